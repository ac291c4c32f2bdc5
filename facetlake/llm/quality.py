"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Every text gives counts and a vector of four transformed statistics. For each group of documents
the minimum-covariance-determinant method looks for the three quarters of the rows with the
tightest covariance: from two starts at the medians, rows are ranked by Mahalanobis distance and
mean and covariance are taken anew from the nearest ones, until the determinant stops falling; the
start with the least determinant counts. Rows far outside that core are rejected.
DataFrame functions only; groups are moments in a table, never rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions.paths import evaluate_once
from facetlake.llm.scratch import small, stored

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WINDOW = 5

VECTOR = ("x0", "x1", "x2", "x3")
# Least standard deviation of each statistic. Most clean texts have no symbols and no repeated
# lines at all, so that the plain estimate can be 0; short texts vary more than long ones. Each is
# small enough for its statistic to pass the cutoff alone: x3, which ends at 1, does from a share of
# 0.52 of repeated lines.
LEAST_SPREAD = (0.06, 0.1, 0.08, 0.12)
CORE_SHARE = 0.75
LEAST_FALL = 1e-3  # of the logarithm of the determinant; a smaller one ends the steps
MAD_TO_SPREAD = 1.4826
MEDIAN_CHI2 = 3.3567  # median of chi-square with four degrees of freedom
CUTOFF = 36.0  # its quantile at about 1 - 3e-7
LEAST_ROWS = 200
_MODEL = ("g", "start", *[f"m{i}" for i in range(len(VECTOR))],
          *[f"l{i}{j}" for i in range(len(VECTOR)) for j in range(i + 1)], "logdet")


def text_hash(text: Column) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def text_words(text: Column) -> Column:
    """Maximal runs without blanks (space, tab to carriage return); null counts as empty."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.filter(F.split(trimmed, BLANK_RUN), lambda w: w != "")


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of five words."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    return F.when(F.size(words) >= WINDOW, F.transform(
        starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, in one pass over sorted windows."""
    def count(ordered: Column) -> Column:
        def repeated(x: Column, k: Column) -> Column:
            same_before = F.get(ordered, k - 1)["h"] == x["h"]
            same_after = F.get(ordered, k + 1)["h"] == x["h"]
            return F.coalesce(same_before, F.lit(False)) | F.coalesce(same_after, F.lit(False))

        places = F.sort_array(F.transform(F.filter(ordered, repeated), lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
        return F.aggregate(places, start, lambda s, i: F.struct(
            (s["n"] + (i + WINDOW) - F.greatest(i, s["end"])).alias("n"),
            (i + WINDOW).alias("end"),
        ))["n"]

    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return evaluate_once(F.sort_array(placed), count)


def repeated_words(words: Column) -> Column:
    """How many words lie in five-word windows found twice or more, first ones included.

    Only a text whose windows are not all distinct sorts them."""
    return evaluate_once(_window_hashes(words), lambda hashes: F.when(
        F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")
    ).otherwise(_covered(hashes)))


def _count_of(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def text_statistics(text: Column) -> Column:
    """Struct of the counts of a whole text and of its transformed statistics."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def line_counts(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        )

    return F.struct(
        evaluate_once(text_words(text), counts).alias("w"),
        evaluate_once(lines, line_counts).alias("l"),
        _count_of(body, r"[^#*$%&|<>]+").alias("n_symbols"),
        _count_of(body, r"[^A-Z]+").alias("n_upper"),
    )


def document_statistics(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``id, lang, source``, text hash ``t``, the counts, ``base_failed`` and the vector ``x0 ... x3``:
    logarithm of the mean word length; square roots of symbols per word, of the share of
    capitals and of the share of repeated lines."""
    s = docs.select(
        docs[id_column].alias("id"),
        F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"),
        F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source"),
        text_hash(docs["text"]).alias("t"), text_statistics(docs["text"]).alias("s"),
    ).select("id", "lang", "source", "t", "s.w.*", "s.l.*", "s.n_symbols", "s.n_upper")
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return s.select(
        "id", "lang", "source", "t", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .alias("base_failed"),
        F.log(chars / words).alias("x0"),
        F.sqrt(F.col("n_symbols") / words).alias("x1"),
        F.sqrt(F.col("n_upper") / chars).alias("x2"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("x3"),
    )


def _grouped(rows: DataFrame, least_rows: int) -> DataFrame:
    """``rows`` with a group ``g``, null where ``base_failed``: by language and source; sources
    with too few rows by language; languages with too few such rows all together."""
    usable = rows.where(~F.col("base_failed"))
    own = stored(
        usable.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least_rows).select("lang", "source", F.lit(True).alias("own")),
        "quality-sources")
    own = small(own, 80)
    rest = usable.join(own, ["lang", "source"], "left").where("own IS NULL")
    common = stored(
        rest.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least_rows).select("lang", F.lit(True).alias("common")),
        "quality-languages")
    group = F.when(~F.col("base_failed"), F.when(
        F.col("own"), F.to_json(F.struct("lang", "source"))
    ).when(F.col("common"), F.to_json(F.struct("lang"))).otherwise("{}"))
    return rows.join(own, ["lang", "source"], "left").join(
        small(common, 60), "lang", "left").select(*rows.columns, group.alias("g"))


def _factored(moments: DataFrame) -> DataFrame:
    """``_MODEL``: means, the Cholesky factor ``l00, l10, ...`` of covariance plus spread, and the
    logarithm of its determinant."""
    p, n = len(VECTOR), F.col("n")
    table = moments.select(
        "g", "start", "n", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(p)],
        *[f"s{i}{j}" for i in range(p) for j in range(i + 1)])
    for i in range(p):
        for j in range(i + 1):
            value = F.col(f"s{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")
            if i == j:
                value = F.greatest(value, F.lit(0.0)) + LEAST_SPREAD[i] ** 2
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # Rounding can bring a pivot down to 0, never far below.
            factor = F.sqrt(F.greatest(value, F.lit(1e-9))) if i == j else value / F.col(f"l{j}{j}")
            table = table.withColumn(f"l{i}{j}", factor)
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(1, p)), 2 * F.log("l00"))
    return table.withColumn("logdet", logdet).select(*_MODEL)


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    solved: list[Column] = []
    for i, x in enumerate(VECTOR):
        value = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(f"l{i}{k}") * solved[k]
        solved.append(value / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for y in solved:
        total = total + y * y
    return total


def _moments(rows: DataFrame) -> DataFrame:
    p = len(VECTOR)
    return rows.groupBy("g", "start").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(VECTOR[i]).alias(f"s{i}") for i in range(p)],
        *[F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"s{i}{j}")
          for i in range(p) for j in range(i + 1)],
    )


def _measured(grouped: DataFrame, model: DataFrame) -> DataFrame:
    return grouped.join(small(model, 200), "g").withColumn("d2", _distance())


def _starts(grouped: DataFrame) -> DataFrame:
    """``_MODEL``: for each group the medians with twice the least spreads (0), and with the
    spreads that the median deviations stand for (1)."""
    p = len(VECTOR)
    middle = [F.percentile_approx(x, 0.5).alias(f"m{i}") for i, x in enumerate(VECTOR)]
    centre = stored(grouped.groupBy("g").agg(*middle), "quality-centre")
    deviation = [F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5).alias(f"d{i}")
                 for i, x in enumerate(VECTOR)]
    apart = grouped.join(small(centre, 60), "g").groupBy("g").agg(*deviation)
    both = stored(centre.join(apart, "g"), "quality-deviations")

    def start(number: int, spread: list[Column]) -> DataFrame:
        return both.select(
            "g", F.lit(number).alias("start"), *[f"m{i}" for i in range(p)],
            *[(spread[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}")
              for i in range(p) for j in range(i + 1)],
            F.lit(float("inf")).alias("logdet"))

    return start(0, [F.lit(2 * x) for x in LEAST_SPREAD]).union(start(1, [
        F.sqrt(x ** 2 + (MAD_TO_SPREAD * F.col(f"d{i}")) ** 2)
        for i, x in enumerate(LEAST_SPREAD)]))


def fit_core(grouped: DataFrame) -> DataFrame:
    """``g``, location, factor and ``scale`` of every group's core.

    ``scale`` is the median squared distance over its value for a normal core, at least 1.
    Quantiles are approximate to 1/10,000 of a group's rows. A start goes on while its
    determinant falls, which the least spreads bound from below.
    """
    key = ["g", "start"]
    model = stored(_starts(grouped), "quality-start")
    settled = model.limit(0)
    while not model.isEmpty():
        near = stored(_measured(grouped, model).groupBy(*key).agg(
            F.percentile_approx("d2", CORE_SHARE).alias("near")), "quality-near")
        core = _measured(grouped, model).join(small(near, 60), key).where("d2 <= near")
        fresh = stored(_factored(_moments(core)), "quality-step")
        before = model.select(*key, F.col("logdet").alias("before"))
        falling = stored(fresh.join(before, key).where(
            F.col("logdet") < F.col("before") - LEAST_FALL).select(*_MODEL), "quality-falling")
        settled = stored(settled.union(model.join(falling.select(*key), key, "left_anti").select(
            *_MODEL)), "quality-settled")
        model = falling
    rest = [c for c in _MODEL if c != "g"]
    best = stored(settled.groupBy("g").agg(
        F.min_by(F.struct(*rest), F.struct("logdet", "start")).alias("best")
    ).select("g", "best.*"), "quality-best")
    spread = _measured(grouped, best).groupBy("g").agg(
        F.greatest(F.percentile_approx("d2", 0.5) / MEDIAN_CHI2, F.lit(1.0)).alias("scale"))
    return stored(best.join(spread, "g").drop("start", "logdet"), "quality-core")


def _judged(docs: DataFrame, id_column: str, least_rows: int, cutoff: float) -> DataFrame:
    rows = stored(document_statistics(docs, id_column), "quality-statistics")
    grouped = stored(_grouped(rows, least_rows), "quality-groups")
    core = fit_core(grouped.where("g IS NOT NULL"))
    measured = grouped.join(small(core, 220), "g", "left").withColumn(
        "distance", _distance() / F.col("scale"))
    far = F.coalesce(F.col("distance") > cutoff, F.lit(False))
    return measured.withColumn("kept", ~F.col("base_failed") & ~far)


def judge_quality(
    docs: DataFrame,
    id_column: str = "doc_id",
    least_rows: int = LEAST_ROWS,
    cutoff: float = CUTOFF,
) -> DataFrame:
    """``id``, the counts, ``base_failed``, ``distance`` and ``kept`` of every document.

    A document fails with fewer than 10 words or more than a fifth of them in repeated windows;
    those rows take no part in the estimates. The others are kept unless their squared distance
    from their group's core exceeds ``cutoff`` times the group's scale. Repeated ids are
    each judged.

    Defined cases: a null text has no words and fails; null languages or sources form groups of
    their own; groups below ``least_rows`` are pooled by language, then all together; an empty
    table gives no rows. Reads ``lang``, ``source``, ``text`` and the id; other columns are
    ignored.
    """
    return _judged(docs, id_column, least_rows, cutoff).select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "distance", "kept")


def keep_good_documents(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with all their columns."""
    bad = stored(
        _judged(docs, id_column, LEAST_ROWS, CUTOFF).where("NOT kept")
        .select(F.col("id").alias("_gone_id"), F.col("t").alias("_gone_text")).distinct(), "quality-rejected")
    return docs.join(
        small(bad, 32), docs[id_column].eqNullSafe(F.col("_gone_id"))
        & (text_hash(docs["text"]) == F.col("_gone_text")), "left_anti")
