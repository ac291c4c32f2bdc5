"""Personal data by weak supervision, with DataFrame functions only.

Fixed patterns give the base spans. Looser patterns give further candidates. Five labelers
(form, check, gazetteer, context, edges) vote on every candidate or abstain. The votes are counted
by pattern over the whole corpus: a few hundred rows, bounded by the number of possible votes.
Expectation-maximisation on these counts estimates how reliable each labeler is, and its
posteriors train the final classifier, a logistic regression whose weights become a column
expression. Base spans always stay; the classifier decides on the other candidates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions.paths import evaluate_once
from facetlake.llm.scratch import stored

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "check", "gazetteer", "context", "edges")
BEFORE, AFTER = 48, 16

_LOCAL = "A-Za-z0-9._%+-"
# The contract's patterns, written so that no text takes quadratic time: a run is entered at its
# start or where the last match ended, and possessive repeats never look back.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": (rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?[\[(] ?(?i:at) ?[\])] ?[A-Za-z0-9-]++"
              r"(?: ?[\[(] ?(?i:dot) ?[\])] ?[A-Za-z0-9-]++)++"),
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./_])",
    "phone": r"(?<![0-9A-Za-z+(-])\(?[2-9][0-9]{2}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
# What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+"}

_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
_OCTETS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# Gazetteers: endings of mail domains, first digits of card issuers, countries' calling codes.
MAIL_ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "22")
CALLING_CODES = ("1", "33", "34", "44", "49", "39", "41", "43", "31", "32", "351", "52", "54")
CUES = {
    "email": r"e-?mail|mail|correo|courriel|contact|kontakt|contacto|write to|address",
    "ip": r"\bip\b|host|server|address|adresse|direcci[oó]n|ping|client",
    "card": r"card|visa|mastercard|karte|carte|tarjeta|credit|payment",
    "phone": r"phone|tel\b|tel[eé]|call|fax|mobile|cell|handy|contact|anruf|llam",
}
COUNTER_CUES = r"version|isbn|issn|order|invoice|serial|figure|section|\bid\b|\bv\.?$|#$"


def running_sums(values: Column) -> Column:
    """Prefix sums of an array, in blocks of 64 so that long arrays stay linear."""
    def plain(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<int>"), lambda sums, x: F.concat(
            sums, F.array(F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0)) + x)))

    def shifted(blocks: Column) -> Column:
        totals = plain(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return evaluate_once(totals, lambda t: F.flatten(F.transform(
            blocks, lambda b, i: F.transform(
                b, lambda x: x + F.coalesce(F.get(t, i - 1), F.lit(0))))))

    starts = F.sequence(F.lit(1), F.size(values), F.lit(64))
    blocks = F.transform(starts, lambda s: plain(F.slice(values, s, F.lit(64))))
    return F.when(F.size(values) > 0, evaluate_once(blocks, shifted)).otherwise(
        F.array().cast("array<int>"))


_SPAN = ("array<struct<kind:int,start:int,end:int,value:string,before:string,after:string,"
         "base:boolean>>")


def find_spans(text: Column, pattern: str, kind: str, base: bool) -> Column:
    """Leftmost non-overlapping matches with code point offsets and their surroundings.

    The offsets follow from the lengths of the matches and of the gaps between them."""
    def build(parts: Column) -> Column:
        found, gaps = parts["found"], parts["gaps"]
        lengths = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)),
                             lambda m, g: F.length(m) + F.length(g))
        return evaluate_once(running_sums(lengths), lambda ends: F.transform(
            found, lambda m, i: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"),
                m.alias("value"), F.right(F.get(gaps, i), F.lit(BEFORE)).alias("before"),
                F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("after"),
                F.lit(base).alias("base"))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return evaluate_once(found, lambda f: F.when(F.size(f) > 0, evaluate_once(
        F.struct(f.alias("found"), F.split(text, pattern, -1).alias("gaps")), build
    )).otherwise(F.array().cast(_SPAN)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str) -> Callable[[Column], Column]:
    """The conditions on a base match; there are none on mail addresses."""
    def test(span: Column) -> Column:
        digits = digits_of(span["value"])
        if kind == "ip":
            return span["value"].rlike(_OCTETS)
        if kind == "card":
            return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
        if kind == "phone":
            return F.length(digits).between(9, 15)
        return F.lit(True)
    return test


def candidates(text: Column) -> Column:
    """All candidates of a text, base spans first, by kind and start."""
    none = F.array().cast(_SPAN)
    digit = text.rlike("[0-9]")
    base, loose = [], []
    for kind in KINDS:
        needed = text.contains(NEEDS[kind]) if kind in NEEDS else digit
        spans = F.filter(find_spans(text, BASE[kind], kind, True), valid(kind))
        base.append(F.when(needed, spans).otherwise(none))
        needed = text.rlike(r"[\[(] ?(?i:at) ?[\])]") if kind == "email" else digit
        spans = find_spans(text, LOOSE[kind], kind, False)
        if kind == "card":
            spans = F.filter(spans, valid(kind))
        loose.append(F.when(needed, spans).otherwise(none))

    def apart(both: Column) -> Column:
        free = F.filter(both["loose"], lambda x: ~F.exists(
            both["base"], lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
        return F.concat(both["base"], free)

    return evaluate_once(
        F.struct(F.concat(*base).alias("base"), F.concat(*loose).alias("loose")), apart)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(span: Column) -> list[Column]:
    """1 for personal data, -1 against, 0 to abstain; in the order of ``LABELERS``."""
    value, before = span["value"], F.lower(span["before"])
    digits = digits_of(value)
    count = F.length(digits)

    def by_kind(choices: Mapping[str, Column]) -> Column:
        result = F.lit(0)
        for kind, vote in choices.items():
            result = F.when(span["kind"] == KINDS.index(kind), vote).otherwise(result)
        return result

    ending = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)[\])]?$", 1))
    check = by_kind({
        "email": _vote(ending.rlike("^[a-z]{2,}$"), ending.rlike("[0-9]")),
        "ip": _vote(value.rlike(_OCTETS) | value.contains(":"), F.lit(False)),
        "card": _vote(F.call_function("luhn_check", digits), ~F.call_function("luhn_check", digits)),
        "phone": _vote(count.between(10, 15), count < 9),
    })
    gazetteer = by_kind({
        "email": _vote(ending.isin(*MAIL_ENDINGS), F.lit(False)),
        "ip": _vote(F.lit(False), value.rlike(r"^0+\.")),
        "card": _vote(digits.rlike(f"^({'|'.join(CARD_STARTS)})"), digits.rlike("^0")),
        "phone": _vote(
            value.startswith("+") & digits.rlike(f"^({'|'.join(CALLING_CODES)})")
            | ~value.startswith("+") & digits.rlike("^[2-9][0-9]{2}[2-9]"),
            digits.rlike("^0{3}")),
    })
    context = by_kind({k: _vote(before.rlike(CUES[k]), before.rlike(COUNTER_CUES)) for k in KINDS})
    edges = _vote(
        ~span["before"].rlike(r"[\p{L}\p{N}]$") & ~span["after"].rlike(r"^[\p{L}\p{N}]"),
        span["before"].rlike(r"[\p{L}\p{N}]$"))
    return [F.when(span["base"], 1).otherwise(0), check, gazetteer, context, edges]


def _length_class(span: Column) -> Column:
    size = F.length(span["value"])
    return F.when(size < 12, 0).when(size < 20, 1).otherwise(2)


@dataclass(frozen=True)
class SpanModel:
    """``reliability`` of each labeler, ``prior`` of each kind, ``weights`` of the classifier."""

    reliability: tuple[float, ...]
    prior: tuple[float, ...]
    weights: tuple[float, ...]


def _features(kind: int, ballot: Sequence[int], length_class: int) -> list[float]:
    return [1.0, *map(float, ballot), *(float(kind == k) for k in range(1, len(KINDS))),
            float(length_class == 1), float(length_class == 2)]


def fit_model(counts: Sequence[tuple[int, tuple[int, ...], int, int]], rounds: int = 50) -> SpanModel:
    """From counts of (kind, votes, length class, n).

    A labeler that abstains says nothing. Reliability starts at 0.8, held by 20 pseudo-votes,
    priors at 0.5, held by 2. The logistic regression has a small ridge."""
    reliability, prior = [0.8] * len(LABELERS), [0.5] * len(KINDS)

    def posterior(kind: int, ballot: Sequence[int]) -> float:
        odds = math.log(prior[kind] / (1 - prior[kind]))
        for right, vote in zip(reliability, ballot):
            odds += vote * math.log(right / (1 - right))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))

    for _ in range(rounds):
        agree, cast = [16.0] * len(LABELERS), [20.0] * len(LABELERS)
        positive, total = [1.0] * len(KINDS), [2.0] * len(KINDS)
        for kind, ballot, _length, n in counts:
            p = posterior(kind, ballot)
            positive[kind] += n * p
            total[kind] += n
            for j, vote in enumerate(ballot):
                if vote:
                    cast[j] += n
                    agree[j] += n * (p if vote > 0 else 1 - p)
        reliability = [min(0.99, max(0.51, a / c)) for a, c in zip(agree, cast)]
        prior = [min(0.99, max(0.01, a / c)) for a, c in zip(positive, total)]

    rows = [(_features(k, b, size), posterior(k, b), n) for k, b, size, n in counts]
    # Without data the labelers' log odds are the classifier.
    weights = [0.0, *(math.log(r / (1 - r)) for r in reliability), *[0.0] * (len(KINDS) + 1)]
    mass = sum(n for _, _, n in rows) or 1
    for _ in range(400):
        slope = [0.0] * len(weights)
        for x, target, n in rows:
            score = sum(w * v for w, v in zip(weights, x))
            miss = (target - 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))) * n / mass
            for i, v in enumerate(x):
                slope[i] += miss * v
        weights = [w + 0.5 * (g - 1e-4 * w) for w, g in zip(weights, slope)]
    return SpanModel(tuple(reliability), tuple(prior), tuple(weights))


def vote_counts(found: DataFrame) -> DataFrame:
    """``kind, form, check, gazetteer, context, edges, length, n`` over all candidates."""
    spans = found.select(F.explode("candidates").alias("s"))
    named = [v.alias(name) for name, v in zip(LABELERS, votes(F.col("s")))]
    return spans.select(F.col("s.kind").alias("kind"), *named, _length_class(F.col("s"))
                        .alias("length")).groupBy("kind", *LABELERS, "length").agg(
        F.count(F.lit(1)).alias("n"))


def accepted(span: Column, model: SpanModel) -> Column:
    w = model.weights
    score = F.lit(w[0])
    for weight, vote in zip(w[1:], votes(span)):
        score = score + F.lit(weight) * vote
    at = 1 + len(LABELERS)
    for k in range(1, len(KINDS)):
        score = score + F.when(span["kind"] == k, w[at + k - 1]).otherwise(0.0)
    size = _length_class(span)
    score = score + F.when(size == 1, w[-2]).when(size == 2, w[-1]).otherwise(0.0)
    return span["base"] | (score >= 0)


def span_table(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and ``spans``: array of (kind, start, end, base), sorted, for every document.

    ``kind`` is a place in ``KINDS``; offsets are code points, the end exclusive. Candidates are
    stored without their texts, so that counting and deciding read little.

    Defined cases: null and empty texts have no spans; repeated rows each get theirs; an empty
    table gives no rows. Columns named in ``keep`` may have any name but ``spans``.
    """
    body = F.coalesce(docs[text], F.lit(""))
    found = stored(docs.select(
        F.struct(*[docs[k] for k in keep]).alias("row"), candidates(body).alias("candidates"),
    ), "privacy-candidates")
    # At most 4 kinds x 3^5 votes x 3 length classes = 2,916 rows, whatever the corpus.
    counts = [(r["kind"], tuple(r[n] for n in LABELERS), r["length"], r["n"])
              for r in vote_counts(found.where(F.size("candidates") > 0)).collect()]
    model = fit_model(sorted(counts))
    kept = F.filter("candidates", lambda s: accepted(s, model))
    spans = F.sort_array(F.transform(kept, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        s["base"].alias("base"))))
    return found.select("row.*", spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(
        F.get(name, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"),
        s["end"].cast("string"))), ",")


def span_digest(spans: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``id``, base counts by kind, ``base_sha256`` and all ``spans`` as text."""
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}")
        for k, name in enumerate(KINDS)
    ]
    return spans.select(
        id_column, *counts, F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"))


def masked_text(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one.

    Short lists of spans cut the text by offsets; long ones cut an array of its characters, so
    that the time stays in proportion to the text."""
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(ordered: Column, piece: Callable[[Column, Column], Column]) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(state: Column, s: Column) -> Column:
            return F.when(s["start"] < state["at"], F.struct(
                F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"),
            )).otherwise(F.struct(s["end"].alias("at"), F.concat(state["out"], F.array(
                piece(state["at"], s["start"]), F.get(name, s["kind"]))).alias("out")))

        return evaluate_once(F.aggregate(ordered, start, step), lambda done: F.concat(
            F.array_join(done["out"], ""), piece(done["at"], F.lit(None).cast("int"))))

    def by_offset(a: Column, b: Column) -> Column:
        return F.substring(text, a + 1, F.coalesce(b - a, F.length(text)))

    def by_array(chars: Column) -> Callable[[Column, Column], Column]:
        return lambda a, b: F.array_join(F.slice(
            chars, a + 1, F.greatest(F.coalesce(b - a, F.size(chars) - a), F.lit(0))), "")

    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.when(F.size(spans) == 0, text).when(
        F.size(spans) <= 64, evaluate_once(ordered, lambda o: cut(o, by_offset))
    ).otherwise(evaluate_once(ordered, lambda o: evaluate_once(
        F.split(text, ""), lambda chars: cut(o, by_array(chars)))))


def mask_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all columns and rows stay."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), docs[text].alias("_text"))
    spans = span_table(whole, ("_row",), "_text")
    return spans.select(*[
        masked_text(F.col("_row")[c], F.col("spans")).alias(c) if c == text
        else F.col("_row")[c].alias(c) for c in docs.columns
    ])
