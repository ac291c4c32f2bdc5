"""Keyword search, filters, sorts, pages and facets over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from conformance.inputs import (
    CATALOG, DOCS_SQL, FACETS, FIELDS, SORTS, dated, documents, fresh_index, kept_index, sql_fold,
    sql_tokens, stored_index, table,
)
from conformance.registry import case
from conformance.stems import stems_sql
from facetlake.functions import dates
from facetlake.operators import facets, filters, keywords, sorting
from facetlake.operators.keywords import Boosted, Phrase, Word, all_of, any_of, none_of
from facetlake.plans.catalog import BadgeSpec, FacetSpec, IndexField, SortSpec
from facetlake.plans.search import badge_flags, search, select_fields

# --- SQL of the term tables -------------------------------------------------------------

TERMS_SQL = f"""
words AS (
  SELECT id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT doc_id AS id, {sql_tokens(sql_fold('text'))} AS t FROM documents)),
postings AS (
  SELECT 'text' AS field, term, id, count(*) AS tf, 1.0 AS boost, false AS verbatim
  FROM words GROUP BY term, id
  UNION ALL SELECT 'source', source, doc_id, 1, 4.0, true FROM documents WHERE source IS NOT NULL
  UNION ALL SELECT 'lang', lang, doc_id, 1, 2.0, true FROM documents WHERE lang IS NOT NULL),
lengths AS (SELECT field, id, sum(tf) AS len FROM postings GROUP BY field, id),
sums AS (SELECT field, sum(tf) AS sum_len FROM postings GROUP BY field),
dfs AS (SELECT field, term, count(*) AS df FROM postings GROUP BY field, term),
corpus AS (SELECT count(*) AS n FROM documents),
scored AS (
  SELECT p.field, p.term, p.id,
    CASE WHEN verbatim THEN boost ELSE
      (ln(n / (df + 1.0)) + 1) * tf * boost * 2.2
      / (tf * boost + 1.2 * (0.25 + 0.75 * len / (sum_len / n::DOUBLE))) END AS score
  FROM postings p JOIN lengths USING (field, id) JOIN sums USING (field)
  JOIN dfs USING (field, term), corpus)
"""


def leaf_sql(name: str, word: str, fields: str = "'text', 'source', 'lang'") -> str:
    """Documents with a word, with the summed score."""
    return f"""
{name} AS (SELECT id, sum(score) AS s FROM scored
           WHERE term = '{word}' AND field IN ({fields}) GROUP BY id)"""


def phrase_sql(name: str, words: str, slop: int = 1) -> str:
    """Documents with a phrase, scored by its words."""
    listed = words.split()
    joins = " ".join(
        f"JOIN words w{i} ON w{i}.id = w0.id AND w{i}.term = '{w}' "
        f"AND w{i}.pos > w{i - 1}.pos AND w{i}.pos - w{i - 1}.pos <= {slop}"
        for i, w in enumerate(listed) if i
    )
    scores = " + ".join(
        f"(SELECT score FROM scored s WHERE s.id = h.id AND s.field = 'text' AND s.term = '{w}')"
        for w in listed
    )
    return f"""
{name}_hits AS (SELECT DISTINCT w0.id FROM words w0 {joins} WHERE w0.term = '{listed[0]}'),
{name} AS (SELECT h.id, {scores} AS s FROM {name}_hits h)"""


def boolean_sql(leaves: list[str], condition: str, score: str) -> str:
    """Match and score over leaf tables; a0, a1 ... are NULL without a hit."""
    joins = " ".join(f"LEFT JOIN {n} ON {n}.id = d.doc_id" for n in leaves)
    return f"""
SELECT d.doc_id AS id, round({score}, 4) AS score FROM documents d {joins} WHERE {condition}"""


def hits(spark, d, expr):
    return keywords.keyword_hits(stored_index(spark, d), expr, FIELDS).select(
        "id", F.round("score", 4).alias("score")
    )


# --- term tables ------------------------------------------------------------------------


@case("postings", f"""
    WITH {TERMS_SQL}
    SELECT p.field, p.term, p.id, CAST(p.tf AS BIGINT) AS tf, CAST(l.len AS BIGINT) AS len
    FROM postings p JOIN lengths l USING (field, id)
""")
def postings(spark, d):
    return fresh_index(spark, d).postings


@case("term_positions", f"""
    WITH {TERMS_SQL}
    SELECT term, id, string_agg(pos, ',' ORDER BY pos) AS positions FROM words GROUP BY term, id
""")
def term_positions(spark, d):
    return fresh_index(spark, d).positions.filter("field = 'text'").select(
        "term", "id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")
    )


@case("corpus_stats", f"""
    WITH {TERMS_SQL}
    SELECT field, term, CAST(df AS BIGINT) AS df, CAST(sum_len AS BIGINT) AS sum_len,
           CAST(n AS BIGINT) AS n_docs FROM dfs JOIN sums USING (field), corpus
""")
def corpus_stats(spark, d):
    index = fresh_index(spark, d)
    return index.term_stats.join(index.field_stats, "field")


# --- a stemmed field --------------------------------------------------------------------

STEMMED = (IndexField("text", "text", 1.0, ("all",)),)
STEMMED_SQL = f"""
raw AS (
  SELECT id, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT doc_id AS id, {sql_tokens('text')} AS t FROM documents)),
{stems_sql('raw')},
words AS (SELECT id, {sql_fold('stem')} AS term, pos FROM raw JOIN stems USING (word)),
postings AS (SELECT 'text' AS field, term, id, count(*) AS tf, 1.0 AS boost, false AS verbatim
             FROM words GROUP BY term, id),
{TERMS_SQL[TERMS_SQL.index('lengths AS'):]}
"""


def stemmed_texts(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.lit("text").alias("field"), F.lit("").alias("part"), "text")


def stemmed_index(spark, d):
    return kept_index(spark, d, "stemmed-index", stemmed_texts, STEMMED)


@case("stemmed_postings", f"""
    WITH {STEMMED_SQL}
    SELECT p.term, p.id, CAST(p.tf AS BIGINT) AS tf, CAST(l.len AS BIGINT) AS len,
           CAST(df AS BIGINT) AS df
    FROM postings p JOIN lengths l USING (field, id) JOIN dfs USING (field, term)
""")
def stemmed_postings(spark, d):
    index = stemmed_index(spark, d)
    return index.postings.join(index.term_stats, ["field", "term"]).select(
        "term", "id", "tf", "len", "df")


@case("stemmed_search", f"WITH {STEMMED_SQL}, {leaf_sql('a0', 'one')}, {leaf_sql('a1', 'antion')}, "
      + leaf_sql('a2', 'this') + " "
      + boolean_sql(["a0", "a1", "a2"],
                    "(a0.s IS NOT NULL OR a1.s IS NOT NULL) AND a2.s IS NULL",
                    "coalesce(a0.s, 0) + coalesce(a1.s, 0)"))
def stemmed_search(spark, d):
    expr = all_of(any_of(Word("Ones"), Word("antions")), none_of(Word("this")))
    return keywords.keyword_hits(stemmed_index(spark, d), expr, STEMMED).select(
        "id", F.round("score", 4).alias("score"))


@case("stemmed_phrase", f"WITH {STEMMED_SQL}, {phrase_sql('a0', 'as the', 3)} "
      + boolean_sql(["a0"], "a0.s IS NOT NULL", "a0.s"))
def stemmed_phrase(spark, d):
    return keywords.keyword_hits(
        stemmed_index(spark, d), Phrase("AS the", slop=3), STEMMED
    ).select("id", F.round("score", 4).alias("score"))


# --- keyword predicates -----------------------------------------------------------------


@case("term", f"WITH {TERMS_SQL}, {leaf_sql('a0', 'fr')} "
              + boolean_sql(["a0"], "a0.s IS NOT NULL", "a0.s"))
def term(spark, d):
    return hits(spark, d, Word("fr"))


@case("all_of", f"WITH {TERMS_SQL}, {leaf_sql('a0', 'the')}, {leaf_sql('a1', 'and')} "
                + boolean_sql(["a0", "a1"], "a0.s IS NOT NULL AND a1.s IS NOT NULL",
                              "a0.s + a1.s"))
def all_of_words(spark, d):
    return hits(spark, d, all_of(Word("The"), Word("and")))


@case("any_of", f"WITH {TERMS_SQL}, {leaf_sql('a0', 'der')}, {leaf_sql('a1', 'que')} "
                + boolean_sql(["a0", "a1"], "a0.s IS NOT NULL OR a1.s IS NOT NULL",
                              "coalesce(a0.s, 0) + coalesce(a1.s, 0)"))
def any_of_words(spark, d):
    return hits(spark, d, any_of(Word("der"), Word("que")))


@case("none_of", f"WITH {TERMS_SQL}, {leaf_sql('a0', 'the')} "
                 + boolean_sql(["a0"], "a0.s IS NULL", "CAST(0.0 AS DOUBLE)"))
def none_of_words(spark, d):
    return hits(spark, d, none_of(Word("the")))


@case("grouping", f"WITH {TERMS_SQL}, {leaf_sql('a0', 'the')}, {leaf_sql('a1', 'of')}, "
                  f"{leaf_sql('a2', 'des')} "
                  + boolean_sql(
                      ["a0", "a1", "a2"],
                      "(a0.s IS NOT NULL AND a1.s IS NOT NULL) OR (a2.s IS NOT NULL AND a0.s IS NULL)",
                      "CASE WHEN a0.s IS NOT NULL AND a1.s IS NOT NULL THEN a0.s + a1.s ELSE 0 END "
                      "+ CASE WHEN a2.s IS NOT NULL AND a0.s IS NULL THEN a2.s ELSE 0 END"))
def grouping(spark, d):
    return hits(spark, d, any_of(
        all_of(Word("the"), Word("of")), all_of(Word("des"), none_of(Word("the")))
    ))


@case("phrase", f"WITH {TERMS_SQL}, {phrase_sql('a0', 'of the')} "
                + boolean_sql(["a0"], "a0.s IS NOT NULL", "a0.s"))
def phrase(spark, d):
    return hits(spark, d, Phrase("of the", scope="fulltext"))


@case("phrase_slop", f"WITH {TERMS_SQL}, {phrase_sql('a0', 'the and the', 3)} "
                     + boolean_sql(["a0"], "a0.s IS NOT NULL", "a0.s"))
def phrase_slop(spark, d):
    return hits(spark, d, Phrase("the and the", slop=3, scope="fulltext"))


@case("phrase_passages", rf"""
    WITH passages AS (
      SELECT DISTINCT item_id, array_to_string(t[i:i + 3], ' ') AS g FROM (
        SELECT item_id, t, unnest(range(1, len(t) - 2)) AS i FROM (
          SELECT item_id, {sql_tokens(sql_fold('text'))} AS t FROM benchmark))),
    docs AS (
      SELECT DISTINCT id, array_to_string(t[i:i + 3], ' ') AS g FROM (
        SELECT id, t, unnest(range(1, len(t) - 2)) AS i FROM (
          SELECT doc_id AS id, {sql_tokens(sql_fold('text'))} AS t FROM documents)))
    SELECT item_id, id, count(*) AS n_shared FROM passages JOIN docs USING (g)
    GROUP BY item_id, id
""")
def phrase_passages(spark, d):
    """Documents that share four-word phrases with a benchmark passage, over whole texts.

    Phrases of passages are many times rarer than their words, and each document counts a phrase
    once, so no frequent word brings rows together.
    """
    from facetlake.functions.paths import evaluate_once
    from facetlake.functions.text import fold_accents, tokenize

    def phrases(name: str, key: str, alias: str):
        def cut(words):
            starts = F.sequence(F.lit(1), F.size(words) - 3)
            return F.when(F.size(words) >= 4, F.array_distinct(F.transform(
                starts, lambda i: F.array_join(F.slice(words, i, F.lit(4)), " "))))

        tokens = tokenize(fold_accents(F.col("text")))
        return table(spark, d, name).repartition(key).select(
            F.col(key).alias(alias), F.explode(evaluate_once(tokens, cut)).alias("g"))

    shared = phrases("benchmark", "item_id", "item_id").join(
        phrases("documents", "doc_id", "id"), "g")
    return shared.groupBy("item_id", "id").agg(F.count(F.lit(1)).alias("n_shared"))


@case("boost", f"WITH {TERMS_SQL}, {leaf_sql('a0', 'the')}, {leaf_sql('a1', 'de')} "
               + boolean_sql(["a0", "a1"], "a0.s IS NOT NULL OR a1.s IS NOT NULL",
                             "3 * (coalesce(a0.s, 0) * 2 + coalesce(a1.s, 0))"))
def boost(spark, d):
    return hits(spark, d, Boosted(any_of(Boosted(Word("the"), 2), Word("de")), 3))


@case("scopes", f"WITH {TERMS_SQL}, {leaf_sql('a0', 'de', chr(39) + 'lang' + chr(39))}, "
                f"{leaf_sql('a1', 'src1', chr(39) + 'source' + chr(39) + ', ' + chr(39) + 'lang' + chr(39))} "
                + boolean_sql(["a0", "a1"], "a0.s IS NOT NULL AND a1.s IS NOT NULL", "a0.s + a1.s"))
def scopes(spark, d):
    return hits(spark, d, all_of(Word("de", "language"), Word("src1", "metadata")))


@case("multi_keywords", f"WITH {TERMS_SQL}, {leaf_sql('a0', 'the')}, "
                        f"{leaf_sql('a1', 'en', chr(39) + 'lang' + chr(39))} "
                        + boolean_sql(["a0", "a1"], "a0.s IS NOT NULL AND a1.s IS NOT NULL",
                                      "a0.s + a1.s"))
def multi_keywords(spark, d):
    return hits(spark, d, keywords.multi_keywords([Word("the"), Word("en", "language")]))


@case("bm25f_score", f"WITH {TERMS_SQL}, {leaf_sql('a0', 'the')}, {leaf_sql('a1', 'la')}, "
                     f"{leaf_sql('a2', 'en')} "
                     + boolean_sql(["a0", "a1", "a2"],
                                   "a0.s IS NOT NULL OR a1.s IS NOT NULL OR a2.s IS NOT NULL",
                                   "coalesce(a0.s, 0) + coalesce(a1.s, 0) + coalesce(a2.s, 0)"))
def bm25f_score(spark, d):
    return hits(spark, d, any_of(Word("the"), Word("la"), Word("en")))


# --- whole searches ---------------------------------------------------------------------

_BOTH = f"""
{TERMS_SQL}, {leaf_sql('a0', 'the')}, {leaf_sql('a1', 'and')}, {DOCS_SQL},
matched AS (SELECT docs.*, round(a0.s + a1.s, 4) AS score
            FROM docs JOIN a0 USING (id) JOIN a1 USING (id) WHERE lang = 'en')
"""


def _search(spark, d, sort=None, filters=None):
    return search(
        documents(spark, d), stored_index(spark, d), CATALOG, all_of(Word("the"), Word("and")),
        {"lang": ["en"]} if filters is None else filters, sort,
    )


@case("search_page", f"""
    WITH {_BOTH}
    SELECT id, source, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS position
    FROM matched ORDER BY score DESC, id LIMIT 20
""")
def search_page(spark, d):
    result = _search(spark, d)
    result.matched = result.matched.withColumn("score", F.round("score", 4))
    return result.page(1, 20).select("id", "source", "score", "position")


@case("sort_score", f"WITH {_BOTH} SELECT id, score FROM matched")
def sort_score(spark, d):
    return _search(spark, d, "score").everything().select("id", F.round("score", 4).alias("score"))


@case("facet_counts_search", f"""
    WITH {_BOTH}
    SELECT 'lang' AS facet, lang AS value, count(*) AS "count", true AS active FROM matched GROUP BY lang
    UNION ALL SELECT 'source', source, count(*), false FROM matched GROUP BY source
    UNION ALL SELECT 'tag', t, count(*), false
              FROM (SELECT unnest(tags) AS t FROM matched) GROUP BY t
    UNION ALL SELECT 'tag', NULL, count(*), false FROM matched
              WHERE tags IS NULL OR len(tags) = 0
""")
def facet_counts_search(spark, d):
    return _search(spark, d).facets().select("facet", "value", "count", "active")


@case("result_totals", f"""
    WITH {_BOTH} SELECT count(*) AS item_count, CAST(ceil(count(*) / 20.0) AS BIGINT) AS page_count
    FROM matched
""")
def result_totals(spark, d):
    return _search(spark, d).totals(20)


@case("page", """
    SELECT id, n_chars FROM (
      SELECT doc_id AS id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r,
             count(*) OVER () AS n FROM documents)
    WHERE r > (ceil(n / 15.0) - 1) * 15
""")
def page(spark, d):
    """A page far beyond the end is the last page."""
    result = search(documents(spark, d), None, CATALOG, sort="longest")
    return result.page(10 ** 9, 15).select("id", "n_chars")


@case("result_position", """
    SELECT id, CAST(r AS INTEGER) AS position FROM (
      SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents)
    WHERE r BETWEEN 31 AND 40
""")
def result_position(spark, d):
    docs = documents(spark, d)
    rows = sorting.page(docs, SORTS[1], 4, 10)
    return sorting.with_positions(rows, SORTS[1], 4, 10).select("id", "position")


@case("result_at", """
    SELECT id, id <> 7 AS moved FROM (
      SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents)
    WHERE r = 25
""")
def result_at(spark, d):
    return sorting.result_at(documents(spark, d), SORTS[1], 25, 7).select("id", "moved")


@case("all_results", "SELECT doc_id AS id, lang, n_chars FROM documents")
def all_results(spark, d):
    return sorting.all_results(documents(spark, d), SORTS[2]).select("id", "lang", "n_chars")


@case("select_fields", "SELECT doc_id AS id, source FROM documents")
def fields_selected(spark, d):
    return select_fields(documents(spark, d), ["id", "absent"], extra=["source"])


@case("badge_flags", f"""
    WITH {DOCS_SQL}
    SELECT id, n_chars > 2000 AS is_long, coalesce(list_contains(tags, 'quality'), false) AS is_good
    FROM docs
""")
def badges(spark, d):
    specs = [BadgeSpec("is_long", lambda: F.col("n_chars") > 2000, 2),
             BadgeSpec("is_good", lambda: F.array_contains("tags", "quality"), 1)]
    return badge_flags(documents(spark, d), specs).select("id", "is_long", "is_good")


@case("document_count", "SELECT count(*) AS documents FROM documents")
def document_count(spark, d):
    from facetlake.sources.store import document_count as counted

    return counted(documents(spark, d))


# --- filters ----------------------------------------------------------------------------


@case("match_all", "SELECT doc_id AS id, CAST(0 AS DOUBLE) AS score FROM documents")
def match_all(spark, d):
    return hits(spark, d, None)


@case("require_all", """
    SELECT doc_id AS id FROM documents WHERE lang IN ('fr', 'de') AND source IN ('src1', 'src4')
""")
def require_all(spark, d):
    wanted = {"lang": ["fr", "de"], "source": ["src1", "src4"], "absent": ["x"]}
    return filters.require_all(documents(spark, d), wanted).select("id")


@case("require_any", f"""
    WITH {DOCS_SQL} SELECT id FROM docs
    WHERE lang = 'es' OR source = 'src2' OR coalesce(list_contains(tags, 'toxic'), false)
""")
def require_any(spark, d):
    wanted = {"lang": ["es"], "source": ["src2"], "tags": ["toxic"]}
    return filters.require_any(documents(spark, d), wanted).select("id")


@case("date_ranges", """
    SELECT o_orderkey AS id FROM orders
    WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate <= TIMESTAMP '1997-03-31'
""")
def date_ranges(spark, d):
    from datetime import datetime

    span = {"o_orderdate": (datetime(1996, 2, 1), datetime(1997, 3, 31)), "absent": (None, None)}
    return filters.date_ranges(dated(spark, d), span).select("id")


@case("reject_any", f"""
    WITH {DOCS_SQL} SELECT id FROM docs
    WHERE lang <> 'en' AND NOT coalesce(list_contains(tags, 'toxic'), false)
""")
def reject_any(spark, d):
    return filters.reject_any(
        documents(spark, d), {"lang": ["en"], "tags": ["toxic"]}
    ).select("id")


def _by_facets(spark, d, chosen):
    docs = documents(spark, d)
    return docs.filter(filters.facet_condition(FACETS, chosen)).select("id")


@case("facet_equals", "SELECT doc_id AS id FROM documents WHERE source = 'src1'")
def facet_equals(spark, d):
    return _by_facets(spark, d, {"source": ["src1"], "unknown": ["x"]})


@case("facet_prefix", """
    SELECT o_orderkey AS id FROM orders WHERE year(o_orderdate) BETWEEN 1990 AND 1999
""")
def facet_prefix(spark, d):
    orders = _year_docs(spark, d)
    return orders.filter(filters.facet_condition([YEAR], {"year": ["1900.1990"]})).select("id")


@case("facet_missing", f"""
    WITH {DOCS_SQL} SELECT id FROM docs WHERE tags IS NULL OR len(tags) = 0
""")
def facet_missing(spark, d):
    return _by_facets(spark, d, {"topic": [""]})


@case("facet_conjunction", f"""
    WITH {DOCS_SQL} SELECT id FROM docs
    WHERE lang = 'en' AND list_contains(tags, 'quality') AND list_contains(tags, 'toxic')
""")
def facet_conjunction(spark, d):
    return _by_facets(spark, d, {"lang": ["en"], "topic": ["quality", "toxic"]})


# --- facet counts -----------------------------------------------------------------------

YEAR = FacetSpec("year", "years", "year", "path", multi=True, missing_label="Unknown",
                 path_label=lambda p: dates.year_path_label(p, 1998))
STATUS_LABELS = {"F": "Filled", "O": "Open", "P": "Partial"}


def _year_docs(spark, d):
    return dated(spark, d).withColumn("years", dates.year_path(F.col("parsed_date")))


@case("facet_counts_multi", """
    SELECT flag AS value, count(*) AS "count" FROM (
      SELECT DISTINCT l_orderkey, l_returnflag AS flag FROM lineitem
      UNION SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem) GROUP BY flag
""")
def facet_counts_multi(spark, d):
    """Line flags of an order as one multi-valued facet; two flags of fixed alphabets per order."""
    flags = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_set("l_returnflag").alias("returned"),
        F.collect_set("l_linestatus").alias("status"),
    ).select("id", F.array_union("returned", "status").alias("flags"))
    spec = FacetSpec("flag", "flags", "flag", multi=True)
    return facets.facet_counts(flags, [spec]).select("value", "count")


@case("facet_counts_single", "SELECT lang AS value, count(*) AS \"count\" FROM documents GROUP BY lang")
def facet_counts_single(spark, d):
    return facets.facet_counts(documents(spark, d), FACETS[:1]).select("value", "count")


@case("facet_missing_bucket", f"""
    WITH {DOCS_SQL}
    SELECT t AS value, t AS label, count(*) AS "count" FROM (SELECT unnest(tags) AS t FROM docs)
    GROUP BY t
    UNION ALL SELECT NULL, 'Unlabelled', count(*) FROM docs WHERE tags IS NULL OR len(tags) = 0
""")
def facet_missing_bucket(spark, d):
    return facets.facet_counts(documents(spark, d), FACETS[2:]).select("value", "label", "count")


_ALL_COUNTS = f"""
{DOCS_SQL},
counts AS (
  SELECT 'lang' AS facet, lang AS value, lang AS label, count(*) AS "count" FROM docs GROUP BY lang
  UNION ALL SELECT 'source', source, source, count(*) FROM docs GROUP BY source
  UNION ALL SELECT 'tag', t, t, count(*) FROM (SELECT unnest(tags) AS t FROM docs) GROUP BY t
  UNION ALL SELECT 'tag', NULL, 'Unlabelled', count(*) FROM docs
            WHERE tags IS NULL OR len(tags) = 0)
"""


@case("facet_counts_all", f"WITH {_ALL_COUNTS} SELECT * FROM counts")
def facet_counts_all(spark, d):
    return facets.facet_counts(documents(spark, d), FACETS)


_YEAR_COUNTS = """
years AS (SELECT o_orderkey AS id, year(o_orderdate) AS y FROM orders),
levels AS (
  SELECT id, CAST((y // 100) * 100 AS VARCHAR) AS value, NULL AS parent, 1 AS depth,
         'Between ' || (y // 100) * 100 || ' and ' || least((y // 100) * 100 + 99, 1998) AS label
  FROM years
  UNION ALL SELECT id, (y // 100) * 100 || '.' || (y // 10) * 10,
         CAST((y // 100) * 100 AS VARCHAR), 2,
         'Between ' || (y // 10) * 10 || ' and ' || least((y // 10) * 10 + 9, 1998) FROM years
  UNION ALL SELECT id, (y // 100) * 100 || '.' || (y // 10) * 10 || '.' || y,
         (y // 100) * 100 || '.' || (y // 10) * 10, 3, CAST(y AS VARCHAR) FROM years)
"""


@case("facet_tree", f"""
    WITH {_YEAR_COUNTS}
    SELECT value, parent, CAST(depth AS INTEGER) AS depth, count(*) AS "count",
           row_number() OVER (PARTITION BY parent ORDER BY lower(label), value) AS place
    FROM levels GROUP BY value, label, parent, depth
""")
def facet_tree(spark, d):
    tree = facets.with_active(facets.facet_tree(_year_docs(spark, d), YEAR), [YEAR], {})
    return facets.tree_places(tree, YEAR).select("value", "parent", "depth", "count", "place")


@case("facet_labels", f"""
    WITH {_YEAR_COUNTS} SELECT value, label, count(*) AS "count" FROM levels GROUP BY ALL
""")
def facet_labels(spark, d):
    return facets.facet_counts(_year_docs(spark, d), [YEAR]).select("value", "label", "count")


@case("active_facets", f"""
    WITH {_ALL_COUNTS}
    SELECT facet, value, "count" FROM counts
    WHERE (facet = 'lang' AND value = 'fr') OR (facet = 'tag' AND value IS NULL)
""")
def active_facets(spark, d):
    counts = facets.facet_counts(documents(spark, d), FACETS)
    chosen = {"lang": ["fr"], "topic": [""]}
    return facets.active_facets(counts, FACETS, chosen).select("facet", "value", "count")


@case("facets_when_empty", f"""
    WITH {DOCS_SQL}
    SELECT 'lang' AS facet, lang AS value, count(*) AS "count" FROM docs WHERE lang = 'fr' GROUP BY lang
    UNION ALL SELECT 'tag', t, count(*) FROM (
      SELECT unnest(tags) AS t FROM docs
      WHERE list_contains(tags, 'toxic') AND list_contains(tags, 'quality')) GROUP BY t
""")
def facets_when_empty(spark, d):
    chosen = {"lang": ["fr"], "topic": ["toxic", "quality"]}
    return facets.facets_when_empty(documents(spark, d), FACETS, chosen).select(
        "facet", "value", "count"
    )


@case("facets_of_item", f"""
    WITH {DOCS_SQL}
    SELECT id, 'lang' AS facet, lang AS value, CAST(0 AS BIGINT) AS "count" FROM docs
    UNION ALL SELECT id, 'source', source, 0 FROM docs
    UNION ALL SELECT id, 'tag', t, 0 FROM (SELECT id, unnest(tags) AS t FROM docs)
    UNION ALL SELECT id, 'tag', NULL, 0 FROM docs WHERE tags IS NULL OR len(tags) = 0
""")
def facets_of_item(spark, d):
    return facets.facets_of_item(documents(spark, d), FACETS, "id").drop("label")


def _counts(spark, d, chosen=None):
    counts = facets.facet_counts(documents(spark, d), FACETS)
    return facets.with_active(counts, FACETS, chosen)


@case("facet_flat_rows", f"""
    WITH {_ALL_COUNTS}
    SELECT value, label, "count", value = 'src3' AS active FROM counts WHERE facet = 'source'
""")
def facet_flat_rows(spark, d):
    return facets.ordered_facet(_counts(spark, d, {"source": ["src3"]}), FACETS[1]).drop("facet")


@case("facet_order", f"""
    WITH {_ALL_COUNTS}
    SELECT value, "count", CAST(row_number() OVER (
      ORDER BY value <> 'src3', label = '', "count" DESC, label, value) AS INTEGER) AS place
    FROM counts WHERE facet = 'source'
""")
def facet_order(spark, d):
    from pyspark.sql import Window

    rows = _counts(spark, d, {"source": ["src3"]}).filter("facet = 'source'")
    window = Window.partitionBy("facet").orderBy(*facets.directed_order(FACETS[1]))
    return rows.select("value", "count", F.row_number().over(window).alias("place"))


@case("limit_with_leeway", f"""
    WITH {_ALL_COUNTS},
    ranked AS (
      SELECT facet, value, "count", count(*) OVER (PARTITION BY facet) AS n,
        row_number() OVER (PARTITION BY facet ORDER BY
          CASE WHEN facet = 'source' THEN -"count" ELSE 0 END, label, value) AS r
      FROM counts)
    SELECT facet, value, "count" FROM ranked
    WHERE (facet = 'lang' AND (r <= 2 OR n <= 3)) OR (facet = 'source' AND (r <= 10 OR n <= 14))
       OR facet = 'tag'
""")
def limit_with_leeway(spark, d):
    return facets.limit_with_leeway(_counts(spark, d), FACETS).select("facet", "value", "count")


@case("facet_tag", f"""
    WITH {DOCS_SQL} SELECT t AS value, count(*) AS "count"
    FROM (SELECT unnest(tags) AS t FROM docs) GROUP BY t
""")
def facet_tag(spark, d):
    spec = FacetSpec("tag", "tags", "topic", "flat", multi=True)
    return facets.facet_counts(documents(spark, d), [spec]).select("value", "count")


@case("facet_item_type", """
    SELECT o_orderstatus AS value,
           CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE 'P' END AS label,
           count(*) AS "count"
    FROM orders GROUP BY o_orderstatus
""")
def facet_item_type(spark, d):
    """Labels come from a table of types; a type without label shows its code."""
    labelled = _with_type_labels(spark, d)
    spec = FacetSpec("item_type", "typed", "type", "labelled")
    return facets.facet_counts(labelled, [spec]).select("value", "label", "count")


def _with_type_labels(spark, d):
    from facetlake.functions.values import labelled
    from facetlake.operators.dimensions import type_labels

    locale = spark.sql("""SELECT * FROM VALUES ('F', 'en', 'Filled'), ('O', 'en', 'Open'),
        ('P', 'fr', 'Partiel') AS t(item_type, locale, localized)""")
    orders = dated(spark, d).withColumn("item_type", F.col("o_orderstatus"))
    joined = orders.join(type_labels(locale, "en"), "item_type", "left")
    return joined.withColumn(
        "typed", labelled(F.col("item_type"), F.coalesce("type_label", "item_type"))
    )


@case("type_label", """
    SELECT o_orderkey AS id, o_orderstatus AS item_type,
           CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' END AS type_label
    FROM orders
""")
def type_label(spark, d):
    return _with_type_labels(spark, d).select("id", "item_type", "type_label")


@case("facet_year", f"""
    WITH {_YEAR_COUNTS} SELECT value, label, count(*) AS "count" FROM levels GROUP BY ALL
""")
def facet_year(spark, d):
    chosen = {"year": ["1900"]}
    docs = _year_docs(spark, d)
    total = facets.facet_counts(docs, [YEAR])
    flagged = facets.with_active(total, [YEAR], chosen)
    return facets.ordered_facet(flagged, YEAR).select("value", "label", "count")


@case("facet_language", """
    SELECT code AS value, name AS label, count(*) AS "count" FROM (
      SELECT CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' ELSE 'spa' END
               AS code,
             CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German'
               ELSE 'Spanish' END AS name
      FROM documents) GROUP BY ALL
""")
def facet_language(spark, d):
    from facetlake.functions.languages import normalize_language

    docs = documents(spark, d).withColumn("languages", normalize_language(F.col("lang")))
    spec = FacetSpec("language", "languages", "lang", "labelled", multi=True)
    return facets.facet_counts(docs, [spec]).select("value", "label", "count")


@case("facet_link", """
    SELECT CASE WHEN u THEN 't' ELSE 'f' END AS value, CASE WHEN u THEN 'yes' ELSE 'no' END AS label,
           count(*) AS "count"
    FROM (SELECT starts_with(url, 'https:') AS u FROM pages) GROUP BY u
""")
def facet_link(spark, d):
    from facetlake.functions.values import has_url

    secure = F.when(F.startswith("url", F.lit("https:")), F.col("url"))
    docs = table(spark, d, "pages").withColumn("online", has_url(secure))
    spec = FacetSpec("link", "online", "link", "boolean")
    return facets.facet_counts(docs, [spec]).select("value", "label", "count")


# --- sorts ------------------------------------------------------------------------------


def _top(name: str, spec: SortSpec, order_sql: str):
    """A sort shown by the place it gives to every row."""
    @case(name, f"""
        WITH r AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY {order_sql}) AS place
                   FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT id, place FROM r
    """)
    def query(spark, d):
        customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
        rows = table(spark, d, "orders").join(
            customers, F.col("o_custkey") == F.col("c_custkey")
        ).select(
            F.col("o_orderkey").alias("id"), F.col("c_name").alias("sort_creator"),
            F.col("c_mktsegment").alias("sort_title"),
            dates.sort_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("sort_date"),
            F.unix_timestamp("o_orderdate").alias("sort_date_added"),
        )
        return sorting.all_positions(rows, spec, name="place").select("id", "place")
    return query


from facetlake.plans.catalog import DEFAULT_SORTS  # noqa: E402

_BY_KEY = {s.key: s for s in DEFAULT_SORTS}
for _name, _key, _sql in (
    ("sort_recently_added", "recently_added",
     "o_orderdate DESC, o_orderdate DESC, c_name, c_mktsegment, o_orderkey"),
    ("sort_date_desc", "date_desc", "o_orderdate DESC, c_name, c_mktsegment, o_orderkey"),
    ("sort_date_asc", "date_asc", "o_orderdate, c_name, c_mktsegment, o_orderkey"),
    ("sort_author_asc", "author_asc", "c_name, c_mktsegment, o_orderdate, o_orderkey"),
    ("sort_author_desc", "author_desc", "c_name DESC, c_mktsegment, o_orderdate, o_orderkey"),
    ("sort_title_asc", "title_asc", "c_mktsegment, c_name, o_orderdate, o_orderkey"),
    ("sort_title_desc", "title_desc", "c_mktsegment DESC, c_name, o_orderdate, o_orderkey"),
):
    _top(_name, _BY_KEY[_key], _sql)
_top("multi_key_sort", SortSpec("own", ("sort_title", "sort_date", "sort_creator"),
                                (True, False, True)),
     "c_mktsegment DESC, o_orderdate, c_name DESC, o_orderkey")
_top("sort_single_key", SortSpec("one", ("sort_date_added",), True),
     "o_orderdate DESC, o_orderkey")
