import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from facetlake.functions.stemming import stem
from facetlake.functions.text import fold_word
from facetlake.operators import facets, filters, hierarchy, keywords, lookups, relations, sorting
from facetlake.operators.index_tables import TermIndex, build_term_index
from facetlake.operators.keywords import Boosted, Phrase, Word, all_of, any_of, none_of
from facetlake.operators.numbering import global_positions
from facetlake.operators.tags import tag_filter, tag_gate
from facetlake.plans.catalog import Catalog, FacetSpec, IndexField, SortSpec, default_catalog
from facetlake.plans.search import search

# --- tags -------------------------------------------------------------------------------


@pytest.mark.parametrize("tags, include, exclude, expected", [
    ([], "", "", True), (None, "", "_x", True), (["a"], "", "a", False), (["a"], "a", "", True),
    (["ba"], "a", "", False), ([" a "], "a", "", True), (["a", "b"], ["a", "b"], "", True),
    (["a"], ["a", "b"], "", False), (["a"], "", ["a", "b"], True),
    (["a", "b"], "", ["a", "b"], False), (["a", "b"], "a", "b", False), ([], "a", "", False),
])
def test_tag_gate(spark, tags, include, exclude, expected):
    row = spark.createDataFrame([(tags,)], "t array<string>")
    assert row.select(tag_gate(F.col("t"), include, exclude)).first()[0] is expected


def test_tag_filter(spark):
    row = spark.createDataFrame([([" a ", "a", "", "_b", "c"],)], "t array<string>")
    assert row.select(tag_filter(F.col("t"), "", "^_")).first()[0] == ["a", "c"]
    assert row.select(tag_filter(F.col("t"), "z")).first()[0] is None


# --- filters ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([
        (1, "book", ["x", "y"], datetime(2020, 1, 1), [["a"], ["a", "b"]]),
        (2, "bookSection", [], None, [["ab"]]),
        (3, None, None, datetime(2021, 6, 1), None),
    ], "id int, kind string, tags array<string>, at timestamp, place array<array<string>>")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filters(items):
    assert ids(filters.require_all(items, {"kind": ["book"], "unknown": ["q"]})) == [1]
    assert ids(filters.require_any(items, {"kind": ["bookSection"], "tags": ["y"]})) == [1, 2]
    assert ids(filters.require_any(items, {})) == [1, 2, 3]
    assert ids(filters.require_any(items, {"unknown": ["q"]})) == []
    assert ids(filters.reject_any(items, {"kind": ["book"]})) == [2, 3]
    assert ids(filters.date_ranges(items, {"at": (datetime(2020, 6, 1), None)})) == [3]
    assert ids(filters.date_ranges(items, {"at": (None, None)})) == [1, 3]


def test_facet_filters(items):
    kind = FacetSpec("kind", "kind", "kind")
    tag = FacetSpec("tag", "tags", "topic", multi=True)
    place = FacetSpec("place", "place", "where", "path", multi=True)
    def kept(**chosen):
        return ids(items.filter(filters.facet_condition([kind, tag, place], chosen)))
    assert kept(kind=["book"]) == [1]  # Not the section, although its code starts alike.
    assert kept(topic=[""]) == [2, 3]
    assert kept(where=["a"]) == [1]
    assert kept(where=["a.b"], topic=["x"]) == [1]
    assert kept(nothing=["x"]) == [1, 2, 3]


# --- facets -----------------------------------------------------------------------------


def test_facet_order_and_reverse(spark):
    rows = spark.createDataFrame(
        [("k", "b", "Bé", 5, False), ("k", "a", "ba", 9, False), ("k", "z", "zz", 1, True),
         ("k", None, "", 7, False)],
        "facet string, value string, label string, count long, active boolean")
    spec = FacetSpec("k", "c", "k", missing_label="?")
    def shown(s):
        return [r["value"] for r in facets.ordered_facet(rows, s).collect()]
    assert shown(spec) == ["z", "a", "b", None]
    by_count = FacetSpec("k", "c", "k", missing_label="?", sort_by=("count",))
    assert shown(by_count) == ["z", "a", "b", None]
    reverse = FacetSpec("k", "c", "k", missing_label="?", sort_reverse=True)
    assert shown(reverse) == ["b", "a", None, "z"]
    assert None not in shown(FacetSpec("k", "c", "k"))


def test_facet_totals(spark):
    docs = spark.createDataFrame(
        [(i, None if i % 3 == 0 else "v%d" % (i % 4)) for i in range(60)], "id int, v string")
    spec = FacetSpec("v", "v", "v", missing_label="none")
    counts = facets.facet_counts(docs, [spec]).collect()
    assert sum(r["count"] for r in counts) == 60


def test_tree_counts_are_consistent(spark):
    rng = random.Random(1)
    rows = []
    for i in range(80):
        leaf = [str(rng.randint(1, 2)), str(rng.randint(1, 3))]
        rows.append((i, [leaf[:1], leaf]))
    docs = spark.createDataFrame(rows, "id int, p array<array<string>>")
    tree = facets.facet_tree(docs, FacetSpec("p", "p", "p", "path", multi=True)).collect()
    count = {r["value"]: r["count"] for r in tree}
    for r in tree:
        if r["parent"] is not None:
            assert count[r["parent"]] >= r["count"]
    below = {v: sum(c for k, c in count.items() if k.startswith(v + ".")) for v in ("1", "2")}
    assert below == {v: count[v] for v in below}


# --- sorting and pages ------------------------------------------------------------------


def test_pages_concatenate(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.randint(0, 5)) for i in range(47)], "id int, k int")
    spec = SortSpec("k", ("k",), True)
    everything = [r["id"] for r in sorting.all_results(df, spec).collect()]
    pages = [[r["id"] for r in sorting.page(df, spec, p, 10, item_count=47).collect()]
             for p in range(1, 7)]
    assert sum(pages[:5], []) == everything
    assert pages[5] == pages[4]
    assert sorting.result_totals(df, 10).first()[:] == (47, 5)
    numbered = global_positions(df, sorting.sort_columns(spec)).orderBy("position").collect()
    assert [r["id"] for r in numbered] == everything
    assert [r["position"] for r in numbered] == list(range(1, 48))


# --- hierarchy --------------------------------------------------------------------------


def test_ancestor_paths(spark):
    nodes = spark.createDataFrame([
        ("r", None, None), ("a", "r", False), ("b", "a", None), ("t", "r", True), ("u", "t", None),
        ("m", "missing", None), ("x", "y", None), ("y", "x", None), ("e", "", None),
    ], "key string, parent string, trashed boolean")
    found = {r["key"]: r["path"] for r in hierarchy.ancestor_paths(nodes).collect()}
    assert found == {"r": ["r"], "a": ["r", "a"], "b": ["r", "a", "b"], "e": ["e"]}
    every = {r["key"] for r in hierarchy.ancestor_paths(nodes, include_trashed=True).collect()}
    assert every == {"r", "a", "b", "t", "u", "e"}
    deep = spark.createDataFrame(
        [(str(i), str(i - 1) if i else None, None) for i in range(150)]
        + [("x", "y", None), ("y", "x", None), ("z", "x", None)],
        "key string, parent string, trashed boolean")
    found = {r["key"]: r["path"] for r in hierarchy.ancestor_paths(deep).collect()}
    assert found == {str(i): [str(k) for k in range(i + 1)] for i in range(150)}


def test_collection_membership(spark):
    nodes = spark.createDataFrame([
        ("A", None, "Root A", None), ("A1", "A", " One ", None), ("A11", "A1", "Eleven", None),
        ("A2", "A", None, None), ("B", None, "Root B", None), ("B1", "B", "B one", True),
    ], "key string, parent string, name string, trashed boolean")
    member = spark.createDataFrame(
        [(1, "A11"), (1, "A1"), (1, "B"), (2, "B1"), (3, "A2")], "id int, key string")
    closure = hierarchy.ancestor_paths(nodes)
    paths = hierarchy.collection_paths(member, nodes, closure)
    tree = hierarchy.collection_facet_paths(paths, nodes, "A").collect()
    assert sorted((r["id"], ".".join(r["path"]), r["label"]) for r in tree) == [
        (1, "A1", "One"), (1, "A1.A11", "Eleven"), (3, "A2", "")]
    items = member.select("id").distinct().unionByName(spark.createDataFrame([(9,)], "id int"))
    def flags(**kw):
        rows = hierarchy.in_collection(items, member, nodes, closure, **kw).collect()
        return {r["id"]: r["member"] for r in rows}
    assert flags(key="A") == {1: True, 2: None, 3: True, 9: None}
    assert flags(key="A", check_subcollections=False) == {1: None, 2: None, 3: None, 9: None}
    assert flags(key="B1", true_only=False) == {1: False, 2: False, 3: False, 9: False}
    assert flags(key="A1", true_only=False, check_subcollections=False)[1] is True


# --- relations --------------------------------------------------------------------------


def test_relations(spark):
    docs = spark.createDataFrame(
        [("a", "book"), ("b", "book"), ("c", "report"), ("n", "note")],
        "id string, item_type string")
    edges = spark.createDataFrame(
        [("a", "r", "b"), ("a", "r", "b"), ("b", "r", "c"), ("a", "r", "n"), ("c", "r", "doi"),
         ("a", "r", "gone")], "src string, rel string, ref string")
    alternate = spark.createDataFrame([("a", "doi")], "id string, alternate_id string")
    def pairs(df):
        return sorted((r["src"], r["id"]) for r in df.collect())
    forward = pairs(relations.related_forward(edges, docs))
    assert forward == [("a", "b"), ("b", "c")]
    assert ("c", "a") in pairs(relations.related_forward(edges, docs, alternate))
    reverse = pairs(relations.related_reverse(edges, docs))
    assert {(b, a) for a, b in reverse} == {*forward, ("a", "n")}
    both = set(pairs(relations.related_undirected(edges, docs)))
    assert {(b, a) for a, b in both if "n" not in (a, b)} == {p for p in both if "n" not in p}
    asked = spark.createDataFrame([("a",), ("doi",), ("none",)], "request string")
    found = {r["request"]: (r["id"], r["fellback"])
             for r in lookups.resolve_ids(asked, docs, alternate).collect()}
    assert found == {"a": ("a", False), "doi": ("a", True), "none": (None, False)}


# --- keywords against brute force -------------------------------------------------------

FIELDS = (IndexField("title", "text", 20.0, ("all", "title")),
          IndexField("note", "name", 2.0, ("all",), multi_part=True),
          IndexField("code", "id", 40.0, ("all", "code")))
WORDS = ["running", "runs", "Été", "cat", "cats", "of", "the"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    rows, n = [], 60
    for i in range(n):
        rows.append((i, "title", "", " ".join(rng.choices(WORDS, k=rng.randint(1, 6)))))
        for part in range(rng.randint(0, 3)):
            rows.append((i, "note", str(part), " ".join(rng.choices(WORDS, k=rng.randint(1, 8)))))
        rows.append((i, "code", "", rng.choice(["K1", "k1", "the", "Cat nap"])))
    texts = spark.createDataFrame(rows, "id int, field string, part string, text string")
    docs = spark.range(n).selectExpr("CAST(id AS INT) AS id")
    index = build_term_index(docs, texts, FIELDS, materialize=True)
    return rows, index, n


def test_materialized_postings_are_counted_once(corpus):
    """Postings, term counts and lengths are written side by side: none counts the parts anew."""
    _, index, _ = corpus
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()


ANALYZERS = {f.name: f.analyzer for f in FIELDS}


def analysed(field, text):
    if ANALYZERS[field] == "id":
        return [text]
    words = re.findall(r"\w+", text)
    return [fold_word(stem(w) if ANALYZERS[field] == "text" else w) for w in words]


def in_part(tokens, wanted, slop):
    reached = {i for i, t in enumerate(tokens) if t == wanted[0]}
    for word in wanted[1:]:
        reached = {j for j, t in enumerate(tokens) if t == word
                   and any(0 < j - i <= slop for i in reached)}
    return bool(reached)


def brute(rows, expr, doc):
    if isinstance(expr, (Word, Phrase)):
        slop = expr.slop if isinstance(expr, Phrase) else 0
        for i, field, _, text in rows:
            if i != doc or expr.scope not in next(f for f in FIELDS if f.name == field).scopes:
                continue
            wanted, tokens = analysed(field, expr.text), analysed(field, text)
            if slop and len(wanted) > 1:
                if in_part(tokens, wanted, slop):
                    return True
            elif len(wanted) == 1 and wanted[0] in tokens:
                return True
        return False
    if isinstance(expr, Boosted):
        return brute(rows, expr.part, doc)
    parts = [brute(rows, p, doc) for p in expr.parts]
    return {"AllOf": all, "AnyOf": any, "NoneOf": lambda p: not any(p)}[type(expr).__name__](parts)


@pytest.mark.parametrize("expr", [
    Word("run"), Word("cat", "title"), Word("ete"), Word("K1"), Word("Cat nap", "code"),
    all_of(Word("cats"), Word("of")), any_of(Word("K1"), Word("runs")), none_of(Word("the")),
    all_of(Word("cat"), none_of(Word("of"), Word("K1"))),
    any_of(all_of(Word("cat"), Word("of")), Boosted(none_of(Word("the")), 2)),
    Phrase("of the"), Phrase("the the"), Phrase("cat of", 2), Phrase("cats été the", 3, "title"),
    Phrase("the of the", 2), all_of(Phrase("of the"), none_of(Phrase("cat cat", 3))),
])
def test_keywords_match_brute_force(corpus, expr):
    rows, index, n = corpus
    found = ids(keywords.keyword_hits(index, expr, FIELDS))
    assert found == [d for d in range(n) if brute(rows, expr, d)]


def test_phrase_nesting(corpus):
    _, index, _ = corpus
    near = set(ids(keywords.keyword_hits(index, Phrase("cat the"), FIELDS)))
    wide = set(ids(keywords.keyword_hits(index, Phrase("cat the", 4), FIELDS)))
    both = set(ids(keywords.keyword_hits(index, all_of(Word("cat"), Word("the")), FIELDS)))
    assert near <= wide <= both


def test_words_of_one_entry_share_a_field(corpus):
    """Several tokens in one word must meet in one field."""
    rows, index, n = corpus
    found = ids(keywords.keyword_hits(index, Word("cat-of"), FIELDS))
    def together(d):
        for field in ("title", "note"):
            tokens = {t for i, f, _, x in rows if i == d and f == field for t in analysed(f, x)}
            if set(analysed(field, "cat of")) <= tokens:
                return True
        return False
    assert found == [d for d in range(n) if together(d)]


def test_unknown_scope(corpus):
    with pytest.raises(KeyError):
        keywords.keyword_hits(corpus[1], Word("x", "nowhere"), FIELDS)


def scores(df):
    return {r["id"]: r["score"] for r in df.collect()}


def test_scores(spark, corpus):
    _, index, n = corpus
    plain = scores(keywords.keyword_hits(index, Word("cat"), FIELDS))
    boosted = scores(keywords.keyword_hits(index, Boosted(Word("cat"), 3), FIELDS))
    assert boosted == pytest.approx({k: v * 3 for k, v in plain.items()})
    code = scores(keywords.keyword_hits(index, Word("K1", "code"), FIELDS))
    assert set(code.values()) == {40.0}
    restricted = scores(keywords.keyword_hits(index, all_of(Word("cat"), none_of(Word("of"))), FIELDS))
    assert all(restricted[d] == pytest.approx(plain[d]) for d in restricted)
    docs = spark.range(n).selectExpr("CAST(id AS INT) AS id", "id % 2 = 0 AS even",
                                     "'book' AS item_type")
    catalog = Catalog(fields=FIELDS, facets=(FacetSpec("even", "even", "even", "boolean"),))
    result = search(docs, index, catalog, Word("cat"), {"even": ["t"]})
    filtered = scores(result.matched)
    assert filtered == pytest.approx({k: v for k, v in plain.items() if k % 2 == 0})
    best = [r["id"] for r in result.page(1, 5).orderBy("position").collect()]
    assert best == sorted(filtered, key=lambda d: (-filtered[d], d))[:5]
    assert result.totals(5).first()["item_count"] == len(filtered)


def test_later_pages_read_their_documents_last(spark, corpus, tmp_path, monkeypatch):
    _, index, n = corpus
    path = str(tmp_path / "docs")
    spark.range(n).selectExpr("CAST(id AS INT) AS id", "-id % 3 AS third", "'book' AS item_type",
                              "repeat('x', 100) AS wide").write.parquet(path)
    docs, spec = spark.read.parquet(path), SortSpec("third", ("third",))
    catalog = Catalog(fields=FIELDS, facets=(), sorts=(spec,))
    for near in (sorting.NEAR_PLACES, 0):  # by the best rows of each task, then by a range sort
        monkeypatch.setattr(sorting, "NEAR_PLACES", near)
        result = search(docs, index, catalog, Word("cat"), sort=spec)
        order = sorted(scores(result.matched), key=lambda d: (-(d % 3), d))
        for number in (2, 3, 10 ** 9):
            last = min(number, -(-len(order) // 4))
            found = result.page(number, 4)
            rows = found.collect()
            assert [r["id"] for r in rows] == order[4 * last - 4:4 * last]
            assert [r["position"] for r in rows] == list(range(4 * last - 3, 4 * last - 3 + len(rows)))
            assert found.columns == [*result.matched.columns, "position"]
            assert "PushedFilters: [In(id" in found._jdf.queryExecution().executedPlan().toString() or (
                len(rows) == 1)
            # The search ran before: neither its terms nor its scores are in the plan.
            assert "tf" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert result.at(3, order[2]).select("id", "moved", "wide").collect() == [
            (order[2], False, "x" * 100)]
        assert result.at(1, -1).first()["moved"]
        assert result.at(10 ** 6).count() == 0
    nothing = search(docs, index, catalog, Word("absent"), sort=spec)
    assert nothing.page(2, 5).count() == 0


def test_one_exchange_for_any_expression(corpus, tmp_path, spark):
    """With stored tables a boolean query shuffles once, per document."""
    _, index, _ = corpus
    stored = []
    for name in TermIndex.names():
        getattr(index, name).write.parquet(str(tmp_path / name))
        stored.append(spark.read.parquet(str(tmp_path / name)))
    hits = keywords.keyword_hits(
        TermIndex(*stored), any_of(all_of(Word("cat"), Word("of")), Word("K1")), FIELDS)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "PushedFilters: [" in plan and "In(term" in plan


def test_catalog_changes():
    catalog = default_catalog()
    assert len(catalog.fields) == 9 + 91
    more = catalog.with_items(fields=[IndexField("extra_field")], sorts=[SortSpec("score", ("id",))])
    assert len(more.fields) == len(catalog.fields) + 1
    assert more.sort("score").columns == ("id",)
    assert len(more.without(facets=["tag"]).facets) == len(catalog.facets) - 1


def test_words_without_tokens(spark):
    """Nothing but marks: found nowhere, and its negation everywhere."""
    texts = spark.createDataFrame([(1, "body", "", "cat of nine"), (2, "body", "", "dog")],
                                  "id long, field string, part string, text string")
    fields = [IndexField("body", "name", 1.0, ("all",))]
    index = build_term_index(texts.select("id").distinct(), texts, fields)
    assert ids(keywords.keyword_hits(index, Word("!!!"), fields)) == []
    assert ids(keywords.keyword_hits(index, none_of(Word("!!!")), fields)) == [1, 2]
    assert ids(keywords.keyword_hits(index, any_of(Word("..."), Word("cat")), fields)) == [1]
    assert ids(keywords.keyword_hits(index, Phrase("?! --"), fields)) == []


def test_no_active_facet_when_empty(items):
    spec = FacetSpec("kind", "kind", "Kind")
    for chosen in ({}, {"kind": []}, {"other": ["x"]}):
        found = facets.facets_when_empty(items, [spec], chosen, records_only=False)
        assert found.collect() == []
        assert set(found.columns) == {"facet", "value", "label", "count", "active"}


def test_a_record_cited_by_a_third_of_all_others(spark):
    """Its list is whole and in order, and its links are dealt to many tasks."""
    n = 3000
    docs = spark.range(n).select(F.format_string("R%04d", "id").alias("id"),
                                 F.lit("book").alias("item_type"),
                                 F.format_string("t%04d", n - F.col("id")).alias("sort_title"))
    edges = spark.range(n).select(
        F.format_string("R%04d", "id").alias("src"), F.lit("cites").alias("rel"),
        F.when(F.col("id") % 3 == 0, "alias").otherwise(
            F.format_string("R%04d", F.col("id") % 900)).alias("ref"))
    other = spark.createDataFrame([("R0001", "alias"), ("gone", "alias")],
                                  "id string, alternate_id string")
    specs = default_catalog().relations
    title = SortSpec("title", ("sort_title",), False)
    found = relations.relations_of_records(edges, docs, other, specs, title)
    hot = sorted((r["place"], r["id"]) for r in found.filter(
        "src = 'R0001' AND relation = 'isCitedBy'").collect())
    citing = sorted({f"R{i:04d}" for i in range(n) if i % 3 == 0 or i % 900 == 1}, reverse=True)
    assert hot == list(enumerate(citing, 1))
    first = relations.relations_of_records(edges, docs, other, specs, title, limit=2)
    assert {r["place"] for r in first.collect()} == {1, 2}
    names = docs.select(F.lit("alias").alias("ref"), F.col("id").alias("to")).limit(1)
    spread = relations.join_salted(edges, names, ["ref"]).select(F.spark_partition_id().alias("p"))
    assert spread.count() == 1000
    heavy = relations.heavy_keys(edges, ["ref"]).collect()
    assert [r["ref"] for r in heavy] == ["alias"]


def test_relations_by_alternate_id_only_where_specified(spark):
    docs = spark.createDataFrame([("a", "book", "x"), ("b", "book", "y"), ("n", "note", "z")],
                                 "id string, item_type string, sort_title string")
    edges = spark.createDataFrame(
        [("a", "related", "B2"), ("a", "cites", "B2"), ("a", "related", "n"), ("n", "cites", "a"),
         ("a", "unknown", "b"), ("lost", "cites", "a")], "src string, rel string, ref string")
    other = spark.createDataFrame([("b", "B2")], "id string, alternate_id string")
    found = relations.relations_of_records(edges, docs, other, default_catalog().relations,
                                           SortSpec("title", ("sort_title",), False))
    assert sorted(tuple(r) for r in found.collect()) == [
        ("a", "cites", "b", 1), ("b", "isCitedBy", "a", 1), ("n", "cites", "a", 1),
        ("n", "related", "a", 1)]


def _moves(df):
    """Hash exchanges of the plan as it is before adaptive execution."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_links_move_once_for_each_end_and_once_by_list(spark):
    docs = spark.createDataFrame([(c, "book", c) for c in "abc"] + [("n", "note", "n")],
                                 "id string, item_type string, sort_title string")
    edges = spark.createDataFrame(
        [("a", "related", "b"), ("b", "related", "a"), ("c", "related", "c"),
         ("a", "related", "b"), ("n", "related", "c"), ("lost", "related", "a")],
        "src string, rel string, ref string")
    other = spark.createDataFrame([], "id string, alternate_id string")
    found = relations.relations_of_records(edges, docs, other, default_catalog().relations,
                                           SortSpec("title", ("sort_title",), False))
    assert _moves(found) <= 2
    assert sorted(tuple(r) for r in found.collect()) == [
        ("a", "related", "b", 1), ("b", "related", "a", 1), ("c", "related", "c", 1),
        ("n", "related", "c", 1)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = relations.related_undirected(edges, docs)
        assert _moves(both) <= 5
        assert sorted((r["src"], r["id"]) for r in both.collect()) == [
            ("a", "b"), ("b", "a"), ("c", "c"), ("lost", "a"), ("n", "c")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_words_are_grouped_within_their_text(spark):
    texts = spark.createDataFrame(
        [(1, "body", "", "b a b. \x1e a"), (1, "stem", "", "Hopping hops hop"), (2, "body", "", ""),
         (2, "stem", "", None), (3, "stem", "", "the")],
        "id long, field string, part string, text string")
    fields = [IndexField("body", "name", 1.0, ("all",)), IndexField("stem", "text", 1.0, ("all",))]
    index = build_term_index(texts.select("id").distinct(), texts, fields)
    plan = index.positions._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Sort" not in plan
    assert sorted((r["field"], r["term"], r["id"], r["positions"])
                  for r in index.positions.collect()) == [
        ("body", "\x1e", 1, [3]), ("body", "a", 1, [1, 4]), ("body", "b", 1, [0, 2]),
        ("stem", "hop", 1, [0, 1, 2]), ("stem", "the", 3, [0])]
    assert sorted(map(tuple, index.field_stats.select("field", "sum_len", "n_docs").collect())) == [
        ("body", 5, 3), ("stem", 4, 3)]
    assert sorted((r["term"], r["df"]) for r in index.term_stats.collect()) == [
        ("\x1e", 1), ("a", 1), ("b", 1), ("hop", 1), ("the", 1)]


def test_stems_of_frequent_and_other_words(spark):
    from facetlake.operators.index_tables import stemmed_rows

    words = ["hopping"] * 5 + ["hoping"] * 4 + ["knives"] * 2 + ["Relational", "x" * 80 + "ing", "hopes"]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, term string")
    wanted = [(i, fold_word(stem(w))) for i, w in enumerate(words)]
    for most in (100, 2):
        found = stemmed_rows(rows, most)
        assert found.columns == rows.columns
        assert sorted(map(tuple, found.collect())) == wanted
    assert stemmed_rows(rows.limit(0)).count() == 0
