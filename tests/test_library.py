"""Assembly, store, refresh and publishing over a small hand-made library."""

import json
from dataclasses import fields, replace
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from facetlake.functions.patterns import LIBRARY_HOST
from facetlake.functions.text import RECORD_SEPARATOR
from facetlake.operators.keywords import Phrase, Word, all_of
from facetlake.plans import publish, refresh
from facetlake.plans.assemble import Assembly, AssemblyOptions
from facetlake.plans.catalog import (
    DEFAULT_EXPORTS, DEFAULT_SORTS, IndexField, SortSpec, collection_facet, default_catalog,
)
from facetlake.plans.search import search
from facetlake.sources.library import SCHEMAS, Library, LibraryEmptyError, load_library
from facetlake.sources.store import (
    DocumentStore, bucket_of, IndexEmptyError, IndexMissingError, IndexSchemaError, write_table,
)

URI = f"http://{LIBRARY_HOST}/groups/5/items/"
OPTIONS = AssemblyOptions(as_of=date(2023, 2, 14), collection_roots=("ROOT",),
                          item_exclude="^private")


def item(key, version, kind, parent=None, trashed=None, parsed=None, relations=None, **data):
    tags = [{"tag": t} for t in data.pop("tags", [])]
    meta = {"parsedDate": parsed} if parsed else {}
    links = {"alternate": {"href": f"https://lib.example/{key}", "type": "text/html"}}
    body = {"itemType": kind, "tags": tags, "dateAdded": f"2022-01-{version:02d}T08:00:00Z",
            "dateModified": f"2022-02-{version:02d}T08:00:00Z", **data}
    return (key, version, kind, parent, json.dumps(meta), json.dumps(links), json.dumps(body),
            json.dumps(relations) if relations else None, trashed)


def author(first, last, kind="author"):
    return {"creatorType": kind, "firstName": first, "lastName": last}


ITEMS = [
    item("BOOK", 3, "book", parsed="2019-05", title="The <i>Élan</i> of Rivers",
         creators=[author("Ana", "Ruiz"), author("Ed", "Itor", "editor")], tags=["Water", "_hid"],
         collections=["LEAF", "ROOT"], ISBN="978-1", language="en; fre", date="2019-05",
         publisher="Press & Co", pages="11–55", url="https://x.example/1",
         relations={"dc:relation": [URI + "ARTI", "http://elsewhere.example/items/Q"],
                    "dc:replaces": URI + "OLDB"}),
    item("ARTI", 4, "journalArticle", parsed="2011-06-07", title="Rivers again",
         creators=[author("Bo", "Lee")], tags=["Water", "Faceted search"], collections=["LEAF2"],
         DOI="10.1/arti", publicationTitle="J of Water", volume="28", issue="4", pages="5-7",
         date="2011-06-07", extra="ISSN: 0741-9058\nKind: x", abstractNote="On rivers & seas",
         relations={"dc:relation": URI + "BOOK"}),
    item("CASE", 5, "case", caseName="Doe v. Roe", title="wrong field", collections=[]),
    item("PRIV", 6, "book", title="Secret", tags=["private thing"], collections=["LEAF"]),
    item("GONE", 7, "book", title="Trash", trashed=True),
    item("NOTE1", 2, "note", "BOOK", note=f"<p>cites {URI}CASE</p>", tags=["_cites"]),
    item("NOTE2", 2, "note", "BOOK", note="<p>Plain &amp; visible</p>"),
    item("NOTE3", 2, "note", "BOOK", note="<p>in the bin</p>", trashed=True),
    item("PDF1", 2, "attachment", "ARTI", linkMode="imported_file"),
    item("PDF2", 2, "attachment", "ARTI", linkMode="imported_file", tags=["_skip"]),
    item("HTML", 2, "attachment", "ARTI", linkMode="imported_url"),
    item("LINK", 2, "attachment", "ARTI", linkMode="linked_url", url="https://l.example/a"),
    item("LONE", 8, "note", note="<p>a note on its own</p>"),
]
COLLECTIONS = [
    ("ROOT", 1, "Root", None, None), ("LEAF", 1, " Leaf one ", "ROOT", None),
    ("LEAF2", 1, "Leaf two", "LEAF", None), ("DEAD", 1, "Dead", "ROOT", True),
]


def frame(spark, name, rows):
    return spark.createDataFrame(rows, SCHEMAS[name])


def small_library(spark, items=ITEMS, collections=COLLECTIONS, deleted=(), deleted_collections=(),
                  history=((1, 0, 10),)):
    kinds = {"book": ["title", "ISBN"], "journalArticle": ["title", "DOI", "date"],
             "case": ["caseName"]}
    type_fields = [(k, f, n) for k, fs in kinds.items() for n, f in enumerate(fs)]
    creators = [("book", "author", 0), ("book", "editor", 1), ("journalArticle", "author", 0)]
    keys = [i[0] for i in items if i[3] is None]
    files = [("PDF1", "application/pdf", "", "a.pdf", None, None, "ok"),
             ("PDF2", "application/pdf", "", "b.pdf", None, None, "ok"),
             ("HTML", "text/html", "utf-8", "c.html", None, None, "ok")]
    texts = [(k, f"<b>Deep text</b> of {k}", None, None, None, None) for k in ("PDF1", "HTML")]
    present = {i[0] for i in items}
    rows = {
        "collection": [(k, v, n, p, "{}", "{}", "{}", t) for k, v, n, p, t in collections],
        "item_type": [(k,) for k in kinds],
        "item_type_locale": [("book", "en-US", "Book"), ("journalArticle", "en-US", "Article")],
        "item_type_field": type_fields,
        "item_type_field_locale": [(k, f, "en-US", f.title()) for k, f, _ in type_fields],
        "item_type_creator_type": creators,
        "item_type_creator_type_locale": [(k, c, "en-US", c.title()) for k, c, _ in creators],
        "item": list(items),
        "deleted_collection": [(k,) for k in deleted_collections],
        "deleted_item": [(k,) for k in deleted],
        "sync_history": [(n, "5", "groups", since, to, datetime(2022, 3, n), datetime(2022, 3, n, 1))
                         for n, since, to in history],
        "item_collection": [(i[0], c) for i in items for c in json.loads(i[6]).get("collections", [])],
        "item_tag": [(i[0], t["tag"]) for i in items for t in json.loads(i[6])["tags"]],
        "item_bib": [(k, "apa", "en-US", f"<div>{k}</div>") for k in keys]
                    + [(k, "mla", "en-US", "other") for k in keys],
        "item_export_format": [(k, f, f"{f}:{k}\n") for k in keys for f in ("ris", "bibtex", "coins")],
        "item_file": [f for f in files if f[0] in present],
        "item_fulltext": [t for t in texts if t[0] in present],
    }
    return Library(**{f.name: frame(spark, f.name, rows[f.name]) for f in fields(Library)})


@pytest.fixture(scope="module")
def made(spark):
    return {n: df.cache() for n, df in Assembly(small_library(spark), OPTIONS).tables().items()}


@pytest.fixture(scope="module")
def docs(made):
    return {r["id"]: r for r in made["docs"].collect()}


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_documents(docs):
    assert set(docs) == {"BOOK", "ARTI", "CASE", "LONE"}
    book, arti, case = docs["BOOK"], docs["ARTI"], docs["CASE"]
    assert book["alternate_id"] == ["978-1", "OLDB"]
    assert arti["alternate_id"] == ["10.1/arti", "0741-9058"]
    assert case["alternate_id"] is None
    assert (book["item_type_label"], case["item_type_label"]) == ("Book", None)
    assert case["facet_item_type"] == ("case", "case")
    assert (book["year"], case["year"]) == ("2019", None)
    assert case["title"] == "Doe v. Roe" and case["sort_title"] == "doe v roe"
    assert book["sort_title"] == "the elan of rivers"
    assert book["sort_creator"] == "ruiz zzz ana"
    assert (book["sort_date"], case["sort_date"]) == (20190500, 0)
    assert book["filter_date"] == datetime(2019, 5, 31)
    assert case["filter_date"] == datetime(2022, 1, 5, 8)
    assert book["facet_tag"] == ["Water"] and case["facet_tag"] is None
    assert [tuple(v) for v in book["facet_language"]] == [("eng", "English"), ("fra", "French")]
    assert [(".".join(v["path"]), v["label"]) for v in book["facet_collection_ROOT"]] == [
        ("LEAF", "Leaf one")]
    assert [(".".join(v["path"]), v["label"]) for v in arti["facet_collection_ROOT"]] == [
        ("LEAF", "Leaf one"), ("LEAF.LEAF2", "Leaf two")]
    assert book["facet_link"] and not arti["facet_link"]
    assert book["rel_related"] == ["ARTI"] and case["rel_related"] == []
    assert book["bib"] == "<div>BOOK</div>" and book["ris"] == "ris:BOOK\n"
    assert [f["localized"] for f in book["item_fields"]] == ["Title", "Isbn"]
    assert [t["creator_type"] for t in book["creator_types"]] == ["author", "editor"]
    assert book["app_url"].endswith("://select/groups/5/items/BOOK")
    assert book["web_url"] == "https://lib.example/BOOK"


def test_child_tables(made):
    # Exclusion by tag hides the citing note from readers, not from the citation edges.
    assert rows(made["notes"], "id", "child_key") == [("BOOK", "NOTE2")]
    assert rows(made["links"], "id", "title", "url") == [
        ("ARTI", "https://l.example/a", "https://l.example/a")]
    assert rows(made["attachments"], "id", "child_key") == [("ARTI", "PDF1")]
    assert rows(made["edges"], "src", "rel", "ref") == [
        ("ARTI", "related", "BOOK"), ("BOOK", "cites", "CASE"), ("BOOK", "related", "ARTI")]
    deps = rows(made["deps"], "id", "kind", "dep")
    assert [d for d in deps if d[0] == "BOOK"] == [
        ("BOOK", "collection", "LEAF"), ("BOOK", "collection", "ROOT"), ("BOOK", "item", "BOOK"),
        ("BOOK", "item", "NOTE1"), ("BOOK", "item", "NOTE2"), ("BOOK", "item", "NOTE3")]


def test_texts(made):
    texts = {(r["id"], r["field"], r["part"]): r["text"] for r in made["texts"].collect()}
    assert texts["BOOK", "z_title", ""] == "The Élan of Rivers"
    assert texts["BOOK", "text_notes", "NOTE2"] == "Plain & visible"
    assert texts["ARTI", "text_docs", "PDF1"] == "Deep text of PDF1"
    assert texts["ARTI", "text_tags", ""] == f"Faceted search{RECORD_SEPARATOR}Water"
    assert texts["BOOK", "text_collections", ""] == f"Leaf one{RECORD_SEPARATOR}Root"
    assert ("ARTI", "text_docs", "HTML") not in texts
    assert ("BOOK", "z_pages", "") not in texts
    assert texts["BOOK", "alternate_id", "1"] == "OLDB"


def test_citation_tags(made):
    tags = publish.citation_tags(made["docs"], made["attachments"]).orderBy("id", "seq").collect()
    arti = [(r["name"].removeprefix("citation_"), r["value"]) for r in tags if r["id"] == "ARTI"]
    assert arti == [
        ("title", "Rivers again"), ("publication_date", "2011-06-07"), ("date", "2011-06-07"),
        ("year", "2011"), ("author", "Lee, Bo"), ("volume", "28"), ("issue", "4"),
        ("firstpage", "5"), ("lastpage", "7"), ("journal_title", "J of Water"),
        ("issn", "0741-9058"), ("doi", "10.1/arti"), ("pdf_url", "ARTI/download/PDF1/a.pdf")]
    book = {r["name"]: r["value"] for r in tags if r["id"] == "BOOK"}
    assert book["citation_author"] == "Ruiz, Ana" and "citation_doi" not in book
    assert book["citation_firstpage"] == "11–55" and "citation_lastpage" not in book
    assert not [r for r in tags if r["id"] == "CASE"]


def test_feed_and_display(made):
    feed = {r["id"]: r for r in publish.feed_entries(made["docs"]).collect()}
    assert feed["BOOK"]["title"] == "The <i>Élan</i> of Rivers"
    assert feed["BOOK"]["publisher"] == "Press & Co"
    assert feed["BOOK"]["creators"] == ["Ruiz, Ana", "Itor, Ed"]
    assert feed["ARTI"]["doi_url"] == "https://doi.org/10.1/arti"
    assert feed["CASE"]["date"] is None
    shown = rows(publish.display_fields(made["docs"]), "id", "seq", "label", "value")
    assert [s[2:] for s in shown if s[0] == "ARTI"] == [
        ("Title", "Rivers again"), ("Doi", "https://doi.org/10.1/arti"), ("Date", "2011-06-07")]


def test_exports(made, spark, tmp_path):
    author_asc = next(s for s in DEFAULT_SORTS if s.key == "author_asc")
    ris = DEFAULT_EXPORTS[0]
    matched = publish.records_of(made["docs"])
    records = [r["record"] for r in publish.export_records(matched, ris, author_asc).collect()]
    assert records == ["ris:CASE\n", "ris:ARTI\n", "ris:BOOK\n"]
    publish.write_export(matched, ris, author_asc, str(tmp_path / "out"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert written == "".join(records)
    page = spark.createDataFrame([(2, "b"), (1, "a")], "position int, record string")
    grouped = replace(ris, delimiter=",", group_format="[{}]")
    assert publish.export_text(page, grouped).first()["text"] == "[a,b]"
    assert publish.export_allowed(5, replace(ris, max_records=5))
    assert not publish.export_allowed(6, replace(ris, max_records=5))


@pytest.mark.parametrize("delimiter, group, wanted", [
    ("", "{}", "ris:CASE\nris:ARTI\nris:BOOK\n"),
    ("", "<{}>", "<ris:CASE\nris:ARTI\nris:BOOK\n>"),
    (",\n", "[\n{}]\n", "[\nris:CASE\n,\nris:ARTI\n,\nris:BOOK\n]\n"),
])
def test_grouped_exports_laid_end_to_end(made, tmp_path, delimiter, group, wanted):
    author_asc = next(s for s in DEFAULT_SORTS if s.key == "author_asc")
    spec = replace(DEFAULT_EXPORTS[0], delimiter=delimiter, group_format=group)
    for matched, expected in ((publish.records_of(made["docs"]), wanted),
                              (made["docs"].limit(0), group.replace("{}", ""))):
        path = tmp_path / ("all" if expected == wanted else "none")
        publish.write_export_group(matched, spec, author_asc, str(path))
        files = [f for part in publish.EXPORT_PARTS for f in sorted((path / part).glob("part-*"))]
        assert "".join(f.read_text() for f in files) == expected


def test_records_that_end_no_line_need_a_delimiter(made, tmp_path):
    author_asc = next(s for s in DEFAULT_SORTS if s.key == "author_asc")
    spec = replace(DEFAULT_EXPORTS[0], column="bib")
    with pytest.raises(ValueError, match="line feed"):
        publish.write_export_group(made["docs"], spec, author_asc, str(tmp_path / "x"))


def test_an_export_computes_only_what_it_writes(spark, tmp_path):
    docs = spark.range(3).select(
        F.col("id").cast("string").alias("id"), (-F.col("id")).alias("key"),
        F.concat(F.lit("r"), F.col("id")).alias("ris"),
        F.raise_error(F.lit("not asked for")).cast("string").alias("costly"))
    spec = replace(DEFAULT_EXPORTS[0], delimiter=",", group_format="[{}]")
    publish.write_export_group(docs, spec, SortSpec("k", ("key",), False), str(tmp_path / "x"))
    files = [f for part in publish.EXPORT_PARTS
             for f in sorted((tmp_path / "x" / part).glob("part-*"))]
    assert "".join(f.read_text() for f in files) == "[r2,r1,r0]"


def test_tables_written_together_decode_the_items_once(spark, made):
    """A refresh writes every table: what they share is laid down, and the rows are the same."""
    written = Assembly(small_library(spark), OPTIONS, materialize=True).tables()
    for name, df in written.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json(StructField(creators" not in plan, name
        assert df.columns == made[name].columns
        assert sorted(map(repr, df.collect())) == sorted(map(repr, made[name].collect())), name


def test_custom_columns_and_fields(spark):
    """X-1, X-2: a field and a column of one's own."""
    options = replace(OPTIONS, extra_columns={"loud": F.upper("item_type")})
    catalog = default_catalog().with_items(fields=[IndexField("z_pages", "id", 1.0, ("all",))])
    made = Assembly(small_library(spark), options, catalog)
    assert {r["loud"] for r in made.docs.collect()} == {"BOOK", "JOURNALARTICLE", "CASE", "NOTE"}
    assert rows(made.texts.filter("field = 'z_pages'"), "id", "text") == [
        ("ARTI", "5-7"), ("BOOK", "11–55")]


# --- store and refresh ------------------------------------------------------------------


def test_store_errors(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "s"))
    with pytest.raises(IndexMissingError):
        store.open()
    store.publish({"docs": spark.createDataFrame([], "id string")})
    with pytest.raises(IndexEmptyError):
        store.open()
    store.publish({"docs": spark.createDataFrame([("a",)], "id string")})
    with pytest.raises(IndexSchemaError):
        store.open(["id", "nope"])
    assert store.open(["id"]).count() == store.count() == 1
    with pytest.raises(LibraryEmptyError):
        refresh.refresh(small_library(spark, history=()), store)


def test_words_are_written_where_they_are(spark, tmp_path):
    """No row per word moves: as many files as tasks, each sorted by word."""
    postings = spark.range(30).repartition(3, "id").selectExpr(
        "'text' AS field", "explode(array('b', 'a', concat('w', id))) AS term",
        "cast(id AS string) AS id", "1L AS tf", "3L AS len")
    write_table(postings, "postings", str(tmp_path / "p"))
    files = sorted((tmp_path / "p" / "field=text").glob("part-*.parquet"))
    assert len(files) == 3
    for file in files:
        terms = [r["term"] for r in spark.read.parquet(str(file)).collect()]
        assert terms == sorted(terms)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 90


def test_load_library(spark, tmp_path):
    library = small_library(spark)
    for f in fields(Library):
        getattr(library, f.name).write.parquet(str(tmp_path / f.name))
    loaded = load_library(spark, str(tmp_path))
    assert loaded.item.count() == len(ITEMS)
    assert loaded.sync_history.columns[0] == "history_id"


def changed_library(spark):
    """A later state: new, changed, deleted, trashed items, a new child, a renamed collection."""
    by_key = {i[0]: i for i in ITEMS}
    by_key["CASE"] = item("CASE", 12, "case", caseName="Roe v. Doe", collections=[])
    by_key["NEW"] = item("NEW", 12, "book", title="Fresh rivers", collections=["LEAF2"])
    by_key["NOTE9"] = item("NOTE9", 12, "note", "CASE", note="<p>late remark</p>")
    by_key["LONE"] = item("LONE", 13, "note", note="<p>x</p>", trashed=True)
    del by_key["ARTI"]
    for child in ("PDF1", "PDF2", "HTML", "LINK"):
        del by_key[child]
    collections = [("ROOT", 1, "Root", None, None), ("LEAF", 14, "Leaf renamed", "ROOT", None),
                   *COLLECTIONS[2:]]
    return small_library(spark, list(by_key.values()), collections, deleted=["ARTI", "NEVER"],
                         history=((1, 0, 10), (2, 10, 14)))


def contents(store, name):
    df = store.read(name)
    return sorted(repr(sorted(r.asDict(recursive=True).items())) for r in df.collect())


def test_incremental_equals_full(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "inc"))
    assert refresh.refresh(small_library(spark), store, OPTIONS, n_buckets=8) == "full"
    assert refresh.refresh(small_library(spark), store, OPTIONS, n_buckets=8) == "none"
    later = changed_library(spark)
    before = store.latest()["tables"]
    assert refresh.refresh(later, store, OPTIONS, n_buckets=8) == "incremental"
    assert store.latest()["library_version"] == 14
    # Only buckets of changed documents lie elsewhere than before.
    changed = {r["b"] for r in spark.createDataFrame(
        [("BOOK",), ("ARTI",), ("CASE",), ("NEW",), ("LONE",)], "id string").select(
        bucket_of(F.col("id"), 8).alias("b")).collect()}
    for name, table in store.latest()["tables"].items():
        moved = set(table["buckets"]) - set(before[name]["buckets"])
        assert {int(f.rsplit("=", 1)[1]) for f in moved} <= changed, name
    rebuilt = DocumentStore(spark, str(tmp_path / "full"))
    assert refresh.refresh(later, rebuilt, OPTIONS, force=True, n_buckets=8) == "full"
    assert {r["id"] for r in store.read("docs").collect()} == {"BOOK", "CASE", "NEW"}
    for name in (*refresh.KEYED, *refresh.COUNTED):
        assert contents(store, name) == contents(rebuilt, name), name

    catalog = default_catalog().with_items(facets=[collection_facet("ROOT", "place")])
    docs, index = store.open(), refresh.open_index(store)
    def found(keywords, **filters):
        return rows(search(docs, index, catalog, keywords, filters).matched, "id")
    assert found(Word("river")) == [("BOOK",), ("NEW",)]
    assert found(Word("river"), place=["LEAF.LEAF2"]) == [("NEW",)]
    assert found(all_of(Word("river", "title"), Word("ruiz", "creator"))) == [("BOOK",)]
    assert found(Phrase("late remark")) == [("CASE",)]
    assert found(Word("978-1")) == [("BOOK",)]
    facets = search(docs, index, catalog, None, {"topic": ["Water"]}).facets()
    assert rows(facets.filter("facet = 'tag'"), "value", "count", "active") == [("Water", 1, True)]


def many_books(spark, n, changed=(), version=5, history=((1, 0, 10),)):
    rows = [item(f"B{i}", version if i in changed else 1, "book",
                 title=f"{'New' if i in changed else 'Old'} river {i}") for i in range(n)]
    return small_library(spark, rows, COLLECTIONS, history=history)


def test_bytes_written_grow_with_the_change(spark, tmp_path):
    """One changed document of 400 writes a small part, forty a larger one, none nothing."""
    store = DocumentStore(spark, str(tmp_path / "s"))
    refresh.refresh(many_books(spark, 400), store, OPTIONS)

    def written():
        folder = Path(store.latest()["folder"])
        return sum(f.stat().st_size for f in folder.rglob("*.parquet"))

    sizes = [written()]
    for step, changed in enumerate([[7], range(40), []], 2):
        history = tuple((k, 0 if k == 1 else k, 10 * k) for k in range(1, step + 1))
        later = many_books(spark, 400, set(changed), 10 * step - 5, history)
        assert refresh.refresh(later, store, OPTIONS) == "incremental"
        sizes.append(written())
    full, one, forty, none = sizes
    assert none == 0 < 10 * one < full and 2 * one < forty < full
    titles = {r["id"]: r["title"] for r in store.read("docs").collect()}
    assert len(titles) == 400 and titles["B7"] == "New river 7" and titles["B8"] == "New river 8"
    assert titles["B300"] == "Old river 300"


@pytest.mark.parametrize("version, synced, force, mode", [
    (None, None, False, "full"), (14, datetime(2022, 3, 2, 1), True, "full"),
    (14, datetime(2022, 3, 2, 1), False, "none"), (10, datetime(2022, 3, 1), False, "incremental"),
])
def test_refresh_mode(spark, version, synced, force, mode):
    state = spark.createDataFrame([(10, 14, datetime(2022, 3, 2, 1))],
                                  "since_version int, to_version int, ended_on timestamp")
    assert refresh.refresh_mode(state, version, synced, force).first()["mode"] == mode
    restarted = state.withColumn("since_version", F.lit(0))
    assert refresh.refresh_mode(restarted, 14, datetime(2021, 1, 1)).first()["mode"] == "full"


def test_manifest(spark, made):
    keys = spark.createDataFrame([("ARTI",), ("BOOK",)], "id string")
    found = refresh.attachment_manifest(made["docs"], made["attachments"], keys)
    assert rows(found, "file_id") == [("PDF1",)]
    def files(*names):
        return spark.createDataFrame([(n,) for n in names], "file_id string")
    diff = refresh.manifest_diff(files("a", "b"), files("b", "c", "d"), files("b", "d"))
    assert rows(diff, "action", "file_id") == [("add", "c"), ("remove", "a")]
    full = refresh.manifest_diff(files("a"), files("b"), files("a", "b"), full=True)
    assert rows(full, "action", "file_id") == [("add", "b"), ("remove", "a"), ("remove", "b")]


def test_tags_and_collections_come_from_their_tables(spark):
    from dataclasses import replace

    library = small_library(spark)
    tags = spark.createDataFrame([("BOOK", " Ocean\t"), ("BOOK", "Ocean"), ("BOOK", "Reef")],
                                 "item_key string, tag string")
    members = spark.createDataFrame([("BOOK", "ROOT"), ("BOOK", "ROOT")],
                                    "item_key string, collection_key string")
    made = Assembly(replace(library, item_tag=tags, item_collection=members))
    book = made.docs.filter("id = 'BOOK'").first()
    assert book["facet_tag"] == ["Ocean", "Reef"]
    deps = {(r["kind"], r["dep"]) for r in made.deps.filter("id = 'BOOK'").collect()}
    assert ("collection", "ROOT") in deps and ("collection", "LEAF") not in deps
