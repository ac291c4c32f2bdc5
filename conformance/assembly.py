"""Assembly of documents, relations, look-ups and maintenance."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from conformance.derived_library import (
    FIRST_STATE, LAST_STATE, RECORDS_SQL, TYPES, URI, derived_library, library_states,
)
from conformance.inputs import (
    GEOGRAPHY_SQL, documents, geography, sql_tokens, sql_words, table,
)
from conformance.registry import case
from facetlake.functions import names
from facetlake.functions.patterns import APP_SCHEME
from facetlake.functions.values import labelled
from facetlake.operators import children, dimensions, facets, hierarchy, lookups, relations
from facetlake.plans import assemble as plan
from facetlake.plans import refresh
from facetlake.plans.catalog import FacetSpec
from facetlake.session import lay_down
from facetlake.sources import store
from facetlake.sources.library import decode_json, library_state

AS_OF = date(1998, 6, 15)
OPTIONS = plan.AssemblyOptions(as_of=AS_OF)


def _tables(spark, d):
    return plan.Assembly(derived_library(spark, d), OPTIONS)


def _docs(spark, d):
    return _tables(spark, d).docs


# --- sources ----------------------------------------------------------------------------


@case("load_library", f"""
    SELECT 'O' || o_orderkey AS item_key, {TYPES} AS item_type, CAST(o_orderkey AS INTEGER) AS version,
           CAST(NULL AS VARCHAR) AS parent_item, o_totalprice < 20000 AS trashed,
           CASE WHEN o_totalprice > 100000 THEN 3 ELSE 2 END::BIGINT AS n_tags
    FROM orders
    UNION ALL
    SELECT 'L' || l_orderkey || 'x' || l_linenumber || 'x' || l_partkey || 'x' || l_suppkey,
           CASE l_returnflag WHEN 'N' THEN 'note' ELSE 'attachment' END,
           CAST(l_orderkey AS INTEGER), 'O' || l_orderkey, l_quantity >= 45, 0
    FROM lineitem
""")
def load_library(spark, d):
    """All tables of the derived library written to a folder, then loaded with their schemas."""
    from dataclasses import fields

    from facetlake.sources.library import SCHEMAS, load_library as load

    made, root = derived_library(spark, d), _store(spark, "library").root
    for f in fields(made):
        rows = getattr(made, f.name)
        names = [c.strip().split(" ")[0] for c in SCHEMAS[f.name].split(",")]
        rows.select(*names).write.parquet(f"{root}/{f.name}")
    loaded = load(spark, root)
    tags = loaded.item_tag.groupBy("item_key").agg(F.count("tag").alias("n_tags"))
    return loaded.item.join(tags, "item_key", "left").select(
        "item_key", "item_type", "version", "parent_item",
        F.coalesce("trashed", F.lit(False)).alias("trashed"),
        F.coalesce("n_tags", F.lit(0)).cast("bigint").alias("n_tags"))


@case("library_state", """
    SELECT 0 AS since_version, CAST(user_id AS INTEGER) AS to_version,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS ended_on
    FROM events ORDER BY event_id DESC LIMIT 1
""")
def state_of_library(spark, d):
    return library_state(derived_library(spark, d).sync_history).select(
        "since_version", "to_version",
        F.date_format("ended_on", "yyyy-MM-dd HH:mm:ss").alias("ended_on"))


@case("refresh_mode", """
    SELECT event_id, CASE WHEN event_type = 'signup' THEN 'full'
      WHEN user_id = event_id THEN 'none' ELSE 'incremental' END AS mode
    FROM events
""")
def mode_of_refresh(spark, d):
    """Every event taken as a state: sign-ups were never refreshed before."""
    states = table(spark, d, "events").select(
        "event_id", "event_type", F.lit(5).alias("since_version"),
        F.col("user_id").cast("int").alias("to_version"), F.col("ts").alias("ended_on"))
    seen = F.when(F.col("event_type") != "signup", F.col("event_id"))
    state = states.withColumn("seen", seen)
    mode = refresh.refresh_mode(
        state.select("event_id", "since_version", "to_version", "ended_on", "seen"),
        F.col("seen"), F.col("ended_on"), keep=("event_id",))
    return mode.select("event_id", "mode")


@case("freshness", """
    SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "when",
           round((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(arg_max(ts, event_id))) / 3600000000.0, 3)
             AS hours_ago
    FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 1)
""")
def freshness(spark, d):
    from facetlake.plans.publish import freshness as fresh

    state = library_state(derived_library(spark, d).sync_history)
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    return fresh(state, now).select(
        F.date_format("when", "yyyy-MM-dd HH:mm:ss").alias("when"), "hours_ago")


# --- rows that become documents ---------------------------------------------------------


@case("top_level_items", "SELECT 'O' || o_orderkey AS item_key FROM orders WHERE o_totalprice >= 20000")
def top_level_items(spark, d):
    return plan.top_level_items(derived_library(spark, d).item).select("item_key")


@case("reject_reasons", """
    SELECT 'O' || o_orderkey AS item_key, CASE WHEN o_totalprice < 20000 THEN 'trashed'
      WHEN o_totalprice > 100000 THEN 'excluded by tag' ELSE 'indexed' END AS status FROM orders
    UNION ALL SELECT 'L' || l_orderkey || 'x' || l_linenumber || 'x' || l_partkey || 'x' || l_suppkey,
      CASE WHEN l_quantity >= 45 THEN 'trashed' ELSE 'not top-level' END FROM lineitem
""")
def reject_reasons(spark, d):
    items = decode_json(derived_library(spark, d).item)
    return plan.reject_reasons(items, "", "_large").select("item_key", "status")


@case("children_of_type", """
    SELECT 'L' || l_orderkey || 'x' || l_linenumber || 'x' || l_partkey || 'x' || l_suppkey AS item_key
    FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity < 45
""")
def children_of_type(spark, d):
    items = decode_json(derived_library(spark, d).item)
    return children.children_of_type(items, "note", "", "^_").select("item_key")


@case("children_by_parent", """
    SELECT p.conv_id, p.text AS opening, c.chunk, c.children FROM conversations p
    LEFT JOIN (SELECT conv_id, turn // 3 AS chunk,
                      string_agg(role || ':' || turn, '|' ORDER BY turn) AS children
               FROM conversations WHERE turn > 0 GROUP BY ALL) c USING (conv_id)
    WHERE p.turn = 0
""")
def children_by_parent(spark, d):
    """Later turns gathered below the first, in chunks of three."""
    turns = table(spark, d, "conversations")
    parents = turns.filter("turn = 0").select("conv_id", F.col("text").alias("opening"))
    later = turns.filter("turn > 0")
    value = F.concat_ws(":", "role", "turn")
    return children.children_by_parent(parents, later, "conv_id", "turn", value, 3).select(
        "conv_id", "opening", "chunk", F.array_join("children", "|").alias("children"))


@case("concat_texts", """
    SELECT conv_id, turn // 1000 AS chunk, string_agg(text, chr(30) ORDER BY turn) AS text
    FROM conversations GROUP BY ALL
""")
def concat_texts(spark, d):
    return children.concat_texts(
        table(spark, d, "conversations"), "conv_id", "turn", F.col("text"))


# --- joins ------------------------------------------------------------------------------


@case("with_tags", """
    SELECT doc_id AS id, lang, array_to_string(tags, '|') AS tags FROM documents LEFT JOIN (
      SELECT doc_id, list_sort(list(DISTINCT tag)) AS tags FROM (
        SELECT doc_id, 'quality' AS tag FROM labels WHERE quality = 1
        UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1) GROUP BY doc_id) USING (doc_id)
""")
def with_tags(spark, d):
    tagged = documents(spark, d).select("id", F.explode("tags").alias("tag"))
    items = documents(spark, d).select("id", "lang")
    return dimensions.tags_of_items(tagged, items).select(
        "id", "lang", F.array_join("tags", "|").alias("tags"))


@case("with_collections", """
    SELECT c_custkey AS id, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE n_regionkey <> 3
""")
def with_collections(spark, d):
    membership = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("key"))
    nodes = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"),
        (F.col("n_regionkey") == 3).alias("trashed"))
    return dimensions.collection_names(membership, nodes)


@case("with_reference_text", """
    SELECT 'O' || o_orderkey AS item_key, '<div>Order ' || o_orderkey || '</div>' AS bib FROM orders
""")
def with_reference_text(spark, d):
    return dimensions.reference_text(derived_library(spark, d).item_bib, "apa", "en-US")


@case("with_export_formats", """
    SELECT conv_id AS item_key, max(CASE WHEN role = 'user' THEN text END) AS "user",
           max(CASE WHEN role = 'system' THEN text END) AS "system"
    FROM conversations WHERE turn = 0 GROUP BY conv_id
""")
def with_export_formats(spark, d):
    """Opening turns as stored texts by role."""
    stored = table(spark, d, "conversations").filter("turn = 0").select(
        F.col("conv_id").alias("item_key"), F.col("role").alias("format"),
        F.col("text").alias("content"))
    return dimensions.export_formats(stored, ["user", "system"])


@case("with_files_fulltext", """
    SELECT doc_id AS item_key, source AS parent_item, url AS filename, text AS content
    FROM documents LEFT JOIN pages ON doc_id = page_id
""")
def with_files_fulltext(spark, d):
    docs = table(spark, d, "documents")
    attachments = docs.select(F.col("doc_id").alias("item_key"),
                              F.col("source").alias("parent_item"))
    files = table(spark, d, "pages").select(F.col("page_id").alias("item_key"),
                                            F.col("url").alias("filename"))
    texts = docs.select(F.col("doc_id").alias("item_key"), F.col("text").alias("content"))
    return children.with_files_fulltext(attachments, files, texts)


@case("child_fulltext", f"""
    WITH {RECORDS_SQL}
    SELECT id, child_key, 'Full text of part ' || l_partkey AS text FROM kids
    WHERE l_returnflag = 'A' AND l_linestatus = 'F'
""")
def child_fulltext(spark, d):
    library = derived_library(spark, d)
    attachments = children.children_of_type(decode_json(_kept_items(library)), "attachment")
    return children.child_fulltext(
        attachments, library.item_file, library.item_fulltext, ["application/pdf"])


def _kept_items(library):
    """Children whose record is kept."""
    ids = plan.top_level_items(library.item).select(F.col("item_key").alias("parent_item"))
    return library.item.join(ids, "parent_item", "left_semi")


@case("child_files", f"""
    WITH {RECORDS_SQL}
    SELECT id, child_key, 'part' || l_partkey || '.pdf' AS filename, 'ok' AS download_status
    FROM kids WHERE l_returnflag = 'A' AND l_linestatus = 'F'
""")
def child_files(spark, d):
    return _tables(spark, d).attachments.select(
        "id", "child_key", F.col("data.filename").alias("filename"), "download_status")


@case("child_links", f"""
    WITH {RECORDS_SQL}
    SELECT id, child_key, CASE l_linestatus WHEN 'F' THEN 'Part ' || l_partkey
      ELSE 'https://parts.example.org/' || l_partkey END AS title,
      'https://parts.example.org/' || l_partkey AS url
    FROM kids WHERE l_returnflag = 'R'
""")
def child_links(spark, d):
    return _tables(spark, d).links


@case("child_notes", f"""
    WITH {RECORDS_SQL}
    SELECT id, child_key, 'Line ' || l_linenumber || ' ships & cites itsee {URI}O'
      || (l_suppkey + 1) AS text
    FROM kids WHERE l_returnflag = 'N'
""")
def child_notes(spark, d):
    notes = children.children_of_type(decode_json(_kept_items(derived_library(spark, d))), "note")
    return children.child_notes(notes).select("id", "child_key", "text")


@case("cited_in_notes", f"""
    WITH {RECORDS_SQL}
    SELECT DISTINCT id AS src, 'O' || (l_suppkey + i) AS ref FROM kids, (VALUES (0), (1)) t(i)
    WHERE l_returnflag = 'N' AND l_linestatus = 'F'
""")
def cited_in_notes(spark, d):
    return _tables(spark, d).edges.filter("rel = 'cites'").select("src", "ref")


@case("title_by_type", f"""
    WITH {RECORDS_SQL}
    SELECT id, CASE item_type WHEN 'thesis' THEN 'Thesis ' || o_orderkey
      ELSE '<i>Order</i> ' || o_orderkey || ' of ' || c_name END AS title,
      CASE item_type WHEN 'thesis' THEN 'thesis ' || o_orderkey
      ELSE 'order ' || o_orderkey || ' of ' || {sql_words('c_name')} END AS sort_title
    FROM rec
""")
def title_by_type(spark, d):
    return _docs(spark, d).select("id", "title", "sort_title")


@case("field_catalog", f"""
    WITH {RECORDS_SQL}
    SELECT id, CASE item_type WHEN 'thesis' THEN 'Subject' ELSE 'Title' END
      || '|Abstractnote|Date|Doi|Extra' AS labels FROM rec
""")
def field_catalog(spark, d):
    labels = F.transform("item_fields", lambda f: f["localized"])
    return _docs(spark, d).select("id", F.array_join(labels, "|").alias("labels"))


@case("creator_types_present", f"""
    WITH {RECORDS_SQL} SELECT id, 'author=Author|editor=Editor' AS types FROM rec
""")
def creator_types_present(spark, d):
    shown = F.transform("creator_types", lambda t: F.concat_ws("=", t["creator_type"], t["localized"]))
    return _docs(spark, d).select("id", F.array_join(shown, "|").alias("types"))


@case("creator_names", f"""
    WITH {RECORDS_SQL}
    SELECT id, c_mktsegment || ' ' || c_name || chr(30) || c_name || ', ' || c_mktsegment || chr(30)
      || 'Nation ' || c_nationkey AS text FROM rec
""")
def creator_names(spark, d):
    return _tables(spark, d).texts.filter("field = 'text_creator'").select("id", "text")


@case("creator_sort_key", f"""
    WITH {RECORDS_SQL}
    SELECT id, {sql_words('c_name')} || ' zzz ' || lower(c_mktsegment) AS sort_creator FROM rec
""")
def creator_sort_key(spark, d):
    return _docs(spark, d).select("id", "sort_creator")


@case("primary_creator_types", f"""
    WITH {RECORDS_SQL} SELECT id, c_name AS last_name FROM rec
""")
def primary_creator_types(spark, d):
    order = F.array(F.lit("author"), F.lit("editor"))
    first = names.primary_creators(F.col("creators"), order)
    return _docs(spark, d).select("id", F.explode(first).alias("c")).select(
        "id", F.col("c.lastName").alias("last_name"))


@case("creator_display", f"""
    WITH {RECORDS_SQL}
    SELECT id, 'Author: ' || c_name || ', ' || c_mktsegment || '|Editor: Nation ' || c_nationkey
      AS shown FROM rec
""")
def creator_display(spark, d):
    shown = F.transform(
        names.creator_display(F.col("creators"), F.col("creator_types")),
        lambda c: F.concat_ws(": ", c["label"], c["display"]))
    return _docs(spark, d).select("id", F.array_join(shown, "|").alias("shown"))


@case("alternate_ids", f"""
    WITH {RECORDS_SQL}
    SELECT id, concat_ws('|', CASE WHEN o_orderstatus = 'F' THEN '10.1234/' || o_orderkey END,
      CASE WHEN item_type = 'book' THEN '978-' || o_orderkey END,
      CASE WHEN o_orderstatus = 'O' THEN '10.5555/' || o_orderkey END,
      'X' || o_orderkey) AS ids FROM rec
""")
def alternate_ids(spark, d):
    return _docs(spark, d).select("id", F.array_join("alternate_id", "|").alias("ids"))


@case("relation_refs", f"WITH {RECORDS_SQL} SELECT id, 'O' || o_custkey AS ref FROM rec")
def relation_refs(spark, d):
    return _docs(spark, d).select("id", F.explode("rel_related").alias("ref"))


@case("app_and_web_links", f"""
    WITH {RECORDS_SQL}
    SELECT id, '{APP_SCHEME}://select/groups/1/items/' || id AS app_url,
           'https://library.example.org/' || o_orderkey AS web_url FROM rec
""")
def app_and_web_links(spark, d):
    return _docs(spark, d).select("id", "app_url", "web_url")


@case("build_documents", f"""
    WITH {RECORDS_SQL}
    SELECT id, item_type, CASE WHEN item_type <> 'report' THEN
        upper(substr(item_type, 1, 1)) || lower(substr(item_type, 2)) || ' label' END AS type_label,
      strftime(o_orderdate, '%Y') AS "year", stamp AS date_added,
      CASE o_orderstatus WHEN 'F' THEN 'https://shop.example.org/o/' || o_orderkey ELSE '' END AS url,
      CAST(rpad(replace(parsed_date, '-', ''), 8, '0') AS INTEGER) AS sort_date,
      CAST(epoch(o_orderdate) AS BIGINT) AS sort_date_added,
      array_to_string(list_sort([c_mktsegment, 'Status ' || o_orderstatus]), '|') AS tags,
      CASE o_orderstatus WHEN 'F' THEN 'eng|fra' WHEN 'O' THEN 'deu' END AS languages,
      o_orderstatus = 'F' AS facet_link,
      '<div>Order ' || o_orderkey || '</div>' AS bib, 'ris of ' || o_orderkey AS ris,
      CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
        THEN 'N' || c_nationkey END AS below_region
    FROM rec
""")
def build_documents(spark, d):
    """The full assembly, a column of every kind."""
    languages = F.transform("facet_language", lambda v: v["value"])
    below = F.transform("facet_collection_R1", lambda v: F.array_join(v["path"], "."))
    options = plan.AssemblyOptions(as_of=AS_OF, collection_roots=("R1",))
    return plan.Assembly(derived_library(spark, d), options).docs.select(
        "id", "item_type", F.col("item_type_label").alias("type_label"), "year", "date_added",
        "url", "sort_date", "sort_date_added",
        F.array_join(F.sort_array("facet_tag"), "|").alias("tags"),
        F.array_join(languages, "|").alias("languages"), "facet_link", "bib", "ris",
        F.array_join(below, "|").alias("below_region"))


@case("display_fields", f"""
    WITH {RECORDS_SQL}
    SELECT id, CASE item_type WHEN 'thesis' THEN 'Subject' ELSE 'Title' END AS label,
      CASE item_type WHEN 'thesis' THEN 'Thesis ' || o_orderkey
        ELSE '<i>Order</i> ' || o_orderkey || ' of ' || c_name END AS value FROM rec
    UNION ALL SELECT id, 'Abstractnote', 'Priority ' || o_orderpriority || ' &amp; status '
      || o_orderstatus FROM rec
    UNION ALL SELECT id, 'Date', day FROM rec
    UNION ALL SELECT id, 'Doi', 'https://doi.org/10.1234/' || o_orderkey FROM rec
      WHERE o_orderstatus = 'F'
    UNION ALL SELECT id, 'Extra', 'DOI: <a href="https://doi.org/10.5555/' || o_orderkey
      || '">10.5555/' || o_orderkey || '</a>' || chr(10) || 'Note: x' FROM rec
      WHERE o_orderstatus = 'O'
""")
def display_fields(spark, d):
    from facetlake.plans.publish import display_fields as shown

    return shown(_docs(spark, d)).select("id", "label", "value")


@case("citation_tags", f"""
    WITH {RECORDS_SQL}, pdf AS (
      SELECT id, min(child_key) AS k, arg_min(l_partkey, child_key) AS p FROM kids
      WHERE l_returnflag = 'A' AND l_linestatus = 'F' GROUP BY id)
    SELECT id, 'citation_title' AS name, '<i>Order</i> ' || o_orderkey || ' of ' || c_name AS value
      FROM rec
    UNION ALL SELECT id, 'citation_publication_date', day FROM rec
    UNION ALL SELECT id, 'citation_date', day FROM rec
    UNION ALL SELECT id, 'citation_year', strftime(o_orderdate, '%Y') FROM rec
    UNION ALL SELECT id, 'citation_author', c_name || ', ' || c_mktsegment FROM rec
    UNION ALL SELECT id, 'citation_volume', CAST(c_nationkey AS VARCHAR) FROM rec
    UNION ALL SELECT id, 'citation_language', CASE o_orderstatus WHEN 'F' THEN 'en; fre' ELSE 'German' END
      FROM rec WHERE o_orderstatus <> 'P'
    UNION ALL SELECT id, 'citation_publisher', c_mktsegment FROM rec
    UNION ALL SELECT id, 'citation_firstpage', CAST(o_orderkey AS VARCHAR) FROM rec
    UNION ALL SELECT id, 'citation_lastpage', CAST(o_orderkey + 9 AS VARCHAR) FROM rec
    UNION ALL SELECT id, 'citation_journal_title', 'Order Letters' FROM rec
      WHERE item_type = 'journalArticle'
    UNION ALL SELECT id, 'citation_dissertation_institution', 'University of ' || c_nationkey FROM rec
      WHERE item_type = 'thesis'
    UNION ALL SELECT id, 'citation_isbn', '978-' || o_orderkey FROM rec WHERE item_type = 'book'
    UNION ALL SELECT id, 'citation_doi', CASE o_orderstatus WHEN 'F' THEN '10.1234/' ELSE '10.5555/'
      END || o_orderkey FROM rec WHERE o_orderstatus <> 'P'
    UNION ALL SELECT id, 'citation_pdf_url', id || '/download/' || k || '/part' || p || '.pdf' FROM pdf
""")
def citation_tags(spark, d):
    from facetlake.plans.publish import citation_tags as tagged

    made = _tables(spark, d)
    return tagged(made.docs, made.attachments).select("id", "name", "value")


# --- hierarchy --------------------------------------------------------------------------


@case("collection_ancestors", f"""
    WITH {GEOGRAPHY_SQL} SELECT key, array_to_string(path, '.') AS path FROM closure
""")
def collection_ancestors(spark, d):
    return hierarchy.ancestor_paths(geography(spark, d)).select(
        "key", F.array_join("path", ".").alias("path"))


def _supplied(spark, d):
    """Orders as members of their customer's node."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.expr("concat('C', o_custkey)").alias("key"))


@case("collection_facet_paths", f"""
    WITH {GEOGRAPHY_SQL},
    own AS (SELECT o_orderkey AS id, path FROM orders JOIN closure ON key = 'C' || o_custkey
            WHERE path[1] = 'R2'),
    prefixes AS (SELECT id, [path[2]] AS p FROM own UNION ALL SELECT id, path[2:3] FROM own)
    SELECT id, array_to_string(p, '.') AS path, name AS label
    FROM prefixes JOIN nodes ON key = p[len(p)]
""")
def collection_facet_paths(spark, d):
    nodes = geography(spark, d)
    found = hierarchy.collection_paths(_supplied(spark, d), nodes, hierarchy.ancestor_paths(nodes))
    return hierarchy.collection_facet_paths(found, nodes, "R2").select(
        "id", F.array_join("path", ".").alias("path"), "label")


@case("facet_collection", f"""
    WITH {GEOGRAPHY_SQL},
    own AS (SELECT o_orderkey AS id, path FROM orders JOIN closure ON key = 'C' || o_custkey
            WHERE path[1] = 'R2'),
    prefixes AS (SELECT id, [path[2]] AS p FROM own UNION ALL SELECT id, path[2:3] FROM own)
    SELECT array_to_string(p, '.') AS value, name AS label, count(*) AS "count"
    FROM prefixes JOIN nodes ON key = p[len(p)] GROUP BY ALL
""")
def facet_collection(spark, d):
    """Long rows of one tree facet counted directly."""
    nodes = geography(spark, d)
    found = hierarchy.collection_paths(_supplied(spark, d), nodes, hierarchy.ancestor_paths(nodes))
    rows = hierarchy.collection_facet_paths(found, nodes, "R2").select(
        "id", F.array(F.struct("path", "label")).alias("below"))
    spec = FacetSpec("collection", "below", "where", "path", multi=True, labelled_path=True)
    return facets.facet_counts(rows, [spec]).select("value", "label", "count")


@case("in_collection", f"""
    WITH {GEOGRAPHY_SQL}
    SELECT o_orderkey AS id, coalesce(list_contains(path, 'N12'), false) AS member
    FROM orders LEFT JOIN closure ON key = 'C' || o_custkey
""")
def in_collection(spark, d):
    nodes = geography(spark, d)
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return hierarchy.in_collection(
        items, _supplied(spark, d), nodes, hierarchy.ancestor_paths(nodes), "N12", true_only=False)


@case("dependencies", f"""
    WITH {RECORDS_SQL}
    SELECT id, 'item' AS kind, id AS dep FROM rec
    UNION ALL SELECT id, 'item', 'L' || l_orderkey || 'x' || l_linenumber || 'x' || l_partkey || 'x'
      || l_suppkey FROM lineitem JOIN rec ON l_orderkey = o_orderkey
    UNION ALL SELECT id, 'collection', 'N' || c_nationkey FROM rec
    UNION ALL SELECT id, 'collection', 'R' || n_regionkey FROM rec JOIN nation ON c_nationkey = n_nationkey
""")
def dependencies(spark, d):
    return _tables(spark, d).deps


# --- relations and look-ups -------------------------------------------------------------

EDGES_SQL = """
nodes AS (SELECT 'P' || p_partkey AS id, p_brand || '-' || p_partkey AS alt, p_name FROM part
          UNION ALL SELECT 'O' || o_orderkey, NULL, o_orderpriority FROM orders),
edges AS (SELECT DISTINCT 'O' || l_orderkey AS src, 'P' || l_partkey AS ref FROM lineitem
          UNION SELECT 'O' || l_orderkey, p_brand || '-' || p_partkey FROM lineitem
          JOIN part ON l_suppkey = p_partkey)
"""


def _graph(spark, d):
    """Orders refer to their parts by id, and to one more part by its alternate id."""
    parts, orders = table(spark, d, "part"), table(spark, d, "orders")
    lines = table(spark, d, "lineitem")
    alternate = parts.select(
        F.expr("concat('P', p_partkey)").alias("id"),
        F.expr("concat(p_brand, '-', p_partkey)").alias("alternate_id"), "p_partkey")
    docs = parts.select(F.expr("concat('P', p_partkey)").alias("id"), F.lit("part")
                        .alias("item_type"), F.col("p_name").alias("sort_title")).unionByName(
        orders.select(F.expr("concat('O', o_orderkey)").alias("id"), F.lit("order")
                      .alias("item_type"), F.col("o_orderpriority").alias("sort_title")))
    src = F.expr("concat('O', l_orderkey)").alias("src")
    edges = lines.select(
        src, F.lit("cites").alias("rel"), F.expr("concat('P', l_partkey)").alias("ref")
    ).unionByName(lines.join(alternate, F.col("l_suppkey") == F.col("p_partkey")).select(
        src, F.lit("cites").alias("rel"), F.col("alternate_id").alias("ref")))
    return edges, docs, alternate.select("id", "alternate_id")


@case("related_forward", f"""
    WITH {EDGES_SQL}
    SELECT DISTINCT src, n.id FROM edges JOIN nodes n ON ref = n.id OR ref = n.alt
""")
def related_forward(spark, d):
    edges, docs, alternate = _graph(spark, d)
    return relations.related_forward(edges, docs, alternate).select("src", "id")


@case("related_reverse", f"""
    WITH {EDGES_SQL}
    SELECT DISTINCT ref AS src, src AS id FROM edges WHERE ref IN (SELECT id FROM nodes)
""")
def related_reverse(spark, d):
    edges, docs, _ = _graph(spark, d)
    return relations.related_reverse(edges, docs).select("src", "id")


@case("related_undirected", f"""
    WITH {EDGES_SQL}, kept AS (SELECT src, ref FROM edges WHERE ref IN (SELECT id FROM nodes))
    SELECT src, ref AS id FROM kept UNION SELECT ref, src FROM kept
""")
def related_undirected(spark, d):
    edges, docs, _ = _graph(spark, d)
    return relations.related_undirected(edges, docs).select("src", "id")


@case("related_limit", f"""
    WITH {EDGES_SQL},
    kept AS (SELECT DISTINCT ref AS src, src AS id FROM edges WHERE ref IN (SELECT id FROM nodes)),
    ranked AS (SELECT kept.*, row_number() OVER (PARTITION BY src ORDER BY p_name, id) AS r
               FROM kept JOIN nodes USING (id))
    SELECT src, id, CAST(r AS INTEGER) AS rank FROM ranked WHERE r <= 5
""")
def related_limit(spark, d):
    edges, docs, _ = _graph(spark, d)
    reverse = relations.related_reverse(edges, docs)
    order = [F.col("sort_title"), F.col("id")]
    return relations.related_limit(reverse, docs, order, 5).select("src", "id", "rank")


@case("relations_of_records", f"""
    WITH {EDGES_SQL},
    named AS (SELECT id AS ref, id FROM nodes UNION ALL SELECT alt, id FROM nodes WHERE alt IS NOT NULL),
    cites AS (SELECT DISTINCT src, named.id AS dst FROM edges JOIN named USING (ref)),
    mates AS (SELECT 'P' || p_partkey AS src, 'P' || (p_partkey + 1) AS dst FROM part
              WHERE 'P' || (p_partkey + 1) IN (SELECT id FROM nodes)
              UNION SELECT 'P' || p_partkey, 'P1' FROM part),
    links AS (
      SELECT src, 'cites' AS relation, dst AS id FROM cites
      UNION SELECT dst, 'isCitedBy', src FROM cites
      UNION SELECT src, 'related', dst FROM mates UNION SELECT dst, 'related', src FROM mates)
    SELECT src, relation, id, row_number() OVER (PARTITION BY src, relation ORDER BY p_name, id)
      AS place FROM links JOIN nodes USING (id)
""")
def relations_of_records(spark, d):
    """Orders cite parts; parts are related to the next one and all of them to the first, whose
    list holds every part."""
    from facetlake.plans.catalog import DEFAULT_RELATIONS, SortSpec

    edges, docs, alternate = _graph(spark, d)
    parts = table(spark, d, "part").select(
        F.expr("concat('P', p_partkey)").alias("src"), F.lit("related").alias("rel"),
        F.explode(F.expr("array(concat('P', p_partkey + 1), 'P1')")).alias("ref"))
    return relations.relations_of_records(
        edges.unionByName(parts), docs, alternate, DEFAULT_RELATIONS,
        SortSpec("title", ("sort_title",), False))


@case("resolve_id", """
    SELECT request, CASE WHEN p_partkey IS NOT NULL THEN 'P' || p_partkey END AS id,
           coalesce(request LIKE 'Brand%', false) AND p_partkey IS NOT NULL AS fellback
    FROM (SELECT 'P' || p_partkey AS request FROM part
          UNION ALL SELECT p_brand || '-' || p_partkey FROM part
          UNION ALL SELECT 'Z' || s_suppkey FROM supplier)
    LEFT JOIN part ON request = 'P' || p_partkey OR request = p_brand || '-' || p_partkey
""")
def resolve_id(spark, d):
    _, docs, alternate = _graph(spark, d)
    requests = docs.filter("item_type = 'part'").select(F.col("id").alias("request")).unionByName(
        alternate.select(F.col("alternate_id").alias("request"))).unionByName(
        table(spark, d, "supplier").select(F.expr("concat('Z', s_suppkey)").alias("request")))
    return lookups.resolve_ids(requests, docs, alternate)


# --- maintenance ------------------------------------------------------------------------

CHANGES_SQL = """
since AS (SELECT avg(conv_id) AS v FROM conversations),
items AS (SELECT 'T' || conv_id || '.' || turn AS id, conv_id AS version,
                 CASE WHEN turn > 0 THEN 'T' || conv_id || '.0' END AS parent, turn,
                 role = 'system' AS trashed FROM conversations),
docs AS (SELECT id FROM items, since WHERE parent IS NULL AND NOT trashed),
deps AS (SELECT id, id AS dep FROM docs
         UNION ALL SELECT parent, items.id FROM items JOIN docs ON items.parent = docs.id),
gone AS (SELECT 'T' || doc_id || '.0' AS id FROM labels WHERE toxic = 1
         UNION ALL SELECT 'T' || doc_id || '.1' FROM labels WHERE toxic = 1),
dirty AS (
  SELECT deps.id FROM deps JOIN items i ON dep = i.id, since WHERE version > v
  UNION SELECT deps.id FROM deps JOIN gone ON dep = gone.id
  UNION SELECT parent FROM items, since WHERE version > v AND NOT trashed
    AND parent IN (SELECT id FROM docs)
  UNION SELECT id FROM items, since WHERE version > v AND NOT trashed AND parent IS NULL)
"""


def _changes(spark, d):
    """Turns as items, first turns as documents, conversation numbers as versions; toxic labels
    name deleted items."""
    turns = table(spark, d, "conversations")
    items = turns.select(
        F.expr("concat('T', conv_id, '.', turn)").alias("id"), F.col("conv_id").alias("version"),
        F.expr("CASE WHEN turn > 0 THEN concat('T', conv_id, '.0') END").alias("parent"),
        (F.col("role") == "system").alias("trashed"))
    docs = items.filter("parent IS NULL AND NOT trashed").select("id")
    kids = items.filter("parent IS NOT NULL").select(
        F.col("parent").alias("id"), F.col("id").alias("dep")).join(docs, "id", "left_semi")
    deps = docs.select("id", F.col("id").alias("dep")).unionByName(kids).select(
        "id", F.lit("item").alias("kind"), "dep")
    toxic = table(spark, d, "labels").filter("toxic = 1")
    gone = toxic.select(F.explode(F.array(
        F.expr("concat('T', doc_id, '.0')"), F.expr("concat('T', doc_id, '.1')"))).alias("id"))
    since = turns.agg(F.avg("conv_id").alias("v")).scalar()
    return docs, deps, items, gone, since


def _dirty(spark, d):
    docs, deps, items, gone, since = _changes(spark, d)
    none = docs.filter(F.lit(False))
    return refresh.dirty_documents(
        docs, deps, items, none.withColumn("version", F.lit(0)), gone, none, since)


@case("dirty_documents", f"WITH {CHANGES_SQL} SELECT id FROM dirty")
def dirty_documents(spark, d):
    return _dirty(spark, d)


@case("documents_to_delete", f"WITH {CHANGES_SQL} SELECT id FROM docs WHERE id IN (SELECT id FROM gone)")
def documents_to_delete(spark, d):
    docs, _, _, gone, _ = _changes(spark, d)
    return refresh.documents_to_delete(docs, gone)


@case("union_distinct", f"""
    WITH {CHANGES_SQL} SELECT id FROM dirty UNION SELECT id FROM gone
""")
def union_distinct(spark, d):
    gone = _changes(spark, d)[3]
    return _dirty(spark, d).unionByName(gone).distinct()


@case("difference", f"WITH {CHANGES_SQL} SELECT id FROM dirty WHERE id NOT IN (SELECT id FROM gone)")
def difference(spark, d):
    return refresh.difference(_dirty(spark, d), _changes(spark, d)[3])


@case("upsert_documents", """
    SELECT doc_id, CASE WHEN quality = 1 THEN 'improved' ELSE source END AS source
    FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT -1 - page_id, 'page' FROM pages
""")
def upsert_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    better = table(spark, d, "labels").filter("quality = 1").select(
        "doc_id", F.lit("improved").alias("source"))
    added = table(spark, d, "pages").select(
        (F.lit(-1) - F.col("page_id")).alias("doc_id"), F.lit("page").alias("source"))
    return store.upsert_documents(docs, better.unionByName(added), "doc_id")


@case("delete_documents", """
    SELECT doc_id, source FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def delete_documents(spark, d):
    toxic = table(spark, d, "labels").filter("toxic = 1")
    return store.delete_documents(
        table(spark, d, "documents").select("doc_id", "source"), toxic, "doc_id")


@case("attachment_manifest", f"""
    WITH {RECORDS_SQL}
    SELECT DISTINCT child_key AS file_id FROM kids JOIN rec USING (id)
    WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND o_orderstatus = 'F'
""")
def attachment_manifest(spark, d):
    made = _tables(spark, d)
    wanted = made.docs.filter("facet_link").select("id")
    return refresh.attachment_manifest(made.docs, made.attachments, wanted)


@case("manifest_diff", """
    WITH old AS (SELECT DISTINCT conv_id AS file_id FROM conversations WHERE role = 'system'),
    new AS (SELECT DISTINCT conv_id AS file_id FROM conversations WHERE turn >= 4),
    present AS (SELECT DISTINCT conv_id AS file_id FROM conversations WHERE turn >= 6)
    SELECT file_id, 'remove' AS action FROM old WHERE file_id NOT IN (SELECT file_id FROM new)
    UNION ALL SELECT file_id, 'add' FROM new WHERE file_id NOT IN (SELECT file_id FROM present)
""")
def manifest_diff(spark, d):
    turns = table(spark, d, "conversations").withColumnRenamed("conv_id", "file_id")
    return refresh.manifest_diff(
        turns.filter("role = 'system'"), turns.filter("turn >= 4"), turns.filter("turn >= 6"))


# --- publishing -------------------------------------------------------------------------


@case("export_records", f"""
    WITH {RECORDS_SQL} SELECT id, 'ris of ' || o_orderkey AS record FROM rec
""")
def export_records(spark, d):
    from facetlake.plans.catalog import DEFAULT_EXPORTS, DEFAULT_SORTS
    from facetlake.plans.publish import export_records as exported

    author = next(s for s in DEFAULT_SORTS if s.key == "author_asc")
    return exported(_docs(spark, d), DEFAULT_EXPORTS[0], author)


@case("export_record", f"""
    WITH {RECORDS_SQL}
    SELECT 'X' || o_orderkey AS request, id, 'bibtex of ' || o_orderkey AS record, true AS fellback
    FROM rec
""")
def export_record(spark, d):
    """Every record asked for by the id it replaces."""
    from facetlake.plans.catalog import DEFAULT_EXPORTS
    from facetlake.plans.publish import export_record as exported

    spec = DEFAULT_EXPORTS[1]
    # Documents are stored tables: three look-ups read them, one run computes them. Identifiers
    # that are not stored would be computed once more, to keep empty lists out of the explosion.
    docs = lay_down(_docs(spark, d).select("id", "alternate_id", spec.column))
    alternate = docs.select("id", F.explode("alternate_id").alias("alternate_id"))
    asked = table(spark, d, "orders").select(F.expr("concat('X', o_orderkey)").alias("request"))
    return exported(lookups.resolve_ids(asked, docs, alternate), docs, spec)


@case("feed_entries", f"""
    WITH {RECORDS_SQL}
    SELECT id, CASE item_type WHEN 'thesis' THEN 'Thesis ' || o_orderkey
        ELSE '<i>Order</i> ' || o_orderkey || ' of ' || c_name END AS title,
      stamp AS published, 'Priority ' || o_orderpriority || ' &amp; status ' || o_orderstatus AS summary,
      c_name || ', ' || c_mktsegment || '; Nation ' || c_nationkey AS creators, day AS date,
      CASE o_orderstatus WHEN 'F' THEN 'https://doi.org/10.1234/' || o_orderkey END AS doi_url,
      CASE item_type WHEN 'book' THEN '978-' || o_orderkey END AS isbn, c_mktsegment AS publisher
    FROM rec WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 30 DAYS
    ORDER BY epoch(o_orderdate) DESC, id LIMIT 50
""")
def feed_entries(spark, d):
    from datetime import datetime

    from facetlake.operators.sorting import page
    from facetlake.plans.catalog import SortSpec
    from facetlake.plans.publish import feed_entries as entries
    from facetlake.plans.publish import feed_window

    recent = feed_window(_docs(spark, d).filter("facet_link"), datetime(1998, 6, 1, 15), 30)
    newest = page(recent, SortSpec("added", ("sort_date_added",), True), 1, 50)
    return entries(newest).select(
        "id", "title", "published", "summary", F.array_join("creators", "; ").alias("creators"),
        "date", "doi_url", "isbn", "publisher")


FEED_DAYS = 400


@case("feed_page", f"""
    WITH {RECORDS_SQL}
    SELECT id, CAST(n AS INTEGER) AS position,
      CASE item_type WHEN 'thesis' THEN 'Thesis ' || o_orderkey
        ELSE '<i>Order</i> ' || o_orderkey || ' of ' || c_name END AS title,
      stamp AS published, c_mktsegment AS publisher, item_count, page_count
    FROM (SELECT *, row_number() OVER (ORDER BY epoch(o_orderdate) DESC, id) AS n,
            count(*) OVER () AS item_count,
            CAST(ceil(count(*) OVER () / 20.0) AS BIGINT) AS page_count
          FROM rec
          WHERE o_orderstatus = 'F' AND item_type <> 'report' AND c_mktsegment IN ('BUILDING', 'MACHINERY')
            AND o_orderdate >= TIMESTAMP '2000-03-01' - INTERVAL {FEED_DAYS} DAYS
            AND list_contains({sql_tokens("lower('Order ' || o_orderkey || ' of ' || c_name)")}, 'customer'))
    WHERE n BETWEEN 21 AND 40
""")
def feed_page(spark, d):
    """The second page of a feed of records with a word, a facet filter, a list of required and
    one of rejected values, and an age limit."""
    from dataclasses import replace
    from datetime import datetime

    from facetlake.operators.index_tables import build_term_index
    from facetlake.operators.keywords import Word
    from facetlake.plans.catalog import FacetSpec as Facet, default_catalog
    from facetlake.plans.publish import feed_page as fed

    catalog = default_catalog()
    titles = [f for f in catalog.fields if f.name == "z_title"]
    catalog = replace(catalog, fields=titles, facets=(
        Facet("link", "facet_link", "link", kind="boolean"),))
    made = plan.Assembly(derived_library(spark, d), OPTIONS, catalog)
    docs = made.docs.withColumn("segment", F.from_json("data", "publisher string")["publisher"])
    entries, totals = fed(
        docs, build_term_index(docs, made.texts, catalog.fields, materialize=True), catalog,
        Word("customers", "title"), {"link": ["t"]}, number=2, max_days=FEED_DAYS,
        as_of=datetime(2000, 3, 1, 9), required={"segment": ["BUILDING", "MACHINERY"]},
        rejected={"item_type": ["report"]})
    return entries.select("id", "position", "title", "published", "publisher").join(totals)


@case("export_group", f"""
    WITH {RECORDS_SQL}, sorted AS (
      SELECT 'bibtex of ' || o_orderkey AS record, row_number() OVER (
        ORDER BY {sql_words("CASE item_type WHEN 'thesis' THEN 'Thesis ' || o_orderkey ELSE 'Order ' || o_orderkey || ' of ' || c_name END")}, id) AS n,
        count(*) OVER () AS total FROM rec)
    SELECT '0-head' AS part, '[' AS text
    UNION ALL SELECT '1-records', record FROM sorted WHERE n < total
    UNION ALL SELECT '2-foot', record || ' ]' FROM sorted WHERE n = total
""")
def export_group(spark, d):
    """Every record inside a group format, written as files and read again."""
    from dataclasses import replace

    from facetlake.plans.catalog import DEFAULT_EXPORTS, SortSpec
    from facetlake.plans.publish import EXPORT_PARTS, write_export_group

    spec = replace(DEFAULT_EXPORTS[1], delimiter=" ,\n", group_format="[\n{} ]\n")
    path = _store(spark, "export").root
    write_export_group(_docs(spark, d), spec, SortSpec("title", ("sort_title",), False), path)
    parts = [spark.read.option("lineSep", end).text(f"{path}/{part}").select(
        F.lit(part).alias("part"), F.col("value").alias("text"))
        for part, end in zip(EXPORT_PARTS, ("\n", spec.delimiter, "\n"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@case("result_items", f"""
    WITH {RECORDS_SQL},
    page AS (SELECT id, CAST(row_number() OVER (ORDER BY epoch(o_orderdate) DESC, id) AS INTEGER) AS position FROM rec
             QUALIFY position <= 100),
    entries AS (
      SELECT DISTINCT p.id, 'cites' AS kind, 'O' || (l_suppkey + step) AS child, NULL AS label,
        'O' || (l_suppkey + step) AS value
      FROM page p JOIN kids USING (id), (SELECT unnest([0, 1]) AS step)
      WHERE l_returnflag = 'N' AND l_linestatus = 'F'
      UNION ALL SELECT p.id, 'attachment', child_key, 'part' || l_partkey || '.pdf', 'application/pdf'
      FROM page p JOIN kids USING (id) WHERE l_returnflag = 'A' AND l_linestatus = 'F'
      UNION ALL SELECT p.id, 'link', child_key, CASE l_linestatus WHEN 'F' THEN 'Part ' || l_partkey
          ELSE 'https://parts.example.org/' || l_partkey END, 'https://parts.example.org/' || l_partkey
      FROM page p JOIN kids USING (id) WHERE l_returnflag = 'R'
      UNION ALL SELECT p.id, 'note', child_key, NULL, '<p>Line <b>' || l_linenumber
          || '</b> ships &amp; cites <a href="{URI}O' || l_suppkey || '">it</a><br/>see {URI}O'
          || (l_suppkey + 1) || '</p>'
      FROM page p JOIN kids USING (id) WHERE l_returnflag = 'N' AND l_linestatus <> 'F')
    SELECT page.id, position, kind, CAST(CASE WHEN kind IS NOT NULL THEN row_number() OVER (
        PARTITION BY page.id, kind ORDER BY child) END AS INTEGER) AS place, child, label, value
    FROM page LEFT JOIN entries ON page.id = entries.id
""")
def result_items(spark, d):
    """Everything that belongs to the hundred records added last."""
    from dataclasses import replace

    from facetlake.operators.sorting import page, with_positions
    from facetlake.plans.catalog import SortSpec
    from facetlake.plans.search import result_items as items_of

    library = derived_library(spark, d)
    added = SortSpec("added", ("sort_date_added",), True)
    docs = plan.Assembly(library, OPTIONS).docs.select("id", "sort_date_added")
    # The page is found once, and its ids reach the scans of the items: only what belongs to it
    # is decoded, and kept side by side.
    newest = lay_down(with_positions(page(docs, added, 1, 100), added, 1, 100))
    ids = [r["id"] for r in newest.select("id").collect()]
    own = library.item.filter(F.coalesce("parent_item", "item_key").isin(ids))
    made = plan.Assembly(replace(library, item=own), OPTIONS, materialize=True)
    tables = {n: getattr(made, n) for n in ("edges", "attachments", "links", "notes")}
    return items_of(newest, tables)


@case("url_inventory", """
    SELECT id, position, CAST(ceil(position / 1000.0) AS BIGINT) AS page,
           CAST(ceil(n / 1000.0) AS BIGINT) AS page_count_upper FROM (
      SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position,
             (SELECT count(*) FROM documents) AS n
      FROM documents WHERE lang <> 'es')
""")
def url_inventory(spark, d):
    """Texts in one language play the part of child records."""
    from facetlake.plans.publish import url_inventory as inventory

    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("n_chars").alias("sort_date_modified"),
        F.when(F.col("lang") == "es", "note").otherwise("text").alias("item_type"))
    return inventory(docs).select("id", "position", "page", "page_count_upper")


# --- store and stream -------------------------------------------------------------------


def _store(spark, name):
    import uuid

    from facetlake.session import scratch_dir

    return store.DocumentStore(spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")


@case("read_index", "SELECT doc_id AS id, lang, n_chars FROM documents")
def read_index(spark, d):
    """Documents published as a version, then opened with a check of their columns."""
    published = _store(spark, "store")
    published.publish({"docs": documents(spark, d).select("id", "lang", "n_chars")})
    return published.open(["id", "lang", "n_chars"]).select("id", "lang", "n_chars")


@case("refresh_stream", """
    SELECT user_id AS id, max(event_id) AS version, arg_max(event_type, event_id) AS kind
    FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'
""")
def refresh_stream(spark, d):
    """Events as changes of their user's row; an error deletes it. They arrive in three batches,
    the latest events first, on a store that was built before."""
    from facetlake.streaming.refresh import apply_changes, refresh_stream as refreshed

    kept = _store(spark, "stream")
    events = table(spark, d, "events")
    changes = events.select(
        F.col("user_id").alias("id"), F.col("event_id").alias("version"),
        F.col("event_type").alias("kind"), (F.col("event_type") == "error").alias("deleted"))
    kept.publish({"docs": changes.where("NOT deleted").drop("deleted").limit(0)}, 100)
    turn = F.pmod(F.col("version"), F.lit(3))
    for batch, rest in enumerate((2, 0)):
        apply_changes(kept, changes.where(turn == rest), batch, "id", "version", "deleted",
                      stream="backfill")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events*.parquet").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("version"),
        F.col("event_type").alias("kind"), (F.col("event_type") == "error").alias("deleted"))
    query = refreshed(stream.where(turn == 1), kept, f"{kept.root}/checkpoint")
    query.awaitTermination()
    return kept.read("docs").select("id", "version", "kind")


def _rows_per_record(kept):
    """What the tables of a store hold of each record; the words of a title are read from its
    postings, the corpus counts from those of the buckets."""
    def counted(name, n, rows=lambda df: df):
        return rows(kept.read(name)).groupBy("id").agg(n)

    index = refresh.open_index(kept)
    words = index.postings.filter("field = 'z_title'")
    n_docs = index.field_stats.filter("field = 'z_title'").select("n_docs").scalar()
    everywhere = index.term_stats.filter("field = 'z_title' AND term = 'order'").select("df").scalar()
    drafts = index.term_stats.filter("field = 'z_title' AND term = 'draft'").agg(
        F.coalesce(F.sum("df"), F.lit(0)).cast("bigint")).scalar()
    found = kept.read("docs").select("id", "title")
    for part in (words.groupBy("id").agg(F.sum("tf").alias("title_words")),
                 counted("deps", F.count(F.lit(1)).alias("deps")),
                 counted("notes", F.count(F.lit(1)).alias("notes")),
                 counted("texts", F.count(F.lit(1)).alias("titles"),
                         lambda df: df.filter("field = 'z_title'"))):
        found = found.join(part, "id", "left")
    return found.select(
        "id", "title", "title_words", "deps", F.coalesce("notes", F.lit(0)).alias("notes"),
        "titles", n_docs.alias("n_docs"), everywhere.alias("df_order"), drafts.alias("df_draft"))


REFRESHED_SQL = f"""
    WITH {RECORDS_SQL}, left_over AS (SELECT * FROM rec WHERE o_orderdate >= TIMESTAMP '1995-02-01')
    SELECT id, CASE item_type WHEN 'thesis' THEN 'Thesis ' || o_orderkey
        ELSE '<i>Order</i> ' || o_orderkey || ' of ' || c_name END AS title,
      CAST(len({sql_tokens("'Order ' || o_orderkey || ' of ' || c_name")}) AS BIGINT) AS title_words,
      (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) + 3 AS deps,
      (SELECT count(*) FROM kids WHERE kids.id = left_over.id AND l_returnflag = 'N'
         AND l_linestatus <> 'F') AS notes,
      CAST(1 AS BIGINT) AS titles, (SELECT count(*) FROM left_over) AS n_docs,
      (SELECT count(*) FROM left_over) AS df_order, CAST(0 AS BIGINT) AS df_draft
    FROM left_over
"""


@case("refresh_incremental", REFRESHED_SQL)
def refresh_incremental(spark, d):
    """Built from the first state of the library and refreshed to its last: the rows are those
    of a build from that one."""
    kept, library = _store(spark, "refreshed"), library_states(spark, d)
    refresh.build_full(library(FIRST_STATE), kept, OPTIONS, n_buckets=16)
    refresh.refresh_incremental(library(LAST_STATE), kept, OPTIONS)
    return _rows_per_record(kept)


@case("library_stream", REFRESHED_SQL)
def library_stream(spark, d):
    """The three synchronisations of the library as a stream of its history, one micro-batch
    each, and an empty one in the end."""
    from facetlake.sources.library import SCHEMAS
    from facetlake.streaming.refresh import refresh_library_stream

    kept, library = _store(spark, "library-stream"), library_states(spark, d)
    source = f"{kept.root}/history"
    for state in (*range(LAST_STATE + 1), LAST_STATE):
        now = library(state)
        now.sync_history.filter(F.col("history_id") == state + 1).write.mode("overwrite").parquet(
            f"{source}/arrived={state}")
        history = spark.readStream.schema(SCHEMAS["sync_history"]).parquet(f"{source}/arrived=*")
        refresh_library_stream(history, lambda now=now: now, kept, f"{kept.root}/checkpoint",
                               OPTIONS).awaitTermination()
    return _rows_per_record(kept)


@case("facet_pairs", "SELECT o_orderkey AS id, o_orderstatus AS value, o_orderpriority AS label FROM orders")
def facet_pairs(spark, d):
    pair = labelled(F.col("o_orderstatus"), F.col("o_orderpriority"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), pair.alias("p")).select(
        "id", "p.value", "p.label")
