"""Library tables to document tables (S5): one wide plan, no per-item lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions import dates, languages, names, patterns, text, values
from facetlake.functions.paths import evaluate_once
from facetlake.operators import children, dimensions, hierarchy, tags
from facetlake.plans.catalog import ITEM_FIELD_PREFIX, Catalog, default_catalog
from facetlake.session import lay_down
from facetlake.sources.library import Library, decode_json


@dataclass(frozen=True)
class AssemblyOptions:
    """What goes into the documents. Defaults are the reference settings of a library."""

    # Defaults of the settings.
    style: str = "apa"
    locale: str = "en-US"
    item_include: Sequence[str] | str = ""
    item_exclude: Sequence[str] | str = ""
    child_include: Sequence[str] | str = ""
    child_exclude: Sequence[str] | str = "^_"
    tag_include: str = ""
    tag_exclude: str = "^_"
    cites_tag: str = "_cites"
    media_types: Sequence[str] = ("application/pdf",)
    with_files: bool = True
    # Root collection keys that get a tree facet.
    collection_roots: Sequence[str] = ()
    as_of: date | None = None
    # X-2: extra document columns, by name, over the decoded item columns.
    extra_columns: Mapping[str, Column] | None = None


def top_level_items(items: DataFrame) -> DataFrame:
    """Items without parent that are not trashed."""
    return items.filter(F.col("parent_item").isNull() & hierarchy.live(F.col("trashed")))


def reject_reasons(
    items: DataFrame, include: Sequence[str] | str = "", exclude: Sequence[str] | str = ""
) -> DataFrame:
    """Why an item is left out of the documents, or ``indexed``; the first reason wins."""
    return items.withColumn(
        "status",
        F.when(~hierarchy.live(F.col("trashed")), "trashed")
        .when(F.col("parent_item").isNotNull(), "not top-level")
        .when(~tags.tag_gate(F.col("tags"), include, exclude), "excluded by tag")
        .otherwise("indexed"),
    )


def relation_refs(relations: Column, predicate: str) -> Column:
    """M8: values of one predicate as a list; empty without any."""
    def as_array(value: Column) -> Column:
        return F.when(
            F.startswith(value, F.lit("[")), F.from_json(value, "array<string>")
        ).when(value != "", F.array(value))

    value = F.from_json(relations, "map<string,string>")[predicate]
    return F.coalesce(evaluate_once(value, as_array), F.expr(patterns.EMPTY))


def collection_nodes(collection: DataFrame) -> DataFrame:
    """The collection tree in the shape of the hierarchy operators."""
    return collection.select(
        F.col("collection_key").alias("key"), F.col("parent_collection").alias("parent"),
        "name", "trashed", "version",
    )


def app_url(history: DataFrame, item_key: Column) -> Column:
    """M9: link that opens an item in the desktop application."""
    latest = history.agg(
        F.max_by(F.struct("library_prefix", "library_id"), "history_id").alias("s")
    ).select("s.*")
    prefix = latest.select("library_prefix").scalar()
    library = latest.select("library_id").scalar()
    root = f"{patterns.APP_SCHEME}://select/"
    return F.when(
        prefix == "users", F.concat(F.lit(root + "library/items/"), item_key)
    ).otherwise(F.concat(F.lit(root + "groups/"), library, F.lit("/items/"), item_key))


def web_url(link_map: Column, key: str = "alternate", media_type: str = "text/html") -> Column:
    """M9: a link of the item, if it has the wanted media type."""
    return F.when(link_map[key]["type"] == media_type, link_map[key]["href"])


class Assembly:
    """The document tables of a library, for every item or only for the listed ``id`` keys.

    Each table is planned when first asked for, so a job that needs one pays for one. A job that
    writes them all lets ``materialize`` lay down what they share: the decoded items, their
    children and the documents, each computed once.
    """

    NAMES = ("docs", "texts", "notes", "links", "attachments", "deps", "edges")

    def __init__(
        self, library: Library, options: AssemblyOptions | None = None,
        catalog: Catalog | None = None, keys: DataFrame | None = None, materialize: bool = False,
    ):
        self.materialize = materialize
        self.library = library
        self.options = options or AssemblyOptions()
        self.catalog = catalog or default_catalog()
        self.keys = keys

    def _laid_down(self, df: DataFrame) -> DataFrame:
        return lay_down(df) if self.materialize else df

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.NAMES}

    @cached_property
    def items(self) -> DataFrame:
        return decode_json(self.library.item)

    @cached_property
    def kept(self) -> DataFrame:
        """The items that become documents, with their data as a map."""
        parents = top_level_items(self.items)
        if self.keys is not None:
            wanted = self.keys.select(F.col("id").alias("item_key"))
            parents = parents.join(wanted, "item_key", "left_semi")
        marked = reject_reasons(parents, self.options.item_include, self.options.item_exclude)
        return self._laid_down(marked.filter("status = 'indexed'").drop("status").withColumn(
            "fields", F.from_json("data", "map<string,string>")
        ))

    @cached_property
    def _owned(self) -> DataFrame:
        """The children of the kept items, trashed ones too."""
        owners = self.kept.select(F.col("item_key").alias("parent_item"))
        return self._laid_down(self.items.filter(F.col("parent_item").isNotNull()).join(
            owners, "parent_item", "left_semi"))

    def _children(self, kind: str, include, exclude) -> DataFrame:
        return children.children_of_type(self._owned, kind, include, exclude)

    @cached_property
    def _attached(self) -> DataFrame:
        return self._children("attachment", self.options.child_include, self.options.child_exclude)

    @cached_property
    def _note_rows(self) -> DataFrame:
        return children.child_notes(
            self._children("note", self.options.child_include, self.options.child_exclude)
        )

    @cached_property
    def _wide(self) -> DataFrame:
        as_of = F.lit(self.options.as_of) if self.options.as_of else F.current_date()
        kept = self.kept
        if self.materialize:
            # Few bytes, much work for each: a number that is given is not reduced. The joins
            # that follow keep this partitioning.
            tasks = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            kept = kept.repartition(tasks, "item_key")
        return self._laid_down(_documents(self.library, kept, self.options, as_of))

    @cached_property
    def docs(self) -> DataFrame:
        return self._wide.drop("fields", "text_collections")

    @cached_property
    def texts(self) -> DataFrame:
        fulltext = children.child_fulltext(
            self._attached, self.library.item_file, self.library.item_fulltext,
            self.options.media_types,
        )
        return _texts(self._wide, self._note_rows, fulltext, self.catalog)

    @cached_property
    def notes(self) -> DataFrame:
        return self._note_rows.select("id", "child_key", "note")

    @cached_property
    def links(self) -> DataFrame:
        return children.child_links(self._attached)

    @cached_property
    def attachments(self) -> DataFrame:
        files = children.child_files(
            self._attached, self.library.item_file, self.options.media_types
        )
        return files if self.options.with_files else files.filter(F.lit(False))

    @cached_property
    def deps(self) -> DataFrame:
        return _dependencies(self.library, self.kept, self._owned)

    @cached_property
    def edges(self) -> DataFrame:
        return _edges(self.kept, self._children("note", self.options.cites_tag, ""))


def assemble(
    library: Library, options: AssemblyOptions | None = None, catalog: Catalog | None = None,
    keys: DataFrame | None = None, materialize: bool = False,
) -> dict[str, DataFrame]:
    """All document tables at once."""
    return Assembly(library, options, catalog, keys, materialize).tables()


def _documents(
    library: Library, kept: DataFrame, options: AssemblyOptions, as_of: Column
) -> DataFrame:
    locale = options.locale
    field = F.col("fields")
    per_type = (
        dimensions.title_fields(library.item_type_field)
        .join(dimensions.type_labels(library.item_type_locale, locale), "item_type", "full")
        .join(dimensions.field_catalog(
            library.item_type_field, library.item_type_field_locale, locale
        ), "item_type", "full")
        .join(dimensions.creator_type_catalog(
            library.item_type_creator_type, library.item_type_creator_type_locale, locale
        ).withColumnRenamed("creator_types", "type_catalog"), "item_type", "full")
        .join(dimensions.creator_type_order(library.item_type_creator_type), "item_type", "full")
    )
    rows = (
        kept.join(per_type, "item_type", "left")
        .join(dimensions.reference_text(library.item_bib, options.style, locale), "item_key",
              "left")
        .join(dimensions.export_formats(
            library.item_export_format, ["coins", "ris", "bibtex"]
        ), "item_key", "left")
        .join(_collection_columns(library, kept, options), "item_key", "left")
        .join(dimensions.recorded_tags(library.item_tag), "item_key", "left")
    )
    title = F.coalesce(field[F.col("title_field")], F.lit(""))
    type_order = F.coalesce("type_order", F.expr(patterns.EMPTY))
    creators = F.coalesce("creators", F.expr("array()").cast(
        "array<struct<creatorType:string,firstName:string,lastName:string,name:string>>"
    ))
    parsed, added, modified = F.col("parsed_date"), field["dateAdded"], field["dateModified"]
    related = patterns.item_ids_in_uris(relation_refs(F.col("relations"), "dc:relation"))
    tag_values = tags.tag_filter(F.col("recorded_tags"), options.tag_include, options.tag_exclude)
    return rows.select(
        F.col("item_key").alias("id"),
        patterns.alternate_ids(
            field["DOI"], field["ISBN"], field["ISSN"], F.coalesce(field["extra"], F.lit("")),
            relation_refs(F.col("relations"), "dc:replaces"),
        ).alias("alternate_id"),
        "item_type",
        F.col("type_label").alias("item_type_label"),
        dates.year_of(parsed).alias("year"),
        title.alias("title"),
        added.alias("date_added"), modified.alias("date_modified"),
        field["url"].alias("url"),
        related.alias("rel_related"),
        text.sort_key_text(title).alias("sort_title"),
        names.creator_sort_key(creators, type_order).alias("sort_creator"),
        dates.sort_date(parsed).alias("sort_date"),
        dates.iso_epoch(added).alias("sort_date_added"),
        dates.iso_epoch(modified).alias("sort_date_modified"),
        dates.filter_date(parsed, added, as_of).alias("filter_date"),
        tag_values.alias("facet_tag"),
        values.labelled(F.col("item_type"), F.coalesce("type_label", "item_type"))
        .alias("facet_item_type"),
        dates.year_path(parsed).alias("facet_year"),
        languages.normalize_language(
            field["language"], languages=languages.known_languages(kept.sparkSession)
        ).alias("facet_language"),
        values.has_url(field["url"]).alias("facet_link"),
        *[F.col(f"facet_collection_{root}") for root in options.collection_roots],
        names.creator_names(creators).alias("text_creator"),
        F.array_join(
            dimensions.sort_by_normal_form(tag_values), text.RECORD_SEPARATOR
        ).alias("text_tags"),
        "text_collections",
        app_url(library.sync_history, F.col("item_key")).alias("app_url"),
        web_url(F.col("link_map")).alias("web_url"),
        F.coalesce("item_fields", F.expr("array()").cast(
            "array<struct<field:string,locale:string,localized:string>>")).alias("item_fields"),
        dimensions.creator_types_present(F.col("type_catalog"), creators).alias("creator_types"),
        creators.alias("creators"),
        "fields",
        *[column.alias(name) for name, column in (options.extra_columns or {}).items()],
        "bib", "coins", "ris", "bibtex", "data",
    )


def _membership(library: Library, kept: DataFrame) -> DataFrame:
    """``id, key``: the recorded collections of the kept items."""
    ids = kept.select(F.col("item_key").alias("id"))
    return library.item_collection.select(
        F.col("item_key").alias("id"), F.col("collection_key").alias("key")
    ).distinct().join(ids, "id", "left_semi")


def _collection_columns(
    library: Library, kept: DataFrame, options: AssemblyOptions
) -> DataFrame:
    """Collection names and facet paths per item, as its memberships are recorded."""
    nodes = collection_nodes(library.collection)
    membership = _membership(library, kept)
    named = dimensions.collection_names(membership, nodes).groupBy("id").agg(
        F.array_join(
            dimensions.sort_by_normal_form(F.collect_list("name")), text.RECORD_SEPARATOR
        ).alias("text_collections")
    )
    if options.collection_roots:
        closure = hierarchy.ancestor_paths(nodes)
        paths = hierarchy.collection_paths(membership, nodes, closure)
        for root in options.collection_roots:
            tree = hierarchy.collection_facet_paths(paths, nodes, root).groupBy("id").agg(
                F.sort_array(F.collect_set(F.struct("path", "label")))
                .alias(f"facet_collection_{root}")
            )
            named = named.join(tree, "id", "full")
    return named.withColumnRenamed("id", "item_key")


def _texts(
    docs: DataFrame, notes: DataFrame, fulltext: DataFrame, catalog: Catalog
) -> DataFrame:
    """Long searchable texts of every known field: ``id, field, part, text``."""
    known = {f.name: f for f in catalog.fields}
    own = [n for n in ("id", "item_type_label", "year", "text_creator", "text_collections",
                       "text_tags") if n in known]
    entries = [
        F.struct(F.lit(n).alias("field"), F.lit("").alias("part"), F.col(n).alias("text"))
        for n in own
    ]
    item_keys = [n.removeprefix(ITEM_FIELD_PREFIX) for n in known
                 if n.startswith(ITEM_FIELD_PREFIX)]
    verbatim = [n.removeprefix(ITEM_FIELD_PREFIX) for n in known
                if n.startswith(ITEM_FIELD_PREFIX) and known[n].analyzer == "id"]
    data_entries = F.transform(
        F.filter(F.map_entries("fields"), lambda e: e["key"].isin(item_keys)),
        lambda e: F.struct(
            F.concat(F.lit(ITEM_FIELD_PREFIX), e["key"]).alias("field"), F.lit("").alias("part"),
            F.when(e["key"].isin(verbatim), e["value"])
            .otherwise(text.strip_rich_text(e["value"])).alias("text"),
        ),
    )
    every = [F.array(*entries), data_entries]
    if "alternate_id" in known:
        every.append(F.transform(
            F.coalesce("alternate_id", F.expr(patterns.EMPTY)),
            lambda v, n: F.struct(F.lit("alternate_id").alias("field"),
                                  n.cast("string").alias("part"), v.alias("text")),
        ))
    rows = docs.select("id", F.explode(F.concat(*every)).alias("e")).select("id", "e.*")
    for name, source in (("text_notes", notes), ("text_docs", fulltext)):
        if name in known:
            rows = rows.unionByName(source.select(
                "id", F.lit(name).alias("field"), F.col("child_key").alias("part"), "text"
            ))
    return rows.filter("text <> ''")


def _dependencies(library: Library, kept: DataFrame, owned: DataFrame) -> DataFrame:
    """``id, kind, dep``: items and collections whose change makes a document stale."""
    ids = kept.select(F.col("item_key").alias("id"))
    own = ids.select("id", F.lit("item").alias("kind"), F.col("id").alias("dep"))
    below = owned.select(
        F.col("parent_item").alias("id"), F.lit("item").alias("kind"),
        F.col("item_key").alias("dep"),
    )
    nodes = collection_nodes(library.collection)
    membership = _membership(library, kept)
    everything = hierarchy.ancestor_paths(nodes, include_trashed=True)
    above = hierarchy.collection_dependencies(membership, everything).select(
        "id", F.lit("collection").alias("kind"), "dep"
    )
    return own.unionByName(below).unionByName(above)


def _edges(kept: DataFrame, citing: DataFrame) -> DataFrame:
    """Links as rows: ``src, rel, ref``."""
    related = patterns.item_ids_in_uris(relation_refs(F.col("relations"), "dc:relation"))
    return kept.select(
        F.col("item_key").alias("src"), F.lit("related").alias("rel"),
        F.explode(F.array_distinct(related)).alias("ref"),
    ).unionByName(children.cited_in_notes(citing).select(
        F.col("id").alias("src"), F.lit("cites").alias("rel"), "ref"
    ))
