"""What a library is searched, filtered, sorted and exported by.

Plain lists of dataclasses: a caller extends or trims them before passing them on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetlake.functions.dates import year_path_label


@dataclass(frozen=True)
class IndexField:
    """A searchable field. ``analyzer`` is ``id`` (verbatim), ``name`` or ``text`` (stemmed)."""

    name: str
    analyzer: str = "text"
    boost: float = 1.0
    scopes: tuple[str, ...] = ("all",)
    # Whether a document may hold several rows (parts) of this field.
    multi_part: bool = False


@dataclass(frozen=True)
class FacetSpec:
    """A facet over one column of ``docs``.

    Kinds: ``flat`` (text), ``labelled`` (struct value, label), ``path`` (array of components,
    or struct path, label), ``boolean``.
    """

    key: str
    column: str
    filter_key: str
    kind: str = "flat"
    multi: bool = False
    labelled_path: bool = False
    missing_label: str | None = None
    sort_by: tuple[str, ...] = ("label",)
    sort_reverse: bool = False
    initial_limit: int = 0
    initial_leeway: int = 0
    path_separator: str = "."
    # Label of a path value from its components, e.g. year ranges.
    path_label: Callable[[Column], Column] | None = field(default=None, compare=False)


@dataclass(frozen=True)
class SortSpec:
    """Sort columns with one direction for all, or one per column."""

    key: str
    columns: tuple[str, ...]
    reverse: bool | tuple[bool, ...] = False

    def directions(self) -> tuple[bool, ...]:
        if isinstance(self.reverse, bool):
            return (self.reverse,) * len(self.columns)
        return self.reverse


@dataclass(frozen=True)
class RelationSpec:
    """Links of one kind; undirected links are followed both ways, directed ones also backwards
    if ``reverse_key`` names that list."""

    key: str
    column: str
    directed: bool = True
    match_alternate: bool = False
    reverse_key: str | None = None


@dataclass(frozen=True)
class BadgeSpec:
    """A boolean per document from a user predicate."""

    key: str
    predicate: Callable[[], Column] = field(compare=False)
    weight: int = 0


@dataclass(frozen=True)
class ExportSpec:
    """A stored record format and how records are put together."""

    key: str
    column: str
    delimiter: str = ""
    group_format: str = "{}"
    max_records: int = 0


@dataclass(frozen=True)
class Catalog:
    """Everything a search can refer to."""

    fields: Sequence[IndexField] = ()
    facets: Sequence[FacetSpec] = ()
    sorts: Sequence[SortSpec] = ()
    relations: Sequence[RelationSpec] = ()
    badges: Sequence[BadgeSpec] = ()
    exports: Sequence[ExportSpec] = ()

    def with_items(self, **items) -> Catalog:
        """X-1: copy with some lists extended, an item of the same key replacing the old one."""
        changed = {}
        for name, added in items.items():
            key = "name" if name == "fields" else "key"
            added_keys = {getattr(a, key) for a in added}
            kept = [o for o in getattr(self, name) if getattr(o, key) not in added_keys]
            changed[name] = (*kept, *added)
        return replace(self, **changed)

    def without(self, **keys) -> Catalog:
        """X-1: copy without the named items."""
        changed = {}
        for name, removed in keys.items():
            key = "name" if name == "fields" else "key"
            changed[name] = tuple(o for o in getattr(self, name) if getattr(o, key) not in removed)
        return replace(self, **changed)

    def facet(self, key: str) -> FacetSpec:
        return next(f for f in self.facets if f.key == key)

    def sort(self, key: str) -> SortSpec:
        return next(s for s in self.sorts if s.key == key)


# Default searchable fields of library items by analyzer and weight.
ITEM_FIELDS = (
    ("id", 40.0, ("all", "metadata"), (
        "applicationNumber", "billNumber", "callNumber", "codeNumber", "docketNumber",
        "documentNumber", "patentNumber", "priorityNumbers", "publicLawNumber", "reportNumber",
    )),
    ("text", 20.0, ("all", "metadata", "title"), (
        "caseName", "nameOfAct", "shortTitle", "subject", "title",
    )),
    ("text", 8.0, ("all", "metadata"), (
        "blogTitle", "bookTitle", "code", "conferenceName", "dictionaryTitle", "encyclopediaTitle",
        "forumTitle", "meetingName", "proceedingsTitle", "programTitle", "publicationTitle",
        "section", "series", "seriesTitle", "session", "websiteTitle",
    )),
    ("name", 4.0, ("all", "metadata"), (
        "archive", "archiveID", "archiveLocation", "assignee", "audioFileType",
        "audioRecordingFormat", "committee", "company", "country", "court", "distributor",
        "institution", "issuingAuthority", "journalAbbreviation", "label", "legislativeBody",
        "libraryCatalog", "network", "place", "programmingLanguage", "publisher", "reporter",
        "studio", "system", "university", "videoRecordingFormat",
    )),
    ("text", 4.0, ("all", "metadata"), (
        "date", "dateDecided", "dateEnacted", "filingDate", "issueDate", "abstractNote",
        "artworkMedium", "artworkSize", "codeVolume", "edition", "episodeNumber", "extra", "genre",
        "history", "interviewMedium", "issue", "language", "legalStatus", "letterType",
        "manuscriptType", "mapType", "postType", "presentationType", "references", "reportType",
        "reporterVolume", "repository", "rights", "seriesNumber", "seriesText", "thesisType",
        "versionNumber", "volume", "websiteType",
    )),
)
# Prefix that keeps item fields apart from the other columns.
ITEM_FIELD_PREFIX = "z_"


def item_fields() -> tuple[IndexField, ...]:
    """Searchable fields taken directly from item data."""
    return tuple(
        IndexField(ITEM_FIELD_PREFIX + name, analyzer, boost, scopes)
        for analyzer, boost, scopes, names in ITEM_FIELDS
        for name in names
    )


# Default weights and scopes of the derived searchable fields.
CORE_FIELDS = (
    IndexField("id", "id", 200.0, ("all", "metadata")),
    IndexField("alternate_id", "id", 200.0, ("all", "metadata"), multi_part=True),
    IndexField("item_type_label", "text", 4.0, ("all", "metadata")),
    IndexField("year", "id", 8.0, ("pubyear",)),
    IndexField("text_creator", "name", 8.0, ("all", "metadata", "creator")),
    IndexField("text_collections", "text", 8.0, ("all", "metadata")),
    IndexField("text_tags", "text", 8.0, ("all", "metadata")),
    IndexField("text_notes", "text", 2.0, ("all", "metadata"), multi_part=True),
    IndexField("text_docs", "text", 1.0, ("all", "fulltext"), multi_part=True),
)

# Default sorts; True is descending.
DEFAULT_SORTS = (
    SortSpec("score", ()),
    SortSpec("recently_added", ("sort_date_added", "sort_date", "sort_creator", "sort_title"),
             (True, True, False, False)),
    SortSpec("date_desc", ("sort_date", "sort_creator", "sort_title"), (True, False, False)),
    SortSpec("date_asc", ("sort_date", "sort_creator", "sort_title"), False),
    SortSpec("author_asc", ("sort_creator", "sort_title", "sort_date"), False),
    SortSpec("author_desc", ("sort_creator", "sort_title", "sort_date"), (True, False, False)),
    SortSpec("title_asc", ("sort_title", "sort_creator", "sort_date"), False),
    SortSpec("title_desc", ("sort_title", "sort_creator", "sort_date"), (True, False, False)),
)

DEFAULT_RELATIONS = (
    RelationSpec("cites", "rel_cites", directed=True, match_alternate=True,
                 reverse_key="isCitedBy"),
    RelationSpec("related", "rel_related", directed=False),
)

DEFAULT_EXPORTS = (
    ExportSpec("ris", "ris", "", "{}"),
    ExportSpec("bibtex", "bibtex", "", "{}"),
)


def default_facets(year_label: Callable[[Column], Column] | None = None) -> tuple[FacetSpec, ...]:
    """Tag, item type and year facets of a library."""
    return (
        FacetSpec("tag", "facet_tag", "topic", "flat", multi=True, initial_limit=10,
                  initial_leeway=4),
        FacetSpec("item_type", "facet_item_type", "type", "labelled", initial_limit=10,
                  initial_leeway=4),
        FacetSpec("year", "facet_year", "year", "path", multi=True, missing_label="Unknown",
                  path_label=year_label or year_range_label),
    )


def optional_facets() -> tuple[FacetSpec, ...]:
    """Language and link facets, for catalogues that want them."""
    return (
        FacetSpec("language", "facet_language", "lang", "labelled", multi=True,
                  initial_limit=10, initial_leeway=4),
        FacetSpec("link", "facet_link", "link", "boolean"),
    )


def year_range_label(path: Column) -> Column:
    """A year, or the range of a decade or century up to the current year."""
    return year_path_label(path, F.year(F.current_date()))


def collection_facet(collection_key: str, filter_key: str) -> FacetSpec:
    """A tree facet of everything below one root collection."""
    return FacetSpec(f"collection_{collection_key}", f"facet_collection_{collection_key}",
                     filter_key, "path", multi=True, labelled_path=True)


def default_catalog() -> Catalog:
    return Catalog(
        fields=(*CORE_FIELDS, *item_fields()),
        facets=default_facets(),
        sorts=DEFAULT_SORTS,
        relations=DEFAULT_RELATIONS,
        exports=DEFAULT_EXPORTS,
    )
