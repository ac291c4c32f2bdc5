"""Bulk outputs: exports, feed, URL inventory, citation tags, display fields, freshness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions.text import strip
from facetlake.functions import dates, names, patterns, text, values
from facetlake.operators import sorting
from facetlake.operators.index_tables import TermIndex
from facetlake.operators.keywords import Expr
from facetlake.operators.numbering import global_positions
from facetlake.operators.relations import CHILD_TYPES
from facetlake.operators.sorting import sort_columns
from facetlake.plans.catalog import Catalog, ExportSpec, SortSpec
from facetlake.plans.search import search
from facetlake.session import lay_down

# Fixed value: URLs per page of the inventory.
URLS_PER_PAGE = 1000


def records_of(docs: DataFrame) -> DataFrame:
    """Documents that are records of their own."""
    return docs.filter(~F.coalesce(F.col("item_type").isin(*CHILD_TYPES), F.lit(False)))


def export_records(matched: DataFrame, spec: ExportSpec, sort: SortSpec | None) -> DataFrame:
    """One stored text per match, in sort order; a distributed sort, nothing collected."""
    return matched.orderBy(*sort_columns(sort)).select(
        "id", F.coalesce(F.col(spec.column), F.lit("")).alias("record")
    )


def export_allowed(item_count: int, spec: ExportSpec) -> bool:
    """Exports may be limited to small results; 0 is no limit."""
    return spec.max_records == 0 or item_count <= spec.max_records


def write_export(
    matched: DataFrame, spec: ExportSpec, sort: SortSpec | None, path: str
) -> None:
    """Write the records as ordered text files, the delimiter between records."""
    lines = export_records(matched, spec, sort).select("record")
    if not spec.delimiter:
        # A text file needs a line end; it stands for the one the record brings along.
        lines = lines.select(F.regexp_replace("record", r"\n\z", "").alias("record"))
    lines.write.mode("overwrite").option("lineSep", spec.delimiter or "\n").text(path)


EXPORT_PARTS = ("0-head", "1-records", "2-foot")


def write_export_group(
    matched: DataFrame, spec: ExportSpec, sort: SortSpec | None, path: str
) -> None:
    """Write all records in order inside the group format, the delimiter between records.

    Three folders, ``EXPORT_PARTS``, hold the text before, the records, and the last record with
    the text after; their files laid end to end are the export. The records are sorted by range
    and written by as many tasks; only the last one, which no delimiter follows, and the fixed
    texts are written apart. Without a delimiter each record must end its last line, as stored
    formats do: a text file cannot be written otherwise.
    """
    spark = matched.sparkSession
    before, after = spec.group_format.split("{}", 1)
    # The documents are computed once, for their order and the stored text alone.
    order = sort.columns if sort and sort.columns else ("score",)
    records = lay_down(matched.select(
        *dict.fromkeys([*order, "id"]), F.coalesce(F.col(spec.column), F.lit("")).alias("_record")))
    placed = lay_down(global_positions(records, sort_columns(sort), "_at").select(
        "_at", "_record"))
    last = placed.agg(F.max("_at")).first()[0]
    if not spec.delimiter:
        if not placed.filter(~F.endswith("_record", F.lit("\n"))).isEmpty():
            raise ValueError("records without a delimiter must end with a line feed")
        lines = F.regexp_replace("_record", r"\n\z", "")
    else:
        lines = F.col("_record")
    # Rows come out of the numbering in order, and a text file keeps the order of its task.
    placed.filter(F.col("_at") < F.lit(last)).orderBy("_at").select(lines.alias("value")).write.mode(
        "overwrite").option("lineSep", spec.delimiter or "\n").text(f"{path}/{EXPORT_PARTS[1]}")

    def write_one(text: DataFrame, end: str, part: str) -> None:
        """One row, written with its last character as the line end."""
        rows = text.filter("value <> ''").select(
            F.substring("value", F.lit(1), F.length("value") - 1).alias("value"))
        rows.write.mode("overwrite").option("lineSep", end or "\n").text(f"{path}/{part}")

    head = spark.range(1).select(F.lit(before).alias("value"))
    write_one(head, before[-1:], EXPORT_PARTS[0])
    final = placed.filter(F.col("_at") == F.lit(last)).select("_record")
    if last is None:
        final = spark.range(1).select(F.lit("").alias("_record"))
    # At most one record: its end is known on the driver.
    end = after[-1:] or (final.select(F.substring("_record", -1, 1)).first() or ("",))[0]
    write_one(final.select(F.concat("_record", F.lit(after)).alias("value")), end, EXPORT_PARTS[2])


def export_text(records: DataFrame, spec: ExportSpec) -> DataFrame:
    """S12 for a page of records: one joined text inside the group format."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "record")))
    body = F.array_join(F.transform(ordered, lambda r: r["record"]), spec.delimiter)
    before, after = spec.group_format.split("{}", 1)
    return records.agg(F.concat(F.lit(before), body, F.lit(after)).alias("text"))


def export_record(resolved: DataFrame, docs: DataFrame, spec: ExportSpec) -> DataFrame:
    """Stored text of looked-up records; nothing where it is empty."""
    return (
        resolved.filter("id IS NOT NULL")
        .join(docs.select("id", F.col(spec.column).alias("record")), "id")
        .filter(F.coalesce("record", F.lit("")) != "")
        .select("request", "id", "record", "fellback")
    )


# Fixed value: the order of a feed.
FEED_SORT = SortSpec("date_added_desc", ("sort_date_added",), True)


def feed_page(
    docs: DataFrame, index: TermIndex, catalog: Catalog, keywords: Expr | None = None,
    filters: Mapping[str, Sequence[str]] | None = None, number: int = 1, length: int = 20,
    max_days: int = 0, as_of: datetime | None = None,
    required: Mapping[str, Sequence] | None = None, rejected: Mapping[str, Sequence] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The entries of one page of a feed, newest first, and the totals of the feed.

    Takes what a search takes: keywords and facet filters; ``required`` (any of the values) and
    ``rejected`` columns; and an age limit in days before the midnight of ``as_of``, 0 for none.
    Notes and attachments are no entries. A page number beyond the end gives the last page.
    """
    recent = feed_window(docs, as_of, max_days) if max_days else docs
    found = search(recent, index, catalog, keywords, filters, FEED_SORT,
                   any_values=required or {}, rejected=rejected or {})
    # Both follow from the keys, so the search runs once and a page's documents are read once.
    newest = found.later_page(number, length)
    return feed_entries(newest, "position"), sorting.result_totals(found.keys, length)


def feed_window(df: DataFrame, as_of: datetime, max_days: int) -> DataFrame:
    """Only documents dated at most ``max_days`` before today's midnight; 0 is no limit."""
    if not max_days:
        return df
    start = F.date_trunc("DAY", F.lit(as_of)) - F.expr(f"INTERVAL {int(max_days)} DAYS")
    return df.filter(F.col("filter_date") >= start)


# Item fields that may hold the date of a record, in order of preference.
DATE_FIELDS = ("date", "dateDecided", "dateEnacted", "filingDate", "issueDate")


def first_date(fields: Column) -> Column:
    """First non-empty date field."""
    return F.coalesce(*[F.nullif(fields[name], F.lit("")) for name in DATE_FIELDS])


def feed_entries(docs: DataFrame, *extra: str) -> DataFrame:
    """Entry columns of the documents of one feed page, and ``extra`` ones as they are."""
    field = F.from_json("data", "map<string,string>")

    def nonempty(name: str) -> Column:
        return F.nullif(field[name], F.lit(""))

    def plain(name: str) -> Column:
        return text.strip_markup(text.escape_rich_text(nonempty(name)))

    return docs.select(
        "id",
        text.escape_rich_text(F.col("title")).alias("title"),
        field["dateAdded"].alias("published"),
        field["dateModified"].alias("updated"),
        text.escape_rich_text(nonempty("abstractNote")).alias("summary"),
        F.transform("creators", names.display_name).alias("creators"),
        first_date(field).alias("date"),
        values.doi_url(nonempty("DOI")).alias("doi_url"),
        plain("ISBN").alias("isbn"), plain("ISSN").alias("issn"),
        plain("language").alias("language"), plain("publisher").alias("publisher"),
        plain("rights").alias("rights"), *extra,
    )


def url_inventory(
    docs: DataFrame, modified: str = "sort_date_modified", per_page: int = URLS_PER_PAGE
) -> DataFrame:
    """``id, position, page`` of every record, last modified first.

    The number of pages announced counts all documents, child records included.
    """
    announced = docs.agg(
        F.ceil(F.count(F.lit(1)) / F.lit(per_page)).cast("bigint").alias("n")
    )
    rows = records_of(docs).select("id", modified)
    numbered = global_positions(rows, [F.col(modified).desc(), F.col("id").asc()])
    return numbered.select(
        "id", modified, "position",
        F.ceil(F.col("position") / F.lit(per_page)).cast("bigint").alias("page"),
        announced.scalar().alias("page_count_upper"),
    )


def freshness(state: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Last change and hours since, three decimals."""
    now = F.current_timestamp() if as_of is None else as_of
    seconds = F.unix_micros(now) - F.unix_micros(F.col("ended_on").cast("timestamp"))
    return state.select(
        F.col("ended_on").alias("when"),
        F.round(seconds / F.lit(3_600_000_000), 3).alias("hours_ago"),
    )


# Item types that get citation tags, and their fields.
CITED_TYPES = ("book", "conferencePaper", "journalArticle", "report", "thesis")
VENUES = (
    ("conferencePaper", "citation_conference_title", ("conferenceName",)),
    ("journalArticle", "citation_journal_title", ("publicationTitle", "journalAbbreviation")),
    ("thesis", "citation_dissertation_institution", ("university",)),
    ("report", "citation_technical_report_institution", ("institution",)),
    ("report", "citation_technical_report_number", ("reportNumber",)),
)


def citation_tags(
    docs: DataFrame, attachments: DataFrame, file_url: Sequence[str] = ("", "/download/")
) -> DataFrame:
    """``id, seq, name, value`` rows of citation metadata.

    ``file_url`` is the text before the document id, and between it and the file id.
    """
    # The first file is a minimum, so a record with very many files is no problem.
    pdf = (
        attachments.filter(F.col("data.content_type") == "application/pdf").groupBy("id")
        .agg(F.min(F.struct("child_key", F.col("data.filename").alias("filename"))).alias("pdf"))
    )
    rows = docs.filter(F.col("item_type").isin(*CITED_TYPES)).join(pdf, "id", "left")
    rows = rows.withColumn("f", F.from_json("data", "map<string,string>"))
    field = F.col("f")

    def tag(name: str, value: Column, keep_empty: bool = False) -> Column:
        entry = F.struct(F.lit(name).alias("name"), value.alias("value"))
        if keep_empty:
            value = F.coalesce(value, F.lit(""))
            return F.array(F.struct(F.lit(name).alias("name"), value.alias("value")))
        return F.when(value != "", F.array(entry)).otherwise(
            F.expr("CAST(array() AS array<struct<name:string,value:string>>)")
        )

    authors = F.transform(
        F.filter("creators", lambda c: c["creatorType"] == "author"),
        lambda c: F.struct(F.lit("citation_author").alias("name"),
                           names.display_name(c).alias("value")),
    )
    page_parts = F.split(field["pages"], r"[^\p{L}\p{N}_]*-[^\p{L}\p{N}_]*", 3)
    parts = [
        tag("citation_title", strip(F.coalesce(field["title"], field["shortTitle"])), True),
        tag("citation_publication_date", field["date"], True),
        tag("citation_date", field["date"], True),
        tag("citation_year", F.col("year"), True),
        authors,
        *[tag(f"citation_{n}", field[n]) for n in ("volume", "issue", "language", "publisher")],
        tag("citation_firstpage", strip(F.get(page_parts, F.lit(0)))),
        tag("citation_lastpage", strip(F.get(page_parts, F.lit(1)))),
    ]
    for item_type, name, sources in VENUES:
        venue = strip(F.coalesce(*[field[s] for s in sources]))
        parts.append(tag(name, F.when(F.col("item_type") == item_type, venue)))
    for name in ("ISBN", "ISSN", "DOI"):
        line = F.get(patterns.identifier_lines(field["extra"], name), F.lit(0))
        parts.append(tag(f"citation_{name.lower()}",
                         F.coalesce(F.nullif(field[name], F.lit("")), line)))
    url = F.concat(F.lit(file_url[0]), F.col("id"), F.lit(file_url[1]), F.col("pdf.child_key"),
                   F.lit("/"), F.coalesce("pdf.filename", "id"))
    parts.append(tag("citation_pdf_url", url))
    return rows.select("id", F.posexplode(F.concat(*parts)).alias("seq", "tag")).select(
        "id", "seq", "tag.name", "tag.value"
    )


def display_fields(docs: DataFrame) -> DataFrame:
    """``id, seq, field, label, value`` of the non-empty fields in type order."""
    field = F.from_json("data", "map<string,string>")
    rows = docs.select("id", field.alias("f"), F.posexplode("item_fields").alias("seq", "d"))
    rows = rows.select("id", "seq", F.col("d.field").alias("field"),
                       F.col("d.localized").alias("label"), F.col("f")[F.col("d.field")]
                       .alias("raw")).filter("raw <> ''")
    value = (
        F.when(F.col("field") == "accessDate", dates.format_date(F.col("raw"), convert_tz=True))
        .when(F.col("field").isin(*DATE_FIELDS), dates.format_date(F.col("raw")))
        .when(F.col("field") == "DOI", values.doi_url(F.col("raw")))
        .when(F.col("field") == "extra",
              values.link_doi_lines(text.escape_rich_text(F.col("raw"))))
        .otherwise(text.escape_rich_text(F.col("raw")))
    )
    return rows.select("id", "seq", "field", "label", value.alias("value"))
