from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from facetlake.functions import dates, languages, names, paths, patterns, text, values
from facetlake.functions.patterns import APP_SCHEME, LIBRARY_HOST
from facetlake.functions.stemming import stem, stem_terms

C = F.col("c")
SEP = text.RECORD_SEPARATOR


@pytest.mark.parametrize("given, expected", [
    ("Ada's 3.14 e.g. x..y .z", ["Ada", "s", "3.14", "e.g", "x", "y", "z"]),
    (f"été_2{SEP}Ωmega", ["été_2", SEP, "Ωmega"]),
    ("...", []),
    (".".join(["ab"] * 20000), [".".join(["ab"] * 20000)]),
])
def test_tokenize(value, given, expected):
    assert value(text.tokenize(C), c=given) == expected


def test_folding_and_keys(value):
    assert value(text.fold_accents(C), c="ÉCOLE Straße Ñandú") == "ecole strase nandu"
    assert text.fold_word("École") == "ecole"
    assert value(text.slug(C), c="L'été_à  Paris!") == "l-ete-a-paris"
    assert value(text.id_key(C), c="É-1 b") == "e-1 b"
    assert value(text.sort_key_text(C), c="<i>The</i> Émile &amp; co.") == "the emile co"


@pytest.mark.parametrize("given, expected", [
    ("a<!-- <b> --> c", "a c"),
    ("<!-->x", "x"),
    ("&lt;b&gt; &amp;lt; &eacute;&#233;&#xE9; &unknown; &amp;", "<b> &lt; ééé &unknown; &"),
    ("<p>one</p>\n\t two", "one two"),
    ("1 < 2", "1 < 2"),
    ("&#x1F600; &#xD800; &#0065;", "😀 \ufffd A"),
    ("tail &eacute;", "tail é"),
])
def test_strip_markup(value, given, expected):
    assert value(text.strip_markup(C), c=given) == expected


@pytest.mark.parametrize("given, html5, terminated", [
    ("cut&amp</p><b>p{", "cut&p{", "cut&ampp{"),
    ("&amp; &copy; &amplt; &eacute;&eacute &#233;&#233", "& © &lt; éé éé", "& © &amplt; é&eacute é&#233"),
    ("a &amp;lt; &quo", "a &lt; &quo", "a &lt; &quo"),
])
def test_references_without_semicolon(value, given, html5, terminated):
    assert value(text.strip_markup(C), c=given) == html5
    assert value(text.strip_markup(C, terminated=True), c=given) == terminated


def test_rich_text(value):
    caps = '<span style="font-variant:small-caps;">A <i>b</i></span>'
    assert value(text.strip_rich_text(C), c=caps + '<em>c</em><span class="nocase">d</span>') == (
        "A b<em>c</em>d"
    )
    assert value(text.escape_rich_text(C), c=caps) == caps
    assert value(text.escape_rich_text(C), c="<em>'x' & \"y\"</em><sub>2</sub>") == (
        "&lt;em&gt;&#39;x&#39; &amp; &#34;y&#34;&lt;/em&gt;<sub>2</sub>"
    )


@pytest.mark.parametrize("given, stripped, escaped", [
    (None, None, None),
    ("", "", ""),
    ("no markup & more", "no markup & more", "no markup &amp; more"),
    ("a < d > c", "a < d > c", "a &lt; d &gt; c"),
    ("<a<b>x</ b >", "<ax", "&lt;a<b>x</b>"),
    ("< sup >2</sup><P>", "2<P>", "<sup>2</sup>&lt;P&gt;"),
    ('<span  class = " nocase ">a<span>b</span>c</span>', "a<span>bc</span>",
     '<span class="nocase">a&lt;span&gt;b</span>c&lt;/span&gt;'),
    ('<span class="nocase">a<span style="font-variant :small-caps;">b</span>c</ span>', "abc",
     '<span class="nocase">a<span style="font-variant:small-caps;">b</span>c</span>'),
    ('<span class="nocase">open', '<span class="nocase">open',
     "&lt;span class=&#34;nocase&#34;&gt;open"),
    ('x</span><span class="no case">y</span>', 'x</span><span class="no case">y</span>',
     "x&lt;/span&gt;&lt;span class=&#34;no case&#34;&gt;y&lt;/span&gt;"),
    ("&lt;i&gt;<i\n>z</i>", "&lt;i&gt;z", "&amp;lt;i&amp;gt;<i>z</i>"),
])
def test_rich_text_pieces(value, given, stripped, escaped):
    assert value(text.strip_rich_text(C.cast("string")), c=given) == stripped
    assert value(text.escape_rich_text(C.cast("string")), c=given) == escaped


def test_snippet(value):
    assert value(text.abstract_snippet(C, 12), c="one two three four") == "one two..."
    assert value(text.abstract_snippet(C, 12, 6), c="one two three four") == "one two three four"
    assert value(text.abstract_snippet(C, 0), c="anything") == "anything"
    assert value(text.abstract_snippet(C, 12), c="   ") is None


@pytest.mark.parametrize("given, expected", [
    ("2020-03-09", (2020, 3, 9)), ("2020-03", (2020, 3, 0)), ("2020", (2020, 0, 0)),
    ("2020-13-45x", (2020, 13, 45)), ("spring 2020", (0, 0, 0)), ("", (0, 0, 0)),
])
def test_partial_date(value, given, expected):
    assert tuple(value(dates.partial_date(C), c=given)) == expected


@pytest.mark.parametrize("given, expected", [
    ((0, 0, 0), (2023, 2, 14)), ((2020, 0, 0), (2020, 12, 31)), ((2020, 2, 0), (2020, 2, 29)),
    ((2023, 0, 0), (2023, 2, 14)), ((2023, 2, 0), (2023, 2, 14)), ((2023, 1, 0), (2023, 1, 31)),
    ((2021, 5, 6), (2021, 5, 6)),
])
def test_maximize_date(value, given, expected):
    parts = F.struct(*[F.lit(v).alias(n) for v, n in zip(given, ("year", "month", "day"))])
    assert tuple(value(dates.maximize_date(parts, F.lit(date(2023, 2, 14))))) == expected


def test_filter_date(value):
    as_of = F.lit(date(2023, 2, 14))
    def found(parsed, added):
        return value(dates.filter_date(F.lit(parsed), F.lit(added), as_of))
    assert found("2020-02", "2021-01-01T00:00:00Z") == datetime(2020, 2, 29)
    assert found("2020-02-31", "2021-01-01T10:00:00Z") == datetime(2021, 1, 1, 10)
    assert found(None, "2021-01-01T10:00:00Z") == datetime(2021, 1, 1, 10)
    assert found(None, "2021-01-01") is None


def test_years(value):
    assert value(dates.year_of(C), c="1987-05") == "1987"
    assert value(dates.year_of(C), c="soon") == "0"
    assert value(dates.year_of(F.lit(None).cast("string"))) is None
    assert value(dates.year_path(C), c="1987-05") == [
        ["1900"], ["1900", "1980"], ["1900", "1980", "1987"]]
    assert value(dates.sort_date(C), c="1987-05") == 19870500
    assert value(dates.sort_date(F.lit(None).cast("string"))) == 0
    def label(*path):
        return value(dates.year_path_label(F.array(*map(F.lit, path)), 2023))
    assert label("1900") == "Between 1900 and 1999"
    assert label("2000", "2020") == "Between 2020 and 2023"
    assert label("2000", "2020", "2021") == "2021"


@pytest.mark.parametrize("given, options, expected", [
    ("1999", {}, "1999"), ("3 May 1999", {"convert_tz": True}, "3 May 1999"),
    ("1999-05-03T04:05:06+00:00", {}, "5/3/99, 4:05 AM"),
    ("1999-05-03T14:05:06.5Z", {}, "5/3/99, 2:05 PM"),
    ("1999-05-03T14Z", {}, "5/3/99, 2:00 PM"),
    ("1999-05-03T14:05:06-0300", {}, "5/3/99, 2:05 PM"),
    ("1999-05-03T14:05:06-0300", {"convert_tz": True, "show_tz": True}, "5/3/99, 5:05 PM (UTC)"),
    ("1999-05-03T14:05:06-0300", {"show_tz": True}, "5/3/99, 2:05 PM (UTC-03:00)"),
    ("1999-05-03T14:05Z", {"convert_tz": True, "zone": "Asia/Tokyo"}, "5/3/99, 11:05 PM"),
])
def test_format_date(value, given, options, expected):
    assert value(dates.format_date(C, **options), c=given) == expected


def test_patterns(value):
    assert value(patterns.find_matches(C, r"(\d+)"), c="a1b22") == "1"
    assert value(patterns.find_matches(C, r"(\d+)"), c="none") == ""
    assert value(patterns.find_matches(C, r"(\d+)", max_matches=0), c="a1b22") == ["1", "22"]
    assert value(patterns.find_in_each(F.array(F.lit("a1b2"), F.lit("x"), F.lit("c3")),
                                       r"(\d)")) == ["1", "3"]
    assert value(patterns.split_trim(C, ";", 1), c=" a ; b ; c") == ["a", "b ; c"]
    assert value(patterns.split_trim(F.lit(None).cast("string"), ";")) == []
    assert value(patterns.identifier_lines(C), c="note\n doi: 10.1/x \nISBN: 978\nDOI: a b") == [
        "10.1/x", "978"]


def test_item_uris(value):
    group = f"https://www.{LIBRARY_HOST}/groups/12/items/ABCD1234"
    app = f"{APP_SCHEME}://select/library/items/EFGH5678"
    uris = F.array(F.lit(group), F.lit("http://other.example/items/X"), F.lit(app))
    assert value(patterns.item_ids_in_uris(uris)) == ["ABCD1234", "EFGH5678"]
    note = f'<p>See {group}<br/>{app}</p> <a class="x" href="{app[:-1]}9">l</a> {group}x'
    assert set(value(patterns.linked_item_ids(C), c=note)) == {
        "ABCD1234", "EFGH5678", "EFGH5679"}


def test_values(value):
    assert value(values.doi_url(C), c="10.1/x") == "https://doi.org/10.1/x"
    assert value(values.doi_url(C), c="HTTP://doi.org/1") == "HTTP://doi.org/1"
    assert value(values.url_is_valid(C), c="not a url") is False
    assert value(values.url_host(C), c="https://Www.Example.ORG:80/x") == "www.example.org"
    assert value(values.has_url(F.lit(None).cast("string"))) is False
    empty = F.expr("CAST(array() AS array<string>)")
    assert value(values.merge_values(empty, values.as_list(F.lit("")))) is None
    assert value(values.json_value(C, "k", "int"), c="{broken") is None


def creators(*rows):
    kinds = ("creatorType", "firstName", "lastName", "name")
    return F.array(*[
        F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(kinds, row)]) for row in rows
    ])


def test_creators(value):
    people = creators(("editor", "Zoé", "Ábel", None), ("author", None, None, "The <i>Group</i>"),
                      ("author", "Ann", "Lee", None), ("author", "Solo", None, None))
    assert value(names.creator_names(people)).split(SEP) == [
        "Zoé Ábel", "Ábel, Zoé", "The Group", "Ann Lee", "Lee, Ann", "Solo"]
    order = F.array(F.lit("author"), F.lit("editor"))
    assert value(names.creator_sort_key(people, order)) == (
        "the group zzzzzz lee zzz ann zzzzzz solo")
    assert value(names.creator_sort_key(creators(("editor", "A", "B", None)), order)) == "b zzz a"
    assert value(names.creator_names(F.expr("CAST(array() AS array<struct<creatorType:string,"
                                            "firstName:string,lastName:string,name:string>>)"))) is None
    assert value(names.display_name(people[2])) == "Lee, Ann"


@pytest.mark.parametrize("given, options, expected", [
    ("", {}, None), (" ;; ", {}, None), ("nl", {}, [("nld", "Dutch")]),
    ("nl_BE", {}, [("nld", "Dutch")]), (" Nld ", {}, [("nld", "Dutch")]),
    ("DUTCH", {}, [("nld", "Dutch")]), ("cze", {}, [("ces", "Czech")]),
    ("Low speech", {}, [("low speech", "Low Speech")]), ("qq_AB", {}, [("qq_ab", "Qq_Ab")]),
    ("Low speech", {"allow_invalid": False}, None),
    ("Low speech", {"normalize_invalid": F.upper}, [("low speech", "LOW SPEECH")]),
    ("pol;dut ; tr", {}, [("pol", "Polish"), ("nld", "Dutch"), ("tur", "Turkish")]),
    ("pol / ell", {"separator": "[, /]"}, [("pol", "Polish"), ("ell", "Modern Greek (1453-)")]),
    ("pl; Polish; pl-PL; pol", {}, [("pol", "Polish")]),
    ("ja; nowhere; kor", {"allow_invalid": False}, [("jpn", "Japanese"), ("kor", "Korean")]),
    ("pl", {"translations": {"Polish": "Polnisch"}}, [("pol", "Polnisch")]),
    ("pl; ja; pl", {"normalize": False}, [("pl", "pl"), ("ja", "ja")]),
])
def test_languages(value, given, options, expected):
    found = value(languages.normalize_language(C, **options), c=given)
    assert (None if found is None else [tuple(p) for p in found]) == expected


def test_languages_beyond_the_common_ones(spark, value):
    known = languages.known_languages(spark)
    found = value(languages.normalize_language(C, languages=known), c="ceb; Cebuano; el; gre; Klingonish")
    assert [tuple(p) for p in found] == [
        ("ceb", "Cebuano"), ("ell", "Modern Greek (1453-)"), ("klingonish", "Klingonish")]
    assert len({row[0] for row in known}) == len(known)


def test_paths(value):
    abc = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    ab, a = F.slice(abc, 1, 2), F.slice(abc, 1, 1)
    assert value(paths.path_prefixes(abc)) == [["a"], ["a", "b"], ["a", "b", "c"]]
    assert value(paths.path_prefixes(F.slice(abc, 1, 0))) == []
    assert value(paths.is_ancestor(ab, abc)) and not value(paths.is_ancestor(abc, abc))
    assert value(paths.parent_path(ab)) == ["a"] and value(paths.parent_path(a)) is None
    assert value(paths.starts_with_path(abc, ab))


# Samples of the vocabulary published with the algorithm.
STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consist": "consist",
    "consistency": "consist", "consistently": "consist", "consolation": "consol",
    "consolatory": "consolatori", "conspicuously": "conspicu", "conspiracy": "conspiraci",
    "knack": "knack", "knavish": "knavish", "kneeling": "kneel", "knightly": "knight",
    "knitting": "knit", "knives": "knive", "knocked": "knock", "knots": "knot",
    "generously": "generous", "communication": "communic", "skies": "sky", "dying": "die",
    "hopping": "hop", "hoping": "hope", "ties": "tie", "cries": "cri", "gas": "gas",
    "this": "this", "relational": "relat", "vietnamization": "vietnam", "happily": "happili",
    "proceed": "proceed", "agreed": "agre", "feed": "feed", "boy": "boy", "says": "say",
}


def test_stemming(spark):
    assert {w: stem(w) for w in STEMS} == STEMS
    rows = spark.createDataFrame([(w,) for w in [*STEMS, None]], "w string")
    assert {r["w"]: r["s"] for r in rows.select("w", stem_terms("w").alias("s")).collect()} == {
        **STEMS, None: None}


@pytest.mark.parametrize("space", ["\u00a0", "\u2003", "\u3000", "\x1f", "\u0085", "\n"])
def test_item_links_between_blanks_of_any_kind(value, space):
    uri = f"https://www.{patterns.LIBRARY_HOST}/groups/12/items/ABCD2345"
    assert value(patterns.item_ids_in_text(C), c=f"see{space}{uri}{space}there") == ["ABCD2345"]
    assert value(patterns.item_ids_in_text(C), c=f"see{space}({uri}){space}there") == []
