"""Text normalisation as native column expressions."""

from __future__ import annotations

import html
import html.entities
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetlake.functions.paths import evaluate_once

# Joins the parts of a multi-part text; it is a token of its own, so phrases stop at it.
RECORD_SEPARATOR = "\x1e"

# Java's \w is ASCII only, hence explicit Unicode letters and numbers.
WORD = r"\p{L}\p{N}_"
_LONE_DOT = rf"(?<![{WORD}])\.|\.(?![{WORD}])"
BLANK_RUN = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def strip(c: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(c, f"^{BLANK_RUN}|{BLANK_RUN}$", "")


def is_blank(c: Column) -> Column:
    """Whether a text is NULL or holds white space only."""
    return F.coalesce(strip(c), F.lit("")) == ""


def _accent_pairs() -> tuple[str, str]:
    """Lower-case Latin letters that decompose to an ASCII letter plus marks."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = unicodedata.normalize("NFD", char)[0]
        if char == char.lower() and char != base and base.isascii() and base.isalpha():
            source.append(char)
            target.append(base)
    # Letters without a decomposition.
    source += "ßøđħłŧı"
    target += "sodhlti"
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _accent_pairs()
_FOLD_TABLE = str.maketrans(FOLD_FROM, FOLD_TO)


def fold_accents(c: Column) -> Column:
    """Lower-case and strip accents."""
    return F.translate(F.lower(c), FOLD_FROM, FOLD_TO)


def fold_word(word: str) -> str:
    """Driver-side twin of :func:`fold_accents` for query words."""
    return word.lower().translate(_FOLD_TABLE)


def tokenize(c: Column, keep_separator: bool = True) -> Column:
    """Words, where one dot may join word characters, plus the record separator.

    Dots that join nothing are blanked first, so that the extraction is one plain character
    class: a nested repetition would recurse per dotted part and overflow on hostile input.
    """
    cleaned = F.regexp_replace(c, _LONE_DOT, " ")
    alternatives = rf"[{WORD}.]+" + (r"|\x1e" if keep_separator else "")
    return F.regexp_extract_all(cleaned, F.lit(alternatives), F.lit(0))


def sort_key_text(c: Column, terminated: bool = False) -> Column:
    """T4: comparable form of a display text: markup removed, folded words joined by a blank."""
    return normalize_words(strip_markup(c, terminated))


def normalize_words(c: Column) -> Column:
    """Folded words joined by one blank (the ordering used for facet labels and tags)."""
    return F.array_join(tokenize(fold_accents(c), keep_separator=False), " ")


def slug(c: Column, delimiter: str = "-") -> Column:
    """T5: folded letter/number runs joined by a delimiter."""
    return F.array_join(
        F.regexp_extract_all(fold_accents(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), delimiter
    )


def id_key(c: Column) -> Column:
    """Whole value folded."""
    return fold_accents(c)


# --- markup -----------------------------------------------------------------------------

# A reference is a number or a name; HTML5 lets some of both end without a semicolon.
_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)"
_TERMINATED = _ENTITY.replace(";?", ";")
# References that plain replacement handles; the ampersand must come last.
_COMMON = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"),
           ("&nbsp;", "\xa0"), ("&amp;", "&")]
_NOT_COMMON = r"&(?!(?:lt|gt|quot|#34|#39|nbsp|amp);)"

# The names of HTML5, as one constant: control characters separate names from characters.
_NAMED = "\x1d".join(f"&{name}\x1f{chars}" for name, chars in html.entities.html5.items())
# Names that need no semicolon, longest first: the longest beginning of a word counts.
_OPEN_NAMES = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")),
                              key=len, reverse=True))
# Codes that stand for another character, such as 128 to 159 of Windows-1252, or for none.
_SPECIAL = "\x1d".join(
    f"{code}\x1f{html.unescape(f'&#{code};')}" for code in range(160)
    if html.unescape(f"&#{code};") != chr(code))
_UNPRINTED = "|".join(
    f"{code}" for code in (*range(0xFDD0, 0xFDF0), *(p * 0x10000 + e for p in range(17)
                                                     for e in (0xFFFE, 0xFFFF))))


def _of_number(hexed: Column, decimal: Column) -> Column:
    """The character of a numeric reference of any number of digits."""
    digits = F.when(hexed != "", F.upper(F.regexp_replace(hexed, "^0+(?=.)", ""))).when(
        decimal != "", F.regexp_replace(decimal, "^0+(?=.)", ""))
    # Seven decimal or six hexadecimal digits hold every code point.
    short = F.length(digits) <= F.when(hexed != "", 6).otherwise(7)
    code = F.when(short, F.when(hexed != "", F.conv(digits, 16, 10)).otherwise(digits)).cast("long")
    listed = F.try_element_at(
        F.str_to_map(F.lit(_SPECIAL), F.lit("\x1d"), F.lit("\x1f")), code.cast("string"))
    usable = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    named = F.when(code.cast("string").rlike(f"^(?:{_UNPRINTED})$"), F.lit("")).otherwise(char)
    return F.when(digits.isNotNull(), F.coalesce(
        listed, F.when(usable, named), F.lit("\ufffd")))


def _decode_entity(entity: Column, terminated: bool) -> Column:
    table = F.str_to_map(F.lit(_NAMED), F.lit("\x1d"), F.lit("\x1f"))
    number = _of_number(F.regexp_extract(entity, r"^&#[xX]([0-9a-fA-F]+);?$", 1),
                        F.regexp_extract(entity, r"^&#([0-9]+);?$", 1))
    if terminated:
        return F.coalesce(number, F.try_element_at(table, entity), entity)
    begun = F.regexp_extract(entity, f"^&(?:{_OPEN_NAMES})", 0)
    open_name = F.when(begun != "", F.concat(
        F.try_element_at(table, begun), F.substr(entity, F.length(begun) + 1)))
    return F.coalesce(number, F.try_element_at(table, entity), open_name, entity)


def unescape_entities(c: Column, terminated: bool = False) -> Column:
    """Character references to characters, each decoded once; with ``terminated`` only those that
    end with a semicolon."""
    return evaluate_once(c, lambda text: _unescaped(text, terminated))


def _unescaped(c: Column, terminated: bool) -> Column:
    simple, pattern = c, _TERMINATED if terminated else _ENTITY
    for entity, char in _COMMON:
        simple = F.replace(simple, F.lit(entity), F.lit(char))
    # Limit -1 keeps trailing empty pieces, so pieces = entities + 1.
    pieces = F.split(c, pattern, -1)
    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)),
                        lambda entity: _decode_entity(entity, terminated))
    general = F.array_join(
        F.flatten(
            F.zip_with(pieces, found, lambda p, e: F.array(p, F.coalesce(e, F.lit(""))))
        ),
        "",
    )
    return F.when(c.rlike(_NOT_COMMON + pattern[1:]), general).otherwise(simple)


def strip_markup(c: Column, terminated: bool = False) -> Column:
    """Comments and tags removed, blanks collapsed, entities decoded.

    As in HTML5, some names count without a semicolon, also where the removal of a tag makes one
    run on; ``terminated`` leaves those as they are, for texts that may be cut within one.
    """
    bare = F.regexp_replace(c, r"(?s)<!(?=--).*?-->", "")
    bare = F.regexp_replace(bare, "<[^>]*>", "")
    return unescape_entities(F.trim(F.regexp_replace(bare, BLANK_RUN, " ")), terminated)


# The rich text that titles and names may hold, as written inside the angle
# brackets. A span counts only together with its end.
_RICH_TAGS = ("i", "/i", "b", "/b", "sub", "/sub", "sup", "/sup")
_RICH_SPANS = ('span class="nocase"', 'span style="font-variant:small-caps;"')
_SPAN_END = "/span"
# Everything between two angle brackets, or the text up to the next one.
_PIECE = "<[^<>]*>|[^<]+|<"
_REFERENCES = {"&": "&amp;", ">": "&gt;", "<": "&lt;", "'": "&#39;", '"': "&#34;"}


def _inside(piece: Column) -> Column:
    """What a tag holds, with single blanks and none beside an equals sign, a quote or a slash
    or before a colon; NULL for anything else."""
    inside = F.regexp_replace(F.substring(piece, F.lit(2), F.length(piece) - 2), BLANK_RUN, " ")
    inside = F.regexp_replace(inside, ' ?(["=]) ?', "$1")
    inside = F.btrim(F.replace(F.regexp_replace(inside, "^/ ", "/"), F.lit(" :"), F.lit(":")))
    return F.when(F.startswith(piece, F.lit("<")) & F.endswith(piece, F.lit(">")), inside)


def _closed_spans(tags: Column) -> Column:
    """Places of the spans of rich text that have an end, and of those ends."""
    places = F.filter(
        F.transform(tags, lambda t, i: F.struct(i.alias("at"), (t == _SPAN_END).alias("end"),
                                                t.isin(*_RICH_SPANS, _SPAN_END).alias("span"))),
        lambda e: e["span"])
    none = F.expr("CAST(array() AS array<int>)")

    def step(state: Column, event: Column) -> Column:
        depth = F.size(state["open"])
        return F.when(~event["end"], F.struct(
            F.concat(state["open"], F.array(event["at"])).alias("open"),
            state["closed"].alias("closed"),
        )).when(depth > 0, F.struct(
            F.slice(state["open"], F.lit(1), depth - 1).alias("open"),
            F.concat(state["closed"], F.array(F.get(state["open"], depth - 1), event["at"]))
            .alias("closed"),
        )).otherwise(state)

    start = F.struct(none.alias("open"), none.alias("closed"))
    return F.aggregate(places, start, step, lambda state: state["closed"])


def _rewritten(c: Column, rich: Callable[[Column], Column],
               literal: Callable[[Column], Column]) -> Column:
    """The text with ``rich`` applied to the insides of its rich text tags and ``literal`` to all
    other pieces."""
    def whole(pieces: Column) -> Column:
        return evaluate_once(F.transform(pieces, _inside), lambda tags: evaluate_once(
            _closed_spans(tags), lambda closed: F.array_join(F.zip_with(
                pieces, F.transform(tags, lambda t, i: F.when(
                    t.isin(*_RICH_TAGS) | F.array_contains(closed, i), t)),
                lambda piece, tag: F.when(tag.isNotNull(), rich(tag)).otherwise(literal(piece)),
            ), "")))

    pieces = F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0))
    return F.when(F.contains(c, F.lit("<")), evaluate_once(pieces, whole)).otherwise(literal(c))


def strip_rich_text(c: Column) -> Column:
    """Remove only the rich text elements; any other markup is literal text."""
    return _rewritten(c, lambda tag: F.lit(""), lambda piece: piece)


def _escaped(piece: Column) -> Column:
    for char, reference in _REFERENCES.items():
        piece = F.replace(piece, F.lit(char), F.lit(reference))
    return piece


def escape_rich_text(c: Column) -> Column:
    """All markup characters as references, but for those of the rich text elements."""
    return _rewritten(c, lambda tag: F.concat(F.lit("<"), tag, F.lit(">")), _escaped)


def abstract_snippet(c: Column, length: int, leeway: int = 0, end: str = "...") -> Column:
    """Whole text when short enough, else cut at the last blank before ``length``."""
    head = F.substring(c, 1, max(length - len(end), 0))
    cut = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    cut = F.when(F.instr(head, " ") > 0, cut).otherwise(head)
    text = F.when(F.length(c) <= length + leeway, c).otherwise(F.concat(cut, F.lit(end)))
    return F.when(~is_blank(c), text if length > 0 else c)
