"""Pattern searches over text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetlake.functions.paths import none_if_empty
from facetlake.functions.text import BLANK_RUN, strip, strip_markup

# The site and the application that item URIs point to, and what follows them.
LIBRARY_HOST = "zotero.org"
APP_SCHEME = "zotero"
ITEM_PLACES = (rf"https?://(?:www\.)?{re.escape(LIBRARY_HOST)}", f"{APP_SCHEME}://select")
ITEM_OWNERS = ("library", "groups/[0-9]+", "users/[0-9]+")
# The item id is the only group.
ITEM_URI = f"(?:{'|'.join(ITEM_PLACES)})/(?:{'|'.join(ITEM_OWNERS)})/items/([A-Z0-9]+)"
# Neither side may touch anything but white space of any kind.
_INK = "[^" + BLANK_RUN[1:-1]
_ALONE = f"(?<!{_INK}){ITEM_URI}(?!{_INK})"


def _link_target(target: str) -> str:
    """Pattern of a link's opening tag up to its target, which must equal ``target``."""
    return rf"""<a\s[^>]*?(?<=\s)href=["']{target}["']"""


EMPTY = "CAST(array() AS array<string>)"


def find_matches(
    c: Column, pattern: str, group: int = 1, max_matches: int = 1, ignore_case: bool = False,
    multiline: bool = False,
) -> Column:
    """One match as text (empty if none), or the first n / all (0) matches as an array."""
    flags = ("i" if ignore_case else "") + ("m" if multiline else "")
    pattern = (f"(?{flags})" if flags else "") + pattern
    if max_matches == 1:
        return F.coalesce(F.regexp_extract(c, pattern, group), F.lit(""))
    found = F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.expr(EMPTY))
    return F.slice(found, 1, max_matches) if max_matches else found


def find_in_each(values: Column, pattern: str, group: int = 1, max_matches: int = 1) -> Column:
    """R1 over an array: the matches of every element, flattened."""
    def per_value(value: Column) -> Column:
        found = F.regexp_extract_all(value, F.lit(pattern), F.lit(group))
        return F.slice(found, 1, max_matches) if max_matches else found

    present = F.filter(values, lambda v: v.isNotNull())
    return F.coalesce(F.flatten(F.transform(present, per_value)), F.expr(EMPTY))


def split_trim(c: Column, separator: str | None = None, max_split: int = -1) -> Column:
    """R2: split on a literal separator and strip; NULL gives an empty list.

    Without a separator the text is split on runs of white space, none at its ends.
    """
    limit = max_split + 1 if max_split >= 0 else -1
    if separator is None:
        parts = F.filter(F.split(strip(c), BLANK_RUN, limit), lambda v: v != "")
    else:
        parts = F.split(c, "\\Q" + separator + "\\E", limit)
    return F.coalesce(F.transform(parts, strip), F.expr(EMPTY))


def item_ids_in_uris(uris: Column) -> Column:
    """At most one item id per URI of a list."""
    return find_in_each(uris, _ALONE, 1, 1)


def item_ids_in_text(c: Column) -> Column:
    """Item ids of URIs standing alone in running text."""
    return find_matches(c, _ALONE, 1, 0)


def item_ids_in_links(c: Column) -> Column:
    """Item ids of URIs in ``href`` attributes."""
    return find_matches(c, _link_target(ITEM_URI), 1, 0)


def linked_item_ids(note: Column) -> Column:
    """Ids cited by a note, in links or in its visible text."""
    visible = strip_markup(F.regexp_replace(note, r"<br\s*/>", "\n"))
    return F.array_union(item_ids_in_links(note), item_ids_in_text(visible))


def hrefs(c: Column) -> Column:
    """All link targets of a page."""
    return find_matches(c, _link_target("""([^"']*)"""), 1, 0)


def identifier_lines(c: Column, names: str = "DOI|ISBN|ISSN") -> Column:
    """Values of ``NAME: value`` lines in a free text field."""
    line = rf"^\s*(?:{names}):\s*(\S+)\s*$"
    return find_matches(c, line, 1, 0, ignore_case=True, multiline=True)


def alternate_ids(
    doi: Column, isbn: Column, issn: Column, extra: Column, replaced_uris: Column
) -> Column:
    """Secondary identifiers of an item, NULL if it has none."""
    single = F.filter(F.array(doi, isbn, issn), lambda v: v.isNotNull() & (v != ""))
    every = F.flatten(
        F.array(single, identifier_lines(extra), item_ids_in_uris(replaced_uris))
    )
    return none_if_empty(every)
