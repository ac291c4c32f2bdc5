"""Porter2 stems as SQL, written from the published rules: the oracle of stemmed text."""

from __future__ import annotations

_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_STOP = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
          "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism",
          "ate", "iti", "ous", "ive", "ize", "ion")
_SHORT = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
_VC = "^.*?[aeiouy][^aeiouy]"


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def _ending(source: str, target: str, endings, result: str) -> str:
    """A step that finds the longest of ``endings``; ``result`` is made of ``w, e, base``."""
    return f"""
{target} AS (
  SELECT word, whole, done, r1, r2, CASE WHEN done THEN w ELSE {result} END AS w
  FROM (SELECT *, substr(w, 1, length(w) - length(e)) AS base
        FROM (SELECT *, regexp_extract(w, '({"|".join(endings)})$') AS e FROM {source})))"""


def stems_sql(words: str) -> str:
    """CTEs that end in ``stems(word, stem)`` for the distinct words of table ``words(word)``."""
    return f"""
st_marked AS (
  SELECT word, {_map(_WHOLE)}[lower(word)] AS whole, length(word) <= 2 AS done,
         regexp_replace(regexp_replace(lower(word), '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w
  FROM (SELECT DISTINCT word FROM {words})),
st_first AS (
  SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)')
                 THEN length(regexp_extract(w, '^(gener|commun|arsen)'))
                 WHEN regexp_matches(w, '{_VC}') THEN length(regexp_extract(w, '{_VC}'))
                 ELSE length(w) END AS r1 FROM st_marked),
st_0 AS (
  SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{_VC}')
                 THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{_VC}'))
                 ELSE length(w) END AS r2 FROM st_first),
st_1a AS (
  SELECT word, whole, done OR w IN ({_list(_STOP)}) AS done, r1, r2, w FROM (
    SELECT word, whole, done, r1, r2, CASE WHEN done THEN w
      WHEN w LIKE '%sses' THEN substr(w, 1, length(w) - 2)
      WHEN w LIKE '%ied' OR w LIKE '%ies'
        THEN substr(w, 1, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
      WHEN regexp_matches(w, '[^us]s$') AND regexp_matches(w, '[aeiouy].+s$')
        THEN substr(w, 1, length(w) - 1)
      ELSE w END AS w FROM st_0)),{_ending("st_1a", "st_1b", ("eedly", "ingly", "edly", "eed", "ing", "ed"), f"""
    CASE WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(base) >= r1 THEN base || 'ee' ELSE w END
         WHEN e = '' OR NOT regexp_matches(base, '[aeiouy]') THEN w
         WHEN regexp_matches(base, '(at|bl|iz)$') THEN base || 'e'
         WHEN regexp_matches(base, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')
           THEN substr(base, 1, length(base) - 1)
         WHEN length(base) <= r1 AND regexp_matches(base, '{_SHORT}') THEN base || 'e'
         ELSE base END""")},
st_1c AS (
  SELECT word, whole, done, r1, r2, CASE WHEN NOT done AND regexp_matches(w, '.[^aeiouy][yY]$')
    THEN substr(w, 1, length(w) - 1) || 'i' ELSE w END AS w FROM st_1b),{
    _ending("st_1c", "st_2", sorted(_STEP2, key=len, reverse=True), f"""
    CASE WHEN e = '' OR length(base) < r1 THEN w
         WHEN e = 'ogi' AND base NOT LIKE '%l' THEN w
         WHEN e = 'li' AND NOT regexp_matches(base, '[cdeghkmnrt]$') THEN w
         ELSE base || {_map(_STEP2)}[e] END""")},{
    _ending("st_2", "st_3", sorted(_STEP3, key=len, reverse=True), f"""
    CASE WHEN e = '' OR length(base) < r1 OR (e = 'ative' AND length(base) < r2) THEN w
         ELSE base || {_map(_STEP3)}[e] END""")},{
    _ending("st_3", "st_4", sorted(_STEP4, key=len, reverse=True), """
    CASE WHEN e = '' OR length(base) < r2 OR (e = 'ion' AND NOT regexp_matches(base, '[st]$'))
         THEN w ELSE base END""")},
stems AS (
  SELECT word, coalesce(whole, lower(CASE WHEN done THEN w
    WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(
      substr(w, 1, length(w) - 1), '{_SHORT}'))) THEN substr(w, 1, length(w) - 1)
    WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN substr(w, 1, length(w) - 1)
    ELSE w END)) AS stem FROM st_4)"""
