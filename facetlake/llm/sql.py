"""Comparison SQL of the operators' queries."""

from __future__ import annotations

LISTING_RE = r"(?i)\b(stupid|trash|worthless|disgusting|scum)\b"

_HOST = r"lower(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1))"
_PATH = r"regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^?#]*\?([^#]*)', 1)"

URL_FILTER = rf"""
WITH parsed AS (
  SELECT page_id, html, {_HOST} AS host, {_PATH} AS path,
         list_sort(list_filter(string_split({_QUERY}, '&'),
                               lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS kept
  FROM pages),
named AS (
  SELECT *, host || regexp_replace(path, '/+$', '')
         || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical
  FROM parsed),
listed AS (
  SELECT DISTINCT canonical AS entry FROM named
  WHERE canonical <> '' AND regexp_matches(html, '{LISTING_RE}')),
ruled AS (
  SELECT page_id, host, path, canonical, entry IS NOT NULL AS listed,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com'))
              AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com'))
              AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/')
           THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/')
           THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/')
           THEN 'com/' END AS rule
  FROM named LEFT JOIN listed ON canonical = entry)
SELECT page_id, host, path, rule, canonical, listed AND canonical <> '' AS listed,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
       WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def _jump(n_shards: int) -> str:
    """Chain of jumps as nested queries: one level per possible jump."""
    level = "SELECT doc_id, -1::BIGINT AS landed, 0::BIGINT AS jump, CAST(doc_id AS HUGEINT) AS k FROM documents"
    for _ in range(n_shards):
        level = (
            "SELECT doc_id, CASE WHEN jump < {n} THEN jump ELSE landed END AS landed,"
            " CASE WHEN jump < {n} THEN CAST(floor((jump + 1) * (2147483648.0::DOUBLE /"
            " ((nk // 8589934592) + 1)::DOUBLE)) AS BIGINT) ELSE jump END AS jump, nk AS k"
            " FROM (SELECT *, CAST((k::UHUGEINT * 2862933555777941757 + 1)"
            " % 18446744073709551616 AS HUGEINT) AS nk FROM ({inner}))"
        ).format(n=n_shards, inner=level)
    return f"SELECT doc_id, landed FROM ({level})"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes: eight shifts per byte."""
    return f"""(SELECT xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
      lambda acc, b: {_shifts()}), 4294967295)
      FROM (SELECT hex(encode({text})) AS h))"""


def _shifts() -> str:
    value = "xor(acc, b)"
    for _ in range(8):
        value = f"list_transform([{value}], lambda v: xor(v >> 1, (v & 1) * 3988292384))[1]"
    return value


def jump_shards(n_shards: int) -> str:
    return f"""
WITH now AS ({_jump(n_shards)}), grown AS ({_jump(n_shards + 1)})
SELECT d.doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
       {_crc32("coalesce(text, '')")} AS text_crc32, 'key' AS law, CAST(now.landed AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY now.landed ORDER BY d.doc_id) - 1 AS slot,
       CAST(grown.landed AS INTEGER) AS grown_shard
FROM documents d JOIN now ON d.doc_id = now.doc_id JOIN grown ON d.doc_id = grown.doc_id
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
shingled AS (
  SELECT doc_id, CASE
    WHEN len(words) >= 5 THEN list_distinct(list_transform(
      range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles
  FROM worded),
members AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS s FROM shingled),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS i
  FROM members x JOIN members y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * i >= 75 * (na + nb - i)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, len(shingles) AS n_shingles, component_id, doc_id = component_id AS kept
FROM shingled JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON doc_id = a
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spoken(table: str, key: str) -> str:
    """Lower-cased words of a table's texts."""
    return f"""SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM {table}"""


CONTAMINATION = f"""
WITH docs AS (SELECT *, row_number() OVER () AS r FROM ({_spoken("documents", "doc_id")})),
items AS ({_spoken("benchmark", "item_id")}),
sized AS (SELECT item_id, words, least(10, len(words)) AS m FROM items WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(words, i, i + m - 1), ' ') AS w
  FROM (SELECT item_id, m, words, unnest(range(1, len(words) - m + 2)) AS i FROM sized)),
places AS (
  SELECT r, i, m, array_to_string(list_slice(words, i, i + m - 1), ' ') AS w
  FROM (SELECT r, m, words, unnest(range(1, len(words) - m + 2)) AS i
        FROM docs, (SELECT DISTINCT m FROM windows))),
found AS (SELECT r, i, places.m, item_id FROM places JOIN windows ON places.m = windows.m AND places.w = windows.w),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM found) GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM found GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""


def _leaf_text(text: str) -> str:
    """Each column as its byte count, colon and value, or ``-``."""
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return " || ".join(
        f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values)


# A node's children are up to three neighbours; lists hold a level of a tree.
_PARENTS = """list_transform(range(0, (len(l) + 2) // 3),
    lambda i: sha256(array_to_string(list_slice(l, 3 * i + 1, 3 * i + 3), '')))"""


def _siblings(place: str) -> str:
    """The others of the run of the node at ``place`` of the level ``l``, left and right."""
    run = f"3 * ({place} // 3)"
    return (f"list_slice(l, {run} + 1, {place}) AS lefts, "
            f"list_slice(l, {place} + 2, {run} + 3) AS rights")


MERKLE_MANIFEST = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, source, sha256({_leaf_text("text")}) AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0
      THEN sha256({_leaf_text("replace(text, chr(10), '')")}) ELSE sha256({_leaf_text("text")}) END AS claim
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    row_number() OVER (ORDER BY doc_id, leaf) AS r FROM leaves),
levels AS (
  SELECT source, 0 AS up, list(leaf ORDER BY place) AS l FROM placed GROUP BY source
  UNION ALL SELECT source, up + 1, {_PARENTS} FROM levels WHERE len(l) > 1),
subroots AS MATERIALIZED (
  SELECT source, l[1] AS subroot, up AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place
  FROM levels WHERE len(l) = 1),
tops AS (
  SELECT 0 AS up, list(subroot ORDER BY place) AS l FROM subroots
  UNION ALL SELECT up + 1, {_PARENTS} FROM tops WHERE len(l) > 1),
steps AS MATERIALIZED (
  SELECT r, levels.up, {_siblings("(place // CAST(pow(3, levels.up) AS BIGINT))")}
  FROM placed JOIN levels ON placed.source IS NOT DISTINCT FROM levels.source WHERE len(l) > 1
  UNION ALL
  SELECT r, height + tops.up, {_siblings("(subroots.place // CAST(pow(3, tops.up) AS BIGINT))")}
  FROM placed JOIN subroots ON placed.source IS NOT DISTINCT FROM subroots.source, tops WHERE len(l) > 1),
proofs AS (
  SELECT r, count(*) AS n, sha256(string_agg(array_to_string(lefts, '') || array_to_string(rights, ''), ''
    ORDER BY up)) AS proof_sha256 FROM steps GROUP BY r),
folds AS (
  SELECT r, 0 AS up, claim AS digest FROM placed
  UNION ALL SELECT folds.r, folds.up + 1,
    sha256(array_to_string(lefts, '') || digest || array_to_string(rights, ''))
  FROM folds JOIN steps ON folds.r = steps.r AND folds.up = steps.up)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
  digest AS folded_root, digest = root AS verified
FROM placed JOIN subroots ON placed.source IS NOT DISTINCT FROM subroots.source
  JOIN folds USING (r) LEFT JOIN proofs USING (r), (SELECT l[1] AS root FROM tops WHERE len(l) = 1)
WHERE folds.up = coalesce(n, 0)
"""
