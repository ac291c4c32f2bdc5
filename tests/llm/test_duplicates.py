"""Near copies, lines and passages against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetlake.llm import shingles as sh
from facetlake.llm.components import components
from facetlake.llm.lines import band_keys, dedup_lines, shingle_hashes
from facetlake.llm.near_duplicates import keep_one_of_each, near_duplicates
from facetlake.llm.repeats import (COVER, PERIOD, _compare, _emit, pack_ascending,
                                   remove_repeats, unpack_ascending)
from tests.llm import plain


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies: some round a base whose copies are unlike each other."""
    rng, texts = random.Random(11), []
    for group in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(160)]
        texts += [" ".join(edited(base, rng.choice([1, 2, 3, 4, 5]), rng)) for _ in range(12)]
        texts.append(" ".join(base))
        texts += [" ".join(base).upper()] * 2
    for _ in range(60):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 14))]
        texts += [" ".join(base), " ".join([*base, "end"])]
    rng.shuffle(texts)
    return texts


def test_near_copies_form_the_exact_components(make_docs, copies):
    wanted = plain.near_components(list(enumerate(copies)))
    docs = make_docs(copies)
    found = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    assert len(found) == len(copies)
    for i, (n, component) in wanted.items():
        assert (found[i]["n_shingles"], found[i]["component_id"], found[i]["kept"]) == (
            n, component, i == component)
    kept = {r["doc_id"] for r in keep_one_of_each(docs).select("doc_id").collect()}
    assert kept == {i for i, (_, c) in wanted.items() if i == c}


def test_near_copies_odd_rows(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = {r["doc_id"]: r for r in rows}
    assert found[None]["kept"] and found[None]["component_id"] is None
    assert found[0]["n_shingles"] == 0 and found[0]["kept"]
    assert {found[i]["component_id"] for i in (9, 10, 11)} == {9}
    assert sum(r["doc_id"] == 3 for r in rows) == 2
    assert keep_one_of_each(odd_docs).columns == odd_docs.columns
    assert near_duplicates(no_docs).count() == 0


def test_ids_with_several_texts_link_wherever_one_of_them_does(spark):
    rng = random.Random(5)
    a, b = ([f"{name}{rng.random()}" for _ in range(60)] for name in "ab")
    near = lambda words: " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (1, " ".join(a)),
            (4, "quite alone, this one is")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert near_duplicates(docs).count() == len(rows)
    # Texts of two larger groups that only an id between them joins.
    rows = [(7, " ".join(a)), (8, " ".join(a)), (9, " ".join(b)), (8, " ".join(b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(docs).collect()} == {7}


def test_small_sets_at_the_limit_are_all_linked(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        words = [f"w{rng.random()}" for _ in range(36)]
        # 32 shingles against 24 of them: exactly three quarters.
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[4:-4]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_duplicates(docs).where("component_id = doc_id - doc_id % 2").count() == len(rows)


def test_sketches_fill_every_range():
    for n in (1, 2, 5, 400):
        values = sh.sketch(next(sh.shingle_sets([" ".join(map(str, range(n + 4))).encode()])))
        assert len(values) == sh.BINS and len(sh.band_keys(values)) == sh.BANDS


def test_sketches_agree_as_often_as_the_sets():
    a = [f"a{i}" for i in range(1000)]
    b = a[:800] + [f"b{i}" for i in range(200)]
    one, two = sh.shingle_sets([" ".join(a).encode(), " ".join(b).encode()])
    share = (sh.sketch(one) == sh.sketch(two)).mean()
    assert abs(share - len(set(one) & set(two)) / len(set(one) | set(two))) < 0.15


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(500, i) for i in range(501, 560)]
    edges += [(900 + i, 900 + (i + 1) % 9) for i in range(9)] + [(77, 77), (5, 4), (5, 4)]
    plainly = plain.Sets()
    for a, b in edges:
        plainly.join(a, b)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(4)
    found = {r["node"]: r["component"] for r in components(frame).collect()}
    assert found == {n: plainly.find(n) for n in plainly.parent}
    assert components(frame.limit(0)).count() == 0


# --- lines ------------------------------------------------------------------------------


def test_lines_that_differ_a_little(make_docs):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = [f"word{rng.randrange(900)}" for _ in range(30)]
        texts.append("\n".join(" ".join(edited(base, k, rng)) for k in (0, 1, 2)))
        texts.append(" ".join(base).upper() + "\n\n" + "  ".join(base))
    wanted = plain.without_similar_lines(list(enumerate(texts)))
    found = {r["doc_id"]: r["text"] for r in dedup_lines(make_docs(texts)).collect()}
    assert found == wanted


def test_lines_without_blanks_are_looked_at_whole(make_docs):
    rng = random.Random(9)
    same = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(12))
    tails = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60)) for _ in range(3)]
    kept = ["https://www.example.com/a", "https://www.other.org/b",
            "[1] https://www.foo.example/first", "[1] https://www.bar.example/second",
            "2024-01-01T10:00:00.123456 up", "2024-01-01T10:59:31.987650 down",
            *[same + tail for tail in tails], "😀" * 3 + tails[0][::-1]]
    copies = [same + tails[0][:-1] + "x", "😀" * 3 + tails[0][::-1] + "!"]
    texts = [*kept, *copies]
    wanted = plain.without_similar_lines(list(enumerate(texts)))
    assert wanted == dict(enumerate([*kept, "", ""]))
    found = {r["doc_id"]: r["text"] for r in dedup_lines(make_docs(texts)).collect()}
    assert found == wanted


def test_lines_of_documents_by_shingles_at_every_position(documents, document_rows):
    wanted = plain.without_similar_lines([(i, t) for i, t, _, _ in document_rows])
    found = {r["doc_id"]: r["text"] for r in dedup_lines(documents).collect()}
    assert found == wanted


def test_short_similar_lines_always_share_a_key():
    rng = random.Random(21)
    for _ in range(4000):
        a = [rng.getrandbits(64) - 2**63 for _ in range(rng.choice([3, 6, 12, 16]))]
        b = [*a, *[rng.getrandbits(64) - 2**63 for _ in range(len(a) // 3)]]
        keys = [set(band_keys(np.array(sorted(x), dtype=np.int64)).tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_long_similar_lines_nearly_always_share_a_key():
    rng = random.Random(22)
    missed = 0
    for _ in range(4000):
        n = rng.choice([22, 40, 90, 300])
        same = [rng.getrandbits(64) - 2**63 for _ in range(n * 6 // 7)]
        sides = [[*same, *[rng.getrandbits(64) - 2**63 for _ in range(n // 7)]] for _ in "ab"]
        keys = [set(band_keys(np.array(sorted(x), dtype=np.int64)).tolist()) for x in sides]
        missed += not keys[0] & keys[1]
    assert missed <= 8


def test_shingle_hashes_tell_shingles_apart():
    """Equal shingles hash alike wherever they stand, others do not."""
    rng = random.Random(4)
    lines = ["".join(rng.choice("ab é😀中") for _ in range(rng.choice([1, 5, 11, 12, 13, 60])))
             for _ in range(400)]
    by_shingle, hashes = {}, list(shingle_hashes(lines))
    for line, found in zip(lines, hashes):
        parts = {line[k:k + 12] for k in range(max(1, len(line) - 11))}
        assert len(found) == len(parts) and list(found) == sorted(set(found))
        for part, alone in zip(parts, shingle_hashes(list(parts))):
            by_shingle[part] = int(alone[0])
            assert by_shingle[part] in found
    assert len(set(by_shingle.values())) == len(by_shingle)


def test_lines_move_and_not_their_sets(make_docs, monkeypatch):
    """A set takes eight bytes for each character of its line: none is written or shuffled."""
    from pyspark.sql import types as T

    from facetlake.llm import lines, scratch, stars
    written = {}

    def noted(df, name):
        written[name] = {f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)}
        return scratch.stored(df, name)

    for module in (lines, stars):
        monkeypatch.setattr(module, "stored", noted)
    rng = random.Random(8)
    base = [f"word{rng.randrange(900)}" for _ in range(40)]
    texts = [" ".join(edited(base, k, rng)) for k in (0, 1, 2, 1, 30)]
    wanted = plain.without_similar_lines(list(enumerate(texts)))
    found = {r["doc_id"]: r["text"] for r in dedup_lines(make_docs(texts)).collect()}
    assert found == wanted
    arrays = {name: kinds for name, kinds in written.items() if kinds}
    assert arrays == {"lines": {"keys"}, "line-dropped": {"lines"}}


def family(rng, size, edits):
    """Lines of one base, so edited that many pairs are nearly but not quite similar."""
    base = [f"word{rng.randrange(900)}" for _ in range(60)]
    return [" ".join(edited(base, rng.choice(edits), rng)) for _ in range(size)]


def test_families_of_lines_make_no_row_for_each_pair(make_docs, monkeypatch):
    from facetlake.llm import families, lines, scratch, stars
    rows = {}

    def noted(df, name):
        table = scratch.stored(df, name)
        rows[name] = max(rows.get(name, 0), table.count())
        return table

    for module in (lines, stars, families):
        monkeypatch.setattr(module, "stored", noted)
    rng = random.Random(14)
    texts = [*family(rng, 160, [5, 6, 7, 8]), *family(rng, 9, [1, 6])]
    wanted = plain.without_similar_lines(list(enumerate(texts)))
    found = {r["doc_id"]: r["text"] for r in dedup_lines(make_docs(texts)).collect()}
    assert found == wanted and "" in found.values() and "family-members" in rows
    # Some 13,000 pairs; each line is in up to 16 buckets.
    assert max(rows.values()) <= 16 * len(texts)


@pytest.mark.parametrize("part", [1 << 20, 3000])
def test_links_within_families_join_what_is_similar(spark, part):
    from facetlake.llm.families import links_within
    from facetlake.llm.lines import PERCENT, _sets_of
    rng = random.Random(15)
    lines = [*family(rng, 60, [1, 3, 5, 7, 9]), *family(rng, 25, [2, 8]), "short", "short too"]
    sets = list(shingle_hashes(lines))
    bucket = [0] * 60 + [1] * 25 + [2] * 2
    wanted = plain.Sets()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if bucket[i] == bucket[j] and 100 * both >= PERCENT * (len(a) + len(b) - both):
                wanted.join(j, i)
    shared = spark.createDataFrame([
        (bucket[i], i, len(s), i - i % 2) for i, s in enumerate(sets)],
        "key long, id long, n int, c long")
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, s string")
    found = plain.Sets()
    for i in range(0, len(lines), 2):  # what was joined before
        found.join(i, min(i + 1, len(lines) - 1))
        wanted.join(i, min(i + 1, len(lines) - 1))
    for a, b in links_within(shared, texts, _sets_of, PERCENT, part).collect():
        both = len(np.intersect1d(sets[a], sets[b]))
        assert a < b and 100 * both >= PERCENT * (len(sets[a]) + len(sets[b]) - both)
        found.join(a, b)
    assert [found.find(i) for i in range(len(lines))] == [wanted.find(i) for i in range(len(lines))]


def test_stored_tables_leave_no_shuffled_files(spark):
    import glob
    import tempfile

    from facetlake.llm import scratch

    def shuffled():
        folder = spark.conf.get("spark.local.dir", tempfile.gettempdir())
        return set(glob.glob(f"{folder}/blockmgr-*/*/shuffle_*.data"))

    before = shuffled()
    kept = spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count()
    table = scratch.stored(kept.join(kept.withColumnRenamed("count", "n"), "k"), "no-shuffles")
    assert not shuffled() - before and table.count() == 1000
    assert spark.conf.get(scratch.CLEAN_SHUFFLES) == "false"


def test_lines_odd_rows(odd_docs, no_docs):
    rows = dedup_lines(odd_docs).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd_docs.count() and found[0]["text"] is None
    assert found[0]["lines_before"] == 0 and found[2]["text"] == " \n\t "
    assert found[10]["text"] == "" and found[11]["text"] == ""
    assert found[None]["text"] == "again and again" and found[9]["key"] == 7
    assert dedup_lines(no_docs).count() == 0


# --- passages ---------------------------------------------------------------------------


def test_every_distance_meets_the_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_packed_numbers_round_trip():
    for values in ([], [0], [5, 6, 70_000, 4_000_000_000]):
        import numpy as np
        assert unpack_ascending(pack_ascending(np.array(values, dtype=np.int64))).tolist() == values


def test_equal_short_names_of_two_buckets_in_one_batch():
    import numpy as np
    # Places 0 and 200 share the short name but not the bucket; the other batch repeats the second.
    def rows(doc, places, second):
        names = (np.full(len(places), 77, np.uint64), np.array(second, np.uint64))
        return [r for b in _emit([(doc, 0)], [400], np.array(places), names, 2, True, "<u4")
                for r in b.to_pylist()]
    sent = rows(1, [0, 200], [0, 1]) + rows(2, [50], [1])
    found = {}
    for bucket in (0, 1):
        blobs = pa.table({"entries": [r["entries"] for r in sent if r["bucket"] == bucket]})
        for r in _compare(True, "<u4")(blobs).to_pylist():
            found.setdefault(r["k"], []).extend(unpack_ascending(r["places"]).tolist())
    assert found == {1: [200], 2: [50]}


def passages():
    rng, texts = random.Random(5), []
    base = "".join(rng.choice("abcé ") for _ in range(3000))
    for _ in range(50):
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 300)))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(0, 2600)
            text += base[at:at + rng.choice([99, 100, 101, 155, 156, 400])] + rng.choice("xyz")
        texts.append(text)
    return [*texts, "a" * 1000, "a" * 150, "ab" * 400, texts[3], "x" + texts[5]]


def test_passages_against_all_windows(make_docs):
    texts = passages()
    wanted = plain.without_repeated_bytes(list(enumerate(texts)))
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
             for r in remove_repeats(make_docs(texts)).collect()}
    assert found == wanted
    assert sum(w[1] for w in wanted.values()) > 5000


def test_passages_odd_rows(odd_docs, no_docs):
    rows = remove_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = {r["doc_id"]: r for r in rows}
    assert (found[0]["n_bytes"], found[0]["n_spans"]) == (0, 0)
    assert found[6]["n_removed"] == 15000 - 5 and found[7]["n_removed"] == 20000 - 1
    assert remove_repeats(no_docs).count() == 0


def test_passages_of_documents(documents, document_rows):
    rows = [(i, t) for i, t, _, _ in document_rows]
    wanted = {i: (*w[:3], plain.sha(w[3])) for i, w in plain.without_repeated_bytes(rows).items()}
    found = remove_repeats(documents).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("s")).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == wanted
