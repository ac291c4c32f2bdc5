"""The operators' results computed plainly, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Sets:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a


def similar_pairs(sets):
    """Pairs of keys with 100 * intersection >= 75 * union."""
    holders = defaultdict(list)
    for key, members in sets.items():
        for m in members:
            holders[m].append(key)
    for key, members in sets.items():
        shared = Counter(o for m in members for o in holders[m] if o != key)
        for other, n in shared.items():
            if 100 * n >= 75 * (len(members) + len(sets[other]) - n):
                yield key, other


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if len(words) >= 5:
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def near_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    found = Sets()
    for a, b in similar_pairs({i: s for i, s in sets.items() if s}):
        found.join(a, b)
    return {i: (len(sets[i]), found.find(i)) for i in sets}


def normal_line(line):
    return " ".join(WORD.findall(line)).lower()


def without_similar_lines(rows):
    """Texts by id, without repeated lines; rows with one text per id."""
    first, sets = {}, {}
    for i, text in sorted(rows):
        for n, line in enumerate((text or "").split("\n")):
            s = normal_line(line)
            if s and s not in first:
                first[s] = (i, n)
                sets[s] = {s[k:k + 12] for k in range(max(1, len(s) - 11))}
    found, best = Sets(), {}
    for a, b in similar_pairs(sets):
        found.join(a, b)
    for s, place in first.items():
        root = found.find(s)
        best[root] = min(best.get(root, place), place)
    return {i: None if text is None else "\n".join(
        line for n, line in enumerate(text.split("\n"))
        if not normal_line(line) or best[found.find(normal_line(line))] == (i, n)
    ) for i, text in rows}


def without_repeated_bytes(rows, length=100):
    """``n_bytes, n_removed, n_spans, kept`` by id."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p:p + length]
            if window in seen:
                gone[p:p + length] = b"\1" * length
            else:
                seen.add(window)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), spans, kept)
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    """``(kind, start, end)`` by kind and start."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email"
                    or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def masked(text, spans):
    if text is None or not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2], list(PATTERNS).index(s[0]))):
        if a < at:
            at = max(at, b)
        else:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def statistics(text):
    n, chars, symbols, dup, _ = quality_counts(text)
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    upper = len(re.findall("[A-Z]", text or ""))
    return [np.log(max(chars, 1) / max(n, 1)), np.sqrt(symbols / max(n, 1)),
            np.sqrt(upper / max(chars, 1)), np.sqrt(dup / max(len(lines), 1))]


def core_distances(x, spread, share=0.75, least_fall=1e-3, median_chi2=3.3567):
    """Distances of the rows of one group from its core, over the group's scale."""
    spread = np.array(spread)

    def lower(values, q):
        return np.sort(values)[max(0, int(np.ceil(q * len(values))) - 1)]

    def distances(mean, cov):
        y = np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T)
        return (y * y).sum(axis=0)

    def core_of(mean, cov):
        logdet = np.inf
        while True:
            d = distances(mean, cov)
            core = x[d <= lower(d, share)]
            new_mean = core.mean(axis=0)
            new = core.T @ core / len(core) - np.outer(new_mean, new_mean)
            new[np.diag_indices_from(new)] = np.maximum(np.diag(new), 0) + spread ** 2
            fallen = np.linalg.slogdet(new)[1]
            if not fallen < logdet - least_fall:
                return logdet, mean, cov
            logdet, mean, cov = fallen, new_mean, new

    middle = np.array([lower(c, 0.5) for c in x.T])
    deviation = np.array([lower(c, 0.5) for c in abs(x - middle).T])
    starts = (2 * spread) ** 2, spread ** 2 + (1.4826 * deviation) ** 2
    _, mean, cov = min((core_of(middle, np.diag(v)) for v in starts), key=lambda m: m[0])
    d = distances(mean, cov)
    return d / max(1.0, lower(d, 0.5) / median_chi2)


def kept_by_quality(rows, spread, least_rows, cutoff):
    """``id -> kept`` of rows (id, text, lang, source)."""
    counts = {i: quality_counts(t) for i, t, _, _ in rows}
    failed = {i: c[0] < 10 or 100 * c[4] > 20 * c[0] for i, c in counts.items()}
    usable = [r for r in rows if not failed[r[0]]]
    sizes = Counter((lang, source) for _, _, lang, source in usable)
    own = {k for k, n in sizes.items() if n >= least_rows}
    rest = Counter(lang for _, _, lang, source in usable if (lang, source) not in own)
    groups = defaultdict(list)
    for i, t, lang, source in usable:
        key = (lang, source) if (lang, source) in own else (
            (lang,) if rest[lang] >= least_rows else ())
        groups[key].append((i, statistics(t)))
    kept = {i: False for i in failed}
    for members in groups.values():
        d = core_distances(np.array([s for _, s in members]), spread)
        kept.update({i: bool(x <= cutoff) for (i, _), x in zip(members, d)})
    return kept


def jump(key, n):
    """The published algorithm on 64-bit words."""
    key %= 1 << 64
    at, jump_to = -1, 0
    while jump_to < n:
        at = jump_to
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        jump_to = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def merkle_root(digests):
    """Every level from the leaves to the root, as lists of hexadecimal digests."""
    levels = [digests]
    while len(levels[-1]) > 1:
        l = levels[-1]
        levels.append([hashlib.sha256("".join(l[i:i + 3]).encode()).hexdigest()
                       for i in range(0, len(l), 3)])
    return levels


def merkle_leaf(row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle_rows(rows):
    """(doc_id, leaf, subroot, root, proof_sha256) of rows (doc_id, source, ...)."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        leaves = sorted(((r[0] is not None, r[0] or 0, merkle_leaf(r)), r[0]) for r in groups[s])
        trees[s] = [i for _, i in leaves], merkle_root([k[2] for k, _ in leaves])
    top = merkle_root([trees[s][1][-1][0] for s in order])

    def siblings(levels, at):
        out = []
        for level in levels[:-1]:
            run = range(at - at % 3, min(at - at % 3 + 3, len(level)))
            out += [level[j] for j in run if j != at]
            at //= 3
        return out

    for place, s in enumerate(order):
        ids, levels = trees[s]
        for at, i in enumerate(ids):
            proof = "".join(siblings(levels, at) + siblings(top, place))
            yield (i, levels[0][at], levels[-1][0], top[-1][0],
                   hashlib.sha256(proof.encode()).hexdigest())


def spoken(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contamination(texts, items, window=10):
    """(n_words, hit words, ids) of each text; ``items``: (id, text)."""
    windows = defaultdict(set)
    for i, text in items:
        words = spoken(text)
        m = min(window, len(words))
        for k in range(len(words) - m + 1) if m else ():
            windows[tuple(words[k:k + m])].add(i)
    lengths = {len(w) for w in windows}
    for text in texts:
        words, hit, ids = spoken(text), set(), set()
        for m in lengths:
            for k in range(len(words) - m + 1):
                found = windows.get(tuple(words[k:k + m]))
                if found:
                    hit.update(range(k, k + m))
                    ids |= found
        yield len(words), len(hit), sorted(str(i) for i in ids if i is not None)


def aligned(tokens_a, tokens_b):
    """(groups, links) of two lists of (id, bytes) with the same bytes in all: groups as lists of
    both sides' ids, links as pairs of ids."""
    def spans(tokens):
        at = 0
        for i, b in tokens:
            yield i, at, at + len(b)
            at += len(b)

    a, b = list(spans(tokens_a)), list(spans(tokens_b))
    links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
    shared = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups, low = [], 0
    for end in shared:
        groups.append(tuple([i for i, _, e in side if low < e <= end] for side in (a, b)))
        low = end
    return groups, links
