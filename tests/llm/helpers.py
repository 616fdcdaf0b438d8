"""Small frames and plain re-computations for the text operators."""

import re
from itertools import combinations

import xxhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _h int, pos string, word string, fp string"


def docs(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, "p", "w", None) for i, t in rows], DOCS)


LONG = " ".join(f"w{i}" for i in range(30))
ROWS = [
    (1, LONG), (2, "start " + LONG + " end"), (3, LONG), (3, LONG), (4, None), (5, ""), (6, " \n\t "), (7, "one"),
    (8, "x " * 5000), (9, "aÉb café 日本 12's  'll \n\n z"), (None, "no id " + LONG), (10, LONG.upper()),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def near_roots(rows, bits=3, shingle_words=5):
    """Smallest id reachable from each id of (id, text) over links of few bits or similar sets; and over bits only."""
    def fingerprint(text):
        w = words(lowered(text))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[j:j + 3]).encode(), 42) for j in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    sets, fps = {}, {}
    for i, t in rows:
        w = words(lowered(t))
        fps[i] = fingerprint(t)
        sets[i] = {tuple(w[j:j + shingle_words]) for j in range(max(1, len(w) - shingle_words + 1))} if w else set()
    by_bits, by_all = ({i: i for i in sets} for _ in range(2))

    def find(root, x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        near = (fps[a] ^ fps[b]).bit_count() <= bits
        similar = near or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0
        for root, linked in ((by_bits, near), (by_all, similar)):
            if linked:
                x, y = sorted((find(root, a), find(root, b)))
                root[y] = x
    return {i: find(by_all, i) for i in sets}, {i: find(by_bits, i) for i in sets}
