"""Mixing, Merkle manifest and fill-in-middle against plain loops, with odd rows and tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adledger.llm import fill_in_middle, merkle, mixing
from tests.llm.helpers import DOCS, LONG, ROWS, collected, docs, words

MIXED = "doc_id bigint, text string, source string, size int, rank string, start int, key string, draw int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- mixing -----------------------------------------------------------------

def targets_of(sizes, weights=(5, 2, 1)):
    """Excess shared again and again, as the rule says."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in sorted(free, key=str):
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def mixed_rows(rng, hot=True):
    rows = []
    for i in range(300):
        source = "hot" if hot and rng.random() < .34 else rng.choice(["a", "b", "Z", "é", "z9", None])
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 3, 20, 100, 300])), source))
    rows += [(7, "same words", "a")] * 5 + [(None, "no id", "b"), (900, None, "a"), (901, "", None), (902, "w " * 20000, "b")]
    return [(i, t, s, 1, "r", 2, "k", 3) for i, t, s in rows]


@pytest.mark.parametrize("block_words, shards", [(64, 16), (64, 1), (7, 5), (4096, None)])
def test_mix_meets_its_quotas(spark, block_words, shards):
    rows = mixed_rows(random.Random(block_words))
    frame = spark.createDataFrame(rows, MIXED)
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(words(t))
    want = targets_of(sizes)
    documents, pieces = mixing.mix(frame, block_words=block_words, shards=shards)
    documents, pieces = documents.collect(), pieces.collect()
    assert len(documents) == len(rows)
    source = {d["row"]: d["source"] for d in documents}
    taken = Counter()
    seen = Counter()
    for p in pieces:
        taken[source[p["row"]]] += p["n_words"]
        for w in range(p["first_word"], p["first_word"] + p["n_words"]):
            seen[p["row"], p["epoch"], w] += 1
    assert set(seen.values()) <= {1} and {e for _, e, _ in seen} <= {0, 1}
    top = Counter()
    for r, _, w in seen:
        top[r] = max(top[r], w)
    for d in documents:
        assert d["source_size"] == sizes[d["source"]] and math.isclose(d["target"], want[d["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert top[d["row"]] < max(d["size"], 1)
    for s, t in want.items():
        assert abs(taken[s] - t) < .5001
    # a second pass starts only when the first is whole
    second = {source[r] for r, e, _ in seen if e == 1}
    first = Counter(source[r] for r, e, _ in seen if e == 0)
    assert all(first[s] == sizes[s] for s in second)
    if shards:
        blocks = Counter((p["shard"]) for p in pieces)
        assert set(blocks) <= set(range(shards))
        words_of = Counter()
        for p in pieces:
            words_of[p["shard"]] += p["n_words"]
        # an even number of blocks; each source has at most one block cut short and one short block
        assert max(words_of.values()) - min(words_of.values()) <= block_words * (1 + 3 * len(want))


def test_mix_repeats_itself_and_ignores_layout(spark):
    rows = mixed_rows(random.Random(2))
    frame = spark.createDataFrame(rows, MIXED)

    def result(df):
        return collected(mixing.taken_words(df, block_words=64), "doc_id", "size", "taken", "target")

    assert result(frame.repartition(7)) == result(frame.coalesce(1)) == result(frame)


def test_mix_of_nothing(spark):
    documents, pieces = mixing.mix(spark.createDataFrame([], MIXED))
    assert documents.count() == pieces.count() == 0
    blank = spark.createDataFrame([(1, None, "a", 1, "r", 2, "k", 3), (2, " ", None, 1, "r", 2, "k", 3)], MIXED)
    assert collected(mixing.taken_words(blank), "doc_id", "size", "source_size", "target", "taken") == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_hypergeometric_follows_the_distribution(spark):
    big_n, big_k, n, runs = 40, 13, 17, 20000
    got = Counter(r["x"] for r in spark.range(runs).select(mixing.hypergeometric(
        F.lit(big_n).cast("bigint"), F.lit(big_k).cast("bigint"), F.lit(n).cast("bigint"), mixing.uniform("id")).alias("x")).collect())
    for x in range(14):
        p = math.comb(big_k, x) * math.comb(big_n - big_k, n - x) / math.comb(big_n, n)
        assert abs(got[x] - runs * p) < 5 * math.sqrt(runs * p) + 3
    large = spark.range(60).select(mixing.hypergeometric(F.lit(10 ** 9), F.lit(4 * 10 ** 8), F.lit(5 * 10 ** 8), mixing.uniform("id")).alias("x"))
    at = [r["x"] for r in large.collect()]
    deviation = math.sqrt(5e8 * .4 * .6 * .5)
    assert abs(sum(at) / 60 - 2e8) < deviation * .7 and len(set(at)) > 50
    edges = spark.createDataFrame([(0, 0, 0, .5), (5, 5, 3, .9), (5, 0, 3, .9), (5, 3, 0, .1), (5, 3, 5, 0.0)], "a long, b long, c long, u double")
    assert [r["x"] for r in edges.select(mixing.hypergeometric(*[F.col(c) for c in "abcu"]).alias("x")).collect()] == [0, 3, 0, 0, 3]


# --- manifest ---------------------------------------------------------------

def leaf_of(row, lower=False):
    text = row[4]
    if lower and text is not None:
        text = text.translate({i: i + 32 for i in range(65, 91)})
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([sha("".join(row[i:i + 8])) for i in range(0, len(row), 8)])
    return levels


def walk(levels, i):
    out = []
    for row in levels[:-1]:
        first = i - i % 8
        out.append(("".join(row[first:i]), "".join(row[i + 1:first + 8])))
        i //= 8
    return out


def manifest_want(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    def tampered(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 0

    langs = sorted({r[2] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, placed = [], {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        placed[lang] = own
        trees.append(tree_of([leaf_of(r) for r in own]))
    top = tree_of([t[-1][0] for t in trees])
    root, want = top[-1][0], []
    for number, lang in enumerate(langs):
        for i, r in enumerate(placed[lang]):
            way = walk(trees[number], i) + walk(top, number)
            node = leaf_of(r, lower=tampered(r[0]))
            for a, b in way:
                node = sha(a + node + b)
            want.append((r[0], leaf_of(r), trees[number][-1][0], root, sha("".join(a + b for a, b in way)), node, node == root))
    return sorted(want, key=repr)


LEAVES = "doc_id bigint, source string, lang string, n_chars bigint, text string, pos int, tree string, claimed string, n int"


def manifest_got(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "t", "c", 2) for r in rows], LEAVES)
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    made = merkle.manifest(frame, {"text": F.translate("text", merkle.UPPER, merkle.LOWER)}, crc)
    return collected(merkle.proofs(made), "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    rng = random.Random(levels)
    rows = [(i, "s", rng.choice(["en", "en", "en", "de", "é", "", None]), 5, f"Text {i} É") for i in range(620)]
    rows += [(None, None, None, None, None), (9001, "x", "alone", 0, ""), (9002, "x", "en", 3, "A b " * 20000), (9003, None, "en", None, None)]
    rows += [(3, "s", "en", 5, "Twin")] * 3
    assert manifest_got(spark, rows) == manifest_want(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_manifest_of_full_and_broken_runs(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    assert manifest_got(spark, rows) == manifest_want(rows)


def test_manifest_with_many_languages(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    rows = [(i, "s", f"l{i % 90}", 1, f"T{i}") for i in range(150)]
    assert manifest_got(spark, rows) == manifest_want(rows)


def test_manifest_of_nothing(spark):
    made = merkle.manifest(spark.createDataFrame([], LEAVES))
    assert made.root.count() == 0 and merkle.proofs(made).count() == 0


def test_addresses_fill_a_block():
    for rows in range(1, 6):
        places = [p for depth in range(rows) for p in merkle.address(depth, np.arange(8 ** depth), rows)]
        assert sorted(places) == list(range(merkle.tree_size(rows)))
    # half the height first: the two upper rows of four fill the first nine places
    assert sorted(merkle.address(1, np.arange(8), 4)) == list(range(1, 9))


# --- fill in middle ---------------------------------------------------------

TEXTS = [(i, t) for i, t in ROWS] + [
    (20, "has a <P> inside"), (21, "<S>"), (22, "x<M"), (23, "<"), (24, "<P"), (25, "日本語のテキスト😀 mixed é text"), (26, "é" * 3000 + " x\n" * 2000),
    (27, "line one\nline two\r\nline three"), (28, "a" * 64), (29, "b" * 63), *[(100 + i, f"text number {i} ü " * (i % 7)) for i in range(60)],
]


def test_fill_in_middle(spark):
    got = fill_in_middle.transform(docs(spark, TEXTS)).withColumn("back", fill_in_middle.restored())
    want = []
    for i, t in TEXTS:
        t = t or ""
        h = sha(f"1:{'' if i is None else i}")
        h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in range(0, 32, 8))
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            want.append((i, len(t), "plain", None, None, t, t))
        elif h4 % 100 < 20:
            want.append((i, len(t), "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b], t))
        else:
            want.append((i, len(t), "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b], t))
    assert collected(got, "doc_id", "n", "form", "prefix_units", "middle_units", "output", "back") == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("unit, ends", [("words", " \t\n\r\x0b\x0c"), ("lines", "\n\r\x0b\x0c")])
def test_fill_in_middle_at_words_and_lines(spark, unit, ends):
    rows = fill_in_middle.transform(docs(spark, TEXTS), unit=unit, fim_percent=100, spm_percent=0).withColumn(
        "back", fill_in_middle.restored()).collect()
    texts = Counter(t or "" for _, t in TEXTS)
    assert Counter(r["back"] for r in rows) == texts
    for r in rows:
        if r["form"] == "psm":
            prefix = r["output"][3:].split("<S>")[0]
            assert sum(c in ends for c in prefix) == r["prefix_units"] and (not prefix or prefix[-1] in ends)


def test_ranks_against_a_count():
    rng = random.Random(5)
    for n in (0, 1, 63, 64, 65, 500):
        body = "".join(rng.choice("ab 1.\né日😀") for _ in range(n)).encode()
        matrix = fill_in_middle.WaveletMatrix(body)
        kinds = fill_in_middle.CLASSES[list(body)] if body else []
        for least in range(8):
            for end in {0, len(body) // 3, len(body) // 2, len(body)}:
                assert matrix.rank_from(least, end) == sum(k >= least for k in kinds[:end])
        text = body.decode()
        for k in {0, 1, n // 2, n}:
            assert body[: matrix.cut_after("characters", k)].decode() == text[:k]


def test_markers_must_be_told_apart(spark):
    frame = docs(spark, [(1, LONG)])
    for bad in (("<A>", "<A>", "<B>"), ("<<A>", "<B>", "<C>"), ("a", "b", "c")):
        with pytest.raises(ValueError):
            fill_in_middle.transform(frame, markers=bad)
