"""Exact, SimHash, substring and line dedup against plain loops, with odd rows and tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from adledger.llm import decontaminate, exact_dedup, line_dedup, set_links, simhash, substring_dedup
from adledger.operators import skew
from tests.llm.helpers import DOCS, ROWS, collected, docs, lowered, near_roots, words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [3, 4096])
def test_exact_groups(spark, block_bytes):
    got = collected(exact_dedup.exact_groups(docs(spark, ROWS), block_bytes=block_bytes), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want, used = [], set()
    for i, t in ROWS:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        kept = i == keep and (t or "") not in used
        if kept:
            used.add(t or "")
        want.append((i, keep, len(ids), kept, sha(t or "")))
    assert got == sorted(want, key=repr)


def test_exact_identity_is_by_content(spark):
    """Texts that agree in all blocks but the last, or in length only, stay apart."""
    rows = [(i, "ab" * 20 + str(i)) for i in range(6)] + [(10, "ab" * 20), (11, "ba" * 20)]
    got = exact_dedup.exact_groups(docs(spark, rows), block_bytes=4)
    assert {r.group_size for r in got.collect()} == {1}


def test_drop_copies(spark):
    frame = docs(spark, ROWS)
    kept = exact_dedup.drop_copies(frame)
    assert kept.columns == frame.columns
    assert Counter(r.text or "" for r in kept.collect()) == Counter({t or "" for _, t in ROWS})
    assert {r.doc_id for r in kept.where("text like 'w0 %'").collect()} == {3}
    assert exact_dedup.drop_copies(spark.createDataFrame([], DOCS)).count() == 0


def fingerprint(text):
    w = words(lowered(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[j:j + 3]).encode(), 42) for j in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in ROWS if i is not None]
    base = [f"v{rng.randrange(500)}" for _ in range(400)]
    for i in range(40):
        near = list(base)
        near[rng.randrange(400)] = f"n{i}"
        rows.append((100 + i, " ".join(near)))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(docs(spark, rows)).collect()}
    ids = sorted({i for i, _ in rows})
    fp = {i: fingerprint(t) for i, t in rows}
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (fp[a] ^ fp[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert got == {(i, f"{fp[i]:016x}", root[i]) for i in ids}
    kept = simhash.keep_one(docs(spark, rows))
    assert {r.doc_id for r in kept.collect()} == set(root.values())
    assert simhash.near_groups(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("cell", [512, 3])
def test_near_stage_drops_similar_texts(spark, monkeypatch, cell):
    """Every pair with a five-word Jaccard similarity of 0.8 or more is linked, near the limit and in groups too."""
    monkeypatch.setattr(set_links, "CELL", cell)
    rng = random.Random(8)
    rows = [(i, t) for i, t in ROWS if i is not None]
    passage = [f"p{i}" for i in range(30)]
    for g in range(30):
        base = passage * (g % 3 == 0) + [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(5, 120))]
        for k in range(3 if g else 25):
            near = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40 + 1)):
                near[rng.randrange(len(near))] = f"n{g}_{k}"
            rows.append((100 + g * 30 + k, " ".join(near)))
    root, bits = near_roots(rows)
    assert len(set(root.values())) < len(set(bits.values()))
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, rows), "")
    assert {r.doc_id for r in kept.collect()} == set(root.values())


def test_sketches_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 90, 91, 700, 3000):
        a = rng.integers(-2 ** 63, 2 ** 63, n)
        for share in (0, .05, .1, .3, 1):
            b = np.unique(np.concatenate([a[int(n * share):], rng.integers(-2 ** 63, 2 ** 63, int(n * share * rng.random()))]))
            differ = len(np.setxor1d(a, b))
            assert set_links.apart(set_links.sketch_of(a), set_links.sketch_of(b)) <= differ


def test_filters_keep_columns_of_their_own_names(spark):
    """Input columns that are called like the operators' marks come back as they were."""
    frame = spark.createDataFrame([(1, "a b", 11, 21, 31, 41), (2, "a b", 12, 22, 32, 42), (3, "c d e f", 13, 23, 33, 43)],
                                  "doc_id bigint, text string, _h int, _keep_h int, _drop_h int, _r_doc_id int")
    want = [(2, 12, 22, 32, 42), (3, 13, 23, 33, 43)]
    columns = ["doc_id", "_h", "_keep_h", "_drop_h", "_r_doc_id"]
    assert collected(exact_dedup.drop_copies(frame), *columns) == want
    assert collected(simhash.keep_one(frame.where("doc_id > 1"), set_words=5), *columns) == want
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert collected(decontaminate.drop_contaminated(frame, items), *columns) == want[1:]


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**63, 300).astype(np.uint64)
    fps[1::2] = fps[::2] ^ (np.uint64(1) << rng.integers(0, 63, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 150).astype(np.uint64))
    planes = simhash.packed(simhash.bits_of(fps))
    for x in fps[:40]:
        want = np.flatnonzero(np.bitwise_count(fps ^ x) <= radius)
        assert simhash.within(planes, len(fps), int(x), radius).tolist() == want.tolist()


@pytest.mark.parametrize("block", [70, 4096])
def test_packed_buckets(monkeypatch, block):
    """Buckets of all sizes in shared blocks give the components of each, and no link between two."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    fps, bucket = [], []
    for b, size in enumerate([1, 2, 1, 1, 5, 63, 64, 65, 2, 150, 3, 1, 30, 30, 30, 2, 1]):
        own = {rng.getrandbits(64)}
        while len(own) < size:
            x = rng.choice(sorted(own))
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            own.add(x)
        fps += sorted(own)
        bucket += [b] * size
    edges = simhash.links_in(np.array(fps, np.uint64), np.array(bucket), 3)
    got, want = ({i: i for i in range(len(fps))} for _ in range(2))
    place = {(f, b): i for i, (f, b) in enumerate(zip(fps, bucket))}
    assert len(place) == len(fps) and len(edges) < len(fps)

    def find(root, x):
        while root[x] != x:
            x = root[x]
        return x

    def join(root, i, k):
        i, k = sorted((find(root, i), find(root, k)))
        root[k] = i

    by_value = {f: i for i, f in enumerate(fps)}
    for u, v in edges:
        assert ((u ^ v) & (1 << 64) - 1).bit_count() <= 3
        join(got, by_value[u % (1 << 64)], by_value[v % (1 << 64)])
    for i in range(len(fps)):
        for k in range(i):
            if bucket[i] == bucket[k] and (fps[i] ^ fps[k]).bit_count() <= 3:
                join(want, i, k)
    assert {i: find(got, i) for i in got} == {i: find(want, i) for i in want}


def test_crowded_buckets_lose_no_link(spark):
    """A bucket over the limit is split by further bits with the same components."""
    rng = random.Random(5)
    fps = {rng.getrandbits(63)}
    while len(fps) < 300:
        x = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(63)
        fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    root = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 3 and root[a] > root[b]:
                    root[a] = root[b]
                    changed = True
    linked = {a for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3}
    for limit in (4, 2048):
        got = {(r.node, r.root) for r in simhash.linked(frame, bucket_limit=limit).collect()}
        assert got == {(x, root[x]) for x in linked}


def substring_want(rows, size=13):
    least = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - size + 1):
            g = tuple(w[s:s + size])
            i_ = -1 if i is None else i
            least[g] = min(least.get(g, i_), i_)
    want = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - size + 1):
            if least[tuple(w[s:s + size])] < (-1 if i is None else i):
                gone |= set(range(s, s + size))
        want.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(want, key=repr)


def test_substring_dedup(spark, monkeypatch):
    rng = random.Random(2)
    common = [[f"c{p}_{i}" for i in range(rng.randrange(10, 40))] for p in range(6)]
    rows = list(ROWS)
    for i in range(20, 60):
        parts = [[f"u{i}_{k}" for k in range(rng.randrange(0, 9))] + rng.choice(common)[rng.randrange(3):] for _ in range(3)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w for p in parts for w in p)))
    frame = docs(spark, rows).repartition(4)
    want = substring_want(rows)
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert collected(substring_dedup.repeated_words(frame), *columns) == want
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", 50)  # many chunks: most answers come from other chunks
    told = substring_dedup.repeated_words(frame, with_text=True)
    assert collected(told, *columns) == want
    for r in told.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and sha(r.kept_text) == r.kept_sha256
    assert substring_dedup.repeated_words(spark.createDataFrame([], DOCS)).count() == 0


def test_line_at_one_place_of_many_documents_is_spread(spark):
    """The salt follows document and line: a line that opens 3,000 documents is no single group."""
    rows = docs(spark, [(i, f"the same first line of all\nown line {i}") for i in range(3000)])
    named = rows.select(F.col("doc_id").alias("did"), F.xxhash64("text").alias("_h"), F.lit(0).alias("pos"))
    sizes = [r["count"] for r in named.groupBy(skew.salt_of(line_dedup._salt())).count().collect()]
    assert max(sizes) < 40
    got = line_dedup.remove_repeats(rows).groupBy("n_removed").count().collect()
    assert {r["n_removed"]: r["count"] for r in got} == {0: 1, 1: 2999}


@pytest.mark.parametrize("min_lines", [1, 2, 3])
def test_line_dedup(spark, min_lines):
    rng = random.Random(min_lines)
    kinds = ["a", "b", "c", "d", "long line of at least twenty characters", "Δ" * 20, "x" * 19]
    rows = [(i, "\n".join(rng.choice(kinds) for _ in range(rng.randrange(0, 9)))) for i in range(1, 25)]
    rows += [(40, "\n".join(f"passage {i}" for i in range(70))), (41, "\n".join(["other", *(f"passage {i}" for i in range(70)), "end"]))]
    rows += [(30, None), (31, ""), (32, "q\nq\nq\nq\nq"), (None, "a\nb\nc"), (33, "z\n" + "a\nb\nc"), (34, "unique line"), (34, "unique line")]
    got = collected(line_dedup.remove_repeats(docs(spark, rows), min_lines, with_text=True), "doc_id", "n_lines", "n_removed", "run_scale", "kept_text")
    keyed = {((-1 if i is None else i), t or ""): (t or "").split("\n") for i, t in rows}
    first = {}
    for (i, t), lines in sorted(keyed.items()):
        for n in {1, min_lines}:
            for p in range(len(lines) - n + 1):
                first.setdefault(tuple(lines[p:p + n]), (i, t, p))
    scales = (1, 2, 4, 8, 16, 32, 64)
    seen = Counter(tuple(x[p:p + n]) for x in keyed.values() for n in scales for p in range(len(x) - n + 1))
    want = []
    for i, t in rows:
        key = (-1 if i is None else i, t or "")
        lines = keyed[key]
        gone = {q for p in range(len(lines) - min_lines + 1) if first[tuple(lines[p:p + min_lines])] != (*key, p) for q in range(p, p + min_lines)}
        gone |= {p for p, x in enumerate(lines) if len(x) >= 20 and first[(x,)] != (*key, p)}
        scale = max((n for n in scales for p in range(len(lines) - n + 1) if seen[tuple(lines[p:p + n])] > 1), default=0)
        want.append((i, len(lines), len(gone), scale, "\n".join(x for q, x in enumerate(lines) if q not in gone)))
    assert got == sorted(want, key=repr)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_rounds_on_few_edges_use_few_tasks(spark, monkeypatch):
    """Each task of a round leaves files: with many shuffle partitions a small graph took them all."""
    from adledger.llm import common

    files, old = [], common.cut

    def cut(df):
        out = old(df)
        files.append(out.rdd.getNumPartitions() and len(out.inputFiles()))
        return out

    monkeypatch.setattr(common, "cut", cut)
    cores = spark.sparkContext.defaultParallelism
    edges = spark.range(4000).selectExpr("id AS u", "id + 1 AS v").where("u % 5 < 4")
    with common.setting(spark, "spark.sql.shuffle.partitions", str(8 * cores)), \
            common.setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        found = {r["node"]: r["root"] for r in common.components(edges).collect()}
    assert found == {n: n - n % 5 for n in range(4000)}
    assert len(files) > 1 and max(files[1:]) <= cores
