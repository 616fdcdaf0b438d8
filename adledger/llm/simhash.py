"""SimHash near-dedup: bit-sliced comparison of fingerprints inside banded buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger.llm.common import components, cut, fresh, join_on, small_batches
from adledger.llm.set_links import set_nodes, similar_links, widened
from adledger.operators.skew import lookup
from adledger.session import durable

RADIUS = 3
SHINGLE_WORDS = 3
BANDS = 6
BUCKET_LIMIT = 2048
BLOCK = 4096
#: Largest bucket that shares its block of planes with others.
SMALL = 64
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str, shingle_words: int) -> np.ndarray:
    """XXH64 of the ASCII-lower-cased words' shingles, repeats included; one of all words if there are fewer."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(words))
    if len(words) <= shingle_words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        [digest(joined[a:b], 42) for a, b in zip(starts[: 1 - shingle_words].tolist(), ends[shingle_words - 1:].tolist(), strict=True)],
        np.uint64, len(words) - shingle_words + 1)


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the text's shingles; zero without words."""
    hashes = shingle_hashes(text, shingle_words)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * set_bits > len(hashes)).tolist())


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, _h, fp bigint) per row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "", shingle_words) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "_h", "fp"])

    return keyed(docs).mapInArrow(run, "doc_id bigint, _h bigint, fp bigint")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, _h, text) with ``_h`` the text's hash."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), "text")


def bits_of(fps: np.ndarray) -> np.ndarray:
    """Bits stored vertically: row i holds bit i of all fingerprints."""
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as planes of 64-bit words, zeros at the end."""
    padded = np.zeros((64, -(-bits.shape[1] // 64) * 64), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def lanes_within(differ: Callable[[int], np.ndarray], width: int, n: int, radius: int) -> np.ndarray:
    """Lanes among the first ``n`` whose planes ``differ(0..63)`` have at most ``radius`` bits set.

    One counter per lane, kept as bit slices: a differing plane is added with a carry
    chain. ``over`` marks counters past the radius; when all are, the block is abandoned.
    """
    slices = [np.zeros(width, np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(width, np.uint64)
    over[n // 64:] = ~np.uint64(0)
    if n % 64:
        over[n // 64] = ~np.uint64(0) << np.uint64(n % 64)
    ones = ~np.uint64(0)
    # unless radius + 1 is a power of two, the counter is compared with the radius
    steps = not all(radius >> t & 1 for t in range(len(slices)))
    for i in range(64):
        carry = differ(i).copy()
        for s in slices:
            s_old = s.copy()
            s ^= carry
            carry &= s_old
        over |= carry
        if steps:
            above = np.zeros_like(over)
            equal = np.full_like(over, ones)
            for t in reversed(range(len(slices))):
                if radius >> t & 1:
                    equal &= slices[t]
                else:
                    above |= equal & slices[t]
                    equal &= ~slices[t]
            over |= above
        if i % 4 == 3 and (over == ones).all():
            return np.empty(0, np.int64)
    return np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little")[:n])


def within(planes: np.ndarray, n: int, fp: int, radius: int) -> np.ndarray:
    """Indices of the block's fingerprints at ``radius`` or fewer bits from ``fp``."""
    return lanes_within(lambda i: ~planes[i] if fp >> i & 1 else planes[i], planes.shape[1], n, radius)


class Groups:
    """Union-find that keeps the edges which joined two groups."""

    def __init__(self, n: int) -> None:
        self.root, self.edges = list(range(n)), []

    def join(self, i: int, k: int) -> None:
        root = self.root
        a, b = i, k
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            root[b] = a
            self.edges.append((i, k))


def links_in(fps: np.ndarray, bucket: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect all fingerprints linked inside their bucket: at most one per fingerprint.

    ``fps`` are distinct within a bucket and its rows adjacent. Buckets of up to ``SMALL`` share
    blocks of planes: at distances 1, 2, ... every row is compared with the one so far on, where
    that is of its bucket, all rows of a block at once. Each row of a larger bucket is compared
    with the bucket's blocks from its own onwards.
    """
    signed = fps.view(np.int64)
    groups = Groups(len(fps))
    starts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    sizes = np.diff(starts)
    # rows of small buckets, in blocks; a bucket that crosses an edge of a block meets its rest there
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    for at in range(0, len(small), BLOCK):
        rows = small[at:at + BLOCK + SMALL]
        bits, own = bits_of(fps[rows]), bucket[rows]
        left = np.arange(min(BLOCK, len(rows)))
        for step in range(1, SMALL):
            left = left[left + step < len(rows)]
            left = left[own[left] == own[left + step]]
            if not len(left):
                break
            planes = packed(bits[:, left] ^ bits[:, left + step])
            for lane in lanes_within(planes.__getitem__, planes.shape[1], len(left), radius):
                groups.join(int(rows[left[lane]]), int(rows[left[lane] + step]))
    for first, size in zip(starts[:-1][sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        for at in range(0, size, BLOCK):
            block = fps[first + at:first + min(at + BLOCK, size)]
            planes = packed(bits_of(block))
            for i in range(min(size, at + len(block))):
                for j in within(planes, len(block), int(fps[first + i]), radius):
                    if at + int(j) > i:
                        groups.join(first + i, first + at + int(j))
    return [(int(signed[i]), int(signed[k])) for i, k in groups.edges]


def band_keys(fp: Column, bits: list[int], bands: int, radius: int) -> list[Column]:
    """One bigint key per choice of ``bands - radius`` bands of the given bit positions.

    Two fingerprints that differ in at most ``radius`` of these bits agree in at least
    that many bands, so they share a key.
    """
    cuts = [round(i * len(bits) / bands) for i in range(bands + 1)]
    parts = [bits[cuts[i]:cuts[i + 1]] for i in range(bands)]
    keys = []
    for number, chosen in enumerate(combinations(range(bands), bands - radius)):
        key, used = F.lit(number).cast("bigint"), 0
        for part in (parts[c] for c in chosen):
            piece = F.shiftrightunsigned(fp, part[0]).bitwiseAND(F.lit((1 << len(part)) - 1))
            key = F.shiftleft(key, len(part)).bitwiseOR(piece)
            used += len(part)
        keys.append(key)
    return keys


def _compare(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Edges inside each bucket of (keys, fp) rows; a bucket is bounded by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def edges_of(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            new = np.zeros(len(columns[-1]), bool)
            for c in columns[:-1]:
                new[1:] |= c[1:] != c[:-1]
            bucket = np.cumsum(new)
            # sorted by fingerprint inside a bucket, so repeats are neighbours
            keep = np.ones(len(bucket), bool)
            keep[1:] = (bucket[1:] != bucket[:-1]) | (columns[-1][1:] != columns[-1][:-1])
            u, v = zip(*edges, strict=True) if (edges := links_in(columns[-1][keep].view(np.uint64), bucket[keep], radius)) else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(i)) for i in range(batch.num_columns)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)) + 1
            if held and any(h[-1] != c[0] for h, c in zip(held[-1][:-1], columns[:-1], strict=True)):
                yield edges_of(held)
                held = []
            # the last bucket may go on in the next batch
            last = int(change[-1]) if len(change) else 0
            if last:
                yield edges_of([*held, [c[:last] for c in columns]])
                held = []
            held.append([c[last:] for c in columns])
        if held:
            yield edges_of(held)

    ordered = rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return ordered.mapInArrow(run, "u bigint, v bigint")


def linked(distinct: DataFrame, radius: int = RADIUS, bands: int = BANDS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(node, root) over distinct fingerprints ``fp``: components of the link graph, for linked ones.

    Every pair within the radius shares a bucket of one of C(bands, radius) tables keyed by
    half the bits. A bucket of more than ``bucket_limit`` fingerprints is split again by
    bands of the remaining bits, which fixes about three quarters of the bits: such a
    bucket holds at most 2^17 distinct fingerprints whatever the input, and no pair is lost.
    """
    bits = list(range(64))
    keyed = distinct.select("fp", F.explode(F.array(*band_keys(F.col("fp"), bits, bands, radius))).alias("key"))
    large = durable(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_limit).select("key"))
    edges = _compare(keyed.join(large, "key", "left_anti"), ["key"], radius)
    if large.limit(1).count():
        cuts = [round(i * 64 / bands) for i in range(bands + 1)]
        tables = list(combinations(range(bands), bands - radius))
        inner = F.lit(None).cast("array<bigint>")
        # bit positions left over differ by table; bands of them are whole runs of bits
        for number, chosen in enumerate(tables):
            runs = [list(range(cuts[b], cuts[b + 1])) for b in range(bands) if b not in chosen]
            halves = [part for run in runs for part in (run[: len(run) // 2], run[len(run) // 2:])]
            subkeys = []
            for sub, picked in enumerate(combinations(range(len(halves)), len(halves) - radius)):
                key = F.lit(sub).cast("bigint")
                for part in (halves[p] for p in picked):
                    key = F.shiftleft(key, len(part)).bitwiseOR(
                        F.shiftrightunsigned("fp", part[0]).bitwiseAND(F.lit((1 << len(part)) - 1)))
                subkeys.append(key)
            inner = F.when(F.col("table") == number, F.array(*subkeys)).otherwise(inner)
        used = [sum(cuts[b + 1] - cuts[b] for b in chosen) for chosen in tables]
        table_of = F.lit(None).cast("int")
        for number, width in enumerate(used):
            table_of = F.when(F.shiftrightunsigned("key", width) == number, number).otherwise(table_of)
        crowded = keyed.join(large, "key", "left_semi").withColumn("table", table_of)
        split = crowded.select("key", "fp", F.explode(inner).alias("sub"))
        edges = edges.union(_compare(split, ["key", "sub"], radius))
    return components(edges)


def near_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, set_words: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_links, and ``_h``; one row per input row.

    Rows with equal fingerprints are one node, so a group of copies is compared once and
    only aggregated otherwise. component_id is the smallest non-null doc_id reachable over
    links of ``radius`` or fewer bits (null if there is none). Texts without words have
    fingerprint zero and link like any other. n_links counts the other rows of the
    component. With ``set_words``, texts whose sets of shingles of so many words have a
    Jaccard similarity of 0.8 or more are linked too. Works for an empty table; other
    columns are ignored.
    """
    rows = durable(fingerprints(docs, shingle_words))
    nodes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = durable(linked(nodes.select("fp"), radius).withColumnRenamed("node", "fp"))
    if set_words:
        texts = keyed(docs)
        with small_batches(docs.sparkSession):
            sets = cut(set_nodes(texts, set_words).distinct())
        with_sets = cut(join_on(rows.distinct(), sets, ["doc_id", "_h"]))
        roots = widened(roots, similar_links(texts, with_sets, set_words, roots))
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size"))
    by_fp = durable(lookup(named.select("fp", "root"), groups, "root", "fp").drop("root"))
    out = lookup(rows, by_fp, "fp", "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
                      (F.col("size") - 1).alias("n_links"), "_h")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, set_words: int | None = None) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, columns unchanged.

    Rows that repeat the same id all stay; run exact dedup first to exclude that. A
    component whose ids are all null stays whole.
    """
    groups = near_groups(docs, shingle_words, radius, set_words)
    drop = groups.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
    mark = fresh(docs, "_h")
    drop = durable(drop.select("doc_id", F.col("_h").alias(mark)).distinct())
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return join_on(marked, drop, ["doc_id", mark], "left_anti").select(*docs.columns)
