"""Links between texts whose sets of word shingles have a Jaccard similarity of at least SIMILAR.

An exact prefix search. In any one order of all shingles, two sets that similar share a
shingle among the first n - ceil(0.8 n) + 1 of each one's n. The order is by how often a fixed
slot of the shingle's hash is used, seldom ones first, so it needs one bounded table and
not the count of every shingle. Only these prefix rows are exchanged; whole sets are
read for candidate pairs only. A text without words has no set and no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger.llm.common import components, cut, join_on, once, small_batches, tasks_for
from adledger.operators.skew import lookup

#: Least Jaccard similarity of linked sets, as a fraction.
SIMILAR = (4, 5)
#: Slots of the table of uses, and of the filter before whole sets are read.
USE_SLOTS = 1 << 16
READ_SLOTS = 1 << 18
#: Members of a shingle that are compared in one cell.
CELL = 512
SKETCH_BITS = (64, 1 << 16)
CELL_BITS = 512
#: Pairs of a task that compares whole sketches, each 8 KB at most.
SKETCHED_ROWS = 4096

NODE = "doc_id bigint, _h bigint, sid bigint, n int, sketch binary, small binary"


def needed(n: int | np.ndarray) -> int | np.ndarray:
    """Least overlap of two sets of ``n`` elements together."""
    num, den = SIMILAR
    return -(-n * num // (num + den))


def prefix_length(n: int) -> int:
    num, den = SIMILAR
    return n + -(n * num) // den + 1


class RunHasher:
    """Hashes of all runs of ``size`` words, A-Z lower-cased; of all words if there are fewer.

    Words end at ASCII white space. A word's hash is a polynomial of its bytes modulo 2^64, taken
    from one running sum over the text and the inverse powers of an odd base; a run's hash is a
    polynomial of its words' hashes, mixed. So it depends on the words alone, and the work is a
    few passes over the text's bytes. Two runs of a text may share a hash by chance like in any
    64-bit hash; it never hides an equal run.
    """

    def __init__(self, size: int) -> None:
        self.size = size
        self.byte = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.byte[65:91] = self.byte[97:123]
        self.gap = np.zeros(256, bool)
        self.gap[[32, *range(9, 14)]] = True
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            base = 0x9E3779B97F4A7C15
            for name, step in (("powers", base), ("inverse", pow(base, -1, 1 << 64))):
                row = np.full(n + n // 4, step, np.uint64)
                row[0] = 1
                setattr(self, name, np.cumprod(row))

    def __call__(self, text: str) -> np.ndarray:
        body = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        self._reach(len(body))
        edge = np.diff(np.concatenate([[True], self.gap[body], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(starts):
            return np.empty(0, np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[body] * self.powers[: len(body)])])
        told = (sums[ends] - sums[starts]) * self.inverse[starts]
        told ^= told >> np.uint64(31)
        told *= np.uint64(0x94D049BB133111EB)
        size = min(self.size, len(told))
        runs = np.zeros(len(told) - size + 1, np.uint64)
        for j in range(size):
            runs *= np.uint64(0x9E3779B97F4A7C15)
            runs += told[j:len(told) - size + 1 + j]
        runs ^= runs >> np.uint64(29)
        runs *= np.uint64(0xBF58476D1CE4E5B9)
        return runs ^ (runs >> np.uint64(32))


def sketch_of(values: np.ndarray) -> bytes:
    """Parity of the elements by a few bits of their hash: two sets differ in at least as many
    elements as their sketches in bits. The size follows the set's."""
    least, most = SKETCH_BITS
    bits = min(most, max(least, 1 << (2 * len(values)).bit_length()))
    parity = np.bincount((values >> 20) & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Least number of elements that are in one set only; the longer sketch is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _sets(size: int, column: pa.Array) -> Iterator[np.ndarray]:
    hasher = RunHasher(size)
    for text in column:
        yield np.unique(hasher(text.as_py() or "").view(np.int64))


def small(sketch: bytes) -> bytes:
    """The sketch folded to at most CELL_BITS, for rows that come in numbers."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) * 8 > CELL_BITS:
        x = x[: len(x) // 2] ^ x[len(x) // 2:]
    return x.tobytes()


def set_nodes(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, _h, sid, n, sketch, small): name of the row's set (the same for equal sets), its size and sketches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sids, sizes, sketches = [], [], []
            for s in _sets(size, batch.column(2)):
                sids.append(xxhash.xxh64_intdigest(s.tobytes(), len(s)))
                sizes.append(len(s))
                sketches.append(sketch_of(s))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(np.array(sids, np.uint64).view(np.int64)),
                pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(map(small, sketches), pa.binary())],
                ["doc_id", "_h", "sid", "n", "sketch", "small"])

    return docs.select("doc_id", "_h", "text").mapInArrow(run, NODE)


def slot_uses(docs: DataFrame, size: int) -> np.ndarray:
    """Sets that use each slot: USE_SLOTS numbers, whatever the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(USE_SLOTS, np.int64)
        for batch in batches:
            for s in _sets(size, batch.column(0)):
                uses += np.bincount(s & (USE_SLOTS - 1), minlength=USE_SLOTS)
        slots = np.flatnonzero(uses)
        for at in range(0, len(slots), 8192):
            part = slots[at:at + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(uses[part], pa.int64())], ["slot", "uses"])

    rows = docs.select("text").mapInArrow(run, "slot bigint, uses bigint").groupBy("slot").agg(F.sum("uses").alias("uses"))
    table = np.zeros(USE_SLOTS, np.int64)
    with small_batches(docs.sparkSession):
        found = rows.collect()  # at most USE_SLOTS rows
    for row in found:
        table[row["slot"]] = row["uses"]
    return table


def prefixes(docs: DataFrame, size: int, uses: np.ndarray) -> DataFrame:
    """(x, sid, n, pos): the first shingles of each set in the common order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            held: list[tuple[np.ndarray, int, int]] = []
            for s in _sets(size, batch.column(0)):
                if len(s):
                    first = np.lexsort((s, uses[s & (USE_SLOTS - 1)]))[: prefix_length(len(s))]
                    held.append((s[first], xxhash.xxh64_intdigest(s.tobytes(), len(s)), len(s)))
            if held:
                lengths = [len(h[0]) for h in held]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([h[0] for h in held])),
                    pa.array(np.repeat(np.array([h[1] for h in held], np.uint64).view(np.int64), lengths)),
                    pa.array(np.repeat(np.array([h[2] for h in held], np.int32), lengths)),
                    pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lengths]))], ["x", "sid", "n", "pos"])

    return docs.select("text").mapInArrow(run, "x bigint, sid bigint, n int, pos int")


def possible(n: np.ndarray, pos: np.ndarray, n2: np.ndarray, pos2: np.ndarray) -> np.ndarray:
    """Can sets of these sizes that share the elements at these places be similar enough?"""
    most = np.minimum(pos, pos2) + 1 + np.minimum(n - pos - 1, n2 - pos2 - 1)
    return most >= needed(n + n2)


def compare_cells(rows: DataFrame) -> DataFrame:
    """(sid, n, sid2, n2): pairs inside each (x, i, j) cell that have different roots and may be similar.

    ``rows``: x, i, j, side, n, pos, sid, root, small. A cell is bounded by the caller. In a
    cell of two blocks (i < j) only members of different ``side`` are compared. Rows of a cell
    are sorted by size and compared at distances 1, 2, ... until sizes are too far apart.
    """
    num, den = SIMILAR

    def pairs(at: dict[str, np.ndarray], sketches: pa.Array) -> list[tuple[int, int, int, int]]:
        total, out, step = len(at["x"]), [], 0
        active = np.arange(total)
        while len(active):
            step += 1
            a = active[active + step < total]
            b = a + step
            same = (at["x"][a] == at["x"][b]) & (at["i"][a] == at["i"][b]) & (at["j"][a] == at["j"][b])
            same &= at["n"][b] * num <= at["n"][a] * den
            active, a, b = a[same], a[same], b[same]
            hit = (at["root"][a] != at["root"][b]) & ((at["i"][a] == at["j"][a]) | (at["side"][a] != at["side"][b]))
            hit &= possible(at["n"][a], at["pos"][a], at["n"][b], at["pos"][b])
            for k, m in zip(a[hit].tolist(), b[hit].tolist(), strict=True):
                n, n2 = int(at["n"][k]), int(at["n"][m])
                if apart(sketches[k].as_py(), sketches[m].as_py()) <= n + n2 - 2 * needed(n + n2):
                    out.append((int(at["sid"][k]), n, int(at["sid"][m]), n2))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            at = {c: np.asarray(table[c]) for c in table.column_names if c != "small"}
            found = list(dict.fromkeys(pairs(at, table["small"]))) if table.num_rows else []
            columns = zip(*found, strict=True) if found else ((), (), (), ())
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["sid", "n", "sid2", "n2"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # the last cell of a batch may go on in the next
            key = [np.asarray(batch.column(c)) for c in ("x", "i", "j")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            last = int(change[-1]) if len(change) else 0
            starts_new = bool(held) and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in ("x", "i", "j"))
            if starts_new:
                yield done(held)
                held = []
            if last:
                yield done([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield done(held)

    ordered = rows.repartition("x", "i", "j").sortWithinPartitions("x", "i", "j", "n", "sid")
    return ordered.mapInArrow(run, "sid bigint, n int, sid2 bigint, n2 int")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """The ``pairs`` (sid, n, sid2, n2) of sufficient similarity, by whole sets.

    Sets are made again for documents that pass a hash filter of fixed size; a full filter
    passes all, and the join after it decides.
    """
    pairs = cut(pairs)
    wanted = cut(pairs.select("sid").union(pairs.select("sid2")).distinct().join(nodes, "sid").select("sid", "doc_id", "_h"))

    def slot() -> Column:
        return F.pmod(F.xxhash64("doc_id", "_h"), F.lit(READ_SLOTS)).alias("_slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            sets = list(_sets(size, batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "_h", "shingles"])

    slots = wanted.select(slot()).distinct()
    read = docs.select("doc_id", "_h", "text", slot()).join(F.broadcast(slots), "_slot", "left_semi")  # at most READ_SLOTS rows
    made = read.select("doc_id", "_h", "text").mapInArrow(run, "doc_id bigint, _h bigint, shingles array<bigint>")
    with small_batches(docs.sparkSession):
        of = once(cut(join_on(made, wanted, ["doc_id", "_h"]).select("sid", "shingles")), ["sid"])
    sides = pairs.select("sid", "sid2", F.explode(F.array("sid", "sid2")).alias("_of"))
    # a set that many pairs ask for is copied in as many tasks as there are salts
    both = lookup(sides, of.withColumnRenamed("sid", "_of"), "_of", F.xxhash64("sid", "sid2"))
    both = both.groupBy("sid", "sid2").agg(F.min("shingles").alias("a"), F.max("shingles").alias("b"))
    num, den = SIMILAR
    common, total = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    return both.where(common * (num + den) >= total * num).select("sid", "sid2")


def similar_links(docs: DataFrame, rows: DataFrame, size: int, roots: DataFrame) -> DataFrame:
    """(u, v) between the ``fp`` of texts that are linked by equal or similar sets.

    ``docs``: doc_id, _h, text. ``rows``: the same documents as doc_id, _h, fp, sid, n, sketch, small.
    ``roots`` (fp, root): what is linked already. With the links given, the components are those
    of all similar pairs. All members of a shared shingle are compared with one of them first,
    so a group of near copies is linked without comparing every two; then those that still have
    different roots, in cells of bounded size. The one is that in whose order the shingle comes
    earliest: few seldom shingles stand before it, so it has few changes and is the centre of copies
    that are near it, but not near each other.
    """
    rows = rows.where("n > 0")
    nodes = cut(rows.groupBy("sid").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("small").alias("small"),
                                        F.min(F.struct("doc_id", "_h")).alias("_key")).select("sid", "fp", "n", "sketch", "small", "_key.*"))
    same = rows.select("sid", "fp").distinct().join(nodes.select("sid", F.col("fp").alias("v")), "sid").where("fp <> v")
    same = cut(same.select(F.col("fp").alias("u"), "v"))
    uses = slot_uses(docs, size)
    head = prefixes(docs, size, uses)
    with small_batches(docs.sparkSession):
        shared = cut(head.groupBy("x").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a < b").select("x"))
        members = cut(head.join(shared, "x").select("x", "sid", "n", "pos").distinct())
    spark = docs.sparkSession
    few = tasks_for(spark, max(members.count(), nodes.count()))
    fp_of, sketch_by = nodes.select("sid", "fp"), nodes.select("sid", "sketch")

    def mixed(roots: DataFrame) -> DataFrame:
        """Members, with their root, of shingles that still have several roots: and m, the number, and the pivot."""
        named = cut(fp_of.join(roots, "fp", "left").select("sid", F.coalesce("root", "fp").alias("root")).coalesce(few))
        rooted = lookup(members, named, "sid", "x", few)
        pivots = rooted.groupBy("x").agg(F.min(F.struct("pos", "root", "sid", "n")).alias("pivot"),
                                         F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("m"))
        return lookup(rooted, cut(pivots.where("least <> most").drop("least", "most").coalesce(few)), "x", "sid", few).where("pivot is not null")

    def links(pairs: DataFrame) -> DataFrame:
        """Pairs of sids as pairs of their fingerprints."""
        left = pairs.join(fp_of.withColumnRenamed("fp", "u"), "sid")
        return cut(left.join(fp_of.select(F.col("sid").alias("sid2"), F.col("fp").alias("v")), "sid2").select("u", "v").where("u <> v").coalesce(few))

    def sketched(pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches do not rule them out, with the distance ``d`` of these."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, n2 = np.asarray(batch.column(1)), np.asarray(batch.column(3))
                most = (n + n2 - 2 * needed(n + n2)).tolist()
                d = [apart(a.as_py(), b.as_py()) for a, b in zip(batch.column(4), batch.column(5), strict=True)]
                near = [k <= m for k, m in zip(d, most, strict=True)]
                told = batch.select(["sid", "n", "sid2", "n2"]).add_column(4, "d", pa.array(d, pa.int32()))
                yield told.filter(pa.array(near, pa.bool_()))

        tasks = tasks_for(spark, pairs.count(), SKETCHED_ROWS)
        both = lookup(lookup(pairs, sketch_by, "sid", "sid2", tasks), sketch_by.select(F.col("sid").alias("sid2"), F.col("sketch").alias("sketch2")), "sid2", "sid", tasks)
        return both.select("sid", "n", "sid2", "n2", "sketch", "sketch2").mapInArrow(run, "sid bigint, n int, sid2 bigint, n2 int, d int")

    num, den = SIMILAR
    star = mixed(roots).where("root <> pivot.root").select("sid", "n", "pos", *[F.col(f"pivot.{c}").alias(f"{c}2") for c in ("sid", "n", "pos")])
    overlap = F.least("pos", "pos2") + 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("n2") - F.col("pos2") - 1)
    star = star.where((overlap * (num + den) >= (F.col("n") + F.col("n2")) * num) & (F.least("n", "n2") * den >= F.greatest("n", "n2") * num))
    star = sketched(cut(star.select("sid", "n", "sid2", "n2").distinct()))
    one = star.groupBy("sid", "n").agg(F.min(F.struct("d", "sid2", "n2")).alias("_to")).select("sid", "n", "_to.sid2", "_to.n2")
    first = same.union(links(verified(one, docs, nodes, size)))
    rest = mixed(widened(roots, first)).withColumn("_k", F.ceil(F.col("m") / F.lit(CELL)).cast("int"))
    rest = rest.withColumn("side", F.pmod(F.xxhash64("sid"), F.col("_k")).cast("int"))
    rest = rest.select("x", "sid", "n", "pos", "root", "side", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_other"))
    rest = lookup(rest, nodes.select("sid", "small"), "sid", "x").select("x", F.least("side", "_other").alias("i"), F.greatest("side", "_other").alias("j"), "side", "n", "pos", "sid", "root", "small")
    second = compare_cells(rest).select(*[F.when(F.col("sid") <= F.col("sid2"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in
                                          (("sid", "sid2"), ("n", "n2"), ("sid2", "sid"), ("n2", "n"))]).distinct()
    return first.union(links(verified(sketched(cut(second)).drop("d"), docs, nodes, size)))


def widened(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots (fp, root) of the components by ``roots`` and further ``links`` (u, v)."""
    edges = roots.select(F.col("fp").alias("u"), F.col("root").alias("v")).union(links.select("u", "v"))
    return cut(components(edges).withColumnRenamed("node", "fp"))
