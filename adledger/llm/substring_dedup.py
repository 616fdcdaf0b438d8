"""Substring dedup: fixed-block anchors, rolling probes, hits extended to maximal exact repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adledger.llm.common import stored

WINDOW_WORDS = 13
#: Words a map task gathers before it sends them off.
CHUNK_WORDS = 1_500_000
#: Hashes a bucket holds on average, at most; the number of buckets follows the input.
BUCKET_LOAD = 1_000_000
LEAST_BUCKET_BITS = {"probe": 10, "extend": 8}
HITS_A_ROW = 32_768
NO_ID = -(1 << 63)
KNOWN_WORDS = 1_000_000
U32, U64 = np.dtype("<u4"), np.dtype("<u8")
# odd multipliers of the rolling polynomials: blocks, windows, windows again
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


class _WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def rolling(hashes: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Mixed polynomial hash of every run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    total = np.zeros(n, U64)
    f = np.uint64(factor)
    with np.errstate(over="ignore"):
        for i in range(width):
            total = total * f + hashes[i:i + n]
        total ^= total >> np.uint64(31)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(29)
    return total


def block_words(window_words: int) -> int:
    """Longest block of which every window holds one whole at a multiple of its length."""
    return (window_words + 1) // 2


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


MESSAGE = [("kind", pa.int8()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
MESSAGE_SCHEMA = "kind tinyint, bucket int, chunk bigint, a binary, b binary, c binary"
IDS, ENTRIES, HITS = 0, 1, 2


def _slices(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and bounds in an array of sorted 64-bit keys."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    found, starts = np.unique(bucket, return_index=True)
    return found, np.append(starts, len(keys))


def _messages(rows: DataFrame, window_words: int, bits: int) -> DataFrame:
    """Index blocks and rolling probes of each chunk of documents, by bucket of their hash.

    A chunk states each hash once. What two of its documents share is known at once and
    goes out as hits; the rest as presence, or as an anchor that waits for an answer.
    """
    block = block_words(window_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words = _WordHashes()
        number = 0
        ids: list[tuple[int, int]] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = (part << 24) + number
            mask = (1 << bits) - 1
            sizes = [len(p) for p in parts]
            doc = np.repeat(np.arange(len(parts), dtype=np.uint32), sizes)
            first = np.concatenate([np.arange(s) for s in sizes])
            keys = np.concatenate(parts)
            anchor = first % block == 0
            order = np.argsort(keys, kind="stable")
            keys, doc, anchor = keys[order], doc[order], anchor[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            ends = np.append(starts[1:], len(keys))
            shared = doc[starts] != doc[ends - 1]
            anchored = np.logical_or.reduceat(anchor, starts)
            local = np.repeat(shared, ends - starts) & anchor
            out = [(IDS, chunk & mask, chunk, np.array([i for i, _ in ids], "<i8").tobytes(), np.array([h for _, h in ids], "<i8").tobytes(), None)]
            if local.any():
                out.append((HITS, chunk & mask, chunk, keys[local].tobytes(), None, doc[local].astype(U32).tobytes()))
            one, asks, who = keys[starts], anchored & ~shared, doc[starts].astype(U32)
            found, bounds = _slices(one, bits)
            short = ((one << np.uint64(bits)) >> np.uint64(32)).astype(U32)
            for i, b in enumerate(found.tolist()):
                cut = slice(bounds[i], bounds[i + 1])
                ask = asks[cut]
                out.append((ENTRIES, b, chunk, short[cut][~ask].tobytes(), short[cut][ask].tobytes(), who[cut][ask].tobytes()))
            for at in range(0, len(out), 2048):
                yield _batch(out[at:at + 2048], MESSAGE)

        for batch in batches:
            for doc_id, h, text in zip(*batch.columns, strict=True):
                found = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if len(found) < window_words:
                    continue
                ids.append((doc_id.as_py(), h.as_py()))
                parts.append(rolling(words.of(found), block, FACTORS[0]))
                held += len(found)
                if held >= CHUNK_WORDS:
                    yield from flush()
                    number, ids, parts, held = number + 1, [], [], 0
        if parts:
            yield from flush()

    return rows.mapInArrow(run, MESSAGE_SCHEMA)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Consecutive rows with an equal key."""
    last, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != last and held:
                yield last, held
                held = []
            last = row[key]
            held.append(row)
    if held:
        yield last, held


def _answers(messages: DataFrame, bits: int) -> DataFrame:
    """Anchors whose hash another chunk has too, as hits of their chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(batches, "bucket"):
            out = [(r["kind"], 0, r["chunk"], r["a"], r["b"], r["c"]) for r in rows if r["kind"] != ENTRIES]
            entries = [r for r in rows if r["kind"] == ENTRIES]
            if len(entries) > 1:
                seen = np.sort(np.concatenate([np.frombuffer(r[x], U32) for r in entries for x in "ab"]))
                twice = seen[1:][seen[1:] == seen[:-1]]
                for r in entries:
                    asked = np.frombuffer(r["b"], U32)
                    if len(asked) and len(twice):
                        at = np.searchsorted(twice, asked)
                        hit = twice[np.minimum(at, len(twice) - 1)] == asked
                        if hit.any():
                            keys = (np.uint64(bucket) << np.uint64(64 - bits)) | (asked[hit].astype(U64) << np.uint64(32 - bits))
                            out.append((HITS, 0, r["chunk"], keys.tobytes(), None, np.frombuffer(r["c"], U32)[hit].tobytes()))
            yield _batch(out, MESSAGE)

    return messages.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, MESSAGE_SCHEMA)


KEYS = [("did", pa.int64()), ("_h", pa.int64()), ("keys", pa.binary())]
KEYS_SCHEMA = "did bigint, _h bigint, keys binary"


def _by_document(hits: DataFrame) -> DataFrame:
    """Hits of a chunk as (did, _h, keys) rows of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "chunk"):
            ids = np.concatenate([np.frombuffer(r["a"], "<i8") for r in rows if r["kind"] == IDS])
            hs = np.concatenate([np.frombuffer(r["b"], "<i8") for r in rows if r["kind"] == IDS])
            told = [r for r in rows if r["kind"] == HITS]
            if not told:
                continue
            keys = np.concatenate([np.frombuffer(r["a"], U64) for r in told])
            who = np.concatenate([np.frombuffer(r["c"], U32) for r in told])
            order = np.argsort(who, kind="stable")
            keys, who = keys[order], who[order]
            docs, starts = np.unique(who, return_index=True)
            ends = np.append(starts[1:], len(who))
            out = [(int(ids[d]), int(hs[d]), keys[a:b].tobytes()) for d, a, b in zip(docs.tolist(), starts, ends, strict=True)]
            for at in range(0, len(out), 1000):
                yield _batch(out[at:at + 1000], KEYS)

    return hits.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, KEYS_SCHEMA)


def _packed(rows: DataFrame) -> DataFrame:
    """(did, _h, z): texts compressed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            z = [press((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["did", "_h", "z"])

    return rows.mapInArrow(run, "did bigint, _h bigint, z binary")


def _joined_keys(cell: list[bytes] | None) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(k, U64) for k in cell])) if cell else np.empty(0, U64)


def candidate_starts(words: np.ndarray, hit: np.ndarray, window_words: int, bits: int) -> np.ndarray:
    """Starts of the windows whose first whole block at a multiple of its length is a hit."""
    block = block_words(window_words)
    n = len(words) - window_words + 1
    keep = np.uint64(32 - bits)
    keys = (rolling(words, block, FACTORS[0])[::block] >> keep) << keep
    is_hit = np.isin(keys, (hit >> keep) << keep)
    starts = np.arange(n)
    return starts[is_hit[-(-starts // block)]]


CHECKED = [("did", pa.int64()), ("_h", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("n_candidates", pa.int64()), ("z", pa.binary()), ("starts", pa.binary())]
CHECKED_SCHEMA = "did bigint, _h bigint, n_words bigint, kept_sha256 string, n_candidates bigint, z binary, starts binary"


def _checked(joined: DataFrame, window_words: int, bits: int) -> DataFrame:
    """Documents without candidate windows done; the others with their text and candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        hashes = _WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                out = []
                for row in whole.slice(at, 500).to_pylist():
                    words = open_(row["z"]).split()
                    hit = _joined_keys(row["keys"])
                    starts = np.empty(0, np.int64)
                    if len(hit) and len(words) >= window_words:
                        starts = candidate_starts(hashes.of(words), hit, window_words, bits)
                    if len(starts):
                        out.append((row["did"], row["_h"], len(words), None, len(starts), row["z"], starts.astype(U32).tobytes()))
                    else:
                        out.append((row["did"], row["_h"], len(words), hashlib.sha256(b" ".join(words)).hexdigest(), 0, None, None))
                yield _batch(out, CHECKED)

    return joined.mapInArrow(run, CHECKED_SCHEMA)


WINDOWS = [("kind", pa.int8()), ("bucket", pa.int32()), ("did", pa.binary()), ("h", pa.binary()), ("sizes", pa.binary()), ("a", pa.binary()), ("b", pa.binary())]
WINDOWS_SCHEMA = "kind tinyint, bucket int, did binary, h binary, sizes binary, a binary, b binary"


def _windows(candidates: DataFrame, window_words: int, bits: int) -> DataFrame:
    """Digests of the candidate windows by bucket: per chunk and window, the smallest id asks
    whether another chunk has a smaller one; larger ids in the chunk are repeats already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        hashes = _WordHashes()
        ids: list[tuple[int, int]] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def rows_of(kind: int, bucket: int, who: np.ndarray, a: np.ndarray, b: np.ndarray | None):
            docs, sizes = np.unique(who, return_counts=True)
            return (kind, bucket, np.array([ids[d][0] for d in docs], "<i8").tobytes(), np.array([ids[d][1] for d in docs], "<i8").tobytes(),
                    sizes.astype(U32).tobytes(), a.tobytes(), None if b is None else b.tobytes())

        def flush() -> Iterator[pa.RecordBatch]:
            a = np.concatenate([p[0] for p in parts])
            b = np.concatenate([p[1] for p in parts])
            who = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            did = np.array([i for i, _ in ids], np.int64)[who]
            order = np.lexsort((did, b, a))
            a, b, who, did = a[order], b[order], who[order], did[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            least = did[new][np.cumsum(new) - 1]
            repeat = did > least
            out = []
            r = np.flatnonzero(repeat)
            if len(r):
                r = r[np.argsort(who[r], kind="stable")]
                for at in range(0, len(r), HITS_A_ROW):  # spread over the buckets, whose numbers mean nothing to hits
                    piece = r[at:at + HITS_A_ROW]
                    out.append(rows_of(HITS, int(a[piece[0]] & np.uint64((1 << bits) - 1)), who[piece], a[piece], None))
            asks = np.flatnonzero(~repeat)
            found, bounds = _slices(a[asks], bits)
            for i, bucket in enumerate(found.tolist()):
                cut = asks[bounds[i]:bounds[i + 1]]
                cut = cut[np.argsort(who[cut], kind="stable")]
                out.append(rows_of(ENTRIES, bucket, who[cut], a[cut], b[cut]))
            for at in range(0, len(out), 512):
                yield _batch(out[at:at + 512], WINDOWS)

        for batch in batches:
            for row in batch.to_pylist():
                words = hashes.of(open_(row["z"]).split())
                starts = np.frombuffer(row["starts"], U32)
                one = rolling(words, window_words, FACTORS[1])[starts]
                two = (rolling(words, window_words, FACTORS[2])[starts] >> np.uint64(32)).astype(U32)
                _, first = np.unique(one, return_index=True)  # a window repeated inside its text asks once
                ids.append((row["did"], row["_h"]))
                parts.append((one[first], two[first]))
                held += len(first)
                if held >= CHUNK_WORDS:
                    yield from flush()
                    ids, parts, held = [], [], 0
        if parts:
            yield from flush()

    return candidates.select("did", "_h", "z", "starts").mapInArrow(run, WINDOWS_SCHEMA)


def _repeats(windows: DataFrame) -> DataFrame:
    """(did, _h, keys): digests of the windows of a document that start in one with a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "bucket"):
            out = []
            read = lambda r: (np.frombuffer(r["did"], "<i8"), np.frombuffer(r["h"], "<i8"), np.frombuffer(r["sizes"], U32), np.frombuffer(r["a"], U64))
            for r in rows:
                if r["kind"] == HITS:
                    did, h, sizes, a = read(r)
                    ends = np.cumsum(sizes)
                    out += [(int(d), int(x), a[e - s:e].tobytes()) for d, x, s, e in zip(did, h, sizes.tolist(), ends.tolist(), strict=True)]
            entries = [r for r in rows if r["kind"] == ENTRIES]
            if len(entries) > 1:
                dids, hs, sizes, a = (np.concatenate(x) for x in zip(*map(read, entries), strict=True))
                b = np.concatenate([np.frombuffer(r["b"], U32) for r in entries])
                who = np.repeat(np.arange(len(dids)), sizes)
                order = np.lexsort((b, a))
                sa, sb, sd = a[order], b[order], dids[who[order]]
                starts = np.flatnonzero(np.concatenate([[True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])]))
                least = np.repeat(np.minimum.reduceat(sd, starts), np.diff(np.append(starts, len(sa))))
                repeat = order[sd > least]
                if len(repeat):
                    repeat = repeat[np.argsort(who[repeat], kind="stable")]
                    docs, first = np.unique(who[repeat], return_index=True)
                    ends = np.append(first[1:], len(repeat))
                    out += [(int(dids[d]), int(hs[d]), a[repeat[s:e]].tobytes()) for d, s, e in zip(docs.tolist(), first, ends, strict=True)]
            for at in range(0, len(out), 2000):
                yield _batch(out[at:at + 2000], KEYS)

    return windows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, KEYS_SCHEMA)


DONE_SCHEMA = "did bigint, _h bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:int,end:int>>, kept_text string"


def _removed(joined: DataFrame, window_words: int, with_text: bool) -> DataFrame:
    """Texts without the words of their repeats; consecutive repeats merged to maximal spans."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    fields = [("did", pa.int64()), ("_h", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", span), ("kept_text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        hashes = _WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                out = []
                for row in whole.slice(at, 500).to_pylist():
                    words = open_(row["z"]).split()
                    repeats = _joined_keys(row["keys"])
                    starts = np.frombuffer(row["starts"], U32).astype(np.int64)
                    starts = starts[np.isin(rolling(hashes.of(words), window_words, FACTORS[1])[starts], repeats)]
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window_words, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    spans = [{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)]
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    out.append((row["did"], row["_h"], len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans, kept.decode("utf-8", "replace") if with_text else None))
                yield _batch(out, fields)

    return joined.mapInArrow(run, DONE_SCHEMA)


def _bits(total: int, what: str) -> int:
    return min(31, max(LEAST_BUCKET_BITS[what], int(total // BUCKET_LOAD).bit_length()))


def repeated_words(docs: DataFrame, window_words: int = WINDOW_WORDS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans and (``with_text``) kept_text per row of ``docs``.

    A word goes if it is covered by a window of ``window_words`` words whose sequence also
    starts in a document with a smaller doc_id. spans are the maximal removed runs
    [start, end) of word numbers.

    1. Every document's blocks of half a window at multiples of their length are the index;
       every rolling block of every document probes it. Each window holds such a block
       whole, so a sequence found in two documents makes that block a hit in both. Map
       tasks send each hash once per chunk, in 4 bytes, and answer shared ones themselves.
    2. A hit is extended to the windows around its block. They are compared by 96 bits of
       digest; the smallest id of each is found, again combined in the chunks first.
    3. Windows with a smaller id elsewhere are merged and cut out.

    A hash that all documents share travels once per chunk. Null and empty texts have no
    words; a null doc_id counts as smaller than any; rows that repeat an id do not repeat
    each other. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("did"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), "text")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _bits(n_bytes // 6, "probe")
    hits = _by_document(_answers(_messages(rows, window_words, bits), bits))
    per_doc = hits.groupBy("did", "_h").agg(F.collect_list("keys").alias("keys"))
    checked = stored(_checked(_packed(rows).join(per_doc, ["did", "_h"], "left"), window_words, bits), "checked")
    clean = checked.where("n_candidates = 0")
    candidates = checked.where("n_candidates > 0")
    n_windows = candidates.agg(F.sum("n_candidates")).first()[0] or 0
    found = _repeats(_windows(candidates, window_words, _bits(n_windows, "extend")))
    found = found.groupBy("did", "_h").agg(F.collect_list("keys").alias("keys"))
    cut = _removed(candidates.select("did", "_h", "z", "starts").join(found, ["did", "_h"], "left"), window_words, with_text)
    if with_text:
        plain = _removed(_packed(rows).join(clean.select("did", "_h").distinct(), ["did", "_h"], "left_semi").select(
            "did", "_h", "z", F.lit(b"").alias("starts"), F.lit(None).cast("array<binary>").alias("keys")), window_words, True)
    else:
        plain = clean.select("did", "_h", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept_sha256",
                             F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(None).cast("string").alias("kept_text"))
    out = plain.union(cut).withColumn("doc_id", F.when(F.col("did") != NO_ID, F.col("did")))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "spans", *(["kept_text"] if with_text else []))
