"""Byte-level BPE encoding and decoding by a monoid tree reduction over each text."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LEAF_CHARS = 8192
WINDOW_CHARS = 32
CACHED_WORDS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def is_cut(text: str, i: int) -> bool:
    """True if, whatever stands further left or right, a pattern match starts at ``i``.

    A space before a visible character: no alternative of the pattern has white space
    after its first character except the two white-space ones. ``\\s+(?!\\S)`` cannot
    end just after this space, as a visible character follows, and gives the space
    back; a bare ``\\s+`` is tried only for a single white-space character that no
    other alternative takes, but one of them takes a space with a visible character.
    So the space begins a match, and what precedes it is matched as if the text ended
    there. Visible: not white space to the pattern, which str.isspace() covers.
    """
    return text[i] == " " and i + 1 < len(text) and not text[i + 1].isspace()


def tree_encoder(encode: Callable[[str], list[int]], leaf_chars: int = LEAF_CHARS,
                 window_chars: int = WINDOW_CHARS) -> Callable[[str], list[int]]:
    """Encode halves recursively and join neighbours.

    A join re-encodes the text between the last cut in the left half and the first cut
    in the right half. It looks for them in a window at the seam that doubles until it
    has both or holds the whole half. By ``is_cut`` the tokens outside are those of the
    whole text: each half's ids are kept but for those of its part of the window.
    """

    def left_cut(text: str, lo: int, mid: int) -> int:
        size = window_chars
        while True:
            start = max(lo, mid - size)
            for i in range(mid - 2, start - 1, -1):
                if is_cut(text, i):
                    return i
            if start == lo:
                return lo
            size *= 2

    def right_cut(text: str, mid: int, hi: int) -> int:
        size = window_chars
        while True:
            end = min(hi, mid + size)
            for i in range(mid, end - 1):
                if is_cut(text, i):
                    return i
            if end == hi:
                return hi
            size *= 2

    def run(text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf_chars:
            return encode(text[lo:hi])
        mid = (lo + hi) // 2
        left, right = run(text, lo, mid), run(text, mid, hi)
        a, b = left_cut(text, lo, mid), right_cut(text, mid, hi)
        seam = encode(text[a:b])
        drop_left, drop_right = len(encode(text[a:mid])), len(encode(text[mid:b]))
        del left[len(left) - drop_left:]
        left += seam
        left += right[drop_right:] if drop_right else right
        return left

    return lambda text: run(text, 0, len(text))


def word_encoder(encode: Callable[[str], list[int]], cached: int = CACHED_WORDS) -> Callable[[str], list[int]]:
    """``encode`` for leaves, through a bounded cache of the strings between cuts."""
    known: dict[str, list[int]] = {}

    def leaf(text: str) -> list[int]:
        ids: list[int] = []
        first = True
        for word in text.split(" "):
            if not first:
                word = " " + word
            first = False
            if len(word) == 1 and word == " " or word[1:2].isspace():
                return encode(text)  # spaces in a row or at the end: not all of them are cuts
            got = known.get(word)
            if got is None:
                got = encode(word)
                if len(word) < 64:
                    if len(known) >= cached:
                        known.clear()
                    known[word] = got
            ids += got
        return ids

    return leaf


def tree_decoder(vocabulary: list[bytes], leaf_ids: int = LEAF_CHARS) -> Callable[[list[int]], bytes]:
    """Concatenate token bytes up a tree over the ids; exact for any id sequence."""

    def run(ids: list[int], lo: int, hi: int) -> bytes:
        if hi - lo <= leaf_ids:
            return b"".join(map(vocabulary.__getitem__, ids[lo:hi]))
        mid = (lo + hi) // 2
        return run(ids, lo, mid) + run(ids, mid, hi)

    return lambda ids: run(ids, 0, len(ids))


def codec(path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
    """(encode, decode) of whole texts for a tiktoken rank file and pattern."""
    import tiktoken

    ranks = read_ranks(path)
    plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    vocabulary = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        vocabulary[rank] = token
    return tree_encoder(word_encoder(plain.encode_ordinary), leaf_chars), tree_decoder(vocabulary, leaf_chars)


def encode_texts(docs: DataFrame, path: str, pattern: str, keep: list[str], leaf_chars: int = LEAF_CHARS,
                 with_ids: bool = True) -> DataFrame:
    """``keep`` columns plus ids (array<int>, if ``with_ids``), n_tokens, ids_sha256 (of the decimal
    ids joined by a space) and decoded_sha256 (of the bytes the ids decode to).

    One output row per row; null and empty texts have no ids. Works row by row on bounded
    batches without a shuffle; memory holds one text and its ids. The rank file is read in
    each task from the installed package, as ``path`` names it.
    """
    source = docs.select(*keep, docs["text"].alias("_text"))
    kept = source.drop("_text").schema
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields]
    schema = ", ".join(fields + (["ids array<int>"] if with_ids else []) + ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = codec(path, pattern, leaf_chars)
        digits: list[str] = [str(i) for i in range(1 << 17)]
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                ids_of, counts, ids_sha, out_sha = [], [], [], []
                for text in batch.column(batch.num_columns - 1):
                    ids = encode(text.as_py() or "")
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                    out_sha.append(hashlib.sha256(decode(ids)).hexdigest())
                    if with_ids:
                        ids_of.append(pa.array(ids, pa.int32()))
                columns = [batch.column(i) for i in range(batch.num_columns - 1)]
                if with_ids:
                    lengths = [0]
                    for c in counts:
                        lengths.append(lengths[-1] + c)
                    flat = pa.concat_arrays(ids_of) if ids_of else pa.array([], pa.int32())
                    columns.append(pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat))
                columns += [pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(out_sha)]
                names = [f.name for f in kept.fields] + (["ids"] if with_ids else []) + ["n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)


def decode_ids(frame: DataFrame, path: str, pattern: str, keep: list[str], ids_col: str = "ids",
               leaf_ids: int = LEAF_CHARS) -> DataFrame:
    """``keep`` columns plus decoded (binary): the bytes of each row's ids; null ids give empty bytes."""
    source = frame.select(*keep, frame[ids_col].alias("_ids"))
    kept = source.drop("_ids").schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields] + ["decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decode = codec(path, pattern, leaf_ids)
        for batch in batches:
            done = [decode(ids.as_py() or []) for ids in batch.column(batch.num_columns - 1)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(done, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept.fields] + ["decoded"])

    return source.mapInArrow(run, schema)
