"""Fill-in-middle transformation: a wavelet matrix over character classes finds both cuts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKERS = ("<P>", "<S>", "<M>")
FIM_PERCENT = 90
SPM_PERCENT = 20
SEED = 1

#: Classes of UTF-8 bytes, in an order that makes each kind of boundary one range of classes:
#: a character starts at every byte but an inner one, a word ends at blanks and breaks.
INNER, WIDE, LETTER, DIGIT, MARK, BLANK, BREAK = range(7)
LEVELS = 3
UNITS = {"characters": WIDE, "words": BLANK, "lines": BREAK}


def byte_classes() -> np.ndarray:
    """Class of each byte value."""
    kinds = np.full(256, MARK, np.uint8)
    for b in range(256):
        if b >= 0x80:
            kinds[b] = INNER if b < 0xC0 else WIDE
        elif chr(b) in "\n\r\x0b\x0c":
            kinds[b] = BREAK
        elif chr(b) in " \t":
            kinds[b] = BLANK
        elif chr(b).isalpha():
            kinds[b] = LETTER
        elif chr(b).isdigit():
            kinds[b] = DIGIT
    return kinds


CLASSES = byte_classes()


class WaveletMatrix:
    """Rank structure over the classes of a byte string.

    A level holds one bit of each class, highest first, as 64-bit words with the number of
    ones before each word; rows are then stably parted by that bit for the next level. It
    takes about an eighth of the text's bytes per level, plus the counts.
    """

    def __init__(self, body: bytes) -> None:
        self.n = len(body)
        row = CLASSES[np.frombuffer(body, np.uint8)]
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(LEVELS)):
            bits = row >> level & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bits
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            one = bits.astype(bool)
            self.zeros.append(self.n - int(one.sum()))
            row = np.concatenate([row[~one], row[one]])

    def _ones(self, level: int, end: int) -> int:
        """Ones among the first ``end`` bits of a level."""
        word, bit = divmod(end, 64)
        rest = int(self.words[level][word]) & (1 << bit) - 1
        return int(self.before[level][word]) + rest.bit_count()

    def rank_from(self, least: int, end: int) -> int:
        """Bytes of a class of at least ``least`` among the first ``end``."""
        found, start = 0, 0
        for level in range(LEVELS):
            ones_start, ones_end = self._ones(level, start), self._ones(level, end)
            if least >> LEVELS - 1 - level & 1:
                start, end = self.zeros[level] + ones_start, self.zeros[level] + ones_end
            else:
                found += ones_end - ones_start
                start, end = start - ones_start, end - ones_end
        return found + end - start

    def units(self, kind: str) -> int:
        return self.rank_from(UNITS[kind], self.n)

    def cut_after(self, kind: str, count: int) -> int:
        """Byte offset after ``count`` units, by bisection on ranks.

        Characters: before the start of the next one. Words and lines: after the blank or
        break that ends the last one.
        """
        least = UNITS[kind]
        total = self.units(kind)
        if count <= 0:
            return 0
        if kind == "characters":
            if count >= total:
                return self.n
            count += 1
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if self.rank_from(least, middle) < count:
                low = middle + 1
            else:
                high = middle
        return low - 1 if kind == "characters" else low


def _draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def arranged(body: bytes, doc_id: int | None, unit: str, markers: list[bytes], fim: int, spm: int, seed: int):
    """(n, form, units of the prefix, units of the middle, output bytes) of one text."""
    matrix = WaveletMatrix(body)
    n = matrix.units(unit)
    h1, h2, h3, h4 = _draws(seed, doc_id)
    if not body or h3 % 100 >= fim or any(m in body for m in markers):
        return n, "plain", None, None, body
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = matrix.cut_after(unit, first), matrix.cut_after(unit, second)
    prefix, middle, suffix = body[:a], body[a:b], body[b:]
    p, s, m = markers
    if h4 % 100 < spm:
        return n, "spm", first, second - first, s + suffix + p + prefix + m + middle
    return n, "psm", first, second - first, p + prefix + s + suffix + m + middle


def transform(docs: DataFrame, unit: str = "characters", markers: tuple[str, str, str] = MARKERS,
              fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output), one row per input row.

    ``form`` is plain (the text itself), psm or spm. Which one, and both cuts, follow from
    the id and the seed alone, so repeated rows and reruns agree. A null text is an empty
    one; an empty text or one that holds a marker stays plain. A null id draws like an id
    without digits. Other columns are ignored; an empty table gives an empty result. Texts
    are handled one at a time, as bytes: memory is a few times the longest text.
    """
    marks = [m.encode() for m in markers]
    if len(set(marks)) < 3 or any(len(m) < 2 or m.count(m[:1]) > 1 or not m.startswith(marks[0][:1]) for m in marks):
        raise ValueError("markers must differ and share a first character that comes nowhere else in them")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_units", "middle_units", "output"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                told = [(i, *arranged(t.as_py() or b"", i, unit, marks, fim_percent, spm_percent, seed))
                        for i, t in zip(ids[at:at + 256], batch.column(1)[at:at + 256], strict=True)]
                columns = zip(*told, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = rows.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_units bigint, middle_units bigint, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: str = "output", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text from an output and its form.

    Pieces hold no marker, and a marker's first character is nowhere else in one, so the
    first place where each marker stands is the inserted one.
    """
    text = F.col(output)
    p, s, m = markers

    def after(column: Column, head: Column, mark: str) -> Column:
        return F.substr(column, F.length(head) + (len(mark) + 1))

    outer = F.substring_index(text, m, 1)
    middle = after(text, outer, m)

    def pieces(one: str, two: str) -> tuple[Column, Column]:
        head = F.substring_index(outer, two, 1)
        return F.substr(head, F.lit(len(one) + 1)), after(outer, head, two)

    prefix, suffix = pieces(p, s)
    suffix_first, prefix_last = pieces(s, p)
    return (F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix))
            .when(F.col(form) == "spm", F.concat(prefix_last, middle, suffix_first)).otherwise(text))
