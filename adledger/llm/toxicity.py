"""Toxicity: a learned weighted lexicon matched by Aho-Corasick on folded text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adledger.llm.quality import remainder
from adledger.session import durable

# Characters read as another letter. i stands for i, l, 1 and |.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l",
    "ø": "o", "æ": "ae", "œ": "oe",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
MARKS_INSIDE = {"$": "s", "@": "a", "!": "i", "|": "i", "+": "t"}
INVISIBLE = "­​‌‍⁠﻿"

#: Labelled training rows the lexicon is learned from, at most; chosen by a hash of the id.
FIT_ROWS = 40_000
MAX_TERMS = 5_000
MIN_LOG_ODDS = 2.0
MIN_CONTEXTS = 6
MIN_CONTEXT_SHARE = 0.002
THRESHOLD = 0.3


def _fold_table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        out[cp] = base.lower()
    for cp in range(0x300, 0x370):
        out[cp] = None
    for a, b in {**HOMOGLYPHS, **DIGITS}.items():
        out[ord(a)] = b
    out |= {ord(c): None for c in INVISIBLE}
    out[ord("l")] = "i"
    return {k: v.replace("l", "i") if v else v for k, v in out.items()}


def folder():
    """Function that folds case, accents, homoglyphs and digit substitutions of a text."""
    table = _fold_table()
    marks = re.compile(r"(?<=[^\W_])[$@!|+](?=[^\W_])")

    def fold(text: str) -> str:
        text = text.lower()
        if any(c in text for c in "$@!|+"):
            text = marks.sub(lambda m: MARKS_INSIDE[m[0]], text)
        return text.translate(table)

    return fold


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: list[float] = field(default_factory=lambda: [0.0] * 4)
    bias: float = 0.0


def matcher(lexicon: Lexicon):
    """Function text -> features: weights of the whole-word matches outside exception
    phrases as sum, sum per 100 words, largest, and number of different terms."""
    import ahocorasick

    fold = folder()
    automaton = ahocorasick.Automaton()
    for term, weight in lexicon.weights.items():
        automaton.add_word(term, (len(term), weight))
    for phrase in lexicon.exceptions:
        automaton.add_word(phrase, (len(phrase), None))
    if len(automaton):
        automaton.make_automaton()

    def features(text: str) -> list[float]:
        if not len(automaton) or not text:
            return [0.0] * 4
        folded = fold(text)
        hits, covered = [], []
        n = len(folded)
        for end, (size, weight) in automaton.iter(folded):
            start = end - size + 1
            if (start and folded[start - 1].isalnum()) or (end + 1 < n and folded[end + 1].isalnum()):
                continue
            if weight is None:
                covered.append((start, end))
            else:
                hits.append((start, end, weight))
        if covered:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in covered)]
        if not hits:
            return [0.0] * 4
        total = sum(h[2] for h in hits)
        words = text.count(" ") + text.count("\n") + 1
        return [float(np.log1p(total)), float(np.log1p(100.0 * total / words)), max(h[2] for h in hits) / 10.0,
                float(np.log1p(len({folded[a:b + 1] for a, b, _ in hits})))]

    return features


WORD = r"\w+"


def _training(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, fit_rows: int) -> DataFrame:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(remainder(F.col("doc_id"), modulus) != held_out)
    chosen = durable(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    return docs.join(F.broadcast(chosen), "doc_id")  # at most fit_rows rows of an id and a label


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, fit_rows: int = FIT_ROWS) -> Lexicon:
    """Lexicon, exception phrases and score curve from labelled rows outside the held-out fold.

    A term's weight is its smoothed log-odds between toxic and clean documents. It must be
    seen after several different words in toxic documents, so words of one much-copied
    text do not count. Exception phrases are a term with a neighbour that clean documents
    use at least three times and toxic ones never. The driver gets at most ``MAX_TERMS``
    terms, as many phrases, and four numbers for each of at most ``fit_rows`` rows.
    """
    training = _training(docs, labels, modulus, held_out, fit_rows)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, pattern = folder(), re.compile(WORD)
        for batch in batches:
            clean: Counter = Counter()
            toxic: dict[tuple[str, str], int] = {}
            rows_toxic, rows_clean = 0, 0
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                found = pattern.findall(fold(text.as_py() or ""))
                if y.as_py():
                    rows_toxic += 1
                    before: dict[str, str] = {}
                    for prev, word in zip(["", *found], found, strict=False):
                        before.setdefault(word, prev)
                    for word, prev in before.items():
                        toxic[word, prev] = toxic.get((word, prev), 0) + 1
                else:
                    rows_clean += 1
                    clean.update(set(found))
            out = [("", None, rows_toxic, rows_clean)]
            out += [(w, p, n, 0) for (w, p), n in toxic.items()] + [(w, None, 0, n) for w, n in clean.items()]
            w, p, t, c = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(p, pa.string()), pa.array(t, pa.int64()), pa.array(c, pa.int64())],
                                             ["word", "prev", "toxic", "clean"])

    counts = training.select("text", "toxic").mapInArrow(words, "word string, prev string, toxic bigint, clean bigint")
    tally = durable(counts.groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.approx_count_distinct("prev").alias("contexts")).where("toxic > 0"))
    rows = tally.where("word = ''").first()
    if rows is None or not rows.clean:
        return Lexicon()
    odds = F.log((F.col("toxic") + 0.5) / (rows.toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (rows.clean + 1.0))
    chosen = (
        tally.where((F.length("word") > 2) & (F.col("contexts") >= max(MIN_CONTEXTS, MIN_CONTEXT_SHARE * rows.toxic)))
        .select("word", odds.alias("weight")).where(F.col("weight") >= MIN_LOG_ODDS)
        .orderBy(F.desc("weight"), "word").limit(MAX_TERMS).collect()
    )
    lexicon = Lexicon({r.word: r.weight for r in chosen})
    if not chosen:
        return lexicon

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, pattern = folder(), re.compile(WORD)
        for batch in batches:
            seen: Counter = Counter()
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                folded = fold(text.as_py() or "")
                spans = [m.span() for m in pattern.finditer(folded)]
                for i, (a, b) in enumerate(spans):
                    if folded[a:b] in lexicon.weights:
                        for left, right in ((i - 1, i), (i, i + 1)):
                            if left >= 0 and right < len(spans):
                                seen[folded[spans[left][0]:spans[right][1]], y.as_py()] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([seen[k] if k[1] else 0 for k in keys], pa.int64()),
                 pa.array([0 if k[1] else seen[k] for k in keys], pa.int64())], ["phrase", "toxic", "clean"])

    used = training.select("text", "toxic").mapInArrow(phrases, "phrase string, toxic bigint, clean bigint")
    lexicon.exceptions = [r.phrase for r in used.groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
                          .where("t = 0 and c >= 3").orderBy(F.desc("c"), "phrase").limit(MAX_TERMS).collect()]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = matcher(lexicon)
        for batch in batches:
            rows = [features(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["f", "y"])

    points = training.select("text", "toxic").mapInArrow(measured, "f array<double>, y int").collect()  # at most fit_rows per copy of an id
    x = np.array([p.f for p in points])
    lexicon.coefficients, lexicon.bias = _logistic(x, np.array([float(p.y) for p in points]))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[list[float], float]:
    """Ridge-penalised logistic regression by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(z.shape[1])
    keep = penalty * np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + keep, z.T @ (y - p) - keep @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-7:
            break
    return [float(b) for b in beta[:-1]], float(beta[-1])


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2,
                    threshold: float = THRESHOLD, lexicon: Lexicon | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and n_terms for every row of ``docs``.

    Scores depend on the text alone. Null and empty texts have no match and get the score
    of such texts; a null doc_id is not held out. Without usable labels the lexicon is
    empty and every score 0.5 of a zero logit. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    lexicon = lexicon or learn(rows, labels, modulus, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = matcher(lexicon)
        beta = np.array(lexicon.coefficients)
        for batch in batches:
            x = np.array([features(t.as_py() or "") for t in batch.column(1)]).reshape(batch.num_rows, 4)
            score = 1.0 / (1.0 + np.exp(-(x @ beta + lexicon.bias)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(np.rint(np.expm1(x[:, 3])).astype(np.int64))],
                                             ["doc_id", "score", "n_terms"])

    scored = rows.mapInArrow(run, "doc_id bigint, score double, n_terms bigint")
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_terms")
