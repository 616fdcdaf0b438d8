"""Tokens, chat, toxicity, quality, decontamination and licences on small frames."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from adledger.llm import byte_bpe, chat_format, decontaminate, license_scan, quality, toxicity
from tests.llm.helpers import DOCS, ROWS, bench_words, collected, docs

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PLAIN = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})
CODECS = {n: byte_bpe.codec(PATH, public_tokenizers.PATTERN, n) for n in (2, 7, 8192)}
PIECES = st.text(alphabet=st.sampled_from(list("ab' sd\n\t.1é日  ’ll")), max_size=60) | st.text(max_size=40)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_tree_encoding_is_the_plain_one(text):
    text = text.encode("utf-8", "ignore").decode()
    want = PLAIN.encode_ordinary(text)
    for encode, decode in CODECS.values():
        assert encode(text) == want
        assert decode(want) == text.encode()


def test_bpe_rows(spark):
    rows = [*ROWS, (11, "y" * 20000), (12, "word " * 20000)]
    out = byte_bpe.encode_texts(docs(spark, rows), PATH, public_tokenizers.PATTERN, ["doc_id", "fp"])
    want = sorted(((i, PLAIN.encode_ordinary(t or "")) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in out.collect()), key=repr) == want
    for r in out.collect():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
    back = byte_bpe.decode_ids(out, PATH, public_tokenizers.PATTERN, ["doc_id"])
    assert sorted((bytes(r.decoded).decode() for r in back.collect())) == sorted(t or "" for _, t in rows)
    assert byte_bpe.encode_texts(spark.createDataFrame([], DOCS), PATH, public_tokenizers.PATTERN, ["doc_id"]).count() == 0


def cheapest(roles, needs_reply):
    """Least cost by trying every sequence of moves."""
    best = {0: 0}
    for role in roles:
        step = chat_format.moves(role)
        best = {t: min(c + step[s][t][0] for s, c in best.items() if step[s][t]) for t in range(4) if any(step[s][t] for s in best)}
    return min(c + chat_format.closing(s, needs_reply)[0] for s, c in best.items())


def test_moves_are_legal_and_cheap():
    for role, s, t in itertools.product([*chat_format.ROLES, None], range(4), range(4)):
        move = chat_format.moves(role)[s][t]
        if move and "merge" not in move[2]:
            at = s
            for given_ in (*move[1], move[3]):
                assert given_ in chat_format.NEXT[at]
                at = chat_format.ROLES.index(given_) + 1
            assert at == t
    assert chat_format.moves("user")[2][2][:3] == (chat_format.MERGE, (), "merge")
    assert chat_format.moves("assistant")[0][3][:2] == (chat_format.INSERT, ("user",))


def test_chat_repair(spark):
    rng = random.Random(1)
    turns = [(c, n, rng.choice(["system", "user", "assistant", "User ", "tool", None]), rng.choice(["hi", None, "", "x y"])) for c in range(30) for n in range(rng.randrange(1, 9))]
    turns += [(99, n, rng.choice(["user", "assistant"]), str(n)) for n in range(400)] + [(None, 1, "user", "q"), (None, None, "assistant", "r")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    for needs_reply in (True, False):
        out = chat_format.render(frame, needs_reply).collect()
        assert len(out) == len(turns)
        for conv in {t[0] for t in turns}:
            mine = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.place)
            given_ = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1]))
            roles = [None if t[2] is None else t[2].strip().lower() for t in given_]
            assert sum(r.cost for r in mine) == cheapest(roles, needs_reply)
            text = "".join(r.rendered for r in mine)
            marks = [m[2:-2] for m in text.split("\n") if m.startswith("<|") and m != "<|end|>"]
            at = 0
            for role in marks:
                assert role in chat_format.NEXT[at]
                at = chat_format.ROLES.index(role) + 1
            assert not (needs_reply and at == 2) and text.endswith("<|end|>\n")
    whole = {r.conv_id: r.text for r in chat_format.conversation_texts(chat_format.render(frame)).collect()}
    assert len(whole) == len({t[0] for t in turns})
    assert chat_format.render(frame.limit(0)).count() == 0


def test_folding():
    fold = toxicity.folder()
    assert fold("M0r0n") == fold("moron") == fold("mоrоn") == fold("MÓRON")
    assert fold("1diot") == fold("idiot") == fold("!diot"[0:0] + "ıdiot") and fold("lo$er") == fold("loser") != fold("lo er")


def test_toxicity_learns_terms_and_exceptions(spark):
    rng = random.Random(0)
    plain = [f"w{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(1, 30)] = rng.choice(["grumbo", "Grumb0", "flarn"])
        elif i % 45 == 1:
            w[10:12] = ["flarn", "dish"]
        rows.append((i, " ".join(w)))
        labels.append((i, None, int(bad)))
    rows += [(None, None), (5000, ""), (5001, "gruмbo")]
    labels += [(None, 1, 1), (7, None, None)]
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.score_documents(docs(spark, rows), lab).collect()}
    held = [i for i in range(900) if out[i].held_out]
    assert 150 < len(held) < 300
    assert sum(out[i].predicted == int(i % 4 == 0) for i in held) > 0.95 * len(held)
    assert out[5001].predicted == 1 and out[5000].predicted == 0 and out[None].held_out is False
    blank = toxicity.score_documents(docs(spark, rows[:3]), lab.limit(0)).collect()
    assert {r.score for r in blank} == {0.5}
    assert toxicity.score_documents(spark.createDataFrame([], DOCS), lab).count() == 0


def test_quality_on_held_out_labels(spark):
    from pathlib import Path

    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("no test data")
    table, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score_documents(table, lab).join(lab, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.95
    kept = quality.keep_good(table, lab)
    assert kept.schema == table.schema and 0.7 * table.count() < kept.count() < table.count()


def test_quality_odd_rows(spark):
    lab = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    out = quality.score_documents(docs(spark, ROWS), lab).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality.score_documents(docs(spark, ROWS), lab.limit(0)).collect()} == {0.5}
    assert quality.score_documents(spark.createDataFrame([], DOCS), lab).count() == 0


def test_isotonic_and_features():
    knots, values = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(values) > 0).all() and values[0] == 0 and values[-1] == 1
    rng = np.random.default_rng(0)
    size = len(quality.STATISTICS)
    model = quality.QualityModel(np.zeros(size), np.ones(size), rng.normal(size=(size, 4000)) / np.sqrt(size / 2), rng.uniform(0, 2 * np.pi, 4000), np.zeros(4001), np.zeros(1), np.zeros(1))
    x = rng.normal(size=(6, size))
    near = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / size)
    assert np.abs(model.features(x) @ model.features(x).T - near).max() < 0.1


ITEMS = "item_id bigint, text string, doc_id int, term string"


def test_decontamination(spark):
    rng = random.Random(4)
    vocab = [f"t{i}" for i in range(12)] + ["é", "X9"]
    item_texts = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (25, 10, 9, 3, 1, 2, 40)]
    items = [(i, t, 0, "x") for i, t in enumerate(item_texts)] + [(20, None, 0, "x"), (21, "?!", 0, "x"), (1, item_texts[0], 0, "x"), (22, item_texts[1], 0, "x")]
    rows = list(ROWS)
    for i in range(40, 80):
        w = [rng.choice(vocab[2:] + [f"d{i}"]) for _ in range(30)]
        if i % 3 == 0:
            w[5:5] = bench_words(item_texts[i % 2])
        rows.append((i, rng.choice([" ", ". ", "--"]).join(w).upper()))
    frame, bench = docs(spark, rows), spark.createDataFrame(items, ITEMS)
    windows = {}
    for i, t, _, _ in items:
        w = bench_words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s:s + 10]), set()).add(i)
    want = []
    for i, t in rows:
        w = bench_words(t)
        hit, found = set(), set()
        for win, ids in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= ids
        listed = ",".join(sorted(map(str, found)))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert collected(decontaminate.contamination(frame, bench), *columns) == sorted(want, key=repr)
    clean = decontaminate.drop_contaminated(frame, bench)
    assert clean.columns == frame.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((w[0] for w in want if not w[-1]), key=repr)
    assert not any(r.contaminated for r in decontaminate.contamination(frame, bench.limit(0)).collect())
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta", 0, "x")], ITEMS)
    frame = docs(spark, [(1, "alpha beta gamma delta"), (2, "alpha beta so gamma delta"), (3, "alpha beta delta"), (4, "delta x x x x gamma beta alpha")])
    searched = decontaminate.phrases(bench)
    index = decontaminate.build_index(frame, searched.vocabulary)
    terms = decontaminate.ranked_terms(index, searched)
    assert {r.doc_id for r in decontaminate.exact_matches(index, terms).collect()} == {1}
    near = {(r.doc_id, r.moved > 0) for r in decontaminate.proximity_matches(index, terms, 1).collect()}
    assert near == {(1, False), (2, True)}


def test_licences(spark):
    rows = [
        (1, "LICENSE", "Released under the MIT License."), (2, "a/x.py", "line of code words " * 40 + "\nLicensed under CC BY 4.0."), (3, "a/y.py", "no notice at all"),
        (4, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."), (5, "a/b/c/d.py", "words"), (6, None, None), (7, "ab/z.py", "the terms of it"), (7, "ab/z.py", "the terms of it"),
        (None, "a/b/q.py", "more"),
    ] + [(100 + i, f"far{i}/f.txt", "plain words of the file\n" * 5) for i in range(30)]
    files = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id bigint, path string, text string, line int, word string")
    out = license_scan.scan(files, license_scan.templates(spark)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.license_id, r.origin) for r in out}
    assert got[1] == ("MIT", "file") and got[2] == ("CC-BY-4.0", "header") and got[3] == ("MIT", "inherited")
    assert got[4] == ("Apache-2.0", "file") and got[5] == got[None] == ("Apache-2.0", "inherited") and got[7] == ("MIT", "inherited")
    assert got[6] == ("MIT", "inherited")
    none = license_scan.scan(files, license_scan.templates(spark, [])).collect()
    assert {r.origin for r in none} == {"none"}
    assert license_scan.scan(files.limit(0), license_scan.templates(spark)).count() == 0


@pytest.mark.parametrize("n", [9, 300])
def test_common_notice_is_found(spark, n):
    """A notice in a third of all files, in a table of fewer than 100 lines and in a larger one."""
    notice = "Released under the MIT License."
    rows = [(i, f"d{i}/f.txt", notice if i % 6 == 0 else f"w{i} first\n{notice}\n" + f"x{i} y{i} z{i} " * 9 if i % 3 == 0
             else f"plain words {i}\nthe end under the {i}") for i in range(n)]
    files = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    got = {r.doc_id: (r.license_id, r.origin, r.similarity) for r in license_scan.scan(files, license_scan.templates(spark)).collect()}
    assert got == {i: ("MIT", "file" if i % 6 == 0 else "header", 1.0) if i % 3 == 0 else (None, "none", None) for i in range(n)}


def plain_scan(rows, limits):
    """Own licence of each file by comparing every line and file with every template, without any choice of candidates."""
    known = [(t, Counter(bench_words(x))) for t, x in license_scan.TEMPLATES]
    vocabulary = {w for _, c in known for w in c}
    lines = [(i, bench_words(b)) for i, _, t in rows for b in t.split("\n")]
    uses = Counter(w for _, ws in lines for w in ws)
    idf = {w: math.log(1 + len(lines) / (1 + uses[w])) if w in vocabulary else math.log(1 + len(lines) / 2) for w in {*uses, *vocabulary}}
    out = {}
    for i, _, text in rows:
        best = {}
        for kind, units in (("file", [text]), ("header", text.split("\n"))):
            for c in (Counter(bench_words(u)) for u in units):
                # words of no template are summed as one dimension each use, as stated
                norm = math.sqrt(sum((n * idf[w]) ** 2 if w in vocabulary else n * idf[w] ** 2 for w, n in c.items()))
                for t, k in known:
                    dot = sum(n * idf[w] * k[w] * idf[w] for w, n in c.items() if w in k)
                    cosine = round(dot / norm / math.sqrt(sum((n * idf[w]) ** 2 for w, n in k.items())), 6) if dot else 0
                    if cosine >= limits[kind]:
                        best[kind] = min(best.get(kind, (0, "")), (-cosine, t))
        out[i] = (best.get("file") or best.get("header") or (None, None))[1]
    return out


@pytest.mark.parametrize("limits", [(0.8, 0.5), (0.6, 0.3)])
def test_licence_candidates_lose_no_match(spark, limits):
    rng = random.Random(11)
    pool = sorted({w for _, t in license_scan.TEMPLATES for w in bench_words(t)})
    rows = [(i, f"d{i}/f", "\n".join(" ".join(rng.choice(pool) if rng.random() < 0.8 else f"o{rng.randrange(30)}" for _ in range(rng.randrange(1, 7)))
             for _ in range(rng.randrange(1, 4)))) for i in range(250)]
    files = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    got = license_scan.scan(files, license_scan.templates(spark), *limits).collect()
    assert {r.doc_id: r.license_id for r in got} == plain_scan(rows, dict(zip(("header", "file"), limits)))
