"""Language identification: sums against all segmentations spelt out, a fit, and held-out texts."""

import itertools
import random
import zlib

import numpy as np
import pytest

from brindle.llm import language_id as li
from brindle.llm.queries import PIECES, QUERIES, tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, clean string, held_out int, run string"
NAMES = [b" ", b" a", b" ab", b"a", b"b", b"ab", b"ba", b"abab", "é".encode(), *[bytes([x]) for x in "é".encode()]]


def segmentations(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if all(x in NAMES for x in parts):
            yield parts


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.ones(len(NAMES)), size=3).T
    return li.Model(["x", "y", "z"], li.Pieces.of(NAMES), p, np.log([0.2, 0.3, 0.5]))


def test_forward_sums_all_segmentations(model):
    words = ["a", "ab", "abab", "é", "baabéb", "abababab", "bbbb"]
    for at, rows in li.by_length(words, 2):
        got = np.exp(li.log_probabilities(rows, model.pieces, model.p))
        for i, w in zip(range(len(at)), at):
            want = sum(np.prod([model.p[NAMES.index(x)] for x in s], axis=0) for s in segmentations(b" " + words[w].encode()))
            assert np.allclose(got[i], want, rtol=1e-12)


def test_expected_counts_of_all_segmentations(model):
    words, weights = ["abab", "babé", "aabb"], np.array([[1.0, 0, 2], [0, 3, 0], [1, 1, 1]])
    got = sum(li.expected(rows, weights[at], model.pieces, model.p) for at, rows in li.by_length(words, 9))
    want = np.zeros(model.p.shape)
    for w, weight in zip(words, weights):
        ways = list(segmentations(b" " + w.encode()))
        each = np.array([np.prod([model.p[NAMES.index(x)] for x in s], axis=0) for s in ways])
        for s, share in zip(ways, each / each.sum(axis=0) * weight):
            for x in s:
                want[NAMES.index(x)] += share
    assert np.allclose(got, want)


def test_a_long_word_is_summed_whole_and_stays_finite(model):
    word = "ab" * 4000
    now = {0: np.zeros(3)}
    data = b" " + word.encode()
    logs = np.log(model.p)
    for end in range(1, len(data) + 1):  # plain forward pass in logarithms
        now[end] = np.logaddexp.reduce([now[end - k] + logs[NAMES.index(data[end - k : end])] for k in range(1, min(4, end) + 1) if data[end - k : end] in NAMES and end - k in now])
    ((_, rows),) = li.by_length([word], 1)
    assert np.allclose(li.log_probabilities(rows, model.pieces, model.p)[0], now[len(data)], rtol=1e-10)


def test_every_piece_is_found():
    pieces = li.vocabulary(tokenizer_path(PIECES))
    assert pieces.find(np.array([li._hash(n) for n in pieces.names], np.uint64)).tolist() == list(range(len(pieces.names)))
    assert len(pieces.names) > 10_000 and pieces.find(np.array([li._hash(b"qqqqq")], np.uint64)).tolist() == [-1]


def test_held_out_texts(spark):
    got = {r["doc_id"]: r for r in QUERIES["op13_language_id"](spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1]
    assert {d["doc_id"] for d in held} == {i for i, r in got.items() if r["held_out"]}
    assert sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = {"aa": ["alpha", "beta", "gamma", "delta", "und"], "bb": ["einz", "zwo", "drey", "fier", "und"], "cc": ["山水", "日月", "木林", "火土"]}
    out = []
    for i in range(120):
        lang = ("aa", "aa", "aa", "bb", "cc")[i % 5]
        out.append((i, ("" if lang == "cc" else " ").join(rng.choices(words[lang], k=rng.choice([3, 30, 300]))), lang))
    out += [(200, None, "aa"), (201, "", "bb"), (202, "12 $$ 34", "aa"), (203, "ALPHA Beta 7", None), (204, "alpha" * 5000, None), (None, "zwo drey", "bb"), (3, out[3][1], "bb"), (205, "never learned", None)]
    out += [(900 + i, "gamma delta", "aa") for i in range(40)]
    return [(*r, None, 0, "c", 1, "r") for r in out]


def test_odd_rows(spark, rows):
    path = tokenizer_path(PIECES)
    got = li.language_id(spark.createDataFrame(rows, COLUMNS).repartition(3), path).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} == {"aa", "bb", "cc", "und"}
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (200, 201, 202))
    assert by_id[203]["lang_pred"] == by_id[204]["lang_pred"] == "aa" and by_id[None]["lang_pred"] == "bb"
    assert all(by_id[r[0]]["lang_pred"] == r[2] for r in rows if r[0] is not None and r[0] < 120)
    again = li.language_id(spark.createDataFrame(rows[::-1], COLUMNS), path).collect()
    assert sorted((r["doc_id"] or -1, r["lang_pred"], round(r["score"], 6)) for r in got) == sorted((r["doc_id"] or -1, r["lang_pred"], round(r["score"], 6)) for r in again)


def test_nothing_to_learn(spark, rows):
    path = tokenizer_path(PIECES)
    assert li.language_id(spark.createDataFrame([], COLUMNS), path).collect() == []
    none = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows], COLUMNS)
    assert {(r["lang_pred"], r["score"]) for r in li.language_id(none, path).collect()} == {("und", 0.0)}
