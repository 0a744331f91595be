"""op1's model: the same numbers with less work, and what goes to the driver."""

import brute
import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import lm_scoring


def model(words=191, buckets=8, items=40):
    shape = lm_scoring.Shape(words=words, buckets=buckets, items=items)
    rng = np.random.default_rng(4)
    class_of = np.r_[np.arange(words + 1), np.repeat(np.arange(buckets) + words + 1, items // buckets + 1)]
    made = lm_scoring.Model(shape, class_of, rng.integers(1, 99, len(class_of)).astype(float))
    for x in made.values():
        x += rng.normal(0, 0.5, x.shape).astype(np.float32)
    return made, *made.tokens([rng.integers(0, len(class_of), n) for n in (1, 0, 700, 30)])


def plain(m, flat, at):
    """log10 of the softmax over classes, then over the bucket, in double precision."""
    out = []
    for p in at:
        q = sum(m.c[i][flat[p - 1 - i]].astype(float) for i in range(m.shape.context))
        shares = [(m.r, m.b, m.class_of[flat[p]])]
        if flat[p] >= m.first:
            k = m.class_of[flat[p]] - m.first
            shares.append((m.v[m.starts[k] : m.ends[k]], m.e[m.starts[k] : m.ends[k]], flat[p] - m.first - m.starts[k]))
        total = 0
        for vectors, biases, mine in shares:
            x = vectors.astype(float) @ q + biases
            total += x[mine] - x.max() - np.log(np.exp(x - x.max()).sum())
        out.append(total / np.log(10))
    return np.array(out)


def test_scores_take_no_exponential_for_each_class_of_a_token(monkeypatch):
    m, flat, at = model()
    tables, taken, exp = m.tables(), [], np.exp
    monkeypatch.setattr(lm_scoring.np, "exp", lambda x, *a, **b: (taken.append(np.size(x)), exp(x, *a, **b))[1])
    got = m.log10(flat, at, tables)
    monkeypatch.undo()
    assert sum(taken) < 10 * len(at) < m.shape.classes * len(at)
    assert got == pytest.approx(plain(m, flat, at), abs=1e-4)


def test_scores_out_of_the_range_of_products():
    m, flat, at = model()
    for i, x in enumerate(m.c):
        x *= 60 * (-1) ** i
    assert m.log10(flat, at) == pytest.approx(plain(m, flat, at), rel=1e-4, abs=1e-3)


def test_drawn_items_have_their_shares():
    m, _, _ = model(buckets=3, items=6)
    for k in range(3):
        got = np.bincount(m.drawn(np.random.default_rng(k), np.full(50_000, k)).ravel(), minlength=len(m.near)) / 200_000
        assert got[: m.starts[k]].sum() + got[m.ends[k] :].sum() == 0
        assert got[m.starts[k] : m.ends[k]] == pytest.approx(m.near[m.starts[k] : m.ends[k]], abs=0.006)


def test_words_of_a_batch():
    texts = [None, "", " \t", " Ab\x0bc\x1cD\n\r", "x", "É\x85é\xa0 \x00", None]
    want = [bytes(t or "", "utf8").lower().split() for t in texts]
    for at in range(len(texts)):
        words, sizes = lm_scoring.split(pa.array(texts).slice(at))
        assert [w.encode() for w in words.to_pylist()] == sum(want[at:], []) and sizes.tolist() == [len(x) for x in want[at:]]


def test_batches_are_bounded_by_size_and_whole():
    texts = ["a" * n for n in (3, 0, 50, 2, 2, 2, 9, 1)] + [None]
    parts = [b.column(0).to_pylist() for b in lm_scoring.light([pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])], 0, 4, 10)]
    assert sum(parts, []) == texts and all(parts) and max(map(len, parts)) <= 4
    assert all(len(p) == 1 or sum(len(x or "") for x in p) < 20 for p in parts if "a" * 50 not in p)


def test_most_frequent_words_with_ties(spark):
    rows = [(f"w{i}", c) for i, c in enumerate([5, 1, 3, 3, 1, 9, 3, 1])]
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    counts = spark.createDataFrame(rows, "word string, c long").repartition(5)
    for head in (0, 1, 3, 4, 5, 8, 20):
        assert [tuple(r) for r in lm_scoring.most_frequent(counts, head)] == want[:head]


def test_texts_count_as_plain(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "B b\tc", "É x"] * 3 + [" ".join(f"w{i % 7}é{i % 11}" for i in range(n)) for n in (1, 40, 400)])]
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), head=4).collect()}
    for d, (held, n, known, train, base, *_) in brute.base_scores(rows).items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train) and r["base_score"] == pytest.approx(base, rel=1e-9)
