"""Quantiles, frequent values, overlaps and patterns against plain Python, with hot keys, nulls, ties and odd values."""

import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from brindle.operators.frequent import heavy_hitters, shrunk
from brindle.operators import intervals, vectors
from brindle.operators.intervals import overlap_join
from brindle.operators.patterns import Step, sequences
from brindle.operators.quantiles import quantiles, ranked_values


@pytest.fixture(scope="module")
def values():
    """One group with nearly all rows: far-flung, bunched, equal, infinite values and nulls."""
    rng = random.Random(2)
    hot = [rng.choice([rng.gauss(0, 1), 10 ** rng.uniform(-200, 200), 7.0, -(10 ** rng.uniform(-5, 5)), None]) for _ in range(1500)] + [math.inf, -math.inf, 1e308, -0.0, 5e-324]
    return [("hot", v) for v in hot] + [(None, v) for v in hot[:300]] + [("few", 1.0), ("few", 2.0), ("none", None)] + [("one", 3.0)] * 400


def plain(group, f, kind):
    v = sorted(x for x in group if x is not None)
    if not v:
        return None
    if kind == "disc":
        return v[max(math.ceil(Fraction(f) * len(v)) - 1, 0)]
    at = f * (len(v) - 1)
    low, high = v[math.floor(at)], v[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("most", [100, 10_000])
def test_quantiles(spark, values, most):
    df = spark.createDataFrame(values, "g string, v double").repartition(5)
    wanted = {"a": (0.5, "cont"), "b": (0.03, "disc"), "c": (1.0, "disc"), "d": (0.0, "disc"), "e": (0.77, "cont")}
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", wanted, most).collect()}
    assert set(got) == {g for g, _ in values}
    for g, r in got.items():
        for n, (f, kind) in wanted.items():
            want = plain([v for k, v in values if k == g], f, kind)
            assert r[n] == want or math.isclose(r[n], want, rel_tol=1e-12), (g, n)
    whole = quantiles(df, [], "v", {"m": (0.4, "disc")}, most).collect()
    assert [r["m"] for r in whole] == [plain([v for _, v in values], 0.4, "disc")]


def test_quantiles_of_longs_and_text_are_exact(spark):
    rows = [(1, (1 << 60) + i % 97, f"w{i % 31:02d}") for i in range(500)]
    df = spark.createDataFrame(rows, "g int, v long, s string")
    want = sorted(r[1] for r in rows)[math.ceil(0.9 * 500) - 1]
    assert [quantiles(df, ["g"], "v", {"q": (0.9, "disc")}, m).first()["q"] for m in (50, 1000)] == [want, want]
    assert quantiles(df, ["g"], "s", {"q": (0.5, "disc")}).first()["q"] == "w15"
    assert quantiles(df.limit(0), ["g"], "v", {"q": (0.9, "disc")}).count() == 0


def test_ranks_of_one_group_are_not_met_in_one_task(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), F.pmod(F.col("id") * 7919, F.lit(20_011)).alias("v"))
    wanted = spark.createDataFrame([(1, 0), (1, 9_999), (1, 19_999)], "g int, rank long")
    found = {r["rank"]: r["value"] for r in ranked_values(df, ["g"], "v", wanted).collect()}
    want = sorted(i * 7919 % 20_011 for i in range(20_000))
    assert found == {k: want[k] for k in (0, 9_999, 19_999)}


def test_heavy_hitters(spark):
    rng = random.Random(4)
    words = [rng.choice(["a", "b", None]) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.7))}" for _ in range(8000)] + ["edge"] * 100
    counts = Counter(w for w in words if w is not None)
    total = sum(counts.values())
    for share, parts in ((0.01, 5), (0.3, 130), (100 / total, 3)):
        got = {r["w"]: r["n"] for r in heavy_hitters(spark.createDataFrame([(w,) for w in words], "w string").repartition(parts), "w", share).collect()}
        assert got == {w: n for w, n in counts.items() if n > share * total}
    none = spark.createDataFrame([(None,)], "w string")
    assert heavy_hitters(none, "w", 0.5).collect() == []
    with pytest.raises(ValueError):
        heavy_hitters(none, "w", 0.0)


def test_no_value_above_the_share_is_lost_by_shrinking():
    rng = random.Random(6)
    tables = [Counter(int(rng.paretovariate(0.5)) for _ in range(500)) for _ in range(60)]
    every, kept = sum(tables, Counter()), {}
    for t in tables:
        kept = shrunk(dict(Counter(kept) + Counter(shrunk(dict(t), 40))), 40)
    assert len(kept) <= 40 and {v for v, n in every.items() if n > 30_000 / 41} <= set(kept)
    assert all(every[v] - 30_000 / 41 <= n <= every[v] for v, n in kept.items())


def spans(rng, n, keys):
    out = []
    for i in range(n):
        start = rng.choice([None, 0, rng.randint(-500, 500)]) if rng.random() < 0.1 else rng.randint(-500, 500)
        length = rng.choice([0, 1, 3, rng.randint(0, 20), rng.randint(0, 2000), -4])
        out.append((rng.choice(keys), i, start, None if start is None else start + length))
    return out


@pytest.mark.parametrize("base", [None, 1.0, 50.0])
def test_overlap_join(spark, base):
    rng = random.Random(9)
    a, b = spans(rng, 150, [1, 1, 1, 2, None]), spans(rng, 140, [1, 1, 3, 2, None])
    left, right = spark.createDataFrame(a, "k int, a int, a0 int, a1 int"), spark.createDataFrame(b, "k int, b int, b0 int, b1 int")
    meet = lambda x, y: None not in (*x[2:], *y[2:]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]
    got = sorted((r["a"], r["b"]) for r in overlap_join(left, right, ("a0", "a1"), ("b0", "b1"), ["k"], base).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] is not None and x[0] == y[0] and meet(x, y))
    free = sorted((r["a"], r["b"]) for r in overlap_join(left.drop("k"), right.drop("k"), ("a0", "a1"), ("b0", "b1"), base=base).collect())
    assert free == sorted((x[1], y[1]) for x in a for y in b if meet(x, y))
    assert overlap_join(left.limit(0), right, ("a0", "a1"), ("b0", "b1"), ["k"], base).count() == 0


def made_by(plan, name):
    """Rows that the nodes of a plan that has run have put out."""
    kind = plan.nodeName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlan" else [plan.plan()] if kind.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    return [m for p in inner for m in made_by(p, name)] + ([plan.metrics().apply("numOutputRows").value()] if kind == name else [])


def test_few_copies_of_spans_of_many_lengths(spark):
    """Lengths as those of error_purchase_overlaps: the rows that are dealt out are less than twice the input's, four times for all copies of both steps."""
    rng = random.Random(5)
    a = [(i, s, s + round(rng.expovariate(1 / 3000))) for i in range(1500) for s in [rng.randint(0, 900_000)]]
    b = [(i, s, s + round(rng.expovariate(1 / 50) ** 2)) for i in range(1500) for s in [rng.randint(0, 900_000)]]
    left, right = spark.createDataFrame(a, "a int, a0 int, a1 int"), spark.createDataFrame(b, "b int, b0 int, b1 int")
    joined = overlap_join(left, right, ("a0", "a1"), ("b0", "b1"))
    got = sorted((r["a"], r["b"]) for r in joined.collect())
    assert got == sorted((i, j) for i, x0, x1 in a for j, y0, y1 in b if x0 <= y1 and y0 <= x1)
    assert sum(made_by(joined._jdf.queryExecution().executedPlan(), "Generate")) < 4 * 3000


@pytest.mark.parametrize("row", [1e-3, 1e6])
def test_overlap_join_on_many_levels_and_on_few(spark, monkeypatch, row):
    monkeypatch.setattr(intervals, "ROW", row)
    used, chosen = [], intervals._chosen
    monkeypatch.setattr(intervals, "_chosen", lambda *x: used.append(chosen(*x)) or used[-1])
    rng = random.Random(21)
    span = lambda i, longest: (i, s := rng.randint(0, 3000), s + int(rng.choice([0, 2, 9, 40, rng.randint(0, longest)])))
    for long_a, long_b in ((2500, 90), (90, 2500), (900, 900)):
        a, b = [span(i, long_a) for i in range(200)], [span(i, long_b) for i in range(200)]
        left, right = spark.createDataFrame(a, "a int, a0 int, a1 int"), spark.createDataFrame(b, "b int, b0 int, b1 int")
        got = sorted((r["a"], r["b"]) for r in overlap_join(left, right, ("a0", "a1"), ("b0", "b1"), base=2.0).collect())
        assert got == sorted((i, j) for i, x0, x1 in a for j, y0, y1 in b if x0 <= y1 and y0 <= x1)
    assert all(len(levels) > 1 for levels in used) if row < 1 else min(map(len, used)) <= 2


def test_long_spans_beside_short_ones_meet_few_others(spark):
    """Few spans are very long; the join is one of equal bins all the same."""
    n = 3000
    a = spark.range(n).select((F.col("id") * 10).alias("a0"), (F.col("id") * 10 + F.when(F.col("id") % 500 == 0, 20_000).otherwise(5)).alias("a1"))
    b = spark.range(n).select((F.col("id") * 10 + 3).alias("b0"), (F.col("id") * 10 + 4).alias("b1"))
    pairs = overlap_join(a, b, ("a0", "a1"), ("b0", "b1")).count()
    assert pairs == sum(max(0, min(n - 1, (i * 10 + (20_000 if i % 500 == 0 else 5) - 3) // 10) - i + 1) for i in range(n))
    whole = overlap_join(a, b, ("a0", "a1"), ("b0", "b1"))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "__bin" in plan and "Cartesian" not in whole._jdf.queryExecution().executedPlan().toString()


def matched(rows, steps):
    """Plain fold: for each first step walk on by (time, id)."""
    rows = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2]))
    out = []
    for i, r in enumerate(rows):
        if not steps[0][0](r):
            continue
        ids, at = [r[2]], i
        for when, within, unless in steps[1:]:
            j = next((j for j in range(at + 1, len(rows)) if when(rows[j]) or unless(rows[j])), None)
            if j is None or unless(rows[j]) or within is not None and rows[j][1] - rows[at][1] > within:
                break
            ids.append(rows[j][2])
            at = j
        else:
            out.append(tuple(ids))
    return out


@pytest.mark.parametrize("most", [50, 10_000])
def test_sequences(spark, most):
    rng = random.Random(12)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.choice([None, *range(0, 4000)]) if i % 20 == 0 else rng.randint(0, 4000), i, rng.choice("vcpexx")) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, t int, id int, kind string").withColumn("ts", F.timestamp_seconds("t"))
    kind = F.col("kind")
    got = sequences(df, ["k"], "ts", "id", [Step("v", kind == "v"), Step("c", kind.isin("c", "p"), within=30), Step("p", kind == "p", unless=kind.isin("e", "v"))], most)
    steps = [(lambda r: r[3] == "v", None, None), (lambda r: r[3] in "cp", 30, lambda r: False), (lambda r: r[3] == "p", None, lambda r: r[3] in "ev")]
    want = [(k, *m) for k in (1, 2, None) for m in matched([r for r in rows if r[0] == k], steps)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 20


def test_cosine_search_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.choice([2, 3]))]) for i in range(70)] + [(70, None), (71, [0.0, 0.0]), (72, [1.0, None]), (73, [float("nan"), 1.0]), (74, []), (5, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    want = []
    for a, x in rows:
        for b, y in rows:
            if a % 7 == 0 and a != b and x and y and len(x) == len(y) and None not in (*x, *y) and any(x) and any(y):
                cos = round(sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(p * p for p in y)), 6)
                if cos > 0.9:
                    want.append((a, b, cos))
    for most in ((3, 5), (1000, 1000)):
        monkeypatch.setattr(vectors, "QUERIES", most[0])
        monkeypatch.setattr(vectors, "ROWS", most[1])
        got = [tuple(r) for r in vectors.cosine_search(df.where("id % 7 = 0"), df, "id", "v", 0.9).collect()]
        assert sorted(got) == sorted(want)
