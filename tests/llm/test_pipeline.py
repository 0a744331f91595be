"""The pipeline against the brute-force versions, stage by stage and as a whole."""

import random
from collections import Counter

import brute
import corpus_pipeline
from test_near_copies import classes
from test_operators import check_packed

SF = "/root/testdata/sf0.001"


def check_mixed(rows, mixed):
    """Whole rows, as often as brute force allows, and each source's words within its largest document of the target."""
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in rows:
        n = len(brute.words(r[1]))
        sizes[r[3]] += n
        largest[r[3]] = max(largest[r[3]], n)
    goal, times = brute.targets(sizes), Counter(map(repr, mixed))
    for r in rows:
        allowed = brute.allowed_copies(goal[r[3]], sizes[r[3]]) if brute.words(r[1]) else {1}
        assert times[repr(r)] in allowed
    assert set(times) <= set(map(repr, rows))
    for r in mixed:
        taken[r[3]] += len(brute.words(r[1]))
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sizes)


ODD = "doc_id long, text string, lang string, source string, n_chars long, row int, text_key string, __host int, id string, node double"


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls, empty and repeated rows, ties, a long text and columns with the stages' own names, from the table's file on."""
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(400)) for _ in range(n))
    made = [(i, prose(rng.randint(55, 160)), "en", rng.choice(["a", "b", None]), 7) for i in range(40)]
    made += [(None, prose(70), None, None, None), (50, None, None, "a", None), (51, "", "en", "b", 0), (52, prose(4000), "en", "a", 1), made[3], made[3], (60, made[4][1], "en", "b", 7)]
    made += [(70, prose(60) + ' token = "Zx81bQwerty77aa"', "en", "a", 1)]
    made = [(*r, 1, "k", 2, "i", 0.5) for r in made]
    spark.createDataFrame(made, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    facts = brute.quality([(r[1], r[3]) for r in made])
    rows = [(r[0], f[7], r[2], r[3], len(f[7]), *r[5:]) for r, f in zip(made, facts) if f[6]]
    out = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, rows))
    out = corpus_pipeline.near_dedup(spark, out, str(tmp_path))
    rows = [r for i, r in enumerate(rows) if r not in rows[:i] and r[0] != 60]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, rows))
    out = corpus_pipeline.secrets(spark, out, str(tmp_path))
    rows = [(r[0], t := r[1].replace("Zx81bQwerty77aa", "[REDACTED]"), r[2], r[3], len(t), *r[5:]) for r in rows]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, rows))
    mixed = corpus_pipeline.mixture(spark, out, str(tmp_path)).collect()
    check_mixed(rows, [tuple(r) for r in mixed])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    n, bound = check_packed(packed, [(r["doc_id"], r["text"]) for r in mixed])
    assert n <= bound + 1


def test_empty_table_through_all_stages(spark, tmp_path):
    spark.createDataFrame([], ODD).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
    facts = brute.quality([(r[1], r[3]) for r in rows])
    rows = [(r[0], f[7], *r[2:4], len(f[7])) for r, f in zip(rows, facts) if f[6]]
    near = classes([r[:2] for r in rows])
    rows = [r for r in rows if near[r[0]] == r[0]]
    live = {d: x for d, _, x in brute.secrets([(r[0], r[1], r[3]) for r in rows])}
    rows = [(r[0], t := brute.redacted(r[1], live[r[0]]), *r[2:4], len(t)) for r in rows]
    out = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns, name
    assert sorted(map(tuple, out.collect())) == rows
    mixed = corpus_pipeline.mixture(spark, out, SF).collect()
    check_mixed(rows, [tuple(r) for r in mixed])
    packed = corpus_pipeline.packed(spark, spark.createDataFrame(mixed, docs.schema), SF).collect()
    n, bound = check_packed(packed, [(r["doc_id"], r["text"]) for r in mixed])
    assert n <= bound + 1
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r)[:5] for r in packed)
