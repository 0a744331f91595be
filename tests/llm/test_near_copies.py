"""The pipeline's near copies against all pairs: five-word shingles with similarity 0.8, or SimHash within three bits."""

import json
import random

import brute
import corpus_pipeline

from brindle.llm import near_copies, simhash
from brindle.llm.common import maybe_in

SF = "/root/testdata/sf0.001"


def shingles(text, size=5):
    ws = brute.words(brute.lowered(text))
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} or {tuple(ws)} - {()}


def classes(rows):
    """rows: (doc_id, text), ids in order. {doc_id: smallest doc_id of its near copies}"""
    sets, fps = [shingles(t) for _, t in rows], [brute.simhash(t) for _, t in rows]
    near = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3 or near(sets[i], sets[j])]
    return {r[0]: rows[c][0] for r, c in zip(rows, brute.components(len(rows), pairs))}


def made(seed=5):
    """Chains of copies, each changed further than the one before, some past the limit; short and empty texts."""
    rng = random.Random(seed)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = [None, "", "One two", "one TWO", "one two three four five", "one two three four six"]
    for size in (60, 150, 400):
        for _ in range(12):
            first = prose(size)
            texts.append(" ".join(first))
            for _ in range(3):
                first = list(first)
                for _ in range(rng.randint(1, max(1, size // 40))):
                    first[rng.randrange(size)] = "changed"
                texts.append(" ".join(first))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_dedup(spark):
    rows = made()
    want = classes(rows)
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    assert sum(c != d for d, c in want.items()) > sum(c[1] != d for d, c in brute.simhash_classes(rows).items())
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == set(want.values())
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), SF).count() == 0


def test_cells_in_blocks(spark):
    rows = made(6)
    docs = spark.createDataFrame(rows, "node long, text string")
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    got = near_copies.similar_links(docs, block=2).collect()
    found = [(r["a"], r["b"]) for r in got]
    apart = {i for i in range(len(rows)) if not sets[i]}  # texts without words have equal sets
    assert brute.components(len(rows), found) == brute.components(len(rows), pairs + [(i, min(apart)) for i in apart])


def test_repeated_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, None), (1, ""), (2, "a b c d"), (3, "w x y z"), (5, "w x y z"), (5, "another text"), (None, "q"), (None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"] or "") for r in near_copies.one_of_each(docs).collect()), key=repr)
    assert got == sorted([(1, "a b c d"), (1, ""), (3, "w x y z"), (5, "another text"), (None, "q")], key=repr)


def test_first_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
    facts = brute.quality([(r[1], r[3]) for r in rows])
    rows = [(r[0], f[7]) for r, f in zip(rows, facts) if f[6]]
    want = classes(rows)
    assert len(set(want.values())) < len({c for _, c in brute.simhash_classes(rows).values()})
    out = corpus_pipeline.near_dedup(spark, corpus_pipeline.quality(spark, docs, SF), SF)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [r for r in rows if want[r[0]] == r[0]]


def test_maybe_in_misses_no_key(spark):
    keys = spark.range(0, 30000, 3).selectExpr("if(id = 0, null, id) as id", "id * 7 as node")
    rows = spark.range(30000).selectExpr("if(id = 0, null, id) as id", "id * 7 as node", "'x' as bit")
    got = {(r.id, r.maybe) for r in maybe_in(rows, keys, ["id", "node"]).select("id", "maybe").collect()}
    assert len(got) == 30000
    assert all((i, True) in got for i in [None, *range(3, 30000, 3)])
    assert sum(m for _, m in got) < 10000 + 20000 * 0.05
    assert not any(r.maybe for r in maybe_in(rows, keys.where("false"), ["id", "node"]).collect())


def test_stay_one_against_brute_force(spark):
    texts = ["a", "b", "c", "d", None]
    rows = [(i if i % 11 else None, texts[(i * i + i // 5) % 5], i % 4) for i in range(60)] + [(7, "b", 1), (7, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, maybe int")
    node = {t: k for t, k in docs.select("text", simhash.text_key()).distinct().collect()}
    roots = spark.createDataFrame([(node["a"], 1), (node["b"], 1), (node["c"], 2)], "node long, root long")
    group = {"a": 1, "b": 1, "c": 2, "d": "d", None: "none"}
    best = {}
    for r in rows:
        key = (r[0] is None, r[0] or 0, node[r[1]], json.dumps(r))
        best[group[r[1]]] = min(best.get(group[r[1]], (key, r)), (key, r), key=lambda x: x[0])
    got = simhash.stay_one(docs, roots)
    assert got.columns == ["doc_id", "text", "maybe"]
    ids = sorted((r.doc_id is None, r.doc_id or 0, str(r.text)) for r in got.collect())
    assert ids == sorted((r[0] is None, r[0] or 0, str(r[1])) for _, r in best.values())
