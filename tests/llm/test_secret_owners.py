"""Owners decide: the documents of one owner or two never make a credential a widely copied example."""

from pyspark.sql import functions as F

from brindle.llm import secret_scan

SCHEMA = "doc_id long, text string, source string"


def test_many_documents_of_few_owners(spark):
    own, both, wide = "Qz81bKwerty77aLm", "Rv92cLopiuy66bNd", "Tk03dMasdfg55cPe"
    rows = [(i, f'token = "{own}" and more', "a") for i in range(30)]
    rows += [(100 + i, f'token = "{both}" and more', "ab"[i % 2]) for i in range(30)]
    rows += [(200 + i, f'token = "{wide}" and more', "abc"[i]) for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: (r["n_live"], r["n_shared"]) for r in secret_scan.secret_scan(docs).collect()}
    assert got == {d: (1, 0) if d < 200 else (0, 1) for d, *_ in rows}  # two owners may share one, in however many documents
    clean = secret_scan.redact(docs)
    assert clean.where(F.col("text").contains(own) | F.col("text").contains(both)).count() == 0
    assert clean.where(F.col("text").contains(wide)).count() == 3
