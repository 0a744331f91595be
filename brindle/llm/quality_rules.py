"""Quality rules: lines that too many documents of a host share are removed, depleted documents rejected."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, keep, null_safe, ship, signed, sliced

SYMBOLS = b"#*$%&|<>"
_FACTS = (
    "rid long, doc_id long, host string, text_key long, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:int>>"
)


def line_hash(line: bytes) -> int:
    """Signed 64-bit hash of a line: A-Z lowered, runs of white space one space, digits as 0."""
    import xxhash

    plain = b" ".join(line.lower().split()).translate(bytes.maketrans(b"123456789", b"0" * 9))
    return signed(xxhash.xxh64_intdigest(plain))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count: dict = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def _facts(batches):
    import xxhash

    kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))]
    names = ["rid", "doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
    for batch in sliced(batches):
        rows: dict = {n: [] for n in names}
        for rid, doc_id, host, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            raw = (text or "").encode()
            words = raw.split()
            seen, dup, lines = set(), 0, {}
            for line in raw.split(b"\n"):
                n = len(line.split())
                if not n:
                    continue
                dup += line in seen
                seen.add(line)
                key = line_hash(line)
                lines[key] = lines.get(key, 0) + n
            out = (
                rid, doc_id, host, signed(xxhash.xxh64_intdigest(raw, 42)), len(words),
                len(text or "") - (len(raw) - len(raw.translate(None, SPACES))),
                len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeated_words(words),
                [{"line": k, "words": n} for k, n in lines.items()],
            )
            for n, v in zip(names, out):
                rows[n].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(rows[n], k) for n, k in zip(names, kinds)], names)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_docs: int = 20, max_share: float = 0.05, keep_share: float = 0.5, min_words: int = 50, max_repeat: int = 50,
) -> DataFrame:
    """Facts and verdict for each row: rid, doc_id, host, the base counts, n_removed, drop_lines, base_failed, kept.

    A line is above its limit in a host when more than ``min_docs`` documents and more than
    ``max_share`` of the host's documents have it. Documents with one text in one host count
    once, so that copies alone don't make a line common. drop_lines: hashes of the document's
    lines above the limit; n_removed: their words. A document is depleted, and rejected, when
    less than ``keep_share`` of its words stay. ``max_repeat``: percent of words in repeated
    3-word windows above which the base rule fails.

    Null text: as empty. Null host: a host of its own. Null ids and repeated rows: every row gets
    its own result (rid numbers them). Empty table: no rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"),
        F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"),
    )
    facts = keep(rows.mapInArrow(_facts, _FACTS))
    firsts = facts.groupBy("host", "text_key").agg(F.min("rid").alias("rid"))
    hosts = keep(firsts.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs")))
    one_each = facts.select("rid", "host", "lines").join(firsts.select("rid"), "rid", "left_semi")
    lines = one_each.select("host", F.explode("lines.line").alias("line"))
    often = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs)
    often = keep(null_safe(often, hosts, ["host"]).where(F.col("n") > max_share * F.col("n_docs")).select("host", "line"))
    found = facts.select("rid", "host", F.explode("lines").alias("x")).select("rid", "host", "x.line", "x.words")
    cut = null_safe(found, often.withColumn("hit", F.lit(1)), ["host", "line"]).groupBy("rid")
    cut = cut.agg(F.sum("words").cast("long").alias("n_removed"), F.sort_array(F.collect_set("line")).alias("drop_lines"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    out = facts.drop("lines").join(cut, "rid", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
    rest = F.col("n_words") - F.col("n_removed")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (rest >= keep_share * F.col("n_words")))


def _trimmed(batches):
    """(rest, text, drop_lines) to (rest, text) without the lines to drop."""
    for batch in sliced(batches):
        texts = []
        for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop_lines").to_pylist()):
            if drop:
                gone = set(drop)
                text = "\n".join(x for x in text.split("\n") if not x.encode().split() or line_hash(x.encode()) not in gone)
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string())], ["rest", "text"])


def apply_rules(docs: DataFrame, **limits) -> DataFrame:
    """The documents that the rules keep, without their lines above the limit; n_chars is counted anew, where there is one.

    Same columns as ``docs``, whatever their names, of which doc_id, text and source are read. Rows with equal doc_id, source
    and text share a verdict and each stays; null texts are empty, so they go. Null ids and sources: as any other. Very long
    texts: whole. Empty table: no rows.
    """
    ship(docs.sparkSession)
    keys = ["doc_id", "host", "text_key"]
    said = quality_rules(docs, **limits).where("kept").groupBy(*keys).agg(F.first("drop_lines").alias("drop_lines"))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), others, "text")
    joined = null_safe(own, said, keys).select("rest", "text", "drop_lines")
    kept = joined.select("rest", "text").schema
    out = joined.mapInArrow(_trimmed, kept)
    return out.select(*[F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
