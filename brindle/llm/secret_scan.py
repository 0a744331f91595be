"""Secret scans: spans by pattern, and how many repositories and owners share each candidate. Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, null_safe, whole_row

#: Kinds of the base in the order that breaks ties, their patterns, the group that is the value, and its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]{16,})", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
)
#: A cheap test that each text with a match passes.
HINT = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
#: Kind of the spans that the ownership frequency adds.
LIVE = "live"


def _parts(text: Column, rank: int, pattern: str, group: int) -> Column:
    """Array of {rank, gap, n, value}, one for each match: characters since the last match, its own, and what it holds. Linear in the text."""
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    each = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    each = F.transform(each, lambda x: F.struct(F.lit(rank).alias("rank"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["whole"]).cast("long").alias("n"), x["value"].alias("value")))
    return F.filter(each, lambda x: x["n"].isNotNull())  # the last gap has no match after it


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def plausible(value: Column) -> Column:
    """Looks like a generated credential: letters and digits, eight different characters or two thirds of a short one, no placeholder word."""
    different = F.size(F.array_distinct(F.split(value, "")))
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ((different >= 8) | (3 * different >= 2 * F.length(value)))
    return mixed & ~value.rlike("(?i)example|changeme|placeholder|dummy|xxxx|12345678")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """(rid, doc_id, repo, owner, text_key, parts) for each row, parts of all kinds by _parts()."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(repo_col).cast("string").alias("repo"),
        F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"),
    )
    parts = F.concat(*[_parts(text, rank, pattern, group) for rank, (_, pattern, group, _) in enumerate(BASE)])
    none = F.array().cast("array<struct<rank:int,gap:bigint,n:bigint,value:string>>")
    return keep(rows.select("rid", "doc_id", "repo", "owner", F.xxhash64(text).alias("text_key"), F.when(text.rlike(HINT), parts).otherwise(none).alias("parts")))


def base_spans(found: DataFrame) -> DataFrame:
    """(rid, repo, owner, rank, kind, start, end, v_start, value, value_hash), a row for each span of the base, places in code points.

    A match ends where the gaps and matches of its kind up to it end: a running sum over the document's matches.
    """
    each = found.select("rid", "repo", "owner", F.posexplode("parts").alias("nth", "part")).select("rid", "repo", "owner", "nth", "part.*")
    upto = Window.partitionBy("rid", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto))
    kind, least = (F.element_at(F.array(*[F.lit(b[i]) for b in BASE]), F.col("rank") + 1) for i in (0, 3))
    return keep(each.where(F.length("value") >= least).select(
        "rid", "repo", "owner", "rank", kind.alias("kind"), (F.col("end") - F.col("n")).alias("start"), "end", (F.col("end") - F.length("value")).alias("v_start"), "value", F.sha2("value", 256).alias("value_hash"),
    ))


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, n_repos, n_owners): distinct repositories and owners that hold a candidate."""
    each = spans.select("value_hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo")).distinct()
    by_owner = each.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value_hash").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", most_owners: int = 2,
) -> DataFrame:
    """(doc_id, text_key, spans, every, live, n_assign, n_access, n_hex, n_live, n_shared) for each row.

    Values of the base patterns are candidates. Their SHA-256 is counted over the corpus by distinct
    repositories, summed to owners: a value that more than ``most_owners`` owners hold is a widely copied example
    (n_shared), however many repositories of theirs have it, so that it does not become one as a table grows;
    any other that looks generated is live, and gets a further span of kind "live" over the value
    alone. One span per value and place. Values of letters alone or of digits alone are never live.

    Null text: empty. Null repository or owner: as "". Repeated rows: each is returned. Null ids: as any
    other. Very long texts: time grows with their length and their matches. Empty table: no rows. Other
    columns are not read.
    """
    found = candidates(docs, id_col, text_col, repo_col, owner_col)
    each = base_spans(found)
    few = F.col("n_owners") <= most_owners
    live = F.when(few & plausible(F.col("value")), F.struct(F.col("v_start").alias("start"), "end"))
    span = F.struct("start", "rank", "end", "kind", "v_start", "value")
    said = each.join(keep(ownership(each)), "value_hash").groupBy("rid").agg(
        F.array_sort(F.collect_list(span)).alias("base"), F.array_sort(F.collect_set(live)).alias("live"), F.count_if(~few).alias("n_shared")
    )
    out = found.drop("parts").join(said, "rid", "left")
    no_span, no_live = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,v_start:bigint,value:string>>"), F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = out.withColumns({"base": F.coalesce("base", no_span), "live": F.coalesce("live", no_live)})
    n = lambda rank, kind: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")
    spans = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["v_start"].alias("v_start"), s["value"].alias("value")))
    placed = lambda s, rank, kind: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), kind.alias("kind"))
    every = F.concat(F.transform("base", lambda s: placed(s, s["rank"], s["kind"])), F.transform("live", lambda s: placed(s, F.lit(len(BASE)), F.lit(LIVE))))
    return out.select(
        "doc_id", "text_key", spans.alias("spans"), F.array_sort(every).alias("every"), "live", *[n(i, b[0]) for i, b in enumerate(BASE)],
        F.size("live").cast("long").alias("n_live"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"),
    )


def _without(text: Column, cuts: Column, mark: str) -> Column:
    """The text with each of the cuts {start, end}, in order and apart, replaced by mark. Split to characters once, so linear in the text."""

    def built(chars: Column) -> Column:
        before = lambda i: F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0).cast("long"))
        piece = lambda a, n: F.array_join(F.slice(chars, (a + 1).cast("int"), n.cast("int")), "")
        pieces = F.transform(cuts, lambda c, i: F.concat(piece(before(i), c["start"] - before(i)), F.lit(mark)))
        last = before(F.size(cuts))
        return F.concat(F.array_join(pieces, ""), piece(last, F.greatest(F.size(chars) - last, F.lit(0).cast("long"))))

    return F.transform(F.array(F.split(text, "")), built)[0]


def redact(docs: DataFrame, mark: str = "[REDACTED]", **options) -> DataFrame:
    """The documents with every live value replaced by ``mark``; same columns, n_chars counted anew. Needs doc_id, text and source.

    Live values that overlap get one mark. Nulls, repeated rows, very long texts and empty tables: see secret_scan().
    """
    keys = ["id", "text_key"]
    said = secret_scan(docs, **options).where("n_live > 0").select(F.col("doc_id").alias("id"), "text_key", "live")
    each = said.groupBy(*keys).agg(F.max("live").alias("live")).select(*keys, F.explode("live").alias("s")).select(*keys, "s.*")
    order = Window.partitionBy(*keys).orderBy("start", "end")
    earlier = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("new", (F.col("start") >= F.coalesce(earlier, F.lit(0))).cast("int"))
    each = each.withColumn("nth", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = each.groupBy(*keys, "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = keep(cuts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts")))
    own = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    out = null_safe(own, cuts, keys, "left")
    row = F.when(F.col("cuts").isNull(), F.col("row")).otherwise(F.col("row").withField("text", _without(F.col("row.text"), F.col("cuts"), mark)))
    out = out.select(row.alias("row")).select("row.*")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
