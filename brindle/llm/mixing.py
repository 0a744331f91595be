"""Mixing sources to target weights by pivotal dependent rounding of copy numbers. Spark expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep, null_safe, whole_row

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(sid, source, source_size, target): the words that each source shall give, sid its place; sizes: (source, size).

    Targets share ``budget`` times all words by weight; none is above ``most`` times its source's
    words, and what is above goes to the others by weight, until none is above. As all shares grow by
    one factor, sources reach their limit in the order of limit / weight, so running sums give the
    factor at which the rest stays below. One row per source; sources are few against documents.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    total = total.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    total = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    total = total.withColumn("limit", most * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, from_here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = budget * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))
    total = total.withColumn("share", F.col("weight") * rest / F.sum("weight").over(from_here))
    # The first source in order that stays below its limit sets the level for itself and all after it.
    level = F.first(F.when(F.col("share") <= F.col("limit"), F.col("share") / F.col("weight")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return total.select("sid", "source", "source_size", F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit"))).alias("target"))


def _uniform(*keys: Column) -> Column:
    """A number in [0, 1) that follows from the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


#: Documents are rounded by classes of size, each so many times as large as the one below.
STEP = 16.0
_ITEM = "struct<rid:long,key:long,size:double,mass:double>"


def _fold(items: Column, seed: int) -> Column:
    """Pair the items one after another: {carry: the one still fractional or null, done: [rid, up]}."""

    def paired(state: Column, x: Column) -> Column:
        c = state["carry"]
        gain_c, gain_x = F.least(c["size"] - c["mass"], x["mass"]), F.least(c["mass"], x["size"] - x["mass"])
        up = _uniform(F.lit(seed), c["key"], x["key"]) * (gain_c + gain_x) < gain_x  # more mass for c, at odds that keep all expectations
        full_c, full_x = c["size"] - c["mass"] <= x["mass"], x["size"] - x["mass"] <= c["mass"]
        mass_c = F.when(up, F.when(full_c, c["size"]).otherwise(c["mass"] + x["mass"])).otherwise(F.when(full_x, c["mass"] - (x["size"] - x["mass"])).otherwise(0.0))
        mass_x = F.when(up, F.when(full_c, x["mass"] - (c["size"] - c["mass"])).otherwise(0.0)).otherwise(F.when(full_x, x["size"]).otherwise(c["mass"] + x["mass"]))
        item = lambda i, mass: F.struct(i["rid"].alias("rid"), i["key"].alias("key"), i["size"].alias("size"), mass.alias("mass"))
        return F.transform(F.array(F.array(item(c, mass_c), item(x, mass_x))), lambda two: _state(two, state["done"]))[0]

    def _state(two: Column, done: Column) -> Column:
        whole = lambda i: (i["mass"] <= 0) | (i["mass"] >= i["size"])
        ended = F.transform(F.filter(two, whole), lambda i: F.struct(i["rid"].alias("rid"), (i["mass"] > 0).alias("up")))
        carry = F.get(F.filter(two, lambda i: ~whole(i)), F.lit(0))
        return F.struct(carry.alias("carry"), F.concat(done, ended).alias("done"))

    start = F.struct(F.lit(None).cast(_ITEM).alias("carry"), F.array().cast("array<struct<rid:long,up:boolean>>").alias("done"))
    step = lambda s, x: F.when(s["carry"].isNull(), F.struct(x.alias("carry"), s["done"].alias("done"))).otherwise(paired(s, x))
    return F.aggregate(items, start, step)


def _coin(last: DataFrame, seed: int) -> DataFrame:
    """Draw the last fractional document of each source's class: (sid, rid, up, part, done, classes), part the rate for the classes below.

    It is paired with all smaller documents as one: ``moved`` words change sides, as many as it needs to be whole,
    or as few as the smaller ones can give or hold. Up or down, at odds that keep its expectation and theirs.
    last: (sid, part, classes, room, state); room and state null where the source has no such class, state.carry where none is left.
    """
    last = last.select("sid", "part", "classes", "room", "state.done", "state.carry.*").withColumn("p", F.col("mass") / F.col("size")).withColumn("rest", F.col("room") * F.col("part"))
    moved = F.least("size", F.col("rest") / (1 - F.col("p")), (F.col("room") - F.col("rest")) / F.col("p"))
    up = _uniform(F.lit(seed), F.col("key")) < F.col("p")
    rest = F.when(up, F.col("rest") - (1 - F.col("p")) * moved).otherwise(F.col("rest") + F.col("p") * moved)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(rest, F.col("room"))))
    return last.select("sid", "rid", up.alias("up"), F.when((F.col("room") > 0) & F.col("rid").isNotNull(), part).otherwise(F.col("part")).alias("part"), "done", "classes")


def pivotal(docs: DataFrame, parts: DataFrame, seed: int = 17, fan_in: int = 512) -> DataFrame:
    """(rid, up) for each document: whether its fraction is rounded up.

    docs: (rid, key, sid, words), rid its own number, key what random numbers follow from, sid the source's
    number, words above 0; parts: (sid, part), part the fraction of each document's copies to be rounded.

    Two fractional documents of a source are paired: words move from one to the other, at random, until one
    has none or all of its size; the pair's words stay as they were, and each document's expectation too.
    Documents are paired with those of their class of size: chunks of about ``fan_in``, largest first, leave
    one fractional document each, those are paired again, up a tree, until the class has one. That one is
    paired with all smaller documents of the source as one (see _coin), and the next class goes on with
    the rate that is left. So what a source misses at the end is a small document's size, unless the
    small ones can't make up for a large one. Classes are as many as the powers of STEP in the largest size.
    """
    size_class = F.floor(F.log(STEP, F.col("words"))).cast("int")
    docs = keep(docs.withColumn("cls", size_class).sortWithinPartitions("cls"))
    below = Window.partitionBy("sid").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    own = docs.groupBy("sid", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"))
    own = keep(own.select("sid", "cls", "n", F.coalesce(F.sum("words").over(below), F.lit(0.0)).alias("room")))
    classes = F.map_from_entries(F.collect_list(F.struct("cls", F.struct("n", "room"))))
    parts = keep(parts.join(own.groupBy("sid").agg(classes.alias("classes")), "sid"))
    decided = [docs.limit(0).select("rid", F.lit(True).alias("up"))]
    for cls, n in own.groupBy("cls").agg(F.max("n")).orderBy(F.desc("cls")).collect():  # one row for a class
        # A written table, so that Spark knows its size: few sources are broadcast, many are joined with skew handled.
        here = parts.select("sid", "part", F.try_element_at("classes", F.lit(cls)).alias("of")).where("of is not null").select("sid", "part", "of.n")
        chunk = F.pmod(F.xxhash64(F.lit(seed), "key"), F.ceil(F.col("n") / fan_in)).alias("chunk")
        level = docs.where(F.col("cls") == cls).join(here, "sid").select("sid", chunk, "rid", "key", F.col("words").alias("size"), (F.col("words") * F.col("part")).alias("mass"))
        decided.append(level.where("mass <= 0 or mass >= size").select("rid", (F.col("mass") > 0).alias("up")))
        level, chunks = level.where("mass > 0 and mass < size"), -(-n // fan_in)
        while True:
            items = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "key", "rid", "size", "mass")))
            items = F.transform(items, lambda i: F.struct(i["rid"].alias("rid"), i["key"].alias("key"), i["size"].alias("size"), i["mass"].alias("mass")))
            # Else chunks would stay where the join has put their source, all of a hot one in one task.
            level = level.repartition("sid", "chunk")
            folded = level.groupBy("sid", "chunk").agg(items.alias("items")).select("sid", "chunk", _fold(F.col("items"), seed).alias("state"))
            if chunks <= 1:
                break
            done = keep(folded)
            decided.append(done.select(F.explode("state.done").alias("d")).select("d.rid", "d.up"))
            left = done.where("state.carry is not null").select("sid", "chunk", "state.carry.*")
            level, chunks = left.withColumn("chunk", F.floor(F.col("chunk") / fan_in)), -(-chunks // fan_in)
        last = parts.withColumn("room", F.try_element_at("classes", F.lit(cls))["room"]).join(folded.drop("chunk"), "sid", "left")
        drawn = keep(_coin(last, seed))
        decided += [drawn.select(F.explode("done").alias("d")).select("d.rid", "d.up"), drawn.where("rid is not null").select("rid", "up")]
        parts = drawn.select("sid", "part", "classes")
    return reduce(DataFrame.unionAll, decided)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, budget: float = 1.5, most: float = 2.0, fan_in: int = 512, seed: int = 17,
) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, copies, taken) for each row.

    size: words of the text. Each document shall be copied target / source_size times: the whole part
    is given, the fraction rounded up or down by pivotal(), which keeps expectations and brings each source's
    words near its target. Random numbers follow from ``seed`` and the documents, so that reruns agree.

    Null text: size 0. Null source: a source of its own, last in order. Documents of size 0 get the whole
    part of the copies and take nothing. Null and equal ids: rows that differ in text or source are rounded
    each on its own; rows equal in id, text and source are rounded together, as one document. Very long texts:
    a document larger than all others of its source together is drawn by its fraction alone, so the source
    may miss its target by that much. Empty table: no rows. Other columns are not read.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
    )
    rows = rows.groupBy("doc_id", "source", "text_key", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = keep(rows.withColumn("rid", F.monotonically_increasing_id()))
    goals = source_targets(rows.select("source", (F.col("size") * F.col("n")).alias("size")), weights, budget, most)
    goals = goals.withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))).withColumn("whole", F.floor("rate").cast("long"))
    goals = keep(goals.select("sid", "source", "source_size", "target", "whole", (F.col("rate") - F.col("whole")).alias("part")))
    with_goal = keep(null_safe(rows, goals, ["source"]).withColumn("key", F.xxhash64("doc_id", "source", "text_key")))
    fractional = with_goal.where("size > 0 and part > 0").select("rid", "key", "sid", (F.col("size") * F.col("n")).cast("double").alias("words"))
    ups = pivotal(fractional, goals.select("sid", "part"), seed, fan_in)
    out = with_goal.join(ups, "rid", "left").withColumn("copies", F.col("whole") + F.coalesce(F.col("up").cast("long"), F.lit(0).cast("long")))
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select("doc_id", "text_key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them; same columns. Needs doc_id, text and source.

    Rows without words stay as they are, once. Nulls, repeated rows, very long texts and empty tables: see mix().
    """
    keys = ["id", "source", "text_key"]
    said = mix(docs, **options).select(F.col("doc_id").alias("id"), "source", "text_key", F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(1)).cast("long").alias("times")).distinct()
    own = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    joined = null_safe(own, said.where("times > 0"), keys)
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
