"""Scalar functions: text, numbers, dates, nulls, arrays, maps, structs, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.text import visible_text
from brindle.plans.catalogue import query
from brindle.session import table


@query(
    """select p_partkey, split_part(p_name, ' ', 1) as head, translate(p_name, 'aeiou', '12345') as coded, levenshtein(p_name, p_type) as away, reverse(p_name) as back,
    concat_ws('/', p_brand, p_type) as path, instr(p_name, 'e') as at, rpad(p_brand, 10, '.') as wide, repeat(left(p_name, 2), 3) as thrice, right(p_brand, 2) as tail,
    trim('  ' || p_name || ' ') as bare, starts_with(p_name, 'c') as is_c, contains(p_name, 'wid') as has_wid, p_type like 'E%' as like_e, p_type ilike 'e%y' as ilike_e,
    regexp_matches(p_brand, '#[1-3]') as low_brand, regexp_extract(p_brand, '#([0-9]+)', 1) as digits, ascii(p_name) as code, upper(p_name) as up, length(p_name) as n from part"""
)
def text_functions(spark, d):
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    return table(spark, d, "part").select(
        "p_partkey", F.split_part(name, F.lit(" "), F.lit(1)).alias("head"), F.translate(name, "aeiou", "12345").alias("coded"), F.levenshtein(name, kind).cast("long").alias("away"),
        F.reverse(name).alias("back"), F.concat_ws("/", brand, kind).alias("path"), F.instr(name, "e").cast("long").alias("at"), F.rpad(brand, 10, ".").alias("wide"),
        F.repeat(F.left(name, F.lit(2)), 3).alias("thrice"), F.right(brand, F.lit(2)).alias("tail"), F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("bare"),
        name.startswith("c").alias("is_c"), name.contains("wid").alias("has_wid"), kind.like("E%").alias("like_e"), kind.ilike("e%y").alias("ilike_e"), brand.rlike("#[1-3]").alias("low_brand"),
        F.regexp_extract(brand, "#([0-9]+)", 1).alias("digits"), F.ascii(name).alias("code"), F.upper(name).alias("up"), F.length(name).cast("long").alias("n"),
    )


@query("select doc_id, length(text) as chars, strlen(text) as bytes, sha256(text) as sha, md5(text) as md, len(list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), lambda x: x <> '')) as words from documents")
def text_facts(spark, d):
    t = F.col("text")
    words = F.size(F.filter(F.split(t, r"[ \n\t\r]+"), lambda x: x != ""))
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"), F.sha2(t, 256).alias("sha"), F.md5(t).alias("md"), words.cast("long").alias("words"))


@query("select word, count(*) as n from (select unnest(string_split_regex(text, '[ \\n\\t\\r]+')) as word from documents) where word <> '' group by 1")
def word_frequency(spark, d):
    return table(spark, d, "documents").select(F.explode(F.split("text", r"[ \n\t\r]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    """select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b.*?(</script\\s*>|\\z)|<style\\b.*?(</style\\s*>|\\z)', ' ', 'gis'), '<[^<>]*>', ' ', 'g'), '[ \\n\\t\\r]+', ' ', 'g'))) as digest,
    regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host from pages"""
)
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(visible_text(F.col("html"))).alias("digest"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"))


@query(
    """select c_custkey, cast(floor(c_acctbal) as bigint) as lo, cast(ceil(c_acctbal) as bigint) as hi, round(sqrt(abs(c_acctbal)), 6) as root, round(ln(abs(c_acctbal) + 1), 6) as nat,
    round(log10(abs(c_acctbal) + 1), 6) as dec, round(exp(c_nationkey / 10.0), 6) as e, round(power(c_nationkey, 3), 3) as cube, c_custkey % 7 as rest, cast(sign(c_acctbal) as int) as s,
    greatest(c_custkey, c_nationkey) as g, least(c_custkey, c_nationkey) as l, cast(trunc(c_acctbal) as bigint) as t, round(sin(c_nationkey) + cos(c_nationkey), 6) as trig, c_custkey // 3 as whole from customer"""
)
def math_functions(spark, d):
    x, k, n = F.col("c_acctbal"), F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, d, "customer").select(
        "c_custkey", F.floor(x).alias("lo"), F.ceil(x).alias("hi"), F.round(F.sqrt(F.abs(x)), 6).alias("root"), F.round(F.ln(F.abs(x) + 1), 6).alias("nat"), F.round(F.log10(F.abs(x) + 1), 6).alias("dec"),
        F.round(F.exp(n / 10.0), 6).alias("e"), F.round(F.pow(n, F.lit(3)), 3).alias("cube"), (k % 7).alias("rest"), F.signum(x).cast("int").alias("s"), F.greatest(k, n.cast("long")).alias("g"),
        F.least(k, n.cast("long")).alias("l"), x.cast("long").alias("t"), F.round(F.sin(n) + F.cos(n), 6).alias("trig"), F.expr("c_custkey div 3").alias("whole"),
    )


@query("select event_id, event_id & 12 as a, event_id | 5 as o, xor(event_id, 9) as x, event_id << 2 as l, event_id >> 1 as r, cast(bit_count(event_id) as int) as ones from events")
def bit_functions(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", e.bitwiseAND(12).alias("a"), e.bitwiseOR(5).alias("o"), e.bitwiseXOR(9).alias("x"), F.shiftleft(e, 2).alias("l"), F.shiftright(e, 1).alias("r"), F.bit_count(e).alias("ones")
    )


@query(
    """select o_orderkey, cast(o_orderdate + interval 2 months as date) as later, last_day(o_orderdate) as month_end, make_date(year(o_orderdate), 1, 1) as new_year, strftime(o_orderdate, '%Y-%m-%d') as text,
    weekofyear(o_orderdate) as week, dayofyear(o_orderdate) as nth, hour(o_orderdate) as h, epoch_us(o_orderdate) as us, o_orderdate + interval 36 hours as soon, cast(o_orderdate as date) as day from orders"""
)
def date_functions(spark, d):
    at = F.col("o_orderdate")
    whole = lambda f: f.cast("long")
    return table(spark, d, "orders").select(
        "o_orderkey", F.add_months(at, 2).alias("later"), F.last_day(at).alias("month_end"), F.make_date(F.year(at), F.lit(1), F.lit(1)).alias("new_year"), F.date_format(at, "yyyy-MM-dd").alias("text"),
        whole(F.weekofyear(at)).alias("week"), whole(F.dayofyear(at)).alias("nth"), whole(F.hour(at)).alias("h"), F.unix_micros(at.cast("timestamp")).alias("us"), (at + F.expr("interval 36 hours")).alias("soon"), at.cast("date").alias("day"),
    )


@query(
    """select event_id, coalesce(nullif(event_type, 'click'), 'none') as kind, nullif(value, 0) is null as no_value, case when nullif(event_type, 'click') is not null then 'set' else 'unset' end as state,
    nullif(event_type, 'click') is distinct from nullif(event_type, 'view') as differs, try_cast(event_type as int) is null as not_a_number, value / nullif(event_id % 5, 0) as part from events"""
)
def null_functions(spark, d):
    kind, v = F.col("event_type"), F.col("value")
    set_ = F.nullif(kind, F.lit("click"))
    return table(spark, d, "events").select(
        "event_id", F.coalesce(set_, F.lit("none")).alias("kind"), F.nullif(v, F.lit(0.0)).isNull().alias("no_value"), F.nvl2(set_, F.lit("set"), F.lit("unset")).alias("state"),
        (~set_.eqNullSafe(F.nullif(kind, F.lit("view")))).alias("differs"), kind.try_cast("int").isNull().alias("not_a_number"), F.try_divide(v, F.col("event_id") % 5).alias("part"),
    )


@query(
    """with w as (select p_partkey, string_split(p_name || ' ' || p_type, ' ') as w from part) select p_partkey, len(w) as n, w[1] as head, array_to_string(w[1:2], '+') as two, list_contains(w, 'widget') as has,
    array_to_string(list_sort(list_distinct(w)), ',') as sorted, cast(coalesce(list_position(w, 'widget'), 0) as bigint) as at, list_max(list_transform(w, lambda x: length(x))) as longest,
    cast(list_sum(list_transform(w, lambda x: length(x))) as bigint) as letters, array_to_string(list_reverse(w), ' ') as back from w"""
)
def array_functions(spark, d):
    w = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    sizes = F.transform("w", lambda x: F.length(x).cast("long"))
    return table(spark, d, "part").select("p_partkey", w.alias("w")).select(
        "p_partkey", F.size("w").cast("long").alias("n"), F.get("w", F.lit(0)).alias("head"), F.array_join(F.slice("w", 1, 2), "+").alias("two"), F.array_contains("w", "widget").alias("has"),
        F.array_join(F.array_sort(F.array_distinct("w")), ",").alias("sorted"), F.array_position("w", "widget").alias("at"), F.array_max(sizes).alias("longest"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x).alias("letters"), F.array_join(F.reverse("w"), " ").alias("back"),
    )


@query("select p_partkey, pos, word from (select p_partkey, unnest(string_split(p_name, ' ')) as word, cast(generate_subscripts(string_split(p_name, ' '), 1) - 1 as int) as pos from part)")
def exploded_positions(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))


@query("select s_suppkey, s_acctbal * 2 as doubled, cast(s_nationkey + 1 as bigint) as next, 2 as n_keys, s_name || '!' as named from supplier")
def maps_and_structs(spark, d):
    m = F.map_from_arrays(F.array(F.lit("bal"), F.lit("nation")), F.array("s_acctbal", F.col("s_nationkey").cast("double")))
    grown = F.transform_values("m", lambda k, v: F.when(k == "bal", v * 2).otherwise(v + 1))
    s = F.struct(F.col("s_name").alias("name")).withField("loud", F.concat("s_name", F.lit("!")))
    rows = table(spark, d, "supplier").select("s_suppkey", m.alias("m"), s.alias("s")).withColumn("m", grown)
    return rows.select("s_suppkey", F.element_at("m", "bal").alias("doubled"), F.element_at("m", "nation").cast("long").alias("next"), F.size(F.map_keys("m")).alias("n_keys"), F.col("s.loud").alias("named"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, cast(json_extract_string(props, '$.k') as bigint) as v, json_extract_string(props, '$.none') as missing from events")
def json_and_variant(spark, d):
    parsed = F.from_json("props", "k long")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"), F.variant_get(F.parse_json("props"), "$.k", "long").alias("v"), F.get_json_object("props", "$.none").alias("missing"))


@query("select l_orderkey, l_linenumber, cast(cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2)) as double) as tax, cast(round(cast(l_extendedprice as decimal(12,2)), 1) as double) as tenths from lineitem")
def decimal_functions(spark, d):
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (price * F.col("l_tax").cast("decimal(4,2)")).cast("double").alias("tax"), F.round(price, 1).cast("double").alias("tenths"))
