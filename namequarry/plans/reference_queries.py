"""Queries of the record-processing operators, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namequarry.functions import handles as H
from namequarry.functions import identity as I
from namequarry.functions.instants import with_instant
from namequarry.functions.names import shown_name
from namequarry.operators import asof, calibrate, estimates, generate, lifecycle, merge, models, similarity, splits, validate, weighted
from namequarry.plans.pipeline_queries import table
from namequarry.session import checkpointed, work_dir
from namequarry.sources import files
from namequarry.streaming import events as streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
DAY_US = 86_400_000_000
HALF = 1.2345678e-5  # added before rounding means of money, so that exact halves don't round either way


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---- views over the driver's tables

SALES_SQL = """sales AS (SELECT replace(p_name,' ','_') || CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS name,
  l_extendedprice AS price, l_shipdate AS sale_at, l_quantity AS weight, p_retailprice * l_quantity AS predicted, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey)"""
MARKET_SQL = """market AS (SELECT user_id AS asset, ts AS moment, event_id AS tie, value AS price,
  CASE event_type WHEN 'view' THEN 'listed' WHEN 'click' THEN 'bid' WHEN 'purchase' THEN 'sale' WHEN 'error' THEN 'cancelled' ELSE 'transfer' END AS kind FROM events)"""


def sales(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).otherwise(""))
    return joined.select(
        name.alias("name"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("sale_at"), F.col("l_quantity").alias("weight"),
        (F.col("p_retailprice") * F.col("l_quantity")).alias("predicted"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    )


def _kind() -> Column:
    e = F.col("event_type")
    return F.when(e == "view", "listed").when(e == "click", "bid").when(e == "purchase", "sale").when(e == "error", "cancelled").otherwise("transfer")


def market(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("asset"), F.col("ts").alias("moment"), F.col("event_id").alias("tie"), F.col("value").alias("price"), _kind().alias("kind"))


# ---- strings and keys

_PLAIN_NAME = "nullif(regexp_replace(lower(translate(username, 'ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９＿', 'abcdefghijklmnopqrstuvwxyz0123456789_')), '[^a-z0-9_]', '', 'g'), '')"


@query(f"SELECT row_id, {_PLAIN_NAME} AS name FROM sold_records")
def name_shown(spark, sf):
    return table(spark, sf, "sold_records").select("row_id", shown_name(F.col("username")).alias("name"))


@query(f"""WITH n AS (SELECT row_id, {_PLAIN_NAME} AS u FROM market_events)
SELECT row_id, CASE WHEN regexp_full_match(u, '[a-z][a-z0-9_]{{3,31}}') THEN u END AS handle,
 regexp_full_match(u, '[a-z][a-z0-9_]{{4,31}}') AND NOT contains(u, '__') AND NOT suffix(u, '_') AS valid5,
 regexp_full_match(u, '[a-z][a-z0-9_]{{3,31}}') AND NOT contains(u, '__') AND NOT suffix(u, '_') AS valid4 FROM n""")
def handle_validity(spark, sf):
    u = F.col("u")
    rows = table(spark, sf, "market_events").select("row_id", shown_name(F.col("username")).alias("u"))
    return rows.select("row_id", H.handle(u).alias("handle"), H.valid_handle(u, 5).alias("valid5"), H.valid_handle(u, 4).alias("valid4"))


@query(f"""WITH {SALES_SQL}, k AS (SELECT name,
 CAST(length(name) AS VARCHAR) || ':' || CAST(CAST(regexp_matches(name,'[0-9]') AS INT) AS VARCHAR) || ':' || CAST(CAST(contains(name,'_') AS INT) AS VARCHAR) AS segment,
 (CASE WHEN contains(name,'_') THEN 'underscore' WHEN regexp_matches(name,'[0-9]') THEN 'letter-digit' ELSE 'letters' END) || ':' ||
 (CASE WHEN length(name) <= 4 THEN '4' WHEN length(name) = 5 THEN '5' WHEN length(name) <= 7 THEN '6-7' WHEN length(name) <= 10 THEN '8-10' ELSE '11+' END) AS shape,
 regexp_replace(regexp_replace(name,'[0-9]+','#','g'),'_+','_','g') AS family FROM sales)
SELECT segment, shape, family, count(*) AS n, count(DISTINCT name) AS names FROM k GROUP BY ALL""")
def name_keys(spark, sf):
    n = F.col("name")
    keyed = sales(spark, sf).groupBy("name").agg(F.count("*").alias("c")).select("name", "c", H.structural_segment(n).alias("segment"), H.shape(n).alias("shape"), H.lexical_family(n).alias("family"))
    return keyed.groupBy("segment", "shape", "family").agg(F.sum("c").alias("n"), F.count("*").alias("names"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS plain, round(l_extendedprice, 2) AS european, round(l_extendedprice, 2) AS united FROM lineitem""")
def amount_notations(spark, sf):
    p = F.round("l_extendedprice", 2).cast("decimal(18,2)")
    grouped = F.format_number(p, 2)
    swapped = F.translate(grouped, ",.", ".,")
    united = F.concat(grouped, F.lit("  TON"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", p.cast("string").alias("a"), swapped.alias("b"), united.alias("c"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", H.amount(F.col("a")).alias("plain"), H.amount(F.col("b")).alias("european"), H.amount(F.col("c")).alias("united"))


_COUNT = lambda cls: f"length(regexp_replace(name,'[^{cls}]','','g'))"
_LONGEST = lambda p: f"coalesce(list_max(list_transform(regexp_extract_all(name,'{p}'), lambda x: length(x))), 0)"


@query(f"""WITH n AS (SELECT DISTINCT {_PLAIN_NAME} AS name FROM listing_observations), m AS (SELECT * FROM n WHERE name IS NOT NULL)
SELECT name, length(name) AS length, {_COUNT('0-9')} AS digits, {_COUNT('a-z')} AS letters, {_COUNT('_')} AS underscores,
 round({_COUNT('0-9')} / length(name), 6) AS digit_ratio, round({_COUNT('a-z')} / length(name), 6) AS letter_ratio,
 {_LONGEST('[0-9]+')} AS digit_run, {_LONGEST('[a-z]+')} AS letter_run, len(regexp_extract_all(name,'[0-9]+')) AS digit_groups,
 length(regexp_extract(name,'^[0-9]*')) AS leading_digits, length(regexp_extract(name,'[0-9]*$')) AS trailing_digits,
 CAST(name = reverse(name) AS INT) AS palindrome, round(len(list_distinct(string_split(name,''))) / length(name), 6) AS unique_ratio,
 round(coalesce({_COUNT('aeiouy')} / nullif({_COUNT('a-z')}, 0), 0), 6) AS vowel_ratio,
 {_LONGEST('[b-df-hj-np-tv-xz]+')} AS consonant_run, {_LONGEST('[aeiouy]+')} AS vowel_run FROM m""")
def name_features(spark, sf):
    names = table(spark, sf, "listing_observations").select(shown_name(F.col("username")).alias("name")).where("name is not null").distinct()
    wanted = ["length", "digits", "letters", "underscores", "digit_ratio", "letter_ratio", "digit_run", "letter_run", "digit_groups", "leading_digits", "trailing_digits", "palindrome", "unique_ratio", "vowel_ratio", "consonant_run", "vowel_run"]
    made = H.numeric_features(F.col("name"))
    return names.select("name", *((r6(made[f]) if f.endswith("ratio") else made[f]).alias(f) for f in wanted))


@query()
def name_vectors(spark, sf):
    names = table(spark, sf, "listing_observations").select(shown_name(F.col("username")).alias("name")).where("name is not null").distinct()
    n = F.col("name")
    made = H.numeric_features(n)
    return names.select("name", F.array(*(c.cast("double") for c in made.values()), H.entropy(n)).alias("numeric"), H.hashed_banks(n).alias("grams"))


@query()
def names_canonical(spark, sf):
    names = table(spark, sf, "listing_observations").where("username is not null").groupBy("username").agg(F.count("*").alias("n"))
    return names.select("username", "n", H.canonical(F.col("username")).alias("canonical"))


@query(f"""WITH n AS (SELECT DISTINCT {_PLAIN_NAME} AS name FROM listing_observations), m AS (SELECT name, '^' || name || '$' AS p FROM n WHERE name IS NOT NULL),
g AS (SELECT name, list_distinct(list_transform(range(1, greatest(length(p) - 1, 1) + 1), lambda i: substr(p, i, 2))) AS grams FROM m),
pair AS (SELECT a.name AS a, b.name AS b, len(list_intersect(a.grams, b.grams)) AS both_, len(a.grams) AS na, len(b.grams) AS nb FROM g a JOIN g b ON a.name < b.name)
SELECT a, b, round(both_ / (na + nb - both_), 6) AS jaccard, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS edit FROM pair WHERE both_ / (na + nb - both_) >= 0.3 - 1e-9""")
def similar_names(spark, sf):
    names = table(spark, sf, "listing_observations").select(shown_name(F.col("username")).alias("name"))
    return similarity.similar_names(names, "name", 0.3, 2).select("a", "b", r6("jaccard").alias("jaccard"), r6("edit").alias("edit"))


@query()
def similar_name_scores(spark, sf):
    names = table(spark, sf, "listing_observations").select(shown_name(F.col("username")).alias("name"))
    return similarity.similar_scores(names, "name", 0.05)  # fixed value: least similarity of a comparable sale


@query()
def transliterated_words(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[а-яё]{4,}"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).withColumn("latin", H.transliterated(F.col("word"))).where(H.valid_handle(F.col("latin"), 4) & H.pronounceable(F.col("latin")))


# ---- estimates (E1-E5, J1, J2, M5, M7, A6, A7, A15, A16, F22-F24, N4, N5, W8-W10, P11, P12): targets are a stated query set, against all rows

@query()
def comparable_estimates(spark, sf):
    sold = with_instant(table(spark, sf, "sold_records").join(F.broadcast(table(spark, sf, "source_feeds").select("source", "clock_zone", "day_order")), "source", "left"), "saleAt", "exact_ms", "clock_zone", "day_order")
    rows = sold.select("row_id", shown_name(F.col("username")).alias("name"), F.col("priceTon").alias("price"), "exact_ms", F.unix_millis(F.col("scrapedAt").cast("timestamp")).alias("observed_ms"), F.col("eventId").alias("event_id"))
    rows = checkpointed(rows, "sales")
    targets = rows.where("row_id % 50 = 0").select(F.col("row_id").alias("target_id"), "name", F.coalesce("exact_ms", "observed_ms").alias("at_ms"))
    return estimates.comparable_estimates(targets, checkpointed(estimates.sale_history(rows), "history"))


@query()
def listing_estimates(spark, sf):
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    seen = table(spark, sf, "listing_observations").withColumn("name", shown_name(F.col("username")))
    rows = seen.select("row_id", "id", "name", F.col("askTon").alias("ask"), "segment", "status", ms("listedAt").alias("listed_ms"), ms("lastObservedAt").alias("observed_ms"), ms("endedAt").alias("ended_ms"), ms("soldAt").alias("sold_ms"), F.col("salePriceTon").alias("sale_price"))
    targets = rows.where("row_id % 50 = 0").select(F.col("row_id").alias("target_id"), "name", F.coalesce("observed_ms", "listed_ms").alias("at_ms"), F.when(F.col("ask") > 0, F.col("ask")).alias("ask"))
    return estimates.listing_estimates(targets, rows)


# ---- identity

@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'sold:' || substr(sha256(l_returnflag || chr(0) || l_orderkey || chr(0) || 'sale:' || strftime(l_shipdate, '%Y-%m-%d')), 1, 32) AS event_id,
 'sha256:' || sha256('global' || chr(0) || l_suppkey) AS party FROM lineitem""")
def record_ids(spark, sf):
    at = F.concat(F.lit("sale:"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", I.record_id(F.lit("sold"), F.col("l_returnflag"), F.col("l_orderkey"), at).alias("event_id"), I.hashed_party(F.col("l_suppkey")).alias("party"))


@query("""SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(sha256(o_orderkey || chr(0) || o_custkey || chr(0) || o_orderstatus), 1, 12) AS HUGEINT)) AS VARCHAR) AS checksum FROM orders""")
def table_checksum(spark, sf):
    return I.table_hash(table(spark, sf, "orders"), "o_orderkey", "o_custkey", "o_orderstatus")


# ---- joins

@query(f"""WITH {SALES_SQL}, f AS (SELECT name, sale_at, max(price) AS price FROM sales GROUP BY ALL)
SELECT s.name, s.l_orderkey, s.l_partkey, s.l_suppkey, s.l_linenumber, f.price AS last_price FROM sales s ASOF LEFT JOIN f ON s.name = f.name AND s.sale_at > f.sale_at""")
def asof_last_price(spark, sf):
    rows = sales(spark, sf).withColumn("t", F.unix_micros(F.col("sale_at").cast("timestamp")))
    facts = rows.groupBy("name", "t").agg(F.max("price").alias("last_price"))
    out = asof.asof_join(rows.select("name", "t", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), facts, "name", "t", ["last_price"], 30 * DAY_US)
    return out.select("name", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "last_price")


@query(f"""WITH {SALES_SQL}, k AS (SELECT *, length(name) || ':' || CAST(regexp_matches(name,'[0-9]') AS INT) AS segment FROM sales),
g AS (SELECT *, count(*) OVER a AS n_seg, avg(price) OVER a AS m_seg, count(*) OVER b AS n_all, avg(price) OVER b AS m_all FROM k
 WINDOW a AS (PARTITION BY segment ORDER BY sale_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), b AS (ORDER BY sale_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, n_seg, n_all, round(CASE WHEN n_seg >= 3 THEN m_seg WHEN n_all > 0 THEN m_all END + 1.2345678e-5, 4) AS reference FROM g""")
def reference_pool(spark, sf):
    segment = F.concat(F.length("name").cast("string"), F.lit(":"), F.col("name").rlike("[0-9]").cast("int").cast("string"))
    rows = sales(spark, sf).withColumns({"segment": segment, "t": F.unix_micros(F.col("sale_at").cast("timestamp")), "all": F.lit(1)})
    rows = asof.running_before(rows, ["segment"], "t", F.col("price")).withColumnsRenamed({"n_before": "n_seg", "sum_before": "s_seg"})
    rows = asof.running_before(rows, ["all"], "t", F.col("price")).withColumnsRenamed({"n_before": "n_all", "sum_before": "s_all"})
    mean = F.when(F.col("n_seg") >= 3, F.col("s_seg") / F.col("n_seg")).when(F.col("n_all") > 0, F.try_divide("s_all", "n_all"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "n_seg", "n_all", F.round(mean + HALF, 4).alias("reference"))


@query("SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1")
def sole_aliases(spark, sf):
    return merge.sole_alias(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


@query("""WITH r AS (SELECT DISTINCT c_custkey AS k FROM customer), a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(r.k, a.k) AS k, CASE WHEN r.k IS NULL THEN 'foreign' WHEN a.k IS NULL THEN 'missing' WHEN n = 1 THEN 'matched' ELSE 'duplicate' END AS state, coalesce(n, 0) AS answers FROM r FULL JOIN a ON r.k = a.k""")
def reconciliation(spark, sf):
    return merge.reconciled(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""SELECT c_custkey, c_mktsegment, round(coalesce(avg(o_totalprice), 0) + 1.2345678e-5, 4) AS estimate, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def estimates_joined(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"), F.count("*").alias("orders"))
    c = table(spark, sf, "customer")
    return c.join(per, c["c_custkey"] == per["o_custkey"], "left").select("c_custkey", "c_mktsegment", F.round(F.coalesce("m", F.lit(0.0)) + HALF, 4).alias("estimate"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query(f"""WITH s AS (SELECT row_id, {_PLAIN_NAME} AS name FROM sold_records), m AS (SELECT DISTINCT {_PLAIN_NAME} AS name FROM market_events) SELECT row_id, name FROM s WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM m WHERE name IS NOT NULL)""")
def unseen_names(spark, sf):
    named = lambda t, *c: table(spark, sf, t).select(*c, shown_name(F.col("username")).alias("name"))
    return named("sold_records", "row_id").where("name is not null").join(named("market_events"), "name", "left_anti").select("row_id", "name")


@query(f"""WITH s AS (SELECT row_id, priceTon, {_PLAIN_NAME} AS name FROM sold_records), m AS (SELECT priceTon, {_PLAIN_NAME} AS name FROM market_events)
SELECT row_id FROM s WHERE EXISTS (SELECT 1 FROM m WHERE m.name = s.name AND abs(m.priceTon - s.priceTon) <= greatest(1, abs(m.priceTon), abs(s.priceTon)) * 1e-12)""")
def tolerant_matches(spark, sf):
    named = lambda t, *c: table(spark, sf, t).select(*c, "priceTon", shown_name(F.col("username")).alias("name"))
    return merge.tolerant_match(named("sold_records", "row_id"), named("market_events"), "name", "priceTon").select("row_id")


# ---- validation

_RULES_SQL = ("SELECT row_id, array_to_string(list_filter([CASE WHEN NOT coalesce(eventType IS NOT NULL, false) THEN 'eventType' END, CASE WHEN NOT coalesce(priceTon IS NULL OR priceTon > 0, false) THEN 'priceTon' END, "
  "CASE WHEN NOT coalesce(feesTon IS NULL OR feesTon >= 0, false) THEN 'feesTon' END, CASE WHEN NOT coalesce(eventType <> 'sale' OR priceTon IS NOT NULL, false) THEN 'salePrice' END, "
  "CASE WHEN NOT coalesce(eventType <> 'bid' OR bidTon IS NOT NULL, false) THEN 'bid' END, CASE WHEN NOT coalesce(lower(trim(confidence)) IN ('high','medium','low'), false) THEN 'confidence' END, "
  "CASE WHEN NOT coalesce(provenance.page IS NULL OR provenance.page > 0, false) THEN 'page' END, CASE WHEN NOT coalesce(provenance.sourceUrl IS NULL OR (length(provenance.sourceUrl) <= 2048 AND regexp_matches(provenance.sourceUrl, '^https?://[^/ ]+')), false) THEN 'sourceUrl' END, "
  "CASE WHEN NOT coalesce(txHash IS NULL OR length(txHash) BETWEEN 1 AND 128, false) THEN 'txHash' END], lambda x: x IS NOT NULL), ',') AS errors FROM market_events")  # fmt: skip


def event_rules() -> dict[str, Column]:
    c, kind, url = F.col, F.col("eventType"), F.col("provenance.sourceUrl")
    return {
        "eventType": kind.isNotNull(),
        "priceTon": c("priceTon").isNull() | (c("priceTon") > 0),
        "feesTon": c("feesTon").isNull() | (c("feesTon") >= 0),
        "salePrice": (kind != "sale") | c("priceTon").isNotNull(),
        "bid": (kind != "bid") | c("bidTon").isNotNull(),
        "confidence": F.lower(F.trim("confidence")).isin("high", "medium", "low"),
        "page": c("provenance.page").isNull() | (c("provenance.page") > 0),
        "sourceUrl": url.isNull() | ((F.length(url) <= 2048) & url.rlike("^https?://[^/ ]+")),
        "txHash": c("txHash").isNull() | F.length("txHash").between(1, 128),
    }


@query(_RULES_SQL)
def events_validated(spark, sf):
    return table(spark, sf, "market_events").select("row_id", F.array_join(validate.errors(event_rules()), ",").alias("errors"))


@query()
def actions_canonical(spark, sf):
    return validate.with_canonical(table(spark, sf, "raw_actions"), "delivery_id", "details")


# ---- merges

@query("""WITH e AS (SELECT lower(trim(eventId, chr(32) || chr(9) || chr(10) || chr(13))) AS k, * FROM market_events), g AS (SELECT k, count(*) AS n,
 max(CASE lower(trim(confidence)) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS grade_rank, min(priceTon) AS lo, max(priceTon) AS hi, min(eventType) AS t0, max(eventType) AS t1 FROM e WHERE k IS NOT NULL GROUP BY k)
SELECT k, n, grade_rank, CASE WHEN abs(lo - hi) <= greatest(1, abs(lo), abs(hi)) * 1e-12 THEN lo END AS priceTon, CASE WHEN t0 = t1 THEN t0 END AS eventType,
 concat_ws(',', CASE WHEN NOT abs(lo - hi) <= greatest(1, abs(lo), abs(hi)) * 1e-12 THEN 'priceTon' END, CASE WHEN t0 <> t1 THEN 'eventType' END) AS conflicts FROM g""")
def events_merged(spark, sf):
    e = table(spark, sf, "market_events").select(F.lower(F.regexp_replace("eventId", r"^[ \t\n\r]+|[ \t\n\r]+$", "")).alias("k"), "priceTon", "eventType", "confidence")
    return merge.merged_events(e, "k", ["priceTon"], ["eventType"], "confidence")


@query("""WITH c AS (SELECT eventId, username, priceTon, count(*) AS copies FROM sold_records GROUP BY ALL)
SELECT eventId, min(username) AS username, min(priceTon) AS priceTon, CAST(sum(copies) AS BIGINT) AS copies FROM c WHERE eventId IS NOT NULL GROUP BY eventId HAVING count(*) = 1
UNION ALL SELECT eventId, username, priceTon, copies FROM c WHERE eventId IS NULL""")
def conflicts_dropped(spark, sf):
    rows = table(spark, sf, "sold_records").select("eventId", "username", "priceTon")
    return merge.without_conflicts(rows, "eventId", ["username", "priceTon"]).select("eventId", "username", "priceTon", "copies")


@query("""SELECT listingId, status, row_id FROM (SELECT *, row_number() OVER (PARTITION BY listingId ORDER BY CASE status WHEN 'sold' THEN 0 WHEN 'expired' THEN 1 WHEN 'cancelled' THEN 1 ELSE 2 END, row_id) AS r FROM listing_observations WHERE listingId IS NOT NULL) WHERE r = 1""")
def listings_deduplicated(spark, sf):
    rank = F.when(F.col("status") == "sold", 0).when(F.col("status").isin("expired", "cancelled"), 1).otherwise(2)
    rows = table(spark, sf, "listing_observations").where("listingId is not null")
    return merge.best_per_key(rows, ["listingId"], [rank, F.col("row_id")], ["status", "row_id"])


@query("""WITH a AS (SELECT c_nationkey AS v, min(c_custkey) AS o FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS v, min(s_suppkey) AS o FROM supplier GROUP BY 1),
u AS (SELECT v, 2 * row_number() OVER (ORDER BY o, v) AS p FROM a UNION ALL SELECT v, 2 * row_number() OVER (ORDER BY o, v) + 1 FROM b)
SELECT v, min(p) AS place FROM u GROUP BY v ORDER BY place LIMIT 20""")
def lists_interleaved(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("v"), F.col("c_custkey").alias("o"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("v"), F.col("s_suppkey").alias("o"))
    return merge.interleaved(a, b, "v", "o", 20)


@query("""SELECT coalesce(h.u, c.u) AS u, coalesce(c.n, h.n) AS n, coalesce(c.p, h.p) AS p FROM (SELECT username AS u, count(*) AS n, max(askTon) AS p FROM listing_observations WHERE username IS NOT NULL GROUP BY 1) h
 FULL JOIN (SELECT username AS u, count(*) AS n, max(priceTon) AS p FROM sold_records WHERE username IS NOT NULL GROUP BY 1) c ON h.u = c.u""")
def favorites_upserted(spark, sf):
    held = table(spark, sf, "listing_observations").where("username is not null").groupBy(F.col("username").alias("u")).agg(F.count("*").alias("n"), F.max("askTon").alias("p"))
    new = table(spark, sf, "sold_records").where("username is not null").groupBy(F.col("username").alias("u")).agg(F.count("*").alias("n"), F.max("priceTon").alias("p"))
    return merge.upserted(held, new, ["u"])


# ---- aggregates

@query(f"""WITH {SALES_SQL} SELECT length(name) AS len, count(*) AS n, round(avg(price), 4) AS mean, round(stddev_pop(price), 4) AS sd, round(quantile_cont(price, 0.25), 4) AS q25, round(quantile_cont(price, 0.5), 4) AS q50,
 round(pow(sum(weight), 2) / sum(weight * weight), 4) AS ess, round(sum(weight * price) / sum(weight), 4) AS wmean, count(DISTINCT sale_at) AS times, max(sale_at) AS latest, round(sum(weight * pow(price - predicted, 2)) / sum(weight), 0) AS wmse FROM sales GROUP BY 1""")
def price_statistics(spark, sf):
    w, p = F.col("weight"), F.col("price")
    rows = sales(spark, sf).withColumn("len", F.length("name"))
    sums = rows.groupBy("len").agg(
        F.count("*").alias("n"), F.round(F.avg(p), 4).alias("mean"), F.round(F.stddev_pop(p), 4).alias("sd"),
        F.round(weighted.effective_size(w), 4).alias("ess"), F.round(F.sum(w * p) / F.sum(w), 4).alias("wmean"), F.count_distinct("sale_at").alias("times"), F.max("sale_at").alias("latest"), F.round(F.sum(w * F.pow(p - F.col("predicted"), 2)) / F.sum(w), 0).alias("wmse"),
    )
    quantiles = weighted.linear_quantiles(rows, ["len"], "price", [0.25, 0.5])
    return sums.join(quantiles.select("len", F.round("q_25", 4).alias("q25"), F.round("q_50", 4).alias("q50")), "len")


_POINTS_SQL = f"WITH {SALES_SQL}, g AS (SELECT length(name) AS len, price, sum(weight) AS p FROM sales GROUP BY ALL), c AS (SELECT *, sum(p) OVER (PARTITION BY len ORDER BY price) AS c, sum(p) OVER (PARTITION BY len) AS w FROM g)"


@query(_POINTS_SQL + " SELECT len, min(price) AS quantile FROM c WHERE c >= 0.9 * w * (1 - 1e-12) GROUP BY len")
def quantile_step(spark, sf):
    return weighted.step_quantile(sales(spark, sf).withColumn("len", F.length("name")), ["len"], "price", "weight", 0.9)


@query(_POINTS_SQL + """, d AS (SELECT *, (c - p / 2) / w AS pos FROM c), e AS (SELECT *, lag(pos) OVER (PARTITION BY len ORDER BY price) AS pos0, lag(price) OVER (PARTITION BY len ORDER BY price) AS v0 FROM d)
SELECT len, round(coalesce(arg_min(CASE WHEN pos0 IS NULL THEN price ELSE v0 + (price - v0) * (0.1 - pos0) / (pos - pos0) END, pos) FILTER (pos >= 0.1), max(price)), 4) AS q_10,
 round(coalesce(arg_min(CASE WHEN pos0 IS NULL THEN price ELSE v0 + (price - v0) * (0.5 - pos0) / (pos - pos0) END, pos) FILTER (pos >= 0.5), max(price)), 4) AS q_50 FROM e GROUP BY len""")
def quantile_midpoint(spark, sf):
    out = weighted.midpoint_quantile(sales(spark, sf).withColumn("len", F.length("name")), ["len"], "price", "weight", [0.1, 0.5])
    return out.select("len", F.round("q_10", 4).alias("q_10"), F.round("q_50", 4).alias("q_50"))


@query(f"""WITH {SALES_SQL} SELECT CAST(year(sale_at) AS INT) AS y, count(*) AS n, round(sqrt(avg(pow(ln(1 + predicted) - ln(1 + price), 2))), 6) AS rmsle, round(avg(abs(ln(1 + predicted) - ln(1 + price))), 6) AS male,
 round(exp(quantile_cont(abs(ln(predicted / price)), 0.5)), 6) AS median_factor, round(avg(CASE WHEN abs(ln(predicted / price)) <= ln(2) + 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS within2x,
 round(avg(CASE WHEN abs(ln(predicted / price)) <= ln(3) + 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS within3x FROM sales GROUP BY 1""")
def prediction_accuracy(spark, sf):
    out = weighted.accuracy(sales(spark, sf).withColumn("y", F.year("sale_at")), ["y"], "price", "predicted")
    return out.select("y", "n", *(r6(c).alias(c) for c in ("rmsle", "male", "median_factor", "within2x", "within3x")))


@query(f"""WITH {SALES_SQL}, a AS (SELECT price, predicted, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2 AS ra, rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2 AS rp FROM sales)
SELECT count(*) AS n, round(corr(ra, rp), 6) AS spearman, round(corr(price, predicted), 6) AS pearson FROM a""")
def rank_correlation(spark, sf):
    rows = sales(spark, sf).select("price", "predicted")
    ranked = weighted.average_ranks(weighted.average_ranks(rows, "price", "ra"), "predicted", "rp")
    return ranked.agg(F.count("*").alias("n"), r6(weighted.correlation(F.col("ra"), F.col("rp"))).alias("spearman"), r6(weighted.correlation(F.col("price"), F.col("predicted"))).alias("pearson"))


@query(f"""WITH {SALES_SQL} SELECT CAST(year(sale_at) AS INT) AS y, round(avg(CASE WHEN price BETWEEN predicted * 0.9 AND predicted * 1.1 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(ln(1 + predicted * 1.1) - ln(1 + predicted * 0.9)), 6) AS width FROM sales GROUP BY 1""")
def interval_coverage(spark, sf):
    lo, hi = F.col("predicted") * 0.9, F.col("predicted") * 1.1
    return sales(spark, sf).groupBy(F.year("sale_at").alias("y")).agg(r6(F.avg(F.col("price").between(lo, hi).cast("double"))).alias("coverage"), r6(F.avg(F.log1p(hi) - F.log1p(lo))).alias("width"))


@query(f"""WITH {SALES_SQL}, s AS (SELECT CAST(year(sale_at) AS INT) AS y, round(price, -2) AS a, round(predicted, -2) AS p FROM sales), k AS (SELECT y, greatest(ceil(count(*) * 0.05), 1) AS k FROM s GROUP BY y),
r AS (SELECT s.y, k, a, p, rank() OVER (PARTITION BY s.y ORDER BY a DESC) - 1 AS ba, count(*) OVER (PARTITION BY s.y, a) AS na, rank() OVER (PARTITION BY s.y ORDER BY p DESC) - 1 AS bp, count(*) OVER (PARTITION BY s.y, p) AS np FROM s JOIN k ON s.y = k.y)
SELECT y, CAST(max(k) AS BIGINT) AS selected, round(sum(greatest(0, least(1, (k - ba) / na)) * greatest(0, least(1, (k - bp) / np))) / max(k), 6) AS recall FROM r GROUP BY y""")
def top_tail_recall(spark, sf):
    rows = sales(spark, sf).select(F.year("sale_at").alias("y"), F.round("price", -2).alias("a"), F.round("predicted", -2).alias("p"))
    return weighted.tail_recall(rows, ["y"], "a", "p", 0.05).select("y", "selected", r6("recall").alias("recall"))


@query(f"""WITH {SALES_SQL}, n AS (SELECT name, avg(price) AS m FROM sales GROUP BY 1) SELECT name, round((rank() OVER (ORDER BY round(m, 6)) - 1) / count(*) OVER (), 6) AS below FROM n""")
def percentile_ranks(spark, sf):
    n = sales(spark, sf).groupBy("name").agg(r6(F.avg("price")).alias("m"))
    ranked = weighted.average_ranks(n, "m", "r")
    ties = ranked.groupBy("m").agg(F.count("*").alias("t"))
    total = n.agg(F.count("*").alias("all"))
    return ranked.join(ties, "m").join(F.broadcast(total)).select("name", r6((F.col("r") - (F.col("t") + 1) / 2) / F.col("all")).alias("below"))


@query(f"""WITH {SALES_SQL}, s AS (SELECT *, unnest(list_filter([CASE WHEN length(name) <= 8 THEN 'short' END, CASE WHEN regexp_matches(name,'[0-9]') THEN 'digits' END, CASE WHEN contains(name,'_') THEN 'underscore' END, CASE WHEN price > 10000 THEN 'dear' END], lambda x: x IS NOT NULL)) AS slice FROM sales)
SELECT slice, count(*) AS n, round(avg(price), 4) AS mean FROM s GROUP BY 1""")
def named_slices(spark, sf):
    n, p = F.col("name"), F.col("price")
    names = F.array_compact(F.array(F.when(F.length(n) <= 8, "short"), F.when(n.rlike("[0-9]"), "digits"), F.when(n.contains("_"), "underscore"), F.when(p > 10000, "dear")))
    return sales(spark, sf).select("price", F.explode(names).alias("slice")).groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean"))


@query(f"""WITH n AS (SELECT {_PLAIN_NAME} AS name, provenance.source AS source, eventType AS kind FROM market_events), p AS (SELECT name, bool_or(kind = 'sale') AS sold, bool_or(kind = 'listed') AS listed, count(DISTINCT source) AS sources FROM n WHERE name IS NOT NULL GROUP BY 1)
SELECT name, sources, CASE WHEN sold THEN 'taken' WHEN listed AND sources > 1 THEN 'confirmed' WHEN listed THEN 'likely' ELSE 'unknown' END AS status FROM p""")
def status_rollup(spark, sf):
    n = table(spark, sf, "market_events").select(shown_name(F.col("username")).alias("name"), F.col("provenance.source").alias("source"), F.col("eventType").alias("kind")).where("name is not null")
    p = n.groupBy("name").agg(F.coalesce(F.bool_or(F.col("kind") == "sale"), F.lit(False)).alias("sold"), F.coalesce(F.bool_or(F.col("kind") == "listed"), F.lit(False)).alias("listed"), F.count_distinct("source").alias("sources"))
    return p.select("name", "sources", F.when(F.col("sold"), "taken").when(F.col("listed") & (F.col("sources") > 1), "confirmed").when(F.col("listed"), "likely").otherwise("unknown").alias("status"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def results_pivoted(spark, sf):
    out = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return out.select("o_orderpriority", *(F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in "FOP"))


_FEEDS = ["quillmart", "harborlist"]


@query(f"""WITH n AS (SELECT row_id, {_PLAIN_NAME} AS name, provenance.source AS source, priceTon AS price, nullif(trim(eventAt), '') AS time FROM market_events)
SELECT name, {", ".join(f"arg_min({f}, row_id) FILTER ({c} AND {f} IS NOT NULL) AS {s}{f}" for s, c in (("quillmart_", "source = 'quillmart'"), ("harborlist_", "source = 'harborlist'"), ("direct_", "coalesce(source NOT IN ('quillmart', 'harborlist'), true)"), ("", "true")) for f in ("price", "time"))}
FROM n WHERE name IS NOT NULL GROUP BY 1""")
def results_grouped(spark, sf):
    rows = table(spark, sf, "market_events").select("row_id", shown_name(F.col("username")).alias("name"), F.col("provenance.source").alias("source"), F.col("priceTon").alias("price"), F.nullif(F.trim("eventAt"), F.lit("")).alias("time"))
    return merge.first_by_source(rows, "name", "source", _FEEDS, "row_id", ["price", "time"])


# ---- survival and lifecycles

_DUR_SQL = """d AS (SELECT status AS segment, floor((epoch_ms(coalesce(endedAt, soldAt, lastObservedAt)) - epoch_ms(listedAt)) / 86400000) AS days, CASE status WHEN 'sold' THEN 'sale' WHEN 'active' THEN 'censored' ELSE 'competing' END AS event,
 CASE WHEN askTon < 50 THEN 'low' ELSE 'high' END AS tier, 1.0 AS w FROM listing_observations WHERE listedAt IS NOT NULL AND coalesce(endedAt, soldAt, lastObservedAt) >= listedAt AND askTon IS NOT NULL)"""


def _durations(spark, sf):
    end = F.coalesce("endedAt", "soldAt", "lastObservedAt")
    rows = table(spark, sf, "listing_observations").where(F.col("listedAt").isNotNull() & (end >= F.col("listedAt")) & F.col("askTon").isNotNull())
    days = F.floor((F.unix_millis(end.cast("timestamp")) - F.unix_millis(F.col("listedAt").cast("timestamp"))) / 86_400_000).cast("double")
    event = F.when(F.col("status") == "sold", "sale").when(F.col("status") == "active", "censored").otherwise("competing")
    return rows.select(F.when(F.col("askTon") < 50, "low").otherwise("high").alias("tier"), days.alias("days"), event.alias("event"), F.lit(1.0).alias("w"))


@query(f"""WITH RECURSIVE {_DUR_SQL}, t AS (SELECT tier, days, sum(w) AS n, coalesce(sum(w) FILTER (event = 'sale'), 0) AS s, coalesce(sum(w) FILTER (event = 'competing'), 0) AS c FROM d GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY tier ORDER BY days DESC) AS risk FROM t), e AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY days) AS i FROM r WHERE s + c > 0),
f AS (SELECT tier, i, days, risk, s / risk AS cum, 1 - (s + c) / risk AS alive FROM e WHERE i = 1 UNION ALL SELECT e.tier, e.i, e.days, e.risk, f.cum + f.alive * e.s / e.risk, f.alive * (1 - (e.s + e.c) / e.risk) FROM f JOIN e ON e.tier = f.tier AND e.i = f.i + 1)
SELECT tier, days, risk AS at_risk, round(cum, 6) AS cumulative FROM f""")
def survival_curve(spark, sf):
    return weighted.sale_curve(_durations(spark, sf), ["tier"], "days", "event", "w").select("tier", "days", "at_risk", r6("cumulative").alias("cumulative"))


@query()
def median_days_to_sale(spark, sf):
    return weighted.median_duration(weighted.sale_curve(_durations(spark, sf), ["tier"], "days", "event", "w"), ["tier"], "days")


@query(f"""WITH {_DUR_SQL} SELECT tier, round(sum(w) FILTER (days >= 30 OR event <> 'censored') / sum(w), 6) AS support30, round(sum(w) FILTER (days >= 90 OR event <> 'censored') / sum(w), 6) AS support90 FROM d GROUP BY 1""")
def followup_support(spark, sf):
    share = lambda h: r6(F.sum(F.when((F.col("days") >= h) | (F.col("event") != "censored"), F.col("w")).otherwise(0.0)) / F.sum("w"))
    return _durations(spark, sf).groupBy("tier").agg(share(30).alias("support30"), share(90).alias("support90"))


@query(f"""WITH {MARKET_SQL}, m AS (SELECT *, lead(moment) OVER w AS ended_at, lead(kind) OVER w AS ended_by FROM market WHERE kind <> 'bid' WINDOW w AS (PARTITION BY asset ORDER BY moment, tie))
SELECT asset, moment AS listed_at, price, ended_at, ended_by, CASE WHEN ended_by IS NULL THEN 'open' WHEN ended_by = 'listed' THEN 'repriced' ELSE 'ended' END AS state FROM m WHERE kind = 'listed'""")
def listing_lifecycles(spark, sf):
    return lifecycle.listings(market(table(spark, sf, "events")), "asset", "moment", "kind", "tie")


@query(f"""WITH {MARKET_SQL}, m AS (SELECT *, lag(kind) OVER (PARTITION BY asset ORDER BY moment, tie) AS before FROM market WHERE kind <> 'bid') SELECT asset, moment, tie, kind FROM m WHERE kind <> 'listed' AND before IS DISTINCT FROM 'listed'""")
def unmatched_endings(spark, sf):
    return lifecycle.unmatched_endings(market(table(spark, sf, "events")), "asset", "moment", "kind", "tie").select("asset", "moment", "tie", "kind")


@query("""WITH v AS (SELECT *, TIMESTAMP '2024-06-01 00:00:00' AS v, CASE WHEN status = 'sold' THEN coalesce(soldAt, endedAt) WHEN status IN ('expired','cancelled') THEN endedAt END AS fin FROM listing_observations),
k AS (SELECT *, fin IS NOT NULL AND fin <= v AS known FROM v), t AS (SELECT *, CASE WHEN known THEN fin ELSE least(coalesce(lastObservedAt, v), v) END AS through FROM k)
SELECT row_id, CASE WHEN NOT known THEN 'censored' WHEN status = 'sold' THEN 'sale' ELSE 'competing' END AS event, through FROM t WHERE listedAt <= v AND through >= listedAt AND status IN ('active','sold','expired','cancelled')""")
def known_at_time(spark, sf):
    at = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    rows = table(spark, sf, "listing_observations")
    rows = rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("listedAt", "lastObservedAt", "endedAt", "soldAt")})
    return rows.select("row_id", lifecycle.status_at(at).alias("s")).where("s is not null").select("row_id", "s.event", "s.through")


# ---- ordered operators

_PACKED = """c AS (SELECT s, n, row_number() OVER (ORDER BY s) AS i, sum(n) OVER (ORDER BY s) - n AS before, sum(n) OVER () AS rows, count(*) OVER () AS groups FROM g),
 r AS (SELECT i, s, n, rows, groups, 0 AS bin, n AS cur, (n >= ceil(rows / {b}) AND groups - i >= {b} - 1 AND {b} > 1) AS closed FROM c WHERE i = 1
  UNION ALL SELECT i, s, n, rows, groups, bin, cur, (bin < {b} - 1 AND cur >= ceil((rows - before) / ({b} - bin)) AND groups - i >= {b} - bin - 1) FROM
  (SELECT c.i, c.s, c.n, c.rows, c.groups, c.before, r.bin + CAST(r.closed AS INT) AS bin, c.n + CASE WHEN r.closed THEN 0 ELSE r.cur END AS cur FROM r JOIN c ON c.i = r.i + 1))"""


@query(f"""WITH RECURSIVE {SALES_SQL}, g AS (SELECT round(price, -2) AS s, count(*) AS n FROM sales GROUP BY 1), {_PACKED.format(b="least(8, groups)")} SELECT s, n, CAST(bin AS INT) AS bin FROM r""")
def tie_aware_bins(spark, sf):
    return weighted.tie_aware_bins(sales(spark, sf).select(F.round("price", -2).alias("s")), "s", 8)


@query(f"""WITH RECURSIVE {SALES_SQL}, x AS (SELECT round(predicted, -3) AS s, ln(price / predicted) AS r FROM sales), g AS (SELECT s, count(*) AS n FROM x GROUP BY 1), {_PACKED.format(b="least(4, groups)")},
y AS (SELECT CAST(bin AS INT) AS bin, x.s, x.r, row_number() OVER (PARTITION BY bin ORDER BY x.r) AS k, count(*) OVER (PARTITION BY bin) AS c FROM x JOIN r ON x.s = r.s)
SELECT bin, max(s) AS max_score, count(*) AS n, round(max(r) FILTER (k = greatest(1, floor((c + 1) * 0.1 + 1e-9))), 6) AS p10, round(quantile_cont(r, 0.5), 6) AS p50, round(max(r) FILTER (k = least(c, ceil((c + 1) * 0.9 - 1e-9))), 6) AS p90 FROM y GROUP BY bin""")
def residual_bins(spark, sf):
    rows = sales(spark, sf).select(F.round("predicted", -3).alias("s"), F.ln(F.col("price") / F.col("predicted")).alias("r"))
    return calibrate.residual_bins(rows, "s", "r", 4).select("bin", "max_score", "n", *(r6(c).alias(c) for c in ("p10", "p50", "p90")))


def _scored_sales(spark, sf):
    rows = sales(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "predicted", F.round("predicted", -3).alias("s"))
    near = F.greatest("price", "predicted") <= 2 * F.least("price", "predicted")
    return rows.withColumns({"r": F.ln(F.col("price") / F.col("predicted")), "hit": near.cast("int")})


@query()
def price_confidence(spark, sf):
    rows = _scored_sales(spark, sf)
    bins = calibrate.confidence(rows, "s", "hit")
    found = calibrate.lookup_bin(rows, "s", bins).join(F.broadcast(bins.select("bin", "probability")), "bin", "left")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s", "bin", "probability")


@query()
def price_intervals(spark, sf):
    rows = _scored_sales(spark, sf)
    bins = calibrate.residual_bins(rows, "s", "r", 4)
    found = calibrate.lookup_bin(rows, "s", bins).join(F.broadcast(bins.select("bin", "p10", "p50", "p90")), "bin", "left")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "bin", *((F.col("predicted") * F.exp(p)).alias(p) for p in ("p10", "p50", "p90")))


@query("""SELECT o_orderkey, CASE WHEN ('0x' || substr(sha256('7:' || o_orderkey), 1, 12))::HUGEINT / 281474976710656.0 < 0.2 THEN 'test' WHEN ('0x' || substr(sha256('7:' || o_orderkey), 1, 12))::HUGEINT / 281474976710656.0 < 0.3 THEN 'calibration' ELSE 'train' END AS cohort FROM orders""")
def random_split(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", splits.hashed_cohort(F.col("o_orderkey"), 7, {"test": 0.2, "calibration": 0.1}).alias("cohort"))


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, sha256('7:' || o_custkey) AS k FROM orders GROUP BY 1), c AS (SELECT *, (sum(n) OVER (ORDER BY k) - n) / sum(n) OVER () AS before FROM g)
SELECT o_custkey, n, CASE WHEN before < 0.2 - 1e-12 THEN 'test' WHEN before < 0.2 + 0.1 - 1e-12 THEN 'calibration' ELSE 'train' END AS cohort FROM c""")
def group_split(spark, sf):
    return splits.group_cohorts(table(spark, sf, "orders"), "o_custkey", 7, {"test": 0.2, "calibration": 0.1})


@query("""WITH g AS (SELECT o_custkey, min(o_orderdate) AS first, count(*) AS n, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') AS a, count(*) FILTER (o_orderdate >= TIMESTAMP '1997-01-01') AS b FROM orders GROUP BY 1)
SELECT o_custkey, first, n, CASE WHEN first < TIMESTAMP '1996-01-01' THEN 0 WHEN first < TIMESTAMP '1997-01-01' THEN 1 ELSE 2 END AS cohort, CASE WHEN first < TIMESTAMP '1996-01-01' THEN a WHEN first < TIMESTAMP '1997-01-01' THEN b ELSE 0 END AS excluded FROM g""")
def temporal_split(spark, sf):
    rows = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    cuts = [F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (1996, 1997)]
    out = splits.temporal_cohorts(rows, "o_custkey", "o_orderdate", cuts)
    return out.withColumn("excluded", F.col("excluded").cast("bigint"))


@query(f"""WITH {SALES_SQL} SELECT name, l_orderkey, l_partkey, l_suppkey, l_linenumber, price FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY price DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS r FROM sales) WHERE r <= 3""")
def top_per_name(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("name").orderBy(F.desc("price"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return sales(spark, sf).withColumn("r", F.row_number().over(order)).where("r <= 3").select("name", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "price")


@query(f"""WITH n AS (SELECT DISTINCT {_PLAIN_NAME} AS name FROM listing_observations), m AS (SELECT name, '~~~~' || name || '$' AS p FROM n WHERE name IS NOT NULL), w AS (SELECT p, unnest(range(1, length(p) - 3)) AS i FROM m)
SELECT substr(p, i, 4) AS context, substr(p, i + 4, 1) AS following, count(*) AS n FROM w GROUP BY ALL""")
def training_windows(spark, sf):
    names = table(spark, sf, "listing_observations").select(shown_name(F.col("username")).alias("name")).where("name is not null").distinct()
    p = F.concat(F.lit("~~~~"), "name", F.lit("$"))
    rows = names.select(p.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.length("p") - 4)).alias("i"))
    return rows.groupBy(F.expr("substring(p, i, 4)").alias("context"), F.expr("substring(p, i + 4, 1)").alias("following")).agg(F.count("*").alias("n"))


@query("""SELECT row_id, username, priceTon FROM sold_records ORDER BY priceTon DESC NULLS LAST, username ASC NULLS LAST, row_id LIMIT 100""")
def dearest_sales(spark, sf):
    return table(spark, sf, "sold_records").orderBy(F.desc_nulls_last("priceTon"), F.asc_nulls_last("username"), "row_id").limit(100).select("row_id", "username", "priceTon")


@query(f"""WITH {SALES_SQL}, n AS (SELECT name, avg(price) AS m FROM sales GROUP BY 1), r AS (SELECT name, (rank() OVER (ORDER BY round(m, 6)) - 1) / count(*) OVER () AS q FROM n), w AS (SELECT name, CASE WHEN q >= 0.75 THEN 4 WHEN q >= 0.5 THEN 2 WHEN q >= 0.25 THEN 1 ELSE 0 END AS c FROM r)
SELECT name, c AS copy_no FROM (SELECT name, unnest(range(1, c + 1)) AS c FROM w)""")
def weighted_corpus(spark, sf):
    q = F.col("below")
    copies = F.when(q >= 0.75, 4).when(q >= 0.5, 2).when(q >= 0.25, 1).otherwise(0)
    return percentile_ranks(spark, sf).withColumn("c", copies).where("c > 0").select("name", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c").cast("bigint"))).alias("copy_no"))


# ---- generators and models (G2-G7, L3-L5); their properties are tested

@query()
def generated_names(spark, sf):
    n = table(spark, sf, "part").count()
    return generate.readable(spark, n, 5, 9, 11).unionByName(generate.random_names(spark, n, 5, 9, 11)).distinct()


@query()
def compound_names(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return generate.compounds(words, words, "w", 5, 3)


_MODEL = ["l_quantity", "l_discount", "p_retailprice", "p_size"]


def _matrix(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(F.col(c).cast("double").alias(c) for c in _MODEL), F.ln("l_extendedprice").alias("y"))


@query()
def ridge_predictions(spark, sf):
    rows = checkpointed(_matrix(spark, sf), "matrix")
    beta = models.ridge(rows, _MODEL, "y", penalty=1.0, huber=2)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y", models.predicted(beta, _MODEL).alias("prediction"))


@query()
def boosted_predictions(spark, sf):
    rows = _matrix(spark, sf)
    vector, model = models.boosted(rows, _MODEL, "y", rounds=10)
    return model.transform(vector.transform(rows)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y", "prediction")


@query()
def tail_predictions(spark, sf):
    rows = _matrix(spark, sf).withColumn("price", F.exp("y"))
    models_ = models.tail_scores(rows, _MODEL, "price")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(models.predicted(b, _MODEL).alias(f"above_{int(t)}") for t, b in models_.items()))


# ---- sources, sinks and streams

@query("SELECT row_id, eventId, username, priceTon, saleAt, source FROM sold_records")
def json_round_trip(spark, sf):
    path = work_dir(spark, "sold-json")
    wanted = table(spark, sf, "sold_records").select("row_id", "eventId", "username", "priceTon", "saleAt", "source")
    wanted.write.json(path)
    return files.strict_json(spark, path, T.StructType(wanted.schema.fields))


@query("""SELECT CAST(row_id // 50 AS BIGINT) AS page, trim(coalesce(username, '')) AS name, priceTon AS price FROM sold_records""")
def html_pages_parsed(spark, sf):
    text = F.concat(F.lit("<tr><td>"), F.coalesce("username", F.lit("")), F.lit("</td><td><b>"), F.coalesce(F.col("priceTon").cast("string"), F.lit("")), F.lit("</b> TON</td></tr>"))
    pages = table(spark, sf, "sold_records").select(F.expr("row_id div 50").alias("page_id"), text.alias("t")).groupBy("page_id").agg(F.concat(F.lit("<html><table>"), F.array_join(F.collect_list("t"), ""), F.lit("</table></html>")).alias("html"))
    cells = files.table_rows(pages)
    return cells.select("page", F.regexp_replace(F.col("cells")[0], r"^ +| +$", "").alias("name"), H.amount(F.col("cells")[1]).alias("price"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def versioned_store(spark, sf):
    store = files.VersionedTable(spark, work_dir(spark, "orders-store"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    store.save(orders.where("o_orderkey % 2 = 0"))
    store.save(store.load().unionByName(orders.where("o_orderkey % 2 <> 0")))
    return store.load()


@query("SELECT event_id, user_id, event_type, ts, value FROM events")
def stream_events_once(spark, sf):
    schema = table(spark, sf, "events").schema
    seen = streams.read_events(spark, f"{sf}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    again = streams.read_events(spark, f"{sf}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))  # every event observed twice
    once = streams.once(seen.unionByName(again), "ts", ["event_id"], "36500 days")  # no late event is dropped
    return streams.drained(once.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "value"), "events-once")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_windows(spark, sf):
    schema = table(spark, sf, "events").schema
    timed = streams.read_events(spark, f"{sf}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = streams.windowed_counts(timed, "ts", ["event_type"])
    flat = counted.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
    return streams.latest(flat, ["start", "event_type"], "windows")


@query(f"""WITH {MARKET_SQL}, m AS (SELECT *, lead(moment) OVER w AS ended_at, lead(kind) OVER w AS ended_by FROM market WHERE kind <> 'bid' WINDOW w AS (PARTITION BY asset ORDER BY moment, tie))
SELECT CAST(asset AS VARCHAR) AS asset, moment AS listed_at, price, ended_at, ended_by, CASE WHEN ended_by = 'listed' THEN 'repriced' ELSE 'ended' END AS state FROM m WHERE kind = 'listed' AND ended_by IS NOT NULL""")
def stream_lifecycles(spark, sf):
    schema = table(spark, sf, "events").schema
    moves = market(streams.read_events(spark, f"{sf}/events*.parquet", schema)).withColumns({"asset": F.col("asset").cast("string"), "moment": F.col("moment").cast("timestamp")}).withColumnRenamed("moment", "at")
    return streams.drained(lifecycle.stream_listings(moves), "lifecycles")
