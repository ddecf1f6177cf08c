"""Queries of the warehouse, estimate, lexicon and number operators; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namequarry.functions import numbers as N
from namequarry.functions.handles import hashed_banks
from namequarry.functions.instants import with_instant
from namequarry.functions.name_vector import named_features
from namequarry.functions.names import shown_name
from namequarry.operators import actions, calibrate, estimates, generate, lexicon, market, models, splits, weighted
from namequarry.plans.pipeline_queries import market_instants, table
from namequarry.plans.reference_queries import r6
from namequarry.session import checkpointed
from namequarry.sources import sold_pages as pages_
from namequarry.sources import statuses

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_SHOWN = "nullif(regexp_replace(translate(lower(username), 'ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９＿', 'abcdefghijklmnopqrstuvwxyz0123456789_'), '[^a-z0-9_]', '', 'g'), '')"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# ---- the event warehouse

def _canonical(spark: SparkSession, sf: str) -> DataFrame:
    columns = [c for c in table(spark, sf, "market_events").columns if c not in ("row_id", "eventAt", "observedAt")]
    return market.canonical_events(market_instants(spark, sf, *columns))


@query()
def events_canonical(spark, sf):
    return _canonical(spark, sf).select("row_id", "event_id", "identityKind", "eventType", "username", "effective_ms", "provenance.source", F.array_join("errors", ",").alias("errors"))


@query()
def events_migrated(spark, sf):
    feeds = F.broadcast(table(spark, sf, "source_feeds").select("source", "clock_zone", "day_order"))
    sold = with_instant(table(spark, sf, "sold_records").join(feeds, "source", "left"), "saleAt", "event_ms", "clock_zone", "day_order")
    sold = sold.withColumn("observed_ms", F.unix_millis(F.col("scrapedAt").cast("timestamp"))).drop("clock_zone", "day_order")
    canonical = market.canonical_events(checkpointed(market.sales_as_events(sold), "sales-as-events"))
    return market.merged(canonical).select("event_id", "n", "grade_rank", "username", "priceTon", "event_ms", "observed_ms", "effective_ms", "conflicts")


def _lives(spark: SparkSession, sf: str) -> DataFrame:
    e = checkpointed(_canonical(spark, sf).select("event_id", "row_id", "username", "eventType", "event_ms", "observed_ms", "askTon", "reserveTon", "priceTon", "txHash", "nftItemAddress", F.col("provenance.source").alias("source"), F.col("provenance.sourceEventId").alias("source_event")), "canonical-events")
    e = e.withColumn("event_id", F.concat(F.coalesce("event_id", F.lit("")), F.lit("#"), F.col("row_id").cast("string")))  # rows stay apart, so that every row has its outcome
    return market.lifecycles(market.asset_events(e))


@query()
def market_lifecycles(spark, sf):
    return _lives(spark, sf).select("outcome", "id", "username", "status", "ask", "listed_ms", "last_ms", "ended_ms", "sale_price")


@query()
def market_build_counts(spark, sf):
    return _lives(spark, sf).groupBy("outcome", "status").agg(F.count("*").alias("n"), F.count_distinct("asset").alias("assets"))


@query()
def market_liquidity(spark, sf):
    targets = table(spark, sf, "listing_observations").where("row_id % 50 = 0").select(F.col("row_id").alias("target_id"), shown_name(F.col("username")).alias("name"), F.unix_millis(F.coalesce("lastObservedAt", "listedAt").cast("timestamp")).alias("at_ms"), F.lit(None).cast("double").alias("ask"))
    return estimates.listing_estimates(targets, checkpointed(market.as_listings(_lives(spark, sf)), "market-listings"))


# ---- chain actions

@query(actions.action_errors_sql())
def action_errors(spark, sf):
    return actions.action_errors(table(spark, sf, "raw_actions"))


@query()
def actions_merged(spark, sf):
    return actions.merged_revisions(table(spark, sf, "raw_actions")).select("action_key", "revisions", "first_delivery", "last_delivery", "finality", "details", F.size("accounts").alias("accounts"), F.array_join("conflicts", ",").alias("conflicts"))


@query()
def account_identities(spark, sf):
    accounts = table(spark, sf, "raw_actions").select("trace_id", F.explode("accounts").alias("account")).where("account is not null")
    return accounts.groupBy("account").agg(F.count("*").alias("n")).withColumn("identity", actions.address_identity(F.col("account")))


@query("""SELECT account, count(*) AS n, count(DISTINCT trace_id) AS traces FROM (SELECT trace_id, unnest(accounts) AS account FROM raw_actions) WHERE account IS NOT NULL GROUP BY 1""")
def accounts_united(spark, sf):
    accounts = table(spark, sf, "raw_actions").select("trace_id", F.explode("accounts").alias("account")).where("account is not null")
    return accounts.groupBy("account").agg(F.count("*").alias("n"), F.count_distinct("trace_id").alias("traces"))


# ---- sold pages

def _pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "sold_records")
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    at = F.when(F.col("scrapedAt").isNotNull(), F.concat(F.lit("<time datetime='"), F.date_format("scrapedAt", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("'></time>"))).otherwise("")
    text = F.concat(F.lit("<tr><td><div class='table-cell-value-row'><span class='tm-value'>"), cell("username"), F.lit("</span></div></td><td>Sale price <span class='icon-ton'>"), cell("priceTon"), F.lit("</span></td><td class='table-cell-status-thin'>Sold</td><td>"), at, F.lit("</td></tr>"))
    # fifty rows a page
    return rows.select("row_id", "username", "priceTon", "scrapedAt", text.alias("t")).groupBy(F.expr("row_id div 50").alias("page_id")).agg(F.concat(F.lit("<html><body><form><input name='sort' value='ended'></form><table class='tm-table'><tbody>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_id", "t"))), lambda r: r["t"]), ""), F.lit("</tbody></table></body></html>")).alias("html"))


@query()
def sold_pages_read(spark, sf):
    pages = _pages(spark, sf)
    found = pages_.sold_pages(pages)
    views = pages.select("page_id", pages_.listing_view(F.col("html"), F.lit(None).cast("string")).alias("view"))
    return found.join(views, "page_id")


@query()
def sold_pages_unique(spark, sf):
    return pages_.unique_sales(checkpointed(pages_.sold_pages(_pages(spark, sf)), "sold-pages"))[0]


# ---- names

def _words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,12}"), F.lit(0)))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1").select("word")


@query()
def lexical_content(spark, sf):
    names = table(spark, sf, "market_events").select(shown_name(F.col("username")).alias("name"))
    tokens = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    out = lexicon.lexical_content(names, _words(spark, sf), tokens)
    return out.withColumn("words", F.array_join("words", " "))


@query()
def name_feature_vectors(spark, sf):
    names = table(spark, sf, "listing_observations").select(shown_name(F.col("username")).alias("name"))
    tokens = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    found = lexicon.lexical_content(names, _words(spark, sf), tokens)
    made = named_features(F.col("name"), F.struct(*found.columns[1:]))
    return checkpointed(found, "lexical").select("name", F.concat(F.array(*(c.cast("double") for c in made.values())), hashed_banks(F.col("name"))).alias("features"))


@query()
def dictionary_names(spark, sf):
    words = _words(spark, sf)
    made = [generate.dictionary_names(words, "word", p, 5, 12, 7).select("name", F.lit(p).alias("policy")) for p in ("none", "optional", "required")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query()
def names_with_word(spark, sf):
    n = table(spark, sf, "part").count()
    made = [generate.with_word(spark, n, "gold", p, 6, 12, 5).select("name", F.lit(p).alias("position")) for p in ("start", "middle", "end", "any")]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


# ---- numbers

_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_KEYS = _KEY.split(", ")


@query(f"""WITH x AS (SELECT {_KEY}, l_extendedprice AS m, p_retailprice * l_quantity AS c, l_discount * 5 AS f FROM lineitem JOIN part ON l_partkey = p_partkey),
y AS (SELECT *, least(0.65, greatest(f, 0) * 0.65) AS w FROM x)
SELECT {_KEY}, round(CASE WHEN c > 0 THEN greatest(0, exp(least(ln(1 + m) * (1 - w) + ln(1 + c) * w, ln(1 + 1e12))) - 1) ELSE m END, 2) AS blended, CASE WHEN f >= 0.72 THEN 'high' WHEN f >= 0.42 THEN 'medium' ELSE 'low' END AS label,
 round(CASE WHEN c > 0 THEN m / c ELSE 0 END, 6) AS ratio, round(least(greatest(f, 0.1), 0.4), 6) AS clamped FROM y""")
def price_blends(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m, c, f = F.col("l_extendedprice"), F.col("p_retailprice") * F.col("l_quantity"), F.col("l_discount") * 5
    return rows.select(*_KEYS, F.round(N.blended(m, c, f, 0.65), 2).alias("blended"), N.confidence_label(f).alias("label"), r6(N.safe_ratio(m, c)).alias("ratio"), r6(N.clamp(f, 0.1, 0.4)).alias("clamped"))


@query(f"""WITH x AS (SELECT {_KEY}, l_quantity / 10 AS a, l_tax * 10 AS b, l_discount * 10 AS c FROM lineitem), y AS (SELECT *, exp(a / 0.8) AS ea, exp(b / 0.8) AS eb, exp(c / 0.8) AS ec FROM x)
SELECT {_KEY}, round(ea / (ea + eb + ec), 6) AS first, round(eb / (ea + eb + ec), 6) AS second, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS top FROM y""")
def softmax_shares(spark, sf):
    xs = F.array(F.col("l_quantity") / 10, F.col("l_tax") * 10, F.col("l_discount") * 10)
    soft, hard = N.softmax(xs, 0.8), N.softmax(xs, 0)
    return table(spark, sf, "lineitem").select(*_KEYS, r6(soft[0]).alias("first"), r6(soft[1]).alias("second"), (F.array_position(hard, 1.0) - 1).cast("int").alias("top"))


@query(f"""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem)
SELECT {_KEY}, round((l_quantity - mq) / sq, 5) AS quantity, round((l_extendedprice - mp) / sp, 5) AS price, round(sqrt((pow((l_quantity - mq) / sq, 2) + pow((l_extendedprice - mp) / sp, 2)) / 2), 5) AS distance FROM lineitem, s""")
def standardized_rows(spark, sf):
    rows = table(spark, sf, "lineitem")
    s = rows.agg(*(f(c) for c in ("l_quantity", "l_extendedprice") for f in (F.avg, F.stddev_pop))).first()  # four numbers
    z = N.standardized(F.array("l_quantity", "l_extendedprice"), [s[0] or 0.0, s[2] or 0.0], [s[1] or 0.0, s[3] or 0.0])
    rms = F.sqrt((F.pow(z[0], 2) + F.pow(z[1], 2)) / 2)
    return rows.select(*_KEYS, F.round(z[0], 5).alias("quantity"), F.round(z[1], 5).alias("price"), F.round(rms, 5).alias("distance"))


@query("""WITH f AS (SELECT o_custkey % 20 AS seed, sqrt(avg(pow(ln(1 + o_totalprice) - 10, 2))) AS rmsle FROM orders GROUP BY 1)
SELECT count(*) AS seeds, round(avg(rmsle), 6) AS mean, round(stddev_pop(rmsle), 6) AS sd, round(min(rmsle), 6) AS least, round(max(rmsle), 6) AS most FROM f""")
def backtest_summary(spark, sf):
    runs = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 20).alias("seed")).agg(F.sqrt(F.avg(F.pow(F.log1p("o_totalprice") - 10, 2))).alias("rmsle"))
    return runs.agg(F.count("*").alias("seeds"), *(r6(f("rmsle")).alias(n) for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("least", F.min), ("most", F.max))))


@query("""SELECT row_id, round(greatest(0.2, least(1, (CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 0.75 WHEN 'low' THEN 0.4 ELSE 0.65 END) * (CASE provenance.parser WHEN 'fragment-embedded-json' THEN 0.9 WHEN 'fragment-text' THEN 0.7 ELSE 1 END)
 * (CASE WHEN coalesce(saleAt, '') <> '' THEN 1 ELSE 0.9 END))), 6) AS weight FROM sold_records""")
def training_weights(spark, sf):
    return table(spark, sf, "sold_records").select("row_id", r6(N.evidence_weight(F.col("confidence"), F.col("provenance.parser"), F.coalesce("saleAt", F.lit("")) != "")).alias("weight"))


# ---- projections, pools and orders

@query("""SELECT row_id, coalesce(soldAt, endedAt, lastObservedAt) AS at, CASE WHEN soldAt IS NOT NULL THEN 'exact' WHEN coalesce(endedAt, lastObservedAt) IS NOT NULL THEN 'observed' END AS evidence FROM listing_observations""")
def record_times(spark, sf):
    evidence = F.when(F.col("soldAt").isNotNull(), "exact").when(F.coalesce("endedAt", "lastObservedAt").isNotNull(), "observed")
    return table(spark, sf, "listing_observations").select("row_id", F.coalesce("soldAt", "endedAt", "lastObservedAt").alias("at"), evidence.alias("evidence"))


@query("""SELECT row_id, coalesce(nullif(trim(eventId), ''), nullif(trim(txHash), '')) AS id, coalesce(length(eventId) BETWEEN 1 AND 240, false) AS wire FROM market_events""")
def comparable_ids(spark, sf):
    known = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, sf, "market_events").select("row_id", F.coalesce(known("eventId"), known("txHash")).alias("id"), F.coalesce(F.length("eventId").between(1, 240), F.lit(False)).alias("wire"))


@query(f"""WITH f AS (SELECT row_id, {_SHOWN} AS name, source FROM sold_records), gone AS (SELECT DISTINCT {_SHOWN} AS name, provenance.source AS source FROM market_events WHERE eventType = 'cancelled'),
k AS (SELECT f.*, EXISTS (SELECT 1 FROM gone g WHERE g.name = f.name AND g.source = f.source) AS removed FROM f)
SELECT source, count(*) FILTER (removed) AS removed, count(*) FILTER (NOT removed) AS kept FROM k GROUP BY 1""")
def favorites_removed(spark, sf):
    held = table(spark, sf, "sold_records").select("row_id", shown_name(F.col("username")).alias("name"), "source")
    gone = table(spark, sf, "market_events").where("eventType = 'cancelled'").select(shown_name(F.col("username")).alias("name"), F.col("provenance.source").alias("source")).distinct().withColumn("gone", F.lit(True))
    marked = held.join(gone, ["name", "source"], "left")
    return marked.groupBy("source").agg(F.count_if(F.col("gone").isNotNull()).alias("removed"), F.count_if(F.col("gone").isNull()).alias("kept"))


@query(f"""WITH p AS (SELECT name, count(*) AS sales, max(price) AS best FROM (SELECT {_SHOWN} AS name, priceTon AS price FROM sold_records) WHERE name IS NOT NULL GROUP BY 1)
SELECT row_id, l.name, status, coalesce(sales, 0) AS sales, best FROM (SELECT row_id, {_SHOWN} AS name, status FROM listing_observations) l LEFT JOIN p ON l.name = p.name""")
def results_priced(spark, sf):
    prices = table(spark, sf, "sold_records").select(shown_name(F.col("username")).alias("name"), "priceTon").where("name is not null").groupBy("name").agg(F.count("*").alias("sales"), F.max("priceTon").alias("best"))
    return table(spark, sf, "listing_observations").select("row_id", shown_name(F.col("username")).alias("name"), "status").join(prices, "name", "left").select("row_id", "name", "status", F.coalesce("sales", F.lit(0)).alias("sales"), "best")


@query("""WITH c AS (SELECT batch_no, count(*) AS n, count(priceTon) AS priced FROM sold_records GROUP BY 1) SELECT batch_no, CAST(sum(n) OVER w AS BIGINT) AS pool, CAST(sum(priced) OVER w AS BIGINT) AS priced FROM c WINDOW w AS (ORDER BY batch_no)""")
def cohort_pools(spark, sf):
    """Each cohort with all before it. Rows are counted by cohort first; a cohort then has a handful of rows."""
    from pyspark.sql import Window

    counts = table(spark, sf, "sold_records").groupBy("batch_no").agg(F.count("*").alias("n"), F.count("priceTon").alias("p"))
    upto = Window.orderBy("batch_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select("batch_no", F.sum("n").over(upto).alias("pool"), F.sum("p").over(upto).alias("priced"))


_CHECKED = "('quillmart', 'harborlist')"


@query(f"""WITH r AS (SELECT {_SHOWN} AS name, provenance.source AS source, eventType AS kind, lower(trim(confidence)) AS grade FROM market_events), s AS (SELECT * FROM r WHERE name IS NOT NULL AND source IN {_CHECKED}),
g AS (SELECT name, coalesce(bool_or(kind = 'sale'), false) AS taken, coalesce(bool_or(kind = 'mint'), false) AS invalid, coalesce(bool_and(coalesce(kind = 'listed', false)), false) AS free, coalesce(bool_and(coalesce(grade = 'high', false)), false) AS sure, count(DISTINCT source) AS sources FROM s GROUP BY 1)
SELECT name, CASE WHEN taken THEN 'taken' WHEN invalid THEN 'invalid' WHEN NOT free THEN 'unknown' WHEN sources < 2 THEN 'partial' WHEN sure THEN 'confirmed' ELSE 'likely' END AS status FROM g""")
def availability(spark, sf):
    """Roll-up of checks by two sources: a sale says taken, a mint invalid, a listing free, anything else unknown."""
    rows = table(spark, sf, "market_events").select(shown_name(F.col("username")).alias("name"), F.col("provenance.source").alias("source"), F.col("eventType").alias("kind"), F.lower(F.trim("confidence")).alias("grade"))
    rows = rows.where(F.col("name").isNotNull() & F.col("source").isin("quillmart", "harborlist"))
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    g = rows.groupBy("name").agg(F.bool_or(is_("kind", "sale")).alias("taken"), F.bool_or(is_("kind", "mint")).alias("invalid"), F.bool_and(is_("kind", "listed")).alias("free"), F.bool_and(is_("grade", "high")).alias("sure"), F.count_distinct("source").alias("sources"))
    status = F.when(F.col("taken"), "taken").when(F.col("invalid"), "invalid").when(~F.col("free"), "unknown").when(F.col("sources") < 2, "partial").when(F.col("sure"), "confirmed").otherwise("likely")
    return g.select("name", status.alias("status"))


@query("""SELECT row_id, listedAt, askTon FROM listing_observations ORDER BY listedAt NULLS LAST, CASE status WHEN 'sold' THEN 0 WHEN 'active' THEN 2 ELSE 1 END, askTon DESC NULLS LAST, row_id LIMIT 100""")
def canonical_order(spark, sf):
    rank = F.when(F.col("status") == "sold", 0).when(F.col("status") == "active", 2).otherwise(1)
    return table(spark, sf, "listing_observations").orderBy(F.asc_nulls_last("listedAt"), rank, F.desc_nulls_last("askTon"), "row_id").limit(100).select("row_id", "listedAt", "askTon")


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.key'), json_extract_string(props, '$.k')) AS k FROM events""")
def json_probes(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.key"), F.get_json_object("props", "$.k")).alias("k"))


# ---- sold history, collected pages, bins and splits

@query()
def sold_history(spark, sf):
    feeds = F.broadcast(table(spark, sf, "source_feeds").select("source", "clock_zone", "day_order"))
    sold = with_instant(table(spark, sf, "sold_records").join(feeds, "source", "left"), "saleAt", "event_ms", "clock_zone", "day_order")
    sold = sold.withColumn("observed_ms", F.unix_millis(F.col("scrapedAt").cast("timestamp")))
    return market.sold_history(checkpointed(market.valid_sales(sold), "valid-sales"))


def _paged(spark: SparkSession, sf: str) -> DataFrame:
    key = F.coalesce("action_id", F.col("delivery_id").cast("string"))
    return table(spark, sf, "raw_actions").select(F.expr("(delivery_id - 1) div 20").cast("int").alias("page_no"), F.col("delivery_id").alias("place"), key.alias("action_key"), "end_utime")


_PAGED = """p AS (SELECT (delivery_id - 1) // 20 AS page_no, delivery_id AS place, coalesce(action_id, CAST(delivery_id AS VARCHAR)) AS action_key FROM raw_actions), z AS (SELECT page_no, count(*) AS size FROM p GROUP BY 1),
s AS (SELECT least(coalesce(min(page_no) FILTER (size < 20), max(page_no)), max(page_no), 999) AS stop, min(page_no) FILTER (size < 20) AS short FROM z), k AS (SELECT p.* FROM p, s WHERE page_no <= stop)"""


@query(f"WITH {_PAGED} SELECT action_key, count(*) AS copies, CAST(arg_min(page_no, place) AS INT) AS page_no, min(place) AS place FROM k GROUP BY 1")
def pages_collected(spark, sf):
    return actions.collected(_paged(spark, sf), 20)[0]


@query(f"WITH {_PAGED} SELECT CAST(any_value(stop) + 1 AS INT) AS pages, count(*) AS rows, count(DISTINCT action_key) AS actions, count(*) - count(DISTINCT action_key) AS duplicates, any_value(short IS NOT NULL) AS complete, CAST((any_value(stop) + 1) * 20 AS INT) AS next_offset FROM k, s")
def pages_summary(spark, sf):
    return actions.collected(_paged(spark, sf), 20)[1]


@query("""WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders), b AS (SELECT unnest(range(1, 16)) AS b), t AS (SELECT DISTINCT l.v FROM b, r l, r x WHERE l.i = b.b * l.n // 16 AND x.i = l.i + 1 AND l.v < x.v)
SELECT o_orderkey, (SELECT count(*) FROM t WHERE t.v < o_totalprice) AS bin FROM orders""")
def quantile_bins(spark, sf):
    rows = table(spark, sf, "orders")
    thresholds = calibrate.quantile_thresholds(rows, "o_totalprice", 16)
    return rows.select("o_orderkey", calibrate.threshold_bin(F.col("o_totalprice"), thresholds).cast("bigint").alias("bin"))


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, sha256('11:' || o_custkey) AS k FROM orders GROUP BY 1), c AS (SELECT *, (sum(n) OVER (ORDER BY k) - n) / sum(n) OVER () AS before FROM g)
SELECT o_custkey, n, CASE WHEN before < 0.4 - 1e-12 THEN 'blend' WHEN before < 0.4 + 0.3 - 1e-12 THEN 'residual' ELSE 'confidence' END AS cohort FROM c""")
def calibration_split(spark, sf):
    """Families of the calibration rows in three disjoint parts, by a seed of their own."""
    parts = splits.group_cohorts(table(spark, sf, "orders"), "o_custkey", 11, {"blend": 0.4, "residual": 0.3})
    return parts.withColumn("cohort", F.when(F.col("cohort") == "train", "confidence").otherwise(F.col("cohort")))


@query(ORACLE["standardized_rows"].replace(f"SELECT {_KEY}, round((l_quantity", "SELECT round(quantile_cont(distance, 0.5), 4) AS p50, round(quantile_cont(distance, 0.9), 4) AS p90, round(quantile_cont(distance, 0.99), 4) AS p99 FROM (SELECT round((l_quantity") + ")")
def distance_quantiles(spark, sf):
    q = weighted.linear_quantiles(standardized_rows(spark, sf).select(F.lit(1).alias("g"), "distance"), ["g"], "distance", [0.5, 0.9, 0.99])
    return q.select(*(F.round(f"q_{p}", 4).alias(f"p{p}") for p in (50, 90, 99)))


_X = "4294967296"


@query(f"""WITH a AS (SELECT o_orderkey, CAST((9 + CAST(o_orderkey AS HUGEINT) * 1831565813) % {_X} AS BIGINT) AS s FROM orders), b AS (SELECT *, CAST((CAST(xor(s, s >> 15) AS HUGEINT) * (s | 1)) % {_X} AS BIGINT) AS v FROM a),
c AS (SELECT o_orderkey, xor(CAST((v + (CAST(xor(v, v >> 7) AS HUGEINT) * (v | 61)) % {_X}) % {_X} AS BIGINT), v) AS v FROM b) SELECT o_orderkey, round(xor(v, v >> 14) / {_X}.0, 9) AS u FROM c""")
def seeded_numbers(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(N.uniform(9, F.col("o_orderkey")), 9).alias("u"))


@query(f"WITH s AS (SELECT count(*) / sum(l_quantity) AS k FROM lineitem) SELECT {_KEY}, round(l_quantity * k, 6) AS weight FROM lineitem, s")
def weights_rescaled(spark, sf):
    rows = table(spark, sf, "lineitem")
    k = rows.agg(F.try_divide(F.count("*"), F.sum("l_quantity"))).first()[0]
    return rows.select(*_KEYS, r6(F.col("l_quantity") * F.lit(k)).alias("weight"))


@query()
def stacked_predictions(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(*_KEYS, F.col("l_quantity").cast("double").alias("q"), F.col("p_retailprice").alias("p"), F.col("p_size").cast("double").alias("z"), F.ln("l_extendedprice").alias("y"))
    rows = checkpointed(rows, "members")
    one, two = models.ridge(rows, ["q", "p"], "y", 1.0), models.ridge(rows, ["q", "z"], "y", 1.0, huber=1)
    members = rows.withColumns({"a": models.predicted(one, ["q", "p"]), "b": models.predicted(two, ["q", "z"])})
    top = models.ridge(members, ["a", "b"], "y", 1e-3)
    return members.select(*_KEYS, "y", models.predicted(top, ["a", "b"]).alias("prediction"))


# ---- availability from recorded answers

_ANSWERS = f"""a AS (SELECT row_id, {_SHOWN} AS name, CASE eventType WHEN 'listed' THEN true WHEN 'transfer' THEN false END AS result, CASE eventType WHEN 'mint' THEN 'USERNAME_INVALID' WHEN 'sale' THEN '400: USERNAME_OCCUPIED' WHEN 'bid' THEN 'FLOOD_WAIT_7' WHEN 'expired' THEN 'reset' END AS error FROM market_events),
s AS (SELECT *, CASE WHEN contains(error, 'INVALID') THEN 'invalid' WHEN contains(error, 'OCCUPIED') THEN 'no' WHEN error IS NOT NULL OR result IS NULL THEN 'unknown' WHEN result THEN 'yes' ELSE 'no' END AS available FROM a)"""


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("eventType")
    rows = table(spark, sf, "market_events").select("row_id", shown_name(F.col("username")).alias("name"), F.when(e == "listed", True).when(e == "transfer", False).alias("result"), F.when(e == "mint", "USERNAME_INVALID").when(e == "sale", "400: USERNAME_OCCUPIED").when(e == "bid", "FLOOD_WAIT_7").when(e == "expired", "reset").alias("error"))
    return rows.select("row_id", "name", statuses.answer_status(F.col("result"), F.col("error")).alias("s"), statuses.wait_seconds(F.col("error")).alias("wait")).select("row_id", "name", "s.available", "wait")


@query(f"WITH {_ANSWERS} SELECT row_id, name, available, CASE WHEN contains(error, 'FLOOD') THEN 7 ELSE 0 END AS wait FROM s")
def answers_read(spark, sf):
    return _answers(spark, sf).fillna(0, ["wait"])


@query(f"WITH {_ANSWERS}, o AS (SELECT DISTINCT name FROM s WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM s WHERE available IN ('no', 'invalid') AND name IS NOT NULL)) SELECT name FROM o")
def names_still_open(spark, sf):
    answers = _answers(spark, sf)
    return statuses.still_open(answers.select("name").distinct(), answers)


@query()
def listing_pages_judged(spark, sf):
    """A search page for each sold record: one row of its name with its price, judged as a marketplace page."""
    name = shown_name(F.col("username"))
    row = F.concat(F.lit("<body><a class='tm-row-selectable'><div class='table-cell-value-row'><span class='tm-value'>@"), name, F.lit("</span></div><span class='table-cell-status-thin'>"), F.when(F.col("priceTon") > 50, "Sold").otherwise("Unavailable"), F.lit("</span> Not for sale</a></body>"))
    rows = table(spark, sf, "sold_records").select("row_id", name.alias("name"), row.alias("html"))
    return rows.select("row_id", "name", statuses.listing_status(F.col("html"), F.col("name")).alias("s")).select("row_id", "name", "s.*")
