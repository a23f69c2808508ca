"""Aggregates, windows, partial aggregation and reports."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import exact_sum, ratio
from ..operators import partitioning, relational
from ..streaming.events import windowed
from .registry import Tables, query

EXACT = "CAST(sum(CAST({} AS DECIMAL(24,{}))) AS DOUBLE)"


@query(f"""SELECT l_returnflag, l_linestatus, {EXACT.format('l_quantity', 4)} AS sum_qty, {EXACT.format('l_extendedprice', 4)} AS sum_base_price,
{EXACT.format('l_extendedprice * (1 - l_discount)', 4)} AS sum_disc_price, {EXACT.format('l_extendedprice * (1 - l_discount) * (1 + l_tax)', 6)} AS sum_charge,
round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
def tpch_q1(t: Tables):
    price, off, tax = F.col("l_extendedprice"), 1 - F.col("l_discount"), 1 + F.col("l_tax")
    held = t.lineitem.filter(F.col("l_shipdate") <= F.expr("DATE '1998-09-02'"))
    return held.groupBy("l_returnflag", "l_linestatus").agg(
        exact_sum(F.col("l_quantity")).alias("sum_qty"),
        exact_sum(price).alias("sum_base_price"),
        exact_sum(price * off).alias("sum_disc_price"),
        exact_sum(price * off * tax, 6).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("count_order"),
    ).orderBy("l_returnflag", "l_linestatus")


@query("SELECT count(*) AS n, count(nullif(o_orderstatus, 'F')) AS open, max(o_totalprice) AS dearest, min(o_totalprice) AS cheapest FROM orders")
def global_counts(t: Tables):
    return t.orders.agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif(F.col("o_orderstatus"), F.lit("F"))).alias("open"), F.max("o_totalprice").alias("dearest"), F.min("o_totalprice").alias("cheapest"))


@query(f"SELECT o_orderstatus, count(*) AS n, {EXACT.format('o_totalprice', 4)} AS total FROM orders GROUP BY o_orderstatus")
def group_one_key(t: Tables):
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col("o_totalprice")).alias("total"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def group_two_keys(t: Tables):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 5")
def group_count_topk(t: Tables):
    return relational.top(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc("o_custkey")], 5)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
def having(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 10")


@query(f"SELECT coalesce({EXACT.format('o_totalprice', 4)}, 0) AS total FROM orders WHERE o_orderkey < 0")
def null_safe_sum(t: Tables):
    return t.orders.filter("o_orderkey < 0").agg(F.coalesce(exact_sum(F.col("o_totalprice")), F.lit(0.0)).alias("total"))


@query("SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states, round(count(DISTINCT o_custkey) / count(*), 6) AS customer_selectivity, round(count(DISTINCT o_orderstatus) / count(*), 6) AS state_selectivity FROM orders")
def selectivity(t: Tables):
    customers, states, n = F.count_distinct("o_custkey"), F.count_distinct("o_orderstatus"), F.count(F.lit(1))
    return t.orders.agg(customers.alias("customers"), states.alias("states"), F.round(customers / n, 6).alias("customer_selectivity"), F.round(states / n, 6).alias("state_selectivity"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS close FROM lineitem GROUP BY l_returnflag")
def approximate_distinct(t: Tables):
    held = t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"), F.approx_count_distinct("l_partkey", 0.02).alias("approx"))
    return held.select("l_returnflag", "exact", (F.abs(F.col("approx") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"))


@query(f"SELECT event_type, count(*) AS n, {EXACT.format('value', 4)} AS total FROM events GROUP BY event_type")
def shard_partial_final(t: Tables):
    # a partial result per shard, then one over all shards; Spark also aggregates within each task by itself
    placed = t.events.withColumn("shard", partitioning.hash_shard(F.col("user_id"), 4))
    part = placed.groupBy("shard", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(24,4)")).alias("total"))
    return part.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))


@query("""WITH s AS (SELECT CAST(('0x' || right(md5(CAST(user_id AS VARCHAR)), 4)) AS INTEGER) % 4 AS shard, user_id FROM events),
c AS (SELECT shard, count(*) AS n FROM s GROUP BY shard) SELECT round(avg(n), 4) AS mean, round(stddev_pop(n), 4) AS spread, min(n) AS least, max(n) AS most, round(1 - stddev_pop(n) / avg(n), 4) AS balance FROM c""")
def shard_balance(t: Tables):
    counts = t.events.groupBy(partitioning.hash_shard(F.col("user_id"), 4).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    spread, mean = F.stddev_pop("n"), F.avg("n")
    return counts.agg(F.round(mean, 4).alias("mean"), F.round(spread, 4).alias("spread"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(1 - spread / mean, 4).alias("balance"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, round(avg(value), 6) AS moving_average FROM r WHERE n <= 5 GROUP BY user_id""")
def moving_average(t: Tables):
    return relational.moving_average(t.events, "user_id", ["ts", "event_id"], "value", 5).withColumn("moving_average", F.round("moving_average", 6))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS trailing FROM events")
def trailing_mean(t: Tables):
    last = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return t.events.select("event_id", F.round(F.avg("value").over(last), 6).alias("trailing"))


@query("""SELECT o_orderkey, rank() OVER w AS place, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS quarter
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)""")
def window_rank(t: Tables):
    by_price = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    rising = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return t.orders.select("o_orderkey", F.rank().over(by_price).cast("long").alias("place"), F.dense_rank().over(by_price).cast("long").alias("dense"), F.ntile(4).over(rising).cast("long").alias("quarter"))


@query("SELECT o_orderkey, coalesce(lag(o_orderkey) OVER w, -1) AS before, coalesce(lead(o_orderkey) OVER w, -1) AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_lag(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.coalesce(F.lag("o_orderkey").over(w), F.lit(-1)).alias("before"), F.coalesce(F.lead("o_orderkey").over(w), F.lit(-1)).alias("after"))


@query("SELECT n_regionkey, coalesce(c_mktsegment, 'all') AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment) HAVING n_regionkey IS NOT NULL")
def rollup(t: Tables):
    held = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return held.filter("n_regionkey IS NOT NULL").select("n_regionkey", F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "n")


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '\\s+'))) AS word FROM documents)
SELECT word, count(*) AS docs FROM w WHERE word <> '' GROUP BY word ORDER BY docs DESC, word LIMIT 50""")
def word_index(t: Tables):
    words = t.documents.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word")).filter("word <> ''")
    return relational.top(words.groupBy("word").agg(F.count(F.lit(1)).alias("docs")), [F.desc("docs"), F.asc("word")], 50)


@query("SELECT s_nationkey, round(count(*) FILTER (WHERE s_acctbal > 0)::DOUBLE / nullif(count(*) FILTER (WHERE s_acctbal <= 0), 0), 4) AS ratio FROM supplier GROUP BY s_nationkey")
def ratio_metric(t: Tables):
    held = t.supplier.groupBy("s_nationkey").agg(F.count(F.when(F.col("s_acctbal") > 0, 1)).alias("up"), F.count(F.when(F.col("s_acctbal") <= 0, 1)).alias("down"))
    return held.select("s_nationkey", ratio(F.col("up"), F.col("down")).alias("ratio"))


@query("""SELECT o_orderstatus, count(*) AS n, datediff('day', min(o_orderdate), max(o_orderdate)) AS days, round(count(*) / nullif(datediff('day', min(o_orderdate), max(o_orderdate)), 0), 6) AS per_day,
round(count(*) + 30 * count(*) / nullif(datediff('day', min(o_orderdate), max(o_orderdate)), 0), 4) AS in_30_days,
round((2 * count(*) - count(*)) / (count(*) / nullif(datediff('day', min(o_orderdate), max(o_orderdate)), 0)), 4) AS days_to_double, round(greatest((10000 - count(*)) / (count(*) / nullif(datediff('day', min(o_orderdate), max(o_orderdate)), 0)), 0), 4) AS days_to_10000 FROM orders GROUP BY o_orderstatus""")
def capacity_forecast(t: Tables):
    days = F.datediff(F.max("o_orderdate"), F.min("o_orderdate"))
    held = t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), days.cast("long").alias("days"))
    rate = F.col("n") / F.nullif(F.col("days"), F.lit(0))
    return held.select("o_orderstatus", "n", "days", F.round(rate, 6).alias("per_day"), F.round(F.col("n") + 30 * rate, 4).alias("in_30_days"), F.round(F.col("n") / rate, 4).alias("days_to_double"), F.round(F.greatest((10000 - F.col("n")) / rate, F.lit(0.0)), 4).alias("days_to_10000"))


@query("SELECT event_id, event_type, value FROM events WHERE value > 90 ORDER BY value DESC, event_id LIMIT 10")
def slow_report(t: Tables):
    return relational.top(t.events.filter("value > 90").select("event_id", "event_type", "value"), [F.desc("value"), F.asc("event_id")], 10)


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(24,4))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def event_windows(t: Tables):
    return windowed(t.events, "1 hour")


@query("""SELECT CAST(('0x' || right(md5(CAST(user_id AS VARCHAR)), 4)) AS INTEGER) % 4 AS shard, count(*) AS n, min(user_id) AS min_key, max(user_id) AS max_key FROM events GROUP BY shard""")
def shard_report(t: Tables):
    placed = t.events.groupBy(partitioning.hash_shard(F.col("user_id"), 4).alias("shard"))
    return placed.agg(F.count(F.lit(1)).alias("n"), F.min("user_id").alias("min_key"), F.max("user_id").alias("max_key"))


@query("SELECT o_custkey, max(o_orderpriority) AS priority FROM orders GROUP BY o_custkey")
def sort_aggregate(t: Tables):
    # a text has no fixed width, so the groups are made by sorting
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderpriority").alias("priority"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS states FROM orders GROUP BY o_custkey")
def object_aggregate(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), "").alias("states"))


@query("""WITH s AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, min(ts) AS first, max(ts) AS last, count(*) AS steps FROM events GROUP BY ALL)
SELECT user_id, strftime(start, '%Y-%m-%d %H') AS start, CAST(date_diff('second', date_trunc('second', first), date_trunc('second', last)) AS BIGINT) AS seconds, steps FROM s WHERE seconds > 1800 ORDER BY seconds DESC, user_id, start LIMIT 20""")
def long_transactions(t: Tables):
    # a user's events of an hour stand for a transaction
    held = t.events.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("steps"))
    seconds = F.unix_timestamp(F.col("last").cast("timestamp")) - F.unix_timestamp(F.col("first").cast("timestamp"))
    held = held.select("user_id", F.date_format("hour", "yyyy-MM-dd HH").alias("start"), seconds.alias("seconds"), "steps").filter("seconds > 1800")
    return relational.top(held, [F.desc("seconds"), F.asc("user_id"), F.asc("start")], 20)


@query("""SELECT count(*) FILTER (WHERE event_type = 'purchase') AS timed, count(*) FILTER (WHERE event_type = 'error') AS requested,
round(count(*) FILTER (WHERE event_type = 'error')::DOUBLE / nullif(count(*) FILTER (WHERE event_type IN ('purchase', 'error')), 0), 4) AS requested_share FROM events""")
def checkpoint_report(t: Tables):
    # purchases stand for checkpoints by time, errors for those that were asked for
    kinds = {n: F.count(F.when(F.col("event_type") == k, 1)) for n, k in (("timed", "purchase"), ("requested", "error"))}
    held = t.events.agg(*(c.alias(n) for n, c in kinds.items()))
    return held.select("timed", "requested", ratio(F.col("requested"), F.col("timed") + F.col("requested")).alias("requested_share"))
