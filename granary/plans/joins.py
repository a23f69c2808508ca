"""Joins and subqueries."""

from pyspark.sql import functions as F

from ..functions.scalar import exact_sum
from ..operators import relational
from ..sources import tables
from .registry import Tables, query


@query("SELECT c_custkey, c_name, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice, o_orderstatus FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey = 100 ORDER BY o_orderdate DESC, o_orderkey")
def tpch_q2(t: Tables):
    held = t.customer.filter("c_custkey = 100").join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
    return held.orderBy(F.desc("o_orderdate"), "o_orderkey").select("c_custkey", "c_name", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_orderdate < DATE '1996-03-15' ORDER BY o_orderdate, o_orderkey")
def tpch_q3(t: Tables):
    old = t.orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.expr("DATE '1996-03-15'")))
    return old.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_totalprice", "c_name")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, c_name, r_name, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS item_count
FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND r_name = 'ASIA' ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def tpch_q4(t: Tables):
    places = t.nation.join(t.region.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    year = t.orders.filter(F.col("o_orderdate").between(F.expr("DATE '1996-01-01'"), F.expr("DATE '1996-12-31'")))
    held = year.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    first = relational.top(held.select("o_orderkey", "o_orderdate", "c_name", "r_name"), [F.asc("o_orderdate"), F.asc("o_orderkey")], 100)
    # a hundred orders: their items alone are counted
    items = t.lineitem.join(F.broadcast(first.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")
    held = relational.count_children(first, items, "o_orderkey", "l_orderkey", "item_count").orderBy("o_orderdate", "o_orderkey")
    return held.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "c_name", "r_name", "item_count")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS order_count, CAST(sum(CAST(o_totalprice AS DECIMAL(24,4))) AS DOUBLE) AS total_amount FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_name LIKE 'Customer#00000001%' GROUP BY ALL ORDER BY total_amount DESC, c_custkey")
def tpch_q5(t: Tables):
    held = t.customer.filter(F.col("c_name").like("Customer#00000001%")).join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
    return held.groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("order_count"), exact_sum(F.col("o_totalprice")).alias("total_amount")).orderBy(F.desc("total_amount"), "c_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def left_join_count(t: Tables):
    done = t.orders.filter("o_orderstatus = 'F'")
    return relational.count_children(t.customer.select("c_custkey"), done, "c_custkey", "o_custkey", "n")


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY o_custkey) ON c_custkey = o_custkey")
def join_counted(t: Tables):
    counted = t.orders.filter("o_orderpriority = '5-LOW'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.customer.select("c_custkey").join(counted, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def nested_children(t: Tables):
    held = relational.nested(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey", "o_orderkey", "orders")
    return held.select("c_custkey", F.array_join(F.transform("orders", lambda x: x.cast("string")), ",").alias("orders"))


@query("SELECT count(*) AS n FROM nation JOIN region ON n_nationkey < r_regionkey")
def theta_join_count(t: Tables):
    return t.nation.join(t.region, F.col("n_nationkey") < F.col("r_regionkey")).agg(F.count(F.lit(1)).alias("n"))


THREE = "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'"


@query(THREE)
def three_way_join(t: Tables):
    some = t.customer.filter("c_mktsegment = 'BUILDING'")
    held = t.orders.filter("o_orderstatus = 'F'").join(some, F.col("o_custkey") == F.col("c_custkey"))
    return t.lineitem.join(held, F.col("l_orderkey") == F.col("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))


HINTED = "SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey"


def _hinted(t: Tables, hint: str):
    return t.orders.join(t.customer.hint(hint), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query(HINTED)
def smj_forced(t: Tables):
    return _hinted(t, "merge")


@query(HINTED)
def shuffle_hash_forced(t: Tables):
    return _hinted(t, "shuffle_hash")


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def broadcast_forced(t: Tables):
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey")
def small_drives_big(t: Tables):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def big_big_join(t: Tables):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("orders"))


@query("SELECT event_type, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY event_type")
def salted_join(t: Tables):
    small = t.customer.select(F.col("c_custkey").alias("user_id"))
    return relational.salted_join(t.events.select("user_id", "event_type", "event_id"), small, "user_id", 8).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


BUILDING = "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"


@query(BUILDING)
def semi_join(t: Tables):
    some = t.customer.filter("c_mktsegment = 'BUILDING'")
    return t.orders.join(some, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query(BUILDING)
def semi_exists(t: Tables):
    return t.spark.sql("SELECT o_orderkey FROM {o} o WHERE EXISTS (SELECT 1 FROM {c} c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING')", o=t.orders, c=t.customer)


@query(BUILDING)
def semi_join_distinct(t: Tables):
    some = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")).distinct()
    return t.orders.join(some, "o_custkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(t: Tables):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier)")
def not_in_nulls(t: Tables):
    keys = t.supplier.select(F.nullif(F.col("s_nationkey"), F.lit(3)).alias("k"))
    return relational.not_in(t.nation.select("n_nationkey"), "n_nationkey", keys, "k")


@query("SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE nullif(s_nationkey, 3) = n_nationkey)")
def not_exists_nulls(t: Tables):
    keys = t.supplier.select(F.nullif(F.col("s_nationkey"), F.lit(3)).alias("n_nationkey"))
    return t.nation.select("n_nationkey").join(keys, "n_nationkey", "left_anti")


@query("""SELECT a.event_id AS waiting, b.event_id AS holding, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.event_type <> b.event_type
AND b.ts <= a.ts AND a.ts - b.ts <= INTERVAL 1 HOUR AND b.value > 50""")
def self_join_conflict(t: Tables):
    held = relational.within_an_hour(t.events.filter("value > 50"), t.events, "user_id", "ts").filter("early.event_id <> late.event_id AND early.event_type <> late.event_type")
    return held.select(F.col("late.event_id").alias("waiting"), F.col("early.event_id").alias("holding"), F.col("late.user_id"))


@query("SELECT min(a.p_partkey) AS first, b.p_partkey AS second FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey GROUP BY b.p_partkey")
def self_join_duplicates(t: Tables):
    # each duplicate with the first of its group; all pairs would be the square of the group
    alike = ["p_brand", "p_type", "p_size"]
    first = t.part.groupBy(*alike).agg(F.min("p_partkey").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return t.part.select(*alike, "p_partkey").join(first, alike).filter("first < p_partkey").select("first", F.col("p_partkey").alias("second"))


@query("SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA' AND s_acctbal > 0")
def catalog_join(t: Tables):
    held = t.supplier.filter("s_acctbal > 0").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return held.join(t.region.filter("r_name <> 'AFRICA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_name", "n_name", "r_name")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (3, 17, 42, 99)")
def key_list_lookup(t: Tables):
    keys = t.spark.createDataFrame([(3,), (17,), (42,), (99,)], "user_id long")
    return t.events.select("event_id", "user_id").join(F.broadcast(keys), "user_id", "left_semi").select("event_id", "user_id")


@query("SELECT n_name, count(*) AS n FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE TIMESTAMP '2024-03-01' - ts < INTERVAL 60 DAY GROUP BY n_name")
def reference_table_join(t: Tables):
    recent = t.events.filter(F.expr("TIMESTAMP_NTZ '2024-03-01' - ts < INTERVAL 60 DAYS"))
    held = recent.join(t.customer, F.col("user_id") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return held.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n")


@query("SELECT o_orderkey, n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' WHERE n >= 3")
def derived_table(t: Tables):
    back = t.lineitem.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return back.join(t.orders.filter("o_orderstatus = 'F'"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "n")


@query("""SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lines,
(SELECT max(o_totalprice) FROM orders) AS dearest, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS done, (SELECT min(c_acctbal) FROM customer) AS poorest""")
def scalar_subqueries(t: Tables):
    orders = t.orders.agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("dearest"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("done"))
    customers = t.customer.agg(F.count(F.lit(1)).alias("customers"), F.min("c_acctbal").alias("poorest"))
    lines = t.lineitem.agg(F.count(F.lit(1)).alias("lines"))
    return customers.crossJoin(orders).crossJoin(lines).select("customers", "orders", "lines", "dearest", "done", "poorest")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) * 1.9")
def scalar_in_where(t: Tables):
    return t.spark.sql("SELECT c_custkey FROM {c} WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {c}) * 1.9", c=t.customer)


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders")
def correlated_count(t: Tables):
    back = t.lineitem.filter("l_returnflag = 'R'")
    return relational.count_children(t.orders.select("o_orderkey"), back, "o_orderkey", "l_orderkey", "returned")


@query("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12) SELECT c_name, n FROM big JOIN customer ON o_custkey = c_custkey")
def common_table(t: Tables):
    return t.spark.sql("WITH big AS (SELECT o_custkey, count(*) AS n FROM {o} GROUP BY o_custkey HAVING count(*) > 12) SELECT c_name, n FROM big JOIN {c} ON o_custkey = c_custkey", o=t.orders, c=t.customer)


@query("WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r")
def recursive_table(t: Tables):
    return t.spark.sql("WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r")


@query("SELECT n_name FROM nation WHERE list_contains([1, 3], n_regionkey)")
def any_of_array(t: Tables):
    return t.nation.filter(F.array_contains(F.array(F.lit(1), F.lit(3)), F.col("n_regionkey"))).select("n_name")


@query("SELECT coalesce(c_custkey, -1) AS customer, coalesce(s_suppkey, -1) AS supplier FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal < 5000) ON c_custkey = s_suppkey")
def full_join(t: Tables):
    a, b = t.customer.filter("c_acctbal > 0"), t.supplier.filter("s_acctbal < 5000")
    return a.join(b, F.col("c_custkey") == F.col("s_suppkey"), "full").select(F.coalesce("c_custkey", F.lit(-1)).alias("customer"), F.coalesce("s_suppkey", F.lit(-1)).alias("supplier"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderstatus")
def bucketed_merge_join(t: Tables):
    # both sides are stored by hash of the key and sorted by it, so the join neither shuffles nor sorts
    orders = tables.bucketed(t.orders.select("o_custkey", "o_orderstatus"), "o_custkey", 8)
    held = orders.join(tables.bucketed(t.customer.select("c_custkey"), "c_custkey", 8).hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    return held.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


SIZES = (10, 100, 1000, 5000)


@query(" UNION ALL ".join(f"SELECT {n} AS size, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey AND p_partkey <= {n}" for n in SIZES))
def small_side_sweep(t: Tables):
    # the same join with an ever larger side; Spark broadcasts it as long as its size allows
    each = [t.lineitem.select("l_partkey").join(t.part.select("p_partkey").filter(F.col("p_partkey") <= n), F.col("l_partkey") == F.col("p_partkey")).agg(F.lit(n).alias("size"), F.count(F.lit(1)).alias("n")) for n in SIZES]
    return relational.unite(each)
