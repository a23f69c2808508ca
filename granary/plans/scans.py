"""Scans, projections, predicates, sorts, limits and set operations."""

from pyspark.sql import functions as F

from ..operators import relational
from ..sources import tables
from .registry import Tables, query


@query("SELECT * FROM nation")
def scan_all(t: Tables):
    return t.nation


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 42")
def point_lookup(t: Tables):
    return t.orders.filter(F.col("o_orderkey") == 42).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 10 AND 19 ORDER BY o_orderkey")
def range_scan(t: Tables):
    return t.orders.filter(F.col("o_orderkey").between(10, 19)).select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey")


@query("SELECT * FROM nation WHERE n_regionkey <> 3")
def filter_ne(t: Tables):
    return t.nation.filter(F.col("n_regionkey") != 3)


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def project_filter(t: Tables):
    return t.customer.filter(F.col("c_acctbal") > 9000).select("c_custkey")


@query("SELECT c_mktsegment FROM customer WHERE c_acctbal < 0")
def project_bag(t: Tables):
    return t.customer.filter(F.col("c_acctbal") < 0).select("c_mktsegment")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 100 AND c_acctbal < 5000 AND c_mktsegment = 'BUILDING' AND c_nationkey <= 12")
def conjunction(t: Tables):
    c = F.col
    return t.customer.filter(c("c_acctbal") >= 100).filter(c("c_acctbal") < 5000).filter(c("c_mktsegment") == "BUILDING").filter(c("c_nationkey") <= 12).select("c_custkey", "c_acctbal")


@query("SELECT 1 AS whole, 2.5::DOUBLE AS part, 'text' AS word, CAST(NULL AS VARCHAR) AS nothing FROM region")
def literals(t: Tables):
    return t.region.select(F.lit(1).alias("whole"), F.lit(2.5).alias("part"), F.lit("text").alias("word"), F.lit(None).cast("string").alias("nothing"))


EITHER = "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_custkey = 100 OR o_orderpriority = '1-URGENT'"


def _by_customer(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderpriority").filter(F.col("o_custkey") == 100)


def _urgent(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderpriority").filter(F.col("o_orderpriority") == "1-URGENT")


@query(EITHER)
def filter_or(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderpriority").filter((F.col("o_custkey") == 100) | (F.col("o_orderpriority") == "1-URGENT"))


@query(EITHER)
def or_as_union(t: Tables):
    return _by_customer(t).union(_urgent(t)).distinct()


@query(EITHER)
def or_as_union_all(t: Tables):
    return _by_customer(t).unionByName(_urgent(t).filter(F.col("o_custkey") != 100))


@query("SELECT n_name FROM nation WHERE NOT (n_regionkey = 1 OR n_regionkey = 2)")
def filter_not(t: Tables):
    return t.nation.filter(~((F.col("n_regionkey") == 1) | (F.col("n_regionkey") == 2))).select("n_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 2, 3)")
def in_list(t: Tables):
    return t.orders.filter(F.col("o_custkey").isin(1, 2, 3)).select("o_orderkey", "o_custkey")


@query("SELECT r_name FROM region WHERE r_name NOT IN ('ASIA', 'EUROPE')")
def not_in_list(t: Tables):
    return t.region.filter(~F.col("r_name").isin("ASIA", "EUROPE")).select("r_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#00000001%'")
def like_prefix(t: Tables):
    return t.customer.filter(F.col("c_name").like("Customer#00000001%")).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%0001%'")
def like_contains(t: Tables):
    return t.customer.filter(F.col("c_name").like("%0001%")).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE upper(c_mktsegment) = 'BUILDING'")
def upper_eq(t: Tables):
    return t.customer.filter(F.upper("c_mktsegment") == "BUILDING").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey + 1 = 501")
def expr_filter(t: Tables):
    return t.orders.filter(F.col("o_orderkey") + 1 == 501).select("o_orderkey")


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(large|small)', 'i')")
def regex_ci(t: Tables):
    return t.part.filter(F.col("p_type").rlike("(?i)(large|small)")).select("p_partkey", "p_type")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')")
def boolean_predicate(t: Tables):
    return t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("granted")).filter(~F.col("granted")).select("o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS bucket FROM customer")
def case_when(t: Tables):
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "some").otherwise("rich").alias("bucket"))


@query("SELECT n_nationkey, nullif(n_regionkey, 2) IS NULL AS no_region, nullif(n_regionkey, 2) IS NOT NULL AS has_region FROM nation")
def null_checks(t: Tables):
    region = F.nullif(F.col("n_regionkey"), F.lit(2))
    return t.nation.select("n_nationkey", region.isNull().alias("no_region"), region.isNotNull().alias("has_region"))


@query("SELECT n_nationkey FROM nation WHERE nullif(n_regionkey, 2) <> 1")
def null_comparison(t: Tables):
    return t.nation.filter(F.nullif(F.col("n_regionkey"), F.lit(2)) != 1).select("n_nationkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 100 AND o_totalprice > 1000")
def parameters(t: Tables):
    return t.spark.sql("SELECT o_orderkey FROM {orders} WHERE o_custkey = :customer AND o_totalprice > :least", args={"customer": 100, "least": 1000}, orders=t.orders)


COMPOSITE = {
    "a": "o_custkey = 100",
    "ab": "o_custkey = 100 AND o_orderstatus = 'F'",
    "abc": "o_custkey = 100 AND o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-01-01'",
    "b": "o_orderstatus = 'P'",
    "c": "o_orderdate < TIMESTAMP '1995-03-01'",
    "ac": "o_custkey = 100 AND o_orderdate < TIMESTAMP '1998-01-01'",
    "bc": "o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-03-01'",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS columns, count(*) AS n FROM orders WHERE {v}" for k, v in COMPOSITE.items()))
def composite_prefixes(t: Tables):
    counts = [F.count(F.when(F.expr(v.replace("TIMESTAMP", "TIMESTAMP_NTZ")), 1)).alias(k) for k, v in COMPOSITE.items()]
    return t.orders.agg(*counts).unpivot([], list(COMPOSITE), "columns", "n")


@query("SELECT event_id FROM events WHERE TIMESTAMP '2024-01-02 00:00:00' - ts > INTERVAL 10 MINUTE")
def older_than(t: Tables):
    return t.events.filter(F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00' - ts > INTERVAL 10 MINUTES")).select("event_id")


@query("SELECT c.c_custkey AS id, c.c_name AS name FROM customer AS c WHERE c.c_nationkey = 7")
def aliases(t: Tables):
    c = t.customer.alias("c")
    return c.filter(F.col("c.c_nationkey") == 7).select(F.col("c.c_custkey").alias("id"), F.col("c.c_name").alias("name"))


@query("SELECT i AS n, 'row_' || i AS label FROM generate_series(1, 1000) s(i)")
def generated_rows(t: Tables):
    return tables.series(t.spark, 1, 1000).select("n", F.concat(F.lit("row_"), F.col("n").cast("string")).alias("label"))


USERS = [(1, 25, 85), (2, 30, 90), (3, 35, 75), (4, 28, 95), (5, 40, 60)]


@query(f"SELECT id, score FROM (VALUES {', '.join(map(str, USERS))}) u(id, age, score) WHERE age > 28")
def in_memory_relation(t: Tables):
    users = tables.relation(t.spark, "users", tables.schema({"id": "int", "age": "int", "score": "int"}, "id"), USERS)
    return users.filter(F.col("age") > 28).select("id", "score")


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")
def json_sink(t: Tables):
    return tables.as_json(t.region.select("r_regionkey", "r_name"))


@query("SELECT event_type, event_id, user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def partition_pruning(t: Tables):
    path = tables.scratch(t.spark, "by-type")
    tables.dump(t.events.select("event_type", "event_id", "user_id"), path, by=["event_type"])
    kept = t.spark.read.schema("event_id bigint, user_id bigint, event_type string").parquet(path)
    first = t.events.agg(F.min("event_type")).first()[0]
    return kept.filter(F.col("event_type") == first).select("event_type", "event_id", "user_id")


@query("SELECT l_orderkey, l_linenumber, l_shipdate < TIMESTAMP '1996-01-01' AS early FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1")
def column_pruning(t: Tables):
    return t.lineitem.filter((F.col("l_quantity") == 50) & (F.col("l_discount") == 0.1)).select("l_orderkey", "l_linenumber", (F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ '1996-01-01'")).alias("early"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_orders(t: Tables):
    return relational.top(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 20")
def keyset_page(t: Tables):
    return relational.page_after(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 20)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 1000")
def offset_page(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(1000).limit(20)


@query("SELECT n_nationkey, nullif(n_regionkey, 2) AS region FROM nation ORDER BY region DESC NULLS LAST, n_nationkey LIMIT 22")
def order_nulls_last(t: Tables):
    return t.nation.select("n_nationkey", F.nullif(F.col("n_regionkey"), F.lit(2)).alias("region")).orderBy(F.desc_nulls_last("region"), "n_nationkey").limit(22)


@query("SELECT c_custkey, c_acctbal * 2 AS twice FROM customer ORDER BY c_acctbal * 2, c_custkey LIMIT 15")
def order_by_expression(t: Tables):
    return t.customer.select("c_custkey", (F.col("c_acctbal") * 2).alias("twice")).orderBy("twice", "c_custkey").limit(15)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 30 AND 50 ORDER BY c_custkey")
def index_order(t: Tables):
    return t.customer.filter(F.col("c_custkey").between(30, 50)).select("c_custkey", "c_name").orderBy("c_custkey")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_pairs(t: Tables):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem")
def set_except(t: Tables):
    return t.part.select(F.col("p_partkey").alias("k")).subtract(t.lineitem.select("l_partkey"))


@query("SELECT 'customer' AS kind, c_acctbal AS balance FROM customer WHERE c_acctbal < -900 UNION ALL SELECT 'supplier', s_acctbal FROM supplier WHERE s_acctbal < -900")
def concatenation(t: Tables):
    return relational.unite([
        t.customer.filter("c_acctbal < -900").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance")),
        t.supplier.filter("s_acctbal < -900").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance")),
    ])


@query("SELECT t.name, t.columns FROM (VALUES ('nation', 3), ('region', 2)) t(name, columns)")
def table_listing(t: Tables):
    tables.register(t.spark, t.folder, ["region", "nation"])
    return tables.listing(t.spark).filter(F.col("name").isin("region", "nation"))
