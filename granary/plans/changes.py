"""Row versions, row changes, redo."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inspect, relational, versions
from ..sources import tables
from .registry import Tables, query

#: Versions made of orders by fixed arithmetic, and a snapshot in which every third transaction is not committed.
VERSIONS = "v AS (SELECT o_orderkey, o_orderkey % 50 + 1 AS xmin, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 43 + 1 ELSE 0 END AS xmax FROM orders)"
COMMITTED = "s AS (SELECT i AS txn FROM range(1, 51) r(i) WHERE i % 3 <> 0)"


def _versions(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.select("o_orderkey", (key % 50 + 1).alias("xmin"), F.when(key % 7 == 0, key % 43 + 1).otherwise(0).alias("xmax"))


def _snapshot(t: Tables) -> DataFrame:
    status = F.when(F.col("id") % 3 == 0, "A").otherwise("C")
    return versions.committed(t.spark.range(1, 51).select(F.col("id").alias("txn"), status.alias("status")))


@query(f"""WITH {VERSIONS}, {COMMITTED} SELECT o_orderkey FROM v WHERE (xmin = 9 OR xmin IN (SELECT txn FROM s)) AND (xmax = 0 OR NOT (xmax = 9 OR xmax IN (SELECT txn FROM s)))""")
def mvcc_visible(t: Tables):
    return versions.visible(_versions(t), _snapshot(t), 9).select("o_orderkey")


@query(f"WITH {VERSIONS}, {COMMITTED} SELECT o_orderkey FROM v WHERE xmax <> 0 AND xmax IN (SELECT txn FROM s)")
def mvcc_deleted(t: Tables):
    return versions.deleted(_versions(t), _snapshot(t)).select("o_orderkey")


@query(f"WITH {VERSIONS}, {COMMITTED} SELECT o_orderkey, xmin, xmax FROM v WHERE xmax NOT IN (SELECT txn FROM s)")
def vacuum(t: Tables):
    return versions.vacuum(_versions(t), _snapshot(t)).select("o_orderkey", "xmin", "xmax")


@query(f"""WITH {VERSIONS}, {COMMITTED}, n AS (SELECT txn FROM s WHERE txn <= 20)
SELECT (SELECT count(*) FROM v WHERE xmin IN (SELECT txn FROM n) AND xmax NOT IN (SELECT txn FROM n)) AS early, (SELECT count(*) FROM v WHERE xmin IN (SELECT txn FROM s) AND xmax NOT IN (SELECT txn FROM s)) AS late""")
def two_snapshots(t: Tables):
    held, snapshot = _versions(t), _snapshot(t)
    count = lambda s, name: versions.visible(held, s, 999).agg(F.count(F.lit(1)).alias(name))
    return count(snapshot.filter("txn <= 20"), "early").crossJoin(count(snapshot, "late"))


@query("SELECT * FROM region UNION ALL SELECT * FROM (VALUES (7, 'ATLANTIS'), (8, 'LEMURIA')) n(k, name)")
def dml_insert(t: Tables):
    new = t.spark.createDataFrame([(0, "AGAIN"), (7, "ATLANTIS"), (8, "LEMURIA")], t.region.schema)
    return versions.insert_absent(t.region, new, "r_regionkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE NOT coalesce(nullif(n_regionkey, 2) = 1, false)")
def dml_delete(t: Tables):
    return versions.delete(t.nation, F.nullif(F.col("n_regionkey"), F.lit(2)) == 1).select("n_nationkey", "n_name")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(t: Tables):
    return versions.update(t.supplier.select("s_suppkey", "s_acctbal"), F.col("s_acctbal") < 0, {"s_acctbal": F.lit(0.0)})


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'NEW WORLD' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'MU'")
def upsert(t: Tables):
    new = t.spark.createDataFrame([(1, "NEW WORLD"), (9, "MU")], t.region.schema)
    return versions.upsert(t.region, new, "r_regionkey")


@query("""WITH log AS (SELECT event_id AS lsn, user_id % 40 AS txn, CASE WHEN event_id % 20 = 0 THEN 'commit' ELSE 'update' END AS kind, event_id % 97 AS page, event_id % 5 AS off, value FROM events),
done AS (SELECT DISTINCT txn FROM log WHERE kind = 'commit') SELECT page, off, arg_max(value, lsn) AS value, max(lsn) AS lsn FROM log WHERE kind = 'update' AND txn IN (SELECT txn FROM done) GROUP BY page, off""")
def redo_log(t: Tables):
    lsn = F.col("event_id")
    log = t.events.select(lsn.alias("lsn"), (F.col("user_id") % 40).alias("txn"), F.when(lsn % 20 == 0, "commit").otherwise("update").alias("kind"), (lsn % 97).alias("page"), (lsn % 5).alias("off"), "value")
    return versions.redo(log, ["page", "off"])


@query("SELECT event_id AS lsn, user_id, event_type FROM events ORDER BY lsn")
def log_scan(t: Tables):
    return t.events.select(F.col("event_id").alias("lsn"), "user_id", "event_type").orderBy("lsn")


@query("SELECT c_custkey, c_acctbal + CASE WHEN ok AND c_custkey = 3 THEN -50.0 WHEN ok AND c_custkey = 4 THEN 50.0 ELSE 0.0 END AS c_acctbal FROM customer, (SELECT max(CASE WHEN c_custkey = 3 THEN c_acctbal END) >= 50 AS ok FROM customer)")
def transfer(t: Tables):
    return versions.transfer(t.customer.select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", 3, 4, 50.0)


@query("SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(24,2))) AS DOUBLE) AS before, CAST(sum(CAST(c_acctbal AS DECIMAL(24,2))) AS DOUBLE) AS after FROM customer")
def transfer_invariant(t: Tables):
    total = lambda df, name: df.agg(F.sum(F.col("c_acctbal").cast("decimal(24,2)")).cast("double").alias(name))
    accounts = t.customer.select("c_custkey", "c_acctbal")
    return total(accounts, "before").crossJoin(total(versions.transfer(accounts, "c_custkey", "c_acctbal", 3, 4, 50.0), "after"))


@query(f"WITH {VERSIONS} SELECT o_orderkey FROM v WHERE xmax = 0")
def heap_scan(t: Tables):
    return _versions(t).filter("xmax = 0").select("o_orderkey")


@query("SELECT r_regionkey AS row_id, CASE WHEN r_regionkey <> 1 THEN r_name END AS r_name FROM region WHERE r_regionkey IN (1, 3)")
def fetch_by_row_id(t: Tables):
    # the key stands for a physical address; the row at 1 is deleted, and its fetch gives null
    wanted = t.spark.createDataFrame([(1,), (3,)], "row_id int")
    live = versions.delete(t.region, F.col("r_regionkey") == 1).select(F.col("r_regionkey").cast("int").alias("row_id"), "r_name")
    return wanted.join(live, "row_id", "left").select("row_id", "r_name")


@query("SELECT event_id AS lsn, event_type FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id + 1000000, event_type FROM events WHERE event_type = 'view'")
def log_append(t: Tables):
    path = tables.scratch(t.spark, "log")
    t.events.filter("event_type <> 'view'").select(F.col("event_id").alias("lsn"), "event_type").write.parquet(path)
    t.events.filter("event_type = 'view'").select((F.col("event_id") + 1000000).alias("lsn"), "event_type").write.mode("append").parquet(path)
    return t.spark.read.schema("lsn bigint, event_type string").parquet(path).orderBy("lsn")


@query("""WITH l AS (SELECT user_id AS resource, event_id AS owner, ts, CASE WHEN event_type = 'purchase' THEN 'X' ELSE 'S' END AS mode FROM events)
SELECT a.owner AS holder, b.owner AS waiter, a.mode AS held, b.mode AS wanted FROM l a JOIN l b ON a.resource = b.resource AND a.ts <= b.ts AND b.ts - a.ts <= INTERVAL 1 HOUR AND a.owner < b.owner AND (a.mode = 'X' OR b.mode = 'X')""")
def lock_conflicts(t: Tables):
    mode = F.when(F.col("event_type") == "purchase", "X").otherwise("S")
    # an event locks its user for an hour; two locks conflict unless both are shared
    locks = t.events.select(F.col("user_id").alias("resource"), F.col("event_id").alias("owner"), "ts", mode.alias("mode"))
    held = relational.within_an_hour(locks, locks, "resource", "ts").filter("early.owner < late.owner AND (early.mode = 'X' OR late.mode = 'X')")
    return held.select(F.col("early.owner").alias("holder"), F.col("late.owner").alias("waiter"), F.col("early.mode").alias("held"), F.col("late.mode").alias("wanted"))


@query(f"""WITH {VERSIONS}, {COMMITTED} SELECT xmin % 5 AS part, count(*) FILTER (WHERE xmax IN (SELECT txn FROM s)) AS dead, count(*) AS n,
round(count(*) FILTER (WHERE xmax IN (SELECT txn FROM s))::DOUBLE / count(*), 4) AS share FROM v GROUP BY part""")
def dead_row_report(t: Tables):
    held, dead = _versions(t), versions.deleted(_versions(t), _snapshot(t))
    part = (F.col("xmin") % 5).alias("part")
    gone = dead.groupBy(part).agg(F.count(F.lit(1)).alias("dead"))
    counted = held.groupBy(part).agg(F.count(F.lit(1)).alias("n")).join(gone, "part", "left").withColumn("dead", F.coalesce("dead", F.lit(0).cast("long")))
    return counted.select("part", "dead", "n", F.round(F.col("dead") / F.col("n"), 4).alias("share"))


@query("""WITH p AS (SELECT user_id % 3 AS replica, max(event_id) AS applied FROM events WHERE event_type <> 'purchase' GROUP BY replica), m AS (SELECT max(event_id) AS written FROM events)
SELECT replica, written - applied AS lag, written - applied > 10 AS late FROM p, m""")
def replication_lag(t: Tables):
    applied = t.events.filter("event_type <> 'purchase'").groupBy((F.col("user_id") % 3).alias("replica")).agg(F.max("event_id").alias("applied"))
    written = t.events.agg(F.max("event_id").alias("written"))
    lag = F.col("written") - F.col("applied")
    return applied.crossJoin(F.broadcast(written)).select("replica", lag.alias("lag"), (lag > 10).alias("late"))


@query("SELECT * FROM nation")
def replica_refresh(t: Tables):
    path = tables.scratch(t.spark, "replica")
    tables.dump(t.nation, path)
    return t.spark.read.schema(t.nation.schema).parquet(path)


@query("SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS segments FROM customer")
def cached_scan(t: Tables):
    # the cache is filled by the first query that runs and serves all later ones; Spark evicts and spills it by itself
    held = t.customer.select("c_custkey", "c_mktsegment").persist(StorageLevel.MEMORY_AND_DISK)
    return held.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_mktsegment").alias("segments"))


@query("SELECT column_name AS column, lower(data_type) AS kind FROM information_schema.columns WHERE table_name = 'region'")
def schema_dump(t: Tables):
    names = {"int": "integer", "string": "varchar"}
    return t.spark.createDataFrame([(c, names.get(k, k)) for c, k in t.region.dtypes], "column string, kind string")


@query("SELECT 'r_regionkey | r_name' AS line UNION ALL SELECT r_regionkey || ' | ' || r_name FROM region UNION ALL SELECT '(' || count(*) || ' rows)' FROM region")
def text_table(t: Tables):
    return tables.as_lines(t.region)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def jdbc_bulk_load(t: Tables):
    # the database that comes with Spark, in the driver's memory, which on a cluster only the driver reads and writes; of a
    # server, whose address would stand in its place, all executors do
    url = tables.embedded_database(t.spark)
    rows = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    tables.bulk_load(rows, url, "nation")
    return tables.jdbc(t.spark, url, "SELECT * FROM nation", "n_nationkey", 0, 25, 4).select(*rows.columns)


@query("SELECT 1 AS id, 'one' AS name UNION ALL SELECT 2, 'two'")
def create_table(t: Tables):
    name = tables.create(t.spark, tables.schema({"id": "int", "name": "text"}, primary_key="id"))
    t.spark.sql(f"INSERT INTO {name} VALUES (1, 'one'), (2, 'two')")
    return t.spark.table(name)


@query("SELECT n * 2 AS dirty, n AS committed FROM (SELECT count(*) AS n FROM region)")
def dirty_read(t: Tables):
    # a second version of every row is written and not committed: who reads it counts each row twice
    held = t.region.select(F.lit(1).alias("xmin"), F.lit(0).alias("xmax")).unionAll(t.region.select(F.lit(2).alias("xmin"), F.lit(0).alias("xmax")))
    snapshot = versions.committed(t.spark.createDataFrame([(1, "C"), (2, "A")], "txn int, status string"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(held, "dirty").crossJoin(count(versions.visible(held, snapshot, 9), "committed"))


@query(f"""WITH v AS (SELECT o_orderkey % 50 + 1 AS xmin, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 43 + 1 ELSE 0 END AS xmax FROM orders WHERE o_totalprice > 100000), {COMMITTED}, n AS (SELECT txn FROM s WHERE txn <= 20)
SELECT early AS first_read, late AS read_committed_again, early AS snapshot_again FROM (SELECT count(*) AS early FROM v WHERE xmin IN (SELECT txn FROM n) AND xmax NOT IN (SELECT txn FROM n)), (SELECT count(*) AS late FROM v WHERE xmin IN (SELECT txn FROM s) AND xmax NOT IN (SELECT txn FROM s))""")
def phantom_read(t: Tables):
    # rows that match the predicate are committed between two reads; a snapshot that is kept does not see them
    dear = t.orders.filter("o_totalprice > 100000").select("o_orderkey")
    held, snapshot = _versions(t).join(dear, "o_orderkey", "left_semi"), _snapshot(t)
    count = lambda s, name: versions.visible(held, s, 999).agg(F.count(F.lit(1)).alias(name))
    kept = snapshot.filter("txn <= 20")
    return count(kept, "first_read").crossJoin(count(snapshot, "read_committed_again")).crossJoin(count(kept, "snapshot_again"))


@query("SELECT c_custkey, c_acctbal + 50.0 AS lost, c_acctbal + 100.0 AS serial FROM customer WHERE c_custkey = 7")
def lost_update(t: Tables):
    # two transactions add 50 each: from the same snapshot the later write replaces the earlier, one after the other both count
    account = t.customer.filter("c_custkey = 7").select("c_custkey", "c_acctbal")
    add = lambda df: versions.update(df, F.lit(True), {"c_acctbal": F.col("c_acctbal") + 50.0})
    snapshot_write = versions.upsert(add(account), add(account), "c_custkey")
    return snapshot_write.withColumnRenamed("c_acctbal", "lost").join(add(add(account)).withColumnRenamed("c_acctbal", "serial"), "c_custkey")


@query("SELECT count(*) - 2 AS by_snapshot, count(*) - 1 AS serial FROM supplier WHERE s_suppkey IN (1, 2)")
def write_skew(t: Tables):
    # two are on call, and each may leave as long as another one stays
    on_call = t.supplier.filter("s_suppkey IN (1, 2)").select(F.col("s_suppkey").alias("who"))

    def leaves(state: DataFrame, seen: DataFrame, who: int) -> DataFrame:
        others = seen.filter(F.col("who") != who).agg(F.count(F.lit(1)).alias("others"))
        return state.crossJoin(F.broadcast(others)).filter(~((F.col("who") == who) & (F.col("others") > 0))).select("who")

    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    both_saw_two = leaves(leaves(on_call, on_call, 1), on_call, 2)
    first = leaves(on_call, on_call, 1)
    return count(both_saw_two, "by_snapshot").crossJoin(count(leaves(first, first, 2), "serial"))


def _few(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'F'").select("o_custkey").distinct()


def _shown(t: Tables, found: list[tuple[int, str]]) -> DataFrame:
    return t.spark.createDataFrame([(i, depth, node) for i, (depth, node) in enumerate(found)], "line int, depth int, node string")


def _tree(*nodes: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS line, {len(n) - len(n.lstrip())} AS depth, '{n.strip()}' AS node" for i, n in enumerate(nodes))


@query(_tree("Aggregate", " Project", "  Filter", "   LogicalRelation"))
def logical_plan(t: Tables):
    return _shown(t, inspect.tree(_few(t), "optimized"))


@query(_tree("Project", " Filter", "  UnresolvedRelation"))
def syntax_tree(t: Tables):
    return _shown(t, inspect.parsed(t.spark, "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'"))


@query("SELECT true AS compiled, true AS scan_filters, true AS costs")
def explain_plan(t: Tables):
    # whether stages are compiled to code, the filter reaches the scan, and sizes are estimated
    found = "GeneratedIteratorForCodegenStage" in inspect.plan_text(t.orders.filter("o_orderstatus = 'F'"), "codegen"), "EqualTo(o_orderstatus,F)" in inspect.plan_text(_few(t)), "sizeInBytes" in inspect.plan_text(_few(t), "cost")
    return t.spark.createDataFrame([found], "compiled boolean, scan_filters boolean, costs boolean")


@query("SELECT 'r_name' AS column, CAST(NULL AS BIGINT) AS distinct_before, count(DISTINCT r_name) AS distinct_after FROM region UNION ALL SELECT 'r_regionkey', NULL, count(DISTINCT r_regionkey) FROM region")
def analyze_table(t: Tables):
    name = tables.create(t.spark, t.region.schema)
    t.region.write.insertInto(name)
    before = inspect.statistics(t.spark, name)
    after = inspect.analyze(t.spark, name)
    number = lambda df, to: df.filter("name = 'distinct_count'").select("column", F.expr("try_cast(value AS BIGINT)").alias(to))
    return number(before, "distinct_before").join(number(after, "distinct_after"), "column")
