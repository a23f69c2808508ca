"""Rows to shards."""

from pyspark.sql import functions as F

from ..operators import partitioning
from ..sources import tables
from .registry import Tables, query

RING = "ring AS (SELECT md5('shard-' || s || '-vn-' || v) AS p, CAST(s AS INTEGER) AS shard FROM range({}) a(s), range(150) b(v))"
PLACED = """SELECT c_custkey, coalesce((SELECT arg_min(shard, p) FROM {0} WHERE p >= md5(CAST(c_custkey AS VARCHAR))), (SELECT arg_min(shard, p) FROM {0})) AS shard FROM customer"""


@query("SELECT o_orderkey, CAST(('0x' || right(md5(CAST(o_orderkey AS VARCHAR)), 4)) AS INTEGER) % 4 AS shard FROM orders")
def hash_shard(t: Tables):
    return t.orders.select("o_orderkey", partitioning.hash_shard(F.col("o_orderkey"), 4).alias("shard"))


WORD = "CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), {}, 8)) AS BIGINT)"


@query(f"SELECT c_custkey, CAST((({WORD.format(1)} % 5 * (4294967296 % 5) + {WORD.format(9)}) % 5 * (4294967296 % 5) % 5 * (4294967296 % 5) + {WORD.format(17)} % 5 * (4294967296 % 5) + {WORD.format(25)}) % 5 AS INTEGER) AS shard FROM customer")
def hash_shard_any(t: Tables):
    return t.customer.select("c_custkey", partitioning.any_hash_shard(F.col("c_custkey"), 5).alias("shard"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 300 THEN 0 WHEN o_orderkey < 700 THEN 1 WHEN o_orderkey < 1100 THEN 2 ELSE 3 END AS shard FROM orders")
def range_shard(t: Tables):
    return t.orders.select("o_orderkey", partitioning.range_shard(F.col("o_orderkey"), [300, 700, 1100]).alias("shard"))


@query("SELECT r_name, CASE WHEN r_name IN ('ASIA', 'MIDDLE EAST') THEN 'east' WHEN r_name = 'AMERICA' THEN 'west' ELSE 'rest' END AS shard FROM region")
def list_shard(t: Tables):
    return t.region.select("r_name", partitioning.list_shard(F.col("r_name"), {"east": ["ASIA", "MIDDLE EAST"], "west": ["AMERICA"]}, "rest").alias("shard"))


@query(f"WITH {RING.format(4)} {PLACED.format('ring')}")
def hash_ring(t: Tables):
    return partitioning.ring_shard(t.spark, t.customer.select("c_custkey"), "c_custkey", 4)


@query(f"""WITH {RING.format(4)}, {RING.format(5).replace('ring AS', 'wider AS')}, a AS ({PLACED.format('ring')}), b AS ({PLACED.format('wider')})
SELECT round(avg(CASE WHEN a.shard <> b.shard THEN 1.0 ELSE 0.0 END), 6) AS moved_on_ring, count(CASE WHEN a.shard <> b.shard AND b.shard <> 4 THEN 1 END) AS moved_elsewhere FROM a JOIN b USING (c_custkey)""")
def ring_rebalance(t: Tables):
    keys = t.customer.select("c_custkey")
    both = partitioning.ring_shard(t.spark, partitioning.ring_shard(t.spark, keys, "c_custkey", 4, "old"), "c_custkey", 5, "new")
    moved = F.col("old") != F.col("new")
    return both.agg(F.round(F.avg(moved.cast("double")), 6).alias("moved_on_ring"), F.count(F.when(moved & (F.col("new") != 4), 1)).alias("moved_elsewhere"))


FIFTH = f"(({WORD.format(1)} % 5 * (4294967296 % 5) + {WORD.format(9)}) % 5 * (4294967296 % 5) % 5 * (4294967296 % 5) + {WORD.format(17)} % 5 * (4294967296 % 5) + {WORD.format(25)}) % 5"


@query(f"SELECT round(avg(CASE WHEN {WORD.format(25)} % 4 <> {FIFTH} THEN 1.0 ELSE 0.0 END), 6) AS moved FROM customer")
def naive_rebalance(t: Tables):
    # from four shards to five; the ring moves a fifth
    key = F.col("c_custkey")
    moved = partitioning.any_hash_shard(key, 4) != partitioning.any_hash_shard(key, 5)
    return t.customer.agg(F.round(F.avg(moved.cast("double")), 6).alias("moved"))


def _stored(t: Tables):
    """Events in a folder for each shard."""
    path = tables.scratch(t.spark, "shards")
    tables.dump(t.events.select("event_id", "user_id", "value", partitioning.hash_shard(F.col("user_id"), 4).alias("shard")), path, by=["shard"])
    return t.spark.read.schema("event_id bigint, user_id bigint, value double, shard int").parquet(path)


@query("SELECT event_id, user_id FROM events WHERE CAST(('0x' || right(md5(CAST(user_id AS VARCHAR)), 4)) AS INTEGER) % 4 = CAST(('0x' || right(md5('17'), 4)) AS INTEGER) % 4 AND user_id = 17")
def routed_lookup(t: Tables):
    # the key's shard is known before the query runs, so the other folders are not read
    return _stored(t).filter((F.col("shard") == partitioning.hash_shard(F.lit(17), 4)) & (F.col("user_id") == 17)).select("event_id", "user_id")


@query("SELECT event_id, value FROM events WHERE value > 95")
def fan_out(t: Tables):
    return _stored(t).filter("value > 95").select("event_id", "value")
