"""Results that are known beforehand, on small relations."""

import hashlib

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from granary.functions import scalar
from granary.operators import partitioning, relational, versions
from granary.sources import tables

USERS = [(1, 25, 85), (2, 30, 90), (3, 35, 75), (4, 28, 95), (5, 40, 60)]


@pytest.fixture(scope="module")
def users(spark):
    return tables.relation(spark, "users", tables.schema({"id": "int", "age": "int", "score": "int"}, "id"), USERS)


@pytest.fixture(scope="module")
def big(spark):
    return tables.relation(spark, "big", tables.schema({"id": "int", "val": "int"}, "id"), [(i, 10 * i) for i in range(100)])


@pytest.mark.parametrize(
    "where, ids",
    [("id = 3", [3]), ("age < 30", [1, 4]), ("score >= 90", [2, 4]), ("age > 28", [2, 3, 5]), ("id >= 2 AND age < 35", [2, 4]), ("id != 3", [1, 2, 4, 5]), ("id = 999", []), ("id <= 2", [1, 2])],
)
def test_where(spark, users, where, ids):
    assert [r.id for r in spark.sql(f"SELECT id FROM users WHERE {where} ORDER BY id").collect()] == ids


def test_all_rows(users):
    assert [tuple(r) for r in users.orderBy("id").collect()] == USERS


def test_range_and_projection(spark, big):
    assert spark.sql("SELECT * FROM big WHERE id >= 10 AND id < 20").count() == 10
    assert spark.sql("SELECT val FROM big WHERE id >= 90 ORDER BY id").first().val == 900
    assert big.filter(F.col("id").between(30, 50)).count() == 21


def test_errors(spark, users):
    for wrong, kind in (("SELECT nothing FROM users", AnalysisException), ("SELECT * FROM nowhere", AnalysisException), ("SELECT * FROM users WHERE id >", ParseException)):
        with pytest.raises(kind):
            spark.sql(wrong).collect()
    with pytest.raises(ValueError, match="unknown type"):
        tables.schema({"a": "blob"})


def test_no_cap_on_rows(spark):
    assert tables.series(spark, 1, 5000).count() == 5000


@pytest.mark.parametrize(
    "xmin, xmax, snapshot, reader, seen",
    [(5, 0, [], 5, True), (3, 0, [], 5, False), (3, 0, [3], 5, True), (3, 7, [3, 7], 5, False), (3, 7, [3], 5, True), (5, 5, [], 5, False), (3, 5, [3], 5, False)],
)
def test_visibility(spark, xmin, xmax, snapshot, reader, seen):
    held = spark.createDataFrame([(xmin, xmax)], "xmin long, xmax long")
    known = spark.createDataFrame([(t,) for t in snapshot], "txn long")
    assert (versions.visible(held, known, reader).count() == 1) is seen


def test_redo_takes_the_last_committed_write(spark):
    log = [(1, 1, "update", 0, 90), (2, 2, "update", 0, 7), (3, 1, "update", 0, 99), (4, 1, "commit", None, None), (5, 2, "update", 1, 8)]
    df = spark.createDataFrame(log, "lsn long, txn long, kind string, page long, value long")
    assert [tuple(r) for r in versions.redo(df, ["page"]).collect()] == [(0, 99, 3)]


def test_changes(spark):
    table = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "k long, v long")
    assert {r.k for r in versions.delete(table, F.col("v") > 6).collect()} == {1, 2}
    assert {tuple(r) for r in versions.update(table, F.col("v") > 6, {"v": F.col("v") + 1}).collect()} == {(1, 5), (2, None), (3, 10)}
    new = spark.createDataFrame([(3, 0), (4, 1)], table.schema)
    assert {tuple(r) for r in versions.insert_absent(table, new, "k").collect()} == {(1, 5), (2, None), (3, 9), (4, 1)}
    assert {tuple(r) for r in versions.upsert(table, new, "k").collect()} == {(1, 5), (2, None), (3, 0), (4, 1)}


def test_transfer(spark):
    table = spark.createDataFrame([(1, 100.0), (2, 0.0)], "k long, b double")
    assert {tuple(r) for r in versions.transfer(table, "k", "b", 1, 2, 60.0).collect()} == {(1, 40.0), (2, 60.0)}
    assert {tuple(r) for r in versions.transfer(table, "k", "b", 1, 2, 160.0).collect()} == {(1, 100.0), (2, 0.0)}
    assert {tuple(r) for r in versions.transfer(table, "k", "b", 1, 9, 60.0).collect()} == {(1, 100.0), (2, 0.0)}


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "x long")
    some, null, none = (spark.createDataFrame(rows, "k long") for rows in ([(1,)], [(1,), (None,)], []))
    assert [r.x for r in relational.not_in(left, "x", some, "k").collect()] == [2]
    assert relational.not_in(left, "x", null, "k").count() == 0
    assert relational.not_in(left, "x", none, "k").count() == 3


def test_functions(spark):
    row = spark.range(1).select(
        scalar.simple_hash(F.lit("hello")).alias("hash"),
        scalar.is_palindrome(F.lit("")).alias("empty"),
        scalar.is_palindrome(F.lit("abca")).alias("no"),
        scalar.prefix_match(F.lit("abc"), F.lit("ab")).alias("longer"),
        scalar.reverse_text(F.lit(None).cast("string")).alias("null"),
        scalar.int_array_sum(F.array(F.lit(2147483647), F.lit(None).cast("int"), F.lit(1))).alias("sum"),
        scalar.word_count(F.lit("  two  words ")).alias("words"),
        scalar.ratio(F.lit(1), F.lit(0)).alias("ratio"),
    ).first()
    assert tuple(row) == ("0f923099", True, False, 0, None, 2147483648, 2, None)


def test_moving_average_of_last_values(spark):
    rows = [("a", i, float(i)) for i in range(1, 8)] + [("a", 8, None), ("b", 1, 4.0)]
    df = spark.createDataFrame(rows, "g string, t long, v double")
    got = {r.g: r.moving_average for r in relational.moving_average(df, "g", ["t"], "v", 3).collect()}
    assert got == {"a": pytest.approx((6 + 7 + 0) / 3), "b": 4.0}


def test_shards_match_the_whole_digest(spark):
    df = spark.range(500).select("id", partitioning.hash_shard(F.col("id"), 4).alias("four"), partitioning.any_hash_shard(F.col("id"), 7).alias("seven"))
    for r in df.collect():
        whole = int(hashlib.md5(str(r.id).encode()).hexdigest(), 16)
        assert (r.four, r.seven) == (whole % 4, whole % 7)


def test_ring(spark):
    positions = partitioning.ring(3, 5)
    got = {r.id: r.shard for r in partitioning.ring_shard(spark, spark.range(300), "id", 3, points=5).collect()}
    for key, shard in got.items():
        digest = hashlib.md5(str(key).encode()).hexdigest()
        assert shard == next((s for p, s in positions if p >= digest), positions[0][1])
