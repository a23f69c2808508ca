"""Two-pass external shuffle into shards, with DataFrame functions only.

The first pass scatters records uniformly into buckets that fit in memory, by a seeded hash of the record's number in
the input. The second pass shuffles each bucket by itself: Spark's `shuffle` draws a Fisher-Yates permutation of the
bucket's array, and is written. Buckets one after the other are a random order of all records, and shards are equal runs
of it: buckets are counted as they were written, so every record is numbered once and gets one place.

Law `rows`: shard sizes differ by one record at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, staged

#: Bytes that a bucket holds, about.
BUCKET_BYTES = 32 << 20
#: Buckets whose sizes are summed in one task.
RUN = 4096
#: More buckets than needed for memory keep many machines at work on small inputs.
LEAST_BUCKETS = 1024


def shard(docs: DataFrame, shards: int, seed: int = 17, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of `docs` with `shard` (0 to shards - 1) and `slot` (gapless from 0 within the shard).

    `docs` must be a table on disk (or read back from one): a record's number is its place in the files, so a lost
    task that runs again scatters its records as before. Records are never told apart by their values, so copies,
    repeated rows and null keys spread like all others. A null text takes no room. No rows give no rows; with fewer
    rows than shards some shards are empty. A column that is named like a result is replaced, and columns that the
    operator needs for itself get other names if taken.
    """
    docs = docs.drop("shard", "slot")
    number, bucket, records, at, record, run, first, rows = fresh(docs, "number", "bucket", "records", "at", "record", "run", "first", "rows")
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 16)).first()[0]
    buckets = max(LEAST_BUCKETS, -(-(size or 0) // bucket_bytes))
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    scattered = numbered.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), number), F.lit(buckets)))
    # records arrive in the same order whenever a task runs, so the drawn permutation is the same as well
    ordered = scattered.repartition(F.col(bucket)).sortWithinPartitions(bucket, number)
    whole = ordered.groupBy(bucket).agg(F.collect_list(F.struct(*docs.columns)).alias(records))
    drawn = staged(whole.select(bucket, F.posexplode(F.shuffle(records, F.lit(seed))).alias(at, record)), "shuffled")
    counted = drawn.groupBy(bucket).agg(F.count(F.lit(1)).alias(rows)).withColumn(run, F.floor(F.col(bucket) / RUN))
    # where each bucket begins in the random order: sums within runs of buckets, and over a row for each run
    before = lambda w: F.coalesce(F.sum(rows).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counted.groupBy(run).agg(F.sum(rows).alias(rows)).select(run, before(Window.orderBy(run)).alias("_first"))
    begins = counted.withColumn(first, before(Window.partitionBy(run).orderBy(bucket))).join(runs, run)
    # a row for each bucket, written so that Spark knows its size and moves the records only if it is large
    begins = staged(begins.select(bucket, (F.col(first) + F.col("_first")).alias(first)), "begins", small=True)
    held = drawn.count()
    placed = drawn.join(begins, bucket)
    total = f"(`{first}` + `{at}`)"
    # shard s holds positions ceil(s * n / shards) to ceil((s + 1) * n / shards) - 1
    number_of = F.expr(f"{total} * {shards} div {max(held, 1)}L")
    start = F.expr(f"(shard * {held}L + {shards - 1}) div {shards}")
    return placed.withColumn("shard", number_of.cast("int")).select(f"{record}.*", "shard", (F.expr(total) - start).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """Writes `shard` to one folder per shard, in the order of the slots."""
    shard(docs, shards, **options).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
