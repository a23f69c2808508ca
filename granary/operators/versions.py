"""Row versions, row changes and log replay as DataFrame transformations; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def committed(transactions: DataFrame) -> DataFrame:
    """The snapshot: ids of committed transactions (txn, status)."""
    return transactions.filter(F.col("status") == "C").select("txn")


def visible(versions: DataFrame, snapshot: DataFrame, reader: int) -> DataFrame:
    """Versions (xmin, xmax; xmax 0 is live) that a reader sees.

    Its own rows unless it deleted them or a committed transaction did; others' rows if their maker is committed and
    neither a committed transaction nor the reader deleted them.
    """
    seen = snapshot.select("txn").distinct()
    made = seen.withColumnsRenamed({"txn": "xmin"}).withColumn("_made", F.lit(True))
    gone = seen.withColumnsRenamed({"txn": "xmax"}).withColumn("_gone", F.lit(True))
    held = versions.join(made, "xmin", "left").join(gone, "xmax", "left")
    deleted = (F.col("xmax") == reader) | F.coalesce("_gone", F.lit(False))
    mine = (F.col("xmin") == reader) | F.coalesce("_made", F.lit(False))
    return held.filter(mine & ((F.col("xmax") == 0) | ~deleted)).select(*versions.columns)


def deleted(versions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Versions that a committed transaction deleted; vacuum may drop them."""
    return versions.filter(F.col("xmax") != 0).join(snapshot.select(F.col("txn").alias("xmax")).distinct(), "xmax", "left_semi")


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """`table` with those rows whose key it lacks."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti").select(*table.columns))


def delete(table: DataFrame, where: Column) -> DataFrame:
    """`table` without rows for which the condition holds; where it is null the row stays."""
    return table.filter(~F.coalesce(where, F.lit(False)))


def update(table: DataFrame, where: Column, new: dict[str, Column]) -> DataFrame:
    """`table` with new values, computed from the old row, where the condition holds."""
    hit = F.coalesce(where, F.lit(False))
    return table.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """`table` with the given rows in place of those of the same key, and the others added."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows.select(*table.columns))


def vacuum(versions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Versions that some reader of the snapshot or a later one may still see."""
    dead = snapshot.select(F.col("txn").alias("xmax")).distinct()
    return versions.join(dead, "xmax", "left_anti").select(*versions.columns)


def redo(log: DataFrame, place: list[str]) -> DataFrame:
    """The last value that a committed transaction wrote to each place.

    `log` has lsn, txn, kind (update or commit), value and the columns of `place`; what is not committed is left out,
    and nothing is undone. The latest write is an aggregate, so no log is ever sorted as a whole.
    """
    done = log.filter(F.col("kind") == "commit").select("txn").distinct()
    writes = log.filter(F.col("kind") == "update").join(done, "txn", "left_semi")
    return writes.groupBy(*place).agg(F.max_by("value", "lsn").alias("value"), F.max("lsn").alias("lsn"))


def transfer(accounts: DataFrame, key: str, balance: str, payer: int, payee: int, amount: float) -> DataFrame:
    """Accounts after an atomic transfer; unchanged if the payer has too little or either is missing."""
    facts = accounts.filter(F.col(key).isin(payer, payee)).agg(F.max(F.when(F.col(key) == payer, F.col(balance))).alias("_has"), F.count_distinct(key).alias("_n"))
    allowed = (F.col("_n") == 2) & (F.col("_has") >= amount)
    change = F.when(F.col(key) == payer, -amount).when(F.col(key) == payee, amount).otherwise(0)
    moved = F.when(allowed, F.col(balance) + change).otherwise(F.col(balance))
    return accounts.crossJoin(F.broadcast(facts)).withColumn(balance, moved).drop("_has", "_n")
