"""What the operators share: input tables, the shared folder and staged tables."""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_FOLDER = "file:///tmp/checkpoints"

#: The paths of staged tables, by the tables that are read from them.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_owned: set[str] = set()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for a session, so that their Python finds it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    if package.suffix == "" and package.is_dir():
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as held:
            for path in sorted(package.rglob("*.py")):
                held.write(path, path.relative_to(package.parent))
        context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table `name`, whole."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as the session's spark.checkpoint.dir names it. Without it a
    local session uses LOCAL_FOLDER; one on a cluster is refused, as no folder of a machine is shared."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = spark._jvm.org.apache.hadoop.fs.Path(named or LOCAL_FOLDER)
    # with its scheme, so that Spark and Arrow take it for the same place
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets. What a session has put there goes when its driver ends."""
    own = f"{shared_folder(spark)}/granary/{spark.sparkContext.applicationId}"
    if own not in _owned:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _owned.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, small: bool = False, **options: str) -> DataFrame:
    """`df` as a written table in the shared folder: computed once, and still there when executors are lost.

    `options` are those of the writer. `small`: the rows are little beside what they were made of; they are dealt anew, so that many tasks leave few files.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.hint("rebalance") if small else df).write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read any more, results and repeated tasks included."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to `names` that `df` does not use, so that an operator's own columns never clash."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
