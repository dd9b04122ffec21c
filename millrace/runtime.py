"""What every operator needs of the session: tables, the shared scratch folder, code on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_LOCAL_SCRATCH: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Arrow functions import there.

    Local Python workers need it too: they do not know what the driver has put on its path.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="millrace-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{here.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share. On one machine a temporary one will do."""
    ship(spark)
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_SCRATCH:
            _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="millrace-scratch-")
            atexit.register(shutil.rmtree, _LOCAL_SCRATCH[app], ignore_errors=True)
        path = "file://" + _LOCAL_SCRATCH[app]
    return path.rstrip("/")


def settle(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage: write to the shared scratch folder and read back. Survives the loss of any executor.

    The files are removed, on whatever file system, when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/millrace-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: A key counts as hot if it holds at least this share of all rows; so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.002


def skew_safe_lookup(rows: DataFrame, lookup: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of rows with a lookup that has one row per key and, in `weight`, how many rows hold that key.

    Keys with a share of HOT_SHARE or more are joined by broadcast: the sum of weights bounds their number by
    1 / HOT_SHARE, whatever the size. All others go through one shuffle, in which none can be large.
    `rows` is read twice, so settle it first. Null keys match nothing.
    """
    bound = max(2, int(total * HOT_SHARE))
    hot = lookup.filter(F.col(weight) >= bound)
    cold = lookup.filter(F.col(weight) < bound)
    by_hot = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return by_hot.unionByName(rest)


def ranked(df: DataFrame, within: list[str], order_hash: str, tie: str, rows: int, out: str = "rank", per_bucket: int = 200_000) -> DataFrame:
    """1-based rank of each row within its key by (order_hash, tie), without a task that holds a whole key.

    The unsigned range of the 64-bit hash is cut into buckets of about `per_bucket` rows; counts per bucket give
    each bucket its offset, and a window numbers the rows inside a bucket. The table of counts has
    keys x buckets rows and is joined by shuffle.
    """
    from pyspark.sql import Window as W

    buckets = max(1, -(-rows // per_bucket))
    b = F.shiftright((F.shiftright(order_hash, 32) + F.lit(1 << 31)) * F.lit(buckets), 32).cast("int")
    df = df.withColumn("_bucket", b if buckets > 1 else F.lit(0))
    keys = [*within, "_bucket"]
    inside = W.partitionBy(*keys).orderBy(order_hash, tie)
    numbered = df.withColumn("_inside", F.row_number().over(inside))
    if buckets == 1:
        return numbered.withColumn(out, F.col("_inside").cast("long")).drop("_bucket", "_inside")
    before = W.partitionBy(*within).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = df.groupBy(*keys).count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    cond = [numbered[k].eqNullSafe(offsets[k]) for k in keys]
    joined = numbered.join(offsets, cond).select(*[numbered[c] for c in numbered.columns], offsets["_before"])
    return joined.withColumn(out, (F.col("_inside") + F.col("_before")).cast("long")).drop("_bucket", "_inside", "_before")


def spread(df: DataFrame) -> DataFrame:
    """For work that costs far more than moving its rows: a table of fewer files than there are cores is dealt to all of them.

    A table of at least as many splits as cores is left where it is, without a shuffle.
    """
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
