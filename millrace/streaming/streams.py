"""Streams of events: latest state, sessions after a quiet period, changes of content, alarms, gated batches."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..runtime import scratch_dir


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A table of a folder as a stream of its files, whether it is one file or a folder of them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def timed(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_counts(stream: DataFrame, ts: str, kind: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, kind, n) per window; rows later than the watermark are left out."""
    g = timed(stream, ts).withWatermark(ts, late).groupBy(F.window(ts, size), kind).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), kind, "n")


def latest_state(stream: DataFrame, key: str, ts: str, fields: list[str]) -> DataFrame:
    """The last row of each key so far; for output mode complete or update."""
    return stream.groupBy(key).agg(F.max_by(F.struct(ts, *fields), F.col(ts)).alias("s")).select(key, "s.*")


def debounced(stream: DataFrame, key: str, ts: str, quiet: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): bursts of a key, given out once it has been quiet that long."""
    g = timed(stream, ts).withWatermark(ts, late).groupBy(F.session_window(ts, quiet), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def changes(stream: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """(key, order, content) where the content differs from what the key had before, across batches."""
    types = dict(stream.dtypes)

    def step(k, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(frames)).sort_values(order)
        out = []
        for o, c in zip(pdf[order], pdf[content]):
            c = "" if c is None or c != c else str(c)
            if c != last:
                out.append((k[0], o, c))
                last = c
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, order, content])

    schema = f"{key} {types[key]}, {order} {types[order]}, {content} string"
    return stream.groupBy(key).applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def alarms(stream: DataFrame, key: str, order: str, bad: str, run: int = 3) -> DataFrame:
    """(key, order): where a key has `run` bad rows in a row, across batches; the count starts again after an alarm."""
    types = dict(stream.dtypes)

    def step(k, frames, state: GroupState):
        n = state.get[0] if state.exists else 0
        pdf = pd.concat(list(frames)).sort_values(order)
        out = []
        for o, b in zip(pdf[order], pdf[bad]):
            n = n + 1 if b is True or b == 1 else 0
            if n == run:
                out.append((k[0], o))
                n = 0
        state.update((n,))
        yield pd.DataFrame(out, columns=[key, order])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, {order} {types[order]}", "n long", "append", GroupStateTimeout.NoTimeout)


def run_to_table(df: DataFrame, mode: str) -> DataFrame:
    """Everything there is through the stream, and the result as a table. complete: the last state."""
    spark = df.sparkSession
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = df.schema
    if mode == "complete":
        w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out"))
    else:
        w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").format("parquet").option("path", f"{base}/out")
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


def gated(stream: DataFrame, path: str, least: int, checkpoint: str):
    """Batches wait in path/pending and are appended to path/synced together once `least` rows wait.

    Each batch is written once to pending and at most once to synced, as a folder of its own; path/ledger has the last
    batch of each sync and how many rows it moved. A batch that is run again after a failure replaces its own folders.
    """
    spark = stream.sparkSession

    def there(name):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def each(batch, i):
        batch.write.mode("overwrite").parquet(f"{path}/pending/batch={i}")
        last = spark.read.parquet(f"{path}/ledger").where(F.col("batch") < i).agg(F.max("batch")).first()[0] if there("ledger") else None
        schema = batch.schema.add("batch", "long")
        wait = spark.read.schema(schema).parquet(f"{path}/pending").where(F.col("batch") <= i)
        wait = wait if last is None else wait.where(F.col("batch") > last)
        n = wait.count()
        if n >= least:
            wait.drop("batch").write.mode("overwrite").parquet(f"{path}/synced/sync={i}")
            spark.createDataFrame([(n,)], "rows long").write.mode("overwrite").parquet(f"{path}/ledger/batch={i}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
