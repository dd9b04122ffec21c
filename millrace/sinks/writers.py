"""Writers of JSON lines, tables, snapshots, graphs and reports, chosen by name."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> None:
    """JSON lines, one file per partition unless `files` says otherwise; nulls are left out. Committed as a whole."""
    (df.coalesce(files) if files else df).write.mode(mode).json(path)


def append_jsonl(new: DataFrame, path: str, key: str) -> int:
    """Append rows whose key the table at path does not have; how many."""
    spark = new.sparkSession
    try:
        old = spark.read.schema(new.schema).json(path).select(key).distinct()
        fresh = new.join(old, key, "left_anti")
    except Exception as e:  # noqa: BLE001 - a path that is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = new
    fresh = fresh.dropDuplicates([key]).persist()
    n = fresh.count()
    fresh.write.mode("append").json(path)
    fresh.unpersist()
    return n


def append_history(rows: DataFrame, path: str) -> None:
    """Rows added to a table of a run's metrics or predictions; each write is committed as a whole."""
    rows.write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, path: str, at: str, keep: int | None = None) -> str:
    """The table as path/snapshot=<at>, replaced if it is there; with `keep` only the latest so many snapshots stay. Returns its path.

    `at` is a time in text that sorts, such as 20320101T120000.
    """
    spark = df.sparkSession
    out = f"{path}/snapshot={at}"
    df.write.mode("overwrite").parquet(out)
    if keep:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = sorted(x.getPath().getName() for x in fs.listStatus(root) if x.getPath().getName().startswith("snapshot="))
        for name in names[:-keep]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, name), True)
    return out


def graph_tensors(nodes: DataFrame, edges: DataFrame, graph: str, node: str, features: str, label: str) -> DataFrame:
    """(graph, x array<array>, edge_index array<array<int>>, y): each graph as arrays, nodes in order, edges as places in that order.

    nodes: graph, node, features, label of the graph; edges: graph, src, dst. Edges whose ends are no nodes are left
    out. One task holds one graph.
    """
    n = nodes.groupBy(graph).agg(F.array_sort(F.collect_list(F.struct(node, features))).alias("ns"), F.max(label).alias("y"))
    e = edges.groupBy(graph).agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("es"))
    j = n.join(e, graph, "left").withColumn("ids", F.transform("ns", lambda z: z[node]))
    place = lambda z, end: (F.array_position("ids", z[end]) - 1).cast("int")
    pairs = F.filter(F.transform(F.coalesce("es", F.array().cast(dict(e.dtypes)["es"])), lambda z: F.array(place(z, "src"), place(z, "dst"))), lambda p: (p[0] >= 0) & (p[1] >= 0))
    return j.select(graph, F.transform("ns", lambda z: z[features]).alias("x"), pairs.alias("edge_index"), "y")


def write_atomic(obj, path: str) -> None:
    """A small JSON document: written beside its place, then moved there; on failure nothing is left."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(obj, f, ensure_ascii=False, indent=2)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        os.path.exists(tmp) and os.unlink(tmp)
        raise


def sarif(events: DataFrame) -> DataFrame:
    """(document): one SARIF run with a result per collector, level note if it succeeded, else warning."""
    result = F.struct(F.col("collector").alias("ruleId"), F.when(F.col("success"), "note").otherwise("warning").alias("level"), F.struct(F.coalesce("message", F.lit("")).alias("text")).alias("message"))
    tool = F.struct(F.struct(F.lit("collection").alias("name"), F.lit("1.0.0").alias("version")).alias("driver"))
    runs = events.agg(F.array_sort(F.collect_list(result)).alias("results")).select(F.array(F.struct(tool.alias("tool"), "results")).alias("runs"))
    return runs.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), "runs")).alias("document"))


def metrics_document(scores: DataFrame, sweep: DataFrame) -> DataFrame:
    """(document): a row of scores with the sweep as an array."""
    arr = sweep.agg(F.array_sort(F.collect_list(F.struct("threshold", "precision", "recall", "f1"))).alias("threshold_sweep"))
    return scores.withColumn("threshold_sweep", arr.scalar()).select(F.to_json(F.struct("*")).alias("document"))


def graph_tables(nodes: DataFrame, edges: DataFrame, path: str, key: str = "id") -> None:
    """Nodes and edges as two tables, after a check that keys are unique and edges end at nodes."""
    if nodes.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("node keys are not unique")
    ends = edges.select(F.explode(F.array("src", "dst")).alias(key)).distinct()
    if ends.join(nodes.select(key), key, "left_anti").limit(1).count():
        raise ValueError("an edge ends at no node")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small table as text; larger ones are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for a report")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x) for x in r) + " |" for r in rows)])


WRITERS: dict[str, Callable[[DataFrame, str], None]] = {
    "jsonl": write_jsonl,
    "csv": lambda df, path: df.write.mode("overwrite").option("header", True).csv(path),
    "parquet": lambda df, path: df.write.mode("overwrite").parquet(path),
    "sarif": lambda df, path: sarif(df).coalesce(1).write.mode("overwrite").text(path),
}


def write_all(df: DataFrame, path: str, formats: list[str]) -> list[str]:
    """The table in each known format, at path/format; the formats written."""
    done = []
    for f in formats:
        if f in WRITERS:
            WRITERS[f](df, f"{path}/{f}")
            done.append(f)
    return done
