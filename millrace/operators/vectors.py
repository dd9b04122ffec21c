"""Nearest neighbours by cosine for a stated set of queries, against all rows in blocks."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries that are broadcast at once.
QUERY_BLOCK = 4096


def norm(v) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, least: float | None = None) -> DataFrame:
    """(query, neighbour, similarity): the k most similar rows for each query, itself left out, then those below `least`.

    Queries are taken QUERY_BLOCK at a time; each batch of rows is multiplied with the block and keeps its own k
    best, so at most k rows per query and batch are shuffled. Equal similarities are ranked by id. Vectors of different
    lengths are not alike; nor are null and zero vectors, and those with a null, like anything. Rows without an id are left out.
    """
    spark = rows.sparkSession

    def search(block):
        ids = np.asarray([i for i, _ in block], np.int64)
        m = np.asarray([v for _, v in block], np.float64)
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((ids, m))

        def scan(batches):
            qs, q = shared.value
            for b in batches:
                d = q.shape[1]
                b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), d), False))
                flat = b.column(1).flatten()
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                gaps = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(axis=1)
                keep = ~gaps & (np.where(gaps[:, None], 0.0, x) != 0).any(axis=1)
                if not keep.any():
                    continue
                rid, x = b.column(0).to_numpy(zero_copy_only=False)[keep], x[keep]
                sim = np.round(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
                sim[qs[:, None] == rid[None, :]] = -np.inf
                n = min(k, len(rid))
                order = np.argsort(rid, kind="stable")
                top = np.argsort(-sim[:, order], axis=1, kind="stable")[:, :n]
                s = np.take_along_axis(sim[:, order], top, axis=1)
                ok = np.isfinite(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qs, n)[ok.ravel()]), pa.array(rid[order][top][ok]), pa.array(s[ok])], ["query", "neighbour", "similarity"])

        return rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), vector).mapInArrow(scan, "query long, neighbour long, similarity double")

    held: dict[int, list] = {}
    parts = []
    for r in queries.select(F.col(id_col).cast("long"), vector).toLocalIterator():
        v = r[1]
        if v is None or None in v or not any(v):
            continue
        block = held.setdefault(len(v), [])
        block.append((r[0], v))
        if len(block) == QUERY_BLOCK:
            parts.append(search(held.pop(len(v))))
    parts += [search(block) for block in held.values()]
    out = functools.reduce(DataFrame.unionByName, parts) if parts else None
    if out is None:
        return rows.select(F.lit(0).cast("long").alias("query"), F.lit(0).cast("long").alias("neighbour"), F.lit(0.0).alias("similarity")).limit(0)
    w = W.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    best = out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    return best if least is None else best.where(F.col("similarity") >= least)
