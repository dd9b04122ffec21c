"""Inference-shaped functions: hashed embeddings, dense layers over given weights, logits, scores of several parts."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VECTOR = T.ArrayType(T.FloatType())


def embedder(dims: int = 64, limit: int | None = 512) -> Callable[[Column], Column]:
    """A vector of hashed words of length one for each non-empty text, null for others; the first `limit` words count (512 as encoders take, None for all).

    Stands where a trained encoder would: any function from a list of texts to a matrix fits in its place.
    """

    @F.pandas_udf(_VECTOR)
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words = (text or "").split()[:limit]
            if not words:
                out.append(None)
                continue
            v = np.zeros(dims, np.float32)
            for w in words:
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                v[h % dims] += 1.0 if h >> 31 else -1.0
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed


def dense(layers: list[tuple[list[list[float]], list[float]]]) -> Callable[[Column], Column]:
    """Layers of (weights, bias) with ReLU between them, over a feature array; null for vectors of another length."""
    mats = [(np.asarray(w, float), np.asarray(b, float)) for w, b in layers]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def forward(features: pd.Series) -> pd.Series:
        n = mats[0][0].shape[0]
        good = [i for i, f in enumerate(features) if f is not None and len(f) == n]
        out: list = [None] * len(features)
        if good:
            x = np.asarray([features.iloc[i] for i in good], float)
            for k, (w, b) in enumerate(mats):
                x = x @ w + b
                if k + 1 < len(mats):
                    x = np.maximum(x, 0)
            for i, row in zip(good, x):
                out[i] = row.tolist()
        return pd.Series(out)

    return forward


def positive_probability(logits: Column) -> Column:
    """Probability of class 1 from two logits."""
    return 1 / (1 + F.exp(F.get(logits, F.lit(0)) - F.get(logits, F.lit(1))))


def mean_logits(df: DataFrame, row: str, logits: str) -> DataFrame:
    """(row, label): the class with the largest mean logit; of equal ones the first."""
    g = df.select(row, F.posexplode(logits).alias("cls", "z")).groupBy(row, "cls").agg(F.avg("z").alias("z"))
    return g.groupBy(row).agg(F.max_by("cls", F.struct("z", -F.col("cls"))).alias("label"))


def weighted_parts(parts: list[tuple[Column, float]], missing: float = 0.0) -> Column:
    """The weighted sum of several parts, a missing one counting as `missing`."""
    return sum((F.coalesce(c, F.lit(missing)) * w for c, w in parts), F.lit(0.0))


def graph_layer(nodes: DataFrame, edges: DataFrame, weights: list[list[float]] | None = None, relu: bool = True) -> DataFrame:
    """(graph, node, h): one convolution: each node's vector becomes the sum over itself and its neighbours, each
    divided by the root of both degrees (counted with itself), times the weights.

    nodes (graph, node, h), edges (graph, src, dst). Messages are summed per dimension, so hot nodes are combined
    before the shuffle.
    """
    ends = edges.select("graph", "src", "dst").where("src <> dst").distinct().unionByName(nodes.select("graph", F.col("node").alias("src"), F.col("node").alias("dst")))
    deg = ends.groupBy("graph", F.col("src").alias("node")).agg(F.count("*").alias("deg"))
    h = nodes.join(deg, ["graph", "node"]).select("graph", F.col("node").alias("src"), F.transform("h", lambda x: x / F.sqrt(F.col("deg"))).alias("h"))
    msg = ends.join(h, ["graph", "src"]).select("graph", F.col("dst").alias("node"), F.posexplode("h").alias("i", "x"))
    got = msg.groupBy("graph", "node", "i").agg(F.sum("x").alias("x")).groupBy("graph", "node").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("r"))
    out = got.join(deg, ["graph", "node"]).select("graph", "node", F.transform("r", lambda z: z["x"] / F.sqrt(F.col("deg"))).alias("h"))
    if weights is not None:
        cols = [F.array(*[F.lit(float(v)) for v in c]) for c in zip(*weights)]
        out = out.withColumn("h", F.array(*[F.aggregate(F.zip_with("h", c, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for c in cols]))
    return out.withColumn("h", F.transform("h", lambda x: F.greatest(x, F.lit(0.0)))) if relu else out


def graph_classifier(nodes: DataFrame, edges: DataFrame, layers: list[list[list[float]] | None], head: list[tuple[list[list[float]], list[float]]]) -> DataFrame:
    """(graph, logits): convolutions with ReLU, mean and maximum of the node vectors of each graph, and a dense head over both.

    layers: the weights of each convolution, None to leave the vectors as they are; head: as in `dense`, its input is the
    mean and then the maximum. Graphs without a node have no row.
    """
    from ..operators.graph import pool

    h = nodes
    for w in layers:
        h = graph_layer(h, edges, w)
    return pool(h, "graph", "h").select("graph", dense(head)(F.concat("mean", "most")).alias("logits"))


class Registry:
    """Named models: what builds them and their fixed facts. Names count without case; an unknown one lists those there are."""

    def __init__(self):
        self._held: dict[str, tuple[Callable, dict]] = {}

    def add(self, name: str, build: Callable, **facts) -> None:
        if name.lower() in self._held:
            raise ValueError(f"{name} is there already")
        self._held[name.lower()] = (build, facts)

    def names(self) -> list[str]:
        return sorted(self._held)

    def facts(self, name: str) -> dict:
        return dict(self._get(name)[1])

    def build(self, name: str, **options):
        return self._get(name)[0](**options)

    def _get(self, name: str):
        try:
            return self._held[name.lower()]
        except KeyError:
            raise KeyError(f"no model {name}; there are {', '.join(self.names())}") from None


#: Embedders by name; a trained encoder is added the same way.
BACKBONES = Registry()
BACKBONES.add("hashed-64", lambda limit=512: embedder(64, limit), dims=64, words=512)
BACKBONES.add("hashed-256", lambda limit=512: embedder(256, limit), dims=256, words=512)
