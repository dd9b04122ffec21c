"""Reachability over edge tables, pooling over graph nodes, trees of Python code."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import settle


#: Steps that one job takes before what is reached is written to the shared folder.
STEPS_A_JOB = 6


def reach(edges: DataFrame, starts: DataFrame, depth: int, keep_start: bool = False) -> DataFrame:
    """(start, node, depth): nodes within `depth` steps of each start, with the least number of steps.

    edges (src, dst), starts (start). A step joins what is reached with the edges, and with a loop of length 0 at each
    node, and keeps the shortest way to each node; so pairs are never listed by path, cycles end, and the steps of
    STEPS_A_JOB are one job. Beyond those, it goes on only while something new is reached. Start nodes themselves are
    left out unless keep_start, or reached again.
    """
    own = starts.select("start").where("start is not null").distinct()
    pairs = edges.select("src", "dst").where("src is not null and dst is not null")
    both = pairs.select(F.explode(F.array(F.struct("src", "dst", F.lit(1).alias("far")), F.struct(F.col("dst").alias("src"), "dst", F.lit(0).alias("far")))).alias("e")).select("e.*")
    e = settle(both.unionByName(own.select(F.col("start").alias("src"), F.col("start").alias("dst"), F.lit(0).alias("far"))).distinct())

    def step(held, k, far):
        joined = held.join(e.where("far = 1") if far else e, F.col("node") == F.col("src"))
        # only what the last step reached goes further
        ways = joined.where((F.col("far") == 0) | (F.col("depth") == k - 1)).select("start", F.col("dst").alias("node"), (F.col("depth") + F.col("far")).alias("depth"))
        return ways.groupBy("start", "node").agg(F.min("depth").alias("depth"))

    first = own.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    if depth < 1:
        return first if keep_start else first.limit(0)
    held = step(first, 1, not keep_start)
    last = None
    for k in range(2, depth + 1):
        held = step(held, k, False)
        if k % STEPS_A_JOB == 0 and k < depth:
            held = settle(held)
            now = held.count()
            if now == last:
                break
            last = now
    return held


def between(edges: DataFrame, sources: DataFrame, sinks: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): sinks that sources reach, nearest first by depth."""
    return reach(edges, sources, depth).join(sinks.select(F.col("sink").alias("node")).distinct(), "node", "left_semi")


def mark(nodes: DataFrame, marks: DataFrame, key: str, flag: str) -> DataFrame:
    """Nodes with a flag set where marks has the key; marks without a node become nodes."""
    m = marks.select(key).distinct().withColumn("_m", F.lit(True))
    return nodes.drop(flag).join(m, key, "full").withColumn(flag, F.coalesce("_m", F.lit(False))).drop("_m")


def seeded(rows: DataFrame, kinds: list[tuple[str, str, str]]) -> DataFrame:
    """(kind, src, dst): the distinct edges that pairs of columns of one table make, ends as text; edges with a null end are left out."""
    e = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst")) for k, a, b in kinds))
    return rows.select(F.explode(e).alias("e")).select("e.*").where("src is not null and dst is not null").distinct()


def duplicate_keys(nodes: DataFrame, key: list[str]) -> DataFrame:
    return nodes.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def pool(vectors: DataFrame, graph: str, vector: str, mask: str | None = None) -> DataFrame:
    """(graph, mean, most): element-wise mean and maximum of node vectors per graph; masked nodes count for nothing.

    Aggregated per dimension, so partial sums are combined before the shuffle. A graph without any node that counts
    has zeros as its mean.
    """
    x = vectors.select(graph, F.posexplode(vector).alias("i", "v"), (F.col(mask).cast("double") if mask else F.lit(1.0)).alias("m"))
    g = x.groupBy(graph, "i").agg((F.sum(F.col("v") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-6))).alias("a"), F.max(F.when(F.col("m") > 0, F.col("v"))).alias("b"))
    at = F.array_sort(F.collect_list(F.struct("i", "a", "b")))
    return g.groupBy(graph).agg(at.alias("r")).select(graph, F.transform("r", lambda z: z["a"]).alias("mean"), F.transform("r", lambda z: z["b"]).alias("most"))


#: Levels of a tree that are kept.
TREE_DEPTH = 50


def trees(df: DataFrame, id_col: str, code: str) -> DataFrame:
    """(id, ok, how, nodes array<string>, edges array<array<int>>): trees of Python code in pre-order, both edge directions.

    Nodes and edges come from one walk, TREE_DEPTH levels deep. Code that does not parse is tried without its last
    lines, by halves (how = partial), then becomes a chain of its words (how = tokens, ok = false).
    """

    def walk(tree):
        nodes, edges = [], []
        stack = [(tree, -1, 0)]
        while stack:
            node, parent, level = stack.pop()
            me = len(nodes)
            nodes.append(type(node).__name__)
            if parent >= 0:
                edges += [[parent, me], [me, parent]]
            if level < TREE_DEPTH:
                stack.extend((c, me, level + 1) for c in reversed(list(ast.iter_child_nodes(node))))
        return nodes, edges

    def build(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for i, text in zip(pdf[id_col], pdf[code]):
                lines, how, tree = (text or "").split("\n"), "full", None
                keep = len(lines)
                while keep and tree is None:
                    try:
                        tree = ast.parse("\n".join(lines[:keep]))
                    except (SyntaxError, ValueError, RecursionError, MemoryError):
                        keep, how = keep // 2, "partial"
                if tree is not None and (how == "full" or getattr(tree, "body", None)):
                    n, e = walk(tree)
                    rows.append((i, how == "full", how, n, e))
                else:
                    n = (text or "").split()[:512]
                    rows.append((i, False, "tokens", n, [p for k in range(len(n) - 1) for p in ([k, k + 1], [k + 1, k])]))
            yield pd.DataFrame(rows, columns=[id_col, "ok", "how", "nodes", "edges"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, code).mapInPandas(build, f"{id_col} {kind}, ok boolean, how string, nodes array<string>, edges array<array<int>>")


def definitions(df: DataFrame, id_col: str, code: str) -> DataFrame:
    """(id, kind, name, line, owner, route): functions, classes and routes of Python code.

    A method has its class as owner; a function whose decorator calls something with a path as first argument is a
    route of that path. Code that does not parse, and null, give no rows.
    """

    def found(text):
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        stack = [(tree, None)]
        while stack:
            node, owner = stack.pop()
            for c in ast.iter_child_nodes(node):
                inside = owner
                if isinstance(c, ast.ClassDef):
                    yield "class", c.name, c.lineno, owner, None
                    inside = c.name
                elif isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    paths = [x.args[0].value for x in c.decorator_list if isinstance(x, ast.Call) and x.args and isinstance(x.args[0], ast.Constant) and isinstance(x.args[0].value, str) and x.args[0].value.startswith("/")]
                    yield "route" if paths else "function", c.name, c.lineno, owner, paths[0] if paths else None
                stack.append((c, inside))

    def build(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([(i, *row) for i, text in zip(pdf[id_col], pdf[code]) for row in found(text)], columns=[id_col, "kind", "name", "line", "owner", "route"])

    return df.select(id_col, code).mapInPandas(build, f"{id_col} {dict(df.dtypes)[id_col]}, kind string, name string, line int, owner string, route string")
