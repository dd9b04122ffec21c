"""Functions for SQL: register(spark) makes them known by name."""

from __future__ import annotations

import ast

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from . import text

_ROW = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("kind", T.StringType())])


class _Nodes:
    """Nodes of a Python file in pre-order, each with its parent; none where it does not parse."""

    def eval(self, code):
        try:
            tree = ast.parse(code or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        stack, n = [(tree, -1)], 0
        while stack:
            node, parent = stack.pop()
            yield n, parent, type(node).__name__
            stack.extend((c, n) for c in reversed(list(ast.iter_child_nodes(node))))
            n += 1


def register(spark: SparkSession) -> None:
    spark.udf.register("syntax_counts", text.syntax_counts)
    spark.udf.register("risky_spans", text.risky_spans)
    spark.udtf.register("python_nodes", udtf(_Nodes, returnType=_ROW))
