"""A base for sources that are paged services: a class with a name, a schema, partitions and rows becomes a Spark data source.

    class Advisories(Collector):
        name, schema = "advisories", "doc_id string, published string, document string"
        def partitions(self, wanted): ...      # what to read, by the filters that were pushed
        def rows(self, partition, wanted): ...  # dictionaries with the schema's columns
    register(spark, Advisories)
    spark.read.format("advisories").option("path", folder).load().where("published >= '2031'")

Equality and range filters on the columns in `pushed` reach both methods as `Wanted`; Spark applies all filters again,
so a source may use as many of them as it can.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


@dataclass
class Wanted:
    """Filters that were pushed: column -> value, and column -> least and most value (inclusive)."""

    equal: dict = field(default_factory=dict)
    least: dict = field(default_factory=dict)
    most: dict = field(default_factory=dict)

    def take(self, f) -> None:
        if len(f.attribute) != 1:
            return
        c = f.attribute[0]
        if isinstance(f, EqualTo):
            self.equal[c] = f.value
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.least[c] = max(self.least.get(c, f.value), f.value)
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.most[c] = min(self.most.get(c, f.value), f.value)

    def admits(self, row: dict) -> bool:
        """Whether a row can pass; a null passes no filter."""
        for c, v in self.equal.items():
            if row.get(c) != v:
                return False
        for bounds, ok in ((self.least, lambda x, v: x >= v), (self.most, lambda x, v: x <= v)):
            for c, v in bounds.items():
                if row.get(c) is None or not ok(row[c], v):
                    return False
        return True


class Collector:
    """What a source gives: see the module's text."""

    name: str = ""
    schema: str = ""
    pushed: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.options = options

    def partitions(self, wanted: Wanted) -> list:
        raise NotImplementedError

    def rows(self, partition, wanted: Wanted):
        raise NotImplementedError


def data_source(cls: type[Collector]) -> type[DataSource]:
    """The Spark data source of a collector."""
    columns = [c.split()[0] for c in cls.schema.split(",")]

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.collector, self.wanted = cls(dict(options)), Wanted()

        def pushFilters(self, filters):
            for f in filters:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute[0] in cls.pushed:
                    self.wanted.take(f)
                yield f  # Spark still applies it

        def partitions(self):
            return [InputPartition(p) for p in self.collector.partitions(self.wanted)]

        def read(self, partition):
            if partition is None or getattr(partition, "value", None) is None:
                return
            for row in self.collector.rows(partition.value, self.wanted):
                if self.wanted.admits(row):
                    yield tuple(row.get(c) for c in columns)

    class Source(DataSource):
        @classmethod
        def name(cls_):
            return cls.name

        def schema(self):
            return cls.schema

        def reader(self, schema):
            return Reader(self.options)

    return Source


REGISTRY: dict[str, type[Collector]] = {}


def register(spark: SparkSession, *collectors: type[Collector]) -> None:
    """Make collectors readable by their names; a name that another class has is refused."""
    for c in collectors:
        if not c.name or REGISTRY.get(c.name, c) is not c:
            raise ValueError(f"no free name: {c.name!r}")
        REGISTRY[c.name] = c
        spark.dataSource.register(data_source(c))
