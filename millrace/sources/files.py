"""Readers of JSON lines, JSON arrays, CSV, archives and arrays in files."""

from __future__ import annotations

import functools
import io
import json
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(schema) -> T.StructType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


def read_jsonl(spark: SparkSession, path, schema, bad: str = "skip", source: str | None = None) -> DataFrame:
    """JSON lines by a given schema. bad: 'skip' drops damaged lines, 'fail' aborts, 'keep' adds them as _bad_line.

    source is added as column dataset_source. Blank lines are ignored. The schema is given, so files are read once.
    """
    s = _schema(schema)
    if bad == "keep":
        df = spark.read.schema(T.StructType([*s.fields, T.StructField("_bad_line", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad_line").json(path)
    else:
        df = spark.read.schema(s).option("mode", "FAILFAST" if bad == "fail" else "DROPMALFORMED").json(path)
    return df if source is None else df.withColumn("dataset_source", F.lit(source))


def rejected(spark: SparkSession, path, schema) -> DataFrame:
    """(file, line) of each damaged line."""
    s = _schema(schema)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where("trim(line) <> ''")
    return lines.where(F.try_parse_json("line").isNull() | F.from_json("line", s).isNull())


def intact(spark: SparkSession, path, schema) -> bool:
    """Whether reading with bad = 'fail' gets through; other errors than a damaged line are raised."""
    try:
        read_jsonl(spark, path, schema, bad="fail").write.format("noop").mode("overwrite").save()
    except Exception as e:  # noqa: BLE001 - Spark wraps a damaged line in several kinds of errors
        if "MALFORMED_RECORD" not in str(e):
            raise
        return False
    return True


def read_json_document(path: str):
    """One JSON document of a driver's file; FileNotFoundError if it is not there, ValueError with the path if it is no JSON."""
    with open(path, encoding="utf-8") as f:
        try:
            return json.load(f)
        except ValueError as e:
            raise ValueError(f"{path} is no valid JSON: {e}") from e


def registry(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """(name, n, columns): rows and columns of each registered table; a table that is not there is an error. One job for all."""
    each = [spark.read.parquet(path) for path in tables.values()]
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(len(df.columns)).alias("columns")) for name, df in zip(tables, each)]
    return functools.reduce(DataFrame.unionByName, rows)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all the columns are there; an absent key and a null are the same."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def read_json_array(spark: SparkSession, path, schema) -> DataFrame:
    """Files that are one array of records each."""
    return spark.read.schema(_schema(schema)).option("multiLine", True).json(path)


def read_csv_text(spark: SparkSession, path, renames: dict[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, all columns text, missing cells empty, columns renamed."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path).withColumnsRenamed(renames or {}).na.fill("")


def read_metrics_csv(spark: SparkSession, path, schema) -> DataFrame:
    return spark.read.schema(_schema(schema)).option("header", True).csv(path)


def read_zip_json(spark: SparkSession, path) -> DataFrame:
    """(archive, entry, ordinal, document, error) of the .json entries of ZIP files, in archive order. A bad entry has an error."""

    def unzip(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile as e:
                    rows.append((name, None, 0, None, str(e)))
                    continue
                for i, info in enumerate(x for x in z.infolist() if x.filename.endswith(".json")):
                    try:
                        text = z.read(info).decode("utf-8")
                        json.loads(text)
                        rows.append((name, info.filename, i, text, None))
                    except Exception as e:  # noqa: BLE001 - whatever is wrong with one entry is that entry's error
                        rows.append((name, info.filename, i, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["archive", "entry", "ordinal", "document", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "archive string, entry string, ordinal int, document string, error string")


def read_npy(spark: SparkSession, path) -> DataFrame:
    """(file, row_id, value) of one-dimensional .npy arrays."""

    def load(batches):
        import numpy as np

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False).ravel()
                yield pd.DataFrame({"file": name, "row_id": np.arange(len(a)), "value": a.astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, "file string, row_id long, value double")


def predictions(spark: SparkSession, directory: str) -> DataFrame:
    """(seed, row_id, prob, label) of <directory>/seed_*/val_probs.npy and val_labels.npy; seeds that lack one are left out."""
    seed = lambda c: F.regexp_extract(c, r"seed_?(\d+)", 1).cast("long")
    p = read_npy(spark, f"{directory}/seed_*/val_probs.npy").select(seed("file").alias("seed"), "row_id", F.col("value").alias("prob"))
    l = read_npy(spark, f"{directory}/seed_*/val_labels.npy").select(seed("file").alias("seed"), "row_id", F.col("value").cast("long").alias("label"))
    return p.join(l, ["seed", "row_id"])


def read_glob(spark: SparkSession, pattern: str, schema, key: str, key_pattern: str, lines: bool = False) -> DataFrame:
    """JSON documents (or, with `lines`, JSON lines) of many folders, with a key cut out of each path; the key orders them."""
    df = spark.read.schema(_schema(schema)).option("multiLine", not lines).json(pattern)
    return df.withColumn(key, F.regexp_extract(F.col("_metadata.file_path"), key_pattern, 1))


def inventory(spark: SparkSession, pattern: str) -> DataFrame:
    """(directory, files, bytes) below a pattern; only file names and sizes are read."""
    df = spark.read.format("binaryFile").load(pattern).select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("directory"), "length")
    return df.groupBy("directory").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def checksums(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, sha256) of whole files."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"))


def cache_key(*parts) -> Column:
    return F.md5(F.concat_ws("_", *parts))


def fresh(df: DataFrame, ts: str, now: Column, max_age_hours: float = 168.0) -> DataFrame:
    """Entries of a cache that are not older than the limit; those without a time are stale."""
    return df.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")) <= int(max_age_hours * 3_600_000_000))


def read_through(wanted: DataFrame, cache: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses); an empty cached value is a miss."""
    have = cache.where(F.col(value).isNotNull() & (F.col(value) != "")).select(key, value)
    return wanted.join(have, key), wanted.join(have, key, "left_anti")


#: Where the registry of an ecosystem has a package's repository; elsewhere at the first path of the rest.
REPOSITORY_PATHS = {"npm": "$.repository.url", "pip": "$.info.home_page", "rubygems": "$.source_code_uri"}


def registry_urls(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """wanted (ecosystem, package, ...) with `url` from the registry's document of that package, null without one.

    registry (ecosystem, package, document): one JSON document per package, in the shape of its ecosystem.
    """
    url = F.get_json_object("document", "$.url")
    for name, path in REPOSITORY_PATHS.items():
        url = F.when(F.col("ecosystem") == name, F.get_json_object("document", path)).otherwise(url)
    return wanted.join(registry.select("ecosystem", "package", url.alias("url")), ["ecosystem", "package"], "left")


def first_valid(*candidates: Column, valid) -> Column:
    """The first of several texts that is valid."""
    return F.coalesce(*(F.when(valid(c), c) for c in candidates))
