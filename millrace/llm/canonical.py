"""Copies hidden by formatting: canonical digests, Bloom filters of once- and repeatedly-seen hashes, exact grouping.

Every record gets a digest of its canonical form. Each partition builds two Bloom filters over its digests: of those
seen at least once and of those seen at least twice. Two partitions' filters merge as
    twice = twice_a | twice_b | (once_a & once_b),   once = once_a | once_b,
so a digest that occurs in two partitions has all its bits in `twice` even if each saw it only once. Rows outside
`twice` are surely unique and never shuffled; the rest (repeats and a few false hits) are grouped exactly.

The filter has BITS_PER_ROW bits for each row and is cut into ranges of a second hash, each of at most RANGE_BITS bits.
Digests of more than one range are written range by range; the filters of all ranges are built in one job, and each
range reads and probes only its own digests. What is broadcast at once never exceeds RANGES_AT_ONCE times RANGE_BITS / 8
bytes, and is freed when a range is done.
"""

from __future__ import annotations

import functools
import zlib
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import settle, skew_safe_lookup

BITS_PER_ROW = 16
RANGE_BITS = 1 << 28  # 32 MB a filter
SLICE_BITS = 1 << 18  # 32 kB
FAN_IN = 64
RANGES_AT_ONCE = 4


def canonical_json(col):
    """JSON text with sorted keys and no spacing; text that is no JSON stays as it is."""
    v = F.try_parse_json(col)
    return F.when(v.isNull(), F.concat(F.lit("raw:"), col)).otherwise(F.to_json(v))


def letters_digits(col):
    """Letters and digits of a text in lower case, everything else removed."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", "")


def canonical_digests(samples: DataFrame) -> DataFrame:
    """(sample_id, digest binary(16), h long) of the rows that take part.

    Rows whose label or code is null, or whose code has no letter or digit, take no part. Null attrs equal null attrs
    and nothing else.
    """
    s = samples.select("sample_id", "label", "attrs", letters_digits("code").alias("_c")).where("label is not null and _c is not null and _c <> ''")
    attrs = F.coalesce(F.concat(F.lit("j"), canonical_json(F.col("attrs"))), F.lit("n"))
    digest = F.unhex(F.md5(F.concat_ws("\u0001", F.col("label").cast("string"), attrs, F.col("_c"))))
    return s.select("sample_id", digest.alias("digest")).withColumn("h", F.xxhash64("digest"))


def _positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions from disjoint halves of the hash; bits is a power of two of at most 2^32."""
    u = h.view(np.uint64)
    mask = np.uint64(bits - 1)
    return (u & mask).astype(np.int64), (u >> np.uint64(32) & mask).astype(np.int64)


def _test(flt: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    p, q = _positions(h, bits)
    return ((flt[p >> 3] >> (7 - (p & 7)) & 1) & (flt[q >> 3] >> (7 - (q & 7)) & 1)).astype(bool)


def _bitmap(pos: np.ndarray, bits: int) -> np.ndarray:
    flags = np.zeros(bits, dtype=bool)
    flags[pos] = True
    return np.packbits(flags)


_PARTIAL = "range int, slice int, part int, once binary, twice binary"


def _builder(bits: int):
    slices, per = max(1, bits // SLICE_BITS), min(bits, SLICE_BITS)

    def build(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not parts:
            return
        hs, rs = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        order = np.argsort(rs, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(rs[order])) + 1):
            uniq, counts = np.unique(hs[own], return_counts=True)
            once, twice = (np.concatenate(_positions(x, bits)) for x in (uniq, uniq[counts > 1]))
            once.sort()
            twice.sort()
            for s in range(slices):
                o = once[np.searchsorted(once, s * per) : np.searchsorted(once, (s + 1) * per)] - s * per
                t = twice[np.searchsorted(twice, s * per) : np.searchsorted(twice, (s + 1) * per)] - s * per
                if len(o):
                    ints = {"range": int(rs[own[0]]), "slice": s, "part": part}
                    yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32()) for k, v in ints.items()} | {"once": [zlib.compress(_bitmap(o, per).tobytes(), 1)], "twice": [zlib.compress(_bitmap(t, per).tobytes(), 1)]})

    return build


def _merge(pdf):
    once = twice = None
    for o, t in zip(pdf["once"], pdf["twice"]):
        o, t = np.frombuffer(zlib.decompress(o), np.uint8), np.frombuffer(zlib.decompress(t), np.uint8)
        if once is None:
            once, twice = o.copy(), t.copy()
        else:
            twice |= t | (once & o)
            once |= o
    return pd.DataFrame({"range": [pdf["range"].iloc[0]], "slice": [pdf["slice"].iloc[0]], "part": [pdf["part"].iloc[0]], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})


def _merged(hashes: DataFrame, bits: int) -> DataFrame:
    """(range, slice, part, once, twice): the filters of (h, range), merged over all partitions, FAN_IN at a time."""
    parts = hashes.rdd.getNumPartitions()
    merged = hashes.mapInArrow(_builder(bits), _PARTIAL)
    while True:
        merged = merged.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("range", "slice", "part").applyInPandas(_merge, _PARTIAL)
        if parts <= FAN_IN:
            return merged
        parts = -(-parts // FAN_IN)


def _filter(merged: DataFrame, bits: int, which: str) -> np.ndarray:
    """One range's filter, as bytes."""
    per = min(bits, SLICE_BITS) // 8
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.select("slice", which).toLocalIterator():
        out[row[0] * per : (row[0] + 1) * per] = np.frombuffer(zlib.decompress(row[1]), np.uint8)
    return out


def _bits(rows: int) -> int:
    """Bits of a filter for so many rows: a power of two, at most RANGE_BITS."""
    return min(RANGE_BITS, max(1 << 12, 1 << (max(1, rows) * BITS_PER_ROW - 1).bit_length()))


def possible_repeats(digests: DataFrame, rows: int) -> DataFrame:
    """The rows of (sample_id, digest, h) whose digest may occur again: all that do, and few others. `rows`: at least their number."""
    spark = digests.sparkSession
    ranges = max(1, -(-rows * BITS_PER_ROW // RANGE_BITS))
    bits = _bits(-(-rows // ranges))
    ranged = digests.withColumn("range", F.pmod(F.xxhash64(F.lit(1), "digest"), F.lit(ranges)).cast("int") if ranges > 1 else F.lit(0))
    if ranges > 1:
        ranged = settle(ranged, partition_by=["range"])
    merged = _merged(ranged.select("h", "range"), bits)
    if ranges > 1:
        merged = settle(merged, partition_by=["range"])

    def probed(r: int) -> DataFrame:
        own, flt = (x.where(F.col("range") == r) if ranges > 1 else x for x in (ranged, merged))
        shared = spark.sparkContext.broadcast(_filter(flt, bits, "twice"))

        def probe(batches, shared=shared, bits=bits):
            for b in batches:
                yield b.filter(pa.array(_test(shared.value, b.column(2).to_numpy(zero_copy_only=False), bits)))

        got = settle(own.select("sample_id", "digest", "h").mapInArrow(probe, "sample_id long, digest binary, h long"))
        shared.unpersist()
        return got

    if ranges == 1:
        return probed(0)
    with ThreadPool(RANGES_AT_ONCE) as pool:
        return functools.reduce(DataFrame.unionByName, pool.map(probed, range(ranges)))


def copy_groups(samples: DataFrame) -> DataFrame:
    """(sample_id, first_id, copies) of the rows that have copies."""
    total = samples.count()
    maybe = possible_repeats(settle(canonical_digests(samples)), total)
    groups = maybe.groupBy("digest").agg(F.min("sample_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return skew_safe_lookup(maybe, settle(groups), "digest", "copies", total).select("sample_id", "first_id", "copies")


def found_copies(samples: DataFrame) -> DataFrame:
    """(first_id, copy_id): one row for each copy but the first, which has the smallest sample_id. Empty input gives no rows."""
    return copy_groups(samples).where("sample_id <> first_id").select("first_id", F.col("sample_id").alias("copy_id"))


def collapse(samples: DataFrame) -> DataFrame:
    """One row for each distinct record, all its columns and `n_copies`, how many rows it stands for.

    Rows that take no part (null label or code, no letter or digit) stay, with n_copies 1. An input column of that
    name is replaced. Rows without copies go straight from the scan to the result; only rows that a filter of the
    copies' ids lets through are joined with the copies, and so shuffled. The filter has at most RANGE_BITS bits: with
    more copies it lets more rows through.
    """
    spark = samples.sparkSession
    marks = settle(copy_groups(samples).select(F.col("sample_id").alias("__id"), F.col("first_id").alias("__first"), F.col("copies").alias("__copies")).distinct())
    bits = _bits(marks.count())
    ids = marks.select(F.xxhash64("__id").alias("h"), F.lit(0).alias("range"))
    shared = spark.sparkContext.broadcast(_filter(_merged(ids, bits), bits, "once"))

    @F.pandas_udf("boolean")
    def may_have_copies(h: pd.Series) -> pd.Series:
        return pd.Series(_test(shared.value, h.to_numpy(), bits))

    s = samples.drop("n_copies")
    hit = may_have_copies(F.xxhash64("sample_id"))
    alone = s.where(~hit).withColumn("n_copies", F.lit(1).cast("long"))
    met = s.where(hit)
    joined = met.join(marks, met["sample_id"] == marks["__id"], "left").where("__id is null or __id = __first")
    return alone.unionByName(joined.withColumn("n_copies", F.coalesce("__copies", F.lit(1)).cast("long")).drop("__id", "__first", "__copies"))
