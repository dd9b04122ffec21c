"""Same or near-same records across splits: join of canonical hashes, of whole records and of their word runs.

Records are canonicalised (words only, lower case), so spacing, punctuation and case do not count. For near copies the
join runs over hashed runs of three words. Two sets of runs with a share t of their union in common have at least the
share t of each side in common, so most rows of the larger side are dismissed where they are read: a Bloom filter of
the evaluation side's runs shows that too few of theirs occur there at all. What is left, on both sides, is collapsed
into classes of equal sets (whole records that are equal stand for all their copies), and every run gets its exact
count of classes on either side. Put rarest first, two sets that reach t must agree in one of the first
|x| - ceil(t |x|) + 1 runs of each; the positions of what they agree in bound what else they can have in common, and
pairs within that bound are counted exactly. No pair is lost at any step.

The evaluation side is the stated query set: if it has more runs than one filter holds, it is taken in blocks.
"""

from __future__ import annotations

import math
import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import settle, skew_safe_lookup, spread
from .canonical import BITS_PER_ROW, RANGE_BITS, _bits, _filter, _merged, _test
from .leakage import window_keys

THRESHOLD = 0.6
RUN = 3
#: Rows of one key that one task of a join gets; keys with more are cut into parts.
ROWS_A_PART = 20_000

_WORD = re.compile(rb"[a-z0-9_]+")
_SETS = "id long, sig binary, canon binary, n int, runs array<long>"


def words(code: str) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and underscores, lower-cased."""
    return _WORD.findall(code.encode("utf-8", "surrogatepass").lower())


class _Hashes(dict):
    """Hash of each word seen; forgets all when it holds too many."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        got = self[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
        return got


_HASHES = _Hashes()


def _needed(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def _sets(df: DataFrame, run: int, threshold: float = 0.0, known: tuple | None = None) -> DataFrame:
    """(id, sig, canon, n, runs) of the rows of (id, code) that have a run: digests of the set and of all words, and the set.

    known: (broadcast filter, bits). Then rows of which too few runs pass the filter are left out, and n counts all
    runs while runs holds those that pass.
    """

    def build(batches):
        known_words = _HASHES
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if code is None:
                    continue
                ws = words(code)
                if len(ws) < run:
                    continue
                runs = np.unique(window_keys(np.array([known_words[w] for w in ws], np.uint64), run).view(np.int64))
                kept = runs
                if known is not None:
                    kept = runs[_test(known[0].value, runs, known[1])]
                    if len(kept) < _needed(len(runs), threshold):
                        continue
                for c, v in zip(out, (i, blake2b(runs.tobytes(), digest_size=16).digest(), blake2b(b" ".join(ws), digest_size=16).digest(), len(runs), kept)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int32()), _lists(out[4])], ["id", "sig", "canon", "n", "runs"])

    return spread(df.select(F.col("id").cast("long"), "code")).mapInArrow(build, _SETS)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def _filter_of_runs(sets: DataFrame, runs: int):
    bits = _bits(runs)
    merged = _merged(sets.select(F.explode("runs").alias("h"), F.lit(0).alias("range")), bits)
    return sets.sparkSession.sparkContext.broadcast(_filter(merged, bits, "once")), bits


def _thinned(sets: DataFrame, threshold: float, known: tuple) -> DataFrame:
    """Sets whose runs pass a filter often enough, with those runs only."""

    def thin(batches):
        for b in batches:
            runs = b.column("runs")
            flat = runs.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            hit = _test(known[0].value, flat, known[1])
            keep, kept = [], []
            for k, n in enumerate(b.column("n").to_pylist()):
                own = flat[ends[k] : ends[k + 1]][hit[ends[k] : ends[k + 1]]]
                if len(own) >= _needed(n, threshold):
                    keep.append(k)
                    kept.append(own)
            t = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(t.column(i) for i in range(4)), _lists(kept)], ["id", "sig", "canon", "n", "runs"])

    return sets.mapInArrow(thin, _SETS)


def _classes(sets: DataFrame) -> DataFrame:
    """(sig, n, runs, rows): sets that are equal are one class."""
    return settle(sets.groupBy("sig").agg(F.first("n").alias("n"), F.first("runs").alias("runs"), F.count("*").alias("rows")))


def _parts(rows):
    """Into how many parts a key of so many rows is cut."""
    return F.ceil(rows / ROWS_A_PART).cast("int")


def _prefixes(priced: DataFrame, threshold: float) -> DataFrame:
    """(sig, h, n, m, at, l, r): the first runs of each class, rarest first. m: its runs that both sides have; at: place among them."""
    listed = priced.groupBy("sig").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct((F.col("l") * F.col("r")).alias("price"), "h", "l", "r"))).alias("hs"))
    need = F.greatest(F.lit(1), F.ceil(threshold * F.col("n") - 1e-9))
    m = F.size("hs")
    # runs that only one side has come first in the order and join nothing
    take = (m - need + 1).cast("int")
    kept = listed.where(m >= need).select("sig", "n", m.alias("m"), F.posexplode(F.slice("hs", F.lit(1), take)).alias("at", "e"))
    return kept.select("sig", F.col("e.h").alias("h"), "n", "m", "at", F.col("e.l").alias("l"), F.col("e.r").alias("r"))


def _joined_classes(lc: DataFrame, rc: DataFrame, threshold: float) -> DataFrame:
    """(l, r, common, union_size) of the pairs of classes that reach the threshold."""
    le, re_ = (c.select("sig", "n", F.explode("runs").alias("h")) for c in (lc, rc))
    both = le.select("h", F.lit(1).alias("l"), F.lit(0).alias("r")).union(re_.select("h", F.lit(0).alias("l"), F.lit(1).alias("r")))
    freq = settle(both.groupBy("h").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where("l > 0 and r > 0"))
    total = freq.agg(F.sum("l"), F.sum("r")).first()
    l, r = (_prefixes(skew_safe_lookup(e, freq, "h", w, t or 0), threshold) for e, w, t in ((le, "l", total[0]), (re_, "r", total[1])))
    # a run of many left classes is cut into parts, to each of which the right classes go
    k = _parts(F.col("l"))
    left = l.select(F.col("sig").alias("ls"), "h", F.col("n").alias("ln"), F.col("m").alias("lm"), F.col("at").alias("la"), F.pmod(F.xxhash64("sig"), k).cast("int").alias("part"))
    right = r.select(F.col("sig").alias("rs"), "h", F.col("n").alias("rn"), F.col("m").alias("rm"), F.col("at").alias("ra"), F.explode(F.sequence(F.lit(0), k - 1)).alias("part"))
    met = left.join(right, ["h", "part"]).where(F.expr(f"least(ln, rn) >= {threshold} * greatest(ln, rn) - 1e-9"))
    # what both have beyond the last run they agree in is bounded by what is left of either
    near = met.groupBy("ls", "rs").agg(F.count("*").alias("c"), F.max("la").alias("la"), F.max("ra").alias("ra"), *(F.first(x).alias(x) for x in ("ln", "rn", "lm", "rm")))
    most = F.col("c") + F.least(F.col("lm") - F.col("la"), F.col("rm") - F.col("ra")) - 1
    near = near.where(most * (1 + threshold) >= threshold * (F.col("ln") + F.col("rn")) - 1e-6).select("ls", "rs", "ln", "rn")
    x = near.join(lc.select(F.col("sig").alias("ls"), F.col("runs").alias("a")), "ls").join(rc.select(F.col("sig").alias("rs"), F.col("runs").alias("b")), "rs")
    x = x.withColumn("common", F.size(F.array_intersect("a", "b"))).withColumn("union_size", F.col("ln") + F.col("rn") - F.col("common"))
    return x.where(F.col("common") >= threshold * F.col("union_size") - 1e-9).select(F.col("ls").alias("l"), F.col("rs").alias("r"), "common", "union_size")


def similar_classes(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD, run: int = RUN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs: l, r, common, union_size, l_rows, r_rows; left members: id, sig, canon, rows; right members: the same).

    All pairs of classes of equal sets of runs, of (id, code) on both sides, that share `threshold` of their union, with
    how many rows each class has; and which row is in which class. Copies are not expanded. Rows that are in no pair
    may be left out of the members. Null codes, and codes with fewer than `run` words, are in nothing; empty tables
    give no rows. Codes of any length are read whole. `right` is the smaller side and is taken in blocks if it is large.
    """
    every = settle(_sets(right, run))
    runs = every.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-runs * BITS_PER_ROW // RANGE_BITS))
    out = None
    for k in range(blocks):
        own = every if blocks == 1 else every.where(F.pmod(F.xxhash64("sig"), F.lit(blocks)) == k)
        known = _filter_of_runs(own, -(-runs // blocks))
        ls = settle(_sets(left, run, threshold, known))
        known[0].unpersist()
        found = _filter_of_runs(ls, ls.agg(F.sum(F.size("runs"))).first()[0] or 0)
        rs = settle(_thinned(own, threshold, found))
        found[0].unpersist()
        lc, rc = _classes(ls), _classes(rs)
        pairs = _joined_classes(lc, rc, threshold)
        size = lambda c, a, b: c.select(F.col("sig").alias(a), F.col("rows").alias(b))
        pairs = settle(pairs.join(size(lc, "l", "l_rows"), "l").join(size(rc, "r", "r_rows"), "r"))
        members = [skew_safe_lookup(s.select("id", "sig", "canon"), c.select("sig", "rows"), "sig", "rows", s.count()) for s, c in ((ls, lc), (rs, rc))]
        got = (pairs.select("l", "r", "common", "union_size", "l_rows", "r_rows"), *(m.select("id", "sig", "canon", "rows") for m in members))
        # a left row may meet several blocks
        out = got if out is None else (out[0].unionByName(got[0]), out[1].unionByName(got[1]), out[2].unionByName(got[2]))
    return out if blocks == 1 else (out[0], out[1].distinct(), out[2])


def _expanded(pairs: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """Pairs of classes with the rows of one side; classes of many rows are cut into parts, to each of which their pairs go."""
    k = _parts(F.col("rows"))
    m = members.select(F.col("id").alias(name), F.col("sig").alias(key), F.pmod(F.xxhash64("id"), k).cast("int").alias("part"))
    return pairs.withColumn("part", F.explode(F.sequence(F.lit(0), _parts(F.col(f"{key}_rows")) - 1))).join(m, [key, "part"]).drop("part")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD, run: int = RUN) -> DataFrame:
    """(left_id, right_id, common, union_size) of all pairs of rows: the pairs of `similar_classes`, expanded."""
    pairs, lm, rm = similar_classes(left, right, threshold, run)
    return _expanded(_expanded(pairs, lm, "l", "left_id"), rm, "r", "right_id").select("left_id", "right_id", "common", "union_size")


def _side(df: DataFrame) -> DataFrame:
    return df.select(F.col("row_id").alias("id"), "code")


def found_overlaps(train: DataFrame, valid: DataFrame, test: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first: all pairs of a training row and an evaluation row that are equal or nearly so."""
    p = similar_pairs(_side(train), _side(valid).unionByName(_side(test)))
    return p.select(F.least("left_id", "right_id").alias("id_a"), F.greatest("left_id", "right_id").alias("id_b")).distinct()


def overlap_report(train: DataFrame, valid: DataFrame, test: DataFrame) -> DataFrame:
    """(split, source, exact, near, leaked_rows) per evaluation split and metadata.source ('unknown' where null).

    exact: pairs whose words are the same, in order; near: other pairs; leaked_rows: evaluation rows in any pair. Pairs
    are counted by class, without expanding copies. Ids are unique over the three tables.
    """
    ev = valid.select(F.col("row_id").alias("id"), "code", "metadata.source", F.lit("valid").alias("split")).unionByName(test.select(F.col("row_id").alias("id"), "code", "metadata.source", F.lit("test").alias("split")))
    pairs, lm, rm = similar_classes(_side(train), ev.select("id", "code"))
    named = ev.select("id", "split", F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source"))
    copies = lm.groupBy("canon").agg(F.count("*").alias("same"))
    partners = pairs.groupBy(F.col("r").alias("sig")).agg(F.sum("l_rows").alias("pairs"))
    rows = rm.join(partners, "sig").join(copies, "canon", "left").select("id", "pairs", F.coalesce("same", F.lit(0)).alias("same"))
    j = rows.join(named, "id")
    return j.groupBy("split", "source").agg(F.sum("same").alias("exact"), F.sum(F.col("pairs") - F.col("same")).alias("near"), F.count("*").alias("leaked_rows"))
