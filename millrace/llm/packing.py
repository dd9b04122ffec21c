"""Filling containers of fixed capacity along a space-filling curve.

Each text becomes a vector of hashed words, projected to DIMS numbers by fixed weights, seven bits of each word's hash;
the Hilbert index of that point is its place on a curve on which like texts are neighbours. Texts are range-sorted by
it, into at most MOST_RANGES ranges, and each range packs its part of the curve in pieces of RANGE_TOKENS tokens: best
fit into the piece's containers that are still open, largest texts of a stretch first. A text longer than the capacity
is cut into full containers and a rest, which is packed like any other.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import settle, spread

DIMS, BITS = 4, 8
#: Tokens that are packed with each other; each piece of the curve leaves at most a few containers part empty.
RANGE_TOKENS = 4_000_000
#: Tasks of the range sort, at most; a task packs one piece after the other.
MOST_RANGES = 8192
#: Texts of the curve that are packed together, largest first.
STRETCH = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


_ENCODER: dict = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file that `measured` has sent to the executors."""
    if path not in _ENCODER:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _ENCODER[path] = tiktoken.Encoding("millrace", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODER[path]


def hilbert(point: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n, dims), by Skilling's transposition (2004)."""
    x = point.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[:, i] & q) != 0
            t = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] = np.where(on, x[:, i], x[:, i] ^ t)
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def curve_key(text: str) -> np.ndarray:
    """The text's point: DIMS sums of signs of its words, scaled to BITS bits each."""
    ws = text.lower().split() or [""]
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in ws), np.int64, len(ws))
    sums = [(((h >> (7 * d)) & 127) - 63.5).sum() for d in range(DIMS)]
    z = np.asarray(sums) / (np.sqrt(len(ws)) * 37.0)
    return np.clip((0.5 + z / 4) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def measured(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, tokens, curve) of every non-null text with at least one token. vocabulary: a file that the driver can read."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name

    def run(batches):
        enc = encoder(SparkFiles.get(name))
        for b in batches:
            keep = [(d, x) for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if x]
            if not keep:
                continue
            sizes = [len(enc.encode_ordinary(x)) for _, x in keep]
            keys = hilbert(np.stack([curve_key(x) for _, x in keep]))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in keep], pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "tokens", "curve"])

    return spread(documents.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, tokens long, curve long")


def pack_stretch(sizes: list[int], capacity: int, open_: list[tuple[int, int]], fresh) -> list[list[tuple[int, int, int]]]:
    """Pieces (container, start, tokens) of each text. open_: sorted (free, container); changed in place."""
    out: list[list] = [[] for _ in sizes]
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k] % capacity if sizes[k] > capacity else -sizes[k]):
        start, left = 0, sizes[k]
        while left > capacity:
            out[k].append((fresh(), start, capacity))
            start += capacity
            left -= capacity
        at = bisect_left(open_, (left, -1))
        free, box = open_.pop(at) if at < len(open_) else (capacity, fresh())
        out[k].append((box, start, left))
        if free > left:
            insort(open_, (free - left, box))
    return out


def pack(documents: DataFrame, limits: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(container, capacity_tokens, box, doc_id, piece, start_token, tokens): where each text, or piece of one, goes.

    container is the name in pack_limits; box identifies one container of that kind. Texts that are null or empty have
    no token and no place. A text within the capacity is one piece. Containers without a positive capacity are
    left out. Repeated doc_ids are packed as often as they occur.
    """
    vocabulary = vocabulary or VOCABULARY
    caps = [(r[0], int(r[1])) for r in limits.where("capacity_tokens > 0").select("container", "capacity_tokens").collect()]
    sized = settle(measured(documents, vocabulary))
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    ranges = max(1, min(MOST_RANGES, -(-total // RANGE_TOKENS)))
    lined = sized.repartitionByRange(ranges, "curve", F.xxhash64("doc_id")).sortWithinPartitions("curve", "doc_id")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        state = {name: [[], part << 40] for name, _ in caps}

        def stretch(rows):
            cols: list[list] = [[] for _ in range(7)]
            for name, cap in caps:
                st = state[name]

                def fresh(st=st):
                    st[1] += 1
                    return st[1] - 1

                for (d, n), pieces in zip(rows, pack_stretch([n for _, n in rows], cap, st[0], fresh)):
                    for i, (box, start, size) in enumerate(pieces):
                        for c, v in zip(cols, (name, cap, box, d, i, start, size)):
                            c.append(v)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["container", "capacity_tokens", "box", "doc_id", "piece", "start_token", "tokens"])

        held: list = []
        packed = 0
        for b in batches:
            held.extend(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            while len(held) >= STRETCH:
                packed += sum(n for _, n in held[:STRETCH])
                yield stretch(held[:STRETCH])
                held = held[STRETCH:]
                if packed >= RANGE_TOKENS:  # a new piece of the curve, with no container open
                    packed = 0
                    for st in state.values():
                        st[0].clear()
        if held:
            yield stretch(held)

    return lined.select("doc_id", "tokens").mapInArrow(run, "container string, capacity_tokens int, box long, doc_id long, piece int, start_token long, tokens long")


def pack_report(documents: DataFrame, limits: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(container, boxes, least_boxes, texts, tokens, fill_pct) for each kind of container; least_boxes if nothing were wasted."""
    p = pack(documents, limits, vocabulary)
    return p.groupBy("container", "capacity_tokens").agg(F.countDistinct("box").alias("boxes"), F.count_if(F.col("piece") == 0).alias("texts"), F.sum("tokens").alias("tokens")).select("container", "boxes", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_boxes"), "texts", "tokens", F.round(100 * F.col("tokens") / (F.col("boxes") * F.col("capacity_tokens")), 3).alias("fill_pct"))
