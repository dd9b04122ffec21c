"""Evaluation texts leaking into training text: SimHash of windows, Hamming blocks, weighted shingle similarity.

One pass over the documents finds both kinds of leak:

* unbroken: SPAN successive words of an item (SPAN_CJ for zh and ja), the same and in order;
* changed: NEAR_SPAN words of an item of which some have been changed, dropped or added.

Every window of an item has a 64-bit SimHash of its words, and so has every window of every document. Windows within
`radius` bits of each other are candidates; a candidate counts if its word shingles, weighted by how few items have
them, have a share of `similarity` in common. Unbroken windows are the case of radius 0, decided by the words themselves.

Fingerprints within the radius agree in one of radius + 1 blocks; if those would be short, in one of half as many but
for one bit. Evaluation items are the stated query set: their windows are broadcast in blocks of BLOCK_WINDOWS, about
70 bytes each; longer items are cut into pieces that overlap by a window. Tables of their blocks are made by each worker.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread

SPAN, SPAN_CJ = 12, 24
BLOCK_WINDOWS = 500_000
#: Words of a window, bits of radius, words of a shingle and similarity for passages with changed words.
NEAR_SPAN, NEAR_RADIUS, NEAR_SHINGLE, NEAR_SIMILARITY = 32, 7, 2, 0.7
#: Pairs of windows that are compared at once.
PAIRS_AT_ONCE = 1 << 20
#: Pairs whose shingles are compared at once.
ALIKE_AT_ONCE = 1 << 13
#: Words whose windows are hashed at once, of one long text or many short ones; bounds memory for texts of any length.
CHUNK_WORDS = 1 << 16
#: Bits of a table's index; blocks of more bits are folded.
CELL_BITS = 16

_WORD = re.compile("[぀-ヿ㐀-鿿]|[^\\W_぀-ヿ㐀-鿿]+")
_CACHE: dict[str, int] = {}


def words(text: str) -> list[str]:
    """Runs of letters and digits, case folded; each Chinese character or kana is a word of its own."""
    return _WORD.findall(text.lower())


def word_hashes(ws: list[str]) -> np.ndarray:
    if len(_CACHE) > 500_000:
        _CACHE.clear()
    out = np.empty(len(ws), np.uint64)
    for i, w in enumerate(ws):
        h = _CACHE.get(w)
        if h is None:
            h = _CACHE[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        out[i] = h
    return out


def running_bits(h: np.ndarray, most: int) -> np.ndarray:
    """How often each bit is set in the words before each place, counted in lanes that hold differences up to `most`.

    Eight lanes of a byte (two of four bytes, if windows are long) share a 64-bit number. Sums run over, but the
    difference of two places is right in every lane, as a window's own counts fit.
    """
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = (bits if most < 256 else bits.astype(np.uint32)).view(np.uint64)
    run = np.zeros((len(h) + 1, lanes.shape[1]), np.uint64)
    np.cumsum(lanes, axis=0, out=run[1:])
    return run


def simhashes(run: np.ndarray, span: int) -> np.ndarray:
    """SimHash of each window of `span` words, of the words' running bits."""
    counts = (run[span:] - run[:-span]).view(np.uint8 if run.shape[1] == 8 else np.uint32).reshape(-1, 64)
    return np.packbits(counts > span // 2, axis=1, bitorder="little").view(np.uint64).ravel()


def simhash_windows(h: np.ndarray, span: int) -> np.ndarray:
    """SimHash of each window of `span` word hashes: bit b is set if more than half of its words have bit b."""
    return simhashes(running_bits(h, span), span) if len(h) >= span else np.empty(0, np.uint64)


def window_keys(h: np.ndarray, span: int) -> np.ndarray:
    """A hash of each window that depends on its words and their order, for the exact check."""
    if len(h) < span:
        return np.empty(0, np.uint64)
    n = len(h) - span + 1
    out = np.zeros(n, np.uint64)
    for k in range(span):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (h[k : k + n] * np.uint64(2 * k + 0xD6E8FEB86659FD93))
        out ^= out >> np.uint64(29)
    return out


def blocks(fp: np.ndarray, radius: int) -> list[np.ndarray]:
    """radius + 1 disjoint parts of each fingerprint."""
    return [(fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in _cuts(radius + 1)]


def _cuts(parts: int) -> list[tuple[int, int]]:
    cuts = [64 * k // parts for k in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def _cells(block: np.ndarray, bits: int) -> np.ndarray:
    if bits > CELL_BITS:
        block = (block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CELL_BITS)
    return block.astype(np.int32)


class Chunk:
    """Successive words of one or more texts, with what their windows of any span have in common."""

    def __init__(self, h: np.ndarray, text: np.ndarray, starts: int, reach: int):
        """h: word hashes; text: each word's text; only windows that start in the first `starts` words are the chunk's."""
        self.h, self.text, self.starts = h, text, starts
        self.run = running_bits(h, reach)

    def windows(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, SimHash) of the windows that lie within a text."""
        n = min(self.starts, len(self.h) - span + 1)
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.text[:n] == self.text[span - 1 : span - 1 + n])
        return at, simhashes(self.run[: n + span], span)[at]


def chunks(texts: list[np.ndarray], reach: int):
    """Chunks of texts, each given by its word hashes, in which each window of up to `reach` words is once."""
    h = np.concatenate([np.empty(0, np.uint64), *texts])
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in texts])
    for start in range(0, len(h), CHUNK_WORDS):
        end = start + CHUNK_WORDS + reach - 1
        yield Chunk(h[start:end], text[start:end], CHUNK_WORDS, reach)


class Index:
    """Windows of items, by span; immutable, and small enough to broadcast."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], radius: int, similarity: float = 1.0, shingle: int = NEAR_SHINGLE):
        """items: (item_id, word hashes, span)."""
        self.radius, self.similarity, self.shingle = radius, similarity, shingle
        parts: dict[int, list] = {}
        for item, h, span in items:
            if len(h) >= span:
                parts.setdefault(span, []).append((item, h))
        self.spans = {
            span: {
                "fp": np.concatenate([simhash_windows(h, span) for _, h in ps]),
                "words": np.concatenate([h for _, h in ps]),
                "start": np.concatenate([a + np.arange(len(h) - span + 1) for a, (_, h) in zip(np.cumsum([0, *(len(h) for _, h in ps[:-1])]), ps)]).astype(np.int32),
                "item": np.concatenate([np.full(len(h) - span + 1, i, np.int64) for i, h in ps]),
            }
            for span, ps in parts.items()
        }
        self.reach = max(self.spans, default=1)
        self.most = float(np.log1p(len({i for i, _, _ in items})))
        self.known, self.weight = np.empty(0, np.uint64), np.empty(0)
        if similarity < 1 and items:
            has = [window_keys(h, shingle) for _, h, _ in items]
            keys, item = np.concatenate(has), np.repeat(np.array([i for i, _, _ in items]), [len(k) for k in has])
            order = np.lexsort((item, keys))
            keys, item = keys[order], item[order]
            once = np.ones(len(keys), bool)
            once[1:] = (keys[1:] != keys[:-1]) | (item[1:] != item[:-1])
            self.known, n = np.unique(keys[once], return_counts=True)
            self.weight = np.log1p(len({i for i, _, _ in items}) / n)
        #: blocks, and in how many bits a block may differ
        self.parts, self.slack = (radius + 1, 0) if radius <= 3 else (max(4, (radius + 2) // 2), 1)

    def tables(self, ix: dict) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block (first window of each cell, windows): item windows by all values of the block that count as theirs."""
        if "tables" not in ix:
            made = []
            for (a, b), block in zip(_cuts(self.parts), blocks(ix["fp"], self.parts - 1)):
                flips = [0, *(1 << k for k in range(b - a) if self.slack)]
                cell = np.concatenate([_cells(block ^ np.uint64(f), b - a) for f in flips])
                order = (np.argsort(cell, kind="stable") % len(block)).astype(np.int32)
                first = np.zeros((1 << CELL_BITS) + 1, np.int32)
                np.cumsum(np.bincount(cell, minlength=1 << CELL_BITS), out=first[1:])
                made.append((first, order))
            ix["tables"] = made
        return ix["tables"]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"spans": {s: {k: v for k, v in ix.items() if k not in ("tables", "shingles")} for s, ix in self.spans.items()}}

    def candidates(self, fp: np.ndarray, ix: dict):
        """(document windows, item windows) within the radius, a slice at a time; each pair comes once."""
        cuts = _cuts(self.parts)
        for part, ((a, b), block, (first, order)) in enumerate(zip(cuts, blocks(fp, self.parts - 1), self.tables(ix))):
            cell = _cells(block, b - a)
            lo = first[cell]
            n = first[cell + 1] - lo
            own = np.flatnonzero(n)
            lo, n = lo[own], n[own]
            ends = np.cumsum(n)
            at = 0
            while at < len(own):
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + PAIRS_AT_ONCE, "right")))
                m = n[at:to]
                doc = np.repeat(own[at:to], m)
                item = order[np.arange(before, int(ends[to - 1])) + np.repeat(lo[at:to] - (ends[at:to] - m), m)]
                at = to
                apart = fp[doc] ^ ix["fp"][item]
                near = np.flatnonzero(np.bitwise_count(apart) <= self.radius)
                doc, item, apart = doc[near], item[near], apart[near]
                # folded blocks may meet without being alike, but then another block is; a pair belongs to its first
                same = [np.bitwise_count(x) <= self.slack for x in blocks(apart, self.parts - 1)[: part + 1]]
                mine = same[part] & ~np.any(same[:part], axis=0) if part else same[part]
                yield doc[mine], item[mine]

    def search(self, chunk: Chunk, found: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """Further (text, item_id) of which the chunk holds a whole window, or one as similar as wanted."""
        out: set[tuple[int, int]] = set()
        shingles = self.numbers(window_keys(chunk.h, self.shingle)) if self.similarity < 1 and self.spans else None
        for span, ix in self.spans.items():
            first, fp = chunk.windows(span)
            for doc, item in self.candidates(fp, ix):
                at, start = first[doc], ix["start"][item]
                hit = self.alike(shingles, at, ix, start, span) >= self.similarity if shingles else np.zeros(len(at), bool)
                same = np.flatnonzero(~hit)
                for k in range(span):
                    same = same[chunk.h[at[same] + k] == ix["words"][start[same] + k]]
                hit[same] = True
                out.update(zip(chunk.text[at[hit]].tolist(), ix["item"][item[hit]].tolist()))
        return out - found

    def alike(self, shingles: tuple[np.ndarray, np.ndarray], at: np.ndarray, ix: dict, start: np.ndarray, span: int) -> np.ndarray:
        """For pairs of windows, the weighted share of their shingles that both have; what no item has weighs most.

        shingles: `numbers` of the document's.
        """
        a, weight = shingles
        if "shingles" not in ix:
            # those across two items are in no window, whatever their number
            ix["shingles"] = np.searchsorted(self.known, window_keys(ix["words"], self.shingle))
        b = ix["shingles"]
        out = np.empty(len(at))
        each = np.arange(span - self.shingle + 1)
        for k in range(0, len(at), ALIKE_AT_ONCE):
            one = slice(k, k + ALIKE_AT_ONCE)
            # a shingle's occurrences in the document's window come before those in the item's
            z = np.concatenate([a[at[one, None] + each] * 2, b[start[one, None] + each] * 2 + 1], axis=1)
            z.sort(axis=1)
            w = weight[z >> 1]
            both = (w[:, 1:] * ((z[:, 1:] == z[:, :-1] + 1) & (z[:, 1:] & 1 == 1))).sum(axis=1)
            either = w[:, 0] + (w[:, 1:] * (z[:, 1:] >> 1 != z[:, :-1] >> 1)).sum(axis=1)
            out[one] = both / np.maximum(either, 1e-12)
        return out

    def numbers(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each shingle, its place in `known` if an item has it, and the weights of all numbers."""
        number = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        new = np.flatnonzero(self.known[number] != keys)
        others, place = np.unique(keys[new], return_inverse=True)
        number[new] = len(self.known) + place
        return number, np.concatenate([self.weight, np.full(len(others), self.most)])

    def find(self, h: np.ndarray) -> set[int]:
        """Items of which the word hashes h hold a whole window, or one as similar as wanted."""
        found: set[tuple[int, int]] = set()
        for chunk in chunks([h], self.reach):
            found |= self.search(chunk, found)
        return {item for _, item in found}


def _span(lang: str | None) -> int:
    return SPAN_CJ if (lang or "").strip().lower() in ("zh", "ja") else SPAN


def item_blocks(items: DataFrame, size: int = BLOCK_WINDOWS, reach: int = 1):
    """Blocks of (item_id, word hashes, span) with at most `size` words each.

    Longer items come in pieces that overlap by a word less than the span, or than `reach` if that is more.
    """
    block: list[tuple] = []
    held = 0
    for r in items.where("text is not null").select("item_id", "text", "lang").toLocalIterator():
        h, n = word_hashes(words(r["text"])), _span(r["lang"])
        over = max(n, reach) - 1
        step = max(1, size - over)
        for at in range(0, max(1, len(h) - over), step):
            piece = h[at : at + step + over]
            if block and held + len(piece) > size:
                yield block
                block, held = [], 0
            block.append((r["item_id"], piece, n))
            held += len(piece)
    if block:
        yield block


def leaks_of(texts: list[np.ndarray], whole: Index, near: Index) -> list[tuple[int, int, bool]]:
    """(text, item_id, unbroken), texts given by word hashes."""
    unbroken: set[tuple[int, int]] = set()
    changed: set[tuple[int, int]] = set()
    for chunk in chunks(texts, max(whole.reach, near.reach)):
        unbroken |= whole.search(chunk, unbroken)
        changed |= near.search(chunk, unbroken | changed)
    return sorted([(*p, True) for p in unbroken] + [(*p, False) for p in changed - unbroken])


def leaks(documents: DataFrame, items: DataFrame, radius: int = NEAR_RADIUS, similarity: float = NEAR_SIMILARITY, span: int = NEAR_SPAN, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """(doc_id, item_id, unbroken) of documents that hold a passage of an item, whatever lies between its words.

    unbroken: the document has SPAN (SPAN_CJ for zh and ja) successive words of the item. If not, `span` words of it
    occur with some of them changed. Items shorter than a span have no case of its kind, and null texts on either side
    have none; texts are read whole; each pair of ids comes once. Items in more than one block are weighed by their own.
    """
    if shingle > span:
        raise ValueError("a window holds no shingle")
    spark = documents.sparkSession
    out = None
    for block in item_blocks(items, reach=span):
        shared = spark.sparkContext.broadcast((Index(block, 0), Index([(i, h, span) for i, h, _ in block], radius, similarity, shingle)))

        def scan(batches, shared=shared):
            whole, near = shared.value
            ids, texts, held = [], [], 0

            def rows():
                got = leaks_of(texts, whole, near)
                columns = [pa.array([ids[t] for t, _, _ in got], pa.int64()), pa.array([i for _, i, _ in got], pa.int64()), pa.array([u for _, _, u in got], pa.bool_())]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "unbroken"])

            for b in batches:
                for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if text:
                        ids.append(d)
                        texts.append(word_hashes(words(text)))
                        held += len(texts[-1])
                        if held >= CHUNK_WORDS:
                            yield rows()
                            ids, texts, held = [], [], 0
            yield rows()

        part = spread(documents.select(F.col("doc_id").cast("long"), "text")).mapInArrow(scan, "doc_id long, item_id long, unbroken boolean")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return documents.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("item_id"), F.lit(True).alias("unbroken")).limit(0)
    return out.groupBy("doc_id", "item_id").agg(F.max("unbroken").alias("unbroken"))


def found_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the `leaks` that are unbroken."""
    return leaks(documents, items).where("unbroken").select("doc_id", "item_id")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, n_docs): in how many documents each item that leaked unbroken occurs."""
    return found_leaks(documents, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))
