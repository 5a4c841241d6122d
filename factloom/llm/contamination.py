"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are few and short, documents many and of any length. Items are parted by their number of
shingles, and for each part documents are read in overlapping windows of a size in proportion to the part's, so
that an item and the window around it have a Jaccard similarity which one-row bands find almost surely.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WordIds, materialize, mix64, plain_word, rows_of, shingle_hashes, text_column, word_ids

#: Shingle size, containment, MinHash functions (bands of one row), ratio of the sizes in a part, window in units of the part's largest size.
WORDS, CONTAINMENT, HASHES, RATIO, SPAN = 5, 0.8, 64, 1.5, 3
_SEEDS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of shingles."""
    return np.concatenate([mix64(shingles[None, :] ^ _SEEDS[k : k + 16, None]).min(1) for k in range(0, HASHES, 16)])


def part_size(n: int) -> int:
    """The largest size of the part that holds items of n shingles."""
    return math.ceil(RATIO ** math.ceil(math.log(n, RATIO) - 1e-9))


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in the sorted, non-empty array."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Items:
    """A block of test items with what the search needs."""

    def __init__(self, rows: list[tuple[int, str]]):
        ids = WordIds(plain_word)
        self.items, self.parts = [], defaultdict(lambda: defaultdict(list))
        picked = []
        for item_id, text in rows:
            s = np.unique(shingle_hashes(word_ids(text, ids), WORDS))
            if len(s):
                sig = signature(s)
                for k, v in enumerate(sig.tolist()):
                    self.parts[part_size(len(s))][k, v].append(len(self.items))
                picked.append(s[np.argmin(mix64(s[None, :] ^ _SEEDS[:, None]), 1)])
                self.items.append((item_id, s))
        self.parts = {u: dict(bands) for u, bands in self.parts.items()}
        # A window collides with an item only where it holds a shingle that is the item's least under some function.
        self.picked = np.unique(np.concatenate(picked)) if picked else np.zeros(0, np.uint64)
        self.low = np.zeros(1 << 20, bool)
        self.low[self.picked & np.uint64((1 << 20) - 1)] = True

    def search(self, shingles: np.ndarray, containment: float) -> list[tuple[int, float]]:
        """item_id and containment of the items that a document's shingles contain."""
        at = np.flatnonzero(self.low[shingles & np.uint64((1 << 20) - 1)])
        at = at[among(shingles[at], self.picked)] if len(at) else at
        if not len(at):
            return []
        found = set()
        for u, bands in self.parts.items():
            touched = np.unique(np.concatenate([at // u - i for i in range(SPAN)]))
            for w in touched[touched >= 0]:
                for k, v in enumerate(signature(shingles[w * u : (w + SPAN) * u]).tolist()):
                    found.update(bands.get((k, v), ()))
            if len(shingles) < u:
                for k, v in enumerate(signature(shingles).tolist()):
                    found.update(bands.get((k, v), ()))
        if not found:
            return []
        whole, out = np.sort(shingles), []
        for i in sorted(found):
            item_id, s = self.items[i]
            if (share := among(s, whole).mean()) >= containment - 1e-9:
                out.append((item_id, float(share)))
        return out


def _searcher(block, containment: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, ids = block.value, WordIds(plain_word)
        for b in batches:
            rows = []
            for i, (text,) in enumerate(rows_of(b, "text")):
                s = shingle_hashes(word_ids(text, ids), WORDS)
                rows += [(i, item, share) for item, share in items.search(s, containment)] if len(s) else []
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(at), b["h"].take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["doc_id", "h", "item_id", "containment"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, h (hash of the text), item_id, containment: one row per document and test item of which it
    contains `containment` of the distinct five-word shingles or more.

    Words are compared in lower case without punctuation; a text of fewer words is one shingle; null and empty
    texts and texts without a letter or digit match nothing. Repeated rows match alike; repeated items give
    a row each. Other columns are ignored. Documents pass once per block of items, with no shuffle; a block is
    broadcast and bounded in bytes, so a large benchmark is searched in several blocks.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_column().alias("text"))
    n_bytes = bench.agg(F.sum(F.length("text") * 16 + HASHES * 100)).collect()[0][0] or 0
    blocks = max(1, math.ceil(n_bytes / BROADCAST_BYTES))
    slim = docs.select("doc_id", text_column().alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, h long, item_id long, containment double"
    out = None
    for k in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()  # a block, bounded
        found = slim.mapInArrow(_searcher(spark.sparkContext.broadcast(Items([tuple(r) for r in rows])), containment), schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """docs without the documents that contain a test item, in the columns of docs."""
    hit = materialize(find(docs, benchmark, containment).select(F.col("doc_id").alias("hid"), F.col("h").alias("hh")).distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_column()).alias("h"))
    return rows.join(hit, F.col("id").eqNullSafe(F.col("hid")) & (F.col("h") == F.col("hh")), "left_anti").select("row.*")
