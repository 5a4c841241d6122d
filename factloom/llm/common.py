"""Shared pieces of the corpus operators: working tables, word hashing, row identity."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run without ASCII white space; bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Most bytes of a table that an operator broadcasts; above it the operator joins or works in blocks.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. A private one takes its place only where the
    driver is the only executor; on a cluster without the setting it's an error, as executors can't see each other's disks."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[[^,]*(,[0-9]+)?\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: lost executors don't recompute it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)  # small row groups: writers hold one each
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_column(name: str = "text"):
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def rows_of(batch, *names: str, step: int = 256):
    """Tuples of the columns of an Arrow batch, as Python values of a few rows at a time."""
    for k in range(0, len(batch), step):
        part = batch.slice(k, step)
        yield from zip(*(part[c].to_pylist() for c in names))


class WordIds(dict):
    """64-bit ids of words, remembered up to a bound."""

    def __init__(self, clean=None, bound: int = 400_000):
        super().__init__()
        self.clean, self.bound = clean, bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        w = self.clean(word) if self.clean else word
        got = self[word] = xxhash.xxh64_intdigest(w, 7) | 1 if w else 0
        return got


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer: shifts and odd multipliers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of word ids; of the whole sequence if it's shorter, of none if it's empty."""
    if not len(ids):
        return ids
    n = min(n, len(ids))
    out = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + len(out)]
    return mix64(out)


_MARKS = bytes(b for b in range(128) if not chr(b).isalnum())


def plain_word(word: bytes) -> bytes:
    """A word in lower case without what isn't a letter or digit."""
    if word.isascii():
        return word.lower().translate(None, _MARKS)
    w = word.decode("utf-8", "replace").lower()
    return (w if w.isalnum() else "".join(filter(str.isalnum, w))).encode()


def word_ids(text: str | None, ids: WordIds) -> np.ndarray:
    """Ids of a text's words, without words that have no letter or digit."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    out = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    return out[out != 0]
