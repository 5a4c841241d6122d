"""Language ID as multilingual mixture inference.

Each language is a distribution of hashed character trigrams. A document's words are draws from a mixture of
languages; expectation-maximisation estimates the proportions, and languages stay in the document's set only if
they raise the likelihood by more than a penalty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, text_column

BUCKETS = 1 << 15
#: Expected number of documents per language that the model is fitted on, chosen by a hash of the text, whole texts each.
SAMPLE = 2000
SMOOTH, ROUNDS = 0.5, 12
#: Bytes of characters without case or letters become a space; bytes over 127 are parts of letters here.
_FOLD = np.array([b if b > 127 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of each word with a space on both sides, in order, and where each word's begin."""
    raw = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    space = raw == 32
    raw = raw[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint32)  # one space between words
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(17)
    inner = raw[1:-1] != 32  # not the trigrams across two words
    return code[inner].astype(np.int64), np.flatnonzero(raw[:-2][inner] == 32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in rows_of(b, "lang", "text"):
            code, _ = grams(text)
            if lang not in total:
                total[lang] = np.zeros(BUCKETS, np.int64)
            total[lang] += np.bincount(code, minlength=BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at])], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log probability of each bucket in each, from lang and text without nulls.

    What comes to the driver is bounded by languages times buckets.
    """
    labelled = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, BUCKETS), np.float32)
    langs = sorted(sizes, key=lambda x: x.encode())
    rate = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))])
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit("fit"), "text"), F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30))
    table = chosen.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(langs), BUCKETS), SMOOTH)
    row = {k: i for i, k in enumerate(langs)}
    np.add.at(counts, ([row[x] for x in table["lang"].to_pylist()], table["bucket"].to_numpy()), table["n"].to_numpy())
    return langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def proportions(likely: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """EM: proportions and the log likelihood of words whose likelihoods, scaled, are the columns of `likely`."""
    share = start
    for _ in range(ROUNDS):
        joint = share[:, None] * likely
        total = joint.sum(0)
        new = (joint / total).mean(1)
        moved, share = np.abs(new - share).max(), new
        if moved < 1e-3:
            break
    return share, float(np.log(share @ likely).sum())


def mixture(text: str | None, log_p: np.ndarray) -> np.ndarray | None:
    """Proportions of a text's languages, zero for those outside its set; None if it has no letter."""
    if not text or not len(log_p) or not any(c.isalpha() for c in text):
        return None
    code, words = grams(text)
    if not len(words):  # letters that fold to nothing
        return np.full(len(log_p), 1 / len(log_p))
    word = np.add.reduceat(log_p[:, code], words, axis=1).astype(np.float64)
    single = word.sum(1)
    out = np.zeros(len(log_p))
    best = int(single.argmax())
    out[best] = 1.0
    if len(log_p) == 1:
        return out
    likely = np.maximum(np.exp(word - word.max(0)), 1e-30)
    level = float(word.max(0).sum())
    share, _ = proportions(likely, np.full(len(log_p), 1 / len(log_p)))
    # Nested sets in order of proportion; each more language must pay for its parameter and for words' dependence, and the
    # first that doesn't ends it.
    order = [best, *[int(k) for k in np.argsort(-share, kind="stable") if k != best]]
    penalty, score = 4 * np.log(len(words)), float(single[best])
    for n in range(2, len(order) + 1):
        chosen = order[:n]
        part, gain = proportions(likely[chosen], np.full(n, 1 / n))
        if gain + level - penalty <= score:
            break
        score = gain + level
        out[:] = 0
        out[chosen] = part
    return out


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, log_p = model.value
        for b in batches:
            lang, score = [], []
            for (text,) in rows_of(b, "text"):
                m = mixture(text, log_p)
                lang.append("und" if m is None else langs[int(m.argmax())])
                score.append(0.0 if m is None else float(min(1.0, m.max())))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the proportion of the predicted language).

    The model is fitted on documents whose crc32(doc_id as text) mod `folds` is not `held`, and the prediction sees the
    text alone. Null texts and texts without a letter are `und` with score 0, as is every text if nothing is
    labelled. A null id is not held out. Of languages with equal proportions the first by code point wins. Repeated
    rows are predicted alike, and other columns are ignored. Texts of any length are read whole, one word by the same rule as
    many; an empty table gives no rows. Two passes over the texts; no text is shuffled.
    """
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    model = fit(docs.where(~out).select("lang", F.col("text").cast("string").alias("text")), sample)
    slim = docs.select("doc_id", out.alias("held_out"), text_column().alias("text"))
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return slim.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(model)), schema)
