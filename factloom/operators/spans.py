"""Spans: exact and fuzzy verification of excerpts, and boxes of words on a page."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions.normalize import bound

#: Most bytes of excerpts that are broadcast at once.
BLOCK_BYTES = 8 << 20


def exact_span(excerpt: Column, text: Column) -> Column:
    """struct<start, end, status> of the first occurrence, [start, end); unverified for none and for empty sides."""
    at = F.instr(text, excerpt)
    ok = (F.length(excerpt) > 0) & (F.length(text) > 0) & (at > 0)
    return F.struct(F.when(ok, at - 1).alias("start"), F.when(ok, at - 1 + F.length(excerpt)).alias("end"), F.when(ok, F.lit("verified_exact")).otherwise(F.lit("unverified")).alias("status"))


def _grams(words: Column) -> Column:
    """Hashes of three words in a row; the words are bound, as a lambda would split the text again for each."""
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return bound(words, lambda w: F.when(F.size(w) >= 3, hashed(w)))


def exact_pairs(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, start, end, status of every pair of documents (doc_id, text) and items (item_id, excerpt), as exact_span() has them.

    Words of an excerpt but its first and last are words of any text that holds it. So excerpts of five words or more meet texts by
    the hash of their second to fourth word, and only these texts are searched; shorter excerpts are searched in all texts.
    What is broadcast comes in blocks bounded in bytes.
    """
    white = r"[\x20\x09-\x0D]+"
    it = items.select("item_id", "excerpt", F.xxhash64("excerpt").alias("eh"), F.split("excerpt", white).alias("w"))
    long = F.coalesce(F.size("w") >= 5, F.lit(False))
    sizes = it.agg(F.sum(F.when(~long, F.octet_length("excerpt") + 64)), F.count_if(long)).first()
    status = F.when(F.col("at") > 0, F.lit("verified_exact")).otherwise(F.lit("unverified"))
    span = [F.when(F.col("at") > 0, F.col("at") - 1).alias("start"), F.when(F.col("at") > 0, F.col("at") - 1 + F.col("n")).alias("end"), status.alias("status")]

    def block(rows: DataFrame, n_bytes: int) -> list[DataFrame]:
        blocks = max(1, math.ceil(n_bytes / block_bytes))
        return [rows.where(F.pmod(F.col("eh"), F.lit(blocks)) == k) for k in range(blocks)]

    d = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    grams = d.select("doc_id", "h", F.explode(F.array_distinct(_grams(F.split("text", white)))).alias("gram"))
    keyed = it.where(long).select("eh", "excerpt", F.xxhash64(F.get("w", F.lit(1)), F.get("w", F.lit(2)), F.get("w", F.lit(3))).alias("key")).distinct()
    met = reduce(DataFrame.unionByName, (grams.join(F.broadcast(x.select("eh", "key")), F.col("gram") == F.col("key")) for x in block(keyed, 32 * sizes[1])))
    met = met.select(F.col("doc_id").alias("md"), F.col("h").alias("mh"), "eh").distinct().join(keyed.select(F.col("eh").alias("ke"), "excerpt"), F.col("eh") == F.col("ke"))
    same = F.col("doc_id").eqNullSafe(F.col("md")) & (F.col("h") == F.col("mh"))
    found = d.join(met, same).select("doc_id", "h", "eh", F.instr(F.col("text"), F.col("excerpt")).alias("at")).where("at > 0").distinct()
    # A document's own places, by excerpt, come with it; pairs are made of ids alone.
    found = found.groupBy(F.col("doc_id").alias("md"), F.col("h").alias("mh")).agg(F.map_from_entries(F.collect_list(F.struct("eh", "at"))).alias("places"))
    base = d.select("doc_id", "h").join(found, same, "left").select("doc_id", "places")
    ids = it.where(long).select("item_id", "eh", F.length("excerpt").alias("n"))
    out = [base.crossJoin(F.broadcast(x)).select("doc_id", "item_id", "n", F.try_element_at("places", F.col("eh")).alias("at")) for x in block(ids, 32 * sizes[1])]
    for x in block(it.where(~long), sizes[0] or 0) if sizes[0] is not None else []:
        pairs = d.crossJoin(F.broadcast(x.select("item_id", "excerpt")))
        at = F.when((F.length("excerpt") > 0), F.instr(F.col("text"), F.col("excerpt")))
        out.append(pairs.select("doc_id", "item_id", F.length("excerpt").alias("n"), at.alias("at")))
    return reduce(DataFrame.unionByName, out).select("doc_id", "item_id", *span)


def _lcs_windows(short: str, long: str) -> tuple[float, int, int]:
    """Best normalized Indel similarity (2 LCS / lengths, in percent) of a string with the stretches of another, and the stretch.

    Stretches are as long as the short string, or shorter at the ends; bit-parallel LCS with one Python integer per
    stretch, on stretches that share enough letters to reach the threshold.
    """
    m = len(short)
    place: dict[str, int] = {}
    for i, c in enumerate(short):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << m) - 1
    codes = np.array([ord(c) for c in long])
    # Letters in common bound the LCS: count them for all stretches at once.
    common = np.zeros(len(long) + 1)
    ends = np.minimum(np.arange(1 - m, len(long)) + m, len(long))
    starts = np.maximum(np.arange(1 - m, len(long)), 0)
    bound = np.zeros(len(starts))
    for c in set(short):
        total = np.concatenate([[0], np.cumsum(codes == ord(c))])
        bound += np.minimum(total[ends] - total[starts], short.count(c))
    del common
    most = 200.0 * bound / (m + ends - starts)
    best = (0.0, 0, 0)
    for k in np.argsort(-most, kind="stable"):
        if most[k] <= best[0] or most[k] < vocab.FUZZY_SCORE:
            break
        a, b = int(starts[k]), int(ends[k])
        v = full
        for c in long[a:b]:
            u = v & place.get(c, 0)
            v = ((v + u) | (v - u)) & full
        score = 200.0 * (m - v.bit_count()) / (m + b - a)
        if score > best[0]:
            best = (score, a, b)
    return best


def _aligned(excerpt: str, text: str) -> tuple[float, int, int]:
    """Score and stretch of the text. An excerpt longer than the text is searched for the text, all of which is the stretch."""
    if len(excerpt) <= len(text):
        return _lcs_windows(excerpt, text)
    return _lcs_windows(text, excerpt)[0], 0, len(text)


def _fuzzy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [_aligned(e, t) for e, t in zip(b["excerpt"].to_pylist(), b["text"].to_pylist())]
        ok = [s >= vocab.FUZZY_SCORE for s, _, _ in out]
        cols = [pa.array([x[1] if k else None for x, k in zip(out, ok)], pa.int32()), pa.array([x[2] if k else None for x, k in zip(out, ok)], pa.int32()), pa.array(["verified_fuzzy" if k else "unverified" for k in ok])]
        yield pa.RecordBatch.from_arrays([b["id"], *cols], ["id", "start", "end", "status"])


def verify_spans(rows: DataFrame) -> DataFrame:
    """id, start, end, status of rows of id (string), excerpt, text. Exact search is native; only rows it misses reach Python."""
    r = rows.select("id", F.coalesce("excerpt", F.lit("")).alias("excerpt"), F.coalesce("text", F.lit("")).alias("text"))
    hit = (F.length("excerpt") > 0) & (F.length("text") > 0) & (F.instr(F.col("text"), F.col("excerpt")) > 0)
    empty = (F.length("excerpt") == 0) | (F.length("text") == 0)
    exact = r.where(hit | empty).withColumn("s", exact_span(F.col("excerpt"), F.col("text"))).select("id", "s.start", "s.end", "s.status")
    fuzzy = r.where(~hit & ~empty).mapInArrow(_fuzzy, "id string, start int, end int, status string")
    return exact.unionByName(fuzzy)


def normal_token(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def named_words(words: Column) -> Column:
    """The words that have a token."""
    return F.filter(words, lambda w: normal_token(w["text"]) != "")


def tokens_of(words: Column) -> Column:
    return F.filter(F.transform(words, lambda w: normal_token(w["text"])), lambda t: t != "")


def locate(rows: DataFrame, ratio: float = vocab.TOKEN_RATIO) -> DataFrame:
    """id, start, score, window: the earliest best place of an excerpt's tokens among a page's words.

    A sliding window is an equi-join within the row: words meet excerpt tokens that are equal, each meeting votes for
    the start it implies, and the earliest start with the most votes wins. Only votes are shuffled. Rows without a
    place are missing. Rows that have the `tokens` of their words already bring them.
    """
    words = F.col("tokens") if "tokens" in rows.columns else tokens_of(F.col("words"))
    excerpt = F.filter(F.transform(F.split("excerpt", r"(?U)\s+"), normal_token), lambda t: t != "")
    r = rows.select("id", words.alias("w"), excerpt.alias("e")).where((F.size("w") > 0) & (F.size("e") > 0))
    r = r.withColumn("n", F.size("w")).withColumn("window", F.size("e"))
    met = F.filter(F.transform("w", lambda t, i: F.struct(t.alias("t"), i.alias("pp"))), lambda x: F.array_contains("e", x["t"]))
    starts = F.filter(F.transform("e", lambda t, i: F.when(t == F.col("x.t"), F.col("x.pp") - i)), lambda v: v.isNotNull())
    votes = r.select("id", "n", "window", "e", F.explode(met).alias("x")).select("id", "n", "window", F.explode(starts).alias("start"))
    votes = votes.where((F.col("start") >= 0) & (F.col("start") <= F.greatest(F.col("n") - F.col("window"), F.lit(0)))).groupBy("id", "window", "start").agg(F.count("*").alias("score"))
    best = votes.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "start"))).where("place = 1")
    return best.where(F.col("score") / F.col("window") >= ratio).select("id", "start", F.col("score").cast("int").alias("score"), "window")


def boxes(words: Column, tolerance: float = vocab.LINE_TOLERANCE) -> Column:
    """Boxes of words by line, top to bottom: a word within the tolerance of its line's first word is on the line."""
    box = "array<struct<x0:double,top:double,x1:double,bottom:double>>"
    ordered = F.array_sort(F.transform(words, lambda w: F.struct(w["top"].alias("top"), w["x0"].alias("x0"), w["x1"].alias("x1"), w["bottom"].alias("bottom"))))
    start = F.struct(F.array().cast(box).alias("done"), F.lit(None).cast("double").alias("anchor"))

    def add(acc, w):
        last = F.get(acc["done"], F.size(acc["done"]) - 1)
        same = F.coalesce(F.abs(w["top"] - acc["anchor"]) <= tolerance, F.lit(False))
        grown = F.struct(F.least(last["x0"], w["x0"]).alias("x0"), F.least(last["top"], w["top"]).alias("top"), F.greatest(last["x1"], w["x1"]).alias("x1"), F.greatest(last["bottom"], w["bottom"]).alias("bottom"))
        one = F.struct(w["x0"].alias("x0"), w["top"].alias("top"), w["x1"].alias("x1"), w["bottom"].alias("bottom"))
        done = F.when(same, F.concat(F.slice(acc["done"], 1, F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc["done"], F.array(one)))
        return F.struct(done.alias("done"), F.when(same, acc["anchor"]).otherwise(w["top"]).alias("anchor"))

    rounded = lambda b: F.struct(*[F.round(b[k], 2).alias(k) for k in ("x0", "top", "x1", "bottom")])
    return F.aggregate(ordered, start, add, lambda acc: F.transform(acc["done"], rounded))


def locate_boxes(rows: DataFrame) -> DataFrame:
    """id, source_bbox of rows of id, excerpt, words; null where the excerpt has no place. With `tokens`, words are those that have one."""
    kept = F.col("words") if "tokens" in rows.columns else named_words(F.col("words"))
    placed = rows.join(locate(rows).hint("merge"), "id", "left")  # places are as many as rows, whatever the planner takes them for
    found = boxes(F.slice(kept, F.col("start") + 1, F.col("window")))
    return placed.select("id", F.when(F.col("start").isNotNull(), found).alias("source_bbox"))
