"""Mixing sources to target weights, in DataFrame functions alone.

Tokens are summed per source, a target per source is derived by water-filling, and each
document is emitted floor(rate) times plus one copy with probability equal to the rate's
fraction, decided by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WORD, materialize, text_column


def size_of(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """source, source_size, target, rate of each source; `sizes` has source, size.

    Sources take the weights in turn, by code point and null last. They share share[0]/share[1]
    of all sizes by weight; a target stops at `most` times its source's size and the excess goes
    to the others by weight. In order of size per weight the sources that stop form a prefix, so
    two running sums find it and no loop is needed; sums are of whole numbers, so exact.
    The windows run over one row per source, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (turn % len(weights) + 1).cast("int")).cast("long"))
    before = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cap = F.col("source_size") * most
    # All in units of 1 / share[1], to stay in whole numbers.
    left = F.sum("source_size").over(every) * share[0] - F.coalesce(F.sum(cap).over(before), F.lit(0)) * share[1]
    weight_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    per = per.withColumn("stops", cap.cast("double") * share[1] * weight_left.cast("double") <= left.cast("double") * F.col("w"))
    free = F.sum("source_size").over(every) * share[0] - F.coalesce(F.sum(F.when(F.col("stops"), cap)).over(every), F.lit(0)) * share[1]
    free_weight = F.sum(F.when(~F.col("stops"), F.col("w"))).over(every)
    target = F.when(F.col("stops"), cap.cast("double")).otherwise(F.col("w").cast("double") * free.cast("double") / (free_weight * share[1]).cast("double"))
    per = per.withColumn("target", target)
    return per.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def coin(doc_id: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the id: the first 52 bits of an MD5, so that reruns and other engines agree."""
    hex13 = F.substring(F.md5(F.concat_ws("|", F.lit(seed), doc_id.cast("string"))), 1, 13)
    return F.conv(hex13, 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, seed: str = "mix", **rule) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies.

    Null text has size 0; a null source is a source of its own; null ids share a coin. Documents of
    size 0 get the copies of their source's rate and take no words. Repeated rows are documents
    like others, with the same coin. Other columns are ignored. An empty table gives no rows.
    A source can hold any share of the rows: sizes are summed before the shuffle, and the join with
    one row per source is broadcast or split by adaptive execution according to its actual size.
    """
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(text_column()).alias("size"))
    per = targets(slim, **rule).select(F.col("source").alias("s"), "source_size", "target", "rate")
    joined = slim.join(per, F.col("source").eqNullSafe(F.col("s")))
    copies = F.floor("rate") + (coin(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"))


def emit(docs: DataFrame, seed: str = "mix", **rule) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as the mix takes it, in the columns of docs.

    Rates are written first, one row per source, and broadcast where their size allows, so that texts aren't shuffled.
    """
    per = targets(docs.select(F.col("source").cast("string").alias("source"), size_of(text_column()).alias("size")), **rule)
    per = materialize(per.select(F.col("source").alias("s"), "rate"), "rates")
    n_bytes = per.agg(F.sum(F.coalesce(F.octet_length("s"), F.lit(0)) + 32)).collect()[0][0] or 0
    per = F.broadcast(per) if n_bytes <= BROADCAST_BYTES else per
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("src"), F.col("doc_id").alias("id"))
    copies = F.floor("rate") + (coin(F.col("id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    out = rows.join(per, F.col("src").eqNullSafe(F.col("s"))).select("row", copies.cast("int").alias("n"))
    return out.where("n > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("copy")).select("row.*")
