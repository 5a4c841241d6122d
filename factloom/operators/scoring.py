"""Scoring deals against mandates, with full traces, and conflicts among facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import python_float


def weights(criteria: DataFrame) -> DataFrame:
    """Criteria with `share`: the weight over the mandate's sum, equal shares if that isn't positive."""
    w = W.partitionBy("mandate_id", "mandate_version")
    total = F.sum("weight").over(w)
    return criteria.withColumn("share", F.when(total <= 0, F.lit(1.0) / F.count("*").over(w)).otherwise(F.col("weight") / total))


def text_of(facts_text: Column, value: Column) -> Column:
    return F.coalesce(F.nullif(facts_text, F.lit("")), F.lower(value))


def matches(facts: DataFrame, criteria: DataFrame) -> DataFrame:
    """Facts with each criterion they can answer: claim type equal, the subtype within the fact's, units equal for numbers.

    Criteria are a handful of rows of a mandate, checked against the limit, and are broadcast, so facts don't move.
    """
    c = criteria.select(*[F.col(x).alias(f"c_{x}") for x in ("mandate_id", "mandate_version", "pos", "claim_type", "claim_subtype", "operator", "threshold_num", "threshold_text", "threshold_list", "threshold_unit")])
    small = criteria.count() <= 10_000
    scope = F.col("c_claim_subtype").isNull() | F.coalesce(F.lower("claim_subtype_raw").contains(F.lower("c_claim_subtype")), F.lit(False))
    numeric = F.col("c_operator").isin("gte", "lte", "eq")
    unit = F.col("c_threshold_unit").isNull() | F.col("normalized_value_unit").eqNullSafe(F.col("c_threshold_unit"))
    joined = facts.join(F.broadcast(c) if small else c, (F.col("claim_type") == F.col("c_claim_type")) & scope)
    return joined.where(~numeric | F.col("normalized_value_numeric").isNotNull() & unit)


def drivers(facts: DataFrame, criteria: DataFrame) -> DataFrame:
    """Per deal and criterion: n (facts that answer), n_hit (those that satisfy a text test), top (up to three facts, in order).

    Ranks use row_number with a bound, which limits groups before the shuffle; ties go to the first in reading order.
    """
    m = matches(facts, criteria)
    v, t, op = F.col("normalized_value_numeric"), F.col("c_threshold_num"), F.col("c_operator")
    words = text_of(F.col("normalized_value_text"), F.col("claim_value"))
    hit = F.when(op == "contains", words.contains(F.lower("c_threshold_text"))).when(op == "in", F.coalesce(F.array_contains("c_threshold_list", words), F.lit(False))).when(op == "exists", F.lit(True)).otherwise(F.lit(False))
    rank = F.when(op == "gte", -v).when(op == "lte", v).when(op == "eq", F.abs(v - t)).otherwise(F.when(hit, F.lit(0.0)).otherwise(F.lit(1.0)))
    m = m.withColumn("hit", hit).withColumn("rank", rank)
    key = ["deal_id", "c_mandate_id", "c_mandate_version", "c_pos"]
    counts = m.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("hit").alias("n_hit"))
    w = W.partitionBy(*key).orderBy("rank", "ord", "fact_id")
    fact = F.struct(F.col("place"), *[F.col(x) for x in ("fact_id", "entity_name", "claim_type", "claim_value", "normalized_value_numeric", "source_page", "source_excerpt", "confidence_score", "hit")])
    top = m.withColumn("place", F.row_number().over(w)).where("place <= 3").groupBy(*key).agg(F.array_sort(F.collect_list(fact)).alias("top"))
    return counts.join(top, key)


def _named(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def evaluate(deals: DataFrame, facts: DataFrame, criteria: DataFrame) -> DataFrame:
    """One row per deal and criterion: met, raw_score, weighted_score, facts_used, explanation and the criterion's fields.

    `facts` has entity_name and ord. Deals meet all criteria of the broadcast mandate, and left-join the small per-criterion
    results; criteria that no fact answers are unmet.
    """
    found = drivers(facts, criteria)
    c = weights(criteria).select(F.col("mandate_id").alias("c_mandate_id"), F.col("mandate_version").alias("c_mandate_version"), F.col("pos").alias("c_pos"), "fund_name", "criterion_id", "name", F.col("claim_type").alias("kind"), "operator", "threshold_num", "threshold_text", "threshold_list", "threshold_unit", "is_knockout", "share")
    every = deals.select("deal_id").distinct().crossJoin(F.broadcast(c) if criteria.count() <= 10_000 else c)
    r = every.join(found, ["deal_id", "c_mandate_id", "c_mandate_version", "c_pos"], "left")
    op, t = F.col("operator"), F.col("threshold_num")
    n, hits = F.coalesce("n", F.lit(0)), F.coalesce("n_hit", F.lit(0))
    numeric = op.isin("gte", "lte", "eq")
    value = F.get("top", F.lit(0))["normalized_value_numeric"]
    meets = F.when(op == "gte", value >= t).when(op == "lte", value <= t).when(op == "eq", F.abs(value - t) <= vocab.EQ_TOLERANCE * F.greatest(F.abs(t), F.lit(1.0)))
    met = F.coalesce(F.when(numeric, (n > 0) & meets).when(op == "exists", n > 0).otherwise(hits > 0), F.lit(False))
    r = r.withColumn("met", met)
    good = F.col("met")
    kept = F.when(numeric, F.when(t.isNotNull(), F.slice("top", 1, 1))).when((op == "exists") | (hits >= 3), F.col("top")).when(hits > 0, F.filter("top", lambda f: f["hit"])).otherwise(F.slice("top", 1, 1))
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    unit = _named(F.col("threshold_unit"))
    options = F.concat(F.lit("["), F.array_join(F.transform("threshold_list", quoted), ", "), F.lit("]"))
    symbol = F.when(op == "gte", F.lit(">=")).when(op == "lte", F.lit("<=")).otherwise(F.lit("=="))
    needle = quoted(F.lower("threshold_text"))
    explanation = (
        F.when(op == "exists", F.when(good, F.concat(F.lit("Found "), n.cast("string"), F.lit(" fact(s) of type '"), F.col("kind"), F.lit("'."))).otherwise(F.concat(F.lit("No fact of type '"), F.col("kind"), F.lit("' was found."))))
        .when(numeric & (n == 0), F.concat(F.lit("No comparable '"), F.col("kind"), F.lit("' value with unit '"), F.coalesce("threshold_unit", F.lit("None")), F.lit("' was found.")))
        .when(numeric & t.isNull(), F.concat(F.lit("Threshold '"), F.coalesce("threshold_text", F.lit("None")), F.lit("' is not numeric.")))
        .when(numeric, F.concat(python_float(value), F.lit(" "), unit, F.lit(" "), symbol, F.lit(" "), python_float(t), F.lit(" "), unit, F.lit(" -> "), F.when(good, F.lit("met")).otherwise(F.lit("not met")), F.lit(".")))
        .when(n == 0, F.concat(F.lit("No '"), F.col("kind"), F.lit("' fact to test.")))
        .when(op == "contains", F.concat(needle, F.when(good, F.lit(" found in a matching fact.")).otherwise(F.lit(" not present in any matching fact."))))
        .otherwise(F.concat(F.when(good, F.lit("A matching fact value is in ")).otherwise(F.lit("No matching fact value is in ")), options, F.lit(".")))
    )
    used = F.transform(F.coalesce(kept, F.slice("top", 1, 0)), lambda f: F.struct(f["fact_id"].alias("fact_id"), f["entity_name"].alias("entity_canonical_name"), f["claim_type"].alias("claim_type"), f["claim_value"].alias("claim_value"), f["source_page"].alias("source_page"), f["source_excerpt"].alias("source_excerpt"), f["confidence_score"].alias("confidence_score"), F.when(good, F.lit("supports")).otherwise(F.lit("contradicts")).alias("contribution_direction")))
    raw = F.when(good, F.lit(1.0)).otherwise(F.lit(0.0))
    return r.select("deal_id", F.col("c_mandate_id").alias("mandate_id"), F.col("c_mandate_version").alias("mandate_version"), F.col("c_pos").alias("pos"), "fund_name", "criterion_id", F.col("name").alias("criterion_name"), "is_knockout", "met", raw.alias("raw_score"), (raw * F.col("share")).alias("weighted_score"), F.coalesce(used, F.array()).alias("facts_used"), explanation.alias("explanation"))


def score(deals: DataFrame, facts: DataFrame, criteria: DataFrame) -> DataFrame:
    """One row per deal and mandate: total_score (0 after a failed knockout), knockout name (the last failed), traces, notes."""
    each = evaluate(deals, facts, criteria)
    failed = F.col("is_knockout") & ~F.col("met")
    trace = F.struct("pos", "criterion_id", "criterion_name", "is_knockout", "met", "raw_score", "weighted_score", "facts_used", "explanation")
    per = each.groupBy("deal_id", "mandate_id", "mandate_version").agg(F.array_sort(F.collect_list(trace)).alias("t"), F.coalesce(F.bool_or(failed), F.lit(False)).alias("knockout_triggered"), F.max(F.when(failed, F.struct("pos", "criterion_name")))["criterion_name"].alias("knockout_criterion_name"))
    counted = facts.groupBy("deal_id").agg(F.count("*").alias("facts_evaluated"))
    total = F.aggregate("t", F.lit(0.0), lambda acc, x: acc + x["weighted_score"])  # in order of criteria
    n = F.size("t").cast("string")
    notes = F.when(F.col("knockout_triggered"), F.concat(F.lit("Knockout criterion '"), F.col("knockout_criterion_name"), F.lit("' failed; total forced to 0 regardless of "), n, F.lit(" criteria."))).otherwise(F.concat(F.lit("Weighted score across "), n, F.lit(" criteria.")))
    out = per.join(counted, "deal_id", "left")
    return out.select(F.md5(F.concat_ws("|", "deal_id", "mandate_id", "mandate_version")).alias("score_id"), "deal_id", "mandate_id", "mandate_version", F.when(F.col("knockout_triggered"), F.lit(0.0)).otherwise(F.least(total * 100, F.lit(100.0))).alias("total_score"), "knockout_triggered", "knockout_criterion_name", F.transform("t", lambda x: x.dropFields("pos")).alias("criterion_scores"), F.coalesce("facts_evaluated", F.lit(0)).alias("facts_evaluated"), notes.alias("scoring_notes"))


def numeric_conflicts(facts: DataFrame) -> DataFrame:
    """deal_id, entity_id, claim_type, n_values where facts of one entity and type disagree on (number, unit)."""
    d = facts.where("normalized_value_numeric is not null and normalized_value_unit is not null")
    return d.groupBy("deal_id", "entity_id", "claim_type").agg(F.count_distinct("normalized_value_numeric", "normalized_value_unit").alias("n_values")).where("n_values > 1")


def text_conflicts(facts: DataFrame) -> DataFrame:
    """The same for canonical texts."""
    d = facts.where("normalized_value_text is not null")
    return d.groupBy("deal_id", "entity_id", "claim_type").agg(F.count_distinct("normalized_value_text").alias("n_values")).where("n_values > 1")
