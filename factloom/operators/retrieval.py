"""Keyword retrieval over facts, deal listings and the audit trail."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions.normalize import bound
from ..sources.store import checkpoint_dir
from ..functions.text import general, tokens


def query_tokens(text: str) -> list[str]:
    return sorted(set(re.findall("[a-z0-9]+", text.lower())))


def relevance(query: list[str]) -> Column:
    """3 per hint of the claim type in the query, 2 per entity token, 1 per excerpt and value token, and a tenth of the
    confidence if anything matched. The query is folded into constants; facts need claim_type, entity_name,
    source_excerpt, claim_value, confidence_score."""
    q = F.array(*[F.lit(t) for t in query]).cast("array<string>")
    hints = F.lit(0)
    for kind, words in vocab.HINTS.items():
        if n := len(set(words) & set(query)):
            hints = F.when(F.col("claim_type") == kind, F.lit(3 * n)).otherwise(hints)
    common = lambda c: F.size(F.array_intersect(q, tokens(F.col(c))))
    s = hints + 2 * common("entity_name") + common("source_excerpt") + common("claim_value")
    return F.when(s > 0, s + 0.1 * F.coalesce("confidence_score", F.lit(0.0))).otherwise(F.lit(0.0))


def display_value(numeric: Column, unit: Column, text: Column) -> Column:
    return F.when(numeric.isNotNull(), F.rtrim(F.concat(general(numeric), F.lit(" "), F.coalesce(unit, F.lit(""))))).otherwise(text)


def search(facts: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The best `limit` facts of each deal with their citation and `place`; ties in reading order.

    The rank is bounded, so each task keeps at most `limit` facts per deal before the shuffle.
    """
    if not query or not 1 <= limit <= 50:
        raise ValueError("a query has text and a limit from 1 to 50")
    words = query_tokens(query)
    # A fact that shares no token has none of them in its texts either; this is cheap beside the token sets.
    text = F.lower(F.concat_ws(" ", "entity_name", "source_excerpt", "claim_value"))
    hinted = [k for k, hints in vocab.HINTS.items() if set(hints) & set(words)]
    r = facts.where(F.coalesce(F.col("claim_type").isin(hinted), F.lit(False)) | (text.rlike("|".join(words)) if words else F.lit(False)))
    r = r.withColumn("relevance", bound(F.lit(0), lambda _: relevance(words))).where("relevance > 0")
    w = W.partitionBy("deal_id").orderBy(F.desc("relevance"), "ord", "fact_id")
    r = r.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    shown = display_value(F.col("normalized_value_numeric"), F.col("normalized_value_unit"), F.col("normalized_value_text"))
    extra = [c for c in ("source_char_start", "source_char_end", "span_verification", "source_bbox") if c in facts.columns]
    return r.select("deal_id", "place", "fact_id", F.col("entity_name").alias("entity"), "claim_type", "claim_value", shown.alias("normalized_value"), "confidence_score", "source_page", "source_excerpt", *extra, "relevance")


def related_criteria(found: DataFrame, criteria: DataFrame) -> DataFrame:
    """deal_id, pos, name of the criteria whose claim type is among a deal's results."""
    kinds = found.select("deal_id", "claim_type").distinct()
    return kinds.join(criteria.select("claim_type", "pos", "name"), "claim_type").select("deal_id", "pos", "name")


def list_deals(documents: DataFrame, facts: DataFrame, scores: DataFrame) -> DataFrame:
    """Deals newest first: deal_id, deal_name, ingested_at, fact_count, total_score (latest), without a query per deal."""
    from ..sources.store import latest_scores

    counted = facts.groupBy("deal_id").agg(F.count("*").alias("fact_count"))
    newest = latest_scores(scores).select("deal_id", "total_score")
    name = F.coalesce(F.try_element_at("source_metadata", F.lit("deal_name")), F.lit(""))
    out = documents.select("deal_id", name.alias("deal_name"), "ingested_at").join(counted, "deal_id", "left").join(newest, "deal_id", "left")
    return out.select("deal_id", "deal_name", "ingested_at", F.coalesce("fact_count", F.lit(0)).alias("fact_count"), "total_score").orderBy(F.desc("ingested_at"), "deal_id")


def token_estimate(*texts: Column) -> Column:
    return F.floor(sum((F.length(t) for t in texts), F.lit(0)) / 4)


def cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """US dollars; an unknown model costs nothing."""
    rate = lambda k: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for m, r in vocab.RATES.items() for x in (m, r[k])]), model), F.lit(0.0))
    return (tokens_in * rate(0) + tokens_out * rate(1)) / 1e6


def audit_events(events: DataFrame) -> DataFrame:
    """Events with root_event_id: the given root, else the parent, else the event itself."""
    return events.withColumn("root_event_id", F.coalesce("root_event_id", "parent_event_id", "event_id"))


def chain(events: DataFrame, root: str) -> DataFrame:
    return events.where(F.col("root_event_id") == root)


def true_roots(events: DataFrame) -> DataFrame:
    """event_id, origin: the event at the top of each chain of parents, of any length.

    Each round doubles the steps that are known and is written to the checkpoint folder; the round in which nothing moves is
    the last, so a chain of n takes log2 n of them. A parent that isn't there is the top. Rings never end, so they are an error.
    """
    checkpoint_dir(events.sparkSession)
    up = events.select("event_id", F.coalesce("parent_event_id", "event_id").alias("origin")).checkpoint()
    for _ in range(63):
        step = up.select(F.col("event_id").alias("o"), F.col("origin").alias("next")).where("o <> next")
        new = up.join(step, F.col("origin") == F.col("o"), "left").select("event_id", F.coalesce("next", "origin").alias("origin"), F.col("next").isNotNull().alias("moved")).checkpoint()
        if new.where("moved").isEmpty():
            return new.select("event_id", "origin")
        if not new.where("moved and event_id = origin").isEmpty():
            raise ValueError("a chain of parents is a ring")
        up = new.select("event_id", "origin")
    raise ValueError("a chain of parents is a ring")


def run_counters(pages: DataFrame, chunks: DataFrame, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """deal_id, pages, chunks, facts, entities: counted apart, joined on the small results."""
    out = None
    for name, d in (("pages", pages), ("chunks", chunks), ("facts", facts), ("entities", entities)):
        n = d.groupBy("deal_id").agg(F.count("*").alias(name))
        out = n if out is None else out.join(n, "deal_id", "full")
    return out.na.fill(0, ["pages", "chunks", "facts", "entities"])


def cost_totals(audit: DataFrame) -> DataFrame:
    return audit.groupBy("deal_id").agg(F.sum(F.coalesce("estimated_cost_usd", F.lit(0.0))).alias("cost_usd"))
