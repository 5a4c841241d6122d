"""The ingest pipeline as one plan, and the facade that answers questions from stored tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, extraction, retrieval, scoring
from ..sources.store import Store, latest_scores


@dataclass(frozen=True)
class Ingested:
    chunks: DataFrame
    facts: DataFrame
    entities: DataFrame
    audit: DataFrame


def _event(rows: DataFrame, kind: str, *key: str, given: str | None = None, made: str | None = None) -> DataFrame:
    """Audit events of rows, one each; usage columns come along where rows have them."""
    usage = {"model_id": "string", "latency_ms": "long", "token_count_input": "long", "token_count_output": "long", "estimated_cost_usd": "double"}
    payload = lambda c: F.lit(None).cast("string") if c is None else F.to_json(F.struct(c))
    kept = [F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in usage.items()]
    none = F.lit(None).cast("string")
    out = rows.select(
        F.md5(F.concat_ws("|", F.lit(kind), *key)).alias("event_id"), F.lit(kind).alias("event_type"), "deal_id", none.alias("parent_event_id"), none.alias("root_event_id"),
        F.lit("system").alias("actor"), payload(given).alias("input_payload"), payload(made).alias("output_payload"), *kept, F.lit(True).alias("success"), F.current_timestamp().alias("occurred_at"),
    )
    return retrieval.audit_events(out)


def classify_by_rules(chunks: DataFrame) -> DataFrame:
    """The offline classification stage, with the usage that a cheap model would have."""
    n = retrieval.token_estimate(F.col("content"))
    return chunking.classify(chunks).withColumns({"model_id": F.lit("cheap"), "token_count_input": n, "token_count_output": F.lit(0).cast("long"), "estimated_cost_usd": retrieval.cost(F.lit("cheap"), n, F.lit(0))})


def run_pipeline(pages: DataFrame, classify=classify_by_rules, extract=extraction.extract_by_rules, resolve=extraction.resolve_entities, written=lambda name, rows: rows) -> Ingested:
    """Pages of any number of deals to chunks, facts, entities and audit events.

    The gate stands before the extractor, so what it drops is never read by it. Each stage is a function of DataFrames: `classify`
    adds section_type and classification_confidence to chunks, `extract` makes raw records of chunks (or answers, if it has
    `records` to read them with), `resolve` makes entities of records. `written` materializes what several tables are derived
    from, so that a model is asked once per chunk and facts and entities come from the same answers.
    """
    chunks = written("classified", classify(chunking.chunk_pages(pages)))
    passed = chunking.extractable(chunks)
    read = getattr(extract, "records", None)
    answers = written("answers", extract(passed))
    records = written("records", extraction.coerce(read(answers) if read else answers))
    entities = written("entities", resolve(records))  # of all records, rejected ones too
    facts = written("facts", extraction.build_facts(records, pages))
    n = retrieval.token_estimate(F.col("content"))
    rules = {"model_id": F.lit("capable"), "token_count_input": n, "token_count_output": F.lit(0).cast("long"), "estimated_cost_usd": retrieval.cost(F.lit("capable"), n, F.lit(0))}
    asked = answers if read else passed.drop("latency_ms").withColumns(rules)
    counted = facts.groupBy("chunk_id").agg(F.count("*").alias("facts_extracted"))
    runs = asked.join(counted, "chunk_id", "left").withColumn("facts_extracted", F.coalesce("facts_extracted", F.lit(0)))
    resolved = pages.select("deal_id").distinct().join(entities.groupBy("deal_id").agg(F.count("*").alias("entity_count")), "deal_id", "left").na.fill(0, ["entity_count"])
    audit = _event(chunks, "classification_run", "chunk_id", given="chunk_index", made="section_type")
    audit = audit.unionByName(_event(runs, "extraction_run", "chunk_id", given="chunk_index", made="facts_extracted"))
    audit = audit.unionByName(_event(resolved, "entity_resolved", "deal_id", made="entity_count"))
    return Ingested(chunks, facts, entities.drop("match_key"), audit)


class Engine:
    """Ingest, score and query over a store."""

    def __init__(self, store: Store):
        self.store = store

    def ingest(self, pages: DataFrame, documents: DataFrame | None = None, **stages) -> Ingested:
        """Write a batch of pages, all its tables or none; errors are written to the audit log by a job of their own and raised
        again. What stages return is written beside the tables first. Returns the stored rows."""
        batch = uuid.uuid4().hex

        def written(name: str, rows: DataFrame) -> DataFrame:
            path = f"{self.store.root}/.work/{batch}/{name}"
            rows.write.parquet(path)
            return self.store.spark.read.schema(rows.schema).parquet(path)

        try:
            out = run_pipeline(pages, written=written, **stages)
            tables = {"chunks": out.chunks, "canonical_entities": out.entities, "facts": out.facts, "audit_log": out.audit}
            if documents is not None:
                came = _event(documents, "document_ingested", "deal_id", given="source_path" if "source_path" in documents.columns else None)
                tables |= {"raw_documents": documents, "audit_log": came.unionByName(out.audit)}
            self.store.write(tables, batch=batch)
            return out
        except Exception as e:
            self.record("pipeline_error", success=False, error_message=str(e)[:1000])
            raise

    def record(self, event_type: str, **fields) -> None:
        row = {"event_id": str(uuid.uuid4()), "event_type": event_type, **fields}
        kinds = {"success": "boolean", "latency_ms": "long"}
        rows = self.store.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row))
        for c in ("root_event_id", "parent_event_id"):
            rows = rows if c in row else rows.withColumn(c, F.lit(None).cast("string"))
        self.store.save("audit_log", retrieval.audit_events(rows).withColumn("occurred_at", F.current_timestamp()))

    def facts(self, deal_id: str | None = None) -> DataFrame:
        f, e = self.store.read("facts"), self.store.read("canonical_entities")
        if deal_id is not None:
            f, e = f.where(F.col("deal_id") == deal_id), e.where(F.col("deal_id") == deal_id)
        return extraction.attach_entities(f, e)

    def score(self, criteria: DataFrame, deals: DataFrame | None = None) -> DataFrame:
        """Score deals (all with facts by default) and append the snapshots."""
        facts = self.facts()
        batch = uuid.uuid4().hex
        scores = scoring.score(facts.select("deal_id") if deals is None else deals, facts, criteria).withColumn("scored_at", F.current_timestamp())
        path = f"{self.store.root}/.work/{batch}/scores"
        scores.write.parquet(path)  # what is returned is what is stored
        scores = self.store.spark.read.schema(scores.schema).parquet(path)
        events = _event(scores, "scoring_run", "score_id", "scored_at", given="mandate_id", made="total_score")
        self.store.write({"score_results": scores, "audit_log": events}, batch=batch)
        return scores

    def deals(self) -> DataFrame:
        return retrieval.list_deals(self.store.read("raw_documents"), self.store.read("facts"), self.store.read("score_results"))

    def query(self, deal_id: str, text: str, limit: int = 10, criteria: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        """Citations and, with a mandate, its related criteria. LookupError for a deal without facts."""
        facts = self.facts(deal_id)
        if facts.isEmpty():
            raise LookupError(f"deal {deal_id} has no facts")
        found = retrieval.search(facts, text, limit)
        self.record("query_executed", deal_id=deal_id, input_payload=text, success=True)
        return found.orderBy("place"), None if criteria is None else retrieval.related_criteria(found, criteria).orderBy("pos")

    def latest_score(self, deal_id: str) -> DataFrame:
        s = latest_scores(self.store.read("score_results").where(F.col("deal_id") == deal_id))
        if s.isEmpty():
            raise LookupError(f"deal {deal_id} was never scored")
        return s
