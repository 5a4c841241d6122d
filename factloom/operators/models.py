"""Model calls as stages: a tier per task, output caps, time limits and retries, with usage in columns.

A model is any function of (tier, prompt, output cap) that returns the answer's text. Executors call it batch by batch;
its answers are written by the caller before anything is derived from them, so that no chunk is asked twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..sources.store import Settings
from . import chunking, extraction
from .retrieval import cost

#: The tier of each task.
TIERS = {"classification": "cheap", "extraction": "capable"}
Model = Callable[[str, str, int], str]


class ModelError(RuntimeError):
    """A call that failed at every attempt."""


def call(model: Model, tier: str, prompt: str, settings: Settings, pause=time.sleep) -> tuple[str, int]:
    """The answer and the milliseconds it took. An attempt ends at the time limit; pauses double from a second on."""
    began, last = time.monotonic(), None
    for attempt in range(settings.attempts):
        pool = ThreadPoolExecutor(1)
        try:
            text = pool.submit(model, tier, prompt, vocab.OUTPUT_CAPS[tier]).result(settings.timeout_s)
            return text, int((time.monotonic() - began) * 1000)
        except Exception as e:  # a model can raise anything
            last = e
            if attempt + 1 < settings.attempts:
                pause(2**attempt)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
    raise ModelError(f"{tier} model failed {settings.attempts} times: {last}") from last


def ask(rows: DataFrame, prompt: Column, task: str, model: Model, settings: Settings | None = None) -> DataFrame:
    """rows with answer, model_id, latency_ms, token_count_input, token_count_output, estimated_cost_usd."""
    tier, settings = TIERS[task], settings or Settings.from_environment()
    fields = "answer string, latency_ms long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [call(model, tier, p or "", settings) for p in b["prompt"].to_pylist()]
            answers = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([b["row"], b["prompt"], *answers], ["row", "prompt", "answer", "latency_ms"])

    packed = rows.select(F.struct("*").alias("row"), prompt.alias("prompt"))
    out = packed.mapInArrow(run, f"row {rows.schema.simpleString()}, prompt string, {fields}")
    n_in, n_out = (F.floor(F.length(x) / 4).cast("long") for x in ("prompt", "answer"))
    out = out.withColumns({"model_id": F.lit(tier), "token_count_input": n_in, "token_count_output": n_out})
    usage = ("answer", "latency_ms", "model_id", "token_count_input", "token_count_output")
    return out.select("row.*", *usage, cost(F.col("model_id"), n_in, n_out).alias("estimated_cost_usd"))


def classifier(model: Model, settings: Settings | None = None):
    """A classification stage for run_pipeline()."""

    def stage(chunks: DataFrame) -> DataFrame:
        prompt = F.concat(F.lit("Label this section as one of " + ", ".join(vocab.SECTION_TYPES) + '. Answer {"section_type": ..., "confidence": ...}.\n\n'), "content")
        asked = ask(chunks, prompt, "classification", model, settings).withColumn("c", chunking.parse_classification(F.col("answer")))
        return asked.withColumns({"section_type": F.col("c.section_type"), "classification_confidence": F.col("c.confidence")}).drop("c", "answer")

    return stage


def extractor(model: Model, settings: Settings | None = None):
    """An extraction stage for run_pipeline(): answers of chunks, to be written before parse_records() reads them."""

    def stage(chunks: DataFrame) -> DataFrame:
        prompt = F.concat(F.lit("List the claims of this section as a JSON array of objects with entity, claim_type, claim_subtype_raw, claim_value, source_excerpt, confidence.\n\n"), "content")
        keep = chunks.select("deal_id", "chunk_id", "chunk_index", "source_pages", "content")
        return ask(keep, prompt, "extraction", model, settings)

    stage.records = extraction.parse_records
    return stage
