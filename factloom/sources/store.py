"""Sources and sinks: files, tables of the store, mandates and settings."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from .schemas import SCHEMAS


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one of its own only where none is set and the driver is the only executor."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="factloom-"))
    return context.getCheckpointDir()


@dataclass(frozen=True)
class Settings:
    """Where tables are, and the limits of model calls."""

    root: str = "warehouse"
    timeout_s: float = 60.0
    attempts: int = 3

    @classmethod
    def from_environment(cls) -> Settings:
        e = os.environ
        return cls(e.get("FACTLOOM_ROOT", cls.root), float(e.get("FACTLOOM_TIMEOUT_S", cls.timeout_s)), int(e.get("FACTLOOM_ATTEMPTS", cls.attempts)))


def scan_documents(spark: SparkSession, path: str, metadata: dict[str, str] | None = None) -> DataFrame:
    """Files as raw_documents rows; a missing path raises. Files that don't start as a PDF are refused when read."""
    files = spark.read.format("binaryFile").load(path)
    ok = F.assert_true(F.substring("content", 1, 5) == F.lit(b"%PDF-"), F.concat(F.lit("not a PDF: "), F.col("path")))
    meta = F.create_map(*[F.lit(x) for kv in (metadata or {}).items() for x in kv]).cast("map<string,string>")
    return files.where(ok.isNull()).select(
        F.md5(F.concat_ws("|", "path", F.sha2("content", 256))).alias("deal_id"), F.col("path").alias("source_path"), F.sha2("content", 256).alias("file_hash"),
        F.col("length").alias("file_size_bytes"), F.lit(None).cast("int").alias("page_count"), F.col("modificationTime").alias("ingested_at"), meta.alias("source_metadata"), F.col("content").alias("raw_bytes"),
    )


def page_count(pages: DataFrame) -> DataFrame:
    return pages.groupBy("deal_id").agg(F.count("*").cast("int").alias("page_count"))


def parse_pages(documents: DataFrame, parser) -> DataFrame:
    """Pages of raw documents. `parser(bytes)` yields dicts of a page's raw_text, tables, words, has_images, each a
    value or an exception; a part that failed becomes a warning and the page stays."""
    import pandas as pd

    names = ("raw_text", "tables", "words", "has_images")
    empty = {"raw_text": "", "tables": [], "words": [], "has_images": False}

    def run(batches):
        for b in batches:
            rows = []
            for deal, raw in zip(b["deal_id"], b["raw_bytes"]):
                for number, page in enumerate(parser(raw), 1):
                    failed = [f"{k}: {page[k]}" for k in names if isinstance(page.get(k), Exception)]
                    row = {k: empty[k] if isinstance(page.get(k, empty[k]), Exception) else page.get(k, empty[k]) for k in names}
                    rows.append({"deal_id": deal, "page_number": number, **row, "extraction_warnings": failed})
            yield pd.DataFrame(rows, columns=["deal_id", "page_number", "raw_text", "tables", "has_images", "extraction_warnings", "words"])

    return round_words(documents.select("deal_id", "raw_bytes").mapInPandas(run, SCHEMAS["pages"]))


def round_words(pages: DataFrame) -> DataFrame:
    """Word geometry with two decimals."""
    keep = lambda w: F.struct(w["text"].alias("text"), *[F.round(w[k], 2).alias(k) for k in ("x0", "x1", "top", "bottom")])
    return pages.withColumn("words", F.transform("words", keep))


def load_mandate(source: str | dict) -> dict:
    """A mandate from a YAML file or a dict, checked: FileNotFoundError for a missing file, ValueError for what isn't valid."""
    if isinstance(source, str):
        if not os.path.exists(source):
            raise FileNotFoundError(source)
        try:
            with open(source) as f:
                source = yaml.safe_load(f)
        except yaml.YAMLError as e:
            raise ValueError(f"not YAML: {e}") from e
    if not isinstance(source, dict) or not source.get("criteria") or not source.get("fund_name"):
        raise ValueError("a mandate has fund_name and criteria")
    for c in source["criteria"]:
        if c.get("claim_type") not in vocab.CLAIM_TYPES or c.get("operator") not in vocab.OPERATORS:
            raise ValueError(f"criterion {c.get('name')}: unknown claim_type or operator")
        if not isinstance(c.get("weight"), (int, float)) or not c["weight"] > 0:
            raise ValueError(f"criterion {c.get('name')}: weight must be positive")
    return source


def criteria_frame(spark: SparkSession, mandates: list[dict] | dict) -> DataFrame:
    """Criteria rows of mandates, in order."""
    rows = []
    for m in [mandates] if isinstance(mandates, dict) else mandates:
        for pos, c in enumerate(m["criteria"]):
            t = c.get("threshold")
            try:
                num = float(t) if not isinstance(t, (list, tuple)) and t is not None else None
            except ValueError:
                num = None
            num = None if num is not None and math.isnan(num) else num
            options = sorted({str(o).lower() for o in (t if isinstance(t, (list, tuple)) else [t])}) if t is not None else None
            text = None if t is None or isinstance(t, (list, tuple)) else str(t)
            rows.append((str(m.get("mandate_id", m["fund_name"])), int(m.get("mandate_version", 1)), m["fund_name"], pos, str(c.get("criterion_id", pos)), c["name"], c.get("description", ""), c["claim_type"], c.get("claim_subtype"), c["operator"], num, text, options, c.get("threshold_unit"), float(c["weight"]), bool(c.get("is_knockout", False))))
    return spark.createDataFrame(rows, SCHEMAS["criteria"])


class Store:
    """Parquet tables under one root.

    A batch writes each of its tables to a folder of its own, and then one row of the table `commits`, which readers go by:
    a batch that fails halfway is never seen, and running it again doubles nothing. Rows are sorted by deal within files, so
    that a reader of one deal skips most row groups. One writer at a time is assumed; commits are one small row a batch.
    """

    COMMIT = "seq long, batch string, tables array<string>, replaces boolean"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self) -> None:
        """No commits where there are none; calling it again changes nothing."""
        self.spark.createDataFrame([], self.COMMIT).write.mode("ignore").parquet(self.path("commits"))

    def _commits(self) -> list:
        return sorted(self.spark.read.schema(self.COMMIT).parquet(self.path("commits")).collect(), key=lambda r: (r["seq"], r["batch"]))

    def read(self, name: str) -> DataFrame:
        batches: list[str] = []
        for r in self._commits():
            if name in r["tables"]:
                batches = [r["batch"]] if r["replaces"] else [*batches, r["batch"]]
        if not batches:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.path(name)}/{x}" for x in batches])

    def write(self, tables: dict[str, DataFrame], replaces: bool = False, batch: str | None = None) -> str:
        """Tables of a batch, all or none; with `replaces`, in place of what they hold."""
        batch = batch or uuid.uuid4().hex
        for name, rows in tables.items():
            kinds = self.spark.createDataFrame([], SCHEMAS[name]).schema
            columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]
            out = rows.select(*columns)
            out = out.sortWithinPartitions("deal_id") if "deal_id" in out.columns else out
            out.write.mode("overwrite").parquet(f"{self.path(name)}/{batch}")
        seq = max((r["seq"] for r in self._commits()), default=0) + 1
        row = self.spark.createDataFrame([(seq, batch, list(tables), replaces)], self.COMMIT)
        row.coalesce(1).write.mode("append").parquet(self.path("commits"))
        return batch

    def save(self, name: str, rows: DataFrame) -> None:
        self.write({name: rows})

    def upsert_criteria(self, rows: DataFrame) -> None:
        """Mandates of `rows` take the place of stored ones with their ids; readers see the old ones or the new ones."""
        old = self.read("criteria").join(rows.select("mandate_id").distinct(), "mandate_id", "left_anti")
        self.write({"criteria": old.select(*rows.columns).unionByName(rows)}, replaces=True)

    def facts(self, deal_id: str) -> DataFrame:
        return self.read("facts").where(F.col("deal_id") == deal_id)

    def entity_names(self, deal_id: str) -> DataFrame:
        return self.read("canonical_entities").where(F.col("deal_id") == deal_id).select("entity_id", "canonical_name")


def latest_scores(scores: DataFrame) -> DataFrame:
    """The newest score of each deal; the smaller id among equal times."""
    w = W.partitionBy("deal_id").orderBy(F.desc("scored_at"), "score_id")
    return scores.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
