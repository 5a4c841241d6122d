"""Pages into chunks, chunk labels and the gate before extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import is_blank, strip


def serialize_table(table: Column) -> Column:
    """Cells stripped, nulls empty, joined by " | ", rows by line breaks."""
    return F.array_join(F.transform(table, lambda row: F.array_join(F.transform(row, lambda c: strip(F.coalesce(c, F.lit("")))), " | ")), "\n")


def split_prose(text: Column, cap: int = vocab.PROSE_CHARS) -> Column:
    """Segments of a page: the text as it is up to the cap, else paragraphs packed greedily; one paragraph is never cut."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def pack(acc, p):
        now = acc["now"]
        full = (now != "") & (F.length(now) + F.length(p) + 2 > cap)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(strip(now)))).otherwise(acc["done"]).alias("done"),
            F.when(full, p).when(now == "", p).otherwise(F.concat(now, F.lit("\n\n"), p)).alias("now"),
        )

    packed = F.aggregate(F.split(text, "\n\n"), start, pack, lambda acc: F.when(is_blank(acc["now"]), acc["done"]).otherwise(F.concat(acc["done"], F.array(strip(acc["now"])))))
    none = F.array().cast("array<string>")
    return F.when(F.length(text) <= cap, F.when(is_blank(text), none).otherwise(F.array(text))).otherwise(packed)


def chunk_pages(pages: DataFrame) -> DataFrame:
    """chunk_id, deal_id, chunk_index, source_pages, content, contains_table: a page's prose segments, then its tables
    under the first 500 characters of its prose; blank prose and tables give nothing and take no number."""
    p = pages.select("deal_id", "page_number", F.coalesce("raw_text", F.lit("")).alias("text"), F.coalesce("tables", F.array().cast("array<array<array<string>>>")).alias("tables"))
    p = p.withColumn("segments", split_prose(F.col("text")))
    preamble = F.substring(F.coalesce(F.get("segments", F.lit(0)), F.lit("")), 1, vocab.PREAMBLE_CHARS)
    prose = p.select("deal_id", "page_number", F.posexplode("segments").alias("seg", "content")).select("deal_id", "page_number", F.lit(0).alias("kind"), "seg", "content")
    tables = p.select("deal_id", "page_number", preamble.alias("pre"), F.posexplode("tables").alias("seg", "t")).withColumn("body", serialize_table(F.col("t"))).where(~is_blank(F.col("body")))
    tables = tables.select("deal_id", "page_number", F.lit(1).alias("kind"), "seg", F.when(F.col("pre") == "", F.col("body")).otherwise(F.concat("pre", F.lit("\n\n[TABLE]\n"), "body")).alias("content"))
    w = W.partitionBy("deal_id").orderBy("page_number", "kind", "seg")
    out = prose.unionByName(tables).withColumn("chunk_index", F.row_number().over(w) - 1)
    return out.select(F.md5(F.concat_ws("|", "deal_id", "chunk_index")).alias("chunk_id"), "deal_id", "chunk_index", F.array("page_number").alias("source_pages"), "content", (F.col("kind") == 1).alias("contains_table"))


def classify_by_rules(content: Column) -> Column:
    """The offline classifier's label."""
    low = F.lower(content)
    legal = low.contains(vocab.LEGAL_CUES[0])
    for cue in vocab.LEGAL_CUES[1:]:
        legal |= low.contains(cue)
    return F.when(legal, F.lit("legal_boilerplate")).when(low.contains("[table]") | content.contains("$") & content.contains("|"), F.lit("financial_data")).otherwise(F.lit("narrative_claim"))


def json_object(text: Column) -> Column:
    """From the first { to the last }; the text itself if there is none."""
    return F.coalesce(F.nullif(F.regexp_substr(text, F.lit(r"(?s)\{.*\}")), F.lit("")), text)


def parse_classification(raw: Column) -> Column:
    """struct<section_type, confidence> of a model's answer; (other, 0.0) for what isn't a known label in valid JSON."""
    v = F.try_parse_json(json_object(raw))
    label = strip(F.lower(F.try_variant_get(v, "$.section_type", "string")))
    known = F.coalesce(label.isin(*vocab.SECTION_TYPES), F.lit(False))
    has = F.try_variant_get(v, "$.confidence", "string").isNotNull()
    confidence = F.try_variant_get(v, "$.confidence", "double")
    ok = known & (~has | confidence.isNotNull())
    return F.struct(F.when(ok, label).otherwise(F.lit("other")).alias("section_type"), F.when(ok, F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0)).alias("confidence"))


def classify(chunks: DataFrame, label=classify_by_rules, confidence: float = 0.9) -> DataFrame:
    return chunks.withColumn("section_type", label(F.col("content"))).withColumn("classification_confidence", F.lit(confidence))


def extractable(chunks: DataFrame) -> DataFrame:
    """Chunks that aren't legal boilerplate; unlabelled ones pass."""
    return chunks.where(~F.col("section_type").eqNullSafe("legal_boilerplate"))
