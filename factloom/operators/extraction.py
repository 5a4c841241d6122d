"""Chunks into raw records and records into facts, with entities and verified spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions.normalize import detect_scale, normalize_claim
from ..functions.text import is_blank, strip

RECORD = "array<struct<rule:int,pos:int,entity:string,claim_type:string,claim_subtype_raw:string,claim_value:string,source_excerpt:string,confidence:double>>"


def company(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_substr(text, F.lit(vocab.COMPANY)), F.lit("")), F.lit("the company"))


def _line(before: Column, after: Column) -> Column:
    """The line around a place, given what stands before it and from it on; stripped, 500 characters."""
    return F.substring(strip(F.concat(F.substring_index(before, "\n", -1), F.substring_index(after, "\n", 1))), 1, vocab.EXCERPT_CHARS)


def _record_maker(text, rule, kind, subtype, entity, whole, value, gaps):
    """The record of a rule's i-th match; the text before it is put together from the pieces between and the matches."""

    def one(i):
        joined = F.zip_with(F.slice(gaps, F.lit(1), i), F.slice(whole, F.lit(1), i), lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit(""))))
        before = F.concat(F.array_join(joined, ""), F.get(gaps, i))
        line = _line(before, text.substr(F.length(before) + 1, F.length(text)))
        return F.struct(F.lit(rule).alias("rule"), i.alias("pos"), entity.alias("entity"), F.lit(kind).alias("claim_type"), F.lit(subtype).cast("string").alias("claim_subtype_raw"), F.get(value, i).alias("claim_value"), line.alias("source_excerpt"), F.lit(0.88).alias("confidence"))

    return one


def extract_by_rules(chunks: DataFrame) -> DataFrame:
    """Raw records of the offline extractor: deal_id, chunk_id, chunk_index, source_pages, ord, and the record's fields.

    Seven patterns, every match of each, in order of rule and position, then two cues. Matches come with the text
    between them, so the line around each is rebuilt without offsets; one explode over the few records of a chunk.
    """
    text, who = F.col("content"), company(F.col("content"))
    found = []
    for k, (pattern, kind, subtype) in enumerate(vocab.EXTRACTION_RULES):
        entity = F.lit("global logistics market") if kind == "market_size" else who
        whole, value = F.regexp_extract_all(text, F.lit(pattern), 0), F.regexp_extract_all(text, F.lit(pattern), 1)
        gaps = F.split(text, pattern, -1)

        one = _record_maker(text, k, kind, subtype, entity, whole, value, gaps)
        found.append(F.when(text.rlike(pattern), F.transform(F.sequence(F.lit(0), F.size(whole) - 1), one)).otherwise(F.array().cast(RECORD)))

    def cue(k, applies, at, kind, subtype, value, confidence):
        at = F.greatest(at, F.lit(1))
        line = _line(text.substr(F.lit(1), at - 1), text.substr(at, F.length(text)))
        record = F.struct(F.lit(k).alias("rule"), F.lit(0).alias("pos"), who.alias("entity"), F.lit(kind).alias("claim_type"), F.lit(subtype).cast("string").alias("claim_subtype_raw"), F.lit(value).alias("claim_value"), line.alias("source_excerpt"), F.lit(confidence).alias("confidence"))
        return F.when(applies, F.array(record)).otherwise(F.array().cast(RECORD))

    low = F.lower(text)
    found.append(cue(7, text.rlike("(?i)b2b saas"), F.instr(low, "b2b saas"), "competitive_positioning", None, "B2B SaaS platform", 0.9))
    found.append(cue(8, text.rlike(r"(?i)united states|u\.s\.|san francisco|headquartered"), F.greatest(F.instr(low, "united states"), F.instr(low, "headquartered")), "other", "geography", "Headquartered in the United States", 0.85))
    out = chunks.select("deal_id", "chunk_id", "chunk_index", "source_pages", F.posexplode(F.concat(*[x.cast(RECORD) for x in found])).alias("ord", "r"))
    return out.select("deal_id", "chunk_id", "chunk_index", "source_pages", "ord", "r.entity", "r.claim_type", "r.claim_subtype_raw", "r.claim_value", "r.source_excerpt", F.col("r.confidence").cast("string").alias("confidence"))


def json_array(text: Column) -> Column:
    """From the first [ to the last ]; the text itself if there is none."""
    return F.coalesce(F.nullif(F.regexp_substr(text, F.lit(r"(?s)\[.*\]")), F.lit("")), text)


def parse_records(answers: DataFrame, raw: str = "answer") -> DataFrame:
    """Raw records of model answers, one per object of the array. What isn't JSON or an array gives none, and an
    element that isn't an object goes alone."""
    d = answers.withColumn("v", F.try_parse_json(json_array(F.col(raw)))).where(F.schema_of_variant("v").startswith("ARRAY"))
    keys = F.from_json(F.to_json("v"), "array<string>")
    each = d.select("deal_id", "chunk_id", "chunk_index", "source_pages", F.posexplode(keys).alias("ord", "item"))
    item = F.try_parse_json("item")
    each = each.withColumn("item", item).where(F.schema_of_variant("item").startswith("OBJECT"))
    get = lambda k: F.try_variant_get("item", f"$.{k}", "string").alias(k)
    return each.select("deal_id", "chunk_id", "chunk_index", "source_pages", "ord", *[get(k) for k in ("entity", "claim_type", "claim_subtype_raw", "claim_value", "source_excerpt", "confidence")])


def coerce(records: DataFrame) -> DataFrame:
    """Records with every field in its domain: claim type known or other, entity or unknown, a subtype for other, the
    excerpt cut to 500 characters, confidence in [0, 1] or 0.5."""
    kind = strip(F.lower(F.col("claim_type")))
    kind = F.when(kind.isin(*vocab.CLAIM_TYPES), kind).otherwise(F.lit("other"))
    value = F.coalesce("claim_value", F.lit(""))
    label = F.when(is_blank(value), F.lit("unmapped claim")).otherwise(F.concat(F.lit("unmapped: "), F.substring(strip(value), 1, vocab.LABEL_CHARS)))
    out = records.withColumn("claim_type", kind).withColumn("claim_value", value)
    out = out.withColumn("entity", F.when(is_blank(F.col("entity")), F.lit("unknown")).otherwise(strip(F.col("entity"))))
    out = out.withColumn("claim_subtype_raw", F.when((F.col("claim_type") == "other") & is_blank(F.col("claim_subtype_raw")), label).otherwise(F.col("claim_subtype_raw")))
    out = out.withColumn("source_excerpt", F.substring(F.coalesce("source_excerpt", F.lit("")), 1, vocab.EXCERPT_CHARS))
    confidence = F.col("confidence").try_cast("double")
    return out.withColumn("confidence_score", F.when(confidence.isNull() | F.isnan(confidence), F.lit(0.5)).otherwise(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)))).drop("confidence")


def match_key(name: Column) -> Column:
    """Lower case, punctuation out, company suffixes out wherever they stand; unknown if nothing is left."""
    words = F.split(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " "), r"(?U)\s+")
    key = F.array_join(F.filter(words, lambda t: (t != "") & ~t.isin(*vocab.SUFFIXES)), " ")
    return F.when(key == "", F.lit("unknown")).otherwise(key)


def entity_type(claim_type: Column) -> Column:
    return F.when(claim_type == "team_background", F.lit("person")).when(claim_type == "market_size", F.lit("market")).otherwise(F.lit("company"))


def resolve_entities(records: DataFrame) -> DataFrame:
    """entity_id, deal_id, match_key, canonical_name, entity_type, aliases of records with deal_id, entity, claim_type, and
    chunk_index and ord as reading order. The first variant names an entity and types it; later ones are aliases, in order
    of appearance, once. Variants are reduced to their first place before they are gathered, so a hot entity's rows are few."""
    place = F.struct("chunk_index", "ord")
    per = records.withColumn("match_key", match_key(F.col("entity"))).groupBy("deal_id", "match_key", strip(F.col("entity")).alias("name"))
    per = per.agg(F.min(F.struct(place.alias("at"), entity_type(F.col("claim_type")).alias("kind"))).alias("first"))
    out = per.groupBy("deal_id", "match_key").agg(F.array_sort(F.collect_list(F.struct(F.col("first.at").alias("at"), "name", F.col("first.kind").alias("kind")))).alias("v"))
    names = F.transform("v", lambda x: x["name"])
    return out.select(F.md5(F.concat_ws("|", "deal_id", "match_key")).alias("entity_id"), "deal_id", "match_key", F.get(names, F.lit(0)).alias("canonical_name"), F.get("v", F.lit(0))["kind"].alias("entity_type"), F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))).alias("aliases"))


def build_facts(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts of coerced records with normalized values, entity ids, spans and boxes; records without an excerpt go.

    Scale phrases and tokens of words are found once per page, and pages meet records in one join on (deal, page). Only excerpts without an exact
    place on their page are aligned, and only those of pages with words are located among them. `records` is read three
    times, so it's a written table. Sizes of texts and words are unknown to the planner, which would broadcast pages of
    any number by its guess; so all joins are shuffled.
    """
    from .spans import exact_span, locate_boxes, named_words, tokens_of, verify_spans

    page = F.coalesce(F.get("source_pages", F.lit(0)), F.lit(1)).alias("source_page")
    words = F.col("words") if "words" in pages.columns else F.lit(None).cast("array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>")
    p = pages.select(F.col("deal_id").alias("pd"), F.col("page_number").alias("pn"), F.coalesce("raw_text", F.lit("")).alias("page_text"), named_words(words).alias("words"))
    p = p.withColumn("scale", detect_scale(F.col("page_text"))).withColumn("tokens", tokens_of(F.col("words")))
    r = records.select(F.md5(F.concat_ws("|", "deal_id", "chunk_index", "ord")).alias("fact_id"), "*", page).where(~is_blank(F.col("source_excerpt")))
    r = r.join(p.hint("merge"), (F.col("deal_id") == F.col("pd")) & (F.col("source_page") == F.col("pn")), "left")
    text = F.coalesce("page_text", F.lit(""))
    r = r.withColumn("n", normalize_claim(F.col("claim_value"), F.col("claim_type"), F.col("scale"))).withColumn("s", exact_span(F.col("source_excerpt"), text))
    missed = r.where((F.col("s.status") == "unverified") & (text != "")).select(F.col("fact_id").alias("id"), F.col("source_excerpt").alias("excerpt"), text.alias("text"))
    near = verify_spans(missed).where("status <> 'unverified'").select(F.col("id").alias("sid"), F.struct("start", "end", "status").alias("f"))
    placed = locate_boxes(r.where(F.size("words") > 0).select(F.col("fact_id").alias("id"), F.col("source_excerpt").alias("excerpt"), "words", "tokens"))
    placed = placed.where(F.size("source_bbox") > 0).select(F.col("id").alias("bid"), "source_bbox")
    r = r.drop("page_text", "words", "tokens").join(near.hint("merge"), F.col("fact_id") == F.col("sid"), "left").join(placed.hint("merge"), F.col("fact_id") == F.col("bid"), "left")
    s = F.coalesce(F.col("f"), F.col("s"))
    return r.select(
        "fact_id", "deal_id", "chunk_id", F.md5(F.concat_ws("|", "deal_id", match_key(F.col("entity")))).alias("entity_id"), F.col("entity").alias("entity_raw_name"),
        "claim_type", "claim_subtype_raw", "claim_value", F.col("n.numeric").alias("normalized_value_numeric"), F.col("n.unit").alias("normalized_value_unit"),
        F.col("n.text").alias("normalized_value_text"), F.col("n.status").alias("normalization_status"), "source_page", "source_excerpt",
        s["start"].alias("source_char_start"), s["end"].alias("source_char_end"), s["status"].alias("span_verification"), "source_bbox",
        F.lit("sonnet_extraction").alias("extraction_method"), "confidence_score", F.lit(1).alias("document_version"),
        (F.col("chunk_index") * F.lit(1_000_000).cast("long") + F.col("ord")).alias("ord"),
    )


def attach_entities(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with the canonical name of their entity, else their own. Names are shuffled: there can be as many as deals."""
    names = entities.select("entity_id", "canonical_name").hint("merge")
    return facts.join(names, "entity_id", "left").withColumn("entity_name", F.coalesce("canonical_name", "entity_raw_name")).drop("canonical_name")


def latest_first(documents: DataFrame) -> DataFrame:
    """Documents by hash, the newest of each kept: the dedup that the data model documents."""
    w = W.partitionBy("file_hash").orderBy(F.desc("ingested_at"), "deal_id")
    return documents.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
