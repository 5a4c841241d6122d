import time

import pytest
from factloom import vocab
from factloom.operators import chunking, extraction, models, retrieval, scoring, spans
from factloom.plans.engine import Engine
from factloom.sources.jdbc import read_table, write_table
from factloom.sources.sample import sample_pages
from factloom.sources.schemas import SCHEMAS
from factloom.sources.store import Settings, Store, criteria_frame, load_mandate, scan_documents
from factloom.streaming.audit import rollup
from pyspark.sql import functions as F

PAGES = [
    ("d1", 1, "Confidential. All rights reserved.", []),
    ("d1", 2, "Northwind Logistics reports\nARR of $4.2M and revenue of $5.0M\nA B2B SaaS firm headquartered in the United States", [[["Year", None], ["2023", " 5 "]], [[""]]]),
    ("d1", 3, "A team of 14 serves 1,200 paying customers", []),
    ("d2", 1, "ARR of $300K\nNorthwind Labs has a team of 3", []),
]
MANDATE = {"mandate_id": "m", "fund_name": "f", "criteria": [
    {"name": "arr", "claim_type": "revenue", "claim_subtype": "arr", "operator": "gte", "threshold": 1000000, "threshold_unit": "USD", "weight": 2, "is_knockout": True},
    {"name": "saas", "claim_type": "competitive_positioning", "operator": "contains", "threshold": "B2B SaaS", "weight": 1},
    {"name": "team", "claim_type": "team_background", "operator": "gte", "threshold": 5, "threshold_unit": "count", "weight": 1, "is_knockout": True},
]}


def pages(spark):
    return spark.createDataFrame([(d, n, t, tables, False, [], []) for d, n, t, tables in PAGES], SCHEMAS["pages"])


def test_engine_end_to_end(spark, tmp_path):
    engine = Engine(Store(spark, str(tmp_path)))
    engine.store.create()
    engine.store.create()
    docs = spark.createDataFrame([("d1", {"deal_name": "One"}), ("d2", None)], "deal_id string, source_metadata map<string,string>").withColumn("ingested_at", F.current_timestamp())
    engine.ingest(pages(spark), docs)
    criteria = criteria_frame(spark, load_mandate(MANDATE))
    engine.store.upsert_criteria(criteria)
    engine.store.upsert_criteria(criteria)
    assert engine.store.read("criteria").count() == 3
    engine.score(engine.store.read("criteria"))
    one, two = engine.latest_score("d1").first(), engine.latest_score("d2").first()
    assert one.total_score == 100.0 and not one.knockout_triggered
    assert two.total_score == 0.0 and two.knockout_criterion_name == "team"
    assert one.criterion_scores[0].explanation == "4200000.0 USD >= 1000000.0 USD -> met."
    found, related = engine.query("d1", "what is the revenue", 5, criteria)
    assert found.first().claim_type == "revenue" and found.first().normalized_value == "4.2e+06 USD"
    assert [r.name for r in related.collect()][0] == "arr"
    assert {(r.deal_id, r.deal_name) for r in engine.deals().collect()} == {("d1", "One"), ("d2", "")}
    facts = engine.store.read("facts")
    assert facts.where("span_verification = 'verified_exact'").count() == facts.count() > 0
    assert facts.where("source_page = 1 and deal_id = 'd1'").count() == 0  # legal text is gated
    with pytest.raises(LookupError):
        engine.query("d9", "x")
    with pytest.raises(LookupError):
        engine.latest_score("d9")


def test_chunks(spark):
    long = "\n\n".join(["a" * 1500, "b" * 1500, "c" * 1500, "d" * 5000])
    p = spark.createDataFrame([("x", 1, "  ", [[["a", None], [" b ", "c"]]], False, [], []), ("x", 2, long, [], False, [], [])], SCHEMAS["pages"])
    got = [(r.chunk_index, r.contains_table, r.content) for r in chunking.chunk_pages(p).orderBy("chunk_index").collect()]
    assert got[0] == (0, True, "a | \nb | c")
    assert [len(c) for _, _, c in got[1:]] == [3002, 1500, 5000]


def test_classification_answers(spark):
    raw = ['x {"section_type": " Table ", "confidence": 3} y', '{"section_type": "nope"}', "[1]", "", '{"section_type": "table", "confidence": "high"}', '{"section_type": "other"}']
    got = [tuple(r.v) for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").orderBy("i").select(chunking.parse_classification(F.col("x")).alias("v")).collect()]
    assert got == [("table", 1.0), ("other", 0.0), ("other", 0.0), ("other", 0.0), ("other", 0.0), ("other", 0.0)]


def test_fuzzy_spans(spark):
    text = "Revenue grew strongly in the year. ARR reached four million dollars.\nThe team is large."
    rows = [("exact", "ARR reached four", text), ("fuzzy", "ARR reached fuor million dolars", text), ("none", "entirely different words here", text), ("empty", "", text), ("null", None, None)]
    got = {r.id: r for r in spans.verify_spans(spark.createDataFrame(rows, "id string, excerpt string, text string")).collect()}
    assert got["exact"].status == "verified_exact" and text[got["exact"].start : got["exact"].end] == "ARR reached four"
    assert got["fuzzy"].status == "verified_fuzzy" and got["fuzzy"].start <= 40 and got["fuzzy"].end >= 60
    assert got["none"].status == got["empty"].status == got["null"].status == "unverified"


def test_boxes_use_the_first_word_of_a_line(spark):
    words = [(t, 10.0 * i, 10.0 * i + 8, top, top + 5) for i, (t, top) in enumerate(zip(["Alpha", "beta", "gamma", "delta"], [100.0, 102.0, 104.0, 120.0]))]
    rows = spark.createDataFrame([("a", "alpha BETA gamma delta", words), ("b", "no such words", words), ("c", "x", [])], "id string, excerpt string, words " + "array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>")
    got = {r.id: r.source_bbox for r in spans.locate_boxes(rows).collect()}
    assert [(b.x0, b.top, b.x1, b.bottom) for b in got["a"]] == [(0.0, 100.0, 18.0, 107.0), (20.0, 104.0, 28.0, 109.0), (30.0, 120.0, 38.0, 125.0)]
    assert got["b"] is None and got["c"] is None


def test_mandates_are_checked(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_mandate(str(tmp_path / "none.yaml"))
    (tmp_path / "bad.yaml").write_text("a: [")
    with pytest.raises(ValueError):
        load_mandate(str(tmp_path / "bad.yaml"))
    with pytest.raises(ValueError):
        load_mandate({"fund_name": "f", "criteria": [{**MANDATE["criteria"][0], "weight": 0}]})
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 x")
    assert scan_documents(spark, str(tmp_path / "x.pdf")).first().file_size_bytes == 10
    (tmp_path / "y.pdf").write_bytes(b"text")
    with pytest.raises(Exception, match="not a PDF"):
        scan_documents(spark, str(tmp_path / "y.pdf")).collect()


def test_filters_stand_before_python_and_criteria_are_broadcast(spark):
    facts = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.col("o_custkey").cast("string").alias("deal_id"), F.col("o_orderkey").cast("string").alias("fact_id"), F.when(F.col("o_orderkey") % 2 == 0, "revenue").otherwise("tvpi").alias("claim_type"), F.lit(None).cast("string").alias("claim_subtype_raw"), F.lit("USD").alias("normalized_value_unit"), F.col("o_totalprice").alias("normalized_value_numeric"))
    plan = scoring.matches(facts, criteria_frame(spark, MANDATE))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_streaming_rollup_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").alias("occurred_at"), "event_type", F.col("value").alias("estimated_cost_usd"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = rollup(stream).writeStream.outputMode("complete").format("memory").queryName("rolled").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rolled").agg(F.sum("n")).first()[0] == events.count()
    assert spark.table("rolled").count() == rollup(events).count()


def test_search_and_audit(spark):
    with pytest.raises(ValueError):
        retrieval.search(spark.range(1), "", 5)
    with pytest.raises(ValueError):
        retrieval.search(spark.range(1), "x", 51)
    e = spark.createDataFrame([("a", None, None), ("b", "a", None), ("c", "b", None), ("d", "c", "a")], "event_id string, parent_event_id string, root_event_id string")
    assert {r.event_id: r.root_event_id for r in retrieval.audit_events(e).collect()} == {"a": "a", "b": "a", "c": "b", "d": "a"}
    assert {r.origin for r in retrieval.true_roots(e).collect()} == {"a"}


def test_entities_come_from_first_variants(spark):
    rows = [("d", "Acme Corp.", "team_background", 0, 1), ("d", "ACME  inc", "revenue", 0, 0), ("d", "Acme Corp.", "revenue", 1, 0), ("d", "!!!", "market_size", 2, 0)]
    got = {r.match_key: r for r in extraction.resolve_entities(spark.createDataFrame(rows, "deal_id string, entity string, claim_type string, chunk_index int, ord int")).collect()}
    assert got["acme"].canonical_name == "ACME  inc" and got["acme"].entity_type == "company" and got["acme"].aliases == ["Acme Corp."]
    assert got["unknown"].entity_type == "market"


def test_ingest_attaches_boxes_and_near_spans_and_writes_all_events(spark, tmp_path):
    engine = Engine(Store(spark, str(tmp_path)))
    engine.store.create()
    docs = spark.createDataFrame([("sample", "deck.pdf")], "deal_id string, source_path string").withColumn("ingested_at", F.current_timestamp())
    asked = spark.sparkContext.accumulator(0)

    def model(tier, prompt, cap):
        asked.add(1)
        if tier == "cheap":
            return '{"section_type": "%s", "confidence": 0.7}' % ("legal_boilerplate" if "Confidential" in prompt else "narrative_claim")
        if "ARR of" not in prompt:
            return "none"
        return '[{"entity": "Harbor Logistics", "claim_type": "revenue", "claim_value": "$1.8M", "source_excerpt": "Harbor Logistics reachd ARR of $1.8M", "confidence": 0.9}, {"entity": "Harbor Logistics Inc.", "claim_type": "customer_metrics", "claim_value": "12%", "source_excerpt": "growing 12% MoM"}]'

    engine.ingest(sample_pages(spark), docs, classify=models.classifier(model), extract=models.extractor(model))
    facts = {r.claim_type: r for r in engine.store.read("facts").collect()}
    assert facts["revenue"].span_verification == "verified_fuzzy" and facts["customer_metrics"].span_verification == "verified_exact"
    text = "Harbor Logistics reached ARR of $1.8M and is growing 12% MoM"
    at = text.index("growing")
    assert [(b.x0, b.top, b.x1, b.bottom) for b in facts["customer_metrics"].source_bbox] == [(40.0 + 6 * at - 2 * text[:at].count(" "), 50.0, 40.0 + 6 * len(text) - 2 * text.count(" "), 62.0)]
    assert facts["revenue"].source_bbox[0].x0 == 40.0 and facts["revenue"].entity_id == facts["customer_metrics"].entity_id
    chunks = engine.store.read("chunks")
    assert asked.value == chunks.count() + chunks.where("section_type <> 'legal_boilerplate'").count()  # once each
    engine.score(criteria_frame(spark, MANDATE))
    engine.query("sample", "revenue")
    with pytest.raises(Exception, match="broken"):
        engine.ingest(sample_pages(spark, "other"), docs, resolve=lambda records: records.select(F.raise_error(F.lit("broken"))))
    kinds = {r.event_type for r in engine.store.read("audit_log").select("event_type").distinct().collect()}
    assert kinds == set(vocab.EVENT_TYPES)
    assert engine.store.read("chunks").where("deal_id = 'other'").isEmpty()  # a batch is seen whole or not at all
    found = engine.store.read("audit_log").where("event_type = 'extraction_run'").collect()
    assert {r.output_payload for r in found} == {'{"facts_extracted":0}', '{"facts_extracted":2}'} and all(r.root_event_id == r.event_id for r in found)


def test_sample_deck_by_rules(spark, tmp_path):
    engine = Engine(Store(spark, str(tmp_path)))
    engine.store.create()
    out = engine.ingest(sample_pages(spark))
    assert out.chunks.count() == 11 and engine.store.read("facts").where("size(source_bbox) > 0 and span_verification = 'verified_exact'").count() == out.facts.count() >= 6


def test_model_calls_retry_and_stop(spark):
    seen, pauses = [], []

    def flaky(tier, prompt, cap):
        seen.append((tier, cap))
        if len(seen) < 3:
            raise OSError("busy")
        return "ok"

    assert models.call(flaky, "cheap", "x", Settings(), pauses.append)[0] == "ok"
    assert seen == [("cheap", 1024)] * 3 and pauses == [1, 2]
    with pytest.raises(models.ModelError, match="failed 2 times"):
        models.call(lambda *_: time.sleep(5), "capable", "x", Settings(timeout_s=0.05, attempts=2), pauses.append)


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, f"n{i}", [i, i + 1]) for i in range(20)], "id long, name string, parts array<long>")
    write_table(rows, url, "things", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    back = read_table(spark, url, "things", "id", (0, 20), 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert back.rdd.getNumPartitions() == 4 and sorted((r.id, r.name, r.parts) for r in back.collect())[3] == (3, "n3", "[3,4]")


def test_settings_come_from_the_environment(monkeypatch):
    monkeypatch.setenv("FACTLOOM_ATTEMPTS", "5")
    assert Settings.from_environment() == Settings(attempts=5)


def test_fuzzy_spans_of_excerpts_longer_than_the_text(spark):
    rows = [("long", "ARR reached four million dollars", "ARR reached fuor million dolars"), ("no", "nothing of the kind stands here", "xyz")]
    got = {r.id: r for r in spans.verify_spans(spark.createDataFrame(rows, "id string, excerpt string, text string")).collect()}
    assert (got["long"].status, got["long"].start, got["long"].end) == ("verified_fuzzy", 0, 31) and got["no"].status == "unverified"


def test_exact_pairs_match_a_plain_search(spark):
    texts = ["one two three four five six seven", "x one two\tthree  four five", "", None, "one two three four fiver and on", "five four three two one", "é one two three\nfour five é"]
    items = ["one two three four five", "ne two three four fiv", "two three", "", None, "two\tthree  four five", " two three four five six ", "three\nfour five é", "a b c d e"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[1]), (None, texts[0])], "doc_id long, text string")
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(items)] + [(0, items[1])], "item_id long, excerpt string")
    for size in (8 << 20, 40):
        got = sorted(((r.doc_id, r.item_id, r.start, r.end, r.status) for r in spans.exact_pairs(docs, rows, size).collect()), key=str)
        want = []
        for d, t in [*enumerate(texts), (0, texts[1]), (None, texts[0])]:
            for i, e in [*enumerate(items), (0, items[1])]:
                at = t.find(e) if t and e else -1
                want.append((d, i, *((at, at + len(e), "verified_exact") if at >= 0 else (None, None, "unverified"))))
        assert got == sorted(want, key=str)


def test_ingest_broadcasts_no_table_that_grows_with_pages(spark, small):
    from factloom import queries

    plan = queries.ingest_facts(spark, small)
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
    pages = queries.rendered_pages(spark, small)
    records = extraction.coerce(extraction.extract_by_rules(queries.rendered(spark, small)))
    plan = extraction.build_facts(records, pages)._jdf.queryExecution()
    assert "Join" in plan.executedPlan().toString() and "Broadcast" not in plan.executedPlan().toString()
