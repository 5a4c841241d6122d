"""Queries over the test tables against brute force."""

import re

from factloom import queries
from factloom.operators import spans


def test_span_exact_searches_all_items_in_all_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    want = {(k, i): (at, at + len(e)) for k, t in docs for i, e in items if e and t and (at := t.find(e)) >= 0}
    got = queries.span_exact(spark, d).collect()
    assert len(got) == len(docs) * len(items)
    assert len(want) == 26 and {(r.doc_id, r.item_id): (r.span_start, r.span_end) for r in got if r.status == "verified_exact"} == want
    assert all(r.span_start is None and r.span_end is None for r in got if r.status == "unverified")


def test_span_blocks_lose_no_pair(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(k, e) for k, e in enumerate(["two", "three", "four", "", None])], "item_id long, excerpt string")
    got = {(r.doc_id, r.item_id): (r.start, r.end) for r in spans.exact_pairs(docs, items, 100).collect()}
    assert len(got) == 15 and {k: v for k, v in got.items() if v[0] is not None} == {(1, 0): (4, 7), (1, 1): (8, 13)}


def plain_tokens(words):
    return [t for w in words if (t := re.sub("[^a-z0-9]", "", w.lower()))]


def brute_place(words, excerpt):
    w, e = plain_tokens(words), plain_tokens(re.split(r"\s+", excerpt))
    if w and e:
        scores = [sum(a == b for a, b in zip(w[k:], e)) for k in range(max(len(w) - len(e), 0) + 1)]
        if max(scores) >= 0.6 * len(e):
            return scores.index(max(scores)), max(scores), len(e)
    return None


def test_boxes_are_sought_in_all_words_of_all_documents(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    rows = {r.id: ([w.text for w in r.words or []], r.excerpt or "") for r in queries.laid_out(spark, small).collect()}
    assert len(rows) == len(texts) and all(rows[str(k)][0] == re.split(r"\s+", t, flags=re.A) for k, t in texts.items() if t)
    want = {k: p for k, (w, e) in rows.items() if (p := brute_place(w, e))}
    assert {r.id: (r.start, r.score, r.window) for r in queries.Q["bbox_locate"](spark, small).collect()} == want
    assert max(start for start, *_ in want.values()) > 200
    assert {r.id for r in queries.Q["bbox_boxes"](spark, small).where("lines > 0").collect()} == set(want)
