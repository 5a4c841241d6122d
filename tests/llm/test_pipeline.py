"""The pipeline and each of its stages against brute force, on what the stage before keeps."""

import math
import random

import corpus_pipeline
import pytest
from .test_documents import brute_secrets, brute_stats, brute_targets, plain_shingles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, h string, spans string, kept string"


def brute_quality(rows):
    """Texts that the quality rules keep, without the lines that recur, by row."""
    hosts, where = {}, {}
    normal = lambda x: " ".join(x.encode("utf-8").split() and x.split()).lower()
    for _, t, s in set((None, t or "", s) for _, t, s in rows):
        hosts[s] = hosts.get(s, 0) + 1
        for x in {normal(x) for x in t.split("\n")} - {""}:
            where[s, x] = where.get((s, x), 0) + 1
    often = {k for k, n in where.items() if n >= 10 and 100 * n >= hosts[k[0]]}
    out = []
    for d, t, s in rows:
        n, _, _, _, repeats = brute_stats(t)
        lost = sum(len(x.split()) for x in (t or "").split("\n") if (s, normal(x)) in often)
        if n >= 50 and 100 * repeats <= 50 * n and 2 * lost <= n:
            out.append((d, "\n".join(x for x in t.split("\n") if (s, normal(x)) not in often), s))
    return out


def brute_groups(rows):
    sets = [plain_shingles(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return label


def checked(spark, docs, benchmark, folder, sf_dir):
    """Runs the stages one by one and holds each against brute force; the tables in between."""
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf_dir).write.parquet(f"{folder}/{k}")
        seen.append(spark.read.parquet(f"{folder}/{k}"))
        assert seen[-1].columns == docs.columns
    start, good, single, clean, masked, mixed = ([tuple(r) for r in d.select("doc_id", "text", "source").collect()] for d in seen)
    assert sorted(good, key=str) == sorted(brute_quality(start), key=str)
    label = brute_groups(good)
    group = {r: x for r, x in zip(good, label)}
    assert sorted(group[r] for r in single) == sorted(set(label))  # one of each group
    for r in single:
        assert r[0] == min((x[0] for x in good if group[x] == group[r] and x[0] is not None), default=None)
    items = [s for t in benchmark if (s := plain_shingles(t))]
    leaks = {r for r in single if (own := plain_shingles(r[1])) is not None and any(len(s & own) >= 0.8 * len(s) - 1e-9 for s in items)}
    assert sorted(clean, key=str) == sorted(set(single) - leaks, key=str)
    assert sorted(((d, s) for d, _, s in masked), key=str) == sorted(((d, s) for d, _, s in clean), key=str) and not any(brute_secrets(t) for _, t, _ in masked)
    untouched = {r for r in clean if not brute_secrets(r[1])}
    assert len(untouched & set(masked)) >= 0.99 * len(untouched)
    assert set(mixed) <= set(masked)
    sizes, copies = {}, {}
    for _, t, s in masked:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for r in mixed:
        copies[r] = copies.get(r, 0) + 1
    target = brute_targets(sizes)
    for r in masked:
        rate = target[r[2]] / sizes[r[2]]
        assert math.floor(rate) <= copies.get(r, 0) <= math.ceil(rate)
    return seen


def test_stages_on_a_table_of_the_driver(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [t for (t,) in spark.read.parquet(f"{small}/benchmark.parquet").select("text").collect()]
    seen = checked(spark, docs, bench, tmp_path, small)
    whole = corpus_pipeline.run(spark, small)
    assert whole.columns == docs.columns
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, seen[-1].collect()), key=str)


def test_stages_on_awkward_rows(spark, tmp_path):
    rng = random.Random(4)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    item, footer, long = line(12), line(6), "\n".join(line(20) for _ in range(3000))
    rows = [(i, line(60) + "\n" + footer, "s") for i in range(40)]
    rows += [(40, rows[3][1], "s"), (3, rows[3][1], "s"), (41, rows[4][1].upper(), None), (None, line(70), "s"), (None, line(70), None), (3, line(80), "s")]  # copies, repeated rows, one id with two texts, nulls
    rows += [(50, None, "s"), (51, "", None), (52, "\n \n", "s"), (53, long, "s"), (54, long + " " + item, "t"), (55, line(60) + " api_key: abcdef123 " + line(5), "t"), (56, "ein wort " * 60, "t")]
    rows += [(60, line(60) + " " + item, None)]
    docs = spark.createDataFrame([(d, t, None, s, len(t or ""), "row", "h", "spans", "kept") for d, t, s in rows], COLUMNS).repartition(3)
    spark.createDataFrame([(1, item), (2, None), (3, ""), (3, item)], "item_id long, text string").write.parquet(f"{tmp_path}/in/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    checked(spark, spark.read.parquet(f"{tmp_path}/in/documents.parquet"), [item], tmp_path / "out", f"{tmp_path}/in")
    assert corpus_pipeline.run(spark, f"{tmp_path}/in").columns == docs.columns


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], COLUMNS)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    nulls = spark.createDataFrame([(None,) * 9] * 3, COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nulls, str(tmp_path)).columns == nulls.columns
        stage(spark, nulls, str(tmp_path)).collect()
