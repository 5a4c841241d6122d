import random

import numpy as np
import pytest
import xxhash
from factloom.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id string"


def brute_fingerprint(text, n=4):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(fps, radius):
    label = {d: d for d in fps}
    ids = sorted(fps)
    moved = True
    while moved:
        moved = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
    return label


def variants(seed, groups=12, copies=6):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    out = ["", None, "One", "ONE", "one two three four", " \t\n"]
    for _ in range(groups):
        words = rng.choices(vocabulary, k=rng.randint(3, 150))
        for _ in range(copies):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [4096, 8])
def test_groups_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash.links, "__defaults__", (block,))
    texts = variants(3)
    rows = [(i, t, "en", "s", 0, "clash", "clash") for i, t in enumerate(texts)] + [(7, texts[7], None, None, None, None, None)]
    got = simhash.groups(spark.createDataFrame(rows, DOCS)).collect()
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(fps, 4)
    assert len(got) == len(rows)
    assert {r.doc_id: int.from_bytes(r.fp, "big") for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == want


def test_forest_is_a_minimum_one():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (20, 1), dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, (20, 1), dtype=np.uint64)) for _ in range(30)]), axis=0)
    fps = fps[simhash.gray_sorted(fps)]
    apart = np.bitwise_count(fps ^ fps.T)
    found, third = simhash.forest(fps, None, 4), len(fps) // 3
    split = [(i + third, j + third) for i, j in simhash.forest(fps[third:], None, 4)] + simhash.forest(fps[:third], None, 4) + simhash.forest(fps[:third], fps[third:], 4)
    for radius in range(5):  # what links up to each length tie is what brute force ties
        want = _tied(len(fps), zip(*np.nonzero(apart <= radius)))
        for edges in (found, split):
            assert _tied(len(fps), [(i, j) for i, j in edges if apart[i, j] <= radius]) == want


def _tied(n, edges):
    label = np.arange(n)
    for i, j in edges:
        label[label == max(label[i], label[j])] = min(label[i], label[j])
    return label.tolist()


def test_index_drops_groups_and_no_pair():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, (40, 1), dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, (40, 1), dtype=np.uint64)) for _ in range(40)] + [rng.integers(0, 2**63, (900, 1), dtype=np.uint64)]), axis=0)
    fps = fps[simhash.gray_sorted(fps)]
    count = [0, 0]
    got = {(int(i), int(j)) for a, b, _ in simhash.near_pairs(fps, None, 4, count) for i, j in zip(a, b)}
    near = np.bitwise_count(fps ^ fps.T) <= 4
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j}
    assert count[1] > 0.3 * count[0]  # pairs of leaves that were never compared


@pytest.mark.parametrize("count", [100, 10**5, 10**7, 10**9, 10**11])
def test_masks_meet_every_pair(count):
    rng = np.random.default_rng(1)
    masks = simhash.exact_masks(64, 4, count)
    assert all(int(m[0]).bit_count() <= simhash.width(count) for m in masks)
    for _ in range(300):
        diff = 0
        for b in rng.choice(64, 4, replace=False):
            diff |= 1 << int(b)
        assert any(diff & int(m[0]) == 0 for m in masks)


@pytest.mark.parametrize("count", [10**4, 10**6, 10**9])
def test_random_masks_miss_alike_at_every_size(count):
    rng = np.random.default_rng(2)
    mean, deviation = simhash.distance(256, 0.8)
    masks = np.array(simhash.random_masks(256, mean, count, 0.01))
    missed = 0
    for _ in range(400):
        bits = np.zeros(256, bool)
        bits[rng.choice(256, round(mean), replace=False)] = True
        diff = np.packbits(bits).view(">u8").astype(np.uint64)
        missed += not ((masks & diff) == 0).all(1).any()
    assert missed <= 16


def test_recall_of_near_texts(spark):
    """Against brute force: nearly all pairs of 0.8 end in one group, and none below is linked."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for _ in range(150):
        words = [word() for _ in range(rng.choice([60, 120, 300]))]
        texts.append(words)
        for share in (0.01, 0.02, 0.03):
            texts.append([word() if rng.random() < share else w.capitalize() + rng.choice(["", ","]) for w in words])
    sets = [simhash.shingle_hashes(simhash.word_ids(" ".join(w), simhash.WordIds(simhash.plain_word)), 5) for w in texts]
    sets = [set(x.tolist()) for x in sets]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    fps = simhash.fingerprints(docs, 5, 256, True)
    named = {r.member: r.cluster for r in simhash.clusters(docs, fps, 5, 256, 0.8, 0.01).collect()}
    cluster = {r.doc_id: named[r.node] for r in fps.collect()}
    label, near = list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i // 4 * 4, i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                near.append((i, j))
                label = [label[j] if x == label[i] else x for x in label]
    assert len(near) > 300 and sum(cluster[i] == cluster[j] for i, j in near) >= 0.97 * len(near)
    assert all(label[i] == label[j] for i in range(len(texts)) for j in range(i) if cluster[i] == cluster[j])


def test_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [[word() for _ in range(200)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(10):
        w = list(base[i])
        for k in rng.sample(range(200), 3):
            w[k] = word()
        rows += [(100 + i, " ".join(w)), (200 + i, rows[i][1])]
    rows += [(3, rows[3][1]), (None, "quite another text"), (300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.dedup(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([*range(30), None, 300], key=str)


def test_dedup_keeps_a_document_of_each_group_whatever_its_id(spark):
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(120))
    lone = [text() for _ in range(8)]
    rows = [(None, t) for t in lone] + [(None, lone[0])] * 3
    shared = [text(), text()]
    rows += [(7, t) for t in shared]  # two texts with one id
    near = text()
    rows += [(1, near), (9, near), (9, other := text())]  # a text that is near nothing, and its namesake's group
    got = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("None", t) for t in lone] + [("7", t) for t in shared] + [("1", near), ("9", other)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(docs).collect() == []
    assert simhash.dedup(docs).collect() == []


@pytest.mark.parametrize("chunk", [1 << 20, 3])
def test_components(spark, chunk):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(40)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(3), chunk).collect()}
    assert {x: got.get(x, x) for x in label} == label


@pytest.mark.parametrize("block", [4096, 2])
def test_clusters_lose_no_link_that_a_forest_leaves_out(spark, monkeypatch, block):
    monkeypatch.setattr(simhash.links, "__defaults__", (block,))
    words = [f"w{k}" for k in range(100)]
    texts = [words[:90], words[10:], words]  # 0.79 between the first two, 0.9 between each and the third
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    # The forest has the first two, which fail, and 1 and 2; the link of 0 and 2 is one bit longer.
    marks = [bytes(32), bytes(31) + b"\x01", bytes(29) + b"\xff\xff\x1f"]
    fp = simhash.F.element_at(simhash.F.array(*[simhash.F.lit(m) for m in marks]), (simhash.F.col("doc_id") + 1).cast("int"))
    fps = simhash.fingerprints(docs, 5, 256, True).withColumn("fp", fp)
    got = simhash.clusters(docs, fps, 5, 256, 0.8, 0.01).collect()
    assert len(got) == 3 and len({r.cluster for r in got}) == 1
