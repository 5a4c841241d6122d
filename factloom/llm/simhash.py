"""SimHash near-dedup by a Gray-order hierarchical index.

Distinct fingerprints that agree on a masked bit pattern meet in a bucket; patterns have as many bits as leave
some two thousand fingerprints to a bucket. A bucket is sorted by Gray rank, so that neighbours share long bit
patterns; runs of it become nodes that hold the bits all their fingerprints share, and nodes of nodes above them.
Going down pairs of nodes, the differences among bits shared on both sides add up to a lower bound, and a pair of
groups is dropped as soon as it exceeds the radius. Each bucket returns a spanning forest of its links, the closest
first, never all its pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WordIds, materialize, mix64, plain_word, rows_of, shingle_hashes, text_column, word_ids

LEAF, FANOUT = 8, 8
#: Fingerprints of a bucket on average, and the most that one task holds; larger buckets are joined in pairs of blocks.
BUCKET, BLOCK = 2048, 4096
#: Pairs of leaves that are compared at once.
PAIRS = 1 << 13
#: Edges that one task holds.
CHUNK = 1 << 20
_BITS = np.array([[b >> (7 - j) & 1 for j in range(8)] for b in range(256)], np.float64)


def _lower(b: bytes) -> bytes:
    return b.lower()  # bytes: A-Z alone


def shingle_values(text: str, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle of a text, words A-Z lower-cased and joined by one space."""
    words = _lower(text.encode("utf-8", "surrogatepass")).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    n = min(n, len(words))
    ends = list(itertools.accumulate([len(w) + 1 for w in words], initial=0))
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[ends[i] : ends[i + n] - 1], 42) for i in range(len(words) - n + 1)), np.uint64, len(words) - n + 1)


def fingerprint(values: np.ndarray, bits: int = 64) -> np.ndarray:
    """Words of the fingerprint: bit 1 where over half the values have it. Beyond 64 bits, the values are mixed anew."""
    out = np.zeros(bits // 64, np.uint64)
    for k in range(len(out) if len(values) else 0):
        v = values if k == 0 else mix64(values + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1)))
        lanes = v.astype(">u8").view(np.uint8).reshape(-1, 8)
        if len(v) < 128:
            ones = np.unpackbits(lanes, axis=1).sum(0, dtype=np.int64)
        else:
            ones = np.concatenate([np.bincount(lanes[:, j], minlength=256) @ _BITS for j in range(8)])
        out[k] = np.packbits(ones * 2 > len(v)).view(">u8")[0]
    return out


def _fingerprints(n: int, bits: int, plain: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(plain_word)
        for b in batches:
            found, nodes = [], []
            for (text,) in rows_of(b, "text"):
                words = word_ids(text, ids) if plain else None
                found.append(fingerprint(shingle_hashes(words, n) if plain else shingle_values(text, n), bits).astype(">u8").tobytes())
                nodes.append(xxhash.xxh64_intdigest(words.tobytes() if plain else found[-1]) - (1 << 63))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["h"], pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "h", "node", "fp"])

    return run


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a 64-bit word in Gray order: the running parity of its bits from the top."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def width(count: int) -> int:
    """Bits of a pattern that leave BUCKET fingerprints to a bucket."""
    return max(0, math.ceil(math.log2(max(1, count) / BUCKET)))


def exact_masks(bits: int, radius: int, count: int) -> list[np.ndarray]:
    """Masks of which any two fingerprints within the radius agree on one at least: of `parts` fields, parts - radius are equal.
    There are as many fields as give the patterns their width, and patterns are cut to it."""
    if not (wide := width(count)):
        return [_mask(bits, [])]
    parts = next(p for p in range(radius + 1, bits + 1) if (p - radius) * (bits // p) >= wide or p == 2 * radius + 2)
    edges = [round(i * bits / parts) for i in range(parts + 1)]
    return [_mask(bits, [b for p in chosen for b in range(edges[p], edges[p + 1])][:wide]) for chosen in itertools.combinations(range(parts), parts - radius)]


def random_masks(bits: int, distance: float, count: int, miss: float, seed: int = 1) -> list[np.ndarray]:
    """Random masks, as many as leave a pair at the distance unmet with probability `miss`, whatever the width."""
    if not (wide := width(count)):
        return [_mask(bits, [])]
    meet = math.prod((bits - distance - i) / (bits - i) for i in range(wide))
    rng = np.random.default_rng(seed)
    return [_mask(bits, rng.choice(bits, wide, replace=False)) for _ in range(math.ceil(math.log(miss) / math.log1p(-meet)))]


def _mask(bits: int, chosen) -> np.ndarray:
    out = [0] * (bits // 64)
    for b in chosen:
        out[int(b) // 64] |= 1 << (63 - int(b) % 64)
    return np.array(out, np.uint64)


def levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of Gray-sorted fingerprints, for each level from the leaves up: the bits that a node's fingerprints share, and their values."""
    out, all1, any1, size = [], fps, fps, LEAF
    while True:
        starts = np.arange(0, len(all1), size)
        all1, any1 = np.bitwise_and.reduceat(all1, starts, 0), np.bitwise_or.reduceat(any1, starts, 0)
        out.append((~(all1 ^ any1), all1))
        size = FANOUT
        if len(all1) == 1:
            return out


def node_pairs(left: list, right: list, radius: int, same: bool) -> np.ndarray:
    """Pairs of leaves that can hold a link: down both trees at once, whole groups dropped by accumulated differences."""
    while len(left) < len(right):
        left = [*left, left[-1]]
    while len(right) < len(left):
        right = [*right, right[-1]]
    pairs = np.zeros((1, 2), np.int64)
    for depth in range(len(left) - 1, -1, -1):
        (ma, va), (mb, vb) = left[depth], right[depth]
        if depth < len(left) - 1:
            na, nb = len(ma), len(mb)
            fa, fb = (FANOUT if len(x[depth][0]) > len(x[depth + 1][0]) else 1 for x in (left, right))
            i = (pairs[:, :1] * fa + np.arange(fa))[:, :, None]
            j = (pairs[:, 1:] * fb + np.arange(fb))[:, None, :]
            i, j = (x.ravel() for x in np.broadcast_arrays(i, j))
            ok = (i < na) & (j < nb)
            if same:
                ok &= i <= j
            i, j = i[ok], j[ok]
            pairs = np.stack([i, j], 1)
        i, j = pairs[:, 0], pairs[:, 1]
        apart = np.bitwise_count((va[i] ^ vb[j]) & ma[i] & mb[j]).sum(1, dtype=np.int64)
        pairs = pairs[apart <= radius]
    return pairs


def near_pairs(a: np.ndarray, b: np.ndarray | None, radius: int, dropped: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in a and in b (in a, if b is None), both Gray-sorted, and distances of fingerprints within the radius, a part at a time.
    dropped: gets the number of leaf pairs in all, and of those that the index leaves out."""
    same, other = b is None, a if b is None else b
    left = levels(a)
    right = left if same else levels(other)
    leaves = node_pairs(left, right, radius, same)
    if dropped is not None:
        n, m = len(left[0][0]), len(right[0][0])
        dropped[0] += n * (n + 1) // 2 if same else n * m
        dropped[1] += (n * (n + 1) // 2 if same else n * m) - len(leaves)
    within = np.arange(LEAF)
    for k in range(0, len(leaves), PAIRS):
        i = np.broadcast_to((leaves[k : k + PAIRS, :1] * LEAF + within)[:, :, None], (len(leaves[k : k + PAIRS]), LEAF, LEAF)).ravel()
        j = np.broadcast_to((leaves[k : k + PAIRS, 1:] * LEAF + within)[:, None, :], (len(leaves[k : k + PAIRS]), LEAF, LEAF)).ravel()
        ok = (i < len(a)) & (j < len(other))
        if same:
            ok &= i < j
        i, j = i[ok], j[ok]
        apart = np.zeros(len(i), np.uint16)
        for w in range(a.shape[1]):  # whoever is too far after one word is left out of the next
            apart += np.bitwise_count(a[i, w] ^ other[j, w])
            if not (near := apart <= radius).all():
                i, j, apart = i[near], j[near], apart[near]
        yield i, j, apart


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that span what is within the radius: of a with itself, or of a and b. Both Gray-sorted; b's places follow a's.
    They are a minimum spanning forest, so two fingerprints are tied by links that are no longer than their distance."""
    off = 0 if b is None else len(a)
    size = len(a) + (0 if b is None else len(b))
    kept = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint16),)
    for part in near_pairs(a, b, radius):
        if not len(part[0]):
            continue
        i, j, apart = (np.concatenate(x) for x in zip(kept, (part[0], part[1] + off, part[2])))
        chosen, label = [], np.arange(size)
        order = np.argsort(apart, kind="stable")
        for level in np.split(order, np.flatnonzero(np.diff(apart[order])) + 1):
            level = level[label[i[level]] != label[j[level]]]
            if not len(level):
                continue
            parent: dict[int, int] = {}

            def top(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(up, up)
                return x

            for e, u, v in zip(level.tolist(), label[i[level]].tolist(), label[j[level]].tolist()):
                u, v = top(u), top(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    chosen.append(e)
            moved = np.arange(size)
            for x in parent:
                moved[x] = top(x)
            label = moved[label]
        at = np.array(chosen, np.int64)
        kept = i[at], j[at], apart[at]
    return list(zip(kept[0].tolist(), kept[1].tolist()))


def gray_sorted(fps: np.ndarray) -> np.ndarray:
    return np.lexsort([gray_rank(fps[:, k]) for k in range(fps.shape[1] - 1, -1, -1)])


def _words(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def _keyed(masks: list[np.ndarray], names: list[str]):
    """A row per fingerprint and mask: the key is a hash of the masked bit pattern."""
    used = [[(w, x) for w, x in enumerate(m) if x] for m in masks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _words(b["fp"], len(masks[0]))
            for k, fields in enumerate(used):
                key = np.zeros(len(fp), np.uint64)
                for w, x in fields:
                    key = mix64(key * np.uint64(3) + (fp[:, w] & x) + np.uint64(w))
                yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(np.full(len(fp), k, np.int32)), pa.array(key.view(np.int64))], [*names, "mask", "key"])

    return run


def _bucket_links(radius: int, words: int, tagged: bool):
    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket (mask, key, pair of blocks). What is held is the last, incomplete bucket, of two blocks at most."""
        held = None

        def joined(t: pa.Table) -> Iterator[pa.RecordBatch]:
            head = np.stack([t[c].to_numpy().astype(np.int64) for c in ("mask", "key", "pair")])
            new = np.flatnonzero(np.concatenate([[True], (head[:, 1:] != head[:, :-1]).any(0)]))
            size = np.diff(np.append(new, len(t)))
            ids, side = t["id"].to_numpy(), t["side"].to_numpy()
            fp, tag = _words(t["fp"].combine_chunks(), words), t["tag"].to_numpy() if tagged else None
            plain = np.bincount(np.repeat(np.arange(len(new)), size), side > 0, len(new)) == 0
            found = []
            for k in np.flatnonzero(size > 1):
                at = np.arange(new[k], new[k] + size[k])
                sides = [at] if plain[k] else [at[side[at] == 1], at[side[at] == 2]]
                sides = [x[gray_sorted(fp[x])] for x in sides]
                if tagged and (tag[at] != tag[at[0]]).any() and all(map(len, sides)):
                    for i, j, _ in near_pairs(fp[sides[0]], None if plain[k] else fp[sides[1]], radius):
                        i, j = sides[0][i], sides[-1][j]
                        if (apart := tag[i] != tag[j]).any():
                            yield edges(ids[i[apart]], ids[j[apart]])
                elif not tagged and all(map(len, sides)):
                    both = np.concatenate(sides)
                    found += [(both[x], both[y]) for x, y in forest(fp[sides[0]], None if plain[k] else fp[sides[1]], radius)]
            if found:
                yield edges(*(ids[np.array(x)] for x in zip(*found)))

        for rb in batches:
            t = pa.Table.from_batches([rb]) if held is None else pa.concat_tables([held, pa.Table.from_batches([rb])])
            if not len(t):
                continue
            last = [t[c][len(t) - 1].as_py() for c in ("mask", "key", "pair")]
            head = np.stack([t[c].to_numpy().astype(np.int64) for c in ("mask", "key", "pair")])
            cut = int(np.flatnonzero((head == np.array(last)[:, None]).all(0))[0])
            held = t.slice(cut)
            if cut:
                yield from joined(t.slice(0, cut))
        if held is not None:
            yield from joined(held)

    return run


def links(fps: DataFrame, radius: int, masks: list[np.ndarray], block: int = BLOCK) -> DataFrame:
    """a, b: ids of linked fingerprints, a spanning forest per bucket. `fps` is a written table of id (long), fp (binary), distinct in fp.
    If it has tag (long), these are all pairs within the radius that differ in it, in place of a forest.

    Buckets above `block` are cut into blocks by hash and joined as pairs of blocks, so no task holds more than
    two blocks, and no link is lost. All rows are shuffled once.
    """
    names = ["id", "fp", *(["tag"] if "tag" in fps.columns else [])]
    rows = fps.select(*names).mapInArrow(_keyed(masks, names), f"id long, fp binary, {'tag long, ' if 'tag' in names else ''}mask int, key long")
    keys = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = materialize(keys.select(F.col("mask").alias("m"), F.col("key").alias("k"), F.ceil(F.col("n") / block).cast("int").alias("parts")), "large-buckets")
    met = rows.join(large, (F.col("mask") == F.col("m")) & (F.col("key") == F.col("k")), "left")
    own, parts = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.col("parts")
    one = F.array(F.struct(F.lit(0).alias("pair"), F.lit(0).alias("side")))
    side = lambda o: F.when(o == own, F.lit(0)).when(own < o, F.lit(1)).otherwise(F.lit(2))
    blocks = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct((F.least(own, o) * parts + F.greatest(own, o)).alias("pair"), side(o).alias("side")))
    met = met.select(*names, "mask", "key", F.explode(F.when(parts.isNull(), one).otherwise(blocks)).alias("p")).select(*names, "mask", "key", "p.pair", "p.side")
    met = met.repartition("mask", "key", "pair").sortWithinPartitions("mask", "key", "pair")
    return met.mapInArrow(_bucket_links(radius, len(masks[0]), "tag" in names), "a long, b long")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of a task's edges, CHUNK of them at a time: each node with the smallest one it reaches over them."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        nodes = list(parent)
        u = np.array(nodes, np.int64)
        v = np.array([top(x) for x in nodes], np.int64)
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    for b in batches:
        for x, y in zip(b["u"].to_pylist(), b["v"].to_pylist()):
            x, y = top(x), top(y)
            parent[max(x, y)] = min(x, y)
        if len(parent) > CHUNK:
            yield stars()
    if parent:
        yield stars()


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node, label: the smallest node reachable.

    Tasks contract their edges to stars, at most `chunk` at a time; stars that fit one chunk are contracted once more,
    which ends it. More than that go through large-star and small-star steps on written tables until nothing
    moves. A step joins a node's neighbours with the smallest of them, an aggregate, so hubs are summed before the
    shuffle and their rows can be split; the number of steps grows with the logarithm of a component.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = materialize(e.mapInArrow(_contract, "u long, v long"), "stars")
    if e.count() <= chunk:
        return materialize(e.repartition(1).mapInArrow(_contract, "u long, v long"), "stars").select(F.col("u").alias("node"), F.col("v").alias("label"))
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(F.col("u").alias("c"), "m")
        large = both.join(low, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(low, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = materialize(small.where("u <> v").distinct(), "stars")
        after = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).collect()[0]
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = after


def fingerprints(docs: DataFrame, n: int, bits: int = 64, plain: bool = False) -> DataFrame:
    """A written table of doc_id, h (hash of the text), node (of the fingerprint, or of the words if plain), fp; repeated texts are hashed
    once per row, null texts are empty. plain: words are taken without what isn't a letter or digit."""
    slim = docs.select("doc_id", text_column().alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return materialize(slim.mapInArrow(_fingerprints(n, bits, plain), f"doc_id {kind}, h long, node long, fp binary"), "fingerprints")


def groups(docs: DataFrame, n: int = 4, bits: int = 64, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, h, fp, component_id (the smallest doc_id reachable over links of `radius` bits or fewer).

    All links within the radius are found. Null and empty texts have fingerprint zero and link like others; equal
    texts share a fingerprint, so a hot text is one node. A null doc_id is grouped but never names a group
    unless all its ids are null. Texts of any length are read whole; repeated rows are grouped alike. Other
    columns are ignored; an empty table gives no rows.
    """
    fps = fingerprints(docs, n, bits)
    # A node is the smallest id of a fingerprint.
    per = fps.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null")
    nodes = materialize(per.select(F.col("id").cast("long").alias("id"), "fp"), "nodes")
    found = components(links(nodes, radius, exact_masks(bits, radius, nodes.count())))
    named = nodes.join(found, F.col("id") == F.col("node"), "left").select(F.col("fp").alias("nfp"), F.coalesce("label", "id").alias("component_id"))
    return fps.join(named, F.col("fp") == F.col("nfp"), "left").select("doc_id", "h", "fp", "component_id")


def distance(bits: int, similarity: float) -> tuple[float, float]:
    """Mean and standard deviation of the bits that differ between texts of the similarity: the angle law, for sets of equal size."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return bits * share, math.sqrt(bits * share * (1 - share))


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(plain_word)
        for b in batches:
            found = [np.unique(shingle_hashes(word_ids(text, ids), n)).tobytes() for (text,) in rows_of(b, "text")]
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(found, pa.binary())], ["node", "s"])

    return run


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for sa, sb in rows_of(b, "sa", "sb", step=64):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                if len(x) < len(y):
                    x, y = y, x
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(y) else 0
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b["a"].take(at), b["b"].take(at)], ["a", "b"])

    return run


def clusters(docs: DataFrame, fps: DataFrame, n: int, bits: int, similarity: float, miss: float) -> DataFrame:
    """node, cluster: the clusters of texts over links of the similarity of n-word shingles, or more.

    Candidates are pairs of fingerprints within three standard deviations of the distance that the similarity gives; each is
    verified by the exact Jaccard similarity. Spanning forests of them come first. Where they hold, all other candidates lie
    within a cluster; where a link of theirs fails, the candidates between the clusters that it leaves are verified one and all. A text is a node under the hash of its
    words, so ids of documents, null or shared, have no part in it.
    """
    mean, deviation = distance(bits, similarity)
    nodes = materialize(fps.groupBy("node").agg(F.min("h").alias("h"), F.min("fp").alias("fp")).select(F.col("node").alias("id"), "h", "fp"), "nodes")
    masks = random_masks(bits, mean, nodes.count(), miss)
    radius = math.ceil(mean + 3 * deviation)

    def ordered(found: DataFrame) -> DataFrame:
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    edges = materialize(ordered(links(nodes.select("id", "fp"), radius, masks)), "candidates")
    involved = edges.select(F.explode(F.array("a", "b")).alias("e")).distinct().join(nodes, F.col("e") == F.col("id")).select(F.col("id").alias("node"), F.col("h").alias("nh"))
    involved = materialize(involved, "candidate-nodes")
    involved = F.broadcast(involved) if involved.count() * 160 <= BROADCAST_BYTES else involved
    texts = docs.select(text_column().alias("text")).select(F.xxhash64("text").alias("h"), "text").join(involved, F.col("h") == F.col("nh")).dropDuplicates(["node"])
    sets = materialize(texts.select("node", "text").mapInArrow(_sets(n), "node long, s binary"), "shingle-sets")
    left, right = sets.select(F.col("node").alias("n1"), F.col("s").alias("sa")), sets.select(F.col("node").alias("n2"), F.col("s").alias("sb"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(right, F.col("b") == F.col("n2")).join(left, F.col("a") == F.col("n1"))
        return materialize(both.select("a", "b", "sa", "sb").mapInArrow(_alike(similarity), "a long, b long"), "verified")

    held = verified(edges)
    found = components(held)
    # Forests whose links didn't all hold: their nodes, each tagged with its cluster so far.
    named = lambda stars, name: stars.select(F.col("node").alias("id"), F.col("label").alias(name))
    label = sets.select(F.col("node").alias("id")).join(named(components(edges), "whole"), "id", "left").join(named(found, "tag"), "id", "left")
    label = materialize(label.select("id", F.coalesce("whole", "id").alias("whole"), F.coalesce("tag", "id").alias("tag")), "forests")
    broken = label.groupBy("whole").agg(F.min("tag").alias("x"), F.max("tag").alias("y")).where("x < y").select("whole")
    broken = materialize(label.join(broken, "whole", "left_semi").join(nodes, "id").select("id", "fp", "tag"), "broken-forests")
    if broken.limit(1).count():
        more = ordered(links(broken, radius, masks)).join(edges, ["a", "b"], "left_anti")
        found = components(held.unionByName(verified(more)))
    return nodes.join(found, F.col("id") == F.col("node"), "left").select(F.col("id").alias("member"), F.coalesce("label", "id").alias("cluster"))


def dedup(docs: DataFrame, n: int = 5, bits: int = 256, similarity: float = 0.8, miss: float = 0.003) -> DataFrame:
    """docs with one document of each group in the columns of docs: the one with the smallest id, of equal ids the one
    with the smallest hash of its text. One with a null id stays where its group has no other.

    Words are compared in lower case without punctuation; texts are linked from a Jaccard similarity of 0.8 of their n-word
    shingles on, and groups are what links connect. Two texts at that similarity are no candidates for each other with a
    probability of `miss`, by masks, and of 0.0014, by the radius, whatever the size of the table. Texts without a word are
    one group; of rows with one id and one text, one stays. Texts of any length are read whole; an empty table gives no rows.
    """
    fps = fingerprints(docs, n, bits, True)
    named = clusters(docs, fps, n, bits, similarity, miss)
    # Rows with one text shrink first, so a hot text is one row of its group.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    least = fps.groupBy("node").agg(F.min(place).alias("p"))
    least = least.join(named, F.col("node") == F.col("member")).groupBy("cluster").agg(F.min("p").alias("p"))
    least = least.select(F.col("p.doc_id").alias("kid"), F.col("p.h").alias("kh"))
    copies = fps.groupBy(F.col("doc_id").alias("cid"), F.col("h").alias("ch")).agg(F.count("*").alias("c"))
    keep = materialize(least.join(copies, F.col("kid").eqNullSafe(F.col("cid")) & (F.col("kh") == F.col("ch"))).select("kid", "kh", "c"), "kept")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_column()).alias("h"))
    kept = rows.join(keep, F.col("id").eqNullSafe(F.col("kid")) & (F.col("h") == F.col("kh")))
    if not keep.where("c > 1").limit(1).count():
        return kept.select("row.*")
    once = kept.where("c > 1").groupBy("id", "h").agg(F.first("row").alias("row"))
    return kept.where("c = 1").select("row").unionByName(once.select("row")).select("row.*")
