"""Quality rules on lines that recur across documents of a host.

Normalised lines are hashed, the distinct documents of each line are counted per host, lines above
the limits are removed, and documents that lose too much are rejected. Documents with equal texts
count once, so copies don't make a line boilerplate. A few rules on the words of a document alone come first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, rows_of, text_column

SYMBOLS = "#*$%&|<>"
#: A line is boilerplate from so many different documents of a host on, if these are so many percent of the host's
#: different documents or more; a document is rejected if it loses more than this share of its words.
LINE_DOCUMENTS, LINE_PERCENT, LOST_SHARE = 10, 1, 0.5
#: Rules on the document alone.
LEAST_WORDS, REPEAT_PERCENT = 50, 50
_WHITE = re.compile(r"[\x20\x09-\x0D]")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur at least twice, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    counts = Counter(windows)
    hit = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : k + n] |= hit
    return int(covered.sum())


def normal_line(words: list[bytes]) -> bytes:
    """A line's words in lower case, one space between."""
    return b" ".join(words).decode().lower().encode()


def line_words(text: str) -> tuple[int, dict[int, int]]:
    """Lines with a word that equal an earlier one; hashes and word counts of the distinct lines."""
    seen, dup, count = set(), 0, {}
    for line in text.split("\n"):
        if w := line.encode("utf-8", "surrogatepass").split():
            if line in seen:
                dup += 1
            seen.add(line)
            h = xxhash.xxh64_intdigest(normal_line(w)) - (1 << 63)
            count[h] = count.get(h, 0) + len(w)
    return dup, count


def stats(text: str) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; hashes and word counts of the distinct lines."""
    words = text.encode("utf-8", "surrogatepass").split()
    n_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    dup, count = line_words(text)
    return len(words), n_chars, sum(map(text.count, SYMBOLS)), dup, repeat_words(words), list(count), list(count.values())


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [list(line_words(t)[1]) for (t,) in rows_of(b, "text")]
        yield pa.RecordBatch.from_arrays([b["host"], b["h"], pa.array(found, pa.list_(pa.int64()))], ["host", "h", "lines"])


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [stats(t or "") for (t,) in rows_of(b, "text")]
        cols = list(zip(*got)) or [()] * 7
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["host"], b["h"], *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "host", "h", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"])


def frequent_lines(profile: DataFrame, least: int, percent: int) -> DataFrame:
    """host, line of the lines above the limits: in `least` different documents of the host, and in `percent` of them, at least.

    Both counts collapse equal texts first; they are summed in two steps, so a line or host that most documents
    have is counted in all tasks before anything meets.
    """
    lines = profile.select("host", "h", F.explode("lines").alias("line"))
    per = lines.groupBy("host", "line", "h").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    all_ = profile.groupBy("host", "h").agg(F.lit(1).alias("one")).groupBy(F.col("host").alias("th")).agg(F.count("*").alias("total"))
    per = per.where(F.col("n_docs") >= least).join(all_, F.col("host").eqNullSafe(F.col("th")))
    return per.where(F.col("n_docs") * 100 >= F.col("total") * percent).select("host", "line", "n_docs")


def _bytes(often: DataFrame) -> int:
    return often.agg(F.sum(F.coalesce(F.octet_length("host"), F.lit(0)) + 40)).collect()[0][0] or 0


def judge(docs: DataFrame, host: str = "source", least: int = LINE_DOCUMENTS, percent: int = LINE_PERCENT, lost: float = LOST_SHARE) -> DataFrame:
    """One row per document: doc_id, host, h (hash of the text), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, lost_words, removed (hashes of its removed lines), kept.

    Null texts are empty and fail the base rule; a null host is a host of its own. Repeated rows count as
    one document and get equal verdicts; a line that reaches a limit exactly is above it. Texts of any length are
    read whole. Other columns are ignored; an empty table gives no rows. Texts pass through Python once; what is
    shuffled are line hashes, summed per host and line before. The recurring lines are broadcast if their size,
    checked, is small, else joined, where adaptive execution can split a hot line.
    """
    slim = docs.select("doc_id", F.col(host).cast("string").alias("host"), text_column().alias("text"))
    slim = slim.withColumn("h", F.xxhash64("text")).select("doc_id", "host", "h", "text")
    id_type = slim.schema["doc_id"].dataType.simpleString()
    profile = slim.mapInArrow(_profile, f"doc_id {id_type}, host string, h long, {STATS}, lines array<long>, line_words array<long>")
    profile = materialize(profile.withColumn("row", F.monotonically_increasing_id()), "lines")
    often = materialize(frequent_lines(profile, least, percent), "boilerplate")
    small = _bytes(often) <= BROADCAST_BYTES
    often = often.select(F.col("host").alias("oh"), F.col("line").alias("ol"))
    often = F.broadcast(often) if small else often
    lines = profile.select("row", "host", F.explode(F.arrays_zip(F.col("lines").alias("line"), F.col("line_words").alias("n"))).alias("x")).select("row", "host", "x.line", "x.n")
    gone = lines.join(often, F.col("host").eqNullSafe(F.col("oh")) & (F.col("line") == F.col("ol")))
    gone = gone.groupBy(F.col("row").alias("r")).agg(F.sum("n").alias("lost_words"), F.collect_set("line").alias("removed"))
    out = profile.join(gone, F.col("row") == F.col("r"), "left").withColumn("lost_words", F.coalesce("lost_words", F.lit(0)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("removed", F.coalesce("removed", F.array().cast("array<long>")))
    kept = ~F.col("base_failed") & (F.col("lost_words") <= lost * F.col("n_words"))
    return out.select("doc_id", "host", "h", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "removed", kept.alias("kept"))


def without(text: str, drop: set[int]) -> str:
    """The text without the lines of these hashes."""
    keep = [x for x in text.split("\n") if not (w := x.encode("utf-8", "surrogatepass").split()) or xxhash.xxh64_intdigest(normal_line(w)) - (1 << 63) not in drop]
    return "\n".join(keep)


def _cleaned(often: dict[str | None, set[int]], lost: float):
    """Verdict and cut in one pass over texts: all that is needed of other documents are the recurring lines of the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts, cut = [], [], []
            for k, (host, text) in enumerate(rows_of(b, "host", "text")):
                n_words, _, _, _, n_repeat, lines, counts = stats(text)
                if n_words < LEAST_WORDS or 100 * n_repeat > REPEAT_PERCENT * n_words:
                    continue
                gone = {x: n for x, n in zip(lines, counts) if x in often.get(host, ())}
                if sum(gone.values()) <= lost * n_words:
                    at.append(k)
                    texts.append(without(text, set(gone)) if gone else text)
                    cut.append(bool(gone))
            yield pa.RecordBatch.from_arrays([b["row"].take(pa.array(at, pa.int64())), pa.array(texts, pa.string()), pa.array(cut, pa.bool_())], ["row", "text", "cut"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [without(text, set(removed)) if removed else text for text, removed in rows_of(b, "text", "removed")]
        yield pa.RecordBatch.from_arrays([b["row"], pa.array(out, pa.string()), pa.compute.greater(pa.compute.list_value_length(b["removed"]), 0)], ["row", "text", "cut"])


def clean(docs: DataFrame, host: str = "source", least: int = LINE_DOCUMENTS, percent: int = LINE_PERCENT, lost: float = LOST_SHARE, broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that judge() keeps, in the columns of docs, without the removed lines; n_chars, if there, follows.

    A verdict depends on the text, its host and the host's recurring lines. Where these lines fit `broadcast` bytes, each task
    has them and texts stay where they are; else documents meet their verdict by id, host and text hash, so rows with equal ids and
    different texts stay apart. Repeated rows all stay or all go. Null and empty texts are rejected. An empty table gives
    no rows; texts of any length and columns of any name pass through.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    rows = docs.select(rest.alias("row"), text_column().alias("text"), F.col(host).cast("string").alias("host"), F.col("doc_id").alias("id"))
    out_type = f"row {rows.schema['row'].dataType.simpleString()}, text string, cut boolean"
    lines = rows.select("host", F.xxhash64("text").alias("h"), "text").mapInArrow(_lines, "host string, h long, lines array<long>")
    often = materialize(frequent_lines(materialize(lines, "lines"), least, percent), "boilerplate")
    if _bytes(often) <= broadcast:
        by_host: dict[str | None, set[int]] = {}
        for h, line in often.select("host", "line").collect():
            by_host.setdefault(h, set()).add(line)
        kept = rows.select("row", "text", "host").mapInArrow(_cleaned(by_host, lost), out_type)
    else:
        verdict = judge(docs, host, least, percent, lost).where("kept").groupBy(F.col("doc_id").alias("vid"), F.col("host").alias("vhost"), F.col("h").alias("vh")).agg(F.max("removed").alias("removed"))
        met = rows.join(verdict, F.col("id").eqNullSafe(F.col("vid")) & F.col("host").eqNullSafe(F.col("vhost")) & (F.xxhash64("text") == F.col("vh")))
        kept = met.select("row", "text", "removed").mapInArrow(_without, out_type)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
