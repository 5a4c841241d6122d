"""Secret scans, in DataFrame functions alone.

Patterns give the base spans. A randomness battery adds more: for each long token of an inferred
encoding, chi-squared uniformity of the alphabet, the number of runs and the serial correlation are
tested against what names put together from words give; tokens that are too random for such a name are
secrets, at a false-discovery rate controlled over the whole corpus with weights by length.
"""

from __future__ import annotations

import functools
import math
import random as rnd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, text_column

# The base patterns.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Equal to dropping shorter matches of the open-ended patterns, since a later start in the same run is shorter still.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings in order of inference: the alphabet, and what a token of it matches.
ENCODINGS = {
    "hex": (DIGITS + "abcdef", "^[0-9a-f]+$"),
    "HEX": (DIGITS + "ABCDEF", "^[0-9A-F]+$"),
    "base32": (UPPER + "234567", "^[A-Z2-7]+$"),
    "base36": (LOWER + DIGITS, "^[a-z0-9]+$"),
    "BASE36": (UPPER + DIGITS, "^[A-Z0-9]+$"),
    "base38": (LOWER + DIGITS + "-_", "^[a-z0-9_-]+$"),
    "BASE38": (UPPER + DIGITS + "-_", "^[A-Z0-9_-]+$"),
    "base38+": (LOWER + DIGITS + "+/", "^[a-z0-9+/]+$"),
    "base62": (UPPER + LOWER + DIGITS, "^[A-Za-z0-9]+$"),
    "base64": (UPPER + LOWER + DIGITS + "+/", "^[A-Za-z0-9+/]+$"),
    "base64url": (UPPER + LOWER + DIGITS + "-_", "^[A-Za-z0-9_-]+$"),
}
#: Shorter tokens can't be told from names by any of the tests.
LEAST_CHARS = 20
TOKEN = r"[A-Za-z0-9+/_-]{%d,}"
#: Where a run of letters of one kind, or of digits, meets another one; marks end a run for names as for random letters.
CHANGE = "(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"
#: Least deviation of the runs test: a change more or less is nothing in a name.
LEAST_DEVIATION = 0.3
#: Words that names are put together from, to fit what the tests give for names.
WORDS = """
about access account action active address agent archive array author backup base batch benchmark block branch bucket buffer build cache
call center change channel check client cluster color column commit common config connection content control count create current customer
data default delete deploy detail device digest display document domain driver editor element email enable engine entry error event example
export feature field file filter folder format frame function gateway global graph group handler header history host image import index info
input instance item join kernel key label language layer length level library limit link list load local lock log login machine main manager map
market master member memory message method metric mobile model module monitor name network node number object offset online option order output
owner package page panel parent parser path pattern payment platform plugin point policy port prefix primary print process product profile project
property provider public query queue quick random range record region release remote render report request reset resource response result role
root route rule sample schedule schema scope screen search section security select sender server service session setting shared simple source
space stage start state static status storage stream string style submit summary support switch symbol system table target task template test
text theme thread time title total trace track transfer tree trigger type unique update upload user value vector version video view virtual
visible warning watch web widget window worker world writer zone
""".split()


def _matches(text: Column, pattern: str, value_group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, value>> of a pattern's matches: lengths of what stands between and of the matches, added up."""
    whole, value = F.regexp_extract_all(text, F.lit(pattern), 0), F.regexp_extract_all(text, F.lit(pattern), value_group)
    between = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    parts = F.zip_with(between, F.arrays_zip(whole.alias("m"), value.alias("v")), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["m"]).alias("n"), m["v"].alias("v")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc, p):
        begin = acc["at"] + p["gap"]
        one = F.array(F.struct(begin.alias("start"), (begin + p["n"]).alias("end"), p["v"].alias("value")))
        return F.struct((begin + p["n"]).alias("at"), F.when(F.length(p["v"]) >= least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda acc: acc["found"])).otherwise(none)


def _normal_cdf(z: Column) -> Column:
    """The normal distribution by a logistic curve, off by less than 0.0002."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def _encoding(token: str) -> str:
    import re

    return next((name for name, (_, rx) in ENCODINGS.items() if re.match(rx, token)), "base64")


def measures(token: str, encoding: str) -> tuple[float, float, float]:
    """What the tests measure: the chi-squared statistic of the alphabet's letters by its mean for random ones (close
    to 1 for these), class changes a place, and the serial correlation of the letters' places in the alphabet."""
    import re

    alphabet, n = ENCODINGS[encoding][0], len(token)
    pairs = sum(token.count(c) ** 2 for c in alphabet) - sum(c in alphabet for c in token)
    values = [alphabet.find(c) + 1 for c in token if c in alphabet]
    mean = sum(values) / n
    dev = [v - mean for v in values]
    serial = sum(x * y for x, y in zip(dev, dev[1:])) / max(sum(x * x for x in dev), 1e-9)
    return pairs * len(alphabet) / (n * (n - 1)), len(re.findall(CHANGE, token)) / (n - 1), serial


@functools.cache
def names_fit() -> dict[str, tuple[float, ...]]:
    """By encoding: mean and deviation times the root of the length of each measure over names of words and numbers, and the weights of
    their z in a sum of deviation 1. A fixed rule gives the names, so the fit is the same everywhere; it takes no part of the corpus."""
    dice, found = rnd.Random(7), {name: [] for name in ENCODINGS}
    styles = (str.lower, str.upper, str.capitalize, str.capitalize)
    marks = {"base38": "_-", "BASE38": "_-", "base38+": "/", "base64": "/+", "base64url": "_-"}
    case = {"base32": str.upper, "HEX": str.upper, "BASE36": str.upper, "BASE38": str.upper, "base36": str.lower, "hex": str.lower, "base38": str.lower, "base38+": str.lower}
    for name in ENCODINGS:
        alphabet = set(ENCODINGS[name][0])
        while len(found[name]) < 1500:
            style = case.get(name) or dice.choice(styles)
            mark, parts, size = dice.choice(marks.get(name, " ")).strip(), [], dice.randint(LEAST_CHARS, 44)
            while sum(map(len, parts)) + len(mark) * len(parts) < size:
                part = style(dice.choice(WORDS)) if dice.random() < 0.95 else str(dice.randint(0, 999))
                parts.append("".join(c for c in part if c in alphabet))
            token = mark.join(x for x in parts if x)
            if dice.random() < 0.5:
                token += str(dice.randint(1, 2999))
            token = "".join(c for c in token if c in alphabet)
            if len(token) >= LEAST_CHARS and (_encoding(token) == name or name in ("hex", "HEX")):
                found[name].append((len(token), *measures(token, name)))
    out = {}
    for name, rows in found.items():
        fit = []
        for k in (1, 2, 3):
            mean = sum(r[k] for r in rows) / len(rows)
            fit += [mean, max(LEAST_DEVIATION, math.sqrt(sum(r[0] * (r[k] - mean) ** 2 for r in rows) / len(rows)))]
        # A test weighs as much as it sets random letters of this encoding apart from names.
        letters = [(n, *measures("".join(dice.choices(ENCODINGS[name][0], k=n)), name)) for n in range(LEAST_CHARS, 60) for _ in range(10)]
        weights = [sum(_z(r, fit)[k] / math.sqrt(r[0]) for r in letters) / len(letters) for k in range(3)]
        total = [sum(w * z for w, z in zip(weights, _z(r, fit))) for r in rows]
        spread = math.sqrt(sum(x * x for x in total) / len(total))
        out[name] = (*fit, *(w / spread for w in weights))
    return out


def _z(row: tuple, fit) -> tuple[float, float, float]:
    root = math.sqrt(row[0])
    return (fit[0] - row[1]) / fit[1] * root, (row[2] - fit[2]) / fit[3] * root, (fit[4] - row[3]) / fit[5] * root


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, n, p_uniform, p_runs, p_serial of a column `token`, and p of all three: the chance that a name of words is as
    random, or more. Random letters are spread more evenly than a name's, change their kind more often and follow each other less."""
    t = F.col("token")
    encoding = F.coalesce(*[F.when(t.rlike(rx), F.lit(name)) for name, (_, rx) in ENCODINGS.items()], F.lit("base64"))
    d = tokens.withColumn("encoding", encoding).withColumn("n", F.length("token").cast("double"))
    letters = F.create_map(*[F.lit(x) for name, (a, _) in ENCODINGS.items() for x in (name, a)])
    d = d.withColumn("letters", letters[F.col("encoding")]).withColumn("k", F.length("letters").cast("double"))
    n, k = F.col("n"), F.col("k")
    # Uniformity: Pearson's statistic goes with the number of pairs of equal letters.
    count = lambda i: n - F.length(F.replace(F.col("token"), F.substring(F.col("letters"), i, F.lit(1)), F.lit("")))
    pairs = F.aggregate(F.sequence(F.lit(1), F.length("letters")), F.lit(0.0), lambda acc, i: acc + count(i) * (count(i) - 1))
    d = d.withColumn("m_uniform", pairs * k / (n * (n - 1)))
    d = d.withColumn("m_runs", F.regexp_count("token", F.lit(CHANGE)) / (n - 1))
    values = F.transform(F.split("token", ""), lambda c: F.instr(F.col("letters"), c).cast("double"))
    d = d.withColumn("v", F.filter(values, lambda x: x > 0))
    d = d.withColumn("m", F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / n)
    d = d.withColumn("dev", F.transform("v", lambda x: x - F.col("m")))
    ss = F.aggregate("dev", F.lit(0.0), lambda a, x: a + x * x)
    lag = F.aggregate(F.zip_with(F.slice("dev", 1, F.size("dev") - 1), F.slice("dev", 2, F.size("dev") - 1), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    d = d.withColumn("m_serial", lag / F.greatest(ss, F.lit(1e-9)))
    table = F.create_map(*[x for name, fit in names_fit().items() for x in (F.lit(name), F.array(*[F.lit(v) for v in fit]))])
    d = d.withColumn("fit", table[F.col("encoding")])
    fit = lambda i: F.element_at("fit", i + 1)
    d = d.withColumn("z_uniform", (fit(0) - F.col("m_uniform")) / fit(1) * F.sqrt(n)).withColumn("z_runs", (F.col("m_runs") - fit(2)) / fit(3) * F.sqrt(n)).withColumn("z_serial", (fit(4) - F.col("m_serial")) / fit(5) * F.sqrt(n))
    d = d.withColumn("z", fit(6) * F.col("z_uniform") + fit(7) * F.col("z_runs") + fit(8) * F.col("z_serial"))
    for name in ("_uniform", "_runs", "_serial", ""):
        d = d.withColumn(f"p{name}", 1 - _normal_cdf(F.col(f"z{name}")))
    return d.drop("letters", "k", "v", "m", "dev", "fit", "m_uniform", "m_runs", "m_serial", "z_uniform", "z_runs", "z_serial", "z")


def discovery_limit(tests: DataFrame, alpha: float, bins: int = 20) -> DataFrame:
    """One row, `limit`: Benjamini-Hochberg's largest p / weight at which a token is a secret.

    Weights grow with length, as longer tokens have more power, and average 1 over all tests. The
    step-up rule needs only counts by quantised p, so a bounded histogram takes the place of a
    global sort: bins of 1/`bins` of a unit of log10 p, rounded up, which rejects no more than
    the exact rule.
    """
    every = tests.agg(F.count("*").alias("m"), F.avg("n").alias("mean_n"))
    q = F.col("p") * F.col("mean_n") / F.col("n")
    bin_ = F.ceil(F.log10(F.greatest(F.least(q, F.lit(1.0)), F.lit(1e-30))) * bins)
    hist = tests.crossJoin(F.broadcast(every)).groupBy(bin_.alias("bin"), "m").agg(F.count("*").alias("c"))  # one row
    upto = F.sum("c").over(W.partitionBy("m").orderBy("bin"))
    hist = hist.withColumn("q", F.pow(F.lit(10.0), F.col("bin") / bins)).withColumn("ok", F.col("q") * F.col("m") <= alpha * upto)
    return hist.agg(F.coalesce(F.max(F.when(F.col("ok"), F.col("q"))), F.lit(0.0)).alias("limit"), F.max("m").alias("m0")).crossJoin(F.broadcast(every.select("mean_n")))


def scan(docs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row per document: doc_id, h (hash of the text), base and spans (arrays of struct<start, rank, end>, by start, then kind).

    rank indexes KINDS; positions are code points, the end exclusive. Null texts are empty and have
    no spans. Documents without a candidate, most of them, skip the battery. Tokens of the battery that
    overlap a base span add nothing. Repeated rows are scanned alike and count once in the corpus-wide rule; other columns are
    ignored. Texts of any length are read whole; an empty table gives no rows.
    The corpus-wide threshold comes from a table of candidates, which is small beside the texts.
    """
    return _spans(docs.select("doc_id", text_column().alias("text")), alpha)


def _spans(d: DataFrame, alpha: float) -> DataFrame:
    text = F.col("text")
    token = TOKEN % LEAST_CHARS
    d = d.withColumn("a", _matches(text, ASSIGN, 2, 6)).withColumn("k", _matches(text, ACCESS)).withColumn("h", _matches(text, HEX)).withColumn("t", _matches(text, token))
    ranked = lambda c, rank: F.transform(c, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), m["value"].alias("value")))
    base = F.array_sort(F.concat(ranked("a", 0), ranked("k", 1), ranked("h", 2)))
    d = d.withColumn("base", base)
    # Only tokens with a digit and a letter, clear of the base spans.
    apart = lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    mixed = lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]")
    d = d.withColumn("t", F.filter("t", lambda m: mixed(m) & apart(m)))
    found = materialize(d.select("doc_id", F.xxhash64("text").alias("h"), F.transform("base", lambda b: F.struct(b["start"], b["rank"], b["end"])).alias("base"), F.col("t").alias("t")), "secrets")
    tests = battery(found.where(F.size("t") > 0).select("doc_id", "h", F.explode("t").alias("t")).select("doc_id", "h", F.col("t.value").alias("token"), F.col("t.start").alias("start"), F.col("t.end").alias("end")).distinct())
    tests = materialize(tests.select("doc_id", "h", "token", "start", "end", "encoding", "n", "p_uniform", "p_runs", "p_serial", "p"), "secret-tests")
    limit = discovery_limit(tests, alpha)
    random = tests.crossJoin(F.broadcast(limit)).where(F.col("p") * F.col("mean_n") / F.col("n") <= F.col("limit"))  # one row
    random = random.groupBy(F.col("doc_id").alias("id"), F.col("h").alias("rh")).agg(F.collect_set(F.struct(F.col("start"), F.lit(3).alias("rank"), F.col("end"))).alias("extra"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    plain = found.where(F.size("t") == 0).withColumn("extra", none)
    tested = found.where(F.size("t") > 0).join(random, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("rh")), "left").withColumn("extra", F.coalesce("extra", none))
    out = plain.select("doc_id", "h", "base", "extra").unionByName(tested.select("doc_id", "h", "base", "extra"))
    return out.withColumn("spans", F.array_sort(F.concat(F.col("base").cast("array<struct<start:int,rank:int,end:int>>"), "extra"))).drop("extra")


def listed(spans: Column) -> Column:
    kind = lambda r: F.element_at(F.array(*[F.lit(k) for k in KINDS]), r + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s["rank"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """scan() as counts, a digest of the base spans and the list of all spans."""
    of = lambda rank: F.size(F.filter("base", lambda b: b["rank"] == rank)).cast("long")
    return scan(docs, alpha).select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(F.encode(listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", alpha: float = 0.05) -> DataFrame:
    """docs with the spans of scan() replaced by a mark, overlapping spans by one; n_chars, if there, follows.

    Only the documents with a span are rewritten; null texts stay null.
    """
    found = scan(docs, alpha).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("sid"), F.col("h").alias("sh")).agg(F.first("spans").alias("spans"))
    found = materialize(found, "redactions")
    n_bytes = found.agg(F.sum(F.size("spans") * 24 + 64)).collect()[0][0] or 0
    found = F.broadcast(found) if n_bytes <= BROADCAST_BYTES else found
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_column()).alias("h"))
    rows = rows.join(found, F.col("id").eqNullSafe(F.col("sid")) & (F.col("h") == F.col("sh")), "left").select("row", "spans")
    text = F.col("row.text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    rows = rows.withColumn("clean", F.when(F.col("spans").isNotNull(), clean).otherwise(text))
    new = {"text": F.col("clean")} | ({"n_chars": F.when(F.col("spans").isNotNull(), F.length("clean")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
