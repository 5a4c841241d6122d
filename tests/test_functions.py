import math
import random

import pytest
from factloom.functions import normalize as N
from factloom.functions import text as T
from pyspark.sql import functions as F

CASES = [
    ("currency", "$5M", 5e6, "USD"), ("currency", "$5,000,000", 5e6, "USD"), ("currency", "5 million USD", 5e6, "USD"), ("currency", "€1.2B", 1.2e9, "EUR"), ("currency", "CAD 2 million", 2e6, "CAD"), ("currency", "several million dollars", None, None),
    ("currency", "5 millions", 5.0, "USD"), ("currency", "USDT 5", 5.0, "USD"), ("currency", "-5", -5.0, "USD"), ("currency", "1234,567", 1234.0, "USD"),
    ("percentage", "15%", 15.0, "percent"), ("percentage", "0.15", 15.0, "percent"), ("percentage", "1", 100.0, "percent"), ("percentage", "42", 42.0, "percent"), ("percentage", "0.5%", 0.5, "percent"), ("percentage", "a large share", None, None),
    ("count", "1,234 customers", 1234.0, "count"), ("count", "5k users", 5000.0, "count"), ("multiple", "1.8x", 1.8, "multiple"), ("multiple", "2.0×", 2.0, "multiple"), ("multiple", "1.5", 1.5, "multiple"),
    ("year", "vintage 2015", 2015.0, "year"), ("year", "12019", 2019.0, "year"), ("year", "recent vintage", None, None),
]


def test_normalizers(spark):
    rows = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "i int, kind string, raw string")
    v = None
    for kind in {c[0] for c in CASES}:
        one = F.when(F.col("kind") == kind, getattr(N, f"normalize_{kind}")(F.col("raw")))
        v = one if v is None else F.coalesce(v, one)
    for r in rows.select("i", v.alias("v")).collect():
        assert (r.v.numeric, r.v.unit) == CASES[r.i][2:], CASES[r.i]
        assert r.v.status == ("unparseable" if CASES[r.i][2] is None else "normalized")


@pytest.mark.parametrize(("kind", "raw", "scale", "want"), [
    ("fund_size", "365,000", 1e6, (3.65e11, "USD", None, "normalized")), ("revenue", "$5M", 1e6, (5e6, "USD", None, "normalized")), ("revenue", "$5M (3x growth)", None, (3.0, "multiple", None, "normalized")),
    ("net_irr", "18.5", None, (18.5, "percent", None, "normalized")), ("other", "2 Xerox deals", None, (2.0, "multiple", None, "normalized")), ("competitive_positioning", "  United   States ", None, (None, None, "united states", "normalized")),
    ("other", "   ", None, (None, None, None, "not_applicable")), ("other", None, None, (None, None, None, "not_applicable")), ("market_size", "a multi-billion dollar market", None, (None, None, None, "unparseable")), ("gp_commitment", "2%", None, (2.0, "percent", None, "normalized")), ("other", "Series B stage", None, (None, None, "series b stage", "normalized")),
])
def test_dispatch(spark, kind, raw, scale, want):
    row = spark.createDataFrame([(kind, raw, scale)], "k string, r string, s double").select(N.normalize_claim(F.col("r"), F.col("k"), F.col("s")).alias("v")).first()
    assert tuple(row.v) == want


def test_float_texts(spark):
    rng = random.Random(4)
    values = [0.0, 1.0, 4.2e6, 1.2e10, 1e16, 1.5e17, 0.001, 0.0005, -2.5, 123456.0, 1234567.0, 1e-5, 1.25e-7, 999999.5] + [round(rng.uniform(-1, 1) * 10 ** rng.randint(-3, 12), 3) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.python_float(F.col("v")).alias("p"), T.general(F.col("v")).alias("g")).collect()
    assert [(r.v, r.p) for r in rows] == [(v, repr(v)) for v in values]
    assert [(r.v, r.g) for r in rows] == [(v, f"{v:g}") for v in values]
    assert not any(math.isnan(r.v) for r in rows)
