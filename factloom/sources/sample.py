"""Sample pages: a deck of ten pages with a table, in place of a parsed file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schemas import SCHEMAS

TEXTS = (
    "Harbor Logistics\nSeries A overview",
    "Harbor Logistics is a B2B SaaS platform for port operators\nHeadquartered in the United States",
    "The total addressable market for port software is $4.1B\nPorts still plan berths by hand",
    "Harbor Logistics reached ARR of $1.8M and is growing 12% MoM",
    "Financial summary\nRevenue by year in thousands",
    "The platform serves 64 paying customers in nine countries",
    "A team of 17 with two founders from the shipping trade",
    "Harbor Logistics raised $3.5M in seed two years ago",
    "Competitors sell licences; we sell by the berth",
    "Confidential. Forward-looking statements may change.",
)
TABLE = [["Year", "Revenue", "Costs", "Customers"], ["2022", "$300", "$900", "11"], ["2023", "$900", "$1,500", "31"], ["2024", "$1,800", "$2,100", "64"]]


def words(text: str) -> list[tuple]:
    """Words on lines of 20 points, 6 points a letter."""
    out = []
    for i, line in enumerate(text.split("\n")):
        x = 40.0
        for w in line.split():
            out.append((w, x, x + 6.0 * len(w), 50.0 + 20 * i, 62.0 + 20 * i))
            x += 6.0 * len(w) + 4
    return out


def sample_pages(spark: SparkSession, deal_id: str = "sample") -> DataFrame:
    rows = [(deal_id, n, t, [TABLE] if n == 5 else [], False, [], words(t)) for n, t in enumerate(TEXTS, 1)]
    return spark.createDataFrame(rows, SCHEMAS["pages"])
