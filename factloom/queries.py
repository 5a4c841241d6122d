"""Queries over the test tables, one per operator, and the same in SQL.

The tables have no deals, so a view makes claims of orders: a customer is a deal, an order a fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .functions import normalize as N
from .functions import text as T
from .operators import chunking, extraction, retrieval, scoring, spans
from .sources.store import checkpoint_dir, criteria_frame, latest_scores, page_count
from .streaming.audit import rollup

MANDATE = {
    "mandate_id": "m1", "mandate_version": 1, "fund_name": "Sample Fund",
    "criteria": [
        {"name": "Revenue floor", "claim_type": "revenue", "operator": "gte", "threshold": 150000, "threshold_unit": "USD", "weight": 0.3, "is_knockout": True},
        {"name": "Revenue ceiling", "claim_type": "revenue", "operator": "lte", "threshold": 400000, "threshold_unit": "USD", "weight": 0.15},
        {"name": "Recurring revenue", "claim_type": "revenue", "claim_subtype": "arr", "operator": "gte", "threshold": 200000, "threshold_unit": "USD", "weight": 0.15},
        {"name": "Multiple", "claim_type": "tvpi", "operator": "eq", "threshold": 1.8, "threshold_unit": "multiple", "weight": 0.1},
        {"name": "Urgent", "claim_type": "competitive_positioning", "operator": "contains", "threshold": "URGENT", "weight": 0.1},
        {"name": "Graded", "claim_type": "competitive_positioning", "operator": "in", "threshold": ["B2B 2-HIGH", "b2b 1-urgent"], "weight": 0.1},
        {"name": "Any customers", "claim_type": "customer_metrics", "operator": "exists", "weight": 0.05, "is_knockout": True},
        {"name": "Wrong unit", "claim_type": "revenue", "operator": "gte", "threshold": 1, "threshold_unit": "EUR", "weight": 0.05},
    ],
}
FORMS = {
    "currency": ("$1,234.5", "€1.2B", "£500k", "CAD 2 million", "USDT 5", "5 millions", "none", "-3.5 mm", ".15 bn"),
    "percent": ("15%", "0.15", "1", "42", "-5%", "a large share", ".5", "100%"),
    "count": ("1,234 customers", "5k users", "3 million users", "12", "1234,567", "no users"),
    "multiple": ("1.8x", "2.0×", "1.5", "3.2X net", "7 x", "no multiple"),
    "year": ("2018", "vintage 2015", "12019", "1899", "recent"),
    "text": ("  United   States ", "Series B\tstage", "ABC", "a", ""),
}


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# --- views ---------------------------------------------------------------------


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Facts before normalization: deal_id, fact_id, ord, claim_type, claim_value and the rest of a record."""
    o = _read(spark, d, "orders")
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("revenue", "customer_metrics", "tvpi", "net_irr", "competitive_positioning")]), (k % 5 + 1).cast("int"))
    value = (
        F.when(k % 5 == 0, F.concat(F.lit("$"), F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("k")))
        .when(k % 5 == 1, F.concat((k % 700).cast("string"), F.lit(" customers")))
        .when(k % 5 == 2, F.concat(F.floor(k % 4).cast("string"), F.lit("."), (F.floor(k / 5) % 10).cast("string"), F.lit("x")))
        .when(k % 5 == 3, F.concat((k % 40).cast("string"), F.lit(".5")))
        .otherwise(F.concat(F.lit("  B2B  "), F.col("o_orderpriority"), F.lit(" ")))
    )
    sub = F.when(k % 3 == 0, F.lit("ARR run rate")).when(k % 3 == 1, F.lit("booked"))
    return o.select(
        F.col("o_custkey").cast("string").alias("deal_id"), k.cast("string").alias("fact_id"), k.cast("long").alias("ord"), kind.alias("claim_type"), value.alias("claim_value"), sub.alias("claim_subtype_raw"),
        F.concat(F.lit("Entity "), (k % 7).cast("string")).alias("entity_name"), F.concat(F.lit("e"), (k % 7).cast("string")).alias("entity_id"), (k % 9).cast("int").alias("source_page"),
        F.concat(F.lit("The "), kind, F.lit(" market was "), value).alias("source_excerpt"), ((k % 11) / 10.0).alias("confidence_score"),
    )


def facts(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d).withColumn("n", N.normalize_claim(F.col("claim_value"), F.col("claim_type")))
    return c.select("*", F.col("n.numeric").alias("normalized_value_numeric"), F.col("n.unit").alias("normalized_value_unit"), F.col("n.text").alias("normalized_value_text"), F.col("n.status").alias("normalization_status")).drop("n")


def deals(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("deal_id"))


def _forms(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Each part with one of the forms of a kind, its number put before it for part of them."""
    p = _read(spark, d, "part")
    form = F.element_at(F.array(*[F.lit(x) for x in FORMS[kind]]), (F.col("p_partkey") % len(FORMS[kind]) + 1).cast("int"))
    return p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, form).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" "), form)).alias("raw"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _forms_sql(kind: str) -> str:
    n = len(FORMS[kind])
    form = f"({_sql_list(FORMS[kind])})[p_partkey % {n} + 1]"
    return f"forms AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {form} ELSE p_size || ' ' || {form} END AS raw FROM part)"


CLAIMS_SQL = """claims AS (SELECT CAST(o_custkey AS VARCHAR) AS deal_id, CAST(o_orderkey AS VARCHAR) AS fact_id, o_orderkey AS ord,
  (['revenue', 'customer_metrics', 'tvpi', 'net_irr', 'competitive_positioning'])[o_orderkey % 5 + 1] AS claim_type,
  CASE o_orderkey % 5 WHEN 0 THEN '$' || CAST(floor(o_totalprice / 1000) AS BIGINT) || 'k' WHEN 1 THEN (o_orderkey % 700) || ' customers'
    WHEN 2 THEN (o_orderkey % 4) || '.' || (o_orderkey // 5 % 10) || 'x' WHEN 3 THEN (o_orderkey % 40) || '.5' ELSE '  B2B  ' || o_orderpriority || ' ' END AS claim_value,
  CASE o_orderkey % 3 WHEN 0 THEN 'ARR run rate' WHEN 1 THEN 'booked' END AS claim_subtype_raw, 'Entity ' || (o_orderkey % 7) AS entity_name, 'e' || (o_orderkey % 7) AS entity_id,
  CAST(o_orderkey % 9 AS INTEGER) AS source_page, (o_orderkey % 11) / 10.0::DOUBLE AS confidence_score FROM orders)"""


def _number_sql(x: str) -> str:
    return f"TRY_CAST(replace(nullif(regexp_extract({x}, '{vocab.NUMBER}'), ''), ',', '') AS DOUBLE)"


def _multiplier_sql(x: str) -> str:
    token = f"regexp_extract({x}, '{vocab.NUMBER}')"
    word = f"regexp_extract(lower(ltrim(substr({x}, strpos({x}, {token}) + length({token})))), '^([a-z]+)', 1)"
    return f"CASE {word} " + " ".join(f"WHEN '{k}' THEN {v:.1f}" for k, v in vocab.MULTIPLIERS.items()) + " ELSE 1.0 END"


def _currency_sql(x: str) -> str:
    symbols = " ".join(f"WHEN contains({x}, '{s}') THEN '{c}'" for s, c in vocab.CURRENCY_SYMBOLS.items())
    return f"CASE {symbols} ELSE list_filter(regexp_extract_all({x}, '[A-Z]{{3}}'), lambda c: c IN {tuple(vocab.CURRENCY_CODES)})[1] END"


def _squeeze_sql(x: str) -> str:
    return rf"regexp_replace(trim(lower({x}), E' \t\n\r'), '\s+', ' ', 'g')"


def _dispatch_sql(x: str, kind: str) -> tuple[str, str, str, str]:
    """SQL of numeric, unit, text, status of the dispatcher."""
    n, m, cur = _number_sql(x), _multiplier_sql(x), _currency_sql(x)
    multiple = f"coalesce(TRY_CAST(nullif(regexp_extract({x}, '{vocab.MULTIPLE}', 1), '') AS DOUBLE), {n})"
    percent = f"CASE WHEN contains({x}, '%') THEN {n} WHEN {n} BETWEEN 0 AND 1 THEN {n} * 100 ELSE {n} END"
    route = f"""CASE WHEN {x} IS NULL OR trim({x}, E' \\t\\n\\r') = '' THEN 'blank' WHEN {kind} = 'competitive_positioning' THEN 'text'
      WHEN {kind} IN ('tvpi', 'dpi') OR regexp_matches({x}, '{vocab.MULTIPLE}') THEN 'multiple' WHEN {kind} = 'vintage_year' THEN 'year'
      WHEN contains({x}, '%') OR {kind} = 'net_irr' THEN 'percent' WHEN {kind} IN {vocab.CURRENCY_TYPES} OR ({cur}) IS NOT NULL THEN 'currency'
      WHEN {n} IS NOT NULL THEN 'count' ELSE 'text' END"""
    numeric = f"""CASE {route} WHEN 'multiple' THEN {multiple} WHEN 'year' THEN TRY_CAST(nullif(regexp_extract({x}, '(19|20)[0-9]{{2}}'), '') AS DOUBLE)
      WHEN 'percent' THEN {percent} WHEN 'currency' THEN {n} * ({m}) WHEN 'count' THEN {n} * ({m}) END"""
    unit = f"CASE {route} WHEN 'currency' THEN coalesce({cur}, 'USD') WHEN 'blank' THEN NULL WHEN 'text' THEN NULL ELSE {route} END"
    text = f"CASE {route} WHEN 'text' THEN {_squeeze_sql(x)} END"
    return numeric, unit, text, route


def _flat(raw: str, v) -> list:
    return [v["numeric"].alias("num"), v["unit"].alias("unit"), v["text"].alias("txt"), v["status"].alias("status")]


def _norm(kind: str, fn):
    def query(spark: SparkSession, d: str) -> DataFrame:
        f = _forms(spark, d, kind).withColumn("v", fn(F.col("raw")))
        return f.select("p_partkey", "raw", F.col("v.numeric").alias("num"), F.col("v.unit").alias("unit"), F.col("v.status").alias("status"))

    return query


def _norm_sql(kind: str, numeric: str, unit: str) -> str:
    return f"WITH {_forms_sql(kind)}, v AS (SELECT *, {numeric} AS num FROM forms) SELECT p_partkey, raw, num, CASE WHEN num IS NOT NULL THEN {unit} END AS unit, CASE WHEN num IS NULL THEN 'unparseable' ELSE 'normalized' END AS status FROM v"


Q: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    Q[name] = query
    if sql:
        SQL[name] = sql


_n, _m = _number_sql("raw"), _multiplier_sql("raw")
_add("norm_currency", _norm("currency", N.normalize_currency), _norm_sql("currency", f"{_n} * ({_m})", f"coalesce({_currency_sql('raw')}, 'USD')"))
_add("norm_percent", _norm("percent", N.normalize_percentage), _norm_sql("percent", f"CASE WHEN contains(raw, '%') THEN {_n} WHEN {_n} BETWEEN 0 AND 1 THEN {_n} * 100 ELSE {_n} END", "'percent'"))
_add("norm_count", _norm("count", N.normalize_count), _norm_sql("count", f"{_n} * ({_m})", "'count'"))
_add("norm_multiple", _norm("multiple", N.normalize_multiple), _norm_sql("multiple", f"coalesce(TRY_CAST(nullif(regexp_extract(raw, '{vocab.MULTIPLE}', 1), '') AS DOUBLE), {_n})", "'multiple'"))
_add("norm_year", _norm("year", N.normalize_year), _norm_sql("year", "TRY_CAST(nullif(regexp_extract(raw, '(19|20)[0-9]{2}'), '') AS DOUBLE)", "'year'"))
_add("norm_text", lambda s, d: _forms(s, d, "text").select("p_partkey", T.squeeze(F.col("raw")).alias("txt")), f"WITH {_forms_sql('text')} SELECT p_partkey, {_squeeze_sql('raw')} AS txt FROM forms")


def _dispatched(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for k in FORMS:
        f = _forms(spark, d, k).select("p_partkey", F.lit(k).alias("form"), "raw")
        out = f if out is None else out.unionByName(f)
    kinds = F.array(*[F.lit(x) for x in vocab.CLAIM_TYPES])
    out = out.withColumn("claim_type", F.element_at(kinds, (F.col("p_partkey") % len(vocab.CLAIM_TYPES) + 1).cast("int")))
    return out.withColumn("v", N.normalize_claim(F.col("raw"), F.col("claim_type")))


def _dispatched_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT p_partkey, '{k}' AS form, raw FROM (WITH {_forms_sql(k)} SELECT * FROM forms)" for k in FORMS)
    num, unit, text, route = _dispatch_sql("raw", "claim_type")
    return f"""typed AS (SELECT *, ({_sql_list(vocab.CLAIM_TYPES)})[p_partkey % {len(vocab.CLAIM_TYPES)} + 1] AS claim_type FROM ({parts})),
      v AS (SELECT *, {num} AS num, {unit} AS unit0, {text} AS txt, {route} AS route FROM typed),
      dispatched AS (SELECT p_partkey, form, claim_type, num, CASE WHEN num IS NOT NULL THEN unit0 END AS unit, txt,
        CASE route WHEN 'blank' THEN 'not_applicable' WHEN 'text' THEN 'normalized' ELSE CASE WHEN num IS NULL THEN 'unparseable' ELSE 'normalized' END END AS status FROM v)"""


_add("norm_dispatch", lambda s, d: _dispatched(s, d).select("p_partkey", "form", "claim_type", *_flat("raw", F.col("v"))), f"WITH {_dispatched_sql()} SELECT * FROM dispatched")
_add("norm_status_rollup", lambda s, d: _dispatched(s, d).groupBy("claim_type", F.col("v.status").alias("status")).agg(F.count("*").alias("n")), f"WITH {_dispatched_sql()} SELECT claim_type, status, count(*) AS n FROM dispatched GROUP BY ALL")


def norm_scale_hint(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = _read(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("string").alias("raw"), F.element_at(F.array(F.lit("(In millions)"), F.lit("all in  THOUSANDS of USD"), F.lit("margin billions"), F.lit("none")), (k % 4 + 1).cast("int")).alias("header"))
    v = N.normalize_claim(F.col("raw"), F.lit("fund_size"), N.detect_scale(F.col("header")))
    return o.select("o_orderkey", N.detect_scale(F.col("header")).alias("scale"), v["numeric"].alias("num"))


_add("norm_scale_hint", norm_scale_hint, "WITH o AS (SELECT o_orderkey, floor(o_totalprice) AS v, (['(In millions)', 'all in  THOUSANDS of USD', 'margin billions', 'none'])[o_orderkey % 4 + 1] AS header FROM orders), s AS (SELECT *, CASE lower(regexp_extract(header, '(?i)in\\s+(thousands|millions|billions)', 1)) WHEN 'thousands' THEN 1e3 WHEN 'millions' THEN 1e6 WHEN 'billions' THEN 1e9 END AS scale FROM o) SELECT o_orderkey, CAST(scale AS DOUBLE) AS scale, v * coalesce(scale, 1) AS num FROM s")
_add("display_value", lambda s, d: facts(s, d).select("fact_id", retrieval.display_value(F.col("normalized_value_numeric"), F.col("normalized_value_unit"), F.col("normalized_value_text")).alias("shown")), None)

# --- scoring ---------------------------------------------------------------------


def _facts_sql() -> str:
    num, unit, text, _ = _dispatch_sql("claim_value", "claim_type")
    return f"{CLAIMS_SQL}, facts AS (SELECT *, {num} AS num, {unit} AS unit, {text} AS txt FROM claims)"


def _criteria_sql() -> str:
    q = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"
    rows = []
    for pos, c in enumerate(MANDATE["criteria"]):
        t = c.get("threshold")
        rows.append(f"({pos}, {q(c['name'])}, {q(c['claim_type'])}, {q(c.get('claim_subtype'))}, '{c['operator']}', {float(t) if isinstance(t, (int, float)) else 'NULL::DOUBLE'}, {q(t) if isinstance(t, str) else 'NULL'}, {_sql_list(sorted(x.lower() for x in t)) if isinstance(t, list) else 'NULL::VARCHAR[]'}, {q(c.get('threshold_unit'))}, {c['weight']}::DOUBLE, {bool(c.get('is_knockout'))})")
    return "criteria(pos, name, kind, sub, op, t, tt, tl, tu, weight, ko) AS (VALUES " + ", ".join(rows) + ")"


SCORE_SQL = f"""WITH {_facts_sql()}, {_criteria_sql()},
m AS (SELECT f.*, c.*, CASE op WHEN 'contains' THEN contains(coalesce(nullif(txt, ''), lower(claim_value)), lower(tt)) WHEN 'in' THEN list_contains(tl, coalesce(nullif(txt, ''), lower(claim_value))) WHEN 'exists' THEN true ELSE false END AS hit
  FROM facts f JOIN criteria c ON f.claim_type = c.kind AND (c.sub IS NULL OR contains(lower(f.claim_subtype_raw), lower(c.sub)))
  WHERE op NOT IN ('gte', 'lte', 'eq') OR (num IS NOT NULL AND (tu IS NULL OR unit IS NOT DISTINCT FROM tu))),
r AS (SELECT *, row_number() OVER (PARTITION BY deal_id, pos ORDER BY CASE op WHEN 'gte' THEN -num WHEN 'lte' THEN num WHEN 'eq' THEN abs(num - t) ELSE CASE WHEN hit THEN 0 ELSE 1 END END, ord) AS place FROM m),
g AS (SELECT deal_id, pos, count(*) AS n, count(*) FILTER (hit) AS n_hit, max(num) FILTER (place = 1) AS v,
  string_agg(fact_id, ',' ORDER BY place) FILTER (place <= 3) AS top3, max(fact_id) FILTER (place = 1) AS top1, string_agg(fact_id, ',' ORDER BY place) FILTER (place <= 3 AND hit) AS hits3 FROM r GROUP BY 1, 2),
e AS (SELECT CAST(c_custkey AS VARCHAR) AS deal_id, c.*, coalesce(n, 0) AS n, coalesce(n_hit, 0) AS n_hit, v, top3, top1, hits3,
  coalesce(CASE op WHEN 'gte' THEN v >= t WHEN 'lte' THEN v <= t WHEN 'eq' THEN abs(v - t) <= 1e-9 * greatest(abs(t), 1) WHEN 'exists' THEN n > 0 ELSE n_hit > 0 END, false) AS met
  FROM customer CROSS JOIN criteria c LEFT JOIN g ON g.deal_id = CAST(c_custkey AS VARCHAR) AND g.pos = c.pos),
evaluated AS (SELECT deal_id, pos, name, op, met, ko, weight, n, CASE WHEN op IN ('gte', 'lte', 'eq') THEN coalesce(top1, '') WHEN op = 'exists' THEN coalesce(top3, '') ELSE coalesce(hits3, top1, '') END AS used, v, t, tu, kind, tt, tl FROM e)
"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    return scoring.evaluate(deals(spark, d), facts(spark, d), criteria_frame(spark, MANDATE))


def _one(*names: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        chosen = {**MANDATE, "criteria": [c for c in MANDATE["criteria"] if c["name"] in names]}
        out = scoring.evaluate(deals(spark, d), facts(spark, d), criteria_frame(spark, chosen))
        used = F.array_join(F.transform("facts_used", lambda f: f["fact_id"]), ",")
        return out.select("deal_id", F.col("criterion_name").alias("name"), "met", used.alias("used"))

    return query


for _name, _criteria in {"score_numeric_gte": ("Revenue floor",), "score_numeric_lte": ("Revenue ceiling",), "score_numeric_eq": ("Multiple",), "score_contains": ("Urgent",), "score_in": ("Graded",), "score_exists": ("Any customers",), "score_subscope": ("Recurring revenue",), "score_unit": ("Revenue floor", "Wrong unit")}.items():
    _add(_name, _one(*_criteria), SCORE_SQL + f"SELECT deal_id, name, met, used FROM evaluated WHERE name IN ({', '.join(repr(c) for c in _criteria)})")
_add("score_weights", lambda s, d: scoring.weights(criteria_frame(s, MANDATE)).select("pos", F.round("share", 9).alias("share")), f"WITH {_criteria_sql()} SELECT pos, round(weight / sum(weight) OVER (), 9) AS share FROM criteria")
_TOTAL_SQL = SCORE_SQL + """, per AS (SELECT deal_id, coalesce(bool_or(ko AND NOT met), false) AS knockout, arg_max(name, pos) FILTER (ko AND NOT met) AS knockout_name, sum(CASE WHEN met THEN weight ELSE 0 END) / sum(weight) AS w FROM evaluated GROUP BY 1) """


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(deals(spark, d), facts(spark, d), criteria_frame(spark, MANDATE))


_add("score_total", lambda s, d: _scores(s, d).select("deal_id", F.round("total_score", 6).alias("total"), "facts_evaluated"), _TOTAL_SQL + "SELECT deal_id, round(CASE WHEN knockout THEN 0 ELSE least(w * 100, 100) END, 6) AS total, (SELECT count(*) FROM claims c WHERE c.deal_id = per.deal_id) AS facts_evaluated FROM per")
_add("score_knockout", lambda s, d: _scores(s, d).select("deal_id", "knockout_triggered", "knockout_criterion_name", "scoring_notes"), _TOTAL_SQL + "SELECT deal_id, knockout AS knockout_triggered, knockout_name AS knockout_criterion_name, CASE WHEN knockout THEN 'Knockout criterion ''' || knockout_name || ''' failed; total forced to 0 regardless of 8 criteria.' ELSE 'Weighted score across 8 criteria.' END AS scoring_notes FROM per")
_add("score_trace", lambda s, d: _evaluated(s, d).select("deal_id", "pos", "met", F.array_join(F.transform("facts_used", lambda f: F.concat_ws(":", f["fact_id"], f["contribution_direction"])), ",").alias("trace")), SCORE_SQL + "SELECT deal_id, pos, met, CASE WHEN used = '' THEN '' ELSE list_aggregate(list_transform(string_split(used, ','), lambda x: x || ':' || CASE WHEN met THEN 'supports' ELSE 'contradicts' END), 'string_agg', ',') END AS trace FROM evaluated")
_add("score_explain", lambda s, d: _evaluated(s, d).select("deal_id", "pos", "explanation"), SCORE_SQL + """SELECT deal_id, pos, CASE WHEN op = 'exists' THEN CASE WHEN met THEN 'Found ' || n || ' fact(s) of type ''' || kind || '''.' ELSE 'No fact of type ''' || kind || ''' was found.' END
  WHEN op IN ('gte', 'lte', 'eq') THEN CASE WHEN n = 0 THEN 'No comparable ''' || kind || ''' value with unit ''' || tu || ''' was found.'
    ELSE CAST(v AS VARCHAR) || ' ' || tu || ' ' || CASE op WHEN 'gte' THEN '>=' WHEN 'lte' THEN '<=' ELSE '==' END || ' ' || CAST(t AS VARCHAR) || ' ' || tu || ' -> ' || CASE WHEN met THEN 'met' ELSE 'not met' END || '.' END
  WHEN n = 0 THEN 'No ''' || kind || ''' fact to test.'
  WHEN op = 'contains' THEN '''' || lower(tt) || '''' || CASE WHEN met THEN ' found in a matching fact.' ELSE ' not present in any matching fact.' END
  ELSE CASE WHEN met THEN 'A matching fact value is in ' ELSE 'No matching fact value is in ' END || '[' || list_aggregate(list_transform(tl, lambda x: '''' || x || ''''), 'string_agg', ', ') || '].' END AS explanation FROM evaluated""")


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("score_id"), F.col("o_custkey").cast("string").alias("deal_id"), F.round("o_totalprice", 2).alias("total_score"), F.col("o_orderdate").alias("scored_at"))


_LATEST_SQL = "latest AS (SELECT deal_id, score_id, total_score FROM (SELECT CAST(o_orderkey AS VARCHAR) AS score_id, CAST(o_custkey AS VARCHAR) AS deal_id, round(o_totalprice, 2) AS total_score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS k FROM orders) WHERE k = 1)"
_add("latest_score", lambda s, d: latest_scores(_snapshots(s, d)).select("deal_id", "score_id", "total_score"), f"WITH {_LATEST_SQL} SELECT * FROM latest")


def list_deals(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "customer")
    docs = c.select(F.col("c_custkey").cast("string").alias("deal_id"), F.when(F.col("c_custkey") % 3 > 0, F.create_map(F.lit("deal_name"), F.col("c_name"))).alias("source_metadata"), F.timestamp_seconds(F.lit(1_600_000_000) + F.col("c_custkey")).alias("ingested_at"))
    return retrieval.list_deals(docs, claims(spark, d), _snapshots(spark, d)).drop("ingested_at")


_add("list_deals", list_deals, f"WITH {CLAIMS_SQL}, {_LATEST_SQL}, n AS (SELECT deal_id, count(*) AS n FROM claims GROUP BY 1) SELECT CAST(c_custkey AS VARCHAR) AS deal_id, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE '' END AS deal_name, coalesce(n, 0) AS fact_count, total_score FROM customer LEFT JOIN n ON n.deal_id = CAST(c_custkey AS VARCHAR) LEFT JOIN latest l ON l.deal_id = CAST(c_custkey AS VARCHAR)")

# --- retrieval ---------------------------------------------------------------------

QUESTION = "How large is the market, revenue or customers of entity 3? urgent"
_tok = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
_q = _sql_list(retrieval.query_tokens(QUESTION))
_hint = " ".join(f"WHEN '{k}' THEN {3 * len(set(w) & set(retrieval.query_tokens(QUESTION)))}" for k, w in vocab.HINTS.items())
SEARCH_SQL = f"""WITH {CLAIMS_SQL}, s AS (SELECT *, CASE claim_type {_hint} ELSE 0 END + 2 * len(list_intersect({_q}, {_tok('entity_name')})) + len(list_intersect({_q}, {_tok("'The ' || claim_type || ' market was ' || claim_value")})) + len(list_intersect({_q}, {_tok('claim_value')})) AS s0 FROM claims),
ranked AS (SELECT *, s0 + 0.1 * confidence_score AS relevance, row_number() OVER (PARTITION BY deal_id ORDER BY s0 + 0.1::DOUBLE * confidence_score DESC, ord) AS place FROM s WHERE s0 > 0) """
_add("retrieve_topk", lambda s, d: retrieval.search(facts(s, d), QUESTION, 5).select("deal_id", "place", "fact_id", F.round("relevance", 6).alias("relevance")), SEARCH_SQL + "SELECT deal_id, place, fact_id, CAST(round(relevance, 6) AS DOUBLE) AS relevance FROM ranked WHERE place <= 5")
_add("retrieve_related", lambda s, d: retrieval.related_criteria(retrieval.search(facts(s, d), QUESTION, 2), criteria_frame(s, MANDATE)), SEARCH_SQL + f", {_criteria_sql()} SELECT DISTINCT deal_id, pos, name FROM ranked JOIN criteria ON claim_type = kind WHERE place <= 2")

# --- chunks, labels, records ---------------------------------------------------------


def doc_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages, blank lines between their lines; a deal has the pages of ten ids."""
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return _read(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).cast("string").alias("deal_id"), F.col("doc_id").cast("int").alias("page_number"), text.alias("raw_text"), F.array().cast("array<array<array<string>>>").alias("tables"))


def chunk_prose(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunk_pages(doc_pages(spark, d))
    return c.select("deal_id", "chunk_index", F.get("source_pages", F.lit(0)).alias("page"), F.length("content").alias("n"), F.md5("content").alias("digest"))


_BLANK = r"E' \t\n\r\x0b\x0c'"
_STEP = f"""CASE WHEN acc.now <> '' AND length(acc.now) + length(p.now) + 2 > 4000 THEN {{'done': list_append(acc.done, trim(acc.now, {_BLANK})), 'now': p.now}}
  WHEN acc.now = '' THEN {{'done': acc.done, 'now': p.now}} ELSE {{'done': acc.done, 'now': acc.now || E'\\n\\n' || p.now}} END"""
_add("chunk_prose", chunk_prose, f"""WITH p AS (SELECT CAST(doc_id // 10 AS VARCHAR) AS deal_id, doc_id, replace(text, E'\\n', E'\\n\\n') AS t FROM documents),
f AS (SELECT *, CASE WHEN length(t) > 4000 THEN list_reduce(list_transform(string_split(t, E'\\n\\n'), lambda x: {{'done': []::VARCHAR[], 'now': x}}), lambda acc, p: {_STEP}, {{'done': []::VARCHAR[], 'now': ''}}) END AS packed FROM p),
s AS (SELECT deal_id, doc_id, CASE WHEN length(t) <= 4000 THEN CASE WHEN trim(t, {_BLANK}) = '' THEN [] ELSE [t] END WHEN trim(packed.now, {_BLANK}) = '' THEN packed.done ELSE list_append(packed.done, trim(packed.now, {_BLANK})) END AS seg FROM f),
u AS (SELECT deal_id, doc_id, unnest(seg) AS content, generate_subscripts(seg, 1) AS k FROM s)
SELECT deal_id, CAST(row_number() OVER (PARTITION BY deal_id ORDER BY doc_id, k) - 1 AS INTEGER) AS chunk_index, CAST(doc_id AS INTEGER) AS page, CAST(length(content) AS INTEGER) AS n, md5(content) AS digest FROM u""")


def chunk_tables(spark: SparkSession, d: str) -> DataFrame:
    n = _read(spark, d, "nation")
    per = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.array(F.lpad(F.col("n_nationkey").cast("string"), 3, " "), F.when(F.col("n_nationkey") % 4 > 0, F.col("n_name"))))).alias("t"))
    pages = per.select(F.col("n_regionkey").cast("string").alias("deal_id"), F.lit(1).alias("page_number"), F.when(F.col("n_regionkey") % 2 == 0, F.lit("Nations of a region")).otherwise(F.lit("  ")).alias("raw_text"), F.array("t", F.array(F.array(F.lit(" ")))).alias("tables"))
    return chunking.chunk_pages(pages).select("deal_id", "chunk_index", "contains_table", "content")


_add("chunk_tables", chunk_tables, r"""WITH t AS (SELECT n_regionkey AS r, string_agg(n_nationkey || ' | ' || CASE WHEN n_nationkey % 4 > 0 THEN trim(n_name) ELSE '' END, chr(10) ORDER BY lpad(CAST(n_nationkey AS VARCHAR), 3, ' ')) AS body FROM nation GROUP BY 1)
SELECT CAST(r AS VARCHAR) AS deal_id, 0 AS chunk_index, false AS contains_table, 'Nations of a region' AS content FROM t WHERE r % 2 = 0
UNION ALL SELECT CAST(r AS VARCHAR), CASE WHEN r % 2 = 0 THEN 1 ELSE 0 END, true, CASE WHEN r % 2 = 0 THEN 'Nations of a region' || chr(10) || chr(10) || '[TABLE]' || chr(10) ELSE '' END || body FROM t""")


def _cued(spark: SparkSession, d: str) -> DataFrame:
    cue = F.element_at(F.array(F.lit(" This is CONFIDENTIAL."), F.lit(" $5 | total"), F.lit(" [TABLE]"), F.lit(" plain"), F.lit(" Forward-Looking")), (F.col("doc_id") % 5 + 1).cast("int"))
    return _read(spark, d, "documents").select("doc_id", F.concat("text", cue).alias("content"))


_CUED = "c AS (SELECT doc_id, text || ([' This is CONFIDENTIAL.', ' $5 | total', ' [TABLE]', ' plain', ' Forward-Looking'])[doc_id % 5 + 1] AS content FROM documents), l AS (SELECT doc_id, CASE WHEN regexp_matches(lower(content), 'confidential|disclaimer|forward-looking') THEN 'legal_boilerplate' WHEN contains(lower(content), '[table]') OR (contains(content, '$') AND contains(content, '|')) THEN 'financial_data' ELSE 'narrative_claim' END AS section_type FROM c)"
_add("classify_rules", lambda s, d: chunking.classify(_cued(s, d)).select("doc_id", "section_type"), f"WITH {_CUED} SELECT * FROM l")
_add("extractable", lambda s, d: chunking.extractable(chunking.classify(_cued(s, d))).groupBy("section_type").agg(F.count("*").alias("n")), f"WITH {_CUED} SELECT section_type, count(*) AS n FROM l WHERE section_type <> 'legal_boilerplate' GROUP BY 1")


def rendered(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with sentences that the offline extractor knows, one per customer; some lines are longer than an excerpt."""
    c = _read(spark, d, "customer")
    k, bal = F.col("c_custkey"), F.floor(F.abs("c_acctbal")).cast("string")
    company = F.concat(F.lit("Acme"), F.when(k % 2 == 0, F.lit(" Labs")).otherwise(F.lit(" Partners")), F.lit(" reports"))
    sales = F.concat(F.lit("ARR of $"), bal, F.lit("K, and revenue of $"), (k % 90).cast("string"), F.lit(".5M."))
    team = F.concat(F.lit("  A team of "), (k % 50).cast("string"), F.lit(" serves "), (k % 900).cast("string"), F.lit(" paying customers, growing "), (k % 30).cast("string"), F.lit("% MoM"))
    team = F.concat(team, F.when(k % 11 == 0, F.concat(F.lit(" "), F.repeat(F.lit("x"), 600))).otherwise(F.lit("")))
    market = F.when(k % 4 == 0, F.concat(F.lit("The TAM of ports is $"), (k % 40).cast("string"), F.lit("B")))
    raised = F.when(k % 5 == 0, F.concat(F.lit("It raised $"), (k % 9).cast("string"), F.lit(".5M in seed")))
    cues = F.when(k % 3 == 0, F.lit("A B2B SaaS firm headquartered in the United States"))
    return c.select(k.cast("string").alias("deal_id"), F.concat(F.lit("c"), k.cast("string")).alias("chunk_id"), F.lit(0).alias("chunk_index"), F.array(F.lit(1)).alias("source_pages"), F.concat_ws("\n", company, sales, team, market, raised, cues).alias("content"))


#: lines: what rendered() makes, by line; records: what the rules find in it, with the line they stand on.
_RECORDS = """c AS (SELECT c_custkey AS k, CAST(floor(abs(c_acctbal)) AS BIGINT) AS bal, CASE WHEN c_custkey % 2 = 0 THEN 'Acme Labs' ELSE 'the company' END AS who FROM customer),
lines AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'Acme Labs reports' ELSE 'Acme Partners reports' END AS l1, 'ARR of $' || bal || 'K, and revenue of $' || (k % 90) || '.5M.' AS l2,
  'A team of ' || (k % 50) || ' serves ' || (k % 900) || ' paying customers, growing ' || (k % 30) || '% MoM' || CASE WHEN k % 11 = 0 THEN ' ' || repeat('x', 600) ELSE '' END AS l3,
  CASE WHEN k % 4 = 0 THEN 'The TAM of ports is $' || (k % 40) || 'B' END AS l4, CASE WHEN k % 5 = 0 THEN 'It raised $' || (k % 9) || '.5M in seed' END AS l5,
  CASE WHEN k % 3 = 0 THEN 'A B2B SaaS firm headquartered in the United States' END AS l6 FROM c),
pages AS (SELECT *, concat_ws(chr(10), l1, l2, '  ' || l3, l4, l5, l6) AS content, 3 AS i4, 3 + CASE WHEN l4 IS NULL THEN 0 ELSE 1 END AS i5 FROM lines),
found AS (SELECT k, 0 AS rule, who, 'revenue' AS t, 'ARR' AS s, '$' || bal || 'K' AS v, l2 AS e, 1 AS line, 0.88 AS f FROM pages UNION ALL SELECT k, 1, who, 'revenue', NULL, '$' || (k % 90) || '.5M', l2, 1, 0.88 FROM pages
UNION ALL SELECT k, 2, 'global logistics market', 'market_size', 'TAM', '$' || (k % 40) || 'B', l4, i4, 0.88 FROM pages WHERE l4 IS NOT NULL
UNION ALL SELECT k, 3, who, 'funding_history', NULL, '$' || (k % 9) || '.5M', l5, i5, 0.88 FROM pages WHERE l5 IS NOT NULL
UNION ALL SELECT k, 4, who, 'customer_metrics', 'customer_count', CAST(k % 900 AS VARCHAR), l3, 2, 0.88 FROM pages UNION ALL SELECT k, 5, who, 'customer_metrics', 'growth_rate', (k % 30) || '%', l3, 2, 0.88 FROM pages
UNION ALL SELECT k, 6, who, 'team_background', 'team_size', CAST(k % 50 AS VARCHAR), l3, 2, 0.88 FROM pages
UNION ALL SELECT k, 7, who, 'competitive_positioning', NULL, 'B2B SaaS platform', l6, i5 + CASE WHEN l5 IS NULL THEN 0 ELSE 1 END, 0.9 FROM pages WHERE l6 IS NOT NULL
UNION ALL SELECT k, 8, who, 'other', 'geography', 'Headquartered in the United States', l6, i5 + CASE WHEN l5 IS NULL THEN 0 ELSE 1 END, 0.85 FROM pages WHERE l6 IS NOT NULL),
records AS (SELECT *, substr(e, 1, 500) AS excerpt, row_number() OVER (PARTITION BY k ORDER BY rule) - 1 AS o FROM found)"""


def extract_rules(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract_by_rules(rendered(spark, d)).select("deal_id", "ord", "entity", "claim_type", "claim_subtype_raw", "claim_value", "source_excerpt", F.col("confidence").cast("double").alias("confidence"))


_add("extract_rules", extract_rules, f"WITH {_RECORDS} SELECT CAST(k AS VARCHAR) AS deal_id, CAST(o AS INTEGER) AS ord, who AS entity, t AS claim_type, s AS claim_subtype_raw, v AS claim_value, excerpt AS source_excerpt, CAST(f AS DOUBLE) AS confidence FROM records")


def rendered_pages(spark: SparkSession, d: str) -> DataFrame:
    """The chunks as pages with words on a grid, a line of text to a row of it."""
    words = F.transform(F.split("content", "\n"), lambda line, i: F.transform(F.filter(F.split(line, " "), lambda w: w != ""), lambda w, j: F.struct(w.alias("text"), (j * 50).cast("double").alias("x0"), (j * 50 + 40).cast("double").alias("x1"), (i * 20).cast("double").alias("top"), (i * 20 + 12).cast("double").alias("bottom"))))
    return rendered(spark, d).select("deal_id", F.lit(1).alias("page_number"), F.col("content").alias("raw_text"), F.array().cast("array<array<array<string>>>").alias("tables"), F.flatten(words).alias("words"))


def _ingested(pages: DataFrame):
    """The ingest pipeline with its stages in the checkpoint folder."""
    from .plans.engine import run_pipeline

    checkpoint_dir(pages.sparkSession)
    return run_pipeline(pages, written=lambda _, rows: rows.checkpoint())


def ingest_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of all pages with the names of their entities, spans and boxes."""
    out = _ingested(rendered_pages(spark, d))
    f = extraction.attach_entities(out.facts, out.entities)
    return f.select("deal_id", F.col("ord").cast("int").alias("ord"), "entity_name", "claim_type", F.col("normalized_value_numeric").alias("num"), F.col("normalized_value_unit").alias("unit"), F.col("source_char_start").alias("span_start"), F.col("source_char_end").alias("span_end"), "span_verification", F.to_json("source_bbox").alias("box"))


def _ingest_sql() -> str:
    num, unit, _, _ = _dispatch_sql("v", "t")
    return f"""WITH {_RECORDS}, placed AS (SELECT r.*, strpos(p.content, r.excerpt) AS place, len(string_split(r.excerpt, ' ')) AS n FROM records r JOIN pages p USING (k)),
valued AS (SELECT *, {num} AS num, {unit} AS unit0 FROM placed)
SELECT CAST(k AS VARCHAR) AS deal_id, CAST(o AS INTEGER) AS ord, who AS entity_name, t AS claim_type, num, CASE WHEN num IS NOT NULL THEN unit0 END AS unit, CAST(place - 1 AS INTEGER) AS span_start, CAST(place - 1 + length(excerpt) AS INTEGER) AS span_end,
  'verified_exact' AS span_verification, '[{{"x0":0.0,"top":' || (line * 20) || '.0,"x1":' || (n * 50 - 10) || '.0,"bottom":' || (line * 20 + 12) || '.0}}]' AS box FROM valued"""


_add("ingest_facts", ingest_facts, _ingest_sql())


def classify_answers(spark: SparkSession, d: str) -> DataFrame:
    """A model's answers, good and malformed, as labels."""
    k = F.col("p_partkey")
    forms = [F.lit('x {"section_type": " Table ", "confidence": 3} y'), F.lit('{"section_type": "nope"}'), F.lit("[1]"), F.concat(F.lit('{"section_type": "financial_data", "confidence": 0.'), (k % 10).cast("string"), F.lit("}")), F.lit("")]
    answer = F.element_at(F.array(*forms), (k % 5 + 1).cast("int"))
    return _read(spark, d, "part").select("p_partkey", chunking.parse_classification(answer).alias("c")).select("p_partkey", "c.section_type", "c.confidence")


_add("classify_answers", classify_answers, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'table' WHEN 3 THEN 'financial_data' ELSE 'other' END AS section_type, CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 3 THEN CAST('0.' || (p_partkey % 10) AS DOUBLE) ELSE 0 END::DOUBLE AS confidence FROM part")
_add("page_count", lambda s, d: page_count(_read(s, d, "orders").select(F.col("o_custkey").cast("string").alias("deal_id"))), "SELECT CAST(o_custkey AS VARCHAR) AS deal_id, CAST(count(*) AS INTEGER) AS page_count FROM orders GROUP BY 1")


def extract_json(spark: SparkSession, d: str) -> DataFrame:
    """Answers with good, malformed and out-of-domain elements."""
    p = _read(spark, d, "part")
    k = F.col("p_partkey").cast("string")
    good = F.concat(F.lit('{"entity": " '), F.col("p_brand"), F.lit(' ", "claim_type": " Revenue ", "claim_value": "$'), k, F.lit('k", "source_excerpt": "line '), k, F.lit('", "confidence": "1.7"}'))
    odd = F.concat(F.lit('7, {"claim_type": "nonsense", "claim_value": "'), k, F.lit(' units", "source_excerpt": "x", "confidence": "high"}'))
    answer = F.when(F.col("p_partkey") % 5 == 0, F.lit("no answer")).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("["), good, F.lit(", oops]"))).otherwise(F.concat(F.lit("Here: ["), good, F.lit(", "), odd, F.lit("] done")))
    a = p.select(k.alias("deal_id"), k.alias("chunk_id"), F.lit(0).alias("chunk_index"), F.array(F.lit(1)).alias("source_pages"), answer.alias("answer"))
    return extraction.coerce(extraction.parse_records(a)).select("deal_id", "ord", "entity", "claim_type", "claim_subtype_raw", "claim_value", "source_excerpt", "confidence_score")


_add("extract_json", extract_json, """WITH p AS (SELECT p_partkey AS k, p_brand FROM part WHERE p_partkey % 5 > 1)
SELECT CAST(k AS VARCHAR) AS deal_id, 0 AS ord, p_brand AS entity, 'revenue' AS claim_type, NULL AS claim_subtype_raw, '$' || k || 'k' AS claim_value, 'line ' || k AS source_excerpt, 1.0::DOUBLE AS confidence_score FROM p
UNION ALL SELECT CAST(k AS VARCHAR), 2, 'unknown', 'other', 'unmapped: ' || k || ' units', k || ' units', 'x', 0.5 FROM p""")


def variants(spark: SparkSession, d: str) -> DataFrame:
    """Supplier names in several spellings, as mentions of a nation's deal."""
    s = _read(spark, d, "supplier")
    k = F.col("s_suppkey")
    base = F.concat(F.lit("Supplier "), (k % 17).cast("string"))
    name = F.element_at(F.array(F.concat(base, F.lit(" Inc.")), F.concat(F.upper(base), F.lit(", LLC")), F.concat(F.lit(" "), base, F.lit("  corp")), base), (k % 4 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("team_background"), F.lit("market_size"), F.lit("revenue")), (k % 3 + 1).cast("int"))
    return s.select((F.col("s_nationkey") % 5).cast("string").alias("deal_id"), name.alias("entity"), kind.alias("claim_type"), F.lit(0).alias("chunk_index"), k.alias("ord"))


_VARIANTS = """v AS (SELECT CAST(s_nationkey % 5 AS VARCHAR) AS deal_id, s_suppkey AS ord, 'supplier ' || (s_suppkey % 17) AS match_key, trim((['Supplier ' || (s_suppkey % 17) || ' Inc.', 'SUPPLIER ' || (s_suppkey % 17) || ', LLC', ' Supplier ' || (s_suppkey % 17) || '  corp', 'Supplier ' || (s_suppkey % 17)])[s_suppkey % 4 + 1]) AS name, (['person', 'market', 'company'])[s_suppkey % 3 + 1] AS kind FROM supplier),
f AS (SELECT deal_id, match_key, name, min(ord) AS o, arg_min(kind, ord) AS kind FROM v GROUP BY 1, 2, 3)"""
_add("entity_resolve", lambda s, d: extraction.resolve_entities(variants(s, d)).select("deal_id", "match_key", "canonical_name", "entity_type"), f"WITH {_VARIANTS} SELECT deal_id, match_key, arg_min(name, o) AS canonical_name, arg_min(kind, o) AS entity_type FROM f GROUP BY 1, 2")
_add("entity_alias", lambda s, d: extraction.resolve_entities(variants(s, d)).select("deal_id", "match_key", F.array_join("aliases", ";").alias("aliases")), f"WITH {_VARIANTS}, n AS (SELECT *, row_number() OVER (PARTITION BY deal_id, match_key ORDER BY o) AS k FROM f) SELECT deal_id, match_key, coalesce(string_agg(name, ';' ORDER BY o) FILTER (k > 1), '') AS aliases FROM n GROUP BY 1, 2")

# --- spans and boxes ---------------------------------------------------------------


def span_exact(spark: SparkSession, d: str) -> DataFrame:
    """All test items against all documents."""
    b = _read(spark, d, "benchmark").select("item_id", F.col("text").alias("excerpt"))
    pairs = spans.exact_pairs(_read(spark, d, "documents").select("doc_id", "text"), b)
    return pairs.select("doc_id", "item_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "status")


_add("span_exact", span_exact, "SELECT doc_id, item_id, CAST(CASE WHEN p > 0 THEN p - 1 END AS INTEGER) AS span_start, CAST(CASE WHEN p > 0 THEN p - 1 + length(e) END AS INTEGER) AS span_end, CASE WHEN p > 0 THEN 'verified_exact' ELSE 'unverified' END AS status FROM (SELECT doc_id, item_id, b.text AS e, strpos(d.text, b.text) AS p FROM documents d CROSS JOIN benchmark b)")


def span_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Each test item with letters changed, between two sentences of itself and another."""
    b = _read(spark, d, "benchmark")
    changed = F.concat(F.substring("text", 1, 20), F.lit("#"), F.expr("substring(text, 22)"))
    rows = b.select(F.col("item_id").cast("string").alias("id"), F.when(F.col("item_id") % 4 == 3, F.reverse("text")).otherwise(changed).alias("excerpt"), F.concat(F.lit("Before it. "), "text", F.lit(" And after.")).alias("text"))
    return spans.verify_spans(rows).select("id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "status")


_add("span_fuzzy", span_fuzzy)


def laid_out(spark: SparkSession, d: str) -> DataFrame:
    """All words of all documents on a grid of ten a line, with an excerpt from any place of the text."""
    docs = _read(spark, d, "documents").select("doc_id", F.split("text", r"\s+").alias("w"))
    words = F.transform("w", lambda t, i: F.struct(t.alias("text"), ((i % 10) * 50).cast("double").alias("x0"), ((i % 10) * 50 + 40).cast("double").alias("x1"), (F.floor(i / 10) * 20).cast("double").alias("top"), (F.floor(i / 10) * 20 + 12).cast("double").alias("bottom")))
    at = F.pmod(F.col("doc_id") * 7919, F.greatest(F.size("w") - 11, F.lit(1))) + 1
    excerpt = F.concat(F.array_join(F.slice("w", at.cast("int"), 12), " "), F.when(F.col("doc_id") % 4 == 0, F.lit(" extra words at the end")).otherwise(F.lit("")))
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("id"), words.alias("words"), excerpt.alias("excerpt"))


_LOCATED = r"""d AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, regexp_split_to_array(text, '\s+') AS w FROM documents), y AS (SELECT *, CAST(doc_id * 7919 % greatest(len(w) - 11, 1) + 1 AS BIGINT) AS place FROM d),
x AS (SELECT id, w, string_split(array_to_string(w[place : place + 11], ' ') || CASE WHEN doc_id % 4 = 0 THEN ' extra words at the end' ELSE '' END, ' ') AS e FROM y),
n AS (SELECT id, list_filter(list_transform(w, lambda t, i: {'t': regexp_replace(lower(t), '[^a-z0-9]', '', 'g'), 'i': i - 1}), lambda t: t.t <> '') AS w, list_filter(list_transform(e, lambda t: regexp_replace(lower(t), '[^a-z0-9]', '', 'g')), lambda t: t <> '') AS e FROM x),
p AS (SELECT id, len(w) AS n, len(e) AS m, unnest(w).t AS t, unnest(w).i AS i, generate_subscripts(w, 1) - 1 AS pp FROM n), q AS (SELECT id, unnest(e) AS t, generate_subscripts(e, 1) - 1 AS ep FROM n),
v AS (SELECT p.id, m, pp - ep AS s, count(*) AS score FROM p JOIN q ON p.id = q.id AND p.t = q.t WHERE pp - ep BETWEEN 0 AND greatest(n - m, 0) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, s) AS k FROM v),
located AS (SELECT id, CAST(s AS INTEGER) AS start, CAST(score AS INTEGER) AS score, CAST(m AS INTEGER) AS window FROM r WHERE k = 1 AND score / m >= 0.6)"""
_add("bbox_locate", lambda s, d: spans.locate(laid_out(s, d)).select("id", "start", "score", "window"), f"WITH {_LOCATED} SELECT * FROM located")
_add("bbox_boxes", lambda s, d: spans.locate_boxes(laid_out(s, d)).where("source_bbox is not null").select("id", F.size("source_bbox").alias("lines"), F.to_json("source_bbox").alias("boxes")), f"""WITH {_LOCATED},
line AS (SELECT p.id, p.i // 10 AS y, min(p.i % 10) AS a, max(p.i % 10) AS b FROM p JOIN located l ON p.id = l.id AND p.pp >= l.start AND p.pp < l.start + l.window GROUP BY 1, 2)
SELECT id, CAST(count(*) AS INTEGER) AS lines, '[' || string_agg('{{"x0":' || (a * 50) || '.0,"top":' || (y * 20) || '.0,"x1":' || (b * 50 + 40) || '.0,"bottom":' || (y * 20 + 12) || '.0}}', ',' ORDER BY y) || ']' AS boxes FROM line GROUP BY id""")

# --- conflicts, audit, integrity ------------------------------------------------------

_CONFLICT = "GROUP BY 1, 2, 3 HAVING count(DISTINCT {}) > 1"
_add("conflicts_numeric", lambda s, d: scoring.numeric_conflicts(facts(s, d)), f"WITH {_facts_sql()} SELECT deal_id, entity_id, claim_type, count(DISTINCT (num, unit)) AS n_values FROM facts WHERE num IS NOT NULL AND unit IS NOT NULL {_CONFLICT.format('(num, unit)')}")
_add("conflicts_text", lambda s, d: scoring.text_conflicts(facts(s, d)), f"WITH {_facts_sql()} SELECT deal_id, entity_id, claim_type, count(DISTINCT txt) AS n_values FROM facts WHERE txt IS NOT NULL {_CONFLICT.format('txt')}")


def audit(spark: SparkSession, d: str) -> DataFrame:
    """Events as an audit log: every third event hangs on the one before, and some name their root."""
    e, i = _read(spark, d, "events"), F.col("event_id")
    parent = F.when(i % 3 > 0, (i - 1).cast("string"))
    rows = e.select(i.cast("string").alias("event_id"), "event_type", F.col("ts").alias("occurred_at"), parent.alias("parent_event_id"), F.when(i % 3 == 2, (i - 2).cast("string")).alias("root_event_id"), F.element_at(F.array(F.lit("cheap"), F.lit("capable"), F.lit("other")), (i % 3 + 1).cast("int")).alias("model_id"), (F.col("user_id") % 97).cast("string").alias("deal_id"), retrieval.token_estimate(F.col("event_type"), F.col("props")).alias("token_count_input"), (i % 50).alias("token_count_output"))
    return retrieval.audit_events(rows).withColumn("estimated_cost_usd", retrieval.cost(F.col("model_id"), F.col("token_count_input"), F.col("token_count_output")))


def chained(spark: SparkSession, d: str) -> DataFrame:
    """Events in chains of two hundred, each hanging on the one before."""
    i = F.col("event_id")
    return _read(spark, d, "events").select(i.cast("string").alias("event_id"), F.when(i % 200 > 0, (i - 1).cast("string")).alias("parent_event_id"))


_AUDIT = "a AS (SELECT *, CASE event_id % 3 WHEN 0 THEN (tin * 1.0 + tout * 5.0) / 1e6 WHEN 1 THEN (tin * 3.0 + tout * 15.0) / 1e6 ELSE 0 END AS cost FROM (SELECT *, (length(event_type) + length(props)) // 4 AS tin, event_id % 50 AS tout, CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN event_id - 1 ELSE event_id - 2 END AS root FROM events))"
_add("audit_rollup", lambda s, d: audit(s, d).groupBy("root_event_id").agg(F.count("*").alias("n"), F.round(F.sum("estimated_cost_usd"), 9).alias("cost")), f"WITH {_AUDIT} SELECT CAST(root AS VARCHAR) AS root_event_id, count(*) AS n, round(CAST(sum(cost) AS DOUBLE), 9) AS cost FROM a GROUP BY 1")
_add("audit_chain", lambda s, d: retrieval.true_roots(chained(s, d)), "WITH RECURSIVE up AS (SELECT event_id AS e, event_id AS o FROM events UNION ALL SELECT e, o - 1 FROM up WHERE o % 200 > 0) SELECT CAST(e AS VARCHAR) AS event_id, CAST(min(o) AS VARCHAR) AS origin FROM up GROUP BY e")
_add("audit_cost", lambda s, d: retrieval.cost_totals(audit(s, d)).select("deal_id", F.round("cost_usd", 9).alias("cost_usd")), f"WITH {_AUDIT} SELECT CAST(user_id % 97 AS VARCHAR) AS deal_id, round(CAST(sum(cost) AS DOUBLE), 9) AS cost_usd FROM a GROUP BY 1")
_add("audit_windows", lambda s, d: rollup(audit(s, d)).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n"), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
_add("dedup_hash", lambda s, d: extraction.latest_first(_read(s, d, "documents").select(F.col("doc_id").alias("deal_id"), F.sha2("text", 256).alias("file_hash"), F.timestamp_seconds("doc_id").alias("ingested_at"))).select("deal_id", "file_hash"), "SELECT max(doc_id) AS deal_id, sha256(text) AS file_hash FROM documents GROUP BY sha256(text)")
_add("integrity_anti", lambda s, d: _read(s, d, "orders").select("o_orderkey").join(_read(s, d, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"), "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")


def run_counters(spark: SparkSession, d: str) -> DataFrame:
    pages = rendered_pages(spark, d)
    out = _ingested(pages)
    return retrieval.run_counters(pages, out.chunks, out.facts, out.entities)


_add("run_counters", run_counters, f"WITH {_RECORDS} SELECT CAST(k AS VARCHAR) AS deal_id, 1 AS pages, 1 AS chunks, count(*) AS facts, count(DISTINCT who) AS entities FROM records GROUP BY k")

SQL["display_value"] = f"WITH {_facts_sql()} SELECT fact_id, CASE WHEN num IS NOT NULL THEN rtrim(printf('%g', num) || ' ' || coalesce(unit, '')) ELSE txt END AS shown FROM facts"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Customers scored against a mandate."""
    return _scores(spark, d).select("deal_id", "total_score", "knockout_triggered", "knockout_criterion_name", "facts_evaluated", "scoring_notes")
