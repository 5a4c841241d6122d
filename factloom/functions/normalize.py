"""Value normalization: free text into a number with a unit, or canonical text.

Each function returns struct<numeric double, unit string, text string, status string>. All are CASE
expressions over built-in functions, so a scan, its filter and the normalization are one stage. The number, the
scale word and the currency of a text are found once each and bound, as an expression that is used twice is
planned twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import is_blank, squeeze


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _found(x: Column) -> Column:
    """The first match, null for none."""
    return F.nullif(x, F.lit(""))


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once: the optimizer doesn't inline the argument of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def number_token(raw: Column) -> Column:
    return _found(F.regexp_substr(raw, F.lit(vocab.NUMBER)))


def _number(token: Column) -> Column:
    return F.regexp_replace(token, ",", "").try_cast("double")


def first_number(raw: Column) -> Column:
    """Leftmost number, grouped, plain or with a leading dot; null for none."""
    return _number(number_token(raw))


def _multiplier(raw: Column, token: Column) -> Column:
    rest = F.lower(F.regexp_replace(raw.substr(F.instr(raw, token) + F.length(token), F.length(raw)), r"(?U)^\s+", ""))
    return F.coalesce(F.try_element_at(_map(vocab.MULTIPLIERS), F.regexp_extract(rest, "^([a-z]+)", 1)), F.lit(1.0))


def multiplier(raw: Column) -> Column:
    """The scale word right after the first number, 1 if unknown."""
    return bound(F.struct(raw.alias("raw"), number_token(raw).alias("token")), lambda r: _multiplier(r["raw"], r["token"]))


def currency(raw: Column) -> Column:
    """Currency code by symbol, in a fixed priority, else by the first code among runs of three capitals; else null."""
    codes = F.filter(F.regexp_extract_all(raw, F.lit("([A-Z]{3})"), 1), lambda c: c.isin(*vocab.CURRENCY_CODES))
    out = F.get(codes, F.lit(0))
    for symbol, code in reversed(vocab.CURRENCY_SYMBOLS.items()):
        out = F.when(raw.contains(symbol), F.lit(code)).otherwise(out)
    return out


def detect_scale(text: Column) -> Column:
    """Multiplier of a document's "in thousands", "in millions" or "in billions"; null for none."""
    return F.try_element_at(_map(vocab.SCALES), F.lower(F.regexp_extract(text, r"(?iU)in\s+(thousands|millions|billions)", 1)))


def _value(numeric: Column, unit: Column) -> Column:
    """A number, or unparseable."""
    ok = lambda n: n.isNotNull()
    return bound(numeric, lambda n: F.struct(n.alias("numeric"), F.when(ok(n), unit).alias("unit"), F.lit(None).cast("string").alias("text"), F.when(ok(n), F.lit("normalized")).otherwise(F.lit("unparseable")).alias("status")))


def _text(text: Column, status: str) -> Column:
    return F.struct(F.lit(None).cast("double").alias("numeric"), F.lit(None).cast("string").alias("unit"), text.alias("text"), F.lit(status).alias("status"))


def _parsed(raw: Column, kind: Column | None = None, scale: Column | None = None) -> Column:
    """A text with what the normalizers read of it."""
    hint = F.coalesce(scale, F.lit(1.0)) if scale is not None else F.lit(1.0)
    return F.struct(raw.alias("raw"), number_token(raw).alias("token"), currency(raw).alias("currency"), (F.lit(None).cast("string") if kind is None else kind).alias("kind"), hint.alias("hint"))


def _currency(r: Column) -> Column:
    scaled = bound(_multiplier(r["raw"], r["token"]), lambda m: F.when(m != 1.0, m).otherwise(r["hint"]))
    return _value(_number(r["token"]) * scaled, F.coalesce(r["currency"], F.lit("USD")))


def _percentage(r: Column) -> Column:
    share = lambda n: F.when(r["raw"].contains("%"), n).when((n >= 0) & (n <= 1), n * 100).otherwise(n)
    return _value(bound(_number(r["token"]), share), F.lit("percent"))


def _count(r: Column) -> Column:
    return _value(_number(r["token"]) * _multiplier(r["raw"], r["token"]), F.lit("count"))


def _multiple(r: Column) -> Column:
    return _value(F.coalesce(_found(F.regexp_extract(r["raw"], vocab.MULTIPLE, 1)).try_cast("double"), _number(r["token"])), F.lit("multiple"))


def _year(r: Column) -> Column:
    return _value(_found(F.regexp_substr(r["raw"], F.lit("(19|20)[0-9]{2}"))).try_cast("double"), F.lit("year"))


def normalize_currency(raw: Column, scale: Column | None = None) -> Column:
    return bound(_parsed(raw, scale=scale), _currency)


def normalize_percentage(raw: Column) -> Column:
    return bound(_parsed(raw), _percentage)


def normalize_count(raw: Column) -> Column:
    return bound(_parsed(raw), _count)


def normalize_multiple(raw: Column) -> Column:
    return bound(_parsed(raw), _multiple)


def normalize_year(raw: Column) -> Column:
    return bound(_parsed(raw), _year)


def _dispatched(r: Column) -> Column:
    raw, kind = r["raw"], r["kind"]
    return (
        F.when(is_blank(raw), _text(F.lit(None).cast("string"), "not_applicable"))
        .when(kind.isin(*vocab.TEXT_TYPES), _text(squeeze(raw), "normalized"))
        .when(kind.isin(*vocab.MULTIPLE_TYPES) | raw.rlike(vocab.MULTIPLE), _multiple(r))
        .when(kind == "vintage_year", _year(r))
        .when(raw.contains("%") | kind.isin(*vocab.PERCENT_TYPES), _percentage(r))
        .when(kind.isin(*vocab.CURRENCY_TYPES) | r["currency"].isNotNull(), _currency(r))
        .when(r["token"].isNotNull(), _count(r))
        .otherwise(_text(squeeze(raw), "normalized"))
    )


def normalize_claim(raw: Column, claim_type: Column, scale: Column | None = None) -> Column:
    """The dispatcher; the first rule that applies decides. Null and blank values aren't applicable."""
    return bound(_parsed(raw, claim_type, scale), _dispatched)
