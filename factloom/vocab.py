"""Closed vocabularies, multipliers, patterns and hints that results depend on."""

CLAIM_TYPES = ("market_size", "revenue", "team_background", "competitive_positioning", "funding_history", "customer_metrics", "net_irr", "tvpi", "dpi", "fund_size", "vintage_year", "gp_commitment", "other")
SECTION_TYPES = ("financial_data", "narrative_claim", "legal_boilerplate", "table", "other")
OPERATORS = ("gte", "lte", "eq", "contains", "in", "exists")
EVENT_TYPES = ("document_ingested", "classification_run", "extraction_run", "entity_resolved", "scoring_run", "query_executed", "pipeline_error")
MULTIPLIERS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mm": 1e6, "mn": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "t": 1e12, "trillion": 1e12}
SCALES = {"thousands": 1e3, "millions": 1e6, "billions": 1e9}
CURRENCY_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP"}
CURRENCY_CODES = ("USD", "EUR", "GBP", "CAD", "AUD", "JPY", "CHF")
CURRENCY_TYPES = ("market_size", "revenue", "funding_history", "fund_size")
PERCENT_TYPES, MULTIPLE_TYPES, TEXT_TYPES = ("net_irr",), ("tvpi", "dpi"), ("competitive_positioning",)
NUMBER = r"[-+]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[-+]?[0-9]+(?:\.[0-9]+)?|[-+]?\.[0-9]+"
MULTIPLE = r"([0-9]+(?:\.[0-9]+)?)\s*[xX×]"
SUFFIXES = ("inc", "corp", "corporation", "llc", "ltd", "co")
HINTS = {
    "market_size": ("market", "tam", "sam", "size", "opportunity"),
    "revenue": ("revenue", "arr", "mrr", "sales", "income", "topline"),
    "team_background": ("team", "founder", "ceo", "cto", "people", "hire"),
    "competitive_positioning": ("compete", "competitor", "moat", "position"),
    "funding_history": ("fund", "raise", "round", "seed", "series", "investor"),
    "customer_metrics": ("customer", "churn", "retention", "growth", "nps", "user"),
}
#: Rules of the offline extractor: pattern, claim type, subtype, in order.
EXTRACTION_RULES = (
    (r"(?i)ARR of (\$[0-9.,]+\s*[MBK]?)", "revenue", "ARR"),
    (r"(?i)revenue of (\$[0-9.,]+\s*[MBK]?)", "revenue", None),
    (r"(?i)(?:TAM|total addressable market)[^$]*(\$[0-9.,]+\s*[MBK]?)", "market_size", "TAM"),
    (r"(?i)raised (\$[0-9.,]+\s*[MBK]?)\s+(?:in\s+)?(series [a-z]|seed)", "funding_history", None),
    (r"(?i)([0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)\s+(?:paying\s+)?customers", "customer_metrics", "customer_count"),
    (r"(?i)growing ([0-9]+%)\s*(?:MoM|month)", "customer_metrics", "growth_rate"),
    (r"(?i)team of ([0-9]+)", "team_background", "team_size"),
)
COMPANY = r"[A-Z][A-Za-z]+\s+(?:Logistics|Technologies|Labs|Systems|Health)"
LEGAL_CUES = ("confidential", "disclaimer", "forward-looking")
#: US dollars per million tokens, in and out, and the output caps.
RATES = {"cheap": (1.0, 5.0), "capable": (3.0, 15.0)}
OUTPUT_CAPS = {"cheap": 1024, "capable": 4096}
PROSE_CHARS, EXCERPT_CHARS, PREAMBLE_CHARS, LABEL_CHARS = 4000, 500, 500, 60
TOKEN_RATIO, LINE_TOLERANCE, FUZZY_SCORE, EQ_TOLERANCE = 0.6, 3.0, 85.0, 1e-9
