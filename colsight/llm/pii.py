"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.llm.shared import free_names
from colsight.llm.spans import Rule, add_spans, digest, digits, luhn, mod97, replaced, spans_sql

# Java forms of the base patterns. A run is entered at its first character or where the last match ended, and repeated
# parts give nothing back: the matches are those of the plain patterns, in time linear in the text and without recursion.
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
OCTETS = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
SPACED_ACCOUNT = r"[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?"
NATIONAL = "[0-9]{3}-[0-9]{2}-[0-9]{4}"
NOT_GIVEN = "^(?:000|666|9[0-9][0-9])|-00-|-0000$"
RULES = [
    Rule("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", base_score=0.7, context="mail|contact|write"),
    Rule("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", lambda v: v.rlike(OCTETS), 0.4, "ip|host|server|address|login"),
    Rule("card", r"[0-9](?:[\x20-]?+[0-9])++", lambda v: F.length(digits(v)).between(14, 19) & luhn(digits(v)), 0.6, "card|visa|credit|pay"),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(digits(v)).between(10, 15), 0.5, "phone|call|tel|mobile|fax"),
    Rule("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", mod97, 0.6, "iban|account|bank|transfer"),
    # these need a word nearby: by themselves they are below the limit
    Rule("account", SPACED_ACCOUNT, lambda v: mod97(F.replace(v, F.lit(" "), F.lit(""))), 0.4, "iban|account|bank|transfer"),
    Rule("national", NATIONAL, lambda v: ~v.rlike(NOT_GIVEN), 0.3, "ssn|social security|tax id|national id"),
]
BASE = ["email", "ip", "card", "phone"]
LEAST = 0.5
"""The score that a span of an added kind must reach."""


def find_pii(df: DataFrame, text_col: str = "text", rules: list[Rule] = RULES, min_score: float = LEAST) -> DataFrame:
    """``df`` with an array column ``pii_<kind>`` for each rule: start, stop (code points), value and score.

    Base kinds keep every confirmed span; an added kind keeps those whose score, which words nearby raise, reaches
    ``min_score``. A null or empty text has empty arrays. Rows are searched one by one, so repeated rows stay. All other
    columns stay; the new names must be free.
    """
    if taken := [f"pii_{r.kind}" for r in rules if f"pii_{r.kind}" in df.columns]:
        raise ValueError(f"columns exist already: {', '.join(taken)}")
    (text,) = free_names([*df.columns, *(f"pii_{r.kind}" for r in rules)], "text")
    df = df.withColumn(text, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    for rank, rule in enumerate(rules):
        df = add_spans(df, text, rule, rank, f"pii_{rule.kind}")
        if rule.kind not in BASE:
            df = df.withColumn(f"pii_{rule.kind}", F.filter(f"pii_{rule.kind}", lambda s: s["score"] >= min_score))
    return df.drop(text)


REDACTED_FIRST = ["iban", "account", "card", "national", "phone", "ip", "email"]


def redact_pii(df: DataFrame, text_col: str = "text", rules: list[Rule] = RULES, min_score: float = LEAST) -> DataFrame:
    """``df`` with the personal data that ``find_pii`` keeps replaced by marks such as <EMAIL>; a null text stays null.

    Rules apply one after the other, account codes and cards first, so that parts of a longer number go with it.
    """
    for rule in sorted(rules, key=lambda r: REDACTED_FIRST.index(r.kind) if r.kind in REDACTED_FIRST else len(REDACTED_FIRST)):
        df = replaced(df, text_col, rule, f"<{rule.kind.upper()}>", 0.0 if rule.kind in BASE else min_score)
    return df


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest, list and scores of the spans of every row; rows that repeat are reported again."""
    found = find_pii(docs.select(F.col(id_col), F.col(text_col)), text_col)
    return digest(found, id_col, {r.kind: f"pii_{r.kind}" for r in RULES}, BASE, scores=True)


def _digits_sql(low: int, high: int) -> str:
    return f"length(regexp_replace($m, '[^0-9]', '', 'g')) BETWEEN {low} AND {high}"


LUHN_SQL = (
    "list_sum(list_transform(range(1, length(regexp_replace($m, '[^0-9]', '', 'g')) + 1), lambda j: "
    "(CASE WHEN j % 2 = 0 THEN 2 ELSE 1 END) * CAST(substr(reverse(regexp_replace($m, '[^0-9]', '', 'g')), j, 1) AS INT)"
    " - (CASE WHEN j % 2 = 0 AND substr(reverse(regexp_replace($m, '[^0-9]', '', 'g')), j, 1) > '4' THEN 9 ELSE 0 END))) % 10 = 0"
)
MOD97_SQL = (
    "list_reduce(list_transform(string_split(substr($m, 5) || substr($m, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' "
    "THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, v: (CASE WHEN v < 10 THEN a * 10 + v ELSE a * 100 + v END) % 97) = 1"
)
PII_SQL = spans_sql(
    {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", f"regexp_matches($m, '{OCTETS}')"),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"{_digits_sql(14, 19)} AND {LUHN_SQL}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", _digits_sql(10, 15)),
        "iban": (r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", MOD97_SQL),
        "account": (SPACED_ACCOUNT, MOD97_SQL.replace("$m", "replace($m, ' ', '')")),
        "national": (NATIONAL, f"NOT regexp_matches($m, '{NOT_GIVEN}')"),
    },
    BASE,
    RULES,
    LEAST,
)
