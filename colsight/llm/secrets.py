"""Secrets by rules over a trigram index.

From each rule's regular expression follow trigrams that any match must hold: factors of literal strings, each an OR of
ANDs of trigrams. Postings are made for these trigrams only; a rule is verified on the documents in which the postings
meet its query. A rule without a mandatory trigram reads every text. Trigrams are over a-z case-folded text,
a superset of what either case of a rule needs.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.llm.shared import free_names
from colsight.llm.spans import Rule, add_spans, digest, spans_sql

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = [
    Rule("assign", ASSIGN, lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 6, 0.6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base_score=0.9),
    Rule("hex", r"[0-9a-f]{24,}", base_score=0.5),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", base_score=0.9),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", base_score=0.9),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", base_score=0.9),
    Rule("pem", r"-----BEGIN[A-Z\x20]{0,40}PRIVATE\x20KEY-----", base_score=0.9),
]
BASE = ["assign", "access", "hex"]
WORD = 62
"""Trigrams of a postings column."""
MOST_STRINGS = 64
"""A factor with more literal strings says nothing."""


def _strings(parsed) -> list[set[str] | None]:
    """The pieces of a parsed pattern in order: a set of literal strings, or None for what can be many things."""
    found: list[set[str] | None] = []
    for name, value in parsed:
        name = str(name)
        if name == "LITERAL":
            found.append({chr(value)})
        elif name == "IN" and all(str(k) in {"LITERAL", "RANGE"} for k, _ in value):
            one = {chr(c) for k, v in value for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))}
            found.append(one if len(one) <= 8 else None)
        elif name == "BRANCH":
            sides = [_joined(_strings(side)) for side in value[1]]
            found.append(set().union(*sides) if all(s is not None for s in sides) else None)
        elif name == "SUBPATTERN":
            found += _strings(value[3])
        elif name == "MAX_REPEAT" and value[1] <= 8 and (inner := _joined(_strings(value[2]))) is not None:
            found.append({"".join(x) for n in range(value[0], value[1] + 1) for x in product(inner, repeat=n)} if len(inner) ** value[1] <= MOST_STRINGS else None)
        else:
            found.append(None)
    return found


def _joined(pieces: list[set[str] | None]) -> set[str] | None:
    """All strings that the pieces make together, if they are few."""
    whole = {""}
    for piece in pieces:
        if piece is None or len(whole) * len(piece) > MOST_STRINGS:
            return None
        whole = {a + b for a in whole for b in piece}
    return whole


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """An AND of ORs of ANDs of trigrams that every match of the pattern holds; empty if there is none."""
    factors, run = [], {""}
    for piece in [*_strings(re._parser.parse(pattern)), None]:
        if piece is not None and len(run) * len(piece) <= MOST_STRINGS:
            run = {a + b for a in run for b in piece}
            continue
        if all(len(s) >= 3 for s in run):
            factors.append(sorted(sorted({s.lower()[i : i + 3] for i in range(len(s) - 2)}) for s in run))
        run = piece or {""}
    return factors


def _holds(mask: dict[str, Column], query: list[list[list[str]]]) -> Column:
    every = [reduce(Column.__or__, [reduce(Column.__and__, [mask[g] for g in side]) for side in factor]) for factor in query]
    return reduce(Column.__and__, every)


def find_secrets(df: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``df`` with an array column ``secret_<kind>`` for each rule: start, stop (code points), value and score.

    A row's postings, which of the wanted trigrams its text holds, are bits beside the row, so that queries meet them
    where the text is and nothing is shuffled. A null or empty text has empty arrays; rows are searched one by one, so
    repeated rows and null ids do not matter. All other columns stay; the new names must be free.
    """
    if taken := [f"secret_{r.kind}" for r in rules if f"secret_{r.kind}" in df.columns]:
        raise ValueError(f"columns exist already: {', '.join(taken)}")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    names = sorted({g for q in queries.values() for f in q for side in f for g in side})
    words = range(-(-len(names) // WORD))
    text, low, *inner = free_names([*df.columns, *(f"secret_{r.kind}" for r in rules)], "text", "low", *(f"postings_{w}" for w in words), *(f"try_{r.kind}" for r in rules))
    postings, tried = inner[: len(words)], dict(zip((r.kind for r in rules), inner[len(words) :], strict=True))
    df = df.withColumn(text, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).withColumn(low, F.lower(text))
    bits = [F.when(F.contains(low, F.lit(g)), F.lit(1 << i % WORD)).otherwise(F.lit(0)).cast("long") for i, g in enumerate(names)]
    df = df.withColumns({p: reduce(Column.bitwiseOR, bits[w * WORD : (w + 1) * WORD]) for w, p in zip(words, postings, strict=True)}).drop(low)
    holds = {g: F.col(postings[i // WORD]).bitwiseAND(F.lit(1 << i % WORD)) != 0 for i, g in enumerate(names)}
    df = df.withColumns({tried[k]: _holds(holds, q) for k, q in queries.items() if q})
    for rank, rule in enumerate(rules):
        df = add_spans(df, text, rule, rank, f"secret_{rule.kind}", F.col(tried[rule.kind]) if queries[rule.kind] else None)
    return df.drop(text, *inner)


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and list of the spans of every row; rows that repeat are reported again."""
    found = find_secrets(docs.select(F.col(id_col), F.col(text_col)), text_col)
    return digest(found, id_col, {r.kind: f"secret_{r.kind}" for r in RULES}, BASE)


_EITHER = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_ASSIGN_SQL = rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SECRETS_SQL = spans_sql(
    {
        "assign": (_ASSIGN_SQL, "length(regexp_extract($m, '" + _ASSIGN_SQL.replace("'", "''") + "', 2)) >= 6"),
        "access": ("AKIA[A-Z0-9]+", "length($m) >= 20"),
        "hex": ("[0-9a-f]+", "length($m) >= 24"),
        "github": (r"gh[oprsu]_[A-Za-z0-9]{36,}", "true"),
        "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
        "google": (r"AIza[0-9A-Za-z_-]{35}", "true"),
        "pem": (r"-----BEGIN[A-Z\x20]{0,40}PRIVATE\x20KEY-----", "true"),
    },
    BASE,
)
