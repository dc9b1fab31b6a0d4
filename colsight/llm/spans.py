"""Spans of regular expressions as array columns, with DataFrame functions only.

A rule's matches and the gaps between them come from ``regexp_extract_all`` and ``split``; running sums of their lengths
are the positions (code points, end exclusive), added up in blocks so that texts with very many matches stay cheap.
Matches are leftmost and do not overlap within a rule; those that fail the rule's test are dropped and not tried again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.llm.shared import free_names

BLOCK = 256
SPAN = "struct<start:int,rank:int,stop:int,kind:string,value:string,score:double>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is for Java; ``base_score`` and ``context`` (words nearby, which add ``boost``) make the score."""

    kind: str
    pattern: str
    valid: Callable[[Column], Column] = field(default=lambda value: F.lit(True))
    base_score: float = 0.5
    context: str = ""
    boost: float = 0.3


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the Luhn test."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code, its first four characters moved to the end and letters read as 10 to 35, is 1 mod 97."""
    turned = F.split(F.concat(F.substring(code, 5, 1 << 30), F.substring(code, 1, 4)), "")

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(turned, F.lit(0), add) == 1


def _before(lengths: Column) -> Column:
    """The sum of all earlier lengths, for each length."""
    none = F.array().cast("array<int>")

    def step(a: Column, total: Column) -> Column:
        return F.struct((a["sum"] + total).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out"))

    start = F.struct(F.lit(0).alias("sum"), none.alias("out"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    inside = F.transform(parts, lambda part: F.aggregate(part, start, step))
    shifts = F.aggregate(inside, start, lambda a, x: step(a, x["sum"]))["out"]
    return F.flatten(F.zip_with(inside, shifts, lambda x, shift: F.transform(x["out"], lambda v: v + shift)))


def add_matches(df: DataFrame, text: str, rule: Rule, found: str, gaps: str, on: Column | None = None) -> DataFrame:
    """Columns ``found`` and ``gaps`` of a rule (null without a match); ``on``: where the rule is tried at all."""
    hits = F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(0))
    df = df.withColumn(found, hits if on is None else F.when(on, hits))
    return df.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, rule.pattern, -1)))


def _score(rule: Rule, gaps: str, i: Column) -> Column:
    """A match's score: that of its kind, and more where a context word stands at most 40 signs before or 20 behind it."""
    if not rule.context:
        return F.lit(rule.base_score)
    around = F.lower(F.concat(F.substring(F.get(gaps, i), -40, 40), F.lit(" "), F.substring(F.get(gaps, i + 1), 1, 20)))
    return F.round(F.lit(rule.base_score) + F.when(around.rlike(rule.context), rule.boost).otherwise(0.0), 2)


def add_spans(df: DataFrame, text: str, rule: Rule, rank: int, out: str, on: Column | None = None) -> DataFrame:
    """Column ``out``: the rule's spans in order, an empty array if there are none."""
    found, gaps, sizes, begin = free_names([*df.columns, out], "hits", "gaps", "sizes", "begin")
    df = add_matches(df, text, rule, found, gaps, on)
    df = df.withColumn(sizes, F.when(F.size(found) > 0, F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.length(g) + F.length(h))))
    df = df.withColumn(begin, F.when(F.size(found) > 0, _before(F.col(sizes))))

    def span(hit: Column, i: Column) -> Column:
        start = F.get(begin, i) + F.length(F.get(gaps, i))
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(hit)).alias("stop"), F.lit(rule.kind).alias("kind"), hit.alias("value"), _score(rule, gaps, i).alias("score"))

    spans = F.filter(F.transform(found, span), lambda s: rule.valid(s["value"]))
    df = df.withColumn(out, F.coalesce(F.when(F.size(found) > 0, spans), F.array()).cast(f"array<{SPAN}>"))
    return df.drop(found, gaps, sizes, begin)


def replaced(df: DataFrame, text: str, rule: Rule, mark: str, least: float = 0.0) -> DataFrame:
    """The text with the rule's valid matches of at least a score replaced by a mark."""
    found, gaps = free_names(df.columns, "hits", "gaps")
    df = add_matches(df, text, rule, found, gaps)

    def piece(gap: Column, i: Column) -> Column:
        hit = F.get(found, i)
        good = rule.valid(hit) if least <= rule.base_score else rule.valid(hit) & (_score(rule, gaps, i) >= least)
        return F.concat(gap, F.when(hit.isNull(), "").when(good, mark).otherwise(hit))

    return df.withColumn(text, F.when(F.size(found) > 0, F.array_join(F.transform(gaps, piece), "")).otherwise(F.col(text))).drop(found, gaps)


def listed(spans: Column) -> Column:
    """kind:start:stop of sorted spans, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digest(df: DataFrame, id_col: str, spans: dict[str, str], base: list[str], scores: bool = False) -> DataFrame:
    """The id, a count n_<kind> for each base kind, the digest of the base spans, and all spans listed.

    ``spans``: column of each kind. With ``scores`` also the scores of the listed spans in their order, as whole per cent.
    """
    more = [F.array_join(F.transform(F.array_sort(F.concat(*spans.values())), lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores")] if scores else []
    counts = [F.size(spans[kind]).cast("long").alias(f"n_{kind}") for kind in base]
    return df.select(id_col, *counts, F.sha2(listed(F.concat(*(spans[k] for k in base))), 256).alias("base_sha256"), listed(F.concat(*spans.values())).alias("spans"), *more)


def spans_sql(rules: dict[str, tuple[str, str]], base: list[str], scored: list[Rule] | None = None, least: float = 0.0) -> str:
    """DuckDB SQL for ``digest``: rules are kind -> (plain pattern, condition on the match ``m``). ``scored`` rules give the
    scores; kinds beyond the base ones then need a score of ``least``."""
    cols, parts = [], []
    for rank, (kind, (pattern, valid)) in enumerate(rules.items()):
        p = pattern.replace("'", "''")
        cols.append(f"regexp_extract_all(t, '{p}') AS h{rank}, string_split_regex(t, '{p}') AS g{rank}")
        start = f"CAST(list_sum(list_transform(g{rank}[1:i], lambda q: length(q))) + coalesce(list_sum(list_transform(h{rank}[1:i - 1], lambda q: length(q))), 0) AS BIGINT)"
        rule = next((r for r in scored or [] if r.kind == kind), None)
        score = "0"
        if rule:
            around = f"lower(right(g{rank}[i], 40) || ' ' || left(g{rank}[i + 1], 20))"
            score = f"{round(rule.base_score * 100)} + CASE WHEN regexp_matches({around}, '{rule.context}') THEN {round(rule.boost * 100)} ELSE 0 END"
        enough = f" AND x.p >= {round(least * 100)}" if rule and kind not in base else ""
        parts.append(
            f"list_filter(list_transform(range(1, len(h{rank}) + 1), lambda i: {{'s': {start}, 'r': {rank}, 'k': '{kind}', 'm': h{rank}[i], 'p': {score}}}), lambda x: {valid.replace('$m', 'x.m')}{enough}) AS s{rank}"
        )
    show = "list_transform(list_sort({}), lambda x: x.k || ':' || x.s || ':' || (x.s + length(x.m)))"
    joined = lambda kinds: " || ".join(f"s{list(rules).index(k)}" for k in kinds)
    join = lambda kinds: f"coalesce(array_to_string({show.format(joined(kinds))}, ','), '')"
    counts = ", ".join(f"CAST(len(s{list(rules).index(k)}) AS BIGINT) AS n_{k}" for k in base)
    more = f", coalesce(array_to_string(list_transform(list_sort({joined(list(rules))}), lambda x: CAST(x.p AS VARCHAR)), ','), '') AS scores" if scored else ""
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), h AS (SELECT doc_id, {', '.join(cols)} FROM d), "
        f"s AS (SELECT doc_id, {', '.join(parts)} FROM h) "
        f"SELECT doc_id, {counts}, sha256({join(base)}) AS base_sha256, {join(list(rules))} AS spans{more} FROM s"
    )
