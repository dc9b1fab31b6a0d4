"""Delimited text in: all-text rows, malformed-row capture, guards, preview.

Files are read as lines by every task, also one large file and also where quoted cells hold line breaks. One pass counts
the quotes of each byte range; running sums of their parities say in which ranges a quoted cell is open at the begin.
With that each range is cut into records on its own. A record that goes on in the next ranges leaves a fragment in each,
and only those fragments are put together. Every file has its own header; files of equal headers are parsed together and
all layouts are joined by column name.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions import text as say
from colsight.functions.tables import small_table
from colsight.operators.kinds import name_column
from colsight.operators.ranking import hold

# --- fixed values: limits and messages ---------------------------------------
SUFFIXES = (".csv", ".txt")
DELIMITERS = (",", "\t", ";", "|")
LARGE_BYTES = 5 * 1024 * 1024
LARGE_ROWS = 50_000
PREVIEW_ROWS = 10
PREVIEW_CHARS = 40
BLANK_MARK = "·"
EMPTY_FILE = "The file appears to be empty or contains no data rows."
NO_HEADER = "Could not find a header row. CSV must have column names on the first line."
LARGE_NOTICE = "Large file ({}, {:,} rows). Analysis may take a moment."
# --- end of fixed values -----------------------------------------------------

CORRUPT = "_malformed"
ORDER = ["_file", "_block", "_at"]
MOST_LAYOUTS = 1_000
"""Different headers of one input; more are refused, as each is a plan of its own."""
SENT_FILES = 100_000
"""Files or ranges that are sent to all tasks; more are joined."""


class InputError(ValueError):
    """The input cannot be analysed at all."""


@dataclass
class Delimited:
    """``rows``: one text column per header; ``malformed``: raw text of bad rows."""

    rows: DataFrame
    parsed: DataFrame
    headers: list[str]
    paths: list[str]

    def malformed(self) -> DataFrame:
        """Rows with a wrong field count or broken quotes, with 1-based row numbers."""
        numbered = with_row_numbers(self.parsed)
        return numbered.where(F.col(CORRUPT).isNotNull()).select("row", F.col(CORRUPT).alias("text"))


def check_suffix(path: str) -> None:
    if PurePosixPath(path).suffix and not path.lower().endswith(SUFFIXES):
        raise InputError(f"Couldn't recognize {path!r}; expected one of {', '.join(SUFFIXES)}.")


def plain(text: Column) -> Column:
    """A line without its quoted parts."""
    return F.regexp_replace(text, '"[^"]*"', "")


def pick_delimiter(lines: DataFrame, header: str) -> str:
    """The delimiter of the header; of several candidates in it, the one for which most lines have the header's number of
    fields, then the one with most fields."""
    fields = {}
    for sep in DELIMITERS:
        try:
            fields[sep] = len(next(csv.reader([header], delimiter=sep), []))
        except csv.Error:  # a quoted cell that this delimiter would split
            fields[sep] = 0
    open_ = [sep for sep in DELIMITERS if fields[sep] > 1]
    if len(open_) <= 1:
        return open_[0] if open_ else DELIMITERS[0]
    found = F.length(plain(F.col("value")))
    same = [F.count_if(found - F.length(F.replace(plain(F.col("value")), F.lit(sep), F.lit(""))) == fields[sep] - 1).alias(f"s{i}") for i, sep in enumerate(open_)]
    votes = lines.agg(*same).first()
    return max(open_, key=lambda sep: (votes[open_.index(sep)], fields[sep]))


def unique_headers(names: list[str]) -> list[str]:
    """Blank names get a position, repeated names a counter."""
    out, seen = [], set()
    for i, raw in enumerate(names):
        name = raw.strip("﻿") or f"_c{i}"
        base, k = name, 1
        while name in seen:
            name, k = f"{base}_{k}", k + 1
        seen.add(name)
        out.append(name)
    return out


def blank_row(names: list[str]) -> Column:
    cell = [F.coalesce(F.trim(name_column(n)), F.lit("")) for n in names]
    return F.concat(*cell) == ""


def _text_schema(headers: list[str]) -> T.StructType:
    return T.StructType([T.StructField(h, T.StringType()) for h in headers] + [T.StructField(CORRUPT, T.StringType())])


def _finish(records: DataFrame, layouts: dict[str, list[str]], sep: str, paths: list[str]) -> Delimited:
    """``records``: ORDER columns, ``value``, and ``header``, the text of the record's header. Columns of all layouts are
    joined by name, in the order in which they are met; what a file lacks is null."""
    parsed, names = None, []
    for header, own in layouts.items():
        part = parse_lines(records.where(F.col("header") == header), own, sep, ORDER)
        parsed = part if parsed is None else parsed.unionByName(part, allowMissingColumns=True)
        names += [h for h in own if h not in names]
    if not names or all(h.startswith("_c") for h in names):
        raise InputError(NO_HEADER)
    kept = parsed.where(~blank_row(names))
    rows = kept.select(*[name_column(h) for h in names])
    if rows.isEmpty():
        raise InputError(EMPTY_FILE)
    return Delimited(rows, kept, names, paths)


def _record_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, inside, value), those of a block together and in order, to records and fragments of records.

    ``inside``: a quoted cell is open where the block begins. A piece is (file, block, at, value, opens, ends, header): its
    number in the block, whether a record begins and ends with it, and whether it is the file's first record.
    """
    key = None
    open_, at, text, begins, seen = False, 0, [], True, False

    def piece(ends: bool) -> tuple:
        nonlocal at, seen
        value = "\n".join(text).rstrip("\r")
        head = key[1] == 0 and begins and not seen and value.strip("\ufeff\r \t") != ""
        seen |= head
        at += 1
        return (*key, at - 1, value, begins, ends, head)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*ORDER, "value", "opens", "ends", "header"])

    for batch in batches:
        rows = []
        odd = pc.bit_wise_and(pc.count_substring(batch.column(3), '"'), 1).to_numpy(zero_copy_only=False).astype(bool)
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        for i, (file, block, inside, value) in enumerate(zip(files, blocks.tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            if (file, block) != key:
                if text:
                    rows.append(piece(not open_))
                key, open_, at, text, begins, seen = (file, block), inside, 0, [], not inside, False
            elif not open_ and text:
                rows.append(piece(True))
                text, begins = [], True
            text.append(value)
            open_ ^= bool(odd[i])
        if rows:
            yield packed(rows)
    if text:
        yield packed([piece(not open_)])


def _whole_records(pieces: DataFrame) -> DataFrame:
    """Records put together from the fragments of neighbouring ranges; a quote that nothing closes ends with the file."""
    order = Window.partitionBy("_file").orderBy("_block", "_at")
    parts = pieces.where("not opens or not ends").withColumn("record", F.sum(F.col("opens").cast("int")).over(order))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_block", "_at", "value"))), lambda p: p["value"])
    whole = parts.groupBy("_file", "record").agg(F.min(F.struct("_block", "_at", "header")).alias("first"), F.array_join(texts, "\n").alias("value"))
    joined = whole.select("_file", "first._block", "first._at", F.rtrim("value", F.lit("\r")).alias("value"), "first.header")
    return pieces.where("opens and ends").select(*ORDER, "value", "header").unionByName(joined)


def read_delimited(spark: SparkSession, paths: str | list[str], sep: str | None = None) -> Delimited:
    """Files and folders of files; every cell is text, wholly blank lines are dropped.

    Each file begins with its header; headers may differ in order and columns. A file of another kind is refused, also
    inside a folder. Quotes inside a cell are doubled and a cell that holds quotes is quoted, as the format says: a single
    quote sign in an unquoted cell would open a quoted part. A header is one line.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    for path in paths:
        check_suffix(path)
    source = spark.read.options(recursiveFileLookup=True, lineSep="\n").text(paths)
    for path in source.inputFiles():
        check_suffix(path)
    lines = source.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    said = F.when((F.col("_block") == 0) & (F.trim("value", F.lit("\ufeff\r \t")) != ""), F.struct("_line", "value"))
    numbered = lines.withColumn("_line", F.monotonically_increasing_id())
    blocks = hold(numbered.groupBy("_file", "_block").agg(F.sum(quotes).alias("quotes"), F.min(said).alias("head")))
    try:
        earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        inside = blocks.withColumn("before", F.sum("quotes").over(earlier)).where(F.col("before") % 2 == 1).select("_file", "_block", F.lit(True).alias("inside"))
        heads = blocks.where("head is not null").select("_file", F.rtrim("head.value", F.lit("\r")).alias("header"))
        kinds = heads.groupBy("header").agg(F.count(F.lit(1)).alias("files"), F.min("_file").alias("first")).orderBy("first").limit(MOST_LAYOUTS + 1).collect()
        if not kinds:
            raise InputError(EMPTY_FILE)
        if len(kinds) > MOST_LAYOUTS:
            raise InputError(f"More than {MOST_LAYOUTS} different headers.")
        if any(r["header"].count('"') % 2 for r in kinds):
            raise InputError(NO_HEADER)
        first = kinds[0]["header"].strip("\ufeff")
        sep = sep or pick_delimiter(lines, first)
        layouts = {r["header"]: unique_headers(next(csv.reader([r["header"].strip("\ufeff")], delimiter=sep), [])) for r in kinds}
        open_ranges = inside.count()
        known = small_table(spark, inside.collect(), "_file string, _block bigint, inside boolean") if open_ranges <= SENT_FILES else inside
        files = sum(r["files"] for r in kinds)
        of_file = small_table(spark, heads.collect(), "_file string, header string") if files <= SENT_FILES else heads
    finally:
        blocks.unpersist()
    if not open_ranges:
        lines = lines.withColumn("inside", F.lit(False))
    elif open_ranges <= SENT_FILES:
        lines = lines.join(F.broadcast(known), ["_file", "_block"], "left")
    else:  # shuffled lines come back into their order
        lines = lines.withColumn("_line", F.monotonically_increasing_id()).join(known, ["_file", "_block"], "left")
        lines = lines.repartition("_file", "_block").sortWithinPartitions("_file", "_block", "_line")
    lines = lines.select("_file", "_block", F.coalesce("inside", F.lit(False)).alias("inside"), "value")
    pieces = lines.mapInArrow(_record_pieces, "_file string, _block bigint, _at bigint, value string, opens boolean, ends boolean, header boolean")
    records = _whole_records(pieces) if open_ranges else pieces.select(*ORDER, "value", "header")
    records = records.where(~F.col("header") & (F.trim("value", F.lit("\r \t")) != "")).drop("header")
    if len(layouts) == 1:
        records = records.withColumn("header", F.lit(next(iter(layouts))))
    else:
        records = records.join(F.broadcast(of_file) if files <= SENT_FILES else of_file, "_file")
    return _finish(records, layouts, sep, paths)


def parse_lines(lines: DataFrame, headers: list[str], sep: str = ",", keep: list[str] | None = None) -> DataFrame:
    """A column of record texts (``value``) as text columns plus the malformed capture; ``keep`` names columns that stay."""
    schema = ", ".join("`" + f.name.replace("`", "``") + "` string" for f in _text_schema(headers).fields)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.select(*(keep or []), F.from_csv("value", schema, options).alias("r")).select(*(keep or []), "r.*")


def read_text(spark: SparkSession, content: str, sep: str | None = None) -> Delimited:
    """Delimited text already in memory (the caller holds it, so it is small)."""
    records, current = [], ""
    for line in io.StringIO(content):
        current += line
        if current.count('"') % 2 == 0:  # outside quotes: the record ends here
            records.append(current.rstrip("\r\n"))
            current = ""
    if current:
        records.append(current.rstrip("\r\n"))
    records = [r for r in records if r.strip()]
    if not records:
        raise InputError(EMPTY_FILE)
    header = records[0].strip("\ufeff")
    lines = small_table(spark, [("", 0, i, r, header) for i, r in enumerate(records[1:])], "_file string, _block bigint, _at bigint, value string, header string")
    sep = sep or pick_delimiter(lines, header)
    return _finish(lines, {header: unique_headers(next(csv.reader([header], delimiter=sep), []))}, sep, [])


def with_row_numbers(df: DataFrame) -> DataFrame:
    """Add a 1-based ``row`` in the order of files: place in the byte range plus the rows of earlier ranges."""
    place = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at"))
    upto = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per byte range
    before = df.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("held")).select(
        "_file", "_block", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("earlier")
    )
    return df.withColumn("row", place).join(before, ["_file", "_block"]).withColumn("row", F.col("row") + F.col("earlier")).drop("earlier", *ORDER)


def large_input_notice(source: Delimited, max_bytes: int = LARGE_BYTES, max_rows: int = LARGE_ROWS) -> str | None:
    """A warning above either limit; sizes come from file metadata."""
    rows = source.rows.count()
    size = 0
    if source.paths:
        files = source.rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(source.paths)
        size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if size < max_bytes and rows < max_rows:
        return None
    shown = source.rows.sparkSession.range(1).select(say.file_size(F.lit(float(size)))).first()[0]
    return LARGE_NOTICE.format(shown, rows)


def preview(df: DataFrame, order_by: list[str] | None = None, rows: int = PREVIEW_ROWS, chars: int = PREVIEW_CHARS) -> DataFrame:
    """The first rows with long cells cut and blanks marked."""
    def shown(name: str) -> Column:
        cell = F.trim(F.coalesce(name_column(name).cast("string"), F.lit("")))
        return (
            F.when(cell == "", BLANK_MARK)
            .when(F.length(cell) > chars, F.concat(F.substring(cell, 1, chars), F.lit("…")))
            .otherwise(cell)
        )

    first = df.orderBy(*order_by).limit(rows) if order_by else df.limit(rows)
    return first.select(*[shown(n).alias(n) for n in df.columns])
