"""Lines that fail to parse, beside the rows that load.

Each line is a record by itself (``assemble`` joins lines of an open quote, for callers that want it), parsed by Python's
csv reader in strict mode, and structural errors are caught before any field is converted. Lines without a quote go through one reader a batch; the others get a reader
each, so that an open quote can't swallow the next line.

The first reason that applies is given: ``quoting``, ``column_count``, ``invalid_value``. Edge cases, as tested: a null
line has no field (``column_count``), an empty line one empty field; a line of an unknown or null layout is rejected as
``unknown_layout``; line ends and other control characters inside a line are ordinary characters; a field may be of any
length; repeated lines are judged each; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import csv
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"
BLANKS = " \t"
#: Fields that are well-formed as to quotes: wholly quoted, or without any.
_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^",][^",]*|)'
csv.field_size_limit(1 << 31)  # fields of any length
FIELD = re.compile(_FIELD, re.DOTALL)
WELL_QUOTED = re.compile(f"{_FIELD}(?:,{_FIELD})*", re.DOTALL)
DIGITS = re.compile(r"[0-9]+")
NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


class Invalid(ValueError):
    """A field that its constructor doesn't take."""


@dataclass(frozen=True)
class Whole:
    """Digits alone, below ``states``."""

    states: int
    spark: str = "bigint"

    def __call__(self, text: str) -> int:
        text = text.strip(BLANKS)
        if not DIGITS.fullmatch(text):
            raise Invalid(text)
        bare = text.lstrip("0") or "0"
        if len(bare) > 18 or int(bare) >= self.states:
            raise Invalid(text)
        return int(bare)


@dataclass(frozen=True)
class Digits:
    """A whole number of any length, as its digits without leading zeros, so that none is changed to fit a type."""

    spark: str = "string"

    def __call__(self, text: str) -> str:
        text = text.strip(BLANKS)
        if not DIGITS.fullmatch(text):
            raise Invalid(text)
        return text.lstrip("0") or "0"


@dataclass(frozen=True)
class Number:
    """A finite number in a range."""

    low: float = -math.inf
    high: float = math.inf
    spark: str = "double"

    def __call__(self, text: str) -> float:
        text = text.strip(BLANKS)
        if not NUMBER.fullmatch(text):
            raise Invalid(text)
        value = float(text)
        if not math.isfinite(value) or not self.low <= value <= self.high:
            raise Invalid(text)
        return value


@dataclass(frozen=True)
class Text:
    """Any text, or any but an empty one; outer blanks are taken off if ``strip``."""

    empty: bool = True
    strip: bool = True
    spark: str = "string"

    def __call__(self, text: str) -> str:
        bare = text.strip(BLANKS)
        if not bare and not self.empty:
            raise Invalid(text)
        return bare if self.strip else text


Layout = list[tuple[str, Whole | Digits | Number | Text]]
#: The two layouts of the test lines.
LAYOUTS: dict[str, Layout] = {
    "mood": [(f"c{i}", Whole(states)) for i, states in enumerate((2, 7, 2, 2, 2, 2, 2))],
    "runs": [("problem", Text(empty=False)), ("algorithm", Text(empty=False)), ("seed", Digits()), ("f1", Number(0, 1)), ("time", Number(0)), ("note", Text())],
}


def bare(line: str) -> str:
    """Without one leading byte order mark and one final carriage return."""
    return line.removeprefix(BOM).removesuffix("\r")


def split_strict(line: str) -> list[str]:
    """The fields of one line; csv.Error where the quoting is broken.

    The strict reader refuses open quotes and text after a closing one. It takes a quote inside an unquoted field as
    an ordinary character, so that is looked for afterwards.
    """
    if "\r" not in line and "\n" not in line:
        fields = next(csv.reader([line], strict=True)) or [""]
        if '"' in line and not WELL_QUOTED.fullmatch(line):
            raise csv.Error("a quote in an unquoted field")
        return fields
    # the reader would end the record at the line end; such fields are cut by the pattern
    if not WELL_QUOTED.fullmatch(line):
        raise csv.Error("quotes out of place")
    at, out = 0, []
    while True:
        field = FIELD.match(line, at)
        text = field[0]
        out.append(text[1:-1].replace('""', '"') if text[:1] == '"' else text)
        if field.end() >= len(line):
            return out
        at = field.end() + 1


def read_batch(lines: list[str]) -> Iterator[list[str] | None]:
    """The fields of each line, None where the quoting is broken."""
    plain = [x for x in lines if '"' not in x and "\r" not in x and "\n" not in x and x]
    reader = csv.reader(plain, strict=True)
    for line in lines:
        if '"' not in line and "\r" not in line and "\n" not in line and line:
            yield next(reader)
            continue
        try:
            yield split_strict(line)
        except csv.Error:
            yield None


def judge(fields: list[str] | None, layout: Layout | None) -> tuple[str | None, list | None]:
    """The reason for refusal, or the typed values."""
    if layout is None:
        return "unknown_layout", None
    if fields is None:
        return "quoting", None
    if len(fields) != len(layout):
        return "column_count", None
    try:
        return None, [make(text) for text, (_, make) in zip(fields, layout, strict=True)]
    except Invalid:
        return "invalid_value", None


def assemble(lines: list[str]) -> Iterator[tuple[int, str]]:
    """Records of a file whose quoted fields may hold line ends: (place of the first line, record).

    A record ends where its quotes are even. One that never closes is given as far as the end of the file.
    """
    start, held, odd = 0, [], False
    for i, line in enumerate(lines):
        if not held:
            start = i
        held.append(line)
        odd ^= line.count('"') % 2 == 1
        if not odd:
            yield start, "\n".join(held)
            held = []
    if held:
        yield start, "\n".join(held)


def parse_lines(df: DataFrame, line: str = "line", layout: str = "layout", keep: list[str] | None = None, layouts: dict[str, Layout] | None = None) -> DataFrame:
    """The ``keep`` columns with ``reason`` (null: loaded) and one struct of typed values for each layout.

    Each line is a record by itself. Narrow: no shuffle, one pass, a batch of lines at a time.
    """
    layouts = layouts or LAYOUTS
    keep = keep or []
    kept = [f"_k{i}" for i in range(len(keep))]
    structs = {name: T.StructType([T.StructField(f, T._parse_datatype_string(make.spark)) for f, make in fields]) for name, fields in layouts.items()}
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = {name: to_arrow_type(s) for name, s in structs.items()}
    names = [*kept, "reason", *layouts]
    source = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(f"`{line}`").cast("string").alias("_line"), F.col(f"`{layout}`").cast("string").alias("_layout"))
    out = T.StructType([*[T.StructField(k, df.schema[c].dataType) for c, k in zip(keep, kept, strict=True)], T.StructField("reason", T.StringType()), *[T.StructField(n, s) for n, s in structs.items()]])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, kinds = batch.column("_line").to_pylist(), batch.column("_layout").to_pylist()
            fields = read_batch(["" if x is None else bare(x) for x in lines])
            reasons, values = [], {n: [] for n in layouts}
            for text, kind, got in zip(lines, kinds, fields, strict=True):
                reason, row = judge([] if text is None else got, layouts.get(kind))
                reasons.append(reason)
                for n, v in values.items():
                    v.append(dict(zip((f for f, _ in layouts[n]), row, strict=True)) if row is not None and n == kind else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(reasons, pa.string()), *[pa.array(values[n], arrow[n]) for n in layouts]], names=names)

    return source.mapInArrow(parse, out).select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "reason", *[F.col(f"`{n}`") for n in layouts])


def rejected(parsed: DataFrame) -> DataFrame:
    """The refused lines with their reason."""
    return parsed.filter(F.col("reason").isNotNull())


def loaded(parsed: DataFrame, layout: str, keep: list[str]) -> DataFrame:
    """The rows of a layout that load, typed."""
    return parsed.filter(F.col(f"`{layout}`").isNotNull()).select(*keep, F.col(f"`{layout}`.*"))
