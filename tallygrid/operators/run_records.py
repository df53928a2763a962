"""Records inside packed result files, and those that are there more than once."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.operators.small_files import whole

#: The part of a path that names a run, and a line of eleven numbers. The names of problem and algorithm may be anything,
#: so the run begins at the path's first ``eval_``: files of one name in different folders ``..eval../x/`` are different runs.
RUN = re.compile(r"eval_.+_tr[0-9]+_.+_T[0-9.]+_s[0-9]+\.dat")
NUMBER = rb"(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[nN][aA][nN])"
RECORD = re.compile(rb"\s*" + NUMBER + rb"(?:\s+" + NUMBER + rb"){10}\s*")
FIELDS = ("f1", "time", "ll_s0", "kl_s0", "sp_s0", "ll_s1", "kl_s1", "sp_s1", "ll_s2", "kl_s2", "sp_s2")


def _parsed(b: dict) -> Iterator[tuple[int, int, str, list[float]]]:
    for m, body in whole(b):
        run = RUN.search(m["path"] or "")
        if run is None:
            continue
        for no, line in enumerate(body.split(b"\n"), 1):
            if line and not line.startswith(b"#") and RECORD.fullmatch(line):
                yield m["file_id"], no, run[0], [float(x) + 0.0 for x in line.split()]


def records(bundles: DataFrame) -> DataFrame:
    """``file_id, line_no, run`` and the eleven numbers of every record in the bundles.

    Files without an id give records with a null ``file_id``; files whose path names no run give none. Lengths and
    checksums are compared with the bundle's index; an error is raised where they differ.
    """
    schema = pa.schema([("file_id", pa.int64()), ("line_no", pa.int32()), ("run", pa.string()), *[(f, pa.float64()) for f in FIELDS]])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                if got := list(_parsed(b)):
                    fid, no, run, numbers = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((fid, no, run, *zip(*numbers, strict=True)), schema.types, strict=True)], schema=schema)

    return bundles.select("bundle_id", "payload", "n_bytes", "crc", "members").mapInArrow(parse, ", ".join(["file_id bigint", "line_no int", "run string", *[f"`{f}` double" for f in FIELDS]]))


def record_keys(bundles: DataFrame) -> DataFrame:
    """``file_id, line_no, key``; the key is a 128-bit BLAKE2 digest of run and numbers (every NaN alike, -0 as 0).

    Sixteen bytes instead of about 130 go through the shuffle; two different records with one digest are not to be
    expected at any number of records that can be stored.
    """
    nan = float("nan")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                got = [(f, no, hashlib.blake2b(run.encode() + b"\0" + array("d", [nan if x != x else x for x in xs]).tobytes(), digest_size=16).digest()) for f, no, run, xs in _parsed(b)]
                if got:
                    fid, no, key = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(fid, pa.int64()), pa.array(no, pa.int32()), pa.array(key, pa.binary())], names=["file_id", "line_no", "key"])

    return bundles.select("bundle_id", "payload", "n_bytes", "crc", "members").mapInArrow(parse, "file_id bigint, line_no int, key binary")


def surplus(keyed: DataFrame, key: str, order: list[str], salts: int = 64) -> DataFrame:
    """Rows that are not the first of their key.

    A key may hold a third of all rows, so its rows are first ordered within ``salts`` parts by a hash of the order
    columns. Only the first of each part goes on to be compared under the key alone, at most ``salts`` rows a key; the
    other rows, known to be surplus, keep their part. Nulls in the order come first; equal rows are told apart.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(salts))
    by = [F.col(c).asc_nulls_first() for c in order]
    parts = keyed.withColumn("_part", part).withColumn("_place", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*by)))
    lane = F.when(F.col("_place") == 1, F.lit(-1)).otherwise(F.col("_part"))
    firsts = parts.withColumn("_lane", lane).withColumn("_first", F.row_number().over(Window.partitionBy(key, "_lane").orderBy(*by)))
    return firsts.filter((F.col("_place") > 1) | (F.col("_first") > 1)).drop("_part", "_place", "_lane", "_first")
