"""Helpers that touch the session: shared checkpoint folder, lineage cuts, identity-preserving deduplication."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks of the test tables: a space or a tab.
BLANKS = " \t"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, as the session names it in ``spark.checkpoint.dir``.

    Only where the setting is absent and the session is local, a temporary folder is made, because a machine-local
    folder can't be read by other executors.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    have = sc.getCheckpointDir()
    if have:
        return have
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tallygrid-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def trimmed(column: Column | str) -> Column:
    """Without outer blanks."""
    return F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(BLANKS))


def label(column: str) -> Column:
    """Lower case without outer blanks."""
    return F.lower(trimmed(F.col(f"`{column}`")))


#: Words of the filter of repeated keys, 64 bits each and at most so many rows broadcast: some 30 MB if every word is in use,
#: and a few bits a key for about ten million repeated keys. With more, more rows are shuffled; the result is the same.
WORDS = 1 << 20


def _place(key: Column) -> tuple[Column, Column]:
    """The word of a key in the filter, and its four bits there."""
    h = F.xxhash64(key)
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int")) for at in (24, 34, 44, 54)]
    return F.pmod(h, F.lit(WORDS)).cast("int"), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def told_apart(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key occurs once for certain, or is null, and the others, among them all whose key occurs again.

    Only keys are counted, combined before the shuffle; those that occur twice are put into a filter of fixed size, which
    is broadcast. The first part is narrow: its rows stay in the task that scans them.
    """
    word, mask = _place(F.col(f"`{key}`"))
    twice = df.select(F.col(f"`{key}`").alias("k")).filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("c")).filter("c > 1")
    at, bits = _place(F.col("k"))
    held = cut(twice.select(at.alias("_word"), bits.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits")))
    marked = df.withColumns({"_word": word, "_mask": mask}).join(F.broadcast(held), "_word", "left")
    again = F.col(f"`{key}`").isNotNull() & F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    columns = [f"`{c}`" for c in df.columns]
    return marked.filter(~again).select(*columns), marked.filter(again).select(*columns)


def each_once(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row per ``key`` with the ``values`` of its smallest row (nulls first), so the pick is the same every time.

    Rows without a key can't be told apart by it and are all kept. Only rows that may be repeated are shuffled, combined
    before.
    """
    kept = df.select(F.col(f"`{key}`").alias("_key"), *[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)])
    once, others = told_apart(kept, "_key")
    names = [f"v{i}" for i in range(len(values))]
    one = others.groupBy("_key").agg(F.min(F.struct(*names)).alias("_v")).select("_key", *[F.col(f"_v.{n}") for n in names])
    return once.unionByName(one).select(F.col("_key").alias(key), *[F.col(n).alias(v) for n, v in zip(names, values, strict=True)])
