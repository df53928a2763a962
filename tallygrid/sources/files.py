"""Readers and writers of the file kinds that networks and their evaluation come in."""

from __future__ import annotations

import uuid
from glob import glob
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators.ordered import first_k
from tallygrid.operators.run_records import FIELDS


def read_states(spark: SparkSession, path: str, n_vars: int, most: int | None = None) -> DataFrame:
    """A headerless table of integers as ``row_id, x0`` ...; rows that aren't whole numbers or of another width are dropped.

    ``row_id`` follows the file's order within each piece of a file; ``most`` keeps the first rows by name of file, place of
    the piece and row.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select(at.alias("at"), F.monotonically_increasing_id().alias("row_id"), F.split(F.trim("value"), r"\s*,\s*").alias("v"))
    good = lines.filter((F.size("v") == n_vars) & F.forall("v", lambda c: c.rlike(r"\A[+-]?[0-9]{1,9}\z")))
    if most is not None:
        good = first_k(good, [F.asc("at"), F.asc("row_id")], most)
    return good.select("row_id", *[F.col("v")[i].cast("int").alias(f"x{i}") for i in range(n_vars)])


def find_data(folder: str, name: str, n: int) -> str | None:
    """``<name>_data_N<n>.csv``, else the last of the sizes there are."""
    exact = Path(folder) / f"{name}_data_N{n}.csv"
    if exact.exists():
        return str(exact)
    return next(iter(sorted(glob(f"{folder}/{name}_data_N*.csv"), reverse=True)), None)


META = "name string, n_vars int, n_edges int, n_samples int, description string, var_names array<string>, cardinality array<int>, adjacency array<array<int>>, var_states map<string,array<string>>"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(META).json(path, multiLine=True)


def metadata_edges(meta: DataFrame) -> DataFrame:
    """``name, src, dst`` from the adjacency matrices."""
    rows = meta.select("name", F.posexplode("adjacency").alias("src", "row")).select("name", "src", F.posexplode("row").alias("dst", "on"))
    return rows.filter("on <> 0").select("name", "src", "dst")


def metadata_schema(meta: DataFrame) -> DataFrame:
    """``name, var, var_name, cardinality, states``; missing cardinalities count 2."""
    rows = meta.select("name", F.posexplode("var_names").alias("var", "var_name"), "cardinality", "var_states")
    return rows.select("name", "var", "var_name", F.coalesce(F.get("cardinality", F.col("var")), F.lit(2)).alias("cardinality"), F.element_at("var_states", F.col("var_name")).alias("states"))


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated rows as ``x`` (states), ``f`` (objective) and ``split``; rows with other than numbers are dropped."""
    v = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(v.alias("v")).filter((F.size("v") >= 3) & F.forall("v", lambda c: c.try_cast("double").isNotNull()))
    return rows.select(F.transform(F.slice("v", F.lit(1), F.size("v") - 2), lambda c: c.cast("double").cast("int")).alias("x"), F.element_at("v", -2).cast("double").alias("f"), F.element_at("v", -1).cast("double").cast("int").alias("split"))


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    """True edges ``problem, i, j`` in both directions; the first line, a count, is left out."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)_structure\.dat$", 1).alias("problem"), F.split(F.trim("value"), r"\s+").alias("v"))
    pairs = lines.filter(F.size("v") == 2).select("problem", F.col("v")[0].cast("int").alias("i"), F.col("v")[1].cast("int").alias("j"))
    return pairs.union(pairs.select("problem", F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


RUN_PARTS = r"eval_(?<problem>[^/]+)_tr(?<tr>[0-9]+)_(?<algo>[^/]+)_T(?<temp>[0-9.]+)_s(?<seed>[0-9]+)\.dat"


def size_group(n):
    """Below 50 small, below 100 medium, else large."""
    return F.when(n < 50, "small").when(n < 100, "medium").otherwise("large")


def size_group_by_gaps(n):
    """The other grouping in use: up to 40 small, between 50 and 100 medium, from 100 large, others none."""
    return F.when(n <= 40, "small").when((n > 50) & (n < 100), "medium").when(n >= 100, "large")


def tidy_results(files: DataFrame) -> DataFrame:
    """One tidy row for each line of eleven numbers in the result files (``path, content``) with a run in their path.

    ``line_no`` counts the file's lines from 1. A file may hold several results, which are all kept, equal ones too.
    Names come from the path, ``n, edges, n_selected`` from ``key=value`` words of the comment lines; what isn't a
    number is null. ``train`` is the split trained on, ``test1`` and ``test2`` the others, ``test`` their mean.
    """
    part = lambda i: F.regexp_extract("path", RUN_PARTS, i)
    lines = F.split("content", r"\r?\n")
    notes = F.str_to_map(F.array_join(F.regexp_extract_all(F.array_join(F.filter(lines, lambda x: x.startswith("#")), " "), F.lit(r"([^\s#=]+=[^\s=]+)"), 1), " "), F.lit(" "), F.lit("="))
    words = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_no"), F.when(~x.startswith("#"), F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " ")).alias("v")))
    numbers = F.filter(words, lambda w: F.size(w["v"]) == 11)
    rows = files.select(part(1).alias("problem"), part(2).cast("string").alias("tr"), part(3).alias("algorithm"), part(4).alias("temp_str"), part(5).alias("seed"), notes.alias("m"), numbers.alias("numbers")).filter("problem <> ''")
    rows = rows.withColumn("_each", F.explode("numbers")).withColumns({"line_no": F.col("_each.line_no"), "v": F.col("_each.v")})
    note = lambda k, t: F.element_at(F.col("m"), k).try_cast(t)
    rows = rows.select("problem", "line_no", F.regexp_replace("problem", r"_[0-9]+$", "").alias("family"), F.coalesce(note("n", "int"), F.regexp_extract("problem", r"_([0-9]+)$", 1).try_cast("int"), F.lit(-1)).alias("n"), "algorithm", F.col("temp_str").try_cast("double").alias("temperature"), "temp_str", F.col("tr").try_cast("int").alias("train_set"), F.col("seed").try_cast("int").alias("seed"), note("edges", "double").alias("edges"), note("n_selected", "double").alias("n_selected"), *[F.col("v")[i].try_cast("double").alias(f) for i, f in enumerate(FIELDS)])
    out = rows.withColumn("group", size_group(F.col("n")))
    for m in ("sp", "ll", "kl"):
        s = [F.col(f"{m}_s{i}") for i in range(3)]
        pick = lambda a, b, c: F.when(F.col("train_set") == 0, a).when(F.col("train_set") == 1, b).when(F.col("train_set") == 2, c)
        out = out.withColumns({f"train_{m}": pick(s[0], s[1], s[2]), f"test1_{m}": pick(s[1], s[0], s[0]), f"test2_{m}": pick(s[2], s[2], s[1])}).withColumn(f"test_{m}", (F.col(f"test1_{m}") + F.col(f"test2_{m}")) / 2)
    return out


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on whatever file system the path is of: written beside its place, then renamed, so it is whole or absent."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(aside, target):
        raise OSError(f"{path} could not be put in its place")


def write_table(df: DataFrame, path: str, fields: list[str]) -> None:
    """A table with a header, the fields in order, other columns left out; committed whole or not at all."""
    df.select(*[F.col(f"`{f}`") for f in fields]).write.mode("errorifexists").csv(path, header=True)


def experiment_grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of the axes' values, as exploded literals."""
    out = spark.range(1)
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("id")


def result_name(problem: str, train: int, algorithm: str, temperature: float, seed: int) -> str:
    return f"eval_{problem}_tr{train}_{algorithm}_T{temperature}_s{seed}.dat"
