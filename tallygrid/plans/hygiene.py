"""Queries of the general data problems 1, 2 and 4, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.cluster import checkpoint_dir, cut
from tallygrid.operators import reject_rows, run_records, schema_drift, small_files
from tallygrid.plans.tables import table

#: Fields of the unified table and their types.
TARGET = {"problem": "string", "algorithm": "string", "seed": "bigint", "edges": "double", "n_selected": "double", "f1": "double", "time": "double"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    bundles = small_files.pack_files(table(spark, d, "result_files"))
    return run_records.surplus(run_records.record_keys(bundles), "key", ["file_id", "line_no"]).select("file_id", "line_no")


def p1_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its length and checksum, cut out of its bundle."""
    files = small_files.members(small_files.pack_files(table(spark, d, "result_files")))
    return files.select("file_id", "path", F.length("content").cast("bigint").alias("n_bytes"), F.md5("content").alias("md5"), "intact")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """The distinct records: run and numbers of all that aren't surplus."""
    got = run_records.records(small_files.pack_files(table(spark, d, "result_files")))
    return got.groupBy("run", *run_records.FIELDS).agg(F.min(F.struct("file_id", "line_no")).alias("at")).select(F.col("at.file_id").alias("file_id"), F.col("at.line_no").alias("line_no"), "run", *run_records.FIELDS)


def p1_written(spark: SparkSession, d: str) -> DataFrame:
    """Lines of eleven numbers in the bundles as files, with their number: written, checked and read again."""
    bundles = cut(small_files.pack_files(table(spark, d, "result_files")))
    out = f"{checkpoint_dir(spark)}/p1_written_{uuid.uuid4().hex}"
    small_files.write_bundles(bundles, out)
    if wrong := small_files.check_written(spark, bundles, out).take(3):
        raise ValueError(f"files written differ from their bundles: {wrong}")
    number = r"(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[nN][aA][nN])"
    lines = spark.read.text(out, lineSep="\n").withColumnRenamed("value", "line")
    return lines.filter(F.col("line").rlike(rf"\A\s*{number}(?:\s+{number}){{10}}\s*\z")).groupBy("line").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    schemas = schema_drift.batch_schemas(*(table(spark, d, t) for t in ("tidy_batches", "tidy_lines", "field_names")))
    # a null header has no fields, so its batch is compared like others
    schemas = schemas.withColumn("fields", F.coalesce("fields", F.array().cast(schemas.schema["fields"].dataType)))
    return schema_drift.batch_changes(schemas).filter(F.col("change_kind").isin("added", "removed", "renamed", "retyped")).select("batch_id", "field", "change_kind")


def _text(cells: str) -> Column:
    """A map as ``field=cell`` in order of the fields, for comparison; fields without a cell as ``field``."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(cells)), lambda k: F.concat_ws("=", k, F.element_at(F.col(cells), k))), ";")


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    """All cells: typed, in ``raw`` where they aren't of the type, and in ``other_cells``, whose number is ``others``."""
    rows = schema_drift.unified_lines(*(table(spark, d, t) for t in ("tidy_batches", "tidy_lines", "field_names")), TARGET, raw="raw")
    return rows.withColumnRenamed("others", "other_cells").withColumns({"others": F.size("other_cells"), "raw_text": _text("raw"), "other_text": _text("other_cells")})


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same with the maps as text."""
    return p2_unified(spark, d).drop("raw", "other_cells")


#: Names of one field over time, in the nested files of p2_nested.
NESTED = "key bigint, info struct<total:double, status:string, who:struct<cust:bigint, priority:string>, day:string>"
FORMER = {"amount": "total", "prio": "priority", "customer": "cust"}


def p2_nested(spark: SparkSession, d: str) -> DataFrame:
    """Orders in three sets of files, one for each status, whose nested schemas differ: fields renamed, retyped, moved between
    structs and missing; read as one table."""
    o, out = table(spark, d, "orders"), f"{checkpoint_dir(spark)}/p2_nested_{uuid.uuid4().hex}"
    key, total, status = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderstatus").alias("status")
    forms = {
        "O": o.select(key.alias("key"), F.struct(total.alias("total"), status, F.struct(F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("priority")).alias("who")).alias("info")),
        "F": o.select(key.cast("string").alias("key"), F.struct(total.alias("amount"), F.struct(F.col("o_custkey").alias("customer")).alias("who"), status).alias("info"), F.col("o_orderpriority").alias("prio")),
        "P": o.select(F.struct(status, F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).alias("info"), key.alias("key")),
    }
    for s, form in forms.items():
        form.filter(F.col("info.status") == s).write.parquet(f"{out}/{s}")
    rows, _ = schema_drift.read_consistent(spark, [[f"{out}/{s}"] for s in forms], lambda n: FORMER.get(n, n), want=T._parse_datatype_string(NESTED))
    return rows.select("key", F.col("info.status").alias("status"), F.col("info.total").alias("total"), F.col("info.day").alias("day"), F.col("info.who.cust").alias("cust"), F.col("info.who.priority").alias("priority"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parsed = reject_rows.parse_lines(table(spark, d, "raw_lines"), keep=["line_id"])
    return reject_rows.rejected(parsed).select("line_id", "reason")


def p4_mood(spark: SparkSession, d: str) -> DataFrame:
    parsed = reject_rows.parse_lines(table(spark, d, "raw_lines"), keep=["line_id"])
    return reject_rows.loaded(parsed, "mood", ["line_id"])


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """``seed`` is null where its digits exceed 64 bits; ``seed_digits`` always has them."""
    parsed = reject_rows.parse_lines(table(spark, d, "raw_lines"), keep=["line_id"])
    rows = reject_rows.loaded(parsed, "runs", ["line_id"]).withColumnRenamed("seed", "seed_digits")
    return rows.withColumn("seed", F.col("seed_digits").try_cast("bigint"))


_NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_RECORDS = rf"""
files AS (SELECT DISTINCT file_id, path, content FROM result_files),
named AS (SELECT file_id, content, regexp_extract(path, 'eval_.+_tr[0-9]+_.+_T[0-9.]+_s[0-9]+\.dat') AS run FROM files),
split AS (SELECT file_id, run, string_split(content, chr(10)) AS ls FROM named WHERE run <> ''),
lines AS (SELECT file_id, run, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM split),
good AS (SELECT file_id, run, line_no, list_transform(regexp_extract_all(line, '[^\s]+'), lambda x: CASE WHEN lower(x) = 'nan' THEN 'NaN'::DOUBLE ELSE x::DOUBLE + 0.0 END) AS v
  FROM lines WHERE line NOT LIKE '#%' AND regexp_full_match(line, '\s*({_NUM}|[nN][aA][nN])(\s+({_NUM}|[nN][aA][nN])){{10}}\s*'))"""
_FIELDS = r"""
head AS (SELECT DISTINCT ON (batch_id) * FROM tidy_batches),
parts AS (SELECT batch_id, stream, exported_at, delimiter, string_split(header, delimiter) AS hs FROM head),
written AS (SELECT batch_id, trim(unnest(hs), ' ' || chr(9) || '"') AS name, unnest(range(1, len(hs) + 1)) AS pos FROM parts),
known AS (SELECT w.batch_id, w.pos, w.name, coalesce(f.field, w.name) AS field FROM written w LEFT JOIN field_names f ON f.known_name = w.name)"""
_MISSING = "('', 'na', 'nan', 'null', 'none', '?')"
_CELLS = r"""
lparts AS (SELECT l.batch_id, l.line_no, string_split(l.line, h.delimiter) AS cs FROM tidy_lines l JOIN head h USING (batch_id)),
cells AS (SELECT batch_id, line_no, trim(unnest(cs), ' ' || chr(9) || '"') AS cell, unnest(range(1, len(cs) + 1)) AS pos FROM lparts)"""
_LINES = rf"""
bare AS (SELECT line_id, layout, CASE WHEN l LIKE '%' || chr(13) THEN left(l, -1) ELSE l END AS l
  FROM (SELECT line_id, layout, CASE WHEN line LIKE chr(65279) || '%' THEN substr(line, 2) ELSE line END AS l FROM raw_lines)),
quoted AS (SELECT line_id, layout, l, regexp_full_match(l, '("[^"]*(""[^"]*)*"|[^",]*)(,("[^"]*(""[^"]*)*"|[^",]*))*') AS ok FROM bare),
fields AS (SELECT line_id, layout, ok, CASE WHEN ok THEN list_transform(regexp_extract_all(',' || l, ',("(?:[^"]|"")*"|[^",]*)', 1), lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) END AS raw FROM quoted),
cut AS (SELECT line_id, layout, ok, list_transform(raw, lambda x: trim(x, ' ' || chr(9))) AS f FROM fields),
judged AS (SELECT line_id, layout, f, CASE WHEN NOT ok THEN 'quoting' WHEN len(f) <> CASE layout WHEN 'mood' THEN 7 ELSE 6 END THEN 'column_count'
  WHEN layout = 'mood' AND NOT (f[1] SIMILAR TO '0*[01]' AND f[2] SIMILAR TO '0*[0-6]' AND f[3] SIMILAR TO '0*[01]' AND f[4] SIMILAR TO '0*[01]' AND f[5] SIMILAR TO '0*[01]' AND f[6] SIMILAR TO '0*[01]' AND f[7] SIMILAR TO '0*[01]') THEN 'invalid_value'
  WHEN layout = 'runs' AND (f[1] = '' OR f[2] = '' OR NOT f[3] SIMILAR TO '[0-9]+' OR NOT regexp_full_match(f[4], '{_NUM}') OR NOT coalesce(try_cast(f[4] AS DOUBLE) BETWEEN 0 AND 1, false)
    OR NOT regexp_full_match(f[5], '{_NUM}') OR NOT coalesce(try_cast(f[5] AS DOUBLE) >= 0 AND isfinite(try_cast(f[5] AS DOUBLE)), false)) THEN 'invalid_value' END AS reason FROM cut)"""

_TARGETS = "(" + ", ".join(f"'{k}'" for k in TARGET) + ")"
_CAST = {"string": "cell", "double": "try_cast(cell AS DOUBLE)", "bigint": "CASE WHEN regexp_full_match(cell, '[+-]?[0-9]+') THEN try_cast(cell AS BIGINT) END"}

QUERIES = {f.__name__: f for f in (p1_found, p1_bundles, p1_records, p1_written, p2_found, p2_unified, p2_rows, p2_nested, p4_found, p4_mood, p4_runs)}
SQL = {
    "p1_found": f"WITH {_RECORDS} SELECT file_id, line_no::INT AS line_no FROM (SELECT file_id, line_no, row_number() OVER (PARTITION BY run, v ORDER BY file_id, line_no) AS k FROM good) WHERE k > 1",
    "p1_bundles": "SELECT file_id, path, strlen(content)::BIGINT AS n_bytes, md5(content) AS md5, true AS intact FROM (SELECT DISTINCT file_id, path, content FROM result_files)",
    "p1_records": f"WITH {_RECORDS} SELECT file_id, line_no::INT AS line_no, run, " + ", ".join(f'v[{i}] AS "{f}"' for i, f in enumerate(run_records.FIELDS, 1)) + " FROM (SELECT *, row_number() OVER (PARTITION BY run, v ORDER BY file_id, line_no) AS k FROM good) WHERE k = 1",
    "p1_written": rf"WITH files AS (SELECT DISTINCT file_id, path, content FROM result_files), l AS (SELECT unnest(string_split(content, chr(10))) AS line FROM files) SELECT line, count(*) AS n FROM l WHERE regexp_full_match(line, '\s*({_NUM}|[nN][aA][nN])(\s+({_NUM}|[nN][aA][nN])){{10}}\s*') GROUP BY line",
    "p2_found": f"""WITH {_FIELDS}, {_CELLS},
widths AS (SELECT batch_id, pos, max(CASE WHEN regexp_full_match(cell, '[+-]?[0-9]+') THEN 1 WHEN regexp_full_match(cell, '{_NUM}') THEN 2 ELSE 3 END) AS w FROM cells WHERE lower(cell) NOT IN {_MISSING} GROUP BY ALL),
fields AS (SELECT k.batch_id, k.field, k.name, w.w FROM known k LEFT JOIN widths w USING (batch_id, pos)),
steps AS (SELECT batch_id, lag(batch_id) OVER (PARTITION BY stream ORDER BY exported_at, batch_id) AS prior FROM head),
olds AS (SELECT s.batch_id, f.field, f.name, f.w FROM steps s JOIN fields f ON f.batch_id = s.prior),
news AS (SELECT s.batch_id, f.field, f.name, f.w FROM steps s JOIN fields f ON f.batch_id = s.batch_id WHERE s.prior IS NOT NULL),
both_ AS (SELECT coalesce(n.batch_id, o.batch_id) AS batch_id, coalesce(n.field, o.field) AS field, n.name AS nn, o.name AS oname, n.w AS nw, o.w AS ow FROM news n FULL JOIN olds o ON n.batch_id = o.batch_id AND n.field = o.field)
SELECT batch_id, field, 'added' AS change_kind FROM both_ WHERE oname IS NULL UNION ALL SELECT batch_id, field, 'removed' FROM both_ WHERE nn IS NULL
UNION ALL SELECT batch_id, field, 'renamed' FROM both_ WHERE nn <> oname UNION ALL SELECT batch_id, field, 'retyped' FROM both_ WHERE nw <> ow""",
    "p2_rows": f"""WITH {_FIELDS}, {_CELLS},
clean AS (SELECT DISTINCT c.batch_id, c.line_no, k.field, CASE WHEN lower(c.cell) NOT IN {_MISSING} THEN c.cell END AS cell FROM cells c JOIN known k USING (batch_id, pos)),
typed AS (SELECT *, CASE {" ".join(f"WHEN field = '{k}' THEN {_CAST[t]} IS NOT NULL" for k, t in TARGET.items())} END AS fits FROM clean)
SELECT batch_id, line_no, {", ".join(f"""max({_CAST[t]}) FILTER (field = '{k}' AND fits) AS "{k}\"""" for k, t in TARGET.items())},
(count(*) FILTER (field NOT IN {_TARGETS}))::INT AS others, coalesce(string_agg(field || '=' || cell, ';' ORDER BY field) FILTER (field IN {_TARGETS} AND cell IS NOT NULL AND NOT fits), '') AS raw_text,
coalesce(string_agg(field || CASE WHEN cell IS NULL THEN '' ELSE '=' || cell END, ';' ORDER BY field) FILTER (field NOT IN {_TARGETS}), '') AS other_text FROM typed GROUP BY batch_id, line_no""",
    "p2_nested": "SELECT o_orderkey AS key, o_orderstatus AS status, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS total, CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS cust, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority FROM orders",
    "p4_found": f"WITH {_LINES} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_mood": f"WITH {_LINES} SELECT line_id, {', '.join(f'f[{i + 1}]::BIGINT AS c{i}' for i in range(7))} FROM judged WHERE reason IS NULL AND layout = 'mood'",
    "p4_runs": f"WITH {_LINES} SELECT line_id, f[1] AS problem, f[2] AS algorithm, try_cast(f[3] AS BIGINT) AS seed, CASE WHEN ltrim(f[3], '0') = '' THEN '0' ELSE ltrim(f[3], '0') END AS seed_digits, f[4]::DOUBLE AS f1, f[5]::DOUBLE AS \"time\", f[6] AS note FROM judged WHERE reason IS NULL AND layout = 'runs'",
}
