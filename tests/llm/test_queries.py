from collections import Counter
from pathlib import Path

import duckdb
import pytest

import compare
from tallygrid.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, D)
    ask = con.execute(queries.SQL[name])
    names = [x[0] for x in ask.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(compare.cell(r[c]) for c in names) for r in df.collect()) == Counter(tuple(map(compare.cell, r)) for r in ask.fetchall())


def test_short_sources_by_hand(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").toPandas()
    targets = spark.read.parquet(f"{D}/mix_targets.parquet").toPandas()
    from tallygrid.llm import tokens

    enc = tokens.Encoder(open(tokens.VOCABULARY, "rb").read())
    docs["n"] = [len(x) for x in enc.encode([t if isinstance(t, str) else None for t in docs.text])]
    n = docs.groupby("source").n.sum()
    total = n.reindex(targets.source).sum()
    want = {t.source for t in targets.itertuples() if n.get(t.source, 0) * t.max_repeats < t.target_share * total}
    assert {r.source for r in queries.p8_found(spark, D).collect()} == want
