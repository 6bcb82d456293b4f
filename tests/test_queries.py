"""Registered queries on made tables: against their SQL, and what their plans leave out."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_blocks import profile_of, records

from seqspark.functions import alphabet as A
from seqspark.functions import sql
from seqspark.jobs import catalogue as C
from seqspark.operators import blocks as B
from seqspark.operators import scan as O
from seqspark.operators.windows import windows


@pytest.fixture
def made(spark, tmp_path):
    """A folder of tables whose documents have letters that charged and aromatic residues take donors from."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("MMMPFKDEYR" if i % 2 else A.ALPHABET + "xB ") for _ in range(rnd.choice([4, 9, 40, 400]))) for i in range(30)]
    rows = [(i, t, "en" if i % 3 else None, "web") for i, t in enumerate([*texts, None, "", "short"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def from_sql(name, made, columns):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{made}/{table}.parquet/*.parquet')")
    return con.execute(f"SELECT {', '.join(columns)} FROM ({C.ORACLE_SQL[name]})").fetchall()


@pytest.mark.parametrize("name", ["index_scan"])
def test_query_equals_its_sql(spark, made, name):
    got = C.QUERIES[name](spark, made)
    assert sorted(map(tuple, got.collect())) == sorted(from_sql(name, made, got.columns))


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_functions_of_arrays_of_windows(spark):
    names = [*sql.register(spark), *sql.register_arrays(spark)]
    assert names[-3:] == ["sequence_bonuses", "rigid_scores", "rescue_scores"]
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice(A.ALPHABET * 3 + "DERKFPX") for _ in range(n))
    tables = [[p.energies for p in profile_of(rnd, r)] for r in ("REKFD", "REKFD", "FED")]
    rows = [(i, [text(rnd.choice([3, 5, 5])) for _ in range(rnd.randint(0, 9))], "REKFD" if i % 5 else "FED", tables[i % 3] if i % 7 else None) for i in range(60)] + [(60, None, "REKFD", tables[0]), (61, [None, "", "AAAAA"], None, tables[0])]
    df = spark.createDataFrame(rows, "i int, w array<string>, residues string, energies array<array<double>>")
    constant = "array(" + ", ".join("array(" + ", ".join(f"{e}D" for e in row) + ")" for row in tables[0]) + ")"
    for energies in ("energies", constant):
        got = spark.sql(f"SELECT i, size(w) AS n, sequence_bonuses(w) AS b, rigid_scores(w, {energies}) AS s, rescue_scores(w, residues, {energies}) AS r FROM {{df}}", df=df).collect()
        one = spark.sql(f"SELECT i, at, if(is_sequence(x), sequence_bonus(x), NULL) AS b, rigid_score(x, {energies}) AS s, rescue_score(x, residues, {energies}) AS r FROM (SELECT *, posexplode(w) AS (at, x) FROM {{df}})", df=df)
        want = {(r.i, r.at): r for r in one.collect()}
        for g in got:
            assert (g.b is None) == (g.s is None) == (g.r is None) == (g.n is None or g.n < 0)
            for k in range(len(g.b or [])):
                w = want[g.i, k]
                assert (g.s[k], g.r[k]) == (w.s, w.r) and (g.b[k] is None if w.b is None else g.b[k] == pytest.approx(w.b))
        assert sum(w.r is not None for w in want.values()) > 20


def test_tiles_are_not_folded_one_by_one(spark, made):
    got = C.sql_tiles(spark, made)
    assert "aggregate(" not in plan_of(got) and sorted(map(tuple, got.collect())) == sorted(from_sql("sql_tiles", made, got.columns))


@pytest.mark.parametrize("length", [1, 9, 30])
def test_window_totals(spark, monkeypatch, made, length):
    monkeypatch.setattr(B, "BLOCK", 40)  # long records go on over several blocks
    recs = records(spark, random.Random(length)).unionByName(spark.createDataFrame([(99, "a", "A" * 500 + "C" * 20)], "record_ord long, header string, sequence string").withColumn("lang", F.lit("x")))
    want = windows(recs, length).groupBy("record_ord").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.min("window").alias("least"))
    got = B.window_totals(recs, length)
    assert sorted(got.collect()) == sorted(want.collect()) and got.dtypes == want.dtypes
    assert "Generate" not in plan_of(C.fasta_windows(spark, made))  # no row for a window, which sums would sort


def test_metric_means(spark, monkeypatch, made):
    monkeypatch.setattr(B, "BLOCK", 40)
    recs = records(spark, random.Random(6))
    want = O.add_metrics(windows(recs, 9), 9).groupBy("record_ord").agg(*[F.avg(m).alias(m) for m in B.H.METRICS])
    for g, w in zip(sorted(B.metric_means(recs, 9).collect()), sorted(want.collect()), strict=True):
        assert g.record_ord == w.record_ord and tuple(g) == pytest.approx(tuple(w))
    assert "Generate" not in plan_of(C.heuristic_metrics(spark, made))


def test_bonus_ranges(spark, monkeypatch, made):
    monkeypatch.setattr(B, "BLOCK", 40)
    recs = records(spark, random.Random(7))
    want = O.add_bonus(windows(recs, 9), 9).groupBy("record_ord").agg(F.min("bonus").alias("low"), F.avg("bonus").alias("mean"), F.max("bonus").alias("high"))
    for g, w in zip(sorted(B.bonus_ranges(recs, 9).collect()), sorted(want.collect()), strict=True):
        assert (g.record_ord, g.low, g.high) == (w.record_ord, w.low, w.high) and g.mean == pytest.approx(w.mean)
    assert "Generate" not in plan_of(C.heuristic_bonus(spark, made))


def test_bonus_counts(spark, monkeypatch, made):
    monkeypatch.setattr(B, "BLOCK", 40)
    recs = records(spark, random.Random(8))
    found = [r.bonus for r in O.add_bonus(windows(recs, 9), 9).collect()]
    levels = [-1.0, 0.4, sorted(found)[len(found) // 2], 9.0]
    assert tuple(B.bonus_counts(recs, 9, levels).first()) == (len(found), *(sum(b >= t for b in found) for t in levels))
    assert tuple(B.bonus_counts(recs.limit(0), 9, levels).first()) == (0,) * 5
    assert "Generate" not in plan_of(O.heuristic_report(C.T.records(spark, made), 9, levels)).replace("inline", "").split("== Optimized")[0].split("MapInArrow")[-1]
