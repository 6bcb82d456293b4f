"""Published indexes, modes of reading motif files, and the fasta data source (A5-A11, B8, K)."""

import random

import pytest
from pyspark.sql import functions as F

from seqspark.functions import alphabet as A
from seqspark.sources import fasta
from seqspark.sources import files as S


def index(spark, value, n=3):
    return spark.createDataFrame([(a, 1, 1, [value] * 20, [0.0] * 20, "1x1") for a in A.ALPHABET[:n]], "seq string, count long, buckets long, mean array<double>, std array<double>, motif_size string")


def test_a_failed_write_leaves_the_old_index(spark, tmp_path):  # A9-A11
    path = str(tmp_path / "ix")
    with pytest.raises(FileNotFoundError):
        S.load_index(spark, path, "root")
    S.store_index(index(spark, 1.0), path, "root")
    broken = index(spark, 2.0).withColumn("count", F.when(F.col("seq") == "K", F.raise_error(F.lit("broken off")).cast("long")).otherwise(F.col("count")))
    with pytest.raises(Exception, match="broken off"):
        S.store_index(broken, path, "root")
    before = S.load_index(spark, path, "root")
    assert {r["mean"][0] for r in before.collect()} == {1.0} and before.count() == 3
    S.store_index(index(spark, 3.0, 5), path, "root")
    assert S.load_index(spark, path, "root", "1x1").count() == 5 and before.count() == 3  # those who read the old one still can
    assert S.load_or_build_index(spark, path, "root", lambda: 1 / 0).count() == 5
    S.expire_index(spark, path)
    assert len(list((tmp_path / "ix").glob("rows-*"))) == 1 and S.load_index(spark, path, "root").count() == 5
    assert S.load_or_build_index(spark, path, "root", lambda: index(spark, 4.0, 2), rebuild=True).count() == 2
    with pytest.raises(ValueError):
        S.load_index(spark, path, "elsewhere")


def motifs(tmp_path):
    line = lambda n, res, num: f"ATOM  {n:>5}  CA  {res} A{num:>4}    {float(n):8.3f}{0:8.3f}{0:8.3f}"
    chain = lambda *names: "\n".join(line(i, r, i) for i, r in enumerate(names))
    cells = [f"a b {A.THREE[x]} {A.THREE[y]} {i * 20 + j}" for i, x in enumerate(A.ALPHABET) for j, y in enumerate(A.ALPHABET)]
    five = ("ALA", "ARG", "GLY", "LEU", "LYS")
    frags = {"1ABC_1_2": chain(*five), "1ABC_1_3": chain("ALA", "XXX", *five[2:]), "1ABC_1_4": chain(*five), "1ABC_1_5": chain(*five), "odd": chain(*five), "1ABC_1_6": chain(*five), "1ABC_1_7": chain(*five)}
    tables = {"1ABC_1_2": cells, "1ABC_1_3": cells, "1ABC_1_4": cells[1:], "odd": cells, "1ABC_1_6": ["a b c", *cells], "1ABC_1_7": [*cells, "a b ALA XXX 1"]}
    for folder, files, end in (("frags-5x5", frags, "pdb"), ("en-5x5", {k: "\n".join(v) for k, v in tables.items()}, "etab")):
        (tmp_path / folder).mkdir()
        for stem, text in files.items():
            (tmp_path / folder / f"{stem}.{end}").write_text(text)
    return str(tmp_path / "frags-5x5"), str(tmp_path / "en-5x5")


def test_modes_and_rejected_files(spark, tmp_path):  # B8, K1, K18, A1
    frags, en = motifs(tmp_path)
    with pytest.raises(Exception):
        S.read_motif_rows(spark, frags, en, "5x5").collect()
    with pytest.raises(Exception, match="5 fields|unknown residue|400 cells"):
        S.read_energy_tables(spark, en).collect()
    (row,) = S.read_motif_rows(spark, frags, en, "5x5", mode="DROPMALFORMED").collect()
    assert row.seq == "ARGLK" and row.row[0] == A.ALPHABET.index("R") * 20
    (row,) = S.read_motif_rows(spark, frags, en, "5x5", mode="DROPMALFORMED", center_5x5="true_center").collect()
    assert row.row[0] == A.ALPHABET.index("G") * 20
    assert sorted(map(tuple, S.rejected_motifs(spark, frags, en).collect())) == [
        ("1ABC_1_3", "fragment", "an unknown residue"),
        ("1ABC_1_4", "table", "an energy table needs 400 cells"),
        ("1ABC_1_5", "fragment", "no energy table"),
        ("1ABC_1_6", "table", "an energy line needs 5 fields"),
        ("1ABC_1_7", "table", "an unknown residue"),
        ("odd", "fragment", "a name that isn't of three parts"),
    ]
    for bad in ({"mode": "PERMISSIVE"}, {"center_5x5": "other"}):
        with pytest.raises(ValueError):
            S.read_motif_rows(spark, frags, en, "5x5", **bad)
    one = spark.range(1).select(F.lit("1abc").alias("p"), F.lit("1").alias("a"), F.lit("2").alias("b"))
    assert tuple(one.select(*S.motif_paths("/db", "5x5", F.col("p"), F.col("a"), F.col("b"))).first()) == ("/db/frags-5x5/1A/1ABC/1ABC_1_2.pdb", "/db/en-5x5/1A/1ABC/1ABC_1_2.etab")


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_fasta_data_source(spark, tmp_path, size):  # A5, A7
    fasta.register(spark)
    rnd = random.Random(size)
    odd = "junk\n>one x\nAAAK\n kkaaa \n\n> two\r\nQQQLRLQQQ\r\n>three\n  >four\nAC\rDE\r>five\rA B\n>>six\n\n"
    (tmp_path / "a.fasta").write_bytes(odd.encode())
    (tmp_path / "b.fasta").write_text("".join(f">r{i}\n" + "".join("ACDE"[rnd.randrange(4)] * rnd.randint(0, 9) + "\n" for _ in range(rnd.randint(0, 4))) for i in range(60)))
    (tmp_path / "c.fasta").write_text("no record\n" * 5)
    (tmp_path / "d.fasta").write_text("")
    (tmp_path / "e.txt").write_text(">not read\n")
    got = spark.read.format("fasta").option("splitBytes", size).load(str(tmp_path))
    want = sorted(S.read_fasta(spark, str(tmp_path), "*.fasta").select("record_ord", "header", "sequence").collect())
    rows = sorted(got.collect(), key=lambda r: r.record_ord)
    assert [(r.header, r.sequence) for r in rows] == [(r.header, r.sequence) for r in want]
    assert len({r.record_ord for r in rows}) == len(rows) == 66 and (size > 100 or got.rdd.getNumPartitions() > 10)
    assert spark.read.format("fasta").load(f"file://{tmp_path}/b.fasta").count() == 60
    with pytest.raises(Exception, match="no FASTA files"):
        spark.read.format("fasta").load(str(tmp_path / "none")).count()


def test_fasta_stream(spark, tmp_path):  # K
    fasta.register(spark)
    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.format("fasta").option("splitBytes", 10).load(str(tmp_path / "in"))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start(str(tmp_path / "out")).awaitTermination(90)
        return sorted((r.header, r.sequence) for r in spark.read.schema(fasta.SCHEMA).parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in" / "a.fasta").write_text(">a\nLRL\n>b\nAAA\nKKK\n")
    assert run() == [("a", "LRL"), ("b", "AAAKKK")]
    (tmp_path / "in" / "b.fasta").write_text(">c\nDE\n")
    assert run() == [("a", "LRL"), ("b", "AAAKKK"), ("c", "DE")]
    assert len(run()) == 3
