"""Readers, the stored index and the stream (A1-A12, D1, K)."""

import pytest

from seqspark.functions import alphabet as A
from seqspark.functions.scoring import Position
from seqspark.operators import motif_index as M
from seqspark.sources import files as S
from seqspark.streaming.fasta_stream import scan_stream, stream_records

FASTA = "junk\n>one x\nAAAK\n kkaaa \n\n> two\r\nQQQLRLQQQ\r\n>three\n"


def test_fasta(spark, tmp_path):  # A5, A7
    (tmp_path / "a.fasta").write_text(FASTA)
    (tmp_path / "b.fasta").write_text(">four\nLRL\n")
    got = sorted((r.record_ord, r.header, r.sequence) for r in S.read_fasta(spark, str(tmp_path), "*.fasta").collect())
    assert got == [(0, "one x", "AAAKKKAAA"), (1, " two", "QQQLRLQQQ"), (2, "three", ""), (3, "four", "LRL")]


def test_fasta_in_splits(spark, tmp_path):  # A6: one file, many tasks
    want = [(i, f"r{i}", "ACDE" * (i % 40)) for i in range(400)]
    (tmp_path / "a.fasta").write_text("".join(f"{' ' * (i % 7 == 3)}>{h}\n{s[:60]}\n{s[60:]}\n" for i, h, s in want))
    (tmp_path / "b.fasta").write_text("no record\n")
    (tmp_path / "c.fasta").write_text("")
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "2000")
    try:
        got = S.read_fasta(spark, str(tmp_path), "*.fasta")
        assert S.fasta_chunks(spark.read, str(tmp_path / "a.fasta")).rdd.getNumPartitions() > 5
        assert sorted((r.record_ord, r.header, r.sequence) for r in got.collect()) == want
    finally:
        spark.conf.set(key, old)


def test_motifs_and_index(spark, tmp_path):  # A2, A3, A4, B7, B8, C1, D1, A9-A11
    line = lambda n, res, chain, num, x: f"ATOM  {n:>5}  CA  {res} {chain}{num:>4}    {x:8.3f}{0:8.3f}{0:8.3f}"
    frag, en = tmp_path / "frags-3x3" / "1A" / "1ABC", tmp_path / "en-3x3" / "1A" / "1ABC"
    frag.mkdir(parents=True), en.mkdir(parents=True)
    chain = [line(i, r, "A", i, float(i)) for i, r in enumerate(("ALA", "ARG", "GLY"))]
    (frag / "1ABC_1_2.pdb").write_text("\n".join([*chain, line(9, "ALA", "A", 0, 9.0), *(line(i, "LEU", "B", i, 2.0 * i) for i in range(2))]))
    (frag / "1ABC_3_4.pdb").write_text(line(1, "XXX", "A", 1, 0.0))
    cells = [f"a b {A.THREE[x]} {A.THREE[y]} {i * 20 + j}" for i, x in enumerate(A.ALPHABET) for j, y in enumerate(A.ALPHABET)]
    (en / "1ABC_1_2.etab").write_text("\n".join([*cells, f"a b {A.THREE['R']} {A.THREE['M']} -7"]))
    rows = S.read_motif_rows(spark, str(tmp_path / "frags-3x3"), str(tmp_path / "en-3x3"), "3x3")
    (r,) = rows.collect()
    k = A.ALPHABET.index("R")
    assert (r.seq, r.geom) == ("ARG", "1.0 2.0 1.0") and r.row == [-7.0, *range(k * 20 + 1, k * 20 + 20)]
    from pyspark.sql import functions as F

    build = lambda: M.build_index(rows).withColumn("motif_size", F.lit("3x3"))
    path = S.index_path(str(tmp_path / "cache"), "root")
    got = S.load_or_build_index(spark, path, "root", build).first()
    assert got.seq == "ARG" and got["count"] == 1 and got.mean[0] == -7.0
    with pytest.raises(ValueError):
        S.load_index(spark, path, "elsewhere")


def test_matrix(spark, tmp_path):  # A8
    names = A.STANDARD
    (tmp_path / "m.tsv").write_text("\t" + "\t".join(names) + "\n" + "".join(f"{a}\t" + "\t".join(str(ord(a) + ord(b) / 100) for b in names) + "\n" for a in names))
    directed = spark.createDataFrame([(a, 3, 2) for a in A.ALPHABET], "seq string, count long, buckets long")
    m = {r.seq: r for r in S.read_matrix_tsv(spark, str(tmp_path / "m.tsv"), directed).collect()}
    assert len(m) == 20 and m["A"].mean[A.ALPHABET.index("C")] == pytest.approx(65.67) and m["A"].std == [0.0] * 20 and m["A"]["count"] == 3


def test_stream(spark, tmp_path):  # K
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(FASTA)
    flat = lambda **e: [e.get(a, 1.0) for a in A.ALPHABET]
    profile = [Position("T", flat(L=-1.5)), Position("T", flat(R=-2.0)), Position("S", flat(L=-1.25))]
    scan_stream(stream_records(spark, str(tmp_path / "in")), profile, -4.0, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [(r.window, r.score) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("LRL", -4.75)]


def test_stream_writes_a_batch_once(spark, tmp_path):  # K: a batch tried again, equal headers
    import shutil

    (tmp_path / "in").mkdir()
    flat = lambda **e: [e.get(a, 1.0) for a in A.ALPHABET]
    profile = [Position("T", flat(L=-1.5)), Position("T", flat(R=-2.0)), Position("S", flat(L=-1.25))]

    def run():
        scan_stream(stream_records(spark, str(tmp_path / "in")), profile, -4.0, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        return spark.read.parquet(str(tmp_path / "out"))

    (tmp_path / "in" / "a.fasta").write_text(">same\nALRL\n>same\nLRL\n")
    assert sorted(r.start for r in run().collect()) == [1, 2]
    (tmp_path / "in" / "b.fasta").write_text(">other\nLRLLRL\n")
    got = run()
    assert got.count() == 4 and got.select("record_ord").distinct().count() == 3
    shutil.rmtree(tmp_path / "cp" / "commits")  # as if the job had died before it noted its batches
    assert run().count() == 4


def test_reports(spark, tmp_path):  # A13 to A18
    from seqspark.jobs import reports as R

    rows = spark.createDataFrame([(i, f"h{i}", i + 1, i + 3, "LRL", i * 0.5, [i, i + 1]) for i in (2, 0, 1)], "record_ord long, header string, start long, end long, window string, score double, tags array<long>")
    R.write_tsv(rows.select("header", "score", "tags"), str(tmp_path / "t"), 3, ("score",))
    assert [(r.header, r.score, r.tags) for r in spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).orderBy("header").collect()] == [("h0", "0.000", "0,1"), ("h1", "0.500", "1,2"), ("h2", "1.000", "2,3")]
    R.write_chunk_hits(rows, spark.createDataFrame([(7,)], "windows long"), {"profile": "p"}, str(tmp_path / "c"))
    lines = [x for part in sorted((tmp_path / "c").glob("part-*")) for x in part.read_text().splitlines()]
    assert lines == ["# profile\tp", "# windows\t7", "# header\tstart\tend\twindow\tscore", *(f"h{i}\t{i + 1}\t{i + 3}\tLRL\t{i * 0.5:.4f}" for i in range(3))]


def test_fixed_reports(spark, tmp_path):  # A13 to A19
    from seqspark.jobs import reports as R
    from seqspark.operators import profiles as P
    from seqspark.operators import scan as O

    recs = spark.createDataFrame([(0, "sp|P1|NAME text", "AAAKKKAAA"), (1, "b", "QQQLRLQQQ")], "record_ord long, header string, sequence string")
    profile = [Position(r, [-1.5 if a in "LR" else 1.0 for a in A.ALPHABET]) for r in "ETS"]
    flat = lambda **e: [e.get(a, 1.0) for a in A.ALPHABET]
    one = M.index_arrays(M.index_long(spark.createDataFrame([(a, "g", flat(L=-2.0, R=-1.0)) for a in A.ALPHABET], "seq string, geom string, row array<double>")))
    none = one.filter("false")

    shown = R.profile_report(P.build(P.queries_of(spark, ["EL"]), one, none, none)).collect()
    assert [(r.position, r.residue, r.mode, r.w1, r.support) for r in shown] == [(1, "E", "1x1_terminal", "1.00", "1.0"), (2, "L", "1x1_terminal", "1.00", "1.0")]
    assert shown[0].best.startswith("L:-2.0000, R:-1.0000, ") and len(shown[0].best.split(", ")) == 6

    hit = R.scan_report(O.scan(recs, profile, 1, breakdown=True)).first()
    assert (hit.score, hit.header, hit.span, hit.window, hit.breakdown) == ("-4.5000", "b", "4-6", "LRL", "q1:L:-1.5000 q2:R:-1.5000 q3:L:-1.5000")
    hits = O.scan(recs, profile, 1, alignment="trim_query_one_target_gap")
    hit = R.scan_report(hits).first()
    assert (hit.score, hit.q, hit.t, hit.skip, hit.aligned) == ("-4.5000", "1-3", "4-6", "None", "LRL")
    R.write_chunk_hits(hits, spark.createDataFrame([(7,)], "windows long"), {}, str(tmp_path / "c"))
    lines = [x for part in sorted((tmp_path / "c").glob("part-*")) for x in part.read_text().splitlines()]
    assert len(lines[1].split("\t")) == 11 and lines[2] == "b\t3\t5\tQLR\t-4.5000\t1\t3\t4\t6\t\tLRL"  # found through its flank

    row = R.rerank_report(O.rerank(recs, profile, 2, top_n=14, metrics=True)).first()
    assert len(row) == 20 and row.window == "LRL" and row.score == "-4.500000" and float(row.rank_score) == pytest.approx(-4.5 - float(row.bonus))
    rank = R.rank_report(O.window_ranks(recs, profile, [("x", "LRL"), ("y", "AAA")])).collect()
    assert len(rank[0]) == 14 and tuple(rank[0])[5:] == (1, f"{100 / 14:.6f}", 1, 1, 1, "50.000000", 1, 14, 2)
    assert rank[1].same_sequence == 2 and rank[1]["entries"] == 2
    empty = R.rank_report(O.window_ranks(recs.filter("false"), profile, [("x", "LRL")])).first()
    assert (empty["rank"], empty.percent, empty.total, empty["entries"], empty.entry_rank, empty.entry_percent) == (1, None, 0, 0, 1, None)

    ix = spark.createDataFrame([("ARA", flat(A=0.5, K=-2.0)), ("KKK", flat(R=-1.0))], "seq string, mean array<double>")
    got = R.rescore_report(O.rescore(O.scan(recs, profile, 14), "ARA", ix)).collect()
    by = {(r.header, r.start): r for r in got}
    best = by["sp|P1|NAME text", 4]
    assert len(best) == 13 and (best.accession, best.entry, best.reciprocal_rank, best.top_terms) == ("P1", "NAME", 1, "2:ARA>KKK:-3.0000")
    assert by["b", 4].top_terms == "" and by["b", 4].used == 0

    pairs = R.pair_report(M.reciprocal_pairs(M.index_long(spark.createDataFrame([(a, "g", flat(L=-2.0)) for a in "LA"], "seq string, geom string, row array<double>")))).collect()
    assert [tuple(r)[:5] for r in pairs] == [("A", "A", "1.0000", "1.0000", "2.0000"), ("A", "L", "-2.0000", "1.0000", "-1.0000"), ("L", "A", "1.0000", "-2.0000", "-1.0000"), ("L", "L", "-2.0000", "-2.0000", "-4.0000")]
    made = R.design_report(spark.createDataFrame([("LL", -1.0, -2.0, -3.0), ("AA", 0.0, -4.0, -4.0)], "sequence string, forward double, reciprocal double, total double")).collect()
    assert [tuple(r) for r in made] == [("-4.0000", "0.0000", "-4.0000", "AA"), ("-3.0000", "-1.0000", "-2.0000", "LL")]
