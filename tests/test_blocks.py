"""Scans over blocks against scores of the windows one by one, and what makes up an alignment's score."""

import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_scan import naive, total

from seqspark.functions import alphabet as A
from seqspark.functions.scoring import Position
from seqspark.jobs import reports as R
from seqspark.operators import align as L
from seqspark.operators import blocks as B
from seqspark.operators import scan as O
from seqspark.operators.metrics import metrics, sliding_metrics
from seqspark.operators.windows import windows

GAPPED = "trim_query_one_target_gap"


def records(spark, rnd, n=40):
    text = lambda k: "".join(rnd.choice(A.ALPHABET * 5 + "XBJ") for _ in range(k))
    rows = [(i, f"h{i}", text(rnd.choice([0, 3, 4, 5, 9, 60, 300])), "x", 1) for i in range(n)] + [(n, None, None, "y", 2), (n + 1, "same", "DEKRFPDEKR", "z", 3), (n + 2, "same", "DEKRFPDEKR", "z", 3)]
    return spark.createDataFrame(rows, "record_ord long, header string, sequence string, lang string, score int").drop("score").repartition(3)


def profile_of(rnd, residues):
    return [Position(r, [rnd.randint(-40, 40) / 16 for _ in range(20)], [1 + rnd.random() for _ in range(20)]) for r in residues]


@pytest.mark.parametrize(
    "alignment, residues, options",
    [
        ("rigid", "TLVN", {}),
        ("rigid", "REKFD", {}),
        ("rigid", "REKFD", {"mode": "centered", "prefilter": 0.5}),
        ("rigid", "A", {"rescue": "none"}),
        ("rigid", "DEKR", {"context": True, "prefilter": 1.0, "prefilter_mode": "confidence_adjusted"}),
        (GAPPED, "REKF", {}),
        (GAPPED, "RDKFY", {"gap_penalty": 0.5, "flank": 2, "prefilter": 2.0}),
        (GAPPED, "FDL", {"gap_penalty": -0.25, "least": 1, "flank_weight": 1.0}),
        (GAPPED, "KRTE", {"max_gaps": 0, "flank": 0, "flank_weight": 0.0, "mode": "confidence_adjusted"}),
        (GAPPED, "EKDR", {"context": True, "rescue": "full"}),
        (GAPPED, "EKWR", {"rescue": "none", "flank": 3}),
    ],
)
def test_scan_over_blocks_equals_scores_of_windows(spark, monkeypatch, alignment, residues, options):  # F10, F12, B4, B5, D6, H1, H2
    rnd = random.Random(residues + str(options))
    monkeypatch.setattr(B, "BLOCK", 50)  # records are cut and joined
    recs, profile = records(spark, rnd), profile_of(rnd, residues)
    if options.get("context"):
        options = {**options, "context": {r: [rnd.choice([float("nan"), rnd.randint(-50, 50) / 16]) for _ in range(8000)] for r in "DERK"}}
    every = O.score_windows(recs, profile, alignment=alignment, keep=("lang",), **options).collect()
    want = sorted(every, key=lambda r: (r.score, r.record_ord, r.start))
    assert len(want) > 30
    for k in (1, 7, 10_000):
        assert O.scan(recs, profile, k, alignment=alignment, keep=("lang",), **options).select(*every[0].__fields__).collect() == want[:k]
    cut = want[len(want) // 5].score
    seen = Observation()
    hits = O.scan(recs, profile, threshold=cut, alignment=alignment, keep=("lang",), observe=seen, **options).select(*every[0].__fields__)
    assert sorted(hits.collect(), key=lambda r: (r.score, r.record_ord, r.start)) == [r for r in want if r.score <= cut]
    assert O.scan(recs, profile, threshold=cut, alignment=alignment, **options).select("record_ord", "start").collect() == [(r.record_ord, r.start) for r in want if r.score <= cut]
    scanned = windows(recs, len(profile)).count()
    passed = L.add_score(windows(recs, len(profile)), profile, options.get("prefilter_mode", "raw"), rescue=options.get("rescue", "full"), context=options.get("context")).filter(F.col("score") <= options.get("prefilter", 0)).count() if "prefilter" in options else 0
    assert seen.get == {"windows_scanned": scanned, "prefilter_passed": passed, "scored_windows": len(every), "threshold_passed": sum(r.score <= cut for r in every)}
    seen = Observation()
    assert len(O.scan(recs, profile, 3, alignment=alignment, observe=seen, **options).collect()) == 3
    assert seen.get["scored_windows"] == seen.get["threshold_passed"] == len(every)


def test_statistics_of_a_scan_are_one_pass(spark):  # D6, A16
    recs, profile = records(spark, random.Random(1)), profile_of(random.Random(2), "RLKE")
    seen = Observation()
    hits = O.scan(recs, profile, threshold=0.0, prefilter=0.5, observe=seen)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("CollectMetrics") == 1
    hits.collect()
    want = O.scan_stats(recs, profile, 0.5, 0.0, rescue="full").first().asDict()
    assert seen.get == want
    none = Observation()
    assert O.scan(recs.limit(0), profile, threshold=0.0, observe=none).count() == 0
    assert set(none.get.values()) == {0}


def test_bonus_over_blocks(spark, monkeypatch):  # G9, H3
    monkeypatch.setattr(B, "BLOCK", 64)
    recs = records(spark, random.Random(4))
    for n in (1, 2, 5, 9):
        codes = np.random.default_rng(n).integers(0, 20, 400)
        one = metrics(np.lib.stride_tricks.sliding_window_view(codes, n))
        for name, x in sliding_metrics(codes, n, len(codes) - n + 1).items():
            assert np.array_equal(x, one[name]), name
    every = O.add_bonus(windows(recs, 5), 5).collect()
    order = lambda r: (-r.bonus, r.record_ord, r.start)
    assert sorted(B.bonus_hits(recs, 5).collect(), key=order) == sorted(every, key=order)
    some = B.bonus_hits(recs, 5, 20, 0.3)
    assert O.top(some, 20, F.desc("bonus"), "record_ord", "start").collect() == sorted((r for r in every if r.bonus >= 0.3), key=order)[:20]


def test_breakdown_of_alignments(spark):  # F10, F11, A13
    rnd = random.Random(9)
    recs = records(spark, rnd)
    sequences = {r.record_ord: r.sequence for r in recs.collect()}
    for residues, options in (("REKFD", {}), ("KDW", {"least": 1, "flank": 2}), ("DERT", {"rescue": "none"})):
        profile = profile_of(rnd, residues)
        hits = O.scan(recs, profile, 200, alignment=GAPPED, breakdown=True, gap_penalty=0.25, **options).collect()
        assert any(r.peripheral for r in hits) and (bool(options) or any("<-" in b.label for r in hits for b in r.breakdown))
        for r in hits:
            part = profile[r.query_start - 1 : r.query_end]
            parts, letters = naive(r.aligned_window, part, options.get("rescue") != "none"), r.aligned_window
            assert [b.position for b in r.breakdown] == list(range(r.query_start, r.query_end + 1)) and all(b.label[0] == x for b, x in zip(r.breakdown, letters))
            for d in r.peripheral:  # eases an end by half of what the letter beside it scores lower
                i = d.position - r.query_start
                assert i in (0, len(part) - 1) and sequences[r.record_ord][d.target - 1] == d.residue and not (r.target_start <= d.target <= r.target_end and d.target != r.skipped)
                parts[i] += 0.5 * (part[i].energies[A.ALPHABET.index(d.residue)] - parts[i])
                assert d.energy == parts[i]
            assert [b.energy for b in r.breakdown] == parts
            assert r.score == pytest.approx(total(parts) + (0.25 if r.skipped else 0))


def test_breakdown_golden_and_report(spark):  # A13, F7, F8
    flat = lambda r, **e: Position(r, [e.get(a, 1.0) for a in A.ALPHABET])
    profile = [flat("L", D=-4.0), flat("K", L=-1.0, D=-3.0, E=-2.0), flat("L", L=-1.0, V=-5.0)]
    recs = spark.createDataFrame([(0, "a", "ADLEV")], "record_ord long, header string, sequence string")
    hit = O.scan(recs, profile, 1, alignment=GAPPED, breakdown=True, least=3, max_gaps=0).first()
    # K takes D and E (-3 - 0.7), E as the last letter is eased by V beside it (1 to -2).
    assert (hit.aligned_window, hit.score) == ("DLE", pytest.approx(-4 - 3.7 - 2))
    assert [(b.position, b.label, b.energy) for b in hit.breakdown] == [(1, "D", -4.0), (2, "L<-D@1,E@3", pytest.approx(-3.7)), (3, "E", -2.0)]
    assert [tuple(x) for x in hit.peripheral] == [(3, 5, "V", -2.0)]
    line = R.scan_report(O.scan(recs, profile, 1, alignment=GAPPED, breakdown=True, least=3, max_gaps=0)).first()
    assert line.periph == "q3@5:V:-2.0000" and line.breakdown == "q1:D:-4.0000 q2:L<-D@1,E@3:-3.7000 q3:E:-2.0000"
    plain = O.scan(recs, profile, 3, breakdown=True, rescue="none").collect()
    assert all(r.labels == list(r.window) and r.score == sum(r.energies) for r in plain)


def test_chunk_report_takes_statistics_from_the_hits_own_pass(spark, tmp_path):  # A16, D6, D7
    recs, profile = records(spark, random.Random(5)), profile_of(random.Random(6), "RLKE")
    seen = Observation()
    R.write_chunk_hits(O.scan(recs, profile, threshold=-2.0, prefilter=1.0, observe=seen), seen, {"profile": "p"}, str(tmp_path / "c"))
    lines = [x for part in sorted((tmp_path / "c").glob("part-*")) for x in part.read_text().splitlines()]
    want = O.scan_stats(recs, profile, 1.0, -2.0, rescue="full").first().asDict()
    assert lines[:6] == ["# profile\tp", *(f"# {c}\t{want[c]}" for c in B.COUNTS), "# header\tstart\tend\twindow\tscore"] and len(lines) == 6 + want["threshold_passed"] > 6
    shown = [float(x.split("\t")[4]) for x in lines[6:]]
    assert shown == sorted(shown)
    by = {r.lang: r for r in O.scan_stats(recs, profile, 1.0, -2.0, by=("lang",), rescue="full").collect()}
    assert set(by) == {"x", "y", "z"} and by["y"].windows_scanned == 0 and sum(r.threshold_passed for r in by.values()) == want["threshold_passed"]


@pytest.mark.parametrize("size", [1, 3, 14])
def test_kmer_counts(spark, monkeypatch, size):  # B9
    monkeypatch.setattr(B, "BLOCK", 40)  # long records go on over several blocks
    recs = records(spark, random.Random(size))
    per = windows(recs, size).groupBy(F.col("window").alias("kmer"), "record_ord").agg(F.count("*").alias("n"))
    want = per.groupBy("kmer").agg(F.sum("n").alias("n"), F.count("*").alias("records")).collect()
    assert sorted(B.kmer_counts(recs, size).collect()) == sorted(want) and want
    assert B.kmer_counts(recs.limit(0), size).count() == 0
    with pytest.raises(ValueError):
        B.kmer_counts(recs, 15)


def test_bounds_share_their_rows_and_keep_few():
    import tracemalloc

    import pyarrow as pa

    rnd, codes = random.Random(6), {c: i for i, c in enumerate(A.ALPHABET)}
    profile = profile_of(rnd, "REKFD")
    table = np.array([p.scores("raw", 1.0) for p in profile])
    text = "".join(rnd.choice(A.ALPHABET * 9 + "X") for _ in range(100_000))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([text])], names=["record_ord", "sequence"])
    (block,) = B.blocks(batch, 5, 1)
    block.at = block.at[block.sides(block.at)[2]]
    tracemalloc.start()
    low = B.Bound(table, profile, True, {}, 1, 1, None, 0.5)(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # not rows of all places, which are 0.8 MB each
    some = [i for i in rnd.sample(range(len(block.at)), 3000) if block.base[0] < block.at[i] < block.end[0] - 6]
    regions = np.array([[codes[c] for c in text[a - 1 : a + 6]] for a in (block.at[some] - block.base[0]).tolist()])
    score, _ = L.align(regions, table, profile, L.plan(5, 7), "full")
    assert (low[some] <= score + 1e-9).all()
