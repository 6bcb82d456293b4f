"""Goldens and brute-force checks of windows, scores, alignment and design (IDs of the survey in brackets)."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.functions import alphabet as A
from seqspark.functions import heuristics as H
from seqspark.functions.scoring import Position, labels, rescued, rigid_score
from seqspark.operators import align as L
from seqspark.operators import motif_index as M
from seqspark.operators import profiles as P
from seqspark.operators import scan as O
from seqspark.operators.metrics import metrics
from seqspark.operators.windows import header_fields, parse_targets, windows


def p(residue, **energies):
    return Position(residue, [energies.get(a, 1.0) for a in A.ALPHABET])


AEA = [p("R", A=1.0, E=-2.0), p("A", E=0.5), p("R", A=1.0, E=-2.0)]


def naive(window, profile, full=True, context=None):
    """Scores by the rules as they are stated, with a set of used donors."""
    used, out = set(), []
    for i, q in enumerate(profile):
        d = s = q.energies[A.ALPHABET.index(window[i])]
        if full and i not in used and q.residue in A.RESCUERS:
            found = []
            for j in (i - 1, i + 1):
                if 0 <= j < len(window) and j not in used and window[j] in A.RESCUERS[q.residue]:
                    e = q.energies[A.ALPHABET.index(window[j])]
                    if context and q.charged and 0 < j < len(window) - 1:
                        e = context[q.residue].get(window[j - 1 : j + 2], e)
                    if e < d:
                        found.append((e - d, e, j))
            if found := sorted(found):
                s, j = found[0][1:]
                used.add(j)
                if q.charged and len(found) > 1 and found[1][1] < 0:
                    both = max(s + 0.35 * found[1][1], 1.5 * s)
                    if both < s:
                        s = both
                        used.add(found[1][2])
        out.append(s)
    return out


def total(parts):
    t = 0.0
    for x in parts:
        t += x
    return t


@pytest.mark.parametrize(
    "window, profile, want",
    [
        ("AEA", AEA, -0.5),
        ("EAE", AEA, -3.0),
        ("EAD", [p("A"), p("R", E=-2.0, D=-1.0), p("A")], -0.35),
        ("EAD", [p("A"), p("R", E=-2.0, D=-1.9), p("A")], -0.665),
        ("AP", [p("F", P=-1.5), p("A")], -0.5),
    ],
)
def test_rescue_goldens(spark, window, profile, want):  # F5, F6
    got = spark.createDataFrame([(window,)], "w string").select(rescued(F.col("w"), profile)["total"]).first()[0]
    assert got == pytest.approx(want)


def test_trace_and_none(spark):  # F2, F7, F8
    r = spark.createDataFrame([("AEA",)], "w string").select(rescued(F.col("w"), AEA).alias("t"), rigid_score(F.col("w"), AEA).alias("n"), labels(F.col("w"), AEA, rescued(F.col("w"), AEA)).alias("l")).first()
    assert r.n == 2.5 and r.t.energies == [-2.0, 0.5, 1.0] and r.t.donors == [1, 1, 2] and r.l == ["A<-E@2", "E", "A"]


def test_context(spark):  # C6, F5
    table = ["NaN"] * 8000
    code = [A.ALPHABET.index(x) for x in "AEA"]
    table[code[0] * 400 + code[1] * 20 + code[2]] = -0.25
    none = ["NaN"] * 8000
    profile = [p("A"), p("R", E=-2.0), p("A"), p("A"), p("A")]
    context = {"R": table, "K": none, "D": none, "E": none}
    got = spark.createDataFrame([("AAEAA",)], "w string").select(rescued(F.col("w"), profile, context=context)["total"]).first()[0]
    assert got == 3.75
    numbers = {k: np.array(v, float) for k, v in context.items()}
    codes = np.array([[A.ALPHABET.index(x) for x in "AAEAA"]])
    assert L.rescue_scores(codes, np.array([q.energies for q in profile]), profile, numbers).sum() == 3.75


def test_rescue_matches_naive(spark):  # F3, F4, F5
    rnd = random.Random(1)
    profile = [Position(r, [rnd.randint(-40, 40) / 16 for _ in range(20)]) for r in "REKFDW"]
    ws = ["".join(rnd.choice("DERKPAFW") for _ in range(6)) for _ in range(400)]
    want = {w: total(naive(w, profile)) for w in ws}
    df = spark.createDataFrame([(w,) for w in ws], "window string")
    for name, got in (("fold", df.select("window", rescued(F.col("window"), profile)["total"].alias("s"))), ("kernel", L.add_score(df, profile, name="s"))):
        assert all(r.s == pytest.approx(want[r.window], abs=1e-12) for r in got.collect()), name


def test_scan_golden(spark):  # A5, B1, B2, F12, H1, H2
    recs = spark.createDataFrame([(0, "a", "AAAKKKAAA"), (1, "b", "QQQLRLQQQ"), (2, "c", "QL"), (3, "d", "")], "record_ord long, header string, sequence string")
    profile = [p("E", L=-1.5), p("T", R=-2.0), p("S", L=-1.25)]
    assert windows(recs, 3).count() == 14
    best = O.scan(recs, profile, 3, breakdown=True).first()
    assert (best.record_ord, best.start, best.end, best.window, best.score, best.labels) == (1, 4, 6, "LRL", -4.75, ["L", "R", "L"])
    skipped = spark.createDataFrame([(0, "x", "QQQLXRLQQQ")], recs.schema)
    assert sorted(r.start for r in windows(skipped, 3).collect()) == [1, 2, 6, 7, 8]
    assert O.scan(recs, profile, None, -4.0).count() == 1
    assert O.scan(recs, profile, 2, prefilter=-1.0, mode="centered").count() == 1
    with pytest.raises(ValueError):
        O.scan(recs, profile, 0)


@pytest.mark.parametrize("length, flank", [(1, 0), (3, 0), (5, 2), (7, 1)])
def test_windows_match_slices(spark, length, flank):  # B1, B6
    rnd = random.Random(length)
    seqs = ["".join(rnd.choice(A.ALPHABET + "X" * (k % 2)) for _ in range(n)) for k, n in enumerate((0, 1, length, 127, 128, 129, 300, 700))]
    recs = spark.createDataFrame([(i, f"h{i}", s) for i, s in enumerate(seqs)], "record_ord long, header string, sequence string")
    want = set()
    ok = lambda s: not set(s) - set(A.ALPHABET)
    for i, s in enumerate(seqs):
        for a in range(len(s) - length + 1):
            lo, hi = max(0, a - flank), min(len(s), a + length + flank)
            if ok(s[a : a + length]):
                want.add((i, a + 1, s[a : a + length], *((s[lo:hi] if ok(s[lo:hi]) else None, lo + 1) if flank else ())))
    got = {(r.record_ord, r.start, r.window, *((r.region, r.region_from) if flank else ())) for r in windows(recs, length, (), flank).collect()}
    assert got == want


def test_plan_sizes():  # C10
    assert len(L.plan(17, 19)) == 149 and len(L.plan(23, 25)) == 197 and len(L.plan(17, 17)) == 39


def test_semiglobal_matches_naive(spark):  # F10, F11, D13
    rnd = random.Random(3)
    profile = [Position(r, [rnd.randint(-40, 40) / 16 for _ in range(20)]) for r in "REKF"]
    recs = spark.createDataFrame([(0, "a", "".join(rnd.choice("DERKPAFWX") for _ in range(80)))], "record_ord long, header string, sequence string")
    seq = recs.first().sequence
    for rescue in ("full", "none"):
        rows = L.semiglobal(windows(recs, 4, (), 1), profile, rescue=rescue, gap_penalty=0.25).collect()
        assert rows
        for r in rows:
            region, best = r.region, None
            for qs, qe, ts, gap in L.plan(4, len(region)):
                k = qe - qs
                cols = [ts + x for x in range(k + (gap >= 0)) if x != gap]
                parts = naive("".join(region[c] for c in cols), profile[qs:qe], rescue == "full")
                ends = [(0, cols[0] - 1), (k - 1, cols[-1] + 1)]
                for i, at in ends if k > 1 else []:
                    if 0 <= at < len(region):
                        f = profile[qs + i].energies[A.ALPHABET.index(region[at])]
                        parts[i] += 0.5 * min(0.0, f - parts[i])
                t = total(parts) + (0.25 if gap >= 0 else 0)
                if best is None or t < best[0]:
                    best = (t, qs + 1, qe, r.region_from + ts, r.region_from + cols[-1] if gap < k else r.region_from + ts + k)
            assert (r.score, r.query_start, r.query_end, r.target_start) == (pytest.approx(best[0]), *best[1:4])
            span = seq[r.target_start - 1 : r.target_end]
            assert r.aligned_window == (span if r.skipped is None else span[: r.skipped - r.target_start] + span[r.skipped - r.target_start + 1 :])


@pytest.mark.parametrize(
    "window, want", [("LRLLKKHNYNILQVVTE", 0.248699), ("LNLRLLKKHNYNILQVVTELLQL", 0.303208), ("ETSEAKGPDGMALPRPR", 0.741522), ("FGFETSEAKGPDGMALPRPRDQA", 0.706304), ("DDDDD", -1.987829), ("A", -0.239145)]
)
def test_bonus_goldens(spark, window, want):  # G1-G10
    df = spark.createDataFrame([(window,)], "window string")
    assert df.select(H.bonus(H.metrics(F.col("window")))).first()[0] == pytest.approx(want, abs=2e-6)
    kernel = metrics(L._codes([window], len(window)))
    column = df.select(*[c.alias(k) for k, c in H.metrics(F.col("window")).items()]).first()
    assert all(kernel[k][0] == pytest.approx(column[k], abs=1e-12) for k in H.METRICS)


def test_mixture_golden(spark):  # D1, D2
    rows = [("A", "g", [x] * 20) for x in (-0.5, 0.0, 0.5)] + [("A", "h", [2.0] * 20)]
    r = M.index_long(spark.createDataFrame(rows, "seq string, geom string, row array<double>")).filter("idx = 0").first()
    s1 = math.sqrt(0.5 / 3)
    mean = -math.log(0.75 + 0.25 * math.exp(-2))
    assert r["count"] == 4 and r.buckets == 2 and r.mean == pytest.approx(0.24355824435274565) and r.mean == pytest.approx(mean)
    assert r.std == pytest.approx(math.sqrt(0.75 * (s1**2 + mean**2) + 0.25 * (2 - mean) ** 2))


def test_beam_golden(spark):  # L1, H5, E8
    flat = lambda **e: [e.get(a, 1.0) for a in A.ALPHABET]
    rows = spark.createDataFrame([("AA", 1, flat(L=-2.0, V=-1.0)), ("AA", 2, flat(R=-3.0, K=-0.5))], "query string, position int, energies array<double>")
    got = [tuple(r) for r in O.beam_design(P.top_choices(rows, 2), 4).collect()]
    assert got[0] == ("LR", -5.0) and ("VK", -1.5) in got


def test_small_parts(spark):  # B12, B13, G12, B10, B11
    assert A.distances()["L", "I"] == 5 and A.distances()["C", "W"] == 215 and len(A.distances()) == 400
    assert parse_targets(["x= lrl "], 3) == [("x", "LRL")]
    with pytest.raises(ValueError):
        parse_targets(["LRL"], 3)
    r = spark.createDataFrame([("sp|P1|NAME some text",), ("plain",)], "h string").select(*header_fields(F.col("h"))).collect()
    assert [tuple(x) for x in r] == [("P1", "NAME"), ("", "")]
    w = spark.createDataFrame([("LRX",)], "w string").select(A.encode(F.col("w")).alias("c"), A.decode(A.encode(F.lit("LRL"))).alias("d"), A.triplet_code(A.encode(F.lit("GMK"))).alias("t")).first()
    assert w.c == [10, 4, -1] and w.d == "LRL" and w.t == 402


def test_reciprocal_3x3(spark):  # F9, C7
    flat = lambda **e: [e.get(a, 1.0) for a in A.ALPHABET]
    ix = spark.createDataFrame([("ARA", flat(A=0.5, E=-2.0)), ("EAE", flat(R=-1.0))], "seq string, mean array<double>")
    got = O.reciprocal_3x3(spark.createDataFrame([("ARA", "EAE"), ("AAA", "EAE"), ("A", "A")], "query string, window string"), ix)
    by = {r["query"]: r for r in got.collect()}
    assert by["ARA"].reciprocal_total == -3.0 and by["ARA"].used == 1
    assert by["AAA"].used == 0 and math.isnan(by["AAA"].reciprocal_mean) and by["A"].reciprocal_total == 0.0


def test_context_from_index(spark):  # C6
    flat = lambda **e: [e.get(a, 1.0) for a in A.ALPHABET]
    ix = spark.createDataFrame([("AEA", flat(R=-0.25)), ("EA", flat()), ("XEA", flat())], "seq string, mean array<double>")
    context = P.context_of(ix)
    code = lambda t: sum(A.ALPHABET.index(x) * 20 ** (2 - i) for i, x in enumerate(t))
    assert context["R"][code("AEA")] == -0.25 and context["K"][code("AEA")] == 1.0
    assert sorted(context) == sorted("DERK") and sum(not math.isnan(x) for x in context["R"]) == 1
    profile = [p("A"), p("R", E=-2.0), p("A"), p("A"), p("A")]
    got = L.add_score(spark.createDataFrame([("AAEAA",), ("AAEAG",), ("AAEGA",)], "window string"), profile, context=context).collect()
    assert {r.window: r.score for r in got} == {"AAEAA": 3.75, "AAEAG": 3.75, "AAEGA": 2.0}
    assert all(math.isnan(x) for x in P.context_of(ix.filter("false"))["D"])


def test_rerank_aligned(spark):  # B3, F10, H4
    recs = spark.createDataFrame([(0, "a", "AAAKKKAAA"), (1, "b", "QQQLRLQQQ"), (2, "c", "XLRLQ"), (3, "d", "")], "record_ord long, header string, sequence string")
    profile = [p("E", L=-1.5), p("T", R=-2.0), p("S", L=-1.25)]
    every = O.rerank(recs, profile, 100).collect()
    some = O.rerank(recs, profile, 100, bonus_threshold=0.5).collect()
    assert len(every) == 16 and [r for r in every if r.bonus >= 0.5] == some
    got = O.rerank(recs, profile, 100, alignment="trim_query_one_target_gap").collect()
    assert {(r.record_ord, r.start) for r in got} == {(r.record_ord, r.start) for r in every} - {(2, 2)}
    scores = {(r.record_ord, r.start): r.score for r in O.scan(recs, profile, None, alignment="trim_query_one_target_gap").collect()}
    assert all(r.rank_score == r.score - r.bonus and r.score == scores[r.record_ord, r.start] for r in got)
    assert [r.rank_score for r in got] == sorted(r.rank_score for r in got)
    with pytest.raises(ValueError):
        O.rerank(recs, profile, 5, alignment="other")
