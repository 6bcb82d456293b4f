"""Ranks of many targets against plain counts."""

import random

import pytest
from pyspark.sql import functions as F
from test_blocks import profile_of, records

from seqspark.functions import alphabet as A
from seqspark.functions import heuristics as H
from seqspark.operators import align as L
from seqspark.operators import blocks as B
from seqspark.operators import scan as O
from seqspark.operators.ranks import window_ranks
from seqspark.operators.windows import windows


@pytest.mark.parametrize("residues, rescue, bonus", [("REKF", "full", True), ("TLV", "full", False), ("DERK", "none", True)])
def test_window_ranks(spark, monkeypatch, residues, rescue, bonus):  # C8, C9, D9, D10, I3, I4, I5
    monkeypatch.setattr(B, "BLOCK", 50)
    rnd = random.Random(residues)
    recs, profile = records(spark, rnd), profile_of(rnd, residues)
    recs = recs.withColumn("header", F.when(F.col("record_ord") % 5 == 0, "same").otherwise(F.col("header")))
    every = L.add_score(windows(recs, len(profile)), profile, rescue=rescue).withColumn("b", F.round(H.bonus(H.metrics(F.col("window"))), 9) if bonus else F.lit(0.0))
    every = every.withColumn("f", F.round(F.col("score") - F.col("b"), 9)).collect()
    some = [rnd.choice(every).window for _ in range(60)] + ["".join(rnd.choice(A.ALPHABET) for _ in residues) for _ in range(60)]
    some[3] = some[4]
    got = window_ranks(recs, profile, [(f"t{i}", s) for i, s in enumerate(some)], rescue, bonus).collect()
    last = {}
    for r in sorted(every, key=lambda r: -r.f):  # the least comes last
        if r.record_ord >= last.get(r.header, (-1, 0))[0]:
            last[r.header] = (r.record_ord, r.f)
    known = {r.window: r for r in every}
    assert [(r.label, r.sequence) for r in got] == [(f"t{i}", s) for i, s in enumerate(some)]
    for r in got:
        if r.sequence in known:
            assert (r.score, r.bonus, r.final) == (known[r.sequence].score, known[r.sequence].b, known[r.sequence].f)
        better, above = sum(x.f < r.final for x in every), sum(f < r.final for _, f in last.values())
        assert (r.total, r.better, r.equal_score, r.same_sequence) == (len(every), better, sum(x.f == r.final for x in every), sum(x.window == r.sequence for x in every))
        assert (r["rank"], r.percent, r.entries, r.entry_rank, r.entry_percent) == (better + 1, 100.0 * (better + 1) / len(every), len(last), above + 1, 100.0 * (above + 1) / len(last))
        assert r.entry_equal == sum(f == r.final for _, f in last.values())


def test_plan_of_many_targets_is_that_of_few(spark):
    rnd = random.Random(1)
    recs, profile = records(spark, rnd), profile_of(rnd, "LVTA")
    many = [(str(i), "".join(rnd.choice(A.ALPHABET) for _ in range(4))) for i in range(5000)]
    plans = [window_ranks(recs, profile, some)._jdf.queryExecution().executedPlan().toString() for some in (many[:3], many)]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines()) and plans[1].count("MapInArrow") == 3
    got = window_ranks(recs, profile, many).collect()
    assert len(got) == 5000 and [r for r in got[:3]] == window_ranks(recs, profile, many[:3]).collect()
    assert window_ranks(recs, profile, []).count() == 0
    assert {(r.total, r.entries, r["rank"], r.percent, r.entry_percent) for r in window_ranks(recs.limit(0), profile, many[:2]).collect()} == {(0, 0, 1, None, None)}
    with pytest.raises(ValueError):
        O.window_ranks(recs, profile, [("x", "LVT")])
