"""Functions of spark.sql against the column expressions (F1, F5, G1-G12)."""

import random

import pytest
from pyspark.sql import functions as F
from test_blocks import profile_of
from test_scan import naive, total

from seqspark.functions import alphabet as A
from seqspark.functions import heuristics as H
from seqspark.functions import sql


def test_functions(spark):
    names = sql.register(spark)
    rnd = random.Random(7)
    profile = profile_of(rnd, "REKFD")
    rows = [("".join(rnd.choice(A.ALPHABET if i % 3 else "DERKFP") for _ in range(5)),) for i in range(200)]
    df = spark.createDataFrame(rows, "window string")
    energies = "array(" + ", ".join("array(" + ", ".join(f"{e}D" for e in p.energies) + ")" for p in profile) + ")"
    got = spark.sql(
        f"""SELECT window, sequence_bonus(window) AS bonus, sequence_bonus(window, surface => 0D, repeat_penalty => 1D) AS other, rigid_score(window, {energies}) AS rigid, rescue_score(window, 'REKFD', {energies}) AS rescued,
            class_entropy(window) AS entropy, transition_rate(window) AS transition, longest_repeat(window) AS rep, longest_run(window, 'DE') AS acidic, surface_scale(window) AS surface, flex_scale(window) AS flex FROM {{df}}""",
        df=df,
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    m = {k: v.alias(k) for k, v in H.metrics(F.col("window")).items()}
    want = df.select("window", H.bonus(H.metrics(F.col("window"))).alias("bonus"), H.bonus(H.metrics(F.col("window")), H.BonusWeights(surface=0.0, repeat_penalty=1.0)).alias("other"), *m.values())
    for g, w in zip(got.collect(), want.collect()):
        plain = [p.energies[A.ALPHABET.index(x)] for p, x in zip(profile, g.window)]
        assert g.rigid == total(plain) and g.rescued == total(naive(g.window, profile))
        assert (g.bonus, g.other, g.entropy, g.transition, g.surface, g.flex) == pytest.approx((w.bonus, w.other, w.entropy, w.transition, w.surface, w.flex))
        assert (g.rep / 5, g.acidic / 5) == (w.repeat, w.acidic_run)
    odd = spark.sql(
        f"""SELECT residue_index('M'), residue_index('B'), grantham_distance('L', 'I'), grantham_distance('W', 'W'), grantham_distance('A', 'X'), is_sequence('AB'), is_sequence('AC'), class_labels('DKNGAX'), fraction_of('DEAA', 'DE'),
            rigid_score('AAXAA', {energies}), rescue_score('AAA', 'REKFD', {energies}), rigid_score(NULL, {energies}), longest_repeat('ABBBA'), class_entropy('A'), transition_rate('A')"""
    ).first()
    assert tuple(odd) == (0, -1, 5, 0, 999, False, True, "abpgho", 0.5, None, None, None, 3, 0.0, 0.0)
    assert {"sequence_bonus", "rescue_score", "grantham_distance"} <= set(names) and sql.register(spark) == names
