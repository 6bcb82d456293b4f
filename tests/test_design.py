"""Designs: the beam as one fold, and rescue against many profiles as rows, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F
from test_scan import naive, total

from seqspark.functions import alphabet as A
from seqspark.functions.scoring import Position, rescued, rescued_by_rows
from seqspark.operators import profiles as P
from seqspark.operators import scan as O


def energies(rnd):
    return [rnd.randint(-40, 40) / 16 for _ in range(20)]


def indexes(spark, rnd, triplets):
    make = lambda seqs: spark.createDataFrame([(s, rnd.randint(1, 50), 1, energies(rnd), [1.0] * 20) for s in seqs], "seq string, count long, buckets long, mean array<double>, std array<double>")
    return make(A.ALPHABET), make(triplets), make(["ADEKR", "EKRDD"])


def test_rescue_with_profiles_in_rows(spark):  # F5, L2
    rnd = random.Random(3)
    rows, want = [], []
    for i in range(60):
        n = rnd.choice([1, 2, 5, 9])
        residues, window = ("".join(rnd.choice("DERKFWYPAL") for _ in range(n)) for _ in range(2))
        profile = [Position(r, energies(rnd)) for r in residues]
        known = {window[j - 1 : j + 2]: energies(rnd) for j in range(1, n - 1) if rnd.random() < 0.5} if i % 2 else {}
        around = [known.get(window[j - 1 : j + 2]) if 0 < j < n - 1 else None for j in range(n)]
        rows.append((i, window, residues, [p.energies for p in profile], around))
        want.append(total(naive(window, profile, context={r: {t: m[A.ALPHABET.index(r)] for t, m in known.items()} for r in "DERK"})))
    df = spark.createDataFrame([*rows, (60, "AXA", "REK", [[0.0] * 20] * 3, None), (61, "AA", "REK", [[0.0] * 20] * 3, None)], "i int, window string, residues string, table array<array<double>>, around array<array<double>>")
    got = df.select("i", rescued_by_rows(F.col("window"), F.col("residues"), F.col("table"), F.col("around"))["total"].alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [*want, None, None]
    one = [Position(r, t) for r, t in zip("REKFD", [energies(rnd) for _ in range(5)])]
    both = spark.createDataFrame([("".join(rnd.choice("DERKF") for _ in range(5)),) for _ in range(50)], "w string").withColumn("table", F.array(*[F.array(*map(F.lit, p.energies)) for p in one]))
    both = both.select(rescued(F.col("w"), one).alias("a"), rescued_by_rows(F.col("w"), F.lit("REKFD"), F.col("table")).alias("b")).collect()
    assert all(r.a == r.b for r in both) and any(d != i for r in both for i, d in enumerate(r.a.donors))


def plain_beam(choices, beam):
    state = [(0.0, "")]
    for options in choices:
        state = sorted((s + e, t + r) for s, t in state for r, e in options)[:beam]
    return [(t, s) for s, t in state]


def test_beam_of_many_queries_in_one_plan(spark):  # L1, H5
    rnd = random.Random(8)
    rows = [(q, i + 1, [rnd.randint(-3, 3) / 4 for _ in range(20)]) for q, n in (("a", 1), ("b", 6), ("c", 12)) for i in range(n)]
    df = spark.createDataFrame(rows, "query string, position int, energies array<double>")
    got = {}
    for r in O.beam_designs(P.top_choices(df, 3), 10).collect():
        got.setdefault(r.query, []).append((r.sequence, r.score))
    for q in "abc":
        choices = [[(A.ALPHABET[i], e) for e, i in sorted((e, i) for i, e in enumerate(es))[:3]] for k, _, es in rows if k == q]
        assert got[q] == plain_beam(choices, 10)
    plans = [len(O.beam_designs(P.top_choices(df.filter(F.col("query") == q)), 10)._jdf.queryExecution().optimizedPlan().toString()) for q in "bc"]
    assert plans[0] == plans[1]  # whatever the length
    assert O.beam_designs(P.top_choices(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        O.beam_designs(P.top_choices(df), 0)


@pytest.mark.parametrize("rescue", ["none", "full"])
def test_reciprocal_designs(spark, rescue):  # L2, H6, C11
    rnd = random.Random(5)
    query = "KEDRFPDEA"
    triplets = [query[i : i + 3] for i in (0, 2, 3)] + ["AAA", "DDE"]
    ix = indexes(spark, rnd, triplets)
    sequences = ["".join(rnd.choice("DERKFWYPA") for _ in range(len(query))) for _ in range(30)]
    candidates = spark.createDataFrame([(s, rnd.randint(-9, 9) / 4, "x") for s in sequences] + [(sequences[0], 5.0, "y")], "sequence string, score double, reciprocal string")
    got = O.reciprocal_design(candidates.drop("reciprocal"), query, ix, None, P.STRATEGIES[3], rescue).collect()
    mean3 = {r.seq: r["mean"] for r in ix[1].collect()}
    context = {c: {t: mean3[t][A.ALPHABET.index(c)] for t in mean3} for c in "DERK"}
    want = []
    for r in candidates.collect():
        rows = sorted(P.build(spark.createDataFrame([(r.sequence,)], "query string"), *ix, strategy=P.STRATEGIES[3]).select("position", "residue", "energies").collect()) if r.sequence in sequences[:4] else None
        if rows:
            back = total(naive(query, [Position(x.residue, x.energies) for x in rows], rescue == "full", context))
            want.append((r.sequence, r.score, back))
    have = {(r.sequence, r.forward): r for r in got}
    assert len(got) == 31
    for sequence, forward, back in want:
        assert have[sequence, forward].reciprocal == pytest.approx(back) and have[sequence, forward].total == pytest.approx(forward + back)
    key = lambda r: (r.total, r.forward, r.reciprocal, r.sequence)
    assert got == sorted(got, key=key)
    with pytest.raises(ValueError):
        O.reciprocal_design(candidates, query, ix, rescue="some")


def test_reciprocal_scores_of_repeated_rows(spark):  # F9, D11
    rnd = random.Random(2)
    ix = indexes(spark, rnd, ["ARA", "KKK", "RAK"])[1]
    pairs = spark.createDataFrame([("ARA", "KKK", 1), ("ARA", "KKK", 1), ("ARA", "KKK", 1), ("ARA", "ARA", 2), ("AR", "KK", 3), (None, None, 4), (None, None, 4)], "query string, window string, n int")
    got = O.reciprocal_3x3(pairs, ix).collect()
    assert sorted(r.n for r in got) == [1, 1, 1, 2, 3, 4, 4]
    assert len({r.reciprocal_total for r in got if r.n == 1}) == 1 and {r.used for r in got if r.n == 1} == {1} and {r.used for r in got if r.n > 2} == {0}
    hits = spark.createDataFrame([(i, "h", 1, 3, w, float(i)) for i, w in enumerate(("KKK", "ARA", "KKK"))], "record_ord long, header string, start long, end long, window string, score double")
    assert [r.first_rank for r in O.rescore(hits, "ARA", ix).orderBy("first_rank").collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="more than 2 hits"):
        O.rescore(hits, "ARA", ix, most=2).collect()


@pytest.mark.parametrize("strategy", P.STRATEGIES)
def test_profiles_from_the_kmers_they_need(spark, strategy):  # C2, C3, D1, E1-E5
    rnd = random.Random(strategy)
    made = lambda seqs: spark.createDataFrame([(s, str(rnd.randint(0, 2)), energies(rnd)) for s in seqs for _ in range(rnd.randint(1, 4))], "seq string, geom string, row array<double>")
    queries = spark.createDataFrame([("ADEKRLV",), ("AD",), ("K",), ("LLVIMLA",)], "query string")
    near = ["LLVIM", "MLVLL", "IIVMI", "LLKIM", "ADEKR", "EDEKK", "WDEKR"]
    rows = (made(A.ALPHABET), made(["ADE", "EKR", "LVI", "WWW"]), made([*near, "WWWWW", "PPPPP"]))
    some, whole = P.indexes_for(queries, *rows, strategy), tuple(O.P.M.build_index(r) for r in rows)
    assert some[2].filter("seq in ('WWWWW', 'PPPPP')").count() == 0 and some[1].filter("seq = 'WWW'").count() == 0
    shown = lambda r: (r.query, r.position, r.mode, [round(x, 9) + 0.0 for x in [*(r.energies or []), *(r.stds or [])]])
    built = [sorted(shown(r) for r in P.build(queries, *ix, strategy=strategy).collect()) for ix in (some, whole)]
    assert built[0] == built[1]


def test_rescue_flags(spark):  # E7
    ix = indexes(spark, random.Random(1), [])
    rows = P.build(spark.createDataFrame([("MDERKFWYP",)], "query string"), *ix, strategy=P.STRATEGIES[3]).orderBy("position").collect()
    assert "".join(r.residue for r in rows if r.charge) == "DERK" and "".join(r.residue for r in rows if r.aromatic) == "FWY"
