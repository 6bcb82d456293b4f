"""Profiles of queries: for each position the energies of the k-mers around it, chosen or blended.

Queries are rows, so many are built in one plan: (query, position, k-mers) meet the three indexes in left
joins. One query's profile is a few dozen rows and becomes literals of scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions.scoring import Position, Profile
from . import motif_index as M

STRATEGIES = ("hierarchical_5x5_3x3_1x1", "hierarchical_5x5degen1_3x3_1x1", "shrinkage_5x5_3x3_1x1", "blend_3x3_1x1")
DEGENERATE_WEIGHT, NEAR = 0.25, 50


def positions(queries: DataFrame) -> DataFrame:
    """(query, position, n, residue, k3, k5) for each position; terminal ones have no longer k-mers."""
    q = queries.select("query", F.length("query").alias("n"), F.explode(F.sequence(F.lit(1), F.length("query"))).alias("position"))
    inner = lambda half: (F.col("position") > half) & (F.col("position") <= F.col("n") - half)
    around = lambda half: F.when(inner(half), F.substring("query", F.col("position") - half, F.lit(2 * half + 1)))
    return q.select("query", "position", "n", F.substring("query", F.col("position"), F.lit(1)).alias("residue"), around(1).alias("k3"), around(2).alias("k5"))


def near_kmers(kmers: DataFrame, near: int = NEAR) -> DataFrame:
    """(seq) of all 5-mers with the centre of one of these (k5) and flanks within so much Grantham distance: 2,401
    for each at most, whatever the index holds."""
    pairs = kmers.sparkSession.createDataFrame([(a, b) for (a, b), d in A.distances().items() if d <= near], "a string, b string")
    out = kmers.select(F.col("k5").alias("seq"))
    for i in (1, 2, 4, 5):
        head, tail = F.substring("seq", 1, i - 1), F.expr(f"substring(seq, {i + 1})")
        out = out.join(F.broadcast(pairs), F.substring("seq", i, 1) == F.col("a")).select(F.concat(head, "b", tail).alias("seq")).distinct()
    return out


def indexes_for(queries: DataFrame, rows_1x1: DataFrame, rows_3x3: DataFrame, rows_5x5: DataFrame, strategy: str = STRATEGIES[0]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three indexes (arrays) of the k-mers alone that profiles of these queries look up. Motif rows (see
    motif_index.index_long) meet these k-mers before they are taken apart and shuffled, so that a few
    queries read the rows of a few dozen k-mers, not three whole indexes."""
    p = positions(queries)
    five = p.filter("k5 is not null").select("k5").distinct()
    wanted = (p.select(F.col("residue").alias("seq")), p.select(F.col("k3").alias("seq")), near_kmers(five) if strategy == STRATEGIES[1] else five.select(F.col("k5").alias("seq")))
    return tuple(M.build_index(rows.join(seqs.filter("seq is not null").distinct(), "seq", "left_semi")) for rows, seqs in zip((rows_1x1, rows_3x3, rows_5x5), wanted))


def degenerate_pool(kmers: DataFrame, index_5x5: DataFrame, near: int = NEAR) -> DataFrame:
    """(k5, count, buckets, mean, std): for each 5-mer the index's 5-mers with its centre and four
    flanks within so much Grantham distance, pooled by count.

    The flanks' near letters come from a table of 400 pairs; candidates are looked up by equi-join on the
    centre and the first flank, so no 5-mer meets all others."""
    spark = kmers.sparkSession
    pairs = spark.createDataFrame([(a, b) for (a, b), d in A.distances().items() if d <= near], "a string, b string")
    letter = lambda c, i: F.substring(c, i, 1)
    want = kmers.select("k5").distinct().withColumn("a", letter("k5", 1)).join(F.broadcast(pairs), "a").select("k5", F.col("b").alias("first"), letter("k5", 3).alias("centre"))
    have = index_5x5.select("*", letter("seq", 1).alias("first"), letter("seq", 3).alias("centre"))
    met = want.join(have, ["first", "centre"])
    for i in (2, 4, 5):
        met = met.join(F.broadcast(pairs), (letter("k5", i) == F.col("a")) & (letter("seq", i) == F.col("b")), "left_semi")
    cells = met.select("k5", "seq", "count", "buckets", F.posexplode(F.arrays_zip("mean", "std")).alias("idx", "e"))
    n, m, s = F.col("count"), F.col("e.mean"), F.col("e.std")
    pooled = cells.groupBy("k5", "idx").agg(F.sum("count").alias("n"), F.sum("buckets").alias("b"), (F.sum(n * m) / F.sum(n)).alias("mean"), (F.sum(n * (s * s + m * m)) / F.sum(n)).alias("q"))
    std = F.sqrt(F.greatest(F.col("q") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    rows = pooled.withColumn("std", std).groupBy("k5").agg(F.array_sort(F.collect_list(F.struct("idx", "mean", "std"))).alias("r"), F.first("n").alias("count"), F.first("b").alias("buckets"))
    return rows.select("k5", "count", "buckets", F.transform("r", lambda x: x["mean"]).alias("mean"), F.transform("r", lambda x: x["std"]).alias("std"))


def _blend(w: Column, x: str, y: str) -> tuple[Column, Column]:
    """Means and deviations of w of one row and 1 - w of another."""
    mean = F.zip_with(f"{x}.mean", f"{y}.mean", lambda a, b: w * a + (1 - w) * b)
    std = F.zip_with(f"{x}.std", f"{y}.std", lambda a, b: F.sqrt(w * w * a * a + (1 - w) * (1 - w) * b * b))
    return mean, std


def build(
    queries: DataFrame, index_1x1: DataFrame, index_3x3: DataFrame, index_5x5: DataFrame, strategy: str = STRATEGIES[0],
    strong_threshold: int = 100, strong_weight: float = 0.8, weak_weight: float = 0.5, prior_3x3: float = 25, prior_5x5: float = 10,
) -> DataFrame:
    """(query, position, residue, energies, stds, w5, w3, w1, mode, support, charge, aromatic) from array
    indexes. Terminal positions use the 1x1 index alone. A position whose k-mers are all missing has null energies."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown profile strategy {strategy!r}")
    p = positions(queries)
    entry = lambda ix, key, name: ix.select(F.col("seq").alias(key), F.struct("count", "buckets", "mean", "std").alias(name))
    j = p.join(entry(index_1x1, "residue", "e1"), "residue", "left").join(entry(index_3x3, "k3", "e3"), "k3", "left").join(entry(index_5x5, "k5", "e5"), "k5", "left")
    degenerate = strategy == STRATEGIES[1]
    if degenerate:
        pool = degenerate_pool(p.filter("k5 is not null"), index_5x5)
        j = j.join(pool.select("k5", F.struct("count", "buckets", "mean", "std").alias("ed")), "k5", "left")
    has = {k: F.coalesce(F.col(f"{k}.count") > 0, F.lit(False)) for k in ("e1", "e3", "e5", *(["ed"] if degenerate else []))}
    terminal = (F.col("position") == 1) | (F.col("position") == F.col("n"))
    pick = lambda e, mode, w5, w3, w1: F.struct(
        F.col(f"{e}.mean").alias("energies"), F.col(f"{e}.std").alias("stds"), F.lit(w5).alias("w5"), F.lit(w3).alias("w3"), F.lit(w1).alias("w1"), F.lit(mode).alias("mode"), F.col(f"{e}.count").cast("double").alias("support")
    )
    mix = lambda ms, w5, w3, w1, mode, support: F.struct(ms[0].alias("energies"), ms[1].alias("stds"), w5.alias("w5"), w3.alias("w3"), w1.alias("w1"), mode.alias("mode"), support.alias("support"))
    zero, one = F.lit(0.0), F.lit(1.0)
    if strategy == "blend_3x3_1x1":
        strong = F.col("e3.count") >= strong_threshold
        w = F.when(strong, strong_weight).otherwise(weak_weight)
        both = mix(_blend(w, "e3", "e1"), zero, w, 1 - w, F.when(strong, "strong").otherwise("weak"), w * F.col("e3.count") + (1 - w) * F.col("e1.count"))
        chosen = F.when(has["e1"] & has["e3"], both).when(has["e1"], pick("e1", "1x1_only", 0.0, 0.0, 1.0))
    elif strategy == "shrinkage_5x5_3x3_1x1":
        w3 = F.when(has["e3"], F.col("e3.count") / (F.col("e3.count") + prior_3x3)).otherwise(0.0)
        w5 = F.when(has["e5"], F.col("e5.count") / (F.col("e5.count") + prior_5x5)).otherwise(0.0)
        m3, s3 = _blend(w3, "e3", "e1")
        j = j.withColumn("b3", F.when(has["e3"], F.struct(m3.alias("mean"), s3.alias("std"), (w3 * F.col("e3.count") + (1 - w3) * F.col("e1.count")).alias("count"))).otherwise(F.struct("e1.mean", "e1.std", F.col("e1.count").cast("double").alias("count"))))
        five = mix(_blend(w5, "e5", "b3"), w5, (1 - w5) * w3, (1 - w5) * (1 - w3), F.lit("5x5_shrinkage"), w5 * F.col("e5.count") + (1 - w5) * F.col("b3.count"))
        three = mix((F.col("b3.mean"), F.col("b3.std")), zero, w3, 1 - w3, F.when(has["e3"], "3x3_shrinkage").otherwise("1x1_only"), F.col("b3.count"))
        chosen = F.when(has["e1"] & has["e5"], five).when(has["e1"], three)
    else:
        chosen = F.when(has["e5"], pick("e5", "5x5_primary", 1.0, 0.0, 0.0))
        if degenerate:
            w = F.lit(DEGENERATE_WEIGHT)
            blended = mix(_blend(w, "ed", "e3"), w, 1 - w, zero, F.lit("5x5_degen_3x3_blend"), w * F.col("ed.count") + (1 - w) * F.col("e3.count"))
            chosen = chosen.when(has["ed"] & has["e3"], blended).when(has["ed"], pick("ed", "5x5_degen_only", 1.0, 0.0, 0.0))
        chosen = chosen.when(has["e3"], pick("e3", "3x3_primary", 0.0, 1.0, 0.0)).when(has["e1"], pick("e1", "1x1_only", 0.0, 0.0, 1.0))
    chosen = F.when(terminal, F.when(has["e1"], pick("e1", "1x1_terminal", 0.0, 0.0, 1.0))).otherwise(chosen)
    out = j.withColumn("c", chosen)
    flags = [F.col("residue").isin(*"DERK").alias("charge"), F.col("residue").isin(*"FWY").alias("aromatic")]
    return out.select("query", "position", "residue", "c.*", *flags)


def queries_of(spark: SparkSession, sequences: list[str]) -> DataFrame:
    return spark.createDataFrame([(A.check_sequence(s, "query"),) for s in sequences], "query string")


def collect_profile(rows: DataFrame) -> Profile:
    """One query's profile as literals: a row per position. A position without energies is an error."""
    got = sorted(rows.select("position", "residue", "energies", "stds").collect())
    if missing := [r.position for r in got if r.energies is None]:
        raise ValueError(f"no index entry for positions {missing}")
    return [Position(r.residue, list(r.energies), list(r.stds)) for r in got]


def top_choices(rows: DataFrame, n: int = 4) -> DataFrame:
    """(query, position, rank, residue, energy): each position's n residues of least energy, ties in the alphabet's order."""
    if n < 1:
        raise ValueError("top_choices needs n of 1 or more")
    ranked = F.slice(F.array_sort(F.transform("energies", lambda e, i: F.struct(e.alias("energy"), i.alias("idx")))), 1, n)
    out = rows.select("query", "position", F.posexplode(ranked).alias("rank", "c"))
    return out.select("query", "position", (F.col("rank") + 1).alias("rank"), F.substring(F.lit(A.ALPHABET), F.col("c.idx") + 1, F.lit(1)).alias("residue"), F.col("c.energy").alias("energy"))


def context_of(index_3x3: DataFrame) -> dict[str, list[float]]:
    """Contextual rescue energies from the 3x3 index (arrays): for D, E, R and K, by triplet code, the energy of
    that residue at the triplet's centre; NaN where the index lacks the triplet. 8,000 triplets at most exist."""
    code = A.triplet_code(A.encode(F.col("seq")))
    energies = [F.get("mean", A.index_of(F.lit(r))).alias(r) for r in "DERK"]
    tables = {r: [float("nan")] * 8000 for r in "DERK"}
    for row in index_3x3.filter((F.length("seq") == 3) & A.is_valid(F.col("seq"))).select(code.alias("code"), *energies).collect():
        for r in tables:
            tables[r][row.code] = row[r]
    return tables
