"""Scans, reranking, exact ranks, reciprocal rescoring and design."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import heuristics as H
from ..functions import scoring as S
from . import align as L
from . import blocks as B
from . import profiles as P
from .metrics import add_bonus, add_metrics
from .ranks import window_ranks
from .windows import windows

__all__ = ["add_bonus", "window_ranks"]  # offered here as well
ORDER = ("score", "record_ord", "start")
ALIGNMENTS = ("rigid", "trim_query_one_target_gap")


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of a total order: each partition keeps k, so no full sort."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    return df.orderBy(*order).limit(k)


def score_windows(
    records: DataFrame, profile: S.Profile, mode: str = "raw", floor: float = 1.0, rescue: str = "full", alignment: str = "rigid",
    prefilter: float | None = None, prefilter_mode: str = "raw", threshold: float | None = None, flank: int = 1, keep: tuple[str, ...] = (), context=None, **options,
) -> DataFrame:
    """All windows with their scores, after the prefilter (a rigid score at most so much, cheap) and the
    threshold. Filters precede the costlier score; a score that both need is one expression."""
    if alignment not in ALIGNMENTS:
        raise ValueError(f"unknown alignment mode {alignment!r}")
    rigid = alignment == "rigid"
    w = windows(records, len(profile), keep, 0 if rigid else flank)
    if prefilter is not None:
        w = L.add_score(w, profile, prefilter_mode, floor, rescue, context, "pre_").filter(F.col("pre_") <= prefilter)
        w = w.withColumnRenamed("pre_", "score") if rigid and mode == prefilter_mode else w.drop("pre_")
    if rigid:
        w = w if "score" in w.columns else L.add_score(w, profile, mode, floor, rescue, context)
    else:
        if not flank:
            w = w.withColumns({"region": F.col("window"), "region_from": F.col("start")})
        w = L.semiglobal(w, profile, mode, floor, rescue, context=context, **options)
    return w if threshold is None else w.filter(F.col("score") <= threshold)


def scan(records: DataFrame, profile: S.Profile, top_k: int | None = 25, threshold: float | None = None, breakdown: bool = False, digits: int | None = None, observe: Observation | None = None, **options) -> DataFrame:
    """Hits, best first, ties in scan order: all under the threshold if there is one, else the top k. With digits
    scores are rounded first. The breakdown is found for hits only: ``labels`` and ``energies`` of a rigid hit's
    positions, ``breakdown`` and ``peripheral`` of an aligned one's (align.add_breakdown).

    An observation gets the run's statistics (scan_stats) from the pass that finds the hits. Hits under a
    threshold are unordered then: a range sort would read them, and count them, twice."""
    alignment = options.get("alignment", "rigid")
    if alignment not in ALIGNMENTS:
        raise ValueError(f"unknown alignment mode {alignment!r}")
    if threshold is None and top_k is not None and top_k < 1:
        raise ValueError("k must be 1 or more")
    hits = B.scan_hits(records, profile, top_k, threshold=threshold, digits=digits, observe=observe, **options)
    whole = threshold is not None or top_k is None
    in_order = (lambda df: df) if whole and observe is not None else (lambda df: df.orderBy(*ORDER))
    hits = in_order(hits) if whole else top(hits, top_k, *ORDER)
    score = {k: options[k] for k in ("mode", "floor", "context") if k in options}
    if breakdown and alignment == "rigid":
        own = profile if S.rescues(profile, options.get("rescue", "full")) else [S.Position("A", p.energies, p.stds) for p in profile]  # A takes no donors
        traced = hits.withColumn("trace", S.rescued(F.col("window"), own, **score))
        hits = in_order(traced.withColumns({"labels": S.labels(F.col("window"), own, F.col("trace")), "energies": F.col("trace.energies")}).drop("trace"))
    elif breakdown:
        hits = in_order(L.add_breakdown(hits, profile, **score, **{k: options[k] for k in ("rescue", "flank_weight") if k in options}))
    return hits


def scan_stats(records: DataFrame, profile: S.Profile, prefilter: float | None, threshold: float | None, by: tuple[str, ...] = (), rescue: str = "none", mode: str = "raw", **options) -> DataFrame:
    """Windows scanned, passing the prefilter, scored and passing the threshold: one pass, one row (for each value
    of ``by``). Records count in numpy, so no window becomes a row."""
    per = B.scan_hits(records, profile, None, mode=mode, rescue=rescue, prefilter=prefilter, threshold=threshold, keep=by, counts_only=True, **options)
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in B.COUNTS]
    return per.groupBy(*by).agg(*counts) if by else per.agg(*counts)


def with_bonus(w: DataFrame, length: int, weights: H.BonusWeights = H.BonusWeights()) -> DataFrame:
    """Adds the heuristic metrics and their bonus to windows of this length."""
    return add_metrics(w, length).withColumn("bonus", F.round(H.bonus({k: F.col(k) for k in H.METRICS}, weights), 9))


def heuristic_report(records: DataFrame, length: int, thresholds: list[float], top_n: int | None = None) -> DataFrame:
    """(threshold, passed, percent): how many windows reach each bonus; all thresholds in one pass."""
    some = sorted(set(thresholds))
    one = B.bonus_counts(records, length, some)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("passed")) for i, t in enumerate(some)])
    out = one.select("n", F.inline(rows)).select("threshold", "passed", (100.0 * F.col("passed") / F.col("n")).alias("percent"))
    if top_n is None:
        return out
    share = one.select(F.lit(None).cast("double").alias("threshold"), F.least(F.lit(top_n).cast("long"), "n").alias("passed"), F.col("n"))
    return out.unionByName(share.select("threshold", "passed", (100.0 * F.col("passed") / F.col("n")).alias("percent")))


def rerank(
    records: DataFrame, profile: S.Profile, top_k: int = 50, bonus_threshold: float | None = None, top_n: int | None = None, threshold: float | None = None,
    alignment: str = "rigid", flank: int = 1, metrics: bool = False, **score,
) -> DataFrame:
    """Windows by score less bonus, after a bonus threshold or the top n by bonus, so that few are scored.
    A semiglobal alignment leaves out windows whose region has other letters, as scans do. With metrics the
    heuristic metrics of the hits stay as columns."""
    if alignment not in ALIGNMENTS:
        raise ValueError(f"unknown alignment mode {alignment!r}")
    rigid = alignment == "rigid"
    w = B.bonus_hits(records, len(profile), top_n, bonus_threshold, 0 if rigid else flank)
    if top_n is not None:
        w = top(w, top_n, F.desc("bonus"), "record_ord", "start")
    if not rigid and not flank:
        w = w.withColumns({"region": F.col("window"), "region_from": F.col("start")})
    w = L.add_score(w, profile, **score) if rigid else L.semiglobal(w, profile, **score)
    if threshold is not None:
        w = w.filter(F.col("score") <= threshold)
    hits = top(w.withColumn("rank_score", F.col("score") - F.col("bonus")), top_k, "rank_score", "record_ord", "start")
    return add_metrics(hits, len(profile)).orderBy("rank_score", "record_ord", "start") if metrics else hits


def reciprocal_3x3(pairs: DataFrame, index_3x3: DataFrame, metric: str = "sum", require_full: bool = False) -> DataFrame:
    """Adds reciprocal_total, used, reciprocal_mean (NaN without a position) and terms (the six lowest) to rows
    with ``query`` and ``window`` of one length: for each inner place whose two triplets the index (arrays)
    holds, the energy of the target's centre in the query's triplet and the reverse, each eased by
    neighbours that suit. Each pair of texts is scored once, whatever the rows that have it, and all of these
    rows stay; rows with a null have no position. Triplets meet the index in two equi-joins."""
    if metric not in ("sum", "mean"):
        raise ValueError(f"unknown metric {metric!r}")
    keys = pairs.columns
    inner = F.when(F.length("query") >= 3, F.sequence(F.lit(2), F.length("query") - 1)).otherwise(F.array().cast("array<int>"))
    checked = pairs.select("query", "window").distinct().filter("query is not null and window is not null").withColumn("row_", F.assert_true(F.length("query") == F.length("window"), F.lit("query and window differ in length"))).filter("row_ is null").drop("row_")
    places = checked.withColumn("place", F.explode(inner)).withColumns({"q3": F.substring("query", F.col("place") - 1, F.lit(3)), "t3": F.substring("window", F.col("place") - 1, F.lit(3))})
    ix = index_3x3.select("seq", "mean")
    joined = places.join(ix.select(F.col("seq").alias("q3"), F.col("mean").alias("qm")), "q3", "left").join(ix.select(F.col("seq").alias("t3"), F.col("mean").alias("tm")), "t3", "left")
    both = F.col("qm").isNotNull() & F.col("tm").isNotNull()
    if require_full:
        joined = joined.withColumn("ok_", F.assert_true(both, F.lit("a triplet isn't in the 3x3 index"))).filter("ok_ is null").drop("ok_")
    suits = F.create_map(*[F.lit(x) for r in A.ALPHABET for x in (r, A.RESCUERS.get(r, ""))])

    def eased(source: str, target: str, row: str):
        own = F.get(F.col(row), A.index_of(F.substring(target, 2, 1)))
        for i in (1, 3):
            x = F.substring(target, i, 1)
            own = F.when(F.contains(F.element_at(suits, F.substring(source, 2, 1)), x), F.least(own, F.get(F.col(row), A.index_of(x)))).otherwise(own)
        return own

    scored = joined.filter(both).withColumns({"forward": eased("q3", "t3", "qm"), "reverse": eased("t3", "q3", "tm")})
    scored = scored.withColumn("combined", (F.col("forward") + F.col("reverse")) / (2 if metric == "mean" else 1))
    term = F.struct("combined", "place", "q3", "t3", "forward", "reverse")
    sums = scored.groupBy(F.col("query").alias("query_"), F.col("window").alias("window_")).agg(F.sum("combined").alias("reciprocal_total"), F.count("*").alias("used"), F.array_sort(F.collect_list(term)).alias("terms"))
    same = F.col("query").eqNullSafe(F.col("query_")) & F.col("window").eqNullSafe(F.col("window_"))
    out = pairs.join(sums, same, "left").select(*keys, F.coalesce("reciprocal_total", F.lit(0.0)).alias("reciprocal_total"), F.coalesce("used", F.lit(0)).cast("long").alias("used"), "terms")
    return out.withColumn("reciprocal_mean", F.when(F.col("used") > 0, F.col("reciprocal_total") / F.col("used")).otherwise(F.lit(float("nan")))).withColumn("terms", F.slice("terms", 1, 6))


def rescore(hits: DataFrame, query: str, index_3x3: DataFrame, metric: str = "sum", most: int = 100_000) -> DataFrame:
    """First-pass hits with first_rank, reciprocal scores and their rank by (reciprocal_total, first_rank). Hits
    are a top k: more than ``most`` are an error, so that the ranks' one task is bounded."""
    few = hits.orderBy(*ORDER).limit(most + 1)
    first = few.withColumn("first_rank", F.row_number().over(Window.orderBy(*ORDER))).withColumn("query", F.lit(query))
    first = first.withColumn("ok_", F.assert_true(F.col("first_rank") <= most, F.lit(f"more than {most} hits to rescore"))).filter("ok_ is null").drop("ok_")
    scored = reciprocal_3x3(first, index_3x3, metric)
    return scored.withColumn("reciprocal_rank", F.row_number().over(Window.orderBy("reciprocal_total", "first_rank")))


def beam_design(choices: DataFrame, beam: int = 1000) -> DataFrame:
    """(sequence, score) of one query's choices (see ``beam_designs``)."""
    return beam_designs(choices, beam).select("sequence", "score")


def beam_designs(choices: DataFrame, beam: int = 1000) -> DataFrame:
    """(query, sequence, score): for each query, position by position, the beam's sequences with each of the
    position's choices (see profiles.top_choices), of which the best ``beam`` go on; ties by sequence.

    The beam is an array that one fold carries over the positions, so the plan doesn't grow with their number
    and queries spread over tasks; a row holds ``beam`` sequences."""
    if beam < 1:
        raise ValueError("beam must be 1 or more")
    each = choices.groupBy("query", "position").agg(F.array_sort(F.collect_list(F.struct("rank", "residue", "energy"))).alias("options"))
    by_place = each.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "options"))), lambda x: x["options"]).alias("places"))
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit("").alias("sequence")))

    def step(state, options):
        longer = lambda s, c: F.struct((s["score"] + c["energy"]).alias("score"), F.concat(s["sequence"], c["residue"]).alias("sequence"))
        return F.slice(F.array_sort(F.flatten(F.transform(state, lambda s: F.transform(options, lambda c: longer(s, c))))), 1, beam)

    return by_place.select("query", F.inline(F.aggregate("places", start, step))).select("query", "sequence", "score")


def reciprocal_design(candidates: DataFrame, query: str, indexes: tuple[DataFrame, DataFrame, DataFrame], top_k: int | None = 25, strategy: str = P.STRATEGIES[0], rescue: str = "none", **profile) -> DataFrame:
    """(sequence, forward, reciprocal, total): for each candidate a profile of its own, against which the
    query is scored, with neighbour rescue if asked; all candidates in one plan. Ordered by total, forward,
    reciprocal, sequence. A charged donor inside the query scores as the centre of its own triplet where the
    3x3 index has that (a row for each triplet of the query is read)."""
    query = A.check_sequence(query, "query")
    if rescue not in S.RESCUE_MODES:
        raise ValueError(f"unknown rescue mode {rescue!r}")
    q = candidates.select(F.col("sequence").alias("query")).distinct()
    rows = P.build(q, *indexes, strategy=strategy, **profile)
    if rescue == "none":
        own = F.get("energies", A.index_of(F.substring(F.lit(query), F.col("position"), F.lit(1))))
        back = rows.groupBy("query").agg(F.sum(own).alias("reciprocal"))
    else:
        triplets = {query[j - 1 : j + 2]: None for j in range(1, len(query) - 1)}
        triplets |= {r.seq: list(r["mean"]) for r in indexes[1].filter(F.col("seq").isin(*triplets)).select("seq", "mean").collect()} if triplets else {}
        lists = [F.array(*map(F.lit, m)) if m else F.lit(None).cast("array<double>") for m in (triplets.get(query[j - 1 : j + 2]) if 0 < j < len(query) - 1 else None for j in range(len(query)))]
        whole = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("position", "energies"))).alias("p"))
        table = F.transform("p", lambda x: x["energies"])
        back = whole.select("query", S.rescued_by_rows(F.lit(query), F.col("query"), table, F.array(*lists))["total"].alias("reciprocal"))
    out = candidates.join(back, candidates.sequence == back["query"]).select("sequence", F.col("score").alias("forward"), "reciprocal", (F.col("score") + F.col("reciprocal")).alias("total"))
    ordered = out.orderBy("total", "forward", "reciprocal", "sequence")
    return ordered.limit(top_k) if top_k else ordered
