"""Reports of scans as files: tab-separated tables, preambles with run statistics, and matrices.

Numbers are formatted in Spark and files written by its CSV writer; ordered reports are part files of ranges
in order, since hits that passed a threshold grow with the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import heuristics as H
from ..operators.windows import header_fields


def fixed(column: str | Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", column)


def write_tsv(df: DataFrame, path: str, digits: int = 6, order: tuple[str, ...] = ()) -> None:
    """All columns, doubles with so many digits; arrays are joined by commas. Each part file has the header."""
    shown = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        shown.append((fixed(c, digits) if kind == "double" else F.array_join(c.cast("array<string>"), ",") if kind == "array" else c.cast("string")).alias(f.name))
    rows = df.orderBy(*order) if order else df
    rows.select(*shown).write.mode("overwrite").csv(path, sep="\t", header=True)


def profile_report(rows: DataFrame) -> DataFrame:
    """A row per position of profiles (see profiles.build): weights and support, and the six residues of least
    energy as ``residue:energy``, ties in the alphabet's order. Positions without energies have no residues."""
    ranked = F.slice(F.array_sort(F.transform("energies", lambda e, i: F.struct(e.alias("e"), i.alias("i")))), 1, 6)
    shown = F.transform(ranked, lambda x: F.concat(F.substring(F.lit(A.ALPHABET), x["i"] + 1, F.lit(1)), F.lit(":"), fixed(x["e"], 4)))
    weights = [fixed(w, 2).alias(w) for w in ("w5", "w3", "w1")]
    return rows.select("query", "position", "residue", "mode", *weights, fixed("support", 1).alias("support"), F.coalesce(F.array_join(shown, ", "), F.lit("")).alias("best")).orderBy("query", "position")


def scan_report(hits: DataFrame) -> DataFrame:
    """score (4 digits), header, start-end, window; of an alignment also its places in query and target, the
    place it skips and its letters; of a breakdown also ``q<place>:<label>:<energy>`` for each position, and of
    an aligned hit's ``q<place>@<place in the record>:<residue>:<energy>`` for letters beside it that ease its ends."""
    columns = [fixed("score", 4).alias("score"), "header", F.concat_ws("-", "start", "end").alias("span"), "window"]
    if "aligned_window" in hits.columns:
        columns += [F.concat_ws("-", "query_start", "query_end").alias("q"), F.concat_ws("-", "target_start", "target_end").alias("t"), F.coalesce(F.col("skipped").cast("string"), F.lit("None")).alias("skip"), F.col("aligned_window").alias("aligned")]
    if "labels" in hits.columns:
        lines = F.transform(F.arrays_zip("labels", "energies"), lambda x, i: F.concat(F.lit("q"), (i + 1).cast("string"), F.lit(":"), x["labels"], F.lit(":"), fixed(x["energies"], 4)))
        columns.append(F.array_join(lines, " ").alias("breakdown"))
    if "peripheral" in hits.columns:
        of = lambda x: F.concat(F.lit("q"), x["position"].cast("string"), F.lit("@"), x["target"].cast("string"), F.lit(":"), x["residue"], F.lit(":"), fixed(x["energy"], 4))
        columns.append(F.array_join(F.transform("peripheral", of), ",").alias("periph"))
        line = lambda x: F.concat(F.lit("q"), x["position"].cast("string"), F.lit(":"), x["label"], F.lit(":"), fixed(x["energy"], 4))
        columns.append(F.array_join(F.transform("breakdown", line), " ").alias("breakdown"))
    return hits.select(*columns)


#: Metrics in the order of a rerank report (fixed).
_RERANKED = ("surface", "flex", "polar", "acidic", "basic", "gp", "hydrophobe", "entropy", "transition", "repeat", "acidic_run", "basic_run", "charged_run")


def rerank_report(hits: DataFrame) -> DataFrame:
    """20 columns of ``scan.rerank(metrics=True)``: scores, bonus and metrics with 6 digits, then the window."""
    assert set(_RERANKED) == set(H.METRICS)
    return hits.select(*[fixed(c, 6).alias(c) for c in ("rank_score", "score", "bonus", *_RERANKED)], "header", "start", "end", "window")


def rank_report(ranks: DataFrame) -> DataFrame:
    """14 columns of ``scan.window_ranks``; percentiles of no windows or entries are null."""
    six = lambda c: F.when(F.col(c).isNotNull(), fixed(c, 6)).alias(c)
    return ranks.select("label", "sequence", six("score"), six("bonus"), six("final"), "rank", six("percent"), "equal_score", "same_sequence", "entry_rank", six("entry_percent"), "entry_equal", "total", "entries")


def rescore_report(rescored: DataFrame) -> DataFrame:
    """13 columns of ``scan.rescore``: ranks, scores as they are, the header's fields, the window and up to six
    terms of least value as ``place:query triplet>target triplet:value``."""
    accession, entry = header_fields(F.col("header"))
    shown = F.transform("terms", lambda t: F.concat(t["place"].cast("string"), F.lit(":"), t["q3"], F.lit(">"), t["t3"], F.lit(":"), fixed(t["combined"], 4)))
    return rescored.select("reciprocal_rank", "first_rank", "score", "reciprocal_total", "reciprocal_mean", "used", accession.alias("accession"), entry.alias("entry"), "start", "end", "window", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("top_terms"), "header")


def pair_report(pairs: DataFrame, order: str = A.STANDARD, digits: int = 4) -> DataFrame:
    """Residue pairs in an alphabet's order, with so many digits."""
    place = [F.instr(F.lit(order), F.col(c)) for c in ("source", "target")]
    return pairs.orderBy(*place).select("source", "target", *[fixed(c, digits).alias(c) for c in ("forward", "reverse", "value", "std")])


def design_report(designs: DataFrame) -> DataFrame:
    """total, forward and reciprocal with 4 digits, and the sequence, best first."""
    return designs.orderBy("total", "forward", "reciprocal", "sequence").select(*[fixed(c, 4).alias(c) for c in ("total", "forward", "reciprocal")], "sequence")


def write_chunk_hits(hits: DataFrame, stats: DataFrame | Observation, settings: dict[str, object], path: str) -> None:
    """Hits of all chunks in one order (printed score, record, start), behind lines ``# key<tab>value``: five
    columns, or eleven where hits have alignments (a skipped place that isn't there is empty).

    With the observation that the hits were made with, the run's statistics come from the pass that finds the
    hits: these are kept as Parquet beside the report (``<path>.hits``), from which the ordered report is made."""
    spark = hits.sparkSession
    if isinstance(stats, Observation):
        hits.write.mode("overwrite").parquet(f"{path}.hits")
        hits, counts = spark.read.schema(hits.schema).parquet(f"{path}.hits"), stats.get
    else:
        counts = stats.first().asDict()
    more = [c for c in ("query_start", "query_end", "target_start", "target_end", "skipped", "aligned_window") if c in hits.columns]
    lines = [f"# {k}\t{v}" for k, v in {**settings, **counts}.items()] + ["# " + "\t".join(["header", "start", "end", "window", "score", *more])]
    head = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n long, value string").select(F.lit(0).alias("part"), F.lit(0.0).alias("s"), F.col("n").alias("r"), F.lit(0).cast("long").alias("t"), "value")
    body = hits.select(F.lit(1).alias("part"), F.round("score", 4).alias("s"), F.col("record_ord").cast("long").alias("r"), F.col("start").cast("long").alias("t"), F.concat_ws("\t", "header", F.col("start").cast("string"), F.col("end").cast("string"), "window", fixed("score", 4), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in more]).alias("value"))
    head.unionByName(body).orderBy("part", "s", "r", "t").select("value").write.mode("overwrite").text(path)


def show_matrix(matrix: DataFrame, digits: int = 4) -> None:
    matrix.select("source", *[fixed(c, digits).alias(c) for c in matrix.columns[1:]]).show(20, truncate=False)
