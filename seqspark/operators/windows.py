"""Records and their fixed-length windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions.scoring import let

BLOCK = 128


def records_of(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents as records: their ASCII letters in upper case; keep: columns that stay."""
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    header = F.concat_ws("|", "lang", "source", F.col("doc_id").cast("string"))
    return documents.select(F.col("doc_id").alias("record_ord"), header.alias("header"), letters.alias("sequence"), *keep)


def windows(records: DataFrame, length: int, keep: tuple[str, ...] = (), flank: int = 0) -> DataFrame:
    """(record_ord, header, *keep, start, end, window[, region, region_from]) of all windows of valid residues; start and end count from 1.

    Sequences are first cut into overlapping blocks (one pass of a pattern), then blocks into windows:
    taking each window from the whole sequence would walk it from the front each time. With a flank, the
    region is the window and so many letters either side, as far as the record goes; regions with other
    letters are null."""
    if length < 1:
        raise ValueError("windows have a positive length")
    size = max(BLOCK, length + 2 * flank)
    pieces = F.regexp_extract_all("sequence", F.lit(f".{{1,{size}}}"), F.lit(0))
    # A block is followed by the first letters of the next, and led by the last of the one before.
    more = length - 1 + flank
    def block(blocks: Column) -> Column:
        lead = lambda i: F.when(i > 0, F.right(F.get(blocks, i - 1), F.lit(flank))).otherwise("") if flank else F.lit("")
        text = lambda b, i: F.concat(b, F.substring(F.coalesce(F.get(blocks, i + 1), F.lit("")), 1, more))
        return F.transform(blocks, lambda b, i: F.struct(lead(i).alias("lead"), text(b, i).alias("text"), F.length(b).alias("own")))

    wide = let(pieces, block)  # else each block would cut the sequence anew
    cut = records.filter(F.length("sequence") >= length).select("record_ord", "header", *keep, F.posexplode(wide).alias("block", "b"))
    last = F.least(F.col("b.own"), F.length("b.text") - length + 1)
    placed = cut.filter(last >= 1).select("record_ord", "header", *keep, "block", "b", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    start = F.col("block").cast("long") * size + F.col("at")
    columns = ["record_ord", "header", *keep, start.alias("start"), (start + length - 1).alias("end"), F.substring(F.col("b.text"), F.col("at"), F.lit(length)).alias("window")]
    if flank:
        text, lead = F.concat("b.lead", "b.text"), F.length("b.lead")
        begin = F.greatest(F.col("at") + lead - flank, F.lit(1))
        region = F.substring(text, begin, F.col("at") + lead + length + flank - begin)
        columns += [F.when(A.is_valid(region), region).alias("region"), (start - (F.col("at") + lead - begin)).alias("region_from")]
    return placed.select(*columns).filter(A.is_valid(F.col("window")))


def kmers(sequence: str, size: int) -> list[tuple[int, str]]:
    """(position from 1 of the centre, k-mer) of a query's interior."""
    half = size // 2
    return [(i + 1, sequence[i - half : i + half + 1]) for i in range(half, len(sequence) - half)]


def parse_targets(specs: list[str], length: int) -> list[tuple[str, str]]:
    """(label, sequence) from ``label=SEQUENCE``."""
    out = []
    for spec in specs:
        label, eq, seq = spec.partition("=")
        seq = A.check_sequence(seq.strip(), spec) if eq else ""
        if not eq or len(seq) != length:
            raise ValueError(f"target {spec!r} must be label=SEQUENCE of {length} residues")
        out.append((label.strip(), seq))
    return out


def header_fields(header: Column) -> tuple[Column, Column]:
    """(accession, entry) of ``db|accession|entry ...``; empty without three fields."""
    f = F.split(header, r"\|")
    many = F.size(f) >= 3
    return F.when(many, F.get(f, 1)).otherwise(""), F.when(many, F.substring_index(F.ltrim(F.get(f, 2)), " ", 1)).otherwise("")
