"""Readers of FASTA files, motif fragments, energy tables and 1x1 matrices, and the stored index."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alphabet as A

SIZES = {"1x1": 1, "3x3": 3, "5x5": 5}
INDEX_VERSION = 4


def fasta_chunks(reader, path: str | list[str]) -> DataFrame:
    """(file, block, value) of FASTA files: text between two headers at line starts. Files are split as any
    lines of text are, so that one large file is read by many tasks. reader: batch or stream."""
    chunks = reader.option("lineSep", "\n>").text(path)
    return chunks.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _numbered_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of a task's chunks, counted from 0 in each block: a task reads whole blocks, in order."""
    split, at, n = re.compile(r"[\n\r]+[ \t]*>").split, None, 0
    for batch in batches:
        rows = []
        for file, block, value in zip(*(c.to_pylist() for c in batch.columns)):
            first = (file, block) != at
            if first:
                at, n = (file, block), 0
            # What a file begins with may be no record; other chunks begin behind a header's sign.
            for part in split(("\n" if first and block == 0 else "\n>") + value)[1:]:
                header, *lines = re.split(r"[\r\n]+", part)
                rows.append((file, block, n, header.rstrip(" "), "".join(x.strip(" ") for x in lines).upper()))
                n += 1
        columns = zip(*rows) if rows else [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "block", "n", "header", "sequence"])


def fasta_records(chunks: DataFrame) -> DataFrame:
    """(file, block, n, header, sequence) of ``fasta_chunks`` as they are read; n counts a block's records from 0,
    inside the task that reads it. A chunk holds more than one record where blanks precede a header's sign."""
    return chunks.select("file", "block", "value").mapInArrow(_numbered_records, "file string, block bigint, n bigint, header string, sequence string")


#: Splits of files whose counts are sent to all tasks; of more, the counts are joined by shuffles.
FEW_SPLITS = 1 << 18


def read_fasta(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(record_ord, header, sequence, file) of every record, by file name and place in the file.

    Lines are stripped, blank lines skipped, sequences joined and put in upper case; text before the first
    header goes; a header without a body has an empty sequence; files without a record give no rows. Numbers
    have no gaps, so records are counted by split first (a row for each); the texts themselves aren't shuffled.
    The ``fasta`` data source reads files once, with numbers that have gaps."""
    chunks = fasta_chunks(spark.read.option("pathGlobFilter", glob) if glob else spark.read, path)
    if not (files := chunks.inputFiles()):
        raise FileNotFoundError(f"no FASTA files at {path}")
    records = fasta_records(chunks)
    counts = records.groupBy("file", "block").agg(F.count("*").alias("m"))
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("file", "block", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))
    if chunks.rdd.getNumPartitions() + len(files) <= FEW_SPLITS:
        base = F.broadcast(base)
    ranked = records.join(base, ["file", "block"])
    return ranked.select((F.col("base") + F.col("n")).alias("record_ord"), "header", "sequence", "file")


def motif_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.(?:pdb|etab)$", 1)


def motif_paths(root: str, size: str, pdb_id: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """(fragment file, energy file) of a motif."""
    if size not in SIZES:
        raise ValueError(f"unknown motif size {size!r}")
    pdb = F.upper(pdb_id)
    stem = F.concat_ws("_", pdb, left, right)
    place = lambda kind, end: F.concat(F.lit(f"{root}/{kind}-{size}/"), F.substring(pdb, 1, 2), F.lit("/"), pdb, F.lit("/"), stem, F.lit(end))
    return place("frags", ".pdb"), place("en", ".etab")


def _lines(spark: SparkSession, root: str, glob: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    return text.select(motif_stem(F.col("_metadata.file_path")).alias("stem"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def one_letter(three: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for a, t in A.THREE.items() for x in (t.upper(), a)])
    return F.try_element_at(codes, F.upper(three))


MODES = ("FAILFAST", "DROPMALFORMED")


def _checked(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return mode


def _cells(spark: SparkSession, root: str) -> DataFrame:
    """(stem, line_no, i, j, e, reason) of the lines of energy tables; reason: what is wrong with a line."""
    f = F.split(F.trim("line"), r"\s+")
    cells = _lines(spark, root, "*.etab").filter(F.trim("line") != "").select(
        "stem", "line_no", F.size(f).alias("fields"), A.index_of(one_letter(F.get(f, 2))).alias("i"), A.index_of(one_letter(F.get(f, 3))).alias("j"), F.get(f, 4).try_cast("double").alias("e")
    )
    reason = F.when(F.col("fields") != 5, "an energy line needs 5 fields").when(F.col("i").isNull() | F.col("j").isNull(), "an unknown residue").when(F.col("e").isNull(), "an energy that is no number")
    return cells.withColumn("reason", reason).drop("fields")


def _table_problems(cells: DataFrame) -> DataFrame:
    """(stem, reason) of the energy tables that can't be read."""
    each = cells.groupBy("stem", "i", "j").agg(F.min("reason").alias("reason"))
    whole = each.groupBy("stem").agg(F.min("reason").alias("reason"), F.count_if(F.col("reason").isNull()).alias("n"))
    return whole.select("stem", F.coalesce("reason", F.when(F.col("n") < 400, "an energy table needs 400 cells")).alias("reason")).filter("reason is not null")


def read_energy_tables(spark: SparkSession, root: str, mode: str = "FAILFAST") -> DataFrame:
    """(stem, matrix array<array<double>>): rows and columns in the alphabet's order; of repeated cells the
    last holds. A line without five fields, an unknown residue, an energy that is no number or a missing cell
    is an error; with DROPMALFORMED such tables are left out (see ``rejected_motifs``)."""
    cells = _cells(spark, root)
    if _checked(mode) == "DROPMALFORMED":
        cells = cells.join(_table_problems(cells), "stem", "left_anti")
    else:
        cells = cells.withColumn("ok", F.when(F.col("reason").isNotNull(), F.raise_error(F.col("reason")))).filter("ok is null").drop("ok")
    last = cells.groupBy("stem", "i", "j").agg(F.max_by("e", "line_no").alias("e"))
    rows = last.groupBy("stem", "i").agg(F.array_sort(F.collect_list(F.struct("j", "e"))).alias("row"), F.count("*").alias("n"))
    whole = rows.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("i", F.transform("row", lambda x: x["e"]).alias("row")))).alias("rows"), F.sum("n").alias("n"))
    return whole.select("stem", F.transform("rows", lambda x: x["row"]).alias("matrix"), F.assert_true(F.col("n") == 400, F.lit("an energy table needs 400 cells")).alias("ok")).filter("ok is null").drop("ok")


def _chains(spark: SparkSession, root: str) -> DataFrame:
    """(stem, chain, r, reason) of the chains of fragments: r has their residues in order."""
    line = F.col("line")
    atoms = _lines(spark, root, "*.pdb").filter(line.startswith("ATOM") & (F.trim(F.substring(line, 13, 4)) == "CA"))
    cut = atoms.select(
        "stem", "line_no", F.substring(line, 22, 1).alias("chain"), F.substring(line, 23, 5).alias("place"), one_letter(F.trim(F.substring(line, 18, 3))).alias("aa"),
        F.array(*[F.trim(F.substring(line, s, 8)).try_cast("double") for s in (31, 39, 47)]).alias("xyz"),
    )
    first = cut.groupBy("stem", "chain", "place").agg(F.min(F.struct("line_no", "aa", "xyz")).alias("r"))
    reason = F.when(F.col("r.aa").isNull(), "an unknown residue").when(F.exists("r.xyz", lambda x: x.isNull()), "a coordinate that is no number")
    return first.groupBy("stem", "chain").agg(F.array_sort(F.collect_list("r")).alias("r"), F.min(reason).alias("reason"))


def read_fragments(spark: SparkSession, root: str, size: str) -> DataFrame:
    """(stem, chain, seq, ca array<array<double>>) of chains with the right length: one row per chain. Of
    repeated residue numbers the first holds. A file with an unknown residue is left out, in every mode."""
    good = _chains(spark, root).withColumn("bad", F.max("reason").over(Window.partitionBy("stem"))).filter("bad is null")
    out = good.select("stem", "chain", F.array_join(F.transform("r", lambda x: x["aa"]), "").alias("seq"), F.transform("r", lambda x: x["xyz"]).alias("ca"))
    return out.filter((F.length("seq") == SIZES[size]) & (F.size("ca") == SIZES[size]))


def geometry_signature(ca: Column) -> Column:
    """Distances of all pairs of points, to one decimal (halves to even), as text; empty for one point."""
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    places = F.sequence(F.lit(0), F.size(ca) - 1)
    pairs = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: F.bround(far(F.get(ca, i), F.get(ca, j)), 1).cast("string"))))
    return F.array_join(pairs, " ")


#: The residue (from 1) whose energies stand for a chain: the second for longer motifs, or with true_center the middle one.
CENTRES = {"compat": {"1x1": 1, "3x3": 2, "5x5": 2}, "true_center": {"1x1": 1, "3x3": 2, "5x5": 3}}


def read_motif_rows(spark: SparkSession, fragments: str, energies: str, size: str, mode: str = "FAILFAST", center_5x5: str = "compat") -> DataFrame:
    """(seq, geom, row): for each chain of a motif the energies of its centre (see CENTRES). A name that isn't
    of three parts, or a fragment without (sound) energies, is an error; with DROPMALFORMED it is left out."""
    if center_5x5 not in CENTRES:
        raise ValueError(f"unknown centre {center_5x5!r}")
    frags, tables = read_fragments(spark, fragments, size), read_energy_tables(spark, energies, mode)
    named = F.size(F.split("stem", "_")) == 3
    if mode == "DROPMALFORMED":
        frags = frags.filter(named)
    else:
        odd = frags.filter(~named).first()
        if odd is not None:
            raise ValueError(f"motif {odd.stem} isn't named of three parts")
        alone = frags.join(tables, "stem", "left_anti").first()
        if alone is not None:
            raise FileNotFoundError(f"no energy table for motif {alone.stem}")
    centre = A.index_of(F.substring("seq", CENTRES[center_5x5][size], 1))
    return frags.join(tables, "stem").select("seq", geometry_signature(F.col("ca")).alias("geom"), F.get("matrix", centre).alias("row"))


def rejected_motifs(spark: SparkSession, fragments: str, energies: str) -> DataFrame:
    """(stem, kind, reason) of the motif files that reading leaves out: fragments with an unknown residue, and
    what DROPMALFORMED drops besides; one row for each file, with one of its reasons."""
    chains, cells = _chains(spark, fragments), _cells(spark, energies)
    unread = chains.groupBy("stem").agg(F.min("reason").alias("reason")).filter("reason is not null").select("stem", F.lit("fragment").alias("kind"), "reason")
    tables = _table_problems(cells)
    bad = tables.select("stem", F.lit("table").alias("kind"), "reason")
    sound = chains.select("stem").distinct().join(unread, "stem", "left_anti")
    odd = sound.filter(F.size(F.split("stem", "_")) != 3).select("stem", F.lit("fragment").alias("kind"), F.lit("a name that isn't of three parts").alias("reason"))
    alone = sound.filter(F.size(F.split("stem", "_")) == 3).join(cells.select("stem").distinct(), "stem", "left_anti").select("stem", F.lit("fragment").alias("kind"), F.lit("no energy table").alias("reason"))
    return unread.unionByName(bad).unionByName(odd).unionByName(alone)


def read_matrix_tsv(spark: SparkSession, path: str, directed: DataFrame) -> DataFrame:
    """An index of one-letter k-mers with the means of a matrix file (a blank first header cell, the 20
    residues in any order, 20 rows); deviations are 0, counts those of the directed index."""
    table = spark.read.csv(path, sep="\t", header=True)
    first, *names = table.columns
    if sorted(names) != sorted(A.ALPHABET) or (first or "").strip(" _c0"):
        raise ValueError("the matrix needs a blank header cell and the 20 residues")
    rows = table.select(F.col(first).alias("seq"), F.array(*[F.col(a).cast("double") for a in A.ALPHABET]).alias("mean"))
    if {r.seq for r in rows.select("seq").collect()} != set(A.ALPHABET):  # 20 rows
        raise ValueError("the matrix needs a row for each residue")
    return rows.join(directed.select("seq", "count", "buckets"), "seq").withColumn("std", F.array_repeat(F.lit(0.0), 20))


_COMMITS = "number long, folder string, version int, root string, rows long"


def store_index(index: DataFrame, path: str, root: str) -> None:
    """Publishes an index (with a motif_size column): its rows go to a folder of their own, and once all are
    there a commit names it, with its version and the root of its motifs. Readers take the last commit, so a
    write that breaks off leaves the index before it as it was."""
    spark, folder = index.sparkSession, f"rows-{uuid.uuid4().hex}"
    index.write.partitionBy("motif_size").parquet(f"{path}/{folder}")
    rows = spark.read.parquet(f"{path}/{folder}").count()
    last = _commit(spark, path)
    entry = [((last.number if last else 0) + 1, folder, INDEX_VERSION, root, rows)]
    spark.createDataFrame(entry, _COMMITS).coalesce(1).write.mode("append").json(f"{path}/commits")


def _commit(spark: SparkSession, path: str) -> Row | None:
    """The last commit; writers at the same time may give the same number, then the greater folder counts."""
    try:
        return spark.read.schema(_COMMITS).json(f"{path}/commits").orderBy(F.desc("number"), F.desc("folder")).first()
    except AnalysisException:
        return None


def expire_index(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Deletes the rows of all but the last ``keep`` commits, and rows that no commit names: not while an index is written."""
    kept = {r.folder for r in spark.read.schema(_COMMITS).json(f"{path}/commits").orderBy(F.desc("number"), F.desc("folder")).limit(max(1, keep)).collect()}
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(at):
        if status.getPath().getName().startswith("rows-") and status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)


def index_path(folder: str, root: str) -> str:
    return f"{folder}/sequence_index_v{INDEX_VERSION}_{hashlib.sha256(root.encode()).hexdigest()[:12]}"


def load_index(spark: SparkSession, path: str, root: str, size: str | None = None) -> DataFrame:
    """The last index that was published at a path; another version or root is an error."""
    head = _commit(spark, path)
    if head is None:
        raise FileNotFoundError(f"no index at {path}")
    if head.version != INDEX_VERSION:
        raise ValueError(f"the stored index has another version than {INDEX_VERSION}")
    if head.root != root:
        raise ValueError(f"the stored index is of {head.root}")
    stored = spark.read.parquet(f"{path}/{head.folder}")
    out = stored.withColumns({"std": F.coalesce("std", F.array_repeat(F.lit(0.0), 20)), "buckets": F.coalesce("buckets", F.lit(1))})
    return out.filter(F.col("motif_size") == size) if size else out


def load_or_build_index(spark: SparkSession, path: str, root: str, build, rebuild: bool = False) -> DataFrame:
    """The stored index; build() makes it where there is none, or anew."""
    if not rebuild:
        try:
            return load_index(spark, path, root)
        except FileNotFoundError:
            pass
    store_index(build(), path, root)
    return load_index(spark, path, root)
