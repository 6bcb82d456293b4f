"""Scans of FASTA files as they arrive: the batch scan per micro-batch, hits added to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scoring import Profile
from ..operators.blocks import scan_hits
from ..sources.files import fasta_chunks, fasta_records


def stream_records(spark: SparkSession, folder: str, glob: str = "*.fasta") -> DataFrame:
    """The text of the records of each new file, as a stream for ``scan_stream``."""
    return fasta_chunks(spark.readStream.schema("value string").option("pathGlobFilter", glob), folder)


def scan_stream(records: DataFrame, profile: Profile, threshold: float, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Adds hits under the threshold to a Parquet table; each file is scanned once. Stateless, so no
    watermark is needed. A micro-batch owns a folder of the table (``batch=N``) and writes it anew when it is
    tried again, so a table belongs to one checkpoint. record_ord is a hash of file and place in it."""

    def write(batch: DataFrame, number: int) -> None:
        found = fasta_records(batch).withColumn("record_ord", F.xxhash64("file", "block", "n"))
        hits = scan_hits(found.select("record_ord", "header", "sequence"), profile, None, threshold=threshold, **options)
        hits.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
