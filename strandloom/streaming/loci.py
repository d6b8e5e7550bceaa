"""Streaming forms: loci as session windows and coverage in tumbling bins.

Positions are event time (one base per second), so a locus is a session whose gap is
its read's length and max_gap. Spark joins sessions that touch, while a locus breaks at
equality, hence the gap is one less.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _time(c):
    return F.timestamp_seconds(c.cast("long"))


def session_loci(reads: DataFrame, max_gap: int = 50, late: int | None = None) -> DataFrame:
    """chrom, left, right, n_reads, weight per locus; works on batch and streaming
    reads. late: bases by which reads may be out of order."""
    rows = reads.withColumn("at", _time(F.col("left")))
    if rows.isStreaming:
        rows = rows.withWatermark("at", f"{late or 0} seconds")
    gap = F.concat(F.greatest(F.lit(1), F.col("right") - F.col("left") + max_gap - 1).cast("string"), F.lit(" seconds"))
    out = rows.groupBy("chrom", F.session_window("at", gap)).agg(F.min("left").alias("left"), F.max("right").alias("right"), F.count("*").alias("n_reads"), F.sum("weight").alias("weight"))
    return out.drop("session_window")


def binned_coverage(reads: DataFrame, bin_size: int = 1000, late: int | None = None) -> DataFrame:
    """chrom, bin, weight of read starts in tumbling bins."""
    rows = reads.withColumn("at", _time(F.col("left")))
    if rows.isStreaming:
        rows = rows.withWatermark("at", f"{late or 0} seconds")
    out = rows.groupBy("chrom", F.window("at", f"{bin_size} seconds").alias("w")).agg(F.sum("weight").alias("weight"))
    return out.select("chrom", F.floor(F.unix_seconds("w.start") / bin_size).alias("bin"), "weight")
