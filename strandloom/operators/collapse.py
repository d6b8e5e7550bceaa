"""Weighted duplicates, sorting, merging, normalising; splice-junction tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READ_KEYS = ["chrom", "left", "right", "strand", "elcigar", "source"]


def collapse_duplicates(reads: DataFrame, keys: list[str] | None = None, weights: tuple[str, ...] = ("weight", "s_weight", "e_weight")) -> DataFrame:
    """Identical reads become one with their weights summed."""
    return reads.groupBy(*(keys or READ_KEYS)).agg(*[F.sum(w).alias(w) for w in weights])


def strand_order(strand: Column) -> Column:
    return F.when(strand == 1, -1).when(strand == -1, 1).otherwise(0)


def sort_reads(reads: DataFrame) -> DataFrame:
    """Chrom, left, length, strand (+ . -), label string, source, weight."""
    return reads.orderBy("chrom", "left", F.col("right") - F.col("left"), strand_order(F.col("strand")), "elcigar", "source", "weight")


def combine(files: list[DataFrame], scale: list[float] | None = None, source: list[str] | None = None) -> DataFrame:
    """The union of read sets, scaled and renamed, with duplicates collapsed and sorted."""
    out = []
    for i, df in enumerate(files):
        if scale:
            df = df.withColumns({w: F.col(w) * scale[i] for w in ("weight", "s_weight", "e_weight")})
        out.append(df.withColumn("source", F.lit(source[i])) if source else df)
    return sort_reads(collapse_duplicates(reduce(DataFrame.unionByName, out)))


def tpm(df: DataFrame, weight: str = "weight", by: tuple[str, ...] = ("source",)) -> DataFrame:
    """df with TPM: a million times the share of its source's weight (0 of nothing)."""
    totals = df.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.sum(weight).alias("__total"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    share = F.when(F.col("__total") != 0, F.col(weight) / F.col("__total") * 1e6).otherwise(0.0)
    return df.join(totals, same).withColumn("TPM", share).drop("__total", *[f"__{c}" for c in by])


def multimap_weight(df: DataFrame, name: str = "qname") -> DataFrame:
    return df.withColumn("weight", 1 / F.count("*").over(Window.partitionBy(name)))


def label_histogram(df: DataFrame, label: str = "label") -> DataFrame:
    """label, n and percent of all, floored to 0.1. The total is a join with one row,
    so no window gathers the table."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).withColumn("percent", F.floor(F.col("n") / F.col("total") * 1000) / 10).drop("total")


def source_pivot(df: DataFrame, row: str, sources: list[str], value: str = "weight") -> DataFrame:
    return df.groupBy(row).pivot("source", sources).agg(F.sum(value)).na.fill(0.0, sources)


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """id, name of a column's values, numbered in their order."""
    return df.select(F.col(column).alias("name")).distinct().select((F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("id"), "name")


def merge_junctions(sj: DataFrame) -> DataFrame:
    """One row per (chrom, start, end, strand): lines merged, summed counts, widest
    overhang, smallest name."""
    return sj.groupBy("chrom", "start", "end", "strand").agg(F.count("*").alias("reps"), F.sum("uniq").alias("uniq"), F.sum("multi").alias("multi"), F.max("overhang").alias("overhang"))


def filter_junctions(merged: DataFrame, min_unique: int = 0, min_reps: int = 1, min_proportion: float = 0.0, min_overhang: int = 0) -> DataFrame:
    """Junctions with enough reads, files and overhang, and at least min_proportion of
    the unique reads of all junctions that overlap them on their strand."""
    from strandloom.operators.joins import range_join

    kept = merged.where((F.col("uniq") >= min_unique) & (F.col("reps") >= min_reps) & (F.col("overhang") >= min_overhang))
    if not min_proportion:
        return kept
    a = kept.select("chrom", F.col("start").alias("left"), F.col("end").alias("right"), "strand")
    b = merged.select("chrom", F.col("start").alias("left"), F.col("end").alias("right"), F.col("strand").alias("b_strand"), F.col("uniq").alias("b_uniq"))
    total = range_join(a, b, ["chrom"]).where("strand = b_strand").groupBy("chrom", F.col("left").alias("start"), F.col("right").alias("end"), "strand").agg(F.sum("b_uniq").alias("around"))
    return kept.join(total, ["chrom", "start", "end", "strand"]).where(F.col("uniq") >= min_proportion * F.col("around")).drop("around")


def new_junctions(merged: DataFrame, known: DataFrame) -> DataFrame:
    return merged.join(known.select("chrom", "start", "end", "strand").distinct(), ["chrom", "start", "end", "strand"], "left_anti")


def extract_junctions(reads: DataFrame) -> DataFrame:
    """Junction rows of reads' splices; overhang is the shorter flank."""
    n = F.size("ranges")
    each = reads.where(n > 1).select("chrom", "strand", "weight", F.explode(F.sequence(F.lit(1), n - 1)).alias("i"), "ranges", "splice").where(F.element_at("splice", F.col("i")))
    a, b = F.element_at("ranges", F.col("i")), F.element_at("ranges", F.col("i") + 1)
    return each.select("chrom", a["r"].alias("start"), b["l"].alias("end"), "strand", F.col("weight").cast("long").alias("uniq"), F.lit(0).cast("long").alias("multi"), F.least(a["r"] - a["l"], b["r"] - b["l"]).alias("overhang"))
