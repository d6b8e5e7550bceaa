"""Sweep-line coverage and end signals.

Depth changes only at block ends, so a chrom's coverage is the running sum of
weighted end events, pre-aggregated by position before the window's shuffle; zero
changes are dropped, which joins equal neighbours. A chrom's axis is cut into stripes
(``stripe`` positions) that are summed apart and offset by the totals before them, so a
window never holds more rows than a stripe has positions.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.islands import STRIPE

SIGNALS = {"5P": "s_tag", "S": "s_tag and not capped", "C": "capped", "E": "e_tag", "3P": "e_tag"}


def block_events(reads: DataFrame) -> DataFrame:
    """(chrom, pos, delta) at the ends of all blocks, summed by position."""
    ends = reads.select("chrom", "weight", F.explode("ranges").alias("x")).select("chrom", F.inline(F.array(F.struct(F.col("x.l").alias("pos"), F.col("weight").alias("delta")), F.struct(F.col("x.r").alias("pos"), (-F.col("weight")).alias("delta")))))
    return ends.groupBy("chrom", "pos").agg(F.sum("delta").alias("delta")).where("delta != 0")


def coverage(reads: DataFrame, strand: int | None = None, stripe: int | None = STRIPE) -> DataFrame:
    """chrom, start, end, value of all segments of nonzero coverage."""
    events = block_events(reads if strand is None else reads.where(F.col("strand") == strand))
    if stripe:
        # the filter is that of the join below, so that both its sides read one shuffle
        events = events.withColumn("__s", F.floor(F.col("pos") / stripe)).where("chrom is not null and __s is not null")
        before = Window.partitionBy("chrom").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy("chrom").orderBy("__s").rowsBetween(1, Window.unboundedFollowing)
        parts = events.groupBy("chrom", "__s").agg(F.sum("delta").alias("__d"), F.min("pos").alias("__f"))
        parts = parts.select("chrom", "__s", F.coalesce(F.sum("__d").over(before), F.lit(0.0)).alias("__d"), F.min("__f").over(after).alias("__f"))
        order = Window.partitionBy("chrom", "__s").orderBy("pos")
        out = events.join(parts, ["chrom", "__s"]).select("chrom", F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(order), F.col("__f")).alias("end"), (F.col("__d") + F.sum("delta").over(order)).alias("value"))
    else:
        order = Window.partitionBy("chrom").orderBy("pos")
        out = events.select("chrom", F.col("pos").alias("start"), F.lead("pos").over(order).alias("end"), F.sum("delta").over(order).alias("value"))
    return out.where("value != 0 and end is not null")


def end_signal(reads: DataFrame, kind: str, strand: int | None = None) -> DataFrame:
    """chrom, start, end, value at the ends with a label; without a strand plus
    counts as positive and minus as negative."""
    rows = reads.where(F.expr(SIGNALS[kind])).where(F.col("strand") != 0)
    if strand is not None:
        rows = rows.where(F.col("strand") == strand)
    first = F.col("ranges")[0]["l"]
    last = F.element_at("ranges", -1)["r"] - 1
    five = kind in ("5P", "S", "C")
    pos = F.when((F.col("strand") == 1) == F.lit(five), first).otherwise(last)
    sign = F.col("strand") if strand is None else F.lit(1)
    return rows.groupBy("chrom", pos.alias("start")).agg(F.sum(F.col("weight") * sign).alias("value")).where("value != 0").select("chrom", "start", (F.col("start") + 1).alias("end"), "value")


def bedgraph(reads: DataFrame, kind: str = "COV", strand: int | None = None, offset: int = 0) -> DataFrame:
    from strandloom.operators.intervals import shift_by

    if offset:
        reads = reads.withColumn("ranges", shift_by(F.col("ranges"), F.lit(offset), F.col("strand")))
    return coverage(reads, strand) if kind == "COV" else end_signal(reads, kind, strand)


def inferred_strand_coverage(reads: DataFrame) -> DataFrame:
    """chrom, start, end, plus, minus: unstranded coverage dealt to strands by the
    plus share of stranded coverage, interpolated between the nearest stranded
    segments; shares below 0.01 and above 0.99 are taken as 0 and 1."""
    kinds = reads.select("chrom", "weight", "strand", F.explode("ranges").alias("x"))
    part = lambda s, w: F.when(F.col("strand") == s, w).otherwise(0.0)
    end = lambda p, sign: F.struct(F.col(p).alias("pos"), *[part(s, sign * F.col("weight")).alias(n) for s, n in ((1, "p"), (-1, "m"), (0, "u"))])
    events = kinds.select("chrom", F.inline(F.array(end("x.l", 1), end("x.r", -1)))).groupBy("chrom", "pos").agg(*[F.sum(c).alias(c) for c in "pmu"])
    order = Window.partitionBy("chrom").orderBy("pos")
    segments = events.select("chrom", F.col("pos").alias("start"), F.lead("pos").over(order).alias("end"), *[F.sum(c).over(order).alias(c) for c in "pmu"]).where("end is not null and p + m + u != 0")
    share = F.when(F.col("p") + F.col("m") > 0, F.col("p") / (F.col("p") + F.col("m")))
    middle = (F.col("start") + F.col("end")) / 2
    known = F.when(share.isNotNull(), F.struct(middle.alias("x"), share.alias("y")))
    # both ways as running windows: one that looks ahead reads a chrom's rest for every row
    back, ahead = (Window.partitionBy("chrom").orderBy(c).rowsBetween(Window.unboundedPreceding, 0) for c in (F.asc("start"), F.desc("start")))
    rows = segments.withColumns({"__a": F.last(known, True).over(back), "__z": F.last(known, True).over(ahead), "__x": middle})
    mixed = F.col("__a.y") + (F.col("__z.y") - F.col("__a.y")) * (F.col("__x") - F.col("__a.x")) / (F.col("__z.x") - F.col("__a.x"))
    at = F.coalesce(F.when(F.col("__a.x") == F.col("__z.x"), F.col("__a.y")), mixed, F.col("__a.y"), F.col("__z.y"), F.lit(0.5))
    at = F.when(at < 0.01, 0.0).when(at > 0.99, 1.0).otherwise(at)
    return rows.withColumn("__r", at).select("chrom", "start", "end", (F.col("p") + F.col("u") * F.col("__r")).alias("plus"), (F.col("m") + F.col("u") * (1 - F.col("__r"))).alias("minus"))


def depth_features(reads: DataFrame) -> DataFrame:
    """Long form of the depth matrix: chrom, feature (S+, S-, E+, E-, C+, C-), pos, weight."""
    out = None
    for kind in ("S", "E", "C"):
        for s, sign in ((1, "+"), (-1, "-")):
            rows = end_signal(reads, kind, s).select("chrom", F.lit(kind + sign).alias("feature"), F.col("start").alias("pos"), F.col("value").alias("weight"))
            out = rows if out is None else out.unionByName(rows)
    return out


def sharpest_change(segments: DataFrame) -> DataFrame:
    """Per chrom the positions of the largest relative rise and fall of coverage."""
    order = Window.partitionBy("chrom").orderBy("start")
    touch = F.lag("end").over(order) == F.col("start")
    last = F.when(touch, F.lag("value").over(order)).otherwise(0.0)
    change = (F.col("value") - last) / F.greatest("value", last)
    rows = segments.withColumn("__c", F.coalesce(change, F.lit(1.0)))
    return rows.groupBy("chrom").agg(F.max_by("start", F.struct("__c", -F.col("start"))).alias("rise"), F.min_by("start", F.struct("__c", F.col("start"))).alias("fall"))
