"""Gaps and islands: loci, annotation loci, junction chunks, merged ends, sessions.

Each uses windows over the starts of a partition key. Loci, junction chunks and unions
first number islands within stripes of the axis (``STRIPE``) and then join stripes by
their running ends, so that no chrom is one task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


STRIPE = 1 << 20  # positions of a chrom that one window gathers


def island_ids(df: DataFrame, keys: list[str], left: str, right: str, max_gap: int = 0, touch: bool = False, name: str = "island", stripe: int | None = None) -> DataFrame:
    """df with the number (from 1 within keys) of each row's island. A row starts one
    where its left is >= the largest right before it plus max_gap (touch: only >)."""
    if stripe:
        return _striped(df, keys, left, right, max_gap, touch, name, stripe)
    order = Window.partitionBy(*keys).orderBy(left, right)
    before = F.max(right).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return _numbered(df.withColumn("__b", before), order, left, max_gap, touch, name)


def _opens(left: str, before: str, max_gap: int, touch: bool) -> Column:
    bound = F.col(before) + max_gap
    return F.col(before).isNull() | (F.col(left) > bound if touch else F.col(left) >= bound)


def _numbered(df: DataFrame, order, left: str, max_gap: int, touch: bool, name: str) -> DataFrame:
    # of rows that tie only one can open an island, and a range frame counts it for all of them
    number = F.sum(F.when(_opens(left, "__b", max_gap, touch), 1).otherwise(0)).over(order.rangeBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, number.cast("long")).drop("__b")


def _striped(df: DataFrame, keys: list[str], left: str, right: str, max_gap: int, touch: bool, name: str, stripe: int) -> DataFrame:
    cut, floor = F.floor(F.col(left) / stripe), (F.col("__s") * stripe).cast(df.schema[left].dataType)
    # rows that reach into later stripes leave a row ahead of these: the largest right so far
    reach = F.floor((F.col(right) + max_gap) / stripe)
    ahead = df.where(reach > cut).select(*keys, F.col(right), F.explode(F.sequence(cut + 1, reach)).alias("__s"))
    ahead = ahead.groupBy(*keys, "__s").agg(F.max(right).alias(right)).withColumn(left, (floor - 1).cast(df.schema[left].dataType))
    order = Window.partitionBy(*keys, "__s").orderBy(left, right)
    held = df.withColumn("__s", cut).unionByName(ahead, allowMissingColumns=True).withColumn("__b", F.max(right).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    own = F.col(left) >= floor
    held = held.withColumn("__o", F.when(own & _opens(left, "__b", max_gap, touch), 1).otherwise(0))
    over = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    first = held.groupBy(*keys, "__s").agg(F.sum("__o").alias("__n")).withColumn("__n0", F.coalesce(F.sum("__n").over(over), F.lit(0))).drop("__n")
    # numbered before the join, whose sides are then sorted already
    held = held.withColumn(name, F.sum("__o").over(order.rangeBetween(Window.unboundedPreceding, 0))).where(own)
    out = held.join(first, [*keys, "__s"]).withColumn(name, (F.col("__n0") + F.col(name)).cast("long"))
    return out.select(*df.columns, name)


def loci(reads: DataFrame, max_gap: int = 50, max_intron: int | None = None, stripe: int | None = STRIPE) -> DataFrame:
    """reads with locus: a new one where left >= the largest right so far + max_gap."""
    if max_intron is not None:
        from strandloom.operators.intervals import gaps, malformed

        reads = reads.where(~malformed(F.col("ranges")) & ~F.exists(gaps(F.col("ranges")), lambda g: g["r"] - g["l"] > max_intron))
    return island_ids(reads, ["chrom"], "left", "right", max_gap, name="locus", stripe=stripe)


def annotation_loci(df: DataFrame, stripe: int | None = STRIPE) -> DataFrame:
    """Touching transcripts stay together."""
    return island_ids(df, ["chrom"], "left", "right", 0, touch=True, name="locus", stripe=stripe)


def junction_chunks(sj: DataFrame, stripe: int | None = STRIPE) -> DataFrame:
    return island_ids(sj, ["chrom"], "start", "end", 0, touch=True, name="chunk", stripe=stripe)


def union_rows(df: DataFrame, keys: list[str], left: str = "left", right: str = "right") -> DataFrame:
    """The union of rows' intervals per keys; touching ones merge."""
    return island_ids(df, keys, left, right, 0, touch=True, stripe=STRIPE).groupBy(*keys, "island").agg(F.min(left).alias(left), F.max(right).alias(right)).drop("island")


def locus_summary(reads: DataFrame, max_gap: int = 50) -> DataFrame:
    return (
        loci(reads, max_gap)
        .groupBy("chrom", "locus")
        .agg(F.min("left").alias("left"), F.max("right").alias("right"), F.count("*").alias("n_reads"), F.sum("weight").alias("weight"), has_ends().alias("has_ends"))
    )


def has_ends(require_cap: bool = False) -> Column:
    """Aggregate: a start and an end label exist on one strand."""
    start = F.col("capped") if require_cap else F.col("s_tag")
    seen = lambda c, s: F.max(F.when((F.col("strand") == s) & c, 1).otherwise(0)) == 1
    return (seen(start, 1) & seen(F.col("e_tag"), 1)) | (seen(start, -1) & seen(F.col("e_tag"), -1))


def assemblable(reads: DataFrame, max_gap: int = 50, require_cap: bool = False, whole: bool = True) -> DataFrame:
    """Reads of loci with ends: filtered before any per-locus function runs. Without whole
    the reads of a strand go that lacks one of its ends."""
    kept = loci(reads, max_gap)
    over = Window.partitionBy("chrom", "locus")
    start = F.col("capped") if require_cap else F.col("s_tag")
    seen = lambda c, s: F.max(F.when((F.col("strand") == s) & c, 1).otherwise(0)).over(over)
    ends = {s: seen(start, s) + seen(F.col("e_tag"), s) for s in (1, -1)}
    both = F.greatest(ends[1], ends[-1])
    if not whole:
        both = F.when(F.col("strand") == 1, ends[1]).when(F.col("strand") == -1, ends[-1]).otherwise(both)
    return kept.withColumn("__ends", both).where("__ends = 2").drop("__ends")


def merge_ends(ends: DataFrame) -> DataFrame:
    """Windows of ends(chrom, strand, kind, left, right, peak, name) that overlap or
    touch: outer bounds, the outermost peak of their kind, names joined by _."""
    rows = island_ids(ends, ["chrom", "strand", "kind"], "left", "right", 0, touch=True)
    upstream = (F.col("kind") == "S") == (F.col("strand") != -1)
    return (
        rows.groupBy("chrom", "strand", "kind", "island")
        .agg(F.min("left").alias("left"), F.max("right").alias("right"), F.min("peak").alias("__lo"), F.max("peak").alias("__hi"), F.array_join(F.array_sort(F.collect_list("name")), "_").alias("name"))
        .withColumn("peak", F.when(upstream, F.col("__lo")).otherwise(F.col("__hi")))
        .drop("__lo", "__hi", "island")
    )


def split_loci(reads: DataFrame, max_gap: int = 50) -> DataFrame:
    """reads with part: loci cut where neither blocks nor splices cover more than
    max_gap bases."""
    from strandloom.operators.intervals import left, right

    spans = reads.select("chrom", "locus", "row", F.explode("ranges").alias("x")).select("chrom", "locus", "row", "x.*")
    spliced = reads.select("chrom", "locus", "row", left(F.col("ranges")).alias("l"), right(F.col("ranges")).alias("r"), "splice").where(F.forall("splice", lambda s: s)).select("chrom", "locus", "row", "l", "r")
    parts = island_ids(spans.unionByName(spliced), ["chrom", "locus"], "l", "r", max_gap, touch=True, name="part")
    held = parts.groupBy("chrom", "locus", "row").agg(F.min("part").alias("part"), F.max("part").alias("last"))
    return reads.join(held.where("part = last").drop("last"), ["chrom", "locus", "row"])  # reads across a cut go


def sessions(events: DataFrame, key: str, ts: str, gap: int) -> DataFrame:
    """events with session: a pause of gap seconds or more starts one."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return island_ids(events.withColumn("__t", at), [key], "__t", "__t", gap * 1_000_000, name="session").drop("__t")


def gaps_below(depth: DataFrame, threshold: float, max_gap: int) -> DataFrame:
    """Runs of more than max_gap bases of segments(chrom, start, end, value) below
    the threshold; a run at the end of a chrom is not reported."""
    low = depth.where(F.col("value") < threshold)
    runs = island_ids(low, ["chrom"], "start", "end", 0, touch=True).groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    last = depth.groupBy("chrom").agg(F.max("end").alias("__last"))
    return runs.join(last, "chrom").where((F.col("end") - F.col("start") > max_gap) & (F.col("end") < F.col("__last"))).drop("__last")


def passes_threshold(depth: DataFrame, threshold: float, max_gap: int) -> DataFrame:
    """chrom, passes: no run of more than max_gap bases is below the threshold, ends of
    segments(chrom, start, end, value) included."""
    low = depth.where(F.col("value") < threshold)
    runs = island_ids(low, ["chrom"], "start", "end", 0, touch=True, stripe=STRIPE).groupBy("chrom", "island").agg((F.max("end") - F.min("start")).alias("n"))
    worst = runs.groupBy(F.col("chrom").alias("__c")).agg(F.max("n").alias("__n"))
    all_ = depth.select("chrom").distinct()
    return all_.join(worst, F.col("chrom") == F.col("__c"), "left").select("chrom", (F.coalesce("__n", F.lit(0)) <= max_gap).alias("passes"))
