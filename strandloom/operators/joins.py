"""Interval joins. Spark has no range join, so the axis is cut into bins: rows are
repeated for the bins they reach, meet by equality on key and bin, and a pair is kept
only in the first bin both reach, which needs no distinct."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(a: DataFrame, b: DataFrame, keys: list[str], bin_size: int = 1000, left: str = "left", right: str = "right", closed: bool = True, prefix: str = "b_") -> DataFrame:
    """All pairs of rows with equal keys whose spans overlap (closed: or touch); b's
    left and right get the prefix."""
    cut = lambda c: F.floor(c / bin_size)
    reach = lambda df: df.withColumn("__bin", F.explode(F.sequence(cut(F.col(left)), cut(F.col(right)))))
    bb = reach(b).withColumnsRenamed({left: prefix + left, right: prefix + right})
    l2, r2 = F.col(prefix + left), F.col(prefix + right)
    pairs = reach(a).join(bb, [*keys, "__bin"])
    meets = (F.col(right) >= l2) & (F.col(left) <= r2) if closed else (F.col(right) > l2) & (F.col(left) < r2)
    return pairs.where(meets & (F.col("__bin") == cut(F.greatest(F.col(left), l2)))).drop("__bin")


def nearest(points: DataFrame, targets: DataFrame, keys: list[str], window: int, pos: str = "pos", target: str = "peak", row: str = "row") -> DataFrame:
    """Each point's nearest target within window, ties to the smaller; points without
    one are dropped."""
    size = max(1, window)
    near = F.explode(F.sequence(F.floor((F.col(pos) - window) / size), F.floor((F.col(pos) + window) / size)))
    pairs = points.withColumn("__bin", near).join(targets.withColumn("__bin", F.floor(F.col(target) / size)), [*keys, "__bin"])
    pairs = pairs.withColumn("distance", F.abs(F.col(pos) - F.col(target))).where(F.col("distance") <= window)
    return pairs.groupBy(*keys, row, pos).agg(F.min(F.struct("distance", target)).alias("x")).select(*keys, row, pos, "x.*")


def shifted_junctions(reads: DataFrame, known: DataFrame, shift: int) -> DataFrame:
    """junctions(chrom, start, end, row) moved by the least shift (up to +-shift, + before -)
    that makes them known; those without one stay."""
    steps = F.array(*[F.lit(s) for d in range(shift + 1) for s in ((d, -d) if d else (0,))])
    tries = reads.select("*", F.posexplode(steps).alias("rank", "by"))
    k = known.select("chrom", F.col("start").alias("k_start"), F.col("end").alias("k_end")).distinct()
    hit = tries.join(k, (tries.chrom == k.chrom) & (F.col("start") + F.col("by") == F.col("k_start")) & (F.col("end") + F.col("by") == F.col("k_end"))).groupBy("row").agg(F.min(F.struct("rank", "by")).alias("x"))
    return reads.join(hit, "row", "left").withColumn("by", F.coalesce("x.by", F.lit(0))).withColumns({"start": F.col("start") + F.col("by"), "end": F.col("end") + F.col("by")}).drop("x", "by")


def known_junctions(sj: DataFrame, known: DataFrame) -> DataFrame:
    """sj with annotated: whether (chrom, start, end, strand) is known."""
    k = known.select("chrom", "start", "end", "strand").distinct().withColumn("__k", F.lit(True))
    return sj.join(k, ["chrom", "start", "end", "strand"], "left").withColumn("annotated", F.coalesce("__k", F.lit(False))).drop("__k")


def junctions_between(spans: DataFrame, sj: DataFrame, bin_size: int = 1000) -> DataFrame:
    """Pairs of spans(chrom, left, right, row) and the junctions inside them."""
    j = sj.select("chrom", F.col("start").alias("left"), F.col("end").alias("right"), "strand")
    return range_join(spans, j, ["chrom"], bin_size).where("b_left >= left and b_right <= right").withColumnsRenamed({"b_left": "start", "b_right": "end"})


TILE = 1 << 16  # bases


def tiles(genome: DataFrame, size: int = TILE) -> DataFrame:
    """tile_chrom, tile, bases: genome(chrom, seq) cut into pieces, so that no join repeats
    a whole chromosome."""
    last = F.floor((F.length("seq") - 1) / size)
    cut = genome.where("length(seq) > 0").select(F.col("chrom").alias("tile_chrom"), "seq", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("tile"))
    return cut.select("tile_chrom", "tile", F.expr(f"substring(seq, cast(tile * {size} + 1 as int), {size})").alias("bases"))


def with_pieces(df: DataFrame, genome: DataFrame, pieces, name: str = "pieces", chrom: str = "chrom", size: int = TILE) -> DataFrame:
    """df with an array of the genome's text in each of pieces (an array of l, r, 0-based),
    shorter where a piece leaves the chrom. Rows meet the tiles that their pieces touch;
    a row's own columns travel once."""
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(chrom).alias("at"), F.transform(pieces, lambda x: F.struct(F.greatest(x["l"].cast("bigint"), F.lit(0)).alias("l"), x["r"].cast("bigint").alias("r"))).alias("all"))
    row = row.withColumn("id", F.monotonically_increasing_id())
    each = row.select("id", "row", "at", F.size("all").alias("n"), F.posexplode_outer("all").alias("i", "x"))
    touched = F.when(F.col("x.r") > F.col("x.l"), F.sequence(F.floor(F.col("x.l") / size), F.floor((F.col("x.r") - 1) / size)))
    each = each.select("id", F.when(F.coalesce("i", F.lit(0)) == 0, F.col("row")).alias("row"), "at", "n", "i", "x", F.posexplode_outer(touched).alias("k", "tile"))
    each = each.withColumn("row", F.when(F.coalesce("k", F.lit(0)) == 0, F.col("row")))
    t = tiles(genome, size).withColumnRenamed("tile", "number")
    met = each.join(t, (F.col("at") == F.col("tile_chrom")) & (F.col("tile") == F.col("number")), "left")
    low = F.greatest(F.col("x.l") - F.col("tile") * size, F.lit(0))
    high = F.least(F.col("x.r") - F.col("tile") * size, F.lit(size))
    part = F.coalesce(F.substring(F.col("bases"), (low + 1).cast("int"), (high - low).cast("int")), F.lit(""))
    whole = met.groupBy("id").agg(F.first("row", True).alias("row"), F.max("n").alias("n"), F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "tile", part.alias("part")))).alias("parts"))
    text = lambda i: F.array_join(F.transform(F.filter(F.array_sort("parts"), lambda y: y["i"] == i), lambda y: y["part"]), "")
    found = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), text)).otherwise(F.expr("cast(array() as array<string>)"))
    return whole.select("row.*", found.alias(name))


def span(l, r):
    return F.struct(l.alias("l"), r.alias("r"))


def flanks(positions: DataFrame, genome: DataFrame, before: int, after: int) -> DataFrame:
    """positions with flank: the genome around pos (0-based), shorter at the ends."""
    out = with_pieces(positions, genome, F.array(span(F.col("pos") - before, F.col("pos") + after)), "flank")
    return out.withColumn("flank", F.col("flank")[0])


def in_loci_of(df: DataFrame, loci: DataFrame) -> DataFrame:
    return df.join(loci.select("chrom", "locus").distinct(), ["chrom", "locus"], "left_semi")


def mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates by name."""
    return first.join(second.select("name", F.col("seq1").alias("seq2"), F.col("plus1").alias("plus2"), F.col("qual1").alias("qual2")), "name")


def first_in_order(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
