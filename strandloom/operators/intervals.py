"""Projections, predicates and unions over rows that hold sorted blocks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- one row -----------------------------------------------------------------


def left(ranges: Column) -> Column:
    return ranges[0]["l"]


def right(ranges: Column) -> Column:
    return F.element_at(ranges, -1)["r"]


def span(ranges: Column) -> Column:
    return F.struct(left(ranges).alias("l"), right(ranges).alias("r"))


def covered_length(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0), lambda a, x: a + x["r"] - x["l"])


def gaps(ranges: Column) -> Column:
    """The gaps between neighbouring blocks; none for one block."""
    n = F.size(ranges)
    return F.when(n > 1, F.zip_with(F.slice(ranges, 1, F.greatest(n - 1, F.lit(0))), F.slice(ranges, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a["r"].alias("l"), b["l"].alias("r")))).otherwise(F.expr("cast(array() as array<struct<l:int,r:int>>)"))


def junctions(ranges: Column, splice: Column) -> Column:
    """The gaps that are splices."""
    marked = F.filter(F.zip_with(gaps(ranges), splice, lambda g, s: F.struct(g.alias("g"), s.alias("s"))), lambda x: x["s"])
    return F.transform(marked, lambda x: x["g"])


def exon_count(ranges: Column, least: int = 0) -> Column:
    return F.size(F.filter(ranges, lambda x: x["r"] - x["l"] >= least))


def malformed(ranges: Column) -> Column:
    return F.exists(ranges, lambda x: x["r"] <= x["l"])


def complete(s_tag: Column, e_tag: Column, splice: Column) -> Column:
    return s_tag & e_tag & F.forall(splice, lambda x: x)


def normal_flags(df: DataFrame) -> DataFrame:
    """Rows without a strand carry no end labels."""
    has = F.col("strand") != 0
    return df.withColumns({c: F.coalesce(has & F.col(c), F.lit(False)) for c in ("s_tag", "e_tag", "capped")})


def collapse_blocks(ranges: Column, touch: bool = True) -> Column:
    """The union of blocks; overlapping ones merge, and touching ones if touch."""
    empty = F.expr("cast(array() as array<struct<l:int,r:int>>)")

    def add(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        meets = (x["l"] <= last["r"]) if touch else (x["l"] < last["r"])
        grown = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["l"].alias("l"), F.greatest(last["r"], x["r"]).alias("r"))))
        return F.when(F.size(a) == 0, F.array(x)).when(meets, grown).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(F.array_sort(ranges), empty, add)


def shorten_to(ranges: Column, length: Column, strand: Column) -> Column:
    """The first ``length`` covered bases, from the 5' end by strand."""
    forward = F.when(strand == -1, F.reverse(ranges)).otherwise(ranges)
    start = F.struct(F.expr("cast(array() as array<struct<l:int,r:int>>)").alias("kept"), length.cast("int").alias("rest"))

    def add(a: Column, x: Column) -> Column:
        n = F.least(x["r"] - x["l"], a["rest"])
        part = F.when(strand == -1, F.struct((x["r"] - n).alias("l"), x["r"].alias("r"))).otherwise(F.struct(x["l"].alias("l"), (x["l"] + n).alias("r")))
        return F.when(n > 0, F.struct(F.concat(a["kept"], F.array(part)).alias("kept"), (a["rest"] - n).alias("rest"))).otherwise(a)

    kept = F.aggregate(forward, start, add)["kept"]
    return F.when(strand == -1, F.reverse(kept)).otherwise(kept)


def shift_by(ranges: Column, offset: Column, strand: Column) -> Column:
    """The two ends moved downstream by offset (upstream if negative) along the blocks:
    inner junctions stay, the end that moves inwards skips gaps and drops the blocks it
    passes, and the other grows. Unstranded rows stay."""
    d = (offset * strand).cast("int")
    n = F.size(ranges)
    grown = F.transform(ranges, lambda x, i: F.struct((x["l"] + F.when(i == 0, F.least(d, F.lit(0))).otherwise(0)).cast("int").alias("l"), (x["r"] + F.when(i == n - 1, F.greatest(d, F.lit(0))).otherwise(0)).cast("int").alias("r")))
    moved = shorten_to(grown, covered_length(ranges), F.when(d > 0, -1).otherwise(1))
    # one block is moved without a walk
    l, r, by = ranges[0]["l"], ranges[0]["r"], F.coalesce(d, F.lit(0))
    one = F.when(r > l, F.array(F.struct((l + by).cast("int").alias("l"), (r + by).cast("int").alias("r")))).otherwise(F.expr("cast(array() as array<struct<l:int,r:int>>)"))
    return F.when(n == 1, one).otherwise(moved)


def array_runs(values: Column) -> Column:
    """Sorted distinct integers as inclusive runs."""
    blocks = F.transform(values, lambda v: F.struct(v.cast("int").alias("l"), (v + 1).cast("int").alias("r")))
    return F.transform(collapse_blocks(blocks), lambda x: F.struct(x["l"].alias("first"), (x["r"] - 1).alias("last")))


def node_labels(s_tag: Column, e_tag: Column, capped: Column, condensed: Column, strand: Column) -> Column:
    """The two end labels, in genome order; lower case for condensed rows."""
    s = F.when(capped, "C").when(s_tag, "S").otherwise(".")
    e = F.when(e_tag, "E").otherwise(".")
    both = F.when(strand == -1, F.concat(e, s)).otherwise(F.concat(s, e))
    return F.when(condensed, F.lower(both)).otherwise(both)


# --- two rows ----------------------------------------------------------------


def overlaps(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    """Closed test: spans that touch overlap."""
    return (r1 >= l2) & (l1 <= r2)


def overlap_range(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    return F.struct(F.greatest(l1, l2).alias("l"), F.least(r1, r2).alias("r"))


def overlap_type(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    """Whether the left edge is at or beyond the other's left (ll) and right (lr), and
    the right edge at or beyond them (rl, rr)."""
    return F.struct((l1 >= l2).alias("ll"), (l1 >= r2).alias("lr"), (r1 >= l2).alias("rl"), (r1 >= r2).alias("rr"))


def shared_bases(a: Column, b: Column) -> Column:
    """Bases in blocks of both rows."""
    one = lambda x: F.aggregate(b, F.lit(0), lambda s, y: s + F.greatest(F.lit(0), F.least(x["r"], y["r"]) - F.greatest(x["l"], y["l"])))
    return F.aggregate(a, F.lit(0), lambda s, x: s + one(x))


def splice_match(a: Column, b: Column, splice_a: Column | None = None, splice_b: Column | None = None, ignore_ends: bool = True) -> Column:
    """Equal lists of junctions (of gaps, where splice is not given); without
    ignore_ends equal blocks."""
    if not ignore_ends:
        return a == b
    return _spliced(a, splice_a) == _spliced(b, splice_b)


def _spliced(ranges: Column, splice: Column | None) -> Column:
    return gaps(ranges) if splice is None else junctions(ranges, splice)


def _reach(l1: Column, r1: Column, l2: Column, r2: Column, least: int) -> Column:
    """The spans overlap by least bases, or by as many as the shorter one has."""
    shared = F.least(r1, r2) - F.greatest(l1, l2)
    return overlaps(l1, r1, l2, r2) & (shared >= F.least(F.lit(least), r1 - l1, r2 - l2))


def sense_match(strand1: Column, strand2: Column, l1: Column, r1: Column, l2: Column, r2: Column, least: int) -> Column:
    return (strand1 == strand2) & _reach(l1, r1, l2, r2, least)


def antisense_match(strand1: Column, strand2: Column, l1: Column, r1: Column, l2: Column, r2: Column, least: int) -> Column:
    """Opposite strands; two rows without a strand are opposite too."""
    return (strand1 == -strand2) & _reach(l1, r1, l2, r2, least)


def ends_clash(strand1, s1, e1, l1, r1, strand2, s2, e2, l2, r2) -> Column:
    """One row reaches beyond the other's start or end label: both plus, or one minus
    and the other not plus. Opposite strands clash."""
    left_closed, right_closed = lambda s, e, minus: e if minus else s, lambda s, e, minus: s if minus else e

    def beyond(minus: bool) -> Column:
        return (left_closed(s1, e1, minus) & (l1 > l2)) | (left_closed(s2, e2, minus) & (l2 > l1)) | (right_closed(s1, e1, minus) & (r1 < r2)) | (right_closed(s2, e2, minus) & (r2 < r1))

    low = F.least(strand1, strand2)
    return F.when(strand1 * strand2 == -1, True).when(low == 1, beyond(False)).when(low == -1, beyond(True)).otherwise(False)


def compatible(a: Column, b: Column, strand1: Column | None = None, strand2: Column | None = None, splice_a: Column | None = None, splice_b: Column | None = None, clash: Column | None = None, ignore_overhang: bool = False, allow_retention: bool = False) -> Column:
    """Nothing shows that both rows can't be parts of one molecule: strands do not
    oppose, ends do not clash (``ends_clash``, where given), and the junctions that
    reach into the spans' overlap (ignore_overhang: that lie inside it) are equal, or
    with allow_retention a's are among b's. Spans that do not overlap are compatible."""
    l, r = F.greatest(left(a), left(b)), F.least(right(a), right(b))
    inside = (lambda g: (g["l"] > l) & (g["r"] < r)) if ignore_overhang else (lambda g: (g["r"] > l) & (g["l"] < r))
    j1, j2 = F.filter(_spliced(a, splice_a), inside), F.filter(_spliced(b, splice_b), inside)
    same = (j1 == j2) | (F.size(F.array_except(j1, j2)) == 0) if allow_retention else j1 == j2
    out = ~overlaps(left(a), right(a), left(b), right(b)) | same
    if strand1 is not None and strand2 is not None:
        out = out & (strand1 * strand2 != -1)
    return out if clash is None else out & ~clash
