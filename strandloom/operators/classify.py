"""Transcripts against a reference annotation.

Pairs come from an interval join on chrom, so a locus is never gathered; a CASE ladder
gives each pair its class. One row per transcript is chosen by aggregation, except
fusions, which are folded over a transcript's references in their order.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators import intervals as I
from strandloom.operators.joins import range_join, span, with_pieces

# The classes and their codes.
CLASSES = {0.0: "intergenic", 1.0: "ambiguous", 2.0: "antisense", 3.0: "intronic", 4.0: "splice_variant", 4.1: "alt_tss", 4.2: "alt_pas", 4.3: "retained_intron", 5.0: "fragment", 6.0: "fusion", 7.0: "exon_match", 8.0: "full_match"}


def pairs(query: DataFrame, reference: DataFrame, bin_size: int = 2000) -> DataFrame:
    """query(row, chrom, strand, ranges) x reference(row, gene_id, ...) that overlap."""
    spans = lambda df: df.withColumns({"left": I.left(F.col("ranges")), "right": I.right(F.col("ranges"))})
    a = spans(query.select("row", "chrom", "strand", "ranges"))
    b = spans(reference.select("chrom", F.col("row").alias("ref"), F.col("gene_id").alias("ref_gene"), F.col("strand").alias("ref_strand"), F.col("ranges")))
    b = b.withColumnRenamed("ranges", "ref_ranges")
    out = range_join(a, b, ["chrom"], bin_size)
    out = out.withColumns({"gaps": I.gaps(F.col("ranges")), "ref_gaps": I.gaps(F.col("ref_ranges"))})
    # the gaps of either row that reach into the overlap, once for all rules of match_code
    l, r = F.greatest("left", "b_left"), F.least("right", "b_right")
    reach = {n: F.filter(c, lambda g: (g["r"] > l) & (g["l"] < r)) for n, c in (("reach", "gaps"), ("ref_reach", "ref_gaps"))}
    return out.withColumns(reach | {"shared": I.shared_bases(F.col("ranges"), F.col("ref_ranges")), "n": I.covered_length(F.col("ranges")), "ref_n": I.covered_length(F.col("ref_ranges"))})


def end_differences() -> tuple[Column, Column]:
    """How far the 5' and the 3' end of a pair lie apart, by the query's strand."""
    low, high, plus = F.col("left") - F.col("b_left"), F.col("right") - F.col("b_right"), F.col("strand") == 1
    return F.when(plus, low).otherwise(high), F.when(plus, high).otherwise(low)


def match_code(end_buffer: int = 100, fragment: float = 0.6, match_unstranded: bool = False) -> Column:
    """The class of a pair (of ``pairs``, whose spans overlap: compatible, as in
    ``intervals.compatible``, asks for gaps and strands only). Equal junctions on one strand: full_match, fragment or
    exon_match by ends and length; compatible: fragment of a longer reference, else
    splice_variant; otherwise by strand, shared bases, and how the chains differ."""
    a, b, strand = F.col("ranges"), F.col("ref_ranges"), F.col("strand")
    kin = strand * F.col("ref_strand") != -1
    gaps, ref_gaps, reach, ref_reach = (F.col(c) for c in ("gaps", "ref_gaps", "reach", "ref_reach"))
    l, r = F.greatest("left", "b_left"), F.least("right", "b_right")
    within = lambda c: F.filter(c, lambda g: (g["l"] > l) & (g["r"] < r))
    inner = (within(gaps) == within(ref_gaps)) & kin
    retained = ((reach == ref_reach) | (F.size(F.array_except(reach, ref_reach)) == 0)) & kin
    five, three = end_differences()
    close = (F.abs(F.col("left") - F.col("b_left")) <= end_buffer) & (F.abs(F.col("right") - F.col("b_right")) <= end_buffer)
    whole = F.when(close, 8.0).when(F.col("n") < fragment * F.col("ref_n"), 5.0).otherwise(7.0)
    first, last, ref_first, ref_last = a[0], F.element_at(a, -1), b[0], F.element_at(b, -1)
    low = (ref_first["r"] < first["l"]) | (first["r"] < ref_first["l"])
    high = (ref_last["l"] > last["r"]) | (last["l"] > ref_last["r"])
    tss, pas = F.when(strand == 1, low).otherwise(high), F.when(strand == 1, high).otherwise(low)
    ends = F.when(pas & ~(tss & (F.abs(five) > F.abs(three))), 4.2).when(tss, 4.1).otherwise(0.0)
    spans = (first["l"] < ref_first["r"]) & (last["r"] > ref_last["l"])
    chains = F.when(inner, ends).when(retained, F.when(spans, 4.3).otherwise(5.0)).otherwise(4.0)
    apart = F.when(strand == 0, 1.0).when(strand != F.col("ref_strand"), 2.0).when(F.col("shared") == 0, 3.0).otherwise(chains)
    code = F.when((gaps == ref_gaps) & (strand == F.col("ref_strand")), whole).when((reach == ref_reach) & kin, F.when(F.col("ref_n") > F.col("n"), 5.0).otherwise(4.0)).otherwise(apart)
    return code if match_unstranded else F.when((strand == 0) & F.floor(code).isin(4, 7, 8), 1.0).otherwise(code)


def classify(query: DataFrame, reference: DataFrame, end_buffer: int = 100, bin_size: int = 2000) -> DataFrame:
    """row, code, ref, ref_gene, shared: the best reference of every query row."""
    rated = pairs(query, reference, bin_size).withColumn("code", match_code(end_buffer)).where("code > 0 or shared > 0")
    best = rated.groupBy("row").agg(F.max(F.struct("code", "shared", (-F.col("ref")).alias("neg"), F.col("ref"), F.col("ref_gene"))).alias("x"))
    out = query.select("row").join(best, "row", "left")
    return out.select("row", F.coalesce("x.code", F.lit(0.0)).alias("code"), "x.ref", "x.ref_gene", F.coalesce("x.shared", F.lit(0)).alias("shared"))


def _shared(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> int:
    return sum(max(0, min(r1, r2) - max(l1, l2)) for l1, r1 in a for l2, r2 in b)


def fold_fusions(refs: list[tuple], covered: float = 0.9) -> tuple[float, str, str]:
    """(code, refs, genes) of references (id, gene, code, shared, ref_n, blocks) of one
    transcript, taken in order of place and id. A full match stays but for one that
    shares more; another gene's reference joins as a fusion if neither is antisense, each
    is nearly all shared or matches by structure, and they share little; otherwise the
    higher code, then the larger share, stays."""
    best: tuple | None = None
    structure = lambda x: x[3] >= covered * x[4] or int(x[2]) in (4, 6, 7)
    for new in sorted(refs, key=lambda r: (r[5][0][0], r[5][-1][1], r[0])):
        new = (str(new[0]), str(new[1]), *new[2:])
        if best is None:
            best = new if new[2] > 0 or new[3] > 0 else None
        elif best[2] == 8 or new[2] == 8:
            if new[2] == 8 and (best[2] != 8 or new[3] > best[3]):
                best = new
        elif new[1] != best[1] and 2 not in (new[2], best[2]) and structure(new) and structure(best) and _shared(best[5], new[5]) < covered * min(best[4], new[4]):
            best = (f"{best[0]}|{new[0]}", f"{best[1]}|{new[1]}", 6.0, max(best[3], new[3]), max(best[4], new[4]), best[5] if best[3] > new[3] else new[5])
        elif (new[2], new[3]) > (best[2], best[3]):
            best = new
    return (best[2], best[0], best[1]) if best else (0.0, "", "")


def classify_with_fusions(query: DataFrame, reference: DataFrame, end_buffer: int = 100, bin_size: int = 2000) -> DataFrame:
    """row, code, refs, genes with fusions; one small group per transcript."""
    rated = pairs(query, reference, bin_size).withColumn("code", match_code(end_buffer))
    entry = F.struct(F.col("ref").alias("i"), F.col("ref_gene").cast("string").alias("g"), F.col("code").alias("c"), F.col("shared").alias("s"), F.col("ref_n").alias("m"), F.col("ref_ranges").alias("b"))
    lists = rated.groupBy("row").agg(F.collect_list(entry).alias("refs"))

    @F.pandas_udf("code double, refs string, genes string")
    def fold(refs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None) if r is None else fold_fusions([(x["i"], x["g"], x["c"], x["s"], x["m"], [(y["l"], y["r"]) for y in x["b"]]) for x in r]) for r in refs], columns=["code", "refs", "genes"])

    # one reference stays if it says anything; only several are folded
    only, several = F.col("refs")[0], F.size("refs") > 1
    says = (only["c"] > 0) | (only["s"] > 0)
    alone = F.struct(F.when(says, only["c"]).otherwise(0.0).alias("code"), F.when(says, only["i"].cast("string")).otherwise("").alias("refs"), F.when(says, F.coalesce(only["g"], F.lit("None"))).otherwise("").alias("genes"))
    found = lists.select("row", "refs", fold(F.when(several, F.col("refs"))).alias("x")).select("row", F.when(several, F.col("x")).otherwise(alone).alias("x")).select("row", "x.*")
    return query.select("row").join(found, "row", "left").withColumn("code", F.coalesce("code", F.lit(0.0)))


def report(classified: DataFrame) -> DataFrame:
    names = F.create_map(*[x for k, v in CLASSES.items() for x in (F.lit(k), F.lit(v))])
    return classified.withColumn("class", F.element_at(names, F.col("code")))


def classification_table(query: DataFrame, reference: DataFrame, end_buffer: int = 100, bin_size: int = 2000, pass_attributes: bool = False) -> DataFrame:
    """The classification table (``tables.CLASSIFICATION``): every query transcript, its
    best reference, lengths, end differences, and cov, S.reads, S.capped and E.reads, which
    come from the reference with pass_attributes. Those may be missing columns (0)."""
    from strandloom.sources.tables import CLASSIFICATION

    five, three = end_differences()
    rated = pairs(query, reference, bin_size).withColumns({"code": match_code(end_buffer), "diff5p": five, "diff3p": three}).where("code > 0 or shared > 0")
    best = rated.groupBy("row").agg(F.max(F.struct("code", "shared", (-F.col("ref")).alias("neg"), "ref", "ref_gene", "ref_n", "diff5p", "diff3p")).alias("x")).select("row", "x.*")
    donor, key = (reference, "ref") if pass_attributes else (query, "row")
    numbers = [(F.col(f"`{c}`").cast("double") if c in donor.columns else F.lit(0.0)).alias(c) for c in CLASSIFICATION[9:]]
    rows = query.select("row", I.covered_length(F.col("ranges")).alias("assembly_len")).join(best, "row", "left")
    rows = rows.join(donor.select(F.col("row").alias("__d"), *numbers), F.col(key) == F.col("__d"), "left")
    names = F.create_map(*[x for k, v in CLASSES.items() for x in (F.lit(k), F.lit(v))])
    return rows.select(
        F.col("row").cast("string").alias("assembly_id"), F.element_at(names, F.coalesce("code", F.lit(0.0))).alias("classification"),
        F.coalesce(F.col("ref").cast("string"), F.lit("NA")).alias("ref_match"), F.coalesce(F.col("ref_gene").cast("string"), F.lit("NA")).alias("ref_gene"),
        "assembly_len", F.coalesce("ref_n", F.lit(0)).alias("ref_len"), F.coalesce("shared", F.lit(0)).alias("overlap_len"), "diff5p", "diff3p",
        *[F.coalesce(f"`{c}`", F.lit(0.0)).alias(c) for c in CLASSIFICATION[9:]],
    )


def noncanonical_junctions(transcripts: DataFrame, genome: DataFrame) -> DataFrame:
    """transcripts with noncanonical: some intron is not GT-AG or GC-AG on its strand."""
    from strandloom.functions.sequence import reverse_complement

    introns = I.gaps(F.col("ranges"))
    ends = F.flatten(F.transform(introns, lambda g: F.array(span(g["l"], g["l"] + 2), span(g["r"] - 2, g["r"]))))
    out = with_pieces(transcripts, genome, ends, "__ends")
    n = F.size("__ends") / 2
    pairs_ = F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.upper(F.concat(F.get("__ends", 2 * i), F.get("__ends", 2 * i + 1)))))
    odd = lambda m: ~F.when(F.col("strand") == -1, reverse_complement(m)).otherwise(m).isin("GTAG", "GCAG")
    return out.withColumn("noncanonical", F.coalesce(F.exists(pairs_, odd), F.lit(False))).drop("__ends")


def end_windows(transcripts: DataFrame, extend: int = 50, min_terminal: int = 40) -> DataFrame:
    """chrom, strand, kind, left, right, peak, name: start and end windows bounded by
    the terminal exon, for rows with a strand."""
    first, last = F.col("ranges")[0], F.element_at("ranges", -1)
    plus = F.col("strand") == 1
    five, three = F.when(plus, first["l"]).otherwise(last["r"] - 1), F.when(plus, last["r"] - 1).otherwise(first["l"])
    inner = lambda exon: F.greatest(F.lit(min_terminal), exon["r"] - exon["l"])

    def window(kind, peak, at_left):
        exon = F.when(at_left, first).otherwise(last)
        into = F.least(F.lit(extend), inner(exon))
        return F.struct(F.lit(kind).alias("kind"), F.when(at_left, peak - extend).otherwise(peak + 1 - into).alias("left"), F.when(at_left, peak + into).otherwise(peak + 1 + extend).alias("right"), peak.alias("peak"))

    both = F.array(window("S", five, plus), window("E", three, ~plus))
    return transcripts.where("strand != 0").select("chrom", "strand", F.col("row").cast("string").alias("name"), F.inline(both))


def end_lines(ends: DataFrame) -> DataFrame:
    """chrom, left, right, value: BED6 lines of end windows (``end_windows``, or what
    ``islands.merge_ends`` made of them), named <kind><P or M>:<name>, scored by their peak."""
    sign = F.when(F.col("strand") == -1, "M").otherwise("P")
    strand = F.when(F.col("strand") == -1, "-").otherwise("+")
    line = F.concat_ws("\t", "chrom", "left", "right", F.concat("kind", sign, F.lit(":"), "name"), "peak", strand)
    return ends.select("chrom", "left", "right", line.alias("value"))
