"""SAM alignments to end-labelled reads. Blocks come from CIGAR by a fold in the JVM;
filters, strands and weights are columns; mates and multimappers meet by name."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import motif_strand, read_tag
from strandloom.operators.intervals import collapse_blocks, covered_length, gaps

# SAM flag bits.
PAIRED, UNMAPPED, REVERSE, SECOND, SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = 0x1, 0x4, 0x10, 0x80, 0x100, 0x200, 0x400, 0x800
# Settings by kind of data; untrimmed long reads are not oriented yet.
PRESETS = {
    "ONT": {"stranded": True, "s_tag": True, "e_tag": True, "max_headclip": 10, "error_rate": 0.2, "trim_gaps": True},
    "ONT untrimmed": {"stranded": False, "s_tag": False, "e_tag": False, "max_headclip": 120, "error_rate": 0.2, "trim_gaps": True},
    "PACBIO": {"stranded": True, "s_tag": True, "e_tag": True, "max_headclip": 4, "trim_gaps": True},
    "DIRECT_RNA": {"stranded": True, "trim_gaps": True},
    "SMART": {"stranded": False, "trim_gaps": True},
}
NAMES = {"NANOPORE": "ONT", "OXFORD": "ONT", "ISOSEQ": "PACBIO", "ISOSEQ3": "PACBIO", "FLNC": "PACBIO", "ONT-RNA": "DIRECT_RNA", "ONT_RNA": "DIRECT_RNA", "DIRECT-RNA": "DIRECT_RNA", "SMARTER": "SMART", "SMARTSEQ": "SMART", "SMART-SEQ": "SMART"}


def preset(kind: str, untrimmed: bool = False) -> dict:
    """The arguments of reads_of for a kind of data."""
    name = kind.upper()
    name = NAMES.get(name, name)
    if name not in PRESETS:  # protocol versions are numbered
        name = NAMES.get(name.strip("0123456789"), name.strip("0123456789"))
    if name not in PRESETS:
        raise ValueError(f"{kind}: expected one of {', '.join(k for k in PRESETS if ' ' not in k)}")
    return PRESETS["ONT untrimmed" if untrimmed and name == "ONT" else name]


def flag(bit: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(bit)) != 0


def cigar_blocks(cigar: Column, pos: Column, max_indel: int = 10) -> Column:
    """ranges and splice (N gaps, or deletions of more than max_indel as plain gaps),
    clipped bases at both ends."""
    ops = F.zip_with(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)), F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1)), lambda n, o: F.struct(n.cast("int").alias("n"), o.alias("o")))
    empty = F.expr("cast(array() as array<struct<l:int,r:int>>)")
    start = F.struct((pos - 1).cast("int").alias("at"), empty.alias("b"), F.expr("cast(array() as array<boolean>)").alias("s"), F.lit(None).cast("boolean").alias("gap"))

    def step(a: Column, x: Column) -> Column:
        match = x["o"].isin("M", "=", "X")
        joined = F.size(a["b"]) > 0
        last = F.element_at(a["b"], -1)
        grow = match & joined & a["gap"].isNull()
        blocks = F.when(grow, F.concat(F.slice(a["b"], 1, F.size(a["b"]) - 1), F.array(F.struct(last["l"].alias("l"), (a["at"] + x["n"]).alias("r"))))).when(match, F.concat(a["b"], F.array(F.struct(a["at"].alias("l"), (a["at"] + x["n"]).alias("r"))))).when((x["o"] == "D") & (x["n"] <= max_indel) & joined & a["gap"].isNull(), F.concat(F.slice(a["b"], 1, F.size(a["b"]) - 1), F.array(F.struct(last["l"].alias("l"), (a["at"] + x["n"]).alias("r"))))).otherwise(a["b"])
        gap = F.when(match, F.lit(None).cast("boolean")).when(x["o"] == "N", F.lit(True)).when((x["o"] == "D") & (x["n"] > max_indel), F.coalesce(a["gap"], F.lit(False))).otherwise(a["gap"])
        splices = F.when(match & a["gap"].isNotNull() & joined, F.concat(a["s"], F.array(a["gap"]))).otherwise(a["s"])
        moves = F.when(x["o"].isin("M", "=", "X", "D", "N"), x["n"]).otherwise(0)
        return F.struct((a["at"] + moves).alias("at"), blocks.alias("b"), splices.alias("s"), gap.alias("gap"))

    done = F.aggregate(ops, start, step)
    clip = lambda p: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(cigar, p, 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    return F.struct(done["b"].alias("ranges"), done["s"].alias("splice"), clip(r"^(\d+)S").alias("head"), clip(r"(\d+)S$").alias("tail"))


def trim_terminal_gaps(ranges: Column, splice: Column) -> Column:
    """(ranges, splice, left_trim, right_trim) without the outer blocks that gaps part from
    the rest: what lies from the first splice to the last one. Without any splice one block
    stays, the middle one or the longer of the two middle ones."""
    n = F.size(splice)
    first = F.array_position(splice, True).cast("int")
    last = n + 1 - F.array_position(F.reverse(splice), True).cast("int")
    half = F.floor((n + 1) / 2).cast("int")  # of n + 1 blocks
    a, b = F.get(ranges, half - 1), F.get(ranges, half)
    middle = F.when((n % 2 == 1) & (a["r"] - a["l"] >= b["r"] - b["l"]), half).otherwise(half + 1)
    low, high = F.when(first > 0, first).otherwise(middle), F.when(first > 0, last + 1).otherwise(middle)
    kept = F.struct(F.slice(ranges, low, high - low + 1).alias("ranges"), F.slice(splice, low, high - low).alias("splice"), (low > 1).alias("left_trim"), (high < n + 1).alias("right_trim"))
    return F.when(n > 0, kept).otherwise(F.struct(ranges.alias("ranges"), splice.alias("splice"), F.lit(False).alias("left_trim"), F.lit(False).alias("right_trim")))


def md_mismatches(md: Column) -> Column:
    """Mismatched bases of an MD tag (deletions do not count)."""
    return F.length(F.regexp_replace(F.regexp_replace(md, r"\^[A-Za-z]+", ""), r"\d", ""))


def reads_of(sam: DataFrame, source: str = "SAM", stranded: bool = False, secondary: bool = False, error_rate: float = 0.1, minlen: int = 18, max_indel: int = 10, max_intron: int = 100_000, genome: DataFrame | None = None, s_tag: bool = False, e_tag: bool = False, max_headclip: int | None = None, trim_gaps: bool = False) -> DataFrame:
    """Reads with blocks, strands, end labels (from names' tags and clips) and weights
    1 / number of alignments. s_tag, e_tag: reads with a strand are whole molecules, whose
    start counts unless more than max_headclip bases are clipped there. trim_gaps: see
    ``trim_terminal_gaps``; trimmed ends lose their labels, and so do both ends of a spliced
    read whose tagged strand is not its labels'."""
    drop = UNMAPPED | FAILED | DUPLICATE | SUPPLEMENTARY | (0 if secondary else SECONDARY)
    rows = sam.where(F.col("flag").bitwiseAND(F.lit(drop)) == 0).where("cigar != '*'")
    rows = rows.withColumn("__b", cigar_blocks(F.col("cigar"), F.col("pos"), max_indel)).select("*", "__b.*").drop("__b")
    n = covered_length(F.col("ranges"))
    errors = F.coalesce(md_mismatches(F.try_element_at("tags", F.lit("MD"))), F.lit(0))
    rows = rows.where((F.size("ranges") > 0) & (n >= minlen) & (errors <= error_rate * n) & ~F.exists(gaps(F.col("ranges")), lambda g: g["r"] - g["l"] > max_intron))
    reverse = F.when(flag(REVERSE), -1).otherwise(1)
    own = F.when(flag(PAIRED) & flag(SECOND), -reverse).otherwise(reverse)
    xs = F.try_element_at("tags", F.lit("XS"))
    ts = F.try_element_at("tags", F.lit("ts"))
    by_tag = F.when(xs == "+", 1).when(xs == "-", -1).when(ts == "+", own).when(ts == "-", -own)
    tag = read_tag(F.col("qname"))
    labelled = (tag["s"] + tag["e"] + tag["c"]) > 0
    strand = F.coalesce(by_tag, F.when(labelled | F.lit(stranded), own), F.lit(0))
    rows = rows.withColumns({"strand": strand.cast("int"), "s_tag": (tag["s"] + tag["c"]) > 0, "e_tag": tag["e"] > 0})
    if s_tag or e_tag:
        clipped = F.when(F.col("strand") == -1, F.col("tail")).otherwise(F.col("head"))
        near = F.lit(True) if max_headclip is None else clipped <= max_headclip
        rows = rows.withColumns({"s_tag": F.col("s_tag") | (F.lit(s_tag) & (F.col("strand") != 0) & near), "e_tag": F.col("e_tag") | (F.lit(e_tag) & (F.col("strand") != 0))})
    head = F.when(F.col("strand") == -1, F.reverse(F.translate(F.substring(F.col("seq"), F.length("seq") - F.col("tail") + 1, F.col("tail")), "ACGT", "TGCA"))).otherwise(F.substring(F.col("seq"), F.lit(1), F.col("head")))
    capped = F.col("s_tag") & head.rlike("^.*G{1,4}$")
    rows = rows.withColumn("capped", F.coalesce(capped, F.lit(False)))
    against = by_tag.isNotNull() & labelled & (by_tag != own) & F.exists("splice", lambda x: x)
    rows = rows.withColumns({c: F.col(c) & ~F.coalesce(against, F.lit(False)) for c in ("s_tag", "e_tag", "capped")})
    if genome is not None:
        rows = motif_strands(rows, genome)
    if trim_gaps:
        rows = rows.withColumn("__t", trim_terminal_gaps(F.col("ranges"), F.col("splice")))
        at_start = F.when(F.col("strand") == -1, F.col("__t.right_trim")).otherwise(F.col("__t.left_trim"))
        at_end = F.when(F.col("strand") == -1, F.col("__t.left_trim")).otherwise(F.col("__t.right_trim"))
        labels = {"s_tag": F.col("s_tag") & ~at_start, "capped": F.col("capped") & ~at_start, "e_tag": F.col("e_tag") & ~at_end}
        rows = rows.withColumns(labels | {"ranges": F.col("__t.ranges"), "splice": F.col("__t.splice")}).drop("__t")
    count = F.coalesce(F.try_element_at("tags", F.lit("NH")).try_cast("double"), F.count("*").over(Window.partitionBy("qname", flag(SECOND))).cast("double"))
    rows = rows.withColumn("weight", 1 / count)
    hit = F.coalesce(F.try_element_at("tags", F.lit("HI")), F.concat_ws(":", "rname", F.when(flag(SECOND), F.col("pnext")).otherwise(F.col("pos"))))
    return merge_mates(rows.withColumn("hit", hit), source)


def motif_strands(rows: DataFrame, genome: DataFrame) -> DataFrame:
    """Strands from splice motifs for rows without one."""
    from strandloom.operators.joins import span, with_pieces

    introns = F.filter(gaps(F.col("ranges")), lambda g: g["r"] - g["l"] >= 4)
    ends = F.flatten(F.transform(introns, lambda g: F.array(span(g["l"], g["l"] + 2), span(g["r"] - 2, g["r"]))))
    out = with_pieces(rows, genome, F.when(F.col("strand") == 0, ends), "__ends", chrom="rname")
    n = F.size("__ends") / 2
    votes = F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: motif_strand(F.get("__ends", 2 * i), F.get("__ends", 2 * i + 1))))
    total = F.coalesce(F.aggregate(votes, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(0))
    return out.withColumn("strand", F.when(F.col("strand") == 0, F.signum(total).cast("int")).otherwise(F.col("strand"))).drop("__ends")


def merge_mates(rows: DataFrame, source: str) -> DataFrame:
    """One read per name and hit: united blocks, OR of flags, gaps that either mate
    splices stay splices."""
    spliced = F.transform(F.filter(F.arrays_zip(gaps(F.col("ranges")).alias("g"), F.col("splice").alias("s")), lambda x: x["s"]), lambda x: x["g"])
    each = rows.withColumn("__s", spliced)
    out = each.groupBy("qname", "hit", F.col("rname").alias("chrom")).agg(
        collapse_blocks(F.flatten(F.collect_list("ranges"))).alias("ranges"), F.flatten(F.collect_set("__s")).alias("__s"), F.max_by("strand", F.abs("strand")).alias("strand"),
        *[F.max(c).alias(c) for c in ("s_tag", "e_tag", "capped")], F.max("weight").alias("weight"),
    )
    out = out.withColumn("splice", F.transform(gaps(F.col("ranges")), lambda g: F.array_contains(F.col("__s"), g)))
    return out.select("chrom", F.col("ranges")[0]["l"].alias("left"), F.element_at("ranges", -1)["r"].alias("right"), "strand", "ranges", "splice", "s_tag", "e_tag", "capped", F.lit(False).alias("condensed"), F.lit(source).alias("source"), "weight")


def junctions_of(sam: DataFrame, max_indel: int = 10) -> DataFrame:
    """Junction rows of alignments: unique and multi by NH, overhang the shorter flank."""
    rows = sam.where(F.col("flag").bitwiseAND(F.lit(UNMAPPED | FAILED | SUPPLEMENTARY)) == 0).withColumn("__b", cigar_blocks(F.col("cigar"), F.col("pos"), max_indel)).select("rname", "tags", "__b.*")
    n = F.size("ranges")
    each = rows.where(n > 1).select("rname", "tags", "ranges", "splice", F.explode(F.sequence(F.lit(1), n - 1)).alias("i")).where(F.element_at("splice", F.col("i")))
    a, b = F.element_at("ranges", F.col("i")), F.element_at("ranges", F.col("i") + 1)
    unique = F.coalesce(F.try_element_at("tags", F.lit("NH")), F.lit("1")) == "1"
    rows = each.select(F.col("rname").alias("chrom"), a["r"].alias("start"), b["l"].alias("end"), F.coalesce(F.try_element_at("tags", F.lit("XS")), F.lit(".")).alias("strand"), unique.cast("long").alias("uniq"), (~unique).cast("long").alias("multi"), F.least(a["r"] - a["l"], b["r"] - b["l"]).alias("overhang"))
    from strandloom.operators.collapse import merge_junctions

    return merge_junctions(rows)
