"""BED, GTF/GFF3, splice-junction tables, FASTA, FASTQ, SAM and small TSV tables."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators.intervals import collapse_blocks, normal_flags
from strandloom.sources.elr import label_string, strand_number, strand_sign, weight_text

# --- BED ---------------------------------------------------------------------

# Item colours by the kinds of ends that a row has.
COLORS = {"complete": "0,128,0", "start": "0,0,255", "end": "255,0,0", "none": "128,128,128"}


def _cell(i: int) -> Column:
    return F.get("__p", F.lit(i))


def _ints(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int"))


def parse_bed(lines: DataFrame, source: str = "BED", s_tag: bool = False, e_tag: bool = False, capped: bool = False, gaps_are_junctions: bool = True) -> DataFrame:
    """Reads of BED6, BED12 or BED15 (BED12 and weight, source, label string)."""
    rows = lines.where(~F.col("value").rlike(r"^(#|track|browser)") & (F.trim("value") != "")).withColumn("__p", F.split("value", "\t")).withColumn("__n", F.size("__p"))
    start = _cell(1).cast("int")
    blocks = F.when(F.col("__n") >= 12, F.zip_with(_ints(_cell(11)), _ints(_cell(10)), lambda s, z: F.struct((start + s).alias("l"), (start + s + z).alias("r")))).otherwise(F.array(F.struct(start.alias("l"), _cell(2).cast("int").alias("r"))))
    label = F.when(F.col("__n") >= 15, _cell(14))
    strand = strand_number(_cell(5))
    end = lambda minus: F.when((strand == -1) == F.lit(minus), F.substring(label, 1, 1)).otherwise(F.substring(label, -1, 1))
    five, three = end(False), end(True)
    out = rows.select(
        _cell(0).alias("chrom"), F.coalesce(_cell(3), F.lit("")).alias("name"), strand.alias("strand"), blocks.alias("ranges"),
        F.when(label.isNotNull(), F.upper(five).isin("S", "C")).otherwise(s_tag).alias("s_tag"), F.when(label.isNotNull(), F.upper(three) == "E").otherwise(e_tag).alias("e_tag"),
        F.when(label.isNotNull(), F.upper(five) == "C").otherwise(capped).alias("capped"), F.coalesce(five.rlike("[a-z]") | three.rlike("[a-z]"), F.lit(False)).alias("condensed"),
        F.coalesce(F.when(F.col("__n") >= 15, _cell(13)), F.lit(source)).alias("source"), label.alias("elcigar"),
        F.coalesce(F.when(F.col("__n") >= 15, _cell(12).try_cast("double")), _cell(4).try_cast("double"), F.lit(1.0)).alias("weight"),
    )
    marks = F.regexp_extract_all("elcigar", F.lit(r"\d([AD.])-?\d+[AD.]"), F.lit(1))
    plain = F.transform(F.array_repeat(F.lit(gaps_are_junctions), F.greatest(F.size("ranges") - 1, F.lit(0))), lambda x: x)
    out = out.withColumn("splice", F.when(F.col("elcigar").isNotNull(), F.transform(marks, lambda m: m != ".")).otherwise(plain))
    return normal_flags(out.withColumns({"left": F.col("ranges")[0]["l"], "right": F.element_at("ranges", -1)["r"]}))


def parse_color_code(lines: DataFrame) -> DataFrame:
    """key, color of a two-column TSV; of repeated keys the last line's in sort order counts."""
    p = F.split("value", "\t")
    return lines.where(F.size(p) >= 2).groupBy(p[0].alias("key")).agg(F.max(p[1]).alias("color"))


def with_colors(reads: DataFrame, codes: DataFrame, key: Column) -> DataFrame:
    """reads with color: that of their key, which bed_lines uses; a small table."""
    return reads.join(F.broadcast(codes.select(F.col("key").alias("__key"), "color")), key == F.col("__key"), "left").drop("__key")


def bed_lines(reads: DataFrame, score: str = "weight") -> DataFrame:
    """value: BED15 lines; needs name (or an empty one), and takes color where given."""
    name = F.col("name") if "name" in reads.columns else F.lit(".")
    label = label_string(*[F.col(x) for x in ("ranges", "splice", "s_tag", "e_tag", "capped", "condensed", "strand")])
    color = F.when(F.col("s_tag") & F.col("e_tag"), COLORS["complete"]).when(F.col("s_tag"), COLORS["start"]).when(F.col("e_tag"), COLORS["end"]).otherwise(COLORS["none"])
    color = F.coalesce("color", color) if "color" in reads.columns else color
    sizes = F.array_join(F.transform("ranges", lambda x: (x["r"] - x["l"]).cast("string")), ",")
    starts = F.array_join(F.transform("ranges", lambda x: (x["l"] - F.col("left")).cast("string")), ",")
    cells = ["chrom", "left", "right", name, weight_text(F.col(score)), strand_sign(F.col("strand")), "left", "right", color, F.size("ranges"), sizes, starts, weight_text(F.col("weight")), "source", label]
    return reads.select(F.concat_ws("\t", *cells).alias("value"))


# --- GTF and GFF3 ----------------------------------------------------------------


def _first_of_keys(entries: Column) -> Column:
    """A map of (k, v) entries; of entries with one key the first counts."""
    keys = F.transform(entries, lambda e: e["k"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["k"]) == i + 1))


def _gff_attributes(a: Column) -> Column:
    pair = lambda t: F.struct(F.trim(F.substring_index(t, "=", 1)).alias("k"), F.substring(t, F.locate("=", t) + 1, F.length(t)).alias("v"))
    return _first_of_keys(F.transform(F.filter(F.split(a, ";"), lambda t: F.contains(t, F.lit("="))), pair))


def _gtf_attributes(a: Column) -> Column:
    found = F.regexp_extract_all(a, F.lit(r'[^\s;]+\s+(?:"[^"]*"|[^";\s]+)'), F.lit(0))
    pair = lambda t: F.struct(F.substring_index(t, " ", 1).alias("k"), F.btrim(F.ltrim(F.substring(t, F.locate(" ", t), F.length(t))), F.lit('"')).alias("v"))
    return _first_of_keys(F.transform(found, pair))


def parse_annotation(lines: DataFrame, transcript_types=("transcript", "mRNA"), exon_types=("exon", "CDS"), transcript_keys=("transcript_id", "Parent", "ID"), gene_keys=("gene_id", "Parent")) -> DataFrame:
    """One row per line: kind (transcript, exon, CDS), ids, 0-based bounds, attributes.
    GTF values may lack quotes; GFF3 attributes are k=v."""
    rows = lines.where(~F.col("value").startswith("#")).withColumn("__p", F.split("value", "\t")).where(F.size("__p") >= 9)
    a = _cell(8)
    is_gff = a.rlike(r"^\s*[^\s;\"]+=")
    rows = rows.withColumn("attributes", F.when(is_gff, _gff_attributes(a)).otherwise(_gtf_attributes(a)))
    pick = lambda keys: F.coalesce(*[F.try_element_at("attributes", F.lit(k)) for k in keys])
    kind = F.when(_cell(2).isin(*transcript_types), "transcript").when(_cell(2) == "CDS", "CDS").when(_cell(2).isin(*exon_types), "exon")
    own = F.when(kind == "transcript", pick(("transcript_id", "ID"))).otherwise(pick(transcript_keys))
    return rows.where(kind.isNotNull()).select(
        _cell(0).alias("chrom"), _cell(1).alias("source"), kind.alias("kind"), (_cell(3).cast("int") - 1).alias("left"), _cell(4).cast("int").alias("right"),
        strand_number(_cell(6)).alias("strand"), own.alias("transcript_id"), pick(gene_keys).alias("gene_id"), "attributes",
    )


def transcripts(annotation: DataFrame, weight_key: str = "cov") -> DataFrame:
    """Parents and their exons, in any line order: transcripts with exons only; child
    attributes fill gaps of the parent's; CDS bounds; touching exons merge."""
    kids = annotation.where("kind != 'transcript'").groupBy("transcript_id").agg(
        collapse_blocks(F.collect_list(F.struct(F.col("left").alias("l"), F.col("right").alias("r")))).alias("ranges"),
        F.min(F.when(F.col("kind") == "CDS", F.col("left"))).alias("cds_left"), F.max(F.when(F.col("kind") == "CDS", F.col("right"))).alias("cds_right"),
        F.min("gene_id").alias("kid_gene"), F.min("chrom").alias("kid_chrom"), F.min("strand").alias("kid_strand"), F.min_by("attributes", "left").alias("kid_attributes"), F.min("source").alias("kid_source"),
    )
    heads = annotation.where("kind = 'transcript'").groupBy("transcript_id").agg(*[F.min_by(c, "left").alias(c) for c in ("chrom", "strand", "gene_id", "source", "attributes")])
    rows = kids.join(heads, "transcript_id", "left").where("gene_id is null or kid_gene is null or gene_id = kid_gene or kid_gene = transcript_id")
    missing = F.map_filter("kid_attributes", lambda k, _: F.coalesce(F.try_element_at("attributes", k), F.lit("\0")) == "\0")
    merged = F.when(F.col("attributes").isNull(), F.col("kid_attributes")).otherwise(F.map_concat("attributes", missing))
    out = rows.select(
        "transcript_id", F.coalesce("gene_id", "kid_gene").alias("gene_id"), F.coalesce("chrom", "kid_chrom").alias("chrom"), F.coalesce("strand", "kid_strand").alias("strand"),
        F.coalesce("source", "kid_source").alias("source"), "ranges", "cds_left", "cds_right", merged.alias("attributes"),
    )
    weight = F.coalesce(F.try_element_at("attributes", F.lit(weight_key)).try_cast("double"), F.lit(1.0))
    return out.withColumns({"left": F.col("ranges")[0]["l"], "right": F.element_at("ranges", -1)["r"], "weight": weight, "splice": F.array_repeat(F.lit(True), F.size("ranges") - 1)})


def import_annotation(spark: SparkSession, path: str, name: str, is_reference: bool = False) -> DataFrame:
    """Transcripts of a GTF, GFF or BED file, with TPM where they have none."""
    from strandloom.operators.collapse import tpm

    lines, kind = spark.read.text(path), path.lower().removesuffix(".gz").rsplit(".", 1)[-1]
    if kind in ("gtf", "gff", "gff3"):
        rows = transcripts(parse_annotation(lines))
    elif kind == "bed":
        bed = parse_bed(lines)
        rows = bed.withColumns({"transcript_id": F.col("name"), "gene_id": F.when(F.col("name").contains("."), F.regexp_replace("name", r"\.[^.]*$", "")).otherwise(F.col("name")), "attributes": F.expr("cast(map() as map<string,string>)")})
    else:
        return spark.createDataFrame([], "transcript_id string")
    rows = tpm(rows.withColumn("source", F.lit(name)))
    given = F.try_element_at("attributes", F.lit("TPM")).try_cast("double")
    return rows.withColumn("TPM", F.coalesce(given, F.bround("TPM", 2))).withColumn("is_reference", F.lit(is_reference))


def annotation_lines(tr: DataFrame, source: str = "engine", gff: bool = False) -> DataFrame:
    """transcript_id, place, value: GTF (GFF3) lines of transcripts, exons after their
    transcript, in 5' to 3' order; CDS parts carry their frame."""
    exons = F.when(F.col("strand") == -1, F.reverse("ranges")).otherwise(F.col("ranges"))
    kv = F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter("attributes", lambda k, _: ~k.isin("gene_id", "transcript_id", "ID", "Parent")))), lambda e: F.concat(e["key"], F.lit("=" if gff else ' "'), e["value"], F.lit("" if gff else '"'))), ";" if gff else "; ")
    ids = F.concat(F.lit("ID="), "transcript_id", F.lit(";Parent="), "gene_id") if gff else F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "'), "transcript_id", F.lit('"'))
    kid = F.concat(F.lit("Parent="), "transcript_id") if gff else ids
    end = "" if gff else ";"
    whole = F.concat(ids, F.when(kv != "", F.concat(F.lit(";" if gff else "; "), kv)).otherwise(""), F.lit(end))
    line = lambda kind, l, r, frame, attrs: F.concat_ws("\t", "chrom", F.lit(source), F.lit(kind), (l + 1).cast("string"), r.cast("string"), F.lit("."), strand_sign(F.col("strand")), frame, attrs)
    parts = [F.array(F.struct(F.lit(0).alias("place"), line("transcript", F.col("left"), F.col("right"), F.lit("."), whole).alias("value")))]
    parts.append(F.transform(exons, lambda x, i: F.struct((2 * i + 1).alias("place"), line("exon", x["l"], x["r"], F.lit("."), F.concat(kid, F.lit(end))).alias("value"))))
    if "cds_left" in tr.columns:
        coding = F.filter(F.transform(exons, lambda x: F.struct(F.greatest(x["l"], F.col("cds_left")).alias("l"), F.least(x["r"], F.col("cds_right")).alias("r"))), lambda x: x["l"] < x["r"])
        step = lambda a, x: F.struct((a["n"] + x["r"] - x["l"]).alias("n"), F.concat(a["all"], F.array(F.struct(x["l"].alias("l"), x["r"].alias("r"), F.pmod(-a["n"], F.lit(3)).alias("f")))).alias("all"))
        framed = F.aggregate(coding, F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<struct<l:int,r:int,f:int>>)").alias("all")), step)["all"]
        parts.append(F.coalesce(F.transform(framed, lambda x, i: F.struct((2 * i + 2).alias("place"), line("CDS", x["l"], x["r"], x["f"].cast("string"), F.concat(kid, F.lit(end))).alias("value"))), F.expr("cast(array() as array<struct<place:int,value:string>>)")))
    return tr.select("transcript_id", F.inline(F.concat(*parts)))


# --- splice junctions ----------------------------------------------------------------


def parse_junctions(lines: DataFrame) -> DataFrame:
    """Star tables (nine columns, 1-based, strand 0 1 2) and BED6."""
    rows = lines.where(F.trim("value") != "").withColumn("__p", F.split("value", "\t"))
    star = F.size("__p") >= 9
    return rows.where(F.size("__p") >= 6).select(
        _cell(0).alias("chrom"), F.when(star, _cell(1).cast("int") - 1).otherwise(_cell(1).cast("int")).alias("start"), _cell(2).cast("int").alias("end"),
        F.when(star, F.when(_cell(3) == "1", "+").when(_cell(3) == "2", "-").otherwise(".")).otherwise(_cell(5)).alias("strand"), F.when(star, _cell(4).cast("int")).otherwise(0).alias("motif"),
        F.when(star, _cell(5) == "1").otherwise(False).alias("annotated"), F.when(star, _cell(6).cast("bigint")).otherwise(_cell(4).try_cast("double").cast("bigint")).alias("uniq"),
        F.when(star, _cell(7).cast("bigint")).otherwise(0).alias("multi"), F.when(star, _cell(8).cast("int")).otherwise(0).alias("overhang"), F.when(~star, _cell(3)).alias("name"),
    )


def junction_lines(sj: DataFrame, star: bool = True) -> DataFrame:
    if star:
        code = F.when(F.col("strand") == "+", 1).when(F.col("strand") == "-", 2).otherwise(0)
        return sj.select(F.concat_ws("\t", "chrom", F.col("start") + 1, "end", code, "motif", F.col("annotated").cast("int"), "uniq", "multi", "overhang").alias("value"))
    return sj.select(F.concat_ws("\t", "chrom", "start", "end", F.coalesce("name", F.lit(".")), F.col("uniq") + F.col("multi"), "strand").alias("value"))


def junction_bed(sj: DataFrame) -> DataFrame:
    """BED9 lines named SJ.<n> in order, coloured by strand; numbers are dealt per chrom
    and offset by the chroms before it."""
    order = Window.partitionBy("chrom").orderBy("start", "end", "strand")
    counts = sj.groupBy("chrom").count()
    before = counts.select("chrom", (F.sum("count").over(Window.orderBy("chrom")) - F.col("count")).alias("__o"))
    color = F.when(F.col("strand") == "+", "255,0,0").when(F.col("strand") == "-", "0,0,255").otherwise("0,0,0")
    rows = sj.join(F.broadcast(before), "chrom").withColumn("__n", F.row_number().over(order) + F.col("__o"))
    return rows.select(F.concat_ws("\t", "chrom", "start", "end", F.concat(F.lit("SJ."), "__n"), F.col("uniq") + F.col("multi"), "strand", "start", "end", color).alias("value"))


# --- sequence files --------------------------------------------------------------------


def read_fasta(spark: SparkSession, path: str, keep_case: bool = True) -> DataFrame:
    """chrom, seq: records are cut at '>' so that splits never break one."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\s]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return rows.select(head.alias("chrom"), (seq if keep_case else F.upper(seq)).alias("seq"))


def fasta_lines(df: DataFrame, name: str = "name", seq: str = "seq", width: int = 80) -> DataFrame:
    wrapped = F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), r"\n$", "")
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrapped).alias("value"))


def fasta_index(df: DataFrame) -> DataFrame:
    return df.select("chrom", F.length("seq").cast("long").alias("length"))


def read_fastq(spark: SparkSession, path: str, mates: str | None = None) -> DataFrame:
    """Records of FASTQ files (also gzipped), each file read whole so that four-line
    records stay together; mates meet by name without its last two characters if
    they differ there."""

    def one(p: str) -> DataFrame:
        lines = spark.read.text(p, wholetext=True).select(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("l"))
        n = F.floor(F.size("l") / 4).cast("int")
        rec = lines.where(n > 0).select("l", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
        at = lambda k: F.get("l", F.col("i") * 4 + k)
        return rec.select(F.regexp_replace(at(0), "^@", "").alias("name"), at(1).alias("seq1"), at(2).alias("plus1"), at(3).alias("qual1"))

    first = one(path)
    if not mates:
        return first.select("*", *[F.lit(None).cast("string").alias(c) for c in ("seq2", "plus2", "qual2")])
    key = lambda df: df.withColumn("__k", F.regexp_replace(F.split("name", " ")[0], r"[/._][12]$", ""))
    second = key(one(mates)).select("__k", F.col("seq1").alias("seq2"), F.col("plus1").alias("plus2"), F.col("qual1").alias("qual2"))
    return key(first).join(second, "__k").withColumn("name", F.col("__k")).drop("__k")


def fastq_lines(df: DataFrame, mate: int = 1) -> DataFrame:
    return df.where(F.col(f"seq{mate}").isNotNull()).select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), F.col(f"seq{mate}"), F.coalesce(f"plus{mate}", F.lit("+")), F.col(f"qual{mate}")).alias("value"))


def parse_sam(lines: DataFrame) -> DataFrame:
    rows = lines.where(~F.col("value").startswith("@")).withColumn("__p", F.split("value", "\t")).where(F.size("__p") >= 11)
    tags = F.map_from_entries(F.transform(F.slice("__p", 12, F.greatest(F.size("__p") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), F.regexp_replace(t, r"^..:.:", ""))))
    names = "qname flag rname pos mapq cigar rnext pnext tlen seq qual".split()
    ints = {"flag", "pos", "mapq", "pnext", "tlen"}
    return rows.select(*[(_cell(i).cast("int") if n in ints else _cell(i)).alias(n) for i, n in enumerate(names)], tags.alias("tags"))


# --- small tables ------------------------------------------------------------------------


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)


def rename_chroms(df: DataFrame, names: DataFrame) -> DataFrame:
    """names(old, new), a small table; chroms not in it stay."""
    return df.join(F.broadcast(names), F.col("chrom") == F.col("old"), "left").withColumn("chrom", F.coalesce("new", "chrom")).drop("old", "new")


def abundances(df: DataFrame) -> DataFrame:
    """df(transcript_id, value) with share, the ratio to all."""
    return df.join(F.broadcast(df.agg(F.sum("value").alias("__t")))).withColumn("share", F.when(F.col("__t") != 0, F.col("value") / F.col("__t")).otherwise(0.0)).drop("__t")


def bedgraph_lines(df: DataFrame) -> DataFrame:
    return df.orderBy("chrom", "start").select(F.concat_ws("\t", "chrom", "start", "end", weight_text(F.col("value"))).alias("value"))


# --- reports -----------------------------------------------------------------------


# The columns of a classification table.
CLASSIFICATION = "assembly_id classification ref_match ref_gene assembly_len ref_len overlap_len diff5p diff3p cov S.reads S.capped E.reads".split()  # noqa: SIM905


def tsv(df: DataFrame, columns: list[str], header: bool = True) -> DataFrame:
    """place, value: a table's lines, a header (place 0) before them. Numbers that are
    not whole have one decimal; nulls are NA."""
    text = lambda c, kind: F.coalesce(F.round(F.col(f"`{c}`"), 1).cast("string") if kind in ("double", "float") else F.col(f"`{c}`").cast("string"), F.lit("NA"))
    kinds = dict(df.dtypes)
    lines = df.select(F.lit(1).alias("place"), F.concat_ws("\t", *[text(c, kinds[c]) for c in columns]).alias("value"))
    if not header:
        return lines
    return df.sparkSession.createDataFrame([(0, "\t".join(columns))], "place int, value string").unionByName(lines)


def check_extension(path: str, kinds: tuple[str, ...]) -> str:
    """The extension of an input (without .gz), which must be one of kinds."""
    name = path.lower().removesuffix(".gz")
    kind = name.rsplit(".", 1)[-1] if "." in name.rsplit("/", 1)[-1] else ""
    if kind not in kinds:
        raise ValueError(f"{path}: expected one of {', '.join(kinds)}")
    return kind
