"""End-labelled reads: seven tab-separated columns chrom index, position, length,
strand, label string, source index, weight; ``#C i name`` and ``#S i name`` lines
number chroms and sources.

The label string alternates labels and lengths: block, gap, block ... between the end
labels; a gap whose label pair is AD or DA is a splice. Lower-case end labels mark
condensed reads; C is a capped start, S a start, E an end.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.intervals import node_labels, normal_flags

STRANDS = {"+": 1, "-": -1, ".": 0}


def strand_number(s: Column) -> Column:
    return F.when(s == "+", 1).when(s == "-", -1).otherwise(0).cast("tinyint")


def strand_sign(n: Column) -> Column:
    return F.when(n == 1, "+").when(n == -1, "-").otherwise(".")


def weights(text: Column) -> dict[str, Column]:
    """weight or weight|start|end."""
    part = F.split(text, r"\|")
    return {"weight": part[0].cast("double"), "s_weight": F.try_element_at(part, F.lit(2)).cast("double"), "e_weight": F.try_element_at(part, F.lit(3)).cast("double")}


def parse_labels(df: DataFrame, left: str = "left", labels: str = "elcigar", strand: str = "strand") -> DataFrame:
    """df with ranges, splice and flags of its label strings."""
    s = F.col(labels)
    names = F.regexp_extract_all(s, F.lit(r"([A-Za-z.<>])"), F.lit(1))
    lengths = F.transform(F.regexp_extract_all(s, F.lit(r"(-?\d+)"), F.lit(1)), lambda x: x.cast("int"))
    start = F.struct(F.col(left).cast("int").alias("at"), F.lit(0).alias("i"), F.expr("cast(array() as array<struct<l:int,r:int>>)").alias("b"))
    walk = lambda a, n: F.struct((a["at"] + n).alias("at"), (a["i"] + 1).alias("i"), F.when(a["i"] % 2 == 0, F.concat(a["b"], F.array(F.struct(a["at"].alias("l"), (a["at"] + n).alias("r"))))).otherwise(a["b"]).alias("b"))
    # one block needs no walk
    single = s.rlike(r"^[A-Za-z.<>]-?\d{1,9}[A-Za-z.<>]$")
    at, size = F.col(left).cast("int"), F.substring(s, F.lit(2), F.length(s) - 2).try_cast("int")
    one = F.array(F.struct(at.alias("l"), (at + size).alias("r")))
    df = df.withColumn("__n", F.when(single, F.array(F.left(s, F.lit(1)), F.right(s, F.lit(1)))).otherwise(names))
    df = df.withColumn("ranges", F.when(single, one).otherwise(F.aggregate(lengths, start, walk)["b"]))
    inner = F.slice(F.col("__n"), 2, F.greatest(F.size("__n") - 2, F.lit(0)))
    pairs = F.when(F.size(inner) > 1, F.transform(F.sequence(F.lit(0), F.size(inner) - 2, F.lit(2)), lambda i: F.get(inner, i).isin("A", "D"))).otherwise(F.expr("cast(array() as array<boolean>)"))
    first, last = F.get("__n", F.lit(0)), F.element_at("__n", -1)
    five, three = F.when(F.col(strand) == -1, last).otherwise(first), F.when(F.col(strand) == -1, first).otherwise(last)
    df = df.withColumns({
        "splice": pairs, "s_tag": F.upper(five).isin("S", "C"), "capped": F.upper(five) == "C", "e_tag": F.upper(three) == "E",
        "condensed": first.isin("s", "c", "e") | last.isin("s", "c", "e"), "right": F.element_at("ranges", -1)["r"],
    })
    return normal_flags(df).drop("__n")


def header(lines: DataFrame, mark: str) -> DataFrame:
    """id, name of the #C or #S lines."""
    part = F.split("value", r"[ \t]+")
    return lines.where(F.col("value").startswith(f"#{mark}")).select(part[1].cast("int").alias("id"), part[2].alias("name")).distinct()


def parse(lines: DataFrame) -> DataFrame:
    """Reads of lines(value); lines that are no reads have _corrupt_record instead."""
    p = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("__p", p)
    good = (F.size("__p") == 7) & F.get("__p", F.lit(1)).rlike(r"^-?\d+$") & F.get("__p", F.lit(4)).rlike(r"^[SCE.<>sce]-?\d+([AD.]-?\d+[AD.]-?\d+)*[SCE.<>sce]$")
    cell = lambda i: F.get("__p", F.lit(i))
    out = rows.select(
        F.when(good, cell(0).cast("int")).alias("c"), F.when(good, cell(5).cast("int")).alias("s"), F.when(good, cell(1).cast("int")).alias("left"),
        strand_number(cell(3)).alias("strand"), F.when(good, cell(4)).alias("elcigar"), *[F.when(good, w).alias(k) for k, w in weights(F.coalesce(cell(6), F.lit(""))).items()],
        F.when(~F.coalesce(good, F.lit(False)), F.col("value")).alias("_corrupt_record"),
    )
    chroms, sources = header(lines, "C").withColumnsRenamed({"id": "c", "name": "chrom"}), header(lines, "S").withColumnsRenamed({"id": "s", "name": "source"})
    named = out.join(F.broadcast(chroms), "c", "left").join(F.broadcast(sources), "s", "left")
    return parse_labels(named).drop("c", "s")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def label_string(ranges: Column, splice: Column, s_tag: Column, e_tag: Column, capped: Column, condensed: Column, strand: Column) -> Column:
    ends = node_labels(s_tag, e_tag, capped, condensed, strand)
    sizes = F.transform(ranges, lambda x: (x["r"] - x["l"]).cast("string"))
    n = F.size(ranges)
    gap = F.when(n > 1, F.zip_with(F.slice(ranges, 1, n - 1), F.slice(ranges, 2, n - 1), lambda a, b: (b["l"] - a["r"]).cast("string")))
    pair = F.when(strand == -1, F.lit("A|D")).otherwise(F.lit("D|A"))
    marked = F.zip_with(gap, splice, lambda g, s: F.when(s, F.concat(F.split(pair, r"\|")[0], g, F.split(pair, r"\|")[1])).otherwise(F.concat(F.lit("."), g, F.lit("."))))
    body = F.array_join(F.zip_with(sizes, F.coalesce(marked, F.expr("cast(array() as array<string>)")), lambda s, g: F.concat(s, F.coalesce(g, F.lit("")))), "")
    only = (ranges[0]["r"] - ranges[0]["l"]).cast("string")
    return F.concat(F.substring(ends, 1, 1), F.when(n == 1, only).otherwise(body), F.substring(ends, 2, 1))


def weight_text(w: Column) -> Column:
    """Two decimals without trailing zeros, and never an exponent."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.bround(w, 2)), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def lines(reads: DataFrame) -> DataFrame:
    """value: the header and read lines, in file order."""
    from strandloom.operators.collapse import dictionary, strand_order

    c, s = dictionary(reads, "chrom"), dictionary(reads, "source")
    triple = F.when((F.coalesce("s_weight", F.lit(0.0)) != 0) | (F.coalesce("e_weight", F.lit(0.0)) != 0), F.concat_ws("|", weight_text(F.col("weight")), weight_text(F.coalesce("s_weight", F.lit(0.0))), weight_text(F.coalesce("e_weight", F.lit(0.0))))).otherwise(weight_text(F.col("weight")))
    label = label_string(*[F.col(x) for x in ("ranges", "splice", "s_tag", "e_tag", "capped", "condensed", "strand")])
    rows = reads.join(F.broadcast(c.withColumnsRenamed({"id": "__c", "name": "chrom"})), "chrom").join(F.broadcast(s.withColumnsRenamed({"id": "__s", "name": "source"})), "source")
    body = rows.select(F.lit(2).alias("k"), F.col("__c").alias("a"), F.col("left").cast("long").alias("b"), (F.col("right") - F.col("left")).alias("n"), strand_order(F.col("strand")).alias("o"), F.concat_ws("\t", "__c", "left", F.col("right") - F.col("left"), strand_sign(F.col("strand")), label, "__s", triple).alias("value"))
    head = lambda df, m, k: df.select(F.lit(k).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("n"), F.lit(0).alias("o"), F.concat_ws(" ", F.lit(f"#{m}"), "id", "name").alias("value"))
    return head(c, "C", 0).union(head(s, "S", 1)).union(body).orderBy("k", "a", "b", "n", "o", "value").select("value")


def write(reads: DataFrame, path: str) -> None:
    lines(reads).write.text(path)


def subset(reads: DataFrame, region: str) -> DataFrame:
    """Reads that overlap chrom:start-end (or a whole chrom)."""
    chrom, _, span = region.partition(":")
    out = reads.where(F.col("chrom") == chrom)
    if span:
        start, _, end = span.replace(",", "").partition("-")
        out = out.where((F.col("left") < int(end)) & (F.col("right") > int(start)))
    return out
