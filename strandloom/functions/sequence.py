"""Nucleotide sequence functions as JVM expressions."""

import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# IUPAC nucleotide codes, their complements and the bases they stand for.
IUPAC = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
COMPLEMENT = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"
BASES = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}
# The standard genetic code, codons in the order TCAG of each place.
ORDER, AMINO_ACIDS = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# Splice motifs (donor + acceptor) and their codes.
MOTIFS = {"GTAG": 1, "CTAC": 2, "GCAG": 3, "CTGC": 4, "ATAC": 5, "GTAT": 6}
PLUS_MOTIFS, MINUS_MOTIFS = ("GTAG", "GCAG", "ATAC", "GAAG"), ("CTAC", "CTGC", "GTAT", "CTTC")

CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(ORDER) for j, b in enumerate(ORDER) for k, c in enumerate(ORDER)}


def translate_codon(codon: str) -> str:
    """The amino acid of a codon; ambiguous codons have one if all their readings
    agree, else X; shorter strings have none."""
    codon = codon.upper().replace("U", "T")
    if len(codon) < 3:
        return ""
    found = {CODONS[x + y + z] for x in BASES.get(codon[0], "") for y in BASES.get(codon[1], "") for z in BASES.get(codon[2], "")}
    return found.pop() if len(found) == 1 else "X"


CODES = "ACGTMRWSYKVHDBN"


@cache
def _codon_table() -> tuple[np.ndarray, np.ndarray]:
    """The place of each byte among CODES (0 for other letters), and the amino acids of
    all triples of places."""
    place = np.zeros(256, np.int64)
    for i, c in enumerate(CODES, 1):
        place[[ord(c), ord(c.lower())]] = i
    place[[ord("U"), ord("u")]] = place[ord("T")]
    letters = " " + CODES
    return place, np.frombuffer("".join(translate_codon(a + b + c) for a in letters for b in letters for c in letters).encode(), np.uint8)


def translate_text(s: str) -> str:
    """The amino acids of the codons of a sequence; X for what can't be read."""
    place, acids = _codon_table()
    n = len(s) // 3
    p = place[np.frombuffer(s[: 3 * n].encode("latin-1", "replace"), np.uint8)].reshape(n, 3)
    return acids[(p[:, 0] * 16 + p[:, 1]) * 16 + p[:, 2]].tobytes().decode()


def complement(s: Column) -> Column:
    return F.translate(s, IUPAC, COMPLEMENT)


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def base_count(s: Column, base: str) -> Column:
    return F.length(s) - F.length(F.translate(s, base, ""))


def is_homopolymer(s: Column, share: float = 0.8) -> Column:
    """One base makes at least share of the sequence; true of the empty one."""
    most = F.greatest(*[base_count(s, b) for b in "ACGT"])
    return (F.length(s) == 0) | (most >= F.length(s) * share)


def mean_quality(q: Column) -> Column:
    """Mean Phred score of a quality string (offset 33)."""
    scores = F.transform(F.split(q, ""), lambda c: F.ascii(c) - 33)
    return F.aggregate(scores, F.lit(0), lambda a, x: a + x) / F.length(q)


def to_regex(s: Column) -> Column:
    """IUPAC letters as character classes."""
    out = F.upper(s)
    for code, bases in BASES.items():
        if len(bases) > 1 or code == "U":
            out = F.replace(out, F.lit(code), F.lit(f"[{bases.lower()}]" if len(bases) > 1 else "t"))
    return F.upper(out)


def masks(s: Column) -> Column:
    """Bit masks of bases: A 1, C 2, G 4, T 8; other letters 0."""
    bits = {code: sum(1 << "ACGT".index(b) for b in bases) for code, bases in BASES.items()}
    code = F.create_map(*[x for k, v in bits.items() for x in (F.lit(k), F.lit(v))])
    letters = F.filter(F.split(F.upper(s), ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.coalesce(F.try_element_at(code, c), F.lit(0)))


def iupac_hamming(a: Column, b: Column) -> Column:
    """Places whose base sets are disjoint; -1 for equal strings and for unequal lengths."""
    apart = F.aggregate(F.zip_with(masks(a), masks(b), lambda x, y: F.when(x.bitwiseAND(y) == 0, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when((a == b) | (F.length(a) != F.length(b)), -1).otherwise(apart)


def translate(s: Column) -> Column:
    """translate_text of a column, by Arrow batches."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(translate_text, na_action="ignore")

    return run(s)


def motif_code(donor: Column, acceptor: Column) -> Column:
    out = F.lit(0)
    for motif, code in MOTIFS.items():
        out = F.when(F.upper(F.concat(donor, acceptor)) == motif, code).otherwise(out)
    return out


def motif_strand(donor: Column, acceptor: Column) -> Column:
    m = F.upper(F.concat(donor, acceptor))
    return F.when(m.isin(*PLUS_MOTIFS), 1).when(m.isin(*MINUS_MOTIFS), -1).otherwise(0)


def read_tag(name: Column) -> Column:
    """The lengths of the end labels in a read name's _TAG=S<n>E<n>."""
    part = lambda k: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(name, rf"_TAG=(?:[A-Z]\d+)*{k}(\d+)", 1), F.lit("")), F.lit("999999")).cast("int"), F.lit(0))
    return F.struct(part("S").alias("s"), part("E").alias("e"), part("C").alias("c"))


def reading_frames(s: str, startless: bool = False, stopless: bool = False, min_aa: int = 10) -> list[tuple]:
    """(frame, start, end, aa, has_start, has_stop) of each open reading frame of more
    than min_aa amino acids in three forward frames; the span holds the stop codon."""
    out = []
    for frame in range(3):
        protein = translate_text(s[frame:])
        for m in re.finditer(r"[^*]+", protein):
            first = m.start() if startless and not m.start() else protein.find("M", m.start(), m.end())
            stop = m.end() < len(protein)
            if first < 0 or m.end() - first <= min_aa or not (stop or stopless):
                continue
            aa = protein[first : m.end()]
            out.append((frame, frame + 3 * first, frame + 3 * (m.end() + stop), aa, aa[0] == "M", stop))
    return out


def orfs(df: DataFrame, seq: str = "seq", startless: bool = False, stopless: bool = False, min_aa: int = 10) -> DataFrame:
    """df without seq and with orf, the fields of ``reading_frames``."""
    fields = "frame int, start int, end int, aa string, has_start boolean, has_stop boolean"

    def find(x: pd.Series) -> pd.Series:
        names = [f.split()[0] for f in fields.split(", ")]
        return x.map(lambda s: [dict(zip(names, r, strict=True)) for r in reading_frames(s or "", startless, stopless, min_aa)])

    found = F.pandas_udf(find, "array<struct<" + fields.replace(" ", ":").replace(",:", ",") + ">>")
    return df.select(*[c for c in df.columns if c != seq], F.explode(found(F.col(seq))).alias("orf"))


def longest_orf(df: DataFrame, key: str, **how) -> DataFrame:
    found = orfs(df.select(key, how.get("seq", "seq")), **how)
    return found.groupBy(key).agg(F.max_by("orf", F.struct(F.length("orf.aa"), -F.col("orf.start"))).alias("orf"))


def first_orf(df: DataFrame, key: str, **how) -> DataFrame:
    found = orfs(df.select(key, how.get("seq", "seq")), **how)
    return found.groupBy(key).agg(F.min_by("orf", F.col("orf.start")).alias("orf"))


def softmasked(genome: DataFrame, least: int = 1, most: int = 1 << 30) -> DataFrame:
    """chrom, start, end of lower-case runs."""
    pieces = F.regexp_extract_all("seq", F.lit("([a-z]+|[^a-z]+)"), F.lit(1))
    ends = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,low:boolean>>)").alias("all")), lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.concat(a["all"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(x)).alias("end"), F.rlike(x, F.lit("^[a-z]")).alias("low")))).alias("all")))["all"]
    return genome.select("chrom", F.inline(ends)).where("low").drop("low").where((F.col("end") - F.col("start")).between(least, most))


def transcript_sequence(transcripts: DataFrame, genome: DataFrame) -> DataFrame:
    """transcripts with cdna: joined exons, reverse-complemented on the minus strand,
    lower case without a strand."""
    from strandloom.operators.joins import with_pieces

    joined = with_pieces(transcripts, genome, F.col("ranges"), "__exons")
    exons = F.array_join("__exons", "")
    cdna = F.when(F.col("strand") == -1, reverse_complement(exons)).when(F.col("strand") == 0, F.lower(exons)).otherwise(exons)
    return joined.withColumn("cdna", cdna).drop("__exons")


def register(spark: SparkSession) -> None:
    """SQL functions of the same meaning: rc(s), complement_dna(s), translate_dna(s),
    orfs(s) (rows), elcigar_parse(s) (label and length pairs of a label string), and
    interval_union(blocks)."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION complement_dna(s STRING) RETURNS STRING RETURN translate(s, '{IUPAC}', '{COMPLEMENT}')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rc(s STRING) RETURNS STRING RETURN reverse(translate(s, '{IUPAC}', '{COMPLEMENT}'))")
    spark.udf.register("translate_dna", F.pandas_udf(lambda x: x.map(translate_text, na_action="ignore"), "string", F.PandasUDFType.SCALAR))

    @F.udtf(returnType="frame: int, start: int, end: int, aa: string, has_start: boolean, has_stop: boolean")
    class Orfs:
        def eval(self, s: str):
            yield from reading_frames(s or "")

    spark.udtf.register("orfs", Orfs)
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION elcigar_parse(s STRING) RETURNS ARRAY<STRUCT<label: STRING, length: INT>>
      RETURN transform(regexp_extract_all(s, '([A-Za-z.<>])(-?\\d+)?', 0), x -> named_struct('label', left(x, 1), 'length', try_cast(substr(x, 2) AS INT)))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION interval_union(b ARRAY<STRUCT<l: INT, r: INT>>) RETURNS ARRAY<STRUCT<l: INT, r: INT>>
      RETURN aggregate(array_sort(b), cast(array() AS ARRAY<STRUCT<l: INT, r: INT>>), (a, x) -> CASE WHEN size(a) = 0 THEN array(x)
        WHEN x.l <= element_at(a, -1).r THEN concat(slice(a, 1, size(a) - 1), array(named_struct('l', element_at(a, -1).l, 'r', greatest(element_at(a, -1).r, x.r)))) ELSE concat(a, array(x)) END)""")
