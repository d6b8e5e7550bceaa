"""Merging assemblies: transcripts of several sources become one set, named after a
reference where they match one. Within a locus the fold is by falling support."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.grouped import per_group
from strandloom.operators.islands import annotation_loci


@dataclass(frozen=True)
class Options:
    end_buffer: int = 100
    min_length: int = 100
    rep_filter: int = 1
    tpm_filter: float = 1.0
    confidence: float = 3.0
    cap_percent: float = 0.0
    min_terminal: int = 0
    min_start: float = 0.0
    min_end: float = 0.0
    allow_unstranded: bool = False
    discard: tuple[str, ...] = ("ambiguous",)
    keep_best: bool = False


# Counts of a transcript's members that are summed, where assemblies have them.
COUNTS = ("s_reads", "s_capped", "e_reads")


def support(ranges: list, weight: float) -> float:
    """Covered length x weight x exons of 20 bases or more."""
    return sum(r - l for l, r in ranges) * weight * sum(r - l >= 20 for l, r in ranges)


def same_transcript(a, b, o: Options) -> bool:
    """Equal introns and strand, ends within the buffer."""
    gaps = lambda x: [(p[1], q[0]) for p, q in zip(x, x[1:], strict=False)]
    return a["strand"] == b["strand"] and gaps(a["ranges"]) == gaps(b["ranges"]) and abs(a["ranges"][0][0] - b["ranges"][0][0]) <= o.end_buffer and abs(a["ranges"][-1][1] - b["ranges"][-1][1]) <= o.end_buffer


def fold(rows: list[dict], o: Options) -> list[dict]:
    """One entry per distinct transcript: summed weight and TPM, distinct sources as
    reps, ends from the best supported member."""
    out: list[dict] = []
    for t in sorted(rows, key=lambda t: (-support(t["ranges"], t["weight"]), t["ranges"], t["transcript_id"])):
        mine = next((x for x in out if same_transcript(x, t, o)), None)
        if mine is None:
            out.append(t | {"sources": {t["source"]}, "members": [t["transcript_id"]]})
        else:
            mine["weight"] += t["weight"]
            mine["TPM"] += t["TPM"]
            for c in COUNTS:
                mine[c] = t[c] if mine[c] is None else mine[c] + (t[c] or 0)
            mine["robust"] = mine["robust"] or t["robust"]
            mine["sources"].add(t["source"])
            mine["members"].append(t["transcript_id"])
    return out


def named(found: list[dict], refs: list[dict], o: Options) -> list[dict]:
    """Reference names for matches; others are isoforms of the gene they share bases
    with (.i<n>), antisense to one (-AS), inside one's intron (-IT), or new."""
    shared = lambda a, b: sum(max(0, min(r, y) - max(l, x)) for l, r in a for x, y in b) if a[-1][1] > b[0][0] and b[-1][1] > a[0][0] else 0
    used: dict[str, int] = {}
    for t in found:
        match = next((r for r in refs if same_transcript(t, r, o)), None)
        t["class"], t["gene_id"] = "new", None
        if match:
            t |= {"class": "full_match", "gene_id": match["gene_id"], "name": match["transcript_id"]}
            continue
        over = sorted(((shared(t["ranges"], r["ranges"]), r["strand"] == t["strand"], r["gene_id"]) for r in refs), reverse=True)
        sense = next((x for x in over if x[0] > 0 and x[1]), None)
        anti = next((x for x in over if x[0] > 0 and not x[1]), None)
        within = next((r for r in refs if r["ranges"][0][0] <= t["ranges"][0][0] and r["ranges"][-1][1] >= t["ranges"][-1][1]), None)
        kind, gene = ("isoform", sense[2]) if sense else ("antisense", anti[2] + "-AS") if anti else ("intronic", within["gene_id"] + "-IT") if within else ("new", None)
        t["class"], t["gene_id"] = kind, gene
        if gene:
            used[gene] = used.get(gene, 0) + 1
            t["name"] = f"{gene}.i{used[gene]}"
    return found


def reject(t: dict, o: Options) -> str | None:
    """Why a merged transcript does not pass, or None. Structures that assemblers get
    wrong need more support by the confidence factor; counts that are not given pass."""
    kind = t["class"]
    factor = o.confidence if kind in ("fragment", "fusion", "retained_intron") or t.get("noncanonical") else 1
    reps = 1 if t["robust"] else o.rep_filter
    starts = o.min_start if t["s_reads"] is None else t["s_reads"]
    ends = o.min_end if t["e_reads"] is None else t["e_reads"]
    suspect = kind in ("fragment", "alt_tss", "antisense")
    terminal = min(t["ranges"][0][1] - t["ranges"][0][0], t["ranges"][-1][1] - t["ranges"][-1][0])
    rules = (
        ("class", kind in o.discard),
        ("reps", len(t["sources"]) < reps * factor),
        ("unstranded", not o.allow_unstranded and t["strand"] == 0),
        ("length", sum(r - l for l, r in t["ranges"]) < o.min_length),
        ("terminal exon", terminal < o.min_terminal and len(t["sources"]) < reps * o.confidence),
        ("TPM", t["TPM"] < o.tpm_filter * factor),
        ("caps", suspect and (t["s_capped"] or 0) / (1 if t["s_reads"] is None else t["s_reads"] or 1) < o.cap_percent),
        ("starts", starts < o.min_start * (o.confidence if suspect and t["s_reads"] is not None else 1)),
        ("ends", ends < o.min_end * (o.confidence if kind == "alt_pas" and t["e_reads"] is not None else 1)),
    )
    return next((name for name, fails in rules if fails), None)


SCHEMA = "chrom string, locus bigint, found array<struct<name:string,gene_id:string,class:string,strand:int,ranges:array<struct<l:int,r:int>>,weight:double,TPM:double,reps:int,members:array<string>,reject_reason:string,n:int>>"


def merge(assemblies: DataFrame, reference: DataFrame, options: Options = Options()) -> DataFrame:
    """assemblies(chrom, strand, ranges, weight, TPM, source, transcript_id) and
    reference(chrom, strand, ranges, gene_id, transcript_id): merged transcripts with
    the reason for which a filter rejects them; assemblies may have s_reads, s_capped,
    e_reads and robust. New genes are numbered at the end."""
    cols = ["chrom", "strand", "ranges", "transcript_id"]
    given = lambda c, kind: (F.col(c) if c in assemblies.columns else F.lit(None)).cast(kind).alias(c)
    counts = [given(c, "double") for c in COUNTS] + [F.coalesce(given("robust", "boolean"), F.lit(False)).alias("robust")]
    none = [F.lit(None).cast("double").alias(c) for c in COUNTS] + [F.lit(False).alias("robust")]
    a = assemblies.select(*cols, "weight", "TPM", "source", *counts, F.lit(None).cast("string").alias("gene_id"), F.lit(False).alias("is_reference"))
    b = reference.select(*cols, F.lit(0.0).alias("weight"), F.lit(0.0).alias("TPM"), F.lit("reference").alias("source"), *none, F.col("gene_id").cast("string"), F.lit(True).alias("is_reference"))
    both = a.unionByName(b).withColumns({"left": F.col("ranges")[0]["l"], "right": F.element_at("ranges", -1)["r"], "chrom": F.col("chrom").cast("string")})
    chunks = annotation_loci(both)

    def run(key, rows):
        refs = sorted((r for r in rows if r["is_reference"]), key=lambda r: (r["ranges"], r["transcript_id"]))
        found = named(fold([r for r in rows if not r["is_reference"]], options), refs, options)
        if options.keep_best:
            found = found[:1]
        for known in (False, True):
            group = sorted((t for t in found if (t["gene_id"] is not None) == known), key=lambda t: (t["ranges"], t["strand"]))
            for n, t in enumerate(group, 1):
                t["n"] = n
        found = [
            {"name": t.get("name"), "gene_id": t["gene_id"], "class": t["class"], "strand": int(t["strand"]), "ranges": t["ranges"],
             "weight": t["weight"], "TPM": t["TPM"], "reps": len(t["sources"]), "members": t["members"], "reject_reason": reject(t, options), "n": t["n"]}
            for t in found
        ]
        return [{"chrom": str(key[0]), "locus": key[1], "found": found}] if found else []

    # A row per locus, dealt once: numbers and transcripts read the same shuffle, so the
    # function runs once. Both need whole rows and no filter of their own, or Spark would
    # plan the function anew for each.
    out = per_group(chunks, ["chrom", "locus"], run, SCHEMA).where("chrom is not null and locus is not null").repartition("chrom", "locus")
    # new genes: numbered within chroms, after those of the chroms before
    fresh = out.select("chrom", "locus", F.exists("found", lambda t: t["gene_id"].isNull()).cast("long").alias("fresh"))
    ahead = _before(fresh.groupBy("chrom").agg(F.sum("fresh").alias("fresh")))
    g = F.sum("fresh").over(Window.partitionBy("chrom").orderBy("locus"))
    numbers = fresh.withColumn("g", g).join(ahead, "chrom").select("chrom", "locus", F.when(F.col("fresh") == 1, F.col("g") + F.col("o")).alias("g"))
    own = F.concat(F.lit("NEW-"), "g")
    named_ = out.join(numbers, ["chrom", "locus"], "left").select("chrom", "locus", "g", F.inline_outer("found"))
    return named_.withColumns({"name": F.coalesce("name", F.concat(own, F.lit(".i"), "n")), "gene_id": F.coalesce("gene_id", own)}).drop("g", "n")


def _before(counts: DataFrame) -> DataFrame:
    """chrom, o: the sum of fresh over the chroms before; by the first letters of chroms, so
    that no task orders them all."""
    counts = counts.withColumn("__k", F.coalesce(F.substring("chrom", 1, 3), F.lit("")))
    groups = counts.groupBy("__k").agg(F.sum("fresh").alias("__n")).select("__k", (F.sum("__n").over(Window.orderBy("__k")) - F.col("__n")).alias("__o"))
    inside = F.sum("fresh").over(Window.partitionBy("__k").orderBy("chrom")) - F.col("fresh")
    return counts.withColumn("__i", inside).join(groups, "__k").select("chrom", (F.col("__o") + F.col("__i")).alias("o"))


def simulate(transcripts: DataFrame, n: int, seed: int = 0, jitter: float = 10.0) -> DataFrame:
    """n fragments of transcripts drawn by weight, with normal end jitter: each row
    draws its own count, so nothing is gathered."""
    total = transcripts.agg(F.sum("weight").alias("__t"))
    drawn = transcripts.join(F.broadcast(total)).withColumn("__k", F.floor(F.lit(n) * F.col("weight") / F.col("__t") + F.rand(seed)).cast("int")).where("__k > 0")
    each = drawn.select("*", F.explode(F.sequence(F.lit(1), "__k")).alias("__i"))
    a, b = F.rint(F.abs(F.randn(seed + 1)) * jitter).cast("int"), F.rint(F.abs(F.randn(seed + 2)) * jitter).cast("int")
    first, last = F.col("ranges")[0], F.element_at("ranges", -1)
    l = F.least(first["l"] + a, first["r"] - 1)
    one = F.array(F.struct(l.alias("l"), F.greatest(l + 1, last["r"] - b).alias("r")))
    cut = F.concat(F.array(F.struct(l.alias("l"), first["r"].alias("r"))), F.slice("ranges", 2, F.greatest(F.size("ranges") - 2, F.lit(0))), F.array(F.struct(last["l"].alias("l"), F.greatest(last["l"] + 1, last["r"] - b).alias("r"))))
    return each.withColumn("ranges", F.when(F.size("ranges") == 1, one).otherwise(cut)).drop("__k", "__i", "__t")
