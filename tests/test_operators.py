import random

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import adapters, sequence
from strandloom.operators import alignments, assembly, classify, coverage, intervals, islands, joins, merge
from strandloom.plans import views
from strandloom.streaming import loci as streaming

DIR = "/root/testdata/sf0.001"
B = "array<struct<l:int,r:int>>"


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def blocks(*pairs):
    return F.array(*[F.struct(F.lit(l).alias("l"), F.lit(r).alias("r")) for l, r in pairs])


def test_intervals(spark):
    a = blocks((10, 20), (30, 40), (60, 70))
    r = one(
        spark, gaps=intervals.gaps(a), none=intervals.gaps(blocks((1, 2))), n=intervals.covered_length(a), u=intervals.collapse_blocks(blocks((5, 9), (1, 3), (3, 4), (8, 12))), apart=intervals.collapse_blocks(blocks((1, 3), (3, 4)), False),
        plus=intervals.shorten_to(a, F.lit(15), F.lit(1)), minus=intervals.shorten_to(a, F.lit(15), F.lit(-1)), sh=intervals.shift_by(a, F.lit(5), F.lit(-1)), runs=intervals.array_runs(F.array(*[F.lit(x) for x in (1, 2, 3, 7, 9, 10)])),
        j=intervals.junctions(a, F.array(F.lit(True), F.lit(False))), bad=intervals.malformed(blocks((5, 5))), closed=intervals.overlaps(F.lit(1), F.lit(5), F.lit(5), F.lit(9)), sb=intervals.shared_bases(a, blocks((15, 35))),
        ok=intervals.compatible(a, blocks((32, 40), (60, 65))), clash=intervals.compatible(a, blocks((15, 35))), sm=intervals.splice_match(a, blocks((5, 20), (30, 40), (60, 90))), lab=intervals.node_labels(F.lit(True), F.lit(True), F.lit(True), F.lit(True), F.lit(-1)),
    )
    t = lambda x: [tuple(y) for y in x]
    assert t(r.gaps) == [(20, 30), (40, 60)] and r.none == [] and r.n == 30 and t(r.u) == [(1, 4), (5, 12)] and t(r.apart) == [(1, 3), (3, 4)]
    assert t(r.plus) == [(10, 20), (30, 35)] and t(r.minus) == [(35, 40), (60, 70)] and t(r.sh) == [(5, 20), (30, 40), (60, 65)] and t(r.runs) == [(1, 3), (7, 7), (9, 10)]
    assert t(r.j) == [(20, 30)] and r.bad and r.closed and r.sb == 10 and r.ok and not r.clash and r.sm and r.lab == "ec"


def test_shift_by_moves_the_ends_along_the_blocks(spark):
    r = random.Random(4)
    for _ in range(12):
        edges = sorted(r.sample(range(400), 2 * r.randrange(1, 5)))
        pairs = list(zip(edges[::2], edges[1::2], strict=True))
        bases = [p for a, b in pairs for p in range(a, b)]
        for d in (-r.randrange(1, len(bases) + 1), 0, r.randrange(1, len(bases) + 1)):
            grown = bases + [bases[-1] + 1 + i for i in range(d)] if d >= 0 else [bases[0] - 1 - i for i in range(-d)][::-1] + bases
            want = grown[d:] if d >= 0 else grown[: len(bases)]
            got = one(spark, x=intervals.shift_by(blocks(*pairs), F.lit(d), F.lit(1)), y=intervals.shift_by(blocks(*pairs), F.lit(-d), F.lit(-1)), z=intervals.shift_by(blocks(*pairs), F.lit(d), F.lit(0)))
            assert [p for a, b in got.x for p in range(a, b)] == want and got.x == got.y and [tuple(p) for p in got.z] == pairs


def test_ends_clash(spark):
    no, yes = F.lit(False), F.lit(True)
    span = lambda l, r: (F.lit(l), F.lit(r))
    clash = lambda s, a, b: one(spark, x=intervals.ends_clash(F.lit(s), *a, F.lit(s), *b)).x
    start, end, none = (yes, no), (no, yes), (no, no)
    assert clash(1, (*start, *span(5, 9)), (*none, *span(3, 9))) and not clash(1, (*start, *span(3, 9)), (*none, *span(5, 12)))
    assert clash(1, (*none, *span(5, 12)), (*end, *span(3, 9))) and not clash(1, (*end, *span(5, 12)), (*start, *span(3, 9)))
    assert clash(-1, (*start, *span(3, 9)), (*none, *span(3, 10))) and clash(-1, (*end, *span(5, 9)), (*none, *span(3, 9)))
    assert not clash(0, (*start, *span(5, 9)), (*none, *span(3, 9)))
    assert one(spark, x=intervals.ends_clash(F.lit(1), *none, *span(1, 2), F.lit(-1), *none, *span(1, 2))).x


def test_breaks_at_the_gap(spark):
    rows = spark.createDataFrame([("c", 0, 10), ("c", 60, 70), ("c", 119, 130), ("d", 5, 6)], "chrom string, left int, right int")
    for stripe in (None, 25):
        got = sorted((r.chrom, r.left, r.locus) for r in islands.loci(rows, 50, stripe=stripe).collect())
        assert got == [("c", 0, 1), ("c", 60, 2), ("c", 119, 2), ("d", 5, 1)]
    touch = spark.createDataFrame([("c", 0, 10), ("c", 10, 20), ("c", 21, 22)], "chrom string, left int, right int")
    assert sorted((r.left, r.locus) for r in islands.annotation_loci(touch).collect()) == [(0, 1), (10, 1), (21, 2)]


@pytest.mark.parametrize("gap, touch", [(0, False), (0, True), (7, False)])
def test_striped_islands_are_those_of_whole_chroms(spark, gap, touch):
    draw = random.Random(gap + touch)
    rows = [(c, l, l + draw.choice([0, 1, 3, 3, 9, 80]), i) for c in ("a", "b", None) for i, l in enumerate(draw.choices(range(-100, 900), k=150))] + [("c", -5, 400, 0), ("c", 401, 402, 1), ("c", 405, 409, 2)]
    df = spark.createDataFrame(rows, "chrom string, left int, right int, row int")
    want, got = (sorted(tuple(r) for r in islands.island_ids(df, ["chrom"], "left", "right", gap, touch, stripe=s).where("chrom is not null").collect()) for s in (None, 20))
    assert want == got
    # one join, and one sort of the rows per branch: a task holds them once
    plan = islands.island_ids(df, ["chrom"], "left", "right", gap, touch, stripe=20)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_grouped_rows_hold_blocks_as_tuples():
    from strandloom.operators.grouped import row_lists

    kind = pa.schema([("x", pa.int32()), ("b", pa.list_(pa.struct([("l", pa.int32()), ("r", pa.int32())])))])
    data = [{"x": 1, "b": [{"l": 1, "r": 2}, {"l": 5, "r": 9}]}, {"x": None, "b": None}, {"x": 3, "b": []}, {"x": 4, "b": [{"l": 7, "r": 8}]}]
    batch = pa.RecordBatch.from_pylist(data, kind)
    assert row_lists(batch) == [{"x": 1, "b": [(1, 2), (5, 9)]}, {"x": None, "b": None}, {"x": 3, "b": []}, {"x": 4, "b": [(7, 8)]}]
    assert row_lists(batch.slice(1)) == row_lists(batch)[1:]


def test_condense_deals_only_the_columns_it_needs_and_keeps_lone_reads(spark):
    rows = [("a", 1, [(0, 30)], True, True, 2.0), ("a", 1, [(10, 40)], True, False, 5.0), ("a", 1, [(10, 40)], True, False, 1.0), ("a", -1, [(500, 520), (600, 640)], True, True, 1.0), ("a", 0, [(900, 910)], False, False, -1.0)]
    df = spark.createDataFrame(rows, f"chrom string, strand int, ranges {B}, s_tag boolean, e_tag boolean, weight double")
    df = df.withColumns({"left": F.col("ranges")[0]["l"], "right": F.element_at("ranges", -1)["r"], "capped": F.lit(False), "splice": F.array_repeat(F.lit(True), F.size("ranges") - 1)})
    out = assembly.condense(df)
    got = sorted((r.strand, [tuple(b) for b in r.ranges], r.s_tag, r.e_tag, r.weight) for r in out.collect())
    assert got == [(-1, [(500, 520), (600, 640)], True, True, 1.0), (0, [(900, 910)], False, False, -1.0), (1, [(10, 30)], True, True, 2.0), (1, [(10, 40)], True, False, 6.0)]
    call = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line)
    assert "splice" not in call and "capped" not in call


def test_strands_without_both_ends_are_not_assembled(spark):
    row = lambda strand, l, s, e: ("a", strand, [(l, l + 200)], [], s, e, False, 5.0, l, l + 200)
    rows = [row(1, 0, True, False), row(1, 10, False, True), row(-1, 5, True, False), row(0, 8, False, False)]
    df = spark.createDataFrame(rows, f"chrom string, strand int, ranges {B}, splice array<boolean>, s_tag boolean, e_tag boolean, capped boolean, weight double, left int, right int")
    assert {r.strand for r in islands.assemblable(df).collect()} == {1, -1, 0}
    assert sorted(r.strand for r in islands.assemblable(df, whole=False).collect()) == [0, 1, 1]
    assert [(r.strand, r.left, r.right) for r in assembly.assemble(df).collect()] == [(1, 0, 210)]


def test_merge_runs_its_function_once_and_numbers_genes_over_chroms(spark):
    rows = [(c, 1, [(p, p + 30)], 1.0, 1.0, "s", f"{c}.{p}") for c in ("10", "2", "a", "100") for p in (500, 100)]
    df = spark.createDataFrame(rows, f"chrom string, strand int, ranges {B}, weight double, TPM double, source string, transcript_id string")
    ref = spark.createDataFrame([("2", 1, [(100, 130)], "G", "T")], f"chrom string, strand int, ranges {B}, gene_id string, transcript_id string")
    out = merge.merge(df, ref)
    got = {r.members[0]: r.name for r in out.collect()}
    assert got == {"10.100": "NEW-1.i1", "10.500": "NEW-2.i1", "100.100": "NEW-3.i1", "100.500": "NEW-4.i1", "2.100": "T", "2.500": "NEW-5.i1", "a.100": "NEW-6.i1", "a.500": "NEW-7.i1"}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and "ReusedExchange" in plan


def test_coverage_totals(spark):
    reads = views.reads(spark, DIR)
    total = reads.agg(F.sum(F.col("weight") * (F.col("right") - F.col("left")))).first()[0]
    for how in ({}, {"stripe": 3000}):
        assert coverage.coverage(reads, **how).agg(F.sum(F.col("value") * (F.col("end") - F.col("start")))).first()[0] == total
    both = coverage.inferred_strand_coverage(reads).agg(F.sum((F.col("plus") + F.col("minus")) * (F.col("end") - F.col("start")))).first()[0]
    assert both == pytest.approx(total)


def test_split_merge_and_low_runs(spark):
    reads = spark.createDataFrame([("c", 1, 0, [(0, 10), (500, 510)], [True]), ("c", 1, 1, [(20, 30)], []), ("c", 1, 2, [(900, 910)], [])], f"chrom string, locus int, row int, ranges {B}, splice array<boolean>")
    assert sorted((r.row, r.part) for r in islands.split_loci(reads, 50).collect()) == [(0, 1), (1, 1), (2, 2)]
    ends = spark.createDataFrame([("c", 1, "S", 0, 10, 5, "a"), ("c", 1, "S", 10, 20, 12, "b"), ("c", 1, "S", 30, 40, 35, "c")], "chrom string, strand int, kind string, left int, right int, peak int, name string")
    assert sorted((r.left, r.right, r.peak, r["name"]) for r in islands.merge_ends(ends).collect()) == [(0, 20, 5, "a_b"), (30, 40, 35, "c")]
    depth = spark.createDataFrame([("c", 0, 10, 5.0), ("c", 10, 30, 0.0), ("c", 30, 40, 4.0), ("c", 40, 90, 0.0)], "chrom string, start int, end int, value double")
    assert [(r.start, r.end) for r in islands.gaps_below(depth, 1.0, 19).collect()] == [(10, 30)]


def test_joins(spark):
    sj = spark.createDataFrame([(0, "c", 11, 21), (1, "c", 50, 60)], "row int, chrom string, start int, end int")
    known = spark.createDataFrame([("c", 10, 20), ("c", 12, 22)], "chrom string, start int, end int")
    got = {r.row: (r.start, r.end) for r in joins.shifted_junctions(sj, known, 2).collect()}
    assert got == {0: (12, 22), 1: (50, 60)}
    g = spark.createDataFrame([("c", "ACGTACGT")], "chrom string, seq string")
    assert joins.flanks(spark.createDataFrame([("c", 1)], "chrom string, pos int"), g, 3, 2).first().flank == "ACG"


def test_pieces_of_a_tiled_genome(spark):
    r = random.Random(8)
    text = {c: "".join(r.choice("ACGT") for _ in range(n)) for c, n in (("a", 100), ("b", 33), ("c", 0))}
    genome = spark.createDataFrame(list(text.items()), "chrom string, seq string")
    rows = [(i, r.choice("abcd"), [tuple(sorted((r.randrange(-3, 110), r.randrange(-3, 110)))) for _ in range(r.randrange(4))]) for i in range(30)]
    got = joins.with_pieces(spark.createDataFrame(rows, f"n int, chrom string, ranges {B}"), genome, F.col("ranges"), size=16)
    assert {x.n: list(x.pieces) for x in got.collect()} == {i: [text.get(c, "")[max(0, a) : max(0, z)] for a, z in p] for i, c, p in rows}


SEQ = st.text(sequence.IUPAC[:16], max_size=60)


def test_sequences(spark):
    aa = "ATGGCCTAA"
    r = one(
        spark, rc=sequence.reverse_complement(F.lit("ACGTNr")), u=sequence.complement(F.lit("U")), t=sequence.translate(F.lit("ATGGCNTAAXXXA")), h=sequence.iupac_hamming(F.lit("ACGT"), F.lit("RCCT")), e=sequence.iupac_hamming(F.lit("AC"), F.lit("AC")), empty=sequence.is_homopolymer(F.lit("")),
        hp=sequence.is_homopolymer(F.lit("AAAAC")), rx=sequence.to_regex(F.lit("ARN")), q=sequence.mean_quality(F.lit("I!")), tag=sequence.read_tag(F.lit("r1_TAG=S12E30")), m=sequence.motif_code(F.lit("CT"), F.lit("AC")), s=sequence.motif_strand(F.lit("gt"), F.lit("ag")),
    )
    assert r.rc == "yNACGT" and r.u == "A" and r.t == "MA*X" and r.h == 1 and r.e == -1 and r.empty and r.hp and r.rx == "A[AG][ACGT]" and r.q == 20.0 and tuple(r.tag)[:2] == (12, 30) and r.m == 2 and r.s == 1
    df = spark.createDataFrame([(1, "CC" + "ATG" + "GCC" * 12 + "TAA" + "GG"), (2, aa)], "id int, seq string")
    orf = {r.id: r.orf for r in sequence.longest_orf(df, "id").collect()}
    assert list(orf) == [1] and (orf[1].start, orf[1].end, orf[1].has_stop) == (2, 44, True) and orf[1].aa == "M" + "A" * 12
    soft = spark.createDataFrame([("c", "ACgtNNaaaG")], "chrom string, seq string")
    assert sorted((x.start, x.end) for x in sequence.softmasked(soft).collect()) == [(2, 4), (6, 9)]
    tr = spark.createDataFrame([("c", -1, [(0, 2), (4, 6)])], f"chrom string, strand int, ranges {B}")
    assert sequence.transcript_sequence(tr, spark.createDataFrame([("c", "AACCGGTT")], "chrom string, seq string")).first().cdna == "CCTT"
    sequence.register(spark)
    assert spark.sql("select rc('AACG')").first()[0] == "CGTT"
    assert spark.sql("select translate_dna('ATGTAA')").first()[0] == "M*"
    assert [x.start for x in spark.sql(f"select * from orfs('CCATG{'GCC' * 12}TAAGG')").collect()] == [2]
    assert [tuple(x) for x in spark.sql("select elcigar_parse('S50AD-20D30E')").first()[0]] == [("S", 50), ("A", None), ("D", -20), ("D", 30), ("E", None)]
    assert [tuple(x) for x in spark.sql("select interval_union(array(named_struct('l', 5, 'r', 9), named_struct('l', 1, 'r', 5)))").first()[0]] == [(1, 9)]


def test_presets_colours_and_merge_rules(spark):
    assert alignments.preset("ont")["stranded"] and not alignments.preset("Nanopore", untrimmed=True)["stranded"] and alignments.preset("smartseq2") == {"stranded": False, "trim_gaps": True}
    with pytest.raises(ValueError):
        alignments.preset("illumina")
    from strandloom.sources import tables

    codes = tables.parse_color_code(spark.createDataFrame([("SPE\t1,2,3",), ("bad",)], "value string"))
    assert [(x.key, x.color) for x in codes.collect()] == [("SPE", "1,2,3")]
    assert tables.with_colors(spark.createDataFrame([("SPE",), ("x",)], "k string"), codes, F.col("k")).where("color is null").count() == 1
    lines = tables.tsv(spark.createDataFrame([("a", 1.25, None)], "n string, v double, w int"), ["n", "v", "w"])
    assert sorted((x.place, x.value) for x in lines.collect()) == [(0, "n\tv\tw"), (1, "a\t1.3\tNA")]
    assert tables.check_extension("/x/a.GTF.gz", ("gtf", "bed")) == "gtf"
    with pytest.raises(ValueError):
        tables.check_extension("/x.d/a", ("gtf",))
    t = {"class": "isoform", "sources": {"a"}, "ranges": [(0, 100), (200, 230)], "TPM": 2.0, "strand": 1, "s_reads": 4.0, "s_capped": 1.0, "e_reads": 5.0, "robust": False}
    why = lambda change, **o: merge.reject(t | change, merge.Options(**o))
    assert why({}) is None and why({"strand": 0}) == "unstranded" and why({"strand": 0}, allow_unstranded=True) is None
    assert why({}, rep_filter=2) == "reps" and why({"robust": True}, rep_filter=2) is None and why({}, min_terminal=40) == "terminal exon"
    assert why({"class": "alt_tss"}, cap_percent=0.5) == "caps" and why({}, cap_percent=0.5) is None
    assert why({}, min_start=5) == "starts" and why({"class": "antisense"}, min_start=2) == "starts" and why({"s_reads": None}, min_start=5) is None
    assert why({"class": "alt_pas"}, min_end=2) == "ends" and why({}, min_end=2) is None
    assert why({"class": "fragment", "sources": set("abc")}) == "TPM" and why({"class": "fragment", "sources": set("abc"), "TPM": 3.0}) is None


def gaps_trimmed(ranges, splice):
    """Round by round: outer blocks go while a gap parts them from the rest."""
    left = right = False
    while splice and not (splice[0] and splice[-1]):
        if len(splice) == 1:
            best = max(range(2), key=lambda i: (ranges[i][1] - ranges[i][0], -i))
            return [ranges[best]], [], left or best == 1, right or best == 0
        if not splice[0]:
            ranges, splice, left = ranges[1:], splice[1:], True
        if splice and not splice[-1]:
            ranges, splice, right = ranges[:-1], splice[:-1], True
    return ranges, splice, left, right


def test_terminal_gaps(spark):
    r = random.Random(6)
    rows = []
    for n in range(60):
        edges = sorted(r.sample(range(300), 2 * r.randrange(1, 6)))
        pairs = list(zip(edges[::2], edges[1::2], strict=True))
        rows.append((n, pairs, [r.random() < 0.4 for _ in pairs[1:]]))
    got = spark.createDataFrame(rows, f"n int, ranges {B}, splice array<boolean>").select("n", alignments.trim_terminal_gaps(F.col("ranges"), F.col("splice")).alias("t"))
    assert {x.n: ([tuple(b) for b in x.t.ranges], x.t.splice, x.t.left_trim, x.t.right_trim) for x in got.collect()} == {n: gaps_trimmed(p, s) for n, p, s in rows}


def test_end_lines(spark):
    ends = spark.createDataFrame([("c", -1, "S", 3, 9, 5, "a_b")], "chrom string, strand int, kind string, left int, right int, peak int, name string")
    assert classify.end_lines(ends).first().value == "c\t3\t9\tSM:a_b\t5\t-"


def test_cap_filter():
    o = assembly.Options(cap_filter=0.1, min_start=0.5)
    through = lambda l, r: 10.0 if r > 100 else 1.0
    args = ({150: 150, 160: 150}, {150: 9.0, 160: 1.0}), [100, 140]
    keep = lambda caps, plain, cover=through, bounds=args[1]: assembly.capped_sites(*args[0], caps, plain, bounds, cover, 1, o)
    assert keep({}, {150: 9, 160: 1}) == {} and keep({160: 1}, {150: 9}) == args[0][0]
    assert keep({}, {150: 9}, bounds=[]) == args[0][0] and keep({}, {150: 9}, cover=lambda l, r: 0.0 if l < 150 else 9.0) == args[0][0]
    assert assembly.capped_sites({150: 150}, {150: 2.0}, {150: 2}, {}, [], through, 1, o) == {}


def test_adapters(spark):
    tso, dt = "ACATGGG", "CCATTTTTT+"
    body = "GATTACAGATTACACCGTGC"
    rc = lambda s: s.translate(adapters.RC)[::-1]
    q = lambda s: "I" * len(s)
    read = tso + body
    assert adapters.label_read(read, q(read), tso, dt) == ("S7", body, q(body), 1)
    flipped = "CCATTTTTTTTT" + rc(body)
    lab, s, _, strand = adapters.label_read(flipped, q(flipped), tso, dt)
    assert lab.startswith("E") and strand == -1 and s == body
    assert adapters.label_read(body, q(body), tso, dt)[0] == ""
    assert adapters.label_read("ACATGG", "IIIIII", tso, dt)[0] == ""
    assert adapters.collapse_mates("AACCGGTTAACCGGTTA", "I" * 17, rc("ACCGGTTAACCGGTTACC"), "I" * 18)[0] == "AACCGGTTAACCGGTTACC"
    assert adapters.prefix_match("ACGTACGTAA", "ACGTACGTCC", 0.2) and not adapters.prefix_match("ACG", "ACG", 0.0)
    fq = spark.createDataFrame([("r", read + "CAGT" * 5, "I" * 47)], "name string, seq1 string, qual1 string")
    r = adapters.label(fq, tso, dt).first()
    assert r["name"] == "r_TAG=S7" and r.keep and r.seq1.startswith(body)


@settings(max_examples=100, deadline=None)
@given(st.text("ACGTN", max_size=14), st.text("ACGTR", max_size=14))
def test_iupac_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            meet = set(sequence.BASES[x]) & set(sequence.BASES[y])
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (not meet)))
        row = new
    assert adapters.iupac_edit_distance(a, b, 20) == row[-1]


@pytest.mark.parametrize("how", [{"rate": 0.2}, {}, {"min_start": 3, "min_end": 12, "longest": 15, "rate": 0.3}])
def test_batches_of_reads_are_labelled_like_single_reads(spark, how):
    draw = random.Random(3)
    parts = ["ACATGGG", "CCATTTTTT", "TTTTTTTTTTTT", "AAAAAAAAAAAAAATGG", "CCCATGT", "ACNTGGG", ""]
    reads = ["", "A", "é" * 9, *("".join(draw.choice(parts) for _ in range(2)) + "".join(draw.choices("ACGTacgtNé", k=draw.choice([0, 3, 30, 200]))) + draw.choice(parts) for _ in range(300))]
    rows = [(str(i), s, "".join(draw.choices("!5I", [1, 1, 8], k=len(s)))) for i, s in enumerate(reads)] + [("none", None, None)]
    got = {r.name.split("_")[0]: r for r in adapters.label(spark.createDataFrame(rows, "name string, seq1 string, qual1 string"), "ACATGGG", "CCATTTTTT+", **how).collect()}
    for name, s, q in rows:
        r = got[name]
        assert (r.label, r.seq1, r.qual1, r.strand) == adapters.label_read(s or "", q or "", "ACATGGG", "CCATTTTTT+", **how), (s, q)


def test_labelling_sends_only_the_ends_of_reads_to_python(spark):
    rows = spark.createDataFrame([("r", "ACATGGG" + "ACGT" * 500, "I" * 2007)], "name string, seq1 string, qual1 string")
    plan = adapters.label(rows, "ACATGGG", "CCATTTTTT+")._jdf.queryExecution().analyzed().toString()
    assert next(line for line in plan.splitlines() if "AS __x" in line).count(", 120)") == 4


def test_alignments(spark):
    T = "map<string,string>"
    rows = [
        ("q1_TAG=S5", 0, "c", 11, "3S10M100N10M2S", "AAG" + "A" * 22, {"XS": "+", "NH": "1"}), ("q2", 16, "c", 11, "10M2D10M", "A" * 20, {"MD": "10^AA10"}), ("q3", 0, "c", 1, "25M", "A" * 25, {"NH": "2"}), ("q3", 256, "c", 900, "25M", "A" * 25, {"NH": "2"}),
        ("bad", 4, "*", 0, "*", "A", {}), ("err", 0, "c", 1, "20M", "A" * 20, {"MD": "1A1C1G1T1A10"}), ("p", 99, "c", 101, "20M", "A" * 20, {"XS": "+", "HI": "1"}), ("p", 147, "c", 111, "20M", "A" * 20, {"XS": "+", "HI": "1"}),
    ]
    sam = spark.createDataFrame([(n, f, c, p, 60, g, "=", p, 0, s, s, t) for n, f, c, p, g, s, t in rows], f"qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags {T}")
    got = {(r.left, r.right): r for r in alignments.reads_of(sam, secondary=True).collect()}
    assert len(got) == 5
    a = got[10, 130]
    assert [tuple(x) for x in a.ranges] == [(10, 20), (120, 130)] and a.splice == [True] and a.strand == 1 and a.s_tag and a.capped and a.weight == 1
    assert [tuple(x) for x in got[10, 32].ranges] == [(10, 32)] and got[0, 25].weight == 0.5 == got[899, 924].weight
    assert [tuple(x) for x in got[100, 130].ranges] == [(100, 130)]
    sj = alignments.junctions_of(sam).collect()
    assert [(r.start, r.end, r.strand, r.uniq, r.overhang) for r in sj] == [(20, 120, "+", 1, 10)]


def reads_frame(rows):
    return list(pd.DataFrame(rows, columns=["strand", "ranges", "splice", "s_tag", "e_tag", "capped", "weight"]).itertuples())


def two_isoforms(seed=0):
    """Full and partial reads of two isoforms with a shared start, in a random order."""
    a, b = [(100, 300), (500, 700), (900, 1200)], [(100, 300), (900, 1200)]
    rows = [(1, a, [True, True], True, True, True, 10.0), (1, b, [True], True, True, False, 6.0), (1, [(150, 300), (500, 650)], [True], False, False, False, 4.0), (1, [(100, 200)], [], True, False, False, 3.0), (1, [(1000, 1200)], [], False, True, False, 3.0), (0, [(950, 1100)], [], False, False, False, 2.0), (1, [(250, 300), (320, 420)], [True], False, False, False, 0.01)]
    random.Random(seed).shuffle(rows)
    return reads_frame(rows)


def test_assembly_of_two_isoforms():
    out = {tuple(t["ranges"]): t for t in assembly.assemble_locus(two_isoforms())}
    assert set(out) == {((100, 300), (500, 700), (900, 1200)), ((100, 300), (900, 1200))}
    assert all(t["complete"] for t in out.values())
    assert out[(100, 300), (500, 700), (900, 1200)]["cov"] > out[(100, 300), (900, 1200)]["cov"]
    for seed in range(1, 5):
        assert {tuple(t["ranges"]): round(t["cov"], 9) for t in assembly.assemble_locus(two_isoforms(seed))} == {k: round(t["cov"], 9) for k, t in out.items()}


def test_assembly_joins_partial_reads():
    rows = reads_frame([(-1, [(100, 300), (500, 600)], [True], False, True, False, 5.0), (-1, [(250, 300), (500, 800)], [True], True, False, True, 5.0)])
    out = assembly.assemble_locus(rows)
    assert [t["ranges"] for t in out] == [[(100, 300), (500, 800)]] and out[0]["strand"] == -1
    total = sum(r.weight * sum(b - a for a, b in r.ranges) for r in rows)
    assert out[0]["cov"] * 500 == pytest.approx(total)


def test_assembly_in_spark(spark):
    pdf = two_isoforms()
    rows = [("c", r.ranges[0][0], r.ranges[-1][1], r.strand, r.ranges, r.splice, r.s_tag, r.e_tag, r.capped, float(r.weight)) for r in pdf]
    reads = spark.createDataFrame(rows, f"chrom string, left int, right int, strand int, ranges {B}, splice array<boolean>, s_tag boolean, e_tag boolean, capped boolean, weight double")
    tr = assembly.assemble(reads)
    assert tr.count() == 2
    q = {r.transcript_id: r.weight for r in assembly.quantify(reads, tr).collect()}
    assert sum(q.values()) == pytest.approx(28.0) and len(q) == 2
    c = assembly.condense(reads)
    assert c.agg(F.sum("weight")).first()[0] == pytest.approx(sum(r.weight for r in pdf))
    assert merge.simulate(tr.withColumn("weight", F.col("cov")), 100).where("size(ranges) = 0").count() == 0


REF = f"row bigint, chrom string, strand int, ranges {B}, gene_id string"


def test_classification(spark):
    refs = spark.createDataFrame([(1, "c", 1, [(0, 100), (200, 300)], "g1"), (2, "c", 1, [(1000, 1100), (1200, 1300)], "g2")], REF)
    cases = {10: (1, [(20, 100), (200, 290)], 8), 11: (1, [(0, 100), (200, 900)], 7), 12: (1, [(50, 100), (200, 205)], 8), 13: (-1, [(10, 90)], 2), 14: (0, [(10, 90)], 5), 15: (1, [(120, 180)], 3), 16: (1, [(5000, 5100)], 0), 17: (1, [(0, 80), (250, 300)], 4),
        18: (1, [(-200, -150), (50, 100), (200, 300)], 4.1), 19: (1, [(0, 100), (200, 250), (350, 400)], 4.2), 20: (1, [(0, 300)], 4.3), 21: (1, [(10, 60)], 5), 22: (0, [(0, 100), (200, 300)], 1)}
    q = spark.createDataFrame([(k, "c", s, r, "x") for k, (s, r, _) in cases.items()], REF)
    assert {r.row: r.code for r in classify.classify(q, refs).collect()} == {k: v[2] for k, v in cases.items()}
    fused = spark.createDataFrame([(1, "c", 1, [(0, 100), (200, 300), (1000, 1100), (1200, 1300)], "x")], REF)
    f = classify.classify_with_fusions(fused, refs).first()
    assert f.code == 6 and f.genes == "g1|g2"
    w = {(r.kind, r.left, r.right) for r in classify.end_windows(refs.where("row = 1"), 50).collect()}
    assert w == {("S", -50, 50), ("E", 250, 350)}
    genome = spark.createDataFrame([("c", "A" * 100 + "GT" + "A" * 96 + "AG" + "A" * 2000)], "chrom string, seq string")
    assert {r.row: r.noncanonical for r in classify.noncanonical_junctions(refs, genome).collect()} == {1: False, 2: True}
    assert classify.report(classify.classify(q, refs)).where("class = 'full_match'").count() == 2


def test_merge(spark):
    S = f"chrom string, strand int, ranges {B}, weight double, TPM double, source string, transcript_id string"
    a = spark.createDataFrame([("c", 1, [(0, 100), (200, 300)], 5.0, 5.0, "s1", "a1"), ("c", 1, [(10, 100), (200, 310)], 2.0, 2.0, "s2", "b1"), ("c", -1, [(0, 150)], 1.0, 9.0, "s1", "a2"), ("c", 1, [(5000, 5400)], 1.0, 3.0, "s1", "a3"), ("d", 1, [(0, 50)], 1.0, 3.0, "s1", "a4")], S)
    ref = spark.createDataFrame([("c", 1, [(0, 100), (200, 300)], "g", "t")], f"chrom string, strand int, ranges {B}, gene_id string, transcript_id string")
    got = {r["name"]: r for r in merge.merge(a, ref).collect()}
    assert set(got) == {"t", "g-AS.i1", "NEW-1.i1", "NEW-2.i1"}
    assert got["t"].reps == 2 and got["t"].TPM == 7.0 and sorted(got["t"].members) == ["a1", "b1"] and got["NEW-2.i1"].reject_reason == "length"


def test_streaming_equals_batch(spark, tmp_path):
    reads = views.reads(spark, DIR).select("chrom", F.col("left").cast("int"), F.col("right").cast("int"), "weight").where("chrom <= 3")
    reads.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    want = sorted((r.chrom, r.left, r.right, r.n_reads, r.weight) for r in islands.loci(reads, 50).groupBy("chrom", "locus").agg(F.min("left").alias("left"), F.max("right").alias("right"), F.count("*").alias("n_reads"), F.sum("weight").alias("weight")).collect())
    key = lambda df: sorted((r.chrom, r.left, r.right, r.n_reads, r.weight) for r in df.collect())
    assert key(streaming.session_loci(reads, 50)) == want
    q = streaming.session_loci(live, 50).writeStream.format("memory").queryName("loci").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert key(spark.table("loci")) == want
    assert streaming.binned_coverage(reads, 500).agg(F.sum("weight")).first()[0] == reads.agg(F.sum("weight")).first()[0]


def analyzed(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_inferred_strands_need_no_window_that_looks_ahead(spark):
    out = coverage.inferred_strand_coverage(views.reads(spark, DIR).where("chrom = 1"))
    assert "unboundedfollowing" not in analyzed(out).lower()
    rows = [("a", 1, 0, 10, 3.0), ("a", -1, 0, 10, 1.0), ("a", 0, 20, 30, 4.0), ("a", -1, 40, 50, 4.0), ("b", 0, 0, 5, 2.0)]
    df = spark.createDataFrame(rows, "chrom string, strand int, l int, r int, weight double").withColumn("ranges", F.array(F.struct("l", "r")))
    got = {(r.chrom, r.start): (r.plus, r.minus) for r in coverage.inferred_strand_coverage(df).collect()}
    assert got == {("a", 0): (3.0, 1.0), ("a", 20): (pytest.approx(1.5), pytest.approx(2.5)), ("a", 40): (0.0, 4.0), ("b", 0): (1.0, 1.0)}


def test_coverage_reads_its_events_once(spark):
    out = coverage.coverage(views.reads(spark, DIR))
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_one_block_is_shifted_like_several(spark):
    rows = [([(5, 9)], 1), ([(5, 9)], -1), ([(5, 9)], 0), ([(5, 9)], None), ([(5, 5)], 1), ([(9, 5)], 1), ([(1, 3), (5, 9)], 1)]
    df = spark.createDataFrame(rows, f"ranges {B}, strand int").select(intervals.shift_by(F.col("ranges"), F.lit(3), F.col("strand")).alias("x"))
    assert [[tuple(b) for b in r.x] for r in df.collect()] == [[(8, 12)], [(2, 6)], [(5, 9)], [(5, 9)], [], [], [(6, 12)]]
    assert "size(ranges" in analyzed(df) and "THEN CASE WHEN (ranges" in analyzed(df)


def test_lone_references_are_not_sent_to_python(spark):
    kind = f"row long, gene_id string, chrom string, strand int, ranges {B}"
    q = spark.createDataFrame([(1, "", "a", 1, [(0, 100)]), (2, "", "a", 1, [(1000, 2000)]), (3, "", "a", 1, [(5000, 5100)])], kind)
    ref = spark.createDataFrame([(11, "G", "a", 1, [(0, 100)]), (12, "H", "a", 1, [(1000, 1400)]), (13, "I", "a", 1, [(1500, 2000)]), (14, None, "a", 1, [(5100, 5200), (5300, 5400)])], kind)
    out = classify.classify_with_fusions(q, ref)
    assert {r.row: (r.code, r.refs, r.genes) for r in out.collect()} == {1: (8.0, "11", "G"), 2: (6.0, "12|13", "H|I"), 3: (5.0, "14", "None")}
    assert "fold(CASE WHEN" in analyzed(out)
