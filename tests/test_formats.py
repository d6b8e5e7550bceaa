from pyspark.sql import functions as F
from strandloom.sources import elr, tables

ELR = """#C 0 chrA
#C 1 chrB
#S 0 s1
0\t10\t50\t+\tS20D10A20E\t0\t3
0\t10\t50\t-\tE20A10D20C\t0\t1.5
0\t12\t30\t.\t.30.\t0\t2
0\t20\t60\t+\tc20.20.20.\t0\t1|2|3
1\t5\t8\t-\te8.\t0\t4"""


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.split("\n")], "value string")


def test_elr_round_trip(spark):
    reads = elr.parse(lines(spark, ELR + "\nnot a read\n0\tx\ty"))
    bad = [r._corrupt_record for r in reads.collect() if r._corrupt_record]
    assert sorted(bad) == ["0\tx\ty", "not a read"]
    good = reads.where("_corrupt_record is null")
    by = {(r.left, r.elcigar): r for r in good.collect()}
    a = by[10, "S20D10A20E"]
    assert [tuple(x) for x in a.ranges] == [(10, 30), (40, 60)] and a.splice == [True] and a.s_tag and a.e_tag and not a.capped and a.right == 60
    b = by[10, "E20A10D20C"]
    assert b.strand == -1 and b.s_tag and b.capped and b.e_tag
    assert not by[12, ".30."].s_tag and by[12, ".30."].splice == []
    c = by[20, "c20.20.20."]
    assert c.condensed and c.capped and c.splice == [False] and (c.weight, c.s_weight, c.e_weight) == (1.0, 2.0, 3.0)
    out = [r.value for r in elr.lines(good).collect()]
    assert out[:3] == ["#C 0 chrA", "#C 1 chrB", "#S 0 s1"] and set(out) == set(ELR.split("\n"))
    assert elr.subset(good, "chrA:0-15").count() == 3 and elr.subset(good, "chrB").count() == 1


def test_strandless_labels_are_wiped(spark):
    r = elr.parse(lines(spark, "#C 0 c\n#S 0 s\n0\t1\t9\t.\tS9E\t0\t1")).first()
    assert not r.s_tag and not r.e_tag


def test_bed_round_trip(spark):
    good = elr.parse(lines(spark, ELR)).where("_corrupt_record is null")
    back = tables.parse_bed(tables.bed_lines(good))
    cols = ["chrom", "left", "right", "strand", "ranges", "splice", "s_tag", "e_tag", "capped", "condensed", "source", "weight"]
    rows = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert rows(back) == rows(good)
    six = tables.parse_bed(lines(spark, "c\t5\t9\tn\t7\t+"), e_tag=True).first()
    assert six.weight == 7.0 and six.e_tag and [tuple(x) for x in six.ranges] == [(5, 9)]


GTF = """c\tx\texon\t31\t40\t.\t-\t.\tgene_id "g"; transcript_id "t";
c\tx\ttranscript\t11\t40\t.\t-\t.\tgene_id "g"; transcript_id "t"; cov 2.5;
c\tx\texon\t11\t20\t.\t-\t.\tgene_id "g"; transcript_id "t";
c\tx\tCDS\t15\t20\t.\t-\t.\tgene_id "g"; transcript_id "t";
c\tx\ttranscript\t1\t9\t.\t+\t.\tgene_id "h"; transcript_id "lonely";"""


def test_gtf(spark):
    tr = tables.transcripts(tables.parse_annotation(lines(spark, GTF))).collect()
    assert len(tr) == 1
    t = tr[0]
    assert [tuple(x) for x in t.ranges] == [(10, 20), (30, 40)] and (t.cds_left, t.cds_right) == (14, 20) and t.weight == 2.5 and t.strand == -1 and t.gene_id == "g"
    df = tables.transcripts(tables.parse_annotation(lines(spark, GTF)))
    out = [r.value.split("\t") for r in tables.annotation_lines(df).orderBy("place").collect()]
    assert [(x[2], x[3], x[4]) for x in out] == [("transcript", "11", "40"), ("exon", "31", "40"), ("CDS", "15", "20"), ("exon", "11", "20")]
    again = tables.transcripts(tables.parse_annotation(tables.annotation_lines(df).select("value"))).first()
    assert again.ranges == t.ranges and again.transcript_id == "t"


def test_gff(spark):
    text = "c\tx\ttranscript\t11\t40\t.\t+\t.\tID=t;Parent=g;Name=n\nc\tx\texon\t11\t20\t.\t+\t.\tParent=t;gene_id=g\nc\tx\texon\t21\t40\t.\t+\t.\tParent=t;gene_id=g"
    t = tables.transcripts(tables.parse_annotation(lines(spark, text))).first()
    assert t.transcript_id == "t" and t.gene_id == "g" and [tuple(x) for x in t.ranges] == [(10, 40)]


def test_annotation_files(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(GTF)
    (tmp_path / "b.bed").write_text("c\t5\t9\tg1.2\t7\t+\nc\t5\t19\tg1.3\t3\t+\n")
    (tmp_path / "c.txt").write_text("x")
    assert [r.TPM for r in tables.import_annotation(spark, str(tmp_path / "a.gtf"), "a").collect()] == [1e6]
    bed = {r.transcript_id: (r.gene_id, r.TPM) for r in tables.import_annotation(spark, str(tmp_path / "b.bed"), "b").collect()}
    assert bed == {"g1.2": ("g1", 700000.0), "g1.3": ("g1", 300000.0)}
    assert tables.import_annotation(spark, str(tmp_path / "c.txt"), "c").count() == 0


def test_junctions(spark):
    star = "c\t11\t20\t1\t1\t0\t5\t2\t30\nc\t1\t9\t2\t2\t1\t1\t0\t3"
    sj = tables.parse_junctions(lines(spark, star))
    assert {(r.start, r.end, r.strand, r.annotated) for r in sj.collect()} == {(10, 20, "+", False), (0, 9, "-", True)}
    assert {r.value for r in tables.junction_lines(sj).collect()} == set(star.split("\n"))
    assert {r.value.split("\t")[3] for r in tables.junction_bed(sj).collect()} == {"SJ.1", "SJ.2"}
    assert tables.parse_junctions(lines(spark, "c\t10\t20\tn\t7\t-")).first().uniq == 7


def test_sequence_files(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 words\r\nACGT\r\nacgt\r\n>c2\nGG\n")
    g = tables.read_fasta(spark, str(tmp_path / "g.fa"))
    assert {r.chrom: r.seq for r in g.collect()} == {"c1": "ACGTacgt", "c2": "GG"}
    assert {r.value for r in tables.fasta_lines(g, "chrom", width=4).collect()} == {">c1\nACGT\nacgt", ">c2\nGG"}
    (tmp_path / "r1.fq").write_text("@a/1\nAC\n+\nII\n@b/1\nGG\n+\nHH\n")
    (tmp_path / "r2.fq").write_text("@a/2\nTT\n+\nJJ\n@b/2\nCC\n+\nKK\n")
    pairs = tables.read_fastq(spark, str(tmp_path / "r1.fq"), str(tmp_path / "r2.fq"))
    assert {(r.name, r.seq1, r.seq2, r.qual2) for r in pairs.collect()} == {("a", "AC", "TT", "JJ"), ("b", "GG", "CC", "KK")}
    assert {r.value for r in tables.fastq_lines(pairs, 2).collect()} == {"@a\nTT\n+\nJJ", "@b\nCC\n+\nKK"}
    sam = "@HD\tx\nq\t16\tc\t5\t60\t10M5N3M\t*\t0\t0\tACG\tIII\tNH:i:2\tXS:A:-"
    s = tables.parse_sam(lines(spark, sam)).first()
    assert s.flag == 16 and s.pos == 5 and s.tags == {"NH": "2", "XS": "-"}


def test_small_tables(spark, tmp_path):
    (tmp_path / "n.tsv").write_text("a\tA\n")
    names = tables.read_tsv(spark, str(tmp_path / "n.tsv"), "old string, new string")
    df = spark.createDataFrame([("a",), ("b",)], "chrom string")
    assert {r.chrom for r in tables.rename_chroms(df, names).collect()} == {"A", "b"}
    ab = tables.abundances(spark.createDataFrame([("x", 1.0), ("y", 3.0)], "transcript_id string, value double"))
    assert {r.transcript_id: r.share for r in ab.collect()} == {"x": 0.25, "y": 0.75}
    bg = spark.createDataFrame([("c", 0, 5, 12345678.5)], "chrom string, start int, end int, value double")
    assert tables.bedgraph_lines(bg).first().value == "c\t0\t5\t12345678.5"
    assert bg.select(elr.weight_text(F.lit(3.0))).first()[0] == "3"


def test_labels_of_one_block_need_no_walk(spark):
    df = spark.createDataFrame([(5, "S12E", 1), (5, "E-3.", -1), (5, "C12D7A9E", 1), (0, ".1.", 0)], "left int, elcigar string, strand int")
    out = elr.parse_labels(df)
    got = [([tuple(b) for b in r.ranges], r.splice, r.s_tag, r.capped, r.e_tag, r.right) for r in out.collect()]
    assert got == [([(5, 17)], [], True, False, True, 17), ([(5, 2)], [], False, False, True, 2), ([(5, 17), (24, 33)], [True], True, True, True, 33), ([(0, 1)], [], False, False, False, 1)]
    assert "CASE WHEN RLIKE(elcigar" in out._jdf.queryExecution().analyzed().toString()
