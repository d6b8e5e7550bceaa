"""The engine's queries over the adapter views and their DuckDB SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequence as Q
from strandloom.operators import collapse, coverage, intervals, islands, joins
from strandloom.plans import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str = "", *, name: str = ""):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# --- coverage ------------------------------------------------------------------


def _coverage_sql(where: str = "TRUE", shift: str = "0") -> str:
    return f"""WITH {views.READS},
e AS (SELECT chrom, pos, sum(delta) AS delta FROM (
  SELECT chrom, "left" + {shift} AS pos, weight AS delta FROM v_reads WHERE {where} UNION ALL SELECT chrom, "right" + {shift}, -weight FROM v_reads WHERE {where}) GROUP BY 1, 2 HAVING sum(delta) <> 0),
s AS (SELECT chrom, pos AS "start", lead(pos) OVER w AS "end", sum(delta) OVER w AS value FROM e WINDOW w AS (PARTITION BY chrom ORDER BY pos))
SELECT chrom, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", value FROM s WHERE value <> 0 AND "end" IS NOT NULL"""


@query(_coverage_sql())
def coverage_all(spark, d):
    return longs(coverage.coverage(views.reads(spark, d)), "start", "end")


@query(_coverage_sql())
def coverage_striped(spark, d):
    return longs(coverage.coverage(views.reads(spark, d), stripe=20_000), "start", "end")


@query(_coverage_sql("strand = 1"))
def coverage_plus(spark, d):
    return longs(coverage.coverage(views.reads(spark, d), 1), "start", "end")


@query(_coverage_sql("strand = -1"))
def coverage_minus(spark, d):
    return longs(coverage.coverage(views.reads(spark, d), -1), "start", "end")


@query(_coverage_sql("TRUE", "7 * strand"))
def coverage_offset(spark, d):
    return longs(coverage.bedgraph(views.reads(spark, d), offset=7), "start", "end")


@query()
def coverage_inferred_strand(spark, d):
    return coverage.inferred_strand_coverage(views.reads(spark, d))


def _signal_sql(flag: str, five: bool) -> str:
    side = "strand = 1" if five else "strand = -1"
    return f"""WITH {views.READS}
SELECT chrom, CAST(pos AS BIGINT) AS "start", CAST(pos + 1 AS BIGINT) AS "end", value FROM (
  SELECT chrom, CASE WHEN {side} THEN "left" ELSE "right" - 1 END AS pos, sum(weight * strand) AS value FROM v_reads WHERE strand <> 0 AND {flag} GROUP BY 1, 2) WHERE value <> 0"""


for _kind, _flag, _five in (("5P", "s_tag", True), ("S", "s_tag AND NOT capped", True), ("C", "capped", True), ("E", "e_tag", False)):
    query(_signal_sql(_flag, _five), name=f"signal_{_kind}")(lambda spark, d, k=_kind: longs(coverage.end_signal(views.reads(spark, d), k), "start", "end"))


@query(f"""WITH {views.READS}, r AS (SELECT *, CASE strand WHEN 1 THEN '+' ELSE '-' END AS s FROM v_reads WHERE strand <> 0)
SELECT chrom, feature, CAST(pos AS BIGINT) AS pos, sum(weight) AS weight FROM (
  SELECT chrom, 'S' || s AS feature, CASE strand WHEN 1 THEN "left" ELSE "right" - 1 END AS pos, weight FROM r WHERE s_tag AND NOT capped
  UNION ALL SELECT chrom, 'C' || s, CASE strand WHEN 1 THEN "left" ELSE "right" - 1 END, weight FROM r WHERE capped
  UNION ALL SELECT chrom, 'E' || s, CASE strand WHEN -1 THEN "left" ELSE "right" - 1 END, weight FROM r WHERE e_tag) GROUP BY 1, 2, 3""")
def depth_features(spark, d):
    return longs(coverage.depth_features(views.reads(spark, d)), "pos")


@query(f"""WITH cov AS ({_coverage_sql()}),
c AS (SELECT chrom, "start", (value - last) / greatest(value, last) AS change FROM (
  SELECT *, CASE WHEN lag("end") OVER w = "start" THEN lag(value) OVER w ELSE 0 END AS last FROM cov WINDOW w AS (PARTITION BY chrom ORDER BY "start")))
SELECT chrom, arg_max("start", change * 1e9 - "start" / 1e3) AS rise, arg_min("start", change * 1e9 + "start" / 1e3) AS fall FROM c GROUP BY 1""")
def sharpest_change(spark, d):
    return longs(coverage.sharpest_change(coverage.coverage(views.reads(spark, d))), "rise", "fall")


# --- collapse, sort, normalise ---------------------------------------------------


@query(f"""WITH {views.READS} SELECT chrom, CAST("left" AS BIGINT) AS "left", CAST("right" AS BIGINT) AS "right", CAST(strand AS BIGINT) AS strand, CAST(source AS BIGINT) AS source, sum(weight) AS weight, count(*) AS n
FROM v_reads GROUP BY 1, 2, 3, 4, 5""")
def collapse_duplicates(spark, d):
    rows = views.reads(spark, d).withColumn("n", F.lit(1).cast("long"))
    return longs(collapse.collapse_duplicates(rows, ["chrom", "left", "right", "strand", "source"], ("weight", "n")), "left", "right", "strand", "source")


@query(f"""WITH {views.READS},
u AS (SELECT chrom, "left", "right", strand, CASE WHEN source <= 2 THEN 2 ELSE 1 END * weight AS weight, CASE WHEN source <= 2 THEN 'a' ELSE 'b' END AS source FROM v_reads),
c AS (SELECT chrom, "left", "right", strand, source, sum(weight) AS weight FROM u GROUP BY ALL)
SELECT chrom, CAST("left" AS BIGINT) AS "left", CAST("right" AS BIGINT) AS "right", CAST(strand AS BIGINT) AS strand, source, weight FROM c""")
def combine_scaled(spark, d):
    rows = views.reads(spark, d).withColumns({"elcigar": F.lit(""), "s_weight": F.lit(0.0), "e_weight": F.lit(0.0)})
    out = collapse.combine([rows.where("source <= 2"), rows.where("source > 2")], [2.0, 1.0], ["a", "b"])
    return longs(out.select("chrom", "left", "right", "strand", "source", "weight"), "left", "right", "strand")


@query(f"""WITH {views.READS}, c AS (SELECT chrom, "left", "right", strand, source, sum(weight) AS weight FROM v_reads GROUP BY ALL)
SELECT chrom, CAST("left" AS BIGINT) AS "left", CAST("right" AS BIGINT) AS "right", CAST(strand AS BIGINT) AS strand, CAST(source AS BIGINT) AS source, weight,
row_number() OVER (PARTITION BY chrom ORDER BY "left", "right" - "left", CASE strand WHEN 1 THEN -1 WHEN -1 THEN 1 ELSE 0 END, source, weight) AS place FROM c""")
def sort_reads(spark, d):
    from pyspark.sql import Window

    rows = collapse.collapse_duplicates(views.reads(spark, d), ["chrom", "left", "right", "strand", "source"], ("weight",))
    order = Window.partitionBy("chrom").orderBy("left", F.col("right") - F.col("left"), collapse.strand_order(F.col("strand")), "source", "weight")
    return longs(rows.withColumn("place", F.row_number().over(order)), "left", "right", "strand", "source", "place")


@query("""SELECT l_suppkey AS chrom, l_linenumber AS source, w AS weight, w / sum(w) OVER (PARTITION BY l_linenumber) * 1e6 AS "TPM" FROM (
SELECT l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)""")
def tpm(spark, d):
    rows = views.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("chrom"), F.col("l_linenumber").cast("long").alias("source")).agg(F.sum("l_quantity").alias("weight"))
    return collapse.tpm(rows)


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, 1.0 / count(*) OVER (PARTITION BY l_orderkey) AS weight FROM lineitem""")
def multimap_weight(spark, d):
    return longs(collapse.multimap_weight(views.table(spark, d, "lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "weight"), "l_linenumber")


@query("""SELECT event_type AS label, count(*) AS n, floor(count(*) * 1.0 / (SELECT count(*) FROM events) * 1000) / 10 AS percent FROM events GROUP BY 1""")
def label_histogram(spark, d):
    return collapse.label_histogram(views.table(spark, d, "events").select(F.col("event_type").alias("label")))


@query(f"""WITH {views.READS} SELECT chrom, {", ".join(f'coalesce(sum(weight) FILTER (source = {i}), 0) AS "s{i}"' for i in range(1, 8))} FROM v_reads GROUP BY chrom""")
def source_pivot(spark, d):
    rows = views.reads(spark, d).withColumn("source", F.concat(F.lit("s"), "source"))
    return collapse.source_pivot(rows, "chrom", [f"s{i}" for i in range(1, 8)])


@query("""SELECT row_number() OVER (ORDER BY name) - 1 AS id, name FROM (SELECT DISTINCT o_orderpriority AS name FROM orders)""")
def source_dictionary(spark, d):
    return collapse.dictionary(views.table(spark, d, "orders"), "o_orderpriority")


# --- islands ------------------------------------------------------------------------


def _island_sql(opens: str, extra: str = "") -> str:
    return f"""{views.READS},
o AS (SELECT *, CASE WHEN m IS NULL OR "left" {opens} THEN 1 ELSE 0 END AS opens FROM (
  SELECT *, max("right") OVER (PARTITION BY chrom ORDER BY "left", "right" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM v_reads)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY "left", "right" RANGE UNBOUNDED PRECEDING) AS locus FROM o)"""


def _summary_sql(gap: int) -> str:
    return f"""WITH {_island_sql(f">= m + {gap}")}
SELECT chrom, CAST(locus AS BIGINT) AS locus, CAST(min("left") AS BIGINT) AS "left", CAST(max("right") AS BIGINT) AS "right", count(*) AS n_reads, sum(weight) AS weight,
  (max(CASE WHEN strand = 1 AND s_tag THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN strand = 1 AND e_tag THEN 1 ELSE 0 END) = 1)
  OR (max(CASE WHEN strand = -1 AND s_tag THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN strand = -1 AND e_tag THEN 1 ELSE 0 END) = 1) AS has_ends
FROM i GROUP BY chrom, locus"""


for _gap in (0, 50, 200):
    query(_summary_sql(_gap), name=f"locus_summary_{_gap}")(lambda spark, d, g=_gap: longs(islands.locus_summary(views.reads(spark, d), g), "left", "right"))


@query(f"""WITH {_island_sql("> m")} SELECT chrom, CAST(min("left") AS BIGINT) AS "left", CAST(max("right") AS BIGINT) AS "right" FROM i GROUP BY chrom, locus""")
def interval_union(spark, d):
    return longs(islands.union_rows(views.reads(spark, d), ["chrom"]), "left", "right")


@query(f"""WITH {_island_sql("> m")} SELECT chrom, CAST(locus AS BIGINT) AS locus, count(*) AS n FROM i GROUP BY 1, 2""")
def annotation_loci(spark, d):
    return islands.annotation_loci(views.reads(spark, d), stripe=10_000).groupBy("chrom", "locus").agg(F.count("*").alias("n"))


@query(f"""WITH {_island_sql(">= m + 50")} SELECT chrom, CAST("left" AS BIGINT) AS "left", CAST("right" AS BIGINT) AS "right", CAST(locus AS BIGINT) AS locus, weight FROM i WINDOW w AS (PARTITION BY chrom, locus)
QUALIFY greatest(max(CASE WHEN strand = 1 AND s_tag THEN 1 ELSE 0 END) OVER w + max(CASE WHEN strand = 1 AND e_tag THEN 1 ELSE 0 END) OVER w,
                 max(CASE WHEN strand = -1 AND s_tag THEN 1 ELSE 0 END) OVER w + max(CASE WHEN strand = -1 AND e_tag THEN 1 ELSE 0 END) OVER w) = 2""")
def assemblable_reads(spark, d):
    return longs(islands.assemblable(views.reads(spark, d)).select("chrom", "left", "right", "locus", "weight"), "left", "right")


@query(f"""WITH {views.JUNCTIONS},
o AS (SELECT *, CASE WHEN m IS NULL OR "start" > m THEN 1 ELSE 0 END AS opens FROM (
  SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM v_sj)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY "start", "end" RANGE UNBOUNDED PRECEDING) AS chunk FROM o)
SELECT chrom, CAST(chunk AS BIGINT) AS chunk, count(*) AS n, CAST(min("start") AS BIGINT) AS "start", CAST(max("end") AS BIGINT) AS "end" FROM i GROUP BY 1, 2""")
def junction_chunks(spark, d):
    return longs(islands.junction_chunks(views.junctions(spark, d)).groupBy("chrom", "chunk").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end")), "start", "end")


@query("""WITH s AS (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t FROM events),
o AS (SELECT *, CASE WHEN t >= lag(t) OVER (PARTITION BY user_id ORDER BY t) + 3600000000 OR lag(t) OVER (PARTITION BY user_id ORDER BY t) IS NULL THEN 1 ELSE 0 END AS o FROM s),
i AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS session FROM o)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM i GROUP BY 1, 2""")
def event_sessions(spark, d):
    return islands.sessions(views.table(spark, d, "events"), "user_id", "ts", 3600).groupBy("user_id", "session").agg(F.count("*").alias("n"))


# --- projections and predicates --------------------------------------------------------


@query(f"""WITH {views.MULTI} SELECT "row", chrom, CAST("left" AS BIGINT) AS "left", CAST("right" AS BIGINT) AS "right", CAST(bases AS BIGINT) AS bases, n_blocks,
len(list_filter(ranges, lambda x: x.r - x.l >= 20)) AS n_exons, n_blocks - 1 AS n_gaps, len(list_filter(ranges, lambda x: x.r <= x.l)) > 0 AS malformed FROM v_multi""")
def read_projections(spark, d):
    r = F.col("ranges")
    out = views.multi(spark, d).select("row", "chrom", intervals.left(r).alias("left"), intervals.right(r).alias("right"), intervals.covered_length(r).alias("bases"), F.size(r).alias("n_blocks"), intervals.exon_count(r, 20).alias("n_exons"), F.size(intervals.gaps(r)).alias("n_gaps"), intervals.malformed(r).alias("malformed"))
    return longs(out, "left", "right", "bases", "n_blocks", "n_exons", "n_gaps")


_PAIRS = f"""{views.MULTI},
p AS (SELECT a."row" AS a, b."row" AS b, a."left" AS l1, a."right" AS r1, b."left" AS l2, b."right" AS r2, a.strand AS s1, b.strand AS s2, a.ranges AS x, b.ranges AS y, a.bases AS n1, b.bases AS n2
FROM v_multi a JOIN v_multi b ON a.chrom = b.chrom AND NOT a.is_reference AND b.is_reference AND a."right" >= b."left" AND a."left" <= b."right")"""


def _pairs(spark, d) -> DataFrame:
    rows = views.multi(spark, d)
    a = rows.where("not is_reference").select("chrom", "left", "right", F.col("row").alias("a"), F.col("ranges").alias("x"), F.col("strand").alias("s1"))
    b = rows.where("is_reference").select("chrom", "left", "right", F.col("row").alias("b"), F.col("ranges").alias("y"), F.col("strand").alias("s2"))
    return joins.range_join(a, b, ["chrom"], bin_size=500)


@query(f"""WITH {_PAIRS} SELECT a, b, CAST(greatest(l1, l2) AS BIGINT) AS l, CAST(least(r1, r2) AS BIGINT) AS r FROM p""")
def overlap_join(spark, d):
    ov = intervals.overlap_range(F.col("left"), F.col("right"), F.col("b_left"), F.col("b_right"))
    return longs(_pairs(spark, d).select("a", "b", ov.alias("o")).select("a", "b", "o.l", "o.r"), "l", "r")


@query(f"""WITH {_PAIRS},
s AS (SELECT p.a, p.b, sum(greatest(0, least(u.r, v.r) - greatest(u.l, v.l))) AS shared FROM p JOIN v_blocks u ON u."row" = p.a JOIN v_blocks v ON v."row" = p.b GROUP BY 1, 2)
SELECT p.a, p.b, CAST(shared AS BIGINT) AS shared, l1 >= l2 AS ll, l1 >= r2 AS lr, r1 >= l2 AS rl, r1 >= r2 AS rr,
  s1 = s2 AND least(r1, r2) - greatest(l1, l2) >= least(20, r1 - l1, r2 - l2) AS sense, s1 = -s2 AND least(r1, r2) - greatest(l1, l2) >= least(20, r1 - l1, r2 - l2) AS antisense
FROM p JOIN s ON s.a = p.a AND s.b = p.b""")
def pair_predicates(spark, d):
    x, y = F.col("x"), F.col("y")
    spans = [F.col(c) for c in ("left", "right", "b_left", "b_right")]
    sense = lambda f: f(F.col("s1"), F.col("s2"), *spans, 20)
    rows = _pairs(spark, d).select("a", "b", intervals.shared_bases(x, y).alias("shared"), intervals.overlap_type(*spans).alias("k"), sense(intervals.sense_match).alias("sense"), sense(intervals.antisense_match).alias("antisense"))
    return longs(rows.select("a", "b", "shared", "k.*", "sense", "antisense"), "shared")


@query(f"""WITH {_PAIRS},
g AS (SELECT "row", r AS gl, lead(l) OVER (PARTITION BY "row" ORDER BY l) AS gr FROM v_blocks QUALIFY gr IS NOT NULL),
k AS (SELECT "row", string_agg(gl || '-' || gr, ',' ORDER BY gl) AS chain FROM g GROUP BY 1)
SELECT a, b, coalesce(u.chain, '') = coalesce(v.chain, '') AS same FROM p LEFT JOIN k u ON u."row" = a LEFT JOIN k v ON v."row" = b""")
def splice_match(spark, d):
    return _pairs(spark, d).select("a", "b", intervals.splice_match(F.col("x"), F.col("y")).alias("same"))


_CHAINS = """g AS (SELECT "row", r AS gl, lead(l) OVER (PARTITION BY "row" ORDER BY l) AS gr FROM v_blocks QUALIFY gr IS NOT NULL),
k AS (SELECT "row", list({'l': gl, 'r': gr} ORDER BY gl) AS gaps FROM g GROUP BY 1),
q AS (SELECT p.*, coalesce(u.gaps, []) AS g1, coalesce(v.gaps, []) AS g2, greatest(l1, l2) AS l0, least(r1, r2) AS r0 FROM p LEFT JOIN k u ON u."row" = a LEFT JOIN k v ON v."row" = b),
j AS (SELECT *, list_filter(g1, lambda e: e.r > l0 AND e.l < r0) AS j1, list_filter(g2, lambda e: e.r > l0 AND e.l < r0) AS j2,
  list_filter(g1, lambda e: e.l > l0 AND e.r < r0) AS i1, list_filter(g2, lambda e: e.l > l0 AND e.r < r0) AS i2, s1 * s2 <> -1 AS kin FROM q)"""


@query(f"""WITH {_PAIRS}, {_CHAINS} SELECT a, b, kin AND j1 = j2 AS compatible, kin AND i1 = i2 AS inner_compatible, kin AND len(list_filter(j1, lambda e: NOT list_contains(j2, e))) = 0 AS retained FROM j""")
def compatible_pairs(spark, d):
    args = [F.col(c) for c in ("x", "y", "s1", "s2")]
    return _pairs(spark, d).select("a", "b", intervals.compatible(*args).alias("compatible"), intervals.compatible(*args, ignore_overhang=True).alias("inner_compatible"), intervals.compatible(*args, allow_retention=True).alias("retained"))


# --- junctions ---------------------------------------------------------------------------

_MERGED = f"""{views.JUNCTIONS},
m AS (SELECT chrom, "start", "end", strand, count(*) AS reps, sum(uniq) AS uniq, sum(multi) AS multi, max(overhang) AS overhang FROM v_sj GROUP BY 1, 2, 3, 4)"""
_SJ = 'chrom, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", CAST(strand AS BIGINT) AS strand, reps, CAST(uniq AS BIGINT) AS uniq, CAST(multi AS BIGINT) AS multi, CAST(overhang AS BIGINT) AS overhang'


@query(f"WITH {_MERGED} SELECT {_SJ} FROM m")
def junction_merge(spark, d):
    return longs(collapse.merge_junctions(views.junctions(spark, d)), "start", "end", "strand")


@query(f"""WITH {_MERGED},
t AS (SELECT a.chrom, a."start", a."end", a.strand, sum(b.uniq) AS around FROM m a JOIN m b ON a.chrom = b.chrom AND a.strand = b.strand AND a."end" >= b."start" AND a."start" <= b."end" GROUP BY 1, 2, 3, 4)
SELECT {_SJ} FROM m JOIN t USING (chrom, "start", "end", strand) WHERE uniq >= 10 AND reps >= 1 AND uniq >= 0.05 * around""")
def junction_filter(spark, d):
    return longs(collapse.filter_junctions(collapse.merge_junctions(views.junctions(spark, d)), 10, 1, 0.05), "start", "end", "strand")


@query(f"""WITH {_MERGED} SELECT {_SJ}, EXISTS (SELECT 1 FROM v_sj k WHERE file = 1 AND k.chrom = m.chrom AND k."start" = m."start" AND k."end" = m."end" AND k.strand = m.strand) AS annotated FROM m""")
def junction_annotate(spark, d):
    sj = views.junctions(spark, d)
    return longs(joins.known_junctions(collapse.merge_junctions(sj), sj.where("file = 1")), "start", "end", "strand")


@query(f"""WITH {_MERGED} SELECT {_SJ} FROM m WHERE NOT EXISTS (SELECT 1 FROM v_sj k WHERE file = 1 AND k.chrom = m.chrom AND k."start" = m."start" AND k."end" = m."end" AND k.strand = m.strand)""")
def junction_new(spark, d):
    sj = views.junctions(spark, d)
    return longs(collapse.new_junctions(collapse.merge_junctions(sj), sj.where("file = 1")), "start", "end", "strand")


@query(f"""WITH {views.READS}, {views.JUNCTIONS},
pt AS (SELECT DISTINCT chrom, "left" % 5100 AS pos FROM v_reads WHERE e_tag), pk AS (SELECT DISTINCT chrom, "end" AS peak FROM v_sj)
SELECT chrom, CAST(pos AS BIGINT) AS pos, CAST(abs(pos - peak) AS BIGINT) AS distance, CAST(peak AS BIGINT) AS peak FROM pt JOIN pk USING (chrom) WHERE abs(pos - peak) <= 60
QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY abs(pos - peak), peak) = 1""")
def nearest_peak(spark, d):
    pts = views.reads(spark, d).where("e_tag").select("chrom", F.pmod("left", F.lit(5100)).alias("pos")).distinct().withColumn("row", F.lit(0))
    peaks = views.junctions(spark, d).select("chrom", F.col("end").alias("peak")).distinct()
    return longs(joins.nearest(pts, peaks, ["chrom"], 60).drop("row"), "pos", "distance", "peak")


@query(f"""WITH {views.JUNCTIONS}, s AS (SELECT DISTINCT chrom, "start" - 60 AS l, "start" + 260 AS r FROM v_sj), j AS (SELECT DISTINCT chrom, "start", "end", strand FROM v_sj)
SELECT s.chrom, CAST(l AS BIGINT) AS "left", CAST(r AS BIGINT) AS "right", CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", CAST(strand AS BIGINT) AS strand FROM s JOIN j ON s.chrom = j.chrom AND "start" >= l AND "end" <= r""")
def junctions_between(spark, d):
    sj = views.junctions(spark, d)
    spans = sj.select("chrom", (F.col("start") - 60).alias("left"), (F.col("start") + 260).alias("right")).distinct()
    return longs(joins.junctions_between(spans, sj.select("chrom", "start", "end", "strand").distinct()), "left", "right", "start", "end", "strand")


# --- sequences ----------------------------------------------------------------------------


@query(f"WITH {views.SEQUENCES} SELECT doc_id, reverse(translate(seq, '{Q.IUPAC}', '{Q.COMPLEMENT}')) AS rc FROM v_seq")
def seq_reverse_complement(spark, d):
    return views.sequences(spark, d).select("doc_id", Q.reverse_complement(F.col("seq")).alias("rc"))


@query(f"""WITH {views.SEQUENCES}, c AS (SELECT doc_id, length(seq) AS n, greatest({", ".join(f"length(seq) - length(replace(seq, '{b}', ''))" for b in "ACGT")}) AS most FROM v_seq)
SELECT doc_id, CAST(most AS BIGINT) AS most, n = 0 OR most >= n * 0.3 AS homopolymer FROM c""")
def seq_homopolymer(spark, d):
    s = F.col("seq")
    most = F.greatest(*[Q.base_count(s, b) for b in "ACGT"])
    return longs(views.sequences(spark, d).select("doc_id", most.alias("most"), Q.is_homopolymer(s, 0.3).alias("homopolymer")), "most")


@query("""WITH q AS (SELECT doc_id, regexp_replace(text, '[^!-~]', '', 'g') AS q FROM documents)
SELECT doc_id, list_sum(list_transform(string_split(q, ''), lambda c: ascii(c) - 33)) / length(q) AS quality FROM q WHERE length(q) > 0""")
def seq_quality(spark, d):
    q = views.table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^!-~]", "").alias("q")).where("length(q) > 0")
    return q.select("doc_id", Q.mean_quality(F.col("q")).alias("quality"))


@query(f"""WITH {views.SEQUENCES}, m AS (SELECT doc_id, substr(seq, 1, 2) || right(seq, 2) AS m FROM v_seq)
SELECT doc_id, m, CASE m {" ".join(f"WHEN '{k}' THEN {v}" for k, v in Q.MOTIFS.items())} ELSE 0 END AS code,
CASE WHEN m IN {Q.PLUS_MOTIFS} THEN 1 WHEN m IN {Q.MINUS_MOTIFS} THEN -1 ELSE 0 END AS strand FROM m""")
def seq_motif(spark, d):
    s = views.sequences(spark, d).select("doc_id", F.substring("seq", 1, 2).alias("a"), F.right("seq", F.lit(2)).alias("b"))
    return s.select("doc_id", F.concat("a", "b").alias("m"), Q.motif_code(F.col("a"), F.col("b")).alias("code"), Q.motif_strand(F.col("a"), F.col("b")).alias("strand"))


_ACIDS = Q._codon_table()[1].tobytes().decode()


def _translate_sql(seq: str) -> str:
    place = lambda k: f"strpos('{Q.CODES}', substr(z, 3 * i + {k}, 1))"
    return f"array_to_string(list_transform(range(0, length({seq}) // 3), lambda i: substr('{_ACIDS}', ({place(1)} * 16 + {place(2)}) * 16 + {place(3)} + 1, 1)), '')".replace("substr(z,", f"substr({seq},")


@query(f"WITH {views.SEQUENCES}, u AS (SELECT doc_id, replace(seq, 'U', 'T') AS z FROM v_seq) SELECT doc_id, {_translate_sql('z')} AS aa FROM u")
def seq_translate(spark, d):
    return views.sequences(spark, d).select("doc_id", Q.translate(F.col("seq")).alias("aa"))


@query(f"""WITH {views.SEQUENCES},
u AS (SELECT doc_id, frame, substr(replace(seq, 'U', 'T'), frame + 1) AS z FROM v_seq, (SELECT unnest([0, 1, 2]) AS frame)),
f AS (SELECT doc_id, frame, string_split({_translate_sql('z')}, '*') AS a FROM u),
t AS (SELECT doc_id, frame, unnest(a) AS a, generate_subscripts(a, 1) AS i, len(a) AS n FROM f),
b AS (SELECT *, sum(length(a) + 1) OVER (PARTITION BY doc_id, frame ORDER BY i) - length(a) - 1 + strpos(a, 'M') - 1 AS first FROM t),
o AS (SELECT doc_id, frame, frame + 3 * first AS "start", substr(a, strpos(a, 'M')) AS aa FROM b WHERE strpos(a, 'M') > 0 AND i < n)
SELECT doc_id, CAST(frame AS BIGINT) AS frame, CAST("start" AS BIGINT) AS "start", CAST("start" + 3 * length(aa) + 3 AS BIGINT) AS "end", aa, TRUE AS has_start, TRUE AS has_stop
FROM o WHERE length(aa) > 5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(aa) DESC, "start") = 1""")
def seq_orfs(spark, d):
    return longs(Q.longest_orf(views.sequences(spark, d), "doc_id", min_aa=5).select("doc_id", "orf.*"), "frame", "start", "end")


_MASKS = {c: sum(1 << "ACGT".index(x) for x in b) for c, b in Q.BASES.items()}


@query(f"""WITH {views.SEQUENCES}, h AS (SELECT doc_id, substr(seq, 1, length(seq) // 2) AS x, substr(seq, length(seq) // 2 + 1, length(seq) // 2) AS y FROM v_seq),
m AS (SELECT *, {list(_MASKS.values())} AS masks FROM h)
SELECT doc_id, CAST(CASE WHEN x = y THEN -1 ELSE len(list_filter(range(1, length(x) + 1), lambda i: (masks[strpos('{"".join(_MASKS)}', substr(x, i, 1))] & masks[strpos('{"".join(_MASKS)}', substr(y, i, 1))]) = 0)) END AS BIGINT) AS distance FROM m""")
def seq_iupac_hamming(spark, d):
    """The first half of each sequence against its second half."""
    n = F.floor(F.length("seq") / 2).cast("int")
    rows = views.sequences(spark, d).select("doc_id", Q.iupac_hamming(F.substring(F.col("seq"), F.lit(1), n), F.substring(F.col("seq"), n + 1, n)).alias("distance"))
    return longs(rows, "distance")


# --- formats: what is written and read again ------------------------------------------------


def _full_reads(spark, d) -> DataFrame:
    rows = views.reads(spark, d)
    blank = F.expr("cast(array() as array<boolean>)")
    return rows.withColumns({"chrom": F.col("chrom").cast("string"), "source": F.col("source").cast("string"), "splice": blank, "condensed": F.lit(False), "s_weight": F.lit(0.0), "e_weight": F.lit(0.0)})


_READ_ROWS = f"""WITH {views.READS} SELECT CAST(chrom AS VARCHAR) AS chrom, CAST("left" AS BIGINT) AS "left", CAST("right" AS BIGINT) AS "right", CAST(strand AS BIGINT) AS strand, s_tag, e_tag, capped, CAST(source AS VARCHAR) AS source, weight FROM v_reads"""


def _read_rows(df: DataFrame) -> DataFrame:
    return longs(df.select("chrom", "left", "right", "strand", "s_tag", "e_tag", "capped", "source", "weight"), "left", "right", "strand")


@query(_READ_ROWS)
def elr_round_trip(spark, d):
    from strandloom.sources import elr

    return _read_rows(elr.parse(elr.lines(_full_reads(spark, d))))


@query(_READ_ROWS)
def bed_round_trip(spark, d):
    from strandloom.sources import tables

    return _read_rows(tables.parse_bed(tables.bed_lines(_full_reads(spark, d))))


@query(f"""WITH {views.READS} SELECT CAST(chrom AS VARCHAR) AS chrom, CAST("left" AS BIGINT) AS "left", CAST("right" AS BIGINT) AS "right", weight FROM v_reads WHERE chrom = 7 AND "left" < 30000 AND "right" > 10000""")
def elr_subset(spark, d):
    from strandloom.sources import elr

    return longs(elr.subset(_full_reads(spark, d), "7:10000-30000").select("chrom", "left", "right", "weight"), "left", "right")


@query(f"""WITH {views.MULTI} SELECT CAST("row" AS VARCHAR) AS transcript_id, CAST(gene_id AS VARCHAR) AS gene_id, CAST(chrom AS VARCHAR) AS chrom, CAST(strand AS BIGINT) AS strand, CAST("left" AS BIGINT) AS "left", CAST("right" AS BIGINT) AS "right", CAST(bases AS BIGINT) AS bases, n_blocks FROM v_multi""")
def gtf_round_trip(spark, d):
    from strandloom.sources import tables

    rows = views.multi(spark, d)
    tr = rows.select(F.col("row").cast("string").alias("transcript_id"), F.col("gene_id").cast("string"), F.col("chrom").cast("string"), "strand", "ranges", "left", "right", F.expr("cast(map() as map<string,string>)").alias("attributes"))
    back = tables.transcripts(tables.parse_annotation(tables.annotation_lines(tr).select("value")))
    r = F.col("ranges")
    return longs(back.select("transcript_id", "gene_id", "chrom", "strand", "left", "right", intervals.covered_length(r).alias("bases"), F.size(r).alias("n_blocks")), "strand", "left", "right", "bases", "n_blocks")


@query(f"""WITH {_MERGED} SELECT {_SJ} FROM m""")
def junction_round_trip(spark, d):
    from strandloom.sources import tables

    sj = collapse.merge_junctions(views.junctions(spark, d))
    star = sj.withColumns({"chrom": F.col("chrom").cast("string"), "strand": F.when(F.col("strand") == 1, "+").when(F.col("strand") == -1, "-").otherwise("."), "motif": F.lit(0), "annotated": F.lit(False)})
    back = tables.parse_junctions(tables.junction_lines(star)).select(F.col("chrom").cast("bigint").alias("chrom"), "start", "end", F.when(F.col("strand") == "+", 1).when(F.col("strand") == "-", -1).otherwise(0).alias("strand"), "uniq", "multi", "overhang")
    out = back.join(sj.select("chrom", "start", "end", "strand", "reps"), ["chrom", "start", "end", "strand"])
    return longs(out, "start", "end", "strand", "overhang")


@query(f"""WITH {views.MULTI}, w AS (SELECT *, least(50, greatest(40, ranges[1].r - ranges[1].l)) AS a, least(50, greatest(40, ranges[-1].r - ranges[-1].l)) AS z FROM v_multi WHERE strand <> 0)
SELECT CAST("row" AS VARCHAR) AS name, kind, CAST(l AS BIGINT) AS "left", CAST(r AS BIGINT) AS "right", CAST(peak AS BIGINT) AS peak FROM (
SELECT "row", CASE strand WHEN 1 THEN 'S' ELSE 'E' END AS kind, "left" - 50 AS l, "left" + a AS r, "left" AS peak FROM w
UNION ALL SELECT "row", CASE strand WHEN 1 THEN 'E' ELSE 'S' END, "right" - z, "right" + 50, "right" - 1 FROM w)""")
def end_windows(spark, d):
    from strandloom.operators import classify

    return longs(classify.end_windows(views.multi(spark, d)).select("name", "kind", "left", "right", "peak"), "left", "right", "peak")


# --- classification, assembly, merging --------------------------------------------------------


def _query_and_reference(spark, d):
    rows = views.multi(spark, d)
    return rows.where("not is_reference"), rows.where("is_reference")


@query(f"""WITH {_PAIRS}, {_CHAINS},
s AS (SELECT p.a, p.b, sum(greatest(0, least(u.r, v.r) - greatest(u.l, v.l))) AS shared FROM p JOIN v_blocks u ON u."row" = p.a JOIN v_blocks v ON v."row" = p.b GROUP BY 1, 2),
e AS (SELECT j.*, shared, y[1].r < x[1].l OR x[1].r < y[1].l AS low, y[-1].l > x[-1].r OR x[-1].l > y[-1].r AS high, abs(l1 - l2) AS dl, abs(r1 - r2) AS dr FROM j JOIN s ON s.a = j.a AND s.b = j.b),
f AS (SELECT *, CASE s1 WHEN 1 THEN low ELSE high END AS tss, CASE s1 WHEN 1 THEN high ELSE low END AS pas, CASE s1 WHEN 1 THEN dl ELSE dr END AS d5, CASE s1 WHEN 1 THEN dr ELSE dl END AS d3 FROM e),
c AS (SELECT a, b, s1, shared, CASE
  WHEN g1 = g2 AND s1 = s2 THEN CASE WHEN dl <= 100 AND dr <= 100 THEN 8 WHEN n1 < 0.6 * n2 THEN 5 ELSE 7 END
  WHEN kin AND j1 = j2 THEN CASE WHEN n2 > n1 THEN 5 ELSE 4 END
  WHEN s1 = 0 THEN 1 WHEN s1 <> s2 THEN 2 WHEN shared = 0 THEN 3
  WHEN i1 = i2 THEN CASE WHEN pas AND NOT (tss AND d5 > d3) THEN 4.2 WHEN tss THEN 4.1 ELSE 0 END
  WHEN len(list_filter(j1, lambda e: NOT list_contains(j2, e))) = 0 THEN CASE WHEN x[1].l < y[1].r AND x[-1].r > y[-1].l THEN 4.3 ELSE 5 END
  ELSE 4 END AS kind FROM f),
best AS (SELECT a, b, shared, CASE WHEN s1 = 0 AND floor(kind) IN (4, 7, 8) THEN 1 ELSE kind END AS code FROM c WHERE kind > 0 OR shared > 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY code DESC, shared DESC, b) = 1)
SELECT m."row", CAST(coalesce(code, 0) AS DOUBLE) AS code, b AS ref, CAST(coalesce(shared, 0) AS BIGINT) AS shared FROM v_multi m LEFT JOIN best ON a = m."row" WHERE NOT is_reference""")
def classify_transcripts(spark, d):
    from strandloom.operators import classify

    q, r = _query_and_reference(spark, d)
    return longs(classify.classify(q, r).select("row", "code", "ref", "shared"), "shared")


_MATCHED = SQL["classify_transcripts"][: SQL["classify_transcripts"].index('SELECT m."row", CAST(coalesce')]


@query(_MATCHED + """SELECT CAST(m."row" AS VARCHAR) AS assembly_id, CASE coalesce(code, 0) WHEN 0 THEN 'intergenic' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'antisense' WHEN 3 THEN 'intronic' WHEN 4 THEN 'splice_variant' WHEN 4.1 THEN 'alt_tss' WHEN 4.2 THEN 'alt_pas' WHEN 4.3 THEN 'retained_intron' WHEN 5 THEN 'fragment' WHEN 7 THEN 'exon_match' WHEN 8 THEN 'full_match' END AS classification,
  coalesce(CAST(b AS VARCHAR), 'NA') AS ref_match, CAST(m.bases AS BIGINT) AS assembly_len, CAST(coalesce(n.bases, 0) AS BIGINT) AS ref_len, CAST(coalesce(shared, 0) AS BIGINT) AS overlap_len,
  CAST(CASE m.strand WHEN 1 THEN m."left" - n."left" ELSE m."right" - n."right" END AS BIGINT) AS diff5p, CAST(CASE m.strand WHEN 1 THEN m."right" - n."right" ELSE m."left" - n."left" END AS BIGINT) AS diff3p
FROM v_multi m LEFT JOIN best ON a = m."row" LEFT JOIN v_multi n ON n."row" = b WHERE NOT m.is_reference""")
def classification_table(spark, d):
    from strandloom.operators import classify

    q, r = _query_and_reference(spark, d)
    return longs(classify.classification_table(q, r).select("assembly_id", "classification", "ref_match", "assembly_len", "ref_len", "overlap_len", "diff5p", "diff3p"), "assembly_len", "ref_len", "overlap_len", "diff5p", "diff3p")


@query()
def classify_fusions(spark, d):
    from strandloom.operators import classify

    return classify.report(classify.classify_with_fusions(*_query_and_reference(spark, d)))


@query()
def assemble_transcripts(spark, d):
    from strandloom.operators import assembly

    return assembly.assemble(_full_reads(spark, d), options=assembly.Options(min_length=10))


@query(f"""WITH {views.READS} SELECT CAST(chrom AS VARCHAR) AS chrom, sum(weight) AS weight FROM v_reads GROUP BY 1""")
def condense_weight(spark, d):
    from strandloom.operators import assembly

    return assembly.condense(_full_reads(spark, d)).groupBy("chrom").agg(F.sum("weight").alias("weight"))


@query()
def condense_reads(spark, d):
    from strandloom.operators import assembly

    return assembly.condense(_full_reads(spark, d))


@query()
def quantify_transcripts(spark, d):
    from strandloom.operators import assembly

    q, r = _query_and_reference(spark, d)
    return assembly.quantify(q.withColumn("weight", F.lit(1.0)), r.withColumn("transcript_id", F.col("row").cast("string")))


@query()
def merge_annotations(spark, d):
    from strandloom.operators import merge

    q, r = _query_and_reference(spark, d)
    a = q.where("strand != 0").select("chrom", "strand", "ranges", F.lit(1.0).alias("weight"), F.lit(2.0).alias("TPM"), F.concat(F.lit("s"), "gene_id").alias("source"), F.col("row").cast("string").alias("transcript_id"))
    b = r.select("chrom", "strand", "ranges", F.concat(F.lit("g"), "gene_id").alias("gene_id"), F.col("row").cast("string").alias("transcript_id"))
    return merge.merge(a, b, merge.Options(min_length=10))


@query()
def simulate_reads(spark, d):
    from strandloom.operators import merge

    return merge.simulate(views.multi(spark, d).withColumn("weight", F.lit(1.0)), 1000).select("row", "ranges")


@query(_summary_sql(50).replace(",\n  (max(CASE", ", FALSE AND (\n  (max(CASE").replace("END) = 1) AS has_ends", "END) = 1)) AS has_ends"))
def session_loci(spark, d):
    from strandloom.streaming import loci as streaming

    rows = views.reads(spark, d)
    out = streaming.session_loci(rows, 50)
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("chrom").orderBy("left"))
    return longs(out.withColumn("locus", number), "left", "right", "locus").withColumn("has_ends", F.lit(False))


@query(f"""WITH {views.READS} SELECT chrom, CAST(floor("left" / 1000) AS BIGINT) AS bin, sum(weight) AS weight FROM v_reads GROUP BY 1, 2""")
def binned_coverage(spark, d):
    from strandloom.streaming import loci as streaming

    return streaming.binned_coverage(views.reads(spark, d), 1000)


@query()
def label_sequences(spark, d):
    from strandloom.functions import adapters

    s = views.sequences(spark, d).select(F.col("doc_id").cast("string").alias("name"), F.col("seq").alias("seq1"))
    return adapters.label(s.withColumn("qual1", F.repeat(F.lit("I"), F.length("seq1"))), "ACATGGG", "CCATTTTTT+", rate=0.2).drop("qual1")
