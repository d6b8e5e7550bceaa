"""Adapter views: the engine's row types over the star-schema test tables, in Spark
and, as WITH clauses, in DuckDB."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.intervals import collapse_blocks

EPOCH = "1992-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day():
    return F.datediff(F.col("l_shipdate").cast("date"), F.lit(EPOCH).cast("date"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    strand = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0)
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("chrom"), (_day() * 24).alias("left"), (_day() * 24 + F.col("l_quantity").cast("int")).alias("right"), strand.alias("strand"),
        ((strand != 0) & (F.col("l_linestatus") == "O")).alias("s_tag"), ((strand != 0) & (F.col("l_discount") >= 0.05)).alias("e_tag"),
        F.col("l_tax"), F.col("l_linenumber").alias("source"), F.col("l_linenumber").cast("double").alias("weight"),
    )
    rows = rows.withColumn("capped", F.col("s_tag") & (F.col("l_tax") >= 0.04)).drop("l_tax")
    return rows.withColumn("ranges", F.array(F.struct(F.col("left").alias("l"), F.col("right").alias("r"))))


READS = f"""v_reads AS (
  SELECT chrom, d * 24 AS "left", d * 24 + q AS "right", strand, strand <> 0 AND status = 'O' AS s_tag, strand <> 0 AND l_discount >= 0.05 AS e_tag,
         strand <> 0 AND status = 'O' AND l_tax >= 0.04 AS capped, source, CAST(source AS DOUBLE) AS weight
  FROM (SELECT l_suppkey AS chrom, date_diff('day', DATE '{EPOCH}', CAST(l_shipdate AS DATE)) AS d, CAST(l_quantity AS INTEGER) AS q, l_linestatus AS status, l_discount, l_tax,
               CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS strand, l_linenumber AS source FROM lineitem))"""


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read of several blocks per order."""
    at = F.pmod(_day(), F.lit(60)) * 24
    blocks = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(collapse_blocks(F.collect_list(F.struct(at.cast("int").alias("l"), (at + F.col("l_quantity")).cast("int").alias("r")))).alias("ranges"))
    strand = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", -1).otherwise(0)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("chrom"), strand.alias("strand"), (F.col("o_orderpriority") == "1-URGENT").alias("is_reference"))
    rows = orders.join(blocks, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.col("o_orderkey").alias("row"), "chrom", "strand", "is_reference", (F.col("o_orderkey") % 3).alias("gene_id"), "ranges", F.col("ranges")[0]["l"].alias("left"), F.element_at("ranges", -1)["r"].alias("right"))


MULTI = f"""v_lines AS (
  SELECT l_orderkey, (date_diff('day', DATE '{EPOCH}', CAST(l_shipdate AS DATE)) % 60) * 24 AS l, (date_diff('day', DATE '{EPOCH}', CAST(l_shipdate AS DATE)) % 60) * 24 + CAST(l_quantity AS INTEGER) AS r FROM lineitem),
v_flag AS (SELECT *, CASE WHEN l > max(r) OVER (PARTITION BY l_orderkey ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS o FROM v_lines),
v_isl AS (SELECT *, sum(o) OVER (PARTITION BY l_orderkey ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS i FROM v_flag),
v_blocks AS (SELECT l_orderkey AS "row", min(l) AS l, max(r) AS r FROM v_isl GROUP BY l_orderkey, i),
v_multi AS (
  SELECT b."row", o_custkey AS chrom, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN -1 ELSE 0 END AS strand, o_orderpriority = '1-URGENT' AS is_reference, o_orderkey % 3 AS gene_id,
         min(l) AS "left", max(r) AS "right", count(*) AS n_blocks, sum(r - l) AS bases, list(struct_pack(l := l, r := r) ORDER BY l) AS ranges
  FROM v_blocks b JOIN orders ON o_orderkey = b."row" GROUP BY ALL)"""


def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.pmod(_day(), F.lit(50)) * 100
    strand = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("chrom"), start.alias("start"), (start + 50 + (F.col("l_partkey") % 5) * 10).alias("end"), strand.alias("strand"),
        F.col("l_linenumber").alias("file"), F.col("l_quantity").cast("long").alias("uniq"), F.lit(0).cast("long").alias("multi"), F.col("l_linenumber").cast("long").alias("overhang"),
    )


JUNCTIONS = f"""v_sj AS (
  SELECT l_suppkey AS chrom, s AS "start", s + 50 + (l_partkey % 5) * 10 AS "end", CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS strand,
         l_linenumber AS file, CAST(l_quantity AS BIGINT) AS uniq, 0 AS multi, l_linenumber AS overhang
  FROM (SELECT *, (date_diff('day', DATE '{EPOCH}', CAST(l_shipdate AS DATE)) % 50) * 100 AS s FROM lineitem))"""

LETTERS = "[^ACGTUMRWSYKVHDBNacgtumrwsykvhdbn]"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace("text", LETTERS, "")).alias("seq"))


SEQUENCES = f"v_seq AS (SELECT doc_id, upper(regexp_replace(text, '{LETTERS}', '', 'g')) AS seq FROM documents)"
