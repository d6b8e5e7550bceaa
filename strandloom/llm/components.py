"""Connected components of a table of links, by rounds of minimum labels with
pointer jumping. Nothing is collected; each round is stored, so that lineage stays
short. Defined cases: repeated links, loops and an empty table are allowed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import stored


def components(links: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """node, label (the smallest node reachable) of every node of links(u, v)."""
    both = stored(links.select("u", "v").union(links.select("v", "u")).distinct(), "links", kept)
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")), "labels", kept)
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("to"))
        new = stored(step.join(jump, F.col("label") == F.col("j"), "left").select("node", "was", F.least("label", F.coalesce("to", "label")).alias("label")), "labels", kept)
        labels = new.select("node", "label")
        if new.where("label < was").isEmpty():
            return labels
