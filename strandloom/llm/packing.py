"""Packing documents of like length into padded batches.

The histogram of lengths over all documents is exact; lengths of ``EXACT`` and
more are rounded up to a 2^-13 part, which bounds the histogram that the driver
reads. Dynamic programming (divide and conquer over the monotone optimum)
chooses the ``buckets`` upper bounds that minimise total padding. In a bucket,
batches hold as many documents as fit the token budget at the bucket's length.

Documents of a bucket are dealt by hash into groups of about ``group`` rows, and
rows are numbered within a group, so that no bucket is one task; each group ends
with at most one part-filled batch.

Lengths are counts of words [^\\x20\\x09-\\x0D]+. Defined cases: null or empty
text has length 0; a document longer than the budget is a batch of its own;
repeated rows are packed each; an empty table gives no rows.
"""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXACT = 1 << 14


def rounded(n):
    """Column n, rounded up to 14 leading bits."""
    step = F.when(n < EXACT, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))) - 13).cast("long"))
    return (F.ceil(n / step) * step).cast("long")


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The upper bounds (some of lengths, the last among them) with least padding."""
    if not lengths:
        return []
    x, c = np.array(lengths, np.float64), np.array(counts, np.float64)
    d = len(x)
    cum, mass = np.r_[0, np.cumsum(c)], np.r_[0, np.cumsum(c * x)]
    # cost(i, j): lengths i..j in one bucket
    best = x * cum[1:] - mass[1:]
    choice = []
    for _ in range(1, min(buckets, d)):
        new, cut = np.empty(d), np.zeros(d, np.int64)
        todo = [(0, d - 1, 0, d - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j) + 1)  # the last bucket starts at i
            before = np.where(i > 0, best[i - 1], 0.0)
            costs = before + x[j] * (cum[j + 1] - cum[i]) - (mass[j + 1] - mass[i])
            k = int(np.argmin(costs))
            new[j], cut[j] = costs[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best = new
        choice.append(cut)
    out, j = [], d - 1
    for cut in reversed(choice):
        out.append(int(x[j]))
        j = int(cut[j]) - 1
        if j < 0:
            break
    else:
        out.append(int(x[j]))
    return sorted(out)


def pack(docs: DataFrame, buckets: int = 16, budget: int = 1 << 16, group: int = 50_000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_words, bucket (padded length), batch (bucket, group and
    number), slot in it, and padding."""
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    fields = [f"c{i}" for i in range(len(keep))]  # kept by place, whatever their names
    rows = docs.select(*keep, n, F.xxhash64("text")).toDF(*fields, "n", "h")
    histogram = sorted((r.b, r["count"]) for r in rows.groupBy(rounded(F.col("n")).alias("b")).count().collect())
    bounds = best_bounds([b for b, _ in histogram], [c for _, c in histogram], buckets)
    sizes, at = [0] * len(bounds), 0
    for b, c in histogram:
        while b > bounds[at]:
            at += 1
        sizes[at] += c
    of_bucket = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values or [1]]), F.col("k"))
    k = F.lit(1)
    for b in bounds[:-1]:
        k = k + (F.col("n") > b).cast("int")
    rows = rows.withColumn("k", k).withColumn("bucket", of_bucket(bounds, "long"))
    rows = rows.withColumn("g", F.pmod(F.xxhash64(fields[0], "h"), of_bucket([max(1, -(-s // group)) for s in sizes], "long")))
    place = F.row_number().over(Window.partitionBy("bucket", "g").orderBy(fields[0], "n", "h")) - 1
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1)))).cast("long")
    rows = rows.withColumn("i", place).withColumn("per", per)
    number = F.floor(F.col("i") / F.col("per"))
    out = rows.select(*fields, "n", "bucket", F.concat_ws("-", "bucket", "g", number).alias("batch"), F.pmod(F.col("i"), F.col("per")).cast("long").alias("slot"), (F.col("bucket") - F.col("n")).alias("padding"))
    return out.toDF(*keep, "n_words", "bucket", "batch", "slot", "padding")
