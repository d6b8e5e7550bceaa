"""URL filter: a blocked Bloom filter in front of an exact hash join.

Rules are (host, path, verdict). A rule fits its host and every subdomain of it
when the URL's path starts with the rule's path. Each URL has a short list of
keys (host suffix, path prefix) under which a rule that fits it must be listed;
path prefixes are taken only at the lengths that occur among the rules.

The filter is a table of blocks of eight 64-bit words; a key sets one bit in
each word of one block. Probing is an equi-join on the block number. Both the
blocks and the rules are broadcast only while their measured size is within
``broadcast_bytes``; beyond it the same joins shuffle.

Everything is DataFrame expressions. Work is done once per distinct (host,
path), which are pre-aggregated before any shuffle, so a hot URL is one row
until the last join, where adaptive skew handling splits it.

Defined cases: null URL or one without '://' has empty host and path and no
rule; an empty rule table allows everything; repeated rules count once, and
where both verdicts are listed for one rule, block wins; repeated input rows
each get their row; the longest rule wins, then the longer host.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import lower_ascii

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
WORDS = 8
KEYS_PER_BLOCK = 32  # 16 bits a key: about 1 false positive in 5,000


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _hashed(df: DataFrame, blocks: int) -> DataFrame:
    """block, and the masks m0..m7, of the columns k_host, k_path."""
    first, second = F.xxhash64("k_host", F.lit("/"), "k_path"), F.xxhash64("k_path", F.lit("#"), "k_host")
    bit = [F.shiftright(second, 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in range(WORDS)]
    one = F.lit(1).cast("long")
    return df.withColumns({"block": F.pmod(first, F.lit(blocks))} | {f"m{j}": F.call_function("shiftleft", one, b) for j, b in enumerate(bit)})


def bloom_blocks(rules: DataFrame, blocks: int) -> DataFrame:
    keys = rules.select(F.col("host").alias("k_host"), F.col("path").alias("k_path"))
    return _hashed(keys, blocks).groupBy("block").agg(*[F.bit_or(f"m{j}").alias(f"w{j}") for j in range(WORDS)])


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(fits, lambda n: F.struct(s.alias("k_host"), F.substring(path, 1, n).alias("k_path")))))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """keep columns, host, path, rule (or null) and verdict for every row of pages."""
    rules = (
        rules.select(lower_ascii(F.col("host")).alias("host"), F.col("path"), F.col("verdict"))
        .where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # 'block' sorts after 'allow'
    )
    size = rules.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("host") + F.length("path") + 32), F.lit(0)).alias("b"), F.array_sort(F.collect_set(F.length("path"))).alias("lens")).first()
    sent = lambda df, n: F.broadcast(df) if n <= broadcast_bytes else df

    rows = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not size.n:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = max(1, -(-size.n // KEYS_PER_BLOCK))
    keys = rows.select("host", "path").where("host != ''").distinct().select("host", "path", F.inline(url_keys(F.col("host"), F.col("path"), list(size.lens))))
    maybe = _hashed(keys, blocks).join(sent(bloom_blocks(rules, blocks), blocks * (WORDS + 1) * 8), "block")
    for j in range(WORDS):
        maybe = maybe.where(F.col(f"w{j}").bitwiseAND(F.col(f"m{j}")) == F.col(f"m{j}"))
    listed = rules.select(F.col("host").alias("k_host"), F.col("path").alias("k_path"), "verdict")
    hits = maybe.select("host", "path", "k_host", "k_path").join(sent(listed, size.b).hint("shuffle_hash") if size.b > broadcast_bytes else sent(listed, size.b), ["k_host", "k_path"])
    rank = F.struct(F.length(F.concat("k_host", "k_path")), F.length("k_host"), F.concat("k_host", "k_path").alias("rule"), "verdict")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("top")).select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "top.rule", "top.verdict")
    same = (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path"))
    return rows.join(best, same, "left").select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
