"""Document fingerprints by spot signatures.

An anchor is a common word, the start of the text, or (so that texts without common
words have spots too) one word in ``SPARE`` by its hash; its signature is the chain
of the ``CHAIN`` content words that follow it at steps of ``STEP``, hashed to 32
bits. A document's set of signatures is its fingerprint, written as the sorted
hashes in base64: equal texts have equal fingerprints, and likeness is the Jaccard
similarity of two sets.

``near_classes`` finds the near copies among all documents. Equal fingerprints are one
node. Nodes meet in the lists of their rarest signatures, partitioned by length: a set of n
signatures is only held against those of n to n / ``percent`` % signatures, which follow it
in its list. Pairs that pass go on through the bounds of set_join (shared rare signatures,
bitmaps), and ``likeness``, which stops as soon as the threshold is out of reach, decides.
``edited_neighbours`` gets its numbers from the same pruned comparison, with no threshold.

``edited_neighbours`` needs each document and the next one by falling id: documents
are range-partitioned by exact bounds, and a document that opens a part is also
sent to the part before, so that neighbours meet without one global task.

Defined cases: null is the empty text, which has the empty fingerprint; two empty
sets have likeness 1, an empty and another set 0; words are what is between white
space, lower-cased, without punctuation at the ends; a text of fewer content
words than a chain has one signature; in a text of anchors alone all words are
content; repeated ids keep a row each and follow each
other in the order of their texts' hashes; null ids come last; a single document
is its own next.
"""

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import set_join
from strandloom.llm.common import discard, mix, released, small_batches, stored

# Common words of English, Spanish, French and German.
ANCHORS = """
a an and are as at be by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you
al como con de del el en es la las lo los más no o para pero por que se sin su un una y
au aux avec ce dans des du elle est et il le les leur mais ne nous ou par pas plus pour qui sa son sur une vous
als auch auf aus bei das dem den der des die ein eine einem einen einer er für hat im ist mit nach nicht oder sich sie sind über um und von war wie zu zum zur
""".split()  # noqa: SIM905
CHAIN, STEP, SPARE = 3, 1, 8
PUNCTUATION = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
ANCHOR_HASHES = np.sort(np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in dict.fromkeys(ANCHORS)], np.uint64))


def text_words(text: str) -> list[bytes]:
    return [s for w in text.lower().encode("utf-8", "surrogatepass").split() if (s := w.strip(PUNCTUATION))]


def signatures_of(words: list[bytes]) -> np.ndarray:
    """The sorted set of 32-bit signature hashes."""
    if not words:
        return np.empty(0, np.uint32)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    at = np.searchsorted(ANCHOR_HASHES, h)
    at[at == len(ANCHOR_HASHES)] = 0
    anchor = (ANCHOR_HASHES[at] == h) | (h % np.uint64(SPARE) == 0)
    if anchor.all():
        anchor[:] = False
    content = mix(h[~anchor])
    begin = np.concatenate([[0], np.cumsum(~anchor)[anchor]])  # first content word after each anchor
    reach = STEP * (CHAIN - 1)
    begin = begin[begin + reach < len(content)] if len(content) > reach else begin[:1]
    padded = np.concatenate([content, np.zeros(reach + 1, np.uint64)])
    begin = np.unique(begin)
    with np.errstate(over="ignore"):
        chain = np.zeros(len(begin), np.uint64)
        for j in range(CHAIN):
            chain = mix(chain * np.uint64(31) + padded[np.minimum(begin + j * STEP, len(padded) - 1)])
    return np.unique((chain >> np.uint64(32)).astype(np.uint32))


def write_fingerprint(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def read_fingerprint(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, percent: int = 0) -> float:
    """The Jaccard similarity of two sorted sets, or 0 if it is below percent / 100: that
    shows by their lengths, or as soon as too few signatures are left to reach it."""
    if not len(a) and not len(b):
        return 1.0
    a, b = sorted((a, b), key=len)
    if not len(a) or 100 * len(a) < percent * len(b):
        return 0.0
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    common, step = 0, max(64, len(a) // 8)
    for at in range(0, len(a), step):
        some = a[at : at + step]
        place = np.searchsorted(b, some)
        common += int(np.count_nonzero(b.take(place, mode="clip") == some))
        if common + len(a) - at - len(some) < need:
            return 0.0
    return common / (len(a) + len(b) - common)


def near_classes(docs: DataFrame, percent: int = 80, **how) -> DataFrame:
    """doc_id, n_signatures, class_id (the smallest doc_id reachable by links between
    fingerprints of likeness percent / 100 or more; itself for an empty one)."""
    spark = docs.sparkSession
    small_batches(spark)
    for seed in range(8):
        kept: list[str] = []

        def run(batches, seed=seed):
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    s = b.slice(at, 256)
                    sets = [signatures_of(text_words(t or "")).astype(np.uint64) for t in s.column(2).to_pylist()]
                    yield set_join.set_rows(s.column(0), s.column(1), sets, seed, spread=True)

        try:
            rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
            sets = stored(rows.mapInArrow(released(run), set_join.SETS), "spots", kept)
            out = set_join.join_sets(sets, percent, kept=kept, **how)
            if out is not None:
                return stored(out.select("doc_id", F.col("n_shingles").alias("n_signatures"), F.col("component_id").alias("class_id")), "classes")
        finally:
            discard(spark, kept)
    raise ArithmeticError("sets collide under every seed")


def edited(text: str, after: str) -> str:
    """text, with its last third replaced by the start of the text after it."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def edited_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("k"))
    steps = [i / parts for i in range(1, parts)]
    bounds = sorted({int(b) for b in rows.select("k").stat.approxQuantile("k", steps, 0.2 / parts)}) if steps else []
    limits = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.expr("cast(array() as array<bigint>)")
    rows = rows.withColumn("part", F.size(F.filter(limits, lambda b: b >= F.col("k"))))  # part 0: the largest ids
    heads = sorted((r.part, r.k) for r in rows.groupBy("part").agg(F.max("k").alias("k")).collect())  # at most ``parts`` rows
    # The first document of each part also ends the part before it; that of part 0 the last one.
    ends = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}
    own = F.struct(F.col("part"), F.lit(0).alias("ahead"))
    spot = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(p).alias("p")) for k, p in ends.items()]) if ends else None
    places = F.array(own)
    if spot is not None:
        places = F.concat(places, F.transform(F.filter(spot, lambda x: x.k == F.col("k")), lambda x: F.struct(x.p.alias("part"), F.lit(1).alias("ahead"))))
    placed = rows.select("doc_id", "text", "k", F.xxhash64("text").alias("th"), F.inline(places))
    sorted_rows = placed.repartition(parts, "part").sortWithinPartitions("part", "ahead", F.desc("k"), "th").select("part", "ahead", "doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def result(doc_id, text, own, after, then):
        new = edited(text, after)
        e = signatures_of(text_words(new)) if new != text else own
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), sha, write_fingerprint(own), write_fingerprint(e), likeness(own, e), likeness(own, then)

    def run(batches):
        last = None  # the document that waits for the next one: part, id, text, signatures
        for b in batches:
            out = []
            for part, ahead, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if last and last[0] != part:
                    last = None
                if ahead and not last:
                    continue
                own = signatures_of(text_words(text))
                if last:
                    out.append(result(*last[1:], text, own))
                last = None if ahead else (part, doc_id, text, own)
            if out:
                cols = list(zip(*out, strict=True))
                types = [b.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return sorted_rows.mapInArrow(released(run), schema)
