"""Substring dedup by relative Lempel-Ziv parsing.

Reference blocks are the documents themselves: a position may be copied from any
position before it in (document, position) order. All windows of ``width`` words
of all documents are indexed by a 64-bit hash; the reference of a window is the
first occurrence of its word sequence. Each document is then factored greedily: a
factor starts at a window with an earlier reference and grows while the next
window's reference is the next position of the same document; where it is not,
the parse is at a factor boundary and the window there starts a factor of its own
(overlapping the last one), so no repeated window is missed between factors.
Words that factors cover are removed.

Flow: each map task hashes its documents and settles repeats among them at once,
so that it sends each word sequence once however often it holds it; what is left
goes, packed in one binary row per task and hash range, to the range of its hash
(``ranges`` of them, which no frequent passage can fill). There the first
occurrence of each sequence is found and repeated windows go back to their
documents as positions with their references.

Defined cases: null and empty texts have no words; texts of fewer than ``width``
words have no windows; null ids come last; rows that repeat an id and text are
the same document and do not remove each other's words; rows with one id and
different texts are ordered by the hash of the text.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as pa_type

from strandloom.llm.common import byte_words, hash_words, mix, plus, released, released_group, small_batches

BASE = 0x9E3779B97F4A7C15
CHUNK_WORDS, CHUNK_HITS, SLICE_ROWS = 2_000_000, 500_000, 256
BATCH_BYTES = 1 << 20  # between Python and Spark at a time: the JVM keeps what the largest batch took
HIT = np.dtype([("pos", "<u4"), ("source", "<i8"), ("source_pos", "<u4")])


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width word hashes (a polynomial in an odd base
    modulo 2^64, by prefix sums)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    inverse = pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.full(len(h), BASE, np.uint64)
        up[0] = 1
        np.multiply.accumulate(up, out=up)
        down = np.full(n, inverse, np.uint64)
        down[0] = 1
        np.multiply.accumulate(down, out=down)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * up, dtype=np.uint64)])
        return mix((sums[width:] - sums[:-width]) * down)


def _planes(a: np.ndarray) -> bytes:
    """The bytes of a, all first bytes first, which compress better."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def _unplanes(b: bytes, dtype) -> np.ndarray:
    d = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(d.itemsize, -1).T).view(d).ravel()


HITS = ("<i8", "<i4", "<u4", "<i8", "<i4")  # id, text hash, position, source, shift to its position


def _pack_hits(k_id, k_text, pos, s_id, s_pos, buckets: int):
    """(bucket of the document, blob) of repeated windows."""
    cols = [np.asarray(c).astype(t) for c, t in zip((k_id, k_text, pos, s_id, np.asarray(s_pos, np.int64) - pos), HITS, strict=True)]
    at = (mix(cols[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((cols[2], cols[1], cols[0], at))
    cols, at = [c[order] for c in cols], at[order]
    cuts = np.searchsorted(at, np.arange(buckets + 1))
    return [(r, b"".join(_planes(c[cuts[r] : cuts[r + 1]]) for c in cols)) for r in range(buckets) if cuts[r + 1] > cuts[r]]


def _unpack_hits(b: bytes) -> list[np.ndarray]:
    n, at, out = len(b) // 28, 0, []
    for t in HITS:
        size = np.dtype(t).itemsize * n
        out.append(_unplanes(b[at : at + size], t))
        at += size
    return out


def read_hits(b: bytes | None) -> np.ndarray:
    """pos, source, source_pos of a document's repeated windows, by pos."""
    return np.frombuffer(b, HIT) if b else np.empty(0, HIT)


def factors(hits: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """The parse: (start, words, source document, source start), by start."""
    if not len(hits):
        return []
    pos, src = hits["pos"].astype(np.int64), hits["source_pos"].astype(np.int64)
    on = (np.diff(pos) == 1) & (np.diff(src) == 1) & (np.diff(hits["source"]) == 0)
    first = np.flatnonzero(np.r_[True, ~on])
    last = np.r_[first[1:], len(pos)] - 1
    return [(int(pos[a]), int(pos[b] - pos[a]) + width, int(hits["source"][a]), int(src[a])) for a, b in zip(first, last, strict=True)]


class _Chunk:
    """Windows of some documents, gathered before they are sent."""

    def __init__(self, width: int, ranges: int):
        self.width, self.ranges = width, ranges
        self.clear()

    def clear(self):
        self.rows: list[tuple[int, int, np.ndarray]] = []
        self.words = 0

    def add(self, k_id: int, k_text: int, text: str | None):
        h = hash_words(byte_words(text))
        if len(h) >= self.width:
            self.rows.append((k_id, k_text, window_hashes(h, self.width)))
            self.words += len(h)

    def send(self):
        """(range, kind, blob): kind 0 windows, kind 1 settled repeats of documents
        whose bucket has the range's number. Equal windows are in one range, so ranges
        are sorted one by one and what that takes is a range's share of the chunk."""
        if not self.rows:
            return
        self.rows.sort(key=lambda r: r[:2])
        ids = np.array([r[0] for r in self.rows], np.int64)
        texts = np.array([r[1] for r in self.rows], np.int64)
        ends = np.cumsum([len(r[2]) for r in self.rows])
        starts = np.r_[0, ends[:-1]]
        h = np.concatenate([r[2] for r in self.rows])
        self.clear()
        part = (h >> np.uint64(32)) % np.uint64(self.ranges)
        cuts = np.r_[0, np.cumsum(np.bincount(part.astype(np.int32), minlength=self.ranges))].tolist()
        by = np.argsort(part.astype(np.min_scalar_type(self.ranges)), kind="stable").astype(np.uint32)
        del part
        doc = lambda p: np.searchsorted(ends, p, side="right")
        hits, n_hits = [], 0
        for r in range(self.ranges):
            p = by[cuts[r] : cuts[r + 1]]
            if not len(p):
                continue
            order = np.argsort(h[p], kind="stable")
            s = h[p[order]]
            first = np.r_[True, s[1:] != s[:-1]]
            if not first.all():
                origin = order[first][np.cumsum(first) - 1]  # the first occurrence, for each sorted window
                again, of = p[order[~first]].astype(np.int64), p[origin[~first]].astype(np.int64)
                d, o = doc(again), doc(of)
                twin = (ids[d] == ids[o]) & (texts[d] == texts[o]) & (again - starts[d] == of - starts[o])
                again, of, d, o = (a[~twin] for a in (again, of, d, o))
                hits.append((ids[d], texts[d].astype(np.int32), (again - starts[d]).astype(np.uint32), ids[o], (of - starts[o]).astype(np.uint32)))
                n_hits += len(d)
                p = p[np.sort(order[first])]
            docs, counts = np.unique(doc(p), return_counts=True)
            gaps = np.diff(p, prepend=np.uint32(0)).astype("<u4")
            head = np.array([len(p), len(docs)], "<i8").tobytes()
            table = b"".join(_planes(np.diff(c, prepend=0).astype("<i8")) for c in (ids[docs], starts[docs])) + texts[docs].astype("<i4").tobytes() + _planes(counts.astype("<u4"))
            yield r, 0, head + table + _planes(gaps) + h[p].tobytes()
            if n_hits >= CHUNK_HITS:
                yield from self._settled(hits)
                n_hits = 0
        yield from self._settled(hits)

    def _settled(self, hits: list):
        """The blobs of the repeats gathered so far, which are dropped."""
        if hits:
            cols = [np.concatenate(c) for c in zip(*hits, strict=True)]
            hits.clear()
            for r, b in _pack_hits(*cols, self.ranges) if len(cols[0]) else ():
                yield r, 1, b


def _hashes(b) -> np.ndarray:
    """The hashes of the windows in a kind-0 blob."""
    n, k = np.frombuffer(b, "<i8", 2).tolist()
    return np.frombuffer(b, "<u8", n, 16 + 24 * k + 4 * n)


def _places(b, some: np.ndarray):
    """id, text hash and position of some windows, by number, in a kind-0 blob."""
    n, k = np.frombuffer(b, "<i8", 2).tolist()
    ids, starts = (np.cumsum(_unplanes(b[16 + 8 * k * i : 16 + 8 * k * (i + 1)], "<i8")) for i in (0, 1))
    texts = np.frombuffer(b, "<i4", k, 16 + 16 * k)
    counts = _unplanes(b[16 + 20 * k : 16 + 24 * k], "<u4")
    at = 16 + 24 * k
    p = np.cumsum(_unplanes(b[at : at + 4 * n], "<u4"), dtype=np.int64)[some]
    d = np.searchsorted(np.cumsum(counts, dtype=np.int64), some, side="right")
    return ids[d], texts[d], (p - starts[d]).astype(np.uint32)


def _repeats(blobs: list):
    """The windows of a hash range that occur earlier, with their references. Places
    are worked out for windows that occur again only."""
    s = np.concatenate([_hashes(b) for b in blobs])
    s.sort()
    twice = s[1:][s[1:] == s[:-1]]
    del s
    if not len(twice):
        return None
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    found = []
    for b in blobs:
        h = _hashes(b)
        at = np.searchsorted(twice, h).astype(np.uint32)
        at[at == len(twice)] = 0
        some = np.flatnonzero(twice[at] == h)
        found.append((at[some], *_places(b, some)))
    group, ids, texts, pos = (np.concatenate(c) for c in zip(*found, strict=True))
    del found, twice
    order = np.lexsort((pos, texts, ids, group))
    group, ids, texts, pos = group[order], ids[order], texts[order], pos[order]
    lead = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], np.arange(len(group)), 0))
    hit = (ids != ids[lead]) | (texts != texts[lead]) | (pos != pos[lead])
    lead = lead[hit]
    return ids[hit], texts[hit], pos[hit], ids[lead], pos[lead]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of a document: __id (null ids last) and __th, 32 bits
    that tell apart texts of one id."""
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)), "__th": F.shiftright(F.xxhash64("text"), 32)})


def repeated_windows(docs: DataFrame, width: int = 20, ranges: int | None = None) -> DataFrame:
    """s_id, s_th, hits: the repeated windows of each document that has any."""
    spark = docs.sparkSession
    small_batches(spark, size=BATCH_BYTES)
    ranges = ranges or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def send(batches):
        def packed(rows):
            some, size = [], 0
            for row in rows:
                some.append(row)
                size += len(row[2])
                if size >= BATCH_BYTES:
                    yield batch(some)
                    some, size = [], 0
            if some:
                yield batch(some)

        def batch(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["range", "kind", "blob"])

        chunk = _Chunk(width, ranges)
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                for i, t, x in zip(*(c.to_pylist() for c in b.slice(at, SLICE_ROWS).columns), strict=True):
                    chunk.add(i, t, x)
                if chunk.words >= CHUNK_WORDS:
                    yield from packed(chunk.send())
        yield from packed(chunk.send())

    def settle(t: pa.Table) -> pa.Table:
        r, kind = t.column("range")[0].as_py(), np.array(t.column("kind"))
        blobs = [b.as_buffer() for b in t.column("blob")]  # not copied
        out = [(r, b.to_pybytes()) for b, k in zip(blobs, kind, strict=True) if k == 1]
        found = _repeats([b for b, k in zip(blobs, kind, strict=True) if k == 0]) if (kind == 0).any() else None
        del blobs
        if found:
            out += _pack_hits(*found, ranges)
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "blob"])

    def gather(t: pa.Table) -> pa.Table:
        cols = [np.concatenate(c) for c in zip(*map(_unpack_hits, t.column("blob").to_pylist()), strict=True)]
        order = np.lexsort((cols[2], cols[1], cols[0]))
        k_id, k_text, pos, source, shift = (c[order] for c in cols)
        hits = np.empty(len(pos), HIT)
        hits["pos"], hits["source"], hits["source_pos"] = pos, source, pos + shift.astype(np.int64)
        cut = np.flatnonzero(np.r_[True, (k_id[1:] != k_id[:-1]) | (k_text[1:] != k_text[:-1])])
        blobs = [hits[a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(pos)], strict=True)]
        return pa.table({"s_id": k_id[cut], "s_th": k_text[cut].astype(np.int64), "__hits": pa.array(blobs, pa.binary())})

    rows = keyed(docs.select("doc_id", "text")).select("__id", "__th", "text")
    sent = rows.mapInArrow(released(send), "range int, kind int, blob binary")
    settled = sent.groupBy("range").applyInArrow(released_group(settle), "bucket int, blob binary")
    return settled.groupBy("bucket").applyInArrow(released_group(gather), "s_id bigint, s_th bigint, __hits binary")


def _kept(text: str | None, hits: bytes | None, width: int) -> tuple[list[bytes], int, list]:
    words = byte_words(text)
    parse = factors(read_hits(hits), width) if hits else []
    if not parse:
        return words, len(words), parse
    keep = np.ones(len(words), bool)
    for start, n, _, _ in parse:
        keep[start : start + n] = False
    return [words[i] for i in np.flatnonzero(keep)], len(words), parse


def _apply(docs: DataFrame, width: int, ranges: int | None, keep: list[str], ddl: str, row) -> DataFrame:
    """docs with their repeated windows, through row(text, hits) -> new columns."""
    hits = repeated_windows(docs, width, ranges)
    fields = [f"__{i}" for i in range(len(keep))]  # the columns that stay, by place
    base = keyed(docs).select("__id", "__th", *[F.col(c).alias(f) for c, f in zip(keep, fields, strict=True)], F.col("text").alias("__text"))

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            texts = [None if t is None else squeeze(t.encode("utf-8", "surrogatepass")) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.binary())], b.schema.names)

    packed = base.mapInArrow(released(pack), plus(base.drop("__text"), "__text binary"))  # what the join shuffles
    joined = packed.join(hits, (F.col("__id") == F.col("s_id")) & (F.col("__th") == F.col("s_th")), "left").select(*fields, "__text", "__hits")
    schema = plus(docs.select(*keep), ddl)

    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        plain = lambda t: None if t is None else expand(t).decode("utf-8", "surrogatepass")
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                s = b.slice(at, SLICE_ROWS)
                new = [row(plain(t), h) for t, h in zip(s.column(len(keep)).to_pylist(), s.column(len(keep) + 1).to_pylist(), strict=True)]
                types = [pa_type(f.dataType) for f in schema.fields[len(keep) :]]
                yield pa.RecordBatch.from_arrays([*[s.column(i) for i in range(len(keep))], *[pa.array([r[i] for r in new], t) for i, t in enumerate(types)]], schema.names)

    return joined.mapInArrow(released(run), schema)


def dedup(docs: DataFrame, width: int = 20, ranges: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the factors of every document."""

    def row(text, hits):
        kept, n, parse = _kept(text, hits, width)
        return n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": a, "words": b, "source": c, "source_start": d} for a, b, c, d in parse]

    return _apply(docs, width, ranges, ["doc_id"], "n_words bigint, n_removed bigint, kept_sha256 string, factors array<struct<start:int,words:int,source:bigint,source_start:int>>", row)


def rewrite(docs: DataFrame, width: int = 20, ranges: int | None = None) -> DataFrame:
    """docs without repeated words: texts with none removed stay as they are,
    others are their kept words joined by one space. Texts that keep no word
    become empty; n_chars, where docs have it, follows the new text."""
    others = [c for c in docs.columns if c != "text"]

    def row(text, hits):
        if not hits:
            return (text,)
        return (b" ".join(_kept(text, hits, width)[0]).decode("utf-8", "surrogatepass"),)

    out = _apply(docs, width, ranges, others, "__new string", row).withColumnRenamed("__new", "text")
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
