"""Language-model scores by deleted interpolation.

P(w | h) = l(b) * c(h, w) / c(h) + (1 - l(b)) * base(w), where base is the unigram
estimate (c + 0.5) / (N + 0.5 (V + 1)) and b the bucket of the context's count
c(h), by powers of two. Each bucket's weight l is learned by expectation-maximisation
on held-out counts: one training document in five (by the next remainder of its id's
checksum) is set aside, the estimates for its bigrams are taken from the counts of the
others, and the ratios of the two estimates, as a histogram per bucket (``PER_OCTAVE``
cells for each doubling), are all that EM needs. The final estimates count all training
documents. A document starts in a context of its own and ends with an end token. The
order is two: contexts are single words.

Flow, over all documents: word counts by hash range; each task then sums each document's
equal bigrams and sends them as pairs of word numbers, packed in one binary row per chunk
and hash range, to the range of the pair, where they are counted and compared; what counts
above the document's own occurrence is stored. After EM a last scan sums what a document
can know of itself, and the stored counts add their corrections, summed per chunk's
documents (whose ids travel once) before they become rows. Ranges are as many as their words need
(``RANGE_WORDS`` each).

The words sent to all tasks are those of training documents that occur again there or
in a scored one. Any other word of a training document is known to occur once, where it
stands: none of its bigrams has another occurrence, and no other document asks for it.
Word counts are sent only if they fit ``broadcast_bytes``, at ``WORD_BYTES`` each; beyond
it the same model is computed by joins (``_by_joins``), which is much slower.

Defined cases: null text is empty: one end token; without training rows every
count is 0 and both scores are those of the smoothed base; null ids train as the
empty id's remainder says; repeated rows train each and score alike.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import byte_words, hash_words, mix, released, released_group, small_batches, stored
from strandloom.llm.substring_dedup import _planes, _unplanes, keyed

END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # no word has a line feed
BUCKETS, CELLS, PER_OCTAVE = 40, 4096, 32  # cells of log2 of the ratio; cell 0: ratio 0
CHUNK_WORDS, RANGE_WORDS, SLICE_ROWS = 400_000, 1_000_000, 256
START, WORD_BYTES = 0, 14  # number of a document's start; hash, number and two small counts


KEPT, HELD, ASIDE = 0, 1, 2  # of documents: training, scored only, training set aside for the weights


class Vocabulary:
    """Word numbers, by falling count, and counts. Number START is the start of a
    document, ``unknown`` any word that is not held, ``lone`` such a word where it is
    known to occur once in training."""

    def __init__(self, hashes: np.ndarray, number: np.ndarray, counts: tuple, kept: tuple, v: int, n: int, n_kept: int):
        """hashes: sorted, with their numbers; counts of all training documents and of
        those kept when weights are learned, by number: the large ones, then bytes; v:
        all distinct training words."""
        self.hashes, self.number, self.counts, self.kept = hashes, number, counts, kept
        self.v, self.n, self.n_kept, self.unknown, self.lone = v, n, n_kept, len(hashes) + 1, len(hashes) + 2
        self.bits = max(1, min(24, len(hashes).bit_length() - 2))
        self.first = np.r_[np.searchsorted(hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)), len(hashes)].astype(np.int32)

    @staticmethod
    def arrays(hashes: np.ndarray, counts: np.ndarray, kept: np.ndarray) -> tuple:
        """What __init__ takes first, from words and their counts in any order."""
        falling = np.lexsort((hashes, -counts))
        number = np.empty(len(hashes), np.uint32)
        number[falling] = np.arange(1, len(hashes) + 1, dtype=np.uint32)
        large, ends, by_number = int((counts > 255).sum()), hashes == END, []
        for c, once in ((counts, 1), (kept, 0)):
            documents, c = c[ends].sum(), c[falling]
            by_number.append((np.r_[documents, c[:large]].astype(np.int64), np.r_[c[large:], 0, once].astype(np.uint8)))
        order = np.argsort(hashes)
        return hashes[order], number[order], *by_number

    @staticmethod
    def _of(counts: tuple, w: np.ndarray) -> np.ndarray:
        large, small = counts
        out = large[np.minimum(w, len(large) - 1)]
        rest = np.flatnonzero(w >= len(large))
        out[rest] = small[w[rest] - len(large)]
        return out

    def count(self, w: np.ndarray) -> np.ndarray:
        return self._of(self.counts, w)

    def count_kept(self, w: np.ndarray) -> np.ndarray:
        return self._of(self.kept, w)

    def find(self, h: np.ndarray) -> np.ndarray:
        cell = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.first[cell], self.first[cell + 1]
        del cell
        out = np.full(len(h), self.unknown, np.uint32)
        todo = np.flatnonzero(at < stop)
        while len(todo):
            same = self.hashes[at[todo]] == h[todo]
            hit = todo[same]
            out[hit] = self.number[at[hit]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < stop[todo]]
        return out

    def base(self, w: np.ndarray) -> np.ndarray:
        return (self.count(w) + 0.5) / (self.n + 0.5 * (self.v + 1))


def bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.log2(np.maximum(count, 1)).astype(np.int64))


def cell(ratio: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.clip(np.round(PER_OCTAVE * np.log2(np.maximum(ratio, 1e-300))) + CELLS // 2, 1, CELLS - 1), 0).astype(np.int64)


def learn(histogram: np.ndarray, rounds: int = 60) -> np.ndarray:
    """EM for each bucket's weight; histogram: BUCKETS x CELLS counts of ratios."""
    ratio = np.r_[0.0, 2.0 ** ((np.arange(1, CELLS) - CELLS // 2) / PER_OCTAVE)]
    weight = np.where(histogram.sum(1) > 0, 0.5, 0.0)
    total = np.maximum(1, histogram.sum(1))
    for _ in range(rounds):
        part = weight[:, None] * ratio
        weight = (histogram * part / np.maximum(part + 1 - weight[:, None], 1e-300)).sum(1) / total
    return np.minimum(weight, 1 - 1e-9)


def _tokens(batch: pa.RecordBatch):
    """Token hashes of a slice's texts, end tokens included, and counts per text."""
    words = [byte_words(t, lower=True) for t in batch.column("text").to_pylist()]
    n = np.array([len(w) for w in words], np.int64)
    flat = hash_words([w for ws in words for w in ws])
    out = np.empty(len(flat) + len(words), np.uint64)
    ends = np.cumsum(n + 1) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = flat, END
    return out, n + 1


def _chunks(batches):
    """(ids, text hashes, roles, token hashes, token counts) of about
    CHUNK_WORDS words at a time."""
    held, words = [], 0
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            s = b.slice(at, SLICE_ROWS)
            h, n = _tokens(s)
            held.append((*(np.array(s.column(c)) for c in ("__id", "__th", "role")), h, n))
            words += len(h)
            if words >= CHUNK_WORDS:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, words = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _pack_docs(ids: np.ndarray, ths: np.ndarray) -> bytes:
    """12 bytes for each document: id and text hash."""
    return _planes(np.diff(ids, prepend=0).astype("<i8")) + ths.astype("<i4").tobytes()


def _unpack_docs(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = len(b) // 12
    return np.cumsum(_unplanes(b[: 8 * k], "<i8")), np.frombuffer(b, "<i4", k, 8 * k).astype(np.int64)


def _by_range(part: np.ndarray, ranges: int):
    by = np.argsort(part.astype(np.int16) if ranges < 1 << 15 else part, kind="stable")
    cuts = np.searchsorted(part[by], np.arange(ranges + 1))
    return [(r, by[cuts[r] : cuts[r + 1]]) for r in range(ranges) if cuts[r + 1] > cuts[r]]


def word_counts(rows: DataFrame, ranges: int, kept: list[str] | None = None) -> DataFrame:
    """Stored: for each hash range the words of training rows, their counts, and those
    of rows that are not set aside; words that occur once and in no scored row apart."""

    def send(batches):
        for _, _, role, h, n in _chunks(batches):
            of = np.repeat(role, n)
            for kind in (KEPT, HELD, ASIDE):
                words, counts = np.unique(h[of == kind], return_counts=True)
                part = (words & np.uint64(0xFFFFFFFF)).astype(np.int64) % ranges
                for r, i in _by_range(part, ranges):
                    yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "kind": pa.array([kind], pa.int32()), "words": pa.array([words[i].tobytes()], pa.binary()), "counts": pa.array([counts[i].astype("<u4").tobytes()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        words = [np.frombuffer(b, "<u8") for b in t.column("words").to_pylist()]
        counts = np.concatenate([np.frombuffer(b, "<u4") for b in t.column("counts").to_pylist()])
        kind = np.repeat(np.array(t.column("kind")), [len(w) for w in words])
        keys, at = np.unique(np.concatenate(words), return_inverse=True)
        sums = np.bincount(at, counts * (kind != HELD), len(keys)).astype("<i8")
        some = np.bincount(at, counts * (kind == KEPT), len(keys)).astype("<i8")
        again = (sums > 0) & ((sums + np.bincount(at, kind == HELD, len(keys)) > 1) | (keys == END))
        lone = (sums > 0) & ~again
        blobs = {"words": keys[again], "counts": sums[again], "kept": some[again], "lone": keys[lone], "lone_kept": some[lone].astype("<u1")}
        numbers = {"t": int(again.sum()), "v": int((sums > 0).sum()), "n": int(sums.sum()), "n_kept": int(some.sum())}
        return pa.table({k: pa.array([x.tobytes()], pa.binary()) for k, x in blobs.items()} | {k: pa.array([x], pa.int64()) for k, x in numbers.items()})

    sent = rows.mapInArrow(released(send), "range int, kind int, words binary, counts binary")
    return stored(sent.groupBy("range").applyInArrow(released_group(add), "words binary, counts binary, kept binary, lone binary, lone_kept binary, t bigint, v bigint, n bigint, n_kept bigint"), "words", kept)


def _bigrams(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The context number of each token."""
    h = np.empty(len(ids), np.uint32)
    h[1:] = ids[:-1]
    h[np.cumsum(n) - n] = START
    return h


def _once(doc: np.ndarray, c: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """A document's equal bigrams as one: doc, context, word, how often; by document."""
    key = c.astype(np.uint64) << np.uint64(32) | w
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(key) else np.empty(0, np.int64)
    times = np.diff(np.r_[first, len(key)]).astype(np.uint32)
    key = key[first]
    return doc[first], (key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), times


def _compare(vocab: Vocabulary, t: pa.Table) -> pa.Table:
    """Counts of a range's bigrams: the histogram for EM and, per task's documents,
    the occurrences that have others."""
    hs, ws, ks, docs, roles, at = [], [], [], [], [], 0
    tables = [(n, d) for n, d in zip(t.column("name").to_pylist(), t.column("docs").to_pylist(), strict=True) if d is not None]
    names, sizes = [], []
    for name, b in zip(t.column("name").to_pylist(), t.column("blob").to_pylist(), strict=True):
        if not b:
            continue
        n, k = np.frombuffer(b, "<i8", 2).tolist()
        names.append(name)
        sizes.append(k)
        roles.append(np.frombuffer(b, "<u1", k, 16))
        counts = _unplanes(b[16 + k : 16 + 5 * k], "<u4")
        off = 16 + 5 * k
        for i, x in enumerate((hs, ws, ks)):
            x.append(_unplanes(b[off + 4 * n * i : off + 4 * n * (i + 1)], "<u4"))
        docs.append(np.repeat(np.arange(at, at + k, dtype=np.uint32), counts))
        at += k
    empty = np.empty(0, np.uint32)
    hs, ws, ks, docs, roles = ([empty, *x] for x in (hs, ws, ks, docs, roles))
    h, w, times, doc, role = (np.concatenate(x) for x in (hs, ws, ks, docs, roles))
    del hs, ws, ks, docs
    held = np.packbits(role == HELD).tobytes()
    role = role.astype(np.uint8)[doc]
    key = h.astype(np.uint64) << np.uint64(32) | w
    del h, w
    keys, of = np.unique(key, return_inverse=True)
    del key
    of = of.astype(np.uint32)
    c2 = np.bincount(of, times * (role != HELD), len(keys)).astype(np.int64)
    aside = np.bincount(of, times * (role == ASIDE), len(keys)).astype(np.int64)
    kh, kw = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ch = vocab.count_kept(kh)
    seen = (aside > 0) & (ch > 0)
    p2 = (c2 - aside)[seen] / ch[seen]
    p1 = (vocab.count_kept(kw[seen]) + 0.5) / (vocab.n_kept + 0.5 * (vocab.v + 1))
    histogram = np.bincount(bucket(ch[seen]) * CELLS + cell(p2 / p1), aside[seen], BUCKETS * CELLS)
    filled = np.flatnonzero(histogram)
    c2[kw == vocab.unknown] = 0  # these are different words
    more = np.flatnonzero(c2[of] - (role != HELD) >= 1)
    used, of = np.unique(of[more], return_inverse=True)
    planes = lambda x: _planes(x.astype("<u4")) if len(x) else b""
    return pa.table({
        "cells": pa.array([filled.astype("<u4").tobytes()], pa.binary()),
        "sums": pa.array([histogram[filled].tobytes()], pa.binary()),
        "keys": pa.array([_planes(keys[used]) if len(used) else b""], pa.binary()),
        "c2": pa.array([c2[used].astype("<u4").tobytes()], pa.binary()),
        "of": pa.array([planes(of)], pa.binary()),
        "times": pa.array([planes(times[more])], pa.binary()),
        "doc": pa.array([planes(doc[more])], pa.binary()),
        "names": pa.array([names], pa.list_(pa.int64())),
        "sizes": pa.array([sizes], pa.list_(pa.int32())),
        "held": pa.array([held], pa.binary()),
        "tables": pa.array([[{"name": n, "docs": d} for n, d in tables]], pa.list_(pa.struct([("name", pa.int64()), ("docs", pa.binary())]))),
    })


COMPARED = "cells binary, sums binary, keys binary, c2 binary, of binary, times binary, doc binary, names array<bigint>, sizes array<int>, held binary, tables array<struct<name:bigint,docs:binary>>"


def score(docs: DataFrame, held: int = 1, ranges: int | None = None, broadcast_bytes: int = 128 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    checksum = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    role = F.when(checksum % 5 == held, F.lit(HELD)).when(F.floor(checksum / 5) % 5 == 0, F.lit(ASIDE)).otherwise(F.lit(KEPT))
    rows = keyed(docs.select("doc_id", "text")).withColumn("role", role).select("doc_id", "__id", "__th", "role", "text")
    counted = word_counts(rows, ranges or max(8, partitions))
    size = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("t", "v", "n", "n_kept")]).first()
    ranges = ranges or max(8, partitions, -(-size.n // RANGE_WORDS))
    if WORD_BYTES * size.t > broadcast_bytes:
        return _by_joins(rows, counted, size.v, size.n, size.n_kept)
    flat, at = (np.empty(size.t, np.uint64), np.empty(size.t, np.int64), np.empty(size.t, np.int64)), 0
    for r in counted.select("t", "words", "counts", "kept").toLocalIterator():
        for x, b in zip(flat, r[1:], strict=True):
            x[at : at + r.t] = np.frombuffer(b, x.dtype)
        at += r.t
    sent = spark.sparkContext.broadcast((*Vocabulary.arrays(*flat), size.v, size.n, size.n_kept))
    del flat
    vocabulary = lambda: Vocabulary(*sent.value)

    def blob_row(r, name, blob, docs):
        return pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "name": pa.array([name], pa.int64()), "blob": pa.array([blob], pa.binary()), "docs": pa.array([docs], pa.binary())})

    def send(batches):
        vocab, part_id = vocabulary(), TaskContext.get().partitionId()
        for number, (ids, ths, out, h, n) in enumerate(_chunks(batches)):
            w = vocab.find(h)
            c = _bigrams(w, n)
            doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            del h
            docs = _pack_docs(ids, ths)
            name = xxhash.xxh3_64_intdigest(docs + np.array([part_id, number], "<i8").tobytes()) >> 1  # of these documents
            roles = out.astype("<u1").tobytes()
            yield blob_row(name % ranges, name, b"", docs)
            # a word that is not held has no bigrams elsewhere; set aside, it still tells that its context has it
            known = np.flatnonzero(((w != vocab.unknown) | np.repeat(out == ASIDE, n)) & (c != vocab.unknown))
            doc, c, w, times = _once(doc[known], c[known], w[known])
            part = (mix(c.astype(np.uint64) << np.uint64(32) | w) >> np.uint64(33)).astype(np.int64) % ranges
            for r, i in _by_range(part, ranges):
                count = np.bincount(doc[i], minlength=len(n))
                head = np.array([len(i), len(n)], "<i8").tobytes()
                yield blob_row(r, name, head + roles + _planes(count.astype("<u4")) + _planes(c[i]) + _planes(w[i]) + _planes(times[i]), None)

    compared = stored(rows.mapInArrow(released(send), "range int, name bigint, blob binary, docs binary").groupBy("range").applyInArrow(released_group(lambda t: _compare(vocabulary(), t)), COMPARED), "bigrams")
    histogram = np.zeros(BUCKETS * CELLS)
    for r in compared.select("cells", "sums").toLocalIterator():  # the cells that a range fills
        histogram[np.frombuffer(r.cells, "<u4")] += np.frombuffer(r.sums, "<f8")
    weights = learn(histogram.reshape(BUCKETS, CELLS))

    def mixed(vocab, h, w, c2):
        ch, p1 = vocab.count(h), vocab.base(w)
        lam = np.where(ch > 0, weights[bucket(ch)], 0.0)
        return lam * c2 / np.maximum(ch, 1) + (1 - lam) * p1

    def correct(batches):
        vocab = vocabulary()
        row = lambda name, docs, sums: pa.RecordBatch.from_pydict({"name": pa.array([name], pa.int64()), "docs": pa.array([docs], pa.binary()), "sums": pa.array([sums], pa.binary())})
        for b in batches:
            for r in b.to_pylist():
                for x in r["tables"]:
                    yield row(x["name"], x["docs"], None)
                if not r["of"]:
                    continue
                held = np.unpackbits(np.frombuffer(r["held"], np.uint8))[: sum(r["sizes"])]
                keys = _unplanes(r["keys"], "<u8")
                h, w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
                full = np.log10(mixed(vocab, h, w, np.frombuffer(r["c2"], "<u4")))
                own = np.stack([full - np.log10(mixed(vocab, h, w, 1)), full - np.log10(mixed(vocab, h, w, 0))])
                doc = _unplanes(r["doc"], "<u4")
                total = np.bincount(doc, own[held[doc], _unplanes(r["of"], "<u4")] * _unplanes(r["times"], "<u4"), len(held))
                at = 0
                for name, k in zip(r["names"], r["sizes"], strict=True):
                    if total[at : at + k].any():
                        yield row(name, None, total[at : at + k].tobytes())
                    at += k

    def add(t: pa.Table) -> pa.Table:
        ids, ths = _unpack_docs(next(d for d in t.column("docs").to_pylist() if d is not None))
        sums = np.sum([np.zeros(len(ids)), *[np.frombuffer(b, "<f8") for b in t.column("sums").to_pylist() if b is not None]], axis=0)
        return pa.table({"c_id": ids, "c_th": ths, "more": sums})

    corrections = (
        compared.select("keys", "c2", "of", "times", "doc", "names", "sizes", "held", "tables")
        .mapInArrow(released(correct), "name bigint, docs binary, sums binary")
        .groupBy("name")
        .applyInArrow(released_group(add), "c_id bigint, c_th bigint, more double")
        .groupBy("c_id", "c_th")
        .agg(F.avg("more").alias("more"))  # repeated rows have equal sums
    )

    def own(batches):
        vocab = vocabulary()
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                s = b.slice(at, SLICE_ROWS)
                h, n = _tokens(s)
                w = vocab.find(h)
                train = np.repeat(np.array(s.column("role")) != HELD, n)
                w[train & (w == vocab.unknown)] = vocab.lone
                c = _bigrams(w, n)
                p = np.log10(mixed(vocab, c.astype(np.int64), w.astype(np.int64), train.astype(np.float64)))
                first = np.cumsum(n) - n
                sums = [np.add.reduceat(x, first) for x in ((vocab.count(w) > 0).astype(np.int64), np.log10(vocab.base(w)), p)]
                yield pa.RecordBatch.from_arrays(
                    [s.column("doc_id"), s.column("__id"), s.column("__th"), pa.array(np.array(s.column("role")) == HELD), pa.array(n), pa.array(sums[0]), pa.array([vocab.n] * len(n), pa.int64()), pa.array(sums[1]), pa.array(sums[2])],
                    ["doc_id", "__id", "__th", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "own"],
                )

    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, __id bigint, __th bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, own double"
    out = rows.mapInArrow(released(own), ddl).join(corrections, (F.col("__id") == F.col("c_id")) & (F.col("__th") == F.col("c_th")), "left")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", (F.col("own") + F.coalesce("more", F.lit(0.0))).alias("score"))


def _by_joins(rows: DataFrame, counted: DataFrame, v: int, n: int, n_kept: int) -> DataFrame:
    """The same model by shuffled joins of distinct (document, context, word)."""

    def spread(batches):
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                s = b.slice(at, SLICE_ROWS)
                h, k = _tokens(s)
                first = np.cumsum(k) - k
                c = np.r_[np.uint64(0), h[:-1]]
                c[first] = 0
                i = np.repeat(np.arange(len(k)), k)
                yield pa.RecordBatch.from_arrays([*(s.column(x).take(pa.array(i)) for x in ("__id", "__th", "role")), pa.array(c.view(np.int64)), pa.array(h.view(np.int64))], ["d_id", "d_th", "role", "h", "w"])

    def unpack(batches):
        for b in batches:
            for r in b.to_pylist():
                lone = np.frombuffer(r["lone_kept"], "<u1").astype("<i8")
                for cols in ([np.frombuffer(r[c], "<i8") for c in ("words", "counts", "kept")], [np.frombuffer(r["lone"], "<i8"), np.ones(len(lone), "<i8"), lone]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["word", "c", "kept"])

    words = counted.mapInArrow(released(unpack), "word bigint, c bigint, kept bigint")
    end = int(END.view(np.int64)) if hasattr(END, "view") else int(END)
    contexts = words.union(words.where(F.col("word") == end).select(F.lit(0).cast("bigint"), "c", "kept"))
    copies = rows.groupBy("__id", "__th").agg(F.count("*").alias("copies"))
    tokens = rows.mapInArrow(released(spread), "d_id bigint, d_th bigint, role int, h bigint, w bigint").groupBy("d_id", "d_th", "role", "h", "w").agg(F.count("*").alias("k"))
    aside = F.coalesce(F.sum(F.when(F.col("role") == ASIDE, F.col("k"))), F.lit(0))
    pairs = tokens.where(F.col("role") != HELD).groupBy(F.col("h").alias("p_h"), F.col("w").alias("p_w")).agg(F.sum("k").alias("c2"), aside.alias("aside"))
    t = (
        tokens.join(words.select(F.col("word").alias("w"), F.col("c").alias("cw"), F.col("kept").alias("kw")), "w", "left")
        .join(contexts.select(F.col("word").alias("h"), F.col("c").alias("ch"), F.col("kept").alias("kh")), "h", "left")
        .join(pairs, (F.col("h") == F.col("p_h")) & (F.col("w") == F.col("p_w")), "left")
        .select("d_id", "d_th", "role", "k", "h", "w", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("cw", "kw", "ch", "kh", "c2", "aside")])
    )
    den = n + 0.5 * (v + 1)
    of = lambda c: F.least(F.lit(BUCKETS - 1), F.floor(F.log2(F.greatest(c, F.lit(1)).cast("double")))).cast("int")
    b = of("ch")
    ratio = (F.col("c2") - F.col("aside")) / F.col("kh") / ((F.col("kw") + 0.5) / (n_kept + 0.5 * (v + 1)))
    cells = F.when(ratio > 0, F.greatest(F.lit(1), F.least(F.lit(CELLS - 1), F.rint(PER_OCTAVE * F.log2(ratio)) + CELLS // 2))).otherwise(0).cast("int")
    histogram = np.zeros((BUCKETS, CELLS))
    for r in t.where((F.col("role") == ASIDE) & (F.col("kh") > 0)).groupBy(of("kh").alias("b"), cells.alias("x")).agg(F.sum("k").alias("k")).collect():
        histogram[r.b, r.x] = r.k
    weights = learn(histogram)
    lam = F.when(F.col("ch") > 0, F.element_at(F.array(*[F.lit(float(x)) for x in weights]), b + 1)).otherwise(0.0)
    base = (F.col("cw") + 0.5) / den
    p = lam * F.col("c2") / F.greatest("ch", F.lit(1)) + (1 - lam) * base
    sums = t.groupBy("d_id", "d_th").agg(F.sum("k").alias("n_tokens"), F.sum(F.when(F.col("cw") > 0, F.col("k")).otherwise(0)).alias("n_known"), F.sum(F.col("k") * F.log10(base)).alias("base_score"), F.sum(F.col("k") * F.log10(p)).alias("score"))
    out = rows.join(sums.join(copies, (F.col("d_id") == F.col("__id")) & (F.col("d_th") == F.col("__th"))).drop("__id", "__th"), (F.col("__id") == F.col("d_id")) & (F.col("__th") == F.col("d_th")))
    per = lambda c: (F.col(c) / F.col("copies")).cast("bigint").alias(c)
    return out.select("doc_id", (F.col("role") == HELD).alias("held_out"), per("n_tokens"), per("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), (F.col("base_score") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))


