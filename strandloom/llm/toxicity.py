"""Toxicity by nearest labelled examples.

Terms are lower-cased letter words and their prefixes of 4 to 6 letters (so
inflected forms share a term), held as 64-bit hashes; a second term says that at least
1 % of a text's words have it. A bounded sample of labelled rows (``sample``,
a documented parameter: the rows with the smallest hash of their id) fits the
classifier: terms that the labels depend on (all that pass the cutoffs of ``CUTS``
that do best on held-out folds of the labels), their IDF, the TF-IDF vectors of the
examples, and an inverted index whose examples are dealt into blocks of
``BLOCK`` with the largest weight of each term in each block. Terms are counted where
the documents are; one task joins the counts of the sample.

A query gets its exact ``k`` nearest examples by cosine: blocks are taken in
falling order of their bound (the sum of query weight times block maximum) until
no bound exceeds the k-th similarity found. Votes weighted by similarity give a
raw share of toxic neighbours; an isotonic fit on leave-one-out votes turns it
into a probability. The neighbours are returned as evidence.

Defined cases: a null or empty text, or one without a known term, has no
neighbours and gets the share of toxic rows among such examples; null labels
and null ids do not teach; an id labelled twice counts as toxic if one row says
so; of rows that repeat an id the one whose text has the largest hash teaches;
without any labelled row every score is 0; repeated documents score alike;
equal similarities are broken by the example's order; columns are carried by place,
whatever their names.
"""

import math
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import crc_mod5, numbered, plus, released, small_batches

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
BLOCK = 512
FOLDS, GAIN = 3, 0.02
# Least support, chi2 and log odds of a term, the strictest first; the last takes all terms.
CUTS = ((6, 40.0, 2.0), (4, 20.0, 2.0), (3, 12.0, 2.0), (2, 8.0, 1.5), (1, 4.0, 1.0), (1, 0.0, 0.0))
CACHED_WORDS, CACHED_VOTES, SLICE_ROWS = 200_000, 2_000, 256
DENSE = 0x5851F42D4C957F2D  # changes a term's hash into that of its second term


def terms_of(word: str) -> list[tuple[int, int]]:
    """(hash, form) of a word's terms; form: first four letters, length, 0."""
    first = xxhash.xxh32_intdigest(word[: PREFIXES[0]]) >> 6 << 6
    forms = [("=" + word, len(word) + 1), *[(word[:k], k) for k in PREFIXES if k <= len(word)]]
    return [(xxhash.xxh3_64_intdigest(t), first | min(n, 31) << 1) for t, n in forms]


def term_counts(text: str | None, known: dict[str, tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, forms and counts of a text's terms."""
    words = WORD.findall((text or "").lower())
    hashes: list[int] = []
    forms: list[int] = []
    times: list[int] = []
    for w, c in Counter(words).items():
        found = known.get(w)
        if found is None:
            if len(known) >= CACHED_WORDS:
                known.clear()
            h, f = zip(*terms_of(w), strict=True)
            found = known[w] = (list(h), list(f))
        hashes += found[0]
        forms += found[1]
        times += [c] * len(found[0])
    keys, first, of = np.unique(np.array(hashes, np.uint64), return_index=True, return_inverse=True)
    counts = np.minimum(np.bincount(of, times, len(keys)), 65535).astype(np.uint16)
    forms_ = np.array(forms, np.uint32)[first] if len(first) else np.empty(0, np.uint32)
    dense = (counts >= 2) & (100 * counts.astype(np.int64) >= len(words))
    return np.r_[keys, keys[dense] ^ np.uint64(DENSE)], np.r_[forms_, forms_[dense] | np.uint32(1)], np.r_[counts, np.ones(dense.sum(), np.uint16)]


class Examples:
    """The labelled rows as a sparse matrix: for each entry its row, its column in
    ``keys`` and its count; row by row."""

    def __init__(self, terms: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: list[int]):
        self.labels = np.array(labels, np.int64)
        self.rows = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t[0]) for t in terms])
        self.edges = np.cumsum([0, *[len(t[0]) for t in terms]])  # where each row's entries start
        hashes, forms, counts = (np.concatenate([np.empty(0, t), *[x[i] for x in terms]]) for i, t in enumerate((np.uint64, np.uint32, np.uint16)))
        terms.clear()
        self.counts, self.cols = counts, np.empty(len(hashes), np.int32)
        keys, kinds, n = [], [], 0
        for part in range(8):  # an eighth at a time, so that sorting takes little memory
            at = np.flatnonzero(hashes >> np.uint64(61) == part)
            found, first, of = np.unique(hashes[at], return_index=True, return_inverse=True)
            self.cols[at] = of + n
            keys.append(found)
            kinds.append(forms[at[first]])
            n += len(found)
        self.keys, self.forms = np.concatenate(keys), np.concatenate(kinds)

    def informative(self, kept: np.ndarray, cut: tuple[int, float, float]) -> tuple[np.ndarray, np.ndarray]:
        """Columns of the terms that pass the cutoffs among the kept rows, the most
        informative first, and their document counts."""
        support, least_chi2, least_odds = cut
        n, n1 = int(kept.sum()), int(self.labels[kept].sum())
        if not n1 or n1 == n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        here = kept[self.rows]
        a = np.bincount(self.cols[here], self.labels[self.rows[here]], len(self.keys))
        s = np.bincount(self.cols[here], minlength=len(self.keys))
        some = np.flatnonzero((s >= support) & (s < n))
        a, s = a[some], s[some]
        odds = np.abs(np.log((a + 0.5) / (n1 + 1)) - np.log((s - a + 0.5) / (n - n1 + 1)))
        chi2 = n * (a - s * n1 / n) ** 2 / np.maximum(1e-9, s * n1 / n * (n - s) * (n - n1) / n)
        good = (odds >= least_odds) & (chi2 >= least_chi2)
        some, a, s, chi2 = some[good], a[good], s[good], chi2[good]
        # prefixes of one word on the same rows say the same: the longest stays
        form = self.forms[some].astype(np.int64)
        same = np.stack([form >> 6, form & 1, a.astype(np.int64), s])
        order = np.lexsort((self.keys[some], -(form >> 1 & 31), *same))
        first = np.r_[True, (np.diff(same[:, order]) != 0).any(0)] if len(order) else np.empty(0, bool)
        chosen = order[first]
        chosen = chosen[np.lexsort((self.keys[some[chosen]], -chi2[chosen]))]
        return some[chosen], s[chosen]


def held_out_loss(rows: Examples, k: int, cut: tuple[int, float, float]) -> float:
    """The log loss of each fold's labels by an index of the other folds."""
    fold = np.empty(len(rows.labels), np.int64)
    for y in (0, 1):
        mine = np.flatnonzero(rows.labels == y)
        fold[mine] = np.arange(len(mine)) % FOLDS
    loss = 0.0
    for f in range(FOLDS):
        index = Index(rows, [], k, cut, fold != f)
        for i in np.flatnonzero(fold == f):
            p = min(max(index.score(index.all_similar(*index.row(rows, i))), 1e-6), 1 - 1e-6)
            loss -= math.log(p if rows.labels[i] else 1 - p)
    return loss


def chosen_cut(rows: Examples, k: int) -> tuple[int, float, float]:
    """The cutoffs of the least loss on held-out folds. Looser ones must lower the loss
    by GAIN, and two in a row that do not end the search."""
    if min(rows.labels.sum(), len(rows.labels) - rows.labels.sum()) < FOLDS:
        return CUTS[0]
    best, cut, failed = held_out_loss(rows, k, CUTS[0]), CUTS[0], 0
    for c in CUTS[1:]:
        loss = held_out_loss(rows, k, c)
        if loss < (1 - GAIN) * best:
            best, cut, failed = loss, c, 0
        elif failed:
            break
        else:
            failed = 1
    return cut


class Index:
    """Selected terms, example vectors and the block-max inverted index of the kept rows."""

    def __init__(self, rows: Examples, ids: list[int], k: int = 15, cut: tuple[int, float, float] | None = None, kept: np.ndarray | None = None):
        self.k, self.ids, self.cut = k, ids, cut or chosen_cut(rows, k)
        kept = np.ones(len(rows.labels), bool) if kept is None else kept
        self.labels = rows.labels[kept].astype(np.float64)
        n = len(self.labels)
        chosen, df = rows.informative(kept, self.cut)
        self.terms = {h: i for i, h in enumerate(rows.keys[chosen].tolist())}
        self.idf = np.log((1 + n) / (1 + df)) + 1
        self.number = np.full(len(rows.keys), -1)
        self.number[chosen] = np.arange(len(chosen))
        here = kept[rows.rows] & (self.number[rows.cols] >= 0)
        doc, tid = (np.cumsum(kept) - 1)[rows.rows[here]], self.number[rows.cols[here]]
        w = (1 + np.log(rows.counts[here])) * self.idf[tid]
        w /= np.sqrt(np.bincount(doc, w * w, n))[doc]
        order = np.lexsort((doc, tid))
        self.docs, self.weights, tid = doc[order].astype(np.int32), w[order], tid[order]
        self.blocks = max(1, -(-n // BLOCK))
        edges = np.arange(len(chosen))[:, None] * (self.blocks + 1) * BLOCK + np.arange(self.blocks + 1) * BLOCK
        self.start = np.searchsorted(tid * (self.blocks + 1) * BLOCK + self.docs, edges).astype(np.int32)
        self.top = np.zeros((len(chosen), self.blocks))
        np.maximum.at(self.top, (tid, self.docs // BLOCK), self.weights)
        self._calibrate(doc, order, tid)
        if ids:
            del self.number  # what remains is sent to the tasks

    @classmethod
    def load(cls, state: bytes) -> "Index":
        out = cls.__new__(cls)
        vars(out).update(pickle.loads(state))
        return out

    def row(self, rows: Examples, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The vector of a row of examples."""
        a, b = rows.edges[i : i + 2]
        tid = self.number[rows.cols[a:b]]
        return self.weigh(tid[tid >= 0], rows.counts[a:b][tid >= 0])

    def weigh(self, tid: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(tid)
        tid = tid[order]
        w = (1 + np.log(counts[order])) * self.idf[tid]
        return tid, w / np.sqrt((w * w).sum()) if len(tid) else w

    def nearest(self, tid: np.ndarray, w: np.ndarray) -> list[tuple[float, int]]:
        """The k nearest (similarity, example), exact; ties by example order."""
        if not len(tid):
            return []
        bound = w @ self.top[tid]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) >= self.k and bound[b] < best[-1][0] - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for t, x in zip(tid, w, strict=True):
                s, e = self.start[t, b], self.start[t, b + 1]
                if e > s:
                    scores[self.docs[s:e] - b * BLOCK] += x * self.weights[s:e]
            hit = np.flatnonzero(scores)
            best += [(round(float(scores[i]), 12), int(i + b * BLOCK)) for i in hit]
            best = sorted(best, key=lambda p: (-p[0], p[1]))[: self.k]
        return best

    def all_similar(self, tid: np.ndarray, w: np.ndarray, without: int = -1) -> list[tuple[float, int]]:
        """The same from the scores of all examples, which is faster for one query in
        a task that has just built the index."""
        scores = np.zeros(len(self.labels))
        for t, x in zip(tid, w, strict=True):
            s, e = self.start[t, 0], self.start[t, -1]
            scores[self.docs[s:e]] += x * self.weights[s:e]
        if without >= 0:
            scores[without] = 0
        hit = np.flatnonzero(scores)
        value = np.round(scores[hit], 12)
        if len(hit) > 4 * self.k:
            few = value >= -np.partition(-value, self.k - 1)[self.k - 1]
            hit, value = hit[few], value[few]
        order = np.lexsort((hit, -value))[: self.k]
        return list(zip(value[order].tolist(), hit[order].tolist(), strict=True))

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = sum(s for s, _ in near)
        return sum(s * self.labels[d] for s, d in near) / total if total else -1.0

    def _calibrate(self, doc: np.ndarray, order: np.ndarray, tid: np.ndarray) -> None:
        """Isotonic regression of labels on leave-one-out votes; -1: no neighbour."""
        by_doc = np.lexsort((tid, self.docs))
        edges = np.searchsorted(self.docs[by_doc], np.arange(len(self.labels) + 1))
        vectors = (by_doc[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True))
        raw = np.array([self.vote(self.all_similar(tid[v], self.weights[v], without=d)) for d, v in enumerate(vectors)])
        prior = (self.labels.sum() + 0.5) / (len(raw) + 1) if len(raw) else 0.0
        none = raw < 0
        self.none = float((self.labels[none].sum() + prior) / (none.sum() + 1))
        order = np.argsort(raw[~none], kind="stable")
        x, y = raw[~none][order], self.labels[~none][order]
        pools: list[list[float]] = []
        for v, lab in zip(x, y, strict=True):
            pools.append([v, lab, 1.0])
            while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]):
                v2, s2, n2 = pools.pop()
                pools[-1] = [v2, pools[-1][1] + s2, pools[-1][2] + n2]
        self.upto = np.array([p[0] for p in pools])
        self.prob = np.array([(p[1] + prior) / (p[2] + 1) for p in pools])

    def score(self, near: list[tuple[float, int]]) -> float:
        raw = self.vote(near)
        if raw < 0 or not len(self.upto):
            return self.none
        return float(self.prob[min(np.searchsorted(self.upto, raw), len(self.prob) - 1)])


def learned(rows: list[tuple], k: int = 15) -> bytes:
    """The state of an Index of rows (id, label, text hash, hashes, forms, counts)."""
    by_id: dict[int, tuple] = {}
    for r in rows:
        by_id[r[0]] = max(by_id.get(r[0], r), r, key=lambda x: x[2])
    by_text: dict[int, tuple] = {}
    for r in sorted(by_id.values(), key=lambda x: x[0]):  # copies of a text teach once
        old = by_text.setdefault(r[2], r)
        by_text[r[2]] = (old[0], max(old[1], r[1]), *old[2:])
    got = list(by_text.values())
    terms = [tuple(np.frombuffer(b, t) for b, t in zip(r[3:], (np.uint64, np.uint32, np.uint16), strict=True)) for r in got]
    ids, marks = [r[0] for r in got], [r[1] for r in got]
    for x in (rows, by_id, by_text, got):
        x.clear()
    return pickle.dumps(vars(Index(Examples(terms, marks), ids, k)))


def count_terms(batches):
    """id, label, text hash and term arrays of labelled texts."""
    known: dict = {}
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            s = b.slice(at, SLICE_ROWS)
            arrays = [[x.tobytes() for x in term_counts(t, known)] for t in s.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), s.column(2), *[pa.array(x, pa.binary()) for x in zip(*arrays, strict=True)]], ["id", "label", "th", "hashes", "forms", "counts"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6_000, k: int = 15) -> bytes | None:
    """The state of an Index of at most ``sample`` labelled rows; None without any."""
    small_batches(docs.sparkSession)
    taught = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("l_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("l_toxic"))
        .orderBy(F.xxhash64(F.lit(17), "l_id"), "l_id")
        .limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("th"), "text").join(F.broadcast(taught), F.col("id") == F.col("l_id"))
    counted = rows.select("id", "l_toxic", "th", "text").mapInArrow(released(count_terms), "id bigint, label int, th bigint, hashes binary, forms binary, counts binary")

    def build(batches):
        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if got:
            yield pa.RecordBatch.from_pydict({"model": [learned(got, k)]}, pa.schema([("model", pa.binary())]))

    found = counted.repartition(1).mapInArrow(released(build), "model binary").collect()
    return bytes(found[0].model) if found else None


def scored(rows: DataFrame, text: str, model: bytes | None) -> DataFrame:
    """rows with score, predicted and evidence of the column text."""
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64())]))
    schema = plus(rows, "score double, predicted int, evidence array<struct<doc_id:bigint,similarity:double>>")
    place = rows.columns.index(text)

    def run(batches):
        index = Index.load(sent.value) if sent.value else None
        known: dict[str, tuple[int, ...]] = {}
        cache: dict[tuple, tuple[float, list]] = {}

        def judge(t: str | None) -> tuple[float, list]:
            words = WORD.findall((t or "").lower())
            counts: dict[int, int] = {}
            for w, c in Counter(words).items():
                ts = known.get(w)
                if ts is None:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    ts = known[w] = tuple(h for h, _ in terms_of(w) if h in index.terms or h ^ DENSE in index.terms)
                for h in ts:
                    counts[h] = counts.get(h, 0) + c
            found = {i: c for h, c in counts.items() if (i := index.terms.get(h)) is not None}
            found |= {i: 1 for h, c in counts.items() if c >= 2 and 100 * c >= len(words) and (i := index.terms.get(h ^ DENSE)) is not None}
            key = tuple(sorted(found.items()))
            if key not in cache:
                if len(cache) > CACHED_VOTES:
                    cache.clear()
                near = index.nearest(*index.weigh(np.array(list(found), np.int64), np.array(list(found.values()), np.int64)))
                cache[key] = (index.score(near), [{"doc_id": index.ids[d], "similarity": s} for s, d in near])
            return cache[key]

        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                some = b.slice(at, SLICE_ROWS)
                got = [judge(t) if index else (0.0, []) for t in some.column(place).to_pylist()]
                out = [pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= 0.5) for s, _ in got], pa.int32()), pa.array([e for _, e in got], kind)]
                yield pa.RecordBatch.from_arrays([*some.columns, *out], schema.names)

    return rows.mapInArrow(released(run), schema)


def score(docs: DataFrame, model: bytes | None) -> DataFrame:
    """doc_id, score, predicted, and evidence: the neighbours' ids and similarities."""
    return scored(docs.select("doc_id", "text"), "text", model).drop("text")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels.where(crc_mod5() != 0))
    return score(docs, model).select("doc_id", (crc_mod5() == 0).alias("held_out"), "score", "predicted", "evidence")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with their own columns."""
    rows, place = numbered(docs)
    kept = scored(rows, place["text"], fit(docs, labels)).where("predicted = 0")
    return kept.select(*rows.columns).toDF(*docs.columns)
