import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import lm_score, packing, substring_dedup, token_store

SCHEMA = "doc_id bigint, text string, lang string, n_words string"


def odd_documents():
    """Nulls, empties, repeats, long texts and a clashing column."""
    base = " ".join(f"w{i % 97}" for i in range(300))
    texts = [base, base, "a b c", "", None, " \n\t ", "x" * 5000, base[100:] + " tail of it", "Pre " + base[:400] + " mid " + base[200:900], "née  double  space \n end ", "the same the same the same " * 30]
    rows = [(i, t, "en", "z") for i, t in enumerate(texts)]
    return rows + [(3, "a b c", None, None), (None, base, "en", None), (2, "a b c", "en", "z"), (None, None, None, None)]


def removed_by_brute_force(rows, width=20):
    """The contract's rule, word by word."""
    key = lambda r: (r[0] if r[0] is not None else 2**63, r[1] or "")
    words = {key(r): (r[1] or "").encode().split() for r in rows}
    first, out = {}, {}
    for k in sorted(words):
        w = words[k]
        gone = set()
        for i in range(len(w) - width + 1):
            if first.setdefault(tuple(w[i : i + width]), (k, i)) != (k, i):
                gone.update(range(i, i + width))
        out[k] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out, key


def test_substring_dedup_is_brute_force(spark):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    want, key = removed_by_brute_force(rows)
    got = substring_dedup.dedup(docs).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(set)
    for r in rows:
        by_id[r[0]].add(want[key(r)])
    for g in got:
        assert (g.n_words, g.n_removed, g.kept_sha256) in by_id[g.doc_id]


def test_substring_dedup_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, key = removed_by_brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    want = {k[0]: v for k, v in want.items()}
    got = {g.doc_id: (g.n_words, g.n_removed, g.kept_sha256) for g in substring_dedup.dedup(docs, ranges=5).collect()}
    assert got == want and sum(v[1] for v in got.values()) > 0


def traced_peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_substring_dedup_takes_little_memory(monkeypatch):
    """Of a worker, beside what it is given; what it finds is that of the whole chunk."""
    monkeypatch.setattr(substring_dedup, "CHUNK_HITS", 1000, raising=False)
    rng, chunk = np.random.default_rng(7), substring_dedup._Chunk(20, 16)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 1000))) for _ in range(100)]
    rows = [(i, texts[i % 100] if i < 110 else " ".join(map(str, rng.integers(0, 10**6, 1000)))) for i in range(300)]
    for i, t in rows:
        chunk.add(i, 0, t)
    windows = sum(len(r[2]) for r in chunk.rows)
    (blobs, size), peak = traced_peak(lambda: ([], 0) if (sent := chunk.send()) is None else (x := list(sent), sum(len(b) for _, _, b in x)))
    assert peak - size < 30 * windows
    hits = [substring_dedup._unpack_hits(b) for _, kind, b in blobs if kind == 1]
    got = {(int(i), int(p), int(o), int(p + d)) for h in hits for i, _, p, o, d in zip(*(c.astype(np.int64) for c in h), strict=True)}
    assert got == {(i, p, i - 100, p) for i in range(100, 110) for p in range(981)}
    one = [b for r, kind, b in blobs if kind == 0 and r == 3]
    given = [bytes(b) for b in one * 3]
    found, peak = traced_peak(lambda: substring_dedup._repeats(one))
    assert found is None and peak < 2 * sum(map(len, one))
    assert not len(substring_dedup._repeats(given)[0])  # each window is a twin of itself


def test_rewrite_keeps_columns_and_clean_texts(spark):
    docs = spark.createDataFrame(odd_documents(), SCHEMA)
    out = substring_dedup.rewrite(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.text for r in out.where("doc_id = 9").collect()} == {"née  double  space \n end "}
    assert substring_dedup.rewrite(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=0, max_size=400))
def test_re_pair_round_trip(ids):
    a = np.array(ids, np.uint32)
    symbols, rules, lengths = token_store.compress(np.tile(a, 8), 10)
    whole = token_store.decode(symbols, rules, lengths, 10)
    assert (whole == np.tile(a, 8)).all() and len(symbols) <= 8 * len(ids)
    for s, e in ((0, 5), (len(ids), 3 * len(ids)), (7, 7)):
        assert (token_store.decode(symbols, rules, lengths, 10, s, e) == np.tile(a, 8)[s:e]).all()


def test_re_pair_ends_when_no_pair_is_frequent():
    words = np.random.default_rng(3).integers(0, 40, (30, 6))
    ids = words[np.random.default_rng(4).integers(0, 30, 4000)].ravel().astype(np.uint32)
    symbols, rules, lengths = token_store.compress(ids, 40)
    keys, counts = np.unique(symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:], return_counts=True)
    a, b = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    assert counts[a != b].max() < 4 and len(symbols) < len(ids) / 6
    assert (token_store.decode(symbols, rules, lengths, 40) == ids).all() and lengths.max() > 6


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\u00e9\n\t.,'!|_5ß\x00", max_size=30))
def test_pieces_equal_whole_texts(text):
    global PIECES
    PIECES = globals().get("PIECES") or token_store.Pieces(vocabulary(), most=50)
    assert PIECES.encode([text]) == [PIECES.whole(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", " ", "\n", "\n", "a", "Bc", "é", "5", ",", ".'", "'s", "\u00a0", "\t", "\x1c", "\x00", "÷", "日", "<|endoftext|>"]), max_size=12).map("".join), max_size=4))
def test_pieces_of_texts_encoded_together(texts):
    global PIECES
    PIECES = globals().get("PIECES") or token_store.Pieces(vocabulary(), most=50)
    assert PIECES.encode(texts) == [PIECES.whole(t) for t in texts]


def test_pieces_are_cut_at_line_feeds_and_marks():
    p = token_store.Pieces(vocabulary())
    words = ["abra", "Bebra", "cé", "Dodra5", "eh"]
    texts = [f"x {a}{m}\n{b}{m} {a}" for a in words for b in words for m in ".,;"]
    assert p.encode(texts) == [p.whole(t) for t in texts]
    assert len(p) <= 2 * len(words) + 3 * 4 + 3  # and not one of each two words


def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("small", [True, False])
def test_token_files_round_trip(spark, small):
    from tokenizers import Tokenizer

    v = vocabulary()
    t = Tokenizer.from_str(v)
    docs = spark.createDataFrame(odd_documents(), SCHEMA) if small else spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0]))
    want = Counter()
    ends, at = {}, 0
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        ends.setdefault(i, []).append((at, len(ids)))
        at += len(ids)
    got = token_store.read(token_store.write(docs, v, shard_tokens=500)).collect()
    assert Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in got) == want
    assert sorted(g.start for g in got) == sorted(np.cumsum([0, *[g.n_tokens for g in sorted(got, key=lambda g: g.start)]])[:-1].tolist())
    order = [g.doc_id for g in sorted(got, key=lambda g: g.start)]
    assert order == [i for i, _ in rows]
    assert token_store.read(token_store.write(docs.limit(0), v)).count() == 0


def model_by_brute_force(rows):
    """The columns of lm_score.score from plain counters."""
    sums = [zlib.crc32(("" if i is None else str(i)).encode()) for i, _ in rows]
    role = ["held" if x % 5 == 1 else "aside" if x // 5 % 5 == 0 else "kept" for x in sums]
    toks = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]

    def counted(roles):
        texts = [ws for (_, ws), r in zip(toks, role, strict=True) if r in roles]
        pairs = Counter(p for ws in texts for p in zip(["start", *ws], ws, strict=False))
        words = Counter(w for ws in texts for w in ws)
        return words, pairs, words | {"start": len(texts)}, sum(words.values())

    c, c2, ch, n = counted({"kept", "aside"})
    k, k2, kh, n_kept = counted({"kept"})
    _, aside, _, _ = counted({"aside"})
    v = len(c)
    bucket = lambda x: min(lm_score.BUCKETS - 1, int(math.log2(x)))
    histogram = np.zeros((lm_score.BUCKETS, lm_score.CELLS))
    for (h, w), times in aside.items():
        if kh.get(h):
            ratio = k2[h, w] / kh[h] / ((k[w] + 0.5) / (n_kept + 0.5 * (v + 1)))
            histogram[bucket(kh[h]), lm_score.cell(np.array([ratio]))[0]] += times
    weights = lm_score.learn(histogram)

    def p(h, w):
        base = (c[w] + 0.5) / (n + 0.5 * (v + 1))
        x = weights[bucket(ch[h])] if ch.get(h) else 0.0
        return x * (c2[h, w] / ch[h] if x else 0.0) + (1 - x) * base

    out = []
    for (i, ws), r in zip(toks, role, strict=True):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        out.append((i, r == "held", len(ws), sum(c[w] > 0 for w in ws), n, base, sum(math.log10(p(h, w)) for h, w in zip(["start", *ws], ws, strict=False))))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_language_model(spark, small):
    docs = spark.createDataFrame(odd_documents(), SCHEMA) if small else spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: (str(r[0]), *map(str, r[1:5]), round(r[5], 5), round(r[6], 5))
    want = sorted(map(key, model_by_brute_force(rows)))
    packed, joined = lm_score.score(docs).collect(), lm_score.score(docs, broadcast_bytes=0).collect()
    assert sorted(map(key, packed)) == want == sorted(map(key, joined))
    if not small:
        held = [g for g in packed if g.held_out]
        assert sum(g.score for g in held) > sum(g.base_score for g in held)
    assert lm_score.score(docs.limit(0)).count() == 0


def test_language_model_sends_no_lone_words(spark, monkeypatch):
    """Words that occur once are most words; they don't turn the model to joins, and every score is that of all words."""
    r = random.Random(3)
    rows = [(i, " ".join(r.choice([f"a{r.randrange(40)}", f"b{r.randrange(400)}", f"once{r.randrange(10**9)}"]) for _ in range(60))) for i in range(150)]
    words = Counter(w for _, t in rows for w in t.split())
    again = 1 + sum(n > 1 for n in words.values())
    monkeypatch.setattr(lm_score, "_by_joins", None)
    got = lm_score.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), broadcast_bytes=14 * again).collect()
    assert 20 * again < 10 * len(words)
    key = lambda r: (r[0], *r[1:5], round(r[5], 5), round(r[6], 5))
    assert sorted(map(key, got)) == sorted(map(key, model_by_brute_force(rows)))


def test_language_model_sums_to_one():
    hist = np.zeros((lm_score.BUCKETS, lm_score.CELLS))
    hist[3, 0], hist[3, lm_score.CELLS // 2 + 9 * lm_score.PER_OCTAVE] = 50, 50
    w = lm_score.learn(hist)
    assert 0 < w[3] < 1 and w[0] == 0


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 4))
def test_bounds_are_optimal(histogram, k):
    from itertools import combinations

    lengths, counts = zip(*sorted(histogram.items()), strict=True)
    got = packing.best_bounds(list(lengths), list(counts), k)
    best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in combinations(lengths[:-1], min(k, len(lengths)) - 1))
    assert len(got) <= k and got[-1] == lengths[-1] and padding(lengths, counts, got) == best


def test_packing(spark):
    docs = spark.createDataFrame(odd_documents(), SCHEMA).withColumnRenamed("n_words", "slot")
    rows = packing.pack(docs, buckets=3, budget=700, group=4).collect()
    assert len(rows) == docs.count()
    words = Counter((r.doc_id, len((r.text or "").split())) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words) for r in rows) == words
    batches = defaultdict(list)
    for r in rows:
        assert r.bucket >= r.n_words and r.padding == r.bucket - r.n_words
        batches[r.batch].append(r)
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1 and sorted(r.slot for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].bucket <= 700
    assert packing.pack(docs.limit(0)).count() == 0
