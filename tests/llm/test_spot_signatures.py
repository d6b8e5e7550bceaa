import hashlib

import numpy as np
import pytest

from strandloom.llm import spot_signatures as S
from tests.llm.test_text_ops import SCHEMA, odd_documents


def by_brute_force(rows):
    """(n_chars, sha, fingerprint) by id, for tables of distinct ids."""
    order = sorted(rows, reverse=True)
    out = {}
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        new = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        sets = [set(S.signatures_of(S.text_words(x)).tolist()) for x in (t, new, after)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out[d] = (len(t), hashlib.sha256(new.encode()).hexdigest(), like(sets[0], sets[1]), like(sets[0], sets[2]))
    return out


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_neighbours(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = by_brute_force([(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()])
    got = S.edited_neighbours(docs, parts).collect()
    assert {g.doc_id: (g.n_chars, g.edited_sha256, g.near_edited, g.near_next) for g in got} == want and len(got) == len(want)
    near = sum(g.near_edited > g.near_next for g in got if g.n_chars > 100) / sum(g.n_chars > 100 for g in got)
    assert near > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_documents(), SCHEMA)
    got = S.edited_neighbours(docs, 4).collect()
    assert len(got) == len(odd_documents())
    prints = {}
    for r, g in zip(sorted(odd_documents(), key=lambda r: (str(r[0]), str(r[1]))), sorted(got, key=lambda g: (str(g.doc_id), g.n_chars)), strict=True):
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
        if r[0] in (0, 1):
            prints[r[0]] = g.fingerprint
    assert prints[0] == prints[1] != ""
    one = docs.where("doc_id = 0")
    assert [g.near_next for g in S.edited_neighbours(one, 3).collect()] == [1.0]
    assert S.edited_neighbours(docs.limit(0), 3).count() == 0


def test_fingerprints():
    a = S.signatures_of(S.text_words("The cat sat on the mat, and the dog of the house was near it."))
    assert (S.read_fingerprint(S.write_fingerprint(a)) == a).all() and len(a) > 1
    assert S.likeness(a, a) == 1.0 and S.likeness(a, a[:0]) == 0.0 and S.likeness(a[:0], a[:0]) == 1.0


def test_pruned_likeness():
    r = np.random.default_rng(2)
    for _ in range(300):
        a, b = (np.unique(r.integers(0, 300, r.integers(0, 200))).astype(np.uint32) for _ in range(2))
        whole = len(set(a) & set(b)) / max(1, len(set(a) | set(b))) if len(a) or len(b) else 1.0
        assert S.likeness(a, b) == S.likeness(b, a) == whole
        for p in (10, 30, 80):
            assert S.likeness(a, b, p) == (whole if whole * 100 >= p - 1e-9 else 0.0)


def test_near_classes_are_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(10**6 + i, " ".join(f"w{(k * 7 + i // 4) % 90 if k < 80 else i} the" for k in range(90))) for i in range(24)] + [(10**7, None), (10**7 + 1, "")]
    rows = [tuple(r) for r in docs.collect()] + extra
    sets = {i: frozenset(S.signatures_of(S.text_words(t or "")).tolist()) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    got = S.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), ranges=4).collect()
    assert {g.doc_id: (g.n_signatures, g.class_id) for g in got} == {i: (len(x), find(i)) for i, x in sets.items()}
    assert len({g.class_id for g in got}) < len(got) - 5
