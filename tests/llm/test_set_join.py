import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import components, set_join
from tests.llm.test_text_ops import SCHEMA, odd_documents


def components_by_brute_force(rows, k, percent):
    """(id, set size, component) for each row, comparing all pairs of sets."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    distinct = list(dict.fromkeys(s for s in sets if s))
    top = {s: s for s in distinct}

    def find(s):
        while top[s] is not s:
            s = top[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                top[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            r = find(s)
            least[r] = min(least.get(r, i), i)
    return Counter((i, len(s), least.get(find(s), i) if s else i) for (i, _), s in zip(rows, sets, strict=True))


def near_copies(n=90, seed=1):
    """A chain of edits, a star of edits, shared passages and unrelated texts."""
    r = random.Random(seed)
    word = lambda: f"v{r.randrange(4000)}"
    base = [word() for _ in range(120)]
    rows = [" ".join(base)]
    for _ in range(n):
        w = base.copy()
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = word()
        rows.append(" ".join(w))
    chain = [word() for _ in range(100)]
    for _ in range(n // 3):
        chain = chain.copy()
        chain[r.randrange(len(chain))] = word()
        rows.append(" ".join(chain))
    passage = [word() for _ in range(40)]
    rows += [" ".join([word() for _ in range(30)] + passage + [word() for _ in range(20)]) for _ in range(n // 2)]
    rows += [" ".join(word() for _ in range(r.randrange(1, 12))) for _ in range(n // 3)]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_join_is_brute_force(spark, monkeypatch, k, percent):
    monkeypatch.setattr(set_join, "BAND_ROWS", 20)
    rows = near_copies()
    got = set_join.near_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), k, percent, hot=200, ranges=4)
    assert Counter(map(tuple, got.collect())) == components_by_brute_force(rows, k, percent)


def test_join_without_bands_or_broadcasts(spark, monkeypatch):
    """What the bands leave unlinked, the short lists must find."""
    monkeypatch.setattr(set_join, "LEADERS", 0)
    rows = near_copies(40, 3)
    got = set_join.near_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), ranges=3, limit=0)
    assert Counter(map(tuple, got.collect())) == components_by_brute_force(rows, 4, 85)


def test_join_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_documents(), SCHEMA)
    rows = [(r[0], r[1]) for r in odd_documents()]
    assert Counter(map(tuple, set_join.near_documents(docs).collect())) == components_by_brute_force(rows, 4, 85)
    kept = set_join.first_of_groups(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[0] == 1 and ids[1] == 0 and ids[2] == 1 and ids[3] == 1 and ids[4] == ids[5] == 1
    assert set_join.near_documents(docs.limit(0)).count() == 0


def test_join_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, set_join.near_documents(docs).collect())) == components_by_brute_force(rows, 4, 85)


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_pairs_between_labels():
    r = np.random.default_rng(1)
    for _ in range(100):
        n = r.integers(1, 60)
        lists = np.unique(np.sort(r.integers(0, 4, n)), return_inverse=True)[1]
        size, label, percent = r.integers(1, 30, n), r.integers(0, 4, n), int(r.choice([50, 80, 85]))
        by = np.lexsort((size, lists))
        size, label = size[by], label[by]
        got = [(a, b) for x, y in set_join.pairs_apart(lists, size, label, percent) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        want = [(i, j) for i in range(n) for j in range(i + 1, n) if lists[i] == lists[j] and label[i] != label[j] and 100 * size[i] >= percent * size[j]]
        assert sorted(got) == want


def test_large_group_is_not_paired_with_itself():
    """200,000 sets of one group and one other share a token: 200,000 pairs are met."""
    n = 200_000
    s1, label = np.arange(n + 1), np.r_[np.zeros(n, np.int64), n]
    assert sum(len(x) for x, _ in set_join.pairs_apart(np.zeros(n + 1, np.int64), np.full(n + 1, 9), label, 85)) == n
    blob = set_join._pack_lists(s1, label, np.full(n + 1, 9), np.full(n + 1, 7, np.uint64), s1, np.zeros(n + 1, np.int64))
    got = set_join.merge_short_lists([blob], 85)
    assert len(got) == n and (got["b"] == n).all()


def test_lists_packed():
    r = np.random.default_rng(2)
    s1 = r.integers(-(2**63), 2**63, 1000)
    label = np.where(r.random(1000) < 0.1, s1[0], s1)
    given = (s1, label, r.integers(1, 9000, 1000), r.integers(0, 2**56, 1000).astype(np.uint64), np.arange(1000), r.integers(0, 99, 1000))
    packed = set_join._pack_lists(*given)
    assert all((x == y).all() for x, y in zip(given, set_join._unpack_lists(packed), strict=True))
    assert len(zlib.compress(packed)) < 24 * 1000  # sent one by one these took 40 bytes an entry


def test_leaders_of_a_cluster(spark):
    """Copies of one text, with up to three words of 150 edited, become one group."""
    r = random.Random(5)
    base, rows = [f"v{r.randrange(4000)}" for _ in range(150)], []
    for i in range(600):
        w = base.copy()
        for _ in range(r.randrange(4)):
            w[r.randrange(150)] = f"e{r.randrange(10**6)}"
        rows.append((0, 0, i, set_join.pack_set(set_join.token_set(" ".join(w), 4))))
    links = set_join._leaders(spark.createDataFrame(rows, "group bigint, salt int, s1 bigint, tokens binary"), 85)
    labels = Counter(x.label for x in components.components(links.select(F.col("x").alias("u"), F.col("leader").alias("v"))).collect())
    assert max(labels.values()) >= 400  # of 600; with links to the first leader alone 179


def test_overlap():
    a, b = np.array([1, 5, 9], np.uint64), np.array([2, 5, 9, 11], np.uint64)
    assert set_join.overlap(a, b) == set_join.overlap(b, a) == 2 and set_join.overlap(a, a[:0]) == 0
    assert set_join.linked(a, a, 100) and not set_join.linked(a, b, 50)
