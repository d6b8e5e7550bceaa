import random

import numpy as np

from strandloom.llm import toxicity
from tests.llm.test_text_ops import SCHEMA, odd_documents


def corpus(n=600, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "ke", "lo", "mi", "nu", "ro", "sta", "ti"]) for _ in range(r.randrange(1, 4)))
    rows = []
    for i in range(n):
        toxic = int(r.random() < 0.15)
        words = [word() for _ in range(r.randrange(20, 200))]
        for _ in range(r.randrange(1, 6) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["Vilezz", "grubzak", "snarkling" + r.choice(["s", "er", "ed"])]))
        rows.append((i, " ".join(words), toxic))
    return rows


def examples(rows):
    terms = [toxicity.term_counts(t, {}) for t, _ in rows]
    return toxicity.Examples(terms, [y for _, y in rows])


def vector(index, text):
    h, _, c = toxicity.term_counts(text, {})
    known = [(index.terms[k], n) for k, n in zip(h.tolist(), c.tolist(), strict=True) if k in index.terms]
    return index.weigh(np.array([k for k, _ in known], np.int64), np.array([n for _, n in known], np.int64))


def test_nearest_is_exact():
    rows = corpus(300)
    index = toxicity.Index(examples([r[1:] for r in rows]), [i for i, *_ in rows], k=7)
    dense = np.zeros((len(rows), len(index.terms)))
    for d, (_, t, _) in enumerate(rows):
        tid, w = vector(index, t)
        dense[d, tid] = w
    for d in range(0, 300, 3):
        tid, w = vector(index, rows[d][1])
        sims = dense[:, tid] @ w if len(tid) else np.zeros(len(rows))
        want = sorted(((round(float(s), 9), -i) for i, s in enumerate(sims) if s > 0), reverse=True)[:7]
        got = [(round(s, 9), -i) for s, i in index.nearest(tid, w)]
        assert np.allclose([s for s, _ in got], [s for s, _ in want], atol=1e-8, rtol=0)
        assert np.allclose([s for s, _ in index.all_similar(tid, w)], [s for s, _ in want], atol=1e-8, rtol=0)


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.query(docs, labels).collect()}
    held = [(got[i].predicted, y, got[i].score) for i, _, y in rows if got[i].held_out]
    assert len(held) > 80 and sum(p == y for p, y, _ in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for *_, s in held)
    one = next(r for r in got.values() if r.predicted)
    assert one.evidence and one.evidence[0].similarity > 0
    assert toxicity.clean(docs, labels).columns == docs.columns


def test_held_out_labels_are_not_used(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    key = lambda df: sorted((r.doc_id, r.score) for r in df.collect())
    assert key(toxicity.query(docs, labels)) == key(toxicity.query(docs, flipped))


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_documents(), SCHEMA).withColumnRenamed("n_words", "score")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (2, 0)], "doc_id bigint, toxic int")
    assert toxicity.query(docs, labels).count() == docs.count()
    assert toxicity.clean(docs, labels.limit(0)).count() == docs.count()
    assert {r.score for r in toxicity.query(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.query(docs.limit(0), labels).count() == 0


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b", 7, 8), (1, None, 7, 8)], "doc_id bigint, text string, score int, c0 int").withColumnRenamed("c0", "predicted")
    labels = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    out = toxicity.clean(docs, labels)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def test_few_labels_still_catch():
    """Terms are chosen at 60 to 80 labels too, and then caught are more than left."""
    test = corpus(400, seed=9)
    for n in (60, 80):
        rows = corpus(n, seed=1)
        index = toxicity.Index(examples([r[1:] for r in rows]), [i for i, *_ in rows])
        assert index.terms
        got = [(index.score(index.nearest(*vector(index, t))) >= 0.5, y) for _, t, y in test]
        caught, toxic = sum(p and y for p, y in got), sum(y for _, y in got)
        assert caught > 0.5 * toxic and sum(p and not y for p, y in got) < 0.1 * len(got)


def test_number_of_terms_has_no_cap():
    words = [chr(97 + i // 26 % 26) + chr(97 + i % 26) + chr(97 + i // 676) for i in range(1500)]
    rows = [(" ".join(words) if i % 2 else "good day", i % 2) for i in range(200)]
    rows = [(f"{t} {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}", y) for i, (t, y) in enumerate(rows)]
    index = toxicity.Index(examples(rows), list(range(200)))
    assert len(index.terms) >= 1500
