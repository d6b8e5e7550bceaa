import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import decontaminate as D
from tests.llm.test_text_ops import SCHEMA, odd_documents


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=25), st.text("abc ", max_size=25), st.integers(0, 12))
def test_edit_distance(a, b, most):
    assert D.edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)


def changed(text, edits, r):
    c = list(text)
    for _ in range(edits):
        q = r.randrange(len(c))
        c[q : q + 1] = r.choice([[], ["z"], [c[q], "y"]])
    return "".join(c)


def test_recall_of_edited_items():
    r = random.Random(5)
    items = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(13, 60)))) for i in range(60)]
    found = D.Items(items, 0.1)
    hit = total = 0
    for i, t in items * 3:
        for edits in (0, 1, 2, 3):
            doc = "some words before it " * 5 + changed(t, edits, r) + " and some words after it" * 5
            got = found.search([D.normal_words(doc)])[0]
            total, hit = total + 1, hit + any(g[0] == i for g in got)
            assert all(g[0] == i for g in got)
    assert hit >= 0.97 * total


def test_table_matches_brute_force(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, " ".join(D.normal_words(r.text))) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if f" {t} " in f" {' '.join(D.normal_words(r.text))} "}
    got = D.contaminated(docs, bench).collect()
    assert len(got) == docs.count()
    found = {(g.doc_id, m.item_id): m.distance for g in got for m in g.matches}
    assert {k for k, d in found.items() if d == 0} == want and want
    in_blocks = D.contaminated(docs, bench, broadcast_bytes=500).collect()
    assert {(g.doc_id, m.item_id): m.distance for g in in_blocks for m in g.matches} == found


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_documents(), SCHEMA)
    items = spark.createDataFrame([(1, "Tail  OF it"), (2, None), (None, "a b c"), (3, ""), (1, "a b c")], "item_id bigint, text string")
    got = {(g.doc_id, tuple((m.item_id, m.first_word) for m in g.matches)) for g in D.contaminated(docs, items).collect()}
    assert (2, ((1, 0), (None, 0))) in got and (3, ()) in got and (4, ()) in got
    kept = D.clean(docs.withColumnRenamed("n_words", "matches"), items).withColumnRenamed("matches", "n_words")
    assert kept.columns == docs.columns and kept.where("doc_id = 2").count() == 0 and kept.where("doc_id = 0").count() == 1
    assert D.clean(docs, items.limit(0)).count() == docs.count() and D.contaminated(docs.limit(0), items).count() == 0


def random_item(words, r):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(words))


def nearest_window(doc, item, most):
    """(distance, first word, words) of the nearest run of words, over every window."""
    doc = " ".join(doc.split())
    starts = [0, *[i + 1 for i, c in enumerate(doc) if c == " "]]
    width = len(item) + most
    text = np.zeros((len(starts), width), np.uint32)
    for row, a in zip(text, starts, strict=True):
        row[: len(doc[a : a + width])] = [ord(c) for c in doc[a : a + width]]
    ramp = np.arange(width + 1)
    table = np.tile(ramp, (len(starts), 1))
    for c in item:
        new = table + 1
        new[:, 1:] = np.minimum(new[:, 1:], table[:, :-1] + (text != ord(c)))
        table = np.minimum.accumulate(new - ramp, axis=1) + ramp
    ends = [*[a - 1 for a in starts[1:]], len(doc)]
    least = min((int(table[i, z - a]), i, k + 1) for i, a in enumerate(starts) for k, z in enumerate(ends[i:]) if z - a <= width)
    return least if least[0] <= most else None


def check_found(items, docs, must=True):
    got = D.Items(list(enumerate(items)), 0.1).search([D.normal_words(d) for d in docs])
    found = 0
    for i, (item, doc, hits) in enumerate(zip(items, docs, got, strict=True)):
        want = nearest_window(doc, item, int(0.1 * len(item)))
        assert want or not must
        have = next(((e, p, n) for j, p, n, e in hits if j == i), None)
        assert have in (None, want)
        found += have == want
    return found


AROUND = "some words before it and after it "


def test_typos_leave_no_three_words_whole():
    r = random.Random(1)
    items = [random_item(40, r) for _ in range(25)]
    docs = []
    for t in items:
        w = t.split()
        for p in range(0, 40, 3):
            w[p] = "z" + w[p][1:]
        if sum(len(x) for x in w) + 39 >= 140:
            docs.append(AROUND + " ".join(w) + " " + AROUND)
    items = items[: len(docs)]
    assert check_found(items, docs) == len(items) == 25


def test_runs_of_inserted_and_missing_words():
    r = random.Random(2)
    items, docs = [], []
    while len(items) < 40:
        t = random_item(r.choice([40, 55, 100]), r)
        w, p, room = t.split(), r.randrange(5, 30), int(0.1 * len(t))
        run = []
        if len(items) % 2:
            while len(" ".join([*run, "zyzy"])) + 1 <= room:
                run.append("zyzy")
            w[p:p] = run
        else:
            while len(" ".join(w[p : p + len(run) + 1])) + 1 <= room:
                run.append(w[p + len(run)])
            del w[p : p + len(run)]
        items.append(t)
        docs.append(AROUND + " ".join(w) + " " + AROUND)
    assert check_found(items, docs) == len(items)


def test_recall_up_to_the_full_distance():
    """Against every window, with edits of words and characters up to the limit."""
    r = random.Random(3)
    items, docs = [], []
    for k in range(200):
        t = random_item(r.choice([3, 8, 20, 40]), r)
        w, room = t.split(), int(0.1 * len(t))
        while k % 2 and room > 0:  # words replaced, left out or added
            p, new = r.randrange(len(w)), random_item(r.randrange(0, 3), r).split()
            room -= max(len(w[p]), len(" ".join(new))) + 1
            if room >= 0 and len(w) > 1:
                w[p : p + 1] = new
        text = " ".join(w)
        items.append(t)
        docs.append(AROUND + (text if k % 2 else changed(text, room, r)) + " " + AROUND)
    want = sum(nearest_window(d, t, int(0.1 * len(t))) is not None for t, d in zip(items, docs, strict=True))
    found = check_found(items, docs, must=False)
    assert want > 150
    assert found >= 0.97 * len(items)  # the search's target; a text without a window counts where none is reported


def test_few_keys_are_searched_and_none_is_lost(monkeypatch):
    """The filters before the binary search keep every agreeing window, and little else."""
    r = random.Random(4)
    items = [random_item(r.choice([8, 20, 40]), r) for _ in range(60)]
    docs = [" ".join([random_item(60, r), changed(t, 3, r), random_item(60, r), "", items[-1 - i]]) for i, t in enumerate(items)]
    found = D.Items(list(enumerate(items)), 0.1)
    text = "\n".join(" ".join(D.normal_words(d)) for d in ["", *docs, ""])
    offsets = np.cumsum([0, *[len(t) + 1 for t in text.split("\n")]])
    chars, searched, plain = D.characters(text), [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x, **y: searched.append(np.size(v)) or plain(a, v, *x, **y))
    every = lambda _, o: np.ones((len(found.classes), len(o) - 1), bool)
    monkeypatch.setattr(found, "holding", every, raising=False)
    clean = D.characters(" ".join(random_item(60, r) for _ in range(100)))
    found.regions(clean, np.array([0, len(clean) + 1]))
    assert sum(searched) < 2 * 6000  # words
    monkeypatch.undo()
    monkeypatch.setattr(found, "holding", every, raising=False)
    monkeypatch.setattr(found, "likely", lambda d, *_: np.ones(len(d), bool), raising=False)
    regions = list(found.regions(chars, offsets)[0])
    letters, want = D.letters(chars), []
    words = np.array([i for i in range(len(text)) if i == 0 or text[i - 1] in " \n"])
    for c in found.classes:
        known = {}
        for k, x in zip(c.known.tolist(), c.order.tolist(), strict=True):
            known.setdefault(k, []).append(x % len(c.item))
        doc = np.array([text.count("\n", 0, i) for i in words])
        first = c._first(words - offsets[doc], doc)
        agree = {(i, w) for h, named in zip(c.walks.keys(letters, words[first]), c.names(len(c.flags)), strict=True) for i, k in enumerate((h + named).tolist()) for w in known.get(k, ())}
        for i, w in agree:
            p, d, j = words[first][i], doc[first][i], c.item[w]
            begin = p - c.shift[w]
            want.append((d, j, max(begin - found.most[j], offsets[d]), min(begin + found.lengths[j] + found.most[j], offsets[d + 1] - 1)))
    merged = []
    for d, j, a, z in sorted(map(lambda x: tuple(map(int, x)), want)):
        if merged and merged[-1][:2] == [d, j] and a <= merged[-1][3]:
            merged[-1][3] = max(merged[-1][3], z)
        else:
            merged.append([d, j, a, z])
    assert [list(x) for x in regions] == merged and len(merged) >= 100


def test_texts_that_cannot_match_are_not_walked(monkeypatch):
    r = random.Random(6)
    items = [random_item(r.choice([1, 3, 8, 20, 40]), r) for _ in range(60)]
    docs = [random_item(300, r).translate(str.maketrans("abcd", "wxyz")) for _ in range(30)]
    docs += [d + " " + changed(t, int(0.1 * len(t)), r) for d, t in zip(docs, items, strict=False)]
    found, walked = D.Items(list(enumerate(items)), 0.1), []
    want = [found.search([d.split()]) for d in docs]
    keys = "sampled" if hasattr(D.Walks, "sampled") else "keys"
    plain = getattr(D.Walks, keys)
    monkeypatch.setattr(D.Walks, keys, lambda self, text, starts: walked.append((self.steps, len(starts))) or plain(self, text, starts))
    assert [found.search([d.split()]) for d in docs[:30]] == want[:30]
    assert not sum(n for steps, n in walked if steps >= 57)  # shorter items have too few runs
    walked.clear()
    monkeypatch.setattr(D, "MOST_APART", -1)
    assert [found.search([d.split()]) for d in docs] == want and sum(n for _, n in walked) > 0
    assert sum(map(len, (x for w in want for x in w))) >= 25
