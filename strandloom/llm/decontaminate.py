"""Benchmark decontamination: near matches of benchmark items in documents.

A document is contaminated by an item if some run of its words is within edit
distance ``share`` * item length of it, on lower-cased text with single spaces. The
run may have any number of words: that is bounded by the distance alone.

Candidates come from CGK embeddings and bit sampling. A CGK walk copies characters of a
string to its output and moves on, or not, by a random bit of the step and the character;
strings within a small edit distance come out within a small Hamming distance. Items are
dealt into classes by length, doubling; a class has windows of ``PART`` of its least
length, and every word start of an item with that much left after it begins one. A
document's windows begin at the first word start of every cell, whose width is what the
class's windows leave of an item, so any occurrence holds the start of a window that an
item's window begins with. ``WALKS`` walks embed each window, a round samples steps of one
of them (two of its ``GROUPS`` groups of ``BITS`` sampled steps, so that groups serve many
rounds), and windows that agree in a round are candidates. Rounds are added until ``recall``
of copies of the items with random edits at the limit are found (``MOST_ROUNDS`` at most).

Texts that lack too many of an item's side by side runs of GRAM characters can't match it;
those that can't match any of a class are not walked for it, which loses nothing.
Of the candidates those go on whose surroundings share at least L - GRAM + 1 - GRAM k runs
of GRAM characters with the item, as every match with k edits does. The nearest run of whole
words there is found by exact edit distance from all word starts to all word ends at once,
and the result says which item, where, and how far.

Benchmark items are broadcast while they are within ``broadcast_bytes``; larger sets
are dealt into blocks of that size, each a pass over the documents.

Defined cases: null or empty texts and items match nothing; items too short for one
edit are found only whole; columns are carried by place, whatever their names; repeated items and rows each count; an item longer than a
document can still match the whole document; equal distances are broken by the
earlier place, then by the shorter window.
"""

import functools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as pa_type

from strandloom.llm.common import numbered, released, small_batches

SLICE_ROWS = 1000  # few, and the last of a slice's pieces of CHARACTERS would often be small
WALKS, GROUPS, BITS, PART = 4, 16, 4, 0.5
FEWEST_ROUNDS, MOST_ROUNDS = 64, 256
GRAM, MOST_APART = 5, 40_000
CHARACTERS, WINDOWS = 250_000, 5_000  # looked through at a time: what they take stays in a core's cache
FACTOR, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
ODD, SPREAD32, EIGHT, HALF = np.uint32(0x85EBCA6B), np.uint32(0x9E3779B1), np.uint32(8), np.uint64(32)


def normal_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger (a band of 2 most + 1)."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    x = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    y = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 2 * most + 1
    ramp = np.arange(width)
    big = most + 1
    # row[k]: distance of a[:i] to b[:i + k - most]
    row = np.where(ramp >= most, ramp - most, big)
    padded = np.concatenate([np.full(most, 2**32 - 1, np.uint32), y, np.full(width + most, 2**32 - 1, np.uint32)])
    for i in range(1, n + 1):
        same = padded[i - 1 : i - 1 + width] == x[i - 1]
        new = np.minimum(row + ~same, np.r_[row[1:] + 1, big])
        j = i + ramp - most
        new[j < 0] = big
        new[j == 0] = i
        new[j > m] = big
        new = np.minimum(new, np.minimum.accumulate(new - ramp) + ramp)
        row = np.minimum(new, big)
        if row.min() > most:
            return big
    return int(row[m - n + most])


def distances(item: np.ndarray, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each place in text the least distance of item to a run that ends there
    and begins at one of the starts."""
    ramp = np.arange(len(text) + 1)
    first = np.full(len(text) + 1, -(len(text) + len(item) + 1))
    first[starts] = starts
    row = ramp - np.maximum.accumulate(first)
    for i, c in enumerate(item.tolist(), 1):
        new = row + 1
        np.minimum(new[1:], row[:-1] + (text != c), out=new[1:])
        row = np.minimum.accumulate(new - ramp) + ramp
    return row


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def rolling(chars: np.ndarray, sizes: Iterable[int]) -> Iterable[tuple[int, np.ndarray]]:
    """The hashes of all runs of each size."""
    wanted = set(sizes)
    h = np.zeros(len(chars), np.uint64)
    c = chars.astype(np.uint64)
    for n in range(1, max(wanted, default=0) + 1):
        if n > len(chars):
            return
        h = h[: len(chars) - n + 1] * FACTOR + c[n - 1 :]
        if n in wanted:
            yield n, h


def letters(chars: np.ndarray) -> np.ndarray:
    """What the walks see of characters: numbers below 256."""
    return (chars.astype(np.int64) * 0x9E3779B1 >> 16) & 255


class Walks:
    """CGK walks for windows of ``width`` characters, and rounds of sampled steps."""

    def __init__(self, width: int):
        g = np.random.default_rng(width)
        self.steps = max(2, int(1.8 * width))
        self.bits = g.integers(0, 2, (self.steps, WALKS, 256))
        self.groups_at: list[list[list[int]]] = [[[] for _ in range(WALKS)] for _ in range(self.steps)]  # by step and walk the groups that sample it
        for w in range(WALKS):
            for k in range(GROUPS):
                for j in g.choice(self.steps, min(BITS, self.steps), replace=False):
                    self.groups_at[j][w].append(k)
        pairs = [(a, b) for b in range(GROUPS) for a in range(b)]
        self.rounds = [(w, *pairs[k]) for k in g.permutation(len(pairs)) for w in range(WALKS)][:MOST_ROUNDS]

    def keys(self, text: np.ndarray, starts: np.ndarray) -> Iterable[np.ndarray]:
        """For each round the keys of the windows of text that begin at the starts."""
        return (a.astype(np.uint64) << HALF | b for a, b in self.sampled(text, starts))

    def sampled(self, text: np.ndarray, starts: np.ndarray) -> Iterable[tuple[np.ndarray, np.ndarray]]:
        """For each round the letters of its two groups, packed in 32 bits each."""
        n = len(starts)
        groups = np.zeros((WALKS, GROUPS, n), np.uint32)  # a sampled step's letter takes BITS * 8 bits of a group in turn
        at = np.tile(starts.astype(np.int64), (WALKS, 1))
        here, move, letter = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.uint32)
        for bits, sampled in zip(self.bits if n else (), self.groups_at, strict=False):
            for w in range(WALKS):
                text.take(at[w], out=here, mode="clip")
                if sampled[w]:
                    letter[:] = here
                    for k in sampled[w]:
                        g = groups[w, k]
                        g <<= EIGHT
                        g |= letter
                bits[w].take(here, out=move, mode="clip")
                at[w] += move
        for w, a, b in self.rounds:
            yield groups[w, a], groups[w, b]

    @staticmethod
    def cells(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
        """A hash of the two groups of so many bits."""
        h = a * ODD
        h += b
        h *= SPREAD32
        h >>= np.uint32(32 - bits)
        return h


class Class:
    """Items of like length with the keys of their windows."""

    def __init__(self, least: int, items: list[tuple[int, np.ndarray]], share: float, recall: float):
        self.width = max(min(least, 12), int(PART * least))
        self.cell = max(1, least - self.width - 12)  # a word start lies within 12 characters, mostly
        text, starts, self.item, self.shift = self._windows([c for _, c in items])
        self.walks = Walks(self.width)
        self.walks.rounds = self.walks.rounds[: self._rounds(items, share, recall, text, starts)]
        self.item = np.array([n for n, _ in items])[self.item]
        keys = list(self.walks.keys(text, starts))
        self.bits = min(24, max(12, (16 * len(starts)).bit_length()))
        self.flags = np.zeros((len(keys), 1 << self.bits), bool)
        for flags, (a, b) in zip(self.flags, self.walks.sampled(text, starts), strict=True):
            flags[self.walks.cells(a, b, self.bits)] = True
        flat = np.concatenate([h + named for h, named in zip(keys, self.names(len(keys)), strict=True)])
        self.order = np.argsort(flat, kind="stable")
        self.known = flat[self.order]
        self.rare = np.uint64(64 - min(24, max(12, (8 * len(flat)).bit_length())))
        self.some = np.zeros(1 << 64 - int(self.rare), bool)
        self.some[flat * FACTOR >> self.rare] = True

    @staticmethod
    def names(rounds: int) -> np.ndarray:
        """Added to a round's keys, so that all rounds share one sorted list."""
        return np.arange(rounds, dtype=np.uint64) * FACTOR

    def _windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """One text of all, with gaps, and start, text and place of each window."""
        parts, starts, item, shift, at = [], [], [], [], 0
        gap = np.zeros(2 * self.width, np.uint32)
        for i, chars in enumerate(texts):
            words = np.flatnonzero(np.r_[True, chars[:-1] == 32])
            words = words[words + self.width <= len(chars)]
            starts.append(words + at)
            item.append(np.full(len(words), i))
            shift.append(words)
            parts += [chars, gap]
            at += len(chars) + len(gap)
        return letters(np.concatenate(parts)), *(np.concatenate(x) for x in (starts, item, shift))

    def _rounds(self, items: list[tuple[int, np.ndarray]], share: float, recall: float, text: np.ndarray, starts: np.ndarray) -> int:
        """How many rounds find edited copies of some of the items."""
        g = np.random.default_rng(5)
        which = [i for _ in range(-(-64 // len(items))) for i in range(len(items))][:256]
        copies = []
        for i in which:
            chars = items[i][1]
            copy = chars.tolist()
            for q in g.integers(0, len(copy), int(share * len(copy))).tolist():
                other = int(chars[g.integers(len(chars))])
                copy[q : q + 1] = ([], [other], [*copy[q : q + 1], other])[g.integers(3)]
            copies.append(np.array(copy, np.uint32))
        copied, begin, copy_of, place = self._windows(copies)
        begin, copy_of = (x[self._first(place, copy_of)] for x in (begin, copy_of))
        found = np.zeros(len(which), bool)
        for r, (x, y) in enumerate(zip(self.walks.keys(text, starts), self.walks.keys(copied, begin), strict=True), 1):
            mark = lambda keys, item: keys ^ (item.astype(np.uint64) + np.uint64(1)) * FACTOR
            found[copy_of[np.isin(mark(y, np.array(which)[copy_of]), mark(x, self.item))]] = True
            if r >= FEWEST_ROUNDS and found.mean() >= recall:
                return r
        return MOST_ROUNDS

    def _first(self, place: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Which word starts come first in their cell of their text."""
        cell = place // self.cell
        return np.r_[True, (np.diff(cell) != 0) | (np.diff(text) != 0)] if len(place) else np.empty(0, bool)

    def candidates(self, text: np.ndarray, starts: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in text, item, place in the item) of windows that agree; starts: of words,
        at their places of documents."""
        starts = starts[self._first(place, doc)]
        where, keys = [], []
        for some in np.array_split(np.arange(len(starts)), -(-len(starts) // WINDOWS) or 1):
            for (a, b), flags, named in zip(self.walks.sampled(text, starts[some]), self.flags, self.names(len(self.flags)), strict=True):
                at = np.flatnonzero(flags.take(self.walks.cells(a, b, self.bits)))
                where.append(some[at])
                keys.append((a.take(at).astype(np.uint64) << HALF | b.take(at)) + named)
        where, keys = np.concatenate(where), np.concatenate(keys)
        likely = np.flatnonzero(self.some.take((keys * FACTOR >> self.rare).view(np.int64)))
        where, keys = where[likely], keys[likely]
        lo = np.searchsorted(self.known, keys, "left")
        hit = np.flatnonzero(self.known.take(lo, mode="clip") == keys)
        where, lo = where[hit], lo[hit]
        count = np.searchsorted(self.known, keys[hit], "right") - lo
        rows = self.order[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())] % len(self.item)
        where, rows = np.divmod(np.unique(np.repeat(where, count) * len(self.item) + rows), len(self.item))
        return starts[where], self.item[rows], self.shift[rows]


class Items:
    """A block of benchmark items, ready to be searched."""

    def __init__(self, items: list[tuple[int, str]], share: float, recall: float = 0.97):
        if not 0 <= share <= 0.5:
            raise ValueError("share must be within 0 and 0.5")
        self.rows = []
        classes: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, t in items:
            text = " ".join(normal_words(t))
            if not text:
                continue
            chars = characters(text)
            most = int(share * len(chars))
            grams = next((self.slots(h) for _, h in rolling(chars, {GRAM})), np.empty(0, np.int64))
            classes.setdefault(1 << len(chars).bit_length() - 1, []).append((len(self.rows), chars))
            self.rows.append((i, text, chars, most, grams, len(chars) - GRAM + 1 - GRAM * most))
        self.classes = [Class(least, some, share, recall) for least, some in sorted(classes.items())]
        kinds = {least: k for k, least in enumerate(sorted(classes))}
        kind = [kinds[1 << len(r[2]).bit_length() - 1] for r in self.rows]
        by_class = sorted(range(len(kind)), key=kind.__getitem__)
        apart = [self.rows[i][4][::GRAM] for i in by_class]
        self.apart = np.concatenate([np.empty(0, np.int64), *apart])
        self.ends = np.cumsum([0, *map(len, apart)])
        self.needed = np.array([len(x) - self.rows[i][3] for i, x in zip(by_class, apart, strict=True)], np.int64)
        self.kinds = np.searchsorted(np.sort(kind), range(len(kinds)))
        self.lengths = np.array([len(r[2]) for r in self.rows], np.int64)
        self.most = np.array([r[3] for r in self.rows], np.int64)
        self.grams = np.array([len(r[4]) for r in self.rows], np.int64)
        self.least = np.array([r[5] for r in self.rows], np.int64)
        self.seen = np.zeros(1 << 16, bool)

    @staticmethod
    def slots(hashes: np.ndarray) -> np.ndarray:
        return ((hashes * SPREAD) >> np.uint64(48)).astype(np.int64)

    def holding(self, grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each class which texts may hold one of its items. Of an item's runs of GRAM
        characters that lie side by side an edit breaks one at most, so a text that lacks
        more of them than edits are allowed holds no match, and its windows are not walked.
        With more than MOST_APART runs that is not asked."""
        out = np.ones((len(offsets) - 1, len(self.classes)), bool)
        held = np.zeros(len(self.apart) + 1, np.int32)
        for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), (offsets[1:] - GRAM).tolist(), strict=True)):
            if len(self.apart) <= MOST_APART and self.classes:
                here = grams[a : max(a, z)]
                self.seen[here] = True
                np.cumsum(self.seen.take(self.apart), out=held[1:])
                self.seen[here] = False
                out[i] = np.logical_or.reduceat(np.diff(held.take(self.ends)) >= self.needed, self.kinds)
        return out.T

    def regions(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[Iterable[tuple[int, int, int, int]], np.ndarray]:
        """(text, item, first, last character) around the candidates that may match, which
        holds every window within the distance, and the slots of the texts' runs of GRAM characters."""
        grams = next((self.slots(h) for _, h in rolling(chars, {GRAM})), np.empty(0, np.int64))
        text = letters(chars)
        words = np.flatnonzero(np.r_[True, (chars[:-1] == 32) | (chars[:-1] == 10)]) if len(chars) else np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(words, offsets)))
        found = []
        for c, may in zip(self.classes, self.holding(grams, offsets), strict=True):
            some = np.flatnonzero(may[doc])
            found.append(c.candidates(text, words[some], doc[some], (words - offsets[doc])[some]))
        if not found:
            return [], grams
        p, j, q = (np.concatenate(x) for x in zip(*found, strict=True))
        d = np.searchsorted(offsets, p, "right") - 1
        first = np.maximum(p - q - self.most[j], offsets[d])
        last = np.minimum(p - q + self.lengths[j] + self.most[j], offsets[d + 1] - 1)
        order = np.lexsort((first, j, d))
        d, j, first, last = (x[order] for x in (d, j, first, last))
        # those of a text and an item that overlap are one; pairs are set apart for that
        apart = np.cumsum(np.r_[0, (np.diff(d) != 0) | (np.diff(j) != 0)][: len(d)]) * (2 * len(chars) + 2)
        new = np.flatnonzero(np.r_[True, (first + apart)[1:] > np.maximum.accumulate(last + apart)[:-1]][: len(d)])
        last = np.maximum.reduceat(last, new) if len(new) else last
        d, j, first = d[new], j[new], first[new]
        some = self.likely(d, j, grams, offsets)
        out = zip(*(x[some].tolist() for x in (d, j, first, last)), strict=True)
        return out, grams

    def likely(self, d: np.ndarray, j: np.ndarray, grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts hold enough of the items' runs of GRAM characters, wherever they
        are: most candidates don't."""
        cuts = [*np.flatnonzero(np.r_[True, np.diff(d) != 0][: len(d)]).tolist(), len(d)]
        out = np.empty(len(d), bool)
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            begin, end = int(offsets[d[a]]), int(offsets[d[a] + 1]) - GRAM
            here, items = grams[begin : max(begin, end)], j[a:z]
            self.seen[here] = True
            held = np.cumsum(self.seen.take(np.concatenate([self.rows[x][4] for x in items.tolist()])))
            self.seen[here] = False
            ends = np.cumsum(self.grams[items])
            out[a:z] = np.diff(np.r_[0, held][np.r_[0, ends]]) >= self.least[items]
        return out

    def near(self, j: int, text: str, a: int, z: int, edge: int, end: int) -> tuple[int, int, int] | None:
        """(distance, first, last character) of the nearest run of words in a..z."""
        _, item, chars, most, _, _ = self.rows[j]
        whole = a if text.startswith(item, a, z) else text.find(" " + item, a, z) + 1
        if (whole > a or text.startswith(item, a, z)) and (whole == edge or text[whole - 1] == " ") and (whole + len(item) == end or text[whole + len(item)] == " "):
            return 0, whole, whole + len(item)
        part = characters(text[a:z])
        gap = part == 32
        starts = np.flatnonzero(np.r_[a == edge or text[a - 1] == " ", gap])
        ends = np.flatnonzero(np.r_[gap, z == end or text[z] == " "])
        if not len(starts) or not len(ends):
            return None
        e = int(distances(chars, part, starts)[ends].min())
        if e > most:
            return None
        back = distances(chars[::-1], part[::-1], len(part) - ends[::-1])[len(part) - starts]
        s = int(starts[back == e][0])
        for last in ends[(ends >= s + len(chars) - e) & (ends > s)].tolist():
            if edit_distance(text[a + s : a + last], item, e) <= e:
                return e, a + s, a + last
        return None

    def search(self, texts: Iterable[list[str]]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item, first word, words, distance) of the nearest window
        of each item that it holds."""
        out: list[list[tuple[int, int, int, int]]] = []
        some: list[str] = []
        size = 0
        for words in texts:
            some.append(" ".join(words))
            size += len(some[-1])
            if size >= CHARACTERS:
                out += self.search_some(some)
                some, size = [], 0
        return out + self.search_some(some)

    def search_some(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])  # a line break parts two texts
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        text = "\n".join(texts)
        regions, grams = self.regions(characters(text), offsets)
        for d, j, a, z in regions:
            _, _, _, _, wanted, least = self.rows[j]
            if least > 0:  # an edit breaks at most GRAM runs of GRAM characters
                here = grams[a : max(a, z - GRAM + 1)]
                self.seen[here] = True
                shared = np.count_nonzero(self.seen.take(wanted))
                self.seen[here] = False
                if shared < least:
                    continue
            found = self.near(j, text, a, z, int(offsets[d]), int(offsets[d + 1]) - 1)
            if found and (j not in best[d] or found < best[d][j]):
                best[d][j] = found
        return [[(self.rows[j][0], text.count(" ", offsets[d], a), text.count(" ", a, z) + 1, e) for j, (e, a, z) in b.items()] for d, b in enumerate(best)]


class Block:
    """Benchmark items as they are sent; a worker gets them ready once, for all its tasks."""

    def __init__(self, rows: list[tuple[int, str]], share: float, recall: float):
        self.rows, self.share, self.recall = rows, share, recall

    @functools.cached_property
    def items(self) -> Items:
        return Items(self.rows, self.share, self.recall)


MATCHES = "array<struct<item_id:bigint,first_word:int,n_words:int,distance:int>>"


def matched(rows: DataFrame, text: str, benchmark: DataFrame, share: float, recall: float, broadcast_bytes: int) -> DataFrame:
    """rows with ``matches`` of the column text as a last column."""
    spark = rows.sparkSession
    small_batches(spark)
    items = benchmark.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b")).first().b
    blocks = max(1, -(-total // broadcast_bytes))
    place = rows.columns.index(text)
    out = rows.withColumn("matches", F.expr(f"cast(array() as {MATCHES})"))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast(Block([(r.item_id, r.text) for r in block.orderBy("item_id", "text").collect()], share, recall))

        def run(batches, sent=sent, schema=out.schema):
            found = sent.value.items
            kind = pa_type(schema[-1].dataType)
            for b in batches:
                for at in range(0, b.num_rows, SLICE_ROWS):
                    s = b.slice(at, SLICE_ROWS)
                    new = []
                    for hits, old in zip(found.search(normal_words(t) for t in s.column(place).to_pylist()), s.column(s.num_columns - 1).to_pylist(), strict=True):
                        hits = sorted(hits, key=lambda h: (h[1], h[0] is None, h[0]))
                        new.append(old + [{"item_id": i, "first_word": p, "n_words": n, "distance": d} for i, p, n, d in hits])
                    yield pa.RecordBatch.from_arrays([*s.columns[:-1], pa.array(new, kind)], schema.names)

        out = out.mapInArrow(released(run), out.schema)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.1, recall: float = 0.97, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """doc_id and ``matches``: an array of (item_id, first_word, n_words, distance),
    empty for clean documents. share: edits per character allowed."""
    return matched(docs.select("doc_id", "text"), "text", benchmark, share, recall, broadcast_bytes).drop("text")


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.1, recall: float = 0.97, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    rows, place = numbered(docs)
    kept = matched(rows, place["text"], benchmark, share, recall, broadcast_bytes).where(F.size("matches") == 0)
    return kept.select(*rows.columns).toDF(*docs.columns)
