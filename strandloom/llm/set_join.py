"""Exact similarity join of documents' shingle sets (T-occurrence with DivideSkip).

Two sets link when their Jaccard similarity reaches ``percent`` / 100. Equal sets
are one node. The overlap T that a partner must reach divides a set's inverted
lists as DivideSkip does: all but the rarest p = n - ceil(percent n / 100) + 1
tokens are long lists, which are never merged. The short lists of a hash range are
merged in order of size, and each pair of sets counts its occurrences among the first
n - T + l tokens of both: sets that overlap in T tokens share l of these, so pairs with
fewer than l occurrences over all ranges are dropped (l is at most ``OCCURRENCES``, and
as large as the p tokens allow). The bound of their parity bitmaps (overlap is at most
half of both sizes minus the bitmaps' difference) drops most of the others, and the long
lists are then probed by binary search in the partner's sorted tokens, which gives the
exact overlap: first for one pair of each two groups, then for the pairs whose groups
are still apart. Pairs travel packed, by bucket of a set, and meet its size and
bitmap there; only those left become rows.

Rare first: a table of the ``hot`` most frequent tokens is counted over all sets;
tokens not in it come first, by hash, then hot ones by count. The order decides
only how much work is done.

Groups of near copies are not expanded into pairs: sets that share a min-hash band
are first compared with the few leaders of their band, and with the sets just before
them if no leader is like them, and linked if the exact similarity holds; afterwards
only sets of different groups are candidates, so no link between components is lost,
and a list's largest group is never paired with itself. Bands with many sets are split
by a salt; their leaders and a sample of their sets meet in a second round.

Defined cases: null and empty texts have empty sets and no links; texts of fewer
than ``k`` words have one shingle, the whole sequence; repeated rows and copies
share a node; a null id gets the smallest id of its component, or null; an empty
table gives no rows. Node numbers are 64-bit hashes of whole sets; a second hash
detects a collision, and the join is then done anew with another seed.
"""

from collections import deque
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import byte_words, discard, hash_words, mix, numbered, released, released_group, released_pair, shingle_hashes, small_batches, stored
from strandloom.llm.components import components
from strandloom.llm.substring_dedup import _planes, _unplanes

BANDS, LEADERS, RECENT, SAMPLED, BAND_ROWS = 4, 8, 64, 32, 1000
OCCURRENCES = 8
SLICE_ROWS, CHUNK_TOKENS, CHUNK_PAIRS, BATCH_BYTES = 256, 2_000_000, 250_000, 250_000
WORDS = 8  # of a parity bitmap
SETS = "doc_id bigint, th bigint, s1 bigint, s2 bigint, n int, bands array<bigint>, " + ", ".join(f"w{i} bigint" for i in range(WORDS)) + ", tokens binary"


def token_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes (56 bits) of a text."""
    words = byte_words(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words)
    if len(h) < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64) >> np.uint64(8)
    return np.unique(shingle_hashes(h, k) >> np.uint64(8))


def pack_set(tokens: np.ndarray) -> bytes:
    return _planes(np.diff(tokens, prepend=np.uint64(0))) if len(tokens) else b""


def unpack_set(b: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(b, "<u8"), dtype=np.uint64) if b else np.empty(0, np.uint64)


def parity(tokens: np.ndarray) -> np.ndarray:
    bits = np.bincount((tokens >> np.uint64(11)).astype(np.int64) & (64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def band_keys(tokens: np.ndarray) -> list[int]:
    out = []
    for j in range(BANDS):
        m = mix(tokens + np.uint64(j + 1))
        two = np.sort(np.partition(m, 1)[:2]) if len(m) > 2 else np.sort(m)
        out.append(xxhash.xxh3_64_intdigest(two.tobytes(), seed=j) - (1 << 63))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    c = overlap(a, b)
    return 100 * c >= percent * (len(a) + len(b) - c)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class Rarity:
    """The order of tokens: those that are not hot by hash, then hot ones by count."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.tokens & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def order(self, tokens: np.ndarray) -> np.ndarray:
        """tokens (sorted by hash), rarest first."""
        some = np.flatnonzero(self.maybe[(tokens & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(some):
            return tokens
        at = np.searchsorted(self.tokens, tokens[some])
        at[at == len(self.tokens)] = 0
        hot = self.tokens[at] == tokens[some]
        if not hot.any():
            return tokens
        count = np.zeros(len(tokens), np.int64)
        count[some[hot]] = self.counts[at[hot]]
        return tokens[np.argsort(count, kind="stable")]


def text_sets(docs: DataFrame, k: int, seed: int, kept: list[str] | None = None) -> DataFrame:
    """Stored: the token set of every row with its hashes, bands and bitmap."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                s = b.slice(at, SLICE_ROWS)
                sets = [token_set(t, k) for t in s.column(2).to_pylist()]
                yield set_rows(s.column(0), s.column(1), sets, seed)

    return stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(released(run), SETS), "sets", kept)


def set_rows(ids, hashes, sets: list[np.ndarray], seed: int, spread: bool = False) -> pa.RecordBatch:
    """Rows of SETS; spread: tokens are small numbers, which become 56-bit hashes."""
    if spread:
        sets = [np.unique(mix(x + np.uint64(1)) >> np.uint64(8)) for x in sets]
    h = [xxhash.xxh3_128_intdigest(x.tobytes(), seed=seed) for x in sets]
    high = [(x >> 64) - (1 << 63) for x in h]
    low = [(x & (2**64 - 1)) - (1 << 63) for x in h]
    maps = np.stack([parity(x) for x in sets]) if sets else np.empty((0, WORDS), np.int64)
    cols = [ids, hashes, pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array([len(x) for x in sets], pa.int32())]
    cols += [pa.array([band_keys(x) if len(x) else [] for x in sets], pa.list_(pa.int64()))]
    cols += [pa.array(maps[:, i]) for i in range(WORDS)] + [pa.array([pack_set(x) for x in sets], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "s1", "s2", "n", "bands", *[f"w{i}" for i in range(WORDS)], "tokens"])


def _sized(df: DataFrame, width: int, limit: int) -> DataFrame:
    """df, broadcast if its rows of about width bytes fit the limit."""
    return F.broadcast(df) if df.count() * width <= limit else df


def _leaders(rows: DataFrame, percent: int) -> DataFrame:
    """Links x - leader and group of each set in rows(group, salt, s1, tokens), to all
    its leaders or else to one of the sets just before it; a leader and the first
    SAMPLED sets also with x = leader. Streams over sorted rows and holds LEADERS +
    RECENT sets."""

    def run(batches):
        key, held, recent, met = None, [], deque(maxlen=RECENT), 0
        for b in batches:
            out = []
            for group, salt, s1, tokens in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if key != (group, salt):
                    key, held, met = (group, salt), [], 0
                    recent.clear()
                x = unpack_set(tokens)
                leads = [s for s, y in held if s == s1 or linked(x, y, percent)]
                if not leads and LEADERS:
                    if len(held) < LEADERS:
                        held.append((s1, x))
                        leads = [s1]
                    else:
                        leads = list(islice((s for s, y in reversed(recent) if linked(x, y, percent)), 1))
                if met < SAMPLED and s1 not in leads and LEADERS:
                    leads.append(s1)
                met += 1
                recent.append((s1, x))
                out += [(s1, lead, group) for lead in leads]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["x", "leader", "group"])

    dealt = rows.select("group", "salt", "s1", "tokens").repartition("group", "salt").sortWithinPartitions("group", "salt", "s1")
    return dealt.mapInArrow(released(run), "x bigint, leader bigint, group bigint")


def near_groups(sets: DataFrame, nodes: DataFrame, percent: int, limit: int, kept: list[str]) -> DataFrame:
    """Exact links x - leader among sets that share a band. Bands whose smallest set
    is the same are one group, so a set is sent once for most of its bands."""
    bands = nodes.where("n > 0").select("s1", "rep", F.explode("bands").alias("band"))
    heads = bands.groupBy("band").agg(F.count("*").alias("size"), F.min("s1").alias("group")).where("size > 1")
    members = bands.join(heads, "band").groupBy("group", "s1").agg(F.min("rep").alias("rep"))
    sizes = members.groupBy("group").agg(F.ceil(F.count("*") / BAND_ROWS).cast("int").alias("salts"))
    members = stored(members.join(sizes, "group").withColumn("salt", F.pmod(F.xxhash64("s1", "group"), F.col("salts")).cast("int")), "bands", kept)
    first = stored(_leaders(_fetch(sets, members, limit, "group", "salt"), percent), "leaders", kept)
    wide = members.where("salts > 1")
    again = first.where("x = leader").select(F.col("x").alias("s1"), "group").distinct().join(wide.select("group", "s1", "rep"), ["group", "s1"])
    second = _leaders(_fetch(sets, again.withColumn("salt", F.lit(0)), limit, "group", "salt"), percent)
    return first.union(second).where("x != leader").select(F.col("x").alias("u"), F.col("leader").alias("v")).distinct()


def _fetch(sets: DataFrame, wanted: DataFrame, limit: int, *more: str) -> DataFrame:
    """s1, tokens of the representatives in wanted(s1, rep), and its more columns."""
    w = wanted.select(F.col("s1").alias("f1"), F.col("rep").alias("f_rep"), *more)
    w = _sized(w, 40, limit)
    return sets.join(w, (F.col("s1") == F.col("f1")) & (F.coalesce("doc_id", F.lit(2**63 - 1)) == F.col("f_rep"))).select("s1", "tokens", *more)


def hot_tokens(sets: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens and their counts (of tasks that hold them thrice)."""

    def count(batches):
        held, n = [], 0

        def send():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= 3
            return pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["token", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(unpack_set(t))
                n += len(held[-1])
                if n >= CHUNK_TOKENS:
                    yield send()
                    held, n = [], 0
        if held:
            yield send()

    rows = sets.where("n > 0").select("tokens").mapInArrow(released(count), "token bigint, c bigint").groupBy("token").agg(F.sum("c").alias("c"))
    got = rows.orderBy(F.desc("c"), "token").limit(most).toArrow()
    return np.array(got.column("token")).astype(np.int64).view(np.uint64), np.array(got.column("c")).astype(np.int64)


def _pack_lists(s1, label, size, tokens, node, place) -> bytes:
    """Entries (token, node, place) of the sets numbered by node; only labels that
    differ from s1 are written."""
    own = label == s1
    head = np.array([len(tokens), len(s1), len(s1) - np.count_nonzero(own)], "<i8").tobytes()
    table = s1.astype("<i8").tobytes() + _planes(size.astype("<u4")) + np.packbits(own).tobytes() + label[~own].astype("<i8").tobytes()
    return head + table + b"".join(_planes(x) for x in (tokens.astype("<u8"), node.astype("<u4"), place.astype("<u4")))


def _unpack_lists(b: bytes) -> tuple[np.ndarray, ...]:
    n, k, m = np.frombuffer(b, "<i8", 3).tolist()
    o, flags = 24 + 12 * k, -(-k // 8)
    s1, size = np.frombuffer(b, "<i8", k, 24), _unplanes(b[24 + 8 * k : o], "<u4").astype(np.int64)
    label = s1.copy()
    label[np.unpackbits(np.frombuffer(b, np.uint8, flags, o), count=k) == 0] = np.frombuffer(b, "<i8", m, o + flags)
    o += flags + 8 * m
    tokens, node, place = (_unplanes(b[o + i * n : o + j * n], t) for i, j, t in ((0, 8, "<u8"), (8, 12, "<u4"), (12, 16, "<u4")))
    return s1, label, size, tokens, node.astype(np.int64), place.astype(np.int64)


def _send_short_lists(rarity_state, ranges: int, percent: int):
    """Tasks' short-list entries: (range, blob of tokens, nodes, positions)."""

    lists = lambda of, blobs: pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(blobs, pa.binary())], ["range", "blob"])

    def run(batches):
        rarity = Rarity(*rarity_state.value)
        seen: set[int] = set()
        held: list[tuple[int, int, int, np.ndarray]] = []
        n = 0

        def send():
            s1, label, size = (np.array(x, np.int64) for x in list(zip(*held, strict=True))[:3])
            lengths = np.array([len(h[3]) for h in held])
            tokens = np.concatenate([h[3] for h in held])
            node = np.repeat(np.arange(len(held), dtype=np.int32), lengths)
            place = (np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype("<u4")
            part = (mix(tokens) >> np.uint64(40)).astype(np.int64) % ranges
            by = np.argsort(part.astype(np.int32), kind="stable")
            cuts = np.searchsorted(part[by], np.arange(ranges + 1))
            blobs, of, total = [], [], 0
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                i = by[cuts[r] : cuts[r + 1]]
                docs, inner = np.unique(node[i], return_inverse=True)
                blobs.append(_pack_lists(s1[docs], label[docs], size[docs], tokens[i], inner, place[i]))
                of.append(r)
                total += len(blobs[-1])
                if total > BATCH_BYTES:  # small batches: the JVM keeps what the largest one took
                    yield lists(of, blobs)
                    blobs, of, total = [], [], 0
            if blobs:
                yield lists(of, blobs)

        for b in batches:
            for s1, label, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if s1 in seen:
                    continue
                seen.add(s1)
                x = unpack_set(t)
                held.append((s1, label, len(x), rarity.order(x)[: prefix_length(len(x), percent)].copy()))
                n += len(held[-1][3])
                if n >= CHUNK_TOKENS // 4:
                    yield from send()
                    held, n = [], 0
                    seen.clear()
        if held:
            yield from send()

    return run


PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("least", "u1"), ("count", "u1")])


def summed(pairs: np.ndarray) -> np.ndarray:
    """Equal pairs as one, with the sum of their counts (up to 255)."""
    order = np.lexsort((pairs["b"], pairs["a"]))
    s = pairs[order]
    first = np.flatnonzero(np.r_[True, (s["a"][1:] != s["a"][:-1]) | (s["b"][1:] != s["b"][:-1])]) if len(s) else np.empty(0, np.int64)
    out = s[first]
    if len(s):
        out["count"] = np.minimum(np.add.reduceat(s["count"].astype(np.int64), first), 255)
    return out


def merge_short_lists(blobs: list[bytes], percent: int) -> np.ndarray:
    """PAIRs (a < b) of sets of different groups that occur together in a range's
    lists, with their occurrences and the least that all ranges must give."""
    parts, at = [], 0
    for b in blobs:
        *table, token, node, place = _unpack_lists(b)
        parts.append((*table, token, node + at, place))
        at += len(table[0])
    s1, label, size, token, node, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.lexsort((size[node], token))
    token, node, place = token[order], node[order], place[order]
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    # only lists with two groups
    lab = label[node]
    mixed = np.minimum.reduceat(lab, start) != np.maximum.reduceat(lab, start) if len(start) else np.empty(0, bool)
    lengths = np.diff(np.r_[start, len(token)])
    of = np.repeat(mixed, lengths)
    node, place, lab = node[of], place[of], lab[of]
    lists = np.repeat(np.arange(np.count_nonzero(mixed)), lengths[mixed])
    del token, of
    prefix = size - -(-percent * size // 100) + 1
    out, gathered = [], 0
    for x, y in pairs_apart(lists, size[node], lab, percent):
        i, j, p, q = node[x], node[y], place[x], place[y]
        need = -(-percent * (size[i] + size[j]) // (100 + percent))
        least = np.clip(np.minimum(prefix[i] - size[i], prefix[j] - size[j]) + need, 1, OCCURRENCES)
        ok = (p < size[i] - need + least) & (q < size[j] - need + least)
        found = np.empty(np.count_nonzero(ok), PAIR)
        u, v = s1[i[ok]], s1[j[ok]]
        found["a"], found["b"], found["least"], found["count"] = np.minimum(u, v), np.maximum(u, v), least[ok], 1
        out.append(found)
        gathered += len(found)
        if gathered > 1_000_000:
            out = [summed(np.concatenate(out))]
            gathered = len(out[0]) // 2
    return summed(np.concatenate([np.empty(0, PAIR), *out]))


def pairs_apart(lists: np.ndarray, size: np.ndarray, label: np.ndarray, percent: int):
    """Chunks (x, y) of the places x < y of entries of one list whose labels differ and
    whose sizes allow a link; entries are in order of list and size. The list's most
    frequent label is met from the others only, so the work is that of the pairs
    between labels, whatever the size of one group."""
    if not len(lists):
        return
    by = np.lexsort((label, lists))
    new = np.flatnonzero(np.r_[True, (lists[by][1:] != lists[by][:-1]) | (label[by][1:] != label[by][:-1])])
    most = np.lexsort((np.diff(np.r_[new, len(by)]), lists[by[new]]))
    of = lists[by[new[most]]]
    top = label[by[new[most[np.r_[of[1:] != of[:-1], True]]]]]  # the longest run of each list
    inside = label == top[lists]
    others, members = np.flatnonzero(~inside), np.flatnonzero(inside)
    width = np.int64(size.max()) * 2 + 2
    key = lists * width + size
    start = key[others] - size[others]
    after = np.searchsorted(key, start + np.minimum(100 * size[others] // percent, width - 1), "right")
    before = np.searchsorted(key[members], start - (-percent * size[others] // 100))
    until = np.maximum(np.searchsorted(members, others), before)
    for low, high, left in ((others + 1, after, False), (before, until, True)):
        ends = np.cumsum(high - low)
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(CHUNK_PAIRS, ends[-1], CHUNK_PAIRS)) + 1, len(ends)]) if len(ends) else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            n = high[i:j] - low[i:j]
            met = np.arange(n.sum()) + np.repeat(low[i:j] - (np.cumsum(n) - n), n)
            one = np.repeat(others[i:j], n)
            if left:
                yield members[met], one
            else:
                apart = label[one] != label[met]
                yield one[apart], met[apart]


MAP = np.dtype([("s1", "<i8"), ("n", "<i8"), ("bits", "<u8", WORDS)])
HALF_MET = np.dtype([("a", "<i8"), ("b", "<i8"), ("n", "<i8"), ("bits", "<u8", WORDS)])


def _maps(t: pa.Table) -> np.ndarray:
    """MAPs of a bucket's sets, by s1."""
    out = np.empty(t.num_rows, MAP)
    for c in ("s1", "n"):
        out[c] = np.array(t.column(c))
    for i in range(WORDS):
        out["bits"][:, i] = np.array(t.column(f"w{i}")).astype(np.int64).view(np.uint64)
    return out[np.argsort(out["s1"])]


def candidates(sets: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int, hot: int, ranges: int, limit: int) -> DataFrame:
    """Pairs a, b of sets of different groups that share enough short lists and
    whose bitmaps leave enough overlap."""
    sent = sets.sparkSession.sparkContext.broadcast(hot_tokens(sets, hot))
    marks = _sized(labels.select(F.col("node").alias("m"), "label"), 24, limit)
    rows = sets.where("n > 0").join(marks, F.col("s1") == F.col("m"), "left").select("s1", F.coalesce("label", "s1").alias("label"), "tokens")
    lists = rows.mapInArrow(released(_send_short_lists(sent, ranges, percent)), "range int, blob binary")
    maps = nodes.where("n > 0").select(F.pmod("s1", F.lit(ranges)).cast("int").alias("bucket"), "s1", F.col("n").cast("bigint").alias("n"), *[f"w{i}" for i in range(WORDS)])

    def dealt(pairs: np.ndarray, side: str) -> pa.Table:
        out = [(r, np.ascontiguousarray(pairs[i]).tobytes()) for r, i in _parts(pairs[side] % ranges, ranges)]
        return pa.table([pa.array([r for r, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["bucket", "pairs"])

    def merge(t: pa.Table) -> pa.Table:
        return dealt(merge_short_lists(t.column("blob").to_pylist(), percent), "a")

    def first(t: pa.Table, of: pa.Table) -> pa.Table:
        pairs = summed(np.concatenate([np.empty(0, PAIR), *[np.frombuffer(b, PAIR) for b in t.column("pairs").to_pylist()]]))
        pairs, m = pairs[pairs["count"] >= pairs["least"]], _maps(of)
        mine = m[np.searchsorted(m["s1"], pairs["a"])]
        out = np.empty(len(pairs), HALF_MET)
        out["a"], out["b"], out["n"], out["bits"] = pairs["a"], pairs["b"], mine["n"], mine["bits"]
        return dealt(out, "b")

    def second(t: pa.Table, of: pa.Table) -> pa.Table:
        pairs, m = np.concatenate([np.empty(0, HALF_MET), *[np.frombuffer(b, HALF_MET) for b in t.column("pairs").to_pylist()]]), _maps(of)
        mine = m[np.searchsorted(m["s1"], pairs["b"])]
        both = pairs["n"] + mine["n"]
        most = (both - np.bitwise_count(pairs["bits"] ^ mine["bits"]).sum(1, dtype=np.int64)) // 2
        left = pairs[100 * most >= percent * (both - most)]
        return pa.table({"a": pa.array(left["a"]), "b": pa.array(left["b"])})

    by_range = lists.groupBy("range").applyInArrow(released_group(merge), "bucket int, pairs binary")
    half = by_range.groupBy("bucket").cogroup(maps.groupBy("bucket")).applyInArrow(released_pair(first), "bucket int, pairs binary")
    return half.groupBy("bucket").cogroup(maps.groupBy("bucket")).applyInArrow(released_pair(second), "a bigint, b bigint")


def _parts(at: np.ndarray, n: int):
    by = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[by], np.arange(n + 1))
    return [(r, by[cuts[r] : cuts[r + 1]]) for r in range(n) if cuts[r + 1] > cuts[r]]


def exact_links(sets: DataFrame, pairs: DataFrame, percent: int, limit: int) -> DataFrame:
    """u, v of the pairs (a, a_rep, b, b_rep) whose similarity holds."""
    # each partner's set goes to its pair's first set, which is sent once
    first = _fetch(sets, pairs.select(F.col("a").alias("s1"), F.col("a_rep").alias("rep")).distinct(), limit).select(F.col("s1").alias("a"), F.lit(None).cast("bigint").alias("b"), "tokens")
    partners = _fetch(sets, pairs.select(F.col("b").alias("s1"), F.col("b_rep").alias("rep"), "a"), limit, "a").select("a", F.col("s1").alias("b"), "tokens")

    def probe(batches):
        key, x = None, None
        for batch in batches:
            out = []
            for a, b, tokens in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b is None:
                    key, x = a, unpack_set(tokens)
                elif key == a and linked(x, unpack_set(tokens), percent):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])

    both = first.union(partners).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    return both.mapInArrow(released(probe), "u bigint, v bigint").distinct()


def links_between(sets: DataFrame, nodes: DataFrame, near: DataFrame, labels: DataFrame, pairs: DataFrame, percent: int, limit: int, kept: list[str]) -> DataFrame:
    """Exact links among the pairs that, with near, connect all that they connect."""
    reps = lambda x: nodes.select(F.col("s1").alias(x), F.col("rep").alias(f"{x}_rep"))
    pairs = stored(pairs.join(_sized(reps("a"), 24, limit), "a").join(_sized(reps("b"), 24, limit), "b").select("a", "a_rep", "b", "b_rep"), "candidates", kept)

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """pairs of different labels x < y."""
        mark = lambda c: _sized(labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")), 24, limit)
        both = pairs.join(mark("a"), "a", "left").join(mark("b"), "b", "left")
        p, q = F.coalesce("a_label", "a"), F.coalesce("b_label", "b")
        return both.where(p != q).select("a", "a_rep", "b", "b_rep", F.least(p, q).alias("x"), F.greatest(p, q).alias("y"))

    one = apart(pairs, labels).groupBy("x", "y").agg(F.min(F.struct("a", "a_rep", "b", "b_rep")).alias("p")).select("p.*")
    one = stored(one, "first", kept)
    found = stored(exact_links(sets, one, percent, limit), "far", kept)
    rest = stored(apart(pairs, components(near.union(found), kept)).drop("x", "y").join(one, ["a", "b"], "left_anti"), "rest", kept)
    return found.union(stored(exact_links(sets, rest, percent, limit), "far", kept))


def join_sets(sets: DataFrame, percent: int, hot: int = 1 << 20, ranges: int | None = None, limit: int = 32 << 20, kept: list[str] | None = None) -> DataFrame | None:
    """doc_id, th, n_shingles, label, component_id of every row of sets; None if
    two different sets share s1."""
    spark = sets.sparkSession
    kept = [] if kept is None else kept
    ranges = ranges or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rep = F.coalesce("doc_id", F.lit(2**63 - 1))
    firsts = [F.first(c).alias(c) for c in ("n", "bands", *[f"w{i}" for i in range(WORDS)])]
    nodes = stored(sets.groupBy("s1").agg(F.min(rep).alias("rep"), F.min("s2").alias("low"), F.max("s2").alias("high"), *firsts), "nodes", kept)
    if not nodes.where("low != high").isEmpty():
        return None
    near = stored(near_groups(sets, nodes, percent, limit, kept), "near", kept)
    labels = components(near, kept)
    links = links_between(sets, nodes, near, labels, candidates(sets, nodes, labels, percent, hot, ranges, limit), percent, limit, kept)
    labels = components(near.union(links), kept)
    smallest = labels.join(nodes.select(F.col("s1").alias("node"), "rep"), "node").groupBy("label").agg(F.min("rep").alias("least"))
    of_node = labels.join(smallest, "label").select(F.col("node").alias("s1"), "label", "least")
    known = nodes.select("s1", "rep").join(of_node, "s1", "left").select("s1", F.coalesce("label", "s1").alias("label"), F.coalesce("least", "rep").alias("least"))
    rows = sets.select("doc_id", "th", "s1", F.col("n").cast("bigint").alias("n_shingles")).join(known, "s1")
    least = F.when((F.col("least") < 2**63 - 1) & (F.col("n_shingles") > 0), F.col("least")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "th", "n_shingles", "label", least.alias("component_id"))


def grouped(docs: DataFrame, k: int, percent: int, **how) -> DataFrame:
    """doc_id, hash of the text, n_shingles, label of its group, component_id."""
    small_batches(docs.sparkSession)
    for seed in range(8):
        kept: list[str] = []
        try:
            out = join_sets(text_sets(docs, k, seed, kept), percent, kept=kept, **how)
            if out is not None:
                return stored(out, "groups")
        finally:
            discard(docs.sparkSession, kept)
    raise ArithmeticError("sets collide under every seed")


def near_documents(docs: DataFrame, k: int = 4, percent: int = 85, **how) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return grouped(docs, k, percent, **how).select("doc_id", "n_shingles", "component_id")


def first_of_groups(docs: DataFrame, k: int = 5, percent: int = 80, **how) -> DataFrame:
    """docs with one document of each group: that of the smallest id (null ids
    last), then text hash. Documents without words all stay."""
    rows = grouped(docs, k, percent, **how)
    key = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("k"), F.col("th").alias("t"))
    first = rows.where("n_shingles > 0").groupBy("label").agg(F.min(key).alias("x")).select("x.*", F.lit(False).alias("every"))
    empty = rows.where("n_shingles = 0").select(key.alias("x")).distinct().select("x.*", F.lit(True).alias("every"))
    base, place = numbered(docs)
    same = (F.coalesce(F.col(place["doc_id"]).cast("bigint"), F.lit(2**63 - 1)) == F.col("k")) & (F.xxhash64(place["text"]) == F.col("t"))
    kept = base.join(first.union(empty), same)
    nth = F.row_number().over(Window.partitionBy("k", "t").orderBy("every"))
    return kept.withColumn("i", nth).where("i = 1 or every").select(*base.columns).toDF(*docs.columns)
