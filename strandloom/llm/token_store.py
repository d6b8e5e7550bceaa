"""Token ids of documents in Re-Pair compressed shards.

File format: a Parquet table whose rows are shards of about ``shard_tokens`` ids
in ascending doc_id order. A shard holds its documents' ids and token counts, a
grammar and a sequence of symbols. Symbols below ``base`` are token ids; symbol
base + i is the i-th rule, a pair of earlier symbols. The lengths of the rules'
expansions are stored, so a range of ids is decoded from its own symbols alone.

Documents are range-partitioned by id, so parts are in order; a shard's place is
its part, its number there, and the ids before it in the part. Parts, not
documents, are numbered globally: the offsets of parts are one small table.

Compression is Re-Pair: the most frequent neighbouring pairs become rules and their
occurrences are replaced, again and again, until no pair occurs ``least`` times in the
shard, whatever its size. Pairs are taken many at a time: a round takes those that occur
at least 1 / ``SPREAD`` as often as the most frequent one, and of two that overlap the
more frequent one wins. A pair that occurs less than ``least`` times can't become
frequent later, so a round looks only at places that have changed or are still frequent.

Tokenizing goes by pieces, cut where the byte-level pre-tokenizer always starts a token
(``cuts``), so equal pieces have equal ids, which a worker remembers. A batch of texts asks
once for each of its distinct pieces, and its unseen runs of letters go through the
library's model one after the other. Texts with white space next to a space or a line feed
or with an added token (``<|endoftext|>``), and all texts if the tokenizer is not byte-level,
are encoded whole.

Defined cases: null text is empty (the end id alone); null doc_ids come first;
rows that repeat an id keep a row each, in
the order of their texts' hashes; a document longer than a shard has its own shard;
an empty table gives no shards and no rows.
"""

import json
import re
import zlib
from array import array
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import released, stored

ODD_SPACE = re.compile(r"\s(?:\s|\Z)|\A\s")
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation without the apostrophe, which starts contractions
SHARDS = "part int, seq int, first_token bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<int>, base int, rules binary, lengths binary, symbols binary"
KIND = np.array([2 if chr(b) in MARKS else b < 128 and chr(b).isalnum() for b in range(256)], np.uint8)
ID = attrgetter("id")
SPREAD, HALF = 128, np.uint64(32)


def byte_alphabet() -> np.ndarray:
    """The characters by which byte-level tokenizers write bytes: printable Latin-1
    ones stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in set(plain)]
    out = np.arange(256, dtype="<u4")
    out[others] = 256 + np.arange(len(others))
    return out


KEPT: dict[int, "Pieces"] = {}  # of a worker process, at most one


def cuts(b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces of joined UTF-8 texts begin, and the end: at each text, each space, each
    mark after an ASCII letter or digit, and before and after a line feed without ASCII white
    space or control characters around it. The pre-tokenizer starts a token at each of them,
    unless other white space is next to it, which leaves an odd piece."""
    cut = np.zeros(len(b) + 1, bool)
    cut[:-1] = b == 32
    kind = KIND.take(b)
    cut[1:-1] |= (kind[1:] == 2) & (kind[:-1] == 1)
    line = np.flatnonzero(b == 10)
    line = line[(b.take(line - 1, mode="clip") > 32) & (b.take(line + 1, mode="clip") > 32)]
    cut[line] = cut[line + 1] = True
    cut[ends] = True
    return np.flatnonzero(cut)


class Pieces(dict):
    """ids (as uint32 bytes) of pieces, None for a piece with odd white space; unseen ones
    are encoded when they are asked for, a batch's words of letters before that. When it is
    full its content becomes the older half, from which pieces come back."""

    def __init__(self, vocabulary: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.older = Tokenizer.from_str(vocabulary), most, {}
        self.base = max(self.tokenizer.get_vocab_size(), 3)
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet()
        kind = json.loads(vocabulary)
        cut = kind.get("pre_tokenizer") or {}
        self.added = [x["content"] for x in kind.get("added_tokens") or []]
        self.bytes_only = not kind.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")

    @staticmethod
    def of(vocabulary: str) -> "Pieces":
        """The worker's own, which its next tasks of write() find filled; read() drops it."""
        key = zlib.crc32(vocabulary.encode())
        if key not in KEPT:
            KEPT.clear()
            KEPT[key] = Pieces(vocabulary)
        return KEPT[key]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def spelled(self, s: str) -> str:
        return self.alphabet[np.frombuffer(s.encode(), np.uint8)].tobytes().decode("utf-32-le")

    def learn(self, words: list[str]) -> None:
        """The ids of pre-tokens without line feeds, spelled together."""
        for w, s in zip(words, self.spelled("\n".join(words)).split(self.spelled("\n")), strict=True):
            self[w] = array("I", map(ID, self.model.tokenize(s))).tobytes()

    def __missing__(self, piece: str) -> bytes | None:
        x = piece.removeprefix(" ")
        if piece in self.older:
            ids = self.older[piece]
        elif piece != "\n" and (not x or ODD_SPACE.search(x)):
            ids = None
        elif (y := piece.rstrip(MARKS)) != piece and y.removeprefix(" ").isalpha():
            ids = self[y] + self[piece[len(y) :]]
        else:
            ids = self.whole(piece)
        self[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the tokenizer gives them for the whole text."""
        if not self.bytes_only or not any(texts):
            return [self.whole(t) for t in texts]
        _, ends, data = pa.array(texts, pa.large_string()).buffers()
        ends = np.frombuffer(ends, np.int64)[: len(texts) + 1]
        at = cuts(np.frombuffer(data, np.uint8)[: ends[-1]], ends)
        coded = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # each is asked for once
        found = list(map(self.get, pieces))
        unseen = [k for k, ids in enumerate(found) if ids is None]
        new = [p for p in map(pieces.__getitem__, unseen) if p not in self.older]
        words = dict.fromkeys(y for p in new if (y := p.rstrip(MARKS)).removeprefix(" ").isalpha())
        if words := [y for y in words if y not in self and y not in self.older]:
            self.learn(words)
        for k in unseen:
            found[k] = self[pieces[k]]
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        first = np.searchsorted(at, ends)  # each text's first piece
        nulls = np.r_[0, np.cumsum(ids.is_null().to_numpy(zero_copy_only=False))]
        odd = (np.diff(nulls.take(first)) > 0).tolist()
        stops = np.frombuffer(ids.buffers()[1], np.int64).take(first).tolist()
        flat = (ids.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        out = [self.whole(t) if o or any(x in t for x in self.added) else flat[i:j] for t, o, i, j in zip(texts, odd, stops, stops[1:], strict=False)]
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        return out


def picked(mask: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    """What mask keeps of each array; by numbers, which is faster than by a mask of no pattern."""
    at = np.flatnonzero(mask)
    return [a.take(at) for a in arrays]


def compress(ids: np.ndarray, base: int, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules as pairs, expansion lengths)."""
    seq, lengths, rules = ids.astype(np.uint32), np.ones(0, np.uint32), []
    live = np.ones(len(seq), bool)  # places whose pair may be frequent
    live[-1:] = False
    odd = 0x9E3779B97F4A7C15
    while np.count_nonzero(live) >= least:
        at = np.flatnonzero(live)
        key = seq.take(at).astype(np.uint64) << HALF | seq.take(at + 1)
        bits = min(20, max(10, len(at).bit_length() - 1))
        cell = (key * np.uint64(odd) >> np.uint64(64 - bits)).view(np.int64)
        odd = (odd * 0xD6E8FEB86659FD93 + 2) % (1 << 64) | 1  # other pairs share a cell next time
        hot = (np.bincount(cell, minlength=1 << bits) >= least).take(cell)
        live[at] = hot
        at, key, cell = picked(hot, at, key, cell)
        owner = np.zeros(1 << bits, np.uint64)
        owner[cell] = key
        mine = owner.take(cell) == key
        at, key, cell = picked(mine, at, key, cell)
        count = np.bincount(cell, minlength=1 << bits).take(cell)
        live[at] = count >= least
        top = int(count.max(initial=0))
        if top < least:
            continue  # the cells' owners are settled; other pairs own them next time
        taken = count >= max(least, top // SPREAD)
        at, key, cell, count = picked(taken, at, key, cell, count)
        rank = count.view(np.uint64) << HALF | cell.view(np.uint64)
        around = np.zeros(len(seq) + 2, np.uint64)
        around[at + 1] = rank
        best = (rank >= around.take(at)) & (rank >= around.take(at + 2))
        at, key, cell = picked(best, at, key, cell)
        # of overlapping occurrences of one pair every second one is replaced, from the left
        first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
        each = (np.arange(len(at)) - first) & 1 == 0
        at, key, cell = picked(each, at, key, cell)
        used = np.bincount(cell, minlength=1 << bits) >= 2
        at, key, cell = picked(used.take(cell), at, key, cell)
        name = np.cumsum(used) - 1
        pairs = np.empty(np.count_nonzero(used), np.uint64)
        pairs[name[cell]] = key
        seq[at] = base + len(lengths) + name[cell]
        sides = (pairs >> HALF).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        sizes = np.r_[np.uint32(1), lengths]
        lengths = np.r_[lengths, sum(sizes[np.maximum(x - base + 1, 0)] for x in sides)].astype(np.uint32)
        rules.append(pairs)
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, live = picked(stay, seq, live)
        live[-1:] = False
    flat = np.concatenate([np.empty(0, np.uint64), *rules])
    return seq, np.stack([flat >> HALF, flat & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32), lengths


def expansions(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """All rules' expansions in one array after the tokens 0..base-1, and where
    each symbol's expansion starts."""
    size = np.r_[np.ones(base, np.int64), lengths.astype(np.int64)]
    starts = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint32)
    flat[:base] = np.arange(base)
    done = base
    while done < len(size):
        # the rules up to the first that needs one of them
        part = rules[done - base :]
        later = np.flatnonzero((part >= done).any(1))
        n = int(later[0]) if len(later) else len(part)
        for side, shift in ((part[:n, 0], 0), (part[:n, 1], size[part[:n, 0]])):
            long, to = size[side], starts[done : done + n] + shift
            inner = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
            flat[np.repeat(to, long) + inner] = flat[np.repeat(starts[side], long) + inner]
        done += n
    return flat, starts


def decode(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """ids start..stop of a shard; only the symbols that cover them are expanded."""
    length = np.concatenate([np.ones(base, np.int64), lengths.astype(np.int64)])[symbols]
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return np.empty(0, np.uint32)
    i, j = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
    flat, begins = expansions(rules, lengths, base)
    length, before = length[i:j], int(ends[i] - length[i])
    shift = begins[symbols[i:j]] - (np.cumsum(length) - length)
    out = flat[np.repeat(shift, length) + np.arange(int(length.sum()))]
    return out[start - before : stop - before]


def write(docs: DataFrame, vocabulary: str, end_id: int = 2, shard_tokens: int = 1 << 18, batch: int = 256) -> DataFrame:
    """The shards of docs, stored."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        pieces = Pieces.of(sent.value)
        end = np.array([end_id], np.uint32).tobytes()
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        counts: list[int] = []
        blobs: list[bytes] = []
        n = 0

        def shard():
            nonlocal seq, before, n
            tokens = np.frombuffer(b"".join(blobs), np.uint32)
            symbols, rules, lengths = compress(tokens, pieces.base)
            row = [part, seq, before, n, list(ids), list(counts), pieces.base, rules.tobytes(), lengths.tobytes(), symbols.tobytes()]
            seq, before, n = seq + 1, before + n, 0
            ids.clear(), counts.clear(), blobs.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            names = [x.split()[0] for x in SHARDS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for b in batches:
            for at in range(0, b.num_rows, batch):
                some = b.slice(at, batch)
                texts = [t or "" for t in some.column(1).to_pylist()]
                for d, e in zip(some.column(0).to_pylist(), pieces.encode(texts), strict=True):
                    e += end
                    if n and n + len(e) // 4 > shard_tokens:
                        yield shard()
                    ids.append(d)
                    counts.append(len(e) // 4)
                    blobs.append(e)
                    n += len(e) // 4
        if n:
            yield shard()

    keys = F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h")  # rows of one id may be parted by their texts
    rows = docs.select(*keys, "text").repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return stored(rows.mapInArrow(released(run), SHARDS), "tokens")


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select(F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("offset"))

    def run(batches):
        KEPT.clear()
        for b in batches:
            for r in b.to_pylist():
                a = lambda k: np.frombuffer(r[k], np.uint32)  # noqa: B023, E731
                ids = decode(a("symbols"), a("rules").reshape(-1, 2), a("lengths"), r["base"])
                ends = np.cumsum(np.array(r["doc_tokens"], np.int64))
                starts = ends - r["doc_tokens"]
                crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["first_token"]), pa.array(r["doc_tokens"], pa.int64()), pa.array(crc, pa.int64()), pa.array([r["part"]] * len(crc), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "in_part", "n_tokens", "ids_crc32", "part"])

    docs = shards.mapInArrow(released(run), "doc_id bigint, in_part bigint, n_tokens bigint, ids_crc32 bigint, part int")
    # one row for each part of the writing job
    return docs.join(F.broadcast(offsets), F.col("part") == F.col("p")).select("doc_id", (F.col("offset") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")
