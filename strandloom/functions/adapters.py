"""Adapter matching and end labels of sequencing reads, as Arrow-batched functions.

Bases are bit masks (A 1, C 2, G 4, T 8); two positions match if their masks meet, so
IUPAC codes and masked low-quality bases (all four) match what they stand for.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import BASES, COMPLEMENT, IUPAC

MASK = np.zeros(256, np.uint8)
for _code, _bases in BASES.items():
    for _c in (_code, _code.lower()):
        MASK[ord(_c)] = sum(1 << "ACGT".index(b) for b in _bases)
RC = str.maketrans(IUPAC, COMPLEMENT)


def masks(seq: str, qual: str | None = None, qualmask: int = -1) -> np.ndarray:
    """Bit masks of a sequence; bases of quality <= qualmask match anything."""
    m = MASK[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)].copy()
    if qual and qualmask >= 0:
        m[np.frombuffer(qual.encode("latin-1", "replace"), np.uint8)[: len(m)] <= qualmask + 33] = 15
    return m


def mismatches(a: np.ndarray, b: np.ndarray) -> int:
    return int(((a & b) == 0).sum())


def prefix_match(a: str, b: str, rate: float, least: int = 8) -> bool:
    """The shorter one's length of both agrees within the mismatch rate."""
    n = min(len(a), len(b))
    return n >= least and mismatches(masks(a[:n]), masks(b[:n])) <= rate * n


def iupac_edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance on masks; most + 1 if larger."""
    x, y = masks(a), masks(b)
    row = np.arange(len(y) + 1)
    ramp = np.arange(len(y) + 1)
    for i, c in enumerate(x, 1):
        new = np.r_[i, np.minimum(row[:-1] + ((y & c) == 0), row[1:] + 1)]
        row = np.minimum.accumulate(new - ramp) + ramp
        if row.min() > most:
            return most + 1
    return min(int(row[-1]), most + 1)


def head_match(read: np.ndarray, adapter: np.ndarray, monomer: bool, least: int, rate: float, longest: int) -> tuple[int, int]:
    """(bases, mismatches) of the longest suffix of the adapter that starts the read;
    (0, 0) without one. monomer: the adapter's last base may go on. The last base of
    a match must match."""
    best = (0, 0)
    for i in range(least, min(len(read), longest) + 1):
        if i > len(adapter) and not monomer:
            break
        want = adapter[-i:] if i <= len(adapter) else np.r_[adapter, np.full(i - len(adapter), adapter[-1], np.uint8)]
        d = mismatches(read[:i], want)
        if d <= int(rate * i) and read[i - 1] & want[-1]:
            best = (i, d)
    return best


def label_read(seq: str, qual: str, start: str, end: str, min_start: int = 7, min_end: int = 9, rate: float = 0.06, longest: int = 120, qualmask: int = 16) -> tuple[str, str, str, int]:
    """(label, sequence, quality, strand) with adapters cut: S<n> where the start
    adapter opens the read, E<n> where the end adapter (its reverse complement first)
    does, or both when the other one closes it; reads that open with an end are
    turned round. A '+' ends an adapter whose last base may repeat."""
    parts = {}
    for kind, adapter, least in (("S", start, min_start), ("E", end, min_end)):
        mono, adapter = adapter.endswith("+"), adapter.rstrip("+")
        parts[kind] = (masks(adapter), mono, least)
    rseq, rqual = seq.translate(RC)[::-1], qual[::-1]
    found = {}
    for kind, (adapter, mono, least) in parts.items():
        for turned, s, q in ((False, seq, qual), (True, rseq, rqual)):
            found[kind, turned] = head_match(masks(s, q, qualmask), adapter, mono, least, rate, longest)[0] if len(adapter) else 0
    ahead, back = found["S", False] + found["E", True], found["S", True] + found["E", False]
    if not ahead and not back:
        return "", seq, qual, 0
    turned = back > ahead
    s, q = (rseq, rqual) if turned else (seq, qual)
    a, b = found["S", turned], found["E", not turned]
    if a + b >= len(s):
        return (f"S{a}" if a else "") + (f"E{b}" if b else ""), "", "", -1 if turned else 1
    return (f"S{a}" if a else "") + (f"E{b}" if b else ""), s[a : len(s) - b], q[a : len(q) - b], -1 if turned else 1


def head_masks(seqs: list[str], quals: list[str], width: int, qualmask: int) -> np.ndarray:
    """The masks of many reads' first bases, a row each; what a read lacks is 0."""
    grid = lambda texts, fill: np.frombuffer("".join(x[:width].ljust(width, fill) for x in texts).encode("latin-1", "replace"), np.uint8).reshape(len(texts), width)
    m = MASK[grid(seqs, "\0")]
    if qualmask >= 0:
        m[grid(quals, "\xff") <= qualmask + 33] = 15
    return m


def head_matches(heads: np.ndarray, lengths: np.ndarray, adapter: np.ndarray, monomer: bool, least: int, rate: float, longest: int) -> np.ndarray:
    """The bases of head_match for every row of heads, reads of these lengths."""
    best, k, least = np.zeros(len(heads), np.int64), len(adapter), max(1, least)
    if not k:
        return best
    for i in range(least, min(k, longest) + 1):
        d = ((heads[:, :i] & adapter[-i:]) == 0).sum(1)
        best[(lengths >= i) & (d <= int(rate * i)) & (heads[:, i - 1] & adapter[-1] != 0)] = i
    if monomer and longest > k:
        miss = (heads[:, k:longest] & adapter[-1]) == 0
        i = np.arange(k + 1, longest + 1)
        d = ((heads[:, :k] & adapter) == 0).sum(1)[:, None] + miss.cumsum(1)
        fits = (d <= (rate * i).astype(np.int64)) & ~miss & (i >= least) & (i <= lengths[:, None])
        best = np.where(fits.any(1), longest - fits[:, ::-1].argmax(1), best)
    return best


def cuts(head: pd.Series, tail: pd.Series, qhead: pd.Series, qtail: pd.Series, lengths: pd.Series, start: str, end: str, min_start: int = 7, min_end: int = 9, rate: float = 0.06, longest: int = 120, qualmask: int = 16) -> pd.DataFrame:
    """What label_read finds in reads of these first and last bases: the start adapter's
    bases a, the end adapter's bases b, and whether the read is turned."""
    n = lengths.to_numpy()
    ways = {False: head_masks(list(head), list(qhead), longest, qualmask), True: head_masks([x.translate(RC)[::-1] for x in tail], [x[::-1] for x in qtail], longest, qualmask)}
    found = {(kind, turned): head_matches(m, n, masks(text.rstrip("+")), text.endswith("+"), least, rate, longest) for kind, text, least in (("S", start, min_start), ("E", end, min_end)) for turned, m in ways.items()}
    turned = found["S", True] + found["E", False] > found["S", False] + found["E", True]
    return pd.DataFrame({"a": np.where(turned, found["S", True], found["S", False]), "b": np.where(turned, found["E", False], found["E", True]), "turned": turned})


def collapse_mates(seq1: str, qual1: str, seq2: str, qual2: str, least: int = 16, rate: float = 0.06) -> tuple[str, str] | None:
    """The consensus of mates that overlap (mate 2 reverse-complemented): the widest
    overlap within the rate; better quality wins where they differ."""
    other, q2 = seq2.translate(RC)[::-1], qual2[::-1]
    x, y = masks(seq1), masks(other)
    for n in range(min(len(x), len(y)), least - 1, -1):
        if mismatches(x[-n:], y[:n]) <= rate * n:
            mid = [(a, p) if p >= r else (b, r) for a, p, b, r in zip(seq1[-n:], qual1[-n:], other[:n], q2[:n], strict=True)]
            return seq1[:-n] + "".join(m[0] for m in mid) + other[n:], qual1[:-n] + "".join(m[1] for m in mid) + q2[n:]
    return None


def label(fastq: DataFrame, start: str, end: str, minlen: int = 18, minqual: float = 25, **how) -> DataFrame:
    """fastq with label, trimmed seq1 and qual1, strand and keep (long, good, not one
    base, trimmed); names get _TAG=<label>."""

    from strandloom.functions.sequence import is_homopolymer, mean_quality, reverse_complement

    longest = how.get("longest", 120)

    @F.pandas_udf("a int, b int, turned boolean")
    def find(head: pd.Series, tail: pd.Series, qhead: pd.Series, qtail: pd.Series, lengths: pd.Series) -> pd.DataFrame:
        return cuts(head, tail, qhead, qtail, lengths, start, end, **how)

    # only the reads' ends go to Python; adapters are cut off in the JVM
    seq, qual = (F.coalesce(c, F.lit("")) for c in ("seq1", "qual1"))
    ends = [f(x, F.lit(longest)) for x in (seq, qual) for f in (F.left, F.right)]
    a, b, turned = (F.col(f"__x.{c}") for c in ("a", "b", "turned"))
    inner = lambda s, back: F.when(a + b < F.length(seq), F.substring(F.when(turned, back).otherwise(s), a + 1, F.greatest(F.length(s) - a - b, F.lit(0)))).otherwise(F.when(a + b == 0, s).otherwise(""))
    tag = lambda c, k: F.when(c > 0, F.concat(F.lit(k), c)).otherwise("")
    rows = fastq.withColumn("__x", find(*ends, F.length(seq))).withColumns({
        "label": F.concat(tag(a, "S"), tag(b, "E")), "seq1": inner(seq, reverse_complement(seq)), "qual1": inner(qual, F.reverse(qual)),
        "strand": F.when(a + b == 0, 0).when(turned, -1).otherwise(1),
    }).drop("__x")
    good = (F.length("seq1") >= minlen) & (mean_quality(F.col("qual1")) >= minqual) & ~is_homopolymer(F.col("seq1"))
    return rows.withColumns({"keep": F.coalesce(good, F.lit(False)), "name": F.when(F.col("label") != "", F.concat("name", F.lit("_TAG="), "label")).otherwise(F.col("name"))})


def pseudomate(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))
