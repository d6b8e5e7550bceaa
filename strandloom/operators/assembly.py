"""Transcript assembly of one locus, as a grouped function.

A read is a walk along splice sites: a chain of introns between a start and an end,
either of which may be a labelled site or only as far as the read reached. Rare
junctions are dropped, labelled ends are clustered into sites, equal walks are summed,
and contained walks give their weight to the walks that contain them. Paths from a
start site to an end site are then built greedily from the heaviest walk by the best
compatible extension, until the paths explain enough of the bases; one round of
expectation-maximisation shares the weight of walks among the paths they fit, and
paths that are truncations, retain introns or are rare are removed.

Every choice has a total order (weight, then coordinates), so results do not depend on
the order of reads.
"""

from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property

from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame

from strandloom.operators.grouped import per_group
from strandloom.operators.islands import assemblable


@dataclass(frozen=True)
class Options:
    min_proportion: float = 0.01
    intron_filter: float = 0.15
    truncation_filter: float = 0.5
    end_cluster: int = 100
    cap_bonus: float = 5.0
    min_intron: int = 50
    min_overhang: int = 3
    min_cov: float = 2.0
    min_length: int = 100
    max_isoforms: int = 10
    require_cap: bool = False
    cap_filter: float = 0.02
    min_start: float = 0.0
    min_end: float = 0.0
    allow_incomplete: bool = False


@dataclass(frozen=True, order=True)
class Walk:
    left: int
    right: int
    introns: tuple[tuple[int, int], ...]
    starts: bool  # left is a site
    ends: bool  # right is a site

    def __hash__(self) -> int:
        return self._hash

    @cached_property
    def _hash(self) -> int:
        return hash((self.left, self.right, self.introns, self.starts, self.ends))

    @cached_property
    def length(self) -> int:
        return self.right - self.left - sum(r - l for l, r in self.introns)

    def exons(self) -> list[tuple[int, int]]:
        edges = [self.left, *[x for i in self.introns for x in i], self.right]
        return list(zip(edges[::2], edges[1::2], strict=True))


@dataclass
class Path:
    walk: Walk
    weight: float = 0.0


def prune_junctions(weights: dict, coverage, o: Options) -> set:
    """Junctions with enough of the mean coverage they span and of their site's total."""
    donors, acceptors = defaultdict(float), defaultdict(float)
    for (l, r), w in weights.items():
        donors[l] += w
        acceptors[r] += w
    out = set()
    for (l, r), w in weights.items():
        around = max((x for (a, b), x in weights.items() if a < r and b > l), default=w)
        if r - l >= o.min_intron and w >= o.min_proportion * max(around, coverage(l, r)) and w >= o.min_proportion * min(donors[l], acceptors[r]):
            out.add((l, r))
    return out


def cluster_ends(signal: dict, o: Options, total: float | None = None) -> dict[int, int]:
    """Position -> site (the heaviest position of its cluster), for clusters with at
    least min_proportion of the signal."""
    out, group = {}, []
    total = sum(signal.values()) if total is None else total

    def close():
        if group and sum(signal[p] for p in group) >= o.min_proportion * total:
            peak = max(group, key=lambda p: (signal[p], -p))
            out.update(dict.fromkeys(group, peak))
        group.clear()

    for p in sorted(signal):
        if group and p - group[-1] > o.end_cluster:
            close()
        group.append(p)
    close()
    return out


def capped_sites(site: dict[int, int], signal: dict, caps: dict, plain: dict, bounds: list[int], coverage, strand: int, o: Options) -> dict[int, int]:
    """Start sites that stay: with min_start of support, and either no splice site upstream
    of them, or less than intron_filter of their coverage running through from it, or
    cap_filter of their reads capped."""
    out = {}
    for peak in set(site.values()):
        members = [p for p, q in site.items() if q == peak]
        left, right = min(members), max(members)
        if sum(signal[p] for p in members) / o.cap_bonus < o.min_start:
            continue
        if strand == 1:
            near = max((b for b in bounds if b <= left), default=None)
            through, inside = (near, left), (right, right + 1)
        else:
            near = min((b for b in bounds if b >= right), default=None)
            through, inside = (right, near), (left - 1, left)
        capped, others = sum(caps.get(p, 0) for p in members), sum(plain.get(p, 0) for p in members)
        if near is None or through[0] == through[1] or coverage(*through) < o.intron_filter * coverage(*inside) or capped >= o.cap_filter * (capped + others):
            out.update(dict.fromkeys(members, peak))
    return out


def compatible(a: Walk, b: Walk) -> bool:
    """The walks overlap and agree on introns and sites where both reach."""
    l, r = max(a.left, b.left), min(a.right, b.right)
    if l >= r:
        return False
    if a.introns or b.introns:
        inside = lambda w: [i for i in w.introns if i[1] > l and i[0] < r]
        if inside(a) != inside(b):
            return False
    for x, y in ((a, b), (b, a)):
        if x.starts and y.left < x.left or x.ends and y.right > x.right:
            return False
    return True


def merge(a: Walk, b: Walk) -> Walk:
    return Walk(min(a.left, b.left), max(a.right, b.right), tuple(sorted(set(a.introns) | set(b.introns))), a.starts and a.left <= b.left or b.starts and b.left <= a.left, a.ends and a.right >= b.right or b.ends and b.right >= a.right)


def contains(a: Walk, b: Walk) -> bool:
    return a.left <= b.left and a.right >= b.right and (not b.starts or a.starts) and (not b.ends or a.ends) and compatible(a, b)


def assemble_paths(weights: dict[Walk, float], o: Options) -> list[Path]:
    """Paths that explain the walks of one strand."""
    if not o.allow_incomplete and not (any(w.starts for w in weights) and any(w.ends for w in weights)):
        return []  # no path of them has both ends
    walks = sorted(weights)
    free = {w: weights[w] * w.length for w in walks}
    total = sum(free.values())
    paths: list[Walk] = []
    tried: set[Walk] = set()
    while total and sum(free.values()) > o.min_proportion * total and len(paths) < o.max_isoforms * max(1, len(walks)):
        seeds = [w for w in walks if free[w] > 0 and w not in tried]
        if not seeds:
            break
        seed = max(seeds, key=lambda w: (free[w], w.starts and w.ends, w.length, -w.left, w.introns))
        tried.add(seed)
        path, used = seed, {seed}
        while not (path.starts and path.ends):
            options = [w for w in walks if w not in used and compatible(path, w) and not contains(path, w)]
            if not options:
                break
            best = max(options, key=lambda w: (weights[w] * (1 + free[w] / (weights[w] * w.length + 1e-9)) / (1 + abs(weights[w] - weights[seed]) / (weights[w] + weights[seed])), w.starts or w.ends, w.length, -w.left, w.introns))
            used.add(best)
            path = merge(path, best)
        if not (path.starts and path.ends) and not o.allow_incomplete:
            free[seed] = 0
            continue
        for w in walks:
            if contains(path, w):
                free[w] = 0
        if path not in paths:
            paths.append(path)
    return share_weights([Path(p) for p in paths], weights)


def share_weights(paths: list[Path], weights: dict[Walk, float], rounds: int = 2) -> list[Path]:
    """Walks' bases shared among the paths that contain them, by the paths' weight."""
    for p in paths:
        p.weight = weights.get(p.walk, 0.0) + 1e-6
    fits = [(w, x, [i for i, p in enumerate(paths) if contains(p.walk, w)]) for w, x in weights.items()]
    for _ in range(rounds):
        got = [0.0] * len(paths)
        for w, x, fit in fits:
            all_of = sum(paths[i].weight for i in fit)
            for i in fit:
                got[i] += x * w.length * paths[i].weight / all_of
        for p, g in zip(paths, got, strict=True):
            p.weight = g / max(1, p.walk.length)
    return paths


def remove_bad(paths: list[Path], o: Options) -> list[Path]:
    """Without truncations, retained introns and rare paths, in that order."""
    paths = sorted(paths, key=lambda p: (-p.weight, p.walk))
    inside = lambda a, b: a.left >= b.left and a.right <= b.right
    kept = [p for p in paths if not any(q is not p and p.walk.introns == q.walk.introns[: len(p.walk.introns)] or q is not p and p.walk.introns == q.walk.introns[len(q.walk.introns) - len(p.walk.introns) :] for q in paths if q is not p and len(q.walk.introns) > len(p.walk.introns) and inside(p.walk, q.walk) and p.weight < o.truncation_filter * (p.weight + q.weight))]
    paths, kept = kept, []
    for p in paths:
        spliced = [q for q in paths if q is not p and set(p.walk.introns) < set(q.walk.introns) and any(any(l <= a and b <= r for l, r in p.walk.exons()) for a, b in set(q.walk.introns) - set(p.walk.introns))]
        if not spliced or p.weight >= o.intron_filter * (p.weight + sum(q.weight for q in spliced)):
            kept.append(p)
    return [p for p in kept if p.weight >= o.min_proportion * sum(q.weight for q in kept if min(p.walk.right, q.walk.right) - max(p.walk.left, q.walk.left) >= 0.5 * (p.walk.right - p.walk.left))]


def assemble_locus(reads: list, o: Options = Options()) -> list[dict]:
    """Transcripts of a locus' reads (objects with strand, ranges as [(l, r)], splice, s_tag, e_tag,
    capped, weight)."""
    out = []
    for strand in (1, -1):
        mine = [r for r in reads if r.strand == strand or r.strand == 0]
        if not any(r.strand == strand for r in mine):
            continue
        junction, starts, ends, deltas, caps, plain = (defaultdict(float) for _ in range(6))
        for r in mine:
            if len(r.ranges) > 1 and r.strand == strand:
                for (a, b), (c, d), s in zip(r.ranges, r.ranges[1:], r.splice, strict=False):
                    if s and b - a >= o.min_overhang and d - c >= o.min_overhang:
                        junction[b, c] += r.weight
            for a, b in r.ranges:
                deltas[a] += r.weight
                deltas[b] -= r.weight
            left, right = r.ranges[0][0], r.ranges[-1][1]
            if r.strand == strand and r.s_tag and (r.capped or not o.require_cap):
                starts[left if strand == 1 else right] += r.weight * (o.cap_bonus if r.capped else 1)
                (caps if r.capped else plain)[left if strand == 1 else right] += r.weight
            if r.strand == strand and r.e_tag:
                ends[right if strand == 1 else left] += r.weight
        if not (starts and ends) and not o.allow_incomplete:
            continue  # without both kinds of sites no path is whole
        edges = sorted(deltas)

        def coverage(l, r, edges=edges, deltas=deltas):
            depth = bases = 0.0
            for a, b in zip(edges, edges[1:], strict=False):
                depth += deltas[a]
                bases += depth * max(0, min(b, r) - max(a, l))
            return bases / max(1, r - l)

        good = prune_junctions(junction, coverage, o)
        s_site, e_site = cluster_ends(starts, o), cluster_ends(ends, o)
        s_site = capped_sites(s_site, starts, caps, plain, sorted({x for j in good for x in j}), coverage, strand, o)
        held: dict[int, float] = defaultdict(int)
        for p, q in e_site.items():
            held[q] += ends[p]
        e_site = {p: q for p, q in e_site.items() if held[q] >= o.min_end}
        left_site, right_site = (s_site, e_site) if strand == 1 else (e_site, s_site)
        weights: dict[Walk, float] = defaultdict(float)
        for r in mine:
            introns, ok = [], True
            if len(r.ranges) > 1:
                for (_, b), (c, _), s in zip(r.ranges, r.ranges[1:], r.splice, strict=False):
                    if s and (b, c) in good:
                        introns.append((b, c))
                    elif s:
                        ok = False
            if not ok:
                continue
            left, right = r.ranges[0][0], r.ranges[-1][1]
            own = r.strand == strand
            at_left, at_right = (r.s_tag, r.e_tag) if strand == 1 else (r.e_tag, r.s_tag)
            l2 = left_site.get(left) if own and at_left else None
            r2 = right_site.get(right) if own and at_right else None
            l3, r3 = left if l2 is None else l2, right if r2 is None else r2
            if introns and not (l3 < introns[0][0] and r3 > introns[-1][1]) or l3 >= r3:
                l3, r3, l2, r2 = left, right, None, None
            weights[Walk(l3, r3, tuple(introns), l2 is not None, r2 is not None)] += r.weight
        left_end, right_end = (lambda r: r.ranges[0][0]), (lambda r: r.ranges[-1][1])
        five, three = (left_end, right_end) if strand == 1 else (right_end, left_end)
        own = [r for r in mine if r.strand == strand]
        capped, labelled, ended = [(five(r), r.weight) for r in own if r.capped], [(five(r), r.weight) for r in own if r.s_tag], [(three(r), r.weight) for r in own if r.e_tag]
        near = lambda signals, at: sum(w for p, w in signals if abs(p - at) <= o.end_cluster)
        for n, p in enumerate(remove_bad(assemble_paths(dict(weights), o), o)):
            w = p.walk
            if p.weight < o.min_cov or w.length < o.min_length:
                continue
            begin, end = (w.left, w.right) if strand == 1 else (w.right, w.left)
            caps, first, last = near(capped, begin), near(labelled, begin), near(ended, end)
            out.append({"strand": strand, "number": n, "left": w.left, "right": w.right, "ranges": w.exons(), "cov": p.weight, "s_reads": first, "s_capped": caps, "e_reads": last, "complete": w.starts and w.ends})
    return out


SCHEMA = "chrom string, locus bigint, transcript_id string, strand int, left int, right int, ranges array<struct<l:int,r:int>>, cov double, s_reads double, s_capped double, e_reads double, complete boolean"


def as_reads(rows: list[dict]) -> list[SimpleNamespace]:
    """Reads of a group, with splices for rows without them."""
    out = []
    for r in rows:
        if not r.get("splice"):
            r["splice"] = [True] * (len(r["ranges"]) - 1)
        out.append(SimpleNamespace(**r))
    return out


def assemble(reads: DataFrame, max_gap: int = 50, options: Options = Options()) -> DataFrame:
    """Transcripts of all loci that have both ends; a locus is one group."""
    columns = [c for c in ("chrom", "locus", "strand", "ranges", "splice", "s_tag", "e_tag", "capped", "weight") if c in reads.columns or c == "locus"]
    kept = assemblable(reads, max_gap, options.require_cap, whole=options.allow_incomplete).select(*columns)

    def run(key, rows):
        found = assemble_locus(as_reads(rows), options)
        same = ("strand", "left", "right", "cov", "s_reads", "s_capped", "e_reads", "complete")
        return [{"chrom": str(key[0]), "locus": key[1], "transcript_id": f"t.{key[0]}.{key[1]}.{'+' if t['strand'] == 1 else '-'}{t['number']}", **{k: t[k] for k in same}, "ranges": [{"l": a, "r": b} for a, b in t["ranges"]]} for t in found]

    return per_group(kept, ["chrom", "locus"], run, SCHEMA)


def condense(reads: DataFrame, max_gap: int = 0, options: Options = Options(end_cluster=50, min_cov=1, min_length=20)) -> DataFrame:
    """Loci as their sums of equal walks, ends snapped to sites: chrom, strand, ranges, s_tag, e_tag, weight."""
    columns = ["chrom", "locus", "strand", "ranges", "s_tag", "e_tag", "weight"]
    from strandloom.operators.islands import loci

    def run(key, group):
        rows: dict = defaultdict(float)
        # one read's ends are their own sites
        signal = {k: defaultdict(float) for k in ((1, "s"), (1, "e"), (-1, "s"), (-1, "e"))} if len(group) > 1 else {}
        for r in group if signal else ():
            strand = r["strand"]
            if strand:
                l, e = r["ranges"][0][0], r["ranges"][-1][1]
                if r["s_tag"]:
                    signal[strand, "s"][l if strand == 1 else e] += r["weight"]
                if r["e_tag"]:
                    signal[strand, "e"][e if strand == 1 else l] += r["weight"]
        sites = {k: cluster_ends(v, options) for k, v in signal.items() if v}
        for r in group:
            blocks, strand = list(r["ranges"]), r["strand"]
            if strand and sites:
                at = ("s", "e") if strand == 1 else ("e", "s")
                has = {"s": r["s_tag"], "e": r["e_tag"]}
                l = sites[strand, at[0]].get(blocks[0][0], blocks[0][0]) if has[at[0]] else blocks[0][0]
                e = sites[strand, at[1]].get(blocks[-1][1], blocks[-1][1]) if has[at[1]] else blocks[-1][1]
                if l < blocks[0][1] and e > blocks[-1][0] and (len(blocks) > 1 or l < e):
                    blocks[0] = (l, blocks[0][1]) if len(blocks) > 1 else (l, e)
                    blocks[-1] = (blocks[-1][0], e) if len(blocks) > 1 else (l, e)
            rows[strand, tuple(blocks), bool(r["s_tag"]), bool(r["e_tag"])] += r["weight"]
        chrom = str(key[0])
        return [{"chrom": chrom, "strand": int(s), "ranges": bl, "s_tag": st, "e_tag": en, "weight": w} for (s, bl, st, en), w in sorted(rows.items())]

    return per_group(loci(reads, max_gap).select(*columns), ["chrom", "locus"], run, "chrom string, strand int, ranges array<struct<l:int,r:int>>, s_tag boolean, e_tag boolean, weight double")


def quantify(reads: DataFrame, transcripts: DataFrame, rounds: int = 20) -> DataFrame:
    """transcript_id, weight: reads shared by expectation-maximisation among the
    transcripts that contain their blocks, by chrom; counts per distinct set of
    transcripts are summed before the rounds."""
    from pyspark.sql import functions as F

    from strandloom.operators import intervals as I
    from strandloom.operators.joins import range_join

    a = reads.select("chrom", "left", "right", "weight", "strand", F.col("ranges").alias("x"), F.monotonically_increasing_id().alias("id"))
    b = transcripts.select("chrom", "left", "right", "transcript_id", F.col("strand").alias("t_strand"), F.col("ranges").alias("y"))
    fit = range_join(a, b, ["chrom"], 2000).where(((F.col("strand") == F.col("t_strand")) | (F.col("strand") == 0)) & (I.shared_bases(F.col("x"), F.col("y")) == I.covered_length(F.col("x"))))
    sets = fit.groupBy("chrom", "id", "weight").agg(F.array_sort(F.collect_set("transcript_id")).alias("set")).groupBy("chrom", "set").agg(F.sum("weight").alias("weight"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({t for s in pdf["set"] for t in s})
        share = dict.fromkeys(names, 1.0)
        for _ in range(rounds):
            new = dict.fromkeys(names, 0.0)
            for s, w in zip(pdf["set"], pdf["weight"], strict=True):
                total = sum(share[t] for t in s) or 1.0
                for t in s:
                    new[t] += w * share[t] / total
            share = new
        return pd.DataFrame({"transcript_id": names, "weight": [share[t] for t in names]})

    return sets.groupBy("chrom").applyInPandas(run, "transcript_id string, weight double")
