"""Near-duplicate passages by compact windows.

For each of ``HASHES`` hash functions, the minima of a document's shingle hashes
form a Cartesian tree; a node (l, c, r) groups all runs [i, j] with
l <= i <= c <= j <= r, whose minimum is at c. Only nodes at least a passage wide
are kept, about 2n / width a function, found by sliding minima and one pass of a
stack. Nodes whose minimum no other document has end here.

Within a document, the nodes left of two functions are joined on the intervals
where their passage-wide runs start; documents that share both minima of such a
join meet. One that many share costs each of them one comparison, with the
smallest document that has it, and runs are compared exactly as sets.

Nodes in a join that no passage found explains go through all smaller ids that
share their one minimum, in blocks of bounded size: bitmaps of what stands
around c rule most out, the others are compared exactly, and the first that is
alike ends the search. So no family of passages is expanded into all its pairs,
and two functions must agree only for documents that no third one brings up.

Long lists, such as a common phrase makes, are filed anew before that, by the
minimum together with the rarest shingles around it. A run that is alike to
another shares ``PERCENT`` hundredths of its shingles with it, so of any few more
than it may miss, one is shared. A node asks for the rarest of each run about its
minimum and meets all nodes of its list that have one of them: no partner is lost,
and those that have only the phrase in common don't meet. What many nodes have is
not filed by itself: they meet once, whatever number of such shingles they share.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledeforge.llm.grouped import group_arrays
from ledeforge.llm.shingles import WIDTH, mixed, shingle_list
from ledeforge.llm.workers import tidy
from ledeforge.runtime import bounded_broadcast, input_partitions, materialize, release, settle

HASHES = 4
#: Functions that must agree with one, on a run that is to be looked up by that one alone.
ENOUGH = 2
#: Lists up to this length are looked through as they are; longer ones are filed anew by rare shingles. Both find the same partners.
LONG = 512
#: Shingles that more rows of a long list have bring these together once, under the list's key, instead of once a shingle.
COMMON = 64
#: Cells of whole lists that are broadcast.
HOT_ROWS = 200_000
#: Verdicts on pairs that a worker keeps.
VERDICTS = 20_000
#: Cells of a table of starts and ends of runs.
TABLE = 1 << 18
MIN_WORDS = 50
PERCENT = 80
#: Alignments that differ by fewer words belong to one run.
BAND = 24
BLOCK = 1024
BITS = 1024
#: Lists up to this length need no bitmaps.
FEW = 8
#: Words within which a repeated minimum is taken with the one before it.
NEARBY = 8
#: Passage widths from which a refuted run is parted at its widest gap instead of narrowed step by step.
SPLIT = 10
#: Shingles that a worker's tree building holds at once, but for one longer text.
CHUNK = 400_000
#: The largest reach that a node's row has room for.
_REACH = 4095
_GAP = np.zeros(1, dtype=np.uint64)
_SALT = np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``width`` values, by doubling."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def _nodes(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian trees' nodes that are at least ``width`` wide; zeros part the texts in ``h`` and stand at both its ends.

    A node so wide is the minimum of a run of ``width``, and so are the nodes
    that bound it; so only minima of such runs go through the stack. Among equal
    minima the first is the root.
    """
    none = np.zeros(0, np.int64)
    if len(h) < width + 2:
        return none, none, none
    low = np.zeros(len(h) + width - 1, dtype=h.dtype)
    low[width - 1 : len(h)] = _sliding(h, width, np.minimum)
    at = np.flatnonzero((_sliding(low, width, np.maximum) == h) | (h == 0))
    where, value = at.tolist(), h[at].tolist()
    left, right = [0] * len(where), [0] * len(where)
    stack: list[int] = []
    for k, v in enumerate(value):
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = where[k] - 1
        left[k] = where[stack[-1]] + 1 if stack else 0
        stack.append(k)
    l, r = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
    wide = (r - l + 1 >= width) & (h[at] > 0)
    return l[wide], at[wide], r[wide]


def compact_windows(h: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(l, c, r) of the nodes of one text's tree that are at least ``width`` wide; among equal minima the first is the root."""
    l, c, r = _nodes(np.concatenate([[0], np.maximum(h, 1), [0]]).astype(np.uint64), width)
    return list(zip((l - 1).tolist(), (c - 1).tolist(), (r - 1).tolist(), strict=True))


def best_runs(a: np.ndarray, b: np.ndarray, width: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """(a from, a to, b from, b to, similarity), ends included, of runs of shingles that match, the longest of ``b`` first.

    A run of ``b`` starts and ends with stretches of shingles that ``a`` has (or
    is widened from there to ``width``), and misses no more than similarity
    allows; runs of ``SPLIT`` widths that fail are parted. Whether a run counts is decided by the similarity of the sets alone.
    """
    if len(b) >= width and np.array_equal(a, b):
        return [(0, len(a) - 1, 0, len(b) - 1, 1.0)]
    out: list[tuple[int, int, int, int, float]] = []
    code = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    a, b = code[: len(a)], code[len(a) :]
    fresh_a = _first(a, len(code))
    known = _sums(_first(b, len(code)))
    held = np.zeros(len(code), dtype=bool)
    held[a] = True
    match = np.zeros(len(b) + 2, dtype=bool)
    match[1:-1] = held[b]
    edge = np.flatnonzero(match[1:] != match[:-1])
    starts, ends = edge[::2], edge[1::2]
    hits = _sums(match[1:-1])
    todo = [(0, len(starts), 0, len(b))]
    while todo:
        p, q, lo, hi = todo.pop()
        if p == q or hi - lo < width:
            continue
        found = None
        runs = _long_runs(starts[p:q], ends[p:q], hits, width, percent)
        while len(runs):
            x, y = runs[0].tolist()
            if y - x < width:
                x = min(max(x - (width - y + x) // 2, lo), hi - width)
                y = x + width
            most, run = _partner(a, fresh_a, b[x:y], percent)
            if run:
                found = x, y, run
                break
            if y - x >= SPLIT * width:
                # refuted as a whole: its two sides are looked through on their own, as far from each other as can be
                m = p + 1 + int((starts[p + 1 : q] - ends[p : q - 1]).argmax())
                cut = int(ends[m - 1] + starts[m]) // 2
                todo += [(p, m, lo, cut), (m, q, cut, hi)]
                break
            # what matches within a refuted run is no more than matches in it
            inside = (runs[:, 0] >= x) & (runs[:, 1] <= y) & (runs[:, 1] - runs[:, 0] >= width)
            gone = inside & (percent * (known[runs[:, 1]] - known[runs[:, 0]]) > most)
            gone[0] = True
            runs = runs[~gone]
        if found is None:
            continue
        x, y, (a_lo, a_hi, sim) = found
        out.append((a_lo, a_hi, x, y - 1, sim))
        todo += [(p, int(np.searchsorted(ends, x, "right")), lo, x), (int(np.searchsorted(starts, y)), q, y, hi)]
    return out


def _first(codes: np.ndarray, n: int) -> np.ndarray:
    """Marks the first place of each code below ``n``."""
    place, at = np.full(n, len(codes)), np.arange(len(codes))
    np.minimum.at(place, codes, at)
    return place[codes] == at


def _sums(x: np.ndarray) -> np.ndarray:
    """Running sums from 0 on."""
    out = np.zeros(len(x) + 1, dtype=np.int64)
    np.cumsum(x, out=out[1:])
    return out


def _long_runs(starts: np.ndarray, ends: np.ndarray, hits: np.ndarray, width: int, percent: int) -> np.ndarray:
    """(from, to) between stretches that hold enough hits to be ``percent`` alike to anything, the longest first."""
    # many starts at once, as far as a table of theirs and all ends stays small
    runs, step = [], max(1, TABLE // len(starts))
    first, last = hits[starts], hits[ends]
    for k in range(0, len(starts), step):
        long = np.maximum(ends[k:] - starts[k : k + step, None], width)
        x, y = np.nonzero((100 * (last[k:] - first[k : k + step, None]) >= percent * long) & (ends[k:] > starts[k : k + step, None]))
        runs.append(np.stack([starts[k + x], ends[k + y]], axis=1))
    all_ = runs[0] if len(runs) == 1 else np.concatenate(runs)
    return all_[np.lexsort((all_[:, 0], all_[:, 0] - all_[:, 1]))]


def _partner(a: np.ndarray, fresh: np.ndarray, run: np.ndarray, percent: int) -> tuple[int, tuple[int, int, float] | None]:
    """The most that any run of ``a`` can weigh, and (from, to, similarity) of the one most like ``run`` if it is alike; ends included.

    Sets are alike where (100 + percent) * both >= percent * (n + m): a hit in
    ``a`` weighs 100 and a miss -percent, and the sum is percent * m or more. Where
    ``a`` repeats itself, only the first or the last place of a shingle counts as
    well. ``fresh`` marks the first places in ``a``; only they weigh in the bound.
    """
    held = np.zeros(int(max(a.max(initial=0), run.max())) + 1, dtype=bool)
    held[run] = True
    match = held[a]
    plain = bool(fresh.all())
    lo, end, most = _heaviest(np.where(match, 100, -percent if plain else np.where(fresh, -percent, 0)))
    m = int(np.count_nonzero(held))
    if most < percent * m:
        return most, None
    if plain:  # what weighs in the bound is the set itself
        both = int(np.count_nonzero(match[lo : end + 1]))
        either = end + 1 - lo + m - both
        return most, (lo, end, both / either) if 100 * both >= percent * either else None
    at = np.flatnonzero(match)
    first, last = np.unique(a[at], return_index=True)[1], len(at) - 1 - np.unique(a[at][::-1], return_index=True)[1]
    best = None
    for places in [at] if len(first) == len(at) else [at, at[first], at[last]]:
        weight = np.where(match, 0, -percent)
        weight[places] = 100
        lo, end, _ = _heaviest(weight)
        x = np.unique(a[lo : end + 1])
        both = int(held[x].sum())
        either = len(x) + m - both
        if 100 * both >= percent * either and (best is None or both / either > best[2]):
            best = lo, end, both / either
    return most, best


def _heaviest(weight: np.ndarray) -> tuple[int, int, int]:
    """(from, to, sum) of the run with the largest sum; ends included."""
    total = _sums(weight)
    gain = total[1:] - np.minimum.accumulate(total[:-1])
    end = int(gain.argmax())
    return int(total[: end + 1].argmin()), end, int(gain[end])


class Verdicts:
    """Whether runs about the middle of one stretch of shingles are alike to runs of others; pairs of the same pattern are compared once.

    A shingle's number is its first place in the one stretch; what stands there
    nowhere gets a number of its own, and what lies outside the first and the last
    shingle of both is left out, as no run that is alike begins or ends with it.
    """

    def __init__(self, width: int, percent: int, most: int = VERDICTS):
        self.width, self.percent, self.most = width, percent, most
        self.held: dict[tuple[int, bytes, bytes], bool] = {}

    def first(self, own: np.ndarray, middle: int, others: list[np.ndarray], stop: int) -> list[int]:
        """Places among ``others`` of those that are alike, in order, up to ``stop`` of them."""
        out: list[int] = []
        if not others:
            return out
        known, at, place = np.unique(own, return_index=True, return_inverse=True)
        at = at.astype(np.int32)
        mine = at[place]
        name = mine.tobytes()
        flat, size = np.concatenate(others), np.array([len(y) for y in others])
        end = np.cumsum(size)
        k = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        same = known[k] == flat
        hit, lone = np.flatnonzero(same), np.flatnonzero(~same)
        if not len(hit):
            return out
        left, right = np.searchsorted(hit, end - size), np.searchsorted(hit, end)
        lo, hi = hit[np.minimum(left, len(hit) - 1)], hit[right - 1] + 1
        row, code = np.searchsorted(end, lone, "right"), at[k]
        code[lone] = len(own) + np.arange(len(lone)) - np.searchsorted(lone, lo)[row]
        # strange shingles that repeat have one number
        inside = (lone >= lo[row]) & (lone < hi[row])
        row, strange = row[inside], flat[lone[inside]]
        order = np.lexsort((strange, row))
        twice = set(row[order][1:][(np.diff(row[order]) == 0) & (strange[order][1:] == strange[order][:-1])].tolist())
        for n, (x, y) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
            if left[n] == right[n]:
                continue
            piece = code[x:y]
            if n in twice:
                piece[~same[x:y]] = len(own) + np.unique(flat[x:y][~same[x:y]], return_inverse=True)[1]
            pattern = middle, name, piece.tobytes()
            if pattern not in self.held:
                if len(self.held) >= self.most:
                    self.held.clear()
                self.held[pattern] = any(lo <= middle <= hi for _, _, lo, hi, _ in best_runs(piece, mine, self.width, self.percent))
            if self.held[pattern]:
                out.append(n)
                if len(out) >= stop:
                    break
        return out


def _pairs(meets: DataFrame, enough: int) -> DataFrame:
    """Runs (a, a_lo, a_hi, b, b_lo, b_hi) on which ``enough`` functions agree, from aligned windows of two documents."""
    names = ["a", "a_lo", "a_hi", "b", "b_lo", "b_hi"]

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in group_arrays(batches, ["a", "b"], ["ca", "cb", "left", "right", "fn"], least=enough):
            a, b = int(g["a"][0]), int(g["b"][0])
            runs: list[list[int]] = []  # lo, hi in b; lo, hi in a; functions; last shift
            for x, y, left, right, fn in sorted(zip(*(g[c].tolist() for c in ("ca", "cb", "left", "right", "fn")), strict=True), key=lambda w: (w[1] - w[2], w[0])):
                lo, hi, shift = y - left, y + right, x - y
                for r in runs:
                    if lo <= r[1] and hi >= r[0] and abs(shift - r[5]) <= BAND:
                        r[0], r[1], r[2], r[3], r[4], r[5] = min(r[0], lo), max(r[1], hi), min(r[2], x - left), max(r[3], x + right), r[4] | 1 << fn, shift
                        break
                else:
                    runs.append([lo, hi, x - left, x + right, 1 << fn, shift])
            out += [(a, r[2], r[3], b, r[0], r[1]) for r in runs if r[4].bit_count() >= enough]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    dealt = meets.repartition(input_partitions(meets.sparkSession), "a", "b").sortWithinPartitions("a", "b")
    return dealt.mapInPandas(tidy(joined), "a long, a_lo long, a_hi long, b long, b_lo long, b_hi long")


def _exact(runs: DataFrame, shingles: DataFrame, width: int, percent: int) -> DataFrame:
    """The passages of ``runs`` that are alike, in shingle positions of their documents."""
    runs = runs.withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in ("a_lo", "b_lo")})
    # only the runs' own bytes travel on; 4 bytes a shingle
    cut = lambda lo, hi: F.substring(F.col("s"), (F.col(lo) * 4 + 1).cast("int"), ((F.col(hi) - F.col(lo) + 1) * 4).cast("int"))
    with_b = runs.join(shingles.withColumnRenamed("id", "b"), "b").withColumn("sb", cut("b_lo", "b_hi")).drop("s")
    with_a = with_b.join(shingles.withColumnRenamed("id", "a"), "a").withColumn("sa", cut("a_lo", "a_hi")).drop("s")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for a, a0, b, b0, sa, sb in zip(*(frame[c] for c in ("a", "a_lo", "b", "b_lo", "sa", "sb")), strict=True):
                for al, ah, bl, bh, sim in best_runs(np.frombuffer(sa, np.uint32), np.frombuffer(sb, np.uint32), width, percent):
                    out.append((a, a0 + al, a0 + ah, b, b0 + bl, b0 + bh, sim))
            if out:
                yield pd.DataFrame(out, columns=["a", "a_lo", "a_hi", "b", "b_lo", "b_hi", "sim"])

    return with_a.mapInPandas(tidy(compare), "a long, a_lo long, a_hi long, b long, b_lo long, b_hi long, sim double")


def _around(members: DataFrame, shingles: DataFrame, width: int, percent: int, start: int, stop: int, exact: bool = False) -> DataFrame:
    """Windows (as ``_pairs`` takes them) of unexplained rows with the others of their lists, by what stands around c.

    A row's partners in a block have a fixed order, the smallest id first and
    then the closest; those from ``start`` to ``stop`` are given, and ``more``
    tells whether others follow. With ``exact``, only those are partners that
    hold a run about c that is alike, and one is enough.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.count_if("open").alias("open")).filter((F.col("open") > 0) & (F.col("g") > 1)).select("key", F.ceil(F.col("g") / BLOCK).cast("int").alias("nb"))
    rows = members.join(sizes, "key").join(shingles, "id")
    lo = F.greatest(F.col("c") - width, F.lit(0))
    rows = rows.withColumn("near", F.substring(F.col("s"), (lo * 4 + 1).cast("int"), ((F.col("c") + width - lo + 1) * 4).cast("int"))).drop("s")
    mine = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other", "nb")

    least = -(-percent * 2 * width // (100 + percent))

    spans = np.arange(-(-percent * width // 100), 100 * width // percent + 1)  # lengths that runs alike to one of ``width`` have
    least_both = -(-percent * (width + spans) // (100 + percent))

    def holding(own: np.ndarray, c: int, others: list[bytes]) -> np.ndarray:
        """Whether some run of ``own`` about c and some run of each of ``others`` hold enough of each other; where shingles repeat, only the first counts."""
        lo, hi = max(0, c - width + 1), min(c, len(own) - width) + 1
        if lo >= hi:
            return np.zeros(len(others), dtype=bool)
        order = own.argsort()
        known, place = own[order], np.empty(len(own), dtype=np.int64)
        place[order] = np.arange(len(own))
        if (repeats := known[1:] == known[:-1]).any():
            known, place = np.unique(own, return_inverse=True)
        size = np.array([len(y) // 4 for y in others])
        flat, row = np.frombuffer(b"".join(others), np.uint32), np.repeat(np.arange(len(others)), size)
        k = np.searchsorted(known, flat)
        np.minimum(k, len(known) - 1, out=k)
        same = known[k] == flat
        held = np.zeros((len(others), len(known)), dtype=bool)
        held[row[same], k[same]] = True
        total = np.zeros((len(others), len(own) + 1), dtype=np.int32)
        np.cumsum(held[:, place], axis=1, out=total[:, 1:])
        most = (total[:, lo + width : hi + width] - total[:, lo:hi]).max(axis=1)
        fits = 100 * most >= percent * width
        if repeats.any() or not fits.any():
            return fits
        # the other side of those left; positions past a text's end stay without hits
        left, most = np.flatnonzero(fits), most[fits]
        if len(left) < len(others):
            same, size = same[fits[row]], size[left]
            row = np.repeat(np.arange(len(left)), size)
        back = np.zeros((len(left), int(size.max()) + 1), dtype=np.int32)
        back[row, np.arange(len(same)) - np.repeat(np.cumsum(size) - size, size) + 1] = same
        back = np.cumsum(back, axis=1, dtype=np.int32)
        ok = np.zeros(len(left), dtype=bool)
        for n, need in zip(spans.tolist(), least_both.tolist(), strict=True):
            if ok.all() or need > most.max():  # longer ones need more
                break
            n = min(n, back.shape[1] - 1)
            ok |= (most >= need) & ((back[:, n:] - back[:, : back.shape[1] - n]).max(axis=1) >= need)
        fits[left] = ok
        return fits

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["a", "b", "shift", "ca", "cb", "left", "right", "fn", "more"]
        out: list[tuple] = []
        verdicts = Verdicts(width, percent)
        for g in group_arrays(batches, ["key", "i", "j"], ["id", "open", "mine", "c", "l", "r", "fn", "near"]):
            ids, open_, mine, near = g["id"], g["open"].astype(bool), g["mine"], g["near"]
            if not open_.any():
                continue
            c, l, r, fn = (g[x].astype(np.int64) for x in ("c", "l", "r", "fn"))
            few = exact and len(ids) <= FEW
            size = np.array([len(s) // 4 for s in near])
            if not few:
                spot = np.repeat(np.arange(len(near)) * BITS, size) + np.frombuffer(b"".join(near), np.uint32) % BITS
                bits = np.packbits((np.bincount(spot, minlength=len(near) * BITS) & 1).astype(bool)).view(np.uint64).reshape(len(near), -1)
            across = g["i"][0] != g["j"][0]
            for x in np.flatnonzero(open_).tolist():
                at = np.flatnonzero(ids < ids[x])
                if across:
                    at = at[mine[at] != mine[x]]
                if not len(at):
                    continue
                # two alike passages around c share so many shingles of what stands there
                apart = np.zeros(len(at), dtype=np.int64) if few else np.bitwise_count(bits[at] ^ bits[x]).sum(axis=1, dtype=np.int64)
                fits = apart <= size[at] + size[x] - 2 * least
                at, apart = at[fits], apart[fits]
                if len(at) > start:
                    least_id = np.flatnonzero(ids[at] == ids[at].min())
                    lead = least_id[np.lexsort((r[at[least_id]], l[at[least_id]], c[at[least_id]], apart[least_id]))[0]] if len(least_id) > 1 else least_id[0]
                    apart[lead] = -1  # goes first
                    if exact:
                        own, middle = np.frombuffer(near[x], np.uint32), min(int(c[x]), width)
                        held = holding(own, middle, [near[y] for y in at.tolist()])
                        at, apart = at[held], apart[held]
                    if len(at) > 1:
                        at = at[np.lexsort((r[at], l[at], c[at], ids[at], apart))]
                    if exact:
                        at = at[verdicts.first(own, middle, [np.frombuffer(near[y], np.uint32) for y in at.tolist()], stop)]
                    more = len(at) > stop
                    for y in at[start:stop].tolist():
                        out.append((ids[y], ids[x], c[y] - c[x], c[y], c[x], min(c[y] - l[y], c[x] - l[x]), min(r[y] - c[y], r[x] - c[x]), fn[x], more))
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=cols)
                out = []
        if out:
            yield pd.DataFrame(out, columns=cols)

    dealt = rows.repartition(input_partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInPandas(tidy(pairs), "a long, b long, shift long, ca long, cb long, left long, right long, fn long, more boolean")


def _named(key: int | np.ndarray, near: np.ndarray) -> np.ndarray:
    """Cells: shingles hashed with their row's list."""
    return mixed(np.asarray(key, dtype=np.int64).view(np.uint64) + mixed(near.astype(np.uint64))).view(np.int64)


def _cells(rows: DataFrame) -> DataFrame:
    """(row, open, key, cell) of what stands around the minimum of each row, each cell once a row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            flat = [np.unique(np.frombuffer(s, np.uint32)) for s in b["near"]]
            size = np.array([len(x) for x in flat])
            key = np.repeat(b["key"].to_numpy(np.int64), size)
            yield pd.DataFrame({"row": np.repeat(b["row"].to_numpy(np.int64), size), "open": np.repeat(b["open"].to_numpy(bool), size), "key": key, "cell": _named(key, np.concatenate(flat))})

    return rows.select("row", "open", "key", "near").mapInPandas(tidy(each), "row long, open boolean, key long, cell long")


def _by_list(cells: DataFrame) -> DataFrame:
    """(key, hot, hot_often): a list's cells in order and their counts; they go to all tasks where they are few."""
    out = cells.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("cell", "often"))).alias("x")).select("key", F.col("x.cell").alias("hot"), F.col("x.often").alias("hot_often"))
    return F.broadcast(out) if cells.limit(HOT_ROWS + 1).count() <= HOT_ROWS else out


def _counts(cells: np.ndarray, known: np.ndarray | None, often: np.ndarray | None, out: np.ndarray) -> None:
    """Puts the counts of those ``cells`` that are in ``known``, which is sorted, into ``out``."""
    if known is None or not len(known):
        return
    k = np.minimum(np.searchsorted(known, cells), len(known) - 1)
    same = known[k] == cells
    out[same] = often[k[same]]


def rarest(cells: np.ndarray, often: np.ndarray, middle: int, width: int, percent: int) -> np.ndarray:
    """Of each run of ``width`` places about ``middle``, the rarest cells, as many as any alike run must share one of; those that stand elsewhere too."""
    order = np.lexsort((cells, often))
    rank = np.zeros(len(cells), dtype=np.int64)
    rank[order[1:]] = np.cumsum(cells[order[1:]] != cells[order[:-1]])
    at, chosen = range(max(0, middle - width + 1), min(middle, len(cells) - width) + 1), []
    if len(at) and rank.max() == len(rank) - 1:  # no cell repeats
        runs = np.lib.stride_tricks.sliding_window_view(rank[at[0] : at[-1] + width], width)
        many = width - -(-percent * width // 100) + 1
        chosen, at = [np.partition(runs, many - 1, axis=1)[:, :many].ravel()], range(0)
    for x in at:
        run = np.unique(rank[x : x + width])
        chosen.append(run[: len(run) - -(-percent * len(run) // 100) + 1])
    if not chosen:
        return np.zeros(0, dtype=np.int64)
    held = np.isin(rank, np.concatenate(chosen)) & (often > 1)
    return np.unique(cells[held])


def _filed_anew(members: DataFrame, shingles: DataFrame, width: int, percent: int) -> DataFrame:
    """``members`` of long lists, filed by a cell instead of their list: open ones, as such, where they ask for it, and all where they have it."""
    lo = F.greatest(F.col("c") - width, F.lit(0))
    near = F.substring(F.col("s"), (lo * 4 + 1).cast("int"), ((F.col("c") + width - lo + 1) * 4).cast("int"))
    # only what stands around the minima travels on
    rows = members.join(shingles, "id").select(*members.columns, near.alias("near"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "passage-long")
    settle(members.sparkSession)
    # a cell that one row has, or no open one, brings nobody together
    often = _cells(rows).groupBy("cell").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("often"), F.max("open").alias("open")).filter(F.col("open") & (F.col("often") > 1))
    # what a good part of a list has, some thousand cells at most, goes with the list and is not joined row by row
    sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("g")), "passage-sizes")
    hot = F.col("often") > F.greatest(F.lit(COMMON), F.col("g") / COMMON)
    often = materialize(often.join(bounded_broadcast(sizes), "key").select("key", "cell", "often", hot.alias("hot")), "passage-often")
    settle(members.sparkSession)
    opened = rows.filter("open")
    own = _cells(opened).join(bounded_broadcast(often.filter(~F.col("hot")).select("cell", "often")), "cell").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("cell", "often"))).alias("x"))
    own = own.select("row", F.col("x.cell").alias("own"), F.col("x.often").alias("own_often"))
    around = opened.select("row", "key", "near", F.least("c", F.lit(width)).alias("middle")).join(own, "row", "left").join(_by_list(often.filter("hot")), "key", "left")

    def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cells, of, listed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for row, key, near, middle, own, own_often, hot, hot_often in zip(*(b[c] for c in ("row", "key", "near", "middle", "own", "own_often", "hot", "hot_often")), strict=True):
                cell = _named(key, np.frombuffer(near, np.uint32))
                count = np.ones(len(cell), dtype=np.int64)
                _counts(cell, own, own_often, count)
                _counts(cell, hot, hot_often, count)
                cell = rarest(cell, count, int(middle), width, percent)
                cells.append(cell)
                of.append(np.full(len(cell), row))
                listed.append(np.isin(cell, hot) if hot is not None else np.zeros(len(cell), dtype=bool))
            yield pd.DataFrame({"cell": np.concatenate(cells), "row": np.concatenate(of), "hot": np.concatenate(listed)})

    asked = materialize(around.repartition(input_partitions(members.sparkSession), "row").mapInPandas(tidy(asks), "cell long, row long, hot boolean"), "passage-asked")
    wanted = materialize(often.join(bounded_broadcast(asked.select("cell").distinct()), "cell", "left_semi"), "passage-wanted")

    def among(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            have = [bool(np.isin(_named(key, np.frombuffer(near, np.uint32)), hot).any()) for key, near, hot in zip(b["key"], b["near"], b["hot"], strict=True)]
            yield b.loc[np.array(have, dtype=bool), ["row"]]

    # a row's common cells become one entry before anything is dealt out
    entry = lambda df, common, open_: df.select("row", F.when(~common, F.col("cell")).alias("cell"), F.lit(open_).alias("open"))
    some = bounded_broadcast(wanted.filter(~F.col("hot")).select("cell", (F.col("often") > COMMON).alias("common")))
    lists = rows.select("row", "key", "near").join(_by_list(wanted.filter("hot")).select("key", "hot"), "key").mapInPandas(tidy(among), "row long").withColumn("cell", F.lit(None).cast("long"))
    filed = entry(_cells(rows).join(some, "cell"), F.col("common"), False).union(entry(lists, F.lit(True), False))
    filed = filed.union(entry(asked.filter(~F.col("hot")).join(some, "cell"), F.col("common"), True)).union(entry(asked.filter("hot"), F.lit(True), True))
    filed = filed.groupBy("row", "cell").agg(F.max("open").alias("open"))
    filed = filed.join(rows.drop("open", "near"), "row").select(F.coalesce("cell", "key").alias("key"), "id", "l", "c", "r", "fn", "open")
    filed = materialize(filed, "passage-filed")
    # only smaller ids are asked for
    lists = filed.groupBy("key").agg(F.min("id").alias("least"), F.max(F.when(F.col("open"), F.col("id"))).alias("last")).filter(F.col("least") < F.col("last")).select("key", "last")
    out = materialize(filed.join(lists, "key").filter(F.col("id") <= F.col("last")).drop("last"), "passage-anew")
    release(filed)
    release(rows, sizes, often, asked, wanted)
    settle(members.sparkSession)
    return out


def _unexplained(members: DataFrame, passages: DataFrame) -> DataFrame:
    """``members`` whose ``open`` is kept only where no passage found, as the later of the two, holds their minimum."""
    spans = passages.select(F.col("b").alias("id"), F.struct(F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi")).alias("s")).groupBy("id").agg(F.collect_set("s").alias("spans"))
    held = F.exists("spans", lambda s: (s["lo"] <= F.col("c")) & (F.col("c") <= s["hi"]))
    return members.join(spans, "id", "left").withColumn("open", F.col("open") & ~F.coalesce(held, F.lit(False))).drop("spans")


def _retried(members: DataFrame, shingles: DataFrame, width: int, percent: int) -> list[DataFrame]:
    """The passages of unexplained rows: each goes through its list until a partner is alike about its minimum, or none is left."""
    windows = materialize(_around(members, shingles, width, percent, 0, 1, exact=True), "passage-windows")
    found = materialize(_exact(materialize(_pairs(windows, 1), "passage-runs"), shingles, width, percent), "passages")
    release(windows)
    settle(members.sparkSession)
    return [found]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """(``id_col``, start, n_words, first_id, first_start, first_n_words, similarity) of passages that also stand in an earlier document.

    Positions count words from 0. A passage has ``min_words`` words or more,
    and its set of 5-word shingles has similarity ``percent`` hundredths or more
    with that of the passage named beside it, which stands in a document with a
    smaller id: the smallest that shares the minimum by which they met. That other
    passage may be shorter, by as much as the similarity allows. Shingles are
    compared by 32-bit hashes within a pair. Null, empty and short texts
    have no passages; rows with a null id are left out, and rows that repeat an
    id are not compared with each other.
    """
    width = min_words - WIDTH + 1
    reach = min(3 * width, _REACH)
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        texts: list[np.ndarray] = []
        held = 0
        for b in batches:
            for doc, text in zip(b["id"].to_numpy(), b["text"], strict=True):
                s = shingle_list(text)
                if len(s) < width:
                    continue
                ids.append(doc)
                texts += [_GAP, s]
                held += len(s)
                if held >= CHUNK:
                    yield _filed(ids, texts, width, reach)
                    ids, texts, held = [], [], 0
        if ids:
            yield _filed(ids, texts, width, reach)

    filed = materialize(src.mapInPandas(tidy(nodes), "key long, id long, p long"), "passage-nodes")
    # one counter a key and task goes out; the join's hot keys are split by adaptive execution
    lists = filed.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).filter(F.col("pivot") < F.col("top")).select("key", "pivot")
    shared = materialize(filed.join(lists, "key"), "passage-shared")
    release(filed)
    settle(spark)

    joint = materialize(_joint(shared, width), "passage-joint")
    release(shared)
    settle(spark)
    unpacked = {"l": F.col("c") - F.shiftright("p", 14).bitwiseAND(F.lit(_REACH)), "c": F.col("c"), "r": F.col("c") + F.shiftright("p", 2).bitwiseAND(F.lit(_REACH)), "fn": F.col("p").bitwiseAND(F.lit(3))}
    single = joint.filter(~F.col("pair")).withColumn("c", F.shiftright("p", 26)).select("key", "id", *(x.cast("int").alias(k) for k, x in unpacked.items()), "rich", "pivot")
    double = joint.filter("pair").select("key", "id", F.col("p").alias("c"))
    pivots = double.groupBy("key").agg(F.min(F.struct("id", "c")).alias("first"), F.max("id").alias("top")).filter(F.col("first.id") < F.col("top"))
    # a pair's joins at one shift make one window, from the first to the last
    shift = F.col("first.c") - F.col("c")
    star = double.join(pivots, "key").filter(F.col("id") > F.col("first.id")).groupBy(F.col("first.id").alias("a"), F.col("id").alias("b"), shift.alias("shift")).agg(F.min("c").alias("cb"), F.max("c").alias("last"))
    star = star.select("a", "b", "shift", (F.col("cb") + F.col("shift")).alias("ca"), "cb", F.lit(reach).cast("long").alias("left"), (F.col("last") - F.col("cb") + reach).alias("right"), F.lit(0).cast("long").alias("fn"))
    runs = materialize(_pairs(star, 1), "passage-runs")
    settle(spark)

    def texts_of(ids: DataFrame) -> DataFrame:
        def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"id": b["id"], "s": [(shingle_list(t) >> np.uint64(32)).astype(np.uint32).tobytes() for t in b["text"]]})

        ids = materialize(ids.distinct(), "passage-ids")
        out = materialize(src.join(bounded_broadcast(ids), "id", "left_semi").mapInPandas(tidy(hashes), "id long, s binary"), "passage-shingles")
        release(ids)
        return out

    shingles = texts_of(runs.select(F.col("a").alias("id")).union(runs.select("b")))
    first = materialize(_exact(runs, shingles, width, percent), "passages")
    release(runs)
    settle(spark)
    # rows whose minimum lies in a passage found are explained, and the smallest id of a list has none before it
    opened = materialize(_unexplained(single.withColumn("open", F.col("rich") & (F.col("id") != F.col("pivot"))), first).drop("rich", "pivot"), "passage-opened")
    release(joint)
    asked = opened.groupBy("key").agg(F.max(F.when(F.col("open"), F.col("id"))).alias("last"), F.count(F.lit(1)).alias("g")).filter(F.col("last").isNotNull())
    listed = materialize(opened.join(asked, "key").filter(F.col("id") <= F.col("last")).drop("last"), "passage-listed")
    release(opened)
    settle(spark)
    shingles = shingles.unionByName(texts_of(listed.select("id").join(bounded_broadcast(shingles.select("id")), "id", "left_anti")))
    members = listed.filter(F.col("g") <= LONG).drop("g")
    members = members.unionByName(_filed_anew(listed.filter(F.col("g") > LONG).drop("g"), shingles, width, percent))
    out = functools.reduce(DataFrame.union, _retried(members, shingles, width, percent), first)
    best = out.groupBy("b", "b_lo", "b_hi").agg(F.min(F.struct("a", "a_lo", "a_hi", "sim")).alias("m"))
    words = WIDTH
    return best.select(
        F.col("b").alias(id_col), F.col("b_lo").alias("start"), (F.col("b_hi") - F.col("b_lo") + words).alias("n_words"),
        F.col("m.a").alias("first_id"), F.col("m.a_lo").alias("first_start"), (F.col("m.a_hi") - F.col("m.a_lo") + words).alias("first_n_words"), F.col("m.sim").alias("similarity"),
    )


def _filed(ids: list[int], texts: list[np.ndarray], width: int, reach: int) -> pd.DataFrame:
    """(key, id, p) of all nodes of some texts; p holds c, how far the node reaches on both sides (up to ``reach``) and the function."""
    x = np.concatenate([*texts, _GAP])
    gaps = np.concatenate([[0], np.cumsum([len(s) + 1 for s in texts[1::2]])])
    names, parts = np.array(ids, dtype=np.int64), []
    for fn in range(HASHES):
        h = mixed(x ^ _SALT[fn])
        # the trees go by the upper halves, which vectors compare in one step; keys are whole
        order = np.maximum(h.view(np.uint32)[1::2], np.uint32(1))
        order[gaps] = 0
        h[gaps] = 0
        l, c, r = _nodes(order, width)
        # a minimum that stands again a few words on repeats its neighbours too: runs from it have the shingles of runs from the first
        first = (h[l - 1] != h[c]) | (c - l >= NEARBY)
        l, c, r = l[first], c[first], r[first]
        doc = np.searchsorted(gaps, c) - 1
        p = (c - gaps[doc] - 1) << 26 | np.minimum(c - l, reach) << 14 | np.minimum(r - c, reach) << 2 | fn
        parts.append((h[c].view(np.int64), names[doc], p))
    return pd.DataFrame({k: np.concatenate([part[i] for part in parts]) for i, k in enumerate(("key", "id", "p"))})


def _joint(shared: DataFrame, width: int) -> DataFrame:
    """(pair, key, id, p, rich, pivot): the rows of ``shared``, rich where windows of ``ENOUGH`` other functions join theirs, and a row for each such join.

    A node is the minimum of the runs of ``width`` that start in one interval,
    and one function's intervals don't overlap; joining those of two functions
    within a text is a merge, with as many results as intervals at most. A
    joined row has both minima as its key and the first's c as p.
    """

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = b["id"].to_numpy()
            whole = int(np.searchsorted(last, last[-1])) if len(b) else 0
            rest = b.iloc[whole:]
            if whole:
                yield _joined(b.iloc[:whole], width)
        if rest is not None and len(rest):
            yield _joined(rest, width)

    dealt = shared.repartition(input_partitions(shared.sparkSession), "id").sortWithinPartitions("id")
    return dealt.mapInPandas(tidy(joined), "pair boolean, key long, id long, p long, rich boolean, pivot long")


def _joined(b: pd.DataFrame, width: int) -> pd.DataFrame:
    key, doc, p, pivot = (b[k].to_numpy(np.int64) for k in ("key", "id", "p", "pivot"))
    c, left, right, fn = p >> 26, p >> 14 & _REACH, p >> 2 & _REACH, p & 3
    # texts side by side on one axis
    at = (np.cumsum(np.diff(doc, prepend=doc[:1]) != 0) + 1) * (int(c.max()) + 4 * width)
    lo, hi = at + np.maximum(c - left, c - width + 1), at + np.minimum(c, c + right - width + 1)
    others = np.zeros(len(b), dtype=np.uint8)
    order = [x[np.argsort(lo[x], kind="stable")] for x in (np.flatnonzero(fn == k) for k in range(HASHES))]
    parts = []
    for f in range(HASHES):
        for g in range(f + 1, HASHES):
            x, y = order[f], order[g]
            if not len(x) or not len(y):
                continue
            start, stop = np.searchsorted(np.maximum.accumulate(hi[y]), lo[x]), np.searchsorted(lo[y], hi[x], "right")
            many = np.maximum(stop - start, 0)
            xs = np.repeat(x, many)
            ys = y[np.arange(len(xs)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)]
            meet = (doc[xs] == doc[ys]) & (hi[ys] >= lo[xs])
            xs, ys = xs[meet], ys[meet]
            others[xs] |= np.uint8(1 << g)
            others[ys] |= np.uint8(1 << f)
            both = mixed(key[xs].view(np.uint64) + mixed(key[ys].view(np.uint64))).view(np.int64)
            parts.append((both, doc[xs], c[xs]))
    rich = np.bitwise_count(others) >= ENOUGH
    n = sum(len(x[0]) for x in parts)
    none = np.zeros(0, np.int64)
    many = [np.concatenate([part[i] for part in parts]) if parts else none for i in range(3)]
    return pd.DataFrame({
        "pair": np.concatenate([np.zeros(len(b), dtype=bool), np.ones(n, dtype=bool)]), "key": np.concatenate([key, many[0]]), "id": np.concatenate([doc, many[1]]),
        "p": np.concatenate([p, many[2]]), "rich": np.concatenate([rich, np.ones(n, dtype=bool)]), "pivot": np.concatenate([pivot, np.zeros(n, np.int64)]),
    })
