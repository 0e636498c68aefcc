"""Periodic runs of words (operator 11), by maximal pairs on a tree of LCP intervals.

A run is a stretch of words with smallest period q, at least ``min_exponent`` periods and ``min_length`` words long, that no
neighbour extends. It holds two copies of its words but the last q, q words apart, that differ in the words on both sides:
a maximal pair of common length run - q. Maximal pairs of one text are found where two places meet in its tree of LCP
intervals, which is walked from the bottom up; each interval keeps its places by the word to their left, as only pairs
of different left words are maximal. A pair counts if its distance is at most its common length / (min_exponent - 1) and
both together make min_length. Such pairs are the runs: nothing is extended. A run's multiples of its period give
pairs of the same stretch; the least distance is its period.

Work stays near linear on any text: the smaller of two joined intervals looks its places up in the larger, and places within half
the common length of each other form an arithmetic progression (their strings overlap by half), in which only the first one can
have another left word than the rest. So one look on each side tells which class to read. The suffixes of many documents
are sorted together by doubling; places whose first words (the largest power of two within the least common length) do not
come again in their text are in no run and are left out, as are parts of the tree whose places are too far apart.

Each document is worked on by itself, so nothing is shuffled. A task holds some CHUNK words and its longest document, at 100
bytes a word or so where it repeats itself.

Cases: null, empty and blank texts have no words and no runs. Rows that share an id, and rows without one, are
each scanned by themselves. Extra columns are not read. Ties: runs come by start, then period.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

MIN_LENGTH, MIN_EXPONENT = 24, 3
#: Words scanned at a time, and rows of a result at a time.
CHUNK, ROWS = 1 << 18, 512
ODD = 0x9E3779B97F4A7C15
RUN = "struct<start: long, length: long, period: long>"


class Interval:
    """The places of an LCP interval: all in order, and in order for each left word."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int):
        self.places, self.classes = [place], {left: [place]}

    def take(self, place: int, left: int) -> None:
        insort(self.places, place)
        if left in self.classes:
            insort(self.classes[left], place)
        else:
            self.classes[left] = [place]


class Pairs:
    """Runs from the maximal pairs of one text or several; ``found`` maps (start, end) to the least distance."""

    def __init__(self, lefts: np.ndarray, min_length: int, min_exponent: int):
        self.left, self.least, self.times = lefts, min_length, min_exponent - 1
        self.found: dict[tuple[int, int], int] = {}

    def pair(self, a: int, b: int, common: int) -> None:
        gap = b - a
        if gap + common >= self.least and gap < self.found.get((a, b + common), gap + 1):
            self.found[a, b + common] = gap

    def join(self, one: Interval, other: Interval, common: int) -> Interval:
        """Both intervals as one, and the maximal pairs between them, whose common length is that of the interval that holds both."""
        large, small = (one, other) if len(one.places) >= len(other.places) else (other, one)
        reach, places, left = common // self.times, large.places, self.left
        for left_word, own in small.classes.items():
            for x in own:
                i = bisect_left(places, x)
                if i < len(places) and places[i] - x <= reach and (c := left[places[i]]) != left_word:
                    behind = large.classes[c]
                    for k in range(bisect_right(behind, x), len(behind)):
                        if behind[k] - x > reach:
                            break
                        self.pair(x, behind[k], common)
                if i and x - places[i - 1] <= reach and left[y := places[bisect_left(places, x - reach)]] != left_word:
                    self.pair(y, x, common)
        for left_word, own in small.classes.items():
            for x in own:
                large.take(x, left_word)
        return large

    def walk(self, places: list[int], lcps: list[int]) -> None:
        """A tree's places in the order of their suffixes, with the common length of each and the next (0 behind the last)."""
        stack: list[list] = []
        node = Interval(places[0], self.left[places[0]])
        for k, common in enumerate(lcps):
            while stack and stack[-1][0] > common:
                held, other = stack.pop()
                node = self.join(other, node, held)
            if stack and stack[-1][0] == common:
                stack[-1][1] = self.join(stack[-1][1], node, common)
            else:
                stack.append([common, node])
            if k + 1 < len(places):
                node = Interval(places[k + 1], self.left[places[k + 1]])


def _starts(changed: np.ndarray) -> np.ndarray:
    """For each element the last one at or ahead of it where something changes."""
    return np.maximum.accumulate(np.where(changed, np.arange(len(changed)), 0))


def _changes(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], values[1:] != values[:-1]))


def suffix_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until they differ; the rank behind the end is -1."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = _changes(symbols[order])
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = _starts(new)
    levels, active, k = [rank], order[~(new & np.append(new[1:], True))], 1
    while len(active):
        key = rank[active] * (n + 2) + rank[np.minimum(active + k, n)] + 1
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        bucket, new = rank[active], _changes(key)
        rank = rank.copy()
        rank[active] = bucket + _starts(new) - _starts(_changes(bucket))
        levels.append(rank)
        active, k = active[~(new & np.append(new[1:], True))], 2 * k
    return levels


def common_lengths(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first symbols the suffixes at a and b share."""
    n, out = len(levels[0]) - 1, np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        same = levels[k][np.minimum(a + out, n)] == levels[k][np.minimum(b + out, n)]
        out[same] += 1 << k
    return out


def _repeating(words: list[bytes], sizes: np.ndarray, window: int) -> np.ndarray:
    """For each text, whether a window of its words may come again in it (hashes: never a false no)."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    k, odd = 1, ODD
    while k < window:
        h[:-k] = h[:-k] * np.uint64(odd) + h[k:]
        k, odd = 2 * k, odd * odd & (1 << 64) - 1
    whole = np.arange(len(words)) + window <= np.repeat(np.cumsum(sizes), sizes)
    h = (h + text.astype(np.uint64) * np.uint64(ODD ^ 0x5555))[whole]
    order = np.argsort(h)
    again = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(sizes), bool)
    out[text[whole][order[1:][again]]] = True
    return out


def runs_of(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, given as its words."""
    if min_exponent < 3 or min_length < 1:
        raise ValueError("runs have three periods or more, and a word")
    shortest = max(-(-min_length * (min_exponent - 1) // min_exponent), min_exponent - 1)
    level = shortest.bit_length() - 1
    sizes = np.array([len(t) for t in texts], np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return found
    some = np.flatnonzero(_repeating([w for t in texts for w in t], sizes, 1 << level))
    if not len(some):
        return found
    # Words get numbers of their text, so what two texts share is not common to them.
    symbols, first = [], 0
    for t in some.tolist():
        known: dict[bytes, int] = {}
        symbols.append(np.fromiter((known.setdefault(w, len(known)) for w in texts[t]), np.int64, len(texts[t])) + first)
        first += len(known)
    begins = np.concatenate(([0], np.cumsum(sizes[some])))
    symbols = np.concatenate(symbols)
    levels = suffix_ranks(symbols)
    if len(levels) <= level:
        return found
    order = np.empty(len(symbols), np.int64)
    order[levels[-1][:-1]] = np.arange(len(symbols))
    shared = levels[level][order[1:]] == levels[level][order[:-1]]
    at = np.flatnonzero(shared)
    lcp = common_lengths(levels, order[at], order[at + 1])
    del levels
    lefts = np.concatenate(([-1], symbols[:-1]))
    lefts[begins[:-1]] = -1
    pairs = Pairs(lefts, min_length, min_exponent)
    tree = np.concatenate(([True], np.diff(at) > 1))
    heads = np.flatnonzero(tree)
    ends = np.append(heads[1:], len(at))
    # Places of a tree in the order of the text: where no two are near enough for its largest common length, it has no run.
    number = np.repeat(np.arange(len(heads)), ends - heads + 1)
    places = order[np.concatenate([np.arange(at[a], at[a] + (b - a) + 1) for a, b in zip(heads.tolist(), ends.tolist())])]
    by_place = np.lexsort((places, number))
    gaps = np.diff(places[by_place])
    gaps[np.diff(number[by_place]) > 0] = len(symbols)
    least = np.minimum.reduceat(np.append(gaps, len(symbols)), np.flatnonzero(_changes(number[by_place])))
    near = least * (min_exponent - 1) <= np.maximum.reduceat(lcp, heads)
    for k in np.flatnonzero(near).tolist():
        a, b = heads[k], ends[k]
        pairs.walk(order[at[a] : at[a] + (b - a) + 1].tolist(), [*lcp[a:b].tolist(), 0])
    for (start, end), period in pairs.found.items():
        k = int(np.searchsorted(begins, start, "right")) - 1
        found[some[k]].append((start - int(begins[k]), end - start, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what runs repeat: of each run the first period stays."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def _scan(min_length: int, min_exponent: int):
    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        rows, n = [], 0
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                words = [] if text is None else bytes(text).split()  # at ASCII white space
                rows.append((doc, words))
                n += len(words)
                if n >= CHUNK or len(rows) >= 8 * ROWS:
                    yield rows
                    rows, n = [], 0
        yield rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in chunks(batches):
            found = runs_of([w for _, w in rows], min_length, min_exponent)
            for at in range(0, len(rows), ROWS):
                some = [(doc, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(collapsed(words, runs))) for (doc, words), runs in zip(rows[at : at + ROWS], found[at : at + ROWS])]
                yield pd.DataFrame(some, columns=["doc_id", "n_words", "runs", "collapsed"]).astype({"doc_id": "Int64"})

    return run


def scan_documents(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per row of docs (doc_id, text): n_words, runs (start, length, period; words from 0), and the collapsed text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    out = rows.mapInPandas(_scan(min_length, min_exponent), f"doc_id long, n_words long, runs array<{RUN}>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def periodic_text(doc_id: Column, text: Column) -> Column:
    """One text in ten made periodic from some word on, by a hash of the id; the others as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, words = F.floor(h / 10).cast("long"), words_of(text)

    def varied(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("long")
        # One-element arrays bind a, p and the words once for the lambda below.
        bound = F.transform(F.array(F.struct(w.alias("w"), a.alias("a"), p.alias("p"))), lambda b: F.transform(b["w"], lambda x, i: F.when(i < b["a"], x).otherwise(F.get(b["w"], (b["a"] + F.pmod(i - b["a"], b["p"])).cast("int")))))
        return F.array_join(F.get(bound, F.lit(0)), " ")

    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike(r"[^\x20\x09-\x0D]"), varied(words)).otherwise(text)


def digest(scanned: DataFrame) -> DataFrame:
    """Of each document its number of runs, the run of the greatest exponent, and hashes of all runs and of the collapsed text."""
    # Cross products compare length / period exactly; of equal runs the first stays, and they come by start, then period.
    better = F.aggregate("runs", F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    df = scanned.withColumn("_best", better)
    return df.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
