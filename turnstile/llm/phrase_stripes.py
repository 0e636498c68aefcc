"""Collocations by stripes (operator 13).

Each prefix of no, one or two words keys a counter of the words that follow it within a piece. A task fills the counters of
some FLUSH words, numbered, and writes each as a stripe: the prefix once, its next words and their counts side by side. Stripes
are dealt by prefix and merged word by word. One structure then gives all there is to know: an entry is the frequency of a
prefix longer by a word, a prefix's total is its entry in the stripe of the prefix without its last word, and the largest
entry of a stripe is what may subsume the prefix.

A phrase of three words that comes least_count times holds two of two words that do. So stripes of two-word prefixes are made in
a second pass, of words in two frequent pairs only. Which pairs are, tasks look up in a bitmap of 2^BITS hashes: of that size
whatever the corpus, 8 MB, and a wrong yes only counts a phrase that is then too rare.

A prefix that many texts share is one entry or few in a task's stripe, and its stripe is cut into slices by a hash of the next
word (SLICES of no prefix, fewer of others), which are dealt and merged apart. The top phrases of a language come from the tops of
parts of its phrases. Arithmetic is by whole decimals of 38 digits.

Cases: null and empty texts have no words; a null language is ``und``. Repeated rows count each. Ties go by count, then by the phrase's
bytes. Words of control characters other than white space count as words. A text of any length is cut into parts of PART words that
overlap by two. An empty table gives no phrases. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, stored

LEAST, TOP = 10, 2000
#: Words counted at a time, and words of a text taken at once; bits of a word's number.
FLUSH, PART, WIDTH = 1 << 21, 1 << 20, 21
#: Slices of a stripe by the words of its prefix; parts of a language whose tops are taken first.
SLICES, TOPS = (4096, 32, 32), 64
BITS = 26
#: Stripes of a result at a time.
ROWS = 1 << 14
BREAKS = b".,;:!?\n\v\f\r"
PLAIN = bytes.maketrans(UPPER.encode() + b"\t" + BREAKS, LOWER.encode() + b" " + b"." * len(BREAKS))
STRIPE = "lang string, prefix binary, slice int, nexts array<binary>, counts array<long>"


class _Numbers(dict):
    """Numbers of words from 1; a break is 0. ``words`` has them by number."""

    def __init__(self) -> None:
        super().__init__({b".": 0})
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words and, for each break, a dot."""
    return (text or b"").translate(PLAIN).replace(b".", b" . ").split()


def parts_of(text: bytes | None) -> Iterator[list[bytes]]:
    """A text's words by PART, each part with the two words behind it."""
    words = words_of(text)
    for at in range(0, len(words), PART):
        yield words[at : at + PART + 2]


def pair_bit(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The place of a pair of words in the bitmap, by the words' hashes; ``pair_bit_column`` is the same in SQL."""
    return (one ^ (two << np.uint64(21) | two >> np.uint64(43))) >> np.uint64(64 - BITS)


def pair_bit_column(one: Column, two: Column) -> Column:
    a, b = F.xxhash64(one), F.xxhash64(two)
    return F.shiftrightunsigned(a.bitwiseXOR(F.shiftleft(b, 21).bitwiseOR(F.shiftrightunsigned(b, 43))), 64 - BITS)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


class _Counters:
    """Counters of the prefixes of ``sizes`` words, over the words held."""

    def __init__(self, sizes: tuple[int, ...], bitmap: np.ndarray | None):
        self.sizes, self.bitmap = sizes, bitmap
        self.clear()

    def clear(self) -> None:
        self.known, self.held, self.n = _Numbers(), {}, 0

    def add(self, lang: str, words: list[bytes]) -> bool:
        """Takes a part of a text; whether the counters are full."""
        x = np.zeros(len(words) + 1, np.int64)
        x[:-1] = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        own = np.ones(len(x), bool)
        own[PART:] = False  # the next part begins there
        self.held.setdefault(lang, []).append((x, own))
        self.n += len(words)
        return self.n >= FLUSH or len(self.known) > 1 << WIDTH - 1

    def stripes(self) -> Iterator[pa.RecordBatch]:
        words = pa.array(self.known.words, pa.binary())
        hashes = _hashes(self.known.words)
        slices = (hashes >> np.uint64(7)).astype(np.int64)
        for lang, parts in self.held.items():
            x, own = (np.concatenate(p) for p in zip(*parts))
            word = x > 0
            if 0 in self.sizes:
                yield from self._rows(lang, words, slices, np.zeros(int((own & word).sum()), np.int64), x[own & word], 0)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([b""]), pa.array([-1], pa.int32()), pa.array([[b""]]), pa.array([[int((own & word).sum())]])], names=["lang", "prefix", "slice", "nexts", "counts"])
            pair = own[:-1] & word[:-1] & word[1:]
            if 1 in self.sizes:
                yield from self._rows(lang, words, slices, x[:-1][pair], x[1:][pair], 1)
            if 2 in self.sizes:
                at = np.flatnonzero(pair[:-1] & word[2:])
                h = hashes[x]
                frequent = [self._frequent(h[at + k], h[at + k + 1]) for k in (0, 1)]
                at = at[frequent[0] & frequent[1]]
                yield from self._rows(lang, words, slices, x[at] << WIDTH | x[at + 1], x[at + 2], 2)
        self.clear()

    def _frequent(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        bit = pair_bit(one, two)
        return (self.bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def _rows(self, lang: str, words: pa.Array, slices: np.ndarray, prefix: np.ndarray, nexts: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
        """Stripes of the prefixes (numbers of WIDTH bits a word), one row for each slice that has words."""
        code, counts = np.unique(prefix << WIDTH | nexts, return_counts=True)
        prefix, nexts = code >> WIDTH, code & (1 << WIDTH) - 1
        slice_ = slices[nexts] % SLICES[size]
        order = np.lexsort((slice_, prefix))
        prefix, nexts, slice_, counts = prefix[order], nexts[order], slice_[order], counts[order]
        firsts = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (slice_[1:] != slice_[:-1])))) if len(prefix) else np.empty(0, np.int64)
        for k in range(0, len(firsts), ROWS):
            some = firsts[k : k + ROWS]
            a, b = some[0], firsts[k + ROWS] if k + ROWS < len(firsts) else len(prefix)
            offsets = pa.array(np.append(some, b) - a, pa.int32())
            if size == 2:
                key = [self.known.words[p >> WIDTH] + b" " + self.known.words[p & (1 << WIDTH) - 1] for p in prefix[some].tolist()]
                key = pa.array(key, pa.binary())
            else:
                key = words.take(pa.array(prefix[some]))
            lists = [pa.ListArray.from_arrays(offsets, v) for v in (words.take(pa.array(nexts[a:b])), pa.array(counts[a:b], pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), key, pa.array(slice_[some], pa.int32()), *lists], names=["lang", "prefix", "slice", "nexts", "counts"])


def _count(sizes: tuple[int, ...], bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = _Counters(sizes, None if bitmap is None else np.frombuffer(bitmap.value, np.uint8))
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for words in parts_of(text):
                    if counters.add(lang, words):
                        yield from counters.stripes()
        yield from counters.stripes()

    return run


def merged(docs: DataFrame, sizes: tuple[int, ...], bitmap=None) -> DataFrame:
    """lang, prefix, next, n: the entries of all stripes of prefixes of so many words, summed."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    stripes = rows.mapInArrow(_count(sizes, bitmap), STRIPE).repartition("lang", "prefix", "slice")
    entries = stripes.select("lang", "prefix", "slice", F.inline(F.arrays_zip("nexts", "counts")))
    # Dealt by prefix and slice already: words are merged where their stripes lie.
    sums = entries.groupBy("lang", "prefix", "slice", F.col("nexts").alias("next")).agg(F.sum("counts").alias("n"))
    return sums.select("lang", F.col("prefix").cast("string").alias("prefix"), F.col("next").cast("string").alias("next"), "n")


def _bitmap(pairs: DataFrame) -> bytes:
    """2^BITS bits, set where a pair (prefix, next) has its place: of one size for any number of pairs."""
    bit = pair_bit_column(F.col("prefix"), F.col("next"))
    rows = pairs.select(bit.alias("b")).groupBy(F.shiftright("b", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("b").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = bytearray(1 << BITS - 3)
    for r in rows.collect():
        out[r["k"] << 12 : (r["k"] << 12) + len(r["bits"])] = r["bits"]
    return bytes(out)


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entries of prefixes of no, one and two words that come least times or more, and all words of each language."""
    spark = docs.sparkSession
    short = stored(merged(docs, (0, 1)).filter((F.col("n") >= least) | (F.col("next") == "")), "phrase-pairs")
    words = short.filter("prefix = '' AND next <> ''").select("lang", F.col("next").alias("w"), "n")
    pairs = short.filter("prefix <> ''")
    bitmap = spark.sparkContext.broadcast(_bitmap(pairs))
    long = stored(merged(docs, (2,), bitmap).filter(F.col("n") >= least), "phrase-triples")
    bitmap.destroy()
    return words, pairs, long, short.filter("next = ''").select("lang", F.col("n").alias("all"))


def _score(a: str, left: str, right: str) -> Column:
    """floor(10^6 a^2 / (left right)) by whole numbers of 38 digits."""
    big = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({big(a)} * {big(a)})) DIV ({big(left)} * {big(right)})")


def candidates(words: DataFrame, pairs: DataFrame, long: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of all phrases of two and three words that no longer one subsumes."""
    w1 = words.select("lang", F.col("w").alias("w1"), F.col("n").alias("l"))
    w2 = words.select("lang", F.col("w").alias("w2"), F.col("n").alias("r"))
    two = pairs.select("lang", F.col("prefix").alias("w1"), F.col("next").alias("w2"), F.col("n").alias("a")).join(w1, ["lang", "w1"]).join(w2, ["lang", "w2"])
    two = stored(two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r"), "phrase-two")
    three = long.select("lang", F.col("prefix").alias("head"), F.concat_ws(" ", F.substring_index("prefix", " ", -1), "next").alias("tail"), F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("n").alias("a"))
    # Cut behind the first word: f(w1) and f(w2 w3); behind the second: f(w1 w2) and f(w3). All of them are frequent.
    head = two.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l2"), F.col("l").alias("l1"))
    tail = two.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    cut = three.join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
    cut = cut.withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    cut = cut.select("lang", "phrase", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), F.least("s1", "s2").alias("score"))
    # The largest entry of a pair's own stripe, and of those that end in it.
    over = three.select("lang", F.col("head").alias("phrase"), "a").unionAll(three.select("lang", F.col("tail").alias("phrase"), "a"))
    over = over.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = two.join(over, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 50 * a")
    return left.select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score")).unionByName(cut)


def top_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, count and bytes."""
    words, pairs, long, total = frequent_phrases(docs, least)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = candidates(words, pairs, long).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(TOPS)))
    # Tops of parts first, so that no task ranks all phrases of a language.
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    rows = rows.join(total.groupBy("lang").agg(F.sum("all").alias("n")), "lang")
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


_PIECES = """SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents) p"""
ORACLE = f"""WITH p AS ({_PIECES}), pos AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM pos, (VALUES (1), (2), (3)) s(k) WHERE i + k - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
j AS MATERIALIZED (SELECT lang, phrase, k, a, 1 AS j, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM c UNION ALL SELECT lang, phrase, k, a, 2, array_to_string(w[1:2], ' '), w[3] FROM c WHERE k = 3),
cuts AS (SELECT j.lang, j.phrase, j.k AS words, j.a, j.j, l.a AS l, r.a AS r, CAST(1000000 * CAST(j.a AS HUGEINT) * j.a // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM j JOIN f l ON l.lang = j.lang AND l.phrase = j.head JOIN f r ON r.lang = j.lang AND r.phrase = j.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, phrase, max(a) AS m FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) x GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE b.words = 3 OR o.m IS NULL OR 100 * o.m < 50 * b.a)
SELECT * FROM (SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score FROM kept k JOIN n ON n.lang = k.lang) t WHERE rank <= {TOP}"""
