"""LM scoring with a Katz backoff model (operator 1).

A bigram model: P(w | v) is the Good-Turing discounted relative count where the pair was seen in training, and
otherwise the context's backoff weight times P(w), which in turn is discounted and leaves its mass to unknown words
(one type). Weights are set so that every context sums to exactly 1. The recursion is evaluated for each token; a document's
score is the sum of log10 probabilities of its words, each given the one before, and of its end.

How the work is dealt:

1. Blocks of documents are tokenised once and stored as local word numbers with their local vocabulary.
2. Vocabularies meet by word: counts, and a global id by falling count, which goes back to the blocks. As ids
   follow counts, the count of any id is a step function with at most sqrt(2 N) steps for N tokens; only that,
   with its counts of counts, goes to the driver and the tasks.
3. Blocks send (context, word, document, times) by a hash of the context, sorted and packed. A hot context, one with more
   than a quarter of a partition's share of tokens, is dealt by context and word; there are at most four hot ones a partition.
4. Partitions merge what they get into a stored table of bigrams, training counts and postings. Counts of counts
   give the discounts. Backoff weights are worked out inside a partition, and for hot contexts from partial sums.
5. Partitions score their postings and send sums by block; blocks add them up in the order of partitions.

Cases: a null or empty text is its end only. A null id counts as the text "null" for the split. Documents may repeat; rows
are scored one by one. Without training tokens every score is 0 apart from the unknown type, which has all mass.
Where counts are too few or uneven for Good-Turing (a discount outside (0, 1]), absolute discounting by
n1 / (n1 + 2 n2) is used for that order. A context without discounted mass keeps one pseudo-count for unseen words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stored

#: Counts up to CUT are discounted; a block has up to BLOCK tokens (or one document).
CUT, BLOCK, HOT_SHARE = 5, 1 << 22, 4
FOLDS, HELD = 7, 2
#: Two ids below this one fit a single signed number; larger ones are compared side by side.
PAIRED = 1 << 31
#: The word that ends a text; no word has white space.
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays of up to 64 bits, by byte planes, compressed; an array has four planes, or eight where a value needs them."""
    widths = [8 if len(a) and int(a.max()) >> 32 else 4 for a in arrays]
    sizes = np.array([len(arrays), *map(len, arrays), *widths], np.uint32)
    planes = [np.ascontiguousarray(a.astype(f"<u{k}")).view(np.uint8).reshape(-1, k).T.tobytes() for a, k in zip(arrays, widths)]
    return zstandard.ZstdCompressor(level=3).compress(sizes.tobytes() + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), np.uint8)
    k = int(raw[:4].view("<u4")[0])
    sizes, at, out = raw[4 : 4 + 8 * k].view("<u4").tolist(), 4 + 8 * k, []
    for n, width in zip(sizes[:k], sizes[k:]):
        out.append(np.ascontiguousarray(raw[at : at + width * n].reshape(width, n).T).view(f"<u{width}").reshape(n))
        at += width * n
    return out


BLOCKS = "block long, ids binary, missing binary, held binary, words array<long>, trained array<long>, tokens binary"


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents to blocks; ``tokens`` packs lengths and local word numbers (by falling count)."""
    number = TaskContext.get().partitionId() << 32
    rows: list[tuple] = []
    hashes: list[np.ndarray] = []
    total = 0

    def block() -> pd.DataFrame:
        lengths = np.array([len(h) for h in hashes])
        flat = np.concatenate(hashes)
        held = np.array([r[1] for r in rows])
        words, local, n = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        trained = np.bincount(local[np.repeat(~held, lengths)], minlength=len(words))
        ids = np.array([-1 if r[0] is pd.NA else r[0] for r in rows], "<i8")
        missing = np.array([r[0] is pd.NA for r in rows])
        return pd.DataFrame({"block": [number], "ids": [ids.tobytes()], "missing": [missing.tobytes()], "held": [held.tobytes()], "words": [words[order].view(np.int64)], "trained": [trained[order]], "tokens": [pack(lengths, rank[local])]})

    digest = xxhash.xxh3_64_intdigest
    for pdf in batches:
        for doc, text, held in zip(pdf["doc_id"].astype("Int64").array, pdf["text"], pdf["held"]):
            words = (text or "").encode().lower().split()
            h = np.empty(len(words) + 1, np.uint64)
            h[:-1] = np.fromiter(map(digest, words), np.uint64, len(words))
            h[-1] = END
            rows.append((doc, bool(held)))
            hashes.append(h)
            total += len(h)
            if total >= BLOCK:
                yield block()
                number, rows, hashes, total = number + 1, [], [], 0
    if rows:
        yield block()


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, at = TaskContext.get().partitionId(), 0
    for pdf in batches:
        yield pdf.assign(part=np.int32(part), at=np.arange(at, at + len(pdf)))
        at += len(pdf)


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """Katz's discounts for counts 0 to CUT + 1 and more (the last entry); entry 0 is not used."""
    n = [0.0] + [float(counts_of_counts.get(r, 0)) for r in range(1, CUT + 2)]
    out = np.ones(CUT + 2)
    if n[1]:
        a = (CUT + 1) * n[CUT + 1] / n[1]
        if all(n[r] for r in range(1, CUT + 1)) and a < 1:
            out[1 : CUT + 1] = [((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) for r in range(1, CUT + 1)]
        if not ((out[1:] > 0) & (out[1:] <= 1)).all() or (out == 1).all():
            d = n[1] / (n[1] + 2 * n[2])
            d = min(d, 0.95)
            out[1 : CUT + 1] = [(r - d) / r for r in range(1, CUT + 1)]
    return out


class Unigrams:
    """Counts and probabilities by id (from 1; 0 is the start), from the steps of the falling counts."""

    def __init__(self, counts: np.ndarray, types: np.ndarray):
        order = np.argsort(-counts)
        self.counts, types = counts[order].astype(np.int64), types[order]
        self.first = 1 + np.concatenate(([0], np.cumsum(types)[:-1])).astype(np.int64) if len(types) else np.empty(0, np.int64)
        seen = self.counts > 0
        self.n, self.v = int((self.counts * types).sum()), int(types[seen].sum())
        d = discounts({int(c): int(t) for c, t in zip(self.counts, types)})
        mass = d[np.minimum(self.counts, CUT + 1)] * self.counts
        left = self.n - float((mass * types)[seen].sum())
        total = float(self.n)
        if left <= 1e-9 * total or not total:
            total, left = total + 1, 1.0
        self.p = np.where(seen, mass, left) / total
        self.ends = 0

    def step(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, ids, "right") - 1

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Training count; of the start, the number of training documents."""
        return np.where(ids == 0, self.ends, self.counts[np.maximum(self.step(ids), 0)])

    def hot(self, parts: int) -> int:
        """Ids below this one are hot contexts."""
        return int(self.first[(self.counts > self.n / (HOT_SHARE * parts)).sum()]) if (self.counts <= self.n / (HOT_SHARE * parts)).any() else int(1e18)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


PAIRS = "part int, block long, docs binary, n_ids int, pairs binary"


def _pairs(uni: Unigrams, parts: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        lengths, local = unpack(row["tokens"])
        lengths = lengths.astype(np.int64)
        ids = np.empty(len(right), np.int64)
        ids[right["at"].to_numpy()] = right["id"].to_numpy()
        w = ids[local]
        n = len(lengths)
        ends = np.cumsum(lengths)
        v = np.concatenate(([0], w[:-1]))
        v[np.concatenate(([0], ends[:-1]))] = 0
        held = np.frombuffer(row["held"], bool)
        count = uni.count(w)
        docs = pd.DataFrame({"n_tokens": lengths, "n_known": np.add.reduceat((count > 0).astype(np.int64), ends - lengths), "base": np.add.reduceat(np.log10((count + 1) / (uni.n + uni.v + 1)), ends - lengths)})
        packed = b"".join([docs["n_tokens"].to_numpy("<i8").tobytes(), docs["n_known"].to_numpy("<i8").tobytes(), docs["base"].to_numpy("<f8").tobytes(), row["ids"], row["missing"], row["held"]])
        doc = np.repeat(np.arange(n), lengths)
        bits_w, bits_d = int(w.max()).bit_length(), max(1, int(n - 1).bit_length())
        if 2 * bits_w + bits_d <= 63:
            key = np.sort((v << (bits_w + bits_d)) | (w << bits_d) | doc)
            first = np.flatnonzero(np.diff(key, prepend=-1))
            key = key[first]
            v, w, doc = key >> (bits_w + bits_d), (key >> bits_d) & ((1 << bits_w) - 1), key & ((1 << bits_d) - 1)
        else:
            order = np.lexsort((doc, w, v))
            v, w, doc = v[order], w[order], doc[order]
            first = np.flatnonzero((np.diff(v, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
            v, w, doc = v[first], w[first], doc[first]
        times = np.diff(np.append(first, len(count)))
        hot = v < uni.hot(parts)
        part = (_spread(v.astype(np.uint64) + np.where(hot, (w.astype(np.uint64) + np.uint64(1)) << np.uint64(32), np.uint64(0))) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        mark = doc * 2 + held[doc]
        out = [(int(row["mine"]) % parts, row["mine"], packed, n, None)]
        for p in range(parts):
            at = order[cuts[p] : cuts[p + 1]]
            if len(at):
                out.append((p, row["mine"], None, 0, pack(np.diff(v[at], prepend=0), w[at], mark[at], times[at])))
        return pd.DataFrame(out, columns=["part", "block", "docs", "n_ids", "pairs"])

    return run


MERGED = f"part int, blocks array<long>, bigrams binary, postings binary, docs array<binary>, docs_block array<long>, docs_n array<int>, {', '.join(f'n{r} long' for r in range(1, CUT + 2))}"


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block", kind="stable")
    rows = pdf[pdf["pairs"].notna()]
    docs = pdf[pdf["docs"].notna()]
    parts = [unpack(x) for x in rows["pairs"]]
    empty = np.empty(0, np.int64)
    v = np.concatenate([np.cumsum(p[0].astype(np.int64)) for p in parts]) if parts else empty
    w = np.concatenate([p[1] for p in parts]).astype(np.int64) if parts else empty
    mark = np.concatenate([p[2] for p in parts]) if parts else empty
    times = np.concatenate([p[3] for p in parts]) if parts else empty
    block = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]) if parts else empty
    narrow = not len(v) or max(int(v.max()), int(w.max())) < PAIRED
    order = np.argsort((v << 32) | w, kind="stable") if narrow else np.lexsort((w, v))
    v, w, mark, times, block = v[order], w[order], mark[order], times[order], block[order]
    first = np.flatnonzero((np.diff(v, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0))
    count = np.add.reduceat(np.where(mark & 1, 0, times), first) if len(first) else empty
    of = [int((count == r).sum()) for r in range(1, CUT + 2)]
    bigrams = pack(np.diff(v[first], prepend=0), w[first], count, np.diff(np.append(first, len(v))))
    return pd.DataFrame([(pdf["part"].iloc[0], rows["block"].to_numpy(), bigrams, pack(block, mark, times), list(docs["docs"]), docs["block"].to_numpy(), docs["n_ids"].to_numpy(), *of)], columns=["part", "blocks", "bigrams", "postings", "docs", "docs_block", "docs_n", *[f"n{r}" for r in range(1, CUT + 2)]])


class Katz:
    """Probabilities of one partition's bigrams."""

    def __init__(self, uni: Unigrams, d: np.ndarray, parts: int):
        self.uni, self.d, self.below = uni, d, uni.hot(parts)

    def read(self, data: bytes) -> None:
        v, self.w, count, self.runs = unpack(data)
        self.v, self.w, self.count = np.cumsum(v.astype(np.int64)), self.w.astype(np.int64), count.astype(np.int64)
        self.p1 = self.uni.p[self.uni.step(self.w)] if len(self.w) else np.empty(0)
        self.starts = np.flatnonzero(np.diff(self.v, prepend=-1))
        self.mass = self.d[np.minimum(self.count, CUT + 1)] * self.count
        seen = self.count > 0
        self.context = self.v[self.starts]
        self.sums = [np.add.reduceat(x, self.starts) if len(self.starts) else np.empty(0) for x in (np.where(seen, self.mass, 0.0), np.where(seen, self.p1, 0.0))]

    def log_p(self, hot: dict[int, tuple[float, float]]) -> np.ndarray:
        mass, lower = (s.copy() for s in self.sums)
        for i in np.flatnonzero(self.context < self.below):
            mass[i], lower[i] = hot[int(self.context[i])]
        total = self.uni.count(self.context).astype(np.float64)
        log_alpha, total = weights(total, mass, lower)
        each = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.v))))
        with np.errstate(divide="ignore"):
            return np.where(self.count > 0, np.log10(self.mass) - np.log10(total)[each], log_alpha[each] + np.log10(self.p1))


def weights(total: np.ndarray, mass: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the backoff weights, and the totals that counts are divided by."""
    left = total - mass
    bare = (left <= 1e-9 * total) & (total > 0)
    left, total = np.where(bare, 1.0, left), np.where(bare, total + 1, total)
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.where(total > 0, left / total / np.maximum(1 - lower, 1e-12), 1.0)
    return np.log10(alpha), np.where(total > 0, total, 1.0)


def _hot_sums(katz: Katz):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, data in zip(pdf["part"], pdf["bigrams"]):
                katz.read(data)
                hot = katz.context < katz.below
                yield pd.DataFrame({"part": np.full(hot.sum(), part, np.int32), "v": katz.context[hot], "mass": katz.sums[0][hot], "lower": katz.sums[1][hot]})

    return run


SUMS = "block long, part int, n_docs int, docs binary, which binary, sums binary"


def _sums(katz: Katz, hot: dict[int, tuple[float, float]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                for b, n, docs in zip(row.docs_block, row.docs_n, row.docs):
                    yield pd.DataFrame([(b, -1, n, docs, None, None)], columns=["block", "part", "n_docs", "docs", "which", "sums"])
                katz.read(row.bigrams)
                block, mark, times = unpack(row.postings)
                value = np.repeat(katz.log_p(hot), katz.runs) * times
                doc = mark >> 1
                spot = (block.astype(np.int64) << 32) | doc
                order = np.argsort(spot, kind="stable")
                spot, value = spot[order], value[order]
                first = np.flatnonzero(np.diff(spot, prepend=-1))
                sums = np.add.reduceat(value, first) if len(first) else value
                blocks, docs = spot[first] >> 32, (spot[first] & 0xFFFFFFFF).astype("<u4")
                cuts = np.searchsorted(blocks, np.arange(len(row.blocks) + 1))
                out = [(b, row.part, 0, None, docs[i:j].tobytes(), sums[i:j].astype("<f8").tobytes()) for b, i, j in zip(row.blocks, cuts[:-1], cuts[1:]) if j > i]
                if out:
                    yield pd.DataFrame(out, columns=["block", "part", "n_docs", "docs", "which", "sums"])

    return run


def _scores(train_tokens: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", kind="stable")
        head = pdf.iloc[0]
        n, data = int(head["n_docs"]), head["docs"]
        score = np.zeros(n)
        for which, sums in zip(pdf["which"].iloc[1:], pdf["sums"].iloc[1:]):
            score[np.frombuffer(which, "<u4")] += np.frombuffer(sums, "<f8")
        at = lambda k, kind: np.frombuffer(data, kind, n, 8 * k * n)
        ids = pd.array(at(3, "<i8"), dtype="Int64")
        ids[np.frombuffer(data, bool, n, 32 * n)] = pd.NA
        held = np.frombuffer(data, bool, n, 33 * n)
        return pd.DataFrame({"doc_id": ids, "held_out": held, "n_tokens": at(0, "<i8"), "n_known": at(1, "<i8"), "train_tokens": np.full(n, train_tokens), "base_score": at(2, "<f8"), "score": score})

    return run


def score_documents(docs: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % folds == held).alias("held"))
    blocks = stored(rows.mapInPandas(_blocks, BLOCKS), "katz-blocks")
    local = blocks.select("block", F.posexplode(F.arrays_zip("words", "trained")).alias("at", "_w")).select("block", "at", F.col("_w.words").alias("word"), F.col("_w.trained").alias("n"))
    counts = local.groupBy("word").agg(F.sum("n").alias("c"))
    order = [F.col("c").desc(), F.col("word")]
    dealt = counts.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_numbered, "word long, c long, part int, at long")
    dealt = stored(dealt, "katz-unigrams")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    words = dealt.join(sizes, "part").select("word", (F.col("_before") + F.col("at") + 1).alias("id"))
    steps = dealt.groupBy("c").agg(F.count(F.lit(1)).alias("types")).toPandas()
    uni = Unigrams(steps["c"].to_numpy(dtype=np.int64), steps["types"].to_numpy(dtype=np.int64))
    ends = dealt.filter(F.col("word") == int(END.view(np.int64))).select("c").first()
    uni.ends = int(ends["c"]) if ends else 0
    back = local.select("block", "at", "word").join(words, "word").select("block", "at", "id")
    pairs = blocks.select(F.col("block").alias("mine"), "ids", "missing", "held", "tokens").groupBy("mine").cogroup(back.groupBy("block")).applyInPandas(_pairs(uni, parts), PAIRS)
    merged = stored(pairs.groupBy("part").applyInPandas(_merged, MERGED), "katz-bigrams")
    of = merged.agg(*[F.sum(f"n{r}").alias(f"n{r}") for r in range(1, CUT + 2)]).first()
    katz = Katz(uni, discounts({r: of[f"n{r}"] or 0 for r in range(1, CUT + 2)}), parts)
    # At most HOT_SHARE * parts contexts, and the start; summed in the order of parts, so that reruns agree.
    hot = merged.select("part", "bigrams").mapInPandas(_hot_sums(katz), "part int, v long, mass double, lower double")
    hot = hot.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("part", "mass", "lower"))).alias("s"))
    total = lambda c: F.aggregate("s", F.lit(0.0), lambda a, x: a + x[c])
    sums = {r["v"]: (r["m"], r["l"]) for r in hot.select("v", total("mass").alias("m"), total("lower").alias("l")).collect()}
    scored = merged.select("part", "blocks", "bigrams", "postings", "docs", "docs_block", "docs_n").mapInPandas(_sums(katz, sums), SUMS)
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return scored.groupBy("block").applyInPandas(_scores(uni.n), kinds)
