"""Packing along a space-filling curve (operator 12).

A document's token counts are hashed into DIMS signed sums, damped by a square root and scaled to length one. A fixed random
projection takes that vector to four numbers, each laid on a grid of 2^12, and the grid point to its number on a Hilbert curve.
Documents are dealt by ranges of that number and sorted in them, so what is alike lies together, and the sorted ids are cut into
sequences of ``size`` wherever one is full. Ranges join without a gap: the ids ahead of each are known before ids are dealt,
as a count of the ids of every range comes first. What is left at the very end goes into sequences of powers of two, so
nothing is padded at all.

Beyond the curve's number a place holds 15 bits of a hash of the id, so any number of copies of one text is dealt over many
ranges. Documents are encoded once, and written with their ids; one shuffle deals them. A task holds batches, never a
range. The driver gets two numbers for each range, so as many as there are shuffle partitions.

Cases: null and empty texts have the end id only. A null id comes ahead of others at its place; rows that share an id are
packed one by one. Equal places go by id, then by a hash of the ids. Extra columns are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .addressable_codes import WordIds
from .common import partitions, stored

#: Length of a sequence; the id behind each document.
SIZE, END = 1024, 0
#: Hashed sums of a vector; numbers that it is projected to, and bits of each; bits of the id's hash in a place.
DIMS, AXES, BITS, SPREAD = 2048, 4, 12, 15
#: Documents encoded at a time.
ROWS = 256


class SpacedIds(WordIds):
    """Ids of parts of a text that begin with a blank ahead of what is no white space; each is encoded once while remembered.

    A byte-level vocabulary that splits by its usual pattern always begins a token there, so a text's ids are its parts' ids in a
    row. New parts are encoded all in one string, by rank where the vocabulary's numbers follow its merges (the first parts of each
    worker are held against the library, which else takes over); where a part ends shows in the bytes of the ids. Parts of another
    form, or with a special token in them, go to the library one by one. Vocabularies with other rules encode whole texts.
    """

    CROWDED = re.compile(r" \s")
    PART = re.compile(r"(?s:.)[^ ]*(?: (?!\S)[^ ]*)*")
    # Fixed value: how such a vocabulary splits a text.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    #: Parts of a worker that are held against the library.
    HELD = 2000

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads that wait for work would spin on others'
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        spec = json.loads(self.tokenizer.to_str())
        splits, kind = spec.get("pre_tokenizer") or {}, spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        # The rules of a vocabulary whose texts may be encoded part by part.
        self.by_words = (
            spec.get("normalizer") is None and (splits.get("type"), splits.get("add_prefix_space"), splits.get("use_regex")) == ("ByteLevel", False, True)
            and kind["type"] == "BPE" and not kind.get("dropout") and not spec.get("truncation") and not spec.get("padding")
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.ranks = self._ranks(kind) if self.by_words else None
        self.forget()

    def _ranks(self, kind: dict):
        """An encoder by rank, and the bytes of each id; none if numbers do not follow merges."""
        # Bytes that print stand for themselves; the others are written as the next characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        made = [kind["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in kind["merges"]]
        if len(kind["vocab"]) != 256 + len(made) or any(a >= b for a, b in zip(made, made[1:])) or not set("".join(kind["vocab"])) <= set(byte):
            return None
        import tiktoken

        ranks = {bytes(byte[c] for c in token): i for token, i in kind["vocab"].items()}
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(t) for t in ranks]
        return tiktoken.Encoding("parts", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={})

    def words(self, text: str) -> list[str]:
        if text[-1:] == " " or self.CROWDED.search(text):
            return self.PART.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def _library(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row, and their number in each part."""
        return self.whole(parts) if parts else (np.empty(0, np.uint32), np.empty(0, np.int64))

    def _joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of parts that begin with a blank, from one string."""
        text = "".join(parts)
        ids = np.array(self.ranks.encode_ordinary(text), np.uint32)
        ends = np.cumsum([len(x.encode()) for x in parts])
        upto = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
        return ids, np.diff(upto, prepend=0)

    def learn(self) -> None:
        new = self.code.new
        fit = np.array([x[0] == " " and not x[1:2].isspace() for x in new]) & (self.ranks is not None)
        if any(t in "".join(new) for t in self.special):
            fit &= np.array([not any(t in x for t in self.special) for x in new])
        plain = [x for x, f in zip(new, fit.tolist()) if f]
        if plain and self.HELD:
            some = plain[: self.HELD]
            if any(a.tolist() != b.tolist() for a, b in zip(self._joined(some), self._library(some))):
                self.ranks, plain = None, []
                fit[:] = False
            self.HELD -= len(some)
        sizes, at = np.zeros(len(new), np.int64), len(self.flat)
        starts = np.zeros(len(new), np.int64)
        for own, (ids, n) in ((fit, self._joined(plain) if plain else self._library([])), (~fit, self._library([x for x, f in zip(new, fit.tolist()) if not f]))):
            sizes[own], starts[own] = n, at + np.cumsum(n) - n
            self.flat.frombytes(ids.astype(np.uint32).tobytes())
            at += len(ids)
        self.sizes.frombytes(sizes.tobytes())
        self.starts.frombytes(starts.tobytes())
        self.held += 2 * sum(map(len, new)) + 200 * len(new)
        self.code.new = []


@lru_cache(maxsize=1)
def spaced_ids(model: str) -> SpacedIds:
    return SpacedIds(model)


@lru_cache(maxsize=1)
def projection() -> np.ndarray:
    return np.random.default_rng(12).standard_normal((DIMS, AXES))


def grid_points(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each document's point: AXES whole numbers of BITS bits."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (mixed >> np.uint64(40)).astype(np.int64) % DIMS
    sign = 1.0 - 2.0 * ((mixed >> np.uint64(63)) & np.uint64(1)).astype(np.float64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    sums = np.bincount(doc * DIMS + bucket, weights=sign, minlength=len(sizes) * DIMS).reshape(len(sizes), DIMS)
    vectors = np.sign(sums) * np.sqrt(np.abs(sums))
    length = np.sqrt(np.abs(sums).sum(1, keepdims=True))
    # Not as a matrix product, whose library would start threads beside the task's.
    z = np.einsum("ij,jk->ik", vectors / np.where(length == 0, 1, length), projection())
    return np.minimum((0.5 + 0.5 * np.tanh(0.8 * z)) * (1 << BITS), (1 << BITS) - 1).astype(np.int64)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Numbers along a Hilbert curve of points (a row each) on a grid of 2^bits a side."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    for k in range(bits - 1, 0, -1):
        low = (1 << k) - 1
        for i in range(n):
            # Where an axis has this bit, the first axis turns over below it; elsewhere both change places below it.
            has = (x[i] >> k & 1).astype(bool)
            swap = np.where(has, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(has, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for k in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] >> k & 1, (1 << k) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for k in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> k & 1)
    return out


def _encode(model: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = spaced_ids(model)
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                some = pdf.iloc[at : at + ROWS]
                ids, sizes = codes([t or "" for t in some["text"]])
                place = hilbert(grid_points(ids, sizes), BITS) << SPREAD | some["spread"].to_numpy(np.int64)
                ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id))
                ends = np.cumsum(sizes + 1) * codes.width
                data = ids.astype(f"<u{codes.width}").tobytes()
                held = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64"), "place": place, "n": sizes + 1, "mark": [zlib.crc32(x) for x in held], "ids": held})

    return run


def encode_documents(docs: DataFrame, model: str, end_id: int = END) -> DataFrame:
    """One row per row of docs: doc_id, place (along the curve), n, mark (a hash of the ids), ids (little-endian, two bytes each or four)."""
    doc_id = F.col("doc_id").cast("long")
    spread = F.shiftrightunsigned(F.xxhash64(doc_id), 64 - SPREAD)
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), spread.alias("spread"))
    return rows.mapInPandas(_encode(model, end_id), "doc_id long, place long, n long, mark long, ids binary")


def ranges(encoded: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each range of the curve, and the ids of each."""
    n = partitions(encoded.sparkSession)
    dealt = encoded.select("place", "n").repartitionByRange(n, "place").groupBy(F.spark_partition_id()).agg(F.min("place").alias("first"), F.sum("n").alias("n"))
    rows = sorted((r["first"], r["n"]) for r in dealt.collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def cuts(total: int, size: int) -> tuple[int, np.ndarray]:
    """The ids in full sequences, and where sequences of powers of two begin behind them (and end)."""
    full = total // size * size
    rest = [1 << k for k in reversed(range((total - full).bit_length())) if (total - full) >> k & 1]
    return full, full + np.concatenate(([0], np.cumsum(rest, dtype=np.int64))).astype(np.int64)


def _pieces(starts: np.ndarray, total: int, size: int, width: int):
    full, tail = cuts(total, size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, part, out = 0, -1, []
        for pdf in batches:
            for doc, k, ids in zip(pdf["doc_id"], pdf["part"], pdf["ids"]):
                if k != part:
                    part, at = k, int(starts[k])
                data = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                n, begun = len(data) // 4, at
                while at < begun + n:
                    if at < full:
                        sequence, first, end = at // size, at // size * size, (at // size + 1) * size
                    else:
                        i = int(np.searchsorted(tail, at, "right")) - 1
                        sequence, first, end = full // size + i, int(tail[i]), int(tail[i + 1])
                    upto = min(end, begun + n)
                    out.append((doc, at - begun, upto - at, n, sequence, at - first, data[4 * (at - begun) : 4 * (upto - begun)]))
                    at = upto
                if len(out) >= 4096:
                    yield _frame(out)
                    out = []
        yield _frame(out)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]).astype({"doc_id": "Int64"})


def pack_documents(docs: DataFrame, model: str, size: int = SIZE, end_id: int = END) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian, four bytes each)."""
    spark = docs.sparkSession
    encoded = stored(encode_documents(docs, model, end_id), "packing-ids")
    first, counts = ranges(encoded)
    starts, total = np.cumsum(counts) - counts, int(counts.sum())

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(first, place.to_numpy(), "right") - 1).astype("int32")

    width = SpacedIds(model).width
    dealt = encoded.withColumn("part", range_of("place")).repartitionById(max(len(first), partitions(spark)), F.col("part"))
    dealt = dealt.sortWithinPartitions("part", "place", "doc_id", "mark").select("doc_id", "part", "ids")
    return dealt.mapInPandas(_pieces(starts, total, size, width), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n, ids: the pieces of each sequence in a row."""
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(held.alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n"), ids.alias("ids"))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", _crc(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _crc(data: Column) -> Column:
    return F.crc32(data)
