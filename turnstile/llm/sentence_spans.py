"""Substring dedup by sliding sentence spans (operator 10).

A text is cut into sentences, and every sentence, whatever its length, behind words that their hashes pick: the word of
the smallest hash in each WINDOW consecutive words. Which words these are depends on those windows alone, so a passage
is cut alike wherever it stands and no piece has more than WINDOW words. The MIN_WORDS words from each piece on and the
MIN_WORDS words up to the end of each piece are a run. Runs are hashed by their words and met across all documents; one
that occurs before, in an earlier document by id or earlier in the same one without overlap, is repeated, and the pieces
that repeated runs cover whole go. So a repeated passage of WINDOW + MIN_WORDS words or more is always found, and all of
it goes but WINDOW words at most at its start and WINDOW - 1 at its end.

Cases: null and empty texts have no sentences and stay as they are; null ids come after all others. Rows that
share an id count as one document: runs shared between them stay, unless another document had them first. Case and
white space do not matter for equality. Extra columns stay in ``clean_documents``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored, unpacked, whole_row

#: Pieces that a run touches and words that it has, at least; a piece ends in every so many words.
MIN_SENTENCES, MIN_WORDS, WINDOW = 2, 20, 12
BLANK = " \t\n\r\f\v"
#: A word with what ends it; marks and blanks without a word.
TOKEN = re.compile(r"[^.!?\s]+(?:[.!?\n]+[ \t\r]*|[ \t\r\f\v]*)|[.!?\n]+[ \t\r]*|[ \t\r\f\v]+", re.ASCII)
#: Rows of a result at a time.
ROWS = 512
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LAST_ID = (1 << 63) - 1
#: Tokens remembered, and their longest.
REMEMBERED, LONGEST = 1 << 17, 64


class _Tokens(dict):
    """The hash of a token's word; the lowest bit tells that a sentence ends, the next one that there is a word."""

    def __missing__(self, token: str) -> int:
        word = token.strip(BLANK).lower()
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & ~3 | bool(word) << 1 | (token.rstrip(" \t\r")[-1:] in (".", "!", "?", "\n"))
        if len(token) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = value
        return value


KNOWN = _Tokens()


def cut(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The text's tokens, where each piece ends among them, the words before each piece and in all, the words' hashes."""
    tokens = TOKEN.findall(text or "")
    value = np.fromiter(map(KNOWN.__getitem__, tokens), np.uint64, len(tokens))
    word = (value & np.uint64(2)) > 0
    last = (value & np.uint64(1)) > 0
    h = value[word] >> np.uint64(2)
    if len(h) >= WINDOW:
        least = np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(1) + np.arange(len(h) - WINDOW + 1)
        last[np.flatnonzero(word)[least]] = True
    last[-1:] = True
    ends = np.flatnonzero(last) + 1
    return tokens, ends, np.concatenate(([0], np.cumsum(word)[ends - 1])), h


def sentences(text: str | None) -> list[str]:
    """Pieces that make up the text, in order."""
    tokens, ends, *_ = cut(text)
    return ["".join(tokens[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def runs(upto: np.ndarray, h: np.ndarray, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and hash of every run, in order."""
    n, at = len(h), np.unique(upto)
    k = np.arange(len(at) - 1)
    end = np.maximum(at[:-1] + min_words, at[np.minimum(k + min_sentences - 1, len(k))] + 1)
    from_ = np.minimum(at[1:] - min_words, at[np.maximum(k + 2 - min_sentences, 0)] - 1)
    pairs = np.unique(np.concatenate(((at[:-1] << 32 | end)[end <= n], (from_ << 32 | at[1:])[from_ >= 0])))
    i, j = pairs >> 32, pairs & 0xFFFFFFFF
    if not len(pairs):
        return i, j, np.empty(0, np.int64)
    power = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, BASE), dtype=np.uint64)))
    # sums[j] - sums[i] is the run's polynomial times BASE**i; the inverse takes that out.
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)))
    inverse = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, INVERSE), dtype=np.uint64)))
    value = (sums[j] - sums[i]) * inverse[i] + (j - i).astype(np.uint64)
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(29)
    return i, j, value.view(np.int64)


def _sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), ROWS):
            yield pdf.iloc[at : at + ROWS]


def _hashes(min_sentences: int, min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _sliced(batches):
            parts = []
            for order, part, text in zip(pdf["_order"].to_numpy(), pdf["_part"].to_numpy(), pdf["text"]):
                _, _, upto, h = cut(text)
                found, n = np.unique(runs(upto, h, min_sentences, min_words)[2], return_counts=True)
                if len(found):
                    parts.append((found, np.full(len(found), order), np.full(len(found), part), n > 1))
            if parts:
                yield pd.DataFrame(dict(zip(("hash", "_order", "_part", "again"), (np.concatenate(c) for c in zip(*parts)))))

    return run


def repeated(upto: np.ndarray, h: np.ndarray, theirs: np.ndarray, own: np.ndarray, min_sentences: int, min_words: int) -> np.ndarray:
    """For every piece, whether it goes: runs of theirs do, those of own from their second place on."""
    i, j, value = runs(upto, h, min_sentences, min_words)
    gone = np.isin(value, theirs)
    kept_to = {}
    for k in np.flatnonzero(np.isin(value, own)).tolist():
        gone[k] |= i[k] >= kept_to.setdefault(value[k], j[k])
    depth = np.zeros(len(h) + 1, np.int64)
    np.add.at(depth, i[gone], 1)
    np.add.at(depth, j[gone], -1)
    left = np.concatenate(([0], np.cumsum(np.cumsum(depth)[:-1] == 0)))
    # A piece without words goes with the words on both sides of it.
    empty = upto[1:] == upto[:-1]
    first, end = np.where(empty, np.maximum(upto[:-1] - 1, 0), upto[:-1]), np.where(empty, np.minimum(upto[1:] + 1, len(h)), upto[1:])
    return (left[first] == left[end]) & (first < end)


def _clean(min_sentences: int, min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _sliced(batches):
            rows = []
            for doc, text, theirs, own in zip(pdf["doc_id"], pdf["text"], pdf["theirs"], pdf["own"]):
                tokens, ends, upto, h = cut(text)
                gone = np.zeros(len(ends), bool)
                if theirs is not None:
                    gone = repeated(upto, h, np.asarray(theirs, np.int64), np.asarray(own, np.int64), min_sentences, min_words)
                out = text if not gone.any() else "".join("".join(tokens[a:b]) for a, b, g in zip([0, *ends[:-1].tolist()], ends.tolist(), gone) if not g)
                rows.append((doc, len(ends), int(gone.sum()), np.flatnonzero(gone).astype(np.int32), out))
            yield pd.DataFrame(rows, columns=["doc_id", "n_sentences", "n_removed", "removed", "clean_text"]).astype({"doc_id": "Int64"})

    return run


def _keys() -> list:
    """A document's order and, as null ids share theirs, a hash of the text that tells such rows apart."""
    doc_id = F.col("doc_id").cast("long")
    return [F.coalesce(doc_id, F.lit(LAST_ID)).alias("_order"), F.when(doc_id.isNull(), F.xxhash64(F.col("text").cast("string"))).otherwise(F.lit(0).cast("long")).alias("_part")]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *_keys())


def covered(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """(_order, _part, theirs, own): hashes of runs that an earlier document has, and of those that come again in the first one.

    Each hash is dealt once with no more than its document; where its runs are, ``repeated`` finds again.
    """
    found = _keyed(docs).mapInPandas(_hashes(min_sentences, min_words), "hash long, _order long, _part long, again boolean")
    hits = found.withColumn("_first", F.min("_order").over(Window.partitionBy("hash"))).filter("again OR _order <> _first")
    mine = F.col("_order") == F.col("_first")
    return hits.groupBy("_order", "_part").agg(F.collect_set(F.when(~mine, F.col("hash"))).alias("theirs"), F.collect_set(F.when(mine, F.col("hash"))).alias("own"))


def clean_table(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_sentences, n_removed, removed (their numbers from 0), clean_text."""
    out = _keyed(docs).join(stored(covered(docs, min_sentences, min_words), "spans-covered"), ["_order", "_part"], "left")
    return out.select("doc_id", "text", "theirs", "own").mapInPandas(_clean(min_sentences, min_words), "doc_id long, n_sentences int, n_removed int, removed array<int>, clean_text string")


def clean_documents(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated sentences taken out of text (and n_chars, where there is one, counted again).

    Rows of which nothing but white space is left go; rows that had no text from the start stay.
    """
    order, part = _keys()
    found = stored(covered(docs, min_sentences, min_words), "spans-covered")
    rows = docs.select(order, part, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), whole_row(docs).alias("row"))
    rows = rows.hint("merge").join(found, ["_order", "_part"], "left")
    whole = rows.filter("theirs IS NULL").select("row")
    clean = _clean(min_sentences, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                pdf = pa.table({c: some.column(c) for c in ("text", "theirs", "own")}).to_pandas().assign(doc_id=0)
                text = pd.concat(clean(iter([pdf])))["clean_text"].tolist()
                left = pa.array([bool((t or "").strip()) for t in text])
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()).filter(left), some.column("row").filter(left)], names=["clean", "row"])

    # A row's other columns go along as they are; its old text does not.
    name = {c.lower(): c for c in docs.columns}
    hit = rows.filter("theirs IS NOT NULL").select("text", "theirs", "own", F.col("row").dropFields(name["text"]).alias("row"))
    cleaned = hit.mapInArrow(run, T.StructType([T.StructField("clean", T.StringType()), hit.schema["row"]]))
    fresh_values = {name["text"]: F.col("clean").cast(docs.schema[name["text"]].dataType)}
    if "n_chars" in name:
        fresh_values[name["n_chars"]] = F.length("clean").cast(docs.schema[name["n_chars"]].dataType)
    cleaned = cleaned.select(*[fresh_values.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
    return unpacked(whole, "row", docs.columns).unionByName(cleaned)
