"""Token-id files of directly addressable codes (operator 7).

An id is split into chunks of eight bits. Level 0 holds the low chunks of all ids and a bitmap of those that
continue, level 1 the next chunks of those, and so on. Each bitmap has a rank directory (set bits before every block of
512), so any id is found by one look-up a level, without decoding what lies before it.

A file is a table of segments, ordered by doc_id over its parts; a segment holds whole documents, their ids and lengths,
and one code. Documents end with an end id. The text is dealt by ranges of doc_id, encoded, and written by Spark.

Cases: null and empty texts have the end id only; a null id comes first; rows that share an id are ordered by a hash of
their text. A document longer than a segment has one of its own. Extra columns are not read. Any vocabulary file of the
tokenizers library is taken; where its rules are not those that ids by word rest on, whole texts are encoded.
"""

from __future__ import annotations

import array
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, scratch

#: Ids of a segment; bits of a rank block.
SEGMENT, BLOCK = 1 << 18, 512
#: Bytes that a task's remembered words may take, and those that a word takes besides its own.
MEMORY, EACH = 192 << 20, 160
HEAD = struct.Struct("<4sII")
LEVEL = struct.Struct("<II")


def encode(ids: np.ndarray) -> bytes:
    """The code of ids (unsigned 32-bit)."""
    out, rest, levels = [], ids.astype(np.uint32), 0
    while True:
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little") if more.any() else np.empty(0, np.uint8)
        out += [LEVEL.pack(len(rest), len(bitmap)), (rest & 255).astype(np.uint8).tobytes(), bitmap.tobytes()]
        levels += 1
        if not len(bitmap):
            break
        blocks = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), BLOCK))
        out.append((np.cumsum(blocks, dtype=np.uint32) - blocks).astype("<u4").tobytes())
        rest = rest[more] >> 8
    return b"".join([HEAD.pack(b"DAC1", levels, len(ids)), *out])


class Codes:
    """Random and whole access to a code."""

    def __init__(self, data: bytes):
        magic, levels, self.n = HEAD.unpack_from(data)
        if magic != b"DAC1":
            raise ValueError("not a code")
        at, self.levels = HEAD.size, []
        for _ in range(levels):
            n, size = LEVEL.unpack_from(data, at)
            at += LEVEL.size
            chunk = np.frombuffer(data, np.uint8, n, at)
            bitmap = np.frombuffer(data, np.uint8, size, at + n)
            at += n + size
            blocks = -(-n // BLOCK) if size else 0
            self.levels.append((chunk, bitmap, np.frombuffer(data, "<u4", blocks, at)))
            at += 4 * blocks

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunk, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * k)
            if not len(bitmap) or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            first = i // BLOCK * BLOCK
            bits = np.unpackbits(bitmap[first >> 3 : (i >> 3) + 1], bitorder="little")
            i = int(ranks[i // BLOCK]) + int(bits[: i - first].sum())
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(self.n, np.uint32)
        where = np.arange(self.n)
        for k, (chunk, bitmap, _) in enumerate(self.levels):
            out[where] |= chunk.astype(np.uint32) << np.uint32(8 * k)
            if len(bitmap):
                where = where[np.unpackbits(bitmap, count=len(chunk), bitorder="little").astype(bool)]
        return out


class Numbers(dict):
    """Numbers for words, given out as words are asked for; ``new`` has those not yet encoded."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


# The rules of a vocabulary whose texts may be encoded word by word.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(spec: dict) -> bool:
    """Whether a vocabulary always splits at white space, and between a letter and what is none, and lowers A-Z."""
    split, letters = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}])[:2]
    model = spec["model"]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": SPLIT}, "Removed", True)
        and (letters.get("type"), letters.get("add_prefix_space"), letters.get("use_regex")) == ("ByteLevel", False, False)
        and model["type"] == "BPE" and not model.get("dropout") and not spec.get("truncation") and not spec.get("padding")
        and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    )


class WordIds:
    """Ids of white-space separated words; each word is encoded once while it is remembered.

    The vocabulary's pre-tokeniser always splits at white space, and between a letter and what is none, so a text's ids are
    its words' ids in a row, with a last comma or full stop behind a letter as a word of its own. It also lowers A-Z, which
    is done before, except in texts that might hold a special token. A word of plain lower-case letters is one piece that
    its rules leave as it is: it goes to the model at once. Vocabularies with other rules encode whole texts.
    """

    TAIL = re.compile(rb"(?<=[a-z])(?=[.,](?:[\x09-\x0d ]|\Z))")
    PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")

    def words(self, text: str) -> list[bytes]:
        data = text.encode()
        if b"<|" not in data:
            data = self.TAIL.sub(b" ", data.lower())
        return data.split()

    def __init__(self, model: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(model)
        self.model = self.tokenizer.model
        self.by_words = by_words(json.loads(self.tokenizer.to_str()))
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.forget()

    def forget(self) -> None:
        self.code, self.held = Numbers(), 0
        self.flat, self.starts, self.sizes = array.array("I"), array.array("q"), array.array("q")

    def learn(self) -> None:
        """Encodes the words that are new."""
        new = [w.decode() for w in self.code.new]
        plain = [self.PLAIN.fullmatch(w) is not None for w in new]
        rest = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(new, plain) if not p], add_special_tokens=False))
        for w, p in zip(new, plain):
            ids = [t.id for t in self.model.tokenize(w if w.isascii() else w.translate(self.letters))] if p else next(rest).ids
            self.starts.append(len(self.flat))
            self.sizes.append(len(ids))
            self.flat.extend(ids)
        self.held += sum(map(len, self.code.new)) + EACH * len(new)
        self.code.new = []

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(f) for f in found], np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and their number in each text."""
        if not self.by_words:
            return self.whole(texts)
        if self.held > MEMORY:
            self.forget()
        words = [self.words(t) for t in texts]
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(words)), np.int64)
        if self.code.new:
            self.learn()
        if not len(codes):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        # Views of the arrays; they end with this call, before the arrays grow again.
        sizes = np.frombuffer(self.sizes, np.int64)[codes]
        upto = np.cumsum(sizes)
        ids = np.frombuffer(self.flat, np.uint32)[np.repeat(np.frombuffer(self.starts, np.int64)[codes] - upto + sizes, sizes) + np.arange(upto[-1])]
        ends = np.cumsum([len(ws) for ws in words])
        return ids.astype(np.uint32), np.diff(np.concatenate(([0], upto))[ends], prepend=0)


@lru_cache(maxsize=1)
def word_ids(model: str) -> WordIds:
    return WordIds(model)


SEGMENTS = "part int, seq int, first long, n_ids long, doc_ids binary, missing binary, lengths binary, code binary"


def _segments(model: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        docs: list[np.ndarray] = []
        none: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        n = 0

        def row() -> pd.DataFrame:
            ids, lengths = np.concatenate(held), np.concatenate(sizes)
            return pd.DataFrame({"part": [part], "seq": [seq], "first": [first], "n_ids": [len(ids)], "doc_ids": [np.concatenate(docs).astype("<i8").tobytes()], "missing": [np.packbits(np.concatenate(none)).tobytes()], "lengths": [lengths.astype("<u4").tobytes()], "code": [encode(ids)]})

        for pdf in batches:
            for at in range(0, len(pdf), 256):
                some = pdf.iloc[at : at + 256]
                ids, lengths = word_ids(model)([t or "" for t in some["text"]])
                ids = np.insert(ids, np.cumsum(lengths), np.uint32(end_id))
                lengths = lengths + 1
                if n and n + len(ids) > SEGMENT:
                    yield row()
                    seq, first, n = seq + 1, first + n, 0
                    docs, none, sizes, held = [], [], [], []
                docs.append(some["doc_id"].fillna(0).to_numpy(dtype=np.int64))
                none.append(some["doc_id"].isna().to_numpy())
                sizes.append(lengths)
                held.append(ids)
                n += len(ids)
        if held:
            yield row()

    return run


def write_codes(docs: DataFrame, path: str, model: str, end_id: int = 1) -> None:
    """Encodes the texts and writes the files to path, in ascending order of doc_id."""
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInPandas(_segments(model, end_id), SEGMENTS).write.option("compression", "zstd").parquet(path)


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples():
            ids = Codes(r.code).all().astype("<u4")
            lengths = np.frombuffer(r.lengths, "<u4").astype(np.int64)
            ends = np.cumsum(lengths)
            data = ids.tobytes()
            doc_ids = pd.array(np.frombuffer(r.doc_ids, "<i8"), dtype="Int64")
            doc_ids[np.unpackbits(np.frombuffer(r.missing, np.uint8), count=len(lengths)).astype(bool)] = pd.NA
            yield pd.DataFrame({"doc_id": doc_ids, "start": r.start + ends - lengths, "n_tokens": lengths, "ids_crc32": [zlib.crc32(data[4 * (e - n) : 4 * e]) for n, e in zip(lengths, ends)]})


def with_start(segments: DataFrame) -> DataFrame:
    """Segments with ``start``, the number of ids before them in all files: a running sum over the parts, one row each."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    return segments.join(before, "part").withColumn("start", F.col("_before") + F.col("first")).drop("_before")


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    segments = with_start(spark.read.parquet(path))
    return segments.select("start", "doc_ids", "missing", "lengths", "code").mapInPandas(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, path: str, position: int) -> int | None:
    """The id at a place counted over all files, from one segment and without decoding a block."""
    found = with_start(spark.read.parquet(path)).filter((F.col("start") <= position) & (F.col("start") + F.col("n_ids") > position)).select("start", "code").first()
    return None if found is None else Codes(bytes(found["code"]))[position - found["start"]]


def round_trip(docs: DataFrame, model: str, end_id: int = 1) -> DataFrame:
    """Writes the files into the shared folder and reads them back."""
    spark = docs.sparkSession
    path = f"{scratch(spark)}/codes-{uuid.uuid4().hex}"
    write_codes(docs, path, model, end_id)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return read_codes(spark, path)
