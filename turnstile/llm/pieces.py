"""SentencePiece encoding and decoding with byte offsets (operator 6).

A text is normalised by longest prefixes of the model's compiled character map, and every byte of the result keeps the
place in the source it came from. The library's pieces, laid over the normalised bytes, are projected
through that alignment to spans of the original text. Ids are the library's own.

Cases: a null text counts as empty; an empty one has the end id only, if asked for. Texts are encoded whole. Rows
are independent: repeated rows give repeated results. Only doc_id and text are read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of text unless a text has more, that are encoded at a time.
ROWS, BYTES = 256, 4 << 20
MARK = "▁".encode()


class Normalizer:
    """The model's character map and white-space rules, with alignment."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, escape: bool, squeeze: bool):
        self.dummy_prefix, self.escape, self.squeeze = dummy_prefix, escape, squeeze
        self.units: tuple[int, ...] = ()
        if charsmap:
            size = struct.unpack("<I", charsmap[:4])[0]
            self.units = struct.unpack(f"<{size // 4}I", charsmap[4 : 4 + size])
            self.results = charsmap[4 + size :]
            first = [c for c in range(256) if self._child(0, c) is not None]
            self.starts = re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in first) + b"]", re.S) if first else None

    @property
    def plain(self) -> bool:
        """Whether nothing but spaces changes: no map, and no spaces taken out."""
        return not self.units and not self.squeeze

    def _offset(self, unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _child(self, at: int, c: int) -> int | None:
        """at: a unit's place; the place of its child by byte c."""
        to = at ^ self._offset(self.units[at]) ^ c
        return to if to < len(self.units) and self.units[to] & 0x800000FF == c else None

    def longest(self, text: bytes, i: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry of the map that text has at i."""
        at, best = 0, None
        for j in range(i, len(text)):
            at = self._child(at, text[j])
            if at is None:
                break
            if self.units[at] >> 8 & 1:
                value = self.units[at ^ self._offset(self.units[at])] & 0x7FFFFFFF
                best = (j + 1 - i, self.results[value : self.results.index(b"\0", value)])
        return best

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The normalised bytes, and for each the first source byte and the one behind its source."""
        raw = np.frombuffer(text, np.uint8)
        begin = np.arange(len(raw))
        end = begin + 1
        if self.units and self.starts is not None:
            parts, done, i = [], 0, 0
            while (m := self.starts.search(text, i)) is not None:
                i = m.start()
                found = self.longest(text, i)
                if found is None:
                    i += 1
                    continue
                n, new = found
                parts.append((raw[done:i], begin[done:i], end[done:i]))
                parts.append((np.frombuffer(new, np.uint8), np.full(len(new), i), np.full(len(new), i + n)))
                i = done = i + n
            parts.append((raw[done:], begin[done:], end[done:]))
            raw, begin, end = (np.concatenate(x) for x in zip(*parts))
        if self.squeeze and len(raw):
            space = raw == 32
            solid = np.flatnonzero(~space)
            keep = ~space | np.concatenate(([False], ~space[:-1]))
            keep &= np.arange(len(raw)) <= (solid[-1] if len(solid) else -1)
            raw, begin, end = raw[keep], begin[keep], end[keep]
        if self.dummy_prefix and len(raw):
            raw, begin, end = np.concatenate(([np.uint8(32)], raw)), np.concatenate(([0], begin)), np.concatenate(([0], end))
        if self.escape:
            space = raw == 32
            times = np.where(space, len(MARK), 1)
            where = np.cumsum(times) - times
            raw, begin, end = np.repeat(raw, times), np.repeat(begin, times), np.repeat(end, times)
            for k, c in enumerate(MARK):
                raw[where[space] + k] = c
        return raw, begin, end


class Encoder:
    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        spec = proto.normalizer_spec
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.escape_whitespaces, spec.remove_extra_whitespaces)
        self.lengths = np.array([1 if self.sp.is_byte(i) else len(self.sp.id_to_piece(i).encode()) for i in range(self.sp.get_piece_size())])
        self.unknown = self.sp.unk_id()

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte, and the byte behind the last, of every id's part of the text."""
        if not len(ids):
            return ids, ids
        _, begin, end = self.normalize(text.encode())
        lengths = self.lengths[ids]
        if (ids == self.unknown).any():
            lengths = np.array([len(p.encode()) for p in self.sp.encode(text, out_type=str)])
        upto = np.cumsum(lengths)
        if upto[-1] != len(begin):
            raise ValueError(f"pieces cover {upto[-1]} of {len(begin)} normalised bytes")
        return begin[upto - lengths], end[upto - 1]

    def spans_of(self, texts: list[bytes], ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """spans for many texts in a row; ids holds those of all texts, counts how many each has.

        With a plain normaliser every source byte becomes one byte, or a mark, so that places follow from one running sum.
        """
        rule = self.normalize
        if not rule.plain or (ids == self.unknown).any():
            each = [self.spans(t.decode(), i) for t, i in zip(texts, np.split(ids, np.cumsum(counts)[:-1]))]
            return np.concatenate([b for b, _ in each]), np.concatenate([e for _, e in each])
        lead = int(rule.dummy_prefix)
        sizes = np.array([len(t) + lead * (len(t) > 0) for t in texts], np.int64)
        raw = np.frombuffer(b"".join(b" " * lead + t if t else t for t in texts), np.uint8)
        # Normalised bytes up to and with each source byte, the leading space among them.
        made = np.cumsum(np.where(raw == 32, len(MARK) if rule.escape else 1, 1))
        upto = np.cumsum(self.lengths[ids])
        if len(upto) and upto[-1] != made[-1]:
            raise ValueError(f"pieces cover {upto[-1]} of {made[-1]} normalised bytes")
        # Each text's first source byte among all, less the leading space, which stands at place 0 of its text and is empty.
        first = np.repeat(np.cumsum(sizes) - sizes + lead, counts)
        begin = np.searchsorted(made, upto - self.lengths[ids], "right") - first
        end = np.searchsorted(made, upto, "left") + 1 - first
        return np.maximum(begin, 0), np.maximum(end, 0)

    def __call__(self, texts: list[str], end_id: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Ids, first bytes and ends of all texts in a row, how many each text has, and the decoded texts."""
        found = self.sp.encode(texts, num_threads=1)
        counts = np.array([len(f) for f in found], np.int64)
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        data = [t.encode() for t in texts]
        begin, end = self.spans_of(data, ids, counts)
        if end_id:
            for f in found:
                f.append(self.sp.eos_id())
            behind, sizes = np.cumsum(counts), np.array([len(d) for d in data], np.int64)
            ids, begin, end = np.insert(ids, behind, self.sp.eos_id()), np.insert(begin, behind, sizes), np.insert(end, behind, sizes)
            counts = counts + 1
        return ids, begin, end, counts, self.sp.decode(found, num_threads=1)


@lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    return Encoder(model)


SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of up to ROWS rows and about BYTES bytes."""
    at, n = 0, len(sizes)
    upto = np.cumsum(sizes)
    while at < n:
        before = upto[at] - sizes[at]
        to = min(n, at + ROWS, max(at + 1, int(np.searchsorted(upto, before + BYTES, "right"))))
        yield at, to
        at = to


def _encode(model: str, end_id: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            doc, text = batch.column(0), batch.column(1)
            for at, to in _slices(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)):
                ids, begin, end, counts, decoded = enc([t or "" for t in text.slice(at, to - at).to_pylist()], end_id)
                bounds = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (ids, begin, end)]
                yield pa.RecordBatch.from_arrays([doc.slice(at, to - at), *lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "begins", "ends", "decoded"])

    return run


def encode_documents(docs: DataFrame, model: str, end_id: bool = True) -> DataFrame:
    """doc_id, ids, begins and ends (byte spans of the original text), decoded: one row per row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(model, end_id), SCHEMA)


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("covered_bytes"),
        F.xxhash64("begins", "ends").alias("spans_hash"),
    )
