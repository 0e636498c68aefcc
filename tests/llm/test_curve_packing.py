"""Operator 12: the curve, ids by the library, sequences without gaps, neighbours that are alike."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnstile.llm import curve_packing
from turnstile.llm.registry import QUERIES
from turnstile.llm.vocabulary import byte_model, word_model


@pytest.mark.parametrize("axes,bits", [(2, 1), (2, 4), (3, 3), (4, 2), (4, 3)])
def test_the_curve_meets_every_point_once_and_steps_by_one(axes, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    number = curve_packing.hilbert(points, bits)
    assert sorted(number.tolist()) == list(range(1 << bits * axes))
    assert (np.abs(np.diff(points[np.argsort(number)], axis=0)).sum(1) == 1).all()


def test_parts_give_the_librarys_ids():
    codes, library, rnd = curve_packing.SpacedIds(byte_model()), Tokenizer.from_file(byte_model()), random.Random(2)
    assert codes.by_words and not curve_packing.SpacedIds(word_model()).by_words
    parts = [" ", " ", "  ", "a", "b'll", "'s", "É", "é", "12", "\n", "\t", " ", "　", "\x1c", "\x85", ".", ",", "<|endoftext|>", "<|", "漢", "x", " ab.\nDe", " q%%%", "\nÉa", " Straße,", " naïve..", "ÀÿŁ", "×", " a", "b!", "ſ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    ids, sizes = codes(texts)
    ends = np.cumsum(sizes)
    for text, got in zip(texts, np.split(ids, ends[:-1])):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids, text


def laid_out(rows, size=1024):
    """Sequences as lists of (offset, length), and pieces by document."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])), "a gap"
    lengths = {k: sum(n for _, n in v) for k, v in sequences.items()}
    assert sorted(lengths) == list(range(len(lengths)))
    short = [n for n in lengths.values() if n != size]
    assert all(n < size and n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)
    return lengths


def held_against_library(docs, rows):
    library = Tokenizer.from_file(byte_model())
    want = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in docs}
    seen = defaultdict(list)
    for r in rows:
        seen[r.doc_id].append(r)
    assert set(seen) == set(want)
    for d, pieces in seen.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[d])
            assert r.ids_crc32 == zlib.crc32(want[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[d])
    assert sum(laid_out(rows).values()) == sum(map(len, want.values()))


def test_query_holds_every_id_once(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = QUERIES["op12_curve_packing"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    held_against_library(docs, got.collect())


def test_alike_documents_lie_together_and_partitions_do_not_matter(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows = []
    for topic in range(20):
        own = rnd.sample(words, 60)
        rows += [(topic + 20 * k, " ".join(rnd.choice(own) for _ in range(150))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def order(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            got = curve_packing.pack_documents(docs.repartition(n), byte_model(), 256).filter("start = 0").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        return [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))]

    one = order(3)
    assert one == order(7)
    together = sum(a % 20 == b % 20 for a, b in zip(one, one[1:])) / len(one)
    assert together > 0.3, together  # by chance 0.05


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "same text"), (4, "same text"), (None, "same text"), (None, "other"), (5, "long words " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Place", F.lit(1)).withColumn("ids", F.lit("x"))
    got = curve_packing.digest(curve_packing.pack_documents(docs, byte_model())).collect()
    library = Tokenizer.from_file(byte_model())
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in got) == total == sum(laid_out(got).values())
    assert sorted((r.doc_id, r.doc_tokens) for r in got if r.doc_id in (1, 2)) == [(1, 1), (2, 1)]
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert curve_packing.pack_documents(docs.limit(0), byte_model()).count() == 0


def test_sequences_hold_their_pieces(spark):
    docs = spark.createDataFrame([(i, f"document {i} " * (i % 7 + 1)) for i in range(300)], "doc_id long, text string")
    pieces = curve_packing.pack_documents(docs, byte_model(), 128).cache()
    got = {r.sequence_id: r for r in curve_packing.sequences(pieces).collect()}
    assert set(got) == {r.sequence_id for r in pieces.collect()}
    for r in pieces.collect():
        assert bytes(got[r.sequence_id].ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
        assert len(got[r.sequence_id].ids) == 4 * got[r.sequence_id].n
