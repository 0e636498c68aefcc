"""Operator 13 against its SQL and a plain count."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstile.llm import phrase_stripes
from turnstile.llm.registry import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        held = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in held.items():
            if len(p) == 2 and any(100 * b >= 50 * a for q, b in held.items() if len(q) == 3 and (q[:2] == p or q[1:] == p)):
                continue
            score, k = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_query_equals_its_sql(spark):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{path}/documents.parquet'")
    want = con.sql(ORACLES["op13_phrase_stripes"])
    got = QUERIES["op13_phrase_stripes"](spark, path)
    assert got.columns == want.columns == NAMES
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(want.fetchall()) and len(got) > 300


def some(seed, n=400):
    rnd = random.Random(seed)
    words = ["Aa", "b", "ÄÖ", "c", "dd", "É", "é", "x\x1cy", "z"]
    glue = [" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n", "?!", ";"]
    return [(rnd.choice(["en", "en", "en", None, "und", "de"]), "".join(rnd.choice(words) + rnd.choice(glue) for _ in range(rnd.randint(0, 40)))) for _ in range(n)]


@pytest.mark.parametrize("seed,least,top", [(1, 10, 2000), (2, 25, 2000), (3, 10, 7)])
def test_small_tables(spark, seed, least, top):
    rows = [*some(seed), (None, None), ("en", ""), ("en", " .,\n"), ("fr", "only once")]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("prefix", F.lit("x")).withColumn("N", F.lit(1)).repartition(3)
    assert sorted(map(tuple, phrase_stripes.top_phrases(docs, least, top).collect())) == plain(rows, least, top)
    assert phrase_stripes.top_phrases(docs.limit(0)).count() == 0


def test_parts_and_flushes_lose_nothing(spark, monkeypatch):
    """Small limits: long texts come in parts, and counters are written many times."""
    rows = some(4, 60) + [("en", " ".join(t for _, t in some(5, 60)))]
    for name, value in (("FLUSH", 50), ("PART", 16)):
        monkeypatch.setattr(phrase_stripes, name, value)
    counters = phrase_stripes._Counters((0, 1), None)
    got, calls = Counter(), 0
    for lang, text in rows:
        for words in phrase_stripes.parts_of(None if text is None else text.encode()):
            if counters.add(lang or "und", words):
                calls += 1
                got.update(entries(counters.stripes()))
    got.update(entries(counters.stripes()))
    want = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update({(lang or "und", "", ""): len(w)} if w else {})
            want.update((lang or "und", "", x) for x in w)
            want.update((lang or "und", x, y) for x, y in zip(w, w[1:]))
    assert calls > 20 and +got == want


def entries(batches):
    out = Counter()
    for b in batches:
        for r in b.to_pylist():
            for x, n in zip(r["nexts"], r["counts"]):
                out[r["lang"], r["prefix"].decode(), x.decode()] += n
    return out


def test_places_in_the_bitmap_are_the_same_on_both_sides(spark):
    words = [b"a", "Ünï".encode(), b"", b"x" * 300, b"1234567"]
    df = spark.createDataFrame([(a.decode(), b.decode()) for a in words for b in words], "a string, b string")
    got = [r[0] for r in df.select(phrase_stripes.pair_bit_column(F.col("a"), F.col("b"))).collect()]
    h = phrase_stripes._hashes(words)
    assert got == phrase_stripes.pair_bit(np.repeat(h, len(words)), np.tile(h, len(words))).tolist()


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000_000
    row = spark.createDataFrame([(big, big + 7, big + 11)], "a long, l long, r long").select(phrase_stripes._score("a", "l", "r").alias("s")).first()
    assert row.s == 10**6 * big * big // ((big + 7) * (big + 11))
