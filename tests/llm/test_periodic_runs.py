"""Operator 11 against every period tried at every place."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from turnstile.llm import periodic_runs
from turnstile.llm.registry import QUERIES


def plain_runs(w, min_length=24, times=3):
    """All stretches that keep a period, by period; the least one of a stretch counts."""
    best = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(min_length, times * p):
                best.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((a, b - a, p) for (a, b), p in best.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = (None,) * 3
    for s, length, p in runs:
        if best[0] is None or length * best[2] > best[1] * p:
            best = (s, length, p)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001")
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect())) == sorted((plain_row(r.doc_id, r.text) for r in docs), key=lambda r: r[0])


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (1, 3), (10, 4), (5, 5)])
def test_runs_of_random_texts(least, times):
    rnd, seen = random.Random(least * times), 0
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(1, 5)):
            k, text = rnd.choice([1, 2, 2, 3, 50]), []
            while len(text) < rnd.randint(0, 110):
                text += [b"%d" % rnd.randrange(k) for _ in range(rnd.randint(1, 9))] * rnd.choice([1, 1, rnd.randint(2, 9)])
            texts.append(text)
        want = [plain_runs(t, least, times) for t in texts]
        assert periodic_runs.runs_of(texts, least, times) == want
        seen += sum(map(len, want))
    assert seen > 100


def test_two_periods_are_no_run():
    with pytest.raises(ValueError):
        periodic_runs.runs_of([[b"a"] * 50], 24, 2)


def test_long_texts_made_of_repeats():
    rnd = random.Random(3)
    nested = ([b"a"] * 40 + [b"b"]) * 1500
    fib, prior = [b"a", b"b"], [b"a"]
    while len(fib) < 50_000:
        fib, prior = fib + prior, fib
    assert periodic_runs.runs_of([[b"x"] * 100_000]) == [[(0, 100_000, 1)]]
    got = periodic_runs.runs_of([nested, fib, [b"%d" % rnd.randrange(2) for _ in range(30_000)]])
    assert (0, len(nested), 41) in got[0] and len(got[0]) == 1501  # the whole, and each row of the same word


def test_odd_rows(spark):
    same = " ".join(["la"] * 30)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, same), (4, same), (None, same), (None, "a\x1cb c d " * 12), (5, "É é " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Runs", F.lit(7)).withColumn("collapsed", F.lit("x"))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.scan_documents(docs).collect()]
    assert len(got) == len(rows)
    assert got.count((4, 30, [(0, 30, 1)], "la")) == 2 and (None, 30, [(0, 30, 1)], "la") in got
    assert (None, 24, [(0, 24, 2)], "a\x1cb c d") in got and (5, 40, [(0, 40, 2)], "É é") in got
    assert [x[1:] for x in got if x[0] in (1, 2, 3)] == [(0, [], "")] * 3
    assert periodic_runs.digest(periodic_runs.scan_documents(docs.limit(0))).count() == 0


def test_ties_take_the_first_run(spark):
    text = " ".join(["a"] * 24 + ["b"] + ["c"] * 24 + ["d", "e"] * 24)
    row = periodic_runs.digest(periodic_runs.scan_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (3, 0, 24, 1, 24_000)
