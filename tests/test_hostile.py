"""Lines made to be slow or to mislead, and patterns as users write them."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from turnstile.functions import addr
from turnstile.operators import extract
from turnstile.plans.catalogue import TAG, catalogue, expand, host_group, literals, needed, patterns_of, steady
from turnstile.plans.samples import samples

PATTERNS = [(s, p) for s, _, ps in catalogue() for p in ps]
SIZE = 65536


def near_misses(pattern):
    """Lines of 64 KB that have all of a pattern's literals, again and again, and no address at its place."""
    runs = [x for x in re.split(r"[\\.*+?()\[\]{}|^$]+|<HOST>", pattern) if x.strip()]
    every = " ".join(runs)
    first, rest = runs[0], " ".join(runs[1:])
    for line in (every, f"{first} ", f"{every} 1.2.3.4", "(a", "1.2.3.4 "):
        long = (line * (SIZE // len(line) + 1))[: SIZE - 200]
        yield f"{every} {long}"[: SIZE - 150] + rest


@pytest.mark.parametrize("part", range(8))
def test_hostile_lines_end_soon(spark, part):
    slow = []
    for service, pattern in PATTERNS[part::8]:
        df = spark.createDataFrame([(i, x) for i, x in enumerate(near_misses(pattern))], "seq int, line string")
        began = time.time()
        df.select(extract.token(F.col("line"), pattern)).collect()
        if time.time() - began > 30:
            slow.append((service, pattern, round(time.time() - began)))
    assert not slow


def test_steady_patterns_find_what_patterns_find():
    rng = random.Random(11)
    lines = [line.replace("{ip}", "192.0.2.7") for _, line in samples()]
    hits = 0
    for _, pattern in PATTERNS:
        plain, other, group = re.compile(expand(pattern)), re.compile(steady(pattern), re.M), host_group(pattern)
        own = [x for x in lines if plain.search(x)]
        words = [x for x in re.split(r"[\\.*+?()\[\]{}|^$]|<HOST>", pattern) if x] + ["10.0.0.1", "::1", "(a"]
        for _ in range(60):
            line = rng.choice(own).split(" ") if own else [rng.choice(words) for _ in range(8)]
            for _ in range(rng.randint(0, 4)):
                line.insert(rng.randrange(len(line) + 1), rng.choice(words if rng.random() < 0.5 else line))
            text = " ".join(line)
            a, b = plain.search(text), other.search(text)
            assert (a and a.group(group)) == (b and b.group(group)), (pattern, text)
            assert a is None or all(x in text for x in literals(pattern))
            hits += a is not None
    assert hits > 1000


@pytest.mark.parametrize(
    "pattern, line",
    [
        (r"(?P<who>\w+) failed from <HOST>", "bob failed from 10.0.0.9"),
        (r"(?<=user )\w+ failed from <HOST>", "user bob failed from 10.0.0.9"),
        (r"(?<!x)(a|b) [(]c[)] <HOST>", "a (c) 10.0.0.9"),
        (r"colou?r {2}<HOST>", "colour  10.0.0.9"),
        (r"^a|from <HOST>", "b from 10.0.0.9"),
        (r"(?i)FROM <HOST> PORT", "FROM 10.0.0.9 port"),
        (r"a\d+.*5 x.* <HOST> end", "a12345 x y 10.0.0.9 end"),
        (r"from <HOST>\s+-.+- x", "from 10.0.0.9  --- x"),
    ],
)
def test_user_patterns(spark, pattern, line):
    assert pattern.count(TAG) == 1
    df = spark.createDataFrame([(1, line)], "seq int, line string")
    assert [r["ip"] for r in extract.match(df, [("j", [pattern])]).collect()] == ["10.0.0.9"]


def test_a_gate_counts_as_it_is_written_whatever_the_flags(spark):
    lines = [(1, "Login FAILED for x from 10.0.0.1"), (2, "login failed for x FROM 10.0.0.2"), (3, "LOGIN failed for x from 10.0.0.3 from")]
    df = spark.createDataFrame(lines, "seq int, line string")
    roundcube = patterns_of("roundcube-auth")
    assert {r["ip"] for r in extract.match(df, [("j", roundcube)]).collect()} == {"10.0.0.1", "10.0.0.3"}
    every = extract.match(df, [(s, p) for s, _, p in catalogue()])
    assert {r["ip"] for r in every.filter("jail = 'roundcube-auth'").collect()} == {"10.0.0.1", "10.0.0.3"}
    assert extract.match(df, [("j", [r"(?i)FROM <HOST>"])]).first()["ip"] == "10.0.0.2"


def test_the_index_of_words_loses_no_line(spark):
    """All patterns at once, by the index, as each alone: on sample lines, and with their words stuck to others."""
    rnd = random.Random(5)
    lines = []
    for _, line in samples():
        text = line.replace("{ip}", "192.0.2.7")
        words = text.split(" ")
        for _ in range(3):
            words.insert(rnd.randrange(len(words) + 1), rnd.choice(words) + rnd.choice(["", "x", ":", "_"]))
            lines.append(" ".join(words))
        lines += [text, "x" + text, text + "x", text.replace(" ", "  "), text.upper()]
    df = spark.createDataFrame(list(enumerate(lines)), "seq int, line string").repartition(4)
    jails = [(s, p) for s, _, p in catalogue()] + [("twice", patterns_of("sshd"))]
    names = ["seq", "jail", "pattern_idx", "ip"]
    got = sorted(map(tuple, extract.match(df, jails).select(names).collect()))
    assert len(got) > 400
    want = []
    for jail, patterns in jails:
        for seq, line in enumerate(lines):
            for i, p in enumerate(patterns):
                hit = re.search(steady(p), line, re.M) if all(x in line for x in needed(p)) else None
                if hit and hit.group(host_group(p)) == "192.0.2.7":
                    want.append((seq, jail, i, "192.0.2.7"))
                    break
    assert [g for g in got if g[3] == "192.0.2.7"] == sorted(want)


def test_blanks_end_soon_and_go_by_unicode(spark):
    long = "a" + " " * 65_000 + "x"
    rows = [long, "a\u00a0\u3000", "b\u0085 \t", "c\u200b ", "   ", "d \x1c", "x" * 65_537, "é" * 32_768 + " "]
    df = spark.createDataFrame(list(enumerate(rows)), "seq int, line string")
    extract.clean_lines(df).collect()
    began = time.time()
    got = {r["seq"]: r["line"] for r in extract.clean_lines(df).collect()}
    assert time.time() - began < 10
    assert got == {0: long, 1: "a", 2: "b", 3: "c\u200b", 4: "", 5: "d \x1c"}
    many = spark.createDataFrame([(i, long) for i in range(50)], "seq int, line string")
    began = time.time()
    assert extract.failures(many, [("sshd", patterns_of("sshd"))]).count() == 0
    assert time.time() - began < 60


def test_addresses_behind_a_literal_are_valid(spark):
    df = spark.createDataFrame([("from ad from 300.1.1.1 from 1.2.3.4:22 from 5.6.7.8",), ("from none",), ("from ::1",), (None,)], "line string")
    assert [r[0] for r in df.select(extract.address_behind(F.col("line"), "from ")).collect()] == ["1.2.3.4", None, "::1", None]


def test_addresses_with_line_ends_and_many_ports(spark):
    rows = ["1.2.3.4\n", "::1\n", "1.2.3.4:1:2:3:4:5", "1:2:3:4:5:6:7:8:9:10:11:12:13", "1.2.3.4" + ":9" * 500, "x" * 100 + ":1", "", ":", "2001:db8::1"]
    out = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(addr.without_port(F.col("t"))).collect()]
    assert out == [None, None, "1.2.3.4", "1:2:3:4:5:6:7:8", "1.2.3.4", None, None, None, "2001:db8::1"]
