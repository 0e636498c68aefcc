import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from turnstile.functions import addr, eventtime, labels
from turnstile.operators import extract, timeline
from turnstile.operators.timeline import Policy
from turnstile.plans.catalogue import catalogue, expand, gate, patterns_of
from turnstile.plans.samples import samples


def test_catalogue_has_all_services():
    rows = catalogue()
    assert len(rows) == 88 and sum(len(p) for _, _, p in rows) == 127
    assert all(re.compile(expand(p)) for _, _, ps in rows for p in ps)
    assert sum(gate(p) is None for _, _, ps in rows for p in ps) == 12


def test_each_service_matches_its_line_only_with_an_address(spark):
    rows = [(i, s, line.replace("{ip}", "192.0.2.7"), line.replace("{ip}", "not-known")) for i, (s, line) in enumerate(samples())]
    df = spark.createDataFrame(rows, "seq int, service string, line string, other string")
    jails = [(s, p) for s, _, p in catalogue()]
    hits = {(r["service"], r["ip"]) for r in extract.match(df, jails).filter("service = jail").collect()}
    assert hits == {(s, "192.0.2.7") for s, _ in samples()}
    misses = df.select("seq", "service", F.col("other").alias("line"))
    assert extract.match(misses, jails).filter("service = jail").count() == 0


ADDRESSES = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "::1", "::", "2001:DB8:0:0:1:0:0:1", "2001:db8::1", "fe80::1:2:3:4:5:6", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "::ffff:10.0.0.1", "::ffff:0a00:0001", "1::2::3", "12345::", ":1", "1:", "abcd", "", "1:2:3:4:5:6:1.2.3.4", "64:ff9b::192.0.2.33"]


def test_addresses_as_the_standard_library_reads_them(spark):
    def want(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return None
        mapped = getattr(ip, "ipv4_mapped", None)
        return ipaddress.ip_address(mapped or ip)

    df = addr.with_ip(spark.createDataFrame([(a,) for a in ADDRESSES], "token string"), "token", "ip")
    for r in addr.with_bin(df, "ip", "bin").collect():
        expected = want(r["token"])
        assert (None if r["ip"] is None else ipaddress.ip_address(r["ip"])) == expected, r
        if expected is not None:
            assert bytes(r["bin"]) == expected.packed


@pytest.mark.parametrize("cidr", ["10.1.2.3/8", "0.0.0.0/0", "192.0.2.7/32", "2001:db8::/32", "2001:db8::1/127", "::1/128", "fe80::/10"])
def test_network_ranges(spark, cidr):
    r = addr.with_range(spark.createDataFrame([(cidr,)], "cidr string"), "cidr").first()
    net = ipaddress.ip_network(cidr, strict=False)
    assert (bytes(r["lo"]), bytes(r["hi"])) == (net[0].packed, net[-1].packed)


def test_ports_are_taken_off(spark):
    df = spark.createDataFrame([("10.0.0.1:8080",), ("10.0.0.1:29530:",), ("fe80::1:",), ("zz:1",)], "t string")
    assert [r[0] for r in df.select(addr.without_port(F.col("t"))).collect()] == ["10.0.0.1", "10.0.0.1", "fe80::1", None]


def test_spoofed_user_name_does_not_win(spark):
    line = "srv sshd[1]: Failed password for x from 1.1.1.1 port 1 from 2.2.2.2 port 22 ssh2"
    df = spark.createDataFrame([(1, line)], "seq int, line string")
    assert extract.match(df, [("sshd", patterns_of("sshd"))]).first()["ip"] == "2.2.2.2"


def test_times(spark):
    df = spark.createDataFrame([("Feb 29 01:02:03 x",), ("Feb 30 01:02:03 x",), ("2024-02-31T00:00:00Z",), ("[1700000000123]",), ("29/Feb/2024:00:00:01 +0100",)], "line string")
    out = df.select(*[eventtime.event_time(F.col("line"), F.lit(f), F.lit(2024)).alias(f) for f in ("syslog", "iso8601", "epoch", "common")]).collect()
    assert out[0]["syslog"] == 1709168523 and out[1]["syslog"] is None
    assert out[2]["iso8601"] == 1709337600 and out[3]["epoch"] == 1700000000123 and out[4]["common"] == 1709164801


def test_durations_and_ban_lengths(spark):
    df = spark.createDataFrame([("10m",), (" 2w ",), ("5",), ("5y",), ("",), ("99999999999999999999s",), ("9223372036854775807h",)], "t string")
    assert [r[0] for r in df.select(labels.duration(F.col("t"))).collect()] == [600, 1209600, 5, None, None, None, None]
    p = Policy(3, 60, 100, True, (1, 3), 1.5, 400)
    assert [p.length(n) for n in range(4)] == [150, 400, 400, 400]
    assert Policy(3, 60, 100, True, maxtime=0).length(50) == 100 * 2**20 and Policy(3, 60, -1, True).length(4) == -1


def test_fold_keeps_the_ring_and_drops_failures_of_banned_addresses(spark):
    rows = [("a", "j", t, t, 0, False) for t in (0, 10, 20, 30, 125, 500)]
    f = spark.createDataFrame(rows, "ip string, jail string, ts long, seq long, pattern_idx int, ts_inferred boolean")
    got = [(r["banned_at"], r["expires_at"], r["ban_count"]) for r in timeline.bans(f, {"j": Policy(3, 200, 100)}).orderBy("banned_at").collect()]
    assert got == [(20, 120, 1), (125, 225, 2)]


def test_bans_of_one_jail_never_overlap(spark):
    rows = [(f"i{k % 5}", "j", (k * 7919) % 5000, k, 0, False) for k in range(1500)]
    f = spark.createDataFrame(rows, "ip string, jail string, ts long, seq long, pattern_idx int, ts_inferred boolean")
    out = timeline.bans(f, {"j": Policy(3, 60, 40, True)}).toPandas().sort_values(["ip", "banned_at"])
    for _, g in out.groupby("ip"):
        assert (g["banned_at"].to_numpy()[1:] >= g["expires_at"].to_numpy()[:-1]).all()
        assert (g["ban_time"].diff().dropna() >= 0).all()


def test_line_hygiene_keeps_lines_up_to_65536_bytes(spark, tmp_path):
    from turnstile.plans.queries import QUERIES

    rows = [(n, "x" * n) for n in (4096, 4097, 65536, 65537)] + [(1, "é" * 32768), (2, "é" * 32768 + "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["seq"] for r in QUERIES["line_hygiene"](spark, str(tmp_path)).collect()} == {4096, 4097, 65536, 1}


def test_rings_of_jails_that_are_taken_out_are_dropped_and_bans_stay(spark):
    # j is missing from 100 to 200; b's ban lasts over that time.
    rows = [("a", "j", 10), ("a", "j", 150), ("a", "j", 210), ("a", "j", 220), ("b", "j", 20), ("b", "j", 21), ("b", "j", 210), ("b", "j", 220), ("c", "k", 90), ("c", "k", 110)]
    f = spark.createDataFrame([(*r, i, 0, False) for i, r in enumerate(rows)], "ip string, jail string, ts long, seq long, pattern_idx int, ts_inferred boolean")
    j, k = Policy(2, 1000, 500), Policy(2, 1000, 500)
    out = {(r["ip"], r["jail"], r["banned_at"]) for r in timeline.bans(f, [(0, {"j": j, "k": k}), (100, {"k": k}), (200, {"j": j, "k": k})]).collect()}
    assert out == {("b", "j", 21), ("a", "j", 220), ("c", "k", 110)}


def test_nested_networks_of_both_families(spark):
    from turnstile.operators import enrich

    nets = spark.createDataFrame([("10.0.0.0/8", "wide"), ("10.1.0.0/16", "mid"), ("10.1.2.0/24", "narrow"), ("2001:db8::/32", "six"), ("2001:db8:0:1::/64", "six-narrow"), ("::/0", "all"), ("bad", "bad")], "cidr string, country string")
    want = {"10.9.9.9": "wide", "10.1.9.9": "mid", "10.1.2.3": "narrow", "11.0.0.1": None, "2001:db8::1": "six", "2001:db8:0:1::1": "six-narrow", "fe80::1": "all"}
    rows = spark.createDataFrame([(a,) for a in [*want, "10.1.2.3"]], "ip string")
    assert sorted((r["ip"], str(r["country"])) for r in enrich.geo_prefix(rows, nets, ["country"]).collect()) == sorted((a, str(want[a])) for a in [*want, "10.1.2.3"])
    ranges = spark.createDataFrame([(0x0A000000, 0x0AFFFFFF, "wide"), (0x0A010000, 0x0A01FFFF, "mid")], "lo_n long, hi_n long, country string")
    found = enrich.geo_range(rows.filter("ip LIKE '10%'"), ranges).collect()
    assert sorted((r["ip"], r["country"]) for r in found) == [("10.1.2.3", "mid"), ("10.1.2.3", "mid"), ("10.1.9.9", "mid"), ("10.9.9.9", "wide")]


def test_bans_at_each_of_many_instants(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(300):
        at = rnd.randrange(-10**6, 10**9)
        end = rnd.choice([None, at, at + 1, at + rnd.randrange(3600), at + rnd.randrange(10**5), at + rnd.randrange(10**7), at + rnd.randrange(2 * 10**9)])
        rows.append((f"ip{i % 40}", rnd.choice("jk"), at, end, end))
    bans = spark.createDataFrame([*rows, rows[0]], "ip string, jail string, banned_at long, expires_at long, ended_at long")
    times = [rnd.randrange(-2 * 10**6, 10**9) for _ in range(200)] + [r[2] for r in rows[:40]] + [r[3] for r in rows[:40] if r[3] is not None]
    asked = spark.createDataFrame([(k, t) for k, t in enumerate([*times, times[0], None])], "k long, t long")
    got = sorted((r.k, r.ip, r.jail, r.banned_at) for r in timeline.active_at_each(bans, asked).collect())
    want = sorted((k, r[0], r[1], r[2]) for k, t in enumerate([*times, times[0]]) for r in [*rows, rows[0]] if r[2] <= t and (r[4] is None or r[4] > t))
    assert got == want and len(got) > 1000
    assert timeline.active_at_each(bans, asked.limit(0)).count() == timeline.active_at_each(bans.limit(0), asked).count() == 0
