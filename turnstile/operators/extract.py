"""Lines to failures: match, validate, suppress, allow-list, time."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.functions import addr, eventtime
from turnstile.plans.catalogue import host_group, needed, rare_word, steady
from turnstile.sources.tables import written

MAX_LINE = 65536
#: White space by Unicode, which goes from the ends of lines.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
Jails = Sequence[tuple[str, Sequence[str]]]


def clean_lines(lines: DataFrame, bound: int = MAX_LINE) -> DataFrame:
    """Drops lines over the bound in bytes, replaces invalid UTF-8, trims white space at the end."""
    # A set of characters to trim is looked through once from the end; a pattern would begin anew at every blank of a line.
    return lines.filter(F.octet_length("line") <= bound).withColumn("line", F.rtrim(F.make_valid_utf8("line"), F.lit(BLANKS)))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found_sql(pattern: str, bit: int | None, gated: bool) -> str:
    """The text at <HOST> from one run of the pattern on the column line, as SQL: empty, or null behind a gate, where it does not match."""
    text = f"regexp_extract(line, {_quoted('(?dm)' + steady(pattern))}, {host_group(pattern)})"
    gates = [] if bit is None else [f"(_words & {1 << bit}L) != 0L"]
    gates += [f"contains(line, {_quoted(x)})" for x in needed(pattern)] if gated else []
    return f"CASE WHEN {' AND '.join(gates)} THEN {text} END" if gates else text


def token(line: Column, pattern: str, gated: bool = True) -> Column:
    """The text at <HOST>, null where the pattern does not match; the literals that it needs are looked for first."""
    text = F.regexp_extract(line, "(?dm)" + steady(pattern), host_group(pattern))
    for literal in needed(pattern) if gated else []:
        text = F.when(line.contains(literal), text)
    return F.when(text != "", text)


#: From so many patterns on, a line's words are looked up in an index before any pattern's literals are looked for.
INDEXED = 24
#: Places in the index of words, and bits that tell words apart; words that share a place or a bit only cost a look.
PLACES, BITS = 1024, 63


def _index(line: Column, patterns: Sequence[str]) -> tuple[Column, list[int | None]]:
    """A number whose bits tell which indexed words a line has, and for each pattern its word's bit (None: no such word).

    Each pattern is known by one word that stands whole in one of its literals, so it stands whole in every line that matches. A line is
    split into words once; a word's place in a table holds the bits of the words with that hash.
    """
    words = [rare_word(p) for p in patterns]
    bit_of = {w: i % BITS for i, w in enumerate(dict.fromkeys(w for w in words if w))}
    spark = SparkSession.active()
    places = spark.range(1).select(*[F.xxhash64(F.lit(w)).bitwiseAND(F.lit(PLACES - 1)) for w in bit_of]).first() if bit_of else []
    table = [0] * PLACES
    for place, bit in zip(places, bit_of.values()):
        table[place] |= 1 << bit
    held = F.expr(f"array({', '.join(f'{x}L' for x in table)})")
    found = F.aggregate(F.split(line, "[^A-Za-z0-9]+"), F.lit(0).cast("long"), lambda m, w: m.bitwiseOR(F.get(held, F.xxhash64(w).bitwiseAND(F.lit(PLACES - 1)).cast("int"))))
    return found, [bit_of.get(w) for w in words]


def match(lines: DataFrame, jails: Jails, gated: bool = True) -> DataFrame:
    """lines with jail, pattern_idx and ip: for each jail the first of its patterns that yields an address.

    One pass over the text for all jails. A pattern that several jails have runs once, and only on lines that have all of its
    literals; of many patterns only those are looked at of which a line has a word. Addresses are parsed only where a pattern has matched.
    """
    line = F.col("line")
    patterns = list(dict.fromkeys(p for _, ps in jails for p in ps))
    bits: list[int | None] = [None] * len(patterns)
    df = lines
    if gated and len(patterns) >= INDEXED:
        found, bits = _index(line, patterns)
        df = df.withColumn("_words", found)
    # As text, since hundreds of expressions take seconds to build one by one.
    texts = [_found_sql(p, b, gated) for p, b in zip(patterns, bits)]
    df = df.select(*lines.columns, F.expr(f"array({', '.join(texts)})").alias("_t"))
    text = lambda k: F.get("_t", k)
    row = lambda jail, i, token: F.struct(jail.alias("jail"), i.alias("pattern_idx"), token.alias("token"))
    if len(patterns) < INDEXED:
        df = df.select(*lines.columns, F.array(*[F.when(text(F.lit(k)) != "", addr.without_port(text(F.lit(k)))) for k in range(len(patterns))]).alias("_t"))
        first = lambda jail, own: F.coalesce(*[F.when(text(F.lit(patterns.index(p))).isNotNull(), row(F.lit(jail), F.lit(i), text(F.lit(patterns.index(p))))) for i, p in enumerate(own)])
        hits = F.array_compact(F.array(*[first(jail, own) for jail, own in jails if own]))
    else:
        # Of many patterns few have a text: those alone are parsed, dealt to their jails, and put in order, the first of each jail first.
        own = {p: ", ".join(f"named_struct('jail', {_quoted(jail)}, 'i', {i})" for jail, ps in jails for i, q in enumerate(ps) if q == p) for p in patterns}
        owners = F.expr(f"array({', '.join(f'array({own[p]})' for p in patterns)})")
        parsed = F.transform(F.filter(F.sequence(F.lit(0), F.lit(len(patterns) - 1)), lambda k: text(k) != ""), lambda k: F.struct(k.alias("k"), addr.without_port(text(k)).alias("token")))
        dealt = F.transform(F.filter(parsed, lambda h: h["token"].isNotNull()), lambda h: F.transform(F.get(owners, h["k"]), lambda o: row(o["jail"], o["i"], h["token"])))
        df = df.select(*lines.columns, F.when(F.array_join("_t", "") != "", F.array_sort(F.flatten(dealt))).alias("_t"))
        hits = F.filter("_t", lambda x, i: (i == 0) | (x["jail"] != F.get("_t", i - 1)["jail"]))
    # The outer form, as Spark infers a filter from the other and would run all patterns again for it.
    df = df.select(*lines.columns, F.explode_outer(hits).alias("_t")).filter(F.col("_t").isNotNull())
    df = df.select(*lines.columns, "_t.jail", "_t.pattern_idx", F.col("_t.token").alias("_token"))
    return addr.with_ip(df, "_token", "ip").drop("_token")


def address_behind(line: Column, literal: str) -> Column:
    """The first valid address that stands directly behind a literal, ports taken off; a client may have put it there."""
    found = F.regexp_extract_all(line, F.lit(re.escape(literal) + "([0-9A-Fa-f.:]{2,})"), F.lit(1))
    return F.get(F.filter(F.transform(found, addr.without_port), lambda x: x.isNotNull()), F.lit(0))


def address_ahead(line: Column, literal: str) -> Column:
    """The last address ahead of the first place of a literal."""
    ahead = F.split(F.substring_index(line, literal, 1), r"[^0-9A-Fa-f.:]+")
    return F.get(F.filter(F.transform(F.reverse(ahead), addr.without_port), lambda x: x.isNotNull()), F.lit(0))


def drop_ignored(matched: DataFrame, ignore: Sequence[str]) -> DataFrame:
    """Leaves out lines that any ignore pattern matches; tried on matched lines only."""
    for pattern in ignore:
        matched = matched.filter(~F.col("line").rlike(pattern))
    return matched


def networks(allowed: DataFrame) -> DataFrame:
    """allowed (jail, cidr) to jail, family, bits, lo, hi; loopback networks are always among them. Invalid texts have no range."""
    spark = allowed.sparkSession
    own = spark.createDataFrame([(None, "127.0.0.0/8"), (None, "::1/128")], "jail string, cidr string")
    return written(addr.with_range(allowed.select("jail", "cidr").union(own), "cidr"), "networks")


def holding(ips: DataFrame, nets: DataFrame) -> DataFrame:
    """ips (ip, distinct) with the columns of each network (family, bits, lo, ..., written) that holds them.

    An address meets networks by its first bits, once for each prefix length that its family's networks have: an equi-join of
    both families, without a key that many addresses share but that of a network that holds them all.
    """
    known = nets.filter("family IS NOT NULL")
    lengths = known.groupBy("family").agg(F.collect_set("bits").alias("_all"))  # two rows, of 129 lengths at most
    mine = addr.with_bin(ips.select("ip").withColumn("_family", addr.family(F.col("ip"))), "ip", "_bin")
    mine = mine.join(F.broadcast(lengths), mine["_family"] == lengths["family"]).select("ip", "_family", "_bin", F.explode("_all").alias("_bits"))
    mine = mine.select("ip", "_family", "_bits", addr.masked(F.col("_bin"), F.col("_bits")).alias("_key"))
    known = known.withColumn("_net", addr.masked(F.col("lo"), F.col("bits")))
    on = (mine["_family"] == known["family"]) & (mine["_bits"] == known["bits"]) & (mine["_key"] == known["_net"])
    return mine.join(known, on).drop("_family", "_bits", "_key", "_net")


def drop_allowed(failures: DataFrame, allowed: DataFrame) -> DataFrame:
    """Failures whose address no allow-list network of their jail (or of all jails) holds."""
    failures = written(failures, "failures")  # read twice, matched once
    held = holding(failures.select("ip").distinct(), networks(allowed)).select(F.col("ip").alias("_ip"), F.col("jail").alias("_jail")).distinct()
    return failures.join(held, (F.col("ip") == F.col("_ip")) & (F.col("_jail").isNull() | (F.col("_jail") == F.col("jail"))), "left_anti")


def in_networks(rows: DataFrame, cidrs: DataFrame) -> DataFrame:
    """Rows whose ip lies in any of the networks."""
    rows = written(rows, "rows")
    held = holding(rows.select("ip").distinct(), networks(cidrs)).select(F.col("ip").alias("_ip")).distinct()
    return rows.join(held, F.col("ip") == F.col("_ip"), "left_semi")


def with_time(matched: DataFrame, form: Column | str, year: int, default: Column | None = None) -> DataFrame:
    """Adds ts (epoch seconds; the default where the line has none) and ts_inferred."""
    parsed = eventtime.event_time(F.col("line"), F.lit(form) if isinstance(form, str) else form, F.lit(year))
    df = matched.withColumn("_parsed", parsed)
    return df.withColumn("ts", F.coalesce("_parsed", default if default is not None else F.lit(0).cast("long"))).withColumn("ts_inferred", F.col("_parsed").isNull()).drop("_parsed")


def failures(lines: DataFrame, jails: Jails, form: str = "iso8601", year: int = 2024, ignore: Sequence[str] = (), allowed: DataFrame | None = None) -> DataFrame:
    """ip, jail, ts, seq, pattern_idx, ts_inferred."""
    df = drop_ignored(match(clean_lines(lines), jails), ignore)
    if allowed is not None:
        df = drop_allowed(df, allowed)
    return with_time(df, form, year).select("ip", "jail", "ts", "seq", "pattern_idx", "ts_inferred")
