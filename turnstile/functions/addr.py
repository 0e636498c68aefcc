"""Addresses as columns: strict parsing, canonical text, 4- or 16-byte form, networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"^{OCTET}(?:\.{OCTET}){{3}}\z"


def is_v4(token: Column) -> Column:
    """A dotted quad without leading zeros."""
    return token.rlike(V4)


def v4_number(ip: Column) -> Column:
    """The quad as a number; null if it is none."""
    part = F.split(ip, r"\.")
    value = F.lit(0).cast("long")
    for i in range(4):
        value = value * 256 + F.try_element_at(part, F.lit(i + 1)).try_cast("long")
    return F.when(is_v4(ip), value)


def v4_text(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)])


def _v6_shape() -> str:
    """All texts of version-6 addresses: eight groups, or fewer around one "::", the last two also as a quad."""
    h, quad = "[0-9a-fA-F]{1,4}", rf"{OCTET}(?:\.{OCTET}){{3}}"
    forms = [rf"(?:{h}:){{7}}{h}", rf"(?:{h}:){{6}}{quad}"]
    for n in range(8):
        left = "" if n == 0 else h if n == 1 else rf"{h}(?::{h}){{{n - 1}}}"
        forms.append(rf"{left}::" + (rf"(?:{h}(?::{h}){{0,{6 - n}}})?" if n < 7 else ""))
        if n <= 5:
            forms.append(rf"{left}::(?:{h}:){{0,{5 - n}}}{quad}")
    return "^(?:" + "|".join(forms) + r")\z"


V6 = _v6_shape()
#: Characters of the longest text of an address.
LONGEST = 45


def with_hex(df: DataFrame, token: str, out: str) -> DataFrame:
    """Adds the 32 hex digits of a version-6 address; null if the token is none. Each step is a column of its own."""
    low = F.lower(token)
    octets = F.split(F.regexp_extract(low, r"([0-9.]+)$", 1), r"\.")
    word = lambda i: F.lower(F.hex(F.get(octets, F.lit(i)).try_cast("int") * 256 + F.get(octets, F.lit(i + 1)).try_cast("int")))
    whole = F.when(low.contains("."), F.concat(F.regexp_replace(low, r"[0-9.]+$", ""), word(0), F.lit(":"), word(2))).otherwise(low)
    df = df.withColumn("_whole", F.when(F.col(token).contains(":") & F.col(token).rlike(V6), whole))
    side = lambda i: F.coalesce(F.array_remove(F.split(F.get(F.split("_whole", "::"), F.lit(i)), ":"), ""), F.array().cast("array<string>"))
    df = df.withColumn("_left", side(0)).withColumn("_right", side(1))
    groups = F.concat("_left", F.array_repeat(F.lit("0"), F.greatest(8 - F.size("_left") - F.size("_right"), F.lit(0))), "_right")
    return df.withColumn(out, F.when(F.col("_whole").isNotNull(), F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))).drop("_whole", "_left", "_right")


def is_address(token: Column) -> Column:
    return is_v4(token) | (token.contains(":") & token.rlike(V6))


def without_port(token: Column) -> Column:
    """The token if it is an address; else what is left of its last colon, again and again; null if that is none.

    An address has 45 characters at most, so only the beginnings of the token that end ahead of a colon and are
    no longer than that can be one. The longest that is wins.
    """
    head = F.substring(token, 1, LONGEST + 1)
    ends = F.filter(F.sequence(F.lit(1), F.length(head)), lambda i: F.substring(head, i + 1, F.lit(1)) == ":")
    tries = F.transform(F.reverse(ends), lambda i: F.substring(head, F.lit(1), i))
    cut = F.get(F.filter(tries, is_address), F.lit(0))
    return F.when(is_address(token), token).when(token.contains(":"), cut)


def with_ip(df: DataFrame, token: str, out: str) -> DataFrame:
    """Adds the canonical text of an address: lower case, the first longest run of zero groups as "::", mapped ones as version 4.

    In steps with columns of their own, so that each is worked out once.
    """
    col = F.col(token)
    df = with_hex(df, token, "_hex")
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring("_hex", (i * 4 + 1).cast("int"), F.lit(4)), "^0{1,3}", "")), ":")
    df = df.withColumn("_groups", F.when(F.col("_hex").isNotNull(), groups))
    text = F.col("_groups")
    for n in range(2, 9):
        run = r"(?:^|(?<=:))0(?::0){%d}(?:$|(?=:))" % (n - 1)
        text = F.when(F.col("_groups").rlike(run), F.regexp_replace(F.regexp_replace("_groups", "^(.*?)" + run, "$1<>"), r":?<>:?", "::")).otherwise(text)
    mapped = v4_text(F.conv(F.substring("_hex", 25, 8), 16, 10).cast("long"))
    v6 = F.when(F.substring("_hex", 1, 24) == "0" * 20 + "ffff", mapped).otherwise(text)
    return df.withColumn(out, F.when(is_v4(col), col).when(F.col("_hex").isNotNull(), v6)).drop("_hex", "_groups")


def family(ip: Column) -> Column:
    return F.when(ip.contains(":"), 6).otherwise(4).cast("int")


def with_bin(df: DataFrame, ip: str, out: str) -> DataFrame:
    """Adds network-order bytes; they compare as addresses do."""
    df = with_hex(df, ip, "_hex16")
    return df.withColumn(out, F.coalesce(F.unhex("_hex16"), F.unhex(F.lpad(F.hex(v4_number(F.col(ip))), 8, "0")))).drop("_hex16")


def masked(ip_bin: Column, bits: Column) -> Column:
    """Upper bits of a binary address as hex digits; the rest is left out. With the number of bits, it names a network."""
    digits = F.hex(ip_bin)
    whole, odd = F.floor(bits / 4).cast("int"), F.pmod(bits, F.lit(4))
    edge = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.call_function("shiftleft", F.lit(1), (4 - odd).cast("int"))
    return F.concat(F.substring(digits, F.lit(1), whole), F.when(odd > 0, F.hex((edge - F.pmod(edge, step)).cast("long"))).otherwise(""))


def with_range(df: DataFrame, cidr: str) -> DataFrame:
    """Adds family, lo, hi (bytes) and bits of a network; all null if the text is none. Host bits are allowed."""
    df = df.withColumn("_addr", F.substring_index(cidr, "/", 1)).withColumn("_bits", F.regexp_extract(F.col(cidr), r"^[^/]+/([0-9]{1,3})$", 1).try_cast("int"))
    df = with_hex(df, "_addr", "_digits").withColumn("_n", F.when(F.col("_bits") <= 32, v4_number(F.col("_addr"))))
    df = df.withColumn("_size", F.call_function("shiftleft", F.lit(1).cast("long"), 32 - F.least("_bits", F.lit(32)))).withColumn("_lo", F.col("_n") - F.pmod("_n", "_size"))
    bits, odd = F.col("_bits"), F.pmod(F.col("_bits"), F.lit(4))
    df = df.withColumn("_full", F.floor(bits / 4).cast("int")).withColumn("_step", F.call_function("shiftleft", F.lit(1), 4 - odd))
    edge = F.conv(F.substring(F.col("_digits"), F.col("_full") + 1, F.lit(1)), 16, 10).cast("int")
    df = df.withColumn("_edge", F.when(bits < 128, edge - F.pmod(edge, F.col("_step"))))
    side = lambda e, fill: F.when(bits == 128, F.col("_digits")).otherwise(F.rpad(F.concat(F.substring(F.col("_digits"), F.lit(1), F.col("_full")), F.lower(F.hex(e.cast("long")))), 32, fill))
    six = F.col("_digits").isNotNull() & (bits <= 128)
    quad = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    df = df.withColumn("family", F.when(F.col("_n").isNotNull(), 4).when(six, 6).cast("int"))
    df = df.withColumn("lo", F.when(F.col("family") == 4, quad(F.col("_lo"))).when(six, F.unhex(side(F.col("_edge"), "0"))))
    df = df.withColumn("hi", F.when(F.col("family") == 4, quad(F.col("_lo") + F.col("_size") - 1)).when(six, F.unhex(side(F.col("_edge") + F.col("_step") - 1, "f"))))
    df = df.withColumn("bits", F.when(F.col("family").isNotNull(), bits))
    return df.drop("_addr", "_bits", "_digits", "_n", "_size", "_lo", "_full", "_step", "_edge")
