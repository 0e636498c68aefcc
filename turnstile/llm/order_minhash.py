"""Document fingerprints by Order MinHash (operator 2), DataFrame functions only.

A text is a run of tokens: pieces of at most 16 characters without white space. Its k-mers, runs of K tokens,
are numbered by their occurrence, so that a repeated k-mer counts each time. Each of SIGNATURES signatures has a hash order
of the numbered k-mers, takes the two that are smallest in it, and hashes the two in the order in which they stand in the text.
Two texts agree on a signature if the same two k-mers come out in the same order: moving parts of a
text costs as edits do, other than with plain MinHash. The likeness of two fingerprints is the share of equal signatures.

The orders are those of one permutation: each numbered k-mer has one hash, and order j begins at the j-th of SIGNATURES equal
parts of the hashes' range and goes on in a circle. So one sort of a text's hashes gives all of them, and a text with few k-mers
needs no rule of its own. All steps are linear or a sort, on one row's arrays; nothing is exploded and no k-mer is shuffled.
A hash has 32 bits, a place 31, which is all that an array can have.

Cases: a null text counts as empty; texts without a token share one fingerprint, with a likeness of 1 to each other and of
0 to all else; a text with fewer than K tokens is one k-mer, which is then both of the two. Ties in a hash fall to the earlier
k-mer. Documents are ordered by id, descending, nulls last, then by a hash of the text; copies of a row (same id, same text)
follow each other, so that a copy's next document is the next copy. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_of

K, SIGNATURES = 3, 32
#: Bits of a k-mer's place, below those of its hash, and bits of a number that tell its part of the hashes' range.
PLACE, PART = 31, 58
#: White space, or the end of a piece of 16 characters.
SPLIT = r"[\x20\x09-\x0D]+|(?<=\G[^\x20\x09-\x0D]{16})"
OWN, EDITED, SELF = 0, 1, 2


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, SPLIT), "")


def kmers(t: str) -> Column:
    """32-bit hashes of the k-mers in column t of tokens, in text order."""
    n = F.size(t)
    at = lambda i: F.hash(*[F.element_at(t, (i + j).cast("int")) for j in range(K)])
    return F.when(n >= K, F.transform(F.sequence(F.lit(1), n - (K - 1)), at)).otherwise(F.array(F.hash(F.array_join(t, " "))))


def _number(hash_: Column, place: Column) -> Column:
    """A hash above a place; such numbers order by both and are never negative."""
    return F.shiftleft(hash_.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), PLACE).bitwiseOR(place.cast("long"))


def _hash_of(number: Column) -> Column:
    return F.shiftright(number, PLACE)


def _place_of(number: Column) -> Column:
    return number.bitwiseAND(F.lit((1 << PLACE) - 1).cast("long"))


def signatures(texts: DataFrame, by: list[str], text: str, carry: str) -> DataFrame:
    """``by``, ``signatures`` (array of int) and ``carry``, one row for each row of texts."""
    keep = [*by, carry]
    df = texts.select(*keep, tokens(F.col(text)).alias("_t")).select(*keep, kmers("_t").alias("_k"))
    df = df.select(*keep, F.sort_array(F.transform("_k", _number)).alias("_s"))
    # Equal k-mers now stand in a row, in text order: where such rows begin, and the numbers 1, 2, ... within each.
    new = lambda i: (i == 0) | (_hash_of(F.get("_s", i)) != _hash_of(F.get("_s", i - 1)))
    df = df.select(*keep, "_s", F.filter(F.sequence(F.lit(0), F.size("_s") - 1), new).alias("_b"))
    nth = F.flatten(F.transform("_b", lambda b, r: F.sequence(F.lit(1), F.coalesce(F.get("_b", r + 1), F.size("_s")) - b)))
    df = df.select(*keep, F.sort_array(F.zip_with("_s", nth, lambda x, k: _number(F.hash(_hash_of(x), k), _place_of(x)))).alias("_g"))
    df = df.select(*keep, "_g", F.size("_g").alias("_n"), F.transform("_g", lambda g: F.shiftright(g, PART).cast("int")).alias("_p"))
    # Where each part of the range begins among the sorted hashes (from 1); an empty part begins where the next one does.
    # Arrays of an earlier step are named twice within a lambda, else Spark would put that step into it, once per element.
    parts = F.sequence(F.lit(0), F.lit(SIGNATURES - 1))
    df = df.select(*keep, "_g", "_n", F.transform(parts, lambda j: F.when(F.array_contains("_p", j), F.array_position("_p", j).cast("int"))).alias("_a"))
    later = lambda j: F.filter(F.slice("_a", j + 1, F.lit(SIGNATURES)), lambda a: a.isNotNull())
    df = df.select(*keep, "_g", "_n", F.transform(parts, lambda j: F.coalesce(F.get("_a", j), F.get(later(j), F.lit(0)), F.lit(1))).alias("_a"))
    df = df.select(*keep, F.transform("_a", lambda a: F.struct(F.element_at("_g", a).alias("one"), F.element_at("_g", a % F.col("_n") + 1).alias("two"))).alias("_m"))

    def tuple_of(m: Column) -> Column:
        one, two = m["one"], m["two"]
        return F.when(_place_of(one) <= _place_of(two), F.hash(_hash_of(one), _hash_of(two))).otherwise(F.hash(_hash_of(two), _hash_of(one)))

    return df.select(*keep, F.transform("_m", tuple_of).alias("signatures"))


def neighbours(rows: DataFrame) -> DataFrame:
    """rows (doc_id, key, n_chars, ...) with ``next_*`` and ``prev_*`` of each, in a circle, by id and key, descending.

    Dealt by ranges; only the ends of the ranges, one row each, are looked up across them.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("key").desc()]
    dealt = stored(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "order-dealt")
    by = Window.partitionBy("part").orderBy(*order)
    here = F.struct("doc_id", "key", "n_chars")
    dealt = dealt.select("*", here.alias("_here"), F.lead(here).over(by).alias("_next"), F.lag(here).over(by).alias("_prev"))
    ends = dealt.groupBy("part").agg(F.first(F.when(F.col("_prev").isNull(), F.col("_here")), True).alias("_first"), F.first(F.when(F.col("_next").isNull(), F.col("_here")), True).alias("_last"))
    every = Window.orderBy("part")
    span = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("_first").over(every), F.first("_first").over(span)).alias("_after"), F.coalesce(F.lag("_last").over(every), F.last("_last").over(span)).alias("_before"))
    df = dealt.join(ends, "part").withColumn("_next", F.coalesce("_next", "_after")).withColumn("_prev", F.coalesce("_prev", "_before"))
    return df.select(*rows.columns, *[F.col(f"_{w}.{c}").alias(f"{w}_{c}") for w in ("next", "prev") for c in ("doc_id", "key", "n_chars")])


def likeness(a: str, b: str) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.lit(float(SIGNATURES))


def text_form(sig: str) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0")), "")


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text = text_of(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("*", F.xxhash64("text").alias("key"))
    ids = rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).cast("long").alias("n_chars"))
    ids = stored(neighbours(ids), "order-ids")
    # One row for equal rows; each sends its beginning to the document before it.
    # A row is known by two hashes, of its text and of its id with that; all that follows is dealt by both.
    spot = lambda i, k: F.xxhash64(F.col(i).isNull(), i, k)
    at = ["spot", "key"]
    whole = rows.select(spot("doc_id", "key").alias("spot"), "key", "text").groupBy(*at).agg(F.first("text").alias("text"))
    known = ids.select(spot("doc_id", "key").alias("spot"), "key", "copies", "n_chars", spot("prev_doc_id", "prev_key").alias("prev_spot"), "prev_key", "prev_n_chars")
    whole = whole.join(known, at)
    third = lambda c: F.floor(F.col(c) / 3).cast("int")
    heads = whole.select(F.col("prev_spot").alias("spot"), F.col("prev_key").alias("key"), F.substring("text", F.lit(1), third("prev_n_chars")).alias("head"))
    both = whole.join(heads, at)
    stay = F.substring("text", F.lit(1), (F.col("n_chars") - third("n_chars")).cast("int"))
    edited = F.concat(stay, F.col("head"))
    again = F.concat(stay, F.substring("text", F.lit(1), third("n_chars")))
    form = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    forms = F.when(F.col("copies") > 1, F.array(form(OWN, F.col("text")), form(EDITED, edited), form(SELF, again))).otherwise(F.array(form(OWN, F.col("text")), form(EDITED, edited)))
    forms = both.select(*at, F.explode(forms).alias("_f")).select(*at, "_f.kind", "_f.text")
    forms = forms.select(*at, "kind", "text", F.when(F.col("kind") != OWN, F.sha2("text", 256)).alias("sha"))
    prints = stored(signatures(forms, [*at, "kind"], "text", "sha"), "order-prints")
    of = lambda kind, name: prints.filter(F.col("kind") == kind).select(F.col("spot").alias(f"{name}_spot"), F.col("key").alias(f"{name}_key"), F.col("signatures").alias(name), F.col("sha").alias(f"{name}_sha"))
    is_ = lambda name, by: (F.col(f"{name}_spot") == F.col(by[0])) & (F.col(f"{name}_key") == F.col(by[1]))
    out = ids.select("doc_id", "copies", "n_chars", spot("doc_id", "key").alias("spot"), "key", spot("next_doc_id", "next_key").alias("next"), "next_key")
    out = out.join(of(OWN, "own"), is_("own", at)).join(of(EDITED, "edited"), is_("edited", at))
    out = out.join(of(OWN, "other"), is_("other", ["next", "next_key"])).join(of(SELF, "self"), is_("self", at), "left")
    last = out.select("doc_id", "n_chars", F.col("edited_sha").alias("edited_sha256"), "own", "edited", "other")
    copies = out.filter("copies > 1").select("doc_id", "n_chars", F.col("self_sha").alias("edited_sha256"), "own", F.col("self").alias("edited"), F.col("own").alias("other"), F.explode(F.sequence(F.lit(2).cast("long"), F.col("copies"))).alias("_n")).drop("_n")
    out = last.unionByName(copies)
    return out.select("doc_id", "n_chars", "edited_sha256", text_form("own").alias("fingerprint"), text_form("edited").alias("edited_fingerprint"), likeness("own", "edited").alias("near_edited"), likeness("own", "other").alias("near_next"))
