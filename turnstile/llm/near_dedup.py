"""Near-duplicate documents by HyperMinHash (operator 5).

Each document becomes a set of word shingles, and the set becomes REGISTERS buckets. A bucket keeps its smallest hash
as a leading-zero count and MANTISSA further bits. Bands of four registers name the places where documents can meet.
Pairs that meet are estimated from all registers, corrected for registers that agree by chance, and what is not clearly
too far apart is confirmed on the full sets. Classes are the connected components of the confirmed links.

Equal sets count once. No place is expanded into all of its pairs, however many or few meet there: each member is held
against the place's first one; of a place whose other members are then still in several components, these go through a prefix
join, which is exact, with rounds of the same kind ahead of it. Two sets can only be as similar as the threshold if the smaller one's first n - ceil(2t / (1 + t) * n) + 1
shingles and the larger one's first n - ceil(t * n) + 1 share one, in a common order from the rarest to the most
frequent. So rows are cut by their places in that order before they meet, and copies that were changed too much to be links have
rare shingles of their own there and meet nobody. The first round holds each member against the one with the fewest rare shingles,
which of copies of one text is the one that is closest to it; later rounds take any.

Each set also has a bitmap: the parity of the number of its hashes at each of PARITY bits. Bits in which two bitmaps differ are never more
than the shingles that only one of the two sets has, so pairs that differ in too many for a link go before they become rows. That loses no
link: it is a bound, not an estimate.

Cases: null or empty texts, and texts without a word, have no shingles, link with nothing and are kept; a text with fewer
words than a shingle is one shingle. A null id links with nothing, has a null component and is kept. Rows that share
an id share a component, whatever their texts. Equal texts always share one. Columns other than doc_id and text play no part,
whatever their names; equal rows count as one in ``dedup_documents``, rows of one id that differ are all kept or all gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, removed, stored

REGISTERS, MANTISSA, ROWS = 128, 10, 4
BANDS = REGISTERS // ROWS
#: Bits of a set's bitmap, in 64-bit words.
PARITY = 1024
#: Rounds, at most, in which members are held against one of them; they end where less than one try in FRUITFUL is a link.
ROUNDS, FRUITFUL = 4, 10
#: Rows that a task works on at a time.
SLICE = 256
#: Standard deviations below the threshold at which an estimate still goes on to the full sets.
MARGIN = 6.0
MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
#: For an empty bucket, the buckets it borrows from, in order.
BORROW = np.random.default_rng(20240501).integers(0, REGISTERS, (REGISTERS, 8 * REGISTERS))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of runs of k words."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    m = n - k + 1
    total = np.zeros(m, np.uint64)
    for i in range(k):
        total += mixed(h[i : i + m] ^ MULT[i % len(MULT)]) * (MULT[(i * 3 + 1) % len(MULT)] + np.uint64(2 * i))
    return np.unique(mixed(total))


def registers(s: np.ndarray) -> np.ndarray:
    """One 16-bit register a bucket: leading zeros, then the bits behind the first one."""
    bucket = (s >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (s[first] << np.uint64(7)) | np.uint64(127)
    zeros = 63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 62)
    behind = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out = np.zeros(REGISTERS, np.uint16)
    filled = np.zeros(REGISTERS, bool)
    out[bucket[first]] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | behind).astype(np.uint16)
    filled[bucket[first]] = True
    if not filled.all():
        empty = np.flatnonzero(~filled)
        hit = filled[BORROW[empty]]
        source = BORROW[empty, hit.argmax(1)]
        source[~hit.any(1)] = bucket[first[0]]
        out[empty] = out[source]
    return out


def parity(s: np.ndarray) -> np.ndarray:
    """For each of PARITY bits, whether an odd number of hashes fall on it; as 64-bit words."""
    return np.packbits(np.bincount((s % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) % 2 == 1).view(np.int64)


def may_link(a: str, b: str, n_a: str, n_b: str, threshold: int) -> Column:
    """False if two sets are no link, as their bitmaps differ in more bits than shingles may be in one set only."""
    differ = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(PARITY // 64)), F.lit(0))
    return differ * (100 + threshold) <= (100 - threshold) * (F.col(n_a) + F.col(n_b))


def bands(regs: str) -> Column:
    """A key for each band of ROWS registers (ROWS * 2 bytes)."""
    return F.array(*[F.xxhash64(F.lit(i), F.substring(regs, 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])


def _sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), SLICE):
            yield pdf.iloc[at : at + SLICE]


def _signatures(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _sliced(batches):
            rows = []
            for text in pdf["text"]:
                s = shingles(text, k)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), registers(s).tobytes(), parity(s)) if len(s) else (0, None, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "digest", "regs", "parity"])
            yield out.assign(doc_id=pdf["doc_id"].astype("Int64").array, spot=pdf["spot"].array)[["doc_id", "spot", "n_shingles", "digest", "regs", "parity"]]

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text that tells rows of one id apart."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.withColumn("spot", F.xxhash64("text"))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """One row per row of docs, with a number of its own (node)."""
    out = keyed(docs).mapInPandas(_signatures(k), "doc_id long, spot long, n_shingles long, digest binary, regs binary, parity array<long>")
    return out.withColumn("node", F.monotonically_increasing_id())


def chance(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How often registers of two sets agree though their minima differ.

    A bucket of b values has its minimum in the cell [x, x + w) with probability (1 - x)^b - (1 - x - w)^b; for two sets
    that is summed over cells. Cells halve in groups of 2^MANTISSA, so a group is an integral over its cells' width.
    """
    ba, bb = np.maximum(na / REGISTERS, 1.0), np.maximum(nb / REGISTERS, 1.0)
    total = np.zeros(len(ba))
    for zeros in range(24):
        lo, hi = 2.0 ** -(zeros + 1), 2.0**-zeros
        # Densities b (1 - x)^(b - 1) at both sets, integrated over the group by Simpson's rule, times the cell's width.
        at = [(1 - x) ** (ba + bb - 2) for x in (lo, (lo + hi) / 2, min(hi, 1 - 1e-12))]
        total += ba * bb * (hi - lo) / 6 * (at[0] + 4 * at[1] + at[2]) * (hi - lo) / 2**MANTISSA
    return np.minimum(total, 0.5)


def _estimate(threshold: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _sliced(batches):
            a = np.frombuffer(b"".join(pdf["regs_a"]), np.uint16).reshape(-1, REGISTERS)
            b = np.frombuffer(b"".join(pdf["regs_b"]), np.uint16).reshape(-1, REGISTERS)
            na, nb = pdf["n_a"].to_numpy(), pdf["n_b"].to_numpy()
            by_chance = chance(na, nb)
            estimate = ((a == b).mean(1) - by_chance) / (1 - by_chance)
            t = threshold / 100
            # A short set fills few buckets of its own, and the others repeat those.
            sd = np.sqrt(t * (1 - t) / np.minimum(REGISTERS, np.minimum(na, nb)))
            possible = 100 * np.minimum(na, nb) >= threshold * np.maximum(na, nb)
            yield pdf.loc[possible & (estimate >= t - MARGIN * sd), ["a", "b"]]

    return run


def _confirm(k: int, threshold: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, of_last = None, None
        for pdf in _sliced(batches):
            keep = []
            for a, ta, tb in zip(pdf["a"], pdf["text_a"], pdf["text_b"]):
                if a != last:
                    last, of_last = a, shingles(ta, k)
                other = shingles(tb, k)
                both = len(np.intersect1d(of_last, other, assume_unique=True))
                keep.append(100 * both >= threshold * (len(of_last) + len(other) - both))
            yield pdf.loc[keep, ["a", "b"]]

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node that can be reached.

    Large-star and small-star steps in turn, until the edges point from each node to its component. A step's table goes when
    the next one is written.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "near-edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(lows.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        large = stored(large, "near-large")
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lows.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = stored(small, "near-small")
        removed(edges, large)
        edges = now
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        mark = seen
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _texts_of(nodes: DataFrame, lead: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of some nodes, stored. How many there are has no bound that is known before, so they are never broadcast."""
    wanted = lead.join(nodes, "node", "left_semi").select("node", "doc_id", "spot")
    found = keyed(docs).hint("merge").join(wanted, ["doc_id", "spot"])
    return stored(found.groupBy("doc_id", "spot").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text"), "near-texts")


def _links(pairs: DataFrame, lead: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs of nodes (a, b) that are links: estimated, then confirmed on the full sets."""
    regs = lambda x: lead.select(F.col("node").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("parity").alias(f"parity_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    near = pairs.join(regs("a"), "a").join(regs("b"), "b").filter(may_link("parity_a", "parity_b", "n_a", "n_b", threshold))
    near = near.select("a", "b", "regs_a", "regs_b", "n_a", "n_b")
    close = stored(near.mapInPandas(_estimate(threshold), "a long, b long"), "near-close")
    text = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    full = close.hint("merge").join(text("b"), "b").hint("merge").join(text("a"), "a")
    out = stored(full.select("a", "b", "text_a", "text_b").mapInPandas(_confirm(k, threshold), "a long, b long"), "near-links")
    removed(close)
    return out


def _shingle_rows(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _sliced(batches):
            sets = [shingles(t, k).view(np.int64) for t in pdf["text"]]
            if sets:
                yield pd.DataFrame({"node": np.repeat(pdf["node"].to_numpy(), [len(x) for x in sets]), "shingle": np.concatenate(sets)})

    return run


def _prefixes(texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """(node, shingle, n, at, short), stored: the shared shingles of each prefix; short: it is in the short one too."""
    rows = stored(texts.mapInPandas(_shingle_rows(k), "node long, shingle long"), "near-shingles")
    # The order: rarest first; a shingle of one document only can't be shared, but counts in its prefix.
    often = stored(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "near-often")
    by = Window.partitionBy("node")
    n, at = F.col("n"), F.col("at")
    placed = rows.join(often, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    placed = placed.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("at", F.row_number().over(by.orderBy("df", "shingle")))
    # ceil(t * n) and ceil(2 t / (1 + t) * n), in whole numbers.
    least, alone = F.expr(f"({threshold} * n + 99) div 100"), F.expr(f"({2 * threshold} * n + {99 + threshold}) div {100 + threshold}")
    placed = placed.filter((F.col("df") > 1) & (at <= n - least + 1)).select("node", "shingle", "n", "at", (at <= n - alone + 1).alias("short"))
    out = stored(placed, "near-prefixes")
    removed(rows, often)
    return out


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (node, component) after links (a, b), stored."""
    of = lambda x: comp.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    to = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    to = to.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return stored(comp.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "near-members")


def _enough(x: str, y: str, threshold: int) -> Column:
    """Whether two sets that meet at a shingle of their prefixes can share enough. What they share is that shingle and what follows it, if it is their
    first; a later one says less.
    """
    shared = 1 + F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at"))
    return shared * (100 + threshold) >= threshold * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _by_prefix(here: DataFrame, lead: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """All further links (a, b) that bring together components among the members (key, node, component) of places; exact.

    First, in rounds, the members of each shingle of a prefix are held against one of them, which brings most components
    together in linear work; in the first round that is the one in whose order the shingle comes first. What is then left apart is joined in full; one side of that join is of the nodes outside their place's
    largest component, as each pair of different components has one.
    """
    comp = stored(here.select("node", "component").distinct(), "near-members")
    own = stored(texts.join(comp.select("node"), "node", "left_semi"), "near-texts")
    placed = _prefixes(own, k, threshold)
    links = None
    for turn in range(ROUNDS):
        live = stored(placed.select("node", "shingle", "n", "at").join(comp, "node"), "near-live")
        first = F.xxhash64("node", "shingle", F.lit(turn))
        pivot = F.max_by(F.struct("node", "component", "n", "at"), F.struct(-F.col("at"), first) if turn == 0 else first).alias("p")
        groups = stored(live.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), pivot).filter("lo <> hi").select("shingle", "p"), "near-pivots")
        alike = (100 * F.col("p.n") >= threshold * F.col("n")) & (100 * F.col("n") >= threshold * F.col("p.n"))
        tried = live.alias("m").join(groups, "shingle").filter((F.col("component") != F.col("p.component")) & alike & _enough("m", "p", threshold))
        tried = stored(tried.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct(), "near-tried")
        found = _links(tried, lead, own, k, threshold)
        n_found, n_tried = found.count(), tried.count()
        removed(live, groups, tried)
        links = found if links is None else links.union(found)
        if n_found:
            comp = _merged(comp, found)
        if n_found * FRUITFUL < n_tried or not n_tried:
            break
    here = stored(here.select("key", "node").join(comp, "node"), "near-here")
    counts = here.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    most = stored(counts.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("most")), "near-most")
    rest = stored(here.join(most, "key").filter("component <> most").select("node").distinct(), "near-rest")
    of = comp.join(rest.withColumn("odd", F.lit(True)), "node", "left").withColumn("odd", F.coalesce("odd", F.lit(False)))
    full = stored(placed.join(of.join(lead.select("node", "parity"), "node"), "node"), "near-prefixes")
    met = None
    for odd_side in ("x", "y"):
        # x: the larger set with its long prefix; y: the smaller one with its short prefix.
        x, y = full, full.filter("short")
        x, y = (x.filter("odd"), y) if odd_side == "x" else (x, y.filter("odd"))
        x, y = x.alias("x"), y.alias("y")
        alike = (F.col("y.n") <= F.col("x.n")) & (100 * F.col("y.n") >= threshold * F.col("x.n"))
        possible = alike & _enough("x", "y", threshold) & may_link("x.parity", "y.parity", "x.n", "y.n", threshold)
        pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component")) & possible)
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        met = pairs if met is None else met.union(pairs)
    met = stored(met.distinct(), "near-met")
    out = links.union(_links(met, lead, own, k, threshold))
    removed(own, placed, here, most, rest, full, met)
    return out


def near_table(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * the intersection of their sets is at least threshold * the union.
    """
    sig = stored(signatures(docs, shingle), "near-signatures")
    known = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # A node stands for all rows with its set; rep is the smallest id that has it.
    sets = stored(known.groupBy("digest").agg(F.min("node").alias("node"), F.min("doc_id").alias("rep"), F.max("doc_id").alias("high")), "near-sets")
    lead = stored(known.join(sets.select("node", "rep"), "node").select("node", "rep", "doc_id", "spot", "n_shingles", "regs", "parity"), "near-leads")
    equal = known.join(sets.filter("rep <> high").select("digest", "rep"), "digest").filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    places = lead.select("node", F.explode(bands("regs")).alias("key"))
    low = stored(places.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).filter("n > 1").select("key", "low"), "near-places")
    # All members of a place but its first one.
    many = stored(places.join(low, "key").filter("node <> low"), "near-places")
    pairs = stored(many.select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    # The texts of all that share a place, dealt once for all that follows.
    texts = _texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), lead, docs)
    links = _links(pairs, lead, texts, shingle, threshold)
    at = stored(components(links), "near-nodes")
    here = stored(many.join(at, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "near-here")
    several = stored(here.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key"), "near-several")
    mixed_ = stored(here.join(several, "key", "left_semi"), "near-mixed")
    removed(low, many, pairs, here, several)
    links = links.union(_by_prefix(mixed_, lead, texts, shingle, threshold))
    rep = lambda x: lead.select(F.col("node").alias(x), F.col("rep").alias(f"rep_{x}"))
    links = links.join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    found = stored(components(equal.union(links)), "near-components")
    removed(sets, lead, at, mixed_, texts)
    out = sig.join(found, sig["doc_id"] == found["node"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def dedup_documents(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs that stand first in their component, with all columns; of equal rows, one stays."""
    table = near_table(docs, shingle, threshold)
    gone, once = fresh(docs, "gone", "once")
    own = docs["doc_id"].cast("long")
    # Neither side has a bound, so rows meet by a shuffle at any size.
    out = stored(table.filter("NOT kept").select(F.col("doc_id").alias(gone)).distinct(), "near-gone")
    left = docs.hint("merge").join(out, own == F.col(gone), "left_anti")
    # Ids that several rows share, if there are any; only their rows are compared whole.
    ids = stored(table.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias(once)), "near-again")
    if ids.isEmpty():
        return left
    return left.join(ids, own == F.col(once), "left_anti").unionByName(left.join(ids, own == F.col(once), "left_semi").dropDuplicates())
