"""Quality rules: robust multivariate outliers (operator 4), DataFrame functions only.

Every text gets counts from its whole words and lines. Texts that fail two plain rules go;
the others are judged by a minimum-covariance-determinant estimate of four transformed
statistics, one estimate per language and source, and rejected where their squared
Mahalanobis distance is too large.

Cases: a null or empty text has no words, fails the base rules and is not kept. Null languages
and sources are groups of their own. A group with fewer than ``min_group`` usable rows is pooled
with the other small groups of its language, and what is still too small with the rest; if the
last pool is too small as well, its rows are kept. Repeated rows and ties count as rows of their
own: rows at the same distance are in or out of an estimate together. Extra columns pass through
``filter_documents`` untouched, whatever their names, as a row travels as one value.

States, cuts and pools are one row a group and written first, so that Spark knows their size: rows never meet them in one task
by a hot group, but by a broadcast where they are small, and else by a join whose large partitions it splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, removed, stored, text_of, unpacked, whole_row, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Natural-log units or roots of shares; the floor keeps an estimate regular where nearly all rows share a value. A
#: statistic of less spread than its floor is not regular: the floor alone says how far from the others a row may be.
FLOORS = (0.01, 0.05, 0.075, 0.10)
DIM = len(FLOORS)
#: Share of a group that an estimate rests on, squared distance that is too far (the 0.9999 quantile of chi-square with DIM
#: degrees of freedom), smallest group.
COVER, CUTOFF, MIN_GROUP = 0.75, 23.513, 50
#: A group's steps go on while its determinant falls by more than this share of it; the ridge bounds it from below, so they end.
STILL = 1e-3
#: Medians of the chi-square distributions with 1 to DIM degrees of freedom, one for each regular statistic of a group.
#: CUTOFF is the stated quantile where all are regular, and a higher one where fewer are.
CHI2_MEDIANS = (0.4549, 1.3863, 2.3660, 3.3567)
#: A floor at most doubles a regular variance, so no scale is less; where it would be, half of the rows are ties.
LEAST_SCALE = 0.5
#: Distances are ranked by bins of a 32nd of a doubling, so that a rank is an exact count on any layout.
BINS = 32


def _places(windows: Column) -> Column:
    """The windows' whole hashes with their places from 1, sorted, so that equal windows are side by side."""
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("hash"), (i + 1).alias("at"))))


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the counts of every row; no shuffle."""
    df = docs.select(*keep, text_of(F.col("text")).alias("_text"))
    df = df.select(*keep, "_text", words_of(F.col("_text")).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    at = lambda i: F.xxhash64(*[F.element_at("_hashes", (i + k).cast("int")) for k in range(WINDOW)])
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1).cast("long"), F.col("n_words") - (WINDOW - 1)), at)).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*keep, "n_words", "word_chars", "n_symbols", F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), windows.alias("_windows"))
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.select(*keep, *counts, F.when(repeats, _places(F.col("_windows"))).alias("_places"))
    near = lambda i, d: F.get("_places", (i + d).cast("int"))["hash"]
    same = F.filter("_places", lambda x, i: F.coalesce(near(i, -1) == x["hash"], F.lit(False)) | F.coalesce(near(i, 1) == x["hash"], F.lit(False)))
    df = df.select(*keep, *counts, F.sort_array(F.transform(same, lambda x: x["at"])).alias("_starts"))
    covered = F.aggregate(
        F.transform("_starts", lambda p, i: F.least(F.lit(WINDOW).cast("long"), F.coalesce((F.get("_starts", (i + 1).cast("int")) - p).cast("long"), F.lit(WINDOW).cast("long")))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    df = df.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _vector() -> list[Column]:
    """Mean word length, and roots of the shares of symbols, repeated lines and repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def _with_distance(df: DataFrame, state: DataFrame) -> DataFrame:
    """Adds d2, from each group's centre and the Cholesky factor of its covariance."""
    df = df.join(state, "_group")
    y: list[Column] = []
    for i in range(DIM):
        rest = F.col(f"_x{i}") - F.col(f"_m{i}")
        for j in range(i):
            rest = rest - F.col(f"_l{i}{j}") * F.col(f"_y{j}")
        df = df.withColumn(f"_y{i}", rest / F.col(f"_l{i}{i}"))
        y.append(F.col(f"_y{i}") * F.col(f"_y{i}"))
    d2 = y[0]
    for part in y[1:]:
        d2 = d2 + part
    return df.withColumn("_d2", d2).drop(*[f"_y{i}" for i in range(DIM)], *[c for c in state.columns if c != "_group"])


def _cholesky(state: DataFrame) -> DataFrame:
    """``_m*`` and ``_c*`` (the lower half of a covariance) to ``_m*``, ``_l*`` and the number of regular statistics."""
    regular = [F.when(F.col(f"_c{i}{i}") > FLOORS[i] ** 2, 1).otherwise(0) for i in range(DIM)]
    state = state.withColumn("_dof", regular[0] + regular[1] + regular[2] + regular[3])
    for i in range(DIM):
        for j in range(i + 1):
            rest = F.col(f"_c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            state = state.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"_l{j}{j}"))
    return state.drop(*[f"_c{i}{j}" for i in range(DIM) for j in range(i + 1)])


def _log_det() -> Column:
    """Half the logarithm of a covariance's determinant, from its Cholesky factor."""
    total = F.lit(0.0)
    for i in range(DIM):
        total = total + F.log(F.col(f"_l{i}{i}"))
    return total


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 2.0**-20) * BINS).cast("int")


def _cuts(df: DataFrame, shares: dict[str, float]) -> DataFrame:
    """For each group and name, the first bin at which that share of its rows is reached."""
    counts = df.groupBy("_group", _bin(F.col("_d2")).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy("_group")
    counts = counts.withColumn("_sum", F.sum("_n").over(by.orderBy("_bin"))).withColumn("_all", F.sum("_n").over(by))
    return counts.groupBy("_group").agg(*[F.min(F.when(F.col("_sum") >= F.ceil(F.col("_all") * share), F.col("_bin"))).alias(name) for name, share in shares.items()])


def _moments(df: DataFrame) -> DataFrame:
    aggs = [F.avg(f"_x{i}").alias(f"_m{i}") for i in range(DIM)]
    aggs += [F.covar_pop(f"_x{i}", f"_x{j}").alias(f"_c{i}{j}") for i in range(DIM) for j in range(i + 1)]
    return df.groupBy("_group").agg(*aggs)


def judged(stats: DataFrame, lang: str = "lang", source: str = "source", cover: float = COVER, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """stats (a stored table) with ``distance2`` (null where no estimate was made) and ``kept``."""
    usable = stats.filter(~F.col("base_failed"))
    label = lambda c: F.concat(F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce(F.col(c).cast("string"), F.lit("")))
    own = F.concat_ws("\u0001", label(lang), label(source))
    pools = usable.groupBy(own.alias("_own"), label(lang).alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    pools = pools.withColumn("_key", F.when(F.col("_n") >= min_group, F.col("_own")).otherwise(F.col("_lang")))
    pools = pools.join(pools.groupBy("_key").agg(F.sum("_n").alias("_total")), "_key")
    pools = pools.select("_own", F.when(F.col("_total") >= min_group, F.col("_key")).otherwise(F.lit("rest")).alias("_group"))
    pools = stored(pools, "quality-groups")
    x = usable.withColumn("_own", own).join(pools, "_own").select("_group", *[c.alias(f"_x{i}") for i, c in enumerate(_vector())])
    x = stored(x, "quality-vectors")
    # The start: medians and median absolute deviations of each statistic, on a grid of exact counts.
    grid = [F.floor(F.col(f"_x{i}") * 256).cast("int").alias(f"_g{i}") for i in range(DIM)]
    state = None
    for i in range(DIM):
        by = Window.partitionBy("_group")
        count = x.select("_group", grid[i]).groupBy("_group", f"_g{i}").agg(F.count(F.lit(1)).alias("_n"))
        count = count.withColumn("_all", F.sum("_n").over(by)).withColumn("_med", F.min(F.when(F.sum("_n").over(by.orderBy(f"_g{i}")) * 2 >= F.sum("_n").over(by), F.col(f"_g{i}"))).over(by))
        away = count.groupBy("_group", "_all", "_med", F.abs(F.col(f"_g{i}") - F.col("_med")).alias("_away")).agg(F.sum("_n").alias("_n"))
        away = away.withColumn("_sum", F.sum("_n").over(by.orderBy("_away")))
        part = away.groupBy("_group").agg(
            (F.first("_med") / 256.0).alias(f"_m{i}"),
            F.pow(F.min(F.when(F.col("_sum") * 2 >= F.col("_all"), F.col("_away"))) / 256.0 * 1.4826, F.lit(2.0)).alias(f"_c{i}{i}"),
        )
        state = part if state is None else state.join(part, "_group")
    for i in range(DIM):
        for j in range(i):
            state = state.withColumn(f"_c{i}{j}", F.lit(0.0))
    state = stored(_cholesky(state).withColumn("_open", F.lit(True)), "quality-start")
    # Concentration: the mean and covariance of the closest rows lower the determinant step by step. A group is done with the first
    # step that does not, and is left alone from then on.
    while not state.filter("_open").isEmpty():
        going = state.filter("_open")
        far = _with_distance(x, going)
        cut = stored(_cuts(far, {"_cut": cover}), "quality-cut")
        close = far.join(cut, "_group").filter(_bin(F.col("_d2")) <= F.col("_cut"))
        stepped = _cholesky(_moments(close)).join(going.select("_group", _log_det().alias("_was")), "_group")
        stepped = stepped.withColumn("_open", _log_det() < F.col("_was") + math.log1p(-STILL)).drop("_was")
        last, state = state, stored(state.filter("NOT _open").unionByName(stepped), "quality-step")
        removed(last, cut)
    ended = state
    state = state.drop("_open")
    # Distances are scaled so that their median is that of a normal sample in the regular statistics.
    far = _with_distance(x, state)
    half = F.pow(F.lit(2.0), (F.col("_half") + 0.5) / BINS)
    median = F.element_at(F.array(*[F.lit(m) for m in CHI2_MEDIANS]), F.greatest(F.col("_dof"), F.lit(1)))
    scale = F.when(F.col("_dof") == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(LEAST_SCALE), half / median))
    half_way = stored(_cuts(far, {"_half": 0.5}), "quality-half")
    scale = half_way.join(state.select("_group", "_dof"), "_group").select("_group", scale.alias("_scale"))
    sizes = x.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    model = pools.join(state.drop("_dof").join(scale, "_group").join(sizes, "_group"), "_group")
    model = stored(model.withColumn("_scale2", F.col("_scale")).drop("_scale"), "quality-model")
    removed(half_way, ended, x, pools)
    out = stats.withColumn("_own", F.when(~F.col("base_failed"), own)).join(model, "_own", "left")
    for i, c in enumerate(_vector()):
        out = out.withColumn(f"_x{i}", c)
    d2 = F.lit(0.0)
    for i in range(DIM):
        rest = F.col(f"_x{i}") - F.col(f"_m{i}")
        for j in range(i):
            rest = rest - F.col(f"_l{i}{j}") * F.col(f"_y{j}")
        out = out.withColumn(f"_y{i}", rest / F.col(f"_l{i}{i}"))
        d2 = d2 + F.col(f"_y{i}") * F.col(f"_y{i}")
    out = out.withColumn("distance2", F.when(F.col("_rows") >= min_group, d2 / F.col("_scale2")))
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True)))
    return out.select(*stats.columns, "distance2", "kept")


def judge_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, lang, source, the counts, base_failed, distance2, kept."""
    return judged(stored(statistics(docs, ["doc_id", "lang", "source"]), "quality-counts"), **options)


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    rows = docs.select("lang", "source", "text", whole_row(docs).alias("row"))
    stats = stored(statistics(rows, ["lang", "source", "row"]), "quality-counts")
    return unpacked(judged(stats, **options).filter("kept"), "row", docs.columns)
