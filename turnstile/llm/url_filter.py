"""URL filters: rules first, then a ratio of two character models (operator 3).

A rule is a host and a path prefix; it fits the host, all its subdomains and paths that begin with the
prefix, and the longest one that fits decides. For urls without a rule, two character models, of the urls that rules allow
and of those they block, are compared: variable-order Markov models (up to ORDER characters of context) in which each order
is interpolated with the next lower one by Witten-Bell weights, down to a uniform distribution. The mean
log-likelihood difference per character is held against a threshold that is calibrated on a fifth of the
labelled urls, which the models do not see, as the least sum of both error rates.

The alphabet has ALPHABET classes (letters, one for all digits, common punctuation, the rest), so a model has at most
ALPHABET ** (ORDER + 1) entries, 2.8 million, at any size of input; that bounds what is collected and broadcast.

Cases: a null url counts as an empty one. A url without "://" has an empty host and path and no rule; the models judge it by its
characters like any other. Where one of the two classes has no labelled url, urls without a rule are allowed. Repeated urls count as often as they occur. Only page_id and url are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Production rules: host, path prefix, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER = 3
#: Fixed classes: 0 is an end of the url, then letters, digits, punctuation, and the rest.
PUNCTUATION = "/.-_?=&#:%+~"
ALPHABET = 1 + 26 + 1 + len(PUNCTUATION) + 1
SIZE = ALPHABET ** (ORDER + 1)
FOLDS = 5
#: Bins of the calibration histogram, and their width in nats per character.
BINS, WIDTH = 4000, 0.005


def classes() -> np.ndarray:
    table = np.full(256, ALPHABET - 1, np.int64)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = 1 + i
    table[ord("0") : ord("9") + 1] = 27
    for i, c in enumerate(PUNCTUATION):
        table[ord(c)] = 28 + i
    return table


TABLE = classes()


def codes(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each character of each url and its end, context and character as one number; and the number of these per url."""
    data = [u.encode() for u in urls]
    lengths = np.array([len(d) for d in data], dtype=np.int64)
    pad = b"\0" * ORDER
    flat = np.frombuffer(pad + b"".join(d + b"\0" + pad for d in data), np.uint8)
    c = np.where(flat == 0, 0, TABLE[flat])
    out = np.zeros(len(c) - ORDER, np.int64)
    for k in range(ORDER + 1):
        out = out * ALPHABET + c[k : k + len(out)]
    keep = np.zeros(len(out), bool)
    starts = np.cumsum(lengths + 1 + ORDER) - (lengths + 1 + ORDER)
    total = lengths + 1
    keep[np.repeat(starts - (np.cumsum(total) - total), total) + np.arange(total.sum())] = True
    return out[keep], total


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruled (its verdict); among rules of one length, the longer host decides, then block."""
    url = F.col("url")
    host, path = parts(url)
    df = pages.select(F.col("page_id"), url).select("page_id", "url", host.alias("host"), path.alias("path"))
    found = []
    for h, p, verdict in rules:
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        found.append(F.when(fits, F.struct(F.lit(len(h + p)).alias("n"), F.lit(len(h)).alias("hosts"), F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))))
    best = F.array_max(F.array(*found))
    return df.select("*", best.alias("_best")).select("page_id", "url", "host", "path", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("ruled"))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((2, SIZE), np.int64)
    for pdf in batches:
        for label in (0, 1):
            urls = pdf.loc[pdf["label"] == label, "url"].tolist()
            if urls:
                code, n = np.unique(codes(urls)[0], return_counts=True)
                total[label, code] += n
    for label in (0, 1):
        code = np.flatnonzero(total[label])
        if len(code):
            yield pd.DataFrame({"label": np.full(len(code), label, np.int32), "code": code, "n": total[label, code]})


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """counts over (context, character) to log p(character | context), smoothed from order 0 up."""
    p = np.full(ALPHABET, 1.0 / ALPHABET)
    for order in range(ORDER + 1):
        n = counts.reshape(-1, ALPHABET ** (order + 1)).sum(0).reshape(-1, ALPHABET)
        total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        lower = np.tile(p.reshape(-1, ALPHABET), (len(n) // max(1, p.size // ALPHABET), 1))
        with np.errstate(invalid="ignore", divide="ignore"):
            p = np.where(total > 0, (n + kinds * lower) / (total + kinds), lower)
    return np.log(p).reshape(-1)


def model(labelled: DataFrame) -> np.ndarray | None:
    """The table of log-likelihood differences, from labelled (url, label: 1 allowed, 0 blocked)."""
    counts = labelled.mapInPandas(_counts, "label int, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros((2, SIZE), np.float64)
    dense[counts["label"].to_numpy(dtype=np.int64), counts["code"].to_numpy(dtype=np.int64)] = counts["n"]
    if not dense.any(1).all():
        return None
    return (log_probabilities(dense[1]) - log_probabilities(dense[0])).astype(np.float32)


def scorer(spark, table: np.ndarray):
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("double")
    def score(urls: pd.Series) -> pd.Series:
        code, total = codes([u or "" for u in urls])
        sums = np.add.reduceat(shared.value[code].astype(np.float64), np.cumsum(total) - total) if len(total) else np.empty(0)
        return pd.Series(sums / total)

    return score


def calibrated(scores: DataFrame) -> float:
    """The threshold with the least sum of error rates, from labelled (score, label); the middle of the best ones."""
    bin_ = F.least(F.greatest(F.floor(F.col("score") / WIDTH) + BINS // 2, F.lit(0)), F.lit(BINS - 1)).cast("int")
    rows = scores.groupBy("label", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    n = np.zeros((2, BINS))
    for r in rows:
        n[r["label"], r["bin"]] = r["n"]
    if not n.any(1).all():
        return 0.0
    share = n / n.sum(1, keepdims=True)
    wrong = np.concatenate(([0.0], np.cumsum(share[1]))) + np.concatenate((np.cumsum(share[0][::-1])[::-1], [0.0]))
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float((best[len(best) // 2] - BINS // 2) * WIDTH)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (mean log-likelihood difference), threshold."""
    spark = pages.sparkSession
    df = ruled(pages, rules)
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS))
    labelled = df.filter("ruled IS NOT NULL").select("url", (F.col("ruled") == "allow").cast("int").alias("label"), fold.alias("fold"))
    table = model(labelled.filter("fold <> 0").select("url", "label"))
    if table is None:
        return df.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("threshold"))
    score = scorer(spark, table)
    threshold = calibrated(labelled.filter("fold = 0").select("label", score("url").alias("score")))
    out = df.withColumn("score", score("url"))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(threshold).alias("threshold"))
