"""Near-duplicates in one large group: copies of one text, edited at so many places that few of them are links."""

import numpy as np
from test_operators import components_of

from turnstile.llm import near_dedup


def copies(n):
    """n copies of a text of 150 words, each with new words at two to eight places."""
    rng = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(n):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(2, 9)), replace=False):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))
    return rows


def test_pairs_of_a_group_do_not_grow_with_its_square(spark, monkeypatch):
    made, stored = [0], near_dedup.stored

    def counted(df, name):
        out = stored(df, name)
        made[-1] += out.count() if name in ("near-tried", "near-met") else 0
        return out

    monkeypatch.setattr(near_dedup, "stored", counted)
    for n in (250, 500):
        made.append(0)
        rows = copies(n)
        out = near_dedup.near_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5, 80).collect()
        assert {r["doc_id"]: r["component_id"] for r in out} == components_of(rows, 5, 80)
    assert made[1] <= 2 * 250 and made[2] <= 2 * 500


def test_bitmaps_differ_in_no_more_bits_than_sets(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in (1, 2, 5, 40, 150, 3000):
        for changed in (0, 1, 2, n // 20, n // 9, n // 7, n // 3, n):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
            both = len(np.intersect1d(a, b))
            pa, pb = near_dedup.parity(a), near_dedup.parity(b)
            differ = sum(int(x).bit_count() for x in (pa ^ pb).view(np.uint64))
            assert differ <= len(a) + len(b) - 2 * both
            rows.append((len(rows), pa.tolist(), pb.tolist(), len(a), len(b), both, differ))
    df = spark.createDataFrame(rows, "i long, pa array<long>, pb array<long>, na long, nb long, both long, differ long")
    for t in (50, 80, 85, 100):
        out = df.withColumn("may", near_dedup.may_link("pa", "pb", "na", "nb", t)).collect()
        link = [100 * r["both"] >= t * (r["na"] + r["nb"] - r["both"]) for r in out]
        assert any(link) and not all(r["may"] for r in out)
        assert all(r["may"] for r, x in zip(out, link) if x)
        assert all(r["may"] == (r["differ"] * (100 + t) <= (100 - t) * (r["na"] + r["nb"])) for r in out)
