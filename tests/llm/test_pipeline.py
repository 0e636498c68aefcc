"""The whole pipeline against a plain version of its five stages."""

from collections import Counter

import numpy as np
import pandas as pd
from test_operators import components_of, counts_of
from test_plain_versions import plain_mcd

from turnstile.llm import quality_mcd, sentence_spans
from turnstile.llm.registry import ORACLES
from turnstile.llm.vocabulary import piece_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 10))))
    text = lambda n: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(n))
    rows = [(i, text(int(rng.integers(60, 200)))) for i in range(160)]
    passages = [text(70) for _ in range(6)]
    rows += [(200 + i, f"{text(30)} {passages[i % 6]} {text(30)}") for i in range(24)]
    for i in range(20):
        words = rows[i][1].split()
        words[int(rng.integers(len(words)))] = "edited"
        rows.append((300 + i, " ".join(words)))
    rows += [(400 + i, " ".join(word() + "|#" for _ in range(80))) for i in range(6)]
    rows += [(500, None), (501, ""), (502, "few words"), (503, text(30) + " " + "same words go on again and again here " * 20), (5, rows[5][1]), (None, text(80))]
    return [(d, t, "en" if (d or 0) % 2 else "fr", f"s{(d or 0) % 2}", len(t or "")) for d, t in rows]


def kept_by_quality(rows):
    stats = [counts_of(t) for _, t, *_ in rows]
    fine = [n >= 20 and 100 * repeats <= 30 * n for n, _, _, _, repeats in stats]
    out = []
    for lang in ("en", "fr"):
        at = [i for i, r in enumerate(rows) if r[2] == lang and fine[i]]
        assert len(at) >= quality_mcd.MIN_GROUP
        lines = [max(1, len([x for x in rows[i][1].split("\n") if x.split()])) for i in at]
        x = np.array([[np.log(c / n), np.sqrt(s / n), np.sqrt(d / m), np.sqrt(r / n)] for (n, c, s, d, r), m in zip([stats[i] for i in at], lines)])
        out += [rows[i] for i, d2 in zip(at, plain_mcd(x)) if d2 <= quality_mcd.CUTOFF]
    return out


def kept_by_near(rows):
    first = components_of(rows, 5, 80)
    return list(dict.fromkeys(r for r in rows if r[0] is None or first[r[0]] == r[0]))


def without_repeats(rows):
    size, least = sentence_spans.MIN_WORDS, sentence_spans.MIN_SENTENCES
    assert least == 2
    cuts, where = {}, {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        tokens, ends, upto, h = sentence_spans.cut(r[1])
        at, words, spans = sorted(set(upto.tolist())), h.tolist(), set()
        for k in range(len(at) - 1):
            end = max(at[k] + size, at[min(k + 1, len(at) - 2)] + 1)
            begin = min(at[k + 1] - size, at[k] - 1)
            spans |= {(at[k], end)} if end <= len(words) else set()
            spans |= {(begin, at[k + 1])} if begin >= 0 else set()
        cuts[r] = tokens, ends, upto, words, sorted(spans)
        for i, j in cuts[r][-1]:
            where.setdefault(tuple(words[i:j]), r)
    out = []
    for r in rows:
        tokens, ends, upto, words, spans = cuts[r]
        gone, kept_to = np.zeros(len(words), bool), {}
        for i, j in spans:
            key = tuple(words[i:j])
            if where[key] is not r or i >= kept_to.setdefault(key, j):
                gone[i:j] = True
        text, before = "", 0
        for k, end in enumerate(ends.tolist()):
            a, b = upto[k], upto[k + 1]
            if a == b:
                a, b = max(a - 1, 0), min(b + 1, len(words))
            text += "" if gone[a:b].all() and a < b else "".join(tokens[before:end])
            before = end
        if text.strip() or not (r[1] or "").strip():
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def mixed(rows):
    import duckdb

    documents = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})  # noqa: F841
    times = {d: taken // size for d, size, _, _, taken in duckdb.sql(ORACLES["op9_mix_sources"]).fetchall()}
    return [r for r in rows for _ in range(times[r[0]])]


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline

    rows = corpus()
    left = [rows]
    for stage in (kept_by_quality, kept_by_near, without_repeats, mixed):
        left.append(stage(left[-1]))
    sizes = [len(x) for x in left]
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 100 and any(a[1] not in {r[1] for r in left[2]} for a in left[3])
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    want = Counter((d, tuple([*sp.encode(t), sp.eos_id()])) for d, t, *_ in left[-1])
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_pipeline_of_no_rows_and_of_other_columns(spark, tmp_path):
    import corpus_pipeline

    for n, name in ((0, "none"), (90, "some")):
        rows = [(*r, "x", "y") for r in corpus()[:n]]
        spark.createDataFrame(rows, SCHEMA + ", ROW string, _copies string").write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "ids", "begins", "ends"] and (out.count() > 0) == (n > 0)
