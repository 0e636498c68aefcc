"""Operators against plain Python versions, beyond old limits, and with columns of any name."""

import itertools
import math
import time
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnstile.llm import addressable_codes, katz_lm, mix_sources, near_dedup, order_minhash, pieces, quality_mcd, sentence_spans, transcripts, url_filter
from turnstile.llm.common import fresh
from turnstile.llm.vocabulary import piece_model, word_model

M32 = 0xFFFFFFFF


def mix_in(h, k):
    k = k * 0xCC9E2D51 & M32
    k = (k << 15 | k >> 17) & M32
    h ^= k * 0x1B873593 & M32
    h = (h << 13 | h >> 19) & M32
    return (h * 5 + 0xE6546B64) & M32


def finish(h, n):
    h ^= n
    h = (h ^ h >> 16) * 0x85EBCA6B & M32
    h = (h ^ h >> 13) * 0xC2B2AE35 & M32
    return h ^ h >> 16


def spark_hash(*values):
    """Spark's hash(): Murmur3 of each value, seeded by the one before."""
    h = 42
    for kind, v in values:
        if kind == "int":
            h = finish(mix_in(h, v & M32), 4)
        elif kind == "long":
            h = finish(mix_in(mix_in(h, v & M32), v >> 32 & M32), 8)
        else:
            data = v.encode()
            whole = len(data) // 4 * 4
            for i in range(0, whole, 4):
                h = mix_in(h, int.from_bytes(data[i : i + 4], "little"))
            for b in data[whole:]:
                h = mix_in(h, b - 256 & M32 if b > 127 else b)
            h = finish(h, len(data))
    return h


def plain_signatures(text):
    words = [w[i : i + 16] for w in text.split() for i in range(0, len(w), 16)]
    if len(words) < 3:
        kmers = [spark_hash(("text", " ".join(words)))]
    else:
        kmers = [spark_hash(*[("text", x) for x in words[i : i + 3]]) for i in range(len(words) - 2)]
    seen, numbered = Counter(), []
    for place, k in enumerate(kmers):
        seen[k] += 1
        numbered.append((spark_hash(("long", k), ("int", seen[k])), place))
    out = []
    for j in range(order_minhash.SIGNATURES):
        begin = j << 27
        ranked = sorted(numbered, key=lambda x: ((x[0] - begin) % (1 << 32), x[1]))
        two = sorted((ranked * 2)[:2], key=lambda x: x[1]) if len(ranked) == 1 else sorted(ranked[:2], key=lambda x: x[1])
        h = spark_hash(("long", two[0][0]), ("long", two[1][0]))
        out.append(h - (1 << 32) if h >> 31 else h)
    return out


def test_2_signatures_are_those_of_the_plain_version(spark):
    rng = np.random.default_rng(2)
    texts = ["", "a", "a b", "a b c", "x y z " * 40, "é" * 50 + " ß \U0001f600 ok", "w" * 100]
    texts += [" ".join(f"w{int(i)}" for i in rng.integers(0, m, n)) for m, n in ((5, 60), (1000, 300), (30, 30), (10**6, 2000))]
    df = spark.createDataFrame(list(enumerate(texts)), "row int, text string").withColumn("c", F.lit("x"))
    got = {r["row"]: list(r["signatures"]) for r in order_minhash.signatures(df.repartition(2), ["row"], "text", "c").collect()}
    assert got == {i: plain_signatures(t) for i, t in enumerate(texts)}


def plain_model(urls):
    """log p(character | context) by Witten-Bell over dictionaries."""
    table, order, size = url_filter.classes(), url_filter.ORDER, url_filter.ALPHABET
    text = lambda u: [0] * order + [int(table[b]) for b in u.encode()] + [0]
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for u in urls:
        t = text(u)
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts[k][tuple(t[i - k : i])][t[i]] += 1

    def p(context, c):
        value = 1 / size
        for k in range(order + 1):
            seen = counts[k].get(tuple(context[order - k :]))
            if seen:
                n, kinds = sum(seen.values()), len(seen)
                value = (seen[c] + kinds * value) / (n + kinds)
        return value

    def score(u):
        t = text(u)
        return [math.log(p(t[i - order : i], t[i])) for i in range(order, len(t))]

    return score


def test_3_scores_and_verdicts_are_those_of_the_plain_version(spark):
    urls = [f"http://www.example.com/en/{'abc'[i % 3]}{i}" for i in range(40)] + [f"http://z{i}.site.net/fr/sale{i}?x=1" for i in range(40)]
    urls += ["w9.example.com/en/9", "file:///fr/x", "", None, "http://q.org/" + "y" * 50000, "http://shop.org/fr/sale7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    rows = url_filter.judge_urls(pages).collect()
    out = {r["page_id"]: r for r in rows}
    fold = {r["url"]: r["f"] for r in pages.select("url", F.pmod(F.xxhash64("url"), F.lit(url_filter.FOLDS)).alias("f")).collect()}
    models = [plain_model([u for i, u in enumerate(urls[:80]) if out[i]["verdict"] == v and fold[u]]) for v in ("allow", "block")]
    for i, u in enumerate(urls):
        a, b = (m(u or "") for m in models)
        want = (sum(a) - sum(b)) / len(a)
        assert abs(out[i]["score"] - want) < 1e-4
        if out[i]["rule"] is None:
            assert out[i]["verdict"] == ("allow" if out[i]["score"] >= out[i]["threshold"] else "block")
    assert out[80]["host"] == "" and {out[i]["verdict"] for i in range(40)} == {"allow"}


def plain_mcd(x, cover=quality_mcd.COVER):
    """distance2 of each row of one group, by the rule that the operator states."""
    n, dim = x.shape
    floors = np.array(quality_mcd.FLOORS)
    grid = np.floor(x * 256)
    half = lambda v: np.sort(v)[math.ceil(n / 2) - 1]
    med = np.array([half(grid[:, i]) for i in range(dim)])
    mad = np.array([half(np.abs(grid[:, i] - med[i])) for i in range(dim)])
    centre, cov = med / 256, np.diag((mad / 256 * 1.4826) ** 2)
    bins = lambda d: np.floor(np.log2(d + 2.0**-20) * quality_mcd.BINS)

    def distance(centre, cov):
        low = np.linalg.cholesky(cov + np.diag(floors**2))
        return (np.linalg.solve(low, (x - centre).T) ** 2).sum(0), np.log(np.diag(low)).sum()

    while True:
        d2, before = distance(centre, cov)
        b = bins(d2)
        close = x[b <= np.sort(b)[math.ceil(n * cover) - 1]]
        centre, cov = close.mean(0), np.cov(close.T, bias=True)
        if not distance(centre, cov)[1] < before + math.log1p(-quality_mcd.STILL):
            break
    d2, _ = distance(centre, cov)
    regular = int((np.diag(cov) > floors**2).sum())
    scale = 1.0 if not regular else max(quality_mcd.LEAST_SCALE, 2.0 ** ((np.sort(bins(d2))[math.ceil(n / 2) - 1] + 0.5) / quality_mcd.BINS) / quality_mcd.CHI2_MEDIANS[regular - 1])
    return d2 / scale


def test_4_distances_are_those_of_the_plain_version(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 12))))
    rows = []
    for i in range(240):
        lines = [" ".join(word() + ("#" if rng.random() < 0.02 * (i % 7) else "") for _ in range(8)) for _ in range(12)]
        lines += lines[: i % 5]
        rows.append((i, "\n".join(lines), "en" if i % 2 else "fr", None))
    out = sorted(quality_mcd.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect(), key=lambda r: r["doc_id"])
    for lang in ("en", "fr"):
        some = [r for r in out if r["lang"] == lang and not r["base_failed"]]
        assert len(some) > 60
        n_lines = {d: len(t.split("\n")) for d, t, *_ in rows}
        x = np.array([[math.log(r["word_chars"] / r["n_words"]), math.sqrt(r["n_symbols"] / r["n_words"]), math.sqrt(r["n_dup_lines"] / n_lines[r["doc_id"]]), math.sqrt(r["n_repeat_words"] / r["n_words"])] for r in some])
        want = plain_mcd(x)
        assert np.allclose([r["distance2"] for r in some], want, rtol=1e-6)
        assert [r["kept"] for r in some] == [bool(w <= quality_mcd.CUTOFF) for w in want]


def test_8_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(8)
    s = transcripts.STATES
    model = transcripts.Model(rng.random(s), rng.random((s, s)), [rng.random((s, v)) for v in transcripts.VALUES])
    for n in (1, 2, 4):
        f = np.stack([rng.integers(0, v, n) for v in transcripts.VALUES], axis=1)
        e = model.emission(f)
        score = lambda p: model.start[p[0]] + e[0, p[0]] + sum(model.moves[a, b] + e[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:])))  # noqa: B023,E731
        best = max(itertools.product(range(s), repeat=n), key=score)
        assert abs(score(best) - score(tuple(transcripts.viterbi(model, f).tolist()))) < 1e-9


def test_8_numbers_of_any_size_and_blanks_within(spark):
    rows = [(t, ("user", "assistant")[k % 2], f"what is {k}?" if k % 2 == 0 else f"it is {k}.") for k, t in enumerate([-(1 << 63), -5, 0, 7, 1 << 33, (1 << 63) - 1])]
    conv = spark.createDataFrame([(c, *r) for c in range(1, 9) for r in rows], "conv_id long, turn long, role string, text string")
    got = transcripts.parse_conversations(conv).filter("conv_id = 5").orderBy("turn_no").collect()
    assert [r["content"] for r in got] == [r[2] for r in rows]
    numbered = transcripts.lines_of(transcripts.raw_transcripts(conv))
    plain = numbered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "at", "line"))).alias("l")).select("conv_id", F.posexplode("l").alias("line_no", "l")).select("conv_id", F.col("line_no").cast("long").alias("line_no"), "l.line")
    model = transcripts.fit(transcripts.with_next(transcripts.raw_transcripts(conv)).select("conv_id", "turn", "role", "next_role", F.size("_l").alias("n"), F.posexplode("_l").alias("at", "line")))
    # The same lines numbered from 0, in one chunk and in several.
    one, many = (sorted((r["conv_id"], r["turn_no"], r["content"]) for r in transcripts.turns(transcripts.decode(plain, model, span)).collect()) for span in (1 << 20, 3))
    assert one == many and len(one) == 48
    wide = spark.createDataFrame([(1, 0, "user", "a" + " " * 48_000 + "b  "), (1, 1, "assistant", "c.")], "conv_id long, turn long, role string, text string")
    began = time.time()
    assert {len(r["content"]) for r in transcripts.parse_conversations(wide).collect()} >= {48_002}
    assert time.time() - began < 60


def test_8_long_turns_stay_apart_and_turns_may_repeat(spark):
    long = "\n" * (1 << 20) + "end of it"
    conv = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "right."), (2, 0, "user", "same?"), (2, 0, "user", "same?")], "conv_id long, turn long, role string, text string")
    lines = transcripts.lines_of(transcripts.raw_transcripts(conv))
    first, last = (lines.filter(f"turn = {t} AND conv_id = 1").agg(F.min(F.struct("line_no", "at")), F.max(F.struct("line_no", "at"))).first() for t in (0, 1))
    assert first[1] < last[0] and first[1]["at"] >= 1 << 20
    assert {(r["turn_no"], r["content"].strip()[-9:]) for r in transcripts.parse_conversations(conv.filter("conv_id = 1")).collect()} == {(1, "end of it"), (2, "right.")}
    assert transcripts.parse_conversations(conv.filter("conv_id = 2")).agg(F.sum(F.size(F.split("content", "same")) - 1)).first()[0] == 2


def test_8_chunks_are_cut_by_lines(spark):
    rng = np.random.default_rng(9)
    s = transcripts.STATES
    model = transcripts.Model(rng.random(s), rng.random((s, s)), [rng.random((s, v)) for v in transcripts.VALUES])
    line = lambda: str(rng.choice(["", "User: hi?", "A: yes.", "some words here", "###  User", "why not:", "x " * 15]))
    # Turns of one line and of hundreds, in one block of numbers; places that are null, and lines that share a place.
    sizes = {1: [3, 700, 1, 0, 90], 2: [2, 1, 4], 3: [40] * 70}
    rows = [(c, t, k, line()) for c, turns in sizes.items() for t, n in enumerate(turns) for k in range(n)] + [(2, 1, None, "A: first?"), (2, 1, 0, None), (2, None, 0, "b")]
    lines = spark.createDataFrame(rows, "conv_id long, line_no long, at int, line string").repartition(3)
    cut = transcripts._chunked(lines.selectExpr("conv_id AS _conv", "coalesce(line_no, 0) AS line_no", "coalesce(at, 0)::long AS at", "line"), 64, 16)
    assert cut.groupBy("_conv", "_chunk", "_piece").count().agg(F.max("count")).first()[0] <= 16
    found = transcripts.decode(lines, model, 64, 16).collect()
    assert len(found) == len(rows)
    for c in sizes:
        mine = sorted((r["line_no"], r["at"], r["line"] or "", r["state"], r["turn_no"]) for r in found if r["conv_id"] == c)
        assert [m[:3] for m in mine] == sorted((t or 0, k or 0, x or "") for i, t, k, x in rows if i == c)
        f = transcripts._featured(spark.createDataFrame([(i, m[2]) for i, m in enumerate(mine)], "i int, line string"), "i").orderBy("i").toPandas()[transcripts.FEATURES].to_numpy()
        e = model.emission(f)
        score = lambda p: model.start[p[0]] + e[0, p[0]] + sum(model.moves[a, b] + e[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:])))  # noqa: B023,E731
        path = [m[3] for m in mine]
        # Paths may tie; the one found is as good as the best over the whole transcript, and its turns are numbered without a gap.
        assert abs(score(path) - score(transcripts.viterbi(model, f).tolist())) < 1e-6
        assert [m[4] for m in mine] == np.cumsum(np.array(path) % 3 == transcripts.BEGIN).tolist()


def test_1_ids_beyond_32_bits(monkeypatch):
    rng = np.random.default_rng(1)
    wide = [np.array([0, 1 << 33, 5, (1 << 62) + 1]), rng.integers(0, 1 << 32, 50), np.empty(0, np.int64), np.arange(9)]
    assert all(np.array_equal(a, b) for a, b in zip(wide, katz_lm.unpack(katz_lm.pack(*wide))))

    def merged(far):
        rng = np.random.default_rng(2)
        rows = []
        for block in range(3):
            v, w = rng.integers(0, 6, 40) * far, rng.integers(1, 5, 40) * far
            order = np.lexsort((w, v))
            rows.append((0, block, None, 0, katz_lm.pack(np.diff(v[order], prepend=0), w[order], rng.integers(0, 20, 40), rng.integers(1, 4, 40))))
        out = katz_lm._merged(pd.DataFrame(rows, columns=["part", "block", "docs", "n_ids", "pairs"])).iloc[0]
        v, w, count, times = katz_lm.unpack(out["bigrams"])
        return (np.cumsum(v.astype(np.int64)) // far).tolist(), (w.astype(np.int64) // far).tolist(), count.tolist(), times.tolist(), [x.tolist() for x in katz_lm.unpack(out["postings"])], [out[f"n{r}"] for r in range(1, 7)]

    near = merged(1)
    assert merged(1 << 34) == near
    monkeypatch.setattr(katz_lm, "PAIRED", 0)
    assert merged(1) == near


def test_4_repeats_in_a_long_text_are_exact(spark):
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in rng.integers(0, 1 << 40, 300_000)]
    words[200_000:200_009] = words[100:109]
    n = {r["n_repeat_words"] for r in quality_mcd.statistics(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:1000]))], "doc_id long, text string"), ["doc_id"]).collect()}
    assert n == {18, 0}


def test_7_other_vocabularies_encode_whole_texts(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    texts = ["Hello there, it's 2024.", "", "naïve café — 漢字", " x ", "a.b. c,"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own, t = addressable_codes.WordIds(path(name)), Tokenizer.from_file(path(name))
        assert own.by_words == (name == "word_bpe_49k.json")
        ids, n = own(texts)
        assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    few = addressable_codes.WordIds(word_model())
    few.held = addressable_codes.MEMORY + 1
    assert few(["again"])[0].tolist() == addressable_codes.WordIds(word_model())(["again"])[0].tolist() and few.held < 1000


def test_6_spans_of_a_batch_are_those_of_each_text():
    enc = pieces.encoder(piece_model())
    texts = ["", " ", "  Ça  coûte 5€", "\U0001f600 x", "a" * 3000, "▁ <s> \x00"]
    ids, begin, end, counts, decoded = enc(texts, False)
    at = 0
    for t, n, d in zip(texts, counts, decoded):
        b, e = enc.spans(t, np.array(enc.sp.encode(t), np.int32))
        assert (list(begin[at : at + n]), list(end[at : at + n])) == (list(b), list(e)) and d == enc.sp.decode(enc.sp.encode(t))
        at += n


NAMES = ["_row", "_ROW_KEY", "_copy", "_of", "_limit", "_copies", "_gone", "_Once", "_twice", "_row_order", "theirs", "own", "place", "row", "clean", "node", "spot", "key", "_group", "component", "kept", "a b.c"]


@pytest.mark.parametrize("upper", [False, True])
def test_columns_of_any_name_stay(spark, upper):
    names = [n.upper() if upper else n for n in NAMES]
    rng = np.random.default_rng(1)
    text = lambda i: " ".join(f"w{int(x)}" for x in rng.integers(0, 5000, 60)) + f" end{i}."
    rows = [(i, text(i), "en", f"s{i % 2}", 7) for i in range(120)]
    rows += [(500, rows[3][1], "en", "s0", 7), (501, rows[4][1] + " More of it.", "en", "s1", 7)]
    df = spark.createDataFrame([(*r, *[f"{r[0]}{n}" for n in names]) for r in rows], ["doc_id", "text", "lang", "source", "n_chars", *names])
    for f in (quality_mcd.filter_documents, near_dedup.dedup_documents, sentence_spans.clean_documents, mix_sources.mix_documents):
        out = f(df)
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(r[n] == f"{r['doc_id']}{n}" for r in got for n in names)
    assert fresh(df, "row", "new") == ["__row", "_new"]


def test_5_rows_of_one_id_with_other_texts_keep_their_links(spark):
    rng = np.random.default_rng(9)
    a, b = (" ".join(f"{c}{int(x)}" for x in rng.integers(0, 10**6, 200)) for c in "ab")
    rows = [(7, a), (7, b), (8, a + " more"), (9, b + " more"), (9, b + " more"), (10, "quite another text of some words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.near_table(df).collect()} == {(7, 7), (8, 7), (9, 7), (10, 10)}
    assert sorted(tuple(r) for r in near_dedup.dedup_documents(df).collect()) == sorted([(7, a), (7, b), rows[-1]])
