import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from meridia.llm import lang_id, quality

from meridia.llm.common import Scratch

from .conftest import as_dict

MODEL = P.path("piece_bpe_32k.model")
PIECES = lang_id.vocabulary(MODEL)
VOCAB = {"en": "the of and ing tion her that with was from", "de": "der und sch ein ich ung keit nicht für mit"}


def texts(n=120, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        parts = VOCAB[lang].split()
        out.append((i, " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))).title() for _ in range(12)), lang, "s", None))
    return out


def brute_log(word, probs, where):
    """The sum over all segmentations, by recursion."""
    s = "▁" + word
    memo = {len(s): 1.0}

    def rest(i):
        if i not in memo:
            total = 0.0
            for j in range(i + 1, min(len(s), i + lang_id.MAX_PIECE) + 1):
                row = where.get(s[i:j])
                if row is not None:
                    total += probs[row] * rest(j)
                elif j == i + 1:
                    total += lang_id.UNKNOWN * rest(j)
            memo[i] = total
        return memo[i]

    return math.log(rest(0))


@pytest.fixture(scope="module")
def model():
    counts = {}
    for _, t, lang, *_ in texts():
        counts.setdefault(lang, Counter()).update(t.lower().split())
    return lang_id.train(counts, PIECES)


def test_forward_sums_all_segmentations(model):
    where = {p: i for i, p in enumerate(PIECES)}
    words = ["the", "andher", "schein", "für", "q", "xyzzy", "ʒʒʒ", "unglaublichkeit", "x" * 70, "thethethe" * 30]
    got, _ = model.forward(words)
    for w, row in zip(words, got):
        if len(w) <= 40:
            for k in range(2):
                assert abs(row[k] - brute_log(w, model.probs[:, k], where)) < 1e-8
        assert np.isfinite(row).all()


def test_long_words_have_the_same_sums_and_expected_counts(model):
    where = {p: i for i, p in enumerate(PIECES)}
    rng = random.Random(3)
    for n in (1, 2, 15, 16, 17, 40, 300, 4095, 4096, 4100, 9000):
        word = "".join(rng.choice("theanderingsßü") for _ in range(n))
        got = model.long_word(word)
        if n <= 40:
            assert np.allclose(got, [brute_log(word, model.probs[:, k], where) for k in range(2)])
        assert np.allclose(got, model.forward([word])[0][0], rtol=1e-9)
    for word in ("the", "q", "andherschein", "unglaublichkeiten"):
        c = np.array([2.0, 3.0])
        one, other = model.forward([word], c[None])[1], np.zeros_like(model.probs)
        model.long_expected(word, c, other)
        assert np.allclose(one, other)
    long, other = "anderschein" * 90, np.zeros_like(model.probs)
    model.long_expected(long, np.ones(2), other)
    sizes = np.array([len(p) for p in PIECES] + [1])
    assert np.allclose((other * sizes[:, None]).sum(axis=0), len(long) + 1)  # pieces cover the word once


def test_predictions_and_scores_agree_with_brute_force(spark):
    rows = [r[:3] for r in texts(60, 4)] + [(200, "x" * 50 + " der und", None), (201, "Sch", "en"), (202, "ß 12 the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = as_dict(lang_id.predict(df, MODEL))
    counts = {}
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(t.lower().split())
    model, where = lang_id.train(counts, PIECES), {p: i for i, p in enumerate(PIECES)}
    for i, t, _ in rows:
        words = [w for w in t.lower().split() if w.isalpha()]
        logs = [sum(brute_log(w, model.probs[:, k], where) for w in words) for k in range(2)]
        best = max(range(2), key=lambda k: logs[k])
        assert got[i]["lang_pred"] == model.langs[best]
        assert abs(got[i]["score"] - 1 / sum(math.exp(x - logs[best]) for x in logs)) < 1e-9


def test_training_makes_probabilities(model):
    assert np.allclose(model.probs[:-1].sum(axis=0), 1)


def test_predictions_held_out(spark, clashing, empty):
    rows = texts() + [(900, None, "en", "s", 0), (901, "123 !?", "de", "s", 0), (902, "ungkeit sch nicht", None, "s", 0), (903, "², ³", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = as_dict(lang_id.predict(df, MODEL))
    assert len(got) == len(rows)
    for i, t, lang, *_ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i]["score"] <= 1
        if i < 900:
            assert got[i]["lang_pred"] == lang
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "de", "und"]
    assert lang_id.predict(empty, MODEL).count() == 0
    assert lang_id.predict(clashing, MODEL).count() == clashing.count()


# ---------------------------------------------------------------- quality
def brute_kneser_ney(train):
    """Interpolated modified Kneser-Ney for character trigrams, from the definitions."""
    s, a = quality.SYMBOLS, Counter()
    for t in train:
        a.update(quality.trigrams(t).tolist())
    tri = {(c // s**2, c // s % s, c % s): n for c, n in a.items()}
    bi, uni = Counter(), Counter()
    for x, y, z in tri:
        bi[y, z] += 1
    for y, z in bi:
        uni[z] += 1

    def discount(counts):
        n = [sum(v == i for v in counts.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        return [max(0, i + 1 - (i + 2) * y * n[i + 1] / n[i]) if n[i] else 0 for i in range(3)]

    d = [discount({(k,): v for k, v in uni.items()}), discount(bi), discount(tri)]
    cut = lambda n, o: d[o][min(n, 3) - 1]

    def level(table, order, context, z, lower):
        own = {k[-1]: v for k, v in table.items() if k[:-1] == context}
        if not own:
            return lower
        total = sum(own.values())
        gamma = sum(cut(v, order) for v in own.values()) / total
        n = own.get(z, 0)
        return (n - cut(n, order) if n else 0) / total + gamma * lower

    def p(x, y, z):
        one = level({(k,): v for k, v in uni.items()}, 0, (), z, 1 / s)
        two = level(bi, 1, (y,), z, one)
        return level(tri, 2, (x, y), z, two)

    return p


def test_model_is_kneser_ney(spark):
    train = ["the anin of thea", "of the ou\nthe", "thea thea blé"]
    p = brute_kneser_ney(train)
    s = quality.SYMBOLS
    rng = random.Random(0)
    codes = sorted({int(c) for t in train for c in quality.trigrams(t)}) + [rng.randrange(s**3) for _ in range(60)]
    x, y = (int(v) for v in divmod(quality.trigrams("th")[1] // s, s))
    codes += [(x * s + y) * s + z for z in range(s)]
    grams = spark.createDataFrame([(c // s**2, c // s % s, c % s) for c in sorted(set(codes))], "a long, b long, c long")
    with Scratch(spark) as scratch:
        model = quality.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(2), scratch)
        got = {(r.a, r.b, r.c): r.p for r in model.price(grams).collect()}
    assert len(got) == len(set(codes))
    for k, v in got.items():
        assert abs(v - p(*k)) < 1e-9
    assert abs(sum(got[x, y, z] for z in range(s)) - 1) < 1e-9


def test_perplexity_threshold_and_kept_agree_with_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "anin", "ou", "naïve", "blé", "zq"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 12))), ("en", "de", "fr", None)[i % 4]) for i in range(60)]
    rows += [(100, "x" * 300, "en"), (101, None, "en"), (102, "the of", "xx"), (103, "#!$" * 20, "de"), (104, "", None)]
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(1, 1, 1), (3, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = as_dict(quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), quantile=0.8, min_trusted=12, chunk_chars=300))
    trusted = [r for r in rows if r[0] < 60 and r[0] % 2 == 0]
    p, s = brute_kneser_ney([t for _, t, _ in trusted]), quality.SYMBOLS
    nll = lambda t: sum(-math.log(p(int(c) // s**2, int(c) // s % s, int(c) % s)) for c in quality.trigrams(t or ""))
    prior = sum(nll(t) for _, t, _ in trusted) / sum(len(t) for _, t, _ in trusted)
    score = {i: (nll(t) + 64 * prior) / (len(t or "") + 64) for i, t, _ in rows}

    def limit(lang):
        own = [i for i, _, g in trusted if g == lang and lang is not None]
        own = own if len(own) >= 12 else [i for i, *_ in trusted]
        steps = sorted(math.floor(score[i] * 1000) for i in own)
        return steps[math.ceil(len(steps) * 0.8) - 1]

    for i, _, lang in rows:
        assert abs(got[i]["perplexity"] - math.exp(score[i])) < 1e-9 * math.exp(score[i])
        assert abs(got[i]["threshold"] - math.exp((limit(lang) + 1) / 1000)) < 1e-9
        assert got[i]["kept"] == (math.floor(score[i] * 1000) <= limit(lang))
    assert not got[103]["kept"] and got[101]["kept"] and 3 < sum(not r["kept"] for r in got.values()) < 30


def quality_rows():
    rows = texts(240)
    junk = [(1000 + i, " ".join("%$#&*"[i % 5] * 3 + w for w in t.split()), lang, "s", 0) for i, t, lang, *_ in rows[:10]]
    odd = [(2000, None, "en", "s", 0), (2001, "", None, "s", 0), (2002, rows[0][1], "xx", "s", 0)]
    labels = [(i, 1, 0) for i, *_ in rows[:200]] + [(i, 0, 0) for i, *_ in junk] + [(5, 1, 0), (None, 1, 0)]
    return rows, junk, odd, labels


def test_quality_keeps_clean_and_rejects_junk(spark):
    rows, junk, odd, labels = quality_rows()
    docs = spark.createDataFrame(rows + junk + odd, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = as_dict(quality.classify(docs, lab))
    assert len(got) == len(rows + junk + odd)
    assert not any(got[i]["kept"] for i, *_ in junk)
    assert all(got[i]["kept"] for i, *_ in odd)
    assert sum(not got[i]["kept"] for i, *_ in rows) <= 3
    kept = quality.good_documents(docs, lab)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_all_trusted_documents_are_learned_from(spark):
    """Every one of 400 trusted documents of one language counts, in the model, the prior and the threshold."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the", "of", "anin", "ou"]) for _ in range(4)), "en") for i in range(400)] + [(400, "zq ou", "en"), (401, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = as_dict(quality.classify(docs, spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")))
    p, s, cache = brute_kneser_ney([t for _, t, _ in rows[:400]]), quality.SYMBOLS, {}

    def nll(t):
        for c in (codes := quality.trigrams(t or "").tolist()):
            if c not in cache:
                cache[c] = -math.log(max(p(c // s**2, c // s % s, c % s), 1e-300))
        return sum(cache[c] for c in codes)

    prior = sum(nll(t) for _, t, _ in rows[:400]) / sum(len(t) for _, t, _ in rows[:400])
    for i, t, _ in rows:
        want = math.exp((nll(t) + 64 * prior) / (len(t or "") + 64))
        assert abs(got[i]["perplexity"] - want) < 1e-9 * want


def test_quality_without_labels_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none).collect()
    assert all(r.kept and r.perplexity is None for r in got) and len(got) == docs.count()
    assert quality.classify(empty, none).count() == 0
    assert quality.good_documents(empty, none).count() == 0


def test_long_texts_are_scored_whole(spark):
    t = "the of and " * 120_000
    assert np.array_equal(np.concatenate(list(quality._pieces(t))), quality.trigrams(t))


def test_long_pieces_are_in_the_vocabulary_and_the_sums():
    pieces = lang_id.vocabulary(P.path("piece_bpe_32k.model"))
    assert {"▁something", "▁government", "▁information", "translation"} <= set(pieces)
    long = max(pieces, key=len)
    some = sorted({lang_id._START, *"abcdefghijklmnopqrstuvwxyz", long})
    model = lang_id.Model(["x"], lang_id.Pieces(some), np.full((len(some) + 1, 1), 0.01))
    word = long.lstrip("▁")
    got, _ = model.forward([word])
    whole = math.log(0.01 ** (len(word) + 1) + (0.01 if long[0] == "▁" else 0.01 ** 2))
    assert abs(got[0, 0] - whole) < 1e-9
