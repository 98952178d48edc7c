import hashlib
import math
from collections import Counter, defaultdict

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from meridia.llm import bpe_codec, mixing, quality

from .test_language_and_quality import brute_kneser_ney, quality_rows
from .test_mixing import brute_targets, words
from .test_shingle_join import brute_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_quality(rows, labels):
    """Rows within their language's quantile of trusted perplexities, from the definitions."""
    good = {i for i, q, toxic in labels if q == 1 and not toxic}
    trusted = [r for r in rows if r[0] in good and r[1] is not None]
    p, s, cache = brute_kneser_ney([r[1] for r in trusted]), quality.SYMBOLS, {}

    def nll(t):
        total = 0.0
        for c in quality.trigrams(t or "").tolist():
            if c not in cache:
                cache[c] = -math.log(p(c // s**2, c // s % s, c % s))
            total += cache[c]
        return total

    prior = sum(nll(r[1]) for r in trusted) / sum(len(r[1]) for r in trusted)
    step = lambda r: math.floor((nll(r[1]) + 64 * prior) / (len(r[1] or "") + 64) * 1000)
    cut = lambda own: sorted(own)[math.ceil(len(own) * quality.QUANTILE) - 1]
    steps = defaultdict(list)
    for r in trusted:
        steps[r[2]].append(step(r))
    general = cut([x for own in steps.values() for x in own])
    limit = {g: cut(own) for g, own in steps.items() if g is not None and len(own) >= quality.MIN_TRUSTED}
    return [r for r in rows if step(r) <= limit.get(r[2], general)]


def brute_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add(i)
    stays = lambda i, x: len(key(x)) < 40 or len(where[key(x)]) < 5 or i == max(where[key(x)])
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if stays(i, x)), *rest) for i, t, *rest in rows]


def brute_near(rows):
    rows = sorted(rows)
    root = brute_groups([(r[1] or "").lower() for r in rows])
    return [r for n, r in enumerate(rows) if root[n] == n]


def brute_mix(spark, rows):
    keyed = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").select("doc_id", mixing.random_key(F.col("doc_id"), F.col("text")).alias("k"))
    key = {r.doc_id: r.k for r in keyed.collect()}
    sizes, out = Counter(), []
    for r in rows:
        sizes[r[3]] += words(r[1])
    for source, target in brute_targets(sizes).items():
        budget, at, last = math.floor(target + 0.5), 0, None
        left = budget % sizes[source] if sizes[source] else 0
        own = sorted((r for r in rows if r[3] == source), key=lambda r: (key[r[0]], r[0]))
        for n, r in enumerate(own):
            if left > 0 and 2 * at + words(r[1]) <= 2 * left:
                last = n
            at += words(r[1])
        for n, r in enumerate(own):
            out += [r] * ((budget // sizes[source] if sizes[source] else 0) + (last is not None and n <= last))
    return out


def test_run_agrees_with_brute_force(spark, tmp_path):
    rows, junk, odd, labels = quality_rows()
    line = "This very line stands in many documents, and it has over forty characters."
    rows = [(i, t + ("\n" + line if i % 4 == 0 else ""), lang, f"src{i % 3}", len(t)) for i, t, lang, *_ in rows]
    copies = [(3000 + i, rows[j][1], "en", "src1", 0) for i, j in enumerate((1, 2, 3, 5, 6))]
    near = [(3100 + i, rows[j][1] + " the", "en", "src2", 0) for i, j in enumerate((7, 9, 10))]
    every = rows + junk + odd + copies + near
    spark.createDataFrame(every, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = sorted(map(tuple, out.collect()))

    kept = brute_quality(every, labels)
    assert {r[0] for r in kept}.isdisjoint({i for i, *_ in junk}) and len(kept) > 230
    lines = brute_lines(kept)
    assert sum(line in (r[1] or "") for r in lines) == 1
    single = brute_near(lines)
    assert {r[0] for r in single}.isdisjoint([*range(3000, 3005), *range(3100, 3103)])
    enc = bpe_codec.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = []
    for r in brute_mix(spark, single):
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_stages_take_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "byte_bpe"]
