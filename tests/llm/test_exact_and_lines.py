import hashlib
import re
from collections import Counter, defaultdict

import pytest

from meridia.llm import exact_dedup, line_dedup

from .conftest import SCHEMA, as_dict

WS = " \t\n\x0b\x0c\r"


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups["".join(c for c in t or "" if c not in WS)].append((-len(t or ""), i))
    out = {}
    for norm, g in groups.items():
        keep = min(g)[1]
        for _, i in g:
            out[i] = {"doc_id": i, "keep_id": keep, "group_size": len(g), "kept": i == keep, "text_sha256": hashlib.sha256(norm.encode()).hexdigest()}
    return out


@pytest.mark.parametrize("support", [0.001, 0.02, 0.3])
def test_exact_dedup_agrees_with_brute_force(docs, rows, support):
    assert as_dict(exact_dedup.exact_dedup(docs, support=support)) == brute_exact(rows)


def test_exact_dedup_extra_columns_and_empty(clashing, empty, rows):
    assert as_dict(exact_dedup.exact_dedup(clashing)) == brute_exact(rows)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(5, "a b", None, None, 0)] * 3 + [(None, "ab ", None, None, 0), (None, None, None, None, 0)], SCHEMA)
    got = exact_dedup.exact_dedup(df).collect()
    ab = [r for r in got if r.group_size == 4]
    assert len(ab) == 4 and {r.keep_id for r in ab} == {5} and sum(r.kept for r in ab) == 1
    assert [r.kept for r in got if r.group_size == 1] == [True]


def brute_lines(rows):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(WS))
    where, last = Counter(), {}
    for i, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            where[k] += 1
            last[k] = max(last.get(k, i), i)
    out = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and where[key(x)] >= 5 and last[key(x)] != i)]
        out[i] = {"doc_id": i, "n_lines": len(lines), "n_dropped": len(lines) - len(kept), "kept_sha256": hashlib.sha256("\n".join(kept).encode()).hexdigest()}
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 3), (5, 2)])
def test_line_dedup_agrees_with_brute_force(docs, rows, batches, fanout):
    want = brute_lines(rows)
    assert sum(w["n_dropped"] for w in want.values()) >= 10
    assert as_dict(line_dedup.line_dedup(docs, batches=batches, fanout=fanout)) == want


def test_line_dedup_extra_columns_and_empty(clashing, empty, rows):
    assert as_dict(line_dedup.line_dedup(clashing)) == brute_lines(rows)
    assert line_dedup.line_dedup(empty).count() == 0


def test_drop_lines_keeps_columns(clashing, rows):
    out = line_dedup.drop_lines(clashing)
    assert out.columns == clashing.columns
    want = brute_lines(rows)
    texts = {i: t for i, t, *_ in rows}
    for i, r in as_dict(out).items():
        assert (r["text"] is None) == (texts[i] is None)
        assert hashlib.sha256((r["text"] or "").encode()).hexdigest() == want[i]["kept_sha256"]
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_runs_compact_and_find_new_lines(spark):
    with line_dedup.LineRuns(spark, fanout=2) as runs:
        batch = lambda *keys: spark.createDataFrame([(d, h, 0) for d, h in keys], "doc_id long, h1 long, h2 long")
        runs.add(batch((9, 7), (8, 7), (8, 7), (8, 8)))
        assert {r.h1 for r in runs.new_lines(batch((7, 7), (7, 9))).collect()} == {9}
        runs.add(batch((7, 7), (7, 9)))
        runs.add(batch((6, 9), (None, 9)))
        assert [len(x) for x in runs.levels] == [1, 1]
        assert {(r.h1, r.n_docs, r.last_doc) for r in runs.rows().collect()} == {(7, 3, 9), (8, 1, 8), (9, 3, 7)}
        assert "Exchange" not in runs.new_lines(runs.rows())._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_document_count_once(spark):
    line = "a line that is certainly longer than forty characters"
    df = spark.createDataFrame([(1, f"{line}\nx{i}", None, None, 0) for i in range(4)] + [(2, line, None, None, 0)], SCHEMA)
    assert sum(r.n_dropped for r in line_dedup.line_dedup(df).collect()) == 0
    more = df.union(spark.createDataFrame([(None, line, None, None, 0), (None, line + "\nz", None, None, 0), (3, f"{line}\n{line}", None, None, 0), (4, line.upper(), None, None, 0)], SCHEMA))
    got = line_dedup.line_dedup(more).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in got) == [(0, 1), (0, 1), (1, 1), (1, 1), (1, 1), (1, 1), (2, 1), (3, 2), (4, 0)]


def test_very_long_texts_and_few_hot_keys(spark):
    """100,000 lines in one text, every other one dropped; one key is hot, the others take the join."""
    shared = [f"shared line number {i} with more than forty characters in it" for i in range(3)]
    rows = [(i, "\n".join(shared), None, None, 0) for i in range(5)]
    rows += [(-1, "\n".join(x for i in range(50_000) for x in (shared[i % 3], str(i))), None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for hot in (1, 1000):
        got = as_dict(line_dedup.line_dedup(df, hot_keys=hot))
        assert got[-1]["n_lines"] == 100_000 and got[-1]["n_dropped"] == 50_000
        assert got[-1]["kept_sha256"] == hashlib.sha256("\n".join(map(str, range(50_000))).encode()).hexdigest()
        assert [got[i]["n_dropped"] for i in range(5)] == [3, 3, 3, 3, 0]
