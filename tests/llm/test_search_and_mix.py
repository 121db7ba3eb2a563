import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import mixing, topk
from shelfwise.llm.mixing import mix_sources
from shelfwise.llm.topk import scores_of, top_k
from tests.llm.odd import empty_documents, odd_documents


def brute_top_k(rows, k):
    """Every row against every other; a query row's list is without that row only."""
    fine = [
        (i, [math.floor(64 * x) for x in v]) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (i, v) in enumerate(fine):
        if i % 20:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), j) for other, (j, w) in enumerate(fine) if other != at and len(w) == len(v)
        )
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK", 5)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    random.seed(1)
    rows = [(i, [random.choice([-1.5, 0.01, 0.5, 2.25]) for _ in range(6)]) for i in range(-40, 260)]
    rows += [(300 + i, [0.5] * 6) for i in range(60)]  # ties
    rows += [(400, None), (None, [1.0] * 6), (420, [1.0, None]), (440, [float("nan")] * 6), (460, [float("inf")] * 6)]
    rows += [(480, []), (500, [1.0, 2.0]), (520, [3.0, 4.0]), (0, [9.0] * 6), (20, [-9.0] * 6)]  # other length, repeated ids
    rows += [(2, [0.5] * 6), (2, [0.9] * 6), (60, [2.25] * 6), (60, [2.25] * 6)]  # repeated rows
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = top_k(df.repartition(7), F.col("vec_id") % 20 == 0, k=7)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_top_k(rows, 7)


def test_top_k_twin_agrees_on_repeated_ids(spark, tmp_path):
    import duckdb

    from shelfwise.llm.registry import QUERIES, SQL

    rows = [(2, [0.5, 0.0]), (2, [0.9, 0.0]), (20, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [0.25, 1.0]), (3, [0.5, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in QUERIES["op1_top_k"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(SQL["op1_top_k"]).fetchall()) == brute_top_k(rows, 20)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<double>")
    assert top_k(one, F.col("vec_id") % 20 == 0).count() == 0


def test_products_stay_exact():
    big = np.array([[2.0**40, 3.0]])
    assert scores_of(big, np.array([[2.0**20 + 1, 5.0]]))[0, 0] == 2**60 + 2**40 + 15
    huge = np.array([[2.0**50, 1.0]])
    assert scores_of(huge, np.array([[2.0**40, 1.0]]))[0, 0] == 2**63 - 1


def check_mix(docs, out, weights=(5, 2, 1)):
    sources = {}
    for r in out:
        sources.setdefault(r.source, []).append(r)
    total = sum(r.size for r in out)
    targets = {s: rows[0].target for s, rows in sources.items()}
    sizes = {s: sum(r.size for r in rows) for s, rows in sources.items()}
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    share = {s: weights[i % 3] for i, s in enumerate(order)}
    # Water filling by repetition.
    left, open_, want = 1.5 * total, set(order), {}
    while open_:
        level = left / sum(share[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * share[s]}
        if not full:
            want |= {s: level * share[s] for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    for s in order:
        assert targets[s] == pytest.approx(want[s])
        assert all(r.source_size == sizes[s] for r in sources[s])
        assert all(r.taken <= 2 * r.size for r in sources[s])
        taken = sum(r.taken for r in sources[s])
        assert abs(taken - want[s]) <= max([r.size for r in sources[s]] + [1])


def test_mix_targets_and_reruns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COARSE", 8)
    monkeypatch.setattr(mixing, "FINE", 4)
    random.seed(2)
    rows = []
    for i in range(3000):
        source = random.choice(["hot"] * 6 + ["b", "c", "d", "é", None])
        rows.append((i, " ".join(["w"] * int(random.paretovariate(1.1)) if random.random() > 0.05 else []), source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([(i, 2.0 if i % 2 else 0.5) for i in range(0, 3000, 3)], "doc_id long, weight double")
    first = mix_sources(docs, weights).collect()
    assert len(first) == len(rows)
    check_mix(docs, first)
    again = mix_sources(docs.repartition(13), weights).collect()
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str)


def test_copies_at_the_end_of_the_budget_are_counted(spark):
    """Hot copies of one id, of one text without id, and of an id with texts of two lengths."""
    ten, six = "w " * 10, "w " * 6
    for copies in ([(7, ten)] * 100, [(None, ten)] * 100, [(7, ten)] * 60 + [(7, six)] * 60):
        rows = [(*c, s) for c in copies for s in ("a", None)] + [(100 + i, ten, "a") for i in range(50)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
        out = mix_sources(docs, weights=(1, 1)).collect()
        check_mix(docs, out, weights=(1, 1))
        again = mix_sources(docs.repartition(3), weights=(1, 1)).collect()
        plain = lambda rows: sorted(map(str, rows))
        assert plain(out) == plain(again)
        assert len({r.taken for r in out if r.size == 10 and r.source == "a"}) <= 2


def test_fractional_epoch_follows_the_keys(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 5)), s) for s in ("a", "b", "c") for i in range(400 * "abc".index(s), 400 * "abc".index(s) + 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = {r.doc_id: r.key for r in mixing._sized(docs, None, mixing.SEED).collect()}
    for source in "abc":
        out = [r for r in mix_sources(docs).collect() if r.source == source]
        whole = int(out[0].target // out[0].source_size)
        picked = {r.doc_id: r.taken // r.size - whole for r in out}
        assert set(picked.values()) <= {0, 1}
        chosen = [keys[d] for d, p in picked.items() if p]
        other = [keys[d] for d, p in picked.items() if not p]
        assert not chosen or not other or max(chosen) < min(other)


def test_heavier_documents_come_first(spark):
    rows = [(i, "one two three", s) for s in ("a", "b") for i in range(1000 * (s == "b"), 1000 * (s == "b") + 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([(i, 8.0 if i % 2 else 0.125) for i in range(2000)], "doc_id long, weight double")
    out = [r for r in mix_sources(docs, weights, weights=(1, 1)).collect() if r.source == "a"]
    assert {r.taken - r.size for r in out} == {0, 3}  # one epoch and a half
    heavy = sum(r.taken - r.size for r in out if r.doc_id % 2)
    assert heavy > 0.9 * sum(r.taken - r.size for r in out)


def test_mix_odd_rows(spark):
    docs = odd_documents(spark)
    bad = spark.createDataFrame([(1, float("nan")), (5, -1.0), (None, 3.0), (5, None)], "doc_id long, weight double")
    out = mix_sources(docs, bad).collect()
    assert len(out) == docs.count()
    check_mix(docs, out)
    assert sum(r.size for r in out if r.doc_id in (2, 3, 4)) == 0
    assert mix_sources(empty_documents(spark)).count() == 0


def test_mix_has_no_python_in_its_plan(spark):
    plan = mix_sources(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
