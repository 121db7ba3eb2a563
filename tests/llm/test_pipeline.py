import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import registry
from shelfwise.llm.minhash import near_duplicates
from tests.compare import connect, difference
from tests.llm.test_near_and_lines import brute_components

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = corpus_pipeline.pin(stage(spark, docs, FOLDER), name)
        out[name] = docs, result
        docs = result
    return out


def test_names_and_columns(spark, stages):
    assert list(stages) == ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "source_mix"]
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").dtypes
    for name in list(stages)[:-1]:
        assert stages[name][1].dtypes == columns


def test_toxic_documents_go_and_others_stay(spark, stages):
    docs, left = stages["toxicity"]
    kept = {r.doc_id for r in left.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    clean = [d for d, t in labels.items() if not t]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    assert left.join(docs, docs.columns, "left_anti").isEmpty()


def test_line_stage_keeps_every_document(stages):
    docs, left = stages["line_dedup"]
    assert docs.count() == left.count()
    assert left.where(F.length("text") != F.col("n_chars")).isEmpty()


def test_one_document_of_each_group_stays(stages):
    docs, left = stages["minhash_near_dedup"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {d for d, c in brute_components(rows, 5).items() if d == c}
    assert {r.doc_id for r in left.collect()} == want


def test_passages_go(spark, stages):
    docs, left = stages["benchmark_decontamination"]
    norm = lambda s: " ".join((s or "").lower().split())
    items = [norm(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in docs.collect() if any(i in norm(r.text) for i in items)}
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in left.collect()}
    assert holds <= gone and len(gone) <= len(holds) + 2


def test_mix_takes_what_is_left(stages):
    docs, mixed = stages["source_mix"]
    assert docs.count() == mixed.count()
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size")).collect():
        assert abs(r.taken - r.target) <= r.size


def test_run_is_the_stages(spark, stages):
    same = ["doc_id", "source", "size", "taken"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).select(same).collect())) == sorted(
        map(tuple, stages["source_mix"][1].select(same).collect())
    )


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_twins(spark, name):
    assert difference(registry.QUERIES[name](spark, FOLDER), registry.SQL[name], connect(FOLDER)) is None


def test_registered_near_duplicates(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    out = registry.op7_near_duplicates(spark, FOLDER).collect()
    assert {r.doc_id: r.component_id for r in out} == brute_components(rows, 2)
    assert near_duplicates(spark.read.parquet(f"{FOLDER}/documents.parquet")).count() == len(rows)


def test_stages_on_odd_rows(spark, stages):
    """Null and repeated ids, empty and long texts, columns of the operators' own names, no rows at all."""
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id for r in stages["toxicity"][1].collect()}
    toxic = next(r for r in given.collect() if r.doc_id not in kept)
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    clean, long = "Words of a row that has no id at all, and nothing else to say.", "lorem ipsum dolor sit amet " * 8000
    odd = [
        (None, toxic.text), (None, f"so {item} it is"), (None, clean), (None, None), (7001, ""), (7002, None),
        (7003, long), (7003, long), (7004, long), (7005, clean + " Once."), (7005, clean + " Twice and more often than that."),
    ]
    rows = spark.createDataFrame([(i, t, "en", None, 0) for i, t in odd], given.schema)
    docs = given.unionByName(rows).selectExpr("*", "1 AS is_toxic", "'c' AS c0", "2 AS loser", "3 AS key", "4 AS n_lines_", "5 AS place")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.pin(stage(spark, docs, FOLDER), name)
        assert left.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        seen[name], docs = [(r.doc_id, r.text) for r in left.collect()], left
    assert (None, toxic.text) not in seen["toxicity"] and (None, clean) in seen["toxicity"]
    assert (None, f"so {item} it is") in seen["minhash_near_dedup"]
    final = seen["benchmark_decontamination"]
    assert (None, f"so {item} it is") not in final
    assert {(None, clean), (None, None), (7001, ""), (7002, None)} <= set(final)
    assert [i for i, _ in final].count(7003) == 2 and [i for i, _ in final].count(7005) == 2
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert mixed.count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), FOLDER).count() == 0
