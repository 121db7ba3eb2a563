import random

import numpy as np
import pyarrow as pa

from shelfwise.llm.toxicity import Rows, fit, score_toxicity, slots_of, _threshold
from tests.llm.odd import empty_documents, odd_documents

PLAIN = ["river", "stone", "walk", "green", "table", "house", "cloud", "paper", "light", "music", "garden", "winter"]
RUDE = ["idiot", "moron", "trash", "pathetic", "zorgul", "zorgax"]


def corpus(n, seed):
    random.seed(seed)
    rows, labels = [], []
    for i in range(n):
        words = [random.choice(PLAIN) + random.choice(["", "s", "ly"]) for _ in range(random.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(random.randint(1, 3)):
                words.insert(random.randrange(len(words)), random.choice(RUDE))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_reruns(spark):
    rows, labels = corpus(1200, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, toxic int")
    train = train.unionByName(spark.createDataFrame([x for x in labels if x[0] % 4 == 0], "doc_id long, toxic int"))
    out = {r.doc_id: r for r in score_toxicity(docs, train).collect()}
    held = [(i, t) for i, t in labels if i % 4 == 2]
    right = sum(out[i].is_toxic == bool(t) for i, t in held)
    assert right >= 0.98 * len(held)
    assert {"p_insult", "p_contempt", "p_toxic", "is_insult", "is_contempt"} <= set(out[0].asDict())
    insults = [i for i, text in rows if i % 4 == 2 and ("idiot" in text or "moron" in text)]
    assert np.mean([out[i].is_insult for i in insults]) > 0.9
    again = {r.doc_id: r for r in score_toxicity(docs.repartition(11), train.repartition(3)).collect()}
    assert all(abs(out[i].p_toxic - again[i].p_toxic) < 1e-12 for i in out)


def test_fit_reaches_the_optimum():
    """The gradient of the penalised loss vanishes."""
    texts = [t for _, t in corpus(300, 8)[0]]
    wanted = np.array([t for _, t in corpus(300, 8)[1]], dtype=float)
    rows = Rows([s.tobytes() for _, s in slots_of(pa.array(texts))], np.zeros((300, 1)))
    model = fit(rows, wanted)
    error = (1 / (1 + np.exp(-rows.odds(model))) - wanted) / 300
    used = np.flatnonzero(model["weights"])
    slope = np.zeros(len(model["weights"]))
    for slots, e in zip(rows.slots, error):
        slope[slots] += e
    assert len(used) and np.abs(slope[used]).max() < 5e-3 and abs(error.sum()) < 5e-3


def test_threshold():
    assert 0 < _threshold(np.array([-2.0, -1.0, 0.0, 3.0]), np.array([0, 0, 0, 1.0])) < 3
    assert _threshold(np.array([1.0]), np.array([1.0])) == float("inf")


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame(
        [(1, 0), (5, 1), (5, 0), (None, 1), (7, None), (99, 1), (8, 0)], "doc_id long, toxic int"
    )
    out = score_toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(0 <= r.p_toxic <= 1 for r in out)
    one_class = labels.where("doc_id = 1")
    assert not any(r.is_toxic for r in score_toxicity(docs, one_class).collect())
    assert score_toxicity(docs, labels.limit(0)).count() == docs.count()
    assert score_toxicity(empty_documents(spark), labels).count() == 0
