"""Toxicity by a classifier chain of linear models over hashed words.

Method. Categories are predicted one after the other by logistic models. A model's features are the
presence of hashed words and of their first bytes, and the log-odds of all earlier categories. For
training, those come from out-of-fold predictions, so that a later model sees the errors an earlier
one makes on unseen documents; for scoring, from the earlier model fitted on the whole sample. The
decision threshold of each category is the one with the fewest errors among out-of-fold predictions.

Bounds. The chain is fitted on at most ``SAMPLE`` labelled documents, those whose ids have the least
hash; their features are what one fitting task holds. Folds are fitted in parallel tasks. The models
have a fixed number of weights (``SLOTS``), so what is sent to the tasks does not grow. Every word
of every document is scored.

Rules for odd rows. Null and empty texts have no features and get the models' base probabilities.
Labels of a null doc_id or with a null category take no part; of several labels of one document the
highest counts. Without both classes in the sample a category is predicted as its smoothed base
rate and never flagged. Repeated rows are scored alike; rows without doc_id are scored. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.lineage import pin
from shelfwise.llm.words import ALPHANUMERIC, mix, slices, span_hashes

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
PREFIXES = (3, 4, 5, 6)
SAMPLE = 8_000
FOLDS = 3
ROUNDS, PENALTY = 600, 1e-5
LEAST_DOCS, LEAST_STATISTIC, KEPT = 3, 12, 2000
STEADY_ODDS = 6.0

# Weak labels of the two kinds of abuse inside documents that are labelled toxic.
CATEGORY_WORDS = {
    "insult": ("idiot", "moron", "clown", "loser", "scum"),
    "contempt": ("trash", "pathetic", "worthless", "disgusting", "stupid"),
}
FINAL = "toxic"


def slots_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and distinct feature slots of every text."""
    for part in slices(texts, lower=True):
        starts, ends, rows = part.word_spans(ALPHANUMERIC)
        prefix = part.prefix_hashes()
        found = [(rows, span_hashes(prefix, starts, ends))]
        for size in PREFIXES:
            long = ends - starts > size
            at = starts[long]
            found.append((rows[long], mix(span_hashes(prefix, at, at + size), size)))
        owner = np.concatenate([f[0] for f in found]).astype(np.uint64)
        slot = np.concatenate([f[1] for f in found]) >> np.uint64(64 - SLOT_BITS)
        both = np.unique(owner << np.uint64(SLOT_BITS) | slot)
        owner, slot = both >> np.uint64(SLOT_BITS), (both & np.uint64(SLOTS - 1)).astype(np.int32)
        bounds = np.searchsorted(owner, np.arange(part.rows + 1, dtype=np.uint64))
        for row in range(part.rows):
            yield part.first + row, slot[bounds[row] : bounds[row + 1]]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = [s.tobytes() for _, s in slots_of(batch.column("text"))]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(slots, pa.binary())], [*names, "slots"]
        )


class Rows:
    """Present slots of each row, kept as they came, and dense extra columns."""

    def __init__(self, slots: Sequence[bytes], extra: np.ndarray):
        self.slots = [np.frombuffer(s, dtype=np.int32) for s in slots]
        self.extra = extra

    def __len__(self) -> int:
        return len(self.slots)

    def take(self, keep: np.ndarray) -> "Rows":
        out = Rows((), self.extra[keep])
        out.slots = [s for s, k in zip(self.slots, keep) if k]
        return out

    def counts(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with each slot, and those of them that are wanted."""
        every, hits = np.zeros(SLOTS), np.zeros(SLOTS)
        for slots, hit in zip(self.slots, wanted):
            every[slots] += 1  # slots are distinct within a row
            if hit:
                hits[slots] += 1
        return every, hits

    def entries(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of all slots that have a place."""
        found = [place[slots] for slots in self.slots]
        found = [f[f >= 0] for f in found]
        return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)

    def odds(self, model: dict) -> np.ndarray:
        sums = np.array([model["weights"][slots].sum() for slots in self.slots])
        return sums + self.extra @ model["extra"] + model["bias"]


def fit(rows: Rows, wanted: np.ndarray) -> dict:
    """Penalised logistic regression on the slots that differ most between the classes.

    Slots are screened by their chi-square statistic, as rare words would fit any sample by heart;
    accelerated gradient steps of the inverse curvature need no tuning.
    """
    n, hits = len(wanted), wanted.sum()
    base = float(np.log((hits + 0.5) / (n - hits + 0.5)))
    model = {"weights": np.zeros(SLOTS), "extra": np.zeros(rows.extra.shape[1]), "bias": base}
    if not 0 < hits < n:
        return model
    docs, with_hit = rows.counts(wanted)
    expected = docs * hits / n
    spread = np.maximum(expected * (1 - hits / n) * (1 - docs / n), 1e-9)
    statistic = np.where(docs >= LEAST_DOCS, (with_hit - expected) ** 2 / spread, 0)
    used = np.flatnonzero(statistic >= LEAST_STATISTIC)
    used = np.sort(used[np.argsort(-statistic[used], kind="stable")[:KEPT]])
    place = np.full(SLOTS, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    owner, index = rows.entries(place)
    m, width = len(used), rows.extra.shape[1]

    def forward(theta: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=theta[index], minlength=n) + rows.extra @ theta[m : m + width] + theta[-1]

    def backward(error: np.ndarray) -> np.ndarray:
        return np.concatenate(
            [np.bincount(index, weights=error[owner], minlength=m), rows.extra.T @ error, [error.sum()]]
        )

    top = np.ones(m + width + 1)
    for _ in range(15):  # power iteration for the largest curvature
        grown = backward(forward(top)) / n
        curvature = np.linalg.norm(grown)
        top = grown / curvature
    rate = 1 / (0.25 * 1.1 * curvature + PENALTY)
    theta = np.zeros(m + width + 1)
    theta[-1] = base
    before = theta.copy()
    for step in range(1, ROUNDS + 1):
        ahead = theta + (step - 1) / (step + 2) * (theta - before)
        slope = backward((_probability(forward(ahead)) - wanted) / n)
        slope[:-1] += PENALTY * ahead[:-1]
        before, theta = theta, ahead - rate * slope
    model["weights"][used] = theta[:m]
    model["extra"], model["bias"] = theta[m : m + width], float(theta[-1])
    return model


def steady(odds: np.ndarray) -> np.ndarray:
    """Log-odds of earlier categories, held to the range in which they tell anything."""
    return np.clip(odds, -STEADY_ODDS, STEADY_ODDS)


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_fold(category: str, earlier: list[str]):
    """Fit on the rows of other folds; predict the own fold. The last group fits all rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "doc_id"]).reset_index(drop=True)
        fold = int(group["group"].iloc[0])
        rows = Rows(group["slots"].tolist(), steady(group[earlier].to_numpy(dtype=float).reshape(len(group), -1)))
        wanted = group[category].to_numpy(dtype=float)
        own = (group["fold"] == fold).to_numpy()
        model = fit(rows.take(~own), wanted[~own])
        odds = rows.take(own).odds(model)
        weights = np.concatenate([[model["bias"]], model["extra"], model["weights"]]).tobytes() if fold == FOLDS else None
        out = pd.DataFrame({"doc_id": group["doc_id"][own], "odds": odds, "model": None})
        if fold == FOLDS:
            out = pd.DataFrame({"doc_id": [None], "odds": [None], "model": [weights]})
        return out

    return run


def _threshold(odds: np.ndarray, wanted: np.ndarray) -> float:
    """Log-odds with the fewest errors, in the middle of the widest gap."""
    if not 0 < wanted.sum() < len(wanted):
        return float("inf")
    order = np.argsort(odds, kind="stable")
    odds, wanted = odds[order], wanted[order]
    errors = np.concatenate([[0], np.cumsum(wanted)]) + np.concatenate([np.cumsum((1 - wanted)[::-1])[::-1], [0]])
    edges = np.concatenate([[odds[0] - 1], (odds[1:] + odds[:-1]) / 2, [odds[-1] + 1]])
    best = np.flatnonzero(errors == errors.min())
    gaps = np.concatenate([[1], odds[1:] - odds[:-1], [1]])
    return float(edges[best[np.argmax(gaps[best])]])


def fit_chain(sample: DataFrame, categories: Sequence[str]) -> list[dict]:
    """Models and thresholds of the categories from (doc_id, slots, one 0/1 column each)."""
    chain: list[dict] = []
    # The order of rows, and with it the folds and the sums, follows a hash of the id.
    sample = pin(
        sample.withColumn("order", F.xxhash64("doc_id")).withColumn("fold", F.pmod("order", F.lit(FOLDS)).cast("int")),
        "sample",
    )
    earlier: list[str] = []
    for category in categories:
        groups = sample.withColumn("group", F.explode(F.array(*(F.lit(g) for g in range(FOLDS + 1)))))
        fitted = pin(
            groups.groupBy("group").applyInPandas(
                _fit_fold(category, list(earlier)), "doc_id long, odds double, model binary"
            ),
            "fitted",
        )
        models = fitted.where("model IS NOT NULL").collect()
        out_of_fold = fitted.where("model IS NULL").select("doc_id", F.col("odds").alias(f"odds_{category}"))
        sample = pin(sample.join(out_of_fold, "doc_id"), "sample")
        seen = sample.select(f"odds_{category}", category).toPandas()
        values = np.frombuffer(models[0].model) if models else np.zeros(1 + len(earlier) + SLOTS)
        chain.append(
            {
                "bias": float(values[0]),
                "extra": values[1 : 1 + len(earlier)],
                "weights": values[1 + len(earlier) :],
                "threshold": _threshold(seen[f"odds_{category}"].to_numpy(), seen[category].to_numpy(dtype=float)),
            }
        )
        earlier.append(f"odds_{category}")
    return chain


def _score(chain):
    """The rows with the probability and the decision of every category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = chain.value
        for batch in batches:
            odds = np.zeros((batch.num_rows, len(models)))
            for row, slots in slots_of(batch.column("text")):
                for i, model in enumerate(models):
                    odds[row, i] = model["bias"] + model["weights"][slots].sum() + steady(odds[row, :i]) @ model["extra"]
            columns = [pa.array(_probability(odds[:, i])) for i in range(len(models))]
            columns += [pa.array(odds[:, i] >= m["threshold"]) for i, m in enumerate(models)]
            names = [*(f"p{i}" for i in range(len(models))), *(f"is{i}" for i in range(len(models)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """doc_id, slots and 0/1 categories of at most ``limit`` labelled documents."""
    one = labels.where(f"doc_id IS NOT NULL AND {FINAL} IS NOT NULL").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    )
    one = one.agg((F.max(FINAL) > 0).cast("int").alias(FINAL))
    known = docs.select("doc_id").distinct().join(one, "doc_id")
    chosen = pin(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit), "chosen")
    rows = docs.join(chosen, "doc_id").groupBy("doc_id", FINAL).agg(F.max("text").alias("text"))
    text = F.lower(F.coalesce("text", F.lit("")))
    weak = {
        name: (F.col(FINAL) * text.rlike(r"\b(" + "|".join(words) + r")\b").cast("int")).alias(name)
        for name, words in CATEGORY_WORDS.items()
    }
    kinds = ", ".join(f"{name} int" for name in (*weak, FINAL))
    return rows.select("doc_id", *weak.values(), FINAL, "text").mapInArrow(
        _features, f"doc_id long, {kinds}, slots binary"
    )


def _scored(rows: DataFrame, docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``rows`` (with text) and p_<category>, is_<category>, by the chain fitted on (doc_id, text) of ``docs``."""
    categories = [*CATEGORY_WORDS, FINAL]
    chain = fit_chain(labelled_sample(docs, labels, sample), categories)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    n = range(len(categories))
    added = [T.StructField(f"p{i}", T.DoubleType()) for i in n] + [T.StructField(f"is{i}", T.BooleanType()) for i in n]
    scored = rows.mapInArrow(_score(shared), T.StructType([*rows.schema.fields, *added]))
    return scored.toDF(*rows.columns, *(f"p_{c}" for c in categories), *(f"is_{c}" for c in categories))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, p_<category> and is_<category> of every row of (doc_id, text)."""
    return _scored(_plain(docs), _plain(docs), labels, sample).drop("text")


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with their columns, that the last category does not flag.

    The decision is taken on the row, so rows without doc_id go as well, and a row does not take
    others of its id along.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    text = docs.columns.index("text")
    rows = docs.withColumn("text", F.col("text").cast("string")).toDF(*columns).withColumnRenamed(columns[text], "text")
    kept = _scored(rows, _plain(docs), labels, sample).where(~F.col(f"is_{FINAL}"))
    return kept.select(*(F.col(c).alias(n) for c, n in zip(rows.columns, docs.columns)))
