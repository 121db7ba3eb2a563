"""Spelling variants of the corpus vocabulary by a dictionary of trie-node pairs.

Method. Words are counted over all texts. Every prefix of a word is a node of a forward trie, every
suffix one of the trie of reversed words, and nodes have numbers: a node's number follows from its
parent's number and the letter. A word's split at position i is the pair (prefix node, suffix node)
around that position, and its skip of letter i the pair around that letter. Two words differ by
one replaced letter where they have a skip pair in common, and by one inserted letter where a skip
of the longer one is a split of the shorter one. Of equal letters in a row only the first is
skipped for insertions, so each pair of words meets once. Pairs that meet are confirmed on the words
themselves at the position where they met, so equal numbers of unlike nodes make no false link; and
equal nodes have equal numbers, so no link is missed.

A word's form is its most frequent near word where that is ``RATIO`` times as frequent; roots follow
forms by pointer doubling. Frequencies rise fivefold a step, so a chain is short.

Scale. Texts reduce to (word, count) rows in the tasks that read them. All later tables grow with the
vocabulary: 2 * length + 1 pairs a word, of three numbers each. A pair key has at most one word per
letter and one split, so no key is hot and no group is large. Numbers are made in numpy, letter by
letter over a batch of words; joins and sums are Spark's.

Rules for odd rows. Null texts have no words. A row without doc_id takes part, with an empty id in
the hash. Repeated rows count each. Letters beyond U+00FF and digits end a word; U+00D7 and U+00F7
are inside the range and count as letters. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.lineage import discard, pin
from shelfwise.llm.words import Slice, mix, slices

DAMAGED = 199
LEAST_POINTS, LEAST_COUNT, RATIO = 6, 5, 5
SALTS = 8
#: Longer runs are hashed one by one.
LONG_RUN = 64
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
SKIPS = "prefix long, suffix long, at int, first boolean, id long"
SPLITS = "prefix long, suffix long, id long"


def _crc_table() -> np.ndarray:
    """Steps of the usual crc32 for every byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


class Runs:
    """Letter runs of a slice: row, code points, and all bytes side by side."""

    def __init__(self, part: Slice):
        data = part.data
        # U+00C0 to U+00FF are the two-byte characters that start with 0xC3.
        lead = data == 0xC3
        inside = ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90)) | lead
        inside[1:] |= lead[:-1]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        first = part.offsets[:-1]
        first = first[first < len(data)]
        opens[first] = inside[first]
        starts = np.flatnonzero(opens)
        self.row = np.searchsorted(part.offsets, starts, "right") - 1
        self.data = data[inside]
        place = np.cumsum(inside)
        self.offsets = np.append(place[starts] - 1, len(self.data)).astype(np.int64)
        points = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        self.points = points[self.offsets[1:]] - points[self.offsets[:-1]]

    def strings(self) -> pa.Array:
        offsets = pa.py_buffer(self.offsets.astype(np.int64))
        return pa.Array.from_buffers(
            pa.large_string(), len(self.row), [None, offsets, pa.py_buffer(np.ascontiguousarray(self.data))]
        )

    def crc(self, at: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """crc32 of the row's seed text followed by the run, for the runs ``at``."""
        starts, sizes = self.offsets[at], np.diff(self.offsets)[at]
        state = seeds[self.row[at]] ^ np.uint32(0xFFFFFFFF)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] <= LONG_RUN]
        active, where, lengths = state[order], starts[order], sizes[order]
        for k in range(int(lengths[0]) if len(order) else 0):
            n = int(np.searchsorted(-lengths, -k, "left"))
            byte = self.data[where[:n] + k]
            active[:n] = _CRC[(active[:n] ^ byte) & np.uint32(255)] ^ (active[:n] >> np.uint32(8))
        state[order] = active
        out = state ^ np.uint32(0xFFFFFFFF)
        for i in np.flatnonzero(sizes > LONG_RUN):
            run = self.data[starts[i] : starts[i] + sizes[i]].tobytes()
            out[i] = zlib.crc32(run, int(seeds[self.row[at[i]]]))
        return out


def _counted(least_points: int, damaged: int):
    """Words of a batch, damaged ones as they read, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ["" if i is None else str(i) for i in batch.column("doc_id").to_pylist()]
            found, broken = [], []
            for part in slices(batch.column("text"), lower=True):
                runs = Runs(part)
                at = np.flatnonzero(runs.points >= least_points)
                names = ids[part.first : part.first + part.rows]
                seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in names], dtype=np.uint32)
                crc = runs.crc(at, seeds).astype(np.int64)
                hit = crc % damaged == 0
                words = runs.strings()
                found.append(words.take(pa.array(at[~hit])))
                for i, h in zip(at[hit].tolist(), crc[hit].tolist()):
                    word = words[i].as_py()
                    gap = h % len(word)
                    if len(word) > least_points:
                        broken.append(word[:gap] + word[gap + 1 :])
            found.append(pa.array(broken, pa.large_string()))
            counts = pa.chunked_array(found).value_counts()
            yield pa.RecordBatch.from_arrays(
                [pc.cast(counts.field("values"), pa.string()), counts.field("counts")], ["word", "n"]
            )

    return run


class Nodes:
    """Numbers of the trie nodes of a batch of words.

    ``prefix[first[w] + i]`` is the node of the first i letters of word w, ``suffix[first[w] + i]``
    that of the letters from i on; ``first`` leaves length + 1 places a word.
    """

    def __init__(self, words: pa.Array, salt: int):
        self.count = len(words)
        self.length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.letters = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.length + 1)])[:-1].astype(np.int64)
        text = np.concatenate([[0], np.cumsum(self.length)])[:-1].astype(np.int64)
        total = int(self.length.sum()) + self.count
        self.prefix, self.suffix = (np.full(total, mix(np.array([k], dtype=np.uint64), salt)[0]) for k in (1, 2))
        order = np.argsort(-self.length, kind="stable")
        first, text, length = self.first[order], text[order], self.length[order]
        for k in range(int(length[0]) if self.count else 0):
            n = int(np.searchsorted(-length, -k, "left"))
            here, there = first[:n] + k, first[:n] + length[:n] - k
            self.prefix[here + 1] = mix(self.prefix[here] * _SPREAD + self.letters[text[:n] + k], 81)
            self.suffix[there - 1] = mix(self.suffix[there] * _SPREAD + self.letters[text[:n] + length[:n] - 1 - k], 82)

    @property
    def whole(self) -> np.ndarray:
        """Node of each whole word, its id."""
        return self.prefix[self.first + self.length].view(np.int64)


def _ids(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("id", pa.array(Nodes(batch.column("word"), salt).whole))

    return run


def _splits(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = Nodes(batch.column("word"), salt)
            owner = np.repeat(nodes.whole, nodes.length + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.view(np.int64)) for x in (nodes.prefix, nodes.suffix, owner)], ["prefix", "suffix", "id"]
            )

    return run


def _skips(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = Nodes(batch.column("word"), salt)
            # Positions of all letters in the node arrays: every place but the last of each word.
            word = np.repeat(np.arange(nodes.count), nodes.length)
            here = np.arange(len(word)) + word
            at = here - nodes.first[word]
            opens = np.ones(len(word), dtype=bool)
            opens[1:] = (nodes.letters[1:] != nodes.letters[:-1]) | (at[1:] == 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes.prefix[here].view(np.int64)),
                    pa.array(nodes.suffix[here + 1].view(np.int64)),
                    pa.array(at.astype(np.int32)),
                    pa.array(opens),
                    pa.array(nodes.whole[word]),
                ],
                ["prefix", "suffix", "at", "first", "id"],
            )

    return run


def word_counts(docs: DataFrame, damaged: int = DAMAGED) -> DataFrame:
    """word, n of all words with enough letters and occurrences in (doc_id, text)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = plain.mapInArrow(_counted(LEAST_POINTS, damaged), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def numbered(counts: DataFrame) -> tuple[DataFrame, int]:
    """The written (word, n, id), and the salt under which no two words have the same number.

    A number is the node of a whole word. Two of a billion words share one with a probability of a few
    percent; then the numbers are made again under another salt.
    """
    counts = pin(counts, "words")
    for salt in range(SALTS):
        words = pin(counts.mapInArrow(_ids(salt), "word string, n long, id long"), "numbered")
        if words.groupBy("id").count().where("count > 1").isEmpty():
            discard(counts)
            return words, salt
        discard(words)
    raise ValueError("two words have one number under every salt")


def near_words(words: DataFrame, salt: int) -> DataFrame:
    """left_word, right_word (id, word, n) of all pairs of words that differ by one letter."""
    skips = words.select("word").mapInArrow(_skips(salt), SKIPS)
    splits = words.select("word").mapInArrow(_splits(salt), SPLITS)
    pair = ["prefix", "suffix"]
    other = skips.select(*pair, F.col("id").alias("right"))
    replaced = skips.withColumnRenamed("id", "left").join(other, pair).where("left < right")
    inserted = skips.where("first").withColumnRenamed("id", "left")
    inserted = inserted.join(splits.withColumnRenamed("id", "right"), pair).where("left <> right")
    met = replaced.select("left", "right", "at", F.lit(True).alias("replaced")).unionByName(
        inserted.select("left", "right", "at", F.lit(False).alias("replaced"))
    )
    sides = [
        words.select(F.col("id").alias(side), F.struct("id", "word", "n").alias(f"{side}_word"))
        for side in ("left", "right")
    ]
    met = met.join(sides[0], "left").join(sides[1], "right")
    rest = lambda word: F.concat(
        F.substring(word, F.lit(1), F.col("at")), F.substring(word, F.col("at") + 2, F.length(word))
    )
    left, right = F.col("left_word.word"), F.col("right_word.word")
    same = F.when(F.col("replaced"), rest(left) == rest(right)).otherwise(rest(left) == right)
    return met.where(same).select("left_word", "right_word")


def spelling_variants(docs: DataFrame, damaged: int = DAMAGED) -> DataFrame:
    """word, n, n_near, form, form_n, root of the vocabulary of (doc_id, text).

    One in ``damaged`` pairs of document and run, by their hash, loses a letter before it is counted.
    """
    words, salt = numbered(word_counts(docs, damaged))
    pairs = near_words(words, salt)
    both = F.explode(
        F.array(
            F.struct(F.col("left_word.id").alias("id"), F.col("right_word").alias("near")),
            F.struct(F.col("right_word.id").alias("id"), F.col("left_word").alias("near")),
        )
    ).alias("link")
    # The least of (-n, word) is the most frequent word, of ties the first in code-point order.
    best = F.min(F.struct((-F.col("link.near.n")).alias("less"), "link.near.word", "link.near.id"))
    near = pairs.select(both).groupBy("link.id").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = words.join(near, "id", "left").select(
        "id",
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best")).alias("best"),
    )
    known = pin(
        known.select(
            "id", "word", "n", "n_near", F.col("best.word").alias("form"),
            (-F.col("best.less")).alias("form_n"), F.col("best.id").alias("form_id"),
        ),
        "known_words",
    )
    roots = _roots(known.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("root_id")))
    names = words.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    return (
        known.join(roots, "id", "left")
        .join(names, "root_id", "left")
        .select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
    )


def _roots(steps: DataFrame) -> DataFrame:
    """The end of each chain (id, root_id); every round doubles the steps taken."""
    steps = pin(steps, "roots")
    while True:
        onward = steps.select(F.col("id").alias("root_id"), F.col("root_id").alias("further"))
        jumped = pin(
            steps.join(onward, "root_id", "left").select(
                "id", F.coalesce("further", "root_id").alias("root_id"), F.col("further").isNotNull().alias("moved")
            ),
            "roots",
        )
        discard(steps)
        steps = jumped.select("id", "root_id")
        if jumped.where("moved").isEmpty():
            return steps
