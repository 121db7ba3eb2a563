"""Line deduplication by a log-template tree.

Method. A line is a sequence of tokens; tokens with a digit are variable from the start. The tree
has a fixed depth: the number of tokens, then the first ``LEADING`` tokens. In each leaf the line
that most documents have leads a template; lines of the leaf that agree with it in ``ALIKE`` of the
positions belong to it, and the other positions are variable fields. What is left elects the next
leader until no line is left. A template that occurs in ``LEAST_DOCS`` documents, or with lines of
``MANY_TOKENS`` tokens in ``LEAST_DOCS_MANY``, is dropped everywhere but in the document with the smallest
doc_id.

Leaves of more than ``SMALL`` lines or ``SMALL_BYTES`` of tokens are split by token values: the tokens
after the leading ones are cut into one block more than two alike lines may differ in, so that alike
lines share a block. In each round, each slot of a block names its line of most documents; named in all
its blocks and unlike all better named ones of them, a line leads, and every line alike a leader joins
the one of most documents. Leaders of a round are mutually unlike, at least one line of each leaf is
among them, and rounds go on until every line has a leader. The number of slots doubles with each
round up to ``MOST_SLOTS``, so a leaf of 10,000 lines that are all unlike takes nine rounds. A line
alike two leaders may join another one here than it would in a small leaf.

Scale. Texts are read in tasks that reduce lines to hashes; leaves and lines are partial aggregates,
so a leaf or line that a third of all documents share is one row a task. Tokens are built only for
lines of leaves that enough documents reach, selected by a bit map of constant size. Texts move only
for documents that lose lines, selected likewise; of the others only the lines are counted. No more
than ``SMALL`` lines of a leaf or ``MOST_SLOTS`` of a block are ever collected.

Rules for odd rows. Null texts stay null, empty ones empty. Lines with fewer than ``LEAST_TOKENS``
tokens, blank ones too, always stay. Rows without doc_id are passed on unchanged and do not count.
Rows that repeat a doc_id are one document and lose the same lines. A document may lose all its
lines; it stays with an empty text. Other columns are passed on.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.lineage import discard, pin
from shelfwise.llm.bitmap import bit_map, marked, place
from shelfwise.llm.words import Slice, mix, slices, span_hashes

LEADING, ALIKE = 3, 0.7
SMALL, SMALL_BYTES = 4096, 8 << 20
SLOTS, MOST_SLOTS = 32, 8192
LEAST_DOCS, LEAST_TOKENS = 3, 4
LEAST_DOCS_MANY, MANY_TOKENS = 2, 20
VARIABLE = np.uint64(0x5EED)
_NEWLINE = 10
#: Tokens compared at once.
COMPARED = 1 << 22
GONE, PLACE, LOSER = "__lines_gone", "__doc_place", "__loser"
LEAF_BITS = 23
LINES = "doc_id long, leaf long, line long, many boolean"
TOKENS = "leaf long, line long, tokens binary"


def _running(marks: np.ndarray) -> np.ndarray:
    """Number of marks before each byte."""
    out = np.zeros(len(marks) + 1, dtype=np.int32)
    np.cumsum(marks, out=out[1:])
    return out


def _lines(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and line numbers of all words, and the first word of each line that has any.

    Lines are numbered through the slice; a new row opens a new line.
    """
    starts, ends, rows = part.word_spans()
    number = _running(part.data == _NEWLINE)[starts] + rows
    opens = np.ones(len(number), dtype=bool)
    opens[1:] = number[1:] != number[:-1]
    return starts, ends, rows, number, np.flatnonzero(opens)


class Lines:
    """Lines with enough tokens in a slice: number within the slice, row, hashes and tokens."""

    def __init__(self, part: Slice):
        starts, ends, rows, number, first = _lines(part)
        digits = _running(part.data - np.uint8(48) < 10)
        words = span_hashes(part.prefix_hashes(), starts, ends)
        words[digits[ends] > digits[starts]] = VARIABLE
        count = np.diff(np.append(first, len(number)))
        self.words, self.first, self.count = words, first, count
        self.number, self.row = number[first], rows[first]
        place_in_line = np.arange(len(words)) - np.repeat(first, count)
        spread = mix(words + place_in_line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.line = mix(np.add.reduceat(spread, first), 61) if len(first) else spread
        leaf = mix(count.astype(np.uint64), 62)
        for k in range(LEADING):
            at = np.minimum(first + k, max(0, len(words) - 1))
            leaf = mix(leaf, 63 + k) + np.where(k < count, words[at] if len(words) else 0, np.uint64(0))
        self.leaf = mix(leaf)
        self.long = count >= LEAST_TOKENS
        self.many = count >= MANY_TOKENS

    def tokens(self, i: int) -> bytes:
        return self.words[self.first[i] : self.first[i] + self.count[i]].astype(np.uint32).tobytes()


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct long lines of each row."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for part in slices(batch.column("text")):
            found = Lines(part)
            rows, lines, leaves = (x[found.long] for x in (found.row, found.line, found.leaf))
            order = np.lexsort((lines, rows))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (rows[order][1:] != rows[order][:-1]) | (lines[order][1:] != lines[order][:-1])
            keep = order[new]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[part.first + rows[keep]]),
                    pa.array(leaves[keep].view(np.int64)),
                    pa.array(lines[keep].view(np.int64)),
                    pa.array(found.many[found.long][keep]),
                ],
                ["doc_id", "leaf", "line", "many"],
            )


def _line_tokens(wanted):
    """leaf, line and tokens of lines whose leaf is wanted, once a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        for batch in batches:
            for part in slices(batch.column("text")):
                found = Lines(part)
                at = np.flatnonzero(found.long & known[_leaf_place(found.leaf)])
                at = at[np.unique(found.line[at], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.leaf[at].view(np.int64)),
                        pa.array(found.line[at].view(np.int64)),
                        pa.array([found.tokens(i) for i in at], pa.binary()),
                    ],
                    ["leaf", "line", "tokens"],
                )

    return run


def _leaf_place(leaf: np.ndarray) -> np.ndarray:
    return (leaf >> np.uint64(64 - LEAF_BITS)).astype(np.int64)


def _leaf_map(leaves: DataFrame):
    """Constant-size table of the leaves' first bits; others with the same bits pass too."""
    first = leaves.select(F.shiftrightunsigned("leaf", 64 - LEAF_BITS).alias("bits")).distinct().toArrow()
    known = np.zeros(1 << LEAF_BITS, dtype=bool)
    known[first.column("bits").to_numpy()] = True
    return leaves.sparkSession.sparkContext.broadcast(known)


def _agree(x: np.ndarray, y: np.ndarray, share: float) -> bool:
    return len(x) == len(y) and bool((x == y).sum() >= share * len(x))


def _words(tokens: bytes) -> np.ndarray:
    return np.frombuffer(tokens, dtype=np.uint32)


def _leaf_templates(share: float):
    """line, template of all lines of a small leaf."""

    def run(leaf: pa.Table) -> pa.Table:
        line, docs = leaf.column("line").to_numpy(), leaf.column("n_docs").to_numpy()
        words = [_words(x) for x in leaf.column("tokens").to_pylist()]
        sizes, template = np.array([len(x) for x in words]), line.copy()
        best = np.lexsort((line, docs))[::-1]
        for size in np.unique(sizes):
            left = best[sizes[best] == size]
            rows = np.stack([words[i] for i in left])
            while len(left):
                joined = (rows == rows[0]).sum(axis=1) >= share * size
                template[left[joined]] = line[left[0]]
                left, rows = left[~joined], rows[~joined]
        return pa.table({"line": line, "template": template})

    return run


def _block_keys(share: float):
    """Lines with hashes of blocks of their tokens; alike lines of a leaf have one in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for leaf, tokens in zip(batch.column("leaf").to_pylist(), batch.column("tokens").to_pylist()):
                words = _words(tokens)
                blocks = len(words) - math.ceil(share * len(words)) + 1
                # With fewer tokens than blocks, all lines of the leaf may be alike.
                parts = np.array_split(words[LEADING:], blocks) if blocks <= len(words) - LEADING else [words[:0]]
                hashed = [hashlib.blake2b(x.tobytes(), digest_size=8, salt=b"%d" % i, key=b"%d" % leaf) for i, x in enumerate(parts)]
                keys.append([int.from_bytes(x.digest(), "little", signed=True) for x in hashed])
            columns = [batch.column(c) for c in ("line", "n_docs", "tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(keys, pa.list_(pa.int64()))], ["line", "n_docs", "tokens", "keys"]
            )

    return run


def _unlike_better(share: float):
    """Of the lines that a block names, those unlike all better ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            free = []
            for named in batch.column("named"):
                # A block's lines are of one leaf and have as many tokens.
                named = sorted(named.as_py(), key=lambda x: (x["n_docs"], x["line"]), reverse=True)
                words = np.stack([_words(x["tokens"]) for x in named])
                step = max(1, COMPARED // words.size)
                for low in range(0, len(named), step):
                    rows = words[low : low + step]
                    agree = (rows[:, None, :] == words[None, : low + len(rows), :]).sum(axis=2) >= share * words.shape[1]
                    better = np.arange(low + len(rows))[None, :] < (low + np.arange(len(rows)))[:, None]
                    free += [named[low + i]["line"] for i in np.flatnonzero(~(agree & better).any(axis=1)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(free, pa.int64())], ["line"])

    return run


def _alike(share: float):
    """line, template where a line agrees with the leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = np.zeros(batch.num_rows, dtype=bool)
            for i, (a, b) in enumerate(zip(batch.column("tokens"), batch.column("leading"))):
                joined[i] = _agree(_words(a.as_buffer()), _words(b.as_buffer()), share)
            yield batch.select(["line", "template", "leader_docs"]).filter(pa.array(joined))

    return run


def _elect_by_blocks(left: DataFrame, alike: float) -> list[DataFrame]:
    """line, template of the lines of large leaves; a frame per round."""
    left = pin(left.mapInArrow(_block_keys(alike), "line long, n_docs long, tokens binary, keys array<long>"), "left")
    found, slots = [], SLOTS
    while not left.isEmpty():
        keyed = left.select(F.explode("keys").alias("key"), "line", "n_docs", "tokens")
        slot = F.pmod("line", F.lit(slots)).alias("slot")
        named = keyed.groupBy("key", slot).agg(F.max(F.struct("n_docs", "line", "tokens")).alias("named"))
        named = named.groupBy("key").agg(F.collect_list("named").alias("named")).select("named")
        free = named.mapInArrow(_unlike_better(alike), "line long").groupBy("line").agg(F.count(F.lit(1)).alias("n"))
        leading = left.join(free, "line").where(F.col("n") == F.size("keys"))
        leading = leading.select(
            F.explode("keys").alias("key"),
            F.col("line").alias("template"),
            F.col("n_docs").alias("leader_docs"),
            F.col("tokens").alias("leading"),
        )
        compared = keyed.join(pin(leading, "leading"), "key").select("line", "tokens", "template", "leader_docs", "leading")
        joined = compared.mapInArrow(_alike(alike), "line long, template long, leader_docs long")
        best = F.max(F.struct("leader_docs", "template"))
        found.append(pin(joined.groupBy("line").agg(best["template"].alias("template")), "joined"))
        rest = pin(left.join(found[-1], "line", "left_anti"), "left")
        discard(left)
        left, slots = rest, min(2 * slots, MOST_SLOTS)
    return found


def line_templates(
    docs: DataFrame,
    held: DataFrame,
    least_docs: int = LEAST_DOCS,
    alike: float = ALIKE,
    least_docs_many: int = LEAST_DOCS_MANY,
) -> DataFrame:
    """line, template of lines that may recur. ``held`` has the distinct (doc_id, leaf, line, many)."""
    lines = held.groupBy("leaf", "line", "many").agg(F.count(F.lit(1)).alias("n_docs"))
    lines = pin(lines.join(_busy(lines, _least(least_docs, least_docs_many)), "leaf", "left_semi").drop("many"), "lines")
    wanted = _leaf_map(lines.select("leaf"))
    tokens = docs.mapInArrow(_line_tokens(wanted), TOKENS).groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"))
    # A line alone in its leaf leads itself; its tokens are not needed.
    several = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    left = pin(lines.join(several, "leaf").join(tokens, ["leaf", "line"]), "left")
    # All lines of a leaf have as many tokens, so they are all small or none is.
    is_small = (F.col("n") <= SMALL) & (F.col("n") * F.octet_length("tokens") <= SMALL_BYTES)
    small = left.where(is_small).select("leaf", "line", "n_docs", "tokens")
    members = small.groupBy("leaf").applyInArrow(_leaf_templates(alike), "line long, template long")
    members = pin(members, "members")
    for more in _elect_by_blocks(left.where(~is_small), alike):
        members = members.unionByName(more)
    own = lines.select("line").join(members.select("line"), "line", "left_anti")
    return members.unionByName(own.select("line", F.col("line").alias("template")))


def _least(least_docs: int, least_docs_many: int) -> Column:
    """Documents from which on a template recurs."""
    return F.when(F.col("many"), least_docs_many).otherwise(least_docs)


def _busy(lines: DataFrame, least: Column) -> DataFrame:
    """Leaves that enough lines of documents reach; all lines of a leaf have as many tokens."""
    return lines.groupBy("leaf", "many").agg(F.sum("n_docs").alias("n")).where(F.col("n") >= least).select("leaf")


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines listed in the last column, and the numbers of lines and dropped ones."""
    for batch in batches:
        names = [n for n in batch.schema.names if n != GONE]
        for part in slices(batch.column("text")):
            rows = batch.slice(part.first, part.rows)
            gone, given = rows.column(GONE), rows.column("text")
            found = Lines(part)
            bounds = np.searchsorted(found.row, np.arange(part.rows + 1))
            breaks = _running(part.data == _NEWLINE)
            texts, drops = [], []
            for row in range(part.rows):
                lost, here = gone[row], slice(bounds[row], bounds[row + 1])
                start, stop = part.offsets[row], part.offsets[row + 1]
                text = part.data[start:stop].tobytes().decode()
                out: set[int] = set()
                if lost.is_valid and bounds[row + 1] > bounds[row]:
                    hashes = np.array(lost.as_py(), dtype=np.int64)
                    cut = np.isin(found.line[here].view(np.int64), hashes) & found.long[here]
                    out = set((found.number[here][cut] - row - breaks[start]).tolist())
                if out:
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)
                texts.append(text if given[row].is_valid else None)
                drops.append(len(out))
            columns = [pa.array(texts, pa.string()) if n == "text" else rows.column(n) for n in names]
            counts = [pa.array(np.diff(bounds).astype(np.int64)), pa.array(drops, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *counts], [*names, "n_lines", "n_dropped"])


def _losers(bits):
    """Rows of documents that lose lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.filter(pa.array(marked(bits.value, batch.column(PLACE).to_numpy())))
            yield keep.select([n for n in keep.schema.names if n != PLACE])

    return run


def _others(bits):
    """The other rows with their numbers of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.filter(pa.array(~marked(bits.value, batch.column(PLACE).to_numpy())))
            names = [n for n in keep.schema.names if n != PLACE]
            counts = np.zeros(keep.num_rows, dtype=np.int64)
            for part in slices(keep.column("text")):
                _, _, rows, _, first = _lines(part)
                counts[part.first : part.first + part.rows] = np.bincount(rows[first], minlength=part.rows)
            columns = [keep.column(n) for n in names]
            added = [pa.array(counts), pa.array(np.zeros(keep.num_rows, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, *added], [*names, "n_lines", "n_dropped"])

    return run


def drop_repeated_lines(
    docs: DataFrame, least_docs: int = LEAST_DOCS, alike: float = ALIKE, least_docs_many: int = LEAST_DOCS_MANY
) -> DataFrame:
    """``docs`` with shorter texts, n_lines (non-blank) and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped", GONE, PLACE, LOSER)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.where("doc_id IS NOT NULL AND text IS NOT NULL")
    held = pin(plain.mapInArrow(_line_hashes, LINES).distinct(), "lines_held")
    templates = pin(line_templates(plain, held, least_docs, alike, least_docs_many), "templates")
    inside = held.join(templates, "line").select("doc_id", "line", "template", "many")
    recurring = (
        inside.select("doc_id", "template", "many").distinct()
        .groupBy("template", "many")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("kept_in"))
        .where(F.col("n_docs") >= _least(least_docs, least_docs_many))
        .select("template", "kept_in")
    )
    # Written, so that its join with a hot template's lines can be broadcast or split.
    recurring = pin(recurring, "recurring")
    gone = inside.join(recurring, "template").where("doc_id <> kept_in")
    gone = pin(gone.groupBy(F.col("doc_id").alias(LOSER)).agg(F.collect_set("line").alias(GONE)), "gone")
    bits = bit_map(gone, LOSER)
    placed = docs.withColumn(PLACE, place(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))))
    counted = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    losing = placed.mapInArrow(_losers(bits), docs.schema)
    losing = losing.join(gone, losing["doc_id"].cast("long") == gone[LOSER], "left").drop(LOSER)
    return losing.mapInArrow(_rebuild, counted).unionByName(placed.mapInArrow(_others(bits), counted))
