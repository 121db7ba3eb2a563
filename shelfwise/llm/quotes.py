"""Quotation linking: from messages that quote each other to reply-ordered turns without quotes.

Method. Each message is parsed into lines with a quote level, the number of leading ``>``; an
attribution line ("... wrote:") before a quote belongs to the quote. Runs of lines of one level,
cut at blank lines, are passages. Passages, and single lines of at least ``LINE_WORDS`` words, are
normalised (case, white space) and hashed. A quoted hash links to the original: the first message
of the conversation that holds it as its own text, if that is an earlier turn. The parent of a
message is the latest original among its shallowest linked quotes. Parents chain to the root of a
thread; messages are ordered by the root's turn, the depth and the turn, so that every reply comes
after what it answers and threads do not interleave.

Scale. Passages are hashes from the task on. Originals are a partial aggregate, one row per
conversation and hash, so a passage that a third of all messages share is one row a task; the join with
quotes has one row per key on that side. No conversation is ever gathered: order is a sort key, not a
position. Roots and depths are found by pointer doubling over linked messages only.

Rules for odd rows. Null texts have no passages and stay null; a message of quotes alone gets an
empty text. Messages without conv_id or turn are roots of their own and link to nothing. Rows that
repeat a (conv_id, turn) are one message whose passages are united; each row is returned. Other
columns are passed on, unless they have the names of results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.lineage import pin

LINE_WORDS = 3
PREFIX = re.compile(r"[\x20\t]*((?:>[\x20\t]?)*)")
ATTRIBUTION = re.compile(r"\bwrote:\s*$|\bschrieb\b.*:\s*$|\ba écrit\s*:\s*$|\bescribió\s*:\s*$", re.IGNORECASE)
PASSAGES = "conv_id long, turn long, level int, passage long"
RESULTS = ("reply_text", "n_quotes", "n_linked", "parent_turn", "thread_turn", "depth")


def parse(text: str) -> list[tuple[int, str]]:
    """(level, line without marks) of every line; attribution lines before a quote join it."""
    lines = []
    for line in text.split("\n"):
        marks = PREFIX.match(line)
        level = marks.group(1).count(">")
        lines.append([level, line[marks.end() :] if level else line])
    for i in range(len(lines) - 1):
        after = next((lines[j][0] for j in range(i + 1, min(i + 3, len(lines))) if lines[j][1].strip() or lines[j][0]), 0)
        if after > lines[i][0] and ATTRIBUTION.search(lines[i][1]):
            lines[i] = [after, ""]
    return [(level, line) for level, line in lines]


def normal_hash(text: str) -> int:
    """64-bit hash of the text in lower case with single spaces."""
    plain = " ".join(text.casefold().split())
    return int.from_bytes(hashlib.blake2b(plain.encode(), digest_size=8).digest(), "little", signed=True)


def passages(text: str) -> set[tuple[int, int]]:
    """(level, hash) of all passages and of all lines with enough words."""
    found: set[tuple[int, int]] = set()
    run: list[str] = []
    level = 0

    def close() -> None:
        if run:
            found.add((level, normal_hash(" ".join(run))))
            run.clear()

    for at, line in parse(text):
        if at != level or not line.strip():
            close()
            level = at
        if line.strip():
            run.append(line)
            if len(line.split()) >= LINE_WORDS:
                found.add((level, normal_hash(line)))
    close()
    return found


def own_text(text: str) -> str:
    """The lines of level 0, without blank lines at the ends."""
    return "\n".join(line for level, line in parse(text) if level == 0).strip("\n")


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, turn, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "text"))):
            rows += [(conv, turn, level, value) for level, value in passages(text)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
            ["conv_id", "turn", "level", "passage"],
        )


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [None if t is None else own_text(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string())], [*batch.schema.names, "reply_text"])


def quote_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, n_quotes, n_linked, parent_turn of all messages with quotes."""
    plain = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("text").cast("string").alias("text"),
    ).where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    found = pin(plain.mapInArrow(_passages, PASSAGES), "passages")
    quoted = found.where("level > 0").distinct()
    # Only passages that something quotes can be originals.
    asked = quoted.select("conv_id", "passage").distinct()
    originals = (
        found.where("level = 0")
        .groupBy("conv_id", "passage")
        .agg(F.min("turn").alias("original"))
        .join(asked, ["conv_id", "passage"], "left_semi")
    )
    linked = quoted.join(originals, ["conv_id", "passage"], "left").withColumn(
        "original", F.when(F.col("original") < F.col("turn"), F.col("original"))
    )
    # Shallowest level first, then the latest original.
    best = F.min(F.when(F.col("original").isNotNull(), F.struct("level", (-F.col("original")).alias("back"))))
    return linked.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count("original").alias("n_linked"),
        (-best["back"]).alias("parent_turn"),
    )


def thread_roots(links: DataFrame) -> DataFrame:
    """conv_id, turn, thread_turn, depth of all messages with a parent, by pointer doubling."""
    ahead = pin(
        links.where("parent_turn IS NOT NULL").select("conv_id", "turn", F.col("parent_turn").alias("to"), F.lit(1).cast("long").alias("steps")),
        "ahead",
    )
    while True:
        further = ahead.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        jumped = pin(
            ahead.join(further, ["conv_id", "to"], "left").select(
                "conv_id",
                "turn",
                F.coalesce("next", "to").alias("to"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
                F.col("next").isNotNull().alias("moved"),
            ),
            "ahead",
        )
        ahead = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return ahead.select("conv_id", "turn", F.col("to").alias("thread_turn"), F.col("steps").alias("depth"))


def reply_order(messages: DataFrame) -> DataFrame:
    """Messages with reply_text (without quotes) and the keys of their order.

    Sorting by (conv_id, thread_turn, depth, turn) gives the conversations in reply order.
    """
    messages = messages.drop(*RESULTS)
    links = pin(quote_links(messages), "links")
    roots = thread_roots(links)
    joined = links.join(roots, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("of_conv"), F.col("turn").alias("of_turn"), "n_quotes", "n_linked", "parent_turn", "thread_turn", "depth"
    )
    text = messages.withColumn("text", F.col("text").cast("string"))
    own = text.mapInArrow(_strip, T.StructType([*text.schema.fields, T.StructField("reply_text", T.StringType())]))
    same = (own["conv_id"].cast("long") == joined["of_conv"]) & (own["turn"].cast("long") == joined["of_turn"])
    zero = F.lit(0).cast("long")
    return own.join(joined, same, "left").select(
        *(own[c] for c in messages.columns),
        own["reply_text"],
        F.coalesce("n_quotes", zero).alias("n_quotes"),
        F.coalesce("n_linked", zero).alias("n_linked"),
        "parent_turn",
        F.coalesce("thread_turn", own["turn"].cast("long")).alias("thread_turn"),
        F.coalesce("depth", zero).alias("depth"),
    )
