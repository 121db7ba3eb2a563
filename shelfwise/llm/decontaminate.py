"""Benchmark passages in documents, exact or edited: CGK embedding, bit sampling, edit distance.

Method. The CGK embedding walks over a string: each step writes the current character and moves on
or stays by a random bit that depends on the step and the character. Strings at a small edit
distance get embeddings at a small Hamming distance, because walks that an edit has parted meet
again. Every word start of a document opens a window as long as an item; its embedding is sampled
at ``SAMPLE`` of the first ``DEPTH`` coordinates, ``TABLES`` times, and looked up among the same
samples of the items. An item is indexed at each of its word starts, so an item of forty words
repeats the search forty times and only an unusually even spread of edits escapes all of them.
Candidates pass if one of ``WALKS`` independent embeddings of the aligned rest agrees in
``AGREE`` of its coordinates. Survivors are verified exactly: the least edit distance of the item
to any part of the text around the window, by bit-parallel dynamic programming over characters, must
be at most ``MOST_EDITS`` of the item's length. ``tests/llm`` measures the recall on edited copies.

Items of up to ``FEW`` characters have too few word starts for that. They are found by the count of
their grams of 3 bytes, or 4 above ``GRAM_CHARS`` characters: an edit changes a bounded number of grams and
shifts the others by a bounded distance, so a copy has a known number of grams within a narrow band of
shifts. All places with as many are verified, so none of these items is missed.

Texts and items are compared in lower case (A-Z) with runs of white space as one space.

Scale. Documents are read once per block of items and never shuffled. A block holds at most
``BLOCK_BYTES`` of item text, checked before it is gathered and sent to the tasks; larger benchmarks
take several passes. Python works on arrays of windows; only survivors are handled one by one. The
result is one row per document and item.

Rules for odd rows. Null and empty texts match nothing, nor do null items and those with fewer than
``SHORTEST`` characters. Rows without doc_id or item_id are left out of ``contaminated``; the filter
``without_contaminated`` needs no doc_id. Repeated documents match alike and give one row per doc_id
and item_id, as repeated items do. Other columns are ignored or, by the filter, passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.words import Slice, mix, slices

DEPTH, SAMPLE, TABLES = 24, 16, 4
REST, WALKS, AGREE = 96, 3, 0.55
MOST_EDITS = 0.2
SHORTEST = 24
FEW, GRAM_CHARS, GRAM_BITS = 80, 40, 20
LONG_WORD = 32
BLOCK_BYTES = 8 << 20
CHUNK = 1 << 15
FILTER_BITS = 20
SCHEMA = "doc_id long, item_id long, edits int, item_chars int"
_SPREAD = np.uint64(0x9FB21C651E98DF25)


def _moves(seed: int, steps: int) -> np.ndarray:
    """Random bit per step and character."""
    codes = np.arange(steps * 256, dtype=np.uint64)
    return (mix(codes, 1000 + seed) >> np.uint64(63)).astype(np.int32).reshape(steps, 256)


def _masks() -> np.ndarray:
    """Bytes of the coordinates that each table samples, as words."""
    out = np.zeros((TABLES, DEPTH), dtype=np.uint8)
    for t in range(TABLES):
        out[t, np.argsort(mix(np.arange(DEPTH, dtype=np.uint64), 2000 + t))[:SAMPLE]] = 255
    return out.view(np.uint64)


_KEY_MOVES, _MASKS = _moves(0, DEPTH), _masks()
_REST_MOVES = [_moves(1 + w, REST) for w in range(WALKS)]


def normalised(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with single spaces, padded for the walks; row offsets; window starts."""
    starts, ends, rows = part.word_spans()
    inside = np.zeros(len(part.data) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1  # a word's end is never another word's start
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool) if len(part.data) else np.zeros(0, bool)
    keep = inside.copy()
    gaps = ends[:-1][rows[1:] == rows[:-1]]  # one space after each word but a row's last
    keep[gaps] = True
    text = np.where(inside, part.data, 32).astype(np.uint8)[keep]
    place = np.concatenate([[0], np.cumsum(keep)])
    opens = place[starts]
    long = np.flatnonzero(ends - starts >= LONG_WORD)
    if len(long):
        more = [np.arange(opens[i] + 1, opens[i] + ends[i] - starts[i] - LONG_WORD // 2) for i in long]
        opens = np.sort(np.concatenate([opens, *more]))
    return np.append(text, np.zeros(REST + DEPTH, dtype=np.uint8)), place[part.offsets], opens


def window_keys(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[table, window] hash of the sampled coordinates of the embedding."""
    codes = np.empty((len(starts), DEPTH), dtype=np.uint8)
    at = starts.astype(np.int32)
    for step in range(DEPTH):
        char = np.take(text, at)
        codes[:, step] = char
        at += np.take(_KEY_MOVES[step], char)
    # Eight coordinates are one word; a table's sample is a mask of bytes.
    words = codes.view(np.uint64)
    keys = np.empty((TABLES, len(starts)), dtype=np.uint64)
    for t in range(TABLES):
        keys[t] = 0
        for k in range(words.shape[1]):
            keys[t] = (keys[t] + (words[:, k] & _MASKS[t, k])) * _SPREAD
            keys[t] ^= keys[t] >> np.uint64(29)
        keys[t] *= _SPREAD
    return keys


def _rest_agrees(text: np.ndarray, at: np.ndarray, items: np.ndarray, item_at: np.ndarray, item_end: np.ndarray) -> np.ndarray:
    """Whether some embedding of both rests agrees in enough coordinates of the item's."""
    fine = np.zeros(len(at), dtype=bool)
    for moves in _REST_MOVES:
        todo = np.flatnonzero(~fine)
        x, y, end = at[todo].astype(np.int32), item_at[todo].astype(np.int32), item_end[todo].astype(np.int32)
        same, steps = np.zeros(len(todo), dtype=np.int16), np.zeros(len(todo), dtype=np.int16)
        for step in range(REST):
            a, b = np.take(text, x), np.take(items, y)
            live = y < end
            same += (a == b) & live
            steps += live
            x += np.take(moves[step], a)
            y += np.take(moves[step], b)
        fine[todo] = same >= AGREE * steps
    return fine


class GramIndex:
    """Grams of short items with their offsets."""

    def __init__(self, gram: int):
        self.gram, self.codes, self.offsets, self.owners = gram, [], [], []
        self.items, self.least, self.band = [], [], []

    def add(self, body: np.ndarray, word: str, number: int, most: int) -> None:
        widest = sorted((len(c.encode()) for c in word), reverse=True)[:most]
        codes = self._hashed(body)
        self.codes.append(codes)
        self.offsets.append(np.arange(len(codes)))
        self.owners.append(np.full(len(codes), len(self.items)))
        self.items.append(number)
        # Grams that no edit touches; an edit shifts what follows by a character's bytes.
        self.least.append(max(1, len(codes) - sum(w + self.gram - 1 for w in widest)))
        self.band.append(4 * most)

    def close(self) -> None:
        if self.items:
            codes = np.concatenate(self.codes)
            order = np.argsort(codes, kind="stable")
            self.offsets, self.owners = np.concatenate(self.offsets)[order], np.concatenate(self.owners)[order]
            self.first = np.searchsorted(codes[order], np.arange((1 << GRAM_BITS) + 1)).astype(np.int32)
            self.least, self.band = np.array(self.least), np.array(self.band)
        self.codes = None

    def _hashed(self, text: np.ndarray) -> np.ndarray:
        n = max(0, len(text) - self.gram + 1)
        whole = text.astype(np.uint32)
        gram = whole[:n]
        for k in range(1, self.gram):
            gram = gram << np.uint32(8) | whole[k : n + k]
        return (gram * np.uint32(0x9E3779B1) >> np.uint32(32 - GRAM_BITS)).astype(np.int32)

    def places(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and where they would begin, for bands of shifts with enough grams."""
        codes = self._hashed(text)
        left = self.first[codes]
        count = self.first[codes + 1] - left
        hit = np.flatnonzero(count)
        count = count[hit]
        entry = np.arange(count.sum()) + np.repeat(left[hit] - np.cumsum(count) + count, count)
        item, begin = self.owners[entry], np.repeat(hit, count) - self.offsets[entry]
        size = len(text) + FEW * 8
        key = np.sort(item * size + begin + FEW * 4)
        item, begin = key // size, key % size - FEW * 4
        last = np.arange(len(key)) + self.least[item] - 1
        fits = np.flatnonzero(last < len(key))
        found = fits[key[last[fits]] - key[fits] <= self.band[item[fits]]]
        found = found[item[last[found]] == item[found]]
        return item[found], begin[found]


class ItemIndex:
    """Sampled embeddings of the items of a block at each of their word starts."""

    def __init__(self, items: list[tuple[int, str]], most_edits: float = MOST_EDITS):
        texts = pa.array([t for _, t in items], pa.large_string())
        self.ids, self.chars, bodies, starts, ends, owners = [], [], [], [], [], []
        self.few = [GramIndex(3), GramIndex(4)]
        size = 0
        for part in slices(texts, lower=True):
            text, offsets, opens = normalised(part)
            owner = np.searchsorted(offsets, opens, "right") - 1
            for row in range(part.rows):
                body = text[offsets[row] : offsets[row + 1]]
                word = body.tobytes().decode(errors="replace")
                if len(word) < SHORTEST:
                    continue
                own = opens[owner == row] - offsets[row]
                own = own[own <= max(0, len(body) - SHORTEST // 2)]
                number = len(self.ids)
                self.ids.append(items[part.first + row][0])
                self.chars.append(word)
                if len(word) <= FEW:
                    self.few[len(word) > GRAM_CHARS].add(body, word, number, int(most_edits * len(word)))
                    continue
                bodies += [body, np.zeros(REST + DEPTH, dtype=np.uint8)]
                starts.append(own + size)
                ends.append(np.full(len(own), size + len(body)))
                owners.append(np.full(len(own), number))
                size += len(body) + REST + DEPTH
        for grams in self.few:
            grams.close()
        join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
        self.data = np.concatenate(bodies) if bodies else np.zeros(1, dtype=np.uint8)
        self.starts, self.ends, self.owners = join(starts), join(ends), join(owners)
        begin = {}
        for s, o in zip(self.starts.tolist(), self.owners.tolist()):
            begin.setdefault(o, s)
        self.before = self.starts - np.array([begin[o] for o in self.owners.tolist()], dtype=np.int64)
        keys = window_keys(self.data, self.starts)
        self.order = np.argsort(keys, axis=1)
        self.keys = np.take_along_axis(keys, self.order, axis=1)
        self.filter = np.zeros((TABLES, 1 << FILTER_BITS), dtype=bool)
        for t in range(TABLES):
            self.filter[t, (self.keys[t] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def short(self, text: np.ndarray, offsets: np.ndarray, most_edits: float) -> set[tuple[int, int, int]]:
        """Row, item and proposed begin of places that may hold a short item."""
        out = set()
        for grams in self.few:
            if not grams.items:
                continue
            item, begin = grams.places(text)
            slacks = np.array([_slack(int(most_edits * len(self.chars[n]))) for n in grams.items])[item]
            step = np.unique(item * (1 << 40) + begin // slacks + (1 << 20))
            for key in step.tolist():
                k, at = key >> 40, (key & (1 << 40) - 1) - (1 << 20)
                number = grams.items[k]
                slack = _slack(int(most_edits * len(self.chars[number])))
                # The copy begins within a slack of a place in [at, at + 1) slacks; its rows are those there.
                low, high = (at - 1) * slack, (at + 2) * slack + 4 * FEW
                first, stop = np.searchsorted(offsets, [max(0, low), max(0, high)], "right") - 1
                for row in range(int(first), min(int(stop), len(offsets) - 2) + 1):
                    out.update((row, number, (at + j) * slack) for j in (-1, 0, 1))
        return out

    def candidates(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window starts and index entries that share a sample and agree further on."""
        where, entries = [], []
        for low in range(0, len(starts), CHUNK):
            part = starts[low : low + CHUNK]
            keys = window_keys(text, part)
            for t in range(TABLES):
                hit = np.flatnonzero(self.filter[t, (keys[t] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                left = np.searchsorted(self.keys[t], keys[t, hit], "left")
                count = np.searchsorted(self.keys[t], keys[t, hit], "right") - left
                total = int(count.sum())
                if total:
                    within = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                    entries.append(self.order[t, np.repeat(left, count) + within])
                    where.append(np.repeat(part[hit], count))
        if not where:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at, entry = np.concatenate(where), np.concatenate(entries)
        both = np.unique(at * len(self.starts) + entry)
        at, entry = both // len(self.starts), both % len(self.starts)
        fine = _rest_agrees(text, at, self.data, self.starts[entry], self.ends[entry])
        return at[fine], entry[fine]


def least_edits(pattern: str, text: str, most: int) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text``, or most + 1 if above.

    One bit per character of the pattern: the vertical differences of a column of the dynamic
    programme, +1 and -1, advance by a few operations on whole integers per character of the text.
    """
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    masks: dict[str, int] = {}
    for i, char in enumerate(pattern):
        masks[char] = masks.get(char, 0) | 1 << i
    plus, minus, score, least = full, 0, n, n
    for char in text:
        equal = masks.get(char, 0)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        score += bool(up & top) - bool(down & top)
        least = min(least, score)
        up, down = up << 1 & full, down << 1 & full
        vertical = equal | minus
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return least if least <= most else most + 1


def _found(items: ItemIndex, texts: pa.Array, most_edits: float) -> Iterator[tuple[int, int, int]]:
    """Row, number of the item and least edits of every item that a text holds."""
    if not items.ids:
        return
    for part in slices(texts, lower=True):
        text, offsets, starts = normalised(part)
        at, entry = items.candidates(text, starts)
        rows = np.searchsorted(offsets, at, "right") - 1
        groups: dict[tuple[int, int], set[int]] = {}
        for row, item, begin in zip(rows.tolist(), items.owners[entry].tolist(), (at - items.before[entry]).tolist()):
            groups.setdefault((row, item), set()).add(begin)
        for row, item, begin in items.short(text, offsets, most_edits):
            groups.setdefault((row, item), set()).add(begin)
        for (row, item), begins in groups.items():
            edits = _verify(text, int(offsets[row]), int(offsets[row + 1]), items.chars[item], begins, most_edits)
            if edits is not None:
                yield part.first + row, item, edits


def _matches(index, most_edits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: ItemIndex = index.value
        for batch in batches:
            docs = batch.column("doc_id")
            out = [
                (docs[row].as_py(), items.ids[item], edits, len(items.chars[item]))
                for row, item, edits in _found(items, batch.column("text"), most_edits)
            ]
            names = ["doc_id", "item_id", "edits", "item_chars"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _clean(index, most_edits: float, text: int):
    """The rows whose text, in column ``text``, holds no item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for row, _, _ in _found(index.value, batch.column(text), most_edits):
                keep[row] = False
            yield batch.filter(pa.array(keep))

    return run


def _slack(most: int) -> int:
    """Bytes: a shift of ``most`` characters."""
    return 4 * most + 4


def _verify(text: np.ndarray, low: int, high: int, item: str, begins: set[int], most_edits: float) -> int | None:
    """Least edits over the regions around the proposed starts of the item; regions are merged."""
    most = int(most_edits * len(item))
    size = len(item.encode())
    slack = _slack(most)
    least, done = most + 1, low
    for begin in sorted(begins):
        start, stop = max(low, begin - slack, done), min(high, begin + size + slack)
        if stop <= done or stop <= start:
            continue
        region = text[start:stop].tobytes().decode(errors="ignore")
        least = min(least, least_edits(item, region, most))
        if not least:
            break
        done = max(done, stop - size - 2 * slack)
    return least if least <= most else None


def _indexes(benchmark: DataFrame, most_edits: float) -> Iterator:
    """Broadcast indexes of blocks of the benchmark's items."""
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where(f"item_id IS NOT NULL AND length(text) >= {SHORTEST}").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // BLOCK_BYTES))
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text")
        yield spark.sparkContext.broadcast(ItemIndex([(r.item_id, r.text) for r in mine.collect()], most_edits))


def contaminated(docs: DataFrame, benchmark: DataFrame, most_edits: float = MOST_EDITS) -> DataFrame:
    """doc_id, item_id, edits, item_chars of all documents (doc_id, text) that hold an item."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = None
    for index in _indexes(benchmark, most_edits):
        part = docs.mapInArrow(_matches(index, most_edits), SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(
        F.min("edits").alias("edits"), F.max("item_chars").alias("item_chars")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, most_edits: float = MOST_EDITS) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text holds no item.

    The decision is taken on the row, so rows without doc_id go as well. Rows pass one task per block
    of items and are not shuffled.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    for index in _indexes(benchmark, most_edits):
        docs = docs.mapInArrow(_clean(index, most_edits, docs.columns.index("text")), docs.schema)
    return docs
