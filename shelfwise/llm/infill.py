"""Fill-in-middle transformation by a secondary sort of text pieces.

Method. A text is a sequence of units: runs of ASCII letters, and every other code point by itself.
Two unit positions, drawn from a hash of the document's id, cut it into prefix, middle and suffix.
A first pass emits pieces of at most ``UNITS`` units and ``PIECE_BYTES`` bytes, and the markers,
keyed by document and position in the output. ``repartition`` and ``sortWithinPartitions`` (the
DataFrame form of repartitionAndSortWithinPartitions) bring the pieces of a document to one task in
output order, where they stream into an incremental digest. That task knows the sections only by
the markers it reads; it gives every piece its position in the restored text, and a second sort, of
the rows that the task holds, streams the restored text into its digest.

Scale. One exchange of the text, no join. A task holds one batch of pieces and one open digest,
however long a text is; documents are dealt by a 128-bit digest of their text, so copies under
different ids, rows of one source and rows without id spread. Spark's sort spills.

Rules for odd rows. Null texts are empty; empty texts are plain with no units. Rows without doc_id
are cut as if the id were the empty string. Rows that repeat doc_id and text are one document to
the sort and come out as often as they went in; rows that repeat only the doc_id are cut by the
same hashes, each by its own length. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.words import Slice, slices

UNITS, PIECE_BYTES = 8192, 64 << 10
PLAIN_PERCENT, SPM_PERCENT = 10, 20
BATCH_BYTES, BATCH_ROWS = 4 << 20, 16384
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = ["plain", "psm", "spm"]
#: Bytes of white space are read as any other code point here.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SECTION = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: Positions of a section's pieces in the restored text start here; the summary comes after all.
_SECTION_SPAN = 1 << 40
_SUMMARY = 4 * _SECTION_SPAN
KEY = ["doc_id", "print_high", "print_low"]
#: ``place`` orders the pieces; the other columns describe the document and repeat in its pieces.
PIECES = (
    "doc_id long, print_high long, print_low long, place long, piece binary, "
    "form byte, n long, prefix_chars long, middle_chars long"
)
ASSEMBLED = PIECES + ", copies int, output_sha256 string, output binary"
RESULT = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
    "output_sha256 string, restored_sha256 string, output string"
)


def _seeds(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else b"%d" % doc_id)).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def _unit_starts(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions where units start, code points before every byte, bounds of rows in the starts."""
    data = part.data
    letter = _LETTER[data]
    opens = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(opens)])
    inside = np.zeros(len(data), dtype=bool)
    inside[1:] = letter[1:] & letter[:-1]
    first = part.offsets[:-1]
    inside[first[first < len(data)]] = False
    starts = np.flatnonzero(opens & ~inside)
    return starts, points, np.searchsorted(starts, part.offsets)


def _cut(low: int, high: int, edges: np.ndarray, units: int, size: int) -> list[tuple[int, int]]:
    """Bytes low to high in pieces that end at one of ``edges`` where a unit is not too long for that."""
    if high - low <= size and len(edges) <= units:
        return [(low, high)] if high > low else []
    out = []
    while low < high:
        at = np.searchsorted(edges, low, "right")
        stop = int(edges[at + units - 1]) if at + units - 1 < len(edges) else high
        if stop - low > size:
            fit = int(np.searchsorted(edges, low + size, "right")) - 1
            stop = int(edges[fit]) if fit >= at else low + size
        out.append((low, min(stop, high)))
        low = out[-1][1]
    return out


class _Rows:
    """Rows gathered for Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.size += size

    @property
    def full(self) -> bool:
        return self.size >= BATCH_BYTES or len(self.rows) >= BATCH_ROWS

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(self.schema)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema)]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "byte": pa.int8(), "binary": pa.binary(), "string": pa.string(),
}


def _arrow(schema: str) -> pa.Schema:
    """Arrow twin of a schema string of the flat types used here."""
    return pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in schema.split(", ")])


def _pieces(units: int, size: int):
    """Pieces and markers of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(_arrow(PIECES))
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for part in slices(batch.column("text")):
                starts, points, bounds = _unit_starts(part)
                every = part.data.tobytes()
                for row in range(part.rows):
                    low, high = int(part.offsets[row]), int(part.offsets[row + 1])
                    first, n = int(bounds[row]), int(bounds[row + 1] - bounds[row])
                    text, doc_id = every[low:high], ids[part.first + row]
                    h1, h2, h3, h4 = _seeds(doc_id)
                    marked = PREFIX in text or SUFFIX in text or MIDDLE in text
                    edges = np.append(starts[first : first + n], high)
                    if not text or marked or h3 % 100 >= 100 - PLAIN_PERCENT:
                        form, chars, order = 0, (None, None), [(b"", low, high)]
                    else:
                        one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
                        a, b = int(edges[one]), int(edges[two])
                        chars = int(points[a] - points[low]), int(points[b] - points[a])
                        form = 2 if h4 % 100 < SPM_PERCENT else 1
                        prefix, suffix = (PREFIX, low, a), (SUFFIX, b, high)
                        order = [*((suffix, prefix) if form == 2 else (prefix, suffix)), (MIDDLE, a, b)]
                    digest = hashlib.blake2b(text, digest_size=16).digest()
                    key = (
                        doc_id,
                        int.from_bytes(digest[:8], "big", signed=True),
                        int.from_bytes(digest[8:], "big", signed=True),
                    )
                    place = 0
                    for marker, start, stop in order:
                        # Every section opens with its marker; a plain text with an empty piece.
                        for piece in (marker, *(every[s:e] for s, e in _cut(start, stop, edges, units, size))):
                            out.add((*key, place, piece, form, n, *chars), len(piece) + 64)
                            place += 1
                            if out.full:
                                yield out.take()
        yield out.take()

    return run


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of a sorted partition with the number of times each occurs.

    The pieces of a document that was given several times lie side by side.
    """
    last, copies = None, 0
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[:4] == last:
                copies += 1
                continue
            if last is not None:
                yield (*held, copies)
            held, last, copies = row, row[:4], 1
    if last is not None:
        yield (*held, copies)


def _assembled(keep_text: bool):
    """Digest of each output, and its pieces at their places in the restored text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(_arrow(ASSEMBLED))
        open_key, digest, text, about, copies, place = None, None, [], (), 0, 0

        def summary() -> tuple:
            whole = b"".join(text) if keep_text else None
            return (*open_key, _SUMMARY, None, *about, copies, digest.hexdigest(), whole)

        for row in _streams(batches):
            key, piece, form, copies_here = row[:3], row[4], row[5], row[-1]
            if key != open_key:
                if open_key is not None:
                    out.add(summary(), 200 + sum(map(len, text)))
                open_key, digest, text, place = key, hashlib.sha256(), [], 0
            about, copies = row[5:9], copies_here
            digest.update(piece)
            if keep_text:
                text.append(piece)
            if form and piece in _SECTION:
                place = _SECTION[piece] * _SECTION_SPAN
            elif piece:
                out.add((*key, place, piece, None, None, None, None, None, None, None), len(piece) + 64)
                place += 1
            if out.full:
                yield out.take()
        if open_key is not None:
            out.add(summary(), 0)
        yield out.take()

    return run


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document: the pieces stream into its digest until the summary closes it."""
    out = _Rows(_arrow(RESULT))
    digest = hashlib.sha256()
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            doc_id, place, piece = row[0], row[3], row[4]
            if place != _SUMMARY:
                digest.update(piece)
                continue
            form, n, prefix, middle, copies, output_digest, text = row[5:12]
            whole = None if text is None else text.decode()
            answer = (doc_id, n, FORMS[form], prefix, middle, output_digest, digest.hexdigest(), whole)
            for _ in range(copies):
                out.add(answer, 200 + len(text or b""))
            digest = hashlib.sha256()
            if out.full:
                yield out.take()
    yield out.take()


def output_pieces(docs: DataFrame, units: int = UNITS, size: int = PIECE_BYTES) -> DataFrame:
    """Pieces of the outputs of (doc_id, text): in the order of ``place`` they are the output.

    A piece has at most ``units`` units and ``size`` bytes.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_pieces(units, size), PIECES)


def fill_in_middle(
    docs: DataFrame, keep_text: bool = False, units: int = UNITS, size: int = PIECE_BYTES
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n, form, section lengths, digests and the output.

    ``output`` is null unless ``keep_text``; then a document's output is built as one value.
    """
    by_output = output_pieces(docs, units, size).repartition(*KEY).sortWithinPartitions(*KEY, "place")
    # The pieces of a document stay in their task, so restoration needs no second exchange.
    by_source = by_output.mapInArrow(_assembled(keep_text), ASSEMBLED).sortWithinPartitions(*KEY, "place")
    return by_source.mapInArrow(_restored, RESULT)


def restored_text(form: Column, output: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    after = lambda marker: F.substring_index(output, marker, -1)
    until = lambda text, marker: F.substring_index(text, marker, 1)
    psm = F.concat(until(after("<P>"), "<S>"), after("<M>"), until(after("<S>"), "<M>"))
    spm = F.concat(until(after("<P>"), "<M>"), after("<M>"), until(after("<S>"), "<P>"))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
