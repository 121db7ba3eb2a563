"""Removal of long byte strings that an earlier document holds, by sorted suffixes.

Task. A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller doc_id. All strings of the input count, at every offset, overlapping or not.

Method. Only some suffixes need sorting: every window of LENGTH bytes chooses the gram of ``GRAM``
bytes with the least hash in it as its anchor, so equal windows choose equal anchors at equal
offsets. Consecutive windows with one anchor form a fragment. Anchors that one document alone holds
need nothing; where all fragments of an anchor are equal, the least doc_id decides. For the rest
the suffixes that start at the anchors are sorted by mergesort. Two suffixes are compared by their
common extension, a binary search over prefix polynomial hashes, so a comparison takes log2(LENGTH)
hash look-ups. Every adjacent pair of the result is then verified byte by byte, order and extension
alike; a collision makes that anchor bucket sort by its bytes instead. Windows are equal if the
extensions reach to their ends and the bytes before the anchors agree, which is verified too.

Scale. Texts are never compared with each other and never meet in one task: a bucket of anchors
holds packed hashes, about 14 bytes for every 13 bytes of text, and bytes only of fragments whose
anchor has different contexts. Answers return to the documents by buckets of doc_id. There is a bucket
for each ``BUCKET_BYTES`` of text, so what a task holds does not grow. A passage that very many
documents share spreads over as many buckets as it has anchors; each holds a few bytes a document.

Rules for odd rows. Null texts are empty. A text shorter than LENGTH bytes keeps all its bytes.
Rows without doc_id take no part and keep all. Rows that repeat a doc_id are the same document:
neither takes bytes from the other. Other columns are ignored. Whole fragments are equal by 80 bits
of two hashes of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.lineage import pin
from shelfwise.llm.words import Slice, mix, powers, slices, span_hashes, _INVERSE

LENGTH = 50
GRAM = 24
BUCKET_BYTES = 32 << 20
RESOLVED, PENDING = 0, 1
FRAGMENT_SCHEMA = "bucket int, anchor binary, low binary, high binary, doc binary"
ANSWER_SCHEMA = "bucket int, kind int, doc binary, low binary, high binary, mask binary"
BYTES_SCHEMA = "bucket int, anchor binary, low binary, high binary, doc binary, offset binary, size binary, data binary"
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Fragments:
    """Runs of windows with one anchor in a slice: first and last window, anchor, hashes."""

    def __init__(self, part: Slice, length: int, gram: int):
        n, width = len(part.data), length - gram + 1
        self.prefix = prefix = part.prefix_hashes()
        windows = n - length + 1
        if windows <= 0:
            self.first = self.last = self.anchor = np.zeros(0, dtype=np.int64)
            self.key = self.whole = np.zeros(0, dtype=np.uint64)
            self.row = np.zeros(0, dtype=np.int64)
            return
        at = np.arange(n - gram + 1)
        grams = mix((prefix[gram:] - prefix[: n - gram + 1]) * powers(_INVERSE, n - gram + 1))
        # High half: hash; low half: position, so that ties go to the first.
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        anchor = (least[:windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # A window is whole if it ends inside the row in which it starts.
        room = np.zeros(n + 1, dtype=np.int8)
        sizes = np.diff(part.offsets)
        rows = np.flatnonzero(sizes >= length)
        np.add.at(room, part.offsets[rows], 1)
        np.add.at(room, part.offsets[rows] + sizes[rows] - length + 1, -1)
        whole = np.cumsum(room, dtype=np.int8)[:windows].astype(bool)
        turn = np.ones(windows, dtype=bool)
        turn[1:] = anchor[1:] != anchor[:-1]
        opens = whole & turn
        opens[1:] |= whole[1:] & ~whole[:-1]
        closes = whole.copy()
        closes[:-1] &= turn[1:] | ~whole[1:]
        self.first, self.last = np.flatnonzero(opens), np.flatnonzero(closes)
        self.anchor = anchor[self.first]
        self.key = mix(grams[self.anchor], 9)
        self.whole = span_hashes(prefix, self.first, self.last + length)
        self.row = np.searchsorted(part.offsets, self.first, "right") - 1

    def take(self, keep: np.ndarray) -> None:
        for name in ("first", "last", "anchor", "key", "whole", "row"):
            setattr(self, name, getattr(self, name)[keep])


def _pack(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[dict]:
    """One row of binaries per bucket."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edges) if len(order) else []:
        yield {"bucket": int(bucket[part[0]]), **{k: v[part].tobytes() for k, v in columns.items()}}


def _split(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return whole.astype(np.uint32), (whole >> np.uint64(32)).astype(np.uint16)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def _read(table: pa.Table, name: str, kind) -> np.ndarray:
    """All binaries of a column as one array."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)


def _rows(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def _arrow(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in text.split(", "))])


def _fragment_hashes(buckets: int, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            held, size = [], 0
            for part in slices(batch.column("text")):
                found = Fragments(part, length, gram)
                held.append((found.key, found.whole, ids[part.first + found.row].astype(np.int64)))
                size += len(found.key)
                if size > 1 << 20:
                    yield from flush(held)
                    held, size = [], 0
            yield from flush(held)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        if held and sum(len(x[0]) for x in held):
            key, whole, doc = (np.concatenate(x) for x in zip(*held))
            low, high = _split(whole)
            columns = {"anchor": key.astype(np.uint32), "low": low, "high": high, "doc": doc}
            bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            yield from _rows(list(_pack(bucket, columns)), _arrow(FRAGMENT_SCHEMA)).to_batches()

    return run


def doc_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64), 31) % np.uint64(buckets)).astype(np.int64)


def _repeats(buckets: int):
    """Of one bucket: answers where the least doc_id decides, and what needs the bytes."""

    def run(table: pa.Table) -> pa.Table:
        anchor = _read(table, "anchor", np.uint32)
        whole = _joined(_read(table, "low", np.uint32), _read(table, "high", np.uint16))
        doc = _read(table, "doc", np.int64)
        order = np.lexsort((doc, whole, anchor))
        anchor, whole, doc = anchor[order], whole[order], doc[order]
        opens = np.ones(len(anchor), dtype=bool)
        opens[1:] = anchor[1:] != anchor[:-1]
        group = np.cumsum(opens) - 1
        at = np.flatnonzero(opens)
        least, most = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
        kinds = np.ones(len(anchor), dtype=bool)
        kinds[1:] = opens[1:] | (whole[1:] != whole[:-1])
        several = np.add.reduceat(kinds.astype(np.int64), at) > 1
        shared = least < most
        fresh = np.ones(len(anchor), dtype=bool)  # a document's repeat of one fragment needs one answer
        fresh[1:] = kinds[1:] | (doc[1:] != doc[:-1])
        done = fresh & (shared & ~several)[group] & (doc > least[group])
        open_ = fresh & (shared & several)[group]
        out = []
        for kind, keep in ((RESOLVED, done), (PENDING, open_)):
            low, high = _split(whole[keep])
            mask = np.full(int(keep.sum()), 0xFFFFFFFF, dtype=np.uint32) if kind == RESOLVED else np.zeros(0, np.uint32)
            columns = {"doc": doc[keep], "low": low, "high": high}
            bucket = doc_bucket(doc[keep], buckets)
            if kind == RESOLVED:
                columns["mask"] = mask
            out += [{"kind": kind, "mask": b"", **row} for row in _pack(bucket, columns)]
        return _rows(out, _arrow(ANSWER_SCHEMA))

    return run


def _members(doc: np.ndarray, whole: np.ndarray):
    """Look-up of (doc, fragment) pairs: a function to the positions in the given arrays or -1."""
    key = mix(doc.view(np.uint64), 41) ^ whole
    order = np.argsort(key)
    ordered = key[order]

    def find(other_doc: np.ndarray, other_whole: np.ndarray) -> np.ndarray:
        wanted = mix(other_doc.astype(np.int64).view(np.uint64), 41) ^ other_whole
        if not len(ordered):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
        position = order[at]
        same = (doc[position] == other_doc) & (whole[position] == other_whole)
        return np.where(same, position, -1)

    return find


def _fragment_bytes(buckets: int, length: int, gram: int):
    """Bytes of the wanted fragments of the documents in one doc bucket."""

    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[dict] = []
        doc = _read(wanted, "doc", np.int64)
        if len(doc) and docs.num_rows:
            find = _members(doc, _joined(_read(wanted, "low", np.uint32), _read(wanted, "high", np.uint16)))
            docs = docs.filter(pa.compute.is_in(docs.column("doc_id"), pa.array(np.unique(doc))))
            ids = docs.column("doc_id").to_numpy()
            for part in slices(docs.column("text").combine_chunks()):
                found = Fragments(part, length, gram)
                owner = ids[part.first + found.row].astype(np.int64)
                whole = _joined(*_split(found.whole))
                hit = find(owner, whole)
                keep = np.flatnonzero(hit >= 0)
                # Once per document and fragment.
                keep = keep[np.unique(hit[keep], return_index=True)[1]]
                found.take(keep)
                low, high = _split(found.whole)
                size = (found.last + length - found.first).astype(np.int32)
                bucket = ((found.key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order])) + 1
                for rows in np.split(order, edges) if len(order) else []:
                    text = b"".join(
                        part.data[found.first[r] : found.last[r] + length].tobytes() for r in rows
                    )
                    out.append(
                        {
                            "bucket": int(bucket[rows[0]]),
                            "anchor": found.key[rows].astype(np.uint32).tobytes(),
                            "low": low[rows].tobytes(),
                            "high": high[rows].tobytes(),
                            "doc": owner[keep][rows].tobytes(),
                            "offset": (found.anchor - found.first)[rows].astype(np.int32).tobytes(),
                            "size": size[rows].tobytes(),
                            "data": text,
                        }
                    )
        return _rows(out, _arrow(BYTES_SCHEMA))

    return run


class Suffixes:
    """Suffixes of one byte array that begin at ``starts`` and stop before ``stops``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, longest: int):
        self.data = np.append(data, np.uint8(0))
        self.starts = starts
        self.sizes = np.minimum(stops - starts, longest)
        self.longest = longest
        self.prefix = Slice(0, data, np.array([0, len(data)])).prefix_hashes()
        self.back = powers(_INVERSE, len(self.prefix))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b by binary search over hashes."""
        x, y = self.starts[a], self.starts[b]
        low, high = np.zeros(len(a), dtype=np.int64), np.minimum(self.sizes[a], self.sizes[b])
        base_x, base_y, back_x, back_y = self.prefix[x], self.prefix[y], self.back[x], self.back[y]
        for _ in range(int(self.longest).bit_length()):
            mid = (low + high + 1) // 2
            same = (self.prefix[x + mid] - base_x) * back_x == (self.prefix[y + mid] - base_y) * back_y
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def _next(self, a: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Byte after the common part, -1 at the end."""
        return np.where(common < self.sizes[a], self.data[self.starts[a] + common].astype(np.int16), -1)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        common = self.extension(a, b)
        return self._next(a, common) < self._next(b, common)

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order by group, then suffix, and the extension of each with its predecessor.

        Bottom-up mergesort, all runs of all groups at once: the place of an element is its place
        in its own run plus its rank in the other run, found by binary search.
        """
        order = np.argsort(group, kind="stable")
        opens = np.ones(len(order), dtype=bool)
        opens[1:] = group[order][1:] != group[order][:-1]
        at = np.flatnonzero(opens)
        sizes = np.diff(np.append(at, len(order)))
        begin, count = np.repeat(at, sizes), np.repeat(sizes, sizes)
        width = 1
        while len(sizes) and width < sizes.max():
            moving = np.flatnonzero(count > width)
            place = moving - begin[moving]
            base = place // (2 * width) * (2 * width)
            in_left = place - base < width
            # The other run of the pair, cut at the end of the group.
            other = np.where(in_left, base + width, base)
            stop = np.minimum(other + width, count[moving])
            moving, in_left, other, stop, base, place = (
                v[other < stop] for v in (moving, in_left, other, stop, base, place)
            )
            low, high = begin[moving] + other, begin[moving] + stop
            first = low.copy()
            for _ in range(width.bit_length()):
                go = low < high
                mid = (low + high) // 2
                probe, self_ = order[np.minimum(mid, len(order) - 1)], order[moving]
                # Elements of the left run come before equal ones of the right run.
                before = np.where(in_left, self.less(probe, self_), ~self.less(self_, probe)) & go
                low = np.where(before, mid + 1, low)
                high = np.where(before | ~go, high, mid)
            own = np.where(in_left, place - base, place - base - width)
            moved = order.copy()
            moved[begin[moving] + base + own + (low - first)] = order[moving]
            order, width = moved, 2 * width
        common = np.zeros(len(order), dtype=np.int64)
        inner = np.flatnonzero(~opens)
        common[inner] = self.extension(order[inner - 1], order[inner])
        if not self._sorted(order, inner, common):
            order, common = self._by_bytes(group, opens)
        return order, common

    def _sorted(self, order: np.ndarray, inner: np.ndarray, common: np.ndarray) -> bool:
        """Bytes of all claimed extensions, and the order after them."""
        a, b, reach = order[inner - 1], order[inner], common[inner]
        for k in range(self.longest):
            live = np.flatnonzero(reach > k)
            if (self.data[self.starts[a[live]] + k] != self.data[self.starts[b[live]] + k]).any():
                return False
        return not (self._next(a, reach) > self._next(b, reach)).any()

    def _by_bytes(self, group: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = [
            self.data[s : s + n].tobytes() for s, n in zip(self.starts, self.sizes)
        ]
        order = np.array(sorted(range(len(text)), key=lambda i: (group[i], text[i])), dtype=np.int64)
        common = np.zeros(len(order), dtype=np.int64)
        for i in np.flatnonzero(~opens):
            a, b = text[order[i - 1]], text[order[i]]
            while common[i] < min(len(a), len(b)) and a[common[i]] == b[common[i]]:
                common[i] += 1
        return order, common


def least_owner(
    data: np.ndarray, starts: np.ndarray, offsets: np.ndarray, sizes: np.ndarray,
    group: np.ndarray, doc: np.ndarray, length: int, gram: int,
) -> np.ndarray:
    """Least doc of the fragments that share each window: [fragment, offset before the anchor]."""
    at = starts + offsets
    suffixes = Suffixes(data, at, starts + sizes, length)
    order, common = suffixes.sort(group)
    least = np.full((len(starts), length - gram + 1), np.iinfo(np.int64).max)
    for back in range(length - gram + 1):
        # Windows that begin ``back`` bytes before the anchor and lie in the fragment.
        fits = (offsets >= back) & (at + length - back <= starts + sizes)
        segment = np.cumsum(common < length - back)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = segment
        rows = np.flatnonzero(fits)
        left = span_hashes(suffixes.prefix, at[rows] - back, at[rows])
        by = np.lexsort((doc[rows], left, rank[rows]))
        rows, left = rows[by], left[by]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rank[rows][1:] != rank[rows][:-1]) | (left[1:] != left[:-1])
        for k in range(back):  # verify the bytes before the anchors
            here = data[at[rows] - back + k]
            new[1:] |= here[1:] != here[:-1]
        opened = np.flatnonzero(new)
        if len(opened):
            # A collision inside an equal run only splits it further; runs keep the least doc first.
            least[rows, back] = np.repeat(np.minimum.reduceat(doc[rows], opened), np.diff(np.append(opened, len(rows))))
    return least


def _sort_bucket(buckets: int, length: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        anchor = _read(table, "anchor", np.uint32)
        whole = _joined(_read(table, "low", np.uint32), _read(table, "high", np.uint16))
        doc, offset = _read(table, "doc", np.int64), _read(table, "offset", np.int32).astype(np.int64)
        size = _read(table, "size", np.int32).astype(np.int64)
        data = _read(table, "data", np.uint8)
        starts = np.cumsum(size) - size
        # Equal fragments are sorted once, for their least document.
        order = np.lexsort((doc, whole, anchor))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (whole[order][1:] != whole[order][:-1])
        kind = np.empty(len(order), dtype=np.int64)
        kind[order] = np.cumsum(new) - 1
        one = order[new]
        least = least_owner(data, starts[one], offset[one], size[one], anchor[one], doc[one], length, gram)
        bits = np.uint32(1) << np.arange(least.shape[1], dtype=np.uint32)
        mask = np.zeros(len(doc), dtype=np.uint32)
        for low in range(0, len(doc), 1 << 16):
            part = slice(low, low + (1 << 16))
            mask[part] = ((least[kind[part]] < doc[part, None]) * bits).sum(axis=1, dtype=np.uint32)
        keep = np.flatnonzero(mask)
        low32, high16 = _split(whole[keep])
        columns = {"doc": doc[keep], "low": low32, "high": high16, "mask": mask[keep]}
        rows = _pack(doc_bucket(doc[keep], buckets), columns)
        return _rows([{"kind": RESOLVED, **row} for row in rows], _arrow(ANSWER_SCHEMA))

    return run


def _cut(length: int, gram: int):
    """Remove what the answers say from the documents of one doc bucket."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        doc = _read(answers, "doc", np.int64)
        find = _members(doc, _joined(_read(answers, "low", np.uint32), _read(answers, "high", np.uint16)))
        mask = np.append(_read(answers, "mask", np.uint32), np.uint32(0))
        touched = np.unique(doc)
        if not docs.num_rows:
            return pa.table({k: pa.array(v, f.type) for (k, v), f in zip(out.items(), _arrow(RESULT_SCHEMA))})
        ids = docs.column("doc_id").to_pylist()
        for part in slices(docs.column("text").combine_chunks()):
            owners = np.array([np.iinfo(np.int64).min if i is None else i for i in ids[part.first : part.first + part.rows]])
            gone = np.zeros(len(part.data) + 1, dtype=np.int32)
            if len(touched) and np.isin(owners, touched).any():
                found = Fragments(part, length, gram)
                at = find(owners[found.row], _joined(*_split(found.whole)))
                found.take(at >= 0)
                answer = mask[at[at >= 0]]
                for back in range(length - gram + 1):
                    window = found.anchor - back
                    hit = (answer >> np.uint32(back) & 1).astype(bool) & (window >= found.first) & (window <= found.last)
                    np.add.at(gone, window[hit], 1)
                    np.add.at(gone, window[hit] + length, -1)
            cut = np.cumsum(gone[:-1]) > 0
            for row in range(part.rows):
                low, high = part.offsets[row], part.offsets[row + 1]
                lost = cut[low:high]
                out["doc_id"].append(ids[part.first + row])
                out["n_bytes"].append(int(high - low))
                out["n_removed"].append(int(lost.sum()))
                out["n_spans"].append(int(lost[:1].sum() + (lost[1:] & ~lost[:-1]).sum()))
                out["kept_sha256"].append(hashlib.sha256(part.data[low:high][~lost].tobytes()).hexdigest())
        return pa.table({k: pa.array(v, f.type) for (k, v), f in zip(out.items(), _arrow(RESULT_SCHEMA))})

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of (doc_id, text)."""
    if not length // 3 <= gram <= length - 1 or length - gram + 1 > 32:
        raise ValueError("the gram must leave 1 to 31 offsets in a window")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    # Answers take a row per pair of a bucket of anchors and one of documents at most.
    buckets = _bucket_count(known)
    anchors = 2 * buckets
    hashes = known.mapInArrow(_fragment_hashes(anchors, length, gram), FRAGMENT_SCHEMA)
    answers = pin(_dealt(hashes, anchors).applyInArrow(_repeats(buckets), ANSWER_SCHEMA), "repeats")

    placed = known.mapInArrow(_placed(buckets), "bucket int, doc_id long, text string")
    pending = answers.where(F.col("kind") == PENDING)
    fragments = _dealt(placed, buckets).cogroup(_dealt(pending, buckets)).applyInArrow(
        _fragment_bytes(anchors, length, gram), BYTES_SCHEMA
    )
    sorted_answers = _dealt(fragments, anchors).applyInArrow(_sort_bucket(buckets, length, gram), ANSWER_SCHEMA)
    every = answers.where(F.col("kind") == RESOLVED).unionByName(sorted_answers)
    cut = _dealt(placed, buckets).cogroup(_dealt(every, buckets)).applyInArrow(_cut(length, gram), RESULT_SCHEMA)
    return cut.unionByName(docs.where("doc_id IS NULL").mapInArrow(_whole, RESULT_SCHEMA))


def _bucket_count(docs: DataFrame) -> int:
    """Buckets of about ``BUCKET_BYTES`` of text, as many as shuffle partitions at least."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))


def _dealt(rows: DataFrame, buckets: int):
    """Groups of the buckets, spread over as many tasks as there are buckets."""
    return rows.repartition(buckets, "bucket").groupBy("bucket")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers for rows without doc_id, which lose nothing."""
    for batch in batches:
        texts = [(t.as_py() or "").encode() for t in batch.column("text")]
        zero = np.zeros(len(texts), dtype=np.int64)
        columns = [batch.column("doc_id"), [len(t) for t in texts], zero, zero, [hashlib.sha256(t).hexdigest() for t in texts]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _arrow(RESULT_SCHEMA))], schema=_arrow(RESULT_SCHEMA)
        )


def _placed(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = pa.array(doc_bucket(batch.column("doc_id").to_numpy(), buckets).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [bucket, batch.column("doc_id"), batch.column("text")], ["bucket", "doc_id", "text"]
            )

    return run
