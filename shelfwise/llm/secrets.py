"""Secrets in whole texts: fixed formats, plus formats inferred from the credentials they find.

Method. One pass finds the base spans (assigned values, access keys, long hex runs) and, apart from
them, all candidates: maximal runs of credential characters of ``CANDIDATE`` characters or more.
The base spans are labelled credentials. From a bounded sample of each kind a prefix tree is built
and its statistically compatible states are merged into a probabilistic automaton
(``automata.py``); another one is inferred from sampled candidates without label, as background. A
second pass over the candidates, not the texts, scores all of them: a candidate whose mean log
likelihood under the automaton of some kind reaches the level that ``RECALL`` of held-out
credentials of that kind reach, and exceeds its likelihood under the background by ``MARGIN`` bits
a character, is added as a span of kind ``format``.

Bounds. At most ``SAMPLE`` credentials a kind and ``SAMPLE`` background candidates are used for
inference, those with the least hash, none longer than ``LONGEST`` characters; they are all that the
driver gathers. Texts, spans and candidates are never cut or sampled.

Rules for odd rows. A null or empty text has no spans. Repeated rows and rows without doc_id are
scanned like any other; the result has one row per input row. A kind with fewer than ``FEWEST``
distinct credentials gets no automaton. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.lineage import pin
from shelfwise.llm.automata import Automaton, log_likelihood

# Fixed formats of the contract.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGNED, ACCESS_LENGTH = 8, 16

ADDED = "format"
CANDIDATE = 16
CANDIDATES = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % CANDIDATE)
SAMPLE, LONGEST, FEWEST = 1000, 256, 20
RECALL, MARGIN = 0.98, 0.5
SPAN = "struct<kind:string,start:int,end:int,value:string>"
FOUND_SCHEMA = f"doc_id long, base array<{SPAN}>, others array<{SPAN}>"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) by start, then by the order of kinds.

    ``{32,}`` finds the same runs as a greedy ``+`` with a check of the length, because a run of
    hex digits is maximal either way.
    """
    spans = [
        ("assign", *m.span(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGNED
    ]
    spans += [
        ("access", *m.span(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_LENGTH
    ]
    spans += [("hex", *m.span(), m.group()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def other_candidates(text: str, spans: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Candidate runs that no base span touches."""
    found, at = [], 0
    for m in CANDIDATES.finditer(text):
        start, end = m.span()
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        if not any(s[1] < end and s[2] > start for s in spans[at:]):
            found.append((ADDED, start, end, m.group()))
    return found


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
    )
    as_rows = lambda spans: [dict(zip(("kind", "start", "end", "value"), s)) for s in spans]
    for batch in batches:
        base, others = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            spans = base_spans(text)
            base.append(as_rows(spans))
            others.append(as_rows(other_candidates(text, spans)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(base, kind), pa.array(others, kind)],
            ["doc_id", "base", "others"],
        )


def infer_formats(found: DataFrame) -> dict[str, tuple[list, float]]:
    """Automaton and least likelihood per kind, and the background's under the added kind."""
    value = F.substring("s.value", 1, LONGEST + 1)
    labelled = found.select(F.explode("base").alias("s")).select("s.kind", value.alias("value"))
    free = found.select(F.explode("others").alias("s")).select("s.kind", value.alias("value"))
    tables = {}
    for kind in (*KINDS, ADDED):
        rows = (labelled if kind != ADDED else free).where((F.col("kind") == kind) & (F.length("value") <= LONGEST))
        sample = [
            r.value
            for r in rows.groupBy("value").count().orderBy(F.xxhash64("value"), "value").limit(SAMPLE).select("value").collect()
        ]
        if len(sample) < FEWEST:
            continue
        held, train = sample[::4], [x for i, x in enumerate(sample) if i % 4]
        table = Automaton(train).merged().table()
        scores = sorted(log_likelihood(table, x) for x in held)
        tables[kind] = table, scores[int((1 - RECALL) * len(scores))]
    return tables


def _score(tables: dict[str, tuple[list, float]]):
    background = tables.get(ADDED)
    formats = [tables[k] for k in KINDS if k in tables]

    def likely(value: str) -> bool:
        usual = log_likelihood(background[0], value) if background else float("-inf")
        for table, least in formats:
            score = log_likelihood(table, value)
            if score >= least and score >= usual + MARGIN:
                return True
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_added", "base_sha256", "spans")}
            for base, others in zip(batch.column("base").to_pylist(), batch.column("others").to_pylist()):
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(s["kind"] == kind for s in base))
                added = [s for s in others if likely(s["value"])]
                order = lambda s: (s["start"], (*KINDS, ADDED).index(s["kind"]))
                joined = lambda spans: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(sorted(base + added, key=order)))
                out["n_added"].append(len(added))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(v) for v in out.values())], ["doc_id", *out]
            )

    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_added, base_sha256, spans per row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = pin(docs.mapInArrow(_find, FOUND_SCHEMA), "candidates")
    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, n_added long, "
        "base_sha256 string, spans string"
    )
    return found.mapInArrow(_score(infer_formats(found)), schema)
