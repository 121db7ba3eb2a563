import hashlib
import random
import re

from pyspark.sql import functions as F

from shelfwise.llm import infill
from shelfwise.llm.infill import fill_in_middle, output_pieces, restored_text
from tests.llm.odd import empty_documents, odd_documents


def plain_fill(doc_id, text):
    """The contract, read literally."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    hexa = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexa[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    whole = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(whole), sha(text)


def answers(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=str)


def test_against_the_contract(spark):
    random.seed(3)
    parts = ["abc", "Z", " ", "\n", "é", "漢", "😀", "<", "P", ">", "<S>", "<S", "\t", "x" * 40, "\x00", "0", "ÿ"]
    rows = []
    for i in range(400):
        chosen = parts if i % 5 == 0 else [p for p in parts if p != "<S>"]
        rows.append((i, "".join(random.choice(chosen) for _ in range(random.choice([0, 1, 2, 7, 60])))))
    rows += [(-7, "negative id"), (2**62, "large id"), (400, "<P"), (401, "<P>"), (402, "<M"), (403, ">S>")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, place string")
    # Small pieces, so that texts and even single units are cut, and the usual ones.
    got = answers(fill_in_middle(docs.repartition(5), units=5, size=16))
    assert got == answers(fill_in_middle(docs.repartition(3))) == sorted((plain_fill(*r) for r in rows), key=str)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_texts_come_back(spark):
    rows = [(i, f"head {i} <b> <PS> tail\n" * (i % 7)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fill_in_middle(docs, keep_text=True).withColumn("text", restored_text(F.col("form"), F.col("output")))
    for r in out.collect():
        assert r.text == dict(rows)[r.doc_id]
        assert hashlib.sha256(r.output.encode()).hexdigest() == r.output_sha256
        assert hashlib.sha256(r.text.encode()).hexdigest() == r.restored_sha256


def test_pieces_are_bounded_and_ordered(spark):
    text = "word " * 30000 + "y" * 300000 + "é" * 50000
    docs = spark.createDataFrame([(i, text) for i in (1, 2, 3)], "doc_id long, text string")
    pieces = output_pieces(docs).collect()
    assert max(len(p.piece) for p in pieces) <= infill.PIECE_BYTES
    for i in (1, 2, 3):
        whole = b"".join(bytes(p.piece) for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.place))
        assert hashlib.sha256(whole).hexdigest() == plain_fill(i, text)[5]


def test_odd_rows_and_repeated_ones(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert answers(fill_in_middle(docs)) == sorted((plain_fill(*r) for r in rows), key=str)
    again = docs.unionByName(docs.select([F.lit(5).cast("long").alias("doc_id"), F.lit("other").alias("text"), *docs.columns[2:]]))
    expected = rows + [(5, "other")] * len(rows)
    assert answers(fill_in_middle(again)) == sorted((plain_fill(*r) for r in expected), key=str)
    assert fill_in_middle(empty_documents(spark)).count() == 0
