import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from shelfwise.llm import variants
from shelfwise.llm.variants import spelling_variants, word_counts
from tests.llm.odd import empty_documents, odd_documents

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts_of(rows, damaged=199):
    out = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damaged == 0:
                gap = h % len(run)
                run = run[:gap] + run[gap + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_of(rows, damaged=199):
    """Every word against every other."""
    words, forms, out = counts_of(rows, damaged), {}, []
    around = {w: [v for v in words if near(w, v)] for w in words}
    for w, n in words.items():
        best = min(around[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, n, len(around[w]), forms[w], words.get(forms[w]), root))
    return sorted(out)


def got(df):
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(tuple(r) for r in df.collect())


def test_against_every_pair(spark):
    random.seed(5)
    rows = []
    for i in range(300):
        words = []
        for _ in range(120):
            word = "".join(random.choice("aabé") for _ in range(random.choice([6, 6, 7, 8])))
            words += [word if random.random() < 0.5 else word.upper()] * random.choice([1, 1, 2])
        rows.append((i - 20, random.choice([" ", "-", "1", "Ā"]).join(words)))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    expected = variants_of(rows)
    assert got(spelling_variants(docs.repartition(7))) == expected
    assert any(r[3] for r in expected) and max(r[2] for r in expected) > 10


def test_chains_and_ties(spark):
    text = (
        "straße " * 5 + "straßes " * 25 + "straßens " * 130 + "strafens " * 700 + "xtraße " * 25
        + "aaaaaa " * 10 + "aaaaaaa " * 50 + "aaaaab " * 50 + "baaaaa " * 50 + "÷×÷×÷× " * 6 + "÷×÷×÷×÷ " * 30
    )
    rows = [(1, text), (2, "aaaaaaa" * 40000 + " "), *[(3, "y" * 100 + "z " + "y" * 100)] * 6]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    answer = got(spelling_variants(docs, damaged=1 << 40))
    assert answer == variants_of(rows, damaged=1 << 40)
    by_word = {r[0]: r for r in answer}
    assert by_word["straße"][5] == "strafens" and by_word["straße"][3] in ("straßes", "xtraße")
    assert by_word["aaaaaa"][3] == "aaaaaaa"  # ties go to the first in code-point order


def test_damage_and_lengths(spark):
    """Every third run loses a letter; short and long runs meet the limits."""
    random.seed(6)
    rows = [(i, " ".join(["abcdef", "abcdefg", "q" * 90, "é" * 40, "ab" * 33, "ÀÿZ×÷a"] * 3)) for i in range(60)]
    rows += [(None, "abcdefg abcdefg"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = counts_of(rows, 3)
    assert {r.word: r.n for r in word_counts(docs, 3).collect()} == expected
    assert got(spelling_variants(docs, 3)) == variants_of(rows, 3)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(spelling_variants(docs)) == variants_of(rows)
    assert spelling_variants(empty_documents(spark)).count() == 0


def test_words_that_share_a_number_get_others(spark, monkeypatch):
    """With numbers of few bits the first salts fail; without any good one there is an error."""
    counts = spark.createDataFrame([(f"word{chr(97 + i)}xyz", 5) for i in range(20)], "word string, n long")
    real = variants._ids

    def poor(good):
        def ids(salt):
            return (lambda batches: (b.append_column("id", pa.array([7] * b.num_rows)) for b in batches)) if salt < good else real(salt)

        return ids

    monkeypatch.setattr(variants, "_ids", poor(2))
    words, salt = variants.numbered(counts)
    assert salt == 2 and words.select("id").distinct().count() == 20
    monkeypatch.setattr(variants, "_ids", poor(99))
    with pytest.raises(ValueError, match="one number"):
        variants.numbered(counts)
