import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shelfwise.llm import lines, minhash
from shelfwise.llm.components import components, spanning_forest
from shelfwise.llm.lines import drop_repeated_lines
from shelfwise.llm.minhash import near_duplicates
from shelfwise.llm.words import slices
from tests.llm.odd import LONG, empty_documents, odd_documents

DOC = "doc_id long, text string"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(rows, width):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, set()).add(shingles(t, width))
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(
                100 * len(x & y) >= 80 * len(x | y) and x and y for x in sets[a] for y in sets[b]
            ):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: root(d) for d in ids}


def near_rows(seed):
    random.seed(seed)
    word = lambda: "".join(random.choice(["th", "er", "on", "an", "re"]) for _ in range(random.randint(1, 4)))
    rows, number = [], 0
    for group in range(12):
        base = [word() for _ in range(random.choice([1, 2, 3, 6, 12, 60, 120]))]
        for _ in range(random.choice([1, 2, 5, 40 if group == 3 else 8])):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 4, 8, 14])):
                copy[random.randrange(len(copy))] = word()
            rows.append((number, " ".join(w.title() if random.random() < 0.2 else w for w in copy)))
            number += 1
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,width", [(1, 2), (2, 2), (3, 5)])
def test_components_against_all_pairs(spark, seed, width):
    rows = near_rows(seed)
    out = near_duplicates(spark.createDataFrame(rows, DOC).repartition(5), width=width).collect()
    want = brute_components(rows, width)
    assert {r.doc_id: r.component_id for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert {r.doc_id: r.n_shingles for r in out} == {d: len(shingles(t, width)) for d, t in rows}


def test_radius_holds_for_similar_sets():
    """Sets of similarity 0.8 stay within the radius and share a key."""
    random.seed(5)
    rng = np.random.default_rng(5)
    for _ in range(200):
        common, own = rng.integers(0, 2**63, 160, dtype=np.uint64), rng.integers(0, 2**63, 40, dtype=np.uint64)
        a = minhash.signature(np.concatenate([common, own[:20]]))[: minhash.CHUNKS].view(np.uint64)
        b = minhash.signature(np.concatenate([common, own[20:]]))[: minhash.CHUNKS].view(np.uint64)
        lanes = np.stack([(a ^ b) >> np.uint64(12 * k) & np.uint64(0xFFF) for k in range(5)]) != 0
        assert lanes.sum() <= minhash.RADIUS
        assert (lanes.sum(axis=0) <= 1).any()


def test_near_odd_rows(spark):
    docs = odd_documents(spark)
    out = near_duplicates(docs).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.component_id is None and r.kept for r in by[None])
    assert [(r.component_id, r.kept) for r in by[5]] == [(5, True)] * 2
    assert (by[6][0].component_id, by[6][0].kept) == (5, False)
    assert all(by[d][0].n_shingles == 0 and by[d][0].component_id == d for d in (2, 3, 4))
    assert by[7][0].n_shingles == 1
    assert near_duplicates(empty_documents(spark)).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "a b c d e f g h i j k"), (2, "l m n o p q r s t u v"), (2, "a b c d e f g h i j k"), (3, "l m n o p q r s t u v")]
    out = near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert {r.doc_id: r.component_id for r in out}[3] == 1


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101)]
    out = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in out} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


# Lines


def test_templates_with_variable_fields(spark):
    users = ["alice", "bob", "carol", "dave"]
    rows = [
        (i, f"own words number {'xyzw'[i]} that nobody repeats here\nuser logged in from host {users[i]} at port {8000 + i} today\n\nshort line\nthe end of it is the same everywhere")
        for i in range(4)
    ]
    out = {r.doc_id: r for r in drop_repeated_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert out[0].text == rows[0][1] and out[0].n_dropped == 0
    for i in (1, 2, 3):
        # The first lines differ in one of eight tokens, so they are one template as well.
        assert out[i].text == "\nshort line"
        assert (out[i].n_lines, out[i].n_dropped) == (4, 3)


@pytest.mark.parametrize("small", [256, 5])
def test_every_template_of_a_leaf_counts(spark, monkeypatch, small):
    """Ten templates of one leaf, each with a variable field; whole leaf or split by blocks."""
    monkeypatch.setattr(lines, "SMALL", small)
    monkeypatch.setattr(lines, "SLOTS", 4)
    random.seed(4)
    fixed = [[f"t{chr(97 + k)}{chr(97 + j)}" for j in range(7)] for k in range(10)]
    rows = []
    for k, words in enumerate(fixed):
        for copy in range(4):
            field = "".join(random.choice("abcdefgh") for _ in range(8))
            rows.append((10 * copy + k, " ".join(["2024-05-01", f"12:00:{copy:02}", "INFO", *words[:3], field, *words[3:]])))
    rows += [(100, " ".join(["2024-05-01", "12:00", "INFO", *"zyxwvuts"]))]
    out = {r.doc_id: r.text for r in drop_repeated_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert out == {d: t if d < 10 or d == 100 else "" for d, t in rows}


def test_unlike_lines_of_one_leaf_stay(spark):
    random.seed(1)
    lines = [" ".join(["same", "start", "here", *(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(7))]) for i in range(20)]
    rows = [(i, line) for i, line in enumerate(lines)] + [(20 + i, lines[0]) for i in range(3)]
    out = {r.doc_id: r.text for r in drop_repeated_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert all(out[i] == lines[i] for i in range(20))
    assert all(out[20 + i] == "" for i in range(3))


def test_too_few_documents_keep_their_lines(spark):
    rows = [(1, "one line of five tokens\nx"), (2, "one line of five tokens"), (3, "a b c\n" * 3), (4, "a b c"), (5, "a b c")]
    rows += [(6, "again and again and again\n" * 5)]
    out = {r.doc_id: r.text for r in drop_repeated_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert out == dict(rows)


def test_long_lines_recur_from_two_documents_on(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    passage, edge, below = " ".join(words), " ".join(words[:20]), " ".join(words[1:20])
    rows = [(1, f"{passage}\n{edge}\n{below}"), (2, f"own\n{passage}\n{below}"), (3, edge)]
    out = {r.doc_id: r.text for r in drop_repeated_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert out == {1: rows[0][1], 2: f"own\n{below}", 3: ""}


def test_line_odd_rows(spark):
    docs = odd_documents(spark)
    more = docs.where("doc_id = 6").selectExpr("9 AS doc_id", *docs.columns[1:])
    docs = docs.unionByName(more)
    out = drop_repeated_lines(docs)
    assert set(out.columns) == set(docs.columns) | {"n_dropped"}
    rows = out.collect()
    assert len(rows) == docs.count()
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[5] == [LONG, LONG] and texts[6] == [""] and texts[9] == [""]
    assert texts[2] == [None] and texts[3] == [""] and texts[4] == [" \n\t "]
    assert {r.key for r in rows} == {r.key for r in docs.collect()}
    assert drop_repeated_lines(empty_documents(spark)).count() == 0


def plain_lines(rows):
    """doc_id -> text by the rules of the template tree, one leaf after the other."""
    def words_of(line):
        return tuple("*" if any(c.isdigit() for c in w) else w for w in line.split())

    def code(line):
        part = next(slices(pa.array([line])))
        return int(lines.Lines(part).line[0].view(np.int64))

    docs_of, codes = {}, {}
    for doc, text in rows:
        for line in text.split("\n"):
            words = words_of(line)
            if len(words) >= lines.LEAST_TOKENS:
                docs_of.setdefault(words, set()).add(doc)
                codes[words] = code(line)
    leaves, leader = {}, {}
    for words in docs_of:
        leaves.setdefault((len(words), words[:3]), []).append(words)
    for leaf in leaves.values():
        left = sorted(leaf, key=lambda w: (len(docs_of[w]), codes[w]), reverse=True)
        while left:
            first = left[0]
            near = [w for w in left if sum(a == b for a, b in zip(first, w)) >= lines.ALIKE * len(w)]
            leader |= {w: first for w in near}
            left = [w for w in left if w not in leader]
    members = {}
    for words, first in leader.items():
        members.setdefault(first, set()).update(docs_of[words])
    gone = {}
    for first, docs in members.items():
        least = lines.LEAST_DOCS_MANY if len(first) >= lines.MANY_TOKENS else lines.LEAST_DOCS
        if len(docs) >= least:
            gone[first] = min(docs)
    out = {}
    for doc, text in rows:
        kept = [x for x in text.split("\n") if gone.get(leader.get(words_of(x)), doc) == doc]
        out[doc] = "\n".join(kept)
    return out


def test_template_tree_against_brute_force(spark):
    random.seed(12)
    word = lambda: random.choice(["ab", "cd", "ef", "gh", "x1", "y22"])
    long = [[random.choice("klmnop") + random.choice("qrs") for _ in range(24)] for _ in range(6)]
    rows = []
    for doc in range(120):
        own = [" ".join(["in", "one", "leaf", *(word() for _ in range(random.choice([0, 1, 5, 7])))]) for _ in range(6)]
        passage = list(random.choice(long))
        for _ in range(random.choice([0, 3, 12])):
            passage[random.randrange(24)] = "zz"
        rows.append((doc, "\n".join([*own, "", " ".join(passage), "  ".join(word() for _ in range(5))])))
    out = {r.doc_id: r for r in drop_repeated_lines(spark.createDataFrame(rows, DOC)).collect()}
    expected = plain_lines(rows)
    assert {d: r.text for d, r in out.items()} == expected
    assert all(r.n_lines == sum(bool(x.strip()) for x in dict(rows)[d].split("\n")) for d, r in out.items())
    assert 0 < sum(r.n_dropped for r in out.values()) < sum(r.n_lines for r in out.values())


def test_rounds_grow_with_the_logarithm_of_a_leaf(spark):
    """2,000 lines that share a block and are all unlike."""
    rng = np.random.default_rng(3)
    words = rng.integers(1000, 1 << 31, (2000, 20)).astype(np.uint32)
    words[:, : lines.LEADING + 3] = 7
    rows = [(1, i, 1, words[i].tobytes()) for i in range(2000)]
    left = spark.createDataFrame(rows, "leaf long, line long, n_docs long, tokens binary")
    found = lines._elect_by_blocks(left, lines.ALIKE)
    assert len(found) <= 9
    members = [r for part in found for r in part.collect()]
    assert sorted(r.line for r in members) == list(range(2000)) and all(r.line == r.template for r in members)


def test_a_line_joins_the_better_of_two_leaders(spark):
    a, b = ([*"xyz", *(f"{k}{i}" for i in "abcd")] for k in "ab")  # agree in six of ten places
    both = a[:5] + b[5:]
    words = lambda w: np.array([hash(x) & 0xFFFF for x in ["s", "t", "u", *w]], dtype=np.uint32).tobytes()
    rows = [(1, 1, 9, words(a)), (1, 2, 5, words(b)), (1, 3, 1, words(both))]
    found = lines._elect_by_blocks(spark.createDataFrame(rows, "leaf long, line long, n_docs long, tokens binary"), 0.7)
    assert {r.line: r.template for part in found for r in part.collect()} == {1: 1, 2: 2, 3: 1}


def test_spanning_forest_keeps_components_and_drops_links(spark):
    random.seed(2)
    links = [(random.randrange(40), random.randrange(40)) for _ in range(3000)] + [(100 + i, 100) for i in range(500)]
    links += [(7, None), (None, None), (60, 60)]
    df = spark.createDataFrame(links, "a long, b long").repartition(9)
    forest = spanning_forest(df).collect()
    nodes = {x for r in forest for x in r}
    assert all(r.a < r.b for r in forest) and len(forest) <= 2 * len(nodes)
    parent = {n: n for n in nodes}
    def root(n):
        return n if parent[n] == n else root(parent[n])
    for a, b in links:
        if a is not None and b is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r.node: r.component for r in components(df).collect()} == {n: root(n) for n in nodes}
