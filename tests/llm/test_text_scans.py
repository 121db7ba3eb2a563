import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shelfwise.llm import decontaminate, suffixes
from shelfwise.llm.automata import Automaton, log_likelihood
from shelfwise.llm.decontaminate import contaminated, least_edits
from shelfwise.llm.licenses import TEMPLATES, scan_licenses
from shelfwise.llm.secrets import base_spans, scan_secrets
from shelfwise.llm.suffixes import Suffixes, remove_repeats
from shelfwise.llm.words import slices
from tests.llm.odd import LONG, empty_documents, odd_documents

DOC = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOC)


# Words


def test_word_spans_and_hashes_against_regex():
    random.seed(4)
    texts = ["".join(random.choice("ab Ä\n\t😀.") for _ in range(random.randint(0, 40))) for _ in range(300)] + [None, ""]
    for limit in (7, 1 << 20):
        seen = {}
        found = [[] for _ in texts]
        for part in slices(pa.array(texts)[:], limit=limit):
            starts, ends, rows = part.word_spans()
            for s, e, r in zip(starts, ends, rows):
                found[part.first + r].append(part.data[s:e].tobytes())
        want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
        assert found == want
        assert not seen


# Secrets


def plain_spans(text):
    out = []
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for kind, pattern, fits in (
        ("assign", assign, lambda m: len(m.group(2)) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 32),
    ):
        out += [(m.start(), ("assign", "access", "hex").index(kind), kind, m.end()) for m in pattern.finditer(text) if fits(m)]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_base_spans_against_plain_regexes():
    random.seed(6)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH0123", "0a1b2c3d" * 4, "deadbeef", "ſecret", "é", "x", "-_.", "\n", "password:token: abcdefgh12"]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(1, 12)))
        assert [s[:3] for s in base_spans(text)] == plain_spans(text), text


def test_inferred_formats_add_spans(spark):
    random.seed(7)
    hexa = lambda n: "".join(random.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(random.choice("aeioutrsnl") for _ in range(random.randint(3, 22)))
    code = lambda: f"zq_{random.randint(1000, 9999)}-{hexa(12).upper()}"
    rows = []
    for i in range(300):
        text = " ".join(word() for _ in range(40))
        if i % 3 == 0:
            text += f" token = {code()} end"
        rows.append((i, text))
    rows += [(1000 + i, f"look at {code()} here") for i in range(50)]
    rows += [(2000, "see tokentoken=short and nothing")]
    out = {r.doc_id: r for r in scan_secrets(frame(spark, rows)).collect()}
    assert sum(r.n_assign for r in out.values()) == 100
    assert sum(out[1000 + i].n_added for i in range(50)) >= 45
    assert sum(r.n_added for r in out.values() if r.doc_id < 1000) <= 3
    text = dict(rows)
    for r in out.values():
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(text[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("format")] == [x for x in base.split(",") if x]


def test_automaton_gives_probabilities():
    words = ["ab1", "ab2", "abab1", "ababab1", "ab3"] * 20
    table = Automaton(words).merged().table()
    for row in table:
        assert sum(2 ** p for p, _ in row.values()) == pytest.approx(1)
    assert len(table) < 8
    assert log_likelihood(table, "ab9") > log_likelihood(table, "Q-Q-Q") + 3


def test_secret_odd_rows(spark):
    docs = odd_documents(spark)
    out = scan_secrets(docs).collect()
    assert len(out) == docs.count()
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" for r in out)
    assert scan_secrets(empty_documents(spark)).count() == 0


# Licenses


def test_license_spans(spark):
    notice, mit = TEMPLATES[0][1], TEMPLATES[4][1]
    edited = mit.split()
    for i in (10, 40, 70, 100):
        edited[i] = "changed"
    edited = " ".join(edited[:50] + ["one", "more"] + edited[50:])
    rows = [
        (1, f"Ünï 漢字 {notice} and again\n{notice.upper()}"),
        (2, f"before {edited} after"),
        (3, "Released under something else by the people of the town."),
        (4, " ".join(mit.split()[:60])),
    ]
    out = scan_licenses(frame(spark, rows)).collect()
    one = sorted((r.start, r.end, r.coverage) for r in out if r.doc_id == 1)
    text = rows[0][1]
    assert [text[s:e] for s, e, _ in one] == [notice[:-1], notice.upper()[:-1]] and all(c == 1 for *_, c in one)
    (two,) = [r for r in out if r.doc_id == 2]
    assert two.license == "MIT" and rows[1][1][two.start : two.end].lower().startswith("permission")
    assert two.template_tokens - two.matched == 4
    assert not [r for r in out if r.doc_id in (3, 4)]


def test_short_notices_with_changed_tokens_are_found():
    """Any edit that leaves the coverage, in every short notice at every place."""
    from shelfwise.llm import licenses

    short = [(n, t) for n, t in licenses.TEMPLATES if len(re.findall("[A-Za-z0-9]+", t)) < licenses.SHORT]
    long = [(f"made {k}", " ".join(f"w{k}x{i}" for i in range(k))) for k in (5, 6, 9, 10, 15, 19)]
    for name, text in [*short, *long]:
        words = re.findall("[A-Za-z0-9]+", text)
        index = licenses.TemplateIndex([(name, text)])
        allowed = int((1 - licenses.COVERAGE) * len(words) + 1e-9)
        for first in range(len(words)):
            for edit in ("change", "insert", "drop"):
                new = list(words)
                for at in {(first + i * len(words) // max(1, allowed)) % len(words) for i in range(allowed)}:
                    new[at] = {"change": "other", "insert": f"other {words[at]}", "drop": ""}[edit]
                (part,) = slices(pa.array(["before the " + " ".join(new) + " and after"]), lower=True)
                hashes, _, _, rows = licenses.tokens(part)
                assert [f[1] for f in licenses._found(index, hashes, rows, licenses.COVERAGE)] == [0], (name, new)


def test_license_odd_rows(spark):
    docs = odd_documents(spark)
    extra = spark.createDataFrame([(None, TEMPLATES[1][1]), (5, LONG + TEMPLATES[2][1])], DOC)
    out = scan_licenses(docs.select("doc_id", "text").unionByName(extra)).collect()
    assert sorted((str(r.doc_id), r.license) for r in out) == [("5", TEMPLATES[2][0]), ("None", TEMPLATES[1][0])]
    assert scan_licenses(empty_documents(spark)).count() == 0
    assert scan_licenses(docs, templates=()).count() == 0


# Benchmark passages


def naive_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edit_distance_against_the_dynamic_programme():
    random.seed(8)
    for _ in range(300):
        p = "".join(random.choice("abé") for _ in range(random.randint(1, 12)))
        t = "".join(random.choice("abé") for _ in range(random.randint(0, 25)))
        d = naive_edits(p, t)
        for most in (2, 20):
            assert least_edits(p, t, most) == min(d, most + 1)


def edited(text, edits):
    chars = list(text)
    for _ in range(edits):
        at, kind = random.randrange(len(chars)), random.random()
        if kind < 0.34:
            chars[at] = random.choice("abcdefgh ")
        elif kind < 0.67:
            chars.insert(at, random.choice("abcdefgh "))
        else:
            del chars[at]
    return "".join(chars)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 2000])
def test_recall_and_precision_of_edited_passages(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    random.seed(9)
    word = lambda: "".join(random.choice(["th", "er", "on", "an", "re", "ed", "in"]) for _ in range(random.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(random.randint(20, 60)).capitalize()) for i in range(30)]
    rows, want = [], set()
    for n in range(400):
        item, body = random.choice(items)
        rate = (0, 0.03, 0.08, 0.12)[n % 4]
        host = text(60).split()
        host.insert(random.randrange(60), edited(body, int(rate * len(body))).replace(" ", "\n  ", 3))
        rows.append((n, " ".join(host)))
        want.add((n, item))
    rows += [(1000 + n, text(80)) for n in range(300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = contaminated(frame(spark, rows), bench).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert len(want & got) >= 0.98 * len(want)
    assert not [g for g in got if g[0] >= 1000]
    norm = lambda s: " ".join(s.lower().split())
    body, docs = dict(items), dict(rows)
    for r in out[:60]:  # verified distances are exact
        assert r.edits == naive_edits(norm(body[r.item_id]), norm(docs[r.doc_id]))


@pytest.mark.parametrize("low,high", [(24, 26), (27, 40), (41, 60), (61, 80)])
def test_short_items_within_the_edits_are_all_found(low, high):
    random.seed(low)
    word = lambda: "".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(40)[: random.randint(low, high)].rstrip() + "x") for i in range(20)]
    items = [(i, t[:high].ljust(low, "x")) for i, t in items]
    class Index:
        value = decontaminate.ItemIndex(items)
    docs = [f"{text(20)} {edited(items[n % 20][1], int((0.15, 0.2)[n % 2] * len(items[n % 20][1])))} {text(20)}" for n in range(60)]
    most = {i: int(0.2 * len(t)) for i, t in items}
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(docs)], ["doc_id", "text"])
    found = [r for b in decontaminate._matches(Index, 0.2)(iter([batch])) for r in b.to_pylist()]
    want = {
        (n, n % 20) for n, t in enumerate(docs)
        if least_edits(items[n % 20][1], " ".join(t.lower().split()), most[n % 20]) <= most[n % 20]
    }
    assert len(want) >= 55 and want <= {(r["doc_id"], r["item_id"]) for r in found}


def test_passages_odd_rows(spark):
    docs = odd_documents(spark)
    bench = spark.createDataFrame(
        [(1, "quick brown fox jumps over the lazy dog near"), (1, "quick brown fox jumps over the lazy dog near"),
         (2, None), (3, ""), (4, "short"), (None, "A row without an id but with a text that is long"), (5, LONG[:300])],
        "item_id long, text string",
    ).selectExpr("item_id", "text", "'x' AS doc_id", "1 AS edits")
    out = sorted((r.doc_id, r.item_id, r.edits) for r in contaminated(docs, bench).collect())
    assert out == [(1, 1, 0), (5, 5, 0), (6, 5, 0)]
    assert contaminated(empty_documents(spark), bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0


# Repeated bytes


def brute_repeats(rows, length):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - length + 1):
                key = b[i : i + length]
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        cut = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                cut[i : i + length] = True
        kept = bytes(x for x, c in zip(b, cut) if not c)
        spans = int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum())
        out.append((d, len(b), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeat_rows(seed, n=120):
    random.seed(seed)
    pieces = ["".join(random.choice("abc é") for _ in range(random.randint(20, 140))) for _ in range(25)]
    rows = []
    for _ in range(n):
        text = "".join(random.choice(pieces)[random.randint(0, 10) :] + random.choice(["", "x", "zz"]) for _ in range(random.randint(0, 5)))
        rows.append((random.choice([random.randint(-50, 400), None]) if random.random() < 0.1 else random.randint(-50, 400), text))
    rows += [(500, "a" * 300), (501, "a" * 120 + "b" + "a" * 90), (499, "a" * 49), (502, None), (503, ""), (504, "ab" * 100), (505, "ab" * 40)]
    rows += [rows[3], (3, "q" * 200), (3, "q" * 200), (2, "q" * 60)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_brute_force(spark, seed):
    rows = repeat_rows(seed)
    got = remove_repeats(frame(spark, rows).repartition(6)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, 50)


def test_collisions_fall_back_to_bytes():
    random.seed(3)
    texts = ["".join(random.choice("ab") for _ in range(random.randint(1, 30))).encode() for _ in range(200)]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    stops = np.cumsum([len(t) for t in texts])
    starts = stops - np.array([len(t) for t in texts])
    group = np.array([random.randrange(5) for _ in texts])
    want = [(group[i], texts[i][:20]) for i in sorted(range(200), key=lambda i: (group[i], texts[i][:20]))]
    for broken in (False, True):
        suffixes_ = Suffixes(data, starts, stops, 20)
        if broken:
            suffixes_.prefix[:] = 0  # all hashes collide
        order, common = suffixes_.sort(group)
        assert [(group[i], texts[i][:20]) for i in order] == want
        for a, b, c in zip(order, order[1:], common[1:]):
            if group[a] == group[b]:
                x, y = texts[a][:20], texts[b][:20]
                assert x[:c] == y[:c] and (c == min(len(x), len(y)) or x[c] != y[c])
            else:
                assert c == 0


def test_repeats_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {(str(r.doc_id), r.n_bytes): r for r in remove_repeats(docs).collect()}
    assert got["5", len(LONG)].n_removed == 0  # repeated rows are one document
    assert got["6", len(LONG)].n_removed == len(LONG) and got["6", len(LONG)].n_spans == 1
    assert sum(r.n_removed for r in got.values()) == len(LONG)
    assert remove_repeats(docs).count() == len(rows)
    assert remove_repeats(empty_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs, length=50, gram=10)
    assert suffixes.LENGTH == 50
