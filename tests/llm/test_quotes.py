import random

from shelfwise.llm.quotes import own_text, parse, reply_order

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def test_levels_and_attribution():
    assert parse("> > a\n>b\nc") == [(2, "a"), (1, "b"), (0, "c")]
    assert own_text("On Monday, Ann wrote:\n> hi there\n\nYes.\n") == "Yes."
    assert own_text("She wrote:\nnothing quoted") == "She wrote:\nnothing quoted"


def build(spark):
    rows = [
        (1, 0, "u", "Hello there my friend.\nHow are you today?", "x"),
        (1, 1, "a", "> Hello there my friend.\n> How are  you TODAY?\nFine, thanks a lot.", "x"),
        (1, 2, "u", "Ann wrote:\n> > Hello there my friend.\n> Fine, thanks a lot.\n\nGood to know.", "x"),
        (1, 3, "u", "A new topic for all of you.", "x"),
        (1, 4, "u", "> How are you today?\nStill here.", "x"),
        (1, 5, "u", "> Never said by anyone here.\nWell.", "x"),
        (1, 6, "u", "> A later thing that comes after.\nOdd.", "x"),
        (1, 7, "u", "A later thing that comes after.", "x"),
        (2, 0, "u", "> Hello there my friend.\nOther conversation.", "x"),
        (3, 0, None, None, None),
        (3, 1, "u", "", None),
        (None, 1, "u", "> x", None),
        (4, None, "u", "> y", None),
        (5, 0, "u", "Same words in here.", None),
        (5, 0, "u", "Same words in here.", None),
        (5, 1, "u", "> Same words in here.", None),
    ]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_links_threads_and_order(spark):
    df, rows = build(spark)
    out = reply_order(df.repartition(5)).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn): r for r in out}
    assert (by[1, 1].parent_turn, by[1, 1].depth, by[1, 1].reply_text) == (0, 1, "Fine, thanks a lot.")
    assert (by[1, 2].parent_turn, by[1, 2].depth, by[1, 2].thread_turn) == (1, 2, 0)
    assert by[1, 2].reply_text == "Good to know."
    assert by[1, 4].parent_turn == 0
    assert (by[1, 5].parent_turn, by[1, 5].n_quotes, by[1, 5].n_linked) == (None, 1, 0)
    assert by[1, 6].parent_turn is None  # the original would be a later turn
    assert by[2, 0].parent_turn is None and by[2, 0].thread_turn == 0
    assert by[3, 0].reply_text is None and by[3, 1].reply_text == ""
    assert by[None, 1].parent_turn is None and by[4, None].depth == 0
    assert by[5, 1].parent_turn == 0 and by[5, 1].reply_text == ""
    order = sorted((r for r in out if r.conv_id == 1), key=lambda r: (r.thread_turn, r.depth, r.turn))
    assert [r.turn for r in order] == [0, 1, 4, 2, 3, 5, 6, 7]


def test_long_chain(spark):
    rows = [(9, 0, "u", "Message number zero is here.", None)]
    rows += [(9, t, "u", f"> Message number {('zero', t - 1)[t > 1]} is here.\nMessage number {t} is here.", None) for t in range(1, 41)]
    out = {r.turn: r for r in reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[t].depth == t and out[t].thread_turn == 0 for t in range(41))


def test_empty(spark):
    assert reply_order(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_passages(text):
    """(level, text) of runs of lines of one level and of lines of three words, without hashes."""
    found, run, level = set(), [], None
    norm = lambda lines: " ".join(" ".join(lines).casefold().split())
    for line in [*text.split("\n"), None]:
        bare = (line or "").lstrip(" \t")
        at = 0
        while bare.startswith(">"):
            at, bare = at + 1, bare[1:].lstrip(" \t") if bare[1:2] in (" ", "\t") else bare[1:]
        words = bare if at else line or ""
        if line is None or at != level or not words.strip():
            if run:
                found.add((level, norm(run)))
            run, level = [], at
        if words.strip():
            run.append(words)
            if len(words.split()) >= 3:
                found.add((at, norm([words])))
    return found


def plain_order(rows):
    """(conv, turn) -> n_quotes, n_linked, parent, thread, depth; every message against every other."""
    held = {}
    for conv, turn, _, text, *_ in rows:
        if conv is not None and turn is not None and text is not None:
            held.setdefault((conv, turn), set()).update(plain_passages(text))
    out = {}
    for (conv, turn), mine in held.items():
        quotes = [(level, words) for level, words in mine if level]
        links = []
        for level, words in quotes:
            first = min((t for (c, t), other in held.items() if c == conv and (0, words) in other), default=None)
            if first is not None and first < turn:
                links.append((level, -first))
        out[conv, turn] = [len(quotes), len(links), -min(links)[1] if links else None]
    for (conv, turn), answer in out.items():
        at, depth = turn, 0
        while out[conv, at][2] is not None:
            at, depth = out[conv, at][2], depth + 1
        answer += [at, depth]
    return out


def test_against_every_message(spark):
    random.seed(21)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(random.randint(1, 25)):
            lines = []
            for _ in range(random.randint(0, 3)):
                if said and random.random() < 0.8:
                    marks = random.choice([">", "> ", ">> ", "> > ", " > "])
                    quoted = random.choice(said).upper() if random.random() < 0.3 else random.choice(said)
                    lines += [marks + part for part in quoted.split("\n")] + [""] * random.randint(0, 1)
            for _ in range(random.randint(0, 2)):
                own = "\n".join(" ".join(random.choice("ab cd ef gh".split()) for _ in range(random.randint(1, 5))) for _ in range(random.randint(1, 2)))
                said.append(own)
                lines += [*own.split("\n"), ""]
            rows.append((conv, turn, "u", "\n".join(lines), "x"))
            if random.random() < 0.1:
                rows.append((conv, turn, "u", random.choice(["> ab cd ef", "again the same turn"]), "x"))
    long = "one two three four five\n" * 20000
    rows += [(50, 0, "u", long, "x"), (50, 1, "u", "> one two three four five\nYes.", "x"), (50, 2, "u", ">" * 3000 + " ab cd ef", "x")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS parent_turn", "'y' AS n_quotes", "2 AS of_turn")
    out = reply_order(df.repartition(6))
    assert {"of_turn"} <= set(out.columns) and out.count() == len(rows)
    expected = plain_order(rows)
    for r in out.collect():
        assert [r.n_quotes, r.n_linked, r.parent_turn, r.thread_turn, r.depth] == expected[r.conv_id, r.turn], (r.conv_id, r.turn)
    assert sum(e[2] is not None for e in expected.values()) > 30
