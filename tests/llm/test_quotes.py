"""Quotation linking against brute force, and lines of any length."""

import random
import re

from pyspark.sql import functions as F

from plotwise.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """(n_quotes, depth, n_linked, reply_to, reply_conv, body) of each message, in plain Python."""
    norm = lambda text: re.sub(r"[ \t\n\r\f\v]+", " ", text.lower()).strip(" ")

    def parse(text):
        lines = []
        for line in re.split("\r?\n", text or ""):
            lead = re.match("[ \t>]*", line)[0]
            level = lead.count(">")
            if level:
                line = line[lead.rindex(">") + 1 :]
                line = line[1:] if line[:1] in " \t" and line else line
            lines.append((level, line))
        own = [c for k, (lev, c) in enumerate(lines) if lev == 0 and not (k + 1 < len(lines) and lines[k + 1][0] > 0 and re.search(r"(?i)^.{0,200}\b(wrote|said)[ \t]*:[ \t]*$", c))]
        passages = []
        for k, (lev, c) in enumerate(lines):
            if lev and k and lines[k - 1][0] == lev:
                passages[-1][1].append(c)
            elif lev:
                passages.append((lev, [c]))
        return re.sub("\n{3,}", "\n\n", "\n".join(own)).strip(" \t\n\r\f\v"), passages

    read = [(c, t, *parse(text)) for c, t, _, text in rows]
    places = {}
    for conv, turn, body, _ in read:
        if conv is not None and turn is not None:
            for unit in {norm(u) for u in [body, *re.split(r"\n\s*\n", body), *body.split("\n")]} - {""}:
                old = places.setdefault(unit, {})
                old[conv] = min(turn, old.get(conv, turn))
    out = []
    for conv, turn, body, passages in read:
        near, far, n = [], [], 0
        for level, contents in passages if conv is not None and turn is not None else []:
            units = [[norm(" ".join(contents))], [norm(x) for x in contents]]
            at = [[places[u][conv] for u in tier if conv in places.get(u, {}) and places[u][conv] < turn] for tier in units]
            away = [[min((c, t) for c, t in places[u].items() if c != conv) for u in tier if set(places.get(u, {})) - {conv}] for tier in units]
            here = max(at[0], default=None) if at[0] else max(at[1], default=None)
            there = min(away[0]) if away[0] else min(away[1], default=None)
            n += here is not None or there is not None
            if here is not None:
                near.append((-level, here))
            elif there is not None:
                far.append(there)
        reply = max(near)[1] if near else None
        out.append((conv, turn, len(passages), max((lev for lev, _ in passages), default=0), n, reply, conv if near else min(far)[0] if far else None, body))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"hash": F.lit(1), "body": F.lit(2), "level": F.lit(3), "first": F.lit(4)})


def test_all_links(spark):
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta".split()
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    rows = []
    for conv in range(25):
        for turn in range(rng.randint(1, 6)):
            lines = []
            for _ in range(rng.randint(1, 7)):
                kind = rng.random()
                text = rng.choice([line(), line().upper(), "  " + line(), ""])
                if kind < 0.5:
                    text = rng.choice(["> ", ">", " > ", "> > ", ">>", "\t>  "]) + text
                elif kind < 0.6:
                    text = "Ann wrote:"
                lines.append(text)
            rows.append((conv, turn, "user", rng.choice(["\n", "\n", "\r\n"]).join(lines)))
    rows += [(None, 0, "user", "> alpha"), (1, None, "user", "> beta"), (2, 0, None, None), (2, 9, "user", ""), rows[3], rows[3]]
    got = [(r.conv_id, r.turn, r.n_quotes, r.quote_depth, r.n_linked, r.reply_to, r.reply_conv, r.body) for r in quotes.linked(frame(spark, rows)).collect()]
    want = brute(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[4] for w in want) > 30 and any(w[6] is not None and w[6] != w[0] for w in want)


def test_what_comes_first(spark):
    rows = [
        (1, 0, "user", "> X marks it"), (1, 1, "user", "x marks it"), (2, 0, "user", "X marks it"),
        (3, 0, "user", "deep line"), (3, 1, "user", "> nobody said this\n> > deep line"),
        (4, 0, "user", "one two\nthree four"), (4, 1, "user", "three four"), (4, 2, "user", "> one two three\n> four"), (4, 3, "user", "> one two\n> three four"),
    ]
    got = {(r.conv_id, r.turn): (r.n_linked, r.reply_to, r.reply_conv) for r in quotes.linked(frame(spark, rows)).collect()}
    assert got[1, 0] == (1, None, 2)  # its own conversation says it only later
    assert got[3, 1] == (1, 0, 3)  # the outer passage is unknown
    assert got[4, 2] == (1, 0, 4) and got[4, 3] == (1, 0, 4)  # the whole passage beats its last line


def test_lines_of_any_length(spark):
    n = 1_000_000
    rows = [(1, 0, "user", ">" * n), (1, 1, "user", "> " * (n // 2) + "x"), (1, 2, "user", " " * n), (1, 3, "user", "\t" * n + "y"), (1, 4, "user", "\n" * 50_000), (1, 5, "user", "a wrote:" + " " * n + "\n> y"), (1, 6, "user", "> " + "w " * n)]
    got = {r.turn: r for r in quotes.linked(frame(spark, rows)).collect()}
    assert got[0].quote_depth == n and got[1].quote_depth == n // 2 and got[2].body == "" and got[3].body == "y" and got[4].body == ""
    assert got[5].body == "" and got[5].reply_to == 3 and got[6].quote_depth == 1
