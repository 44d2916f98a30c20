"""Recall of benchmark decontamination by kind of edit, at the largest number of edits: ``python -m tests.llm.recall``."""

from __future__ import annotations

import random
import sys

from plotwise.llm.decontaminate import SHARE, Index

KINDS = ("substitutions", "deletions", "insertions", "mixed")


def edited(words: list[str], n: int, kind: str, rng: random.Random) -> list[str]:
    """The words after n edits of the kind, at random places; what comes in is in no item."""
    words = list(words)
    for k in range(n):
        do = rng.choice(KINDS[:3]) if kind == "mixed" else kind
        at = rng.randrange(len(words))
        if do == "substitutions":
            words[at] = f"new{k}x"
        elif do == "deletions":
            del words[at]
        else:
            words.insert(at, f"new{k}x")
    return words


def recall(items: list[tuple[int, str]], kind: str, rounds: int = 4, share: float = SHARE, seed: int = 1) -> float:
    """The share of items found in a text that holds them after as many edits as they may have."""
    rng, index, found = random.Random(seed), Index(items), 0
    words = sorted({w for _, t in items for w in t.split()})
    for _ in range(rounds):
        for item, text in items:
            own = text.split()
            noise = lambda: [rng.choice(words) for _ in range(30)]
            held = edited(own, int(len(own) * share + 1e-9), kind, rng)
            found += item in index.holds(" ".join([*noise(), *held, *noise()]))
    return found / (rounds * len(items))


if __name__ == "__main__":
    import duckdb

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    import re

    rows = duckdb.sql(f"select item_id, text from '{folder}/benchmark.parquet'").fetchall()
    items = [(i, " ".join(re.findall(r"\w+", t.lower()))) for i, t in rows]
    for kind in KINDS:
        print(kind, round(recall(items, kind), 4))
