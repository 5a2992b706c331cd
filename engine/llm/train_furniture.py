"""Fits furniture.json: python -m engine.llm.train_furniture FOLDER.

Labelled pages: (a) MADE pages put together here, whose furniture is known; (b) at most LABELLED pages of FOLDER with weak labels, the wording and
run rules of furniture.py by themselves. Every fifth page is held out. Potentials are fitted by gradient ascent on the likelihood of the states of
all nodes; a block's state is that of most of its lines.
"""

from __future__ import annotations

import json
import random
import sys
from collections import Counter
from pathlib import Path

import pandas as pd

from engine.llm.furniture import Model, Tree, fixed_lines, list_runs, plain, tree

MADE, LABELLED, ROUNDS, RATE, SHRINK = 600, 1500, 12, 0.3, 1e-4
MENUS = ["Home", "Documentation", "Pricing", "Forum", "Support", "Downloads", "Log in", "Blog", "Search", "Community"]
TOPS = ["This site uses cookies to remember you.", "Accept all", "Only necessary", "Version 4.2 (latest)", "English | Deutsch | Français", "Skip to content", "Home > Guides > Lists", "You are viewing an old version of this page", "Toggle navigation"]
ENDS = ["Was this page helpful? Yes No", "Send feedback about this page", "Previous: Lists", "Next: Trees", "© 2023 Example. All rights reserved.", "Terms of Use · Privacy Policy", "Back to top", "Subscribe to our newsletter", "Share this page", "Sign in to comment", "Last updated 2023-01-02"]
TITLES = ["Using lists", "How the tree sorts keys", "Limits of Sort", "Setting up the reader", "Notes for 3.1", "Walking a tree", "Keys and values", "Errors of the parser"]
PROSE = ["The reader keeps a list of open files and closes the oldest one first.", "Call Sort before Walk, or the keys come in any order.", "Why does the parser drop my keys? Because the list was cut.", "A footer widget holds one row of buttons.", "Step 1: Open the list of keys.", "Node* Item = Find(3);", "Note: this call is slow.", "1. Press Build twice to see the tree."]


def made_page(r: random.Random) -> tuple[str, set[int]]:
    lines: list[tuple[str, bool]] = []
    put = lambda xs, site: lines.extend((x, site) for x in xs)
    gap = lambda: lines.append(("", False)) if r.random() < 0.5 else None
    put(r.sample(MENUS, r.randint(0, 6)), True)
    put(r.sample(TOPS, r.randint(0, 4)), True)
    gap()
    if r.random() < 0.5:
        put([r.choice(["On this page", "Contents", "In this article"]), *r.sample(TITLES, r.randint(2, 5))], True)
        lines.append(("", False))
    put([r.choice(TITLES)], False)
    for _ in range(r.randint(1, 5)):
        gap()
        put(r.sample(PROSE, r.randint(1, 3)), False)
        if r.random() < 0.3:
            put([r.choice(TITLES), r.choice(PROSE)], False)
        if r.random() < 0.1:
            put([r.choice(ENDS)], True)
    gap()
    if r.random() < 0.4:
        put([r.choice(["Related articles", "See also", "You may also like"]), *r.sample(TITLES, r.randint(2, 4))], True)
    put(r.sample(ENDS, r.randint(0, 6)), True)
    return "\n".join(x for x, _ in lines), {n for n, (x, site) in enumerate(lines, 1) if site and x}


def weak_labels(content: str) -> set[int]:
    lines = [x.rstrip("\r") for x in content.split("\n")]
    texts = [plain(x) for x in lines]
    fixed = fixed_lines(texts)
    return {i + 1 for i, x in enumerate(fixed) if x} | {j + 1 for j, (_, entry) in list_runs(lines, texts, fixed).items() if entry}


def states(t: Tree, furniture: set[int]) -> list[int]:
    out = [int(n in furniture) for n in t.line]
    below: dict[int, Counter] = {}
    for i in range(len(t.parent) - 1, 0, -1):
        if t.edge[i] == "block":
            out[i] = int(below[i][1] > below[i][0]) if i in below else 0
        elif t.edge[i] == "line":
            below.setdefault(t.parent[i], Counter())[out[i]] += 1
    return out


def fit(pages: list[tuple[Tree, list[int]]], r: random.Random) -> Model:
    m = Model(edge={k: [0.0] * 4 for k in ("block", "line", "entry", "after")})
    for n in range(ROUNDS):
        r.shuffle(pages)
        for t, y in pages:
            marginal, pairs = m.messages(t)
            rate = RATE / (1 + n) / len(y) ** 0.5
            for i, x in enumerate(t.features):
                for f in x:
                    m.node[f] = m.node.get(f, 0.0) * (1 - SHRINK * rate) + rate * (y[i] - marginal[i])
                if i:
                    e = m.edge[t.edge[i]]
                    for k in range(4):
                        e[k] += rate * ((2 * y[t.parent[i]] + y[i] == k) - pairs[i][k])
    return m


def train(folder: str) -> None:
    r = random.Random(5)
    labelled = [made_page(r) for _ in range(MADE)]
    records = pd.read_parquet(f"{folder}/source_records.parquet", columns=["id", "content", "metadata"]).dropna().drop_duplicates("content").sort_values("id")
    for content in records["content"][records["metadata"].str.contains('"url"')].iloc[:LABELLED]:
        labelled.append((content, weak_labels(content)))
    r.shuffle(labelled)
    pages = [(t := tree(c), states(t, site)) for c, site in labelled if c]
    held, pages = pages[::5], [x for i, x in enumerate(pages) if i % 5]
    m = fit(pages, r)
    m = Model({k: round(v, 4) for k, v in sorted(m.node.items())}, {k: [round(x, 4) for x in v] for k, v in m.edge.items()})
    Path(__file__).with_name("furniture.json").write_text(json.dumps({"node": m.node, "edge": m.edge}, indent=1) + "\n")
    right = wrong = missed = 0
    for t, y in held:
        for n, p, s in zip(t.line, m.messages(t)[0], y, strict=True):
            right, wrong, missed = right + bool(n and p >= 0.5 and s), wrong + bool(n and p >= 0.5 and not s), missed + bool(n and p < 0.5 and s)
    print(f"{len(held)} held-out pages: {right} lines right, {wrong} wrong, {missed} missed")


if __name__ == "__main__":
    train(sys.argv[1])
