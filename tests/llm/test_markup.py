import time

import numpy as np
import pytest

from engine.llm import boilerplate
from engine.llm.markup import convert, families, p1_clean, p1_found

CASES = [
    ("<h1>Notes</h1>\n\n- plain", {"html", "markdown"}), ("a &amp; b", {"html"}), ("x <!-- y --> z", {"html"}), ("<A NAME=top>x", {"html"}),
    ("```cpp\nif (a < b) { [[x]] <b> }\n```", {"markdown"}), ("<pre><code>**a** [[b]] \\emph{c}</code></pre>", {"html"}), ("Set `the` **limit** [guide](a.md)", {"markdown"}), ("Notes\n=====", {"markdown"}),
    ("== Notes ==\n'''Bold''' [[Page|text]]", {"wiki"}), ("{{Since|5.2}}", {"wiki"}), ("{{CodeBlock|lang=cpp}}\n <b>x</b>\n{{CodeEnd}}", {"wiki"}),
    ("\\section{Notes} in $O(n^2)$", {"latex"}), ("\\begin{verbatim}\n# a <b>\n\\end{verbatim}", {"latex"}), ("Time is $n^2$ and &mdash;", {"latex", "html"}),
    ("* item\n| a | b |\n==\n• other", set()), ("Keep a < b && c > d. TArray<FHit> and TMap<FName, int32> work.", set()), ("The folder D:\\textures\\begin\\section; $5 per seat and $9 per host; $(ProjectDir) and $PATH", set()),
    ("max_walk_speed_scale, x * y * z, *Actor, A = {1, 2} and {{0, 1}, {1, 0}}, #include order, [0, 1] (see below)", set()), ("FPanel* Item = Make();\nif (Item->Num() < 7) { Item->Reset(); }", set()),
]


@pytest.mark.parametrize("text, expected", CASES)
def test_families(text, expected):
    assert set(families(text)) == set(families(text.replace("\n", "\r\n"))) == expected


def test_each_field_by_itself(spark, tmp_path):
    rows = [("a", "<b>x</b> and **y**", "[[x]]"), ("a", "<b>x</b> and **y**", "[[x]]"), ("b", None, None), ("c", "plain", "== x ==")]
    spark.createDataFrame(rows, "id string, content string, title string").write.parquet(f"{tmp_path}/source_records.parquet")
    assert sorted(map(tuple, p1_found(spark, str(tmp_path)).collect())) == [("a", "content", "html"), ("a", "content", "markdown"), ("a", "title", "wiki"), ("c", "title", "wiki")]


def test_structure_stays():
    assert convert("# Notes\n\nSee **the** [guide](a.md).\n\n```cpp\nif (a < b) { **x** }\n```\n- one\n- two")[0] == "Notes\n\nSee the guide.\n\nif (a < b) { **x** }\n\n- one\n- two"
    assert convert("<h2>Notes</h2><ul><li>a &amp; b</li><li>c</li></ul><pre><code>x &lt; y</code></pre>")[0] == "Notes\n\n- a & b\n- c\n\nx < y"
    assert convert("\\section{Notes} of \\emph{all} in $O(n^2)$\n\\begin{itemize}\n\\item a\n\\end{itemize}")[0] == "Notes of all in O(n^2)\n\n- a"
    assert convert("== Notes ==\n'''Bold''' [[Page|text]] {{Since|5.2}} [https://x.example y]")[0] == "Notes\nBold text  y"
    assert convert("plain a < b\r\nc")[0] == "plain a < b\nc" and convert("") == ("", {})


def test_converted_texts_hold_few_marks(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/source_records.parquet").select("content").collect()
    marked = [r.content for r in rows if r.content and families(r.content)]
    left = [x for x in marked if families(convert(x)[0])]
    assert marked and len(left) <= 0.4 * len(marked)  # code that stays may hold marks of its own


def test_open_marks_take_linear_time():
    for unit in ("~", "<pre>", "<code>x</pre>", "{{CodeBlock}}", "\\begin{verbatim}", "```\n", "[a](", "'" * 5, "$a", "<!--", "{{a"):
        began = time.perf_counter()
        convert(unit * (50_000 // len(unit)))
        assert time.perf_counter() - began < 8, unit


def test_repeated_runs_go_and_others_stay(spark, monkeypatch):
    menu, foot = "Home Docs Forum Blog Shop Help Login News Jobs About", "All rights are reserved by the owner of this small site"
    body = lambda i: " ".join(f"w{i}_{k}" for k in range(30))
    rows = [(f"p{i}", None, f"{menu}\n{body(i)}\n{foot}", "a.example") for i in range(7)] + [("m", None, f"{menu}\n{body(0)}\n{foot}", "a.example"), ("q", None, f"{menu}\n{body(9)}", "b.example")]
    frame = spark.createDataFrame(rows, "id string, title string, content string, host string")
    for size in (2000, 2):
        monkeypatch.setattr(boilerplate, "SHARD", size)
        out = {r.id: r.content for r in boilerplate.without_repeats(frame).collect()}
        assert all(out[f"p{i}"] == body(i) for i in range(7)) and out["m"] == body(0)
        assert out["q"] == f"{menu}\n{body(9)}"


def test_runs_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("ab"), rng.integers(0, 60))) for _ in range(12)]
    key, n, place, owner = boilerplate.runs(texts)
    seen = {}
    for k, x in enumerate(texts):
        w = x.split()
        for i in range(len(w) - boilerplate.RUN + 1):
            seen.setdefault(tuple(w[i : i + boilerplate.RUN]), set()).add(k)
    assert sorted(n.tolist()) == sorted(map(len, seen.values())) and len(set(key.tolist())) == len(seen)
    assert (place >= 0).sum() == sum(max(0, len(x.split()) - boilerplate.RUN + 1) for x in texts)


def test_no_records(spark, tmp_path):
    spark.createDataFrame([], "id string, content string, title string, metadata string, host string").write.parquet(f"{tmp_path}/source_records.parquet")
    assert p1_found(spark, str(tmp_path)).count() == 0 and p1_clean(spark, str(tmp_path)).count() == 0
