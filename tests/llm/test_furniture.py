import itertools
import math
import random

from engine.llm.furniture import Model, Tree, furniture, p5_bodies, p5_found
from engine.llm.train_furniture import made_page

PAGE = """Wir verwenden Cookies. Alle akzeptieren / Ablehnen
HOME » FORUMS » LOG IN
Pricing ▾
Home › Docs › NetKit › FPanel
Version 5.3.4 switch version
On this page
Limits of Walk
Notes for 5.4

FPanel in practice
The panel keeps a session cookie until the host migrates.
Limits of Walk
Note: this feature is experimental. Add a Footer widget to the panel.
FPanel* Item = Make();
Notes for 5.4
A sidebar entry is one row of the tree view; press it to call the bound handler.
Was this page helpful? Yes No
Related articles
Setting up NetKit

How the renderer splits tiles
Subscribe to our newsletter
Previous: Limits of Run
© 2024 Larkspur Foundry. All rights reserved."""


def test_lines_of_the_site():
    assert furniture(PAGE) == furniture(PAGE.replace("\n", "\r\n")) == [*range(1, 9), 17, 18, 19, 21, 22, 23, 24]


def test_pages_only(spark, tmp_path):
    rows = [("a", PAGE, '{"url": "https://x.example/a"}'), ("a", PAGE, '{"url": "https://x.example/a"}'), ("b", "Pricing", '{"topic": "x"}'), ("c", None, '{"url": "https://x.example/c"}')]
    spark.createDataFrame(rows, "id string, content string, metadata string").write.parquet(f"{tmp_path}/source_records.parquet")
    assert {tuple(r) for r in p5_found(spark, str(tmp_path)).collect()} == {("a", n) for n in furniture(PAGE)}


def test_messages_give_the_marginals_of_enumeration():
    r = random.Random(3)
    t = Tree()
    for i in range(1, 9):
        t.add(r.randrange(i), r.choice(["block", "line", "entry"]), [f"f{r.randrange(4)}"], i)
    m = Model({f"f{k}": r.uniform(-2, 2) for k in range(4)}, {k: [r.uniform(-2, 2) for _ in range(4)] for k in ("block", "line", "entry")})
    weight = lambda y: math.exp(sum(y[i] * sum(m.node.get(f, 0) for f in t.features[i]) + (m.edge[t.edge[i]][2 * y[t.parent[i]] + y[i]] if i else 0) for i in range(9)))
    every = [(y, weight(y)) for y in itertools.product((0, 1), repeat=9)]
    z = sum(w for _, w in every)
    marginal, pairs = m.messages(t)
    for i in range(9):
        assert abs(marginal[i] - sum(w for y, w in every if y[i]) / z) < 1e-9
        if i:
            assert abs(pairs[i][3] - sum(w for y, w in every if y[i] and y[t.parent[i]]) / z) < 1e-9


def test_held_out_made_pages():
    r = random.Random(99)
    right = wrong = missed = 0
    for _ in range(100):
        content, site = made_page(r)
        found = set(furniture(content))
        right, wrong, missed = right + len(found & site), wrong + len(found - site), missed + len(site - found)
    assert right > 0.97 * (right + missed) and wrong < 0.03 * right


def test_very_long_and_empty_pages():
    assert furniture("") == [] and furniture("\n \r\n") == []
    assert furniture("Back to top\n" + "The reader keeps a list of files and closes one.\n" * 20_000)[:1] == [1]


def test_bodies_and_named_urls(spark, tmp_path):
    rows = [("a", PAGE, '{"url": "https://x.example/a/?q=1#top"}'), ("b", None, '{"url": "https://x.example/b"}'), ("c", "x", None)]
    spark.createDataFrame(rows, "id string, content string, metadata string").write.parquet(f"{tmp_path}/source_records.parquet")
    spark.createDataFrame([("https://x.example/a#z", "e"), ("https://x.example/a", "e"), (None, "e")], "url string, error string").write.parquet(f"{tmp_path}/parse_issues.parquet")
    out = {r.id: r for r in p5_bodies(spark, str(tmp_path)).collect()}
    assert out.keys() == {"a", "b"} and out["a"].without_body and not out["b"].without_body and out["b"].body is None
    assert "FPanel in practice" in out["a"].body and "newsletter" not in out["a"].body
