import time

import pytest

from engine.operators import cpp, index, pages
from engine.operators.chunking import Limits, atoms, code_chunks, code_parts, count, head, markdown_chunks, sections, tail, windows

HTML = """<html><head><title>Doors | Site</title><script>if (a < b) { document.write("</p>"); }</script></head><body>
<nav><ul><li>Home</li></ul></nav><header><h1>All  about doors</h1></header>
<p>See <b>the</b> <a href="/x">list</a>.<p>Next <code>a`b</code> line<br>cut
<ul><li>one<ul><li>deep</li></ul><li>two</ul><ol><li>first</ol>
<pre><code class="language-cpp">if (a &lt; b) {
  x();
}</code></pre>
<table><tr><th>A<th>B|C</tr><tr><td>1</table><blockquote><p>said</p></blockquote><h2>End</h2><img src="i.png" alt="pic"></body></html>"""


def test_html_to_markdown():
    assert pages.title_of(pages.parse(HTML)) == "All about doors"
    assert pages.title_of(pages.parse("<title>Doors | Site</title>")) == "Doors" and pages.title_of(pages.parse("x")) is None
    assert pages.markdown(HTML, "https://s.example/a/") == (
        "# All about doors\n\nSee **the** [list](https://s.example/x).\n\nNext ``a`b`` line\ncut\n\n- one\n  - deep\n- two\n\n1. first\n\n"
        "```cpp\nif (a < b) {\n  x();\n}\n```\n\n| A | B\\|C |\n| --- | --- |\n| 1 |  |\n\n> said\n\n## End\n\n![pic](https://s.example/a/i.png)"
    )
    assert pages.markdown("") == "" and pages.markdown("<div>" * 3000 + "x") == "x"


def test_sections_and_fences():
    text = "intro\n# A\none\n## B\n```\n# no heading\n```\n### C ###\n# D\nfour"
    assert sections(text, "T") == [(["T"], "intro"), (["A"], "one"), (["A", "B"], "```\n# no heading\n```"), (["D"], "four")]
    assert pages.heading_paths(text) == [["A"], ["A", "B"], ["D"]]
    assert [c for _, c in atoms("a\nb\n\n```x\nc\n\nd\n```\ne")] == [False, True, False]


def test_markdown_chunks_keep_limits_and_overlap():
    limits = Limits(10, 20, 30, 8)
    body = "\n\n".join(f"word{i} " * 9 + "end" for i in range(8))
    chunks = markdown_chunks(f"# T\n\n{body}", "x", limits)
    assert len(chunks) > 2 and all(count(t) <= 30 for *_, t in chunks) and [p for _, p, _, _ in chunks] == list(range(1, len(chunks) + 1))
    assert all(x.startswith("# T") for *_, x in chunks)
    code = "```\n" + "a b c d e f g h i j\n" * 8 + "```"
    parts = [t for *_, t in markdown_chunks(f"# T\n\nfirst words here\n\n{code}\n\nlast words", "x", limits)]
    assert any(code in p for p in parts) and sum(code in p for p in parts) == 1
    assert markdown_chunks("# T\n\nshort", "x", limits) == [(["T"], 1, 1, "# T\n\nshort")]
    assert markdown_chunks("", "x", limits) == []
    with pytest.raises(ValueError):
        Limits(5, 4, 3, 1)


def test_code_parts():
    limits = Limits(0, 10, 12, 4)
    text = "\n".join(f"a{i} b c d" for i in range(9))
    parts = code_parts(text, limits)
    assert parts[0].split("\n") == [f"a{i} b c d" for i in range(3)]
    assert parts[1].split("\n")[0] == "a2 b c d"  # the overlap
    assert "".join(code_parts("x y " * 50, limits)).replace(" ", "") == "xy" * 50
    assert code_chunks("class A {};", "h", limits, False)[0][:3] == (1, 1, False)
    assert code_chunks("x " * 50, "h", limits, False)[0][2] is True


def test_tokens():
    assert count("树木 tree_1 3.5, (x)") == 8 and head("a b  c d", 3) == "a b  c" and tail("a b c  d", 2) == "c  d" and head("a", 0) == tail("a", 0) == ""
    assert windows("a b c d e", 2) == ["a b", "c d", "e"] and windows("", 3) == []


CPP = """#include "x.h"
// class Not {};
namespace N {
UCLASS(Blueprintable, meta=(A="(x"))
class CORE_API ADoor final : public AActor, private IOpen
{
public:
    ADoor();
    virtual ~ADoor() {}
    UPROPERTY(EditAnywhere)
    float Width = 2.f;
    UFUNCTION()
    virtual void Open(int32 Angle) const override;
    int Closed() const { if (x) { Call(); } return 1; }
};
struct FPlain { int a; };
enum class EKind : int { One, Two };
void Free(const char* s = ");{") { int y = Other(3); }
}
void N::ADoor::Open(int32 Angle) const
{
    Width = Angle;
}
ADoor::ADoor() : Width(1) { }
int Value = Make(3);
"""


def test_cpp_symbols():
    found = [(s.kind, s.qualified) for s in cpp.symbols(CPP)]
    assert found == [
        ("class", "ADoor"), ("constructor", "ADoor::ADoor"), ("constructor", "ADoor::~ADoor"), ("property", "ADoor::Width"), ("method", "ADoor::Open"), ("method", "ADoor::Closed"),
        ("struct", "FPlain"), ("enum", "EKind"), ("function", "Free"), ("method", "N::ADoor::Open"), ("constructor", "ADoor::ADoor"),
    ]
    door = cpp.symbols(CPP)[0]
    assert door.annotations == ["UCLASS"] and door.bases == ["AActor", "IOpen"] and CPP[door.start : door.end].startswith("UCLASS") and CPP[door.start : door.end].endswith("}")
    masked = cpp.masked(CPP)
    assert len(masked) == len(CPP) and masked.count("\n") == CPP.count("\n") and "Not" not in masked
    assert cpp.symbols("") == [] and cpp.symbols("}}} ((( {{{") == []
    kinds = {(k, s) for k, s, *_ in cpp.symbol_chunks(CPP)}
    assert ("properties", "ADoor") in kinds and ("type", "ADoor") in kinds and ("method", "ADoor::Open") in kinds


def test_cpp_takes_linear_time():
    for unit in ("int f(int a) { return 1; }\n", "(", "{", "/*", '"', "a"):
        times = []
        for n in (1000, 4000):
            began = time.perf_counter()
            cpp.symbols(unit * n)
            times.append(time.perf_counter() - began)
        assert times[1] < 10 * max(times[0], 0.02), unit


def test_index_maintenance(spark):
    old = spark.createDataFrame([("a", "1", "p"), ("b", "2", "p"), ("c", None, "q")], "id string, sha string, file_path string")
    new = spark.createDataFrame([("a", "1", "p"), ("b", "3", "r"), ("d", None, None), ("c", None, "z")], "id string, sha string, file_path string")
    merged, actions = index.upsert(old, new, "id", "sha")
    assert {tuple(r) for r in merged.collect()} == {("a", "1", "p"), ("b", "3", "r"), ("c", None, "q"), ("d", None, None)}
    assert {tuple(r) for r in actions.collect()} == {("a", "skipped"), ("b", "updated"), ("c", "skipped"), ("d", "added")}
    kept, gone = index.replace_by_path(old, new.limit(0), spark.createDataFrame([("p",), ("p",)], "file_path string"))
    assert [r.id for r in kept.collect()] == ["c"] and sorted(r.id for r in gone.collect()) == ["a", "b"]
    assert [r.id for r in index.delete(old, filters={"file_path": "p"}).collect()] == ["c"]
    assert index.delete(new, filters={"file_path": "p"}).count() == 3  # a null equals nothing
    assert index.delete(old, ids=old.where("id = 'a'")).count() == 2
    for bad in ({}, {"ids": old, "filters": {"id": "a"}}):
        with pytest.raises(ValueError):
            index.delete(old, **bad)
    assert index.misses(new.union(new), old, "sha").count() == 2 and index.unique_ids(new.union(old.where("id = 'a'")), "id").count() == 1
