import pytest

from pyspark.sql import functions as F

from engine.llm.provenance import not_by_hand, p7_found, reasons, trees

OURS = b"// Copyright Foundry. All rights reserved.\n\n#include \"A.h\"\n\nvoid FA::Run()\n{\n\tB->Do(1);\n}\n"
FILES = [
    ("Source/A/Private/A.cpp", None, OURS, []),
    ("Source/A/Private/A.gen.cpp", None, None, ["generated"]),
    ("Source\\A\\Inc\\Gen\\A.h", None, OURS, ["generated"]),
    ("Source/A/A.h", None, b"\xef\xbb\xbf// This file was generated by Loom. DO NOT EDIT.\n" + OURS, ["generated"]),
    ("Source/A/A.h", None, b'#line 1 "A.gf"\nstatic void _rule_0(Ctx* c) { }\n', ["generated"]),
    ("Source/A/GeneratedGeometry/CodeGeneratorA.h", None, b"// The lists are filled by code generated at cook time; this file itself is written by hand.\n" + OURS, []),
    ("Source/A/A.h", None, OURS + b"// Do not edit these limits.\nstatic const int32 Limits[] = { 0x10, 0x20, 0x40, 0x80 };\n", []),
    ("Source/A/A.h", None, b"struct a0{int b;float c(int d){return d*b+0.f;}};" * 20, ["minified"]),
    ("Source/A/A.h", None, b'static const TCHAR* Banner = TEXT("' + b"Words; more, of them. " * 20 + b'");\n' + OURS, []),
    ("Source/ThirdParty/lib-1.2/src/a.h", None, OURS, ["vendored"]),
    ("Source/A/Private/ThirdPartyBridge/A.h", None, b"// Thin wrapper around lib; the library lives elsewhere.\n" + OURS, []),
    ("Plugins/Bundled/LibUpstream00/Source/a.h", "LibUpstream00", b"/* Generated by autoprobe for lib. Do not modify */\n", ["generated", "vendored"]),
    ("Source/A/A.h", None, b"/*\n * This file is part of the lib library, release 4.1.\n */\n", ["vendored"]),
    ("Source/A/A.h", None, b"static const unsigned char D[] = {\n" + b"0x63, 0xad, 0xf7,\n" * 40, ["blob"]),
    ("Source/A/A.h", None, b"const char* D =\n" + b'"b42c23d746049450395909717acd735ff09c77ade268"\n' * 9 + b'"b4', ["blob"]),
]


@pytest.mark.parametrize("path, plugin, head, expected", FILES)
def test_reasons(path, plugin, head, expected):
    assert reasons(path, plugin, head) == expected


def test_doubled_rows_count_once(spark, tmp_path):
    rows = [("Source/deps/a.gen.cpp", None, None), ("Source/deps/a.gen.cpp", None, bytearray(OURS)), ("Source/A/A.h", "A", bytearray(OURS))]
    spark.createDataFrame(rows, "relative_path string, plugin string, source_head binary").write.parquet(f"{tmp_path}/engine_inventory.parquet")
    assert sorted(map(tuple, p7_found(spark, str(tmp_path)).collect())) == [("Source/deps/a.gen.cpp", r) for r in ("generated", "vendored")]


def test_copies_in_unrelated_roots_are_vendored(spark, tmp_path):
    body = "".join(f"int quill_{w}(struct quill_ctx *c, int n)\n{{ c->n += {i}; return n; }}\n" for i, w in enumerate(("open", "read", "shut", "seek")))
    other = body.replace("quill", "reed").replace("struct reed_ctx", "Reed")
    rows = [
        ("Source/ThirdParty/quill-1.2/src/a_1.c", None, ("/* mine */\n" + other).encode()),
        ("Source/Runtime/Alpha00/Private/Copy_77.cpp", None, other.encode()),
        ("Source/Runtime/Alpha00/Private/Own.cpp", None, b"int Own() { return 1; }"),
        ("Source/Runtime/Beta00/Private/Alone.cpp", None, other.replace("return n", "return n * n").encode()),
        ("Source/Runtime/Gamma00/Private/Bad.cpp", None, b"\xff\xfe\x00"),
        ("Source\\Runtime\\Delta00\\Private\\Copy.cpp", None, other.encode()),
        (None, None, other.encode()),
        ("x", None, None),
    ]
    schema = "relative_path string, plugin string, source_head binary"
    found = {tuple(r) for r in not_by_hand(spark.createDataFrame(rows + rows, schema).withColumn("path", F.lit("clash"))).collect()}
    assert found == {(rows[i][0], "vendored") for i in (0, 1, 5)}
    assert not_by_hand(spark.createDataFrame([], schema)).count() == 0


def test_directories_share_hashes_whatever_their_order_and_counters(spark):
    leaves = [("A/x/l_1/p.h", 1), ("A/x/l_1/q.h", 2), ("B/y/l_2/q.h", 2), ("B/y/l_2/p.h", 1), ("C/z/l_3/p.h", 1), ("D/w/l/p.h", 1), ("D/w/l/r.h", None)]
    frame = spark.createDataFrame([(p, d, False, p[:1]) for p, d in leaves], "path string, digest long, seed boolean, repo string")
    digest = {r.path: r.digest for r in trees(frame).collect()}
    assert digest["A/x/l_1"] == digest["B/y/l_2"] != digest["C/z/l_3"]
    assert digest["D/w/l"] is None and digest["D"] is None
