import time

from engine.llm.described import described, p3_found, p3_pairs, pairs

EARNEST = """/** Walks every entry of the cache and drops the stale ones. */
UFUNCTION(BlueprintPure, meta = (DisplayName = "Item (fast)"))
template <typename T, typename U = TArray<T>>
static FVector FPanel::Walk(FString InName,
\t\tTArray<int> InList) const
{
\tLog(TEXT("/** Not a comment of any function */"));
\t// keep sparse buffers in step
\tHelper(3);
}
"""


def test_earnest_comments():
    assert described(EARNEST) == described(EARNEST.replace("\n", "\r\n")) == {"Walk"}
    assert described("class FOwner\n{\npublic:\n\t// 遍历系统中的全部条目\n\tFOwner();\n\n\t//----\n\t// Frees the memory of all rigs.\n\t//----\n\tvirtual ~FOwner();\n};") == {"FOwner", "~FOwner"}


def test_trivial_comments():
    for comment in ("/** Walk */", "// Walk the\n// list", "//----------", "/** TODO: document this function later on please */", "/**\n * @param InA\n * @param InB\n * @see FOther\n */", "/** @inheritdoc */",
                    "// Copyright Foundry. All rights reserved. Use is subject to the licence.", "/* if (bOn) { Mover.Reset(); return 9; } */", "// Cache->Rebuild(14);\n// Cache->Flush(15, true);", "// 释放", "// Walks every entry of the cache.\n"):
        assert not described(f"{comment}\nvoid Walk(int A);"), comment


def test_all_rows_of_a_chunk(spark, tmp_path):
    rows = [("a", "engine_source", EARNEST, 1), ("a", "engine_source", EARNEST.replace("Walk(", "Run("), 2), ("b", "docs", EARNEST, 1), ("c", "project_source", None, 1)]
    spark.createDataFrame(rows, "id string, source_type string, content string, run_id int").write.parquet(f"{tmp_path}/chunks.parquet")
    assert {tuple(r) for r in p3_found(spark, str(tmp_path)).collect()} == {("a", "Walk"), ("a", "Run")}


def test_pairs_hold_comment_signature_and_body():
    text = 'namespace N {\nclass A {\n  // Counts the open doors of a room.\n  int Doors(const char* s = "}{") { if (x) { return \'}\'; } return 2; }\n  int Next();\n};\n}\n'
    found = pairs(text)
    assert found.keys() == {"Doors"}
    said, code = found["Doors"]
    assert said == "Counts the open doors of a room." and code.startswith("int Doors(") and code.endswith("return 2; }")


def test_text_that_never_closes_takes_linear_time():
    for unit in ("(", "{", '"', "/*", "((a,", "{ (", "R\"x(", "<", "template<", "\\", "#", "'", "class A {", "// Counts the open doors.\nvoid F(", ":", "A("):
        times = []
        for n in (2000, 8000):
            began = time.perf_counter()
            described("// x\n" + unit * n)
            times.append(time.perf_counter() - began)
        assert times[1] < 12 * max(times[0], 0.02), unit


def test_null_empty_and_equal_rows(spark, tmp_path):
    rows = [(None, EARNEST, None, "x"), ("a", None, "engine_source", "x"), ("a", "", "engine_source", "x"), ("b", EARNEST, "engine_source", "x"), ("b", EARNEST, "engine_source", "y")]
    spark.createDataFrame(rows, "id string, content string, source_type string, chunk_id string").write.parquet(f"{tmp_path}/chunks.parquet")
    one = len(described(EARNEST))
    assert p3_found(spark, str(tmp_path)).count() == 2 * one and p3_pairs(spark, str(tmp_path)).count() == 2 * one
