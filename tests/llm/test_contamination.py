import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from engine.llm.contamination import MATCH, MISMATCH, GAP, align, p9_alignments, p9_found, words

QUERY = "one two three four five six seven eight nine ten eleven twelve thirteen"


def test_disguised_passages(spark, tmp_path):
    spark.createDataFrame([(1, QUERY, None), (2, "other", f"Prefix words; {QUERY}!"), (3, "too short", "one two")], "item_id long, query_text string, reference_text string").write.parquet(f"{tmp_path}/benchmark_cases.parquet")
    docs = [
        (10, "> ONE, two\r\n> three **four** _five_ <em>six</em> se​ven\n// eight ｎｉｎｅ `ten`\n1. eleven twelve"),
        (11, "one two three four five six seven eight nine ten eleven"),
        (12, "one two three four five six sevenish eight nine ten eleven twelve thirteen"),
        (13, None), (14, ""),
    ]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in p9_found(spark, str(tmp_path)).collect()} == {(1, 10), (2, 10)}
    scores = {(r.item_id, r.doc_id): (r.score, r.run) for r in p9_alignments(spark, str(tmp_path)).collect()}
    # one word of 13 differs: 12 matches and a mismatch
    assert scores[1, 12] == (12 * MATCH + MISMATCH, 6)


def test_each_long_run_is_found_even_where_all_grams_are_common(spark, tmp_path):
    common = " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(1, common, None), (2, common, common), (2, common, common)], "item_id long, query_text string, reference_text string").write.parquet(f"{tmp_path}/benchmark_cases.parquet")
    w = common.split()
    docs = [(i, "x " * (i % 3) + " ".join(w[i : i + 12]) + " tail") for i in range(28)] + [(100 + i, " ".join(w[i : i + 11])) for i in range(29)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in p9_found(spark, str(tmp_path)).collect()} == {(item, i) for item in (1, 2) for i in range(28)}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, query_text string, reference_text string, doc_id long").write.parquet(f"{tmp_path}/benchmark_cases.parquet")
    spark.createDataFrame([(1, "a b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert p9_found(spark, str(tmp_path)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=12))
def test_alignment_is_smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    run = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            same = x == y != 0
            h[i][j] = max(0, h[i - 1][j - 1] + (MATCH if same else MISMATCH), h[i - 1][j] + GAP, h[i][j - 1] + GAP)
            run[i][j] = run[i - 1][j - 1] + 1 if same else 0
    pairs = [(np.array(x, np.int32), np.array(y, np.int32)) for x, y in ((a, b), (a[:1], b), ([9] * 20, [9] * 7))]
    assert align(pairs)[0] == (max(map(max, h)), max(map(max, run))) and align(pairs)[2] == (14, 7) and align([]) == []


def test_words_of_very_long_and_odd_texts():
    assert len(words("a b " * 100_000)) == 200_000
    assert words("") == [] and words("***") == []
