import base64
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engine.llm.encoding import VOCABULARY, Encoder, decode_ids, encode_texts, p8_ids

own = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(Path(VOCABULARY).with_suffix(".tiktoken"), "rb"))}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return Encoder(Path(VOCABULARY).read_text(encoding="utf-8")), own.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_merge_order(both):
    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(), st.text("ab "), st.text("<|endoftext>' \n\t\r"), st.text("aeinrst '").map(lambda x: x * 3), st.text("的在了是日本é€😀")))
    def check(text):
        ids = both[0].encode(text)
        assert ids == both[1].encode_ordinary(text)
        assert both[0].decode(ids) == text

    check()


def test_long_pieces_are_whole(both):
    for text in ("ab" * 20_000, "=" * 30_000, "的" * 5000, "x1" * 9000, "a" * 7616):
        assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_all_documents_and_null_and_empty(spark, tmp_path, both):
    folder = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    ids = dict(p8_ids(spark, folder).collect())
    assert ids.keys() == texts.keys()
    assert all(ids[i] == (both[1].encode_ordinary(x) if x else []) for i, x in texts.items())
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "<|endoftext|>", "z"), (3, "a", None)], "doc_id long, text string, ids string")
    out = encode_texts(rows, "doc_id", "text")
    assert sorted(map(tuple, out.collect())) == [(1, []), (2, []), (3, both[1].encode_ordinary("<|endoftext|>")), (3, [64])]
    assert {r.text for r in decode_ids(out, "doc_id").collect()} == {"", "<|endoftext|>", "a"}
    assert encode_texts(rows.where("false"), "doc_id", "text").count() == 0
