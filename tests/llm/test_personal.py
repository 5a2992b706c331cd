from itertools import pairwise, product

import numpy as np
import pytest

from engine.llm.personal import like, p10_found, p10_masked
from engine.llm.tagger import Tagger, reconcile

GIVEN, FAMILY = ["Tova", "Tovis", "Miria", "Miris", "Dorva", "Dorvis", "Lunda", "Lundis", "Brena", "Brenis", "Raven"], ["Corvlow", "Corvdale", "Marthlow", "Marthdale", "Jasklow", "Jaskdale", "Selvlow", "Selvdale", "Grintlow", "Grintdale"]
CASES = [
    ("contact=tova.corvlow+x@mail.tidal.test; <miria@x-y.example>", [("email", "tova.corvlow+x@mail.tidal.test"), ("email", "miria@x-y.example")]),
    ("tova [at] mail [dot] tidal [dot] test or miria at mail dot example now", [("email", "tova [at] mail [dot] tidal [dot] test"), ("email", "miria at mail dot example")]),
    ("Write to <user>@<domain> or install forge-tools@2.5.84 @handle", []),
    ("phone=(202) 555 0117; +44 (0)20 7946 0186, 01.99.00.50.92 and +14155550149.", [("phone", x) for x in ("(202) 555 0117", "+44 (0)20 7946 0186", "01.99.00.50.92", "+14155550149")]),
    ("Host 10.64.0.59, changelist 68356476, 5.5.0-11486918, 4711-8270-78, 74aed32c-6f1e-4537-a656-242929739274, 2025.01.13-01.57.26", []),
    ("SSN 987-65-4313, number 987 65 4722, QQ 34 71 38 C, 身份证号：00000019990417427X, ID card 0041-0597-Z953 (scan)", [("id_number", x) for x in ("987-65-4313", "987 65 4722", "QQ 34 71 38 C", "00000019990417427X", "0041-0597-Z953")]),
    ("At 235 Saltmarsh Road\nHarrowgate Cross AA4 9QT. Or 183 rue Quillon, 00640 Saltby.", [("address", "235 Saltmarsh Road\nHarrowgate Cross AA4 9QT"), ("address", "183 rue Quillon, 00640 Saltby")]),
    ("Oldwellstraße 218a, 00502 Little Quarley; 青禾市临江区柳安路217号。 The Quillon Street level.", [("address", "Oldwellstraße 218a, 00502 Little Quarley"), ("address", "青禾市临江区柳安路217号")]),
    ("By Dr. Tova Corvlow, GRINTDALE, Miris and Dorva A. Selvlow-Jaskdale; L. Marthlow.", [("name", x) for x in ("Tova Corvlow", "GRINTDALE, Miris", "Dorva A. Selvlow-Jaskdale", "L. Marthlow")]),
    ("Tova is the code name. Ms. Miria met Raven Graph.", []),
]


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("p10")
    spark.createDataFrame([(w, "given") for w in GIVEN] + [(w, "family") for w in FAMILY], "name_word string, name_role string").write.parquet(f"{d}/name_lexicon.parquet")
    spark.createDataFrame([*((i, text + "\n" + text) for i, (text, _) in enumerate(CASES)), (99, None), (98, "")], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return [tuple(r) for r in p10_found(spark, str(d)).collect()]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_distinct_strings_as_they_stand(found, i):
    assert sorted((kind, x) for doc, kind, x in found if doc == i) == sorted(CASES[i][1])


def test_names_that_the_lexicon_lacks():
    given = like({stem + end for stem in ("tov", "mir", "dorv", "lund", "bren", "saal") for end in ("a", "is", "eth")} - {"tovis"})
    assert given("tovis") and not given("tower")


def test_masked_text_and_windows(spark, tmp_path):
    text = "Mail tova.corvlow@mail.tidal.test now. " + "Nothing to see in this long line of words. " * 400 + "Call +44 (0)20 7946 0186 or write to miria@x-y.example."
    spark.createDataFrame([(w, "given") for w in GIVEN] + [(w, "family") for w in FAMILY], "name_word string, name_role string").write.parquet(f"{tmp_path}/name_lexicon.parquet")
    spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, kind string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r.masked for r in p10_masked(spark, str(tmp_path)).collect()}
    assert out[2] is None and out[3] == ""
    assert out[1] == text.replace("tova.corvlow@mail.tidal.test", "[EMAIL]").replace("+44 (0)20 7946 0186", "[PHONE]").replace("miria@x-y.example", "[EMAIL]")


def test_windows_are_reconciled():
    assert reconcile([(5, 9, 1), (7, 12, 1), (12, 15, 1), (14, 16, 2), (20, 22, 3)]) == [(5, 15, "email"), (20, 22, "id_number")]
    assert reconcile([]) == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    own = Tagger.load()
    e = rng.normal(size=(5, 3, 6)).astype(np.float32) * 3
    best = own.viterbi(e.copy(), 0.0)
    for j in range(3):
        score = lambda path: sum(e[t, j, k] for t, k in enumerate(path)) + sum(own.a[a, b] for a, b in pairwise(path))  # noqa: B023, E731
        assert tuple(best[:, j]) == max(product(range(6), repeat=5), key=score)
