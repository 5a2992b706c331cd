"""p9: documents that hold passages of held-out items.

Every window of WORDS words of an item gives its rarest gram of GRAM words, by the count of documents over the whole corpus, as a seed. So each
passage of WORDS equal words holds a seed, and grams that stand in many documents are used only where a window has no rarer one. Documents that
hold a seed are aligned with the item around it (Smith-Waterman over words), which also scores edited copies.

Items with null texts or texts shorter than WORDS words have no seeds; null and empty documents hold nothing; doubled rows change nothing; a
passage that items share counts for each of them. Items come in blocks of ITEMS, so that what goes to the workers is bounded.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engine.functions.partitions import spread

WORDS, GRAM, ITEMS = 12, 5, 20_000
MATCH, MISMATCH, GAP, SLACK, PAIRS = 2, -1, -1, 8, 256
#: Alignments below this score aren't reported.
LEAST_SCORE = 16
TAG = re.compile(r"</?[a-z][^<>]{0,200}>")
NUMBERED = re.compile(r"^\s*\d+[.)]\s+", re.MULTILINE)
#: Characters that show nothing and are no format characters (Cf).
INVISIBLE = re.compile("[͏︀-️ᅟᅠ឴឵ㅤ]")


def words(text: str) -> list[str]:
    """Lower-case words without punctuation, white space, tags, emphasis marks, invisible characters and compatibility forms."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", "".join(c for c in text if unicodedata.category(c) != "Cf")))
    text = TAG.sub("", html.unescape(text.casefold()))
    return re.findall(r"[^\W_]+", re.sub(r"[*_~`]", "", text))


def readings(text: str | None) -> list[list[str]]:
    """The words of a text; a number at the head of a line is either its prefix or one of the words, so there may be two readings."""
    if not text:
        return []
    return [words(text), words(NUMBERED.sub("", text))] if NUMBERED.search(text) else [words(text)]


def grams(ids: np.ndarray) -> np.ndarray:
    """A key for each run of GRAM words; 0 where a word is in no item."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(GRAM):
        part = ids[k : k + n]
        whole &= part > 0
        key = key * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)
        key ^= key >> np.uint64(29)
    return np.where(whole, (key | np.uint64(1)).astype(np.int64), 0)


@dataclass
class Items:
    """The items' readings, as ids of their own words."""

    vocabulary: dict[str, int]
    owners: list[int]
    texts: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[int, list[str]]]) -> Items:
        vocabulary: dict[str, int] = {}
        texts = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in x], np.int32) for _, x in rows]
        return cls(vocabulary, [i for i, _ in rows], texts)

    def ids(self, text: str) -> list[np.ndarray]:
        get = self.vocabulary.get
        return [np.fromiter((get(w, 0) for w in x), np.int32, len(x)) for x in readings(text)]

    def seeds(self, documents: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
        """The places (text, word) of each seed; documents: for each gram, how many documents hold it."""
        out: dict[int, list[tuple[int, int]]] = {}
        for n, ids in enumerate(self.texts):
            keys = grams(ids).tolist()
            span = WORDS - GRAM + 1
            rare = {min(range(i, i + span), key=lambda j: (documents.get(keys[j], 0), keys[j])) for i in range(len(keys) - span + 1)}
            # a gram with the seed's key is a seed wherever it stands in the text
            chosen = {keys[j] for j in rare}
            for j, key in enumerate(keys):
                if key in chosen:
                    out.setdefault(key, []).append((n, j))
        return out


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Of each pair the best local alignment's score, and the longest run of equal words; words with id 0 equal none. PAIRS of like sizes are aligned together."""
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    for at in range(0, len(order), PAIRS):
        part = order[at : at + PAIRS]
        rows, width = max(len(pairs[i][0]) for i in part), max(len(pairs[i][1]) for i in part)
        a, b = np.full((len(part), rows), -1, np.int32), np.zeros((len(part), width), np.int32)
        for k, i in enumerate(part):
            a[k, : len(pairs[i][0])], b[k, : len(pairs[i][1])] = pairs[i]
        a[a == 0] = -1
        column = (np.arange(width + 1) * GAP).astype(np.int32)
        score, run = np.zeros((len(part), width + 1), np.int32), np.zeros((len(part), width + 1), np.int32)
        best, longest = np.zeros(len(part), np.int32), np.zeros(len(part), np.int32)
        for j in range(rows):
            same = b == a[:, j, None]
            new = np.zeros_like(score)
            np.maximum(score[:, :-1] + np.where(same, MATCH, MISMATCH).astype(np.int32), score[:, 1:] + GAP, out=new[:, 1:])
            np.maximum(new, 0, out=new)
            score = np.maximum.accumulate(new - column, axis=1) + column  # gaps along b
            run[:, 1:] = (run[:, :-1] + 1) * same
            np.maximum(best, score.max(axis=1), out=best)
            np.maximum(longest, run.max(axis=1), out=longest)
        for k, i in enumerate(part):
            out[i] = int(best[k]), int(longest[k])
    return out


def regions(items: Items, keys: np.ndarray, places: list[list[tuple[int, int]]], text: str) -> list[tuple[int, np.ndarray]]:
    """The items' texts that have a seed in the text, each with the words around where it can stand."""
    found: list[tuple[int, np.ndarray]] = []
    for ids in items.ids(text):
        own = grams(ids)
        at = np.flatnonzero(own)
        if not len(at):
            continue
        spot = np.searchsorted(keys, own[at]).clip(max=len(keys) - 1)
        hits = keys[spot] == own[at]
        spans: dict[int, list[list[int]]] = {}
        for p, k in zip(at[hits].tolist(), spot[hits].tolist(), strict=True):
            for n, q in places[k]:
                size = len(items.texts[n])
                lo, hi = max(0, p - q - SLACK), p + size - q + SLACK
                before = spans.setdefault(n, [])
                if before and lo <= before[-1][1]:
                    before[-1][1] = max(hi, before[-1][1])
                else:
                    before.append([lo, hi])
        found += [(n, ids[lo:hi]) for n, own_spans in spans.items() for lo, hi in own_spans]
    return found


def leaked(documents: DataFrame, cases: DataFrame) -> DataFrame:
    """item_id, doc_id, score and run of each document and item that share a seed.

    documents: doc_id, text; cases: item_id, query_text, reference_text, the held-out table, which the driver reads.
    """
    rows = [(i, x) for i, *texts in cases.select("item_id", "query_text", "reference_text").toLocalIterator() for text in texts for x in readings(text) if len(x) >= WORDS]
    rows = list({(i, tuple(x)): (i, x) for i, x in rows}.values())
    blocks = [Items.of(rows[i : i + ITEMS]) for i in range(0, max(1, len(rows)), ITEMS)]
    return reduce(DataFrame.unionByName, (block_leaks(documents, block) for block in blocks))


def block_leaks(documents: DataFrame, items: Items) -> DataFrame:
    context = documents.sparkSession.sparkContext
    known = context.broadcast((items, np.unique(np.concatenate([np.zeros(0, np.int64), *map(grams, items.texts)]))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, every = known.value
        for batch in batches:
            held = []
            for text in batch["text"]:
                own = np.unique(np.concatenate([np.zeros(0, np.int64), *map(grams, items.ids(text))]))
                held.append(own[every[np.searchsorted(every, own).clip(max=len(every) - 1)] == own] if len(every) else own[:0])
            keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            yield pd.DataFrame({"gram": keys, "n": n})

    texts = spread(documents.select("doc_id", "text").where("length(text) > 0"))
    counts = texts.select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    seeds = items.seeds({gram: n for gram, n in counts.toLocalIterator()})
    keys = np.array(sorted(seeds), np.int64)
    shared = context.broadcast((items, keys, [seeds[k] for k in keys.tolist()]))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, keys, places = shared.value
        for batch in batches:
            tasks = [(doc, *x) for doc, text in zip(batch["doc_id"], batch["text"], strict=True) if len(keys) for x in regions(items, keys, places, text)]
            scores = align([(items.texts[n], words) for _, n, words in tasks])
            found = pd.DataFrame([(items.owners[n], doc, *x) for (doc, n, _), x in zip(tasks, scores, strict=True)], columns=["item_id", "doc_id", "score", "run"])
            yield found.groupby(["item_id", "doc_id"], as_index=False).max()

    return texts.mapInPandas(judge, "item_id long, doc_id long, score int, run int")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return leaked(read("documents"), read("benchmark_cases"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).where(F.col("run") >= WORDS).select("item_id", "doc_id").distinct()


def p9_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited copies too: the score of the best alignment of each item and document that share a seed, if it reaches LEAST_SCORE."""
    return alignments(spark, sf_dir).where(F.col("score") >= LEAST_SCORE).groupBy("item_id", "doc_id").agg(F.max("score").alias("score"), F.max("run").alias("run"))
