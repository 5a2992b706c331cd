"""Runs of words that repeat over the pages of a host.

The pages of a host are dealt into shards of about SHARD pages. The words of a shard's pages are put one after the other and sorted as a suffix
array; neighbours that share RUN words or more are one class, with the pages it stands in. The counts of the classes are added over the shards of
a host, so that no run is missed because its pages lie apart. A word is covered if a run of RUN words around it stands in PAGES pages or more; covered
words go, the others stay with the line breaks and blanks before them. Equal texts, as of mirrors, count as one page.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engine.functions.partitions import written

RUN, PAGES, SHARD = 10, 3, 2000
WORD = re.compile(r"\S+")


def suffix_array(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of words sorted by the `depth` words from there (of equal ones, by place), and each place's class among them; by doubling."""
    _, rank = np.unique(words, return_inverse=True)
    n, have = len(words), 1
    while have < depth:
        step = min(have, depth - have)
        later = np.full(n, -1, np.int64)
        later[: n - step] = rank[step:]
        _, rank = np.unique(rank.astype(np.int64) * (n + 1) + later + 1, return_inverse=True)
        have += step
    return np.argsort(rank, kind="stable"), rank


def streams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, each text ending with a word of its own, and the text of each word."""
    hashes, owner = [], []
    for k, text in enumerate(texts):
        own = [xxhash.xxh64_intdigest(w) >> 2 for w in WORD.findall(text)]
        hashes += [*own, 2**62 + k]
        owner += [k] * (len(own) + 1)
    return np.array(hashes, np.uint64), np.array(owner, np.int64)


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each class of runs within one text its hash and its number of texts; of each place its class (-1: none) and its text."""
    words, owner = streams(texts)
    if not len(words):
        return (np.zeros(0, np.int64),) * 4
    order, rank = suffix_array(words, RUN)
    inside = np.zeros(len(words), bool)
    if len(words) >= RUN:
        inside[: len(words) - RUN + 1] = owner[RUN - 1 :] == owner[: len(words) - RUN + 1]
        inside[: len(words) - RUN + 1] &= words[RUN - 1 :] < 2**62
    order = order[inside[order]]
    place = np.full(len(words), -1, np.int64)
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), place, owner
    starts = np.r_[True, rank[order][1:] != rank[order][:-1]]
    cls = np.cumsum(starts) - 1
    place[order] = cls
    new = starts | np.r_[True, owner[order][1:] != owner[order][:-1]]  # places of a class are in the order of texts
    first = order[np.flatnonzero(starts)]
    key = np.zeros(len(first), np.uint64)
    for k in range(RUN):
        key = (key ^ words[first + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64), np.bincount(cls, new), place, owner


def shards(pages: DataFrame) -> DataFrame:
    """The pages with the column shard; hosts of many pages have many."""
    count = pages.groupBy("host").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    return pages.join(count, "host").withColumn("shard", F.pmod(F.xxhash64("content"), F.col("shards")).cast("int")).drop("shards")


def without_repeats(pages: DataFrame) -> DataFrame:
    """pages: id, title, content, host, none null but title."""
    dealt = written(shards(pages.select("id", "title", "content", "host")))

    def count(group: pd.DataFrame) -> pd.DataFrame:
        key, n, _, _ = runs(group["content"].drop_duplicates().tolist())
        return pd.DataFrame({"host": group["host"].iloc[0], "run": key, "n": n.astype(np.int64)})

    common = dealt.groupBy("host", "shard").applyInPandas(count, "host string, run long, n long").groupBy("host", "run").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES)
    there = dealt.select(F.col("host").alias("of_host"), F.col("shard").alias("of_shard")).distinct()
    each = common.join(there, common["host"] == there["of_host"]).select("of_host", "of_shard", "run")

    def keep(key: tuple, group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        texts = group["content"].drop_duplicates().tolist()
        keys, _, place, owner = runs(texts)
        hit = np.isin(keys, known["run"].to_numpy())
        begins = (place >= 0) & np.r_[hit, False][place] if len(place) else np.zeros(0, bool)
        depth = np.cumsum(np.r_[begins.astype(int), np.zeros(RUN, int)] - np.r_[np.zeros(RUN, int), begins.astype(int)])[: len(begins)]
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        clean = {x: uncovered(x, depth[ends[k] : ends[k + 1] - 1] > 0) for k, x in enumerate(texts)}
        return pd.DataFrame({"id": group["id"], "title": group["title"], "content": [clean[x] for x in group["content"]]})

    return dealt.groupBy("host", "shard").cogroup(each.groupBy("of_host", "of_shard")).applyInPandas(keep, "id string, title string, content string")


def uncovered(text: str, covered: np.ndarray) -> str:
    """The words that aren't covered, with the blanks before them; a gap leaves a line break if it held one."""
    out, at, gap = [], 0, ""
    for m, c in zip(WORD.finditer(text), covered.tolist(), strict=True):
        before = text[at : m.start()]
        gap = before if not gap or "\n" in before and "\n" not in gap else gap
        at = m.end()
        if not c:
            out += [gap, m[0]]
            gap = ""
    return "".join(out).strip()
