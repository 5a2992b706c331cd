"""p7: files that weren't written by hand by the engine's team.

Rules on path, plugin, notice and layout name generated and minified files, blobs, and vendored files that say so. Copies that don't are found by
hashes over the directory trees, bottom-up: a leaf is the layout of its code, without leading comment, identifiers, numbers and white space, and a
directory is the multiset of its children's names and hashes, added up so that large directories are summed where they lie. A subtree that stands
in unrelated repositories (module or plugin roots), and in one of them as another project's code by the rules, is vendored wherever it stands. Leaves
that are minified, generated, blobs, build files or shorter than EVIDENCE say nothing, nor do directories that hold such leaves.

Files without a head, or whose bytes aren't UTF-8, are judged by path, plugin and what can be read; rows without a path are none; doubled rows
change nothing; a file of several heads has the reasons of all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engine.functions.partitions import spread, written

#: Characters of layout from which a leaf is evidence.
EVIDENCE = 60

GENERATED_PATH = re.compile(r"\.(?:generated|gen|g|pb|designer)\.\w+(?:\.\w+)?$|/(?:Inc/(?:[^/]+/)*Gen|Intermediate|autogen|(?:auto)?generated|codegen|gen)/", re.IGNORECASE)
VENDORED_PATH = re.compile(r"(?:^|/)(?:third[_-]?party|3rd[_-]?party|vendor(?:ed)?|extern(?:als?)?|deps|node_modules)/", re.IGNORECASE)
VENDORED_PLUGIN = re.compile(r"(?:Vendored|External|ThirdParty|Upstream)\d*$")
MINIFIED_PATH = re.compile(r"\.min\.\w+$", re.IGNORECASE)
#: Notices stand in comments at the head of a file.
NOTICE = re.compile(r"(?:\s|#pragma once\b|//[^\n]*|/\*.*?(?:\*/|\Z))*", re.DOTALL)
OURS = re.compile(r"written by hand|hand[- ]written|not (?:auto(?:matically)?[- ]?)?generated", re.IGNORECASE)
GENERATED = re.compile(
    r"<auto-?generated|@generated|auto(?:matically)?[- ]generated\b|\b(?:file|code|header|source|module) (?:was|is|has been) (?:\w+ )?(?:generated|created|produced|written) by (?:the )?\w+|^\W*generated (?:by|from|with|using)\b"
    r"|\b(?:exported|emitted|produced|written|made|created|built|output) (?:\w+: )?(?:\w+ )?by (?:the |a )?[\w ]*?(?:tool|generator|compiler|codegen|gramforge|schemaloom)\b|\bregenerate instead\b|\bpacked by \w+, do not edit\b|\ba (?:parser|lexer|scanner|grammar) made by\b|^\W*source: \S+\.(?:schema|proto|idl|fbs)\b",
    re.IGNORECASE | re.MULTILINE,
)
LINE_MARK = re.compile(r'^[ \t]*#line \d+ "[^"\n]*\.(?!(?:cpp|c|h|hpp|inl|cc|cs)")\w+"', re.MULTILINE)
VENDORED = re.compile(r"\b(?:is )?part of the \w[\w.-]* (?:library|project|package)|\bcopyright (?:\(c\) )?(?:[\d, -]+ )?the [\w.-]+ (?:authors|contributors|developers|project)|\bimported from upstream \w|- v?\d+\.\d+(?:\.\d+)? - public domain|public domain - no warranty|^\W*\w+ \d+\.\d+(?:\.\d+)?, copyright\b", re.IGNORECASE | re.MULTILINE)
FOREIGN = re.compile(r"^\s*(?:static |extern )?\w+ \**([a-z]\w*?)_\w+\(struct \1_\w+ \*", re.MULTILINE)
LITERAL = re.compile(r'"(?:\\.|[^"\\\n])*"?')
COMMENT = re.compile(r'("(?:\\.|[^"\\\n])*"?)|//[^\n]*|/\*.*?(?:\*/|\Z)', re.DOTALL)
NUMBERS = re.compile(r"=\s*\{\s*((?:[-+]?(?:0x[0-9a-f]+|\d+\.?\d*(?:e[-+]?\d+)?)[uflUL]*\s*(?:,\s*|(?=\})|\Z)){24,})", re.IGNORECASE)
STRINGS = re.compile(r'=\s*\(?((?:\s*"[0-9A-Za-z+/=]{40,}"?){3,}|\s*"(?:\\x[0-9a-f]{2}|[0-9A-Za-z+/=]){400,})', re.IGNORECASE)


def minified(code: str) -> bool:
    """code: without comments, and each literal as two quotes."""
    lines = [x for x in code.split("\n") if x.strip() and not x.lstrip().startswith("#")]
    longest = max(lines, key=len, default="")
    return len(longest) >= 250 and len(re.findall(r"[;{}]", longest)) >= 10 and len(re.findall(r"[;{},=(+*?:]\s|\s[{}=+*?:(]", longest)) < 0.02 * len(longest)


def reasons(path: str, plugin: str | None, head: bytes | None) -> list[str]:
    path = path.replace("\\", "/")
    text = (head or b"").decode("utf-8", "replace").lstrip("﻿").replace("\r\n", "\n")
    notice = NOTICE.match(text)[0]
    notice = "\n".join(x for x in notice.split("\n") if not OURS.search(x))
    code = COMMENT.sub(lambda m: m[1] or " ", text)
    blob = bool(NUMBERS.search(code) or STRINGS.search(code))
    found = []
    if GENERATED_PATH.search(path) or GENERATED.search(notice) or LINE_MARK.search(text):
        found.append("generated")
    if MINIFIED_PATH.search(path) or not blob and minified(LITERAL.sub('""', code)):
        found.append("minified")
    folders = path.split("/")[:-1]
    if VENDORED_PATH.search(path) or VENDORED_PLUGIN.search(plugin or "") or folders[:1] == ["Plugins"] and any(map(VENDORED_PLUGIN.search, folders[1:3])) or VENDORED.search(notice) or FOREIGN.search(text):
        found.append("vendored")
    if blob:
        found.append("blob")
    return found


def layout(head: bytes | None) -> str:
    """The code with each identifier as x, each number as 0, and no leading comment and white space."""
    text = (head or b"").decode("utf-8", "replace").lstrip("\ufeff").replace("\r\n", "\n")
    code = text[NOTICE.match(text).end() :]
    return re.sub(r"\s+", "", re.sub(r"\d+", "0", re.sub(r"[A-Za-z_]\w*", "x", code)))


def leaf_hash(path: str, head: bytes | None, why: list[str]) -> int | None:
    """None for a leaf that is no evidence."""
    shape = layout(head)
    if len(shape) < EVIDENCE or "minified" in why or "blob" in why or ("generated" in why and "vendored" not in why) or re.search(r"\.(?:build|target)\.cs$", path, re.IGNORECASE):
        return None
    return xxhash.xxh64_intdigest(shape) - 2**63


def repository(path: Column) -> Column:
    """The module or plugin root that a path lies in, without counters."""
    return F.regexp_replace(F.array_join(F.slice(F.split(path, "/"), 1, 3), "/"), r"\d+(?=/|$)", "")


def trees(leaves: DataFrame) -> DataFrame:
    """path, digest, seed and repo of each leaf and directory. leaves: path, digest, seed (another project's by the rules), repo.

    A directory's counters in names and the order of its children don't count. One sum a level; deep trees take as many levels as they have.
    """
    depth = leaves.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    nodes = leaves.select("path", "digest", "seed", "repo")
    levels = [nodes]
    below = None
    for level in range(depth, 1, -1):
        here = nodes.where(F.size(F.split("path", "/")) == level)
        children = here if below is None else here.unionByName(below)
        name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\d+", "")
        # the halves of a hash are added apart, so that sums of any number of children stay within a long
        digest = F.xxhash64(name, "digest")
        below = (
            children.withColumn("h", digest)
            .groupBy(F.array_join(F.slice(F.split("path", "/"), 1, level - 1), "/").alias("path"))
            .agg(
                F.sum(F.shiftrightunsigned("h", 32)).alias("high"), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("low"),
                F.count("*").alias("n"), F.count("digest").alias("whole"), F.max("seed").alias("seed"), F.min("repo").alias("repo"),
            )
            .select("path", F.when(F.col("n") == F.col("whole"), F.xxhash64("high", "low", "n")).alias("digest"), "seed", "repo")
        )
        levels.append(below)
    return reduce(DataFrame.unionByName, levels)


def not_by_hand(files: DataFrame) -> DataFrame:
    """relative_path, reason of files: relative_path, plugin, source_head."""
    rows = spread(files.select("relative_path", "plugin", "source_head").where("relative_path is not null"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                why = reasons(*row)
                found.append((row[0], row[0].replace("\\", "/"), why, leaf_hash(row[0], row[2], why), "vendored" in why))
            yield pd.DataFrame(found, columns=["relative_path", "path", "reasons", "digest", "seed"]).astype({"digest": "Int64"})

    judged = written(rows.mapInPandas(judge, "relative_path string, path string, reasons array<string>, digest long, seed boolean"))
    leaves = written(judged.groupBy("path").agg(F.max("digest").alias("digest"), F.max("seed").alias("seed")).withColumn("repo", repository(F.col("path"))))
    nodes = written(trees(leaves).where("digest is not null"))
    shared = nodes.groupBy("digest").agg(F.max("seed").alias("seed"), F.min("repo").alias("one"), F.max("repo").alias("other")).where("seed and one <> other").select("digest")
    copies = nodes.join(shared, "digest").select("path")
    # a file lies in a shared subtree if it or one of its folders is one
    parts = F.split("path", "/")
    above = judged.select("relative_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path"))
    copied = above.join(copies, "path").select("relative_path", F.lit("vendored").alias("reason"))
    return judged.select("relative_path", F.explode("reasons").alias("reason")).unionByName(copied).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_by_hand(spark.read.parquet(f"{sf_dir}/engine_inventory.parquet"))
