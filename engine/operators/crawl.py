"""A bounded crawl by any page source: robots rules, retries, links, depth and page limits; each step is a join against the pages seen."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from fnmatch import translate
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engine.operators.chunking import each_text
from engine.operators.pages import frontier, parse

#: Answers after which a page is asked for again, and the longest wait between.
RETRYABLE, LONGEST_WAIT = {408, 425, 429, 500, 502, 503, 504}, 60.0


def robots_rules(text: str, agent: str) -> list[tuple[bool, str]]:
    """(allowed, path) of the agent's group, or of that for all."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    names: list[str] = []
    open_names = False
    for line in text.splitlines():
        field, _, value = line.split("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            names = [*names, value.lower()] if open_names else [value.lower()]
            open_names = True
        elif field in ("allow", "disallow"):
            open_names = False
            for n in names:
                groups.setdefault(n, [])
                if value:
                    groups[n].append((field == "allow", value))
    own = next((n for n in groups if n != "*" and n in agent.lower()), "*")
    return groups.get(own, [])


def allowed(rules: list[tuple[bool, str]], url: str) -> bool:
    """By the longest rule that fits; of equal ones, the one that allows."""
    path = urlsplit(url).path or "/"
    fits = [(len(p), ok) for ok, p in rules if re.match(translate(p.rstrip("$") + ("" if p.endswith("$") else "*")), path)]
    return max(fits)[1] if fits else True


def fetch(get: Callable[[str], tuple[int, dict[str, str], str]], url: str, tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The body of a page; get gives status, headers and body. Waits grow twofold, or are what Retry-After asks for, at most LONGEST_WAIT."""
    for n in range(tries):
        status, headers, body = get(url)
        if status < 400:
            return body
        if status not in RETRYABLE or n == tries - 1:
            raise OSError(f"{url}: status {status}")
        asked = headers.get("Retry-After", "")
        sleep(min(LONGEST_WAIT, float(asked) if asked.isdigit() else wait * 2**n))
    raise OSError(url)


def links_of(html: str, base: str) -> list[str]:
    """Targets of all anchors, without those that lead to no page."""
    hrefs = [a.attributes.get("href", "") for a in parse(html).all("a")]
    return [urljoin(base, h.split("#")[0]) for h in hrefs if h and not h.startswith(("#", "mailto:", "javascript:", "tel:"))]


def crawl(seeds: DataFrame, pages: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], depth: int, most: int | None = None) -> DataFrame:
    """url, topic, depth of the pages reached from seeds (url, topic) in at most `depth` steps.

    pages gives content for url, topic, depth; keep drops links that aren't allowed. Depth ends the reading of links, not of pages. With `most`,
    the first pages by depth and url count.
    """
    step = seeds.groupBy("url").agg(F.min("topic").alias("topic")).withColumn("depth", F.lit(0))
    seen = step
    for n in range(depth):
        html = pages(step).where("content is not null").withColumn("_base", F.concat_ws("\u0000", "topic", "url"))

        found = each_text(html.select("_base", F.concat_ws("\u0000", "url", "content").alias("content")), "_base", "content", lambda x: [(u,) for u in links_of(*reversed(x.split("\u0000", 1)))], "url string")
        links = found.select("url", F.split("_base", "\u0000")[0].alias("topic"))
        step = frontier(keep(links), seen, n)
        seen = seen.unionByName(step)
    return seen.orderBy("depth", "url").limit(most) if most else seen


def page_path(url: str) -> str:
    import hashlib

    h = hashlib.sha256(url.encode()).hexdigest()
    return f"{h[:2]}/{h}.html"


def page_table(spark: SparkSession, rows: list[tuple[str, str]]) -> Callable[[DataFrame], DataFrame]:
    """A page source out of url and content."""
    table = spark.createDataFrame(rows, "url string, content string")
    return lambda step: step.join(table, "url", "left")
