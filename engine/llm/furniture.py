"""p5: lines of dumped pages that belong to the site, not to the body.

A page is a tree: the page, its blocks (lines between blank ones), and their lines; entries under the head of a list hang one below the other from
that head. Each node is furniture or body. Potentials of a line come from its kind, wording and place, those of an edge from what it joins; they
were fitted on labelled pages (train_furniture.py, furniture.json). Sum-product messages go up and down the tree once, which gives each line's exact
marginal; lines from one half on are furniture.

Pages are records with a url; null and empty contents have no lines; blank lines are never named; doubled rows change nothing.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engine.functions.partitions import distinct

#: Entries of menus, alone on a line or several of them with separators.
MENU = set(
    "home|documentation|docs|api reference|api|tutorials|downloads|download|pricing|marketplace|showcase|roadmap|forums|forum|community|support|blog|release notes|log in|login|sign in|sign up|register|search|menu|guides|news|about|about us|contact|careers|jobs|learn|products|solutions|features|store|shop|help|faq|account|my account|profile|partners|events|press|legal|more"
    "|anmelden|anleitungen|startseite|suche|hilfe|dokumentation|herunterladen|registrieren|menü|preise|connexion|téléchargements|accueil|guide|aide|recherche|s'inscrire|tarifs|communauté|登录|首页|文档|下载|注册|搜索|论坛|社区|指南|教程|支持|博客|价格|菜单|帮助|inicio|documentación|descargas|guías|iniciar sesión|foro|ayuda|buscar".split("|")
)
LINES = re.compile(
    "|".join(
        r"""
        (?:home|start|startseite|accueil|首页)\s*(?:[>›»/→]\s*[^>›»/→]+){1,8}
        version\ v?[\d.]+\s*(?:\(latest\)|▾|▼|switch\ version|\(current\)|\(old\))?
        (?:select|choose|switch)\ (?:language|version)\b.{0,60}
        (?:english|deutsch|français|中文|español|日本語)(?:[\s|/·,]+(?:english|deutsch|français|中文|español|日本語))*
        you\ are\ (?:reading|viewing|looking\ at)\ an?\ (?:old|older|outdated|archived)\ version.{0,60}
        (?:this\ site|we|our\ site|our\ website|this\ website)\ (?:stores?|uses?)\ (?:small\ files|cookies)\b.{0,120}
        .{0,40}cookie.{0,4}，.{0,40}
        (?:ce\ site\ utilise\ des\ cookies|wir\ verwenden\ cookies|este\ sitio\ (?:usa|utiliza)\ cookies|utilizamos\ cookies)\b.{0,80}
        (?:accept|allow|reject|decline)\ (?:all|only)(?:\ cookies)?
        (?:accept|accept\ all|reject|reject\ all|settings)(?:\s*[|/·]\s*(?:accept|accept\ all|reject|reject\ all|settings|learn\ more))+
        only\ necessary|cookie\ (?:preferences|settings|policy|notice)|manage\ (?:consent|cookies|preferences)|(?:your\ )?privacy\ (?:choices|policy|notice|settings)
        essential\ (?:storage|cookies)\ (?:is|are)\ always\ on\b.{0,40}
        skip\ to\ (?:main\ )?(?:content|navigation)|toggle\ (?:navigation|menu|sidebar)|search(?:\ (?:docs|documentation|the\ docs|this\ site|forum|\w+))?(?:\.\.\.|…)?
        (?:send|give|leave)\ (?:us\ )?feedback\b.{0,30}|was\ this\ (?:page|article)\ (?:helpful|useful)\b.{0,30}|\d+\ (?:people|users|readers|of\ \d+)\ found\ this\ (?:useful|helpful)
        (?:edit|print|share|bookmark|save|improve)\ this\ (?:page|article)|report\ (?:an?\ )?(?:issue|problem|error)\ (?:with|on)\ this\ page|view\ (?:page\ )?source
        follow\ us\b.{0,30}|share\ (?:on|via)\ .{0,30}|copy\ link|(?:copy\ link|link|tweet|share|mail|e-?mail|embed|feed|rss|print)(?:(?:\s*[·|/,]\s*|\s{2,})(?:copy\ link|link|tweet|share|mail|e-?mail|embed|feed|rss|print))+
        sign\ in\ to\ (?:comment|save|vote|reply|rate|bookmark)\b.{0,50}|(?:log|sign)\ in\ (?:with|using)\ .{0,30}|join\ the\ (?:discussion|conversation|community)|ask\ a\ question|top\ contributors|contact\ (?:us|support)|(?:\d+\ )?comments?(?:\ \(\d+\))?
        subscribe\ to\ (?:our|the)\ newsletter\b.{0,30}|enter\ your\ e-?mail\b.{0,40}|join\ [\d,.]+\ (?:makers|developers|readers|subscribers)\b.{0,100}|get\ the\ app|get\ (?:updates|our\ newsletter)\b.{0,30}
        advertisement|sponsored(?:\ content)?(?::.{0,100})?|hiring!.{0,100}|we(?:'|’)?\ ?a?re\ hiring\b.{0,80}|new\ course:.{0,100}|learn\ how\ studios\ ship\ faster\b.{0,100}|.{0,80}\bstart\ your\ free\ trial\b.{0,20}|.{0,80}\benrol\ now\b.{0,5}|.{0,60}\ \d+\ %\ off
        (?:previous|next|prev|vorige|weiter|précédent|suivant|上一页|下一页)\s*[:：].{1,100}|[←‹«].{1,100}|.{1,100}[→›»]|trending:.{1,100}
        last\ (?:build|updated?|modified|changed|edited|reviewed)\b.{0,60}|page\ id\ \d+|powered\ by\ .{1,40}|made\ with\ (?:care|love)\b.{0,60}|built\ with\ .{1,30}|status:\ all\ systems\b.{0,30}|back\ to\ (?:the\ )?top|site\ ?map|imprint|impressum
        (?:terms\ of\ (?:use|service)|privacy\ policy|privacy|imprint|legal\ notice|cookies|terms|sitemap|contact)(?:\s*[·|/,•]\s*(?:terms\ of\ (?:use|service)|privacy\ policy|privacy|imprint|legal\ notice|cookies|terms|sitemap|contact))*
        (?:©|\(c\)|copyright)\s*\d{4}.{0,100}|.{0,60}\ and\ its\ logo\ are\ trademarks\b.{0,60}|.{0,60}\ all\ rights\ reserved\.?
        """.strip().replace("\n        ", "\n").split("\n")
    ),
    re.IGNORECASE | re.VERBOSE,
)
LISTS = re.compile(r"(?:on this page|in this (?:article|page|section)|(?:table of )?contents|related(?: articles| pages| topics| links)?|see also|popular(?: this week| articles| pages| now)?|recommended(?: for you| reading)?|you may also like|more articles|recent posts|trending(?: now)?|auf dieser seite|inhalt|本页内容|相关文章)\s*:?", re.IGNORECASE)
TITLE = re.compile(r"(?:[-–*•▸]\s*|\d+(?:\.\d+)*[.)]?\s+)?[^.!?;:。|{}()=<>]*(?:\d+(?:\.\d+)+)?[^.!?;:。|{}()=<>]*")


def plain(line: str) -> str:
    return re.sub(r"^[\s\-–*•▸>+]+|[\s▾▼▸+]+$", "", line.replace("\xa0", " ")).strip()


def is_title(line: str) -> bool:
    x = line.strip()
    return 0 < len(x) <= 80 and "\t" not in line and bool(TITLE.fullmatch(x)) and len(x.split()) <= 9 and not x.endswith(",")


def is_menu(x: str) -> bool:
    parts = [p.strip().lower() for p in re.split(r"\s*[|·•/»›>→]\s*|\s{2,}|\t", x) if p.strip()]
    return bool(parts) and all(re.sub(r"\s*[▾▼]$", "", p) in MENU for p in parts)


def fixed_lines(texts: list[str]) -> list[bool]:
    return [bool(x) and (is_menu(x) or bool(LINES.fullmatch(x)) or bool(LISTS.fullmatch(x))) for x in texts]


def list_runs(lines: list[str], texts: list[str], fixed: list[bool]) -> dict[int, tuple[int, bool]]:
    """For each title-like line that follows the head of a list: that head or the title before it, and whether the run's shape speaks for an entry."""
    key = [re.sub(r"^\d+(?:\.\d+)*[.)]?\s+", "", x).lower() for x in texts]
    out: dict[int, tuple[int, bool]] = {}
    found = {i for i, x in enumerate(fixed) if x}
    for i, x in enumerate(texts):
        if not (x and LISTS.fullmatch(x)):
            continue
        run = []
        for j in range(i + 1, len(lines)):
            if not texts[j]:
                continue
            if fixed[j] or not is_title(lines[j]):
                break
            run.append(j)
        else:
            j = len(lines)
        if j == len(lines) or fixed[j]:
            entries = len(run)
        else:
            # The body follows, and nothing tells the last entries from its first headings unless they come again below. A body begins
            # with one heading or two, a part of it with one or none; lists have two to five entries.
            again = [k for k in run if key[k] in key[k + 1 :]]
            inside = any(texts[k] and k not in found for k in range(i))
            heads = 0 if inside and len(run) <= 2 else 2 if not inside and len(run) >= 7 else 1
            entries = run.index(again[-1]) + 1 if again else max(0, len(run) - heads)
        found.update(run[:entries])
        for n, j in enumerate(run):
            out[j] = (run[n - 1] if n else i, n < entries)
    return out


@dataclass
class Tree:
    """parent[i] < i of each node; kind of the edge to it; features; line number of line nodes, else 0."""

    parent: list[int] = field(default_factory=lambda: [-1])
    edge: list[str] = field(default_factory=lambda: [""])
    features: list[list[str]] = field(default_factory=lambda: [["page"]])
    line: list[int] = field(default_factory=lambda: [0])

    def add(self, parent: int, edge: str, features: list[str], line: int = 0) -> int:
        self.parent.append(parent)
        self.edge.append(edge)
        self.features.append(features)
        self.line.append(line)
        return len(self.parent) - 1


def line_kind(line: str, text: str, fixed: bool) -> str:
    if fixed:
        return "menu" if is_menu(text) else "head" if LISTS.fullmatch(text) else "phrase"
    if re.match(r"\s*(?:\d+[.)]|step \d+)", line, re.IGNORECASE) and not is_title(line):
        return "step"
    if re.search(r"[;{}]\s*$|^\s*(?://|#include)", line):
        return "code"
    return "title" if is_title(line) else "prose"


def tree(content: str) -> Tree:
    lines = [x.rstrip("\r") for x in content.split("\n")]
    texts = [plain(x) for x in lines]
    fixed = fixed_lines(texts)
    listed = list_runs(lines, texts, fixed)
    full = [i for i, x in enumerate(lines) if x.strip()]
    place = {i: n for n, i in enumerate(full)}
    out, node_of, block = Tree(), {}, 0
    for i, line in enumerate(lines):
        if not line.strip():
            block = 0
            continue
        if not block:
            block = out.add(0, "block", ["block", "first" if place[i] == 0 else "later"])
        kind = line_kind(line, texts[i], fixed[i])
        n = place[i]
        features = [f"kind {kind}", f"top {min(n, 8)}", f"bottom {min(len(full) - 1 - n, 8)}", f"words {min(len(line.split()), 12)}"]
        features += ["stop"] if re.search(r"[.!?。]\s*$", line) else []
        features += ["digits"] if re.search(r"\d", line) else []
        features += ["separators"] if re.search(r"[|·•»›←→©▾▼]", line) else []
        if i in listed:
            parent, entry = listed[i]
            features.append(f"entry {entry}")
            node_of[i] = out.add(node_of.get(parent, block), "entry" if entry else "after", features, i + 1)
        else:
            node_of[i] = out.add(block, "line", features, i + 1)
    return out


@dataclass
class Model:
    """node: what a feature adds to the score of furniture; edge: for each kind of edge the scores of (parent, child) states body-body to furniture-furniture."""

    node: dict[str, float] = field(default_factory=dict)
    edge: dict[str, list[float]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: Path = Path(__file__).with_name("furniture.json")) -> Model:
        return cls(**json.loads(path.read_text()))

    def messages(self, t: Tree) -> tuple[list[float], list[list[float]]]:
        """The marginal of furniture at each node, and of each edge's four pairs of states, by one pass up and one down."""
        n = len(t.parent)
        own = [math.exp(min(30.0, max(-30.0, sum(self.node.get(f, 0.0) for f in x)))) for x in t.features]
        pots = {k: [math.exp(x) for x in v] for k, v in self.edge.items()}
        flat = [1.0] * 4
        up: list[tuple[float, float]] = [(1.0, x) for x in own]  # product of a node's potential and its children's messages
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            bb, bf, fb, ff = pots.get(t.edge[i], flat)
            x, y = up[i]
            m = (bb * x + bf * y, fb * x + ff * y)
            z = m[0] + m[1]
            sent[i] = m = (m[0] / z, m[1] / z)
            p, q = up[t.parent[i]]
            z = p * m[0] + q * m[1]
            up[t.parent[i]] = (p * m[0] / z, q * m[1] / z)
        belief = [(0.0, 0.0)] * n
        pairs: list[list[float]] = [[0.0] * 4] * n
        z = up[0][0] + up[0][1]
        belief[0] = (up[0][0] / z, up[0][1] / z)
        for i in range(1, n):
            bb, bf, fb, ff = pots.get(t.edge[i], flat)
            p, q = belief[t.parent[i]]
            p, q = p / sent[i][0], q / sent[i][1]
            x, y = up[i]
            four = [p * bb * x, p * bf * y, q * fb * x, q * ff * y]
            z = sum(four)
            pairs[i] = four = [v / z for v in four]
            belief[i] = (four[0] + four[2], four[1] + four[3])
        return [b[1] for b in belief], pairs


@cache
def model() -> Model:
    return Model.load()


def furniture(content: str) -> list[int]:
    t = tree(content)
    marginal, _ = model().messages(t)
    return [n for n, p in zip(t.line, marginal, strict=True) if n and p >= 0.5]


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spark.read.parquet(f"{sf_dir}/source_records.parquet")
    return distinct(records.where(F.get_json_object("metadata", "$.url").isNotNull() & (F.length("content") > 0)).select("id", "content"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, n) for i, content in batch.itertuples(index=False) for n in furniture(content)]
            yield pd.DataFrame(found, columns=["id", "line_no"])

    return pages_of(spark, sf_dir).mapInPandas(judge, "id string, line_no int").distinct()


def p5_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, body and without_body of each page: its lines but the furniture, and whether parse_issues names its url."""
    records = spark.read.parquet(f"{sf_dir}/source_records.parquet")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"/+$", "")
    url = F.get_json_object("metadata", "$.url")
    rows = distinct(records.where(url.isNotNull()).select("id", "content", bare(url).alias("url")))
    issues = spark.read.parquet(f"{sf_dir}/parse_issues.parquet").where("url is not null").select(bare(F.col("url")).alias("url")).distinct().withColumn("named", F.lit(True))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = []
            for content in batch["content"]:
                gone = set(furniture(content)) if isinstance(content, str) and content else set()
                bodies.append("\n".join(x for n, x in enumerate(content.split("\n"), 1) if n not in gone).strip() if isinstance(content, str) else None)
            yield pd.DataFrame({"id": batch["id"], "body": bodies, "without_body": batch["without_body"]})

    joined = rows.join(issues, "url", "left").select("id", "content", F.coalesce("named", F.lit(False)).alias("without_body"))
    return joined.mapInPandas(keep, "id string, body string, without_body boolean")
