"""HTML pages as Markdown: title, description, blocks, headings and links; and the plan of a crawl."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NOISE = {"head", "title", "script", "style", "nav", "footer", "noscript", "svg", "form", "button", "iframe", "template"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "table", "tr", "ul"}
#: An opening tag ends these open ones.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "body": {"head", "title"}}
SCOPES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}}


class Node:
    def __init__(self, tag: str, attributes: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attributes, self.parent, self.children = tag, attributes or {}, parent, []

    def all(self, *tags: str) -> list[Node]:
        """Nodes below, in order, without recursion."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, Node):
                if node is not self and node.tag in tags:
                    out.append(node)
                stack.extend(reversed(node.children))
        return out

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in NOISE or node is self:
                stack.extend(reversed(node.children))
        return "".join(out)


class Builder(HTMLParser):
    """A tree out of any text; tags that weren't closed end where HTML ends them."""

    DEEP = 200

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root")
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = ENDS.get(tag, {"p"} if tag in BLOCKS else set())
        node = self.at
        while node.parent and node.tag not in SCOPES.get(tag, {"table", "li", "td", "blockquote"}):
            if node.tag in ends:
                self.at = node.parent
            node = node.parent
        new = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        depth, up = 0, self.at
        while up.parent:
            depth, up = depth + 1, up.parent
        if tag not in VOID and depth < self.DEEP:
            self.at = new

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def inline_text(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def title_of(root: Node) -> str | None:
    """The heading of the header, else any h1, else <title> before the first bar."""
    for found in ([h for x in root.all("header") for h in x.all("h1")], root.all("h1")):
        if found and (text := inline_text(found[0].text())):
            return text
    titles = root.all("title")
    return inline_text(titles[0].text().split("|")[0]) or None if titles else None


def inline(node: Node | str, base: str) -> str:
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    if node.tag in NOISE:
        return ""
    body = "".join(inline(x, base) for x in node.children)
    core = body.strip()
    around = lambda mark: f"{body[: len(body) - len(body.lstrip())]}{mark}{core}{mark}{body[len(body.rstrip()) :]}" if core else body
    if node.tag in ("code", "kbd", "samp", "tt"):
        ticks = "`" * (1 + max((len(x) for x in re.findall(r"`+", core)), default=0))
        return around(ticks)
    if node.tag == "a" and core and node.attributes.get("href"):
        return f"[{core}]({urljoin(base, node.attributes['href'])})"
    if node.tag == "img":
        return f"![{node.attributes.get('alt', '')}]({urljoin(base, node.attributes.get('src', ''))})"
    if node.tag == "br":
        return "\n"
    return around({"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}[node.tag]) if node.tag in ("strong", "b", "em", "i", "del", "s") else body


def code_block(node: Node) -> str:
    code = node.text().strip("\n")
    inner = node.all("code")
    names = " ".join(x.attributes.get("class", "") for x in [node, *inner])
    language = m[1].lower() if (m := re.search(r"lang(?:uage)?-([\w+#-]+)", names)) else ""
    fence = "`" * max(3, 1 + max((len(x) for x in re.findall(r"`+", code)), default=0))
    return f"{fence}{language}\n{code}\n{fence}"


def table_rows(node: Node, base: str) -> str:
    rows = [[inline_text("".join(inline(x, base) for x in c.children)).replace("|", "\\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.all("tr")]
    rows = [x for x in rows if x]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(x + [""] * (width - len(x))) + " |" for x in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def list_lines(node: Node, base: str, depth: int = 0) -> list[str]:
    out, n = [], 0
    for item in node.children:
        if not isinstance(item, Node) or item.tag != "li":
            continue
        n += 1
        mark = f"{n}." if node.tag == "ol" else "-"
        own = [x for x in item.children if not (isinstance(x, Node) and x.tag in ("ul", "ol"))]
        out.append(f"{'  ' * depth}{mark} {inline_text(''.join(inline(x, base) for x in own))}".rstrip())
        for x in item.children:
            if isinstance(x, Node) and x.tag in ("ul", "ol"):
                out += list_lines(x, base, depth + 1)
    return out


def blocks(node: Node, base: str) -> list[str]:
    """The Markdown of what a node holds."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if text := re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"[ \t]+", " ", "".join(run))).strip():
            out.append(text)
        run.clear()

    for x in node.children:
        if isinstance(x, str) or x.tag not in BLOCKS and x.tag not in NOISE and not any(y.tag in BLOCKS for y in x.all(*BLOCKS)):
            run.append(inline(x, base))
            continue
        close()
        if x.tag in NOISE:
            continue
        if re.fullmatch(r"h[1-6]", x.tag):
            if text := inline_text("".join(inline(y, base) for y in x.children)):
                out.append(f"{'#' * int(x.tag[1])} {text}")
        elif x.tag == "pre":
            out.append(code_block(x))
        elif x.tag in ("ul", "ol"):
            out += ["\n".join(lines)] if (lines := list_lines(x, base)) else []
        elif x.tag == "table":
            out += [t] if (t := table_rows(x, base)) else []
        elif x.tag == "hr":
            out.append("---")
        elif x.tag == "blockquote":
            out += ["\n".join("> " + y if y else ">" for y in "\n\n".join(inner).split("\n"))] if (inner := blocks(x, base)) else []
        else:
            out += blocks(x, base)
    close()
    return out


def markdown(html: str, base: str = "") -> str:
    return "\n\n".join(blocks(parse(html), base))


def heading_paths(text: str) -> list[list[str]]:
    """Of each heading of a Markdown text, it and those above it."""
    from engine.operators.chunking import sections

    seen: list[list[str]] = []
    for path, _ in sections(text, ""):
        if path and path not in seen:
            seen.append(path)
    return seen


def frontier(links: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
    """url, topic, depth of links (url, topic) that no url of `seen` equals, each once; the next step of a bounded crawl."""
    new = links.groupBy("url").agg(F.min("topic").alias("topic"))
    return new.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth + 1))
