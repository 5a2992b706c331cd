"""Chunkers: Markdown sections with overlap, code by lines, plain text by tokens; kernels on one text, run in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: What counts as one token; the same as functions.text.TOKEN.
TOKEN = re.compile(r"[㐀-䶿一-鿿]|[A-Za-z_][A-Za-z_0-9]*|\d+(?:\.\d+)?|[^\s]")
HEADING = re.compile(r"(#{1,6})[ \t]+(.+?)\s*")
FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})([^\n]*)")


def count(text: str) -> int:
    return len(TOKEN.findall(text))


def head(text: str, n: int) -> str:
    """The text up to the end of its n-th token."""
    end = 0
    for k, m in enumerate(TOKEN.finditer(text)):
        if k == n:
            break
        end = m.end()
    return text[:end].strip() if n > 0 else ""


def tail(text: str, n: int) -> str:
    """The text from its n-th last token on."""
    starts = [m.start() for m in TOKEN.finditer(text)]
    return text[starts[-n] if n < len(starts) else 0 :].strip() if n > 0 else ""


def windows(text: str, size: int) -> list[str]:
    """Pieces of `size` tokens, without overlap."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    return [text[spans[i][0] : spans[min(i + size, len(spans)) - 1][1]] for i in range(0, len(spans), size)]


@dataclass(frozen=True)
class Limits:
    least: int = 120
    target: int = 400
    most: int = 600
    overlap: int = 60

    def __post_init__(self) -> None:
        if not 0 <= self.least <= self.target <= self.most or not 0 <= self.overlap < self.target:
            raise ValueError("least <= target <= most and overlap < target are needed")


def sections(markdown: str, title: str) -> list[tuple[list[str], str]]:
    """Headings above and text of each section; marks within fences are no headings; text before the first heading stands under the title."""
    out: list[tuple[list[str], list[str]]] = []
    stack: list[tuple[int, str]] = []
    current: list[str] = []
    fence = ""

    def close() -> None:
        if "".join(current).strip():
            out.append(([t for _, t in stack] or ([title] if title else []), current.copy()))
        current.clear()

    for line in markdown.split("\n"):
        if m := FENCE.fullmatch(line):
            if not fence:
                fence = m[1]
            elif m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
        elif not fence and (m := HEADING.fullmatch(line)):
            close()
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2]))
            continue
        current.append(line)
    close()
    return [(path, "\n".join(lines).strip()) for path, lines in out]


def atoms(text: str) -> list[tuple[str, bool]]:
    """Paragraphs and whole fenced blocks, and which of them are code."""
    out: list[tuple[str, bool]] = []
    part: list[str] = []
    fence = ""

    def close(code: bool) -> None:
        if body := "\n".join(part).strip("\n"):
            out.append((body, code))
        part.clear()

    for line in text.split("\n"):
        m = FENCE.fullmatch(line)
        if not fence and m:
            close(False)
            fence = m[1]
            part.append(line)
        elif fence:
            part.append(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                close(True)
                fence = ""
        elif line.strip():
            part.append(line)
        else:
            close(False)
    close(bool(fence))
    return out


def overlap_of(parts: list[tuple[str, bool]], budget: int) -> list[tuple[str, bool]]:
    """The last atoms that the budget holds; of a plain one that it doesn't hold, its tail; code isn't cut but left out."""
    out: list[tuple[str, bool]] = []
    for body, code in reversed(parts):
        n = count(body)
        if n <= budget:
            out.insert(0, (body, code))
            budget -= n
        elif not code:
            if budget and (rest := tail(body, budget)):
                out.insert(0, (rest, False))
            break
        if not budget:
            break
    return out


def packed(prefix: str, body: str, limits: Limits) -> list[str]:
    """Parts of a section too large for one: cut where the next atom doesn't fit, or where the part is large enough and would pass the target."""
    room = max(1, limits.most - count(prefix))
    pieces: list[tuple[str, bool]] = []
    for text, code in atoms(body):
        pieces += [(text, code)] if code or count(text) <= room else [(x, False) for x in windows(text, room)]
    out: list[str] = []
    current: list[tuple[str, bool]] = []
    fresh = 0
    join = lambda xs: "\n\n".join([*([prefix] if prefix else []), *(x for x, _ in xs)])
    for atom in pieces:
        n, have = count(atom[0]), sum(count(x) for x, _ in current)
        if atom[1] and n > room:  # a large block of code stands alone and takes no overlap
            if fresh:
                out.append(join(current))
            out.append(join([atom]))
            current, fresh = [], 0
            continue
        if fresh and (have + n > room or have >= limits.least and have + n > limits.target):
            out.append(join(current))
            current, fresh = overlap_of(current, min(limits.overlap, room - n)), 0
        current.append(atom)
        fresh += 1
    if fresh:
        out.append(join(current))
    return out


def markdown_chunks(markdown: str, title: str, limits: Limits) -> list[tuple[list[str], int, int, str]]:
    """Headings above, part, parts and text of each chunk; a section is whole if it isn't larger than the most."""
    out = []
    for path, body in sections(markdown, title):
        prefix = "\n".join(f"{'#' * (i + 1)} {x}" for i, x in enumerate(path))
        whole = f"{prefix}\n\n{body}"
        parts = [whole] if count(whole) <= limits.most else packed(prefix, body, limits)
        out += [(path, i + 1, len(parts), x) for i, x in enumerate(parts)]
    return out


def code_parts(text: str, limits: Limits) -> list[str]:
    """Whole lines, cut before the line that doesn't fit or once the target is reached; the last lines of a part begin the next one, without a second test.
    A line that is too long by itself is cut by tokens."""
    out: list[str] = []
    current: list[str] = []
    have, fresh = 0, 0
    for line in text.split("\n"):
        n = count(line)
        if n > limits.most:
            if fresh:
                out.append("\n".join(current))
            out += windows(line, limits.most)
            current, have, fresh = [], 0, 0
            continue
        if fresh and (have + n > limits.most or have >= limits.target):
            out.append("\n".join(current))
            kept, budget = [], limits.overlap
            for x in reversed(current):
                if (k := count(x)) > budget:
                    break
                kept.insert(0, x)
                budget -= k
            current, have, fresh = kept, limits.overlap - budget, 0
        current.append(line)
        have += n
        fresh += 1
    if fresh and "\n".join(current).strip():
        out.append("\n".join(current))
    return out


def code_chunks(text: str, header: str, limits: Limits, split: bool) -> list[tuple[int, int, bool, str]]:
    """Part, parts, oversized and text; only functions are split, and only if they are larger than the most less their header; others are flagged."""
    room = limits.most - count(header)
    if not split or count(text) <= room:
        return [(1, 1, count(f"{header}\n{text}") > limits.most, f"{header}\n{text}")]
    small = Limits(0, min(limits.target, max(1, room)), max(1, room), min(limits.overlap, max(0, min(limits.target, room) - 1)))
    parts = code_parts(text, small)
    return [(i + 1, len(parts), count(f"{header}\n{x}") > limits.most, f"{header}\n{x}") for i, x in enumerate(parts)]


def each_text(rows: DataFrame, id_column: str, text_column: str, kernel: Callable[[str], list[tuple]], fields: str) -> DataFrame:
    """The id with each row that the kernel gives for its text; null texts give none."""
    names = [f.split()[0] for f in fields.split(", ")]
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, *x) for i, text in zip(batch[id_column], batch[text_column], strict=True) for x in kernel(text)]
            yield pd.DataFrame(out, columns=[id_column, *names])

    return rows.where(f"{text_column} is not null").select(id_column, text_column).mapInPandas(run, f"{id_column} {kind}, {fields}")
