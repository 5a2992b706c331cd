"""Declarations of C++ source: classes, structs, enums, functions, methods, constructors and annotated members, by a scan over masked text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

HIDDEN = re.compile(r'//(?:[^\\\n]|\\.)*|/\*.*?(?:\*/|\Z)|R"([^()\\\s]{0,16})\(.*?\)\1"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', re.DOTALL)
DIRECTIVE = re.compile(r"^[ \t]*#(?:[^\\\n]|\\.)*", re.MULTILINE | re.DOTALL)
ANNOTATION = re.compile(r"\b[A-Z][A-Z0-9_]{2,}[ \t]*\(")
CALL = re.compile(r"(?<![\w~])(~?\w+|operator[^\w\s(]+)\s*\(")
KEYWORDS = {"if", "for", "while", "switch", "return", "catch", "sizeof", "decltype", "alignas", "noexcept", "static_assert", "throw", "new", "delete", "defined"}
TYPE = re.compile(r"\b(class|struct|enum(?:\s+(?:class|struct))?)\s+(?:\w+_API\s+)?(\w+)\s*(?:final\s*)?(?::\s*([^{;]*))?$", re.DOTALL)
SPACE = re.compile(r"\bnamespace(?:\s+([\w:]+))?\s*$")
ACCESS = re.compile(r"\s*(?:public|protected|private)\s*:(?!:)")


@dataclass
class Symbol:
    kind: str
    name: str
    owner: str
    start: int
    end: int
    annotations: list[str] = field(default_factory=list)
    bases: list[str] = field(default_factory=list)

    @property
    def qualified(self) -> str:
        return f"{self.owner}::{self.name}" if self.owner else self.name


def masked(source: str) -> str:
    """The source with comments, literals and directives blanked; lengths and line ends stay."""
    blank = lambda m: re.sub(r"[^\r\n]", " ", m[0])
    return DIRECTIVE.sub(blank, HIDDEN.sub(blank, source))


def balanced(text: str, at: int) -> int:
    """The place after the bracket that closes the round one at `at`; without one, the end of its line."""
    depth = 0
    for m in re.compile(r"[()]").finditer(text, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.end()
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def annotations(head: str) -> tuple[list[str], str]:
    """Macro calls that lead a declaration, and the rest with them blanked."""
    found, at, out = [], 0, head
    while m := ANNOTATION.search(out, at):
        end = balanced(out, m.end() - 1)
        rest = out[end:].strip()
        if not rest or out[: m.start()].strip():
            at = m.end()
            continue
        found.append(re.match(r"\w+", m[0])[0])
        out = out[: m.start()] + " " * (end - m.start()) + out[end:]
        at = end
    return found, out


def function_of(head: str, owner: str) -> tuple[str, str, str] | None:
    """Kind, name and owner of a function's head, or None."""
    if re.search(r"\b(?:return|using|typedef|new|delete|throw|goto)\b", head):
        return None
    for m in CALL.finditer(head):
        name, before = m[1], head[: m.start()]
        if name in KEYWORDS or "=" in before or "(" in before:
            return None
        q = re.search(r"((?:\w+\s*(?:<[^<>]*>)?\s*::\s*)+)$", before)
        outer = re.sub(r"\s|<[^<>]*>|::$", "", q[1]) if q else ""
        outer = outer.removesuffix("::")
        own = outer.split("::")[-1] if outer else owner.split("::")[-1] if owner else ""
        typed = re.sub(r"\b(?:explicit|inline|virtual|static|constexpr|friend)\b|\b\w+_API\b", "", before[: q.start()] if q else before).strip()
        if name.lstrip("~") == own and own:
            return "constructor", name, outer or owner
        if not typed:
            return None
        where = outer or owner
        return ("method" if where else "function"), name, where
    return None


def symbols(source: str) -> list[Symbol]:
    """In order of their places, each once; what stands in bodies of functions is none."""
    text = masked(source)
    out: list[Symbol] = []
    owners: list[tuple[str, Symbol | None]] = []
    at, i, n = 0, 0, len(text)
    mark = re.compile(r"[{}();]")
    classes = lambda: "::".join(x for x, s in owners if x and s)

    def take(end: int, head_end: int) -> None:
        lead = ACCESS.match(text, at, head_end)
        start = lead.end() if lead else at
        head = text[start:head_end]
        start += len(head) - len(head.lstrip())
        found, bare = annotations(text[start:head_end])
        if f := function_of(bare, classes()):
            out.append(Symbol(f[0], f[1], f[2], start, end, found))
        elif found and (m := re.search(r"(\w+)\s*(?:\[[^\]]*\]\s*)?(?:=[^;]*|\{\s*)?$", bare)) and len(bare.split()) > 1:
            out.append(Symbol("property", m[1], classes(), start, end, found))

    while m := mark.search(text, i):
        c, i = m[0], m.end()
        if c == "(":
            i = balanced(text, m.start())
        elif c == ";":
            take(m.end(), m.start())
            at = i
        elif c == "}":
            if owners:
                _, s = owners.pop()
                if s:
                    s.end = m.end()
            at = i
        elif c == "{":
            lead = ACCESS.match(text, at, m.start())
            start = lead.end() if lead else at
            found, bare = annotations(text[start : m.start()])
            start += len(bare) - len(bare.lstrip()) if not found else len(text[start : m.start()]) - len(text[start : m.start()].lstrip())
            if t := TYPE.search(bare.rstrip()):
                kind = "enum" if t[1].startswith("enum") else t[1]
                bases = [re.sub(r"\b(?:public|protected|private|virtual)\b", "", b).strip() for b in (t[3] or "").split(",") if b.strip()]
                s = Symbol(kind, t[2], classes(), start, n, found, bases)
                out.append(s)
                owners.append((t[2], s))
            elif (space := SPACE.search(bare.rstrip())) or re.search(r"\bextern\s*$", bare):
                owners.append(((space[1] or "") if space else "", None))
            else:
                depth = 1
                for b in re.compile(r"[{}]").finditer(text, i):
                    depth += 1 if b[0] == "{" else -1
                    if not depth:
                        i = b.end()
                        break
                else:
                    i = n
                take(i, m.start())
            at = i
    once: dict[tuple, Symbol] = {}
    for s in out:
        once.setdefault((s.start, s.kind, s.name), s)
    return list(once.values())


def symbol_rows(source: str) -> list[tuple]:
    """kind, name, qualified name, first and last line, annotations, bases, code."""
    rows = []
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    from bisect import bisect_right

    for s in symbols(source):
        rows.append((s.kind, s.name, s.qualified, bisect_right(starts, s.start), bisect_right(starts, max(s.start, s.end - 1)), s.annotations, s.bases, source[s.start : s.end]))
    return rows


SYMBOL_FIELDS = "kind string, name string, qualified string, first_line int, last_line int, annotations array<string>, bases array<string>, code string"


def symbol_chunks(source: str, path: str = "") -> list[tuple]:
    """kind, name, part, parts, oversized, tokens and text of the chunks of a source; annotated members of a class are one chunk."""
    from engine.operators.chunking import Limits, code_chunks, count

    out, members = [], {}
    for kind, name, qualified, first, last, _, _, code in symbol_rows(source):
        if kind == "property":
            members.setdefault(qualified.rpartition("::")[0], []).append(code)
            continue
        label = "type" if kind in ("class", "struct", "enum") else kind
        header = f"Kind: {label}\nSymbol: {qualified}\nLines: {first}-{last}"
        out += [(label, qualified, part, parts, over, count(text), text) for part, parts, over, text in code_chunks(code, header, Limits(), label != "type")]
    for owner, codes in members.items():
        text = f"Kind: properties\nSymbol: {owner}\n" + "\n".join(codes)
        out.append(("properties", owner, 1, 1, count(text) > Limits().most, count(text), text))
    return out


CHUNK_FIELDS = "kind string, symbol string, part int, parts int, oversized boolean, tokens int, content string"
