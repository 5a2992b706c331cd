"""p3: functions of source chunks that are described in earnest, with their descriptions.

One recursive pattern captures what leads to a statement (comments, directives), its head and its balanced body together; literals and comments are
taken whole, so that brackets in them don't count, and what never closes runs to the end, so that no text makes it go back. Classes and namespaces
are entered, bodies of functions aren't. Comments are those directly above; trivial ones (see in_earnest) are dropped.

Null and empty contents, and contents without a comment, hold nothing; doubled rows change nothing; a chunk's rows count together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from engine.functions.partitions import distinct

#: Comments and literals, in the order in which they hide one another.
TOKEN = re.compile(r'(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|R"(?P<d>[^()\\\s]{0,16})\(.*?(?:\)(?P=d)"|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', re.DOTALL)
UNIT = regex.compile(
    r"""
    (?(DEFINE)
      (?P<comment>//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z))
      (?P<literal>R"(?P<mark>[^()\\\s]{0,16})\((?:[^)]++|\)(?!(?P=mark)"))*+(?:\)(?P=mark)"|\Z)|"(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])++')
      (?P<round>\((?:[^()"'/R]++|(?&comment)|(?&literal)|(?&round)|["'/R])*+(?:\)|\Z))
      (?P<curly>\{(?:[^{}"'/R]++|(?&comment)|(?&literal)|(?&curly)|["'/R])*+(?:\}|\Z))
      (?P<directive>\#(?:[^\\\n]++|\\.|\\\Z)*+)
      (?P<piece>[^;{}()"'/\#:R]++|(?&comment)|(?&literal)|(?&round)|::|["'/\#:R])
    )
    (?P<close>\s*+\})
    |(?P<lead>(?:\s++|(?&comment)|(?&directive)|(?:public|protected|private)\s*+:(?!:))*+)
     (?P<head>(?&piece)*+)
     (?:;|(?P<body>\{)|(?=\})|\Z)
    """,
    regex.VERBOSE | regex.DOTALL,
)
BODY = regex.compile(UNIT.pattern[: UNIT.pattern.index("(?P<close>")] + "(?&curly)", regex.VERBOSE | regex.DOTALL)
SCOPE = re.compile(r"\b(?:class|struct|namespace|union|extern)\b[^()=]*$")
NOT_NAMES = {"if", "for", "while", "switch", "return", "sizeof", "catch", "static_assert", "defined", "decltype", "alignas", "alignof", "noexcept", "requires", "new", "delete", "throw"}
NOT_TYPES = re.compile(r"\b(?:return|new|delete|throw|using|typedef|goto|else|case|co_return|co_await)\b|->|[.=+/!?|\"]")
CALL = re.compile(r"(?<!\w)(operator\s*(?:\(\s*\)|[^\s\w(]+|\s[\w:]+[\s*&]*)|~?\w+)\s*(?:<[^()]*>\s*)?\(")
QUALIFIED = re.compile(r"(?<!\w)(\w+)\s*(?:<[^()]*>)?\s*::\s*$")


#: What leads to a statement once comments are blanked.
LEAD = re.compile(r"(?:\s+|#(?:[^\\\n]|\\.)*|(?:public|protected|private)\s*:(?!:))*", re.DOTALL)


def hide(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with comments and literals blanked, lines kept; the spans of comments."""
    spans: list[tuple[int, int]] = []

    def blank(m: re.Match) -> str:
        if m["line"] or m["block"]:
            spans.append(m.span())
            return re.sub(r"[^\n]", " ", m[0])
        return re.sub(r"[^\n]", '"', m[0])

    return TOKEN.sub(blank, text), spans


def closing(code: str, at: int, pair: str) -> int:
    """The place after the bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(code)):
        depth += (code[i] == pair[0]) - (code[i] == pair[1])
        if not depth:
            return i + 1
    return len(code)


def statements(text: str) -> Iterator[tuple[int, int, int, str]]:
    """Of each statement outside of bodies: where what leads to it begins, where its head and its body end, and the class around."""
    owners: list[str] = []
    at = 0
    while at < len(text) and (m := UNIT.match(text, at)):
        if m["close"]:
            if owners:
                owners.pop()
            at = m.end()
            continue
        end = m.end()
        if m["body"]:
            head = hide(m["head"])[0]
            bare = re.sub(r"\b[A-Z][A-Z0-9_]*\s*\([^()]*(?:\([^()]*\)[^()]*)*\)", "", unfold(head)[1])
            if SCOPE.search(bare):
                name = re.search(r"\b(?:class|struct|union)\s+(?:\[\[.*?\]\]\s*|[A-Z][A-Z0-9_]*_API\s+)*(\w+)", bare)
                owners.append(name[1] if name else owners[-1] if owners else "")
                at = end
                continue
            end = BODY.match(text, end - 1).end()
        yield at, m.end("head"), end, owners[-1] if owners else ""
        at = max(end, at + 1)


def unfold(head: str) -> tuple[int, str]:
    """What follows the macro, attribute and template parts at the head of a statement, and where it begins."""
    at = 0
    while True:
        while at < len(head) and head[at].isspace():
            at += 1
        if m := re.compile(r"template\s*(?=<)").match(head, at):
            at = closing(head, m.end(), "<>")
        elif head.startswith("[[", at):
            at = closing(head, at, "[]")
        elif (m := re.compile(r"[A-Z][A-Z0-9_]{2,}\s*(?=\()").match(head, at)) and head[(to := closing(head, m.end(), "()")) :].strip():
            at = to
        elif m := re.compile(r"[A-Z][A-Z0-9_]{2,}[ \t]*(?=\n)").match(head, at):
            at = m.end()
        else:
            return at, head[at:]


def function_name(head: str, owner: str) -> str | None:
    for m in CALL.finditer(head):
        name, before = m[1].strip(), head[: m.start()]
        if name in NOT_NAMES - {"if", "for", "while", "switch", "return", "catch", "static_assert", "throw"} or re.fullmatch(r"__\w+|[A-Z][A-Z0-9_]{3,}", name) and CALL.search(head, closing(head, m.end() - 1, "()")):
            if name in ("sizeof", "new", "delete"):
                return None
            continue
        if name in NOT_NAMES or NOT_TYPES.search(before) or before.count("(") != before.count(")"):
            return None
        q = QUALIFIED.search(before)
        rest = (before[: q.start()] if q else before).strip()
        if re.search(r"\w|>", re.sub(r"\b(?:explicit|inline|virtual|static|constexpr)\b|\b[A-Z0-9_]+_API\b|FORCEINLINE", "", rest)) or name.lstrip("~") in (owner, q and q[1]) or name.startswith("operator"):
            return name
        return None
    return None


TAG = re.compile(r"^[@\\](?:(?:t?param(?:\s*\[[^\]]*\])?|throws?|exception|retval)\s+[\w.,]+|(?:see|sa|inheritdoc|inheritDoc|copydoc|link|ref)\b.*|\w+)\s*[-:]?\s*")
NOTE = re.compile(r"(?:@|\\)?(?:TODO|FIXME|XXX|HACK)\b", re.IGNORECASE)
LICENCE = re.compile(r"copyright|©|\(c\) *(?:19|20)\d\d|all rights reserved|SPDX-|permission is hereby granted|licen[sc]ed under|subject to the (?:terms|licen[sc]e)|redistribution and use", re.IGNORECASE)
CODE = re.compile(r"[{}]\s*$|[\w)\]]\s*;\s*$(?<=;)|^#\s*(?:if|endif|include|define|else|pragma)\b|^(?:if|for|while|switch)\s*\(|^return\b.*;")
CJK = re.compile(r"[㐀-鿿豈-﫿]")


def is_code(line: str) -> bool:
    return bool(CODE.search(line)) and bool(re.search(r"[(){}=\[\]#]|->|::|\breturn\b|\+\+|--|\w\.\w|^\s*(?:break|continue|\w+[\s*&]+\w+)\s*;\s*$", line))


def in_earnest(lines: list[str], name: str) -> bool:
    """lines: of one comment, without its marks."""
    text, note = [], False
    if LICENCE.search(" ".join(lines)):
        return False
    for line in map(str.strip, lines):
        if not re.search(r"\w", line):
            note = False
        elif NOTE.match(line):
            note = True
        elif line[0] in "@\\":
            note = False
            text.append(TAG.sub("", line))
        elif not note and not is_code(line):
            text.append(line)
    said = re.sub(r"\{?@(?:link|inheritdoc|code|see)\b|[{}]", " ", " ".join(text), flags=re.IGNORECASE)
    if cjk := len(CJK.findall(said)):
        return cjk >= 6 or len(re.findall(r"[A-Za-z0-9_]+", said)) >= 4
    words = re.findall(r"\w+(?:['’-]\w+)*", said)
    own = {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)} | {"a", "an", "the", name.lower()}
    own |= {w + s for w in own for s in ("s", "es")}
    return len(words) >= 4 and not all(w.lower() in own for w in words)


def comment_above(lead: str, sig: int, name: str, whole_first: bool) -> list[str]:
    """The lines of the comment in earnest directly above the line of place `sig` in lead, which holds what leads to a statement and its macro lines."""
    code, _ = hide(lead)
    rows, bare = lead.split("\n"), code.split("\n")
    blank = len(code) - len(code.lstrip())
    first, n = code.count("\n", 0, blank), code.count("\n", 0, sig) - 1
    comment: list[str] = []
    while n >= 0 and rows[n].strip():
        if not bare[n].strip() and (n or whole_first):
            x = rows[n].strip()
            x = re.sub(r"^(?:/\*[*!]*<?|//[/!]*<?)|\*+/$", "", x) if x[:2] in ("/*", "//") else re.sub(r"^\*+(?!/)|\*+/$", "", x)
            comment.insert(0, x)
        elif comment and in_earnest(comment, name) or n < first or re.match(r"\s*GENERATED_\w*BODY", bare[n]):
            break
        else:
            comment = []
        n -= 1
    return comment if comment and in_earnest(comment, name) else []


def pairs(content: str) -> dict[str, tuple[str, str]]:
    """Each function described in earnest, with its description and its code; of functions of one name, the first."""
    text = content.replace("\r\n", "\n").replace("\r", "\n")
    found: dict[str, tuple[str, str]] = {}
    if "//" not in text and "/*" not in text:
        return found
    for start, head_end, end, owner in statements(text):
        region = text[start:head_end]
        if "(" not in region or "//" not in region and "/*" not in region:
            continue
        code = hide(region)[0]
        lead = LEAD.match(code).end()
        at, head = unfold(code[lead:])
        if not (name := function_name(head, owner)):
            continue
        before = text[text.rfind("\n", 0, start) + 1 : start]
        if comment := comment_above(region, lead + at, name, not before.strip()):
            said = "\n".join(x.strip() for x in comment).strip()
            found.setdefault(re.sub(r"\s+", " ", name), (said, text[start + lead : end].strip()))
    return found


def described(content: str) -> set[str]:
    return set(pairs(content))


def texts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/chunks.parquet").where("source_type is null or source_type like '%source'")
    return distinct(rows.where("content like '%//%' or content like '%/*%'").select("id", "content"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one content are read once."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, name) for i, content in zip(batch["id"], batch["content"], strict=True) for name in described(content)]
            yield pd.DataFrame(found, columns=["chunk_id", "function_name"])

    return texts_of(spark, sf_dir).mapInPandas(names, "chunk_id string, function_name string").distinct()


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, function_name, description and code of each function described in earnest; rows of a chunk that differ give a row each."""

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, name, *x) for i, content in zip(batch["id"], batch["content"], strict=True) for name, x in pairs(content).items()]
            yield pd.DataFrame(found, columns=["chunk_id", "function_name", "description", "code"])

    return texts_of(spark, sf_dir).mapInPandas(both, "chunk_id string, function_name string, description string, code string").distinct()
