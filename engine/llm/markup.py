"""p1: marks of HTML, Markdown, wiki and LaTeX in texts, and the texts without them.

A converter takes code blocks out, consumes the marks of each family and puts plain text in their place; headings, lists, code, tables' cells and
formulas stay. p1_found tells the families of the marks consumed. p1_clean gives the texts, and takes from pages what repeats over the pages of a
host (boilerplate.py), which can't tell a family.

Null and empty fields hold no marks and stay as they are; doubled rows change nothing; whole texts are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engine.functions.partitions import distinct
from engine.llm.boilerplate import without_repeats

TAGS = (
    "a abbr article aside b blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta"
    " nav ol option p pre q s samp script section select small span strike strong style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul var video wbr nowiki ref"
)
TAG = rf"</?(?:{'|'.join(TAGS.split())})(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"']+))?)*\s*/?>"
class Paired:
    """Stretches from an opening to its closing mark, in time linear in the text: what a closing mark wasn't found for once isn't looked for again."""

    def __init__(self, opening: str, closing: str, flags: int = re.IGNORECASE) -> None:
        self.opening, self.closing, self.flags = re.compile(opening, flags), closing, flags

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        closing: dict[str, re.Pattern | None] = {}
        at = 0
        while m := self.opening.search(text, at):
            at = m.end()
            name = m[1] if self.opening.groups else ""
            if name not in closing:
                closing[name] = re.compile(self.closing.replace("NAME", re.escape(name)), self.flags)
            if closing[name] and (end := closing[name].search(text, at)):
                at = end.end()
                yield m.start(), at
            else:
                closing[name] = None

    def search(self, text: str) -> tuple[str] | None:
        return next(((text[a:b],) for a, b in self.spans(text)), None)

    def sub(self, put: Callable[[tuple[str]], str], text: str) -> str:
        out, at = [], 0
        for a, b in self.spans(text):
            out += [text[at:a], put((text[a:b],))]
            at = b
        return "".join([*out, text[at:]])


#: Code blocks and spans, with the family of their own marks; what they hold is no mark.
BLOCKS = [
    ("markdown", re.compile(r"^[ >\t]*(`{3,}+|~{3,}+)[^\n`]*+\n.*?(?:^[ >\t]*\1[`~]*[ \t]*$|\Z)", re.DOTALL | re.MULTILINE)),
    ("html", Paired(r"<(pre|code|script|style|samp|kbd|tt)\b[^<>]*>", r"</NAME\s*>")),
    ("wiki", Paired(r"<(nowiki|syntaxhighlight|source)\b[^<>]*>", r"</NAME\s*>")),
    ("wiki", Paired(r"\{\{Code(?:Block|Start|Begin)?\b[^{}]*\}\}", r"\{\{Code(?:Block)?End\}\}")),
    ("latex", Paired(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim|alltt)\}", r"\\end\{NAME\}", 0)),
    ("latex", re.compile(r"\\(?:verb\*?|lstinline)([|!+/#@])[^\n]*?\1")),
    ("markdown", re.compile(r"(?<![`\\])(`{1,2})(?![`\s])[^`\n]*?[^`\s]\1(?!`)")),
]
COMMANDS = (
    "begin end section subsection subsubsection paragraph subparagraph chapter part title author maketitle item emph textbf textit texttt textsc textrm textsf underline href url cite citep citet ref eqref pageref label footnote caption"
    " includegraphics frac dfrac sqrt sum prod int SI si num usepackage documentclass newcommand input include bibliography centering hline toprule midrule bottomrule LaTeX TeX ldots dots cdot times alpha beta gamma delta epsilon theta lambda mu pi sigma"
    " omega infty leq geq neq approx le ge mathrm mathbf mathcal left right noindent par tableofcontents newline linebreak hspace vspace quad qquad tag text operatorname vec hat bar"
)
MARKS = {
    "html": [rf"(?i:{TAG})", r"<!--", r"<!DOCTYPE\b", r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,9});"],
    "markdown": [
        r"(?m)^ {0,3}#{1,6}[ \t]+\S", r"(?m)^[^\s|=+*#>-][^\n]*\n {0,3}(?:={3,}|-{3,})[ \t]*$", r"(?<![\w*/\\])\*\*(?=[^\s*])[^*\n]*?[^\s*]\*\*(?![\w*])", r"(?<![\w*/\\])\*(?=[^\s*])[^*\n]*?[^\s*(,]\*(?![\w*/])",
        r"(?<![\w])__(?=[^\s_])[^_\n]* [^_\n]*[^\s_]__(?!\w)", r"(?<![\w/\\.$])_(?=[^\W_])[^_\n]*?[^\W_][.,;:!?)]?_(?![\w/(.])", r"~~(?=[^\s~])[^~\n]*?[^\s~]~~", r"!?\[[^\]\[\n]*\]\((?:[^()\s]|\([^()\s]*\))+(?:\s+\"[^\"\n]*\")?\)",
        r"(?<![\w\]])\[[^\]\[\n]*[A-Za-z][^\]\[\n]*\]\[[^\]\[\n]*\]", r"(?m)^ {0,3}\[[^\]\[\n]+\]:[ \t]+\S", r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", r"(?m)^ {0,3}>[ \t]+\S", r"(?m)^[ \t]*[-+][ \t]\S", r"(?m)^[ \t]*(?:`{3,}|~{3,})", r"(?m)^[ \t]*[-*+][ \t]\[[ xX]\][ \t]",
    ],
    "wiki": [r"\[\[(?!(?:nodiscard|maybe_unused|likely|unlikely|noreturn|fallthrough|deprecated|no_unique_address|carries_dependency|gnu::|clang::|msvc::|\w+\(|\s*\d|\s*-))[^\[\]\n]+\]\]", r"(?<![\w'(,=\[])'{2,5}(?=[^\s',;)])[^'\n]*(?:'[^'\n]+)*[^\s',]'{2,5}(?![\w'])", r"\{\{\s*#?[A-Za-z][^{}\"]*\}\}", r"(?m)^\{\|", r"(?m)^\|\}", r"(?m)^\|-+\s*$", r"(?m)^(={2,6})[ \t]*[^=\s][^\n]*?[^=\s]?[ \t]*\1[ \t]*$", r"(?<!\[)\[(?:https?|ftp)://\S+[^\]\n]*\](?!\()", r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__", r"~{4,5}(?=\s|$)", r"(?i)#REDIRECT\s*\[\["],
    "latex": [rf"(?<![\w:\\/.-])\\(?:{'|'.join(COMMANDS.split())})(?![A-Za-z])\*?(?!\\)(?:(?=[\[{{])|(?=[\s.,;:$^_)}}]|$))", r"\$\$[^$]+\$\$", r"(?<![\w$\\])\$(?=[^\s$\d]|\d[^$\n]*[\\^_=+])(?![A-Z_]+\b[^\\^=+$]*\$)[^$\n]{0,200}?[^\s$\\]\$(?![\w$])", r"\\\((?=[^\n]*?\\\))", r"(?m)\\\[[^\]]*\\\]"],
}
MARKS = {family: [re.compile(x) for x in patterns] for family, patterns in MARKS.items()}


BLOCK_TAGS = re.compile(r"</?(?:address|article|aside|blockquote|br|caption|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|main|nav|ol|p|pre|section|table|tbody|tfoot|thead|tr|ul)\b", re.IGNORECASE)


def plain_tag(m: re.Match) -> str:
    if re.match(r"<li\b", m[0], re.IGNORECASE):
        return "\n- "
    if re.match(r"</t[dh]\b", m[0], re.IGNORECASE):
        return " | "
    return "\n" if BLOCK_TAGS.match(m[0]) else ""


#: What takes the place of marks, in order; what a pattern leaves is read again by those after it.
PLAIN: list[tuple[re.Pattern, str | Callable[[re.Match], str]]] = [
    (re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>", re.DOTALL), ""),
    (re.compile(rf"(?i:{TAG})"), plain_tag),
    (re.compile(r"(?m)^ {0,3}\[[^\]\[\n]+\]:[ \t]+\S.*$"), ""),
    (re.compile(r"(?m)^ {0,3}#{1,6}[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$"), r"\1"),
    (re.compile(r"(?m)^([^\s|=+*#>-][^\n]*)\n {0,3}(?:={3,}|-{3,})[ \t]*$"), r"\1"),
    (re.compile(r"(?m)^(={2,6})[ \t]*([^=\s][^\n]*?[^=\s]?)[ \t]*\1[ \t]*$"), r"\2"),
    (re.compile(r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$\n?"), ""),
    (re.compile(r"(?m)^(?:\{\|.*|\|\}|\|-+\s*?)$\n?"), ""),
    (re.compile(r"(?m)^ {0,3}>[ \t]+(?=\S)"), ""),
    (re.compile(r"(?m)^[ \t]*[-*+][ \t]\[[ xX]\][ \t]"), "- "),
    (re.compile(r"(?m)^([ \t]*)\+[ \t](?=\S)"), r"\1- "),
    (re.compile(r"!?\[([^\]\[\n]*)\]\((?:[^()\s]|\([^()\s]*\))+(?:\s+\"[^\"\n]*\")?\)"), r"\1"),
    (re.compile(r"(?<![\w\]])\[([^\]\[\n]*[A-Za-z][^\]\[\n]*)\]\[[^\]\[\n]*\]"), r"\1"),
    (re.compile(r"\[\[(?:[^\[\]\n|]*\|)*([^\[\]\n|]+)\]\]"), r"\1"),
    (re.compile(r"(?<!\[)\[(?:https?|ftp)://\S+[ \t]*([^\]\n]*)\](?!\()"), r"\1"),
    (re.compile(r"\{\{\s*#?[A-Za-z][^{}\"]*\}\}"), ""),
    (re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|~{4,5}(?=\s|$)|(?i:#REDIRECT)[ \t]*"), ""),
    (re.compile(r"(?<![\w'(,=\[])('{2,5})(?=[^\s',;)])([^'\n]*(?:'[^'\n]+)*[^\s',])\1(?![\w'])"), r"\2"),
    (re.compile(r"(?<![\w*/\\])(\*{1,3})(?=[^\s*])([^*\n]*?[^\s*])\1(?![\w*])"), r"\2"),
    (re.compile(r"(?<![\w/\\.$])(__|_)(?=[^\W_])([^_\n]*?[^\W_][.,;:!?)]?)\1(?![\w/(.])"), r"\2"),
    (re.compile(r"~~(?=[^\s~])([^~\n]*?[^\s~])~~"), r"\1"),
    (re.compile(r"\\item(?![A-Za-z])[ \t]*"), "- "),
    (re.compile(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?[ \t]*"), ""),
    (re.compile(r"~?\\(?:cite[pt]?|eqref|ref|pageref|label|bibliography|input|include|usepackage|documentclass)(?![A-Za-z])(?:\[[^\]\n]*\])?\{[^{}\n]*\}"), ""),
    (re.compile(r"\\href\{[^{}\n]*\}\{([^{}\n]*)\}"), r"\1"),
    (re.compile(r"\\(?:sub)*(?:section|paragraph|chapter|part|title|author)\*?\{([^{}\n]*)\}|\\(?:emph|text(?:bf|it|tt|sc|rm|sf)|underline|caption|footnote|url)\{([^{}\n]*)\}"), lambda m: m[1] or m[2] or ""),
    (re.compile(r"\$\$([^$]+)\$\$"), r"\1"),
    (re.compile(r"(?<![\w$\\])\$(?=[^\s$\d]|\d[^$\n]*[\\^_=+])(?![A-Z_]+\b[^\\^=+$]*\$)([^$\n]{0,200}?[^\s$\\])\$(?![\w$])"), r"\1"),
    (re.compile(r"\\\((.*?)\\\)"), r"\1"),
    (re.compile(r"\\\[([^\]]*)\\\]"), r"\1"),
    (re.compile(r"\\(?:centering|maketitle|tableofcontents|noindent|par|hline|toprule|midrule|bottomrule|newline|linebreak)(?![A-Za-z])[ \t]*"), ""),
    (re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,9});"), lambda m: html.unescape(m[0])),
]
#: What of a code block is its code.
CODE = [
    re.compile(r"^[ >\t]*(`{3,}|~{3,})[^\n`]*\n(?P<code>.*?)(?:^[ >\t]*\1[`~]*[ \t]*$|\Z)", re.DOTALL | re.MULTILINE),
    re.compile(r"<(\w+)\b[^<>]*>(?:<code\b[^<>]*>)?(?P<code>.*?)(?:</code\s*>)?</\1\s*>", re.DOTALL | re.IGNORECASE),
    re.compile(r"\{\{Code[^{}]*\}\}(?P<code>.*?)\{\{Code(?:Block)?End\}\}", re.DOTALL | re.IGNORECASE),
    re.compile(r"\\begin\{(\w+\*?)\}(?:\[[^\]\n]*\])?(?P<code>.*?)\\end\{\1\}", re.DOTALL),
    re.compile(r"\\(?:verb\*?|lstinline)(?P<q>[|!+/#@])(?P<code>[^\n]*?)(?P=q)"),
    re.compile(r"(`{1,2})(?P<code>[^`]*)\1"),
]
HIDDEN, SHOWN = "\ue000", re.compile("\ue000(\\d+)\ue001")


def code_of(block: str) -> str:
    """The code of a block; scripts and styles are none."""
    if re.match(r"<(?:script|style)\b", block, re.IGNORECASE):
        return ""
    for pattern in CODE:
        if m := pattern.match(block):
            code = m["code"]
            return html.unescape(code) if block.startswith("<") else code
    return block


def convert(text: str) -> tuple[str, dict[str, str]]:
    """The text without its marks, and each family found with one of its marks."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    found: dict[str, str] = {}
    codes: list[str] = []
    read = text
    for family, block in BLOCKS:
        if m := block.search(read):
            found.setdefault(family, m[0][:80])
            read = block.sub(lambda m: " " if "\n" not in m[0] else "\n \n", read)
    for family, patterns in MARKS.items():
        for pattern in patterns if family not in found else ():
            if m := pattern.search(read):
                found[family] = m[0][:80]
                break
    if not found:
        return text, found

    def keep(m: re.Match) -> str:
        codes.append(SHOWN.sub(lambda x: codes[int(x[1])], code_of(m[0])))
        line = "\n\n" if m[0][:4].lower() == "<pre" else ""
        return f"{line}{HIDDEN}{len(codes) - 1}\ue001{line}"

    for _, block in BLOCKS:
        text = block.sub(keep, text)
    for pattern, put in PLAIN:
        text = pattern.sub(put, text)
    text = re.sub(r"\n[ \t]*(?:\n[ \t]*)+\n", "\n\n", text).strip()
    return SHOWN.sub(lambda m: codes[int(m[1])], text), found


def families(text: str) -> dict[str, str]:
    """Each family with one of its marks."""
    return convert(text)[1]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/source_records.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).alias("value")) for x in ("content", "title")])).alias("x")
    fields = distinct(records(spark, sf_dir).select("id", both).select("id", "x.*").where("length(value) > 0"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, field, family) for i, field, value in batch.itertuples(index=False) for family in convert(value)[1]]
            yield pd.DataFrame(found, columns=["id", "field", "family"])

    return fields.mapInPandas(judge, "id string, field string, family string").distinct()


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title and content of each record without marks, and pages without the runs that their host repeats."""
    rows = records(spark, sf_dir).select("id", "title", "content", F.parse_url(F.get_json_object("metadata", "$.url"), F.lit("HOST")).alias("host"))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in ("title", "content"):
                batch[c] = [convert(x)[0] if isinstance(x, str) else None for x in batch[c]]
            yield batch

    texts = distinct(rows).mapInPandas(clean, "id string, title string, content string, host string")
    pages = without_repeats(texts.where("host is not null and length(content) > 0"))
    rest = texts.where("host is null or content is null or length(content) = 0").select("id", "title", "content")
    return rest.unionByName(pages.select("id", "title", "content"))
