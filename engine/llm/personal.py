"""p10: e-mail addresses, phone numbers, identity numbers, postal addresses and names of persons in documents.

The character tagger (tagger.py) finds the spans; an exact check by the patterns below sets their ends and drops what has the form of none of
the kinds. Null and empty texts hold nothing; a text's repeated strings give one row; whole texts are read, in overlapping windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from engine.functions.partitions import spread
from engine.llm.tagger import Tagger, encode

AT, DOT = r"(?:@|＠|[ \t]*[\[({<][ \t]*(?:at|AT|At|@|ät)[ \t]*[\])}>][ \t]*|[ \t]+(?:AT|at)[ \t]+(?=[\w-]+(?:[ \t]*[\[({]|[ \t]+(?:dot|DOT)[ \t])))", r"(?:\.|．|[ \t]*[\[({<][ \t]*(?:dot|DOT|Dot|\.|punkt)[ \t]*[\])}>][ \t]*|[ \t]+(?:dot|DOT)[ \t]+)"
EMAIL = re.compile(rf"(?<![\w.+%@/-])[A-Za-z0-9](?:[\w.+%-]*\w)?(?:{DOT}[\w+%-]+)*?{AT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*{DOT}[A-Za-z]{{2,18}}(?![\w@-])")
#: These skip stretches quickly that hold no case.
MAYBE_EMAIL = re.compile(r"[A-Za-z0-9_][@＠][A-Za-z0-9]|[\[({<][ \t]*(?:[Aa]t|AT|@|ät)[ \t]*[\])}>]|[ \t](?:at|AT)[ \t]+[\w-]+(?:[ \t]*[\[({]|[ \t]+(?:dot|DOT)[ \t])")
PHONE = re.compile(
    r"""(?<![\w.+:/#@-])(?:
      (?:\+|00)\d{1,3}(?:[ .\-/]?\(0\))?(?:[ .\-/]?\(\d{2,4}\))?(?:[ .\-/]?\d{2,5}|[ .\-/]\d){1,5}
      |(?:1[ .-])?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|(?:1[ .-])?\d{3}([.-])\d{3}\1\d{4}|\d{3}\ \d{3}\ \d{4}
      |\(?0\d{1,4}\)?[ /-]\d{3,8}(?:[ -]\d{2,5}){0,2}|0\d([ .-])\d{2}(?:\2\d{2}){3}|0\d{9,10}
      |1[3-9]\d[ -]\d{4}[ -]\d{4}|1[3-9]\d{9}
    )(?![\w/:@]|[.-]\d|-[A-Za-z])""",
    re.VERBOSE,
)
IDS = [
    ("", re.compile(r"(?<![\w.-])(?<!\d )\d{3}(?:-\d{2}-| \d{2} )\d{4}(?![\w-]| \d)")),
    ("", re.compile(r"(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)")),
    ("", re.compile(r"(?<!\d)\d{17}[\dXx](?!\w)")),
    ("ID card ", re.compile(r"(?<=ID card )[A-Z0-9]{3,}(?:-[A-Z0-9]+)*")),
    ("usweisnummer", re.compile(r"(?:(?<=usweisnummer: )|(?<=usweisnummer ))[A-Z]\d{2}[A-Z0-9]\d{3,4}[A-Z0-9]\d?(?!\w)")),
    ("assport", re.compile(r"(?:(?<=assport number )|(?<=assport no\. )|(?<=assport: )|(?<=assport ))[A-Z]{1,2}\d[A-Z0-9]{5,9}(?!\w)")),
]
WORD = r"[A-ZÀ-Þ][a-zß-ÿ]+"
TOWN = rf"{WORD}(?: (?:Cross|St|upon|on|am|an der|sur|{WORD}))?"
ROAD = r"(?:Street|Road|Lane|Avenue|Drive|Way|Close|Court|Place|Square|Terrace|Crescent|Boulevard|Row|Hill|Gardens|Grove|Walk|Parade|St|Rd|Ave|Ln|Dr|Blvd)"
GAP = r"(?:,[ \t]*(?:\r?\n[ \t]*)?|[ \t]*\r?\n[ \t]*|[ \t]+)"
SEP = r"(?:,[ \t]*(?:\r?\n[ \t]*)?|[ \t]*\r?\n[ \t]*)"
UK, ZIP = r"[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b", r"[A-Z]{2}[ ,]+\d{5}(?:-\d{4})?\b"
ADDRESS = re.compile(
    rf"(?<![\w.-])(?:(?:Apt|Flat|Unit|Suite) \w+{SEP})?\d{{1,5}}[A-Za-z]?,? (?:{WORD} ){{1,3}}{ROAD}\b\.?(?:{SEP}(?:Apt|Apartment|Suite|Unit|Flat|Floor)\.? ?#?\w+)?(?:{SEP}{TOWN}(?:{GAP}(?:{UK}|{ZIP}|\d{{5}}\b))?|{SEP}(?:{UK}|{ZIP}))?"
    rf"|(?<![\w.-])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours)(?: (?:de la|de l'|des|du|de|d'))? ?{WORD}(?:[ -]{WORD}){{0,2}}(?:{GAP}\d{{5}} {TOWN}|{SEP}{TOWN})?"
    rf"|\b(?:{WORD}(?:[ -]{WORD})?[ -]?(?:Straße|Strasse|straße|strasse|str\.|Str\.|weg|Weg|gasse|platz|Platz|allee|Allee|ufer|damm)|(?:Am|An der|Im|Zum|Zur) {WORD}) \d{{1,4}} ?[a-z]?\b(?:{GAP}(?:D-)?\d{{4,5}} {TOWN})?"
    rf"|\b(?:Calle|Avenida|Plaza|Paseo|C/|Avda\.)(?: (?:de la|de los|del|de))? {WORD}(?: {WORD})?,? (?:n\.?º ?)?\d{{1,4}}(?:{GAP}\d{{5}} {TOWN})?"
    r"|(?:[一-鿿]{2,4}省)?[一-鿿]{2,4}?市(?:[ \t]*\r?\n[ \t]*)?(?:[一-鿿]{1,5}?[区县])?(?:[ \t]*\r?\n[ \t]*)?[一-鿿]{1,8}?(?:路|街|道|巷|大街|大道)(?:[ \t]*\r?\n[ \t]*)?\d{1,5} ?号(?:院)?(?:\d+ ?(?:号楼|栋|幢|楼|单元|室))*"
)
MAYBE_ADDRESS = re.compile(rf" {ROAD}\b|\d,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours)\b|(?:[Ss]tra(?:ß|ss)e|[Ss]tr\.|[Ww]eg|gasse|[Pp]latz|[Aa]llee|ufer|damm) \d|\b(?:Am|An der|Im|Zum|Zur) {WORD} \d|\b(?:Calle|Avenida|Plaza|Paseo|C/|Avda\.) |(?:\d|ter|bis)(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours)\b|市")
INITIAL = r"[A-ZÀ-Þ]\."
#: Characters read on either side of what the tagger finds; no span is longer.
AROUND = 160

def like(words: set[str]) -> Callable[[str], bool]:
    """Whether a word is one of the words, or has a stem and an ending that occur among them with others; the lexicon is incomplete."""
    endings: dict[str, set[str]] = {}
    stems: dict[str, set[str]] = {}
    for w in words:
        for i in range(3, len(w)):
            endings.setdefault(w[i:], set()).add(w[:i])
            stems.setdefault(w[:i], set()).add(w[i:])
    common = {e for e, own in endings.items() if len(own) >= 5}
    return lru_cache(100_000)(lambda w: w in words or any(w[i:] in common and len(stems.get(w[:i], set()) & common) >= 2 for i in range(3, len(w))))


def spans_of_names(text: str, given: Callable[[str], bool], family: Callable[[str], bool]) -> list[tuple[int, int]]:
    """A given and a family name side by side, either way round, or a family name with initials."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"(?<![\w@./<\\-])[^\W\d_]{2,}(?:-[^\W\d_]{2,})*(?![\w@]|/\w|::|\(|->)", text)]

    @cache
    def role(w: str) -> set[str]:
        parts = [p.lower() for p in w.split("-")]
        out = set()
        if all(map(given, parts)):
            out.add("given")
        if all(map(family, parts)):
            out.add("family")
        return out

    # a word in lower case is part of a name only beside another one; small words take no place between capitalised ones
    words = [w for w in words if w[2][0].isupper() or role(w[2])]
    found, i = [], 0
    while i + 1 < len(words):
        (a, b, x), (c, d, y) = words[i], words[i + 1]
        gap = text[b:c]
        rx, ry = role(x), role(y)
        near = re.fullmatch(rf"[ \t\xa0]+(?:{INITIAL}[ \t\xa0]*){{0,3}}|[ \t]*\r?\n[ \t]*", gap)
        if near and ("given" in rx and "family" in ry or "family" in rx and "given" in ry) or re.fullmatch(r",[ \t\xa0]+|,[ \t]*\r?\n[ \t]*", gap) and "family" in rx and "given" in ry:
            if tail := ("," in gap or "family" in rx and "given" in ry) and re.match(rf"(?:[ \t\xa0]{INITIAL})+", text[d:]):
                d += tail.end()
            found.append((a, d))
            i += 2
            continue
        i += 1
    taken = [*found]
    for a, b, x in words:
        if any(a < q and p < b for p, q in taken):
            continue
        if "family" in role(x) and x[0].isupper():
            if m := re.search(rf"(?<![\w.])(?:{INITIAL}[ \t\xa0]*){{1,3}}$", text[:a][-14:]):
                found.append((a - len(m[0]), b))
            elif m := re.match(rf",[ \t\xa0]+{INITIAL}(?:[ \t\xa0]?{INITIAL})*", text[b:]):
                found.append((a, b + m.end()))
    return found


def marked(text: str, given: Callable[[str], bool], family: Callable[[str], bool], lo: int = 0, hi: int | None = None) -> list[tuple[int, int, str]]:
    """Spans within text[lo:hi] that have the form of a kind; of spans that cross, the kind first in order holds."""
    hi = len(text) if hi is None else hi
    taken: list[tuple[int, int, str]] = []

    def take(kind: str, a: int, b: int) -> None:
        if a < b and not any(a < y and x < b for x, y, _ in taken):
            taken.append((a, b, kind))

    if MAYBE_EMAIL.search(text, lo, hi):
        for m in EMAIL.finditer(text, lo, hi):
            if not re.search(r"@\d", m[0]):
                take("email", *m.span())
    for m in ADDRESS.finditer(text, lo, hi) if MAYBE_ADDRESS.search(text, lo, hi) else ():
        take("address", *m.span())
    for sign, pattern in IDS:
        for m in pattern.finditer(text, lo, hi) if text.find(sign, lo, hi) >= 0 else ():
            take("id_number", *m.span())
    for m in PHONE.finditer(text, lo, hi):
        n = len(re.sub(r"\D", "", m[0]))
        if 9 <= n <= 15 and len(set(re.sub(r"\D", "", m[0]))) > 2:
            take("phone", *m.span())
    for a, b in spans_of_names(text[lo:hi], given, family):
        take("name", lo + a, lo + b)
    return sorted(taken)


def checked(text: str, found: list[tuple[int, int, str]], given: Callable[[str], bool], family: Callable[[str], bool]) -> list[tuple[int, int, str]]:
    """Spans of exact form that touch what the tagger found; regions that touch each other are read as one."""
    regions: list[tuple[int, int]] = []
    for a, b, _ in found:
        lo, hi = max(0, a - AROUND), min(len(text), b + AROUND)
        # a region doesn't begin or end within a word
        while lo and text[lo - 1].isalnum():
            lo -= 1
        while hi < len(text) and text[hi].isalnum():
            hi += 1
        if regions and lo <= regions[-1][1]:
            regions[-1] = regions[-1][0], max(hi, regions[-1][1])
        else:
            regions.append((lo, hi))
    spans = [s for lo, hi in regions for s in marked(text, given, family, lo, hi)]
    return [s for s in spans if any(a < s[1] and s[0] < b for a, b, _ in found)]


@cache
def tagger() -> Tagger:
    return Tagger.load()


def personal(texts: list[str], given: Callable[[str], bool], family: Callable[[str], bool]) -> list[list[tuple[int, int, str]]]:
    """Of each text its spans in order; equal texts are tagged once."""
    once = list(dict.fromkeys(texts))
    spans = tagger().spans([encode(x, given, family) for x in once])
    of = {x: checked(x, s, given, family) for x, s in zip(once, spans, strict=True)}
    return [of[x] for x in texts]


def lexicon(spark: SparkSession, sf_dir: str) -> list[set[str]]:
    """Given and family names; the table is fixed and small (302 rows)."""
    names = spark.read.parquet(f"{sf_dir}/name_lexicon.parquet").where("name_word is not null").collect()
    return [{n["name_word"].lower() for n in names if n["name_role"] == role} for role in ("given", "family")]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lexicon(spark, sf_dir)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given, family = map(like, words)
        for batch in batches:
            spans = personal(batch["text"].tolist(), given, family)
            found = [(i, kind, x) for i, text, own in zip(batch["doc_id"], batch["text"], spans, strict=True) for kind, x in {(k, text[a:b]) for a, b, k in own}]
            yield pd.DataFrame(found, columns=["doc_id", "kind", "found_text"])

    return texts_of(spark, sf_dir).mapInPandas(judge, "doc_id long, kind string, found_text string")


def p10_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in the place of personal data; null stays null."""
    words = lexicon(spark, sf_dir)

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given, family = map(like, words)
        for batch in batches:
            texts = batch["text"].where(batch["text"].notna(), None).tolist()
            spans = personal([x or "" for x in texts], given, family)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "masked": [x and masked(x, s) for x, s in zip(texts, spans, strict=True)]})

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spread(documents).mapInPandas(mask, "doc_id long, masked string")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def texts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) > 0"))
