"""Text functions as column expressions; each gives null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One token each for an ideograph, a name, a number and any other character.
TOKEN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]|[A-Za-z_][A-Za-z_0-9]*|\p{Nd}+(?:\.\p{Nd}+)?|[^\p{IsWhite_Space}\x{1c}-\x{1f}]"
#: Tokens of a query; a run of ideographs is one.
QUERY_TOKEN = r"[A-Za-z_][A-Za-z_0-9]*|[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+|\p{Nd}+"
#: Name space of point ids (that of URLs).
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_count(c: Column | str) -> Column:
    return F.size(tokens(c))


def query_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(c, F.lit(QUERY_TOKEN), F.lit(0))


def index_tokens(c: Column | str) -> Column:
    """Lower-case runs of letters and digits, without diacritics of Latin letters."""
    plain = F.regexp_replace(F.lower(c), r"[\x{300}-\x{36f}]", "")
    plain = F.translate(plain, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def normalize_inline(c: Column | str) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\p{IsWhite_Space}\x{1c}-\x{1f}]+", " "))


def clean_markdown(c: Column | str) -> Column:
    """LF line ends, no blanks before them, at most one empty line, none at the ends."""
    lf = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(lf, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def uuid5(c: Column | str, namespace: str = NAMESPACE) -> Column:
    """The UUID of version 5 of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(c, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def canonical_url(c: Column | str, version: str, locale: str | None = None) -> Column:
    """https, host in lower case, single slashes, none at the end, no fragment, the version as the only query; with a locale, the first of the path."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.translate(c, "\\", "/"), r"[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z]+://([^/]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z]+://[^/]*(.*)$", 1), r"/{2,}", "/"), r"/$", "")
    if locale:
        path = F.regexp_replace(path, r"^/[a-z]{2}(?=/|$)", f"/{locale}")
    return F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), F.lit(f"?version={version}"))


def allowed_url(c: Column, hosts: list[str], prefixes: list[str], pattern: str = "") -> Column:
    """https, one of the hosts, and a path that begins with one of the prefixes and holds the pattern in any case."""
    path = F.regexp_extract(c, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    host = F.lower(F.regexp_extract(c, r"^[A-Za-z]+://([^/?#:]*)", 1))
    ok = c.startswith("https://") & host.isin([h.lower() for h in hosts])
    return ok & F.reduce(F.array(*[path.startswith(p) for p in prefixes]), F.lit(False), lambda a, b: a | b) & path.rlike(f"(?i){pattern}")


def file_type(path: Column | str) -> Column:
    """build_cs, cpp, inl or header, else null."""
    low = F.lower(path)
    return F.when(low.endswith(".build.cs"), "build_cs").when(low.endswith(".cpp"), "cpp").when(low.endswith(".inl"), "inl").when(low.endswith(".h"), "header")


def ancestors(path: Column | str) -> Column:
    """The path's folders, the deepest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
