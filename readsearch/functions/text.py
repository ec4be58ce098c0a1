"""Titles from pages and addresses, labels, path tokens."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is text to an HTML parser, so that nothing in it is a tag.
RAW = ("script", "style", "textarea", "xmp", "iframe", "noembed", "noframes")
#: What may hide a title, or is one: comments, raw text elements, titles; each ends with the page if nothing ends it.
_PART = rf"(?is)<(?:!--.*?(?:-->|\z)|({'|'.join(RAW)})\b[^>]*>.*?(?:</\1\b[^>]*>|\z)|title\b[^>]*>.*?(?:</title\b[^>]*>|\z))"
_REFERENCE = r"(?s)(&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)|[^&]+|&)"
_NAMES = {name: char for name, char in html5.items() if name.endswith(";")}
#: Names that hold without a semicolon too, longest first.
_BARE = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
#: Numbers that stand for characters of a Windows code page.
_WINDOWS = {n: bytes([n]).decode("cp1252", errors="ignore") or chr(n) for n in range(0x80, 0xA0)}


def _literal_map(table: dict) -> Column:
    """A constant map, which Spark folds into one literal."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _numbered(number: Column) -> Column:
    """The character of a code point, given as a long."""
    bad = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    known = F.try_element_at(_literal_map(_WINDOWS), number.cast("string"))
    return F.when(bad, F.lit("\ufffd")).otherwise(F.coalesce(known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")))


def _referenced(token: Column, bare: bool) -> Column:
    """What a character reference stands for; any other token as it is, and
    without ``bare`` those that end in no semicolon."""
    digits = F.regexp_extract(token, "^&#0*([0-9]{1,8})", 1)
    hexes = F.regexp_extract(token, "^&#[xX]0*([0-9a-fA-F]{1,8})", 1)
    number = F.when(token.startswith("&#x") | token.startswith("&#X"), F.conv(F.concat(F.lit("0"), hexes), 16, 10)).otherwise(F.concat(F.lit("0"), digits)).cast("long")
    name = F.regexp_extract(token, f"^&({'|'.join(_BARE)})", 1)
    begun = F.concat(F.try_element_at(_literal_map({n: html5[n] for n in _BARE}), name), F.substring(token, F.length(name) + 2, F.length(token)))
    by_name = F.coalesce(F.try_element_at(_literal_map(_NAMES), F.substring(token, 2, 40)), *([begun] if bare else []), token)
    out = F.when(token.rlike("^&#"), _numbered(number)).when(token.rlike("^&[A-Za-z]"), by_name).otherwise(token)
    return out if bare else F.when(token.endswith(";"), out).otherwise(token)


def unescape_html(text: Column, bare: bool = True) -> Column:
    """``text`` with its numeric and named character references resolved, each once.
    ``bare`` takes those without a semicolon as HTML parsers do; else they are text."""
    tokens = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1))
    return F.when(text.contains("&"), F.array_join(F.transform(tokens, lambda t: _referenced(t, bare)), "")).otherwise(text)


def page_title(html: Column, bare: bool = True) -> Column:
    """The text of the first title element, trimmed of white space; empty without
    one or for null.  Titles in comments, scripts and the like are none; one that
    is not closed goes on to the end.  ``bare`` as in ``unescape_html``."""
    parts = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_PART), F.lit(0))
    title = F.get(F.filter(parts, lambda p: p.rlike("(?i)^<title")), F.lit(0))
    inner = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)^<title\b[^>]*>|</title\b[^>]*>$", "")
    return F.regexp_replace(unescape_html(inner, bare), r"(?U)^\s+|\s+$", "")


def title_or_domain(title: Column, url: Column) -> Column:
    """The title if there is one, else what follows :// up to a slash or else a question mark, else the address."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    domain = F.when(F.instr(rest, F.lit("/")) > 0, F.substring_index(rest, "/", 1)).otherwise(F.substring_index(rest, "?", 1))
    return F.when(F.coalesce(title, F.lit("")) != "", title).when(F.instr(url, F.lit("://")) > 0, domain).otherwise(url)


def secondary_text(kind: Column, url: Column, command: Column) -> Column:
    return F.when(kind == "bookmark", url).otherwise(command)


def url_like(query: Column, n_results: Column) -> Column:
    """Whether a query without results is an address to add."""
    q = F.regexp_replace(query, r"(?U)^\s+|\s+$", "")
    return (q != "") & (q.startswith("http://") | q.startswith("https://") | q.contains(".")) & (n_results == 0)


def args_suffix(args: Column) -> Column:
    """Arguments as shown behind a title: a blank before each, or nothing."""
    return F.when(F.size(F.coalesce(args, F.array().cast("array<string>"))) > 0, F.concat(F.lit(" "), F.array_join(args, " "))).otherwise("")


def count_prefix(count: Column) -> Column:
    """A count in four places at least, and a blank."""
    return F.format_string("%4d ", count.cast("long"))


def mode_label(mode: str, has_dictionary: bool = True) -> str:
    names = {"fuzzy": "Fuzzy", "reading": "Reading", "combined": "Combined"}
    return names[mode] + ("" if has_dictionary or mode == "fuzzy" else " (dict missing)")


def sort_label(sort: str) -> str:
    return {"by_score": "Score", "by_count": "Count"}[sort]


def split_token(token: Column) -> Column:
    """struct(prefix, leaf): cut after the last slash or backslash."""
    pattern = r"(?s)^(.*[/\\])?([^/\\]*)$"
    return F.struct(F.regexp_extract(token, pattern, 1).alias("prefix"), F.regexp_extract(token, pattern, 2).alias("leaf"))


def format_candidate(prefix: Column, name: Column, is_dir: Column) -> Column:
    return F.concat(prefix, name, F.when(is_dir, "/").otherwise(""))
