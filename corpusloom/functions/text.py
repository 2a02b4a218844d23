"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common words that are never keywords.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought used "
    "to of in for on with at by from and or but if as i my me what how where when who which that this it its"
).split()

# Intent patterns.
LATEST = (
    r"(?i)\b(?:latest|recent|recently|newest|lately|new since|last updated|last modified|"
    r"(?:modified|changed|change|updated|edited|touched|index|indexed|add|added)\s+(?:last|today|yesterday|this week))\b"
)
LARGEST = r"(?i)\b(?:largest|biggest|heaviest|huge|oversized|most space|taking up space)\b"
PROJECT = r"project|overview|summary|\b(?:codebases?|repos|repositories|workspace|my folders|indexed folders?)\b"
GRAPH = (
    r"(?i)\b(?:what calls|who calls|where is .* called|depends on|dependencies of|what does .* use|how is .* used|relates to|"
    r"connection between|impact of|invoke[sd]?|callers? of|imports?|rel(?:y|ies) on|what breaks if)\b"
)
CODE_SIGNAL = (
    r"\b\w+_\w+\b|\b[a-z]+[A-Z]\w*|\b[A-Z][a-z]+[A-Z]\w*|\b[A-Z]{2,}[a-z]\w*|\b[A-Za-z_]\w*\.[A-Za-z_]\w*\b|\w+\(\)|"
    r"\b(?:[Ff]unctions?|[Mm]ethods?|[Mm]odules?|[Cc]lass(?:es)?|[Cc]ode|signature)\b"
)
METADATA = r"\b(?:project summary|summary of project|show project summary|project overview)\b"
OPERATORS = r'(?i)["*^]|\bAND\b|\bOR\b|\bNOT\b|\bNEAR\b'

INLINE_TAGS = "a|abbr|b|bdi|bdo|cite|code|em|i|kbd|mark|q|s|small|span|strong|sub|sup|u"


def squashed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0))


def keywords(text: Column) -> Column:
    """Words of over two characters that aren't stop words, in order, repeats included."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words(text), lambda w: ~F.array_contains(stop, w) & (F.length(w) > 2))


def match_terms(text: Column) -> Column:
    """Distinct sorted terms of three characters or more, search operators removed."""
    plain = F.regexp_replace(text, OPERATORS, " ")
    parts = F.filter(F.split(F.trim(plain), r"\s+"), lambda w: F.length(w) >= 3)
    return F.array_sort(F.array_distinct(parts))


def answer_tokens(text: Column) -> Column:
    """Lower case, other than letters and digits as spaces, without articles; repeats stay."""
    parts = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    return F.filter(parts, lambda w: (w != "") & ~w.isin("a", "an", "the"))


def html_text(html: Column) -> Column:
    """Text of a page: no scripts, styles and comments; inline tags vanish, others are a space."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{INLINE_TAGS})(?:\s[^>]*)?>", "")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squashed(out)


def without_controls(text: Column) -> Column:
    """Drops control and other unassigned characters but tab and line end."""
    return F.regexp_replace(text, r"[\p{C}&&[^\t\n]]", "")


def garbage_ratio(text: Column) -> Column:
    """Share of characters that are neither letters, digits, white space nor usual punctuation."""
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s.,;:!?'\"()\[\]/%&+-]", ""))
    return F.when(F.length(text) == 0, 0.0).otherwise(odd / F.length(text))


def fragmentation(text: Column) -> Column:
    """Share of words of one or two characters."""
    w = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    short = F.filter(w, lambda x: F.length(x) <= 2)
    return F.when(F.size(w) == 0, 0.0).otherwise(F.size(short) / F.size(w))


def megabytes(size: Column) -> Column:
    return F.round(size / 1048576, 2)


def log_safe(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def sentences(text: Column) -> Column:
    """Cut after sentence ends before a capital."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")


def context_prefix(path: Column) -> Column:
    from corpusloom.operators.scopes import basename, suffix

    return F.concat(F.lit("["), F.upper(F.when(suffix(path) == "", "file").otherwise(suffix(path))), F.lit(": "), basename(path), F.lit("] "))


def without_prefix(text: Column, path: Column) -> Column:
    prefix = context_prefix(path)
    return F.when(F.startswith(text, prefix), F.substr(text, F.length(prefix) + 1)).otherwise(text)


def token_estimate(text: Column) -> Column:
    """A token for four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def largest_billions(name: Column) -> Column:
    """The least "<n>b" size in a model name; null without one."""
    sizes = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+(?:\.\d+)?)b"), F.lit(1))
    return F.array_min(F.transform(sizes, lambda s: s.cast("double")))


def cleaned_reply(text: Column, longest: int = 500_000) -> Column:
    """A transcriber's reply without code fences and lead-in; empty where it is a comment on the image; cut to a bound."""
    plain = F.regexp_replace(F.trim(text), r"(?s)^```[a-z]*\n(.*?)\n?```$", "$1")
    plain = F.regexp_replace(plain, r"(?i)^(?:here is|here's|the text (?:reads|says)|transcription)[^\n:]{0,80}:\s*", "")
    comment = plain.rlike(r"(?i)^(?:i (?:can(?:no|')t|am unable)|there is no text|no (?:readable |visible )?text|the image (?:shows|contains|is))")
    return F.when(comment, "").otherwise(F.substring(F.trim(plain), 1, longest))
