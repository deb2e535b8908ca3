"""Text and metadata of HTML by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped, word_count

#: Blocks that hold no text, and entities in the order they are decoded.
DROPPED = ("style", "script", "head", "nav", "footer", "noscript", "iframe", "svg")
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&mdash;", "\u2014"), ("&ndash;", "\u2013"), ("&hellip;", "..."), ("&copy;", "\u00a9"), ("&reg;", "\u00ae"), ("&trade;", "\u2122"))


def text(html: Column) -> Column:
    """Blocks, attributes and tags go, entities are decoded one after the other, white space becomes one space."""
    out = html
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def title(html: Column) -> Column:
    return stripped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def meta_description(html: Column) -> Column:
    return stripped(F.regexp_extract(html, r"(?i)<meta[^>]+name=['\"]description['\"][^>]+content=['\"]([^'\"]+)['\"]", 1))


def metadata(html: Column, text: Column) -> Column:
    """What a page says of itself, and the size of its text: a map of title and description, where there are some, and of
    characterCount and wordCount."""
    named = F.create_map(F.lit("title"), title(html), F.lit("description"), meta_description(html))
    return F.map_concat(F.map_filter(named, lambda _, v: v != ""), F.create_map(F.lit("characterCount"), F.length(text).cast("string"), F.lit("wordCount"), word_count(text).cast("string")))
