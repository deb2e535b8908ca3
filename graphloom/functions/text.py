"""String and token functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that initials leave out.
SMALL_WORDS = ("a", "an", "the", "of", "and", "or", "for", "in", "on", "at", "to", "from")


def normal_name(name: Column) -> Column:
    """Letters a-z, digits and single spaces, in lower case; everything else vanishes."""
    kept = F.regexp_replace(F.lower(F.regexp_replace(name, r"[^a-zA-Z0-9\s]", "")), r"\s+", " ")
    return F.trim(kept)


#: Characters that count as blank at the ends of a text: the space and all before it.
BLANKS = "".join(map(chr, range(33)))


def stripped(text: Column) -> Column:
    """Without blanks at the ends, line ends and tabs included."""
    return F.btrim(text, F.lit(BLANKS))


def stored_name(name: Column) -> Column:
    return F.lower(stripped(name))


def extracted_name(name: Column, limit: int = 500) -> Column:
    """Without one pair of matching quotes around it, with single spaces, cut at the limit."""
    trimmed = stripped(name)
    bare = F.when(F.length(trimmed) < 2, trimmed)
    for quote in ('"', "'"):
        bare = bare.when(trimmed.startswith(quote) & trimmed.endswith(quote), F.substring(trimmed, F.lit(2), F.length(trimmed) - 2))
    return F.substring(F.trim(F.regexp_replace(bare.otherwise(trimmed), r"\s+", " ")), 1, limit)


def words(text: Column, pattern: str = r"\s+") -> Column:
    return F.filter(F.split(text, pattern), lambda w: w != "")


def token_set(name: Column) -> Column:
    return F.array_distinct(words(normal_name(name)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens; 0 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """1 if either normal name holds the other; an empty one is held by all."""
    return F.when(F.contains(a, b) | F.contains(b, a), 1.0).otherwise(0.0)


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def initials(name: Column) -> Column:
    long = F.filter(words(name), lambda w: ~w.isin(*SMALL_WORDS))
    return F.array_join(F.transform(long, lambda w: F.substring(w, 1, 1)), "")


def acronym(a: Column, b: Column) -> Column:
    """1 if one normal name is the initials of the other, which has two words or more."""

    def one_way(short: Column, long: Column) -> Column:
        return ~F.contains(short, F.lit(" ")) & (F.length(short) > 0) & (F.length(short) < F.length(long)) & (F.size(words(long)) >= 2) & (initials(long) == short)

    return F.when(one_way(a, b) | one_way(b, a), 1.0).otherwise(0.0)


def tidy(text: Column) -> Column:
    """Without runs of underscores, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "_{2,}", ""), r"\s+", " "))


def word_count(text: Column) -> Column:
    """Parts between white space of the trimmed text; text of white space only counts 1, null 0."""
    return F.coalesce(F.size(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")), F.lit(0))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.coalesce(F.ceil(F.length(text) / F.lit(4.0)), F.lit(0)).cast("int")


def truncated(text: Column, max_tokens: int) -> Column:
    return F.when(token_estimate(text) <= max_tokens, text).otherwise(F.concat(F.substring(text, 1, max(0, 4 * max_tokens - 3)), F.lit("...")))


def last_tokens(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= 4 * n, text).otherwise(F.right(text, F.lit(4 * n)))


def role_label(role: Column) -> Column:
    return F.concat(F.upper(F.left(role, F.lit(1))), F.lower(F.substring(role, F.lit(2), F.length(role))))


def csv_field(value: Column) -> Column:
    value = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(value.rlike("[,\"\\n\\r]"), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def markdown_cell(value: Column, limit: int = 100) -> Column:
    flat = F.replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"\r?\n", " "), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def description_key(name: Column, descriptions: Column) -> Column:
    return F.sha2(F.concat(name, F.array_join(descriptions, "")), 256)


def name_uuid(name: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """Version 5 UUID of a name in a namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), F.pmod(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *parts)


def time_uuid(millis: Column, random_hex: Column) -> Column:
    """Version 7 UUID of a time and 32 random hex digits."""
    head, nibble = F.lpad(F.lower(F.hex(millis.cast("long"))), 12, "0"), F.conv(F.substring(random_hex, 17, 1), 16, 10).cast("int")
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), F.pmod(nibble, F.lit(4)) + 1)
    return F.concat_ws("-", F.substring(head, 1, 8), F.substring(head, 9, 4), F.concat(F.lit("7"), F.substring(random_hex, 14, 3)), F.concat(variant, F.substring(random_hex, 18, 3)), F.substring(random_hex, 21, 12))


def glob_like(pattern: str) -> str:
    """LIKE form of a key pattern: * is any run, ? any one character; % and _ keep their LIKE meaning."""
    return pattern.replace("*", "%").replace("?", "_")


def glob_regex(patterns: list[str]) -> str:
    """One anchored regular expression for file name patterns."""
    return "|".join("^" + p.strip().replace(".", r"\.").replace("*", ".*").replace("?", ".") + "$" for p in patterns if p.strip())


def serialized_keywords(high: Column, low: Column) -> Column:
    return F.concat(F.lit("HIGH:"), F.array_join(high, ","), F.lit("|LOW:"), F.array_join(low, ","))


def parsed_keywords(text: Column) -> tuple[Column, Column]:
    part = lambda name: words(F.regexp_extract(text, rf"{name}:([^|]*)", 1), ",")
    return part("HIGH"), part("LOW")


def enhanced_query(query: Column, keywords: Column) -> Column:
    return F.when(F.size(keywords) > 0, F.concat_ws(" ", query, F.array_join(keywords, " "))).otherwise(query)


#: SQL states and words that mark an error worth a retry.
TRANSIENT_STATES = ("08", "40", "53", "57")
TRANSIENT_WORDS = r"(?i)(connection\s+(reset|refused|closed)|timeout|timed\s+out|deadlock|too many connections|temporarily unavailable|server closed|broken pipe)"


def transient_error(state: Column, message: Column) -> Column:
    return F.coalesce(F.substring(state, 1, 2).isin(*TRANSIENT_STATES), F.lit(False)) | F.coalesce(message.rlike(TRANSIENT_WORDS), F.lit(False))
