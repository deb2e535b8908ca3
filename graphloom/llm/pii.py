"""Personal data in texts, by DataFrame and SQL functions only: base kinds by pattern and check digit, further
identifiers by bootstrapped contextual extraction.

Seeds are the base entities and strings of unmistakable secret shape. The words before a seed and the shape of the
string are a lexical pattern. Patterns and strings form a graph that is scored in turns: a pattern by the mean score of
its distinct strings, a string by its best pattern. Strings that are no seeds but stand in a pattern of high confidence
are new finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, match, unused

#: Fixed values of the contract: the kinds in their order and what each looks like. A match starts where the search
#: would find it from the left; possessive parts and the guards before a run keep the search linear.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be searched for at all.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Strings that may be identifiers: eight or more letters, digits and joints with a digit among them.
CANDIDATE = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{8,}+"
#: Seeds of kind secret: long hexadecimal strings of letters and digits, and access key ids.
SECRET = r"^(?:(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{16,}|A[KS]IA[0-9A-Z]{16})$"

ROUNDS, CONFIDENCE, SUPPORT = 2, 0.8, 3
SPAN = "struct<s:int,e:int,kind:string,v:string,cue:string>"


def luhn(digits: Column) -> Column:
    """Whether the check digit fits: every second digit from the right is doubled, and the sum ends in 0."""
    step = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, twice(step(i))).otherwise(step(i)))
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def cue(before: Column) -> Column:
    """The words and joint right before a match, in lower case: at most two words, however long. They are read backwards,
    so the search starts in one place."""
    return F.lower(F.reverse(F.regexp_extract(F.reverse(before), r"^([\"'(]?\s*+[=:]?\s*+[\p{L}_]*+(?:\s+[\p{L}_]++)?)", 1)))


#: Finds of a text are worked through in pieces of so many, so that work grows with their number, not its square.
PIECE = 256


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pieces(rows: Column, fold) -> Column:
    """fold(k, rows of piece k) for each PIECE of an array, as an array."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(rows) - 1) / PIECE).cast("int"))), lambda k: fold(k, F.slice(rows, k * PIECE + 1, F.lit(PIECE))))


def located(text: Column, pattern: str, keep, kind) -> Column:
    """Matches of a pattern with their places in code points, from the lengths of the text's pieces and matches."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    width = lambda x: F.length(x["a"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + F.length(x["a"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(begin.alias("s"), end.alias("e"), kind(x["m"]).cast("string").alias("kind"), x["m"].alias("v"), cue(x["a"]).alias("cue"))
        found = F.when(x["m"].isNotNull() & F.coalesce(keep(x["m"]), F.lit(False)), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("pos"), found.alias("out"))

    def of(rows: Column) -> Column:
        widths = pieces(rows, lambda k, some: F.aggregate(some, F.lit(0), lambda acc, x: acc + width(x)))
        before = lambda sums, k: F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda acc, x: acc + x)
        return bound(widths, lambda sums: F.flatten(pieces(rows, lambda k, some: F.aggregate(some, F.struct(before(sums, k).alias("pos"), none().alias("out")), step, lambda acc: acc["out"]))))

    return bound(pairs, of)


def none() -> Column:
    return F.expr(f"cast(array() AS array<{SPAN}>)")


def base_spans(text: Column) -> Column:
    """Base spans of all kinds, by start and then kind in the order of KINDS."""
    parts = []
    for kind in KINDS:
        may = text.rlike("[0-9]{1,3}[.][0-9]") if kind == "ip" else text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}") if kind == "card" else text.contains(NEEDED[kind])
        parts.append(F.when(may, located(text, PATTERNS[kind], lambda m, kind=kind: valid(kind, m), lambda _, kind=kind: F.lit(kind))).otherwise(none()))
    order = lambda x: F.struct(x["s"].alias("s"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x.alias("x"))
    return F.transform(F.array_sort(F.transform(F.concat(*parts), order)), lambda y: y["x"])


def candidate_spans(text: Column, base: Column) -> Column:
    """Possible identifiers that touch no base span; kind secret marks seeds."""
    found = F.when(text.rlike("[0-9]"), located(text, CANDIDATE, lambda m: F.lit(True), lambda m: F.when(m.rlike(SECRET), "secret"))).otherwise(none())
    return F.filter(found, lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))


def shape(v: Column) -> Column:
    """Kind of characters and length of a string."""
    kind = F.when(v.rlike("^[0-9]+$"), "num").when(v.rlike("^[0-9a-f]+$"), "hex").when(v.rlike("^[0-9A-Z]+$"), "caps").otherwise("mix")
    return F.concat(kind, F.lit(":"), F.length(v).cast("string"))


def label(before: Column) -> Column:
    """The name and joint that a cue ends with, such as `key =`; empty if it ends otherwise."""
    return F.regexp_replace(F.regexp_extract(before, r"([\p{L}_]+\s*[=:]\s*[\"'(]?)$", 1), r"\s+", " ")


def confident_patterns(seen: DataFrame) -> DataFrame:
    """Patterns of high confidence, from (cue, v, kind) of all spans: pattern, confidence, support, kind.

    Scores go to and fro on the graph of distinct strings and patterns; every sum is a partial aggregation, so a
    pattern that holds a third of all rows is no hot key.
    """
    patterns = F.array_compact(F.array(F.when(label(F.col("cue")) != "", F.concat(F.lit("c|"), label(F.col("cue")))), F.when(F.col("cue").rlike(r"\p{L}"), F.concat(F.lit("s|"), F.regexp_replace("cue", r"\s+", " "), F.lit("|"), shape(F.col("v"))))))
    edges = seen.select(F.explode(patterns).alias("pattern"), F.xxhash64(F.lower("v")).alias("inst"), "kind").groupBy("pattern", "inst").agg(F.max("kind").alias("kind"))
    scored = edges.withColumn("score", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0))
    out = None
    scratch = Scratch(seen.sparkSession, "pii-patterns")
    scored = scratch.save(scored, "edges")
    for turn in range(ROUNDS):
        out = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + F.lit(0.5))).alias("confidence"), F.sum(F.when(F.col("kind").isNotNull(), 1).otherwise(0)).alias("support"), F.max("kind").alias("kind"))
        if turn + 1 < ROUNDS:
            best = match(scored.select("pattern", "inst"), out.select("pattern", "confidence"), ["pattern"], "inst").groupBy("inst").agg(F.max("confidence").alias("best"))
            scored = scored.join(best, "inst").select("pattern", "inst", "kind", F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.col("best")).alias("score"))
    return out.filter((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of each document: doc_id, text_hash, base (array of spans), added (array of spans).

    One row per input row. Null text counts as empty and has no spans. Texts are read once; what is found is written
    to the scratch folder, and patterns are scored from there.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with_base = src.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", base_spans(F.col("text")).alias("base"))
    seen = scratch.save(with_base.select("doc_id", "text_hash", "base", candidate_spans(F.col("text"), F.col("base")).alias("cands")), "seen")
    each = seen.filter((F.size("base") > 0) | (F.size("cands") > 0)).select("doc_id", "text_hash", F.explode(F.concat("base", "cands")).alias("x")).select("doc_id", "text_hash", "x.*")
    sure = scratch.save(confident_patterns(each.select("cue", "v", "kind")), "patterns").withColumnRenamed("kind", "found_kind")
    single = F.regexp_replace("cue", r"\s+", " ")
    named = F.when(label(F.col("cue")) != "", F.concat(F.lit("c|"), label(F.col("cue"))))
    maybe = each.filter("kind IS NULL").withColumn("pattern", F.explode(F.array_compact(F.array(named, F.concat(F.lit("s|"), single, F.lit("|"), shape(F.col("v")))))))
    new = match(maybe, sure.select("pattern", "found_kind"), ["pattern"], "v").groupBy("doc_id", "text_hash", "s", "e").agg(F.max("found_kind").alias("kind"), F.first("v").alias("v"), F.first("cue").alias("cue"))
    secrets = each.filter("kind = 'secret'").select("doc_id", "text_hash", "s", "e", "kind", "v", "cue").distinct()
    added = new.select("doc_id", "text_hash", "s", "e", "kind", "v", "cue").unionByName(secrets).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("s", "e", "kind", "v", "cue"))).alias("added"))
    added = added.withColumnsRenamed({"doc_id": "a_id", "text_hash": "a_hash"})
    key = F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_hash") == F.col("a_hash"))
    return seen.join(added, key, "left").select("doc_id", "text_hash", "base", F.coalesce("added", none()).alias("added"))


def all_spans(base: Column, added: Column) -> Column:
    """Base and added spans by start; at one start base kinds first, in their order."""
    order = lambda x: F.struct(x["s"].alias("s"), F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]), F.lit(0)), F.lit(9)).alias("k"), x["e"].alias("e"), x.alias("x"))
    return F.transform(F.array_sort(F.transform(F.concat(base, added), order)), lambda y: y["x"])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of spans: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, n_spans.

    One row per input row; a document without finds, or with a null or empty text, has zeros, the digest of an empty
    string and an empty `spans`. Texts count whole, however long; at one start base kinds come first, in their order;
    repeated rows stay repeated and have equal finds; other columns are not looked at; an empty table gives no rows.
    """
    found = find(docs, id_col, text_col)
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    n_spans = (F.size("base") + F.size("added")).cast("long")
    return found.select(F.col("doc_id").alias(id_col), *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(all_spans(F.col("base"), F.col("added"))).alias("spans"), F.size("added").cast("long").alias("n_added"), n_spans.alias("n_spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with its spans, sorted by start, replaced by their kinds; spans that overlap are one, of the first's kind."""
    ends = lambda rows: F.aggregate(rows, F.lit(0), lambda acc, x: F.greatest(acc, x["e"]))
    mark = lambda x: F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))

    def of(rows: Column) -> Column:
        tops = pieces(rows, lambda k, some: ends(some))

        def one(k: Column, some: Column, before: Column) -> Column:
            # a piece starts where the furthest span before it ended, and its text is cut out once
            stop = F.greatest(before, ends(some))

            def within(part: Column) -> Column:
                start = F.struct(before.alias("pos"), F.expr("cast(array() AS array<string>)").alias("out"))
                gap = lambda acc, x: F.concat(F.substring(part, acc["pos"] - before + 1, x["s"] - acc["pos"]), mark(x))
                step = lambda acc, x: F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.when(x["s"] >= acc["pos"], F.concat(acc["out"], F.array(gap(acc, x)))).otherwise(acc["out"]).alias("out"))
                return F.array_join(F.aggregate(some, start, step, lambda acc: acc["out"]), "")

            return bound(F.substring(text, before + 1, stop - before), within)

        def whole(sums: Column) -> Column:
            reach = lambda k: F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda acc, x: F.greatest(acc, x))
            return F.concat(F.array_join(pieces(rows, lambda k, some: bound(reach(k), lambda before: one(k, some, before))), ""), F.substring(text, F.array_max(sums) + 1, F.length(text)))

        return bound(tops, whole)

    return bound(spans, of)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets; other columns and texts without finds stay as they
    are, whatever the columns are named. Null and empty texts stay; texts count whole; repeated rows stay repeated.

    Texts that hold neither a digit nor @ have no spans and take no part in the join.
    """
    i, h, sp = unused(docs, "_id", "_hash", "_spans")
    found = find(docs, id_col, text_col).filter((F.size("base") > 0) | (F.size("added") > 0)).dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), all_spans(F.col("base"), F.col("added")).alias(sp))
    text = F.col(text_col)
    may = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    rest = docs.filter(~may)
    one = docs.filter(may)
    hit = one.join(found, one[id_col].eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(h)), "left")
    return hit.select(*[(F.when(F.col(sp).isNull(), text).otherwise(masked(text, F.col(sp))) if c == text_col else F.col(c)).alias(c) for c in docs.columns]).unionByName(rest)
