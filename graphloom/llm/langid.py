"""Language of documents and pages by Bayesian evidence fusion.

Evidence: letter-trigram likelihoods of the text, the language that markup declares, the suffix of the address, and a
prior of the host that is smoothed towards its domain and that towards all rows. How far declarations, suffixes and
hosts can be trusted is estimated by grouped aggregation over the whole table.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, hash_bounds, held_out, match, readable
from .html_extract import main_text

#: Bounds of what is learned from: labelled rows of each language.
MAX_LABELLED = 5_000
#: Words that a text's likelihood counts for at most; rows that a domain (or all rows) weigh in the prior of a host (or domain).
EFFECTIVE_WORDS, HOST_WEIGHT, DOMAIN_WEIGHT = 40, 10.0, 20.0
WORD = re.compile(r"[^\W\d_]+")
DECLARED = re.compile(r"<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def trigrams(word: str) -> list[str]:
    word = f" {word} "
    return [word[k : k + 3] for k in range(len(word) - 2)]


class Likelihoods:
    """Log-likelihoods of a text by language: the mean over its words, worked out once a word. table: a row of `rows` for
    each trigram; others have `floor`."""

    def __init__(self, langs: list[str], trigrams: list[str], rows: np.ndarray, floor: np.ndarray, limit: int = 300_000):
        self.langs, self.floor, self.limit = langs, floor, limit
        self.table = dict(zip(trigrams, rows, strict=True))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((4096, len(self.langs) + 1), np.float64)

    def add(self, new: list[str]) -> None:
        at = len(self.number)
        while at + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.number.update(zip(new, range(at, at + len(new)), strict=True))
        for k, word in enumerate(new, at):
            for part in WORD.findall(word.lower()):
                found = [self.table.get(t, self.floor) for t in trigrams(part)]
                self.rows[k, :-1] += sum(found) / len(found)
                self.rows[k, -1] += 1

    def text(self, text: str) -> list[float]:
        """0 for each language if there are no words."""
        words = text.split()
        if len(self.number) >= self.limit:
            self.clear()
        found = list(map(self.number.get, words))
        if None in found:
            self.add(list({w for w, x in zip(words, found) if x is None}))  # noqa: B905
            found = list(map(self.number.get, words))
        if not found:
            return [0.0] * len(self.langs)
        total = self.rows[np.array(found, np.int64)].sum(0)
        n = total[-1]
        out = total[:-1] / max(n, 1) * min(n, EFFECTIVE_WORDS)
        return (out - out.max()).tolist()


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Languages, trigrams, their log-probabilities by language, and those of other trigrams, from labelled rows that are
    not held out: of each language at most MAX_LABELLED, by a hash of id and text. Repeated rows count once."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    src = src.withColumn("h", F.xxhash64("id", F.xxhash64("text")))
    bounds = hash_bounds(src, "h", MAX_LABELLED, by="lang")
    if not bounds:
        return [], [], np.zeros((0, 0)), np.zeros(0)
    limits = docs.sparkSession.createDataFrame(list(bounds.items()), "lang string, bound long")
    src = src.join(F.broadcast(limits), "lang").filter("h <= bound").dropDuplicates(["lang", "h"]).select("text", "lang")

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text, lang in zip(readable(batch.column(0)), readable(batch.column(1)), strict=True):
                for word, n in Counter(WORD.findall(text.lower())).items():
                    for t in trigrams(word):
                        seen[t, lang] += n
            if len(seen) > 300_000:
                yield emit(seen)
                seen.clear()
        yield emit(seen)

    def emit(seen):
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["t", "lang", "n"])

    found = arrow_map(src, count, "t string, lang string, n long").groupBy("t", "lang").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    langs, names = sorted(bounds), sorted(set(found["t"].to_pylist()))
    places = {t: k for k, t in enumerate(names)}
    table = np.full((len(names), len(langs)), 0.5)
    for t, lang, n in zip(*(found[c].to_pylist() for c in ("t", "lang", "n")), strict=True):
        table[places[t], langs.index(lang)] += n
    total = table.sum(0) + 0.5
    return langs, names, np.log(table / total), np.log(0.5 / total)


def softmax(scores: Column) -> Column:
    raised = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def added(*arrays: Column) -> Column:
    out = arrays[0]
    for other in arrays[1:]:
        out = F.zip_with(out, other, lambda a, b: a + b)
    return out


def logs(counts: Column, weight: float, base: Column) -> Column:
    """Log of counts smoothed by `weight` rows that are spread as `base`."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(counts, base, lambda n, p: F.log((n + weight * p) / (total + weight)))


def identify(docs: DataFrame, pages: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", host_col: str = "source", page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Language of each document and page: doc_id, page_id, lang, confidence, text_lang, host.

    Documents have their source for a host and neither markup nor address; pages have all evidence and no doc_id. A row
    without words, markup or host gets the commonest language; of equally likely languages the first in order of name
    wins. Without labelled rows lang is null. Nulls in any column count as missing evidence; texts and pages count whole,
    however long, and bytes that are no UTF-8 count as U+FFFD; ids may be of any type; repeated rows stay repeated and
    have equal results; other columns are not looked at; empty tables give no rows.
    """
    langs, names, table, floor = learn(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast((langs, names, table, floor))  # bounded by the labelled sample
    n = len(langs)

    def of_texts(batches):
        model = Likelihoods(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([model.text(t or "") for t in readable(batch.column(2))], pa.list_(pa.float64()))], ["id", "host", "ll"])

    def of_pages(batches):
        model = Likelihoods(*shared.value)
        for batch in batches:
            html = readable(batch.column(2))
            declared = [(m[1].lower() if (m := DECLARED.search(h or "")) else None) for h in html]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(declared, pa.string()), pa.array([model.text(main_text(h)) for h in html], pa.list_(pa.float64()))], ["id", "url", "declared", "ll"])

    page_kind = pages.schema[page_col].dataType if pages is not None else "long"
    d = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    rows = arrow_map(d, of_texts, f"id {d.schema['id'].dataType.simpleString()}, host string, ll array<double>")
    rows = rows.select(F.col("id").alias("doc_id"), F.lit(None).cast(page_kind).alias("page_id"), "host", F.lit("documents").alias("domain"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), "ll")
    if pages is not None:
        p = pages.select(F.col(page_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
        found = arrow_map(p, of_pages, f"id {p.schema['id'].dataType.simpleString()}, url string, declared string, ll array<double>")
        host = F.lower(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))
        domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
        ending = F.nullif(F.lower(F.coalesce(F.nullif(F.regexp_extract("url", r"^[^:]+://[^/]+/([A-Za-z]{2})(?:/|$|[?#])", 1), F.lit("")), F.regexp_extract(host, r"\.([a-z]{2})$", 1))), F.lit(""))
        rows = rows.unionByName(found.select(F.lit(None).cast(d.schema["id"].dataType).alias("doc_id"), F.col("id").alias("page_id"), host.alias("host"), F.concat(F.lit("pages "), F.coalesce(domain, F.lit(""))).alias("domain"), "declared", ending.alias("suffix"), "ll"))
    if not n:
        return rows.select("doc_id", "page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "host")
    scratch = Scratch(docs.sparkSession, "langid")
    rows = scratch.save(rows.withColumn("host", F.concat_ws(" ", "domain", F.coalesce("host", F.lit("")))).withColumn("p", softmax(F.col("ll"))), "rows")
    sums = F.array(*[F.sum(F.col("p")[k]) for k in range(n)])
    flat = F.array(*[F.lit(1.0 / n)] * n)
    everything = rows.agg(sums.alias("g")).select(F.transform("g", lambda x: F.coalesce(x, F.lit(0.0))).alias("g")).select(F.transform(logs(F.col("g"), float(n), flat), F.exp).alias("g"))
    domains = rows.groupBy("domain").agg(sums.alias("c")).join(F.broadcast(everything)).select("domain", F.transform(logs(F.col("c"), DOMAIN_WEIGHT, F.col("g")), F.exp).alias("dp"))
    hosts = rows.groupBy("domain", "host").agg(sums.alias("c"))
    hosts = match(hosts, domains, ["domain"], "host").select("host", logs(F.col("c"), HOST_WEIGHT, F.col("dp")).alias("prior"))

    def reliability(column: str) -> DataFrame:
        """Log-likelihood of each value of a sign given the language, from how it goes with the texts; missing signs say nothing."""
        counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(sums.alias("c"))
        totals = counts.agg(F.array(*[F.sum(F.col("c")[k]) for k in range(n)]).alias("t"), F.count("*").alias("v"))
        return counts.join(F.broadcast(totals)).select(column, F.zip_with("c", "t", lambda c, t: F.log((c + 0.5) / (t + 0.5 * F.col("v") + 1.0))).alias(f"{column}_ll"))

    known = match(rows, scratch.save(hosts, "hosts"), ["host"], "ll", "left")
    known = known.join(F.broadcast(reliability("declared")), "declared", "left").join(F.broadcast(reliability("suffix")), "suffix", "left")  # two or three letters each
    zeros = F.array(*[F.lit(0.0)] * n)
    total = added(F.col("ll"), F.col("prior"), F.coalesce("declared_ll", zeros), F.coalesce("suffix_ll", zeros))
    names = F.array(*map(F.lit, langs))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    out = known.withColumn("post", softmax(total))
    return out.select("doc_id", "page_id", best(F.col("post")).alias("lang"), F.round(F.array_max("post"), 6).alias("confidence"), best(F.col("ll")).alias("text_lang"), F.substring_index("host", " ", -1).alias("host"))
