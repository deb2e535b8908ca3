"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from graphloom.llm import spelling
from graphloom.plans.scratch import Scratch

from .cases import documents


def near_of(words):
    """By all single deletions and all wildcards."""
    near, wild = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            wild[w[:i], w[i + 1 :]].add(w)
            if (cut := w[:i] + w[i + 1 :]) in words:
                near[w].add(cut)
                near[cut].add(w)
    for found in wild.values():
        for w in found:
            near[w] |= found - {w}
    return near


def brute(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near, form, out = near_of(n), {}, {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def answers(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(300)] + ["Straße", "ÀÉÎÕÜÿ", "aaaaaaa", "aaaaaa", "letters×more"]
    rows = []
    for k in range(260):
        picked = [rng.choice(words[: 10 + k]) for _ in range(60)]
        rows.append((k, " ".join(w.upper() if rng.random() < 0.1 else w for w in picked)))
    chain = ["abcdefgh"] * 700 + ["abcdefg"] * 130 + ["abcdef"] * 20 + ["abcdeg"] * 5
    rows += [(1000 + k, chain[k]) for k in range(len(chain))]
    long = "x" * 70_000
    return rows + [(5000 + k, f"{long} {long}y-{long[1:]}") for k in range(5)] + [(None, None), (None, ""), (6000, None), (None, "letters " * 6), (7, rows[7][1]), (6001, "1234567 ,,, 中文")]


@pytest.mark.parametrize("limit", [2, 64])
def test_words_and_variants_match_brute_force(spark, limit):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for name in ("word", "n", "form", "size", "shared"):
        docs = docs.selectExpr("*", f"cast(null AS string) AS {name}")
    want = brute(rows)
    assert answers(spelling.variants(docs, limit)) == want
    assert want["abcdef"][:2] == ("abcdefg", "abcdefgh") and sum(x[0] is not None for x in want.values()) > 3


def test_a_dictionary_of_any_letters_and_hot_runs(spark):
    """Words beyond Latin-1, and a run that all words share, divided to the end."""
    rng = random.Random(5)
    words = {"common" + "".join(rng.choice("xyzвг中") for _ in range(5)) + "tail" for _ in range(600)} | {"日本語の単語", "日本語単語", "日本語の単吾"}
    frame = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long")
    found = defaultdict(list)
    for r in spelling.near_words(frame, Scratch(spark, "test"), limit=8).collect():
        found[r["word"]].append(r["near"])
    near = near_of(words)
    assert {w: sorted(x) for w, x in found.items()} == {w: sorted(x) for w, x in near.items() if x}


def test_runs_are_bounded(spark):
    words = [("a" * k + "bcdefghijk", 1) for k in range(5, 60)] + [(f"shared{x}{y}{z}end", 1) for x in "abcdefgh" for y in "abcdefgh" for z in "abcdefgh"]
    rows = spelling.blocks(spark.createDataFrame(words, "word string, n long"), Scratch(spark, "test"), limit=16)
    sizes = rows.filter("size - front - back > 1").groupBy("size", "front", "back", "shared").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 16


def test_no_words(spark):
    assert spelling.variants(documents(spark, [])).count() == 0
    assert spelling.variants(documents(spark, [None, "", "short words only"])).count() == 0
