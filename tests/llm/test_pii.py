"""Base spans against regular expressions in Python; added spans and redaction on planted cases."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from graphloom.llm import pii

from .cases import documents

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PARTS = ["a@b.c", "x_y@z", "@", "1.2.3.4", ".5", "256", "+1 (555) 010-9999", "4111 1111 1111 1111", "4111111111111111", "-", " ", "é", "😀", "+", "12", "b", "00.0", "\n", ".x-", "5500-0000 0000-0004", "_"]


def luhn(digits):
    return sum(int(x) if k % 2 == 0 else (int(x) * 2 - 9 if int(x) > 4 else int(x) * 2) for k, x in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for j, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), j, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_base_spans(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(800)] + ["1" * 60000, "a" * 60000 + "@", "1.1.1.1 " * 3000, "1 " * 9000, None, "", ""]
    docs = documents(spark, rows, clashing=True)
    want = sorted((str(r["doc_id"]), hashlib.sha256(brute(r["text"]).encode()).hexdigest()) for r in docs.collect())
    out = pii.report(docs).collect()
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in out) == want
    total = sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in out)
    assert total == sum(len(brute(r["text"]).split(",")) if brute(r["text"]) else 0 for r in docs.collect())


def test_contexts_lead_to_unseen_identifiers(spark):
    rows = [f"lines before password={hashlib.md5(str(k).encode()).hexdigest()[:18]}a1 and after" for k in range(12)] + ["then password=Summer2024x is new", "page 12345678 of the book", "chapter 87654321 of the book", "mail me at jo@ex.org now"]
    out = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert out[12] == "secret:14:25" and out[13] == out[14] == "" and out[15] == "email:11:20"
    assert all(s.startswith("secret:") for k, s in out.items() if k < 12)


def test_redaction_keeps_all_else(spark):
    docs = spark.createDataFrame([(1, "a jo@ex.org b 1.2.3.4", "x"), (1, "a jo@ex.org b 1.2.3.4", "y"), (2, None, "z"), (3, "plain", None), (None, "+1 555 010 9999", "w")], "doc_id long, text string, _spans string")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"]), str(r["_spans"])) for r in out.collect()) == sorted([("1", "a [EMAIL] b [IP]", "x"), ("1", "a [EMAIL] b [IP]", "y"), ("2", "None", "z"), ("3", "plain", "None"), ("None", "[PHONE]", "w")])
    assert pii.report(docs.filter(F.lit(False))).count() == 0


def test_long_cues_and_many_finds(spark):
    word = "k" * 300
    rows = [f"say {word} = {hashlib.md5(str(k).encode()).hexdigest()[:18]}a1 end" for k in range(8)] + [f"say {word} = Summer2024x end", f"say {'q' * 300} = Summer2024x end"]
    out = {r["doc_id"]: r["n_added"] for r in pii.report(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert out[8] == 1 and out[9] == 0
    text = "é 1.2.3.4 jo@ex.org," * 700
    docs = spark.createDataFrame([(1, text), (2, "a@b.c" * 300), (3, "no finds 1")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got[1] == "é [IP] [EMAIL]," * 700 and got[3] == "no finds 1"
    want = re.sub(PATTERNS["email"], "[EMAIL]", "a@b.c" * 300)
    assert got[2] == want
    row = next(r for r in pii.report(docs).collect() if r["doc_id"] == 1)
    assert row["base_sha256"] == hashlib.sha256(brute(text).encode()).hexdigest() and row["n_spans"] == 1400


def test_spans_that_overlap_leave_nothing_behind(spark):
    spans = "array(named_struct('s', 2, 'e', 6, 'kind', 'ip', 'v', '', 'cue', ''), named_struct('s', 4, 'e', 9, 'kind', 'card', 'v', '', 'cue', ''), named_struct('s', 9, 'e', 10, 'kind', 'email', 'v', '', 'cue', ''))"
    assert spark.range(1).select(pii.masked(F.lit("abcdefghijkl"), F.expr(spans))).first()[0] == "ab[IP][EMAIL]kl"
