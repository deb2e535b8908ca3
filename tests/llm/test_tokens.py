"""Encoding, decoding and counting against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import bpe

from .cases import documents

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    out = ["", " ", "\n", " lead", "trail ", "a  b\n\n c", "<|endoftext|> x<|startoftext|>y", "ΑΣ ΣΑΣ İstanbul", "é é", "a\x1cb \x1d c\x85d", "don't I'LL", "12345 ½²", "x　y", "😀👍🏽", "ab" * 3000]
    return out + ["".join(rng.choice("ab c  \n\t'sdtéß1²Ⅷ.,!?<|endoftext|> \x1f́Σ😀中文") for _ in range(rng.randint(0, 40))) for _ in range(1500)]


def test_ids_and_decoded_text(odd):
    mine, theirs = bpe.Encoder(bpe.Vocabulary(open(WORDS, encoding="utf-8").read()), limit=50), Tokenizer.from_file(WORDS)
    for text in odd:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids
        assert mine.row(text) == (len(ids), " ".join(map(str, ids)), theirs.decode(ids, skip_special_tokens=False))


def test_byte_vocabulary_round_trip(odd):
    mine = bpe.Encoder(bpe.Vocabulary(open(BYTES, encoding="utf-8").read()))
    for text in odd[:300]:
        assert mine.decode(mine.encode(text)) == text


def test_counts(odd):
    mine, theirs = bpe.Counter(bpe.Vocabulary(open(BYTES, encoding="utf-8").read()), limit=50), Tokenizer.from_file(BYTES)
    for text in odd:
        assert mine.count(text) == len(theirs.encode(text, add_special_tokens=False).ids)


def test_letters_of_all_versions_of_unicode():
    places = [c for c in range(1, 0x110000, 3) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 < c < 0xAC00 or 0xF900 < c < 0x20000 or c % 61 == 0)]
    places += [ord(c) for c in "\u0558\u1c89\ua7cb\ua7dc\U00010d50\U00016ea0\U0001246f\U000323b0"]
    for path in (WORDS, BYTES):
        mine, theirs = bpe.Encoder(bpe.Vocabulary(open(path, encoding="utf-8").read())), Tokenizer.from_file(path)
        texts = [f"a{chr(c)}b {chr(c)}1" for c in places]
        assert [mine.encode(t) for t in texts] == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(concat(encode('some words ', 'UTF-8'), X'FFFE') AS string) AS text")
    theirs = Tokenizer.from_file(WORDS).encode("some words \ufffd\ufffd", add_special_tokens=False).ids
    assert bpe.encode_texts(docs, WORDS).first()["ids"] == " ".join(map(str, theirs))
    row = bpe.count_tokens(docs, BYTES).first()
    assert row["n_bytes"] == 13 and row["n_tokens"] == len(Tokenizer.from_file(BYTES).encode("some words \ufffd\ufffd", add_special_tokens=False).ids)


def test_tree_and_heap_merge_alike():
    rng = random.Random(2)
    merges = {(a, b): (rng.randrange(10**6), 10 + 10 * a + b) for a in range(10) for b in range(10)}
    for n in (0, 1, 2, 3, 40, 700):
        ids = [rng.randrange(10) for _ in range(n)]
        plain = list(ids)
        while True:
            ranks = [(merges[p][0], k) for k, p in enumerate(zip(plain, plain[1:], strict=False)) if p in merges]
            if not ranks:
                break
            k = min(ranks)[1]
            plain[k : k + 2] = [merges[plain[k], plain[k + 1]][1]]
        assert bpe.merge_by_tree(ids, merges) == plain
        assert bpe.count_by_heap(ids, merges) == len(plain)


def test_queries_bear_odd_tables(spark):
    docs = documents(spark, clashing=True)
    theirs = Tokenizer.from_file(BYTES)
    rows = {(r["doc_id"], r["text"]): r for r in docs.collect()}
    counts = bpe.count_tokens(docs, BYTES).collect()
    assert len(counts) == docs.count()
    want = sorted((str(i), len((t or "").encode()), len(theirs.encode(t or "", add_special_tokens=False).ids)) for (i, t) in [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in counts) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in counts)
    full = {str(r["doc_id"]): r for r in bpe.encode_texts(docs, WORDS).collect()}
    for r in bpe.encode_digests(docs, WORDS).collect():
        assert r["ids_sha256"] == hashlib.sha256(full[str(r["doc_id"])]["ids"].encode()).hexdigest()
    assert bpe.count_tokens(documents(spark, rows=[]), BYTES).count() == 0 and rows
