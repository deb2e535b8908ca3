"""The corpus pipeline against its stages done by hand on a small table."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline

from .cases import words
from .test_filters import ITEM
from .test_near_copies import brute


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(21)
    docs, labels = [], []
    for k in range(600):
        text = words(rng, rng.randint(30, 60))
        if k % 7 == 0:
            text += " idiot scum grblox grbloy you"
        docs.append((k, text, "en", "s", len(text)))
        labels.append((k, 1, int(k % 7 == 0)))
    docs += [(1001, docs[1][1], "en", "s", 1), (1002, docs[2][1] + " tail", "en", "s", 1), (1003, "Now: " + ITEM, "en", "s", 1), (1004, "mail jo@ex.org and " + words(rng, 30), "en", "s", 1)]
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    write("labels", labels, "doc_id long, quality int, toxic int")
    write("benchmark", [(1, ITEM)], "item_id long, text string")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    texts = {d[0]: d[1] for d in docs}
    stay = {i for i, _ in texts.items() if not (i < 600 and i % 7 == 0)}
    least = brute([(i, texts[i]) for i in sorted(stay)])
    want = {i for i in stay if least[i] == i} - {1003}
    assert len(want ^ set(out)) <= 3 and not {1001, 1002, 1003} & set(out)  # the model may miss a few of its 600 rows
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i in (1004, 1, 2):
        ids = tokenizer.encode(texts[i].replace("jo@ex.org", "[EMAIL]"), add_special_tokens=False).ids
        assert out[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_nulls_empty_texts_and_further_columns(spark, tmp_path):
    rng = random.Random(22)
    base = words(rng, 40)
    docs = [(1, base, "x"), (2, base + " tail", "y"), (None, None, None), (3, "", None), (4, None, "z"), (5, "x " * 30000, None), (None, words(rng, 30), None), (1, words(rng, 35), None), (6, "Now: " + ITEM, None)]
    schema = "doc_id long, text string, _row string"
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    write("documents", docs, schema)
    write("labels", [(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    write("benchmark", [(None, ITEM), (1, None)], "item_id long, text string")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "1", "3", "4", "5", "None", "None"]
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["ids_sha256"] == empty and r["n_tokens"] == 0 for r in out if r["doc_id"] in (3, 4))
    for name, kind in (("documents", schema), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        write(name, [], kind)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "pii", "encode"]
