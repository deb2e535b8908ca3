"""Small tables of documents with the cases that each operator has to bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", id long, cls long, sh long, kind string, score double, _id long, doc long, at int, base string, row_hash long"


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "in", "re", "ed", "ly"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts(seed=7):
    rng = random.Random(seed)
    out = [None, "", "  \n\t ", "one", "two words", "A b C d", "a B c D", "x " * 30000, "y" * 120000]
    base = words(rng, 90)
    out += [base, base, base.upper()]
    for k in range(12):  # near copies, some over and some under the threshold
        w = base.split()
        for _ in range(1 + k % 5):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        out.append(" ".join(w))
    passage = words(rng, 60)
    out += [words(rng, 40) + " " + passage + " " + words(rng, 30) for _ in range(4)]
    out += [words(rng, rng.randint(5, 150)) for _ in range(20)]
    return out


def documents(spark, rows=None, clashing=False):
    """rows: texts, or None for the standard ones. With clashing, columns named as operators name theirs inside."""
    rows = texts() if rows is None else rows
    data = [(k, t, "en", "s0" if k % 3 else None, None) for k, t in enumerate(rows)]
    data += [(None, "no id at all here", None, None, None), (3, rows[3] if len(rows) > 3 else None, None, None, None)] if rows else []
    frame = spark.createDataFrame(data, SCHEMA)
    if clashing:
        for part in CLASHING.strip(", ").split(", "):
            name, kind = part.split()
            frame = frame.selectExpr("*", f"cast(null AS {kind}) AS {name}")
    return frame
