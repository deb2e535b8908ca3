"""Near copies of embeddings against all pairs."""

import numpy as np
import pytest

from graphloom.llm import embedding_dedup as ed
from graphloom.llm.common import hash_bounds


def brute(rows, threshold=0.95):
    good = [(i, x) for i, (_, x) in enumerate(rows) if x and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(good):
        for j, y in good[a + 1 :]:
            if len(x) == len(y) and (ed.unit(np.array([x])) @ ed.unit(np.array([y])).T)[0, 0] >= threshold:
                n[i] += 1
                n[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (vec, _) in enumerate(rows):
        if vec is not None:
            least[find(k)] = min(least.get(find(k), vec), vec)
    return sorted(((-1 if v is None else v), n[k], -1 if find(k) not in least else least[find(k)], v is not None and least[find(k)] == v) for k, (v, _) in enumerate(rows))


def answers(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in df.collect())


def clusters(rng, dim, sizes, spread, alone=200):
    out = []
    for size in sizes:
        head = ed.unit(rng.standard_normal((1, dim)))
        out += (head + rng.standard_normal((size, dim)) * spread / np.sqrt(dim)).tolist()
    return out + rng.standard_normal((alone, dim)).tolist()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_and_components(spark, kind):
    """Crowds within a ball, pairs, and vectors that are none."""
    rng = np.random.default_rng(4)
    x = clusters(rng, 24, [150, 60, 2, 2, 3], 0.1)
    x += [x[0]] * 40 + [None, [], [0.0] * 24, [float("nan")] * 24, [None, *x[0][1:]], [float("inf"), *x[0][1:]], x[0][:12], x[0][:12]]
    if kind == "float":
        x = [None if v is None else [None if y is None else float(np.float32(y)) for y in v] for v in x]
    rows = [(int(k * 7 % 1009), v) for k, v in enumerate(x)] + [(None, x[1]), (None, x[0][:3]), (3, x[2]), (3, x[2])]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    for clash in ("row", "item", "v", "n", "code", "component"):
        frame = frame.selectExpr("*", f"cast(null AS string) AS {clash}")
    assert answers(ed.near_copies(frame)) == brute(rows)


def test_crowds_that_are_wider_than_a_ball(spark):
    """Balls next to each other whose members link in part: compared in blocks. Recall of links over 0.9, none too much."""
    rng = np.random.default_rng(8)
    x = clusters(rng, 16, [300, 200], 0.3, 50)
    rows = list(enumerate(x))
    got, want = answers(ed.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), brute(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want) > 0
    assert sum(g[2] == w[2] for g, w in zip(got, want, strict=True)) >= 0.9 * len(rows)


def test_recall_at_the_threshold(spark):
    """Pairs just over the threshold, the hardest ones."""
    rng = np.random.default_rng(9)
    x = ed.unit(rng.standard_normal((600, 48)))
    side = rng.standard_normal(x.shape)
    side = ed.unit(side - (side * x).sum(1, keepdims=True) * x)
    angle = np.arccos(0.951)
    rows = list(enumerate(np.vstack([x, np.cos(angle) * x + np.sin(angle) * side]).tolist()))
    found = answers(ed.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert sum(n for _, n, _, _ in found) >= 0.9 * 1200


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ed.near_copies(frame).count() == 0
    assert answers(ed.near_copies(spark.createDataFrame([(1, None), (None, [0.0])], "vec_id long, embedding array<float>"))) == [(-1, 0, -1, False), (1, 0, 1, True)]


@pytest.mark.parametrize("limit", [1, 20, 700])
def test_samples_of_any_bound(spark, limit):
    """A language a thousand times the bound, a rare one, and a row that repeats; also where one range holds all hashes."""
    rows = spark.range(30_000).selectExpr("'en' AS lang", "xxhash64(id) AS h").unionByName(spark.range(9).selectExpr("'de' AS lang", "xxhash64(id, 5) AS h"))
    rows = rows.unionByName(spark.range(5000).selectExpr("'fr' AS lang", "(77L << 52) + id AS h")).unionByName(spark.range(2000).selectExpr("'en' AS lang", "xxhash64(3L) AS h"))
    bounds = hash_bounds(rows, "h", limit, by="lang")
    assert set(bounds) == {"en", "de", "fr"} if limit > 1 else {"en", "fr"} <= set(bounds)
    for lang, bound in bounds.items():
        n = rows.filter((rows["lang"] == lang) & (rows["h"] <= bound)).select("h").distinct().count()
        assert n <= limit and n >= min(limit / 2, {"en": 30_000, "de": 9, "fr": 5000}[lang])
