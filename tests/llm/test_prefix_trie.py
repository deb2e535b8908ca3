"""The trie of prefixes against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from graphloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = set()

    def walk(p):
        leaves, saved = (0, 0) if children[p] else (1, 0)
        saved += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        for q in children[p]:
            x, y = walk(q)
            leaves, saved = leaves + x, saved + y
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves, saved, digest))
        return leaves, saved

    if own:
        walk(())
    return out


def answers(df):
    return [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]


def tables():
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "héllo wörld"])) for c in [*range(0, 40), *range(100, 160), *range(305, 320)] for t in range(rng.randint(1, 7))]
    rows += [(200, t, "user", f"turn {t % 3}") for t in range(67)] + [(201, t, "user", f"turn {t % 3}") for t in range(64)]
    rows += [(400 + k, t, "user", "same") for k in range(30) for t in range(4)]
    rows += [(500, None, None, "no turn"), (500, 1, "user", None), (500, 1, None, None), (500, 9, "", ""), (501, None, None, None), (-3, 0, "user", "x"), (-203, 0, "user", "y"), (None, 1, "user", "nobody's")]
    rows += [(502, 3, "user", "twice"), (502, 3, "user", "twice")]
    return {"mixed": rows, "one": [(7, 0, "user", "alone")], "nobody": [(None, None, None, None)], "empty": []}


@pytest.mark.parametrize("name", ["mixed", "one", "nobody", "empty"])
def test_nodes_match_brute_force(spark, name):
    rows = tables()[name]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for clash in ("conv", "at", "depth", "node", "name", "n", "k1", "size"):
        turns = turns.selectExpr("*", f"cast(null AS string) AS {clash}")
    out = answers(prefix_trie.trie(turns))
    assert len(out) == len(set(out)) and set(out) == brute(rows)


def test_many_members_end_in_one_node(spark, monkeypatch):
    """Ids of a node in several parts are digested in numeric order."""
    monkeypatch.setattr(prefix_trie, "IDS", 8)
    rows = [(c, 0, "user", "hi") for c in range(5, 3000, 7)]
    assert set(answers(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(6)))) == brute(rows)
