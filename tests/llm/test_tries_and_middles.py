"""Conversation trie, embedding near-duplicates and fill-in-middle against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import op11_trie as op11
from gleaner.llm import op12_collisions as op12
from gleaner.llm import op13_fim as op13

#: Columns whose names the operators use themselves.
CLASH = {"part": 1, "path": "x", "conv": 2, "depth": 3, "id": 4, "copied": 5, "n": 6, "cut": "y", "form": "z", "h1": 7, "rank": 8}
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


# conversations


def talk():
    r = random.Random(11)
    rows = []
    for c in [*range(0, 12), *range(100, 130), 205, 1000, 1001, -3, -100]:
        for turn in range(r.randint(1, 9)):
            said = r.choice(["hi", "hello there", "é日本", ""]) if turn < 3 else f"{r.randint(0, 2)}" * turn
            rows.append((c, turn, r.choice(["user", "assistant"]) if turn else "user", said))
    rows += [(300 + k, t, "user", x) for k in range(40) for t, x in enumerate(["same", "all", "over"])]  # copies
    rows += [(400, k, None, f"long {k // 7}") for k in range(500)]  # one long conversation, and one that leaves it late
    rows += [(500, k, None, f"long {k // 7}" if k < 450 else None) for k in range(500)]
    rows += [(402, None, "b", "first"), (402, 1, None, None), (402, 1, "a", "tie"), (402, 1, "a", "tie"), (None, 0, "user", "nobody's")]
    r.shuffle(rows)
    return rows


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    members = defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = int(math.fmod(c, 100))
        whole[c] = tuple(own.get(c - base, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if whole[c] == p)
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], sha(ends)))
    return out, len(members)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie(spark):
    rows = talk()
    want, nodes = trie_by_hand(rows)
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(7)
    got = op11.trie(df).collect()
    assert len(got) == nodes
    assert {tuple(r[c] for c in COLUMNS) for r in got} == want
    # preorder: subtrees are intervals, positions without gaps
    at = {(r["depth"], r["conv_id"]): (r["position"], r["subtree_end"]) for r in got}
    assert sorted(p for p, _ in at.values()) == list(range(1, nodes + 1))
    for r in got:
        if r["depth"]:
            a, z = at[r["depth"] - 1, r["parent_conv_id"]]
            assert a < r["position"] <= r["subtree_end"] <= z


def test_trie_without_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op11.trie(empty).count() == 0


def test_trie_of_one_row(spark):
    for c in (100, 105):  # 105: crc32 % 6 decides whether its turn stays
        rows = [(c, 0, None, "é")]
        got = op11.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
        assert {tuple(r[k] for k in COLUMNS) for r in got} == trie_by_hand(rows)[0]


def test_ids_that_end_at_one_node_are_hashed_whatever_the_pieces(spark, monkeypatch):
    monkeypatch.setattr(op11, "PIECE", 3)
    enders = spark.range(1000).select(F.col("id").alias("conv"), F.lit(1).cast("long").alias("depth"), F.lit(-5).cast("long").alias("x1"), (F.col("id") % 3).alias("x2")).repartition(5)
    got = {r["x2"]: r["ends_sha256"] for r in op11.ending(enders, 6).collect()}
    assert got == {k: sha(",".join(str(c) for c in range(k, 1000, 3))) for k in range(3)}


# embeddings


def cloud(seed=5, n=700, dims=24):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, dims))
    out = [(k, base[k].tolist(), int(k % 2)) for k in range(n)]
    at = n
    for k in range(0, n, 3):  # near copies at all cosines from 0.96 to 1
        for noise in (0.02, 0.1, 0.16, 0.2, 0.25):
            out.append((at, (base[k] + r.standard_normal(dims) * noise).tolist(), int(k % 2)))
            at += 1
    dense = r.standard_normal(dims)
    out += [(at + k, (dense + r.standard_normal(dims) * 0.02).tolist(), 1) for k in range(300)]  # cannot be cut
    at += 300
    out += [(at + k, dense.tolist(), 1) for k in range(200)]  # copies
    at += 200
    out += [(at, None, 1), (at + 1, [], 1), (at + 2, [0.0] * dims, 1), (at + 3, [float("nan")] * dims, 1), (at + 4, [None] * dims, 1), (at + 5, [float("inf")] * dims, 0), (at + 6, dense.tolist(), None), (None, dense.tolist(), 1), (None, None, None), (at + 7, [1e300] * 3, 1), (at + 8, [1e300, 1e300, 1.1e300], 1), out[0], out[0]]
    return out


def near_by_hand(rows, threshold):
    able = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {}
    for k in able:
        x = np.array(rows[k][1]) / np.abs(rows[k][1]).max()
        unit[k] = x / math.sqrt(x @ x)
    links = set()
    for label in {rows[k][2] for k in able}:
        for dims in {len(unit[k]) for k in able}:
            own = [k for k in able if rows[k][2] == label and len(unit[k]) == dims]
            if own:
                m = np.stack([unit[k] for k in own])
                i, j = np.nonzero(m @ m.T >= threshold)
                links |= {(own[a], own[b]) for a, b in zip(i, j, strict=True) if a != b}
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            least[root(k)] = min(vec_id, least.get(root(k), vec_id))
    n = defaultdict(int)
    for a, _ in links:
        n[a] += 1
    return [(r[0], n[k], least.get(root(k))) for k, r in enumerate(rows)]


@pytest.mark.parametrize("block", [4096, 150])
def test_near_vectors(spark, block):
    rows = cloud()
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).repartition(5)
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in op12.near(df, block=block, levels=6).collect()]
    want = near_by_hand(rows, 0.98)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[0] for r in got] == [r[0] for r in want]
    missed = sum(w[1] - g[1] for g, w in zip(got, want, strict=True))
    assert 0 <= missed <= 0.002 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g != w for g, w in zip(got, want, strict=True)) <= 0.01 * len(rows)
    if block == 4096:
        assert got == want


def test_near_vectors_of_an_empty_table(spark):
    assert op12.near(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_calibration():
    width, count = op12.calibrated(0.98, 0.999, 32)
    r = np.random.default_rng(3)
    a = r.standard_normal((4000, 40))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = r.standard_normal((4000, 40))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * side
    to = op12.directions(40, 1, 32)
    hits = (np.abs(a @ to - b @ to) <= width).sum(1)
    assert (hits >= count).mean() > 0.99
    assert (np.diag(op12.collisions(a[:200] @ to, b[:200] @ to, width)) == hits[:200]).all()


# fill-in-middle

TEXTS = [None, "", "a", "?", "ab cd", "éa日b", "x<P>y", "<S", "<P<P", "P>", "<<S>>", "a\nb\tc\r\n", "Ünïcödé words AND Ascii", "<M", "\U0001f600z", "a" * 1000, " " * 50, "don't stop; 12 ab34cd", "word " * 40000, "ſK", "<P>"]


def middle_by_hand(doc_id, text):
    text = text or ""
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choice("abZ<>PSM é\n.") for _ in range(r.randint(0, 40))) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (3, "ab cd"), (3, "ab cd")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    made = op13.transformed(df)
    made = made.withColumn("restored", op13.restored(F.col("output"), F.col("form")))
    got = [(x["doc_id"], (x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]), x["restored"]) for x in made.collect()]
    want = [(d, middle_by_hand(d, t), t or "") for d, t in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {x[1][1] for x in got} == {"plain", "psm", "spm"}
    assert op13.transformed(df.limit(0)).count() == 0


def test_other_sentinels():
    scanner = op13.Scanner(("<|pre|>", "[S]", "aab"))
    for text in ("x<|pre|>", "a[S]", "aaab", "aab"):
        assert scanner.events(text)[2]
    for text in ("<|pre|", "", "[s]", "aa b"):
        begins, ends, marked = scanner.events(text)
        assert not marked
        assert [(m.start(), m.end()) for m in re.finditer("[A-Za-z]+", text)] == list(zip(begins.tolist(), ends.tolist(), strict=True))
    with pytest.raises(ValueError):
        op13.Scanner(("é",))
