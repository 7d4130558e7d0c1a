"""Prefix trie, nearest neighbours and conversation repair against plain versions, with nulls, ties, copies and hot keys."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain_repair  # noqa: E402

from hashmark.llm import neighbours, repair, trie  # noqa: E402
from hashmark.llm.hot import join_groups  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string, c long, k long, block long, d long, f1 string, pos int"


def _conversations():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "s"]
    texts = ["Yes.", "No!", "why", " \t\n", "", None, "A b c.", "A b c. ", "a  b", "ünï cödé?", "x" * 30_000 + ".", "two\nlines."]
    rows = []
    for conv in list(range(0, 64)) + [-1, -20, -19, 1_000_003]:
        for turn in range(rng.randrange(0, 9)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.75 else rng.choice(roles)
            rows.append((conv, None if rng.random() < 0.04 else turn + (2 if rng.random() < 0.05 else 0), role, rng.choice(texts)))
    rows += [(7, 1, "user", "same."), (7, 1, "user", "same."), (7, 1, "assistant", "tie."), (None, 0, "user", "no id."), (None, None, None, None)]
    for conv in range(100, 140):  # copies
        rows += [(conv, t, "user", f"turn {t}.") for t in range(5 + conv % 3)]
    for t in range(600):  # one conversation with a third of all rows
        rows.append((40, 10 + t // 2, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Again.", f"turn {t}", f"turn {t}.", ""])))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return _conversations()


@pytest.fixture(scope="module")
def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "f", 5) for r in rows], TURNS).repartition(5)


def _plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    members, built = defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    out = []

    def visit(path, parent):
        """Leaves and saved words of the subtree."""
        m = sorted(members[path])
        saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        below = [visit(child, m[0]) for child in children[path]]
        leaves = sum(x for x, _ in below) if below else 1
        saved += sum(x for _, x in below)
        ends = ",".join(str(c) for c in m if len(built[c]) == len(path))
        out.append((m[0], len(path), parent, len(m), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if own:
        sys.setrecursionlimit(10_000)
        visit((), None)
    return sorted(out, key=str)


CONTRACT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _trie(turns, **more):
    nodes = trie.prefix_trie(turns, lambda c: c - c % 20, lambda c: F.crc32(c.cast("string").cast("binary")) % 4, 3, **more)
    return nodes, sorted((tuple(r) for r in nodes.select(CONTRACT).collect()), key=str)


def test_trie_against_plain(turns, rows, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_IDS", 3)
    assert _trie(turns)[1] == _plain_trie(rows)


def test_trie_after_a_collision(turns, rows):
    """A field of 3 elements mixes nodes up; the check sees it and the next attempt has the full field."""
    tried = []
    _, got = _trie(turns.filter("conv_id <> 40"), field=lambda attempt: tried.append(attempt) or (3 if attempt == 0 else trie.FIELD))
    assert got == _plain_trie([r for r in rows if r[0] != 40]) and tried[:2] == [0, 1]
    with pytest.raises(ValueError, match="collided"):
        _trie(turns, field=lambda attempt: 3)


def test_trie_stored_references(turns, rows):
    """``last_conv`` and ``last_turn`` name a stored turn that is as deep in the node's smallest member."""
    nodes, _ = _trie(turns)
    for r in nodes.select("conv_id", "depth", "last_conv", "last_turn").collect():
        if r.depth == 0:
            assert r.last_conv is None and r.last_turn is None
        elif r.last_conv == r.conv_id:
            assert r.last_turn == r.depth or r.last_turn > zlib.crc32(str(r.conv_id).encode()) % 4
        else:
            assert r.last_turn == r.depth <= 3


def test_trie_of_nothing(turns):
    assert _trie(turns.limit(0))[1] == []
    assert _trie(turns.filter("conv_id IS NULL"))[1] == []


def test_repair_against_plain(turns, rows):
    by = defaultdict(list)
    for r in plain_repair.damage(rows):
        by[r[0]].append(r)
    want = sorted(((c, *plain_repair.repaired(v)) for c, v in by.items()), key=str)
    for block_rows, block_bytes in ((1024, 8 << 20), (7, 8 << 20), (1, 100), (50, 20_000)):
        found = repair.repair(repair.damaged(turns), block_rows, block_bytes)
        assert sorted((tuple(r) for r in found.collect()), key=str) == want, (block_rows, block_bytes)


def test_repair_query_gives_every_conversation(spark, rows, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    gone = next(k for k in range(5000, 6000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    spark.createDataFrame([*rows, (gone, 1, "user", "dropped.")], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r[0]: tuple(r)[1:] for r in repair.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(found) == {r[0] for r in rows} | {gone}
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert repair.op13_conversation_repair(spark, f"{tmp_path}/none").count() == 0


def test_repair_takes_the_cheapest_then_least_audit():
    for n in range(400):
        rng = random.Random(n)
        rows = [(1, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", f"{t}."])) for t in range(rng.randrange(0, 9))]
        want = plain_repair.repaired(rows)
        rows.sort(key=plain_repair.order)
        seen, edits = set(), []
        for _, _, role, text in rows:
            edits.append((role[:1], repair.fault_of(text, (role, text) in seen)))
            seen.add((role, text))
        assert repair._cheapest(repair.parse(edits)) == want[5:7]


WIDE = "vec_id long, embedding array<float>, label int, id long, v string, class string, q int, r int, c int, width int, score string, query long"


def _vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 8))
    rows = [(i, [float(x) for x in base[i % 6] + 0.3 * rng.standard_normal(8)]) for i in range(300)]
    rows += [(1000 + i, [float(x) for x in base[0]]) for i in range(300)]  # a third of all rows is one vector
    rows += [(2000 + i, [float(x) * 3 for x in base[0] + 1e-5 * rng.standard_normal(8)]) for i in range(120)]  # nearly so
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 4.0]), (3050, [1.0, -1.0])]  # other lengths
    rows += [(50, None), (100, []), (150, [0.0] * 8), (200, [float("nan")] + [1.0] * 7), (250, [None] + [1.0] * 7), (4000, [float("inf")] * 8)]
    rows += [(None, [1.0] * 8), rows[0], rows[0], (50, rows[7][1]), (5000, [1e-30] * 8), (5050, [3e38] * 8)]
    return rows


def _plain_nearest(rows, every, k):
    rows = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]

    def dot(a, b):
        total = 0.0
        for x, y in zip(a.tolist(), b.tolist()):
            total += x * y
        return total

    norms = [math.sqrt(dot(v, v)) for _, v in rows]
    out = []
    for n, (i, v) in enumerate(rows):
        if i % every == 0:
            scored = [(-(dot(v, w) / (norms[n] * norms[m])), j) for m, (j, w) in enumerate(rows) if m != n and len(w) == len(v)]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:k], start=1)]
    return sorted(out)


def _found(frame):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect())


def test_nearest_against_plain(spark, monkeypatch):
    rows = _vectors()
    frame = spark.createDataFrame([(i, v, 1, 2, "v", "c", 3, 4, 5, 6, "s", 7) for i, v in rows], WIDE).repartition(4)
    want = _plain_nearest(rows, 50, 5)
    assert _found(neighbours.nearest(frame, lambda i: i % 50 == 0)) == want
    monkeypatch.setattr(neighbours, "LEAST_ROWS", 20)
    monkeypatch.setattr(neighbours, "TILE", 16)
    monkeypatch.setattr(neighbours, "QUERY_TILE", 4)
    assert _found(neighbours.nearest(frame, lambda i: i % 50 == 0, block_bytes=2000)) == want
    assert _found(neighbours.nearest(frame, lambda i: i % 2 == 0, k=9)) == _plain_nearest(rows, 2, 9)


def test_nearest_of_few(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert _found(neighbours.nearest(frame, lambda i: i % 50 == 0)) == [(0, 1, 1, 0.0)]
    for few in (frame.limit(0), frame.filter("vec_id = 1"), frame.filter("vec_id = 0")):
        assert _found(neighbours.nearest(few, lambda i: i % 50 == 0)) == []


def test_bound_of_the_tiles_holds():
    rng = np.random.default_rng(1)
    for width in (1, 3, 64, 1500):
        a, b = (m / np.linalg.norm(m, axis=1)[:, None] for m in (rng.standard_normal((40, width)) ** 3, rng.standard_normal((50, width))))
        (ca, sa, _, ea), (cb, sb, nb, eb) = neighbours.quantised(a), neighbours.quantised(b)
        exact = ca.astype(np.int64) @ cb.astype(np.int64).T
        assert (neighbours.products(ca, cb) == exact).all()
        bound = ea[:, None] * nb[None] + eb[None]
        assert (np.abs(a @ b.T - exact * sa[:, None] * sb[None]) <= bound + 1e-12).all()


def test_wide_tiles_keep_every_pair():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((60, 3000))

    def table(rows, **more):
        return pa.table({"class": pa.array(range(len(rows))), "v": pa.array(rows.tolist(), pa.list_(pa.float64())), **more})

    got = neighbours.block_search(table(v), table(v, ids=pa.array([[i] for i in range(60)])), 5).to_pylist()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(60):
        assert {r["id"] for r in got if r["query"] == q} == set(np.argsort(-(unit @ unit[q]))[:6].tolist())


def test_join_with_hot_groups(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7001).alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("key <> 5")
    joined = join_groups(rows, groups, ["key"], "n")
    plain = rows.join(groups, "key", "left").select("id", "key", "n", "least")
    assert joined.columns == plain.columns and joined.exceptAll(plain).count() == 0 and plain.exceptAll(joined).count() == 0
