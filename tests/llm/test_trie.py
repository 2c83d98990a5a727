"""Lists and tries against walks in plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from doccensus.llm import list_ranking, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node int, pos int, c int, depth int"
EXTRA = (0, 0, 0, 0)


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_suffix_sums(spark, monkeypatch, block):
    """Several lists of random names, one long enough to pass many blocks."""
    monkeypatch.setattr(list_ranking, "BLOCK", block)
    rng = random.Random(4)
    names = [(rng.randrange(-50, 50), i) for i in range(1200)]
    rng.shuffle(names)
    lists, want, rows = [names[:900], names[900:901], names[901:]], {}, []
    for one in lists:
        total = 0
        for at, name in reversed(list(enumerate(one))):
            weight = rng.randrange(100)
            total += weight
            want[name] = (len(one) - at, total)
            rows.append((*name, *(one[at + 1] if at + 1 < len(one) else (0, -1)), 1, weight))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "c long, at long, nc long, nat long, one long, w long").repartition(6)
    got = {(r["c"], r["at"]): (r["one"], r["w"]) for r in list_ranking.suffix_sums(table, ["one", "w"]).collect()}
    assert got == want


def test_cycle_is_an_error():
    with pytest.raises(ValueError, match="cycle"):
        list_ranking.jump(np.array([1, 2, 0]), np.ones((3, 1)))


def _turns(rows):
    told = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    by = {}
    for r in rows:
        if r[0] is not None:
            by.setdefault(r[0], []).append(r)
    return {c: [(r[2] or "", r[3] or "") for r in sorted(v, key=lambda r: (r[1] is not None, r[1] or 0, told(r)))] for c, v in by.items()}


def _brute(turns, head):
    rebuilt = {c: (turns.get(int(c - np.fmod(c, 5)), [])[: head(c)] + t[head(c) :]) for c, t in turns.items()}
    members = {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = lambda n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n]
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(rebuilt[c]) == len(node)))
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids(node)), sum(not kids(m) for m in below), saved,
                    hashlib.sha256(ends.encode()).hexdigest(), len(below)))
    return sorted(out, key=str)


def _rows(seed, hot=False):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, 23), *([40] if seed else [])]:
        for t in range(rng.randrange(1, 12)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]) if t > 2 else "user", rng.choice(["a", "é", "", None]) if t > 1 else "same", *EXTRA))
    rows += [rows[3], rows[3], (None, 1, "user", "lost", *EXTRA)]
    if hot:
        rows += [(100, t, "user", f"turn {t % 7}", *EXTRA) for t in range(200)]
    return rows


@pytest.mark.parametrize("seed, piece", [(0, 256), (1, 2)])
def test_trie_of_grafted_conversations(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = _rows(seed, hot=True)
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))
    conv = F.col("conv_id")
    got = prefix_trie.prefix_trie(prefix_trie.graft(turns, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8))
    want = _brute(_turns(rows), lambda c: zlib.crc32(str(c).encode()) % 9)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_copies_and_plain_conversations(spark):
    """Many equal conversations, and sequences that only differ in where role ends and text begins."""
    rows = [(c, t, "user", f"t{t}", *EXTRA) for c in range(60) for t in range(3)]
    rows += [(100, 0, "ab", "c", *EXTRA), (101, 0, "a", "bc", *EXTRA)]
    got = prefix_trie.prefix_trie(prefix_trie.plain_paths(prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))))
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute(_turns(rows), lambda c: 0)


def test_empty(spark):
    turns = prefix_trie.numbered_turns(spark.createDataFrame([], SCHEMA))
    assert prefix_trie.prefix_trie(prefix_trie.plain_paths(turns)).count() == 0
