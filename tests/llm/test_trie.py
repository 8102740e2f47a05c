import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from glyphloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, hi int, n_convs map<string,int>"


def brute(rows, span=100, head=6):
    """Every node as (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % head
        first = c - abs(c) % span * (1 if c >= 0 else -1)
        seq = tuple(convs.get(first, [])[:h] + convs[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves[p] if children[p] else 1
        if p:
            saved[p] += (len(members[p]) - 1) * len(p[-1][1])
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    listed = lambda p: sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted(((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), children[p], leaves[p], saved[p], listed(p)) for p in members), key=repr)


def nodes(spark, rows, **options):
    df = spark.createDataFrame([(*r, "d", 1, {"k": 1}) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, trie.prefix_trie(df, **options).collect()), key=repr)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-3, 40), 100, 101, 205, 299, 1000, *range(1001, 1060)]:
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bé😀", "", None, "long " * 9])))
    rows += [rows[0], rows[0], (None, 1, "user", "no conversation"), (None, None, None, None)]
    for c in range(2000, 2150):  # copies and a common first turn
        rows += [(c, 0, "user", "hello"), (c, 1, "user", "same" if c % 3 else f"own {c}")]
    return rows


@pytest.mark.parametrize("members", [1000, 2, 30])
def test_nodes_equal_brute_force(spark, members):
    rows = conversations(members)
    assert nodes(spark, rows, shard_members=members) == brute(rows)


def test_a_long_conversation_and_its_copy(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 900 else f"{c} {t}") for c in (500, 600) for t in range(1200)] + [(7, 0, "user", "x")]
    assert nodes(spark, rows, shard_members=1) == brute(rows)


def test_turnless_conversations_and_no_conversations(spark):
    short = [c for c in range(1, 90) if zlib.crc32(str(c).encode()) % 6 >= 2][:5]
    rows = [(c, 0, "user", "gone: the first of the span is absent") for c in short]
    got = nodes(spark, rows)
    assert got == brute(rows) and got[0][1] == 0 and len(got) == 1
    assert nodes(spark, []) == [] and nodes(spark, [(None, 1, "a", "b")]) == []


def test_lists_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(trie, "LIST_BYTES", 50)
    rows = [(c, 0, "user", "x") for c in range(0, 60_000, 100)] + [(3, 0, "user", "y")]
    assert nodes(spark, rows) == brute(rows)


def test_queue_spills_and_adds_up():
    rng = random.Random(5)
    queue, want = trie.Messages(rows=7, runs=4), defaultdict(lambda: [0, 0, 0])
    keys = [(-rng.randint(0, 9), rng.randint(-50, 50), rng.choice([-1, 1])) for _ in range(400)]
    for key in keys:
        message = [1, rng.randint(0, 5), rng.randint(0, 1 << 40)]
        queue.push((*key, *message))
        for k in range(3):
            want[key][k] += message[k]
    assert queue.runs
    assert queue.pop((-100, 0, 0)) == (0, 0, 0)
    for key in sorted(want):
        assert queue.pop(key) == tuple(want[key])
    queue.push((-1, 2, 3, 1, 1, 1))
    with pytest.raises(ValueError):
        queue.pop((0, 0, 0))
