"""The conversation trie against brute force: every start of every conversation."""

import hashlib
import random
import zlib

import pytest

from sextant.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(conversations):
    """{(smallest member, depth): figures} of {conversation: [(role, text)]}."""
    members = {}
    for c, x in conversations.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
    share = {k: (len(m) - 1) * len(k[-1][1].encode()) if k else 0 for k, m in members.items()}
    below = lambda k: [x for x in members if x[: len(k)] == k]
    found = set()
    for k, m in members.items():
        subtree = below(k)
        ends = ",".join(map(str, sorted(c for c in m if len(conversations[c]) == len(k))))
        children = [x for x in subtree if len(x) == len(k) + 1]
        leaves = [x for x in subtree if not any(len(y) > len(x) for y in below(x))]
        found.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children), len(leaves), sum(share[x] for x in subtree), hashlib.sha256(ends.encode()).hexdigest()))
    return found


def rows_of(conversations):
    return [(c, i, r, t) for c, x in conversations.items() for i, (r, t) in enumerate(x)]


def found_rows(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def branching(rng, n, longest):
    """Conversations that share starts of any length, copies among them."""
    out = {}
    for c in rng.sample(range(-20, 10 * n), n):
        other = rng.choice(list(out.values())) if out and rng.random() < 0.8 else []
        start = other[: rng.randint(0, len(other))]
        more = [(rng.choice(("user", "")), rng.choice(("a", "é", "bb", ""))) for _ in range(rng.randint(0, longest - len(start)))]
        out[c] = start + (more if rng.random() < 0.8 else []) or [("user", "x")]
    return out


@pytest.mark.parametrize("segment", [64, 2])
def test_trie_matches_all_starts(spark, monkeypatch, segment):
    monkeypatch.setattr(trie, "SEGMENT", segment)  # segments of eight turns: chains of chains
    conversations = branching(random.Random(3), 40, 70)
    found = trie.prefix_trie(spark.createDataFrame(rows_of(conversations), SCHEMA))
    assert found_rows(found) == brute(conversations)


def test_families_share_the_head_of_the_first(spark):
    conversations = branching(random.Random(4), 60, 20)
    rebuilt = {}
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = conversations.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])
        rebuilt[c] = head[:h] + own[h:]
    assert any(not x for x in rebuilt.values())
    found = trie.family_trie(spark.createDataFrame(rows_of(conversations), SCHEMA))
    assert found_rows(found) == brute(rebuilt)


def test_odd_turns(spark):
    rows = [(1, None, "user", "first"), (1, 3, None, None), (1, 3, None, None), (None, 0, "user", "nobody"), (2, 0, "user", "first"), (2, 9, "", ""), (2, 9, "", ""), (3, 2, "user", "x" * 100_000), (3, -1, "user", "first")]
    df = spark.createDataFrame([(*r, "other") for r in rows], SCHEMA + ", n string")
    want = {1: [("user", "first"), ("", ""), ("", "")], 2: [("user", "first"), ("", ""), ("", "")], 3: [("user", "first"), ("user", "x" * 100_000)]}
    assert found_rows(trie.prefix_trie(df)) == brute(want)
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_members_of_several_runs_keep_their_order(spark):
    ends = spark.range(-3000, 4000, 7).selectExpr("'a' id", "id conv").unionByName(spark.createDataFrame([("b", 5)], "id string, conv long"))
    found = dict(trie.ends_digests(ends).collect())
    assert found == {"a": hashlib.sha256(",".join(map(str, range(-3000, 4000, 7))).encode()).hexdigest(), "b": hashlib.sha256(b"5").hexdigest()}


def test_a_conversation_of_many_turns_is_numbered_by_runs(spark):
    turns, convs = trie.turn_rows(spark.range(5000).selectExpr("7L conv_id", "4999 - id turn", "'u' role", "repeat('x', cast(4999 - id as int)) text"))
    assert turns.where("bytes <> at - 1").count() == 0 and turns.count() == 5000 and convs.collect()[0]["n"] == 5000
