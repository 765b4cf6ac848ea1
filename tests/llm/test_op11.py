import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from triage_spark.llm import op11_prefix_trie as A

COLS = "conv_id long, turn long, role string, text string, place long, r int, chunk string, depth int, `a.b` string"


def brute(rows):
    """The nodes as a counter of result rows, through plain tuples; rows: (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                kids[seq[: d - 1]].add(seq[:d])
    below = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        down = [below[k] for k in kids[node]]
        below[node] = (sum(x for x, _ in down) or 1, own + sum(x for _, x in down))
    out = Counter()
    for node, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if built[c] == node)))
        up = min(members[node[:-1]]) if node else None
        out[min(held), len(node), up, len(held), len(kids[node]), *below[node], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "c", 3, "z") for r in rows], COLS)


def result(df):
    return Counter(tuple(r) for r in df.collect())


def random_rows(seed, convs=150):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(0, 420), convs) + [100_000_007, 12_800, 12_899]:
        for turn in range(rnd.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, turn if rnd.random() < 0.9 else None, rnd.choice(["user", "user", "assistant", None]), rnd.choice(["a", "a", "bb", "éé日", "", None])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [4096, 1, 3])
def test_random_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(A, "CHUNK", chunk)
    monkeypatch.setattr(A, "PIECE_BITS", 12 if chunk > 1 else 2)
    rows = random_rows(chunk)
    want = brute(rows)
    assert result(A.prefix_trie(frame(spark, rows).repartition(5))) == want
    assert max(w[1] for w in want) >= 8 and min(w[4] for w in want) == 0


def test_one_conversation_of_many_turns_and_many_equal_ones(spark):
    rows = [(7, i // 3, "user", f"t{i % 5}") for i in range(12_000)] + [(c, t, "r", "same " * t) for c in range(1000, 1400) for t in range(7)] + [(300, None, None, None)] * 50
    assert result(A.prefix_trie(frame(spark, rows))) == brute(rows)


def test_edge_rows(spark):
    long = "word " * 60_000
    rows = [(None, 0, "user", "x"), (-5, 0, "u", long), (3, 0, "u", "x"), (3, 0, "u", "x"), (3, None, None, None), (0, 5, "u", ""), (1, 1, "", ""), (1, 1, "", "")]
    got = result(A.prefix_trie(frame(spark, rows)))
    # As in SQL, % has the sign of its left side, so conversation -5 belongs to conversation 0.
    assert got == brute(rows)
    assert A.prefix_trie(frame(spark, rows[:1])).count() == 0 and A.prefix_trie(spark.createDataFrame([], COLS)).count() == 0


def test_conversations_without_turns_are_members_of_the_root(spark):
    # Each has one turn, which its h drops, and no base conversation.
    ids = [c for c in range(501, 560) if zlib.crc32(str(c).encode()) % 6 > 0][:20]
    rows = [(c, 0, "u", "x") for c in ids]
    want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert result(A.prefix_trie(frame(spark, rows))) == Counter([(ids[0], 0, None, 20, 0, 1, 0, want)]) == brute(rows)


def test_query_against_brute_force(spark, sf_small):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").collect()]
    assert result(A.op11_prefix_trie(spark, sf_small)) == brute(rows)
