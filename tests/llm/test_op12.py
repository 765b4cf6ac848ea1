import math
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest

from triage_spark.llm import op12_hash_tree as A

COLS = "doc_id long, text string, shard string, slot int, place string, part string, `a.b` string, law int, text_hash long"


def descend(doc_id, shards):
    """The path of the shard that a document takes, level by level."""
    path = ()
    while len(path) < 3:
        weights = defaultdict(float)
        for s in shards:
            if s[: len(path)] == path:
                weights[tuple(s[: len(path) + 1])] += s.weight
        draw = lambda c: -math.log((int(md5(f"{'null' if doc_id is None else doc_id}/{'/'.join(map(str, c))}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weights[c]  # noqa: B023, E731
        path = min((c for c in weights if weights[c] > 0), key=draw)
    return path


def paths(spark, shards, n=3000):
    by = {s.number: s[:3] for s in shards}
    return {r.id: by[r.s] for r in A.placed(spark.range(n), shards, "s", "id").collect()}


def uneven():
    return [A.Shard(f"g{i // 6}", f"r{i // 2}", i, 1 + i % 3) for i in range(14)]


def test_placed_equals_plain_descent(spark):
    shards = uneven()
    got = paths(spark, shards)
    assert all(got[i] == descend(i, shards) for i in range(3000))
    total = sum(s.weight for s in shards)
    for s in shards:
        want = 3000 * s.weight / total
        assert abs(Counter(got.values())[s[:3]] - want) < 5 * want**0.5


def test_new_region_takes_rows_only_into_itself(spark):
    before, after = paths(spark, A.topology(40)), paths(spark, A.topology(41))
    moved = [i for i in before if before[i] != after[i]]
    assert 30 < len(moved) < 130 and {after[i][2] for i in moved} == {40}


@pytest.mark.parametrize("weight", [0.5, 4.0, 0.0])
def test_moves_pass_through_the_changed_subtrees(spark, weight):
    shards = uneven()
    changed = shards[9]
    other = [s._replace(weight=weight) if s == changed else s for s in shards]
    before, after = paths(spark, shards), paths(spark, other)
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    assert moved
    for old, new in moved:
        # Where the two paths part, one of them takes the changed subtree: the new one if it grew.
        level = next(k for k in range(3) if old[k] != new[k])
        side = new if weight > changed.weight else old
        assert side[: level + 1] == changed[: level + 1]
    # Subtrees beside the changed region keep their rows among themselves.
    assert not any(old[0] != changed.region and new[0] != changed.region for old, new in moved)


def test_weights_must_be_usable():
    with pytest.raises(ValueError):
        A.tree([A.Shard("a", "b", 0, 0.0)])
    with pytest.raises(ValueError):
        A.tree([A.Shard("a", "b", 0, 1.0), A.Shard("a", "b", 1, -1.0)])


def test_edge_rows(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(40)] + [(5, None), (5, ""), (5, "é日"), (None, "x"), (None, "x"), (7, "long " * 50_000)] + [(8, "same")] * 300
    docs = spark.createDataFrame([(*r, "s", 1, "p", "q", "z", 2, 3) for r in rows], COLS).repartition(4)
    shards = A.topology(12)
    files = A.write_shards(docs, f"file://{tmp_path}/shards", shards)
    assert (files.shard, files.slot) == ("shard_", "slot_") and files.rows.columns[: len(docs.columns)] == docs.columns
    got = files.rows.collect()
    assert Counter((r.doc_id, r.text, r.shard, r["a.b"]) for r in got) == Counter((i, t, "s", "z") for i, t in rows)
    assert all(descend(r.doc_id, shards)[2] == r.shard_ for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard_].append((r.slot_, (r.doc_id is not None, r.doc_id or 0)))
    for held in by.values():
        held.sort()
        assert [s for s, _ in held] == list(range(len(held))) and [k for _, k in held] == sorted(k for _, k in held)
    empty = A.write_shards(spark.createDataFrame([], COLS), f"file://{tmp_path}/none", shards)
    assert empty.rows.count() == 0


def test_query(spark, sf_small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in A.op12_hash_tree(spark, sf_small).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        r = got[i]
        assert (r.size, r.text_crc32, r.law, r.shard) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "key", descend(i, A.topology(40))[2])
        assert r.grown_shard in (r.shard, 40)
    for s in range(40):
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(sum(r.shard == s for r in got.values())))
