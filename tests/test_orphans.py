import datetime as dt
import random

import numpy as np
import pyarrow as pa

from lexmill.operators.orphans import SortedParents, find_orphans, orphans_by_period

REFS = "id long, law string, art string, at timestamp, h string"
PARENTS = "law string, art string, start timestamp, stop timestamp, at string"
day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def brute(refs, parents):
    out = []
    for id_, law, art, at, _ in refs:
        if None not in (law, art, at) and not any(p[0] == law and p[1] == art and p[2] and p[2] <= at and (p[3] is None or p[3] > at) for p in parents):
            out.append(id_)
    return sorted(out)


def make(seed):
    rng = random.Random(seed)
    key = lambda: (rng.choice(["a", "b", "ab", "hot", "hot", "hot", None]), rng.choice(["1", "2", "b1", "1-A", None]))
    parents = [(*key(), rng.choice([None, day(rng.randrange(50))]), rng.choice([None, day(rng.randrange(20, 90))]), "clash") for _ in range(25)]
    refs = [(i // 2, *key(), rng.choice([None, *[day(rng.randrange(90)) for _ in range(9)]]), "clash") for i in range(300)]
    return refs, parents


def run(spark, refs, parents, **bounds):
    r, p = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)
    return sorted(x.id for x in find_orphans(r, p, ["law", "art"], ["law", "art"], "at", "start", "stop", **bounds).collect())


def test_against_brute_force(spark):
    for seed in range(4):
        refs, parents = make(seed)
        wanted = brute(refs, parents)
        assert run(spark, refs, parents) == wanted
        assert run(spark, refs, parents, most_broadcast=0, per_task=20) == wanted


def test_keys_of_one_hash_are_told_apart():
    """Hits are verified by the key, so that a collision of hashes hides no orphan."""
    hashes = np.array([5, 5, 7], np.int64)
    held = SortedParents(hashes, pa.array(["a", "b", "c"]), np.array([0, 50, 0], np.int64), np.array([10, 60, 9], np.int64))
    keys = pa.array(["a", "b", "b", "x", "c", "d"])
    missed = held.miss(np.array([5, 5, 5, 5, 7, 7], np.int64), keys, np.array([5, 5, 55, 5, 5, 5], np.int64))
    assert missed.tolist() == [False, True, False, True, False, True]


def test_large_parents_match_small(spark):
    rng = random.Random(3)
    parents = [(rng.choice("abc"), str(rng.randrange(400)), day(0), rng.choice([None, day(30)]), "") for _ in range(600)]
    refs = [(i, rng.choice("abc"), str(rng.randrange(450)), day(rng.randrange(60)), "") for i in range(2000)]
    wanted = brute(refs, parents)
    assert run(spark, refs, parents) == wanted == run(spark, refs, parents, most_broadcast=0, per_task=30, per_range=20)


def test_empty_tables(spark):
    refs, parents = make(9)
    assert run(spark, refs, []) == brute(refs, [])
    assert run(spark, [], parents) == []
    assert run(spark, refs, [], most_broadcast=-1) == brute(refs, [])


def test_validity_bounds(spark):
    refs = [(1, "a", "1", day(0), ""), (2, "a", "1", day(5), ""), (3, "a", "1", day(10), ""), (4, "a", "1", day(12), "")]
    parents = [("a", "1", day(0), day(5), ""), ("a", "1", day(10), day(11), ""), ("a", "1", day(1), day(2), "")]
    assert run(spark, refs, parents) == [2, 4]


def test_counts_by_month(spark):
    rows = [(1, "x", day(0)), (1, "x", day(0)), (2, "x", day(40)), (3, "y", day(41))]
    got = orphans_by_period(spark.createDataFrame(rows, "id int, field string, at timestamp"), "id", "field", "at").collect()
    assert sorted((r.ref_field, r.period.month, r.n_orphans) for r in got) == [("x", 1, 1), ("x", 2, 1), ("y", 2, 1)]
