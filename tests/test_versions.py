"""Versions that one of several writers makes."""

import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest

from tracewell.operators.ledger import Policy
from tracewell.operators.versions import compare_and_set
from tracewell.session import scratch
from tracewell.sources.versions import Versions, migrated, opened


def test_one_of_two_writers_wins(spark):
    place = scratch(spark, "versions")
    a, b = Versions(spark, place), Versions(spark, place)
    assert a.current() == (0, None) and a.commit(0, {"n": 1}) and not b.commit(0, {"n": 2})
    assert b.current() == (1, {"n": 1}) and b.commit(1, {"n": 2}) and not a.commit(1, {"n": 3}) and a.current() == (2, {"n": 2})
    with ThreadPoolExecutor(4) as pool:
        for seen in range(2, 6):
            won = list(pool.map(lambda i, seen=seen: Versions(spark, place).commit(seen, {"n": i}), range(4)))
            assert sum(won) == 1 and a.current()[0] == seen + 1
    names = [f.getPath().getName() for f in a.path("x").getFileSystem(a.conf).listStatus(a.hadoop.Path(place))]
    assert sorted(n for n in names if not n.endswith(".crc")) == [f"v{n:012d}.json" for n in range(1, 7)]  # nothing half-made is left


def test_a_changed_policy_is_refused(spark):
    place, policy = scratch(spark, "policy"), Policy(daily=5)
    assert opened(spark, place, policy) == opened(spark, place, Policy(daily=5)) == policy
    with pytest.raises(ValueError, match=r"version 1: \['daily', 'gap_s'\]"):
        opened(spark, place, Policy(daily=6, gap_s=7))
    with pytest.raises(ValueError):
        migrated(spark, place, Policy(), Policy(daily=6))
    assert migrated(spark, place, policy, Policy(daily=6)) == 2 and opened(spark, place, Policy(daily=6)).daily == 6
    with pytest.raises(ValueError):
        opened(spark, place, policy)


def test_proposals(spark):
    rng = random.Random(1)
    current = [(k, rng.randrange(3), rng.choice("ab")) for k in range(6)] + [(6, 1, None)]
    proposals = [(rng.choice([*range(9), None]), rng.randrange(60), rng.choice([0, 0, 1, 1, 2, None]), rng.choice(["a", "b", "c", None])) for _ in range(300)]
    rows = compare_and_set(spark.createDataFrame(current, "key long, version long, value string"), spark.createDataFrame(proposals, "key long, seq long, expected long, value string")).collect()
    held = {k: (v, x) for k, v, x in current}
    states = Counter()
    for k in [*range(9), None]:
        mine = sorted([p for p in proposals if p[0] == k], key=lambda p: (p[1], p[3] is not None, p[3] or ""))
        version, value = held.get(k, (0, None))
        same = lambda p, k=k, value=value: k in held and p[3] == value
        fits = [p for p in mine if p[2] == version and not same(p)] if k is not None else []
        for i, p in enumerate(mine):
            state = "refused" if k is None else "same" if same(p) else "stale" if p[2] != version else "lost"
            states[(*p, state, None if k is None else version + bool(fits))] += 1
        if fits:
            states[(*fits[0], "lost", version + 1)] -= 1
            states[(*fits[0], "set", version + 1)] += 1
    assert Counter(map(tuple, rows)) == +states
