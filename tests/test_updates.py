"""A log of updates against the same updates made one after another."""

import random

from pagemill.operators.library import replay


def test_replay_is_updates_in_order(spark):
    rng, docs = random.Random(3), {i: {"a": i, "b": f"b{i}", "c": "stays"} for i in range(30)}
    log = []
    for at in range(200):
        sets = {c: rng.random() < 0.5 for c in "ab"}
        log.append((rng.choice([*range(25), 77]), sets["a"], rng.choice([None, at]), sets["b"], rng.choice([None, f"v{at}"]), at // 3, at))
    rng.shuffle(log)
    want = {i: dict(r) for i, r in docs.items()}
    for id_, has_a, a, has_b, b, *_ in sorted(log, key=lambda r: r[-2:]):
        if id_ in want:
            want[id_] |= ({"a": a} if has_a else {}) | ({"b": b} if has_b else {})
    d = spark.createDataFrame([(i, r["a"], r["b"], r["c"]) for i, r in docs.items()], "id long, a long, b string, c string")
    updates = spark.createDataFrame(log, "id long, has_a boolean, a long, has_b boolean, b string, ts long, no long")
    got = replay(d, updates, ["a", "b"], ["ts", "no"])
    assert got.columns == d.columns
    assert {r.id: {"a": r.a, "b": r.b, "c": r.c} for r in got.collect()} == want
    assert sum(r["a"] is None for r in want.values()) > 3
    assert sorted(replay(d, updates.where("false"), ["a"], ["ts"]).collect()) == sorted(d.collect())
    assert replay(d.where("false"), updates, ["a"], ["ts"]).isEmpty()
