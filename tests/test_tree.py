"""Hierarchies by pointer doubling against a walk up from every node."""
import random

from tidewater.operators import tree


def model(parents):
    out = {}
    for n in parents:
        path, at, seen = [], n, set()
        while at in parents and at not in seen:
            seen.add(at)
            path.append(at)
            if parents[at] not in parents:
                out[n] = (at, len(path) - 1, "/".join(f"n{x}" for x in reversed(path)), False)
                break
            at = parents[at]
        else:
            out[n] = (None, None, None, True)
    return out


def run(spark, parents):
    df = spark.createDataFrame([(n, p, f"n{n}") for n, p in parents.items()], "id long, parent_id long, name string")
    return {r.id: (r.root, r.depth, r.path, r.cyclic) for r in tree.hierarchy_paths(df).collect()}


def test_random_forests_with_cycles(spark):
    rng = random.Random(9)
    parents = {n: rng.choice([None, 900 + n, *range(max(0, n - 8), n)]) for n in range(120)}
    parents |= {200: 203, 201: 200, 202: 201, 203: 202, 204: 203, 205: 204, 206: 206, 207: 206}   # rings and what hangs on them
    assert run(spark, parents) == model(parents)


def test_deep_chain_takes_few_rounds(spark, monkeypatch):
    rounds, once = [], tree._doubled
    monkeypatch.setattr(tree, "_doubled", lambda *a: rounds.append(1) or once(*a))
    parents = {n: n - 1 if n else None for n in range(5000)}
    found = run(spark, parents)
    assert len(rounds) <= 14
    assert {n: r[:2] for n, r in found.items()} == {n: (0, n) for n in parents} and found[4999][2].count("/") == 4999


def test_no_nodes(spark):
    assert run(spark, {}) == {} and run(spark, {1: 1}) == {1: (None, None, None, True)}
