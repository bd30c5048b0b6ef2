"""Purges through foreign keys, against a row-by-row model."""
import random

import pytest

from tidewater.operators.purge import purge
from tidewater.schemas import ForeignKey

GRAPH = [ForeignKey("a", "up", "a", "id", "CASCADE"), ForeignKey("b", "a", "a", "id", "CASCADE"),
         ForeignKey("a", "b", "b", "id", "SET NULL"), ForeignKey("c", "b", "b", "id", "CASCADE"),
         ForeignKey("c", "a", "a", "id", "RESTRICT"), ForeignKey("d", "c", "c", "id", "SET NULL"),
         ForeignKey("d", "d", "d", "id", "RESTRICT")]
COLUMNS = {"a": ["id", "up", "b"], "b": ["id", "a"], "c": ["id", "b", "a"], "d": ["id", "c", "d"]}


def model(rows, roots):
    doomed = {(t, i) for t, ids in roots.items() for i in ids if i in rows[t]}
    while True:
        more = {(fk.child, i) for fk in GRAPH if fk.on_delete == "CASCADE" for i, r in rows[fk.child].items()
                if (fk.parent, r[fk.column]) in doomed} - doomed
        if not more:
            break
        doomed |= more
    blocked = {}
    for fk in GRAPH:
        for i, r in rows[fk.child].items():
            if fk.on_delete == "RESTRICT" and (fk.child, i) not in doomed and (fk.parent, r[fk.column]) in doomed:
                at = (fk.child, fk.column, fk.parent, str(r[fk.column]))
                blocked[at] = blocked.get(at, 0) + 1
    if blocked:
        return rows, blocked
    out = {t: {i: dict(r) for i, r in own.items() if (t, i) not in doomed} for t, own in rows.items()}
    for fk in GRAPH:
        if fk.on_delete == "SET NULL":
            for r in out[fk.child].values():
                if (fk.parent, r[fk.column]) in doomed:
                    r[fk.column] = None
    return out, {}


@pytest.mark.parametrize("seed_value", [1, 2, 3])
def test_random_graphs(spark, seed_value):
    rng = random.Random(seed_value)
    n = {"a": 60, "b": 40, "c": 80, "d": 50}
    target = {"up": "a", "a": "a", "b": "b", "c": "c", "d": "d"}
    rows = {t: {i: {c: i if c == "id" else rng.choice([None, rng.randrange(n[target[c]] + 3)]) for c in cols}
                for i in range(n[t])} for t, cols in COLUMNS.items()}
    if seed_value > 1:                       # nothing may block
        for t in ("c", "d"):
            for r in rows[t].values():
                r["a" if t == "c" else "d"] = None
    tables = {t: spark.createDataFrame([tuple(r[c] for c in COLUMNS[t]) for r in own.values()],
                                       ", ".join(f"{c} int" for c in COLUMNS[t])) for t, own in rows.items()}
    roots = {"a": [0, 1, 5, 999], "d": [3]}
    got = purge(tables, {t: spark.createDataFrame([(i,) for i in ids], "id int") for t, ids in roots.items()}, GRAPH,
                {t: ["id"] for t in tables})
    want, blocked = model(rows, roots)
    assert got.refused == bool(blocked)
    assert {tuple(r)[:4]: r.child_rows for r in got.blocked.collect()} == blocked
    for t, own in want.items():
        assert sorted(got.tables[t].collect(), key=str) == sorted([tuple(r[c] for c in COLUMNS[t]) for r in own.values()], key=str)


def test_seed_category_tree(spark, seed):
    """Declared graph: categories go, their children and products stay without them; orders keep a customer."""
    roots = {"categories": seed["categories"].filter("category_id IN (1, 2)")}
    done = purge(seed, roots)
    assert not done.refused and done.tables["categories"].count() == seed["categories"].count() - 2
    assert done.tables["categories"].filter("parent_id IN (1, 2)").count() == 0
    assert done.tables["products"].count() == seed["products"].count()
    refused = purge(seed, {"customers": seed["customers"]})
    assert refused.refused and refused.tables["customers"].count() == seed["customers"].count()
    assert {r.child for r in refused.blocked.collect()} == {"orders"}


def test_long_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(12)], "id int, up int")
    graph = [ForeignKey("t", "up", "t", "id", "CASCADE")]
    root = spark.createDataFrame([(4,)], "id int")
    assert sorted(r.id for r in purge({"t": chain}, {"t": root}, graph, {"t": ["id"]}).tables["t"].collect()) == [0, 1, 2, 3]
    none = purge({"t": chain.filter("false")}, {"t": root}, graph, {"t": ["id"]})
    assert none.tables["t"].count() == 0 and not none.doomed
    with pytest.raises(ValueError):
        purge({"t": chain}, {"t": root}, graph, {"t": ["id", "up"]})
