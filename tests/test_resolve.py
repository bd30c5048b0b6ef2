"""Upsert on any unique key against a row-by-row model."""
import random
import unicodedata

import pytest

from tidewater.operators.resolve import upsert_any_key
from tidewater.sources.seed import seed_df

KIND = "id long, email string, a int, b string, v string"


def plain(x):
    if x is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFD", str(x)) if not unicodedata.combining(c)).lower().rstrip(" ")


def keys_of(r):
    """Normalised keys without a NULL part: primary, e-mail, (a, b)."""
    out = [("id", r["id"]), ("email", plain(r["email"])), ("ab", None if r["a"] is None or r["b"] is None else (r["a"], plain(r["b"])))]
    return [k for k in out if k[1] is not None]


def model(target, batch):
    table, updates, new, conflicts = {r["id"]: dict(r) for r in target}, {}, [], []
    owner = {k: r["id"] for r in target for k in keys_of(r)}
    for r in batch:
        met = [owner[k] for k in keys_of(r) if k in owner]
        if len(set(met)) > 1:
            conflicts.append(r["seq"])
        elif met:
            updates.setdefault(met[0], []).append(r)
        else:
            new.append(r)
    for i, rows in updates.items():
        table[i]["v"] = max(rows, key=lambda r: r["seq"])["v"]
    kept = {}
    for r in new:
        identity = tuple(keys_of(r)) or ("row", r["seq"])
        if identity not in kept or kept[identity]["seq"] < r["seq"]:
            kept[identity] = r
    count = {}
    for r in kept.values():
        for k in keys_of(r):
            count[k] = count.get(k, 0) + 1
    for r in kept.values():
        (conflicts.append(r["seq"]) if any(count[k] > 1 for k in keys_of(r)) else table.setdefault(("new", r["seq"]), r))
    return table, sorted(conflicts)


@pytest.mark.parametrize("seed_value", [1, 2])
def test_random_batches(spark, seed_value):
    rng = random.Random(seed_value)
    mails = ["Ann@x.com", "bob@x.com", "ÉVE@x.com", "dan@x.com", "zoe@x.com", "new1@x.com", "new2@x.com"]
    target = [{"id": i, "email": mails[i] if i < 5 else None, "a": i % 3, "b": f"B{i}", "v": "old"} for i in range(9)]
    spell = [str.lower, str.upper, lambda s: s + "  ", lambda s: s.replace("e", "é").replace("É", "e")]
    batch = []
    for seq in range(60):
        e = rng.choice([None, *mails])
        b = rng.choice([None, None, "B1", "b4 ", "B7", "nb"])
        batch.append({"id": rng.choice([None, None, None, 3, 8, 77]), "email": e and rng.choice(spell)(e), "a": rng.choice([0, 1, 2]) if b else None,
                      "b": b, "v": f"v{seq}", "seq": seq})
    for seq in range(60, 66):
        batch.append({"id": 500 if seq == 65 else None, "email": f"Solo{seq // 2}@x.com", "a": None, "b": None, "v": f"v{seq}", "seq": seq})
    got = upsert_any_key(spark.createDataFrame([tuple(r.values()) for r in target], KIND),
                         spark.createDataFrame([tuple(r.values()) for r in batch], KIND + ", seq int").repartition(3),
                         "id", [["email"], ["a", "b"]], ["v"], {}, "seq")
    want, conflicts = model(target, batch)
    assert sorted(r.seq for r in got.conflicts.collect()) == conflicts and conflicts
    rows = got.table.collect()
    assert sorted((r.v for r in rows)) == sorted(r["v"] for r in want.values())
    for r in rows:
        if r.id in want:
            assert r.asDict() == want[r.id]
    ids = [r.id for r in rows]
    assert len(ids) == len(set(ids)) and min(i for i in ids if i not in want or i == 77) >= 9


def test_seed_sites(spark):
    """The seed's own upserts: customers by e-mail, codes by code, in another spelling; nothing is inserted twice."""
    for table, primary, column in (("customers", "customer_id", "email"), ("discount_codes", "code_id", "code")):
        target = seed_df(spark, table)
        again = target.selectExpr(f"lower({column}) || ' ' AS {column}", "false AS is_active", "1 AS seq")
        done = upsert_any_key(target, again, primary, [[column]], ["is_active"], {}, "seq")
        assert done.conflicts.count() == 0 and done.table.count() == target.count()
        assert {r.is_active for r in done.table.collect()} == {False}
        assert sorted(done.table.select(column).collect()) == sorted(target.select(column).collect())


def test_refusals_and_empty(spark):
    target = spark.createDataFrame([], KIND)
    with pytest.raises(ValueError):
        upsert_any_key(target, spark.createDataFrame([], "email string, seq int"), "id", [["email"]], ["email"], {}, "seq")
    done = upsert_any_key(target, spark.createDataFrame([("A", 1), ("á", 2), (None, 3), (None, 4)], "email string, seq int"), "id",
                          [["email"]], ["v"], {"v": "d"}, "seq")
    assert sorted(tuple(r) for r in done.table.select("id", "v").collect()) == [(1, "d"), (2, "d"), (3, "d")]
