"""Reservation: golden case, edges, and the parallel plan against brute force."""
import random


from tidewater.operators.reserve import reserve, reserved_totals
from tidewater.operators.transfer import image, transfer


def brute(stock, requests):
    avail = dict(stock)
    out = {}
    for rid, key, qty in sorted(requests, key=lambda r: r[0]):
        a = avail.get(key, 0)
        if qty is not None and a >= qty:
            if key in avail:  # without a stock row nothing changes
                avail[key] = a - qty
            out[rid] = 0
        else:
            out[rid] = 1
    return out


def test_golden_case(seed, spark):
    req = spark.createDataFrame([(1, 1, 1, 30), (2, 1, 1, 20), (3, 1, 1, 10)],
                                "request_id long, product_id long, warehouse_id int, qty int")
    res = reserve(seed["inventory"], req, ["product_id", "warehouse_id"], "request_id")
    assert {r.request_id: r.result for r in res.collect()} == {1: 0, 2: 1, 3: 0}
    inv = reserved_totals(seed["inventory"], res, ["product_id", "warehouse_id"])
    assert inv.filter("product_id = 1 and warehouse_id = 1").first().qty_reserved == 45
    assert inv.count() == 41


def test_missing_inventory_and_release(seed, spark):
    req = spark.createDataFrame([(1, 99, 1, 0), (2, 99, 1, 5), (3, 1, 1, -10), (4, 1, 1, 45), (5, 1, 1, 6)],
                                "request_id long, product_id long, warehouse_id int, qty int")
    got = {r.request_id: r.result for r in reserve(seed["inventory"], req, ["product_id", "warehouse_id"],
                                                    "request_id").collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


def _random_case(seed_value, n=3000):
    rnd = random.Random(seed_value)
    stock = {k: rnd.randint(0, 400) for k in range(6)}
    reqs = []
    for rid in range(n):
        key = 0 if rnd.random() < 0.4 else rnd.randint(1, 7)   # key 0 is hot; 6, 7 have no stock row
        qty = rnd.choice([0, 1, 2, 3, 5, 8, 13, 40, 90]) if rnd.random() > 0.02 else -rnd.randint(1, 30)
        reqs.append((rid, key, qty if rnd.random() > 0.01 else None))
    return stock, reqs


def test_parallel_scan_equals_brute_force(spark):
    for s in (1,):
        stock, reqs = _random_case(s, n=2000)
        inv = spark.createDataFrame([(k, v, 0) for k, v in stock.items()], "k long, qty_on_hand long, qty_reserved long")
        req = spark.createDataFrame(reqs, "request_id long, k long, qty int")
        want = brute(stock, reqs)
        for limit, chunk in ((0, 40), (300, 10 ** 6), (10 ** 9, 40)):
            got = {r.request_id: r.result for r in
                   reserve(inv, req, "k", "request_id", key_limit=limit, chunk_rows=chunk, partitions=8).collect()}
            assert got == want, (s, limit, chunk)


def test_no_releases_hot_key_settles_in_parallel(spark):
    rnd = random.Random(7)
    reqs = [(i, 0, rnd.randint(1, 20)) for i in range(4000)]
    inv = spark.createDataFrame([(0, 5000, 0)], "k long, qty_on_hand long, qty_reserved long")
    req = spark.createDataFrame(reqs, "request_id long, k long, qty int")
    got = {r.request_id: r.result for r in reserve(inv, req, "k", "request_id", key_limit=0,
                                                    chunk_rows=100, partitions=8).collect()}
    assert got == brute({0: 5000}, reqs)
    assert sum(1 for v in got.values() if v == 0) > 0


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), min_size=1, max_size=60),
       st.integers(0, 200))
def test_property_never_negative_and_exact(spark, reqs, stock):
    rows = [(i, k, q) for i, (k, q) in enumerate(reqs)]
    inv = spark.createDataFrame([(k, stock, 0) for k in (0, 1)], "k long, qty_on_hand long, qty_reserved long")
    req = spark.createDataFrame(rows, "request_id long, k long, qty int")
    res = reserve(inv, req, "k", "request_id", key_limit=0, chunk_rows=4, partitions=3)
    got = {r.request_id: r.result for r in res.collect()}
    assert got == brute({0: stock, 1: stock}, rows)
    taken = {0: 0, 1: 0}
    for rid, k, q in rows:
        if got[rid] == 0 and k in taken:
            taken[k] += q
    assert all(stock - t >= 0 for t in taken.values())
    after = {r.k: r.qty_reserved for r in reserved_totals(inv, res, "k").collect()}
    assert after == taken


def test_null_keys_stand_alone(spark):
    inv = spark.createDataFrame([(1, 10, 0)], "k long, qty_on_hand long, qty_reserved long")
    req = spark.createDataFrame([(1, None, -5), (2, None, 0), (3, None, 1), (4, 1, 10), (5, 1, 1)],
                                "request_id long, k long, qty int")
    for limit in (0, 10 ** 6):
        got = {r.request_id: r.result for r in reserve(inv, req, "k", "request_id", key_limit=limit,
                                                        partitions=3).collect()}
        assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 1}, limit


def _walk(s, quantities):
    for q in quantities:
        s -= q if s >= q else 0
    return s


def test_transfer_maps_equal_walks():
    rnd = random.Random(11)
    kinds = [lambda: rnd.randint(1, 60), lambda: rnd.randint(-60, 60), lambda: rnd.choice([-50, 50]), lambda: rnd.choice([0, 1, 999, -7]),
             lambda: rnd.choice([-1, 1000])]
    for case in range(60):
        quantities = [kinds[case % 5]() for _ in range(rnd.choice([1, 5, 200]))]
        domain = [(-30, -30), (0, 400), (900, 1500)] if case % 2 else [(0, 2000)]
        pieces = transfer(quantities, domain)
        starts = [s for lo, hi in domain for s in range(lo, hi + 1)]
        assert [s for lo, hi, _ in pieces for s in range(lo, hi + 1)] == starts
        assert [s + d for lo, hi, d in pieces for s in range(lo, hi + 1)] == [_walk(s, quantities) for s in starts]
        ends = {_walk(s, quantities) for s in starts}
        assert {s for lo, hi in image(pieces) for s in range(lo, hi + 1)} == ends
        few = image(pieces, 2)
        assert len(few) <= 2 and all(any(lo <= e <= hi for lo, hi in few) for e in ends)


def test_stocks_fall_together():
    """A chunk's map over what the chunk before it allows has few pieces, whatever the starting stock was."""
    rnd = random.Random(5)
    runs = [[rnd.randint(1, 10 ** 6) if rnd.random() < 0.5 else -rnd.randint(1, 10 ** 6) for _ in range(5000)] for _ in range(2)]
    ends = image(transfer(runs[0], [(0, 10 ** 8)]))
    assert len(transfer(runs[1], ends)) <= 200


def test_hot_key_alternating_releases_and_requests(spark):
    rnd = random.Random(3)
    for stock in (1000, 0, -40):
        reqs = [(i, 0, (rnd.randint(1, 90) if i % 2 else -rnd.randint(1, 90)) if i % 11 else rnd.choice([0, 500, -300]))
                for i in range(3000)]
        inv = spark.createDataFrame([(0, stock, 0)], "k long, qty_on_hand long, qty_reserved long")
        req = spark.createDataFrame(reqs, "request_id long, k long, qty int")
        got = {r.request_id: r.result for r in reserve(inv, req, "k", "request_id", key_limit=100, chunk_rows=150,
                                                        partitions=4).collect()}
        assert got == brute({0: stock}, reqs), stock
