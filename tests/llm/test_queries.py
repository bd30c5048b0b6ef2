"""Every query against brute force on a small awkward corpus, and on empty tables."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as E
from corpus import lowered, same, words
from tidewater.llm import fingerprint, licenses, mixing

Q = E.queries()
OPS = sorted((n for n in Q if re.match(r"op\d+_", n)), key=lambda n: int(n[2:].split("_")[0]))


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in OPS] == list(range(1, 14))


@pytest.mark.parametrize("name", [*OPS, "pipeline"])
def test_empty_tables(spark, empty, name):
    assert Q[name](spark, empty).collect() == []


def test_op1(spark, tables):
    folder, rows, *_ = tables
    split = [words(r[1]) for r in rows]
    seen = Counter(tuple(w[i:i + 35]) for w in split for i in range(len(w) - 34))
    expected = []
    for r, w in zip(rows, split):
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert sum(e[2] > 0 for e in expected) > 20
    same(Q["op1_substring_dedup"](spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), expected)


def components(rows):
    sets = []
    for r in rows:
        w = words(lowered(r[1]))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[root(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(r[0], len(sets[i]), least[root(i)], r[0] is not None and r[0] == least[root(i)]) for i, r in enumerate(rows)]


def test_op2(spark, tables):
    folder, rows, *_ = tables
    expected = components(rows)
    assert sum(not e[3] for e in expected) > 15
    same(Q["op2_near_dedup"](spark, folder).select("doc_id", "n_shingles", "component_id", "kept").collect(), expected)


def item_hits(rows, bench):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in bench:
        w = pattern.findall(lowered(text))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for r in rows:
        w, hit, items = pattern.findall(lowered(r[1])), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i:i + n]))):
                    hit.update(range(i, i + n))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((r[0], len(w), len(hit), len(items), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_op3(spark, tables):
    folder, rows, bench, _ = tables
    expected = item_hits(rows, bench)
    assert sum(e[5] for e in expected) > 5
    same(Q["op3_decontamination"](spark, folder).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect(), expected)


def test_op4(spark, tables):
    folder, rows, *_ = tables
    out = Q["op4_sharding"](spark, folder).collect()
    same([(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in out],
         [(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode()), "bytes", None) for r in rows])
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_op5(spark, tables):
    folder, rows, *_ = tables
    by_id = {r.doc_id: r for r in Q["op5_license_scan"](spark, folder).collect()}
    for doc_id, text, *_ in rows:
        if text and "MIT License" in text:
            assert (by_id[doc_id].n_known, by_id[doc_id].licenses, by_id[doc_id].category) == (
                2, "All-Rights-Reserved,MIT", "proprietary")
        else:
            assert (by_id[doc_id].n_known, by_id[doc_id].category) == (0, "none")


def test_op6(spark, tables):
    folder, rows, *_ = tables
    out = Q["op6_mixing"](spark, folder).collect()
    again = Q["op6_mixing"](spark, folder).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    assert math.isclose(sum(goal.values()), sum(size.values()))
    same([(r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in out],
         [(r[0], len(words(r[1])), size[r[3]], round(goal[r[3]], 6)) for r in rows])
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 3 * mixing.BLOCK_WORDS / 16)


def test_op7(spark, tables):
    folder, rows, *_ = tables
    out = Q["op7_quality"](spark, folder).collect()
    same([(r.doc_id, r.held_out) for r in out],
         [(r[0], zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 4 == 2) for r in rows])
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def test_op8(spark, tables):
    folder, rows, *_ = tables
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    tokens = [words(lowered(r[1])) + ["end"] for r in rows]
    c = Counter(t for w, h in zip(tokens, held) if not h for t in w)
    n, v = sum(c.values()), len(c)
    expected = {}
    for i, (r, w) in enumerate(zip(rows, tokens)):
        expected.setdefault(r[0], []).append((held[i], len(w), sum(c[t] > 0 for t in w), n,
                                              sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w)))
    out = Q["op8_lm_scoring"](spark, folder).collect()
    assert len(out) == len(rows)
    for r in out:
        e = expected[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:4]
        assert math.isclose(r.base_score, e[4], rel_tol=1e-9) and -12 * r.n_tokens * 20 < r.score < 0


def test_op9(spark, tables):
    folder, rows, *_ = tables
    out = Q["op9_fingerprints"](spark, folder).collect()
    assert len(out) == len(rows)
    order = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: -r[0])
    last = next(r for r in rows if r[0] is None)
    chain = [t or "" for _, t in order] + [last[1] or ""]
    by_id = {r.doc_id: r for r in out}
    errors = []

    def shingles(text):
        w = words(text)
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    twice = [r[0] for r in rows if sum(x[0] == r[0] for x in rows) > 1][0]
    for i, (doc_id, _) in enumerate(order):
        if doc_id == twice:
            continue  # its first row is followed by its second
        text, after = chain[i], chain[(i + 1) % len(chain)]
        k = len(text) // 2
        edited = text[:len(text) - k] + after[:k]
        r = by_id[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(text), shingles(other)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    prints = defaultdict(set)
    for doc_id, text in order:
        prints[text or ""].add(by_id[doc_id].fingerprint)
    assert all(len(v) == 1 for v in prints.values()) and len(prints) > 50
    full = 2 * fingerprint.BINS
    assert {len(next(iter(v))) for v in prints.values()} <= {0, full}


def test_op10(spark, tables):
    folder, rows, *_ = tables
    strip, docs = b" \t\n\r\x0b\x0c", defaultdict(list)
    for r in rows:
        if r[0] is not None:
            docs[r[0]].append(r)
    first = {}
    for r in rows:
        for line in (r[1] or "").encode().split(b"\n"):
            k = line.strip(strip).lower()
            if r[0] is not None and len(k.decode()) >= 10:
                first[k] = min(first.get(k, r[0]), r[0])
    expected = []
    for r in rows:
        lines = (r[1] or "").encode().split(b"\n")
        stay = [x for x in lines if r[0] is None or first.get(x.strip(strip).lower(), r[0]) >= r[0]]
        expected.append((r[0], len(lines), len(lines) - len(stay), hashlib.sha256(b"\n".join(stay)).hexdigest()))
    assert sum(e[2] for e in expected) > 10
    same(Q["op10_line_dedup"](spark, folder).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect(), expected)


def test_license_rules():
    for name, _, text in licenses.LICENSES:
        wrapped = ("Some words before\n" + text.replace(". ", ".\n  ") + "\nand after").encode()
        assert name in {m[0] for m in licenses.scan(wrapped)[2]}, name
    both = next(t for n, _, t in licenses.LICENSES if n == "BSD-3-Clause")
    assert {m[0] for m in licenses.scan(both.encode())[2]} == {"BSD-3-Clause"}
    assert licenses.scan(b"")[1:] == (0, [])


def test_seats():
    assert mixing.sainte_lague([53.0, 24.0, 23.0], 7, [9, 9, 9]) == [3, 2, 2]
    assert mixing.sainte_lague([1.0, 0.0, 9.0], 10, [10, 10, 4]) == [6, 0, 4]
    shares, seats = [5.5, 1.25, 3.25, 7.0], 1000
    given, heap = mixing.sainte_lague(shares, seats, [10**6] * 4), [0] * 4
    for _ in range(seats):
        i = max(range(4), key=lambda k: shares[k] / (2 * heap[k] + 1))
        heap[i] += 1
    assert given == heap
    assert mixing.targets([10, 1000], [3, 1]) == [30.0, 980.0]
