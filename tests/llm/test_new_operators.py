"""Operators 11 to 13 against brute force, and their parts."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as E
from corpus import lowered, same
from tidewater.llm import centroids, collocations, secrets

Q = E.queries()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ------------------------------------------------------------------- op11
def vector_rows():
    rng = np.random.default_rng(3)
    spots = rng.normal(0, 1, (12, 64))
    rows = [(i, (spots[i % 12] + rng.normal(0, 0.2 + (i % 5) / 4, 64)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]                              # copies
    rows += [(2000 + i, [float(i % 3)] * 64) for i in range(30)]                      # ties
    rows += [rows[4], (None, rows[5][1]), (5000, None), (5001, [1.0] * 63), (5002, [1.0] * 65), (5003, [])]
    rows += [(5004, [float("nan")] + [0.0] * 63), (5005, [float("inf")] + [0.0] * 63), (5006, [None] + [0.0] * 63)]
    rows += [(5007, [-0.001] * 64), (5008, [1e30] * 64)]
    return rows


def lloyd(rows, k=40, rounds=5):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(min(max(256 * x, -2 ** 27), 2 ** 27)) for x in v]))
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    v = np.array([r[1] for r in kept], np.int64)
    c = [list(r[1]) for r in kept[:k]]

    def assign():
        d = np.stack([((v - np.array(x)) ** 2).sum(axis=1) for x in c], axis=1)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        at, _ = assign()
        for j in range(len(c)):
            own = v[at == j]
            if len(own):
                c[j] = [int(x) // len(own) for x in own.sum(axis=0)]
    at, d = assign()
    total = Counter()
    for j, x in zip(at.tolist(), d.tolist()):
        total[j] += x
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return [(r[0], j, x, total[j], sum(total.values()), sha[j]) for r, j, x in zip(kept, at.tolist(), d.tolist())]


def test_op11(spark, tmp_path):
    rows = vector_rows()
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    expected = lloyd(rows)
    assert len({e[1] for e in expected}) > 20
    same(Q["op11_centroid_clustering"](spark, str(tmp_path)).collect(), expected)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_op11_few(spark, tmp_path, n):
    rows = vector_rows()[:n] + [(9, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = Q["op11_centroid_clustering"](spark, str(tmp_path)).collect()
    assert sorted(r.cluster for r in out) == list(range(n)) and all(r.distance == 0 for r in out)


def test_clashing_vector_columns(spark):
    rows = [(i, [float(i), 1.0], "x", 5, "y") for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, _v string, cluster long, _p string")
    out = centroids.cluster_vectors(df, k=2, rounds=2, dim=2)
    assert out.columns == ["vec_id", "_v", "_p", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert {(r._v, r._p) for r in out.collect()} == {("x", "y")}


def test_bounds_never_exceed():
    rng = np.random.default_rng(5)
    for scale in (1, 300, 1 << 27):
        v = rng.integers(-scale, scale + 1, (500, 64))
        p = np.vstack([v[:6], v[:1]])                                                  # equal pivots too
        c = p + rng.integers(-max(1, scale // 20), max(1, scale // 20) + 1, p.shape)
        c[2] = v[9]
        low = centroids.Pivots(p).lower_bounds(centroids.distances(v, p).astype(np.float32).astype(float), c)
        true = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v[:50]], dtype=float)
        assert (low[:50] <= true).all() and (low > 0).mean() > 0.5


# ------------------------------------------------------------------- op12
def base_spans(text):
    kinds = {"assign": r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""",
             "access": r"(AKIA[A-Z0-9]+)", "hex": r"([0-9a-f]+)"}
    least = {"assign": 8, "access": 16, "hex": 32}
    out = []
    for place, (kind, pattern) in enumerate(kinds.items()):
        out += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[1]) >= least[kind]]
    return [x[2] for x in sorted(out)]


def secret_texts():
    rng = random.Random(8)
    words = ["".join(rng.choice(["the", "er", "on", "tion", "he", "re", "in", "an", "ing"]) for _ in range(rng.randint(1, 9)))
             for _ in range(400)]
    base62 = "".join(chr(c) for c in (*range(48, 58), *range(65, 91), *range(97, 123)))
    keys = ["".join(rng.choice(base62) for _ in range(40)) for _ in range(30)]
    keys += ["".join(rng.choice(base62 + "+/") for _ in range(64)) for _ in range(10)]
    texts = []
    for i in range(200):
        w = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        if i < len(keys):
            w.insert(rng.randint(0, len(w)), keys[i])
        texts.append("é " + " ".join(w))
    texts += [texts[0]] * 40                                                           # copies
    texts += [None, "", "password=short", "PassWord: 'longenough1'", "tokeN = \"AKIAABCDEFGHIJKL\"", "api_key=apikey=12345678",
              "AKIAAKIAAKIA AKIA1234567890123", "0" * 40, "deadbeef" * 4 + "x", "paſſword=longenough", "toKen=longenough",
              "secret==abcdefgh token=abc token=abcdefgh.", "漢 secret:  x" + "a" * 50, "4929123412341234", "a" * 50_000,
              "-" * 30, "x" * 15, "=" * 40, "A_b-" * 8 + "+/", "token=" + "f" * 40 + " " + "0123456789abcdef" * 3]
    return texts, keys


def test_op12(spark, tmp_path):
    texts, keys = secret_texts()
    rows = [(i, t, "en", None, None) for i, t in enumerate(texts)] + [(None, texts[1], "en", None, None), (3, texts[3], "en", None, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = Q["op12_secret_scan"](spark, str(tmp_path)).collect()
    expected = []
    for r in rows:
        spans = base_spans(r[1] or "")
        n = [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]
        expected.append((r[0], *n, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    same([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out], expected)
    found, plain = set(), 0
    by_id = {r[0]: r[1] for r in rows}
    for r in out:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [int(s[1]) for s in spans] == sorted(int(s[1]) for s in spans)
        assert [":".join(s) for s in spans if s[0] != "random"] == base_spans(by_id[r.doc_id] or "")
        for kind, start, end in spans:
            if kind == "random":
                text = by_id[r.doc_id][int(start):int(end)]
                found.add(text)
                plain += text not in keys
    assert len(found & set(keys)) >= 36 and plain == 0


def test_battery():
    rng = np.random.default_rng(2)
    for k in (16, 32, 62, 64):
        levels = [secrets.battery(rng.integers(0, k, 60), k)[1] for _ in range(400)]
        assert 0.3 < np.mean(levels) < 0.65 and np.mean(np.array(levels) < 0.01) < 0.05
        assert secrets.battery(np.arange(60) % k, k)[1] < secrets.RANDOM                # sorted: no random order
        assert secrets.battery(np.zeros(60, np.int64), k)[1] < secrets.RANDOM
    shares = np.array([0.4, 0.3, 0.2, 0.1])
    draws = [np.bincount(rng.choice(4, 50, p=shares), minlength=4) for _ in range(4000)]
    pairs = np.array([(d * (d - 1) // 2).sum() for d in draws])
    for at in (0.05, 0.2, 0.5):
        c = int(np.quantile(pairs, at))
        assert abs(secrets.ordinary_level(c, 50, shares) - (pairs <= c).mean()) < 0.08


def test_limits():
    rng = random.Random(4)
    levels = [rng.random() for _ in range(500)] + [10 ** rng.uniform(-9, -4) for _ in range(40)]
    bins = Counter(map(secrets.level_bin, levels))
    limit = secrets.limits({("x", 1): bins})[("x", 1)]
    assert secrets.limits({("x", 1): Counter(map(secrets.level_bin, levels[:500]))}).get(("x", 1), 999) > 60
    taken = [x for x in levels if secrets.level_bin(x) >= limit]
    assert len(taken) >= 38 and max(taken) * len(levels) <= 0.012 * len(taken) * 1.2
    assert secrets.encoding_of("0123456789012345") is None and secrets.encoding_of("a-b+c" * 4) is None
    assert secrets.encoding_of("deadbeef")[0] == "hex" and secrets.encoding_of("Zz9_" * 5)[0] == "base64url"


# ------------------------------------------------------------------- op13
def phrases(rows, least=30, top=2000):
    count, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    count[lang][tuple(w[i:i + size])] += 1
    out = []
    for lang, f in count.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in often.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


def phrase_rows():
    rng = random.Random(6)
    vocab = ["New", "york", "city", "the", "of", "é", "\x01a", "a\x00", "ſ", "漢字", "x-y", "'", "\x1c", "\x7f", "of", "the"]
    fixed = ["New York city hall", "new\tyork  city", "kind of", "the \x01a a\x00 ſ", "of the of the", "a b\x85c d e f g"]
    rows = []
    for i in range(3000):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 6)))
                 for _ in range(rng.randint(1, 12))]
        rows.append((i, "".join(p + rng.choice([". ", ",", " ", "\n", "\r", "\x0b", "\x0c", ";x", ":", "!", "?", " \t"]) for p in parts),
                     rng.choice(["en", "en", "en", "de", None, "und", ""]), "s", 0))
    rows += [rows[3]] * 40 + [(None, None, "en", None, None), (1, "", None, None, None), (2, " ".join(["again"] * 20_000), "en", "", 1)]
    return rows


def test_op13(spark, tmp_path):
    rows = phrase_rows()
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    expected = phrases(rows)
    assert len(expected) > 150 and len({e[0] for e in expected}) == 4, len(expected)
    same(Q["op13_collocations"](spark, str(tmp_path)).collect(), expected)


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 3, 4, 5, 6, 7, 8]])
def test_walk_over_ranges(cuts):
    rows = [("de", (), 9), ("de", ("a",), 4), ("en", (), 50), ("en", ("a",), 20), ("en", ("a", "b"), 9), ("en", ("a", "b", "c"), 8),
            ("en", ("a", "d"), 10), ("en", ("b",), 12)]
    known = {(lang, w): f for lang, w, f in rows}
    out = {}
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        part = rows[lo:hi]
        if part:
            lang, w, _ = part[0]
            start = [(lang, w[:k], known[lang, w[:k]]) for k in range(len(w))]
            for lang, w, f, parts, longer in collocations.walk(iter(part), start):
                old = out.get((lang, w), (None, [], 0))
                out[lang, w] = (old[0] if f is None else f, max(old[1], parts), max(old[2], longer))
    assert out["en", ("a", "b", "c")] == (8, [50, 20, 9], 0) and out["en", ("a", "b")] == (9, [50, 20], 8)
    assert out["en", ("a",)] == (20, [50], 10) and out["en", ()] == (50, [], 20) and out["de", ()] == (9, [], 4)


def test_full_filter_changes_nothing(spark, monkeypatch):
    """Where the filter is so small that it lets nearly everything through, counts stay the same."""
    df = spark.createDataFrame(phrase_rows(), DOCS).select("lang", "text")
    wide = sorted(map(tuple, collocations.collocations(df).collect()), key=str)
    monkeypatch.setattr(collocations, "FILTER_BITS", 6)
    assert sorted(map(tuple, collocations.collocations(df).collect()), key=str) == wide


def test_clashing_document_columns(spark):
    """Columns that the operators use inside pass through or are not read; those that they add are replaced."""
    rows = [(1, "token=abcdefgh12 the end", "x", 5, "y"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _fixed string, secrets int, _tested string")
    out = secrets.find_secrets(df)
    assert out.columns == ["doc_id", "text", "_fixed", "_tested", "secrets"]
    got = {r.doc_id: r for r in out.collect()}
    assert (got[1]._fixed, got[1]._tested) == ("x", "y") and [tuple(s)[:3] for s in got[1].secrets] == [(0, 16, "assign")]
    assert got[None].secrets == []
    assert secrets.find_secrets(df, carry=["doc_id"]).columns == ["doc_id", "secrets"]
    rows = [("a b", None, 7, "z", 1)] * 40
    df = spark.createDataFrame(rows, "text string, lang string, words int, phrase string, f int")
    assert [tuple(r) for r in collocations.collocations(df).collect()] == [("und", ["a", "b"], 40, 80, 40, 40, 1_000_000)]
    assert collocations.collocations(df, least=41).collect() == []
