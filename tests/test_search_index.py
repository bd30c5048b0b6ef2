"""The inverted index against scores computed text by text, after updates and deletions."""
import math
import random
import re
import unicodedata
from collections import Counter

from tidewater.operators.search_index import build_index, search_index, update_index


def tokens(text):
    text = "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.combining(c)).lower()
    return [t for t in re.split(r"[^a-z0-9]+", text) if len(t) >= 3]


def model(docs, queries, k):
    counts = {i: Counter(tokens(t)) for i, t in docs.items()}
    df = Counter(t for c in counts.values() for t in c)
    out = set()
    for q in dict.fromkeys(queries):
        scored = []
        for i, c in counts.items():
            hit = [t for t in set(tokens(q)) if t in c]
            if hit:
                scored.append((-round(sum(c[t] * math.log10(len(docs) / df[t]) ** 2 for t in hit), 6), i, len(hit)))
        out |= {(q, i, round(-s, 5), n, place) for place, (s, i, n) in enumerate(sorted(scored)[:k], 1)}
    return out


def found(spark, root, queries, k):
    return {(r.query, r.id, round(r.score, 5), r.matched_terms, r.place) for r in search_index(spark, root, queries, "id", k, 8).collect()}


def test_index_and_updates(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["alpha", "Béta", "gamma", "delta", "x", "ab", "Omega9", "every"]
    docs = {i: " ".join([*rng.choices(vocab, k=rng.randint(0, 12)), "every"]) for i in range(60)}
    docs |= {60: None, 61: "", 62: "alpha " * 5000}
    queries = ["alpha beta", "OMEGA9, gamma!", "every", "x ab", "", "alpha beta", "unknown"]

    def frame(rows):
        return spark.createDataFrame(list(rows.items()), "id long, text string")

    root = f"{tmp_path}/index"
    build_index(frame(docs), "id", "text", root, 8)
    assert found(spark, root, queries, 7) == model(docs, queries, 7)
    changed = {3: "alpha gamma", 4: None, 70: "béta beta", 71: "newword every"}
    update_index(spark, root, frame(changed), "id", "text", spark.createDataFrame([(5,), (62,), (999,)], "id long"), 8)
    docs = {i: t for i, t in (docs | changed).items() if i not in (5, 62)}
    assert found(spark, root, [*queries, "newword"], 9) == model(docs, [*queries, "newword"], 9)
    update_index(spark, root, frame(changed), "id", "text", None, 8)       # the same again changes nothing
    assert found(spark, root, queries, 9) == model(docs, queries, 9)


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    build_index(none, "id", "text", f"{tmp_path}/i", 4)
    assert search_index(spark, f"{tmp_path}/i", ["alpha"], "id", 3, 4).collect() == []
    update_index(spark, f"{tmp_path}/i", spark.createDataFrame([(1, "alpha"), (2, "beta")], "id long, text string"), "id", "text", None, 4)
    assert [r.id for r in search_index(spark, f"{tmp_path}/i", ["alpha"], "id", 3, 4).collect()] == [1]


def test_postings_are_a_row_per_document_and_place(spark, tmp_path):
    """Not one per term; terms of any script keep their place; rows of one key add up."""
    from tidewater.sinks.target import read_bucketed
    rows = [(i, " ".join(f"w{i % 7}x{j} common" for j in range(500)) + " слово 漢字語 𐐨𐐨𐐨") for i in range(20)]
    rows += [(1, "common слово"), (50, " - "), (51, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    root = f"{tmp_path}/index"
    build_index(docs, "id", "text", root, 8)
    update_index(spark, root, docs.filter("id BETWEEN 5 AND 9"), "id", "text", docs.filter("id = 2"), 8)
    postings, documents = (read_bucketed(spark, f"{root}/{t}") for t in ("postings", "documents"))
    assert postings.groupBy("id", "place").count().count() <= 19 * 8 and postings.count() <= 20 * 8
    assert documents.count() == 22
    weight = math.log10(22 / 19) ** 2
    for query, tf in (("слово", 1), ("漢字語", 1), ("𐐨𐐨𐐨", 1), ("common", 500)):
        got = {r.id: r.score for r in search_index(spark, root, [query], "id", None, 8).collect()}
        want = {i: round(tf * weight, 6) for i in range(20) if i != 2}
        assert got == want | ({1: round((tf + 1) * weight, 6)} if query in ("слово", "common") else {})
