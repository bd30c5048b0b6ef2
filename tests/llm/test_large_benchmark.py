"""Decontamination with a benchmark too large to broadcast, and with very long items."""
import random

from corpus import SCHEMA, lowered, same
from tidewater.llm import common, decontaminate

COLUMNS = ("doc_id", "_text_hash", "n_words", "n_hit", "items", "contaminated")


def rows_of(df):
    return [tuple(map(str, r)) for r in df.select(*COLUMNS).collect()]


def test_shuffled_joins_give_the_same(spark, tables, monkeypatch):
    docs, bench = (common.read(spark, tables[0], t) for t in ("documents", "benchmark"))
    few = rows_of(decontaminate.contamination(docs, bench))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same(rows_of(decontaminate.contamination(docs, bench)), few)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert any(r[-1] == "True" for r in few)


def test_long_items(spark):
    """Pieces lose no window, also at their edges; a window that stands twice in an item; repeats in a document."""
    rng = random.Random(5)
    item = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    item[7000:7040] = item[100:140]
    edge = decontaminate.PIECE * 9
    texts = [item[edge - 12:edge + 1], item[edge - 6:edge + 7], item[edge:edge + 13], item[edge - 11:edge + 1],
             item[5000:5600] * 2, ["x"] * 30 + item[100:140] + ["y"] * 400, item[-13:], item[:12], item]
    docs = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]
    bench = [("long", " ".join(item)), ("part", " ".join(item[5100:5200])), ("short", "x x"), ("none", None)]
    out = decontaminate.contamination(spark.createDataFrame(docs, SCHEMA),
                                      spark.createDataFrame(bench, "item_id string, text string")).collect()
    windows = {}
    for name, text in bench:
        w = (text or "").split()
        for s in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[s:s + 13]), set()).add(name)
    expected = []
    for i, text, *_ in docs:
        w, at, items = lowered(text).split(), set(), set()
        for n in (2, 13):
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    at |= set(range(s, s + n))
                    items |= windows[tuple(w[s:s + n])]
        expected.append((i, len(w), len(at), str(sorted(items))))
    same([(r.doc_id, r.n_words, r.n_hit, str(r["items"])) for r in out], expected)
