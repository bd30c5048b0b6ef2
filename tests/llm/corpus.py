"""A small corpus with every awkward case, and brute-force helpers over it."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WHITE = [" ", " ", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r\n"]


def words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def join(rng: random.Random, ws: list[str]) -> str:
    return "".join(w + rng.choice(WHITE) for w in ws).rstrip(" ") if ws else ""


def corpus(seed: int = 1) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(documents, benchmark, labels) rows; ids are unique but for one repeated row and one null."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéöß漢T") for _ in range(rng.randint(1, 7))) for _ in range(500)]
    vocab += ["It's", "x-1", "a b", "\x1c", "ÉCOLE", "Q9", "end.", "*", "K"]

    def some(n: int) -> list[str]:
        return [rng.choice(vocab) for _ in range(n)]

    texts: list[list[str] | str | None] = [some(rng.randint(1, 120)) for _ in range(60)]
    base = some(150)
    texts += [base[:] for _ in range(9)]                                     # exact copies
    for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12):                            # near copies around the threshold
        edit = base[:]
        for i in rng.sample(range(150), k):
            edit[i] = rng.choice(vocab)
        texts.append(edit)
    passage = some(55)
    texts += [some(rng.randint(0, 30)) + passage + some(rng.randint(0, 30)) for _ in range(6)]
    texts += [some(10) + passage[:34] + some(3), some(4) + passage[20:] + some(5), passage[:35]]
    texts.append(["rep"] * 90 + some(5))
    texts.append((some(7) + ["again"]) * 12)
    items = [some(n) for n in (30, 14, 13, 12, 2, 1)] + [vocab[:20]]
    for item in items[:5]:
        texts.append(some(25) + item + some(20))
        texts.append(item[:13])
    texts.append([w.swapcase() if w.isascii() else w for w in items[0]])
    docs = [None if t is None else join(rng, t) if isinstance(t, list) else t for t in texts]
    line = "This line is in many documents."
    docs += [f"{line}\n{join(rng, some(9))}\n  {line.upper()}\t\nshort\nshort" for _ in range(4)]
    docs += ["All rights reserved.\nHello there you. Released under the MIT License.", None, "", " \n\t", "one", "ONE", "One"]
    docs += [docs[60].upper() if docs[60].isascii() else docs[60].replace(" ", "  ")]
    docs.append(" ".join(some(30_000)))                                      # very long
    ids = rng.sample(range(-50, 5000), len(docs))
    rows = [(i, t, "en", rng.choice(["src0", "src0", "src0", "src1", "é", "z", None]), None if t is None else len(t))
            for i, t in zip(ids, docs)]
    rows.append(rows[3])
    rows.append((None, docs[5], None, "src1", None))
    bench = [(i, join(rng, item)) for i, item in enumerate(items)] + [(50, None), (51, "--"), (2, join(rng, items[0]))]
    junk = rng.sample(range(len(docs)), 30)
    labels = [(rows[j][0], j % 2, 0) for j in junk] + [(rows[0][0], None, 1), (None, 1, 0), (99_999, 0, 0)]
    rng.shuffle(rows)
    return rows, bench, labels


def write(spark, folder: str, rows, bench, labels) -> str:
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def key(row) -> tuple:
    return tuple((x is None, str(x)) for x in row)


def same(found, expected) -> None:
    found, expected = sorted(map(tuple, found), key=key), sorted(map(tuple, expected), key=key)
    assert len(found) == len(expected)
    assert [(f, e) for f, e in zip(found, expected) if f != e][:3] == []
