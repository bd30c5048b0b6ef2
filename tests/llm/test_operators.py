"""The operators' own interfaces: columns kept, clashing names, hot groups, several rounds, the pipeline."""
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpus import SCHEMA, join, lowered, same, words
from test_queries import components, item_hits
from tidewater.llm import (attention, common, decontaminate, licenses, line_dedup, lm, mixing, near_dedup, quality,
                           sharding, substring_dedup)


@pytest.fixture(scope="module")
def docs(spark, tables):
    return common.read(spark, tables[0], "documents")


def test_clashing_columns(spark, tables, docs):
    folder = tables[0]
    names = ("shard slot score n_words n_removed spans n_lines n_dropped n_known n_sentences licenses category found n_tokens "
             "taken size _th _t1 _size _rid node label").split()
    odd = docs.withColumns({n: F.lit(n) for n in names})
    bench, labels = common.read(spark, folder, "benchmark"), common.read(spark, folder, "labels")
    n = docs.count()
    assert sharding.shard_documents(odd).count() == n
    assert substring_dedup.dedup_substrings(odd).count() == n
    assert line_dedup.dedup_lines(odd).count() == n
    assert licenses.scan_documents(odd).count() == n
    assert quality.score_documents(odd, labels).count() == n
    assert lm.score_texts(odd, odd).count() == n
    assert near_dedup.dedup_near(odd).columns == odd.columns
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns
    assert mixing.mix_documents(odd).columns == odd.columns


def test_spans_tell_what_is_gone(docs):
    for r in substring_dedup.dedup_substrings(docs).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").collect():
        w = words(r.was)
        left = [x for i, x in enumerate(w) if not any(s["first"] <= i <= s["last"] for s in r.spans)]
        assert words(r.text) == left and r.n_words - r.n_removed == len(left)


def test_hot_groups_and_deeper_regions(spark, monkeypatch):
    """A group larger than a region is cut deeper and still linked, also where only its centre links."""
    rng = random.Random(4)
    monkeypatch.setattr(near_dedup, "REGION", 8)
    base = [f"w{i}" for i in range(120)]
    rows = [(1000, " ".join(base), "en", "s", 0)]
    for i in range(150):
        edit = base[:]
        for j in rng.sample(range(120), 3):
            edit[j] = f"x{i}y{j}"
        rows.append((i, " ".join(edit), "en", "s", 0))
    rows += [(2000 + i, " ".join(base[60:] + [f"z{i}v{k}" for k in range(60)]), "en", "s", 0) for i in range(30)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select(
        "doc_id", "n_shingles", "component_id", "kept").collect()
    same(found, components(rows))


def test_long_chain_of_links(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (500, 502)]
    random.Random(3).shuffle(edges)
    out = dict(near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {out[i] for i in range(201)} == {0} and {out[i] for i in (500, 501, 502)} == {500}


def test_shards_near_equal_with_a_hot_text(spark):
    rng = random.Random(9)
    rows = [(i, "hot " * 50, "en", "s", 0) for i in range(1500)]
    rows += [(5000 + i, f"{i} " * rng.randint(1, 120), "en", "s", 0) for i in range(3000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    size = Counter()
    for r in out:
        size[r.shard] += len(r.text.encode()) + 8
    mean = sum(size.values()) / 24
    assert len(size) == 24 and max(size.values()) < 1.05 * mean and min(size.values()) > 0.95 * mean


def test_line_runs_are_merged_by_level(spark):
    store = line_dedup.LineRuns()
    for b in range(7):
        store.add(spark.createDataFrame([(10 * b + d, h, h) for d in range(3) for h in range(b, b + 4)], "doc_id long, h1 long, h2 long"))
    assert [len(x) for x in store.levels] == [1, 2]
    assert {(r.h1, r["first"]) for r in store.table().collect()} == {(h, 10 * max(0, h - 3)) for h in range(10)}


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_do_not_matter(docs, batches):
    out = line_dedup.dedup_lines(docs.filter("doc_id IS NOT NULL"), batches).select("doc_id", "text", "n_dropped").collect()
    ref = line_dedup.dedup_lines(docs.filter("doc_id IS NOT NULL")).select("doc_id", "text", "n_dropped").collect()
    same(out, ref)


def test_mix_rows_are_what_counts_say(spark, docs):
    unique = docs.dropDuplicates(["doc_id"]).filter("doc_id IS NOT NULL")
    taken = {r.doc_id: r.taken for r in mixing.mix_counts(unique).collect()}
    out = Counter()
    for r in mixing.mix_documents(unique).collect():
        out[r.doc_id] += len(words(r.text))
    assert {k: v for k, v in taken.items() if v} == dict(out)


def test_quality_learns_held_out_labels(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(800):
        bad = i % 4 == 0
        ws = [rng.choice("alpha beta gamma delta epsilon".split()) + ("###" if bad else "") for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(ws), "en", "s", 0))
        labels.append((i, int(not bad), 0))
    d, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.score_documents(d, lab).join(lab, "doc_id").collect()
    assert sum((r.score >= 0.7) == (r.quality == 1) for r in out) >= 0.97 * len(out)


def test_attention_gradients():
    """Analytic gradients against differences, and scoring against the training pass."""
    import numpy as np
    rng = np.random.default_rng(1)
    c = attention.Classes(rng.integers(0, 50, 60).astype(float), 40, 8)
    m = attention.Model(c, 6, 4, 2)
    m.p = {n: x.astype(np.float64) for n, x in m.p.items()}
    ids, lengths = rng.integers(0, 60, 23).astype(np.int32), np.array([9, 0, 1, 13])
    before, own, target, place = attention.blocks(ids, lengths, c.row, 4)
    classes = np.where(target >= 0, c.of[np.maximum(target, 0)], -1)

    def loss():
        m.tables()
        p = m.log10(before, own, target) - np.where(target >= 0, c.within[np.maximum(target, 0)], 0)
        return -(p * np.log(10))[target >= 0].mean()

    g = m.gradients(before, own, classes)
    for name in m.p:
        flat = m.p[name].reshape(-1)
        for i in rng.choice(flat.size, 4):
            if name == "e" and i < m.dims:
                continue  # the padding row
            was = flat[i]
            flat[i] = was + 1e-3
            up = loss()
            flat[i] = was - 1e-3
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-3 - g[name].reshape(-1)[i]) < 2e-3, name
    assert sorted(place[place >= 0]) == list(range(23))
    total = sum(10.0 ** float(x) for x in _distribution(m, c, before[:1], own[:1]))
    assert abs(total - 1) < 1e-3


def _distribution(m, c, before, own):
    import numpy as np
    out = []
    for i in range(60):
        target = np.full(own.shape, -1, np.int32)
        target[0, 0] = i
        out.append(m.log10(before, own, target)[0, 0])
    return out


def test_model_beats_counts_on_held_out_text(spark):
    rng = random.Random(8)
    langs = [["".join(rng.choice(a) for _ in range(4)) for _ in range(60)] for a in ("abcd", "efgh", "ijkl")]
    rows = [(i, " ".join(rng.choice(langs[i % 3]) for _ in range(40)), "en", "s", 0) for i in range(600)]
    d = spark.createDataFrame(rows, SCHEMA)
    out = lm.score_texts(d.filter("doc_id >= 500"), d.filter("doc_id < 500")).collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


APACHE = b"""   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""


def test_published_apache_notice():
    """With the blank lines around its address; one sentence ends in a long run of marks."""
    assert {m[:2] for m in licenses.scan(APACHE)[2]} == {("Apache-2.0", "permissive")}
    assert [m[0] for m in licenses.scan(b"Released under the MIT License" + b" -" * 30)[2]] == ["MIT"]


def test_words_are_laid_out_once(monkeypatch):
    """Not in every step of the word model again; every occurrence is fitted."""
    import numpy as np
    rng = np.random.default_rng(4)
    size = rng.integers(1, 7, 2000)
    spell = rng.integers(0, 300, size.sum()).astype(np.int32)
    ids, lengths = rng.integers(0, 300, 2000).astype(np.int32), np.full(50, 40)
    blocks = attention.blocks(ids, lengths, np.arange(lm.IDS) + 2, lm.BLOCK)
    packed = lm.packed_blocks(*blocks[:3], np.flatnonzero(blocks[3].ravel() >= 0) // lm.BLOCK, spell, size).to_pylist()
    counts = np.bincount(spell, minlength=lm.IDS)
    models = tuple(attention.Model(attention.Classes(counts, c), d, b, 1) for (c, d), b in zip(lm.SETTINGS, (lm.BLOCK, lm.WORD_BLOCK)))
    laid, fitted, plain, step = [], [], lm.word_blocks, models[1].step
    monkeypatch.setattr(lm, "word_blocks", lambda *a: laid.append(1) or plain(*a))
    monkeypatch.setattr(models[1], "step", lambda b, o, y, rate, state, times: fitted.append(
        ((y >= 0).sum(axis=1) * times).sum()) or step(b, o, y, rate, state, times))
    lm._fit_blocks(models, ({}, {}), packed, (0.01, 0.01), 0)
    assert len(laid) == 1 < len(fitted) and round(sum(fitted)) == size.sum()


def test_model_is_fitted_on_every_block(spark, monkeypatch):
    """Of a corpus beyond 3 MB too; a block's words come back from its packed form."""
    class Seen(Exception):
        pass

    def train(samples, *_):
        raise Seen([r.block for r in samples.collect()])

    monkeypatch.setattr(lm, "train", train)
    rows = [(i, "words " * 20_000, "en", "s", 0) for i in range(30)]
    with pytest.raises(Seen) as seen:
        d = spark.createDataFrame(rows, SCHEMA)
        lm.score_texts(d, d)
    blocks = seen.value.args[0]
    assert len(blocks) == 30 * -(-20_001 // lm.BLOCK)
    *_, target, _, size = lm.unpacked(blocks)
    assert (target >= 0).sum() == 30 * 20_001 and (target == lm.STOP).sum() == 30 and len(size) == 30 * 20_000


def test_pipeline_stages(spark, tables, docs):
    """Each stage against brute force on what the stage before kept."""
    folder, rows, bench, _ = tables
    labels = common.read(spark, folder, "labels")
    fields = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    good = common.shared_table(stages["quality"](spark, docs, folder), "t")
    scored = quality.score_documents(docs, labels).filter("score >= 0.7").select(*fields)
    same(good.collect(), scored.collect())
    good = common.shared_table(docs, "t")  # the next stages on all rows, whatever the classifier thinks
    single = common.shared_table(stages["near_dedup"](spark, good, folder), "t")
    assert single.columns == fields
    kept = [tuple(r) for r in single.collect()]
    comp = components(rows)
    worded = {r[2] for r, row in zip(comp, rows) if words(row[1])}
    assert sorted(r[0] for r in kept if words(r[1])) == sorted(worded)
    assert Counter(r[0] for r in kept if not words(r[1])) == Counter(r[0] for r in rows if not words(r[1]))
    clean = common.shared_table(stages["decontamination"](spark, single, folder), "t")
    bad = {(e[0], r[1]) for e, r in zip(item_hits(kept, bench), kept) if e[5]}
    same(clean.collect(), [r for r in kept if (r[0], r[1]) not in bad])
    mixed = common.shared_table(stages["mixing"](spark, clean, folder), "t")
    assert mixed.columns == fields
    taken = {(r.doc_id): r.taken for r in mixing.mix_counts(clean).collect() if r.taken}
    out = Counter()
    for r in mixed.collect():
        out[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert dict(out) == taken
    final = corpus_pipeline.run(spark, folder)
    shards = defaultdict(list)
    for r in final.collect():
        shards[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    same(stages["sharding"](spark, mixed, folder).select(*fields).collect(), mixed.collect())


def test_word_hashes_match_words():
    rng = random.Random(2)
    texts = [join(rng, ["w%d" % rng.randint(0, 99) for _ in range(n)]).encode() for n in (0, 1, 5, 400)] + [b"", b" \n", b"\xc2\xa0x y"]
    h, at = common.word_hashes(texts)
    flat = [w for t in texts for w in words(t.decode())]
    assert len(h) == len(flat) and list(at) == [0, *[sum(len(words(t.decode())) for t in texts[:i + 1]) for i in range(len(texts))]]
    seen = {}
    for w, x in zip(flat, h):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    small = common.SLICE_BYTES
    try:
        common.SLICE_BYTES = 16
        again, _ = common.word_hashes(texts)
    finally:
        common.SLICE_BYTES = small
    assert (again == h).all()
    assert lowered("ÀB") == "Àb"
