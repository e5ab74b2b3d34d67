"""The pipeline: each stage takes the documents that its predecessor kept, whatever is in them."""

import os
import random

import numpy as np
import pytest
import xxhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    from tramline.llm import packing, quality, simhash, toxicity
    from tramline.llm.common import table, written

    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), "test")
        assert out.columns == docs.columns
        before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, out))
        assert after.keys() <= before.keys(), name
        if name == "quality classifier":
            assert after.keys() == {r["doc_id"] for r in quality.digest(docs, labels).where("kept").collect()}
        elif name == "toxicity":
            assert after.keys() == {r["doc_id"] for r in toxicity.digest(docs, labels).where("not toxic").collect()}
        elif name == "SimHash near-dedup":
            assert after.keys() == {r["component_id"] for r in simhash.digest(docs).collect()}
        else:
            assert all(after[i] == before[i] or len(after[i]) < len(before[i]) for i in after)
        docs = out
        sizes.append(len(after))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.4 * sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == sizes[-1] and packing.patterns({}, 8) == []


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _d string, p_toxic double, tail double, span int"
WORDS = ["".join(random.Random(i).choices("abcdefghiklmnoprstu", k=random.Random(i).randint(2, 8))) for i in range(900)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """(folder, rows): documents of every odd kind, and labels; columns whose names the operators use themselves."""
    near = prose(1, 80)
    passage = prose(2, 60)
    texts = [*(prose(100 + i, 40) for i in range(60)), near, near, near + " tail", prose(3, 30) + " " + passage, passage + " " + prose(4, 30), None, "", " \n", "one", "w " * 3000, prose(5, 9000)]
    texts += [f"vile filth scum {prose(200 + i, 25)}" for i in range(30)] + [f"!! $$ {i} ## %% " * 12 for i in range(30)]
    ids = list(range(len(texts)))
    rows = [(i, t, "en", "a", len(t or ""), "x", 0.5, 0.5, 1) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[61], rows[0], (0, prose(6, 50), "en", "a", 1, "x", 0.5, 0.5, 1), (None, prose(7, 50), "en", "a", 1, "x", 0.5, 0.5, 1)]
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    marks = [(i, int(not (t or "").startswith("!!")), int((t or "").startswith("vile"))) for i, t in zip(ids, texts, strict=True) if t and len(t) < 2000]
    spark.createDataFrame([*marks, (None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_stages_on_odd_documents(spark, odd):
    """Against brute force: what is planted for a model goes and nothing else; groups by all pairs of fingerprints; passages by all pairs of texts; pieces by the tokens."""
    from tramline.llm.common import table, written
    from tramline.llm.substring_dedup import shared_stretches, shingles

    path, _ = odd
    docs = table(spark, path, "documents")
    stages = dict(corpus_pipeline.STAGES)
    take = lambda df: [(r["doc_id"], r["text"], r["_d"], r["n_chars"]) for r in df.collect()]
    before = take(docs)

    kept = written(stages["quality classifier"](spark, docs, path), "q")
    assert kept.columns == docs.columns
    after = take(kept)
    assert not [t for _, t, *_ in after if (t or "").startswith("!!")] and sum((t or "").startswith("vile") for _, t, *_ in after) == 30
    assert sum(bool(t) and len(t.split()) == 40 for _, t, *_ in after) == sum(bool(t) and len(t.split()) == 40 for _, t, *_ in before)

    mild = written(stages["toxicity"](spark, kept, path), "t")
    assert sorted(take(mild), key=str) == sorted((x for x in after if not (x[1] or "").startswith("vile")), key=str) and mild.columns == docs.columns

    rows = take(mild)
    prints = [fingerprint(t) for _, t, *_ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root = [root[j] if x == root[i] else x for x in root]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(i)
    single = written(stages["SimHash near-dedup"](spark, mild, path), "s")
    got = take(single)
    assert len(got) == len(groups) and single.columns == docs.columns
    for members in groups.values():
        least = min((rows[i][0] is None, rows[i][0] or 0) for i in members)
        assert any((g[0] is None, g[0] or 0) == least and g in [rows[i] for i in members] for g in got)

    def own(t):
        raw = (t or "").encode()
        return shingles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0][: max(0, len((t or "").split()) - 4)]

    order = sorted(got, key=lambda x: (x[0] is not None, x[0] or 0))
    want = {}
    for j, (i, t, *_) in enumerate(order):
        gone = {p for _, a, *_ in order[:j] for s, e in shared_stretches(own(a), own(t), 46, 0.8) for p in range(s, e + 4)}
        words = (t or "").split()
        left = [w for k, w in enumerate(words) if k not in gone]
        if left or not gone:
            want[i, len(words)] = left
    cut = written(stages["substring dedup"](spark, single, path), "c")
    have = take(cut)
    assert cut.columns == docs.columns and sorted(" ".join((t or "").split()) for _, t, *_ in have) == sorted(" ".join(w) for w in want.values())
    assert all(n == len(t) for i, t, _, n in have if t is not None and (i, t) not in [(x[0], x[1]) for x in got])

    pieces = stages["packing"](spark, cut, path).collect()
    assert {p["doc_id"] for p in pieces} == {x[0] for x in have} and all(0 < p["length"] <= 4096 for p in pieces)
    total = {}
    for p in pieces:
        total.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["length"]))
    for (_, n), parts in total.items():
        assert sum(k for _, k in parts) % n == 0


def test_pipeline_of_nothing(spark, odd, tmp_path):
    path, _ = odd
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
