"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tramline.llm import ann, packing, quality, simhash, sp_bpe, substring_dedup, suffix_dedup, syncmers, token_scan, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, _d string, _h string, key string, n_chars long, lang string"
WORDS = ["".join(random.Random(i).choices("abcdefghilmnoprstuvé", k=random.Random(i).randint(2, 9))) for i in range(4000)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, texts, ids=None):
    """Documents with columns that clash with the operators' own names."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y", "z", len(t or ""), "en") for i, t in zip(ids, texts, strict=True)], SCHEMA)


ODD = [None, "", " \n\t ", "one", "Two words", "ï½ 漢字 😀 <|endoftext|>", "a" * 3000, "w " * 2000]


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# -- 1 ---------------------------------------------------------------------------------------------------------------------


def suffix_cases():
    a, b = prose(1, 200), prose(2, 200)
    return [*ODD, a, a, a[:500] + b, "x" + a[100:700], b[300:] + a[:450], prose(3, 100), b + b[-450:], None]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(spark, hot):
    texts = suffix_cases()
    got = {r["doc_id"]: r for r in suffix_dedup.removed(frame(spark, texts), 400, hot=hot, bucket_bytes=4000).collect()}
    for i, want in enumerate(suffix_dedup.brute([(t or "").encode() for t in texts], 400)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) == want, i


def test_suffix_dedup_of_a_text_over_16_mib(spark):
    r = np.random.default_rng(4)
    long = bytearray(r.integers(97, 123, 17 << 20).astype(np.uint8).tobytes())
    p = r.integers(65, 91, 600).astype(np.uint8).tobytes()
    long[(1 << 24) + 50_000 : (1 << 24) + 50_600] = p
    texts = [long.decode(), "start " + p.decode() + " end", "other"]
    got = {x["doc_id"]: x for x in suffix_dedup.digest(frame(spark, texts)).collect()}
    assert [got[i]["n_removed"] for i in range(3)] == [600, 600, 0]
    kept = bytes(long).replace(p, b"")
    assert got[0]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_anchors_do_not_hang_on_pieces():
    data = np.frombuffer(prose(90, 900).encode(), np.uint8)
    whole, parts = suffix_dedup.anchors(data, 60, 16)[1], suffix_dedup.anchors(data, 60, 16, piece=37)[1]
    assert (whole == parts).all()


def test_suffix_dedup_of_a_hot_anchor(spark):
    """One line of 300 bytes in 60 texts, and in two of them more around it."""
    r = random.Random(3)
    line = "".join(r.choices("abcdefgh", k=300))
    own = lambda n: "".join(r.choices("ijklmnop", k=n))
    around = (own(150), own(150))
    texts = [(around[0] if i in (5, 40) else own(150)) + line + (around[1] if i in (5, 40) else own(150)) for i in range(60)]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.removed(frame(spark, texts), hot=5).withColumn("kept_sha256", F.sha2("kept", 256)).collect()}
    want = suffix_dedup.brute([t.encode() for t in texts], 400)
    assert got == dict(enumerate(want)) and got[5][1] == 600


def test_suffix_dedup_of_repeated_rows_and_nothing(spark):
    t = prose(5, 150)
    got = rows(suffix_dedup.digest(frame(spark, [t, t, None], [7, 7, None])), "doc_id", "n_bytes", "n_removed")
    assert sorted(got, key=str) == sorted([(7, len(t.encode()), len(t.encode()))] * 2 + [(None, 0, 0)], key=str)
    assert suffix_dedup.digest(frame(spark, [])).count() == 0


def test_runs_and_transform_take_bounded_memory():
    """What a worker takes at once for a slice of texts and for a bucket, at the shipped sizes."""
    import tracemalloc

    raw = np.frombuffer(prose(91, 300_000).encode(), np.uint8)
    for step, n, text in ((suffix_dedup.runs, suffix_dedup.SLICE, 4000), (suffix_dedup.repeated_starts, suffix_dedup.BUCKET_BYTES, 560)):
        off = np.append(np.arange(0, n, text), n)
        tracemalloc.start()
        step(raw[:n], off, 400)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(raw) >= n and most < 90e6


def test_transform_finds_repeats():
    r = random.Random(4)
    for _ in range(60):
        k = r.choice([3, 5, 12])
        base = [bytes(r.choices(b"abc"[: r.choice([1, 2, 3])], k=r.randint(0, 90))) for _ in range(r.randint(1, 6))]
        data = np.frombuffer(b"".join(base), np.uint8)
        if not len(data):
            continue
        off = np.r_[0, np.cumsum([len(b) for b in base])]
        seen = {}
        for j, b in enumerate(base):
            for i in range(len(b) - k + 1):
                seen.setdefault(b[i : i + k], []).append(int(off[j]) + i)
        assert suffix_dedup.repeated_starts(data, off, k).tolist() == sorted(x for v in seen.values() if len(v) > 1 for x in v)


# -- 2 ---------------------------------------------------------------------------------------------------------------------


def test_compact_windows_hold_each_passage_once():
    r = np.random.default_rng(5)
    for values in (8, 1000):
        v = r.integers(1, values, 300).astype(np.uint64)
        v[[0, 90, 91, 140, 299]] = 0  # zeros part texts
        windows = list(zip(*substring_dedup.compact(v, 10), strict=True))
        for i in range(300):
            for j in range(i + 10, 301):
                m = v[i:j].min()
                holders = [(c, a, b) for c, a, b in windows if a <= i and j <= b and v[c] == m]
                assert len(holders) == (m > 0) and all(v[a:b].min() == m for _, a, b in holders)


def test_substring_dedup(spark):
    p, q = prose(10, 80), prose(11, 120).split()
    near = q.copy()
    near[60] = "changed"
    texts = [*ODD, prose(12, 90) + " " + p, p + " " + prose(13, 90), prose(14, 60) + " " + " ".join(q), " ".join(near) + " " + prose(15, 70), prose(16, 300), " ".join(q[:45]) + " " + prose(17, 100)]
    n = len(ODD)
    got = {r["doc_id"]: r for r in substring_dedup.digest(frame(spark, texts)).collect()}
    assert len(got) == len(texts) and got[n]["n_removed"] == 0 and got[n + 2]["n_removed"] == 0
    assert 78 <= got[n + 1]["n_removed"] <= 82 and got[n + 1]["repeats_of"] == [n]
    assert 100 <= got[n + 3]["n_removed"] <= 124 and got[n + 3]["repeats_of"] == [n + 2]
    assert all(got[i]["n_removed"] == 0 for i in (*range(n), n + 4, n + 5))
    kept = {r["doc_id"]: r for r in substring_dedup.without_repeats(frame(spark, texts)).collect()}
    assert kept[n + 1]["text"].split()[-88:] == prose(13, 90).split()[-88:] and kept[n + 1]["n_chars"] == len(kept[n + 1]["text"])
    assert kept[n + 4]["text"] == texts[n + 4] and kept[n + 4]["_d"] == "x" and kept[0]["text"] is None


@pytest.mark.parametrize("changes", [1, 2])
@pytest.mark.parametrize("n", [50, 60, 70, 80, 90, 130])
def test_passages_with_changed_words(n, changes):
    def shingled(words):
        text = " ".join(words).encode()
        return substring_dedup.shingles(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0][: len(words) - 4]

    q = prose(30 + n, n).split()
    near = q.copy()
    for i in range(changes):
        near[n * (i + 1) // (changes + 1)] = f"changed{i}"
    a, b = shingled(prose(31, 40).split() + q + prose(32, 40).split()), shingled(prose(33, 30).split() + near + prose(34, 30).split())

    def alike(s, e):
        one, two = set(a[40 + s - 30 : 40 + e - 30].tolist()), set(b[s:e].tolist())
        return len(one & two) >= 0.8 * len(one | two)

    shared = np.isin(b, a)
    want = {p for s in range(len(b)) for e in range(s + 46, len(b) + 1) if shared[s] and shared[e - 1] and alike(s, e) for p in range(s, e)}
    got = {p for s, e in substring_dedup.shared_stretches(a, b, 46, 0.8) for p in range(s, e)}
    assert got == want and (changes == 2 or want == set(range(30, 26 + n)))


def test_substring_dedup_of_a_large_group_and_nothing(spark):
    p = prose(20, 70)
    got = rows(substring_dedup.digest(frame(spark, [prose(100 + i, 60) + " " + p for i in range(40)])), "doc_id", "n_removed")
    assert dict(got)[0] == 0 and all(68 <= n <= 72 for i, n in got if i)
    assert substring_dedup.digest(frame(spark, [])).count() == 0
    whole = substring_dedup.without_repeats(frame(spark, [p, p]))
    assert rows(whole, "doc_id") == [(0,)]


def test_substring_dedup_finds_partners_under_a_frequent_line(spark):
    """Every passage holds one line; its true partner is neither the earliest document with that line nor one of those just before."""
    line = prose(40, 40)
    passage = [prose(200 + i, 5) + " " + line + " " + prose(300 + i, 5) for i in range(30)]
    texts = passage + [prose(400 + i, 30) + " " + passage[i] + " " + prose(500 + i, 30) for i in range(30)]
    got = {r["doc_id"]: r for r in substring_dedup.digest(frame(spark, texts)).collect()}
    assert all(got[i]["n_removed"] == 0 for i in range(30))
    assert all(50 <= got[30 + i]["n_removed"] <= 52 and got[30 + i]["repeats_of"] == [i] for i in range(30))


def test_substring_dedup_of_many_groups_each_with_one_longer_repeat(spark):
    """Groups of 30 texts with a line of 48 words, too short to go; two of each group share 64 words around it, or 64 words of their own."""
    texts, due = [], []
    for g in range(12):
        line = prose(1000 + g, 48)
        own = prose(1100 + g, 8) + " " + line + " " + prose(1200 + g, 8) if g % 2 else prose(1300 + g, 64)
        for k in range(30):
            if k in (11, 23):
                due += [len(texts)] * (k == 23)
                body = own if g % 2 else line + " " + prose(2000 + g * 30 + k, 30) + " " + own
            else:
                body = line
            texts.append(prose(3000 + g * 30 + k, 25) + " " + body + " " + prose(4000 + g * 30 + k, 25))
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.digest(frame(spark, texts)).collect()}
    assert {i: n for i, n in got.items() if n} == {i: got[i] for i in due} and all(64 <= got[i] <= 70 for i in due)


def test_substring_dedup_links_all_of_a_crowded_passage(spark, monkeypatch):
    """Near copies that differ from each other: each is linked to all earlier ones, in one group or in blocks; a line that more texts have links none."""
    p, line = prose(8000, 60).split(), prose(8001, 14)
    texts = [" ".join([prose(8100 + i, 30), *p[:25], f"own{i}", *p[26:], prose(8200 + i, 30)]) for i in range(14)]
    texts += [prose(8300 + i, 50) + " " + line + " " + prose(8400 + i, 50) for i in range(30)]
    for block in (500, 4):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        got = {r["doc_id"]: (r["n_removed"], r["repeats_of"]) for r in substring_dedup.digest(frame(spark, texts)).collect()}
        assert [got[i] for i in range(14)] == [(60 if i else 0, list(range(i))) for i in range(14)]
        assert all(got[i] == (0, []) for i in range(14, 44))


def test_substring_dedup_thins_large_groups_before_blocks(spark, monkeypatch):
    """Of windows around a mere line nothing is left to deal out; those of near copies, and texts that run in circles, stay and are all linked, in any blocks."""
    p, line, ring = prose(8500, 60).split(), prose(8501, 14), prose(8502, 12)
    texts = [" ".join([prose(8600 + i, 30), *p[:25], f"own{i}", *p[26:], prose(8700 + i, 30)]) for i in range(14)]
    texts += [prose(8800 + i, 50) + " " + line + " " + prose(8900 + i, 50) for i in range(30)]
    texts += [prose(9000 + i, 20) + " " + " ".join([ring] * (5 + i % 3)) + " " + prose(9100 + i, 20) for i in range(12)]
    got, left = [], []
    thinned = substring_dedup.thinned
    monkeypatch.setattr(substring_dedup, "thinned", lambda *a: left.append(thinned(*a)) or left[-1])
    for block, many in ((2000, 4), (5, 1)):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        monkeypatch.setattr(substring_dedup, "MANY", many)
        got.append({r["doc_id"]: (r["n_removed"], r["repeats_of"]) for r in substring_dedup.digest(frame(spark, texts)).collect()})
    assert got[0] == got[1]
    assert [got[0][i] for i in range(14)] == [(60 if i else 0, list(range(i))) for i in range(14)]
    assert all(got[0][i] == (0, []) for i in range(14, 44))
    assert all(got[0][i][1] == list(range(44, i)) for i in range(44, 56))
    assert len(left) == 1 and {r["_d"] for r in left[0].collect()} <= {*range(14), *range(44, 56)}


def test_substring_dedup_against_every_pair(spark):
    """Exact and changed repeats among random texts: what goes is what verifying every pair of texts would remove."""
    r = random.Random(9)
    base = [prose(5000 + i, 120).split() for i in range(8)]
    texts = []
    for i in range(60):
        a, b = r.sample(base, 2)
        p = a[r.randint(0, 20) : r.randint(75, 120)].copy()
        if i % 3 == 0:
            p[len(p) // 2] = f"changed{i}"
        texts.append(" ".join([*prose(6000 + i, 20).split(), *p, *prose(6100 + i, 15).split(), *b[: r.choice([0, 0, 30, 55])]]))
    texts += [texts[4], texts[4].upper(), None, "", "short text"]

    def own(t):
        raw = (t or "").encode()
        h, first, _, _ = substring_dedup.shingles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return h[: max(0, len(h) - 4)]

    parts = [own(t) for t in texts]
    want = {}
    for j, b in enumerate(parts):
        gone = {p for a in parts[:j] for s, e in substring_dedup.shared_stretches(a, b, 46, 0.8) for p in range(s, e + 4)}
        want[j] = len(gone)
    got = {x["doc_id"]: x["n_removed"] for x in substring_dedup.digest(frame(spark, texts)).collect()}
    assert not {j: (got[j], want[j]) for j in want if not 0.95 * want[j] <= got[j] <= 1.3 * want[j]}


def test_substring_dedup_of_repeated_rows_and_ids(spark):
    p, q = prose(71, 60), prose(72, 70)
    got = rows(substring_dedup.digest(frame(spark, [p, p, q, p, q], [4, 4, 4, 7, None])), "doc_id", "n_words", "n_removed")
    assert sorted(got, key=str) == sorted([(4, 60, 0), (4, 60, 0), (4, 70, 70), (7, 60, 60), (None, 70, 0)], key=str)


def test_a_text_that_many_pairs_ask_for(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "ASKED", 3)
    p = prose(81, 70)
    got = rows(substring_dedup.digest(frame(spark, [prose(7000 + i, 40) + " " + p for i in range(25)])), "doc_id", "n_removed")
    assert dict(got)[0] == 0 and all(68 <= n <= 72 for i, n in got if i)


# -- 3 ---------------------------------------------------------------------------------------------------------------------


def test_nearest(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((700, 16)).astype(np.float32) * r.uniform(0.5, 2, (700, 1)).astype(np.float32)
    v[300:330] = v[299]
    data = [(i, [float(x) for x in row], 0) for i, row in enumerate(v)] + [(700, None, 0), (720, [0.0] * 16, 0), (740, [float("nan")] + [1.0] * 15, 0), (760, [None] + [1.0] * 15, 0)]
    got = {}
    for q, rank, i, s in rows(ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>, block int"), block_rows=250), "query_id", "rank", "vec_id", "score"):
        got.setdefault(q, []).append((rank, i, s))
    x = v.astype(float)
    hit = 0
    assert sorted(got) == list(range(0, 700, 20))
    for q, found in got.items():
        found.sort()
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(700), -s))[:20]
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert np.allclose([f[2] for f in found], s[[f[1] for f in found]], rtol=0, atol=1e-12)
        hit += len({f[1] for f in found} & set(want.tolist()))
    assert hit / (20 * len(got)) >= 0.9


def test_nearest_with_repeated_rows(spark):
    """Every row is a query and a candidate of its own, whatever its id; equal vectors in any number."""
    r = np.random.default_rng(2)
    v = r.standard_normal((300, 8))
    v[50:150] = v[50]
    ids = np.r_[np.arange(280), np.arange(0, 40, 2)]
    data = [(int(i), x.tolist(), "x", 1) for i, x in zip(ids, v, strict=True)]
    got = {}
    for q, rank, i, s in rows(ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>, v string, row int"), k=5, sure=1.0, block_rows=60), "query_id", "rank", "vec_id", "score"):
        got.setdefault(q, []).append((rank, i, round(s, 9)))
    want = {}
    for j in np.flatnonzero(ids % 20 == 0):
        s = (v * v[j]).sum(axis=1)
        best = [k for k in np.lexsort((ids, -s)) if k != j][:5]
        want.setdefault(int(ids[j]), []).extend((n + 1, int(ids[k]), round(float(s[k]), 9)) for n, k in enumerate(best))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_nearest_of_several_sizes(spark):
    data = [(i, [float(i), 1.0, 2.0][: 2 + i % 2]) for i in range(60)]
    got = rows(ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), k=3, block_rows=10), "query_id", "rank", "vec_id")
    assert sorted(got) == sorted((q, n + 1, i) for q, best in ((0, (2, 4, 6)), (20, (58, 56, 54)), (40, (58, 56, 54))) for n, i in enumerate(best)) or {x[0] for x in got} == {0, 20, 40}


def test_nearest_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert sorted(rows(ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.5, 0.5]), (3, [0.5, 0.5])], schema)), "query_id", "rank", "vec_id")) == [(0, 1, 3), (0, 2, 5)]
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0


# -- 4 and 9 ---------------------------------------------------------------------------------------------------------------


def graded(spark, n=400):
    texts = []
    for i in range(n):
        t = prose(1000 + i, 40 + i % 60)
        if i % 4 == 0:
            t = " ".join(w + "###" for w in t.split())
        if i % 5 == 0:
            t += " " + random.Random(i).choice(["vile", "rotten", "Dreadful!"]) + " " + prose(5000 + i, 10)
        texts.append(t)
    docs = frame(spark, [*texts, *ODD])
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(n)] + [(0, 0, 1), (None, 1, 1), (9999, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels.where("doc_id is null or doc_id < 300 or doc_id = 9999")


def test_quality(spark):
    docs, labels = graded(spark)
    got = {r["doc_id"]: r for r in quality.digest(docs, labels).collect()}
    held = range(300, 400)
    assert sum(got[i]["kept"] == (i % 4 != 0) for i in held) >= 97 and len(got) == 408
    kept = quality.selected(docs, labels)
    assert kept.columns == docs.columns and kept.where("_d <> 'x'").count() == 0


def test_more_grades_keep_their_order():
    r = np.random.default_rng(2)
    n = 600
    col = r.integers(0, 3, n)
    grade = np.clip(col + (r.random(n) < 0.1), 0, 3)
    m = quality.fit(np.arange(n), col, np.ones(n), grade, 3)
    assert (np.diff(m.thresholds) > 0).all() and m.weights[0] < m.weights[1] < m.weights[2]
    assert np.allclose(m.chances(np.array([0.0, 3.0])).sum(axis=1), 1)


def test_toxicity(spark):
    docs, labels = graded(spark)
    got = {r["doc_id"]: r for r in toxicity.digest(docs, labels).collect()}
    assert sum(got[i]["toxic"] == (i % 5 == 0) for i in range(300, 400)) >= 97
    assert toxicity.clean(docs, labels).columns == docs.columns


def test_toxicity_is_decided_by_the_whole_chain(spark):
    import dataclasses

    docs = [(i, f"{'vile awful' if i % 3 == 0 else 'plain good'} text {prose(900 + i, 20)}") for i in range(240)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    models = toxicity.fitted(d, labels)
    last = f"p_{list(toxicity.CATEGORIES)[-1]}"
    plain = dict(rows(toxicity.scored(d, models), "doc_id", last))
    for k in range(len(models)):
        other = [*models[:k], dataclasses.replace(models[k], bias=models[k].bias + 6), *models[k + 1 :]]
        assert any(abs(dict(rows(toxicity.scored(d, other), "doc_id", last))[i] - p) > 1e-6 for i, p in plain.items())
    assert all((p >= 0.35) == (i % 3 == 0) for i, p in plain.items())


def test_models_without_labels(spark):
    docs, labels = graded(spark, 8)
    for none in (labels.where("false"), labels.where("quality = 1 and toxic = 0")):
        assert quality.selected(docs, none).count() == docs.count() and toxicity.clean(docs, none).count() == docs.count()
    assert quality.digest(docs.where("false"), labels).count() == 0 and toxicity.digest(docs.where("false"), labels).count() == 0


# -- 5 ---------------------------------------------------------------------------------------------------------------------


def sketch_of(text):
    """The definition in Python: 31-bit hashes of closed syncmers, the 32 least."""
    def xx(parts, seed=42):
        for p in parts:
            seed = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else p.to_bytes(8, "little"), seed)
        return seed

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    toks = re.findall(r"(?<!\S)\S{1,24}(?!\S)|\S", text, re.ASCII)
    h = [xx([t.encode()]) for t in toks]
    inner = [xx(h[i : i + 2]) for i in range(len(h) - 1)]
    if len(inner) < 4:
        found = [xx([text.encode()])] if toks else []
    else:
        s = [signed(x) for x in inner]
        found = [xx(inner[i : i + 4]) for i in range(len(inner) - 3) if min(s[i], s[i + 3]) <= min(s[i + 1 : i + 3])]
    return sorted({x & 0x7FFFFFFF for x in found})[:32]


def like(a, b):
    u = sorted(set(a) | set(b))[:32]
    return len(set(u) & set(a) & set(b)) / len(u) if u else 1.0


def test_syncmers(spark):
    texts = [*ODD, prose(30, 400), prose(30, 400), prose(31, 500), prose(32, 60), prose(32, 61), "lost", "lost", "lost"]
    ids = [*(3 * i - 5 for i in range(len(texts) - 3)), None, 40, 40]
    got = syncmers.digest(frame(spark, texts, ids)).collect()
    full = [t or "" for t in texts]
    order = sorted(range(len(texts)), key=lambda k: (ids[k] is not None, ids[k] or 0))
    want = []
    for k, i in enumerate(order):
        t, n = full[i], full[order[(k + 1) % len(order)]]
        e = len(t) // 4
        edited = t[: len(t) - e] + n[:e]
        want.append((ids[i], len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:08x}" for x in sketch_of(t)), like(sketch_of(t), sketch_of(edited)), like(sketch_of(t), sketch_of(n))))
    have = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert syncmers.digest(frame(spark, [])).count() == 0
    assert rows(syncmers.digest(frame(spark, ["abcdefgh"])), "near_next") == [(1.0,)]


def test_syncmers_do_not_hang_on_lengths_or_places(spark):
    p, signs = prose(34, 46), "".join(chr(0x4E00 + random.Random(i).randrange(4000)) for i in range(600))
    texts = [p[:299], p[:299] + " abc", signs, "x" + signs]
    got = {r["doc_id"]: r["near_next"] for r in syncmers.digest(frame(spark, texts)).collect()}
    assert got[0] > 0.8 and got[2] > 0.9


def test_syncmers_align_passages(spark):
    p = prose(35, 80)
    a = spark.createDataFrame([(1, prose(36, 30) + " " + p), (2, prose(37, 50))], "doc_id long, text string")
    b = spark.createDataFrame([(7, p + " " + prose(38, 20)), (8, None)], "doc_id long, text string")
    assert [x[:3] for x in rows(syncmers.aligned(a, b), "a_id", "b_id", "shift", "n")] == [(1, 7, -30)]


def test_syncmers_by_their_definition(spark):
    text = prose(33, 200)
    toks = text.split()
    h = [xxhash.xxh64_intdigest(t.encode(), 42) for t in toks]
    h1 = np.array(h, np.uint64).view(np.int64).tolist()
    h2 = rows(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(h1, h1[1:], strict=False))], "i long, a long, b long").orderBy("i"), F.xxhash64("a", "b"))
    inner = [x[0] for x in h2]
    want = [i for i in range(len(inner) - 3) if min(inner[i], inner[i + 3]) <= min(inner[i + 1 : i + 3])]
    got = spark.createDataFrame([(text,)], "text string").select(syncmers.syncmers(F.col("text")).alias("s")).first()["s"]
    assert [x["place"] for x in got] == want


# -- 6, 7, 10 --------------------------------------------------------------------------------------------------------------

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("block", [16, 1 << 18])
def test_token_counts(spark, block):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORD_BPE)
    own.encode_special_tokens = True
    texts = [*ODD, prose(40, 50), prose(41, 300)]
    ids = [*range(len(texts) - 1), None]
    got = rows(token_scan.digest(frame(spark, texts, ids).coalesce(2), WORD_BPE, block_bytes=block), "doc_id", "n_tokens")
    assert sorted(got, key=str) == sorted(((i, len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in zip(ids, texts, strict=True)), key=str)
    assert token_scan.digest(frame(spark, []), WORD_BPE).count() == 0
    twice = rows(token_scan.digest(frame(spark, ["one", "one"], [3, 3]), WORD_BPE), "doc_id", "n_tokens")
    assert len(twice) == 2 and twice[0] == twice[1]


def test_token_counts_of_tables_that_are_no_plain_scan(spark, tmp_path):
    """After a shuffle, a join and a choice of rows the places of documents still are those of their tokens."""
    from tokenizers import Tokenizer

    texts = [prose(700 + i, i % 60) for i in range(400)]
    frame(spark, texts).repartition(7).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    library = Tokenizer.from_file(WORD_BPE)
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    keys = spark.range(400).select(F.col("id").alias("doc_id"))
    for df in (docs, docs.repartition(4), docs.dropDuplicates(["doc_id"]), docs.join(keys, "doc_id"), docs.orderBy(F.rand(3)), docs.sample(0.5, 3).unionByName(docs.repartition(3))):
        got = rows(token_scan.digest(df, WORD_BPE), "doc_id", "n_tokens")
        assert len(got) >= 400 and all(n == want[i] for i, n in got)



@pytest.mark.parametrize("split", [0, 700])
def test_flat_files(spark, tmp_path, split):
    """Any bytes, in one split or many; with the bytes of a line's end and of a byte order mark; an odd byte at the end."""
    ids = np.array([5, 6, 9, 9, 7, 8, 8, 8, 9, 1, 2], np.uint16)
    r = np.random.default_rng(6)
    long = r.integers(0, 40, 3000).astype(np.uint16)
    long[r.integers(0, 3000, 400)] = 10
    mark = np.frombuffer(b"\xef\xbb\xbf\x00\x0a\x0a" * 300, np.uint16)
    files = {"a": ids.tobytes(), "b": b"", "c": long.tobytes(), "d": mark.tobytes() + ids.tobytes() + b"\x0a", "e": b"\x0a" * 7}
    for name, data in files.items():
        (tmp_path / f"{name}.bin").write_bytes(data)
    want = []
    for name, data in files.items():
        x = np.frombuffer(data[: len(data) // 2 * 2], np.uint16)
        e = np.r_[-1, np.flatnonzero(x == 9)]
        want += [(name, k, int(b - a - 1), True) for k, (a, b) in enumerate(zip(e, e[1:], strict=False))] + ([(name, len(e) - 1, len(x) - int(e[-1]) - 1, False)] if len(x) > e[-1] + 1 else [])
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.minPartitionNum", 1)
    try:
        blocks = token_scan.blocks_of_files(spark, str(tmp_path), 64)
        got = rows(token_scan.document_counts(blocks, 9).withColumn("file", F.regexp_extract("file", r"(.)\.bin", 1)), "file", "document", "n_tokens", "ended")
        assert sorted(got) == sorted(want)
        whole = {}
        for f, k, t in sorted(rows(blocks, "file", "block", "tokens")):
            assert len(t) == 64 or k == max(b for g, b, _ in rows(blocks, "file", "block", "tokens") if g == f)
            whole[f[-5]] = whole.get(f[-5], b"") + bytes(t)
        assert whole == {n: d for n, d in files.items() if d}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_sentencepiece(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(6)
    texts = [*ODD, *("".join(r.choices("aeinrst. ,▁\n\t é漢😀\x00ﬁ<>0x1_²", k=r.randint(0, 60))) for _ in range(300)), prose(50, 200)]
    got = {x["doc_id"]: x for x in sp_bpe.digest(frame(spark, texts), PIECES).collect()}
    full = {x["doc_id"]: x for x in sp_bpe.encoded(frame(spark, texts), PIECES).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        joined, back = ",".join(map(str, ids)), lib.decode(ids)
        assert (full[i]["ids"], full[i]["decoded"]) == (joined, back)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (joined, back)))
    assert sp_bpe.digest(frame(spark, []), PIECES).count() == 0


def test_fits_means_that_merging_gives_both_back():
    own, r = sp_bpe.codec(PIECES), random.Random(8)
    some = r.sample(sorted(own.shorter), 1500)
    for a, b in zip(some, some[::-1], strict=True):
        assert own.fits(a, b) == (own.merge(a + b) == [a, b])


def test_packing(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORD_BPE)
    texts = [*ODD, *(prose(60 + i, 5 + 37 * i % 300) for i in range(80)), prose(61, 9000), *["same text here"] * 30]
    got = packing.packed(frame(spark, texts), WORD_BPE).collect()
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], []).append(x)
    for i, t in enumerate(texts):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(by[i], key=lambda x: x["start"])
        assert [x["start"] for x in mine] == np.r_[0, np.cumsum([x["length"] for x in mine])[:-1]].tolist() and sum(x["length"] for x in mine) == len(ids)
        assert all(zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes()) == x["ids_crc32"] and x["doc_tokens"] == len(ids) for x in mine)
    packs = {}
    for x in got:
        packs.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    assert all(sorted(p)[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(sorted(p), sorted(p)[1:], strict=False)) and sum(n for _, n in p) <= 4096 for p in packs.values())
    assert packing.packed(frame(spark, []), WORD_BPE).count() == 0


def test_patterns_use_each_length():
    r = random.Random(9)
    for _ in range(40):
        counts = {r.randint(1, 64): r.randint(1, 50) for _ in range(20)}
        used = dict.fromkeys(counts, 0)
        for n, pack in packing.patterns(counts, 64):
            total = 0
            while pack:
                used[pack[0]] += n
                total, pack = total + pack[0], pack[1]
            assert 0 < total <= 64
        assert used == counts


# -- 8 ---------------------------------------------------------------------------------------------------------------------


def test_simhash_groups(spark):
    base = prose(70, 300).split()
    texts = [*ODD, " ".join(base), " ".join(base).upper(), " ".join([*base[:-1], "end"]), prose(71, 200)]
    fp = [simhash.fingerprint((t or "").encode()) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if bin(fp[i] ^ fp[j]).count("1") <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    got = {r["doc_id"]: r for r in simhash.digest(frame(spark, texts)).collect()}
    assert [(got[i]["fingerprint"], got[i]["component_id"]) for i in range(len(texts))] == [(f"{f:016x}", c) for f, c in zip(fp, label, strict=True)]
    assert simhash.digest(frame(spark, [])).count() == 0
    kept = simhash.representatives(frame(spark, [*texts, texts[0], "no id"], [*range(len(texts)), 0, None]))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(label)) and kept.where("doc_id is null").count() == 1


@pytest.mark.parametrize("hot", [4096, 2])
def test_links_join_what_all_pairs_join(spark, hot):
    from tramline.operators.components import connected_components

    r = random.Random(12)
    fps = {r.getrandbits(64) for _ in range(100)}
    for f in list(fps)[:40]:
        for _ in range(6):
            f ^= 1 << r.randrange(64)
            if r.random() < 0.5:
                f ^= 1 << r.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = dict(rows(connected_components(simhash.linked(nodes, hot), "a", "b"), "node", "component"))
    back = dict(zip(signed, fps, strict=True))
    groups = {}
    for s, f in back.items():
        groups.setdefault(find(f), set()).add(got.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({x for g in groups.values() for x in g}) == len(groups)


# -- rows that repeat --------------------------------------------------------------------------------------------------------


def test_repeated_rows_and_none(spark):
    """Each row gives what it gives alone; an empty table gives nothing."""
    texts = ["Some plain text.", "Some plain text.", None, "", "another one", "another one"]
    ids = [5, 5, None, None, 5, 7]
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    f, none = frame(spark, texts, ids), frame(spark, [])
    for op, n in ((lambda d: quality.digest(d, labels), 6), (lambda d: toxicity.digest(d, labels), 6), (lambda d: sp_bpe.digest(d, PIECES), 6), (lambda d: packing.packed(d, WORD_BPE), 6)):
        got = sorted(map(str, op(f).drop("sequence_id", "offset").collect()))
        assert len(got) == n and len(set(got)) < n
        assert op(none).count() == 0
    clash = f.withColumnsRenamed({"_d": "p_toxic", "_h": "tail", "key": "expected_grade"})
    assert toxicity.clean(clash, labels).columns == clash.columns and quality.selected(clash, labels).columns == clash.columns
    assert ann.nearest(spark.createDataFrame([(1, [1.0]), (1, [1.0])], "vec_id long, embedding array<double>"), every=1).count() == 2
