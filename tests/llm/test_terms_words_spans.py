"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tramline.llm import divergence, personal_data, spelling

SCHEMA = "doc_id long, text string, lang string, source string, term string, word string, n long, key string, spans string, block long"


def frame(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with the operators' own names."""
    return spark.createDataFrame([(*r, "t", "w", 1, "k", "s", 2) for r in rows], SCHEMA)


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


# -- 11 --------------------------------------------------------------------------------------------------------------------


def brute_audit(rows, least=3, top=200):
    groups, used, counts = defaultdict(Counter), defaultdict(Counter), {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text or ""))
        groups[lang, source].update(terms)
        used[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in used[lang].items() if k >= least]
        own = {s: groups[lang, s] for g, s in groups if g == lang}
        whole = Counter()
        for c in own.values():
            whole.update({t: c[t] for t in kept})

        def chances(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        counts = {s: chances(c) for s, c in own.items()}
        q = chances(whole)
        for s, p in counts.items():
            pairs = sorted(((sum((p[t] - r[t]) ** 2 // r[t] for t in kept), o) for o, r in counts.items() if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted((((p[t] - q[t]) ** 2 // q[t], t) for t in kept if own[s][t] and p[t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, "pair", o, v, i) for i, (v, o) in enumerate(pairs, 1)] + [(lang, s, "term", t, v, i) for i, (v, t) in enumerate(terms, 1)]
    return sorted(out)


def term_rows():
    r = random.Random(11)
    words = ["a", "B", "ab", "Éa", "éa", "zz", "ÿ漢", "x1y", "the", "The", "q-q", "o", "rare"]
    rows = [(i, " ".join(r.choices(words[:-1], range(1, 13), k=r.randint(0, 30))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "é", "z", None])) for i in range(60)]
    rows += [(60, None, "en", "s1"), (61, "", "xx", "only"), (62, "1 2 3", "xx", "other"), (63, "rare", "en", "s1"), (None, "rare rare", "en", "s2"), (65, "the " * 3000, "en", "s9")]
    return rows + [rows[0], rows[0]]


@pytest.mark.parametrize("cells", [divergence.CELLS, 1])
def test_divergences(spark, cells, monkeypatch):
    monkeypatch.setattr(divergence, "NARROWEST", 2 if cells == 1 else 256)  # many tiles
    rows = term_rows()
    got = sorted(tuple(x) for x in divergence.audit(frame(spark, rows), cells=cells).select("lang", "source", "part", "item", "value", "rank").collect())
    want = brute_audit(rows)
    assert got == want
    assert {x[:4] for x in want} >= {("xx", "only", "pair", "other"), ("", "s1", "pair", "s2")} and not any(x[3] == "rare" for x in want)


def test_top_terms_are_cut_by_value_and_bytes(spark):
    rows = [(i, " ".join(f"t{chr(97 + j)}" for j in range(9)) + (" own" * i), "en", f"s{i % 2}") for i in range(8)]
    got = sorted(tuple(x) for x in divergence.audit(frame(spark, rows), top=3).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_audit(rows, top=3)


def test_divergences_of_nothing(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    assert divergence.audit(frame(spark, [(1, None, None, None)])).count() == 0


def test_probabilities_are_exact_for_large_counts():
    r = random.Random(2)
    for _ in range(200):
        total, v = r.randint(0, 9 * 10**15 - 10**6), r.randint(1, 10**6)
        c = np.array([0, total // 3, total], np.int64)
        assert divergence.probability(c, np.int64(total), v).tolist() == [1 + 10**9 * (int(x) + 1) // (total + v) for x in c]


def test_terms_in_pieces():
    text = ("ab cd " * 50 + "x" * 400 + " end").encode()
    for piece in (7, 64, 1000):
        assert [t for some in divergence.terms_of(text, piece=piece) for t in some] == text.split()


def test_counts_handed_on_early_are_the_same(spark):
    rows = term_rows()
    sums = lambda df: sorted(tuple(r) for r in df.groupBy("lang", "source", "term").sum("n", "docs").collect())
    assert sums(divergence.counted(frame(spark, rows), held=1)) == sums(divergence.counted(frame(spark, rows)))


# -- 12 --------------------------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[i + 1 :] == b[i + (len(a) == len(b)) :]


def brute_variants(rows, least=7, ratio=10, one_in=31):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    form, found = {}, {}
    for w in n:
        found[w] = [x for x in n if near(w, x)]
        best = min(found[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(found[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def variants(spark, rows, **more):
    return sorted((tuple(x) for x in spelling.variants(frame(spark, rows), **more).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def word_rows():
    r = random.Random(12)
    words = ["aabbaab", "éclairée", "ÀÉÎÕÜ÷×ß", "therefore", "cccccccc", "listens", "silents", "abcdefgh", "y" * 90, "ab" * 60]
    rows = []
    for i in range(400):
        some = [words[min(int(r.expovariate(0.6)), 9)] for _ in range(12)]
        for k in range(12):
            if r.random() < 0.08:
                w, p = some[k], r.randrange(len(some[k]))
                some[k] = r.choice([w[:p] + w[p + 1 :], w[:p] + r.choice("aby") + w[p:], w[:p] + r.choice("abé") + w[p + 1 :]])
        rows.append((i, r.choice([" ", "1", "Δ", "\n"]).join(x.upper() if r.random() < 0.2 and x.isascii() else x for x in some), "en", "s"))
    long = "ab" * 60
    rows += [(1000 + i, " ".join([long, long[:50] + "é" + long[51:], long[:70] + long[71:], "y" * 90, "y" * 89, "x" + "y" * 89]), "en", "s") for i in range(4)]
    return [*rows, (None, "therefore listens", "en", "s"), (7, None, "en", "s"), (8, "", None, None), (3, "short words no 12", "en", "s"), rows[0], rows[0]]


def test_spelling_variants(spark):
    rows = word_rows()
    got, want = variants(spark, rows), brute_variants(rows)
    assert got == want
    assert any(f for _, f, *_ in want) and any(len(w) > 80 and k for w, _, _, _, k, _ in want)


def test_spelling_forms_are_followed(spark):
    """Counts 1,200, 110, 10: each the form of the next; ties go to the first word."""
    rows = [(i, "stations " * 12 + ("station " if i < 100 else "") + ("stationx " if i >= 90 else "") + ("statonx " if i == 5 else ""), "en", "s") for i in range(100)]
    for more in ({}, {"one_in": 10**9}, {"ratio": 2}):
        assert variants(spark, rows, **more) == brute_variants(rows, **more)
    chain = [(0, "aaaaaaa " * 2 + "aaaaaaab " * 20 + "aaaaaaabc " * 200 + "aaaaaaabcd " * 2000 + "aaaaaaabcde " * 20000, "en", "s")]
    got = {w: root for w, _, root, *_ in variants(spark, chain, one_in=10**9)}
    assert set(got.values()) == {"aaaaaaabcde"} and len(got) == 5


def test_spelling_of_random_words(spark):
    r = random.Random(5)
    rows = [(i, " ".join("".join(r.choices("ab", k=r.randint(7, 9))) for _ in range(40)), "en", "s") for i in range(40)]
    assert variants(spark, rows, ratio=2) == brute_variants(rows, ratio=2)


def test_spelling_of_nothing(spark):
    assert variants(spark, []) == [] and variants(spark, [(1, "once only therefore", "en", "s")]) == []


def test_words_that_are_hashed_agree_with_their_rests():
    word = "".join(random.Random(1).choices("abcé", k=150))
    own = spelling._long_rests(word.encode("latin-1"))[1]
    for i in range(150):
        assert own[i] == spelling._long_rests((word[:i] + word[i + 1 :]).encode("latin-1"))[0]


# -- 13 --------------------------------------------------------------------------------------------------------------------

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_base(text):
    def fits(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == 1:
            return all(int(x) <= 255 for x in s.split("."))
        if kind == 2:
            return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == 0 or 9 <= len(d) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if fits(k, m[0]))


def test_base_spans():
    r = random.Random(13)
    parts = ["@", "a", "b.c", ".", "-", "1", "22", "256", "0", "+1", "+", " ", "(", ")", "4111111111111111", "x@y.z", "10.0.0.1", "é", "٣", "+44 20 7946 0958", "\n", "555-12"]
    for _ in range(4000):
        text = "".join(r.choices(parts, k=r.randint(0, 25)))
        assert personal_data.base_spans(text) == brute_base(text), text


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "@a." * 100_000, "1." * 150_000, "+1" + " " * 300_000, "1 " * 150_000, "a@b." * 70_000, "a at b dot " * 30_000, "(at) " * 60_000, "1:" * 100_000, "1(.)" * 70_000):
        personal_data.candidates(text, personal_data.base_spans(text))


def test_labelers_are_told_apart():
    """Votes drawn from known reliabilities: estimated within 0.05, and chances near the truth."""
    r = np.random.default_rng(3)
    y = r.random(20_000) < 0.6
    right = np.array([[0.1, 0.3, 0.15, 0.2, 0.1, 0.4, 0.3], [0.9, 0.8, 0.95, 0.7, 0.9, 0.8, 0.6]])
    v = np.where(r.random((20_000, 7)) < right[y.astype(int)], 1, -1) * (r.random((20_000, 7)) < 0.8)
    rows, count = np.unique(v, axis=0, return_counts=True)
    model = personal_data.reliabilities(rows.astype(float), count.astype(float))
    assert np.abs(model.right - right).max() < 0.05 and abs(model.prior - 0.6) < 0.05
    assert ((model.chances(v.astype(float)) > 0.5) == y).mean() > 0.95


def test_classifier_begins_as_the_label_model():
    model = personal_data.Reliability(0.7, np.array([[0.1] * 7, [0.8] * 7]), 0.4)
    w = personal_data.fit([], np.zeros(0), model)
    v = "0+-+0-+"
    one = personal_data.features(v, "", "", "")
    votes = [c for c in one if c < 21] + [personal_data.WIDTH - 1]
    same = personal_data.Reliability(0.4, model.right).chances(personal_data.signs([v]))[0]
    assert abs(personal_data.sigmoid(w[votes].sum()) - same) < 1e-12


CLEAN = ["on 2024-01-15 we met at 12:30:45", "isbn 978-3-16-148410-0 book", "order 1234567890123456 shipped", "foo @ bar said me@localhost", "a 100 000 000 b 1984 2001 2010", "at the dot", "room 555-1234", None, "", "a" * 3000, "漢字 😀 1.2.3"]
ADDED = {
    "write to jane.doe [at] mail dot example dot com please": ["email:9:47"],
    "jane at example dot org": ["email:0:23"],
    "call 988-555-2485 today": ["phone:5:17"],
    "phone 0049 30 1234567": ["phone:6:21"],
    "server 10[.]20[.]30[.]40 is up": ["ip:7:24"],
    "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 x": ["ip:5:44"],
    "pay 4111 1111 1111 1111 4111 1111 1111 1111 ok": ["card:4:23", "card:24:43"],
    "+1 (663) 555-6869 4465758382889437": ["phone:0:17", "card:18:34"],
    "漢 x@y.org 9": ["email:2:9"],
}


def test_personal_data(spark):
    r = random.Random(8)
    known = [f"the text of {r.choice(['the', 'a', 'one'])} mail{i}@mail{i % 7}.example.com or +1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)} and {r.randint(1, 223)}.{r.randint(0, 255)}.{r.randint(0, 255)}.1 here" for i in range(60)]
    texts = [*CLEAN, *ADDED, *known, known[0], known[0]]
    got = personal_data.digest(frame(spark, [(i, t, None, "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [x["doc_id"] for x in got] == list(range(len(texts)))
    for x, text in zip(got, texts, strict=True):
        base = brute_base(text or "")
        said = ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert x["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [x["n_email"], x["n_ip"], x["n_card"], x["n_phone"]] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert x["spans"] == (",".join(ADDED[text]) if text in ADDED else said), text


def test_personal_data_of_nothing(spark):
    assert personal_data.digest(frame(spark, [])).count() == 0
    got = personal_data.digest(frame(spark, [(None, None, None, None)])).collect()
    assert [tuple(x) for x in got] == [(None, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")]


def test_of_candidates_that_overlap_the_likelier_stays():
    rows = [{"start": s, "end": e, "kind": k, "base": False, "votes": v, "before": "", "body": "", "after": ""} for s, e, k, v in [(0, 10, 3, "0++++++"), (5, 20, 2, "0+++0++"), (20, 25, 3, "0+++0++"), (30, 40, 3, "0------")]]
    own = np.zeros(personal_data.WIDTH)
    own[[3 * j + 2 for j in range(7)]], own[[3 * j for j in range(7)]] = 1, -1
    assert personal_data.chosen(rows, {2: own, 3: own}, 0.8) == [(0, 3, 10), (20, 3, 25)]
