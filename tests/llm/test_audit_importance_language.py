"""Operators 11 to 13 against brute force, and on odd rows."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketlens.llm import filter_audit, importance, language_id
from marketlens.llm.common import text_bytes


def batch(texts):
    return text_bytes(pa.array(texts, pa.string()))


# --- 11 ------------------------------------------------------------------------

def audit_by_force(rows, labels):
    """rows: (id, text, lang); labels: (id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails, out = [], {}
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
             "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        fails.append((i, lang or "", {k for k, v in f.items() if v}))
    for part in {p for _, p, _ in fails}:
        mine = [(i, f) for i, p, f in fails if p == part]
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                every = sum(name in f for _, f in mine)
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), every - len(gone), sum(f == {name} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(frame):
    return {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in frame.collect()}


def test_filter_audit(spark):
    r = np.random.default_rng(4)
    word = lambda: "".join("abcdeXY#"[int(c)] for c in r.choice(8, int(r.integers(1, 5)), p=[0.2, 0.2, 0.2, 0.2, 0.17, 0.01, 0.01, 0.01]))
    texts = [" ".join(word() for _ in range(int(r.choice([0, 5, 150, 199, 200, 201, 400])))) for _ in range(60)]
    texts += ["éé É ñ  \t ß", "x" * 1000 + "ABC", " \n ", None, "", "a " * 300, "spam " * 400 + "#"]
    rows = [(int(i), texts[int(r.integers(len(texts)))], [None, "", "en", "de"][int(r.integers(4))]) for i in r.permutation(240)]
    rows += [(3, texts[0], "en"), (3, texts[0], "en"), (3, texts[0], "de"), (-5, texts[0], "en"), (None, texts[0], "en"), (None, "w " * 250, "en"), (None, "w " * 250, None)]
    labels = [(int(i), int(r.integers(2)), int(r.integers(2))) for i in r.integers(0, 260, 200)] + [(None, 1, 1), (7, None, None)]
    # columns that clash with inner names
    docs = spark.createDataFrame([(i, t, g, 5, "x", 9) for i, t, g in rows], "doc_id long, text string, lang string, mask int, part string, n int").repartition(3)
    marks = spark.createDataFrame([(*x, 1, "z") for x in labels], "doc_id long, quality int, toxic int, id int, hash string")
    got = audited(filter_audit.audit(docs, marks))
    assert got == audit_by_force(rows, labels) and len(got) == 3 * 600
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert {v[4:6] for v in audited(filter_audit.audit(docs, marks.limit(0))).values()} == {(0, 0)}


def test_filter_audit_of_long_texts(spark):
    rows = [(1, "word " * 300_000, "en"), (2, "z" * 1_500_000, "en"), (3, "z" * 1_500_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = audited(filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert got["en", "BACDE", 1][:2] == (2, 1) and got["en", "EABCD", 1][:2] == (2, 1) and got["en", "ABCDE", 1][:2] == (1, 2)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.lists(st.integers(0, 50), min_size=3, max_size=3), max_size=20))
def test_states_of_the_walk(cells):
    masks = np.array(list(cells), np.int64)
    counts = np.array(list(cells.values()), np.int64).reshape(-1, 3)
    states = filter_audit.gray_states(masks, counts, 5)
    assert all((states[s] == counts[(masks & s) == 0].sum(0)).all() for s in range(32))


# --- 12 ------------------------------------------------------------------------

def features_by_force(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return w, collections.Counter(zlib.crc32(" ".join(w[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=700), min_size=1, max_size=8), st.sampled_from([7, 128]), st.sampled_from([64, 1 << 16]))
def test_crc_of_spans(spans, reach, piece):
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(x) for x in spans])
    old, importance.PIECE_BYTES = importance.PIECE_BYTES, piece
    try:
        got = importance.PositionTable(reach).crc(data, ends - [len(x) for x in spans], ends)
    finally:
        importance.PIECE_BYTES = old
    assert got.tolist() == [zlib.crc32(x) for x in spans]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aZ09é '中\n_", max_size=60), st.text(max_size=30)), min_size=1, max_size=6))
def test_features_of_texts(texts):
    count, pieces = importance.feature_buckets(*batch(texts))
    got = [collections.Counter() for _ in texts]
    for text, bucket in pieces:
        for i, b in zip(text.tolist(), bucket.tolist(), strict=True):
            got[i][b] += 1
    want = [features_by_force(t) for t in texts]
    assert got == [f for _, f in want] and count.tolist() == [len(w) for w, _ in want]


def drawn_by_force(rows, bench, percent=5):
    every = [(i, *features_by_force(t)) for i, t in rows]
    s, t = collections.Counter(), collections.Counter()
    for _, _, f in every:
        s.update(f)
    for x in bench:
        t.update(features_by_force(x)[1])
    whole_s, whole_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (whole_s + 10_000) / ((s[b] + 1) * (whole_t + 10_000)))) for b in range(10_000)]
    out = {}
    for i, w, f in every:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain[b] for b, n in f.items())
        out[i] = [sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)]
    fit = sorted((-v[2], -1 if i is None else i, i) for i, v in out.items() if v[4] >= 20)
    for place, (_, _, i) in enumerate(fit[:len(fit) * percent // 100], 1):
        out[i][3] = place
    return {i: tuple(v[:4]) for i, v in out.items()}


def test_importance_resampling(spark):
    r = np.random.default_rng(8)
    word = lambda: "".join("abcdeé"[int(c)] for c in r.integers(0, 6, int(r.integers(1, 4))))
    rows = [(i, " ".join(word() for _ in range(int(r.integers(15, 60))))) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(80)] + [(500, None), (501, ""), (502, "..."), (None, rows[5][1]), (503, "Q" * 5000 + " b " * 40), (504, "word " * 60_000)]
    bench = [rows[5][1], None, "", "abc abd"]
    docs = spark.createDataFrame([(i, t, 0.1, 7, 1) for i, t in rows], "doc_id long, text string, score double, place_ long, t int").repartition(5)
    target = spark.createDataFrame([(x,) for x in bench], "text string")
    got = {x.doc_id: (x.n_features, x.weight, x.score, x.rank) for x in importance.resampled(docs, target).collect()}
    assert got == drawn_by_force(rows, bench) and len(got) == len(rows)
    assert importance.resampled(docs.limit(0), target).count() == 0
    none = importance.resampled(docs, target.limit(0)).filter("rank is not null")
    assert none.count() == sum(len(features_by_force(t)[0]) >= 20 for _, t in rows) * 5 // 100


def test_rows_that_repeat_an_id_are_ranked_each(spark):
    docs = spark.createDataFrame([(1, "x y " * 10)] * 40 + [(2, "z w " * 10)] * 20, "doc_id long, text string")
    got = importance.resampled(docs, spark.createDataFrame([("x y",)], "text string"), percent=50).collect()
    assert sorted(x.rank for x in got if x.rank) == list(range(1, 31)) and len(got) == 60


# --- 13 ------------------------------------------------------------------------

def stream_by_force(text):
    w = "".join(c if c.isalpha() else " " for c in text or "").split(" ")
    w = ["".join(c.lower()[0] for c in x) for x in w if x]
    return " " + " ".join(w) + " " if w else ""


def column_by_force(gram):
    h = 0
    for n, c in enumerate(gram, 1):
        h = (h + ord(c) + n) * 0x9E3779B1 & 0xFFFFFFFF
        h ^= h >> 15
    return (h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - language_id.BUCKET_BITS)


texts_of_any_kind = st.lists(st.one_of(st.none(), st.text("aZ9é ß中İ\n_𐐀", max_size=40), st.text(max_size=30)), min_size=1, max_size=6)


@settings(max_examples=100, deadline=None)
@given(texts_of_any_kind, st.sampled_from([5, 1 << 16]))
def test_streams_and_columns(texts, piece):
    char, off = language_id.streams(*batch(texts))
    want = [stream_by_force(t) for t in texts]
    assert ["".join(map(chr, char[a:b])) for a, b in itertools.pairwise(off)] == want
    old, language_id.PIECE = language_id.PIECE, piece
    got = [collections.Counter() for _ in texts]
    try:
        for text, col in language_id.occurrences(char, off):
            for i, c in zip(text.tolist(), col.tolist(), strict=True):
                got[i][c] += 1
    finally:
        language_id.PIECE = old
    assert got == [collections.Counter(column_by_force(s[i:i + n]) for n in range(1, 5) for i in range(len(s) - n + 1)) for s in want]


def languages(spark):
    r = np.random.default_rng(12)
    parts = {"de": "sch ung keit der und ein ich".split(), "en": "the ing tion and ou wh er".split(), "fr": "eau que oi les ment ç è".split()}
    rows = []
    for i in range(420):
        lang = list(parts)[i % 3]
        text = " ".join("".join(r.choice(parts[lang], int(r.integers(1, 4)))) for _ in range(int(r.integers(1, 30))))
        rows.append((i, text, lang if i % 10 else None))
    return rows, [list(parts)[i % 3] for i in range(420)]


def test_language_id(spark):
    rows, truth = languages(spark)
    rows += [(900, None, "en"), (901, "", "en"), (902, " 12 !?  ", "de"), (903, rows[4][1], None), (None, rows[4][1], "fr"), (904, rows[5][1] + " z" * 200_000, "fr")]
    docs = spark.createDataFrame([(*x, "old", 3.0) for x in rows], "doc_id long, text string, lang string, lang_pred string, l double").repartition(3)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    learn = docs.filter("crc32(cast(doc_id as string)) % 3 <> 1")
    model = language_id.fit(learn)
    assert model.languages == ["de", "en", "fr"]
    out = language_id.predict(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "l", "lang_pred", "score"] and out.count() == len(rows)
    got = {x.doc_id: (x.lang_pred, x.score) for x in out.collect()}
    assert all(0 <= s <= 1 for _, s in got.values())
    tested = [i for i in range(420) if held(i)]
    assert np.mean([got[i][0] == truth[i] for i in tested]) > 0.97
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903] == got[4] and got[None] == got[4]
    # counts and scores by force
    counts = {g: collections.Counter() for g in model.languages}
    seen = [x for x in rows if x[0] is not None and x[2] is not None and not held(x[0])]
    grams = lambda t: [column_by_force(s[i:i + n]) for s in [stream_by_force(t)] for n in range(1, 5) for i in range(len(s) - n + 1)]
    for i, t, g in seen:
        counts[g].update(grams(t))
    size = language_id.BUCKETS
    log = {g: [round(1000 * math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * size))) for b in range(size)] for g, c in counts.items()}
    prior = {g: round(1000 * math.log(sum(x[2] == g for x in seen) / len(seen))) for g in counts}
    for i in (1, 2, 7, 50, 111, 400):
        z = {g: (sum(log[g][b] for b in grams(rows[i][1])) / 4 + prior[g]) / 1000 for g in counts}
        best = max(sorted(z), key=z.get)
        assert got[i][0] == best and got[i][1] == pytest.approx(1 / sum(math.exp(v - z[best]) for v in z.values()), abs=1e-6)


def test_language_id_of_nothing(spark):
    docs = spark.createDataFrame([(1, "the end", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = language_id.fit(docs.limit(0))
    assert {(x.lang_pred, x.score) for x in language_id.predict(docs, model).collect()} == {("und", 0.0)}
    assert language_id.predict(docs.limit(0), language_id.fit(docs)).count() == 0


def test_language_rows_are_bounded_per_language(spark):
    rows, _ = languages(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, every = language_id.fit(docs, rows_per_language=20), language_id.fit(docs)
    assert (few.log != every.log).any() and (few.prior == every.prior).all()
