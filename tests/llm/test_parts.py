"""Numpy parts of the training-data operators against brute force."""

import collections
import gzip
import itertools

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketlens.llm import decontaminate, fingerprint, induced_sort, ngram_join, quality_cnn, recompression, suffix_dedup, toxicity, warc
from marketlens.llm import sentencepiece_codec as sp
from marketlens.llm.common import ValueCache, chunks, text_bytes, word_slices


def batch(texts):
    return text_bytes(pa.array(texts, pa.string()))


# --- induced sorting -------------------------------------------------------

def repeated_by_force(text, depth):
    seen = collections.defaultdict(list)
    for i in range(len(text) - depth + 1):
        if (text[i:i + depth] != 0).all():
            seen[text[i:i + depth].tobytes()].append(i)
    out = np.zeros(len(text), bool)
    for places in seen.values():
        if len(places) > 1:
            out[places] = True
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=40), min_size=1, max_size=8), st.integers(1, 12), st.sampled_from([(1 << 17, 1 << 21), (5, 8)]))
def test_repeated_suffixes(segments, depth, limits):
    induced_sort.PIECE, induced_sort.MEMORY = limits  # (5, 8): queues on disk
    text = np.concatenate([[*s, 0] for s in segments]).astype(np.uint16)
    try:
        assert (induced_sort.repeated(text, depth) == repeated_by_force(text, depth)).all()
    finally:
        induced_sort.PIECE, induced_sort.MEMORY = 1 << 17, 1 << 21


def test_suffix_order_and_common_prefixes():
    text = np.array([*b"mississippi", 0, *b"missouri", 0], np.uint16)
    for _, high, low in induced_sort.suffixes(text, 50):
        for parts, sign in ((high, 1), (low, -1)):
            order = [p for pos, _ in parts for p in pos.tolist()]
            key = [text[p:].tolist()[:text[p:].tolist().index(0)] for p in order]
            assert key == sorted(key, reverse=sign < 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=120), min_size=1, max_size=4), st.integers(4, 40))
def test_windows_of_one_content_have_one_key(texts, length):
    data, offsets = batch(texts)
    found, counts = {}, collections.Counter()
    key, text, p, n, again = suffix_dedup.windows(data, offsets, length, twice=True)
    for k, t, a, m in zip(key.tolist(), text.tolist(), p.tolist(), n.tolist(), strict=True):
        counts[k] += 1
        for i in range(a, a + m):
            assert found.setdefault(texts[t][i:i + length], k) == k
    assert sum(n.tolist()) == sum(max(0, len(t) - length + 1) for t in texts)
    every = [t[i:i + length] for t in texts for i in range(len(t) - length + 1)]
    for w, c in collections.Counter(every).items():
        if c > 1:  # a key of equal windows is never taken for a lone one
            assert counts[found[w]] > 1 or found[w] in again.tolist()


# --- recompression ---------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), min_size=1, max_size=5))
def test_equal_windows_are_filed_alike(docs):
    words = [" ".join("abc"[i] for i in d) for d in docs]
    data, offsets = batch(words)
    s, e, first = word_slices(data, offsets)
    from marketlens.llm.common import slice_hashes

    place, key, anchor, h = recompression.anchors(slice_hashes(data, s, e), first)
    flat = [w for d in words for w in d.split()]
    seen = {}
    for p, k, a, x in zip(place.tolist(), key.tolist(), anchor.tolist(), h.tolist(), strict=True):
        assert seen.setdefault(tuple(flat[p:p + 20]), (k, p - a, x)) == (k, p - a, x)
        assert p <= a < p + 20
    assert len({v[2] for v in seen.values()}) == len(seen)
    assert len(place) == sum(max(0, len(d) - 19) for d in docs)


# --- words, sets -----------------------------------------------------------

def test_words_and_shingles():
    texts = ["A b\tc  d e f g", None, "", " \n", "one two", "One two", "x " * 30]
    data, offsets = batch(texts)
    s, e, first = word_slices(data, offsets)
    assert np.diff(first).tolist() == [6, 0, 0, 0, 2, 2, 30]
    assert bytes(data[s[3]:e[3]]).decode() == "d e"
    h, at = ngram_join.shingles(data, offsets)
    assert np.diff(at).tolist() == [2, 0, 0, 0, 1, 1, 1]
    d = ngram_join.digests(h, at)
    assert d[4] == d[5] and len(set(d[[0, 1, 4, 6]].tolist())) == 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=5, max_size=90), st.lists(st.integers(0, 60), min_size=5, max_size=90))
def test_bitmaps_never_rule_out_a_link(x, y):
    texts = [" ".join(map(str, x)), " ".join(map(str, x[:-3] + y[:3]))]
    h, at = ngram_join.shingles(*batch(texts))
    a, b = (set(h[at[i]:at[i + 1]].tolist()) for i in (0, 1))
    m = [np.frombuffer(v, np.uint64) for v in ngram_join.bitmaps(h, at).to_pylist()]
    p, q = sorted(m, key=len)
    q = np.bitwise_xor.reduce(q.reshape(-1, len(p)), 0)
    assert int(np.bitwise_count(p ^ q).sum()) <= len(a ^ b)


def test_masks_miss_no_leak():
    n, masks = decontaminate.WINDOW, decontaminate.MASKS
    for k in range(decontaminate.MISMATCHES + 1):
        for wrong in itertools.combinations(range(n), k):
            assert any(all(bit == "0" or s + j not in wrong for j, bit in enumerate(m)) for m in masks for s in range(n - len(m) + 1))


def test_chunks_keep_all_rows():
    b = pa.record_batch({"text": pa.array(["x" * 50, None, "", "y" * 500, "z"])})
    got = [v for c in chunks([b], "text", 100) for v in c.column(0).to_pylist()]
    assert got == b.column(0).to_pylist()


def test_value_cache():
    c, calls = ValueCache(8), []
    for hs in ([1, 5], [1, 3, 5], [7, 8, 9, 10, 11, 12]):
        h = np.array(hs, np.uint64)
        got = c.find(h, lambda i: calls.append(len(i)) or h[i].astype(float) * 2)
        assert got.tolist() == [2.0 * x for x in hs]
    assert calls == [2, 1, 6]


# --- SentencePiece ---------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return sp.load_vocabulary(sp.default_model())


@pytest.fixture(scope="module")
def library(vocabulary):
    """The library's own unigram encoder with the same scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(sp.default_model(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for i, p in enumerate(m.pieces):
        if p.type == pb.ModelProto.SentencePiece.NORMAL:
            p.score = vocabulary.score[i]
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


TEXTS = ["hello  world\n▁x  é日本𠮷", "", None, "a", " ", "   b  ", "tab\there\r\n", "日本語テキスト", "🙂🙂 ok", "The quick brown fox. Über naïve façade!", "x" * 5000]


def test_encoding_like_the_library(vocabulary, library):
    ids, off = sp.encode_texts(vocabulary, pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        mine, theirs = ids[off[i]:off[i + 1]].tolist(), library.encode(t or "")
        cost = lambda x: sum(vocabulary.score[k] if k > 258 else 0 for k in x)
        assert mine == theirs or (library.decode(mine) == library.decode(theirs) and cost(mine) >= cost(theirs) - 1e-3)
    assert sp.decode_ids(vocabulary, ids, off).to_pylist() == [(t or "").replace(sp.MARKER, " ") for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(max_size=60), max_size=6))
def test_round_trip(vocabulary, texts):
    ids, off = sp.encode_texts(vocabulary, pa.array(texts, pa.string()))
    assert sp.decode_ids(vocabulary, ids, off).to_pylist() == [t.replace(sp.MARKER, " ") for t in texts]


def test_viterbi_is_best(vocabulary):
    r = np.random.default_rng(0)
    piece_of = {vocabulary.raw[vocabulary.raw_at[i]:vocabulary.raw_at[i + 1]].tobytes().decode(): i for i in range(259, 32000)}

    def best(word):
        top = [0.0] + [-np.inf] * len(word)
        for i in range(len(word)):
            for j in range(i + 1, len(word) + 1):
                if (k := piece_of.get(word[i:j])) is not None:
                    top[j] = max(top[j], top[i] + vocabulary.score[k])
        return top[-1]

    words = ["".join(chr(97 + int(c)) for c in r.integers(0, 26, int(r.integers(1, 12)))) for _ in range(60)]
    ids, off = sp.encode_texts(vocabulary, pa.array(words))
    for i, w in enumerate(words):
        assert abs(vocabulary.score[ids[off[i]:off[i + 1]]].sum() - best(" " + w)) < 1e-9


def test_ill_formed_bytes_decode(vocabulary):
    ids = np.array([3 + 0xFF, 3 + 0x41])
    assert sp.decode_ids(vocabulary, ids, np.array([0, 2])).to_pylist() == ["�A"]


# --- fingerprints ----------------------------------------------------------

def test_fingerprints_share_interiors():
    r = np.random.default_rng(1)
    word = lambda: "".join(chr(97 + int(c)) for c in r.integers(0, 26, 6))
    body = " ".join(word() for _ in range(300))
    other = " ".join(word() for _ in range(300))
    texts = [body, "shifted start " + body, body[:1400] + other[:700], other, body, "", "a" * 5000]
    s = fingerprint.sketches(*batch(texts))
    like = lambda i, j: fingerprint.likeness(s[i], s[j])
    assert like(0, 1) > 0.9 and 0.45 < like(0, 2) < 0.85 and like(0, 3) < 0.1 and like(0, 4) == 1
    assert like(0, 5) == 0 and like(5, 5) == 1
    assert (fingerprint.from_text(fingerprint.to_text(s[0])) == s[0]).all()
    alone = fingerprint.sketches(*batch([texts[0]]))[0]
    assert (alone == s[0]).all()  # whatever stands beside it


def test_edited_texts():
    texts = ["ab", "xyzäöü€uvw", "0123456", ""]
    new, at, n = fingerprint.edited(*batch(texts))
    got = [new[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == ["xyzäöü€" + "ab", "01234" + "xy", ""] and n.tolist() == [10, 7, 0]


# --- WARC ------------------------------------------------------------------

def archive(payloads):
    return [warc.gzip_member(warc.record_bytes(i, f"http://x/{i}", p)) for i, p in enumerate(payloads)]


def test_salvage_recovers_later_records():
    members = archive([b"a" * 50, b"b" * 2000, b"", b"d\r\n\r\nWARC/1.1\r\nx", b"e" * 10])
    whole = b"".join(members)
    rows = list(warc.salvage(whole))
    assert [r["kind"] for r in rows] == ["record"] * 5 and rows[3]["payload"] == b"d\r\n\r\nWARC/1.1\r\nx"
    # a damaged second member, then rubbish
    at = len(members[0])
    bad = whole[:at + 60] + b"\xff" * 8 + whole[at + 68:at + len(members[1])] + b"rubbish" + whole[at + len(members[1]):]
    rows = list(warc.salvage(bad))
    assert [r.get("record_id") for r in rows if r["kind"] == "record"] == [f"{warc.URN}{i}" for i in (0, 2, 3, 4)]
    gap = [r for r in rows if r["kind"] == "gap"]
    assert len(gap) == 1 and gap[0]["start"] == at and gap[0]["stop"] == at + len(members[1]) + 7
    # a cut end
    rows = list(warc.salvage(whole[:-5]))
    assert rows[-1]["kind"] == "gap" and rows[-1]["reason"] == "truncated member" and rows[-1]["stop"] == len(whole) - 5


def test_salvage_of_plain_archives():
    records = [warc.record_bytes(i, None, b"payload %d" % i) for i in range(4)]
    broken = records[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    rows = list(warc.salvage(records[0] + broken + records[2] + records[3].replace(b"payload 3", b"payloae 3")))
    assert [r.get("payload") for r in rows if r["kind"] == "record"] == [b"payload 0", b"payload 2"]
    assert [r["reason"] for r in rows if r["kind"] == "gap"] == ["length", "block digest"]
    assert list(warc.salvage(b"")) == []


def test_members_are_gzip():
    big = warc.gzip_member(b"\x00" * (1 << 24))
    assert big[-1] == 0 and gzip.decompress(big) == b"\x00" * (1 << 24)


# --- classifiers -----------------------------------------------------------

def kernel_by_force(a, b):
    def phi(s):
        code = [int(c) for c in toxicity._CODE[[ord(c) for c in s]]]
        out = collections.Counter()
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i < toxicity.SPAN and code[i] and code[j] and code[k]:
                out[(code[i], code[j], code[k])] += toxicity.DECAY ** (k - i - 2)
        norm = sum(toxicity.DECAY ** (2 * (k - i - 2)) for i, j, k in itertools.combinations(range(len(s)), 3) if k - i < toxicity.SPAN and code[i] and code[j] and code[k])
        return out, norm

    (x, nx), (y, ny) = phi(a), phi(b)
    return sum(v * y[u] for u, v in x.items()) / np.sqrt(max(nx, 1e-9) * max(ny, 1e-9))


def test_string_kernel():
    words = ["idiot", "i-d-i-o-t", "idxiot", "straße", "ab", "the", "aaaa"]
    marks = toxicity.features(words)
    k = toxicity.kernels(words, marks)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(k[i, j] - kernel_by_force(a, b)) < 1e-4
    data, off = batch(words)
    assert np.allclose(toxicity.values(marks[0].astype(float), *toxicity.letters(data, off[:-1], off[1:])), k[:, 0], atol=1e-4)


def test_machine_tolerates_gaps():
    r = np.random.default_rng(2)
    clean = sorted({"".join("etaoinshrdlu"[int(c)] for c in r.integers(0, 12, int(r.integers(2, 9)))) for _ in range(800)})
    m = toxicity.train(["grumbuk", "zwackel"], clean, steps=200)
    v = lambda w: toxicity._values_of(m, [w])[0]
    assert min(v(w) for w in ("grumbuk", "g.r.u.m.b.u.k", "grumxbuk", "zwackels")) > 0 > max(v(w) for w in ("the", "house", "stone"))
    cache = ValueCache()
    assert toxicity.worst(m, *batch(["what a g r u m b u k here", "the house", "", None]), cache).tolist()[0] > 0


def test_blamed_units_are_those_of_toxic_documents():
    docs = [{"bad", f"w{i}", "the"} for i in range(12)] + [{"worse", f"v{i}", "the"} for i in range(4)]
    assert toxicity.blamed(docs, collections.Counter({"the": 40}), 40) == ["bad", "worse"]


def test_network_gradients():
    net = quality_cnn.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(4)
    chunk, doc, y = r.integers(0, 256, (5, quality_cnn.CHUNK)), np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        z = np.bincount(doc, net.scores(chunk), 3) / np.bincount(doc)
        p = 1 / (1 + np.exp(-z))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = net.gradients(chunk, doc, y)
    for name in ("filter", "hidden", "out", "fbias"):
        at = tuple(int(r.integers(0, n)) for n in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        text, start = quality_cnn.chunk_starts(np.array([n]))
        assert start[0] == 0 and start[-1] + quality_cnn.CHUNK >= n and (np.diff(start) == quality_cnn.STEP).all()
