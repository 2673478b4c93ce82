"""SentencePiece encoding and decoding: unigram Viterbi over a double-array
trie of pieces with log scores, byte fallback and whitespace markers.

The vocabulary is a ``.model`` file given by its path. A unigram model's own
scores are used; a merge-ranked (BPE) model has ranks in their place, so piece
number r gets the Zipf log probability ``-log(r) - log(H)``. No tokenizer is
trained.

No piece has a space marker after another character, so the best split of a
text is the best splits of its marker-led words one after another. A batch's
distinct words are split once, all together: the trie walk starts at every
character at once, then the best scores are carried from left to right.

Defined results: a null or empty text has no tokens and decodes to the empty
text; U+2581 in a text is a space (as in SentencePiece); characters outside
the vocabulary become their UTF-8 byte pieces; texts of any length are encoded
whole; equal scores keep the path whose last piece starts first.
"""

from __future__ import annotations

import importlib.util
import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import chunks, ragged, slice_hashes, strings, text_bytes

MARKER = "▁"


def default_model() -> str:
    """The public 32k-piece vocabulary of this machine."""
    for top in ("/opt/tokenizers", os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)):
        if os.path.exists(path := os.path.join(top, "piece_bpe_32k.model")):
            return path
    raise FileNotFoundError("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """Double-array trie: ``check[base[s] + c] == s`` marks the child of state
    s by character code c; ``piece`` has the piece that ends in a state."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    codes: np.ndarray       # code point -> character code, 0: in no piece
    score: np.ndarray
    unknown_score: float
    byte_piece: np.ndarray  # byte -> piece
    raw: np.ndarray         # decoded bytes of all pieces
    raw_at: np.ndarray
    longest: int


def load_vocabulary(path: str) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kinds = pb.ModelProto.SentencePiece
    score = np.array([p.score for p in proto.pieces])
    usable = [i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED) and p.piece]
    if proto.trainer_spec.model_type != pb.TrainerSpec.UNIGRAM:
        rank = np.arange(1, len(usable) + 1)
        score[usable] = -np.log(rank) - np.log(np.sum(1.0 / rank))
    byte_piece, raw = np.full(256, -1, np.int64), []
    for i, p in enumerate(proto.pieces):
        if p.type == kinds.BYTE:
            byte_piece[int(p.piece[3:5], 16)] = i
            raw.append(bytes([int(p.piece[3:5], 16)]))
        else:
            raw.append(b"" if p.type in (kinds.CONTROL, kinds.UNKNOWN) else p.piece.replace(MARKER, " ").encode())
    if (byte_piece < 0).any():
        raise ValueError("the model has no byte pieces")
    if any(MARKER in proto.pieces[i].piece.lstrip(MARKER) for i in usable):
        raise ValueError("a piece has a space marker after another character")
    return build_vocabulary({proto.pieces[i].piece: i for i in usable}, score, float(score[usable].min()) - 10.0, byte_piece, raw)


def build_vocabulary(pieces: dict[str, int], score, unknown_score, byte_piece, raw) -> Vocabulary:
    often = Counter(ord(c) for p in pieces for c in p)
    points = sorted(often, key=lambda c: (-often[c], c))  # frequent characters get small codes: children lie close
    codes = np.zeros(0x110000, np.int32)
    codes[points] = np.arange(1, len(points) + 1)
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for text, i in pieces.items():
        node = 0
        for c in text:
            k = int(codes[ord(c)])
            if k not in children[node]:
                children[node][k] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][k]
        ends[node] = i
    size = 2 * len(children) + len(points) + 2
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    todo, first_free, tail = [(0, 0)], 1, 1
    for node, state in todo:
        kids = np.array(sorted(children[node]), np.int64)
        if not len(kids):
            continue
        if check[first_free] >= 0:
            gaps = np.flatnonzero(check[first_free:tail + 1] < 0)
            first_free = first_free + int(gaps[0]) if len(gaps) else tail
        at = max(1, first_free - int(kids[0]))
        for _ in range(4):  # the first gaps, or else after all others
            if at + kids[-1] >= len(check) or (check[at + kids] < 0).all():
                break
            at += 1
        else:
            at = max(at, tail - int(kids[0]))
        if at + kids[-1] >= len(check):
            grow = int(at + kids[-1])
            base, check, piece = (np.concatenate([a, np.full(grow, v, np.int32)]) for a, v in ((base, 0), (check, -1), (piece, -1)))
        if not (check[at + kids] < 0).all():
            at = tail
        base[state] = at
        tail = max(tail, int(at + kids[-1]) + 1)
        check[at + kids] = state
        for k in kids.tolist():
            child = children[node][k]
            piece[at + k] = ends[child]
            todo.append((child, at + k))
    raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    return Vocabulary(base, check, piece, codes, np.asarray(score, float), unknown_score, byte_piece, np.frombuffer(b"".join(raw), np.uint8), raw_at, max(map(len, pieces)))


def encode_words(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best split of each byte slice (spaces stand for markers): all ids and
    the n + 1 offsets of the slices' ids."""
    size = ends - starts
    flat = data[ragged(starts, size)]
    points = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((flat & 0xC0) != 0x80)
    first = np.searchsorted(lead, np.concatenate([[0], np.cumsum(size)]))  # first character of each word
    n = len(points)
    code = v.codes[np.where(points == 32, ord(MARKER), points)]
    word = np.repeat(np.arange(len(starts)), np.diff(first))
    stop = first[1:][word]
    # edges (from, to, piece): every character walks the trie at once
    here, state, step = np.arange(n), np.zeros(n, np.int64), 0
    edge_from, edge_to, edge_piece, single = [], [], [], np.zeros(n, bool)
    while len(here):
        nxt = v.base[state] + code[here + step]
        ok = (code[here + step] > 0) & (nxt < len(v.check))
        ok[ok] = v.check[nxt[ok]] == state[ok]
        here, state = here[ok], nxt[ok]
        step += 1
        found = v.piece[state]
        hit = found >= 0
        edge_from.append(here[hit])
        edge_to.append(here[hit] + step)
        edge_piece.append(found[hit])
        if step == 1:
            single[here[hit]] = True
        more = here + step < stop[here]
        here, state = here[more], state[more]
    lone = np.flatnonzero(~single)
    a = np.concatenate([*edge_from, lone])
    b = np.concatenate([*edge_to, lone + 1])
    p = np.concatenate([*edge_piece, np.full(len(lone), -1)])
    cost = np.where(p >= 0, v.score[p], v.unknown_score)
    # position i of word w is cell i + w, so that each word has an end of its own
    owner = word[a]
    depth = a - first[owner]
    a, b = a + owner, b + owner
    if len(depth) and depth.max() < 1 << 16:
        depth = depth.astype(np.uint16)  # sorted by radix
    order = np.argsort(depth, kind="stable")
    a, b, p, cost, depth = a[order], b[order], p[order], cost[order], depth[order]
    best = np.full(n + len(starts), -np.inf)
    best[first[:-1] + np.arange(len(starts))] = 0
    back, by = np.zeros(len(best), np.int64), np.full(len(best), -2, np.int64)
    cuts = np.searchsorted(depth, np.arange(int(depth[-1]) + 2)) if len(depth) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        value = best[a[lo:hi]] + cost[lo:hi]
        better = value > best[b[lo:hi]]
        at = b[lo:hi][better]
        best[at], back[at], by[at] = value[better], a[lo:hi][better], p[lo:hi][better]
    on_path = np.zeros(len(best), bool)
    cell, begin = first[1:] + np.arange(len(starts)), first[:-1] + np.arange(len(starts))
    while len(cell):
        keep = cell > begin
        cell, begin = cell[keep], begin[keep]
        on_path[cell] = True
        cell = back[cell]
    used = np.flatnonzero(on_path)
    ids = by[used]
    # an unknown character becomes the pieces of its bytes
    shift = word_shift(used, first)
    char = used - shift - 1
    width = np.where(ids < 0, np.diff(np.append(lead, len(flat)))[char], 1)
    out = np.repeat(ids, width)
    bytes_at = ragged(lead[char], width)
    out = np.where(out < 0, v.byte_piece[flat[bytes_at]], out)
    per_word = np.bincount(shift, weights=width, minlength=len(starts)).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(per_word)])


def word_shift(cells: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Word of each cell (word w has the cells first[w] + w ... first[w + 1] + w)."""
    return np.searchsorted(first[:-1] + np.arange(len(first) - 1), cells, side="right") - 1


class WordCache:
    """Ids of the words seen by a task, by word hash; starts anew beyond
    ``most`` words, so that its size has a bound."""

    def __init__(self, most: int = 1 << 20):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Place and count in ``ids`` for sorted distinct hashes; ``encode(i)``
        gives ids and offsets of the words number i, which are new."""
        if len(self.hashes) + len(hashes) > self.most:
            self.clear()
        i = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[i] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            ids, off = encode(new)
            at = np.insert(self.hashes, np.searchsorted(self.hashes, hashes[new]), hashes[new])
            places = np.searchsorted(self.hashes, hashes[new])
            self.at = np.insert(self.at, places, off[:-1] + len(self.ids))
            self.count = np.insert(self.count, places, np.diff(off))
            self.hashes = at
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            i = np.searchsorted(self.hashes, hashes)
        return self.at[i], self.count[i]


def encode_texts(v: Vocabulary, texts: pa.Array, cache: WordCache | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and their n + 1 offsets."""
    cache = cache or WordCache()
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARKER, " ")
    blank = pa.scalar("", pa.large_string())
    prefixed = pc.if_else(pc.equal(texts, blank), blank, pc.binary_join_element_wise(blank, texts, pa.scalar(" ", pa.large_string())))
    data, offsets = text_bytes(prefixed)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    space = data == 32
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    begins[n] = False
    begins[:n] |= space
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins[1:n] &= ~(space[1:] & space[:-1]) | edge[1:n]
    for c in (9, 10, 13):  # characters of no piece stand alone
        if not v.codes[c]:
            lone = np.flatnonzero(data == c)
            begins[lone] = True
            begins[lone + 1] = True
    begins[n] = False
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    hashes, one, which = np.unique(slice_hashes(data, starts, ends), return_index=True, return_inverse=True)
    at, count = cache.find(hashes, lambda i: encode_words(v, data, starts[one[i]], ends[one[i]]))
    count = count[which]
    tokens = cache.ids[ragged(at[which], count)]
    upto = np.concatenate([[0], np.cumsum(count)])
    return tokens, upto[np.searchsorted(starts, offsets)]


def decode_ids(v: Vocabulary, tokens: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts of the ids: pieces joined, markers as spaces, byte pieces as their
    bytes (ill-formed UTF-8 as U+FFFD), without the leading space."""
    size = np.diff(v.raw_at)[tokens]
    data = v.raw[ragged(v.raw_at[tokens], size)]
    upto = np.concatenate([[0], np.cumsum(size)])[offsets]
    keep = np.ones(len(data), bool)
    begin = upto[:-1][upto[:-1] < upto[1:]]
    keep[begin[data[begin] == 32]] = False
    data = data[keep]
    upto = np.concatenate([[0], np.cumsum(keep)])[upto]
    try:
        data.tobytes().decode("utf-8")
        return strings(data, upto)
    except UnicodeDecodeError:
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.string())


def _shared(df: DataFrame, model_path: str | None):
    return df.sparkSession.sparkContext.broadcast(load_vocabulary(model_path or default_model()))


def encode(df: DataFrame, *, text_col: str = "text", tokens_col: str = "tokens", model_path: str | None = None) -> DataFrame:
    """``df`` with the ids of each text (array<int>), ``n_tokens``, and
    ``round_trip``: whether the ids decode to the text again (markers in it as
    spaces, null as empty). The vocabulary is broadcast: its size is that of
    the model file, whatever the data."""
    shared = _shared(df, model_path)
    names = [c for c in df.columns if c not in (tokens_col, "n_tokens", "round_trip")]
    at = names.index(text_col)
    schema = df.select(*names).withColumn(tokens_col, F.array(F.lit(0))).withColumn("n_tokens", F.lit(0)).withColumn("round_trip", F.lit(True)).schema

    def run(batches: Iterator[pa.RecordBatch]):
        v, cache = shared.value, WordCache()
        for batch in chunks(batches, text_col):
            ids, off = encode_texts(v, batch.column(at), cache)
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
            meant = pc.replace_substring(pc.fill_null(batch.column(at).cast(pa.string()), ""), MARKER, " ")
            same = pc.equal(decode_ids(v, ids, off), meant)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(np.diff(off), pa.int32()), same], names=[*names, tokens_col, "n_tokens", "round_trip"])

    return df.select(*names).mapInArrow(run, schema)


def decode(df: DataFrame, *, tokens_col: str = "tokens", text_col: str = "decoded", model_path: str | None = None) -> DataFrame:
    """``df`` with the text of each id list (null: empty)."""
    shared = _shared(df, model_path)
    names = [c for c in df.columns if c != text_col]
    at = names.index(tokens_col)
    schema = df.select(*names).withColumn(text_col, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]):
        v = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = pc.fill_null(part.column(at), pa.scalar([], part.column(at).type))
                off = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, decode_ids(v, ids, off)], names=[*names, text_col])

    return df.select(*names).mapInArrow(run, schema)
