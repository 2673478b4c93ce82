"""Toxicity: a support vector machine over a gapped-subsequence string kernel
with Nyström landmarks.

Kernel: two strings share every subsequence of three letters that both hold
within seven characters; each occurrence counts ``DECAY`` to the power of its
gaps. Characters that are no letters only widen gaps, so ``i-d-i-o-t`` and
``idxiot`` stay close to ``idiot``. A sentence is compared unit by unit (its
words, and runs of single letters such as ``i d i o t`` as one unit) and its
value is that of its worst unit; a document's value is that of its worst
sentence, put through a logistic curve.

The decision value is linear in a string's subsequences: with landmarks L and
the machine's weights w it is ``sum over u of occurrences(u) * table[u]`` where
``table = features(L)' K(L, L)^-1/2 w``. So scoring costs a few gathers per
character, whatever the number of landmarks.

Training takes a bounded sample: ``sample_rows`` labelled rows of each class
(smallest id hashes). Labels belong to documents; the units to blame are found
by greedy cover: the unit in most toxic and hardly any clean documents first,
until no unit explains three more documents. Sentences with such a unit are
the toxic ones, units of clean documents' sentences the others.

Defined results: null and empty texts, and texts without units of three
letters, get the score of no evidence; with labels of one class only (or none)
every score is the smoothed share of toxic rows; rows with a null id or label
are not learnt from; equal texts have equal scores; all of a text is read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import ValueCache, chunks, ragged, slice_hashes, text_bytes, word_slices

SPAN, DECAY = 7, 0.6
SHIFTS = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]
SYMBOLS = 32
_CODE = np.zeros(0x110000, np.int16)
_CODE[ord("a"):ord("z") + 1] = _CODE[ord("A"):ord("Z") + 1] = np.arange(1, 27)
_CODE[0xC0:0x250] = 27 + np.arange(0x250 - 0xC0) % 5
_CODE[0x370:0x2000] = 27 + np.arange(0x2000 - 0x370) % 5
_CODE[0x3040:0xE000] = 27 + np.arange(0xE000 - 0x3040) % 5


def letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes (0: no letter) of the slices and their n + 1 offsets."""
    size = ends - starts
    flat = data[ragged(starts, size)]
    points = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((flat & 0xC0) != 0x80)
    return _CODE[points], np.searchsorted(lead, np.concatenate([[0], np.cumsum(size)]))


def occurrences(code: np.ndarray, off: np.ndarray):
    """For each shift: places, subsequences and weights of all strings."""
    stop = np.repeat(off[1:], np.diff(off))
    place = np.arange(len(code))
    for a, b, weight in SHIFTS:
        i = place[:max(0, len(code) - b)]
        i = i[(code[i] > 0) & (i + b < stop[i])]
        i = i[(code[i + a] > 0) & (code[i + b] > 0)]
        yield i, (code[i].astype(np.int32) * SYMBOLS + code[i + a]) * SYMBOLS + code[i + b], weight


def values(table: np.ndarray, code: np.ndarray, off: np.ndarray) -> np.ndarray:
    """sum(table[u] * weight) / sqrt(sum(weight^2)) of each string."""
    total, norm = np.zeros(len(code) + 1), np.zeros(len(code) + 1)
    for i, u, weight in occurrences(code, off):
        total[i + 1] += weight * table[u]
        norm[i + 1] += weight * weight
    # equal strings must have equal values wherever they stand: sum per string
    word = np.repeat(np.arange(len(off) - 1), np.diff(off))
    t = np.bincount(word, total[1:], len(off) - 1)
    return np.round(t / np.sqrt(np.maximum(np.bincount(word, norm[1:], len(off) - 1), 1e-9)), 9)


def features(strings: list[str]) -> np.ndarray:
    """Normalised subsequence vectors (one row per string)."""
    out = np.zeros((len(strings), SYMBOLS**3), np.float32)
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(s.encode()) for s in strings])])
    code, at = letters(data, off[:-1], off[1:])
    word = np.repeat(np.arange(len(strings)), np.diff(at))
    norm = np.zeros(len(strings))
    for i, u, weight in occurrences(code, at):
        np.add.at(out, (word[i], u), weight)
        norm += np.bincount(word[i], minlength=len(strings)) * weight * weight
    return out / np.sqrt(np.maximum(norm, 1e-9))[:, None].astype(np.float32)


def kernels(strings: list[str], marks: np.ndarray) -> np.ndarray:
    """Kernel of each string with each landmark (given by its features)."""
    table, out = np.ascontiguousarray(marks.T), np.zeros((len(strings), len(marks)), np.float32)
    for start in range(0, len(strings), 1000):
        some = strings[start:start + 1000]
        data = np.frombuffer("".join(some).encode(), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(s.encode()) for s in some])])
        code, at = letters(data, off[:-1], off[1:])
        word = np.repeat(np.arange(len(some)), np.diff(at))
        norm = np.zeros(len(some))
        for i, u, weight in occurrences(code, at):
            if len(i):
                first = np.flatnonzero(np.append(True, word[i][1:] != word[i][:-1]))
                out[start + word[i[first]]] += weight * np.add.reduceat(table[u], first, axis=0)
                norm += np.bincount(word[i], minlength=len(some)) * weight * weight
        out[start:start + len(some)] /= np.sqrt(np.maximum(norm, 1e-9))[:, None].astype(np.float32)
    return out


@dataclass
class Machine:
    table: np.ndarray
    offset: float
    slope: float = 4.0
    shift: float = 0.0


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of all units: words, and runs of three or more
    single letters."""
    s, e, first = word_slices(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if not len(s):
        return s, e, text
    lone = (e - s == 1) & (_CODE[data[s]] > 0)
    joined = np.zeros(len(s) + 1, bool)  # word i goes on the run of word i - 1
    joined[1:-1] = lone[1:] & lone[:-1] & (text[1:] == text[:-1])
    runs = np.flatnonzero(lone & ~joined[:-1] & joined[1:])
    last = np.flatnonzero(lone & joined[:-1] & ~joined[1:])
    long = last - runs >= 2
    runs, last = runs[long], last[long]
    return np.concatenate([s, s[runs]]), np.concatenate([e, e[last]]), np.concatenate([text, text[runs]])


def worst(machine: Machine, data: np.ndarray, offsets: np.ndarray, cache: ValueCache) -> np.ndarray:
    """Decision value of each text: that of its worst unit."""
    s, e, text = units(data, offsets)
    out = np.full(len(offsets) - 1, -1.0)
    if len(s):
        h, one, which = np.unique(slice_hashes(data, s, e), return_index=True, return_inverse=True)
        v = cache.find(h, lambda i: values(machine.table, *letters(data, s[one[i]], e[one[i]])) + machine.offset)
        np.maximum.at(out, text, v[which])
    return out


def variants(word: str, r: np.random.Generator) -> list[str]:
    """A word with an inserted letter, and with separators between letters."""
    out = ["-".join(word), " ".join(word)]
    for i in range(1, len(word)):
        out.append(word[:i] + chr(97 + int(r.integers(26))) + word[i:])
    return out


def train(toxic: list[str], clean: list[str], *, landmarks: int = 240, steps: int = 500, seed: int = 5) -> Machine:
    """Linear machine (hinge loss) on Nyström features of the strings."""
    r = np.random.default_rng(seed)
    base = toxic + [clean[i] for i in r.permutation(len(clean))[:max(0, landmarks - len(toxic))]]
    marks = features(base[:max(landmarks, len(toxic))])
    strings = toxic + [v for w in toxic for v in variants(w, r)]
    n_toxic = len(strings)
    strings = strings + clean
    k = marks @ marks.T
    lam, vec = np.linalg.eigh(k.astype(float))
    keep = lam > 1e-4
    root = vec[:, keep] / np.sqrt(lam[keep])  # K(L, L)^-1/2 up to a rotation
    z = kernels(strings, marks) @ root.astype(np.float32)
    y = np.where(np.arange(len(z)) < n_toxic, 1.0, -1.0)
    cost = np.where(y > 0, 0.5 / n_toxic, 0.5 / max(1, len(z) - n_toxic))
    w, c = np.zeros(z.shape[1]), -0.5
    m, q, mc, qc = 0.0, 0.0, 0.0, 0.0
    for t in range(1, steps + 1):  # Adam on 1/2 ridge |w|^2 + weighted squared hinge
        slack = np.maximum(0, 1 - y * (z @ w + c))
        g = -2 * z.T @ (cost * y * slack) + 1e-4 * w
        gc = -2 * float(np.sum(cost * y * slack))
        m, q, mc, qc = 0.9 * m + 0.1 * g, 0.99 * q + 0.01 * g * g, 0.9 * mc + 0.1 * gc, 0.99 * qc + 0.01 * gc * gc
        rate = 0.1 * (1 - t / (steps + 1))
        w = w - rate * m / (1 - 0.9**t) / (np.sqrt(q / (1 - 0.99**t)) + 1e-8)
        c -= rate * mc / (1 - 0.9**t) / (np.sqrt(qc / (1 - 0.99**t)) + 1e-8)
    return Machine((marks.T @ (root @ w)).astype(np.float64), float(c))


def blamed(docs: list[set[str]], rest: Counter, n_rest: int) -> list[str]:
    """Units that toxic documents have and hardly any clean one: by greedy
    cover of the toxic documents (each explains three more), and those in one
    toxic document of 20 and at least eight. Near copies, told by the least hash of their rarer units
    (in one document of 20 at most), count as one document, else all their rare
    words would seem to blame."""
    common = Counter(u for d in docs for u in d)
    rarer = max(2, len(docs) // 20)
    family = [min(((zlib.crc32(u.encode()), u) for u in d if common[u] <= rarer), default=(i, "")) for i, d in enumerate(docs)]
    n = len(set(family))
    where: dict[str, set] = {}
    for f, d in zip(family, docs, strict=True):
        for u in d:
            where.setdefault(u, set()).add(f)
    where = {u: w for u, w in where.items() if len(w) >= 3 and rest[u] * 20 * n <= len(w) * n_rest}
    ranked = sorted(where, key=lambda u: (-len(where[u]), u))
    left, out = set(family), [u for u in ranked if len(where[u]) >= max(8, n / 20)]
    for u in out:
        left -= where[u]
    while True:
        best, gain = None, 2
        for u in ranked:
            if len(where[u]) <= gain:
                break
            now = len(where[u] & left)
            if now > gain:
                best, gain = u, now
        if best is None:
            return out
        out.append(best)
        left -= where[best]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(y = 1) = 1 / (1 + exp(-(slope * x + shift)))."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum((p - y) * x) + 0.02 * (a - 1), np.sum(p - y) + 0.02 * b])
        s = p * (1 - p)
        h = np.array([[np.sum(s * x * x) + 0.02, np.sum(s * x)], [np.sum(s * x), np.sum(s) + 0.02]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return max(a, 1e-3), b


def _unit_texts(data: np.ndarray, offsets: np.ndarray) -> list[set[str]]:
    s, e, text = units(data, offsets)
    raw = data.tobytes()
    out: list[set[str]] = [set() for _ in range(len(offsets) - 1)]
    for a, b, t in zip(s.tolist(), e.tolist(), text.tolist(), strict=True):
        w = raw[a:b].decode("utf-8").lower().strip(".,;:!?\"'()[]*$%&#|-")
        if len(w) >= 3:
            out[t].add(w)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id", sample_rows: int = 1500, clean_units: int = 12_000) -> Machine:
    """Train on the texts of ``sample_rows`` rows of ``labels`` of each class.
    The sample is broadcast; only its units come to the driver."""
    base = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"), F.xxhash64(F.col(id_col)).alias("h")).filter("k is not null and y is not null")
    sample = base.filter("y = 1").orderBy("h").limit(sample_rows).union(base.filter("y = 0").orderBy("h").limit(sample_rows))
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(sample), "k").select("h", "y", "t")

    def cut(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches, "t"):
            data, offsets = text_bytes(b.column(2))
            found = ["\n".join(sorted(u)) for u in _unit_texts(data, offsets)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], names=["h", "y", "u"])

    rows = sorted((x.h, x.y, x.u) for x in texts.mapInArrow(cut, "h long, y int, u string").collect())
    sets = [set(u.split("\n")) - {""} for _, _, u in rows]
    y = np.array([label for _, label, _ in rows])
    share = (float(y.sum()) + 0.5) / (len(y) + 1) if len(y) else 0.5
    nothing = Machine(np.zeros(SYMBOLS**3), -1.0, 0.0, float(np.log(share / (1 - share))))
    if not (y == 1).any() or not (y == 0).any():
        return nothing
    rest = Counter(u for s, label in zip(sets, y, strict=True) if label == 0 for u in s)
    toxic = blamed([s for s, label in zip(sets, y, strict=True) if label == 1], rest, int((y == 0).sum()))
    if not toxic:
        return nothing
    named = set(toxic)
    others = sorted(set(rest) - named)
    r = np.random.default_rng(3)
    clean = [u for u, _ in rest.most_common(clean_units // 6) if u not in named] + [others[i] for i in r.permutation(len(others))[:clean_units // 3]]
    machine = train(toxic, clean)
    for _ in range(2):  # learn again with the clean units that look worst
        v = _values_of(machine, others)
        hard = [others[i] for i in np.argsort(-v, kind="stable")[:clean_units // 4]]
        clean = sorted(set(clean) | set(hard))
        machine = train(toxic, clean)
    known = dict(zip(others + toxic, _values_of(machine, others + toxic), strict=True))
    every = sorted({u for s in sets for u in s} - set(known))
    known |= dict(zip(every, _values_of(machine, every), strict=True))
    top = np.array([max([known[u] for u in s], default=-1.0) for s in sets])
    machine.slope, machine.shift = logistic(np.maximum(top, -1.0), y.astype(float))
    return machine


def _values_of(machine: Machine, strings: list[str]) -> np.ndarray:
    out = []
    for i in range(0, len(strings), 20_000):
        some = strings[i:i + 20_000]
        data = np.frombuffer("".join(some).encode(), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(s.encode()) for s in some])])
        out.append(values(machine.table, *letters(data, off[:-1], off[1:])) + machine.offset)
    return np.concatenate(out) if out else np.zeros(0)


def score(df: DataFrame, machine: Machine, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with each whole text's probability of being toxic."""
    names = [c for c in df.columns if c != score_col]
    at = names.index(text_col)
    schema = df.select(*names).withColumn(score_col, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]):
        cache = ValueCache()
        for b in chunks(batches, text_col):
            data, offsets = text_bytes(b.column(at))
            z = machine.slope * np.maximum(worst(machine, data, offsets, cache), -1.0) + machine.shift
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-z)))], names=[*names, score_col])

    return df.select(*names).mapInArrow(run, schema)
