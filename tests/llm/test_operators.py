"""Training-data operators on Spark against brute force or DuckDB."""

import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from marketlens.llm import common, decontaminate, fingerprint, graph, line_dedup, ngram_join, quality_cnn, recompression, suffix_dedup, toxicity, warc
from marketlens.llm import queries as llm_queries
from marketlens.llm import sentencepiece_codec as sp

SCHEMA = "doc_id long, text string, id string, t string, score double, tokens string, key string"


def corpus():
    """Texts with copies, near copies, shared passages, long and empty ones."""
    r = np.random.default_rng(11)
    word = lambda: "".join("etaoinsr"[int(c)] for c in r.integers(0, 8, int(r.integers(1, 7))))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(45), text(120)
    edit = lambda s, k: " ".join(word() if i in set(r.integers(0, 120, k).tolist()) else w for i, w in enumerate(s.split()))
    texts = [base, base, edit(base, 2), edit(base, 4), edit(base, 40), base.upper(), None, "", "  \n\t ", "one two", "one two", "one  two three",
             text(30) + "\n" + passage + "\n" + text(30), text(10) + " " + passage, passage, passage + " " + passage, "ab " * 60, "ab " * 70, "é" * 900, "é" * 1000, text(3000) + "\n" + passage]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", 1.0, "z", "k") for i, t in corpus()]  # columns with names used inside
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def duck(sql, rows, **tables):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    for name, (cols, values) in tables.items():
        con.execute(f"create table {name} ({cols})")
        con.executemany(f"insert into {name} values (?, ?)", values)
    return sorted(con.execute(sql).fetchall())


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- shared ----------------------------------------------------------------

def test_components(spark):
    r = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 120, (80, 2))] + [(i, i + 1) for i in range(200, 230)] + [(5, 5), (None, 3)]
    got = dict(rows_of(graph.components(spark.createDataFrame(pairs, "a long, b long")), "node", "root"))
    parent = {x: x for p in pairs if None not in p for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_dir_is_never_local_on_a_cluster(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_training_fold(spark):
    df = spark.range(50).withColumn("ok", common.in_training_fold("id"))
    assert all(r.ok == (zlib.crc32(str(r.id).encode()) % 5 != 0) for r in df.collect())
    assert spark.sql("select cast(null as bigint) id").select(common.in_training_fold("id")).first()[0] is False


# --- 1 ---------------------------------------------------------------------

def lines_by_force(rows, similarity=0.8):
    """All pairs of lines by their edit distance, row by row."""
    norm = lambda s: re.sub(r"[^\w]+|_+", " ", s.lower()).strip(" ")
    places, first = [], {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if k := norm(line):
                places.append((i, n, k))
                first[k] = min(first.get(k, (i, n)), (i, n))
    parent = {k: k for k in first}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for a in first:  # all pairs, whatever they share
        for b in first:
            longer = max(len(a), len(b))
            if a < b and min(len(a), len(b)) >= longer * similarity and distance(a, b) <= int(longer * (1 - similarity) + 1e-9):
                parent[find(a)] = find(b)
    keep = {}
    for k, at in first.items():
        keep[find(k)] = min(keep.get(find(k), at), at)
    gone = collections.defaultdict(list)
    for i, n, k in places:
        if (i, n) != keep[find(k)]:
            gone[i].append(n)
    return {i: sorted(gone[i]) for i, _ in rows}


def test_line_dedup(spark):
    r = np.random.default_rng(5)
    word = lambda: "".join("etaoinsr"[int(c)] for c in r.integers(0, 8, 5))
    lines = [" ".join(word() for _ in range(30)) for _ in range(8)]
    near = lambda s: s.replace(s.split()[7], s.split()[7] + "x").title() + "!"
    rows = [(i, "\n".join([lines[i % 8], near(lines[(i + 3) % 8]), word() + " " + word(), "--", lines[i % 3]])) for i in range(12)] + [(50, None), (51, ""), (52, "\n\n"), (53, "  ")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    want = lines_by_force(rows)
    got = {x.doc_id: x for x in line_dedup.removed_lines(df).collect()}
    assert {i: g.removed for i, g in got.items()} == want and any(want.values())
    assert got[50].n_lines == 0 and got[52].n_lines == 3
    kept = {x.doc_id: x.text for x in line_dedup.deduplicated(df).collect()}
    for i, t in rows:
        assert kept[i] == (t if t is None or not want[i] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i]))
    assert line_dedup.removed_lines(df.limit(0)).count() == 0


def test_simhash_of_long_lines(spark):
    df = spark.createDataFrame([(b"1", "a " * 70_000 + "b"), (b"2", "a")], "key binary, norm string")
    one, two = sorted(line_dedup.simhashes(df).collect(), key=lambda x: x.key)
    assert (one.u, one.v) == (two.u, two.v)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_recall_by_kind_of_edit(spark):
    """Pairs of similarity 0.8 and more, by all-pairs edit distance: the share
    found, for words replaced and for letters replaced in many words."""
    r = np.random.default_rng(17)
    parts = "the and ing tion en er on th in re st ou at ha nt sh ed es wh ble ly or an is it of".split()
    word = lambda: "".join(r.choice(parts, int(r.integers(1, 5))))
    kinds = {("words", 0.05, 40): 0.95, ("words", 0.1, 40): 0.95, ("words", 0.15, 40): 0.95, ("words", 0.2, 40): 0.95, ("words", 0.2, 10): 0.9,
             ("words", 0.1, 12): 0.95, ("words", 0.1, 8): 0.95, ("letter", 2, 40): 0.9, ("letter", 4, 40): 0.9, ("letter", 1, 40): 0.0}
    rows, pairs = [], {}
    for kind, amount, n in kinds:
        for _ in range(40):
            words = [word() for _ in range(n)]
            changed = list(words)
            if kind == "words":
                for i in r.choice(n, max(1, round(amount * n)), replace=False):
                    changed[i] = word()
            else:
                for i in range(0, n, amount):
                    at = int(r.integers(len(changed[i])))
                    changed[i] = changed[i][:at] + "abcdefghijklmnopqrstuvwxyz"[int(r.integers(26))] + changed[i][at + 1:]
            a, b = " ".join(words), " ".join(changed)
            rows += [(len(rows), a), (len(rows) + 1, b)]
            pairs[len(rows) - 1] = (kind, amount, n), a != b and edit_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)
    got = {x.doc_id: x.n_removed for x in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind, least in kinds.items():
        true = [i for i, (k, near) in pairs.items() if k == kind and near]
        assert len(true) >= 10 and sum(got[i] for i in true) >= least * len(true), kind
    assert all(got[i] == 0 for i, (k, near) in pairs.items() if not near and k[0] == "words")


def test_a_line_has_all_of_its_pieces(spark):
    words = ["w%d" % i for i in range(100)]
    df = spark.createDataFrame([(0, " ".join(words)), (1, "a b c d e"), (2, "a b"), (3, "a b a b a b a")], "key long, norm string")
    got = collections.Counter(x.key for x in line_dedup.pieces(df).collect())
    assert got == {0: 98 + 96, 1: 3 + 1, 2: 1, 3: 2 + 2}
    # one triple in common, wherever it stands, is a shared piece
    pairs = [(2 * i, " ".join(f"x{i}" + w for w in words)) for i in range(20)]
    pairs += [(2 * i + 1, " ".join((f"x{i}" if 3 * i <= j < 3 * i + 3 else f"y{i}") + w for j, w in enumerate(words))) for i in range(20)]
    shared = line_dedup.shared_pieces(spark.createDataFrame(pairs, "key long, norm string")).collect()
    assert collections.Counter((x.key, x.lead) for x in shared) == {(k, 2 * i): 1 for i in range(20) for k in (2 * i, 2 * i + 1)}


def test_short_lines_lose_no_link(spark):
    r = np.random.default_rng(23)
    text = lambda n: "".join("abcde  "[int(c)] for c in r.integers(0, 7, n))
    lines = ["the colour of", "the color of", "grey", "gray", "page 1001", "page 1002", "page 2002", "Über uns", "über u s", "ab cde", "abcde", "a", "b"]
    for _ in range(150):  # few letters, so that many pairs are near; some with a letter changed, left out or added
        one = text(int(r.integers(1, line_dedup.DELETIONS_TO + 1)))
        at = int(r.integers(0, len(one) + 1))
        lines += [one, one[:at] + "ab c"[int(r.integers(0, 4))] * int(r.integers(0, 2)) + one[at + int(r.integers(0, 2)):]]
    rows = [(i, x) for i, x in enumerate(lines) if len(x) <= line_dedup.DELETIONS_TO]
    want = lines_by_force(rows)
    got = {x.doc_id: x.removed for x in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    # all pairs, whatever the other lines join them to
    keyed = spark.createDataFrame(sorted({re.sub(" +", " ", x).strip() for _, x in rows} - {""}), "string").select(F.monotonically_increasing_id().alias("key"), F.col("value").alias("norm"))
    texts = {x.key: x.norm for x in keyed.collect()}
    links = {(x.a, x.b) for x in line_dedup.links(keyed, line_dedup.short_pairs(keyed, 0.8), 0.8).collect()}
    near = lambda a, b: edit_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)
    assert links == {(i, j) for i in texts for j in texts if i < j and near(texts[i], texts[j])} and len(links) > 50


def test_exact_search_finds_pairs_without_a_whole_word(spark):
    r = np.random.default_rng(29)
    letters = lambda n: "".join("abcdefghijklmnop"[int(c)] for c in r.integers(0, 16, n))
    rows = []
    for n in (5, 12, 40):
        words = [letters(7) for _ in range(n)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(w[:3] + "z" + w[4:] for w in words))]
    df = spark.createDataFrame([*rows, (10, None)], "doc_id long, text string")
    found = lambda **how: {x.doc_id for x in line_dedup.removed_lines(df, **how).collect() if x.n_removed}
    assert found() == set() and found(exact=True) == {1, 3, 5}
    assert {x.doc_id for x in line_dedup.deduplicated(df, exact=True).collect() if x.text == ""} == {1, 3, 5}


def test_query_and_pipeline_lose_no_link_of_lines_of_any_length(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(37)
    word = lambda: "".join("the and ing tion en er on th re st ou é ß".split()[int(c)] for c in r.integers(0, 13, int(r.integers(1, 4))))
    lines = ["international communications", "international communication", "internationale communication", "contact the administrator today", "contact the administrators today",
             "counter-revolutionaries", "counter revolutionary's", "a" * 15, "a" * 18, "a" * 23, "😀 is no letter", "𐐷𐐷𐐷𐐷𐐷 of five", "𐐷𐐷𐐷𐐷x of five", "x"]
    for n in (2, 3, 4, 5, 8, 12, 25):
        for share in (1, 1, 2):  # a letter changed, left out or added in every word or every second one
            words = [word() + "esta" for _ in range(n)]
            at = [int(r.integers(0, len(w))) for w in words]
            lines += [" ".join(words), " ".join(w if i % share else w[:k] + "abc "[int(r.integers(0, 3))] * int(r.integers(0, 2)) + w[k + int(r.integers(0, 2)):] for i, (w, k) in enumerate(zip(words, at)))]
    rows = [(i, x) for i, x in enumerate(lines)] + [(900, None), (901, "\n".join(lines[::7])), (902, "")]
    want = lines_by_force(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    query = lambda: {x.doc_id: x.removed for x in llm_queries.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert query() == want and sum(map(len, want.values())) > 15
    monkeypatch.setattr(line_dedup, "PART_ROWS", 8)  # many parts, each compared with each
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert query() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kept = {x.doc_id: x.text for x in corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).collect()}
    assert kept == {i: t if t is None or not want[i] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i]) for i, t in rows}


def test_line_texts_are_stored_once_and_pairs_in_shares(spark, monkeypatch):
    written, plain = [], common.stored

    def noted(df, name):
        written.append((name, plain(df, name)))
        return written[-1][1]

    monkeypatch.setattr(line_dedup, "stored", noted)
    r = np.random.default_rng(31)
    rows = []
    for i in range(60):
        words = ["w%d" % x for x in r.integers(0, 40, 30)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join("other" if j == i % 30 else w for j, w in enumerate(words)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {x.doc_id: x.removed for x in line_dedup.removed_lines(df).collect()}
    assert whole == {i: [0] if i % 2 else [] for i in range(120)}
    there = [n for n, x in written if "norm" in x.columns and os.path.exists(x.inputFiles()[0].removeprefix("file:").replace("//", ""))]
    assert there == ["line-classes"]  # the table of all lines is gone once it was counted
    assert [n for n, _ in written].count("line-open-pairs") == line_dedup.OPEN_PASSES
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 10)
    assert {x.doc_id: x.removed for x in line_dedup.removed_lines(df).collect()} == whole
    assert [n for n, _ in written].count("line-links") > 4  # several shares of the pairs


def test_lines_of_rows_that_share_an_id(spark):
    a, b, c, d = "alpha apples in orchards", "winter gloves kept warm", "dull copper pans hung low", "seven ships went northward"
    rows = [(None, f"{a}\n{b}"), (None, f"{c}\n{a}"), (7, f"{d}\n{b}"), (7, d), (7, d), (8, None)]
    cols = "doc_id long, text string, _gone int, row_key int, lost_lines string, id int"
    df = spark.createDataFrame([(*x, 1, 777, "x", 3) for x in rows], cols)
    left = line_dedup.deduplicated(df)
    assert left.columns == df.columns and {tuple(x)[2:] for x in left.collect()} == {(1, 777, "x", 3)} and left.count() == 6
    kept = collections.Counter(line for x in left.collect() for line in (x.text or "").split("\n") if line)
    assert kept == {a: 1, b: 1, c: 1, d: 1}  # every line once, none lost
    assert line_dedup.removed_lines(df).agg(F.sum("n_removed")).first()[0] == 4
    again = ngram_join.one_of_each(df)
    assert again.columns == df.columns and {x.row_key for x in again.collect()} == {777}


def test_very_long_lines(spark):
    r = np.random.default_rng(3)
    words = ["w%d" % x for x in r.integers(0, 5000, 4000)]
    changed = " ".join("other" if i % 40 == 0 else w for i, w in enumerate(words))
    rows = [(1, " ".join(words)), (2, changed), (3, "z" * 300_000), (4, "z" * 300_000 + " !"), (5, "no such line " * 20_000)]
    got = {x.doc_id: x.n_removed for x in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


def test_all_groups_of_a_bucket_meet(spark):
    n = line_dedup.PART_ROWS + 50  # two salted parts; u and v tell 16 families apart, far from each other
    code = lambda f: int(np.uint64(sum(((f & p).bit_count() & 1) << p for p in range(64))).astype(np.int64))  # noqa: E731  64 of 128 bits apart
    known = spark.createDataFrame([(i, (i, 90, code(i % 16), code(i % 16))) for i in range(n)], "key long, m struct<key: bigint, size: int, u: bigint, v: bigint>")
    shared = spark.createDataFrame([(k, i, 0) for k in (1, 2) for i in range(n)] + [(3, i, i % 16) for i in range(n)], "bucket long, key long, lead long")
    number = lambda found: {(x.a, x.b) for x in found.collect()}
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if i % 16 == j % 16}
    none = spark.createDataFrame([], "key long, root long")
    assert number(line_dedup.head_pairs(shared, known, 0.8)) == {(i, j) for i, j in want if i == 0}
    assert number(line_dedup.open_pairs(shared, known, none, 0.8)) == want
    grouped = spark.createDataFrame([(i, i % 16) for i in range(n)], "key long, root long")
    assert line_dedup.open_pairs(shared, known, grouped, 0.8).count() == 0
    once = shared.filter("bucket = 1")  # one shared piece is not enough for long lines
    assert line_dedup.open_pairs(once, known, none, 0.8).count() == 0 == line_dedup.head_pairs(once, known, 0.8).count()


# --- 2, 3, 5 ---------------------------------------------------------------

def test_ngram_join(docs):
    got = rows_of(ngram_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert got == duck(ngram_join.oracle(), corpus())
    assert len({c for _, _, c in got}) < len(got) - 5
    one = ngram_join.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len({c for _, _, c in got})
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_ngram_join_random(spark):
    r = np.random.default_rng(8)
    rows = []
    for g in range(12):
        base = [str(int(x)) for x in r.integers(0, 400, int(r.integers(6, 60)))]
        for _ in range(int(r.integers(1, 9))):
            rows.append((len(rows), " ".join(w if r.random() > 0.03 else str(int(r.integers(0, 400))) for w in base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(ngram_join.near_duplicates(df), "doc_id", "n_shingles", "component_id") == duck(ngram_join.oracle(), rows)


def test_recompression(docs, spark):
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert rows_of(recompression.deduplicated(docs), *cols) == duck(recompression.oracle(), corpus())
    assert recompression.deduplicated(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "a " * 30), (1, "a " * 30)], "doc_id long, text string")
    assert {x.doc_id: x.n_removed for x in recompression.deduplicated(none).collect()} == {None: 29, 1: 30}


def bytes_by_force(rows, length):
    seen = collections.Counter(t[i:i + length] for _, t in rows for i in range(len(t) - length + 1))
    for k, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        yield k, len(t), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length", [400, 64])
def test_suffix_dedup(docs, length):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = sorted(bytes_by_force([(i, (t or "").encode()) for i, t in corpus()], length))
    got = rows_of(suffix_dedup.deduplicated(docs, length=length), *cols)
    assert got == want and any(x[2] for x in got)
    assert suffix_dedup.deduplicated(docs.limit(0)).count() == 0


# --- 4 ---------------------------------------------------------------------

def test_rows_without_ids_of_their_own(spark):
    words = [f"w{i}" for i in range(400)]
    cut = lambda i, j: " ".join(words[i:j])
    shared = cut(0, 40)
    rows = [(None, cut(100, 160) + " " + shared), (None, "x y " + shared), (7, shared), (7, cut(200, 225)), (9, cut(300, 400))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((x.n_words, x.n_removed) for x in recompression.deduplicated(df).collect())
    assert [w for w, _ in got] == [25, 40, 42, 100, 100] and sum(n for _, n in got) == 80
    assert all(n == 0 for w, n in got if w == 25) and sum(n for w, n in got if w == 100) in (0, 40)
    rows = [(5, "a" * 90 + "b" * 500), (5, "c" * 30), (None, "d" * 40), (None, "z" + "b" * 450), (8, "e" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {x.n_bytes: x.n_removed for x in suffix_dedup.deduplicated(df, length=400).collect()}
    assert got == {590: 500, 30: 0, 40: 0, 451: 450, 20: 0}


def test_join_of_rows_that_repeat_an_id(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, one), (5, two), (1, one), (5, one), (None, two), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((x.doc_id, x.text) for x in ngram_join.one_of_each(df).collect()), key=str)
    assert left == sorted([(1, one), (5, two), (None, None)], key=str)
    got = sorted(((x.doc_id, x.component_id) for x in ngram_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 1), (5, 5), (1, 1), (5, 1), (None, 5), (None, None)], key=str)


def test_fingerprints_of_edits(docs, spark):
    got = {x.doc_id: x for x in fingerprint.compare_edits(docs).collect()}
    order = sorted(((i, t or "") for i, t in corpus()), reverse=True)
    for (i, t), (j, nxt) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[:len(t) - k] + nxt[:k]).encode()).hexdigest()
        assert got[i].near_next == fingerprint.likeness(*(fingerprint.from_text(got[x].fingerprint) for x in (i, j)))
    assert got[0].fingerprint == got[1].fingerprint and got[1].near_next == 1
    plain = {x.doc_id: x.fingerprint for x in fingerprint.fingerprint(docs).collect()}
    assert plain == {i: x.fingerprint for i, x in got.items()}
    assert fingerprint.compare_edits(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a"), (3, "b"), (3, "c")], "doc_id long, text string")
    assert fingerprint.compare_edits(odd).count() == 3


# --- 6 ---------------------------------------------------------------------

def test_warc_round_trip(spark):
    big = "x" * 1000
    rows = [(1, "u", big), (2, "u 2", big), (3, None, "é" * 400), (4, "", None), (5, "v", ""), (6, "v", "é" * 400), (7, "v", big), (8, "w", "y" * 1200)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(3)
    path = common.new_path(spark, "warc-test")
    warc.write(pages, path)
    found = {x.record_id.removeprefix(warc.URN): x for x in warc.read(spark, path).collect()}
    assert {k: (x.record_type, (x.refers_to or "").removeprefix(warc.URN)) for k, x in found.items() if x.record_type == "revisit"} == {"1": ("revisit", "7"), "2": ("revisit", "7")}
    for i, _, html in rows:
        x = found[str(i)]
        assert x.payload_digest == hashlib.sha1((html or "").encode()).hexdigest() and x.payload_bytes == len((html or "").encode())
        assert x.payload is None if x.record_type == "revisit" else bytes(x.payload) == (html or "").encode()
    empty = common.new_path(spark, "warc-test")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


# --- 7 ---------------------------------------------------------------------

def test_leaks(spark):
    r = np.random.default_rng(3)
    text = lambda n: [f"w{int(x)}" for x in r.integers(0, 60, n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate((30, 15, 12, 8, 5))] + [(9, None), (10, "")]
    rows = []
    for i in range(40):
        w = text(40)
        item = items[i % 5][1].split()
        for k in r.integers(0, len(item), i // 10).tolist():
            item[k] = "other"
        rows.append((i, " ".join(w[:20]) + ", " + " ".join(item[:len(item) - i % 3]).upper() + "! " + " ".join(w[20:])))
    rows += [(90, None), (91, ""), (92, items[0][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, seed int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ["doc_id", "item_id", "n_equal", "n_words"]
    got = rows_of(decontaminate.leaks(df, bench), *cols)
    assert got == duck(decontaminate.oracle(), rows, benchmark=("item_id bigint, text varchar", items)) and len(got) > 10
    left = decontaminate.decontaminated(df, bench)
    assert {x.doc_id for x in left.collect()} == {i for i, _ in rows} - {g[0] for g in got}
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


# --- 8, 9, 10 --------------------------------------------------------------

def test_sentencepiece_on_spark(docs):
    out = sp.encode(docs)
    assert out.columns[:2] == ["doc_id", "text"] and out.filter("not round_trip or n_tokens <> size(tokens)").count() == 0
    back = sp.decode(out).collect()
    assert all(x.decoded == (x.text or "") for x in back) and len(back) == len(corpus())
    assert sp.encode(docs.limit(0)).count() == 0


def labelled(spark):
    r = np.random.default_rng(21)
    word = lambda: "".join("etaoinsrdl"[int(c)] for c in r.integers(0, 10, int(r.integers(2, 8))))
    rows, labels = [], []
    for i in range(260):
        w = [word() for _ in range(int(r.integers(10, 50)))]
        bad, junk = i % 3 == 0, i % 4 == 0
        if bad:
            w[int(r.integers(len(w)))] = ["grumbuk", "zwackel", "G.r.u.m.b.u.k", "zwackxel"][i % 4]
        rows.append((i, " ".join(x.upper() + "!!" if junk else x for x in w), 0.5))
        labels.append((i, int(not junk), int(bad)))
    rows += [(900, None, 0.1), (901, "", 0.1), (902, rows[3][1], 0.2)]
    labels += [(903, 1, 0), (None, 1, 1), (900, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label, cut", [(quality_cnn, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_classifiers_on_held_out_rows(spark, module, label, cut):
    docs, labels = labelled(spark)
    learn = labels.filter(common.in_training_fold("doc_id")).select("doc_id", F.col(label).alias("label"))
    model = module.fit(docs, learn)
    got = {x.doc_id: x.score for x in module.score(docs, model).collect()}
    assert len(got) == 263 and all(0 <= v <= 1 for v in got.values()) and got[902] == got[3] and got[900] == got[901]
    held = [r for r in labels.collect() if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = np.mean([(got[r.doc_id] >= cut) == bool(r[label]) for r in held])
    assert right > 0.9
    nothing = module.fit(docs, learn.limit(0))
    assert {round(x.score, 6) for x in module.score(docs, nothing).collect()} == {0.5}
    assert module.score(docs.limit(0), model).count() == 0


def test_queries_and_oracles_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries.QUERIES) == list(range(1, 14))
    assert set(llm_queries.ORACLE) <= set(llm_queries.QUERIES)


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2]
    for f in (root / "marketlens").rglob("*.py"):
        assert f.parent.name == "llm" or "marketlens.llm" not in f.read_text()
