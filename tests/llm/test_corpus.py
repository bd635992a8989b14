"""Operators that look at the whole corpus, against plain computations."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, common, components, decontaminate, embedding_dedup, exchange, line_dedup, lm_score, minhash_dedup, secret_scan, skew, token_count, toxicity, warc

from ..conftest import SF
from .helpers import EDGE, docs, labels

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mir", "ten", "su") for b in ("ra", "vel", "to", "nid") for c in ("sen", "pal", "qu", "ordi")]


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(n))


def groups_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# components


@pytest.mark.parametrize("share", [3, 500])
@pytest.mark.parametrize("pairs", [[], [(0, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(i, 59 - i) for i in range(60)] + [(3, 3), (None, 4)], "random"])
def test_components(spark, pairs, share, monkeypatch):
    monkeypatch.setattr(skew, "SHARE", share)
    if pairs == "random":
        r = random.Random(5)
        pairs = [(r.randint(0, 99), r.randint(0, 99)) for _ in range(70)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    want = groups_of(100, real)
    assert got == {x: want[x] for p in real for x in p}


# line dedup


def changed(r, line, n):
    w = line.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


@pytest.mark.parametrize("share", [3, 500])
def test_line_dedup(spark, share, monkeypatch):
    monkeypatch.setattr(skew, "SHARE", share)
    r = random.Random(1)
    lines = [sentence(r, r.randint(12, 60)) for _ in range(40)]
    rows = [(i, "\n".join([lines[i], lines[(i * 7) % 40], "short line", ""])) for i in range(40)]
    rows += [(100 + i, changed(r, lines[0], 1)) for i in range(80)]  # one group of near copies
    rows += [(200, lines[1].upper().replace(" ", ",  ") + "!"), (201, None), (202, ""), (None, lines[2]), (203, "x y z w " * 4000), (204, "x y z w " * 4000 + "v")]
    got = {x.doc_id: x for x in line_dedup.dedup(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[None].text == lines[2] and got[None].n_removed == 0
    seen = set()
    for i, _ in rows[:40]:
        out = got[i].text.split("\n")
        assert out[-1] == "" and (out[-2:-1] == ["short line"]) == (i == 0)  # exact repeats go at any length, empty lines stay
        for x in out[: -2 if i == 0 else -1]:
            assert x not in seen and x != lines[2]
            seen.add(x)
    assert seen == set(lines) - {lines[2]}
    assert not [i for i in range(100, 180) if got[i].text]  # copies with one word changed
    assert got[200].text == "" and got[201].text is None and got[202].text == "" and got[203].text and not got[204].text
    table = docs(spark, rows)
    assert line_dedup.clean(table).columns == table.columns and line_dedup.dedup(docs(spark, [])).count() == 0
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    by_shuffle = {x.doc_id: x.text for x in line_dedup.dedup(table, broadcast_rows=0).collect()}
    assert by_shuffle == {i: x.text for i, x in got.items()}


def test_line_dedup_finds_what_brute_force_finds(spark):
    r = random.Random(11)
    lines = []
    for _ in range(50):
        base = sentence(r, r.randint(8, 60))
        lines += [base] + [changed(r, base, r.randint(1, max(1, len(base.split()) // 6))) for _ in range(2)]
    lines += [changed(r, lines[0], 1) for _ in range(40)]
    lines = sorted(set(lines))
    table = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    a, b = table.toDF("a", "x"), table.toDF("b", "y")
    near = [tuple(p) for p in a.join(b, F.col("a") < F.col("b")).where(line_dedup.edit_similar(F.col("x"), F.col("y"), 0.8)).select("a", "b").collect()]
    removable = len(lines) - len(set(groups_of(len(lines), near)))
    assert removable > 100
    removed = sum(x.n_removed for x in line_dedup.dedup(docs(spark, list(enumerate(lines)))).collect())
    assert 0.98 * removable <= removed <= removable


def test_line_dedup_recall(spark):
    """Removable lines of the small table, beyond exact repeats, against brute force at edit similarity 0.8."""
    lines = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(F.split(line_dedup.normalised(F.col("text")), "\n")).alias("x")).select(F.trim("x").alias("x")).distinct()
    lines = lines.where("x rlike '( .*){4}' and length(x) < 1500").withColumn("a", F.row_number().over(Window.orderBy("x")) - 1)
    found = sum(x.n_removed for x in line_dedup.dedup(docs(spark, [(x.a, x.x) for x in lines.collect()])).collect())
    other = lines.toDF("y", "b").withColumn("most", F.floor(F.length("y") * 0.2 + 1e-9).cast("int"))
    pairs = lines.repartition(8).join(F.broadcast(other), (F.length("x") <= F.length("y")) & (F.length("x") >= F.length("y") - F.col("most")) & (F.col("a") != F.col("b"))).where(F.call_function("levenshtein", "x", "y", "most") >= 0)
    n = lines.count()
    removable = n - len(set(groups_of(n, [tuple(x) for x in pairs.select("a", "b").collect()])))
    print(f"recall {found}/{removable}")
    assert removable > 30 and 0.95 * removable <= found <= removable


def test_simhash(spark):
    r = random.Random(2)
    for n in (5, 31, 32, 127, 128, 3000):
        words = [r.choice(WORDS) + "abcdef" if r.random() < 0.5 else r.choice("abcdefgh") for _ in range(n)]
        rows = spark.createDataFrame([(1, 1, " ".join(words))], "id int, k bigint, text string")
        got = line_dedup._features(line_dedup._lines(rows), 5).first()
        hashes = [x.h for x in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()]
        weight = [8 if len(w) >= 5 else 1 for w in words]
        want = sum(1 << b for b in range(64) if 2 * sum(w for h, w in zip(hashes, weight, strict=True) if h >> b & 1) > sum(weight))
        assert got.sim % (1 << 64) == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_similarity(spark):
    r = random.Random(3)
    pairs = []
    for _ in range(60):
        a = "".join(r.choice("abc ") for _ in range(r.randint(1, 60)))
        b = list(a)
        for _ in range(r.randint(0, 14)):
            b[r.randrange(len(b))] = r.choice("abc ")
        pairs.append((a, "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.edit_similar(F.col("a"), F.col("b"), 0.8).alias("ok")).collect()
    for x in got:
        assert x.ok == (distance(x.a, x.b) <= int(0.2 * max(len(x.a), len(x.b)) + 1e-9))


@pytest.mark.parametrize("n", [140, 160, 400])
def test_edit_similarity_is_the_same_below_and_above_1000_characters(spark, n):
    """One letter in every fourth word is far below a fifth of the letters, at any length; a third of them is above."""
    r = random.Random(n)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    near = " ".join(w[:-1] + "z" if i % 4 == 0 else w for i, w in enumerate(words))
    far = " ".join("xyxyxy" if i % 3 == 0 else w for i, w in enumerate(words))
    rows = [(" ".join(words), near, True), (" ".join(words), far, False)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select(line_dedup.edit_similar(F.col("a"), F.col("b"), 0.8).alias("ok"), "want").collect()
    assert all(x.ok == x.want for x in got)


def same_bucket(table):
    """(lines, nodes) of a table of (id, text), all with one SimHash and without anchors."""
    lines = line_dedup._lines(table.withColumn("k", F.xxhash64("id")))
    return lines, lines.select("node", "occ", F.lit(7).cast("bigint").alias("sim"), *[F.lit(None).cast("bigint").alias(f"a{i}") for i in range(line_dedup.ANCHORS)])


def test_line_buckets_keep_all_links(spark):
    """In a bucket whose hub is like no other line, the links between the others are found all the same."""
    base = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"
    rows = [(i, base.replace("alpha", f"alph{c}")) for i, c in enumerate("abcdefgh")]
    rows += [(50 + i, sentence(random.Random(i), 12)) for i in range(30)]
    lines, nodes = same_bucket(docs(spark, rows).select(F.col("doc_id").alias("id"), "text"))
    found = line_dedup._groups(lines, nodes, 0.8, 100)
    assert found.count() == 8 and found.select("component").distinct().count() == 1


def test_line_buckets_when_the_largest_component_changes(spark):
    """A line that was passed over in the largest component is compared when another one has outgrown it."""
    r = random.Random(4)
    p, q = (["".join(r.sample("abcdefghijklmnopqrstuvwxyz", 5)) for _ in range(20)] for _ in range(2))
    line = lambda k, last: " ".join(q[:k] + p[k:19] + [last])
    pool = [(k, line(k, "".join(r.choice("aeiou") for _ in range(5)))) for k in (0, 3, 7, 10) for _ in range(80)]
    hashed = spark.createDataFrame(pool, "k int, line string").withColumn("node", F.xxhash64("line")).dropDuplicates(["node"])
    of = defaultdict(list)
    for x in hashed.orderBy("node").collect():
        of[x.k].append((x.node, x.line))
    small, large, near_small, near_large = of[0][:22], of[10][-40:], of[3], of[7]
    # the first hub is of the small group; its link to the large one lies before the next hubs, and the other end after
    link = next(x for x in near_small if small[0][0] < x[0] < large[0][0])
    end = next(x for x in reversed(near_large) if x[0] > large[16][0])
    rows = [*small, *large, link, end]
    table = docs(spark, list(enumerate(x for _, x in rows))).select(F.col("doc_id").alias("id"), "text")
    similar = [(i, j) for i, (_, a) in enumerate(rows) for j, (_, b) in enumerate(rows[:i]) if distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)]
    assert len(set(groups_of(len(rows), similar))) == 1
    assert len(set(groups_of(len(rows), [x for x in similar if set(x) != {len(rows) - 1, len(rows) - 2}]))) == 2
    lines, nodes = same_bucket(table)
    found = line_dedup._groups(lines, nodes, 0.8, 100)
    assert found.count() == len(rows) and found.select("component").distinct().count() == 1


def test_line_buckets_pair_no_lines_of_too_different_lengths(spark, monkeypatch):
    """Lines of very different lengths in one bucket are not paired at all, and no link is lost."""
    r, seen = random.Random(8), []
    base = [sentence(r, n) for n in (6, 12, 24, 48)]
    rows = [(i, changed(r, base[i % 4], 1)) for i in range(8)] + [(100 + i, sentence(r, 8 * (i + 1))) for i in range(5)]
    lines, nodes = same_bucket(docs(spark, rows).select(F.col("doc_id").alias("id"), "text"))
    whole = line_dedup._verified

    def told(texts, pairs, threshold):
        sizes = texts.select("node", "size")
        both = pairs.join(sizes.toDF("a", "x"), "a").join(sizes.toDF("b", "y"), "b")
        seen.append((pairs.count(), both.where(F.abs(F.col("x") - F.col("y")) > F.greatest("x", "y") * 0.2 + 1).count()))
        return whole(texts, pairs, threshold)

    monkeypatch.setattr(line_dedup, "_verified", told)
    found = line_dedup._groups(lines, nodes, 0.8, 100)
    assert sum(n for n, _ in seen) > 0 and not sum(n for _, n in seen)
    x, y = lines.select("node", "line").distinct().toDF("a", "x"), lines.select("node", "line").distinct().toDF("b", "y")
    near = [tuple(p) for p in x.join(y, F.col("a") < F.col("b")).where(line_dedup.edit_similar(F.col("x"), F.col("y"), 0.8)).select("a", "b").collect()]
    assert {x.id for x in found.collect()} == {n for p in near for n in p}


# embeddings


def linked(x, label, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    a = (x @ x.T >= least) & (label[:, None] == label[None, :])
    np.fill_diagonal(a, False)
    return a


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, (30, 24))
    x = np.r_[np.repeat(base, 6, axis=0) + rng.normal(0, 0.16, (180, 24)), np.repeat(base[:1], 15, axis=0), 3 * base[:4]].astype(np.float32)
    label = np.r_[np.repeat(np.arange(30) % 2, 6), np.zeros(15, int), np.arange(4) % 2]
    ids = rng.permutation(len(x)) + 1000
    rows = [(int(i), [float(v) for v in e], int(c), 1, "z") for i, e, c in zip(ids, x, label, strict=True)]
    odd = [(1, None, 1), (2, [], 1), (3, [0.0] * 24, 1), (4, [math.nan] * 24, 1), (5, [1.0] * 23 + [None], 1), (6, [math.inf] + [0.0] * 23, 1), (7, [1.0] * 24, None), (8, [1.0] * 3, 0), (9, [2.0] * 3, 0), (None, [1.0] * 24, 1)]
    table = spark.createDataFrame(rows + [(*o, 1, "z") for o in odd], "vec_id bigint, embedding array<float>, label int, n int, rep string")
    a = linked(x.astype(np.float64), label, 0.93)
    assert 50 < a.sum() < 3000
    root = groups_of(len(x), np.argwhere(a).tolist())
    least = {g: min(ids[i] for i in range(len(x)) if root[i] == g) for g in set(root)}
    want = {int(i): (int(n), int(least[g])) for i, n, g in zip(ids, a.sum(axis=1), root, strict=True)} | {i: (0, i) for i in range(1, 8)} | {8: (1, 8), 9: (1, 8), None: (0, None)}
    for tile in (16, 2048):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link(table, tile=tile).collect()}
        assert got == want
    kept = {r.vec_id: r.kept for r in embedding_dedup.link(table).collect()}
    assert kept == {i: i is not None and i == c for i, (_, c) in want.items()}
    assert embedding_dedup.link(table.limit(0)).count() == 0


# language model


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, most in ((0, 1 << 40), (1, 1 << 40), (3000, 1 << 40), (3000, 3500), (500, 1 << 50), (40, 40)):
        v = np.sort(rng.integers(0, most, n).astype(np.uint64))
        e = lm_score.EliasFano.build(v, most)
        assert (e.get(np.arange(n)) == v).all()
        q = np.r_[v, rng.integers(0, most, 200).astype(np.uint64)]
        for x, at in zip(q.tolist(), e.find(q).tolist(), strict=True):
            assert (at >= 0) == (x in v) and (at < 0 or v[at] == x)


def test_trie_lookups():
    rng = np.random.default_rng(4)
    pairs = np.unique(rng.integers(0, 1 << 40, 400).astype(np.uint64))
    value = np.unique(rng.integers(0, len(pairs), 900).astype(np.uint64) << np.uint64(24) | rng.integers(0, 1 << 24, 900).astype(np.uint64))
    owner, successor = (value >> np.uint64(24)).astype(np.int64), value & np.uint64((1 << 24) - 1)
    seen = rng.integers(1, 9, len(value))
    counts = np.bincount(owner, seen, len(pairs)).astype(np.int64) + 1
    trie = lm_score.Trie.open(lm_score.Trie.build(pairs, counts, owner, successor, seen))
    asked = np.r_[pairs, pairs[:5] + np.uint64(1)]
    node, at = trie.lookup(asked, np.r_[owner, np.arange(len(pairs), len(pairs) + 5), owner], np.r_[successor, successor[:5], successor ^ np.uint64(1)])
    assert (node == np.r_[np.arange(len(pairs)), np.full(5, -1)]).all()
    known = set(value.tolist())
    assert (at[: len(value)] == np.arange(len(value))).all() and (at[len(value) : len(value) + 5] < 0).all()
    assert all((x ^ 1 in known) == (y >= 0) for x, y in zip(value.tolist(), at[len(value) + 5 :].tolist(), strict=True))
    assert lm_score.chance_of(trie.chances) == pytest.approx((seen - 0.75) / counts[owner], rel=1e-3)
    assert lm_score.count_of(lm_score.count_code(np.array([0, 1, 4096, 10**6]))) == pytest.approx([0, 1, 4096, 10**6], rel=1e-3)


def plain_lm(rows, train):
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    c, c2, c3, follow = Counter(), Counter(), Counter(), defaultdict(set)
    for i, w in tokens.items():
        if train(i):
            c.update(w), c2.update(zip(w, w[1:], strict=False)), c3.update(zip(w, w[1:], w[2:], strict=False))
            for a, b, x in zip(w, w[1:], w[2:], strict=False):
                follow[a, b].add(x)
    n, v, low, high = sum(c.values()), len(c), 0.0, 1.0
    for _ in range(60):
        b = (low + high) / 2
        low, high = (low, b) if sum(k**b for k in c.values()) > len(c2) else (b, high)
    out = {}
    for i, w in tokens.items():
        base = [math.log10((c[x] + 1) / (n + v + 1)) for x in w]
        score = 0.0
        for k, x in enumerate(w):
            p = 10 ** base[k]
            if k and c[w[k - 1]]:
                m = c[w[k - 1]] ** low / (c[w[k - 1]] + c[w[k - 1]] ** low)
                p = (1 - m) * c2[w[k - 1], x] / c[w[k - 1]] + m * p
            if k > 1 and c2[w[k - 2], w[k - 1]]:
                t, s = len(follow[w[k - 2], w[k - 1]]), c2[w[k - 2], w[k - 1]]
                p = max(c3[w[k - 2], w[k - 1], x] - 0.75, 0) / s + 0.75 * t / s * p if t else p
            score += math.log10(p)
        out[i] = (len(w), sum(c[x] > 0 for x in w), n, sum(base), score)
    return out


def test_language_model(spark):
    r = random.Random(7)
    common = sentence(r, 40)
    rows = [(i, " ".join([common, sentence(r, r.randint(1, 60))]) if i % 3 else sentence(r, 30)) for i in range(60)] + [(1000 + i, t) for i, t in enumerate(EDGE)]
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    table = docs(spark, rows)
    got = {x.doc_id: x for x in lm_score.scores(table, F.crc32(F.col("doc_id").cast("string")) % 7 != 2).collect()}
    # a text of spaces alone or none has the end only; the same white space as split() has in bytes
    want = plain_lm(rows, train)
    assert set(got) == set(want)
    for i, (n, known, total, base, score) in want.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (not train(i), n, known, total)
        assert x.base_score == pytest.approx(base, rel=1e-9, abs=1e-9) and x.score == pytest.approx(score, abs=0.003 * n)
    held = [i for i in want if not train(i) and i < 1000]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
    tries = lm_score.model(table, F.lit(True)).collect()
    assert sum(lm_score.Trie.open(bytes(t.trie)).pairs.n for t in tries) > 100
    assert lm_score.scores(docs(spark, []), F.lit(True)).count() == 0
    nothing = lm_score.scores(docs(spark, [(1, "a b"), (None, "c")]), F.lit(False)).collect()
    assert {(x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in nothing} == {(3, 0, 0, 0.0), (2, 0, 0, 0.0)}


# MinHash


def shingles(t):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def _shuffled(spark):
    """Bytes of shuffle files that lie on this machine's disks."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    each = [files.apply(i) for i in range(files.size())]
    return sum(f.length() for f in each if f.getName().startswith("shuffle_") and f.getName().endswith(".data"))


def test_language_model_drops_what_it_sent(spark):
    """Texts are shuffled once more for the answers: the first time's files, and the messages', are gone by then."""
    rng = np.random.default_rng(8)
    table = docs(spark, [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**9, 300))) for i in range(300)]).repartition(4).cache()
    table.count()
    common.release(spark)
    before = _shuffled(spark)
    found = lm_score.scores(table, F.lit(True))
    time.sleep(1)  # files are deleted in the background
    left = _shuffled(spark) - before
    assert left < 200_000  # texts alone are about a million bytes
    assert found.count() == 300
    table.unpersist()


def test_language_model_tells_what_it_has_read_twice(spark):
    """By the score of a token, texts that occur twice stand above all that occur once."""
    r = random.Random(17)
    rows = [(i, sentence(r, r.randint(60, 200))) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)]
    got = lm_score.scores(docs(spark, rows), F.lit(True)).collect()
    each = {x.doc_id: x.score / x.n_tokens for x in got}
    twice = [v for i, v in each.items() if i < 30 or i >= 1000]
    once = sorted(v for i, v in each.items() if 30 <= i < 1000)
    assert sum(v > once[int(0.98 * len(once))] for v in twice) >= 0.95 * len(twice)


def test_packing():
    rng = np.random.default_rng(2)
    for most in (1 << 10, 1 << 40, 1 << 44):
        v = np.unique(rng.integers(0, most, 500).astype(np.uint64))
        assert (exchange.unpack(exchange.pack(v)) == v).all()
    assert exchange.large(exchange.small(np.array([1, 70_000]))).tolist() == [1, 70_000]


def test_word_hashes():
    one, n = exchange.word_hashes(["The  quick, brown", None, "the quick", "é É", "x" * 5000], chunk=7)
    assert n.tolist() == [3, 0, 2, 2, 1] and one[0] == one[3] and one[1] == one[4] and one[5] != one[6]
    assert len(set(one.tolist())) == 6


def test_consistent_samples():
    """The share of equal samples estimates the weighted Jaccard similarity."""
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    a, b = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    b[100:] = a[100:]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    same = minhash_dedup.samples(keys, a, 4000) == minhash_dedup.samples(keys, b, 4000)
    assert same.mean() == pytest.approx(want, abs=0.03)


def test_near_duplicates(spark):
    r = random.Random(11)
    base = [sentence(r, r.randint(60, 200)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, changed(r, base[i % 25], i % 4)) for i in range(120)]
    rows += [(300 + i, changed(r, base[0], 2)) for i in range(60)] + [(400, base[3]), (401, base[3].upper() + "."), (10, base[10])]
    rows += [(500 + i, t) for i, t in enumerate(EDGE)] + [(600, "a"), (None, base[4]), (None, None)]
    table = docs(spark, rows)
    real = [(i, t) for i, t in rows if i is not None]
    bags = [shingles(t) for _, t in real]
    n, df = len(real), Counter(x for b in bags for x in b)
    idf = {x: 0.75 + 0.25 * math.log(n / k) / math.log(n) for x, k in df.items()}
    weigh = lambda b: sum(k * idf[x] for x, k in b.items())
    pairs = []
    for i, a in enumerate(bags):
        for j in range(i):
            both = sum(min(k, bags[j].get(x, 0)) * idf[x] for x, k in a.items())
            if both and both >= 0.8 * (weigh(a) + weigh(bags[j]) - both):
                pairs.append((i, j))
    root = groups_of(n, pairs)
    # of equal ids the class is the same
    least = {g: min(real[i][0] for i in range(n) if root[i] == g) for g in set(root)}
    got = sorted((x.doc_id, x.class_id) for x in minhash_dedup.near_duplicates(table).where("doc_id is not null").collect())
    assert got == sorted((real[i][0], least[root[i]]) for i in range(n))
    assert minhash_dedup.near_duplicates(table).where("doc_id is null and kept").count() == 2
    kept = minhash_dedup.kept(table)
    assert kept.columns == table.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter(list(least.values()) + [None, None])
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_tiles_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TILE", 8)
    r = random.Random(12)
    base = sentence(r, 150)
    rows = [(i, changed(r, base, r.randint(0, 1))) for i in range(70)] + [(100 + i, sentence(r, 80)) for i in range(5)]
    got = {x.doc_id: x.class_id for x in minhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    monkeypatch.setattr(minhash_dedup, "TILE", 256)
    assert got == {x.doc_id: x.class_id for x in minhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert {c for i, c in got.items() if i < 100} == {0}


# decontamination

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(rows, items):
    words = lambda t: TOKEN.findall((t or "").encode().lower().decode())
    where = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            where[tuple(w[k : k + n])].add(str(i))
    sizes, out = {len(k) for k in where}, []
    for i, t in rows:
        w, hit, got = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := where.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    got |= found
        out.append((i, len(w), len(hit), tuple(sorted(got)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination(spark):
    r = random.Random(21)
    items = [(i, sentence(r, r.randint(13, 40))) for i in range(12)] + [(50, "Foo BAR baz"), (51, "one"), (52, None), (53, "..."), (54, "la " * 30), (55, items_short(r))]
    rows = []
    for i in range(60):
        w = sentence(r, r.randint(5, 120)).split()
        source = r.choice(items[:12])[1].split()
        a = r.randrange(len(source) - 10)
        w[r.randrange(len(w)) :][:0] = source[a : a + r.randint(8, 20)]
        rows.append((i, (", ".join(w[:3]) + " " + " ".join(w[3:] + source[a : a + r.randint(8, 20)])).upper()))
    rows += [(100, "foo bar"), (101, "x foo--bar baz y"), (102, "la " * 500), (103, "One"), (0, items[3][1]), (None, items[4][1])] + [(200 + i, t) for i, t in enumerate(EDGE)]
    bench = spark.createDataFrame([(i, t, 1, "n") for i, t in items], "item_id bigint, text string, n int, w string")
    table = docs(spark, rows)
    for limit in (50_000, 0):
        got = [(x.doc_id, x.n_words, x.n_hit, tuple(x["items"]), x.contaminated) for x in decontaminate.contamination(table, bench, broadcast_bytes=limit).collect()]
        assert sorted(got, key=str) == plain_hits(rows, items)
    clean = decontaminate.clean(table, bench)
    assert clean.columns == table.columns
    assert sorted(str(x.doc_id) for x in clean.collect()) == sorted(str(x[0]) for x in plain_hits(rows, items) if not x[-1])
    assert decontaminate.contamination(table, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0


def items_short(r):
    return sentence(r, 12)


# toxicity


def test_grammar():
    g = toxicity.Grammar.of({"zark": "I", "mild$": "W"})
    names = lambda t: {toxicity.PATTERNS[k] for k in np.flatnonzero(g.features(t))}
    assert names("what an idiot") == {"insult"} and names("You, IDIOT!") == {"insult_aimed"} and names("idiot, he said to you") == {"insult_aimed"}
    assert names("you are not an idiot") == {"insult_negated"} and names("she said you are an idiot") == {"insult_reported"}
    assert names("I will kill you") == {"threat_aimed"} and names("they never kill") == {"threat_negated"} and names("kill the lights") == {"threat"}
    assert names("zarking. Nothing") == {"insult"} and names("mild weather") == {"weak_insult"} and names("milder weather") == set()
    # scope ends with the clause
    assert names("I did not go. You idiot") == {"insult_aimed"}
    assert g.features("idiot. " * 9).max() == toxicity.CAP and not g.features("").any()
    high, low = g.score(g.features("you idiot")[None]), g.score(g.features("you said not an idiot")[None])
    assert 0 < low[0] < high[0] < 1


def test_learned_stems(spark):
    r = random.Random(31)
    rows, marks = [], []
    for i in range(300):
        w = sentence(r, 40).split()
        toxic = i % 5 == 0
        if toxic:
            for e in ("", "en", "isch"):
                w.insert(r.randrange(len(w)), "glumf" + e)
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(toxic)))
    table, marked = docs(spark, rows + [(None, "glumf"), (900, None), (901, "")]), labels(spark, marks + [(None, 1, 1), (5, None, None), (999, 1, 1)])
    grammar = toxicity.fit(table, marked, fold=toxicity.training_fold)
    assert "glum" in grammar.stems
    got = toxicity.score(table, grammar)
    held = {x.doc_id: x for x in got.collect()}
    test = [i for i, _, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(test) > 30 and all(held[i].predicted == int(i % 5 == 0) for i in test)
    assert held[None].predicted == 1 and 0 <= held[900].score == held[901].score < 0.5
    kept = toxicity.kept(table, grammar)
    assert kept.columns == table.columns and {x.doc_id for x in kept.collect()} == {i for i, x in held.items() if not x.predicted}
    nothing = toxicity.fit(docs(spark, []), labels(spark, []))
    assert (nothing.weights == toxicity.PRIOR).all() and not nothing.stems
    assert toxicity.score(docs(spark, []), nothing).count() == 0


def test_held_out_accuracy(spark):
    table, marked = spark.read.parquet(f"{SF[:-5]}0.01/documents.parquet"), spark.read.parquet(f"{SF[:-5]}0.01/labels.parquet")
    grammar = toxicity.fit(table, marked, fold=toxicity.training_fold)
    both = toxicity.score(table, grammar).join(marked.where(~toxicity.training_fold(F.col("doc_id"))), "doc_id")
    row = both.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"), F.avg((F.col("toxic") == 0).cast("int")).alias("clean")).first()
    assert row.right > max(0.9, row.clean)


# ids and names


def test_large_ids_and_odd_names(spark, tmp_path):
    """An id beyond 2 ** 53 beside a null one, and columns whose names hold dots and quotes, come through unchanged."""
    large, text = (1 << 60) + 1, "some words that make up a short line of text"
    rows = [(large, text, "x"), (None, text + " more", "y"), (3, None, "z"), (4, "one two three four five six seven", "w")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b ``c` string")
    ids = lambda df, name="doc_id": {x[name] for x in df.collect()}
    want = {large, None, 3, 4}
    grammar = toxicity.Grammar.of()
    outs = [byte_bpe.digests(table), byte_bpe.with_digests(table), byte_bpe.decode(byte_bpe.encode(table)), token_count.token_counts(table), secret_scan.scan(table), toxicity.score(table, grammar), toxicity.kept(table, grammar)]
    outs += [lm_score.scores(table, F.lit(True)), line_dedup.dedup(table), line_dedup.clean(table), minhash_dedup.near_duplicates(table), minhash_dedup.kept(table)]
    items = spark.createDataFrame([(1, "nothing of the kind")], "item_id bigint, text string")
    outs += [decontaminate.contamination(table, items), decontaminate.clean(table, items)]
    for out in outs:
        assert ids(out) == want
    for out in (byte_bpe.with_digests(table), toxicity.kept(table, grammar), line_dedup.clean(table), minhash_dedup.kept(table), decontaminate.clean(table, items)):
        assert {x["a.b `c"] for x in out.collect()} == {"x", "y", "z", "w"}
    pages = table.toDF("page_id", "html", "a.b `c").withColumn("url", F.lit("u"))
    assert ids(warc.round_trip(pages), "page_id") == want
    vectors = spark.createDataFrame([(large, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [1.0, 0.01], 1)], "vec_id bigint, embedding array<float>, label int")
    assert {(x.vec_id, x.n_links) for x in embedding_dedup.link(vectors).collect()} == {(large, 1), (None, 0), (5, 1)}


# WARC


def test_archives(spark):
    import hashlib

    r = random.Random(41)
    pages = [(i, f"http://h/{i}", r.choice(["<p>" + "x" * n + "</p>" for n in (1, 90, 91, 92, 93, 94, 200, 5000)]) if i % 3 else f"<p>{i}é</p>" * 40) for i in range(150)]
    pages += [(None, "http://n", "y" * 300), (None, None, "y" * 300), (500, "a\r\nb c", None), (501, "", ""), (502, None, "€" * 33), (503, "u", "€" * 33), (504, "u", "€" * 34), (505, "u", "€" * 34), (7, "again", "z" * 100), (7, "again", "z" * 100)]
    table = spark.createDataFrame([(*p, 1, "d") for p in pages], "page_id bigint, url string, html string, n int, digest string")
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    done, want = set(), []
    for i, _, h in sorted(pages, key=lambda p: (p[0] is not None, p[0] or 0)):
        raw = (h or "").encode()
        own = first.get(h or "")
        response = len(raw) < 100 or own is None or (own == i and (i, h) not in done)
        done.add((i, h))
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if response else "revisit", None if response else own))
    for more in ({}, {"roll_bytes": 500, "task_bytes": 20_000}):
        got = [tuple(x) for x in warc.round_trip(table, **more).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(table.limit(0)).count() == 0


def test_archives_are_deterministic_and_checked(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(40)], "page_id bigint, url string, html string")
    first = warc.write(pages, f"file://{tmp_path}/a", roll_bytes=2000).collect()
    again = warc.write(pages.repartition(3), f"file://{tmp_path}/b", roll_bytes=2000).collect()
    assert {(x.name, x.sha256, x.records) for x in first} == {(x.name, x.sha256, x.records) for x in again} and len(first) > 1
    assert not list((tmp_path / "a").glob(".tmp-*"))
    many = spark.createDataFrame([(i * i * 10**9 if i % 7 else i, f"http://h/{i}", f"<p>{i % 50}</p>" * (10 + i % 90)) for i in range(400)], "page_id bigint, url string, html string")
    one, other = (warc.write(x, f"file://{tmp_path}/{n}", roll_bytes=3000, task_bytes=30_000).collect() for n, x in (("c", many), ("d", many.repartition(5))))
    assert {(x.name, x.sha256) for x in one} == {(x.name, x.sha256) for x in other}
    assert len({x.part for x in one}) > 5 and max(x.seq for x in one) > 0 and sum(x.records for x in one) == 400
    back = warc.read(spark.read.parquet(f"file://{tmp_path}/a/_manifest"), f"file://{tmp_path}/a")
    assert sorted((x.page_id, bytes(x.payload).decode()) for x in back.collect()) == [(i, f"<p>{i}</p>" * 50) for i in range(40)]
    name = tmp_path / "a" / first[0].name
    raw = bytearray(name.read_bytes())
    raw[len(raw) // 2] ^= 1
    name.write_bytes(raw)
    with pytest.raises(Exception, match=r"digest|isn't the file|Error|not a record"):
        back.collect()
