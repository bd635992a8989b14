"""Merkle manifests against a plain recursion."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """(root, proof of each node)."""
    paths, at = ["" for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // fanout * fanout
            paths[i] += "".join(nodes[j] for j in range(run, min(run + fanout, len(nodes))) if j != k)
            at[i] = k // fanout
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def fold(digest, path, k, n, fanout):
    while n > 1:
        run = k // fanout * fanout
        members = [path[64 * j : 64 * (j + 1)] for j in range(min(fanout, n - run) - 1)]
        path = path[64 * len(members) :]
        members.insert(k - run, digest)
        digest, k, n = sha("".join(members)), k // fanout, -(-n // fanout)
    return digest


def plain(rows, claimed, fanout):
    """Sorted (doc_id, lang, leaf, subroot, root, proof, folded_root) of rows (FIELDS)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda x: x[:3]), *climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout)) for g in order}
    if not order:
        return []
    root, over = climb([trees[g][1] for g in order], fanout)
    out = []
    for i, g in enumerate(order):
        members, top, paths = trees[g]
        for k, (m, path) in enumerate(zip(members, paths, strict=True)):
            mine = claimed(m[3]) or m[2]
            out.append((str(m[3][0]), str(g), m[2], top, root, path + over[i], fold(fold(mine, path, k, len(members), fanout), over[i], i, len(order), fanout)))
    return sorted(out)


def check(spark, rows, fanout, levels, parts=3):
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf int, `proof.x` string").repartition(parts)
    wrong = [(F.col(f) + 1) if f == "n_chars" else F.col(f) for f in FIELDS]
    claimed = F.when(F.col("doc_id") % 3 == 0, merkle.leaf_of(wrong))
    got = merkle.manifest(docs, FIELDS, "lang", "doc_id", fanout, levels, claimed)
    told = [(str(r.doc_id), str(r.tree_group), r.leaf, r.subroot, r.root, bytes(r.proof).decode(), r.folded_root, r.verified) for r in got.collect()]
    of = lambda r: leaf((*r[:3], None if r[3] is None else r[3] + 1, r[4])) if r[0] is not None and r[0] % 3 == 0 else None
    want = plain(rows, of, fanout)
    assert sorted(t[:-1] for t in told) == want
    assert all(t[-1] == (t[-2] == t[4]) for t in told)
    return told


@pytest.mark.parametrize("fanout,levels", [(2, 12), (2, 1), (3, 2)])
def test_against_recursion(spark, fanout, levels):
    langs = ["en"] * 40 + ["de"] * 17 + [None] * 3 + ["é"] + [""] * 2 + ["zh"] * 8
    rows = [(i * 7 % 71, "web", lang, i, f"text {i} é") for i, lang in enumerate(langs)]
    told = check(spark, rows, fanout, levels)
    assert len({t[4] for t in told}) == 1 and 0 < sum(t[-1] for t in told) < len(told)


def test_nulls_ties_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", 0, ""), (1, "", "en", 0, ""), (1, "", "en", 1, "b"), (3, None, "en", None, "x" * 300_000), (3, "s", None, 2, None)]
    told = check(spark, rows, 2, 2)
    # where n_chars is null the tampered row is the row itself
    assert {t[-1] for t in told if t[0] == "3" and t[1] == "en"} == {True}
    check(spark, [(5, "a", "en", 1, "t")], 2, 12)
    check(spark, [(6, "same", "en", 1, "t")] * 300, 2, 3, parts=7)
    check(spark, [(i, "s", f"l{i}", 1, "t") for i in range(40)], 2, 2)


def test_empty(spark):
    assert check(spark, [], 2, 12) == []
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], "a int, b int"), ("a",), "b", "a", fanout=1)
