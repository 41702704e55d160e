"""The Merkle manifest against a plain construction level by level."""

import collections
import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from glosspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, idx int, path string, digest string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    """All levels from the leaves to the one node left."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def proof(tree, i):
    """(siblings, place) of each level."""
    out = []
    for level in tree[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        out.append((run[: i % 16] + run[i % 16 + 1 :], i % 16))
        i //= 16
    return out


def brute(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    over = levels([trees[s][-1][0] for s in names])
    out = []
    for s in names:
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = proof(trees[s], i) + proof(over, names.index(s))
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            node = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:5]) if hit else own
            for siblings, at in path:
                node = h(*siblings[:at], node, *siblings[at:])
            out.append((r[0], own, trees[s][-1][0], over[-1][0], h(*(x for siblings, _ in path for x in siblings)), node, node == over[-1][0]))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "p", "d") for r in rows], SCHEMA)


def got(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=repr)


def rows_of(n, sources, seed):
    rng = random.Random(seed)
    return [(rng.randint(1, 3 * n), rng.choice(["Ab", "x É", "", None, "ABC d"]) and f"T{i} Ä", rng.choice(["en", None, ""]), rng.choice(sources), rng.choice([None, i])) for i in range(n)]


def test_one_hot_source(spark):
    rows = rows_of(9000, ["hot"] * 8 + [None, "", "b"], 1)  # more than 4,096 leaves: three passes
    rows += [rows[3], rows[3], (None, None, None, None, None), (None, "a", None, "hot", 1), (7, "Z" * 200_000, "en", "lone", 5)]
    assert got(merkle.audit(table(spark, rows))) == sorted(brute(rows), key=repr)


def test_many_sources(spark):
    rows = rows_of(900, [f"s{i}é" for i in range(400)], 2)
    assert got(merkle.audit(table(spark, rows))) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("n", [0, 1, 17])
def test_sizes(spark, n):
    rows = [(i, f"T{i}", "en", "a", 1) for i in range(n)]
    assert got(merkle.audit(table(spark, rows))) == sorted(brute(rows), key=repr)


def test_manifest_and_paths(spark):
    rows = rows_of(300, ["a", "b", None], 3)
    docs = table(spark, rows)
    out = {r.source: r for r in merkle.manifest(docs).collect()}
    want = {(r[3], x[2], x[3]) for r in rows for x in brute(rows) if x[1] == leaf(*r)}
    assert {(s, r.subroot, r.root) for s, r in out.items()} == want
    assert {s: r.n_leaves for s, r in out.items()} == collections.Counter(r[3] for r in rows)
    assert merkle.proofs(docs).filter(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()


@pytest.mark.parametrize("n", [1, 15, 16, 200, 300, 4096, 5000])
def test_traversal(n):
    leaves = [h(str(i)) for i in range(n)]
    tree = levels(leaves)
    for i, path in enumerate(merkle.traverse(leaves, len(tree) - 1)):
        assert [(run[:at] + run[at + 1 :], at) for run, at in path] == proof(tree, i)
    assert merkle.grown(leaves, len(tree) - 1, n) == tree[-1]
