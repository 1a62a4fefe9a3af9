"""Operator 11 against a hash tree built level by level in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, queries


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    return digest(*[field(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def tree(nodes):
    """The root, and for each node its siblings (left, right) on each level."""
    at, paths, level = list(range(len(nodes))), [[] for _ in nodes], nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            first = p - p % 8
            paths[i].append((level[first:p], level[p + 1 : first + 8]))
            at[i] = p // 8
        level = [digest(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return level[0], paths


def by_hand(rows):
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = []
    for lang in langs:
        own = sorted(((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)), r) for r in rows if r.lang == lang)
        leaves = [k[2] for k, _ in own]
        groups.append(([r for _, r in own], leaves, *tree(leaves)))
    root, upper = tree([g[2] for g in groups])
    out = []
    for (own, leaves, subroot, paths), up in zip(groups, upper, strict=True):
        for r, leaf, path in zip(own, leaves, paths, strict=True):
            node = leaf
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
                node = leaf_of(r, None if r.text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text))
            for left, right in path + up:
                node = digest(*left, node, *right)
            out.append((r.doc_id, leaf, subroot, root, digest(*[x for left, right in path + up for x in left + right]), node, node == root))
    return sorted(out, key=repr)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_query(spark, tiny):
    got = queries.op11_merkle_manifest(spark, tiny)
    rows = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    found = sorted(map(tuple, got.select(*NAMES).collect()), key=repr)
    assert found == by_hand(rows) and any(not r[-1] for r in found) and any(r[-1] for r in found)


@pytest.mark.parametrize("table", ["odd", "none"])
def test_odd_rows(spark, request, table, tmp_path):
    df = request.getfixturevalue(table)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle_manifest(spark, str(tmp_path)).select(*NAMES).collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(df.collect()) if got else df.count() == 0


def test_deep_trees(spark):
    """Blocks of 64 leaves, so that blocks of blocks of blocks arise; trees of 1, 8, 9, 64, 65 and 5,000 leaves, and 70 groups."""
    sizes = {"a": 5000, "b": 1, "c": 8, "d": 9, "e": 64, "f": 65} | {f"g{k}": 1 + k % 3 for k in range(70)}
    rows = [(g, k, digest(g, str(k))) for g, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, leaf string").repartition(7)
    got = merkle.verified(merkle.merkle_manifest(df, "leaf", "g", "k", levels=1), F.col("leaf")).collect()
    want = {}
    roots = []
    for g in sorted(sizes):
        leaves = [digest(g, str(k)) for k in range(sizes[g])]
        subroot, paths = tree(leaves)
        roots.append((g, subroot, paths))
    root, upper = tree([s for _, s, _ in roots])
    for (g, subroot, paths), up in zip(roots, upper, strict=True):
        want |= {(g, k): (subroot, root, ["".join(left + right) for left, right in p + up]) for k, p in enumerate(paths)}
    assert {(r.tree, r.k): (r.subroot, r.root, [s.left + s.right for s in r.path]) for r in got} == want
    assert all(r.verified and r.place == r.k for r in got)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 500, 511, 512, 513, 4095, 4096])
def test_traversal(n):
    """Paths of one block, whole or partly filled, and of a last block of a larger tree."""
    shape = merkle.Shape()
    leaves = [digest(str(k)) for k in range(n)]
    roots, top = merkle.block_top(shape, leaves, n)
    root, paths = tree(leaves)
    assert top == root
    assert [[(s["left"], s["right"]) for s in p] for p in merkle.block_paths(shape, leaves, roots, n)] == [[("".join(a), "".join(b)) for a, b in p] for p in paths]
    roots, top = merkle.block_top(shape, leaves, 4097)  # four levels, however few leaves
    assert all(len(p) == 4 for p in merkle.block_paths(shape, leaves, roots, 4097)) and (n > 8 or top != root)
