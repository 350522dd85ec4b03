from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest
from conftest_llm import DOCS, LOWER, UPPER

from scorebook.llm import manifest


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    i, text, lang, source, n = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def lift(nodes):
    """The root of a list of digests, and for each of them its (left, right) siblings up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, p in enumerate(at):
            run = runs[p // 16]
            paths[k].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        at, nodes = [p // 16 for p in at], [h(*run) for run in runs]
    return nodes[0], paths


def plain(rows):
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: lift([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    root, tops = lift([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for x, path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            i, text, *rest = x[3]
            tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and text is not None
            at = leaf((i, text.translate(str.maketrans(UPPER, LOWER)), *rest)) if tampered else x[2]
            for left, right in path + top:
                at = h(left, at, right)
            proof = h(*[p + q for p, q in path + top])
            out.append((i, x[2], trees[s][0], root, proof, at, at == root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_the_test_documents(docs, rows):
    out = got(manifest.find(docs))
    assert out == plain(rows)
    assert 0 < sum(not r[-1] for r in out) < len(out) / 4


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 2, 300], [1] * 18 + [40], [4100]])
def test_trees_of_all_shapes(spark, sizes):
    r = random.Random(len(sizes))
    rows = [(i * 1000 + k, f"Text {r.random()}", "en", f"s{i:02}é"[: r.randint(2, 4)], k) for i, n in enumerate(sizes) for k in range(n)]
    r.shuffle(rows)
    assert got(manifest.find(spark.createDataFrame(rows, DOCS).repartition(7))) == plain(rows)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    long = "Über Wörter " * 150_000
    rows = [(None, None, None, None, None), (None, "A", None, None, 1), (5, "", "en", "", 0), (5, "B", "en", "", 1), (5, "B", "en", "", 1),
            (7, long, "de", "b", None), (7, long, "de", "b", None), (-3, "Neg", "en", "a", 3), (14, "Ωm", "el", "Ω", 2)]
    assert got(manifest.find(spark.createDataFrame(rows, DOCS))) == plain(rows)


def test_empty_and_clashing(empty, clashing, docs):
    assert manifest.find(empty).count() == 0
    more = clashing.drop("id")
    for name in ("tree", "pos", "leaf", "root", "segment", "level", "members", "up", "path"):
        more = more.withColumn(name, more["doc_id"])
    assert got(manifest.find(more)) == got(manifest.find(docs))


def test_a_proof_that_is_changed_anywhere_fails(spark, docs):
    from pyspark.sql import functions as F

    leaves = docs.select(F.col("doc_id").alias("id"), "source", manifest.leaf_digest([F.col(c) for c in manifest.FIELDS]).alias("leaf"))
    proved = manifest.proofs(leaves)
    broken = F.transform("segment", lambda s, i: F.when(i == 1, F.struct(F.reverse(s["left"]).alias("left"), s["right"])).otherwise(s))
    row = proved.select(
        F.bool_and(manifest.folded(F.col("leaf"), F.col("segment")) == F.col("root")),
        F.count_if((manifest.folded(F.col("leaf"), broken) == F.col("root")) & F.col("segment")[1]["left"].rlike(".")),
    ).first()
    assert row[0] and row[1] == 0
