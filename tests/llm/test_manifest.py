"""The Merkle log against a plain tree held in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle_log as M


def h(*nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        out.append([x for j, x in enumerate(nodes[i // 2 * 2:i // 2 * 2 + 2], i // 2 * 2) if j != i])
        i //= 2
    return out


def up(node, levels, i):
    for nodes in levels[:-1]:
        pair = nodes[i // 2 * 2:i // 2 * 2 + 2]
        pair[i % 2] = node
        node, i = h(*pair), i // 2
    return node


def brute(rows):
    """The contract, read plainly: rows are (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        leaf = h("".join(map(field, r)))
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
        claim = h("".join(map(field, (*r[:3], r[3] + 1, r[4])))) if tampered else leaf
        by.setdefault(r[2], []).append((r[0], leaf, claim))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        by[x].sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        trees[x] = levels_of([t[1] for t in by[x]])
    top = levels_of([trees[x][-1][0] for x in langs]) if langs else None
    out = []
    for k, x in enumerate(langs):
        for i, (doc, leaf, claim) in enumerate(by[x]):
            proof = h(*[s for step in path(trees[x], i) + path(top, k) for s in step])
            folded = up(up(claim, trees[x], i), top, k)
            out.append((doc, leaf, trees[x][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def found(df, block_levels):
    more = [F.col("n_chars").cast("decimal(38,0)") + 1 if c == "n_chars" else F.col(c) for c in M.FIELDS]
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, M.leaf(more))
    proofs = M.write_manifest(df, claimed=claim, block_levels=block_levels).proofs().collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, h(r.proof.replace("L", "").replace("R", "").replace("-", "")), r.folded_root,
                    r.folded_root == r.root) for r in proofs), key=str)


def as_rows(df):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]


@pytest.mark.parametrize("n", [*range(1, 34), 63, 64, 65, 100])
def test_places_in_the_log(n):
    low = (n - 1).bit_length()
    for height in (low, low + 3):
        leaves = [h(str(i)) for i in range(n)]
        log = M.append_all(leaves, height)
        assert len(log) == M.log_size(n, height)
        level = leaves
        for k in range(height + 1):
            assert [log[M.position(k, j, n)] for j in range(len(level))] == level
            level = [h(*level[j:j + 2]) for j in range(0, len(level), 2)]
        # postorder: a node comes after its children
        for k in range(1, height + 1):
            for j in range(-(-n >> k)):
                assert M.position(k, j, n) > M.position(k - 1, 2 * j, n)
        assert {M.fold(leaves[i], "".join(M.siblings(i, n, height, log))) for i in range(n)} == {log[-1]}


@pytest.mark.parametrize("block_levels", [2, 10])
def test_manifest(spark, block_levels):
    """With two levels a segment the trees have several tiers, the groups as well."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150)
    more = docs.limit(90).withColumn("lang", F.concat(F.lit("x"), (F.col("doc_id") % 23).cast("string")))
    df = docs.unionAll(more).unionAll(docs.limit(9).withColumn("lang", F.lit(None).cast("string"))).checkpoint()
    assert found(df, block_levels) == brute(as_rows(df))


def test_edges(spark, odd_docs, no_docs):
    assert found(odd_docs, 3) == brute(as_rows(odd_docs))
    manifest = M.write_manifest(no_docs)
    assert manifest.root() is None and manifest.proofs().count() == 0 and M.audited(no_docs).count() == 0
    one = odd_docs.where("doc_id = 1")
    assert found(one, 10) == brute(as_rows(one))
    assert M.write_manifest(one).root() == found(one, 10)[0][1]


def test_repeated_rows_are_leaves_each(spark):
    rows = [(1, "s", "en", 3, "abc")] * 300 + [(2, "s", "en", 3, "abd")] * 7
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert found(df, 4) == brute(rows)


def test_log_is_bounded_segments(spark, small_dir):
    manifest = M.write_manifest(spark.read.parquet(f"{small_dir}/documents.parquet"), block_levels=3)
    for s in manifest.segments():
        for r in s.collect():
            assert r["count"] <= 8 and len(r["log"]) == 32 * M.log_size(r["count"], min(3, (r["n"] - 1).bit_length()))
