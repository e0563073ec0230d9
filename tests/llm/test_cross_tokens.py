"""Cross-tokenizer alignment against whole texts and all pairs of tokens."""

import bisect
import collections
import functools
import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.llm import cross_tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOOL = functools.partial(cross_tokens.aligner_for, A, B)


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer, decoders
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {c: b for b, c in cross_tokens.byte_letters().items()}
    return t, s, byte


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(text, tools):
    """Tokens, groups and links of one text: encoded whole, every pair of tokens compared."""
    t, s, byte = tools
    if not text:
        return None
    e = t.encode(" " + text, add_special_tokens=False)
    a, a_parts = e.ids, [bytes(byte[c] for c in tok) for tok in e.tokens]
    b = s.encode(text)
    b_parts = [bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, s.id_to_piece(i)) for i in b)]
    if b"".join(a_parts) != (" " + text).encode() or b"".join(b_parts) != (" " + text).encode():
        return None
    sa, sb = spans(a_parts), spans(b_parts)
    links, low = [], 0
    for i, (lo, hi) in enumerate(sa):
        while sb[low][1] <= lo:
            low += 1
        j = low
        while j < len(sb) and sb[j][0] < hi:
            links.append((a[i], b[j]))
            j += 1
    cuts = sorted({hi for _, hi in sa} & {hi for _, hi in sb})
    parts = [([], []) for _ in cuts]
    for side, ids, where in ((0, a, sa), (1, b, sb)):
        for x, (lo, _) in zip(ids, where, strict=True):
            parts[bisect.bisect_right(cuts, lo)][side].append(str(x))
    groups = [",".join(x) + "|" + ",".join(y) for x, y in parts]
    return len(a), len(b), len(cuts), links, groups


def brute(rows, tools):
    got = {t: plain(t, tools) for _, t in rows}
    count = collections.Counter()
    for _, t in rows:
        if got[t]:
            count.update(set(got[t][3]))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc, t in rows:
        if got[t] is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = got[t]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc, n_a, n_b, n_groups, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha))
    return sorted(out, key=str)


def found(df, **kw):
    rows = cross_tokens.align_documents(df, TOOL, **kw).documents.collect()
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows), key=str)


ODD = ["two  spaces", " lead", "trail ", "a▁b", "tab\there", "line\nline \n x", "x y", "日本語テキスト", "größer ñandú 😀 <|endoftext|>", "<s> </s> <0x41>", "a\x00b", "　 x",
       "don't 's I'LL", "é", " ", "\n", "word", "word", "the the the", "1234567 89"]


def test_words_apart_equal_the_whole(tools):
    tool = cross_tokens.Aligner(A, B, most=3)
    for text, got in zip(ODD * 2, tool.texts(ODD) + [tool.texts([t])[0] for t in ODD], strict=True):
        want = plain(text, tools)
        assert (got is None) == (want is None), text
        if want:
            assert got[:4] == (want[0], want[1], want[2], len(want[3])) and got[4] == ";".join(want[4])


@pytest.mark.parametrize("limits", [{}, {"most_pairs": 40, "most_texts": 3}])
def test_documents(spark, tools, limits):
    """Small limits take the path in which only frequent pairs and texts are broadcast."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD + [None, ""])], "doc_id long, text string")
    copies = docs.limit(1).crossJoin(spark.range(40).toDF("n")).select((F.col("n") + 5000).alias("doc_id"), "text")
    df = docs.unionAll(odd).unionAll(copies).checkpoint()
    assert found(df, **limits) == brute([tuple(r) for r in df.collect()], tools)


def test_query(spark, tools):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = E.queries()["op13_distinct_texts"](spark, "/root/testdata/sf0.001").collect()
    want = brute(rows, tools)
    mine = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got), key=str)
    assert mine == want


def test_edges(spark, odd_docs, no_docs, tools):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(odd_docs) == brute(rows, tools)
    assert found(no_docs) == []


def test_pairs(spark, tools):
    rows = [(1, "the cat"), (2, "the cat"), (3, "the dog"), (4, None)]
    out = cross_tokens.align_documents(spark.createDataFrame(rows, "doc_id long, text string"), TOOL)
    assert out.texts.count() == 3
    the = [r for r in out.pairs.collect() if r.documents == 3]
    assert len(the) == 1 and the[0].best and the[0].texts == 2
