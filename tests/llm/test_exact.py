"""Operators against brute force on small tables."""

import collections
import itertools
import json
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

import __spark_entry__ as E
from tessera.llm import chat_collapse, decontam, kd_search, packing, sharding, simhash_golay, tokens
from tests.oracle_harness import duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("key", [k for k in E.oracle_sql() if re.match(r"op\d+_", k)])
def test_sql_oracles(spark, key):
    got, want = E.queries()[key](spark, SF).toPandas(), duck(SF).execute(E.oracle_sql()[key]).df()
    assert rows_of(got) == rows_of(want)


# --- sharding

def check_shards(rows, n_rows):
    assert len(rows) == n_rows
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    for s in by.values():
        assert sorted(s) == list(range(len(s)))


def test_shards(spark, docs):
    rows = sharding.shard_rows(docs, sharding.even_topology(8)).collect()
    check_shards(rows, docs.count())
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))


def test_shards_edges(spark, odd_docs, no_docs):
    rows = sharding.shard_rows(odd_docs, sharding.even_topology(8)).collect()
    check_shards(rows, odd_docs.count())
    assert [r["size"] for r in rows if r["doc_id"] == 2] == [1]
    assert sharding.shard_rows(no_docs, sharding.even_topology(8)).count() == 0


def test_weights_move_rows_only_where_they_change(spark):
    keys = spark.range(4000)
    old = sharding.even_topology(8)
    new = [[rack if rack[0][0] != 2 else [(2, 3.0), (3, 1.0)] for rack in region] for region in old]
    both = keys.select(sharding.shard_of(keys.id, old).alias("o"), sharding.shard_of(keys.id, new).alias("n")).collect()
    # region 0 and its rack 1 got heavier: rows leave region 1 only into region 0, and inside region 0 only into rack 1
    assert all(r.n == r.o or r.n < 4 for r in both if r.o >= 4)
    assert all(r.n == r.o or r.n in (2, 3) for r in both if r.o < 4)
    counts = collections.Counter(r.n for r in both)
    for shard, share in ((0, 1 / 10), (2, 3 / 10), (7, 1 / 10)):
        p = {0: 6 / 10 * 2 / 6 / 2, 2: 6 / 10 * 4 / 6 * 3 / 4, 7: 4 / 10 / 4}[shard]
        assert math.isclose(p, share) and abs(counts[shard] / 4000 - p) < 0.03


# --- conversations

def brute_collapse(turns):
    by = collections.defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((t, r, x))
    conv = {c: tuple((r, x) for _, r, x in sorted(v, key=lambda y: tuple((z is not None, z) for z in y))) for c, v in by.items()}
    out = {}
    for c, v in conv.items():
        if any(len(w) > len(v) and w[:len(v)] == v for w in conv.values()):
            continue
        same = [k for k, w in conv.items() if w == v]
        if c == min(same, key=lambda k: (k is None, k)):
            out[c] = (len(same), "".join(f"<|{r or 'user'}|>\n{x or ''}<|end|>\n" for r, x in v))
    return out


@pytest.mark.parametrize("piece,part", [(4096, 256), (2, 3)])
def test_collapse(spark, piece, part):
    base = [("user", f"q{i}") if i % 2 == 0 else ("assistant", f"a{i}") for i in range(9)]
    turns = []
    for c, n in ((1, 2), (2, 9), (3, 4), (4, 9), (5, 1)):
        turns += [(c, t, *base[t]) for t in range(n)]
    turns += [(6, 0, "user", "q0"), (6, 1, "assistant", None), (7, 0, "user", "q0"), (7, 1, "assistant", ""), (8, 0, None, "x"),
              (9, 5, "user", "tie"), (9, 5, "user", "tie"), (None, 0, "user", "lost"), (10, None, "user", "q0"), (11, 100, "user", "late"), (11, 3, "user", "soon")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = collections.defaultdict(list)
    for r in chat_collapse.collapse_and_render(df, piece, part).orderBy("part").collect():
        got[r.conv_id].append(r)
    want = brute_collapse(turns)
    assert set(got) == set(want)
    for c, parts in got.items():
        assert [p.part for p in parts] == list(range(len(parts)))
        assert (parts[0].n_copies, "".join(p.rendered for p in parts)) == want[c]
    assert chat_collapse.collapse_and_render(df.limit(0)).count() == 0


# --- packing

def check_pack(rows, texts, limits=packing.Limits()):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = collections.Counter()
    for d, x in texts:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want[d, len(ids), 0] += 1
    assert collections.Counter((r["doc_id"], r["doc_tokens"], 0) for r in rows if r["start"] == 0) == want
    for d, x in {(d, x) for d, x in texts}:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        at = collections.Counter()
        for r in pieces[d]:
            assert zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            at[r["start"]] += r["length"]
        assert sum(at.values()) % len(ids) == 0
    pad = total = 0
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        n = 0
        for r in s:
            assert r["offset"] == n and r["length"] > 0
            n += r["length"]
        assert n <= limits.tokens and len(s) <= limits.segments and sum(r["loss_tokens"] for r in s) <= limits.loss
        pad += 0 if n & (n - 1) == 0 else limits.tokens - n
        total += n
    assert pad <= 0.02 * total + limits.tokens


def encoder():
    return tokens.encoder_for(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_of_many_texts(docs):
    """Ids of a batch are those of its texts one by one; each different stretch of the batch is looked up once."""
    class Counted(tokens.CachedEncoder):
        asked = 0

        def __getitem__(self, stretch):
            self.asked += 1
            return super().__getitem__(stretch)

    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = ["", " ", "a", " a", "a ", "a  b", "a\n b", "\n", "a\nb c", "don't (stop), now...", "<|endoftext|> x <|endoftext|>", "été \u4f60\u597d \U0001f600 x\u00a0 y",
           "x" * 50, "word " * 40 + "word", "\x00 \x00"]
    texts = odd + [r.text or "" for r in docs.limit(60).collect()] + odd
    few, plain = Counted(path, most=50), tokens.CachedEncoder(path)
    for batch in (texts, texts[5:], [], ["a  b"], [""]):
        got = few.many(pa.array(batch, pa.string()))
        assert [g.tolist() for g in got] == [plain.ids(t).tolist() for t in batch]
        assert [g.tolist() for g in got] == [plain.tokenizer.encode(t, add_special_tokens=False).ids for t in batch]
    once = Counted(path)
    once.many(pa.array(["one two three two one two"] * 500))
    assert once.asked <= 3


def test_long_texts_go_alone(monkeypatch):
    monkeypatch.setattr(tokens, "LONG", 20)
    texts = ["a short text", "a text that is longer than that limit", "b"]
    assert [g.tolist() for g in encoder().many(pa.array(texts))] == [encoder().ids(t).tolist() for t in texts]


def test_packing(spark, docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        check_pack(packing.pack_documents(df, encoder).collect(), [(r.doc_id, r.text) for r in df.collect()])
    assert packing.pack_documents(no_docs, encoder).count() == 0


def test_packing_limits_bind(spark):
    df = spark.createDataFrame([(i, "word " * (i % 40), (i % 40) // 2) for i in range(300)], "doc_id long, text string, loss_at long")
    limits = packing.Limits(128, 5, 60)
    rows = packing.pack_documents(df, encoder, limits, 64, loss_from="loss_at").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for s in by.values():
        assert sum(r.length for r in s) <= 128 and len(s) <= 5 and sum(r.loss_tokens for r in s) <= 60
    whole = collections.Counter()
    for r in rows:
        whole[r.doc_id] += r.length
    assert whole == {r.doc_id: r.doc_tokens for r in rows}


def test_whole_examples_stay_whole():
    rng = np.random.default_rng(3)
    items = [packing.Piece(i, 0, np.zeros(n, np.uint32), n, n // 3) for i, n in enumerate(rng.integers(1, 100, 400).tolist())]
    limits = packing.Limits(128, 6, 90)
    sequences = list(packing.pack(iter(items), limits, 64, cut=False))
    assert sorted(p.doc for s in sequences for p in s) == list(range(400))
    for s in sequences:
        assert sum(len(p.ids) for p in s) <= 128 and len(s) <= 6 and sum(p.loss() for p in s) <= 90
    assert len(sequences) < 1.35 * max(sum(len(p.ids) for p in items) / 128, sum(p.loss() for p in items) / 90, 400 / 6)


@pytest.mark.parametrize("text", ["", " ", "  two", "a  b", "a\n b", "x\n\n y", "don't it's", "end\n", "a.\nB c", "tab\there now", "wörter, ñ! é\nç 12a a12",
                                  "\n", "a \nb", "x  y", "trail ", "multi   space", "p.,!? q##", "日本 語 text", "<|endoftext|> a", "word\nTail2 x", "x² a½ Ⅷ b", "क्षत्रिय e\u0301 a\u200db", "ǅ ʰ ª"])
def test_cached_encoder(text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert encoder().ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


# --- SimHash

def brute_fingerprint(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), seed=42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: id to fingerprint; id to the least id reachable."""
    ids = sorted(prints)
    root = {i: i for i in ids}
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark, docs):
    got = {r.doc_id: r for r in simhash_golay.near_duplicates(docs).collect()}
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_simhash_links_are_complete(spark, hot):
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2 ** 63, 60).tolist()
    for p in prints[:20]:
        for _ in range(8):
            for b in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
                p ^= 1 << b
            prints.append(p)
    table = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in set(prints)], "print long")
    edges = simhash_golay.links(table, 3, hot).collect()
    number = {int(np.uint64(p).astype(np.int64)): p for p in set(prints)}
    want = brute_components({i: number[s] for i, s in enumerate(sorted(number))})
    at = {s: i for i, s in enumerate(sorted(number))}
    root = {i: i for i in want}
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for e in edges:
        assert (number[e.a] ^ number[e.b]).bit_count() <= 3
        x, y = sorted((find(at[e.a]), find(at[e.b])))
        root[y] = x
    assert {i: find(i) for i in want} == want
    assert len(edges) <= 40 * len(number)


def test_simhash_edges(spark, odd_docs, no_docs):
    rows = simhash_golay.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert {by[i].fingerprint for i in (2, 3, 4)} == {"0" * 16} and {by[i].component_id for i in (2, 3, 4)} == {2}
    assert by[5].component_id == 1 and by[5].n_copies == 3
    assert simhash_golay.near_duplicates(no_docs).count() == 0


def test_large_buckets_are_dealt_again(monkeypatch):
    """A bucket where nothing links takes no comparison of all with all, and loses no link."""
    rng = np.random.default_rng(7)
    free = rng.integers(0, 2 ** 36, 60_000).astype(np.uint64)
    prints = np.unique(free << np.uint64(28) | np.uint64(12345))
    start = time.time()
    simhash_golay.spanning(prints, 3)
    assert time.time() - start < 2

    def roots(n, links):
        up = list(range(n))

        def top(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b in links:
            up[top(a)] = top(b)
        return [frozenset(i for i in range(n) if top(i) == r) for r in {top(x) for x in range(n)}]
    base = rng.integers(0, 2 ** 63, 40).astype(np.uint64)
    near = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64))
                                             for _ in range(6)]]))
    whole = set(roots(len(near), simhash_golay.spanning(near, 3)))
    monkeypatch.setattr(simhash_golay, "COMPARED", 20)
    assert set(roots(len(near), simhash_golay.spanning(near, 3))) == whole


def test_xxh64_of_any_length():
    rng = np.random.default_rng(2)
    raw = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 300)
    lengths = np.concatenate([np.arange(0, 100), rng.integers(0, 1000, 200)])
    got = simhash_golay.xxh64(raw, starts, lengths)
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[s:s + n].tobytes(), seed=42) for s, n in zip(starts, lengths, strict=True)]


# --- decontamination

def brute_overlaps(docs, items, identity=0.8, least=13):
    def words(s):
        return re.findall(rb"(?:[A-Za-z0-9]|[\x80-\xff])+", (s or "").lower().encode())
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            if len(v) < 5:
                continue
            for shift in range(-len(v) + 1, len(w)):
                lo, hi = max(0, -shift), min(len(v), len(w) - shift)
                eq = [w[q + shift] == v[q] for q in range(lo, hi)]
                if sum(eq) < 5:
                    continue
                best = 0
                for a in range(len(eq)):
                    for b in range(len(eq), a, -1):
                        if eq[a] and eq[b - 1] and sum(eq[a:b]) >= identity * (b - a) - 1e-9:
                            best = max(best, b - a)
                            break
                if best >= min(least, len(v)):
                    out[d, i] = max(out.get((d, i), 0), best)
    return out


def test_overlaps(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate((15, 30, 59, 7, 4, 20))] + [(9, None), (10, "")]
    docs = []
    for d in range(60):
        words = rng.choice(vocabulary, 80).tolist()
        i, x = items[d % 6]
        v = x.split()
        if d % 3 == 0:  # whole, with every sixth word replaced, upper case and marks
            v = [w if j % 6 != 4 else "zzz" for j, w in enumerate(v)]
            words[10:10] = [w.upper() + "," for w in v]
        elif d % 3 == 1:
            words[5:5] = v[:14]
        docs.append((d, " ".join(words)))
    docs += [(100, None), (101, ""), (102, items[3][1]), (103, items[4][1] + " more"), (104, items[2][1] * 3), (104, items[2][1] * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_overlaps(docs, items)
    for block in (2_000_000, 60):
        got = decontam.overlaps(df, bench, block_words=block).collect()
        assert {(r.doc_id, r.item_id): r.n_words for r in got} == want
        assert sum(r.doc_id == 104 for r in got) == 2
        assert all(r.identity >= 0.8 - 1e-9 for r in got)
        left = {r.doc_id for r in decontam.drop_contaminated(df, bench, block_words=block).collect()}
        assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.overlaps(df, bench.limit(0)).count() == 0 and decontam.overlaps(df.limit(0), bench).count() == 0


def test_words_are_of_unicode(spark):
    def count(s):
        return sum(len(w) for _, w, _ in decontam.words_of(pa.array([s])))
    for text, n in (("“Größer”—ñandú\u00a0x…", 3), ("北京大学abc。东", 6), ("कि ताब", 2), ("ภาษาไทย", 7), ("น้ำ", 2), ("か\u3099き", 2), ("е́ж 1²", 2), ("\U00020000\U0001f600x", 2), ("", 0), ("é", 1)):
        assert count(text) == n, text
    both = pa.array(["“alpha”", "alpha", "北", "京北"])
    hashes = np.concatenate([w for _, w, _ in decontam.words_of(both)])
    assert hashes[0] == hashes[1] and hashes[2] == hashes[4] != hashes[3]
    item = "在一个阳光明媚的早晨，小明走出家门去学校上课。"
    bench = spark.createDataFrame([(1, item), (2, "the “quick” brown fox—jumps over a lazy dog")], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (2, "前面的文字" + item + "后面"), (3, "完全不同的一段文字，没有关系，不会重复。"), (4, 'The "quick" brown fox - jumps over a lazy dog')], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench).collect()} == {(1, 1), (2, 1), (4, 2)}


def test_short_items_with_any_fifth_of_their_words_replaced():
    for n in range(5, 14):
        item = np.arange(1, n + 1).astype(np.uint64)
        index = decontam.Index([7], [item], decontam.Rule())
        for k in range(n // 5 + 2):
            for gone in itertools.combinations(range(n), k):
                words = item.copy()
                words[list(gone)] = 99
                doc = np.concatenate([np.full(3, 50), words, np.full(2, 60)]).astype(np.uint64)
                want = [(0, 7, 3, 0, n, n - k)] if n - k >= 0.8 * n - 1e-9 else []
                assert index.overlaps(doc, np.zeros(len(doc), np.int64)) == want, (n, gone)
        cut = item[:-1]  # a part of a short item is not the item
        assert index.overlaps(cut, np.zeros(n - 1, np.int64)) == []


def test_items_that_share_a_phrase():
    """A lead phrase of 10,000 items is a seed of all of them; it costs arrays, not a loop for each item and document."""
    rng = np.random.default_rng(3)
    for lead in (8, 14):  # a phrase too short to count, and one that counts
        phrase = np.arange(1, lead + 1)
        items = [np.concatenate([phrase, rng.integers(10 ** 6, 10 ** 9, 16)]).astype(np.uint64) for _ in range(10_000)]
        index = decontam.Index(list(range(10_000)), items, decontam.Rule())
        docs = [np.concatenate([rng.integers(10 ** 9, 10 ** 12, 50), phrase, items[7 * d][lead:lead + 10], rng.integers(10 ** 9, 10 ** 12, 40)]).astype(np.uint64) for d in range(20)]
        rows = np.repeat(np.arange(20), [len(d) for d in docs])
        start = time.time()
        got = index.overlaps(np.concatenate(docs), rows)
        took = time.time() - start
        if lead == 8:
            assert took < 0.5
            assert sorted((r, k, n) for r, k, _, _, n, _ in got) == [(d, 7 * d, lead + 10) for d in range(20)]
        else:
            assert len(got) == 200_000 and {(at, n) for _, _, at, _, n, _ in got} >= {(50, lead)}
            assert sorted((r, k) for r, k, _, _, n, _ in got if n > 20) == [(d, 7 * d) for d in range(20)]


def test_candidates_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    items = [rng.integers(0, 6, int(rng.integers(0, 40))).astype(np.uint64) for _ in range(30)]
    docs = [rng.integers(0, 6, int(rng.integers(0, 60))).astype(np.uint64) for _ in range(12)]
    index = decontam.Index(list(range(30)), items, decontam.Rule())
    rows = np.repeat(np.arange(12), [len(d) for d in docs])
    whole = index.overlaps(np.concatenate(docs), rows)
    monkeypatch.setattr(decontam, "CANDIDATES", 7)
    monkeypatch.setattr(decontam, "COMPARED", 50)
    assert index.overlaps(np.concatenate(docs), rows) == whole and whole


def test_overlaps_edges(spark, odd_docs):
    bench = spark.createDataFrame([(1, "Alpha, beta gamma delta epsilon!")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.overlaps(odd_docs, bench).collect()) == [1, 5, 5]
    kept = decontam.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 3


# --- KD search

def brute_top(vectors, k, every):
    ok = {}
    for i, v in vectors:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        ok[i] = min(ok.get(i, q), q)
    out = []
    for i, q in ok.items():
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), j) for j, w in ok.items() if j != i and len(w) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block", [(32768, 16384), (50, 7)])
def test_top_k(spark, shard_rows, block):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=6).round(1).tolist()) for i in range(600)]
    vectors += [(1000 + i, [0.5] * 6) for i in range(40)] + [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6),
                (2150, [float("inf")] * 6), (None, [0.1] * 6), (2200, [0.1, 0.2]), (2201, [0.3, 0.2]), (2250, []), (50, [0.9] * 6), (50, [0.9] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = kd_search.top_k(df, 5, 50, shard_rows=shard_rows, block=block).collect()
    assert sorted(tuple(r) for r in got) == brute_top(vectors, 5, 50)
    assert kd_search.top_k(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    vectors = [(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [-1e9, 3.0]), (3, [2e9, 0.0]), (4, [0.5, 0.5]), (50, [1.0, 0.0]), (100, [1e300, -1e300])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in kd_search.top_k(df, 3, 50).collect()}
    top = 2 ** 63 - 1
    assert [got[0, n] for n in (1, 2, 3)] == [(1, top), (3, top), (100, top)]
    assert got[50, 1] == (100, top) and got[50, 2] == (3, int(256 * 2e9) * 256)


def test_tree_search_skips_far_boxes():
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(c, 3, (500, 3)) for c in ((0, 0, 100), (100, 0, 0), (0, -100, 0), (0, 0, -100))]).astype(np.int64)
    tree = kd_search.build(np.arange(2000), points, 3, leaf=16)
    query = np.array([[50, 0, 3]])
    best = kd_search.search(tree, np.array([-1]), query, [None], 3)[0]
    score = points @ query[0]
    assert best == sorted((-int(s), i) for i, s in enumerate(score))[:3]
    assert kd_search.search(tree, np.array([-1]), query, [int(score.max()) + 1], 3)[0] == []


def test_arrow_batches_with_offsets():
    texts = pa.array(["skip", "alpha beta gamma", None, "x"]).slice(1)
    assert [int(x) for x in simhash_golay.fingerprints(texts)] == [brute_fingerprint(t) for t in texts.to_pylist()]
    assert json.dumps([len(w) for _, w, _ in decontam.words_of(texts)]) == "[4]"
