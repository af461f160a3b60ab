"""Token counts against the library; runs against brute force; tries against plain dictionaries."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ledgerloom.llm import periodic_runs, prefix_trie, queries, token_counts

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("byte_bpe_50k.json"))
SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  two", "a  b\n\n c\t", "I'm <|endoftext|> there<|endoftext|>", "<|endoftext|", "Éa ñandú über\nzwei 77.", "x" * 500, "\n" * 3000, "don't, stop. 'tis !?.. _., ½²", "日本語 テキスト。　空白", "a b" * 40_000, " lead and tail "]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def counted(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_token_counts_equal_the_library(spark, library, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 1000)
    names = "doc_id long, text string, n_tokens string, n_bytes double, h int, kind int"
    rows = [*((i, t, "x", 0.5, 1, 1) for i, t in enumerate(ODD)), (3, ODD[3], "x", 0.5, 1, 1), (None, "no id", "x", 0.5, 1, 1)]
    docs = spark.createDataFrame(rows, names)
    got = token_counts.token_counts(docs, PATH, limit=400)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(r[0], len((r[1] or "").encode()), n := counted(library, r[1]), n > 400) for r in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0


def test_each_tier_alone_gives_the_same(spark, library):
    r = random.Random(3)
    alphabet = "abcdeéß 12.,'\n\t-_ 　日 "
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(3000)] + ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(0xA0, 0x2100)))) for _ in range(r.randint(1, 30))) for _ in range(2000)]
    want = [counted(library, t) for t in texts]
    cutter = token_counts.Counting(PATH, token_counts.LengthTable())
    pieces = sorted({p for t in texts for b in cutter.blocks(t) for p in cutter.pieces(b)})
    whole = token_counts.LengthTable({p.encode(): counted(library, p) for p in pieces})
    for table in (token_counts.LengthTable(), whole, token_counts.LengthTable(packed=whole.pack()), token_counts.LengthTable(dict(list({p.encode(): counted(library, p) for p in pieces}.items())[::3]))):
        assert token_counts.Counting(PATH, table).counts(texts) == want
    monkey = token_counts.Counting(PATH, token_counts.LengthTable(packed=whole.pack()))
    monkey.tokenizer = None  # the table knows all pieces, so the library is not asked
    assert monkey.counts(texts) == want


def test_equal_hashes_are_no_hit(monkeypatch):
    monkeypatch.setattr(token_counts.xxhash, "xxh3_64_intdigest", lambda data: 5)
    table = token_counts.LengthTable({b"aa": 1, b"bb": 2, b"ccc": 3})
    import pyarrow as pa

    assert table.find(pa.array(["ccc", "bb", "xx", "", "aa"])).tolist() == [3, 2, -1, -1, 1]


def test_the_table_holds_the_most_frequent_pieces(spark):
    docs = spark.createDataFrame([(f"the cat and the dog {i}",) for i in range(50)], "text string")
    table = token_counts.frequent_pieces(docs, PATH, sample=20, most=3)
    assert table.bytes.tobytes() == b" and cat dog" and table.lengths.tolist() == [1, 1, 1]
    assert token_counts.frequent_pieces(docs.limit(0), PATH).pack()


def test_op11_on_a_whole_table(spark, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op11_token_counts(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert got == {r.doc_id: (len((r.text or "").encode()), n := counted(library, r.text), n > 1024) for r in rows} and len(got) == len(rows)


def brute_runs(words):
    """By start, then period: (start, length, period) of the stretches that no neighbour prolongs, smallest periods alone."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        start = None
        for i, x in enumerate(same):
            if x and start is None:
                start = i
            if not x and start is not None:
                if i + q - start >= max(6, 4 * q):
                    found.setdefault((start, i + q), q)
                start = None
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))


def plain_row(doc_id, text):
    """The contract's row, word by word."""
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    out = set()
    for s, length, q in runs:
        out.update(range(s + q, s + length))
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None, None, None)
    kept = " ".join(w.decode() for i, w in enumerate(words) if i not in out)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_runs_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(periodic_runs, "PAIRS", block)
    r = random.Random(7)
    for _ in range(1500):
        n, k = r.randint(0, 60), r.choice((1, 2, 2, 3, 9))
        x = [r.randrange(k) for _ in range(n)]
        if n > 8 and r.random() < 0.5:
            a = r.randrange(n)
            p = 1 + (n - a) // r.randint(3, 10)
            x = [v if i < a else x[a + (i - a) % p] for i, v in enumerate(x)]
        assert [tuple(v) for v in periodic_runs.find_runs(np.array(x, np.int64)).tolist()] == brute_runs(x)


def test_a_hash_that_lies_changes_nothing(monkeypatch):
    monkeypatch.setattr(periodic_runs, "HASHES", ((2, 1),))
    monkeypatch.setattr(periodic_runs, "_POWERS", {})
    r = random.Random(11)
    for _ in range(400):
        x = [r.randrange(3) for _ in range(r.randint(0, 50))] + [0, 1] * r.randint(0, 8)
        assert [tuple(v) for v in periodic_runs.find_runs(np.array(x, np.int64)).tolist()] == brute_runs(x)


def test_runs_of_odd_rows(spark):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x y " * 4, "x y " * 3, " ".join(["l r"] * 20 + ["m"] + ["l r"] * 20), "é " * 9, "a b c a b c a b c a b c a b b b b b b b", "x y " * 6, "w " * 30_000, " ".join(f"w{i % 700}" for i in range(9000))]
    rows = [(k * step, t, "x", 1, "y") for step in (1, 7, 10) for k, t in enumerate(texts)] + [(None, texts[8], "x", 1, "y"), (3, "b " * 9, "x", 1, "y"), (-4, texts[8], "x", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int, collapsed string")
    got = periodic_runs.run_digests(periodic_runs.with_repeats(docs))
    assert got.columns == RUN_COLUMNS
    short = [r for r in rows if len(r[1] or "") < 10_000]
    want = [plain_row(r[0], r[1]) for r in short]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert len(got) == len(rows) and set(want) <= set(got)
    assert sum(r[1] == 1 and r[3:5] == (30_000, 1) for r in got) >= 2
    assert periodic_runs.run_digests(docs.limit(0)).count() == 0


def test_collapsed_text_and_runs_are_the_operators_own(spark):
    docs = spark.createDataFrame([(1, "so  it goes on and on on on on on on\nend")], "doc_id long, text string")
    row = periodic_runs.collapse(docs).first()
    assert row.collapsed == "so it goes on and on end" and [tuple(x) for x in row.runs] == [(5, 6, 1)] and (row.start, row.length, row.period) == (5, 6, 1)


def test_op12_on_a_whole_table(spark):
    got = queries.op12_periodic_runs(spark, SMALL)
    assert got.columns == RUN_COLUMNS
    rows = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if len(r.text or "") < 20_000]
    found = sorted(map(tuple, got.collect()), key=repr)
    assert len(found) == len(rows) and {plain_row(r.doc_id, r.text) for r in short} <= set(found)


def plain_trie(rows):
    """The contract's rows, from a dictionary of all beginnings."""
    own = {}
    for conv, turn, role, text in sorted((r[:4] for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for x in members:
        if x:
            kids[x[:-1]] = kids.get(x[:-1], 0) + 1
    out = []
    for node, of in members.items():
        under = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in under if x not in kids]
        ends = ",".join(str(c) for c in sorted(c for c in of if built[c] == node))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), kids.get(node, 0), len(leaves), saved, sha(ends)))
    return sorted(out, key=repr)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, b"y") for r in rows], "conv_id long, turn int, role string, text string, path string, n int, above binary").repartition(3)


def chat(seed, ids):
    r = random.Random(seed)
    rows = []
    for c in ids:
        rows += [(c, k, r.choice(("user", "bot", None)), r.choice(("a", "é日", "", None))) for k in range(r.randint(1, 9))]
    return rows


@pytest.mark.parametrize("limit", [1, 6, 40, 20_000])
def test_trie_equals_plain_dictionaries(spark, limit):
    same = [(c, k, "user", "hello" * k) for c in range(300, 340) for k in range(7)]  # one group of copies
    preamble = [(c, k, "system", f"s{k}") for c in range(1001, 1009) for k in range(8)] + [(c, 8, "user", str(c % 3)) for c in range(1001, 1009)]
    rows = chat(1, [*range(0, 40), *range(100, 130), -7, -100, -205, 250, 555]) + same + preamble
    rows += [(2, None, "late", "first"), (None, 1, "user", "nobody"), (9, 0, None, None), (5001, 0, "user", "x")]
    rows = [r for i, r in enumerate(rows) if r[:2] not in {x[:2] for x in rows[:i]}]
    got = prefix_trie.trie(prefix_trie.with_shared_heads(conversations(spark, rows)), limit)
    assert got.columns == prefix_trie.COLUMNS and sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_trie_of_odd_tables(spark):
    def built(rows):
        return sorted(map(tuple, prefix_trie.trie(prefix_trie.with_shared_heads(conversations(spark, rows))).collect()), key=repr)

    assert built([]) == [] and built([(None, 0, "user", "x")]) == []
    alone = [(c, 0, "user", "x") for c in (101, 203, 307) if zlib.crc32(str(c).encode()) % 6]  # no base: nothing is left of them
    assert alone and built(alone) == plain_trie(alone) and len(plain_trie(alone)) == 1
    long = [(100, k, "user", "t" * 50_000 if k == 3 else str(k)) for k in range(600)]
    assert built(long) == plain_trie(long)
    twice = [(100, 0, "user", "x")] * 3
    assert [r[1:4] for r in built(twice)] == [(0, None, 1), (1, 100, 1), (2, 100, 1), (3, 100, 1)]


def test_ids_of_copies_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    rows = [(100 * c, 0, "user", "same") for c in range(-30, 90)]
    got = prefix_trie.trie(prefix_trie.paths(conversations(spark, rows))).filter("depth = 1").first()
    assert got.n_convs == 120 and got.conv_id == -3000 and got.saved_tokens == 119 * 4
    assert got.ends_sha256 == sha(",".join(str(100 * c) for c in range(-30, 90)))


def test_op13_on_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op13_prefix_trie(spark, SMALL).collect()), key=repr) == plain_trie(rows)
