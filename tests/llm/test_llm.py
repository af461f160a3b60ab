"""Corpus operators against brute force, libraries and hand-made cases: nulls, empty and long texts, ties, repeated rows,
empty tables, further columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import bpe, chat_format, decontaminate, language_id, media_png, minhash_dedup, ngram_lm, quality_crf, substring_dedup, token_files

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("byte_bpe_50k.json"))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 7)))
    base = [[word() for _ in range(n)] for n in (120, 300, 80, 60)]
    out = [None, "", "one two", "one two", "  \n\t", "Ab cD é ß", " ".join(["x"] * 400)]
    for b in base:
        out += [" ".join(b), " ".join(b)]
        for _ in range(8):
            c = list(b)
            for _ in range(r.randint(1, 6)):
                c[r.randrange(len(c))] = word()
            out.append(" ".join(c))
    passage = base[1][100:160]
    out += [" ".join([word() for _ in range(30)] + passage + [word() for _ in range(20)]) for _ in range(12)]
    out.append(" ".join(word() for _ in range(20_000)))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i * 3 + 1, t, "src", "value") for i, t in enumerate(texts)], "doc_id long, text string, source string, value string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_near_duplicates_equal_brute_force(docs, texts):
    sets = {}
    for i, t in enumerate(texts):
        ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(t)]
        sets[i * 3 + 1] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())
    low = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and low[b] < low[a]:
                    low[a], moved = low[b], True
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), low[i], low[i] == i) for i in sets}


def test_near_duplicates_in_small_blocks_and_steps(docs):
    whole = {tuple(r) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert {tuple(r) for r in minhash_dedup.near_duplicates(docs, wide=64, block=2, top=1).collect()} == whole


@pytest.mark.parametrize("group_words", [substring_dedup.GROUP_WORDS, 200, 1])
def test_repeated_passages_equal_brute_force(docs, texts, group_words):
    first, want = {}, {}
    lists = {i * 3 + 1: words_of(t) for i, t in enumerate(texts)}
    for d, ws in lists.items():
        for k in range(len(ws) - 49):
            first.setdefault(tuple(ws[k : k + 50]), d)
    for d, ws in lists.items():
        gone = set()
        for k in range(len(ws) - 49):
            if first[tuple(ws[k : k + 50])] < d:
                gone.update(range(k, k + 50))
        left = " ".join(w for k, w in enumerate(ws) if k not in gone)
        want[d] = (len(ws), len(gone), hashlib.sha256(left.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_passages(docs, group_words=group_words, tree_words=group_words).collect()}
    assert got == want


def test_without_passages_keeps_rows_and_columns(spark):
    long, short = " ".join(f"w{i}" for i in range(60)), "a few words"
    rows = [(1, long, "x"), (2, f"before {long} after", "y"), (3, long, "z"), (4, None, None), (5, "", "x"), (None, long, "n"), (6, short, "x"), (7, short, "x")]
    got = substring_dedup.without_passages(spark.createDataFrame(rows, "doc_id long, text string, ranges string"))
    assert got.columns == ["doc_id", "text", "ranges", "words_removed"]
    want = [(1, long, "x", False), (2, "before after", "y", True), (3, "", "z", True), (4, None, None, False), (5, "", "x", False), (None, long, "n", False), (6, short, "x", False), (7, short, "x", False)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_deep_nodes_are_the_maximal_repeats():
    r = random.Random(8)
    for _ in range(30):
        rows = [[r.choice("ab") for _ in range(r.randint(1, 30))] for _ in range(4)]
        flat = [x for ws in rows for x in ws]
        tree = substring_dedup.Subtree(np.array([ord(x) for x in flat]), np.array([len(x) for x in rows]))
        suffixes = {int(tree.begin[k] + i): ws[i:] for k, ws in enumerate(rows) for i in range(len(ws))}
        order, common = tree.leaves(np.array(sorted(suffixes)))
        want = {}
        for i, x in suffixes.items():
            if len(x) >= 3:
                want.setdefault(tuple(x[:3]), set()).add(i)
        want = {k: v for k, v in want.items() if len(v) > 1}
        got = {tuple(suffixes[int(order[a])][:3]): (set(order[a:b].tolist()), d) for a, b, d in zip(*substring_dedup.deep_nodes(common, 3), strict=True)}
        assert {k: v for k, (v, _) in got.items()} == want
        for places, depth in got.values():
            parts = [suffixes[p] for p in places]
            assert len({tuple(x[:depth]) for x in parts}) == 1
            assert len({tuple(x[: depth + 1]) for x in parts}) > 1 or any(len(x) == depth for x in parts)  # an end is like no other word


def test_repeated_ids_are_judged_by_their_own_text(spark):
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (5, long), (5, other), (5, other), (5, long.replace(" ", "  ")), (6, other), (None, other), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.repeated_passages(docs).collect()), key=str)
    assert got == sorted([(1, 60, 0), (5, 60, 60), (5, 60, 0), (5, 60, 0), (5, 60, 60), (6, 60, 60), (None, 60, 0), (None, 0, 0)], key=str)


def test_cutting_passages_with_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(60))
    names = ["doc_id", "text", "th", "text_hash", "ranges", "words_removed", "run", "h", "first"]
    docs = spark.createDataFrame([(i, long, *"abcdefg") for i in (1, 2)], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = substring_dedup.without_passages(docs)
    assert got.columns == [*names, "words_removed_"]
    assert sorted(map(tuple, got.collect())) == [(1, long, *"abcdefg", False), (2, "", *"abcdefg", True)]


def test_lm_base_score_counts_and_model(docs, texts):
    train, count = [], Counter()
    toks = lambda t: [w.encode().lower() for w in words_of(t)] + [None]
    for i, t in enumerate(texts):
        if zlib.crc32(str(i * 3 + 1).encode()) % 10:
            train.append(toks(t))
            count.update(toks(t))
    n, v = sum(count.values()), len(count)
    pairs = Counter(p for t in train for p in zip([None, *t[:-1]], t, strict=True))
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    d = min(0.9, max(0.1, once / (once + 2 * twice)))
    one = lambda w: (count[w] - d if count[w] else d * v) / n
    assert sum(one(w) for w in count) + one("unknown") == pytest.approx(1)
    share = ngram_lm.SHARE
    two = lambda u, w: share * pairs[u, w] / count[u] + (1 - share) * one(w) if count[u] else one(w)
    for hot in (ngram_lm.HOT, 3):
        for r in ngram_lm.lm_scores(docs, hot=hot).collect():
            t = toks(texts[(r.doc_id - 1) // 3])
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[w] > 0 for w in t), n)
            assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
            assert r.score == pytest.approx(sum(math.log10(two(a, b)) for a, b in zip([None, *t[:-1]], t, strict=True)), abs=len(t) * 24 / 65534)


def test_elias_fano_finds_places_without_decoding():
    r = np.random.default_rng(1)
    for top, n in ((10_000, 500), (2**60, 300), (5, 900), (1, 1)):
        x = np.sort(r.integers(0, top, n)).astype(np.uint64)
        at = r.permutation(n)
        assert (ngram_lm.EliasFano(x).get(at) == x[at]).all()
    keys = np.unique(r.integers(0, 2**63, 900).astype(np.uint64) * np.uint64(2)) // np.uint64(7) * np.uint64(7)
    assert (ngram_lm.unpack_keys(ngram_lm.pack_keys(keys, 7)) == keys // np.uint64(7)).all()


def test_trie_is_searched_for_pairs_that_it_does_not_hold():
    r = np.random.default_rng(3)
    key, successor = r.integers(0, 60, 900).astype(np.uint64) * np.uint64(2**55 + 1), r.integers(0, 2**48, 900).astype(np.uint64) // np.uint64(2**43)
    counts = r.integers(0, 4, 900) * 2**31
    held = {}
    for k, w, c in zip(key.tolist(), successor.tolist(), counts.tolist(), strict=True):
        held[k, w] = held.get((k, w), 0) + c
    totals = {k: sum(c for (x, _), c in held.items() if x == k) for k, _ in held}
    shard = ngram_lm.Shard(key, successor, counts, np.array([totals[k] if k % 2 else 0 for k in key.tolist()]), 0.3)
    trie = shard.trie
    assert (shard.answers() == [trie.find(np.array([k]), np.array([1]), np.array([w]))[0] for k, w in zip(key, successor, strict=True)]).all()
    asked = [(k, sorted({*r.integers(0, 32, 8).tolist()})) for k in (*sorted(totals), 17, 2**63)]
    got = trie.find(np.array([k for k, _ in asked], np.uint64), np.array([len(ws) for _, ws in asked]), np.array([w for _, ws in asked for w in ws], np.uint64))
    want = [math.log10(0.3 * c / totals[k]) if (c := held.get((k, w), 0)) else None for k, ws in asked for w in ws]
    assert any(x is None for x in want) and any(x is not None for x in want)
    for x, y in zip(got.tolist(), want, strict=True):
        assert (x == ngram_lm.UNSEEN) == (y is None)
        assert y is None or float(ngram_lm.unquantise(np.array([x]))[0]) == pytest.approx(y, abs=24 / 65534)
    empty = ngram_lm.Shard(*(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64)), 0.3).trie
    assert empty.find(np.array([5], np.uint64), np.array([2]), np.array([1, 2], np.uint64)).tolist() == [ngram_lm.UNSEEN] * 2


def test_counts_above_32_bits():
    from pyarrow import table

    keys = np.array([4, 8], np.uint64)
    rows = {"keys": [ngram_lm.pack_keys(keys, 1)] * 2, "counts": [ngram_lm.squeeze(np.array([3_000_000_000, 1]))] * 2, "chunk": [0, 1]}
    import pyarrow as pa

    got = ngram_lm._answer_words((pa.scalar(0),), table(rows))
    assert np.frombuffer(zlib.decompress(got.column("totals")[1].as_py()), np.int64).tolist() == [6_000_000_000, 2]
    assert got.column("n").to_pylist() == [6_000_000_002, 0]


def test_preference_pairs(spark):
    rows = [(1, True, 0, "user", "hi"), (1, True, 1, "assistant", "yes"), (1, False, 0, "user", "hi"), (1, False, 1, "assistant", None), (2, True, 0, None, None), (None, True, 0, "user", "x"), (3, True, 0, "user", "a"), (3, False, 0, "user", "a")]
    got = {r.pair_id: r for r in chat_format.preference_pairs(spark.createDataFrame(rows, "pair_id long, chosen boolean, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].prompt == "<|user|>\nhi<|end|>\n" and got[1].chosen == "<|assistant|>\nyes<|end|>\n" and got[1].n_common == 1
    assert got[1].chosen_mask == "0*14 1*11" and got[1].rejected_mask == "0*14 1*8"
    assert (got[2].complete, got[2].prompt, got[2].rejected) == (False, "", "")
    assert (got[3].n_common, got[3].chosen) == (1, "")


def test_quality_held_out(spark):
    r = random.Random(3)
    prose = lambda: " ".join("".join(r.choices("abcdefghij", k=4)) for _ in range(30)).capitalize() + "."
    junk = lambda: " | ".join("XYZ!!" for _ in range(20))
    rows = [(i, "\n".join((prose if i % 2 else junk)() for _ in range(4)), i % 2) for i in range(400)] + [(400, None, 1), (401, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, q int")
    field = quality_crf.train(docs.select("doc_id", "text"), docs.select("doc_id", docs.q.alias("quality")))
    got = {x.doc_id: x.score for x in quality_crf.score(docs, field).collect()}
    assert len(got) == 402 and all(0 <= x <= 1 for x in got.values())
    assert all((got[i] >= 0.3) == bool(i % 2) for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0)


def test_forward_backward_equals_enumeration():
    import itertools

    e, join = np.array([0.3, -1.0, 0.7, 2.0]), np.array([[0.5, -0.2], [0.1, 0.9]])
    weights = {y: math.exp(sum(e[i] / 2 * (1 if y[i] else -1) for i in range(3)) + sum(join[y[i], y[i + 1]] for i in range(2))) for y in itertools.product((0, 1), repeat=3)}
    good, _, log = quality_crf.marginals(e, np.array([3, 1]), join)
    z = sum(weights.values())
    assert good[1] == pytest.approx(sum(w for y, w in weights.items() if y[1]) / z)
    assert log == pytest.approx(math.log(z) + math.log(2 * math.cosh(1.0)))


def test_language(spark, none):
    r = random.Random(4)
    parts = {"aa": ["ka", "ko", "ku"], "bb": ["sch", "eit", "ung"]}
    rows = [(i, " ".join("".join(r.choices(parts[lang], k=3)) for _ in range(20)), lang) for i in range(200) for lang in (("aa", "bb")[i % 2],)]
    rows += [(200, None, "aa"), (201, "123 !!", "bb"), (202, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.predict(docs, language_id.train(docs, words_per_language=500)).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3
    assert np.mean([got[i].lang_pred == ("aa", "bb")[i % 2] for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]) > 0.95
    assert language_id.predict(none, language_id.train(none)).count() == 0


def test_rare_languages_are_learnt_and_whole_texts_read(spark):
    rows = [(i, "ka ko ku " * 30, "aa") for i in range(300)] + [(1000, "123 " * 600 + "schung eitung", "bb")]
    assert any(zlib.crc32(str(i).encode()) % 4 != 2 for i in (1000,))
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, lang string")
    assert language_id.train(docs, sample_rows=10, words_per_language=50).languages == ["aa", "bb"]


def test_gradients():
    net, words, target = language_id.Network(["x", "y"], hidden=3), [b"abc", b"d", b"xy"], np.array([0, 1, 1])
    net.parameters = [p.astype(np.float64) for p in net.parameters]

    def loss():
        p, mask = net.labels(words)
        return -np.log(p[np.arange(3), :, target][mask]).sum() / mask.sum()

    grads = net.gradients(words, target)
    for p, g, at in zip(net.parameters, grads, [(97, 2), (1, 4), (120, 0), (2, 8), (3, 1), (0,)], strict=True):
        old = p[at]
        p[at] = old + 1e-3
        up = loss()
        p[at] = old - 1e-3
        assert (up - loss()) / 2e-3 == pytest.approx(float(g[at]), abs=2e-3)
        p[at] = old


def test_bpe_equals_library(docs, texts):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(PATH), bpe.codec(PATH)
    r = random.Random(1)
    odd = ["".join(r.choices([*" \n\t'sdtlre.,!?é漢😀1２\xa0\x1c\x85", "  ", "<|endoftext|>"], k=25)) for _ in range(500)]
    odd += ["".join(r.choices([*" \n\t'sdtAB.,-_0", "  ", "word"], k=12)) for _ in range(3000)]  # ASCII alone is cut by other rules
    by_library = token_files.library_codec(PATH)
    for t in [*odd, *(x or "" for x in texts), "ab" * 400]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids
        assert by_library.encode(t) == own.encode(t)
        assert own.decode(own.encode(t)) == library.decode(ids, skip_special_tokens=False)
    assert bpe.round_trip(docs, PATH).count() == len(texts)


def test_token_files(docs, texts, none):
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(token_files.write_token_files(docs, PATH, length=64, file_tokens=500)).collect()}
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i * 3 + 1] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(none, PATH)).count() == 0


@pytest.mark.parametrize("filtering", [None, 0, 1, 2])
def test_png(filtering):
    image = np.random.default_rng(filtering or 7).integers(0, 256, (37, 64)).astype(np.uint8)
    data = media_png.write_png(image, filtering=filtering)
    assert (media_png.read_png(data) == image).all()
    with pytest.raises(ValueError):
        media_png.read_png(data[:50] + bytes([data[50] ^ 1]) + data[51:])


def test_media(docs, texts):
    for r in media_png.media_features(media_png.store_media(docs)).collect():
        data = (texts[(r.doc_id - 1) // 3] or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())


def test_tiling_and_contained_items(spark, none):
    item = [f"w{i}" for i in range(40)]
    moved = item[20:] + item[:20]
    rows = [(1, "x y z " + " ".join(moved) + " tail"), (2, " ".join(item[:12])), (3, " ".join(item).upper()), (4, None), (5, " ".join(f"v{i}" for i in range(5000))), (6, " ".join(item[i // 2] if i % 2 else "q" for i in range(80)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.contaminated(docs, bench).collect()) == [1, 3]
    assert decontaminate.tiles([1, 2, 3, 4, 5, 6, 7, 8], [5, 6, 7, 8, 0, 1, 2, 3, 4], 3) == [(0, 5, 4), (4, 0, 4)]
    assert decontaminate.contaminated(none, bench).count() == 0


def test_empty_tables(none):
    assert minhash_dedup.near_duplicates(none).count() == substring_dedup.repeated_passages(none).count() == ngram_lm.lm_scores(none).count() == 0


def test_pipeline_keeps_clean_and_drops_planted(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choices(["ka", "lo", "mi", "ter", "sun"], k=3)) for _ in range(n))
    item, passage, base = prose(40), prose(60), prose(200)
    texts = [prose(150), base, base, base + " extra", "123", prose(50) + " " + passage, prose(60) + " " + passage, prose(30) + " " + item, prose(90)]
    spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 5, 6, 8]
    assert got[6].decoded_sha256 == hashlib.sha256(" ".join(texts[6].split()[:60]).encode()).hexdigest()
    assert got[0].decoded_sha256 == hashlib.sha256(texts[0].encode()).hexdigest()
