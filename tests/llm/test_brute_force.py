"""Queries that SQL can't express, against plain versions; and nulls, empty tables, repeats, long texts, clashing names."""

import hashlib
import itertools
import math
import random
import struct
import zlib

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import chat_format, decontaminate, language_id, media_png, minhash_dedup, ngram_lm, quality_crf, substring_dedup, token_files
from ledgerloom.llm.common import sampled, small_slices

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("byte_bpe_50k.json"))
ROWS = [(1, "One line here.\n\n| x | y |\n| x | y |"), (2, None), (3, ""), (4, "123 !!"), (5, "Éa ñandú über\nzwei 77."), (5, "Éa ñandú über\nzwei 77."), (None, "no id at all"), (7, "\n" * 3000), (8, "word " * 30_000)]


@pytest.fixture(scope="module")
def docs(spark):
    names = "doc_id long, text string, score double, lang_pred string, node long, comp long, th long, value long"
    return spark.createDataFrame([(*r, 0.5, "x", 1, 1, 1, 1) for r in ROWS], names)


def rows_by_text(rows):
    return sorted(rows, key=repr)


def test_quality_equals_enumeration_of_labels(spark, docs):
    texts = ["aa bb.\ncc", "| |\n||||\nx", "Some prose here, quite long.\nMore of it.", "##"]
    field = quality_crf.fit(texts, np.array([1, 0, 1, 0]), steps=40)
    got = rows_by_text((r.doc_id, r.score) for r in quality_crf.score(docs.filter("doc_id < 7"), field).collect())
    want = []
    for doc, text in ROWS[:6]:
        own, size, lines = quality_crf.line_features([text])
        e = ((quality_crf.with_neighbours(own, lines) - field.mean) / field.scale) @ field.weights
        weights = {y: math.exp(sum(e[i] / 2 * (1 if v else -1) for i, v in enumerate(y)) + sum(field.join[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=len(e))}
        good = [sum(w for y, w in weights.items() if y[i]) / sum(weights.values()) for i in range(len(e))]
        want.append((doc, sum(g * (s + 1) for g, s in zip(good, size, strict=True)) / (size + 1).sum()))
    assert [d for d, _ in got] == [d for d, _ in rows_by_text(want)]
    assert [s for _, s in got] == pytest.approx([s for _, s in rows_by_text(want)])
    everything = quality_crf.score(docs, field)
    assert everything.count() == len(ROWS) and everything.columns == ["doc_id", "score"]


def test_language_equals_one_byte_at_a_time(docs):
    net = language_id.Network(["a", "b", "c"], hidden=4)
    wf, uf, wb, ub, wo, bo = net.parameters

    def states(data, w, u):
        h, out = np.zeros(4), []
        for byte in data:
            a, b = w[byte], h @ u
            z, r = (1 / (1 + np.exp(-(a[k : k + 4] + b[k : k + 4]))) for k in (0, 4))
            h = h + z * (np.tanh(a[8:] + r * b[8:]) - h)
            out.append(h)
        return out

    def predicted(text):
        sums, n = np.zeros(3), 0
        for word in (text or "").lower().split():
            for data in language_id.sequences(word):
                for f, g in zip(states(data, wf, uf), states(data[::-1], wb, ub)[::-1], strict=True):
                    logits = np.concatenate([f, g]) @ wo + bo
                    sums += np.exp(logits) / np.exp(logits).sum()
                    n += 1
        return (net.languages[int(sums.argmax())], sums.max() / n) if n else ("und", 0.0)

    got = language_id.predict(docs, net, "said", "sure")
    assert got.columns == [*docs.columns, "said", "sure"]
    rows = got.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        label, score = predicted(r.text)
        assert r.said == label and r.sure == pytest.approx(score, abs=1e-5) and (r.score, r.lang_pred) == (0.5, "x")


def naive_tiles(item, text, least):
    free_item, free_text, covered = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and free_item[i + n] and free_text[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return covered
        free_item[i : i + n] = free_text[j : j + n] = [False] * n
        covered += n


def test_contained_items_equal_plain_tiling(spark):
    r = random.Random(6)
    word = lambda k: f"w{r.randrange(k)}"
    items = [[word(9) for _ in range(r.randint(8, 20))] for _ in range(4)] + [["w1"] * 12]
    texts = []
    for k in range(24):
        parts = [items[k % 5][a : a + r.randint(4, 9)] for a in r.sample(range(8), 3)]
        texts.append([*(word(9) for _ in range(5)), *itertools.chain.from_iterable(parts), *(word(9) for _ in range(4))])
    docs = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([*items, items[0]])], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.coverage for x in decontaminate.contained_items(docs, bench).collect()}
    want = {(d, i): round(share, 6) for d, t in enumerate(texts) for i, item in enumerate([*items, items[0]]) if (share := naive_tiles(item, t, 5) / len(item)) >= 0.5}
    assert got == want and want
    left = decontaminate.without_items(docs, bench)
    assert left.columns == docs.columns and {x.doc_id for x in left.collect()} == set(range(24)) - {d for d, _ in want}


def test_decontamination_of_odd_rows(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, "no id at all here now"), (2, None), (3, ""), (4, "word word word word word word")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} == {8}
    assert decontaminate.without_items(docs, bench).count() == len(ROWS) - 1
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 10)  # several blocks
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} == {8} and decontaminate.without_items(docs, bench).count() == len(ROWS) - 1
    assert decontaminate.without_items(docs, bench.limit(0)).count() == len(ROWS)


def paeth(a, b, c):
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


@pytest.mark.parametrize("kinds", [[3], [4], [0, 1, 2, 3, 4, 4, 3, 2, 1, 0]])
def test_all_filters_are_undone(kinds):
    image = np.random.default_rng(len(kinds)).integers(0, 256, (20, 9)).astype(np.uint8)
    raw = bytearray()
    for y in range(20):
        kind = kinds[y % len(kinds)]
        raw.append(kind)
        for x in range(9):
            a, b = int(image[y, x - 1]) if x else 0, int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            raw.append((int(image[y, x]) - (0, a, b, (a + b) // 2, paeth(a, b, c))[kind]) & 255)
    data = zlib.compress(bytes(raw))
    png = media_png.SIGNATURE + media_png._chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 20, 8, 0, 0, 0, 0)) + media_png._chunk(b"IDAT", data[:7]) + media_png._chunk(b"IDAT", data[7:]) + media_png._chunk(b"IEND", b"")
    assert (media_png.read_png(png) == image).all()


def test_media_columns(docs):
    got = media_png.media_features(media_png.store_media(docs)).collect()
    assert len(got) == len(ROWS)
    media = {r.doc_id: bytes(r.media) for r in media_png.store_media(docs).collect()}
    for r in got:
        data = next((t or "").encode() for d, t in ROWS if d == r.doc_id)
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest())
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(float)
        small = np.zeros((32, 32))
        for y, x in itertools.product(range(32), repeat=2):
            ys = slice(y * len(image) // 32, max(y * len(image) // 32 + 1, (y + 1) * len(image) // 32))
            small[y, x] = image[ys, 2 * x : 2 * x + 2].mean()
        low = [[sum(small[y, x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)] if len(image) < 40 else None
        if low:
            low = np.rint(np.array(low) * 1e6)
            assert r.feature == np.packbits(low.ravel() > np.median(low)).tobytes().hex()
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got if r.doc_id == 5}) == 1


def test_odd_rows_in_every_operator(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (None, 1), (8, 0)], "doc_id long, quality int")
    assert len(minhash_dedup.near_duplicates(docs).collect()) == len(substring_dedup.repeated_passages(docs).collect()) == len(ROWS)
    scores = ngram_lm.lm_scores(docs).collect()
    assert len(scores) == len(ROWS) and [r.n_tokens for r in scores if r.doc_id in (2, 3)] == [1, 1]
    quality_crf.train(docs, labels)
    assert quality_crf.train(docs, labels.limit(0)) is None and quality_crf.score(docs.limit(0), None).count() == 0
    files = token_files.write_token_files(docs, PATH, length=64, file_tokens=500)
    back = token_files.read_token_files(files).collect()
    assert len(back) == len(ROWS) and sum(r.n_tokens for r in back) == max(r.start + r.n_tokens for r in back)
    assert media_png.media_features(media_png.store_media(docs.limit(0))).count() == 0


def test_near_copies_by_row_and_key(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base, "c"), (5, base, "b"), (5, "quite another text of some length", "a"), (3, base, "a"), (9, None, "z"), (9, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, at string")
    got = {(r.doc_id, r.at): (r.component_id, r.first, r.kept) for r in minhash_dedup.near_duplicates(df, key=("at",)).collect()}
    assert got == {(3, "c"): (3, False, True), (3, "a"): (3, True, True), (5, "b"): (3, False, False), (5, "a"): (5, True, True), (9, "z"): (9, True, True), (9, "y"): (9, True, True)}


def test_stages_judge_rows_and_keep_columns(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(80))
    item = " ".join(f"b{i}" for i in range(30))
    rows = [(3, base), (5, base), (5, "quite another clean text"), (3, base), (6, f"x {item} y"), (6, "a clean one"), (None, "nothing to see"), (7, None), (8, "")]
    names = "doc_id long, text string, lang string, score double, lang_pred string, words_removed long, from_row long"
    df = spark.createDataFrame([(*r, "en", 0.5, "kept", 1, 2) for r in rows], names)
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=repr)
    stage = dict(corpus_pipeline.STAGES)
    for name, f in corpus_pipeline.STAGES[:-1]:
        out, empty = f(spark, docs, str(tmp_path)), f(spark, docs.limit(0), str(tmp_path))
        assert out.columns == docs.columns and empty.count() == 0, name
        assert {(r.score, r.lang_pred, r.words_removed, r.from_row) for r in out.collect()} == {(0.5, "kept", 1, 2)}, name
    one = texts(stage["MinHash near-dedup"](spark, docs, str(tmp_path)))
    assert one == sorted([rows[0], *rows[2:3], *rows[4:]], key=repr)
    assert (6, "a clean one") in (left := texts(stage["benchmark decontamination"](spark, docs, str(tmp_path)))) and (6, rows[4][1]) not in left and len(left) == len(rows) - 1
    cut = texts(stage["substring dedup"](spark, docs, str(tmp_path)))
    assert (5, base) not in cut and (5, rows[2][1]) in cut and cut.count((3, base)) == 2 and (7, None) in cut
    assert {r.text for r in stage["language ID"](spark, docs, str(tmp_path)).collect()}.isdisjoint({None, ""})


def test_preference_pairs_share_their_turns(spark):
    names = "conv_id long, turn long, role string, text string, pair_id string"
    rows = [(1, 0, "user", "q", "z"), (1, 1, "assistant", "a", "z"), (1, 2, "user", "r", "z"), (1, 3, "assistant", "b", "z"), (1, 4, "user", "bye", "z"), (2, 0, "user", "x", "z"), (3, 0, "assistant", "hi", "z"), (4, 0, "user", None, "z"), (4, 1, "assistant", "c" * 100_000, "z"), (None, 0, "assistant", "x", "z"), (5, 0, "user", "s", "z"), (5, 0, "user", "s", "z"), (5, 1, "assistant", "s", "z")]
    turns = chat_format.against_echoes(spark.createDataFrame(rows, names))
    got = {r.pair_id: r for r in chat_format.preference_pairs(turns).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert (got[1].n_common, got[1].chosen, got[1].rejected) == (3, "<|assistant|>\nb<|end|>\n", "<|assistant|>\nr<|end|>\n")
    assert (got[3].n_common, got[3].rejected) == (0, "<|assistant|>\n<|end|>\n") and len(got[4].chosen) > 100_000
    assert (got[5].n_common, got[5].chosen) == (3, "")
    none = spark.createDataFrame([], names)
    assert chat_format.preference_pairs(chat_format.against_echoes(none)).count() == 0


def test_slices_are_bounded_in_bytes_and_samples_in_rows(spark):
    import pyarrow as pa

    batch = pa.record_batch({"text": ["a" * 10, None, "b" * 100, "c", "d"]})
    assert [b.num_rows for b in small_slices([batch], 2, 50)] == [2, 1, 2]
    rows = spark.range(1000).selectExpr("id % 50 as k", "cast(if(id % 50 = 0, 'rare', 'often') as string) as kind")
    got = sampled(rows, 10, "kind").collect()
    assert sorted(r.kind for r in got) == ["often"] * 10 + ["rare"] and len({r.h for r in got}) == 11
    assert sampled(rows, 7).count() == 7 and sampled(rows.limit(0), 3, "kind").count() == 0


def test_components_by_either_way(spark):
    from ledgerloom.llm.components import connected

    r = random.Random(5)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    low = {x: x for p in pairs for x in p}
    for _ in low:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    edges = spark.createDataFrame(pairs, "a long, b long")
    for few in (0, 1000):
        assert {x.node: x.label for x in connected(edges, few).collect()} == low
    assert connected(edges.limit(0)).count() == 0
