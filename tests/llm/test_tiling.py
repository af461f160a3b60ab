"""Tiling is greedy to the last rest, and quick on texts that repeat themselves."""

import random
import time

from ledgerloom.llm import decontaminate


def plain_tiles(item, text, least):
    """The longest free common run, the first of equals, again and again."""
    free_item, free_text, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        longest = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
        for i in range(len(item) - 1, -1, -1):
            for j in range(len(text) - 1, -1, -1):
                if item[i] == text[j] and free_item[i] and free_text[j]:
                    longest[i][j] = longest[i + 1][j + 1] + 1
                    best = max(best, (longest[i][j], -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return out
        free_item[i : i + n] = free_text[j : j + n] = [False] * n
        out.append((i, j, n))


def test_tiles_equal_plain_ones_on_random_pairs():
    r = random.Random(9)
    for _ in range(4000):
        words, least = r.choice((2, 2, 3, 4)), r.choice((2, 3, 5))
        item = [r.randrange(words) for _ in range(r.randint(0, 24))]
        text = [r.randrange(words) for _ in range(r.randint(0, 24))]
        for _ in range(r.randint(0, 3)):  # passages in another order
            a, b = (r.randint(0, len(item)) for _ in range(2))
            text += item[min(a, b) : max(a, b)]
        assert decontaminate.tiles(item, text, least) == plain_tiles(item, text, least), (item, text, least)


def test_repetitive_texts_take_seconds():
    began = time.time()
    assert decontaminate.tiles([7] * 1000, [7] * 10_000) == [(0, 0, 1000)]
    assert sum(n for _, _, n in decontaminate.tiles([1, 2, 3] * 400, [2, 3, 1, 9] * 10 + [1, 2, 3] * 4000)) == 1200
    r = random.Random(2)
    assert decontaminate.tiles([r.randrange(2) for _ in range(300)], [r.randrange(2) for _ in range(3000)])
    assert time.time() - began < 30


def test_long_texts_and_empty_sides(spark):
    words = [f"w{i}" for i in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "word " * 50_000), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words[500:540])), (2, "word " * 200), (3, " ".join(reversed(words[:40]))), (4, None)], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.contained_items(docs, items).collect())) == [(1, 1, 1.0), (2, 2, 1.0)]
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.without_items(docs, items.limit(0)).count() == 4
