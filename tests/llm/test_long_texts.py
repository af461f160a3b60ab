"""Very long texts in near and exact duplicate search; empty tables."""

import hashlib
import random

from ledgerloom.llm import minhash_dedup, substring_dedup


def long_words(seed, n=150_000):
    r = random.Random(seed)
    return [f"w{r.randrange(50_000)}" for _ in range(n)]


def test_long_near_copies_are_linked(spark):
    words = long_words(1)
    near = list(words)
    for k in range(0, len(near), 600):
        near[k] = "changed"
    rows = [(5, " ".join(words)), (2, " ".join(near)), (9, " ".join(long_words(2))), (11, "x " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {5: 2, 2: 2, 9: 9, 11: 11}
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_long_passages_are_removed_from_the_later_text(spark):
    words, other = long_words(3), long_words(4)
    later = [*other[:1000], *words[20_000:20_300], *other[1000:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(later)), (3, "y " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_passages(docs).collect()}
    sha = lambda w: hashlib.sha256(" ".join(w).encode()).hexdigest()
    assert got == {1: (150_000, 0, sha(words)), 2: (150_300, 300, sha(other)), 3: (100_000, 0, sha(["y"] * 100_000))}
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0
