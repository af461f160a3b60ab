"""Texts of a batch are encoded together: each distinct piece is looked up once, and every text gets the library's ids."""

import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from ledgerloom.llm import token_files
from ledgerloom.llm.token_files import LibraryCodec

PATH = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts(n):
    r = random.Random(8)
    signs = [*" \n\t'sdtlre.,!?é漢😀1２\xa0\x1c\x85", "  ", "<|endoftext|>", " word", ", ", ".\n", "naïve", "don't", "\n'll"]
    plain = ["word", "Über", "don't", "a.b", "1,000", "x", "漢字", 'said "so".', "end.\nNew", "(in)", "end,\n'tis"]
    return [*("".join(r.choices(signs, k=r.randrange(30))) for _ in range(n)), *(" ".join(r.choices(plain, k=9)) for _ in range(n)), None, "", " ", "\n", ".", "x" * 500, "é" * 200]


def as_lists(codec, texts):
    return [np.frombuffer(x, codec.kind).tolist() for x in codec.encode_all(texts)]


def test_a_batch_equals_the_library(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    monkeypatch.setattr(token_files, "PIECES", 7)
    codec, library = LibraryCodec(PATH), Tokenizer.from_file(PATH)
    texts = odd_texts(1500)
    want = [library.encode(x or "", add_special_tokens=False).ids for x in texts]
    for size in (1, 3, 400, len(texts)):  # also slices that begin within an array
        for i in range(0, len(texts), size):
            assert as_lists(codec, pa.array(texts).slice(i, size)) == want[i : i + size]
    plain = [x for x in texts if x and "<|" not in x][-1000:]  # judged as one stretch of bytes
    assert as_lists(codec, pa.array(plain)) == [library.encode(x, add_special_tokens=False).ids for x in plain]
    assert len(codec.known) <= 57 and len(codec.older) <= 57


def test_texts_side_by_side_do_not_join():
    codec, library = LibraryCodec(PATH), Tokenizer.from_file(PATH)
    for a in ("a", "a ", "a\n", "a.", "é", "<|endof", "don'", "1", "", " "):
        for b in ("b", " b", "\nb", ".b", ",", "text|>", "t", "2", "é", ""):
            assert as_lists(codec, pa.array([a, b, a])) == [library.encode(x, add_special_tokens=False).ids for x in (a, b, a)]


def test_a_distinct_piece_is_looked_up_once():
    codec, looked = LibraryCodec(PATH), []
    found = codec.remembered
    codec.remembered = lambda pieces: looked.extend(pieces) or found(pieces)
    codec.encode_all(pa.array(["some words, more words.\nAnd words"] * 1000))
    assert len(looked) == len(set(looked)) < 12


def test_large_ids(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    file["model"]["vocab"]["Ġzqzqzq"] = 70_000
    (tmp_path / "wide.json").write_text(json.dumps(file), encoding="utf-8")
    wide, narrow, texts = LibraryCodec(str(tmp_path / "wide.json")), LibraryCodec(PATH), pa.array(odd_texts(100))
    assert (wide.kind, narrow.kind) == ("<u4", "<u2") and as_lists(wide, texts) == as_lists(narrow, texts)
    rows = pa.RecordBatch.from_arrays([pa.array([5, None, 9], pa.int64()), pa.array(["a b", None, "c"])], names=["doc_id", "text"])
    for path in (PATH, str(tmp_path / "wide.json")):
        for end in (0, 70_000):
            out = next(token_files._encode(path, end, np.array([6]))(iter([rows])))
            assert out.column("part").to_pylist() == [0, 0, 1]
            assert [token_files._ids(x).tolist() for x in out.column("ids").to_pylist()] == [[*x, end] for x in as_lists(narrow, rows.column("text"))]
