"""Stream files in a folder are mapped, and read without copies."""

import os

import numpy as np
import pytest

from ledgerloom.llm import token_files

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("byte_bpe_50k.json"))


def test_saved_files_are_mapped(spark, tmp_path):
    rows = [(i, f"document {i} says " + "word " * (i % 50)) for i in range(300)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    files = token_files.write_token_files(docs, PATH, length=64, file_tokens=2000)
    saved = {r.path: r.tokens for r in token_files.save_files(files, f"{tmp_path}/out").collect()}
    again = {r.path: r.tokens for r in token_files.save_files(files, f"{tmp_path}/out").collect()}
    assert saved == again and sorted(saved) == sorted(f"{tmp_path}/out/{x}" for x in os.listdir(tmp_path / "out")) and len(saved) > 2
    at, found = 0, {}
    for path in sorted(saved):
        file = token_files.TokenFile.mapped(path)
        assert file.tokens == saved[path] and not file.flat.flags.writeable and not file.flat.flags.owndata
        ids, mask = file.sequence(len(file) - 1)
        assert len(ids) == 64 and np.shares_memory(ids, file.flat) and mask.sum() == file.tokens - 64 * (len(file) - 1)
        for k, doc in enumerate(file.doc_ids):
            found[doc] = (at + int(file.starts[k]), len(file.document(k)))
        at += file.tokens
    want = {r.doc_id: (r.start, r.n_tokens) for r in token_files.read_token_files(files).collect()}
    assert found == want and len(want) == 301


def test_an_empty_table_gives_no_file(spark, tmp_path):
    files = token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert token_files.save_files(files, f"{tmp_path}/o").count() == 0 and token_files.read_token_files(files).count() == 0
