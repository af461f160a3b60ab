"""The library is asked once for a word of a large vocabulary, and texts get the ids that it gives."""

import itertools

import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm.token_files import LibraryCodec

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Counted:
    def __init__(self, model):
        self.model, self.asked = model, 0

    def tokenize(self, word):
        self.asked += 1
        return self.model.tokenize(word)


def test_words_are_asked_once():
    codec = LibraryCodec(PATH)
    codec.model = Counted(codec.model)
    words = ["".join(x) for x in itertools.islice(itertools.product("abcdefghijklmnop", repeat=5), 280_000)]
    texts = ["x " + " ".join(words[i : i + 4000]) for i in range(0, len(words), 4000)]
    for x in texts:
        codec.encode(x)
    asked = codec.model.asked
    again = [codec.encode(x) for x in texts]
    assert codec.model.asked - asked < 1000
    odd = [texts[0], "", "a", "café naïve Über, x.y\nnew line\nand $$$ end***", "  two  spaces\t", "a&&& b", "中文 word"]
    whole = Tokenizer.from_file(PATH)
    assert [memoryview(codec.encode(x)).cast("I").tolist() if x else [] for x in odd] == [whole.encode(x, add_special_tokens=False).ids for x in odd]
    assert again[0] == codec.encode(texts[0])
