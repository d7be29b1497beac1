"""The packing's table of known pre-tokens: what is met again is not encoded again when the table is full."""

import public_tokenizers
from tokenizers import Tokenizer

from vigil.llm import packing

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_common_words_outlive_a_full_table():
    encoder = packing.WordEncoder(BPE, most=300)
    learnt, learn = [], encoder.learn
    encoder.learn = lambda words: (learnt.extend(words), learn(words))[1]
    common = [f" common{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    texts = ["".join(common) + "".join(f" rare{chr(97 + k)}x{chr(97 + n % 26)}{chr(97 + n // 26)}é" for k in range(20)) for n in range(100)]
    tokenizer = Tokenizer.from_file(BPE)
    for text in texts:
        got = [i for _, ids in encoder.encode([text]) for i in ids.tolist()]
        assert got == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.slot) == len(encoder.n) == len(encoder.again) <= 300
    assert sum(w in common for w in learnt) == len(common)  # a table that is emptied learns them again and again


def test_a_batch_larger_than_the_table():
    encoder = packing.WordEncoder(BPE, most=10)
    tokenizer = Tokenizer.from_file(BPE)
    for text in ["a b c d e f g h", "a b c d e f g h i j k l m n o p q", "a b", "x y z a b c d e f g h", ""]:
        assert [i for _, ids in encoder.encode([text]) for i in ids.tolist()] == tokenizer.encode(text, add_special_tokens=False).ids
