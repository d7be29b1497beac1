"""Ids and counts exactly as the unchanged tokenizer and the plain dynamic programme give them."""

import zlib

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from vigil.llm import packing, textvec, tokencount

BPE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SWAP = str.maketrans("ab", "ba")


def _pair(n):
    """Two words of n letters that any sum of powers modulo 2**64 hashes alike."""
    word = "a"
    while len(word) < n:
        word += word.translate(SWAP)
    return word, word.translate(SWAP)


def _encode(encoder, texts):
    out = [[] for _ in texts]
    for row, ids in encoder.encode(texts):
        out[row] += ids.tolist()
    return out


def test_hash_alone_is_not_trusted():
    for n in (1024, 2048, 4096):
        codes = textvec.code_points("".join(_pair(n)))
        start, end = np.array([0, n]), np.array([n, 2 * n])
        assert len(set(textvec.span_hashes(codes, start, end).tolist())) == 1  # the pair does collide
        number, where = textvec.distinct(codes, start, end)
        assert number.tolist() == [0, 1] and where.tolist() == [0, 1]


def test_ids_of_every_code_point_and_odd_texts():
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    np.random.default_rng(1).shuffle(points)
    texts = ["".join(chr(c) + " a'1"[k % 4] for k, c in enumerate(points[i : i + 2000])) for i in range(0, len(points), 2000)]
    texts += ["x <|endoftext|> y", "<|endoftext|><|endoftext|>a <|endoftext|>", "", "  <|endoftext|>  b", "<|endoftext|", "it's 'll　we'd!\n\n  x\x1c\x1d y"]
    for n in (1024, 2048):
        a, b = _pair(n)
        texts += [f"{a} {b} {a}", b]
    want = [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert _encode(packing.WordEncoder(BPE), texts) == want
    assert _encode(packing.WordEncoder(BPE, most=50), texts[-12:]) == want[-12:]  # with a table that is emptied often


def test_long_texts_are_cut_only_at_white_space():
    text = ("!\x1c\x1d" * 10 + "word  ") * 30
    pieces = [p for _, ps in textvec.batches([text], 50) for p in ps]
    assert "".join(pieces) == text and len(pieces) > 5 and all(p[0] == " " for p in pieces[1:])
    codes, bounds = textvec.code_points(text), textvec.offsets(pieces)
    assert textvec.pretokens(codes, bounds).tolist() == textvec.pretokens(codes, textvec.offsets([text])).tolist()


def test_packed_ids_of_added_tokens(spark):
    a, b = _pair(1024)
    texts = ["x <|endoftext|> y", f"{a} {b}", None]
    tokenizer = Tokenizer.from_file(BPE)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BPE).collect()
    for i, ids in enumerate(want):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)


def test_counts_do_not_depend_on_the_batch():
    vocabulary = tokencount.read_vocabulary(RANKS)

    def best(word):
        f = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            f.append(max((f[i][0] + vocabulary[word[i:j]], f[i][1] - 1) for i in range(max(0, j - 130), j) if word[i:j] in vocabulary))
        return -f[-1][1]

    a, b = _pair(1024)
    texts = [a, b, f"{a} {b}", "naïve 中文 — words\n\n", "ab" * 40]
    together = tokencount._counts(RANKS, texts)
    for k, text in enumerate(texts):
        words = regex.findall(public_tokenizers.PATTERN, text)
        assert (together[0][k], together[1][k]) == (len(words), sum(best(w.encode()) for w in words))
        assert [c[0] for c in tokencount._counts(RANKS, [text])] == [together[0][k], together[1][k]]


def test_bytes_without_a_token():
    trie = tokencount.CountTrie({b"a": -1.0, b"ab": -1.5})
    assert [trie.count(w) for w in (b"ab", b"aXb", b"XXX", b"")] == [1, 3, 3, 0]
