"""The ten operators against brute force, on odd inputs, and against their SQL."""

import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.conftest import same
from vigil.llm import linededup, mih, mixing, packing, quality, queries, simhash, textvec, tokencount, toxicity, urlfilter, warc

WORD = r"[^\x20\x09-\x0D]+"
BPE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    (1, "a b c d e f g h\nsame line\nnext line\nlast one\nend", "s1"), (2, "same line\nnext line\nlast one\nend\nother", "s2"), (2, "same line\nnext line\nlast one\nend\nother", "s2"),
    (3, None, None), (4, "", "s1"), (None, "no id here", "s1"), (5, "word " * 5000, "s2"), (6, "  \n\t\x0b ", "s3"), (7, "it's  'so\u3000we'll\n\n don't 3x!? <|endoftext|>", "s3"), (8, "x" * 3000, "s3"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with inner names."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    for name in ("fp", "key", "size", "h", "lines", "at", "copies", "word", "shard", "n", "label", "lang", "class", "target", "frame"):
        df = df.withColumn(name, F.lit("x"))
    return df.withColumn("n_chars", F.length("text").cast("long"))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(name, spark, data, duck):
    assert same(queries.queries()[name](spark, data).toPandas(), duck.sql(queries.oracle_sql()[name]).df())


@pytest.mark.parametrize("table", ["documents", "pages", "embeddings", "labels"])
def test_empty_tables(spark, data, tmp_path_factory, table):
    folder = tmp_path_factory.mktemp("empty")
    for t in ("documents", "pages", "embeddings", "labels"):
        df = spark.read.parquet(f"{data}/{t}.parquet").limit(20)
        (df.limit(0) if t == table else df).write.parquet(f"{folder}/{t}.parquet")
    uses = {"documents": "op1_ op2_ op4_ op5_ op7_ op8_ op10_", "pages": "op3_ op9_", "embeddings": "op6_", "labels": "op7_"}[table].split()
    for name, run in queries.queries().items():
        if any(name.startswith(u) for u in uses):
            assert run(spark, str(folder)).count() == (20 if table == "labels" else 0), name


# ---- 1


def _chunks(text):
    import hashlib

    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        rolling = h[i] + sum((h[i - k] if i >= k else 0) * (linededup.FACTOR**k % linededup.MODULUS) for k in range(1, linededup.WINDOW))
        if rolling % linededup.MODULUS % linededup.DIVISOR == 0 or i == len(lines) - 1:
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def _dedup(rows):
    docs = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None})
    seen, out = {}, {}
    for known, i, t in docs:
        kept = []
        for k, c in enumerate(_chunks(t)):
            first = seen.setdefault("\n".join(c), (known, i, t, k)) if len(c) > 1 else (known, i, t, k)
            if first == (known, i, t, k):
                kept += c
        out[known, i, t] = "\n".join(kept)
    return [(i, None if t is None else out[i is not None, i or 0, t]) for i, t in rows]


@pytest.mark.parametrize("small", [500_000, 0])
def test_line_dedup(spark, odd, monkeypatch, small):
    monkeypatch.setattr(linededup, "BROADCAST_NUMBERS", small)
    rng = np.random.default_rng(3)
    lines = [f"line {k}" for k in range(30)]
    rows = [(d, "\n".join(lines[s % 30] for s in range(a, a + n))) for d, (a, n) in enumerate(zip(rng.integers(0, 30, 40).tolist(), rng.integers(1, 25, 40).tolist()))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = linededup.dedup_lines(df).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(_dedup(rows))
    assert sum(r["__removed"] for r in got) > 100
    result = linededup.dedup_lines(odd)
    assert result.columns == [*odd.columns, "__removed"]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(r.doc_id, r.text) for r in result.collect()], key=key) == sorted(_dedup([r[:2] for r in ODD]), key=key)
    assert all(r.text is None or r.n_chars == len(r.text) for r in result.collect())


# ---- 2


def _fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORD, low)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(items, linked):
    """name -> root by brute force."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(items, 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in items}


def test_golay_keys():
    words = np.arange(1 << 23, step=977)
    code = simhash.decode(words) << 11
    code |= simhash._syndromes(code)
    assert max(int(x).bit_count() for x in code ^ words) <= 3  # a perfect code of radius 3
    assert {len({*r} - {-1}) for r in simhash.near_indices(words, 23).tolist()} <= {1, 6}
    rng = np.random.default_rng(1)
    for a in rng.integers(0, 2**63, 300, dtype=np.uint64):
        b = a
        for bit in rng.choice(64, rng.integers(0, 3), replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        assert {*simhash.keys(np.array([a]))[1].tolist()} & {*simhash.keys(np.array([b]))[1].tolist()}


@pytest.mark.parametrize("most", [4096, 3])
def test_links_and_components(spark, most):
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(0, 2**63, 60)]
    for _ in range(150):  # chains and clusters at distances 1 to 3
        x = fps[rng.integers(0, len(fps))]
        for bit in rng.choice(64, rng.integers(1, 4), replace=False):
            x ^= 1 << int(bit)
        fps.append(x if x < 2**63 else x - 2**64)
    fps = sorted(set(fps))
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = _classes(fps, lambda a, b: bits(a, b) <= 2)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(df, most)).collect()}
    got = {f: root.get(f, f) for f in fps}
    assert got == want


def test_near_duplicates(spark, odd, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1000))
    got = simhash.near_duplicates(docs).collect()
    text = [(r.doc_id, r.text) for r in docs.collect()]
    fp = {t: _fingerprint(t) for _, t in text}
    want = _classes(sorted(set(fp.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, t in text:
        c = want[fp[t]]
        least[c] = min(x for x in (least.get(c), i) if x is not None) if (least.get(c), i) != (None, None) else None
    key = lambda r: (str(r[0]), r[1])
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=key) == sorted([(i, f"{fp[t]:016x}", least[want[fp[t]]]) for i, t in text], key=key)


# ---- 3


def test_warc_round_trip(spark):
    big, other = "é<p>" * 400, "z" * 999
    rows = [(1, "http://a/ x\r\n", big), (2, None, big), (9, "u", big), (9, "v", big), (3, "u", None), (4, "u", ""), (5, "u", other), (6, "u", other), (None, "u", big), (7, "u", "q" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(2)).repartition(3)
    path = warc.write_archives(pages)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    seen = sorted((str(r.page_id), r.record_type, r.payload_bytes, r.refers_to) for r in got)
    kind = lambda i, h: ("revisit", 9) if h == big and i != 9 else ("response", None)
    assert seen == sorted((str(i), kind(i, h)[0], len((h or "").encode()), kind(i, h)[1]) for i, _, h in rows)
    kept = {(r.page_id, bytes(r.payload)) for r in got if r.record_type == "response"}
    assert kept == {(i, (h or "").encode()) for i, _, h in rows if kind(i, h)[0] == "response"}
    assert {r.url for r in got} == {"http://a/%20x%0D%0A", None, "u", "v"}


def test_warc_frames(spark, data):
    import zstandard

    pages = spark.read.parquet(f"{data}/pages.parquet")
    path = warc.write_archives(pages).removeprefix("file://")
    from pathlib import Path

    for part in Path(path).glob("part-*"):
        raw = part.read_bytes()
        assert raw[:4] == warc.DICTIONARY_MAGIC
        size = int.from_bytes(raw[4:8], "little")
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
        text = reader.stream_reader(raw[8 + size :], read_across_frames=True).read()
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
    assert warc.train_dictionary([b"tiny"]) == b"tiny"


# ---- 4 and 5


def test_pretokens_match_the_pattern():
    import regex

    rng = np.random.default_rng(4)
    alphabet = list("ab1 '\n\t!é\u3000sd中_") + ["'s", "'ll", "  "]
    texts = ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 60, 400)] + [t or "" for _, t, _ in ODD]
    joined, bounds = "".join(texts), textvec.offsets(texts)
    start = textvec.pretokens(textvec.code_points(joined), bounds).tolist()
    want = [o + m.start() for o, t in zip(bounds, texts) for m in regex.finditer(public_tokenizers.PATTERN, t)]
    assert start == want
    pieces = [p for _, ps in textvec.batches(texts, 50) for p in ps]
    assert "".join(pieces) == joined


def test_token_counts(spark, odd):
    import regex

    vocabulary = tokencount.read_vocabulary(RANKS)

    def best(word):
        f = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            f.append(max((f[i][0] + vocabulary[word[i:j]], f[i][1] - 1) for i in range(j) if word[i:j] in vocabulary))
        return -f[-1][1]

    got = tokencount.count_tokens(odd.where("length(text) < 1000 or text is null"), RANKS).collect()
    for r in got:
        text = next(t for i, t, _ in ODD if i == r.doc_id) or ""
        words = regex.findall(public_tokenizers.PATTERN, text)
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(best(w.encode()) for w in words))
    small = tokencount.CountTrie({b"a": -1.0, b"b": -1.0, b"ab": -1.5, b"aba": -2.5}, max_nodes=4)
    assert [small.count(w) for w in (b"ab", b"aba", b"abab", b"b", b"a" * 5000)] == [1, 1, 2, 1, 5000]


def test_packing_covers_all_ids(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    texts = {}
    for i, t, _ in ODD:
        texts.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    rows = packing.pack(odd.coalesce(1), BPE, size=64, block=500).collect()
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
        ids = texts[r.doc_id][0]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert max(fill.values()) <= 64
    for i, copies in texts.items():
        places = sorted(k for r in rows if r.doc_id == i for k in range(r.start, r.start + r.length))
        assert places == sorted(k for ids in copies for k in range(len(ids)))
    padding = sum(64 - n for n in fill.values() if n & (n - 1))
    assert padding <= 0.1 * sum(fill.values())


def test_cuts_are_optimal():
    rng = np.random.default_rng(6)
    for _ in range(200):
        at = np.unique(rng.integers(1, 40, rng.integers(3, 12)))
        fee, size = rng.integers(0, 6, len(at)), int(max(np.diff(np.concatenate([[0], at])).max(), rng.integers(4, 15)))

        def cost(cuts):
            edges = [0, *cuts]
            if max(b - a for a, b in zip(edges, edges[1:])) > size:
                return 10**9
            return sum(size - (b - a) for a, b in zip(edges, edges[1:])) + sum(int(fee[np.searchsorted(at, c)]) for c in cuts)

        least = min(cost([*c, int(at[-1])]) for n in range(len(at)) for c in combinations(at[:-1].tolist(), n))
        assert cost(packing.choose_cuts(at, fee, size)) == least
    ends = np.array([100, 5000])
    at, _ = packing.candidates(ends, np.zeros(5000, bool), 1024)
    assert np.diff(np.concatenate([[0], at])).max() <= 1024


# ---- 6


@pytest.mark.parametrize("shard,block", [(1_000_000, 512), (7, 3)])
def test_top_k(spark, shard, block):
    rng = np.random.default_rng(7)
    vectors = [rng.normal(size=70).round(2).tolist() for _ in range(60)]
    vectors += [vectors[0]] * 15 + [[float("nan")] * 3, [], None, [1.0]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(0, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", F.lit(1)).withColumn("ids", F.lit(2))
    got = mih.top_k(df.where("vec_id % 20 = 0"), df, 4, shard=shard, block=block).collect()
    code = {i: sum(1 << b for b, x in enumerate(v) if x > 0 or x != x) for i, v in rows if v is not None}
    want = [(q, n + 1, i, d) for q in code if q % 20 == 0 for n, (d, i) in enumerate(sorted(((code[q] ^ code[i]).bit_count(), i) for i in code if i != q)[:4])]
    assert sorted(tuple(r) for r in got) == sorted(want)


# ---- 7


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(600):
        text = rng.choice(words, rng.integers(5, 60)).tolist()
        bad = i % 4 == 0
        if bad:
            text[rng.integers(0, len(text))] = "Moron," if i % 8 else "fool"
        rows.append((i, " ".join(text), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic").where("doc_id < 400"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    wrong = sum((got[i] >= toxicity.THRESHOLD) != bool(y) for i, _, y in rows[400:])
    assert wrong <= 4
    assert toxicity.train(docs.drop("toxic"), docs.select("doc_id", F.lit(0).alias("toxic"))) is None
    assert toxicity.train(docs.drop("toxic"), docs.select("doc_id", F.lit(None).cast("int").alias("toxic"))) is None


def test_toxicity_odd(spark, odd):
    model = (np.array([5]), np.array([1.0]), -1.0)
    got = toxicity.score(odd, model, name="s").collect()
    assert len(got) == len(ODD) and all(0 <= r.s <= 1 for r in got)
    assert {r.s for r in toxicity.score(odd, None, name="s").collect()} == {0.0}
    weight = np.zeros(1 << toxicity.BITS)
    weight[toxicity.buckets("bad")] = 2.0
    alone, many = toxicity.score_texts(["x bad y", "bad " * 10], weight, 0.0)
    assert many == alone == pytest.approx(1 / (1 + np.exp(-2.0)))  # a feature counts once


# ---- 8


def test_quality(spark, odd):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in rng.integers(0, 60, 40)] + [t for _, t, _ in ODD]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judge(df).collect():
        text = texts[r.doc_id] or ""
        words = re.findall(WORD, text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)} if len(words) < 500 else set(range(len(words)))
        lines = [x for x in text.split("\n") if re.search(WORD, x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(hit))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words)) and not (r.kept and r.base_failed)
    assert quality.judge(odd).count() == len(ODD)


# ---- 9


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("key"))
    listed = F.col("key").rlike("7$")
    cascade = urlfilter.build_cascade(universe, listed)
    assert len(cascade.levels) > 1
    assert universe.where(cascade.contains(F.col("key")) != listed).count() == 0
    assert urlfilter.build_cascade(universe, listed, max_bits=10) is None
    assert urlfilter.build_cascade(universe, F.lit(False)).levels == []


def test_urls(spark):
    urls = ["http://A.Example.com/en/1", "https://www.example.com/en/x?y#z", "https://m.free-bets.example.org/en", "x://spam-farm.example.org", "http://xspam-farm.example.org/", "http://sub.adult-x.example.net/en/", "http://a.net/es/", "no scheme", None, "http://com/", "http://h.com", "http://a/?/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x"))
    want = [
        ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("m.free-bets.example.org", "/en", None, "allow"), ("spam-farm.example.org", "", None, "block"),
        ("xspam-farm.example.org", "/", None, "allow"), ("sub.adult-x.example.net", "/en/", None, "block"), ("a.net", "/es/", "net/es/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("com", "/", "com/", "allow"), ("h.com", "", None, "allow"), ("a", "/", None, "allow"),
    ]
    for limit in (1 << 24, 10):
        got = urlfilter.filter_urls(df, max_bits=limit).orderBy("page_id").collect()
        assert [tuple(r)[1:] for r in got] == want


# ---- 10


@pytest.mark.parametrize("block", [64, 4])
def test_mixing(spark, block):
    rng = np.random.default_rng(10)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), "abcdefg"[min(6, int(rng.exponential(2)))] if i % 9 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix(df, block=block).collect()
    assert sorted(r.doc_id for r in got) == list(range(700))
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    names = sorted((s for s in size if s), key=str) + [None]
    weight = dict(zip(names, [3, 1, 2] * 9))
    total, full = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and weight[s] * level > 2 * size[s]}
        if not more:
            break
        full |= more
    target = {s: 2 * size[s] if s in full else weight[s] * level for s in names}
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == size[source[r.doc_id]] and r.taken == r.copies * r.size and r.copies in (0, 1, 2)
    for s in names:
        taken = sum(r.taken for r in got if source[r.doc_id] == s)
        assert abs(taken - target[s]) <= max(r.size for r in got if source[r.doc_id] == s)
    again = mixing.mix(df.repartition(3), block=block).collect()
    assert {r.doc_id: r.copies for r in got} == {r.doc_id: r.copies for r in again}


def test_mixing_odd(spark, odd):
    got = mixing.mix(odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in ODD)
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(one).collect()] == [(0, 0.0, 0)]


