"""Splitter, BPE, Huffman files and Wu-Manber against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from yieldlens.llm import bytebpe, decontam, huffman, pretoken, words
from yieldlens.llm.common import SpanHasher

ODD = " \t\n  '''strevlmdSAé9½%# 　漢\U0001f600"
TEXTS = [None, "", " ", "\n\n  x", "I'll we've 'tis don't's", "é" * 700, "x" * 3000, "abab" * 500, "日本語 text 123\t\r\n end ", "<|endoftext|> a", "a <|endoftext|>b<|endoftext|>", "same", "same", "͸ unassigned ՘x"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")


def test_splitter_matches_pattern():
    random.seed(3)
    splitter, pattern = pretoken.Splitter(), regex.compile(P.PATTERN)
    for _ in range(1500):
        texts = ["".join(random.choice(ODD) for _ in range(random.randint(0, 12))) for _ in range(3)]
        points, lens = pretoken.code_points(texts)
        first = np.cumsum(lens) - lens
        at = [*splitter.split(points, first[lens > 0]).tolist(), len(points)]
        joined = "".join(texts)
        assert [joined[a:b] for a, b in zip(at, at[1:], strict=False)] == [m for t in texts for m in pattern.findall(t)]


def test_bpe_against_library(spark, docs):
    path = bytebpe.ranks_file()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    got = sorted(map(tuple, bytebpe.token_digests(bytebpe.encode_texts(docs, path), path).collect()), key=str)
    want = []
    for r in docs.collect():
        t = r["text"] or ""
        ids = np.array(library.encode_ordinary(t), "<u4")
        want.append((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bytebpe.token_digests(bytebpe.encode_texts(docs.limit(0), path), path).count() == 0


def test_huffman_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 40, 700):
        counts = rng.zipf(1.2, n).clip(0, 10**9)
        lens = huffman.code_lengths(counts, 11)
        assert lens.max() <= 11 and (n == 1 or (2.0 ** -lens.astype(float)).sum() == 1)
        code = huffman.Code(lens)
        ids = rng.choice(n, 3000)
        bits, checks = code.encode(ids)
        assert (code.decode(bits, checks, len(ids)) == ids).all()
    assert huffman.code_lengths(np.array([1, 1, 2, 4]), 8).tolist() == [3, 3, 2, 1]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_token_files_round_trip(spark, docs):
    got = [tuple(r) for r in huffman.read_token_files(huffman.write_token_files(docs, huffman.tokenizer_file())).orderBy("start").collect()]
    tok = Tokenizer.from_file(huffman.tokenizer_file())  # as it comes: an added token in a text is one token
    assert 50256 in tok.encode("a <|endoftext|> b", add_special_tokens=False).ids
    want = {}
    for r in docs.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [g[0] for g in got] == sorted((r["doc_id"] for r in docs.collect()), key=lambda x: (x is not None, x))
    start = 0
    for doc_id, at, n, crc in got:
        assert at == start and (n, crc) in want[doc_id]
        start += n
    assert huffman.read_token_files(huffman.write_token_files(docs.limit(0), huffman.tokenizer_file())).count() == 0


def test_splitter_by_the_librarys_classes():
    from tokenizers.pre_tokenizers import ByteLevel

    random.seed(6)
    splitter, cut = pretoken.Splitter(pretoken.library_classes()), ByteLevel(add_prefix_space=False)
    some = [chr(c) for c in (0x558, 0x88F, 0x378, 0x11DE0, 0x1E4F0, 0x323B0, 0x180E, 0x200B, 0xA0, 0x2028)]
    for _ in range(400):
        t = "".join(random.choice([*ODD, *some]) for _ in range(random.randint(1, 20)))
        points, _ = pretoken.code_points([t])
        at = [*splitter.split(points, np.array([0])).tolist(), len(points)]
        assert list(zip(at, at[1:], strict=False)) == [span for _, span in cut.pre_tokenize_str(t)]


def test_key_slots_and_distinct():
    rng = np.random.default_rng(7)
    few = pretoken.KeySlots(50)
    held = np.zeros(0, np.uint64)
    for _ in range(9):
        # keys that share their first bits want the same slots
        keys = np.unique(rng.integers(0, 6, 12).astype(np.uint64) << np.uint64(58) | rng.integers(0, 9, 12).astype(np.uint64))
        want = [int(np.flatnonzero(held == k)[0]) if (held == k).any() else -1 for k in keys]
        assert few.find(keys).tolist() == want
        new = keys[few.find(keys) < 0]
        few.add(new)
        held = np.concatenate([held, new])
    for n in (0, 1, 5, 4000):
        key = rng.integers(0, 50, n).astype(np.uint64) << np.uint64(57) | rng.integers(0, 4, n).astype(np.uint64)
        sample, number = pretoken.distinct(key)
        assert (key[sample][number] == key).all() and len(sample) == len(np.unique(key))


def test_word_ids_are_the_librarys():
    random.seed(4)
    side = words.ByteLevel(huffman.tokenizer_file())
    known = words.WordIds(side)
    texts = ["".join(random.choice(ODD + "\x1c\x85\u180e\u200b") for _ in range(random.randint(0, 25))) for _ in range(3000)] + [t or "" for t in TEXTS]
    got = known.of_texts(texts[:1500]) + known.of_texts(texts[1500:])
    assert [g.tolist() for g in got] == [e.ids for e in side.tok.encode_batch(texts, add_special_tokens=False)]


def test_words_forgotten_and_met_again(monkeypatch):
    monkeypatch.setattr(words, "REMEMBERED", 5)
    side = words.ByteLevel(huffman.tokenizer_file())
    known = words.WordIds(side)
    for k in range(6):
        texts = [f"some words {k} {i} again" for i in range(4)]
        assert [g.tolist() for g in known.of_texts(texts)] == side.encode(texts)


def test_wu_manber_finds_all():
    rng = random.Random(5)
    for shortest in (3, 5, 9, 20):
        pats = list({bytes(rng.choice(b"ab ") for _ in range(rng.randint(shortest, shortest + 6))) for _ in range(12)})
        text = bytes(rng.choice(b"ab ") for _ in range(9000)) + pats[0]
        at, pat = decontam.WuManber(pats).search(np.frombuffer(text + bytes(8), np.uint8), len(text))
        want = sorted((i, k) for k, p in enumerate(pats) for i in range(len(text)) if text.startswith(p, i))
        assert sorted(zip(at.tolist(), pat.tolist(), strict=True)) == want


def test_contamination_against_brute_force(spark, monkeypatch):
    vocab = [f"w{i}" for i in range(40)]
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate((14, 10, 3, 1, 25))] + [(None, "null id item"), (7, None), (8, "?!"), (0, "other text of item zero")]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(60))) for i in range(20)]
    docs += [(30, "X, " + items[0][1].upper().replace(" ", "--") + " y"), (31, items[4][1] * 2), (32, None), (33, ""), (34, "null id item"), (34, "null id item"), (None, items[1][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' AS spans", "1 AS n_words")
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (1 << 20, 40):  # one block, and several
        monkeypatch.setattr(decontam.item_blocks, "__defaults__", (limit,))
        got = sorted((tuple(r) for r in decontam.contamination(d, frame).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)
        want = []
        for doc_id, text in docs:
            w = decontam.words_of(text)
            hit, met = set(), set()
            for item, body in items:
                v = decontam.words_of(body)
                k = min(10, len(v))
                for i in range(len(v) - k + 1 if v else 0):
                    for j in range(len(w) - k + 1):
                        if w[j : j + k] == v[i : i + k]:
                            hit.update(range(j, j + k))
                            met.add("" if item is None else str(item))
            want.append((doc_id, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
        assert got == sorted(want, key=str)
    assert decontam.contamination(d, frame.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(d.limit(0), frame).count() == 0
