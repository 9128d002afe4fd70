"""Cross-tokenizer alignment against whole-text encoding and all pairs of tokens."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from yieldlens.llm import alignment, words

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "\r", "\x1c", "\u00a0", "\u3000", "\x85", "é", "漢", "字", "\U0001f600", "9", "12", "'s", "'", "%", "\u0301", "\u200b", "\x00", "<s>"]
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b \n c", "\n", "x\n  y", "x \n y", "same words here", "same words here", "<s> <unk> <|endoftext|> </s>",
    "▁", "one ▁ two", "漢字" * 400, "x" * 3000, "ab " * 700, "don't we'll I'M", "tokenization   of unbelievable  counterexamples\r\n\r\n",
]


def brute(rows):
    """The contract, straight from both libraries."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    names = {i: t for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    byte = words.bytes_of_unicode()
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    docs, count = [], Counter()
    for doc_id, text in rows:
        a, b, sizes = [], [], [[], []]
        if text:
            want = (" " + text).encode()
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            bytes_a = [bytes(byte[c] for c in names[i]) for i in a]
            bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
                a, b, bytes_a, bytes_b = [], [], [], []
            sizes = [list(map(len, bytes_a)), list(map(len, bytes_b))]
        ends = [[sum(s[: k + 1]) for k in range(len(s))] for s in sizes]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        spans = [[(e - n, e) for e, n in zip(x, s, strict=True)] for x, s in zip(ends, sizes, strict=True)]
        near = [range(len(b))] * len(a) if len(a) < 3000 else [range(max(0, k - 5), k + 6) for k in range(len(a))]
        links = [(a[p], b[q]) for p in range(len(a)) for q in near[p] if q < len(b) and max(spans[0][p][0], spans[1][q][0]) < min(spans[0][p][1], spans[1][q][1])]
        count.update(links)
        docs.append((doc_id, a, b, groups, links))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [
        (d, len(a), len(b), len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for d, a, b, g, x in docs
    ]


@pytest.fixture(scope="module")
def rows():
    random.seed(11)
    odd = ["".join(random.choices(ODD, k=random.randint(1, 30))) for _ in range(250)]
    texts = TEXTS + odd
    return [(k, t) for k, t in enumerate(texts)] + [(3, "a third row of this id"), (None, "no id"), (None, None)]


@pytest.mark.parametrize("hot", [1 << 19, 40, 0])
def test_against_brute_force(spark, rows, hot):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, n_a string, pair int")
    got = alignment.align_texts(docs, A, B, hot=hot)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark):
    assert alignment.align_texts(spark.createDataFrame([], "doc_id bigint, text string"), A, B).count() == 0
    assert alignment.align_texts(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), A, B).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_words_and_links():
    assert words.words_of("a b") == ["a", "b"]
    assert words.words_of(" a\n b ") == [" a\n b", ""]
    assert words.words_of("") == [""]
    b = alignment.Pieces(B)
    assert b.cuts

    class Letters(words.Side):
        def __init__(self, sizes, marks):
            self.load({i: b"x" * n for i, n in enumerate(sizes)}, marks)

        def encode(self, texts):
            return [[0] for _ in texts]

    one, two = Letters([1, 2, 3], ",|"), Letters([1, 2, 3], ",;\n")
    # words of 6 and 2 bytes: A 2+2+1+1 and 2, B 1+3+2 and 1+1
    groups, links, text, pairs = alignment.align(np.array([1, 1, 0, 0, 1]), np.array([0, 2, 1, 0, 0]), one, two, np.array([6, 8]))
    assert groups.tolist() == [2, 1] and links.tolist() == [5, 2]
    assert text == ["1,1|0,2;0,0|1", "1|0,0"]
    assert [(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()] == [(1, 0), (1, 2), (1, 2), (0, 1), (0, 1), (1, 0), (1, 0)]


def test_frequent_class_keeps_its_bound(spark):
    counts = spark.createDataFrame([(k, 1 + k // 10) for k in range(100)], "pair bigint, n bigint")
    for hot in (0, 5, 30, 100, 1000):
        lowest = alignment.frequent_class(counts, hot)
        assert counts.where(alignment.count_class() >= lowest).count() <= hot
    assert alignment.frequent_class(counts, 100) == 0
