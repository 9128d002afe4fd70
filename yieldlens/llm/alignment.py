"""Alignment of a byte-level BPE (A) and a sentence-piece BPE (B) of the same texts.

Both encode a blank and the text. Where tokens of A and of B end at the same byte, both id
lists are cut into groups: an end-to-index dictionary for each side, the hash-set
intersection of their keys, and the sorted common ends slice both lists; the links (pairs of
tokens whose bytes overlap) are expanded slice by slice.

A token of either kind never reaches from a character that is no white space over a blank
(A: its splitting pattern; B: no piece has a blank after another character, which is checked,
or texts stay whole). Texts are therefore cut there into words, each distinct word of a piece
of the input is encoded and aligned once, and a document is a list of words. Two passes:

1. align: a row per piece with the documents' digests, their words as numbers into the
   piece's table of words, and each word's links; written to the shared folder;
2. score: links are counted by pair over the whole corpus (summed by word, then in the task,
   then by Spark). The most frequent pairs, at most ``hot``, go to every task; a document's
   rarer pairs are joined to their counts. What is broadcast is so bounded by ``hot``, and a
   rarer pair has fewer occurrences than the cut-off, so that no join key is hot.

Edge cases: null or empty texts, and texts whose tokens do not give back their bytes (those
with U+2581, which B cannot tell from a blank), have no tokens: zeros and ''. Null and
repeated doc_ids keep a row each; repeated texts count each time; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import pieces, ragged, written
from .words import ByteLevel, Remembered, Side, bytes_of_unicode, encode_words, words_of

BLANK = "▁"
#: bytes of text aligned at a time
PIECE = 1 << 20
#: the most pairs that every task gets with their counts
HOT = 1 << 19
#: pairs counted in a task before they go on to the grouped sum
HELD = 1 << 20
#: classes of counts to a doubling, of which the cut-off is one
STEPS = 8

ALIGNED = """doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>,
  groups_sha256 array<string>, n_words array<int>, words binary, links_per_word binary, links binary"""
SCORED = """doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint,
  groups_sha256 string, rare array<bigint>"""


# ---------------------------------------------------------------- tokenizers


class Ranked(ByteLevel):
    """The same ids from the ranks of the vocabulary, much faster, where its ids rise in the order of its
    merges (else every call goes to the file's own library)."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.ranked = None
        if all(x < y for x, y in zip(merged, merged[1:], strict=False)):
            byte = bytes_of_unicode()
            ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
            if all(bytes([b]) in ranks for b in range(256)) and len(ranks) == 256 + len(merged):
                self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        super().__init__(path)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return super().encode(texts) if self.ranked is None else [self.ranked.encode_ordinary(t) for t in texts]


class Pieces(Side):
    """B: a sentence-piece model, which adds the first blank itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        is_byte = [self.model.is_byte(i) for i in range(len(names))]
        #: whether tokens end before every blank that follows another character, and at line feeds
        self.cuts = not any(BLANK in n.lstrip(BLANK) or "\n" in n for n, b in zip(names, is_byte, strict=True) if not b)
        self.blank = self.model.piece_to_id(BLANK)
        self.load({i: bytes([int(n[3:5], 16)]) if b else n.replace(BLANK, " ").encode() for i, (n, b) in enumerate(zip(names, is_byte, strict=True))}, ",;\n")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def words(self, words: list[str]) -> list[list[int]]:
        return [ids if w else [self.blank] for w, ids in zip(words, self.encode(words), strict=True)]


# ---------------------------------------------------------------- alignment


class Words(Remembered):
    """Aligned words that a task remembers: for each its tokens (A, B), groups, links, the groups
    as text, and its links as numbers a * 2**32 + b."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Ranked(path_a), Pieces(path_b)
        super().__init__()

    def clear(self) -> None:
        super().clear()
        self.stats = np.zeros((0, 4), np.int64)
        self.text: list[str | None] = []
        self.links = np.zeros(0, np.int64)

    def cut(self, text: str) -> list[str]:
        return words_of(text) if self.b.cuts else [text]

    def add(self, plain: list[str], alone: list[str]) -> None:
        words = plain + alone
        data = [b" " + w.encode() for w in words]
        ids, n = zip(*(encode_words(plain, alone, side) for side in (self.a, self.b)), strict=True)
        good = self._given_back(data, ids, n)
        if not good.all():
            ids = [x[np.repeat(good, k)] for x, k in zip(ids, n, strict=True)]
            n = [np.where(good, k, 0) for k in n]
        size = np.where(good, np.array(list(map(len, data)), np.int64), 0)
        groups, links, text, pairs = align(ids[0], ids[1], self.a, self.b, np.cumsum(size))
        self.stats = np.concatenate([self.stats, np.stack([n[0], n[1], groups, links], axis=1)])
        lines = iter(text)
        self.text += [next(lines) if g else None for g in good.tolist()]
        self.links = np.concatenate([self.links, pairs])

    def _given_back(self, data: list[bytes], ids, n) -> np.ndarray:
        """Whether the tokens of both sides are the bytes of each word."""
        good = np.ones(len(data), bool)
        whole = b"".join(data)
        size = np.array(list(map(len, data)), np.int64)
        for side, x, k in zip((self.a, self.b), ids, n, strict=True):
            ends = np.concatenate([[0], np.cumsum(side.size[x])])[np.concatenate([[0], np.cumsum(k)])]
            if (np.diff(ends) == size).all() and b"".join(side.bytes[x].tolist()) == whole:
                continue
            parts = np.split(side.bytes[x], np.cumsum(k)[:-1])
            good &= np.array([b"".join(p.tolist()) == d for p, d in zip(parts, data, strict=True)], bool)
        return good


def align(ids_a: np.ndarray, ids_b: np.ndarray, a: Side, b: Side, word_ends: np.ndarray):
    """Groups a word, links a word, the groups of each word as text, and all links.

    The words lie one after another; ``word_ends`` are their ends in bytes. Ends shared by both sides,
    found by dictionary, slice the ids into groups. Within a slice no inner ends meet, so each different
    end of either side closes one link: the two tokens that hold the byte before it.
    """
    ends_a, ends_b = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])
    at_a, at_b = (dict(zip(e.tolist(), range(1, len(e) + 1), strict=True)) for e in (ends_a, ends_b))
    shared = sorted(at_a.keys() & at_b.keys())
    last_a, last_b = (np.fromiter(map(at.__getitem__, shared), np.int64, len(shared)) for at in (at_a, at_b))
    shared = np.array(shared, np.int64)
    every = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    every = every[np.concatenate([np.ones(min(len(every), 1), bool), every[1:] != every[:-1]])]
    links = ids_a[np.searchsorted(ends_a, every)] << 32 | ids_b[np.searchsorted(ends_b, every)]
    n_groups, n_links = (np.diff(np.searchsorted(x, word_ends, "right"), prepend=0) for x in (shared, every))
    # text: A's ids of a group, each before "," or a last "|", then B's before ",", ";" or the end of a word
    mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    mark_a[last_a - 1] = 1
    mark_b[last_b - 1] = 1 + np.isin(shared, word_ends)
    group_a = np.repeat(np.arange(len(shared)), np.diff(last_a, prepend=0))
    group_b = np.repeat(np.arange(len(shared)), np.diff(last_b, prepend=0))
    text = np.empty(len(ids_a) + len(ids_b), object)
    text[np.arange(len(ids_a)) + np.concatenate([[0], last_b])[group_a]] = a.shown[mark_a, ids_a]
    text[np.arange(len(ids_b)) + last_a[group_b]] = b.shown[mark_b, ids_b]
    return n_groups, n_links, "".join(text.tolist()).split("\n")[:-1], links


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(path_a, path_b)
        pack = zstandard.ZstdCompressor(level=1)

        def blob(x, kind):
            return pa.array([pack.compress(np.asarray(x).astype(kind).tobytes())], pa.binary())

        for batch in pieces(batches, "text", PIECE):
            texts = batch.column("text").to_pylist()
            parts = [known.cut(t) if t else [] for t in texts]
            every = known.numbers([w for p in parts for w in p])
            stats, text = known.stats, known.text
            ends = np.cumsum([len(p) for p in parts])
            del parts
            docs = np.split(every, ends[:-1])
            bad = stats[:, 0] == 0
            if bad[every].any():
                docs = [d if not bad[d].any() else d[:0] for d in docs]
            digests = [hashlib.sha256(";".join([text[k] for k in d.tolist()]).encode()).hexdigest() if len(d) else "" for d in docs]
            n_words = np.array([len(d) for d in docs], np.int64)
            every = np.concatenate([np.zeros(0, np.int64), *docs])
            sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(stats[every], axis=0)])
            sums = np.diff(sums[np.concatenate([[0], np.cumsum(n_words)])], axis=0)
            used = np.zeros(len(stats), bool)
            used[every] = True
            begin = np.cumsum(stats[:, 3]) - stats[:, 3]
            links = known.links[ragged(begin[used], stats[used, 3])]
            columns = [batch.column("doc_id").to_pylist(), *sums.T.tolist(), digests, n_words.tolist()]
            types = [pa.int64()] * 5 + [pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.list_(t)) for c, t in zip(columns, types, strict=True)]
                + [blob((np.cumsum(used) - 1)[every], "<i4"), blob(stats[used, 3], "<i4"), blob(links, "<i8")],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_words", "words", "links_per_word", "links"],
            )

    return run


# ---------------------------------------------------------------- counts


def _open_piece(row: dict):
    """(words of the documents in turn, words per document, links per word, links) of an aligned row."""
    unpack = zstandard.ZstdDecompressor()
    words, per_word = (np.frombuffer(unpack.decompress(row[c]), "<i4").astype(np.int64) for c in ("words", "links_per_word"))
    return words, np.array(row["n_words"], np.int64), per_word, np.frombuffer(unpack.decompress(row["links"]), "<i8")


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(counts[order], begin) if len(begin) else counts[:0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        for row in batch.select(["words", "n_words", "links_per_word", "links"]).to_pylist():
            words, _, per_word, links = _open_piece(row)
            times = np.bincount(words, minlength=len(per_word))
            keys, counts = _summed(links, np.repeat(times, per_word))
            keys, counts = keys[counts > 0], counts[counts > 0]
            held = _summed(np.concatenate([held[0], keys]), np.concatenate([held[1], counts]))
            if len(held[0]) > HELD:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), names=["pair", "n"])
                held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), names=["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (a * 2**32 + b), n (links of the corpus that hold it), best (n is the highest of its b)."""
    n = written(aligned.mapInArrow(_count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = n.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # one row per entry of B's vocabulary
    return n.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def count_class(n: str = "n"):
    """Class of a count: ``STEPS`` to a doubling."""
    return F.floor(F.log2(F.col(n)) * STEPS).cast("int")


def frequent_class(counts: DataFrame, hot: int) -> int:
    """The lowest class of counts such that it and all above it hold at most ``hot`` pairs."""
    total, lowest = 0, 64 * STEPS
    for r in sorted(counts.groupBy(count_class().alias("c")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["c"]):  # 64 * STEPS rows at most
        total += r["n"]
        if total > hot:
            break
        lowest = r["c"]
    return lowest


def _score(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = frequent.value
        for batch in batches:
            for row in batch.to_pylist():
                words, n_words, per_word, links = _open_piece(row)
                at = np.minimum(np.searchsorted(pairs, links), max(len(pairs) - 1, 0))
                known = pairs[at] == links if len(pairs) else np.zeros(len(links), bool)
                count = np.where(known, n[at], 0) if len(pairs) else np.zeros(len(links), np.int64)
                top = known & best[at] if len(pairs) else known
                edge = np.concatenate([[0], np.cumsum(per_word)])

                def by_doc(x):
                    sums = np.concatenate([[0], np.cumsum(x)])
                    word = np.diff(sums[edge])[words]
                    return np.diff(np.concatenate([[0], np.cumsum(word)])[np.concatenate([[0], np.cumsum(n_words)])])

                n_best, count_sum, n_rare = by_doc(top), by_doc(count), by_doc(~known)
                rare_word = np.concatenate([[0], np.cumsum(~known)])
                rare_of = rare_word[edge]
                rare = links[~known][ragged(rare_of[:-1][words], np.diff(rare_of)[words])]
                rare_at = pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32())
                plain = [pa.array(row[c], t) for c, t in (("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [*plain, pa.array(n_best.astype(np.int64)), pa.array(count_sum.astype(np.int64)), pa.array(row["groups_sha256"], pa.string()), pa.ListArray.from_arrays(rare_at, pa.array(rare))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rare"],
                )

    return run


def align_texts(docs: DataFrame, path_a: str, path_b: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    aligned = written(base.mapInArrow(_align(path_a, path_b), ALIGNED), "aligned")
    counts = written(pair_counts(aligned), "pair-counts")
    lowest = frequent_class(counts, hot)
    frequent = counts.where(count_class() >= lowest).toPandas().sort_values("pair")  # ``hot`` rows at most
    shared = spark.sparkContext.broadcast((frequent["pair"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64), frequent["best"].to_numpy(bool)))
    scored = written(aligned.mapInArrow(_score(shared), SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
    rare = rare.join(counts.where(count_class() < lowest), "pair").groupBy("row")
    rare = rare.agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    out = scored.drop("rare").join(rare, "row", "left")
    more, more_best = F.coalesce(F.col("more"), F.lit(0)), F.coalesce(F.col("more_best"), F.lit(0))
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + more_best).alias("n_best"), (F.col("count_sum") + more).alias("count_sum"), "groups_sha256"
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return align_texts(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
