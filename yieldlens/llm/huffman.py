"""Token-id files: canonical length-limited Huffman codes in independent blocks.

Texts are encoded once with the tokenizers library. The library gets each distinct match of
its splitting pattern once per task, by its own classes of code points; a text that holds the
content of an added token goes to it whole, as that is one token there. Global counts of ids come from a grouped sum and give one canonical code of at most
``limit`` bits (package-merge). Files hold blocks of whole documents in ascending doc_id
order: doc_ids, token counts, a bit-offset checkpoint for every 256th token, and the bits.
A block decodes without any other: all its checkpoints advance in step, one table lookup
giving symbol and length for each.

What reaches the driver is bounded: one count per id of the vocabulary. Files are written to
the shared folder under names of their own for each task attempt, and only those of finished
tasks are in the manifest, so a lost executor leaves no double rows.

Edge cases: null and empty texts give the end id alone; null doc_ids come first; rows that
repeat a doc_id are ordered by the digest of their text and keep a row each; an empty table
gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import table
from .common import SpanHasher, pieces, ragged, shared_path, written
from .pretoken import Splitter, WordBatch, WordCache, library_classes

MAGIC = b"HUFIDS01"
STEP = 256
BLOCK_TOKENS = 1 << 18
#: bytes of words that the library gets at a time, bytes of text split at a time
JOINED, PIECE = 1 << 11, 1 << 19
#: bytes that are white space, and bytes that a white-space character may start with
SPACE_BYTES = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
SPACE_LEADS = SPACE_BYTES | np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


# ---------------------------------------------------------------- code


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code length of every symbol (0: never seen) by package-merge, ``limit`` bits at most."""
    out = np.zeros(len(counts), np.uint8)
    seen = np.flatnonzero(counts)
    if len(seen) == 1:
        out[seen] = 1
    if len(seen) < 2:
        return out
    if len(seen) > 1 << limit:
        raise ValueError(f"{len(seen)} symbols do not fit codes of {limit} bits")
    seen = seen[np.argsort(counts[seen], kind="stable")]
    leaf = counts[seen].astype(np.float64)
    levels, items, is_leaf = [], leaf, np.ones(len(leaf), bool)
    levels.append(is_leaf)
    for _ in range(limit - 1):
        pairs = items[0 : len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, pairs])
        order = np.argsort(both, kind="stable")
        items, is_leaf = both[order], order < len(leaf)
        levels.append(is_leaf)
    lens = np.zeros(len(seen), np.int64)
    take = 2 * (len(seen) - 1)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lens[:leaves] += 1
        take = 2 * (take - leaves)
    out[seen] = lens
    return out


class Code:
    """Canonical code of the given lengths; bits are stored lowest first."""

    def __init__(self, lens: np.ndarray):
        self.lens = lens.astype(np.int64)
        self.limit = max(1, int(lens.max(initial=1)))
        order = np.lexsort((np.arange(len(lens)), lens))
        order = order[lens[order] > 0]
        l = self.lens[order]
        # the code of a symbol is the sum of 2**-length of those before it
        value = np.concatenate([[0], np.cumsum(1 << (self.limit - l))])[:-1] >> (self.limit - l)
        back = np.zeros(len(order), np.int64)
        for bit in range(self.limit):
            back |= np.where(bit < l, (value >> bit & 1) << np.maximum(l - 1 - bit, 0), 0)
        self.code = np.zeros(len(lens), np.uint64)
        self.code[order] = back.astype(np.uint64)
        self.symbol = np.zeros(1 << self.limit, np.int32)
        self.size = np.zeros(1 << self.limit, np.int64)
        for n in np.unique(l):
            mine = order[l == n]
            slots = (back[l == n][:, None] + (np.arange(1 << (self.limit - n)) << n)[None, :]).ravel()
            self.symbol[slots] = np.repeat(mine, 1 << (self.limit - n))
            self.size[slots] = n

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of every STEP-th id)."""
        n = self.lens[ids]
        stop = np.cumsum(n)
        at = stop - n
        bits = self.code[ids] << (at & 31).astype(np.uint64)
        word = at >> 5
        size = (int(stop[-1]) + 31) // 32 + 1 if len(ids) else 1
        low = np.bincount(word, (bits & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
        high = np.bincount(word + 1, (bits >> np.uint64(32)).astype(np.float64), size + 1)[:size]
        return (low + high).astype("<u4").tobytes(), at[::STEP]

    def decode(self, bits: bytes, checks: np.ndarray, count: int) -> np.ndarray:
        """The ids, all checkpoints advancing together."""
        data = bits + bytes(8)
        words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        at = checks.astype(np.int64)
        out = np.zeros((STEP, len(at)), np.int32)
        last = count - STEP * (len(at) - 1)
        mask = np.uint64((1 << self.limit) - 1)
        for k in range(STEP):
            m = len(at) if k < last else len(at) - 1
            if not m:
                break
            p = at[:m]
            slot = ((words[p >> 3] >> (p & 7).astype(np.uint64)) & mask).astype(np.int64)
            out[k, :m] = self.symbol[slot]
            at[:m] += self.size[slot]
        return out.T.ravel()[:count]


# ---------------------------------------------------------------- files


def pack_block(code: Code, doc_ids: np.ndarray, known: np.ndarray, n_tokens: np.ndarray, ids: np.ndarray) -> bytes:
    bits, checks = code.encode(ids)
    body = b"".join([doc_ids.astype("<i8").tobytes(), known.astype("u1").tobytes(), n_tokens.astype("<u4").tobytes(), checks.astype("<u4").tobytes(), bits])
    return struct.pack("<IIII", len(body), len(doc_ids), len(ids), len(checks)) + body


def read_blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, known, n_tokens, ids) of each block of an open file."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id file")
    code = Code(np.frombuffer(zlib.decompress(stream.read(struct.unpack("<I", stream.read(4))[0])), np.uint8))
    while head := stream.read(16):
        size, docs, tokens, n_checks = struct.unpack("<IIII", head)
        body = stream.read(size)
        at = 0
        parts = []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", n_checks)):
            parts.append(np.frombuffer(body, kind, n, at))
            at += parts[-1].nbytes
        yield parts[0], parts[1] > 0, parts[2].astype(np.int64), code.decode(body[at:], parts[3], tokens)


def _open(path: str, write: bool = False):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_output_stream(name) if write else store.open_input_stream(name, buffer_size=1 << 20)


# ---------------------------------------------------------------- tasks


def _tokenize(path: str, end_id: int):
    classes = zlib.compress(library_classes().tobytes())  # the same for every task, some kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tok, plain_tok = Tokenizer.from_file(path), None
        added = [t.content for t in tok.get_added_tokens_decoder().values()]
        tok.encode_special_tokens = True  # no word that it gets holds one, so it need not look for them
        model = tok.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # each word comes once
            tok.model = model
        newline = tok.encode("\n", add_special_tokens=False).ids
        splitter, hasher = Splitter(np.frombuffer(zlib.decompress(classes), np.uint8)), SpanHasher()
        pack = zstandard.ZstdCompressor(level=1)

        def joined(buf, start, size):
            """Ids of the words with a newline after each, some kilobytes of words at a time."""
            ends = np.cumsum(size + 1)
            lines = np.full(int(ends[-1]) if len(ends) else 0, ord("\n"), np.uint8)
            lines[ragged(ends - size - 1, size)] = buf[ragged(start, size)]
            cuts = np.unique(np.concatenate([[0], ends[np.searchsorted(ends, np.arange(JOINED, len(lines), JOINED))], ends[-1:]]).astype(np.int64)).tolist()
            found = [np.zeros(0, np.int32)]
            for k in range(0, len(cuts) - 1, 16):
                groups = [lines[a:z].tobytes().decode() for a, z in zip(cuts[k : k + 16], cuts[k + 1 : k + 17], strict=False)]
                found += [np.array(e.ids, np.int32) for e in tok.encode_batch_fast(groups, add_special_tokens=False)]
            return np.concatenate(found)

        def encode(buf, start, stop):
            # words of white space alone would join the separator's match: they go one by one.
            # A match that ends in white space has nothing else; beyond ASCII Python decides.
            blank = SPACE_BYTES[buf[stop - 1]]
            for k in np.flatnonzero((buf[stop - 1] >= 0x80) & SPACE_LEADS[buf[start]]):
                blank[k] = buf[start[k] : stop[k]].tobytes().decode().isspace()
            plain, rest = np.flatnonzero(~blank), np.flatnonzero(blank)
            n = np.zeros(len(start), np.int64)
            some = joined(buf, start[plain], (stop - start)[plain])
            line = some == newline[0]
            n[plain] = np.diff(np.concatenate([[-1], np.flatnonzero(line)])) - 1
            alone = [np.array(tok.encode(buf[start[k] : stop[k]].tobytes().decode(), add_special_tokens=False).ids, np.int32) for k in rest]
            n[rest] = [len(x) for x in alone]
            begin = np.cumsum(n) - n
            flat = np.empty(int(n.sum()), np.int32)
            flat[ragged(begin[plain], n[plain])] = some[~line]
            if len(rest):
                flat[ragged(begin[rest], n[rest])] = np.concatenate(alone)
            return flat, n

        cache = WordCache(encode)
        for b in pieces(batches, "text", PIECE):
            texts = b.column("text").to_pylist()
            odd = [k for k, t in enumerate(texts) if any(a in t for a in added)]
            if odd and plain_tok is None:
                plain_tok = Tokenizer.from_file(path)
            whole = {k: plain_tok.encode(texts[k], add_special_tokens=False).ids for k in odd}
            ids, n = cache.ids_of(WordBatch([("" if k in whole else t) for k, t in enumerate(texts)], splitter, hasher))
            parts = np.split(ids, np.cumsum(n)[:-1])
            blobs = [pack.compress(np.append(whole.get(k, p), end_id).astype("<u4").tobytes()) for k, p in enumerate(parts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(blobs, pa.binary())], names=["doc_id", "tie", "ids"])

    return run


def _unpack(blobs: list[bytes]) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return [np.frombuffer(unpack.decompress(x), "<u4").astype(np.int64) for x in blobs]


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                total += np.bincount(np.concatenate(_unpack(b.column("ids").slice(k, 256).to_pylist())), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return run


def _write(folder: str, lens_blob: bytes):
    """Write the sorted rows of a partition to one file and return its manifest row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(zlib.decompress(lens_blob), np.uint8))
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.huf"
        out, held, size, docs = None, [], 0, 0

        def block(rows):
            doc_ids = np.array([d or 0 for d, _ in rows], np.int64)
            known = np.array([d is not None for d, _ in rows])
            n = np.array([len(x) for _, x in rows])
            return pack_block(code, doc_ids, known, n, np.concatenate([x for _, x in rows]))

        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), _unpack(b.column("ids").to_pylist()), strict=True):
                if out is None:
                    out = _open(path, write=True)
                    out.write(MAGIC + struct.pack("<I", len(lens_blob)) + lens_blob)
                held.append((doc_id, ids))
                size, docs = size + len(ids), docs + 1
                if size >= BLOCK_TOKENS:
                    out.write(block(held))
                    held, size = [], 0
        if out is None:
            return
        if held:
            out.write(block(held))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([docs], pa.int64())], names=["file_no", "path", "n_docs"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for no, path in zip(b.column("file_no").to_pylist(), b.column("path").to_pylist(), strict=True):
            seen = 0
            with _open(path) as stream:
                for doc_ids, known, n, ids in read_blocks(stream):
                    ends = np.cumsum(n)
                    data = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), no), pa.int32()), pa.array(doc_ids, mask=~known), pa.array(seen + ends - n), pa.array(n), pa.array(crc, pa.int64())],
                        names=["file_no", "doc_id", "offset", "n_tokens", "ids_crc32"],
                    )
                    seen += int(ends[-1])


# ---------------------------------------------------------------- jobs


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limit: int = 18) -> DataFrame:
    """Encode ``docs`` (doc_id, text), write the files and return the manifest (file_no, path, n_docs)."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    enc = written(base.mapInArrow(_tokenize(tokenizer_path, end_id), "doc_id bigint, tie bigint, ids binary"), "token-ids")
    counts = np.zeros(size, np.int64)
    for r in enc.select("ids").mapInArrow(_count(size), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # ≤ vocabulary rows
        counts[r["id"]] = r["n"]
    lens_blob = zlib.compress(code_lengths(counts, limit).tobytes())
    folder = shared_path(spark, "token-files")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(folder)
    store.create_dir(name, recursive=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = enc.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    return written(dealt.mapInArrow(_write(folder, lens_blob), "file_no int, path string, n_docs bigint"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    files = max(1, manifest.count())
    rows = manifest.select("file_no", "path").repartition(files, "file_no").mapInArrow(_read, "file_no int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    rows = written(rows, "token-rows")
    totals = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("file_no", (F.sum("n").over(W.orderBy("file_no")) - F.col("n")).alias("base"))  # one row per file
    return rows.join(base, "file_no").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer_file()))
