"""Language identification by Bayesian evidence fusion.

Text gives a likelihood per language from hashed byte trigrams (a multinomial model fitted on
labelled rows, at most ``sample_per_lang`` of each language, chosen by hash). Other evidence
comes from the table itself, by grouped aggregation of the text-only posteriors over all
rows: how often pages of a language declare each markup language, and language shares of
each host, its registered domain and its address suffix, each level smoothed towards the
next wider one and the widest towards the whole table. A row's own share is taken out of the
counts it is judged by. Posterior = text likelihood × declaration likelihood × host prior.

Hot hosts are met by partial aggregates and shuffle joins of narrow rows (no text); only the
trigram model (languages × ``BUCKETS`` numbers) and one row per declared language are
collected, and more than ``MAX_LANGS`` labels raise an error.

Edge cases: null or empty texts have no trigrams and are judged by the other evidence (their
``n_grams`` is 0); null hosts, suffixes or declarations give no evidence; ties go to the
first language by name; without labelled rows every language is null; repeated rows are
judged alike; an empty table gives no rows; other columns are kept only where stated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import first_n
from ..session import table
from .common import mix64, pieces, written

BUCKETS = 1 << 13
SAMPLE_PER_LANG = 20_000
MAX_LANGS = 500
#: overlapping trigrams say the same thing about three times
TEMPER = 1 / 3
#: pseudo-counts by which a level leans on the wider one
STRENGTH = 8.0
_FOLD = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def trigram_buckets(texts: list, bits: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each letter trigram of all texts, number per text)."""
    rows = [b" " + b" ".join(t.lower().encode().translate(_FOLD).split()) + b" " if t else b"" for t in texts]
    size = np.array([len(r) for r in rows], np.int64)
    buf = np.frombuffer(b"".join(rows) + b"  ", np.uint8).astype(np.uint64)
    key = buf[:-2] << np.uint64(16) | buf[1:-1] << np.uint64(8) | buf[2:]
    n = np.maximum(size - 2, 0)
    n[n < 2] = 0  # blanks alone
    ends = np.cumsum(size)
    keep = np.zeros(len(key) + 1, np.int32)
    some = n > 0
    np.add.at(keep, (ends - size)[some], 1)
    np.add.at(keep, (ends - size + n)[some], -1)
    return (mix64(key[np.cumsum(keep[:-1]) > 0]) % np.uint64(bits)).astype(np.int64), n


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in pieces(batches, "text", 1 << 19):
        buckets, n = trigram_buckets(b.column("text").to_pylist())
        langs = np.array(b.column("lang").to_pylist(), dtype=object)
        per = np.repeat(langs, n)
        for lang in set(langs):
            total[lang] = total.get(lang, 0) + np.bincount(buckets[per == lang], minlength=BUCKETS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at].astype(np.int64))], names=["lang", "bucket", "n"])


def fit_trigrams(labelled: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities languages × BUCKETS) from rows (text, lang)."""
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages are labelled")
    if not sizes:
        return [], np.zeros((0, BUCKETS))
    langs = sorted(sizes)
    # the smallest hashes of distinct texts: copies count once, and every language has its share
    h = F.xxhash64("text").alias("h")
    chosen = first_n(known.select("lang", h).distinct(), ["lang"], ["h"], sample_per_lang).select("lang", "h")
    hashed = known.withColumn("h", h).join(F.broadcast(chosen), ["lang", "h"], "left_semi")  # sample_per_lang rows a language
    picked = hashed.groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang")
    counts = np.zeros((len(langs), BUCKETS))
    for r in picked.mapInArrow(_train, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():  # ≤ languages × BUCKETS
        counts[langs.index(r["lang"]), r["bucket"]] = r["n"]
    counts += 0.5
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def text_scores(texts: list, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tempered log-likelihoods rows × languages, trigrams per row)."""
    buckets, n = trigram_buckets(texts)
    sums = np.zeros((len(texts), len(logp)))
    ends = np.concatenate([[0], np.cumsum(n)])
    for k, row in enumerate(logp):
        total = np.concatenate([[0], np.cumsum(row[buckets])])
        sums[:, k] = total[ends[1:]] - total[ends[:-1]]
    return sums * TEMPER, n


def posterior(score: np.ndarray) -> np.ndarray:
    if not score.shape[1]:
        return score
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _lists(x: np.ndarray) -> pa.Array:
    flat = pa.array(x.ravel(), pa.float64())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)


def _score(logp: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 19):
            ll, n = text_scores(b.column("text").to_pylist(), logp)
            rest = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(n), _lists(ll), _lists(posterior(ll))], names=[*rest, "n_grams", "ll", "post"])

    return run


def _fuse(langs: list[str], total: np.ndarray, declared: dict[str, np.ndarray]):
    """Rows with ll, post and the sums of their levels -> language, confidence, text language."""

    def sums(col: pa.Array, own: np.ndarray) -> np.ndarray:
        have = [x if x is not None else None for x in col.to_pylist()]
        out = np.array([x if x is not None else np.zeros(own.shape[1]) for x in have]).reshape(own.shape)
        return np.maximum(out - np.where(np.array([x is not None for x in have])[:, None], own, 0), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = len(langs)
            ll = np.array(b.column("ll").to_pylist(), dtype=float).reshape(-1, k)
            # rows without text have a flat posterior and no say in the counts
            own = np.array(b.column("post").to_pylist(), dtype=float).reshape(-1, k) * (np.array(b.column("n_grams").to_pylist()) > 0)[:, None]
            prior = np.maximum(total - own, 0) + 1.0
            prior /= prior.sum(axis=1, keepdims=True)
            for level in ("suffix", "domain", "host"):
                s = sums(b.column(f"{level}_sum"), own)
                prior = (s + STRENGTH * prior) / (s.sum(axis=1, keepdims=True) + STRENGTH)
            says = np.zeros_like(ll)
            for i, d in enumerate(b.column("declared").to_pylist()):
                if d is not None:
                    seen = np.maximum(declared[d] - own[i], 0)
                    # add-one towards a declaration that says nothing
                    says[i] = np.log((seen + 1) / (np.maximum(total - own[i], 0) + len(declared) + 1))
            p = posterior(ll + np.log(prior) + says)
            best, text_best = p.argmax(axis=1), ll.argmax(axis=1)
            n = b.column("n_grams").to_pylist()
            cols = [
                pa.array([langs[i] for i in best], pa.string()),
                pa.array(p[np.arange(len(p)), best], pa.float64()),
                pa.array([langs[i] if m else None for i, m in zip(text_best, n, strict=True)], pa.string()),
            ]
            keep = [c for c in b.schema.names if c not in ("ll", "post", "suffix_sum", "domain_sum", "host_sum")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *cols], names=[*keep, "language", "confidence", "text_language"])

    return run


def identify(rows: DataFrame, labelled: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """``rows`` (key, text, declared, host, domain, suffix; the key of any type) without text, plus
    n_grams, language, confidence (of the fused posterior) and text_language (by text alone)."""
    langs, logp = fit_trigrams(labelled, sample_per_lang)
    base = rows.select("key", F.coalesce("text", F.lit("")).alias("text"), "declared", "host", "domain", "suffix")
    key = base.schema["key"].dataType.simpleString()
    head = f"key {key}, declared string, host string, domain string, suffix string, n_grams bigint"
    if not langs:
        n = base.mapInArrow(_score(logp), f"{head}, ll array<double>, post array<double>").drop("ll", "post")
        return n.select("*", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_language"))
    scored = written(base.mapInArrow(_score(logp), f"{head}, ll array<double>, post array<double>"), "lang-scores")
    voting = scored.where("n_grams > 0")
    shares = [F.sum(F.col("post")[i]) for i in range(len(langs))]
    totals = voting.agg(*[s.alias(f"s{i}") for i, s in enumerate(shares)]).first()
    total = np.array([x or 0.0 for x in totals])
    # a declaration outside the labelled languages is one class of its own, so the table is bounded
    named = F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("other"))
    scored, voting = scored.withColumn("declared", named), voting.withColumn("declared", named)
    declared = {k: np.zeros(len(langs)) for k in [*langs, "other"]}
    for r in voting.where("declared IS NOT NULL").groupBy("declared").agg(*[s.alias(f"s{i}") for i, s in enumerate(shares)]).collect():  # ≤ languages + 1 rows
        declared[r["declared"]] = np.array(r[1:])
    out = scored
    for level in ("host", "domain", "suffix"):
        level_sums = voting.where(F.col(level).isNotNull()).groupBy(level).agg(F.array(*shares).alias(f"{level}_sum"))
        out = out.join(level_sums, level, "left")
    out = out.select("key", "declared", "host", "domain", "suffix", "n_grams", "ll", "post", "host_sum", "domain_sum", "suffix_sum")
    return out.mapInArrow(_fuse(langs, total, declared), f"{head}, language string, confidence double, text_language string")


# ---------------------------------------------------------------- pages


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags removed, entities left to blanks."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>|&[a-zA-Z#0-9]{1,8};", " ")


def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence rows of ``pages`` (page_id, url, html)."""
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").alias("key"), page_text(F.col("html")).alias("text"), declared.alias("declared"), host.alias("host"))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = rows.select("key", "text", blank("declared").alias("declared"), blank("host").alias("host"))
    return rows.select(
        "*",
        F.substring_index("host", ".", -2).alias("domain"),
        F.substring_index("host", ".", -1).alias("suffix"),
    )


def document_evidence(docs: DataFrame) -> DataFrame:
    """Evidence rows of ``docs``: the lang column declares, the source is the host; no suffix."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").alias("key"), "text", F.lower("lang").alias("declared"), F.col("source").alias("host"), none.alias("domain"), none.alias("suffix"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = identify(page_evidence(pages), table(spark, sf_dir, "documents").select("text", "lang"))
    return found.select(F.col("key").alias("page_id"), "declared", "host", "n_grams", "language", "confidence", "text_language")
