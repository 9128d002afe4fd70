"""MinHash components, suffix removal and fingerprints against brute force."""

import collections
import hashlib
import random

import corpus_pipeline
import numpy as np
import pytest

from yieldlens.llm import fingerprint, minhash, passages, suffixdedup


def _near_docs():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    docs = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE  two"), (None, "one two"), (1005, "one two three")]
    for g in range(6):
        base = [rng.choice(vocab) for _ in range(120)]
        docs.append((10 * g, " ".join(base)))
        for k in range(1, 7):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append((10 * g + k, " ".join(w)))
    docs.append((5, docs[8][1]))  # a doc_id met twice
    return docs


def test_components_match_all_pairs(spark):
    docs = _near_docs()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, kept string")
    got = sorted((tuple(r) for r in minhash.minhash_components(df).collect()), key=str)
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    want = []
    for (doc_id, _), s, c in zip(docs, sets, comp, strict=True):
        low = min((d for (d, _), x in zip(docs, comp, strict=True) if x == c and d is not None), default=None) if s else doc_id
        want.append((doc_id, len(s), low, low == doc_id))
    assert got == sorted(want, key=str)
    assert minhash.minhash_components(df.limit(0)).count() == 0


def test_links_lost_by_stars_are_found(spark, monkeypatch):
    """A chain whose ends share buckets with hubs that are like neither."""
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(500)]
    base = [rng.choice(vocab) for _ in range(400)]
    docs = []
    for k in range(60):
        w = list(base)
        for p in range(3 * k, 3 * k + 12):
            w[p * 2 % 400] = f"u{k}_{p}" if k % 2 else f"u{p}"
        docs.append((k, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK", 8)
    got = {r["doc_id"]: r["component_id"] for r in minhash.minhash_components(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    sets = [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for _, t in docs]
    comp = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    groups = collections.defaultdict(list)
    for i, c in enumerate(comp):
        groups[c].append(i)
    assert got == {i: min(g) for g in groups.values() for i in g}


def test_two_stage_order(monkeypatch):
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 200):
        for letters in (1, 2, 5):
            buf = rng.integers(97, 97 + letters, n).astype(np.uint8)
            text = buf.tobytes()
            want = sorted(range(n), key=lambda i: text[i:])
            assert suffixdedup.two_stage_order(buf, np.arange(n), n + 1).tolist() == want
            for at_once in (1, 2, 7):  # few at a time: runs of equal bytes are refined
                monkeypatch.setattr(suffixdedup, "SORTED_AT_ONCE", at_once)
                assert suffixdedup.sort_suffixes(buf, np.arange(n), n + 1).tolist() == want
            monkeypatch.undo()


@pytest.mark.parametrize("group_bytes", [8 << 20, 300])  # in one sort a key, and salted
def test_removed_bytes(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(suffixdedup, "GROUP_BYTES", group_bytes)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(30))
    docs = [(i, " ".join(word() for _ in range(30)) + passage[i : 60 + i] + word()) for i in range(25)]
    docs += [(40, passage), (41, passage), (42, None), (43, ""), (44, "z" * 300), (45, "short"), (45, "short"), (None, "ab" * 90)]
    length = 40
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, id string").drop("id")
    rows, kept = suffixdedup.remove_repeats(df, length)
    got = sorted((tuple(r) for r in rows.join(kept, "id").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    raw = [(t or "").encode() for _, t in docs]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    want = []
    for (doc_id, _), b in zip(docs, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone[-1:] = False
        left = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    assert got == sorted(want, key=str)
    empty, none = suffixdedup.remove_repeats(df.limit(0), length)
    assert empty.join(none, "id").count() == 0


def test_word_spans():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab\u00e9\u00a0\u2003\u3000\u2014 \n\x85x.,\u00df") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", "\u4f60\u597dab \u304b(c) --"]
    data = [t.encode() for t in texts]
    at = np.cumsum([0] + [len(b) for b in data])
    buf = np.frombuffer(b"".join(data), np.uint8)
    got = [bytes(buf[a:b]).decode() for a, b in zip(*passages.word_spans(buf, at), strict=True)]
    assert got == [w.strip(".,") or w for t in texts[:-1] for w in t.split()] + ["\u4f60", "\u597d", "ab", "\u304b", "c", "--"]
    assert passages.word_spans(buf[:0], at[:1])[0].size == 0


def _planted():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu\u00e9") for _ in range(rng.randint(2, 7)))
    own = lambda n: " ".join(word() for _ in range(n))
    docs, want = [], {}
    for i, n in enumerate([50, 51, 52, 60, 70, 200]):
        passage = own(n)
        for j, (pre, post) in enumerate([("", " "), ("(", ", ")]):
            a, b = own(30), own(40)
            docs.append((10 * i + j, f"{a} {pre}{passage}{post}{b}"))
            want[10 * i + j] = f"{a} {pre}{passage if n < 51 else ''}{post}{b}"
    twice = own(55)
    docs += [(100, f"{twice} middle {twice}"), (101, own(300)), (102, None), (103, "short"), (104, "ha " * 60)]
    want |= {100: " middle ", 101: docs[-4][1], 102: "", 103: "short", 104: " "}
    return docs, want


@pytest.mark.parametrize("group_bytes", [8 << 20, 300])  # in one sort a key, and salted
def test_passages_by_words(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(suffixdedup, "GROUP_BYTES", group_bytes)
    docs, want = _planted()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows, kept = passages.remove_passages(df)
    assert {r["doc_id"]: r["kept_text"] for r in rows.join(kept, "id").collect()} == want
    empty, none = passages.remove_passages(df.limit(0))
    assert empty.join(none, "id").count() == 0


def test_pipeline_stage_removes_short_passages(spark):
    docs, want = _planted()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeated_passages(spark, df, "").collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_entropy_and_likeness():
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 110, 600).astype(np.uint8)
    for i, c in enumerate(fingerprint.entropy_classes(buf).tolist()):
        _, n = np.unique(buf[i : i + 64], return_counts=True)
        assert abs(c - round(-(n / 64 * np.log2(n / 64)).sum() / 6 * 1023)) <= 1
    ranks = np.where((np.arange(1024) < 100) | (np.arange(1024) >= 990), 1024, np.arange(1024))
    a = bytes(rng.integers(97, 123, 6000).astype(np.uint8))
    b = bytes(rng.integers(97, 123, 6000).astype(np.uint8))
    da, db, dc, de = fingerprint.digests([a, b, a[:5000] + b[:1000], b""], ranks)
    assert fingerprint.likeness(da, da) == 1.0 and fingerprint.likeness(de, de) == 1.0 and fingerprint.likeness(da, de) == 0.0
    assert fingerprint.likeness(da, dc) > 0.6 > 0.2 > fingerprint.likeness(da, db)


def plain_digest(data: bytes, ranks) -> list[set]:
    """Chained filters (sets of bits) by loops over windows and neighbourhoods."""
    steps = fingerprint._entropy_steps().tolist()
    n = max(len(data) - 63, 0)

    def entropy_class(i: int) -> int:
        total = sum(sum(steps[1 : c + 1]) for c in collections.Counter(data[i : i + 64]).values())
        return int(np.clip(np.rint((6 - total / (2.0**32 * 64)) / 6 * 1023), 0, 1023))

    rank = [int(ranks[entropy_class(i)]) for i in range(n)]
    points = collections.Counter()
    span = min(64, n)
    for i in range(n - span + 1 if n else 0):
        best = min(range(i, i + span), key=lambda j: (rank[j], j))
        points[best] += 1
    need = min(16, max(1, (n - 64) // 8))
    chosen = [j for j in sorted(points) if rank[j] < 1024 and points[j] >= need]

    def mix(x: int) -> int:
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x ^= x >> 33
            x = x * m % 2**64
        return x ^ x >> 33

    features = []
    for j in chosen:
        h = 0
        for k in range(0, 64, 8):
            h = mix((h * 0x9E3779B97F4A7C15 + int.from_bytes(data[j + k : j + k + 8], "little")) % 2**64)
        features.append([h >> 11 * k & 2047 for k in range(5)])
    if not features and data:
        d = hashlib.sha1(data).digest()
        features = [[int.from_bytes(d[2 * k : 2 * k + 2], "little") & 2047 for k in range(5)]]
    return [{b for f in features[k : k + 160] for b in f} for k in range(0, len(features), 160)]


def plain_likeness(a: list[set], b: list[set]) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a

    def score(x: set, y: set) -> float:
        chance, most = len(x) * len(y) / 2048, min(len(x), len(y))
        return min(max((len(x & y) - chance) / (most - chance), 0), 1) if most > chance else 0.0

    return sum(max(score(x, y) for y in b) for x in a) / len(a)


def test_fingerprints_against_loops():
    rng = random.Random(12)
    texts = ["".join(rng.choices("abcdefghij klmnopé", k=rng.choice((0, 3, 63, 64, 65, 100, 130, 200, 500)))).encode() for _ in range(40)]
    texts += [texts[-1][: len(texts[-1]) * 3 // 4] + texts[0][:40], b"a" * 300, bytes(range(256)), texts[5], b"ab" * 40, "".join(rng.choices("abcdefghijklmnop", k=30000)).encode()]
    counts = np.bincount(np.concatenate([fingerprint.entropy_classes(np.frombuffer(t, np.uint8)) for t in texts]), minlength=1024)
    ranks = np.empty(1024, np.int32)
    ranks[np.lexsort((np.arange(1024), counts))] = np.arange(1024)
    ranks[:100] = ranks[990:] = 1024
    got = fingerprint.digests(texts, ranks)
    want = [plain_digest(t, ranks) for t in texts]
    assert max(map(len, want)) > 1
    for g, w in zip(got, want, strict=True):
        assert [set(np.flatnonzero(f).tolist()) for f in g] == w
    for i in range(len(texts)):
        j = rng.randrange(len(texts))
        assert abs(fingerprint.likeness(got[i], got[j]) - plain_likeness(want[i], want[j])) < 1e-6
    assert abs(fingerprint.likeness(got[39], got[40]) - plain_likeness(want[39], want[40])) < 1e-6


def test_fingerprint_rows(spark):
    rng = random.Random(1)
    texts = [None, "", "short", "short"] + ["".join(rng.choice("abcdé fgh") for _ in range(rng.randint(1, 900))) for _ in range(60)]
    docs = [(3 * i, t, "x") for i, t in enumerate(texts)] + [(None, "first", None)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, fingerprint string")
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(df).collect()}
    order = sorted(((d, t or "") for d, t, _ in docs), key=lambda x: (x[0] is not None, x[0]))
    assert len(got) == len(docs)
    for (d, t), (_, nxt) in zip(order, [*order[1:], order[0]], strict=True):
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
    assert got[6]["fingerprint"] == got[9]["fingerprint"]
    assert fingerprint.fingerprints(df.limit(0)).count() == 0
    assert fingerprint.fingerprints(df.where("doc_id = 6")).first()["near_next"] == 1.0


def test_one_row_of_each_group_stays(spark):
    """Shared and null doc_ids: rows are told apart by their key, one of each group stays."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(0, 5, a), (1, 5, b), (2, 3, b), (3, 9, a + " end"), (4, None, a), (5, None, "x y z"), (6, None, "x y z"), (7, None, "x y z"), (8, 1, ""), (9, None, None), (10, 7, "alone here"), (11, 5, b)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "row bigint, doc_id bigint, text string, component string").drop("component")
    marks = minhash.near_duplicate_rows(df, "row", 80).collect()
    assert {r["row"] for r in marks if not r["stays"]} == {3, 4, 1, 11, 6, 7}
    assert {r["row"] for r in marks if r["stays"]} == {0, 2, 5} and {r["copies"] for r in marks} == {1}
    equal = df.where("row IN (1, 11)").selectExpr("doc_id AS row", "doc_id", "text")
    assert [(r["copies"], r["stays"]) for r in minhash.near_duplicate_rows(equal, "row", 80).collect()] == [(2, True)]
    assert minhash.near_duplicate_rows(df.limit(0), "row", 80).count() == 0


def test_merged_components(spark):
    comps = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node bigint, comp bigint")
    links = spark.createDataFrame([(2, 6), (9, 20), (30, 31), (1, 2)], "a bigint, b bigint")
    got = {r["node"]: r["comp"] for r in minhash.merged_components(comps, links).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8, 20: 8, 30: 30, 31: 30}
    none = minhash.merged_components(comps, links.limit(0)).collect()
    assert {r["node"]: r["comp"] for r in none} == {1: 1, 2: 1, 5: 5, 6: 5, 8: 8, 9: 8}


def test_fingerprints_of_many_rows_without_or_with_one_id(spark):
    """Null and repeated doc_ids are split over ranges; every row meets the next one in (doc_id, text hash) order."""
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randint(1, 40)))
    rows = [(None, text()) for _ in range(30)] + [(7, text()) for _ in range(40)] + [(k, text()) for k in range(20)] + [(3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    tie = {r["text"]: r["h"] for r in df.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()}
    order = sorted(((d is not None, d or 0, tie[t or ""], t or "") for d, t in rows))
    want = []
    for (known, d, _, t), (*_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t) // 4
        want.append((d if known else None, len(t), hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprint.fingerprints(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_planted_passages_of_400_bytes_are_all_caught(spark):
    """Recall 1.00 on passages of 400 bytes or more planted in two documents each; shorter ones and
    clean documents are left alone."""
    rng = random.Random(21)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=n))
    docs, planted = [], {}
    for k in range(30):
        passage = text(rng.randint(400, 900) if k < 20 else rng.randint(200, 399))
        for copy in range(2):
            before = text(rng.randint(0, 500)) + "#" * (k % 3 + copy)
            docs.append((2 * k + copy, before + passage + "!" + text(rng.randint(0, 500))))
            planted[2 * k + copy] = len(passage) if k < 20 else 0
    docs += [(100 + k, text(2000)) for k in range(20)]
    rows, kept = suffixdedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string"))
    got = {r["doc_id"]: r["n_removed"] for r in rows.join(kept, "id").collect()}
    assert all(got[d] >= n for d, n in planted.items() if n)  # the bytes next to a passage may agree by chance
    assert all(got[d] <= n + 4 for d, n in planted.items()) and all(got[100 + k] == 0 for k in range(20))
