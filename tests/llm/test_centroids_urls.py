"""Integer k-means and the URL filter against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from yieldlens.llm import centroids, urlfilter


def plain_kmeans(rows, k, rounds, dim, scale):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dim and all(e is not None and math.isfinite(e) for e in x):
            kept.append((vec_id, [math.floor(scale * float(e)) for e in x]))
    order = sorted((hashlib.sha256(f"2:{v}".encode()).hexdigest(), np.array(x, "<i4").tobytes().hex().upper(), x) for v, x in kept if v is not None)
    cs = [x for _, _, x in order[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        mine = [near(x)[1] for _, x in kept]
        cs = [
            [sum(col) // len(col) for col in zip(*[x for (_, x), m in zip(kept, mine, strict=True) if m == j], strict=True)] if j in mine else c
            for j, c in enumerate(cs)
        ]
    out = [(v, *near(x)) for v, x in kept] if cs else []
    total = sum(d for _, d, _ in out)
    return [(v, j, d, sum(e for _, e, i in out if i == j), total, hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for v, d, j in out]


def vectors(n, dim, seed):
    random.seed(seed)
    middles = [[random.uniform(-1, 1) for _ in range(dim)] for _ in range(4)]
    rows = [(k, [m + random.gauss(0, 0.1) for m in random.choice(middles)]) for k in range(n)]
    same = [(n + k, rows[0][1]) for k in range(n // 2)]  # a hot group of equal vectors
    bad = [(7, None), (8, []), (9, [0.0] * (dim - 1)), (10, [float("nan")] * dim), (11, [float("inf")] + [0.0] * (dim - 1)), (12, [None] + [0.0] * (dim - 1))]
    return rows + same + bad + [(3, rows[3][1]), (3, [0.5] * dim), (None, [0.25] * dim), (None, rows[1][1])]


@pytest.mark.parametrize(("n", "dim", "k", "lead"), [(150, 6, 7, 2), (150, 6, 7, 6), (4, 5, 40, 3), (60, 8, 5, 0)])
def test_kmeans_against_plain(spark, n, dim, k, lead):
    rows = vectors(n, dim, n + lead)
    df = spark.createDataFrame([(v, x, "clash", 1) for v, x in rows], "vec_id bigint, embedding array<double>, cluster string, distance int").repartition(5)
    got = centroids.with_inertia(*centroids.cluster(df, k=k, rounds=3, dim=dim, scale=16, lead=lead))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_kmeans(rows, k, 3, dim, 16), key=str)


def test_kmeans_empty_and_all_bad(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None), (2, [1.0])], [(None, [0.5] * 64)]):
        assert centroids.with_inertia(*centroids.cluster(spark.createDataFrame(rows, schema))).count() == 0


def test_kmeans_out_of_range(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.cluster(df)


def test_filter_is_exact_and_filters():
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 300, (40, 64))
    v = np.floor(middles[rng.integers(0, 40, 2000)] + rng.normal(0, 30, (2000, 64))).astype(np.int64)
    c = np.floor(middles).astype(np.int64)
    c[11] = c[3]  # a tie
    _, axes = np.linalg.eigh(np.cov(v.T))
    axes = np.ascontiguousarray(axes[:, ::-1])
    near = centroids.Filter(c, axes, 16)
    got, d = near.nearest(v, *centroids._rotated(v, axes, 16))
    full = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (got == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
    assert near.verified < near.pairs / 10


def plain_url(url, rules, terms):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = min(fit, key=lambda r: (-len(r.text), r.text)) if fit else None
    low = re.sub("%[0-9a-f]{2}", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or ""))

    def count(words):
        return sum(bool(re.search(f"(?<![a-z]){w}(?![a-z])", low)) for w in words)

    strict = count(set(terms.strict))
    soft = count(set(terms.soft) - set(terms.strict))
    verdict = rule.action if rule else "block" if strict or soft >= terms.need else "allow"
    return host, path, rule.text if rule else None, verdict, strict, soft


URLS = [
    None, "", "no scheme porn", "http://", "http://net/", "http://net", "http://a.net", "http://a.NET/", "http://x.example.net/en/1", "http://example.net/en",
    "http://badexample.net/en/", "http://example.com/de/x", "http://www.example.com/de", "http://a.org/fr/?q", "http://a.org?x=/fr/", "http://sussex.example.org/adult",
    "http://porn.example.org/", "http://xxx/", "http://a/x%20xxx%2fy", "http://a/sexxx", "http://casino-win.example.org/", "http://a/casino/casino", "http://a/poker?bonus=9",
    "http://A/PoRn", "http://a/pornographic", "http://é.example.net/en/é", "x://y://z.net/en/", "http://a:80/b#c/d", "http://u@b.example.com/de/\n\r", "http://a/kasino_bet_é_slots",
    "http://a/" + "x" * 20000 + "/poker/slots", "http://a.net./", "ftp://ÀÉ.ORG/fr/", "http://a/%2", "http://a/%zzporn",
]


def test_urls_against_plain_and_sql(spark):
    import duckdb

    rules, terms = urlfilter.RULES, urlfilter.TERMS
    random.seed(13)
    parts = ["http", "://", "a.", "net", "example.", "org", "com", "/", "/en/", "/de/", "/fr/", "?", "#", *terms.strict[:4], *terms.soft[:6], "-", "9", "%20", "z"]
    urls = URLS + ["".join(random.choices(parts, k=random.randint(1, 14))) for _ in range(1500)]
    rows = [(k, u) for k, u in enumerate(urls)] + [(1, "http://a.net/"), (None, "http://porn/"), (None, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, host string")
    got = sorted(map(tuple, urlfilter.judge_urls(df).collect()), key=str)
    assert got == sorted([(p, *plain_url(u, rules, terms)) for p, u in rows], key=str)
    con = duckdb.connect()
    pages = df.toPandas()  # noqa: F841
    assert sorted(con.sql(urlfilter.OP13_SQL).fetchall(), key=str) == got
    assert urlfilter.judge_urls(df.limit(0)).count() == 0
    assert {g[4] for g in got} == {"allow", "block"}


def test_own_rules_and_terms(spark):
    df = spark.createDataFrame([(1, "http://b.a.x/y/z"), (2, "http://c.x/y/z"), (3, "http://q/w1/w2"), (4, "http://q/w1")], "page_id bigint, url string")
    rules = (urlfilter.Rule("block", "x", "/y/z"), urlfilter.Rule("allow", "a.x", "/y"))
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge_urls(df, rules, urlfilter.Vocabulary((), ("ww", "w1", "w2"), 2)).collect()}
    assert out == {1: ("a.x/y", "allow"), 2: ("x/y/z", "block"), 3: (None, "block"), 4: (None, "allow")}
    assert {r["verdict"] for r in urlfilter.judge_urls(df, (), urlfilter.Vocabulary((), ())).collect()} == {"allow"}
