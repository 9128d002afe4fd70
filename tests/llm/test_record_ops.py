"""Language ID, sharding, WARC, licences and the pipeline."""

import gzip
import hashlib
import io

import corpus_pipeline
from pyspark.sql import functions as F
from yieldlens.llm import langid, licenses, sharding, warc
from yieldlens.llm.common import shared_path
from yieldlens.session import table

SF = "/root/testdata/sf0.001"


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    # no declaration or host: text alone, on rows the model has not seen
    rows = langid.document_evidence(docs.where(fold)).withColumn("declared", F.lit(None).cast("string")).withColumn("host", F.lit(None).cast("string"))
    found = langid.identify(rows, docs.where(~fold).select("text", "lang")).join(docs, F.col("key") == F.col("doc_id"))
    right, n = found.agg(F.sum((F.col("language") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n > 0.97


def test_other_evidence_decides_without_text(spark):
    fr, en = "le la les une des est et dans pour avec " * 4, "the of and to in is that it was for with " * 4
    labelled = spark.createDataFrame([(fr, "fr"), (en, "en"), (None, "en"), (fr, None)], "text string, lang string")
    pages = [(i, f"http://a.example.fr/{i}", f"<html lang='fr'><p>{fr}</p></html>") for i in range(12)]
    pages += [(20 + i, f"http://b.example.com/{i}", f"<html lang=en><script>{fr}</script><p>{en}</p></html>") for i in range(12)]
    pages += [(40, "http://a.example.fr/x", None), (41, "http://other.example.fr/", ""), (42, None, "<html lang='en'></html>"), (43, None, None), (43, None, None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("language", F.lit("clash"))
    got = {r["key"]: r for r in langid.identify(langid.page_evidence(df), labelled).collect()}
    assert [got[k]["language"] for k in (0, 20, 40, 41, 42)] == ["fr", "en", "fr", "fr", "en"]
    assert got[43]["n_grams"] == 0 and got[43]["language"] in ("en", "fr")
    assert langid.identify(langid.page_evidence(df), labelled.limit(0)).where("language IS NOT NULL").count() == 0
    assert langid.identify(langid.page_evidence(df.limit(0)), labelled).count() == 0


def test_shard_table():
    shards = [f"s{i}" for i in range(7)]
    full = sharding.fill_table(shards, 701)
    sizes = [full.count(k) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1
    less = sharding.fill_table(shards[:-1], 701)  # the last shard leaves
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 6)
    assert moved < 0.15 * 701


def test_fill_against_turns_written_out():
    """Each shard's whole preference list, turn after turn."""
    for shards, slots in (([f"s{i}" for i in range(5)], 53), (["only"], 7), ([f"x{i}" for i in range(11)], 11), (sharding.SHARDS, sharding.SLOTS)):
        lists = []
        for s in shards:
            d = hashlib.md5(s.encode()).hexdigest()
            offset, skip = int(d[:8], 16) % slots, int(d[8:16], 16) % (slots - 1) + 1
            order = [(offset + j * skip) % slots for j in range(slots)]
            assert len(set(order)) == slots  # a permutation, as the size is prime
            lists.append(iter(order))
        taken = {}
        while len(taken) < slots:
            for k, prefers in enumerate(lists):
                if len(taken) < slots:
                    taken[next(x for x in prefers if x not in taken)] = k
        assert sharding.fill_table(shards, slots) == [taken[i] for i in range(slots)]


def test_placement(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (7, None)], "k bigint, shard string")
    rows = {(r["k"], r["slot"], r["shard"]) for r in sharding.place(df, "k", sharding.SHARDS, sharding.SLOTS).collect()}
    filled = sharding.fill_table(sharding.SHARDS, sharding.SLOTS)
    for k, slot, shard in rows:
        want = int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:8], 16) % sharding.SLOTS
        assert (slot, shard) == (want, sharding.SHARDS[filled[want]])
    assert len(rows) == 3 and sharding.place(df.limit(0), "k", ["a"], 3).count() == 0


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 300
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "http://b/3", "small"), (4, "http://b/4", "small"), (5, "http://b/5", None), (None, "http://b/6", big)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash"))
    path = shared_path(spark, "warc-test")
    warc.write_warc(warc.records_of(df), path, maxfilebytes=3000)
    got = {r["page_id"]: r for r in warc.read_warc(spark, path).collect()}
    assert len(got) == 7
    for page, url, html in pages:
        data = (html or "").encode()
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"], r["target_uri"]) == (len(data), hashlib.sha1(data).hexdigest(), url)
        revisit = html == big and page != 9
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else data)
    # the files are members of gzip themselves, which other tools read
    store, root = warc._store(path)
    files = [f.path for f in store.get_file_info(warc.fs.FileSelector(root)) if f.path.endswith(".warc.gz")]
    assert files and all(gzip.decompress(store.open_input_stream(f, compression=None).read()).startswith(b"WARC/1.1\r\n") for f in files)
    pushed = warc.read_warc(spark, path, payload="false").where("record_type = 'response' AND target_uri LIKE 'http://b%'")
    assert sorted(r["page_id"] for r in pushed.collect()) == [3, 4, 5]
    assert all(r["payload"] is None for r in pushed.collect())
    empty = shared_path(spark, "warc-test")
    warc.write_warc(warc.records_of(df.limit(0)), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_members_are_plain_gzip():
    data = b"x" * 200_000
    one = warc.pack_record(1, "http://a", "response", None, data, len(data), hashlib.sha1(data).hexdigest())
    assert data in gzip.decompress(one)
    # a member without the length field is read through
    other = gzip.compress(gzip.decompress(one))
    rows = list(warc.read_records(io.BytesIO(one + other + one), lambda h: True, True))
    assert [r[-1] for r in rows] == [data] * 3
    assert len(list(warc.read_records(io.BytesIO(other + one + other), lambda h: h["record_type"] == "revisit", True))) == 0


def test_warc_extra_field_ends_where_it_says():
    """Bytes of the packed data that look like a length field are not read as one."""
    rows = [(k, hashlib.sha1(str(k).encode()).digest() * 9 + b"sl\x08\x00") for k in range(3000)]
    packed = b"".join(warc.pack_record(k, None, "response", None, d, len(d), hashlib.sha1(d).hexdigest(), level=0) for k, d in rows)
    assert [(r[0], r[-1]) for r in warc.read_records(io.BytesIO(packed), lambda h: True, True)] == rows
    assert len(list(warc.read_records(io.BytesIO(packed), lambda h: h["page_id"] == 7, False))) == 1


def test_license_forms(spark):
    mit = licenses.KNOWN["MIT"]
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + mit.upper()), (2, mit.replace(" ", "\n  ") + "\nAll rights reserved."), (3, mit + " and more"), (4, None), (5, ""), (6, "Released under the MIT Licence!"), (6, "Released under the MIT Licence!"), (None, licenses.KNOWN["Zlib"].replace("acknowledgment", "acknowledgement"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("license", F.lit("clash"))
    got = sorted(((r["doc_id"], r["license"]) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "MIT-notice"), (6, "MIT-notice"), (None, "Zlib")], key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_titles_texts_and_signs(spark):
    mit, bsd = licenses.KNOWN["MIT"], (licenses.TEXTS / "BSD-3-Clause.txt").read_text()
    text = lambda name: (licenses.TEXTS / f"{name}.txt").read_text()
    whole = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    cases = [(text(n), n) for n in whole]
    cases += [
        ("MIT License\n\nCopyright (c) 2020 Somebody\n\n" + mit, "MIT"),
        ("The MIT License (MIT)\r\n\r\nCopyright \u00a9 2020 Somebody\r\n\r\n" + mit.replace("\n", "\r\n"), "MIT"),
        ("ISC License\n\nCopyright <year> <holder>\n\n" + licenses.KNOWN["ISC"], "ISC"),
        ("zlib License\n\nCopyright Jane Doe 2020\n\n" + licenses.KNOWN["Zlib"], "Zlib"),
        ("BSD Zero Clause License\n\nCopyright Jane Doe\n\n" + licenses.KNOWN["0BSD"], "0BSD"),
        (mit.replace('"Software"', "\u201cSoftware\u201d").replace('"AS IS"', "\u201cAS\u00a0IS\u201d").replace(", and", "\u2014and"), "MIT"),
        ("\u2022 " + licenses.KNOWN["Zlib"].replace("'as-is'", "\u2018as\u2011is\u2019"), "Zlib"),
        ("BSD 3-Clause License\n\nCopyright [2020] [Org]\n\n" + bsd.replace("the copyright holder nor the names of its", "Example Org nor the names of its"), "BSD-3-Clause"),
        (text("Apache-2.0").partition("END OF TERMS")[0], "Apache-2.0"),
        (text("GPL-2.0").replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA"), "GPL-2.0"),
        ("MIT License and more\n\n" + mit, None),
        (text("GPL-3.0") + "\nwith an exception", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(df).collect()}
    assert got == {i: name for i, (_, name) in enumerate(cases)}


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents").limit(60).unionByName(spark.createDataFrame([(900001, "12 34 !", "en", "s", 7), (900002, None, "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    bench = table(spark, SF, "benchmark").first()["text"]
    docs = docs.unionByName(spark.createDataFrame([(900003, "intro words " + bench, "en", "s", 1)], docs.schema))
    ids = {r["doc_id"] for r in docs.collect()}
    known = corpus_pipeline.language_id(spark, docs, SF)
    assert known.columns == docs.columns and ids - {r["doc_id"] for r in known.collect()} == {900001, 900002}
    clean = corpus_pipeline.benchmark_free(spark, known, SF)
    assert clean.columns == docs.columns and 900003 not in {r["doc_id"] for r in clean.collect()}
    assert corpus_pipeline.repeated_passages(spark, clean.limit(20), SF).columns == docs.columns
    assert corpus_pipeline.token_ids(spark, clean.limit(5), SF).count() == 5


def test_warc_archives_of_other_tools(spark, tmp_path):
    """No manifest, foreign ids, no HTTP length, no or other digests, records without HTTP."""
    body = b"<html>x</html>"

    def record(*head, block=b""):
        lines = b"\r\n".join([b"WARC/1.0", *head, b"Content-Length: %d" % len(block)])
        return gzip.compress(lines + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    uuid = b"<urn:uuid:6f2d0a3c-0b6a-4c5e-9d0b-1c2d3e4f5a6b>"
    parts = [
        record(b"WARC-Type: warcinfo", b"WARC-Record-ID: " + uuid, block=b"software: other\r\n"),
        record(b"WARC-Type: response", b"WARC-Record-ID: " + uuid, b"WARC-Target-URI: http://a/", b"Content-Type: application/http; msgtype=response", block=http),
        record(b"WARC-Type: revisit", b"WARC-Record-ID: <urn:page:x>", b"WARC-Refers-To: " + uuid, b"WARC-Payload-Digest: md5:00", b"Content-Type: application/http", block=b"HTTP/1.1 200 OK\r\n\r\n"),
        record(b"WARC-Type: response", b"WARC-Record-ID: <urn:page:7>", b"WARC-Payload-Digest: sha1:" + hashlib.sha1(b"dns").hexdigest().upper().encode(), b"Content-Type: text/dns", block=b"dns"),
        record(b"WARC-Type: revisit", b"WARC-Record-ID: <urn:page:8>", b"WARC-Payload-Digest: sha1:!!"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    got = [tuple(r) for r in warc.read_warc(spark, str(tmp_path)).select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload").collect()]
    assert got == [
        (None, "warcinfo", None, None, None, None),
        (None, "response", None, len(body), hashlib.sha1(body).hexdigest(), body),
        (None, "revisit", None, None, None, None),
        (7, "response", None, 3, hashlib.sha1(b"dns").hexdigest(), b"dns"),
        (8, "revisit", None, None, None, None),
    ]
    (tmp_path / "a.warc.gz").unlink()
    assert warc.read_warc(spark, str(tmp_path)).count() == 0


def test_language_sample_is_strict_and_leaves_no_language_out(spark):
    """Thousands of copies of the only French text: it is drawn once, and English keeps its bound."""
    fr, en = "le la les une des est et dans pour avec " * 3, "the of and to in is that it was for with "
    rows = [(fr, "fr")] * 3000 + [(f"{en} {i}", "en") for i in range(300)]
    labelled = spark.createDataFrame(rows, "text string, lang string")
    for bound in (1, 10, 1000):
        langs, logp = langid.fit_trigrams(labelled, bound)
        assert langs == ["en", "fr"]
        # a language without a sample would be flat
        assert all(row.max() - row.min() > 1 for row in logp)
    found = langid.identify(langid.document_evidence(labelled.limit(1).selectExpr("1 AS doc_id", "text", "lang", "'s' AS source")), labelled, 10)
    assert found.first()["text_language"] == "fr"


def test_pipeline_judges_rows(spark):
    """Rows that share a doc_id or have none stay or go each for itself."""
    fr = " ".join(f"le mot{i} est dans la maison" for i in range(20))
    en = " ".join(f"the word{i} is in that house" for i in range(20))
    rows = [(5, en, "en", "s", 1), (5, "", "en", "s", 0), (None, fr, "fr", "s", 2), (None, fr, "fr", "s", 2), (None, "123", "fr", "s", 3), (9, en, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"][:3]) if r["doc_id"] else (0, r["text"][:3]) for r in kept.collect()) == [(0, "le "), (0, "le "), (5, "the"), (9, "the")]
    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    assert sorted((r["doc_id"] or 0) for r in one.collect()) == [0, 5]
    for stage in (corpus_pipeline.language_id, corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages, corpus_pipeline.benchmark_free):
        assert stage(spark, docs.limit(0), SF).count() == 0
