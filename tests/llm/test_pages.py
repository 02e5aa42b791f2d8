import base64
import gzip
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexikv.llm import topk, urls, warc

RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/"), urls.Rule("block", "a.org", "/x"), urls.Rule("block", "same.io", "/"), urls.Rule("allow", "same.io", "/")]
CASES = [
    ("http://x.net/a", "net/"), ("http://x.net", None), ("HTTPS://WWW.Example.NET/en/1?q", "example.net/en/"), ("http://example.net/en", "net/"), ("http://notexample.com/de/1", None), ("http://m.example.com/de/", "example.com/de/"),
    ("http://example.com/DE/", None), ("http://o.org/fr/a/b", "org/fr/"), ("http://a.org/xyz", "a.org/x"), ("http://a.org/fr/x", "org/fr/"), ("http://b.a.org/x/y", "a.org/x"), ("net/abc", None), (None, None), ("", None), ("http://net/", "net/"),
    ("http://x.net:80/a", None), ("//x://y.net/z#f", "net/"), ("http://same.io/q", "same.io/"), ("http:///path", None), ("http://x\n.net/a", "net/"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "old", "old") for i, (u, _) in enumerate(CASES)], "page_id long, url string, host string, rule string")
    out = {r.page_id: r for r in urls.filter_urls(df, RULES).collect()}
    for i, (url, rule) in enumerate(CASES):
        r = out[i]
        want = next((x for x in RULES if x.text == rule), None)
        verdict = "block" if rule == "same.io/" else want.verdict if want else "allow"
        assert (r.rule, r.verdict) == (rule, verdict), url
    assert (out[2].host, out[2].path) == ("www.example.net", "/en/1")
    assert (out[16].host, out[16].path) == ("y.net", "/z")
    assert {r.verdict for r in urls.filter_urls(df, [], default="block").collect()} == {"block"}
    assert urls.filter_urls(df.limit(0), RULES).count() == 0
    with pytest.raises(ValueError, match="at most"):
        urls.UrlTrie([urls.Rule("allow", "a", "/")] * (urls.MAX_RULES + 1))


PAGES = [(1, "http://a/1", "x" * 1500), (2, "http://a/2", "x" * 1500), (3, None, "x" * 1500), (3, None, "x" * 1500), (4, "u\r\nv", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", "n" * 2000), (None, "u", "n" * 2000), (8, "u", "é" * 500), (9, "u", "é" * 500), (10, "u", "y" * 300_000)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, first string, revisit int")
    files = warc.write_archives(df.repartition(3))
    out = warc.read_archives(files, with_payload=True).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        first = max((j for j, _, h in PAGES if h == html and j is not None), default=None) if len(data) >= 1000 else None
        revisit = first is not None and i != first
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else data))
    assert sorted(key((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in out) == sorted(map(key, want))
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_reader_checks():
    good = warc.record(1, "http://a/", b"payload", hashlib.sha1(b"payload").hexdigest())
    read = lambda data: list(warc.read_records(pa.BufferReader(data)))
    (r,) = read(good)
    assert warc.split_http(r.block)[1] == b"payload"
    assert len(read(good * 3)) == 3
    assert base64.b32decode(r.headers["warc-payload-digest"][5:]).hex() == hashlib.sha1(b"payload").hexdigest()
    plain = gzip.decompress(good)
    for bad in (good[:-9], gzip.compress(plain.replace(b"Content-Length: 8", b"Content-Length: 9")) if b"Content-Length: 8" in plain else gzip.compress(plain + b"x"), gzip.compress(b"nothing"), b"not gzip"):
        with pytest.raises(warc.WarcError):
            read(bad)


def test_warc_digest_mismatch(spark, tmp_path):
    (tmp_path / "bad.warc.gz").write_bytes(warc.record(1, "u", b"payload", hashlib.sha1(b"other").hexdigest()))
    files = spark.createDataFrame([(f"file://{tmp_path}/bad.warc.gz",)], "path string")
    with pytest.raises(Exception, match="another payload"):
        warc.read_archives(files).collect()


def test_top_k(spark):
    vectors = [(i, [((i * 7 + j) % 11 - 5) / 9 for j in range(4)]) for i in range(60)]
    vectors += [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [1.0, float("nan"), 0.0, 0.0]), (63, [float("inf"), 0.0, 0.0, 0.0]), (64, [1.0, 1.0]), (None, [1.0, 0.0, 0.0, 0.0]), (0, vectors[0][1]), (65, [3e38, 1.0, 0.0, 0.0]), (66, [1e15, 3.0, 1.0, 0.0]), (67, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, rank int, score int")
    out = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, tile_queries=3, tile_vectors=7).collect()
    import math

    good = [(k, i, [math.floor(256 * x) for x in v]) for k, (i, v) in enumerate(vectors) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for k, i, q in good:
        if i % 10 == 0:
            dots = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for m, j, v in good if m != k and len(v) == len(q))[:5]
            want += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(dots)]
    assert sorted(map(tuple, out)) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_long_segments_cost_no_prefixes():
    import time

    trie = urls.UrlTrie([*RULES, urls.Rule("allow", "net", "/ab"), urls.Rule("block", "net", "/abc/d")])
    assert trie.find("x.net", "/abc/dx").text == "net/abc/d"
    began = time.perf_counter()
    assert trie.find("x.net", "/" + "a" * 5_000_000).text == "net/"
    assert trie.find("x.net", "/ab" + "/" * 100_000).text == "net/ab"
    assert time.perf_counter() - began < 2


def test_archives_are_rolled_by_size(spark):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 200) for i in range(40)] + [(None, None, None)] * 3, "page_id long, url string, html string").repartition(2)
    files = warc.write_archives(df, archive_bytes=2000)
    assert files.count() > 4
    assert files.agg(F.sum("n_records")).first()[0] == 43
    assert sorted(str(r.page_id) for r in warc.read_archives(files).collect()) == sorted([*map(str, range(40)), *["None"] * 3])
    from lexikv.llm.files import open_read

    ids, kinds = [], []
    for r in files.collect():
        with open_read(r.path) as source:
            for headers, _ in warc.read_records(source):
                ids.append(headers["warc-record-id"])
                kinds.append(headers["warc-type"])
    assert len(set(ids)) == len(ids)
    assert kinds.count("warcinfo") == files.count()
