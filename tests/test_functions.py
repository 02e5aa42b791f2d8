import os
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from lexikv.config import Config, ConfigError, parse_bool, parse_bytes, parse_config, parse_duration, parse_fraction, parse_train_mode
from lexikv.functions import header, incompressible, parse


def _frame(data, **options):
    return zstandard.ZstdCompressor(**{"write_checksum": False, "write_content_size": True, **options}).compress(data)


def _library_size(frame):
    """Content size by the library; None where it isn't known or the header is bad."""
    if len(frame) < 5:
        return None
    try:
        size = zstandard.frame_content_size(frame)
    except zstandard.ZstdError:
        return None
    return None if size < 0 else size


def test_header_edges(spark):
    head = bytes.fromhex("28B52FFD")
    cases = [b"", b"a", b"ab", b"ab" + head, b"\0\1" + _frame(b"x" * 10), b"\xff\xff" + _frame(b"y" * 300), b"\0\0" + _frame(b"z" * 70_000), b"\0\0" + _frame(b""), b"\0\1" + _frame(b"q" * 50, write_content_size=False),
             b"\0\1" + _frame(b"c" * 99, write_checksum=True), b"\0\1" + bytes.fromhex("502A4D1804000000") + b"abcd", b"\0\1" + head + b"\x08" + b"\0" * 12, b"raw text that is long enough to be one", b"\0\1" + head + b"\xe0" + b"\xff" * 7 + b"\x7f"]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)] + [(99, None)], "i int, v binary")
    out = {r.i: r for r in rows.select("i", header.is_encoded(F.col("v")).alias("e"), header.logical_length(F.col("v")).alias("n"), header.dict_id(F.col("v")).alias("d")).collect()}
    for i, c in enumerate(cases):
        size = _library_size(c[2:])
        assert out[i].e == (size is not None), c[:20]
        assert out[i].n == (len(c) if size is None else size), c[:20]
        assert out[i].d == (None if size is None else int.from_bytes(c[:2], "big"))
    assert (out[99].e, out[99].n, out[99].d) == (None, None, None)


def test_random_headers_agree_with_the_library(spark):
    rng = random.Random(4)
    cases = [bytes.fromhex("000128B52FFD") + rng.randbytes(rng.randint(0, 16)) for _ in range(4000)] + [rng.randbytes(rng.randint(0, 30)) for _ in range(500)]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, v binary")
    for r in rows.select("i", header.is_encoded(F.col("v")).alias("e"), header.logical_length(F.col("v")).alias("n")).collect():
        size = _library_size(cases[r.i][2:])
        assert r.e == (size is not None), cases[r.i].hex()
        if size is None or size < 2**63:
            assert r.n == (len(cases[r.i]) if size is None else size), cases[r.i].hex()


def test_lengths_need_no_python(spark):
    rows = spark.createDataFrame([(bytearray(b"x"),)], "v binary")
    plan = rows.select(header.logical_length(F.col("v")), header.stored_length(F.col("v")), header.split_stored(F.col("v")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


MAGICS = [(b"\x28\xb5\x2f\xfd", True), (b"\x1f\x8b\x08", True), (b"\x78\x01", True), (b"\x78\x9c", True), (b"\x78\xda", True), (b"\x78\x9d", False), (b"PK\x03\x04", True), (b"BZh9", True), (b"\xff\xd8\xff", True), (b"GIF89a", True), (b"RIFF....WEBP", True), (b"RIFF....WAVE", False), (b"....ftypisom", True), (b"%PDF-1", True), (b"plain", False), (b"", False)]


def test_magic(spark):
    rows = spark.createDataFrame([(i, bytearray(v)) for i, (v, _) in enumerate(MAGICS)], "i int, v binary")
    assert {r.i: r.m for r in rows.select("i", incompressible.has_magic(F.col("v")).alias("m")).collect()} == {i: m for i, (_, m) in enumerate(MAGICS)}


def test_incompressible_rule(spark):
    values = [(b"hello world " * 20, False), (os.urandom(512), True), (bytes(range(128, 256)) * 4, False), ("日本語テキスト".encode() * 30, False), (b"", True)]
    rows = spark.createDataFrame([(i, bytearray(v)) for i, (v, _) in enumerate(values)], "i int, v binary")
    assert {r.i: r.m for r in rows.select("i", incompressible.is_incompressible(F.col("v")).alias("m")).collect()} == {i: m for i, (_, m) in enumerate(values)}
    by_rows = {r.i: r.entropy for r in incompressible.byte_entropy(rows, "i", "v").collect()}
    for r in rows.select("i", incompressible.entropy_of(F.col("v")).alias("h")).collect():
        assert by_rows[r.i] == pytest.approx(r.h, abs=1e-9)


def test_value_parsers(spark):
    assert [parse_bytes(x) for x in ("1k", "1.5 MB", "2GiB", "7")] == [1024, 3 << 19, 2 << 30, 7]
    assert [parse_duration(x) for x in ("2h", "1.5m", "90", "3s")] == [7200, 90, 90, 3]
    assert [parse_bool(x) for x in ("Yes", "off", "1", "FALSE")] == [True, False, True, False]
    for f, bad in ((parse_bytes, "10x"), (parse_duration, "3d"), (parse_fraction, "1.1"), (parse_bool, "maybe"), (parse_train_mode, "slow"), (parse_fraction, "x")):
        with pytest.raises(ConfigError):
            f(bad)
    texts = ["1k", "1.5 MB", "2GiB", "10x", "2h", "1.5m", "3d", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parse.bytes_of(F.col("t")).alias("b"), parse.seconds_of(F.col("t")).alias("s")).collect()
    assert [r.b for r in sorted(rows)] == [1024, 3 << 19, 2 << 30, None, None, 3 << 19, None, None, None]
    assert [r.s for r in sorted(rows)] == [None, None, None, None, 7200, 90, None, None, None]


def test_config_text():
    text = "# all\nenable_comp=true\nDICT_SIZE = 1M # a\ncomp_level=3\nmin_comp_size=32\nmax_comp_size=256K\nretraining_interval=2h\newma_alpha=0.20\ntrain_mode=optimize\nspool_dir=/x/y\nenable_async_cmd=on\n"
    c = parse_config(text)
    assert (c.dict_size, c.max_comp_size, c.retraining_interval, c.ewma_alpha, c.train_mode, c.spool_dir, c.enable_async_cmd) == (1 << 20, 256 << 10, 7200, 0.2, "OPTIMIZE", "/x/y", True)
    assert parse_config("") == Config()
    for bad in ("nonsense=1", "comp_level=40", "max_comp_size=257K", "ewma_alpha=2", "no value", "min_comp_size=200K"):
        with pytest.raises(ConfigError):
            parse_config(bad)
    assert Config(min_comp_size=1).min_size == 32
    assert len(Config().entries()) == 28


def test_text_helpers(spark):
    row = spark.createDataFrame([("a, b,,c ", "/x/dict_42.bin", "2025-01-01T00:00:00Z", "2025-13-01T00:00:00Z")], "n string, p string, t string, bad string").select(
        parse.join_names(parse.split_names(F.col("n"))), parse.without_extension(parse.base_name(F.col("p"))), parse.time_text(parse.time_of(F.col("t"))), parse.time_of(F.col("bad"))
    ).first()
    assert tuple(row) == ("a,b,c", "dict_42", "2025-01-01T00:00:00Z", None)
