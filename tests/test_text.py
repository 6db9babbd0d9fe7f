from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from inkwell.functions import analysis, codecs, metadata, text
from inkwell.functions.scoring import bm25, bm25_terms, bm25_value

CASES = [
    ("Hello world", False, ["hello", "world"]),
    ("The quick brown fox", True, ["quick", "brown", "fox"]),
    ("A-1 bb, Ccc!", False, ["bb", "ccc"]),
    ("搜索引擎", False, ["搜索", "索引", "引擎"]),
    ("こんにちは", False, ["こん", "んに", "にち", "ちは"]),
    ("A中B文C", False, ["中", "文"]),
    ("Hello 世界", False, ["hello", "世界"]),
    ("Go 搜索 engine 引擎", False, ["go", "搜索", "engine", "引擎"]),
    ("The, A! 搜索-Engine", True, ["搜索", "engine"]),
    ("123, 中文, 45", True, ["123", "中文", "45"]),
    ("réaux 한국어 ｶﾅ", False, ["aux", "한국", "국어", "ｶﾅ"]),
    ("𠀀𠀁 ab", False, ["ab"]),
    ("...,,,!!!", True, []),
    ("", False, []),
    (None, False, []),
]


def test_terms_and_tokens(spark) -> None:
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, t string")
    got = rows.select("i", analysis.terms(F.col("t")).alias("a"), analysis.terms(F.col("t"), True).alias("b"), analysis.tokens(F.col("t")).alias("c"), analysis.tokens(F.col("t"), True).alias("d")).orderBy("i").collect()
    for r, (t, stop, want) in zip(got, CASES):
        assert (r.b if stop else r.a) == want, t
        assert [x.term for x in (r.d if stop else r.c)] == want, t
        assert [x.pos for x in (r.d if stop else r.c)] == list(range(len(want)))


def test_single_tokenizers(spark) -> None:
    r = spark.createDataFrame([("Go 搜索引 ab x",)], "t string").select(analysis.english_terms(F.col("t")).alias("e"), analysis.bigram_terms(F.col("t")).alias("b")).first()
    assert r.e == ["go", "ab"] and r.b == ["搜索", "索引"]


def test_offsets_are_utf16() -> None:
    assert analysis.analyze("A-1 bb, Ccc!")[0] == ("bb", 0, 4, 6)
    assert [(t.start, t.end) for t in analysis.analyze("The, A! 搜索-Engine", True)] == [(8, 10), (11, 17)]
    assert analysis.analyze("😀 ab")[0][2:] == (3, 5)


def test_stop_words() -> None:
    assert analysis.is_stop_word("The") and not analysis.is_stop_word("fox") and not analysis.is_stop_word(None) and not analysis.is_stop_word("")


PATHS = {"/a/Makefile": "makefile", "/a/.gitignore": "gitignore", "/a/a.": "a.", "/a/X.TAR.GZ": "gz", "/a.b/readme": "readme", "/a/Dockerfile": "dockerfile"}
TYPES = {"/r/App.java": "CODE", "/r/Dockerfile": "CONFIG", "/r/g.md": "DOC", "/r/t.csv": "DATA", "/r/x.bin": "OTHER", "/notes/n.md": "NOTE", "/notes/sub/m.txt": "NOTE", "/notes2/m.txt": "DOC"}


def test_extension_and_type(spark) -> None:
    rows = spark.createDataFrame([(p,) for p in [*PATHS, *TYPES]], "p string").withColumn("e", metadata.extension(F.col("p")))
    got = {r.p: r for r in rows.withColumn("t", metadata.document_type(F.col("p"), F.col("e"), ["/notes"])).withColumn("s", metadata.document_type(F.col("p"), F.col("e"), ["/notes/n.md"], strict=True)).collect()}
    assert {p: got[p].e for p in PATHS} == PATHS
    assert {p: got[p].t for p in TYPES} == TYPES
    assert got["/notes/n.md"].s == "NOTE" and got["/notes/sub/m.txt"].s == "DOC"


def test_bm25_properties(spark) -> None:
    assert bm25_value(0, 5, 10, 100, 50) == 0.0
    assert bm25_value(2, 10, 50, 100, 50) > bm25_value(1, 10, 50, 100, 50)
    assert bm25_value(2, 10, 20, 100, 50) > bm25_value(2, 10, 90, 100, 50)
    assert bm25_value(2, 1, 50, 1000, 100) > bm25_value(2, 500, 50, 1000, 100)
    assert bm25_value(1, 100, 50, 100, 50) > 0
    assert bm25_value(1, 500, 50, 100, 50) == bm25_value(1, 100, 50, 100, 50)
    want = math.log((100 - 10 + 0.5) / 10.5 + 1) * 5 * 2.2 / (5 + 1.2)
    assert math.isclose(bm25_value(5, 10, 50, 100, 50), want)
    assert math.isclose(bm25_terms([5, 3, 2], [10, 20, 30], 50, 100, 50), sum(bm25_value(t, d, 50, 100, 50) for t, d in zip([5, 3, 2], [10, 20, 30])))
    for bad in ((None, [1]), ([1], [1, 2])):
        with pytest.raises(ValueError):
            bm25_terms(*bad, 50, 100, 50)
    r = spark.range(1).select(bm25(F.lit(5), F.lit(10), F.lit(50), F.lit(100), F.lit(50.0)).alias("a"), bm25(F.lit(1), F.lit(1), F.lit(5), F.lit(0), F.lit(0.0)).alias("b"), bm25(F.lit(5), F.lit(10), F.lit(50), F.lit(100), F.lit(50.0), 2.0, 0.5).alias("c")).first()
    assert math.isclose(r.a, want) and math.isclose(r.b, bm25_value(1, 1, 5, 0, 0.0)) and math.isclose(r.c, bm25_value(5, 10, 50, 100, 50, 2.0, 0.5))


def test_helpers(spark) -> None:
    assert [text.format_bytes(n) for n in (0, 1023, 1024, 5 << 20, 3 << 30, 5 << 40)] == ["0 B", "1023 B", "1.00 KB", "5.00 MB", "3.00 GB", "5120.00 GB"]
    assert text.file_name_query('a"b\\c') == 'filename:"a\\"b\\\\c"'
    rows = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 5 << 20, 3 << 30)], "n long")
    assert [r[0] for r in rows.select(text.format_bytes_column(F.col("n"))).collect()] == ["0 B", "1023 B", "1.00 KB", "5.00 MB", "3.00 GB"]
    assert spark.createDataFrame([("\x1b[1;33mx\x1b[0m y",), (None,)], "t string").select(text.strip_ansi(F.col("t"))).collect() == [("x y",), ("",)]


def test_codecs() -> None:
    for v in (0, 1, 127, 128, 16383, 16384, 2**31 - 1):
        assert codecs.decode_varint(codecs.encode_varint(v)) == (v, codecs.varint_size(v))
    assert [codecs.varint_size(v) for v in (0, 127, 128, 16383, 16384, 2**31 - 1)] == [1, 1, 2, 2, 3, 5]
    assert codecs.decode_varlong(codecs.encode_varlong(2**63 - 1))[0] == 2**63 - 1
    assert codecs.delta_encode([10, 15, 20, 25, 30]) == [10, 5, 5, 5, 5]
    v = [1, 5, 5, 900, 100_000]
    assert codecs.decode_deltas(codecs.encode_deltas(v)) == v and codecs.deltas_size(v) == len(codecs.encode_deltas(v))
    assert codecs.check_crc(codecs.with_crc(b"abc")) == b"abc"
    assert codecs.skip_entries(list(range(0, 700, 2))) == [(256, 128), (512, 256)]
    for bad in (lambda: codecs.encode_varint(-1), lambda: codecs.encode_varint(2**31), lambda: codecs.decode_varint(b"\x80"), lambda: codecs.delta_encode([2, 1]), lambda: codecs.check_crc(b"abcd12345"), lambda: codecs.varint_size(-1)):
        with pytest.raises(ValueError):
            bad()


def test_array_codecs(spark) -> None:
    r = spark.createDataFrame([([3, 7, 7, 20],), ([],)], "a array<int>").select(codecs.delta_array(F.col("a")).alias("d"), codecs.undelta_array(codecs.delta_array(F.col("a"))).alias("u")).collect()
    assert r[0].d == [3, 4, 0, 13] and r[0].u == [3, 7, 7, 20] and r[1].d == []
