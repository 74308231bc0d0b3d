"""String rules against Python's own strings."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import files, payload, text

SPACES = [chr(c) for c in range(0x3100) if chr(c).isspace()]
BREAKS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r"))
    return [r.r for r in rows.orderBy("i").collect()]


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(3)
    pieces = [*SPACES, *BREAKS, "a", "Be", "cäß", "\x1f", ".", "Σ", "limit", "\U0001f600"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(1500)]


def test_white_space_is_pythons(spark):
    assert len(SPACES) == 29
    assert column(spark, [f"{s}x{s}" for s in SPACES], text.strip) == ["x"] * 29


def test_lines(spark, strings):
    assert column(spark, strings, text.lines) == [[s.strip() for s in v.splitlines() if s.strip()] for v in strings]


def test_query_words(spark, strings):
    assert column(spark, strings, text.query_words) == [[w for w in v.lower().split() if len(w) > 2] for v in strings]
    assert column(spark, ["  The Cash\tof FLOW "], text.query_words) == [["the", "cash", "flow"]]


def test_nulls(spark):
    assert column(spark, [None], text.lines) == [[]]
    assert column(spark, [None], text.char_preview) == [""]


@pytest.mark.parametrize(
    ("n", "shown"),
    [(0, "0.0 bytes"), (1023, "1023.0 bytes"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1792, "1.8 KB"), (1048575, "1024.0 KB"), (1048576, "1.0 MB"), (5 * 1024**3, "5.0 GB"), (1024**5, "1.0 PB"), (-5, "-5.0 bytes")],
)
def test_human_size(spark, n, shown):
    assert spark.range(1).select(files.human_size(F.lit(n).cast("long"))).first()[0] == shown


def test_extensions(spark):
    names = ["a.PDF", "x.tar.gz", "noext", ".pdf", "a.", "b.Txt ", "c.exe"]
    assert column(spark, names, files.extension) == ["pdf", "gz", "", "pdf", "", "txt", "exe"]
    assert column(spark, names, files.is_allowed) == [True, False, False, True, False, True, False]


def test_secure_filename(spark):
    assert column(spark, ["../../etc/passwd", "My cool movie.mov", "Ünï côde.txt", "..", "a/b\\c.md", "Čapek żółw.txt", "ﬁle.txt", None], files.secure_filename) == ["etc_passwd", "My_cool_movie.mov", "Uni_code.txt", "", "a_b_c.md", "Capek_zow.txt", "file.txt", None]


def test_secure_filename_takes_signs_apart_as_python_does(spark):
    """Each sign that leaves something of ASCII, and mixed names."""
    signs = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]) if unicodedata.normalize("NFKD", c) != c]
    rng = random.Random(5)
    names = [f"{c}x" for c in signs] + ["".join(rng.choice([rng.choice(signs), "a", "Z", " ", "é", "中", "\u0301", "\U0001f600"]) for _ in range(rng.randrange(1, 10))) + rng.choice([".pdf", "\uff0e\uff50\uff44\uff46"]) for _ in range(2000)]
    assert column(spark, names, files.secure_filename) == column(spark, [unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode() for n in names], files.secure_filename)


def test_names_do_not_go_through_python(spark):
    plan = spark.createDataFrame([("ü.txt",)], "v string").select(files.secure_filename(F.col("v")))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_byte_preview(spark):
    payload = F.encode(F.lit("é" * 200), "UTF-8")
    cut, whole = spark.range(1).select(text.byte_preview(payload, 255), text.byte_preview(payload, 256)).first()
    assert cut == "é" * 127 + "�"
    assert whole == "é" * 128


def test_decoding(spark):
    rows = spark.createDataFrame([("héllo".encode(),), ("héllo".encode("latin-1"),), (b"\xef\xbb\xbfx",)], "b binary")
    assert [r[0] for r in rows.select(text.utf8_or_latin1(F.col("b"))).collect()] == ["héllo", "héllo", "﻿x"]


def test_payloads(spark):
    texts = ["", "short", "é" * 50, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").select("i", payload.payload(F.col("v"), 20).alias("b"))
    got = {r.i: (r.b, r.t) for r in rows.select("i", "b", payload.text_of(F.col("b")).alias("t")).collect()}
    assert [got[i][1] for i in range(4)] == ["", "short", "é" * 50, ""]
    assert [bytes(got[i][0] or b"").startswith(payload.MARKER) for i in range(4)] == [False, False, True, False]
    odd = spark.createDataFrame([(b"gzip:no gzip",), (b"\xff\xfe",)], "b binary")
    assert [r[0] for r in odd.select(payload.text_of(F.col("b"))).collect()] == ["gzip:no gzip", ""]


def test_quote_plus(spark):
    from urllib.parse import quote_plus

    texts = ["", "a b+c", "p@ss/w:rd?&=#%", "~*'()!_.-", "äß€𝄞\n\t", "".join(map(chr, range(32, 127)))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.quote_plus(F.col("t")).alias("q")).collect()
    assert {r.t: r.q for r in got} == {t: quote_plus(t) for t in texts}
