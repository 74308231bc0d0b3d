"""PDF files made by hand, and by the library's own writer."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.plans import registry
from scriptorium.sources import extract, pdf, uploads


def built(objects, root=1, trailer="", head=b"%PDF-1.4\n"):
    """A file with a classic table of the objects (number -> bytes)."""
    out, places = bytearray(head), {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    at, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n" % size + b"".join(b"%010d %05d %c \n" % (places.get(n, 0), 0 if n in places else 65535, b"n" if n in places else b"f") for n in range(size))
    return bytes(out + b"trailer\n<</Size %d/Root %d 0 R%s>>\nstartxref\n%d\n%%%%EOF\n" % (size, root, trailer.encode(), at))


def stream(data, told=b""):
    return b"<<%s/Length %d>>\nstream\n" % (told, len(data)) + data + b"\nendstream"


def one_page(content, font=b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>", told=b"", more=None):
    return {
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>/XObject<</X 6 0 R>>>>>>",
        4: stream(content, told), 5: font,
    } | (more or {})


def text_of(content, **more):
    return pdf.page_texts(built(one_page(content, **more)))[0]


def test_strings_and_operators():
    assert text_of(b"BT /F1 12 Tf 50 700 Td (Hello \\(World\\) \\\\ \\101\\7\\\nx) Tj ET") == "Hello (World) \\ A\x07x"
    assert text_of(b"BT /F1 12 Tf 14 TL 50 700 Td (one) Tj T* <74776F> Tj (three) ' 2 1 (four) \" ET") == "one\ntwo\nthree\nfour"
    assert text_of(b"BT /F1 12 Tf 50 700 TD (a) Tj 0 -14 TD (b) Tj T* (c) Tj 0 -40 Td (d) Tj ET") == "a\nb\nc\n\nd"
    assert text_of(b"BT /F1 10 Tf 0 0 Td [(He) 20 (llo) -600 (you) -100 (r)] TJ ET") == "Hello your"
    assert text_of(b"q 2 0 0 2 0 0 cm BT /F1 5 Tf 1 0 0 1 10 300 Tm (big) Tj 1 0 0 1 60 300 Tm (far) Tj 1 0 0 1 10 293 Tm (low) Tj ET Q") == "big far\nlow"
    assert text_of(b"BT (no font) Tj /F1 8 Tf (caf\xe9 \x80) Tj ET % (comment)\n") == "café €"
    assert text_of(b"BI /W 2 /H 2 /BPC 8 /CS /G ID \x01(Tj\x02 EI BT /F1 9 Tf (after) Tj ET") == "after"


def test_filters():
    show = b"BT /F1 12 Tf 50 700 Td (Hello) Tj ET"
    up = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True)) for row, above in ((show[i : i + 6], show[i - 6 : i] if i else bytes(6)) for i in range(0, 36, 6)))
    assert text_of(zlib.compress(show), told=b"/Filter/FlateDecode") == "Hello"
    assert text_of(zlib.compress(up), told=b"/Filter[/FlateDecode]/DecodeParms[<</Predictor 12/Columns 6>>]") == "Hello"
    assert text_of(show.hex().encode() + b">", told=b"/Filter/ASCIIHexDecode") == "Hello"
    import base64

    assert text_of(base64.a85encode(zlib.compress(show)) + b"~>", told=b"/Filter[/A85/Fl]") == "Hello"
    assert text_of(bytes([len(show) - 1]) + show + b"\x80", told=b"/Filter/RunLengthDecode") == "Hello"
    assert text_of(zlib.compress(show)[:-6], told=b"/Filter/FlateDecode").startswith("Hello")


def _lzw_coded(data):
    codes, table, word, width = [(256, 9)], {bytes([i]): i for i in range(256)}, b"", 9
    for k in range(len(data)):
        c = data[k : k + 1]
        if word + c in table:
            word += c
            continue
        codes.append((table[word], width))
        table[word + c] = 258 + len(table) - 256
        width = max(9, (len(table) + 2 + 1).bit_length())
        word = c
    codes += [(table[word], width)]
    codes.append((257, max(9, (len(table) + 3 + 1).bit_length())))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("n", [3, 300, 2000])
def test_lzw(n):
    data = bytes(random.Random(n).choice(b"abcd") for _ in range(n))
    assert pdf._lzw(_lzw_coded(data), 1) == data


def test_fonts():
    widths = b"<</Type/Font/Subtype/TrueType/FirstChar 65/Widths[1000 200]/Encoding<</BaseEncoding/MacRomanEncoding/Differences[65/Eacute/uni4E2D 200/f_i/u1D11E/.notdef]>>>>"
    assert text_of(b"BT /F1 10 Tf (AB\xc8\xc9\x8a) Tj ET", font=widths) == "É中fi𝄞ä"
    standard = b"<</Type/Font/Subtype/Type1/BaseFont/Times-Roman>>"
    assert text_of(b"BT /F1 10 Tf (it's \xaeve \xfb) Tj ET", font=standard) == "it’s ﬁve ß"
    mapped = b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/DescendantFonts[<</DW 1000/W[1[500 500] 3 9 250]>>]/ToUnicode 7 0 R>>"
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfrange <0001> <0003> <0061> <0010> <0011> [<0078> <D834DD1E>] endbfrange 1 beginbfchar <0020> <00660069> endbfchar"
    assert text_of(b"BT /F1 10 Tf <00010002000300100011002000FF> Tj ET", font=mapped, more={7: stream(cmap)}) == "abcx𝄞fi(cid:255)"
    assert text_of(b"BT /F1 10 Tf <4E2D0041> Tj ET", font=b"<</Type/Font/Subtype/Type0/Encoding/UniGB-UCS2-H/DescendantFonts[<<>>]>>") == "中A"


def test_forms_and_their_own_resources():
    form = stream(b"BT /G 10 Tf (inner) Tj ET /X Do", b"/Type/XObject/Subtype/Form/Matrix[1 0 0 1 0 -50]/Resources<</Font<</G 5 0 R>>>>")
    assert text_of(b"BT /F1 10 Tf (outer) Tj ET /X Do", more={6: form}) == "outer\n\ninner"
    own = stream(b"BT /F1 10 Tf (x) Tj ET /X Do", b"/Subtype/Form")  # a form that shows itself comes to an end
    assert set(text_of(b"/X Do", more={6: own})) == {"x"}


def nested():
    return one_page(b"BT /F1 10 Tf (first) Tj ET") | {
        2: b"<</Type/Pages/Kids[3 0 R 7 0 R]/Count 3/Resources<</Font<</F1 5 0 R>>>>>>", 7: b"<</Type/Pages/Parent 2 0 R/Kids[8 0 R 9 0 R 7 0 R]/Count 2>>", 8: b"<</Type/Page/Contents[10 0 R 4 0 R]>>", 9: b"<</Type/Page>>",
        10: stream(b"BT /F1 10 Tf (second) Tj ET"),
    }


def test_page_trees():
    """Inherited resources, several content streams, empty pages, and a node that holds itself."""
    data = built(nested())
    assert pdf.page_texts(data) == ["first", "second\nfirst", ""]
    assert pdf.page_count(data) == 3


def test_a_later_revision_counts():
    data = built(one_page(b"BT /F1 10 Tf (old) Tj ET"))
    before = int(data.split(b"startxref\n")[1].split(b"\n")[0])
    at = len(data)
    data += b"4 0 obj\n" + stream(b"BT /F1 10 Tf (new) Tj ET") + b"\nendobj\n"
    table = len(data)
    data += b"xref\n4 1\n%010d 00000 n \ntrailer\n<</Size 6/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (at, before, table)
    assert pdf.page_texts(data) == ["new"]


@pytest.mark.parametrize("spoilt", ["startxref", "table", "place", "trailer"])
def test_broken_references(spoilt):
    """The objects are looked for where the table is of no use."""
    data = built(one_page(b"BT /F1 10 Tf (found) Tj ET"))
    if spoilt == "startxref":
        data = data.split(b"startxref")[0]
    elif spoilt == "table":
        data = data.replace(b"xref\n0", b"xxxx\n0")
    elif spoilt == "place":
        data = data.replace(b"%PDF-1.4\n", b"%PDF-1.4\n% moved along\n")
    else:
        data = data.split(b"xref")[0]
    assert pdf.page_texts(data) == ["found"]
    assert pdf.page_count(data) == 1


def test_tables_are_followed_where_they_are_whole(monkeypatch):
    """The search for objects is for broken files alone."""
    monkeypatch.setattr(pdf.Document, "_look_for_objects", lambda self: pytest.fail("looked for objects"))
    for data in (pdf.written("one\ntwo\n\nthree", 2), built(nested())):
        assert pdf.page_texts(data)[0]


def test_packed_objects_without_their_table():
    data = pdf.written("one\ntwo\n\nthree", 2)
    assert pdf.page_texts(data) == pdf.page_texts(data.split(b"startxref")[0]) == ["one\ntwo", "three"]


def test_stream_lengths_that_are_references_or_wrong():
    show = b"BT /F1 10 Tf (no endstream yet) Tj ET"
    objects = one_page(b"") | {4: b"<</Length 9 0 R>>\nstream\r\n" + show + b"\nendstream", 9: b"%d" % len(show)}
    assert pdf.page_texts(built(objects)) == ["no endstream yet"]
    objects[4] = b"<</Length 3>>\nstream\nBT /F1 10 Tf (whole) Tj ET\nendstream"
    assert pdf.page_texts(built(objects)) == ["whole"]


@pytest.mark.parametrize("content", [b"", b"no PDF", b"%PDF-1.4\n%%EOF", built({1: b"<</Type/Catalog>>"}), built(one_page(b""), trailer="/Encrypt 9 0 R"), built(one_page(b"x", told=b"/Filter/DCTDecode"))])
def test_what_cannot_be_read_gives_the_fixed_message(content):
    text, error = extract.pdf_text(content)
    assert text == f"[PDF extract error] {error}"


def test_damage_never_crashes():
    """Bytes changed at random: a text or the message, always a count or null."""
    rng = random.Random(7)
    for data in (built(nested()), pdf.written("some text\n" * 80)):
        for _ in range(150):
            spoilt = bytearray(data)
            for _ in range(rng.randrange(1, 8)):
                spoilt[rng.randrange(len(spoilt))] = rng.randrange(256)
            text, error = extract.pdf_text(bytes(spoilt[: rng.randrange(len(spoilt) // 2, len(spoilt) + 1)]))
            assert isinstance(text, str) and (error is None or text.startswith("[PDF extract error] "))


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_characters="\n"), max_size=20).map(lambda s: s + "\n") | st.text(max_size=40), st.integers(1, 5))
def test_written_texts_come_back(text, per_page):
    text = text.encode("utf-8", "ignore").decode()
    pages = pdf.page_texts(pdf.written(text, per_page))
    lines = text.split("\n")
    assert len(pages) == -(-len(lines) // per_page)
    kept = [line for k in range(len(pages)) for line in lines[k * per_page : (k + 1) * per_page] if line]
    assert [line for page in pages for line in page.split("\n") if line] == kept


def test_files_as_rows(spark):
    texts = [("a.pdf", "x\ny\nz"), ("b.pdf", "")]
    files = spark.createDataFrame(texts, "filename string, text string").transform(lambda df: extract.pdf_files(df, 2))
    bad = spark.createDataFrame([("c.pdf", bytearray(b"no PDF"))], "filename string, content binary")
    read = {r.filename: r for r in extract.extract(files.unionByName(bad)).collect()}
    assert (read["a.pdf"].text, read["a.pdf"].total_pages, read["a.pdf"].extract_error) == ("x\ny\n\fz\n\f", 2, None)
    assert read["b.pdf"].text == "\n\f" and read["c.pdf"].text.startswith("[PDF extract error] ") and read["c.pdf"].total_pages is None
    pages = sorted((tuple(r) for r in extract.pdf_page_rows(files.unionByName(bad)).collect()), key=repr)
    assert pages == [("a.pdf", 1, "x\ny"), ("a.pdf", 2, "z"), ("b.pdf", 1, ""), ("c.pdf", None, None)]


def test_a_task_that_reads_files_has_one_python_worker(spark):
    """One step of the plan runs Python: with names judged in others, each task had three workers at once."""
    files = spark.createDataFrame([("a.pdf", bytearray(pdf.written("one")))], "filename string, content binary")
    plan = uploads.accept(files)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_few_texts_are_written_as_files_at_once(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    write = registry.materialize
    monkeypatch.setattr(registry, "materialize", lambda df, label: seen.append(spark.conf.get(name)) or write(df, label))
    before = spark.conf.get(name)
    made = registry._as_pdf(spark.createDataFrame([(1, "one\ntwo"), (2, None)], "doc_id long, text string"))
    assert [(r.filename, pdf.page_texts(bytes(r.content))) for r in made.collect()] == [("1.pdf", ["one\ntwo"])]
    assert seen == ["1000"] and spark.conf.get(name) == before
