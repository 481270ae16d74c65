"""PDF files made by hand."""

import zlib

from corpusloom.sources import pdf


def made(objects: dict[int, bytes], tail: bytes = b"") -> bytes:
    return b"%PDF-1.7\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (n, o) for n, o in objects.items()) + b"\ntrailer << /Root 1 0 R " + tail + b">>"


def stream(data: bytes, head: bytes = b"", packed: bool = True) -> bytes:
    raw = zlib.compress(data) if packed else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(raw), b"/Filter /FlateDecode" if packed else b"", head, raw)


CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <AC00> endbfchar 2 beginbfrange <0002> <0003> <B098> <0010> <0011> [<0041> <00420043>] endbfrange"
FONTS = b"/Resources << /Font << /L << /Subtype /Type1 >> /K << /Subtype /Type0 /ToUnicode 9 0 R >> >> >>"


def book(contents: list[bytes], **more) -> bytes:
    pages = range(20, 20 + len(contents))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages %s /Kids [%s] >>" % (FONTS, b" ".join(b"%d 0 R" % p for p in pages)), 9: stream(CMAP)}
    for p, c in zip(pages, contents):
        objects |= {p: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (p + 100), p + 100: stream(c, packed=p % 2 == 0)}
    return made(objects, **more)


def test_text():
    one = rb"BT /L 10 Tf 72 700 Td (Hello \(old\) \101) Tj 0 -14 Td [(Wo) 20 (rld) -300 (again)] TJ 14 TL T* <48C9> Tj /K 10 Tf 40 0 Td <000100020010> Tj ET"
    ((page, kind, text, ocr),) = pdf.pdf_blocks(book([one]))
    assert (page, kind, ocr) == (1, "text", False) and text == "Hello (old) A\nWorld again\nHÉ 가나A"


def test_table():
    rules = b" ".join(b"%d 100 m %d 160 l S" % (x, x) for x in (50, 150, 250, 350)) + b" " + b" ".join(b"50 %d 300 0 re S" % y for y in (100, 130, 160))
    cells = b" ".join(b"BT /L 8 Tf %d %d Td (%s) Tj ET" % c for c in ((55, 140, b"class"), (155, 140, b"fee"), (255, 140, b"page"), (55, 110, b"A-E"), (155, 110, b"0.3"), (255, 110, b"7")))
    blocks = pdf.pdf_blocks(book([rules + b" " + cells]))
    assert [b[1] for b in blocks] == ["text", "table"] and blocks[1][2].split("\n")[0].replace(" ", "") == "|class|fee|page|" and "| A-E | 0.3 | 7 |" in blocks[1][2]
    assert [b[1] for b in pdf.pdf_blocks(book([b"q 1 0 0 1 5 5 cm 50 100 m 250 100 l S Q " + cells]))] == ["text"]


def test_running_lines_and_scans():
    page = lambda i: b"BT /L 9 Tf 14 TL 50 800 Td (Fund Report) Tj T* (second of %d) Tj T* (text %d that says more) Tj T* (x) Tj T* (y) Tj ET" % (i, i)
    blocks = pdf.pdf_blocks(book([page(i) for i in range(4)]))
    assert len(blocks) == 4 and all("Fund Report" not in b[2] and f"text {i} that" in b[2] for i, b in enumerate(blocks))
    assert "Fund Report" in pdf.pdf_blocks(book([page(i) for i in range(3)]))[0][2]
    scans = pdf.pdf_blocks(book([b"", page(1)]), ocr=lambda content, number: f"seen {number}")
    assert [(b[0], b[3]) for b in scans] == [(1, True), (2, False)] and scans[0][2] == "seen 1" and [b[0] for b in pdf.pdf_blocks(book([b"", page(1)]))] == [2]


def test_object_streams_forms_and_odd_files():
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 2 0 R] >>", b"<< /Type /Page /Contents 5 0 R /Resources << /XObject << /F 6 0 R >> >> >>"]
    at = [sum(map(len, inner[:i])) + i for i in range(3)]
    head = b" ".join(b"%d %d" % x for x in zip((1, 2, 3), at)) + b" "
    form = stream(b"BT /L 9 Tf 10 10 Td (inside a form) Tj ET", b"/Subtype /Form /Matrix [1 0 0 1 0 0] /Resources << /Font << /L << >> >> >>")
    objects = {4: stream(head + b" ".join(inner), b"/Type /ObjStm /N 3 /First %d" % len(head)), 5: stream(b"/F Do"), 6: form}
    assert pdf.pdf_blocks(made(objects)) == [(1, "text", "inside a form", False)]
    for odd in (b"", b"no file", book([b"BT (x"])[:200], book([b"BT /L 9 Tf (hidden) Tj ET"], tail=b"/Encrypt 7 0 R "), made({1: b"<< /Type /Catalog /Pages 1 0 R >>"})):
        assert pdf.pdf_blocks(odd) == []


def test_files(spark):
    rows = spark.createDataFrame([("a", bytearray(book([b"BT /L 9 Tf 1 1 Td (one) Tj ET", b"BT /L 9 Tf 1 1 Td (two) Tj ET"]))), ("b", bytearray(b"x")), ("c", None)], "path string, content binary")
    got = [tuple(r) for r in pdf.pdf_files(rows).orderBy("path", "pos").collect()]
    assert got == [("a", 0, 1, "text", False, "one"), ("a", 1, 2, "text", False, "two")]
