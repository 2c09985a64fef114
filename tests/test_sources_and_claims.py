import io
import random
import zipfile

import pytest

from ledgerloom.functions.claims import atom_coverage, has_unreadable_number, is_negated, locate_quote, numbers_in, quote_alignment, substring_distance
from ledgerloom.operators.chunking import MOST, approx_tokens, canonical_json, chunk_prose, chunk_sheet, markdown_row
from ledgerloom.sources.decode import decode_text
from ledgerloom.sources.elements import Malformed
from ledgerloom.sources.files import list_folder, parse_files, unwrap_attachments
from ledgerloom.sources.mail import attachments_of, parse_mail
from ledgerloom.sources.office import format_number, open_archive, parse_docx, parse_pptx, parse_xlsx
from ledgerloom.sources.tables import parse_delimited
from ledgerloom.sources.texts import parse_html, parse_text


def test_delimited_text():
    p = parse_delimited(b'a;"b;""c"""\r\n1;2\r;3\n')
    assert [(e.cell, e.text) for e in p.elements] == [("A1", "a"), ("B1", 'b;"c"'), ("A2", "1"), ("B2", "2"), ("B3", "3")]
    assert parse_delimited(b"").elements == [] and [e.cell for e in parse_delimited(b"x,y").elements] == ["A1", "B1"]
    for bad in (b'a,b"c', b'"a"b,c', b'"open'):
        with pytest.raises(Malformed):
            parse_delimited(bad)


def test_encodings():
    assert decode_text("é".encode())[1] == "utf-8" and decode_text("prix élevé".encode("cp1252")) == ("prix élevé", "windows-1252")
    assert decode_text("﻿abc".encode("utf-16-le"))[0] == "abc" and decode_text("plain english text in sixteen bits".encode("utf-16-be"))[0].startswith("plain") and decode_text(b"") == ("", "utf-8")


def test_text_and_html():
    e = parse_text(b"# A\n\nx\ny\n \n## B\n\nz\n# not alone\nq").elements
    assert [(x.text, x.heading_path) for x in e] == [("A", ("A",)), ("x\ny", ("A",)), ("B", ("A", "B")), ("z\n# not alone\nq", ("A", "B"))]
    h = parse_html(b"<h1>T</h1><nav><li>menu</li></nav><p>one<br>two<script>x</script></p><p hidden>no</p><div style='display: none'>no</div><table><tr><th>a<th>b</tr><tr><td>1</td><td></td></tr></table><table><tr><td rowspan=2>q</td></tr><tr><td>r</td></tr></table>")
    assert [(x.text, x.cell) for x in h.elements] == [("T", None), ("menu", None), ("one two", None), ("a", "A1"), ("b", "B1"), ("1", "A2"), ("q", None), ("r", None)] and len(h.reasons) == 1
    with pytest.raises(Malformed):
        parse_html(b"<p>a</p><script>left open")


MAIL = b"From: a@x\r\nSubject: =?utf-8?q?H=C3=A9?=\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nhello\r\n\r\nthere\r\n--b\r\nContent-Type: text/csv\r\nContent-Disposition: attachment; filename=\"../../x:y.csv\"\r\n\r\n1,2\r\n--b--\r\n"


def test_mail():
    assert [e.text for e in parse_mail(MAIL).elements] == ["From: a@x\nSubject: Hé\nAttachments: 1", "hello", "there"]
    assert [(a.name, a.content) for a in attachments_of(MAIL)] == [("x_y.csv", b"1,2")]
    with pytest.raises(Malformed):
        parse_mail(b"")


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def test_office():
    w = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
    d = zipped(**{"word__document.xml": f"<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>"})
    assert [(e.text, e.heading_path, e.paragraph_index) for e in parse_docx(d).elements] == [("Head", ("Head",), 0), ("body", ("Head",), 2)]
    s, r = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'", "xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'"
    rels = "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'><Relationship Id='r1' Target='{}'/></Relationships>"
    x = zipped(**{"xl__workbook.xml": f"<workbook {s} {r}><sheets><sheet name='S' r:id='r1'/></sheets></workbook>", "xl___rels__workbook.xml.rels".replace("___", "__"): "", "xl__styles.xml": f"<styleSheet {s}><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/><xf numFmtId='10'/></cellXfs></styleSheet>", "xl__worksheets__1.xml": f"<worksheet {s}><sheetData><row><c r='A1' t='inlineStr'><is><t>m</t></is></c><c r='B2' s='1'><v>45292</v></c><c r='C2' s='2'><v>0.0525</v></c></row></sheetData><mergeCells><mergeCell ref='A1:B1'/></mergeCells></worksheet>"})
    with zipfile.ZipFile(io.BytesIO(x), "r") as old:
        parts = {n: old.read(n) for n in old.namelist() if "rels" not in n}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in parts.items():
            z.writestr(n, b)
        z.writestr("xl/_rels/workbook.xml.rels", rels.format("worksheets/1.xml"))
    assert {e.cell: (e.text, e.merge_covered) for e in parse_xlsx(out.getvalue()).elements} == {"A1": ("m", False), "B1": ("m", True), "B2": ("2024-01-01", False), "C2": ("5.25%", False)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", f"<p:p xmlns:p='p' {r}><p:sldId r:id='r1'/></p:p>")
        z.writestr("ppt/_rels/presentation.xml.rels", rels.format("slides/9.xml"))
        z.writestr("ppt/slides/9.xml", "<x xmlns:a='http://schemas.openxmlformats.org/drawingml/2006/main'><a:p><a:r><a:t>one</a:t></a:r></a:p><a:p/></x>")
    assert [(e.text, e.slide) for e in parse_pptx(out.getvalue()).elements] == [("one", 1)]
    with pytest.raises(Malformed):
        open_archive(zipped(**{"..__evil": "x"}))
    assert format_number(-1234.5, '#,##0.0;(#,##0.0)') == ("(1,234.5)", True) and format_number(0.5, "0%") == ("50%", True) and format_number(12345678, '0.0,,"M"') == ("12.3M", True)


def test_files_in_spark(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_bytes(b"x,y\n1,2")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "m.eml").write_bytes(MAIL)
    files = list_folder(spark, str(tmp_path)).withColumnRenamed("relative_path", "file_id")
    rows = parse_files(files).collect()
    assert {r.file_id for r in rows} == {"a.csv", "sub/b.pdf", "m.eml"} and [r.error for r in rows if r.file_id == "sub/b.pdf"] == ["the content is not of the declared kind"]
    assert [(r.parent_id, r.name, r.kind) for r in unwrap_attachments(files).collect()] == [("m.eml", "x_y.csv", "csv")]


def test_chunks():
    rng = random.Random(1)
    text = " ".join("w" * rng.randint(1, 12) for _ in range(4000))
    chunks = chunk_prose([("intro", ("A",)), (text, ("A",)), ("end", ("B",))])
    assert all(c["n_tokens"] <= MOST + 100 for c in chunks) and chunks[-1]["text"] == "end" and approx_tokens("x" * 5) == 2
    assert "".join(text.split()) in "".join(c["text"].replace(" ", "") for c in chunk_prose([(text, ())])) or len(chunks) > 5
    sheet = chunk_sheet([(1, 1, "Title")] + [(r, c, f"{r}:{c}") for r in range(2, 9) for c in (1, 2)])
    assert [(c["first_row"], c["last_row"]) for c in sheet] == [(1, 1), (3, 6), (7, 8)] and markdown_row(["a|b", "-"]) == "| a\\|b | - |" and markdown_row(["---"]) == "| \\--- |"
    assert canonical_json({"b": 1.0, "a": [None, 0.5]}) == '{"a":[null,0.5],"b":1}' and chunk_prose([]) == [] and chunk_sheet([]) == []


def test_numbers_and_quotes():
    assert [v for _, _, v in numbers_in("twenty five of 1,200 (3%) and one point five and one; a million")] == [25, 1200, -3, 1.5]
    assert has_unreadable_number("٣") and has_unreadable_number("99999999999999999999") and not has_unreadable_number("12")
    assert is_negated("it cannot be") and is_negated("won’t") and not is_negated("without limitation") and is_negated("without delay")
    assert locate_quote("a “b” – c", 'x a "b" -  c y') == ("exact", 1.0) and locate_quote("", "x") == ("none", 0.0) and locate_quote("abcdefghij", "xx abcdefghiX")[0] == "fuzzy"
    assert quote_alignment("Rent rose sharply in the tower", ["The rent of the tower rose sharply"]) == "aligned" and quote_alignment("Rent rose in the tower", ["rent never rose in the tower"]) == "quote-contradicts-statement"
    assert quote_alignment("Rent rose", ["ok"]) == "quote-not-substantive" and quote_alignment("price 漢字", ["x"]) == "quote-script-unsupported" and quote_alignment("pаge of the rent", ["page of the rent"]) == "quote-mixed-script"
    assert atom_coverage("red tower sold", ["red tower", "tower sold"])[0] and not atom_coverage("red tower", [])[0]


def test_substring_distance_against_the_table():
    def slow(text, pattern):
        last = list(range(len(pattern) + 1))
        best = last[-1]
        for c in text:
            row = [0]
            for j, p in enumerate(pattern, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != p)))
            best, last = min(best, row[-1]), row
        return best

    rng = random.Random(4)
    for _ in range(300):
        t, p = ("".join(rng.choice("abc") for _ in range(rng.randint(0, n))) for n in (40, 12))
        assert substring_distance(t, p) == slow(t, p)
