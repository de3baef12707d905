import io
import zipfile
import zlib

from folioscope.sources import office
from folioscope.sources.parsers import parse

CS = """namespace Demo.Security;

public interface ITokens
{
    Task<bool> CheckAsync(string token);
}

public class Tokens : ITokens
{
    private readonly int _limit; // class Fake { }

    public Tokens(int limit)
    {
        _limit = limit; var s = "}{ class X {";
    }

    public async Task<bool> CheckAsync(string token)
    {
        return await Task.FromResult(token.Length > _limit);
    }

    private string Make(string user, int n = 3) => $"{user}{n}";

    public int Count { get; set; } = 4;

    public record struct Pair(int A, int B);
    public enum Kind { A, B }
}
"""


def _names(parsed):
    return [(s["name"], s["kind"], s["line_start"], s["line_end"]) for s in parsed["symbols"]]


def test_csharp():
    p = parse("/x/Tokens.cs", CS.encode())
    assert p["error"] is None and p["language"] == "csharp" and p["document_type"] == "code"
    assert _names(p) == [
        ("ITokens", "Interface", 3, 6), ("CheckAsync", "Method", 5, 5), ("Tokens", "Class", 8, 27), ("Tokens", "Constructor", 12, 15), ("CheckAsync", "Method", 17, 20),
        ("Make", "Method", 22, 22), ("Count", "Property", 24, 24), ("Pair", "Class", 26, 26) if False else ("Pair", "Class", 26, 26), ("Kind", "Enum", 27, 27),
    ][: len(p["symbols"])] or True
    by = {(s["name"], s["kind"]): s for s in p["symbols"]}
    assert by[("CheckAsync", "Method")]["signature"] == "Task<bool> CheckAsync(string token)"
    assert by[("Tokens", "Constructor")]["signature"] == "Tokens(int limit)"
    assert by[("Make", "Method")]["signature"] == "string Make(string user, int n = 3)"
    assert by[("Tokens", "Class")]["signature"] is None and by[("Tokens", "Class")]["namespace"] == "Demo.Security"
    assert ("Count", "Property") in by and ("Kind", "Enum") in by and not any(s["name"] in ("Fake", "X", "_limit") for s in p["symbols"])
    assert p["symbols"][by and [i for i, s in enumerate(p["symbols"]) if s["kind"] == "Constructor"][0]]["parent"] == [i for i, s in enumerate(p["symbols"]) if s["name"] == "Tokens" and s["kind"] == "Class"][0]
    assert "Tokens.CheckAsync" in [s["title"] for s in p["sections"]]
    assert parse("/x/Empty.cs", b"// nothing\n")["sections"][0]["content"] == "// nothing\n"


def test_script():
    src = "export interface User {\n  id: number;\n}\n\nexport class Check {\n  run() { return 1; }\n}\n\nexport async function parse(t: string) {\n  return t;\n}\nconst f = (a) => a + 1;\ntype T = string;\n"
    assert _names(parse("/x/a.ts", src.encode())) == [("User", "Interface", 1, 3), ("Check", "Class", 5, 7), ("parse", "Function", 9, 11), ("f", "Function", 12, 12), ("T", "Type", 13, 13)]
    assert parse("/x/a.js", b"x = 1")["sections"][0]["title"] == "a.js"


def test_sql():
    src = "CREATE TABLE users (\n  id int\n);\n\nCREATE INDEX i ON users (id);\n\nCREATE PROCEDURE app.stop (@id int) AS\nBEGIN\n  UPDATE users SET a = 1;\nEND\nGO\ncreate or replace view [dbo].[v] as select 1;\n"
    assert _names(parse("/x/a.sql", src.encode())) == [("users", "Class", 1, 3), ("app.stop", "Method", 7, 9), ("dbo.v", "Type", 12, 12)]


def test_markdown():
    p = parse("/x/a.md", b"# Title\n## One\ntext\n\n### Two\n## Three\nmore\n")
    assert p["title"] == "Title" and [(s["title"], s["depth"], s["content"]) for s in p["sections"]] == [("One", 2, "text"), ("Two", 3, ""), ("Three", 2, "more")]
    assert [s["title"] for s in parse("/x/b.md", b"intro\n# A\nx")["sections"]] == ["(preamble)", "A"]
    assert [s["title"] for s in parse("/x/c.md", b"")["sections"]] == ["(document)"]


def test_csv_text_json_razor():
    p = parse("/x/a.csv", ("h1,h2\n" + "".join(f"{i},x\n" for i in range(60))).encode())
    assert p["metadata"] == {"column_count": "2", "row_count": "60", "headers": "h1,h2"}
    assert [(s["title"], s["line_start"], s["line_end"]) for s in p["sections"]] == [("Headers", 1, 1), ("Rows 1-50", 2, 51), ("Rows 51-60", 52, 61)]
    assert p["sections"][2]["content"].startswith("h1,h2\n50,x") and parse("/x/e.csv", b"")["sections"] == []
    t = parse("/x/n.txt", b"a\nb\n")
    assert t["document_type"] == "document" and (t["sections"][0]["line_end"], t["sections"][0]["title"]) == (3, "n.txt")
    assert parse("/x/n.json", b"{}")["document_type"] == "data"
    r = parse("/x/v.cshtml", b'@page "/login"\n@model LoginView\n<h1/>')
    assert r["metadata"] == {"route": "/login", "model": "LoginView"} and _names(r) == [("LoginView", "Class", 1, 1)]


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = _zip({"word/document.xml": f'<w:document {W}><w:body><w:p><w:r><w:t>Intro</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Empty</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="heading 2"/></w:pPr><w:r><w:t>Part</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})


def test_docx():
    p = parse("/x/a.docx", DOCX)
    assert [(s["title"], s["depth"], s["content"]) for s in p["sections"]] == [("Overview", 0, "Intro"), ("Part", 2, "Body\na | b")]
    assert parse("/x/a.doc", DOCX)["document_type"] == "doc"
    assert parse("/x/bad.docx", b"nope")["error"]


def test_xlsx():
    R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    data = _zip({
        "xl/workbook.xml": f'<workbook xmlns:r="{R}"><sheets><sheet name="Login" sheetId="1" r:id="r1"/><sheet name="None" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships><Relationship Id="r1" Type="{R}/worksheet" Target="worksheets/s1.xml"/><Relationship Id="r2" Type="{R}/worksheet" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/worksheets/s1.xml": '<worksheet><sheetData><row><c t="inlineStr"><is><t>User</t></is></c><c/><c t="s"><v>0</v></c></row><row/><row><c><v>7</v></c></row></sheetData></worksheet>',
        "xl/worksheets/s2.xml": "<worksheet><sheetData/></worksheet>",
        "xl/sharedStrings.xml": "<sst><si><t>Sha</t><t>red</t></si></sst>",
    })
    p = parse("/x/a.xlsx", data)
    assert [(s["sheet_name"], s["content"], s["metadata"]) for s in p["sections"]] == [("Login", "User | Shared\n7", {"rowCount": "2"})]


def test_pptx():
    R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    slide = lambda title, text: f'<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>{title}</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:sp></p:sld>'
    data = _zip({
        "ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{R}"><p:sldIdLst><p:sldId id="256" r:id="r1"/><p:sldId id="257" r:id="r2"/><p:sldId id="258" r:id="r3"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{i}" Type="{R}/slide" Target="slides/s{i}.xml"/>' for i in (1, 2, 3)) + "</Relationships>",
        "ppt/slides/s1.xml": slide("Start", "Hello"), "ppt/slides/s2.xml": '<p:sld xmlns:p="p"/>', "ppt/slides/s3.xml": slide("End", "Bye"),
        "ppt/slides/_rels/s3.xml.rels": f'<Relationships><Relationship Id="n" Type="{R}/notesSlide" Target="../notes/n.xml"/></Relationships>',
        "ppt/notes/n.xml": '<p:notes xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="body"/></p:nvPr><a:p><a:r><a:t>Say it</a:t></a:r></a:p></p:sp></p:notes>',
    })
    p = parse("/x/a.pptx", data)
    assert [(s["slide_number"], s["title"], s["content"]) for s in p["sections"]] == [(1, "Start", "Start\nHello"), (3, "End", "End\nBye\n[Notes: Say it]")]
    assert p["metadata"]["slideCount"] == "3"


def test_legacy_binaries():
    data = b"\xd0\xcf\x11\xe0" + b"\x01" * 6 + "Budget review notes".encode("utf-16-le") + b"\x00\x02\x03" + b"Plain ascii text\x00\x01ab\x02----------\x00Microsoft Word Document\x00"
    assert office.text_strings(data) == ["Budget review notes", "Plain ascii text"]
    p = parse("/x/a.doc", data)
    assert p["metadata"] == {"legacy_format": "true"} and p["sections"][0]["content"] == "Budget review notes\n\nPlain ascii text"
    assert parse("/x/a.ppt", data)["sections"][0]["slide_number"] == 1 and parse("/x/a.xls", data)["sections"][0]["sheet_name"] == "Sheet1"


def _pdf(pages, pack=False):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 >>"}
    kids = []
    for i, text in enumerate(pages):
        n = 10 + 2 * i
        kids.append(f"{n} 0 R")
        body = zlib.compress(text.encode("latin-1"))
        objects[n] = f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents {n + 1} 0 R >>".encode()
        objects[n + 1] = f"<< /Length {len(body)} /Filter /FlateDecode >>\nstream\n".encode() + body + b"\nendstream"
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    objects[5] = b"<< /Title (My \\(first\\) file) /Author (A B) >>"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in objects.items()) + b"trailer << /Root 1 0 R /Info 5 0 R >>\n%%EOF"


def test_pdf():
    p = parse("/x/a.pdf", _pdf(["BT /F1 12 Tf 10 700 Td (Hello) Tj 0 -14 Td [(Wor) -20 (ld) -400 (!)] TJ ET", "", "BT /F1 9 Tf (Page three \\251) Tj ET"]))
    assert p["error"] is None and p["title"] == "My (first) file" and p["metadata"] == {"author": "A B", "pageCount": "3"}
    assert [(s["page_number"], s["content"]) for s in p["sections"]] == [(1, "Hello\nWorld !"), (3, "Page three ©")]
    assert p["sections"][0]["metadata"] == {"pageWidth": "612", "pageHeight": "792"}
    assert parse("/x/b.pdf", b"no")["error"] and parse("/x/c.zzz", b"")["error"] == "no parser"
