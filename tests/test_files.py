from __future__ import annotations

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from leafstream import cli
from leafstream.job import Job
from leafstream.operators import providers as pools
from leafstream.operators.dispatch import Provider, Settings
from leafstream.operators.services import Echo
from leafstream.sources import books, files, word


@pytest.mark.parametrize(
    ("data", "text"),
    [("é".encode(), "é"), (b"\xef\xbb\xbfa", "a"), ("é".encode("utf-16"), "é"), (b"caf\xe9", "café"), (b"\x81", "\x81"), (b"", "")],
)
def test_decode(data, text):
    assert files.decode(data) == text


def epub() -> bytes:
    page = """<html xmlns="http://www.w3.org/1999/xhtml"><head><title>The book</title><style>p {}</style></head><body>
    <h1>One</h1><div>loose<p>First <b>bold</b><br/>line</p><p><a href="x">Linked</a></p><p>12</p></div>
    <ul><li>item<img src="i.png"/></li></ul></body></html>"""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr(
            "O/p.opf",
            '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="urn:dc"><dc:language>en</dc:language></metadata><manifest>'
            '<item href="a%20b.xhtml" media-type="application/xhtml+xml"/><item href="bad.html" media-type="text/html"/><item href="gone.xhtml" media-type="text/html"/>'
            '<item href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine/></package>',
        )
        z.writestr("O/a b.xhtml", page)
        z.writestr("O/bad.html", "<html><body><p><b>Open<p>Second &nbsp;one</body>")
        z.writestr("O/t.ncx", '<ncx xmlns="urn:n"><navLabel><text>Label</text></navLabel><navLabel><text>1</text></navLabel></ncx>')
        z.writestr("O/i.png", b"\x89PNG")
    return out.getvalue()


def test_epub():
    found = [t for _, _, t in books.blocks(epub())]
    assert found == ["The book", "One", "First bold\nline", "Linked", "item", "Open", "Second \xa0one", "Label"]
    made = books.rebuild(epub(), {i: f"T{i}\nx" for i in range(8)})
    again = zipfile.ZipFile(io.BytesIO(made))
    assert again.namelist()[0] == "mimetype" and again.read("O/i.png") == b"\x89PNG"
    assert [t for _, _, t in books.blocks(made)] == [f"T{i}\nx" for i in range(8)]
    text = again.read("O/a b.xhtml").decode()
    assert 'dir="rtl"' in text and "i.png" in text and 'href="x"' in text and "loose" in text
    package = again.read("O/p.opf").decode()
    assert ">fa<" in package and 'page-progression-direction="rtl"' in package
    assert [t for _, _, t in books.blocks(books.rebuild(epub(), {}))] == found


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    p = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in runs) + "</w:p>"
    body = p("Hello ", "world") + p("12") + f"<w:tbl><w:tr><w:tc>{p('cell')}</w:tc></w:tr></w:tbl>" + p("end") + '<w:sectPr><w:headerReference w:type="default" r:id="h"/></w:sectPr>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}>{p('head')}</w:hdr>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="urn:r"><Relationship Id="h" Target="header1.xml"/></Relationships>')
    return out.getvalue()


def test_docx():
    assert [t for _, _, t in word.paragraphs(docx())] == ["Hello world", "end", "cell", "head"]
    made = word.rebuild(docx(), {0: "A", 2: "C"})
    assert [t for _, _, t in word.paragraphs(made)] == ["A", "end", "C", "head"]
    assert zipfile.ZipFile(io.BytesIO(made)).read("word/document.xml").decode().count("bidi") == 2


def test_pages_to_docx():
    made = word.from_pages([["one", "two"], [], ["three"]])
    assert [t for _, _, t in word.paragraphs(made)] == ["one", "two", "three"]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.TXT").write_text("Hello world.\n\nSecond paragraph.\n\n12", encoding="utf-8")
    (tmp_path / "in" / "b.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHi\n\n2\n00:00:03,000 --> 00:00:04,000\nthere", encoding="utf-8")
    (tmp_path / "in" / "c.epub").write_bytes(epub())
    (tmp_path / "in" / "d.docx").write_bytes(docx())
    (tmp_path / "in" / "e.xyz").write_text("no")
    return tmp_path


def test_job_and_resume(spark, folder):
    read = files.read_files(spark, str(folder / "in"))
    assert {r["ext"] for r in read.collect()} == {".txt", ".srt", ".epub", ".docx", None}
    kept = str(folder / "kept")
    job = Job(read, [Provider("a", concurrency=2)], Echo(change=str.upper), checkpoint=kept)
    out = {r["output"]: r["content"] for r in job.run().collect()}
    assert set(out) == {"a.fa.txt", "b.fa.srt", "c.fa.epub", "d.fa.docx"}
    assert out["a.fa.txt"].decode() == "HELLO WORLD.\n\nSECOND PARAGRAPH.\n\n12"
    assert out["b.fa.srt"].decode().count("‏") == 2 and "‏HI" in out["b.fa.srt"].decode()
    assert [t for _, _, t in word.paragraphs(bytes(out["d.fa.docx"]))] == ["HELLO WORLD", "END", "CELL", "HEAD"]
    assert "ONE" in [t for _, _, t in books.blocks(bytes(out["c.fa.epub"]))]
    told = job.progress()
    assert told["status"] == "done" and told["failed_segments"] == 0 and told["done_segments"] == told["total_segments"] and told["percent"] == 100.0

    def none(service, key, prompt, settings):
        raise AssertionError("nothing is left to do")

    again = Job(read, [Provider("a")], none, checkpoint=kept)
    assert {r["output"]: r["content"] for r in again.run().collect()} == out
    assert again.run_result.rounds == 0


def test_pages_job(spark):
    read = files.pasted(spark, "x").withColumn("ext", F.lit(".pdf")).withColumn("filename", F.lit("p.pdf")).withColumn("doc_id", F.lit("p"))
    pages = spark.createDataFrame([("p", 0, "One.\n\nTwo."), ("p", 1, "12\n\nThree.")], "doc_id string, page_no int, text string")
    row = Job(read, [Provider("a")], Echo(change=str.lower), Settings(), pages=pages).run().first()
    assert row["output"] == "p.fa.docx" and [t for _, _, t in word.paragraphs(bytes(row["content"]))] == ["one.", "two.", "three."]


def test_uploads(spark):
    assert files.uploaded(spark, "c:\\x\\a.md", "YQ==").first()["filename"] == "a.md"
    with pytest.raises(ValueError, match="empty"):
        files.pasted(spark, " \n")


def test_cli(spark, folder, capsys):
    entry = {"name": "a", "url": "http://h/v1", "key": "k1,k2", "model": "m", "roles": ["t"], "concurrency": 2}
    for shape in ([entry], {"providers": [entry, {"name": "b", "enabled": False}]}):
        (folder / "p.json").write_text(json.dumps(shape))
        assert [r["base_url"] for r in files.read_providers(spark, str(folder / "p.json")).collect()] == ["http://h/v1"]
    (folder / "prompt").write_text("Render this.")
    arguments = [str(folder / "in"), "-p", str(folder / "p.json"), "--prompt", str(folder / "prompt"), "-o", str(folder / "out")]
    assert cli.main(arguments, call=Echo()) == 0
    assert (folder / "out" / "a.fa.txt").read_text(encoding="utf-8").startswith("Hello")
    told = capsys.readouterr().out
    assert "a: " in told and "2 of 2 keys" in told and "unknown format" in told
    assert cli.main([*arguments, "--refine"], call=Echo()) == 1
    assert "no provider" in capsys.readouterr().out
    single = [str(folder / "in" / "a.TXT"), "-p", str(folder / "p.json"), "-o", str(folder / "one" / "new.txt")]
    assert cli.main(single, call=Echo()) == 0 and (folder / "one" / "new.txt").read_text(encoding="utf-8").startswith("Hello")


def test_roles_as_text(spark, tmp_path):
    entries = [{"name": n, "url": "u", "model": "m", "use_for": r} for n, r in (("a", "review"), ("b", ["t"]), ("c", "t+r"), ("d", []), ("e", "odd"))]
    (tmp_path / "p.json").write_text(json.dumps(entries))
    rows = pools.configured(files.read_providers(spark, str(tmp_path / "p.json")))
    assert {r["name"]: r["roles"] for r in rows.collect()} == {"a": ["review"], "b": ["translate"], "c": ["translate", "review"], "d": ["translate", "review"], "e": ["translate", "review"]}
    plain = spark.createDataFrame([("x", "u", "k", "m", 1, True, None, "refine")], "name string, base_url string, api_key string, model string, concurrency int, enabled boolean, extra_headers map<string,string>, use_for string")
    assert pools.configured(plain).first()["roles"] == ["review"]


def test_bad_files_keep_no_other_from_its_end(spark, folder):
    (folder / "in" / "bad.epub").write_bytes(b"no archive")
    (folder / "in" / "bad.docx").write_bytes(b"x")
    (folder / "in" / "scan.pdf").write_bytes(b"%PDF")
    job = Job(files.read_files(spark, str(folder / "in")), [Provider("a", concurrency=2)], Echo())
    assert {r["output"] for r in job.run().collect()} == {"a.fa.txt", "b.fa.srt", "c.fa.epub", "d.fa.docx"}
    assert {r["doc_id"].rsplit("/", 1)[-1] for r in job.problems().collect()} == {"bad.epub", "bad.docx", "scan.pdf", "e.xyz"}


def test_watching(tmp_path):
    path = tmp_path / "p.json"
    path.write_text("[]")
    lines = []
    more = cli.watch(str(path), lambda: [Provider("n")], lines.append)
    assert more() == []
    os.utime(path, (1, 1))
    assert [p.name for p in more()] == ["n"] and more() == []
    path.unlink()
    assert more() == [] and lines
