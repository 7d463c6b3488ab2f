import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators.mutation import SnapshotStore
from tessera.providers import LocalProvider, caption_image, caption_missing
from tessera.sources import archives, extract, stores
from tessera.streaming import turns

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def package(parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return data.getvalue()


def relations(pairs):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in pairs) + "</Relationships>"


def test_docx_sections_lists_tables_and_changes():
    para = lambda t, extra="": f"<w:p><w:pPr>{extra}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    item = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>'
    body = para("Title", '<w:pStyle w:val="Heading1"/>') + para("first", item) + para("second", item) + "<w:p><w:ins><w:r><w:t>kept</w:t></w:r></w:ins><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>"
    body += "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>" + para("Next", '<w:pStyle w:val="Heading2"/>')
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="5"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="lowerRoman"/><w:lvlText w:val="%1)"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="5"/></w:num></w:numbering>'
    data = package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/numbering.xml": numbering})
    assert extract.read_docx(data) == [(0, "text", "Title\niii) first\niv) second\nkept"), (4, "text", "Next"), (0, "text", "| a\\|b |  |\n| --- | --- |")]
    form = extract.NUMBER_FORMATS
    assert [form["lowerLetter"](n) for n in (1, 26, 27)] == ["a", "z", "aa"] and form["decimalZero"](4) == "04" and form["upperRoman"](1994) == "MCMXCIV" and form["upperLetter"](28) == "BB"


def test_docx_labels_by_style_override_and_cell():
    level = lambda i, fmt, text, more="": f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{text}"/>{more}</w:lvl>'
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="1">{level(0, "upperRoman", "%1.")}{level(1, "decimal", "%1.%2", "<w:isLgl/>")}{level(2, "bullet", "x")}{level(3, "none", " Note ")}</w:abstractNum>'
    numbering += '<w:num w:numId="1"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="7"/></w:lvlOverride></w:num></w:numbering>'
    styles = f'<w:styles {W}><w:style w:styleId="A"><w:name w:val="list a"/><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style><w:style w:styleId="B"><w:name w:val="Heading 1"/><w:basedOn w:val="A"/></w:style></w:styles>'
    by_style = lambda t, style="B": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    own = lambda t, at, num=1: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{at}"/><w:numId w:val="{num}"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = by_style("one") + own("one one", 1) + own("one two", 1) + f"<w:tbl><w:tr><w:tc>{own('cell', 1)}</w:tc></w:tr></w:tbl>" + own("dot", 2) + own("n", 3) + by_style("two", "A") + own("fresh", 1) + own("seven", 0, 2) + own("plain", 0, 9)
    data = package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/numbering.xml": numbering, "word/styles.xml": styles})
    units = extract.read_docx(data)
    assert units[0][2].split("\n") == ["I. one", "1.1 one one", "1.2 one two", "- dot", "Note n", "II. two", "2.1 fresh", "VII. seven", "plain"] and units[1][2].startswith("| 1.3 cell |")


PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (200).to_bytes(4, "big") + (150).to_bytes(4, "big")


def test_images_that_are_worth_a_caption(spark):
    small = PNG[:16] + (20).to_bytes(4, "big") + PNG[20:]
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + (130).to_bytes(2, "big") + (140).to_bytes(2, "big") + b"\x03"
    assert extract.image_size(PNG) == (200, 150) and extract.image_size(jpeg) == (140, 130) and extract.image_size(b"BM" + b"\0" * 5) is None and extract.image_size(b"") is None
    docx = package({"word/document.xml": f"<w:document {W}><w:body/></w:document>", "word/_rels/document.xml.rels": relations([("a", "media/image1.png"), ("b", "media/image2.png"), ("c", "media/gone.png")]), "word/media/image1.png": PNG, "word/media/image2.png": small})
    got = extract.extract_images(spark.createDataFrame([("a.docx", "docx", docx), ("b.docx", "docx", b"x"), ("c.txt", "txt", b"x")], "filename string, format string, data binary")).collect()
    assert [(r.filename, r.image_no, bytes(r.data)) for r in got] == [("a.docx", 1, PNG)]

    class Shy(LocalProvider):
        calls = 0

        def caption(self, image):
            Shy.calls += 1
            return " a chart " if Shy.calls > 2 else ""

    waits: list = []
    assert caption_image(Shy(), PNG, waits.append) == "a chart" and waits == [2.0, 4.0] and caption_image(LocalProvider(), small) is None
    images = spark.createDataFrame([("h", PNG), ("h", PNG), ("s", small), (None, PNG)], "sha256 string, data binary")
    assert [r.sha256 for r in caption_missing(images, LocalProvider()).collect()] == ["h"]


def test_sheet_values():
    styles = '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    cells = '<c r="A1" s="1"><v>45292</v></c><c r="B1" s="2"><v>45292.5</v></c><c r="C1" s="3"><v>2.50</v></c><c r="D1"><v>3.0</v></c><c r="E1" t="b"><v>1</v></c><c r="F1" t="str"><v>007</v></c>'
    xlsx = package({"xl/workbook.xml": f'<workbook {R}><sheets><sheet name="S" r:id="x"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": relations([("x", "worksheets/sheet1.xml")]), "xl/styles.xml": styles, "xl/worksheets/sheet1.xml": f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>"})
    assert extract.read_xlsx(xlsx)[0][2].split("\n")[1] == "| 2024-01-01 00:00:00 | 2024-01-01 12:00:00 | 2.5 | 3 | TRUE | 007 |"


def test_object_store_attachments_and_web(spark, tmp_path):
    store = stores.ObjectStore(spark, f"file://{tmp_path}/objects")
    assert store.objects().count() == 0 and store.get("a/b c.txt") is None and store.stat("a") is None and store.link("a") is None
    store.put("a/b c.txt", b"one")
    store.put("a/b c.txt", b"two")
    store.put("d.png", PNG)
    assert store.get("/a//b c.txt") == b"two" and store.stat("d.png")["size"] == len(PNG) and store.link("a/b c.txt").endswith("a/b%20c.txt")
    assert sorted((r.key, r.size) for r in store.objects().collect()) == [("a/b c.txt", 3), ("d.png", len(PNG))] and [r.key for r in store.objects("*.png").collect()] == ["d.png"]
    for bad in ("../x", "", "a/../../b"):
        with pytest.raises(ValueError):
            store.get(bad)
    assert stores.attachment_text("n.txt", b"a\0b") == "ab" and stores.attachment_text("noext", b" \n", "text/plain") == ""
    with pytest.raises(ValueError):
        stores.attachment_text("a.exe", b"x")
    with pytest.raises(stores.AttachmentTooLarge):
        stores.attachment_text("a.txt", bytes(25_000_001))
    kept = stores.Attachments(2)
    first, second, third = (kept.add(f"d/{n}.txt", n, 5, n) for n in "abc")
    assert kept.get(first) is None and kept.owned_by(second, "b") and not kept.owned_by(second, "c") and not kept.owned_by(first, "a") and kept.tokens([first, second, third]) == 10
    assert kept.with_question("q", [first, third]) == "q\n\nAttached file c.txt:\nc"

    class Down:
        def search(self, query):
            raise OSError("down")

    pages = stores.PagesSearch([{"title": f"t{i}", "url": f"u{i}", "content": "port " + "x" * 600} for i in range(9)] + [{"title": None, "url": None, "content": None}])
    got = stores.search_web(pages, "the Port")
    assert [r["url"] for r in got] == ["u0", "u1", "u2", "u3", "u4"] and len(got[0]["content"]) == 500 and stores.search_web(Down(), "x") == [] and stores.search_web(None, "x") == []
    queries = spark.createDataFrame([(1, "port"), (2, None), (3, "none")], "query_id long, text string")
    assert stores.web_results(queries, pages).count() == 5


CHART = '<c:chartSpace xmlns:c="c"><c:ser><c:tx><c:strRef><c:pt idx="0"><c:v>Rev</c:v></c:pt></c:strRef></c:tx><c:cat><c:pt idx="0"><c:v>Q1</c:v></c:pt><c:pt idx="1"><c:v>Q2</c:v></c:pt></c:cat><c:val><c:pt idx="0"><c:v>42</c:v></c:pt><c:pt idx="1"><c:v>58</c:v></c:pt></c:val></c:ser></c:chartSpace>'


def test_pptx_and_xlsx():
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:txBody><a:p><a:r><a:t>Hello</a:t></a:r></a:p></p:txBody></p:sld>'
    notes = '<p:notes xmlns:p="p" xmlns:a="a"><p:txBody><a:p><a:r><a:t>say it</a:t></a:r></a:p><a:p><a:r><a:t>1</a:t></a:r></a:p></p:txBody></p:notes>'
    pptx = package({
        "ppt/presentation.xml": f'<p:presentation xmlns:p="p" {R}><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": relations([("rId1", "slides/slide1.xml")]),
        "ppt/slides/slide1.xml": slide, "ppt/slides/_rels/slide1.xml.rels": relations([("a", "../notesSlides/notesSlide1.xml"), ("b", "../charts/chart1.xml")]), "ppt/notesSlides/notesSlide1.xml": notes, "ppt/charts/chart1.xml": CHART,
    })
    assert extract.read_pptx(pptx) == [(1, "text", "Hello\n[Speaker notes] say it"), (1, "chart_data", "|  | Rev |\n| --- | --- |\n| Q1 | 42 |\n| Q2 | 58 |")]
    xlsx = package({
        "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="Rev" sheetId="1" r:id="x"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": relations([("x", "worksheets/sheet1.xml")]), "xl/sharedStrings.xml": "<sst><si><t>Quarter</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="A2"><v> </v></c></row></sheetData></worksheet>',
    })
    assert extract.read_xlsx(xlsx) == [(1, "text", "Sheet: Rev\n| Quarter |  | 7 |\n| --- | --- | --- |")]


def test_extraction_survives_bad_files(spark):
    rows = [("a.txt", "txt", b"caf\xe9\x00"), ("b.docx", "docx", b"not a zip"), ("c.bin", None, b"x"), ("d.md", "md", b" \n "), ("e.txt", "txt", None)]
    got = extract.extract(spark.createDataFrame(rows, "filename string, format string, data binary")).collect()
    by = {r.filename: r for r in got}
    assert by["a.txt"].content == "café" and by["b.docx"].error and by["c.bin"].error and "d.md" not in by and by["e.txt"].error
    kinds = spark.createDataFrame([("x/A.PDF", None), ("noext", "text/plain"), ("a.exe", "text/plain"), ("none", None)], "f string, m string").select(extract.dispatch("f", "m").alias("d"))
    assert [r.d for r in kinds.collect()] == ["pdf", "txt", None, None]


def test_chunker(spark):
    texts = [(1, "one  two\n \nthree\r\n\r\n" + " ".join(map(str, range(12)))), (2, " \n\n "), (3, None), (4, "")]
    got = extract.chunk_text(spark.createDataFrame(texts, "id int, text string"), "text", 5).orderBy("id", "chunk_no").collect()
    assert [r.chunk for r in got] == ["one two", "three", "0 1 2 3 4", "5 6 7 8 9", "10 11"]


def test_zip_source_plan_and_checkpoint(spark, tmp_path):
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.zip").write_bytes(package({"docs/one.txt": "1", "docs/two.md": "2", "__MACOSX/x.txt": "", "docs/~$l.docx": "", "pic.png": ""}))
    spark.dataSource.register(archives.ZipSource)
    entries = spark.read.format("zip_entries").option("content", "true").load(str(tmp_path / "z"))
    plan = archives.zip_plan(entries)
    assert sorted((r.entry, bytes(r.data)) for r in plan.collect()) == [("docs/one.txt", b"1"), ("docs/two.md", b"2")]
    packed = spark.read.format("binaryFile").load(f"file://{tmp_path}/z").select(F.col("path").alias("archive"), F.col("content").alias("data"))
    assert sorted(r.entry for r in archives.zip_plan(archives.unzip(packed)).collect()) == ["docs/one.txt", "docs/two.md"] and archives.unzip(packed.withColumn("data", F.lit(b"bad"))).first().skipped == "damaged archive"
    assert len(archives.ZipReader({"path": str(tmp_path / "z"), "entries": "2"}).partitions()) == 3
    path = f"file://{tmp_path}/done"
    assert archives.load_checkpoint(spark, path).count() == 0
    archives.append_checkpoint(plan.filter("entry like '%one%'").select("archive", "entry", F.lit("done").alias("status"), F.lit("").alias("detail")), path)
    assert [r.entry for r in archives.zip_plan(entries, archives.load_checkpoint(spark, path), exclude=["zzz"]).collect()] == ["docs/two.md"]


def test_event_format_and_calls(spark):
    assert archives.sse_decode(archives.sse_encode("done", "a\nb") + archives.sse_encode("x", {"n": 1})) == [("done", "a\nb"), ("x", '{"n": 1}')]
    rows = [(1, 2, 0, None, None, '"x"}'), (1, 1, 0, "id", "find", '{"q": '), (1, 3, 1, "id2", "list", None)]
    got = archives.assemble_calls(spark.createDataFrame(rows, "turn_id int, seq int, call_index int, call_id string, name string, arguments string")).orderBy("call_index").collect()
    assert [(r.call_id, r.name, r.arguments) for r in got] == [("id", "find", '{"q": "x"}'), ("id2", "list", "")]


def test_streams(spark, tmp_path):
    from tessera.operators.charts import filter_answer

    spec = '{"type": "bar", "title": "t", "labels": ["a", "b"], "series": [{"name": "s", "values": [1, 2]}], "sources": [1]}'
    answers = {"t1": f"see\n```chart\n{spec}\n```\nend", "t2": "```chart\nbad\n```\nplain"}
    schema = "turn_id string, seq long, token string, last boolean"
    source = str(tmp_path / "tokens")
    for part in range(3):
        rows = []
        for turn, text in answers.items():
            tokens = [text[i : i + 4] for i in range(0, len(text), 4)]
            rows += [(turn, i, t, i == len(tokens) - 1) for i, t in enumerate(tokens) if i * 3 // len(tokens) == part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    sources = {"t1": ["only 1"]}
    known = spark.createDataFrame(list(sources.items()), "turn_id string, sources array<string>")
    query = turns.filter_charts(stream, known).writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination()
    out: dict = {}
    for r in spark.table("filtered").orderBy("turn_id", "seq").collect():
        out[r.turn_id] = out.get(r.turn_id, "") + r.text
    assert out == {t: filter_answer(a, sources.get(t, []))[0] for t, a in answers.items()} and "unverified" in out["t1"]

    store, chunks = SnapshotStore(spark, f"file://{tmp_path}/store"), "filename string, chunk_index int, content string"
    incoming = str(tmp_path / "in")
    for version in ("old", "new"):
        spark.createDataFrame([("a", 0, version)], chunks).write.mode("append").parquet(incoming)
        turns.ingest_stream(spark.readStream.schema(chunks).parquet(incoming), store, f"file://{tmp_path}/c2").awaitTermination()
    assert [r.content for r in store.read_buckets("chunks").collect()] == ["new"]
    before = store.versions()
    store.replace_files("chunks", spark.createDataFrame([("b", 0, "x"), ("c", 0, "y")], chunks), 64)
    store.replace_files("chunks", spark.createDataFrame([("b", 1, "z")], chunks), 64)
    assert sorted(tuple(r) for r in store.read_buckets("chunks").collect()) == [("a", 0, "new"), ("b", 1, "z"), ("c", 0, "y")]
    assert {k: v for k, v in store.versions().items() if k in before} == before and store.replace_files("chunks", spark.createDataFrame([], chunks)) is None
    store.append("log", spark.createDataFrame([(1,)], "n int"))
    store.append("log", spark.createDataFrame([(2,)], "n int"))
    assert sorted(r.n for r in store.read("log").collect()) == [1, 2]
