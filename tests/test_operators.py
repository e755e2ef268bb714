import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.functions.unicode import decode_bytes
from pageloom.operators import admission, ast, cleanup, layout, ocr, pages, report, scoring, structure
from pageloom.plans.convert import convert
from pageloom.sources import files, manifest, writers
from pageloom.streaming import dropfolder


def test_quality_rules(spark):
    rows = [(1, "正常的文字 with words"), (2, "   "), (3, "�" * 10), (4, "" * 10), (5, "技" * 30 + "文字"), (6, None)]
    out = {r.id: r for r in T.with_quality(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert out[1].acceptable and out[1].score == 1.0 and out[1].warnings == []
    assert out[2].warnings == [T.FEW_CHARS] and out[6].warnings == [T.FEW_CHARS]
    assert T.REPLACED in out[3].warnings and T.PRIVATE in out[4].warnings
    assert out[5].warnings == [T.REPEATED] and out[5].score == 0.45


@pytest.mark.parametrize("case", [(0, 0, 0.0, "empty"), (0, 1, 0.1, "scanned"), (5, 1, 0.8, "scanned"), (30, 1, 0.8, "mixed"), (5, 0, 0.0, "text"), (30, 1, 0.1, "text"), (-1, 0, 0.0, None), (0, -1, 0.0, None), (1, 1, 1.1, None)])
def test_page_kinds(spark, case):
    df = spark.createDataFrame([case[:3]], "a int, b int, c double")
    assert df.select(pages.page_kind(F.col("a"), F.col("b"), F.col("c"))).first()[0] == case[3]


def test_headers_go_and_page_numbers_stay(spark):
    rows = [(1, n, f"项目报告\n第{n}页正文\n{n}") for n in (1, 2, 3)] + [(2, 1, "a\nb"), (2, 2, "a\nc")]
    out = {(r.doc_id, r.page_number): r.text for r in cleanup.remove_margins(spark.createDataFrame(rows, "doc_id long, page_number int, text string")).collect()}
    assert out[1, 2] == "第2页正文\n2" and out[2, 1] == "a\nb"


def test_prefixes_cascade(spark):
    shared = [f"shared line {k} with some more words" for k in range(12)]
    rows = [(1, 1, "native", "\n".join([*shared, "one"])), (1, 2, "native", "\n".join([*shared, "a", "b", "c"])), (1, 3, "native", "\n".join([*shared, "x", "y", "z"])), (2, 1, "native", "\n".join(shared)), (2, 2, "ocr", "\n".join([*shared, "a", "b", "c"]))]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, source string, text string")
    out = {(r.doc_id, r.page_number): (r.removed, r.text) for r in cleanup.remove_prefixes(df).collect()}
    assert out[1, 2] == (12, "a\nb\nc") and out[1, 3][0] == 0 and out[2, 2][0] == 0


def test_marginals_that_repeat(spark):
    rows = [(1, n, f"body {n}\n国立图书馆藏书目{'录' if n < 3 else '錄'}\nunique title of {'abcdefgh'[n] * 9}", [1, 2]) for n in (1, 2, 3)]
    out = cleanup.remove_marginals(spark.createDataFrame(rows, "doc_id long, page_number int, text string, marginal_line_indices array<int>")).collect()
    assert all("国立" not in r.text and "unique" in r.text for r in out)


def test_structure():
    def md(t):
        return structure.Reader(t).read()

    assert md("") == ("\n", [])
    assert md("第一章 总则\n\n正文第一行，\n正文第二行。\n\n1.1 范围\n")[0] == "# 第一章 总则\n\n正文第一行，\n正文第二行。\n".replace("，\n", "， ") + "\n### 1.1 范围\n"
    assert md("甲字\n乙字，还有\n丙")[0] == "甲字乙字，还有丙\n"
    assert md("a\tb\n1\t2|3\n")[0] == "| a | b |\n| --- | --- |\n| 1 | 2\\|3 |\n"
    assert md("text.\n\n    code\n\n\tmore\nend of it.")[0] == "text.\n\n```\ncode\n\nmore\n```\n\nend of it.\n"
    assert md("Short title\n\nbody text goes on here for long.\n") == ("## Short title\n\nbody text goes on here for long.\n", ["通过短行规则推断了 1 个标题，请核对标题层级。"])
    assert md("一、甲\n二、乙\n")[0] == "1. 甲\n1. 乙\n"
    assert md("plain above\n一、甲")[0] == "plain above\n## 一、甲\n"
    assert md("```\na\n")[0] == "```\na\n" and md("x\n| a |\n|---|\n| b |")[0] == "x\n\n| a |\n|---|\n| b |\n"


def test_separators(spark):
    df = spark.createDataFrame([("| a | b |\n|:---------|-----------:|\n| ---- | x |  \n\n",)], "m string")
    assert df.select(structure.tidy_separators(F.col("m"))).first()[0] == "| a | b |\n| :--- | ---: |\n| ---- | x |\n"


def test_names(spark):
    rows = [(n,) for n in ("../a.txt", "a/b.txt", "a\\b.txt", ".hidden", "", "ok 文件(1).txt", "b*d.md")]
    out = {r[0]: (r[1], r[2]) for r in spark.createDataFrame(rows, "n string").select("n", admission.name_error(F.col("n")), admission.clean_name(F.col("n"))).collect()}
    assert all(out[n][0] for n in ("../a.txt", "a/b.txt", "a\\b.txt", ".hidden", "")) and out["ok 文件(1).txt"] == (None, "ok 文件(1).txt") and out["b*d.md"] == (None, "b_d.md")


def test_free_names(spark):
    wanted = spark.createDataFrame([("d", "a.txt", 1), ("d", "a.txt", 2), ("d", "b.txt", 3)], "dir string, name string, k int")
    taken = spark.createDataFrame([("d", "a.txt"), ("d", "a_3.txt")], "dir string, name string")
    out = {r.k: r.published_name for r in admission.free_names(wanted, directory="dir", name="name", order=["k"], taken=taken).collect()}
    assert out == {1: "a_2.txt", 2: "a_4.txt", 3: "b.txt"}


def archive(*entries, flags=None):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries:
            z.writestr(name, body)
    return buffer.getvalue()


def test_archives(spark):
    good = (("[Content_Types].xml", "x"), ("word/document.xml", "y"))
    rows = [(1, archive(*good)), (2, archive(*good, ("../x", "z"))), (3, archive(good[0])), (4, b"no zip"), (5, archive(*good, ("a/big", "0" * 5_000_000)))]
    entries, broken = files.zip_entries(spark.createDataFrame(rows, "doc_id long, content binary"))
    out = {r.doc_id: r.error for r in admission.inspect_archives(entries).collect()}
    assert out[1] is None and "路径穿越" in out[2] and "word/document.xml" in out[3] and "压缩比" in out[5]
    assert [r.doc_id for r in broken.collect()] == [4]


def test_pdf_heads(spark):
    rows = [(b"%PDF-1.7\n/JS /URI\n%%EOF",), (b"%PDF-1.7\n",), (b"hello",), (b"%PDF-",), (b"",)]
    out = admission.inspect_pdf_heads(spark.createDataFrame(rows, "content binary")).collect()
    assert out[0].error is None and out[0].pdf_version == "1.7" and out[0].has_active_content and out[0].has_external_links and len(out[0].warnings) == 2
    assert "%%EOF" in out[1].error and "文件头" in out[2].error and "空" in out[3].error and out[4].error == "PDF 文件内容为空。"


def test_decoding():
    assert decode_bytes("中文".encode())["encoding"] == "utf-8" and decode_bytes(b"\xef\xbb\xbfa")["text"] == "a"
    assert decode_bytes("这是一个用于测试的中文文本，内容足够长。".encode("gbk"))["text"].startswith("这是一个") and decode_bytes(b"")["error"]


def test_trees(spark):
    tree = '{"blocks":[{"t":"Header","c":[1,["",[],[]],[{"t":"Str","c":"\\"t\\":\\"Table\\""}]]},{"t":"Para","c":[{"t":"Image","c":[["",[],[]],[],["../x.png",""]]}]}],"meta":{"a":{"t":"Link"}}}'
    df = spark.createDataFrame([(1, tree), (2, "[]"), (3, None)], "doc_id long, tree string")
    assert spark.createDataFrame([(tree,), ("[]",)], "t string").select(ast.is_tree(F.col("t"))).collect() == [(True,), (False,)]
    out = {r.doc_id: r for r in ast.stats(df).collect()}
    assert (out[1].headings, out[1].images, out[1].tables, out[1].links) == (1, 1, 0, 0) and out[2].headings == out[3].headings == 0
    assert [(r.doc_id, r.source) for r in ast.image_sources(df.where("doc_id <> 2")).collect()] == [(1, "../x.png")]


def word(text, x0, top, x1, bottom=None):
    return (layout.Word(text, float(x0), float(top), float(x1), float(bottom or top + 10)), True)


def test_three_lanes_are_read_one_after_another():
    words = [word(f"{lane}{r}", x0, 140 + 20 * r, x1) for r in range(25) for lane, (x0, x1) in zip("abc", ((45, 210), (222, 388), (399, 565)), strict=True)]
    out = layout.page_layout(words, [], 612.0, 792.0)
    assert out["column_count"] == 3 and out["warnings"] == [layout.THREE_COLUMNS]
    lines = out["text"].split("\n")
    assert [x[0] for x in lines[-75:]].count("a") == 25 and lines.index("a24") < lines.index("b24") < lines.index("c24")


def test_two_columns_with_a_title():
    words = [word("Title across", 236, 50, 380)] + [word(f"{s} line {r}", x0, 100 + 20 * r, x0 + 190) for s, x0 in (("right", 332), ("left", 60)) for r in range(8)]
    out = layout.page_layout(words, [], 612.0, 792.0)
    lines = out["text"].split("\n")
    assert out["column_count"] == 2 and lines[0] == "Title across" and lines[1:9] == [f"left line {r}" for r in range(8)]


def test_tables():
    rows = [["Head", None, ""], ["a", "b\nc", ""], ["d", "1", ""]]
    found = [{"strategy": "lines", "box": (50.0, 100.0, 300.0, 200.0), "rows": rows}, {"strategy": "text", "box": (52.0, 101.0, 299.0, 199.0), "rows": rows}]
    out = layout.page_layout([word("inside", 100, 150, 140), word("below", 60, 300, 100)], found, 612.0, 792.0)
    assert out["text"] == "Head\t\na\tb c\nd\t1\n\nbelow" and out["structured_table_count"] == 1 and out["complex_table_count"] == 1
    assert not layout.is_table([["x" * 90, "y" * 90]] * 6, "text", (45, 50, 565, 760), 612.0, 792.0, 3)


def test_vertical_text_runs_from_the_right():
    def b(k, x, text, top=100.0, bottom=220.0):
        return {"source_index": k, "left": x, "right": x + 20.0, "top": top, "bottom": bottom, "text": text, "has_geometry": True}

    order, margins, numbers = ocr.columns_from_right([b(0, 110.0, "天地玄黄宇宙", 100.0, 200.0), b(1, 310.0, "洪荒日月盈昃"), b(2, 360.0, "辰宿列张寒来"), b(3, 160.0, "暑往秋收冬藏"), b(4, 162.0, "闰余成岁", 230.0, 320.0), b(5, 361.0, "十二", 300.0, 330.0)])
    assert [x["source_index"] for x in order] == [2, 5, 1, 3, 4, 0] and numbers == {5} and 0 in margins


def test_ruled_grid(spark):
    gray = np.full((400, 600), 255)
    for x in (40, 180, 320, 460, 560):
        gray[60:341, x] = 0
    for y in (60, 130, 200, 270, 340):
        gray[y, 40:561] = 0
    ys, xs = ocr.grid_lines(gray)
    assert ys == [60, 130, 200, 270, 340] and xs == [40, 180, 320, 460, 560] and ocr.grid_lines(np.full((400, 600), 255)) is None
    cells = [(1, 1, 4 * r + c, f"{r}{c}", 0.9, ys[r] + 10.0, xs[c] + 10.0, ys[r] + 30.0, xs[c] + 30.0, True) for r in range(4) for c in range(4)]
    blocks = spark.createDataFrame([*cells, (1, 1, 16, "title", 0.9, 5.0, 50.0, 15.0, 90.0, True)], "doc_id long, page_number int, source_index int, text string, score double, top double, left double, bottom double, right double, has_geometry boolean")
    rules = spark.createDataFrame([(1, 1, xs, ys)], "doc_id long, page_number int, xs array<int>, ys array<int>")
    assert ocr.ruled_tables(blocks, rules).first().text == "title\n" + "\n".join("\t".join(f"{r}{c}" for c in range(4)) for r in range(4))


def test_accuracy(spark):
    rows = [(1, "甲乙 丙", "甲乙丙"), (2, "abcd", "abxd"), (3, "", "x")]
    out = {r.page: r for r in scoring.page_accuracy(spark.createDataFrame(rows, "page int, reference string, output string")).collect()}
    assert out[1].edit_distance == 0 and out[2].accuracy == 0.75 and out[3].error and out[3].accuracy is None
    both = spark.createDataFrame([(1, "a" * 9, "a" * 9), (2, "b", "c")], "page int, reference string, output string")
    assert scoring.total_accuracy(scoring.page_accuracy(both), []).first().passes_gate
    assert scoring.diagnose(both).where("page = 2").first().differences[0].kind == "替换"


def test_six_paths(spark):
    md = "# Title\n\nSome text\nof it\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\ncode\n```\n"
    read = spark.createDataFrame([(md.encode(), "markdown")], "c binary, k string").select(files.parse("c", "k").alias("p")).select("p.blocks")
    back = read.select(writers.docx("blocks").alias("c"), writers.plain(F.col("blocks")).alias("plain"), writers.gfm(F.col("blocks")).alias("gfm")).first()
    assert back.gfm == "# Title\n\nSome text of it\n\n- one\n- two\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n```\ncode\n```\n" and "1\t2" in back.plain
    again = files.docx_blocks(bytes(back.c))
    assert [b["kind"] for b in again] == ["heading", "paragraph", "list", "list", "table", "code"] and again[0]["level"] == 1
    assert spark.createDataFrame([(b"x", "docx")], "c binary, k string").select(files.parse("c", "k").alias("p")).first().p.error


def test_archive_of_a_batch(spark):
    jobs = spark.createDataFrame([("a.txt", "a.md", "txt", "markdown", False, None, []), ("b.md", "b.md", "markdown", "markdown", True, "same", [])], "source_file string, target_file string, source_format string, target_format string, skipped boolean, error string, warnings array<string>")
    reports = report.finish(jobs).withColumn("batch", F.lit(1))
    outputs = spark.createDataFrame([(1, "a.md", b"# a")], "batch int, name string, content binary")
    z = zipfile.ZipFile(io.BytesIO(bytes(report.archives(outputs, reports, "batch").first().archive)))
    assert set(z.namelist()) == {"outputs/a.md", "reports/a_report.json", "reports/b_report.json", "batch_report.json"}
    s = report.batch_summary(reports, ["batch"]).first()
    assert (s.total, s.successful, s.skipped, s.failed) == (2, 1, 1, 0)


def test_drop_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    (tmp_path / "in" / "b.xyz").write_text("?")
    q = dropfolder.watch(spark, str(tmp_path / "in"), "markdown").writeStream.format("memory").queryName("dropped").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    out = {r.file_name: r for r in spark.sql("SELECT * FROM dropped").collect()}
    assert out["a.txt"].text == "hello" and out["b.xyz"].error


def test_publish_never_overwrites(spark, tmp_path):
    df = spark.range(1)
    writers.publish(df, str(tmp_path / "x"))
    with pytest.raises(Exception, match="exists"):
        writers.publish(df, str(tmp_path / "x"))


def test_plug_in():
    with pytest.raises(RuntimeError, match="optional library"):
        files.plug_in("no_such_library", "PDF reading")


@pytest.mark.parametrize("target", ["txt", "markdown", "docx"])
def test_conversion(spark, target):
    md = "# Title\n\ntext of it\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    docx = spark.createDataFrame([(md.encode(), "markdown")], "c binary, k string").select(files.parse("c", "k").alias("p")).select(writers.docx("p.blocks")).first()[0]
    rows = [(1, "a.txt", "第一章 总则\n\n正文在此。\n".encode()), (2, "b.md", md.encode()), (3, "c.docx", bytes(docx)), (4, "d.docx", b"no archive"), (5, "e.txt", b""), (6, "../f.txt", b"x"), (7, "g.pdf", b"%PDF-"), (8, "h.xyz", b"x")]
    df = spark.createDataFrame(rows, "doc_id long, file_name string, content binary").withColumn("length", F.length("content").cast("long"))
    out = {r.doc_id: r for r in convert(df, target).collect()}
    same = {"txt": 1, "markdown": 2, "docx": 3}[target]
    assert out[same].skipped and out[same].error is None and out[same].output is None
    for k in {1, 2, 3} - {same}:
        assert out[k].success and out[k].output and out[k].target_file and out[k].stats.headings == 1, out[k]
    assert all(out[k].error and not out[k].success and out[k].target_file == "" for k in {4, 5, 6, 7, 8} - ({4} if target == "docx" else set()))


def test_manifest(spark, tmp_path):
    import json

    good = {"id": "a-1", "filename": "a.pdf", "source_url": "https://x.org/" + "0" * 40, "source_page_url": "https://x.org", "source_repository": "r", "source_revision": "0" * 40, "source_license": "MIT", "redistribution": "no", "sha256": "a" * 64, "file_size": 3, "language": "zh", "categories": ["x"], "expected_page_count": 1, "acceptance": {}, "manual_review": {}}
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "samples": [good, {**good, "filename": "b.pdf"}, {**good, "id": "b", "filename": "../c.pdf"}]}))
    samples, errors = manifest.manifest(spark, str(tmp_path / "m.json"))
    assert {(r.ord, r.error[:7]) for r in errors.collect()} == {(2, "PDF 样例 "), (3, "PDF 样例 ")}
    chosen, missing = manifest.select_samples(samples, ["b", "nope", "b"])
    assert [r.id for r in chosen.collect()] == ["b"] and missing == ["nope"]


def test_raw_results(spark):
    rows = [(1, 1, [" b ", "", "a", "c"], [0.9, 0.1, float("nan")], [[[5.0, 20.0], [9.0, 30.0]], [], [[1.0, 2.0], [3.0, 4.0]]])]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, texts array<string>, scores array<double>, polygons array<array<array<double>>>")
    out = {r.text: r for r in ocr.blocks_of(df).collect()}
    assert (out["b"].source_index, out["b"].top, out["b"].left, out["b"].bottom, out["b"].right, out["b"].score) == (0, 20.0, 5.0, 30.0, 9.0, 0.9)
    assert out["a"].source_index == 1 and out["a"].score is None and not out["c"].has_geometry and (out["c"].top, out["c"].bottom) == (2.0, 3.0)
    assert ocr.horizontal_text(ocr.blocks_of(df)).first().text == "c\na\nb"  # without a polygon a block stands at the left edge


def test_differences_of_every_item(spark, tmp_path):
    from pageloom.plans import catalogue

    spark.createDataFrame([(1, "the cat"), (2, "thé à la menthe"), (3, "中文 the")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.item_id: r.differences for r in catalogue.accuracy_differences(spark, str(tmp_path)).collect()}
    assert set(out) == {1, 2, 3} and all(x not in (None, "[]") for x in out.values())


def test_rounding_is_of_the_exact_binary_value(spark):
    import random

    from pageloom.functions.text import rounded

    rng = random.Random(6)
    values = [0.125, 0.375, 2.675, 1.005, 0.5, 1.5, 2.5, 0.00005, 0.65125, 1234567.125, -0.125, 0.0] + [rng.random() for _ in range(300)] + [k / 64 for k in range(128)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[rounded(F.col("v"), n).alias(f"r{n}") for n in (1, 2, 4)]).collect()
    assert [tuple(r) for r in rows] == [(r.v, round(r.v, 1), round(r.v, 2), round(r.v, 4)) for r in rows]


def test_composed_texts(spark):
    from pageloom.functions import text

    rows = [("e\u0301t\u00e9",), ("plain",), (None,), ("\u212b \u1100\u1161",)]
    out = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.normalize(F.col("t"))).collect()]
    assert out == ["\u00e9t\u00e9", "plain", "", "\u00c5 \uac00"]


def test_corridors_and_lines_of_long_pages(spark):
    words = [(1, 1, k, 10.0 + 200 * (k % 3), 150.0 + 200 * (k % 3), 20.0 + 10 * (k // 3), 28.0 + 10 * (k // 3)) for k in range(300)]
    df = spark.createDataFrame(words, "doc_id long, page_number int, word_idx int, x0 double, x1 double, top double, bottom double")
    assert sorted((r.start, r.end) for r in layout.corridors(df, 600.0).collect()) == [(150, 210), (350, 410)]
    assert {r.word_idx: r.line_no for r in layout.cluster_lines(df).collect()} == {k: k // 3 for k in range(300)}


def test_three_columns_need_two_gaps():
    words = [layout.Word("wwww", 20.0, 100.0 + 5 * r, 590.0, 104.0 + 5 * r) for r in range(72)]
    band = [layout.Word("ab", 20.0 + 195 * c, 50.0 + 2 * r, 185.0 + 195 * c, 52.0 + 2 * r) for r in range(14) for c in range(3)]
    assert layout.three_columns(band, 612.0, 792.0) is not None
    assert layout.three_columns([*words, *band], 612.0, 792.0) is None  # enough words below for the rule of whole pages


def test_pages_are_folded_without_a_frame_for_each(spark):
    """One exchange deals the words by document; a page's words are one row, in the order of word_idx, whatever else the page has."""
    words = [(1, 1, k, f"w{k}", 60.0, 60.0 + 14 * k, 500.0, 70.0 + 14 * k, True) for k in range(4)] + [(1, 2, 0, None, None, float("nan"), 9.0, 9.0, None), (None, 1, 0, "x", 1.0, 1.0, 9.0, 9.0, True)]
    df = spark.createDataFrame(words[::-1], "doc_id long, page_number int, word_idx int, text string, x0 double, top double, x1 double, bottom double, upright boolean")
    assert {(r.doc_id, r.page_number): r.text for r in layout.page_texts(df, 612.0, 792.0).collect()} == {(1, 1): "w0\nw1\nw2\nw3", (1, 2): "", (None, 1): "x"}
    tables = spark.createDataFrame([(2, 1, "lines", 50.0, 100.0, 300.0, 200.0, [["a", None], ["b", "1"], ["c", "2"]])], "doc_id long, page_number int, strategy string, x0 double, top double, x1 double, bottom double, rows array<array<string>>")
    out = {(r.doc_id, r.page_number): r for r in layout.page_texts(df, 612.0, 792.0, tables).collect()}
    assert len(out) == 4 and out[2, 1].text == "a\t\nb\t1\nc\t2" and out[2, 1].complex_table_count == 1 and out[1, 1].text == "w0\nw1\nw2\nw3"
    plan = layout.page_texts(df, 612.0, 792.0)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_words_are_dealt_once(spark):
    from comparing import DATA
    from pageloom.plans import catalogue

    plan = catalogue.page_layout(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_gutters_equal_all_candidates():
    import random
    from statistics import median

    rng, found = random.Random(4), 0
    for _ in range(300):
        n = rng.randint(4, 40)
        own = [layout.Block("x" * rng.randint(1, 9), 40.0 + 280 * (k % 2) + rng.choice([0, 5.5]), 10.0 * k, 200.0 + 280 * (k % 2) + rng.choice([0, 30.25, 90.0]), 10.0 * k + 8) for k in range(n)]
        blocks, scores = [b for b in own if len(b.text) >= 2], []
        for step in range(31 if len(blocks) >= 6 else 0):
            at, half = 612.0 * (0.35 + step * 0.01), 612.0 * 0.012
            left, right = [b for b in blocks if b.x1 <= at - half], [b for b in blocks if b.x0 >= at + half]
            if min(len(left), len(right)) >= 2:
                w, v = sum(len(b.text) for b in left), sum(len(b.text) for b in right)
                share, a, b = (w + v) / sum(len(b.text) for b in blocks), median(x.x1 for x in left), median(x.x0 for x in right)
                if min(w, v) >= 0.2 * max(w, v) and share >= 0.68 and b - a >= 12.24:
                    scores.append((share + min((b - a) / 612.0, 0.12) - (len(blocks) - len(left) - len(right)) * 0.005, -step, (a + b) / 2))
        found += bool(scores)
        assert layout.two_columns(own, 612.0) == (max(scores)[2] if scores else None)
    assert found > 50


def test_lanes_of_dense_pages_are_found_once_a_word():
    """Not for each of the 55 places where three lanes may begin."""
    looked = [0]

    class Seen(layout.Word):
        @property
        def x(self) -> float:
            looked[0] += 1
            return super().x

    words = [Seen("word", 45.0 + 177 * (k % 3), 60.0 + 14 * (k // 3), 200.0 + 177 * (k % 3), 70.0 + 14 * (k // 3)) for k in range(135)]
    out = layout.order_three(words, [], (210.0, 388.0), 612.0, 792.0)
    assert looked[0] <= 10 * len(words)
    body = [b for b in out if 96 <= b.top < 740]
    assert [b.x0 for b in body] == sorted(b.x0 for b in body) and len(out) == 135


def test_recognised_pages_are_one_row_each(spark):
    from comparing import DATA
    from pageloom.plans import catalogue

    plan = catalogue.ocr_vertical_order(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "FlatMapGroups" not in plan and "Join" not in plan


def test_columns_are_sought_among_near_ones():
    """A column that a block is too far left of is not looked at again."""
    looked = [0]

    class Block(dict):
        def __getitem__(self, k):
            looked[0] += 1
            return super().__getitem__(k)

    for n in (200, 400):
        looked.append(looked[0])
        blocks = [Block(source_index=k, left=40.0 * k, right=40.0 * k + 20, top=100.0 + k % 2, bottom=220.0, text="天地玄黄", has_geometry=True) for k in range(n)]
        order, _, _ = ocr.columns_from_right(blocks)
        assert [b["source_index"] for b in order] == list(range(n))[::-1]
    assert looked[0] - looked[2] <= 2.2 * (looked[2] - looked[1])


def test_lines_are_numbered_without_a_join(spark):
    """Python sees two numbers of a word; the words' other columns stay in their rows."""
    rows = [(1, p, k, f"w{k}", 60.0 + k % 2, 100.0, 60.0 + 14 * (k // 2), 70.0 + 14 * (k // 2), [k]) for p in (1, 2) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, word_idx int, text string, x0 double, x1 double, top double, bottom double, more array<int>")
    out = layout.cluster_lines(df)
    assert out.columns == [*df.columns, "line_no"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert sorted(tuple(r) for r in out.collect()) == sorted((*r, r[2] // 2) for r in rows)


def test_gutters_are_sought_in_a_page_s_own_row(spark):
    """The 31 candidates make no rows; missing, infinite and crossed edges count as they did."""
    import random

    rng, rows, want = random.Random(8), [], {}
    for page in range(60):
        n = rng.randint(4, 30)
        own = [layout.Block("x" * rng.randint(1, 9), 40.0 + 280 * (k % 2) + rng.choice([0, 5.5]), 10.0 * k, 200.0 + 280 * (k % 2) + rng.choice([0, 30.25, 90.0]), 10.0 * k + 8) for k in range(n)]
        want[page] = layout.two_columns(own, 612.0)
        rows += [(1, page, *b[:2], b.x1) for b in own]
    gutter = [(1, 100, "word", 40.0 + 280 * (k % 2), 200.0 + 280 * (k % 2)) for k in range(40)]
    rows += [*gutter, (1, 100, "word", None, 100.0), (1, 100, "word", 400.0, None), (1, 100, "word", 400.0, 100.0), (1, 100, "word", 400.0, float("inf"))]
    out = layout.column_splits(spark.createDataFrame(rows, "doc_id long, page_number int, text string, x0 double, x1 double"), 612.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    assert {r.page_number: r.split for r in out.collect()} == {k: v for k, v in want.items() if v is not None} | {100: 260.0}
    assert sum(v is not None for v in want.values()) > 10


def test_documents_are_dealt_before_their_texts_are_made(spark):
    """The one exchange holds keys, over partitions enough for what is made of them."""
    from comparing import DATA
    from pageloom.functions.udf import PARTS
    from pageloom.plans import catalogue

    for query in (catalogue.adjacent_prefix_length, catalogue.adjacent_prefix_removed):
        out = query(spark, DATA)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(o_orderkey" in plan
        assert out.rdd.getNumPartitions() == PARTS


def test_page_metrics_meet_where_line_items_were_dealt(spark):
    from comparing import DATA
    from pageloom.functions.udf import PARTS
    from pageloom.plans import catalogue

    out = catalogue.image_coverage(spark, DATA)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == plan.count("Exchange hashpartitioning(") <= 3
    assert out.rdd.getNumPartitions() == PARTS
