"""The recovery of paginated documents, engines, evaluation and the command line."""

import io
import json
import os
import sys
import zipfile
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pageloom import __main__ as cli
from pageloom.model import OCR_BLOCKS, WORDS
from pageloom.operators import admission, pages, report
from pageloom.plans import evaluate, recover
from pageloom.sources import engines, files

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this file
NATIVE = "This page has a text layer of good quality"


class Reader:
    """Pages from lines of JSON."""

    def pages(self, content):
        for line in content.decode().splitlines():
            yield {"width": 600.0, "height": 800.0, "text": "", "image_count": 0, "image_coverage_ratio": 0.0, "words": [], **json.loads(line)}


class Engine:
    model = "stub"

    def recognise(self, content, page_number, dpi, profile):
        if page_number == 9:
            raise OSError("no such page")
        return json.dumps({"res": {"rec_texts": [f" read {page_number} at {dpi}", ""], "rec_scores": [0.5, 0.9], "rec_polys": [[[1, 2], [30, 2], [30, 9], [1, 9]], []], "doc_preprocessor_res": {"angle": 90}}})


def words(text, top=100.0):
    return [{"text": w, "x0": 50.0 + 45 * k, "x1": 90.0 + 45 * k, "top": top, "bottom": top + 10, "upright": True} for k, w in enumerate(text.split())]


@pytest.fixture(scope="module")
def found(spark):
    """Document 1: a native, a scanned and an empty page; 2: a file that can't be read; 3: two pages of which one is not recognised."""
    one = [{"text_char_count": 40, "words": words(NATIVE)}, {"text_char_count": 0, "image_count": 1, "image_coverage_ratio": 0.9}, {"text_char_count": 0}]
    three = [{"text_char_count": 0, "image_count": 1, "image_coverage_ratio": 1.0}, {"text_char_count": 40, "image_count": 2, "image_coverage_ratio": 0.8, "words": words(NATIVE)}]
    rows = [(i, "\n".join(map(json.dumps, p)).encode()) for i, p in ((1, one), (3, three))] + [(2, b"no json")]
    pdfs = spark.createDataFrame(rows, "doc_id long, content binary")
    read = recover.settled(engines.read_pdfs(pdfs, Reader))
    classified = pages.classify(read.where("error IS NULL").select("doc_id", "page_number", "text_char_count", "image_count", "image_coverage_ratio"))
    native = recover.native_pages(engines.words_of(read), 600.0, 800.0, raw=read.where("error IS NULL").select("doc_id", "page_number", "text"))
    return pdfs, read, recover.settled(classified), recover.settled(native)


def test_files_that_cannot_be_read_have_an_error(found):
    _, read, classified, native = found
    assert [(r.doc_id, r.page_number) for r in read.where("error IS NOT NULL").collect()] == [(2, None)] and read.count() == 6
    assert recover.count_errors(classified, native).count() == 0
    assert [r.doc_id for r in recover.count_errors(classified, native.where("doc_id = 1 OR page_number = 1")).collect()] == [3]


def test_recovery_of_documents(spark, found):
    pdfs, _, classified, native = found
    wanted = recover.requests(recover.routed(classified, native))
    assert sorted(map(tuple, wanted.collect())) == [(1, 2), (3, 1)]
    raw = engines.recognise(pdfs, wanted.where("doc_id = 1"), Engine, "old_print").checkpoint()
    results = engines.results_of(raw)
    assert results.first().orientation_degrees == 90
    from pageloom.operators import ocr

    models = raw.select("doc_id", "page_number", "recognition_model", "preprocessing_profile")
    out = recover.recover(classified, native, recover.recognised(ocr.blocks_of(results), models)).checkpoint()
    docs = {r.doc_id: r for r in recover.documents(out, "old_print").collect()}
    assert docs[1].text == f"{NATIVE}\n\nread 2 at 300\n" and (docs[1].native_page_numbers, docs[1].ocr_page_numbers, docs[1].empty_page_numbers) == ([1], [2], [3])
    assert docs[1].document_kind == "mixed" and docs[1].error is None and docs[1].warnings[0] == recover.OLD_PRINT and "第 2 页有 1 个 OCR 文字块置信度低于 0.60。" in docs[1].warnings
    assert docs[3].error == "第 1 页没有 OCR 结果。" and docs[3].text == "" and docs[3].image_count == 3
    page = {(r.doc_id, r.page_number): r for r in out.collect()}
    assert page[1, 2].recognition_model == "stub" and page[1, 2].ocr_mean_confidence == 0.5 and any(recover.PICTURES_LEFT in w for w in page[3, 2].warnings)
    told = {r.doc_id: r.details for r in recover.details(recover.documents(out), out).collect()}
    assert told[1].page_count == 3 and [p.source for p in told[1].pages] == ["native", "ocr", "empty"] and told[1].skipped_empty_page_numbers == [3]


def test_sums_of_documents(spark):
    schema = "doc_id long, page_number int, source string, text string, kind string, image_count int, native_quality_score double, ocr_mean_confidence double, column_count int, structured_table_count int, complex_table_count int, table_fallback_count int, warnings array<string>, error string"
    rows = [(1, n, "native", f"t{n}", "text", n, 1.0, None, 1 + n % 2, n, 1, 0, [f"w{n % 2}"], None) for n in (3, 1, 2)]
    d = recover.documents(spark.createDataFrame(rows, schema)).first()
    assert (d.structured_table_count, d.complex_table_count, d.image_count, d.double_column_page_numbers, d.warnings, d.text) == (6, 3, 6, [1, 3], ["w1", "w0"], "t1\n\nt2\n\nt3\n")


def test_page_requests(spark):
    cases = [([1, 2], None), ([], recover.NO_PAGES), (None, recover.NO_PAGES), ([0, 1], recover.FROM_ONE), ([1, 1], recover.REPEATED), ([2, 1], recover.ASCENDING), ([1, 9], "PDF 仅有 5 页，不存在第 9 页。")]
    df = spark.createDataFrame([(k, p, 5) for k, (p, _) in enumerate(cases)], "k int, p array<int>, n int")
    assert [r.e for r in df.select("k", recover.request_error(F.col("p"), F.col("n")).alias("e")).orderBy("k").collect()] == [e for _, e in cases]


def test_engine_failures_are_rows(spark, found):
    out = engines.recognise(found[0], spark.createDataFrame([(1, 9), (1, 1)], "doc_id long, page_number int"), Engine).orderBy("page_number").collect()
    assert out[0].error is None and out[1].error == "OSError: no such page" and engines.results_of(spark.createDataFrame(out, engines.RESULT)).count() == 1
    with pytest.raises(ValueError):
        engines.recognise(found[0], found[0], Engine, "other")
    with pytest.raises(RuntimeError):
        engines.PdfPlumberReader()


def test_payloads_at_the_top(spark):
    raw = spark.createDataFrame([(1, 1, json.dumps({"rec_texts": ["a"], "dt_polys": [[[0, 0], [1, 1]]]}), "m", "standard", None)], engines.RESULT)
    r = engines.results_of(raw).first()
    assert (r.texts, r.scores, r.polygons, r.orientation_degrees) == (["a"], [], [[[0.0, 0.0], [1.0, 1.0]]], None)


def test_prepared_pictures_and_environment(tmp_path):
    gray = np.full((5, 5), 200, np.uint8)
    gray[2, 2] = 0
    assert engines.prepared(gray, "standard") is gray and (engines.prepared(gray, "old_print") == 200).all()
    state = engines.environment(tmp_path)
    assert not state["ready"] and state["missing_models"] == list(engines.MODELS) and str(engines.model_root(str(tmp_path))) == str(tmp_path.resolve())


def test_objects_of_pdfs(spark):
    packed = zlib.compress(b"7 0 8 10 " + b"<<>> <<>>")
    pdf = b"%PDF-1.5\n1 0 obj<<>>endobj\n2 0 obj<<>>endobj\n2 0 obj<<>>endobj\n3 0 obj<</Type /ObjStm /N 2 /First 9 /Filter /FlateDecode>>stream\n" + packed + b"\nendstream endobj\n%%EOF"
    out = spark.createDataFrame([(1, pdf), (2, b"no"), (3, None)], "k int, c binary").select("k", admission.pdf_object_count("c").alias("n")).orderBy("k")
    assert [r.n for r in out.collect()] == [5, None, None]
    assert out.select(admission.object_count_error(F.col("n"), admission.PdfLimits(objects=4)).alias("e")).first().e == "PDF 间接对象过多：5，上限为 4。"


def test_pictures_of_documents(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/media/image1.png", b"png")
        z.writestr("word/document.xml", b"<x/>")
    rows = [(1, "a", buffer.getvalue()), (2, "a", buffer.getvalue()), (3, "b", b"broken"), (4, "c", None)]
    out = sorted((r.doc_id, r.rel_path, bytes(r.content)) for r in files.media(spark.createDataFrame(rows, "doc_id long, stem string, content binary")).collect())
    assert out == [(1, "a_assets/media/image1.png", b"png"), (2, "a_assets_2/media/image1.png", b"png")]


def test_overview_and_preview(spark):
    jobs = spark.createDataFrame([("a.txt", "a.md", "txt", "markdown", False, None, []), ("b.md", "b.md", "markdown", "markdown", True, None, []), ("c.x", "c.md", None, "markdown", False, "bad", [])], "source_file string, target_file string, source_format string, target_format string, skipped boolean, error string, warnings array<string>")
    out = report.overview(report.finish(jobs)).collect()
    assert len(out[0]) == 12 and [r["状态"] for r in out] == ["成功", "已跳过", "失败"] and [r["输出文件"] for r in out] == ["a.md", "—", "—"] and out[2]["错误"] == "bad"
    shown = report.preview(spark.createDataFrame([("a.txt", 2048, "txt"), ("b", 1, None)], "file_name string, length long, source_format string"), F.lit("txt")).collect()
    assert [tuple(r) for r in shown] == [("a.txt", "TXT", "2.0 KB", report.SAME), ("b", "unknown", "1 B", report.WAITING)]


def test_shown_sizes_round_ties_to_even(spark):
    sizes = [0, 1023, 1024, 1280, 1792, 2304, 256 * 4097, 1048575, 1048576, 1310720, 1835008, 3407872, 52428800 + 262144]
    shown = spark.createDataFrame([(n,) for n in sizes], "n long").select(report.shown_size(F.col("n"))).collect()
    python = [f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1048576 else f"{n / 1048576:.1f} MB" for n in sizes]
    assert [r[0] for r in shown] == python


def test_formal_scores(spark):
    reference = spark.createDataFrame([(1, 1, "abcdefghij"), (1, 2, "klm nop"), (2, 1, "x"), (3, 1, "abcdefghij")], "doc_id long, page_number int, text string")
    output = spark.createDataFrame([(1, 1, "abcdefghiX\n", "m2", "standard"), (1, 2, "klmnop", "m1", "standard"), (2, 1, "x", None, None), (2, 2, "y", None, None), (3, 1, "abc", "m", "standard")], "doc_id long, page_number int, text string, recognition_model string, preprocessing_profile string")
    each, totals = evaluate.formal_score(reference, output)
    t = {r.doc_id: r for r in totals.collect()}
    assert (t[1].edit_distance, t[1].reference_characters, t[1].recognition_models, t[1].passes_release_gate) == (1, 16, ["m1", "m2"], True) and t[2].error == evaluate.PAGES_DIFFER and not t[3].passes_release_gate
    out = {r.doc_id: r for r in evaluate.score_report(each, totals).collect()}
    assert {k: r.exit_code for k, r in out.items()} == {1: 0, 2: 1, 3: 2} and len(json.loads(out[1].json)["pages"]) == 2 and out[2].json is None


def test_acceptance_of_samples(spark):
    good = b"%PDF-1 good"
    import hashlib

    thresholds = "expected_page_count int, expected_pdf_kind string, expected_native_pages int, expected_ocr_pages int, expected_empty_pages int, min_output_characters int, min_cjk_characters int, min_latin_characters int, min_structured_tables int, min_complex_tables int, min_ocr_mean_confidence double, required_warning_contains string"
    rest = (1, "text", None, None, None, 3, None, 2, None, None, None, None)
    samples = spark.createDataFrame([(i, f"{i}.pdf", hashlib.sha256(good).hexdigest(), len(good), *rest) for i in "abc"], f"id string, filename string, sha256 string, file_size long, {thresholds}")
    there = spark.createDataFrame([("a.pdf", good), ("b.pdf", good), ("c.pdf", b"other")], "file_name string, content binary")
    reports = spark.createDataFrame([(i, text, True, None, 1, "text", 1, 0, 0, 0, 0, None, []) for i, text in (("a", "fine 中"), ("b", "1"))], "id string, text string, success boolean, error string, page_count int, pdf_kind string, native_pages int, ocr_pages int, empty_pages int, structured_table_count int, complex_table_count int, mean_confidence double, warnings array<string>")
    records = evaluate.acceptance(samples, there, reports)
    out = {r.id: r for r in records.collect()}
    assert (out["a"].status, out["a"].output_characters, out["a"].language_metrics.cjk_characters) == ("passed", 6, 1) and len(out["b"].failures) == 2 and out["c"].status == "failed" and out["c"].report is None
    whole = evaluate.acceptance_report(records, F.lit("run")).first()
    body = json.loads(whole.json)
    assert whole.exit_code == 1 and (body["sample_count"], body["automated_passed"], body["run_id"]) == (3, 1, "run") and [r["id"] for r in body["records"]] == ["a", "b", "c"]


def test_resolutions(spark):
    wanted = evaluate.resolutions(spark, [200, 150, 200])
    assert [r.name for r in wanted.collect()] == ["150ppi-200dpi", "150ppi-150dpi", "300ppi-200dpi", "300ppi-150dpi"]
    with pytest.raises(ValueError):
        evaluate.resolutions(spark, [71])
    truth = spark.createDataFrame([(["Name", "Qty"], [["a1", "b1"], ["a2", "b2"]])], "headers array<string>, rows array<array<string>>")
    results = wanted.select("name", F.lit("m").alias("recognition_model"), F.lit("Name\tQty\na1\tb1\na2\tb2").alias("text"), F.lit(3).alias("line_count"), F.lit(0.9).alias("mean_confidence"), F.lit(1.0).alias("duration_seconds"))
    out = evaluate.resolution_report(wanted, results, truth).collect()
    assert len(out) == 4 and all(r.matched_cells == r.total_cells == 6 and r.row_order_ok for r in out)


def test_names_of_runs(spark):
    r = spark.sql("SELECT timestamp'2026-01-02 03:04:05.678901' AS t").select(evaluate.run_id(F.col("t")).alias("a"), evaluate.batch_name(F.col("t")).alias("b"), evaluate.generated_at(F.col("t")).alias("c")).first()
    assert tuple(r) == ("20260102-030405-678901", "20260102_030405", "2026-01-02T03:04:05Z")


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("HOME", str(tmp_path))
    (tmp_path / "a.txt").write_text("第1章 Title\n\nSome text here.\n")
    (tmp_path / "b.xyz").write_text("?")
    out = tmp_path / "out"
    assert cli.main([str(tmp_path / "a.txt"), "--to", "markdown", "--output", str(out)], spark) == 0
    assert json.loads(capsys.readouterr().out)["success"] == 1 and (out / "a.md").read_text().startswith("# ")
    assert cli.main([str(tmp_path / "a.txt"), str(tmp_path / "b.xyz"), "--to", "markdown", "--output", str(out)], spark) == 1
    assert sorted(os.listdir(out)) == ["a.md", "a_1.md"]
    assert cli.main([str(tmp_path / "a.txt"), "--to", "txt", "--output", "/"], spark) == 2 and cli.main([str(tmp_path / "none"), "--to", "txt", "--output", str(out)], spark) == 2


def test_schemas_match(found, spark):
    assert {x.split()[0] for x in WORDS.split(", ")} == set(engines.words_of(found[1]).columns) and "has_geometry" in OCR_BLOCKS
