import datetime as dt
import json
import zipfile

from tessella.operators import cache
from tessella.plans import answering, report
from tessella.sources import files


def test_report_and_command(spark, small, tmp_path):
    terms = tmp_path / "terms.txt"
    terms.write_text("урок\nquaternion\n")
    out = report.main(["--documents", f"{small}/documents.parquet", "--records", f"{small}/document_records.parquet", "--terms-file", str(terms), "--output-dir", str(tmp_path / "texts"), "--report-dir", str(tmp_path / "r"), "--max-files", "60"])
    told = out["documents"]
    assert told["total_candidates"] == 100 and told["processed"] == 60 and told["unique"] <= 60 and out["db_available"]
    assert told["token_stats"]["n"] == told["unique"] == spark.read.json(out["document_details"]).count()
    assert len(out["quality_metrics"]) == 16 and out["term_coverage"]["missing"] == ["quaternion"]
    assert json.load(open(tmp_path / "r/eda_report.json"))["documents"]["unique"] == told["unique"]
    assert (tmp_path / "r/eda_dashboard.html").stat().st_size > 1000
    assert spark.read.parquet(str(tmp_path / "texts")).count() == told["unique"]


def office_file(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, lines in parts.items():
            z.writestr(name, "<r xmlns:w='urn:w'>" + "".join(f"<w:p><w:t>{x}</w:t></w:p>" for x in lines) + "</r>")


def test_report_over_folders(spark, tmp_path):
    d = tmp_path / "in" / "sub"
    d.mkdir(parents=True)
    office_file(d / "a.docx", {"word/document.xml": ["School museum", "opens on Tuesday"]})
    office_file(d / "b.pptx", {"ppt/slides/slide10.xml": ["last"], "ppt/slides/slide2.xml": ["first"], "ppt/slides/slide3.xml": [" "]})
    office_file(d / "copy.DOCX", {"word/document.xml": ["School museum", "opens on Tuesday"]})
    office_file(d / "blank.docx", {"word/document.xml": []})
    (d / "broken.pptx").write_bytes(b"no zip")
    (d / "other.txt").write_text("not a document kind")
    out = report.main(["--input-dirs", str(tmp_path / "in"), "--output-dir", str(tmp_path / "t"), "--report-dir", str(tmp_path / "r"), "--log-level", "ERROR"])
    told = out["documents"]
    assert (told["total_candidates"], told["processed"], told["unique"], told["duplicates"], out["errors_total"]) == (5, 5, 2, 1, 2)
    assert told["language_distribution"] == {"unknown": 2} and told["duplicate_ratio"] == 0.2
    assert sorted(r["error"].split(":")[0] for r in out["error_samples"]) == ["empty_after_clean", "extract_failed"]
    assert {r.clean for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"School museum\nopens on Tuesday", "first\nlast"}
    pages = files.loaded_pages(files.scan_files(spark, [str(tmp_path / "in")]))
    assert sorted((r.path.rsplit("/")[-1], r.page, r.text) for r in pages.where("error is null").collect()) == [("a.docx", 0, "School museum\nopens on Tuesday"), ("b.pptx", 0, "first"), ("b.pptx", 2, "last"), ("copy.DOCX", 0, "School museum\nopens on Tuesday")]
    assert [r.path.rsplit("/")[-1] for r in pages.where("error is not null").collect()] == ["broken.pptx"]


def test_report_names_every_source(spark):
    docs = spark.createDataFrame([(i, f"text number {i}", "en", f"s{i}") for i in range(230)], "doc_id long, text string, lang string, source string")
    got = report.corpus_report(docs)["classification_summary"]
    assert {r["value"] for r in got if r["field"] == "source"} == {f"s{i}" for i in range(230)}


def test_report_of_nothing(spark):
    out = report.corpus_report(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert out["documents"]["unique"] == 0 and out["documents"]["char_stats"] == {} == out["documents"]["chunk_size_stats"] and out["tfidf_top_features"] == []
    assert all(m["value"] == 0 for m in out["quality_metrics"])


def test_shown():
    assert report.shown("duplicate_ratio", 0.1234) == "12.34%" and report.shown("unique_token_count", 12345.0) == "12 345" and report.shown("avg_tokens_per_chunk", 1234.56) == "1 234.6"


def test_answering(spark, as_rows):
    t = dt.datetime(2024, 1, 1)
    stored = [(1, "Known?", "from cache", [], "m", [1.0, 0.0], t)]
    state = cache.upserted(cache.keyed(spark.createDataFrame(stored, "id long, question string, answer string, files array<string>, model string, embedding array<double>, created_at timestamp")))
    asked = spark.createDataFrame([(1, " known? ", "M", None), (2, "like it", "m", [1.0, 0.01]), (3, "river maps", "m", None), (4, "zzz", "m", None), (5, None, None, None)], "ask_id long, question string, model string, embedding array<double>")
    docs = spark.createDataFrame([(1, "maps of the river", "s"), (2, "other", None)], "doc_id long, text string, source string")
    got = as_rows(answering.answered(asked, state, docs, lambda c: f"<{c}>"))
    none = answering.NOTHING_FOUND
    assert got == [(1, "from cache", "exact"), (2, "from cache", "similar"), (3, "<[s] maps of the river>", "generated"), (4, none, "none"), (5, none, "none")]


def test_generation_retries_and_errors(spark, as_rows):
    prompts = spark.createDataFrame([(1, "bad"), (2, "cjk"), (3, "ok")], "ask_id long, context string")

    def generate(c):
        if c == "bad":
            raise ValueError("no")
        return "漢字" if c == "cjk" else "fine"

    answers = answering.generated(prompts, generate)
    assert as_rows(answers) == [(1, "generation_failed: no"), (2, "漢字"), (3, "fine")]
    assert as_rows(answering.previews(answers).select("ask_id", "foreign")) == [(1, False), (2, True), (3, False)]
