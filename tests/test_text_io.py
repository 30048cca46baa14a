import pytest
from conftest import rows
from pyspark.sql import functions as F

from canvass.functions import ranking
from canvass.operators import dictionary as dc
from canvass.operators import text as tx
from canvass.operators.filters import SurveyParams
from canvass.sources import readers, writers


@pytest.mark.parametrize("parts, batch", [(1, 2), (4, 3), (2, 100)])
def test_failures_touch_only_their_answer(spark, parts, batch):
    def shout(texts):
        if "bad" in texts:
            raise RuntimeError("refused")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(9)] + [(9, None)], "id int, t string")
    got = {r.id: (r.result, r.error) for r in tx.enrich_text(df.repartition(parts), "id", "t", shout, batch).collect()}
    assert got[3] == (None, "refused")
    assert len(got) == 9 and all(got[i] == (f"T{i}", None) for i in got if i != 3)


def test_wrong_number_of_results_is_not_shifted(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "id int, t string").coalesce(1)
    got = {r.id: r.result for r in tx.enrich_text(df, "id", "t", lambda texts: [texts[0]], 4).collect()}
    assert got == {i: f"t{i}" for i in range(4)}


def test_two_header_export(spark, tmp_path):
    lines = ["Status,Q1,Q2", "Response status,\"Name, of venue\",Capacity", "IP Address,Club,100", "IP Address,,20"]
    (tmp_path / "export.csv").write_text("\n".join(lines))
    data, labels = readers.read_two_header(spark, str(tmp_path / "export.csv"))
    assert rows(data) == [("IP Address", "Club", "100"), ("IP Address", None, "20")]
    assert rows(labels) == [("Q1", "Name, of venue"), ("Q2", "Capacity"), ("Status", "Response status")]


def test_csv_nulls_are_empty(spark, tmp_path):
    df = spark.createDataFrame([("a", None), (None, 2)], "x string, y int").coalesce(1)
    writers.write_csv(df, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert sorted(text.split("\n")) == sorted(["x,y", "a,", ",2", ""])


def test_directory_of_files_is_tagged(spark, tmp_path):
    for name in ("fi", "lt"):
        spark.createDataFrame([(name, 1)], "a string, b int").coalesce(1).write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    paths = {n: str(tmp_path / "in" / f"{n}.parquet") for n in ("fi", "lt")}
    got = readers.read_survey_files(spark, paths, columns={"fi": {"a": "x"}, "lt": {"a": "x", "b": "y"}})
    assert rows(got.select("source", "x", "y")) == [("fi", "fi", None), ("lt", "lt", 1)]


def test_folder_of_surveys_is_tagged(spark, tmp_path):
    for name in ("fi.csv", "lt.csv"):
        spark.createDataFrame([(name, 1)], "a string, b int").repartition(2).write.csv(str(tmp_path / "in" / name), header=True)
    (tmp_path / "in" / "ua.csv").write_text("a,b\nx,2\n")
    got = readers.read_surveys(spark, str(tmp_path / "in"), "csv", "a string, b int", "*.csv")
    assert rows(got) == [("fi.csv", 1, "fi"), ("lt.csv", 1, "lt"), ("x", 2, "ua")]


def test_extract_and_csv_rename(spark, tmp_path):
    df = spark.createDataFrame([("A", "f", 1), ("B", "f", 2), ("A", None, 3)], "city string, gender string, v int")
    writers.export_extract(df, SurveyParams(("A",), ("total",), ("f", "m")), str(tmp_path / "x"))
    back = readers.read_csv_renamed(spark, str(tmp_path / "x"), "city string, gender string, v int", {"v": "Value (EUR)"})
    assert back.columns == ["city", "gender", "Value (EUR)"] and rows(back) == [("A", "f", 1)]


def levels(spark):
    return spark.createDataFrame(
        [("q1", 1, "Yes"), ("q1", 2, "No"), ("tick", 1, "Chosen"), ("odd", 1, "One")], "variable string, code int, label string")


def survey(spark):
    return spark.createDataFrame([(1, 1, 5, 2.5, "a"), (2, None, 1, None, ""), (2, 0, 0, 1.5, None)],
                                 "q1 int, tick int, odd int, amount double, open string")


def test_question_types(spark):
    got = {r.variable: r.qtype for r in dc.infer_qtype(survey(spark), levels(spark)).collect()}
    assert got == {"q1": "single choice", "tick": "multiple (dichotomous)", "odd": "unknown",
                   "amount": "numeric/open", "open": "text"}


def test_profile(spark):
    got = {r.variable: r for r in dc.profile(survey(spark)).collect()}
    assert (got["amount"].valid, got["amount"].missing, got["amount"].mean) == (2, 1, 2.0)
    assert got["open"].type == "character" and got["open"].min is None
    cats = {(r.variable, r.code): (r.label, r.n) for r in dc.profile_categories(survey(spark), levels(spark), ["q1", "tick"]).collect()}
    assert cats == {("q1", "1"): ("Yes", 1), ("q1", "2"): ("No", 2), ("tick", "1"): ("Chosen", 1), ("tick", "0"): (None, 1)}


def test_questionnaire(spark, tmp_path):
    spec = dc.questionnaire(survey(spark), {"q1": "Live here?"}, levels(spark))
    blocks = {r.variable: r.block for r in dc.questionnaire_blocks(spec).collect()}
    assert blocks["q1"] == "## q1\n**Question:** Live here?\n**Type:** single choice\n**Options:**\n- Yes [1]\n- No [2]\n\n---\n"
    assert "Options" not in blocks["open"]
    writers.write_questionnaire(spec, str(tmp_path / "q"))
    text = next((tmp_path / "q").glob("part-*")).read_text()
    assert text.startswith("# Questionnaire\n") and text.index("## q1") < text.index("## tick") < text.index("## open")
    same = spec.withColumn("question", F.when(F.col("position") < 2, "Same?").otherwise(F.col("question")))
    grouped = {r.variable: (r.variables_in_group, r.has_multiple) for r in dc.group_by_question(same).collect()}
    assert grouped["tick"] == ("q1, tick", True) and grouped["open"] == ("open", False)


def test_codebook_xml(spark, tmp_path):
    df = survey(spark)
    elements = writers.codebook_elements(dc.profile(df), dc.profile_categories(df, levels(spark), ["q1"]), {"q1": "Live here?"})
    writers.write_codebook_xml(elements, str(tmp_path / "xml"))
    text = "".join(p.read_text() for p in (tmp_path / "xml").glob("part-*"))
    assert text.count("<var name=") == 5
    assert "<labl>Live here?</labl>" in text and '<catStat type="freq">2</catStat>' in text


def test_tables_by_name(spark, tmp_path):
    paths = writers.write_tables({"one": spark.range(3), "two": spark.range(2)}, str(tmp_path))
    assert {n: spark.read.parquet(p).count() for n, p in paths.items()} == {"one": 3, "two": 2}


def test_labels_may_hold_the_separator(spark):
    df = spark.createDataFrame([(1,), (2,)], "q int")
    levels = spark.createDataFrame([("q", 1, "A | B"), ("q", 2, "C")], "variable string, code int, label string")
    spec = dc.questionnaire(df, {}, levels)
    assert spec.first()["options"] == "A | B [1] | C [2]"
    assert "**Options:**\n- A | B [1]\n- C [2]\n" in dc.questionnaire_blocks(spec).first()["block"]


def test_enrichment_goes_on_after_a_stop(spark, tmp_path):
    """Texts that have a result are not sent again; failing ones are, up to the bound; calls keep their pace."""
    calls, stop, ledger = tmp_path / "calls", tmp_path / "stop", str(tmp_path / "ledger")
    calls.mkdir()
    stop.touch()

    def send(texts):
        import os
        import uuid
        (calls / uuid.uuid4().hex).write_text("\n".join(texts))
        if stop.exists() and "t33" in texts:
            os._exit(1)  # as if the machine went away
        if "bad" in texts:
            raise ValueError("no")
        return [t + "!" for t in texts]

    rows = [(i, f"t{i % 50}") for i in range(120)] + [(200, "bad"), (201, None), (202, "bad")]
    df = spark.createDataFrame(rows, "id int, t string").repartition(2)
    with pytest.raises(Exception):  # noqa: B017
        tx.enrich_resumable(df, "id", "t", send, ledger, batch=3, parts=8)
    sent = lambda: [t for f in calls.iterdir() for t in f.read_text().split("\n")]
    done = {r.text for r in spark.read.parquet(ledger).join(df.selectExpr("sha2(t, 256) digest", "t text").distinct(), "digest").where("error IS NULL").collect()}
    assert 0 < len(done) < 50
    for f in list(calls.iterdir()):
        f.unlink()
    stop.unlink()
    out = tx.enrich_resumable(df, "id", "t", send, ledger, batch=3, parts=8, rate=200.0, burst=2)
    assert sorted((r.id, r.result, r.error) for r in out.collect()) == sorted([(i, f"t{i % 50}!", None) for i in range(120)] + [(200, None, "no"), (202, None, "no")])
    again = sent()
    assert not done & set(again) and {f"t{k}" for k in range(50)} - done <= set(again)
    for f in list(calls.iterdir()):
        f.unlink()
    tx.enrich_resumable(df, "id", "t", send, ledger, batch=3, parts=8).count()
    assert not list(calls.iterdir())


def test_pace():
    import time
    pace, start = tx.Pace(50.0, 2), time.monotonic()
    for _ in range(12):
        pace.take()
    assert 0.18 < time.monotonic() - start < 0.6


def test_group_ids_write_no_text(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", 4), ("", 5), (None, 6)], "t string, id int")
    out = ranking.group_ids(df, "t")
    assert out.columns == ["t", "id", "group_id"]
    assert sorted((r.id, r.group_id) for r in out.collect()) == [(1, 3), (2, 2), (3, None), (4, 3), (5, 1), (6, None)]


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from canvass.session import shared_dir
    fake = lambda master, path: SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: {"spark.checkpoint.dir": path, "spark.sql.warehouse.dir": "file:/w"}.get(key) or default),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    assert shared_dir(fake("local[8]", None)) == "file:/w/_scratch" and shared_dir(fake("yarn", "s3://x/")) == "s3://x"
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://m:7077"):
        with pytest.raises(RuntimeError):
            shared_dir(fake(master, None))
