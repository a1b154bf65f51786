"""Saved answers as a data source: batch, filters that leave files out, streams, and files that fail."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.sources import answers
from folioflow.sources.listings import portal_documents, portal_meetings


def meeting(i, title="Council", **more):
    return {"id": i, "dateTime": "2026-09-08T19:00:00", "title": title, "videoUrl": "", "documentList": [{"id": 5, "templateId": 7, "compileOutputType": 1, "templateName": "Agenda"}]} | more


@pytest.fixture()
def folder(tmp_path):
    lists = {
        "a/2026-01.json": [meeting(1), meeting(2, dateTime=None), meeting(3, "  Two   blanks ")],
        "a/2026-02.json": [meeting(1, "again"), meeting(4, documentList=[{"id": 9}])],
        "site=b/2026-01.json": [meeting(1, "other site")],
    }
    for name, rows in lists.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(rows))
    (tmp_path / "a/2026-03.json").write_text("{not json")
    (tmp_path / "site=b/2026-02.json").write_text('{"error": "closed"}')
    (tmp_path / "site=b/empty.json").write_text("[]")
    (tmp_path / "a/agenda.pdf").write_bytes(b"%PDF")
    (tmp_path / "a/.hidden.json").write_text("[]")
    (tmp_path / "a/_SUCCESS").write_text("")
    return tmp_path


def test_meetings_are_those_of_the_portal_reader(spark, folder):
    rows = answers.answers(spark, str(folder))
    assert {(r.site, r.file, r.list_no, r.error is None) for r in rows.collect()} == {("a", "a/2026-01.json", 0, True), ("a", "a/2026-02.json", 1, True), ("a", "a/2026-03.json", 2, False), ("b", "site=b/2026-01.json", 0, True), ("b", "site=b/2026-02.json", 1, False), ("b", "site=b/empty.json", 2, True)}
    found = answers.listed_meetings(spark, str(folder))
    assert {(r.site, r.meeting_id, r.title, len(r.documents)) for r in found.collect()} == {("a", 1, "Council", 1), ("a", 3, "Two blanks", 1), ("a", 4, "Council", 0), ("b", 1, "other site", 1)}
    one = spark.createDataFrame([(0, (folder / "a/2026-01.json").read_text()), (1, (folder / "a/2026-02.json").read_text())], "list_no int, value string")
    assert sorted(map(str, portal_meetings(one).collect())) == sorted(map(str, answers.listed_meetings(spark, str(folder), ["a"]).drop("site").collect()))
    assert portal_documents(found.where("site = 'b'")).count() == 1


def test_filters_leave_files_out(spark, folder):
    """A file that is filtered out isn't opened: it may be gone."""
    reader = answers._Reader(str(folder), "meetings")
    left = list(reader.pushFilters([answers.EqualTo(("site",), "a"), answers.GreaterThan(("file",), "a/2026-01.json"), answers.EqualTo(("list_no",), 1)]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and [p.value[1] for p in reader.partitions()] == ["a/2026-02.json", "a/2026-03.json"]
    rows = answers.answers(spark, str(folder)).where((F.col("site") == "b") & (F.col("list_no") == 0))
    assert [r.file for r in rows.collect()] == ["site=b/2026-01.json"]
    assert rows.rdd.getNumPartitions() == 3 and answers.answers(spark, str(folder)).rdd.getNumPartitions() == 6


def test_documents_and_health(spark, folder):
    docs = answers.answers(spark, str(folder), "documents").collect()
    assert [(r.site, r.file, bytes(r.content), r.sha256[:8], r.error) for r in docs] == [("a", "a/agenda.pdf", b"%PDF", __import__("hashlib").sha256(b"%PDF").hexdigest()[:8], None)]
    health = {r.file: (r.ok, r.meetings_found) for r in answers.answers(spark, str(folder), "health").collect()}
    assert health == {"a/2026-01.json": (True, 3), "a/2026-02.json": (True, 2), "a/2026-03.json": (False, 0), "site=b/2026-01.json": (True, 1), "site=b/2026-02.json": (False, 0), "site=b/empty.json": (False, 0)}
    assert answers.answers(spark, str(folder / "nowhere")).count() == 0
    with pytest.raises(Exception, match="needs a path"):
        answers.answers(spark, str(folder), "nonsense").count()


def test_a_stream_gives_the_rows_of_the_batch(spark, folder, tmp_path_factory):
    spark.dataSource.register(answers.MeetingAnswers)
    point = str(tmp_path_factory.mktemp("answers") / "cp")

    out = str(tmp_path_factory.mktemp("answers") / "out")

    def run():
        rows = spark.readStream.format("meeting_answers").option("path", str(folder)).option("what", "meetings").option("maxFiles", "2").load()
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", point).start()
        query.processAllAvailable()
        query.stop()
        return spark.read.parquet(out).select("site", "file", "value").collect()

    first = run()
    assert sorted(map(str, first)) == sorted(map(str, answers.answers(spark, str(folder)).select("site", "file", "value").collect()))
    Path(folder / "a/zz.json").write_text(json.dumps([meeting(9)]))
    more = run()  # goes on after the last offset
    assert len(more) == len(first) + 1 and {r.file for r in more} - {r.file for r in first} == {"a/zz.json"}
