"""Sources over small literal files."""

import random
import json

import pyarrow as pa
import pytest

from folioflow.sources import agendas, captions, listings, tables

SRV3 = b"""<?xml version="1.0"?><timedtext format="3"><body>
<p t="1000" d="2000"><s>Good</s><s t="400"> evening</s></p>
<p t="2500" d="500" a="1">
</p>
<p t="3000" d="1500">&gt;&gt; [clears throat]</p></body></timedtext>"""
VTT = """WEBVTT
Kind: captions

NOTE made by hand

00:01.000 --> 00:03.500 align:start
Call to &lt;order&gt; &#233;

intro
00:00:03.500 --> 00:00:05.000
two
lines
"""
ROLLING = """WEBVTT

00:00:00.000 --> 00:00:02.000 align:start
 
item<00:00:00.500><c> nine</c>

00:00:02.000 --> 00:00:02.010
item nine
 

00:00:02.010 --> 00:00:04.000
item nine
the<00:00:02.400><c> budget</c>
"""


def rows_of(spark, tmp_path, name, data, ending):
    (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return [tuple(r)[1:6] for r in captions.read_captions(spark, str(tmp_path), ending).orderBy("path", "line").collect()]


def test_timed_text(spark, tmp_path):
    got = rows_of(spark, tmp_path, "a.srv3", SRV3, ".srv3")
    assert [(a, b, c, d) for a, b, c, d, _ in got] == [(0, 1000, 3000, "Good evening"), (1, 3000, 4500, ">> [clears throat]")]
    assert [tuple(w) for w in got[0][4]] == [(1000, "Good"), (1400, "evening")]


def test_web_captions(spark, tmp_path):
    got = rows_of(spark, tmp_path, "a.vtt", VTT, ".vtt")
    assert [x[:4] for x in got] == [(0, 1000, 3500, "Call to <order> é"), (1, 3500, 5000, "two lines")]
    assert got[0][4] == []


def test_rolling_captions_say_each_word_once(spark, tmp_path):
    got = rows_of(spark, tmp_path, "b.vtt", ROLLING, ".vtt")
    assert [x[:4] for x in got] == [(0, 0, 2000, "item nine"), (1, 2010, 4000, "the budget")]
    assert [tuple(w) for w in got[1][4]] == [(2010, "the"), (2400, "budget")]


@pytest.mark.parametrize("data", [b" ", b"no xml", b"<timedtext/>", b"<timedtext><body><p d='1'>x</p></body></timedtext>"])
def test_malformed_files_give_no_lines(spark, tmp_path, data):
    (tmp_path / "bad.srv3").write_bytes(data)
    (tmp_path / "good.srv3").write_bytes(SRV3)
    kept = captions.read_captions(spark, str(tmp_path), ".srv3", keep_errors=True).collect()
    assert sorted((r["path"].rsplit("/")[-1], r["text"], r["error"] is None) for r in kept if r["path"].endswith("bad.srv3")) == [("bad.srv3", None, False)]
    assert sum(r["error"] is None for r in kept) == 2
    with pytest.raises(Exception, match="Malformed"):
        captions.read_captions(spark, str(tmp_path), ".srv3").collect()


@pytest.mark.parametrize("block", ["00:02.000 --> 00:01.000\nx", "00:xx --> 00:01.000\nx", "text alone"])
def test_malformed_cues(block):
    with pytest.raises(captions.Malformed):
        list(captions.web_captions(f"WEBVTT\n\n00:00.000 --> 00:01.000\na\n\n{block}\n".encode()))


def test_spoken_json(spark, tmp_path):
    body = {"segments": [{"start": 0.0005, "end": 1.2345, "text": "  Good   evening ", "speaker": " A ", "words": [{"start": 0.1, "end": 0.2, "text": "Good"}, {"start": 0.3, "end": 0.4, "text": " "}]}, {"start": 2, "end": 3, "text": "secret", "hidden": True}, {"start": 4, "end": 5, "text": " "}]}
    (tmp_path / "a.json").write_text(json.dumps(body))
    got = captions.read_spoken(spark, str(tmp_path)).collect()
    assert [(r["line"], r["start_ms"], r["end_ms"], r["text"], r["speaker"], [tuple(w) for w in r["words"]]) for r in got] == [(0, 1, 1235, "Good evening", "A", [(100, "Good")])]
    (tmp_path / "a.json").write_text('{"segments": [{"start": -1, "end": 1, "text": "x"}]}')
    with pytest.raises(Exception, match="no number of seconds"):
        captions.read_spoken(spark, str(tmp_path)).collect()


def test_captions_written_are_read_again(spark, tmp_path):
    lines = spark.createDataFrame([("a", 0, 0, 1500, "x & <y>"), ("a", 1, 1500, 3_600_000, "z")], "t string, line int, start_ms long, end_ms long, text string")
    content = captions.to_web_captions(lines, "t").first()["content"]
    assert [x[:3] for x in captions.web_captions(content.encode())] == [(0, 1500, "x & <y>"), (1500, 3_600_000, "z")]


def test_portal_meetings(spark):
    archived = [{"id": 5, "dateTime": "2026-09-08T19:00:00-06:00", "title": " City  Council ", "videoUrl": "", "documentList": [{"id": 1, "templateId": 7, "compileOutputType": 3, "templateName": "HTML Agenda"}, {"id": 2}]}, {"id": 6}, {"dateTime": "2026-09-08T19:00:00"}]
    upcoming = [{"id": 5, "dateTime": "2026-09-09T19:00:00", "title": "again"}, {"id": 9, "dateTime": "2026-10-01T18:00:00", "title": None, "documentList": None}]
    lists = spark.createDataFrame([(0, json.dumps(archived)), (1, json.dumps(upcoming))], "list_no int, value string")
    found = listings.portal_meetings(lists)
    assert sorted((r["meeting_id"], r["title"], r["video_url"], len(r["documents"])) for r in found.collect()) == [(5, "City Council", None, 1), (9, "", None, 0)]
    assert [tuple(r) for r in listings.portal_documents(found).collect()] == [(5, 1, 7, 3, "HTML Agenda", None)]


def test_channel_feed(spark, tmp_path):
    entry = "<entry><yt:videoId>{}</yt:videoId><yt:channelId>{}</yt:channelId><title>{}</title><published>2026-09-01T00:00:00+00:00</published></entry>"
    (tmp_path / "feed.xml").write_text('<?xml version="1.0"?><feed xmlns:yt="y" xmlns="a"><title>Town</title>' + entry.format("abc", "H5x", " One ") + entry.format("", "UCq", "none") + entry.format("def", "UCq", "Two") + "</feed>")
    got = listings.channel_feed(spark, str(tmp_path)).collect()
    assert sorted((r["video_id"], r["channel_id"], r["title"], r["source_method"]) for r in got) == [("abc", "UCH5x", "One", "rss"), ("def", "UCq", "Two", "rss")]


def test_playlists_and_api(spark):
    e = lambda i, **k: {"id": i, "title": i.upper(), **k}
    videos, streams = {"channel_id": "UC1", "entries": [e("a", duration=5.5), e("b")]}, {"channel_id": "UC1", "entries": [e("b", live_status="was_live", timestamp=0), {"title": "no id"}]}
    got = listings.flat_playlists(spark.createDataFrame([("videos", json.dumps(videos)), ("streams", json.dumps(streams))], "tab string, value string")).collect()
    assert sorted((r["video_id"], r["duration_s"], r["live_status"], r["published"]) for r in got) == [("a", 5.5, None, None), ("b", None, "was_live", "1970-01-01T00:00:00Z")]
    items = {"items": [{"contentDetails": {"videoId": "a"}, "snippet": {"title": "A", "channelId": "UC1", "publishedAt": "p"}}, {"contentDetails": {"videoId": "b", "videoPublishedAt": "q"}, "snippet": {"publishedAt": "p"}}, {"contentDetails": {}}]}
    facts = {"items": [{"id": "a", "snippet": {"liveBroadcastContent": "none"}, "contentDetails": {"duration": "PT1M5S"}}]}
    frame = lambda x: spark.createDataFrame([(json.dumps(x),)], "value string")
    got = listings.video_api(frame(items), frame(facts)).collect()
    assert sorted((r["video_id"], r["published"], r["duration_s"], r["live_broadcast_content"]) for r in got) == [("a", "p", 65.0, "none"), ("b", "q", None, None)]


def test_ladder(spark):
    def broken():
        raise OSError("no answer\nmore")

    rows, none = spark.range(2), spark.range(0)
    found = listings.ladder(spark, {"api": broken, "flat": lambda: none, "rss": lambda: rows, "never": broken})
    assert found.method == "rss" and [tuple(r)[1:] for r in found.attempts.orderBy("place").collect()] == [("api", "failed: no answer"), ("flat", "empty"), ("rss", "used")]
    with pytest.raises(LookupError):
        listings.ladder(spark, {"flat": lambda: none})


def test_sidecars(spark):
    rows = [("a", {"id": "x", "duration": 12, "subtitles": {"en": [{"ext": "vtt", "modified": "m"}]}, "automatic_captions": {"en": []}}), ("b", {"duration": "long", "automatic_captions": {"en-orig": [{"last_modified": 5, "modified": "n"}], "en": [{"modified": "o"}]}}), ("c", {"subtitles": {"fr": []}})]
    got = listings.sidecar_facts(spark.createDataFrame([(k, json.dumps(v)) for k, v in rows], "path string, value string")).orderBy("path").collect()
    assert [tuple(r) for r in got] == [("a", "x", "publisher", 12.0, "m"), ("b", None, "auto", None, "5"), ("c", None, None, None, None)]


AGENDA = """<html><meta charset="utf-8"><table>
<tr data-sectionid="1" data-videolocation="30"><td class="number-cell-section">1.</td><td class="x section-heading">Call&nbsp;to Order</td></tr>
<div data-sectionid="2"><td class="number-cell-section"> 9. </td><td class="section-heading">Consent<br class="paragraph-break"> a note</td>
<table class="meeting-item" data-videolocation="585021"><tr><td class="number-cell">B.</td><td><div class="agenda-item">Second <b>reading</b> of 5 &lt; 6<div class="item_contents">draft.pdf</div></div></td></tr></table>
<table class="meeting-item" data-videolocation="soon"><td class="number-cell"></td><td class="agenda-item">no number</td></table></div>
<div data-sectionid="3"><td class="section-heading">no number</td><div class="meeting-item"><td class="number-cell">A.</td><td class="agenda-item">Adjourn</td></div></div>"""


def test_html_agendas(spark):
    pages = spark.createDataFrame([(4, AGENDA), (5, None)], "page_id long, html string")
    from pyspark.sql import functions as F

    got = [tuple(r) for r in agendas.html_agendas(pages, "page_id", "html", F.lit(14_407)).orderBy("item_no").collect()]
    assert got == [(4, 0, "1.", "Call to Order", 30, "usable"), (4, 1, "9.", "Consent", None, "missing"), (4, 2, "9.B", "Second reading of 5 < 6", 585021, "outside_video"), (4, 3, "A", "Adjourn", None, "missing")]


@pytest.mark.parametrize(
    "data, declared, name",
    [(b"\xef\xbb\xbfx", "text/html; charset=latin-1", "utf-8-sig"), (b"\xff\xfex\x00", None, "utf-16"), (b"x", "text/html; charset='KOI8-R'", "koi8-r"), (b'<meta charset="cp1251">', None, "cp1251"), ("é".encode(), None, "utf-8"), (b"\xe9", None, "cp1252")],
)
def test_encodings(data, declared, name):
    assert agendas.encoding_of(data, declared) == name
    assert isinstance(agendas.decoded(data, declared), str)


def test_typed_rows_and_writes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, '{"a": "b"}', "[1]"), (2, 0, "broken", None)], "id long, open int, doc string, list string")
    got = tables.typed(rows, ["open"], {"doc": "map<string,string>", "list": "array<int>"}).orderBy("id").collect()
    assert [(r["open"], r["doc"], r["list"]) for r in got] == [(True, {"a": "b"}, [1]), (False, {}, [])]
    assert tables.row_of(rows, "id", 2).count() == 1 and tables.row_of(rows, "id", 3).count() == 0
    path = str(tmp_path / "t")
    assert tables.append_new(rows, path, "id").count() == 2
    more = spark.createDataFrame([(2, 0, "x", "y"), (3, 0, "x", "y"), (3, 0, "x", "y")], rows.schema)
    assert sorted(r["id"] for r in tables.append_new(more, path, "id").collect()) == [1, 2, 3]
    again = spark.createDataFrame([("m", 1), ("m", 2), ("n", 3)], "kind string, v int")
    tables.write_again(again, str(tmp_path / "p"), "kind")
    assert sorted(tuple(r) for r in tables.write_again(spark.createDataFrame([("m", 7)], again.schema), str(tmp_path / "p"), "kind").collect()) == [("m", 7), ("n", 3)]


def test_printed_agendas(spark):
    pages = ["Town Hall\n1.\nCALL TO ORD\nER\nnot capitals\n\n9.\nCONSENT AGENDA\nA.\nO-2026-74\n, A Bill for the 1\nst\nreading\n\nloose\nB.\n\nI.1.\nSub item\nTown Hall, September 8\nPage 1", "10.\n\nC.\nof ten\nAppendix\nD.\nnothing\n3.\nTables\xa0of water\r\n \nPage 2 of 3"]
    rows = spark.createDataFrame([(7, k, t) for k, t in enumerate(pages)], "record_id long, page int, text string")
    got = [tuple(r)[2:] for r in agendas.printed_agendas(rows, "record_id").orderBy("item_no").collect()]
    assert got == [("1.", "CALL TO ORDER"), ("9.", "CONSENT AGENDA"), ("9.A", "O-2026-74, A Bill for the 1st reading"), ("9.I.1", "Sub item"), ("10.C", "of ten"), ("3", "Tables of water")]


def test_plain_pages_are_walked_as_the_parser_does(monkeypatch):
    rng = random.Random(5)
    pieces = ['<div data-sectionid="1" data-videolocation="7">', '<div class="meeting-item" data-videolocation="soon">', '<td class="number-cell-section">3.</td>', '<td class="number-cell">A.', '<td class="agenda-item">', "</td>", "</div>"]
    pieces += ["R&nbsp;&amp; O", "&notit; x &#65", '<br class="paragraph-break">', '<span class="item_contents">', "</span>", '<td class="section-heading" >', "\n", "</div >", "</p>", '<b class="agenda-item" class="x">']
    odd = ["<!-- c -->", "<script>", "</script>", "<title>", "<br/>", "<", "a < b", "<DIV CLASS='x'>", '<i title="a>b">', '<i title="&amp;">', "</td x>", "<td", "&am", '<td class="a"b="c">', "<?x>", "<td checked>"]
    pages = ["".join(rng.choices(pieces, k=rng.randrange(30))) for _ in range(1500)] + ["".join(rng.choices(pieces + odd, k=rng.randrange(30))) for _ in range(1500)]
    got = [agendas.agenda_items(p) for p in pages]
    monkeypatch.setattr(agendas, "_plain", lambda *_: None)  # the parser walks every page
    assert got == [agendas.agenda_items(p) for p in pages] and sum(map(bool, got)) > 200


def test_plain_pages_need_no_parser(monkeypatch):
    page = '<div data-sectionid="1" data-videolocation="7"><td class="number-cell-section">3.</td><td class="section-heading">N &amp; F</td></div>'
    monkeypatch.setattr(agendas._Agenda, "feed", None)
    assert agendas.agenda_items(page) == [{"number": "3.", "title": "N & F", "seconds": 7}]


def test_lines_are_handed_over_by_column():
    lines = [(0, 5, "a b", [(0, "a"), (2, "b")], None), (7, 9, "c", [], "Chair")]
    assert captions._table(lines).to_pylist() == [dict(zip(("start_ms", "end_ms", "text", "words", "speaker"), x)) | {"words": [{"start_ms": t, "text": w} for t, w in x[3]]} for x in lines]
    assert captions._table([]).to_pylist() == []


def test_pages_are_decoded_in_slices(monkeypatch):
    monkeypatch.setattr(agendas, "HELD", 2)
    rows = [("é".encode(), None), (None, "text/html"), (b"\xff\xfe" + "ü".encode("utf-16-le"), None), (b"\xe9", "charset=latin-1"), (b"\xe9", None)]
    data, types = pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())
    assert agendas._decoded_pages(data, types).to_pylist() == ["é", None, "ü", "é", "é"]
    assert agendas._decoded_pages(data[:0], types[:0]).to_pylist() == []
