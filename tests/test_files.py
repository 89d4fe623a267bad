"""Sources, sinks and streams: what may go wrong with files."""

from __future__ import annotations

import json

import pytest

from ledgerlens import sinks, sources, streaming


def put(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_manifest_skips_blank_lines_and_refuses_broken_ones(spark, tmp_path):
    assert sources.read_manifest(spark, put(tmp_path / "a.jsonl", '{"x": 1}\n\n{"x": 2}\n'), "x long").count() == 2
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        sources.read_manifest(spark, put(tmp_path / "b.jsonl", '{"x": 1}\n{"x": \n'), "x long").collect()


def test_cache_last_line_wins_and_corruption_rejects_all(spark, tmp_path):
    good = '{"_meta": true, "data": "d1"}\n{"image": "a", "pred": "1"}\n\n{"image": "b", "pred": " "}\n{"image": "a", "pred": "2"}\n'
    rows, meta, usable = sources.read_cache(spark, put(tmp_path / "a.jsonl", good), "image string, pred string")
    assert usable and {(r["image"], r["pred"]) for r in rows.collect()} == {("a", "2"), ("b", " ")} and meta.count() == 1
    assert sources.stale_keys(meta, {"data": "d1"}) == [] and sources.stale_keys(meta, {"data": "d2", "size": "3"}) == ["data", "size"]
    rows, _, _ = sources.read_cache(spark, str(tmp_path / "a.jsonl"), "image string, pred string", need_text="pred")
    assert [r["image"] for r in rows.collect()] == ["a"]
    blank = good + '{"image": "a", "pred": ""}\n{"image": "a"}\n{"_meta": true, "data": "d1", "size": "3"}\n'
    rows, meta, _ = sources.read_cache(spark, put(tmp_path / "c.jsonl", blank), "image string, pred string", need_text="pred")
    assert [(r["image"], r["pred"]) for r in rows.collect()] == [("a", "2")]
    assert sources.stale_keys(meta, {"data": "d1"}) == [] and sources.stale_keys(meta, {"size": "3"}) == ["size"] and sources.stale_keys(meta, {"size": "3"}, {"size": "data"}) == []
    rows, _, usable = sources.read_cache(spark, put(tmp_path / "b.jsonl", good + '{"image": "c", "pr'), "image string, pred string")
    assert not usable and rows.count() == 0


def test_pairs_listing_and_documents(spark, tmp_path):
    known = spark.createDataFrame([("a.jpg",), ("b.jpg",)], "name string")
    at = put(tmp_path / "p" / "t.txt", 'a.jpg\t{"x": "q\\"t"}\nno tab\nb.jpg\t{broken\nc.jpg\t{"x": "1"}\n')
    assert [(r["name"], r["payload"]["x"]) for r in sources.read_pairs(spark, at, "struct<x:string>", known).collect()] == [("a.jpg", 'q"t')]
    put(tmp_path / "f" / "b.txt", "2"), put(tmp_path / "f" / "a.txt", "11")
    assert [r["name"] for r in sources.listing(spark, str(tmp_path / "f")).collect()] == ["a.txt", "b.txt"]
    assert [r["name"] for r in sources.listing(spark, str(tmp_path / "f"), newest_name_first=True).collect()] == ["b.txt", "a.txt"]
    assert sources.read_document(spark, put(tmp_path / "d.json", '{\n "x":\n 3}')).first()["x"] == 3


def test_outputs_are_never_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([("é", None)], "a string, b string")
    sinks.write_predictions(rows, str(tmp_path / "o"))
    text = next((tmp_path / "o").glob("part-*.json")).read_text(encoding="utf-8")
    assert json.loads(text) == {"a": "é", "b": None} and "é" in text
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_predictions(rows, str(tmp_path / "o"))
    at = str(tmp_path / "s.json")
    sinks.write_summary(rows, at)
    with pytest.raises(FileExistsError):
        sinks.write_summary(rows, at)
    assert sinks.retire(spark, at).endswith(".bak") and sinks.retire(spark, at) is None
    sinks.write_summary(rows, at)
    assert sinks.retire(spark, at).endswith(".bak2") and (tmp_path / "s.json.bak").exists()


def test_csv_begins_with_a_mark_and_cases_are_clipped(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("a", 1, "f", "v")], "section string, row int, field string, value string"), str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("part-*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    scores = spark.createDataFrame([(i, i % 2 == 0, "g" * 900, "p" * 900, [str(j) for j in range(20)], []) for i in range(200)], "seq int, document_correct boolean, gt string, pred string, missing_paths array<string>, extra_paths array<string>")
    cases = sinks.error_cases(scores, "seq")
    got = cases.collect()
    assert [r["seq"] for r in got] == list(range(1, 80, 2)) and all(len(r["gt"]) == 400 and len(r["missing_paths"]) == 8 for r in got)
    sinks.write_error_cases(cases, str(tmp_path / "e.txt"), "seq")
    assert (tmp_path / "e.txt").read_text(encoding="utf-8").count("[") == 40


def test_stream_resumes_and_writes_each_key_once(spark, tmp_path):
    put(tmp_path / "in" / "1.jsonl", '{"image": "a", "pred": "1"}\n{"image": "b", "pred": "1"}\n')
    run = lambda: streaming.resume_predictions(spark, str(tmp_path / "in"), "image string, pred string", str(tmp_path / "out"), str(tmp_path / "cp"), ["image"]).awaitTermination()
    run()
    put(tmp_path / "in" / "2.jsonl", '{"image": "b", "pred": "2"}\n{"image": "c", "pred": "2"}\n')
    run()
    run()
    assert {(r["image"], r["pred"]) for r in sinks.read_log(spark, str(tmp_path / "out")).collect()} == {("a", "1"), ("b", "1"), ("c", "2")}


def test_a_cache_of_other_settings_is_put_aside(spark, tmp_path):
    text = '{"_meta": true, "data": "d0"}\n{"image": "a", "pred": "1"}\n{"_meta": true, "data": "d1"}\n{"image": "b", "pred": "2"}\n'
    at = put(tmp_path / "a.jsonl", text)
    rows, aside = sources.fresh_cache(spark, at, "image string, pred string", {"data": "d1"})
    assert rows is None and aside.endswith("a.jsonl.bak") and not (tmp_path / "a.jsonl").exists() and (tmp_path / "a.jsonl.bak").read_text() == text
    assert sources.fresh_cache(spark, at, "image string, pred string", {"data": "d1"}) == (None, None)
    rows, aside = sources.fresh_cache(spark, put(tmp_path / "b.jsonl", text.replace("d0", "d1")), "image string, pred string", {"data": "d1"})
    assert aside is None and {r["image"] for r in rows.collect()} == {"a", "b"}


def test_a_batch_that_comes_again_is_committed_once(spark, tmp_path):
    """Pairs committed, then a break: the same batch writes the journal alone, even if its rows would now be others."""
    out, journal = str(tmp_path / "pairs"), str(tmp_path / "journal")
    batch = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    assert sinks.append_new(batch((1, "a"), (1, "a")), out, ["k"], "b1")
    (tmp_path / "pairs" / "_staged-broken" / "log_bucket=1").mkdir(parents=True)
    (tmp_path / "pairs" / "_staged-broken" / "log_bucket=1" / "part-0.parquet").write_bytes(b"half")
    sinks.write_pairs(batch((1, "again"), (9, "new")), batch((1, "a"), (2, "b")), out, journal, ["k"], "b1")
    assert [(r["k"], r["v"]) for r in sinks.read_log(spark, out).collect()] == [(1, "a")] and sinks.read_log(spark, journal).count() == 2
    assert sinks.append_new(batch((1, "x"), (3, "c")), out, ["k"], "b2") and not sinks.append_new(batch((4, "d")), out, ["k"], "b2")
    assert {(r["k"], r["v"]) for r in sinks.read_log(spark, out).collect()} == {(1, "a"), (3, "c")}


def test_two_writers_double_no_rows(spark, tmp_path, monkeypatch):
    """While one writer prepares a version, another commits it: the first finds the name taken, compares again and writes the rest."""
    from ledgerlens.sinks import files

    out, commit, met = str(tmp_path / "log"), files._commit, []
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    sinks.append_new(rows(0), out, ["k"])

    def late(session, staged, final):
        if not met:
            met.append(final)
            sinks.append_new(rows(1, 2), out, ["k"], "other")
        return commit(session, staged, final)

    monkeypatch.setattr(files, "_commit", late)
    assert sinks.append_new(rows(2, 3), out, ["k"], "mine")
    assert sorted(r["k"] for r in sinks.read_log(spark, out).collect()) == [0, 1, 2, 3]


def test_last_answers_go_on_after_a_restart(spark, tmp_path):
    answer = lambda i, p, s: json.dumps({"image": i, "pred": p, "seq": s}) + "\n"
    run = lambda: streaming.latest_answers(spark, str(tmp_path / "in"), "image string, pred string, seq long", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    put(tmp_path / "in" / "1.jsonl", answer("a", "1", 5) + answer("b", "1", 6) + answer("a", " ", 7))
    run()
    put(tmp_path / "in" / "2.jsonl", answer("a", "early", 2) + answer("b", "2", 8) + answer("c", None, 9))
    run()
    run()
    assert {(r["image"], r["pred"], r["answers"]) for r in streaming.read_latest(spark, str(tmp_path / "out")).collect()} == {("a", "1", 2), ("b", "2", 2)}


def test_late_events_come_to_no_closed_window(spark, tmp_path):
    event = lambda t, k: json.dumps({"ts": t, "kind": k}) + "\n"
    run = lambda: streaming.closed_windows(spark, str(tmp_path / "in"), "ts timestamp, kind string", str(tmp_path / "out"), str(tmp_path / "cp"), "ts", "kind").awaitTermination()
    put(tmp_path / "in" / "1.jsonl", event("2024-01-01T10:00:00Z", "a") + event("2024-01-01T23:00:00Z", "a") + event("2024-01-02T12:00:00Z", "a"))
    run()
    put(tmp_path / "in" / "2.jsonl", event("2024-01-01T11:00:00Z", "a") + event("2024-01-02T13:00:00Z", "a") + event("2024-01-04T00:00:00Z", "b"))
    run()
    put(tmp_path / "in" / "3.jsonl", event("2024-01-06T00:00:00Z", "b"))
    run()
    assert {(str(r["start"])[:10], r["kind"], r["n"]) for r in sinks.read_log(spark, str(tmp_path / "out")).collect()} == {("2024-01-01", "a", 2), ("2024-01-02", "a", 2), ("2024-01-04", "b", 1)}
