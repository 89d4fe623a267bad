"""Parsing, flattening and schema rules on single texts."""

from __future__ import annotations

import json

import pytest

from ledgerlens.functions import documents as D


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('{"a": 1}', {"a": 1}), (' \n{"a": 1}\t', {"a": 1}), ("[1]", None), ('"x {} y"', None), ("3", None), ("", None), (None, None), ("   ", None),
        ('{"a": 1, "a": 2}', None), ('{"a": NaN}', None), ('{"a": 1} tail', {"a": 1}), ('so {"a": 1} tail', {"a": 1}), ("```json\n{\"a\": 2}\n```", {"a": 2}), ("x ```\n{\"a\": 3}``` y", {"a": 3}),
        ('```{"a": } ``` {"b": 1}', None), ("{ broken", None), ('text [1, {"a": 1}]', {"a": 1}),
    ],
)
def test_loose_object(text, found):
    assert D.loose_object(text) == found


@pytest.mark.parametrize(("text", "ok"), [("{}", True), ("[1]", True), ("3", True), ('{"a":1,"a":1}', False), ("NaN", False), ("-Infinity", False), ("{} x", False), (None, False), ("", False)])
def test_strict_valid(text, ok):
    assert D.strict_valid(text) is ok


def paths(obj, mode="document"):
    return {f[0]: (f[4], f[5], f[6]) for f in D.flatten(obj, mode)}


def test_flat_mode_normalises_numbers_and_dates():
    assert paths({"total": "1,000.00", "date": "2024/1/2", "tax": "x", "store_name": " Ａ b ", "subtotal": 3, "tel": None, "x.y": ""}, "flat") == {
        "total": ("1000", False, False), "date": ("2024-01-02", False, False), "tax": ("number:x", True, False), "store_name": ("A b", False, False), "subtotal": ("type:3", True, False), "x\\.y": ('extra:""', True, True),
    }


def test_null_sections_are_invalid_entries():
    assert paths({"表头": None, "明细": None, "合计": None}) == {"表头": ("object:", True, False), "明细": ("array:", True, False), "合计": ("object:", True, False)}
    assert paths({"明细": [{"数量": "007", "名称": "007"}, None, 4]}) == {"明细[0].数量": ("7", False, False), "明细[0].名称": ("007", False, False), "明细[1]": ("object:", True, False), "明细[2]": ("object:", True, False)}
    assert paths({"表头": {"日期": "2024-02-30", "other": {"deep": 1}}, "more": None}) == {"表头.日期": ("date:2024-02-30", True, False), "表头.other": ('extra:{"deep": 1}', True, True), "more": ("extra:null", True, True)}
    assert paths({"合计": {"金额": "-0.00"}}) == {"合计.金额": ("0", False, False)} and paths([1]) == {}


def test_schema_errors_in_order():
    row = {"序号": "1", "名称": "a", "单位": "m", "数量": "2", "单价": "3", "金额": "6"}
    good = {"单据类型": "材料清单", "表头": {"项目名称": "p", "供应商": "s", "单据编号": "n", "日期": "2024-1-2"}, "明细": [row], "合计": {"金额": "6"}}
    assert D.schema_errors(good) == []
    assert D.schema_errors(None) == ["$: not an object"]
    assert D.schema_errors({}) == ["单据类型: missing", "合计: missing", "明细: missing", "表头: missing", "单据类型: not 材料清单", "表头: not an object", "合计: not an object", "明细: not an array"]
    assert D.schema_errors(good | {"z": 1, "b": 2})[:2] == ["b: unknown", "z: unknown"]
    assert D.schema_errors(good | {"明细": []}) == ["明细: not 1 to 8 rows"]
    assert D.schema_errors(good | {"明细": [row | {"金额": "x", "名称": " ", "数量": 2}]}) == ["明细[0].名称: empty", "明细[0].数量: not a string", "明细[0].金额: invalid number"]
    assert D.schema_errors({"total": "x", "color": "y", "date": "2024-1-1"}, "flat") == ["total: invalid number", "color: unknown"]


def test_repair_of_a_bare_total():
    assert D.tolerant({"合计": "1,200"}) == {"合计": {"金额": "1,200"}} and D.tolerant({"合计": "1200 kg"}) == {"合计": "1200 kg"} and D.tolerant({"合计": ""}) == {"合计": ""}


def test_leaves_and_canonical_json():
    assert D.leaves({"a.b": [{"c": None}, 2], "d": "x"}) == [("a.b[0].c", "null"), ("a.b[1]", "2"), ("d", "x")]
    assert D.canonical_json('{"b": 1, "a": "é"}') == '{"a":"é","b":1}' and D.canonical_json("{") is None
    assert json.loads(D.canonical_json("[1, 2]")) == [1, 2] and D.compact(" Ａ　b\n") == "Ab"


def test_lone_surrogates_and_deep_nesting_end_no_job(spark):
    from ledgerlens.operators import scoring

    deep, deeper = '{"合计": ' + "[" * 3000 + "]" * 3000 + "}", "[" * 200_000 + "]" * 200_000
    texts = ['{"合计": {"金额": "\\ud800"}}', '{"x\\udc00": "1"}', deep, deeper, '{"a": ' * 900 + "1" + "}" * 900]
    rows = spark.createDataFrame([(i, '{"合计": {"金额": "1"}}', t) for i, t in enumerate(texts)], "i int, gt string, pred string")
    scored = {r["i"]: r for r in scoring.score_texts(rows).collect()}
    assert scored[0]["field_errors"][0]["pred"] == "number:\\ud800" and scored[1]["extra_paths"] == ["x\\udc00"] and len(scored) == 5
    got = rows.select("i", D.leaves_udf("pred").alias("l"), D.stable_hash("pred").alias("h")).collect()
    assert got[0]["l"][0]["value"] == "\\ud800" and got[0]["h"] and got[3]["l"] == []
    D.register(spark)
    assert spark.sql("SELECT i, count(*) AS n FROM {rows}, LATERAL leaves(pred) GROUP BY i", rows=rows).count() >= 3
    assert D.leaves([[[]], {"a": {"b": None}}]) == [("[1].a.b", "null")]


@pytest.mark.parametrize(
    ("text", "flags"),
    [
        ('[{"合计": {}}]', (True, False, False, False)), ('{"合计": null, "表头": null}', (False, False, False, False)), ('```json\nso {"合计": 3} it is\n```', (False, True, False, False)), ('x {"表头": "h", "明细": [1]} y', (False, False, True, True)),
        (None, (True, False, False, False)), ("", (True, False, False, False)), ("{", (True, False, False, False)), ('{"明细": "none"}', (False, False, False, False)),
    ],
)
def test_anomalies(text, flags):
    assert D.anomalies(text) == flags


def test_scores_and_fields_leave_python_whole(spark):
    """Scores are compared where texts are read, and fields come as rows: neither brings an array of fields to the JVM."""
    from ledgerlens.operators import scoring as C

    gt = '{"合计":{"金额":"2"},"表头":{"日期":"2024-13-40","项目名称":"p"}}'
    rows = spark.createDataFrame([(1, gt, '{"合计":{"金额":"2.0"},"表头":{"日期":"2024-13-40"},"x":1}'), (2, gt, None)], "i int, gt string, pred string")
    scored = C.score_texts(rows)
    assert [f.name for f in scored.schema.fields if "invalid" in f.dataType.simpleString()] == []
    got = {r["i"]: r for r in scored.collect()}
    assert (got[1]["tp"], got[1]["fp"], got[1]["fn"]) == (1, 2, 2) and got[1]["extra_paths"] == ["x"] and got[1]["missing_paths"] == ["表头.项目名称"] and (got[1]["amount_correct"], got[1]["amount_total"]) == (1, 1)
    assert [tuple(e) for e in got[1]["field_errors"]] == [("x", None, "extra:1"), ("表头.日期", "date:2024-13-40", "date:2024-13-40"), ("表头.项目名称", "p", None)]
    assert (got[2]["loose"], got[2]["tp"], got[2]["fn"], list(got[2]["schema_errors"])) == (False, 0, 3, ["$: not an object"])
    found = [tuple(r) for r in D.fields(rows, "pred").select("i", "path", "value", "invalid", "extra").collect()]
    assert found == [(1, *(f[k] for k in (0, 4, 5, 6))) for f in D.flatten(D.loose_object(rows.collect()[0]["pred"]))]
