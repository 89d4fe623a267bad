"""Fields read in the JVM against the readers of single texts."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import documents as D
from ledgerlens.functions import variants as R

DOC = {"单据类型": "材料清单", "表头": {"项目名称": " Ａ b ", "日期": "2024年1月2日", "供应商": "", "单据编号": None, "odd.key": "x"}, "明细": [{"序号": "1", "数量": "1,000.50", "单价": "about 3", "金额": 3, "名称": {"a": 1}}, 7, None, {}], "合计": {"金额": "-0.0"}, "extra": [], "x[1]": None}
TEXTS = [
    json.dumps(DOC, ensure_ascii=False), json.dumps(DOC), f"so: {json.dumps(DOC)} end", f"```json\n{json.dumps(DOC)}\n``` tail", "```\nno\n``` {\"合计\":{}}", '{"表头":null,"明细":null,"合计":null}', '{"表头":[],"明细":{},"合计":"12"}', '{"明细":[]}',
    '{"合计":{"金额":"1"},"合计":{}}', '{"合计":{"金额":"1","金额":"1"}}', '{"合计":NaN}', '[{"合计":{}}]', '[{"合计":{}}, NaN]', 'a [{"合计":{}}, NaN]', '{"合计":{}} x', '{"合计":{}}]', '{"合计":{}}}', '{"合计":{}},"w":2', '{"合计":{}},{"合计":{}}', '1},{"v":2', "1],[2", "null", "1,null",
    "", "   ", None, "{}", "{", "}{", "　{\"单据类型\":\"　材料　清单　\"}　", '{"表头":{"日期":"2024-13-40"}}', '{"合计":{"金额":"１２.５0"}}', '{"单据类型":true}', '{"单据类型":1.50}', '"{\\"合计\\":{}}"', '{"a":"}"} and {', "x" * 200_000, '{"单据类型":"' + "y" * 200_000 + '"}',
    '{"单据类型":"tab\there"}',
]


def as_told(path, value, invalid, extra):
    """Invalid and unknown values as what their JSON means, not as it is spaced."""
    m = re.match(r"(type|extra):(.*)", value, re.DOTALL) if invalid else None
    return path, (m[1], repr(json.loads(m[2]))) if m else value, invalid, extra


@pytest.mark.parametrize("mode", ["document", "flat"])
def test_fields_agree_with_the_reader_of_single_texts(spark, mode):
    flat = [json.dumps({"total": "1,000.00", "date": "2024/1/2", "tax": "x", "store_name": " Ａ b ", "subtotal": 3, "tel": None, "x.y": ""})]
    docs = spark.createDataFrame(list(enumerate(TEXTS + flat)), "id int, t string")
    got: dict[int, list] = {}
    for r in R.fields(docs, "t", mode).collect():
        got.setdefault(r["id"], []).append((as_told(r["path"], r["value"], r["invalid"], r["extra"]), r["section"], r["row"], r["field"]))
    for i, text in enumerate(TEXTS + flat):
        want = [(as_told(f[0], f[4], f[5], f[6]), f[1], f[2], f[3]) for f in D.flatten(D.loose_object(text), mode)]
        assert sorted(got.get(i, []), key=repr) == sorted(want, key=repr), text and text[:80]


def test_strict_and_loose(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in R.read(docs, "t", "r").select("t", "r.strict", F.col("r.obj").isNotNull().alias("loose")).collect():
        assert (r["strict"], r["loose"]) == (D.strict_valid(r["t"]), D.loose_object(r["t"]) is not None), r["t"] and r["t"][:80]
