"""Page layout against plain versions of the same rules."""

from __future__ import annotations

import json
import random
from statistics import median

from ledgerlens.operators import layout, pages
from ledgerlens.plans import catalogue


def test_lines_by_moving_median(spark):
    pick = random.Random(3)
    tokens = [(d, i, pick.uniform(0, 60), pick.uniform(0, 100), 4.0) for d in range(6) for i in range(25)]
    got = {(r["doc_id"], r["token_id"]): (r["line"], r["place"]) for r in layout.group_lines(spark.createDataFrame(tokens, "doc_id long, token_id long, v double, x double, tolerance double")).collect()}
    for d in range(6):
        lines: list[list[tuple]] = []
        for t in sorted((t for t in tokens if t[0] == d), key=lambda t: (t[2], t[3])):
            if lines and abs(t[2] - median(u[2] for u in lines[-1])) <= 4.0:
                lines[-1].append(t)
            else:
                lines.append([t])
        assert {(d, t[1]): (k, j) for k, line in enumerate(lines) for j, t in enumerate(sorted(line, key=lambda t: t[3]))} == {k: v for k, v in got.items() if k[0] == d}


def test_longest_edges_stay(spark):
    rows = [(1, 10.0, 50.0), (1, 13.0, 90.0), (1, 18.5, 40.0), (1, 19.0, 60.0), (2, 1.0, 5.0)]
    got = {(r["doc_id"], r["x"]) for r in layout.distinct_edges(spark.createDataFrame(rows, "doc_id long, x double, length double")).collect()}
    assert got == {(1, 13.0), (1, 19.0), (2, 1.0)}


def test_continuations(spark):
    rows = [(1, 0.0, False), (1, 10.0, True), (1, 25.0, False), (1, 40.0, False), (1, 50.0, True)]
    got = {r["v"]: r["row_no"] for r in layout.with_continuations(spark.createDataFrame([(*r, 10.0) for r in rows], "doc_id long, v double, is_row boolean, height double")).collect()}
    assert got == {0.0: None, 10.0: 0, 25.0: 0, 40.0: None, 50.0: 1}


HEADS = [(f"h{i}", h, 100.0 * i, 100.0) for i, h in enumerate(("序号", "名称", "数量", "金额"))]


def read(spark, tokens):
    """pred, trace by texts, and warnings of one page of (name, text, x, v) tokens of height 10."""
    rows = [(1, i, t, x, v, 10.0) for i, (_, t, x, v) in enumerate(tokens)]
    page = pages.read_pages(spark.createDataFrame(rows, "doc_id long, token_id long, text string, x double, v double, height double")).collect()[0]
    return json.loads(page["pred"]), {k: [tokens[i][0] for i in ids] for k, ids in page["trace"].items()}, page["warnings"]


def test_values_beside_labels(spark):
    """A label is the start of a token, its value the rest of it or the nearest token to the right at its height; the first value counts."""
    doc, trace, warnings = read(spark, [("a", "项目名称：", 0.0, 10.0), ("low", "too low", 20.0, 16.0), ("far", "far", 90.0, 10.0), ("near", " Ｎ1 ", 50.0, 15.0), ("left", "left", -5.0, 10.0), ("b", "编号: 7", 0.0, 30.0), ("c", "单据编号: 8", 0.0, 40.0), ("d", "日期:20240230", 0.0, 50.0), ("e", "其供应商: x", 0.0, 60.0), ("f", "材 料清单", 0.0, 70.0)])
    assert doc == {"单据类型": "材料清单", "表头": {"项目名称": "N1", "供应商": "", "单据编号": "7", "日期": "20240230"}, "明细": [], "合计": {"金额": ""}}
    assert trace == {"表头.项目名称": ["a", "near"], "表头.单据编号": ["b"], "表头.日期": ["d"], "单据类型": ["f"]} and warnings == ["fewer than four headings"]


def test_the_table_ends_above_total_or_footer(spark):
    row = lambda n, v: [(f"s{n}", str(n), 0.0, v), (f"n{n}", f"item {n}", 100.0, v), (f"q{n}", "2", 200.0, v), (f"m{n}", "4.00", 300.0, v)]
    doc, trace, _ = read(spark, [*HEADS, *row(1, 120.0), ("x", "项目名称: below", 0.0, 140.0), ("t", "合计金额", 0.0, 160.0), ("t1", "1,000", 200.0, 168.0), ("t2", "9", 300.0, 160.0), *row(2, 180.0)])
    assert [r["名称"] for r in doc["明细"]] == ["item 1"] and doc["合计"]["金额"] == "1,000" and trace["合计.金额"] == ["t1"] and doc["表头"]["项目名称"] == ""
    doc, trace, warnings = read(spark, [*HEADS, *row(1, 120.0), ("c", "goes on", 100.0, 135.0), ("u", "apart", 100.0, 160.0), ("z", "loose 5", 300.0, 175.0), *row(2, 190.0), ("f", "审核人", 0.0, 230.0), ("f1", "1", 200.0, 230.0), ("f2", "2", 300.0, 230.0)])
    assert [r["名称"] for r in doc["明细"]] == ["item 1 goes on", "item 2"] and trace["明细[0].名称"] == ["n1", "c"] and trace["明细[1].金额"] == ["m2"]
    assert warnings == ["a line that belongs to no row"] * 2 and doc["合计"]["金额"] == ""


def test_columns_and_headings(spark):
    """A missing cell is not guessed, columns may come in any order, and brackets count but in prices."""
    doc, _, _ = read(spark, [("a", "金额（元）", 0.0, 100.0), ("b", "品 名", 100.0, 100.0), ("c", "数量", 200.0, 101.0), ("d", "序号", 300.0, 99.0), ("e", "5.0", 5.0, 120.0), ("f", "3", 299.0, 120.0), ("g", "a", 90.0, 121.0), ("h", "b", 110.0, 119.0)])
    assert doc["明细"] == [{"序号": "3", "名称": "a b", "规格型号": "", "单位": "", "数量": "", "单价": "", "金额": "5.0"}]
    names = spark.createDataFrame([(t,) for t in ("(序号)", "名(称)", "金额(元", "单价元", "单价(元)", "(数量)", "规格")], "t string")
    assert [r["h"] for r in names.select(layout.heading(names["t"]).alias("h")).collect()] == [None, None, "金额", "单价", "单价", None, "规格型号"]


def test_plain_texts_need_no_python(spark):
    """Every character that counts as plain has the normal form that a translation gives, and blanks are those of the pattern."""
    import unicodedata

    from pyspark.sql import functions as F

    from ledgerlens.functions import documents as D

    texts = spark.createDataFrame([(i, f"a{chr(i)}b") for i in range(0x10000) if not 0xD800 <= i < 0xE000], "i int, t string")
    got = texts.select("i", "t", D.plain(F.col("t")).alias("ok"), D.nfkc_plain(F.col("t")).alias("n"), (F.regexp_replace("t", r"(?U)[\s\x1c-\x1f]+", "") == pages._dense(F.col("t"))).alias("same")).collect()
    assert sum(r["ok"] for r in got) > 21000 and all(r["same"] for r in got)
    assert all(r["n"] == unicodedata.normalize("NFKC", r["t"]) for r in got if r["ok"])


def test_page_queries_move_no_tokens(spark, sf):
    """Pages are made where their lines lie: lines are dealt out once, and no token is a row that is sorted or dealt out."""
    for name in ("page_tables", "page_headers", "page_document_scores"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "token_id" not in "".join(line for line in plan.splitlines() if " Aggregate " in line or " Window " in line or " Sort " in line)


def test_lines_with_gaps_near_the_tolerance(spark):
    """Parts that are folded, parts that aren't, and gaps of just the tolerance give the lines of the moving median."""
    pick = random.Random(5)
    rows = [(d, i, float(pick.choice((0, 1, 3, 4, 5, 8, 9, 12, 13, 17, 30, 31))) + d / 4, float(i), 4.0) for d in range(8) for i in range(14)]
    got = {(r["doc_id"], r["token_id"]): r["line"] for r in layout.group_lines(spark.createDataFrame(rows, "doc_id long, token_id long, v double, x double, tolerance double")).collect()}
    for d in range(8):
        lines: list[list[tuple]] = []
        for t in sorted((t for t in rows if t[0] == d), key=lambda t: (t[2], t[3])):
            if lines and abs(t[2] - median(u[2] for u in lines[-1])) <= 4.0:
                lines[-1].append(t)
            else:
                lines.append([t])
        assert {(d, t[1]): k for k, line in enumerate(lines) for t in line} == {k: v for k, v in got.items() if k[0] == d}


def test_pages_are_spread_whatever_their_bytes(spark, sf):
    assert catalogue.QUERIES["page_headers"](spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
