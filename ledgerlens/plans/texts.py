"""Queries on document texts: the derived documents written as JSON, read back from the text and judged, and the SQL that gives
the same from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import scalars as S
from ..functions import variants as R
from ..operators import scoring as C
from ..operators.pages import settled
from . import derived as V
from .catalogue import query

NAMES = {"project": "项目名称", "supplier": "供应商", "number": "单据编号", "date": "日期", "name": "名称", "spec": "规格型号", "unit": "单位", "qty": "数量", "price": "单价", "amount": "金额", "total": "金额"}


def _guessed(rows: DataFrame, row: Column, fields: dict[str, int]) -> DataFrame:
    """``rows`` with p_<field>, the guess for each of ``fields`` (name: number); a step each, so that each is compiled by itself."""
    for name, no in fields.items():
        rows = settled(rows.select("*", V.guess(F.col(name), row, F.lit(no), F.lit(0)).alias(f"p_{name}")))
    return rows


def _json(fields, prefix: str, *first: Column) -> Column:
    """The JSON object of the fields that have a value."""
    return F.to_json(F.struct(*first, *(F.col(prefix + f).alias(NAMES[f]) for f in fields)))


def samples(spark, sf) -> DataFrame:
    """doc_id, level, gt, pred: both as texts. Some answers are empty, some stand in a fence.

    A line is written where it stands, a document from its lines' texts, so cells are neither gathered nor searched."""
    cells, heads = {n: 4 + i for i, n in enumerate(("name", "spec", "unit", "qty", "price", "amount"))}, {n: i for i, n in enumerate(("project", "supplier", "number", "date"))}
    d = V.details(spark, sf).withColumn("exact", F.col("amount"))
    d = _guessed(d.select("doc_id", "row_idx", "exact", *(F.col(n).cast("string").alias(n) for n in cells)), F.col("row_idx"), cells)
    no = (F.col("row_idx") + 1).cast("string").alias("序号")
    lines = d.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", _json(cells, "", no).alias("gt"), _json(cells, "p_", no).alias("pred")))).alias("lines"), (F.max("row_idx") + 1).alias("n"), F.sum("exact").cast("decimal(18,2)").cast("string").alias("total"))
    o = V.table(spark, sf, "orders").join(V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name"), F.col("o_custkey") == F.col("c_custkey")).withColumn("doc_id", F.col("o_orderkey"))
    o = o.select("doc_id", F.col("c_mktsegment").alias("project"), F.col("c_name").alias("supplier"), F.concat(F.lit("PO-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit(True).alias("headed"))
    docs = _guessed(_guessed(o.join(lines, "doc_id", "full_outer"), F.lit(-1), heads), F.lit(-2), {"total": 10})

    def document(side: str, prefix: str, extra: Column) -> Column:
        # a place whose line is missing is an empty row
        each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.coalesce(F.get(F.filter("lines", lambda r: r.row_idx == i), F.lit(0))[side], F.concat(F.lit('{"序号":"'), (i + 1).cast("string"), F.lit('"}'))))
        rows = F.when(F.col("n").isNull(), "").when(F.size("lines") == F.col("n"), F.array_join(F.col("lines")[side], ",")).otherwise(F.array_join(each, ","))
        return F.concat(F.lit(f'{{"{D.DOC_TYPE}":"{D.DOC_TYPE_VALUE}","{D.HEADER}":'), _json(heads, prefix), F.lit(f',"{D.ROWS}":['), rows, F.lit(f'],"{D.TOTAL}":'), _json(["total"], prefix), extra, F.lit("}"))

    k = F.col("doc_id")
    extra = F.when(F.col("headed") & (k % 29 == 0) & (k % 97 != 0), ',"extra":"x"').otherwise("")
    docs = settled(docs.select("doc_id", (k % 3).alias("level"), document("gt", "", F.lit("")).alias("gt"), document("pred", "p_", extra).alias("pred")))
    return docs.withColumn("pred", F.when(k % 97 == 0, "").when(k % 11 == 0, F.concat(F.lit("Here it is:\n```json\n"), "pred", F.lit("\n```\nDone."))).otherwise(F.col("pred")))


# What the texts hold, from the tables: per document its rows, schema errors by kind, and amounts.
NUMERIC = "('qty', 'price', 'amount', 'total')"
DOCS = V.BASE + f""", x AS (SELECT doc_id, level, doc_id % 97 <> 0 AS loose, doc_id % 97 <> 0 AND doc_id % 11 <> 0 AS strict, greatest(max(row_idx), -1) + 1 AS n_rows,
  count(*) FILTER (ok) AS tp, count(*) FILTER (pred IS NOT NULL AND NOT ok) AS fp, count(*) FILTER (gt IS NOT NULL AND NOT ok) AS fn, count(*) FILTER (row_idx = -3) AS extra,
  4 - count(pred) FILTER (row_idx = -1) + 5 * (greatest(max(row_idx), -1) + 1) - count(pred) FILTER (row_idx >= 0 AND field <> 'spec') + 1 - count(pred) FILTER (row_idx = -2) AS missing,
  count(*) FILTER (field = 'date' AND pred <> gt) AS bad_date, count(*) FILTER (field IN {NUMERIC} AND pred LIKE 'no %') AS bad_number,
  count(*) FILTER (ok AND field IN ('amount', 'total')) AS amount_correct, count(*) FILTER (gt IS NOT NULL AND field IN ('amount', 'total')) AS amount_total FROM m GROUP BY doc_id, level),
y AS (SELECT *, CASE WHEN loose THEN missing + extra + bad_date + bad_number + CAST(n_rows = 0 AS INT) ELSE 1 END AS errors FROM x),
z AS (SELECT *, tp + CASE WHEN loose THEN 1 + n_rows ELSE 0 END AS tp2, fn + CASE WHEN loose THEN 0 ELSE 1 + n_rows END AS fn2 FROM y) """


@query(DOCS + "SELECT level, count(*) AS n, CAST(sum(tp2) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn2) AS BIGINT) AS fn, count(*) FILTER (strict) AS strict_ok, count(*) FILTER (loose) AS loose_ok, count(*) FILTER (errors = 0) AS schema_ok, count(*) FILTER (errors = 0 AND fp = 0 AND fn2 = 0 AND strict) AS docs_ok, CAST(sum(amount_correct) AS BIGINT) AS amount_correct, CAST(sum(amount_total) AS BIGINT) AS amount_total, round(sum(amount_correct) / sum(amount_total), 6) AS amount_accuracy, count(*) FILTER (extra > 0 AND loose) AS extra_docs, count(*) FILTER (NOT loose) AS parse_failures, CAST(sum(errors) AS BIGINT) AS schema_errors FROM z GROUP BY level")
def score_json_texts(spark, sf):
    scored = C.score_texts(samples(spark, sf))
    total = lambda c: F.sum(c).cast("long")
    return scored.groupBy("level").agg(
        F.count("*").alias("n"), total("tp").alias("tp"), total("fp").alias("fp"), total("fn").alias("fn"), F.count_if("strict").alias("strict_ok"), F.count_if("loose").alias("loose_ok"), F.count_if(F.size("schema_errors") == 0).alias("schema_ok"), F.count_if("document_correct").alias("docs_ok"),
        total("amount_correct").alias("amount_correct"), total("amount_total").alias("amount_total"), F.when(F.sum("amount_total") > 0, F.round(F.sum("amount_correct") / F.sum("amount_total"), 6)).alias("amount_accuracy"),
        F.count_if(F.size("extra_paths") > 0).alias("extra_docs"), F.count_if(~F.col("loose")).alias("parse_failures"), total(F.size("schema_errors")).alias("schema_errors"),
    )


@query(DOCS + "SELECT least(errors, 10) AS errors, count(*) AS n FROM (SELECT CAST(errors AS INT) AS errors FROM z) GROUP BY 1")
def schema_error_counts_json(spark, sf):
    parsed = D.parsed(samples(spark, sf).select("pred"), {"p": "pred"}, parts=("errors",))
    return parsed.groupBy(F.least(F.size("p.errors"), F.lit(10)).alias("errors")).agg(F.count("*").alias("n"))


@query(DOCS + "SELECT kind, CAST(sum(c) AS BIGINT) AS n FROM (SELECT 'missing' AS kind, missing AS c FROM x WHERE loose UNION ALL SELECT 'unknown', extra FROM x WHERE loose UNION ALL SELECT 'invalid date', bad_date FROM x WHERE loose UNION ALL SELECT 'invalid number', bad_number FROM x WHERE loose UNION ALL SELECT 'not 1 to 8 rows', CAST(n_rows = 0 AS INT) FROM x WHERE loose UNION ALL SELECT 'not an object', CAST(NOT loose AS INT) FROM x) GROUP BY kind HAVING sum(c) > 0")
def schema_errors_json(spark, sf):
    errors = D.parsed(samples(spark, sf).select("pred"), {"p": "pred"}, parts=("errors",)).select(F.explode("p.errors").alias("e"))
    return errors.groupBy(F.substring_index("e", ": ", -1).alias("kind")).agg(F.count("*").alias("n"))


PATTERN = "CASE field " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END"
_FIELDS = f"SELECT CASE WHEN row_idx = -1 THEN '表头.' WHEN row_idx = -2 THEN '合计.' WHEN row_idx >= 0 THEN '明细[].' ELSE '' END || coalesce({PATTERN}, field) AS pattern, (field = 'date' AND pred <> gt) OR (field IN {NUMERIC} AND pred LIKE 'no %') OR row_idx = -3 AS invalid, row_idx = -3 AS extra, doc_id FROM m WHERE pred IS NOT NULL"
_LINES = "SELECT '明细[].序号', false, false, doc_id FROM x, range(CAST(n_rows AS BIGINT)) WHERE loose UNION ALL SELECT '单据类型', false, false, doc_id FROM x WHERE loose"


@query(DOCS + f"SELECT pattern, invalid, extra, count(*) AS n FROM ({_FIELDS} UNION ALL {_LINES}) GROUP BY ALL")
def flatten_paths_json(spark, sf):
    fields = D.fields(samples(spark, sf).select("pred"), "pred")
    return fields.groupBy(F.regexp_replace("path", r"\[\d+\]", "[]").alias("pattern"), "invalid", "extra").agg(F.count("*").alias("n"))


@query(DOCS + f"SELECT pattern, count(*) AS n FROM ({_FIELDS} UNION ALL {_LINES}) WHERE doc_id % 11 <> 0 GROUP BY 1")
def leaf_walk_json(spark, sf):
    found = samples(spark, sf).select(F.explode(D.leaves_udf("pred")).alias("f"))
    return found.groupBy(F.regexp_replace("f.path", r"\[\d+\]", "[]").alias("pattern")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) AS same, count(DISTINCT (c_name, c_mktsegment)) AS contents FROM customer")
def canonical_hash_json(spark, sf):
    c = V.table(spark, sf, "customer").select("c_name", "c_mktsegment")
    both = c.select(D.stable_hash(F.to_json(F.struct("c_name", "c_mktsegment"))).alias("a"), D.stable_hash(F.concat(F.lit(' { "c_mktsegment": "'), "c_mktsegment", F.lit('" , "c_name":"'), "c_name", F.lit('"}'))).alias("b"))
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.countDistinct("a").alias("contents"))


@query("SELECT count(*) FILTER (bad) AS unparsable, count(*) FILTER (NOT bad AND k % 7 = 0) AS total_scalar, count(*) FILTER (NOT bad AND k % 11 = 0) AS header_scalar, count(*) FILTER (NOT bad AND k % 13 = 0) AS row_scalar FROM (SELECT o_orderkey AS k, o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 AS bad FROM orders)")
def structural_anomalies(spark, sf):
    """Answers in prose, in a fence with prose inside, whole lists (no object), and nulls (no anomaly)."""
    k = F.col("o_orderkey")
    total, header, row = (F.when(k % m == 0, bad).when(k % 2 == 0, none).otherwise(good) for m, bad, none, good in ((7, '"12"', "null", '{"金额":"12"}'), (11, '"x"', "null", '{"日期":"2024-1-2"}'), (13, "3", '{"名称":"c"}', '{"名称":"a"}')))
    obj = F.concat(F.lit('{"合计":'), total, F.lit(',"表头":'), header, F.lit(',"明细":[{"名称":"b"},'), row, F.lit("]}"))
    text = F.when(k % 17 == 0, "no answer").when(k % 19 == 0, F.concat(F.lit("["), obj, F.lit("]"))).when(k % 3 == 0, F.concat(F.lit("```json\nThis is it: "), obj, F.lit(" as asked\n```"))).otherwise(F.concat(F.lit("so: "), obj, F.lit(" end")))
    flags = V.table(spark, sf, "orders").select(D.anomalies_udf(text).alias("a")).select("a.*")
    return flags.agg(*(F.count_if(c).alias(c) for c in D.ANOMALIES.names))


@query(DOCS + f"SELECT pattern, invalid, extra, count(*) AS n FROM ({_FIELDS} UNION ALL {_LINES}) GROUP BY ALL")
def flatten_doc_sql(spark, sf):
    """Documents flattened from SQL, by a table function after LATERAL."""
    D.register(spark)
    return spark.sql("SELECT regexp_replace(f.path, '\\\\[\\\\d+\\\\]', '[]') AS pattern, f.invalid, f.extra, count(*) AS n FROM {docs} d, LATERAL flatten_doc(d.pred) f GROUP BY ALL", docs=samples(spark, sf).select("pred"))


@query(DOCS + f"SELECT pattern, count(*) AS n FROM ({_FIELDS} UNION ALL {_LINES}) WHERE doc_id % 11 <> 0 GROUP BY 1")
def leaves_sql(spark, sf):
    D.register(spark)
    return spark.sql("SELECT regexp_replace(f.path, '\\\\[\\\\d+\\\\]', '[]') AS pattern, count(*) AS n FROM {docs} d, LATERAL leaves(d.pred) f GROUP BY ALL", docs=samples(spark, sf).select("pred"))


@query("SELECT count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS strict_correct, count(*) FILTER (o_orderkey % 3 < 2) AS tolerant_correct FROM orders")
def tolerant_repair_json(spark, sf):
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    gt = F.concat(F.lit('{"合计":{"金额":"'), price, F.lit('"}}'))
    pred = F.when(k % 3 == 0, gt).when(k % 3 == 1, F.concat(F.lit('{"合计":"'), price, F.lit('"}'))).otherwise(F.concat(F.lit('{"合计":"about '), price, F.lit('"}')))
    texts = V.table(spark, sf, "orders").select(gt.alias("gt"), pred.alias("pred"))
    ok = lambda repair: C.score_texts(texts, repair=repair).select(F.lit(repair).alias("repair"), "amount_correct")
    both = ok(False).unionByName(ok(True))
    return both.agg(F.count_if(~F.col("repair")).alias("n"), F.sum(F.when(~F.col("repair"), F.col("amount_correct"))).cast("long").alias("strict_correct"), F.sum(F.when(F.col("repair"), F.col("amount_correct"))).cast("long").alias("tolerant_correct"))


@query("SELECT count(*) AS n, CAST(sum(3 + CAST(k % 2 = 0 AS INT)) AS BIGINT) AS tp, count(*) FILTER (k % 2 = 1) + count(*) FILTER (k % 5 = 0) AS fp, count(*) FILTER (k % 2 = 1) AS fn, CAST(sum(1 + CAST(k % 2 = 0 AS INT)) AS BIGINT) AS amount_correct, count(*) FILTER (k % 5 = 0) AS extra_docs, count(*) FILTER (k % 2 = 1) + count(*) FILTER (k % 5 = 0) AS schema_errors FROM (SELECT o_orderkey AS k FROM orders)")
def flat_scores_json(spark, sf):
    """Flat receipts: dates and totals written in other ways are the same values, a tax in words is invalid."""
    k, price, d = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderdate")
    gt = F.to_json(F.struct(F.concat(F.lit("s"), k).alias("store_name"), F.date_format(d, "yyyy-MM-dd").alias("date"), price.cast("string").alias("total"), F.lit("3.50").alias("tax")))
    pred = F.to_json(F.struct(F.concat(F.lit("  s"), k, F.lit("　")).alias("store_name"), F.date_format(d, "yyyy/M/d").alias("date"), F.format_number(price, 2).alias("total"), F.when(k % 2 == 0, "+3.5").otherwise("three").alias("tax"), F.when(k % 5 == 0, "y").alias("colour")))
    scored = C.score_texts(V.table(spark, sf, "orders").select(gt.alias("gt"), pred.alias("pred")), mode="flat")
    total = lambda c: F.sum(c).cast("long")
    return scored.agg(F.count("*").alias("n"), total("tp").alias("tp"), total("fp").alias("fp"), total("fn").alias("fn"), total("amount_correct").alias("amount_correct"), F.count_if(F.size("extra_paths") > 0).alias("extra_docs"), total(F.size("schema_errors")).alias("schema_errors"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 97 = 0 THEN 'missing: ' || '合计.金额' WHEN o_orderkey % 2 = 0 THEN 'wrong: 合计.金额: 1 for 2' ELSE '' END AS line FROM orders")
def metric_feedback(spark, sf):
    k = F.col("o_orderkey")
    gt = F.lit('{"合计":{"金额":"2"}}')
    pred = F.when(k % 97 == 0, "{}").when(k % 2 == 0, '{"合计":{"金额":"1"}}').otherwise(gt)
    scored = C.feedback(C.score_texts(V.table(spark, sf, "orders").select(k.alias("doc_id"), gt.alias("gt"), pred.alias("pred"))))
    parts = F.filter(F.split("feedback", r" \| "), lambda p: ~p.rlike(": $"))
    return scored.select("doc_id", F.array_join(parts, " | ").alias("line"))


@query("SELECT bucket, count(*) AS n FROM (SELECT (o_orderkey % 50) // 10 AS bucket FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1")
def unparsable_length_hist(spark, sf):
    k = F.col("o_orderkey")
    texts = V.table(spark, sf, "orders").select(F.when(k % 3 == 0, F.repeat(F.lit("x"), (k % 50).cast("int"))).otherwise('{"合计":{}}').alias("pred"))
    bad = R.read(texts, "pred", "p").filter("p.obj IS NULL")
    return bad.groupBy(F.expr("char_length(pred) div 10").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT section, row_no, field, count(*) AS n FROM (SELECT CASE WHEN row_idx = -1 THEN '表头' WHEN row_idx = -2 THEN '合计' ELSE '明细' END AS section, CASE WHEN row_idx >= 0 THEN row_idx + 1 END AS row_no, field FROM gt) GROUP BY ALL".join((V.TRUTH_SQL + " ", "")))
def export_rows(spark, sf):
    """The long form of documents for a table export: section, row from 1, field."""
    r = F.col("row_idx")
    section = F.when(r == -1, D.HEADER).when(r == -2, D.TOTAL).otherwise(D.ROWS)
    return V.truth(spark, sf).groupBy(section.alias("section"), F.when(r >= 0, r + 1).alias("row_no"), "field").agg(F.count("*").alias("n"))


@query("SELECT kind, grp, count(*) AS n FROM (SELECT CASE WHEN field IN ('qty', 'price', 'amount', 'total') THEN 'number' WHEN field = 'date' THEN 'date' ELSE 'text' END AS kind, CASE WHEN row_idx = -1 THEN '表头' WHEN row_idx = -2 THEN '合计' ELSE '明细' END AS grp FROM gt) GROUP BY ALL".join((V.TRUTH_SQL + " ", "")))
def path_kinds(spark, sf):
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    name = F.element_at(names, F.col("field"))
    path = F.when(F.col("row_idx") == -1, F.concat(F.lit("表头."), name)).when(F.col("row_idx") == -2, F.concat(F.lit("合计."), name)).otherwise(F.concat(F.lit("明细["), F.col("row_idx").cast("string"), F.lit("]."), name))
    return V.truth(spark, sf).select(S.field_kind(path).alias("kind"), S.path_group(path).alias("grp")).groupBy("kind", "grp").agg(F.count("*").alias("n"))
