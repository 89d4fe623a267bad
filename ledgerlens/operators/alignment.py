"""Joins by position, by link, by interval and by name, and the guards of run comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def require(rows: DataFrame, ok: Column, what: str, key: str | Column) -> DataFrame:
    """``rows``, or an error that says ``what`` is wrong and with which row (``key``); null isn't ok. The check runs in the pass that reads the rows."""
    name = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("null"))
    bad = F.raise_error(F.concat(F.lit(f"{what}: "), name)).cast("boolean")
    return rows.filter(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(bad))


def same_truth(runs: DataFrame, keys: list[str], run: str, truth: str, n_runs: int) -> DataFrame:
    """``keys`` of ``runs`` once each; an error names the first that a run lacks, has twice, or has with another truth."""
    met = runs.groupBy(*keys).agg(F.count("*").alias("_n"), F.countDistinct(run).alias("_r"), F.count_distinct(F.coalesce(F.col(truth).cast("string"), F.lit(""))).alias("_t"))
    name = F.concat_ws("/", *keys)
    met = require(met, (F.col("_n") == n_runs) & (F.col("_r") == n_runs), "not once in each run", name)
    return require(met, F.col("_t") == 1, "another truth", name).select(*keys)


def with_same_truth(runs: DataFrame, keys: list[str], run: str, truth: str, n_runs: int) -> DataFrame:
    """``runs`` itself, if ``same_truth`` holds for it: the check is a window over the rows of a key, so ``runs`` is made once."""
    w = Window.partitionBy(*keys)
    told = F.coalesce(F.col(truth).cast("string"), F.lit(""))
    met = runs.withColumns({"_n": F.count("*").over(w), "_r": F.size(F.collect_set(run).over(w)), "_lo": F.min(told).over(w), "_hi": F.max(told).over(w)})
    name = F.concat_ws("/", *keys)
    met = require(met, (F.col("_n") == n_runs) & (F.col("_r") == n_runs), "not once in each run", name)
    return require(met, F.col("_lo") == F.col("_hi"), "another truth", name).drop("_n", "_r", "_lo", "_hi")


def require_known(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """``rows``; a value outside the allowed set, or null, ends the query with its name."""
    return require(rows, F.col(column).isin(allowed), f"unknown {column}", column)


def require_match(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with what ``known`` has for them; a row without a match ends the query with its key."""
    return require(rows.join(known.withColumn("_there", F.lit(True)), key, "left"), F.col("_there"), f"no {key}", key).drop("_there")


def zip_kept(left: DataFrame, right: DataFrame, by: list[str], seq: str, keep_left: Column, keep_right: Column) -> DataFrame:
    """Rows side by side by their place among those that are kept: what is filtered out shifts the later ones.

    Columns: by, place, and the others of both sides (those of the right with the suffix _r)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(seq)) - 1
    a = left.filter(keep_left).withColumn("place", place)
    b = right.filter(keep_right).withColumn("place", place)
    return a.join(b.select(*by, "place", *(F.col(c).alias(f"{c}_r") for c in right.columns if c not in by)), [*by, "place"])


def link_answers(entities: DataFrame, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """doc, link_seq, key, value: questions (label question) with the answers that their links (array of id pairs) lead to.

    Of entities with one id the last counts; targets that are no answer, blank keys and blank answers give nothing; keys lose
    trailing colons, and a key that comes again is numbered."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    last = entities.groupBy(doc, "id").agg(F.max_by(F.struct("label", "text"), seq).alias("e"))
    answers = last.filter((F.col("e.label") == "answer") & ~blank(F.col("e.text"))).select(doc, F.col("id").alias("_to"), F.trim("e.text").alias("value"))
    asked = entities.filter("label = 'question'").select(doc, seq, S.clean_key("text").alias("key"), F.posexplode("links").alias("_at", "_link")).filter((F.size("_link") == 2) & ~blank(F.col("key")))
    found = asked.withColumn("_to", F.col("_link")[1]).join(answers, [doc, "_to"])
    w = Window.partitionBy(doc, "key").orderBy(seq, "_at")
    k = F.row_number().over(w)
    return found.withColumn("key", F.when(k == 1, F.col("key")).otherwise(F.concat("key", F.lit("#"), k.cast("string")))).select(doc, F.struct(seq, "_at").alias("link_seq"), "key", "value")


def common_ids(rows: DataFrame, key: str, config: str) -> DataFrame:
    """Keys that every configuration has."""
    n = rows.select(config).distinct().count()
    return rows.groupBy(key).agg(F.countDistinct(config).alias("_n")).filter(F.col("_n") == n).select(key)


def order_identity(runs: DataFrame, run: str, seq: str, key: str, truth: str) -> DataFrame:
    """One row: places, and of them those where the runs differ in key, in truth, or where a run has none."""
    n = runs.select(run).distinct().count()
    places = runs.groupBy(seq).agg(F.count("*").alias("_c"), F.countDistinct(key).alias("_k"), F.countDistinct(truth).alias("_t"))
    return places.agg(F.count("*").alias("places"), F.count_if(F.col("_k") > 1).alias("other_key"), F.count_if(F.col("_t") > 1).alias("other_truth"), F.count_if(F.col("_c") != n).alias("absent"))


def unique_matches(rows: DataFrame, manifest: DataFrame, key: str, truth: str) -> DataFrame:
    """``rows`` with match: unique, ambiguous (the manifest has the key more than once), differs (another truth) or none."""
    known = manifest.groupBy(key).agg(F.count("*").alias("_n"), F.min(truth).alias("_t"))
    found = rows.join(known, key, "left")
    return found.withColumn("match", F.when(F.col("_n").isNull(), "none").when(F.col("_n") > 1, "ambiguous").when(F.col("_t").eqNullSafe(F.col(truth)), "unique").otherwise("differs")).drop("_n", "_t")


def by_stem(files: DataFrame, truth: DataFrame, path: str, name: str) -> DataFrame:
    """Files with the truth of their source: names without extension and degradation mark; files without truth drop out."""
    return files.withColumn("_stem", S.stem(path)).join(truth.withColumnRenamed(name, "_stem"), "_stem").withColumnRenamed("_stem", name)


def in_columns(tokens: DataFrame, edges: DataFrame, by: str, x: str) -> DataFrame:
    """Tokens with the column whose interval (lo, hi; both outside) holds them, and n_left, the left edges that they have passed.

    ``edges``: by, col, lo, hi; a document has few columns, so its intervals come as one list to its tokens and are tested in
    the row: an equi-join on the document, not a join on the condition. Tokens in no interval or in several get no column."""
    lists = edges.groupBy(by).agg(F.collect_list(F.struct("col", "lo", "hi")).alias("_e"))
    held = tokens.join(lists, by).withColumn("_h", F.filter("_e", lambda e: (F.col(x) > e.lo) & (F.col(x) < e.hi)))
    return held.withColumn("n_left", F.size(F.filter("_e", lambda e: F.col(x) > e.lo))).withColumn("col", F.when(F.size("_h") == 1, F.col("_h")[0].col)).drop("_e", "_h")


def evidence(fields: DataFrame, tokens: DataFrame, by: str, path: str, value: str) -> DataFrame:
    """by, path, token_ids: for each field the ids, sorted, of the document's tokens that are words of its value; none: an empty list."""
    words = fields.select(by, path, F.explode(F.array_distinct(F.filter(F.split(F.lower(value), r"\s+"), lambda w: w != ""))).alias("_w"))
    met = words.join(tokens.select(by, F.lower("text").alias("_w"), "token_id"), [by, "_w"]).groupBy(by, path).agg(F.array_sort(F.collect_set("token_id")).alias("token_ids"))
    kind = tokens.schema["token_id"].dataType.simpleString()
    return fields.select(by, path).join(met, [by, path], "left").withColumn("token_ids", F.coalesce("token_ids", F.array().cast(f"array<{kind}>")))


def expect_counts(rows: DataFrame, by: str, expected: dict[str, int]) -> DataFrame:
    """by, n, expected, ok: rows of each template against the protocol; templates without rows are there with 0."""
    want = rows.sparkSession.createDataFrame(list(expected.items()), f"{by} string, expected long")
    have = rows.groupBy(F.col(by).cast("string").alias(by)).agg(F.count("*").alias("n"))
    return have.join(want, by, "full_outer").select(by, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "expected", F.coalesce(F.col("n"), F.lit(0)).eqNullSafe(F.col("expected")).alias("ok"))


def unknown_values(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values outside the allowed set and how often they come."""
    return rows.filter(~F.col(column).isin(allowed)).groupBy(column).agg(F.count("*").alias("n"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side alone, as often as they are in excess there, with side."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def coerced_rows(docs: DataFrame, doc: str, text: str, fields: str) -> DataFrame:
    """doc, row_idx, and a struct r of ``fields`` for each element of a JSON array; an element that is no object is an empty row
    at its place, a text that is no array has no rows."""
    items = F.from_json(text, "array<string>")
    rows = docs.select(doc, F.posexplode(F.coalesce(items, F.array().cast("array<string>"))).alias("row_idx", "_i"))
    return rows.select(doc, "row_idx", F.from_json(F.when(F.ltrim("_i").startswith("{"), F.col("_i")).otherwise("{}"), fields).alias("r"))


def first_given(*choices: Column) -> Column:
    """The first choice that is not blank, trimmed."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in choices))


def preferred(rows: DataFrame, by: str, wanted: Column, seq: str) -> DataFrame:
    """One row of each group: one that is wanted if there is any, the first of them."""
    w = Window.partitionBy(by).orderBy(F.when(wanted, 0).otherwise(1), seq)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def spans(rows: DataFrame, seq: str, cuts: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows of the named spans [first, past) of an order, with span; spans may overlap, all others drop out."""
    named = F.filter(F.array(*(F.when((F.col(seq) >= a) & (F.col(seq) < b), F.lit(name)) for name, (a, b) in cuts.items())), lambda x: x.isNotNull())
    return rows.withColumn("span", F.explode(named))
