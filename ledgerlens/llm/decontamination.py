"""Benchmark decontamination by a distributed positional inverted index.

The terms of the benchmark's windows are counted over all documents. A window is looked for from its rarest term on: for
each document that has it, the postings (term -> positions) of the window's terms are stored, and their lists, each
shifted back by the term's offset in the window, are intersected, the rarest first. What is left are the exact phrase's
starts. Positions that agree up to a slack give proximity matches. The benchmark is taken in blocks of bounded size, each
against all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, chunks, lean, signed, words
from .shared import checkpointed

#: Benchmark words in a block: what is broadcast of a block is bounded by it.
BLOCK_WORDS = 400_000


class Vocabulary:
    """Places of word hashes in a sorted list, -1 for words that aren't in it."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.unique(codes)
        self.gate = np.zeros(1 << 20, bool)
        self.gate[self.codes >> np.uint64(44)] = True

    def places(self, code: np.ndarray) -> np.ndarray:
        out = np.full(len(code), -1, np.int32)
        maybe = np.flatnonzero(self.gate[code >> np.uint64(44)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.codes, code[maybe]), len(self.codes) - 1)
            out[maybe] = np.where(self.codes[at] == code[maybe], at, -1)
        return out


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, raw, off in chunks(batch.column(1)):
            code, _, at = words(raw, off, ALNUM)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signed(code)))], names=["item", "codes"])


def _count_terms(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        total = np.zeros(len(v.codes), np.int64)
        for batch in batches:
            for _, _, raw, off in chunks(batch.column(0)):
                p = v.places(words(raw, off, ALNUM)[0])
                total += np.bincount(p[p >= 0], minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.record_batch({"term": pa.array(there.astype(np.int32)), "n": pa.array(total[there])})

    return run


def _postings(shared):
    """A row per document: id, key, words, and the postings of windows that have all their terms in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, by_anchor, anchors = shared.value
        kind = pa.map_(pa.int32(), pa.list_(pa.int32()))
        for batch in batches:
            for first, last, raw, off in chunks(batch.column(2)):
                code, _, at = words(raw, off, ALNUM)
                place = v.places(code)
                hit = np.flatnonzero((place >= 0) & anchors[place])
                found: list = [None] * (last - first)
                rows = np.searchsorted(at, hit, "right") - 1
                for r in np.unique(rows).tolist():
                    mine = place[at[r] : at[r + 1]]
                    have = set(mine[mine >= 0].tolist())
                    terms: set[int] = set()
                    for a in set(place[hit[rows == r]].tolist()):
                        for needed in by_anchor[a]:
                            if needed <= have:
                                terms |= needed
                    if terms:
                        pos = np.flatnonzero(np.isin(mine, np.fromiter(terms, np.int32)))
                        order = np.argsort(mine[pos], kind="stable")
                        term, cut = np.unique(mine[pos][order], return_index=True)
                        found[r] = [(int(t), p.astype(np.int32)) for t, p in zip(term, np.split(pos[order], cut[1:]), strict=True)]
                n = last - first
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(np.diff(at)), pa.array(found, kind)], names=["_id", "_key", "n_words", "postings"])

    return run


def _plan_windows(items: list[tuple[str, list[int]]], n: int) -> tuple[np.ndarray, dict[tuple[int, ...], set[str]]]:
    """The words of a block, and its distinct windows with the items that have them."""
    windows: dict[tuple[int, ...], set[str]] = {}
    for item, codes in items:
        for k in range(max(1, len(codes) - n + 1) if codes else 0):
            windows.setdefault(tuple(codes[k : k + n]), set()).add(item)
    return np.array(sorted({c for w in windows for c in w}), dtype=np.int64).view(np.uint64), windows


def find_contamination(docs: DataFrame, items: DataFrame, n: int = 10, slack: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans, n_near.

    Words are runs of letters, digits and all characters beyond ASCII, A-Z in lower case; they are compared by 64-bit
    hashes. ``items`` (array<string>): ids of items with a window in the document; ``spans``: (first word, words) of each
    occurrence; ``n_near``: items with a window whose terms all lie within ``slack`` words of their place. Null and empty
    texts have no words and match nothing; items without words or with a null id are left out; rows with equal texts,
    repeated ids and null ids each get their row. Without documents the result is empty, without items nothing is hit."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    item_words = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).mapInArrow(lean(_item_words), "item string, codes array<long>")
    item_words = checkpointed(item_words)
    size = item_words.agg(F.sum(F.size("codes").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_WORDS))
    base, hits = None, None
    for block in range(blocks):
        mine = item_words.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()
        codes, windows = _plan_windows(list(zip(mine.column(0).to_pylist(), mine.column(1).to_pylist(), strict=True)), n)
        vocabulary = Vocabulary(codes)
        terms_sent = spark.sparkContext.broadcast(vocabulary)
        counted = rows.select("_text").mapInArrow(lean(_count_terms(terms_sent)), "term int, n long") if len(codes) else None
        df = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()} if counted is not None else {}
        by_anchor: dict[int, list[frozenset[int]]] = {}
        plan = []
        for window, names in windows.items():
            terms = vocabulary.places(np.array(window, dtype=np.int64).view(np.uint64)).tolist()
            if all(t in df for t in terms):
                order = sorted(range(len(terms)), key=lambda j: (df[terms[j]], j))
                by_anchor.setdefault(terms[order[0]], []).append(frozenset(terms))
                plan.append((len(plan), terms[order[0]], [(terms[j], j) for j in order], len(terms), sorted(names)))
        anchors = np.zeros(len(codes) + 1, bool)
        anchors[list(by_anchor)] = True
        plan_sent = spark.sparkContext.broadcast((vocabulary, by_anchor, anchors))
        scanned = checkpointed(rows.mapInArrow(lean(_postings(plan_sent)), f"_id {id_type}, _key binary, n_words long, postings map<int, array<int>>"))
        terms_sent.unpersist()
        plan_sent.unpersist()
        base = scanned.select("_id", "_key", "n_words") if base is None else base
        table = spark.createDataFrame(plan, "window int, anchor int, terms array<struct<term:int, j:int>>, width int, names array<string>")
        index = scanned.filter(F.col("postings").isNotNull()).groupBy("_key").agg(F.first("postings").alias("postings"))
        found = index.withColumn("anchor", F.explode(F.map_keys("postings"))).join(F.broadcast(table), "anchor")  # a block's table is bounded by BLOCK_WORDS
        found = found.filter(F.expr("forall(terms, t -> map_contains_key(postings, t.term))"))
        found = found.withColumn("starts", F.expr("filter(transform(postings[terms[0].term], p -> p - terms[0].j), s -> s >= 0)"))
        found = found.withColumn("exact", F.expr("aggregate(slice(terms, 2, size(terms)), starts, (left, t) -> array_intersect(left, transform(postings[t.term], p -> p - t.j)))"))
        found = found.withColumn("near", F.expr(f"exists(starts, s -> forall(terms, t -> exists(postings[t.term], p -> abs(p - t.j - s) <= {int(slack)})))"))
        found = found.select("_key", "width", "names", "exact", "near").filter((F.size("exact") > 0) | F.col("near"))
        hits = found if hits is None else hits.unionByName(found)
    each = hits.groupBy("_key").agg(
        F.array_distinct(F.flatten(F.collect_list(F.expr("flatten(transform(exact, s -> sequence(s, s + width - 1)))")))).alias("covered"),
        F.flatten(F.collect_list(F.expr("transform(exact, s -> struct(s AS start, width AS length))"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("exact") > 0, F.col("names")))))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("near"), F.col("names"))))).alias("near"),
    )
    none = F.array().cast("array<string>")
    out = base.join(each, "_key", "left").select(
        F.col("_id").alias(id_col),
        "n_words",
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.col("items"), none).alias("items"),
        F.coalesce(F.col("near"), none).alias("_near"),
        F.coalesce(F.array_sort("spans"), F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
    )
    return out.select(id_col, "n_words", F.greatest("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "spans", F.size("_near").cast("long").alias("n_near"))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS width, array_to_string(w[k : k + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM iw WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM win),
pos AS (SELECT doc_id, width, k, array_to_string(w[k : k + width - 1], ' ') AS s FROM (SELECT doc_id, width, w, unnest(range(1, len(w) - width + 2)) AS k FROM dw, widths WHERE len(w) >= width)),
occ AS (SELECT doc_id, k, pos.width, item_id FROM pos JOIN win ON pos.width = win.width AND pos.s = win.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + width)) AS p FROM occ) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
