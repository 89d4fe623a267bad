"""A Merkle manifest of a table, with a proof for each row, by butterfly exchange.

Rows are sorted by group and identifier and cut into aligned blocks of ``fanout ** levels`` leaves. A block's task hashes its
own subtree. Then blocks exchange roots round by round: in each round the aligned groups of blocks under one run of ``fanout`` nodes
swap the roots of their subtrees, each block with one block of each other group, and every block hashes the common ancestor for
itself. After the last round each block holds the root and all upper siblings, so there is no pass back down. The roots of
the groups are the leaves of one more tree of the same kind."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrays import lean
from .shared import checkpointed

STEP = "array<struct<left:string, right:string>>"
#: Bits of monotonically_increasing_id that count rows within a partition.
ROW_BITS = 33


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """SHA-256 of the values in order, each as its length in bytes, a colon and itself; a null is a dash."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that ``start`` gives with the siblings of ``proof``."""
    return F.aggregate(proof, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of ``proof`` in one string: level by level upwards, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """_g, _pos (from 0), _n (leaves of the group), _node, _item of rows (_g, _node, _item): one sort by range, no task with a whole group.

    Positions come from the sorted partitions: how many rows of the group stand in the ones before, and the place in its own."""
    keys = ["_g", *(F.asc_nulls_first(F.col("_item")[c]) for c in order), "_node", "_salt"]
    # the salt only parts rows that are alike in all else: a third of all rows may be
    at = checkpointed(rows.withColumn("_salt", F.rand(7)).orderBy(*keys).drop("_salt").withColumn("_at", F.monotonically_increasing_id()))
    at = at.withColumns({"_part": F.shiftright("_at", ROW_BITS), "_at": F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))})
    spans = at.groupBy("_part", "_g").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    group = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_c").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("_part", "_g", (before - F.col("_first")).alias("_shift"), F.sum("_c").over(group).alias("_n"))
    return at.join(spans, ["_part", "_g"]).select("_g", (F.col("_at") + F.col("_shift")).alias("_pos"), "_n", "_node", "_item")


def _levels(nodes: list[str], fanout: int, most: int | None) -> list[list[str]]:
    """The nodes of each level: ``most`` levels above the leaves, or until one node remains."""
    out = [nodes]
    while len(out) <= most if most is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return out


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """(group, block) and its rows; rows come sorted by them, and a block is never larger than its leaves and one row."""
    key, held = None, []
    for batch in batches:
        names = list(zip(batch.column("_g").to_pylist(), batch.column("_block").to_pylist(), strict=True))
        first = 0
        for i in range(1, len(names) + 1):
            if i == len(names) or names[i] != names[first]:
                if names[first] != key and held:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = names[first]
                held.append(batch.slice(first, i - first))
                first = i
    if held:
        yield key, pa.Table.from_batches(held)


def _roots(fanout: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, block), rows in _by_block(batches):
            n = rows.column("_n")[0].as_py()
            top = _levels(rows.column("_node").to_pylist(), fanout, levels if n > fanout**levels else None)[-1][0]
            yield pa.record_batch({"_g": [g], "_block": pa.array([block], pa.int64()), "_blocks": pa.array([-(-n // fanout**levels)], pa.int64()), "_node": [top]})

    return run


def _butterfly(state: DataFrame, fanout: int) -> DataFrame:
    """_g, _block, _blocks, _node with the root of the group as _node, and _steps up to it. Each round is kept in the shared folder."""
    state = checkpointed(state.withColumn("_steps", F.lit(None).cast(STEP)).withColumn("_steps", F.coalesce("_steps", F.array().cast(STEP))))
    most = state.agg(F.max("_blocks")).first()[0] or 1
    for r in range(math.ceil(math.log(most, fanout) - 1e-9) + 1):
        width = fanout**r
        if width >= most:
            break
        nodes = F.ceil(F.col("_blocks") / width)
        own = F.floor(F.col("_block") / width)
        first = own - own % fanout
        others = F.filter(F.sequence(first, F.least(first + fanout, nodes) - 1), lambda s: s != own)
        asked = state.filter(nodes > 1).select("_g", "_block", F.explode(others).alias("_s"), "_blocks")
        # of the other group's blocks, the one in the like place; a group cut short by the end is shared evenly
        answering = F.col("_s") * width + F.col("_block") % width % F.least(F.lit(width), F.col("_blocks") - F.col("_s") * width)
        asked = asked.select("_g", "_block", "_s", answering.alias("_asked"))
        told = asked.join(state.select("_g", F.col("_block").alias("_asked"), F.col("_node").alias("_other")), ["_g", "_asked"])
        told = told.groupBy("_g", "_block").agg(F.array_sort(F.collect_list(F.struct("_s", "_other"))).alias("_told"))
        met = state.join(told, ["_g", "_block"], "left").withColumn("_told", F.coalesce("_told", F.array()))

        def side(keep):
            return F.array_join(F.transform(F.filter("_told", keep), lambda x: x["_other"]), "")

        step = F.struct(side(lambda x: x["_s"] < own).alias("left"), side(lambda x: x["_s"] > own).alias("right"))
        met = met.withColumn("_step", step)
        grown = F.sha2(F.concat("_step.left", "_node", "_step.right"), 256)
        state = checkpointed(met.select("_g", "_block", "_blocks", F.when(nodes > 1, grown).otherwise(F.col("_node")).alias("_node"), F.when(nodes > 1, F.concat("_steps", F.array("_step"))).otherwise(F.col("_steps")).alias("_steps")))
    return state


def _proofs(fanout: int, levels: int):
    """Rows of each block, the first of them its upper siblings: their items, the roots, and for each leaf its whole proof."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_block(batches):
            upper, rows = rows.slice(0, 1), rows.slice(1)
            n = rows.column("_n")[0].as_py()
            tree = _levels(rows.column("_node").to_pylist(), fanout, levels if n > fanout**levels else None)
            above = upper.column("_steps")[0].as_py()
            left: list[str] = []
            right: list[str] = []
            for i in range(len(rows)):
                for nodes in tree[:-1]:
                    first = i - i % fanout
                    left.append("".join(nodes[first:i]))
                    right.append("".join(nodes[i + 1 : first + fanout]))
                    i //= fanout
                left += [s["left"] for s in above]
                right += [s["right"] for s in above]
            each = len(tree) - 1 + len(above)
            steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
            proof = pa.ListArray.from_arrays(pa.array(range(0, each * len(rows) + 1, each) if each else [0] * (len(rows) + 1), pa.int32()), steps)
            roots = {c: pa.array([upper.column(f"_{c}")[0].as_py()] * len(rows), pa.string()) for c in ("subroot", "root")}
            item = rows.column("_item").combine_chunks()
            yield pa.record_batch({"_item": item.chunk(0) if isinstance(item, pa.ChunkedArray) else item, **roots, "proof": proof})

    return run


def _blocked(df: DataFrame, *columns) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*columns).repartition(parts, "_g", "_block").sortWithinPartitions("_g", "_block", "_pos")


def _grown(rows: DataFrame, order: list[str], fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """The placed leaves with their blocks, and the blocks after the last round."""
    placed = checkpointed(_placed(rows, order).withColumn("_block", F.floor(F.col("_pos") / fanout**levels)))
    roots = _blocked(placed, "_g", "_block", "_pos", "_n", "_node").mapInArrow(lean(_roots(fanout, levels)), "_g string, _block long, _blocks long, _node string")
    return placed, _butterfly(roots, fanout)


def _proven(placed: DataFrame, upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    nothing = {"_pos": F.lit(-1).cast("long"), "_n": F.lit(None).cast("long"), "_node": F.lit(None).cast("string"), "_item": F.lit(None).cast(placed.schema["_item"].dataType)}
    leaves = placed.withColumns({"_subroot": F.lit(None).cast("string"), "_root": F.lit(None).cast("string"), "_steps": F.lit(None).cast(STEP)})
    met = _blocked(leaves.unionByName(upper.withColumns(nothing)), "_g", "_block", "_pos", "_n", "_node", "_item", "_subroot", "_root", "_steps")
    schema = StructType.fromDDL(f"subroot string, root string, proof {STEP}")
    return met.mapInArrow(lean(_proofs(fanout, levels)), StructType([placed.schema["_item"], *schema.fields])).select("_item.*", "subroot", "root", "proof")


def merkle_proofs(rows: DataFrame, node: str = "leaf", group: str = "lang", order: tuple[str, ...] = ("doc_id",), fanout: int = 2, levels: int = 10) -> DataFrame:
    """The columns of ``rows`` and, for each row, ``subroot`` (of its group), ``root`` (of all) and ``proof``.

    ``node`` holds digests as hex text. The leaves of a group ascend by ``order`` (nulls first) and then by digest, groups by name
    (null first, bytewise). A run of ``fanout`` nodes becomes their digest, as often as more than one remains; a shorter last run
    too, even of one. ``proof`` has a step for each level up to the root, with the digests to the left and to the right of the
    own node; see ``fold``. Rows that are alike in all of this each have a leaf of their own; which of them gets which place is not
    defined, so they form the same set of results. ``levels`` sets the size of blocks and no result. Columns of ``rows`` that are
    called subroot, root or proof are left out. An empty table gives no rows."""
    rows = rows.drop("subroot", "root", "proof")
    name = F.col(group).cast("string")
    keyed = checkpointed(rows.select(F.coalesce(F.concat(F.lit("="), name), F.lit("-")).alias("_g"), F.col(node).alias("_node"), F.struct(*rows.columns).alias("_item")))
    placed, state = _grown(keyed, list(order), fanout, levels)
    tops = state.filter("_block = 0").select(F.lit("").alias("_g"), "_node", F.struct("_g").alias("_item"))
    top_leaves, top = _grown(tops, ["_g"], fanout, levels)
    groups = _proven(top_leaves, top.select("_g", "_block", F.col("_node").alias("_subroot"), F.col("_node").alias("_root"), "_steps"), fanout, levels)
    groups = groups.select("_g", F.col("root").alias("_root"), F.col("proof").alias("_more"))
    upper = state.join(groups, "_g").select("_g", "_block", F.col("_node").alias("_subroot"), "_root", F.concat("_steps", "_more").alias("_steps"))
    return _proven(placed, upper, fanout, levels)


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: tuple[str, ...] = ("doc_id",), fanout: int = 2) -> DataFrame:
    """``order``, ``group``, leaf, subroot, root and proof of each row of ``docs``; a leaf is the digest of ``columns``.

    Null values, empty and very long texts are values like others; other columns are neither read nor returned."""
    names = list(dict.fromkeys([*order, group]))
    return merkle_proofs(docs.select(*names, leaf(*map(F.col, columns)).alias("leaf")), "leaf", group, order, fanout)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    read = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    rows = docs.select("doc_id", "lang", leaf(*read).alias("leaf"), F.when(hit, leaf(*read[:3], more, read[4])).alias("_tampered"))
    out = merkle_proofs(rows).withColumn("folded_root", fold(F.coalesce("_tampered", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 by its bits; a level of a tree at a time; at last each document folds its own way up.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, source, lang, n_chars, text,
    xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 7 = 0 AS hit
  FROM documents),
f AS (SELECT *, coalesce(CAST(strlen(CAST(doc_id AS VARCHAR)) AS VARCHAR) || ':' || doc_id, '-') || coalesce(CAST(strlen(source) AS VARCHAR) || ':' || source, '-') || coalesce(CAST(strlen(lang) AS VARCHAR) || ':' || lang, '-') AS head,
    coalesce(CAST(strlen(CAST(n_chars AS VARCHAR)) AS VARCHAR) || ':' || n_chars, '-') AS n0, coalesce(CAST(strlen(CAST(n_chars + 1 AS VARCHAR)) AS VARCHAR) || ':' || (n_chars + 1), '-') AS n1, coalesce(CAST(strlen(text) AS VARCHAR) || ':' || text, '-') AS body FROM d),
l AS (SELECT doc_id, g, sha256(head || n0 || body) AS leaf, sha256(head || CASE WHEN hit THEN n1 ELSE n0 END || body) AS start FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
t(g, lev, pos, h, n) AS (
  SELECT g, 0, pos, leaf, count(*) OVER (PARTITION BY g) FROM p
  UNION ALL
  SELECT DISTINCT g, lev, pos, h, (n + 1) // 2 FROM (SELECT g, lev + 1 AS lev, pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos) OVER (PARTITION BY g, lev, pos // 2)) AS h, n FROM t WHERE n > 1)),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos FROM t WHERE n = 1),
u(lev, pos, h, n) AS (
  SELECT 0, pos, h, count(*) OVER () FROM s
  UNION ALL
  SELECT DISTINCT lev, pos, h, (n + 1) // 2 FROM (SELECT lev + 1 AS lev, pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos) OVER (PARTITION BY lev, pos // 2)) AS h, n FROM u WHERE n > 1)),
heights AS (SELECT g, max(lev) AS top FROM t GROUP BY g),
sib AS (
  SELECT p.g, p.pos AS leafpos, t.lev, p.pos >> t.lev AS own, o.h AS other FROM p JOIN t ON t.g = p.g AND t.pos = p.pos >> t.lev AND t.n > 1 LEFT JOIN t o ON o.g = t.g AND o.lev = t.lev AND o.pos = xor(t.pos, 1)
  UNION ALL
  SELECT p.g, p.pos, hs.top + u.lev, s.pos >> u.lev, o.h FROM p JOIN heights hs USING (g) JOIN s USING (g) JOIN u ON u.pos = s.pos >> u.lev AND u.n > 1 LEFT JOIN u o ON o.lev = u.lev AND o.pos = xor(u.pos, 1)),
w(g, leafpos, lev, h) AS (
  SELECT g, pos, 0, start FROM p
  UNION ALL
  SELECT w.g, w.leafpos, w.lev + 1, sha256(CASE WHEN sib.own % 2 = 1 THEN sib.other || w.h ELSE w.h || coalesce(sib.other, '') END) FROM w JOIN sib USING (g, leafpos, lev)),
e AS (SELECT g, leafpos AS pos, arg_max(h, lev) AS folded_root FROM w GROUP BY ALL),
q AS (SELECT g, leafpos AS pos, sha256(coalesce(string_agg(other, '' ORDER BY lev), '')) AS proof_sha256 FROM sib GROUP BY ALL)
SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = (SELECT h FROM u WHERE n = 1) AS verified
FROM p JOIN s USING (g) JOIN e ON e.g = p.g AND e.pos = p.pos LEFT JOIN q ON q.g = p.g AND q.pos = p.pos
"""
