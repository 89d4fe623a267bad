"""Similarity join of documents on their word shingles, with signature trees.

Sets that reach the similarity share one of their first shingles in any fixed order, so the sets under one such shingle
form a group (the upper level of the tree, dealt out by Spark); a set stays in a group only if another set there is of
such a size, and stands so early, that the two may reach the similarity. Within a group a signature tree holds OR-combined bitmaps
and size ranges, and a dual traversal prunes node pairs by the greatest overlap they may have. What is left is verified
on the full sets. This is done twice: first along a spanning forest of each group's candidates, where a large group is
dealt out as blocks that each meet one block of pivots; then for all candidates between different components of the links
found so far. The sets of one component are dealt into blocks of their own then, and no block meets another of the same
component, so a group of millions of near copies costs in proportion to its size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import SPACED, Filter, Seen, chunks, lean, shingles, signed, words
from .components import components
from .shared import checkpointed
from .signature_tree import Leaf, candidates, forest

#: Frequent shingles that are ordered last; any number of them gives the same links.
MAX_FREQUENT = 200_000
#: Sets of a block of a group. A traversal takes one or two blocks at once.
BLOCK = 512
#: Bits of a bitmap for each element, rounded up to a power of two.
MULT = 2
#: A set of more groups than this doesn't carry their list, so its pairs may come from several groups.
LISTED = 64


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for first, last, raw, off in chunks(column):
        code, _, at = words(raw, off, SPACED)
        yield first, last, list(shingles(code, at, k))


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts (columns 0 and 1) that the task hasn't had yet."""
    seen = Seen()
    for batch in batches:
        new = pa.array(seen.new(batch.column(0).to_pylist()), pa.int64())
        if len(new):
            yield batch.column(0).take(new), batch.column(1).take(new)


def _frequent(k: int, local: int = 3, room: int = 1_500_000):
    """Shingles that occur in ``local`` texts among ``room`` shingles that a task reads in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= local
            return pa.record_batch({"token": pa.array(signed(s[keep])), "n": pa.array(n[keep].astype(np.int64))})

        for _, texts in _unseen(batches):
            for _, _, found in _sets(texts, k):
                held += found
                size += sum(map(len, found))
                if size >= room:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def _bitmap(s: np.ndarray) -> bytes:
    width = max(64, 1 << (MULT * len(s)).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _signatures(k: int, percent: int, frequent):
    """Size, bitmap and first shingles of each set: rare ones in order of their hashes, then the frequent ones by how frequent they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = frequent.value
        gate = np.zeros(1 << 22, bool)
        gate[often >> np.uint64(42)] = True
        for keys, texts in _unseen(batches):
            for first, last, found in _sets(texts, k):
                firsts = []
                for s in found:
                    n = len(s)
                    if n and len(often):
                        maybe = np.flatnonzero(gate[s >> np.uint64(42)])
                        at = np.minimum(np.searchsorted(often, s[maybe]), len(often) - 1)
                        is_often = often[at] == s[maybe]
                        maybe, at = maybe[is_often], at[is_often]
                        if len(maybe):
                            rare = np.ones(n, bool)
                            rare[maybe] = False
                            s = np.concatenate([s[rare], s[maybe[np.argsort(rank[at], kind="stable")]]])
                    firsts.append(s[: n - -(-percent * n // 100) + 1])
                off = np.concatenate([[0], np.cumsum([len(s) for s in firsts])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(off), pa.array(signed(np.concatenate(firsts))))
                yield pa.RecordBatch.from_arrays([keys.slice(first, last - first), pa.array([len(s) for s in found], pa.int64()), pa.array(list(map(_bitmap, found)), pa.binary()), tokens], names=["_key", "n", "bits", "tokens"])

    return run


def _hashes(k: int, wanted):
    """The whole sets of the texts whose key the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _unseen(batches):
            go = pa.array(wanted.value.has(keys.to_pylist()))
            keys, texts = keys.filter(go), texts.filter(go)
            for first, last, found in _sets(texts, k):
                off = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys.slice(first, last - first), pa.ListArray.from_arrays(pa.array(off), pa.array(signed(np.concatenate(found))))], names=["_key", "hashes"])

    return run


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            at, bit = Filter.places(batch.column(0).to_pylist())
            yield pa.record_batch({"word": pa.array(at), "bit": pa.array(signed(bit))})


def _join_groups(percent: int, spanning: bool):
    """Candidate pairs of each unit of a group; rows come sorted by unit. Columns: gid, bi, bj, i, id, n, bits, root, gids.

    A unit is a block of a group with itself (bi = bj) or with another. When ``spanning``, the unit (0, j) also joins
    block j with itself. Of the groups that two sets share, the first gives the pair."""

    def work(group: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        leaves = [Leaf(at, n, int.from_bytes(bits, "little"), 8 * len(bits), root) for at, (_, _, n, bits, root, _) in enumerate(rows)]
        gid, bi, bj = group
        if bi == bj:
            found = candidates(leaves, percent)
        else:
            one, other = ([x for x, r in zip(leaves, rows, strict=True) if r[0] == b] for b in (bi, bj))
            found = candidates(one, percent, other) if one and other else []
            if spanning and other:
                found += candidates(other, percent)
        if spanning:
            pairs = forest(found, [r[1] for r in rows])
        else:
            lists = {at: frozenset(rows[at][5]) for _, *pair in found for at in pair if rows[at][5]}
            pairs = [(a, b) for _, a, b in found if a not in lists or b not in lists or min(lists[a] & lists[b]) == gid]
        return [(min(rows[a][1], rows[b][1]), max(rows[a][1], rows[b][1])) for a, b in pairs]

    def pairs(out: set) -> pa.RecordBatch:
        return pa.record_batch({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out = None, [], set()
        for batch in batches:
            ids = list(zip(*(batch.column(c).to_pylist() for c in ("gid", "bi", "bj")), strict=True))
            for g, row in zip(ids, zip(*(batch.column(c).to_pylist() for c in ("i", "id", "n", "bits", "root", "gids")), strict=True), strict=True):
                if g != group:
                    if len(held) > 1:
                        out.update(work(group, held))
                    group, held = g, []
                held.append(row)
            if len(out) > 20_000:
                yield pairs(out)
                out = set()
        if len(held) > 1:
            out.update(work(group, held))
        yield pairs(out)

    return run


def _star_units(members: DataFrame) -> DataFrame:
    """Blocks of each group by hash; block 0, the pivots, goes to every unit, each other block to its own."""
    blocks = F.ceil(F.col("df") / BLOCK).cast("int")
    dealt = members.withColumn("i", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    dealt = dealt.withColumn("bj", F.explode(F.when(F.col("i") == 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("i"))))
    return dealt.withColumn("bi", F.lit(0))


def _component_units(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of the groups that hold several components: a component of ``block`` sets or more has blocks of its own, the
    others share some; two blocks of one component never meet."""
    counts = members.groupBy("gid", "root").agg(F.count("*").alias("c"))
    big = F.col("c") >= block
    per_group = counts.groupBy("gid").agg(
        F.count("*").alias("roots"),
        F.array_sort(F.collect_list(F.when(big, F.struct("root", F.ceil(F.col("c") / block).cast("int").alias("nb"))))).alias("bigs"),
        F.ceil(F.coalesce(F.sum(F.when(~big, F.col("c"))), F.lit(0)) / block).cast("int").alias("smalls"),
    )
    mixed = members.join(per_group.filter("roots > 1"), "gid").withColumns({
        "bigs_n": F.expr("aggregate(bigs, 0, (s, b) -> s + b.nb)"),
        "own": F.expr("get(filter(bigs, b -> b.root = root), 0).nb"),
        "before": F.expr("aggregate(filter(bigs, b -> b.root < root), 0, (s, b) -> s + b.nb)"),
    })
    mixed = mixed.withColumn("i", F.expr("cast(CASE WHEN own IS NULL THEN bigs_n + pmod(xxhash64(id), smalls) ELSE before + pmod(xxhash64(id), own) END AS int)"))
    mixed = mixed.withColumn("j", F.explode(F.expr("filter(sequence(0, bigs_n + smalls - 1), b -> own IS NULL OR b < before OR b >= before + own)")))
    return mixed.withColumns({"bi": F.least("i", "j"), "bj": F.greatest("i", "j")})


def jaccard_links(rows: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``rows``: _key (binary digest of the text), _text. Gives a row per text (_key, id, n: size of its set) and verified
    links (a, b) of ids that connect whatever is connected by pairs of at least ``percent`` similarity."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    often = rows.mapInArrow(lean(_frequent(k)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n >= 12").orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toArrow()
    code = np.array(often.column("token").to_numpy(), dtype=np.int64).view(np.uint64)
    order = np.argsort(code)
    shared = spark.sparkContext.broadcast((code[order], np.array(often.column("n").to_numpy(), dtype=np.int64)[order]))
    sets = rows.mapInArrow(lean(_signatures(k, percent, shared)), "_key binary, n long, bits binary, tokens array<long>").repartition(parts, "_key").dropDuplicates(["_key"])
    sets = checkpointed(sets.withColumn("id", F.monotonically_increasing_id()))  # ids hold once the table is written
    shared.unpersist()
    # the smaller of two sets shares one of its first n - 2 * percent * n / (100 + percent) + 1; later ones only lead to sets that are no larger
    early = F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1
    firsts = sets.select("id", "n", early.alias("early"), F.posexplode("tokens").alias("p", "token")).select("token", "id", F.when(F.col("p") < F.col("early"), F.col("n")).otherwise(-F.col("n")).cast("int").alias("size"))
    firsts = firsts.repartition(parts, "token").withColumn("n", F.abs("size"))
    by_size = Window.partitionBy("token").orderBy("n", "id")
    smaller = F.last(F.when(F.col("size") > 0, F.col("n")), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    larger = F.when(F.col("size") > 0, F.lead("n").over(by_size))
    firsts = firsts.withColumns({"_s": smaller, "_l": larger}).filter((100 * F.col("_s") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("_l")))
    w = Window.partitionBy("token")
    firsts = firsts.select("token", "id", F.count("*").over(w).alias("df"), F.min("id").over(w).alias("lo"), F.bit_xor(F.xxhash64("id", F.lit(1))).over(w).alias("x1"), F.bit_xor(F.xxhash64("id", F.lit(2))).over(w).alias("x2")).filter("df > 1")
    # shingles with the same documents make one group
    groups = firsts.withColumn("gid", F.min("token").over(Window.partitionBy("df", "lo", "x1", "x2"))).filter("token = gid").select("gid", "id", "df")
    groups = groups.groupBy("id").agg(F.collect_list(F.struct("gid", "df")).alias("groups"))
    grouped = checkpointed(groups.join(sets.select("id", "_key", "n", "bits"), "id"))

    def candidates_of(units: DataFrame, spanning: bool) -> DataFrame:
        units = units.select("gid", "bi", "bj", "i", "id", "n", "bits", "root", "gids").repartition(parts, "gid", "bi", "bj").sortWithinPartitions("gid", "bi", "bj")
        return units.mapInArrow(lean(_join_groups(percent, spanning)), "a long, b long").distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        names = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(grouped.select("id", "_key"), "id"))
        bits = names.select("_key").mapInArrow(_filter_words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
        wanted = spark.sparkContext.broadcast(Filter(bits.column("word").to_numpy(), bits.column("bit").to_numpy().view(np.uint64)))
        full = rows.mapInArrow(lean(_hashes(k, wanted)), "_key binary, hashes array<long>").join(names, "_key").dropDuplicates(["id"]).select("id", "hashes")
        both = pairs.join(full.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(full.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
        common = F.size(F.array_intersect("ha", "hb"))
        out = checkpointed(both.select("a", "b", (100 * common >= percent * (F.size("ha") + F.size("hb") - common)).alias("ok")))
        wanted.unpersist()
        return out

    members = grouped.withColumns({"root": F.lit(None).cast("long"), "gids": F.lit(None).cast("array<long>")}).select("id", "n", "bits", "root", "gids", F.inline("groups"))
    tested = verified(checkpointed(candidates_of(_star_units(members), True)))
    links = tested.filter("ok").select("a", "b")
    members = grouped.join(components(links).select(F.col("node").alias("id"), "root"), "id", "left").select("id", "n", "bits", F.coalesce("root", "id").alias("root"), F.when(F.size("groups") <= LISTED, F.col("groups.gid")).alias("gids"), F.inline("groups"))
    rest = checkpointed(candidates_of(_component_units(members), False).join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    return sets.select("_key", "id", "n"), checkpointed(links.unionByName(verified(rest).filter("ok").select("a", "b")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z in lower case; a text of fewer than ``k`` words is one
    shingle; shingles are compared by 64-bit hashes, so equal sets and equal texts link. Null and empty texts and texts of
    white space have no shingle and link with nothing: their component is their own id. Null ids never become a component's
    id unless it has no other. Repeated rows each get their row. An empty table gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.unhex(F.md5(text)).alias("_key"), text.alias("_text"))
    sets, links = jaccard_links(rows, k, percent)
    ids = checkpointed(docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(text)).alias("_key")))
    least = ids.groupBy("_key").agg(F.min("_id").alias("_least"))
    texts = least.join(sets, "_key").join(components(links).select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    tops = texts.groupBy("root").agg(F.min("_least").alias("component_id"))
    by_text = texts.join(tops, "root").select("_key", "n", "component_id")
    out = ids.join(by_text, "_key")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)
