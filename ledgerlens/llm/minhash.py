"""Near-duplicate documents by one-permutation hashing with optimal densification.

One hash of each shingle serves all bins: its leading bits choose the bin, and a bin keeps its smallest hash. An empty bin borrows
from the first bin that isn't empty in an order of its own, the same for all sets. Bands of bins are buckets. The members of
a bucket are linked to its smallest one only, a star of one edge less than members; the edges are verified on full sets. Stars
lose the links of members that miss their centre, so buckets that still hold several components are gone through again, in blocks:
bitmaps of the shingles bound the overlap of members of different components, and where the bound allows the similarity, they
are verified. A unit with very many such pairs first gives a spanning forest of them, and what is left between components
after that in one more pass, so that each pass verifies a number of pairs in proportion to the members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, lean, mix, signed
from .components import components
from .jaccard_join import _component_units, _sets, _unseen
from .linking import by_component, text_key, verified
from .shared import checkpointed

#: Bands of bins: two sets of 0.8 similarity share no band of 4 among 32 once in 20 million pairs.
BANDS, WIDTH = 32, 4
#: Bits of a bitmap for each shingle, rounded up to a power of two: so many that an overlap bound is close to the overlap.
MULT = 8
#: Pairs for each member up to which a unit gives them all at once.
DENSE = 32
#: Members of a block of a bucket. Comparing bitmaps is quick, so blocks are large and few copies of a member are sent.
BLOCK = 2048


def borrow_order(bins: int) -> np.ndarray:
    """For each bin an order of all bins."""
    rng = np.random.default_rng(0xB1D5)
    return np.array([rng.permutation(bins) for _ in range(bins)])


def signature(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``s``: sorted distinct hashes, at least one."""
    bins = len(order)
    at = (s >> U64(65 - bins.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    filled, out = np.zeros(bins, bool), np.zeros(bins, np.uint64)
    filled[at[first]] = True
    out[at[first]] = s[first]
    if len(first) < bins:
        empty = np.flatnonzero(~filled)
        donor = order[empty]
        out[empty] = out[donor[np.arange(len(empty)), filled[donor].argmax(1)]]
    return out


def bitmap(s: np.ndarray) -> bytes:
    width = max(64, 1 << (MULT * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & U64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _signatures(k: int, bands: int, width: int):
    """_key, size, bitmap, and one hash a band. A set without shingles has no bands."""
    order = borrow_order(bands * width)
    weights = np.random.default_rng(0xBA2D).integers(1, 1 << 63, (bands, width), dtype=np.uint64) * U64(2) + U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _unseen(batches):
            for first, last, found in _sets(texts, k):
                full = [signature(s, order) for s in found if len(s)]
                sigs = np.array(full, np.uint64).reshape(len(full), bands, width)
                hashes = mix((mix(sigs) * weights).sum(2, dtype=np.uint64))
                sizes = np.array([len(s) for s in found], np.int64)
                off = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys.slice(first, last - first), pa.array(sizes), pa.array(list(map(bitmap, found)), pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(signed(hashes.ravel())))], names=["_key", "n", "bits", "bands"])

    return run


class Bitmaps:
    """Bitmaps of the sets of a unit, by their width; and folded to half of it, since sets of the next larger width may still link."""

    def __init__(self, sizes: np.ndarray, bits: list[bytes]):
        self.sizes, self.width = sizes, np.array([8 * len(b) for b in bits])
        self.row = np.zeros(len(bits), np.int64)
        self.of: dict[int, np.ndarray] = {}
        self.extra: dict[int, np.ndarray] = {}  # elements of each set that share a bit with another of the set
        for w in set(self.width.tolist()):
            mine = np.flatnonzero(self.width == w)
            self.row[mine] = np.arange(len(mine))
            self._keep(w, np.frombuffer(b"".join(bits[i] for i in mine), np.uint64).reshape(len(mine), w // 64), sizes[mine])
            if w > 64:
                whole = self.of[w]
                self._keep(-w, whole[:, : w // 128] | whole[:, w // 128 :], sizes[mine])

    def _keep(self, name: int, rows: np.ndarray, sizes: np.ndarray) -> None:
        self.of[name], self.extra[name] = rows, sizes - np.bitwise_count(rows).sum(1, dtype=np.int64)

    def overlap(self, i: int, others: np.ndarray) -> np.ndarray:
        """No more elements of set ``i`` are in each of the others. Sets of widths further apart than one step can't link: 0."""
        out, wide = np.zeros(len(others), np.int64), int(self.width[i])
        for mine, theirs in ((wide, wide), (wide, -2 * wide), (-wide, wide // 2)):
            if mine in self.of and theirs in self.of:
                at = np.flatnonzero(self.width[others] == abs(theirs))
                rows = self.row[others[at]]
                common = np.bitwise_count(self.of[theirs][rows] & self.of[mine][self.row[i]]).sum(1, dtype=np.int64)
                out[at] = np.minimum(self.extra[theirs][rows], self.extra[mine][self.row[i]]) + common
        return out


def _across(percent: int, most: int | None):
    """Pairs of members of different components of a unit (gid, bi, bj) that may reach the similarity; rows come sorted by unit.

    A pair that shares several buckets comes from the least of them that both list. A unit with more than
    ``most`` pairs a member (if given) gives those of a forest over the components instead, likely ones first, and marks them as cut."""

    def found(group: tuple, rows: list[tuple]) -> Iterator[tuple[float, int, int]]:
        _, bi, bj = group
        part, sizes, roots = (np.array([r[c] for r in rows]) for c in (0, 2, 3))
        maps = Bitmaps(sizes, [r[4] for r in rows])
        second = np.flatnonzero(part == bj)
        for i in np.flatnonzero(part == bi).tolist():
            others = np.arange(i + 1, len(rows)) if bi == bj else second
            others = others[roots[others] != roots[i]]
            both = sizes[others] + sizes[i]
            most = maps.overlap(i, others)
            may = 100 * most >= percent * (both - most)
            for j, ratio in zip(others[may].tolist(), (most[may] / (both - most)[may]).tolist(), strict=True):
                yield ratio, i, j

    def work(group: tuple, rows: list[tuple]) -> tuple[list[tuple[int, int]], bool]:
        all_pairs = list(found(group, rows))
        cut = most is not None and len(all_pairs) > most * len(rows)
        if cut:
            pairs = forest(all_pairs, [r[1] for r in rows], [r[3] for r in rows])
        else:
            lists = [frozenset(r[5]) for r in rows]
            pairs = [(i, j) for _, i, j in all_pairs if min(lists[i] & lists[j]) == group[0]]
        return [(min(rows[i][1], rows[j][1]), max(rows[i][1], rows[j][1])) for i, j in pairs], cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def out() -> pa.RecordBatch:
            pairs, cut = work(group, held) if len(held) > 1 else ([], False)
            return pa.record_batch({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64()), "cut": pa.array([cut] * len(pairs), pa.bool_())})

        for batch in batches:
            units = list(zip(*(batch.column(c).to_pylist() for c in ("gid", "bi", "bj")), strict=True))
            for g, row in zip(units, zip(*(batch.column(c).to_pylist() for c in batch.schema.names[3:]), strict=True), strict=True):
                if g != group:
                    if held:
                        yield out()
                    group, held = g, []
                held.append(row)
        if held:
            yield out()

    return run


def forest(pairs: list[tuple[float, int, int]], names: list[int], roots: list[int]) -> list[tuple[int, int]]:
    """The pairs of a spanning forest over ``roots`` that takes the highest bounds first, then the least names: buckets that share sets
    choose the same pairs."""
    parent = {r: r for r in roots}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept, left = [], len(parent) - 1
    for _, i, j in sorted(pairs, key=lambda p: (-p[0], min(names[p[1]], names[p[2]]), max(names[p[1]], names[p[2]]))):
        if (x := top(roots[i])) != (y := top(roots[j])):
            parent[x] = y
            kept.append((i, j))
            left -= 1
            if not left:
                break
    return kept


def minhash_links(rows: DataFrame, k: int, percent: int, bands: int = BANDS, width: int = WIDTH, dense: int = DENSE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows``: _key (digest of the text), _text. Gives a row per text (_key, id, n), verified links (a, b) of ids, and the
    components of the links (node, root)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = rows.mapInArrow(lean(_signatures(k, bands, width)), "_key binary, n long, bits binary, bands array<long>").repartition(parts, "_key").dropDuplicates(["_key"])
    sets = checkpointed(sets.withColumn("id", F.monotonically_increasing_id()))  # ids hold once the table is written
    members = sets.select("id", F.posexplode("bands").alias("j", "band")).select("id", F.xxhash64("j", "band").alias("band"))
    buckets = checkpointed(members.groupBy("band").agg(F.min("id").alias("least"), F.count("*").alias("df")).filter("df > 1"))
    joined = checkpointed(members.join(buckets, "band"))
    star = checkpointed(joined.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct())
    names = sets.select("id", "_key")
    tested = verified(rows, names, star, k, percent)
    roots = components(tested.filter("ok").select("a", "b"))
    for most in (dense, None):
        rooted = joined.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = rooted.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("band")
        # a set stands in one bucket a band at most, so the list of its buckets is short
        left = checkpointed(rooted.join(mixed, "band").groupBy("id", "root").agg(F.collect_list(F.struct(F.col("band").alias("gid"), "df")).alias("in")))
        units = _component_units(left.join(sets.select("id", "n", "bits"), "id").select("id", "n", "root", "bits", F.col("in.gid").alias("gids"), F.inline("in")), BLOCK)
        units = units.select("gid", "bi", "bj", "i", "id", "n", "root", "bits", "gids").repartition(parts, "gid", "bi", "bj").sortWithinPartitions("gid", "bi", "bj")
        pairs = checkpointed(units.mapInArrow(lean(_across(percent, most)), "a long, b long, cut boolean").groupBy("a", "b").agg(F.max("cut").alias("cut")))
        more = checkpointed(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti").select("a", "b"))
        if not more.isEmpty():
            found = verified(rows, names, more, k, percent)
            tested = checkpointed(tested.unionByName(found))
            if not found.filter("ok").isEmpty():
                roots = components(tested.filter("ok").select("a", "b"))
        if pairs.filter("cut").isEmpty():
            break
    return sets.select("_key", "id", "n"), tested.filter("ok").select("a", "b"), roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, dense: int = DENSE) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links, itself included), kept.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z in lower case; a text of fewer than ``k`` words is one shingle;
    shingles are compared by 64-bit hashes. Equal texts are one set, worked on once. Null and empty texts and texts of white space have no
    shingle, link with nothing and are kept. A row is kept if its id is its component's, so rows that repeat an id share
    that value; null ids never become a component's id unless it has no other, and are kept only then. A link is
    always confirmed on the full sets; one of 0.8 similarity stays unseen with a probability of 5 in 10**8. An empty table
    gives no rows; columns other than id and text are ignored. ``dense`` (see DENSE) changes the work, not the result."""
    if not 50 <= percent <= 100:
        raise ValueError("bands and bitmaps are laid out for 50 to 100 percent")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sets, _, roots = minhash_links(docs.select(text_key(text).alias("_key"), text.alias("_text")), k, percent, dense=dense)
    out = by_component(docs, sets, roots, id_col, text)
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op12_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=80)
