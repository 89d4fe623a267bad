"""Product codes of vectors by exact integer k-means, with LAESA pivots.

Each part position has a codebook and a few fixed pivots, taken from the entries it starts with. The distances of every part to its
pivots are computed once and kept with the vectors. In each round the distances from the pivots to the entries give a lower
bound of every part-entry distance; entries are tried in the order of their bounds, and a part is done when the next bound
exceeds the best exact distance so far. Entries of one round are sums over all parts, added up by Spark."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import lean
from .shared import stored

#: Vectors that a task compares at once.
CHUNK = 4096
#: Labels with more than this share of all rows are joined by broadcast: there are at most so many.
HOT_SHARE = 4096


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(-1)


def choose_pivots(entries: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the entries, each the farthest from those before (ties: the lower index)."""
    chosen = [0]
    near = squares(entries, entries[0])
    while len(chosen) < min(most, len(entries)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squares(entries, entries[chosen[-1]]))
    return entries[chosen]


def nearest(x: np.ndarray, near: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each row's nearest entry (ties: the lower index), and how many distances were computed.

    ``near``: distances to the pivots, rounded to 32 bits; ``slack`` is more than what the rounding may have cost."""
    reach = np.sqrt(squares(pivots[:, None], entries[None]).astype(np.float64))
    near = near.astype(np.float64)
    bound = np.abs(near[:, 0, None] - reach[0])
    for j in range(1, len(pivots)):
        np.maximum(bound, np.abs(near[:, j, None] - reach[j]), out=bound)
    slack = near.max(1) * 2.0**-22 + 1e-3
    order = np.argsort(bound, axis=1, kind="stable")
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries))
    live, tried = np.arange(len(x)), 0
    for k in range(len(entries)):
        entry = order[live, k]
        go = bound[live, entry] - slack[live] <= np.sqrt(best[live].astype(np.float64))
        live, entry = live[go], entry[go]
        if not len(live):
            break
        tried += len(live)
        d = squares(x[live], entries[entry])
        better = (d < best[live]) | ((d == best[live]) & (entry < at[live]))
        best[live[better]], at[live[better]] = d[better], entry[better]
    return at, best, tried


class Codebooks:
    """Entries of each part position, and the pivots that stay."""

    def __init__(self, first: np.ndarray, parts: int, pivots: int):
        self.cuts = np.cumsum([0, *(len(a) for a in np.array_split(np.arange(first.shape[1]), parts))])
        self.entries = [first[:, a:b].copy() for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.pivots = [choose_pivots(e, pivots) for e in self.entries]
        self.places = np.cumsum([0, *map(len, self.pivots)])

    def part(self, x: np.ndarray, p: int) -> np.ndarray:
        return x[:, self.cuts[p] : self.cuts[p + 1]]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of each vector's parts to their pivots."""
        return np.concatenate([np.sqrt(squares(self.part(x, p)[:, None], piv[None]).astype(np.float64)) for p, piv in enumerate(self.pivots)], axis=1).astype(np.float32)

    def assign(self, x: np.ndarray, near: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for p, (entries, pivots) in enumerate(zip(self.entries, self.pivots, strict=True)):
            yield p, *nearest(self.part(x, p), near[:, self.places[p] : self.places[p + 1]], entries, pivots)[:2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, kind).reshape(len(column), width)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            yield batch.slice(at, CHUNK)


def _with_distances(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            near = books.distances(_matrix(b.column("q"), books.cuts[-1], np.int64))
            off = pa.array(np.arange(0, near.size + 1, near.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("q"), pa.ListArray.from_arrays(off, pa.array(near.ravel()))], names=["vec_id", "label", "q", "near"])

    return run


def _sums(books: Codebooks):
    """For each entry how many parts chose it and the sum of each component, over all that the task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        totals = [np.zeros(e.shape, np.int64) for e in books.entries]
        for b in _pieces(batches):
            x, near = _matrix(b.column("q"), books.cuts[-1], np.int64), _matrix(b.column("near"), books.places[-1], np.float32)
            for p, at, _ in books.assign(x, near):
                np.add.at(counts[p], at, 1)
                np.add.at(totals[p], at, books.part(x, p))
        for p, (n, total) in enumerate(zip(counts, totals, strict=True)):
            entry, axis = np.nonzero(np.broadcast_to(n[:, None] > 0, total.shape))
            if len(entry):
                yield pa.record_batch({"part": pa.array([p] * len(entry), pa.int32()), "entry": pa.array(entry.astype(np.int32)), "axis": pa.array(axis.astype(np.int32)), "n": pa.array(n[entry]), "total": pa.array(total[entry, axis])})

    return run


def _codes(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            x, near = _matrix(b.column("q"), books.cuts[-1], np.int64), _matrix(b.column("near"), books.places[-1], np.float32)
            index, error = np.zeros((len(x), len(books.entries)), np.uint8), np.zeros(len(x), np.int64)
            for p, at, best in books.assign(x, near):
                index[:, p] = at
                error += best
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes().hex() for r in index]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, pivots: int = 4, scale: int = 256) -> DataFrame:
    """One row per kept row of ``vectors``: id, label, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components go. A component x becomes floor(scale * x). Vectors are cut into
    ``parts`` consecutive parts; where these don't divide their length, the first are longer by one. Each codebook starts with that
    part of the ``entries`` (at most 256) smallest ids (null last, ties by the vector), of fewer rows with fewer. In each of ``rounds`` every part goes to its
    nearest entry (squared Euclidean distance, ties to the lower index), and each entry becomes the floored mean of its parts;
    an unused one stays. ``label_error`` sums the errors of equal labels, nulls together.
    Vectors of another length than the commonest (ties: the longest), or with a component so
    large that an error may not fit a long (2**27 for 64 components), can't be coded: they come out with null code and error and have no part in the
    codebooks. Repeated rows each count. Other columns are ignored. An empty table gives no rows."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    v = F.col(vector_col)
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    out_kind = vectors.schema[label_col].dataType
    kept = vectors.filter(whole).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))
    length = kept.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length["d"] if length else 0
    limit = math.isqrt((2**63 - 1) // (4 * max(1, d)))
    fits = (F.size("q") == d) & F.forall("q", lambda x: (x > -limit) & (x < limit))
    usable = kept.filter(fits)
    first = [r["q"] for r in usable.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).collect()]
    name, kinds = None, f"vec_id {vectors.schema[id_col].dataType.simpleString()}, label {out_kind.simpleString()}"

    def uncoded(df: DataFrame) -> DataFrame:
        return df.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))

    coded = uncoded(kept)
    if first:
        books = Codebooks(np.array(first, np.int64).reshape(len(first), d), parts, pivots)
        held = stored(usable.mapInArrow(lean(_with_distances(books)), f"{kinds}, q array<long>, near array<float>"))
        for _ in range(rounds):
            sums = held.select("q", "near").mapInArrow(lean(_sums(books)), "part int, entry int, axis int, n long, total long")
            # at most parts x entries x components rows, whatever the table holds
            for r in sums.groupBy("part", "entry", "axis").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
                books.entries[r["part"]][r["entry"], r["axis"]] = int(r["total"]) // r["n"]
        name = books.digest()
        coded = stored(held.mapInArrow(lean(_codes(books)), f"{kinds}, code string, error long").unionByName(uncoded(kept.filter(~fits))))
    by_label = coded.groupBy("label").agg(F.count("*").alias("_n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    total = coded.count()
    is_hot = F.col("_n") * HOT_SHARE > total  # at most HOT_SHARE labels
    named = by_label.select(F.col("label").alias("_label"), "_n", F.expr("try_cast(label_error AS bigint)").alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    hot = coded.join(F.broadcast(named.filter(is_hot)), same)
    cold = coded.join(F.broadcast(named.filter(is_hot).select("_label")), same, "left_anti").join(named.filter(~is_hot), same)
    out = hot.unionByName(cold)
    return out.select(F.col("vec_id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(name).cast("string").alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def _step(k: int) -> str:
    """SQL of the k-th assignment to books b{k}, and of the books that follow from it."""
    return f"""
a{k} AS (SELECT vec_id, rid, part, v, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM (
  SELECT x.vec_id, x.rid, x.part, x.v, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM x JOIN b{k} b USING (part)) GROUP BY ALL),
m{k} AS (SELECT part, entry, list(total ORDER BY axis) AS v FROM (
  SELECT part, entry, axis, CAST(floor(sum(v[axis]) / count(*)) AS BIGINT) AS total FROM a{k}, (SELECT unnest(range(1, 5)) AS axis) GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry)),"""


#: The tables' vectors have 64 components.
ORACLE = f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS q, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS (SELECT vec_id, rid, part, q[4 * part + 1 : 4 * part + 4] AS v FROM e, (SELECT unnest(range(16)) AS part)),
b0 AS (SELECT part, rid AS entry, v FROM x WHERE rid < 64),{_step(0)}{_step(1)}{_step(2)}
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM b2),
c AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a2 GROUP BY rid)
SELECT e.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY e.label) AS BIGINT) AS label_error, books.h AS codebooks_sha256 FROM e JOIN c USING (rid), books
"""
