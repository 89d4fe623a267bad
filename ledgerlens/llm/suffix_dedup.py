"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

Every window of ``length`` bytes is led to the suffix that starts at its smallest gram (a minimizer, chosen by content
alone), so equal windows meet at equal suffixes and only suffixes at minimizers are indexed. Suffixes whose gram occurs
once are dropped before any text moves; occurrences whose windows cover equal bytes (by a 128-bit digest) repeat each
other, and one of them goes on. The rest arrive in batches at the task that holds what their windows share: each batch gets a
suffix array (and one of the reversed left contexts), is merge-scanned against the levels already there, and levels of
equal size merge geometrically. Two windows are equal when their suffixes agree to the right and their left contexts
agree to the left for as long as the window reaches; longest common prefixes of neighbours in the two arrays tell that for
all windows at once."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import U64, Seen, chunks, lean, mix, signed
from .shared import checkpointed

GRAM = 64
PLACE_BITS = 24
#: Bytes of one text that are scanned at once.
SEGMENT = 1 << 23
#: Suffixes in a batch of the index.
BATCH = 4096
#: Bands of distances from a window's start to its minimizer that are indexed apart.
BANDS = 3
_C = np.random.default_rng(0xC0FFEE).integers(1, 1 << 62, GRAM // 8, dtype=np.uint64) * U64(2) + U64(1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on; zeros follow the end."""
    n = len(raw)
    padded = np.zeros(n + GRAM + 8, np.uint8)
    padded[:n] = raw
    word = np.empty(n + GRAM, np.uint64)
    for i in range(8):
        part = word[i::8]
        part[:] = np.frombuffer(padded, "<u8", len(part), i)
    total = word[:n] * _C[0]
    for k in range(1, GRAM // 8):
        total += word[8 * k : 8 * k + n] * _C[k]
    return mix(total)


def minimizers(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of ``length`` bytes that end within their text: gram hash, position, first and last window start
    of each run of windows with the same minimizer (the leftmost smallest gram). ``ends``: the end of each byte's text."""
    n, span = len(raw), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(np.uint64), none, none, none
    code = gram_hashes(raw)
    place = U64((1 << PLACE_BITS) - 1)
    key = np.full(-(-(n + span) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    key[:n] = (code & ~place) | np.arange(n, dtype=np.uint64)
    rows = key.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - length + 1
    at = (np.minimum(behind[:last], ahead[span - 1 : span - 1 + last]) & place).astype(np.int64)
    start = np.arange(last)
    good = np.flatnonzero(start + length <= ends[:last])
    if not len(good):
        return none.view(np.uint64), none, none, none
    at = at[good]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (good[1:] != good[:-1] + 1)])
    first = np.flatnonzero(new)
    final = np.concatenate([first[1:], [len(good)]]) - 1
    return code[at[first]], at[first], good[first], good[final]


def _roles(gram: np.ndarray, cover: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one chunk's occurrences, what Spark has to shuffle: places of the first occurrence of each cover (by gram), whether
    it came again, whether its gram has more than two covers here, places of those that came again, and of two occurrences
    for each gram of many covers."""
    rank = np.lexsort((cover[:, 1], cover[:, 0], gram))
    gram, cover = gram[rank], cover[rank]
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    new = new_gram | np.concatenate([[True], (cover[1:] != cover[:-1]).any(axis=1)])
    start = np.flatnonzero(new)
    again = np.diff(np.append(start, len(rank))) > 1
    group = np.cumsum(new_gram)[start] - 1
    count = np.bincount(group)
    many = count[group] > 2
    probe = many & (np.arange(len(start)) - (np.cumsum(count) - count)[group] < 2)
    return rank[start], again, many, rank[~new], rank[start[probe]]


#: What a row of the shuffle is: an occurrence, the span of one that is known to come again, or only news of a cover.
OCCURRENCE, SPAN, NEWS = 0, 1, 2


def _occurrences(length: int):
    """Minimizers of the windows of each text, combined within a chunk: of occurrences that cover equal bytes the first
    stands for all, and those of a gram with many covers go by gram and cover, so that no gram is one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            batch = batch.take(pa.array(seen.new(batch.column(0).to_pylist()), pa.int64()))
            for first, last, raw, off in chunks(batch.column(1)):
                ends = np.repeat(off[1:], np.diff(off))
                for a in range(0, max(1, len(raw)), SEGMENT):
                    b = min(len(raw), a + SEGMENT + length - 1)
                    gram, pos, lo, hi = minimizers(raw[a:b], ends[a:b] - a, length)
                    if not len(pos):
                        continue
                    row = np.searchsorted(off, lo + a, "right") - 1
                    back = a - off[row]
                    view = memoryview(np.ascontiguousarray(raw[a:b]))
                    digest = b"".join(blake2b(view[i:j], digest_size=16).digest() for i, j in zip(lo.tolist(), (hi + length).tolist(), strict=True))
                    cover = np.frombuffer(digest, np.uint64).reshape(-1, 2)
                    one, again, many, more, news = _roles(gram, cover)
                    at = np.concatenate([one, more, news])
                    role = np.repeat(np.array([OCCURRENCE, SPAN, NEWS], np.int32), [len(one), len(more), len(news)])
                    route = np.concatenate([np.where(many, cover[one, 0] | U64(1), U64(0)), mix(cover[more, 1] + row[more].astype(np.uint64) + U64(first)), np.zeros(len(news), np.uint64)])
                    twice = np.concatenate([again, np.ones(len(more), bool), np.zeros(len(news), bool)])
                    kept = batch.column(0).take(pa.array((row + first)[at]))
                    covers = pa.Array.from_buffers(pa.binary(16), len(at), [None, pa.py_buffer(np.ascontiguousarray(cover[at]))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(signed(gram[at])), pa.array(signed(route)), kept, *(pa.array((x + back)[at].astype(np.int32)) for x in (pos, lo, hi)), covers, pa.array(role), pa.array(twice)], names=["gram", "route", "_key", "pos", "lo", "hi", "cover", "role", "again"])

    return run


def _contexts(length: int):
    """The bytes that the windows of each occurrence cover, once for each band of distances between a window's start and its
    minimizer. ``gram`` is from here on a digest of the bytes that all windows of a band share: far more than the gram, so
    a passage shorter than a window that stands in many surroundings doesn't bring them together."""
    total = length - GRAM + 1
    width = -(-total // BANDS)
    bands = [(k, min(total, k + width) - 1) for k in range(0, total, width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            batch = batch.take(pa.array(seen.new(batch.column("_key").to_pylist()), pa.int64()))
            rows: list[tuple] = []
            size = 0
            for key, text, found in zip(batch.column("_key").to_pylist(), batch.column("_text"), batch.column("found"), strict=True):
                data = text.as_buffer().to_pybytes() if hasattr(text, "as_buffer") else text.as_py().encode()
                for x in found.as_py():
                    pos = x["pos"]
                    for near, far in bands:
                        lo, hi = max(x["lo"], pos - far), min(x["hi"], pos - near)
                        if lo > hi:
                            continue
                        shared = blake2b(data[pos - near : pos - far + length], digest_size=8).digest()
                        piece = data[lo : hi + length]
                        size += len(piece)
                        rows.append((int.from_bytes(shared, "little", signed=True), key, pos, lo, hi, piece))
                if size > 4_000_000:
                    yield _context_batch(rows)
                    rows, size = [], 0
            if rows:
                yield _context_batch(rows)

    return run


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["gram", "_key", "pos", "lo", "hi", "ctx"])


class Level:
    """Suffixes in the order of what follows them, and their left contexts, read backwards.

    ``least`` and ``most``: how far before its minimizer the windows of a suffix start; ``near`` and ``far``: the least
    and most of these distances at which a window was found elsewhere (far < 0: none yet)."""

    FIELDS = ("gram", "key", "pos", "least", "most", "near", "far", "right", "left")

    def __init__(self, **fields):
        self.__dict__.update(fields)

    def __len__(self) -> int:
        return len(self.gram)

    def take(self, at: np.ndarray) -> Level:
        return Level(**{f: getattr(self, f)[at] for f in self.FIELDS})

    @staticmethod
    def of(batch: pa.RecordBatch, length: int) -> Level:
        gram, pos, lo, hi = (batch.column(c).to_numpy() for c in ("gram", "pos", "lo", "hi"))
        ctx = batch.column("ctx")
        _, offsets, data = ctx.buffers()
        off = np.frombuffer(offsets, np.int32)[ctx.offset : ctx.offset + len(ctx) + 1].astype(np.int64)
        raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(1, np.uint8)])
        here = off[:-1] + (pos - lo)
        reach = np.arange(length)
        right = here[:, None] + reach
        right = raw[np.where(right < off[1:, None], right, len(raw) - 1)]
        left = here[:, None] - 1 - reach[: length - GRAM]
        left = raw[np.where(left >= off[:-1, None], left, len(raw) - 1)]
        n = len(gram)
        level = Level(gram=gram, key=np.array(batch.column("_key").to_pylist(), dtype=object), pos=pos.astype(np.int64), least=(pos - hi).astype(np.int64), most=(pos - lo).astype(np.int64), near=np.full(n, 1 << 30), far=np.full(n, -1), right=right, left=left)
        return level.take(order(right))

    @staticmethod
    def merged(a: Level, b: Level) -> Level:
        both = Level(**{f: np.concatenate([getattr(a, f), getattr(b, f)]) for f in Level.FIELDS})
        return both.take(order(both.right))


def order(rows: np.ndarray) -> np.ndarray:
    """The lexicographic order of rows of bytes; two sorted runs are merged in linear time."""
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


def common(rows: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row and the one before it (-1 for the first)."""
    same = rows[1:] == rows[:-1]
    first = np.argmin(same, axis=1)
    return np.concatenate([[-1], np.where(same.all(axis=1), rows.shape[1], first)])


def merge_scan(levels: list[Level], length: int) -> None:
    """Marks in every level the windows that occur again in any of them."""
    right = np.concatenate([x.right for x in levels])
    left = np.concatenate([x.left for x in levels])
    least, most = np.concatenate([x.least for x in levels]), np.concatenate([x.most for x in levels])
    n = len(least)
    if n < 2:
        return
    by_right, by_left = order(right), order(left)
    lcp, lcs = common(right[by_right]), common(left[by_left])
    near, far = np.full(n, 1 << 30), np.full(n, -1)
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(least.min()), int(most.max()) + 1):
        here = np.flatnonzero((least <= o) & (o <= most))
        if len(here) < 2:
            continue
        a[by_right] = np.cumsum(lcp < length - o)
        b[by_left] = np.cumsum(lcs < o) if o else 0
        code = a[here] * (n + 1) + b[here]
        rank = np.argsort(code, kind="stable")
        code = code[rank]
        same = code[1:] == code[:-1]
        twice = np.zeros(len(here), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = here[rank[twice]]
        near[hit] = np.minimum(near[hit], o)
        far[hit] = o
    k = 0
    for x in levels:
        x.near, x.far = np.minimum(x.near, near[k : k + len(x)]), np.maximum(x.far, far[k : k + len(x)])
        k += len(x)


class Family:
    """The levels of the suffixes that are still open: a new batch is scanned against all of them, then equal sizes merge."""

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def scan(self, batch: Level) -> None:
        merge_scan([batch, *self.levels], self.length)

    def add(self, batch: Level) -> None:
        while self.levels and len(self.levels[-1]) < 2 * len(batch):
            batch = Level.merged(self.levels.pop(), batch)
        self.levels.append(batch)

    def close(self) -> list[Level]:
        closed, self.levels = self.levels, []
        return closed


def _index(length: int):
    """Rows come sorted by gram; what a batch ends with stays open for the next one."""

    def spans(levels: list[Level]) -> Iterator[pa.RecordBatch]:
        for x in levels:
            if (hit := np.flatnonzero(x.far >= 0)).size:
                yield pa.RecordBatch.from_arrays([pa.array(x.key[hit].tolist(), pa.binary()), pa.array(x.pos[hit] - x.far[hit], pa.int64()), pa.array(x.pos[hit] - x.near[hit] + length, pa.int64())], names=["_key", "first", "past"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, gram = Family(length), None
        for batch in (b.slice(k, BATCH) for b in batches for k in range(0, b.num_rows, BATCH)):
            level = Level.of(batch, length)
            last = batch.column("gram")[batch.num_rows - 1].as_py()
            if gram is not None and not (level.gram == gram).any():
                yield from spans(family.close())
            family.scan(level)
            if gram != last:
                yield from spans(family.close())
            stay = level.gram == last
            yield from spans([level.take(np.flatnonzero(~stay))])
            family.add(level.take(np.flatnonzero(stay)))
            gram = last
        yield from spans(family.close())

    return run


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """``rows``: _id, _key (digest of the text), _text. The bytes [first, past) of texts, by _key, that are in repeated
    windows; copies of a text count as one text here."""
    found = rows.select("_key", "_text").mapInArrow(lean(_occurrences(length)), "gram long, route long, _key binary, pos int, lo int, hi int, cover binary, role int, again boolean")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(parts, "gram", "route").withColumn("_code", F.when(F.col("role") == OCCURRENCE, F.xxhash64("_key", "pos", "lo")))
    w, alike = Window.partitionBy("gram", "route"), Window.partitionBy("gram", "route", "cover")
    # copies of a text have the same codes: two codes of one cover are two places
    found = found.withColumns({"_a": F.min("cover").over(w), "_b": F.max("cover").over(w), "_first": F.min("_code").over(alike), "_last": F.max("_code").over(alike)}).filter(F.col("role") != NEWS)
    # a cover that came again is marked there; whatever its route, one occurrence of it stands for it in the index if its gram has other covers
    twice = F.col("again") | ((F.col("role") == OCCURRENCE) & (F.col("_first") != F.col("_last")))
    stands = (F.col("role") == OCCURRENCE) & (F.col("_code") == F.col("_first")) & ((F.col("_a") != F.col("_b")) | (F.col("route") != 0))
    found = checkpointed(found.select("gram", "_key", "pos", "lo", "hi", twice.alias("twice"), stands.alias("stands")).filter("twice OR stands"))
    whole = found.filter("twice").select("_key", F.col("lo").cast("long").alias("first"), (F.col("hi") + length).cast("long").alias("past"))
    by_text = found.filter("stands").groupBy("_key").agg(F.collect_set(F.struct("pos", "lo", "hi")).alias("found"))
    # a large group of copies can be split among tasks here; what copies give twice marks copies only, and those go whole
    texts = rows.join(by_text, "_key").select("_key", "_text", "found")
    contexts = texts.mapInArrow(lean(_contexts(length)), "gram long, _key binary, pos int, lo int, hi int, ctx binary")
    indexed = contexts.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(lean(_index(length)), "_key binary, first long, past long")
    return whole.unionByName(indexed)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept (binary).

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same text or another;
    matches never cross texts. ``spans``: the maximal removed runs (first, past). Null texts are empty; a text shorter than
    ``length`` is kept whole; of equal texts of that length or more every byte goes. Repeated rows are copies of each
    other. An empty table gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(text)).alias("_key"), text.alias("_text"))
    spans = repeated_spans(rows, length)
    copies = rows.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("_key", F.lit(True).alias("whole"), F.lit(None).cast("struct<first:long,past:long>").alias("span"))
    marks = spans.select("_key", F.lit(False).alias("whole"), F.struct("first", "past").alias("span")).unionByName(copies).groupBy("_key").agg(F.max("whole").alias("whole"), F.array_sort(F.collect_list("span")).alias("spans"))
    # overlapping and touching spans make one run
    union = "aggregate(spans, cast(array() as array<struct<first:bigint,past:bigint>>), (runs, s) -> CASE WHEN size(runs) > 0 AND element_at(runs, -1).past >= s.first THEN concat(slice(runs, 1, size(runs) - 1), array(struct(element_at(runs, -1).first AS first, greatest(element_at(runs, -1).past, s.past) AS past))) ELSE concat(runs, array(s)) END)"
    marks = checkpointed(marks.select("_key", "whole", F.expr(union).alias("runs")))
    out = rows.join(marks, "_key", "left").withColumn("_b", F.col("_text").cast("binary")).withColumn("n_bytes", F.octet_length("_text").cast("long"))
    out = out.withColumn("spans", F.when(F.col("whole") & (F.col("n_bytes") >= length), F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("past")))).otherwise(F.coalesce("runs", F.array().cast("array<struct<first:long,past:long>>"))))
    kept = "aggregate(sequence(0, size(spans)), cast('' as binary), (b, i) -> concat(b, substring(_b, cast(CASE WHEN i = 0 THEN 0 ELSE spans[i - 1].past END AS int) + 1, cast((CASE WHEN i = size(spans) THEN n_bytes ELSE spans[i].first END) - (CASE WHEN i = 0 THEN 0 ELSE spans[i - 1].past END) AS int))))"
    out = out.withColumn("kept", F.when(F.size("spans") == 0, F.col("_b")).otherwise(F.expr(kept)))
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.past - s.first)")
    return out.select(F.col("_id").alias(id_col), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "spans", "kept")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
