"""Language-model scores by context-tree weighting over bytes.

A byte is coded as eight binary decisions; every decision has a context tree over the preceding bytes. Each node mixes its
Krichevsky-Trofimov estimate with the product of its children's weighted estimates, over all depths up to ``depth``. The
counts come from the whole training corpus and then stand still: with the evidence of a node and of its children known,
the probability of a byte after a context is a weighted mean of the KT estimates along its path, so it depends on the
context and the byte alone. It is computed once for each (context, byte) that any text contains, where Spark has brought
the counts together, and sent to the blocks of texts that asked for it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, SPACED, chunks, lean, signed, words
from .sampling import crc_mod
from .shared import checkpointed, text_bytes

#: Stands before and after each text; UTF-8 has no such byte.
END = 0xFF
#: Bytes of text in a block.
BLOCK_BYTES = 32 << 20
LN_10 = np.log(10.0)


def context_keys(raw: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the lower-cased texts and each text's end: the ``depth`` bytes before it, the nearest first, and
    the byte itself, as one number; and the n+1 offsets of texts in them."""
    n, rows = len(raw), len(off) - 1
    at = off + np.arange(rows + 1)
    text = np.full(n + rows + depth * rows, END, np.uint8)
    # each text stands after ``depth`` end marks and before one
    shift = np.arange(1, rows + 1) * depth + np.arange(rows)
    text[np.arange(n) + np.repeat(shift, np.diff(off))] = LOWER[raw]
    size = np.diff(at)
    where = np.arange(at[-1]) + np.repeat(np.arange(1, rows + 1) * depth, size)
    key = np.zeros(at[-1], np.uint64)
    for d in range(1, depth + 1):
        key = (key << np.uint64(8)) | text[where - d].astype(np.uint64)
    return (key << np.uint64(8)) | text[where].astype(np.uint64), at


def _counts(depth: int, kinds: tuple[int, ...]):
    """Distinct keys of a block with their counts in its training texts: contexts (kind 0) and words (kind 1). Rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}

        def shrink(kind: int) -> None:
            key = np.concatenate([k for k, _ in held[kind]])
            n = np.concatenate([c for _, c in held[kind]])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            held[kind] = [(key[first], np.add.reduceat(n, first) if len(first) else n)]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                if held[kind]:
                    shrink(kind)
                    key, n = held[kind][0]
                    for i in range(0, len(key), 200_000):
                        k, c = key[i : i + 200_000], n[i : i + 200_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(np.full(len(k), block, np.int32)), pa.array(signed(k)), pa.array(c)], names=["kind", "block", "key", "n"])
                held[kind] = []

        for batch in batches:
            ids, train, text = batch.column("block").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False), batch.column("text")
            cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if ids[a] != block:
                    yield from flush()
                    block = int(ids[a])
                for first, last, raw, off in chunks(text.slice(a, b - a)):
                    learns = train[a + first : a + last]
                    for kind in kinds:
                        key, at = words(raw, off, SPACED)[::2] if kind else context_keys(raw, off, depth)
                        weight = np.repeat(learns, np.diff(at))
                        for part, counted in ((key[weight], True), (key[~weight], False)):
                            if len(part):
                                s = np.sort(part)
                                f = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                                held[kind].append((s[f], np.diff(np.append(f, len(s))) if counted else np.zeros(len(f), np.int64)))
                        if sum(len(k) for k, _ in held[kind]) > 4_000_000:
                            shrink(kind)
        yield from flush()

    return run


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _half(a) + _half(b) - _whole(a + b)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5, by Stirling's series after shifting up by eight."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def _half(a: np.ndarray) -> np.ndarray:
    return _lgamma(a + 0.5) - _lgamma(np.array(0.5))


def _whole(n: np.ndarray) -> np.ndarray:
    return _lgamma(n + 1.0)


class Tree:
    """The nodes of all binary decisions' context trees below a set of contexts, from depth ``top`` to ``depth``.

    ``keys``: sorted distinct (context, byte) numbers; ``n``: their counts in training. For each depth d, rows are the
    distinct (context of d bytes, decision), where a decision is the byte's leading bits with a 1 before them."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int, top: int):
        self.depth, self.top, self.keys = depth, top, keys
        symbol = (keys & np.uint64(255)).astype(np.int64)
        context = keys >> np.uint64(8)
        self.place, self.node, self.zeros, self.ones = {}, {}, {}, {}
        bits = [(symbol >> (7 - i)) & 1 for i in range(8)]
        decision = [(1 << i) | (symbol >> (8 - i)) for i in range(8)]
        self.bits = bits
        for d in range(depth, top - 1, -1):
            near = context >> np.uint64(8 * (depth - d))
            full = np.concatenate([(near << np.uint64(8)) | u.astype(np.uint64) for u in decision])
            self.node[d], inverse = np.unique(full, return_inverse=True)
            self.place[d] = inverse.reshape(8, -1)
            bit = np.concatenate(bits)
            weight = np.tile(n, 8).astype(np.float64)
            self.ones[d] = np.bincount(inverse, weight * bit, len(self.node[d]))
            self.zeros[d] = np.bincount(inverse, weight * (1 - bit), len(self.node[d]))
        # evidence: of a node's own estimate, and of it mixed with its children's
        self.weighted, self.below = {}, {}
        for d in range(depth, top - 1, -1):
            own = _log_kt(self.zeros[d], self.ones[d])
            if d == depth:
                self.weighted[d], self.below[d] = own, np.full(len(own), -np.inf)
                continue
            parent = np.searchsorted(self.node[d], self.up(d + 1))
            children = np.bincount(parent, self.weighted[d + 1], len(own))
            self.weighted[d] = np.logaddexp(own, children) - np.log(2.0)
            self.below[d] = children - np.log(2.0) - self.weighted[d]

    def up(self, d: int) -> np.ndarray:
        """The nodes of depth d-1 above those of depth d."""
        x = self.node[d]
        return ((x >> np.uint64(16)) << np.uint64(8)) | (x & np.uint64(255))

    def log_probability(self, carried: np.ndarray | None = None, share: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each key's byte. ``carried``, ``share``: for each node of depth ``top``, the mean of
        the estimates of a one above it, and the share that is left for it and below."""
        total = np.zeros(len(self.keys))
        mean, left = carried, share
        if mean is None:
            mean, left = np.zeros(len(self.node[self.top])), np.ones(len(self.node[self.top]))
        for d in range(self.top, self.depth + 1):
            go = np.exp(np.minimum(self.below[d], 0.0))
            one = (self.ones[d] + 0.5) / (self.ones[d] + self.zeros[d] + 1.0)
            mean, left = mean + left * (1 - go) * one, left * go
            if d < self.depth:
                parent = np.searchsorted(self.node[d], self.up(d + 1))
                mean, left = mean[parent], left[parent]
        for i in range(8):
            p = np.clip(mean[self.place[self.depth][i]], 1e-12, 1 - 1e-12)
            total += np.log(np.where(self.bits[i] == 1, p, 1 - p))
        return total


TOP = 2


def _level_two(depth: int):
    """Counts and evidence of the nodes of depth TOP; rows come sorted by their two nearest bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _groups(batches):
            t = Tree(keys, n, depth, TOP)
            yield pa.record_batch({"node": pa.array(signed(t.node[TOP])), "zeros": pa.array(t.zeros[TOP]), "ones": pa.array(t.ones[TOP]), "weighted": pa.array(t.weighted[TOP])})

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys with counts, by their two nearest bytes (column near, by which rows come sorted)."""
    near, held = None, []

    def out() -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in held])
        n = np.concatenate([c for _, c in held])
        at = np.argsort(keys)
        return keys[at], n[at]

    for batch in batches:
        ids, key, n = batch.column("near").to_numpy(), batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])) if len(ids) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if near is not None and ids[a] != near:
                yield out()
                held = []
            near = ids[a]
            held.append((key[a:b], n[a:b]))
    if held:
        yield out()


def root_shares(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node of depth TOP, sorted: the mean of the estimates of a one above it, and the share that is left for it.

    The tables here are bounded by the alphabet: at most 65,536 contexts of two bytes with 255 decisions each."""
    at = np.argsort(node)
    levels = [(node[at], zeros[at], ones[at], weighted[at])]
    places = []
    for _ in range(TOP):
        below = levels[-1]
        up = ((below[0] >> np.uint64(16)) << np.uint64(8)) | (below[0] & np.uint64(255))
        above, place = np.unique(up, return_inverse=True)
        z, o = np.bincount(place, below[1], len(above)), np.bincount(place, below[2], len(above))
        children = np.bincount(place, below[3], len(above))
        mixed = np.logaddexp(_log_kt(z, o), children) - np.log(2.0)
        places.append((place, np.exp(np.minimum(children - np.log(2.0) - mixed, 0.0)), (o + 0.5) / (z + o + 1.0)))
        levels.append((above, z, o, mixed))
    mean, left = np.zeros(len(levels[-1][0])), np.ones(len(levels[-1][0]))
    for place, go, one in reversed(places):
        mean, left = (mean + left * (1 - go) * one)[place], (left * go)[place]
    return levels[0][0], mean, left


def _key_scores(depth: int, shares):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, mean, left = shares.value
        for keys, n in _groups(batches):
            t = Tree(keys, n, depth, TOP)
            at = np.searchsorted(node, t.node[TOP])
            p = t.log_probability(mean[at], left[at])
            for i in range(0, len(keys), 200_000):
                yield pa.record_batch({"key": pa.array(signed(keys[i : i + 200_000])), "value": pa.array(p[i : i + 200_000])})

    return run


def _look_up(codes: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The value of each key; in order of the keys the search reads the sorted codes from one end to the other."""
    order = np.argsort(keys)
    out = np.empty(len(keys))
    out[order] = values[np.searchsorted(codes, keys[order])]
    return out


def _score_block(depth: int):
    """The texts of a block and the values of all keys in them."""

    def run(texts: pa.Table, values: pa.Table) -> pa.Table:
        texts, values = texts.combine_chunks(), values.combine_chunks()
        kind, key, value = (values.column(c).to_numpy() for c in ("kind", "key", "value"))
        tables = []
        for k in (0, 1):
            mine = kind == k
            codes, v = key[mine].view(np.uint64), value[mine]
            at = np.argsort(codes)
            tables.append((codes[at], v[at]))
        out = []
        for first, last, raw, off in chunks(texts.column("text")):
            key, at = context_keys(raw, off, depth)
            sums = np.add.reduceat(_look_up(*tables[0], key), at[:-1])
            word, _, wat = words(raw, off, SPACED)
            c = _look_up(*tables[1], word) if len(word) else np.zeros(0)
            csum = np.concatenate([[0.0], np.cumsum(np.log10(c + 0.5))])
            known = np.concatenate([[0], np.cumsum(c > 0)])
            out.append((first, last, sums, csum[wat[1:]] - csum[wat[:-1]], known[wat[1:]] - known[wat[:-1]], np.diff(wat), np.diff(at)))
        columns = [np.concatenate([o[i] for o in out]) for i in range(2, 7)]
        return pa.table({"_id": texts.column("_id"), "train": texts.column("train"), "log_p": columns[0], "log_c": columns[1], "known": columns[2].astype(np.int64), "n_words": columns[3].astype(np.int64), "n_symbols": columns[4].astype(np.int64)})

    return run


def score_texts(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", depth: int = 5) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``train``: a boolean column of ``docs``, true for the rows to learn from (null: false); all rows are scored. A-Z is read
    as a-z. score is log10 of the probability that the context-tree mixture gives the whole text and its end;
    bits_per_byte is its code length over its bytes and the end. base_score is the smoothed unigram score of its words and
    the end. Null and empty texts are an end alone. Equal texts get equal scores; repeated rows each get theirs and are
    learned from as often as they occur. Without training rows every bit has probability 1/2. An empty table gives no rows."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    counted = "kind byte, block int, key long, n long"
    whole = rows.withColumn("block", F.lit(0))
    near = F.shiftrightunsigned("key", 8 * (depth - TOP + 1))
    contexts = whole.mapInArrow(lean(_counts(depth, (0,))), counted).groupBy("key").agg(F.sum("n").alias("n")).withColumn("near", near)
    contexts = checkpointed(contexts.repartition(parts, "near").sortWithinPartitions("near"))
    vocabulary = whole.filter("train").mapInArrow(lean(_counts(depth, (1,))), counted).groupBy("key").agg(F.sum("n").alias("n")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    n_train = rows.filter("train").count()
    n, v = (vocabulary["n"] or 0) + n_train, vocabulary["v"] + (n_train > 0)
    upper = contexts.mapInArrow(lean(_level_two(depth)), "node long, zeros double, ones double, weighted double").toArrow()
    columns = [upper.column(c).to_numpy() for c in ("node", "zeros", "ones", "weighted")]
    shares = spark.sparkContext.broadcast(root_shares(columns[0].view(np.uint64), *columns[1:]))
    values = contexts.mapInArrow(lean(_key_scores(depth, shares)), "key long, value double").withColumn("kind", F.lit(0).cast("byte"))
    blocks = max(1, -(-text_bytes(rows, "text") // BLOCK_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("_id", F.xxhash64("text")), F.lit(blocks)).cast("int")).repartition(max(parts, min(blocks, 4096)), "block")
    asked = dealt.sortWithinPartitions("block").mapInArrow(lean(_counts(depth, (0, 1))), counted).repartition(parts, "kind", "key")
    counts = asked.withColumn("c", F.sum("n").over(Window.partitionBy("kind", "key")))
    answered = counts.join(values, ["kind", "key"], "left").select("block", "kind", "key", F.coalesce("value", F.col("c").cast("double")).alias("value"))
    scored = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_score_block(depth), f"_id {id_type}, train boolean, log_p double, log_c double, known long, n_words long, n_symbols long")
    tokens = F.col("n_words") + 1
    unit = float(np.log10(n + 0.5 * (v + 1)))
    return scored.select(
        F.col("_id").alias(id_col), (~F.col("train")).alias("held_out"), tokens.alias("n_tokens"), (F.col("known") + int(n_train > 0)).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("log_c") + F.lit(float(np.log10(n_train + 0.5))) - tokens * F.lit(unit)).alias("base_score"),
        (F.col("log_p") / F.lit(float(LN_10))).alias("score"), (-F.col("log_p") / F.lit(float(np.log(2.0))) / F.col("n_symbols")).alias("bits_per_byte"),
    )


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score_texts(docs, F.coalesce(crc_mod("doc_id", 5) != 1, F.lit(True)))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
