"""Mixture-controlled packing of token streams into fixed windows.

Sources are queues of documents. Every round of the round-robin fills one window: each queue is given its share of the
window's tokens, and what a queue can't be given in whole tokens stays as its deficit and is served in a later window.
The shares are the target proportions, by default the queues' shares of all tokens, so that all queues end together. The
state after any number of rounds has a closed form (queue s has been served floor(round * target_s) tokens), so each
document finds its windows from its place in its queue alone: tasks pack without waiting for each other, and deficits
carry across windows and partitions."""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, SPACED, buffers, lean, mix
from .shared import checkpointed

#: The schedule has at most so many queues. Sources beyond that share the last one, in which they are interleaved by their
#: places, so each of them keeps its share there.
MAX_QUEUES = 1024
#: Tokens of a bucket of the shared queue, and the most buckets; a bucket is ordered by one task.
BUCKET_TOKENS, MAX_BUCKETS = 1_000_000, 65_536
#: Words whose ids a worker keeps at once.
CACHE = 300_000
#: Bytes of text that are encoded at once; a longer text is encoded alone.
ENCODED = 4 << 20
#: Words whose distinct ones are found at once.
BLOCK_WORDS = 1 << 19
#: The lowest 0 to 8 bytes of a 64-bit number.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Letters for which lower-casing and normalising don't go letter by letter, or needn't.
FOREIGN = re.compile("[^\x00-\u017f]|\u0130")
#: Marks that may follow a word's letters, and how many of them are looked up apart from the word.
MARKS, RUN = string.punctuation, 8
MARK = np.zeros(256, bool)
MARK[list(MARKS.encode())] = True
#: Between U+00C0 and U+017F, in UTF-8: the two signs, and the letter that becomes a letter and a mark in lower case.
NO_LETTERS = [0xC397, 0xC3B7, 0xC4B0]


class Generations(dict):
    """What ``find`` gives for a key, kept for the keys in use: after more than CACHE of them ``turn`` begins a new generation,
    to which keys of the last one move when they are asked for again."""

    def __init__(self, find: Callable):
        super().__init__()
        self.find, self.before = find, {}

    def __missing__(self, key):
        found = self.before.get(key)
        self[key] = found = self.find(key) if found is None else found
        return found

    def turn(self) -> None:
        if len(self) > CACHE:
            self.before = dict(self)
            self.clear()


def distinct(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each group of equal words (byte strings at ``start`` of the given sizes; 24 bytes of ``raw`` follow each start),
    and each word's group. Words are compared whole; one of more than 24 bytes is a group of its own."""
    wide = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    keys = [wide[start + k] & LOW_BYTES[np.clip(size - k, 0, 8)] for k in (0, 8, 16)]
    by = np.argsort(mix(keys[0] + mix(keys[1] + mix(keys[2]))))
    new = np.ones(len(by), bool)
    new[1:] = size[by[1:]] > 24
    for x in keys:
        x = x[by]
        new[1:] |= x[1:] != x[:-1]
    new[1:] |= size[by[1:]] != size[by[:-1]]
    group = np.empty(len(by), np.int64)
    group[by] = np.cumsum(new) - 1
    return by[new], group


class Encoder:
    """Token ids of texts by a tokenizer that drops white space, so that a text's ids are those of its words in order.

    Ids are kept by word and by pre-token as little-endian bytes. The equal words of some hundred texts are looked up once,
    and only new pre-tokens go through the tokenizer's model. Where that changes no id, A-Z are lower-cased first."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.kind = "H" if max(self.tokenizer.get_vocab_size(), end_id) < 65536 else "I"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added_low = [a.encode().lower() for a in self.added]
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.tokenizer.pre_tokenizer else None
        # whether lower-case ASCII letters and the marks after them are two pre-tokens, as written, and no added token is such a word
        self.plain = split is not None and self.tokenizer.normalizer is not None and not any(x.isalpha() or not x for x in (a.rstrip(MARKS) for a in self.added))
        self.plain = self.plain and all([x for x, _ in split(self.tokenizer.normalizer.normalize_str("Word" + m))] == ["word", m] for m in [*MARKS, *(a + b for a in MARKS for b in MARKS), MARKS])

        # how the pre-tokenizer writes each small letter below U+0180, where lower-casing and normalising go letter by letter
        self.letters = {c: split(chr(c))[0][0] for c in range(128, 0x180) if chr(c).isalpha()} if self.plain else {}
        self.model = self.tokenizer.model
        self.known, self.pieces = Generations(self.word), Generations(self._piece)

    def _piece(self, piece: str) -> bytes:
        return array(self.kind, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def word(self, data: bytes) -> bytes:
        word = data.decode()
        if self.plain:
            base = word.rstrip(MARKS)
            if base.isalpha() and (base.isascii() or not FOREIGN.search(base)):
                low = base.lower() if base.isascii() else base.lower().translate(self.letters)
                return self._piece(low) if len(base) == len(word) else self.pieces[low] + self.pieces[word[len(base) :]]
        if any(a in word for a in self.added):
            return array(self.kind, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if self.tokenizer.normalizer:
            word = self.tokenizer.normalizer.normalize_str(word)
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(word) if self.tokenizer.pre_tokenizer else [(word, None)]
        return b"".join([self.pieces[x] for x, _ in split])

    def _words(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes to read words from, followed by zeros, and the start and size of each word there.

        Where it changes no id, A-Z are lower-cased and up to RUN marks after a letter are a word of their own: not in words
        beyond U+017F, whose letters may take up what follows them when normalised, and not beside added tokens."""
        n = len(raw)
        inside = SPACED[raw]
        edge = inside.copy()
        edge[1:] &= ~inside[:-1]
        firsts = off[:-1][off[:-1] < off[1:]]
        edge[firsts] = inside[firsts]
        start = np.flatnonzero(edge)
        edge[:-1] = inside[:-1] & ~inside[1:]
        edge[-1:] = inside[-1:]
        edge[off[1:][off[1:] > 0] - 1] |= inside[off[1:][off[1:] > 0] - 1]
        size = np.flatnonzero(edge) + 1 - start
        low = LOWER[raw]
        as_is = np.zeros(len(start), bool)
        if not self.plain or any(a in data for data in [low.tobytes()] for a in self.added_low):
            as_is[:] = True
        elif n and raw.max() >= 0xC6:  # from U+0180 on
            high = np.concatenate([[0], np.cumsum(raw >= 0xC6)])
            as_is = high[start + size] > high[start]
        end = start + size
        tail = end.copy()
        live = np.flatnonzero(MARK[low[end - 1]] & ~as_is)
        for _ in range(RUN):
            tail[live] -= 1
            live = live[tail[live] > start[live]]
            live = live[MARK[low[tail[live] - 1]]]
        tail[live] = end[live]
        cut = np.flatnonzero((start < tail) & (tail < end))
        last, lead = low[tail[cut] - 1], low[np.maximum(tail[cut] - 2, 0)]
        pair = lead.astype(np.int64) << 8 | last
        latin = (last >= 0x80) & (pair >= 0xC380) & (pair <= 0xC5BF) & ~np.isin(pair, NO_LETTERS)
        cut = cut[((last >= 97) & (last <= 122)) | latin]
        shift = n * as_is
        start, end = np.insert(start + shift, cut + 1, tail[cut]), np.insert(end + shift, cut, tail[cut])
        return np.concatenate([low, raw, np.zeros(32, np.uint8)]), start, end - start

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a column, an end id after each, and how many ids each has; a null text has the end id alone."""
        raw, off = buffers(column)
        data, start, size = self._words(raw, off)
        blob = data.tobytes()
        out, counts = [], []
        for k in range(0, len(start), BLOCK_WORDS):
            self.known.turn()
            self.pieces.turn()
            a, n = start[k : k + BLOCK_WORDS], size[k : k + BLOCK_WORDS]
            one, group = distinct(data, a, n)
            ids = [self.known[blob[i:j]] for i, j in zip(a[one].tolist(), (a + n)[one].tolist(), strict=True)]
            flat = np.frombuffer(b"".join(ids), self.kind)
            many = np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize
            first = np.cumsum(many) - many
            count = many[group]
            out.append(flat[np.arange(int(count.sum())) + np.repeat(first[group] - (np.cumsum(count) - count), count)])
            counts.append(count)
        ids, count = np.concatenate([np.zeros(0, self.kind), *out]), np.concatenate([np.zeros(0, np.int64), *counts])
        before = np.concatenate([[0], np.cumsum(count)])
        # words lie in the order of the texts
        own = np.searchsorted(start % max(1, len(raw)), off)
        ends = before[own[1:]] + np.arange(len(off) - 1)
        whole = np.full(len(ids) + len(ends), self.end_id, self.kind)
        kept = np.ones(len(whole), bool)
        kept[ends] = False
        whole[kept] = ids
        return whole, np.diff(before[own]) + 1


@lru_cache(maxsize=2)
def worker_encoder(path: str, end_id: int) -> Encoder:
    """The encoder of this Python worker: what it has learned serves the worker's later tasks too."""
    return Encoder(path, end_id)


def _tokenise(path: str, end_id: int):
    """Ids of each document, and the tokens of its source that the task had before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block = worker_encoder(path, end_id), TaskContext.get().partitionId()
        before: dict[str | None, int] = {}
        for batch in batches:
            size, k = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while k < batch.num_rows:
                done = size[k - 1] if k else 0
                part = batch.slice(k, max(1, int(np.searchsorted(size, done + ENCODED, "right")) - k))
                k += part.num_rows
                ids, counts = encoder.encode(part.column(1))
                at = []
                for source, n in zip(part.column(2).to_pylist(), counts.tolist(), strict=True):
                    at.append(before.get(source, 0))
                    before[source] = at[-1] + n
                ends = np.concatenate([[0], np.cumsum(counts)]) * ids.itemsize
                binary = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([block] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(counts), pa.array([ids.itemsize] * len(at), pa.int32()), binary],
                    names=["_id", "_source", "block", "before", "n", "width", "ids"],
                )

    return run


class Schedule:
    """Who is served what in each round, and where that lies in the output.

    ``totals``: tokens of each queue. ``targets``: proportions (by default the totals). The queues run dry one after
    another if the targets differ from the totals; from then on the rest share the windows in their proportions. A phase
    is a span in which the same queues are served: (first output position, served before it by queue, to be served in it
    by queue, its rounds). Within a phase, queue s has been served floor(round * amount_s / rounds) tokens."""

    def __init__(self, totals: list[int], window: int, targets: list[float] | None = None):
        self.window, self.phases = window, []
        shares = [float(t) for t in (targets or totals)]
        served, position = [0] * len(totals), 0
        while any(left := [t - s for t, s in zip(totals, served, strict=True)]):
            live = [i for i, x in enumerate(left) if x and shares[i] > 0] or [i for i, x in enumerate(left) if x]
            p = {i: shares[i] if shares[i] > 0 else float(left[i]) for i in live}
            if targets is None:
                amount = left
            else:
                end = min(left[i] / p[i] for i in live)
                amount = [0] * len(totals)
                for i in live:
                    amount[i] = left[i] if left[i] / p[i] <= end * (1 + 1e-12) else min(left[i], int(p[i] * end))
            size = sum(amount)
            self.phases.append((position, list(served), amount, -(-size // window)))
            served = [s + a for s, a in zip(served, amount, strict=True)]
            position += size
        self.length = position

    def pieces(self, queue: int, start: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(tokens before the piece, its length, output position) of the tokens [start, start+n) of a queue, cut at rounds and windows."""
        for position, served, amount, rounds in self.phases:
            own = amount[queue]
            lo, hi = max(start - served[queue], 0), min(start + n - served[queue], own)
            if hi <= lo:
                continue
            kind = np.int64 if max(amount) < (1 << 62) // (rounds + 2) else object
            first = lo * rounds // own
            r = np.arange(first, hi * rounds // own + 3).astype(kind)
            given = np.array(amount, dtype=kind)[:, None] * np.minimum(r, rounds)[None, :] // rounds
            base = position + given.sum(axis=0)[:-1] + (given[:queue, 1:] - given[:queue, :-1]).sum(axis=0)
            for a, b, out in zip(given[queue, :-1].tolist(), given[queue, 1:].tolist(), base.tolist(), strict=True):
                t, end = max(lo, a), min(hi, b)
                while t < end:
                    at = out + t - a
                    most = min(end - t, self.window - at % self.window)
                    yield t + served[queue] - start, most, at
                    t += most


def _cut(schedule: Schedule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            rows: list[tuple] = []
            for doc, queue, at, n, width, ids in zip(*(batch.column(c).to_pylist() for c in ("_id", "queue", "at", "n", "width", "ids")), strict=True):
                wide = np.frombuffer(ids, "<u2" if width == 2 else "<u4").astype("<u4").tobytes()
                for done, length, out in schedule.pieces(queue, at, n):
                    rows.append((doc, done, length, zlib.crc32(wide[4 * done : 4 * (done + length)]), n, out // schedule.window, out % schedule.window, queue))
            for k in range(0, len(rows), 20_000):
                columns = list(zip(*rows[k : k + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("_id").type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", targets: dict[str, float] | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    Each document's ids end with ``end_id``, so null and empty texts are one token. Null sources are a queue of their own;
    the MAX_QUEUES - 1 largest sources have queues, further ones share one, interleaved by their places. ``targets`` gives up to MAX_QUEUES - 1 sources proportions, each with a queue of its own whatever its size (others
    0: they fill windows when the rest has run dry); by default each window holds the sources as the corpus does. Only
    the last sequence isn't full. Repeated rows are packed as often as they occur; null ids are kept. Documents of a
    queue follow each other in the order of the input's partitions. An empty table gives no rows."""
    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), source.alias("_source"))
    kind = rows.schema["_id"].dataType.simpleString()
    asked = list(targets or {})
    if len(asked) > MAX_QUEUES - 1:
        raise ValueError(f"{len(asked)} sources with targets; at most {MAX_QUEUES - 1}")
    tokens = checkpointed(rows.mapInArrow(_tokenise(tokenizer_path, end_id), f"_id {kind}, _source string, block int, before long, n long, width int, ids binary"))
    parts = tokens.groupBy("_source", "block").agg(F.sum("n").alias("n"))
    sizes = {r["_source"]: int(r["n"]) for r in parts.groupBy("_source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "_source").limit(MAX_QUEUES - 1 + len(asked)).collect()}
    queues = [*asked, *[q for q in sizes if q not in asked][: MAX_QUEUES - 1 - len(asked)]]
    named = [x for i, q in enumerate(queues) if q is not None for x in (F.lit(q), F.lit(i))]
    queue = F.coalesce(F.element_at(F.create_map(*named), F.col("_source")) if named else F.lit(None).cast("int"), F.when(F.col("_source").isNull(), F.lit(queues.index(None)) if None in queues else F.lit(None).cast("int")), F.lit(len(queues)))
    totals = [0] * (len(queues) + 1)
    for r in parts.groupBy(queue.alias("queue")).agg(F.sum("n").alias("n")).collect():  # a row per queue
        totals[r["queue"]] = int(r["n"])
    wanted = [*(float(targets.get(q, 0.0)) for q in queues), 0.0] if targets else None
    schedule = Schedule(totals, window, wanted)
    own = Window.partitionBy("_source")
    starts = parts.select(F.col("_source").alias("_s"), "block", F.coalesce(F.sum("n").over(own.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"), F.sum("n").over(own).alias("_total"))
    placed = tokens.withColumn("queue", queue).join(starts.withColumnRenamed("block", "_b"), (F.col("block") == F.col("_b")) & F.col("_source").eqNullSafe(F.col("_s")))
    placed = placed.withColumn("at", F.col("_first") + F.col("before"))
    if totals[-1]:
        placed = placed.filter(F.col("queue") < len(queues)).select("_id", "queue", "at", "n", "width", "ids").unionByName(_interleaved(placed.filter(F.col("queue") == len(queues)), totals[-1]))
    out = placed.select("_id", "queue", "at", "n", "width", "ids").mapInArrow(lean(_cut(schedule)), f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue long")
    return out.withColumnRenamed("_id", id_col)


def _interleaved(rows: DataFrame, total: int) -> DataFrame:
    """Documents of the sources that share a queue, in order of their places in their sources (0 to 1), so that every stretch
    of the queue holds the sources in their proportions."""
    buckets = max(1, min(MAX_BUCKETS, total // BUCKET_TOKENS))
    rows = rows.withColumn("_place", F.col("at") / F.col("_total")).withColumn("_bucket", F.least(F.floor(F.col("_place") * buckets), F.lit(buckets - 1)).cast("int"))
    sums = rows.groupBy("_bucket").agg(F.sum("n").alias("_sum"))
    firsts = sums.select("_bucket", F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # at most MAX_BUCKETS rows
    within = Window.partitionBy("_bucket").orderBy("_place", "_source", "block", "before").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(firsts), "_bucket")
    return placed.select("_id", "queue", (F.col("_start") + F.col("_within")).alias("at"), "n", "width", "ids")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
