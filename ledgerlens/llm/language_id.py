"""Language identification by word-first backoff.

A word that the model knows adds its log frequency in each language. A word that it doesn't know is scored by the
longest character n-grams of it that are known, then by shorter ones for what is left, down to single characters."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import lean
from .sampling import crc_mod, per_label_sample
from .shared import with_fields

UND = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Scores of words that a task keeps at once.
CACHE = 300_000


def letters(token: str) -> str:
    return token if token.isalpha() else "".join(c for c in token if c.isalpha())


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class BackoffModel:
    """Log frequencies of words and of 1..max_n-grams by language, as rows of one matrix.

    ``tables[0]`` gives the row of a known word, ``tables[n]`` that of an n-gram."""

    def __init__(self, langs: list[str], words: dict[str, list[int]], ngrams: dict[str, list[int]], max_n: int, smooth: float = 0.5):
        self.langs, self.max_n = langs, max_n
        self.tables: list[dict[str, int]] = []
        blocks = [np.zeros((0, len(langs)))]
        first = 0
        for n in range(max_n + 1):
            counts = words if n == 0 else {g: c for g, c in ngrams.items() if len(g) == n}
            self.tables.append({term: first + i for i, term in enumerate(counts)})
            if counts:
                table = np.array(list(counts.values()), dtype=np.float64) + smooth
                blocks.append(np.log(table / table.sum(axis=0)))
                first += len(counts)
        self.matrix = np.vstack(blocks)

    def word_score(self, word: str) -> np.ndarray:
        """Log scores of a word by language: its own, or else the mean over its known n-grams of the longest length that has any, damped by each step back."""
        if (row := self.tables[0].get(word)) is not None:
            return self.matrix[row]
        for n in range(self.max_n, 0, -1):
            table = self.tables[n]
            if hits := [row for g in grams(word, n) if (row := table.get(g)) is not None]:
                return self.matrix[hits].sum(axis=0) * (n / (self.max_n * len(hits)))
        return np.zeros(len(self.langs))

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """A task's memory of words: a growing matrix of their scores, emptied when it holds CACHE words."""

    def __init__(self, model: BackoffModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, len(self.model.langs) + 1))

    def add(self, token: str) -> int:
        """The token's row: its scores, then 1 if it has a letter."""
        k = len(self.at)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        if word := letters(token):
            self.rows[k, :-1] = self.model.word_score(word)
            self.rows[k, -1] = 1
        self.at[token] = k
        return k

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs = self.model.langs
        names, scores = [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            if len(self.at) > CACHE:
                self.clear()
            get, add = self.at.get, self.add
            rows = [add(w) if (k := get(w)) is None else k for w in WORD.findall(text.lower())] if text else []
            total = self.rows[rows].sum(axis=0)
            n = total[-1]
            if not n or not langs:
                names.append(UND)
                continue
            best = int(np.argmax(total[:-1]))
            names.append(langs[best])
            # the posterior of the mean evidence of a word, sharpened by the root of their number
            scores[i] = 1.0 / np.exp((total[:-1] - total[best]) / math.sqrt(n)).sum()
        return names, scores


def _count(langs: list[str], max_n: int):
    at = {name: i for i, name in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter() for _ in langs]
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[at[lang]].update(WORD.findall(text.lower()) if text else ())
        for i, counts in enumerate(seen):
            found: Counter = Counter()
            for token, c in counts.items():
                if word := letters(token):
                    found[f"w{word}"] += c
                    for n in range(1, max_n + 1):
                        for g in grams(word, n):
                            found[f"{n}{g}"] += c
            items = list(found.items())
            for k in range(0, len(items), 50_000):
                part = items[k : k + 50_000]
                yield pa.record_batch({"term": pa.array([t for t, _ in part], pa.string()), "lang_at": pa.array([i] * len(part), pa.int32()), "n": pa.array([c for _, c in part], pa.int64())})

    return run


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key: tuple[str, ...] = ("doc_id",), per_lang: int = 1500, max_n: int = 5, max_words: int = 150_000, max_ngrams: int = 150_000, min_count: int = 3) -> BackoffModel:
    """Fits on about ``per_lang`` documents of each language (bounds: per_lang documents, max_words words and max_ngrams n-grams, the most frequent ones)."""
    rows = labelled.filter(F.col(text_col).isNotNull())
    sample, counts = per_label_sample(rows, lang_col, list(key), per_lang)
    langs = sorted(counts)
    if not langs:
        return BackoffModel([], {}, {}, max_n)
    terms = sample.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).mapInArrow(lean(_count(langs, max_n)), "term string, lang_at int, n long")
    table = terms.groupBy("term", "lang_at").agg(F.sum("n").alias("n")).groupBy("term").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang_at", "n"))).alias("by"))
    table = table.filter(F.col("all") >= min_count)
    is_word = F.substring("term", 1, 1) == "w"
    found: tuple[dict, dict] = ({}, {})
    for k, (part, most) in enumerate(((table.filter(is_word), max_words), (table.filter(~is_word), max_ngrams))):
        top = part.orderBy(F.desc("all"), "term").limit(most).select("term", "by").toArrow()
        for term, by in zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True):
            have = dict(by)
            found[k][term[1:]] = [have.get(i, 0) for i in range(len(langs))]
    return BackoffModel(langs, found[0], found[1], max_n)


def predict_language(docs: DataFrame, model: BackoffModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added (replacing columns of these names).

    Null texts and texts without a letter: 'und', score 0. Repeated rows and rows with null ids each get theirs; an empty table gives no
    rows, and a model learned from one gives 'und' for all. Ties go to the language first in order. Whole texts are read.
    The model's size is bounded by its training parameters; it travels as a broadcast variable."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rest = docs.drop("lang_pred", "score")
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value.reader()
        for batch in batches:
            names, scores = reader.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(lean(run), with_fields(rest, lang_pred="string", score="double"))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = train(docs.filter(~held_out).select("doc_id", "text", "lang"))
    found = predict_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
