"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of words with classes. The insult transducer emits matches at weighted words and at the last
word of weighted phrases; the threat transducer emits one where a verb of harm and a person meet, in either order, with
more weight after a word of intent. Three more are composed with them: the target transducer raises matches near an
addressed person, the negation transducer takes back those in its scope, and the reported-speech transducer damps those
that a clause quotes. Lexemes, phrases and their weights are learned from labelled rows; a document's clause scores are
turned into a probability by a logistic model on the same rows."""

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

# Fixed word lists: function words of the grammar in the languages of the corpus.
TARGETS = frozenset("you your yours u he she they him her them du dich dir euch ihr sie tu te toi vous lui elle usted ustedes tú ti ellos".split())
NEGATIONS = frozenset("not no never isn't aren't don't doesn't nicht kein keine nie pas jamais ne nunca jamás tampoco".split())
REPORTS = frozenset("said says say told wrote reported quoted claims claimed sagte sagt schrieb dit disait écrit dijo dice escribió".split())
HARMS = frozenset("kill hurt destroy beat burn shoot stab crush die suffer regret töten umbringen schlagen verletzen sterben büßen tuer frapper blesser mourir regretter matar golpear herir morir sufrir".split())
INTENTS = frozenset("will shall gonna going i'll we'll you'll werde werden wirst wird vais va allons vas voy vamos vas".split())
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n\r|]+")
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, HARM, INTENT = range(8)
SCOPE = 4  # words that a negation or a target reaches
FEATURES = ("asserted", "strongest", "negated", "reported", "targeted", "threats", "matches")


class Transducer:
    """States with arcs (state, class) -> (next state, weight factor); an arc not given keeps the state and the factor 1."""

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, float]]):
        self.arcs = arcs

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.arcs.get((state, symbol), (state, 1.0))


def counting(trigger: int, matched: float, reach: int = SCOPE) -> Transducer:
    """After ``trigger``, matches among the next ``reach`` words get the factor ``matched``; then its effect ends."""
    arcs: dict[tuple[int, int], tuple[int, float]] = {}
    for left in range(reach + 1):
        for symbol in range(6):
            down = max(0, left - 1)
            arcs[left, symbol] = (reach if symbol == trigger else down, matched if left and symbol in (INSULT, THREAT) else 1.0)
    return Transducer(arcs)


def lasting(trigger: int, matched: float) -> Transducer:
    """From ``trigger`` to the end of the clause matches get the factor ``matched``."""
    return Transducer({(0, trigger): (1, 1.0), (1, INSULT): (1, matched), (1, THREAT): (1, matched)})


class Insults:
    """Emits the weight of a phrase at its last word. States: the beginnings of phrases that the words read so far end with."""

    start: tuple[str, ...] = ()

    def __init__(self, phrases: dict[tuple[str, ...], float]):
        self.phrases = phrases
        self.beginnings = {p[:n] for p in phrases for n in range(1, len(p) + 1)}

    def step(self, state: tuple[str, ...], part: str) -> tuple[tuple[str, ...], float]:
        longest = (*state, part)
        while longest and longest not in self.beginnings:
            longest = longest[1:]
        return longest, self.phrases.get(longest, 0.0)


class Threats:
    """Emits a threat where a verb of harm and a person are within SCOPE words of each other, in either order; a word of
    intent among the SCOPE words before raises its weight. States: words left for intent, person and harm."""

    start = (0, 0, 0)

    def step(self, state: tuple[int, int, int], symbol: int) -> tuple[tuple[int, int, int], float]:
        intent, person, harm = (max(0, x - 1) for x in state)
        met = (symbol == HARM and state[1] > 0) or (symbol == TARGET and state[2] > 0)
        after = (SCOPE if symbol == INTENT else intent, SCOPE if symbol == TARGET else person, 0 if met else SCOPE if symbol == HARM else harm)
        return after, (1.5 if state[0] else 1.0) if met else 0.0


class Grammar:
    """The composition of the transducers over the lexicon of weighted insults.

    ``lexicon``: weight of whole words; ``stems``: weight of word beginnings of the given ``lengths``, the longest first,
    used for words that the lexicon does not hold; ``phrases``: weight of phrases of several words."""

    def __init__(self, lexicon: dict[str, float], stems: dict[str, float], lengths: tuple[int, ...] = (4, 5, 6), phrases: dict[tuple[str, ...], float] | None = None):
        self.lexicon, self.stems, self.lengths, self.phrases = lexicon, stems, sorted(lengths, reverse=True), dict(phrases or {})
        self.parts = {w for p in self.phrases for w in p}
        self.insults, self.threats = Insults(self.phrases), Threats()
        self.machines = (counting(TARGET, 1.5), counting(NEGATION, 0.25), lasting(REPORT, 0.5))
        self.start = (Insults.start, Threats.start, 0, 0, 0)
        self.coefficients = np.zeros(len(FEATURES) + 1)
        self._composed: dict[tuple, tuple] = {}

    def read(self, word: str) -> tuple[int, float, str]:
        """The word's class, its weight as an insult, and the word itself if phrases have it."""
        part = word if word in self.parts else ""
        w = self.lexicon.get(word)
        if w is None:
            w = next((self.stems[word[:n]] for n in self.lengths if len(word) > n and word[:n] in self.stems), None)
        if w is not None:
            return INSULT, w, part
        for kind, known in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (HARM, HARMS), (INTENT, INTENTS)):
            if word in known:
                return kind, 0.0, part
        return OTHER, 0.0, part

    def arc(self, states: tuple, symbol: int, part: str) -> tuple[tuple, float, float, tuple[float, ...]]:
        """An arc of the composed machine, made when first met: next states, phrase weight, threat weight, and the factors
        that the other machines give to what is matched here."""
        found = self._composed.get((states, symbol, part))
        if found is None:
            phrase_state, phrase = self.insults.step(states[0], part)
            threat_state, threat = self.threats.step(states[1], symbol)
            emitted = THREAT if threat else INSULT if phrase or symbol == INSULT else OTHER
            factors = tuple(m.step(s, emitted)[1] for m, s in zip(self.machines, states[2:], strict=True))
            read = symbol if symbol in (TARGET, NEGATION, REPORT) else emitted
            after = (m.step(s, read)[0] for m, s in zip(self.machines, states[2:], strict=True))
            found = self._composed[states, symbol, part] = ((phrase_state, threat_state, *after), phrase, threat, factors)
        return found

    def clause(self, symbols: list[tuple[int, float, str]]) -> np.ndarray:
        """Sums over one clause: asserted, strongest (the clause's score), negated, reported, targeted, threats, matches."""
        out = np.zeros(len(FEATURES))
        states = self.start
        threats = insults = 0.0
        for symbol, weight, part in symbols:
            states, phrase, threat, (aim, deny, quote) = self.arc(states, symbol, part)
            if threat:
                threats += threat * deny * quote
                out[6] += 1
            if symbol != INSULT and not phrase:
                continue
            weight += phrase
            scored = weight * aim * deny * quote
            out[6] += 1
            insults += scored
            out[0] += scored if deny == 1 and quote == 1 else 0.0
            out[2] += weight if deny < 1 else 0.0
            out[3] += weight if quote < 1 else 0.0
            out[4] += weight if aim > 1 else 0.0
        out[1], out[5] = insults + threats, threats
        return out

    def features(self, text: str | None, cache: dict) -> np.ndarray:
        total = np.zeros(len(FEATURES))
        if not text:
            return total
        for part in CLAUSE.split(text.lower()):
            words = TOKEN.findall(part)
            symbols = []
            hit = False
            for w in words:
                s = cache.get(w)
                if s is None:
                    if len(cache) >= 300_000:
                        cache.clear()
                    s = cache[w] = self.read(w)
                hit = hit or s[0] == INSULT or s[0] == HARM or s[2] != ""
                symbols.append(s)
            if hit:
                got = self.clause(symbols)
                best = max(total[1], got[1])
                total += got
                total[1] = best
        return total

    def probability(self, feats: np.ndarray) -> np.ndarray:
        z = np.tanh(np.atleast_2d(feats) / 6.0) @ self.coefficients[1:] + self.coefficients[0]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _lexemes(stems: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                clauses = [TOKEN.findall(c) for c in CLAUSE.split((text or "").lower())]
                found = {w for c in clauses for w in c}
                seen[label].update({f"w{w}" for w in found} | {f"s{w[:n]}" for w in found for n in stems if len(w) > n} | {f"p{a} {b}" for c in clauses for a, b in zip(c, c[1:], strict=False)})
        for label in (0, 1):
            items = list(seen[label].items())
            for k in range(0, len(items), 50_000):
                part = items[k : k + 50_000]
                yield pa.record_batch({"lexeme": pa.array([t for t, _ in part], pa.string()), "label": pa.array([label] * len(part), pa.int32()), "n": pa.array([c for _, c in part], pa.int64())})

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton's method with a ridge; classes are weighted alike."""
    x = np.hstack([np.ones((len(x), 1)), np.tanh(x / 6.0)])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -40, 40)))
        g = x.T @ (weight * (p - y)) + ridge * b
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", per_class: int = 4000, max_lexemes: int = 20_000, min_docs: int = 3, min_share: float = 0.015, min_odds: float = 1.4, stems: tuple[int, ...] = (4, 5, 6)) -> Grammar:
    """Learns from the labels 0 and 1 of ``labels`` and the texts of ``docs`` with the same id.

    Bounds: about ``per_class`` labelled rows of each class, so the labels' side of the join can be broadcast, and
    ``max_lexemes`` lexemes (words, word beginnings and phrases of two words of which neither is a lexeme), each in at least
    ``min_docs`` and ``min_share`` of the toxic ones, with log odds of at least ``min_odds``. Without labels or documents (empty tables) nothing is learned. Null ids and labels are left out. Without rows of both classes every score is 0.5 at most."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
    chosen, counts = per_label_sample(known, "_label", [id_col], per_class)
    if len(counts) < 2:
        return Grammar({}, {}, stems)
    # copies of one text would make its rare words look like evidence
    rows = docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(chosen), id_col).groupBy("_text").agg(F.max("_label").alias("_label"))
    n1, n0 = (float(min(counts[k], per_class)) for k in (1, 0))
    # the log odds' lower end: two standard errors below, so that lexemes of few documents need more of a contrast
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1)) - 2 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    table = (
        rows.mapInArrow(lean(_lexemes(stems)), "lexeme string, label int, n long")
        .groupBy("lexeme").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
        .filter(F.col("a") >= max(min_docs, min_share * n1)).withColumn("odds", odds).filter(F.col("odds") >= min_odds)
        .orderBy(F.desc("odds"), F.desc("a"), "lexeme").limit(max_lexemes)
    )
    got = table.collect()
    found, times = {r["lexeme"]: float(r["odds"]) for r in got}, {r["lexeme"][1:]: int(r["a"]) for r in got if r["lexeme"][0] == "w"}
    for r in got:  # a beginning that one word accounts for says nothing of other words
        if r["lexeme"][0] == "s" and any(n >= 0.8 * r["a"] for w, n in times.items() if w.startswith(r["lexeme"][1:])):
            del found[r["lexeme"]]
    grammar = Grammar({t[1:]: w for t, w in found.items() if t[0] == "w"}, {t[1:]: w for t, w in found.items() if t[0] == "s"}, stems)
    pairs = {tuple(t[1:].split(" ")): w for t, w in found.items() if t[0] == "p"}
    free = {p: w for p, w in pairs.items() if all(grammar.read(x)[0] != INSULT for x in p)}  # what one word accounts for is no phrase
    grammar = Grammar(grammar.lexicon, grammar.stems, stems, free)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            f = [shared.value.features(t, cache).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), batch.column(1)], names=["f", "label"])

    measured = rows.mapInArrow(lean(measure), "f array<double>, label int").toArrow()
    x, y = np.array(measured.column("f").to_pylist()).reshape(-1, len(FEATURES)), np.array(measured.column("label").to_pylist())
    if len(set(y.tolist())) == 2:
        grammar.coefficients = _logistic(x, y)
    return grammar


def score_toxicity(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score double (0 to 1) and predicted int added (replacing columns of these names).

    Null and empty texts have no clause and get the score of a text without matches. Rows are scored one by one, so
    repeated rows and ties get equal scores. Whole texts are read. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    rest = docs.drop("score", "predicted")
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            g = shared.value
            f = [g.features(t, cache) for t in batch.column(at).to_pylist()]
            p = g.probability(np.array(f).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    return rest.mapInArrow(lean(run), with_fields(rest, score="double", predicted="int"))


def learn_from(spark, sf_dir: str, docs: DataFrame) -> Grammar:
    """The grammar of op9: learned from the labels of rows whose crc32(doc_id as text) mod 3 is not 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False)))
    return train(docs.select("doc_id", "text"), labels)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score_toxicity(docs.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text"), learn_from(spark, sf_dir, docs))
    return found.select("doc_id", "held_out", "score", "predicted")
