"""Backoff scores against a slow version that counts and scores letter by letter, and odd tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerlens.llm.language_id import predict_language, train

MAX_N = 5


def tokens(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def cut(word, n):
    word = f"<{word}>" if n > 1 else word
    return [word[i : i + n] for i in range(len(word) - n + 1)]


class Slow:
    def __init__(self, rows, least):
        self.langs = sorted({lang for _, lang in rows if lang is not None})
        self.tables = [defaultdict(Counter) for _ in range(MAX_N + 1)]
        for text, lang in rows:
            for word in tokens(text) if lang is not None else ():
                self.tables[0][word][lang] += 1
                for n in range(1, MAX_N + 1):
                    for g in cut(word, n):
                        self.tables[n][g][lang] += 1
        self.tables = [{t: c for t, c in table.items() if sum(c.values()) >= least} for table in self.tables]
        self.sums = [{lang: sum(c[lang] + 0.5 for c in table.values()) for lang in self.langs} for table in self.tables]

    def log(self, n, term, lang):
        return math.log((self.tables[n][term][lang] + 0.5) / self.sums[n][lang])

    def word(self, word, lang):
        if word in self.tables[0]:
            return self.log(0, word, lang)
        for n in range(MAX_N, 0, -1):
            known = [g for g in cut(word, n) if g in self.tables[n]]
            if known:
                return sum(self.log(n, g, lang) for g in known) / len(known) * n / MAX_N
        return 0.0

    def text(self, text):
        found = tokens(text)
        if not found or not self.langs:
            return "und", 0.0
        total = {lang: sum(self.word(w, lang) for w in found) for lang in self.langs}
        best = max(self.langs, key=lambda x: total[x])
        return best, 1 / sum(math.exp((total[x] - total[best]) / math.sqrt(len(found))) for x in self.langs)


def made(pick, letters):
    return " ".join("".join(pick.choice(letters) for _ in range(pick.randrange(1, 7))) for _ in range(30))


@pytest.mark.parametrize("least", [1, 3])
def test_scores_against_counting(spark, least):
    pick = random.Random(9)
    kinds = {"aa": "abcde", "bb": "cdefé", "cc": "efgабв", None: "xyz"}
    rows = [(made(pick, letters), lang) for lang, letters in kinds.items() for _ in range(12)]
    table = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model, slow = train(table, min_count=least), Slow(rows, least)
    asked = [None, "", " \n", "12 34 _", "x", "zzz zzz", "abc", "ABC, abc! 7", "ééé", "д", *(made(pick, "abcdefgéабвxyz") for _ in range(40)), "abcd efg " * 30_000]
    asked += asked[-3:]
    docs = spark.createDataFrame([(None if i % 7 == 0 else i % 20, t, "z", 0.5, i) for i, t in enumerate(asked)], "doc_id long, text string, lang_pred string, score double, n int")
    got = {r["n"]: (r["lang_pred"], r["score"]) for r in predict_language(docs, model).collect()}
    assert len(got) == len(asked)
    for n, text in enumerate(asked):
        lang, score = slow.text(text)
        assert got[n][1] == pytest.approx(score, abs=1e-9), text and text[:60]
        assert got[n][0] == lang or score < 0.5 + 1e-9, text and text[:60]


def test_ties_go_to_the_first_language(spark):
    table = spark.createDataFrame([(1, "same words here", "yy"), (2, "same words here", "xx")], "doc_id long, text string, lang string")
    got = predict_language(table.drop("lang"), train(table, min_count=1)).collect()
    assert [(r["lang_pred"], round(r["score"], 9)) for r in got] == [("xx", 0.5)] * 2


def test_a_model_of_nothing(spark):
    table = spark.createDataFrame([(1, "some words", None), (2, None, "xx")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in predict_language(table, train(table)).collect()} == {("und", 0.0)}
