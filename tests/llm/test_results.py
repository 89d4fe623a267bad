"""Each operator on small tables, against its SQL, a brute-force version, a round trip or held-out labels."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerlens.llm import context_tree, decontamination, exact_dedup, jaccard_join, language_id, packing, queries, secret_scan, sharding, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _key string, n long, score string"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def table(spark, texts):
    """A table whose further columns have names that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 3 == 0 else f"s{i % 2}", 0, "x", "y", 7, "z") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and white texts, copies, near copies, ties, a repeated row, a long text and a null id."""
    near = " ".join(f"{w}{i}" for i in range(4) for w in BASE.split())
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, near), (5, near), (6, near.upper()), (7, near + " more"), (8, "short"), (9, "Short"), (10, "two words"), (10, "two words"), (11, (BASE + " ") * 300), (12, "É" + near[40:]), (None, "no id here")]
    return table(spark, texts)


def rows_of(sf, name="documents"):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_sql(name, agree):
    agree(queries.QUERIES[name], queries.ORACLES[name])


def removed(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        runs: list[tuple[int, int]] = []
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                runs = [*runs[:-1], (runs[-1][0], k + length)] if runs and runs[-1][1] >= k else [*runs, (k, k + length)]
        out.append(runs)
    return out


@pytest.mark.parametrize("length", [80, 400])
def test_suffix_dedup_against_all_windows(spark, sf, edge, length):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), edge):
        data = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
        expected = Counter()
        for (i, t), runs in zip(data, removed([t for _, t in data], length), strict=True):
            kept = b"".join(t[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(t)], strict=True))
            expected[(i, len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())] += 1
        got = suffix_dedup.remove_repeats(docs, length).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == expected


def test_exact_dedup_keeps_the_largest(edge):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(edge).collect()}
    assert (got[4]["keep_id"], got[4]["group_size"], got[4]["kept"]) == (6, 3, False) and got[6]["kept"]
    assert got[1]["keep_id"] == 2 and got[8]["keep_id"] == 9 and got[10]["group_size"] == 2
    assert exact_dedup.keep_one(edge).columns == edge.columns


def test_packing_covers_every_id_once(spark, sf, edge):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), edge.filter("doc_id <> 10")):
        texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in packing.pack(docs, packing.default_tokenizer()).collect():
            piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert len(piece) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
            by_doc[r["doc_id"]].append((r["start"], r["length"]))
            by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert {i: sum(n for _, n in p) for i, p in by_doc.items()} == {i: len(x) for i, x in ids.items()}
        for pieces in by_sequence.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(by_sequence) == math.ceil(sum(map(len, ids.values())) / 2048)


def test_packing_holds_target_proportions(spark):
    docs = spark.createDataFrame([(i, "word " * 49, "a" if i % 2 else "b") for i in range(400)], "doc_id long, text string, source string")
    out = packing.pack(docs, packing.default_tokenizer(), window=256, targets={"a": 3.0, "b": 1.0})
    share = defaultdict(Counter)
    for r in out.collect():
        share[r["sequence_id"]][r["queue"]] += r["length"]
    done = 0
    for k in range(20):
        done += max(share[k].values())
        assert abs(max(share[k].values()) - 192) <= 8 and abs(done - 192 * (k + 1)) <= 49, share[k]


def test_lookup_table_is_fair_and_stable():
    shards = [f"s{i}" for i in range(20)]
    full, less = sharding.fill_table(shards, 10_007), sharding.fill_table(shards[:-1], 10_007)
    counts = Counter(full.tolist())
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sum(1 for a, b in zip(full, less, strict=True) if a != 19 and a != b) < 0.05 * 10_007
    with pytest.raises(ValueError):
        sharding.fill_table(shards, 10_000)


def test_rows_are_placed_by_the_table(spark, sf):
    got = queries.QUERIES["op4_sharding"](spark, sf).collect()
    owner = sharding.fill_table([f"shard-{i:03d}" for i in range(64)], 65_537)
    assert len(got) == len(rows_of(sf)) and all(r["shard"] == f"shard-{owner[r['slot']]:03d}" for r in got)


def test_language_of_held_out_rows(spark, sf):
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in rows_of(sf)}
    got = queries.QUERIES["op5_language_id"](spark, sf).collect()
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    asked = [r for r in got if r["held_out"] and lang[r["doc_id"]][0] and len(lang[r["doc_id"]][1] or "") > 100]
    assert sum(r["lang_pred"] == lang[r["doc_id"]][0] for r in asked) >= 0.9 * len(asked)


def test_language_of_odd_texts(spark, sf, edge):
    model = language_id.train(spark.read.parquet(f"{sf}/documents.parquet"))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict_language(edge, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] != "und"


def test_secret_candidates_and_forest(spark, sf, edge):
    key = "AKIA" + "Q7ZXN4PLW8TB2RMV"
    docs = spark.createDataFrame([(1, f"the login is {key} here"), (2, "password=changeme"), (3, None), (4, ""), (5, "commit " + hashlib.sha1(b"x").hexdigest())], "doc_id long, text string")
    words = secret_scan.dictionary(spark.read.parquet(f"{sf}/documents.parquet"))
    model = secret_scan.train(secret_scan.made_findings(words, 2000), words)
    got = {r["doc_id"]: r for r in secret_scan.scan(docs, model).collect()}
    assert got[1]["match"] == key and got[1]["start"] == 13 and got[1]["is_secret"]
    assert not got[2]["is_secret"] and not got[5]["is_secret"] and 3 not in got
    pattern = re.compile(secret_scan.CANDIDATE)
    expected = Counter((r["doc_id"], m.start(), m.group()) for r in edge.collect() for m in pattern.finditer(r["text"] or ""))
    assert Counter((r["doc_id"], r["start"], r["match"]) for r in secret_scan.scan(edge, model).collect()) == expected


def test_decontamination_of_short_items_and_nulls(spark, edge):
    items = spark.createDataFrame([(1, "SHORT"), (2, BASE), (3, None), (4, "")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.find_contamination(edge, items).collect()}
    assert got[8]["n_hit"] == got[9]["n_hit"] == 1 and got[11]["n_hit"] == 24 * 300 and not got[4]["contaminated"] and got[1]["n_words"] == 0
    assert decontamination.find_contamination(edge.limit(0), items).count() == 0


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)


def test_context_tree_against_recursion(spark):
    train, depth = ["abab", "aab"], 3
    texts = [*train, "ba", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    end = bytes([context_tree.END])
    symbols = [(end * depth + t.encode() + end, k + depth) for t in train for k in range(len(t) + 1)]
    every = [(end * depth + (t or "").encode() + end, k + depth) for t in texts for k in range(len(t or "") + 1)]

    def counts(context, decision):
        n = [0, 0]
        for s, k in symbols:
            if s[:k].endswith(context) and ((s[k] | 256) >> (8 - decision.bit_length() + 1)) == decision:
                n[s[k] >> (8 - decision.bit_length()) & 1] += 1
        return n

    def weigh(context, decision):
        own = kt(*counts(context, decision))
        if len(context) == depth:
            return own, 0.0
        children = {s[k - len(context) - 1 : k] for s, k in every if s[:k].endswith(context) and ((s[k] | 256) >> (9 - decision.bit_length())) == decision}
        below = sum(weigh(c, decision)[0] for c in children)
        both = math.log((math.exp(own) + math.exp(below)) / 2)
        return both, math.exp(below) / 2 / math.exp(both)

    def score(text):
        s, total = end * depth + text.encode() + end, 0.0
        for k in range(depth, len(s)):
            for i in range(8):
                decision, bit = (1 << i) | (s[k] >> (8 - i)), s[k] >> (7 - i) & 1
                mean, left = 0.0, 1.0
                for d in range(depth + 1):
                    context = s[k - d : k]
                    a, b = counts(context, decision)
                    go = weigh(context, decision)[1] if d < depth else 0.0
                    mean, left = mean + left * (1 - go) * (b + 0.5) / (a + b + 1), left * go
                total += math.log10(mean if bit else 1 - mean)
        return total

    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in context_tree.score_texts(docs, F.col("doc_id") < 2, depth=depth).collect()}
    for i, t in enumerate(texts):
        assert got[i]["score"] == pytest.approx(score(t or ""), abs=1e-6)


def test_unigram_base_and_counts(spark, sf):
    docs = rows_of(sf)
    words = {r["doc_id"]: [w.decode("utf-8", "surrogateescape") for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (r["text"] or "").encode()))] + ["\0end"] for r in docs}
    learned = Counter(w for i, x in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in x)
    n, v = sum(learned.values()), len(learned)
    got = queries.QUERIES["op8_lm_scoring"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        x = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(learned[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((learned[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), rel=1e-9)
    size = {r["doc_id"]: len((r["text"] or "").encode()) + 1 for r in docs}
    held = [r for r in got if r["held_out"]]
    assert -sum(r["score"] for r in held) / math.log10(2) < 4 * sum(size[r["doc_id"]] for r in held)


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in rows_of(sf, "labels")}
    got = queries.QUERIES["op9_toxicity"](spark, sf).collect()
    held = [(r["score"], toxic[r["doc_id"]]) for r in got if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    high, low = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum((a > b) + 0.5 * (a == b) for a in high for b in low) >= 0.9 * len(high) * len(low)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def jaccard_classes(data, k=4):
    sets = []
    for i, t in data:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * min(len(x), len(y)) >= 85 * max(len(x), len(y)) and 100 * len(x & y) >= 85 * len(x | y):
                root[top(a)] = top(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        least[top(a)].append(i)
    return Counter((i, len(s), min((j for j in least[top(a)] if j is not None), default=None)) for a, (i, s) in enumerate(sets))


def test_jaccard_classes_against_all_pairs(spark, sf, edge):
    import random

    pick = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    made = []
    for i in range(60):
        base = [pick.choice(words) for _ in range(pick.choice([3, 5, 40, 60]))]
        for _ in range(4):
            x = list(base)
            for _ in range(pick.randrange(3)):
                x[pick.randrange(len(x))] = pick.choice(words)
            made.append((len(made) + 1000, " ".join(x)))
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), edge, table(spark, made)):
        data = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = jaccard_join.jaccard_components(docs).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == jaccard_classes(data)


def test_operators_take_empty_tables(spark, edge):
    from pyspark.sql import functions as F

    none = edge.limit(0)
    grammar = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["predicted"] for r in toxicity.score_toxicity(edge, grammar).collect()].count(None) == 0
    for out in (suffix_dedup.remove_repeats(none), exact_dedup.exact_dedup(none), packing.pack(none, packing.default_tokenizer()), sharding.shard(none, ["doc_id"], ["a", "b"], 11), jaccard_join.jaccard_components(none), context_tree.score_texts(none, F.lit(True)), language_id.predict_language(none, language_id.train(none))):
        assert out.count() == 0
