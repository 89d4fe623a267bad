"""Scans for secrets with a random forest against false positives, in DataFrame operations only.

Patterns find candidates with the words around them; a random forest of Spark ML, trained from labelled findings, then
tells secrets from placeholders, digests, identifiers and plain words by the candidate's length, its character
transitions (under letter pairs counted in the corpus), how much of it words of the corpus's dictionary cover, the path and
the neighbouring words on both sides."""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

# Fixed patterns of candidates: keys with a known beginning, values given to a name, and long runs of key characters.
# Values have no upper bound; possessive repeats keep a text of one long run linear.
KNOWN = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}"
GIVEN = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s*+[:=]\s*+[\"']?[^\s\"'<>]{6,}+"
LONG = r"(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[0-9A-Za-z+/_=-]{20,}+"
# Private keys in their armour, signed tokens of three parts, and passwords in addresses.
ARMOUR = r"-----BEGIN [A-Z ]*+PRIVATE KEY-----[^-]*+(?:-----END [A-Z ]*+PRIVATE KEY-----)?"
SIGNED = r"\beyJ[0-9A-Za-z_-]{5,}+\.[0-9A-Za-z_-]{5,}+(?:\.[0-9A-Za-z_-]*+)?"
ADDRESS = r"\b[A-Za-z][A-Za-z0-9+.-]{1,15}+://[^\s:/@]++:[^\s@/]++@"
CANDIDATE = rf"{ARMOUR}|{ADDRESS}|{SIGNED}|(?i:{GIVEN})|\b(?:{KNOWN})\b|(?<![0-9A-Za-z+/_=-]){LONG}(?![0-9A-Za-z+/_=-])"
NAMED = r"^[A-Za-z][A-Za-z0-9+.-]{1,15}+://[^\s:/@]++:|^(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s*+[:=]\s*+[\"']?"
# Fixed words: of placeholders and samples, of names that carry secrets, and of what looks like a secret and is none.
PLACEHOLDERS = "example|sample|dummy|placeholder|changeme|change_me|your|xxxx|test|fake|redacted|none|null|todo|default|123456|abcdef|password|secret|insert|here|foobar"
CARRIERS = "password|passwd|pwd|secret|token|key|auth|credential|login|bearer|access"
HARMLESS = "sha1|sha256|md5|commit|checksum|digest|hash|uuid|revision|etag|build|version|integrity|image|file|id"
TESTING = "test|mock|fixture|sample|example|demo|docs|spec"
FEATURES = ("length", "digits", "uppers", "lowers", "others", "to_digit", "to_letter", "case_changes", "distinct", "longest_run", "transitions", "dictionary", "hex", "known_form", "named", "carrier_before", "harmless_before", "carrier_after", "testing_near", "testing_path", "uuid", "placeholder")
CONTEXT = 60
#: Log-likelihood of a letter pair that the dictionary's words don't have.
RARE = -8.0


def dictionary(docs: DataFrame, text_col: str = "text", most: int = 50_000, least: int = 5) -> DataFrame:
    """Words of three or more letters (word, n) counted over all of ``docs``: those found ``least`` times, at most ``most`` of
    them, the most frequent ones. Nulls have no words."""
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]{3,}+"), F.lit(0))).alias("word"))
    return checkpointed(found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most))


def letter_pairs(words: DataFrame) -> dict[str, float]:
    """Log probability of a letter after another among the words of a dictionary; at most 676 pairs."""
    pairs = words.select("n", F.explode(F.regexp_extract_all("word", F.lit("(?=([a-z][a-z]))"), F.lit(1))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = {r["pair"]: r["n"] for r in pairs.collect()}
    first: dict[str, int] = {}
    for pair, n in counts.items():
        first[pair[0]] = first.get(pair[0], 0) + n
    return {pair: math.log(n / first[pair[0]]) for pair, n in counts.items()}


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row per candidate: _id, start, match, value, before and after (up to CONTEXT characters), path.

    The parts of the text between matches give each match its place and what stands around it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    found = docs.select(F.col(id_col).alias("_id"), path.alias("path"), text.alias("_text")).withColumn("_m", F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0))).filter(F.size("_m") > 0)
    found = found.withColumn("_p", F.split("_text", CANDIDATE, -1)).withColumn("_n", F.size("_m"))
    ends = F.expr("zip_with(slice(_p, 1, _n), _m, (p, m) -> char_length(p) + char_length(m))")
    found = found.withColumn("_ends", ends)
    # running sums of whole numbers: only they are copied from match to match
    found = found.withColumn("_ends", F.expr("slice(aggregate(_ends, array(0), (s, x) -> concat(s, array(element_at(s, -1) + x))), 2, _n)"))
    zipped = F.arrays_zip(F.col("_ends").alias("e"), F.col("_m").alias("m"), F.expr("slice(_p, 1, _n)").alias("b"), F.expr("slice(_p, 2, _n)").alias("a"), F.expr("concat(array(''), slice(_m, 1, _n - 1))").alias("l"))
    rows = found.select("_id", "path", F.explode(zipped).alias("c"))
    return rows.select("_id", "path", (F.col("c.e") - F.char_length("c.m")).alias("start"), F.right(F.concat("c.l", "c.b"), F.lit(CONTEXT)).alias("before"), F.left("c.a", F.lit(CONTEXT)).alias("after"), F.col("c.m").alias("match"), _value(F.col("c.m")).alias("value"))


def _value(match: Column) -> Column:
    """What a match holds without its name, or the password alone of an address."""
    return F.regexp_replace(F.when(match.rlike(f"^(?:{ADDRESS})$"), F.regexp_replace(match, "@$", "")).otherwise(match), NAMED, "")


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def with_features(rows: DataFrame, words: DataFrame, pairs: dict[str, float]) -> DataFrame:
    """Columns of FEATURES from value, match, before, after and path. ``words``: a dictionary; ``pairs``: its letter pairs."""
    # coverage belongs to a value, so equal candidates are looked up once
    runs = rows.select("value").distinct().select("value", F.explode(F.regexp_extract_all(F.lower(F.regexp_replace("value", "(?<=[a-z])(?=[A-Z])", " ")), F.lit("[a-z]{3,}+"), F.lit(0))).alias("word"))
    covered = runs.join(F.broadcast(words.select("word")), "word").groupBy("value").agg(F.sum(F.char_length("word")).alias("_covered"))  # the dictionary is bounded
    rows = rows.join(covered, "value", "left")
    v, n = F.col("value"), F.greatest(F.char_length("value"), F.lit(1)).cast("double")
    lower = F.lower(v)
    last = F.lower(F.concat_ws(" ", F.slice(F.reverse(F.split(F.col("before"), r"\s+")), 1, 3), F.regexp_extract("match", NAMED, 0)))
    following = F.lower(F.concat_ws(" ", F.slice(F.split(F.ltrim("after"), r"\s+"), 1, 3)))
    repeats = F.transform(F.regexp_extract_all(v, F.lit(r"(.)\1*"), F.lit(0)), lambda x: F.char_length(x))
    bigrams = F.regexp_extract_all(lower, F.lit("(?=([a-z][a-z]))"), F.lit(1))
    known = F.from_json(F.lit(json.dumps(pairs)), "map<string,double>")
    likely = F.aggregate(F.transform(bigrams, lambda b: F.coalesce(F.try_element_at(known, b), F.lit(RARE))), F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(bigrams), F.lit(1))
    given = {
        "length": n, "digits": _count(v, "[0-9]") / n, "uppers": _count(v, "[A-Z]") / n, "lowers": _count(v, "[a-z]") / n, "others": _count(v, "[^0-9A-Za-z]") / n,
        "to_digit": _count(v, "(?<=[A-Za-z])(?=[0-9])") / n, "to_letter": _count(v, "(?<=[0-9])(?=[A-Za-z])") / n, "case_changes": _count(v, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n, "longest_run": F.coalesce(F.array_max(repeats), F.lit(0)).cast("double"), "transitions": likely, "dictionary": F.coalesce("_covered", F.lit(0)) / n,
        "hex": v.rlike("^[0-9a-fA-F]+$").cast("double"), "known_form": F.col("match").rlike(f"^(?:{KNOWN}|{ARMOUR}|{SIGNED})$").cast("double"), "named": F.col("match").rlike(NAMED).cast("double"),
        "carrier_before": last.rlike(CARRIERS).cast("double"), "harmless_before": last.rlike(rf"\b(?:{HARMLESS})\b").cast("double"), "carrier_after": following.rlike(CARRIERS).cast("double"), "testing_near": F.concat_ws(" ", last, following).rlike(TESTING).cast("double"),
        "testing_path": F.lower("path").rlike(TESTING).cast("double"), "uuid": lower.rlike("^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$").cast("double"), "placeholder": lower.rlike(PLACEHOLDERS).cast("double"),
    }
    return rows.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in given.items()}).drop("_covered")


def made_findings(words: DataFrame, n: int = 6000) -> DataFrame:
    """Labelled findings to start from, made from row numbers: before, match, after, path, label.

    Half are random keys as they are issued; the others are placeholders, digests under their names, identifiers, words of
    the dictionary ``words`` and paths; of either, some lie in paths of tests, where more are harmless. Use findings of your
    own reviewers where there are any."""
    spark = words.sparkSession
    some = [r["word"] for r in words.filter(F.char_length("word") >= 5).orderBy(F.desc("n"), "word").limit(256).collect()] or ["configuration", "information"]

    def hashed(x: str) -> Column:
        return F.sha2(F.concat(F.lit(x), F.col("id").cast("string")), 256)

    def one_of(seed: str, values: list[str]) -> Column:
        return F.element_at(F.split(F.lit("|".join(values)), r"\|"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(len(values))).cast("int") + 1)

    r = spark.range(n).select("id", (F.col("id") % 2).cast("double").alias("label"), hashed("a").alias("h"), hashed("b").alias("g"), F.expr("cast(id div 2 % 10 as int)").alias("kind"), F.expr("cast(id div 20 % 4 as int)").alias("turn"))
    upper = F.translate(F.upper(F.base64(F.unhex("h"))), "+/=", "QZ7")
    mixed = F.translate(F.base64(F.unhex("g")), "+/=", "xY3")
    word, other, third = one_of("w", some), one_of("o", some), one_of("t", some)
    name = F.element_at(F.array(*map(F.lit, ("password=", "token = \"", "api_key: ", "secret="))), F.col("turn") + 1)
    # lengths vary, so that no length tells a secret
    size = F.pmod(F.xxhash64(F.lit("s"), F.col("id")), F.lit(28)).cast("int") + 12
    signed = F.concat(F.lit("eyJhbGciOi"), F.substring(mixed, 1, 10), F.lit("."), F.substring(mixed, 11, 20), F.lit("."), F.substring("g", 1, 20))
    positive = F.element_at(F.array(F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), F.concat(name, F.substr("h", F.lit(1), size)), F.concat(name, F.substr("g", F.lit(3), size)), F.concat(name, F.substr(mixed, F.lit(1), size)), F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), F.concat(name, F.initcap(word), F.substring("h", 1, 4), F.lit("!"), F.substring(mixed, 3, 4)), F.concat(F.lit("AKIA"), F.substring(upper, 5, 16)), F.concat(F.lit("postgres://app:"), F.substr(mixed, F.lit(5), size), F.lit("@")), signed, F.substr(F.concat(mixed, "g"), F.lit(2), size + 20)), F.col("kind") + 1)
    negative = F.element_at(F.array(F.concat(name, F.lit("changeme"), F.pmod(F.xxhash64("h"), F.lit(100)).cast("string")), F.concat(name, F.lit("your_"), word), F.substring("h", 1, 40), F.concat(F.substring("h", 1, 8), F.lit("-"), F.substring("h", 9, 4), F.lit("-"), F.substring("h", 13, 4), F.lit("-"), F.substring("g", 1, 4), F.lit("-"), F.substring("g", 5, 12)), F.concat(word, F.lit("/"), other, F.lit("/"), third, F.lit("_"), F.col("turn").cast("string")), F.concat(name, word, F.lit("_"), other), F.concat(F.lit("AKIA"), F.repeat(F.lit("X"), 7), F.lit("EXAMPLE00")), F.concat(F.lit("http://"), word, F.lit(":"), other, F.lit("@")), F.concat(F.initcap(word), F.initcap(other), F.initcap(third), F.col("turn").cast("string")), F.concat(word, F.lit("-"), other, F.lit("-"), third, F.lit("2"))), F.col("kind") + 1)
    # what stands before tells digests, identifiers and paths, not placeholders from keys
    before = F.when((F.col("label") == 1) | ~F.col("kind").isin(2, 3, 4), one_of("b", ["the account of ", "and then ", "set it to ", ""])).otherwise(one_of("b", ["commit ", "sha256 checksum ", "see the file ", "revision id "]))
    after = one_of("n", ["", " and the rest", " as login", " in the example", ", then", " for the test"])
    path = F.when(F.col("label") == 1, one_of("p", ["", "", "src/config.ini", "deploy/settings.yaml", "app/main.py", "tests/conftest.py"])).otherwise(one_of("p", ["", "", "tests/fixtures/a.json", "docs/example.md", "spec/mock.yaml", "app/main.py"]))
    return checkpointed(r.select(before.alias("before"), F.when(F.col("label") == 1, positive).otherwise(negative).alias("match"), after.alias("after"), path.alias("path"), "label"))


class Scanner:
    """A forest with the dictionary and the letter pairs that its features were made with."""

    def __init__(self, forest: RandomForestClassificationModel, words: DataFrame, pairs: dict[str, float]):
        self.forest, self.words, self.pairs = forest, words, pairs


def train(findings: DataFrame, words: DataFrame, trees: int = 24, depth: int = 8, seed: int = 7, most: int = 50_000) -> Scanner:
    """A forest from labelled findings (before, match, after, path, label 0 or 1); at most about ``most`` of them, by hash."""
    rows = findings.filter(F.col("label").isin(0.0, 1.0) & F.col("match").isNotNull())
    n = rows.count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64("match", "before"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    pairs = letter_pairs(words)
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("before", "after", "path")}).withColumn("value", _value(F.col("match")))
    rows = with_features(rows, words, pairs)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.select(*FEATURES, F.col("label").cast("double").alias("label"))).select("features", "label").repartition(8)
    return Scanner(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(data), words, pairs)


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate in ``docs``: id, start (characters before it), length, match, value, probability, is_secret.

    Null and empty texts have no candidates; whole texts are searched; candidates don't overlap; repeated candidates and
    repeated rows each get a row; rows with a null id are searched too. Other columns don't matter, whatever their names.
    An empty table gives no rows."""
    rows = with_features(checkpointed(candidates(docs, id_col, text_col, path_col)), scanner.words, scanner.pairs)
    scored = scanner.forest.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    p = vector_to_array("probability")[1]
    out = scored.select(F.col("_id").alias(id_col), "start", F.char_length("match").alias("length"), "match", "value", p.alias("_p"))
    return out.select(id_col, "start", "length", "match", "value", F.col("_p").alias("probability"), (F.col("_p") >= threshold).alias("is_secret"))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = dictionary(docs)
    found = scan(docs, train(made_findings(words), words), path_col="source")
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")
