"""The manifest against plain recomputation, at several fan-outs and sizes of blocks."""

from __future__ import annotations

from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from ledgerlens.llm import merkle


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def prove(nodes, fanout):
    """Root, and for each leaf the siblings' digests joined, level by level."""
    proofs, at = ["" for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i - i % fanout
            proofs[k] += "".join(nodes[first:i] + nodes[i + 1 : first + fanout])
        at = [i // fanout for i in at]
        nodes = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def expected(rows, fanout):
    """(id, leaf, subroot, root, digest of the proof) of (id, group, leaf) rows."""
    groups = defaultdict(list)
    for i, g, h in rows:
        groups[g].append((i is not None, i or 0, h, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: prove([r[2] for r in sorted(groups[g], key=lambda r: r[:3])], fanout) for g in names}
    root, upper = prove([trees[g][0] for g in names], fanout)
    out = Counter()
    for g, above in zip(names, upper, strict=True):
        for r, below in zip(sorted(groups[g], key=lambda r: r[:3]), trees[g][1], strict=True):
            out[(r[3], r[2], trees[g][0], root, digest(below + above))] += 1
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, _node string, _item int, _g string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA)


ROWS = [
    (1, "a", "en", 3, "one"), (2, None, "en", None, "two"), (3, "", "en", 0, ""), (None, "a", "en", 1, None), (None, "b", "en", 1, "x"), (7, "a", "en", 2, "same"), (7, "a", "en", 2, "same"),
    (5, "a", None, 2, "no lang"), (6, "a", None, 2, "né"), (8, "a", "", 2, "empty lang"), (9, "a", "zh", 2, "lone 中"), (10, "a", "É", 1, "long " * 100_000), *((i, "s", "de", i, f"t{i}") for i in range(100, 137)),
]


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 2), (2, 10), (3, 1), (5, 2), (16, 1)])
def test_proofs_against_plain_trees(spark, fanout, levels):
    docs = table(spark, ROWS)
    rows = docs.withColumn("leaf", merkle.leaf(*(docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text"))))
    out = merkle.merkle_proofs(rows, fanout=fanout, levels=levels)
    assert out.columns == [*(c for c in rows.columns if c != "root"), "subroot", "root", "proof"]
    got = out.select("doc_id", "leaf", "subroot", "root", merkle.siblings(out["proof"]).alias("p"), (merkle.fold(out["leaf"], out["proof"]) == out["root"]).alias("ok")).collect()
    assert all(r["ok"] for r in got)
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], digest(r["p"])) for r in got) == expected([(r[0], r[2], plain_leaf(*r)) for r in ROWS], fanout)


def test_empty_one_row_and_one_group(spark):
    assert merkle.manifest(table(spark, [])).collect() == []
    one = merkle.manifest(table(spark, ROWS[:1])).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] == plain_leaf(*ROWS[0]) and one["proof"] == []
    assert {len(r["proof"]) for r in merkle.manifest(table(spark, ROWS[:5])).collect()} == {3}


def test_rows_alike_are_many(spark):
    """A third of all rows are one row: each has a leaf."""
    docs = table(spark, [(i, "s", "en", 1, "t") for i in range(40)] + [(50, "s", "en", 1, "t")] * 20)
    got = merkle.manifest(docs).collect()
    want = expected([(r["doc_id"], "en", r["leaf"]) for r in got], 2)
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], digest(*(s["left"] + s["right"] for s in r["proof"]))) for r in got) == want


def test_tampering_shows(spark, sf):
    """Only the rows that the query tampers with fail, and only if there is something to tamper with."""
    from zlib import crc32

    rows = {r["doc_id"]: r["n_chars"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = merkle.op13_merkle_manifest(spark, sf).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if not r["verified"]} == {i for i, n in rows.items() if n is not None and crc32(str(i).encode()) % 7 == 0}
