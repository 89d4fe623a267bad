"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A model has a column for each label, so their number is bounded; more labels raise an error.
MAX_LABELS = 1024


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(m))


def per_label_sample(rows: DataFrame, label: str, key: list[str], per_label: int) -> tuple[DataFrame, dict]:
    """About ``per_label`` rows of each label, chosen by the hash of ``key``; also the count of rows by label.

    Labels with no more rows than that keep all of them."""
    counts = {r[0]: r[1] for r in rows.filter(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(MAX_LABELS + 1).collect()}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} distinct values of {label}")
    if not counts:
        return rows.limit(0), counts
    shares = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, int(min(1.0, per_label / n) * (1 << 30)))))
    return rows.filter(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < F.element_at(shares, F.col(label))), counts
