"""Untrusted document texts read in the JVM: a text becomes a VARIANT, and its fields are found by typed steps along the schema.

The rules are those of ``documents``, with these differences: a level of nesting beyond 1,000, a number beyond 1,000 digits and a text
beyond the size of a VARIANT hold no object; a lone surrogate is a question mark; an invalid or unknown value is written as
JSON without spaces; fields come in the order of their keys. Python only gives NFKC, to texts that aren't plain ASCII."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import documents as D
from . import scalars as S

#: Spaces as Python's strip knows them.
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_FENCE = r"(?s)```(?:json)?\s*(.+?)```"
ENTRY = "struct<path:string,section:string,row:int,field:string,raw:string,kind:string>"


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _EDGES, "")


def whole(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value with unique keys and without NaN; null for any other.

    The parser stops after the first value, so the text is read in an array and in an object: only white space may then follow it."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    at = lambda i: F.try_variant_get(listed, f"$[{i}]", "variant")
    return F.when(held.isNotNull() & at(1).isNull(), at(0))


def _lenient(text: Column) -> Column:
    """Whether the text is one JSON value for a reader that allows repeated keys and NaN."""
    held = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"]
    return held.isNotNull() & F.coalesce(F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")) == 1, F.lit(False))


def _members(v: Column) -> Column:
    """The members of an object, null if it is none."""
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def _object(v: Column) -> Column:
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def read(docs: DataFrame, text: str, into: str) -> DataFrame:
    """``docs`` with a struct ``into``: strict (the whole text is strict JSON) and obj (the object of the answer, a VARIANT, or null)."""
    t = stripped(F.col(text))
    fenced = F.regexp_extract(t, _FENCE, 1)
    part = F.when(t.rlike(_FENCE), stripped(fenced)).otherwise(F.regexp_extract(t, r"(?s)\{.*\}", 0))
    strict = whole(t)
    inner = F.when(strict.isNull() & ~(t.rlike(r"^[{\[]") & _lenient(t)), _object(whole(part)))
    only_json_spaces = F.regexp_replace(F.col(text), r"^[ \t\n\r]+|[ \t\n\r]+$", "") == t
    return docs.withColumn(into, F.struct(F.coalesce(strict.isNotNull() & only_json_spaces, F.lit(False)).alias("strict"), F.coalesce(_object(strict), inner).alias("obj")))


def _escaped(key: Column) -> Column:
    return F.regexp_replace(key, r"([\\.\[\]])", r"\\$1")


def _entry(path: Column, section: Column | str, row: Column, field: Column | str, raw: Column | str, kind: Column | str) -> Column:
    given = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(*(c.alias(n) for c, n in ((path, "path"), (given(section), "section"), (row.cast("int"), "row"), (given(field), "field"), (given(raw), "raw"), (given(kind), "kind")))).cast(ENTRY)


def _leaf(v: Column, path: Column, section: Column | str, row: Column, field: Column, kind: Column) -> Column:
    """A leaf of a known kind, one of another type than text, or one that the schema doesn't know."""
    is_text = F.schema_of_variant(v) == "STRING"
    raw = F.when(kind.isNotNull() & is_text, F.try_variant_get(v, "$", "string")).when(kind.isNotNull() & F.is_variant_null(v), "").otherwise(F.to_json(v))
    return _entry(path, section, row, field, raw, F.when(kind.isNull(), "extra").when(is_text | F.is_variant_null(v), kind).otherwise("type"))


def _kinds(rules: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in rules.items() for x in pair))


def _cells(v: Column, path: Column, section: Column | str, row: Column, rules: dict[str, str], root: bool = False) -> Column:
    """The leaves of an object, or one entry that says that it is none."""
    below = lambda k: _escaped(k) if root else F.concat(path, F.lit("."), _escaped(k))
    found = F.transform(_members(v), lambda m: _leaf(m["value"], below(m["key"]), section, row, m["key"], F.try_element_at(_kinds(rules), m["key"])))
    return F.coalesce(found, F.array(_entry(path, section, row, "", "", "object")))


def _lines(v: Column) -> Column:
    """The leaves of the rows of a table, or one entry that says that it is none."""
    rows = F.try_variant_get(v, "$", "array<variant>")
    each = F.transform(rows, lambda r, i: _cells(r, F.concat(F.lit(f"{D.ROWS}["), i.cast("string"), F.lit("]")), D.ROWS, i, D.SCHEMA[D.ROWS][0]))
    return F.coalesce(F.flatten(each), F.array(_entry(F.lit(D.ROWS), D.ROWS, F.lit(-1), "", "", "array")))


def entries(obj: Column, mode: str = "document") -> Column:
    """The fields of an object as an array of ENTRY, none if there is no object."""
    none = F.lit(-1)
    if mode == "flat":
        return F.when(obj.isNotNull(), _cells(obj, F.lit(""), "flat", none, D.FLAT_SCHEMA, root=True))

    def member(m: Column) -> Column:
        k, v = m["key"], m["value"]
        known = F.when(k == D.DOC_TYPE, F.lit("text"))
        out = F.array(_leaf(v, _escaped(k), "", none, k, known))
        for name in (D.HEADER, D.TOTAL):
            out = F.when(k == name, _cells(v, F.lit(name), name, none, D.SCHEMA[name])).otherwise(out)
        return F.when(k == D.ROWS, _lines(v)).otherwise(out)

    return F.flatten(F.transform(_members(obj), member))


def fields(docs: DataFrame, text: str, mode: str = "document") -> DataFrame:
    """A row for each field of each document: the columns of ``docs`` but ``text``, and path, section, row, field, value, invalid, extra.

    A document without an object, and null, have no row; repeated documents have theirs each. ``docs`` must not have columns of those
    names, nor _e and _r."""
    kept = [F.col(c) for c in docs.columns if c != text]
    each = read(docs, text, "_r").select(*kept, F.explode(entries(F.col("_r.obj"), mode)).alias("_e"))
    leaf = F.col("_e.kind").isin("text", "number", "date")
    value = stripped(D.nfkc_raw(F.when(leaf & F.col("_e.raw").rlike(r"[^\x00-\x7F]"), F.col("_e.raw"))))
    each = each.withColumn("_t", F.when(leaf & F.col("_e.raw").rlike(r"[^\x00-\x7F]"), value).when(leaf, stripped(F.col("_e.raw"))).otherwise(F.col("_e.raw")))
    each = each.filter(~leaf | (F.col("_t") != ""))
    kind = F.col("_e.kind")
    form = F.when(kind == "text", F.col("_t")).when(kind == "number", S.canonical_number("_t")).when(kind == "date", S.canonical_date("_t"))
    value = F.coalesce(form, F.concat(kind, F.lit(":"), F.col("_t")))
    return each.select(*kept, *(F.col(f"_e.{c}").alias(c) for c in ("path", "section", "row", "field")), value.alias("value"), form.isNull().alias("invalid"), (kind == "extra").alias("extra"))
