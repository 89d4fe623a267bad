"""Kernels on untrusted document texts: strict and loose parsing, flattening to paths, schema rules.

They run in Arrow batches, once for a text; all that follows works on what they return."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from datetime import date
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The names of the document schema.
DOC_TYPE, DOC_TYPE_VALUE = "单据类型", "材料清单"
HEADER, HEADER_FIELDS = "表头", ("项目名称", "供应商", "单据编号", "日期")
ROWS, ROW_FIELDS, OPTIONAL = "明细", ("序号", "名称", "规格型号", "单位", "数量", "单价", "金额"), ("规格型号",)
TOTAL, TOTAL_FIELDS = "合计", ("金额",)
FLAT_FIELDS = ("store_name", "store_addr", "tel", "date", "time", "subtotal", "tax", "total")
NUMBERS, FLAT_NUMBERS = ("数量", "单价", "金额"), ("subtotal", "tax", "total")
MAX_ROWS = 8
# Fixed patterns: what counts as a number and as a date.
_NUMBER = re.compile(r"([+-]?)(\d+|\d{1,3}(?:,\d{3})+)(?:\.(\d+))?", re.ASCII)
_DATE = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{4})年(\d{1,2})月(\d{1,2})日?", re.ASCII)
_FENCE = re.compile(r"```(?:json)?\s*(.+?)```", re.DOTALL)


def _rules(fields: tuple[str, ...], numbers: tuple[str, ...], dates: tuple[str, ...] = ()) -> dict[str, str]:
    return {f: "number" if f in numbers else "date" if f in dates else "text" for f in fields}


#: What may stand where: a kind of leaf, an object (dict of rules) or an array (list of one rule).
SCHEMA = {DOC_TYPE: "text", HEADER: _rules(HEADER_FIELDS, (), ("日期",)), ROWS: [_rules(ROW_FIELDS, NUMBERS)], TOTAL: _rules(TOTAL_FIELDS, NUMBERS)}
FLAT_SCHEMA = _rules(FLAT_FIELDS, FLAT_NUMBERS, ("date",))


class Invalid(ValueError):
    pass


def _pairs(items: list[tuple]) -> dict:
    out = dict(items)
    if len(out) != len(items):
        raise Invalid("a key twice")
    return out


def _constant(name: str):
    raise Invalid(name)


def strict_loads(text: str):
    """JSON without repeated keys, NaN and infinities; raises ValueError."""
    return json.loads(text, object_pairs_hook=_pairs, parse_constant=_constant)


def strict_valid(text: str | None) -> bool:
    try:
        strict_loads(text or "")
        return True
    except (ValueError, RecursionError):
        return False


def _strict_object(text: str) -> dict | None:
    try:
        found = strict_loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def loose_object(text: str | None) -> dict | None:
    """The object in a model's answer: the whole text, or what a fence holds, or else what the first and last brace enclose.

    A whole text that is JSON of another kind, or JSON only for a lenient reader (repeated keys, NaN), holds none."""
    t = (text or "").strip()
    if not t:
        return None
    if strict_valid(t):
        return _strict_object(t)
    if t[0] in "{[":
        try:
            json.loads(t)
            return None
        except (ValueError, RecursionError):
            pass
    fenced = _FENCE.search(t)
    return _strict_object(fenced[1].strip() if fenced else t[t.find("{") : t.rfind("}") + 1])


def read_object(text: str | None) -> tuple[bool, dict | None]:
    """(``strict_valid``, ``loose_object``) of a text; one that is strict JSON is parsed once."""
    try:
        found = strict_loads(text or "")
    except (ValueError, RecursionError):
        return False, loose_object(text)
    return True, found if isinstance(found, dict) else None


#: Stands for a value that is nested too deeply to be written out.
TOO_DEEP = "nested too deeply"


def _dumped(value) -> str:
    try:
        return json.dumps(value, ensure_ascii=False, sort_keys=True, default=str)
    except RecursionError:
        return TOO_DEEP


def sound(text: str) -> str:
    """``text`` with lone surrogates, which no UTF-8 column can hold, written as their JSON escapes."""
    return text if text.isascii() else text.encode("utf-8", "backslashreplace").decode()


def normal_text(value) -> tuple[str, bool]:
    """(canonical form, invalid). An empty form stands for no value."""
    if value is None:
        return "", False
    if not isinstance(value, str):
        return f"type:{_dumped(value)}", True
    if value.isascii():
        return value.strip(), False
    return unicodedata.normalize("NFKC", value).strip(), False


def normal_number(value) -> tuple[str, bool]:
    text, bad = normal_text(value)
    if bad or not text:
        return text, bad
    m = _NUMBER.fullmatch(text)
    if not m:
        return f"number:{text}", True
    whole, part = m[2].replace(",", "").lstrip("0") or "0", (m[3] or "").rstrip("0")
    out = f"{whole}.{part}" if part else whole
    return (f"-{out}" if m[1] == "-" and out != "0" else out), False


def normal_date(value) -> tuple[str, bool]:
    text, bad = normal_text(value)
    if bad or not text:
        return text, bad
    if m := _DATE.fullmatch(text):
        try:
            return date(*(int(x) for x in (m.group(1, 3, 4) if m[1] else m.group(5, 6, 7)))).isoformat(), False
        except ValueError:
            pass
    return f"date:{text}", True


_NORMAL = {"text": normal_text, "number": normal_number, "date": normal_date}


def escape(key: str) -> str:
    return re.sub(r"([\\.\[\]])", r"\\\1", key)


Field = tuple[str, str, int, str, str, bool, bool]  # path, section, row, field, value, invalid, outside the schema


def flatten(obj, mode: str = "document") -> list[Field]:
    """The fields of a parsed object, read along the schema. What should be an object or an array and isn't, null included, is
    one invalid entry where it stands; what the schema doesn't know is one invalid entry at its root, even if empty. Empty
    leaves are no fields."""
    out: list[Field] = []
    # what is still to be read: value, its rule, path, section, row, field; the top is last
    todo: list[tuple] = [(obj, FLAT_SCHEMA if mode == "flat" else SCHEMA, "", "flat" if mode == "flat" else "", -1, "")] if isinstance(obj, dict) else []
    while todo:
        value, rule, path, section, row, field = todo.pop()
        if rule is None:
            out.append((path, section, row, field, f"extra:{_dumped(value)}", True, True))
        elif isinstance(rule, str):
            text, bad = _NORMAL[rule](value)
            if text:
                out.append((path, section, row, field, text, bad, False))
        elif isinstance(value, dict) and isinstance(rule, dict):
            below = [(v, rule.get(k), f"{path}.{escape(k)}" if path else escape(k), section or (k if isinstance(rule.get(k), (dict, list)) else ""), row, k) for k, v in value.items()]
            todo.extend(reversed(below))
        elif isinstance(value, list) and isinstance(rule, list):
            todo.extend(reversed([(v, rule[0], f"{path}[{i}]", section, i, "") for i, v in enumerate(value)]))
        else:
            out.append((path, section, row, "", "object:" if isinstance(rule, dict) else "array:", True, False))
    return out


def tolerant(obj):
    """A bare number as the total stands for an object that holds it."""
    if isinstance(obj, dict) and isinstance(obj.get(TOTAL), str):
        text, bad = normal_number(obj[TOTAL])
        if text and not bad:
            return obj | {TOTAL: {TOTAL_FIELDS[0]: obj[TOTAL]}}
    return obj


def _object_errors(path: str, value, rules: dict[str, str], required: tuple[str, ...]) -> list[str]:
    """Missing fields, sorted, then what is wrong with those there are, in their order."""
    if not isinstance(value, dict):
        return [f"{path or '$'}: not an object"]
    at = (path + "." if path else "") + "{}: {}"
    errors = [at.format(f, "missing") for f in sorted(set(required).difference(value))]
    for k, v in value.items():
        if k not in rules:
            errors.append(at.format(k, "unknown"))
        elif not isinstance(v, str):
            errors.append(at.format(k, "not a string"))
        elif k in required and not normal_text(v)[0]:
            errors.append(at.format(k, "empty"))
        elif rules[k] != "text" and _NORMAL[rules[k]](v)[1]:
            errors.append(at.format(k, f"invalid {rules[k]}"))
    return errors


def schema_errors(obj, mode: str = "document") -> list[str]:
    """What keeps an object from the schema: top-level keys first, then type, header, total and rows, each also if it is absent."""
    if not isinstance(obj, dict):
        return ["$: not an object"]
    if mode == "flat":
        return _object_errors("", obj, FLAT_SCHEMA, ())
    errors = [f"{k}: missing" for k in sorted(SCHEMA.keys() - obj.keys())] + [f"{k}: unknown" for k in sorted(obj.keys() - SCHEMA.keys())]
    if obj.get(DOC_TYPE) != DOC_TYPE_VALUE:
        errors.append(f"{DOC_TYPE}: not {DOC_TYPE_VALUE}")
    errors += _object_errors(HEADER, obj.get(HEADER), SCHEMA[HEADER], HEADER_FIELDS)
    errors += _object_errors(TOTAL, obj.get(TOTAL), SCHEMA[TOTAL], TOTAL_FIELDS)
    rows = obj.get(ROWS)
    if not isinstance(rows, list):
        return [*errors, f"{ROWS}: not an array"]
    if not 1 <= len(rows) <= MAX_ROWS:
        errors.append(f"{ROWS}: not 1 to {MAX_ROWS} rows")
    needed = tuple(f for f in ROW_FIELDS if f not in OPTIONAL)
    return errors + [e for i, row in enumerate(rows) for e in _object_errors(f"{ROWS}[{i}]", row, SCHEMA[ROWS][0], needed)]


def leaves(obj) -> list[tuple[str, str]]:
    """All leaves of any JSON value with plain paths, in order, however deep they lie."""
    out, todo = [], [("", obj)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            todo.extend(reversed([(f"{path}.{k}" if path else k, v) for k, v in value.items()]))
        elif isinstance(value, list):
            todo.extend(reversed([(f"{path}[{i}]", v) for i, v in enumerate(value)]))
        else:
            out.append((sound(path), sound(value) if isinstance(value, str) else json.dumps(value)))
    return out


def lenient_value(text: str | None):
    """What a lenient reader makes of an answer: the fence's content or else the text, whole if it is JSON, or else from its first
    brace to its last; None if neither is."""
    t = (text or "").strip()
    fenced = _FENCE.search(t)
    t = fenced[1].strip() if fenced else t
    for part in (t, t[t.find("{") : t.rfind("}") + 1]):
        try:
            return json.loads(part)
        except (ValueError, RecursionError):
            pass
    return None


def anomalies(text: str | None) -> tuple[bool, bool, bool, bool]:
    """By ``lenient_value``: not an object at all, a total that is no object, a header that is none, a row that is none. A null isn't flagged."""
    obj = lenient_value(text)
    if not isinstance(obj, dict):
        return True, False, False, False
    odd = lambda k: obj.get(k) is not None and not isinstance(obj[k], dict)
    rows = obj.get(ROWS)
    return False, odd(TOTAL), odd(HEADER), isinstance(rows, list) and any(not isinstance(r, dict) for r in rows)


def compact(text: str | None) -> str | None:
    """NFKC without any white space."""
    return None if text is None else "".join(unicodedata.normalize("NFKC", text).split())


def canonical_json(text: str | None) -> str | None:
    """Sorted keys, no spaces; null for what is no JSON, or is nested too deeply to be read."""
    try:
        return sound(json.dumps(json.loads(text or ""), ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    except (ValueError, RecursionError):
        return None


FIELD = "struct<path:string,section:string,row:int,field:string,value:string,invalid:boolean,extra:boolean>"
PARSED = f"strict boolean, loose boolean, errors array<string>, fields array<{FIELD}>"
_NAMES = ("path", "section", "row", "field", "value", "invalid", "extra")


_ARROW = pa.struct({"strict": pa.bool_(), "loose": pa.bool_(), "errors": pa.list_(pa.string()), "fields": pa.list_(pa.struct({"path": pa.string(), "section": pa.string(), "row": pa.int32(), "field": pa.string(), "value": pa.string(), "invalid": pa.bool_(), "extra": pa.bool_()}))})


def _sound(value):
    return sound(value) if isinstance(value, str) else value


def parsed(rows: DataFrame, columns: dict[str, str], mode: str = "document", repair: tuple[str, ...] = (), parts: tuple[str, ...] = ("strict", "loose", "errors", "fields")) -> DataFrame:
    """``rows`` with a struct (strict, loose, errors, fields, or those of them in ``parts``) for each text: ``columns`` maps new names to text columns.

    All texts of a row are read in one Arrow pass. ``repair``: new names whose texts are read tolerantly."""
    names = rows.columns
    told = [f for f in T.StructType.fromDDL(PARSED).fields if f.name in parts]
    arrow = pa.struct([_ARROW.field(f.name) for f in told])
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.StructType(told)) for n in columns)])

    def read(text: str | None, mend: bool) -> dict:
        strict, obj = read_object(text)
        seen = tolerant(obj) if mend else obj
        out = {"strict": strict, "loose": obj is not None}
        if "errors" in parts:
            out["errors"] = list(map(sound, schema_errors(seen, mode)))
        if "fields" in parts:
            out["fields"] = [dict(zip(_NAMES, map(_sound, f), strict=True)) for f in flatten(seen, mode)]
        return {f.name: out[f.name] for f in told}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 2000) for b in batches for k in range(0, b.num_rows, 2000)):
            found = [pa.array([read(t, new in repair) for t in batch.column(names.index(old)).to_pylist()], arrow) for new, old in columns.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*names, *columns])

    return rows.mapInArrow(run, schema)


def fields(docs: DataFrame, text: str, mode: str = "document") -> DataFrame:
    """A row for each field of each document, as ``flatten`` reads it: the columns of ``docs`` but ``text``, and those of FIELD.

    A document without an object, and null, have no row. Rows leave Python as columns, so no array of structs is made."""
    names = docs.columns
    kept = [f for f in docs.schema.fields if f.name != text]
    kinds = T.StructType.fromDDL(FIELD[len("struct<") : -1])
    arrow = _ARROW.field("fields").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 2000) for b in batches for k in range(0, b.num_rows, 2000)):
            found = [(i, f) for i, t in enumerate(batch.column(names.index(text)).to_pylist()) for f in flatten(read_object(t)[1], mode)]
            at = pa.array([i for i, _ in found], pa.int32())
            columns = [pa.array([_sound(f[k]) for _, f in found], arrow.field(k).type) for k in range(len(_NAMES))]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(f.name)).take(at) for f in kept), *columns], names=[*(f.name for f in kept), *_NAMES])

    return docs.mapInArrow(run, T.StructType([*kept, *kinds.fields]))


SCORE = "strict boolean, loose boolean, schema_errors array<string>, tp int, fp int, fn int, extra_paths array<string>, missing_paths array<string>, field_errors array<struct<path:string,gt:string,pred:string>>, amount_correct int, amount_total int, document_correct boolean"
_SCORE_ARROW = pa.struct({"strict": pa.bool_(), "loose": pa.bool_(), "schema_errors": pa.list_(pa.string()), "tp": pa.int32(), "fp": pa.int32(), "fn": pa.int32(), "extra_paths": pa.list_(pa.string()), "missing_paths": pa.list_(pa.string()), "field_errors": pa.list_(pa.struct({"path": pa.string(), "gt": pa.string(), "pred": pa.string()})), "amount_correct": pa.int32(), "amount_total": pa.int32(), "document_correct": pa.bool_()})
_AMOUNT = re.compile(rf"({ROWS}\[\d+\]|{TOTAL})\.{TOTAL_FIELDS[0]}", re.ASCII)


def score(gt: str | None, pred: str | None, mode: str = "document", mend: bool = False) -> dict:
    """The score of one predicted text against the true one (see ``scoring.score_texts``): fields are met by path, and a true field that is invalid is never right."""
    strict, obj = read_object(pred)
    obj = tolerant(obj) if mend else obj
    errors = list(map(sound, schema_errors(obj, mode)))
    mine = {sound(f[0]): (sound(f[4]), f[6]) for f in flatten(obj, mode)}
    true = {sound(f[0]): (sound(f[4]), f[5]) for f in flatten(read_object(gt)[1], mode)}
    right = {p for p, (value, bad) in true.items() if not bad and p in mine and mine[p][0] == value}
    amounts = [p for p in true if _AMOUNT.fullmatch(p) or (mode == "flat" and p in FLAT_NUMBERS)]
    wrong = [{"path": p, "gt": true[p][0] if p in true else None, "pred": mine[p][0] if p in mine else None} for p in sorted((true.keys() | mine.keys()) - right)]
    tp, fp, fn = len(right), len(mine) - len(right), len(true) - len(right)
    return {
        "strict": strict, "loose": obj is not None, "schema_errors": errors, "tp": tp, "fp": fp, "fn": fn, "extra_paths": [p for p, (_, extra) in mine.items() if extra], "missing_paths": [p for p in true if p not in mine],
        "field_errors": wrong, "amount_correct": sum(p in right for p in amounts), "amount_total": len(amounts), "document_correct": strict and not errors and not fp and not fn,
    }


def scored(rows: DataFrame, gt: str, pred: str, mode: str = "document", mend: bool = False) -> DataFrame:
    """``rows`` with the columns of ``score``, in one Arrow pass over both texts; only scores come back from Python."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 2000) for b in batches for k in range(0, b.num_rows, 2000)):
            a, b = (batch.column(names.index(c)).to_pylist() for c in (gt, pred))
            found = pa.array([score(x, y, mode, mend) for x, y in zip(a, b, strict=True)], _SCORE_ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns, *found.flatten()], names=[*names, *_SCORE_ARROW.names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *T.StructType.fromDDL(SCORE).fields]))


@F.pandas_udf(T.StringType())
def nfkc_raw(texts: pd.Series) -> pd.Series:
    """NFKC, which Spark has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: Texts of these characters alone are changed by NFKC at full-width forms and the wide space only, one by one.
PLAIN = r"\x00-\x7F\u3000-\u3002\u4E00-\u9FFF\uFF01-\uFF5E"
_WIDE = "\u3000" + "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = " " + "".join(map(chr, range(0x21, 0x7F)))


def plain(text: Column) -> Column:
    """Whether ``nfkc_plain`` gives the NFKC of a text."""
    return ~text.rlike(f"[^{PLAIN}]")


def nfkc_plain(text: Column) -> Column:
    return F.translate(text, _WIDE, _NARROW)


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_all(texts: pd.Series) -> pd.Series:
    """NFKC of each text of an array."""
    return texts.map(lambda ts: None if ts is None else [unicodedata.normalize("NFKC", t) for t in ts])


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def canonical_json_udf(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_json)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])))
def leaves_udf(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        try:
            out.append([{"path": p, "value": v} for p, v in leaves(json.loads(t or ""))])
        except (ValueError, RecursionError):
            out.append([])
    return pd.Series(out)


@F.udtf(returnType="path string, section string, row int, field string, value string, invalid boolean, extra boolean")
class FlattenDoc:
    """A row for each field of the object in a document's text, as ``flatten`` reads it; none if there is no object."""

    def eval(self, text: str):
        for field in flatten(loose_object(text)):
            yield tuple(map(_sound, field))


@F.udtf(returnType="path string, value string")
class Leaves:
    """A row for each leaf of a JSON text; none if it is no JSON."""

    def eval(self, text: str):
        try:
            value = json.loads(text or "")
        except (ValueError, RecursionError):
            return
        yield from leaves(value)


def register(spark) -> None:
    """Makes the functions known to SQL: flatten_doc and leaves after LATERAL, stable_json and nfkc as scalars."""
    spark.udtf.register("flatten_doc", FlattenDoc)
    spark.udtf.register("leaves", Leaves)
    spark.udf.register("stable_json", canonical_json_udf)
    spark.udf.register("nfkc", nfkc_raw)


ANOMALIES = T.StructType([T.StructField(n, T.BooleanType()) for n in ("unparsable", "total_scalar", "header_scalar", "row_scalar")])


@F.pandas_udf(ANOMALIES)
def anomalies_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([anomalies(t) for t in texts], columns=ANOMALIES.names)


@F.pandas_udf(T.StringType())
def compact_udf(texts: pd.Series) -> pd.Series:
    return texts.map(compact)


def stable_hash(text: Column | str) -> Column:
    """SHA-256 of the canonical JSON: the same for any order of keys and any spacing; null for what is no JSON."""
    return F.sha2(canonical_json_udf(F.col(text) if isinstance(text, str) else text), 256)
