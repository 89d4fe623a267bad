"""Documents read from the boxes of a page's recognised text, in the JVM: a page is one row with an array of its tokens, and every
step is a filter, a sort or a short fold over that array, so once a page's tokens lie together nothing moves."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import scalars as S

# Titles, header labels, marks of totals and footers, and the pattern of a number on a page.
TITLES = ("工程材料清单", "材料清单")
LABELS = {"项目名称": ("项目名称",), "供应商": ("供应商",), "单据编号": ("单据编号", "编号"), "日期": ("日期",)}
TOTALS = ("合计金额", "合计")
FOOTERS = ("制单人", "审核人", "备注")
NUMBER = r"^[+-]?[0-9][0-9,.]*$"
# Fixed values, in text heights: how far a line's tokens lie from its middle, a value from its label, an amount from its total, the
# table's edge above the total and above a footer, the first row below the head, a continuation below its row; and the least
# tolerance of a line in pixels, the height of an empty page, the headings that make a head, the numbers that make a row.
LINE, BESIDE_LABEL, BESIDE_TOTAL, ABOVE_TOTAL, ABOVE_FOOTER, BELOW_HEAD, CONTINUED = 0.7, 0.6, 0.9, 0.55, 1.0, 0.7, 1.8
LEAST_TOLERANCE, NO_HEIGHT, HEADINGS_NEEDED, NUMBERS_NEEDED = 5.0, 16.0, 4, 2

#: v and x first, so that tokens sort down and then along the page; t: the text, h: the heading it is, l and r: the label it begins
#: with and what follows, m: what it marks.
TOKEN = "struct<v:double,x:double,id:bigint,t:string,h:string,l:string,r:string,m:string>"
CELL = "struct<field:string,value:string,ids:array<bigint>>"
ROW = f"struct<v:double,cells:array<{CELL}>>"
#: White space of Unicode, and the separators that Python counts as such.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def middle(sorted_values: Column) -> Column:
    """The median of an ascending array."""
    n = F.size(sorted_values)
    return (F.get(sorted_values, F.floor((n - 1) / 2)) + F.get(sorted_values, F.floor(n / 2))) / 2


def median_of(values: Column) -> Column:
    """The median of an array, nulls left out; null if nothing is left."""
    return let(F.sort_array(F.array_compact(values)), middle)


def let(value: Column, of) -> Column:
    """What ``of`` makes of a value that is computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def apart(tokens: Column, tolerance: Column, kind: str) -> Column:
    """``tokens`` (ascending by v) parted where the next lies further than the tolerance below the one before: lines part there, too."""
    n = F.size(tokens)
    far = lambda i: F.coalesce(F.get(tokens, i).v - F.get(tokens, i - 1).v > tolerance, F.lit(True))
    cuts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | far(i))
    parts = let(cuts, lambda at: F.transform(at, lambda c, k: F.slice(tokens, c + 1, F.coalesce(F.get(at, k + 1), n) - c)))
    return F.when(n > 0, parts).otherwise(F.array().cast(f"array<array<{kind}>>"))


def _fold_lines(tokens: Column, tolerance: Column, kind: str) -> Column:
    none = F.array().cast(f"array<{kind}>")

    def step(s: Column, t: Column) -> Column:
        n = F.size(s.open)
        half = (F.get(s.open, F.floor((n - 1) / 2)).v + F.get(s.open, F.floor(n / 2)).v) / 2
        return F.when(n == 0, F.struct(s.done.alias("done"), F.array(t).alias("open"))).when(F.abs(t.v - half) <= tolerance, F.struct(s.done.alias("done"), F.concat(s.open, F.array(t)).alias("open"))).otherwise(F.struct(F.concat(s.done, F.array(s.open)).alias("done"), F.array(t).alias("open")))

    start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("done"), none.alias("open"))
    return F.aggregate(tokens, start, step, lambda s: F.when(F.size(s.open) > 0, F.concat(s.done, F.array(s.open))).otherwise(s.done))


def lines_of(parts: Column, tolerance: Column, kind: str) -> Column:
    """The lines of each of ``parts`` (see ``apart``): a part no higher than the tolerance is one line, others are folded."""
    low = lambda part: F.coalesce(F.get(part, F.size(part) - 1).v - F.get(part, F.lit(0)).v <= tolerance, F.lit(False))
    return F.flatten(F.transform(parts, lambda part: F.when(low(part), F.array(part)).otherwise(_fold_lines(part, tolerance, kind))))


def as_lines(tokens: Column, tolerance: Column, kind: str) -> Column:
    """Arrays of the tokens (structs of type ``kind``, v first) of each line, down the page.

    ``tokens`` ascend by v. A token belongs to the open line while it is near the line's median; the open line ascends as well, so
    its median is its middle. The median lies between the line's ends, so a gap above the tolerance always parts lines, and tokens
    within the tolerance of each other never part: only what lies between is folded token by token."""
    return lines_of(apart(tokens, tolerance, kind), tolerance, kind)


def _along(line: Column) -> Column:
    return F.sort_array(F.transform(line, lambda t: F.struct(t.x, t.v, t.id, t.t, t.h)))


def _first(tokens: Column, *order) -> Column:
    """The token that is least by ``order``, ties by id; null if there is none."""
    return F.array_min(F.transform(tokens, lambda t: F.struct(*(o(t).alias(f"o{i}") for i, o in enumerate(order)), t.id.alias("id"), t.alias("t")))).t


def _starts(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(or_, (text.startswith(m) for m in marks))


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _dense(text: Column) -> Column:
    """A text without white space."""
    return F.translate(text, BLANKS, "")


def _cleaned(text: Column, field: str) -> Column:
    """A value as it goes into the document; dates in their canonical form if they are any."""
    return let(_trimmed(text), lambda t: F.coalesce(S.compact_date(t), t)) if field == "日期" else _trimmed(text)


def _label_values(field: str) -> Column:
    """The values of a header field above the table, by token, the first that isn't blank: struct (value, ids).

    A label stands at the start of a token; its value follows the colon, or else is the nearest token to its right at the same height."""

    def at(t: Column) -> Column:
        beside = F.filter("toks", lambda o: (o.x > t.x) & (F.abs(o.v - t.v) < BESIDE_LABEL * F.col("height")))
        right = lambda r: F.struct(t.id.alias("id"), r.t.alias("raw"), F.array(t.id, r.id).alias("ids"))
        return F.when(t.r != "", F.struct(t.id.alias("id"), t.r.alias("raw"), F.array(t.id).alias("ids"))).otherwise(let(_first(beside, lambda o: o.x), right))

    labelled = F.filter("marked", lambda t: (t.l == field) & (t.v < F.col("head_v")))
    values = F.filter(F.transform(labelled, at), lambda x: x.raw.isNotNull() & (x.raw != ""))
    named = F.transform(values, lambda x: let(_cleaned(x.raw, field), lambda c: F.struct((c == "").alias("blank"), x.id.alias("id"), c.alias("value"), x.ids.alias("ids"))))
    return F.array_min(named)


def _merged(row: Column, more: Column) -> Column:
    """A row's cells with those of a line that continues it."""
    mine = lambda c: F.get(F.filter(more, lambda m: m.field == c.field), F.lit(0))
    grown = F.transform(row, lambda c: F.when(mine(c).isNotNull(), F.struct(c.field.alias("field"), F.concat(c.value, F.lit(" "), mine(c).value).alias("value"), F.concat(c.ids, mine(c).ids).alias("ids"))).otherwise(c))
    new = F.filter(more, lambda m: ~F.exists(row, lambda c: c.field == m.field))
    return F.concat(grown, F.transform(new, lambda m: F.struct(m.field.alias("field"), F.concat(F.lit(" "), m.value).alias("value"), m.ids.alias("ids"))))


def _rows_of(lines: Column, height: Column) -> Column:
    """Folds a table's lines (v, cells) into struct (rows, loose): a line with a serial number or enough numbers is a row, a line of
    names alone continues the row it lies close below, and any other is counted as loose."""

    def told(line: Column) -> Column:
        serial = F.exists(line.cells, lambda c: (c.field == "序号") & c.value.rlike("^[0-9]+$"))
        numbers = F.size(F.filter(line.cells, lambda c: c.field.isin(*D.NUMBERS) & _dense(c.value).rlike(NUMBER)))
        names = F.forall(line.cells, lambda c: c.field.isin("名称", "规格型号"))
        return F.struct(F.coalesce(serial | (numbers >= NUMBERS_NEEDED), F.lit(False)).alias("row"), names.alias("names"), line.alias("line"))

    def step(s: Column, x: Column) -> Column:
        last = F.get(s.rows, F.size(s.rows) - 1)
        below = x.line.v - last.v
        goes_on = F.coalesce(x.names & (below > 0) & (below < CONTINUED * height), F.lit(False))
        longer = F.concat(F.slice(s.rows, F.lit(1), F.greatest(F.size(s.rows) - 1, F.lit(0))), F.array(F.struct(last.v.alias("v"), _merged(last.cells, x.line.cells).alias("cells"))))
        made = lambda rows, more: F.struct(rows.alias("rows"), (s.loose + F.lit(more)).alias("loose"))
        return F.when(x.row, made(F.concat(s.rows, F.array(x.line)), 0)).when(goes_on, made(longer, 0)).otherwise(made(s.rows, 1))

    return F.aggregate(F.transform(lines, told), F.struct(F.array().cast(f"array<{ROW}>").alias("rows"), F.lit(0).alias("loose")), step)


def settled(pages: DataFrame) -> DataFrame:
    """``pages`` with its columns computed here: projections are not merged across a generator, so what later steps refer to
    inside a lambda isn't computed anew for each element."""
    return pages.select(F.inline(F.array(F.struct(*pages.columns))))


def read_pages(tokens: DataFrame, by: str = "doc_id") -> DataFrame:
    """``read_gathered`` of tokens that lie in rows of their own: ``by``, token_id, text, x, v, height (see ``layout.geometry``)."""
    token = F.struct(*(F.col(c).cast("double").alias(c) for c in ("v", "x", "height")), F.col("token_id").cast("long").alias("token_id"), F.col("text").alias("text"))
    return read_gathered(tokens.groupBy(by).agg(F.collect_list(token).alias("tokens")), by)


PARTS = ("pred", "trace", "rows", "warnings")


def _read_tokens(pages: DataFrame, by: str) -> DataFrame:
    """by, toks (of type TOKEN, sorted) and height, the median of a page's text heights.

    A text of ASCII alone is its own NFKC and neither heading nor label nor mark. NFKC needs Python for texts beyond
    ``documents.PLAIN`` only; their normal forms come as a map."""
    from .layout import heading

    ascii = lambda c: F.octet_length(c) == F.char_length(c)
    odd = F.filter(F.transform("tokens", lambda t: t.text), lambda c: c.isNotNull() & ~ascii(c) & ~D.plain(c))
    p = settled(pages.select(by, "tokens", F.array_distinct(odd).alias("_odd")))
    p = p.withColumn("_nfkc", D.nfkc_all(F.when(F.size("_odd") > 0, F.col("_odd"))))
    p = settled(p.select(by, "tokens", F.when(F.size("_odd") > 0, F.map_from_arrays("_odd", "_nfkc")).alias("_nfkc")))
    label = lambda f: rf"(?s)^({'|'.join(LABELS[f])})(?U:\s)*[:：](?U:\s)*(.*)$"

    def token(t: Column, text: Column, h: Column, l: Column, r: Column, m: Column) -> Column:  # noqa: E741
        return F.struct(t.v.alias("v"), t.x.alias("x"), t.token_id.alias("id"), text.alias("t"), h.alias("h"), l.alias("l"), r.alias("r"), m.alias("m"))

    def read(t: Column, text: Column) -> Column:
        colon = lambda value: F.when(text.contains(":") | text.contains("："), let(_trimmed(text), value))
        which = colon(lambda e: F.coalesce(*(F.when(e.rlike(label(f)), f) for f in LABELS)))
        rest = colon(lambda e: F.coalesce(*(F.when(e.rlike(label(f)), F.regexp_extract(e, label(f), 2)) for f in LABELS)))
        mark = lambda c: F.when(_starts(c, TOTALS), "total").when(_starts(c, FOOTERS), "foot").when(c.isin(*TITLES), "title")
        return let(_dense(text), lambda c: token(t, text, heading(c), which, rest, mark(c)))

    normal = lambda c: F.when(D.plain(c), D.nfkc_plain(c)).otherwise(F.element_at("_nfkc", c))
    none = F.lit(None).cast("string")
    toks = F.transform("tokens", lambda t: F.when(t.text.isNull() | ascii(t.text), token(t, F.coalesce(t.text, F.lit("")), none, none, none, none)).otherwise(let(normal(t.text), lambda c: read(t, c))))
    height = F.coalesce(median_of(F.transform("tokens", lambda t: t.height)), F.lit(NO_HEIGHT))
    return settled(p.select(by, F.sort_array(toks).alias("toks"), height.alias("height")))


def read_gathered(pages: DataFrame, by: str = "doc_id", parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One row a page: ``by``, pred (the document as JSON text), trace (path -> ids of the tokens read), rows, warnings, or those of
    them in ``parts``; fields: the document's single values and the ids they were read from, as an array of struct (path, value, ids).

    ``pages``: ``by`` and tokens, an array of struct (token_id, text, x, v, height). The first line with the most distinct headings is the
    table's head, if there are four; columns part half-way between headings. The table ends above the total line, or else above the
    first footer. Without a head there are no rows, total and header values are still read. Nothing is computed or corrected. Null
    texts count as empty; a page without tokens has no row."""
    p = _read_tokens(pages.filter(F.size("tokens") > 0), by)
    p = p.withColumn("tol", F.greatest(F.lit(LEAST_TOLERANCE), LINE * F.col("height")))
    # a head lies where enough headings are, so other lines aren't made
    headings = lambda line: F.filter(line, lambda t: t.h.isNotNull())
    some = F.when(F.size(headings(F.col("toks"))) >= HEADINGS_NEEDED, F.filter(apart(F.col("toks"), F.col("tol"), TOKEN), lambda part: F.size(headings(part)) >= HEADINGS_NEEDED))
    p = settled(p.select("*", some.alias("some"), F.filter("toks", lambda t: t.l.isNotNull() | t.m.isNotNull()).alias("marked")))
    named = lambda line: F.size(F.array_distinct(F.transform(headings(line), lambda t: t.h)))
    best = lambda lines: let(F.array_max(F.transform(lines, lambda line, i: F.struct(named(line).alias("n"), (-i).alias("at")))), lambda b: F.when(b.n >= HEADINGS_NEEDED, F.get(lines, -b["at"])))
    p = settled(p.select(by, "toks", "height", "tol", "marked", let(lines_of(F.col("some"), F.col("tol"), TOKEN), best).alias("head")))
    p = p.withColumn("head_v", F.coalesce(middle(F.transform("head", lambda t: t.v)), F.lit(float("inf"))))
    heads = F.filter(_along(F.col("head")), lambda t: t.h.isNotNull())
    p = settled(p.withColumn("heads", F.coalesce(heads, F.array().cast("array<struct<x:double,v:double,id:bigint,t:string,h:string>>"))))
    # the last token of each heading stands for its column
    columns = F.filter("heads", lambda t: F.array_max(F.transform(F.filter(F.col("heads"), lambda o: o.h == t.h), lambda o: F.struct(o.x, o.v, o.id))) == F.struct(t.x, t.v, t.id))
    below = lambda mark: F.filter("marked", lambda t: (t.m == mark) & (t.v > F.col("head_v")))
    p = p.withColumns({"columns": columns, "total": _first(below("total"), lambda t: t.v), "foot": F.array_min(F.transform(below("foot"), lambda t: t.v))})
    p = settled(p.drop("heads"))
    singles = [k for k in parts if k in ("pred", "trace", "fields")]
    if singles:
        title = F.array_max(F.transform(F.filter("marked", lambda t: (t.m == "title") & (t.v < F.col("head_v"))), lambda t: t.id))
        amount = F.filter("toks", lambda t: (t.x > F.col("total.x")) & (F.abs(t.v - F.col("total.v")) < BESIDE_TOTAL * F.col("height")) & _dense(t.t).rlike(NUMBER))
        p = p.withColumns({"title": title, **{f"head_{i}": _label_values(f) for i, f in enumerate(D.HEADER_FIELDS)}, "amount": _first(amount, lambda t: t.x)})
    if set(parts) - {"fields"}:
        p = _with_rows(p)
    p = settled(p.drop("toks", "marked", "head_v", "columns", "total", "foot", "tol"))

    cell = lambda r, f: F.coalesce(F.get(F.filter(r.cells, lambda c: c.field == f), F.lit(0)).value, F.lit("")).alias(f)
    out: dict[str, Column] = {}
    if singles:
        values = [F.when(F.col("title").isNotNull(), D.DOC_TYPE_VALUE), *(F.col(f"head_{i}.value") for i in range(len(D.HEADER_FIELDS))), _trimmed(F.col("amount.t"))]
        texts = [F.coalesce(v, F.lit("")) for v in values]
        paths = [D.DOC_TYPE, *(f"{D.HEADER}.{f}" for f in D.HEADER_FIELDS), f"{D.TOTAL}.{D.TOTAL_FIELDS[0]}"]
        ids = [F.array("title"), *(F.col(f"head_{i}.ids") for i in range(len(D.HEADER_FIELDS))), F.array("amount.id")]
        found = [F.col("title").isNotNull(), *(F.col(f"head_{i}").isNotNull() for i in range(len(D.HEADER_FIELDS))), F.col("amount").isNotNull()]
        each = list(zip(found, paths, texts, ids, strict=True))
    if "fields" in parts:
        out["fields"] = F.array_compact(F.array(*(F.when(ok, F.struct(F.lit(path).alias("path"), text.alias("value"), i.cast("array<bigint>").alias("ids"))) for ok, path, text, i in each)))
    if "pred" in parts:
        out["pred"] = F.to_json(F.struct(
            texts[0].alias(D.DOC_TYPE), F.struct(*(t.alias(f) for t, f in zip(texts[1:-1], D.HEADER_FIELDS, strict=True))).alias(D.HEADER),
            F.transform("rows", lambda r: F.struct(*(cell(r, f) for f in D.ROW_FIELDS))).alias(D.ROWS), F.struct(texts[-1].alias(D.TOTAL_FIELDS[0])).alias(D.TOTAL),
        ))
    if "trace" in parts:
        entry = lambda path, ids: F.struct(path.alias("key"), ids.cast("array<bigint>").alias("value"))
        in_rows = F.flatten(F.transform("rows", lambda r, i: F.transform(r.cells, lambda c: entry(F.concat(F.lit(f"{D.ROWS}["), i.cast("string"), F.lit("]."), c.field), c.ids))))
        out["trace"] = F.map_from_entries(F.concat(F.array_compact(F.array(*(F.when(ok, entry(F.lit(path), i)) for ok, path, _, i in each))), in_rows))
    if "rows" in parts:
        out["rows"] = F.col("rows")
    if "warnings" in parts:
        out["warnings"] = F.concat(F.when(F.isnull("head"), F.array(F.lit("fewer than four headings"))).otherwise(F.array().cast("array<string>")), F.array_repeat(F.lit("a line that belongs to no row"), F.coalesce(F.col("loose"), F.lit(0))))
    return p.select(by, *(c.alias(name) for name, c in out.items()))


def _with_rows(p: DataFrame) -> DataFrame:
    """``p`` (toks, height, tol, head, head_v, columns, total, foot) with rows, those of the table, and loose, its lines that belong to none."""
    end = F.coalesce(F.col("total.v") - ABOVE_TOTAL * F.col("height"), F.col("foot") - ABOVE_FOOTER * F.col("height"), F.lit(float("inf")))
    edges = F.transform(F.filter(F.arrays_zip(F.col("columns").alias("a"), F.slice("columns", F.lit(2), F.greatest(F.size("columns"), F.lit(1))).alias("b")), lambda z: z.b.isNotNull()), lambda z: (z.a.x + z.b.x) / 2)
    p = settled(p.withColumns({"start_v": F.col("head_v") + BELOW_HEAD * F.col("height"), "end_v": end, "names": F.transform("columns", lambda c: c.h), "edges": edges}))
    p = settled(p.withColumn("body", F.filter("toks", lambda t: (t.v > F.col("start_v")) & (t.v < F.col("end_v")))).drop("start_v", "end_v"))
    p = settled(p.withColumn("body", as_lines(F.col("body"), F.col("tol"), TOKEN)))

    def placed(line: Column) -> Column:
        return F.transform(_along(line), lambda t: F.struct(F.size(F.filter(F.col("edges"), lambda e: t.x > e)).alias("k"), t.t.alias("t"), t.id.alias("id")))

    def cells(placed: Column) -> Column:
        each = F.transform(F.array_distinct(F.transform(placed, lambda c: c.k)), lambda k: F.struct(k.alias("k"), F.filter(placed, lambda c: c.k == k).alias("m")))
        return F.transform(each, lambda e: F.struct(F.get(F.col("names"), e.k).alias("field"), _trimmed(F.array_join(F.transform(e.m, lambda c: c.t), " ")).alias("value"), F.transform(e.m, lambda c: c.id).alias("ids")))

    lines = F.transform("body", lambda line: F.struct(middle(F.transform(line, lambda t: t.v)).alias("v"), let(placed(line), cells).alias("cells")))
    p = settled(p.withColumn("body", lines).drop("edges", "names"))
    p = settled(p.withColumn("body", F.when(F.isnotnull("head"), _rows_of(F.col("body"), F.col("height")))))
    return p.withColumns({"rows": F.coalesce("body.rows", F.array().cast(f"array<{ROW}>")), "loose": F.col("body.loose")}).drop("body")


def table_cells(pages: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, row_no, field, value, token_ids of all rows that ``read_pages`` found."""
    rows = pages.select(by, F.posexplode("rows").alias("row_no", "r")).select(by, "row_no", F.inline("r.cells"))
    return rows.select(by, "row_no", "field", "value", F.col("ids").alias("token_ids"))
