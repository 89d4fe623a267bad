"""Scalar functions as column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern of a number.
NUMBER = r"^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canonical_number(text: Column | str) -> Column:
    """The exact canonical form of a decimal text of any length, null if it isn't one: no sign for zero, no plus, no
    thousands commas, no leading or trailing zeros. The form is made by string surgery, so no digit is ever rounded."""
    t = F.trim(_c(text))
    bare = F.regexp_replace(t, "[+,]", "")
    sign = F.when(bare.startswith("-"), "-").otherwise("")
    body = F.regexp_replace(bare, "^-", "")
    whole = F.regexp_replace(F.substring_index(body, ".", 1), "^0+(?=[0-9])", "")
    part = F.when(body.contains("."), F.regexp_replace(F.substring_index(body, ".", -1), "0+$", "")).otherwise("")
    value = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    return F.when(t.rlike(NUMBER), F.when(value == "0", value).otherwise(F.concat(sign, value)))


def canonical_date(text: Column | str) -> Column:
    """yyyy-MM-dd of a date written with one kind of separator (- / .) or with year, month and day signs; null if it is no such date."""
    t = F.trim(_c(text))
    plain = F.regexp_extract(t, r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", 0)
    signs = F.regexp_extract(t, r"^(\d{4})年(\d{1,2})月(\d{1,2})日?$", 0)
    spaced = F.when(plain != "", F.regexp_replace(plain, "[/.]", "-")).when(signs != "", F.regexp_replace(F.regexp_replace(signs, "[年月]", "-"), "日", ""))
    return F.date_format(F.try_to_date(spaced, "yyyy-M-d"), "yyyy-MM-dd")


def compact_date(text: Column | str) -> Column:
    """yyyy-MM-dd of eight digits, or as canonical_date."""
    t = F.trim(_c(text))
    return F.when(t.rlike(r"^\d{8}$"), F.date_format(F.try_to_date(F.when(t.rlike(r"^\d{8}$"), t), "yyyyMMdd"), "yyyy-MM-dd")).otherwise(canonical_date(t))


def lenient_decimal(text: Column | str) -> Column:
    """decimal(18,6) of a text with ASCII or full-width commas; null if it is no number. Exponents are read."""
    return F.expr("cast(null as decimal(18,6))") if text is None else F.regexp_replace(_c(text), "[,，]", "").try_cast("decimal(18,6)")


def lenient_double(text: Column | str) -> Column:
    """double of a text that may hold commas and currency signs; null if empty or no number."""
    t = F.regexp_replace(_c(text), r"[,，¥￥\s]", "")
    return F.when(t != "", t.try_cast("double"))


def edit_distance(a: Column | str, b: Column | str, cap: int = 6) -> Column:
    """Levenshtein distance, cap + 1 for all beyond the cap."""
    d = F.levenshtein(_c(a), _c(b), cap)
    return F.when(d < 0, cap + 1).otherwise(d)


def numeric_like(text: Column | str) -> Column:
    """Whether nothing but digits is left without commas, points and hyphens: dates count."""
    return F.regexp_replace(_c(text), "[,.-]", "").rlike(r"^\p{Nd}+$")


def differing_positions(a: Column | str, b: Column | str) -> Column:
    """Number of places where two texts of one length differ."""
    return F.size(F.filter(F.zip_with(F.split(_c(a), ""), F.split(_c(b), ""), lambda x, y: x.eqNullSafe(y)), lambda same: ~same))


def error_shape(gt: Column | str, pred: Column | str) -> Column:
    """How a wrong value differs: digits, decimal_shift, chars_1, chars_2, chars_many or length."""
    g, p = _c(gt), _c(pred)
    strip = lambda x: F.regexp_replace(x, "[,.-]", "")
    n = differing_positions(g, p)
    return F.when(numeric_like(g) & numeric_like(p) & (strip(g) == strip(p)), "decimal_shift").when(F.char_length(g) != F.char_length(p), "length").when(numeric_like(g) & numeric_like(p), "digits").when(n == 1, "chars_1").when(n == 2, "chars_2").otherwise("chars_many")


def row_consistent(quantity: Column, price: Column, amount: Column) -> Column:
    """Whether amount is quantity times price within 0.011 or a millionth; null if one is missing."""
    made = quantity * price
    return F.abs(amount - made) <= F.greatest(F.lit(0.011), F.abs(made) * 1e-6)


def precision(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2tp / (2tp + fp + fn), 0 on an empty denominator."""
    d = 2 * tp + fp + fn
    return F.when(d > 0, 2 * tp / d).otherwise(F.lit(0.0))


def reward(tp: Column, fp: Column, fn: Column, extra: Column, predicted: Column, parsed: Column, weight: float = 0.10) -> Column:
    """F1 less a share for paths outside the schema; 0 if the output can't be parsed."""
    return F.when(~parsed, 0.0).otherwise(f1(tp, fp, fn) - weight * F.when(predicted > 0, extra / predicted).otherwise(0.0))


def score_band(f: Column) -> Column:
    return F.when(f >= 0.95, "high").when(f >= 0.85, "good").when(f >= 0.75, "fair").otherwise("low")


def dpo_loss(chosen: Column, rejected: Column, beta: float = 0.1) -> Column:
    """-log sigmoid(beta * margin), without overflow."""
    x = beta * (chosen - rejected)
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))


def lr_scale(step: Column, warmup: int, total: int) -> Column:
    """Linear warm-up, then a cosine to zero."""
    done = F.least(F.greatest((step - warmup) / float(max(1, total - warmup)), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * done)))


def retry_wait(k: Column) -> Column:
    """Seconds before retry k: a growing wait, 30 at most."""
    return F.least(F.pow(F.lit(2.0), k) + 0.3 * (k + 1), F.lit(30.0))


def token_cost(input_tokens: Column, output_tokens: Column, input_price: float, output_price: float) -> Column:
    """Cost at prices per million tokens."""
    return (input_tokens * input_price + output_tokens * output_price) / 1e6


def escape_html(text: Column | str) -> Column:
    out = _c(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def clip(text: Column | str, most: int = 400) -> Column:
    return F.substring(_c(text), 1, most)


def clean_key(text: Column | str) -> Column:
    """A key without trailing colons and white space."""
    return F.regexp_replace(_c(text), r"(?U)[:：\s]+$", "")


def escape_key(text: Column | str) -> Column:
    r"""A key in which \ . [ ] stand for themselves in a path."""
    return F.regexp_replace(_c(text), r"([\\.\[\]])", r"\\$1")


def field_kind(path: Column | str) -> Column:
    """number, date or text, by where a value stands in the document."""
    p = _c(path)
    number = p.rlike(r"^明细\[\d+\]\.(数量|单价|金额)$") | p.isin("合计.金额", "subtotal", "tax", "total")
    return F.when(number, "number").when(p.isin("表头.日期", "date"), "date").otherwise("text")


def path_group(path: Column | str) -> Column:
    p = _c(path)
    return F.when(p.startswith("表头"), "表头").when(p.startswith("合计"), "合计").when(p.startswith("明细") | (p == "单据类型"), "明细").otherwise("extra")


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/\\]+)$", 1)


def stem(path: Column | str) -> Column:
    """The file's name without extension and without the mark of its degradation."""
    return F.regexp_replace(F.regexp_replace(base_name(path), r"\.[^.]*$", ""), "_(medium|heavy|light)$", "")


def money(value: Column) -> Column:
    return F.format_string("%.2f", value)


def bbox_center(box: Column) -> tuple[Column, Column]:
    """Centre of a box of four points."""
    total = lambda i: F.aggregate(box, F.lit(0.0), lambda a, p: a + p[i])
    return total(0) / F.size(box), total(1) / F.size(box)
