"""Column builders with the dialect's exact semantics.

Everything is made of built-in functions, so it stays inside generated code.  Where
Spark's own operator gives another answer the builder says how it differs.
"""

from __future__ import annotations

import math
import re
import string

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An operand of more nodes than this is bound to a variable where an operator reads it more than once.
LIGHT = 40
#: The greatest finite double.
BIG = 1.7976931348623157e308
SPARK = {"INTEGER": "bigint", "REAL": "double", "BOOLEAN": "boolean", "TEXT": "string", "BLOB": "binary", "TIMESTAMP": "timestamp_ntz"}
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def null(kind: str | None = None) -> Column:
    return F.lit(None).cast(SPARK.get(kind or "", "void"))


def literal(value, kind: str | None) -> Column:
    if value is None:
        return null(kind)
    if kind == "BLOB":
        return F.lit(bytearray(value))
    if kind == "TIMESTAMP":
        return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    return F.lit(value).cast(SPARK[kind])


def fail(pos, message: str, kind: str | None) -> Column:
    """An error where this is evaluated, with its place in the statement."""
    return F.raise_error(F.lit(f"line {pos[0]}, column {pos[1]}: {message}")).cast(SPARK.get(kind or "", "void"))


def let(values: list[tuple[Column, int]], body: Callable[..., Column], light: int = LIGHT) -> Column:
    """body of the columns, given with their numbers of nodes; heavy ones are computed once, however often body reads them.

    Light ones are repeated, which generated code computes once, too.  A heavy one becomes
    the variable of a lambda function: not part of generated code, but the expression's
    size stays linear and it is computed only where its CASE branch is reached.
    """
    heavy = [k for k, (_, n) in enumerate(values) if n > light]
    if not heavy:
        return body(*[c for c, _ in values])
    packed = F.struct(*[values[k][0].alias(f"v{k}") for k in heavy])
    return F.element_at(F.transform(F.array(packed), lambda v: body(*[v[f"v{k}"] if k in heavy else c for k, (c, _) in enumerate(values)])), 1)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value bound to a variable in any case."""
    return let([(value, LIGHT + 1)], body)


# comparison


def _not_nan(x: Column, y: Column, result: Column) -> Column:
    """NaN compares as unknown; Spark takes it for equal to itself and the greatest."""
    return F.when(~(F.isnan(x) | F.isnan(y)), result)


def _mixed(op: str, a: tuple[Column, int], b: tuple[Column, int]) -> Column:
    """INTEGER against REAL exactly; Spark rounds the integer to a double first."""
    return let([a, b], lambda i, f: _exactly(op, i, f))


def _exactly(op: str, i: Column, f: Column) -> Column:
    whole = F.when(f >= 0, F.floor(f)).otherwise(F.ceil(f)).cast("double")
    # -1, 0, 1: how i stands to f
    inside = (f >= -(2.0**63)) & (f < 2.0**63)
    w = F.when(inside, whole).cast("bigint")
    frac = f - whole
    sign = F.when(f >= 2.0**63, -1).when(f < -(2.0**63), 1).when(i < w, -1).when(i > w, 1).when(frac > 0, -1).when(frac < 0, 1).otherwise(0)
    return F.when(i.isNotNull() & f.isNotNull() & ~F.isnan(f), _apply(op, sign, F.lit(0)))


def _apply(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "!=": "!="}


def compare(op: str, a: tuple[Column, int], ta: str | None, b: tuple[Column, int], tb: str | None, only_true: bool = False, a_value=None, b_value=None) -> Column:
    """Three-valued comparison of columns, given with their numbers of nodes.

    only_true: FALSE and NULL are the same to the caller, as in a filter.  a_value, b_value:
    the value where a side is a literal; an INTEGER column against a REAL literal then
    becomes a comparison with an integer, which reaches the scan.
    """
    # an integer literal that REAL holds exactly is compared as REAL, which reaches the scan
    if ta == "REAL" and tb == "INTEGER" and type(b_value) is int and abs(b_value) <= 2**53:
        b, tb, b_value = (F.lit(float(b_value)), 1), "REAL", float(b_value)
    if tb == "REAL" and ta == "INTEGER" and type(a_value) is int and abs(a_value) <= 2**53:
        a, ta, a_value = (F.lit(float(a_value)), 1), "REAL", float(a_value)
    if ta == "INTEGER" and tb == "REAL":
        return _int_against(op, a[0], b_value) if isinstance(b_value, float) else _mixed(op, a, b)
    if ta == "REAL" and tb == "INTEGER":
        return _int_against(_FLIP[op], b[0], a_value) if isinstance(a_value, float) else _mixed(_FLIP[op], b, a)
    if "REAL" not in (ta, tb):
        return _apply(op, a[0], b[0])
    if only_true and (isinstance(b_value, float) and op in ("<", "<=", "=") or isinstance(a_value, float) and op in (">", ">=", "=")):
        return _apply(op, a[0], b[0])  # NaN is greater than and unequal to every literal
    if only_true:
        return let([a, b], lambda x, y: _apply(op, x, y) & ~F.isnan(x) & ~F.isnan(y))
    return let([a, b], lambda x, y: _not_nan(x, y, _apply(op, x, y)))


def _int_against(op: str, i: Column, f: float) -> Column:
    if f != f:
        return null("BOOLEAN")
    if abs(f) >= 2.0**63 and f != -(2.0**63):
        yes = (f > 0) == (op in ("<", "<=")) if op in ("<", "<=", ">", ">=") else op == "!="
        return F.when(i.isNotNull(), F.lit(yes))
    if f == math.trunc(f):
        return _apply(op, i, F.lit(int(f)))
    if op in ("=", "!="):
        return F.when(i.isNotNull(), F.lit(op == "!="))
    return i <= math.floor(f) if op in ("<", "<=") else i >= math.ceil(f)


def is_same(a: tuple[Column, int], ta, b: tuple[Column, int], tb) -> Column:
    """IS: null-safe equality; NaN is not NaN."""
    if "REAL" not in (ta, tb):
        return a[0].eqNullSafe(b[0])
    return let([a, b], lambda x, y: F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(F.coalesce(compare("=", (x, 1), ta, (y, 1), tb), F.lit(False))))


# arithmetic


def finite(x: Column) -> Column:
    return F.abs(x) <= BIG  # NaN is greater than all numbers


def integer(op: str, a: tuple[Column, int], b: tuple[Column, int], pos) -> Column:
    """+ - * / % of integers; columns with their numbers of nodes."""
    if op == "/":  # Spark's / would give a double

        def div(x, y):
            safe = F.when(y == 0, fail(pos, "division by zero", "INTEGER")).when((x == -(2**63)) & (y == -1), fail(pos, "integer overflow", "INTEGER"))
            return safe.otherwise(F.call_function("div", x, F.when(y != 0, y)))

        return let([a, b], div)
    if op == "%":
        return let([a, b], lambda x, y: F.when(y == 0, fail(pos, "division by zero", "INTEGER")).when(y == -1, F.when(x.isNotNull(), F.lit(0).cast("bigint"))).otherwise(x % F.when(y != 0, y)))
    x, y = a[0], b[0]
    return {"+": x + y, "-": x - y, "*": x * y}[op]


def unchecked(op: str, x: Column, y: Column) -> Column:
    return {"+": x + y, "-": x - y, "*": x * y}[op]


def step(op: str, a: tuple[Column, int], b: tuple[Column, int], pos) -> Column:
    """+ - * / of doubles; an error where finite operands give an infinity or NaN, which Spark lets pass."""

    def one(x: Column, y: Column) -> Column:
        if op == "/":
            z = x / F.when(y != 0, y)
            return F.when(y == 0, fail(pos, "division by zero", "REAL")).when(~finite(z) & finite(x) & finite(y), fail(pos, "REAL overflow", "REAL")).otherwise(z)
        z = unchecked(op, x, y)
        return F.when(~finite(z) & finite(x) & finite(y), fail(pos, "REAL overflow", "REAL")).otherwise(z)

    return let([a, b], one)


def fold(first: Column, rest: list[tuple[str, Column, tuple[int, int]]], kind: str) -> Column:
    """A long chain of operators of one level, from left to right, as a fold over an array: a flat tree."""
    told = F.split(F.lit("\n".join(f"{op} line {pos[0]}, column {pos[1]}: " for op, _, pos in rest)), "\n")
    terms = F.zip_with(F.array(*[x for _, x, _ in rest]), told, lambda x, m: F.struct(x.alias("x"), m.alias("m")))
    ops = list(dict.fromkeys(op for op, *_ in rest))

    def wrong(t: Column, message: str) -> Column:
        return F.raise_error(F.concat(F.substring(t["m"], 3, 1000), F.lit(message))).cast(SPARK[kind])

    def apply(op: str, a: Column, t: Column) -> Column:
        x = t["x"]
        if kind == "REAL":
            z = a / F.when(x != 0, x) if op == "/" else unchecked(op, a, x)
            out = F.when(~finite(z) & finite(a) & finite(x), wrong(t, "REAL overflow")).otherwise(z)
            return F.when(x == 0, wrong(t, "division by zero")).otherwise(out) if op == "/" else out
        if op == "/":
            safe = F.when(x == 0, wrong(t, "division by zero")).when((a == -(2**63)) & (x == -1), wrong(t, "integer overflow"))
            return safe.otherwise(F.call_function("div", a, F.when(x != 0, x)))
        if op == "%":
            return F.when(x == 0, wrong(t, "division by zero")).when(x == -1, F.when(a.isNotNull(), F.lit(0).cast("bigint"))).otherwise(a % F.when(x != 0, x))
        return unchecked(op, a, x)

    def by_op(a: Column, t: Column) -> Column:
        out = None
        for op in ops[:-1]:
            out = F.when(F.substring(t["m"], 1, 1) == op, apply(op, a, t)) if out is None else out.when(F.substring(t["m"], 1, 1) == op, apply(op, a, t))
        last = apply(ops[-1], a, t)
        return last if out is None else out.otherwise(last)

    return F.aggregate(terms, first, by_op)


def negate(a: Column, pos) -> Column:
    """Of an integer."""
    return F.when(a == -(2**63), fail(pos, "integer overflow", "INTEGER")).otherwise(-a)


# text


def lettercase(x: Column, up: bool = False) -> Column:
    """Case folding of ASCII letters only."""
    return F.translate(x, _LOWER if up else _UPPER, _UPPER if up else _LOWER)


def like(x: Column, pattern: Column, pattern_value: str | None = None) -> Column:
    """% any run, _ one code point, letters of ASCII in either case, no escape character."""
    if pattern_value is not None:
        p = pattern_value.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\")
        return lettercase(x).like(p)
    return F.call_function("like", lettercase(x), F.replace(lettercase(pattern), F.lit("\\"), F.lit("\\\\")))


def substr(x: tuple[Column, int], start: tuple[Column, int], n: tuple[Column, int] | None, blob: bool, start_value=None, n_value=None) -> Column:
    """Negative start counts from the end, start 0 stands before the first, negative n takes what stands before."""
    top = 2**31 - 1
    if type(start_value) is int and 1 <= start_value <= top and (n is None or type(n_value) is int and n_value >= 0):  # as Spark has it
        return F.substring(x[0], start_value, top if n is None else min(n_value, top))
    empty = F.lit(bytearray(b"")) if blob else F.lit("")
    low, high = F.lit(-(2**40)), F.lit(2**40)  # far beyond any length; keeps the sums from overflowing

    def of(v: Column, s: Column, *more: Column) -> Column:
        size = F.length(v).cast("bigint")
        count = F.greatest(low, F.least(high, more[0])) if more else high
        # before clipping, from 0
        at = F.when(s > 0, F.least(high, s) - 1).when(s < 0, size + F.greatest(low, s)).otherwise(F.lit(-1).cast("bigint"))

        def cut(edge: Column) -> Column:
            a, b = F.greatest(edge["a"], F.lit(0)), F.least(edge["b"], size)
            return F.when(b > a, F.substring(v, (a + 1).cast("int"), (b - a).cast("int"))).otherwise(empty)

        edges = bound(at, lambda p: F.struct(F.when(count < 0, p + count).otherwise(p).alias("a"), F.when(count < 0, p).otherwise(p + count).alias("b")))
        some = v.isNotNull() & s.isNotNull() & (more[0].isNotNull() if more else F.lit(True))
        return F.when(some, bound(edges, cut))

    return let([x, start, *([n] if n is not None else [])], of)


def instr_blob(x: Column, a: Column) -> Column:
    """Byte position of a blob, by its hex text; only hits at even places count."""
    h, needle = F.hex(x), F.hex(a)
    n = F.length(needle)
    places = F.sequence(F.lit(0), F.greatest(F.octet_length(x) - F.octet_length(a), F.lit(0)))
    hit = F.filter(places, lambda i: F.substring(h, i * 2 + 1, n) == needle)
    found = F.coalesce(F.get(hit, 0) + 1, F.lit(0)).cast("bigint")
    return F.when(x.isNotNull() & a.isNotNull(), F.when(F.octet_length(a) > F.octet_length(x), F.lit(0).cast("bigint")).when(F.octet_length(a) == 0, F.lit(1).cast("bigint")).otherwise(found))


# round


#: From so many digits on the rounded number is made of decimal text: 10^digits is no double.
_EXACT_POWERS = 23


def _ten(n: int) -> tuple[float, float]:
    """10^n as a sum of two doubles."""
    high = float(10**n)
    return high, float(10**n - int(high))


def _product(a: Column, b: Column) -> tuple[Column, Column]:
    """a * b as a sum of two doubles (Veltkamp's splitting)."""
    p, big = a * b, 134217729.0
    ah, bh = a * big - (a * big - a), b * big - (b * big - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def _rounded(p: Column, e: Column) -> Column:
    """The sum p + e to a whole number, half up."""
    f = F.floor(p).cast("double")
    d = (p - f) - 0.5
    up = (d > 0) | ((d == 0) & (e >= 0))
    # e may push an exact whole p below itself
    down = (p == f) & (e < 0)
    return F.when(up, f + 1).when(down & (e < -0.5), f - 1).when(down, f).otherwise(f)


def round_half(x: tuple[Column, int], n: tuple[Column, int] | None, n_value=None) -> Column:
    """Half away from zero on the exact binary value; Spark rounds the decimal text.

    |x| * 10^n as a sum p + e of two doubles, so the comparison with the half is exact:
    for up to 22 digits p + e is the exact product; for more, 10^n is a sum of two doubles
    itself, and no product lies at a half.  Where p has no fraction x is its own result.
    """
    if n is None or type(n_value) is int and n_value < _EXACT_POWERS:
        power = 10.0 ** max(0, n_value or 0)
        return let([x], lambda v: _round_with(v, F.lit(power), max(0, n_value or 0) > 0), 4)
    return let([x, n], _round_any, 4)


def _round_with(x: Column, power: Column, signed_zero) -> Column:
    def of(a: Column) -> Column:
        p, e = _product(a, power)
        r = _rounded(p, e) / power
        whole = (a >= 4503599627370496.0) | F.isnan(a) | (p >= 9007199254740992.0)
        keep_sign = (r != 0) | (F.lit(signed_zero) if isinstance(signed_zero, bool) else signed_zero)
        return F.when(whole, x).otherwise(F.when((x < 0) & keep_sign, -r).otherwise(r))

    return of(F.abs(x))


def _round_any(x: Column, n: Column) -> Column:
    tens = [_ten(k) for k in range(309)]
    digits = F.least(F.greatest(n, F.lit(0).cast("bigint")), F.lit(400).cast("bigint")).cast("int")

    def few(d: Column) -> Column:
        return _round_with(x, F.element_at(F.array(*[F.lit(t) for t, _ in tens[:_EXACT_POWERS]]), d + 1), d > 0)

    def many(d: Column) -> Column:
        # 10^d beyond the doubles: x is scaled first
        over = F.greatest(d - 308, F.lit(0))
        a = F.abs(x) * F.element_at(F.array(*[F.lit(t) for t, _ in tens[:93]]), over + 1)
        d = F.least(d, F.lit(308))
        high = F.element_at(F.array(*[F.lit(t) for t, _ in tens]), d + 1)
        low = F.element_at(F.array(*[F.lit(t) for _, t in tens]), d + 1)
        return F.struct(a.alias("a"), high.alias("high"), low.alias("low"))

    def text(t: Column, d: Column) -> Column:
        a, high, low = t["a"], t["high"], t["low"]
        p0, e0 = _product(a, high * 2.0**-60)  # so that splitting 10^n doesn't overflow
        p, e = p0 * 2.0**60, e0 * 2.0**60 + a * low
        whole = ~(p < 9007199254740992.0)  # NaN and infinities, too
        r = F.concat(_rounded(F.when(whole, F.lit(0.0)).otherwise(p), e).cast("bigint").cast("string"), F.lit("e-"), d.cast("string")).cast("double")
        return F.when(whole, x).otherwise(F.when(x < 0, -r).otherwise(r))

    out = bound(digits, lambda d: F.when(d < _EXACT_POWERS, few(d)).otherwise(bound(many(d), lambda t: text(t, d))))
    return F.when(x.isNotNull() & n.isNotNull(), out)


# casts


def real_text(x: Column) -> Column:
    """Shortest digits, exponent below 1e-4 and from 1e15; Spark writes 1.0E20 and -0.0."""

    def parsed(text: Column) -> Column:
        mantissa = F.regexp_extract(text, r"^-?([0-9.]+)", 1)
        exponent = F.coalesce(F.nullif(F.regexp_extract(text, r"[eE]([+-]?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
        point = F.when(F.instr(mantissa, ".") > 0, F.instr(mantissa, ".") - 1).otherwise(F.length(mantissa))
        whole = F.replace(mantissa, F.lit("."), F.lit(""))
        lead = F.length(whole) - F.length(F.ltrim(whole, F.lit("0")))
        return F.struct(F.rtrim(F.ltrim(whole, F.lit("0")), F.lit("0")).alias("digits"), (point + exponent - lead - 1).alias("power"))  # power of the first digit

    def body(t: Column) -> Column:
        digits, power, n = t["digits"], t["power"], F.length(t["digits"])
        science = F.concat(F.substring(digits, 1, 1), F.lit("."), F.when(n > 1, F.substring(digits, F.lit(2), n)).otherwise(F.lit("0")), F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        large = F.concat(F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.lit("."), F.when(n > power + 1, F.substring(digits, power + 2, n)).otherwise(F.lit("0")))
        return F.when((power < -4) | (power >= 15), science).when(power < 0, small).otherwise(large)

    text = F.when((F.length(F.regexp_replace(x.cast("string"), r"[^0-9]|E.*", "")) >= 17) & (F.format_string("%.15e", x).cast("double") == x), F.format_string("%.15e", x)).otherwise(x.cast("string"))
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    written = F.concat(sign, bound(bound(text, parsed), body))
    return F.when(x.isNull(), null("TEXT")).when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("+Inf")).when(x == float("-inf"), F.lit("-Inf")).when(x == 0, F.lit("0.0")).otherwise(written)


#: Which casts there are.
CASTS = {
    "INTEGER": {"INTEGER", "REAL", "TEXT", "BOOLEAN"},
    "REAL": {"REAL", "INTEGER", "TEXT"},
    "BOOLEAN": {"BOOLEAN", "INTEGER", "REAL", "TEXT"},
    "TEXT": {"TEXT", "INTEGER", "REAL", "BOOLEAN", "BLOB", "TIMESTAMP"},
    "BLOB": {"BLOB", "TEXT"},
    "TIMESTAMP": {"TIMESTAMP", "TEXT"},
}
_RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def cast(x: Column, a: str, b: str, pos) -> Column:
    bad = fail(pos, f"value does not convert from {a} to {b}", b)
    if a == b:
        return x
    match a, b:
        case "INTEGER", "BOOLEAN":
            return F.when(x.isNull(), null(b)).when(x.isin(0, 1), x == 1).otherwise(bad)
        case "REAL", "INTEGER":
            ok = (x >= -(2.0**63)) & (x < 2.0**63) & ~F.isnan(x)
            return F.when(x.isNull(), null(b)).when(ok, F.when(ok, x).cast("bigint")).otherwise(bad)
        case "REAL", "TEXT":
            return real_text(x)
        case "BOOLEAN", "REAL":
            return x.cast("int").cast("double")
        case "TEXT", "INTEGER":
            t = F.btrim(x, F.lit(" \t\n\r"))
            n = F.when(t.rlike("^[+-]?[0-9]+$"), t).try_cast("bigint")
            return F.when(x.isNull(), null(b)).when(n.isNotNull(), n).otherwise(bad)
        case "TEXT", "REAL":
            t = F.btrim(x, F.lit(" \t\n\r"))
            n = F.when(t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t).try_cast("double")
            return F.when(x.isNull(), null(b)).when(n.isNotNull() & (F.abs(n) <= BIG), n).otherwise(bad)
        case "TEXT", "BOOLEAN":
            t = lettercase(F.btrim(x, F.lit(" \t\n\r")))
            return F.when(x.isNull(), null(b)).when(t == "true", F.lit(True)).when(t == "false", F.lit(False)).otherwise(bad)
        case "TEXT", "BLOB":
            return F.encode(x, "UTF-8")
        case "BLOB", "TEXT":
            return F.when(x.isNull(), null(b)).when(F.is_valid_utf8(x.cast("string")), x.cast("string")).otherwise(bad)
        case "TEXT", "TIMESTAMP":
            local = F.substring(x, 1, 19)
            fraction = F.regexp_extract(x, r"(\.[0-9]{1,6})", 1)
            wall = F.concat(F.replace(local, F.lit("T"), F.lit(" ")), fraction).try_cast("timestamp_ntz")
            zone = F.regexp_extract(x, r"([+-][0-9]{2}:[0-9]{2})$", 1)
            minutes = F.when(zone == "", F.lit(0)).otherwise(F.concat(F.substring(zone, 1, 1), F.lit("1")).try_cast("int") * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")))
            moved = wall - F.make_dt_interval(F.lit(0), F.lit(0), minutes)
            return F.when(x.isNull(), null(b)).when(x.rlike(_RFC3339) & wall.isNotNull(), moved).otherwise(bad)
        case "TIMESTAMP", "TEXT":
            return timestamp_text(x)
        case _:
            return x.cast(SPARK[b])


def timestamp_text(x: Column) -> Column:
    """RFC 3339 in UTC, the fraction without trailing zeros; no session's time zone plays a part."""
    return F.concat(F.replace(x.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def spark_type(kind: str) -> str | None:
    """The dialect's type of a Spark type name, None if it has none."""
    return {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN", "string": "TEXT", "binary": "BLOB", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}.get(re.sub(r"\(.*", "", kind))


# sums of doubles

#: A number below 2^62 is a whole number and a fraction of 63 bits; digits of 21 bits of both are summed.
_DIGIT, _FRACTION = 21, 63
_INSIDE = 2.0**62


def whole_part(x: Column) -> Column:
    """The whole number in a double below 2^62 in magnitude; null for others."""
    return F.when(F.abs(x) < _INSIDE, x).cast("bigint")  # NaN is greater


def fraction(x: Column, whole: Column) -> Column:
    """The rest of it, in units of 2^-63."""
    return ((x - whole.cast("double")) * 2.0**_FRACTION).cast("bigint")


def digit_sums(x: Column, whole: Column, part: Column) -> list[Column]:
    """Aggregates that together hold the exact sum of doubles: they merge in any order, so a sum
    has one value however rows are dealt, and partial aggregation works.

    Sums of digits are exact for up to 2^42 rows a group (beyond, an overflow error).  What
    lies below 2^-63, and numbers from 2^62 on, are added up as doubles, the last beside
    their greatest magnitude, which tells an overflow.
    """
    mask = F.lit(2**_DIGIT - 1)
    digits = [d for n in (whole, part) for d in (F.shiftright(n, 2 * _DIGIT), F.shiftright(n, _DIGIT).bitwiseAND(mask), n.bitwiseAND(mask))]
    below = (x - whole.cast("double")) - part.cast("double") * 2.0**-_FRACTION
    outside = F.when(whole.isNull(), x)
    return [*[F.sum(d) for d in digits], F.sum(below), F.sum(outside), F.max(F.abs(outside))]


def digit_total(parts: list[Column], pos) -> Column:
    """The sum that digit_sums hold, rounded once; null over nothing."""
    *digits, below, outside, greatest = parts
    terms = [outside]
    for k, d in enumerate(digits):
        unit = 2.0 ** ((2 - k % 3) * _DIGIT - (_FRACTION if k >= 3 else 0))
        # halves of 32 and 31 bits are exact as doubles
        terms += [F.shiftright(d, 31).cast("double") * (unit * 2.0**31), d.bitwiseAND(F.lit(2**31 - 1)).cast("double") * unit]
    terms = [F.coalesce(t, F.lit(0.0)) for t in [*terms, below]]
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(a: Column, t: Column) -> Column:  # Neumaier's sum
        s = a["s"] + t
        lost = F.when(F.abs(a["s"]) >= F.abs(t), (a["s"] - s) + t).otherwise((t - s) + a["s"])
        return F.struct(s.alias("s"), (a["c"] + lost).alias("c"))

    total = F.aggregate(F.array(*terms), zero, add, lambda a: F.when(finite(a["s"]), a["s"] + a["c"]).otherwise(a["s"]))
    some = digits[0].isNotNull() | greatest.isNotNull()
    return F.when(some, bound(total, lambda t: F.when(~finite(t) & finite(F.coalesce(greatest, F.lit(0.0))), fail(pos, "REAL overflow", "REAL")).otherwise(t)))
