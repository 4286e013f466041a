"""Cell addresses as Column expressions: everything here stays inside whole-stage code generation or SQL arrays.

A cell is a BIGINT with the bit pattern face (5 bits), path (27 base-4 digits, left-aligned), level (5 bits). Faces 16
to 19 are negative numbers: compare order with `in_order`, within one face plain order is right.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..solid import ALPHABET, MAX_LEVEL


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _shl(x, n) -> Column:
    return F.call_function("shiftleft", x, n if isinstance(n, Column) else F.lit(n))


def _shr(x, n) -> Column:
    return F.call_function("shiftrightunsigned", x, n if isinstance(n, Column) else F.lit(n))


def _one() -> Column:
    return F.lit(1).cast("long")


def checked(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("long"))


def face_of(a) -> Column:
    return _shr(_c(a), 59).cast("int")


def level_of(a) -> Column:
    return _c(a).bitwiseAND(F.lit(31)).cast("int")


def digit_at(a, k) -> Column:
    """The k-th digit, k from 1."""
    return _shr(_c(a), F.lit(59) - F.lit(2) * k).bitwiseAND(F.lit(3)).cast("int")


def digits_of(a) -> Column:
    a = _c(a)
    return F.when(level_of(a) > 0, F.transform(F.sequence(F.lit(1), F.greatest(level_of(a), F.lit(1))), lambda k: digit_at(a, k))).otherwise(F.array().cast("array<int>"))


def pack(face, digits) -> Column:
    """The address of (face, digits); out of range values raise."""
    face, digits = _c(face), _c(digits)
    n = F.size(digits)
    ok = face.between(0, 19) & (n <= MAX_LEVEL) & F.forall(digits, lambda d: d.between(0, 3))
    path = F.aggregate(digits, F.lit(0).cast("long"), lambda p, d: _shl(p, 2).bitwiseOR(d.cast("long")))
    return checked(ok, _shl(face.cast("long"), 59).bitwiseOR(_shl(path, F.lit(59) - 2 * n)).bitwiseOR(n.cast("long")), "face, level or digit out of range")


def unsigned(a) -> Column:
    """The address as the decimal string of an unsigned number."""
    return F.conv(F.hex(_c(a)), 16, 10)


def from_unsigned(s) -> Column:
    """Decimal string -> address."""
    d = _c(s).cast("decimal(20,0)")
    return F.when(d < F.lit("9223372036854775808").cast("decimal(20,0)"), d).otherwise(d - F.lit("18446744073709551616").cast("decimal(20,0)")).cast("long")


def in_order(a) -> Column:
    """A BIGINT whose plain order is the unsigned, depth-first order of addresses."""
    return _c(a).bitwiseXOR(F.lit(-(1 << 63)))


def up(a, level) -> Column:
    """The ancestor at a level; null if the cell is coarser than that."""
    a = _c(a)
    level = _c(level) if isinstance(level, (str, Column)) else F.lit(level)
    low = _shl(_one(), F.lit(59) - 2 * level) - 1
    return F.when(level_of(a) >= level, a.bitwiseAND(F.bitwise_not(low)).bitwiseOR(level.cast("long")))


def parent(a) -> Column:
    a = _c(a)
    return F.when(level_of(a) == 0, F.raise_error(F.lit("level 0 has no parent")).cast("long")).otherwise(up(a, level_of(a) - 1))


def child(a, digit) -> Column:
    a = _c(a)
    digit = digit if isinstance(digit, Column) else F.lit(digit)
    made = a.bitwiseOR(_shl(digit.cast("long"), F.lit(57) - 2 * level_of(a))) + 1
    return checked((level_of(a) < MAX_LEVEL) & digit.between(0, 3), made, "no child there")


def children(a) -> Column:
    return F.array(*[child(a, d) for d in range(4)])


def is_ancestor(a, b) -> Column:
    """Whether a is b or above it. As a join condition it is an equality on up(b, level)."""
    return F.coalesce(up(b, level_of(a)) == _c(a), F.lit(False))


def subtree(a) -> Column:
    """struct(lo, hi), inclusive: every descendant's address lies in it, and within a face plain order holds."""
    a = _c(a)
    low = _shl(_one(), F.lit(59) - 2 * level_of(a)) - 1
    return F.struct(a.alias("lo"), a.bitwiseAND(F.bitwise_not(F.lit(31).cast("long"))).bitwiseOR(low.bitwiseAND(F.bitwise_not(F.lit(31).cast("long")))).bitwiseOR(F.lit(MAX_LEVEL).cast("long")).alias("hi"))


def index_at(a, level: int) -> Column:
    """The cell's place among the 20 * 4**level cells of a level, the first one if it is coarser."""
    return _shr(_c(a), 59 - 2 * level)


def span(a, level: int) -> Column:
    """struct(start, stop): the half-open run of indexes at a level that the cell covers."""
    a = _c(a)
    start = index_at(a, level)
    width = _shl(_one(), 2 * (F.lit(level) - level_of(a)))
    ok = level_of(a) <= level
    return F.struct(start.alias("start"), checked(ok, start + width, "cell finer than the level").alias("stop"))


def from_index(i, level: int) -> Column:
    return _shl(_c(i).cast("long"), 59 - 2 * level).bitwiseOR(F.lit(level).cast("long"))


def located_or_raise(cell) -> Column:
    """The address, or an error where a point has none: the strict form of cell_of, which gives null."""
    cell = _c(cell)
    return F.coalesce(cell, F.raise_error(F.lit("longitude in [-180, 180] and latitude in [-90, 90] are asked for")).cast("long"))


#: Digits 10 to 31 as conv() writes them, and as the alphabet does.
_PLAIN, _OWN = "ABCDEFGHIJKLMNOPQRSTUV", ALPHABET[10:]


def path_of(a) -> Column:
    """The digits as one number."""
    a = _c(a)
    return _shr(a, F.lit(59) - 2 * level_of(a)).bitwiseAND(_shl(_one(), 2 * level_of(a)) - 1)


def _in_base(value: Column, base: int, width: Column) -> Column:
    return F.when(width > 0, F.lpad(F.conv(value.cast("string"), 10, base), width, "0")).otherwise(F.lit(""))


def to_path(a) -> Column:
    a = _c(a)
    return F.concat(F.lit("F"), F.lpad(face_of(a).cast("string"), 2, "0"), F.lit("-"), _in_base(path_of(a), 4, level_of(a)))


def from_path(s) -> Column:
    """'F07-0123', in any case -> address; anything else raises."""
    return F.when(_c(s).isNotNull(), F.coalesce(_path(F.upper(F.trim(_c(s)))), F.raise_error(F.lit("not a path")).cast("long")))


def _made(face: Column, path: Column, level: Column) -> Column:
    return _shl(face.cast("long"), 59).bitwiseOR(_shl(path, F.lit(59) - 2 * level)).bitwiseOR(level.cast("long"))


def _path(s: Column) -> Column:
    tail = F.regexp_extract(s, r"^F\d{1,2}-?([0-3]*)$", 1)
    face = F.regexp_extract(s, r"^F(\d{1,2})", 1)
    path = F.when(tail == "", F.lit(0).cast("long")).otherwise(F.conv(tail, 4, 10).cast("long"))
    return F.when(s.rlike(r"^F(0?\d|1\d)(-[0-3]{0,27})?$"), _made(face, path, F.length(tail)))


def to_compact(a) -> Column:
    """'T', face, level, then the path's bits five at a time, padded on the right."""
    a = _c(a)
    level = level_of(a)
    n = F.ceil(level * 2 / F.lit(5)).cast("int")
    letter = lambda k: F.substring(F.lit(ALPHABET), k + 1, F.lit(1))
    return F.concat(F.lit("T"), letter(face_of(a)), letter(level), F.translate(_in_base(_shl(path_of(a), 5 * n - 2 * level), 32, n), _PLAIN, _OWN))


def from_compact(s) -> Column:
    """Compact string -> address. Case and I, L, O, U are forgiven; what is past the level's bits is ignored."""
    return F.when(_c(s).isNotNull(), F.coalesce(_compact(F.upper(F.trim(_c(s)))), F.raise_error(F.lit("not a compact address")).cast("long")))


def _compact(s: Column) -> Column:
    body = F.translate(F.substring(s, F.lit(2), F.length(s)), "ILOU", "110V")
    at = lambda k: F.instr(F.lit(ALPHABET), F.substring(body, F.lit(k), F.lit(1))) - 1
    face, level = at(1), at(2)
    n = F.ceil(level * 2 / F.lit(5)).cast("int")
    ok = s.rlike("^T[0-9A-Z]{2,13}$") & (F.translate(body, ALPHABET, "") == "") & level.between(0, MAX_LEVEL) & face.between(0, 19) & (F.length(body) == n + 2)
    tail = F.translate(F.substring(body, F.lit(3), n), _OWN, _PLAIN)
    bits = F.when(tail == "", F.lit(0).cast("long")).otherwise(F.conv(tail, 32, 10).cast("long"))
    return F.when(ok, _made(face, _shr(bits, 5 * n - 2 * level), level))


def try_parse(s) -> Column:
    """Path, compact or decimal string -> address, null if it is none of them."""
    s = F.upper(F.trim(_c(s)))
    number = F.try_to_number(F.when(s.rlike(r"^\d{1,20}$"), s), F.lit("9" * 20))
    number = F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number)
    return F.coalesce(_path(s), _compact(s), from_unsigned(number))


def parse(s) -> Column:
    s = _c(s)
    return F.when(s.isNotNull(), F.coalesce(try_parse(s), F.raise_error(F.lit("not an address")).cast("long")))
