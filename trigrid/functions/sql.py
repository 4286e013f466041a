"""The address algebra as SQL functions: register(spark) makes them temporary functions of a session.

They are SQL expressions, which Spark inlines, so filters push down and no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..solid import ALPHABET, MAX_LEVEL
from .address import _OWN, _PLAIN

_LEVEL = "CAST(a & 31 AS INT)"
_BITS = f"(shiftrightunsigned(a, 59 - 2 * {_LEVEL}) & (shiftleft(1L, 2 * {_LEVEL}) - 1L))"
_LETTERS = f"CAST(ceil({_LEVEL} * 2 / 5) AS INT)"
_IN_32 = f"lpad(conv(CAST(shiftleft({_BITS}, 5 * {_LETTERS} - 2 * {_LEVEL}) AS STRING), 10, 32), {_LETTERS}, '0')"

#: name -> (parameters, result, expression).
FUNCTIONS = {
    "cell_base32": ("v INT", "STRING", f"substring('{ALPHABET}', v + 1, 1)"),
    "cell_face": ("a BIGINT", "INT", "CAST(shiftrightunsigned(a, 59) AS INT)"),
    "cell_level": ("a BIGINT", "INT", _LEVEL),
    "cell_path_number": ("a BIGINT", "BIGINT", _BITS),
    "cell_unsigned": ("a BIGINT", "STRING", "conv(hex(a), 16, 10)"),
    "cell_encode": ("face INT, digits STRING", "BIGINT", f"""CASE WHEN face BETWEEN 0 AND 19 AND digits RLIKE '^[0-3]{{0,{MAX_LEVEL}}}$' THEN
        shiftleft(CAST(face AS BIGINT), 59) | shiftleft(CAST(conv(concat('0', digits), 4, 10) AS BIGINT), 59 - 2 * length(digits)) | CAST(length(digits) AS BIGINT)
        WHEN face IS NOT NULL AND digits IS NOT NULL THEN CAST(raise_error('face, level or digit out of range') AS BIGINT) END"""),
    "cell_path": ("a BIGINT", "STRING", f"concat('F', lpad(CAST(shiftrightunsigned(a, 59) AS STRING), 2, '0'), '-', CASE WHEN {_LEVEL} > 0 THEN lpad(conv(CAST({_BITS} AS STRING), 10, 4), {_LEVEL}, '0') ELSE '' END)"),
    "cell_compact": ("a BIGINT", "STRING", f"concat('T', substring('{ALPHABET}', CAST(shiftrightunsigned(a, 59) AS INT) + 1, 1), substring('{ALPHABET}', {_LEVEL} + 1, 1), CASE WHEN {_LEVEL} > 0 THEN translate({_IN_32}, '{_PLAIN}', '{_OWN}') ELSE '' END)"),
    "cell_from_compact": ("s STRING", "BIGINT", f"""CASE WHEN s IS NULL THEN NULL
        WHEN upper(trim(s)) RLIKE '^T[0-9A-Z]{{2,13}}$' AND translate(translate(substring(upper(trim(s)), 2), 'ILOU', '110V'), '{ALPHABET}', '') = ''
         AND instr('{ALPHABET}', translate(substring(upper(trim(s)), 2, 1), 'ILOU', '110V')) <= 20 AND instr('{ALPHABET}', translate(substring(upper(trim(s)), 3, 1), 'ILOU', '110V')) <= {MAX_LEVEL + 1}
         AND length(trim(s)) = 3 + ceil((instr('{ALPHABET}', translate(substring(upper(trim(s)), 3, 1), 'ILOU', '110V')) - 1) * 2 / 5)
        THEN shiftleft(CAST(instr('{ALPHABET}', translate(substring(upper(trim(s)), 2, 1), 'ILOU', '110V')) - 1 AS BIGINT), 59)
           | shiftleft(shiftrightunsigned(CAST(conv(concat('0', translate(translate(substring(upper(trim(s)), 4), 'ILOU', '110V'), '{_OWN}', '{_PLAIN}')), 32, 10) AS BIGINT),
               5 * (length(trim(s)) - 3) - 2 * (instr('{ALPHABET}', translate(substring(upper(trim(s)), 3, 1), 'ILOU', '110V')) - 1)), 61 - 2 * instr('{ALPHABET}', translate(substring(upper(trim(s)), 3, 1), 'ILOU', '110V')))
           | CAST(instr('{ALPHABET}', translate(substring(upper(trim(s)), 3, 1), 'ILOU', '110V')) - 1 AS BIGINT)
        ELSE CAST(raise_error('not a compact address') AS BIGINT) END"""),
    "cell_parent_at": ("a BIGINT, n INT", "BIGINT", f"CASE WHEN {_LEVEL} >= n THEN (a & ~(shiftleft(1L, 59 - 2 * n) - 1L)) | CAST(n AS BIGINT) END"),
    "cell_parent": ("a BIGINT", "BIGINT", f"CASE WHEN {_LEVEL} = 0 THEN CAST(raise_error('level 0 has no parent') AS BIGINT) ELSE (a & ~(shiftleft(1L, 61 - 2 * {_LEVEL}) - 1L)) | CAST({_LEVEL} - 1 AS BIGINT) END"),
    "cell_child": ("a BIGINT, d INT", "BIGINT", f"CASE WHEN {_LEVEL} < {MAX_LEVEL} AND d BETWEEN 0 AND 3 THEN (a | shiftleft(CAST(d AS BIGINT), 57 - 2 * {_LEVEL})) + 1L WHEN a IS NOT NULL AND d IS NOT NULL THEN CAST(raise_error('no child there') AS BIGINT) END"),
    "cell_children": ("a BIGINT", "ARRAY<BIGINT>", f"CASE WHEN {_LEVEL} < {MAX_LEVEL} THEN transform(sequence(0L, 3L), d -> (a | shiftleft(d, 57 - 2 * {_LEVEL})) + 1L) END"),
    "cell_descendant_lo": ("a BIGINT", "BIGINT", "a"),
    "cell_descendant_hi": ("a BIGINT", "BIGINT", f"(a & ~31L) | ((shiftleft(1L, 59 - 2 * {_LEVEL}) - 1L) & ~31L) | {MAX_LEVEL}L"),
    "cell_is_ancestor": ("a BIGINT, b BIGINT", "BOOLEAN", f"CAST(b & 31 AS INT) >= {_LEVEL} AND ((b & ~(shiftleft(1L, 59 - 2 * {_LEVEL}) - 1L)) | CAST({_LEVEL} AS BIGINT)) = a"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions temporary functions of the session; their names come back. Nulls give null; what is out of
    range raises, but cell_parent_at of a cell coarser than the level is null."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
