"""Parts of the SQL twins that compute geometry: recursive descents over the base solid, for DuckDB."""

from __future__ import annotations

from ..functions import octa
from ..functions.cube import LEAF, TURN, VISIT
from ..functions.geometry import _OF_FACE
from ..solid import EARTH_KM, FACES, face_triangles

XYZ = "uvw"


def faces(solid: str = "") -> str:
    """Rows (face, au, av, aw, ... cw) of the twenty faces, or of the octahedron's eight."""
    own = octa.faces() if solid == "octa" else face_triangles()
    rows = ", ".join(f"({f}, {', '.join(f'{float(v)!r}::DOUBLE' for v in t.ravel())})" for f, t in enumerate(own))
    return f"faces(face, {', '.join(c + k for c in 'abc' for k in XYZ)}) AS (VALUES {rows})"


def det(a: str, b: str, p: str) -> str:
    """The signed volume of three vectors given by their prefixes."""
    turn = [f"({a}{j} * {b}{k} - {a}{k} * {b}{j}) * {p}{i}" for i, j, k in ("uvw", "vwu", "wuv")]
    return "(" + " + ".join(turn) + ")"


def dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{k} * {b}{k}" for k in XYZ) + ")"


def _middles(pairs=("ab", "bc", "ca")) -> str:
    norm = lambda a, b: "sqrt(" + " + ".join(f"({a}{k} + {b}{k}) * ({a}{k} + {b}{k})" for k in XYZ) + ")"
    return ", ".join(f"({a}{k} + {b}{k}) / {norm(a, b)} AS {a}{b}{k}" for a, b in pairs for k in XYZ)


#: Corners of child d by name: a digit below 3 keeps its own corner and takes two middles.
_CHILD = {"a": ("a", "ab", "ca", "ab"), "b": ("ab", "b", "bc", "bc"), "c": ("ca", "bc", "c", "ca")}
_STEP = ", ".join(f"CASE d WHEN 0 THEN {n[0]}{k} WHEN 1 THEN {n[1]}{k} WHEN 2 THEN {n[2]}{k} ELSE {n[3]}{k} END" for n in _CHILD.values() for k in XYZ)
_CORNERS = ", ".join(c + k for c in "abc" for k in XYZ)


def located(points: str, key: str, level: int, name: str = "located", solid: str = "") -> str:
    """CTEs that end in `name`({key}, cell): the cells of points (key, lon, lat), by descent from the face that holds
    them through the children that the three inner edges tell apart."""
    p = "cos(radians(lat)) * cos(radians(lon)) AS pu, cos(radians(lat)) * sin(radians(lon)) AS pv, sin(radians(lat)) AS pw"
    depth = f"least({det('a', 'b', 'p')}, {det('b', 'c', 'p')}, {det('c', 'a', 'p')})"
    d = f"CASE WHEN {det('ab', 'ca', 'p')} > 0 THEN 0 WHEN {det('bc', 'ab', 'p')} > 0 THEN 1 WHEN {det('ca', 'bc', 'p')} > 0 THEN 2 ELSE 3 END"
    return f"""{faces(solid)}, {name}_p AS (SELECT {key}, {p} FROM ({points})),
{name}_f AS (SELECT {key}, min(face) FILTER (WHERE {depth} >= -1e-14) AS face FROM {name}_p, faces GROUP BY {key}),
{name}_r AS (SELECT q.{key}, pu, pv, pw, 0 AS n, f.face::UBIGINT AS path, {_CORNERS} FROM {name}_p q JOIN {name}_f USING ({key}) JOIN faces f USING (face)
UNION ALL SELECT {key}, pu, pv, pw, n + 1, path * 4 + d, {_STEP} FROM (SELECT *, {d} AS d FROM (SELECT *, {_middles()} FROM {name}_r WHERE n < {level}))),
{name} AS (SELECT {key}, (path << {59 - 2 * level}) | {level}::UBIGINT AS cell FROM {name}_r WHERE n = {level})"""


def cornered(cells: str, name: str = "cornered") -> str:
    """CTEs that end in `name`(cell, au ... cw): the corners of cells (cell)."""
    d = "((cell >> (57 - 2 * n)::UBIGINT) & 3)::INT"
    return f"""{faces()}, {name}_r AS (SELECT cell, 0 AS n, {_CORNERS} FROM ({cells}) JOIN faces ON face = (cell >> 59)::INT
UNION ALL SELECT cell, n + 1, {_STEP} FROM (SELECT *, {d} AS d, {_middles()} FROM {name}_r WHERE n < (cell & 31)::INT)),
{name} AS (SELECT cell, {_CORNERS} FROM {name}_r WHERE n = (cell & 31)::INT)"""


def arc(a: str, b: str) -> str:
    return f"acos(greatest(-1, least(1, {dot(a, b)})))"


#: The spherical area by the tangent of half its excess, and the mean edge.
EDGES = f"{arc('a', 'b')} AS ab, {arc('b', 'c')} AS bc, {arc('c', 'a')} AS ca, 2 * atan2({det('a', 'b', 'c')}, 1 + {dot('a', 'b')} + {dot('b', 'c')} + {dot('c', 'a')}) AS excess"
AREA = f"excess * {EARTH_KM} * {EARTH_KM}"
EDGE = f"(ab + bc + ca) / 3 * {EARTH_KM}"
CENTRE = "degrees(atan2(av + bv + cv, au + bu + cu)) AS lon, degrees(asin((aw + bw + cw) / sqrt(power(au + bu + cu, 2) + power(av + bv + cv, 2) + power(aw + bw + cw, 2)))) AS lat"


def latticed(cells: str, name: str = "latticed") -> str:
    """CTEs that end in `name`(cell, face, level, a0 ... c2): corners in whole barycentric numbers."""
    start = ", ".join(f"{int('abc'.index(c) == k)}::BIGINT AS {c}{k}" for c in "abc" for k in range(3))
    value = {"a": "2 * a", "b": "2 * b", "c": "2 * c"}
    of = lambda s, k: f"{value[s]}{k}" if len(s) == 1 else f"{s[0]}{k} + {s[1]}{k}"
    step = ", ".join(f"CASE d WHEN 0 THEN {of(n[0], k)} WHEN 1 THEN {of(n[1], k)} WHEN 2 THEN {of(n[2], k)} ELSE {of(n[3], k)} END" for n in _CHILD.values() for k in range(3))
    names = ", ".join(c + str(k) for c in "abc" for k in range(3))
    return f"""{name}_r AS (SELECT cell, (cell >> 59)::INT AS face, (cell & 31)::INT AS level, 0 AS n, {start} FROM ({cells})
UNION ALL SELECT cell, face, level, n + 1, {step} FROM (SELECT *, ((cell >> (57 - 2 * n)::UBIGINT) & 3)::INT AS d FROM {name}_r WHERE n < level)),
{name} AS (SELECT cell, face, level, {names} FROM {name}_r WHERE n = level)"""


def rhombi(cells: str, name: str = "rhombi") -> str:
    """CTEs that end in `name`(cell, diamond, level, x, y, orientation, key), key with the place on the Hilbert curve."""
    rows = ", ".join(f"({f}, {_OF_FACE[f][0]}, {_OF_FACE[f][1]}, {FACES[f].index(_OF_FACE[f][2][0])}, {FACES[f].index(_OF_FACE[f][2][1])})" for f in range(20))
    pick = lambda c, col: f"CASE {col} WHEN 0 THEN {c}0 WHEN 1 THEN {c}1 ELSE {c}2 END"
    px = ", ".join(f"CASE half WHEN 0 THEN {pick(c, 'i')} ELSE size - ({pick(c, 'j')}) END AS {c}u, CASE half WHEN 0 THEN {pick(c, 'j')} ELSE size - ({pick(c, 'i')}) END AS {c}v" for c in "abc")
    return f"""{latticed(cells, name + '_l')}, {name}_d(face, diamond, half, i, j) AS (VALUES {rows}),
{name}_q AS (SELECT cell, diamond, level, {px} FROM (SELECT *, (1::BIGINT << level) AS size FROM {name}_l JOIN {name}_d USING (face))),
{name}_x AS (SELECT *, least(au, bu, cu) AS x, least(av, bv, cv) AS y FROM {name}_q),
{name}_o AS (SELECT cell, diamond, level, x, y, (NOT ((au = x AND av = y) OR (bu = x AND bv = y) OR (cu = x AND cv = y)))::BIGINT AS orientation FROM {name}_x),
{name}_h AS (SELECT cell, level - 1 AS bit, x AS hx, y AS hy, 0::BIGINT AS d FROM {name}_o
UNION ALL SELECT cell, bit - 1, CASE WHEN ry = 1 THEN hx WHEN rx = 1 THEN s - 1 - hy ELSE hy END, CASE WHEN ry = 1 THEN hy WHEN rx = 1 THEN s - 1 - hx ELSE hx END, d + s * s * xor(3 * rx, ry)
FROM (SELECT *, (1::BIGINT << bit) AS s, (hx >> bit) & 1 AS rx, (hy >> bit) & 1 AS ry FROM {name}_h WHERE bit >= 0)),
{name} AS (SELECT o.*, ((diamond::UBIGINT << 59) | (h.d::UBIGINT << (2 * (27 - level) + 5)::UBIGINT) | level::UBIGINT)::BIGINT AS key FROM {name}_o o JOIN {name}_h h USING (cell) WHERE bit = -1)"""


def hexes(cells: str, name: str = "hexes") -> str:
    """CTEs that end in `name`(cell, hex): the corner of a cell that the group goes by has colour 0."""
    corner = ", ".join(f"CASE WHEN (a1 + 2 * a2) % 3 = 0 THEN a{k} WHEN (b1 + 2 * b2) % 3 = 0 THEN b{k} ELSE c{k} END AS v{k}" for k in range(3))
    rows = ", ".join(f"({f}, {v[0]}, {v[1]}, {v[2]})" for f, v in enumerate(FACES))
    two = lambda x: f"lpad({x}::VARCHAR, 2, '0')"
    on = "list_sort(list_filter([{'v': f0, 'n': v0}, {'v': f1, 'n': v1}, {'v': f2, 'n': v2}], lambda t: t.n > 0))"
    return f"""{latticed(cells, name + '_l')}, {name}_v(face, f0, f1, f2) AS (VALUES {rows}),
{name}_c AS (SELECT cell, face, level, f0, f1, f2, {corner} FROM {name}_l JOIN {name}_v USING (face)),
{name} AS (SELECT cell, CASE len(l) WHEN 1 THEN 'HV' || {two('l[1].v')} || '-' || {two('level')} WHEN 2 THEN 'HE' || {two('l[1].v')} || {two('l[2].v')} || '-' || {two('level')} || '-' || l[2].n
ELSE 'HF' || {two('face')} || '-' || {two('level')} || '-' || v0 || '-' || v1 || '-' || v2 END AS hex FROM (SELECT *, {on} AS l FROM {name}_c))"""


def quads(points: str, key: str, level: int, name: str = "quads") -> str:
    """CTEs that end in `name`({key}, cell): cells of the cube at a level, quarter by quarter along the curve."""
    even = lambda c: f"CASE WHEN {c} >= 0 THEN sqrt(1 + 3 * abs({c})) / 2 ELSE 1 - sqrt(1 + 3 * abs({c})) / 2 END"
    u, v = ("CASE face WHEN 0 THEN " + " ".join(f"{x} WHEN {k + 1} THEN" if k < 5 else f"{x} END" for k, x in enumerate(sides)) for sides in (("y / x", "-x / y", "-x / z", "z / x", "z / y", "-y / z"), ("z / x", "z / y", "-y / z", "y / x", "-x / y", "-x / z")))
    place = lambda c: f"greatest(0, least({2**LEAF - 1}, floor(({even(c)}) * {2**LEAF})))::BIGINT"
    return f"""{name}_p AS (SELECT {key}, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM ({points})),
{name}_f AS (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END WHEN abs(y) >= abs(z) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END ELSE CASE WHEN z < 0 THEN 5 ELSE 2 END END AS face FROM {name}_p),
{name}_u AS (SELECT {key}, face, {u} AS u, {v} AS v FROM {name}_f),
{name}_r AS (SELECT {key}, face, {place('u')} AS i, {place('v')} AS j, 0 AS n, face % 2 AS way, 0::BIGINT AS place FROM {name}_u
UNION ALL SELECT {key}, face, i, j, n + 1, xor(way, {TURN.tolist()}[d + 1])::INT, place * 4 + d FROM (SELECT *, {VISIT.tolist()}[way + 1][(((i >> ({LEAF - 1} - n)) & 1) * 2 + ((j >> ({LEAF - 1} - n)) & 1))::INT + 1] AS d FROM {name}_r WHERE n < {level})),
{name} AS (SELECT {key}, (face::UBIGINT << 61) | ((place::UBIGINT * 2 + 1) << {2 * (LEAF - level)}) AS cell FROM {name}_r WHERE n = {level})"""
