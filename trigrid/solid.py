"""The base solid and the constants that define what a cell is."""

from __future__ import annotations

import numpy as np

# The order of vertices and faces, the rotation, the pairing of faces and the radius define addresses.
EARTH_KM = 6371.0088
ROTATION_DEG = 7.3
MAX_LEVEL = 27
EPS = 1e-14
FACES = (
    (0, 11, 5), (0, 5, 1), (0, 1, 7), (0, 7, 10), (0, 10, 11),
    (1, 5, 9), (5, 11, 4), (11, 10, 2), (10, 7, 6), (7, 1, 8),
    (3, 9, 4), (3, 4, 2), (3, 2, 6), (3, 6, 8), (3, 8, 9),
    (4, 9, 5), (2, 4, 11), (6, 2, 10), (8, 6, 7), (9, 8, 1),
)
#: (first face, second face, shared edge) of the ten diamonds.
DIAMONDS = (
    (0, 1, (0, 5)), (2, 3, (0, 7)), (4, 7, (10, 11)), (5, 15, (5, 9)), (6, 16, (4, 11)),
    (8, 17, (6, 10)), (9, 18, (7, 8)), (10, 11, (3, 4)), (12, 13, (3, 6)), (14, 19, (8, 9)),
)
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def vertices() -> np.ndarray:
    """The twelve vertices: cyclic (0, ±1, ±phi) rectangles in the fixed order, on the unit sphere, turned about z."""
    phi = (1 + 5**0.5) / 2
    signs = ((-1, 1), (1, 1), (-1, -1), (1, -1))
    xyz = [(a, b * phi, 0) for a, b in signs] + [(0, a, b * phi) for a, b in signs] + [(b * phi, 0, a) for a, b in signs]
    v = np.array(xyz, float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    t = np.radians(ROTATION_DEG)
    turn = np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1]])
    return v @ turn.T


def face_triangles() -> np.ndarray:
    """Faces x corners x coordinates."""
    return vertices()[np.array(FACES)]
