"""PLY files, ASCII and binary, as arrays: vertices with every scalar property, faces as triangles."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# The type names of the format.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
         "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


@dataclass
class Ply:
    """``first`` is the row number of the first vertex, for clouds cut into several files."""

    vertices: dict[str, np.ndarray] = field(default_factory=dict)
    faces: np.ndarray = field(default_factory=lambda: np.empty((0, 3), np.int64))
    first: int = 0
    rejects: list[tuple[int, str]] = field(default_factory=list)


@dataclass
class _Element:
    name: str
    count: int
    scalars: list[tuple[str, str]] = field(default_factory=list)
    lists: list[tuple[str, str, str]] = field(default_factory=list)
    order: list[str] = field(default_factory=list)


def header(data: bytes) -> tuple[str, list[_Element], int, int]:
    """(format, elements, first byte of the body, number of the first vertex)."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("no PLY header")
    body = data.index(b"\n", end) + 1 if b"\n" in data[end:] else len(data)
    kind, elements, first = "ascii", [], 0
    for line in data[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:2] == ["comment", "first"]:
            first = int(w[2])
        elif w[:1] == ["element"]:
            elements.append(_Element(w[1], int(w[2])))
        elif w[:2] == ["property", "list"]:
            elements[-1].lists.append((w[4], TYPES[w[2]], TYPES[w[3]]))
            elements[-1].order.append(w[4])
        elif w[:1] == ["property"]:
            elements[-1].scalars.append((w[2], TYPES[w[1]]))
            elements[-1].order.append(w[2])
    return kind, elements, body, first


def _fan(corners: list[int]) -> list[list[int]]:
    """Triangles of a polygon around its first corner."""
    return [[corners[0], corners[i], corners[i + 1]] for i in range(1, len(corners) - 1)]


def _ascii(data: bytes, elements: list[_Element], out: Ply) -> None:
    lines = data.decode("utf-8", "replace").splitlines()
    at, triangles = 0, []
    for element in elements:
        rows = []
        for number in range(at, min(at + element.count, len(lines))):
            words = lines[number].split()
            try:
                if element.name == "vertex" and not element.lists:
                    if len(words) < len(element.scalars):
                        raise ValueError
                    rows.append([float(x) for x in words[: len(element.scalars)]])
                elif element.name == "face":
                    corners = [int(float(x)) for x in words[1 : 1 + int(words[0])]]
                    if len(corners) < 3:
                        raise ValueError
                    triangles += _fan(corners)
            except (ValueError, IndexError):
                out.rejects.append((number, lines[number]))
        if element.name == "vertex":
            table = np.array(rows, float).reshape(-1, len(element.scalars))
            out.vertices = {name: table[:, i] for i, (name, _) in enumerate(element.scalars)}
        at += element.count
    if len(lines) < at:
        out.rejects.append((len(lines), f"{at - len(lines)} rows are missing"))
    out.faces = np.array(triangles, np.int64).reshape(-1, 3)


def _binary(data: memoryview, elements: list[_Element], out: Ply, order: str) -> None:
    at = 0
    for element in elements:
        if not element.lists:
            kind = np.dtype([(n, order + t) for n, t in element.scalars])
            n = min(element.count, (len(data) - at) // kind.itemsize)
            rows = np.frombuffer(data, kind, n, at)
            if element.name == "vertex":
                out.vertices = {name: rows[name].astype(float) for name, _ in element.scalars}
            at += n * kind.itemsize
        else:
            n, at, triangles = _lists(data, element, at, order)
            if element.name == "face":
                out.faces = triangles
        if n < element.count:
            out.rejects.append((n, f"{element.count - n} rows of {element.name} are missing"))


def _lists(data: memoryview, element: _Element, at: int, order: str) -> tuple[int, int, np.ndarray]:
    """(rows read, end, triangles of the first list) of an element with lists.

    Rows are taken in runs of equal list lengths, one array for each run."""
    scalars, lists = dict(element.scalars), {n: (c, v) for n, c, v in element.lists}
    done, triangles = 0, [np.empty((0, 3), np.int64)]
    while done < element.count:
        fields, end = [], at
        for name in element.order:
            if name in scalars:
                fields.append((name, order + scalars[name]))
            else:
                count, value = lists[name]
                width = np.dtype(count).itemsize
                if end + width > len(data):
                    return done, at, np.concatenate(triangles)
                k = int(np.frombuffer(data, order + count, 1, end)[0])
                fields += [(f"{name} count", order + count), (name, order + value, (k,))]
            end = at + np.dtype(fields).itemsize
        kind = np.dtype(fields)
        left = min(element.count - done, (len(data) - at) // kind.itemsize)
        if not left:
            return done, at, np.concatenate(triangles)
        rows = np.frombuffer(data, kind, left, at)
        same = np.ones(left, bool)
        for name in lists:
            same &= rows[f"{name} count"] == rows[f"{name} count"][0]
        run = left if same.all() else int(same.argmin())
        corners = rows[element.lists[0][0]][:run].astype(np.int64)
        for i in range(1, corners.shape[1] - 1):
            triangles.append(corners[:, [0, i, i + 1]])
        done, at = done + run, at + run * kind.itemsize
    return done, at, np.concatenate(triangles)


def read(data: bytes) -> Ply:
    """Parse one file; rows that cannot be read are listed in ``rejects``."""
    out = Ply()
    try:
        kind, elements, body, out.first = header(data)
        if kind == "ascii":
            _ascii(data[body:], elements, out)
        else:
            _binary(memoryview(data)[body:], elements, out, "<" if kind == "binary_little_endian" else ">")
    except (ValueError, KeyError, IndexError) as problem:
        out.rejects.append((-1, str(problem)))
    return out


def write(vertices: dict[str, np.ndarray], first: int = 0) -> bytes:
    """Vertices as a little-endian binary file; whole-number columns become ``uchar``."""
    n = len(next(iter(vertices.values()))) if vertices else 0
    kinds = {k: ("uchar", "u1") if v.dtype.kind in "iu" else ("double", "<f8") for k, v in vertices.items()}
    rows = np.empty(n, [(k, t) for k, (_, t) in kinds.items()])
    for k, v in vertices.items():
        rows[k] = v
    head = ["ply", "format binary_little_endian 1.0", f"comment first {first}", f"element vertex {n}", *[f"property {t} {k}" for k, (t, _) in kinds.items()], "end_header", ""]
    return "\n".join(head).encode() + rows.tobytes()
