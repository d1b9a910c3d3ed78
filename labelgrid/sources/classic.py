"""Codec of the NetCDF classic format (CDF-1 and CDF-2), from its public specification."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: list tags, external types and their sizes.
TAG_DIM, TAG_VAR, TAG_ATT = 10, 11, 12
NC_CHAR, NC_DOUBLE = 2, 6
NUMERIC = {1: ">i1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


class FormatError(ValueError):
    """The bytes are no readable classic file."""


@dataclass
class Variable:
    name: str
    dims: list[str]
    shape: list[int]
    kind: int
    begin: int
    attrs: dict = field(default_factory=dict)
    record: bool = False

    @property
    def dtype(self) -> np.dtype:
        if self.kind not in NUMERIC:
            raise FormatError(f"{self.name} isn't numeric")
        return np.dtype(NUMERIC[self.kind])


@dataclass
class Header:
    dims: dict[str, int]
    variables: dict[str, Variable]
    records: int
    stride: int  # bytes from one record to the next


class _Reader:
    """A cursor over a stream that supports seek and read."""

    def __init__(self, stream):
        self.s = stream

    def take(self, n: int) -> bytes:
        got = self.s.read(n)
        if len(got) != n:
            raise FormatError("truncated")
        return bytes(got)

    def u4(self) -> int:
        return struct.unpack(">I", self.take(4))[0]

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def text(self) -> str:
        return self.padded(self.u4()).decode("utf-8")

    def items(self, tag: int) -> int:
        found, n = self.u4(), self.u4()
        if found not in (0, tag) or (found == 0 and n):
            raise FormatError("unexpected list")
        return n

    def attrs(self) -> dict:
        out = {}
        for _ in range(self.items(TAG_ATT)):
            name, kind, n = self.text(), self.u4(), self.u4()
            if kind == NC_CHAR:
                out[name] = self.padded(n).decode("utf-8", "replace")
            elif kind in NUMERIC:
                out[name] = np.frombuffer(self.padded(n * np.dtype(NUMERIC[kind]).itemsize), NUMERIC[kind]).tolist()
            else:
                raise FormatError("unknown attribute type")
        return out


def read_header(stream) -> Header:
    r = _Reader(stream)
    magic = r.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2):
        raise FormatError("no classic file")
    records = r.u4()
    names, lengths = [], []
    for _ in range(r.items(TAG_DIM)):
        names.append(r.text())
        lengths.append(r.u4())
    r.attrs()
    if records == 0xFFFFFFFF:
        raise FormatError("streaming record count")
    variables: dict[str, Variable] = {}
    sizes: list[int] = []
    for _ in range(r.items(TAG_VAR)):
        name = r.text()
        ids = [r.u4() for _ in range(r.u4())]
        if any(i >= len(names) for i in ids):
            raise FormatError("unknown dimension")
        attrs, kind, vsize = r.attrs(), r.u4(), r.u4()
        begin = r.u4() if magic[3] == 1 else struct.unpack(">Q", r.take(8))[0]
        record = bool(ids) and lengths[ids[0]] == 0
        shape = [records if k == 0 and record else lengths[i] for k, i in enumerate(ids)]
        variables[name] = Variable(name, [names[i] for i in ids], shape, kind, begin, attrs, record)
        if record:
            sizes.append(vsize)
    if len(sizes) == 1:  # a lone record variable is not padded
        only = next(v for v in variables.values() if v.record)
        width = np.dtype(NUMERIC[only.kind]).itemsize if only.kind in NUMERIC else 1
        sizes = [int(np.prod(only.shape[1:], dtype="int64")) * width]
    return Header({n: records if not k else k for n, k in zip(names, lengths)}, variables, records, sum(sizes))


def read_cells(stream, header: Header, name: str, first: int, count: int) -> np.ndarray:
    """Cells ``first .. first+count`` in file order (the slowest dimension first), as float64."""
    v = header.variables[name]
    size = v.dtype.itemsize
    if not v.record:
        stream.seek(v.begin + first * size)
        return np.frombuffer(_Reader(stream).take(count * size), v.dtype).astype("f8")
    inner, parts = int(np.prod(v.shape[1:], dtype="int64")), []
    while count:
        record, skip = divmod(first, inner)
        n = min(count, inner - skip)
        stream.seek(v.begin + record * header.stride + skip * size)
        parts.append(np.frombuffer(_Reader(stream).take(n * size), v.dtype).astype("f8"))
        first, count = first + n, count - n
    return np.concatenate(parts) if parts else np.empty(0)


def end_of(header: Header, name: str) -> int:
    """Where a variable's data end in the file."""
    v = header.variables[name]
    cells = int(np.prod(v.shape[1:] if v.record else v.shape, dtype="int64")) * v.dtype.itemsize
    return v.begin + (max(0, v.shape[0] - 1) * header.stride + (cells if v.shape[0] else 0) if v.record else cells)


def _name(text: str) -> bytes:
    raw = text.encode("utf-8")
    return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def build_header(name: str, dims: list[str], shape: list[int], attrs: dict[str, str], coords: list[str]) -> tuple[bytes, dict[str, int]]:
    """Header for one float64 variable and its coordinates, and where each one's data begin.

    ``dims``/``shape`` are in array order (the fastest first); the file lists them reversed.
    An extent of 0 becomes the record dimension and must then be the slowest.
    """
    if 0 in shape[:-1]:
        raise FormatError("only the slowest dimension may be empty")
    ids = {d: k for k, d in enumerate(dims)}
    specs = [(d, [ids[d]], {}, shape[ids[d]]) for d in dims if d in coords]
    specs.append((name, [ids[d] for d in reversed(dims)], attrs, int(np.prod(shape, dtype="int64"))))
    for version in (1, 2):
        begins: dict[str, int] = {}
        at = 0
        for final in (False, True):
            out = [b"CDF" + bytes([version]), struct.pack(">I", 0)]
            out.append(struct.pack(">II", TAG_DIM if dims else 0, len(dims)))
            out += [_name(d) + struct.pack(">I", n) for d, n in zip(dims, shape)]
            out.append(struct.pack(">II", 0, 0))
            out.append(struct.pack(">II", TAG_VAR, len(specs)))
            for var, where, texts, cells in specs:
                out.append(_name(var) + struct.pack(">I", len(where)) + b"".join(struct.pack(">I", i) for i in where))
                out.append(struct.pack(">II", TAG_ATT if texts else 0, len(texts)))
                for k, text in texts.items():
                    out.append(_name(k) + struct.pack(">I", NC_CHAR) + _name(text))
                out.append(struct.pack(">II", NC_DOUBLE, min(cells * 8, 0xFFFFFFFC)))
                out.append(struct.pack(">I" if version == 1 else ">Q", begins.get(var, 0)))
            raw = b"".join(out)
            if not final:
                at = len(raw)
                for var, _, _, cells in specs:
                    begins[var], at = at, at + cells * 8
        if version == 2 or at < 2**31:
            return raw, begins
        begins.clear()
    raise FormatError("unreachable")
