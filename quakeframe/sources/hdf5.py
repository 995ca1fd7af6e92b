"""Gridded models in HDF5, and so in NetCDF-4: what the format says of a file, read as far as asked.

Superblocks 0 to 3, object headers 1 and 2, groups by symbol tables, by link messages and by dense links, attributes,
fixed and floating numbers, compact, contiguous and chunked data (chunks in a version 1 B-tree, single or implicit), and
the deflate, shuffle and checksum filters. Other chunk indexes, filters and types raise. Only the chunks that a box
touches are read: the B-tree is walked along the box.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, BinaryIO

import numpy as np

#: The format's signatures and its numbers of messages, filters and layouts.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
DATASPACE, LINK_INFO, DATATYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOLS, ATTRIBUTE_INFO = 0x01, 0x02, 0x03, 0x05, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11, 0x15
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
COMPACT, CONTIGUOUS, CHUNKED = 0, 1, 2
SINGLE, IMPLICIT = 1, 2


class Bytes:
    """Numbers read one after another from bytes."""

    def __init__(self, data: bytes, offsets: int = 8, lengths: int = 8) -> None:
        self.data, self.at, self.offsets, self.lengths = data, 0, offsets, lengths

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def offset(self) -> int | None:
        raw = self.take(self.offsets)
        return None if raw == b"\xff" * self.offsets else int.from_bytes(raw, "little")

    def length(self) -> int:
        return self.number(self.lengths)

    def pad(self, n: int = 8) -> None:
        self.at += -self.at % n


@dataclass
class Dataset:
    """What a dataset's header says."""

    shape: tuple[int, ...]
    dtype: np.dtype | None
    layout: int = CONTIGUOUS
    address: int | None = None
    data: bytes = b""
    chunk: tuple[int, ...] = ()
    index: int | None = None
    filters: list[tuple[int, list[int]]] = field(default_factory=list)
    single: tuple[int, int] | None = None
    fill: float | None = None
    attributes: dict[str, Any] = field(default_factory=dict)


class File:
    """An open HDF5 file."""

    def __init__(self, f: BinaryIO) -> None:
        self.f, self.base = f, 0
        at = 0
        while self._at(at, 8) != SIGNATURE:  # a block of the user's may stand before
            at = at * 2 or 512
            if at > 1 << 20:
                raise ValueError("not an HDF5 file")
        version = self._at(at + 8, 1)[0]
        if version < 2:
            self.offsets, self.lengths = self._at(at + 13, 2)
            b = self.bytes(self._at(at + 24 + 4 * version, 6 * 8 + 24))
            self.base = b.offset() or 0
            b.at += 3 * self.offsets + self.offsets
            self.root = b.offset()
        else:
            self.offsets, self.lengths = self._at(at + 9, 2)
            b = self.bytes(self._at(at + 12, 4 * 8))
            self.base = b.offset() or 0
            b.at += 2 * self.offsets
            self.root = b.offset()

    def _at(self, address: int, n: int) -> bytes:
        self.f.seek(self.base + address)
        return self.f.read(n)

    def bytes(self, data: bytes) -> Bytes:
        return Bytes(data, self.offsets, self.lengths)

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """Type and data of an object header's messages."""
        out: list[tuple[int, bytes]] = []
        if self._at(address, 4) == b"OHDR":
            flags = self._at(address + 5, 1)[0]
            start = address + 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            blocks = [(start + width, int.from_bytes(self._at(start, width), "little"))]
            head = lambda b: (b.number(1), b.number(2), b.number(1), b.take(2 if flags & 4 else 0))
            least = 4 + (2 if flags & 4 else 0)
        else:
            flags, size = None, int.from_bytes(self._at(address + 8, 4), "little")
            blocks = [(address + 16, size)]
            head = lambda b: (b.number(2), b.number(2), b.number(1), b.take(3))
            least = 8
        for start, size in blocks:  # grows
            b = self.bytes(self._at(start, size))
            while b.at + least <= size:
                kind, n, own, _ = head(b)
                data = b.take(n)
                if kind == CONTINUATION:
                    c = self.bytes(data)
                    to, room = c.offset(), c.length()
                    blocks.append((to, room) if flags is None else (to + 4, room - 8))  # a signature before, a checksum after
                elif own & 2:
                    raise ValueError("shared messages (named types) are not read")
                elif kind:
                    out.append((kind, data))
        return out

    def children(self, address: int) -> dict[str, int]:
        """Name and header of each object in a group."""
        out = {}
        for kind, data in self.messages(address):
            b = self.bytes(data)
            if kind == SYMBOLS:
                tree, heap = b.offset(), b.offset()
                h = self.bytes(self._at(heap + 8, 24))
                size, _, at = h.length(), h.length(), h.offset()
                names = self._at(at, size)
                for node in self._leaves(tree):
                    s = self.bytes(self._at(node, 8 + int.from_bytes(self._at(node + 6, 2), "little") * (2 * self.offsets + 24)))
                    s.at = 8
                    while s.at < len(s.data):
                        name, to = s.offset(), s.offset()
                        s.at += 24
                        out[names[name : names.index(b"\0", name)].decode()] = to
            elif kind == LINK:
                out |= self._link(data)
            elif kind == LINK_INFO:
                b.at = 2 + (8 if data[1] & 1 else 0)
                for link in self._dense(b.offset(), b.offset(), 4):
                    out |= self._link(link)
        return out

    def _link(self, data: bytes) -> dict[str, int]:
        b = self.bytes(data)
        flags = data[1]
        b.at = 2
        kind = b.number(1) if flags & 8 else 0
        b.at += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
        name = b.take(b.number(1 << (flags & 3))).decode()
        return {name: b.offset()} if kind == 0 else {}

    def _leaves(self, node: int) -> Iterator[int]:
        """Symbol nodes under a group's B-tree."""
        head = self.bytes(self._at(node, 8 + 2 * self.offsets))
        level, n = head.data[5], int.from_bytes(head.data[6:8], "little")
        b = self.bytes(self._at(node + 8 + 2 * self.offsets, n * (self.lengths + self.offsets)))
        for _ in range(n):
            b.length()
            child = b.offset()
            if level:
                yield from self._leaves(child)
            else:
                yield child

    def _dense(self, heap: int | None, tree: int | None, before: int) -> Iterator[bytes]:
        """Objects of a fractal heap that a version 2 B-tree lists; ``before``: bytes of a record before the object's id."""
        if heap is None or tree is None:
            return
        h = self.bytes(self._at(heap, 200))
        h.at = 5
        id_size, filters, flags, most = h.number(2), h.number(2), h.number(1), h.number(4)
        if filters:
            raise ValueError("a filtered heap is not read")
        h.at += 10 * self.lengths + 2 * self.offsets
        width, first, largest, bits, _ = h.number(2), h.length(), h.length(), h.number(2), h.number(2)
        root, rows = h.offset(), h.number(2)
        where, size = (bits + 7) // 8, 0
        while 1 << (8 * size) <= min(largest, most):
            size += 1

        def block(at: int) -> tuple[int, int]:
            """Address of the direct block that holds offset ``at`` of the heap, and the block's offset."""
            if not rows:
                return root, 0
            head = 5 + self.offsets + where
            start, entry = 0, 0
            for row in range(rows):
                span = first * (1 << max(0, row - 1))
                if span > largest:
                    raise ValueError("a heap of nested blocks is not read")
                if at < start + width * span:
                    k = (at - start) // span
                    return int.from_bytes(self._at(root + head + (entry + k) * self.offsets, self.offsets), "little"), start + k * span
                start, entry = start + width * span, entry + width
            raise ValueError("an object beyond its heap")

        for record in self._records(tree):
            b = Bytes(record[before : before + id_size])
            if b.number(1) & 0x30:
                raise ValueError("huge and tiny objects of a heap are not read")
            at, n = b.number(where), b.number(size)
            address, start = block(at)
            yield self._at(address + at - start, n)

    def _records(self, tree: int) -> Iterator[bytes]:
        """Records of a version 2 B-tree."""
        b = self.bytes(self._at(tree, 64))
        b.at = 6
        node, size, depth, _ = b.number(4), b.number(2), b.number(2), b.number(2)
        root, n = b.offset(), b.number(2)
        if root is None or not n:
            return
        if depth:
            raise ValueError("a B-tree of several levels is not read")
        data = self._at(root + 6, n * size)
        yield from (data[k * size : (k + 1) * size] for k in range(n))

    def find(self, path: str) -> int | None:
        """The header of an object by its path."""
        at: int | None = self.root
        for name in path.strip("/").split("/"):
            at = self.children(at).get(name) if at is not None else None
        return at

    def dataset(self, address: int) -> Dataset:
        """What the header at ``address`` says of a dataset; groups have no shape and raise."""
        found = self.messages(address)
        of = dict(found)
        if DATASPACE not in of or LAYOUT not in of:
            raise ValueError("not a dataset")
        out = Dataset(_shape(self.bytes(of[DATASPACE])), _dtype(of[DATATYPE]))
        self._layout(self.bytes(of[LAYOUT]), out)
        if FILTERS in of:
            out.filters = _filters(of[FILTERS])
        if FILL in of and out.dtype is not None:
            out.fill = _fill(of[FILL], out.dtype)
        out.attributes = self.attributes(found)
        return out

    def _layout(self, b: Bytes, out: Dataset) -> None:
        version, out.layout = b.number(1), b.number(1)
        if version not in (3, 4) or out.layout > CHUNKED:
            raise ValueError(f"layout {out.layout} of version {version} is not read")
        if out.layout == COMPACT:
            out.data = b.take(b.number(2))
        elif out.layout == CONTIGUOUS:
            out.address = b.offset()
        elif version == 3:
            rank = b.number(1)
            out.address = b.offset()
            out.chunk = tuple(b.number(4) for _ in range(rank))[:-1]
        else:
            flags, rank, width = b.number(1), b.number(1), b.number(1)
            out.chunk = tuple(b.number(width) for _ in range(rank))[:-1]
            out.index = b.number(1)
            if out.index not in (SINGLE, IMPLICIT):
                raise ValueError(f"chunk index {out.index} is not read")
            if flags & 2 and out.index == SINGLE:
                out.single = (b.length(), b.number(4))
            out.address = b.offset()

    def attributes(self, messages: list[tuple[int, bytes]]) -> dict[str, Any]:
        out = {}
        for kind, data in messages:
            if kind == ATTRIBUTE:
                out |= self._attribute(data)
            elif kind == ATTRIBUTE_INFO:
                b = self.bytes(data)
                b.at = 2 + (2 if data[1] & 1 else 0)
                for each in self._dense(b.offset(), b.offset(), 0):
                    out |= self._attribute(each)
        return out

    def _attribute(self, data: bytes) -> dict[str, Any]:
        """Name and value of an attribute: numbers, text, or the objects that it refers to."""
        b = self.bytes(data)
        version = b.number(1)
        b.at = 2
        sizes = [b.number(2) for _ in range(3)]
        b.at += version == 3
        parts = []
        for n in sizes:
            parts.append(b.take(n))
            if version == 1:
                b.pad()
        name, shape = parts[0].rstrip(b"\0").decode(), _shape(self.bytes(parts[2]))
        count, kind = int(np.prod(shape, dtype=np.int64)), parts[1][0] & 15
        if kind == 3:
            return {name: b.take(int.from_bytes(parts[1][4:8], "little")).rstrip(b"\0").decode("utf-8", "replace")}
        if kind == 9:  # lists, of references where they name dimensions
            return {name: [self._heap_object(b.number(4), b.offset(), b.number(4)) for _ in range(count)]} if parts[1][1] & 15 == 0 else {}
        dtype = _dtype(parts[1])
        return {} if dtype is None else {name: np.frombuffer(b.take(count * dtype.itemsize), dtype).tolist()}

    def _heap_object(self, n: int, collection: int | None, index: int) -> int | None:
        """The first address in an object of the global heap."""
        if not n or collection is None:
            return None
        size = int.from_bytes(self._at(collection + 8, self.lengths), "little")
        b = self.bytes(self._at(collection, size))
        b.at = 8 + self.lengths
        while b.at < size:
            k = b.number(2)
            b.at += 6
            room = b.length()
            if k == index:
                return b.offset()
            if not k:
                break
            b.at += room + -room % 8
        return None

    def read(self, d: Dataset, start: tuple[int, ...], stop: tuple[int, ...]) -> np.ndarray:
        """The values of a box, as the file has them; what was never written is the fill value."""
        if d.dtype is None:
            raise ValueError("only numbers are read")
        out = np.full([z - a for a, z in zip(start, stop, strict=True)], 0 if d.fill is None else d.fill, dtype=d.dtype)
        if d.layout == COMPACT:
            whole = np.frombuffer(d.data, d.dtype, count=int(np.prod(d.shape, dtype=np.int64))).reshape(d.shape)
            return whole[tuple(slice(a, z) for a, z in zip(start, stop, strict=True))]
        if d.layout == CONTIGUOUS:
            if d.address is not None and out.size:
                slab = int(np.prod(d.shape[1:], dtype=np.int64))
                rows = self._at(d.address + start[0] * slab * d.dtype.itemsize, (stop[0] - start[0]) * slab * d.dtype.itemsize)
                whole = np.frombuffer(rows, d.dtype).reshape(stop[0] - start[0], *d.shape[1:])
                out[...] = whole[(slice(None), *(slice(a, z) for a, z in zip(start[1:], stop[1:], strict=True)))]
            return out
        for corner, address, size, mask in self._chunks(d, start, stop):
            values = np.frombuffer(_unfiltered(self._at(address, size), d, mask), d.dtype, count=int(np.prod(d.chunk))).reshape(d.chunk)
            lo = [max(a, c) for a, c in zip(start, corner, strict=True)]
            hi = [min(z, c + n) for z, c, n in zip(stop, corner, d.chunk, strict=True)]
            if all(a < z for a, z in zip(lo, hi, strict=True)):
                into = tuple(slice(a - s, z - s) for a, z, s in zip(lo, hi, start, strict=True))
                out[into] = values[tuple(slice(a - c, z - c) for a, z, c in zip(lo, hi, corner, strict=True))]
        return out

    def _chunks(self, d: Dataset, start: tuple[int, ...], stop: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """Corner, address, stored bytes and filter mask of the chunks that a box touches."""
        if d.address is None:
            return
        size = int(np.prod(d.chunk)) * d.dtype.itemsize
        if d.index == SINGLE:
            n, mask = d.single or (size, 0)
            yield (0,) * len(d.shape), d.address, n, mask
        elif d.index == IMPLICIT:
            grid = [-(-n // c) for n, c in zip(d.shape, d.chunk, strict=True)]
            for k in np.ndindex(*[-(-z // c) - a // c for a, z, c in zip(start, stop, d.chunk, strict=True)]):
                at = [a // c + i for a, c, i in zip(start, d.chunk, k, strict=True)]
                yield tuple(i * c for i, c in zip(at, d.chunk, strict=True)), d.address + size * int(np.ravel_multi_index(at, grid)), size, 0
        else:
            yield from self._chunk_tree(d, d.address, start, stop)

    def _chunk_tree(self, d: Dataset, node: int, start: tuple[int, ...], stop: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        rank = len(d.shape)
        level, n = self._at(node + 5, 1)[0], int.from_bytes(self._at(node + 6, 2), "little")
        key = 8 + 8 * (rank + 1)
        b = self.bytes(self._at(node + 8 + 2 * self.offsets, n * (key + self.offsets) + key))
        keys, to = [], []
        for k in range(n + 1):
            size, mask = b.number(4), b.number(4)
            keys.append((size, mask, tuple(b.number(8) for _ in range(rank + 1))[:-1]))
            if k < n:
                to.append(b.offset())
        for k in range(n):
            size, mask, corner = keys[k]
            if corner[0] >= stop[0] or keys[k + 1][2][0] + d.chunk[0] <= start[0]:
                continue  # keys ascend along the first dimension
            if level:
                yield from self._chunk_tree(d, to[k], start, stop)
            elif all(c < z and c + n > a for c, z, a, n in zip(corner, stop, start, d.chunk, strict=True)):
                yield corner, to[k], size, mask


def _shape(b: Bytes) -> tuple[int, ...]:
    version, rank = b.number(1), b.number(1)
    b.at = 8 if version == 1 else 4
    return tuple(b.length() for _ in range(rank))


def _dtype(data: bytes) -> np.dtype | None:
    """Fixed and floating numbers in either byte order, and references as numbers; None for other types."""
    kind, bits, size = data[0] & 15, data[1], int.from_bytes(data[4:8], "little")
    order = ">" if bits & 1 else "<"
    if kind == 0:
        return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
    if kind == 1 and size in (2, 4, 8):
        return np.dtype(f"{order}f{size}")
    return None


def _fill(data: bytes, dtype: np.dtype) -> float | None:
    b = Bytes(data)
    version = b.number(1)
    defined = bool(data[1] & 0x20) if version == 3 else bool(data[3])
    b.at = 2 if version == 3 else 4
    if not defined:
        return None
    n = b.number(4)
    return np.frombuffer(b.take(n), dtype)[0] if n == dtype.itemsize else None


def _filters(data: bytes) -> list[tuple[int, list[int]]]:
    """Id and numbers of each filter, in the order of writing."""
    b, out = Bytes(data), []
    version, n = b.number(1), b.number(1)
    b.at = 8 if version == 1 else 2
    for _ in range(n):
        kind = b.number(2)
        name = b.number(2) if version == 1 or kind >= 256 else 0
        b.number(2)
        count = b.number(2)
        b.take(name + (-name % 8 if version == 1 else 0))
        out.append((kind, [b.number(4) for _ in range(count)]))
        if version == 1 and count % 2:
            b.at += 4
    return out


def _unfiltered(data: bytes, d: Dataset, mask: int) -> bytes:
    """A chunk's bytes with its filters undone, last first; ``mask`` has the bits of those that were left out."""
    for k, (kind, numbers) in reversed(list(enumerate(d.filters))):
        if mask >> k & 1:
            continue
        if kind == DEFLATE:
            data = zlib.decompress(data)
        elif kind == SHUFFLE:
            size = numbers[0] if numbers else d.dtype.itemsize
            data = np.frombuffer(data, np.uint8).reshape(size, -1).T.tobytes()
        elif kind == CHECKSUM:
            data = data[:-4]
        else:
            raise ValueError(f"filter {kind} is not read")
    return data


def missing_of(d: Dataset) -> list[float]:
    """Values that mean a missing one, by attribute or by fill value."""
    named = [x for key in ("_FillValue", "missing_value") for x in np.atleast_1d(d.attributes.get(key, [])).tolist() if not isinstance(x, str)]
    return named + ([] if d.fill is None or d.fill == 0 else [float(d.fill)])
