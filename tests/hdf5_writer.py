"""Small HDF5 files for the tests of the reader, put together from the format's description."""

from __future__ import annotations

import struct
import zlib

import numpy as np

NONE = b"\xff" * 8


class Writer:
    """Grows a file; each method returns the address of what it wrote."""

    def __init__(self, new: bool) -> None:
        self.new, self.data = new, bytearray(48 if new else 96)

    def put(self, raw: bytes) -> int:
        self.data += b"\0" * (-len(self.data) % 8)
        self.data += raw
        return len(self.data) - len(raw)

    def header(self, messages: list[tuple[int, bytes]], split: bool = False) -> int:
        """An object header of either version; ``split`` puts all messages but the first into a continuation."""
        if self.new:
            pack = lambda ms: b"".join(struct.pack("<BHB", k, len(d), 0) + d for k, d in ms)
        else:
            messages = [(k, d + b"\0" * (-len(d) % 8)) for k, d in messages]
            pack = lambda ms: b"".join(struct.pack("<HHB3x", k, len(d), 0) + d for k, d in ms)
        body = pack(messages)
        if split:
            rest = pack(messages[1:])
            at = self.put(b"OCHK" + rest + b"\0" * 4) if self.new else self.put(rest)
            body = pack([messages[0], (0x10, struct.pack("<QQ", at, len(rest) + (8 if self.new else 0)))])
        if self.new:
            return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + b"\0" * 4)
        return self.put(struct.pack("<BxHII4x", 1, len(messages) + split, 1, len(body)) + body)

    def group(self, members: dict[str, int], dense: bool = False) -> int:
        if not self.new:
            names, at = b"\0" * 8, {}
            for n in members:
                at[n] = len(names)
                names += n.encode() + b"\0" * (8 - len(n) % 8)
            heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, self.put(names)))
            order = sorted(members)
            snod = self.put(b"SNOD" + struct.pack("<BxH", 1, len(order)) + b"".join(struct.pack("<QQI4x16x", at[n], members[n], 0) for n in order))
            tree = self.put(b"TREE" + struct.pack("<BBH", 0, 0, 1) + NONE * 2 + struct.pack("<QQQ", 0, snod, at[order[-1]]))
            return self.header([(0x11, struct.pack("<QQ", tree, heap))])
        links = [struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", to) for n, to in members.items()]
        if not dense:
            return self.header([(0x06, x) for x in links])
        head = b"FHDB" + struct.pack("<BQ", 0, 0) + b"\0" * 4
        ids, body = [], head
        for x in links:
            ids.append(struct.pack("<BIH", 0, len(body), len(x)))
            body += x
        block = self.put(body.ljust(512, b"\0"))
        heap = self.put(b"FRHP" + struct.pack("<BHHBI", 0, 7, 0, 0, 4096) + b"\0" * 8 + NONE + b"\0" * 8 + NONE + b"\0" * 64 + struct.pack("<HQQHHQH", 4, 512, 65536, 32, 1, block, 0) + b"\0" * 4)
        leaf = self.put(b"BTLF" + struct.pack("<BB", 0, 5) + b"".join(b"\0" * 4 + i for i in ids) + b"\0" * 4)
        tree = self.put(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, 5, 512, 11, 0, 100, 40, leaf, len(ids), len(ids)) + b"\0" * 4)
        return self.header([(0x02, struct.pack("<BB", 0, 0) + struct.pack("<QQ", heap, tree))])

    def attribute(self, name: str, dtype: bytes, count: int | None, raw: bytes) -> bytes:
        space = struct.pack("<BBBB", 2, 0 if count is None else 1, 0, 0 if count is None else 1) + (b"" if count is None else struct.pack("<Q", count))
        return struct.pack("<BBHHHB", 3, 0, len(name) + 1, len(dtype), len(space), 0) + name.encode() + b"\0" + dtype + space + raw

    def dataset(self, x: np.ndarray, chunk: tuple[int, ...] | None = None, filters: tuple[int, ...] = (), fill: float | None = None, scales: list[int] | None = None, skip: tuple = (), leaf: int = 3, missing: float | None = None, split: bool = False, single: bool = False) -> int:
        kind = datatype(x.dtype)
        space = struct.pack("<BBB5x", 1, x.ndim, 0) + struct.pack(f"<{x.ndim}Q", *x.shape)
        out = [(0x01, space), (0x03, kind)]
        if fill is not None:
            out.append((0x05, struct.pack("<BBI", 3, 0x20, x.itemsize) + x.dtype.type(fill).astype(x.dtype).tobytes()))
        if chunk is None:
            at = self.put(x.tobytes())
            out.append((0x08, struct.pack("<BBQQ", 3, 1, at, x.nbytes)))
        else:
            stored = []
            for k in np.ndindex(*[-(-n // c) for n, c in zip(x.shape, chunk, strict=True)]):
                if k in skip:
                    continue
                corner = [i * c for i, c in zip(k, chunk, strict=True)]
                whole = np.zeros(chunk, x.dtype)
                part = x[tuple(slice(a, a + c) for a, c in zip(corner, chunk, strict=True))]
                whole[tuple(slice(0, n) for n in part.shape)] = part
                raw = whole.tobytes()
                for f in filters:
                    if f == 1:
                        raw = zlib.compress(raw)
                    elif f == 2:
                        raw = np.frombuffer(raw, np.uint8).reshape(-1, x.itemsize).T.tobytes()
                    else:
                        raw += b"\0" * 4
                stored.append((corner, len(raw), self.put(raw)))
            if single:
                out.append((0x08, struct.pack("<BBBBB", 4, 2, 0, x.ndim + 1, 4) + struct.pack(f"<{x.ndim + 1}I", *chunk, x.itemsize) + struct.pack("<BQ", 1, stored[0][2])))
            else:
                out.append((0x08, struct.pack("<BBBQ", 3, 2, x.ndim + 1, self.tree(stored, x, chunk, leaf)) + struct.pack(f"<{x.ndim + 1}I", *chunk, x.itemsize)))
            if filters:
                out.append((0x0B, struct.pack("<BB", 2, len(filters)) + b"".join(struct.pack("<HHH", f, 0, f != 3) + (struct.pack("<I", x.itemsize if f == 2 else 6) if f != 3 else b"") for f in filters)))
        if scales is not None:
            heap_objects = b"".join(struct.pack("<HH4xQQ", k + 1, 1, 8, to) for k, to in enumerate(scales))
            heap = self.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(heap_objects)) + heap_objects)
            vlen = struct.pack("<BBBBI", 0x19, 0, 0, 0, 16) + struct.pack("<BBBBI", 0x17, 0, 0, 0, 8)
            out.append((0x0C, self.attribute("DIMENSION_LIST", vlen, len(scales), b"".join(struct.pack("<IQI", 1, heap, k + 1) for k in range(len(scales))))))
        if missing is not None:
            out.append((0x0C, self.attribute("missing_value", kind, 1, x.dtype.type(missing).astype(x.dtype).tobytes())))
        return self.header(out, split)

    def tree(self, stored: list, x: np.ndarray, chunk: tuple[int, ...], leaf: int) -> int:
        """A B-tree of chunks with ``leaf`` entries in a node."""
        key = lambda corner, size: struct.pack("<II", size, 0) + struct.pack(f"<{x.ndim + 1}Q", *corner, 0)
        end = [(-(-n // c)) * c for n, c in zip(x.shape, chunk, strict=True)]
        level, rows = 0, stored
        while True:
            nodes = []
            for k in range(0, len(rows), leaf):
                some = rows[k : k + leaf]
                after = rows[k + leaf][0] if k + leaf < len(rows) else end
                raw = b"".join(key(c, n) + struct.pack("<Q", at) for c, n, at in some) + key(after, 0)
                nodes.append((some[0][0], 0, self.put(b"TREE" + struct.pack("<BBH", 1, level, len(some)) + NONE * 2 + raw)))
            if len(nodes) <= 1:
                return nodes[0][2]
            level, rows = level + 1, nodes

    def finish(self, root: int) -> bytes:
        if self.new:
            head = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBB", 2, 8, 8, 0) + struct.pack("<Q", 0) + NONE + struct.pack("<QQ", len(self.data), root) + b"\0" * 4
        else:
            head = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBBBBB", 0, 0, 0, 0, 0, 8, 8, 0) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<Q", 0) + NONE + struct.pack("<Q", len(self.data)) + NONE + struct.pack("<QQI4x16x", 0, root, 0)
        self.data[: len(head)] = head
        return bytes(self.data)


def datatype(dtype: np.dtype) -> bytes:
    big = dtype.byteorder == ">"
    if dtype.kind == "f":
        exponent = {4: (31, 23, 8, 0, 23, 127), 8: (63, 52, 11, 0, 52, 1023)}[dtype.itemsize]
        return struct.pack("<BBBBI", 0x11, 0x20 | big, exponent[0], 0, dtype.itemsize) + struct.pack("<HHBBBBI", 0, 8 * dtype.itemsize, exponent[1], exponent[2], exponent[3], exponent[4], exponent[5])
    return struct.pack("<BBBBIHH", 0x10, big | (8 if dtype.kind == "i" else 0), 0, 0, dtype.itemsize, 0, 8 * dtype.itemsize)
