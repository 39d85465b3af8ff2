"""Merge Parquet files by copying encoded column blocks and rewriting the footer.

Row groups are copied as bytes; no page is decoded or decompressed. Only the
footer (Thrift compact protocol, public format) is parsed: the offsets of each
column chunk are moved to the new file, row totals are added up, and page
indexes and Bloom filters, which lie outside the copied blocks, are dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

MAGIC = b"PAR1"
# Types of the Thrift compact protocol.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)


def _varint(d: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = d[i]
        i += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, i
        shift += 7


def _value(d: bytes, i: int, kind: int) -> tuple:
    """(value, place behind it) of one value of a container or field."""
    if I16 <= kind <= I64:
        n, i = (d[i], i + 1) if d[i] < 0x80 else _varint(d, i)
        return (n >> 1) ^ -(n & 1), i
    if kind == BINARY:
        n, i = (d[i], i + 1) if d[i] < 0x80 else _varint(d, i)
        return d[i : i + n], i + n
    if kind == STRUCT:
        return _struct(d, i, {}, 0)
    if kind in (LIST, SET):
        size, inner = d[i] >> 4, d[i] & 0x0F
        i += 1
        if size == 15:
            size, i = _varint(d, i)
        items = []
        for _ in range(size):
            v, i = _value(d, i, inner)
            items.append(v)
        return [inner, items], i
    if kind in (TRUE, FALSE):
        return d[i] == TRUE, i + 1  # only inside containers
    if kind == BYTE:
        return d[i : i + 1], i + 1
    if kind == DOUBLE:
        return d[i : i + 8], i + 8
    if kind == MAP:
        size, i = _varint(d, i)
        kinds, i = (d[i], i + 1) if size else (0, i)
        pairs = []
        for _ in range(size):
            k, i = _value(d, i, kinds >> 4)
            v, i = _value(d, i, kinds & 0x0F)
            pairs.append((k, v))
        return [kinds, pairs], i
    raise ValueError(f"unknown Thrift type {kind}")


def _struct(d: bytes, i: int, out: dict[int, list], last: int) -> tuple[dict[int, list], int]:
    """{field id: [type, value]} and the place behind; ``out`` and ``last`` take up a struct whose first fields are known."""
    while True:
        head = d[i]
        i += 1
        if not head:
            return out, i
        kind = head & 0x0F
        if head >> 4:
            last += head >> 4
        else:
            last, i = _value(d, i, I16)
        if kind <= FALSE:
            out[last] = [kind, kind == TRUE]
        else:
            v, i = _value(d, i, kind)
            out[last] = [kind, v]


def _put_varint(out: bytearray, n: int) -> None:
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def _put(out: bytearray, kind: int, v) -> None:
    if I16 <= kind <= I64:
        n = (v << 1) ^ (v >> 63)
        if n < 0x80:
            out.append(n)
        else:
            _put_varint(out, n)
    elif kind == BINARY:
        _put_varint(out, len(v))
        out += v
    elif kind == STRUCT:
        _put_struct(out, v)
    elif kind in (LIST, SET):
        inner, items = v
        if len(items) < 15:
            out.append(len(items) << 4 | inner)
        else:
            out.append(0xF0 | inner)
            _put_varint(out, len(items))
        for x in items:
            _put(out, inner, x)
    elif kind in (TRUE, FALSE):
        out.append(TRUE if v else FALSE)
    elif kind in (BYTE, DOUBLE):
        out += v
    elif kind == MAP:
        kinds, items = v
        _put_varint(out, len(items))
        if items:
            out.append(kinds)
        for a, b in items:
            _put(out, kinds >> 4, a)
            _put(out, kinds & 0x0F, b)
    else:
        raise ValueError(f"unknown Thrift type {kind}")


def _put_struct(out: bytearray, s: dict[int, list]) -> None:
    last = 0
    for k in sorted(s):
        kind, v = s[k]
        if kind <= FALSE:
            kind = TRUE if v else FALSE
        if 0 < k - last <= 15:
            out.append((k - last) << 4 | kind)
        else:
            out.append(kind)
            _put(out, I16, k)
        if kind > FALSE:
            _put(out, kind, v)
        last = k
    out.append(0)


def _encode_struct(s: dict[int, list]) -> bytes:
    out = bytearray()
    _put_struct(out, s)
    return bytes(out)


class SchemaMismatch(ValueError):
    """Blocks of these files can't share a file."""


class BlockMismatch(ValueError):
    """Totals after a merge differ from the totals before."""


TAIL = 64 << 10  # read at once for the footer; a longer one takes a second read


class _Bytes:
    """A file that lies in memory."""

    def __init__(self, data: bytes):
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def read_at(self, n: int, at: int) -> bytes:
        return self.data[at : at + n]


def footer_bytes(file) -> tuple[bytes, int]:
    """The raw footer of a file with ``size`` and ``read_at``, and where it starts."""
    size = file.size()
    n = min(TAIL, size)
    tail = file.read_at(n, size - n)
    if n < 12 or tail[-4:] != MAGIC:
        raise ValueError("not a Parquet file with a plain footer")
    length = struct.unpack("<i", tail[-8:-4])[0]
    if length <= 0 or length + 8 > size:
        raise ValueError("the footer isn't in the file")
    start = size - 8 - length
    return (tail[-8 - length : -8] if length + 8 <= n else file.read_at(length, start)), start


class FooterReader:
    """Parses footers; the version and schema in front, equal in files of one writer, are parsed once."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[dict[int, list], dict[bytes, bytes]]] = {}

    def read(self, raw: bytes) -> tuple[dict[int, list], bytes]:
        """(FileMetaData, signature of schema and column orders)"""
        for front, (fields, signatures) in self.known.items():
            if raw.startswith(front):
                footer = _struct(raw, len(front), dict(fields), 2)[0]
                break
        else:
            fields, front, signatures = {}, b"", {}
            if raw[:1] == b"\x15" and raw[1] < 0x80 and raw[2] == 0x19:  # a version of one byte and the schema in front: the usual order
                fields[1] = [I32, _value(raw, 1, I32)[0]]
                schema, at = _value(raw, 3, LIST)
                fields[2], front = [LIST, schema], raw[:at]
                footer = _struct(raw, at, dict(fields), 2)[0]
                self.known[front] = (fields, signatures)
            else:
                footer = _struct(raw, 0, {}, 0)[0]
        orders = repr(footer.get(7)).encode()
        if orders not in signatures:
            signatures[orders] = schema_signature(footer)
        return footer, signatures[orders]


def read_footer(data: bytes) -> dict[int, list]:
    """FileMetaData of a whole file, or of its tail that holds the footer."""
    return _struct(footer_bytes(_Bytes(data))[0], 0, {}, 0)[0]


def schema_signature(footer: dict[int, list]) -> bytes:
    """Bytes that are equal exactly for equal schemas and column orders."""
    return _encode_struct({k: footer[k] for k in (2, 7) if k in footer})


@dataclass
class Merged:
    data: bytes | None
    files: int
    blocks: int
    rows: int
    size: int
    footer: bytes = b""


def _i64(v: int) -> list:
    return [I64, v]


CHUNK = 8 << 20


class BlockCopier:
    """Takes files one after the other and gives one file with all their row groups.

    With a ``sink`` (an object with ``write``) blocks go there as they are copied, in
    pieces of CHUNK bytes, so memory holds footers only; without, the file is kept.
    """

    def __init__(self, sink=None, reader: FooterReader | None = None) -> None:
        self.parts: list[bytes] | None = None if sink is not None else []
        self.write = sink.write if sink is not None else self.parts.append
        self.reader = reader or FooterReader()
        self.write(MAGIC)
        self.size = 4
        self.groups: list[dict[int, list]] = []
        self.first: dict[int, list] | None = None
        self.signature = b""
        self.files = self.rows = 0

    def add(self, data: bytes) -> None:
        self.add_file(_Bytes(data))

    def add_file(self, file, raw: bytes | None = None, end: int = 0) -> None:
        """A file with ``size`` and ``read_at``; its raw footer and start may be given if they were read before."""
        if raw is None:
            raw, end = footer_bytes(file)
        footer, signature = self.reader.read(raw)
        if 8 in footer:
            raise ValueError("encrypted files can't be merged")
        if self.first is None:
            self.first, self.signature = footer, signature
        elif signature != self.signature:
            raise SchemaMismatch("schema differs from that of the files before")
        rows = 0
        for group in footer[4][1][1]:
            if not group[3][1]:
                continue  # a row group without rows has no blocks
            start = self.size
            for column in group[1][1][1]:
                if 1 in column:
                    raise ValueError("column chunks in other files can't be copied")
                meta = column[3][1]
                at = meta[9][1]
                if 11 in meta and 0 < meta[11][1] < at:
                    at = meta[11][1]
                length = meta[7][1]
                if at < 4 or at + length > end:
                    raise BlockMismatch("a column block lies outside its file")
                moved = self.size - at
                for piece in range(0, length, CHUNK):
                    n = min(CHUNK, length - piece)
                    data = file.read_at(n, at + piece)
                    if len(data) != n:
                        raise BlockMismatch("a column block is cut off")
                    self.write(data)
                self.size += length
                for k in (9, 10, 11):
                    if k in meta:
                        meta[k][1] = meta[k][1] + moved if meta[k][1] > 0 else meta[k][1]
                for k in (14, 15):
                    meta.pop(k, None)
                for k in (4, 5, 6, 7):
                    column.pop(k, None)
                column[2] = _i64(0)
            if 5 in group:
                group[5] = _i64(start)
            group[7] = [I16, len(self.groups) & 0x7FFF]
            rows += group[3][1]
            self.groups.append(group)
        if rows != footer[3][1]:
            raise BlockMismatch("row groups don't add up to the file's rows")
        self.files += 1
        self.rows += rows

    def finish(self) -> Merged:
        """Write the new footer and validate it against what was copied."""
        if self.first is None:
            raise ValueError("no file to merge")
        footer = dict(self.first)
        footer[3] = _i64(self.rows)
        footer[4] = [LIST, [STRUCT, self.groups]]
        raw = _encode_struct(footer)
        self.write(raw + struct.pack("<i", len(raw)) + MAGIC)
        check_totals(raw, self.signature, len(self.groups), self.rows, self.size, self.reader)
        return Merged(b"".join(self.parts) if self.parts is not None else None, self.files, len(self.groups), self.rows, self.size + len(raw) + 8, raw)


def check_totals(raw: bytes, signature: bytes, blocks: int, rows: int, end: int, reader: FooterReader) -> None:
    """Parse a footer again: schema, block count, row totals, and that each block lies before ``end`` and follows the one before."""
    footer, own = reader.read(raw)
    groups = footer[4][1][1]
    if footer[3][1] != rows or len(groups) != blocks or sum(g[3][1] for g in groups) != rows or own != signature:
        raise BlockMismatch("the new footer doesn't hold what was copied")
    at = 4
    for g in groups:
        for column in g[1][1][1]:
            meta = column[3][1]
            start = min(meta[k][1] for k in (9, 11) if k in meta and meta[k][1] > 0)
            if start != at:
                raise BlockMismatch("a block isn't where the new footer says")
            at += meta[7][1]
    if at != end:
        raise BlockMismatch("blocks end elsewhere than the footer starts")


def merge_blocks(files: Iterable[bytes]) -> Merged:
    """One file with the row groups of all; totals are validated against the new footer."""
    copier = BlockCopier()
    for f in files:
        copier.add(f)
    return copier.finish()


def block_rows(data: bytes) -> Iterator[int]:
    for group in read_footer(data)[4][1][1]:
        yield group[3][1]
