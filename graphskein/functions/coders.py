"""Values to bytes and back, for wide-column stores."""

from __future__ import annotations

import importlib
import struct
from typing import Protocol

# fixed values: big-endian formats of the primitive types
FORMATS = {"tinyint": ">b", "byte": ">b", "smallint": ">h", "short": ">h", "int": ">i", "integer": ">i", "bigint": ">q", "long": ">q", "float": ">f", "double": ">d"}
# fixed values: order codes of typed bytes (ascending order)
TYPED_NULL, TYPED_INT8, TYPED_INT16, TYPED_INT32, TYPED_INT64, TYPED_FLOAT32, TYPED_FLOAT64, TYPED_TEXT, TYPED_BLOB = 0x05, 0x29, 0x2A, 0x2B, 0x2C, 0x30, 0x31, 0x34, 0x38


class Coder(Protocol):
    composite: bool

    def encode(self, value: object, kind: str, row_key: bool = False) -> bytes: ...

    def decode(self, data: bytes, kind: str, row_key: bool = False) -> object: ...


class PrimitiveCoder:
    """Fixed-width big-endian numbers, one byte booleans, UTF-8 strings, raw binaries. The only coder for composite keys."""

    composite = True

    def encode(self, value: object, kind: str, row_key: bool = False) -> bytes:
        if kind == "boolean":
            return b"\xff" if value else b"\x00"
        if kind == "string":
            return str(value).encode()
        if kind == "binary":
            return bytes(value)
        if kind not in FORMATS:
            raise TypeError(f"unsupported data type {kind}")
        return struct.pack(FORMATS[kind], value)

    def decode(self, data: bytes, kind: str, row_key: bool = False) -> object:
        if kind == "boolean":
            return data[0] != 0
        if kind == "string":
            return data.decode()
        if kind == "binary":
            return bytes(data)
        if kind not in FORMATS:
            raise TypeError(f"unsupported data type {kind}")
        return struct.unpack(FORMATS[kind], data)[0]


class TypedCoder:
    """Bytes that carry their type and sort like the values (ordered bytes); a row key has a salt byte in front, made from
    its hash. Composite keys are not supported."""

    composite = False
    buckets = 256

    def encode(self, value: object, kind: str, row_key: bool = False) -> bytes:
        if value is None:
            out = bytes([TYPED_NULL])
        elif kind == "string":
            out = bytes([TYPED_TEXT]) + str(value).encode() + b"\x00"
        elif kind == "binary":
            out = bytes([TYPED_BLOB]) + bytes(value)
        elif kind == "boolean":
            out = bytes([TYPED_INT8, 0x81 if value else 0x80])
        elif kind in ("float", "double"):
            wide = kind == "double"
            raw = struct.pack(">d" if wide else ">f", value)
            raw = bytes(x ^ 0xFF for x in raw) if raw[0] & 0x80 else bytes([raw[0] ^ 0x80]) + raw[1:]
            out = bytes([TYPED_FLOAT64 if wide else TYPED_FLOAT32]) + raw
        elif kind in FORMATS:
            raw = struct.pack(FORMATS[kind], value)
            out = bytes([{1: TYPED_INT8, 2: TYPED_INT16, 4: TYPED_INT32, 8: TYPED_INT64}[len(raw)], raw[0] ^ 0x80]) + raw[1:]
        else:
            raise TypeError(f"unsupported data type {kind}")
        return bytes([self.salt(out)]) + out if row_key else out

    def salt(self, data: bytes) -> int:
        h = 0
        for b in data:
            h = (31 * h + b) & 0xFFFFFFFF
        return h % self.buckets

    def decode(self, data: bytes, kind: str, row_key: bool = False) -> object:
        data = data[1:] if row_key else data
        tag, raw = data[0], data[1:]
        if tag == TYPED_NULL:
            return None
        if tag == TYPED_TEXT:
            return raw[:-1].decode()
        if tag == TYPED_BLOB:
            return raw
        if tag in (TYPED_FLOAT32, TYPED_FLOAT64):
            raw = bytes([raw[0] ^ 0x80]) + raw[1:] if raw[0] & 0x80 else bytes(x ^ 0xFF for x in raw)
            return struct.unpack(">f" if tag == TYPED_FLOAT32 else ">d", raw)[0]
        formats = {TYPED_INT8: ">b", TYPED_INT16: ">h", TYPED_INT32: ">i", TYPED_INT64: ">q"}
        if tag not in formats:
            raise ValueError(f"unknown type tag {tag:#x}")
        n = struct.unpack(formats[tag], bytes([raw[0] ^ 0x80]) + raw[1:])[0]
        return bool(n) if kind == "boolean" else n


def coder(name: str) -> Coder:
    """'primitive', 'typed', or 'module:Class' of one's own."""
    if ":" in name:
        module, _, cls = name.partition(":")
        return getattr(importlib.import_module(module), cls)()
    known = {"primitive": PrimitiveCoder, "typed": TypedCoder}
    if name.lower() not in known:
        raise ValueError(f"unknown coder: {name}")
    return known[name.lower()]()
