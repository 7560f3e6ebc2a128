"""Byte layouts of raw dumps, for import only: versions and current pointers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = 1 << 63


def encode_record(write_nanos: int, source: str, schema_ver: int, persisted_hash: str, payload: bytes) -> bytes:
    """Marker and layout 1, time, source, schema version, hash, payload; numbers are little-endian."""
    s, h = source.encode(), persisted_hash.encode()
    return b"".join([struct.pack("<QqI", _MARK | 1, write_nanos, len(s)), s, struct.pack("<IH", schema_ver, len(h)), h, payload])


def decode_record(raw: bytes | None) -> tuple | None:
    """(write_nanos, source, schema_ver, persisted_hash, payload); old records are a time and a payload; None if cut off."""
    if raw is None or len(raw) < 8:
        return None
    (first,) = struct.unpack_from("<Q", raw)
    if not first & _MARK:
        return first, "", 0, "", raw[8:]
    try:
        nanos, n = struct.unpack_from("<qI", raw, 8)
        version, m = struct.unpack_from("<IH", raw, 20 + n)
        end = 26 + n + m
        if end > len(raw):
            return None
        return nanos, raw[20 : 20 + n].decode(), version, raw[26 + n : end].decode(), raw[end:]
    except (struct.error, UnicodeDecodeError):
        return None


def decode_records(raw) -> Column:
    """decode_record over a column; fields are null where a record is cut off."""

    def decode(values: pd.Series) -> pd.DataFrame:
        rows = [decode_record(None if x is None else bytes(x)) or (None,) * 5 for x in values]
        return pd.DataFrame(rows, columns=["write_nanos", "source", "schema_ver", "persisted_hash", "payload"]).astype({"write_nanos": "Int64", "schema_ver": "Int32"})

    return F.pandas_udf(decode, "write_nanos long, source string, schema_ver int, persisted_hash string, payload binary")(raw)


def encode_pointer(seq: int, payload_hash: str) -> bytes:
    """A current pointer: seq, length of the hash, hash; numbers are little-endian."""
    h = payload_hash.encode()
    return struct.pack("<QH", seq, len(h)) + h


def decode_pointer(raw: bytes | None) -> tuple[int, str] | None:
    """(seq, payload_hash); None if cut off."""
    if raw is None or len(raw) < 10:
        return None
    seq, n = struct.unpack_from("<QH", raw)
    return (seq, raw[10 : 10 + n].decode(errors="replace")) if len(raw) >= 10 + n else None


def decode_pointers(raw) -> Column:
    """decode_pointer over a column; fields are null where a pointer is cut off."""

    def decode(values: pd.Series) -> pd.DataFrame:
        rows = [decode_pointer(None if x is None else bytes(x)) or (None, None) for x in values]
        return pd.DataFrame(rows, columns=["seq", "payload_hash"]).astype({"seq": "Int64"})

    return F.pandas_udf(decode, "seq long, payload_hash string")(raw)
