"""Results: rows as read-only mappings, JSON bytes, and the digest that tells whether a result has changed."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Row(Mapping):
    """A row: a mapping of column names in order. An unknown name gives None from get() and KeyError from []; of equal names the last is looked up."""

    __slots__ = ("_names", "_values", "_at")

    def __init__(self, names: Sequence[str], values: Sequence[object], at: dict[str, int]) -> None:
        self._names, self._values, self._at = names, tuple(values), at

    def __getitem__(self, k: str | int) -> object:
        return self._values[k if isinstance(k, int) else self._at[k]]

    def __iter__(self) -> Iterator[str]:
        return iter(self._at)

    def __len__(self) -> int:
        return len(self._at)

    def values(self) -> tuple:
        return self._values

    def __repr__(self) -> str:
        return f"Row({dict(self)!r})"

    def __eq__(self, other: object) -> bool:
        return dict(self) == dict(other) if isinstance(other, Mapping) else NotImplemented

    __hash__ = None


def collected(df: DataFrame) -> list[Row]:
    names = df.columns
    at = {n: k for k, n in enumerate(names)}
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else v
    return [Row(names, [plain(v) for v in r], at) for r in df.collect()]


def json_bytes(df: DataFrame) -> bytes:
    """The rows as a JSON array in UTF-8: names kept in order (also equal ones), nulls kept, binary values in base64."""
    rows = df.toDF(*df.columns).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()
    return ("[" + ",".join(r[0] for r in rows) + "]").encode()


def digest(rows: list[Row], in_order: bool) -> tuple[int, bytes]:
    """(number of rows, digest): sensitive to types, values, columns and, if in_order, to the order of rows."""

    def cell(v: object) -> bytes:
        if v is None:
            return b"n"
        if isinstance(v, bool):
            return b"t" if v else b"f"
        if isinstance(v, int):
            return b"i%d" % v
        if isinstance(v, float):
            return b"d" + struct.pack("<d", v)
        body = v if isinstance(v, bytes) else repr(v).encode() if not isinstance(v, str) else v.encode("utf-8", "surrogatepass")
        return (b"b" if isinstance(v, bytes) else b"s") + struct.pack("<q", len(body)) + body

    each = [hashlib.blake2b(b"\0".join(map(cell, r.values())), digest_size=16).digest() for r in rows]
    return len(rows), hashlib.blake2b(b"".join(each if in_order else sorted(each)), digest_size=16).digest()


def large_digest(df: DataFrame) -> tuple[int, int]:
    """(number of rows, sum of row hashes) of a result of any size and no order, as one aggregate. Nulls are hashed as such; a sum, so equal rows don't cancel."""
    cells = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    r = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*cells).cast("decimal(38,0)")), F.lit(0))).first()
    return r[0], int(r[1])
