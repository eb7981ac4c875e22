"""Binary change events, file handles and frame headers.

Events have parts of variable length, which are followed in rounds: a round reads one part of every event
of a batch, all at once, by positions in the batch's bytes.  Handles and headers have fixed places and are
column expressions.  What is cut short or doesn't check is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sizes and kinds of the event format.
METADATA, INFO_HEADER = 24, 4
FID, DFID_NAME, DFID, OLD_NAME, NEW_NAME = 1, 2, 3, 10, 12
FSID, HANDLE_HEADER = 8, 8
#: The handle types that begin with a 32-bit number and a generation.
INO32_GEN = (1, 2)
#: Events of a batch are parsed together up to so many bytes of them.
SLICE_BYTES = 8 << 20

EVENT = "place bigint, event_len bigint, mask bigint, pid bigint, fid_ino bigint, fid_gen bigint, dir_ino bigint, dir_gen bigint, name binary, old_ino bigint, old_gen bigint, old_name binary, new_ino bigint, new_gen bigint, new_name binary"
_GROUPS = {FID: "fid", DFID: "fid", DFID_NAME: "dir", OLD_NAME: "old", NEW_NAME: "new"}


def _number(buf: np.ndarray, at: np.ndarray, size: int, signed: bool = False) -> np.ndarray:
    """Little-endian numbers of ``size`` bytes at the positions."""
    out = np.zeros(len(at), np.uint64)
    for i in range(size):
        out |= buf[at + i].astype(np.uint64) << np.uint64(8 * i)
    out = out.view(np.int64)
    return np.where(out >> (8 * size - 1) & 1, out - (1 << 8 * size), out) if signed and size < 8 else out


def _names(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes | None]:
    """The bytes from each start up to a zero byte or the end; null if there are none."""
    zeros = np.flatnonzero(buf == 0)
    stop = np.concatenate((zeros, [len(buf)]))[np.searchsorted(zeros, start)]
    stop = np.minimum(stop, end)
    return [buf[a:b].tobytes() if b > a else None for a, b in zip(start.tolist(), stop.tolist(), strict=True)]


def split(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the whole events in each row's bytes, round by round; a row ends where an event is cut short."""
    rows, found = np.arange(len(start)), []
    while len(rows):
        whole = end - start >= METADATA
        rows, start, end = rows[whole], start[whole], end[whole]
        size = _number(buf, start, 4)
        whole = (size >= METADATA) & (size <= end - start)
        rows, start, end, size = rows[whole], start[whole], end[whole], size[whole]
        found.append((rows, start, start + size))
        start = start + size
    row, a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.argsort(row, kind="stable")
    return row[order], a[order], b[order]


def parse(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray | list]:
    """Fields of the whole events from start to end each: numbers with a mask of those that are there."""
    n = len(start)
    out: dict[str, np.ndarray | list] = {"event_len": end - start, "mask": _number(buf, start + 8, 8), "pid": _number(buf, start + 20, 4, signed=True)}
    for g in ("fid", "dir", "old", "new"):
        out |= {f"{g}_ino": np.zeros(n, np.int64), f"{g}_gen": np.zeros(n, np.int64), f"{g}_there": np.zeros(n, bool), f"{g}_name": np.full(n, None, object)}
    live = np.arange(n)
    at = start + np.maximum(_number(buf, start + 6, 2), METADATA)
    while len(live):
        fits = at + INFO_HEADER <= end[live]
        live, at = live[fits], at[fits]
        kind, size = buf[at], _number(buf, at + 2, 2)
        fits = (size >= INFO_HEADER) & (at + size <= end[live])
        live, at, kind, size = live[fits], at[fits], kind[fits], size[fits]
        for k, g in _GROUPS.items():
            m = np.flatnonzero(kind == k)
            _part(buf, at[m] + INFO_HEADER, at[m] + size[m], live[m], out, g, named=k not in (FID, DFID))
        at = at + size
    return out


def _part(buf: np.ndarray, a: np.ndarray, b: np.ndarray, rows: np.ndarray, out: dict, g: str, named: bool) -> None:
    """A handle, and a name after it, of the parts from a to b; a later part of a kind replaces the first."""
    out[f"{g}_there"][rows] = False
    out[f"{g}_name"][rows] = None
    m = b - a >= FSID + HANDLE_HEADER
    a, b, rows = a[m], b[m], rows[m]
    size, kind = _number(buf, a + FSID, 4), _number(buf, a + FSID + 4, 4, signed=True)
    at = a + FSID + HANDLE_HEADER
    m = at + size <= b
    at, b, rows, size, kind = at[m], b[m], rows[m], size[m], kind[m]
    if named and len(rows):
        out[f"{g}_name"][rows] = _names(buf, at + size, b)
    m = np.isin(kind, INO32_GEN) & (size >= 8)
    out[f"{g}_ino"][rows[m]], out[f"{g}_gen"][rows[m]], out[f"{g}_there"][rows[m]] = _number(buf, at[m], 4), _number(buf, at[m] + 4, 4), True


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(a, b - a)
        a = b


def parse_events(rows: DataFrame, data: str = "data") -> DataFrame:
    """The other columns of ``rows`` and EVENT for each whole event in ``data``, whose first has place 0.

    Null or short data, and what follows an event that is cut short, give no rows.  A part that is cut
    short ends its event's parts; a handle of a type beside INO32_GEN is null.
    """
    keep = [f for f in rows.schema.fields if f.name != data]
    schema = T.StructType([*keep, *T.StructType.fromDDL(EVENT).fields])
    fields = [c.split(" ") for c in EVENT.split(", ")]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for part in _slices(batch, batch.num_columns - 1):
                texts = [x or b"" for x in part.column(part.num_columns - 1).to_pylist()]
                buf = np.frombuffer(b"".join(texts) + bytes(METADATA), np.uint8)
                to = np.cumsum([len(x) for x in texts]).astype(np.int64)
                row, a, b = split(buf, to - np.array([len(x) for x in texts], np.int64), to)
                got = parse(buf, a, b)
                first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts)))))[:-1] if len(row) else np.zeros(0, np.int64)
                columns = {"place": pa.array(np.arange(len(row)) - first[row] if len(row) else row), **{c: pa.array(got[c]) for c in ("event_len", "mask", "pid")}}
                for g in ("fid", "dir", "old", "new"):
                    absent = ~got[f"{g}_there"]
                    columns |= {f"{g}_{c}": pa.array(got[f"{g}_{c}"], pa.int64(), mask=absent) for c in ("ino", "gen")}
                    columns["name" if g == "dir" else f"{g}_name"] = pa.array(list(got[f"{g}_name"]), pa.binary())
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in part.columns[:-1]), *(columns[c] for c, _ in fields)], [*(f.name for f in keep), *(c for c, _ in fields)])

    return rows.select(*(F.col(f"`{f.name}`") for f in keep), F.col(data).alias("__data")).mapInArrow(run, schema)


# Fixed places.


def little(c: Column, size: int) -> Column:
    """The ``size`` bytes of a whole number, lowest first."""
    h = F.right(F.lpad(F.hex(c.cast("bigint")), 16, "0"), F.lit(2 * size))
    return F.unhex(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(size)))))


def big(c: Column, size: int) -> Column:
    return F.unhex(F.right(F.lpad(F.hex(c.cast("bigint")), 16, "0"), F.lit(2 * size)))


def _read(data: Column, at: int, size: int, reverse: bool) -> Column:
    """A number of ``size`` bytes at a place; of eight bytes as a signed long."""
    h = F.hex(F.substring(data, at + 1, size))
    digits = F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(size)))) if reverse else h
    return F.conv(digits, 16, -10).cast("bigint")


# The frame format.
FRAME_HEADER, FRAME_KINDS, FRAME_FLAGS = 16, ("ctl", "req", "resp", "event", "bulk"), 0b11


def frame_header(data: Column, max_payload: int) -> Column:
    """struct(len, kind, flags, seq, problem) of the 16 bytes that begin a frame; shorter data are null.

    With a ``problem`` (kind, flags, reserved or length, the first of them) the other fields are null.
    """
    length, kind, flags, rest = _read(data, 0, 4, True), _read(data, 4, 1, True), _read(data, 5, 1, True), _read(data, 6, 2, True)
    problem = F.when(kind >= len(FRAME_KINDS), "kind").when(flags.bitwiseAND(~FRAME_FLAGS & 0xFF) != 0, "flags").when(rest != 0, "reserved").when(length > max_payload, "length")
    fine = lambda c: F.when(problem.isNull(), c)
    name = F.get(F.lit(list(FRAME_KINDS)), kind.cast("int"))
    return F.when(F.octet_length(data) >= FRAME_HEADER, F.struct(fine(length).alias("len"), fine(name).alias("kind"), fine(flags).alias("flags"), fine(_read(data, 8, 8, True)).alias("seq"), problem.alias("problem")))


def encode_frame(length: Column, kind: Column, flags: Column, seq: Column) -> Column:
    return F.concat(little(length, 4), little(kind, 1), little(flags, 1), F.unhex(F.lit("0000")), little(seq, 8))


#: Length of a handle: a mark, share, flags, number, generation and the check.
HANDLE = 28
MARK = b"DWH1"


def _mac(body: Column, key: bytes) -> Column:
    """The first eight bytes of HMAC-SHA-256."""
    own = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in own)) for pad in (0x36, 0x5C))
    return F.substring(F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256)), 1, 8)


def encode_handle(share: Column, ino: Column, gen: Column, key: bytes) -> Column:
    """A handle of a node that only who has ``key`` (64 bytes at most) can make."""
    body = F.concat(F.lit(MARK), big(share, 2), F.unhex(F.lit("0000")), big(ino, 8), big(gen, 4))
    return F.concat(body, _mac(body, key))


def decode_handle(data: Column, key: bytes) -> Column:
    """struct(share, ino, gen) of a handle whose length, mark and check are right; else null."""
    body = F.substring(data, 1, HANDLE - 8)
    right = (F.octet_length(data) == HANDLE) & (F.substring(data, 1, 4) == F.lit(MARK)) & (F.substring(data, HANDLE - 7, 8) == _mac(body, key))
    return F.when(right, F.struct(_read(data, 4, 2, False).alias("share"), _read(data, 8, 8, False).alias("ino"), _read(data, 16, 4, False).alias("gen")))
