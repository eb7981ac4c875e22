"""Binary events cut at every byte, against a plain reader."""

from __future__ import annotations

import random
import struct

from pyspark.sql import functions as F

from driftwood.sources import binary


def info(kind: int, ino: int, gen: int, name: bytes | None = None, handle_type: int = 1) -> bytes:
    body = bytes(8) + struct.pack("<IiII", 8, handle_type, ino, gen)
    if name is not None:
        body += name + bytes(4 - len(name) % 4)
    return struct.pack("<BBH", kind, 0, 4 + len(body)) + body


def event(mask: int, pid: int, *parts: bytes, extra: int = 0) -> bytes:
    body = bytes(extra) + b"".join(parts)
    return struct.pack("<IBBHQii", 24 + len(body), 3, 0, 24 + extra, mask, -1, pid) + body


def plain(buf: bytes) -> list[dict]:
    out, at = [], 0
    while len(buf) - at >= 24:
        size, _, _, meta, mask, _, pid = struct.unpack_from("<IBBHQii", buf, at)
        if size < 24 or at + size > len(buf):
            break
        got, off = {"place": len(out), "mask": mask, "pid": pid}, at + max(meta, 24)
        while off + 4 <= at + size:
            kind, _, n = struct.unpack_from("<BBH", buf, off)
            if n < 4 or off + n > at + size:
                break
            group = {1: "fid", 3: "fid", 2: "dir", 10: "old", 12: "new"}.get(kind)
            if group:
                body, node, name = buf[off + 4 : off + n], None, None
                if len(body) >= 16:
                    hb, ht = struct.unpack_from("<Ii", body, 8)
                    if len(body) >= 16 + hb:
                        node = struct.unpack_from("<II", body, 16) if ht in (1, 2) and hb >= 8 else None
                        name = body[16 + hb :].split(b"\0")[0] or None
                got |= {f"{group}_ino": node and node[0], f"{group}_gen": node and node[1], "name" if group == "dir" else f"{group}_name": None if group == "fid" else name}
            off += n
        out.append({k: v for k, v in got.items() if v is not None and k != "fid_name"})
        at += size
    return out


def test_events_against_a_plain_reader(spark):
    rng = random.Random(9)
    whole = [
        event(8, -5, info(2, 7, 1, b"name"), info(1, 4_000_000_000, 2)), event(1 << 40, 3, info(10, 1, 2, b"a"), info(12, 3, 4, "\u00e9\u00e9\u00e9".encode())), event(1, 0), event(2, 1, info(99, 1, 1), info(3, 5, 6), extra=8),
        event(4, 1, info(2, 7, 1, b"x", handle_type=77)), event(4, 2, info(2, 7, 1, b"", handle_type=2)), event(4, 2, info(1, 1, 1), info(1, 2, 2)),
    ]
    bufs = [None, b"", *whole, b"".join(whole), *(b"".join(whole[:3])[:n] for n in range(len(b"".join(whole[:3]))))]
    for _ in range(200):
        b = bytearray(b"".join(rng.choices(whole, k=3)))
        for _ in range(3):
            b[rng.randrange(len(b))] = rng.randrange(256)
        bufs.append(bytes(b))
    df = spark.createDataFrame(list(enumerate(bufs)), "id bigint, data binary").withColumn("note", F.lit("kept")).repartition(3)
    got: dict[int, list] = {}
    for r in sorted(binary.parse_events(df).collect(), key=lambda r: (r["id"], r["place"])):
        assert r["note"] == "kept"
        values = {k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items() if v is not None and k not in ("id", "note", "event_len")}
        got.setdefault(r["id"], []).append(values | {"mask": r["mask"] % 2**64})
    assert got == {i: p for i, b in enumerate(bufs) if (p := plain(b or b""))}
    assert binary.parse_events(df.limit(0)).count() == 0
