"""Scalar functions as columns: identities, fingerprints, modes, addresses, paths.

Unsigned 64-bit values travel as signed longs (two's complement).  Where arithmetic wraps modulo
2**64 it is done in decimals, which ANSI mode doesn't stop.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a over 64-bit words.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
# Kinds, their letters, and their numbers on the wire (NFS version 3 and 4 share them).
KINDS = ("file", "dir", "symlink", "fifo", "sock", "chr", "blk")
KIND_LETTERS = {"file": "-", "dir": "d", "symlink": "l", "fifo": "p", "sock": "s", "chr": "c", "blk": "b"}
FTYPE = {"file": 1, "dir": 2, "blk": 3, "chr": 4, "symlink": 5, "sock": 6, "fifo": 7}
# File type bits of a mode.
S_IFMT = {0o100000: "file", 0o040000: "dir", 0o120000: "symlink", 0o010000: "fifo", 0o140000: "sock", 0o020000: "chr", 0o060000: "blk"}
# Errno to status.
ERRNO = {1: "perm", 2: "noent", 5: "io", 13: "access", 17: "exist", 18: "xdev", 20: "notdir", 21: "isdir", 22: "inval", 27: "fbig", 28: "nospc", 30: "rofs", 36: "nametoolong", 39: "notempty", 116: "stale"}
U64 = 1 << 64


def _map(c: Column, values: dict, default=None) -> Column:
    out = F.lit(default) if default is not None else F.lit(None)
    for k, v in reversed(values.items()):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def unsigned(c: Column) -> Column:
    """A signed long as the decimal it stands for."""
    d = c.cast("decimal(38,0)")
    return F.when(c < 0, d + F.lit(str(U64)).cast("decimal(38,0)")).otherwise(d)


def signed(d: Column) -> Column:
    """A decimal below 2**64 as a signed long."""
    big = F.lit(str(U64)).cast("decimal(38,0)")
    half = F.lit(str(U64 >> 1)).cast("decimal(38,0)")
    return F.when(d >= half, d - big).otherwise(d).cast("bigint")


def fnv64(*words: Column) -> Column:
    """FNV-1a over 64-bit words, as a signed long."""
    big = F.lit(str(U64)).cast("decimal(38,0)")

    def step(h: Column, w: Column) -> Column:
        x = unsigned(h.bitwiseXOR(w)).cast("decimal(20,0)")
        return signed(((x * F.lit(FNV_PRIME).cast("decimal(15,0)")) % big).cast("decimal(38,0)"))

    # An aggregate binds each step's value, so the expression doesn't grow with the words.
    return F.aggregate(F.array(*(w.cast("bigint") for w in words)), F.lit(FNV_OFFSET - U64).cast("bigint"), step)


def content_fingerprint(mtime_sec: Column, mtime_nsec: Column, size: Column, version: Column) -> Column:
    return fnv64(mtime_sec, mtime_nsec, size, version)


def change_attr(mtime_sec: Column, mtime_nsec: Column, ctime_sec: Column, ctime_nsec: Column, size: Column) -> Column:
    return fnv64(mtime_sec, mtime_nsec, ctime_sec, ctime_nsec, size)


def synth_ino(parent: Column, name: Column) -> Column:
    """A deterministic id with bit 63 set for a synthesized entry."""
    h = F.sha2(F.concat(parent.cast("string"), F.lit("/"), name).cast("binary"), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint").bitwiseOR(F.lit(-(1 << 63)).cast("bigint"))


def mode_string(kind: Column, mode: Column) -> Column:
    """Kind letter and the permission bits in octal, such as d755."""
    return F.concat(_map(kind, KIND_LETTERS, "?"), F.lpad(F.conv(mode.bitwiseAND(0o777).cast("string"), 10, 8), 3, "0"))


def kind_of_mode(mode: Column) -> Column:
    return _map(mode.bitwiseAND(0o170000), S_IFMT)


def ftype(kind: Column) -> Column:
    return _map(kind, FTYPE)


def status_of_errno(errno: Column) -> Column:
    return _map(errno, ERRNO, "io")


def path_join(parent: Column, name: Column) -> Column:
    return F.when(parent == "/", F.concat(F.lit("/"), name)).otherwise(F.concat(parent, F.lit("/"), name))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def chunk_offset(off: Column, chunk: int) -> Column:
    return (off - off % chunk).cast("bigint")


def chunk_len(off: Column, size: Column, chunk: int) -> Column:
    return F.least(F.lit(chunk).cast("bigint"), size - off)


def rdev_pack(major: Column, minor: Column) -> Column:
    return F.shiftleft(major.cast("bigint"), 32).bitwiseOR(minor.cast("bigint"))


def uuid_parse(s: Column) -> Column:
    """32 lower-case hex digits of a UUID text, dashes dropped; null if it isn't one."""
    bare = F.regexp_replace(s, "-", "")
    return F.when(bare.rlike("^[0-9A-Fa-f]{32}$"), F.lower(bare))


def uuid_format(h: Column) -> Column:
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def ipv4_to_int(s: Column) -> Column:
    """A dotted quad as a number; null if it isn't one."""
    p = F.split(s, r"\.")
    part = lambda i: F.get(p, F.lit(i)).cast("bigint")
    good = s.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    value = part(0) * (1 << 24) + part(1) * (1 << 16) + part(2) * 256 + part(3)
    return F.when(good, F.when(F.greatest(*(part(i) for i in range(4))) <= 255, value))


def int_to_ipv4(n: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def is_private_v4(n: Column) -> Column:
    ten, twelve, sixteen = n.bitwiseAND(0xFF000000) == 0x0A000000, n.bitwiseAND(0xFFF00000) == 0xAC100000, n.bitwiseAND(0xFFFF0000) == 0xC0A80000
    return ten | twelve | sixteen


def approx_record_size(op: Column, name: Column, to_name: Column | None = None, entries: Column | None = None) -> Column:
    """Bytes that a record is taken to fill when batches are cut."""
    n = F.coalesce(F.octet_length(name), F.lit(0))
    m = F.coalesce(F.octet_length(to_name), F.lit(0)) if to_name is not None else F.lit(0)
    e = F.coalesce(entries, F.lit(0)) if entries is not None else F.lit(0)
    return (
        F.when(op == "created", 48 + n).when(op == "created_batch", 16 + 64 * e).when(op == "removed", 24 + n).when(op == "renamed", 48 + n + m)
        .when(op == "attr", 64).when(op == "content", 40).when(op == "self_removed", 16).otherwise(8)
    )
