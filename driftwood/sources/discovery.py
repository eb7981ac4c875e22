"""Text sources that name machines: lease files, address tables, service listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwood.functions.scalars import ipv4_to_int, uuid_parse


def leases(lines: DataFrame) -> DataFrame:
    """(file, name, ip) of blocks in braces; the last name and address of a block count.

    lines: (file, no, line).  A block's rows share the running count of opening braces.
    """
    w = Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    t = lines.withColumn("line", F.btrim("line", F.lit(" \t\r")))
    t = t.withColumn("block", F.sum((F.col("line") == "{").cast("int")).over(w))
    value = lambda key: F.max_by(F.regexp_extract("line", f"^{key}=(.*)$", 1), F.when(F.col("line").startswith(f"{key}="), F.col("no")))
    out = t.where("block > 0").groupBy("file", "block").agg(value("name").alias("name"), value("ip_address").alias("ip"), F.bool_or(F.col("line") == "}").alias("closed"))
    return out.where(F.col("closed") & ipv4_to_int(F.col("ip")).isNotNull()).select("file", "block", "name", "ip")


def arp(lines: DataFrame) -> DataFrame:
    """Addresses in the first parentheses of each line, once each, in order of appearance."""
    ip = lines.withColumn("ip", F.regexp_extract("line", r"^[^(]*\(([^)]*)\)", 1)).where(ipv4_to_int(F.col("ip")).isNotNull())
    return ip.groupBy("file", "ip").agg(F.min("no").alias("no"))


def browse(lines: DataFrame, service: str) -> DataFrame:
    """Instance names of the Add rows of a service listing."""
    cols = F.split(F.btrim("line", F.lit(" \t\r")), r"\s+")
    at = F.array_position(F.transform(cols, lambda c: c.contains(service)), True)
    name = F.array_join(F.slice(cols, (at + 1).cast("int"), 1 << 20), " ")
    found = lines.where(F.array_contains(cols, "Add") & (at > 0)).withColumn("instance", name).where("instance <> ''")
    return found.groupBy("file", "instance").agg(F.min("no").alias("no"))


def resolve(lines: DataFrame, default_port: int) -> DataFrame:
    """(file, host, port, uuid) of resolved services; the last line that says so counts."""
    at = F.regexp_extract("line", r"can be reached at (\S+):", 1)
    port = F.regexp_extract("line", r"can be reached at \S+:(\d+)", 1)
    uuid = uuid_parse(F.regexp_extract("line", r"(?:^|\s)uuid=(\S+)", 1))
    rows = lines.withColumns({"host": F.regexp_replace(at, r"\.+$", ""), "port": F.try_to_number(port, F.lit("99999")).cast("int"), "uuid": uuid})
    out = rows.groupBy("file").agg(F.max_by("host", F.when(F.col("host") != "", F.col("no"))).alias("host"), F.max_by("port", F.when(F.col("host") != "", F.col("no"))).alias("port"), F.max_by("uuid", F.when(F.col("uuid").isNotNull(), F.col("no"))).alias("uuid"))
    return out.where("host IS NOT NULL").withColumn("port", F.coalesce("port", F.lit(default_port)))


def identity_ok(got, expected):
    """No expectation accepts any; an expectation needs the same identity."""
    return F.when(expected.isNull(), True).otherwise(F.coalesce(got == expected, F.lit(False)))


def candidates(sources: list[DataFrame]) -> DataFrame:
    """Addresses (ip, no) of sources in order of preference, each once, with its place."""
    rows = None
    for k, s in enumerate(sources):
        x = s.select("ip", F.lit(k).alias("source"), "no")
        rows = x if rows is None else rows.unionByName(x)
    best = rows.groupBy("ip").agg(F.min(F.struct("source", "no")).alias("x"))
    return best.select("ip", "x.source", "x.no")


def in_network(ips: DataFrame, networks: DataFrame) -> DataFrame:
    """(ip, n) with the networks (net, bits) that hold it: an equi-join on each mask length there is."""
    lengths = [r["bits"] for r in networks.select("bits").distinct().collect()]  # 33 at most
    out = None
    for b in sorted(lengths):
        mask = (0xFFFFFFFF << (32 - b)) & 0xFFFFFFFF
        x = ips.withColumn("net", F.col("n").bitwiseAND(mask)).join(networks.where(F.col("bits") == b).select(F.col("net").bitwiseAND(mask).alias("net"), "bits", "name"), "net").select("ip", "name", "bits")
        out = x if out is None else out.unionByName(x)
    return out
