"""Leases on nodes (delegations), session slots and clients."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwood.functions.lineage import durable

#: Leases that are held at a time at most.
LEASES = 16_384


def lifecycle(events: DataFrame) -> DataFrame:
    """Effect of each event (node, seq, us, kind in open, inval, return): granted, recalled, returned or
    none, with the latency of a return after a recall.

    A lease is held from an open to the next return.  Between two returns only the first open grants,
    and only the first invalidation after it recalls; so each event needs the last return and the
    first open and invalidation since, which are windows over the node's events.
    """
    w = Window.partitionBy("node").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    span = events.withColumn("span", F.coalesce(F.sum((F.col("kind") == "return").cast("int")).over(before), F.lit(0)))
    s = Window.partitionBy("node", "span").orderBy("seq")
    past = s.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.max((F.col("kind") == "open").cast("int")).over(past) == 1
    held = span.withColumn("held", F.coalesce(opened, F.lit(False)))
    recalls = F.min(F.when((F.col("kind") == "inval") & F.col("held"), F.col("us"))).over(past)
    told = held.withColumn("recalled_us", recalls)
    effect = (
        F.when((F.col("kind") == "open") & ~F.col("held"), "granted")
        .when((F.col("kind") == "inval") & F.col("held") & F.col("recalled_us").isNull(), "recalled")
        .when((F.col("kind") == "return") & F.col("held"), "returned")
        .otherwise("none")
    )
    return told.withColumn("effect", effect).withColumn("latency_us", F.when((F.col("effect") == "returned") & F.col("recalled_us").isNotNull(), F.col("us") - F.col("recalled_us"))).drop("span", "held", "recalled_us")


EFFECTS = "node bigint, seq bigint, us bigint, effect string, latency_us bigint"
_NONE = -1


def _decide(cap: int | None, by_node: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows (node, seq, us, kind, may, bound) in order to EFFECTS; then a row ``held`` for each lease that is
    left, whose ``latency_us`` is when it was recalled.  A ``held`` row on the way in is such a lease.

    ``by_node`` rows come node by node, and one node's lease is all that is remembered.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, int] = {}
        at = None

        def left() -> list[tuple]:
            return [(n, None, None, "held", us) for n, us in held.items()]

        for pdf in parts:
            out: list[tuple] = []
            for node, seq, us, kind, may, bound in zip(*(pdf[c].tolist() for c in ("node", "seq", "us", "kind", "may", "bound")), strict=True):
                if by_node and node != at:
                    out += left()
                    held.clear()
                    at = node
                effect, latency = "none", None
                if kind == "held":
                    held[node] = us
                    continue
                if kind == "open":
                    if may and node not in held:
                        effect = "granted" if cap is None or len(held) < cap else "refused"
                        if effect == "granted":
                            held[node] = _NONE
                elif node in held:
                    if kind == "return":
                        effect, recalled = "returned", held.pop(node)
                        latency = us - recalled if recalled != _NONE else None
                    elif held[node] == _NONE:
                        effect = "recalled" if bound else "revoked"
                        if bound:
                            held[node] = us
                        else:
                            del held[node]
                out.append((node, seq, us, effect, latency))
            yield _effects(out)
        yield _effects(left())

    return run


def _effects(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in EFFECTS.split(", ")], dtype=object)
    return out.astype({"node": "Int64", "seq": "Int64", "us": "Int64", "latency_us": "Int64"})


def admission(events: DataFrame, cap: int = LEASES, block: int = 1 << 16) -> DataFrame:
    """EFFECTS of events (node, seq, us, kind in open, inval, return; may: the open reads an old file;
    bound: there is a channel to recall through), in order of ``seq``: granted, refused, recalled, revoked,
    returned or none.

    An open that may is granted unless its node's lease is held or ``cap`` are held in all.  A lease that
    can't be recalled is revoked.  Whoever holds one under the cap would hold one without it too, so the
    cap can only matter in blocks of ``block`` numbers in which that many would be held without it.  Blocks
    where it can't are decided node by node, side by side; runs of the others one event after another, by
    a task that remembers the leases held, ``cap`` at most, which also go on from one run to the next.
    """
    columns = ["node", "seq", "us", "kind", "may", "bound"]
    rows = durable(events.select(*(F.col(c).cast("bigint") for c in columns[:3]), "kind", F.coalesce("may", F.lit(False)).alias("may"), F.coalesce("bound", F.lit(False)).alias("bound")).where("node IS NOT NULL"))
    alone = lambda part: part.repartition("node").sortWithinPartitions("node", "seq").mapInPandas(_decide(None, True), EFFECTS)
    free = durable(alone(rows))
    number = lambda c: F.floor(F.col(c) / block).cast("bigint")
    step = F.when(F.col("effect") == "granted", 1).when(F.col("effect").isin("returned", "revoked"), -1).otherwise(0)
    inside = Window.partitionBy("b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = free.where("effect <> 'held'").select(number("seq").alias("b"), "seq", step.alias("step")).withColumn("n", F.sum("step").over(inside))
    sums = run.groupBy("b").agg(F.sum("step").alias("total"), F.max("n").alias("top")).orderBy("b").collect()  # a row a block
    if not sums:
        return free.where("effect <> 'held'")
    hot, before = [], 0
    for r in sums:
        hot.append((r["b"], before + r["top"] > cap))
        before += r["total"]
    if not any(h for _, h in hot):
        return free.where("effect <> 'held'")
    out, held = [], None
    for is_hot, group in itertools.groupby(hot, key=lambda x: x[1]):
        blocks = [b for b, _ in group]
        part = rows.where(number("seq").between(blocks[0], blocks[-1]))
        if held is not None:
            part = part.unionByName(held.select("node", F.lit(-1).cast("bigint").alias("seq"), F.col("latency_us").alias("us"), F.lit("held").alias("kind"), F.lit(False).alias("may"), F.lit(False).alias("bound")))
        told = durable(part.repartition(1).sortWithinPartitions("seq").mapInPandas(_decide(cap, False), EFFECTS) if is_hot else alone(part))
        out.append(told.where("effect <> 'held'"))
        held = told.where("effect = 'held'")
    return functools.reduce(DataFrame.unionByName, out)


def report(effects: DataFrame) -> DataFrame:
    granted, returned = F.count_if(F.col("effect") == "granted"), F.count_if(F.col("effect") == "returned")
    return effects.agg(granted.alias("granted"), F.count_if(F.col("effect") == "recalled").alias("recalls"), returned.alias("returned"), (granted - returned).alias("held"))


def exact_percentiles(rows: DataFrame, value: str, key: str, points: dict[str, float]) -> DataFrame:
    """The value at place round((n - 1) * p) of each group's sorted values, by rank."""
    w = Window.partitionBy(key).orderBy(value)
    ranked = rows.where(F.col(value).isNotNull()).withColumns({"rn": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy(key))})
    at = lambda p: F.floor((F.col("n") - 1) * p + 0.5)
    return ranked.groupBy(key).agg(F.count("*").alias("n_samples"), *(F.max(F.when(F.col("rn") == at(p), F.col(value))).alias(name) for name, p in points.items()))


def slot_replay(calls: DataFrame) -> DataFrame:
    """(slot, n, status) of calls (slot, n, seqid, cached): execute, replay, retry_uncached or misordered.

    A slot's number moves on only with calls that execute, so a call depends on all before it: the
    slot's calls stream through one task in order, which holds a slot's last call alone.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, seqid, cached = None, 0, None
        for pdf in parts:
            told = []
            for x in pdf.itertuples(index=False):
                if x.slot != slot:
                    slot, seqid, cached = x.slot, 0, None
                if x.seqid == seqid + 1:
                    told.append("execute")
                    seqid, cached = x.seqid, x.cached
                elif x.seqid != seqid or cached is None:
                    told.append("misordered")
                else:
                    told.append("replay" if cached else "retry_uncached")
            yield pd.DataFrame({"slot": pdf["slot"], "n": pdf["n"], "status": told})

    rows = calls.select(F.col("slot").cast("bigint"), F.col("n").cast("bigint"), F.col("seqid").cast("bigint"), "cached").where("slot IS NOT NULL AND seqid IS NOT NULL")
    return rows.repartition("slot").sortWithinPartitions("slot", "n").mapInPandas(run, "slot bigint, n bigint, status string")


def clients(calls: DataFrame) -> DataFrame:
    """Client of each call (owner, n, verifier): a new verifier makes a new one and drops the old's state."""
    w = Window.partitionBy("owner").orderBy("n")
    fresh = F.coalesce(F.lag("verifier").over(w) != F.col("verifier"), F.lit(True))
    return calls.withColumn("dropped", F.coalesce(F.lag("verifier").over(w) != F.col("verifier"), F.lit(False))).withColumn("client", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
