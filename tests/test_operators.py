"""Literal cases of operators that the tables don't reach."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftwood.functions import lineage, scalars
from driftwood.operators import cas, command, conflict, journal, overlay, tree
from driftwood.sources import discovery


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_names_are_measured_in_bytes(spark):
    rows = spark.createDataFrame([("a" * 255,), ("a" * 256,), ("é" * 127,), ("é" * 128,), (".",), ("..",), ("a/b",), ("",), (None,), ("a\0b",)], "n string").select(journal.name_reason(F.col("n"))).collect()
    assert [r[0] for r in rows] == [None, "long", None, "long", "dots", "dots", "slash", "empty", "empty", "nul"]


def test_fingerprint_of_a_known_row(spark):
    v = [F.lit(x) for x in (1700000000, 500, 42, 7)]
    assert one(spark, scalars.content_fingerprint(*v))[0] == 6449874321128889074


def test_conflict_window_is_open_at_five_seconds(spark):
    rows = [(1, 1, "guest", 0, 1), (1, 1, "host", 4_999_000, 2), (1, 2, "guest", 0, 3), (1, 2, "host", 5_000_000, 4)]
    got = conflict.conflicts(spark.createDataFrame(rows, "share int, node int, side string, us bigint, seq int")).collect()
    assert [(r["node"], r["kind"]) for r in got] == [(1, "host-over-guest")]


def test_eviction_uses_protected_rows_only_over_the_hard_cap(spark):
    rows = spark.createDataFrame([("a", 50, 0), ("b", 50, 950), ("c", 50, 990)], "hash string, len bigint, last bigint")
    got = lambda cap: sorted((r["hash"], r["pass"]) for r in cas.evict(rows, 1000, cap).collect())
    assert got(1000) == []
    assert got(155) == [("a", 1)]
    assert got(60) == [("a", 1), ("b", 2)]


def test_overlay_write_fills_with_zeros_and_caps_rows(spark):
    lit = lambda b: F.lit(bytearray(b))
    assert bytes(one(spark, overlay.write(lit(b"ab"), F.lit(4), lit(b"xy")))[0]) == b"ab\0\0xy"
    assert bytes(one(spark, overlay.write(lit(b"abcdef"), F.lit(1), lit(b"ZZ")))[0]) == b"aZZdef"
    assert one(spark, overlay.write(lit(b"a"), F.lit(1 << 20), lit(b"x")))[0] is None


def test_lease_file(spark):
    text = "{\n\tname=a\n\tip_address=192.168.64.2\n}\n{\n\tip_address=bad\n}\n{\n\tip_address=192.168.64.3\n}\n"
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "file string, no int, line string")
    assert sorted((r["name"] or "", r["ip"]) for r in discovery.leases(lines).collect()) == [("", "192.168.64.3"), ("a", "192.168.64.2")]


def test_address_table_and_services(spark):
    arp = ["? (192.168.64.2) at 1:2 on bridge100", "? (192.168.64.2) at 1:2", "? (incomplete) at x", "none"]
    lines = lambda xs: spark.createDataFrame([("f", i, x) for i, x in enumerate(xs)], "file string, no int, line string")
    assert [r["ip"] for r in discovery.arp(lines(arp)).collect()] == ["192.168.64.2"]
    listing = ["Timestamp A/R Flags if Domain Service Type Instance Name", "10:00 Add 2 6 local. _x._tcp. my box one", "10:01 Rmv 2 6 local. _x._tcp. gone"]
    assert [r["instance"] for r in discovery.browse(lines(listing), "_x._tcp").collect()] == ["my box one"]
    told = ["10:00 a._x._tcp.local. can be reached at box.local.:7000 (interface 6)", " uuid=00112233-4455-6677-8899-aabbccddeeff v=1"]
    r = discovery.resolve(lines(told), 1).first()
    assert (r["host"], r["port"], r["uuid"]) == ("box.local", 7000, "00112233445566778899aabbccddeeff")


def test_walker(spark, tmp_path):
    from driftwood.sources.walker import TreeSource

    (tmp_path / "src/sub").mkdir(parents=True)
    (tmp_path / "src/sub/deep.txt").write_text("abc")
    (tmp_path / "empty").mkdir()
    (tmp_path / "README").write_text("x")
    (tmp_path / "link").symlink_to("README")
    spark.dataSource.register(TreeSource)
    rows = spark.read.format("tree_walk").option("path", str(tmp_path)).load().collect()
    assert sorted((r["name"], r["kind"]) for r in rows) == [("README", "file"), ("deep.txt", "file"), ("empty", "dir"), ("link", "symlink"), ("src", "dir"), ("sub", "dir")]
    assert next(r["target"] for r in rows if r["name"] == "link") == "README"


def chain(spark, n):
    return spark.createDataFrame([(i, f"d{i}", i + 1, "dir", 0) for i in range(1, n + 1)], "parent_ino bigint, name string, ino bigint, kind string, size bigint").coalesce(1)


def test_paths_of_a_deeper_tree_are_an_error(spark):
    assert tree.paths(chain(spark, 4), max_depth=4).count() == 5
    with pytest.raises(RuntimeError, match="below 3 levels"):
        tree.paths(chain(spark, 4), max_depth=3)


def test_garbage_below_any_depth_goes(spark, monkeypatch):
    monkeypatch.setattr(tree, "range", lambda *_: [0, 1], raising=False)  # a bound on rounds would be two
    t = chain(spark, 6)
    assert tree.collect_garbage(t, t.where("parent_ino = 1").select("parent_ino", "name")).count() == 0


def test_resolve_tells_each_path_once_and_misses_by_their_longest_known_prefix(spark):
    known = spark.createDataFrame([("/", 1, "dir"), ("/a", 2, "dir"), ("/a/b", 3, "dir"), ("/a/b/f", 4, "file"), ("/g", 5, "file")], "path string, ino bigint, kind string")
    told = {
        "/": (1, "ok"), "//": (1, "ok"), "": (1, "ok"), "/a/b/": (3, "ok"), "//a//b/f": (4, "ok"), "/a/../g": (None, "badpath"), "/.": (None, "badpath"), "/a/b/f/x": (None, "notdir"), "/a/b/f/x/y/z": (None, "notdir"), "/g/": (5, "ok"), "/g/x/y": (None, "notdir"),
        "/a/bx": (None, "noent"), "/x": (None, "noent"), "/x/y/z": (None, "noent"), "/a/q/b/f": (None, "noent"), "/gx/y": (None, "noent"), None: (None, "noent"),
    }
    got = tree.resolve(known, spark.createDataFrame([(p,) for p in told] * 2, "path string")).collect()
    assert len(got) == len(told) and {r["path"]: (r["ino"], r["status"]) for r in got} == told


def test_copies_let_go_the_shuffles_of_earlier_ones(spark):
    # The number of shuffles that Spark tracks doesn't grow with the levels of a tree.
    def shuffles(depth):
        t = spark.createDataFrame([(d, f"n{i}", d + 1 if i == 0 else 1000 * d + i, "dir" if i == 0 else "file", 0) for d in range(1, depth + 1) for i in range(3)], "parent_ino bigint, name string, ino bigint, kind string, size bigint")
        tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
        peak, real = [], tree.durable

        def counted(df):
            out = real(df)
            peak.append(tracker.shuffleStatuses().size())
            return out

        tree.durable = counted
        try:
            tree.paths(t, 1).collect()
        finally:
            tree.durable = real
        return max(peak) - peak[0]

    assert shuffles(10) <= 8


def left_behind(spark, run):
    """Names that ``run`` leaves in the checkpoint folder, and its rows."""
    folder = Path(lineage.shared_folder(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    rows = run().collect()
    return {p.name for p in folder.iterdir()} - before, rows


def test_climbing_keeps_one_copy_however_deep(spark):
    loose = spark.createDataFrame([(90, "x", 91, "dir", 0), (91, "y", 90, "dir", 0)], "parent_ino bigint, name string, ino bigint, kind string, size bigint")
    t = chain(spark, 6).unionByName(loose)
    left, rows = left_behind(spark, lambda: tree.path_of(t, t.select("ino").unionByName(spark.createDataFrame([(1,), (77,)], "ino bigint")), max_depth=9))
    told = {r["ino"]: r["path"] for r in rows}
    assert told == {1: "/", 77: None, 90: None, 91: None} | {i + 1: "".join(f"/d{j}" for j in range(1, i + 1)) for i in range(1, 7)}
    assert len(left) == 1


def test_garbage_keeps_no_copies_of_what_is_left(spark):
    t = chain(spark, 6).unionByName(spark.createDataFrame([(1, "hard", 5, "dir", 0)], chain(spark, 1).schema))
    left, rows = left_behind(spark, lambda: tree.collect_garbage(t, t.where("name = 'd1'").select("parent_ino", "name")))
    assert sorted((r["parent_ino"], r["name"]) for r in rows) == [(1, "hard"), (5, "d5"), (6, "d6")]
    # The names removed and the nodes of each of the four rounds.
    assert len(left) <= 5


def test_ls_looks_among_paths_as_deep_as_the_wanted_ones(spark):
    known = spark.createDataFrame([("/", 1, "dir"), ("/a", 2, "dir"), ("/g", 3, "file"), ("/a/b", 4, "dir"), ("/a/b/f", 5, "file")], "path string, ino bigint, kind string")
    asked = spark.createDataFrame([("//a/",), ("/g",), ("//a/b/f",), ("/a/q",)], "path string")
    seen = []
    real, command.trees.resolve = command.trees.resolve, lambda p, w: (seen.extend(r["path"] for r in p.collect()), real(p, w))[1]
    try:
        entries = spark.createDataFrame([(1, "a", 2, "dir", 3), (1, "g", 3, "file", 4), (2, "b", 4, "dir", 3), (2, "z", 6, "file", 4), (4, "f", 5, "file", 3)], "parent_ino bigint, name string, ino bigint, kind string, cookie bigint")
        attrs = spark.createDataFrame([(2, 0), (3, 30), (4, 0), (5, 50)], "ino bigint, size bigint")
        got = command.ls(known, entries, attrs, asked.where("path <> '/a/q'"), 1)
    finally:
        command.trees.resolve = real
    assert sorted(tuple(r) for r in got.collect()) == [("//a/", 1, "b", "dir", 0, True), ("//a/b/f", 1, "f", "file", 50, False), ("/g", 1, "g", "file", 30, False)]
    assert sorted(seen) == ["/", "/a", "/a/b/f", "/g"]
