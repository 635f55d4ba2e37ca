"""Published tables: readers see whole states, writers do not mix."""

import pytest

from criterium.sources import published as P
from criterium.sources.shared import scratch

SCHEMA = "k string, v int"


def state(spark, path, number=None):
    return sorted((r["k"], r["v"]) for r in P.load(spark, path, SCHEMA, number).collect())


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA).repartition(3)


def test_partitions_are_replaced(spark):
    path = scratch(spark, "published")
    assert state(spark, path) == [] and P.prune(spark, path) == []
    assert P.publish(rows(spark, ("a", 1), ("a", 2), ("b", 3), ("x/y z", 4)), path, "k") == 1
    assert P.publish(rows(spark, ("a", 9), ("c", 5)), path, "k") == 2
    assert state(spark, path) == [("a", 9), ("b", 3), ("c", 5), ("x/y z", 4)]
    assert state(spark, path, 1) == [("a", 1), ("a", 2), ("b", 3), ("x/y z", 4)]
    assert P.publish(rows(spark).limit(0), path, "k") == 3 and state(spark, path) == state(spark, path, 2)
    assert len(P.prune(spark, path)) == 1 and state(spark, path) == [("a", 9), ("b", 3), ("c", 5), ("x/y z", 4)]
    assert P.publish(rows(spark, ("d", 7)), path, "k", mirror=True) == 4 and state(spark, path) == [("d", 7)]
    assert len(P.prune(spark, path)) == 4 and state(spark, path) == [("d", 7)] and P.prune(spark, path) == []


def test_a_write_that_stops_is_not_seen(spark, monkeypatch):
    path = scratch(spark, "published")
    P.publish(rows(spark, ("a", 1)), path, "k")
    with pytest.raises(Exception, match="no k"):
        P.publish(rows(spark, ("b", 2), (None, 3)), path, "k")
    assert state(spark, path) == [("a", 1)]
    monkeypatch.setattr(P, "manifest", lambda *_: (_ for _ in ()).throw(OSError("stopped")))  # after the version, before the switch
    with pytest.raises(OSError, match="stopped"):
        P.publish(rows(spark, ("a", 2)), path, "k")
    monkeypatch.undo()
    assert state(spark, path) == [("a", 1)]
    assert P.publish(rows(spark, ("c", 3)), path, "k") == 2 and state(spark, path) == [("a", 1), ("c", 3)]
    assert len(P.prune(spark, path, keep=2)) >= 1 and state(spark, path, 1) == [("a", 1)]


def test_the_first_writer_wins(spark, monkeypatch):
    path = scratch(spark, "published")
    P.publish(rows(spark, ("a", 1)), path, "k")
    monkeypatch.setattr(P, "current", lambda *_: 0)  # as seen before the other published
    with pytest.raises(P.Conflict):
        P.publish(rows(spark, ("a", 2)), path, "k")
    monkeypatch.undo()
    assert state(spark, path) == [("a", 1)] and P.current(spark, path) == 1
