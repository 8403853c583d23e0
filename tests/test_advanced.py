"""Dependency nets, playout and alignment of edge graphs, noise, clusters."""

from collections import Counter

import pytest

from tracelake.operators import advanced, core, miners, nets


def log_of(spark, *strings):
    return core.from_trace_strings(spark, list(strings))


def test_heuristics_net(spark):
    got = {(r["source"], r["target"], r["kind"]): r["dependency"] for r in advanced.heuristics_net(log_of(spark, *["a,b,c"] * 9, "a,c", "a,b,a,c"), noise=0.0).collect()}
    assert got["a", "b", "edge"] == pytest.approx((10 - 1) / (10 + 1 + 1))
    assert ("a", "c", "edge") in got and got["a", "b", "loop2"] == pytest.approx(0.5)


def test_graph_playout_and_alignment():
    edges, starts, ends = miners.edges_of({tuple("ab"): 3, tuple("ac"): 1})
    assert advanced.play_out_graph(edges, starts, ends) == [(("a", "b"), pytest.approx(0.75)), (("a", "c"), pytest.approx(0.25))]
    net = advanced.net_of_graph(edges, starts, ends)
    assert nets.align(net, tuple("ab"))[0] == 1
    assert nets.align(net, tuple("b"))[0] == 10_001


def test_edit_alignment(spark):
    models = [tuple("abc"), tuple("xyz")]
    assert advanced.edit_alignment(tuple("abd"), models) == (1, [("a", "a"), ("b", "b"), ("d", None), (None, "c")])
    assert {r["distance"] for r in advanced.edit_alignments(log_of(spark, "a,b,c", "x,y"), models).collect()} == {0, 1}


def test_noisy_variants(spark):
    log = log_of(spark, *["a,b"] * 400, *["a"] * 200)
    got = Counter(dict(advanced.noisy_variants(log, epsilon=2.0, depth=3)))
    assert set(got) == {("a",), ("a", "b")} and abs(got["a", "b"] - 400) < 20


def test_clusters_and_profiles(spark):
    log = log_of(spark, "a,b", "a,b", "x,y", "x,y,x")
    got = {r["case_id"]: r["cluster"] for r in advanced.cluster_cases(log).collect()}
    assert got["0"] == got["1"] != got["2"] == got["3"]
    assert {r["case_id"]: set(r["profile"]) for r in advanced.trace_profiles(log).collect()}["0"] == {"a", "b", "a#b"}
    assert {r["share"] for r in advanced.ordered_position(log_of(spark, "a,b")).collect()} == {0.0, 1.0}
