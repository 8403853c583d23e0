"""Trees, nets, miners, replay and alignment on models worked out by hand."""

from collections import Counter

import pytest

from tracelake.operators import conformance, core, miners, nets
from tracelake.operators.nets import Tree


def leaf(x):
    return Tree(label=x)


@pytest.mark.parametrize(
    ("variants", "tree"),
    [
        ({("a", "b"): 3}, "->( 'a', 'b' )"),
        ({("a",): 1, ("b",): 2}, "X( 'a', 'b' )"),
        ({("a", "b"): 1, ("b", "a"): 1}, "+( 'a', 'b' )"),
        ({("a",): 1, ("a", "b", "a"): 1}, "*( 'a', 'b' )"),
        ({("a", "b"): 1, ("a",): 1}, "->( 'a', X( tau, 'b' ) )"),
        ({(): 1, ("a",): 1}, "X( tau, 'a' )"),
        ({}, "tau"),
    ],
)
def test_inductive_cuts(variants, tree):
    assert str(miners.inductive(variants)) == tree


def test_inductive_model_fits_its_log():
    variants = {tuple(v): 1 for v in ("abcd", "acbd", "aed", "abcdabcd", "abd")}
    net = nets.net_of(miners.inductive(variants))
    for v in variants:
        assert nets.align(net, v)[0] < 10_000
        assert nets.replay(net, v).fits


def test_text_forms_round_trip():
    tree = Tree("->", None, (leaf("a b"), Tree("X", None, (Tree(), leaf("c"))), Tree("*", None, (leaf("d"), leaf("e")))))
    assert nets.parse_tree(str(tree)) == tree
    assert nets.read_ptml(nets.write_ptml(tree)) == tree
    net = nets.net_of(tree)
    back = nets.read_pnml(nets.write_pnml(net))
    assert [t[1:] for t in back.transitions] == [t[1:] for t in net.transitions]
    assert (back.initial, back.final, back.places) == (net.initial, net.final, net.places)


def test_replay_counts():
    net = nets.net_of(Tree("->", None, (leaf("a"), leaf("b"))))
    r = nets.replay(net, ("a", "b"))
    assert (r.missing, r.consumed, r.remaining, r.produced, r.fitness) == (0, 3, 0, 3, 1.0)
    r = nets.replay(net, ("b",))
    assert (r.missing, r.remaining, r.fits) == (1, 1, False)
    assert nets.replay(net, ("x", "a", "b")).unknown == 1


def test_searches_have_no_cap_on_states():
    n = 12  # silent steps side by side, 2^12 markings before "a"
    net = nets.Net(places=2 * n + 1, initial=Counter(range(n)), final=Counter({2 * n: 1}))
    for i in range(n):
        net.add(None, [i], [n + i])
    net.add("a", list(range(n, 2 * n)), [2 * n])
    assert nets.replay(net, ("a",)).fits
    loop = nets.Net(places=1, initial=Counter({0: 1}), final=Counter({0: 1}))
    loop.add("a", [0], [0])
    assert nets.align(loop, ("a",) * 200_001)[0] == 0


def test_alignment_costs():
    net = nets.net_of(Tree("->", None, (leaf("a"), leaf("b"), leaf("c"))))
    assert nets.align(net, ("a", "c"))[0] == 10_000
    assert nets.align(net, ("a", "x", "b", "c"))[1] == [("a", "a"), ("x", None), ("b", "b"), ("c", "c")]
    assert nets.alignment_fitness(net, ("a", "c"), nets.shortest_run(net)) == (10_000, 1 - 1 / 5)


def test_footprints_and_playout():
    net = nets.net_of(Tree("->", None, (leaf("a"), Tree("+", None, (leaf("b"), leaf("c"))))))
    f = nets.footprints(net)
    assert f["sequence"] == {("a", "b"), ("a", "c")} and f["parallel"] == {("b", "c"), ("c", "b")}
    assert f["start"] == {"a"} and f["end"] == {"b", "c"}
    runs = nets.play_out(net, 50)
    assert set(runs) == {("a", "b", "c"), ("a", "c", "b")} and runs == nets.play_out(net, 50)


def test_alpha():
    edges, starts, ends = miners.edges_of({tuple("abd"): 1, tuple("acd"): 1})
    net = miners.alpha(edges, starts, ends)
    assert net.places == 4
    assert nets.replay(net, tuple("acd")).fits and not nets.replay(net, tuple("ad")).fits


def test_rules():
    s = miners.rule_scores(tuple("abab"), ["a", "b", "c"])
    assert s["response", "a", "b"] == 1 and s["alternate_response", "a", "b"] == 1 and s["chain_response", "a", "b"] == 1
    assert s["precedence", "a", "b"] == 1 and s["chain_precedence", "a", "b"] == 1 and s["response", "b", "a"] == -1
    assert s["succession", "a", "b"] == 1 and s["existence", "c", ""] == -1 and s["absence", "c", ""] == 1
    assert ("response", "c", "a") not in s


def test_over_a_log(spark):
    log = core.from_trace_strings(spark, ["a,b", "a,b", "b"])
    net = nets.net_of(Tree("->", None, (leaf("a"), leaf("b"))))
    got = conformance.replay_fitness(conformance.token_replay(log, net)).first()
    assert got["share_fitting"] == pytest.approx(2 / 3)
    assert {r["n"]: r["cost"] for r in conformance.alignments(log, net).collect()} == {2: 0, 1: 10_000}
    assert 0 < conformance.generalization(log, net) < 1
    rules = {(r["rule"], r["a"], r["b"]) for r in miners.declare(log).collect()}
    assert ("response", "a", "b") in rules and ("existence", "b", "") in rules


def test_precision_and_trace_footprints(spark):
    log = core.from_trace_strings(spark, ["a,b", "a,c"])
    exact = nets.net_of(Tree("->", None, (leaf("a"), Tree("X", None, (leaf("b"), leaf("c"))))))
    loose = nets.net_of(Tree("->", None, (leaf("a"), Tree("X", None, (leaf("b"), leaf("c"), leaf("d"), leaf("e"))))))
    assert conformance.precision(log, exact) == 1
    assert conformance.precision(log, loose) == pytest.approx(1 - 4 / 10)
    got = conformance.trace_footprints(log, {("a", "b")}, {"a"}, {"b"}, {"a"}, 2).collect()
    assert {r["case_id"]: r["deviations"] for r in got} == {"0": 0, "1": 2}
