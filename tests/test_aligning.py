"""Alignments by other ways against the plain one, live streams and monitors against whole traces."""

import itertools

import numpy as np
import pytest

from tracelake.operators import aligning, miners, nets
from tracelake.operators.nets import net_of, parse_tree
from tracelake.streaming import live

TREES = ["->( 'a', X( 'b', tau ), 'c' )", "+( 'a', ->( 'b', 'c' ) )", "*( 'a', 'b' )", "->( 'a', *( X( 'b', 'c' ), tau ), 'd' )"]
TRACES = [(), ("a",), ("a", "b", "c"), ("c", "a", "x"), ("b", "b", "a", "d"), ("a", "c", "b", "d")]


@pytest.mark.parametrize("text", TREES)
def test_other_ways_agree(text):
    net = net_of(parse_tree(text))
    for t in TRACES:
        cost = nets.align(net, t)[0]
        assert aligning.align_with_costs(net, t)[0] == cost
        assert aligning.align_with_costs(net, t, width=10_000)[0] == cost <= aligning.align_with_costs(net, t, width=30)[0]
        assert aligning.align_decomposed(net, t)[0] // 10_000 == cost // 10_000
        assert aligning.fits(net, t) == aligning.fits_tree(parse_tree(text), t) == (cost < 10_000)
        discounted = aligning.align_discounted(net, t, 1.0001)[0]
        assert discounted == pytest.approx(cost // 10_000, abs=0.01)
    cheap = aligning.align_with_costs(net, ("x", "a"), [1, 10_000])
    assert cheap[0] % 10_000 >= 1


def test_late_deviations_weigh_less():
    net = net_of(parse_tree("->( 'a', 'b', 'c', 'd' )"))
    early, late = (aligning.align_discounted(net, t, 1.5)[0] for t in (("x", "a", "b", "c", "d"), ("a", "b", "c", "d", "x")))
    assert early == pytest.approx(1 / 1.5) and late == pytest.approx(1.5**-5)


def test_markings_after_prefixes():
    net = net_of(parse_tree("->( 'a', X( 'b', tau ), 'c' )"))
    assert aligning.replay_prefix(net, ("a", "b", "c")) == net.final == aligning.replay_prefix(net, ("a", "c"))
    assert aligning.replay_prefix(net, ("unknown",)) == net.initial


def test_logs(spark):
    rows = [(f"c{i}", j, a) for i, v in enumerate(["abc", "ac", "abc", "acb", "xa"]) for j, a in enumerate(v)]
    log = spark.createDataFrame(rows, "case_id string, idx long, act string")
    tree = parse_tree("->( 'a', X( 'b', tau ), 'c' )")
    net = net_of(tree)
    exact = {tuple(r["seq"]): r["cost"] for r in aligning.align_log_tree(log, tree).collect()}
    assert exact == {v: nets.align(net, v)[0] for v in exact}
    bounds = aligning.align_log_subset(log, net, 2)
    for r in bounds.collect():
        assert r["lower"] <= exact[tuple(r["seq"])] <= r["upper"] + 10
    s = aligning.subset_summary(bounds, net).first()
    assert 0 <= s["least"] <= s["most"] <= 1
    assert aligning.align_log_decomposed(log, net).count() == aligning.align_log_discounted(log, net).count() == aligning.align_log_beam(log, net).count() == 4
    assert aligning.precision(log.filter("case_id in ('c0', 'c1')"), net) == 1
    assert 0 < aligning.precision(log, net_of(parse_tree("*( X( 'a', 'b', 'c', 'x' ), tau )"))) < 1


def test_live_streams():
    stream, one, two = live.LiveStream(), live.Collector(), live.Collector()
    a = stream.register(one)
    assert stream.register(one) == a != stream.register(two)
    assert stream.append(1) and one.get() == []
    stream.start()
    assert stream.append(2) and one.get() == [1, 2] and stream.deregister(a) and not stream.deregister(a)
    stream.append(3)
    stream.stop()
    stream.stop()
    assert not stream.append(4) and (one.get(), two.get()) == ([1, 2], [1, 2, 3])
    with pytest.raises(RuntimeError):
        stream.start()
    assert live.feed(iter("abc"), one) == 3
    d, got = live.Distributor(), live.Collector()
    d.register("order", got)
    d.append({"act": "pay"}, {"order": ["o1", "o2"], "item": ["i"]})
    assert [e["case_id"] for e in got.get()] == ["o1", "o2"]
    with pytest.raises(TypeError):
        d.append({}, {"order": "o1"})


def test_readers(tmp_path):
    (tmp_path / "x.xes").write_text('<log xmlns="http://www.xes-standard.org/"><trace><string key="concept:name" value="c1"/><event><string key="concept:name" value="a"/><int key="n" value="1"/></event><event><string key="concept:name" value="b"/></event></trace><trace><string key="concept:name" value="c2"/></trace></log>')
    assert [(t["concept:name"], len(e)) for t, e in live.xes_traces(f"{tmp_path}/x.xes")] == [("c1", 2), ("c2", 0)]
    assert [(e["case:concept:name"], e["concept:name"]) for e in live.xes_events(f"{tmp_path}/x.xes")] == [("c1", "a"), ("c1", "b")]
    (tmp_path / "x.csv").write_text('case_id,act\n1,"a, b"\n2,c\n1,d\n')
    assert [(c, [e["act"] for e in es]) for c, es in live.traces_of(live.csv_events(f"{tmp_path}/x.csv"))] == [("1", ["a, b", "d"]), ("2", ["c"])]


def test_rule_monitors_agree_with_whole_traces():
    rules = [("absence", "d", ""), ("exactly_one", "a", ""), ("init", "a", ""), ("precedence", "a", "b"), ("alternate_precedence", "a", "b"), ("chain_precedence", "a", "b"), ("non_responded_existence", "c", "d")]
    for n in range(5):
        for t in itertools.product("abcd", repeat=n):
            m = live.RuleMonitor(rules)
            found = {r for a in t for r in m.restore(m.state()).push(a)}
            scores = miners.rule_scores(t, list("abcd"))
            want = {f"{r}({a}{', ' + b if b else ''})" for r, a, b in rules if scores.get((r, a, b), 0) < 0 and not (r == "exactly_one" and a not in t) and not (r == "init" and not t)}
            assert found == want, t


def test_run_monitors_match_edit_costs():
    net = net_of(parse_tree("->( 'a', *( X( 'b', 'c' ), tau ), 'd' )"))
    runs = live.proxy_runs(net, 60)
    assert all(aligning.fits(net, r) for r in runs) and len(set(runs)) == len(runs)
    g = np.random.default_rng(4)
    for _ in range(40):
        t = tuple(g.choice(list("abcdx"), int(g.integers(0, 6))))
        m = live.RunMonitor(runs, 10_000, 10)
        for a in t:
            m.push(str(a))
        m.restore(m.state())
        assert m.finish() == min(aligning._indels(t, r) for r in runs)


def test_monitors_in_a_stream(spark, tmp_path):
    rows = [("1", "a", 0), ("1", "b", 1), ("2", "b", 0), ("1", "<terminate>", 2), ("2", "d", 1)]
    spark.createDataFrame(rows, "case_id string, act string, order long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("case_id string, act string, order long").parquet(f"{tmp_path}/in")
    for name, df in (("breaches", live.rule_breaches(stream, [("precedence", "a", "b")])), ("costs", live.run_costs(stream, [("a", "b")]))):
        q = live.collected(df, name)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert [tuple(r) for r in spark.table("breaches").collect()] == [("2", "precedence(a, b)")]
    assert sorted(map(tuple, spark.table("costs").collect())) == [("1", 0.0, False), ("1", 0.0, False), ("1", 0.0, True), ("2", 1.0, False), ("2", 2.0, False)]
    seen = []
    q = live.delivered(stream, lambda df: seen.append(df.count()))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sum(seen) == 5
