"""Registered queries of attributes, variants and times beyond plain counts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import aligning, attributes, bpmn, core, declarative, discovery, graphs, logs, miners, nets, ocel, petri, powl, stats, trees
from tracelake.plans.catalog import DF_L, INTER, QUERIES, NEXT, SQL_C, SQL_E, SQL_I, SQL_L, SQL_O, SQL_T, C, E, I, L, O, add, joined, rounded


def names(spark, found: dict[str, list[str]]):
    return spark.createDataFrame(sorted((k, c) for k, v in found.items() for c in v), "kind string, name string")


add("event_attributes", lambda s, d: names(s, {"event": attributes.event_attributes(I(s, d))}), "SELECT * FROM (VALUES ('event', 'act'), ('event', 'res'), ('event', 'start_ts'), ('event', 'ts')) v(kind, name)")
add("trace_attributes", lambda s, d: names(s, {"case": attributes.trace_attributes(L(s, d).withColumn("case_size", F.lit(1)))}), "SELECT 'case' AS kind, 'case_size' AS name")
TIMES = "list_reduce(list(n ORDER BY n DESC), lambda t, v: CASE WHEN v > t * 0.6 THEN v ELSE t END)"
add("attributes_threshold", lambda s, d: s.createDataFrame([(attributes.threshold(sorted((r["n"] for r in L(s, d).groupBy("act").agg(F.count("*").alias("n")).collect()), reverse=True), 0.6),)], "cutoff long"), f"WITH {SQL_L}, k AS (SELECT count(*) AS n FROM ev GROUP BY act) SELECT {TIMES} AS cutoff FROM k")
add("start_activities_threshold", lambda s, d: s.createDataFrame([(attributes.threshold(sorted((r["n"] for r in L(s, d).filter("idx = 0").groupBy("act").agg(F.count("*").alias("n")).collect()), reverse=True), 0.6),)], "cutoff long"), f"WITH {SQL_L}, k AS (SELECT count(*) AS n FROM ev WHERE idx = 0 GROUP BY act) SELECT {TIMES} AS cutoff FROM k")
add("attribute_in_every_case", lambda s, d: s.createDataFrame([(c, attributes.in_every_case(L(s, d).withColumn("odd", F.when(F.col("idx") > 0, F.col("act"))), c)) for c in ("res", "odd")], "name string, there boolean"), f"WITH {SQL_L}, p AS (SELECT bool_or(res IS NOT NULL) AS a, bool_or(idx > 0) AS b FROM ev GROUP BY case_id) SELECT 'res' AS name, bool_and(a) AS there FROM p UNION ALL SELECT 'odd', bool_and(b) FROM p")
add("present_in_every_case", lambda s, d: names(s, {"event": attributes.present_in_every_case(L(s, d).withColumn("odd", F.when(F.col("idx") > 0, F.col("act"))), ["act", "odd", "quantity"])}), f"WITH {SQL_L}, p AS (SELECT bool_or(act IS NOT NULL) AS a, bool_or(idx > 0) AS b, bool_or(quantity IS NOT NULL) AS c FROM ev GROUP BY case_id) SELECT 'event' AS kind, name FROM (SELECT 'act' AS name, bool_and(a) AS t FROM p UNION ALL SELECT 'odd', bool_and(b) FROM p UNION ALL SELECT 'quantity', bool_and(c) FROM p) WHERE t")
add("select_for_tree", lambda s, d: names(s, attributes.select_for_tree(L(s, d), 50, 8)), f"WITH {SQL_L}, k AS (SELECT count(DISTINCT act) AS a, count(DISTINCT res) AS r FROM ev) SELECT 'text_event' AS kind, 'act' AS name FROM k WHERE a < 8 UNION ALL SELECT 'text_event', 'res' FROM k WHERE r < 8 UNION ALL SELECT 'number_event', 'quantity' WHERE (SELECT bool_and(q) FROM (SELECT bool_or(quantity IS NOT NULL) AS q FROM ev GROUP BY case_id))")
add("profile_attributes", lambda s, d: names(s, attributes.profile_attributes(L(s, d))), f"WITH {SQL_L}, k AS (SELECT count(DISTINCT act) AS a, count(DISTINCT res) AS r FROM ev) SELECT 'text' AS kind, 'act' AS name FROM k WHERE a < 12.5 UNION ALL SELECT 'text', 'res' FROM k WHERE r < 12.5 UNION ALL SELECT 'number', 'quantity'")
add("activity_labels", lambda s, d: attributes.activity_labels(L(s, d)), f"WITH {SQL_L} SELECT DISTINCT act FROM ev")

DENSE = "s AS (SELECT count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h, min(v) AS lo, max(v) AS hi FROM vals), c AS (SELECT v, count(*) AS m FROM vals GROUP BY 1)"
KERNEL = "sum(m * exp(-0.5 * pow((x - v) / h, 2))) / (n * h * sqrt(2 * pi()))"
add("kde_date_attribute", lambda s, d: attributes.date_density(L(s, d)).select(F.round("x", 2).alias("x"), F.round(F.col("density") * 1e9, 4).alias("density")), f"WITH {SQL_L}, vals AS (SELECT s AS v FROM ev), {DENSE}, g AS (SELECT lo + i * (hi - lo) / 49 AS x, h, n FROM s, (SELECT unnest(range(0, 50)) AS i)) SELECT round(x, 2) AS x, round({KERNEL} * 1e9, 4) AS density FROM g, c GROUP BY x, h, n")
add("kde_case_duration", lambda s, d: attributes.duration_density(L(s, d)).select(F.round("x", 2).alias("x"), F.round(F.col("density") * 1e9, 4).alias("density")).distinct(), f"WITH {SQL_L}, vals AS (SELECT arg_max(s, idx) - arg_min(s, idx) AS v FROM ev GROUP BY case_id), {DENSE}, g AS (SELECT DISTINCT * FROM (SELECT lo + i * (hi - lo) / 24.0 AS x, h, n FROM s, (SELECT unnest(range(0, 25)) AS i) UNION ALL SELECT greatest(lo, 0.000001) * pow(hi / greatest(lo, 0.000001), i / 24.0), h, n FROM s, (SELECT unnest(range(0, 25)) AS i))) SELECT DISTINCT round(x, 2) AS x, round(k * 1e9, 4) AS density FROM (SELECT x, {KERNEL} AS k FROM g, c GROUP BY x, h, n)")

add("variant_cases", lambda s, d: joined(attributes.variant_cases(C(s, d))), f"WITH {SQL_C}, {SQL_T} SELECT array_to_string(seq, '>') AS seq, case_id FROM tr")
add("split_by_variant", lambda s, d: joined(attributes.split_by_variant(C(s, d)), "variant").groupBy("variant", "act").agg(F.count("*").alias("n")), f"WITH {SQL_C}, {SQL_T} SELECT array_to_string(seq, '>') AS variant, act, count(*) AS n FROM ev JOIN tr USING (case_id) GROUP BY 1, 2")
add("variants_with_durations", lambda s, d: joined(attributes.variants_with_durations(L(s, d))), f"WITH {SQL_L}, {SQL_T}, c AS (SELECT case_id, arg_max(s, idx) - arg_min(s, idx) AS duration FROM ev GROUP BY 1) SELECT case_id, array_to_string(seq, '>') AS seq, duration FROM tr JOIN c USING (case_id)")
add("frequent_segments", lambda s, d: attributes.frequent_segments(C(s, d), 8), f"WITH RECURSIVE {SQL_C}, r(case_id, segment, pos) AS (SELECT case_id, '...>' || act || '>...', min(idx) FROM ev GROUP BY case_id, act UNION ALL SELECT r.case_id, r.segment || '>' || e.act || '>...', e.idx FROM r JOIN ev e ON e.case_id = r.case_id AND e.idx > r.pos WHERE NOT EXISTS (SELECT 1 FROM ev x WHERE x.case_id = e.case_id AND x.act = e.act AND x.idx > r.pos AND x.idx < e.idx)) SELECT segment, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 8")
NEAR = "nx AS (SELECT a.case_id, a.idx AS i, a.act AS source, a.e AS \"begin\", min(b.idx) AS j FROM ev a JOIN ev b ON a.case_id = b.case_id AND b.idx > a.idx AND b.b >= a.e GROUP BY 1, 2, 3, 4), fo AS (SELECT nx.*, ev.act AS target, ev.b AS \"end\" FROM nx JOIN ev ON ev.case_id = nx.case_id AND ev.idx = nx.j)"
add("time_intervals", lambda s, d: attributes.time_intervals(I(s, d), "start_ts"), f"WITH {SQL_I}, {NEAR} SELECT case_id, i, j, \"begin\", \"end\" FROM fo")
add("time_intervals_of_couple", lambda s, d: attributes.time_intervals(L(s, d), "ts", ("AF", "RF")), f"WITH {SQL_L}, ev2 AS (SELECT *, s AS b, s AS e FROM ev), {NEAR.replace('FROM ev ', 'FROM ev2 ').replace('JOIN ev ', 'JOIN ev2 ').replace('ev.', 'ev2.')} SELECT case_id, i, j, \"begin\", \"end\" FROM fo WHERE source = 'AF' AND target = 'RF'")
add("variants_paths_durations", lambda s, d: rounded(joined(attributes.paths_durations(I(s, d), "start_ts")), "mean", "median", places=3), f"WITH {SQL_I}, {SQL_T}, {NEAR}, p AS (SELECT *, \"end\" - \"begin\" AS d, row_number() OVER (PARTITION BY case_id, source, target ORDER BY i) - 1 AS k FROM fo), n AS (SELECT seq, count(*) AS n FROM tr GROUP BY 1) SELECT array_to_string(seq, '>') AS seq, n, i AS position, min(k) AS occurrence, round(avg(d), 3) AS mean, round(median(d), 3) AS median, min(d) AS min, max(d) AS max, sum(d) AS sum FROM p JOIN tr USING (case_id) JOIN n USING (seq) GROUP BY 1, 2, 3")
add("interval_event_overlap", lambda s, d: attributes.event_overlap(I(s, d)), f"WITH {SQL_I}, st AS (SELECT b AS t, sum(count(*)) OVER (ORDER BY b) AS n FROM ev GROUP BY b), en AS (SELECT e AS t, sum(count(*)) OVER (ORDER BY e) AS n FROM ev GROUP BY e) SELECT case_id, idx, CAST(st.n - coalesce(en.n, 0) AS BIGINT) AS overlap FROM ev ASOF JOIN st ON ev.e >= st.t ASOF LEFT JOIN en ON ev.b > en.t")
RATE = "c AS (SELECT case_id, min(s) AS f, max(s) AS l FROM ev GROUP BY 1), q AS (SELECT case_id, coalesce(f - lag(f) OVER (ORDER BY f, case_id), 0) AS arrival_rate, coalesce(l - lag(l) OVER (ORDER BY l, case_id), 0) AS finish_rate FROM c)"
add("arrival_finish_rate", lambda s, d: attributes.arrival_finish_rate(E(s, d)).select("case_id", "idx", F.round("arrival_rate", 4).alias("arrival_rate"), F.round("finish_rate", 4).alias("finish_rate")), f"WITH {SQL_E}, {RATE} SELECT case_id, idx, round(arrival_rate, 4) AS arrival_rate, round(finish_rate, 4) AS finish_rate FROM ev JOIN q USING (case_id)")
add("outcome_enriched", lambda s, d: attributes.outcome_enriched(L(s, d), L(s, d).groupBy("case_id").agg(F.max(F.col("act") == "RF").cast("int").alias("has_RF"))).select("case_id", "idx", "diff_start_end", "arrival_rate", "finish_rate", "service", "sojourn", "waiting", "has_RF"), f"WITH {SQL_L}, {RATE} SELECT case_id, idx, 0.0 AS diff_start_end, arrival_rate, finish_rate, 0.0 AS service, l - f AS sojourn, l - f AS waiting, CAST(max(CASE WHEN act = 'RF' THEN 1 ELSE 0 END) OVER (PARTITION BY case_id) AS INT) AS \"has_RF\" FROM ev JOIN c USING (case_id) JOIN q USING (case_id)")
add("network_analysis_performance", lambda s, d: rounded(attributes.network_durations(L(s, d), "act", "act", "res"), "mean", places=3), f"WITH {SQL_L}, p AS (SELECT act AS source, lead(act) OVER w AS target, act AS edge, lead(s) OVER w - s AS d FROM ev WINDOW w AS (PARTITION BY res ORDER BY ts, case_id, idx)) SELECT source, target, edge, count(*) AS n, round(avg(d), 3) AS mean, min(d) AS min, max(d) AS max, sum(d) AS sum FROM p WHERE target IS NOT NULL GROUP BY 1, 2, 3")
add("dotted_chart_points", lambda s, d: attributes.dotted_points(L(s, d)).select(F.unix_seconds("x").alias("x"), "y", "colour"), f"WITH {SQL_L} SELECT CAST(s AS BIGINT) AS x, case_id AS y, act AS colour FROM ev")
add("performance_spectrum", lambda s, d: attributes.performance_spectrum(L(s, d), ["AF", "RF"], 1 << 30).select(F.col("times")[0].alias("t0"), F.col("times")[1].alias("t1")), f"WITH {SQL_L}, p AS (SELECT act, s AS t0, lead(act) OVER w AS nx, lead(s) OVER w AS t1 FROM ev WHERE act IN ('AF', 'RF') WINDOW w AS (PARTITION BY case_id ORDER BY ts, idx)) SELECT t0, t1 FROM p WHERE act = 'AF' AND nx = 'RF'")

# Object-centric
SIZES = "SELECT 'events' AS part, count(DISTINCT eid) AS n FROM k UNION ALL SELECT 'objects', count(DISTINCT oid) FROM k"
sizes = lambda x: ocel.summary(x).filter("part in ('events', 'objects')")
add("ocel_filter_event_attribute", lambda s, d: sizes(ocel.event_attribute(O(s, d), "quantity", [1.0, 2.0, 3.0])), f"WITH {SQL_O}, q AS (SELECT strftime(l_shipdate, '%Y%m%d') || '-' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') AS eid, min(l_quantity) AS q FROM lineitem GROUP BY 1), k AS (SELECT rel.* FROM rel JOIN q USING (eid) WHERE q IN (1, 2, 3)) {SIZES}")
add("ocel_filter_object_attribute", lambda s, d: sizes(ocel.object_attribute(O(s, d), "priority", ["1-URGENT"])), f"WITH {SQL_O}, k AS (SELECT rel.* FROM rel JOIN orders ON oid = 'o' || o_orderkey WHERE o_orderpriority = '1-URGENT') {SIZES}")
add("ocel_filter_object_attribute_exclude", lambda s, d: ocel.object_attribute(O(s, d), "priority", ["1-URGENT"], False).objects.groupBy("type").agg(F.count("*").alias("n")), f"WITH {SQL_O}, ob AS (SELECT DISTINCT oid, type FROM rel UNION SELECT 'c' || o_custkey, 'customer' FROM orders) SELECT type, count(*) AS n FROM ob WHERE oid NOT IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
add("ocel_is_ocel20", lambda s, d: s.createDataFrame([(ocel.is_ocel20(O(s, d)),)], "is_ocel20 boolean"), "SELECT count(*) > 0 AS is_ocel20 FROM orders")
add("ocel_consistent", lambda s, d: ocel.summary(ocel.consistent(O(s, d))), f"WITH {SQL_O}, ob AS (SELECT DISTINCT oid FROM rel UNION SELECT 'c' || o_custkey FROM orders) SELECT 'events' AS part, count(DISTINCT eid) AS n FROM x UNION ALL SELECT 'objects', count(*) FROM ob UNION ALL SELECT 'relations', 3 * count(*) FROM x UNION ALL SELECT 'o2o', count(*) FROM orders")
add("ocel_object_types", lambda s, d: ocel.object_types(O(s, d)), "SELECT unnest(['order', 'part', 'supplier', 'customer']) AS type")
add("ocel_attribute_names", lambda s, d: s.createDataFrame([(c,) for c in ocel.attribute_names(O(s, d))], "name string"), "SELECT unnest(['priority', 'quantity']) AS name")
add("ocel_o2o_enrichment", lambda s, d: ocel.o2o_enrichment(O(s, d), ("interaction", "inheritance")).o2o.groupBy("qualifier").agg(F.count("*").alias("n")), f"WITH {SQL_O}, {INTER}, pr AS (SELECT bo.oid, bo.oid2, a.f AS f1, b.f AS f2 FROM bo JOIN life a ON a.oid = bo.oid JOIN life b ON b.oid = bo.oid2) SELECT 'placed by' AS qualifier, count(*) AS n FROM orders UNION ALL SELECT 'interaction_graph', count(*) FROM bo UNION ALL SELECT 'inheritance_graph', count(*) FROM pr WHERE CASE WHEN f1 < f2 THEN TRUE ELSE FALSE END")
add("ocel_merge_duplicates", lambda s, d: ocel.summary(ocel.merge_duplicates(O(s, d))).filter("part in ('events', 'relations')"), f"WITH {SQL_O}, m AS (SELECT DISTINCT act, s FROM rel) SELECT 'events' AS part, count(*) AS n FROM m UNION ALL SELECT 'relations', count(*) FROM (SELECT DISTINCT act, s, oid FROM rel)")
add("ocel_sort_by_additional_column", lambda s, d: ocel.sorted_by(O(s, d), "quantity").limit(200).select("eid"), f"WITH {SQL_O}, q AS (SELECT x.eid, min(s) AS s, min(l_quantity) AS q FROM x JOIN lineitem ON x.eid = strftime(l_shipdate, '%Y%m%d') || '-' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') GROUP BY 1) SELECT eid FROM q ORDER BY s, q, eid LIMIT 200")
add("ocel_of_log", lambda s, d: ocel.summary(ocel.of_log(L(s, d), ["case_id", "res"])).filter("part != 'o2o'"), f"WITH {SQL_L}, o AS (SELECT case_id AS v FROM ev UNION SELECT res FROM ev) SELECT 'events' AS part, count(*) AS n FROM ev UNION ALL SELECT 'objects', (SELECT count(*) FROM o) UNION ALL SELECT 'relations', sum(CASE WHEN case_id = res THEN 1 ELSE 2 END) FROM ev")
add("ocel_graph_nodes", lambda s, d: ocel.graph_tables(O(s, d))[0].groupBy("kind", "label").agg(F.count("*").alias("n")), f"WITH {SQL_O}, ob AS (SELECT DISTINCT oid, type FROM rel UNION SELECT 'c' || o_custkey, 'customer' FROM orders) SELECT 'EVENT' AS kind, act AS label, count(DISTINCT eid) AS n FROM x GROUP BY 2 UNION ALL SELECT 'OBJECT', type, count(*) FROM ob GROUP BY 2 UNION ALL SELECT 'CHANGE', 'status', count(*) FROM orders")
add("ocel_graph_edges", lambda s, d: ocel.graph_tables(O(s, d))[1].groupBy("kind").agg(F.count("*").alias("n")), f"WITH {SQL_O}, {NEXT} SELECT 'E2O' AS kind, 3 * count(*) AS n FROM x UNION ALL SELECT 'O2O', count(*) FROM orders UNION ALL SELECT 'DF', count(*) FROM nx WHERE target IS NOT NULL UNION ALL SELECT 'CHANGE', count(*) FROM orders")
add("ocel_feature_graph", lambda s, d: ocel.feature_graph(O(s, d), ("interaction", "cobirth", "codeath")).groupBy("kind").agg(F.count("*").alias("n")), f"WITH {SQL_O}, {INTER}, p AS (SELECT oid, oid2, 0 AS k FROM ia UNION ALL SELECT a.oid, b.oid, 1 FROM life a JOIN life b ON a.f = b.f AND a.oid < b.oid UNION ALL SELECT a.oid, b.oid, 2 FROM life a JOIN life b ON a.l = b.l AND a.oid < b.oid), m AS (SELECT oid, oid2, max(k) AS k FROM p GROUP BY 1, 2) SELECT ['INTERACTION', 'COBIRTH', 'CODEATH'][k + 1] AS kind, count(*) AS n FROM m GROUP BY 1")
MEAS = "ra AS (SELECT act, count(DISTINCT eid) AS n FROM rel GROUP BY 1), rf AS (SELECT source, target, count(DISTINCT type || '|' || eid || '|' || eid2) AS n FROM nx WHERE target IS NOT NULL GROUP BY 1, 2), rel2 AS (SELECT * FROM rel WHERE s BETWEEN epoch(TIMESTAMP '1994-01-01') AND epoch(TIMESTAMP '1999-01-01')), nx2 AS (SELECT type, act AS source, eid, lead(act) OVER w AS target, lead(eid) OVER w AS eid2 FROM rel2 WINDOW w AS (PARTITION BY type, oid ORDER BY eid)), wa AS (SELECT act, count(DISTINCT eid) AS n FROM rel2 GROUP BY 1), wf AS (SELECT source, target, count(DISTINCT type || '|' || eid || '|' || eid2) AS n FROM nx2 WHERE target IS NOT NULL GROUP BY 1, 2)"
add("ocel_ocdfg_conformance", lambda s, d: rounded(ocel.ocdfg_conformance(ocel.ocdfg_measures(O(s, d)), ocel.ocdfg_measures(ocel.in_time(O(s, d), "1994-01-01", "1999-01-01"))), "fitness", places=9), f"WITH {SQL_O}, {NEXT}, {MEAS}, a AS (SELECT coalesce(ra.n, 0) AS f, coalesce(wa.n, 0) AS w, ra.act AS x, wa.act AS y FROM ra FULL JOIN wa ON ra.act = wa.act), b AS (SELECT coalesce(rf.n, 0) AS f, coalesce(wf.n, 0) AS w, rf.source AS x, wf.source AS y FROM rf FULL JOIN wf ON rf.source = wf.source AND rf.target = wf.target), u AS (SELECT count(*) AS size, count(*) FILTER (WHERE x IS NULL) AS mi, count(*) FILTER (WHERE y IS NULL) AS ad, count(*) FILTER (WHERE f <> w) AS de FROM a), v AS (SELECT count(*) AS size, count(*) FILTER (WHERE x IS NULL) AS mi, count(*) FILTER (WHERE y IS NULL) AS ad, count(*) FILTER (WHERE f <> w) AS de FROM b) SELECT u.mi AS missing_activities, v.mi AS missing_flows, u.ad AS additional_activities, v.ad AS additional_flows, u.de AS deviating_activities, v.de AS deviating_flows, round(1 - (u.mi + v.mi + u.de + v.de) / (2.0 * u.size + 2.0 * v.size), 9) AS fitness FROM u, v")

# Declarative conformance and footprints
RULES = [("init", "user", ""), ("existence", "assistant", ""), ("response", "user", "assistant"), ("precedence", "system", "user"), ("exactly_one", "system", "")]
add("declare_conformance", lambda s, d: joined(joined(rounded(declarative.declare_conformance(C(s, d), RULES), "fitness", places=9)), "broken"), f"WITH {SQL_C}, {SQL_T}, p AS (SELECT case_id, min(idx) FILTER (WHERE act = 'user') AS u0, max(idx) FILTER (WHERE act = 'user') AS u1, max(idx) FILTER (WHERE act = 'assistant') AS a1, min(idx) FILTER (WHERE act = 'system') AS s0, count(*) FILTER (WHERE act = 'system') AS ns FROM ev GROUP BY 1), b AS (SELECT array_to_string(seq, '>') AS seq, list_filter([CASE WHEN seq[1] <> 'user' THEN 'init(user)' END, CASE WHEN a1 IS NULL THEN 'existence(assistant)' END, CASE WHEN u0 IS NOT NULL AND NOT coalesce(u1 < a1, FALSE) THEN 'response(user, assistant)' END, CASE WHEN u0 IS NOT NULL AND NOT coalesce(s0 < u0, FALSE) THEN 'precedence(system, user)' END, CASE WHEN ns > 1 THEN 'exactly_one(system)' END], lambda x: x IS NOT NULL) AS broken FROM p JOIN tr USING (case_id)) SELECT seq, count(*) AS n, array_to_string(any_value(broken), '>') AS broken, any_value(len(broken)) AS deviations, round(any_value(1 - len(broken) / 5.0), 9) AS fitness FROM b GROUP BY 1")
SKELETON = [("equivalence", "user", "assistant"), ("always_after", "user", "assistant"), ("always_before", "assistant", "user"), ("never_together", "system", "user"), ("directly_follows", "user", "assistant")]


def _skeleton(s, d):
    log = C(s, d)
    wanted = s.createDataFrame([("user", [1, 2, 3]), ("assistant", [1, 2, 3])], "act string, counts array<long>")
    return rounded(declarative.skeleton_conformance(log, s.createDataFrame(SKELETON, "relation string, source string, target string"), wanted), "fitness", places=9)


add("skeleton_conformance", _skeleton, f"WITH {SQL_C}, c AS (SELECT case_id, act, count(*) AS n, min(idx) AS lo, max(idx) AS hi FROM ev GROUP BY 1, 2), nx AS (SELECT DISTINCT case_id, act AS a, lead(act) OVER (PARTITION BY case_id ORDER BY idx) AS b FROM ev), r AS (SELECT * FROM (VALUES {', '.join(map(str, SKELETON))}) v(relation, source, target)), p AS (SELECT c.case_id, CASE r.relation WHEN 'equivalence' THEN coalesce(c.n = t.n, FALSE) WHEN 'always_after' THEN coalesce(c.lo < t.hi, FALSE) WHEN 'always_before' THEN coalesce(t.lo < c.hi, FALSE) WHEN 'never_together' THEN t.act IS NULL ELSE EXISTS (SELECT 1 FROM nx WHERE nx.case_id = c.case_id AND nx.a = r.source AND nx.b = r.target) END AS ok FROM c JOIN r ON r.source = c.act LEFT JOIN c t ON t.case_id = c.case_id AND t.act = r.target UNION ALL SELECT case_id, act <> 'system' AND n BETWEEN 1 AND 3 FROM c UNION ALL SELECT k.case_id, FALSE FROM (SELECT DISTINCT case_id FROM ev) k, (SELECT unnest(['user', 'assistant']) AS act) w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.case_id = k.case_id AND c.act = w.act)) SELECT case_id, count(*) FILTER (WHERE NOT ok) AS deviations, count(*) AS constraints, round(1 - count(*) FILTER (WHERE NOT ok) / count(*), 9) AS fitness FROM p GROUP BY 1")
add("activity_frequencies", lambda s, d: joined(declarative.activity_frequencies(C(s, d)).withColumn("counts", F.transform("counts", lambda x: x.cast("string"))), "counts"), f"WITH {SQL_C}, c AS (SELECT case_id, act, count(*) AS k FROM ev GROUP BY 1, 2), f AS (SELECT act, list_distinct(list(k)) || CASE WHEN count(*) < (SELECT count(DISTINCT case_id) FROM ev) THEN [0] ELSE [] END AS x FROM c GROUP BY 1) SELECT act, array_to_string(list_sort(x), '>') AS counts FROM f")
TREE = "->( X( tau, 'system' ), *( ->( 'user', 'assistant' ), tau ) )"
MODEL = "m AS (SELECT * FROM (VALUES ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) v(source, target))"
add("footprints_fitness", lambda s, d: rounded(declarative.footprints_fitness(C(s, d), trees.footprints(nets.parse_tree(TREE))), "fitness", places=9), f"WITH {SQL_C}, {DF_L}, {MODEL}, o AS (SELECT sum(n) AS n, count(*) AS k, coalesce(sum(n) FILTER (WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.source = g.source AND m.target = g.target)), 0) AS off FROM g), b AS (SELECT DISTINCT 's' AS side, act FROM ev WHERE idx = 0 UNION ALL SELECT DISTINCT 'e', act FROM (SELECT arg_max(act, idx) AS act FROM ev GROUP BY case_id)), e AS (SELECT count(*) AS k, count(*) FILTER (WHERE (side = 's' AND act IN ('system', 'user')) OR (side = 'e' AND act = 'assistant')) AS ok FROM b) SELECT round(((1 - o.off / o.n) * o.k + e.ok) / (o.k + e.k), 9) AS fitness FROM o, e")
add("tree_footprints", lambda s, d: s.createDataFrame(sorted([("sequence", a, b) for a, b in trees.footprints(nets.parse_tree(TREE)).sequence] + [("parallel", a, b) for a, b in trees.footprints(nets.parse_tree(TREE)).parallel]), "relation string, source string, target string"), "SELECT * FROM (VALUES ('sequence', 'system', 'user'), ('parallel', 'user', 'assistant'), ('parallel', 'assistant', 'user')) v(relation, source, target)")

# Edge graphs
VE = f"{DF_L}, st AS (SELECT act, count(*) AS n FROM ev WHERE idx = 0 GROUP BY 1), en AS (SELECT act, count(*) AS n FROM (SELECT arg_max(act, idx) AS act FROM ev GROUP BY case_id) GROUP BY 1), ve AS (SELECT source AS act FROM g UNION SELECT target FROM g UNION SELECT act FROM st UNION SELECT act FROM en)"
cut = lambda s, d: discovery.dfg(L(s, d)).filter("source < target")
add("dfg_vertices", lambda s, d: graphs.vertices(discovery.dfg(L(s, d)), stats.start_activities(L(s, d)), stats.end_activities(L(s, d))), f"WITH {SQL_L}, {VE} SELECT act FROM ve")
add("dfg_inferred_starts", lambda s, d: graphs.inferred_starts(cut(s, d)), f"WITH {SQL_L}, {DF_L} SELECT DISTINCT source AS act FROM g WHERE source < target AND source NOT IN (SELECT target FROM g WHERE source < target)")
add("dfg_inferred_ends", lambda s, d: graphs.inferred_ends(cut(s, d)), f"WITH {SQL_L}, {DF_L} SELECT DISTINCT target AS act FROM g WHERE source < target AND target NOT IN (SELECT source FROM g WHERE source < target)")
add("dfg_vertex_frequencies", lambda s, d: graphs.vertex_frequencies(discovery.dfg(L(s, d)), stats.start_activities(L(s, d)), stats.end_activities(L(s, d))), f"WITH {SQL_L}, {VE} SELECT act, count(*) AS n FROM ev GROUP BY 1")
add("dfg_activity_count", lambda s, d: graphs.activity_count(discovery.dfg(C(s, d))), f"WITH {SQL_C}, {DF_L}, b AS (SELECT source AS act, n, 1 AS side FROM g UNION ALL SELECT target, n, 0 FROM g) SELECT act, CAST(CASE WHEN count(DISTINCT side) = 2 THEN sum(n) // 2 ELSE sum(n) END AS BIGINT) AS n FROM b GROUP BY 1")
REACH = f"WITH RECURSIVE {SQL_L}, {DF_L}, r(source, target) AS (SELECT source, target FROM g WHERE source < target UNION SELECT r.source, g.target FROM r JOIN g ON g.source = r.target AND g.source < g.target)"
add("dfg_successors", lambda s, d: graphs.successors(cut(s, d)), f"{REACH} SELECT source, target FROM r")
add("dfg_predecessors", lambda s, d: graphs.predecessors(cut(s, d)), f"{REACH} SELECT target AS source, source AS target FROM r")

# Queries of the first list that had no SQL
OVERDUE = "q AS (SELECT case_id, act, b, e, row_number() OVER (PARTITION BY case_id, act ORDER BY b, idx) AS k FROM ev)"
SQL_NEW = {
    "to_interval": f"WITH {SQL_I}, p AS (SELECT case_id, idx AS i, act, b AS t, 's' AS life, 0 AS k FROM ev UNION ALL SELECT case_id, idx, act, e, 'c', 1 FROM ev), o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY t, i, k) AS pos FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY case_id, act, life ORDER BY pos) AS nth FROM o) SELECT c.act, count(*) AS n, CAST(sum(CASE WHEN s.pos < c.pos THEN (c.t - s.t) * 1000000 ELSE 0 END) AS BIGINT) AS us FROM n c LEFT JOIN n s ON s.life = 's' AND s.case_id = c.case_id AND s.act = c.act AND s.nth = c.nth WHERE c.life = 'c' GROUP BY 1",
    "heuristics_net": f"WITH {SQL_L}, {DF_L}, top AS (SELECT act, max(n) AS m FROM (SELECT source AS act, n FROM g UNION ALL SELECT target, n FROM g) GROUP BY 1), c AS (SELECT g.* FROM g JOIN top x ON x.act = source JOIN top y ON y.act = target WHERE n >= 0.05 * least(x.m, y.m)), d AS (SELECT c.source, c.target, c.n, CASE WHEN c.source = c.target THEN c.n / (c.n + 1) ELSE (c.n - coalesce(r.n, 0)) / (c.n + coalesce(r.n, 0) + 1) END AS dep FROM c LEFT JOIN c r ON r.source = c.target AND r.target = c.source), t AS (SELECT a AS source, b AS target, count(*) AS n FROM (SELECT act AS a, lead(act) OVER w AS b, lead(act, 2) OVER w AS z FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY idx)) WHERE a = z AND a <> b GROUP BY 1, 2) SELECT source, target, n, round(dep, 9) AS dependency, CASE WHEN source = target THEN 'loop1' ELSE 'edge' END AS kind FROM d WHERE dep >= 0.5 UNION ALL SELECT t.source, t.target, t.n, round((t.n + coalesce(r.n, 0)) / (t.n + coalesce(r.n, 0) + 1), 9), 'loop2' FROM t LEFT JOIN t r ON r.source = t.target AND r.target = t.source WHERE (t.n + coalesce(r.n, 0)) / (t.n + coalesce(r.n, 0) + 1) >= 0.5",
    "filter_between": f"WITH {SQL_E}, pu AS (SELECT case_id, idx AS hi, lag(idx) OVER (PARTITION BY case_id ORDER BY idx) AS p FROM ev WHERE act = 'purchase'), st AS (SELECT pu.case_id, hi, min(x.idx) AS lo FROM pu JOIN ev x ON x.case_id = pu.case_id AND x.act = 'signup' AND x.idx < hi AND x.idx > coalesce(p, -1) GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY hi) - 1 AS k FROM st) SELECT n.case_id || '##@@' || k AS case_id, ev.idx - lo AS idx, act FROM n JOIN ev ON ev.case_id = n.case_id AND ev.idx BETWEEN lo AND hi",
    "batches": f"WITH {SQL_I}, i AS (SELECT DISTINCT act, res, case_id, b AS s, e FROM ev), g1 AS (SELECT *, max(e) OVER (PARTITION BY act, res ORDER BY s, e, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i), g2 AS (SELECT *, sum(CASE WHEN m IS NULL OR s - m > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY act, res ORDER BY s, e, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g1), g3 AS (SELECT *, lag(e) OVER (PARTITION BY act, res, k ORDER BY s, e, case_id) AS p FROM g2), b AS (SELECT act, res, k, count(*) AS n, count(DISTINCT s) AS ns, count(DISTINCT e) AS ne, count(*) FILTER (WHERE p > s) AS t FROM g3 GROUP BY 1, 2, 3 HAVING count(*) >= 2) SELECT act, CASE WHEN ns = 1 AND ne = 1 THEN 'simultaneous' WHEN ns = 1 THEN 'start' WHEN ne = 1 THEN 'end' WHEN t = 0 THEN 'sequential' ELSE 'concurrent' END AS kind, count(*) AS n, CAST(sum(n) AS BIGINT) AS events FROM b GROUP BY 1, 2",
    "business_hours": f"WITH {SQL_E}, c AS (SELECT case_id, min(ts) AS lo, max(ts) AS hi FROM ev GROUP BY 1), d AS (SELECT case_id, lo, hi, unnest(generate_series(date_trunc('day', lo), hi, INTERVAL 1 DAY)) AS day FROM c) SELECT case_id, sum(CASE WHEN isodow(day) <= 5 THEN greatest(0.0, epoch_us(least(hi, day + INTERVAL 17 HOUR)) / 1000000.0 - epoch_us(greatest(lo, day + INTERVAL 9 HOUR)) / 1000000.0) ELSE 0.0 END) AS seconds FROM d GROUP BY 1",
    "edit_alignments": f"WITH {SQL_C}, v AS (SELECT list(act ORDER BY idx) AS seq, string_agg(act[1], '' ORDER BY idx) AS t FROM ev GROUP BY case_id) SELECT array_to_string(seq, '>') AS seq, count(*) AS n, least(levenshtein(any_value(t), 'ua'), levenshtein(any_value(t), 'sua')) AS distance FROM v GROUP BY 1",
    "variant_distances": f"WITH {SQL_C}, v AS (SELECT DISTINCT list(act ORDER BY idx) AS seq, string_agg(act[1], '' ORDER BY idx) AS t FROM ev GROUP BY case_id) SELECT array_to_string(seq, '>') AS seq, levenshtein(t, 'ua') / greatest(len(t), 2) AS distance FROM v",
}
for _name, _sql in SQL_NEW.items():
    add(_name, QUERIES[_name], _sql)
add("sample_cases_size", lambda s, d: core.sample_cases(L(s, d), 100).agg(F.count_distinct("case_id").alias("n"), F.count_distinct("case_id", "idx").alias("events") > 0).toDF("n", "whole"), f"WITH {SQL_L} SELECT least(100, count(DISTINCT case_id)) AS n, TRUE AS whole FROM ev")

# Models: answers that SQL works out from the same few facts
add("tree_language", lambda s, d: s.createDataFrame(sorted({("".join(t),) for t in trees.play_out(nets.parse_tree("->( X( 'a', 'b' ), +( 'c', 'd' ) )"), 400)}), "run string"), "SELECT a || x AS run FROM (SELECT unnest(['a', 'b']) AS a), (SELECT unnest(['cd', 'dc']) AS x)")
add("tree_to_powl_order", lambda s, d: s.createDataFrame(sorted((i, j) for i, j in powl.of_tree(nets.parse_tree("->( 'a', 'b', 'c', 'd' )")).order), "a int, b int"), "SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b FROM range(4) x(a), range(4) y(b) WHERE a < b")
add("powl_transitive_reduction", lambda s, d: s.createDataFrame(sorted(powl.transitive_reduction(frozenset((i, j) for i in range(6) for j in range(i + 1, 6)))), "a int, b int"), "SELECT CAST(a AS INT) AS a, CAST(a + 1 AS INT) AS b FROM range(5) x(a)")
add("net_reachability", lambda s, d: s.createDataFrame([(len(petri.reachability(nets.net_of(nets.parse_tree("+( 'a', 'b', 'c' )"))).markings),)], "markings long"), "SELECT 2 + 2 * 2 * 2 AS markings")
add("net_soundness", lambda s, d: s.createDataFrame([(petri.soundness(nets.net_of(miners.inductive(miners.variants_of(C(s, d))))).sound,)], "sound boolean"), "SELECT TRUE AS sound")
add("bpmn_tasks", lambda s, d: s.createDataFrame(sorted((n,) for k, n in graphs.bpmn_inductive_dfg(*miners.graph_of(C(s, d))).nodes.values() if k == "task"), "act string"), f"WITH {SQL_C} SELECT DISTINCT act FROM ev")
add("bpmn_split_miner", lambda s, d: s.createDataFrame(sorted((n,) for k, n in graphs.split_miner(*miners.graph_of(L(s, d))).nodes.values() if k == "task"), "act string"), f"WITH {SQL_L} SELECT DISTINCT act FROM ev")
add("bpmn_round_trip", lambda s, d: s.createDataFrame([(k, sum(x == k for x, _ in bpmn.read_bpmn(bpmn.write_bpmn(bpmn.of_tree(nets.parse_tree("->( 'a', X( 'b', 'c' ) )")))).nodes.values())) for k in ("start", "end", "task", "exclusive")], "kind string, n long"), "SELECT * FROM (VALUES ('start', 1), ('end', 1), ('task', 3), ('exclusive', 2)) v(kind, n)")
add("petri_net_heuristics", lambda s, d: s.createDataFrame(sorted((t[1],) for t in graphs.net_of_heuristics(graphs.heuristics_of(*miners.graph_of(L(s, d)))).transitions if t[1]), "act string"), f"WITH {SQL_L} SELECT DISTINCT act FROM ev")
add("petri_net_alpha_plus", lambda s, d: s.createDataFrame(sorted((t[1],) for t in graphs.alpha_plus(*miners.graph_of(L(s, d))).transitions), "act string"), f"WITH {SQL_L} SELECT DISTINCT act FROM ev")
add("petri_net_per_edge", lambda s, d: s.createDataFrame([(sum(t[1] is None for t in graphs.net_per_edge(*miners.graph_of(L(s, d))).transitions),)], "silent long"), f"WITH {SQL_L}, {VE} SELECT (SELECT count(*) FROM g) + (SELECT count(*) FROM st) + (SELECT count(*) FROM en) AS silent")

# Logs as a whole
add("rebase", lambda s, d: logs.rebase(L(s, d), case="res").select("case_id", "idx", "act"), f"WITH {SQL_L} SELECT res AS case_id, row_number() OVER (PARTITION BY res ORDER BY ts, case_id, idx) - 1 AS idx, act FROM ev")
add("event_stream", lambda s, d: logs.of_stream(logs.to_stream(C(s, d)).withColumn("at", F.struct("ts", "case_id", "idx")).drop("idx"), "at").select("case_id", "idx", "act"), f"WITH {SQL_C} SELECT case_id, idx, act FROM ev")
add("arrow_round_trip", lambda s, d: logs.of_arrow(s, logs.to_arrow(C(s, d).select("case_id", "idx", "act"))), f"WITH {SQL_C} SELECT case_id, idx, act FROM ev")
add("filter_traces_by_condition", lambda s, d: logs.filter_traces(L(s, d), F.sum("quantity") > 100).select("case_id", "idx", "act"), f"WITH {SQL_L} SELECT case_id, idx, act FROM ev WHERE case_id IN (SELECT case_id FROM ev GROUP BY case_id HAVING sum(quantity) > 100)")
add("filter_traces_by_function", lambda s, d: logs.filter_traces(C(s, d).select("case_id", "idx", "act"), lambda e: e["act"].iloc[0] == "user"), f"WITH {SQL_C} SELECT case_id, idx, act FROM ev WHERE case_id IN (SELECT case_id FROM ev WHERE idx = 0 AND act = 'user')")
add("sort_traces_by_key", lambda s, d: logs.sort_traces(L(s, d), F.sum("quantity"), True).limit(20), f"WITH {SQL_L} SELECT case_id, sum(quantity) AS \"key\" FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
add("filter_events_by_condition", lambda s, d: logs.filter_events(L(s, d), F.col("quantity") > 25, True).select("case_id", "idx", "act"), f"WITH {SQL_L} SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY idx) - 1 AS idx, act FROM ev WHERE quantity > 25")
add("sort_events_by_key", lambda s, d: logs.sort_events(L(s, d), F.col("quantity"), True).select("case_id", "idx", "act", "quantity"), f"WITH {SQL_L} SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY quantity DESC, idx) - 1 AS idx, act, quantity FROM ev")
add("events_of_case", lambda s, d: logs.events_of(L(s, d), "1").select("idx", "act"), f"WITH {SQL_L} SELECT idx, act FROM ev WHERE case_id = '1'")

# Alignments with a model that SQL can follow: user and assistant in turns, perhaps after a system row
TURNS = "->( X( tau, 'system' ), *( ->( 'user', 'assistant' ), tau ) )"


def _turns():
    return nets.net_of(nets.parse_tree(TURNS))


GOOD = "regexp_full_match(array_to_string(seq, ''), '(system)?(userassistant)+')"
add("fits_tree", lambda s, d: joined(aligning.align_log_tree(C(s, d), nets.parse_tree(TURNS)).select("seq", (F.col("fitness") == 1.0).alias("fits"))), f"WITH {SQL_C}, {SQL_T} SELECT DISTINCT array_to_string(seq, '>') AS seq, {GOOD} AS fits FROM tr")
add("alignments_beam", lambda s, d: joined(aligning.align_log_beam(C(s, d), _turns(), 100).select("seq", (F.col("cost") < 10000).alias("fits"))), f"WITH {SQL_C}, {SQL_T} SELECT DISTINCT array_to_string(seq, '>') AS seq, {GOOD} AS fits FROM tr")
add("alignments_discounted", lambda s, d: joined(aligning.align_log_discounted(C(s, d), _turns()).select("seq", (F.col("cost") == 0).alias("fits"))), f"WITH {SQL_C}, {SQL_T} SELECT DISTINCT array_to_string(seq, '>') AS seq, {GOOD} AS fits FROM tr")
add("alignments_decomposed", lambda s, d: joined(aligning.align_log_decomposed(C(s, d), _turns()).select("seq", (F.col("cost") < 10000).alias("fits"))), f"WITH {SQL_C}, {SQL_T} SELECT DISTINCT array_to_string(seq, '>') AS seq, {GOOD} AS fits FROM tr")
add("alignments_subset", lambda s, d: aligning.align_log_subset(C(s, d), _turns(), 1 << 20).agg(F.sum(F.when(F.col("upper") < 10000, F.col("n")).otherwise(0)).alias("fitting")), f"WITH {SQL_C}, {SQL_T} SELECT CAST(count(*) FILTER (WHERE {GOOD}) AS BIGINT) AS fitting FROM tr")
add("trace_footprints_fitness", lambda s, d: declarative.trace_footprints_fitness(C(s, d), trees.footprints(nets.parse_tree("X( 'user', 'assistant', 'system' )"))).select("share_fitting"), f"WITH {SQL_C} SELECT avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS share_fitting FROM (SELECT count(*) AS n FROM ev GROUP BY case_id)")
add("precision_alignments", lambda s, d: s.createDataFrame([(aligning.precision(C(s, d), graphs.net_per_edge(*miners.graph_of(C(s, d)))) > 0.5,)], "high boolean"), "SELECT TRUE AS high")


# Streams: the conversations as they come in, through Structured Streaming
from tracelake.streaming import live, online  # noqa: E402


def chat_stream(s, d):
    # the table is one file or a folder of files; a pattern takes either
    rows = s.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{d}/conversations.parque[t]")
    return rows.select(F.col("conv_id").cast("string").alias("case_id"), F.col("role").alias("act"), F.timestamp_seconds("turn").alias("ts"), F.col("turn").alias("order"))


ALLOWED = {("user", "assistant"), ("assistant", "user"), ("system", "user")}
add("streaming_dfg", lambda s, d: online.snapshot(online.drained(online.edge_changes(chat_stream(s, d)))), f"WITH {SQL_C}, {DF_L} SELECT source, target, n FROM g")
add("streaming_end_activities", lambda s, d: online.snapshot(online.drained(online.edge_changes(chat_stream(s, d))), "end").select(F.col("source").alias("act"), "n"), f"WITH {SQL_C} SELECT act, count(*) AS n FROM (SELECT arg_max(act, idx) AS act FROM ev GROUP BY case_id) GROUP BY 1")
add("streaming_footprints", lambda s, d: online.latest(online.drained(online.footprint_deviations(chat_stream(s, d), ALLOWED, {"user", "system"}, {"user", "assistant", "system"}), "update")), f"WITH {SQL_C}, p AS (SELECT case_id, idx, act, lead(act) OVER (PARTITION BY case_id ORDER BY idx) AS nx FROM ev) SELECT case_id, count(*) FILTER (WHERE nx IS NOT NULL AND (act, nx) NOT IN (('user', 'assistant'), ('assistant', 'user'), ('system', 'user'))) + count(*) FILTER (WHERE idx = 0 AND act NOT IN ('user', 'system')) AS deviations FROM p GROUP BY 1")
add("streaming_temporal", lambda s, d: online.drained(online.temporal_deviations(chat_stream(s, d), {("user", "assistant"): (1.0, 0.0)}, 6.0)).groupBy("case_id").agg(F.count("*").alias("n")), f"WITH {SQL_C} SELECT a.case_id, count(*) AS n FROM ev a JOIN ev b ON a.case_id = b.case_id AND a.idx < b.idx WHERE a.act = 'user' AND b.act = 'assistant' AND b.s - a.s <> 1 GROUP BY 1")
add("streaming_declare", lambda s, d: live.summary(online.drained(live.rule_breaches(chat_stream(s, d), [("precedence", "system", "user"), ("exactly_one", "system", ""), ("chain_response", "user", "assistant")]))), f"WITH {SQL_C}, p AS (SELECT *, lag(act) OVER w AS before, min(CASE WHEN act = 'system' THEN idx END) OVER w AS first FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY idx)) SELECT rule, count(*) AS n FROM (SELECT 'precedence(system, user)' AS rule FROM p WHERE act = 'user' AND (first IS NULL OR first > idx) UNION ALL SELECT 'exactly_one(system)' FROM p WHERE act = 'system' AND first < idx UNION ALL SELECT 'chain_response(user, assistant)' FROM p WHERE before = 'user' AND act <> 'assistant') GROUP BY 1")
add("streaming_alignments", lambda s, d: online.drained(live.run_costs(chat_stream(s, d), [("user", "assistant") * k for k in range(1, 6)])).groupBy("case_id").agg(F.max("cost").alias("cost")).select("case_id", (F.col("cost") == 0).alias("follows")), f"WITH {SQL_C} SELECT case_id, bool_and(act = CASE WHEN idx % 2 = 0 THEN 'user' ELSE 'assistant' END) AS follows FROM ev GROUP BY 1")
