import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.operators import bandit, chunking, decisions, ledger, loops, retrieval, temporal
from meshlark.operators import workflow as W
from meshlark.sources.tables import Artifacts


def lists(spark, data, column="rank int"):
    return [spark.createDataFrame([(1, d, v) for d, v in x], f"query_id int, doc_id string, {column}") for x in data]


def test_reciprocal_ranks_of_three_lists(spark):
    ranked = [[(d, i + 1) for i, d in enumerate(s)] for s in ("ABCDE", "BAEF", "ACED")]
    got = {r["doc_id"]: (r["fused_score"], r["rank"]) for r in retrieval.reciprocal_rank_fusion(lists(spark, ranked), 10).collect()}
    assert math.isclose(got["A"][0], 1 / 61 + 1 / 62 + 1 / 61, abs_tol=1e-12) and math.isclose(got["F"][0], 1 / 64, abs_tol=1e-12)
    assert got["A"][1] == 1 and sorted(v[1] for v in got.values()) == [1, 2, 3, 4, 5, 6]
    only = retrieval.reciprocal_rank_fusion(lists(spark, ranked), 10, weights=[1, 0, 0])
    assert only.count() == 5 and retrieval.reciprocal_rank_fusion(lists(spark, ranked), 0).count() == 0
    for bad in ({"weights": [1, 2]}, {"weights": [1, -1, 0]}, {"k": 0}):
        with pytest.raises(ValueError):
            retrieval.reciprocal_rank_fusion(lists(spark, ranked), 5, **bad)


def test_distribution_fusion_by_hand(spark):
    a, b = [("x", 3.0), ("y", 1.0), ("z", 2.0)], [("x", 7.0)]
    got = {r["doc_id"]: r["fused_score"] for r in retrieval.distribution_fusion(lists(spark, [a, b], "score double"), 5).collect()}
    assert math.isclose(got["x"], (3 - (2 - 3)) / 6 + 0.5, abs_tol=1e-9) and math.isclose(got["y"], (1 + 1) / 6, abs_tol=1e-9)
    flat = lists(spark, [[("x", 2.0), ("y", 2.0)]], "score double")
    assert [r["fused_score"] for r in retrieval.distribution_fusion(flat, 5).collect()] == [0.5, 0.5]
    moved = [(d, 10 * s - 4) for d, s in a]  # neither shift nor scale matters
    one, two = (retrieval.distribution_fusion(lists(spark, [x], "score double"), 5).orderBy("doc_id").collect() for x in (a, moved))
    assert all(math.isclose(p["fused_score"], q["fused_score"], abs_tol=1e-9) for p, q in zip(one, two, strict=True))


def test_hybrid_falls_back(spark):
    dense = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], "query_id int, doc_id string, score double, rank int")
    sparse = spark.createDataFrame([(1, "b", 5.0, 1), (1, "c", 4.0, 2)], dense.schema)
    assert retrieval.hybrid(dense, None, 5)[1]["degraded"] == "no-keyword-provider"
    assert retrieval.hybrid(dense, sparse.limit(0), 5)[1]["degraded"] == "sparse-empty"
    rows, meta = retrieval.hybrid(dense, sparse, 5)
    assert [(r["doc_id"], r["score"]) for r in rows.orderBy("rank").collect()] == [("b", 0.8), ("a", 0.9)] and meta["hybrid"]
    with pytest.raises(ValueError):
        retrieval.HybridOptions(weights=(1.0,))
    with pytest.raises(retrieval.UnknownCollection):
        retrieval.keyword_search(dense, {}, "none", 3)


def test_chunks():
    text = " ".join(f"w{i}" for i in range(1000))
    c = chunking.fixed_chunks(text)
    assert (chunking.words_of(512), chunking.words_of(64)) == (682, 85) and len(c) == 2
    assert c[1][0].split()[0] == "w597" and all(text[a:b] == s for s, a, b in c)
    assert chunking.fixed_chunks("") == [] and chunking.fixed_chunks("  one  ") == [("  one  ", 0, 7)]
    assert [s for s, _, _ in chunking.sentences(" One. Two!  Three? 3.14 rest")] == ["One.", "Two!", "Three?", "3.14 rest"]
    long = "a b c d. e f. " + " ".join("x" * 3 for _ in range(20)) + ". g h."
    for cut in (chunking.sentence_chunks, chunking.paragraph_chunks):
        parts = cut(long, tokens=6, overlap=2)
        assert all(long[a:b] == s for s, a, b in parts) and len(parts) > 2
    two = "one two three\n\nfour five six\r\n\r\nseven"
    assert [s for s, _, _ in chunking.paragraphs(two)] == ["one two three", "four five six", "seven"]
    assert [s for s, _, _ in chunking.paragraph_chunks(two, tokens=3)] == ["one two three", "four five six\r\n\r\nseven"]


def test_ingestion_appends(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two. three"), (2, None), (3, "")], "id int, text string")
    path = str(tmp_path / "chunks")
    chunking.ingest(docs, "id", "text", path, "sentence")
    got = chunking.ingest(docs, "id", "text", path, "sentence")
    assert got.count() == 2 and got.select(F.size("embedding")).distinct().collect()[0][0] == 64
    bad = chunking.embed(docs, "text", lambda texts: [])
    with pytest.raises(Exception, match="vectors"):
        bad.collect()


def fold(log):
    """The dictionary form of the replay."""
    rows = {}
    for a, kind, t in log:
        if kind == "assert" and (a not in rows or rows[a][1] is not None):
            rows[a] = [t, None]
        elif kind == "retract" and a in rows and rows[a][1] is None:
            rows[a][1] = t
    return {a: tuple(v) for a, v in rows.items()}


def test_replay_equals_a_fold(spark):
    rng, start = random.Random(5), datetime(2026, 1, 1)
    log = [(f"a{rng.randrange(40)}", rng.choice(["assert", "retract"]), start + timedelta(hours=i)) for i in range(600)]
    df = spark.createDataFrame(log, "assoc_id string, kind string, occurred_at timestamp")
    got = {r["assoc_id"]: (r["system_from"], r["system_to"]) for r in temporal.replay(df).collect()}
    assert got == fold(log)


def test_intervals(spark):
    d = lambda n: datetime(2026, 1, n)
    rows = spark.createDataFrame([("a", d(1), d(5)), ("a", d(5), None), ("b", d(1), None), ("b", d(9), d(10)), ("c", d(1), d(2))], "k string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    assert [(r["k"], r["valid_from"].day) for r in temporal.overlapping(rows, ["k"]).collect()] == [("b", 9)]


def test_loops(spark):
    def verdict(actions, progress=None, signals=None, outputs=None):
        n = len(actions)
        rows = [(1, i, a, (progress or [True] * n)[i], (signals or [None] * n)[i], (outputs or [None] * n)[i]) for i, a in enumerate(actions)]
        df = spark.createDataFrame(rows, "task int, seq int, action string, progress boolean, signal string, output string")
        r = loops.verdicts(df, "task", ["seq"], "action", "progress", "signal", F.col("output")).head()
        return r["loop_type"], round(r["confidence"], 6)

    assert verdict("aaaa") == (None, 0.0)
    assert verdict("zaaaaa") == ("ExactRepetition", 0.7)
    assert verdict("abcde", [False] * 5) == ("NoProgress", 0.7)
    assert verdict("ababa") == ("Oscillation", 0.74)
    assert verdict("abcda", outputs=["same words here"] * 2 + ["x", "y", None])[0] == "SemanticRepetition"
    assert verdict("abcde")[0] is None


def test_beliefs_and_sampling(spark):
    known = spark.createDataFrame([("a1", "x", 30.0, 10.0, 36), ("a2", "x", 3.0, 9.0, 8)], "agent string, category string, alpha double, beta double, observations long")
    c = spark.createDataFrame([(f"r{i}", "x", a, p) for i in range(300) for p, a in enumerate(["a1", "a2"])], "request string, category string, agent string, position int")
    assert {r["agent"] for r in bandit.select(known, c).collect()} == {"a1"}
    drawn = bandit.select(known, c, seed=1).orderBy("request").collect()
    assert drawn == bandit.select(known, c, seed=1).orderBy("request").collect()
    first = [r["theta"] for r in drawn if r["agent"] == "a1"]
    assert abs(sum(first) / len(first) - 0.75) < 0.05
    none = bandit.select(known, c, c.select("request", "agent"))
    assert none.count() == 0


def test_ledgers(spark, tmp_path):
    tasks = spark.createDataFrame([("a", "Completed", 1, []), ("b", "Pending", 5, ["a"]), ("c", "Pending", 9, ["a", "b"]), ("d", "Pending", 7, []), ("e", "Pending", 1, ["none"])], "task_id string, status string, priority int, dependencies array<string>")
    assert [r["task_id"] for r in ledger.ready_tasks(tasks).collect()] == ["d", "b"]
    with pytest.raises(ValueError):
        ledger.recent(tasks, "task_id", ["priority"], 0)
    store = Artifacts(spark, str(tmp_path / "artifacts"))
    store.put(spark.createDataFrame([("i", 1), ("j", 2)], "id string, v int"), "plans", "id")
    store.put(spark.createDataFrame([("i", 3)], "id string, v int"), "plans", "id")
    store.delete("plans", ["j"])
    assert [(r["id"], r["payload"]) for r in store.get("plans").collect()] == [("i", '{"v":3}')]


def test_workflow_definitions(spark):
    w = W.Workflow("w").then("one", retries=2).branch("b", {"x": ["two"]}, ["three"]).repeat("l", ["four"], 3).fork("f", {"p": ["five"], "q": ["six", "seven"]}, "j").approval("ok").on_failure("clean").finish()
    moves = {(a, b, c) for a, b, c in w.moves}
    assert moves >= {("NotStarted", "one", ""), ("one", "b", ""), ("b", "two", "x"), ("b", "three", "*"), ("two", "four", ""), ("three", "four", ""), ("l", "four", "again"), ("l", "f", "done"), ("seven", "j", ""), ("five", "j", ""), ("ok", "Completed", "approved"), ("ok", "Failed", "rejected"), ("Failed", "clean", "recover")}
    assert W.Workflow.from_json(w.to_json()) == w and "[*] --> one" in w.diagram()
    log = spark.createDataFrame([(1, 1, "one"), (1, 2, "b"), (1, 3, "four"), (2, 1, "b")], "id int, seq int, phase string")
    bad = W.illegal_moves(log, w.transitions(spark), "id", ["seq"], "phase")
    assert sorted((r["id"], r["phase_from"], r["phase_to"]) for r in bad.collect()) == [(1, "b", "four"), (2, "NotStarted", "b")]
    for make in (lambda: W.Workflow("x").repeat("l", [], 1), lambda: W.Workflow("x").fork("f", {"p": ["a"]}, "j"), lambda: W.Workflow("x").then("a").then("a")):
        with pytest.raises(ValueError):
            make()


def test_maps_merge_in_order(spark):
    log = spark.sql("select * from values (1, 2, map('a', 2, 'c', 3), cast(null as string)), (1, 1, map('a', 1, 'b', 1), 'x'), (1, 3, cast(null as map<string,int>), cast(null as string)) as t(id, seq, m, s)")
    r = W.fold_states(log, "id", ["seq"], ["s"], [], ["m"]).head()
    assert (r["s"], dict(r["m"]), r["events"]) == ("x", {"a": 2, "b": 1, "c": 3}, 3)


def test_approvals(spark):
    at = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    asked = spark.createDataFrame([(i, at(0)) for i in range(7)], "request int, asked_at timestamp_ntz")
    said = [(0, 10, True), (1, 11, False), (2, 30, True), (3, 31, True), (4, -5, True), (5, 5, True), (5, 5, False), (9, 1, True)]
    answers = spark.createDataFrame([(r, at(s), ok) for r, s, ok in said], "request int, answered_at timestamp_ntz, approved boolean")
    for now, rest in ((20, ("second", "waiting")), (31, (None, "expired"))):
        got = {r["request"]: (r["level"], r["outcome"]) for r in decisions.approval_outcomes(asked, answers, [("first", 10), ("second", 20)], F.lit(at(now)).cast("timestamp_ntz")).collect()}
        assert got == {0: ("first", "approved"), 1: ("second", "rejected"), 2: ("second", "approved"), 3: (None, "expired"), 4: rest, 5: ("first", "rejected"), 6: rest}


def test_answers_and_coverage(spark):
    scored = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.5, 2), (2, "c", 0.4, 1), (2, "d", 0.3, 2)], "query_id int, doc_id string, score double, rank int")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    rows = decisions.answer_or_abstain(q, scored, 0.9, nearest=1).orderBy("query_id").collect()
    assert [(r["outcome"], list(r["records"])) for r in rows] == [("answer", ["a"]), ("abstain", ["c"]), ("abstain", [])]
    assert decisions.answer_or_abstain(q, scored.limit(0), 0.9).filter("outcome = 'abstain' AND size(records) = 0").count() == 3
    subjects = spark.createDataFrame([(1, "x"), (2, "x"), (None, "y")], "id int, g string")
    seen = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    assert sorted(tuple(r) for r in decisions.coverage(subjects, seen, "id", ["g"]).collect()) == [("x", 1, 2, 1), ("y", 0, 1, 1)]


def test_attributed_links_need_their_object(spark):
    from meshlark.operators.relate import EDGE, relate_attributed

    edges = spark.createDataFrame([("n", "1", "k", "n", "2", a) for a in ("a1", "a2", None)], ", ".join(f"{c} string" for c in EDGE))
    objects = spark.createDataFrame([("n", "1"), ("n", "2")], "type string, id string")
    links = spark.createDataFrame([("n", "k", "n", False)], "src_type string, link string, tgt_type string, self_loops boolean")
    given = spark.createDataFrame([("a1", 5), ("a9", 6)], "id string, v int")
    new, stored, refused = relate_attributed(edges, edges.limit(0), objects, links, given)
    assert [r["assoc_id"] for r in new.collect()] == ["a1"] and [tuple(r) for r in stored.collect()] == [("a1", 5)]
    assert sorted((r["assoc_id"] or "", r["reason"]) for r in refused.collect()) == [("", "missing-association"), ("a2", "missing-association")]
    again, nothing, _ = relate_attributed(edges, edges, objects, links, given)
    assert again.count() == 0 and nothing.count() == 0


def test_interface_actions_are_checked():
    from meshlark.registry import Action, ObjectType, Registry

    t = ObjectType("t", ("k",), interface_actions={"I": {"go": "run", "stop": "halt"}}, actions=(Action("run"),))
    assert [(i.subject, i.message) for i in Registry([t]).issues() if i.code == "interface-action-missing"] == [("default.t:I.stop", "no action halt")]


def test_conditions_and_guards(spark):
    from meshlark.operators import audit

    known = audit.Conditions()
    known.register("a", lambda: F.col("x") > 1)
    known.register("a", lambda: F.col("x") > 2)  # takes the place of the first
    assert "a" in known and "b" not in known
    with pytest.raises(LookupError):
        known.evaluate("b")
    with pytest.raises(ValueError):
        known.register("", lambda: F.lit(True))
    rows = spark.sql("SELECT * FROM VALUES ('s', 3, TIMESTAMP '2024-01-01'), ('s', 2, TIMESTAMP '2024-01-01'), ('s', NULL, TIMESTAMP '2024-01-01'), ('free', 0, TIMESTAMP '2024-01-01') t(step, x, ts)")
    steps = spark.createDataFrame([("s", "a", "no", 5.0)], "step string, validate string, message string, timeout_s double")
    got = sorted((r["step"], r["x"] or -1, r["phase"], r["event"], r["error"], r["deadline"] is not None) for r in audit.start_steps(rows, steps, known).collect())
    assert got == [("free", -1, "free", "Dispatched", None, False), ("s", -1, "ValidationFailed", "ValidationFailed", "no", False), ("s", 2, "ValidationFailed", "ValidationFailed", "no", False), ("s", 3, "s", "Dispatched", None, True)]
    with pytest.raises(LookupError):
        audit.library_events(rows, "Nothing")


def test_budget_options():
    from meshlark.operators import budget

    assert budget.BudgetOptions().allotted() == budget.DEFAULTS
    for bad in ({"multipliers": (1.0, 3.0, 2.0, 10.0)}, {"defaults": (0.0, 1.0, 1.0, 1.0, 1.0)}, {"defaults": (1.0, 1.0, 1.0, 1.0, 0.0)}):
        with pytest.raises(ValueError):
            budget.BudgetOptions(**bad)


def test_observers_change_nothing(spark, tmp_path):
    from meshlark.operators import graph

    seen = str(tmp_path / "seen")

    def note(row, ok, error):
        with open(seen, "a") as f:
            f.write(f"{row['k']}{ok}\n")

    def broken(row, ok, error):
        raise RuntimeError("the observer fails")

    def act(row):
        if row["k"] == 2:
            raise KeyError("two")

    rows = spark.createDataFrame([(1,), (2,)], "k long").coalesce(1)
    got = [tuple(r) for r in graph.dispatch(rows, "k", act, observers=(broken, note)).orderBy("k").collect()]
    assert got == [(1, True, None), (2, False, "KeyError: 'two'")] and set(open(seen).read().split()) == {"1True", "2False"}


def test_beta_draws_have_the_moments_of_beta(spark):
    from meshlark.operators import bandit

    for a, b in ((2.0, 5.0), (0.5, 1.5), (80.0, 20.0)):
        x = np.array([r[0] for r in spark.range(20_000).select(bandit.beta_draw(F.col("id").cast("string"), F.lit(a), F.lit(b))).collect()])
        mean, var = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
        assert abs(x.mean() - mean) < 4 * (var / len(x)) ** 0.5 and abs(x.var() / var - 1) < 0.06


def test_nearest_and_bm25_of_odd_rows(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, None), (None, [-1.0, 0.0])], "item_id long, vector array<double>")
    q = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [3.0]), ("c", None)], "query_id string, vector array<double>")
    got = {}
    for r in retrieval.nearest(q, items, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"], r["score"]))
    assert sorted(got["a"]) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0)] and sorted(got["b"])[0] == (1, 4, 1.0) and sorted(got["c"])[0] == (1, None, 0.0)
    assert retrieval.nearest(q, items, 3, least=0.5).count() == 3 and retrieval.nearest(q.limit(0), items, 3).count() == 0 and retrieval.nearest(q, items.limit(0), 3).count() == 0
    docs = spark.createDataFrame([(1, "red red green"), (2, None), (3, ""), (4, "green blue, green."), (None, "red")], "doc_id long, text string")
    ask = spark.createDataFrame([("q", "Red?"), ("r", None), ("s", "absent")], "query_id string, text string")
    found = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in retrieval.bm25(ask, docs, 5).collect())
    assert found == [("q", 1, None), ("q", 2, 1)] and retrieval.bm25(ask, docs.limit(0), 5).count() == 0 and retrieval.bm25(ask.limit(0), docs, 5).count() == 0


def test_a_batch_of_links_is_taken_whole_or_not(spark):
    from meshlark.operators import relate

    edge = "src_type string, src_id string, link string, tgt_type string, tgt_id string, assoc_id string"
    objects = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "type string, id string")
    links = spark.createDataFrame([("a", "to", "b", False)], "src_type string, link string, tgt_type string, self_loops boolean")
    good, bad = [(0, "a", "1", "to", "b", "1", None), (1, "a", "2", "to", "b", "1", None)], [(3, "a", "9", "to", "b", "1", None), (2, "a", "1", "off", "b", "1", None)]
    for rows, want in ((good, []), (good + bad, [(2, "undeclared-link")])):
        new, first = relate.relate_batch(spark.createDataFrame(rows, f"position int, {edge}"), spark.createDataFrame([], edge), objects, links)
        assert [tuple(r) for r in first.collect()] == want and new.count() == (0 if want else 2)


def test_open_rows_alone_may_clash(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-03-01', TIMESTAMP_NTZ '2024-02-01'), (1, TIMESTAMP_NTZ '2024-02-01', NULL, NULL) t(k, valid_from, valid_to, system_to)")
    assert temporal.overlapping(rows, ["k"]).count() == 1 and temporal.overlapping(rows, ["k"], open_only=True).count() == 0


def test_of_equal_intervals_the_order_says_which_clashes(spark):
    d = lambda n: datetime(2026, 1, n)
    for ids in ([1, 2, 3], [3, 2, 1], [2, 3, 1]):
        rows = spark.createDataFrame([("a", i, d(1), d(5)) for i in ids], "k string, id int, valid_from timestamp_ntz, valid_to timestamp_ntz").coalesce(1)
        assert sorted(r["id"] for r in temporal.overlapping(rows, ["k"], order=("id",)).collect()) == [2, 3]


def test_event_log_of_one_workflow(spark, tmp_path):
    from meshlark.sources import tables

    rows = spark.createDataFrame([(f"w{i % 7}", 100 - i, i) for i in range(60)], "workflow_id string, n int, v int")
    tables.append_events(rows.filter("v < 30"), str(tmp_path / "log"))
    tables.append_events(rows.filter("v >= 30"), str(tmp_path / "log"))
    got = tables.read_events(spark, str(tmp_path / "log"), "w3", ["n"])
    assert [r["v"] for r in got.collect()] == [i for i in reversed(range(60)) if i % 7 == 3] and got.columns == rows.columns
    assert "PartitionFilters: [isnotnull(part" in got._jdf.queryExecution().toString()


def test_vectors_go_to_their_index(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(5)], "i int, t string").coalesce(1)
    turned = lambda texts: [(i, [float(len(t))]) for i, t in reversed(list(enumerate(texts)))]
    assert [r["embedding"] for r in chunking.embed(rows, "t", turned).orderBy("i").collect()] == [[float(i)] for i in range(5)]
    with pytest.raises(Exception, match="index comes twice"):
        chunking.embed(rows, "t", lambda texts: [(0, [1.0])] * len(texts)).collect()


def test_sources_are_drained_in_order():
    from meshlark import registry as R

    base = R.Registry([R.ObjectType("a", ("id",), "d", (R.Property("id"),))], {}, [], [])
    add = lambda n: {"op": "add_property", "domain": "d", "type": "a", "value": R.Property(n)}
    out = R.drain(base, {"one": [add("p")], "two": [add("q"), {"op": "remove_property", "domain": "d", "type": "a", "name": "p"}]})
    assert [p.name for p in out.resolve("a").properties] == ["id", "q"]
    with pytest.raises(R.SourceFailed, match="two"):
        R.drain(base, {"one": [add("p")], "two": [{"op": "nothing", "domain": "d", "type": "a"}]})
