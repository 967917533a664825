"""Small inputs with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from unitweave.functions.columns import chi2_critical, chi2_statistic, ngrams
from unitweave.operators import evaluation as ev
from unitweave.operators import selection as sel
from unitweave.operators import trees as tr
from unitweave.operators import units as un
from unitweave.sources.files import read_artifact, read_file_list, read_labelled_dirs, write_artifact
from unitweave.streaming.frequencies import read_frequencies, start_frequencies

IDENT = lambda name: {"type": "Identifier", "name": name}
TREE_A = {"type": "Program", "sourceType": "script", "body": [{
    "type": "IfStatement", "test": IDENT("a"),
    "consequent": {"type": "BlockStatement", "body": [{"type": "ExpressionStatement", "expression": {"type": "AssignmentExpression", "operator": "=", "left": IDENT("b"), "right": {"type": "Literal", "value": 1, "raw": "1"}}}]},
    "alternate": {"type": "BlockStatement", "body": [{"type": "ExpressionStatement", "expression": {"type": "CallExpression", "callee": IDENT("c"), "arguments": [{"type": "Literal", "value": True, "raw": "true"}]}}]},
}]}
TREE_B = {"type": "Program", "body": [
    {"type": "VariableDeclaration", "declarations": [{"type": "VariableDeclarator", "id": IDENT("x"), "init": {"type": "Literal", "value": 1}}]},
    {"type": "ExpressionStatement", "expression": {"type": "CallExpression", "callee": IDENT("f"), "arguments": [IDENT("x")]}},
]}
EVENTS = "sample_id long, scope int, pos int, k int, name string, kind string, is_function boolean"


@pytest.fixture(scope="module")
def nodes(spark):
    return tr.flatten_tree(spark.createDataFrame([(1, json.dumps(TREE_A)), (2, json.dumps(TREE_B)), (3, "no tree"), (4, None)], "sample_id long, tree string")).cache()


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_ngrams(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4]), (3, [1, 2]), (4, []), (5, None), (6, [1] * 5)], "i int, units array<int>")
    got = {r["i"]: r["g"] for r in df.select("i", ngrams(F.col("units"), 4).alias("g")).collect()}
    assert got == {1: ["1,2,3,4", "2,3,4,5"], 2: ["1,2,3,4"], 3: ["1,2,_,_"], 4: None, 5: None, 6: ["1,1,1,1"] * 2}
    assert df.select(ngrams(F.col("units"), 0).alias("g")).where("g is not null").count() == 0


def test_lexer(spark):
    df = spark.createDataFrame([(1, "?", "var a = 'x\\'y'; // c\n/* d */ if (a === null) `t`; 0x1F + true")], "sample_id long, label string, payload string")
    assert un.lex_units(df).first()["units"] == [3, 2, 6, 7, 6, 10, 11, 3, 6, 2, 6, 4, 6, 9, 6, 5, 6, 0]
    assert un.lex_units(df, with_value=True).first()["units"][3]["value"] == "'x\\'y'"


def test_tree_a(nodes):
    a = nodes.where("sample_id = 1")
    assert [r["subtree_end"] for r in a.orderBy("node_id").collect()] == [12, 12, 2, 7, 7, 7, 6, 7, 12, 12, 12, 11, 12]
    codes = tr.TREE_CODES
    assert [codes[u] for u in tr.ast_units(a).first()["units"]] == [30, 29, 7, 23, 3, 29, 37, 7, 23, 9, 29, 37]
    size = dict(rows(tr.subtree_size(a), "node_id", "descendants"))
    assert (size[1], size[3], size[12]) == (11, 4, 0)
    near = {r["node_id"]: r["statement"] for r in tr.nearest_statement(a).collect()}
    assert [near[k] for k in (2, 6, 11, 3, 0)] == [1, 4, 9, 3, None]
    edges = rows(tr.structure_edges(a), "src", "dst", "type", "label")
    assert [e for e in edges if e[2] == "control"] == [(1, 3, "control", "true"), (1, 8, "control", "false"), (3, 4, "control", "e"), (8, 9, "control", "e")]
    assert [e[:2] for e in edges if e[2] == "statement"] == [(1, 2), (4, 5), (5, 6), (5, 7), (9, 10), (10, 11), (10, 12)]
    values = [(r["unit"], r["value"]) for r in tr.ast_value_features(a).orderBy("node_id").collect()]
    assert values == [(30, "a"), (29, "a"), (7, "b"), (23, "b"), (3, "b"), (29, "b"), (70, "1"), (7, "c"), (23, "c"), (9, "c"), (29, "c"), (70, "1")]
    flow = tr.flow_units(a, tr.structure_edges(a), "cfg").first()["units"]
    assert [codes[u] for u in flow] == [30, 29, 7, 23, 3, 29, 37, 7, 23, 9, 29, 37, 7, 23, 7, 23]


def test_tree_b(spark, nodes):
    b = nodes.where("sample_id = 2")
    events = spark.createDataFrame([(2, 0, 3, 0, "x", "def", False), (2, 0, 7, 0, "f", "use", False), (2, 0, 8, 0, "x", "use", False)], EVENTS)
    data = tr.def_use_edges(events, b)
    assert rows(data, "src", "dst", "begin_id", "end_id") == [(1, 5, 3, 8)]
    reserved = spark.createDataFrame([("document",)], "word string")
    assert rows(tr.undeclared_identifiers(events, reserved), "name") == [("f",)]
    edges = data.withColumn("type", F.lit("data"))
    assert tr.flow_units(b, edges, "pdg-dfg").first()["units"] == ["VariableDeclaration", "VariableDeclarator", "Identifier", "Literal", "ExpressionStatement", "CallExpression", "Identifier", "Identifier"]
    pairs = [(u["unit"], u["value"]) for u in tr.flow_units(b, edges, "pdg-dfg", "value").first()["units"]]
    assert pairs == [("VariableDeclaration", "x"), ("VariableDeclarator", "x"), ("Identifier", "x"), ("Int", "1"), ("ExpressionStatement", "x"), ("CallExpression", "f"), ("Identifier", "f"), ("Identifier", "x")]
    assert tr.flow_units(b, edges, "cfg").first()["units"] == []


def statement(kind, *children):
    return {"type": kind, "body": list(children)}


def edges_of(spark, *body):
    found = tr.flatten_tree(spark.createDataFrame([(1, json.dumps({"type": "Program", "body": list(body)}))], "sample_id long, tree string"))
    return found, [(r["src"], r["dst"], r["type"], r["label"]) for r in tr.structure_edges(found).orderBy("src", "dst").collect()]


def test_switch_visits_own_statements_before_the_next_case(spark):
    case = lambda *x: {"type": "SwitchCase", "consequent": list(x)}
    call = lambda name: {"type": "ExpressionStatement", "expression": IDENT(name)}
    # 1 switch, 2 discriminant, 3 case with statements 4, 6, 8 (identifiers 5, 7, 9), 10 case with statements 11, 13
    found, edges = edges_of(spark, {"type": "SwitchStatement", "discriminant": IDENT("a"), "cases": [case(call("b"), call("c"), call("d")), case(call("e"), call("f"))]})
    control = [e for e in edges if e[2] == "control"]
    assert control == [(1, 3, "control", "e"), (3, 6, "control", "true"), (3, 8, "control", "true"), (3, 10, "control", "false"), (10, 11, "control", "true"), (10, 13, "control", "true")]
    flow = tr.flow_units(found, tr.structure_edges(found), "cfg").first()["units"]
    order = [i for i, u in enumerate(flow) if u == "SwitchCase"]
    own = ["ExpressionStatement", "Identifier"]
    # the switch and its subtree, the first case and its subtree, its statements as targets, then the second case
    assert flow[:2] == ["SwitchStatement", "Identifier"] and flow[2] == "SwitchCase" and flow[3:9] == own * 3
    assert len(order) >= 2 and order[-1] > max(i for i, u in enumerate(flow[: order[-1]]) if u == "ExpressionStatement")


def test_second_comment_after_a_comment_has_no_edge(spark):
    line = {"type": "Line", "value": "x"}
    test = {"type": "IfStatement", "test": IDENT("a"), "consequent": statement("BlockStatement")}
    _, edges = edges_of(spark, test | {"comments": [line, line]})
    assert edges == [(1, 2, "statement", "s"), (1, 3, "control", "true"), (1, 4, "comment", "c")]
    _, edges = edges_of(spark, test | {"alternate": statement("BlockStatement"), "comments": [line]})
    assert edges == [(1, 2, "statement", "s"), (1, 3, "control", "true"), (1, 4, "control", "false"), (1, 5, "comment", "c")]


def test_bad_trees_give_no_rows(spark):
    good = json.dumps({"type": "Program", "body": [{"type": "Literal", "value": []}, {"type": "Literal", "value": {"a": 1}}]})
    bad = ["[" * 100_000, '{"type": 5}', '{"type":"Program","body":[{"type":{}}]}', "[]", "3", '"x"', "{", None, ""]
    found = tr.flatten_tree(spark.createDataFrame([(0, good)] + [(i + 1, t) for i, t in enumerate(bad)], "sample_id long, tree string"))
    assert rows(found, "sample_id", "node_id", "name") == [(0, 0, "Program"), (0, 1, "Literal"), (0, 2, "Literal")]
    assert tr.flatten_tree(spark.createDataFrame([], "sample_id long, tree string")).count() == 0


def recursive_walk(parents, name, edges, kinds):
    """Flow units by plain recursion over one sample."""
    below = {n: [c for c in sorted(parents) if parents[c] == n] for n in parents}
    units = []
    for kind in kinds:
        out = {n: sorted((d for s, d, t in edges if s == n and t == kind)) for n in parents}
        walked, emitted = set(), set()

        def write_below(x):
            for y in below[x]:
                if y not in emitted:
                    emitted.add(y)
                    units.append(name[y])
                    write_below(y)

        def visit(x):
            if out[x]:
                emitted.add(x)
                units.append(name[x])
                write_below(x)
            for y in out[x]:
                if not out[y] or y in walked:
                    units.append(name[y])
                if y not in walked:
                    walked.add(y)
                    emitted.add(y)
                    write_below(y)
                    visit(y)

        for x in sorted(parents):
            if parents[x] is not None and x not in walked:
                visit(x)
    return units


def test_flow_units_equal_recursion(spark, sf):
    from unitweave import catalog
    from unitweave.plans import testdata as td

    nodes = td.order_trees(spark, sf).cache()
    edges = tr.structure_edges(nodes).cache()
    got = {r["sample_id"]: r["units"] for r in tr.flow_units(nodes, edges, "cfg").collect()}
    by_sample, of = {}, {}
    for r in nodes.collect():
        by_sample.setdefault(r["sample_id"], []).append(r)
    for e in edges.collect():
        of.setdefault(e["sample_id"], []).append((e["src"], e["dst"], e["type"]))
    assert set(got) == set(by_sample) and any(got.values())
    for sample, some in by_sample.items():
        want = recursive_walk({r["node_id"]: r["parent_id"] for r in some}, {r["node_id"]: r["name"] for r in some}, of.get(sample, []), ["control"])
        assert got[sample] == want, sample
    assert catalog.flow_edges(nodes).where("type = 'data'").count() > 0


def test_texts_are_lexed_once(spark, sf):
    from unitweave import catalog

    plan = catalog.count_ngrams(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_identifier_events(spark):
    cases = [
        ([("a", 1, 0, "def", False), ("a", 2, 0, "def", False), ("a", 3, 0, "use", False)], [(2, 3)]), ([("x", 1, 0, "def", False), ("x", 5, 0, "def", False), ("x", 6, 0, "use", False)], [(5, 6)]),
        ([("i", 1, 0, "def", False), ("i", 4, 0, "use", False), ("i", 4, 1, "def", False), ("i", 4, 2, "use", False)], [(1, 4), (4, 4)]),
        ([("g", 2, 0, "use", False), ("g", 7, 0, "def", True)], [(7, 2)]), ([("v", 2, 0, "use", False), ("v", 7, 0, "def", False)], []), ([("document", 2, 0, "use", False)], []),
    ]
    events = spark.createDataFrame([(i, 0, pos, k, name, kind, f) for i, (es, _) in enumerate(cases) for name, pos, k, kind, f in es], EVENTS)
    assert rows(tr.def_use_edges(events), "sample_id", "begin_id", "end_id") == sorted((i, *e) for i, (_, want) in enumerate(cases) for e in want)
    assert rows(tr.undeclared_identifiers(events, spark.createDataFrame([("document",)], "word string")), "sample_id", "name") == [(4, "v")]


def test_chi2(spark):
    table = [(10, 90, 40, 60, 22.426666666666666), (1, 347, 10, 41, 54.93759490291447), (20, 80, 37, 63, 6.281437860385229), (20, 80, 33, 67, 3.6965729688101656), (30, 70, 30, 70, 0.0), (0, 100, 0, 100, 0.0)]
    df = spark.createDataFrame([(f"f{i}", *t) for i, t in enumerate(table)], "feature string, ben_with long, ben_wo long, mal_with long, mal_wo long, want double")
    for r in df.withColumn("got", chi2_statistic(*map(F.col, ("ben_with", "ben_wo", "mal_with", "mal_wo")))).collect():
        assert r["got"] == pytest.approx(r["want"])
    assert (chi2_critical(99), chi2_critical(95)) == (6.63, 3.84)
    assert rows(sel.select_features(df), "feature", "pos") == [("f0", 0), ("f1", 1)] and sel.select_features(df, 95).count() == 3
    freq = spark.createDataFrame([("benign", "a", 10), ("benign", "b", 11)], "label string, feature string, df long")
    assert rows(sel.popular_features(freq), "feature") == [("b",)]
    assert rows(sel.merge_document_frequency(freq, freq), "feature", "df") == [("a", 20), ("b", 22)]


def test_vectors(spark):
    counts = spark.createDataFrame([("s1", "?", "A", 2, 4), ("s1", "?", "B", 1, 4), ("s1", "?", "Z", 1, 4), ("s2", "?", "Z", 3, 3)], "sample_id string, label string, feature string, cnt long, total long")
    vocabulary = spark.createDataFrame([("A", 0), ("B", 1)], "feature string, pos int")
    vectors = sel.feature_vectors(counts, vocabulary)
    assert rows(vectors, "sample_id", "pos", "weight") == [("s1", 0, 0.5), ("s1", 1, 0.25), ("s2", 2, 1.0)]
    assert {r["sample_id"]: r["features"].toArray().tolist() for r in sel.to_ml_vectors(vectors, 2).collect()} == {"s1": [0.5, 0.25, 0.0], "s2": [0.0, 0.0, 1.0]}


def test_evaluation(spark):
    p = ev.predict_with_threshold(spark.createDataFrame([("s1", "malicious", 0.5), ("s2", "benign", 0.49), ("s3", "malicious", 0.3), ("s4", "benign", 0.8)], "sample_id string, label string, p_malicious double"))
    assert [r[1] for r in rows(p, "sample_id", "predicted")] == ["malicious", "benign", "benign", "malicious"]
    assert tuple(ev.detection_score(p).first()) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    assert ev.detection_score(p.withColumn("label", F.when(F.col("sample_id") == "s1", "?").otherwise(F.col("label")))).count() == 0
    assert ev.detection_score(p.where("label = 'benign'")).first()["tpr"] is None
    votes = spark.createDataFrame([(s, i, v) for s, vs in {"s1": (0.5, 0.9, 0.1), "s2": (0.2, 0.49, 0.78), "s3": (0.3,) * 3, "s4": (0.8,) * 3}.items() for i, v in enumerate(vs)], "sample_id string, tree int, p_malicious double")
    assert rows(ev.tree_agreement(votes, p), "sample_id", "agreeing", "trees") == [("s1", 2, 3), ("s2", 2, 3), ("s3", 3, 3), ("s4", 3, 3)]
    mods = spark.createDataFrame([(i, f"m{j + 1}", {"m": "malicious", "b": "benign"}[c]) for i, s in enumerate(("mmbb", "mbbb", "mbmb")) for j, c in enumerate(s)], "sample_id int, module string, predicted string")
    assert rows(ev.vote_modules(mods, ["m1", "m2"], ["m3", "m4"]), "sample_id", "result", "layer") == [(0, "malicious", 1), (1, "benign", 2), (2, "forwarded", 0)]


def test_files(spark, tmp_path):
    for d, name, text in (("x", "1.js", "var a;"), ("x", "2.js", "b\nc"), ("y", "sub/3.js", "d")):
        path = tmp_path / d / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    got = read_labelled_dirs(spark, [f"{tmp_path}/x", f"{tmp_path}/y"], ["benign", "malicious"], recursive=True)
    assert rows(got, "label", "payload", "size_bytes") == [("benign", "b\nc", 3), ("benign", "var a;", 6), ("malicious", "d", 1)]
    (tmp_path / "list.txt").write_text(f"{tmp_path}/x/1.js\n{tmp_path}/y/sub/3.js\n")
    for base in (None, str(tmp_path)):
        assert rows(read_file_list(spark, f"{tmp_path}/list.txt", "benign", base), "label", "payload") == [("benign", "d"), ("benign", "var a;")]
    assert rows(read_labelled_dirs(spark, [], files=[f"{tmp_path}/x/1.js"]), "label") == [("?",)]
    write_artifact(got, f"{tmp_path}/out", "tokens", "ngrams", "vectors")
    assert read_artifact(spark, f"{tmp_path}/out", "tokens", "ngrams", "vectors").count() == 3


def test_stream_equals_batch(spark, tmp_path):
    units = spark.createDataFrame([(1, "benign", [1, 2, 3]), (2, "benign", [1, 2]), (3, "malicious", [1, 2])], "sample_id long, label string, units array<int>")
    units.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(units.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # new samples raise what is there
        start_frequencies(stream, f"{tmp_path}/frequencies", f"{tmp_path}/checkpoint", n=2).awaitTermination(60)
        found = read_frequencies(spark, f"{tmp_path}/frequencies")
        assert rows(found, "label", "feature", "df") == rows(sel.document_frequency(un.count_ngrams(spark.read.parquet(f"{tmp_path}/in").withColumn("sample_id", F.monotonically_increasing_id()), 2)), "label", "feature", "df")
        units.write.mode("append").parquet(f"{tmp_path}/in")


def test_statement_edges_of_data_equal_brute_force(spark, sf):
    """Latest definition before each use, then both ends' nearest statements by climbing the parents."""
    from unitweave import catalog
    from unitweave.functions.tables import STATEMENTS
    from unitweave.plans import testdata as td

    nodes = td.order_trees(spark, sf).cache()
    got = {(r["sample_id"], r["src"], r["dst"], int(r["begin_id"]), int(r["end_id"])) for r in catalog.flow_edges(nodes).where("type = 'data'").collect()}
    samples = {}
    for r in nodes.orderBy("sample_id", "node_id").collect():
        samples.setdefault(r["sample_id"], {})[r["node_id"]] = r
    want = set()
    for sample, some in samples.items():
        def statement(n, some=some):
            while n is not None and some[n]["name"] not in STATEMENTS:
                n = some[n]["parent_id"]
            return n

        last = {}
        for n, r in some.items():
            if r["name"] == "Identifier":
                name = r["attributes"]["name"]
                if r["child_ix"] == 0:
                    last[name] = n
                elif name in last and statement(last[name]) is not None and statement(n) is not None:
                    want.add((sample, statement(last[name]), statement(n), last[name], n))
    assert got == want and want


def test_reserved_words_are_not_reported(spark):
    from unitweave import catalog
    from unitweave.functions.tables import RESERVED

    names = ["Document", "javaclass", "pkcs11", "onMouseOver", "Symbol", "each", "myOwn", "window2"]
    events = spark.createDataFrame([(1, 0, i, 0, n, "use", False) for i, n in enumerate(names)], EVENTS)
    assert rows(tr.undeclared_identifiers(events, catalog.reserved_words(spark)), "name") == [("myOwn",), ("window2",)]
    assert len(RESERVED) == 200 and len({w.lower() for w in RESERVED}) == catalog.reserved_words(spark).count()


def test_forest_votes_and_stored_scores(spark, tmp_path):
    from unitweave.plans import model as mo
    from unitweave.plans import modules

    units = [(i, "malicious" if i % 2 else "benign", [3, 4, 3, 4, 5][: 3 + i % 3] if i % 2 else [1, 2, 1, 1, 2][: 3 + i % 3]) for i in range(60)]
    table = spark.createDataFrame(units, "sample_id long, label string, units array<int>")
    train, validation = table.where("sample_id < 30"), table.where("sample_id >= 30")
    forest, vocabulary = modules.train_module(train, validation, n=2, min_df=2, confidence=90, trees=7)
    assert vocabulary.count() >= 2 and forest.getNumTrees == 7
    judged = modules.classify_module(validation, forest, vocabulary, n=2)
    assert all(r["predicted"] == r["label"] for r in judged.collect())
    vectors = sel.feature_vectors(un.count_ngrams(validation, 2), vocabulary)
    p = {r["sample_id"]: r["p_malicious"] for r in judged.collect()}
    votes = mo.tree_votes(forest, sel.to_ml_vectors(vectors, forest.numFeatures - 1), batch=3).groupBy("sample_id").agg(F.avg("p_malicious").alias("mean"), F.count(F.lit(1)).alias("n")).collect()
    assert {r["sample_id"] for r in votes} == set(p) and all(r["n"] == 7 and r["mean"] == pytest.approx(p[r["sample_id"]]) for r in votes)
    mo.write_model(forest, f"{tmp_path}/model")
    write_artifact(vectors, f"{tmp_path}/out", "tokens", "ngrams", "vectors")
    scored = mo.score_stored_analysis(read_artifact(spark, f"{tmp_path}/out", "tokens", "ngrams", "vectors"), mo.read_model(f"{tmp_path}/model"))
    assert {r["sample_id"]: r["p_malicious"] for r in scored.collect()} == pytest.approx(p)
