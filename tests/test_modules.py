"""Modules from programs to votes, long samples, late values and majorities, against the plain way."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from unitweave import catalog
from unitweave.operators import evaluation as ev
from unitweave.operators import selection as sel
from unitweave.operators import trees as tr
from unitweave.operators import units as un
from unitweave.plans import model as mo
from unitweave.plans import modules
from unitweave.plans import testdata as td
from unitweave.sources.files import store


@pytest.fixture(scope="module")
def programs(spark, sf):
    """Unit arrays of all ten modules, stored."""
    return {k: store(v, "units") for k, v in catalog.program_modules(spark, sf).items()}


def rows(df, *columns):
    return Counter(map(tuple, df.select(*columns).collect()))


def test_ten_vocabularies_equal_ten_single_runs_and_vote(spark, programs):
    counts = store(modules.run_modules(programs), "counts")
    train, validation = catalog.keyed_halves(counts)
    keyed = store(modules.learn_vocabularies(train, validation, 1, 50), "vocabularies")
    assert len(programs) == 10
    for (level, features), units in programs.items():
        some = store(modules.sample_features(units, features), "own")
        single = modules.learn_vocabulary(some.where("sample_id % 2 = 0"), some.where("sample_id % 2 = 1"), 1, 50)
        own = keyed.where((F.col("level") == level) & (F.col("features") == features))
        assert rows(own, "feature", "pos") == rows(single, "feature", "pos"), (level, features)
    judged, votes = modules.modular_verdicts(train, validation, validation, *catalog.LAYERS, 1, 50, trees=5)
    said = {}
    for r in judged.collect():
        said.setdefault(r.sample_id, {})[r.module] = r.predicted
    assert set(m for v in said.values() for m in v) == {f"{a} {b}" for a, b in programs if keyed.where((F.col("level") == a) & (F.col("features") == b)).count()}

    def vote(of):
        for k, layer in enumerate(catalog.LAYERS, 1):
            if len({of.get(m) for m in layer}) == 1 and layer[0] in of:
                return of[layer[0]], k
        return "forwarded", 0

    assert {r.sample_id: (r.result, r.layer) for r in votes.collect()} == {s: vote(v) for s, v in said.items()}
    assert len({r for r, _ in map(vote, said.values())}) > 1


def test_keyed_selection_of_modules_without_vocabulary(spark):
    some = [("a", "ngrams", k, "benign" if k % 2 else "malicious", f"f{k % 2}", 1, 1) for k in range(40)] + [("b", "value", k, "benign" if k % 4 < 2 else "malicious", "same", 1, 1) for k in range(40)]
    counts = spark.createDataFrame(some, "level string, features string, sample_id long, label string, feature string, cnt long, total long")
    vocabularies = modules.learn_vocabularies(counts, counts, 2, 99)
    assert rows(vocabularies, "level", "feature", "pos") == Counter([("a", "f0", 0), ("a", "f1", 1)])
    vectors = sel.feature_vectors(counts, vocabularies, modules.MODULE)
    assert rows(vectors.where("level = 'b'"), "pos", "weight") == Counter({(0, 1.0): 40})
    models = modules.fit_modules(vectors, vocabularies, trees=3)
    assert list(models) == [("a", "ngrams")]
    assert rows(modules.classify_modules(counts, models, vocabularies), "label", "predicted") == Counter({("benign", "benign"): 20, ("malicious", "malicious"): 20})


def test_majority_equals_votes_and_agreement(spark, sf):
    units = store(td.event_units(spark, sf).where("label <> '?'"), "events")
    train, validation = units.where("sample_id % 2 = 0"), units.where("sample_id % 2 = 1")
    forest, vocabulary = modules.train_module(train, validation, n=2, min_df=1, confidence=1, trees=7)
    vectors = store(sel.to_ml_vectors(sel.feature_vectors(un.count_ngrams(validation, 2), vocabulary), vocabulary.count()), "vectors")
    for threshold, batch in ((0.5, 3), (0.3, 50)):
        judged = ev.predict_with_threshold(mo.probabilities(vectors, forest), threshold)
        agreement = ev.tree_agreement(mo.tree_votes(forest, vectors, 4), judged, threshold)
        want = judged.join(agreement, "sample_id")
        got = mo.majority(forest, vectors, threshold, batch)
        columns = ("sample_id", "label", "predicted", "agreeing", "trees")
        assert rows(got, *columns) == rows(want, *columns) and len({r.agreeing for r in got.collect()}) > 1
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_popular_values_are_exact_when_digests_clash(spark, sf):
    values = store(td.text_values(spark, sf), "values")
    want = rows(sel.popular_features(sel.document_frequency(un.count_values(values)), 3), "label", "feature", "df")
    for bits in (64, 4, 1):
        assert rows(un.popular_values(values, 3, bits), "label", "feature", "df") == want and want


def test_long_samples_are_cut_and_equal_arrays(spark, sf):
    long = store(td.status_units(spark, sf), "long")
    short = spark.createDataFrame([(f"s{k}", "?", p, p) for k in range(6) for p in range(k)], "sample_id string, label string, pos long, unit int")
    both = long.unionByName(short)
    arrays = un.sequences(both, ["pos"])
    assert rows(long.groupBy("sample_id").agg(F.min("pos"), F.max("pos") + 1 - F.count(F.lit(1))), "min(pos)", "((max(pos) + 1) - count(1))") == Counter({(0, 0): 3})
    for n, span in ((4, 1_000), (1, 7), (3, 2), (4, 100_000), (0, 5)):
        assert rows(un.count_long_ngrams(both, n, span), "sample_id", "label", "feature", "cnt", "total") == rows(un.count_ngrams(arrays, n), "sample_id", "label", "feature", "cnt", "total")
    parts = un.long_ngrams(long, 4, 200).groupBy("sample_id").agg(F.count_distinct("part").alias("n")).collect()
    assert all(r.n >= 4 for r in parts)
    # the parts of one sample are dealt to several tasks, if small ones are not put together
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = un.long_ngrams(long.where("sample_id = 'N'"), 4, 100).withColumn("task", F.spark_partition_id())
        assert dealt.select("task").distinct().count() >= 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 9, 10])
def test_packed_counts_equal_text_counts(spark, n):
    import random

    from unitweave.functions.columns import ngrams

    rng = random.Random(n)
    some = [(k, "?", [rng.choice([0, 1, 5, 126]) for _ in range(rng.randint(0, 14))]) for k in range(80)]
    odd = [(300, "?", None), (301, "?", [1, 127, 1, 127, 1]), (302, "?", [-1, 2, 3, 4, 5]), (303, "?", [1, None, 3, 4, 5])]
    units = spark.createDataFrame(some + odd, "sample_id long, label string, units array<int>")
    columns = ("sample_id", "label", "feature", "cnt", "total")
    assert rows(un.count_ngrams(units, n), *columns) == rows(un._counted(units, ngrams(F.col("units"), n)), *columns)


def recursive(nodes, edges, levels, values):
    """The walk as it is described, by plain recursion. nodes: id -> row; edges: (type, src, dst, ord, begin, end)."""
    below = {n: sorted(k for k, r in nodes.items() if r.parent_id == n) for n in nodes}
    contexts = {}
    for n, r in nodes.items():
        idents = [k for k in range(n, r.subtree_end + 1) if nodes[k].name == "Identifier"]
        contexts[n] = nodes[min(idents)].attributes["name"] if idents else None
    leaf = lambda n: (nodes[n].attributes["value"] or "None") if "value" in nodes[n].attributes else nodes[n].attributes.get("name")
    kinds = {"string": "String", "int": "Int", "bool": "Int", "float": "Numeric", "null": "Null"}
    out = []
    for level in levels:
        steps = {}
        for kind, s, d, order, b, e in sorted(edges, key=lambda x: (x[1], x[2]) if level == "control" else (x[1], x[3], x[2])):
            if kind == level:
                steps.setdefault(s, []).append((d, b, e))
        walked, emitted = set(), set()

        def tree(n, level=level, emitted=emitted):
            for k in below[n]:
                if k not in emitted:
                    emitted.add(k)
                    if not values:
                        out.append(nodes[k].name)
                    elif nodes[k].name == "Literal":
                        out.extend([(kinds.get(nodes[k].value_type, "Literal"), leaf(k))] if "value" in nodes[k].attributes else [])
                    elif contexts[k] is not None:
                        out.append((nodes[k].name, contexts[k]))
                    tree(k)

        def visit(n, level=level, steps=steps, walked=walked, emitted=emitted, tree=tree):
            for i, (d, b, e) in enumerate(steps.get(n, [])):
                if i == 0 and (not values or level == "data" or contexts[n] is not None):
                    emitted.add(n)
                    out.append(nodes[n].name if not values else (nodes[n].name, leaf(b) if level == "data" else contexts[n]))
                    tree(n)
                if d not in steps or d in walked:
                    if not values or level == "data":
                        out.append(nodes[d].name if not values else (nodes[d].name, leaf(e)))
                    elif contexts[d] is not None:
                        out.append((nodes[d].name, contexts[d]))
                if d not in walked:
                    walked.add(d)
                    emitted.add(d)
                    tree(d)
                    visit(d)

        for n in sorted(nodes):
            if nodes[n].parent_id is not None and n not in walked:
                visit(n)
    return out


@pytest.fixture(scope="module")
def walked(spark, sf):
    """Nodes and edges of the programs, stored, and as plain rows by sample."""
    nodes = store(tr.flatten_tree(td.programs(spark, sf)), "nodes")
    edges = store(catalog.program_edges(nodes), "edges")
    trees, arcs = {}, {}
    for r in nodes.collect():
        trees.setdefault(r.sample_id, {})[r.node_id] = r
    for r in edges.collect():
        arcs.setdefault(r.sample_id, []).append((r.type, r.src, r.dst, r.ord, r.begin_id, r.end_id))
    return nodes, edges, trees, arcs


@pytest.mark.parametrize("level, values", [("pdg-dfg", False), ("pdg-dfg", True), ("pdg", False), ("pdg", True), ("cfg", True)])
def test_walks_over_programs_equal_recursion(walked, level, values):
    import sys

    sys.setrecursionlimit(20_000)
    nodes, edges, trees, arcs = walked
    kinds = {"pdg-dfg": ["data"], "pdg": ["data", "control"], "cfg": ["control"]}[level]
    got = {r.sample_id: r.units for r in tr.flow_units(nodes, edges, level, "value" if values else "ngrams").collect()}
    assert set(got) == set(trees) and any(e[0] == "data" for a in arcs.values() for e in a)
    for sample, some in trees.items():
        want = recursive(some, arcs.get(sample, []), kinds, values)
        assert [tuple(u) if values else u for u in got[sample]] == want, sample
