"""Plans of queries over trees: what they deal out and store, so that disk and time grow with the tables and by little."""

import json
import random

import pytest
from programs import random_program
from pyspark.sql import functions as F

import __spark_entry__ as entry
from unitweave import catalog
from unitweave.operators import dataflow as df
from unitweave.operators import trees as tr
from unitweave.operators import units as un
from unitweave.plans import modules
from unitweave.plans import testdata as td
from unitweave.sources.files import store

QUERIES = entry.queries()
#: Queries that read each program once, where its text is made.
IN_ONE_PASS = ["identifier_events", "resolved_names", "data_edges", "undeclared_names", "program_flow_units", "program_flow_values"]


def plan(found) -> str:
    return found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", IN_ONE_PASS)
def test_programs_are_read_in_one_pass(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    exchanges = [line for line in text.splitlines() if "Exchange " in line]
    assert len(exchanges) <= 3 and "Window" not in text and spark.conf.get("spark.checkpoint.dir") not in text
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["flow_units_cfg", "flow_units_pdg", "flow_units_pdg_dfg", "flow_units_pdg_value"])
def test_trees_of_orders_are_dealt_out_and_sorted_once(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert spark.conf.get("spark.checkpoint.dir") not in text and "FlatMapCoGroupsInPandas" not in text
    above, _, below = text.partition("Union")
    # above the nodes: one exchange, one sort of nodes for all windows
    assert below and len([x for x in above.splitlines() if "Exchange " in x]) == 1 and len([x for x in above.splitlines() if "Sort [" in x]) == 1


def some_programs(spark, count=40):
    rng = random.Random(5)
    return spark.createDataFrame([(k, json.dumps(random_program(rng))) for k in range(count)], "sample_id long, tree string")


def same(a, b):
    assert a.schema.simpleString() == b.schema.simpleString() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()


def test_trees_in_json_and_in_nodes_give_the_same(spark):
    trees = some_programs(spark)
    nodes = tr.flatten_tree(trees).cache()
    for of in (df.identifier_events, df.resolved_names, df.data_edges, df.undeclared_names):
        same(of(trees), of(nodes))


def test_walks_over_trees_equal_walks_over_rows(spark):
    trees = some_programs(spark)
    nodes = tr.flatten_tree(trees).cache()
    edges = catalog.program_edges(nodes).cache()
    for level in df.LEVELS:
        for features in ("ngrams", "value"):
            same(df.program_flow(trees, level, features), tr.flow_units(nodes, edges, level, features))


def test_modules_of_trees_equal_modules_of_units(spark, sf):
    def shown(counts):
        return counts.select(*modules.MODULE, "sample_id", "label", "feature", F.col("cnt").cast("long").alias("cnt"), F.col("total").cast("long").alias("total"))

    programs = catalog.labelled_programs(spark, sf).where("sample_id % 7 = 0")
    units = {k: v.where("sample_id % 7 = 0") for k, v in catalog.program_modules(spark, sf).items()}
    counted = store(modules.run_tree_modules(programs), "counts")
    same(shown(modules.counts_in_rows(counted)), store(shown(modules.run_modules(units)), "plain"))
    # what is no tree has tokens only; names in other scripts, comments over lines, an Identifier without a name
    odd = [(1, "?", "var \u00e9t\u00e9 = '\u4e2d'; /* a\nb */ \u00b2 ` // x"), (2, "?", None), (3, "?", ""), (4, "?", '{"type":"Program","body":[{"type":"ExpressionStatement","expression":{"type":"Identifier"}}]}')]
    odd = spark.createDataFrame(odd, "sample_id long, label string, tree string")
    got = modules.counts_in_rows(modules.run_tree_modules(odd, 3))
    nodes = tr.flatten_tree(odd)
    pairs = nodes.where("sample_id = 4 and node_id > 0").groupBy("sample_id").agg(F.collect_list(F.struct(F.col("name").alias("unit"), F.lit(None).cast("string").alias("value"))).alias("units"))
    assert not pairs.isEmpty()
    units = {("tokens", "ngrams"): un.lex_units(odd, "tree"), ("tokens", "value"): un.lex_units(odd, "tree", with_value=True), ("ast", "value"): pairs.withColumn("label", F.lit("?"))}
    units = {k: v.select("sample_id", "label", "units") for k, v in units.items()}
    same(shown(got.where("level = 'tokens' or features = 'value'")), shown(modules.run_modules(units, 3)))


@pytest.mark.parametrize("name", ["run_all_modules", "module_votes"])
def test_modules_count_each_program_once(spark, sf, name, monkeypatch):
    stored = []
    for at in (catalog, modules):
        monkeypatch.setattr(at, "store", lambda found, what: stored.append(what) or store(found, what))
    assert QUERIES[name](spark, sf).count() > 0
    # neither programs nor nodes nor edges nor units are stored
    assert not {"programs", "nodes", "edges", "units"} & set(stored)


def test_flow_of_names_equals_walks_over_rows(spark, sf):
    nodes = tr.flatten_tree(some_programs(spark)).cache()
    for some in (nodes, td.order_trees(spark, sf)):
        for level, features in (("cfg", "ngrams"), ("pdg", "value"), ("pdg-dfg", "ngrams")):
            same(tr.name_flow(some, level, features), tr.flow_units(some, catalog.flow_edges(some), level, features))
