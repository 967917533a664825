"""All queries by name over the given tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitweave.functions.columns import KEYWORDS, LEXER, chi2_critical, leaf_value, literal_type, ngrams
from unitweave.functions.tables import COMMENTS, RESERVED, STATEMENTS, TREE_CODES
from unitweave.operators import dataflow as fl
from unitweave.operators import evaluation as ev
from unitweave.operators import selection as sel
from unitweave.operators import trees as tr
from unitweave.operators import units as un
from unitweave.plans import model as mo
from unitweave.plans import modules
from unitweave.plans import testdata as td
from unitweave.sources.files import read_artifact, read_file_list, read_labelled_dirs, shared_folder, store, write_artifact
from unitweave.streaming.frequencies import read_frequencies, start_frequencies

#: Least document frequency (exclusive), confidence and trees of the queries: below the library's 10, 99 and 500, so that
#: the small tables have dozens of features and fits take seconds.
MIN_DF, CONFIDENCE, TREES, N = 1, 50, 20, 4
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _names(names: list[str]) -> str:
    return ", ".join(map(_q, names))


# Common table expressions of the SQL.
SAMPLES = "samples AS (SELECT d.doc_id AS sample_id, CASE WHEN l.toxic = 1 THEN 'malicious' WHEN l.toxic = 0 THEN 'benign' ELSE '?' END AS label, d.text AS payload FROM documents d LEFT JOIN labels l USING (doc_id))"
CLASS = (
    "CASE WHEN starts_with(t, '//') THEN 10 WHEN starts_with(t, '/*') THEN 11 WHEN length(t) > 1 AND substr(t, 1, 1) IN ('\"', '''') THEN 7 WHEN length(t) > 1 AND starts_with(t, '`') THEN 9 "
    f"WHEN regexp_matches(t, '^[0-9]') THEN 5 WHEN t IN ('true', 'false') THEN 0 WHEN t = 'null' THEN 4 WHEN t IN ({_names(KEYWORDS)}) THEN 3 WHEN regexp_matches(t, '^[\\p{{L}}_$]') THEN 2 ELSE 6 END"
)


def _lexed(source: str) -> str:
    return f"units AS (SELECT sample_id, label, list_transform(regexp_extract_all(payload, {_q(LEXER)}), lambda t: {CLASS}) AS units FROM {source})"


def _grams(units: str = "units", n: int = N) -> str:
    return f"""grams AS (SELECT sample_id, label, CASE
    WHEN len(units) >= {n} THEN list_transform(generate_series(1, len(units) - {n - 1}), lambda i: array_to_string(units[i:i + {n - 1}], ','))
    WHEN len(units) > 0 THEN [array_to_string(units, ',') || repeat(',_', {n} - len(units))] END AS keys FROM {units})"""


COUNTS = "sample_features AS (SELECT sample_id, label, feature, count(*) AS cnt, max(total) AS total FROM (SELECT sample_id, label, unnest(keys) AS feature, len(keys) AS total FROM grams) GROUP BY sample_id, label, feature)"
CHAIN = f"WITH {SAMPLES}, {_lexed('samples')}, {_grams()}, {COUNTS}"
TRAIN = f"""{CHAIN}, train AS (SELECT * FROM sample_features WHERE sample_id % 2 = 0), validation AS (SELECT * FROM sample_features WHERE sample_id % 2 = 1),
doc_freq AS (SELECT label, feature, count(*) AS df FROM train GROUP BY label, feature),
candidates AS (SELECT DISTINCT feature FROM doc_freq WHERE df > {MIN_DF} AND label IN ('benign', 'malicious')),
totals AS (SELECT count(DISTINCT CASE WHEN label = 'benign' THEN sample_id END) AS ben, count(DISTINCT CASE WHEN label = 'malicious' THEN sample_id END) AS mal FROM validation),
present AS (SELECT feature, count(*) FILTER (label = 'benign') AS b, count(*) FILTER (label = 'malicious') AS m FROM validation GROUP BY feature),
contingency AS (SELECT feature, coalesce(b, 0) AS ben_with, ben - coalesce(b, 0) AS ben_wo, coalesce(m, 0) AS mal_with, mal - coalesce(m, 0) AS mal_wo FROM candidates LEFT JOIN present USING (feature), totals),
terms AS (SELECT feature, ben_with::DOUBLE AS a, ben_wo::DOUBLE AS b, mal_with::DOUBLE AS c, mal_wo::DOUBLE AS d FROM contingency),
gaps AS (SELECT *, a + b + c + d AS n, greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0.0) AS gap, (a + b) * (c + d) * (a + c) * (b + d) AS below FROM terms),
scored AS (SELECT feature, CASE WHEN below = 0 THEN 0.0 ELSE n * gap * gap / below END AS chi2 FROM gaps),
vocabulary AS (SELECT feature, CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS pos FROM scored WHERE chi2 >= {chi2_critical(CONFIDENCE)})"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return un.count_ngrams(td.text_units(spark, sf_dir), N)


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Feature counts of training and validation samples. Texts are lexed and counted once, into a stored table."""
    all_ = store(features(spark, sf_dir), "counts")
    return all_.where("sample_id % 2 = 0"), all_.where("sample_id % 2 = 1")


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.document_frequency(halves(spark, sf_dir)[0])


def contingency_of(train: DataFrame, validation: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """Usable samples are those with features."""
    return sel.contingency(
        sel.candidate_features(sel.document_frequency(train), min_df),
        validation,
        validation.select("sample_id", "label").distinct(),
    )


def contingency_table(spark: SparkSession, sf_dir: str, min_df: int = MIN_DF) -> DataFrame:
    return contingency_of(*halves(spark, sf_dir), min_df)


def train_and_vocabulary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    train, validation = halves(spark, sf_dir)
    return train, store(sel.select_features(contingency_of(train, validation), CONFIDENCE), "vocabulary")


def flagship(spark: SparkSession, sf_dir: str, min_df: int = MIN_DF) -> DataFrame:
    return sel.scored_features(contingency_table(spark, sf_dir, min_df)).orderBy(F.desc("chi2"), "feature")


# Units and counts.
@query("WITH s AS (SELECT doc_id AS sample_id, text AS payload FROM documents) SELECT sample_id, CAST(octet_length(encode(payload)) AS BIGINT) AS n_bytes FROM s WHERE octet_length(encode(payload)) < 4000")
def size_filter(spark, sf_dir):
    return un.size_filter(td.text_samples(spark, sf_dir), 4000).select(
        "sample_id", F.octet_length("payload").cast("long").alias("n_bytes")
    )


@query(f"WITH {SAMPLES}, {_lexed('samples')} SELECT sample_id, len(units) AS n_units, array_to_string(units, ',') AS units FROM units")
def lex_units(spark, sf_dir):
    return td.text_units(spark, sf_dir).select(
        "sample_id",
        F.size("units").cast("long").alias("n_units"),
        F.array_join(F.col("units").cast("array<string>"), ",").alias("units"),
    )


@query(f"WITH scripts AS (SELECT page_id AS sample_id, '?' AS label, array_to_string(regexp_extract_all(html, '<script>([^\\x00]*?)</script>', 1), chr(10)) AS payload FROM pages), {_lexed('scripts')} SELECT sample_id, len(units) AS n_units, array_to_string(units, ',') AS units FROM units")
def lex_scripts(spark, sf_dir):
    return un.lex_units(td.script_samples(spark, sf_dir)).select(
        "sample_id",
        F.size("units").cast("long").alias("n_units"),
        F.array_join(F.col("units").cast("array<string>"), ",").alias("units"),
    )


EVENT_LABEL = "CASE user_id % 3 WHEN 0 THEN 'benign' WHEN 1 THEN 'malicious' ELSE '?' END"
EVENT_UNITS = f"units AS (SELECT user_id AS sample_id, {EVENT_LABEL} AS label, list(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END ORDER BY ts, event_id) AS units FROM events GROUP BY user_id)"
EVENT_VALUES = f"units AS (SELECT user_id AS sample_id, {EVENT_LABEL} AS label, list(event_type || ':' || coalesce(replace(props, chr(10), ''), '\\N') ORDER BY ts, event_id) AS units FROM events GROUP BY user_id)"


@query(f"WITH {EVENT_UNITS} SELECT sample_id, label, array_to_string(units, ',') AS units FROM units")
def encode_units(spark, sf_dir):
    return td.event_units(spark, sf_dir).select(
        "sample_id", "label", F.array_join(F.col("units").cast("array<string>"), ",").alias("units")
    )


@query("""WITH u AS (SELECT user_id AS sample_id, count(*) FILTER (event_type = 'error') AS unknown, list(event_type ORDER BY ts, event_id) AS units FROM events GROUP BY user_id)
SELECT sample_id, 'usable' AS part, CAST(NULL AS VARCHAR) AS reason FROM u WHERE unknown = 0 UNION ALL SELECT sample_id, 'quarantine', 'unknown unit' FROM u WHERE unknown > 0""")
def split_usable(spark, sf_dir):
    codes = {k: v for k, v in td.EVENT_CODES.items() if k != "error"}
    good, bad = un.split_usable(un.encode_units(un.sequences(td.event_rows(spark, sf_dir), ["ts", "event_id"]), codes))
    return good.select(
        "sample_id", F.lit("usable").alias("part"), F.lit(None).cast("string").alias("reason")
    ).unionByName(bad.select("sample_id", F.lit("quarantine").alias("part"), "reason"))


ORDER_UNITS = "units AS (SELECT l_orderkey AS sample_id, '?' AS label, list(l_partkey % 7 ORDER BY l_linenumber, l_partkey, l_suppkey) AS units FROM lineitem GROUP BY l_orderkey)"


@query(f"WITH {ORDER_UNITS}, {_grams()} SELECT sample_id, array_to_string(keys, ';') AS grams, len(keys) AS total FROM grams")
def ngrams_padded(spark, sf_dir):
    keys = ngrams(F.col("units"), N)
    return td.order_units(spark, sf_dir).select(
        "sample_id", F.array_join(keys, ";").alias("grams"), F.size(keys).cast("long").alias("total")
    )


@query(f"{CHAIN} SELECT * FROM sample_features")
def count_ngrams(spark, sf_dir):
    return features(spark, sf_dir)


@query(f"WITH {EVENT_UNITS}, {_grams()}, {COUNTS} SELECT * FROM sample_features")
def count_event_ngrams(spark, sf_dir):
    return un.count_ngrams(td.event_units(spark, sf_dir), N)


@query(f"WITH {EVENT_VALUES}, grams AS (SELECT sample_id, label, units AS keys FROM units), {COUNTS} SELECT * FROM sample_features")
def count_values(spark, sf_dir):
    return un.count_values(td.event_values(spark, sf_dir))


@query(f"WITH {EVENT_VALUES}, {_grams(n=2)}, {COUNTS} SELECT * FROM sample_features")
def count_value_ngrams(spark, sf_dir):
    return un.count_value_ngrams(td.event_values(spark, sf_dir), 2)


@query(f"""WITH {SAMPLES}, keyed AS (SELECT label, list_distinct(list_transform(regexp_extract_all(payload, {_q(LEXER)}), lambda t: ({CLASS}) || ':' || replace(t, chr(10), ''))) AS keys FROM samples)
SELECT label, feature, count(*) AS df FROM (SELECT label, unnest(keys) AS feature FROM keyed) GROUP BY label, feature HAVING count(*) > 10""")
def popular_values(spark, sf_dir):
    return un.popular_values(td.text_values(spark, sf_dir))


@query(f"""WITH placed AS (SELECT l_returnflag AS sample_id, l_partkey % 7 AS unit, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_returnflag) AS size FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)),
ahead AS (SELECT sample_id, unit || ',' || lead(unit, 1) OVER w || ',' || lead(unit, 2) OVER w || ',' || lead(unit, 3) OVER w AS feature, size - {N - 1} AS total FROM placed WINDOW w AS (PARTITION BY sample_id ORDER BY i))
SELECT sample_id, '?' AS label, feature, count(*) AS cnt, max(total) AS total FROM ahead WHERE feature IS NOT NULL GROUP BY sample_id, feature""")
def count_long_ngrams(spark, sf_dir):
    return un.count_long_ngrams(td.status_units(spark, sf_dir), N, span=2_000)


# Frequencies and selection.
@query(f"{CHAIN} SELECT label, feature, count(*) AS df FROM sample_features WHERE sample_id % 2 = 0 GROUP BY label, feature")
def document_frequency(spark, sf_dir):
    return frequencies(spark, sf_dir)


@query(f"{CHAIN} SELECT label, feature, count(*) AS df FROM sample_features GROUP BY label, feature")
def merge_document_frequency(spark, sf_dir):
    train, validation = halves(spark, sf_dir)
    return sel.merge_document_frequency(sel.document_frequency(train), sel.document_frequency(validation))


@query(f"{TRAIN} SELECT label, feature, df FROM doc_freq WHERE df > {MIN_DF}")
def popular_features(spark, sf_dir):
    return sel.popular_features(frequencies(spark, sf_dir), MIN_DF)


@query(f"{TRAIN} SELECT feature FROM candidates")
def candidate_features(spark, sf_dir):
    return sel.candidate_features(frequencies(spark, sf_dir), MIN_DF)


@query(f"{TRAIN} SELECT label, feature, df FROM doc_freq ORDER BY df DESC, feature, label LIMIT 20")
def most_used_features(spark, sf_dir):
    return sel.most_used_features(frequencies(spark, sf_dir), 20)


@query(f"{TRAIN} SELECT label, feature, df FROM doc_freq ORDER BY df, feature, label LIMIT 20")
def least_used_features(spark, sf_dir):
    return sel.least_used_features(frequencies(spark, sf_dir), 20)


@query(f"{TRAIN} SELECT * FROM contingency")
def contingency(spark, sf_dir):
    return contingency_table(spark, sf_dir)


#: The normal distribution by Simpson's rule, and its quantile by bisection.
QUANTILES = """WITH RECURSIVE asked AS (SELECT DISTINCT CAST(49 + l_quantity AS INTEGER) AS confidence FROM lineitem),
halved AS (SELECT confidence, 0.0::DOUBLE AS low, 6.0::DOUBLE AS high, 0 AS turn FROM asked
  UNION ALL SELECT confidence, CASE WHEN below < wanted THEN middle ELSE low END, CASE WHEN below < wanted THEN high ELSE middle END, turn + 1 FROM (
    SELECT *, (low + high) / 2 AS middle, 1 - (1 - confidence / 100.0) / 2 AS wanted, 0.5 + (low + high) / 2 / 1200 / sqrt(2 * pi())
      * list_sum(list_transform(generate_series(0, 400), lambda k: (CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow((low + high) / 2 * k / 400, 2) / 2))) AS below
    FROM halved WHERE turn < 50))
SELECT confidence, round(pow((low + high) / 2, 2), 2) AS critical FROM halved WHERE turn = 50"""


@query(QUANTILES)
def chi2_critical_values(spark, sf_dir):
    """Critical values for the confidences that the lines' quantities stand for, 50 to 99 percent."""
    confidence = (F.col("l_quantity") + 49).cast("int")
    values = F.create_map(*[F.lit(x) for c in range(1, 100) for x in (c, chi2_critical(c))])
    return td.table(spark, sf_dir, "lineitem").select(confidence.alias("confidence")).distinct().withColumn("critical", values[F.col("confidence")])


@query(f"{TRAIN} SELECT feature, round(chi2, 9) AS chi2 FROM scored")
def chi2_statistic(spark, sf_dir):
    return sel.scored_features(contingency_table(spark, sf_dir)).select("feature", F.round("chi2", 9).alias("chi2"))


@query(f"{TRAIN} SELECT feature, pos FROM vocabulary")
def select_features(spark, sf_dir):
    return train_and_vocabulary(spark, sf_dir)[1]


@query(f"{TRAIN} SELECT t.sample_id, t.label, t.feature, t.cnt, t.total, v.pos FROM train t JOIN vocabulary v USING (feature)")
def lookup_features(spark, sf_dir):
    return sel.lookup_features(*train_and_vocabulary(spark, sf_dir))


VECTORS = f"""{TRAIN}, known AS (SELECT t.sample_id, t.label, v.pos, t.cnt::DOUBLE / t.total AS weight FROM train t JOIN vocabulary v USING (feature)),
vectors AS (SELECT * FROM known UNION ALL SELECT DISTINCT sample_id, label, (SELECT count(*) FROM vocabulary)::INTEGER, 1.0 FROM train WHERE sample_id NOT IN (SELECT sample_id FROM known))"""


@query(f"{VECTORS} SELECT sample_id, label, pos, weight FROM vectors")
def feature_vectors(spark, sf_dir):
    return sel.feature_vectors(*train_and_vocabulary(spark, sf_dir))


@query(f"{VECTORS} SELECT x.sample_id, x.pos, v.feature FROM vectors x JOIN vocabulary v USING (pos)")
def lookup_positions(spark, sf_dir):
    train, vocab = train_and_vocabulary(spark, sf_dir)
    return sel.lookup_positions(sel.feature_vectors(train, vocab), vocab).select("sample_id", "pos", "feature")


@query(f"{VECTORS} SELECT sample_id, (SELECT count(*) + 1 FROM vocabulary)::INTEGER AS size, pos, weight FROM vectors")
def to_ml_vectors(spark, sf_dir):
    """The vectors' size and entries that are not 0."""
    train, vocab = train_and_vocabulary(spark, sf_dir)
    vectors = sel.to_ml_vectors(sel.feature_vectors(train, vocab), vocab.count())
    dense = vectors.select("sample_id", vector_to_array("features").alias("x"))
    return dense.select("sample_id", F.size("x").alias("size"), F.posexplode("x").alias("pos", "weight")).where("weight <> 0")


# Evaluation over given probabilities.
PREDICTED = f"""predictions AS (SELECT user_id AS sample_id, {EVENT_LABEL} AS label, event_type AS module, min(event_id) % 100 / 100.0::DOUBLE AS p_malicious FROM events GROUP BY user_id, event_type),
decided AS (SELECT *, CASE WHEN p_malicious >= 0.5 THEN 'malicious' ELSE 'benign' END AS predicted FROM predictions)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.predict_with_threshold(td.event_predictions(spark, sf_dir))


@query(f"WITH {PREDICTED} SELECT sample_id, label, module, p_malicious, predicted FROM decided")
def predict_with_threshold(spark, sf_dir):
    return predicted(spark, sf_dir)


@query(f"WITH {PREDICTED} SELECT sample_id, module, sample_id || ': ' || predicted AS line FROM decided")
def prediction_report(spark, sf_dir):
    return ev.prediction_report(predicted(spark, sf_dir), by=BY_MODULE)


#: The votes on a sample are held against the decision of each of its modules.
BY_MODULE = ("sample_id", "module")
AGREE = "agreement AS (SELECT v.sample_id, p.module, count(*) FILTER ((CASE WHEN v.p_malicious >= 0.5 THEN 'malicious' ELSE 'benign' END) = p.predicted) AS agreeing, count(*) AS trees FROM predictions v JOIN decided p ON v.sample_id = p.sample_id GROUP BY v.sample_id, p.module)"


@query(f"WITH {PREDICTED}, {AGREE} SELECT * FROM agreement")
def tree_agreement(spark, sf_dir):
    p = predicted(spark, sf_dir)
    return ev.tree_agreement(p.select("sample_id", F.col("module").alias("tree"), "p_malicious"), p, by=BY_MODULE)


@query(f"""WITH {PREDICTED}, {AGREE} SELECT d.sample_id, d.module, d.sample_id || ': ' || d.predicted || ' (' || d.label || ') Proba: [' || printf('%.4f', 1 - d.p_malicious) || ' ' || printf('%.4f', d.p_malicious) || '] Majority: ' || a.agreeing || '/' || a.trees AS line
FROM decided d JOIN agreement a USING (sample_id, module)""")
def prediction_report_verbose(spark, sf_dir):
    p = predicted(spark, sf_dir)
    return ev.prediction_report(p.join(tree_agreement(spark, sf_dir), list(BY_MODULE)), verbose=True, by=BY_MODULE)


@query(f"""WITH {PREDICTED}, c AS (SELECT count(*) FILTER (label = 'malicious' AND predicted = 'malicious') AS tp, count(*) FILTER (label = 'benign' AND predicted = 'malicious') AS fp,
count(*) FILTER (label = 'malicious' AND predicted = 'benign') AS fn, count(*) FILTER (label = 'benign' AND predicted = 'benign') AS tn FROM decided WHERE label <> '?')
SELECT *, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS detection, tp::DOUBLE / (tp + fn) AS tpr, tn::DOUBLE / (tn + fp) AS tnr FROM c""")
def detection_score(spark, sf_dir):
    return ev.detection_score(predicted(spark, sf_dir).where("label <> '?'"))


@query(f"""WITH {PREDICTED}, v AS (SELECT sample_id,
  min(predicted) FILTER (module IN ('click', 'error')) AS lo1, max(predicted) FILTER (module IN ('click', 'error')) AS hi1, count(DISTINCT module) FILTER (module IN ('click', 'error')) AS n1,
  min(predicted) FILTER (module IN ('signup', 'view')) AS lo2, max(predicted) FILTER (module IN ('signup', 'view')) AS hi2, count(DISTINCT module) FILTER (module IN ('signup', 'view')) AS n2 FROM decided GROUP BY sample_id)
SELECT sample_id, CASE WHEN n1 = 2 AND lo1 = hi1 THEN lo1 WHEN n2 = 2 AND lo2 = hi2 THEN lo2 ELSE 'forwarded' END AS result, CASE WHEN n1 = 2 AND lo1 = hi1 THEN 1 WHEN n2 = 2 AND lo2 = hi2 THEN 2 ELSE 0 END AS layer FROM v""")
def vote_modules(spark, sf_dir):
    return ev.vote_modules(predicted(spark, sf_dir), ["click", "error"], ["signup", "view"])


# Trees and edges.
NODES = """paths AS (
  SELECT c_custkey::BIGINT AS sample_id, NULL::BIGINT AS c, NULL::BIGINT AS o, NULL::INTEGER AS l, NULL::BIGINT AS p, NULL::BIGINT AS s, 0 AS depth, 'Program' AS name, NULL AS vname, NULL AS vvalue, NULL AS value_type FROM customer
  UNION ALL SELECT c_custkey, c_custkey, NULL, NULL, NULL, NULL, 1, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'IfStatement' WHEN 'BUILDING' THEN 'WhileStatement' WHEN 'FURNITURE' THEN 'ForStatement' WHEN 'MACHINERY' THEN 'SwitchStatement' ELSE 'TryStatement' END, NULL, NULL, NULL FROM customer
  UNION ALL SELECT c_custkey, c_custkey, o_orderkey, NULL, NULL, NULL, 2, CASE o_orderstatus WHEN 'O' THEN 'ExpressionStatement' WHEN 'F' THEN 'BlockStatement' ELSE 'SwitchCase' END, NULL, NULL, NULL FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT c_custkey, c_custkey, o_orderkey, l_linenumber, l_partkey, l_suppkey, 3, CASE WHEN l_returnflag = 'R' THEN 'Identifier' WHEN l_returnflag = 'A' THEN 'Literal' WHEN l_linestatus = 'O' THEN 'Line' ELSE 'CallExpression' END,
    CASE WHEN l_returnflag = 'R' THEN 'v' || (l_partkey % 50) END, CASE WHEN l_returnflag = 'A' THEN (l_quantity::INTEGER)::VARCHAR END, CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber % 2 = 1 THEN 'int' ELSE 'string' END END
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
ids AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY c NULLS FIRST, o NULLS FIRST, l NULLS FIRST, p NULLS FIRST, s NULLS FIRST, name, vname NULLS FIRST, vvalue NULLS FIRST) - 1 AS INTEGER) AS node_id FROM paths),
up AS (SELECT *, CASE depth WHEN 1 THEN 0 WHEN 2 THEN last_value(CASE WHEN depth = 1 THEN node_id END IGNORE NULLS) OVER w WHEN 3 THEN last_value(CASE WHEN depth = 2 THEN node_id END IGNORE NULLS) OVER w END AS parent_id,
  CASE depth WHEN 0 THEN max(node_id) OVER (PARTITION BY sample_id) WHEN 1 THEN max(node_id) OVER (PARTITION BY sample_id, c) WHEN 2 THEN max(node_id) OVER (PARTITION BY sample_id, c, o) ELSE node_id END AS subtree_end
  FROM ids WINDOW w AS (PARTITION BY sample_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ix AS (SELECT *, CASE WHEN parent_id IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY sample_id, parent_id ORDER BY node_id) - 1 AS INTEGER) END AS child_ix FROM up),
kids AS (SELECT sample_id, parent_id AS node_id, count(*) AS n_children FROM ix WHERE parent_id IS NOT NULL GROUP BY 1, 2),
nodes AS MATERIALIZED (SELECT ix.*, coalesce(n_children, 0) AS n_children, CASE child_ix WHEN 0 THEN 'body' WHEN 1 THEN 'handler' WHEN 2 THEN 'finalizer' ELSE CASE WHEN child_ix IS NOT NULL THEN 'other' END END AS body FROM ix LEFT JOIN kids USING (sample_id, node_id))"""
CODES = f"codes AS (SELECT * FROM (VALUES {', '.join(f'({_q(k)}, {v})' for k, v in TREE_CODES.items())}) AS t(name, unit))"


@query(f"WITH {NODES} SELECT sample_id, md5(string_agg(name, ',' ORDER BY node_id) FILTER (parent_id IS NOT NULL)) AS units, count(*) FILTER (parent_id IS NOT NULL) AS n_units FROM nodes GROUP BY sample_id")
def ast_units(spark, sf_dir):
    return tr.ast_units(td.order_trees(spark, sf_dir)).select(
        "sample_id",
        F.when(F.size("units") > 0, F.md5(F.array_join("units", ","))).alias("units"),
        F.size("units").cast("long").alias("n_units"),
    )


@query(f"WITH {NODES} SELECT sample_id, node_id, subtree_end - node_id AS descendants FROM nodes")
def subtree_size(spark, sf_dir):
    return tr.subtree_size(td.order_trees(spark, sf_dir))


CONTEXT = f"""{NODES}, onward AS (SELECT *, first_value(CASE WHEN name = 'Identifier' THEN node_id END IGNORE NULLS) OVER w AS ident_at, first_value(CASE WHEN name = 'Identifier' THEN vname END IGNORE NULLS) OVER w AS ident
  FROM nodes WINDOW w AS (PARTITION BY sample_id ORDER BY node_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), context AS (SELECT * FROM onward WHERE ident_at <= subtree_end)"""


@query(f"WITH {CONTEXT} SELECT sample_id, node_id, name, ident AS value FROM context")
def context_values(spark, sf_dir):
    return tr.context_values(td.order_trees(spark, sf_dir)).select("sample_id", "node_id", "name", "value")


@query(f"""WITH {CONTEXT}, {CODES}, pairs AS (
  SELECT sample_id, node_id, CASE value_type WHEN 'string' THEN 'String' ELSE 'Int' END AS name, vvalue AS value FROM nodes WHERE name = 'Literal' AND vvalue IS NOT NULL AND parent_id IS NOT NULL
  UNION ALL SELECT sample_id, node_id, name, ident FROM context WHERE name <> 'Literal' AND parent_id IS NOT NULL)
SELECT sample_id, node_id, name, value, unit FROM pairs LEFT JOIN codes USING (name)""")
def ast_value_features(spark, sf_dir):
    return tr.ast_value_features(td.order_trees(spark, sf_dir))


@query(f"WITH {NODES} SELECT sample_id, node_id, CASE value_type WHEN 'string' THEN 'String' WHEN 'int' THEN 'Int' ELSE 'Literal' END AS literal, coalesce(vvalue, vname) AS leaf FROM nodes")
def literal_type_and_leaf_value(spark, sf_dir):
    return td.order_trees(spark, sf_dir).select(
        "sample_id",
        "node_id",
        literal_type(F.col("value_type"), F.col("attributes")).alias("literal"),
        leaf_value(F.col("attributes")).alias("leaf"),
    )


@query(f"""WITH {NODES}, own AS (SELECT sample_id, node_id, c, o, depth, CASE WHEN name IN ({_names(STATEMENTS)}) THEN node_id END AS statement FROM nodes)
SELECT sample_id, node_id, coalesce(statement, max(CASE WHEN depth = 2 THEN statement END) OVER (PARTITION BY sample_id, c, o), max(CASE WHEN depth = 1 THEN statement END) OVER (PARTITION BY sample_id, c)) AS statement FROM own""")
def nearest_statement(spark, sf_dir):
    return tr.nearest_statement(td.order_trees(spark, sf_dir))


#: The edges to children as a table: parent, first and last place of the child, what the child must be, type, label.
ANY, FORS, IFS = 2**30, ("ForStatement", "ForOfStatement", "ForInStatement"), ("IfStatement", "ConditionalExpression")
LINKS = (("comment", "comment", "c"), ("no comment", "statement", "s"))
EDGE_TABLE = [
    ("DoWhileStatement", 0, 0, "any", "control", "true"), *[("DoWhileStatement", 1, 1, *x) for x in LINKS], ("DoWhileStatement", 2, 2, "comment", "comment", "c"),
    *[(p, 0, ANY, *x) for p in FORS for x in (("body, no comment", "control", "true"), ("no body, comment", "comment", "c"), ("no body, no comment", "statement", "s"))],
    *[(p, *x) for p in IFS for x in ((1, 1, "any", "control", "true"), (2, 2, "comment", "comment", "c"), (2, 2, "no comment", "control", "false"), (3, 3, "comment after no comment", "comment", "c"))],
    *[(p, 0, 0, *x) for p in (*IFS, "WhileStatement", "SwitchStatement") for x in LINKS],
    ("TryStatement", 0, 0, "any", "control", "true"), ("TryStatement", 1, 1, "handler", "control", "false"), ("TryStatement", 1, 1, "no handler", "control", "e"),
    ("TryStatement", 2, 2, "finalizer", "control", "e"), ("TryStatement", 2, 2, "comment, no finalizer", "comment", "c"), ("TryStatement", 3, 3, "comment after finalizer", "comment", "c"),
    ("WhileStatement", 1, 1, "any", "control", "true"), ("WhileStatement", 2, 2, "comment", "comment", "c"),
    ("SwitchStatement", 1, 1, "any", "control", "e"), ("SwitchStatement", 2, ANY, "comment", "comment", "c"), ("SwitchStatement", 2, ANY, "no comment", "control", "false"),
    ("only in case", 0, 0, "any", "control", "true"), ("last case", 0, ANY, "comment", "comment", "c"), ("last case", 0, ANY, "no comment", "control", "true"),
    *[("case", 0, 0, *x) for x in LINKS], ("case", 1, ANY, "comment", "comment", "c"), ("case", 1, ANY, "no comment", "control", "true"),
    ("other", 0, ANY, "plain statement", "control", "e"), *[("other", 0, ANY, f"no statement, {x[0]}", *x[1:]) for x in LINKS],
]
RULES = f"rules AS (SELECT * FROM (VALUES {', '.join(str(r) for r in EDGE_TABLE)}) AS t(parent, low, high, what, type, label))"


@query(f"""WITH {NODES}, {RULES}, c AS (SELECT *, lag(node_id) OVER s AS before_id, lag(body) OVER s AS before_body, lag(name) OVER s AS before_name FROM nodes WINDOW s AS (PARTITION BY sample_id, parent_id ORDER BY child_ix)),
marked AS (SELECT *, CASE WHEN name IN ({_names(COMMENTS)}) THEN 'comment' ELSE 'no comment' END AS k FROM c),
traits AS (SELECT sample_id, node_id, parent_id, child_ix, name, before_id, k, ['any', k,
  CASE WHEN body = 'body' THEN 'body, ' ELSE 'no body, ' END || k, CASE WHEN body = 'handler' THEN 'handler' ELSE 'no handler' END, CASE WHEN body = 'finalizer' THEN 'finalizer' ELSE k || ', no finalizer' END,
  CASE WHEN name IN ({_names(STATEMENTS)}) THEN 'plain statement' ELSE 'no statement, ' || k END,
  k || CASE WHEN before_name IN ({_names(COMMENTS)}) THEN ' after comment' ELSE ' after no comment' END, k || CASE WHEN before_body = 'finalizer' THEN ' after finalizer' ELSE ' after other' END] AS what FROM marked),
parents AS (SELECT p.sample_id, p.node_id, p.name, CASE WHEN p.name = 'SwitchCase' AND p.n_children = 1 THEN 'only in case' WHEN p.name = 'SwitchCase' AND up.name = 'SwitchStatement' AND p.child_ix = up.n_children - 1 AND p.child_ix >= 2 THEN 'last case' WHEN p.name = 'SwitchCase' THEN 'case'
  WHEN p.name IN (SELECT parent FROM rules) THEN p.name ELSE 'other' END AS rule FROM nodes p JOIN nodes up ON p.sample_id = up.sample_id AND p.parent_id = up.node_id)
SELECT t.sample_id, CASE WHEN p.name = 'SwitchStatement' AND t.child_ix >= 2 AND t.k = 'no comment' THEN t.before_id ELSE p.node_id END AS src, t.node_id AS dst, r.type, r.label, t.child_ix AS ord
FROM traits t JOIN parents p ON t.sample_id = p.sample_id AND t.parent_id = p.node_id JOIN rules r ON r.parent = p.rule AND t.child_ix BETWEEN r.low AND r.high AND list_contains(t.what, r.what)""")
def structure_edges(spark, sf_dir):
    return tr.structure_edges(td.order_trees(spark, sf_dir))


IDENTIFIERS = """ids AS (SELECT l_suppkey AS sample_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS pos, 'v' || (l_partkey % 50) AS name, l_returnflag = 'R' AS def, l_returnflag = 'R' AND l_linestatus = 'F' AS fn FROM lineitem),
linked AS (SELECT *, coalesce(max(CASE WHEN def THEN pos END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), min(CASE WHEN fn THEN pos END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS begin_id
  FROM ids WINDOW w AS (PARTITION BY sample_id, name ORDER BY pos))"""


@query(f"WITH {IDENTIFIERS} SELECT sample_id, 0 AS scope, name, begin_id, pos AS end_id, 0 AS ord FROM linked WHERE NOT def AND begin_id IS NOT NULL")
def def_use_edges(spark, sf_dir):
    return tr.def_use_edges(td.identifier_events(spark, sf_dir))


def reserved_words(spark: SparkSession, extra: list[str] = ()) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(w.lower()) for w in [*RESERVED, *extra]])).alias("word")).distinct()


@query(f"WITH {IDENTIFIERS} SELECT DISTINCT sample_id, name FROM linked WHERE NOT def AND begin_id IS NULL AND name NOT IN ('v7', 'v8')")
def undeclared_identifiers(spark, sf_dir):
    return tr.undeclared_identifiers(td.identifier_events(spark, sf_dir), reserved_words(spark, ["v7", "v8"]))


@query()
def flatten_tree(spark, sf_dir):
    """Each order as a tree in JSON, flattened again."""
    lines = td.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("x")
    )
    node = lambda x: F.concat(
        F.lit('{"type":"ExpressionStatement","expression":{"type":"Identifier","name":"v'),
        (x["l_partkey"] % 50).cast("string"),
        F.lit('"}}'),
    )
    trees = lines.select(
        F.col("l_orderkey").alias("sample_id"),
        F.concat(
            F.lit('{"type":"Program","body":['), F.array_join(F.transform("x", node), ","), F.lit("]}")
        ).alias("tree"),
    )
    return tr.flatten_tree(trees).select(
        "sample_id",
        "node_id",
        "parent_id",
        "child_ix",
        "n_children",
        "depth",
        "subtree_end",
        "name",
        "body",
        F.element_at("attributes", "name").alias("ident"),
    )


ORACLE_SQL["flatten_tree"] = """WITH l AS (SELECT l_orderkey AS sample_id, CAST(row_number() OVER w - 1 AS INTEGER) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, 'v' || (l_partkey % 50) AS v FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag))
SELECT DISTINCT sample_id, 0 AS node_id, CAST(NULL AS INTEGER) AS parent_id, 0 AS child_ix, n AS n_children, 0 AS depth, 2 * n AS subtree_end, 'Program' AS name, CAST(NULL AS VARCHAR) AS body, CAST(NULL AS VARCHAR) AS ident FROM l
UNION ALL SELECT sample_id, 2 * k + 1, 0, k, 1, 1, 2 * k + 2, 'ExpressionStatement', 'body', NULL FROM l
UNION ALL SELECT sample_id, 2 * k + 2, 2 * k + 1, 0, 0, 2, 2 * k + 2, 'Identifier', 'expression', v FROM l"""


def flow_edges(nodes: DataFrame) -> DataFrame:
    """Control edges, and data edges between the statements of the identifiers."""
    control = tr.structure_edges(nodes).select("sample_id", "src", "dst", "type", "ord")
    names = nodes.where("name = 'Identifier'").select(
        "sample_id",
        F.lit(0).alias("scope"),
        F.col("node_id").alias("pos"),
        F.lit(0).alias("k"),
        F.element_at("attributes", "name").alias("name"),
        F.when(F.col("child_ix") == 0, "def").otherwise("use").alias("kind"),
        F.lit(False).alias("is_function"),
    )
    data = tr.def_use_edges(names, nodes).select(
        "sample_id", "src", "dst", F.lit("data").alias("type"), F.col("end_id").alias("ord"), "begin_id", "end_id"
    )
    return control.unionByName(data, allowMissingColumns=True)


def _flow(spark, sf_dir, level, features_="ngrams"):
    units = tr.name_flow(td.order_trees(spark, sf_dir), level, features_)
    shown = F.transform("units", lambda u: F.concat_ws(":", u["unit"], u["value"])) if features_ == "value" else F.col("units")
    return units.select("sample_id", F.size("units").cast("long").alias("n_units"), F.md5(F.array_join(shown, ",")).alias("units"))


@query()
def flow_units_cfg(spark, sf_dir):
    return _flow(spark, sf_dir, "cfg")


@query()
def flow_units_pdg_dfg(spark, sf_dir):
    return _flow(spark, sf_dir, "pdg-dfg")


@query()
def flow_units_pdg(spark, sf_dir):
    return _flow(spark, sf_dir, "pdg")


@query()
def flow_units_pdg_value(spark, sf_dir):
    return _flow(spark, sf_dir, "pdg", "value")


# Names in programs. The SQL knows the shapes of the statements: their sizes, what each says about names at which node, and
# where each node is in evaluation order. It looks at all pairs of events of a name.
#: (compound, group, nodes before its lines, place in evaluation order); a do loop's test and a try's finalizer move up.
GROUPS = [(0, 0, 4, 0), (1, 0, 2, 0), (1, 1, 1, 1), (1, 2, 1, 2), (2, 0, 1, 0), (2, 1, 1, 2), (2, 2, 3, 3), (2, 3, 1, 1), (3, 0, 1, 0), (3, 1, 1, 2), (3, 2, 1, 1), (4, 0, 3, 0), (5, 0, 1, 0)]
#: (kind of line, nodes)
SIZES = list(enumerate((2, 4, 4, 4, 4, 3, 6, 6, 6, 7, 8, 4)))
#: (kind of line or name of a compound, group or null, node, node in evaluation order, step, name, kind, how, serves earlier uses,
#: quiet, scope, statement): scope is a node of the statement, or what "var" and "let" mean there.
SAID = [
    (0, None, 1, 1, 0, "x", "use", None, False, False, None, 0), (1, None, 2, 2, 0, "x", "def", "declare", False, False, "var", 0), (1, None, 3, 3, 0, "y", "use", None, False, False, None, 0),
    (2, None, 2, 2, 0, "x", "def", "declare", False, False, "let", 0), (2, None, 3, 3, 0, "y", "use", None, False, False, None, 0), (3, None, 2, 2, 1, "x", "def", "assign", False, False, None, 0),
    (3, None, 3, 3, 0, "y", "use", None, False, False, None, 0), (4, None, 2, 2, 1, "x", "def", "assign", False, False, None, 0), (4, None, 2, 2, 2, "x", "use", None, False, False, None, 0),
    (5, None, 2, 2, 0, "x", "use", None, False, False, None, 0), (5, None, 2, 2, 1, "x", "def", "assign", False, False, None, 0), (5, None, 2, 2, 2, "x", "use", None, False, False, None, 0),
    (6, None, 3, 3, 0, "x", "use", None, False, True, None, 0), (6, None, 3, 3, 1, "x", "def", "assign", False, False, None, 0), (6, None, 5, 5, 0, "y", "use", None, False, False, None, 0),
    (7, None, 3, 3, 0, "x", "use", None, False, True, None, 0), (7, None, 3, 3, 1, "x", "def", "call", False, False, None, 0), (7, None, 5, 5, 0, "y", "use", None, False, False, None, 0),
    (8, None, 2, 2, 0, "f", "use", None, False, False, None, 0), (8, None, 4, 4, 0, "x", "use", None, False, False, None, 0), (8, None, 5, 5, 0, "y", "use", None, False, False, None, 0),
    (9, None, 2, 2, 1, "x", "def", "assign", False, False, None, 0), (9, None, 5, 5, 0, "k", "def", "declare", True, False, "3", 0), (9, None, 6, 6, 0, "y", "use", None, False, False, "3", 0),
    (10, None, 2, 2, 1, "x", "def", "assign", False, False, None, 0), (10, None, 4, 4, 0, "y", "def", "declare", False, False, "3", 0), (10, None, 7, 7, 0, "x", "use", None, False, False, "3", 6),
    (11, None, 3, 2, 0, "x", "use", None, False, False, None, 0),
    (100, 0, 1, 1, 0, "f", "def", "declare", True, False, "root", 0), (100, 0, 2, 2, 0, "x", "def", "declare", False, False, "var", 0), (101, 0, 1, 1, 0, "x", "use", None, False, False, None, 0),
    (102, 2, 1, 1, 0, "x", "def", "declare", False, False, "var", 0), (103, 2, 0, 0, 0, "x", "use", None, False, False, None, -1), (104, 0, 1, 1, 0, "x", "use", None, False, False, None, 0),
]


def _values(rows: list[tuple]) -> str:
    shown = lambda v: "NULL" if v is None else _q(v) if isinstance(v, str) else str(v)
    return ", ".join(f"({', '.join(map(shown, r))})" for r in rows)


PROGRAMS = f"""grps AS (SELECT * FROM (VALUES {_values(GROUPS)}) AS t(shape, grp, head, turn)), sizes AS (SELECT * FROM (VALUES {_values(SIZES)}) AS t(kind, n)),
said AS (SELECT * FROM (VALUES {_values(SAID)}) AS t(kind, of_grp, node, told, k, who, what, how, is_function, quiet, scope, stmt)),
o AS (SELECT o_custkey AS sample_id, o_orderkey AS o, o_orderkey % 6 AS shape, 'v' || (o_orderkey % 4) AS x, 'f' || (o_orderkey % 3) AS f FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
parts AS (
  SELECT sample_id, o, o.shape, grp, turn, -1 AS line, 0 AS p, 0 AS s, 100 + o.shape AS kind, head AS n, x, NULL AS y, f, NULL AS key FROM o JOIN grps USING (shape)
  UNION ALL SELECT sample_id, o, o.shape, grp, turn, l_linenumber, l_partkey, l_suppkey, l_partkey % 12, n, 'v' || (l_partkey // 12 % 4), 'v' || (l_suppkey % 4), 'f' || (l_suppkey % 3), 'k' || (l_suppkey % 2)
    FROM lineitem JOIN o ON l_orderkey = o JOIN sizes ON sizes.kind = l_partkey % 12 JOIN grps ON grps.shape = o.shape
      AND grps.grp = CASE o.shape WHEN 1 THEN 1 + (l_linenumber + 1) % 2 WHEN 2 THEN 1 + (l_linenumber + 2) % 3 WHEN 3 THEN 1 ELSE 0 END),
based AS (SELECT *, CAST(1 + coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base, CAST(1 + coalesce(sum(n) OVER (e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seq FROM parts
  WINDOW w AS (PARTITION BY sample_id ORDER BY o, grp, line, p, s), e AS (PARTITION BY sample_id ORDER BY o, turn, line, p, s)),
homes AS (SELECT o, min(base) AS first FROM based GROUP BY o),
events AS MATERIALIZED (SELECT sample_id, o, shape, grp, base + node AS pos, (seq + told) * 4 + k AS t, CASE who WHEN 'x' THEN x WHEN 'y' THEN y WHEN 'f' THEN f ELSE key END AS name, what AS kind, how, is_function, quiet,
    shape <> 0 AND coalesce(scope, '') <> '3' AS top,
    CASE WHEN how = 'declare' THEN CASE WHEN scope = 'root' THEN 0 WHEN scope = '3' THEN base + 3 WHEN shape <> 0 THEN -1 WHEN scope = 'let' THEN first + 3 ELSE first END END AS scope,
    CASE WHEN scope = '3' THEN base + 3 WHEN shape = 0 AND coalesce(scope, '') <> 'root' THEN first ELSE 0 END AS home,
    list_concat(CASE WHEN shape = 0 AND coalesce(scope, '') <> 'root' THEN [0, first, first + 3] ELSE [0] END, CASE WHEN scope = '3' THEN [base + 3] ELSE [] END) AS scopes,
    CASE WHEN stmt = -1 THEN first ELSE base + stmt END AS stmt
  FROM based JOIN said ON said.kind = based.kind AND (of_grp IS NULL OR of_grp = grp) JOIN homes USING (o))"""


@query(f"WITH {PROGRAMS} SELECT sample_id, pos, t, name, kind, how, is_function, quiet, scope FROM events")
def identifier_events(spark, sf_dir):
    return fl.identifier_events(td.programs(spark, sf_dir)).select(
        "sample_id", F.col("pos").cast("long").alias("pos"), "t", "name", "kind", "how", "is_function", "quiet", F.col("scope").cast("long").alias("scope")
    )


LINKED = f"""{PROGRAMS}, seen AS (SELECT u.sample_id, u.t, d.t AS d_t, d.scope AS d_scope, d.how FROM events u JOIN events d ON u.sample_id = d.sample_id AND u.name = d.name AND d.t < u.t AND NOT (u.o = d.o AND u.shape IN (1, 2) AND d.grp = 1 AND u.grp = 2)
    WHERE u.how IN ('assign', 'call') AND d.how = 'declare' AND d.scope <> -1 AND list_contains(u.scopes, d.scope)),
owned AS (SELECT e.*, CASE WHEN e.how = 'declare' THEN e.scope WHEN e.top THEN -1 WHEN m.inner_scope IS NULL THEN -1 ELSE greatest(m.inner_scope, e.home) END AS lives
  FROM events e LEFT JOIN (SELECT sample_id, t, max(d_scope) AS inner_scope FROM seen GROUP BY sample_id, t) m ON m.sample_id = e.sample_id AND m.t = e.t WHERE e.kind = 'def'),
defs AS MATERIALIZED (SELECT * FROM owned c WHERE how <> 'call' OR EXISTS (SELECT 1 FROM seen s WHERE s.sample_id = c.sample_id AND s.t = c.t)
    OR EXISTS (SELECT 1 FROM owned d WHERE d.sample_id = c.sample_id AND d.name = c.name AND d.t < c.t AND d.how <> 'call' AND d.lives = -1 AND NOT (c.o = d.o AND c.shape IN (1, 2) AND d.grp = 1 AND c.grp = 2))),
fits AS MATERIALIZED (SELECT u.sample_id, u.t, d.t AS d_t, d.pos AS d_pos, d.lives, d.o, d.shape, d.grp FROM events u JOIN defs d ON u.sample_id = d.sample_id AND u.name = d.name AND d.t < u.t AND NOT (u.o = d.o AND u.shape IN (1, 2) AND d.grp = 1 AND u.grp = 2)
    WHERE u.kind = 'use' AND (d.lives = -1 OR list_contains(u.scopes, d.lives) AND NOT (u.quiet AND u.top))),
best AS (SELECT sample_id, t, max({{'local': lives <> -1, 'd_t': d_t, 'lives': lives}}) AS b FROM fits GROUP BY sample_id, t),
same AS MATERIALIZED (SELECT f.*, f.d_t = b.b.d_t AS latest FROM fits f JOIN best b ON f.sample_id = b.sample_id AND f.t = b.t AND f.lives = b.b.lives AND f.d_t <= b.b.d_t),
reaching AS (SELECT * FROM same d WHERE NOT EXISTS (SELECT 1 FROM same k WHERE k.sample_id = d.sample_id AND k.t = d.t AND k.d_t > d.d_t AND NOT (k.o = d.o AND d.shape IN (1, 2) AND d.grp = 1 AND k.grp = 2))),
unknown AS (SELECT * FROM events u WHERE kind = 'use' AND NOT quiet AND NOT EXISTS (SELECT 1 FROM fits f WHERE f.sample_id = u.sample_id AND f.t = u.t)),
links AS MATERIALIZED (
  SELECT u.sample_id, u.name, u.pos AS end_id, u.t, r.d_pos AS begin_id, r.d_t AS begin_t, CASE WHEN r.latest THEN 'before' ELSE 'branch' END AS how FROM reaching r JOIN events u ON r.sample_id = u.sample_id AND r.t = u.t
  UNION ALL SELECT u.sample_id, u.name, u.pos, u.t, arg_min(d.pos, d.t), min(d.t), CASE WHEN min(d.t) IS NOT NULL THEN 'later' END FROM unknown u LEFT JOIN events d ON d.sample_id = u.sample_id AND d.name = u.name AND d.is_function AND d.t > u.t GROUP BY u.sample_id, u.name, u.pos, u.t)"""


@query(f"WITH {LINKED} SELECT sample_id, name, end_id, t, begin_id, begin_t, how FROM links")
def resolved_names(spark, sf_dir):
    found = fl.resolved_names(td.programs(spark, sf_dir))
    return found.withColumns({c: F.col(c).cast("long") for c in ("end_id", "begin_id")})


@query(f"""WITH {LINKED} SELECT l.sample_id, d.stmt AS src, u.stmt AS dst, CASE WHEN l.how = 'later' THEN l.begin_t ELSE l.t END AS ord, l.begin_id, l.end_id FROM links l
JOIN (SELECT DISTINCT sample_id, pos, stmt FROM events) d ON d.sample_id = l.sample_id AND d.pos = l.begin_id JOIN (SELECT DISTINCT sample_id, pos, stmt FROM events) u ON u.sample_id = l.sample_id AND u.pos = l.end_id""")
def data_edges(spark, sf_dir):
    return fl.data_edges(td.programs(spark, sf_dir)).select("sample_id", "ord", *[F.col(c).cast("long").alias(c) for c in ("src", "dst", "begin_id", "end_id")])


@query(f"WITH {LINKED} SELECT DISTINCT sample_id, name FROM links WHERE how IS NULL")
def undeclared_names(spark, sf_dir):
    return fl.undeclared_names(td.programs(spark, sf_dir))


# Models and modules.
def trained(spark: SparkSession, sf_dir: str):
    """Model, vocabulary and stored vectors of the validation samples."""
    train, validation = halves(spark, sf_dir)
    model, vocab = modules.train_on_counts(train, validation, MIN_DF, CONFIDENCE, TREES)
    return model, vocab, sel.feature_vectors(validation, vocab)


@query()
def train_forest(spark, sf_dir):
    model, _, vectors = trained(spark, sf_dir)
    return mo.probabilities(sel.to_ml_vectors(vectors, model.numFeatures - 1), model)


@query()
def classify_module(spark, sf_dir):
    model, vocab, _ = trained(spark, sf_dir)
    return modules.classify_module(td.text_units(spark, sf_dir).where("sample_id % 2 = 1"), model, vocab)


@query()
def tree_votes(spark, sf_dir):
    model, _, vectors = trained(spark, sf_dir)
    return mo.tree_votes(model, sel.to_ml_vectors(vectors, model.numFeatures - 1))


@query()
def majority_report(spark, sf_dir):
    """The verbose report of a fitted forest: labels, probabilities, and how many of its trees agree."""
    model, _, vectors = trained(spark, sf_dir)
    return ev.prediction_report(mo.majority(model, sel.to_ml_vectors(vectors, model.numFeatures - 1)), verbose=True)


@query()
def score_stored_analysis(spark, sf_dir):
    """A model and vectors are stored and scored from what was stored alone."""
    model, _, vectors = trained(spark, sf_dir)
    base = shared_folder(spark)
    mo.write_model(model, f"{base}/model")
    write_artifact(vectors, base, "tokens", "ngrams", "vectors")
    return mo.score_stored_analysis(read_artifact(spark, base, "tokens", "ngrams", "vectors"), mo.read_model(f"{base}/model"))


@query(f"""WITH {EVENT_UNITS}, {_grams()}, {COUNTS}, vals AS (SELECT user_id AS sample_id, {EVENT_LABEL} AS label, event_type || ':' || coalesce(replace(props, chr(10), ''), '\\N') AS feature, count(*) OVER (PARTITION BY user_id) AS total FROM events),
everything AS (SELECT 'events' AS level, 'ngrams' AS features, label, feature FROM sample_features UNION ALL SELECT DISTINCT ON (sample_id, feature) 'events', 'value', label, feature FROM vals)
SELECT level, features, label, feature, count(*) AS df FROM everything GROUP BY ALL""")
def run_modules(spark, sf_dir):
    counted = modules.run_modules(
        {("events", "ngrams"): td.event_units(spark, sf_dir), ("events", "value"): td.event_values(spark, sf_dir)}
    )
    return counted.groupBy("level", "features", "label", "feature").agg(F.count(F.lit(1)).alias("df"))


KEYED = f"""WITH {SAMPLES}, {_lexed('samples')}, {_grams()}, {COUNTS}, {EVENT_UNITS.replace('units AS', 'event_units AS', 1)}, {_grams('event_units').replace('grams AS', 'event_grams AS', 1)},
vals AS (SELECT user_id AS sample_id, {EVENT_LABEL} AS label, event_type || ':' || coalesce(replace(props, chr(10), ''), '\\N') AS feature, count(*) OVER (PARTITION BY user_id) AS total FROM events),
counts AS MATERIALIZED (SELECT 'tokens' AS level, 'ngrams' AS features, * FROM sample_features
  UNION ALL SELECT 'events', 'ngrams', sample_id, label, feature, count(*), max(total) FROM (SELECT sample_id, label, unnest(keys) AS feature, len(keys) AS total FROM event_grams) GROUP BY sample_id, label, feature
  UNION ALL SELECT 'events', 'value', sample_id, label, feature, count(*), max(total) FROM vals GROUP BY sample_id, label, feature),
train AS (SELECT * FROM counts WHERE sample_id % 2 = 0), validation AS (SELECT * FROM counts WHERE sample_id % 2 = 1),
candidates AS (SELECT DISTINCT level, features, feature FROM (SELECT level, features, label, feature FROM train WHERE label IN ('benign', 'malicious') GROUP BY level, features, label, feature HAVING count(*) > {MIN_DF})),
totals AS (SELECT level, features, count(DISTINCT CASE WHEN label = 'benign' THEN sample_id END) AS ben, count(DISTINCT CASE WHEN label = 'malicious' THEN sample_id END) AS mal FROM validation GROUP BY level, features),
present AS (SELECT level, features, feature, count(*) FILTER (label = 'benign') AS b, count(*) FILTER (label = 'malicious') AS m FROM validation GROUP BY level, features, feature),
terms AS (SELECT level, features, feature, coalesce(b, 0)::DOUBLE AS a, (ben - coalesce(b, 0))::DOUBLE AS b, coalesce(m, 0)::DOUBLE AS c, (mal - coalesce(m, 0))::DOUBLE AS d FROM candidates LEFT JOIN present USING (level, features, feature) JOIN totals USING (level, features)),
gaps AS (SELECT *, a + b + c + d AS n, greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0.0) AS gap, (a + b) * (c + d) * (a + c) * (b + d) AS below FROM terms),
vocabulary AS (SELECT level, features, feature, CAST(row_number() OVER (PARTITION BY level, features ORDER BY feature) - 1 AS INTEGER) AS pos FROM gaps WHERE CASE WHEN below = 0 THEN 0.0 ELSE n * gap * gap / below END >= {chi2_critical(CONFIDENCE)})"""


def three_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature counts of a module over documents and two over events, in one table."""
    samples = {("tokens", "ngrams"): td.text_units(spark, sf_dir), ("events", "ngrams"): td.event_units(spark, sf_dir), ("events", "value"): td.event_values(spark, sf_dir)}
    return store(modules.run_modules(samples), "counts")


def keyed_halves(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return counts.where("sample_id % 2 = 0"), counts.where("sample_id % 2 = 1")


@query(f"{KEYED} SELECT level, features, feature, pos FROM vocabulary")
def module_vocabularies(spark, sf_dir):
    return modules.learn_vocabularies(*keyed_halves(three_modules(spark, sf_dir)), MIN_DF, CONFIDENCE)


@query(f"""{KEYED}, known AS (SELECT level, features, t.sample_id, t.label, v.pos, t.cnt::DOUBLE / t.total AS weight FROM counts t JOIN vocabulary v USING (level, features, feature)),
ends AS (SELECT level, features, count(v.pos)::INTEGER AS pos FROM (SELECT DISTINCT level, features FROM counts) LEFT JOIN vocabulary v USING (level, features) GROUP BY level, features)
SELECT * FROM known UNION ALL SELECT DISTINCT c.level, c.features, c.sample_id, c.label, e.pos, 1.0 FROM counts c JOIN ends e USING (level, features) WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.level = c.level AND k.features = c.features AND k.sample_id = c.sample_id)""")
def module_vectors(spark, sf_dir):
    counts = three_modules(spark, sf_dir)
    vocabularies = store(modules.learn_vocabularies(*keyed_halves(counts), MIN_DF, CONFIDENCE), "vocabularies")
    return sel.feature_vectors(counts, vocabularies, modules.MODULE)


def labelled_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, label, tree. The labels of a task's programs are looked up by hash, so that texts are not sorted."""
    return td.programs(spark, sf_dir).join(td.program_labels(spark, sf_dir).hint("shuffle_hash"), "sample_id").select("sample_id", "label", "tree")


def program_modules(spark: SparkSession, sf_dir: str) -> dict[tuple[str, str], DataFrame]:
    """All ten modules over the customers' programs: unit arrays, or arrays of unit and value. Tokens are those of the
    program's text; trees, control edges and data edges come from its nodes."""
    programs = store(td.programs(spark, sf_dir), "programs")
    nodes = store(tr.flatten_tree(programs), "nodes")
    edges = store(program_edges(nodes), "edges")
    pairs = tr.ast_value_features(nodes).groupBy("sample_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("node_id", F.col("name").alias("unit"), "value"))),
            lambda x: F.struct(x["unit"].alias("unit"), x["value"].alias("value")),
        ).alias("units")
    )
    found = {("ast", "ngrams"): tr.ast_units(nodes), ("ast", "value"): pairs}
    found |= {("tokens", "ngrams"): un.lex_units(programs, "tree"), ("tokens", "value"): un.lex_units(programs, "tree", with_value=True)}
    for level in ("cfg", "pdg-dfg", "pdg"):
        for kind in ("ngrams", "value"):
            found[level, kind] = tr.flow_units(nodes, edges, level, kind)
    labels = td.program_labels(spark, sf_dir)
    return {k: v.join(labels, "sample_id").select("sample_id", "label", "units") for k, v in found.items()}


def program_edges(nodes: DataFrame) -> DataFrame:
    """Control edges, and data edges between definitions and uses of names."""
    control = tr.structure_edges(nodes).where("type = 'control'").select("sample_id", "src", "dst", "type", "ord")
    return control.withColumn("ord", F.col("ord").cast("long")).unionByName(fl.data_edges(nodes).drop("name"), allowMissingColumns=True)


def _program_flow(spark: SparkSession, sf_dir: str, level: str, kind: str) -> DataFrame:
    units = fl.program_flow(td.programs(spark, sf_dir), level, kind)
    shown = F.transform("units", lambda u: F.concat_ws(":", u["unit"], u["value"])) if kind == "value" else F.col("units")
    return units.select("sample_id", F.size("units").cast("long").alias("n_units"), F.md5(F.array_join(shown, ",")).alias("units"))


@query()
def program_flow_units(spark, sf_dir):
    return _program_flow(spark, sf_dir, "pdg", "ngrams")


@query()
def program_flow_values(spark, sf_dir):
    return _program_flow(spark, sf_dir, "pdg-dfg", "value")


@query()
def run_all_modules(spark, sf_dir):
    """Document frequencies of all ten modules: five levels, two kinds of features."""
    counted = modules.run_tree_modules(labelled_programs(spark, sf_dir))
    return sel.document_frequency(counted.select(*modules.MODULE, "label", F.explode("feature").alias("feature")), modules.MODULE)


#: Modules that vote first, and those that vote on what the first do not agree about.
LAYERS = ["tokens ngrams", "ast ngrams", "pdg ngrams"], ["ast value", "cfg ngrams", "pdg-dfg ngrams"]


@query()
def module_votes(spark, sf_dir):
    """Ten modules from programs to votes: learnt on half of the programs, judging the other half."""
    counted = store(modules.run_tree_modules(labelled_programs(spark, sf_dir)), "counts")
    train, validation = keyed_halves(counted)
    return modules.modular_verdicts(train, validation, validation, *LAYERS, MIN_DF, CONFIDENCE, TREES)[1]


@query(f"{CHAIN} SELECT label, feature, count(*) AS df FROM sample_features GROUP BY label, feature")
def artifact_round_trip(spark, sf_dir):
    """Document frequencies stored and read again."""
    base = shared_folder(spark)
    write_artifact(sel.document_frequency(features(spark, sf_dir)), base, "tokens", "ngrams", "frequency")
    return read_artifact(spark, base, "tokens", "ngrams", "frequency")


@query(f"{CHAIN} SELECT label, feature, count(*) AS df FROM sample_features GROUP BY label, feature")
def stream_frequencies(spark, sf_dir):
    """Document frequencies of a stream of lexed documents."""
    base = shared_folder(spark)
    td.text_units(spark, sf_dir).write.parquet(f"{base}/units")
    stream = spark.readStream.schema("sample_id long, label string, units array<int>").parquet(f"{base}/units")
    start_frequencies(stream, f"{base}/frequencies", f"{base}/progress", N).awaitTermination()
    return read_frequencies(spark, f"{base}/frequencies")


# Files: the customers of each market segment and nation as a text file with a key a line.
FILES = """SELECT c_nationkey::INTEGER AS nation, {label} AS label, CAST(sum(length(c_custkey::VARCHAR) + 1) AS BIGINT) AS size_bytes,
md5(string_agg(c_custkey::VARCHAR || chr(10), '' ORDER BY c_custkey)) AS payload_md5 FROM customer {where} GROUP BY c_nationkey, c_mktsegment"""


def customer_files(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The folder of the files, and the files as rows."""
    base = f"{shared_folder(spark)}/files"
    keys = td.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("value"),
        "c_custkey",
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"),
    )
    dealt = keys.repartition("segment", "nation").sortWithinPartitions("segment", "nation", "c_custkey").drop("c_custkey")
    dealt.write.partitionBy("segment", "nation").text(base)
    return base, spark.read.format("binaryFile").option(
        "recursiveFileLookup", True
    ).option("pathGlobFilter", "*.txt").load(base).select("path")


def shown_files(samples: DataFrame) -> DataFrame:
    nation = F.regexp_extract("sample_id", r"nation=(\d+)", 1).cast("int").alias("nation")
    return samples.select(nation, "label", "size_bytes", F.md5("payload").alias("payload_md5"))


@query(FILES.format(label="CASE WHEN c_mktsegment < 'F' THEN 'benign' ELSE 'malicious' END", where=""))
def labelled_dirs(spark, sf_dir):
    base, _ = customer_files(spark, sf_dir)
    segments = [r[0] for r in td.table(spark, sf_dir, "customer").select("c_mktsegment").distinct().collect()]
    labels = ["benign" if s < "F" else "malicious" for s in segments]
    return shown_files(read_labelled_dirs(spark, [f"{base}/segment={s}" for s in segments], labels, recursive=True))


@query(FILES.format(label="'benign'", where="WHERE c_nationkey < 10"))
def file_list(spark, sf_dir):
    """The files of ten nations, by a list of their paths."""
    base, files = customer_files(spark, sf_dir)
    files.where(F.regexp_extract("path", r"nation=(\d+)", 1).cast("int") < 10).write.text(f"{base}.list")
    return shown_files(read_file_list(spark, f"{base}.list", "benign", base))
