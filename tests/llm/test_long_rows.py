"""Long rows stay cheap, and what was changed to make them so gives what plain code gives."""

import re
import time

import pytest
from pyspark.sql import functions as F

from unitweave.llm import chat, pii, queries, secrets


def timed(df):
    began = time.time()
    found = df.collect()
    return found, time.time() - began


def test_a_conversation_of_many_turns_is_read_in_proportion(spark):
    turns = spark.range(32_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") % 7 == 0, "").otherwise(F.concat(F.lit("Turn <|x|> é "), F.col("id").cast("string"))).alias("text"),
    )
    chats = spark.createDataFrame(chat.format_chats(turns).collect(), chat.format_chats(turns).schema)
    found, took = timed(chat.read_chats(chats).select(F.size("turns").alias("n"), F.size("loss_texts").alias("k"), F.array_join("loss_texts", "|").alias("said")))
    want = ["" if k % 7 == 0 else f"Turn <|x|> é {k}" for k in range(32_000) if k % 3]
    assert (found[0].n, found[0].k, found[0].said) == (32_000, len(want), "|".join(want)) and took < 10


def test_loss_spans_that_are_no_whole_turn_are_cut_out(spark):
    turns = spark.createDataFrame([(1, 0, "user", "abc"), (1, 1, "assistant", "defgh"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    whole = chat.format_chats(turns).first()
    at = whole.formatted.index("defgh")
    odd = spark.createDataFrame([(1, whole.formatted, [(at + 1, 3), (0, 4), (at, 5)], "x")], "conv_id long, formatted string, loss_spans array<struct<start:long,length:long>>, turns string")
    assert sorted(chat.read_chats(odd).first().loss_texts) == sorted(["efg", whole.formatted[:4], "defgh"])
    assert chat.read_chats(odd.limit(0)).count() == 0


def test_a_text_of_many_matches_is_searched_in_proportion(spark):
    text = " ".join(f"write to user{k}@host{k}.com or" for k in range(40_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found, took = timed(pii.find_personal_data(docs))
    assert found[0].n_email == 40_000 and took < 10


@pytest.mark.parametrize("kind", pii.KINDS)
def test_surroundings_of_spans_equal_slices(spark, sf, kind):
    dense = ["a@b.c" * 3 + " +1 2+1 2+1 2 " + "1.2.3.4 " * 30, "", "Ab Cd " * 20 + "1 Ab 2 Ab 3 Ab", "x" * 100 + "é@b.cd😀" + "x" * 60 + " a@b.cd", "+1 2" * 40, "+1 2" * 12 + " a@b.c"]
    rows = dense + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k long, text string")
    seen = 0
    for r in docs.select("k", "text", pii.spans_of(F.col("text"), pii.PATTERNS[kind], kind).alias("spans")).collect():
        for s in r.spans:
            seen += 1
            assert r.text[s.start : s.end] == s.value and r.text[s.end : s.end + 1] == s.after
            assert r.text[max(0, s.start - pii.BEFORE) : s.start] == s.before
    assert seen or kind in ("ssn", "iban", "birth")


SECRET = "kX9vLq2tR7wZZ"
ENDS = [
    (f'token = "{SECRET}"### 4785', SECRET), (f"token = '{SECRET}')", SECRET), (f'secret: "{SECRET}', SECRET), (f"Passwort: {SECRET}", SECRET), (f"clave:\t{SECRET} x", SECRET),
    (f"la contraseña es {SECRET}.", SECRET), (f"mot de passe\n=\n'{SECRET}' rest", SECRET), ("Kennwort lautet ñandúX9vLq2tR7ü!", "ñandúX9vLq2tR7ü"), (f"token “{SECRET}q5W” und", SECRET + "q5W"), (f"(pwd={SECRET})", SECRET),
    ("secret kqzxvwjb", None), ("the password is short", None), ("tokens are fine things to have", None), ("clave de la puerta principal", None), ("password: aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" + "a" * 900, None),
]


@pytest.mark.parametrize("text, value", ENDS)
def test_values_end_at_their_quote_and_the_rest_stays(text, value):
    cost = secrets.GuessCost()
    spans = [(a, e) for a, k, e in secrets.find_secrets(text, cost) if k == 3]
    assert [text[a:e] for a, e in spans] == ([value] if value else [])
    if value and not any(k != 3 for _, k, _ in secrets.find_secrets(text, cost)):
        assert secrets.redact(text, cost) == text.replace(value, "[SECRET]")
    if value:
        rest = text[text.index(value) + len(value) :]
        assert secrets.redact(text, cost).endswith(rest)


def test_scans_of_given_tables_end_before_quotes(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op5_secret_scan(spark, sf).collect():
        for kind, a, e in (x.split(":") for x in r.spans.split(",") if x):
            if kind == "guess":
                assert not re.search(r"""[\s"“”]""", docs[r.doc_id][int(a) : int(e)])


def test_long_values_cost_time_in_proportion():
    cost = secrets.GuessCost()
    began = time.time()
    for value in ("a" * 50_000, "ab" * 25_000, "qwert" * 8_000, "abcdefgh" * 6_000):
        assert cost(value) < 16
    assert time.time() - began < 30
