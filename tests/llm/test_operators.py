"""Each operator against a brute-force version on whole small tables, and on tables of odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitweave.llm import chat, common, mixing, near_dup, packing, pii, quality, queries, secrets, suffix_dedup, topk, toxicity

BLANK = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kind string"


def words_of(text):
    return [w for w in BLANK.split(text or "") if w]


def odd_rows(spark):
    long = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", None, 4), (4, "one", None, "b", 3), (4, "one", None, "b", 3), (None, "null id here", "de", "a", 12),
        (5, long, "en", "a", len(long)), (6, long, "en", "b", len(long)), (7, "abé\U0001f600 " * 200, "fr", "a", 1), (8, "a" * 5000, "en", "a", 5000), (9, "1 " * 3000, "en", "c", 6000), (10, "x@" * 2000, "en", "c", 4000),
    ]
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.documents(spark, sf)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_toxicity_separates_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op1_toxicity(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    caught = [p for t, p, _ in held if t]
    assert caught and sum(caught) >= 0.7 * len(caught)
    assert sum(p for t, p, _ in held if not t) <= 0.02 * len(held)
    assert all(0 <= s <= 1 and p == (s >= 0.7) for _, p, s in held)


def test_toxicity_folds_and_excuses(spark):
    assert toxicity.fold("1d10t іdiot ID​IOT fïne").split() == ["idiot", "idiot", "idiot", "fine"]
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " awfu": 2.0}, [" so caiied idiot "], (-1.0, 1.0, 0.0))
    matcher = lexicon.automaton()
    assert lexicon.features(matcher, "An idiot!")[0] == pytest.approx(np.log1p(3.0))
    assert lexicon.features(matcher, "the so called 1diot") == (0.0, 0.0)
    assert lexicon.features(matcher, "awfully idiotic lawful")[0] == pytest.approx(np.log1p(2.0))
    scores = toxicity.score_toxicity(odd_rows(spark), lexicon).collect()
    assert len(scores) == 12 and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.score_toxicity(empty(spark), lexicon).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn_lexicon(odd_rows(spark), labels).weights == {}


def naive_features(lexicon, text):
    """Every place of every term and phrase, each hit against each phrase."""
    folded = toxicity.fold(text)
    places = lambda w: [(i, i + len(w)) for i in range(len(folded)) if folded.startswith(w, i)]
    excused = [p for w in lexicon.phrases for p in places(w)]
    total = sum(weight for w, weight in lexicon.weights.items() for a, b in places(w) if not any(x <= a and b <= y for x, y in excused))
    return np.log1p(total), total / np.sqrt(1 + folded.count(" "))


def test_toxicity_features_equal_naive_matching(spark, sf):
    docs = common.documents(spark, sf)
    lexicon = toxicity.learn_lexicon(docs, queries.training_labels(spark, sf))
    assert lexicon.weights
    lexicon.phrases = [*lexicon.phrases, " de", "the "]  # overlapping, and beginnings of others
    some = toxicity.Lexicon({" a": 1.5, " ab ": 2.0, " b": 0.5}, [" ab a", "b b "], (0.0, 1.0, 1.0))
    matcher, other = lexicon.automaton(), some.automaton()
    rng = random.Random(3)
    for text in [r["text"] or "" for r in docs.collect()] + [" ".join(rng.choice(["a", "ab", "b", "abb", "ba"]) for _ in range(40)) for _ in range(50)]:
        if len(text) < 6000:
            assert lexicon.features(matcher, text) == pytest.approx(naive_features(lexicon, text))
            assert some.features(other, text) == pytest.approx(naive_features(some, text))


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, free, total = {}, set(names), sum(sizes.values())
    while free:
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > epochs * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        for s in over:
            fixed[s] = epochs * sizes[s]
            free.discard(s)
    return fixed


def test_mixing_meets_targets(spark, docs):
    for table in (docs, odd_rows(spark)):
        rows = table.select("doc_id", "text", "source").collect()
        sizes = defaultdict(int)
        for r in rows:
            sizes[r["source"]] += len(words_of(r["text"]))
        targets = brute_targets(dict(sizes))
        mixed = mixing.mix_sources(table, carry=["source", "size"]).toDF("doc_id", "size", "source_size", "target", "copies", "taken", "source", "clash") if table is not docs else mixing.mix_sources(table, carry=["source"])
        out = mixed.collect()
        assert len(out) == len(rows)
        taken = defaultdict(int)
        for r in out:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
            assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
            taken[r["source"]] += r["taken"]
        for s, t in taken.items():
            assert abs(t - targets[s]) <= max(0.05 * targets[s], 0.5 * max(r["size"] for r in out if r["source"] == s)) + 1, (s, t, targets[s])
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs).collect()}
    assert mixing.mix_sources(empty(spark)).count() == 0


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        cover = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                cover[i : i + length] = True
        cover = cover[: len(d)]
        kept = np.frombuffer(d, np.uint8)[~cover].tobytes()
        spans = int((np.diff(np.concatenate([[False], cover]).astype(int)) == 1).sum())
        yield len(d), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()


def test_repeats_are_removed(spark, docs):
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect())
    rows = docs.select("doc_id", "text").collect()
    assert got == sorted((r["doc_id"], *x) for r, x in zip(rows, brute_repeats([r["text"] for r in rows], 400), strict=True))


def test_repeats_of_short_strings(spark):
    rng = np.random.default_rng(5)
    parts = ["".join(rng.choice(list("abcd"), 30)) for _ in range(12)]
    texts = ["".join(parts[k] if rng.random() < 0.8 else parts[k][:-3] + "zy" for k in rng.integers(0, 12, rng.integers(0, 12))) for _ in range(120)]
    texts += [None, "", "a" * 300, "ab" * 150, texts[3], texts[3]]
    table = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string").repartition(5)
    rows = table.collect()
    for length, window in ((40, 25), (24, 9)):
        got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(table, length, window).collect())
        assert got == Counter((r["doc_id"], *x) for r, x in zip(rows, brute_repeats([r["text"] for r in rows], length), strict=True))
    assert suffix_dedup.remove_repeats(odd_rows(spark)).count() == 12
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def brute_shared_words(rows, passage):
    """Words of each text in runs of `passage` words that a text of other (doc_id, text) has too."""
    owners = defaultdict(set)
    words = [words_of(t) for _, t in rows]
    for row, w in zip(rows, words, strict=True):
        for i in range(len(w) - passage + 1):
            owners[tuple(w[i : i + passage])].add(row)
    for w in words:
        covered = {j for i in range(len(w) - passage + 1) if len(owners[tuple(w[i : i + passage])]) > 1 for j in range(i, i + passage)}
        yield len(covered)


def test_shared_passages_are_counted(spark, docs):
    rng = random.Random(6)
    passage = lambda n: " ".join(f"p{rng.randrange(10**6)}" for _ in range(n))
    shared, short = passage(52), "ab cd ef " * 17 + "gh"
    texts = [f"{passage(30)} {shared} {passage(k)}" for k in (0, 9, 40)] + [short, f"{passage(20)}\n{short} x", f"{shared} {passage(3)}", passage(51), passage(50), (q := passage(60)), q, "w " * 400, None]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(None if k % 3 == 0 else -k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    rows = [tuple(r) for r in table.collect()]
    want = Counter((d, n) for (d, _), n in zip(rows, brute_shared_words(rows, 51), strict=True))
    got = suffix_dedup.remove_repeats(table).collect()
    assert Counter((r["doc_id"], r["n_shared_words"]) for r in got) == want
    assert sum(n > 0 for d, n in want if d is None or d < 0) >= 6


def test_hot_keys_and_many_null_ids(spark):
    """One passage in a thousand different surroundings, with and without ids: merged in one place, or counted by digest."""
    rng = np.random.default_rng(7)
    noise = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage = noise(60)
    texts = [noise(int(rng.integers(0, 30))) + passage[int(rng.integers(0, 12)) :] + noise(int(rng.integers(0, 30))) for _ in range(1000)] + [passage, passage * 3, None, ""]
    table = spark.createDataFrame([(None if k % 2 else k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    rows = table.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, brute_repeats([r["text"] for r in rows], 40), strict=True))
    for most in (suffix_dedup.MOST, 5):
        got = suffix_dedup.remove_repeats(table, 40, 25, most).drop("kept", "n_shared_words").collect()
        assert Counter(tuple(r) for r in got) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(table, 40, 25).drop("kept", "n_shared_words").collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_loser_tree_merges_with_right_prefixes():
    rng = np.random.default_rng(2)
    runs = [sorted(bytes(rng.choice([97, 98], rng.integers(0, 9)).astype(np.uint8)) for _ in range(n)) for n in (0, 5, 17, 1, 40)]
    merged = list(suffix_dedup.merge_runs([suffix_dedup.decoded(suffix_dedup.front_coded([(x, ()) for x in run])) for run in runs]))
    flat = [x[1] for x in merged]
    assert flat == sorted(x for run in runs for x in run)
    assert [x[0] for x in merged][1:] == [suffix_dedup.common_prefix(a, b) for a, b in zip(flat, flat[1:], strict=False)]


def brute_quality(text):
    text = text or ""
    w = words_of(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_limits(spark, docs):
    for table in (docs, odd_rows(spark)):
        rows = table.select("doc_id", "text").collect()
        got = Counter(tuple(r)[:6] for r in quality.quality_verdicts(table).collect())
        assert got == Counter((r["doc_id"], *brute_quality(r["text"])) for r in rows)
    out = quality.quality_verdicts(docs).collect()
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality.quality_verdicts(empty(spark)).count() == 0


def exact_limits(groups):
    """group (lang, source) -> metric -> limit from exact quantiles (the least value with at least that share below or equal)."""

    def at(x, q):
        x = sorted(x)
        return x[max(0, int(np.ceil(q * len(x) - 1e-9)) - 1)]

    def own(x, level):
        return max(at(x, level), at(x, 0.5) + quality.FENCE * (at(x, 0.75) - at(x, 0.25)))

    out = {}
    for m, level in quality.LEVELS.items():
        whole = own([v[m] for g in groups.values() for v in g], level)
        by_lang = defaultdict(list)
        for (lang, _), g in groups.items():
            by_lang[lang] += [v[m] for v in g]
        weigh = lambda n, a, b: (n * a + quality.PRIOR * b) / (n + quality.PRIOR)
        langs = {lang: weigh(len(x), own(x, level), whole) for lang, x in by_lang.items()}
        for (lang, source), g in groups.items():
            out.setdefault((lang, source), {})[m] = weigh(len(g), own([v[m] for v in g], level), langs[lang])
    return out


def test_quality_verdicts_follow_exact_quantiles(spark, sf):
    docs = common.documents(spark, sf.replace("sf0.001", "sf0.01"))
    groups, metrics, passed = defaultdict(list), {}, {}
    for r in docs.collect():
        n, chars, symbols, dup, again = brute_quality(r["text"])
        passed[r["doc_id"]] = not (n < 50 or 100 * again > 50 * n)
        lines = sum(bool(words_of(x)) for x in (r["text"] or "").split("\n"))
        if passed[r["doc_id"]]:
            metrics[r["doc_id"]] = r["lang"], r["source"], {"symbol_share": symbols / chars, "dup_line_share": dup / lines, "repeat_share": again / n, "word_length": chars / n}
            groups[r["lang"], r["source"]].append(metrics[r["doc_id"]][2])
    limits = exact_limits(groups)
    got = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(docs).collect()}
    clear = refused = 0
    for d, (lang, source, values) in metrics.items():
        margin = {m: values[m] - limits[lang, source][m] for m in values}
        if all(abs(x) > 0.06 * max(values[m], limits[lang, source][m]) or x == 0 == values[m] for m, x in margin.items()):
            clear += 1
            refused += not got[d]
            assert got[d] == all(x <= 0 for x in margin.values()), (d, margin)
    assert clear > 0.7 * len(metrics) and refused > 10
    assert not any(got[d] for d, ok in passed.items() if not ok)
    assert len({round(x["word_length"], 6) for x in limits.values()}) > 20


def test_quality_joins_many_groups_with_salt(spark, docs, monkeypatch):
    want = Counter(map(tuple, quality.quality_verdicts(docs).collect()))
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    assert Counter(map(tuple, quality.quality_verdicts(docs).collect())) == want


def test_quality_keeps_good_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [(labels[r["doc_id"]], r["kept"], r["n_words"], r["base_failed"]) for r in queries.op4_quality_rules(spark, sf).collect() if r["doc_id"] in labels]
    good = [kept for q, kept, n, failed in out if q and not failed]
    assert sum(good) >= 0.97 * len(good)


def test_secrets(spark, docs):
    cost = secrets.GuessCost()
    find = lambda text: [s[1] for s in secrets.find_secrets(text, cost)]
    assert find("token = abcdefgh AKIA" + "A" * 12 + " " + "0a" * 16) == [0, 1, 2]
    assert find("ToKeN: short") == [] and find("aKey=abcdefgh") == []
    assert find("the passphrase is xK9#vLq2!tR7w") == [3] and find("pwd: kqzxvwjbhgtrmnpl") == [3] and find("secret kqzxvwjb") == []
    assert find("the passphrase is password1234") == []
    assert cost("") == 0 and cost("password") < cost("pa55word") < cost("kqzxvwjb") and cost("qwertyuiop") < 4 and cost("aaaaaaaaaaaa") < 4 and cost("20190412") < 6 and cost("abcabcabcabc") < 6
    assert cost("xK9#vLq2!tR7w") > 15 and cost("zxcvbnmonkey") < 4.5 and secrets.GuessCost({"ingredients": 900})("ingredients") < 4 < cost("ingredients")
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in secrets.scan_secrets(docs).collect()}
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]
    for r in rows:
        spans = sorted((m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds) for m in p.finditer(r["text"]) if ok(m))
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        x = got[r["doc_id"]]
        assert x["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and x["n_hex"] == sum(s[3] == "hex" for s in spans)
        assert set(base.split(",")) - {""} <= set(x["spans"].split(","))
    assert secrets.scan_secrets(odd_rows(spark)).count() == 12 and secrets.scan_secrets(empty(spark)).count() == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs).collect()}
    assert all("[SECRET]" in clean[k] for k, r in got.items() if r["n_hex"]) and secrets.redact_secrets(odd_rows(spark)).columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def brute_span_cost(part, known):
    """Cost of one span by the rules in plain words, infinite if it is no known span."""
    low, costs = part.lower(), [float("inf")]
    alphabet = lambda c: np.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33)
    plain = "".join(dict(zip("0134578@$!", "oieastbasi", strict=True)).get(c, c) for c in low)
    if low in known:
        costs.append(np.log10(known[low] + 1) + (0 if part.islower() else np.log10(2)))
    elif plain in known:
        costs.append(np.log10(known[plain] + 1) + 2 * np.log10(2))
    if re.fullmatch(r"(19|20)\d\d", part):
        costs.append(np.log10(120))
    day, month = "(0[1-9]|[12][0-9]|3[01])", "(0[1-9]|1[0-2])"
    if re.fullmatch(rf"(19|20)\d\d[-/._]?{month}[-/._]?{day}|{day}[-/._]?{month}[-/._]?(19|20)\d\d", part):
        costs.append(np.log10(366 * 120))
    steps = secrets.directions()
    if len(part) >= 3 and all(low[k : k + 2] in steps for k in range(len(part) - 1)):
        way = [steps[low[k : k + 2]] for k in range(len(part) - 1)]
        costs.append(np.log10(47 * len(part)) + (1 + sum(a != b for a, b in zip(way, way[1:], strict=False))) * np.log10(4))
    if len(part) >= 3 and low.isalnum() and {ord(b) - ord(a) for a, b in zip(low, low[1:], strict=False)} in ({1}, {-1}):
        costs.append(np.log10(26 * len(part)))
    for size in range(1, len(part)):
        times, rest = divmod(len(part), size)
        if not rest and part == part[:size] * times and times >= (3 if size == 1 else 2):
            costs.append(sum(map(alphabet, part[:size])) + np.log10(times))
    return min(costs)


def brute_guess_cost(value, known):
    """All ways to cut a value."""
    if not value:
        return 0.0
    single = lambda c: np.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33)
    least = float("inf")
    for cuts in range(1 << len(value) - 1):
        ends = [k + 1 for k in range(len(value) - 1) if cuts >> k & 1] + [len(value)]
        at, total = 0, 0.0
        for end in ends:
            part = value[at:end]
            as_span = brute_span_cost(part, known) + (np.log10(2) if at else 0.0)
            total += min(as_span, single(part)) if len(part) == 1 else as_span
            at = end
        least = min(least, total)
    return least


def test_guess_cost_is_least():
    cost = secrets.GuessCost({"thorn": 7, "north": 3})
    rng = random.Random(4)
    parts = ["monkey", "qwe", "zxcv", "abc", "321", "aaa", "1999", "ab", "no", "north", "N0rth", "7", "#", "x", "2019"]
    values = ["zxcvbnmon", "qwertyab", "aaaa1234", "abababx", "19991231", "pa55word1", "thornorth"] + ["".join(rng.choice(parts) for _ in range(4))[:9] for _ in range(60)]
    for value in values:
        assert cost(value) == pytest.approx(brute_guess_cost(value, cost.ranks)), value


def test_chats_round_trip(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a<|end|>\\b\\m<"), (1, 2, "user", "|role|>"), (1, 3, "assistant", "x</s>[INST] <<SYS>>\\"), (1, 4, "assistant", None), (1, 4, None, "tie"), (2, 0, "assistant", ""), (None, 5, "<|text|>", "t"), (3, 1, "user", "same"), (3, 1, "user", "same")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted((t, role or "", text or "") for c, t, role, text in rows if c == conv)
        assert [tuple(x) for x in got[conv]["turns"]] == [x[1:] for x in want]
        assert got[conv]["loss_texts"] == [x[2] for x in want if x[1] == "assistant"]
    assert got[1]["formatted"].count("<|role|>") == 5 and chat.format_chats(turns.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(700)] + [(1000 + i, [1.0] * 64) for i in range(40)] + [(2000, None), (None, [1.0]), (2001, [0.5, None])]
    codes = topk.binary_codes(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    known = {r["vec_id"]: r["code"] & (1 << 64) - 1 for r in codes.collect() if r["vec_id"] is not None}
    near = [(i, random.Random(i % 3).getrandbits(63) ^ (1 << i % 61)) for i in range(90)]
    cases = [(codes, known, None), (codes, known, 16), (spark.createDataFrame(near, "vec_id long, code long"), dict(near), 32)]
    for table, values, width in cases:
        got = defaultdict(list)
        for r in topk.top_k(table, table.where("vec_id % 100 = 0"), k=7, width=width).collect():
            got[r["query_id"]].append((r["rank"], r["distance"], r["vec_id"]))
        for q in [i for i in values if i % 100 == 0]:
            best = sorted(((values[q] ^ c).bit_count(), i) for i, c in values.items())[:7]
            assert sorted(got[q]) == [(k + 1, *x) for k, x in enumerate(best)]
    assert topk.top_k(codes.limit(0), codes.limit(0)).count() == 0
    clash = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"code": F.lit("x"), "q": F.lit(1), "s": F.lit(2)})
    assert topk.binary_codes(clash).columns == ["vec_id", "code"] and topk.binary_codes(clash).exceptAll(codes).count() == 0


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


BASE = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 16 <= len(re.sub(r"\D", "", m[0])) <= 19 and luhn(re.sub(r"\D", "", m[0]))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(re.sub(r"\D", "", m[0])) <= 15),
}


def test_personal_data(spark, docs):
    tricky = ["a@b.c_d@e.f x.y+z@m-n.co.uk", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 9.9.9", "4111 1111 1111 1111 4111-1111-1111-1112 12345678901234567890", "+1 (017) 555-7713 +49.30-1234567 +12 +1234567890123456", "@.@ a@b a@.b é@x.de 😀 a@b.cd", "SSN 123-45-6789 iban DE89370400440532013000", "x" * 3000 + "@" + "y." * 2000]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(tricky)], "doc_id long, text string")).union(odd_rows(spark).select("doc_id", "text"))
    rows = table.collect()
    got = Counter()
    for r in pii.find_personal_data(table).collect():
        got[(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])] += 1
    want = Counter()
    for r in rows:
        spans = {k: [(m.start(), m.end()) for m in p.finditer(r["text"] or "") if ok(m)] for k, (p, ok) in BASE.items()}
        base = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in spans[k])
        want[(r["doc_id"], *(len(spans[k]) for k in BASE), hashlib.sha256(base.encode()).hexdigest())] += 1
    assert got == want
    assert pii.find_personal_data(empty(spark)).count() == 0


def brute_estimate(votes, n, rounds=3000):
    """Two-class expectation-maximisation span by span, as plain loops."""
    rates, prior = {m: list(pii.START[m]) for m in pii.LABELERS}, pii.START_PRIOR
    for _ in range(rounds):
        p = []
        for v in votes:
            odds = prior / (1 - prior)
            for m, x in zip(pii.LABELERS, v, strict=True):
                a, b = rates[m]
                odds *= a / b if x == 1 else (1 - a) / (1 - b) if x == 0 else 1
            p.append(odds / (1 + odds))
        for j, m in enumerate(pii.LABELERS):
            for c in (0, 1):
                w = [k * (q if c == 0 else 1 - q) for k, q in zip(n, p, strict=True)]
                voted = sum(x for x, v in zip(w, votes, strict=True) if v[j] < 2)
                rates[m][c] = (sum(x for x, v in zip(w, votes, strict=True) if v[j] == 1) + pii.PULL * pii.START[m][c]) / (voted + pii.PULL)
        prior = (sum(k * q for k, q in zip(n, p, strict=True)) + pii.PULL * pii.START_PRIOR) / (sum(n) + pii.PULL)
    return p, rates, prior


def test_reliabilities_equal_brute_force():
    rng = np.random.default_rng(8)
    real = rng.random(400) < 0.4
    yes = {"rule": (0.9, 0.1), "gazetteer": (0.7, 0.3), "context": (0.6, 0.1), "edges": (0.9, 0.8), "form": (0.95, 0.3)}
    votes = [tuple(2 if rng.random() < 0.1 else int(rng.random() < yes[m][0 if t else 1]) for m in pii.LABELERS) for t in real]
    patterns = Counter(votes)
    p, rates, prior = pii.estimate(np.array(list(patterns)), np.array(list(patterns.values()), float))
    q, want, share = brute_estimate(list(patterns), list(patterns.values()))
    assert p == pytest.approx(q, abs=1e-3) and prior == pytest.approx(share, abs=1e-3)
    assert all(rates[j] == pytest.approx(want[m], abs=1e-3) for j, m in enumerate(pii.LABELERS))
    verdict = dict(zip(patterns, p > 0.5, strict=True))
    assert np.mean([verdict[v] == t for v, t in zip(votes, real, strict=True)]) > 0.9


PLANTED = [
    ("My name is John {0}", "name", True), ("contact: Maria {0}", "name", True), ("North {0}", "name", False), ("Über {0}", "name", False), ("Chapter {0} East {0}", "name", False),
    ("IBAN DE89 3704 0044 0532 0130 00", "iban", True), ("account GB82WEST12345698765432", "iban", True), ("code DE89370400440532013001", "iban", False), ("part XX12ABCD12345678", "iban", False),
    ("SSN 123-45-6789", "ssn", True), ("social security 219-09-9999", "ssn", True), ("serial 000-12-0000", "ssn", False), ("no 987-00-4321", "ssn", False),
    ("born 12.03.1980", "birth", True), ("geboren 1975-11-02", "birth", True), ("ratio 45/45/2090", "birth", False), ("build 31-31-2089", "birth", False),
    ("lives at 12 Baker Street", "address", True), ("Adresse Gartenstraße 14", "address", True), ("Version 12", "address", False), ("Kapitel 3", "address", False), ("5 Apples", "address", False),
]


def test_added_personal_data_on_planted_spans(spark):
    family = "Miller Novak Rossi Weber Garcia Dubois Keller Jensen Moreau Silva".split()
    rows, meant = [], {}
    for k in range(10):
        for j, (text, kind, real) in enumerate(PLANTED):
            d = k * 100 + j
            rows.append((d, f"und {text.format(family[k])}; dann"))
            meant[d] = kind if real else None
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = {d: {x.split(":")[0] for x in r["spans"].split(",") if x} for d, r in got.items()}
    caught = [d for d, kind in meant.items() if kind and kind in hits[d]]
    false = [d for d, kind in meant.items() if not kind and hits[d]]
    assert len(caught) >= 0.9 * sum(map(bool, meant.values())) and len(false) <= 0.1 * sum(not x for x in meant.values()), (sorted({PLANTED[d % 100][0] for d in meant if meant[d] and d not in caught}), sorted({PLANTED[d % 100][0] for d in false}))
    assert all(r["n_spans"] == len(hits[d]) for d, r in got.items() if len(hits[d]) < 2)


def test_prefix_sums(spark):
    rows = [(k, list(range(n))) for k, n in enumerate((0, 1, 2, 255, 256, 257, 1000, 5000))] + [(99, None)]
    for r in spark.createDataFrame(rows, "k int, x array<int>").withColumn("s", common.prefix_sums(F.col("x"))).collect():
        assert r["s"] == [sum(range(i)) for i in range(len(r["x"] or []))]


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["a  b", " lead", "trail ", "x\n y", "tab\t z", "it's <|endoftext|> 12", "é ü 日本 語", "  nb sp", "a  b"]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "doc_id long, text string")).union(odd_rows(spark).where("doc_id <> 4").select(F.col("doc_id") + 1_000_000, "text"))
    ids = {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in table.collect()}
    rows = packing.pack_documents(table).collect()
    of, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(of) == set(ids)
    for d, pieces in of.items():
        pieces.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(pieces):
            part = ids[d][at : at + r["length"]]
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and (r["length"] == 2048 or k == 0)
            at += r["length"]
        assert at == len(ids[d])
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * sum(map(len, ids.values())) / 2048 + 2
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packing_of_odd_rows(spark):
    rows = packing.pack_documents(odd_rows(spark)).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter([1, 2, 3, 4, 4, None, 5, 6, 7, 8, 9, 10])
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [p[0] for p in places] == [sum(x[1] for x in places[:k]) for k in range(len(places))] and sum(x[1] for x in places) <= 2048


def test_word_encoder_equals_the_tokenizer_on_all_documents(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [r["text"] or "" for r in common.documents(spark, sf.replace("sf0.001", "sf0.01")).collect()]
    encoder = packing.WordEncoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)
    assert all(encoder.encode(t) == np.array(e.ids, "<u4").tobytes() for t, e in zip(texts, whole, strict=True))


def brute_best_two_fit(lengths, capacity):
    """Bin by bin over single pieces: fill greedily, then try every pair in place of the smallest."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        gap, used = capacity, []
        for x in list(left):
            if x <= gap:
                used.append(x)
                left.remove(x)
                gap -= x
        if gap and left:
            small = min(used)
            pairs = [(a + b, max(a, b), min(a, b)) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= gap + small]
            if pairs and max(pairs)[0] > small:
                best = max(pairs)[0]
                gap += small - best
                used.remove(small)
                left.append(small)
                bins.append((used, best))
                a, b = next((x, y) for t, x, y in pairs if t == best)
                left.remove(a)
                left.remove(b)
                used += [a, b]
                left.sort(reverse=True)
                continue
        bins.append((used, None))
    return [b[0] for b in bins]


def test_bin_plan_is_as_good_as_best_two_fit_piece_by_piece():
    rng = np.random.default_rng(11)
    for n, high in ((30, 60), (200, 90), (400, 50), (60, 100)):
        lengths = rng.integers(1, high, n).tolist()
        plan = packing.plan_bins(dict(Counter(lengths)), 100)
        brute = brute_best_two_fit(lengths, 100)
        assert sum(t for _, t in plan) <= len(brute)
        assert sorted(brute[0]) == sorted(x for x, k in plan[0][0] for _ in range(k)) or sum(brute[0]) == sum(x * k for x, k in plan[0][0])


def test_bin_plan_uses_everything():
    rng = np.random.default_rng(4)
    counts = Counter(rng.integers(1, 100, 5000).tolist())
    plan = packing.plan_bins(dict(counts), 100)
    used = Counter()
    for bin_, times in plan:
        assert sum(a * n for a, n in bin_) <= 100
        for a, n in bin_:
            used[a] += n * times
    assert used == counts and sum(t for _, t in plan) <= 1.02 * sum(a * n for a, n in counts.items()) / 100 + 2


def jaccard(a, b):
    s = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a, b)]
    both = sum((s[0] & s[1]).values())
    return both / (sum(s[0].values()) + sum(s[1].values()) - both)


def test_near_duplicates_match_brute_force(spark, sf):
    docs = common.documents(spark, sf.replace("sf0.001", "sf0.01"))
    words = {r["doc_id"]: words_of(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(docs).collect()}
    assert set(got) == set(words)
    parent = {d: d for d in words}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    by_shingle = defaultdict(set)
    for d, w in words.items():
        for i in range(max(1, len(w) - 4)):
            by_shingle[tuple(w[i : i + 5])].add(d)
    distinct = Counter(d for v in by_shingle.values() for d in v)
    pairs = Counter(p for v in by_shingle.values() if 1 < len(v) < 60 for p in ((a, b) for a in v for b in v if a < b))
    for (a, b), n in pairs.items():
        if n > 0.3 * min(distinct[a], distinct[b]) and words[a] and jaccard(words[a], words[b]) >= 0.8:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {d: find(d) for d in words}
    wrong = [d for d in words if got[d] != want[d]]
    assert len(wrong) <= 0.002 * len(words), wrong[:10]


def test_near_duplicates_of_a_star(spark):
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(10**6)}"
    middle = [word() for _ in range(400)]
    texts = [middle]
    for _ in range(1000):
        copy = list(middle)
        for at in rng.sample(range(400), 7):
            copy[at] = word()
        texts.append(copy)
    linked = {i for i, w in enumerate(texts) if jaccard(middle, w) >= 0.8}
    assert len(linked) > 900 and jaccard(texts[1], texts[2]) < 0.8
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in linked) and set(got) == set(range(1001))


def test_near_duplicates_of_groups_with_many_edits(spark):
    """Groups whose copies are edited little to much: classes are those of all pairs, though most pairs are not linked."""
    rng = random.Random(23)
    rows, words = [], {}
    for g in range(3):
        middle = [f"w{rng.randrange(3_000)}" for _ in range(rng.choice([60, 150]))]
        for _ in range(150):
            copy = list(middle)
            for at in rng.sample(range(len(copy)), rng.randrange(0, len(copy) // 10)):
                copy[at] = f"x{rng.randrange(10**6)}" if rng.random() < 0.7 else middle[at - 1]
            if rng.random() < 0.3:
                copy = copy[: rng.randrange(len(copy) // 2, len(copy) + 1)]
            words[len(rows)] = copy
            rows.append((len(rows), " ".join(copy)))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    memory, parent = {}, {k: k for k in words}
    hashed = {k: near_dup.shingles(near_dup.word_hashes(" ".join(w), memory)) for k, w in words.items()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in words:
        for b in range(a):
            if a // 150 == b // 150 and find(a) != find(b) and near_dup.aligned(hashed[a], hashed[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {k: find(k) for k in words} and 20 < len(set(got.values())) < 400


def test_near_duplicate_rounds_read_documents_twice(spark, monkeypatch, tmp_path):
    """However many rounds a group takes, texts are read for sketches and once more, and a round stores few tables. Rounds
    that take more leaders at once find the same classes."""
    rng = random.Random(29)
    rows = []
    for g in range(2):
        middle = [f"w{g}_{rng.randrange(3_000)}" for _ in range(150)]
        for _ in range(120):
            copy = list(middle)
            for at in rng.sample(range(150), rng.randrange(1, 9)):
                copy[at] = middle[rng.randrange(150)]
            rows.append((len(rows), " ".join(copy)))
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    stored, write = [], near_dup.write_shared
    monkeypatch.setattr(near_dup, "write_shared", lambda df, name: (stored.append((name, any(path in f for f in df.inputFiles()))), write(df, name))[1])
    classes, rounds = [], []
    for comparisons in (0, 30_000_000):
        monkeypatch.setattr(near_dup, "COMPARISONS", comparisons, raising=False)
        stored.clear()
        classes.append({r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(spark.read.parquet(path)).collect()})
        names = [name for name, _ in stored if name not in ("edges", "labels", "moved")]
        rounds.append(names.count("members"))
        assert sum(read for _, read in stored) <= 2 and len(names) <= 5 + 4 * rounds[-1]
    assert classes[0] == classes[1] and rounds[0] > rounds[1] == 2 and 2 < len(set(classes[0].values())) < 240


def test_bins_bound_what_is_shared():
    rng = np.random.default_rng(5)
    for n in (1, 40, 400, 40_000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.where(rng.random(n) < 0.05, rng.integers(0, 2**63, n).astype(np.uint64), a)
        assert not near_dup.aligned(a, b) or near_dup.may_align(near_dup.binned(a), near_dup.binned(b))
    assert not near_dup.may_align(near_dup.binned(a[:400]), near_dup.binned(a[400:800]))


def test_near_duplicates_of_odd_rows(spark):
    rows = near_dup.near_duplicate_classes(odd_rows(spark)).collect()
    assert sorted(((r["doc_id"] or 0), r["class_id"] or 0) for r in rows) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8), (9, 9), (10, 10)]
    kept = near_dup.drop_near_duplicates(odd_rows(spark))
    assert kept.columns == odd_rows(spark).columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]
    words = "all the same seven words in here"
    more = spark.createDataFrame([(None, words), (None, words + " "), (7, "  " + words), (None, "only without id"), (None, "only without id"), (8, None), (8, None), (None, None)], "doc_id long, text string")
    for marks in (near_dup.MARKS, 0):
        near_dup.MARKS, old = marks, near_dup.MARKS
        assert Counter((r["doc_id"], r["text"]) for r in near_dup.drop_near_duplicates(more).collect()) == Counter([(7, "  " + words), (None, "only without id"), (8, None), (None, None)])
        near_dup.MARKS = old
    assert near_dup.near_duplicate_classes(empty(spark)).count() == 0


def test_alignment_bounds():
    rng = np.random.default_rng(9)
    for _ in range(60):
        a = rng.integers(0, 50, rng.integers(1, 80)).astype(np.uint64)
        b = np.array([x if rng.random() < 0.93 else rng.integers(0, 50) for x in a if rng.random() < 0.95] or [1], np.uint64)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        m = table[-1, -1]
        assert near_dup.aligned(a, b, 0.8) == (m / (len(a) + len(b) - m) >= 0.8 - 1e-9)


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = common.documents(spark, sf)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.write_shared(stage(spark, before, sf), name)
        assert docs.columns == before.columns and docs.dtypes == before.dtypes and 0 < docs.count()
        if name != "mixing":
            assert docs.select("doc_id").distinct().count() == docs.count() <= before.count()
        if name == "secret_scan":
            assert docs.count() == before.count() and secrets.scan_secrets(docs).where("n_hex > 0").count() == 0
        before = docs
    assert corpus_pipeline.STAGES[-1][1](spark, before, sf).select("doc_id", "piece").distinct().count() > 0


def test_pipeline_equals_brute_force(spark, sf):
    """What each stage keeps, worked out from its input one document after the other, against run()."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [tuple(r) for r in common.documents(spark, sf).collect()]
    lexicon = toxicity.learn_lexicon(common.documents(spark, sf), queries.training_labels(spark, sf))
    naive = lambda t: 1 / (1 + np.exp(-np.dot(lexicon.scale, (1, *naive_features(lexicon, t or "")))))
    rows = [r for r in rows if naive(r[1]) < queries.TOXIC_FROM]
    words = {r[0]: words_of(r[1]) for r in rows}
    parent = {d: d for d in words}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a in words:
        for b in words:
            if a < b and words[a] and 0.8 * max(len(words[a]), len(words[b])) <= min(len(words[a]), len(words[b])) + 4 and jaccard(words[a], words[b]) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    rows = [r for r in rows if find(r[0]) == r[0]]
    cost = secrets.GuessCost({})
    rows = [(r[0], secrets.redact(r[1], cost) if r[1] is not None else None, *r[2:]) for r in rows]
    pieces = corpus_pipeline.run(spark, sf).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    targets = brute_targets(dict(sizes))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known = {r[0]: r for r in rows}
    ids = {d: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0] for d, r in known.items()}
    got = defaultdict(Counter)
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes())
        got[p["doc_id"]][p["piece"]] += 1
    copies = {d: set(c.values()) for d, c in got.items()}
    assert all(len(c) == 1 and set(got[d]) == set(range(-(-len(ids[d]) // 2048))) for d, c in copies.items())
    taken = defaultdict(int)
    for d, c in copies.items():
        assert max(c) <= 3
        taken[known[d][3]] += max(c) * len(words_of(known[d][1]))
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(0.05 * t, 0.5 * max(len(words_of(r[1])) for r in rows if r[3] == s)) + 1


def test_stages_take_odd_and_empty_tables(spark, sf):
    import corpus_pipeline

    for table in (odd_rows(spark), empty(spark)):
        n = table.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf)
            assert out.columns == table.columns and out.dtypes == table.dtypes, name
            ids = Counter(r["doc_id"] for r in out.collect())
            assert not n or (ids and (name == "mixing" or set(ids) <= set(r["doc_id"] for r in table.collect())))
            if name in ("toxicity", "secret_scan"):
                assert sum(ids.values()) == n
        packed = corpus_pipeline.STAGES[-1][1](spark, table, sf).collect()
        assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in table.collect())
