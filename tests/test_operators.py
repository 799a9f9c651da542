import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.functions.text import ALPHABET, CHAT_SPECIALS
from tokenloom.operators import bpe, counting, encode, lp, sampling, unigram
from tokenloom.operators import vocabulary as V

RUNS = [
    ("abcab", {("a", "b"): 2, ("b", "c"): 1, ("c", "a"): 1}),
    ("aaaaabcab", {("a", "a"): 2, ("a", "b"): 2, ("b", "c"): 1, ("c", "a"): 1}),
    ("abcde", {("a", "b"): 1, ("b", "c"): 1, ("c", "d"): 1, ("d", "e"): 1}),
    ("bcaaabc", {("b", "c"): 2, ("c", "a"): 1, ("a", "a"): 1, ("a", "b"): 1}),
    ("bcdaaa", {("b", "c"): 1, ("c", "d"): 1, ("d", "a"): 1, ("a", "a"): 1}),
    ("bcdaaaa", {("b", "c"): 1, ("c", "d"): 1, ("d", "a"): 1, ("a", "a"): 2}),
    ("baaabcaaaaae", {("b", "a"): 1, ("a", "a"): 3, ("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1, ("a", "e"): 1}),
    ("a", {}),
    ("", {}),
]


@pytest.mark.parametrize("word, want", RUNS)
def test_adjacent_pairs(word, want):
    got = defaultdict(int)
    for p in bpe.adjacent(list(word)):
        got[p] += 1
    assert got == want


def test_pair_counts_in_spark(spark):
    df = spark.createDataFrame([(list(w), 2) for w, _ in RUNS], "symbols array<string>, frequency long")
    count, seqs = defaultdict(int), defaultdict(int)
    for _, want in RUNS:
        for p, n in want.items():
            count[p] += 2 * n
            seqs[p] += 1
    assert {(r.left, r.right): (r["count"], r.sequences) for r in counting.pair_counts(df).collect()} == {p: (count[p], seqs[p]) for p in count}


def test_merge():
    assert bpe.merged(list("abcab"), "a", "b") == ["ab", "c", "ab"] and bpe.merged(list("aaa"), "a", "a") == ["aa", "a"]


WORDS = [("Ġthe", 50), ("Ġthen", 20), ("Ġthere", 15), ("hen", 9), ("aaaa", 7), ("Ġa", 40), ("lower", 5), ("lowest", 4), ("newer", 6), ("wider", 3)]


def test_bpe_agrees_with_library():
    lib = pytest.importorskip("tokenizers")
    rng = random.Random(2)
    words = [("".join(rng.choice("abcdeĠ") for _ in range(rng.randint(1, 9))), rng.randint(1, 30)) for _ in range(300)]
    words = [(w, n) for w, n in dict(words).items()]
    tok = lib.Tokenizer(lib.models.BPE())
    tok.pre_tokenizer = lib.pre_tokenizers.WhitespaceSplit()
    tok.train_from_iterator([w for w, n in words for _ in range(n)], lib.trainers.BpeTrainer(vocab_size=420, initial_alphabet=ALPHABET, special_tokens=CHAT_SPECIALS, show_progress=False))
    tokens, _ = bpe.train(words, 420, CHAT_SPECIALS)
    assert {t: i for i, t in enumerate(tokens)} == tok.get_vocab()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("abcĠ", min_size=1, max_size=8), st.integers(1, 20)), min_size=1, max_size=15), st.sampled_from([0.5, 0.9, 1.0]))
def test_picky_counts_stay_right(words, tau):
    made = bpe.Picky(list(dict(words).items()), tau=tau)
    for _ in range(25):
        best = made.best()
        if best is None:
            break
        fresh = defaultdict(int)
        for s, f in zip(made.seqs, made.freq):
            for p in bpe.adjacent(s):
                fresh[p] += f
        able = {p: n for p, n in fresh.items() if p[0] + p[1] not in made.known}
        assert best == min(able.items(), key=lambda x: (-x[1], bpe._bytes(x[0])))
        made.step()
        made.verify()


def test_picky_deletes_and_replays():
    made = bpe.Picky(WORDS, tau=0.9)
    tokens = made.train(275)
    gone = [a for k, a, _ in made.events if k == "delete"]
    assert gone and len(tokens) == 275 and set(gone) <= set(tokens)
    strict = bpe.Picky(WORDS, tau=0.9, drop_deleted=True)
    assert not set(strict.train(270)) & {a for k, a, _ in strict.events if k == "delete"}
    for (w, _), s in zip(WORDS, made.seqs):
        assert bpe.replay(w, made.events) == s
    assert made.whole_words() == sum(f for s, f in zip(made.seqs, made.freq) if len(s) == 1)
    with pytest.raises(ValueError):
        made.train(100)


def test_decode():
    tokens = {0: "Ġthe", 1: "Ã", 2: "©"}
    assert bpe.decode([0, 1, 2, 9], tokens, {9: "<|x|>"}) == " theé<|x|>" and bpe.decode([1], tokens) == "\ufffd"
    with pytest.raises(ValueError):
        bpe.decode([7], tokens)


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=9), st.sets(st.text("abc", min_size=2, max_size=4), max_size=8))
def test_shortest_is_shortest(word, tokens):
    cost = {t: 1.0 for t in [*tokens, *"abc"]}
    got = encode.shortest(word, cost, 4)
    best = [0] + [99] * len(word)
    for e in range(1, len(word) + 1):
        best[e] = min(best[s] + 1 for s in range(e) if word[s:e] in cost)
    assert "".join(got) == word and len(got) == best[-1]


def test_shortest_agrees_with_unigram_library():
    lib = pytest.importorskip("tokenizers")
    rng = random.Random(7)
    for _ in range(60):
        extra = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(8)})
        tokens = ["<unk>", "a", "b", "c", *extra]
        tok = lib.Tokenizer(lib.models.Unigram([(t, -1.0) for t in tokens], 0, False))
        word = "".join(rng.choice("abc") for _ in range(12))
        assert encode.shortest(word, {t: 1.0 for t in tokens}, 4) == tok.encode(word).tokens


def test_unknown():
    assert encode.shortest("axb", {"a": 1.0, "b": 1.0}, 1) is None
    assert encode.shortest("axb", {"a": 1.0, "b": 1.0}, 1, "?") == ["a", "?", "b"]
    assert encode.shortest("", {}, 1) == []


def test_encode_and_compare(spark):
    counts = spark.createDataFrame([("abab", 2), ("b", 1)], "pretoken string, frequency long")
    small = spark.createDataFrame([("a",), ("b",)], "token string")
    large = spark.createDataFrame([("a",), ("b",), ("ab",)], "token string")
    out = {r.pretoken: r for r in encode.compare(encode.encode_words(counts, large), encode.encode_words(counts, small)).collect()}
    assert (out["abab"].left_tokens, out["abab"].right_tokens, out["abab"].delta_percent, out["abab"].first_difference) == (2, 4, -50.0, 0)
    assert out["b"].first_difference is None
    docs = spark.createDataFrame([(1, "abab b"), (2, "")], "doc_id long, text string")
    pieces = F.filter(F.split("text", " "), lambda w: w != "")
    assert {r.doc_id: r.n_tokens for r in encode.document_tokens(docs, pieces, encode.encode_words(counts, large)).collect()} == {1: 3, 2: 0}
    rows = encode.encode_documents(docs, pieces, encode.encode_words(counts, large)).orderBy("word_place", "token_place").collect()
    assert [r.token for r in rows] == ["ab", "ab", "b"]


def test_acceptance(spark):
    every = spark.createDataFrame([(t,) for t in [*ALPHABET, "<|unk|>"]], "token string")
    r = encode.acceptance(spark, every, ["<|unk|>"], "<|unk|>").first()
    assert (r.inputs, r.encodable, r.exact, r.all_unknown, r.special_tokens) == (256, 256, 256, 0, 1)
    few = spark.createDataFrame([("a",)], "token string")
    assert encode.acceptance(spark, few, [], "?").first().exact == 1


def graph_of(spark, words, most=None):
    counts = spark.createDataFrame(words, "pretoken string, frequency long")
    tokens = counting.token_ids(counting.candidate_counts(counts, 0, most))
    return counts, lp.load(counts, counting.edges(counts, tokens, most))


def test_lp_bounds_all_small_vocabularies(spark):
    _, graph = graph_of(spark, [("abab", 5), ("abc", 4), ("bcbc", 3)], 3)
    for budget in (1, 2, 3):
        made = lp.solve(graph, budget, rounds=3000, tolerance=0.001)
        best = min(float((graph.shortest(np.where(np.isin(graph.token, c), 1.0, np.inf)) * graph.weight).sum()) for c in combinations(range(len(graph.tokens)), budget))
        assert made.lower <= best + 1e-6 <= made.upper + 2e-6 and made.gap < 0.25
        assert made.values.min() >= 0 and made.values.max() <= 1 and made.values.sum() <= budget + 1e-6


def test_lp_checks_and_sweep(spark):
    _, graph = graph_of(spark, [("abab", 5), ("abc", 4)])
    with pytest.raises(ValueError):
        lp.solve(graph, 0)
    made = lp.sweep(graph, [3, 1, 3, 1000], rounds=100)
    assert list(made) == [1, 3, 1000] and made[1000].gap == 0 and made[1].upper >= made[3].upper
    table = lp.as_table(spark, graph, made[3])
    assert table.count() == len(graph.tokens)
    assert lp.value_counts(table).first().total <= 3.000001
    for rho in (-1, float("nan")):
        with pytest.raises(ValueError):
            lp.load(*graph_of(spark, [("ab", 1)])[:1], counting.edges(*[spark.createDataFrame([("ab", 1)], "pretoken string, frequency long"), spark.createDataFrame([("ab", 0)], "token string, token_id long")]), rho=rho)


def test_unigram(spark):
    counts = spark.createDataFrame(WORDS, "pretoken string, frequency long")
    rows = unigram.train(counts, 266, ["<|unk|>"], seeds=200, most=6)
    tokens = [t for t, _ in rows]
    assert len(tokens) == len(set(tokens)) <= 266 and set(ALPHABET) <= set(tokens) and tokens[0] == "<|unk|>"
    assert any(len(t) > 1 for t in tokens[1:]) and sum(np.exp(p) for t, p in rows[1:]) < 1.01
    assert unigram._expected("aa", {"a": np.log(0.5), "aa": np.log(0.25)}, 2) == pytest.approx({"a": 1.0, "aa": 0.5})


def test_rounding_sizes_and_errors(spark):
    table = spark.createDataFrame([(f"t{i:03d}", i, 1.0 if i < 10 else 1 / (i + 1)) for i in range(200)] + [("zero", 200, 0.0)], "token string, token_id long, lp_value double")
    for made in (V.deterministic(table, 300, ALPHABET, ["<|bos|>"]), V.biased(table, 300, ALPHABET, ["<|bos|>"]), V.probabilistic(table, 300, ALPHABET, 7, ["<|bos|>"])):
        rows = sorted(made.collect())
        assert [r.id for r in rows] == list(range(300)) and rows[0].token == "<|bos|>" and {f"t{i:03d}" for i in range(10)} <= {r.token for r in rows}
        V.check_size(made, 300)
    assert V.all_ones(table, ALPHABET).count() == 266
    for bad in (lambda: V.deterministic(table, 256, ALPHABET), lambda: V.probabilistic(table, 260, ALPHABET, 7).count(), lambda: V.check_size(V.deterministic(table, 999, ALPHABET), 999), lambda: V.frequent(table, 5)):
        with pytest.raises(ValueError):
            bad()


def test_jaccard(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", "bb"), ("y", "a"), ("y", "cc"), ("z", "ddd")], "sample string, token string")
    pairs = V.jaccard_pairs(df)
    assert {(r.sample_i, r.sample_j): r.jaccard for r in pairs.collect()} == {("x", "y"): 1 / 3, ("x", "z"): 0.0, ("y", "z"): 0.0}
    matrix = {(r.sample_i, r.sample_j): r.jaccard for r in V.jaccard_matrix(pairs).collect()}
    assert len(matrix) == 9 and all(matrix[i, j] == matrix[j, i] for i, j in matrix) and matrix["x", "x"] == 0
    lengths = {(r.sample_i, r.sample_j, r.token_length): r.jaccard for r in V.jaccard_by_length(df).collect()}
    assert lengths["x", "y", 1] == 1.0 and lengths["x", "y", 2] == 0.0 and lengths["x", "z", 3] == 0.0 and ("x", "y", 3) not in lengths


def test_quotas():
    assert sampling.equal_quotas(["a", "b", "c"], 8) == {"a": 3, "b": 3, "c": 2}
    for sources, n in (([], 3), (["a", "a"], 3), (["a"], 0)):
        with pytest.raises(ValueError):
            sampling.equal_quotas(sources, n)


def test_samples(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", None if i % 5 == 0 else f"text {i}") for i in range(60)], "doc_id long, source string, text string")
    first = sampling.first_rows(docs, {"s0": 3, "s1": 100})
    assert first.groupBy("source").count().collect() and sampling.unfilled(first, {"s0": 3, "s1": 100, "s9": 1}) == ["s1", "s9"]
    assert first.where("text is null").count() == 0
    a, b = (sorted(r.doc_id for r in sampling.hash_sample(docs, 10, s).collect()) for s in (1, 2))
    assert len(a) == 10 and a != b and a == sorted(r.doc_id for r in sampling.hash_sample(docs.repartition(7), 10, 1).collect())
    assert {r.source for r in sampling.two_tier_sample(docs, 2, 30, 5).collect()} < {"s0", "s1", "s2"}
    drawn = sampling.draw_sample(docs.select("doc_id", F.lit("x").alias("source"), F.col("source").alias("file")), spark.createDataFrame([("x", 50)], "source string, rows long"), 3)
    assert drawn.count() == 50
    assert sampling.draw_counts(spark, ["a", "b"], 100, 1).agg(F.sum("rows")).first()[0] == 100
    capped = sampling.char_cap(docs.where("text is not null"), 30).orderBy("doc_id").collect()
    assert sum(len(r.text) for r in capped) >= 30 > sum(len(r.text) for r in capped[:-1])
    assert {r.chunk: r["count"] for r in sampling.chunks(docs, 25).groupBy("chunk").count().collect()} == {0: 25, 1: 25, 2: 10}


def test_ids_and_running_sums_over_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10**6), rng.randrange(50)) for _ in range(500)]
    out = counting.dense_ids(spark.createDataFrame(rows, "k long, v long").repartition(9), ["k", "v"], "i", {"before": "v"}).orderBy("i").collect()
    total = 0
    for i, (r, want) in enumerate(zip(out, sorted(rows))):
        assert (r.i, r.k, r.v, r.before) == (i, *want, total)
        total += r.v
    assert counting.dense_ids(spark.createDataFrame([], "k long, v long"), ["k"], "i").count() == 0


def test_closed_form_of_edges(spark):
    counts = spark.createDataFrame([("a" * n, 1) for n in (1, 2, 5, 9)], "pretoken string, frequency long")
    for most in (None, 2, 4, 100):
        assert counting.raw_graph_size(counts, most).first().raw_edges == counting.occurrences(counts, most).count()


def test_bpe_words_beyond_the_bound_are_an_error(spark):
    counts = spark.createDataFrame([("ab", 3), ("cd", 2), ("ef", 1)], "pretoken string, frequency long")
    assert bpe.load_words(counts, 3) == [("ab", 3), ("cd", 2), ("ef", 1)]
    with pytest.raises(ValueError):
        bpe.load_words(counts, 2)


def test_report_trains_on_all_words(spark, tmp_path, monkeypatch):
    from tokenloom.plans import queries

    class Seen(Exception):
        pass

    def train(words, *_):
        raise Seen(len(words))

    spark.createDataFrame([(" ".join(f"{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260 % 26)}{chr(97 + i // 6760)}" for i in range(21_000)),)], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(bpe, "train", train)
    with pytest.raises(Seen) as seen:
        queries.tokenization_report(spark, str(tmp_path))
    assert seen.value.args == (21_000,)


def test_unigram_query_keeps_long_pieces(spark, tmp_path):
    from tokenloom.plans import queries

    spark.createDataFrame([(" ".join(["internationally"] * 50),)], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokens = {r.token for r in queries.unigram_vocabulary(spark, str(tmp_path)).collect()}
    assert "internationally" in tokens or "Ġinternationally" in tokens


def test_draws_go_on_until_the_count_is_full(spark):
    docs = spark.createDataFrame([("a", "f", 1), ("b", "g", 2), ("b", "g", 3), ("b", "h", 4)], "source string, file string, doc_id long")
    counts = spark.createDataFrame([("a", 1500), ("b", 7), ("c", 0)], "source string, rows long")
    out = {r.source: r["count"] for r in sampling.draw_sample(docs, counts, 3).groupBy("source").count().collect()}
    assert out == {"a": 1500, "b": 7}
    with pytest.raises(ValueError, match="no rows"):
        sampling.draw_sample(docs, spark.createDataFrame([("c", 1)], "source string, rows long"), 3)
