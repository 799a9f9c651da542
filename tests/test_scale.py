"""Steps that must not fail or grow beyond their limits on larger tables."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tokenloom.functions.text import ALPHABET
from tokenloom.operators import bpe, counting, prefixes, unigram, vocabulary


def some_words(seed, n=200):
    rng = random.Random(seed)
    return list({"".join(rng.choice("abcĠ") for _ in range(rng.randint(1, 12))): rng.randint(1, 30) for _ in range(n)}.items())


def in_batches(words, n=7):
    for i in range(0, len(words), n):
        part = words[i : i + n]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([f for _, f in part], pa.int64())], ["pretoken", "frequency"])


@pytest.mark.parametrize("seed", range(8))
def test_words_in_one_array_train_alike(seed, monkeypatch):
    monkeypatch.setattr(bpe, "_SPAN", 1 << (3 + seed))
    monkeypatch.setattr(bpe, "_DENSE", 0 if seed % 2 else 1 << 16)
    words = some_words(seed)
    _, merges = bpe.train(words, 320, ["<s>"])
    assert [e[1:] for e in bpe.flat_train(in_batches(words), 320, ["<s>", *sorted(ALPHABET)])] == merges


def test_merges_of_a_table(spark):
    words = some_words(1)
    assert bpe.train(bpe.Table(spark.createDataFrame(words, "pretoken string, frequency long")), 300) == bpe.train(words, 300)


def no_list(*_):
    raise ValueError("more words than a list holds")


def test_merges_need_no_list_of_words(spark, monkeypatch):
    from tokenloom.plans import queries

    monkeypatch.setattr(bpe, "load_words", no_list)
    assert queries.bpe_merges(spark, "/root/testdata/sf0.001").count() > 1000


def test_report_needs_no_list_of_words(spark, monkeypatch):
    from tokenloom.plans import queries

    monkeypatch.setattr(bpe, "load_words", no_list)
    assert queries.tokenization_report(spark, "/root/testdata/sf0.001").count() > 1000


@pytest.mark.parametrize("seed, tau", [(1, 0.5), (2, 0.9), (3, 1.0), (4, 0.5)])
def test_events_from_one_array(seed, tau, monkeypatch):
    monkeypatch.setattr(bpe, "_SPAN", 64)
    words = some_words(seed)
    made = bpe.Picky(words, tau=tau)
    made.train(310)
    assert bpe.flat_picky(in_batches(words), 310, tau) == made.events


def test_events_need_no_list_of_words(spark, monkeypatch):
    from tokenloom.plans import queries

    monkeypatch.setattr(bpe, "load_words", no_list)
    assert queries.picky_bpe_events(spark, "/root/testdata/sf0.001").count() > 700


def no_rows(*_, **__):
    raise AssertionError("a row for each substring of each pretoken")


def some_counts(spark, seed=5):
    return spark.createDataFrame([*some_words(seed), ("z", 1), ("é😀x", 1)], "pretoken string, frequency long")


def by_definition(rows, most=None):
    """Occurrences (pretoken, start, end) of substrings, and their counts."""
    found = [(w, f, s, e) for w, f in rows for s in range(len(w)) for e in range(s + 2, len(w) + 1) if most is None or e - s <= most]
    count = {}
    for w, f, s, e in found:
        count[w[s:e]] = count.get(w[s:e], 0) + f
    return found, count


@pytest.mark.parametrize("batch, most", [(1, None), (3, 4), (10_000, None), (10_000, 2)])
def test_edges_counted_without_making_them(spark, batch, most):
    counts = some_counts(spark)
    found, count = by_definition([tuple(r) for r in counts.collect()], most)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.pretoken: r.edges for r in prefixes.edge_counts(counts, 2, most).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {r.pretoken: sum(w == r.pretoken and count[w[s:e]] > 1 for w, _, s, e in found) for r in counts.collect()}


def test_free_edges_make_no_row_for_each_substring(spark, monkeypatch):
    from tokenloom.plans import queries

    monkeypatch.setattr(counting, "occurrences", no_rows)
    assert queries.extended_free_edges(spark, "/root/testdata/sf0.001").count() > 1000


def test_summary_makes_no_row_for_each_substring(spark, monkeypatch):
    from tokenloom.plans import queries

    monkeypatch.setattr(counting, "occurrences", no_rows)
    assert queries.graph_summary(spark, "/root/testdata/sf0.001").count() > 1000


def test_more_sure_tokens_than_room(spark):
    table = spark.createDataFrame([(f"t{i}", i, 1.0 - i % 3 / 1000) for i in range(60)], "token string, token_id long, lp_value double")
    rows = vocabulary.probabilistic(table, 276, ALPHABET, 7, strict=False).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(276)) and [r.token for r in rows[256:]] == [f"t{i}" for i in [*range(0, 60, 3)]]


@pytest.mark.parametrize("name", ["morphology_penalties", "token_edges", "top_tokens", "value_support", "rounding_biased", "rounding_all_ones", "rounding_deterministic"])
def test_totals_make_no_row_for_each_substring(spark, monkeypatch, name):
    from tokenloom.plans import queries

    monkeypatch.setattr(counting, "occurrences", no_rows)
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 10


@pytest.mark.parametrize("seed", range(4))
def test_expected_counts_of_many_words(seed, monkeypatch):
    monkeypatch.setattr(unigram.Expected, "_CELLS", 10 ** (1 + 2 * seed))
    rng = random.Random(seed)
    words = [w for w, _ in some_words(seed, 60)] + ["", "zz"]
    freq = np.array([rng.randint(1, 9) for _ in words])
    logp = {w[i : i + rng.randint(1, 4)]: -9 * rng.random() for w in words for i in range(len(w))}
    want = dict.fromkeys(logp, 0.0)
    for w, f in zip(words, freq):
        for t, e in unigram._expected(w, logp, 4).items():
            want[t] += f * e
    made = unigram.Expected(logp)
    assert dict(zip(made.tokens, made.of(words, freq))) == pytest.approx(want)
