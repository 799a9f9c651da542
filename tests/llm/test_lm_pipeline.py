import math
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from tests.llm.helpers import edge_docs, edge_rows, empty_docs, labels, prose
from tokenloom.llm import lm_scoring as L


def check_base(rows, docs):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    counts = Counter(w for d, t in docs if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(d), held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for d, t in docs)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and r.bits_per_byte > 0 and math.isfinite(r.score) for r in rows)


def test_scores(spark):
    docs = [(i, prose(i, 60 + i % 50, 150)) for i in range(150)]
    rows = L.lm_scores(spark.createDataFrame(docs, "doc_id long, text string"), hot_words=40).collect()
    check_base(rows, docs)
    held = [r for r in rows if r.held_out]
    # better than eight bits a byte by far, and at most a little worse than the base on so small a corpus
    assert sum(r.bits_per_byte for r in held) / len(held) < 2.5
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)


def test_hot_words_change_nothing(spark):
    df = spark.createDataFrame([(i, prose(i, 60, 100)) for i in range(40)], "doc_id long, text string")
    a, b = ({r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in L.lm_scores(df, hot_words=k).collect()} for k in (5, 10_000))
    assert a == b


def test_edges(spark):
    docs = [(r[0], r[1]) for r in edge_rows()]
    check_base(L.lm_scores(edge_docs(spark)).collect(), docs)
    assert L.lm_scores(empty_docs(spark)).count() == 0
    # held-out documents alone: nothing is known
    only = [d for d in range(200) if zlib.crc32(str(d).encode()) % 5 == 1][:3]
    rows = L.lm_scores(spark.createDataFrame([(d, "a b") for d in only], "doc_id long, text string")).collect()
    assert [r.n_known for r in rows] == [0, 0, 0] and {r.train_tokens for r in rows} == {0} and {r.base_score for r in rows} == {0.0}


def test_probabilities_sum_to_one():
    """Over all continuations of one byte; the mixer predicts bits, so this holds by construction."""
    mixer = L.Mixer(*np.random.default_rng(0).integers(0, 9, (2, L.SLOTS)).astype(np.float32))
    mixer.refine = np.random.default_rng(1).integers(0, 50, mixer.refine.shape).astype(float)
    mixer.prepare()
    data = np.arange(256, dtype=np.uint8)
    context, byte, where = L.contexts(data, np.arange(256), np.zeros(256, int))
    assert (byte[where] == data).all()
    data, partial = byte, L.partial_bytes(byte)
    odds, gate = mixer.inputs(context, partial)
    z = mixer.mixed(odds, gate).astype(float)
    p = 1 / (1 + np.exp(-z))
    at = mixer.cell(mixer.mixed(odds, gate), partial)
    n0, n1 = mixer.refine[0][at], mixer.refine[1][at]
    p = 0.5 * (p + (n1 + 20 * p) / (n0 + n1 + 20))
    assert np.prod(np.where(L.bits_of(data), p, 1 - p), axis=1).sum() == pytest.approx(1, abs=1e-6)


def test_orders_of_the_predictors():
    """One predictor for each of the last one to four bytes of the word, and two for the word so far."""
    words = [b"abcdex", b"zbcdex", b"zzcdex", b"zzzdex", b"zzzzex"]
    data, starts = L.spelled(words)
    context, byte, where = L.contexts(data, starts, np.zeros(len(words), int))
    assert len(context) == L.PREDICTORS == len(L.SLOT_BITS) == L.LONGEST + L.WORD_PREDICTORS
    seen = context[:, where[starts + 5]]
    # the x of two words: the same context while the orders don't reach the first byte that differs
    for k in range(4):
        assert [c == seen[k, 0] for c in seen[k]] == [True] * (5 - k) + [False] * k
    assert all(len(set(seen[k].tolist())) == len(words) for k in (4, 5))


def test_exact_counts_take_the_share_they_earn():
    mixer = L.Mixer(*np.random.default_rng(0).integers(0, 9, (2, L.SLOTS)).astype(np.float32))
    words, kinds, n = [b"aa", b"bb", b"cc"], np.array([0, 0, 1]), np.array([30, 70, 5])
    mixer.tokens = np.bincount(kinds, n, L.CLUSTERS + 1)
    mixer.learn(words, kinds, n)
    assert mixer.trust.sum() == pytest.approx(2 * (L.CLUSTERS + 1) + 105)
    share = mixer.spelled_share(kinds)
    # the exact parts of a class's words and what is left for spelling make one
    assert mixer.counted(kinds, n)[:2].sum() + share[0] == pytest.approx(1) and mixer.counted(kinds, n)[2] + share[2] == pytest.approx(1)
    mixer.prepare()
    spelled = mixer.log10(words, kinds)
    assert np.allclose(10 ** mixer.word_log10(words, kinds, n), mixer.counted(kinds, n) + share * 10**spelled)
    # unseen words, unseen classes and words too long for a double
    assert mixer.word_log10([b"zz"], np.array([0]), np.array([0]))[0] == pytest.approx(mixer.log10([b"zz"], np.array([0]))[0] + np.log10(share[0]))
    assert mixer.word_log10([b"zz"], np.array([5]), np.array([0]))[0] == pytest.approx(mixer.log10([b"zz"], np.array([5]))[0])
    assert np.isfinite(mixer.word_log10([b"x" * 5000], np.array([0]), np.array([0]))[0]) and mixer.word_log10([b"x" * 5000], np.array([0]), np.array([0]))[0] < -300


def test_held_out_texts_of_several_classes_cost_less_than_the_base(spark):
    """Two vocabularies, told apart by the class: known words cost clearly less than by their share of all words."""
    docs = [(i, prose(i, 120, 60) if i % 2 else prose(i, 120, 60).upper().replace("W", "Q")) for i in range(240)]
    held = [r for r in L.lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.15


def test_learning_lowers_the_cost():
    words = sorted({w.encode() for w in prose(1, 3000, 300).split()})
    n = np.arange(1, len(words) + 1)
    counts = np.zeros((2, L.SLOTS), np.float32)
    data, starts = L.spelled(words)
    context, byte, where = L.contexts(data, starts, np.zeros(len(words), int))
    partial, bits = L.partial_bytes(byte)[where], L.bits_of(data)
    times = np.repeat(np.repeat(n, np.diff(np.append(starts, len(data)))), 8)
    for k in range(L.PREDICTORS):
        at = L.slot(k, context[:, where], partial).astype(np.int64) + L.FIRST_SLOT[k]
        np.add.at(counts, (bits.reshape(-1).astype(int), at.reshape(-1)), times)
    cost = []
    for rounds in (0, 3):
        mixer = L.Mixer(*counts)
        for _ in range(rounds):
            for part in L.spell_blocks(words, 1024):
                mixer.learn(words[part], np.zeros(len(words[part]), int), n[part])
        mixer.prepare()
        cost.append((mixer.log10(words, np.zeros(len(words), int)) * n).sum())
    assert cost[1] > cost[0]


@pytest.mark.parametrize("texts", [[], [None], ["", " "], ["a", None, " b  c\n"], ["A\x0bB\x1cC  É"]])
def test_tokens(texts):
    known = L.Vocabulary()
    numbers, starts = L.tokenized(pa.array(texts, pa.string()), known)
    want = [(t or "").encode().lower().split() + [L.END] for t in texts]
    assert [known.words[i] for i in numbers] == [w for x in want for w in x]
    assert starts.tolist() == np.cumsum([0, *map(len, want)])[:-1].tolist()


def test_classes_are_causal():
    votes = np.random.default_rng(2).normal(size=(L.BUCKETS, L.CLUSTERS))
    buckets = np.random.default_rng(3).integers(0, L.BUCKETS, 50)
    starts = np.array([0, 20, 21])
    kind = L.causal_classes(buckets, starts, votes)
    for s, e in zip(starts, [20, 21, 50]):
        assert kind[s] == L.CLUSTERS
        for i in range(s + 1, e):
            assert kind[i] == np.argmax(np.round(votes[buckets[s:i]] * 1e6).sum(0))


def pipeline_folder(spark, tmp_path, docs, known):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline(spark, tmp_path):
    base = prose(1, 200)
    rows = [(i, prose(i, 200), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, f"edit{i} " + base, "en", "s", 0) for i in range(5)] + [(110, base, "en", "s", 0)] + [(200 + i, " ".join(w + "***" for w in prose(300 + i, 80).split()), "de", "s", 0) for i in range(20)]
    rows += [(300 + i, prose(400 + i, 60).replace(" w", " vile w", 6), "en", "s", 0) for i in range(20)] + [(400, "too short", None, None, None), (401, None, None, None, None), (None, prose(9, 100), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = labels(spark, [(i, 1, 0) for i in range(0, 60, 2)] + [(200 + i, 0, 0) for i in range(0, 20, 2)] + [(300 + i, 1, 1) for i in range(0, 20, 2)])
    folder = pipeline_folder(spark, tmp_path, docs, known)
    kept, now = [], spark.read.parquet(folder + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialize(stage(spark, now, folder), "test")
        assert now.columns == docs.columns, name
        kept.append({r.doc_id for r in now.collect()})
    quality, toxic, lines, near = kept
    assert not any(200 <= d < 220 for d in quality if d) and 400 not in quality and set(range(60)) <= quality
    assert not any(300 <= d < 320 for d in toxic if d) and set(range(60)) <= toxic
    # 110 repeats a line: it loses its text but stays, linked with nothing; the edited ones are near copies
    assert lines == toxic and {1, 110} <= near and not near & {100, 101, 102, 103, 104}
    texts = {r.doc_id: r for r in now.collect()}
    assert texts[1].n_chars == len(texts[1].text) and texts[110].text == "" and texts[110].n_chars == 0
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == near


@pytest.mark.parametrize("rows", ["edge", "empty"])
def test_pipeline_edges(spark, tmp_path, rows):
    docs = edge_docs(spark) if rows == "edge" else empty_docs(spark)
    folder = pipeline_folder(spark, tmp_path, docs, labels(spark, [(6, 1, 0), (10, 0, 1), (None, None, None)]))
    now = spark.read.parquet(folder + "/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialize(stage(spark, now, folder), "test")
        assert now.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, now, folder).count() == corpus_pipeline.run(spark, folder).count()


def test_words_are_numbered_together():
    """No Python call for each word: those took a large part of the time."""
    calls = []
    words = [f"w{k}" for k in range(20000)]
    known = L.Vocabulary()
    L.tokenized(pa.array(["a b"]), L.Vocabulary())  # what is imported late
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        numbers, starts = L.tokenized(pa.array([" ".join(words), "w7 new"]), known)
        buckets = known.buckets
    finally:
        sys.setprofile(None)
    assert len(calls) < 10_000
    assert numbers.tolist() == [*range(20000), 20001, 7, 20000, 20001] and starts.tolist() == [0, 20001]
    assert buckets.tolist() == [xxhash.xxh3_64_intdigest(w) % L.BUCKETS for w in known.words]
    assert L.bucketed(pa.array([" ".join(words), "w7 new"]))[0].tolist() == buckets[numbers].tolist()


def test_byte_list():
    values = [b"", b"a", b"bc", "é日".encode(), b"", b"d" * 300]
    array = pa.array(values, pa.binary())
    for part in (array, array[2:], array[1:4], array[4:5], array[:0], pa.array([], pa.binary()), pa.chunked_array([array[3:], array[:0], array[:2]])):
        assert L.byte_list(part) == part.to_pylist()


def test_tables_of_32_bits_pass_nothing(monkeypatch):
    """Given out before they are full, wide for a block that is too much: the sums stay those of the definition."""
    words = sorted({w.encode() for w in prose(1, 400, 60).split()})
    n = np.arange(1, len(words) + 1) ** 3
    n[5] = 2**33
    batches = [pa.RecordBatch.from_arrays([pa.array(words[i : i + 9], pa.binary()), pa.array(np.zeros(len(words[i : i + 9]), np.int32)), pa.array(n[i : i + 9])], ["word", "class", "n"]) for i in range(0, len(words), 9)]
    want = np.zeros(2 * L.SLOTS, np.int64)
    data, starts = L.spelled(words)
    context, byte, where = L.contexts(data, starts, np.zeros(len(words), int))
    times = np.repeat(np.repeat(n, np.diff(np.append(starts, len(data)))), 8)
    for k in range(L.PREDICTORS):
        at = 2 * (L.slot(k, context[:, where], L.partial_bytes(data)).astype(np.int64) + L.FIRST_SLOT[k]) + L.bits_of(data)
        np.add.at(want, at.reshape(-1), times)
    for rows in (1, 130_000):
        gathered = L.gathered
        monkeypatch.setattr(L, "gathered", lambda b, rows=rows, f=gathered: f(b, rows))
        found = np.zeros((len(want) // (2 * L.SHARD), 2 * L.SHARD), np.int64)
        for k, cells in L.tallies(iter(batches)):
            found[k] += cells
        monkeypatch.undo()
        assert (found.reshape(-1) == want).all()
