import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from tests.llm.helpers import edge_docs, edge_rows, empty_docs, prose
from tokenloom.llm import bpe_automaton as B
from tokenloom.llm import packing as P

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
word_library, byte_library = Library.from_file(WORD), Library.from_file(BYTE)
PARTS = ["a", "the", "The", "ing", " ", "\n", "\t", "　", "\x85", "\x1c", "'s", "'LL", "1", "²", "ſ", "Σ", "İ", "é", "é", "日本", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "​", "!?", "\U00016916"]
texts = st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=4)), max_size=30).map(lambda x: "".join(x).encode("utf-8", "ignore").decode())


@settings(max_examples=400, deadline=None)
@given(texts)
def test_automaton_agrees_with_library(text):
    ids, decoded = B.load(WORD).encode(text)
    want = word_library.encode(text, add_special_tokens=False).ids
    assert array("I", ids).tolist() == want
    assert decoded == word_library.decode(want, skip_special_tokens=False) == B.load(WORD).decode(want)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_byte_encoder_agrees_with_library(text):
    assert P.load_encoder(BYTE).encode_to_numpy(text, allowed_special="all").tolist() == byte_library.encode(text, add_special_tokens=False).ids


def bpe(symbols, merges):
    rank = {m: i for i, m in enumerate(merges)}
    s = list(symbols)
    while True:
        found = min(((rank[p], i) for i, p in enumerate(zip(s, s[1:])) if p in rank), default=None)
        if found is None:
            return s
        i = found[1]
        s[i : i + 2] = [s[i] + s[i + 1]]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_automaton_of_random_merges(seed):
    """Gadgets one by one against BPE by definition, on small alphabets with many repetitions."""
    rng = random.Random(seed)
    tokens = list("ab") if seed % 2 else list("abc")
    merges = []
    for _ in range(rng.randint(1, 12)):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens and len(a + b) < 9:
            merges.append((a, b))
            tokens.append(a + b)
    made = B.Automaton({t: i for i, t in enumerate(tokens)}, merges)
    made.spell("")
    made.final = made.inner
    for _ in range(30):
        word = "".join(rng.choice(tokens[:3]) for _ in range(rng.randint(1, 14)))
        assert [tokens[i] for i in made.encode(word)] == bpe(word, merges)


def test_encode_rows(spark):
    rows = {repr(r): r for r in edge_rows()}
    out = B.encode(edge_docs(spark), WORD).collect()
    assert len(out) == len(edge_rows()) and rows
    for r in out:
        want = word_library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == word_library.decode(want, skip_special_tokens=False)
    digest = B.encode(edge_docs(spark), WORD, digest=True).where("doc_id = 6").first()
    want = word_library.encode(digest.text, add_special_tokens=False).ids
    assert digest.n_tokens == len(want) and digest.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert B.encode(empty_docs(spark), WORD).count() == 0


def test_decode_rows(spark):
    df = spark.createDataFrame([(1, [320, 49407]), (2, []), (3, None)], "k int, ids array<int>")
    out = {r.k: r.decoded for r in B.decode(df, WORD).collect()}
    assert out == {1: word_library.decode([320, 49407], skip_special_tokens=False), 2: "", 3: None}


def test_other_files_are_refused():
    with pytest.raises((ValueError, TypeError)):
        B.Tokenizer(BYTE)
    with pytest.raises((ValueError, KeyError)):
        P.load_encoder(WORD)


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 2048, 2049, 5000])
def test_cut(n):
    parts = P.cut(n)
    assert sum(k for _, k in parts) == n and all(k == 1024 for _, k in parts[1:]) and 0 < parts[0][1] <= 1024
    at = 0
    for s, k in parts:
        assert s == at
        at += k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40))
def test_fullest_is_best(lengths):
    counts = [0] * 31
    for n in lengths:
        counts[n] += 1
    chosen = P.fullest(counts, 30)
    assert all(chosen.count(n) <= counts[n] for n in chosen) and max(lengths) in chosen and sum(chosen) <= 30
    rest = sorted(lengths)
    rest.remove(max(lengths))
    sums = {0}
    for n in rest:
        sums |= {s + n for s in sums}
    assert sum(chosen) == max(s + max(lengths) for s in sums if s + max(lengths) <= 30)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_plan_places_everything_once(histogram):
    places, sequences = P.plan(histogram, 64)
    used: dict[int, list] = {}
    for n, first, end, times, base, offset in places:
        for rank in range(first, end):
            turn, slot = divmod(rank - first, times)
            used.setdefault(base + turn, []).append((offset + slot * n, n))
    assert sorted(n for x in used.values() for _, n in x) == sorted(n for n, k in histogram.items() for _ in range(k))
    assert len(used) == sequences
    for x in used.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 64
    rooms: list[int] = []  # first fit decreasing, for comparison
    for n in sorted((n for n, k in histogram.items() for _ in range(k)), reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= n), None)
        if at is None:
            rooms.append(64 - n)
        else:
            rooms[at] -= n
    assert sequences <= 1.1 * len(rooms) + 2


def check_packing(rows, docs):
    ids = [np.array(byte_library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t in docs]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    want = sorted((repr(d), k, s, n, zlib.crc32(x[s : s + n].tobytes())) for (d, _), x in zip(docs, ids) for k, (s, n) in enumerate(P.cut(len(x))))
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 1024
    return len(bins)


def test_pack_rows(spark):
    docs = [(i, prose(i, 10 + 37 * (i % 40))) for i in range(200)]
    rows = P.pack(spark.createDataFrame(docs, "doc_id long, text string"), BYTE).collect()
    assert check_packing(rows, docs) <= -(-sum(r.length for r in rows) // 1024) + 1


def test_pack_edges(spark):
    check_packing(P.pack(edge_docs(spark), BYTE).collect(), [(r[0], r[1]) for r in edge_rows()])
    assert P.pack(empty_docs(spark), BYTE).count() == 0


def test_ranks_in_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECES_PER_BUCKET", 10)
    docs = [(i, "same text") for i in range(95)] + [(i, prose(i, 30)) for i in range(95, 120)]
    check_packing(P.pack(spark.createDataFrame(docs, "doc_id long, text string"), BYTE).collect(), docs)


@pytest.mark.parametrize("text", [" " * 2_000_000 + "x", "word " * 3 + "\n" * 1_200_000 + " tail", "x" * 1_000_000], ids=["spaces", "lines", "letters"])
def test_very_long_runs_encode_as_the_library_does(text):
    assert P.encode(BYTE, text).tolist() == byte_library.encode(text, add_special_tokens=False).ids


def test_very_long_white_space_is_packed(spark):
    df = spark.createDataFrame([(1, " " * 1_200_000 + "x"), (2, "short"), (3, None)], "doc_id long, text string")
    out = P.pack(df, BYTE).collect()
    assert {r.doc_id for r in out} == {1, 2, 3} and max(r.offset + r.length for r in out) <= P.CAPACITY
