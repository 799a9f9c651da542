import hashlib

import pytest

from tests.llm.helpers import edge_docs, edge_rows, empty_docs, prose
from tokenloom.llm import simhash as S
from tokenloom.llm._common import WordHashes, mix

import numpy as np


def slow(text):
    """Votes of every term on every bit, one by one."""
    words = WordHashes().of((text or "").encode().lower().split())
    if not len(words):
        return bytes(16)
    terms: dict[int, int] = {}
    for h in [*words, *(mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]))]:
        terms[int(h)] = terms.get(int(h), 0) + 1
    votes = np.zeros(128, int)
    for h, n in terms.items():
        x = np.array([h], np.uint64)
        both = np.stack((mix(x), mix(x ^ np.uint64(0xA0761D6478BD642F))), axis=1)
        votes += min(n.bit_length(), 16) * (2 * np.unpackbits(both.view(np.uint8).reshape(-1)).astype(int) - 1)
    return np.packbits(votes > 0).tobytes()


@pytest.mark.parametrize("text", [None, "", "a", "a a a a", "b a", prose(3, 200), "the the " * 400])
def test_fingerprint(text):
    assert S.fingerprint(S._words(text or "", WordHashes())) == slow(text)


def check(rows, docs):
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        want.append((repr(d), len(t), hashlib.sha256(e.encode()).hexdigest(), slow(t).hex(), slow(e).hex(), round(S.likeness(slow(t), slow(e)), 9), round(S.likeness(slow(t), slow(n)), 9)))
    got = [(repr(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]
    assert sorted(got) == sorted(want)


def test_rows_in_order_across_tasks(spark):
    docs = [(i * 7, prose(i, 20 + i % 50)) for i in range(150)]
    check(S.with_next(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect(), docs)
    one = [(5, "a single text")]
    check(S.with_next(spark.createDataFrame(one, "doc_id long, text string")).collect(), one)


def test_edges(spark):
    docs = [(r[0], r[1]) for r in edge_rows() if len(r[1] or "") < 10_000]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, fingerprint int")
    check(S.op8(spark, df).collect(), docs)
    assert S.op8(spark, empty_docs(spark)).count() == 0
    assert S.op8(spark, edge_docs(spark)).count() == len(edge_rows())


def test_search_finds_all_within_radius(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (40, 16), dtype=np.uint8)
    marks = [b.tobytes() for b in base]
    for b in base:
        for flips in (1, 2, 3, 4, 6):
            x = np.unpackbits(b)
            x[rng.choice(128, flips, replace=False)] ^= 1
            marks.append(np.packbits(x).tobytes())
    df = spark.createDataFrame([(m.hex(),) for m in marks] + [(marks[0].hex(),), (None,)], "fingerprint string")
    number = [int.from_bytes(m, "big") for m in marks]
    for radius, agree in ((0, 1), (3, 1), (3, 2), (6, 2)):
        want = {(a.hex(), b.hex()) for a, x in zip(marks, number) for b, y in zip(marks, number) if (x ^ y).bit_count() <= radius}
        out = S.search(df, df, radius, agree).collect()
        assert {(r["query"], r.fingerprint) for r in out} == want and len(out) == len(want)


def test_near_column_counts_copies(spark):
    docs = [(50, "some text of words"), (51, "some text of words"), (100, prose(1, 40)), (101, prose(2, 40))]
    out = {r.doc_id: r.n_near for r in S.op8(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {50: 2, 51: None, 100: 1, 101: None}
