import random
from itertools import combinations

import numpy as np
import pytest

from tests.llm.helpers import edge_docs, edge_rows, empty_docs, prose
from tokenloom.llm import near_dedup


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return set(zip(w, w[1:], w[2:])) if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(rows):
    """(doc_id, n_shingles, component, kept) by comparing all pairs."""
    docs = {}
    for d, t in rows:
        docs.setdefault(d, shingle_set(t))
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(d for d in docs if d is not None), 2):
        x, y = docs[a], docs[b]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            i, j = sorted((find(a), find(b)))
            root[j] = i
    return sorted([(d, len(shingle_set(t)), find(d), d is None or find(d) == d) for d, t in rows], key=repr)


def got(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()], key=repr)


def variant(text, rng, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=3):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = prose(g, 150)
        rows += [(len(rows) + k, variant(base, rng, k % 6)) for k in range(14)]
    rows += [(len(rows) + k, prose(1000 + k, 60)) for k in range(30)]
    shared = prose(77, 12)
    rows += [(len(rows) + k, shared + " " + prose(2000 + k, 90)) for k in range(40)]
    rows += [(len(rows) + k, "a b c") for k in range(5)] + [(len(rows) + 5 + k, t) for k, t in enumerate(["A", "a", "b c", "B  C", "", None])]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.near_dedup(df)) == brute(rows)


def test_hot_group_and_small_leaves(spark):
    """More near copies than a node may hold: they branch, link as stars, and still meet."""
    rng = random.Random(5)
    base = prose(1, 200)
    rows = [(k, variant(base, rng, rng.randrange(7))) for k in range(90)] + [(90 + k, base) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.near_dedup(df, leaf=4, depth=2)) == brute(rows)


def test_hot_family_linked_in_pairs_only(spark):
    """A shared core puts all in the same large nodes at J = 0.84; each is linked with its partner alone."""
    core, rows = [f"c{i}" for i in range(185)], []
    for k in range(300):
        rows.append((k, " ".join([*core, *(f"p{k % 150}x{i}" for i in range(2)), *(f"o{k}x{i}" for i in range(15))])))
    x, y, z = (shingle_set(rows[k][1]) for k in (0, 150, 1))
    assert 100 * len(x & y) >= 85 * len(x | y) and 84 * len(x | z) <= 100 * len(x & z) < 85 * len(x | z)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.near_dedup(df)) == brute(rows)


def test_pairs_across_in_blocks(spark):
    """Blocks smaller than the node still meet every pair of different components, and no other pair."""
    sketch = bytes(range(near_dedup.SKETCH))
    members = spark.createDataFrame([(1, i, bytearray(sketch)) for i in range(30)] + [(2, i, bytearray(sketch)) for i in range(30, 34)], "node long, id long, sketch binary")
    label = spark.createDataFrame([(i, 0 if i < 20 else 30) for i in [*range(20), *range(30, 34)]], "id long, component long")
    out = sorted((r.a, r.b) for r in near_dedup.pairs_across(members, label, block=4).collect())
    assert out == [(a, b) for a, b in combinations(range(30), 2) if b >= 20]


def test_edge_rows(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert got(near_dedup.near_dedup(edge_docs(spark))) == brute(rows)
    assert near_dedup.near_dedup(empty_docs(spark)).count() == 0


def test_threshold_is_exact(spark):
    # sets of 100 shingles that share exactly 85 of 100 or 84 of 101 in the union
    words = [f"w{i}" for i in range(400)]
    a = words[:87]
    rows = [(1, " ".join(a)), (2, " ".join(a + words[200:215])), (3, " ".join(a + words[300:316]))]
    x, y, z = (shingle_set(t) for _, t in rows)
    assert 100 * len(x & y) == 85 * len(x | y) and 100 * len(x & z) < 85 * len(x | z)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.near_dedup(df)) == brute(rows)


@pytest.mark.parametrize("sent", [0, near_dedup.MOST_SENT])
def test_large_sets_at_the_threshold(spark, monkeypatch, sent):
    """185,000 of 200,000 shared is a link at 85 of 100 exactly; one shingle less in common isn't."""
    monkeypatch.setattr(near_dedup, "MOST_SENT", sent)
    rows = []
    for g in range(3):
        x = [f"g{g}w{i}" for i in range(200_002)]
        rows += [(3 * g, " ".join(x)), (3 * g + 1, " ".join(x[: 170_002])), (3 * g + 2, " ".join(x[: 170_001] + ["end"]))]
    x, y, z = (shingle_set(rows[k][1]) for k in range(3))
    assert 100 * len(x & y) == 85 * len(x | y) and 100 * len(x & z) < 85 * len(x | z)
    # without the middle one the others aren't linked
    rows = rows[:3] + [rows[k] for k in (3, 5, 6, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(near_dedup.near_dedup(df)) == brute(rows)


def test_narrow_multisets_share_no_less():
    rng = np.random.default_rng(1)
    for _ in range(50):
        # few values, so that many tokens collide
        all_ = rng.permutation(3000)
        x, y = all_[:900], all_[300:1100]
        narrow = rng.integers(0, 2000, 3000).astype(np.uint32)
        assert near_dedup.shared_tokens(np.sort(narrow[x]), np.sort(narrow[y])) >= 600
    wide = np.arange(3000, dtype=np.uint64)
    assert near_dedup.shared_tokens(wide[:900], wide[300:1100]) == 600


def test_large_node_whose_smallest_is_apart(spark):
    """The smallest class of a hot node is linked with none of the others, which are near copies."""
    rng = random.Random(9)
    base = prose(1, 300)
    words = base.split()
    rows = [(0, " ".join(words[:250] + [f"z{i}" for i in range(60)]))] + [(k, variant(base, rng, 1 + k % 5)) for k in range(1, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.near_dedup(df, leaf=6, depth=3)) == brute(rows)


def test_repeated_ids_with_other_texts(spark):
    """A repeated doc_id is linked through each of its texts."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    df = spark.createDataFrame([(6, a), (6, b), (7, a), (5, b), (9, b), (10, c), (11, None), (11, c)], "doc_id long, text string")
    out = {(r.doc_id, r.n_shingles > 0): r.component_id for r in near_dedup.near_dedup(df).collect()}
    assert out == {(5, True): 5, (6, True): 5, (7, True): 5, (9, True): 5, (10, True): 10, (11, True): 10, (11, False): 11}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (5, 5)], "a long, b long")
    out = {r.id: r.component for r in near_dedup.components(edges).collect()}
    assert out == {**{i: 0 for i in range(1, 41)}, 101: 100}
