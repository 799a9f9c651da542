import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tests.llm.helpers import edge_docs, empty_docs, edge_rows, prose
from tokenloom.llm import line_dedup
from tokenloom.llm import line_dedup as L
from tokenloom.llm.line_dedup import CuckooFilter, LineIndex

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    owner = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)].add((d is not None, d or 0))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or len(owner[key(x)]) < 2 or min(owner[key(x)]) == (d is not None, d or 0)]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()], key=repr)


def test_against_brute_force(spark):
    shared = [prose(s, 8) for s in range(6)]
    rows = [(i, "\n".join([shared[i % 6].upper() if i % 2 else f"  {shared[i % 6]}\t", prose(100 + i, 9), shared[(i * 5) % 6], "short"])) for i in range(40)]
    rows += [(100, "éééééééééé\nx"), (101, "éééééééééé"), (102, "éééééé"), (103, "éééééé")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(line_dedup.line_dedup(df)) == brute(rows)


def test_edge_rows(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    out = line_dedup.line_dedup(edge_docs(spark))
    assert got(out) == brute(rows)
    assert out.schema["node"].dataType.simpleString() == "array<int>"
    assert line_dedup.line_dedup(empty_docs(spark)).count() == 0


def test_sql(spark, tmp_path):
    rows = [(i, f"line number {i % 3} here\nown {i}\n\nTail Of All  ") for i in range(12)] + [(20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = sorted(con.execute(line_dedup.ORACLE).fetchall())
    assert sorted(map(tuple, line_dedup.op5(spark, df).collect())) == want
    assert dict((r[0], r[3]) for r in want)[20] == hashlib.sha256(b"").hexdigest()


def test_insert_and_delete_are_reversible(spark):
    rows = [(i, f"shared line of {i % 4} texts\nonly in {i} alone") for i in range(12)]
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    index = LineIndex.build(make(rows[:6]), keys_per_shard=4)
    grown = index.insert(make(rows[6:]))
    assert got(grown.apply(make(rows))) == brute(rows)
    back = grown.delete(make(rows[:4]).select("doc_id"))
    assert got(back.apply(make(rows[4:]))) == brute(rows[4:])
    # deleted keys leave the filters, the others are always found
    keys = back.refs.select("hi", "lo").distinct()
    assert back.maybe_known(keys).count() == keys.count()
    gone = line_dedup.references(make(rows[:4])).join(keys, ["hi", "lo"], "left_anti")
    assert gone.count() > 0 and back.maybe_known(gone).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_cuckoo_filter(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    f = CuckooFilter(n)
    f.insert(np.unique(keys))
    assert f.contains(keys).all() if n else True
    other = np.random.default_rng(99).integers(0, 2**63, 5000).astype(np.uint64)
    assert f.contains(other).mean() < 0.01
    again = CuckooFilter(0, f.to_bytes())
    again.delete(np.unique(keys)[: n // 2])
    assert again.contains(np.unique(keys)[n // 2 :]).all() if n else True
    assert n < 100 or again.contains(np.unique(keys)[: n // 2]).mean() < 0.01


def test_full_filter_overflows():
    f = CuckooFilter(4)
    with pytest.raises(OverflowError):
        f.insert(np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def test_filters_too_large_to_send_and_hot_keys(spark, monkeypatch):
    """The other ways: no filter is broadcast, and owners of hot keys are."""
    rows = [(k, f"shared line of all {k % 3}\nown line number {k}\nshort") for k in range(60)] + [(None, "own line number 7\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(repr, L.line_dedup(df).collect()))
    assert sum(r.n_dropped for r in L.line_dedup(df).collect()) == 58
    monkeypatch.setattr(L, "HOT_REFS", 10)
    assert sorted(map(repr, L.line_dedup(df).collect())) == want
    monkeypatch.setattr(L, "MOST_FILTERS", -1)
    assert sorted(map(repr, L.line_dedup(df).collect())) == want


def test_null_ids_can_be_deleted_and_segments_are_joined(spark, monkeypatch):
    monkeypatch.setattr(L, "SEGMENTS", 2)
    rows = [(k, f"a line that is shared\nline number {k} alone") for k in range(4)]
    schema = "doc_id long, text string"
    docs = spark.createDataFrame(rows, schema)
    index = L.LineIndex.build(spark.createDataFrame([(None, rows[0][1])], schema)).insert(docs)
    assert sum(r.n_dropped for r in index.apply(docs).collect()) == 5
    index = index.delete(spark.createDataFrame([(None,), (1,)], "doc_id long"))
    left = docs.where("doc_id <> 1")
    assert sorted(map(repr, index.apply(left).collect())) == sorted(map(repr, L.line_dedup(left).collect()))
    index = index.insert(docs.where("doc_id = 1"))
    assert sorted(map(repr, index.apply(docs).collect())) == sorted(map(repr, L.line_dedup(docs).collect()))
