import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.text import ALPHABET, SPLITS
from tokenloom.operators import bpe
from tokenloom.operators import vocabulary as V
from tokenloom.sources import readers as R
from tokenloom.sources import writers as W

DATA = "/root/testdata/sf0.001"


def schema(*names, kind=T.StringType()):
    return T.StructType([T.StructField(n, kind) for n in names])


def test_text_column():
    assert R.text_column(schema("a", "content", "text")) == "text" and R.text_column(schema("z", "code")) == "code" and R.text_column(schema("u", "v")) == "u"
    numbers = schema("n", kind=T.LongType())
    with pytest.raises(ValueError):
        R.text_column(numbers)
    assert R.text_column(numbers, lenient=True) == "n" and R.text_column(schema("a", "text"), "a") == "a"
    with pytest.raises(ValueError):
        R.text_column(schema("a"), "b")


def corpus(spark, base):
    spark.createDataFrame([("py",), (None,)], "content string").coalesce(1).write.parquet(f"{base}/starcoder/x")
    spark.createDataFrame([("w1", 1), ("w2", 2)], "text string, n int").coalesce(1).write.parquet(f"{base}/fineweb")


def test_corpus_folders(spark, tmp_path):
    base = str(tmp_path / "c")
    corpus(spark, base)
    rows = {(r.source, r.text) for r in R.read_corpus(spark, base).collect()}
    assert rows == {("starcoder", "py"), ("starcoder", None), ("fineweb", "w1"), ("fineweb", "w2")}
    assert {r.text for r in R.read_corpus(spark, base + "/fineweb").collect()} == {"w1", "w2"}
    assert R.read_sources(spark, base, ["fineweb"]).select("source").first().source == "fineweb"
    with pytest.raises(ValueError):
        R.read_sources(spark, base, ["fineweb"], {"fineweb": "nope"})
    for bad in (lambda: R.source_files(base, ["nothing"]), lambda: R.parquet_files(str(tmp_path / "none"))):
        with pytest.raises(FileNotFoundError):
            bad()
    assert R.first_shards(spark, base + "/fineweb", 1).count() >= 1
    with pytest.raises(ValueError):
        R.first_shards(spark, base, 0)


def test_json_and_samples(spark, tmp_path):
    docs = spark.createDataFrame([("é\n", "s"), (None, "s")], "text string, source string")
    W.save_jsonl(docs, str(tmp_path / "j"))
    assert [r.text for r in R.read_jsonl(spark, str(tmp_path / "j")).collect()] == ["é\n"] and R.read_jsonl(spark, str(tmp_path / "j"), 0).count() == 0
    W.save_sample(docs, str(tmp_path / "s"), {"target_rows": 2, "seed": 1})
    made = json.loads((tmp_path / "s" / "sampling_manifest.json").read_text())
    assert made["source_counts"] == {"s": 2} and made["seed"] == 1


def test_vocabulary_files(spark, tmp_path):
    counts = spark.createDataFrame([("Ġthe", 5), ("Ġa", 3)], "pretoken string, frequency long")
    vocabulary = V.frequent(counts, 258)
    W.save_hex_vocabulary(vocabulary, str(tmp_path / "v"))
    assert sorted(r.token for r in R.read_hex_vocabulary(spark, str(tmp_path / "v")).collect()) == sorted([*ALPHABET, "Ġthe", "Ġa"])
    specials = ["<|bos|>", "<|unk|>"]
    W.save_tokenizer(vocabulary, str(tmp_path / "t"), specials)
    ids = R.tokenizer_vocabulary(str(tmp_path / "t/tokenizer.json"))
    assert len(ids) == 260 and ids["<|bos|>"] == 0 and W.tokenizer_folders(str(tmp_path)) == [str(tmp_path / "t")]
    lib = pytest.importorskip("tokenizers")
    tok = lib.Tokenizer.from_file(str(tmp_path / "t/tokenizer.json"))
    for text in ("the a the", "日本 Ελλ العربية 😀", "def f(x):\n\treturn x  # y", "ab" * 200):
        assert tok.decode(tok.encode(text).ids) == text
    assert tok.encode("<|bos|>").ids == [0]
    lp = spark.createDataFrame([("a", 1.0, 10), ("b", 0.5, 20)], "token string, lp_value double, vocab_size int")
    W.save_vocabularies(lp, str(tmp_path / "raw"))
    assert {r.vocab_size for r in R.raw_vocabularies(spark, str(tmp_path / "raw")).collect()} == {10, 20}


def test_models(tmp_path):
    made = bpe.Picky([("Ġthe", 9), ("Ġthen", 4), ("é".encode().decode("latin-1"), 2)], tau=0.9)
    tokens = made.train(262)
    path = str(tmp_path / "m.model")
    W.save_model(path, "pickybpe", "|".join(SPLITS["nanochat"]), tokens, {"<|bos|>": len(tokens)}, made.events)
    back = R.read_model(path)
    assert back["vocab"] == {t: i for i, t in enumerate(tokens)} and back["specials"] == {"<|bos|>": len(tokens)}
    events = {i: ("merge", *p) for i, p in back["merges"].items()} | {i: ("delete", t, "") for i, t in back["deletions"].items()}
    assert [events[i] for i in sorted(events)] == made.events
    (tmp_path / "bad").write_text("what\n")
    with pytest.raises(ValueError):
        R.read_model(str(tmp_path / "bad"))


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a\tb", "x", 1, "r")], "pretoken string, decoded_form string, frequency long, reason string")
    W.save_unmatched(rows, str(tmp_path / "u.tsv"))
    assert (tmp_path / "u.tsv").read_text().splitlines()[0].split("\t") == rows.columns
    for _ in range(2):
        W.save_time(str(tmp_path / "t.csv"), solve=1.5, wall=2.0)
    assert len((tmp_path / "t.csv").read_text().splitlines()) == 3
    own = spark.createDataFrame([("x", "a"), ("y", "a")], "sample string, token string")
    assert W.save_overlap(str(tmp_path / "o"), V.jaccard_pairs(own), V.jaccard_by_length(own))["by_token_length"]["1"][0]["jaccard"] == 1.0
    text = W.comparison_markdown([{"name": "d1", "left_tokens": 1, "right_tokens": 2, "delta_percent": -50.0, "first_difference": 0, "left": ["ab"], "right": ["a", "b|"]}], ("LP", "BPE"))
    assert "| d1 | 1 | 2 | -50.00 % | 0 |" in text and "b\\|" in text
    W.save_histogram(own.groupBy("token").count(), str(tmp_path / "h"))


def test_tiny_corpus(spark):
    rows = R.tiny_corpus(spark, 300).collect()
    assert len(rows) == 300 and rows[0].text != rows[1].text and all("\n" in r.text and "\t" in r.text for r in rows)


def test_streaming_counts(spark, tmp_path):
    from tokenloom import streaming
    from tokenloom.operators.counting import pretoken_counts

    source = str(tmp_path / "in")
    parts = [spark.createDataFrame([(t,)], "text string") for t in ("a b a", "b c", "")]
    parts[0].write.mode("append").parquet(source)
    found = {}

    def write(batch, _):
        found.update({r.pretoken: r.frequency for r in batch.collect()})

    run = streaming.start(streaming.pretoken_stream(spark.readStream.schema("text string").parquet(source)), str(tmp_path / "ck"), write)
    try:
        run.processAllAvailable()
        for p in parts[1:]:
            p.write.mode("append").parquet(source)
            run.processAllAvailable()
    finally:
        run.stop()
    want = {r.pretoken: r.frequency for r in pretoken_counts(parts[0].union(parts[1]).union(parts[2])).collect()}
    assert found == want


def test_windowed_stream(spark, tmp_path):
    from tokenloom import streaming

    source = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'a b' AS text UNION ALL SELECT timestamp'2024-01-01 00:11:00', 'a'").write.parquet(source)
    rows = []
    stream = streaming.windowed_stream(spark.readStream.schema("ts timestamp, text string").parquet(source), "ts", "10 minutes", "1 minute")
    run = streaming.start(stream, str(tmp_path / "ck"), lambda b, _: rows.extend(b.select(F.col("window.start").cast("string").alias("s"), "pretoken", "frequency").collect()))
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    assert {tuple(r) for r in rows} == {("2024-01-01 00:00:00", "a", 1), ("2024-01-01 00:00:00", "Ġb", 1), ("2024-01-01 00:10:00", "a", 1)}


def test_imports_without_training_data(tmp_path):
    """Without the subpackage and the pipeline the entry still offers all other queries."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tokenloom"), tmp_path / "tokenloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pretoken_counts' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
