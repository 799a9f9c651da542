import json

import pytest

from tokenloom import cli
from tokenloom.sources import readers


def corpus(spark, tmp_path):
    base = str(tmp_path / "corpus")
    for source, text in (("alpha", "the cat sat on the mat and the hat"), ("beta", "then there were other lower words lowest")):
        spark.createDataFrame([(f"{text} {i % 3}",) for i in range(12)], "text string").write.mode("overwrite").parquet(f"{base}/{source}")
    return base


def test_commands(spark, tmp_path):
    base = corpus(spark, tmp_path)
    assert cli.main(["sample", "--base", base, "--sources", "alpha", "beta", "--rows", "5", "--out", str(tmp_path / "s")]) == 0
    assert json.loads((tmp_path / "s/sampling_manifest.json").read_text())["source_counts"] == {"alpha": 3, "beta": 2}
    assert cli.main(["sample", "--base", base, "--sources", "alpha", "--rows", "50", "--out", str(tmp_path / "s2")]) == 1
    assert cli.main(["frequent", "--corpus", base, "--size", "270", "--out", str(tmp_path / "f")]) == 0
    assert cli.main(["bpe", "--corpus", base, "--size", "280", "--out", str(tmp_path / "b")]) == 0
    assert len(readers.tokenizer_vocabulary(str(tmp_path / "b/bpe_280/tokenizer.json"))) == 280
    (tmp_path / "p").mkdir()
    assert cli.main(["picky", "--corpus", base, "--size", "280", "--out", str(tmp_path / "p")]) == 0
    assert len(readers.read_model(str(tmp_path / "p/picky_280.model"))["vocab"]) == 270
    assert cli.main(["lp", "--corpus", base, "--size", "275", "280", "--out", str(tmp_path / "v")]) == 0
    assert cli.main(["round", "--values", str(tmp_path / "v"), "--out", str(tmp_path / "r"), "--schemes", "det", "all_ones"]) == 0
    assert len(readers.tokenizer_vocabulary(str(tmp_path / "r/det_280/tokenizer.json"))) == 280
    with pytest.raises(ValueError):
        cli.main(["lp", "--corpus", base, "--size", "26", "280", "--out", str(tmp_path / "w")])


def test_vocab_size(tmp_path, capsys):
    p = tmp_path / "tokenizer.json"
    p.write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1}}}))
    assert cli.main(["vocab-size", str(p)]) == 0 and capsys.readouterr().out.strip() == "2"


def test_experiment_resumes(spark, tmp_path):
    from tokenloom.plans import experiment

    docs = spark.createDataFrame([(i, f"some words of text {i % 7} and then some other words") for i in range(40)], "doc_id long, text string")
    for _ in range(2):
        out = experiment.run(spark, docs, str(tmp_path), [270], 2, 25, rounds=100)
    assert set(out["270"]) == {"all_ones", "det", "bias", "prob", "bpe"} and out["270"]["det"]["pairs"][0]["jaccard"] > 0.5
    assert json.loads((tmp_path / "run_summary.json").read_text())["seconds"] == {}
