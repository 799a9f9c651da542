"""Writers: samples with a manifest, vocabularies, tokenizer files, models, reports."""

from __future__ import annotations

import csv
import json
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import CHAR_BYTE, SPLITS, to_hex


def save_sample(sample: DataFrame, folder: str, manifest: dict) -> None:
    """Rows as Parquet, and what was drawn as sampling_manifest.json."""
    sample.write.mode("overwrite").parquet(f"{folder}/data")
    counts = {r[0]: r[1] for r in sample.groupBy("source").count().collect()} if "source" in sample.columns else {}
    spark = sample.sparkSession
    _dump(f"{folder}/sampling_manifest.json", {"source_counts": counts, "library_versions": {"spark": spark.version}} | manifest)


def _dump(path: str, value) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")


def save_vocabularies(lp: DataFrame, folder: str) -> None:
    """Fractional vocabularies, one partition a size; lp has the column vocab_size."""
    lp.write.mode("overwrite").partitionBy("vocab_size").parquet(folder)


def tokenizer_json(tokens: list[str], specials: list[str], mode: str = "nanochat") -> dict:
    """A Unigram tokenizer of equal scores over byte-level symbols: it encodes with as few tokens as it can."""
    plain = mode in ("split_bytelevel", "pythia", "gpt2")
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": plain}
    split = {"type": "Split", "pattern": {"Regex": "|".join(SPLITS[mode])}, "behavior": "Isolated", "invert": False}
    vocabulary = [*specials, *(t for t in tokens if t not in set(specials))]
    unknown = next((i for i, t in enumerate(vocabulary) if "unk" in t.lower() and t in specials), 0)
    return {
        "version": "1.0",
        "truncation": None,
        "padding": None,
        "added_tokens": [{"id": i, "content": s, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, s in enumerate(specials)],
        "normalizer": None,
        "pre_tokenizer": level if plain else {"type": "Sequence", "pretokenizers": [split, level]},
        "post_processor": None,
        "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
        "model": {"type": "Unigram", "unk_id": unknown, "vocab": [[t, -1.0] for t in vocabulary], "byte_fallback": False},
    }


def save_tokenizer(vocabulary: DataFrame, folder: str, specials: list[str], mode: str = "nanochat") -> None:
    """tokenizer.json and tokenizer_config.json; a vocabulary (id, token) is small by nature."""
    tokens = [r.token for r in vocabulary.orderBy("id").select("token").toLocalIterator()]
    _dump(f"{folder}/tokenizer.json", tokenizer_json(tokens, specials, mode))
    _dump(f"{folder}/tokenizer_config.json", {"tokenizer_class": "PreTrainedTokenizerFast", "bos_token": specials[0] if specials else None, "additional_special_tokens": specials})


def save_hex_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """One line of hex digits a token, in id order."""
    vocabulary.select("id", to_hex(F.col("token")).alias("h")).orderBy("id").select("h").coalesce(1).write.mode("overwrite").text(path)


def save_jsonl(docs: DataFrame, path: str) -> None:
    """Texts as JSON lines; letters stay as they are."""
    docs.select("text").where("text IS NOT NULL").write.mode("overwrite").json(path)


def save_model(path: str, kind: str, pattern: str, vocabulary: list[str], specials: dict[str, int], events: list[tuple[str, str, str]]) -> None:
    """A model text file; see ``readers.read_model``."""
    hexed = lambda t: bytes(CHAR_BYTE[c] for c in t).hex()
    merges = [(i, a, b) for i, (k, a, b) in enumerate(events) if k == "merge"]
    gone = [(i, a) for i, (k, a, _) in enumerate(events) if k == "delete"]
    lines = [f"{kind} v1", json.dumps(pattern), f"vocab {len(vocabulary)}", *(f"{hexed(t)} {i}" for i, t in enumerate(vocabulary)), f"specials {len(specials)}"]
    lines += [f"{json.dumps(s)} {i}" for s, i in specials.items()]
    lines += [f"merges {len(merges)}", *(f"{hexed(a)} {hexed(b)} {i}" for i, a, b in merges), f"deletions {len(gone)}", *(f"{hexed(a)} {i}" for i, a in gone)]
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")


def save_unmatched(report: DataFrame, path: str) -> None:
    """Tab-separated report in order; the file appears when it is complete."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, delimiter="\t", lineterminator="\n")
        out.writerow(report.columns)
        for row in report.toLocalIterator():
            out.writerow(list(row))
    os.replace(part, path)


def save_histogram(histogram: DataFrame, path: str) -> None:
    histogram.write.mode("overwrite").parquet(path)


def save_time(path: str, **seconds: float) -> None:
    """Append a line of timings."""
    new = not Path(path).exists()
    with open(path, "a", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        if new:
            out.writerow(["written", *seconds])
        out.writerow([int(time.time()), *(f"{s:.3f}" for s in seconds.values())])


def save_overlap(folder: str, pairs: DataFrame, by_length: DataFrame) -> dict:
    """results.json and results.txt of pairwise overlaps; rows are a few a pair of vocabularies."""
    rows = [r.asDict() for r in pairs.orderBy("sample_i", "sample_j").collect()]
    lengths: dict[str, list] = {}
    for r in by_length.orderBy("token_length", "sample_i", "sample_j").collect():
        lengths.setdefault(str(r.token_length), []).append({"sample_i": r.sample_i, "sample_j": r.sample_j, "jaccard": r.jaccard})
    result = {"pairs": rows, "by_token_length": lengths}
    _dump(f"{folder}/results.json", result)
    Path(folder, "results.txt").write_text("".join(f"{r['sample_i']}\t{r['sample_j']}\t{r['jaccard']:.6f}\n" for r in rows), encoding="utf-8")
    return result


def comparison_markdown(rows: list[dict], names: tuple[str, str], width: int = 36) -> str:
    """A report of compared tokenizations: a table of sizes, then tokens side by side."""
    cell = lambda t: "" if t is None else (t if len(t) <= width else t[: width - 3] + "...").replace("|", "\\|").replace("\n", "\\n")
    out = [f"# {names[0]} and {names[1]}", "", f"| document | {names[0]} | {names[1]} | change | first difference |", "|-|-|-|-|-|"]
    for r in rows:
        change = "" if r["delta_percent"] is None else f"{r['delta_percent']:+.2f} %"
        out.append(f"| {r['name']} | {r['left_tokens']} | {r['right_tokens']} | {change} | {'' if r['first_difference'] is None else r['first_difference']} |")
    for r in rows:
        out += ["", f"## {r['name']}", "", f"| # | {names[0]} | {names[1]} |", "|-|-|-|"]
        n = max(len(r["left"]), len(r["right"]))
        pick = lambda x, i: x[i] if i < len(x) else None
        out += [f"| {i} | {cell(pick(r['left'], i))} | {cell(pick(r['right'], i))} |" for i in range(n)]
    return "\n".join(out) + "\n"


def tokenizer_folders(root: str) -> list[str]:
    """Folders that hold a complete tokenizer (both files, valid JSON)."""
    found = []
    for p in sorted(Path(root).rglob("tokenizer.json")):
        other = p.with_name("tokenizer_config.json")
        try:
            if other.is_file() and isinstance(json.loads(p.read_text("utf-8")), dict) and isinstance(json.loads(other.read_text("utf-8")), dict):
                found.append(str(p.parent))
        except ValueError:
            continue
    return found
