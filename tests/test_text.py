import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.functions import morphology as M
from tokenloom.functions import text as T

regex = pytest.importorskip("regex")

EDGES = ["a  b　c\x85d\x1ce​f", "ſ's 'S don'T WE'LL", "x\r\ny\n\n  z \t", "日本語 漢字かな", "😀👍🏽 ok", "½² 12345 x1y2", "", " ", "Σίσυφος ΣΑΣ", "snake_case(x) = {1: 'a'};", "e\u0301e" * 3, "a\0b"]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


@pytest.mark.parametrize("mode", ["nanochat", "apertus", "split_bytelevel", "gpt4", "gpt4o"])
def test_split_agrees_with_regex(spark, mode):
    pattern = regex.compile("|".join(T.SPLITS[mode]))
    for r in rows(spark, EDGES).select("text", T.split("text", mode).alias("p")).collect():
        assert r.p == pattern.findall(r.text) and "".join(r.p) == r.text


def test_split_agrees_with_library(spark):
    lib = pytest.importorskip("tokenizers")
    for mode, level in (("nanochat", False), ("apertus", False), ("split_bytelevel", True)):
        bytes_ = lib.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=level)
        made = bytes_ if level else lib.pre_tokenizers.Sequence([lib.pre_tokenizers.Split(lib.Regex("|".join(T.SPLITS[mode])), "isolated"), bytes_])
        for r in rows(spark, EDGES).select("text", F.transform(T.split("text", mode), T.byte_level).alias("p")).collect():
            assert r.p == [p for p, _ in made.pre_tokenize_str(r.text)]


def test_modes():
    assert len(T.special_tokens("nanochat")) == 10 and len(T.special_tokens("apertus")) == 6
    for f in (T.pattern, T.special_tokens):
        with pytest.raises(ValueError):
            f("custom")
    assert len(T.ALPHABET) == 256 and T.ALPHABET == sorted(T.ALPHABET)


def test_byte_level_round_trip(spark):
    out = rows(spark, EDGES).select("text", T.byte_level(F.col("text")).alias("b")).withColumn("back", T.from_byte_level(F.col("b"))).withColumn("hex", T.to_hex(F.col("b"))).withColumn("again", T.from_hex(F.col("hex"))).collect()
    for r in out:
        assert r.back == r.text and r.again == r.b and r.hex == r.text.encode().hex()
        assert r.b == "".join(T.BYTE_CHAR[x] for x in r.text.encode())


@pytest.mark.parametrize("least, most", [(2, None), (1, 3), (2, 2), (4, 2)])
def test_substrings(spark, least, most):
    for r in rows(spark, ["", "a", "ab", "abcde", "aaaa"]).select("text", T.substrings(F.col("text"), least, most).alias("s")).collect():
        n = len(r.text)
        want = [(i, i + k, r.text[i : i + k]) for k in range(least, min(n, most or n) + 1) for i in range(n - k + 1)]
        assert [tuple(x) for x in r.s] == want


def test_has_text(spark):
    texts = [None, "", " \t\n", "\x1c\x1f", "　\x85", "a", " .", "​"]
    out = [r.h for r in rows(spark, texts).orderBy("i").select(T.has_text(F.col("text")).alias("h")).collect()]
    assert out == [bool(t and t.strip()) for t in texts]


def test_rendering(spark):
    df = rows(spark, ["short", "x" * 50, "a\nb" * 40])
    assert [r.t for r in df.orderBy("i").select(T.truncate(F.col("text"), 10).alias("t")).collect()] == ["short", "x" * 7 + "...", "a\nba\nba..."]
    assert df.where("i = 2").select(T.preview(F.col("text")).alias("p")).first().p == ("a\nb" * 40)[:80].replace("\n", "\\n")


@pytest.mark.parametrize("a, b, want", [([1, 2], [1, 2], None), ([1, 2], [1, 3], 1), ([1], [1, 2], 1), ([], [], None), ([], [1], 0)])
def test_first_difference(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    assert df.select(T.first_difference(F.col("a"), F.col("b")).alias("d")).first().d == want


def test_morphemes_and_penalties(spark):
    df = spark.createDataFrame([("((un)[A|.N],(happy)[A])[A]",), ("",), ("(a)[X],(),(b)",)], "s string")
    assert [r.m for r in df.select(T.deep_morphemes(F.col("s")).alias("m")).collect()] == [["un", "happy"], [], ["a", "b"]]
    assert [M.leaves(s) for s in ("((un)[A|.N],(happy)[A])[A]", "", "(a)[X],(),(b)")] == [["un", "happy"], [], ["a", "b"]]
    spans = spark.createDataFrame([([[(0, 4), (4, 6)], [(0, 6)]],), ([],)], "a array<array<struct<left:int,right:int>>>")
    penalty = lambda s, e: [r.p for r in spans.select(T.edge_penalty(F.lit(s), F.lit(e), F.col("a")).alias("p")).collect()]
    assert penalty(0, 4) == [0.0, 0.0] and penalty(2, 4) == [pytest.approx(1.0), 0.0] and penalty(2, 5) == [pytest.approx(1.0), 0.0]


def test_levenshtein_rows():
    assert M.prefix_costs("abc", "abd") == [3, 2, 1, 1] and M.prefix_costs("", "ab") == [0, 1, 2]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_prefix_costs_property(a, b):
    def slow(x, y):
        return max(len(x), len(y)) if not x or not y else min(slow(x[1:], y) + 1, slow(x, y[1:]) + 1, slow(x[1:], y[1:]) + (x[0] != y[0]))

    if len(a) < 5 and len(b) < 5:
        assert M.prefix_costs(a, b) == [slow(a, b[:k]) for k in range(len(b) + 1)]


def test_projection_and_inflection():
    assert M.project("happyness", (5,), "happiness") == (5,)
    assert M.project("ab", (1,), "x") is None and M.project("ab", (1,), "ab") == (1,) and M.project("ab", (), "zz") == ()
    assert M.lemma_cuts("unhappy", "((un)[A],(happy)[A])[A]") == (2,) and M.lemma_cuts("x", "") == () and M.lemma_cuts("x", "()") is None
    assert M.inflect("bake", "@-e+ing") == ("baking", 3) and M.inflect("dog", "@+@s") == ("dog's", 3)
    assert M.inflect("dog", "IRR") is None and M.inflect("dog", "@-x+s") is None and M.inflect("dog", "@") == ("dog", None)
    for bad in (-1, math.inf, math.nan):
        with pytest.raises(ValueError):
            M.check_rho(bad)


LEMMAS = [["1", "unhappy", *[""] * 19, "((un)[A],(happy)[A])[A]"], ["2", "bake", *[""] * 19, "(bake)[V]"], ["3", "go", *[""] * 19, ""], ["9"]]
FORMS = [["1", "baking", "0", "2", "", "@-e+ing"], ["2", "went", "0", "3", "", "IRR"], ["3", "Unhappier", "0", "1", "", "@-y+ier"], ["4", "qqq", "0", "2", "", "@+z"], ["5"]]


def test_lexicon(spark):
    lex = M.Lexicon().add(LEMMAS, FORMS)
    assert lex.match("unhappy")[1:] == ("exact_celex_match", [[(0, 2), (2, 7)]])
    assert lex.match("Ġbaking")[1:] == ("exact_celex_match", [[(1, 4), (4, 7)]])
    assert lex.match("UNHAPPY")[1] == "casefold_celex_match" and lex.match("qqq")[1] == "boundary_projection_failure"
    assert lex.match("zzz")[1] == "no_celex_entry" and lex.match("Ã")[1] == "decode_failure" and lex.match("Ġ")[1] == "unsupported_nonlexical_form"
    counts = spark.createDataFrame([("Ġbaking", 3), ("zzz", 2), ("Ã", 1)], "pretoken string, frequency long")
    made = M.annotate(counts, lex)
    assert {r.reason: (r.types, r.occurrences) for r in M.diagnostics(made).collect()} == {"exact_celex_match": (1, 3), "no_celex_entry": (1, 2), "decode_failure": (1, 1)}
    assert [r.pretoken for r in M.unmatched_report(made).collect()] == ["zzz", "Ã"]


def test_lexicon_files(tmp_path):
    p = tmp_path / "eml.cd"
    p.write_text("1\\abide\\x\n2\\\"q\"\"t\"\\y\n", "ascii")
    assert M.read_fields(str(p)) == [["1", "abide", "x"], ["2", 'q"t', "y"]]


def test_merges_across_words(spark):
    # as bytes: only spaces, underscores, apostrophes and letters; a merge needs a letter on both sides
    cases = {"a1": (False, False), "Ġthe": (True, True), "don't": (True, True), "Ġ": (True, False), "_'": (True, False), "abĊ": (False, True), "": (True, False), "Ã©": (False, False)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    rows = df.select("t", T.can_supermerge(F.col("t")), T.could_merge(F.col("t")), T.can_merge(F.col("t"), F.lit("Ġx"), True), T.can_merge(F.col("t"), F.lit("1"), False)).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == cases
    assert all(r[3] == r[2] and r[4] for r in rows)
