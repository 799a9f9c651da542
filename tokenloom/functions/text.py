"""Text functions as Catalyst expressions: split patterns, byte-level symbols, substrings, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in set(_PLAIN)]
BYTE_CHAR = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(_OTHER)}
CHAR_BYTE = {c: b for b, c in BYTE_CHAR.items()}
ALPHABET = sorted(BYTE_CHAR.values())
_FROM, _TO = "".join(map(chr, _OTHER)), "".join(BYTE_CHAR[b] for b in _OTHER)

_LETTER, _NUMBER = r"\p{L}", r"\p{N}"
_LEAD = rf"[^\r\n{_LETTER}{_NUMBER}]"
_REST = rf"[^\s{_LETTER}{_NUMBER}]"
_UPPER, _LOWER = r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]", r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]"
_SPACES = [r"\s+(?!\S)", r"\s+"]
_SUFFIXES = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]

#: Alternatives of each split pattern, in order.
SPLITS: dict[str, list[str]] = {
    "nanochat": ["'(?i:[sdmt]|ll|ve|re)", rf"{_LEAD}?+{_LETTER}+", rf"{_NUMBER}{{1,2}}", rf" ?{_REST}++[\r\n]*", r"\s*[\r\n]", *_SPACES],
    "apertus": [rf"{_LEAD}?{_UPPER}*{_LOWER}+", rf"{_LEAD}?{_UPPER}+{_LOWER}*", _NUMBER, rf" ?{_REST}+[\r\n/]*", r"\s*[\r\n]+", *_SPACES],
    "split_bytelevel": [*_SUFFIXES, rf" ?{_LETTER}+", rf" ?{_NUMBER}+", rf" ?{_REST}+", *_SPACES],
    "gpt4": [r"'(?i:[sdmt]|ll|ve|re)", rf"{_LEAD}?+{_LETTER}+", rf"{_NUMBER}{{1,3}}", rf" ?{_REST}++[\r\n]*", r"\s*[\r\n]", *_SPACES],
    "gpt4o": [
        rf"{_LEAD}?{_UPPER}*{_LOWER}+(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        rf"{_LEAD}?{_UPPER}+{_LOWER}*(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        rf"{_NUMBER}{{1,3}}",
        rf" ?{_REST}+[\r\n/]*",
        r"\s*[\r\n]+",
        *_SPACES,
    ],
}
SPLITS["pythia"] = SPLITS["split_bytelevel"]
SPLITS["gpt2"] = SPLITS["split_bytelevel"]

GENERAL_SPECIALS = [f"[{name}]" for name in ("UNK", "EOS", "PAD", "CLS", "SEP", "MASK")]
CHAT_SPECIALS = ["<|bos|>", *(f"<|{who}_{edge}|>" for who in ("user", "assistant", "python", "output") for edge in ("start", "end")), "<|unk|>"]


def pattern(mode: str) -> str:
    """The Java pattern of a split mode, with Unicode classes."""
    if mode not in SPLITS:
        raise ValueError(f"unknown pretokenizer mode {mode!r}; one of {', '.join(SPLITS)}")
    return "(?U)" + "|".join(SPLITS[mode])


def special_tokens(mode: str) -> list[str]:
    """Special tokens of a mode, in id order."""
    if mode not in SPLITS:
        raise ValueError(f"no special tokens for mode {mode!r}; one of {', '.join(SPLITS)}")
    return CHAT_SPECIALS if mode == "nanochat" else GENERAL_SPECIALS


def split(text: Column | str, mode: str = "nanochat") -> Column:
    """Array of the pieces that the mode's pattern isolates; they join to the text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(text, F.lit(pattern(mode)), F.lit(0))


def byte_level(text: Column) -> Column:
    """Every UTF-8 byte as one printable character."""
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), _FROM, _TO)


def _raw(text: Column) -> Column:
    """Byte-level characters back to code points 0 to 255. ``translate`` would delete for a 0, so that goes apart."""
    return F.replace(F.translate(text, _TO[1:], _FROM[1:]), F.lit(_TO[0]), F.lit("\0"))


def from_byte_level(text: Column) -> Column:
    """Inverse of ``byte_level``."""
    return F.decode(F.encode(_raw(text), "ISO-8859-1"), "UTF-8")


def to_hex(token: Column) -> Column:
    """Byte-level token as lower-case hex of its bytes."""
    return F.lower(F.hex(F.encode(_raw(token), "ISO-8859-1")))


def from_hex(value: Column) -> Column:
    return F.translate(F.decode(F.unhex(value), "ISO-8859-1"), _FROM, _TO)


def substrings(token: Column, least: int = 2, most: int | None = None) -> Column:
    """Array of (start, end, token) of all substrings of ``least`` to ``most`` characters, by length and start."""
    n = F.length(token)
    top = n if most is None else F.least(n, F.lit(most))
    one = lambda k: F.transform(F.sequence(F.lit(0), n - k), lambda s: F.struct(s.alias("start"), (s + k).alias("end"), F.substring(token, s + 1, k).alias("token")))
    made = F.flatten(F.transform(F.sequence(F.lit(least), top), one))
    return F.when(top >= least, made).otherwise(F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("token"))), 1, 0))


def has_text(text: Column) -> Column:
    """Not null and not all white space (the separators U+001C to U+001F count as white space too)."""
    return F.coalesce(text.rlike("(?U)[^\\s\\x1c-\\x1f]"), F.lit(False))


def first_difference(left: Column, right: Column) -> Column:
    """Index of the first element in which two arrays differ or one has ended; null if they are equal."""
    zipped = F.arrays_zip(left.alias("l"), right.alias("r"))
    at = F.array_position(F.transform(zipped, lambda p: p["l"].eqNullSafe(p["r"])), F.lit(False))
    return F.when(at > 0, (at - 1).cast("int"))


def truncate(text: Column, width: int) -> Column:
    """At most ``width`` characters; longer texts end in three dots."""
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - 3), F.lit("...")))


def preview(text: Column, width: int = 80) -> Column:
    """The first characters on one line."""
    return F.replace(F.substring(text, 1, width), F.lit("\n"), F.lit("\\n"))


def all_digits(token: Column) -> Column:
    return token.rlike("^[0-9]*$")


def can_supermerge(token: Column) -> Column:
    """Byte-level tokens of spaces, underscores, apostrophes and ASCII letters only."""
    return token.rlike("^[Ġ_'A-Za-z]*$")


def could_merge(token: Column) -> Column:
    """What a merge across words may join: those characters with a letter among them; a line feed may end it."""
    return token.rlike("^[Ġ_'A-Za-z]*[A-Za-z][Ġ_'A-Za-z]*Ċ?$")


def can_merge(left: Column, right: Column, across: bool) -> Column:
    """Whether two tokens may be joined: any inside words, across words only if each could."""
    return could_merge(left) & could_merge(right) if across else F.lit(True)


def deep_morphemes(structure: Column) -> Column:
    """Leaves of a bracketed morphological structure: class labels and brackets go, commas split."""
    flat = F.regexp_replace(F.regexp_replace(structure, r"\[[^\]]*\]", ""), "[()]", "")
    return F.filter(F.split(flat, ","), lambda x: x != "")


def endpoint_penalty(position: Column, spans: Column) -> Column:
    """How far a cut lies inside a morpheme, 0 to 1; spans are disjoint structs (left, right)."""
    inside = F.transform(
        spans,
        lambda s: F.when((position > s["left"]) & (position < s["right"]), 2.0 * F.least(position - s["left"], s["right"] - position) / (s["right"] - s["left"])).otherwise(0.0),
    )
    return F.coalesce(F.array_max(inside), F.lit(0.0))


def edge_penalty(start: Column, end: Column, analyses: Column) -> Column:
    """Least sum of both ends' penalties over the analyses (arrays of spans); 0 without any."""
    return F.coalesce(F.array_min(F.transform(analyses, lambda a: endpoint_penalty(start, a) + endpoint_penalty(end, a))), F.lit(0.0))
