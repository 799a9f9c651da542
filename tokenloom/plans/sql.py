"""SQL that checks the queries, and the pieces it is made of."""

from __future__ import annotations

from tokenloom.functions.text import ALPHABET

#: White space as Unicode has it.
_W = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_MARK = r"\x01"
_SPACE = rf"(?:{_MARK} )?"
_TAIL = [rf"[{_W}]+", rf"{_MARK}[{_W}]"]
_NOT = rf"[^{_W}\pL\pN{_MARK}]+"
_U, _L = r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]", r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]"
_BEFORE = rf"{_MARK}?[^\r\n\pL\pN{_MARK}]?"

#: The split patterns without lookahead: the last white space before other text is marked instead.
_PATTERNS = {
    "nanochat": [r"\x27(?i:[sdmt]|ll|ve|re)", rf"{_BEFORE}\pL+", r"\pN{1,2}", rf"{_SPACE}{_NOT}[\r\n{_MARK}]*[\r\n]", rf"{_SPACE}{_NOT}", rf"[{_W}{_MARK}]*[\r\n]", *_TAIL],
    "apertus": [rf"{_BEFORE}{_U}*{_L}+", rf"{_BEFORE}{_U}+{_L}*", r"\pN", rf"{_SPACE}{_NOT}[\r\n/{_MARK}]*[\r\n/]", rf"{_SPACE}{_NOT}", rf"[{_W}{_MARK}]*[\r\n]", *_TAIL],
    "split_bytelevel": [r"\x27(?:s|t|re|ve|m|ll|d)", rf"{_SPACE}\pL+", rf"{_SPACE}\pN+", rf"{_SPACE}{_NOT}", *_TAIL],
}


def pieces(text: str, mode: str = "nanochat") -> str:
    marked = rf"regexp_replace({text}, '([{_W}])([^{_W}])', chr(1) || '\1\2', 'g')"
    return f"list_transform(regexp_extract_all({marked}, '{'|'.join(_PATTERNS[mode])}'), lambda p: replace(p, chr(1), ''))"


def byte_level(text: str) -> str:
    code = f"cast('0x' || substr(hex(encode({text})), 2*k+1, 2) AS int)"
    symbol = "chr(CASE WHEN b < 33 THEN 256 + b WHEN b BETWEEN 127 AND 160 THEN 289 + b - 127 WHEN b = 173 THEN 323 ELSE b END)"
    return f"array_to_string(list_transform(list_transform(range(0, strlen({text})), lambda k: {code}), lambda b: {symbol}), '')"


def counts(table: str = "documents", column: str = "text", mode: str = "nanochat", where: str = "true") -> str:
    """Common table expressions words and pretok (pretoken, frequency)."""
    return f"""words AS (SELECT unnest({pieces(column, mode)}) AS w FROM {table} WHERE {column} IS NOT NULL AND {where}),
distinct_words AS (SELECT w, count(*) AS frequency FROM words WHERE w <> '' GROUP BY w),
pretok AS (SELECT {byte_level('w')} AS pretoken, frequency FROM distinct_words)"""


CANDIDATES = """spans AS (SELECT pretoken, frequency, length(pretoken) AS n, unnest(range(2, length(pretoken) + 1)) AS k FROM pretok WHERE length(pretoken) >= 2),
occ AS (SELECT pretoken, frequency, k, unnest(range(0, n - k + 1)) AS s FROM spans),
occurrences AS (SELECT pretoken, frequency, s, s + k AS e, substr(pretoken, s + 1, k) AS token FROM occ),
candidates AS (SELECT token, sum(frequency)::BIGINT AS count FROM occurrences GROUP BY token HAVING sum(frequency) > 1)"""


def uniform(digest: str) -> str:
    return f"((('0x' || substr({digest}, 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def md5(seed: int, *keys: str) -> str:
    return "md5(" + " || ':' || ".join([f"'{seed}'", *(f"({k})::VARCHAR" for k in keys)]) + ")"


def quoted(values: list[str]) -> str:
    return ", ".join("('" + v.replace("'", "''") + "')" for v in values)


def numbered(values: list[str]) -> str:
    return ", ".join(f"({i}, '" + v.replace("'", "''") + "')" for i, v in enumerate(values))


ALPHABET_TABLE = f"alphabet(id, token) AS (VALUES {numbered(ALPHABET)})"
