"""BPE encoding by a deterministic tokenization automaton, and decoding by its arc labels.

The merges of a vocabulary are compiled one by one into an automaton over tokens that accepts exactly the
token sequences BPE makes (Berglund, Martens and van der Merwe, "Constructing a BPE Tokenization DFA",
2024). At first one state loops on all symbols. The gadget of a merge (u, v) -> w copies the state t that u
leads to, takes v's arc from the copy, redirects u's arcs to the copy, and gives every state that has u's
arc an arc w to where v led from t.

Two facts keep the tables small. All arcs of one token lead to the same state, so a token's target is one
number. And a copy differs from its original by one arc, so a state is stored as (original, arc taken away,
time), and the copies made for one token form a chain; an arc w belongs to a state, as of its merge, just
if u's arc does. ``arc`` resolves that once for a state and a token and keeps the answer in the transition
table, so encoding is table-driven.

A pre-split word has one accepted path; it is found by following arcs whose labels spell the word, longest
first, with dead ends remembered. Words, and chunks between spaces, are encoded once and then looked up.

Pre-splitting follows the vocabulary file: special tokens are cut out of the raw text, then NFC, lower case,
and runs matching the split pattern; the last symbol of a word carries the end-of-word suffix. Decoding
joins arc labels with a space, as the file names no decoder.

Null or empty text: no tokens. Null doc_ids and repeated rows are encoded like any other row; an empty
table gives an empty result. Extra columns stay, except that one with the name of a result column is
replaced.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm._common import blocks, documents, plus, without

WORDS_KEPT = 250_000
ARCS_KEPT = 500_000
LITTLE = sys.byteorder == "little"


class Automaton:
    """Deterministic automaton of a BPE vocabulary; states are numbers, arcs are token ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        n = max(vocab.values(), default=-1) + 1
        self.label = [""] * n
        for token, i in vocab.items():
            self.label[i] = token
        self.left = [-1] * n  # u of the merge that makes the token; -1: a symbol
        self.born = [-1] * n  # time of that merge
        self.alive = [True] * n
        # state 0 loops on everything; a chain holds the copies made one of the other for one token
        self.target = [0] * n
        self.chain, self.place = [-1], [-1]  # of each state
        self.above: list[int] = []  # of each chain: the state its first copy is made of
        self.times: list[list[int]] = []  # of each chain: when its states were made
        self.states: list[list[int]] = []
        self.removed: list[dict[int, int]] = []  # of each chain: arc taken away -> place in the chain
        self.own: dict[int, int] = {}  # token -> its chain
        self.table: dict[int, bool] = {}
        self.width = n
        for a, b in merges:
            self.alive[vocab[a + b]] = False  # until its merge takes place
        for time, (a, b) in enumerate(merges):
            self._gadget(time, vocab[a], vocab[b], vocab[a + b])
        self.longest = max(map(len, vocab), default=0)
        self.table.clear()

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        if not (self.alive[u] and self.alive[v]) or self.alive[w]:
            return
        t, after = self.target[u], self.target[v]
        if not self._resolve(t, v):
            return
        c = self.own.get(u)
        if c is None:
            c = self.own[u] = len(self.above)
            self.above.append(t), self.times.append([]), self.states.append([]), self.removed.append({})
        copy = len(self.chain)
        self.chain.append(c), self.place.append(len(self.times[c]))
        self.removed[c][v] = len(self.times[c])
        self.times[c].append(time), self.states[c].append(copy)
        self.target[u] = copy
        self.left[w], self.born[w], self.alive[w], self.target[w] = u, time, True, after

    def arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc for ``token``."""
        key = state * self.width + token
        known = self.table.get(key)
        if known is None:
            known = self.table[key] = self._resolve(state, token)
        return known

    def _resolve(self, s: int, y: int) -> bool:
        if not self.alive[y]:
            return False
        while s:
            c, at = self.chain[s], self.place[s]
            gone = self.removed[c].get(y)
            if gone is not None and gone <= at:
                return False
            # back to the state that was there when y's arcs were added; it has one if it has u's
            then = bisect_right(self.times[c], self.born[y], 0, at + 1) - 1
            if then < 0:
                s = self.above[c]
            else:
                s, y = self.states[c][then], self.left[y]
        return True

    def spell(self, suffix: str) -> None:
        """Prepare ``encode`` for words whose last symbol carries ``suffix``."""
        self.inner = {t: i for t, i in self.vocab.items() if not suffix or not t.endswith(suffix)}
        self.final = {t[: len(t) - len(suffix)]: i for t, i in self.vocab.items() if t.endswith(suffix)}
        self.reach: dict[str, int] = {}  # longest token that starts with three symbols
        for t in self.inner:
            self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 2))

    def encode(self, symbols: str) -> list[int]:
        """Token ids of the one accepted path that spells ``symbols``."""
        n, inner, final, table, target, width, reach = len(symbols), self.inner, self.final, self.table, self.target, self.width, self.reach
        path: list[int] = []
        back: list[tuple[int, int, int]] = []
        dead: set[tuple[int, int]] = set()
        at, state, end, longest = 0, 0, n, self.longest
        while at < n:
            if end > at:
                if end == n:
                    token = final.get(symbols[at:]) if n - at <= longest else None
                    end = min(n - 1, at + reach.get(symbols[at : at + 3], 2))
                    after = n
                else:
                    token = inner.get(symbols[at:end])
                    after = end
                    end -= 1
                if token is None:
                    continue
                known = table.get(state * width + token)
                if known or (known is None and self.arc(state, token)):
                    then = target[token]
                    if dead and (after, then) in dead:
                        continue
                    path.append(token)
                    back.append((at, state, end))
                    at, state, end = after, then, n
            else:
                dead.add((at, state))
                if not back:
                    raise ValueError(f"no path spells {symbols!r}")
                at, state, end = back.pop()
                path.pop()
        return path


def _young() -> list[tuple[int, int]]:
    """Ranges of code points that Unicode 3.2 doesn't assign."""
    category = unicodedata.ucd_3_2_0.category
    ranges: list[tuple[int, int]] = []
    for c in range(0x80, 0x110000):
        if category(chr(c)) == "Cn":
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1] = (ranges[-1][0], c)
            else:
                ranges.append((c, c))
    return ranges


class Tokenizer:
    """Pre-splitting, encoding and decoding as a ``tokenizers`` BPE file with word ends describes them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or not split["invert"] or level["use_regex"] or spec["decoder"] or model["continuing_subword_prefix"]:
            raise ValueError(f"{path} is not a lower-case BPE vocabulary with word ends")
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        self.automaton.spell(self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = dict(enumerate(self.automaton.label)) | {i: s for s, i in self.special.items()}
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.cutter = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        self.symbol = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.byte = {c: b for b, c in self.symbol.items()}
        self.words: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.older_chunks: dict[str, tuple[bytes, str]] = {}
        self.rare = regex.compile("[" + "".join(f"{regex.escape(chr(a))}-{regex.escape(chr(b))}" for a, b in _young()) + "]")
        self.path = path
        self.library = None

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if not text.isascii():
            if self.rare.search(text):
                return self._split_by_library(text)
            text = unicodedata.normalize("NFC", text)
            # lower case is taken letter by letter: a final sigma is no exception
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        return self.pattern.findall(text)

    def _split_by_library(self, text: str) -> list[str]:
        """For texts with letters younger than Unicode 3.2, whose class depends on a library's version."""
        if self.library is None:
            from tokenizers import Tokenizer as Library

            self.library = Library.from_file(self.path)
        made = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, w)).decode() for w, _ in made]

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids of a word (32 bits each) and their labels, joined."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= WORDS_KEPT:
                self.words, self.older = {}, self.words
            found = self.older.get(word)
            if found is None:
                if len(self.automaton.table) > ARCS_KEPT:
                    self.automaton.table.clear()
                ids = self.automaton.encode(word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.symbol))
                found = (array("I", ids).tobytes(), " ".join([self.automaton.label[i] for i in ids]))
            self.words[word] = found
        return found

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """The same for a chunk between spaces. Of both, a generation is dropped when the next one is full."""
        if len(self.chunks) >= 2 * WORDS_KEPT:
            self.chunks, self.older_chunks = {}, self.chunks
        found = self.older_chunks.get(chunk)
        if found is None:
            small = chunk.lower()
            if max(chunk) > "\u0220":
                words = self.split(chunk)
            elif small.isalpha():
                words = [small]
            elif small[-1] in ".,!?;:" and small[:-1].isalpha():
                words = [small[:-1], small[-1]]
            else:
                words = self.split(chunk)
            if len(words) == 1:
                found = self.word(words[0])
            else:
                parts = [self.word(w) for w in words]
                found = (b"".join([ids for ids, _ in parts]), " ".join([label for _, label in parts]))
        self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a text (32 bits each), and the text that decoding them gives."""
        cuts = [*self.cutter.finditer(text)] if self.cutter and "<|" in text else []
        found: list[tuple[bytes, str]] = []
        at = 0
        for cut in [*cuts, None]:
            part = text[at : cut.start() if cut else None] if cuts else text
            # no word has white space inside, and a space composes with nothing
            get, miss = self.chunks.get, self.chunk
            for c in part.replace("\n", " ").split(" "):
                if c:
                    f = get(c)
                    if f is None:
                        f = miss(c)
                        get = self.chunks.get
                    found.append(f)
            if cut:
                found.append((array("I", [self.special[cut.group()]]).tobytes(), cut.group()))
                at = cut.end()
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[0]])

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)


_loaded: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """``docs`` plus ids (array) and decoded; with ``digest``: plus n_tokens, ids_sha256, decoded_sha256."""
    more = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digest else ["ids array<int>", "decoded string"]
    docs = without(docs, ", ".join(more))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in blocks(batches):
            first, second, third = [], [], []
            for text in batch.column(at).to_pylist():
                ids, decoded = tokenizer.encode(text or "")
                if digest:
                    first.append(len(ids) // 4)
                    second.append(hashlib.sha256(ids if LITTLE else np.frombuffer(ids, np.uint32).astype("<u4").tobytes()).hexdigest())
                    third.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    first.append(np.frombuffer(ids, np.uint32).astype(np.int32))
                    second.append(decoded)
            made = [pa.array(first, pa.int64()), pa.array(second, pa.string()), pa.array(third, pa.string())] if digest else [pa.array(first, pa.list_(pa.int32())), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(m.split()[0] for m in more)])

    return docs.mapInArrow(run, plus(docs, ", ".join(more)))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` plus decoded, from their column ids (array<int>); null ids give null."""
    rows = without(rows, "decoded string")
    at = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = load(path).names
        for batch in batches:
            text = [None if ids is None else " ".join(names[i] for i in ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, plus(rows, "decoded string"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True).select("doc_id", "n_tokens", "ids_sha256", F.col("decoded_sha256"))
