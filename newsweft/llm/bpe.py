"""BPE encoding and decoding by dynamic programming over the prefixes of a word.

The encoding of a word is found from its prefixes: an Aho-Corasick automaton over the vocabulary lists the tokens
that end at each position, and a token can be the last of a prefix only if it is compatible with the last token
of what comes before it, that is, if the two side by side would not have been merged differently. Exactly one token
passes for each prefix. Following those tokens back from the end of the word gives the exact ids.

Compatibility of two tokens is decided by undoing their merges, latest first: at every step the
pieces that face each other must not be a merge of an earlier rank than the merges still to be undone.

Texts are normalised and cut into words as the tokenizer's file says (composed form, lower case, words and
marks); a word is a string over 512 symbols, the 256 bytes and the 256 bytes that end a word. Words are cached, up to
``CACHE`` of them. Special tokens in a text get their own id, as the library does it.

Decoding writes the tokens of the vocabulary with a space in between, as the library does for a file without a decoder.

Defined results: a null text is empty; an empty text has no ids and decodes to an empty text; null ids and
repeated rows pass through; other columns are ignored. A text is held whole by one task, and so are its ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsweft.llm.common import texts

CACHE = 300_000
NO_LIMIT = 1 << 60
WHITE = r"\t-\r \x85\xa0"
LETTERS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
# the words of texts within Latin-1, where letters, numbers and white space are few; others go through the library
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{WHITE}{LETTERS}{NUMBERS}]+")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixBpe:
    """Encoder and decoder for one tokenizer file."""

    _made: dict[str, PrefixBpe] = {}

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ending = model.get("end_of_word_suffix") or ""
        self.letters = _byte_letters()
        vocabulary = model["vocab"]
        self.names = {i: t for t, i in vocabulary.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            whole = vocabulary[left + right]
            a, b = vocabulary[left], vocabulary[right]
            self.merged[a, b] = rank
            if whole not in self.rank:
                self.rank[whole], self.halves[whole] = rank, (a, b)
        self.symbols: dict[int, str] = {}
        for token, i in vocabulary.items():
            word = self._symbols(token)
            if word is not None:
                self.symbols[i] = word
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i, word in self.symbols.items():
            if len(word) == 1 or (i in self.rank and self._stands(i)):
                self.automaton.add_word(word, (i, len(word)))
        self.automaton.make_automaton()
        self.words: dict[str, tuple[bytes, str]] = {}

    @classmethod
    def of(cls, path: str) -> PrefixBpe:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _symbols(self, token: str) -> str | None:
        ends = bool(self.ending) and token.endswith(self.ending) and len(token) > len(self.ending)
        body = token[: -len(self.ending)] if ends else token
        if not body or any(c not in self.letters for c in body):
            return None
        codes = [self.letters[c] for c in body]
        if ends:
            codes[-1] += 256
        return "".join(map(chr, codes))

    def _undone(self, left: int, right: int, limit: int) -> bool:
        """Whether ``left`` and ``right`` meet unmerged while merges below ``limit`` take place."""
        rank, halves, merged = self.rank, self.halves, self.merged
        while True:
            if merged.get((left, right), NO_LIMIT) < limit:
                return False
            of_left, of_right = rank.get(left, -1), rank.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                limit, left = of_left, halves[left][1]
            else:  # equal merges go from left to right, so the one on the right is undone first
                limit, right = of_right + 1, halves[right][0]

    def _stands(self, token: int) -> bool:
        """Whether a token's own symbols are encoded as that token."""
        left, right = self.halves[token]
        return self._undone(left, right, self.rank[token]) and all(t not in self.halves or self._stands(t) for t in (left, right))

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as symbols."""
        n = len(word)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        pairs = self.pairs
        for end, (token, length) in self.automaton.iter(word):
            at = end + 1
            if last[at] >= 0:
                continue
            start = at - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                pair = (before, token)
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self._undone(before, token, NO_LIMIT)
                if not fits:
                    continue
            last[at], size[at] = token, length
        ids, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError("a word holds a symbol that the vocabulary lacks")
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def _learn(self, word: str, data: bytes) -> tuple[bytes, str]:
        symbols = data.decode("latin-1")
        if self.ending:
            symbols = symbols[:-1] + chr(256 + data[-1])
        ids = self.encode_word(symbols)
        if len(self.pairs) > 4 * CACHE:
            self.pairs.clear()
        if len(self.words) >= CACHE:
            self.words.clear()
        found = self.words[word] = (np.array(ids, dtype="<i4").tobytes(), " ".join([self.names[i] for i in ids]))
        return found

    def _words(self, text: str) -> list[tuple[bytes, str]]:
        low = text.lower()
        try:
            low.encode("latin-1")
        except UnicodeEncodeError:
            normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
            out = []
            for mapped, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                data = bytes(self.letters[c] for c in mapped)
                word = data.decode("utf-8", "surrogateescape")
                out.append(self.words.get(word) or self._learn(word, data))
            return out
        words = self.words
        return [words.get(w) or self._learn(w, w.encode()) for w in LATIN.findall(low)]

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids of a text and the text that they decode to."""
        found: list[tuple[bytes, str]] = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                found.append((np.array([self.special[piece]], dtype="<i4").tobytes(), piece))
            elif piece:
                found.extend(self._words(piece))
        return np.frombuffer(b"".join([f[0] for f in found]), dtype="<i4"), " ".join([f[1] for f in found])

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.names[i] for i in ids if i in self.names])


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PrefixBpe.of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                coded = [bpe.encode(t) for t in some.column("text").to_pylist()]
                ends = np.cumsum([0, *[len(c[0]) for c in coded]])
                flat = np.concatenate([c[0] for c in coded]) if coded else np.zeros(0, dtype="<i4")
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), ids, pa.array([c[1] for c in coded], pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode_decode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids of every text and the text they decode to."""
    return texts(documents).mapInArrow(_encoder(path), "doc_id long, ids array<int>, decoded string")


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PrefixBpe.of(path)
        for batch in batches:
            text = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "decoded"])

    return run


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of rows with (doc_id, ids); a null list decodes to an empty text."""
    return coded.select("doc_id", "ids").mapInArrow(_decoder(path), "doc_id long, decoded string")
