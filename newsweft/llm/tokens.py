"""Token ids of whole texts as by the tokenizers library.

A byte-level file whose tokens are numbered in the order of their merges is read as merge ranks, and texts of Latin letters and
ASCII signs (the two libraries' character classes agree there) are encoded by tiktoken from these ranks.  Merging the lowest rank
first gives the ids of the merge list: two neighbours that together are a token are the two halves of its merge, because
no token crosses their outer ends.  Other texts and files go through the library, with a bounded cache of pieces:

a text is cut in front of each white space that follows something else.  The library's own
pre-tokenizer always has a boundary there, and no token crosses one, so the ids of a text are
the ids of its pieces put together; each distinct piece is encoded once per worker until the cache
is full and starts anew.  Texts that hold a special token are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

CACHE = 1_500_000
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
ODD = re.compile(f" [{SPACE}]|[{SPACE}] ")
LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
BLANK_WORD = re.compile(f" ?[{LETTERS}]+")
ENDED = re.compile(f"( ?[{LETTERS}]+)([.,]?)(\\n?)((?<=\\n)[{LETTERS}]+)?((?<=[{LETTERS}])[.,])?")
LATIN = re.compile("[\\0-\u024f]*")
LONG = 50_000  # beyond this, white space runs are looked at: the direct expression steps back through a run, on a bounded stack
BLANKS = re.compile(f"[{SPACE}]{{{LONG}}}")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value of byte-level pre-tokenizers
# the printable letter that stands for each byte in a byte-level vocabulary
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class _Pieces(dict):
    """Ids of pieces, as bytes; a piece that is not there yet is encoded.

    A word of letters, with a blank in front or not, is one unit for a byte-level pre-tokenizer, so the
    model takes it directly; the full stop, comma or line end behind it is a token of its own.
    """

    def __init__(self, tokenizer, code: str, plain_words: bool):
        self.tokenizer, self.model, self.code, self.plain_words = tokenizer, tokenizer.model, code, plain_words

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = None
        if self.plain_words:
            if piece.isalpha() and piece.isascii() or BLANK_WORD.fullmatch(piece):
                letters = piece.replace(" ", "\u0120") if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
            elif found := ENDED.fullmatch(piece):
                ids = b"".join([self[x] for x in found.groups() if x])
        self[piece] = ids = self.whole(piece) if ids is None else ids
        return ids


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each token with its id, if the ids say which merge comes first; otherwise None."""
    model = spec["model"]
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or any(model.get(option) for option in odd):
        return None
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(b <= a for a, b in zip(merged, merged[1:])):
        return None
    letters = {c: b for b, c in BYTE_LETTERS.items()}
    made = set(merged)
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if i in made or len(token) == 1 and token in letters}
    return ranks if len(ranks) == len(made) + 256 and max(ranks[bytes([b])] for b in range(256)) < min(merged, default=1 << 60) else None


class PieceEncoder:
    """Encodes texts to little-endian unsigned integers, of two bytes if the vocabulary allows."""

    _made: dict[tuple[str, int], PieceEncoder] = {}

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"] or {}
        # such a file has no other step between a word and its model
        plain_words = bool(spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"))
        ranks = merge_ranks(spec) if plain_words else None
        self.direct = None
        if ranks:
            import tiktoken

            self.direct = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.limit = cache
        self.pieces = _Pieces(self.tokenizer, "H" if self.dtype == "<u2" else "I", plain_words)

    @classmethod
    def of(cls, path: str, cache: int = CACHE) -> PieceEncoder:
        """One encoder for each worker process."""
        if (path, cache) not in cls._made:
            cls._made[path, cache] = cls(path, cache)
        return cls._made[path, cache]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens added; the text's pieces are held at once."""
        pieces = self.pieces
        if any(s in text for s in self.special):
            return np.frombuffer(pieces.whole(text), dtype=self.dtype)
        if self.direct and (text.isascii() or LATIN.fullmatch(text)) and not (len(text) > LONG and BLANKS.search(text)):
            return np.frombuffer(array(pieces.code, self.direct(text)), dtype=self.dtype)
        if len(pieces) > self.limit:
            pieces.clear()
        if not text:
            return np.zeros(0, dtype=self.dtype)
        cut = None
        if "\0" not in text and "  " not in text and " \n" not in text and "\n " not in text:
            if text.replace("\n", "").isprintable() or not ODD.search(text):
                cut = text.replace(" ", "\0 ").split("\0")
        return np.frombuffer(b"".join(map(pieces.__getitem__, cut or PIECE.findall(text))), dtype=self.dtype)
