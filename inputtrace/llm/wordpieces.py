"""A word-level view of a BPE tokenizer file: texts fall into words that are encoded on their own.

The vocabulary file stays where it is; its path is a parameter. It must have the shape checked in
`Vocabulary`: composed, blank-collapsed, lower-cased text, split by a pattern, bytes as symbols,
and a mark on the last symbol of a word.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import cache
from itertools import compress, repeat
from operator import is_

import numpy as np
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

# Characters that composition leaves alone and on which this language's lower case, white space,
# letters and digits agree with the tokenizer's.
PLAIN = re.compile("[\t-\r -~\xa1-\xff]*")
PLAIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"  # fixed by the file format
STOPS = frozenset(",.;:!?)")  # what most often ends a word and is then a piece
MEMO = 80_000  # words that a worker remembers at least; it holds twice as many at most


@cache
def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + odd.index(b)) for b in range(256)]


@cache
def _symbol_table() -> dict[int, str]:
    return dict(enumerate(byte_symbols()))


def as_symbols(piece: str) -> str:
    """The piece's bytes, each as its symbol; those of printing ASCII are the characters."""
    if piece.isascii() and piece.isprintable():
        return piece
    return piece.encode().decode("latin-1").translate(_symbol_table())


class Vocabulary:
    """What the file says, and the pieces of texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, split = told["model"], told["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in told["normalizer"]["normalizers"]]
        if (
            model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or told["decoder"] is not None
            or split[0]["pattern"]["Regex"] != PATTERN or split[1]["type"] != "ByteLevel"
            or told["post_processor"] is not None or any(model[k] for k in ("dropout", "unk_token", "ignore_merges"))
        ):
            raise ValueError(f"{path} is not a word-level BPE file of the expected shape")
        self.path, self.suffix = path, model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.size = max(*self.ids.values(), *self.special.values()) + 1
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._split = Split(Regex(PATTERN), "removed", invert=True)
        self._special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")

    def names(self) -> list[str]:
        """The string of each id."""
        found = [""] * self.size
        for name, i in [*self.ids.items(), *self.special.items()]:
            found[i] = name
        return found

    def parts(self, text: str) -> list[str]:
        """The text between special tokens, and those at odd places."""
        return self._special.split(text) if "<" in text else [text]

    def words(self, text: str) -> list[str]:
        """Lower-cased words between blanks of a plain text; of another text, its pieces."""
        if PLAIN.fullmatch(text):
            return text.lower().split()
        return [p for p, _ in self._split.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def pieces(self, word: str) -> list[str]:
        """The pieces of a word from `words`; those of a text that isn't plain are pieces already."""
        if word.isalpha():  # of a plain text or not, its letters hold together
            return [word]
        if word[-1:] in STOPS and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return PLAIN_PIECES.findall(word) if PLAIN.fullmatch(word) else [word]


@cache
def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(path)


class Encoder:
    """What belongs to each word of whole texts, such as its ids. `resolve` gives it for distinct words
    at once. Words are remembered while they keep coming back."""

    def __init__(self, known: Vocabulary, resolve: Callable[[list[str]], Iterable], memo: int = MEMO):
        self.known, self.resolve, self.size = known, resolve, memo
        self.memo: dict = {}
        self.older: dict = {}

    def values(self, texts: list[str], special: dict) -> Iterable[list]:
        """Of each text what belongs to its words, and, from `special`, to special tokens."""
        words: list[str] = []
        ends, tokens = [], []
        for text in texts:
            for i, part in enumerate(self.known.parts(text)):
                if i % 2:
                    tokens.append((len(words), part))
                    words.append("")  # holds the token's place; its value is set below
                else:
                    words += self.known.words(part)
            ends.append(len(words))
        if len(self.memo) > self.size:
            self.memo, self.older = {}, self.memo
        found = list(map(self.memo.get, words))
        gaps = list(compress(range(len(words)), map(is_, found, repeat(None))))
        if gaps:
            new = []
            for word in {words[i] for i in gaps}:
                value = self.older.get(word)
                if value is None:
                    new.append(word)
                else:
                    self.memo[word] = value
            self.memo.update(zip(new, self.resolve(new)))
            for i in gaps:
                found[i] = self.memo[words[i]]
        for i, token in tokens:
            found[i] = special[token]
        start = 0
        for end in ends:
            yield found[start:end]
            start = end

    def encode(self, texts: list[str], end: bytes = b"") -> list[np.ndarray]:
        """Ids of each text, as little-endian 32-bit integers, and those of `end`."""
        special = {name: i.to_bytes(4, "little") for name, i in self.known.special.items()}
        return [np.frombuffer(b"".join(values) + end, "<u4") for values in self.values(texts, special)]


def chunks(texts: Iterable[str], size: int = 1 << 20) -> Iterable[list[str]]:
    """Consecutive texts of about `size` characters together; a longer one comes alone."""
    held, length = [], 0
    for text in texts:
        if held and length + len(text) > size:
            yield held
            held, length = [], 0
        held.append(text)
        length += len(text)
    if held:
        yield held
