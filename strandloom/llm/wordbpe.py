"""Token ids of the lower-casing word BPE vocabulary, by a cache of white-space chunks.

A pre-token never crosses white space, so the ids of a text are the ids of its chunks in
order. Chunks seen before cost a dictionary look-up. A new chunk is cut into pre-tokens; a
pre-token that the vocabulary encodes alone as one token is looked up in a table proved
beforehand, and only the rest is merged by the library's own model. Texts with characters
outside the range whose normal form is known to be itself, and texts that hold a special
token's string, go to the library whole. Caches hold only short chunks and a bounded number of them, so their bytes are bounded.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: Characters for which NFC is the identity and simple lower-casing agrees everywhere.
OUTSIDE = re.compile("[^\t-\r\x20-\x7e\xa0-įĲ-ňŊ-ž]")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


def _category(test) -> str:
    return "".join(re.escape(c) for c in map(chr, range(0x180)) if test(c) and not c.isspace())


LETTERS = _category(str.isalpha)
NUMBERS = _category(lambda c: c.isnumeric() and not c.isalpha())
PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")


LONGEST = 48  # characters of a chunk that is kept


class ChunkCache(dict):
    """Ids by chunk. When full, what was not asked for since the last time is forgotten; long chunks are not kept."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) > LONGEST:
            return got
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


def prove(path: str) -> dict[str, int]:
    """Vocabulary strings that end a word and that the merges bring to that one token, with its id."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    end, byte, out = "</w>", {c: b for b, c in byte_letters().items()}, {}
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        if not token.endswith(end) or any(c not in byte for c in token[: -len(end)]):
            continue
        got = tokenizer.model.tokenize(token[: -len(end)])
        if len(got) != 1 or got[0].id != i:
            continue
        try:
            out[bytes(byte[c] for c in token[: -len(end)]).decode()] = i
        except UnicodeDecodeError:
            continue
    return out


class WordBpe:
    """``ids(text)``: little-endian unsigned 32-bit ids as bytes, equal to the library's; ``count(text)``: their number.

    ``proved``: what ``prove`` found for this vocabulary. At most 2 * ``limit`` chunks of LONGEST characters are kept.
    """

    def __init__(self, path: str, proved: dict[str, int] | None = None, limit: int = 60_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_code = byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = {s: i.to_bytes(4, "little") for s, i in (prove(path) if proved is None else proved).items()}
        self.cache, self.counts = ChunkCache(self.chunk, limit), ChunkCache(self.count_chunk, limit)

    def mapped(self, pretoken: str) -> str:
        return pretoken if pretoken.isascii() else pretoken.encode().decode("latin-1").translate(self.by_code)

    def pretoken(self, s: str) -> bytes:
        """Ids of one pre-token: looked up if it is proved to be one token, else merged."""
        got = self.whole.get(s)
        if got is None:
            got = array("I", [t.id for t in self.model.tokenize(self.mapped(s))]).tobytes()
        return got

    def chunk(self, s: str) -> bytes:
        """Ids of a run without white space; words at its edge are kept for other runs."""
        if s.isalpha():
            return self.pretoken(s)
        if s[:-1].isalpha() and not s[-1].isnumeric():
            return self.cache[s[:-1]] + self.pretoken(s[-1])
        return b"".join(map(self.pretoken, PRETOKEN.findall(s)))

    def count_pretoken(self, s: str) -> int:
        return 1 if s in self.whole else len(self.model.tokenize(self.mapped(s)))

    def count_chunk(self, s: str) -> int:
        """Like ``chunk``: the number of ids only."""
        if s.isalpha():
            return self.count_pretoken(s)
        if s[:-1].isalpha() and not s[-1].isnumeric():
            return self.counts[s[:-1]] + self.count_pretoken(s[-1])
        return sum(map(self.count_pretoken, PRETOKEN.findall(s)))

    def by_library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def plain(self, text: str) -> bool:
        if "<|" in text and any(s in text for s in self.special):
            return False
        return OUTSIDE.search(text) is None

    def ids(self, text: str) -> bytes:
        if not self.plain(text):
            return self.by_library(text)
        return b"".join(map(self.cache.__getitem__, text.lower().split()))

    def count(self, text: str) -> int:
        if not self.plain(text):
            return len(self.by_library(text)) // 4
        return sum(map(self.counts.__getitem__, text.lower().split()))


_made: dict[str, WordBpe] = {}


def word_bpe(path: str, proved: dict[str, int]) -> WordBpe:
    """One encoder for each Python worker and vocabulary."""
    if path not in _made:
        _made[path] = WordBpe(path, proved)
    return _made[path]


def pieces(ids: bytes, most: int) -> list[bytes]:
    """Cut ids into pieces of at most ``most`` tokens."""
    step = 4 * most
    return [ids[i : i + step] for i in range(0, len(ids), step)]

