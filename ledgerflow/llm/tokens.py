"""Token ids by public tokenizers, for whole texts.

``WordBpe`` gives exactly the ids that the tokenizer file's own encode gives. Its
pre-tokens never hold white space, so a text's ids are those of its words in turn;
words are remembered. A word of Latin letters, perhaps with marks after it, is two
pre-tokens that go straight to the file's merges; any other word goes through
encode. ``path`` names the vocabulary file; the default is looked up where it runs.
"""

from __future__ import annotations

import base64
import os
import re
import struct

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WORDS, PARTS = 300_000, 200_000  # remembered of each of two generations
_MARKS = ".,;:!?"
_PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]*)([.,;:!?*%&$#|()\-]*)")


class Remembered(dict):
    """key -> made value, for the keys used lately: two generations of bounded size."""

    def __init__(self, make, size: int):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got

    def forget(self) -> None:
        self.old = {}
        self.clear()


def little_endian(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters for themselves, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + rest.index(b)) for b in range(256)]


class WordBpe:
    """Ids by a BPE with word ends (lower case, white space dropped)."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.bytes_of = [little_endian([i]) for i in range(self.tokenizer.get_vocab_size())]
        self.parts = Remembered(self._part, PARTS)
        self.words = Remembered(self._word, WORDS)

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
        one = self.bytes_of
        return b"".join([one[t.id] for t in self.tokenizer.model.tokenize(spelled)])

    def _word(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        if core.isascii() and core.isalpha():
            ids = self.parts[core.lower()]
            return ids if len(core) == len(word) else ids + self.parts[word[len(core):]]
        plain = _PLAIN.fullmatch(word)
        if not plain:
            return little_endian(self.tokenizer.encode(word, add_special_tokens=False).ids)
        letters, marks = plain.groups()
        if not marks:
            return self.parts[letters.lower()] if letters else b""
        return self.parts[letters.lower()] + self.parts[marks] if letters else self.parts[marks]

    def packed(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        # split() takes four control characters for white space that the file doesn't
        words = text.split(" ") if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return b"".join(map(self.words.__getitem__, words))

    def ids(self, text: str | None) -> list[int]:
        return list(struct.unpack(f"<{len(data := self.packed(text)) // 4}I", data))

    def count(self, text: str | None) -> int:
        return len(self.packed(text)) // 4

    def forget(self) -> None:
        """Drop the remembered words: a worker process outlives the task."""
        self.parts.forget()
        self.words.forget()


class ByteBpe:
    """Counts by a byte-level BPE given as ranks."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})

    def count(self, text: str | None) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0

    def forget(self) -> None:
        """It remembers nothing."""


KINDS = {"word_bpe_49k": WordBpe, "byte_bpe_50k": ByteBpe}
_LOADED: dict[tuple[str, str | None], WordBpe | ByteBpe] = {}


def load(kind: str, path: str | None = None):
    """The tokenizer, once per worker process; tasks make it forget at their end."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = KINDS[kind](path)
    return _LOADED[kind, path]
