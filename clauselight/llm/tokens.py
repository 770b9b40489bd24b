"""Token ids of a byte-level tokenizer file, word by word through a bounded memo.

The tokenizer splits a text at a single space between two non-space characters
before it merges bytes, so ids of such chunks can be joined. A chunk seen before
costs a dictionary look-up.
"""

from __future__ import annotations

import os
import re
import string
import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from clauselight.llm.words import Memo

# Chunks a worker remembers: about 90 MB.
MEMO_CHUNKS = 400_000
DEFAULT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

_SINGLE_SPACE = re.compile(r"(?<=\S)(?= \S)")
# Ends of a word that the splitter parts from its letters (an apostrophe may stay with them).
_TAIL = "".join(c for c in string.punctuation if c != "'")

_PACKED = [struct.Struct(f"<{n}I").pack for n in range(9)]


def _byte_symbols() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the rest is moved above 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


def _regular(text: str) -> bool:
    """Whether white space is only single spaces and line ends between other characters."""
    return (
        "  " not in text
        and "\n\n" not in text
        and " \n" not in text
        and "\n " not in text
        and text[0] not in " \n"
        and text[-1] not in " \n"
        and text.replace("\n", "").isprintable()
    )


def chunks(text: str) -> list[str]:
    if _regular(text):
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
    return _SINGLE_SPACE.split(text)


class Encoder:
    """Little-endian unsigned 32-bit ids of whole texts, as the library gives them.

    A text that holds a string of an added token (such as an end-of-text mark) goes to the
    library whole, since that token's rules may reach beyond the string.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.symbols = _byte_symbols()
        self.space = self.symbols[0x20]
        self.memo = Memo(self._chunk, MEMO_CHUNKS)

    def _chunk(self, chunk: str) -> bytes:
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():  # one piece for the splitter: straight to the merges
            if word.isascii():  # only the space before it has another symbol
                mapped = chunk if word is chunk else self.space + word
            else:
                mapped = chunk.encode().decode("latin-1").translate(self.symbols)
            ids = [t.id for t in self.model.tokenize(mapped)]
        else:
            letters = chunk.rstrip(_TAIL)
            if len(letters) < len(chunk) and letters and letters[-1].isalpha():
                return self.memo[letters] + self.memo[chunk[len(letters) :]]
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes() if len(ids) > 8 else _PACKED[len(ids)](*ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        return b"".join(map(self.memo.__getitem__, chunks(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and file; its memo serves all tasks of the worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)
