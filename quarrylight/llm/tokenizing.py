"""What the two tokenizing operators share: loading, special strings and a bounded memory of pieces."""

from __future__ import annotations

import re
from functools import lru_cache

from tokenizers import Tokenizer

# The separators U+001C to U+001F are white space to Python, not to the tokenizer's expressions.
ODD = re.compile("[\x1c-\x1f]")
GENERATION = 500_000
REMEMBERED_CHARS = 64


@lru_cache(maxsize=4)
def load_tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file that every node holds; loaded once per Python process."""
    return Tokenizer.from_file(path)


def special_strings(tokenizer: Tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others take the code points from U+0100 on in their order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


LETTERS = byte_letters()


def to_letters(text: str) -> str:
    """A text as a byte-level vocabulary spells it."""
    return text.encode("utf-8").decode("latin-1").translate(LETTERS)


class Remembered(dict):
    """What short pieces of text gave. Two generations bound it: when the young one is full it becomes
    the old one, so pieces that come often stay."""

    generation = GENERATION

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def work_out(self, piece: str):
        raise NotImplementedError

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.work_out(piece)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= self.generation:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value
