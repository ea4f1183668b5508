"""Token ids of a byte-level tokenizer file, by the rank merger of tiktoken where that is the same thing.

A byte-level BPE whose merges give ascending ids is fully told by the bytes and rank of its tokens. Such
files are merged by ranks, about four times as fast; all other files, texts that hold special strings with
a meaning, and texts with very long runs of white space (which the rank merger's expressions cannot take)
go to the tokenizers library. Both give the same ids.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

from quarrylight.llm.tables import WHITE
from quarrylight.llm.token_counts import PRE_TOKEN
from quarrylight.llm.tokenizing import LETTERS, ODD, special_strings

LONG_WHITE = re.compile(f"[{WHITE}]{{400}}")


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every token by id; ids without a byte-level spelling are empty."""
    back = {c: b for b, c in LETTERS.items()}
    vocabulary = Tokenizer.from_file(path).get_vocab()
    found = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, number in vocabulary.items():
        if all(c in back for c in token):
            found[number] = bytes(back[c] for c in token)
    return found


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes with their ids as ranks; None where ranks do not tell the whole tokenizer."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, cut = told["model"], told["pre_tokenizer"] or {}
    plain = told["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    numbers = [model["vocab"].get("".join(m), -1) for m in merges]
    if model.get("type") != "BPE" or not plain or model.get("dropout") or model.get("ignore_merges") or numbers != sorted(set(numbers)):
        return None
    back = {c: b for b, c in LETTERS.items()}
    single = [t for t in model["vocab"] if len(t) == 1]
    merged = ["".join(m) for m in merges]
    if len(single) != 256 or len(single) + len(merged) < len(model["vocab"]) - len(told["added_tokens"]):
        return None
    return {bytes(back[c] for c in t): model["vocab"][t] for t in [*single, *merged]}


class ByteLevelIds:
    """The ids of a text, without added tokens. `plain` makes special strings inside texts ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.specials = [] if plain else special_strings(self.tokenizer)
        ranks = merge_ranks(path)
        self.by_rank = None
        if ranks:
            self.by_rank = tiktoken.Encoding(
                "ranks", pat_str=PRE_TOKEN.pattern, mergeable_ranks=ranks, special_tokens={}
            ).encode_ordinary

    def ids(self, text: str) -> list[int]:
        if (
            self.by_rank is None or any(s in text for s in self.specials) or ODD.search(text)
            or (len(text) >= 400 and LONG_WHITE.search(text))
        ):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.by_rank(text)


@lru_cache(maxsize=4)
def byte_level_ids(path: str, plain: bool = False) -> ByteLevelIds:
    return ByteLevelIds(path, plain)
