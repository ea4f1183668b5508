"""Token counts by the whole-token shortcut.

Before the corpus is read, every vocabulary string is encoded alone; those that give one token are
proven whole. A text is cut into pre-tokens; a pre-token that is a whole token counts one without
merging, and only the others are merged by the tokenizer. What a run of non-white characters costs is
remembered in a bounded table, as most of a corpus repeats a small part of its words.

Nulls: a null text counts as empty (0 tokens); a null id stays null. Empty tables give empty results.
Repeated rows are counted each. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.tables import WHITE, text_of
from quarrylight.llm.tokenizing import LETTERS, ODD, Remembered, load_tokenizer, special_strings, to_letters

# The byte-level pre-token pattern. Fixed value.
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# A run of non-white characters with the space before it, or the white space before such a run:
# every pre-token lies in one of these pieces, and the pieces are cut as the pattern above cuts.
PIECE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def whole_tokens(path: str) -> frozenset[str]:
    """The texts that are one pre-token and one token alone, proven by encoding every vocabulary string."""
    tokenizer, back = load_tokenizer(path), {c: b for b, c in LETTERS.items()}
    texts = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if all(c in back for c in token):
            try:
                text = bytes(back[c] for c in token).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(PRE_TOKEN.findall(text)) == 1 and not ODD.search(text):
                texts.append(text)
    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, encoded, strict=True) if len(e) == 1)


class PieceCosts(Remembered):
    """Tokens of a piece of text: whole pre-tokens count one, the rest are merged."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__()
        self.tokenizer, self.whole = load_tokenizer(path), whole
        self.merge = self.tokenizer.model.tokenize
        self.specials = special_strings(self.tokenizer)

    def work_out(self, piece: str) -> int:
        pre_tokens = PRE_TOKEN.findall(piece)
        rest = [p for p in pre_tokens if p not in self.whole]
        return len(pre_tokens) - len(rest) + sum(len(self.merge(to_letters(p))) for p in rest)

    def count(self, text: str) -> int:
        """Tokens of one text; texts with special strings or odd separators go to the tokenizer whole."""
        if any(s in text for s in self.specials) or ODD.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        return sum(map(self.__getitem__, PIECE.findall(text)))


@lru_cache(maxsize=2)
def piece_costs(path: str, whole: frozenset[str]) -> PieceCosts:
    return PieceCosts(path, whole)


def token_counts(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 1024
) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than `limit`).

    `path` names a byte-level tokenizer file present on every node. One pass, no shuffle. The set of
    whole tokens is broadcast; it is no larger than the vocabulary.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = piece_costs(path, whole.value)
        for batch in batches:
            counts = [costs.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    text = text_of(text_column)
    source = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        text.alias("text"),
    )
    counted = source.mapInArrow(count, "id long, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
