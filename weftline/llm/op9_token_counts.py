"""Token counts of a byte-level BPE vocabulary, with a whole-token shortcut.

A pre-token that is a vocabulary entry *and is proven to encode alone as exactly that one
token* counts 1 without running any merges.  The proof is made once per worker by encoding
every vocabulary string on its own with the library.  Other pre-tokens are merged by the
library once and remembered in a bounded memo (a full memo only costs time).

Pre-tokens come from the published split pattern of the vocabulary.  Unicode tables of the
pattern engine and of the library differ on a few recently assigned code points, so texts that
hold a character outside ``_COMMON`` are counted by the library as a whole.

Defined results: null or empty text gives 0 bytes and 0 tokens; special strings inside a text
are one token each, as the library does by default; no truncation, padding or added tokens; very
long texts count whole; repeated rows stay separate; there are no ties; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Published split pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which pattern engine and library are tested to agree (tests/llm).
_COMMON = (
    "\u0000-ԯ֐-ۿऀ-ॿḀ-⁯₠-₿℀-⅏←-⏿─-➿"
    "　-ヿ一-鿿가-힣＀-￯\U0001f300-\U0001f64f"
)
MEMO = 300_000
_counters: dict[str, "Counter"] = {}


class _Pieces(dict):
    """Pre-token -> number of tokens; unknown ones are merged by the library."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece, add_special_tokens=False).ids)
        if len(self) < MEMO and len(piece) <= 64:
            self[piece] = n
        return n


class Counter:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.find = regex.compile(PATTERN).findall
        self.rare = regex.compile(f"[^{_COMMON}]").search
        self.special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.pieces = _Pieces(self.tok.encode)
        self.prove()

    def prove(self) -> None:
        """Enter every vocabulary string that encodes alone as one token and is one pre-token."""
        texts = [self.tok.decode([i], skip_special_tokens=False) for i in self.tok.get_vocab(with_added_tokens=False).values()]
        texts = [t for t in texts if t and "�" not in t and not self.rare(t) and not any(s in t for s in self.special)]
        for t, e in zip(texts, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            if len(e.ids) == 1 and self.find(t) == [t]:
                self.pieces[t] = 1

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.rare(text):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        if any(s in text for s in self.special):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        return sum(map(self.pieces.__getitem__, self.find(text)))


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; one narrow pass, no shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["i"], "n_bytes": b["n"], "n_tokens": [c.count(t) for t in b["t"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n")
    )
    counted = rows.mapInPandas(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
