"""Operator 1: token counts by a whole-token shortcut.

Driver, once: every vocabulary string that ends a word is encoded alone; those
that come back as one token form the set WHOLE. Workers: a text falls into
words at ASCII white space (no step of the tokenizer looks across it); a word
falls into pre-tokens; a pre-token in WHOLE counts 1, and only the rest are
merged by the library's model. Both levels are kept in dictionaries of bounded
size, so memory does not grow with the corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import file_bytes, held, trim

#: Entries a worker keeps of each kind.
KEPT = 250_000
#: What falls into pre-tokens by an ASCII pattern as by the library: printable and no special token.
PLAIN = re.compile(rb"(?:[!-;=-~]|<(?!\|))+")
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def whole_tokens(tokenizer) -> frozenset[str]:
    """Vocabulary strings, without the word end, that the model leaves as one token."""
    end = json.loads(tokenizer.to_str())["model"]["end_of_word_suffix"] or ""
    ends = [k[: len(k) - len(end)] for k in tokenizer.get_vocab(with_added_tokens=False) if k.endswith(end)]
    return frozenset(k for k in ends if k and len(tokenizer.model.tokenize(k)) == 1)


class Counter(dict):
    """Tokens of a word, given as bytes."""

    def __init__(self, tokenizer, whole: frozenset[str]):
        self.tokenizer, self.whole, self.merged = tokenizer, whole, {}

    def pre_tokens(self, word: bytes) -> list[str]:
        if PLAIN.fullmatch(word):
            return PRE_TOKEN.findall(word.decode().lower())
        text = self.tokenizer.normalizer.normalize_str(word.decode())
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def merge(self, piece: str) -> int:
        n = self.merged.get(piece)
        if n is None:
            n = len(self.tokenizer.model.tokenize(piece))
            if len(piece) <= 64:
                self.merged[piece] = n
        return n

    def __missing__(self, word: bytes) -> int:
        if b"<|" in word:  # maybe a special token
            n = len(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        else:
            n = sum(1 if p in self.whole else self.merge(p) for p in self.pre_tokens(word))
        if len(word) <= 64:
            self[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self) > KEPT:
            self.clear()
        if len(self.merged) > KEPT:
            self.merged.clear()
        return sum(map(self.__getitem__, text.encode().split()))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    A null or empty text has 0 bytes and 0 tokens. A null doc_id stays null;
    repeated rows each give a row. Other columns are not read. Special strings
    in a text count as the library's default has them (one token).
    """
    from tokenizers import Tokenizer

    data = file_bytes(tokenizer_path).decode()
    kept = docs.sparkSession.sparkContext.broadcast((data, whole_tokens(Tokenizer.from_str(data))))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(kept)
        for texts in batches:
            yield pd.Series([counter.count(x) for x in texts], dtype="int64")
        trim()

    udf = F.pandas_udf(run, "long")
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), udf(body).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def _counter(kept) -> Counter:
    """One for each worker and vocabulary: later tasks find the dictionaries filled."""
    from tokenizers import Tokenizer

    data, whole = kept.value
    return held(("tokens", hashlib.sha256(data.encode()).digest()), lambda: Counter(Tokenizer.from_str(data), whole))
