"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Where the vocabulary files are and which one is used; both are parameters.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a piece; longer texts are counted in pieces cut before white space, with which a token of this vocabulary only starts, and never in a word.
PIECE = 200_000


@lru_cache(maxsize=2)
def _encoder(folder: str, vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> list[str]:
    """The text cut before white space into pieces of about PIECE characters; a word of any length stays whole."""
    out, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            if cut <= at:
                ahead = [x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0]
                cut = min(ahead) if ahead else len(text)
            while at + 1 < cut < len(text) and text[cut - 1].isspace():
                cut -= 1
            end = cut
        out.append(text[at:end])
        at = end
    return out


def count_many(texts: Sequence[str | None], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> list[int]:
    """Tokens of each text; 0 for null and empty texts. Lone surrogates count as replacement characters."""
    encode = _encoder(folder, vocabulary).encode_ordinary  # the library's batch call takes almost twice the time

    def count(piece: str) -> int:
        try:
            return len(encode(piece))
        except UnicodeEncodeError:
            return len(encode(piece.encode("utf-8", "replace").decode()))

    return [sum(map(count, _pieces(t) if len(t) > PIECE else (t,))) if t else 0 for t in texts]


def count_tokens(text: str | None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> int:
    """``count_many`` of one text."""
    return count_many([text], folder, vocabulary)[0]


def with_tokens(documents: DataFrame, columns: list[str], text_col: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The given columns and n_tokens, the texts left behind. Every text is read whole."""

    @F.pandas_udf(LongType())
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(count_many(texts.tolist(), folder, vocabulary), dtype="int64")

    # declared as not deterministic: a filter on the counts would otherwise be pushed below them and count everything twice
    return documents.select(*columns, tokens.asNondeterministic()(F.col(text_col)).alias("n_tokens"))
