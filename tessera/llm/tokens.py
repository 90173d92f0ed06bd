"""Sizes of texts in tokens of a public tokenizer; the vocabulary file is a parameter, nothing is trained."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(path: str):  # noqa: ANN201
    """The byte-level BPE of a file of ranks; once for each worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, keep: str = "") -> DataFrame:
    """``doc_id, tokens`` and the columns of the schema string ``keep``; whole texts, one pass, no shuffle.

    Null texts have 0 tokens.
    """
    names = [x.split()[0] for x in keep.split(",") if x.strip()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            out = b[["doc_id", *names]].copy()
            out["tokens"] = [len(encode(t.encode("utf-8", "replace").decode("utf-8"))) if t else 0 for t in b.text]
            yield out[["doc_id", "tokens", *names]]

    return documents.select("doc_id", "text", *names).mapInPandas(run, "doc_id bigint, tokens int" + (f", {keep}" if keep else ""))
