"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import by_bytes, shaped, text_of
from helixframe.llm.encoding import encoder


def byte_bpe(path: str) -> Callable[[list[str]], list[int]]:
    """Counts by a byte-level file of the `tokenizers` library, cut at safe boundaries."""
    return encoder(path).count


def sentence_pieces(path: str) -> Callable[[list[str]], list[int]]:
    """Counts by a sentencepiece model. Its pieces depend on the whole text, so nothing is cut."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]


def whole_texts(path: str) -> Callable[[list[str]], list[int]]:
    """Counts by any other file of the `tokenizers` library, each text at once."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def counter(path: str) -> Callable[[list[str]], list[int]]:
    if path.endswith(".model"):
        return sentence_pieces(path)
    import json

    with open(path, encoding="utf-8") as file:
        pre = (json.load(file).get("pre_tokenizer") or {}).get("type")
    return byte_bpe(path) if pre == "ByteLevel" else whole_texts(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, batch_chars: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of `docs`.

    Texts reach Python in Arrow batches; within one, slices of about `batch_chars` characters are encoded
    and only their lengths return. A text longer than a slice is cut at boundaries no token crosses.
    Null and empty texts count 0. Repeated rows and null ids stay as they are; other columns are not read;
    an empty table gives an empty result.
    """

    @F.pandas_udf(T.LongType())
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path)
        for texts in batches:
            yield pd.Series([n for part in by_bytes(texts, batch_chars) for n in count(part)], dtype="int64")

    rows = shaped(docs, doc_id="long", text="string").select("doc_id", text_of().alias("text"))
    return rows.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), lengths("text").alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
