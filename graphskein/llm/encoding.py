"""Token ids and token counts of every document by a public byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphskein.llm.bpe import encoder

#: The vocabulary's file; every executor must have it at this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Code points encoded at once; one longer text is encoded alone.
CHUNK = 1 << 20


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive texts of at most ``most`` bytes together, and the place of the first."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    edges = np.flatnonzero(np.diff(np.append(-1, group)) != 0)
    for lo, hi in zip(edges, np.append(edges[1:], len(texts))):
        yield int(lo), texts.slice(lo, hi - lo).to_pylist()


def _encoded(path: str, only_counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = b.column(1)
            for at, some in chunks(texts):
                words, per_text = e.encode_texts(some)
                n = e.lengths(words, per_text)
                if only_counts:
                    out = pa.array(n)
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(e.gather(words)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), out], ["id", "out"])

    return run


def _over(docs: DataFrame, id_col: str, text_col: str, path: str, only_counts: bool) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_encoded(path, only_counts), f"id {rows.schema['id'].dataType.simpleString()}, out {'long' if only_counts else 'array<int>'}")


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``id_col, ids`` of every row: the token ids of its whole text, without special tokens (their strings are text).

    An empty or null text gives an empty list. Ids may be null or repeat: a row in, a row out. Further columns are
    ignored. An empty table gives no rows. No shuffle: each partition is encoded where it is read.
    """
    return _over(docs, id_col, text_col, path, False).select(F.col("id").alias(id_col), F.col("out").alias("ids"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``id_col, n_tokens``: the length of the list :func:`token_ids` gives, without making the list."""
    return _over(docs, id_col, text_col, path, True).select(F.col("id").alias(id_col), F.col("out").alias("n_tokens"))
