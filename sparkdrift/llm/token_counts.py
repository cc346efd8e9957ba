"""Token counts of whole texts from a trie of their distinct pre-tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from sparkdrift.llm.frames import free_name
from sparkdrift.llm.unigram import Segments, normal, numbered, text_chunks, vocabulary


def count_tokens(docs: DataFrame, model: str, text: str = "text", offset: float = 1000.0) -> DataFrame:
    """``docs`` with ``n_pretokens`` and ``n_tokens``, the ids that a unigram encoding of the text has.

    A task takes the distinct pre-tokens of many texts, inserts them in a trie, and computes each prefix's
    forward score once, however many pre-tokens share it. Texts are counted where they are: nothing is
    shuffled. Null and empty texts have no tokens; repeated rows get the same counts; columns whose names
    are taken make the new ones end in underscores.
    """
    names = [free_name(docs, "n_pretokens"), free_name(docs, "n_tokens")]
    schema = StructType([*docs.schema.fields, *[StructField(n, LongType()) for n in names]])
    place = docs.columns.index(text)

    def run(batches):
        words = vocabulary(model, offset)
        for batch in batches:
            for start, texts in text_chunks(batch.column(place)):
                distinct, rows = numbered([normal(x) for x in texts])
                counts = Segments(distinct, words, with_ids=False).counts
                size = np.array([len(r) for r in rows], np.int64)
                tokens = np.array([int(counts[r].sum()) for r in rows], np.int64)
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(size), pa.array(tokens)], names=[*part.schema.names, *names]
                )

    return docs.mapInArrow(run, schema)
