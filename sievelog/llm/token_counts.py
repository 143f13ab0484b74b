"""Token counts: pieces are counted once for each distinct pre-token of the corpus and joined to the documents' frequencies."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .vocabulary import Vocabulary


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text, as the library counts them; no ids are made for documents.

    First the distinct pre-tokens of all documents are gathered by shards of their hashes, each is encoded once, and its
    number of pieces stored in sorted hash arrays. Then each document's pre-token frequencies are joined to those by
    look-up, and summed. Pre-tokens that frequent texts share are one entry from each flush of a task, so that no key is hot.
    Null text: as empty, with no tokens. Repeated rows: a row for each. An empty table gives none. A long text is one row of
    one task. Other columns aren't looked at.
    """
    known = Vocabulary(docs, path, text_column, keep_ids=False)

    def count(batches):
        for rows, tokens, size in known.counts_of(batches, text_column):
            yield pa.RecordBatch.from_arrays([rows.column(id_column), pa.array(size, pa.int64()), pa.array(tokens, pa.int64())], [id_column, "n_bytes", "n_tokens"])

    return docs.select(id_column, text_column).mapInArrow(count, f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_bytes long, n_tokens long")
