"""Removal of long repeated byte strings.

Every byte goes that lies in a string of `length` bytes which starts at another place of the corpus too,
in the same document or another; strings never cross documents and are judged on the input.
See windows.py for how repeated strings are found; README.md tells why the interval expansion is
done on minimizer classes.

Edges: a null text is empty; documents shorter than `length` keep all; repeated rows count as places of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcode.llm.windows import covered, joined_spans, of_bytes, repeated_windows, with_hash

GRAM = 64


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary, null where nothing goes), kept_sha256: a row for each document."""
    rows = with_hash(docs, id_col, text_col)
    spans = repeated_windows(rows, of_bytes, length, min(GRAM, max(length // 2, 1)), by_least=False)

    def cut(batches):
        for b in batches:
            removed, n_spans, kept, sha = [], [], [], []
            for text, found in zip(b.column("text"), b.column("spans"), strict=True):
                data, at = text.as_buffer(), 0
                gone = covered(found.as_py(), length)
                pieces = []
                for s, e in gone:
                    pieces.append(data[at:s])
                    at = e
                rest = b"".join([*pieces, data[at:]]) if gone else data
                removed.append(sum(e - s for s, e in gone))
                n_spans.append(len(gone))
                kept.append(rest if gone else None)
                sha.append(hashlib.sha256(rest).hexdigest())
            sizes = [len(x.as_buffer()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    both = joined_spans(rows, spans).select("doc_id", "text", "spans")
    return both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
