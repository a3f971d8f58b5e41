"""Removal of long word passages that an earlier document has, by compaction of the corpus's de Bruijn graph.

An edge is a string of k = `length` words; it leads from the node of its first k - 1 words to that of its last. Edges of a document that follow each
other and share a minimizer come as one path, so that equal stretches of edges are added up without a row for each edge (windows.py).
Of paths that share a minimizer but differ, edges are compared and the repeated ones marked, with the least document of each.
Repeated paths that meet in a node without branches, where all places of the one go on to the other, are linked by a join, and chains of
links are compacted by doubling: a chain's first path stands for a whole passage. Chains and what is left are looked up at their
places in the source documents, and a place counts where its words' hash, of another kind than the edges', is that of the path.

A word goes if it lies in a window of `length` words whose word sequence starts in a document with a
smaller doc_id too; windows are judged on the input.

Edges: a null text has no words; fewer than `length` words stay; a null doc_id stands after all others;
rows that repeat a doc_id are not earlier than each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomcode.llm.common import buffers, words
from loomcode.llm.windows import covered, joined_spans, of_words, repeated_windows, with_hash

GRAM = 12


def remove_passages(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, n_words, n_removed, kept (the kept words joined by a space), kept_sha256: a row for each document.

    kept is null where nothing goes.
    """
    rows = with_hash(docs, id_col, text_col)
    spans = repeated_windows(rows, of_words, length, min(GRAM, length), by_least=True, linked=True)

    def cut(batches):
        for b in batches:
            data, offsets = buffers(b.column("text"))
            starts, ends, before = words(data, offsets)
            raw = data.tobytes()
            removed, kept, sha = [], [], []
            for i, found in enumerate(b.column("spans")):
                a, z = int(before[i]), int(before[i + 1])
                gone = covered(found.as_py(), length)
                stays = np.ones(z - a, bool)
                for s, e in gone:
                    stays[s:e] = False
                which = np.flatnonzero(stays) + a
                text = b" ".join([raw[s:e] for s, e in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])
                removed.append(z - a - len(which))
                kept.append(text if gone else None)
                sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(np.diff(before), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())],
                names=["doc_id", "th", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    both = joined_spans(rows, spans).select("doc_id", "th", "text", "spans")
    return both.mapInArrow(cut, "doc_id long, th long, n_words long, n_removed long, kept string, kept_sha256 string")
