"""The language of a text by its character trigrams, learned from texts whose language is known.

A trigram of lower-case code points is hashed to a bucket by a plain formula; a language's weight of a bucket is the logarithm of its share of the language's
trigrams, and a text is in the language in which its trigrams are likeliest. A language that the engine has no model for is recognised too, and told as none, as
a text in it must not be read as one of the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcode.functions import text as T

BUCKETS = 4096
#: The feature looks at the beginning of a text only.
FIRST = 5000
MAX_LANGUAGES = 200


def trigrams(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % BUCKETS


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray

    def of(self, text: str | None) -> str | None:
        found = trigrams(text or "")
        if not len(found) or not self.languages:
            return None
        return self.languages[int(np.argmax(self.weights @ np.bincount(found, minlength=BUCKETS)))]


def fitted(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model of the languages of docs, from their whole texts; rows without a language say nothing. At most MAX_LANGUAGES languages, each with BUCKETS counts, reach the driver."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                seen = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                seen += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, seen in counts.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(seen[at])], names=["lang", "bucket", "n"])

    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    n_languages = known.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if n_languages > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = known.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = tuple(sorted({r["lang"] for r in rows}))
    counts = np.zeros((len(languages), BUCKETS))
    for r in rows:
        counts[languages.index(r["lang"]), r["bucket"]] = r["n"]
    return Model(languages, np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + BUCKETS)))


def detected(text: Column, model: Model, supported: tuple[str, ...] = tuple(T.LANGUAGES), first: int | None = FIRST) -> Column:
    """The language of a text if it is a supported one; null for another, and for a text of fewer than three characters. Ties go to the first by name."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else model.of(t))

    own = F.lower(F.coalesce(text, F.lit("")))
    found = find(own if first is None else F.substring(own, 1, first))
    return F.when(found.isin(list(supported)), found)
