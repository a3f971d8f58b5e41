"""A quality classifier with hierarchical empirical Bayes over sites.

Each document has evidence of its own: a logistic regression on measures of its text and on its words, fitted on at most `sample` labelled
documents (those with the least hash of doc_id). Words and pairs of words are hashed to BUCKETS; a bucket's weight is the log-ratio of the shares of good and
bad documents that have it, from about `sample` labelled documents (a random share of all, drawn where they stand), and a document's measure is the mean over its
buckets. The regression is fitted on measures by weights of the other half of the documents, so that it does not trust words that it has seen. A host (source) and a path in it (source and language) have posteriors from what is known of their
documents: the label where there is one, and the probability from the text elsewhere. The mean over a host's documents is shrunk to the global
mean, and that over a path's to its host's posterior, by strengths that the spread between sites gives (method of moments), so
that a site with few documents tells little. A document is left out of its own site's sums, its label too, so that it is judged by others. Its
posterior moves its own log-odds by its path's log-odds over the global ones.

Site totals are grouped sums, added up before they are shuffled.

Edges: a null or empty text has all measures 0; a null source or language is a site of its own; without
labels of both kinds, every document has probability 0.5 and is kept; labels without a document are not
looked at; rows that repeat a doc_id are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcode.llm.common import buffers, chunks, joined_small, mixed, word_symbols, written

SAMPLE = 20_000
THRESHOLD = 0.5
MAX_SITES = 100_000
#: Buckets of hashed words and pairs of words.
BUCKETS = 1 << 14
#: Tasks that count the sample's words; each sends 4 * BUCKETS numbers to the driver.
COUNTING = 16
MAX_LABELS = 200_000
MEASURES = ["log_words", "symbols", "upper", "bangs", "digits", "pipes", "word_length", "distinct_words", "repeated", "dup_lines", "long_words", "other", "words"]

_CLASS = np.zeros((256, 5), np.int64)
for _i, _set in enumerate((b"#*$%&<>@^~=+_{}[]\\", bytes(range(65, 91)), b"!?", b"0123456789", b"|")):
    _CLASS[list(_set), _i] = 1


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each bucket that a document's words and pairs of words have, once for each document."""
    _, _, before, symbols = word_symbols(data, offsets, lower=True)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    two = mixed(symbols[:-1] * np.uint64(0x2545F4914F6CDD1D) + symbols[1:])
    inside = doc[:-1] == doc[1:]
    every = np.concatenate([symbols, two[inside]])
    keys = np.unique(np.concatenate([doc, doc[:-1][inside]]) * BUCKETS + (every % np.uint64(BUCKETS)).astype(np.int64))
    return keys // BUCKETS, keys % BUCKETS


def word_measure(doc: np.ndarray, bucket: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The mean weight of each document's buckets, 0 without any."""
    return np.bincount(doc, weights[bucket], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1)


def bucket_weights(counts: np.ndarray) -> np.ndarray:
    """Log-ratios from counts (bad and good documents by buckets); all 0 if one kind has none."""
    total = counts.sum(axis=1)
    if not total.all():
        return np.zeros(BUCKETS)
    share = (counts + 1.0) / (total[:, None] + BUCKETS)
    return np.log(share[1] / share[0])


def learned(rows: DataFrame, quality: DataFrame, sample: int) -> np.ndarray:
    """Weights of buckets by what they are learned from: documents of fold 0, of fold 1, of both. rows: doc_id, fold, text."""
    labelled = quality.withColumnRenamed("labelled", "doc_id")
    if labelled.limit(MAX_LABELS + 1).count() <= MAX_LABELS:
        labelled = F.broadcast(labelled)
    n = rows.select("doc_id").join(labelled, "doc_id").count()
    few = rows.where(F.rand(11) < min(1.0, sample / max(n, 1))).join(labelled, "doc_id").select("fold", "quality", "text").repartition(COUNTING)

    def run(batches):
        counts = np.zeros((2, 2, BUCKETS), np.float32)
        for b in batches:
            data, offsets = buffers(b.column("text"))
            fold, good = b.column("fold").to_numpy(), (b.column("quality").to_numpy() >= 0.5).astype(np.int64)
            for i, j in chunks(offsets):
                doc, bucket = word_buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                np.add.at(counts, (fold[i:j][doc], good[i:j][doc], bucket), 1)
        yield pa.RecordBatch.from_arrays([pa.array([counts.ravel()], pa.list_(pa.float32()))], names=["counts"])

    found = few.mapInArrow(run, "counts array<float>").toArrow()["counts"]
    counts = np.sum([np.zeros((2, 2, BUCKETS)), *(np.array(x.values).reshape(2, 2, BUCKETS) for x in found)], axis=0)
    return np.stack([bucket_weights(counts[0]), bucket_weights(counts[1]), bucket_weights(counts.sum(axis=0))])


def measures_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of MEASURES for each document, but for that of its words."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    starts, ends, before, symbols = word_symbols(data, offsets)
    n_words = np.diff(before)
    some = np.maximum(n_words, 1)
    doc = np.repeat(np.arange(n), n_words)

    def distinct(h, d):
        if not len(h):
            return np.zeros(n, np.int64)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        return np.bincount(d[new], minlength=n)

    five = np.zeros(0, np.uint64)
    inside = np.zeros(0, bool)
    if len(symbols) > 4:
        five = symbols[:-4].copy()
        for k in range(1, 5):
            five = mixed(five * np.uint64(0x2545F4914F6CDD1D) + symbols[k : len(symbols) - 4 + k])
        inside = doc[:-4] == doc[4:]
    n_five = np.bincount(doc[:-4][inside], minlength=n) if len(inside) else np.zeros(n, np.int64)
    unlike = distinct(five[inside], doc[:-4][inside]) if len(inside) else np.zeros(n, np.int64)

    # Lines, as stretches between newlines, hashed by their words.
    newline = np.concatenate([[0], np.cumsum(data == 0x0A)])
    line = newline[starts] + doc  # a number for each line with a word, rising
    cut = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])) if len(line) else np.zeros(0, np.int64)
    if len(cut):
        within = np.arange(len(symbols)) - np.repeat(cut, np.diff(np.append(cut, len(symbols))))
        line_hash = np.add.reduceat(mixed(symbols + within.astype(np.uint64)), cut)
        n_lines = np.bincount(doc[cut], minlength=n)
        dup = n_lines - distinct(line_hash, doc[cut])
    else:
        n_lines, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)

    lengths = ends - starts
    counts = [per(_CLASS[data, i]) for i in range(5)]
    word_bytes = np.bincount(doc, lengths, minlength=n)
    return np.column_stack(
        [
            np.log1p(n_words),
            counts[0] / some,
            counts[1] / size,
            counts[2] / some,
            counts[3] / size,
            counts[4] / some,
            word_bytes / some,
            distinct(symbols, doc) / some,
            (n_five - unlike) / np.maximum(n_five, 1),
            dup / np.maximum(n_lines, 1),
            np.bincount(doc, lengths > 20, minlength=n) / some,
            per(data >= 128) / size,
        ]
    )


def measured(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs: doc_id, text, host, path, text_hash, fold. Adds measures, array<float>, in place of text: MEASURES, and that of words as the other fold has them."""
    weights = weights.astype(np.float32)

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column("text"))
            for i, j in chunks(offsets):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                doc, bucket = word_buckets(own, at)
                by = [word_measure(doc, bucket, w, j - i) for w in weights]
                other = np.where(b.column("fold").to_numpy()[i:j] == 0, by[1], by[0])
                m = np.column_stack([measures_of(own, at), by[2], other])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(m.astype(np.float32).ravel()), m.shape[1]).cast(pa.list_(pa.float32()))
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("doc_id", "host", "path", "text_hash")), lists], names=["doc_id", "host", "path", "text_hash", "measures"])

    return docs.select("doc_id", "host", "path", "text_hash", "fold", "text").mapInArrow(run, "doc_id long, host string, path string, text_hash long, measures array<float>")


def expanded(x: np.ndarray) -> np.ndarray:
    """Measures and their square roots."""
    return np.hstack([x, np.sqrt(np.maximum(x, 0))])


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights for expanded measures, and a constant, by Newton's method; all 0 if y has one kind only."""
    z = expanded(x.astype(float))
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(z.shape[1] + 1)
    mean, spread = z.mean(axis=0), z.std(axis=0) + 1e-9
    a = np.hstack([(z - mean) / spread, np.ones((len(z), 1))])
    w = np.zeros(a.shape[1])
    keep = np.append(np.full(z.shape[1], ridge), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep), a.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def sampled(known: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(measures as they are fitted, labels) of the `sample` labelled documents with the least hash of doc_id. Those above twice the share that is wanted are left
    out where they stand."""
    labelled = known.where("quality is not null")
    n = labelled.count()
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    few = labelled.where(order < int(min(1.0, 2 * sample / max(n, 1)) * 1_000_000) + 1)
    rows = few.orderBy(order, "doc_id", "path").limit(sample).select("measures", "quality").toArrow()
    x = np.array(rows["measures"].combine_chunks().flatten() if rows.num_rows else [], float).reshape(rows.num_rows, len(MEASURES) + 1)
    # What words say by the other fold stands in the place of what they say by all.
    return np.delete(x, len(MEASURES) - 1, axis=1), rows["quality"].to_numpy()


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def strength(sites: DataFrame, mean: str) -> float:
    """How many documents the prior counts for: from the spread of site means around `mean`, less what chance gives."""
    r = sites.where("n > 1").agg(
        F.sum("n").alias("n"), F.sum(F.expr(f"n * pow(s / n - {mean}, 2)")).alias("between"), F.sum(F.expr("q - s * s / n")).alias("within"), F.count("*").alias("sites")
    ).first()
    if not r["sites"] or r["n"] <= r["sites"]:
        return 100.0
    inside = r["within"] / (r["n"] - r["sites"])
    spread = max(r["between"] / r["n"] - inside * r["sites"] / r["n"], 0.0)
    return float(min(max(inside / max(spread, 1e-9), 1.0), 1e6))


def site_of(host_col: str = "source", path_col: str = "lang") -> tuple[Column, Column]:
    """(host, path in it); a null is a site of its own."""
    host = F.coalesce(F.concat(F.lit("s:"), F.col(host_col)), F.lit("null"))
    return host, F.concat_ws("/", host, F.coalesce(F.concat(F.lit("s:"), F.col(path_col)), F.lit("null")))


def hash_of(text_col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", row_key: bool = False
) -> DataFrame:
    """doc_id, p_document, host_posterior, path_posterior, posterior, kept: a row for each document; with row_key, text_hash and path too, which tell rows
    that share a doc_id apart."""
    host, path = site_of(host_col, path_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), host.alias("host"), path.alias("path"), hash_of(text_col).alias("text_hash"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    quality = labels.where("quality is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").cast("double").alias("quality"))
    known = written(measured(rows, learned(rows, quality, sample)).join(quality, F.col("doc_id") == F.col("labelled"), "left").drop("labelled"), "measures")
    x, given = sampled(known, sample)
    w = fitted(x, given)
    both = len(given) > 0 and given.min() != given.max()
    k = len(MEASURES)
    z = F.lit(float(w[-1]))
    for i in range(k):
        m = F.get("measures", F.lit(i)).cast("double")
        z = z + m * float(w[i]) + F.sqrt(F.greatest(m, F.lit(0.0))) * float(w[k + i])
    p = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    scored = known.select("doc_id", "host", "path", "text_hash", p.alias("p"), (F.coalesce("quality", p) if both else p).alias("y"))
    paths = written(scored.groupBy("path").agg(F.first("host").alias("host"), F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    n, s = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0.0))).first()
    mean = s / n if n else 0.5
    k_host = strength(hosts, repr(mean))
    shrunk = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("around"))
    sites = paths.join(shrunk, "host")
    k_path = strength(sites, "around")
    judged = joined_small(scored.drop("host"), sites.select("path", "n", "s", "host_n", "host_s"), "path", MAX_SITES)
    without = lambda total, count, prior, strong: (total - F.col("y") + strong * prior) / (count - 1 + strong)
    judged = judged.withColumn("host_posterior", without(F.col("host_s"), F.col("host_n"), F.lit(mean), k_host))
    judged = judged.withColumn("path_posterior", without(F.col("s"), F.col("n"), F.col("host_posterior"), k_path))
    odds = logit(F.col("p")) + logit(F.col("path_posterior")) - logit(F.lit(mean))
    judged = judged.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    own = ["text_hash", "path"] if row_key else []
    return judged.select("doc_id", F.col("p").alias("p_document"), "host_posterior", "path_posterior", "posterior", (F.col("posterior") >= threshold).alias("kept"), *own)
