"""Packing documents into token sequences by lexical retrieval.

Each document's ids (its own, then END) are cut into full windows, which are sequences of their own, and
a tail. Tails are the units of retrieval, sought and found by the terms of their whole documents in a sharded BM25 index. In its shard, the
longest unused tail is the seed of a sequence and asks the index with all its terms; unused neighbours fill the window by falling score, ties
in the order of units, and the first one that does not fit is cut to fill the rest, so that a window has no padding. What a shard has left,
less than a window, goes to the next round, where it is dealt and packed anew; the last round has one shard, whose rest is cut to powers of two.

Units are dealt to shards by content, so that lexical neighbours meet. A unit's weighted terms (log frequency times inverse document
frequency) are projected to DIMS numbers, and the nearest of at most TOPICS centres, one for SHARD_UNITS units, names its topic. Centres are fitted on at most SAMPLE units, those with
the least hash; every unit is dealt by them. A topic of more than SHARD_UNITS units is split by a weighted min-hash of the terms: two units
get one hash with a probability that is the weighted Jaccard similarity of their terms. A hash that a large group of copies shares is split by salt. A
seed asks its own shard alone, so that work grows with the units and not with their square; README.md has the measured agreement with a
search of all shards. Document frequencies and lengths are of all documents.

Edges: a null or empty text has END alone; a long document is encoded in parts of about PART bytes, cut between
words; rows that repeat a doc_id are packed each; an empty table gives an empty result. The order of units, which breaks ties, follows
the partitioning of the input.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcode.llm.common import _LOWER, buffers, chunks, joined_small, mixed, written

WINDOW = 2048
END = 1
#: Units of a shard, more or less: what a task has in memory at once.
SHARD_UNITS = 1024
#: Topics, the numbers that a unit is projected to, and the units that centres are fitted on.
TOPICS, DIMS, SAMPLE = 256, 32, 8192
#: Seeds that are scored together.
SEEDS = 32
#: Bytes of text that are encoded together, and runs that an encoder remembers.
PART, MEMO = 1 << 21, 400_000
K1, B = 1.2, 0.75
_U = np.uint64


# Kinds of bytes: 0 space or newline, 1 ASCII letter or digit, 2 ASCII sign but the apostrophe, 3 anything else.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, 0x0A]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[[x for x in range(33, 127) if not chr(x).isalnum() and x != 39]] = 2


class Encoder:
    """Token ids of whole batches. The text is cut into runs, and each distinct run is encoded once and remembered.

    Runs end at a space or newline, and between an ASCII letter or digit and an ASCII sign other than the apostrophe. The tokenizer drops
    white space, lower-cases, and never joins letters or digits with such a sign, so that the runs' ids are the text's. Where the text may
    hold a special token ("<|"), only white space cuts and letters stay as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        # The first run of all is END.
        self.ids = np.array([END], np.uint16)
        self.ends = np.array([0, 1], np.int64)

    def add(self, runs: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, runs])
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens)])

    def encoded(self, runs: pa.Array) -> np.ndarray:
        """Learns runs that are not known; where they stand."""
        at = np.zeros(len(runs), np.int64)
        letters = pc.and_(pc.utf8_is_alpha(runs), pc.invert(pc.match_substring(runs, "\u0130"))).to_numpy(zero_copy_only=False)
        if letters.any():
            # A run of letters is one word of the tokenizer, closed by a token of its own kind; many go in one text.
            plain = runs.filter(pa.array(letters))
            words = plain.to_pylist()
            got = self.fast([" ".join(words[i : i + 256]) for i in range(0, len(words), 256)], add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, np.uint16) for x in got])
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(words):
                at[letters] = len(self.known) + np.arange(len(words))
                self.add(plain, ids, np.diff(ends, prepend=0))
            else:
                letters[:] = False
        if not letters.all():
            other = runs.filter(pa.array(~letters))
            got = [x.ids for x in self.fast(other.to_pylist(), add_special_tokens=False)]
            at[~letters] = len(self.known) + np.arange(len(other))
            self.add(other, np.array([i for x in got for i in x], np.uint16), np.array([len(x) for x in got]))
        return at

    def only(self, at: np.ndarray) -> None:
        """Forgets all runs but these."""
        size = self.ends[at + 2] - self.ends[at + 1]
        stop = np.cumsum(size)
        source = np.repeat(self.ends[at + 1] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
        known, ids = self.known.take(pa.array(at)), self.ids[source]
        self.forget()
        self.add(known, ids, size)

    def learn(self, runs: pa.Array) -> np.ndarray:
        """Where each of the distinct runs stands in self.ends."""
        found = pc.index_in(runs, self.known)
        new = found.is_null().to_numpy(zero_copy_only=False)
        at = found.fill_null(0).to_numpy().astype(np.int64)
        if new.any():
            if len(self.known) + int(new.sum()) > MEMO:  # bounds the memory of a worker
                self.only(at[~new])
                at[~new] = np.arange(int((~new).sum()))
            at[new] = self.encoded(runs.filter(pa.array(new)))
        return at + 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of documents, each with END."""
        n_docs = len(offsets) - 1
        kind = _KIND[data]
        inside = kind != 0
        first, last = inside.copy(), inside.copy()
        apart = ~inside
        special = (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # <|
        if not special.any():
            data = _LOWER[data]
            step = kind[1:] * np.uint8(4) + kind[:-1]
            new = (step == 6) | (step == 9)  # 1 after 2, 2 after 1
            first[1:] &= apart[:-1] | new
            last[:-1] &= apart[1:] | new
        else:
            first[1:] &= apart[:-1]
            last[:-1] &= apart[1:]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        starts, lens = np.flatnonzero(first), np.flatnonzero(last) + 1
        lens -= starts
        before = np.searchsorted(starts, offsets)
        # Runs in a text without its gaps; each document closes with the run END.
        at = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data[inside])).dictionary_encode()
        which = self.learn(runs.dictionary)[runs.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
        which = np.insert(which, before[1:], 0)
        size = (self.ends[which + 1] - self.ends[which]).astype(np.int32)
        stop = np.cumsum(size)
        doc_end = before[1:] + np.arange(1, n_docs + 1)
        out_at = np.concatenate([[0], stop[doc_end - 1]])
        source = np.repeat((self.ends[which] - (stop - size)).astype(np.int32), size)
        source += np.arange(len(source), dtype=np.int32)
        return self.ids[source], out_at

    def documents(self, data: np.ndarray, offsets: np.ndarray):
        """(first document, ids, offsets) of parts of a batch; a long document is encoded in parts that end with a gap."""
        for i, j in chunks(offsets, PART):
            s, e = int(offsets[i]), int(offsets[j])
            if j - i > 1 or e - s <= 2 * PART:
                yield i, *self.encode(data[s:e], offsets[i : j + 1] - s)
                continue
            pieces = []
            while s < e:
                gaps = np.flatnonzero(_KIND[data[s + PART : e]] == 0) if e - s > 2 * PART else np.zeros(0, np.int64)
                cut = s + PART + int(gaps[0]) if len(gaps) else e
                ids, _ = self.encode(data[s:cut], np.array([0, cut - s]))
                pieces.append(ids if cut == e else ids[:-1])  # END stands after the last part only
                s = cut
            ids = np.concatenate(pieces)
            yield i, ids, np.array([0, len(ids)])


def encoder_of(path: str, held: dict = {}) -> Encoder:  # noqa: B006
    """A worker's encoder, which the tasks it runs share."""
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4"))


def tokenized(docs: DataFrame, tokenizer: str, window: int) -> DataFrame:
    """docs: doc_id, text. doc_id, doc_tokens, full_crcs (of the full windows), tail (ids as 16-bit bytes), and for the index
    the whole document's terms (distinct ids) and counts (of each, 32 bits)."""

    def run(batches):
        encoder = encoder_of(tokenizer)
        for b in batches:
            data, offsets = buffers(b.column("text"))
            for i, ids, at in encoder.documents(data, offsets):
                size = np.diff(at)
                n = len(size)
                crcs, tails, terms, counts = [], [], [], []
                pairs = (np.repeat(np.arange(n, dtype=np.uint32), size) << np.uint32(16)) | ids
                pairs.sort()
                new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
                tf = np.diff(np.append(new, len(pairs))).astype(np.uint32)
                pairs = pairs[new]
                own = np.searchsorted(pairs >> np.uint32(16), np.arange(n + 1)).tolist()
                term = pairs.astype(np.uint16)
                for k, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    full = (e - s) // window
                    crcs.append([crc(ids[s + k * window : s + (k + 1) * window]) for k in range(full)])
                    tails.append(ids[s + full * window : e].tobytes())
                    terms.append(term[own[k] : own[k + 1]].tobytes())
                    counts.append(tf[own[k] : own[k + 1]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, n), pa.array(size.astype(np.int64)), pa.array(crcs, pa.list_(pa.int64())), *(pa.array(x, pa.binary()) for x in (tails, terms, counts))],
                    names=["doc_id", "doc_tokens", "full_crcs", "tail", "terms", "counts"],
                )

    return docs.mapInArrow(run, "doc_id long, doc_tokens long, full_crcs array<long>, tail binary, terms binary, counts binary")


def slices(batch: pa.RecordBatch, rows: int = 512):
    """A batch in parts, so that temporaries stay small."""
    for s in range(0, batch.num_rows, rows):
        yield batch.slice(s, rows)


def bags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, counts, where each unit's begin) of units."""
    data, at = buffers(batch.column("terms"))
    return data.view(np.uint16), buffers(batch.column("counts"))[0].view(np.uint32), at // 2


def frequencies(units: DataFrame) -> DataFrame:
    """id, df, n: in how many units a token id stands and how often; as many rows as the vocabulary has, at most."""

    def run(batches):
        df, n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for b in batches:
            for part in slices(b):
                ids, tf, _ = bags(part)
                df += np.bincount(ids, minlength=1 << 16)
                n += np.bincount(ids, tf, 1 << 16).astype(np.int64)
        which = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(df[which]), pa.array(n[which])], names=["id", "df", "n"])

    return units.select("terms", "counts").mapInArrow(run, "id int, df long, n long").groupBy("id").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def directions() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((1 << 16, DIMS), np.float32)


def placed(terms: np.ndarray, counts: np.ndarray, at: np.ndarray, idf: np.ndarray, towards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a vector of length 1, a weighted min-hash) of each unit; every unit has a term."""
    weight = (np.log1p(counts) * idf[terms]).astype(np.float32) + np.float32(1e-6)
    vectors = np.add.reduceat(towards[terms] * weight[:, None], at[:-1])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9
    # Exponential clocks: the first to ring is a term drawn by its weight, and the same one where units are alike.
    u = (mixed(terms.astype(_U) + _U(0x5DEECE66D)) >> _U(11)).astype(np.float64) / 2**53
    clock = -np.log(u + 2**-54) / weight
    size = np.diff(at)
    least = np.minimum.reduceat(clock, at[:-1])
    hit = np.flatnonzero(clock == np.repeat(least, size))
    unit = np.repeat(np.arange(len(size)), size)[hit]
    first = np.concatenate([[True], unit[1:] != unit[:-1]])
    return vectors, mixed(terms[hit[first]].astype(_U) * _U(0x9E3779B97F4A7C15) + _U(1))


def fitted(vectors: np.ndarray, topics: int, rounds: int = 12) -> np.ndarray:
    """Centres of length 1 by spherical k-means; fewer where there are fewer different vectors."""
    different = np.unique(vectors, axis=0)
    if len(different) <= 1:
        return np.zeros((1, vectors.shape[1] if vectors.size else DIMS), np.float32)
    centres = different[np.random.default_rng(5).permutation(len(different))[:topics]].copy()
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            mine = vectors[own == k]
            if len(mine):
                centres[k] = mine.sum(axis=0) / (np.linalg.norm(mine.sum(axis=0)) + 1e-9)
    return centres.astype(np.float32)


def sampled(units: DataFrame, n: int, idf: np.ndarray) -> np.ndarray:
    """The vectors of the SAMPLE units of n with the least hashes. Those above twice the share that is wanted are left out where they stand."""
    shared = units.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        towards = directions()
        for b in batches:
            for part in slices(b):
                vectors, _ = placed(*bags(part), shared.value, towards)
                yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array([x.tobytes() for x in vectors], pa.binary())], names=["uid", "vector"])

    order = F.pmod(F.xxhash64("uid"), F.lit(1_000_000))
    few = units.where(order < int(min(1.0, 2 * SAMPLE / n) * 1_000_000) + 1).select("uid", "terms", "counts")
    rows = few.mapInArrow(run, "uid long, vector binary").orderBy(order, "uid").limit(SAMPLE).toArrow()
    return np.frombuffer(b"".join(rows["vector"].to_pylist()), np.float32).reshape(-1, DIMS)


def dealt(units: DataFrame, idf: np.ndarray, centres: np.ndarray) -> DataFrame:
    """units with topic and mh."""
    shared = units.sparkSession.sparkContext.broadcast((idf, centres))

    def run(batches):
        idf, centres = shared.value
        towards = directions()
        for b in batches:
            for part in slices(b):
                vectors, mh = placed(*bags(part), idf, towards)
                topic = (vectors @ centres.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(topic), pa.array((mh >> _U(1)).astype(np.int64))], names=[*part.schema.names, "topic", "mh"])

    return units.mapInArrow(run, ", ".join(f"{x} {t}" for x, t in units.dtypes) + ", topic int, mh long")


class Shard:
    """The postings of some units. Terms of many units are rows of a matrix, the others lists."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, at: np.ndarray, idf: np.ndarray, mean: float):
        self.n = n = len(at) - 1
        self.terms, self.own = terms, at
        unit = np.repeat(np.arange(n), np.diff(at))
        tf = counts.astype(np.float64)
        size = np.bincount(unit, tf, n)
        weight = (idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[unit] / mean))).astype(np.float32)
        by_term = np.argsort(terms, kind="stable")
        self.unit, self.weight = unit[by_term], weight[by_term]
        df = np.bincount(terms, minlength=1 << 16)
        self.at = np.concatenate([[0], np.cumsum(df)])
        common = np.flatnonzero(df > max(n // 32, 1))
        self.row = np.full(1 << 16, -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), n), np.float32)
        row = self.row[terms[by_term]]
        self.dense[row[row >= 0], self.unit[row >= 0]] = self.weight[row >= 0]

    def scores(self, seeds: list[int]) -> np.ndarray:
        """A row for each seed: the score of every unit for all the seed's terms."""
        asked = [self.terms[self.own[x] : self.own[x + 1]] for x in seeds]
        seed, term = np.repeat(np.arange(len(seeds)), [len(x) for x in asked]), np.concatenate(asked)
        row = self.row[term]
        flags = np.zeros((len(seeds), len(self.dense)), np.float32)
        flags[seed[row >= 0], row[row >= 0]] = 1
        seed, term = seed[row < 0], term[row < 0].astype(np.int64)
        begin, n = self.at[term], self.at[term + 1] - self.at[term]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rare = np.bincount(np.repeat(seed, n) * self.n + self.unit[at], self.weight[at], len(seeds) * self.n)
        return np.round(flags @ self.dense + rare.reshape(len(seeds), self.n), 4)


def windows(shard: Shard, size: np.ndarray, window: int, put) -> np.ndarray:
    """Fills windows from one shard and returns what is left of each unit, less than a window together.
    put(unit, start, length, seed, offset) takes the pieces, starts from the tail's beginning."""
    left, begin = size.copy(), np.zeros(len(size), np.int64)
    total = int(left.sum())
    order = np.argsort(-size, kind="stable")
    scores: dict[int, np.ndarray] = {}

    for at, seed in enumerate(order.tolist()):
        if total < window:
            break
        if not left[seed]:
            continue
        if seed not in scores:
            ahead = order[at:]
            asking = ahead[left[ahead] > 0][:SEEDS].tolist()
            scores = dict(zip(asking, shard.scores(asking), strict=True))
        score = np.where(left > 0, scores.pop(seed), -1)
        score[seed] = np.inf
        ranked = np.argsort(-score, kind="stable")
        full = np.cumsum(left[ranked])
        last = int(np.searchsorted(full, window))  # fills the window, and is cut if it does not fit
        offset = 0
        for u in ranked[: last + 1].tolist():
            length = min(int(left[u]), window - offset)
            if length:
                put(u, int(begin[u]), length, seed, offset)
                begin[u] += length
                left[u] -= length
                offset += length
        total -= window
    return left


def powers_of_two(left: np.ndarray, begin: np.ndarray, seq: int, put) -> None:
    """Cuts what is left, less than a window, to sequences of falling powers of two."""
    rest, total = np.flatnonzero(left).tolist(), int(left.sum())
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        offset = 0
        while offset < room:
            u = rest[0]
            length = min(room - offset, int(left[u]))
            put(u, int(begin[u]), length, seq, offset)
            begin[u] += length
            left[u] -= length
            offset += length
            if not left[u]:
                rest.pop(0)
        seq += 1


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: What a unit has left carries its tail and terms to the next round; a piece has none.
ROUND = PIECES + ", uid long, tail binary, terms binary, counts binary"
#: A sequence has the id of the unit that is its seed; those of full windows begin at FULL, those of the last rest at REST.
FULL, REST = 1 << 60, 1 << 61


def pack_shards(units: DataFrame, idf: np.ndarray, mean: float, window: int, last: bool) -> DataFrame:
    """units: doc_id, doc_tokens, tail, terms, counts, uid, shard."""
    shared = units.sparkSession.sparkContext.broadcast(idf)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("uid").combine_chunks()
        batch = t.to_batches()[0]
        data, at = buffers(batch.column("tail"))
        ids, tail_at = data.view(np.uint16), at // 2
        size = np.diff(tail_at)
        terms, counts, own = bags(batch)
        uid = batch.column("uid").to_numpy()
        out: list[tuple] = []
        put = lambda *x: out.append(x)
        left = windows(Shard(terms, counts, own, shared.value, mean), size, window, put)
        if last:
            powers_of_two(left, size - left, REST, put)
        unit, begin, length, seq, offset = (np.array([x[i] for x in out], np.int64) for i in range(5))
        first = tail_at[unit] + begin
        crcs = [crc(ids[s : s + n]) for s, n in zip(first.tolist(), length.tolist(), strict=True)]
        before = t.column("doc_tokens").to_numpy() - size  # ids in full windows
        rest = np.flatnonzero(left)
        rows = pa.array(np.concatenate([unit, rest]))
        nulls = lambda n, kind: pa.nulls(n, kind)
        tails = pa.array([ids[tail_at[u + 1] - left[u] : tail_at[u + 1]].tobytes() for u in rest.tolist()], pa.binary())
        binary = lambda x: pa.concat_arrays([nulls(len(unit), pa.binary()), x.cast(pa.binary())])
        with_rest = lambda x: pa.concat_arrays([pa.array(x, pa.int64()), nulls(len(rest), pa.int64())])
        return pa.Table.from_arrays(
            [
                batch.column("doc_id").take(rows),
                with_rest(before[unit] + begin),
                with_rest(length),
                with_rest(np.array(crcs, np.int64)),
                batch.column("doc_tokens").take(rows),
                with_rest(np.where(seq >= REST, seq, uid[np.minimum(seq, len(uid) - 1)])),
                with_rest(offset),
                batch.column("uid").take(rows),
                binary(tails),
                *(binary(batch.column(x).take(pa.array(rest))) for x in ("terms", "counts")),
            ],
            names=[x.split()[0] for x in ROUND.split(", ")],
        )

    return units.groupBy("shard").applyInArrow(run, ROUND)


def into_shards(units: DataFrame, idf: np.ndarray, centres: np.ndarray, shard_units: int) -> DataFrame:
    """units with shard: a topic, a part of it, and a salt."""
    # Three numbers for each unit, and TOPICS counts.
    keys = written(dealt(units.select("uid", "terms", "counts"), idf, centres).select("uid", "topic", "mh"), "topics")
    per_topic = keys.groupBy("topic").agg(F.count("*").alias("n"))
    place = F.struct("topic", F.floor(F.col("mh") / float(1 << 63) * F.ceil(F.col("n") / shard_units)).alias("part"))
    parts = lambda df: df.join(F.broadcast(per_topic), "topic").withColumn("place", place)
    # A part that many copies share is dealt by salt.
    heavy = parts(keys).groupBy("place").agg(F.count("*").alias("of")).where(F.col("of") > 2 * shard_units)
    heavy = written(heavy.select("place", F.ceil(F.col("of") / shard_units).alias("salts")), "heavy")
    salted = joined_small(parts(dealt(units, idf, centres)), heavy, "place", 100_000)
    salt = F.coalesce(F.pmod(F.xxhash64("uid"), F.col("salts")), F.lit(0).cast("long"))
    return salted.select(*units.columns, F.struct("place", salt.alias("salt")).alias("shard"))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard_units: int = SHARD_UNITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tokens = written(tokenized(rows, tokenizer, window).withColumn("uid", F.monotonically_increasing_id()), "tokens")
    units = tokens.drop("full_crcs").where("octet_length(tail) > 0")
    # The vocabulary bounds what comes to the driver.
    n, total = tokens.agg(F.count("*"), F.sum("doc_tokens")).first()
    idf = np.zeros(1 << 16)
    for r in frequencies(tokens).collect():
        idf[r["id"]] = np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))
    mean = max((total or 0) / max(n, 1), 1.0)

    pieces = tokens.select(
        "doc_id",
        (F.posexplode("full_crcs").alias("k", "ids_crc32")),
        "doc_tokens",
    ).select(
        "doc_id",
        (F.col("k").cast("long") * window).alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.monotonically_increasing_id() + FULL).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    before = None
    while True:
        n, ids = units.agg(F.count("*"), F.sum(F.octet_length("tail") / 2)).first()
        if not n:
            return pieces
        if before and n > before / 2:
            shard_units *= 2
        # A shard of short tails has more of them, so that it fills some windows.
        per_shard = max(shard_units, int(8 * window * n / ids))
        before = n
        last = n <= per_shard
        if last:
            sharded = units.withColumn("shard", F.lit(0))
        else:
            centres = fitted(sampled(units, n, idf), min(TOPICS, n // per_shard))
            sharded = into_shards(units, idf, centres, per_shard)
        packed = written(pack_shards(sharded, idf, mean, window, last), "packed")
        pieces = pieces.unionByName(packed.where("sequence_id is not null").select(pieces.columns))
        if last:
            return pieces
        units = packed.where("sequence_id is null").select(units.columns)
