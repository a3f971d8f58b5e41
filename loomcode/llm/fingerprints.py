"""Document fingerprints from a randomised edit embedding.

A pointer walks over a document's characters. At step j it stands on a character c and moves on or stays, as a random bit for
(j, c) says; the bits are the same for all documents. The characters that the pointer stands on make a string of twice the
document's length, and after an edit two walks soon meet again, so that texts at a small edit distance get strings at
a small Hamming distance. The fingerprint samples SLOTS places of that string, SLOT_BITS bits of the character there. The places
are spread over the whole string, however long, and nearly the same for nearly equal lengths: slot b samples
the place below twice the length at which a random sequence of its own is least. The bits repeat after PERIOD steps, and characters share 63
codes, so that strings that differ by such a pair of characters alone look equal; candidates are therefore verified on their texts.

Edges: a null text is empty, and its fingerprint is all padding; equal texts have equal fingerprints; rows that repeat a
doc_id follow each other in the order of their texts; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcode.llm.common import joined_small, parts, written

SLOTS = 256
PERIOD = 4096
#: Characters of texts that a worker walks over at a time.
BUFFER = 6_000_000
_BITS = np.random.default_rng(11).integers(0, 2, (PERIOD, 64)).astype(np.int32)
_BITS[:, 0] = 0  # padding
_SEED = 0x5BD1E995


def _places(limit: int, held: dict = {}) -> list[tuple[int, np.ndarray]]:  # noqa: B006
    """(place, slots): at which places a slot's random sequence has a new least value, up to limit.

    The gaps between such places are drawn directly: after place p, the next is below x with probability 1 - p / x.
    """
    if held.get("limit", 0) < limit:
        rng = np.random.default_rng(_SEED)
        found: dict[int, list[int]] = {}
        for b in range(SLOTS):
            p = 0
            while p < 1 << 40:
                found.setdefault(p, []).append(b)
                p = int((p + 1) / max(1 - rng.random(), 1e-12))
        held["all"] = sorted((p, np.array(s)) for p, s in found.items())
        held["limit"] = 1 << 40
    return held["all"]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """6-bit codes of all characters, each text followed by a padding 0; where each text begins."""
    lens = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = ((points * np.uint32(2654435761)) >> np.uint32(7)) % np.uint32(63) + np.uint32(1)
    out = np.zeros(int(lens.sum()) + len(texts), np.uint8)
    target = np.arange(len(points)) + np.repeat(np.arange(len(texts)), lens)
    out[target] = code
    return out, np.concatenate([[0], np.cumsum(lens + 1)])[:-1]


def walk(texts: list[str]) -> np.ndarray:
    """A row of SLOTS 6-bit values for each text."""
    if not texts:
        return np.zeros((0, SLOTS), np.uint8)
    codes, begin = codes_of(texts)
    lens = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lens, kind="stable")
    pointer = begin[order].astype(np.int32 if len(codes) < 2**31 else np.int64)
    steps = 2 * lens[order]
    prints = np.zeros((len(texts), SLOTS), np.uint8)
    places = _places(int(steps[0]))
    marks = [p for p, _ in places[: bisect.bisect_left(places, int(steps[0]), key=lambda x: x[0])]]
    slots = [s for _, s in places[: len(marks)]]
    rising = steps[::-1]
    k, active = 0, len(texts)
    here = np.empty(len(texts), np.uint8)
    move = np.empty(len(texts), np.int32)
    j = 0
    while j < steps[0]:
        # The number of texts that still walk changes at few steps.
        active = len(texts) - int(np.searchsorted(rising, j, "right"))
        until = int(steps[active - 1])
        p, h, m = pointer[:active], here[:active], move[:active]
        while j < until:
            np.take(codes, p, out=h, mode="clip")
            if k < len(marks) and marks[k] == j:
                prints[:active, slots[k]] = h[:, None]
                k += 1
            np.take(_BITS[j % PERIOD], h, out=m, mode="clip")
            np.add(p, m, out=p)
            j += 1
    out = np.empty_like(prints)
    out[order] = prints
    return out


_DIGITS = np.frombuffer(b"-ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+", np.uint8)


def text_form(prints: np.ndarray) -> list[str]:
    return [x.tobytes().decode() for x in _DIGITS[prints]]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns doc_id, text, fingerprint: a row for each document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            yield from _buffered(b)

    def _buffered(b):
        texts = b.column("text").to_pylist()
        i = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + len(texts[j]) <= BUFFER):
                n += len(texts[j])
                j += 1
            part = b.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(text_form(walk(texts[i:j])))], names=["doc_id", "text", "fingerprint"])
            i = j

    return rows.mapInArrow(run, "doc_id long, text string, fingerprint string")


def equal_slots(a: str, b: str):
    return F.aggregate(F.sequence(F.lit(1), F.lit(SLOTS)), F.lit(0), lambda acc, i: acc + (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))).cast("int"))


def band_slots(least: float) -> list[np.ndarray]:
    """The slots of each band: they are dealt to one band more than slots may differ, so that two fingerprints that agree in the share `least` of them
    have a whole band in common."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0, and 1 at most")
    differ = min(int(SLOTS * (1 - least) + 1e-9), SLOTS - 1)
    return np.array_split(np.random.default_rng(5).permutation(SLOTS), differ + 1)


def band_keys(least: float):
    """A key for each band of the column fingerprint."""
    return F.array(*(F.xxhash64(F.lit(i), *(F.substring("fingerprint", int(p) + 1, 1) for p in row)) for i, row in enumerate(band_slots(least))))


#: Fingerprints of a side that meet in a task.
BLOCK = 2048


def compared(asked: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """asked: q, fq; own: c, fingerprint, n, least_id. q, n_other, like, other_id, c: what a block of own has for a query, as the number of documents whose
    fingerprints agree in the share `least`, and the one that agrees most.

    Both sides meet in their bands. A band that many share is cut into blocks on both sides, and blocks are compared in pairs, so that rows grow
    with the fingerprints and blocks and not with the pairs of fingerprints. A pair counts in the first band that it has in common.
    """
    band = F.posexplode(band_keys(least)).alias("no", "band")
    left = asked.select("q", F.col("fq").alias("fingerprint")).select("q", band)
    right = own.select("c", "fingerprint").select("c", band)
    sized = lambda df, name: df.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias(name))
    parts_q = written(sized(left, "parts_q"), "bands")
    met = written(right.join(parts_q, "band"), "met")
    parts_c = sized(met, "parts_c")
    right = met.join(parts_c, "band").withColumn("bc", F.pmod(F.xxhash64("c"), F.col("parts_c"))).withColumn("bq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_q") - 1)))
    left = left.join(parts_q, "band").join(parts_c, "band").withColumn("bq", F.pmod(F.xxhash64("q"), F.col("parts_q"))).withColumn("bc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_c") - 1)))
    none = F.lit(None).cast("long")
    place = ["band", "bq", "bc", "no"]
    one = left.select(*place, F.lit(0).alias("side"), "q").join(asked, "q").select(*place, "side", F.col("q").alias("id"), F.col("fq").alias("fingerprint"), none.alias("n"), none.alias("least_id"))
    two = right.select(*place, F.lit(1).alias("side"), "c").join(own, "c").select(*place, "side", F.col("c").alias("id"), "fingerprint", "n", "least_id")
    rows = one.unionByName(two).repartition(4 * parts(own.sparkSession), "band", "bq", "bc").sortWithinPartitions("band", "bq", "bc", "side")
    slots = band_slots(least)

    def meet(t: pa.Table):
        """Groups of one place, in order."""
        key = [t.column(x).to_numpy() for x in place]
        codes = np.frombuffer("".join(t.column("fingerprint").to_pylist()).encode(), np.uint8).reshape(-1, SLOTS)
        side, ids = t.column("side").to_numpy(), t.column("id").to_numpy()
        n, least_id = t.column("n").fill_null(0).to_numpy(), t.column("least_id").fill_null(2**63 - 1).to_numpy()
        new = np.flatnonzero(np.concatenate([[True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])]))
        out = []
        for a, z in zip(new.tolist(), np.append(new[1:], len(ids)).tolist(), strict=True):
            cut = a + int((side[a:z] == 0).sum())
            no = int(key[3][a])
            for i in range(a, cut):
                like = (codes[cut:z] == codes[i]).mean(axis=1)
                near = np.flatnonzero((like >= least) & (ids[cut:z] != ids[i]))
                first = np.array([next(k for k, x in enumerate(slots) if (codes[cut + j][x] == codes[i][x]).all()) == no for j in near.tolist()], bool)
                near = near[first] if len(near) else near
                if len(near):
                    top = near[np.lexsort((least_id[cut + near], -like[near]))[0]] + cut
                    out.append((int(ids[i]), int(n[cut + near].sum()), float(like[top - cut]), int(least_id[top]), int(ids[top])))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["q", "n_other", "like", "other_id", "c"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not len(t):
                continue
            last = [t.column(x)[-1].as_py() for x in place[:3]]
            same = np.ones(len(t), bool)
            for x, v in zip(place[:3], last, strict=True):
                same &= t.column(x).to_numpy() == v
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = t.slice(cut)
            if cut:
                yield meet(t.slice(0, cut).combine_chunks())
        if held is not None and len(held):
            yield meet(held.combine_chunks())

    return rows.mapInArrow(run, "q long, n_other long, like double, other_id long, c long")


def nearest(docs: DataFrame, prints: DataFrame, least: float = 0.9, every: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_near, nearest_id, nearest_likeness, nearest_edit: for every document whose id is divisible by `every`, how many others have fingerprints
    that agree in the share `least` of the slots, the one that agrees most (the least id of those that do), and, verified on the texts, 1 less
    the share of their edit distance in the longer text. The distance is counted up to 1 - `least` of it; a text beyond has null.

    prints: doc_id, fingerprint, text_sha256. Candidates come by bands, which miss no pair; equal texts are one row until the end. A document with an
    equal text has that as its nearest.
    """
    own = prints.groupBy("text_sha256").agg(F.first("fingerprint").alias("fingerprint"), F.count("*").alias("n"), F.min("doc_id").alias("least_id"))
    own = written(own.withColumn("c", F.monotonically_increasing_id()), "classes")
    asking = prints.where(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("query_id"), "text_sha256")
    asked = written(own.join(asking.select("text_sha256").distinct(), "text_sha256").select(F.col("c").alias("q"), F.col("fingerprint").alias("fq"), "n"), "asked")
    best = compared(asked.select("q", "fq"), own.select("c", "fingerprint", "n", "least_id"), least).groupBy("q").agg(
        F.sum("n_other").alias("n_other"), F.max(F.struct("like", (-F.col("other_id")).alias("m"), "c")).alias("b")
    )
    other = F.nullif(-F.col("b.m"), F.lit(2**63 - 1))  # a class without an id
    best = written(best.select("q", "n_other", F.col("b.like").alias("like"), F.col("b.c").alias("c"), other.alias("other_id")), "best")
    # The texts of those pairs alone; a query's class and its nearest one are joined to documents by hash.
    need = best.select(F.explode(F.array("q", "c")).alias("c")).distinct().join(own.select("c", "text_sha256"), "c")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text.alias("text"), F.sha2(text, 256).alias("text_sha256"))
    texts = written(joined_small(texts, need, "text_sha256", 100_000).where("c is not null").dropDuplicates(["c"]).select("c", "text"), "texts")
    both = best.join(texts.select(F.col("c").alias("q"), F.col("text").alias("tq")), "q").join(texts, "c")
    # Few rows with much work each: many partitions, which stay as many.
    both = both.repartition(8 * parts(docs.sparkSession), "q", "c")
    longer = F.greatest(F.length("tq"), F.length("text"))
    most = F.floor(longer * (1 - least) + 1e-9).cast("int")
    edits = F.call_function("levenshtein", F.col("tq"), F.col("text"), most)
    judged = both.select("q", "n_other", "like", "other_id", F.when(longer == 0, 1.0).when(edits >= 0, 1 - edits / longer).alias("edit"))
    # A class of several equal texts is its own nearest one.
    twins = prints.join(asking.select("text_sha256").distinct(), "text_sha256").groupBy("text_sha256").agg(F.slice(F.array_sort(F.collect_set("doc_id")), 1, 2).alias("ids"))
    out = asking.join(twins, "text_sha256").join(own.select("text_sha256", F.col("c").alias("q"), F.col("n").alias("n_own")), "text_sha256").join(judged, "q", "left")
    return out.select(
        F.col("query_id").alias("doc_id"),
        (F.col("n_own") - 1 + F.coalesce("n_other", F.lit(0))).alias("n_near"),
        F.coalesce(F.try_element_at(F.filter("ids", lambda x: x != F.col("query_id")), F.lit(1)), F.col("other_id")).alias("nearest_id"),
        F.when(F.col("n_own") > 1, 1.0).otherwise(F.col("like")).alias("nearest_likeness"),
        F.when(F.col("n_own") > 1, 1.0).otherwise(F.col("edit")).alias("nearest_edit"),
    ).dropDuplicates(["doc_id"])


def count_below(x, cuts: list[int]):
    """How many of the rising cuts are below x, looked up in two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    k = max(int(len(cuts) ** 0.5), 1)
    groups = [cuts[i : i + k] for i in range(0, len(cuts), k)]
    among = lambda values: F.size(F.filter(values, lambda c: c < x))
    whole = among(F.lit([g[-1] for g in groups]).cast("array<long>"))
    nested = F.array(*(F.lit(g).cast("array<long>") for g in groups))
    return F.when(whole < len(groups), whole * k + among(F.get(nested, whole))).otherwise(len(cuts))


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text_sha256 string"


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, whose last third comes from the next document in falling order of doc_id.

    Documents are dealt to ranges of doc_id. The first document of a range also goes, as a guest, to the range before,
    where it follows the last one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(4 * parts(spark), 1)
    cuts = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)})
    # Ranges are numbered in falling order of doc_id; documents without an id come last.
    below = count_below(F.col("doc_id"), cuts)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - below).cast("int")
    order = F.struct(F.coalesce(-F.col("doc_id"), F.lit(2**63 - 1)).alias("o"), F.xxhash64("text").alias("h"))
    ranged = rows.select("doc_id", "text", bucket.alias("range"), order.alias("ord"))
    heads = sorted((r["range"], r["ord"]["o"], r["ord"]["h"]) for r in ranged.groupBy("range").agg(F.min("ord").alias("ord")).collect())  # a row for each range
    # The first range's head goes to the last range.
    goes = spark.createDataFrame([(r, o, h, heads[i - 1][0]) for i, (r, o, h) in enumerate(heads)], "range int, head_o long, head_h long, goes int")
    ranged = ranged.join(F.broadcast(goes), "range")
    guest = F.when((F.col("ord.o") == F.col("head_o")) & (F.col("ord.h") == F.col("head_h")), F.col("goes"))
    both = ranged.select(
        "doc_id", "text", "ord", F.explode(F.filter(F.array(F.struct(F.col("range").alias("to"), F.lit(False).alias("guest")), F.struct(guest.alias("to"), F.lit(True).alias("guest"))), lambda x: x["to"].isNotNull())).alias("x")
    ).select("doc_id", "text", "ord", "x.to", "x.guest")
    dealt = both.repartition("to").sortWithinPartitions("to", "guest", "ord").select("doc_id", "text", "to", "guest")

    def flush(group: list[tuple]) -> pa.RecordBatch:
        """group: (doc_id, text), and the one after the last."""
        texts = [t for _, t in group]
        edited = []
        for t, after in zip(texts[:-1], texts[1:], strict=True):
            cut = len(t) // 3
            edited.append(t[: len(t) - cut] + after[:cut])
        both = walk(texts + edited)
        own, other = both[: len(texts)], both[len(texts) :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _ in group[:-1]], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(text_form(own[:-1]), pa.string()),
                pa.array(text_form(other), pa.string()),
                pa.array(likeness(own[:-1], other)),
                pa.array(likeness(own[:-1], own[1:])),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts[:-1]], pa.string()),
            ],
            names=[x.split()[0] for x in EDITED.split(", ")],
        )

    def run(batches):
        held: list[tuple] = []
        size, at, done = 0, None, False
        for b in batches:
            for d, t, to, is_guest in zip(*(b.column(x).to_pylist() for x in ("doc_id", "text", "to", "guest")), strict=True):
                if to != at:
                    held, size, at, done = [], 0, to, False
                if done:  # copies of the guest
                    continue
                held.append((d, t))
                size += len(t)
                if len(held) > 1 and (is_guest or size > BUFFER):
                    yield flush(held)
                    held, size = [(d, t)], len(t)
                done = is_guest

    return dealt.mapInArrow(run, EDITED)
