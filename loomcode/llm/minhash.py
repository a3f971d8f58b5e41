"""Near duplicates by an inverted join on signature coordinates.

Each distinct shingle set (a class of documents) has a signature of COORDINATES min-hashes and is posted under its
(coordinate, value) pairs. Two sets of similarity 0.8 agree in 25.6 of 32 coordinates on average, and in fewer than
MATCHES with a probability of about 2e-6. Sets that agree in MATCHES coordinates share one of the first
COORDINATES - MATCHES + 1 in any common order: postings are ordered by rising frequency, values that only
one set has are skipped, and only that prefix is joined.

A posting list is not paired with itself. First each set is compared with the least set of
each of its lists (a star), links are confirmed on the full shingle sets, and linked sets join. Lists whose sets are all
in one component are done. If others are longer than BLOCK sets, the sets of all others are posted anew, under the shingles of a prefix of the full set, rare ones first:
linked sets have the first shingle that they share in both prefixes, and where it stands bounds what they can share. Each is compared
with the set of these lists that can share most, which joins clouds of near copies; then a set stays in a list only if some set of another
component in it can be linked with it by that bound (narrowed; the old lists are kept if they are fewer rows). What stays is cut into blocks of BLOCK sets, ordered by component, and pairs of
blocks are compared in a task each, on collision counts first and full sets then; a task returns a
spanning forest of the links found, at most a row for each set. So every link between different components is found,
while rows grow with the sets and not with the pairs.

Edges: a null text or one without words has an empty set, linked with nothing; fewer words than a
shingle make one shingle; equal sets are linked; rows that repeat a doc_id take part each with their own text, so that they can stand in two components;
a component is named by its least doc_id; rows without a doc_id take part, with a null component_id unless a document with an id
is reachable. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcode.llm.common import buffers, chunks, dropped, mixed, word_symbols, written

COORDINATES = 32
MATCHES = 14
BLOCK = 1024
#: Ranges of shingles whose frequencies order them; any order would do, a good one makes short lists.
RANGES = 1 << 16
_U = np.uint64
_A = np.random.default_rng(7).integers(0, 2**63, COORDINATES, dtype=np.uint64) * _U(2) + _U(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each document's distinct shingles in rising order."""
    _, _, before, symbols = word_symbols(data, offsets, lower=True)
    n_words = np.diff(before)
    n = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    ends = np.cumsum(n)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(before[:-1], n)
    stop = np.repeat(before[1:], n)
    h = np.full(len(first), 0x51ED270B, np.uint64)
    for k in range(width):
        here = first + k < stop
        w = symbols[np.minimum(first + k, max(len(symbols) - 1, 0))] if len(symbols) else h
        h = np.where(here, mixed(h * _U(0x2545F4914F6CDD1D) + w), h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """docs: doc_id, th (a hash of the text), text. doc_id, th, n_shingles, ka, kb (a 128-bit key of the set), sig (coordinate keys)."""

    def run(batches):
        top = (np.arange(COORDINATES, dtype=np.uint64) << _U(58))[None, :]
        for b in batches:
            data, offsets = buffers(b.column("text"))
            for i, j in chunks(offsets):
                h, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                n = np.diff(at)
                full = np.flatnonzero(n)
                ka, kb = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                sig = np.zeros((len(full), COORDINATES), np.uint64)
                if len(full):
                    ka[full] = np.add.reduceat(h, at[full])
                    kb[full] = np.add.reduceat(mixed(h), at[full])
                    for c in range(COORDINATES):
                        sig[:, c] = np.minimum.reduceat((h * _A[c]) ^ (h >> _U(29)), at[full])
                sig = (mixed(sig) >> _U(6)) | top
                lens = np.zeros(j - i, np.int64)
                lens[full] = COORDINATES
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(sig.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), b.column("th").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(ka.view(np.int64)), pa.array(kb.view(np.int64)), lists],
                    names=["doc_id", "th", "n_shingles", "ka", "kb", "sig"],
                )

    return docs.mapInArrow(run, "doc_id long, th long, n_shingles long, ka long, kb long, sig array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """docs: nid, text. nid, members: the sorted shingles as bytes."""

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column("text"))
            for i, j in chunks(offsets):
                h, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                raw = h.tobytes()
                yield pa.RecordBatch.from_arrays([b.column("nid").slice(i, j - i), pa.array([raw[8 * s : 8 * e] for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["nid", "members"])

    return docs.mapInArrow(run, "nid long, members binary")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs: a, b, set_a, set_b. The pairs whose full sets are alike."""

    def run(batches):
        for b in batches:
            x, y = b.column("set_a"), b.column("set_b")
            ok = [alike(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(x, y, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable), for the nodes of links (a, b), by alternating stars.

    Each round gives every node's larger neighbours, then its smaller ones, to the least of its neighbourhood;
    the number of rounds grows with the logarithm of a component's size.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        after = written(small.select("x.u", "x.v").where("u <> v").distinct(), "links")
        stats = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        same = stats(after) == stats(edges)
        dropped(edges)
        edges = after
        if same:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def forest(pairs, linked) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that linked() confirms; pairs that are connected already are not looked at."""
    top: dict = {}

    def find(x):
        while top.get(x, x) != x:
            top[x] = x = top.get(top[x], top[x])
        return x

    out = []
    for x, y in pairs:
        p, q = find(x), find(y)
        if p != q and linked(x, y):
            top[p] = q
            out.append((x, y))
    return out


def block_links(t: pa.Table, percent: int) -> pa.Table:
    """Links between sets of different components in one pair of blocks; side 0 or 1, or both sides in one block."""
    side, nid, comp = (t.column(x).to_numpy() for x in ("side", "nid", "comp"))
    sig = np.asarray(t.column("sig").combine_chunks().flatten()).reshape(len(nid), COORDINATES)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("members")]
    size = np.array([len(x) for x in sets])
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    one = right is left

    def pairs():
        for s in range(0, len(left), 64):
            rows = left[s : s + 64]
            same = np.zeros((len(rows), len(right)), np.uint8)
            for c in range(COORDINATES):
                same += sig[rows, c][:, None] == sig[right, c][None, :]
            a, b = size[rows][:, None], size[right][None, :]
            ok = (same >= MATCHES) & (comp[rows][:, None] != comp[right][None, :]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
            x, y = np.nonzero(ok)
            x, y = rows[x], right[y]
            keep = nid[x] < nid[y] if one else np.ones(len(x), bool)
            yield from zip(x[keep].tolist(), y[keep].tolist(), strict=True)

    found = forest(pairs(), lambda i, j: alike(sets[i], sets[j], percent))
    return pa.table({"a": pa.array(nid[[p for p, _ in found]] if found else [], pa.int64()), "b": pa.array(nid[[q for _, q in found]] if found else [], pa.int64())})


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """sets: nid, comp, members. nid, comp, n (the set's size), gram, reach: the shingles, rare ones first, among which the first one shared with any linked set is.

    With i shingles of n before it, sets that have this one as their first in common share n - i at most; linked sets share percent / (100 + percent) of
    both sizes together, so that reach = 100 n - (100 + percent) i is at least percent times the size of the other.
    """

    def tally(batches):
        n = np.zeros(RANGES, np.int64)
        for b in batches:
            data, _ = buffers(b.column("members"))
            n += np.bincount((data.view(np.uint64) >> _U(48)).astype(np.int64), minlength=RANGES)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["range", "n"])

    counts = np.zeros(RANGES, np.int64)
    for r in sets.mapInArrow(tally, "range long, n long").groupBy("range").agg(F.sum("n").alias("n")).collect():
        counts[r["range"]] = r["n"]
    rank = np.empty(RANGES, np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(RANGES, dtype=np.uint64)

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column("members"))
            for i, j in chunks(offsets):
                h = data[offsets[i] : offsets[j]].view(np.uint64)
                n = np.diff(offsets[i : j + 1]) // 8
                doc = np.repeat(np.arange(j - i), n)
                gram = (rank[(h >> _U(48)).astype(np.int64)] << _U(48)) | (h & _U((1 << 48) - 1))
                gram = gram[np.lexsort((gram, doc))]
                place = np.arange(len(gram)) - np.repeat(np.cumsum(n) - n, n)
                keep = np.flatnonzero(place <= (n - -(-n * percent // 100))[doc])
                of, size = pa.array(doc[keep] + i), n[doc[keep]]
                reach = 100 * size - (100 + percent) * place[keep]
                yield pa.RecordBatch.from_arrays(
                    [b.column("nid").take(of), b.column("comp").take(of), pa.array(size), pa.array(gram[keep].view(np.int64)), pa.array(reach)], names=["nid", "comp", "n", "gram", "reach"]
                )

    return sets.mapInArrow(run, "nid long, comp long, n long, gram long, reach long")


def narrowed(firsts: DataFrame, percent: int) -> DataFrame:
    """key, nid, comp: the lists of prefixes, without the sets that no set of another component in their list can be linked with.

    Of two linked sets the shorter one (either of equal ones) reaches its own size. So the longer one is held against the largest reach and the least size of such
    sets of other components, and these against the longer ones that stay.
    """
    shorter = firsts.where(F.col("reach") >= percent * F.col("n"))
    per = shorter.groupBy("gram", "comp").agg(F.max("reach").alias("reach"), F.min("n").alias("n"))
    best = per.groupBy("gram").agg(F.max(F.struct("reach", "comp")).alias("top"), F.min("n").alias("least"))
    other = per.join(best.select("gram", "top"), "gram").where("comp <> top.comp").groupBy("gram").agg(F.max("reach").alias("next"))
    bounds = best.join(other, "gram", "left")
    most = F.when(F.col("comp") != F.col("top.comp"), F.col("top.reach")).otherwise(F.col("next"))
    longer = written(firsts.join(bounds, "gram").where((most >= percent * F.col("n")) & (F.col("reach") >= percent * F.col("least"))).select("gram", "nid", "comp", "n", "reach"), "longer")
    met = longer.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("reach").alias("most"))
    shorter = shorter.join(met, "gram").where("lo <> comp or hi <> comp").where((F.col("reach") >= percent * F.col("least")) & (F.col("most") >= percent * F.col("n")))
    return longer.select(F.col("gram").alias("key"), "nid", "comp").union(shorter.select("gram", "nid", "comp")).distinct()


def mixed_lists(lists: DataFrame) -> DataFrame:
    """lists: key, nid, comp. The lists of several components, once where they have the same sets, with m, their sets."""
    several = lists.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.sum(F.xxhash64("nid").cast("decimal(38,0)")).alias("who")
    ).where("lo <> hi").dropDuplicates(["m", "who"]).select("key", "m")
    return written(lists.join(several, "key"), "postings")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs. Linked: 100 * common >= percent * union."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    signed = written(signatures(rows, width), "signatures")
    # A class of equal sets has a number, the least of its doc_ids, and a row whose text stands for it.
    of_set = signed.where("n_shingles > 0").groupBy("ka", "kb").agg(
        F.min("doc_id").alias("named"), F.min(F.struct("doc_id", "th")).alias("at"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")
    )
    one = written(of_set.withColumn("nid", F.monotonically_increasing_id()), "classes")
    classes = one.select("ka", "kb", "nid", "named")
    posted = one.select("nid", "n", F.explode("sig").alias("key"))
    frequent = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    shared = posted.join(frequent, "key").groupBy("nid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
    prefix = shared.where(F.size("keys") >= MATCHES).select("nid", "n", F.explode(F.expr(f"slice(keys, 1, size(keys) - {MATCHES - 1})")).alias("k")).select("nid", "n", F.col("k.key").alias("key"))
    lists = written(prefix, "postings")

    # Stars.
    heads = lists.groupBy("key").agg(F.min(F.struct("nid", "n")).alias("head"), F.count("*").alias("m")).where("m > 1")
    near = (F.col("head.n") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("head.n") * percent)
    stars = lists.join(heads, "key").where((F.col("head.nid") != F.col("nid")) & near).select(F.col("head.nid").alias("a"), F.col("nid").alias("b")).distinct()
    sigs = one.select("nid", "sig")
    matches = F.size(F.array_intersect("sig_a", "sig_b"))
    stars = (
        stars.join(sigs.select(F.col("nid").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(sigs.select(F.col("nid").alias("b"), F.col("sig").alias("sig_b")), "b")
        .where(matches >= MATCHES)
        .select("a", "b")
    )
    stars = written(stars, "stars")

    # The sets of what may be linked, from one text of each class.
    members = lists.join(heads.select("key"), "key", "left_semi").select("nid").distinct()
    stands = one.join(members, "nid", "left_semi").select("nid", F.col("at.doc_id").alias("own"), F.col("at.th").alias("own_th"))
    have = rows.join(stands, (F.col("th") == F.col("own_th")) & F.col("doc_id").eqNullSafe(F.col("own"))).dropDuplicates(["nid"]).select("nid", "text")
    sets = written(shingle_sets(have, width), "sets")
    side = lambda x: sets.select(F.col("nid").alias(x), F.col("members").alias(f"set_{x}"))
    links = written(confirmed(stars.join(side("b"), "b").join(side("a"), "a"), percent), "links")
    labels = components(links)

    # Lists with several components left.
    comp = F.coalesce(F.col("component"), F.col("nid")).alias("comp")
    labelled = lambda df: df.drop("comp").join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", comp).drop("component")
    open_lists = mixed_lists(written(labelled(lists.select("key", "nid")), "postings"))
    # Rows of the comparison below: each set of a list for each block.
    size_of = lambda df: df.agg(F.sum(F.ceil(F.col("m") / BLOCK)), F.max("m")).first()
    n_rows, longest = size_of(open_lists)
    if (longest or 0) > BLOCK:
        # Lists of many blocks: their sets, in lists by prefixes of the full sets.
        sets = written(open_lists.select("nid", "comp").distinct().join(sets, "nid"), "sets")
        firsts = written(prefixes(sets, percent), "prefixes")
        several = firsts.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram")
        firsts = written(firsts.join(several, "gram", "left_semi"), "prefixes")
        head = firsts.groupBy("gram").agg(F.max(F.struct("reach", "nid", "n", "comp")).alias("head"))
        near = (F.col("head.reach") >= percent * F.col("n")) & (F.col("reach") >= percent * F.col("head.n"))
        # A set is compared with one of its lists' heads, the one that can share most with others.
        best = firsts.join(head, "gram").where(near & (F.col("head.comp") != F.col("comp"))).groupBy("nid").agg(F.max(F.struct("head.reach", "head.nid")).alias("best"))
        stars = written(best.select(F.col("best.nid").alias("a"), F.col("nid").alias("b")), "stars")
        links = written(links.union(confirmed(stars.join(side("b"), "b").join(side("a"), "a"), percent)), "links")
        labels = components(links)
        fewer = mixed_lists(written(narrowed(written(labelled(firsts), "prefixes"), percent), "postings"))
        if (size_of(fewer)[0] or 0) < n_rows:
            open_lists = fewer
        else:
            open_lists = mixed_lists(written(labelled(open_lists.select("key", "nid")), "postings"))
    if open_lists.limit(1).count():
        # Components stand together in blocks; a component larger than a block has blocks of its own, as far as a hash deals it out evenly.
        per = open_lists.groupBy("key", "comp").agg(F.count("*").alias("size"))
        blocked = open_lists.join(per, ["key", "comp"]).withColumn(
            "block",
            F.when(F.col("size") > BLOCK, F.concat_ws(":", "comp", F.pmod(F.xxhash64("nid"), F.ceil(F.col("size") / BLOCK)).cast("string"))).otherwise(
                F.concat(F.lit("r"), F.pmod(F.xxhash64("comp", F.lit(1)), F.ceil(F.col("m") / BLOCK)).cast("string"))
            ),
        ).withColumn("only", F.when(F.col("size") > BLOCK, F.col("comp")))
        blocks = blocked.groupBy("key", "block").agg(F.first("only").alias("only"))
        other = blocks.select("key", F.col("block").alias("block2"), F.col("only").alias("only2"))
        # Pairs of blocks, and not of sets; two blocks of one component need no look.
        tasks = blocks.join(other, "key").where("block <= block2 and not coalesce(only = only2, false)").select("key", "block", "block2")
        tasks = tasks.withColumn("task", F.xxhash64("key", "block", "block2"))
        sides = tasks.select("key", "task", F.explode(F.array(F.struct(F.col("block"), F.lit(0).alias("side")), F.struct(F.col("block2").alias("block"), F.when(F.col("block") == F.col("block2"), -1).otherwise(1).alias("side")))).alias("x")).select("key", "task", "x.block", "x.side").where("side >= 0")
        work = blocked.select("key", "block", "nid", "comp").join(sides, ["key", "block"]).join(sigs, "nid").join(sets.select("nid", "members"), "nid")
        more = work.select("task", "side", "nid", "comp", "sig", "members").groupBy("task").applyInArrow(lambda t: block_links(t, percent), "a long, b long")
        labels = components(written(links.union(more), "links"))

    # From sets back to documents.
    of_class = classes.join(labels.withColumnRenamed("node", "nid"), "nid", "left").select("ka", "kb", "named", comp)
    least = of_class.groupBy("comp").agg(F.min("named").alias("least"))
    of_class = of_class.join(least, "comp").select("ka", "kb", "least")
    rows_out = signed.select("doc_id", "n_shingles", "ka", "kb").join(of_class, ["ka", "kb"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return rows_out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True) & F.col("doc_id").isNull() & component.isNull()).alias("kept"))
