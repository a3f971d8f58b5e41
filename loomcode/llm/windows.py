"""Repeated windows of a corpus, found exactly without moving every window.

A window is W consecutive symbols (bytes, or hashes of words) of one document. Each window is
assigned to its minimizer: the K-symbol gram in it with the least hash. Consecutive windows with one
minimizer form a path (a super-window); two equal windows lie in paths with equal minimizer grams, at
equal offsets. So

1. each document yields one narrow row per path: a hash of the gram, a hash of the whole path; equal paths of documents that are read together (CHUNK bytes)
   are one row with their places, so that a passage that very many documents have is far fewer rows than documents; the places of a repeated path stay in that
   row until a chunk's rows meet again, and come out as a row for each document;
2. paths whose gram occurs once in the corpus hold no repeated window, and go;
3. equal paths are counted as one, with their number and their least document;
4. only grams that stand in different paths have their windows looked at one by one. Classes of up to
   HOT paths meet in a task; the windows of a larger class are counted by a grouped aggregation, which
   adds up before it shuffles, so that no task gathers a class.

The result tells of each path which windows occur elsewhere, as runs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcode.llm.common import CHUNK, Hashes, buffers, byte_symbols, chunks, dropped, mixed, word_symbols, written

PLACES = "array<struct<doc_id:bigint,th:bigint,lo:int>>"
PATHS = f"chunk long, gram long, path long, n_win int, off int, n long, m long, p0 long, p1 long, n0 long, n1 long, places {PLACES}"
#: Distinct paths of one gram that a single task looks at.
HOT = 4096
_POS = np.uint64((1 << 24) - 1)
_U = np.uint64


def of_bytes(data: np.ndarray, offsets: np.ndarray):
    """(symbols, where documents begin in them, what a path's name is made of)."""
    return byte_symbols(data), offsets, data


def of_words(data: np.ndarray, offsets: np.ndarray):
    _, _, before, symbols = word_symbols(data, offsets)
    return symbols, before, symbols


def names_of(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of each stretch of raw, of another kind than the symbols' hashes, so that strings that are alike to those are told apart."""
    view, size = memoryview(np.ascontiguousarray(raw)).cast("B"), raw.itemsize
    one = xxhash.xxh3_64_intdigest
    return np.array([one(view[a:z]) for a, z in zip((lo * size).tolist(), (hi * size).tolist(), strict=True)], np.uint64)


def super_windows(symbols: np.ndarray, offsets: np.ndarray, W: int, K: int, raw: np.ndarray):
    """(document, first window's place, windows, minimizer's offset in the first window, gram, path) as arrays."""
    n, M = len(symbols), W - K + 1
    if n < W:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    h = Hashes(symbols)
    at = np.arange(n - K + 1)
    grams = h.of(at, at + K)
    pieces = [[], [], [], []]
    step = 1 << 22  # places fit in 24 bits, and temporaries stay small however long a document is
    for s in range(0, n - W + 1, step):
        e = min(s + step, n - W + 1)  # windows s to e - 1
        keys = (grams[s : e + M - 1] & ~_POS) | np.arange(e + M - 1 - s, dtype=np.uint64)
        m = len(keys)
        padded = np.full(-(-m // M) * M, 2**64 - 1, np.uint64)
        padded[:m] = keys
        blocks = padded.reshape(-1, M)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[: e - s], before[M - 1 : M - 1 + e - s])
        place = (least & _POS).astype(np.int64) + s
        first = np.arange(s, e)
        doc = np.searchsorted(offsets, first, "right") - 1
        ok = first + W <= offsets[doc + 1]
        first, place, doc = first[ok], place[ok], doc[ok]
        if not len(first):
            continue
        cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1)]))
        for x, y in zip(pieces, (doc[cut], first[cut], np.diff(np.append(cut, len(first))), place[cut]), strict=True):
            x.append(y)
    if not pieces[0]:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    doc, lo, n_win, place = (np.concatenate(x) for x in pieces)
    off = place - lo
    path = mixed(names_of(raw, lo, lo + n_win + W - 1) + off.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + n_win.astype(np.uint64))
    return doc, lo, n_win, off, grams[place], path


def grouped_paths(chunk: int, gram: np.ndarray, path: np.ndarray, n_win: np.ndarray, off: np.ndarray, lo: np.ndarray, before: np.ndarray, after: np.ndarray, ids: pa.Array, th: pa.Array) -> pa.RecordBatch:
    """A row of PATHS for each distinct path; ids, th, lo tell where each path stands."""
    order = np.lexsort((path, gram))
    g, p = gram[order], path[order]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])])) if len(order) else np.zeros(0, np.int64)
    take = pa.array(order)
    places = pa.StructArray.from_arrays([ids.take(take), th.take(take), pa.array(lo[order].astype(np.int32))], names=["doc_id", "th", "lo"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), places)
    ident = pc.fill_null(ids, 2**63 - 1).to_numpy(zero_copy_only=False)[order]  # a null doc_id stands after all others
    least = lambda x: np.minimum.reduceat(x, first) if len(first) else x[:0]
    most = lambda x: np.maximum.reduceat(x, first) if len(first) else x[:0]
    prev, next_ = before[order].view(np.int64), after[order].view(np.int64)
    columns = [
        np.full(len(first), chunk, np.int64), g[first].view(np.int64), p[first].view(np.int64), n_win[order][first].astype(np.int32), off[order][first].astype(np.int32), np.diff(np.append(first, len(order))),
        least(ident), least(prev), most(prev), least(next_), most(next_),
    ]
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), lists], names=[x.split()[0] for x in PATHS.split(", ")])


def find_paths(docs: DataFrame, symbols_of: Callable, W: int, K: int, linked: bool) -> DataFrame:
    """docs: doc_id, th, text. Distinct paths of each chunk: n of them, m their least document, p0 and p1 the least and the largest name of the paths before them in their
    documents, n0 and n1 of those after them (0 where there is none, or not linked)."""

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32  # a name of its own for each chunk
        for b in batches:
            ids, th = b.column("doc_id"), b.column("th")
            data, offsets = buffers(b.column("text"))
            for i, j in chunks(offsets):
                symbols, starts, raw = symbols_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                doc, lo, n_win, off, gram, path = super_windows(symbols, starts, W, K, raw)
                take = pa.array(doc + i)
                # The path after a path, and before it, in its document; 0 where there is none.
                follows = np.append((doc[1:] == doc[:-1]) & (lo[:-1] + n_win[:-1] == lo[1:]), False) if len(lo) else np.zeros(0, bool)
                after, before = np.zeros(len(path), np.uint64), np.zeros(len(path), np.uint64)
                if linked:
                    after[follows] = path[np.flatnonzero(follows) + 1]
                    before[np.flatnonzero(follows) + 1] = path[follows]
                chunk += 1
                yield grouped_paths(chunk, gram, path, n_win, off, lo - starts[doc], before, after, ids.take(take), th.take(take))

    return docs.mapInArrow(run, PATHS)


def runs_of(flags: np.ndarray, least: np.ndarray | None) -> list[dict]:
    """Maximal stretches of windows, [s, e), that occur elsewhere, by their least document if that is asked for."""
    if least is None:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
        return [{"s": int(s), "e": int(e), "m": None} for s, e in zip(edges[::2], edges[1::2], strict=True)]
    cut = np.append(np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])), len(least))
    return [{"s": int(s), "e": int(e), "m": int(least[s])} for s, e in zip(cut[:-1], cut[1:], strict=True) if flags[s]]


RUNS = "array<struct<s:int,e:int,m:long>>"
SPANS = "array<struct<s:int,e:int>>"
_RUNS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("m", pa.int64())]))


def spans_of(hits: pa.Table, by_least: bool) -> pa.Table:
    """A row for each document of a chunk that has repeated windows; hits: the chunk's repeated paths, with their places and runs."""
    hits = hits.combine_chunks()
    places, runs = (pa.concat_arrays(hits.column(x).chunks) for x in ("places", "runs"))
    n_places, n_runs = np.diff(places.offsets.to_numpy()), np.diff(runs.offsets.to_numpy())
    at, run = places.flatten(), runs.flatten()
    # Each place with each run of its path; no more than the chunk has windows.
    n = np.repeat(n_runs, n_places)
    ends = np.cumsum(n)
    place = np.repeat(np.arange(len(at)), n)
    which = np.repeat(np.repeat(np.cumsum(n_runs) - n_runs, n_places) - (ends - n), n) + np.arange(len(place))
    ident = pc.fill_null(at.field("doc_id"), 2**63 - 1).to_numpy(zero_copy_only=False)  # a null doc_id stands after all others
    if by_least:
        earlier = run.field("m").to_numpy(zero_copy_only=False)[which] < ident[place]
        place, which = place[earlier], which[earlier]
    null, th, lo = (x.to_numpy(zero_copy_only=False)[place] for x in (at.field("doc_id").is_null(), at.field("th"), at.field("lo")))
    s, e = (lo + run.field(x).to_numpy(zero_copy_only=False)[which] for x in ("s", "e"))
    keys = [ident[place], null, th, s, e]
    order = np.lexsort(keys[::-1])
    keys = [x[order] for x in keys]
    changes = [np.concatenate([[True], x[1:] != x[:-1]])[: len(order)] for x in keys]
    once = np.flatnonzero(np.logical_or.reduce(changes))
    first = np.flatnonzero(np.logical_or.reduce(changes[:3])[once])
    docs = at.take(pa.array(place[order][once][first]))
    spans = pa.StructArray.from_arrays([pa.array(x[once].astype(np.int32)) for x in keys[3:]], names=["s", "e"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(once)).astype(np.int32)), spans)
    return pa.table([docs.field("doc_id"), docs.field("th"), lists], names=["doc_id", "th", "spans"])


def compacted(found: DataFrame, one: DataFrame) -> DataFrame:
    """found (gram, path, runs) with chains of paths as one.

    A path that is repeated as a whole, and is always followed by one other such path which always follows it, is an edge to that: no other way
    enters or leaves the node between them, so that the places of the second are those of the first. Paths are linked by a join, chains
    are measured by doubling (a path knows how far it reaches with the path it points to), and a chain's first path stands for it.
    A chain cannot be a circle, since a document's last path is followed by none.
    """
    m = F.col("runs")[0]
    wide = found.join(one.where("n > 1").select("gram", "path", "n_win", "m", "n0", "n1", "p0", "p1"), ["gram", "path"])
    key = F.struct("gram", "path").alias("key")
    whole = written(wide.where((F.size("runs") == 1) & (m["s"] == 0) & (m["e"] == F.col("n_win")) & m["m"].eqNullSafe(F.col("m"))).select(key, "path", "n_win", "m", "n0", "n1", "p0", "p1"), "whole")
    leaves = whole.where("n0 = n1 and n0 <> 0").select("key", F.col("path").alias("from"), F.col("n0").alias("goes"))
    enters = whole.where("p0 = p1 and p0 <> 0").select(F.col("key").alias("to"), F.col("path").alias("goes"), F.col("p0").alias("from"))
    links = written(leaves.join(enters, ["from", "goes"]).select("key", "to"), "links")
    if links.isEmpty():
        return found
    members = links.select("key").union(links.select("to")).distinct()
    sized = whole.join(members, "key", "left_semi").select("key", F.col("n_win").cast("long").alias("reach"))
    reach = written(sized.join(links, "key", "left").select("key", "to", "reach"), "reach")
    while not reach.where("to is not null").isEmpty():
        ahead = reach.select(F.col("key").alias("to"), F.col("to").alias("far"), F.col("reach").alias("more"))
        longer = reach.join(ahead, "to", "left").select("key", F.col("far").alias("to"), (F.col("reach") + F.coalesce("more", F.lit(0))).alias("reach"))
        last, reach = reach, written(longer, "reach")
        dropped(last)
    heads = reach.join(links.select(F.col("to").alias("key")), "key", "left_anti").join(whole.select("key", "m"), "key")
    chain = F.array(F.struct(F.lit(0).alias("s"), F.col("reach").alias("e"), F.col("m").alias("m"))).cast(RUNS)
    rest = found.withColumn("key", F.struct("gram", "path")).join(members, "key", "left_anti").drop("key")
    return rest.unionByName(heads.select("key.gram", "key.path", chain.alias("runs")))


def repeated_windows(docs: DataFrame, symbols_of: Callable, W: int, K: int, by_least: bool, linked: bool = False) -> DataFrame:
    """doc_id, th, spans: for each document with any, an array of struct(s, e), windows [s, e) of it that are repeated.

    docs: doc_id, th (a hash of the text), text. A window is repeated if it starts at another place
    too; with by_least, if it starts in a document with a smaller doc_id. With linked, chains of repeated paths are compacted
    before they are looked up in documents.
    """
    paths = written(find_paths(docs, symbols_of, W, K, linked), "paths")
    # As a table, so that both sides of the join are plain exchanges and Spark can split a hot gram's partition.
    several = written(paths.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"), "grams")
    shared = written(paths.join(several, "gram", "left_semi"), "paths")
    dropped(paths)

    one = shared.groupBy("gram", "path").agg(
        F.sum("n").alias("n"), F.min("m").alias("m"), F.min(F.col("places")[0]).alias("at"), F.first("n_win").alias("n_win"), F.first("off").alias("off"),
        F.min("n0").alias("n0"), F.max("n1").alias("n1"), F.min("p0").alias("p0"), F.max("p1").alias("p1"),
    )
    n_paths = one.groupBy("gram").agg(F.count("*").alias("n_paths"))
    one = written(one.join(n_paths, "gram"), "classes")
    whole = F.array(F.struct(F.lit(0).alias("s"), F.col("n_win").alias("e"), F.col("m").alias("m")))
    single = one.where("n_paths = 1 and n > 1").select("gram", "path", whole.cast(RUNS).alias("runs"))

    # The windows of paths that differ and have a gram in common.
    want = one.where("n_paths > 1").groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.th").alias("th")).agg(
        F.collect_list(F.struct(F.col("at.lo").alias("lo"), "n_win", "off", "gram", "path", "n", "m", (F.col("n_paths") > HOT).alias("hot"))).alias("want")
    )
    texts = docs.alias("d")
    need = texts.join(want.alias("w"), (F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))) & (F.col("d.th") == F.col("w.th"))).select("d.text", "w.want")

    def windows(batches):
        for b in batches:
            data, offsets = buffers(b.column("text"))
            want = b.column("want")
            for i, j in chunks(offsets):
                symbols, starts, _ = symbols_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                part = want.slice(i, j - i)
                at = part.flatten()
                n_each = np.diff(part.offsets.to_numpy())
                lo = np.asarray(at.field("lo")).astype(np.int64) + np.repeat(starts[:-1], n_each)
                n_win = np.asarray(at.field("n_win")).astype(np.int64)
                ends = np.cumsum(n_win)
                first = np.repeat(lo - (ends - n_win), n_win) + np.arange(ends[-1] if len(ends) else 0)
                h = Hashes(symbols).of(first, first + W).view(np.int64)
                hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(h))
                yield pa.RecordBatch.from_arrays([at.field(x) for x in ("gram", "path", "off", "n", "m", "hot")] + [hashes], names=["gram", "path", "off", "n", "m", "hot", "wh"])

    looked = need.mapInArrow(windows, "gram long, path long, off int, n long, m long, hot boolean, wh array<long>")
    # A repeated row brings a path once for each copy.
    looked = written(looked, "windows")

    def classes(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            gram = t.column("gram").to_numpy()
            if not len(gram):
                continue
            last = int(np.searchsorted(-(gram != gram[-1]).astype(np.int8), 0)) if gram[0] != gram[-1] else 0
            held = t.slice(last)
            if last:
                yield from within(t.slice(0, last))
        if held is not None and len(held):
            yield from within(held)

    def within(t):
        t = t.combine_chunks()
        gram, path = t.column("gram").to_numpy(), t.column("path").to_numpy()
        edges = np.append(np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])), len(gram))
        # Whole classes, of about 2 million windows together.
        lists = t.column("wh").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        bounds = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy()
        off, n, m = (t.column(x).to_numpy() for x in ("off", "n", "m"))
        sizes = bounds[edges]
        i = 0
        while i < len(edges) - 1:
            j = max(int(np.searchsorted(sizes, sizes[i] + CHUNK, "right")) - 1, i + 1)
            a, z = edges[i], edges[j]
            # Copies of a row would count twice.
            once = np.concatenate([[True], (gram[a + 1 : z] != gram[a : z - 1]) | (path[a + 1 : z] != path[a : z - 1])])
            rows = np.arange(a, z)[once]
            lens = bounds[rows + 1] - bounds[rows]
            ends = np.cumsum(lens)
            row = np.repeat(np.arange(len(rows)), lens)
            inner = np.arange(ends[-1]) - np.repeat(ends - lens, lens)
            wh = flat[np.repeat(bounds[rows], lens) + inner].view(np.uint64)
            rel = (inner - np.repeat(off[rows], lens)).astype(np.int64)
            key = mixed(wh + rel.view(np.uint64) * _U(0xA0761D6478BD642F)) ^ gram[rows][row].view(np.uint64)
            order = np.argsort(key, kind="stable")
            sk = key[order]
            new = np.concatenate([[True], sk[1:] != sk[:-1]])
            group = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            count = np.add.reduceat(n[rows][row[order]], at)
            least = np.minimum.reduceat(m[rows][row[order]], at)
            flags, lows = np.empty(len(key), bool), np.empty(len(key), np.int64)
            flags[order] = (count > 1)[group]
            lows[order] = least[group]
            out = [runs_of(flags[e - k : e], lows[e - k : e] if by_least else None) for e, k in zip(ends, lens, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(gram[rows]), pa.array(path[rows]), pa.array(out, _RUNS)], names=["gram", "path", "runs"])
            i = j

    columns = ["gram", "path", "off", "n", "m", "wh"]
    few = looked.where("not hot").select(columns).repartition("gram").sortWithinPartitions("gram", "path").mapInArrow(classes, f"gram long, path long, runs {RUNS}")

    many = looked.where("hot").dropDuplicates(["gram", "path"]).select("gram", "path", "off", "n", "m", F.posexplode("wh").alias("i", "h")).withColumn("rel", F.col("i") - F.col("off"))
    counted = many.groupBy("gram", "rel", "h").agg(F.sum("n").alias("n_all"), F.min("m").alias("m_all")).where("n_all > 1")
    marked = many.join(counted, ["gram", "rel", "h"]).groupBy("gram", "path").agg(
        F.collect_list(F.struct(F.col("i").alias("s"), (F.col("i") + 1).alias("e"), F.col("m_all").alias("m"))).alias("runs")
    )
    found = single.unionByName(few.where("size(runs) > 0")).unionByName(marked.select("gram", "path", F.col("runs").cast(RUNS).alias("runs")))
    if linked:
        found = compacted(written(found, "found"), one)
    hits = shared.select("chunk", "gram", "path", "places").join(found, ["gram", "path"]).select("chunk", "places", "runs")
    spans = hits.groupBy("chunk").applyInArrow(lambda t: spans_of(t, by_least), f"doc_id long, th long, spans {SPANS}")
    # Rows that repeat a document in other chunks have the same spans.
    return spans.dropDuplicates(["doc_id", "th"])


def covered(spans: list, width: int) -> list[tuple[int, int]]:
    """Maximal stretches of symbols that the windows [s, e) of the given width cover, in order."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e - 1 + width)
        else:
            out.append([s, e - 1 + width])
    return [tuple(x) for x in out]


def with_hash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def joined_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    s = spans.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "spans")
    return docs.join(s, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left").drop("__id", "__th")
