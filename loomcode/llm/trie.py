"""Conversation prefix trie: what conversations share from their first turn on.

A node stands for a sequence of turns (role, text) and is named by a chained SHA-256: of its parent's name and its last turn. Every conversation is
exploded to its prefixes, which are grouped by (depth, digest) to the nodes; a node's ancestors are the prefixes of any conversation that starts with it.

Sums over subtrees would need each node exploded to all its ancestors, with rows that grow as the square of a conversation's length. But the nodes whose
smallest member is the same conversation c are one stretch of c's path, from some depth a(c) + 1 to its end (members can only go as depth grows). So a stretch is
exploded to its ancestors as a whole: these are the prefixes of c down to a(c), so that the explosion is as long as all turns together, whatever the shape of the trie. With
bytes(c, d), the bytes of c's first d turns, the sum over a subtree of (n_convs - 1) times the bytes of the last text is the sum, over the members c with
a(c) >= d, of bytes(c, a(c)) - bytes(c, d - 1): what c says from depth d on and somebody before it says too. A node's leaves are its members that own one.

Conversations are rebuilt, chained and exploded in one pass over sorted rows, a row at a time; texts go through no shuffle, only their digests. The ids of a node's ends
are joined in runs of at most RUN ids where a range partition puts them, and the runs are hashed in order as they come. A node that many conversations share is
summed partially before each shuffle, and the join that brings a node's smallest member to its prefixes is split by Spark where a node has many.

Edges: a null role or text is empty; a null turn is before all others, equal turns are ordered by their digests; conversations without turns, after rebuilding, end at the
root; rows without a conv_id belong to no conversation and are left out; families of negative ids are those of the floored quotient; repeated rows are turns each;
other columns are not read; very long texts are read once. An empty table gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcode.llm.common import parts, written

FAMILY = 5
#: A rebuilt conversation takes fewer turns than this from the head of its family.
HEADS = 9
#: Ids joined to one row.
RUN = 4096
ROOT = hashlib.sha256(b"").digest()
NOTHING = hashlib.sha256(b"").hexdigest()
PREFIXES = "conv_id long, depth long, digest binary, parent binary, bytes long, total long, last boolean"
BATCH = 16_384


def taken(conv_id: int) -> int:
    """How many turns of its family's head a conversation is rebuilt with."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def whole(conv_id: int) -> int:
    """No turns of another conversation."""
    return 0


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def tables(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def prefixes_of(rows: Iterator[tuple], heads: Callable[[int], int]) -> Iterator[tuple]:
    """The rows of PREFIXES, from (family, conv_id, digest, bytes) ordered by family, conversation and turn."""
    for family, own in groupby(rows, lambda r: r[0]):
        head: list[tuple] = []
        for conv_id, turns in groupby(own, lambda r: r[1]):
            h = heads(conv_id) if conv_id != family else 0
            yield from chained(conv_id, rebuilt(turns, head, h, conv_id == family))


def rebuilt(turns: Iterator[tuple], head: list[tuple], h: int, first: bool) -> Iterator[tuple]:
    """(digest, bytes) of a conversation's turns after the first h, behind the head's first h; the family's first one fills the head."""
    yield from head[:h]
    for i, (_, _, digest, n) in enumerate(turns):
        if first and i < HEADS - 1:
            head.append((digest, n))
        if i >= h:
            yield digest, n


def chained(conv_id: int, turns: Iterator[tuple]) -> Iterator[tuple]:
    row, total = (conv_id, 0, ROOT, None, 0, 0), 0
    for digest, n in turns:
        yield *row, False
        total += n
        row = (conv_id, row[1] + 1, hashlib.sha256(row[2] + digest).digest(), row[2], n, total)
    yield *row, True


def prefixes(turns: DataFrame, heads: Callable[[int], int] = taken) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, the empty one included; `total` counts the bytes of all its turns."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    own = own.withColumn("family", F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(FAMILY)))
    own = own.repartition(parts(turns.sparkSession), "family").sortWithinPartitions("family", "conv_id", F.col("turn").asc_nulls_first(), "digest")
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64()), ("total", pa.int64()), ("last", pa.bool_())])
    return own.select("family", "conv_id", "digest", "bytes").mapInArrow(lambda batches: tables(prefixes_of(rows_in(batches), heads), schema), PREFIXES)


def runs_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(digest, first, ids): ids of one digest joined by commas, RUN of them at most, from ordered (digest, conv_id)."""
    for digest, own in groupby(rows, lambda r: r[0]):
        held: list[int] = []
        for _, conv_id in own:
            held.append(conv_id)
            if len(held) == RUN:
                yield digest, held[0], ",".join(map(str, held))
                held = []
        if held:
            yield digest, held[0], ",".join(map(str, held))


def hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
    for digest, own in groupby(rows, lambda r: r[0]):
        state, between = hashlib.sha256(), b""
        for _, _, ids in own:
            state.update(between + ids.encode())
            between = b","
        yield digest, state.hexdigest()


def ends(paths: DataFrame) -> DataFrame:
    """digest, ends_sha256: a row for each node at which a conversation ends."""
    n = parts(paths.sparkSession)
    last = paths.where("last").select("digest", "conv_id").repartitionByRange(n, "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    schema = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    runs = last.mapInArrow(lambda b: tables(runs_of(rows_in(b)), schema), "digest binary, first long, ids string")
    runs = runs.repartition(n, "digest").sortWithinPartitions("digest", "first")
    digests = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])
    return runs.mapInArrow(lambda b: tables(hashed(rows_in(b)), digests), "digest binary, ends_sha256 string")


def owners(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """owner, shared (a(c), -1 where it owns the root), shared_bytes, above (the owner of its prefix at that depth), leaf (0 or 1): a row for each conversation."""
    # The root is a prefix of all conversations: its one row is joined apart.
    known = nodes.select(F.col("digest").alias("node"), F.col("conv_id").alias("first"), (F.col("n_ends") == F.col("n_convs")).alias("closed"), F.col("depth").alias("at"))
    below = paths.where("depth > 0").join(known.where("at > 0"), F.col("digest") == F.col("node"))
    top = paths.where("depth = 0").crossJoin(F.broadcast(known.where("at = 0")))
    every = below.unionByName(top)
    other = F.when(F.col("first") != F.col("conv_id"), F.struct("depth", "total", "first"))
    one = every.groupBy(F.col("conv_id").alias("owner")).agg(F.max(other).alias("s"), F.max(F.expr("cast(closed and last and first = conv_id as long)")).alias("leaf"))
    return one.select("owner", F.coalesce("s.depth", F.lit(-1)).cast("long").alias("shared"), F.coalesce("s.total", F.lit(0)).cast("long").alias("shared_bytes"), F.col("s.first").alias("above"), "leaf")


def prefix_trie(turns: DataFrame, heads: Callable[[int], int] = taken) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest: a row for each node.

    heads: how many turns of the first conversation of its family a conversation is rebuilt with; `whole` leaves conversations as they are.
    """
    paths = written(prefixes(turns, heads), "trie_prefixes")
    grouped = paths.groupBy("depth", "digest").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"), F.sum(F.col("last").cast("long")).alias("n_ends"))
    nodes = written(grouped, "trie_nodes")
    own = written(owners(paths, nodes), "trie_owners")
    held = paths.join(own, F.col("conv_id") == F.col("owner"))
    saved = F.when(F.col("depth") <= F.col("shared"), F.col("shared_bytes") - F.col("total") + F.col("bytes")).otherwise(0)
    facts = held.select("digest", F.col("leaf").alias("n_leaves"), saved.alias("saved_tokens"))
    facts = facts.unionByName(nodes.where("parent is not null").select(F.col("parent").alias("digest"), F.lit(1).cast("long").alias("n_children")), True)
    facts = facts.unionByName(ends(paths), True).unionByName(nodes.select("digest", "depth", "conv_id", "n_convs"), True)
    sums = facts.groupBy("digest").agg(
        F.max("depth").alias("depth"), F.max("conv_id").alias("conv_id"), F.max("n_convs").alias("n_convs"), F.coalesce(F.sum("n_children"), F.lit(0)).alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.coalesce(F.max("ends_sha256"), F.lit(NOTHING)).alias("ends_sha256"),
    )
    above = F.when(F.col("depth") - 1 > F.col("shared"), F.col("conv_id")).otherwise(F.col("above"))
    placed = sums.join(own, F.col("conv_id") == F.col("owner"))
    return placed.select("conv_id", "depth", F.when(F.col("depth") > 0, above).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "digest")
