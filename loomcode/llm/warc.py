"""Web archives: writing pages as WARC records, and reading them back with segments joined.

Writing: a page is a response record whose block is an HTTP response with chunked transfer framing; of pages with
equal payloads of at least REVISIT_BYTES bytes, only that with the largest page_id is stored, and the others are
revisit records. A block over `segment` bytes is cut into a record and continuations. Records are rows
of a text file set whose line separator is the two line ends that close a WARC record, so that Spark's own
writer puts them into any store. A file has at most RECORDS_PER_FILE records of at most `segment` bytes.

Reading: archive files are parsed record by record. Segments are grouped by the identifier of their first record and put in
the order of their numbers, by a sort inside partitions and not by gathering groups; the joined length is verified against
the total that the last segment states, the chunked framing is decoded, and the digest is verified.

Edges: a null html is an empty payload; a null url is an empty target; rows that agree in page_id and payload write equal
records, of which each is read back; a null page_id loses to all others; an empty table gives an empty result. A record
with segments missing, a wrong length, framing or digest has verified = false, and so has a revisit whose page was not read with that payload. What
is no record (a broken head, a length that is no number or not the block's, fields that are missing or no numbers) is a row of record_type damaged, with
the bytes that it takes up; reading goes on at the next record of the file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcode.llm.common import joined_small, shared_dir, written

REVISIT_BYTES = 1000
SEGMENT = 16_384
CHUNK_BYTES = 4096
RECORDS_PER_FILE = 2048
GROUPS_LIMIT = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id, digest: bytes, part: int = 1) -> str:
    name = b"%s|%s|%d" % (str(page_id).encode(), digest, part)
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(name).digest())}>"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def chunked(payload: bytes) -> bytes:
    pieces = []
    for i in range(0, len(payload), CHUNK_BYTES):
        x = payload[i : i + CHUNK_BYTES]
        pieces += [b"%x\r\n" % len(x), x, b"\r\n"]
    return b"".join([*pieces, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload, or null if the framing is broken."""
    at, pieces = 0, []
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if n == 0:
            return b"".join(pieces)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        pieces.append(body[at : at + n])
        at += n + 2


def safe(url: str | None) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")


def records_of(page_id, url: str | None, payload: bytes, refers_to, revisit: bool, segment: int) -> list[bytes]:
    sha = hashlib.sha1(payload).digest()
    own = record_id(page_id, sha)
    common = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", safe(url)), ("X-Page-Id", page_id), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha).decode()), ("Content-Type", "application/http; msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        extra = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, sha)), ("X-Refers-To-Page-Id", refers_to)]
        return [record(extra + common, block)]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [record([("WARC-Type", "response"), *common], block)]
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], pieces[0])]
    for k, x in enumerate(pieces[1:], 2):
        total = len(block) if k == len(pieces) else None
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, sha, k)), ("WARC-Date", DATE), ("WARC-Target-URI", safe(url)), ("WARC-Segment-Number", k), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Total-Length", total)], x))
    return out


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    groups = long.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    told = joined_small(rows, groups, "digest", GROUPS_LIMIT).drop("digest")

    def run(batches):
        for b in batches:
            out = []
            size = 0
            for page_id, url, payload, keeper in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("payload"), b.column("keeper").to_pylist(), strict=True):
                made = records_of(page_id, url, payload.as_py(), keeper, keeper is not None and page_id != keeper, segment)
                out += made
                size += sum(map(len, made))
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = told.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parsed(data: bytes):
    """(fields, block) of each record of an archive; (None, bytes) for a stretch that is none, up to where the next record begins."""
    at = 0
    while at < len(data):
        found = _record_at(data, at)
        if found is None:
            behind = data.find(b"\r\n\r\nWARC/", at)
            until = len(data) if behind < 0 else behind + 4
            yield None, data[at:until]
            at = until
        else:
            fields, start, stop = found
            yield fields, data[start:stop]
            at = stop + 4


def _record_at(data: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """(fields, start and end of the block) of a record that is whole."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or data[at : at + 5] != b"WARC/":
        return None
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    stop = end + 4 + int(length) if length.isascii() and length.isdigit() else -1
    # A record is closed by two line ends, but the last one of a file may not be.
    if stop < 0 or stop > len(data) or data[stop : stop + 4] not in (b"\r\n\r\n", b""):
        return None
    return fields, end + 4, stop


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"
ROWS = PAGES + ", origin string, segment int, total long, page string, digest string, block binary"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
_TYPES = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
_SCHEMA = pa.schema([(n, _TYPES[x.split()[1]]) for n, x in zip(_NAMES, ROWS.split(", "), strict=True)])


def finished(page: str | None, digest: str, block: bytes, whole: bool) -> dict:
    """The page of a joined response block."""
    head, sep, body = block.partition(b"\r\n\r\n")
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    sha = hashlib.sha1(payload or b"").digest()
    ok = whole and bool(sep) and payload is not None and digest == "sha1:" + base64.b32encode(sha).decode()
    return {"page_id": None if page is None else int(page), "payload_bytes": len(payload or b""), "payload_digest": sha.hex(), "record_type": "response", "verified": ok}


def row_of(fields: dict[str, str] | None, block: bytes) -> dict | None:
    """What a record tells: a page, or a segment of one; None for other kinds of record."""
    try:
        if fields is None:
            raise ValueError
        kind, page, digest = fields.get("warc-type"), fields.get("x-page-id"), fields.get("warc-payload-digest", "")
        if kind == "revisit":
            length = next((int(x[15:]) for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
            to = fields.get("x-refers-to-page-id")
            sha = base64.b32decode(digest.removeprefix("sha1:")).hex()
            return {"page_id": None if page in (None, "None") else int(page), "payload_bytes": length, "payload_digest": sha, "record_type": "revisit", "refers_to": None if to is None else int(to), "verified": length is not None}
        if kind == "response" and "warc-segment-number" not in fields:
            return finished(page, digest, block, True)
        if kind in ("response", "continuation"):
            first, total = kind == "response", fields.get("warc-segment-total-length")
            own = {"origin": fields["warc-record-id"] if first else fields["warc-segment-origin-id"], "segment": int(fields["warc-segment-number"]), "total": None if total is None else int(total)}
            return own | {"page": None if page is None else str(int(page)), "digest": digest, "block": block}
        return None
    except (ValueError, KeyError):  # of numbers, of base 32, and of fields that are missing
        return {"page_id": None, "payload_bytes": len(block), "payload_digest": hashlib.sha1(block).hexdigest(), "record_type": "damaged", "verified": False}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified: a row for each response, revisit or damaged stretch."""

    def parse(batches):
        for b in batches:
            for file in b.column("content"):
                rows, size = [], 0
                for f, block in parsed(file.as_py()):
                    row = row_of(f, block)
                    if row is None:
                        continue
                    rows.append(row)
                    size += len(row.get("block") or b"") + 100
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    def join(segments: list[dict]) -> list[dict]:
        """The pages of one origin's segments, in order; several if equal records were written."""
        first = segments[0]
        copies = max(sum(x["segment"] == first["segment"] for x in segments), 1)
        once = {x["segment"]: x for x in segments}
        last = once[max(once)]
        block = b"".join(once[k]["block"] for k in sorted(once))
        whole = sorted(once) == list(range(1, len(once) + 1)) and last["total"] == len(block)
        return [finished(once[min(once)]["page"], once[min(once)]["digest"] or "", block, whole)] * copies

    def reassemble(batches):
        held: list[dict] = []
        for b in batches:
            out = []
            for x in b.to_pylist():
                if held and held[0]["origin"] != x["origin"]:
                    out += join(held)
                    held = []
                held.append(x)
            yield pa.RecordBatch.from_pylist(out, _RESULT)
        if held:
            yield pa.RecordBatch.from_pylist(join(held), _RESULT)

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, ROWS)
    columns = [x.split()[0] for x in PAGES.split(", ")]
    done = rows.where("origin is null").select(columns)
    joined = rows.where("origin is not null").select("origin", "segment", "total", "page", "digest", "block")
    joined = joined.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(reassemble, PAGES)
    pages = written(done.unionByName(joined), "archived")
    # A revisit stands on the page that it names: one that was read, with this payload.
    read = pages.where("record_type = 'response' and verified").select(F.col("page_id").alias("to"), F.col("payload_digest").alias("of")).distinct().withColumn("there", F.lit(True))
    told = pages.where("record_type = 'revisit'").join(read, (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("of")), "left")
    told = told.withColumn("verified", F.col("verified") & F.coalesce("there", F.lit(False))).select(columns)
    return pages.where("record_type <> 'revisit'").unionByName(told)


_RESULT = pa.schema([_SCHEMA.field(i) for i in range(6)])


def archived_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
