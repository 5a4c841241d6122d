"""WARC: archives with an index, and coalesced byte-range reads of selected records.

Pages become gzip members in a map-side pass, meet one row per repeated digest in a join that can
split a hot digest, and are appended to one archive per task. The index (file, offset, length, URL,
digest) is a table of its own, written first; a reader takes any selection of its rows, sorts them
by file and offset, and reads neighbours in one request.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of, shared_dir, text_column

DATE = "1970-01-01T00:00:00Z"  # reruns write equal bytes
INDEX = "page_id long, url string, digest string, type string, file string, offset long, length long"
MEMBER = "page_id long, url string, sha1 string, digest string, n_bytes long, member binary"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _header(kind: str, page_id, url: str, digest: str, n_bytes: int, refers, length: int) -> bytes:
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{clean}')}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {n_bytes}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers}"]
    return ("\r\n".join([*lines, "Content-Type: text/html", f"Content-Length: {length}"]) + "\r\n\r\n").encode()


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page as the gzip member of a response record, before the shuffle, which then moves compressed bytes."""
    for b in batches:
        rows = []
        for i, u, sha1, h in rows_of(b, "page_id", "url", "sha1", "payload"):
            d = base64.b32encode(bytes.fromhex(sha1)).decode()
            rows.append((d, len(h), _gzip(_header("response", i, u, d, len(h), None, len(h)) + h + b"\r\n\r\n")))
        digests, sizes, members = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], b["sha1"], pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(members, pa.binary())], ["page_id", "url", "sha1", "digest", "n_bytes", "member"])


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Appends to this attempt's own file; only the index of a finished attempt names it."""
        fs, base = pafs.FileSystem.from_uri(root)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        out, at = None, 0
        try:
            for b in batches:
                rows = []
                for i, u, d, n, m, first, keeper in rows_of(b, "page_id", "url", "digest", "n_bytes", "member", "first", "keeper"):
                    kind = "response" if first else "revisit"
                    data = m if kind == "response" else _gzip(_header(kind, i, u, d, n, "" if keeper is None else keeper, 0) + b"\r\n\r\n")
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(data)
                    rows.append((i, u, d, kind, f"{root}/{name}", at, len(data)))
                    at += len(data)
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["page_id", "url", "digest", "type", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return write


def write(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write one record per row of pages (page_id, url, html); returns the index.

    The payload is the html in UTF-8, a null one empty. Of equal payloads of least_bytes or more, the
    one with the largest page_id is a response and the others revisit it; rows that tie in page_id
    tie-break by URL, and of wholly equal rows one is the response. Null page_ids come before all
    others. An empty table writes nothing. Digests are counted before the shuffle; the join meets only
    those found twice, and adaptive execution broadcasts them or splits a hot one, by actual size.
    """
    root = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    root = root if "://" in root else re.sub("^file:/*|^/*", "file:///", root)
    payload = F.encode(text_column("html"), "UTF-8")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    hashed = slim.withColumn("sha1", F.sha1("payload"))
    order = F.struct(F.coalesce(F.col("page_id"), F.lit(-(2**63))).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"))
    per = hashed.where(F.octet_length("payload") >= least_bytes).groupBy("sha1", order.alias("o")).agg(F.count("*").alias("n"), F.max("page_id").alias("id"))
    per = per.groupBy("sha1").agg(F.sum("n").alias("total"), F.max(F.struct("o", "n", "id")).alias("top")).where("total > 1")
    repeated = materialize(per.select(F.col("sha1").alias("d"), F.col("top.o").alias("top"), F.col("top.id").alias("keeper"), F.col("top.n").alias("ties")), "warc-repeated")

    def roles(rows: DataFrame) -> DataFrame:
        met = rows.select("page_id", "url", "sha1", "payload").mapInArrow(_members, MEMBER).join(repeated, F.col("sha1") == F.col("d"), "left")
        first = F.col("d").isNull() | (order == F.col("top"))
        return met.select("page_id", "url", "digest", "n_bytes", "member", first.alias("first"), "keeper", F.coalesce("ties", F.lit(1)).alias("ties"))

    met = roles(hashed)
    if repeated.where("ties > 1").limit(1).count():  # wholly equal rows at the top: one stays a response
        tied = roles(hashed.join(repeated.where("ties > 1").select("d"), F.col("sha1") == F.col("d"), "left_semi")).where("first and ties > 1")
        tied = tied.groupBy("page_id", "url", "digest", "n_bytes", "keeper", "ties").agg(F.max("member").alias("member"), F.count("*").alias("c"))
        tied = tied.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("c").cast("int")))).withColumn("first", F.col("i") == 1)
        met = met.where("not first or ties = 1").unionByName(tied.select(met.columns))
    return materialize(met.drop("ties").mapInArrow(_writer(root), INDEX), "warc-index")


def _parse(member: bytes) -> dict:
    raw = zlib.decompress(member, 31)
    head, _, body = raw.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    n = int(h["Content-Length"])
    payload = body[:n]
    if body[n:] != b"\r\n\r\n":
        raise ValueError(f"record of page {h['X-Page-Id']} has a wrong length")
    return h | {"payload": payload}


def _reader(gap: int, most: int):
    def read(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The records of one block of one file: sorted, runs with gaps up to `gap` read at once, at most `most` bytes a read."""
        import hashlib

        fs, _ = pafs.FileSystem.from_uri(key[0].as_py())
        path = pafs.FileSystem.from_uri(key[0].as_py())[1]
        want = sorted(zip(table["offset"].to_pylist(), table["length"].to_pylist()))
        rows = []
        with fs.open_input_file(path) as f:
            k = 0
            while k < len(want):
                begin, end, j = want[k][0], sum(want[k]), k + 1
                while j < len(want) and want[j][0] - end <= gap and sum(want[j]) - begin <= most:
                    end, j = max(end, sum(want[j])), j + 1
                data = f.read_at(end - begin, begin)
                for o, n in want[k:j]:
                    h = _parse(data[o - begin : o - begin + n])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(h["payload"]).digest()).decode() != digest:
                        raise ValueError(f"payload of page {h['X-Page-Id']} doesn't match its digest")
                    number = lambda k: int(h[k]) if h.get(k) else None
                    rows.append((number("X-Page-Id"), h["WARC-Target-URI"], int(h["X-Payload-Length"]), digest, h["WARC-Type"], number("X-Refers-To-Page"), h["payload"]))
                k = j
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        cols = list(zip(*rows)) or [()] * 7
        return pa.table([pa.array(x, t) for x, t in zip(cols, kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return read


def read(index: DataFrame, gap: int = 64 << 10, block: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """The records that a selection of index rows names. Groups are blocks of a file, so bounded by `block` plus one record."""
    slim = index.select("file", "offset", "length", F.floor(F.col("offset") / block).alias("block"))
    out = slim.groupBy("file", "block").applyInArrow(_reader(gap, block), RECORD)
    return out if payloads else out.drop("payload")
