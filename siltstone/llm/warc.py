"""WARC archives: a writer of gzip-member records and a salvage reader (operator 9).

Every task writes its own archives, one gzip member a record, to the shared folder and
lists them in a manifest row; files of a lost or repeated attempt are never in the
manifest, so they are never read. The reader takes an archive member by member. Where
a check fails (gzip checksum, truncated data, record header, block length, payload
digest) it looks for the next gzip member or ``WARC/`` version line from which a whole
record can be read, goes on from there, and reports the bytes in between as a gap.

Null html is an empty payload, null url leaves out the target URI, null page_id is kept
as null. Payloads of fewer than ``least`` bytes are always responses. Among equal
payloads all rows with the smallest page_id are responses, the others (null ids too)
revisit it. An empty table gives an empty table. Columns other than page_id, url and html aren't read.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Payloads below this many bytes are always stored.
LEAST = 100
#: An archive is closed when it has this many bytes, so that a reader can hold it.
ARCHIVE_BYTES = 16 << 20

_CHUNK = 1 << 16
_GZIP, _VERSION = b"\x1f\x8b\x08", b"WARC/"
_LINE = re.compile(rb"WARC/\d\.\d\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
#: The date of a record, types of records that are passed over, the revisit profile.
_DATE = "2000-01-01T00:00:00Z"
_OTHERS = ("warcinfo", "request", "metadata", "resource", "conversion", "continuation")
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

_READ = "kind string, path string, at long, size long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, reason string"


class Damaged(ValueError):
    """Bytes that aren't a whole valid record; ``plain`` has what a failed gzip member gave before."""

    plain = b""


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed; a revisit has the HTTP head alone."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    head += [f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {_PROFILE}"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _record_at(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the plain record that begins at ``at``."""
    if not data.startswith(_VERSION, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("header not ended")
    lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no content length")
    begin = stop + 4
    end = begin + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block length")
    return headers, data[begin:end], end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member that begins at ``at``, checksum included, and where it ends."""
    z, out, k = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if not (part := data[k : k + _CHUNK]):
                raise Damaged("truncated member")
            before = z.copy()
            out.append(z.decompress(part))
            k += len(part)
    except (zlib.error, Damaged) as e:
        failed = e if isinstance(e, Damaged) else Damaged(f"gzip: {str(e)[:60]}")
        if isinstance(e, zlib.error):  # what the last bytes gave before they failed
            with contextlib.suppress(zlib.error):
                for i in range(len(part)):
                    out.append(before.decompress(part[i : i + 1]))
        failed.plain = b"".join(out)
        raise failed from e
    return b"".join(out), k - len(z.unused_data)


def _checked(headers: dict[str, str], block: bytes) -> dict | None:
    """The fields of a record, None for one without a page; its payload must have the digest that its header states."""
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, stated = headers.get("warc-type"), headers.get("warc-payload-digest", "").removeprefix("sha256:")
    number = lambda k: int(v) if re.fullmatch(r"-?\d+", v := headers.get(k, "")) else None
    if kind == "response":
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        if stated and digest != stated:
            raise Damaged("payload digest")
    elif kind == "revisit":
        m = re.search(rb"(?im)^content-length: *(\d+)", head)
        digest, size = stated, int(m[1]) if m else None
    elif kind in _OTHERS:
        return None
    else:
        raise Damaged("record type")
    return {"page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page-id"), "payload": payload if kind == "response" else None}


def _records_of(plain: bytes, sure: bool) -> Iterator[tuple[int, int, dict | str]]:
    """(offset, bytes, fields or reason of a gap) of plain records. After a failure the search goes on at the next version line.

    Of bytes that no checksum covers (not ``sure``) only payloads with their stated digest count."""
    k, gap, reason = 0, None, ""
    while k < len(plain):
        try:
            headers, block, end = _record_at(plain, k)
            fields = _checked(headers, block)
            if not sure and (fields is None or fields["record_type"] != "response" or "warc-payload-digest" not in headers):
                raise Damaged("unchecked")
        except Damaged as e:
            if gap is None:
                gap, reason = k, str(e)
            m = _LINE.search(plain, k + 1)
            k = m.start() if m else len(plain)
            continue
        if gap is not None:
            yield gap, k - gap, reason
            gap = None
        if fields is not None:
            yield k, end - k, fields
        k = end
    if gap is not None:
        yield gap, len(plain) - gap, reason


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", offset, bytes, fields) or ("gap", offset, bytes, reason) for all of ``data``, in order.

    A gzip member has the offset and bytes of its own for all that is in it; a gap inside one says so in its reason. Of a member that
    fails its check, the records whose payloads have their stated digest are kept, and its bytes up to the next start are a gap.
    """
    at, gap, reason = 0, None, ""
    while at < len(data):
        found: list[tuple[str, int, int, dict | str]] = []
        try:
            if data.startswith(_GZIP, at):
                plain, end = _inflate(data, at)
                if not plain:
                    raise Damaged("empty member")
                for k, size, x in _records_of(plain, True):
                    found.append(("record", at, end - at, x) if isinstance(x, dict) else ("gap", at, end - at, f"in the member, {size} bytes at {k}: {x}"))
            else:
                headers, block, end = _record_at(data, at)
                if (fields := _checked(headers, block)) is not None:
                    found.append(("record", at, end - at, fields))
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            for _, _, x in _records_of(e.plain, False):
                if isinstance(x, dict):
                    yield "record", at, 0, x  # its bytes are the gap's
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, reason
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield "gap", gap, len(data) - gap, reason


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html (never null), digest, first (the page a revisit refers to, else null), revisit."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    same = pages.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    # only digests that occur again are joined; for a third of all rows under one digest the skew join splits the left side
    joined = pages.join(same.where("_n > 1 and _first is not null").select("digest", "_first"), "digest", "left")
    return joined.withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(), F.lit(False))).withColumn("first", F.when(F.col("revisit"), F.col("_first"))).drop("_first")


def write_warc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives of ``with_revisits`` rows below ``folder``; the manifest: path, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        done: list[tuple[str, int]] = []
        out, n, size = None, 0, 0
        for batch in batches:
            for page, url, html, digest, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, n, size = store.open_output_stream(path, compression=None), 0, 0
                out.write(raw := member(record_bytes(page, url, html.encode("utf-8"), digest, first, revisit)))
                n, size = n + 1, size + len(raw)
                if size >= archive_bytes:
                    out.close()
                    done.append((path.removeprefix(base + "/"), n))
                    out = None
        if out is not None:
            out.close()
            done.append((path.removeprefix(base + "/"), n))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])

    return pages.select("page_id", "url", "html", "digest", "first", "revisit").mapInArrow(run, "path string, records long")


def read_warc(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives that ``manifest`` (path, records) lists (kind: "record" or "gap").

    An archive with another number of records than its manifest row states (null: unknown) has a gap of no bytes at its end that says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("kind", pa.string()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("reason", pa.string())])
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{path}", compression=None) as f:
                    data = f.read()
                rows, found = [], 0
                for kind, at, size, x in salvage(data):
                    found += kind == "record"
                    row = {"kind": kind, "path": path, "at": at, "size": size} | (x if kind == "record" else {"reason": x})
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if records is not None and found != records:
                    rows.append({"kind": "gap", "path": path, "at": len(data), "size": 0, "reason": f"{found} records found, {records} written"})
                yield pa.RecordBatch.from_pylist(rows, schema)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "records").repartition(n, "path").mapInArrow(run, _READ)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    folder = common.scratch_path(spark, "warc")
    manifest = common.materialize(write_warc(with_revisits(common.table(spark, sf_dir, "pages")), folder), "manifest")
    # archives that were written just now must be whole: a gap fails the query instead of losing pages
    damaged = F.raise_error(F.concat_ws(" ", F.lit("damaged archive:"), "path", F.col("at").cast("string"), "reason"))
    records = read_warc(manifest, folder, payloads=False).where(F.when(F.col("kind") == "record", True).otherwise(damaged.cast("boolean")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows without archives.
OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS s FROM p),
f AS (SELECT s, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY s)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.s AS payload_digest,
       CASE WHEN f.first IS NOT NULL AND d.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS NOT NULL AND d.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.s = f.s AND d.n >= 100
"""
