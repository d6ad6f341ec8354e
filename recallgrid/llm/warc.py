"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Records are gzip members of their own, in files of bounded size. A task names its files after its attempt and
reports them; only files that committed tasks reported are read back, so files of lost or repeated attempts
never count.

The salvage reader checks each member (deflate stream, CRC and length) and each record (version line,
Content-Length, record end, payload digest). After a failed check it searches for the next valid member or
version line, in a damaged member for the next version line of what still inflates, goes on from there and
logs the bytes between as a quarantined gap. From a member that fails its own checks only records that their
payload digest vouches for are taken.

Edge cases: a null html is an empty payload; payloads under MIN_REVISIT bytes are never revisits; rows
that tie on page_id and payload are all responses; rows without page_id keep a null page_id; repeated
rows are written as often as they occur; an empty table or an empty task writes nothing and reads nothing;
records of other writers come with what they state (digests in base 32 become hex, a missing one is computed,
a missing payload length of a revisit is null).
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, shuffle_parts, written

MIN_REVISIT = 1000
FILE_BYTES = 16 << 20
#: Bytes of archives that one task reads.
TASK_BYTES = 128 << 20
#: Digests with more than this share of all rows are joined by broadcast: there are at most its inverse of them.
HOT_SHARE = 1 / 1000
VERSION = b"WARC/1.1\r\n"
VERSION_LINES = (b"WARC/1.1\r\n", b"WARC/1.0\r\n")
GZIP_START = b"\x1f\x8b\x08"
#: Where a record or a member can begin; one search over all of them ends at the first, however far the others are.
ANY_VERSION = re.compile(b"|".join(map(re.escape, VERSION_LINES)))
ANY_START = re.compile(b"|".join(map(re.escape, (GZIP_START, *VERSION_LINES))))
GZIP_LEVEL = 6
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Bytes inflated at a time.
TRY_BYTES = 1 << 16

FILE_SCHEMA = "file string, records long, bytes long"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
OTHER_SCHEMA = "record_id string, target_uri string"
GAP_SCHEMA = "file string, start long, end long, reason string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def record(kind: str, uri: str, page_id, digest: str, size: int, refers_to, payload: bytes) -> bytes:
    block = HTTP_HEAD + (payload if kind == "response" else b"")
    ident = "none" if page_id is None else str(page_id)
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{ident}>",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[4:4] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return VERSION + "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def decide(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, digest and, for revisits, the page that holds the payload. One row per page_id and digest.

    A payload that many pages share is looked up by broadcast (few digests can have a large share of all rows),
    the others by a join on the digest.
    """
    slim = written(pages.select("page_id", "digest", "size").distinct(), "warc-pages")
    n = slim.count()
    held = slim.filter(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
    held = written(held.filter("n > 1"), "warc-holders")
    most = F.lit(n * HOT_SHARE)
    hot = F.broadcast(held.filter(F.col("n") > most).select("digest", "holder"))
    cold = held.filter(F.col("n") <= most).select("digest", "holder")
    found = slim.join(hot, "digest").unionByName(slim.join(hot, "digest", "left_anti").join(cold, "digest", "left"))
    return found.select("page_id", "digest", F.when(~F.col("holder").eqNullSafe(F.col("page_id")), F.col("holder")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row of pages (page_id, url, html) as .warc.gz files under path; returns FILE_SCHEMA, written.

    Every attempt of a task writes under names of its own. What is returned lists the files of the attempts that
    were committed; others may lie in the folder and belong to nobody.
    """
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    made = decide(page, least).withColumnsRenamed({"page_id": "_p", "digest": "_d"})
    rows = page.join(made, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d"))).select("page_id", "url", "digest", "size", "refers_to", "payload")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        attempt, files, buf, count = uuid.uuid4().hex, [], io.BytesIO(), 0

        def close() -> None:
            name = f"part-{attempt}-{len(files):05d}.warc.gz"
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(buf.getvalue())
            files.append((f"{path}/{name}", count, buf.tell()))
            buf.seek(0)
            buf.truncate()

        for b in batches:
            for page_id, url, digest, size, refers_to, payload in zip(b["page_id"], b["url"], b["digest"], b["size"], b["refers_to"], b["payload"]):
                page_id = None if pd.isna(page_id) else int(page_id)
                again = not pd.isna(refers_to)
                uri = "".join(url.split()).replace("\x00", "")
                buf.write(member(record("revisit" if again else "response", uri, page_id, digest, int(size), int(refers_to) if again else None, bytes(payload))))
                count += 1
                if buf.tell() >= file_bytes:
                    close()
                    count = 0
        if buf.tell():
            close()
        if files:
            yield pd.DataFrame(files, columns=_names(FILE_SCHEMA))

    spark = pages.sparkSession
    _mkdirs(spark, path)
    return written(rows.mapInPandas(write, FILE_SCHEMA), "warc-files")


def _mkdirs(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


class Damaged(Exception):
    pass


def _after_head(data: bytes, at: int) -> int:
    """Where the deflate stream of the gzip member at a place begins."""
    flags, pos = data[at + 3], at + 10
    if flags & 4:
        pos += 2 + int.from_bytes(data[pos : pos + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            pos = data.index(b"\0", pos) + 1
    return pos + 2 if flags & 2 else pos


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What inflates of the member at a place, its end if it is sound, and what is wrong (or nothing).

    Damaged if it doesn't open with a version line, so that chance bytes are not taken for a member.
    """
    try:
        start = pos = _after_head(data, at)
    except (IndexError, ValueError):
        raise Damaged("cut short") from None
    z, out, why = zlib.decompressobj(-15), [], ""
    view = memoryview(data)
    while not z.eof and pos < len(data):
        try:
            out.append(z.decompress(view[pos : pos + TRY_BYTES]))
        except zlib.error as e:
            why = str(e)
            break
        if not out[0].startswith(VERSION_LINES[0][: len(out[0])]) and not out[0].startswith(VERSION_LINES[1][: len(out[0])]):
            raise Damaged("no version line")
        pos += TRY_BYTES
    if why:  # once more, byte by byte in the last stretch, for what comes before the fault
        z, out = zlib.decompressobj(-15), []
        try:
            out.append(z.decompress(view[start:pos]))
            while True:
                out.append(z.decompress(view[pos : pos + 1]))
                pos += 1
        except zlib.error:
            pass
    inside = b"".join(out)
    if not inside.startswith(VERSION_LINES):
        raise Damaged(why or "no version line")
    if why:
        return inside, at, why
    if not z.eof:
        return inside, at, "cut short"
    end = min(pos, len(data)) - len(z.unused_data)
    if data[end : end + 8] != zlib.crc32(inside).to_bytes(4, "little") + (len(inside) & 0xFFFFFFFF).to_bytes(4, "little"):
        return inside, at, "CRC or length of the member fails"
    return inside, end + 8, ""


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at a place."""
    if not data.startswith(VERSION_LINES, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("no end of headers")
    try:
        lines = data[at:stop].decode("utf-8").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
    except (UnicodeDecodeError, KeyError, ValueError):
        raise Damaged("bad headers") from None
    if size < 0:
        raise Damaged("bad headers")
    end = stop + 4 + size
    if data[end : end + 4] != b"\r\n\r\n":  # before the block is copied
        raise Damaged("length and end disagree")
    return head, data[stop + 4 : end], end + 4


def _sha1(said: str) -> str | None:
    """A stated SHA-1 as bare lower-case hex, from hex or base 32; None for another algorithm."""
    name, _, value = said.rpartition(":")
    if name.lower() not in ("", "sha1", "sha-1"):
        return None
    if len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except ValueError:
            raise Damaged("bad digest") from None
    return value.lower()


def read_record(head: dict[str, str], block: bytes, vouched: bool = False) -> tuple:
    """A row of RECORD_SCHEMA and OTHER_SCHEMA; a response's digest is checked against its payload.

    vouched: only a record whose digest proves its payload will do.
    """

    def page(name: str):
        said = head.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(said) if said.lstrip("-").isdigit() else None

    kind, digest = head.get("warc-type", ""), _sha1(head.get("warc-payload-digest", ""))
    stated = head.get("x-payload-bytes", "")
    if not kind or (stated and not stated.isdigit()):
        raise Damaged("bad headers")
    size = int(stated) if stated else None
    if kind == "revisit":
        proven = False
    else:
        http = head.get("content-type", "").replace(" ", "").startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        found = hashlib.sha1(payload).hexdigest()
        proven = digest == found
        if (digest and not proven) or (size is not None and len(payload) != size):
            raise Damaged("payload digest fails")
        size, digest = len(payload), digest or found
    if vouched and not proven:
        raise Damaged("in a damaged member, without a digest that proves it")
    return page("warc-record-id"), size, digest, kind, page("warc-refers-to"), head.get("warc-record-id"), head.get("warc-target-uri")


def _records(data: bytes, vouched: bool = False) -> Iterator[tuple[str, object]]:
    """('record', row) for each sound record of an inflated member, ('gap', reason) for each stretch without."""
    pos, lost = 0, False
    while pos < len(data):
        try:
            head, block, end = parse_record(data, pos)
            row = read_record(head, block, vouched)
        except Damaged as e:
            if not lost:
                yield "gap", str(e)
            lost = True
            found = ANY_VERSION.search(data, pos + 1)
            pos = found.start() if found else len(data)
            continue
        lost = False
        yield "record", row
        pos = end


def salvage(data: bytes) -> Iterator[tuple[str, tuple]]:
    """('record', row) for each sound record and ('gap', (start, end, reason)) for what lies between.

    A gap inside a member is logged with the member's own bytes, since deflated bytes can't be told apart.
    """
    n, at = len(data), 0
    gap, why = None, ""

    def next_start(after: int) -> int:
        found = ANY_START.search(data, after)
        return found.start() if found else n

    while at < n:
        wrong = ""
        try:
            if data.startswith(GZIP_START, at):
                inside, end, wrong = _inflate(data, at)
                found = list(_records(inside, bool(wrong)))
            else:
                head, block, end = parse_record(data, at)
                found = [("record", read_record(head, block))]
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            at = next_start(at + 1)
            continue
        rescued = any(kind == "record" for kind, _ in found)
        if gap is not None and (rescued or not wrong):
            yield "gap", (gap, at, why)
            gap = None
        for kind, x in found:
            if kind == "record":
                yield kind, x
            elif not wrong:
                yield kind, (at, end, x)
        if wrong:  # one gap, up to the next sound start; a damaged stream's own end is not to be trusted
            if gap is None:
                gap, why = at, wrong
            at = next_start(at + 1)
        else:
            at = end
    if gap is not None:
        yield "gap", (gap, n, why)


def _rows(name: str, data: bytes) -> pd.DataFrame:
    blank = [None] * len(_names(f"{RECORD_SCHEMA}, {OTHER_SCHEMA}"))
    rows = [(kind, *row, name, None, None, None) if kind == "record" else (kind, *blank, name, *row) for kind, row in salvage(data)]
    out = pd.DataFrame(rows, columns=["kind", *_names(f"{RECORD_SCHEMA}, {OTHER_SCHEMA}, {GAP_SCHEMA}")])
    for c in ("page_id", "payload_bytes", "refers_to", "start", "end"):
        out[c] = out[c].astype("Int64")
    for c in ("kind", "payload_digest", "record_type", "record_id", "target_uri", "file", "reason"):
        out[c] = out[c].astype(object)
    return out


READ_SCHEMA = f"kind string, {RECORD_SCHEMA}, {OTHER_SCHEMA}, {GAP_SCHEMA}"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps of all archives under path: READ_SCHEMA. A file is one value, so of 2 GB at most."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc{,.gz}").load(path).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                yield _rows(name, bytes(content))

    return files.mapInPandas(read, READ_SCHEMA)


def read_files(files: DataFrame) -> DataFrame:
    """Records of files (FILE_SCHEMA) that were written whole; a gap, or another number of records than reported, is an error."""
    total = files.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
    parts = max(1, min(total["n"], max(shuffle_parts(files.sparkSession), (total["b"] or 0) // TASK_BYTES)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for name, records in zip(b["file"], b["records"]):
                store, at = fs.FileSystem.from_uri(name)
                with store.open_input_stream(at, compression=None) as f:
                    found = _rows(name, f.read())
                if (found["kind"] != "record").any() or len(found) != records:
                    raise Damaged(f"{name}: {records} records were written, {(found['kind'] == 'record').sum()} read, gaps: {found['reason'].dropna().tolist()}")
                yield found

    return files.repartition(parts).mapInPandas(read, READ_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read the records back."""
    files = write_archives(pages, new_path(pages.sparkSession, "warc"))
    return read_files(files).select(*_names(RECORD_SCHEMA))
