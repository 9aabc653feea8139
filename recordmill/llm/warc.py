"""WARC archives with a two-level capture index.

Executors write archives (one gzip member per record) and index shards into a folder that
all of them share, through any file system that pyarrow knows by its address. Equal payloads
are stored once; their other captures are revisit records.

The index sorts captures by reversed-host URL key. A shard holds a range of keys in
compressed blocks of ``BLOCK`` captures, and beside them a sparse directory with each block's first
key and place. A lookup finds the shard by the shards' key ranges, the block by binary search
in the directory, the captures by binary search in the block, and reads only those ranges.

A task that runs twice writes files of another name; only those of the attempt that
counts are in the index. The table of shards has a row per partition of the index.
"""

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.plans.pins import fresh_path, pin

BLOCK = 512
ROLL_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HOST = re.compile(r"^[^/?#]*?://([^/?#]*)([^#]*)", re.S)
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _safe(text: str) -> str:
    return UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", text)


def url_key(url: str | None) -> str:
    """Sort key of a URL: the host's labels reversed, then path and query; ``)`` and the text where there is no host."""
    found = HOST.match(url or "")
    if not found:
        return ")" + _safe(url or "")
    host = ",".join(reversed(found[1].lower().split(".")))
    return _safe(f"{host}){found[2] or '/'}")


def open_folder(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        path = re.sub(r"^file:/(?!//)/*", "file:///", path)
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def record_of(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One compressed record; with ``refers_to`` a revisit, which keeps the HTTP headers and not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>",
            f"WARC-Date: {date}", *([f"WARC-Target-URI: {_safe(url)}"] if url else []),
            f"WARC-Payload-Digest: sha1:{digest}",
            *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{refers_to}>"] if refers_to else []),
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and payload of one compressed record."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    named = lambda lines: {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    warc = named(head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, named(http.decode().split("\r\n")[1:]), payload


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_of(record_id: str | None) -> int | None:
    found = re.match(r"<urn:page:(-?\d+)[:>]", record_id or "")
    return int(found[1]) if found else None


_ENTRY = "key string, page_id long, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Writes a record per row of ``pages(page_id, url, html)``; ``(key, page_id, file, offset, length)`` of each.

    Of equal payloads of at least ``least_bytes`` bytes the one with the smallest page id is the
    response and the others revisit it. Of rows that share that id too, one is the response. A null
    html is an empty payload. A row without page id revisits one that has an id, and is a response otherwise.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    wide = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    seen = pin(wide.where(F.length("payload") >= least_bytes).groupBy("page_id", "sha").agg(
        F.count(F.lit(1)).alias("copies")))
    holders = pin(seen.groupBy("sha").agg(F.min("page_id").alias("holder")))
    special = pin(
        seen.join(holders, "sha").where("holder is not null and (not page_id <=> holder or copies > 1)")
        .select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "holder", "copies"))
    decided = wide.join(special, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        out, name, before, copies = None, "", None, 0
        try:
            for part in parts:
                rows = []
                for page, url, data, sha, holder in zip(*(c.to_pylist() for c in part.columns[:5]), strict=True):
                    if out is None or out.tell() > ROLL_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    # rows of one id and payload come one after another here
                    copies = copies + 1 if page is not None and (page, sha) == before else 0
                    before = (page, sha)
                    revisit = holder is not None and (page != holder or copies > 0)
                    own = f"urn:uuid:{uuid.uuid4()}" if page is None else f"urn:page:{page}" + f":{copies}" * (copies > 0)
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    at = out.tell()
                    out.write(record_of(own, url, data, digest, f"urn:page:{holder}" if revisit else None, date))
                    rows.append((url_key(url), page, name, at, out.tell() - at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)] if rows else
                    [pa.array([], t) for t in _TYPES], ["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    columns = ["page_id", "url", "payload", "sha", "holder"]
    system, base = open_folder(folder)
    system.create_dir(base, recursive=True)
    if special.where("copies > 1").isEmpty():
        return pin(decided.select(*columns).mapInArrow(batches, _ENTRY))
    several = decided.where("copies > 1").repartition("page_id", "sha").sortWithinPartitions("page_id", "sha", "url")
    once = decided.where("copies is null or copies = 1")
    return pin(once.select(*columns).unionByName(several.select(*columns)).mapInArrow(batches, _ENTRY))


_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def write_index(entries: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Sorts captures into shards of compressed blocks; ``(shard, first, last)``, the key range of each shard.

    Captures of one URL are ordered by page id and place, so that a URL with very many of them spans shards.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        shard, at, held, directory, last = f"{uuid.uuid4().hex}.cdx", 0, [], [], ""
        out = None

        def flush() -> int:
            data = zlib.compress("\n".join(json.dumps(x) for x in held).encode())
            out.write(data)
            directory.append((held[0][0], at, len(data)))
            return at + len(data)

        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                out = out or system.open_output_stream(f"{base}/{shard}", compression=None)
                held.append(row)
                last = row[0]
                if len(held) == block:
                    at, held = flush(), []
        if out is not None:
            if held:
                flush()
            out.close()
            with system.open_output_stream(f"{base}/{shard}.idx", compression=None) as listing:
                listing.write("\n".join(json.dumps(x) for x in directory).encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (shard, directory[0][0], last)], ["shard", "first", "last"])

    system, base = open_folder(folder)
    system.create_dir(base, recursive=True)
    order = ["key", "page_id", "file", "offset"]
    dealt = entries.select("key", "page_id", "file", "offset", "length").repartitionByRange(*order)
    return pin(dealt.sortWithinPartitions(*order).mapInArrow(batches, "shard string, first string, last string"))


class Shard:
    """One shard of the index, opened for lookups; holds its directory and one block."""

    def __init__(self, folder: str, shard: str) -> None:
        system, base = open_folder(folder)
        with system.open_input_stream(f"{base}/{shard}.idx", compression=None) as listing:
            self._directory = [json.loads(x) for x in listing.read().decode().split("\n")]
        self._firsts = [x[0] for x in self._directory]
        self._file = system.open_input_file(f"{base}/{shard}")
        self._number, self._rows = -1, []

    def _block(self, number: int) -> list:
        if number != self._number:
            _, at, length = self._directory[number]
            self._file.seek(at)
            data = zlib.decompress(self._file.read(length))
            self._number, self._rows = number, [json.loads(x) for x in data.decode().split("\n")]
        return self._rows

    def captures(self, key: str) -> Iterator[list]:
        """Captures of ``key`` in this shard, as ``[key, page_id, file, offset, length]``."""
        number = max(bisect_left(self._firsts, key) - 1, 0)
        while number < len(self._firsts) and self._firsts[number] <= key:
            rows = self._block(number)
            for k in range(bisect_left(rows, key, key=lambda r: r[0]), bisect_right(rows, key, key=lambda r: r[0])):
                yield rows[k]
            number += 1


def lookup(urls: DataFrame, shards: DataFrame, folder: str, column: str = "url") -> DataFrame:
    """Captures of the distinct URL keys of ``urls``: ``(key, page_id, file, offset, length)``."""
    ranges = sorted((r.first, r.last, r.shard) for r in shards.collect())  # a row per index partition
    firsts, lasts, names = ([r[k] for r in ranges] for k in range(3))

    def keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [(name, key) for key in {url_key(u) for u in part.column(0).to_pylist()}
                     for name in names[bisect_left(lasts, key) : bisect_right(firsts, key)]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["shard", "key"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for part in parts:
            found = []
            for wanted, key in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if wanted != name:
                    name, shard = wanted, Shard(folder, wanted)
                for row in shard.captures(key):
                    found.append(row)
                    if len(found) == 10_000:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*found, strict=True), _TYPES, strict=True)],
                            ["key", "page_id", "file", "offset", "length"])
                        found = []
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], t) for k, t in enumerate(_TYPES)],
                ["key", "page_id", "file", "offset", "length"])

    asked = urls.select(F.col(column).cast("string")).mapInArrow(keys, "shard string, key string").distinct()
    return asked.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(batches, _ENTRY)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """``(page_id, record_type, payload_digest, payload_bytes, refers_to, payload)`` of captures, by range reads.

    The digest of a response is taken from its payload and compared with the header; a revisit's is its header's.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        name, file = None, None
        for part in parts:
            rows = []
            for wanted, at, length in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if wanted != name:
                    name, file = wanted, system.open_input_file(f"{base}/{wanted}")
                file.seek(at)
                warc, http, payload = parse_record(file.read(length))
                kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and sha1_base32(payload) != digest:
                    raise ValueError(f"{wanted} at {at}: the payload does not have its digest")
                rows.append((_page_of(warc["warc-record-id"]), kind, digest, int(http["content-length"]),
                             _page_of(warc.get("warc-refers-to")), payload if kind == "response" else None))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                ["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])

    near = captures.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return near.mapInArrow(batches, "page_id long, record_type string, payload_digest string, payload_bytes long, "
                                    "refers_to long, payload binary")


def archived(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as archives with an index, looks every URL up in it and reads the records back.

    Files go to ``folder``, or to a fresh one in the shared folder. One row per row of ``pages``; an
    empty table gives none. Other columns are ignored.
    """
    folder = folder or fresh_path(pages.sparkSession)
    shards = write_index(write_archives(pages, folder, least_bytes), f"{folder}/index")
    return read_records(lookup(pages, shards, f"{folder}/index"), folder)
