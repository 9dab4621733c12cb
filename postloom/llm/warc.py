"""WARC archives of pages with a two-level capture index.

Archives. Each task writes its records, one gzip member each, to files of its own in a shared folder. A page whose
payload (SHA-1 of its bytes) another page with a smaller id has already is a `revisit` record without payload that
names the other one; all others are `response` records.

Index. A capture is (key, page_id, archive, offset, length); the key is the URL with its host reversed
(`com,example,www)/path?query`). Captures are sorted by key over the cluster and written as compressed blocks of
`BLOCK_LINES` lines; behind the blocks of a file stands its sparse directory, the first key and the place of each
block. The table that names the files holds their first and last keys.

Look-up. A key's files are found by binary search over the files' keys, its blocks by binary search in the file's
directory, its lines by binary search in the block; only these blocks are read, by offset and length. The captures
found are dealt out by archive and place, and neighbouring records are read in one range.

Files get random names and count only if the table of a finished step names them, so what a lost or repeated task
leaves behind is never read. They stay in the folder until `removed`.

Defined results: a null html is an empty payload, a null url an empty one; a null page_id stays null and counts as
smaller than every other; rows that repeat an id and a payload are alike (all are responses if it is the smallest
id); payloads under `least_bytes` are always responses; equal keys stand in the order of their ids; a page of any
length is one record; an empty table gives an empty index and finds nothing. Only page_id, url and html are read, so
further columns of any name do no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import NULL_ID, settled, shared_folder
from postloom.operators.lookup import left_lookup

ARCHIVE_BYTES, BLOCK_LINES, FILE_LINES = 64 << 20, 512, 1 << 20
#: Records that lie this close are read in one range of at most so many bytes.
GAP_BYTES, RANGE_BYTES = 64 << 10, 4 << 20
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"

CAPTURE = "key string, page_id bigint, archive string, at bigint, length bigint"
INDEX_FILE = "file string, first_key string, last_key string, directory_at bigint, directory_length bigint, lines bigint"
RECORD = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder's URI; a plain path is a mounted one."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def removed(folder: str) -> None:
    """Deletes a folder of archives or of an index."""
    system, path = place(folder)
    system.delete_dir(path)


class Output:
    """A file that is created under a name of its own when its first bytes come."""

    def __init__(self, folder: str, suffix: str):
        self.system, path = place(folder)
        self.system.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.stream = self.system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.at = 0

    def add(self, blob: bytes) -> int:
        self.stream.write(blob)
        self.at += len(blob)
        return self.at - len(blob)

    def close(self) -> None:
        self.stream.close()


def url_key(url: Column) -> Column:
    """Reversed host, port and the rest of the URL without its fragment; text that is no URL has an empty host."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?"
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, scheme + r"([^/?#:]*)", 1))
    port = F.regexp_extract(url, scheme + r"[^/?#:]*(:[0-9]+)", 1)
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"(?s)#.*$", "")
    turned = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.concat(turned, port, F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def _headers(first: str, fields: list[tuple[str, str]]) -> bytes:
    lines = [first, *(f"{name}: {value}" for name, value in fields)]
    return "\r\n".join(lines).encode() + _END


def _urn(page_id: int) -> str:
    return f"<urn:page:{'null' if page_id == NULL_ID else page_id}>"


def _id_of(urn: str) -> int:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return NULL_ID if number == "null" else int(number)


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; `digest` is the payload's SHA-1 in hexadecimal digits."""
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]", errors="surrogatepass")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    http = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html;charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http + (payload if refers_to is None else b"")
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _headers("WARC/1.1", fields) + block + _END


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(_END)
    lines = head.decode().split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:]), rest


def opened(raw: bytes) -> tuple:
    """The values of `RECORD` of one record; damaged records raise."""
    fields, rest = _parsed(raw)
    block = rest[: int(fields["Content-Length"])]
    http, payload = _parsed(block)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    size = int(http["Content-Length"])
    if rest[len(block) :] != _END or response and (
        len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest
    ):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers_to = None if response else _id_of(fields["WARC-Refers-To"])
    found = _id_of(fields["WARC-Record-ID"])
    return found, fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], refers_to, payload if response else None


def archived(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for every page; returns the captures, stored."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.coalesce("page_id", F.lit(NULL_ID)).alias("page_id"), "url", html.alias("html"))
    rows = rows.withColumns({"key": url_key(F.col("url")), "digest": F.sha1("html")})
    keys = settled(rows.where(F.octet_length("html") >= least_bytes).select("page_id", "digest"))
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Only payloads that occur again are looked up; one that very many pages share is spread by the look-up.
    marked = left_lookup(rows, firsts.where("n > 1").select("digest", "first"), "digest", counted=keys)
    again = (F.col("first") != F.col("page_id")) & (F.octet_length("html") >= least_bytes)
    sent = marked.select("key", "page_id", "url", "html", "digest", F.when(again, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        try:
            for batch in batches:
                rows = []
                refers = (None if pd.isna(r) else int(r) for r in batch["refers_to"].astype("Int64"))
                columns = (batch[c] for c in ("key", "page_id", "url", "html", "digest"))
                for (key, page, url, html, digest), first in zip(zip(*columns, strict=True), refers, strict=True):
                    member = gzip.compress(record(page, url, html.encode("utf-8", "surrogatepass"), digest, first), 6, mtime=0)
                    if out is not None and out.at + len(member) > archive_bytes:
                        out.close()
                        out = None
                    out = out or Output(folder, ".warc.gz")
                    rows.append((key, page, out.name, out.add(member), len(member)))
                yield pd.DataFrame(rows, columns=_names(CAPTURE))
        finally:
            if out is not None:
                out.close()

    # A nullable bigint column would reach Python as doubles, which do not hold every id.
    text = sent.withColumn("refers_to", F.col("refers_to").cast("string"))
    return settled(text.mapInPandas(run, CAPTURE))


@dataclass(frozen=True)
class CaptureIndex:
    """Index files of `folder`, in the order of their keys; one row per about `FILE_LINES` captures or range."""

    folder: str
    files: list[tuple[str, str, str, int, int]]  # name, first and last key, place and length of the directory


def indexed(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, file_lines: int = FILE_LINES) -> CaptureIndex:
    """Writes the captures' index. Captures of one key may lie in several ranges, so a very frequent key is no matter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines, directory, files, total = [], [], [], 0
        out = first = last = None

        def block() -> None:
            blob = zlib.compress("\n".join(json.dumps(line) for line in lines).encode())
            directory.append([lines[0][0], out.add(blob), len(blob)])
            lines.clear()

        def finish() -> None:
            if lines:
                block()
            blob = zlib.compress(json.dumps(directory).encode())
            files.append((out.name, first, last, out.add(blob), len(blob), total))
            out.close()
            directory.clear()

        for batch in batches:
            for line in batch[_names(CAPTURE)].itertuples(index=False, name=None):
                if out is None:
                    out, first, total = Output(folder, ".cdx"), line[0], 0
                lines.append(line)
                last, total = line[0], total + 1
                if len(lines) == block_lines:
                    block()
                if total == file_lines:
                    finish()
                    out = None
        if out is not None:
            finish()
        yield pd.DataFrame(files, columns=_names(INDEX_FILE))

    ranged = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "archive", "at")
    written = settled(ranged.mapInPandas(run, INDEX_FILE))
    # One row per file comes to the driver: the captures over FILE_LINES, and one per range at most besides.
    rows = written.select("file", "first_key", "last_key", "directory_at", "directory_length").collect()
    files = sorted((tuple(r) for r in rows), key=lambda r: (_bytes(r[1]), _bytes(r[2])))
    return CaptureIndex(folder, files)


def _bytes(key: str) -> bytes:
    """Spark orders strings by their bytes."""
    return key.encode("utf-8", "surrogatepass")


class IndexFile:
    """One index file with its directory; the block read last is kept."""

    def __init__(self, folder: str, file: str, at: int, length: int):
        system, path = place(folder)
        self.stream = system.open_input_file(f"{path}/{file}")
        self.directory = json.loads(zlib.decompress(self.stream.read_at(length, at)))
        self.firsts = [_bytes(first) for first, _, _ in self.directory]
        self.number, self.lines, self.keys = -1, [], []

    def _open(self, number: int) -> None:
        if number != self.number:
            _, at, length = self.directory[number]
            text = zlib.decompress(self.stream.read_at(length, at)).decode()
            self.number, self.lines = number, [json.loads(line) for line in text.split("\n")]
            self.keys = [_bytes(line[0]) for line in self.lines]

    def found(self, key: bytes) -> Iterator[list]:
        number = max(0, bisect_left(self.firsts, key) - 1)  # the block before may end with the key
        while number < len(self.firsts) and self.firsts[number] <= key:
            self._open(number)
            yield from self.lines[bisect_left(self.keys, key) : bisect_right(self.keys, key)]
            number += 1


def captured(index: CaptureIndex, keys: DataFrame) -> DataFrame:
    """The captures of the keys (a column `key` of distinct keys), by binary search and range reads."""
    folder, files = index.folder, index.files
    firsts, lasts = [_bytes(f[1]) for f in files], [_bytes(f[2]) for f in files]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key in batch["key"]:
                raw = _bytes(key)
                rows += [(number, key) for number in range(bisect_left(lasts, raw), bisect_right(firsts, raw))]
            yield pd.DataFrame(rows, columns=["file", "key"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, file = None, None
        for batch in batches:
            rows = []
            for wanted, key in zip(batch["file"], batch["key"], strict=True):
                if wanted != number:
                    number, file = wanted, IndexFile(folder, files[wanted][0], *files[wanted][3:])
                rows += file.found(_bytes(key))
            yield pd.DataFrame(rows, columns=_names(CAPTURE))

    asked = keys.select("key").mapInPandas(assign, "file int, key string")
    return asked.repartition("file").sortWithinPartitions("file", "key").mapInPandas(run, CAPTURE)


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(archive, start, end, records) of neighbouring records."""
    held, archive, start, end = [], None, 0, 0
    for name, at, length in rows:
        if held and (name != archive or at > end + GAP_BYTES or at + length - start > RANGE_BYTES):
            yield archive, start, end, held
            held = []
        if not held:
            archive, start = name, at
        held.append((at, length))
        end = max(at + length, start if len(held) == 1 else end)
    if held:
        yield archive, start, end, held


def read(folder: str, captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the captures; `payload` is null for revisits, and for all without `payloads`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = place(folder)
        name = stream = None
        for batch in batches:
            for archive, start, end, records in _ranges(list(zip(batch["archive"], batch["at"], batch["length"], strict=True))):
                if archive != name:
                    name, stream = archive, system.open_input_file(f"{path}/{archive}")
                raw, rows = stream.read_at(end - start, start), []
                for at, length in records:
                    *values, payload = opened(gzip.decompress(raw[at - start : at - start + length]))
                    rows.append((*values, payload if payloads else None))
                found = pd.DataFrame(rows, columns=_names(RECORD))
                for column in ("page_id", "refers_to"):
                    found[column] = pd.array([None if v == NULL_ID else v for v in (r[_names(RECORD).index(column)] for r in rows)], dtype="Int64")
                yield found

    near = F.floor(F.col("at") / RANGE_BYTES)
    dealt = captures.repartition("archive", near).sortWithinPartitions("archive", "at")
    return dealt.select("archive", "at", "length").mapInPandas(run, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives and index of the pages in a new folder, and all records read back by their URLs."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    captures = archived(pages, f"{folder}/archives", least_bytes)
    index = indexed(captures, f"{folder}/index")
    keys = pages.select(url_key(F.col("url")).alias("key")).distinct()
    return read(f"{folder}/archives", captured(index, keys), payloads=False)
