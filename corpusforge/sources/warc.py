"""Web-archive sources and sink.

``format("warc")`` is a Python DataSource, read through pyarrow's filesystems (a URI of a
shared store, or a path that every executor sees).  A file is cut into byte ranges; a
task finds the first gzip member that starts in its range by trial decompression, and reads the
members that start there, a piece at a time; what has been parsed of a member is let go, so no archive and
no member is held in memory, only a record.  Record types outside request/response/metadata are
skipped (B4) unless ``types`` says otherwise.  Rows leave as Arrow batches.

A record's ``ordinal`` orders the records of a file: the offset of its member and its place in it, the same
however a file is cut.  ``length`` is that of its member; only the last record of a member has it, which is the
only one in an archive with a member for each record.

Writing gives one archive for each value of ``file``, a gzip member for each record; files
appear under their names when the job commits.

``fetch_records`` is the random-access form: locations (file, offset, length)
are range-partitioned by file and sorted by offset, and each task opens a file
once and reads only the requested byte ranges.
"""

from __future__ import annotations

import gzip
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

RECORD_SCHEMA = (
    "file string, ordinal long, offset long, length long, rec_type string, target_uri string, "
    "warc_date string, warc_headers map<string,string>, http_headers string, payload binary"
)
WANTED = ("request", "response", "metadata")
_CHUNK = 1 << 20


#: Bytes of a file that one task reads, unless the option ``splitBytes`` says otherwise (0: whole files).
SPLIT_BYTES = 128 << 20
#: Rows and payload bytes of a batch.
_BATCH_ROWS, _BATCH_BYTES = 1024, 8 << 20
#: Room for the place of a record in its member.
_PLACE_BITS = 20


class _Member:
    """The decompressed bytes of one gzip member, read forward from a file; only unread bytes are held."""

    def __init__(self, f, start: int, buf: bytes = b""):
        self.f, self.start = f, start
        self._inflate = zlib.decompressobj(31)
        self._raw, self._held, self._at = buf, b"", 0
        self.read_raw = 0  # compressed bytes taken so far

    def _more(self) -> bool:
        """Decompress some more; false at the member's end."""
        if self._inflate.eof:
            return False
        # a bounded piece at a time, however well it compresses
        piece = self._inflate.decompress(self._raw, _CHUNK)
        if not piece and not self._raw and not self._inflate.eof:
            self._raw = self.f.read(_CHUNK)
            if not self._raw:
                raise ValueError(f"truncated gzip member at offset {self.start}")
            piece = self._inflate.decompress(self._raw, _CHUNK)
        rest = self._inflate.unused_data if self._inflate.eof else self._inflate.unconsumed_tail
        self.read_raw += len(self._raw) - len(rest)
        self._raw = rest
        self._held = self._held[self._at :] + piece
        self._at = 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None if the member ends before."""
        seen = self._at
        while True:
            found = self._held.find(mark, seen)
            if found >= 0:
                out = self._held[self._at : found + len(mark)]
                self._at = found + len(mark)
                return out
            behind = max(len(self._held) - self._at - len(mark) + 1, 0)
            if not self._more():
                return None
            seen = behind

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            if self._at >= len(self._held) and not self._more():
                break
            part = self._held[self._at : self._at + n - have]
            self._at += len(part)
            have += len(part)
            parts.append(part)
        return b"".join(parts)

    def skip_line_ends(self) -> bool:
        """Pass over empty lines; false at the member's end."""
        while True:
            while len(self._held) - self._at >= 2 and self._held.startswith(b"\r\n", self._at):
                self._at += 2
            if len(self._held) - self._at >= 2:
                return True
            if not self._more():
                return self._at < len(self._held)

    def finish(self) -> bytes:
        """Read to the member's end; compressed bytes behind it that were read already."""
        while True:
            self._at = len(self._held)
            if not self._more():
                return self._raw


def _first_member(f, start: int, stop: int) -> int | None:
    """Offset of the first gzip member that starts in the range: a header behind which a WARC record decompresses."""
    at, held = start, b""
    while at < stop:
        f.seek(at)
        held = f.read(min(_CHUNK, stop - at) + 64)
        place = held.find(b"\x1f\x8b\x08")
        while 0 <= place < stop - at:
            f.seek(at + place)
            try:
                if zlib.decompressobj(31).decompress(f.read(1 << 16), 64).lstrip(b"\r\n").startswith(b"WARC/"):
                    return at + place
            except zlib.error:
                pass
            place = held.find(b"\x1f\x8b\x08", place + 1)
        if len(held) < min(_CHUNK, stop - at):
            return None
        at += _CHUNK
    return None


def _records(f, start: int, stop: int | None) -> Iterator[tuple[int, int, int, dict]]:
    """(offset, length, place, record) of the members that start in the range; the length is known behind the member's last record."""
    if start:
        found = _first_member(f, start, stop if stop is not None else 1 << 62)
        if found is None:
            return
        start = found
    f.seek(start)
    buf = b""
    while stop is None or start < stop:
        if not buf:
            buf = f.read(_CHUNK)
            if not buf:
                return
        member = _Member(f, start, buf)
        held = None  # a record goes out when it is known whether it is the member's last
        place = 0
        while True:
            rec = _next_record(member)
            if rec is None:
                break
            if held is not None:
                yield start, None, place - 1, held
            held = rec
            place += 1
        buf = member.finish()
        if held is not None:
            yield start, member.read_raw, place - 1, held
        start += member.read_raw


def _next_record(member: _Member) -> dict | None:
    """The next WARC record of a member: version line, headers, blank line, block of Content-Length bytes.

    Header names are matched in any case.  Anything else than records, and the line ends
    around them, raises: a malformed archive is not passed over in silence.
    """
    if not member.skip_line_ends():
        return None
    head = member.until(b"\r\n\r\n")
    if head is None or not head.startswith(b"WARC/"):
        raise ValueError(f"no WARC record in the member at offset {member.start}")
    headers: dict[str, str] = {}
    for line in head[:-4].decode("utf-8", "replace").split("\r\n")[1:]:
        if ":" in line:
            k, v = line.split(":", 1)
            headers.setdefault(k.strip(), v.strip())
    field = {k.lower(): v for k, v in reversed(headers.items())}.get
    n = int(field("content-length", "0") or 0)
    block = member.take(n)
    if len(block) < n:
        raise ValueError(f"a WARC record of {n} bytes ends after {len(block)}")
    rec_type = field("warc-type", "")
    http, payload = None, block
    if rec_type in ("request", "response") and field("content-type", "").lower().startswith("application/http"):
        split = block.find(b"\r\n\r\n")
        if split >= 0:
            http = block[: split + 2].decode("iso-8859-1")
            payload = decoded_content(http, block[split + 4 :])
    return {
        "rec_type": rec_type,
        "target_uri": field("warc-target-uri"),
        "warc_date": field("warc-date"),
        "warc_headers": headers,
        "http_headers": http,
        "payload": payload,
    }


def parse_records(data: bytes) -> Iterator[dict]:
    """All WARC records of one gzip member."""
    import io

    member = _Member(io.BytesIO(b""), 0, data)
    while (rec := _next_record(member)) is not None:
        yield rec


def decoded_content(http_headers: str, body: bytes) -> bytes:
    """The body without its chunked transfer coding and its gzip or deflate content coding.

    What does not decode (many archives store decoded bodies under the original headers) stays as it is.
    """
    field = {}
    for line in http_headers.split("\r\n")[1:]:
        name, _, value = line.partition(":")
        field[name.strip().lower()] = value.strip().lower()
    if "chunked" in field.get("transfer-encoding", ""):
        body = _unchunked(body)
    for coding in reversed([c.strip() for c in field.get("content-encoding", "").split(",")]):
        if coding in ("gzip", "x-gzip", "deflate"):
            for wbits in (31,) if "gzip" in coding else (15, -15):
                try:
                    body = zlib.decompressobj(wbits).decompress(body)
                    break
                except zlib.error:
                    continue
    return body


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line_end = body.find(b"\r\n", at)
        try:
            n = int(body[at:line_end].split(b";")[0], 16) if line_end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0 or line_end + 2 + n > len(body):
            return body  # no chunks after all
        if n == 0:
            return b"".join(out)
        out.append(body[line_end + 2 : line_end + 2 + n])
        at = line_end + 2 + n + 2


def _store(path: str):
    """(filesystem, path inside it): any URI that pyarrow knows, else a path that every executor sees."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:(//)?", "", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _open(path: str):
    store, inside = _store(path)
    return store.open_input_file(inside)


def _listed(pattern: str) -> list[str]:
    """Files that match a pattern with wildcards in its last part, in name order, as URIs if it is one."""
    from fnmatch import fnmatch

    from pyarrow import fs

    folder, _, name = pattern.rpartition("/")
    if not re.search(r"[*?\[]", pattern):
        store, inside = _store(pattern)
        info = store.get_file_info(inside)
        if info.type == fs.FileType.File:
            return [pattern]
        if info.type == fs.FileType.NotFound:
            return []
        folder, name = pattern.rstrip("/"), "*"
    store, inside = _store(folder or "/")
    found = store.get_file_info(fs.FileSelector(inside, allow_not_found=True))
    return sorted(f"{folder}/{f.base_name}" for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, name))


_NAMES = [c.split(" ")[0] for c in RECORD_SCHEMA.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]


def _scan(path: str, start: int, stop: int | None, types: tuple[str, ...] | None) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        nonlocal size
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)
        rows.clear()
        size = 0
        return out

    with _open(path) as f:
        for offset, length, place, rec in _records(f, start, stop):
            if place >= 1 << _PLACE_BITS:
                raise ValueError(f"more than {1 << _PLACE_BITS} records in the member at offset {offset} of {path}")
            if types is None or rec["rec_type"] in types:
                rows.append((path, (offset << _PLACE_BITS) + place, offset, length, *(rec[c] if c != "warc_headers" else list(rec[c].items()) for c in _NAMES[4:])))
                size += len(rec["payload"])
            if len(rows) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                yield batch()
    if rows:
        yield batch()


class _RangePartition(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


def _ranges(paths: list[str], split: int) -> list[_RangePartition]:
    out = []
    for path in paths:
        size = 0
        if split > 0:
            store, inside = _store(path)
            size = store.get_file_info(inside).size or 0
        cuts = list(range(0, max(size, 1), split)) if split > 0 else [0]
        out += [_RangePartition(path, a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
    return out


class _WarcReader(DataSourceReader):
    def __init__(self, paths: list[str], types, split: int):
        self.paths, self.types, self.split = paths, types, split

    def partitions(self):
        return _ranges(self.paths, self.split)

    def read(self, partition):
        yield from _scan(partition.path, partition.start, partition.stop, self.types)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where an archive is, and where it goes


class _WarcWriter(DataSourceWriter):
    """Rows with (file, rec_type, target_uri, warc_date, http_headers, payload[, warc_headers]), the rows of a file together."""

    def __init__(self, root: str, names: list[str]):
        self.root, self.names = root.rstrip("/"), names
        self.job = uuid.uuid4().hex

    def write(self, rows):
        store, root = _store(self.root)
        done: list[tuple[str, str]] = []
        now, out = None, None
        for row in rows:
            rec = row.asDict()
            if rec["file"] != now:
                if out is not None:
                    out.close()
                now = rec["file"]
                part = f"{root}/_parts/{self.job}/{uuid.uuid4().hex}"
                store.create_dir(part.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(part, compression=None)
                done.append((part, f"{root}/{now}.warc.gz"))
            out.write(gzip.compress(_as_record(rec), 6, mtime=0))
        if out is not None:
            out.close()
        return _Written(done)

    def commit(self, messages):
        store, root = _store(self.root)
        seen: dict[str, str] = {}
        for m in messages:
            for part, path in m.files if m is not None else ():
                if path in seen:
                    raise ValueError(f"the rows of {path} were written by two tasks")
                seen[path] = part
        for path, part in seen.items():
            store.move(part, path)
        if store.get_file_info(f"{root}/_parts/{self.job}").type.name == "Directory":
            store.delete_dir(f"{root}/_parts/{self.job}")
        with store.open_output_stream(f"{root}/manifest.gz", compression=None) as f:
            f.write(gzip.compress("".join(f"{p[len(root) + 1:]}\n" for p in sorted(seen)).encode(), mtime=0))

    def abort(self, messages):
        store, root = _store(self.root)
        if store.get_file_info(f"{root}/_parts/{self.job}").type.name == "Directory":
            store.delete_dir(f"{root}/_parts/{self.job}")


def _as_record(rec: dict) -> bytes:
    """A row as a WARC record; HTTP headers, if any, stand before the payload."""
    block = bytes(rec["payload"] or b"")
    head = {"WARC-Type": rec["rec_type"], "WARC-Target-URI": rec.get("target_uri"), "WARC-Date": rec.get("warc_date"), **(rec.get("warc_headers") or {})}
    if rec.get("http_headers") is not None:
        block = rec["http_headers"].encode("iso-8859-1", "replace") + b"\r\n" + block
        head["Content-Type"] = f"application/http; msgtype={rec['rec_type']}"
    head["Content-Length"] = str(len(block))
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in head.items() if v is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _WarcStreamReader(DataSourceStreamReader):
    """Archive files as a stream: the offset names the files listed so far, whatever order they appear in."""

    def __init__(self, pattern: str, types, split: int):
        self.pattern, self.types, self.split = pattern, types, split

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        return {"files": _listed(self.pattern)}

    def partitions(self, start: dict, end: dict):
        before = set(start["files"])
        return _ranges([p for p in end["files"] if p not in before], self.split)

    def read(self, partition):
        yield from _scan(partition.path, partition.start, partition.stop, self.types)

    def commit(self, end: dict) -> None:
        pass


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("types", "request,response,metadata").load(glob)``;
    ``spark.readStream.format("warc")`` reads archive files as they appear; ``write_archives`` writes them."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return RECORD_SCHEMA

    def reader(self, schema):
        listed = self.options.get("paths")
        if listed:  # an explicit, ordered list (e.g. the first n files of a manifest)
            return _WarcReader([p for p in listed.split("\n") if p], self._types(), self._split())
        path = self.options.get("path")
        return _WarcReader(_listed(path) if path else [], self._types(), self._split())

    def writer(self, schema, overwrite):
        return _WarcWriter(self.options["path"], schema.names)

    def _split(self) -> int:
        return int(self.options.get("splitBytes", SPLIT_BYTES))

    def _types(self):
        types = self.options.get("types", ",".join(WANTED))
        return None if types == "*" else tuple(t for t in types.split(",") if t)

    def streamReader(self, schema):
        return _WarcStreamReader(self.options.get("path"), self._types(), self._split())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def read_archives(spark: SparkSession, path_glob: str, types: str = ",".join(WANTED), split_bytes: int = SPLIT_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("types", types).option("splitBytes", str(split_bytes)).load(path_glob)


def read_archive_list(spark: SparkSession, paths: list[str], types: str = ",".join(WANTED), split_bytes: int = 0) -> DataFrame:
    """Records of the given archive files, one partition per file unless ``split_bytes`` cuts them."""
    register(spark)
    return spark.read.format("warc").option("types", types).option("splitBytes", str(split_bytes)).option("paths", "\n".join(paths)).load()


def write_archives(records: DataFrame, path: str) -> None:
    """Write (file, ordinal, rec_type, target_uri, warc_date, http_headers, payload[, warc_headers]) as one archive
    ``<file>.warc.gz`` for each file, its records in ordinal order, and their names as ``manifest.gz``."""
    register(records.sparkSession)
    names = [c for c in ("file", "rec_type", "target_uri", "warc_date", "http_headers", "payload", "warc_headers") if c in records.columns]
    rows = records.repartition("file").sortWithinPartitions("file", "ordinal").select(*names)
    rows.write.format("warc").mode("append").save(path)


def stream_archives(spark: SparkSession, path_glob: str, types: str = ",".join(WANTED)) -> DataFrame:
    """Archive records as a stream of files (S3 for W2)."""
    register(spark)
    return spark.readStream.format("warc").option("types", types).load(path_glob)


def read_manifest(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Archive paths listed one per line in a (gzip) text file (S2); ``first`` keeps the first n (L2).

    A gzip file is one split, so the id attached here follows line order.
    """
    df = spark.read.text(path).select(F.monotonically_increasing_id().alias("ordinal"), F.col("value").alias("path"))
    if first is not None:
        df = df.orderBy("ordinal").limit(first)
    return df


_FETCHED = (("rec_type", "string"), ("target_uri", "string"), ("warc_date", "string"),
            ("http_headers", "string"), ("payload", "binary"))


def _fetch_task(base: str, carry: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        handle, name = None, None
        try:
            for pdf in batches:
                recs = []
                for fn, off, length in zip(pdf["warc_filename"], pdf["warc_record_offset"], pdf["warc_record_length"]):
                    if fn != name:
                        if handle is not None:
                            handle.close()
                        name = fn
                        handle = _open(os.path.join(base, fn))
                    handle.seek(int(off))
                    rec = next(parse_records(handle.read(int(length))), {})
                    recs.append([rec.get(f) for f, _ in _FETCHED])
                out = pdf[carry].reset_index(drop=True)
                fetched = pd.DataFrame(recs, columns=[f for f, _ in _FETCHED])
                yield pd.concat([out, fetched], axis=1)
        finally:
            if handle is not None:
                handle.close()

    return run


def fetch_records(locations: DataFrame, base: str, tasks: int | None = None) -> DataFrame:
    """Read one record per (warc_filename, warc_record_offset, warc_record_length) by byte range.

    Locations are range-partitioned by (file, offset) and sorted, so a task opens
    each file once and reads forward; every input column is carried through.
    """
    spark = locations.sparkSession
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    carry = locations.columns
    locs = locations.repartitionByRange(n, "warc_filename", "warc_record_offset").sortWithinPartitions(
        "warc_filename", "warc_record_offset"
    )
    fields = {f.name: f.dataType.simpleString() for f in locations.schema.fields}
    schema = ", ".join([f"{c} {fields[c]}" for c in carry] + [f"{f} {t}" for f, t in _FETCHED])
    return locs.mapInPandas(_fetch_task(base, carry), schema)


def write_archive(path: str, records: list[dict]) -> list[tuple[int, int]]:
    """Write records as a gzip-per-record archive; returns (offset, length) per record.  For tests and tools."""
    import gzip
    import io

    spans = []
    with open(path, "wb") as f:
        for r in records:
            block = r.get("block", b"")
            head = [f"WARC/1.0", f"WARC-Type: {r['type']}"]
            for k, v in r.get("headers", {}).items():
                head.append(f"{k}: {v}")
            head.append(f"Content-Length: {len(block)}")
            raw = ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
            bio = io.BytesIO()
            with gzip.GzipFile(fileobj=bio, mode="wb") as g:
                g.write(raw)
            start = f.tell()
            f.write(bio.getvalue())
            spans.append((start, f.tell() - start))
    return spans
