"""Web pages in WARC archives with a two-level capture index.

Every page becomes one gzip-compressed record. Of records with equal payloads of at least `least` bytes the one with
the largest page_id is the response; the others are revisits that name it and carry no payload. The index sorts
captures by reversed-host URL key into compressed blocks; a sparse directory (first key and place of each block)
closes each index file, and a list of the files' first keys stands above. A lookup bisects the list, then the
directory, reads one block by range, bisects it, and reads the record by range. Nothing in it grows with the number
of captures but the files themselves: blocks have `block` captures, files a share of the table.

A null html is an empty payload, a null url the key "". Repeated rows each get a record (with equal large payloads and
page_id they are all responses); captures of one key are in page_id order (null first). A very long page is one record;
tasks write records and blocks as they go. Columns other than page_id, url and html are left out, whatever their names.
An empty table gives no archive, an empty index and no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, filesystem, partitions, publishing, shared_dir, stored


def url_key(url) -> F.Column:
    """http://www.a.example.org:80/p?q#f -> org,example,a)/p?q : scheme, leading www and fragment dropped, host reversed, lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"(^www\d*\.)|(:(80|443)$)", ""))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(bare, r"^[^/?]*(.*)$", 1))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parsed(data: bytes) -> dict:
    """One record: its WARC header fields, the HTTP Content-Length and the payload. A response is checked against its digest."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a damaged record")
    page = lambda k: int(x) if (x := fields.get(k, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"), "payload": payload}


def write_archives(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write pages(page_id, url, html) as WARC files in a new shared folder: key, page_id, path, offset, length of each record."""
    folder = shared_dir(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    # partial counts first: copies that fill a third of the table are one row a task here
    again = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = rows.join(broadcast_if_small(stored(again, "payloads")), "digest", "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = (b for b in batches if len(b))
        head = next(batches, None)
        if head is None:
            return
        path, at = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with publishing(path) as out:
            for b in itertools.chain([head], batches):
                places = []
                for r in b.itertuples():
                    page_id, first = (None if pd.isna(x) else int(x) for x in (r.page_id, r.first))
                    revisit = first is not None and page_id != first
                    data = record_bytes(page_id, r.url, r.payload, r.size, r.digest, "revisit" if revisit else "response", first)
                    places.append((r.key, page_id, path, at, len(data)))
                    out.write(data)
                    at += len(data)
                yield pd.DataFrame(places, columns=["key", "page_id", "path", "offset", "length"]).astype({"page_id": "Int64"})

    rows = rows.select("page_id", "url", "payload", "size", "digest", "first", url_key(F.col("url")).alias("key"))
    return stored(rows.mapInPandas(write, "key string, page_id long, path string, offset long, length long"), "captures")


#: Captures of one key are in this order.
def _order(key: str, page_id: int | None) -> tuple:
    return key, page_id is not None, page_id or 0


def write_index(captures: DataFrame, block: int = 3000) -> list[tuple[tuple, str]]:
    """Write the index of captures; returns the top list: (first key and page, path) of each file, in order.

    An index file: compressed blocks, the compressed directory, u64 place of the directory.
    """
    spark = captures.sparkSession
    folder = shared_dir(spark, "index")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = ((*_order(r.key, None if pd.isna(r.page_id) else int(r.page_id)), r.path, r.offset, r.length) for b in batches for r in b.itertuples())
        head = next(lines, None)
        if head is None:
            return
        path, directory, at = f"{folder}/part-{TaskContext.get().partitionId():06d}.idx", [], 0
        with publishing(path) as out:
            for own in iter(lambda rest=itertools.chain([head], lines): list(itertools.islice(rest, block)), []):
                data = zlib.compress(json.dumps(own).encode())
                directory.append((*own[0][:3], at, len(data)))
                out.write(data)
                at += len(data)
            out.write(zlib.compress(json.dumps(directory).encode()) + struct.pack("<Q", at))
        yield pd.DataFrame({"key": [head[0]], "known": [head[1]], "page_id": [head[2]], "path": [path]})

    rows = captures.repartitionByRange(partitions(spark), "key", "page_id").sortWithinPartitions("key", "page_id")
    files = stored(rows.mapInPandas(write, "key string, known boolean, page_id long, path string"), "index-files")
    # one entry for each index file
    return sorted(((f["key"], f["known"], f["page_id"]), f["path"]) for f in files.toLocalIterator())


class Index:
    """Range reads on index files; keeps the directory and the block used last."""

    def __init__(self, top: list[tuple[tuple, str]]):
        self.firsts, self.paths = [k for k, _ in top], [p for _, p in top]
        self.at: tuple = ()
        self.block_at: tuple = ()

    def find(self, key: str, page_id: int | None) -> list[tuple[str, int, int]]:
        """(path, offset, length) of the records of a capture."""
        want, out = _order(key, page_id), []
        for file in range(max(0, bisect.bisect_left(self.firsts, want) - 1), bisect.bisect_right(self.firsts, want)):
            directory = self._directory(file)
            firsts = [tuple(d[:3]) for d in directory] if self.at[0] != file else self.at[2]
            for k in range(max(0, bisect.bisect_left(firsts, want) - 1), bisect.bisect_right(firsts, want)):
                lines, keys = self._block(file, directory[k])
                for line in lines[bisect.bisect_left(keys, want) : bisect.bisect_right(keys, want)]:
                    out.append(tuple(line[3:]))
        return out

    def _range(self, path: str, at: int | None, length: int) -> bytes:
        fs, p = filesystem(path)
        with fs.open_input_file(p) as s:
            s.seek(s.size() + at if at < 0 else at)
            return s.read(length)

    def _directory(self, file: int) -> list:
        if self.at[:1] != (file,):
            fs, p = filesystem(self.paths[file])
            with fs.open_input_file(p) as s:
                size = s.size()
                s.seek(size - 8)
                start = struct.unpack("<Q", s.read(8))[0]
                s.seek(start)
                directory = json.loads(zlib.decompress(s.read(size - 8 - start)))
            self.at = (file, directory, [tuple(d[:3]) for d in directory])
        return self.at[1]

    def _block(self, file: int, entry: list) -> tuple[list, list]:
        if self.block_at[:1] != ((file, entry[3]),):
            lines = json.loads(zlib.decompress(self._range(self.paths[file], entry[3], entry[4])))
            self.block_at = ((file, entry[3]), lines, [tuple(x[:3]) for x in lines])
        return self.block_at[1], self.block_at[2]


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_captures(wanted: DataFrame, top: list[tuple[tuple, str]]) -> DataFrame:
    """RECORDS of the captures wanted(url, page_id), found through the index. A capture that is not there gives no row.

    Wanted rows are sorted like the index, so a task goes through few blocks, each read once. top has one entry for
    each index file, whose number is a setting of the job that wrote them.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, files = Index(top), {}
        for b in batches:
            out, size = [], 0
            for key, page_id in zip(b["key"], b["page_id"], strict=True):
                for path, offset, length in index.find(key, None if pd.isna(page_id) else int(page_id)):
                    if path not in files:
                        if len(files) >= 64:
                            files.pop(next(iter(files))).close()
                        fs, p = filesystem(path)
                        files[path] = fs.open_input_file(p)
                    files[path].seek(offset)
                    out.append(parsed(files[path].read(length)))
                    size += len(out[-1]["payload"])
                    if size > 1 << 22:
                        yield _records(out)
                        out, size = [], 0
            if out:
                yield _records(out)
        for f in files.values():
            f.close()

    rows = wanted.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long"))
    # a wanted capture is looked up once, so that repeated rows give each of its records once
    rows = rows.distinct().repartitionByRange(partitions(wanted.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")
    return rows.mapInPandas(read, RECORDS)


def _records(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT html, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN g.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.first <> p.page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html AND p.n >= 1000
"""
