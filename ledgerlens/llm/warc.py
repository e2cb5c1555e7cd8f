"""WARC archives: written with revisits for equal payloads, read back, merged into capture histories.

Writing: payloads are hashed, the largest id of each equal payload is found by a combined maximum over narrow
rows, and only payloads seen more than once are joined back to the pages.  A record ends with two line
breaks, so Spark's text writer with that separator produces the archive files, gzipped, with its commit protocol.

Reading: every archive file is parsed by the lengths in its headers, digests are checked, and its captures
are sorted by URL key and time: one run per file.  Merging: runs are cut at range boundaries of (URL key,
time, id), and each range is merged from its run segments by a loser tree, so the whole is in global order
and a URL with a third of the captures spreads over several ranges.

Defined cases: null payload: empty.  Null URL: no target header, empty URL key.  Null id: revisits
the largest known id with its payload; a response if there is none.  Repeated rows: a record each; all rows
with the largest id are responses.  Extra columns are ignored.  Bytes that disagree with their digest stop the job.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import staged, table
from ledgerlens.session import ensure_checkpoint_dir

BREAK = "\r\n"
RECORD_END = BREAK + BREAK
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_BYTES = 16 << 20      # aimed at for one archive file, which one task reads whole
RANGE_ROWS = 200_000       # captures merged by one task
FIRST_CAPTURE = 1_700_000_000


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a 40-digit hexadecimal SHA-1: five hexadecimal digits make four characters."""
    chars = []
    for group in range(8):
        value = F.conv(F.substring(digest, group * 5 + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            chars.append(F.substr(F.lit(ALPHABET), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*chars)


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``digest``, ``bytes`` and ``refers_to``: the largest id with an equal payload, null for the response itself."""
    hashed = pages.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    # a second, independent hash and the length stand beside SHA-1, whose collisions can be made
    keyed = hashed.withColumn("second", F.xxhash64("payload"))
    same = (staged(keyed.where(F.col("bytes") >= min_bytes).select("id", "digest", "second", "bytes"))
            .groupBy("digest", "second", "bytes").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return keyed.join(same, ["digest", "second", "bytes"], "left").withColumn(
        "refers_to", F.when(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")), F.col("last"))).drop("second", "last")


def record(payload: str = "payload") -> Column:
    """The WARC record of a row of ``with_references``, without the closing line breaks."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(BREAK * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col(payload)))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))

    def urn(column: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("none")), F.lit(">"))

    return F.concat(
        F.lit(f"WARC/1.1{BREAK}"), header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", urn("id")), header("WARC-Date", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        header("WARC-Target-URI", uri), header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))),
        header("WARC-Refers-To", F.when(revisit, urn("refers_to"))),
        header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(block).cast("string")), F.lit(BREAK), block)


def write(pages: DataFrame, path: str, min_bytes: int = 0, file_records: int = 4096) -> None:
    """Archives of ``pages`` (id, url, captured, payload) under ``path``."""
    plain = pages.select("id", "url", "captured", F.coalesce("payload", F.lit("")).alias("payload"))
    (with_references(plain, min_bytes).select(record().alias("value"))
     .write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path))


CAPTURES = ("url_key string, captured string, id long, record_type string, refers_to long, payload_bytes long, "
            "payload_digest string, file string, offset long, length long, place long")  # offsets are those before compression


def url_key(uri: str) -> str:
    """Sort-friendly form: host labels from the right, then path and query."""
    rest = uri.split("://", 1)[-1].split("#", 1)[0]
    cut = min([i for i in (rest.find(c) for c in "/?") if i >= 0], default=len(rest))
    return f"{','.join(reversed(rest[:cut].lower().split('.')))}){rest[cut:] or '/'}" if rest else ""


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """Headers, offset, length and block of each record."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode().split(BREAK)
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = head_end + 4
        end = start + int(headers["Content-Length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, at, end + 4 - at, data[start:end]
        at = end + 4


def _page(urn: str | None) -> int | None:
    value = urn[len("<urn:page:"):-1] if urn else "none"
    return None if value == "none" else int(value)


def capture_of(headers: dict[str, str], block: bytes) -> tuple:
    """Type, reference, bytes and digest of the full payload; checks a stored payload against its digest."""
    cut = block.index(b"\r\n\r\n") + 4
    said = int(dict(x.split(": ", 1) for x in block[:cut - 4].decode().split(BREAK)[1:])["Content-Length"])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response":
        payload = block[cut:]
        if len(payload) != said or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} disagrees with its digest")
    return headers["WARC-Type"], _page(headers.get("WARC-Refers-To")), said, digest


def _sort_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CAPTURES.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            run = []
            for headers, at, length, block in parse(gzip.decompress(content) if path.endswith(".gz") else content):
                kind, refers, size, digest = capture_of(headers, block)
                run.append((url_key(headers.get("WARC-Target-URI", "")), headers["WARC-Date"], _page(headers["WARC-Record-ID"]),
                            kind, refers, size, digest, path, at, length))
            run.sort(key=_sort_key)
            if run:
                yield pd.DataFrame([(*r, i) for i, r in enumerate(run)], columns=names).astype({"id": "Int64", "refers_to": "Int64"})


class LoserTree:
    """Merges sorted lists: inner nodes keep the loser of their match, so a step replays one path."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        self.heads = [key(r[0]) if r else None for r in runs]
        k = max(1, len(runs))
        self.losers = [-1] * k  # losers[0] is the overall winner
        for i in range(len(runs)):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _replay(self, i: int) -> None:
        winner, node = i, (i + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # first arrival while building waits here
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.runs and self.heads[self.losers[0]] is not None:
            i = self.losers[0]
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.heads[i] = self.key(self.runs[i][self.at[i]]) if self.at[i] < len(self.runs[i]) else None
            self._replay(i)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CAPTURES.split(", ")]
    runs: dict[str, list] = {}
    for batch in batches:
        batch = batch[names].astype(object).where(batch[names].notna(), None)
        for row in batch.itertuples(index=False, name=None):
            runs.setdefault(row[7], []).append(row)
    out = []
    for row in LoserTree(list(runs.values()), _sort_key):
        out.append(row)
        if len(out) == 10_000:
            yield pd.DataFrame(out, columns=names).astype({"id": "Int64", "refers_to": "Int64"})
            out = []
    if out:
        yield pd.DataFrame(out, columns=names).astype({"id": "Int64", "refers_to": "Int64"})


def capture_histories(spark: SparkSession, path: str) -> DataFrame:
    """All captures of the archives under ``path``, in order of URL key, time and id over all partitions."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    runs = staged(files.mapInPandas(_runs, CAPTURES))
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    laid = runs.repartitionByRange(ranges, "url_key", "captured", "id", "file", "offset").sortWithinPartitions("file", "place")
    return laid.mapInPandas(_merge, CAPTURES)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), "url", F.col("html").alias("payload"),
        F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + FIRST_CAPTURE).alias("captured"))
    size = pages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()
    per_file = max(1, int(FILE_BYTES * size[0] / max(1, size[1] + 600 * size[0]))) if size[0] else 1
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, 0, per_file)
    return capture_histories(spark, path).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
last AS (SELECT payload, max(page_id) AS last FROM hashed GROUP BY payload)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM hashed JOIN last USING (payload)
"""
