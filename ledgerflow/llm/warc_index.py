"""WARC archives and their merged capture index (operator 1).

``write_archives`` writes one WARC record per page through Spark's text sink
(gzip files of a bounded number of records, on any file system Spark writes to);
of equal payloads the one with the largest page_id is the response, the others
are revisits that refer to it. ``read_archives`` parses the files back by their
Content-Length and writes, for each archive, its run of index entries sorted by
URL key and capture time. ``merged_index`` range-partitions the runs by (URL key,
time, page_id) and merges the k runs of each range with a loser tree, so the
partitions in order are the capture histories in global order; a URL captured
very often spreads over ranges by time.

Pages carry no capture time: page_id seconds after CAPTURE_EPOCH stand for it.

Cases: a null html is an empty payload; a null url has no target URI and an empty
URL key; a null page_id gives a record without an id, a response unless its
payload has another owner; repeated rows repeat their records; an empty table
gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored
from ledgerflow.session import scratch_path

RECORDS_PER_FILE = 2048
CAPTURE_EPOCH = 1_700_000_000
CAPTURE_SPAN = 10 ** 9  # seconds after it in which capture times lie
MIN_REVISIT_BYTES = 0
INDEX = ("url_key string, capture_time long, page_id long, url string, record_type string, refers_to long, "
         "payload_bytes long, payload_digest string, archive string, record_offset long, record_length long")
IDS = ("page_id", "refers_to")
# ids go through the workers as text: pandas would make floats of them beside a null
_TEXT_IDS = INDEX.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")
ORDER = ["url_key", "capture_time", "page_id", "record_offset"]


def _as(kind: str) -> dict:
    return {c: F.col(c).cast(kind) for c in IDS}


def url_key(url):
    """Sort key of a URL: the host's labels from the last to the first, then port,
    path and query; scheme and fragment don't count."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.when(host == "", F.coalesce(url, F.lit(""))).otherwise(F.coalesce(key, F.lit("")))


def _header(name: str, value) -> str:
    return f"{name}: {value}\r\n"


def _record(page_id, url, payload: str, refers_to) -> str:
    body = payload.encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    revisit = refers_to is not None
    at = datetime.fromtimestamp(CAPTURE_EPOCH + (page_id or 0) % CAPTURE_SPAN, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = "WARC/1.1\r\n" + _header("WARC-Type", "revisit" if revisit else "response") + _header("WARC-Date", at)
    if page_id is not None:
        head += _header("WARC-Record-ID", f"<urn:page:{page_id}>")
    if url is not None:
        safe = "".join(c if c >= " " and c != "\x7f" and c != "%" else f"%{ord(c):02X}" for c in url)
        head += _header("WARC-Target-URI", safe)
    head += _header("WARC-Payload-Digest", f"sha1:{digest}")
    if revisit:
        head += _header("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head += _header("WARC-Refers-To", f"<urn:page:{refers_to}>") + _header("X-Payload-Length", len(body))
        payload, body = "", b""
    return head + _header("Content-Length", len(body)) + "\r\n" + payload + "\r\n"


def write_archives(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Write the archives into a new folder of the shared scratch space; its path."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.sha1(F.encode("html", "UTF-8"))
    size = F.octet_length("html")
    owners = stored(p.select("page_id", digest.alias("sha"), size.alias("size")).where(F.col("size") >= min_bytes)
                    .groupBy("sha", "size").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
                    .where("n > 1 and owner is not null").drop("n"), "payload-owners")
    linked = (p.withColumn("sha", digest).withColumn("size", size).join(owners, ["sha", "size"], "left")
              .withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("owner")),
                                              F.col("owner")))
              .select("page_id", "url", "html", "refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            none = lambda x: None if x is None else int(x)
            yield pd.DataFrame({"value": [_record(none(i), u, h, none(r)) for i, u, h, r in
                                          zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"])]})

    path = scratch_path(pages.sparkSession, "warc")
    (linked.withColumns(_as("string")).mapInPandas(run, "value string").write.option("lineSep", "\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))
    return path


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, payload, offset, length) of each record of an unpacked archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size = int(head["Content-Length"])
        yield head, data[end + 4:end + 4 + size], at, end + 8 + size - at
        at = end + 8 + size


def _unescape(uri: str) -> str:
    parts = uri.split("%")
    return parts[0] + "".join(chr(int(x[:2], 16)) + x[2:] for x in parts[1:])


def _entry(head: dict[str, str], payload: bytes, archive: str, at: int, length: int) -> tuple:
    number = lambda name: int(head[name][10:-1]) if name in head else None  # noqa: E731  <urn:page:N>
    revisit = head["WARC-Type"] == "revisit"
    digest = head["WARC-Payload-Digest"][5:] if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    time = datetime.strptime(head["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
    uri = head.get("WARC-Target-URI")
    return (int(time.timestamp()), number("WARC-Record-ID"), None if uri is None else _unescape(uri),
            head["WARC-Type"], number("WARC-Refers-To"), int(head["X-Payload-Length"]) if revisit else len(payload),
            digest, archive, at, length)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of every record, one run per archive, each run sorted; stored."""
    cols = ["capture_time", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest",
            "archive", "record_offset", "record_length"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"]):
                data = zlib.decompress(content, 31) if content else b""
                rows = [_entry(h, b, archive.rsplit("/", 1)[-1], at, n) for h, b, at, n in parse_records(data)]
                ids = [[r[i] for r in rows] for i in (1, 4)]
                out = pd.DataFrame(rows, columns=cols, dtype=object)
                yield out.assign(**{c: pd.array([None if x is None else str(x) for x in found], dtype="string")
                                    for c, found in zip(IDS, ids)})

    schema = _TEXT_IDS.split(", ", 1)[1]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    runs = files.mapInPandas(run, schema).withColumns({**_as("long"), "url_key": url_key(F.col("url"))})
    return stored(runs.sortWithinPartitions("archive", *ORDER), "index-runs")


class LoserTree:
    """k sorted sequences merged: each inner node keeps the loser of its match."""

    def __init__(self, runs: list[list]):
        self.k = max(1, len(runs))
        self.runs = [iter(r) for r in runs] or [iter(())]
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf)

    def _before(self, x: int, y: int) -> bool:
        a, b = self.heads[x], self.heads[y]
        return b is None if a is None or b is None else (a, x) < (b, y)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            held = self.tree[node]
            if held < 0:
                self.tree[node] = winner
                return
            if self._before(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while (w := self.tree[0]) >= 0 and self.heads[w] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def _key_part(x):
    """Nulls first, as Spark sorts."""
    return (0, 0) if x is None or pd.isna(x) else (1, int(x))


def merged_index(runs: DataFrame) -> DataFrame:
    """All entries in global order over the partitions; ``slot`` is the place in one."""
    names = [x.split()[0] for x in INDEX.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True)
        keys = list(zip(pdf["url_key"], pdf["capture_time"], map(_key_part, pdf["page_id"]),
                        pdf["record_offset"], range(len(pdf))))
        cuts = [0, *(pdf["archive"].ne(pdf["archive"].shift()).to_numpy().nonzero()[0][1:]), len(pdf)]
        order = [x[-1] for x in LoserTree([keys[a:b] for a, b in zip(cuts, cuts[1:])])]
        yield pdf.iloc[order].assign(slot=range(len(pdf)))

    ranged = runs.select(*names).repartitionByRange(*ORDER, "archive").sortWithinPartitions("archive", *ORDER)
    return ranged.withColumns(_as("string")).mapInPandas(run, _TEXT_IDS + ", slot long").withColumns(_as("long"))


def capture_index(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages``, read them back, merge their index."""
    spark = pages.sparkSession
    return merged_index(read_archives(spark, write_archives(pages)))
