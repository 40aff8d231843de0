"""Operator 7: WARC archives of pages and their merged capture index."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.plans.scratch import Scratch, scratch_root

END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
PROFILE = b"http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query, lower-cased: ``com,example)/a?b``."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    labels = host.removeprefix("www.").split(".")
    port_ = "" if port in (None, 80, 443) else f":{port}"
    path = parts.path if len(parts.path) < 2 else parts.path.rstrip("/")
    return (",".join(reversed(labels)) + port_ + ")" + (path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def decide(pages: DataFrame, least: int) -> DataFrame:
    """``(id, sha, refers_to)`` for the rows of ``pages(id, sha, n)`` that revisit an equal payload of a larger id.

    Only ids, lengths and digests move; the largest id of each payload is found with a combined aggregate.
    """
    large = pages.filter(F.col("n") >= least).select("id", "sha")
    last = large.groupBy("sha").agg(F.max("id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1")
    found = large.join(last, "sha").filter(F.col("refers_to").isNotNull() & ~F.col("id").eqNullSafe(F.col("refers_to")))
    return found.select("id", "sha", "refers_to").distinct()


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    time_col: str | None = None,
    *,
    revisit_bytes: int = 0,
) -> bytes:
    """Write one record for each row of ``pages`` below ``folder`` and return the line that opens each record.

    Each input split becomes one archive file.  A payload is the html in UTF-8 (null: empty).  Of rows
    with equal payloads of at least ``revisit_bytes`` bytes the largest id is written as a response, the
    others as revisits without body; rows that repeat that id are responses too, rows without id revisit
    an id if there is one.  Records come with their offset in the file.  Dates are ``time_col``, or
    2024-01-01 plus the id in seconds.  The opening line holds a random mark drawn after the payloads
    were there, so no payload contains it and the files can be read by record at any size.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    when = F.col(time_col).cast("timestamp").cast("bigint") if time_col else F.lit(None).cast("bigint")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), when.alias("time"),
        html.alias("payload"), F.sha1(html).alias("sha"),
    )
    again = decide(rows.select("id", "sha", F.octet_length("payload").alias("n")), revisit_bytes)
    again = Scratch(spark, "warc").save(again, "r").df.toDF("id_", "sha_", "refers_to")
    # written before the join: a small table is broadcast and no payload is shuffled
    rows = rows.join(again, rows["id"].eqNullSafe(again["id_"]) & (rows["sha"] == again["sha_"]), "left")
    mark = b"WARC/1.0\r\nX-Archive: " + uuid.uuid4().hex.encode() + b"\r\n"

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset = 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                made = mark + record(offset=offset, **row)
                offset += len(made) + len(END)
                out.append(made)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    chosen = rows.select("id", "url", "time", "payload", "refers_to")
    text = chosen.mapInArrow(records, "value binary").select(F.col("value").cast("string"))
    text.write.option("lineSep", END.decode()).text(folder)
    return mark


def record(id: int | None, url: str | None, time: int | None, payload: bytes, refers_to: int | None, offset: int) -> bytes:
    """One record without its opening line and without the empty lines at its end."""
    date = EPOCH + dt.timedelta(seconds=(id or 0) % 10**9) if time is None else dt.datetime.fromtimestamp(time, dt.UTC)
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if id is None else id}>",
        "WARC-Date": date.strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": "sha1:" + digest(payload),
        "X-Payload-Length": len(payload),
        "X-Offset": offset,
    }
    body = HTTP + payload
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE.decode(), "WARC-Refers-To": f"<urn:page:{refers_to}>"}
        body = HTTP
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(body)}
    return "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body


def parse(data: bytes) -> dict:
    """The index entry of one record as ``record`` makes it; a damaged record is an error."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    if len(body) != int(fields["Content-Length"]):
        raise ValueError(f"record {fields['WARC-Record-ID']} has {len(body)} bytes instead of {fields['Content-Length']}")
    kind, claimed = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["X-Payload-Length"])
    if kind == "response":
        payload = body.partition(b"\r\n\r\n")[2]
        if (len(payload), digest(payload)) != (size, claimed):
            raise ValueError(f"record {fields['WARC-Record-ID']} does not have the payload of its header")

    def page(name: str) -> int | None:
        text = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    return {
        "page_id": page("WARC-Record-ID"), "url_key": url_key(fields["WARC-Target-URI"]),
        "captured": "".join(c for c in fields["WARC-Date"] if c.isdigit()), "url": fields["WARC-Target-URI"],
        "payload_bytes": size, "payload_digest": claimed, "record_type": kind, "refers_to": page("WARC-Refers-To"),
        "offset": int(fields["X-Offset"]), "length": len(data),
    }


_INDEX = pa.schema(
    [("page_id", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()),
     ("file", pa.string())]
)
_SQL = ", ".join(f"`{f.name}` {'bigint' if f.type == pa.int64() else 'string'}" for f in _INDEX)
ORDER = ["url_key", "captured", "page_id"]


def read_archives(spark: SparkSession, folder: str, mark: bytes) -> DataFrame:
    """One index entry for each record of the archives below ``folder``; payloads are checked, not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, path in zip(batch.column(0), batch.column(1)):
                # before the first mark is nothing; what follows a record is its end
                if data := data.as_py().removesuffix(END):
                    rows.append(parse(data) | {"file": path.as_py().rsplit("/", 1)[-1], "length": len(mark) + len(data)})
            yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)

    lines = spark.read.option("lineSep", mark.decode()).text(folder)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path")).mapInArrow(run, _SQL)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so that a step replays one path."""

    def __init__(self, runs: list[list]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.size = max(1, 1 << (len(runs) - 1).bit_length())
        self.losers = [-1] * self.size
        winners = [-1] * self.size + [i if i < len(runs) else -1 for i in range(self.size)]
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1]

    def _before(self, a: int, b: int) -> bool:
        """Whether the head of run ``a`` comes first; an ended or missing run loses, ties go to the first run."""
        if a < 0 or self.at[a] == len(self.runs[a]):
            return False
        if b < 0 or self.at[b] == len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x[0] < y[0] or (x[0] == y[0] and a < b)

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            node = (self.size + run) // 2
            while node:
                if self._before(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def merge_index(entries: DataFrame, rows_per_range: int = 200_000) -> DataFrame:
    """``entries`` with ``run`` and ``place``: ``place`` orders all captures by URL key, time and id.

    Each task's entries are sorted and written as one run.  Ranges of (URL key, time, id) take their slice of
    every run, and within a range the slices are merged by a loser tree.  A range is held in memory and
    has about ``rows_per_range`` entries; a very common URL key is cut by time and id.  ``place`` has the
    number of the range in its upper bits; null ids come first, equal entries go by run.
    """
    scratch = Scratch(entries.sparkSession, "index")
    runs = scratch.save(entries.sortWithinPartitions(*ORDER).withColumn("run", F.spark_partition_id()), "r")
    columns = [*_INDEX.names, "run"]
    schema = pa.schema([*_INDEX, ("run", pa.int32()), ("place", pa.int64())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["url_key"], row["captured"], row["page_id"] is not None, row["page_id"] or 0)
                slices.setdefault(row["run"], []).append((key, row))
        base, out = TaskContext.get().partitionId() << 33, []
        for i, (_, row) in enumerate(LoserTree([slices[r] for r in sorted(slices)]) if slices else ()):
            out.append(row | {"place": base + i})
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    ranges = max(1, -(-runs.rows // rows_per_range))
    dealt = runs.df.select(*columns).repartitionByRange(ranges, *ORDER).sortWithinPartitions("run", *ORDER)
    return dealt.mapInArrow(merge, f"{_SQL}, run int, place bigint")


def capture_history(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Archives written and read back, and their merged index: one row for each row of ``pages``.

    ``folder`` is a new folder that all executors share, by default one below ``spark.checkpoint.dir``.
    """
    spark = pages.sparkSession
    folder = folder or f"{scratch_root(spark)}/factlake/archives-{uuid.uuid4().hex[:12]}"
    mark = write_archives(pages, folder, **options)
    return merge_index(read_archives(spark, folder, mark))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op7_warc_index``: all pages through archives into one index, its entries with their place in the merged order."""
    found = capture_history(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    base = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.select(*base, "url_key", "captured", "place", "run", "file", "offset", "length")
