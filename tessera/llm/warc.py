"""WARC archives: written one transaction a capture, read back and put together again.

Each capture becomes a request, a response (or revisit) and a metadata record; request and
metadata name the response they belong to by ``WARC-Concurrent-To``. Files go through Spark's
text writer with the record separator as line separator, so they land wherever Spark can
write, compressed by gzip and of bounded size: payloads are written by classes of size, the larger
the fewer of them a file. Reading parses them by
their Content-Length, checks each payload against its digest, and joins the records of a
transaction into one nested row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._joins import join_checked
from tessera.llm._storage import saved

CRLF = "\r\n"
END = CRLF + CRLF
DATE = "2025-01-01T00:00:00Z"
RECORDS_A_FILE = 6000
#: Bytes of payload in a file at most, but for single payloads that are larger.
BYTES_A_FILE = 1 << 26


def base32(hexes: str) -> Column:
    """A SHA-1 in hex digits as upper-case base32: five digits make four letters."""
    parts = [F.conv(F.substring(hexes, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    return F.concat(*(F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(p, n).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for p in parts for n in (15, 10, 5, 0)))


def _record_id(kind: str, *parts: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, n in zip((1, 9, 13, 17, 21), (8, 4, 4, 4, 12)) for x in (F.substring(h, i, n), F.lit(">" if i == 21 else "-"))))


def _record(kind: Column | str, record_id: Column, block: Column, mime: Column | str, *more: tuple[str, Column]) -> Column:
    """Header and block; the separator that ends a record is the writer's line separator."""
    one = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(DATE)), *more, ("Content-Type", F.lit(mime) if isinstance(mime, str) else mime)]
    # a header with a null value is left out
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in one]
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, records: int = RECORDS_A_FILE, most_bytes: int = BYTES_A_FILE) -> None:
    """Write a transaction for each row of ``pages`` below the folder ``path``.

    A file holds ``records`` records at most, and of payloads larger than ``most_bytes`` would allow
    for so many only a share: up to 16 times that size a 16th, and so on to one transaction a file.
    Of rows with equal payloads of ``least_bytes`` bytes or more, the one with the smallest
    key is a response, those with larger keys are revisits of it.
    """
    own = pages.select(F.col(key).alias("key"), F.coalesce(F.regexp_replace(url, r"[\r\n]", " "), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("body"))
    own = own.withColumn("sha1", F.sha1(F.col("body").cast("binary")))
    sized = own.where(F.octet_length("body") >= least_bytes)
    groups = saved(sized.groupBy("sha1").agg(F.count("*").alias("n"), F.min(F.when(F.col("key").isNotNull(), F.struct("key", "url"))).alias("first")).where("n > 1").select("sha1", "first"))
    rows = join_checked(own, groups, "sha1", "left", wide=("first.url",)).withColumn("revisit", F.coalesce((F.octet_length("body") >= least_bytes) & (F.col("key") > F.col("first.key")), F.lit(False)))
    rows = rows.withColumns({"digest": base32("sha1"), "first_key": F.col("first.key"), "first_url": F.col("first.url")})
    own_id, other_id = _record_id("response", "key", "url", "sha1"), _record_id("response", "first_key", "first_url", "sha1")
    digest = F.concat(F.lit("sha1:"), "digest")
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=UTF-8" + CRLF + "Content-Length: "), F.octet_length("body").cast("string"), F.lit(END), F.when(F.col("revisit"), "").otherwise(F.col("body")))
    revisit = F.col("revisit")
    main = _record(
        F.when(revisit, "revisit").otherwise("response"),
        own_id,
        http,
        "application/http; msgtype=response",
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", digest),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(revisit, other_id)),
    )
    where = F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)
    request = _record("request", _record_id("request", "key", "url", "sha1"), F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1" + CRLF + "Host: "), where, F.lit(END)), "application/http; msgtype=request", ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", own_id))
    fields = F.concat(F.coalesce(F.concat(F.lit("capture-key: "), F.col("key").cast("string"), F.lit(CRLF)), F.lit("")), F.lit("payload-length: "), F.octet_length("body").cast("string"), F.lit(CRLF))
    metadata = _record("metadata", _record_id("metadata", "key", "url", "sha1"), fields, "application/warc-fields", ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", own_id))
    bound, level = most_bytes * 3 // records, F.lit(0)
    limits = [records]
    while limits[-1] > 3:
        level = F.when(F.octet_length("body") > bound, len(limits)).otherwise(level)
        limits.append(max(3, limits[-1] // 16))
        bound *= 16
    used = sorted(r[0] for r in own.select(level.alias("level")).distinct().collect())
    for n, k in enumerate(used or [0]):
        part = rows if len(used) < 2 else rows.where(level == k)
        lines = part.select(F.explode(F.array(request, main, metadata)).alias("value"))
        lines.write.mode("append" if n else "overwrite").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", limits[k]).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record; header names are in lower case, lines that go on with a blank are joined to the one before."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        header: dict[str, str] = {}
        name = ""
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace")
            if name and text[0] in " \t":
                header[name] = f"{header[name]} {text.strip()}".strip()
                continue
            name, _, value = text.partition(":")
            name = name.strip().lower()
            header[name] = value.strip()
        size = int(header.get("content-length", "0"))
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {header.get('warc-record-id')} is cut short")
        yield header, block


def has_digest(payload: bytes, claimed: str | None) -> bool | None:
    """Whether a payload has the digest ``algorithm:value``, in hexadecimal or base32 of any case; none: it can't be judged (no digest, or an unknown algorithm)."""
    name, _, value = (claimed or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    digest, value = hashlib.new(name, payload).digest(), value.strip()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


_FIELDS = (("record_id", "warc-record-id"), ("warc_type", "warc-type"), ("concurrent_to", "warc-concurrent-to"), ("target_uri", "warc-target-uri"), ("warc_date", "warc-date"), ("refers_to", "warc-refers-to"), ("digest", "warc-payload-digest"))
_KINDS = pa.schema([*((n, pa.string()) for n, _ in _FIELDS), ("payload_bytes", pa.int64()), ("computed", pa.string()), ("matches", pa.bool_()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all files below ``path``: header fields, payload (if asked for), its size and computed digest,
    and the fields of metadata records. Files may have any name that doesn't begin with ``_`` or ``.``; gzip is
    told by their first bytes."""

    def rows(content: bytes) -> Iterator[tuple]:
        raw = io.BytesIO(content)
        with gzip.open(raw) if content[:2] == b"\x1f\x8b" else raw as stream:
            for header, block in parse(stream):
                fields, payload = None, block
                if "http" in header.get("content-type", ""):
                    payload = block.partition(b"\r\n\r\n")[2]
                if header.get("warc-type") == "metadata":
                    pairs = (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)
                    fields = [(n.strip(), v.strip()) for n, _, v in pairs]
                full = header.get("warc-type") in ("response", "resource")
                computed = base64.b32encode(hashlib.sha1(payload).digest()).decode() if full else None
                claimed = header.get("warc-payload-digest")
                matches = (claimed == f"sha1:{computed}" or has_digest(payload, claimed)) if full else None
                yield (*(header.get(h) for _, h in _FIELDS), len(payload), computed, matches, payload if full and with_payload else None, fields)

    def batches(content: bytes, size: int = 500) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for r in rows(content):
            held.append(r)
            if len(held) == size:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _KINDS)], schema=_KINDS)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _KINDS)], schema=_KINDS)

    def run(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files:
            for content in batch.column(0):
                yield from batches(content.as_py())

    made = ", ".join([f"{n} string" for n, _ in _FIELDS] + ["payload_bytes bigint", "computed string", "matches boolean", "payload binary", "fields map<string,string>"])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[_.]")).select("content").mapInArrow(run, made)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row a capture: (record_id, response, request, metadata).

    request and metadata are joined by the response they name in concurrent_to, or by the
    request that the response names; of several the one with the smallest record id counts, null
    if there is none. Records that name no capture are left out.
    """
    main = records.where(F.col("warc_type").isin("response", "revisit", "resource"))
    main = main.select("record_id", "concurrent_to", F.struct("warc_type", "target_uri", "warc_date", "refers_to", "digest", "computed", "matches", "payload_bytes", "payload").alias("response"))
    out = main
    for kind in ("request", "metadata"):
        own = records.where(F.col("warc_type") == kind).select("record_id", "concurrent_to", F.struct("record_id", "target_uri", "warc_date", "fields").alias(kind))
        named = own.where(F.col("concurrent_to").isNotNull()).select(F.col("concurrent_to").alias("of"), kind, F.col("record_id").alias("own_id"))
        if kind == "request":
            back = main.where(F.col("concurrent_to").isNotNull()).select(F.col("record_id").alias("of"), F.col("concurrent_to").alias("own_id"))
            named = named.unionByName(own.select(F.col("record_id").alias("own_id"), kind).join(back, "own_id").select("of", kind, "own_id"))
        one = named.groupBy("of").agg(F.min_by(kind, "own_id").alias(kind))
        out = out.join(one, out["record_id"] == one["of"], "left").drop("of")
    return out.select("record_id", "response", "request", "metadata")


def captures(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The transactions of the archives below ``path``, with ``payload_ok``: whether the payload has the digest it claims (see ``has_digest``); records without a payload of their own have nothing to fail."""
    found = transactions(saved(read_records(spark, path, with_payload)))
    return found.withColumn("payload_ok", F.when(F.col("response.computed").isNull(), True).otherwise(F.col("response.matches")))


def round_trip(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` below ``path``, read the archives back: (key, payload_bytes, payload_digest, record_type, refers_to).

    Size and digest are those of the full payload, for a revisit as its transaction tells
    them; refers_to: the key of the response that a revisit repeats, else null.

    Null html is an empty payload, and empty payloads are equal like any others; a null url is
    written as an empty one. Rows without a key are always responses. Repeated rows, which share
    the smallest key, are responses each. An empty table gives an empty result. Other
    columns are not written. Urls and payloads may be very long. The archives can go once it has returned.
    """
    write(pages, path, key, url, html, least_bytes)
    kind = pages.schema[key].dataType
    found = saved(captures(pages.sparkSession, path, with_payload=False))
    wrong = found.where(~F.col("payload_ok")).limit(1).count()
    if wrong:
        raise ValueError("a payload doesn't have its digest")
    told = F.col("metadata.fields")
    flat = found.select("record_id", F.col("response.refers_to").alias("to"), F.element_at(told, "capture-key").cast(kind).alias("key"), F.element_at(told, "payload-length").cast("bigint").alias("payload_bytes"), F.regexp_replace("response.digest", "^sha1:", "").alias("payload_digest"), F.col("response.warc_type").alias("record_type"))
    firsts = flat.join(flat.where("to IS NOT NULL").select(F.col("to").alias("record_id")).distinct(), "record_id", "left_semi").select(F.col("record_id").alias("to"), F.col("key").alias("refers_to")).distinct()
    return join_checked(flat, saved(firsts), "to", "left").select(F.col("key").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")
