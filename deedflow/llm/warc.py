"""Operator 6: WARC archives, written from a table of pages and read back by a salvaging reader.

Writing: a record per page, named by its page id, with the SHA-256 of its
payload. Of records with equal payloads of ``revisit_from`` bytes or more the one
with the smallest page id is a response, the others are revisits that refer to it
and carry no payload. Records go through Spark's text writer (its line separator
is the record separator), so archives land in any store Spark can write.

Reading: archives of plain or member-wise gzipped records, of any writer: header
names in any case, repeated and folded headers, digests in hex or base 32, payload
digests of HTTP messages taken after their headers. A record is checked (version
line, lengths, record end, block and payload digest). After a failed check the
reader searches for the next version line or valid gzip member, recovers the
records from there on, and logs the byte gap it had to skip.

Scale: payloads are compared by digest; a group's smallest page is found with
map-side combining. Records are written where they are read, in archives of
``archive_bytes`` at most (a longer record is an archive alone); one task reads an
archive in whole. Revisits find their response by a join of narrow written
tables, which splits a hot payload.

Defined cases: null payloads are empty; pages without an id (null) are responses
and never referred to; rows that repeat a group's smallest page id are all
responses; payloads keep any characters; other columns than id, url and payload
are not read; a null url is left out of the record; an empty table gives no
record. Of a repeated header the first counts.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path, ship

CRLF = "\r\n"
END = b"\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
HEADERS = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Payload-Digest", "WARC-Block-Digest", "WARC-Target-URI")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def planned(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", revisit_from: int = 100) -> DataFrame:
    """(page_id, url, payload, bytes, digest, record_type, refers_to): what each page's record will be."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("bytes"))
    large = rows.filter((F.col("bytes") >= revisit_from) & F.col("page_id").isNotNull()).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    groups = materialise(groups, "groups")
    # no hint: the groups were written, so their size is known; payloads move only where it is too large to broadcast
    joined = rows.join(groups, "digest", "left")
    refers = F.when((F.col("bytes") >= revisit_from) & F.col("page_id").isNotNull() & (F.col("first") < F.col("page_id")), F.col("first"))
    return joined.withColumn("refers_to", refers).withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")).drop("first")


def record(page_id: Column, url: Column, payload: Column, digest: Column, record_type: Column, refers_to: Column) -> Column:
    """A plain WARC record up to, not including, its ending blank lines."""
    block = F.when(record_type == "revisit", F.lit("")).otherwise(payload)

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    uri = F.regexp_replace(url, r"[\r\n]+", " ")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", record_type),
        line("WARC-Record-ID", F.coalesce(record_id(page_id), F.lit("<urn:page:>"))),
        line("WARC-Target-URI", uri),
        F.lit(f"WARC-Date: 1970-01-01T00:00:00Z{CRLF}"),
        line("WARC-Refers-To", record_id(refers_to)),
        F.when(record_type == "revisit", F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}")).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))),
        F.lit(f"Content-Type: text/html{CRLF}"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def write_archives(plan: DataFrame, path: str, *, archive_bytes: int = 128 << 20, longest: int = 0) -> None:
    """Archives of ``archive_bytes`` at most from a plan of records, of which none is longer than ``longest`` bytes (0: not known).

    Records are written by classes of length, each class with as many records an archive as its longest allow.
    """
    lengths = [x for x in (32 << 10, 1 << 20, 32 << 20) if x < archive_bytes]
    lower = -1
    for upper in [*lengths, None]:
        if longest and lower >= longest:
            break
        some = plan.filter(F.col("bytes") > lower) if upper is None else plan.filter((F.col("bytes") > lower) & (F.col("bytes") <= upper))
        lines = some.select(record(*[F.col(c) for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")]).alias("value"))
        per_file = 1 if upper is None else max(1, archive_bytes // (upper + (32 << 10)))
        lines.write.mode("append").option("lineSep", END.decode()).option("maxRecordsPerFile", per_file).text(path)
        lower = upper


def header_fields(raw: bytes) -> dict[str, str] | None:
    """Lower-cased names and values of header lines, the first of repeated ones; None if a line is none."""
    fields: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").split(CRLF):
        if line[:1] in (" ", "\t") and name:  # a folded line goes on with the one before
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            return None
        fields.setdefault(name, value.strip())
    return fields


def digest_holds(claimed: str | None, data: bytes) -> bool:
    """Whether a digest like ``sha1:...`` in hex or base 32 is the data's; without one, or of an unknown kind, it is."""
    kind, _, value = (claimed or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return True
    found = hashlib.new(kind, data).digest()
    return value.strip().lower() in (found.hex(), base64.b32encode(found).decode().lower(), base64.b32encode(found).decode().lower().rstrip("="))


def parse(raw: bytes, at: int, end: int) -> tuple[dict[str, str], bytes, int] | None:
    """The record at ``at``: its headers (lower-cased names), block and where the next begins. None if any check fails."""
    head = VERSION.match(raw, at)
    stop = raw.find(END, at, end)
    if not head or stop < 0:
        return None
    headers = header_fields(raw[head.end() : stop])
    size = (headers or {}).get("content-length", "")
    if headers is None or not size.isascii() or not size.isdigit():
        return None
    begin, finish = stop + len(END), stop + len(END) + int(size)
    if finish + len(END) > end or raw[finish : finish + len(END)] != END:
        return None
    block = raw[begin:finish]
    if not digest_holds(headers.get("warc-block-digest"), block):
        return None
    if headers.get("warc-type", "").lower() != "revisit" and not digest_holds(headers.get("warc-payload-digest"), payload_of(headers, block)):
        return None
    return headers, block, finish + len(END)


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The payload in a record's block: of an HTTP message what follows its headers, else all."""
    if headers.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        return block.partition(END)[2]
    return block


def member(raw: bytes, at: int) -> tuple[bytes, int] | None:
    """The gzip member at ``at`` unpacked, and where it ends. None if it is damaged or cut."""
    unpack, out, view = zlib.decompressobj(31), [], memoryview(raw)
    while at < len(raw) and not unpack.eof:
        some = view[at : at + (1 << 16)]
        at += len(some)
        try:
            out.append(unpack.decompress(some))
        except zlib.error:
            return None
    return (b"".join(out), at - len(unpack.unused_data)) if unpack.eof else None


def records_of(plain: bytes) -> tuple[list[tuple[dict[str, str], bytes]], bool]:
    """The good records of an unpacked member, which may hold several, and whether it holds nothing else."""
    found = [x[2:] for x in salvage(plain, packed=False)]
    return [x for x in found if x[0] is not None], all(x[0] is not None for x in found)


def salvage(raw: bytes, packed: bool = True) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """(from byte, to byte, headers, block) of every good record; headers None for a quarantined gap.

    Records of one gzip member all have its place; a member with bad bytes among them is also a gap. ``packed`` false
    looks for no members. The next mark of each kind is searched for once, however many records fail before it.
    """
    at, bad = 0, None
    line = mark = -1
    while at < len(raw):
        found, end = [], at
        if packed and raw.startswith(MEMBER, at):
            got = member(raw, at)
            if got:
                found, whole = records_of(got[0])
                end = got[1] if found else at
        else:
            one, whole = parse(raw, at, len(raw)), True
            if one:
                found, end = [one[:2]], one[2]
        if found:
            if bad is not None:
                yield bad, at, None, b""
                bad = None
            for headers, block in found:
                yield at, end, headers, block
            if not whole:
                yield at, end, None, b""
            at = end
            continue
        bad = at if bad is None else bad
        if line <= at:
            hit = VERSION.search(raw, at + 1)
            line = hit.start() if hit else len(raw)
        if mark <= at:
            mark = raw.find(MEMBER, at + 1) if packed else -1
            mark = mark if mark >= 0 else len(raw)
        at = min(line, mark)
    if bad is not None:
        yield bad, len(raw), None, b""


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record or gap: archive, from_byte, to_byte, good, the headers' fields, payload_bytes, payload_sha256, block."""
    ship(spark)
    names = [h.lower().replace("-", "_") for h in HEADERS]
    schema = "archive string, from_byte long, to_byte long, good boolean, " + ", ".join(f"{n} string" for n in names) + ", payload_bytes long, payload_sha256 string, block binary"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "from_byte", "to_byte", "good", *names, "payload_bytes", "payload_sha256", "block"]
        for batch in batches:
            for archive, raw in zip(batch["path"], batch["content"], strict=True):
                rows, held = [], 0
                for a, z, headers, block in salvage(bytes(raw)):
                    fields = [headers.get(h.lower()) for h in HEADERS] if headers is not None else [None] * len(HEADERS)
                    payload = payload_of(headers or {}, block)
                    rows.append([archive, a, z, headers is not None, *fields, len(payload), hashlib.sha256(payload).hexdigest(), block])
                    held += len(block)
                    if held > 8 << 20:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def round_trip(pages: DataFrame, *, path: str | None = None, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", revisit_from: int = 100, archive_bytes: int = 128 << 20) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record written and read back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archives")
    plan = planned(pages, id_col=id_col, payload_col=payload_col, url_col=url_col, revisit_from=revisit_from)
    longest = pages.agg(F.max(F.octet_length(payload_col))).first()[0] or 1
    write_archives(plan, path, archive_bytes=archive_bytes, longest=longest)
    return resolved(spark, path)[0]


def resolved(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records of archives with their payloads, and the log of quarantined gaps (archive, from_byte, to_byte).

    A revisit's payload is that of the response it refers to; if that was lost, its digest is the one its own header
    states and its size is null.
    """
    got = materialise(read_archives(spark, path).drop("block"), "records")
    gaps = got.filter("not good").select("archive", "from_byte", "to_byte")
    lost = gaps.agg(F.count("*"), F.sum(F.col("to_byte") - F.col("from_byte"))).first()
    if lost[0]:
        logging.getLogger(__name__).warning("%s gaps, %s bytes, quarantined in %s", lost[0], lost[1], path)
    page = F.nullif(F.regexp_extract("warc_record_id", r"^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
    refers = F.nullif(F.regexp_extract("warc_refers_to", r"^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
    stated = F.regexp_extract("warc_payload_digest", r"^sha256:([0-9a-f]{64})$", 1)
    records = got.filter("good").select(page.alias("page_id"), "payload_bytes", F.col("payload_sha256").alias("payload_digest"), F.col("warc_type").alias("record_type"), refers.alias("refers_to"), F.nullif(stated, F.lit("")).alias("stated"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisit = F.col("record_type") == "revisit"
    responses = records.filter(~revisit | F.col("refers_to").isNull())
    held = responses.filter("page_id is not null").groupBy(F.col("page_id").alias("r")).agg(F.first(F.struct("payload_bytes", "payload_digest")).alias("held"))
    held = materialise(held, "held")
    revisits = records.filter(revisit & F.col("refers_to").isNotNull()).join(held.hint("merge"), F.col("refers_to") == F.col("r"), "left")
    revisits = revisits.withColumn("payload_bytes", F.col("held.payload_bytes")).withColumn("payload_digest", F.coalesce("held.payload_digest", "stated"))
    return responses.select(*columns).unionByName(revisits.select(*columns)), gaps
