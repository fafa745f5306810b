"""Legacy ARC archives to WARC, and back from WARC to rows.

ARC has one version block per file, ``filedesc://``, whose second line names the version. A version 1 record has the
header ``URL IP-address Archive-date Content-type Archive-length``; version 2 puts ``Result-code Checksum Location
Offset Filename`` before the length. The declared length gives the end of the record; nothing is searched for.
The converter gives each record the identifier, time, type and digests that WARC asks for, and stores a payload that
the archives hold already as a revisit.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from marketprose.llm.common import dealt, filesystem, keyed, new_folder, put_file
from marketprose.operators.lookups import keyed_join
from marketprose.session import written

#: Fixed values of the two formats.
ARC_FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result", "checksum", "location", "offset", "filename", "length"),
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "arc-to-warc")


def member(record: bytes) -> bytes:
    """A record as a gzip member; the lightest level, since archives are read more often than kept."""
    return gzip.compress(record, compresslevel=1, mtime=0)


def arc_header(version: int, **fields: object) -> bytes:
    """One header line; a field without a value is a dash."""
    return " ".join(str(fields.get(name) or (0 if name == "length" else "-")) for name in ARC_FIELDS[version]).encode() + b"\n"


def arc_file(version: int, name: str, date: str, records: list[tuple[str, str, bytes]]) -> bytes:
    """An ARC file of (url, content type, network document) records, each a gzip member."""
    block = f"{version} 0 marketprose\n{ARC_TITLES[version]}\n\n".encode()
    fields = {"ip": "0.0.0.0", "date": date, "filename": name, "result": 200}
    first = arc_header(version, **fields, url=f"filedesc://{name}", content_type="text/plain", length=len(block)) + block
    out, size = [first], len(first)
    for url, kind, body in records:
        checksum = hashlib.md5(body).hexdigest()  # what version 2 files of the time carry
        head = arc_header(version, **fields, url=url, content_type=kind, length=len(body), checksum=checksum, offset=size)
        out.append(head + body + b"\n")
        size += len(out[-1])
    return b"".join(map(member, out))


def arc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and body of each record, the version block first.

    The version decides which fields a line has; a url with blanks takes what is left of it. Gzip members are opened;
    offsets count opened bytes.
    Raises ValueError when a header or a declared length does not fit the file.
    """
    content = _opened(content)
    at, version = 0, 0
    while at < len(content):
        if content[at] in b"\r\n":  # between records
            at += 1
            continue
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].decode("utf-8", "replace").rstrip("\r")
        if not version:
            body_line = content[end + 1 : content.find(b"\n", end + 1)].split()
            if not line.startswith("filedesc://") or not body_line or body_line[0] not in (b"1", b"2"):
                raise ValueError("no ARC version block")
            version = int(body_line[0])
            # the version block itself may have a header of either version
            names = next((f for f in (ARC_FIELDS[version], ARC_FIELDS[1]) if len(line.split(" ")) >= len(f)), ())
        else:
            names = ARC_FIELDS[version]
        values = line.rsplit(" ", len(names) - 1)
        if end < 0 or len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"not an ARC header at byte {at}: {line[:200]!r}")
        fields = dict(zip(names, values, strict=True))
        start, stop = end + 1, end + 1 + int(fields["length"])
        if stop > len(content):
            raise ValueError(f"ARC record at byte {at} is cut off")
        yield at, fields | {"version": str(version)}, content[start:stop]
        at = stop


def http_parts(body: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-case names), header bytes and payload of an HTTP response; no header if it is none."""
    if not body.startswith(b"HTTP/"):
        return {}, b"", body
    found = re.search(rb"\r?\n\r?\n", body)
    cut = found.end() if found else len(body)
    lines = body[:cut].decode("latin-1").splitlines()[1:]
    pairs = (line.split(":", 1) for line in lines if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}, body[:cut], body[cut:]


def warc_date(arc: str) -> str:
    """An ARC date of 4 to 14 digits as WARC writes it; what is missing is the earliest, an impossible one is 1970."""
    digits = re.sub(r"\D", "", arc)[:14]
    filled = digits + "00000101000000"[len(digits) :]
    try:
        return datetime.strptime(filled, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(source: str, offset: int) -> str:
    """The same record gets the same identifier whenever it is converted."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{source}#{offset}')}>"


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}", "", ""]
    return member("\r\n".join(lines).encode() + block + b"\r\n\r\n")


def converted(
    source: str, offset: int, fields: dict[str, str], body: bytes, refers_to: str | None, digest: str | None = None
) -> bytes:
    """The WARC record of an ARC record; a revisit if ``refers_to`` names the record with the payload.

    ``digest`` is the payload's SHA-256 where it is known.
    """
    if fields["url"].startswith("filedesc://"):
        kind, mime, block, payload = "warcinfo", "application/warc-fields", f"isPartOf: {source}\r\n".encode(), None
    else:
        head, payload = http_parts(body)[1:]
        kind = "revisit" if refers_to else "response" if head else "resource"
        mime = "application/http; msgtype=response" if head else fields["content_type"]
        block = head if refers_to else body
    out = {"WARC-Type": kind, "WARC-Record-ID": record_id(source, offset), "WARC-Date": warc_date(fields["date"])}
    if payload is not None:
        out["WARC-Target-URI"] = fields["url"]
        out["WARC-Payload-Digest"] = f"sha256:{digest or hashlib.sha256(payload).hexdigest()}"
        out["X-Payload-Length"] = str(len(payload))
        if re.fullmatch(r"[0-9a-fA-F.:]+", fields["ip"]) and fields["ip"] != "0.0.0.0":
            out["WARC-IP-Address"] = fields["ip"]
    if refers_to:
        out |= {"WARC-Refers-To": refers_to, "WARC-Profile": REVISIT}
    out |= {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type": mime}
    return warc_record(out, block)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a WARC file, gzipped by record or plain."""
    stream = io.BytesIO(_opened(content))
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("WARC record is cut off")
        yield fields, block


def _opened(content: bytes, step: int = 1 << 16) -> bytes:
    """Gzip members one after the other, each handed over in steps so that what follows it is not copied each time."""
    if content[:2] != b"\x1f\x8b":
        return content
    out, at, view = [], 0, memoryview(content)
    while at < len(view) and view[at : at + 2] == b"\x1f\x8b":
        reader = zlib.decompressobj(31)
        while not reader.eof and at < len(view):
            out.append(reader.decompress(view[at : at + step]))
            at += min(step, len(view) - at)
        if not reader.eof:
            raise ValueError("gzip member is cut off")
        at -= len(reader.unused_data)
    return b"".join([*out, view[at:]])


def _read(path: str) -> bytes:
    store, local = filesystem(path)
    with store.open_input_file(local) as source:
        return source.read()


def write_arc(
    pages: DataFrame,
    folder: str | None = None,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "20000101000000",
    file_bytes: int = 8 << 20,
) -> DataFrame:
    """Write pages as ARC files of both versions in turn; returns the list of files (path).

    Each record is an HTTP response with the html in UTF-8 as payload (null: empty) and the key in ``X-Page-Id``
    (none for a null key). A null or empty url is a dash, white space in a url is percent-encoded.
    """
    folder = folder or new_folder(pages.sparkSession, "arc")
    rows = pages.select(
        F.col(key).cast("bigint").cast("string").alias("key"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        held: list[tuple[str, str, bytes]] = []
        part = size = 0

        def close() -> pd.DataFrame:
            nonlocal held, part, size
            name = f"{task:06d}-{part:05d}.arc.gz"
            put_file(f"{folder}/{name}", arc_file(1 + (task + part) % 2, name, date, held))
            held, part, size = [], part + 1, 0
            return pd.DataFrame({"path": [f"{folder}/{name}"]})

        for batch in batches:
            for page, link, text in zip(batch["key"], batch["url"], batch["html"], strict=True):
                payload = text.encode()
                lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
                lines += [f"X-Page-Id: {page}"] * (page is not None)
                link = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), link) or "-"
                held.append((link, "text/html", "\r\n".join([*lines, "", ""]).encode() + payload))
                size += len(payload)
                if size >= file_bytes:
                    yield close()
        if held:
            yield close()

    return written(rows.mapInPandas(run, "path string"), "arc-files")


def arc_index(files: DataFrame) -> DataFrame:
    """One row per record of the listed ARC files: path, offset, payload digest and size, key of the page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                found = []
                for offset, fields, body in arc_records(_read(path)):
                    if not fields["url"].startswith("filedesc://"):
                        head, _, payload = http_parts(body)
                        key = head.get("x-page-id")
                        found.append((path, offset, hashlib.sha256(payload).hexdigest(), len(payload), key))
                yield pd.DataFrame(found, columns=["path", "offset", "digest", "size", "key"])

    found = dealt(files, "path").mapInPandas(run, "path string, offset bigint, digest string, size bigint, key string")
    return keyed(found, "key")


def arc_to_warc(files: DataFrame, folder: str | None = None, least_bytes: int = 100) -> DataFrame:
    """Convert the listed ARC files (column path) to WARC files; returns the list of files (path).

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest page key, and of equal
    keys the first in the archives, keeps the payload; the others become revisits of it. Records without a key come
    after all others.
    """
    spark = files.sparkSession
    folder = folder or new_folder(spark, "warc")
    index = written(arc_index(files), "arc-index")
    order = F.struct(F.col("key").isNull(), "key", "path", "offset")
    kept = index.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    kept = kept.filter("n > 1").select("digest", F.col("first.path").alias("first_path"), F.col("first.offset").alias("first_offset"))
    other = ~((F.col("path") == F.col("first_path")) & (F.col("offset") == F.col("first_offset")))
    again = keyed_join(index.filter(F.col("size") >= least_bytes), kept, "digest", "inner").filter(other)
    # per record what is known of it already; a file without records has one row that says nothing
    known = ["path", "offset", "digest", "first_path", "first_offset"]
    plan = index.join(again.select("path", "offset", "first_path", "first_offset"), ["path", "offset"], "left").select(*known)
    plan = plan.unionByName(files.select("path", F.lit(-1).cast("bigint").alias("offset")), allowMissingColumns=True)
    plan = plan.withColumn("first_offset", F.coalesce("first_offset", F.lit(-1).cast("bigint")))

    def convert(rows: pd.DataFrame) -> pd.DataFrame:
        path = rows["path"].iloc[0]
        name = path.rpartition("/")[2]
        digests = dict(zip(rows["offset"].tolist(), rows["digest"], strict=True))
        seen = rows[rows["first_offset"] >= 0]
        firsts = {
            o: record_id(p.rpartition("/")[2], f)
            for o, p, f in zip(seen["offset"].tolist(), seen["first_path"], seen["first_offset"].tolist(), strict=True)
        }
        parts = [
            converted(name, offset, fields, body, firsts.get(offset), digests.get(offset))
            for offset, fields, body in arc_records(_read(path))
        ]
        target = f"{folder}/{name.removesuffix('.gz').removesuffix('.arc')}.warc.gz"
        put_file(target, b"".join(parts))
        return pd.DataFrame({"path": [target]})

    return written(dealt(plan, "path").groupBy("path").applyInPandas(convert, "path string"), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """Rows of the listed WARC files (column path): one per response, resource or revisit record.

    Columns: record_id, record_type, date, url, page_id, payload_bytes, payload_digest (hex), refers_to_id, payload.
    The payload of a revisit is null; size and digest are always those of the full payload. Damaged payloads raise.
    """
    columns = "record_id record_type date url page_id payload_bytes payload_digest refers_to_id payload".split()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                found = []
                for fields, block in warc_records(_read(path)):
                    if fields["warc-type"] not in ("response", "resource", "revisit"):
                        continue
                    head, _, payload = http_parts(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    whole = fields["warc-type"] != "revisit"
                    if whole and (hashlib.sha256(payload).hexdigest() != digest or str(len(payload)) != fields["x-payload-length"]):
                        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
                    found.append((
                        fields["warc-record-id"], fields["warc-type"], fields["warc-date"], fields["warc-target-uri"],
                        head.get("x-page-id"), int(fields["x-payload-length"]), digest, fields.get("warc-refers-to"),
                        payload if whole else None,
                    ))
                yield pd.DataFrame(found, columns=columns)

    schema = (
        "record_id string, record_type string, date string, url string, page_id string, payload_bytes bigint, "
        "payload_digest string, refers_to_id string, payload binary"
    )
    return keyed(dealt(files, "path").mapInPandas(run, schema), "page_id")


def with_targets(records: DataFrame) -> DataFrame:
    """Records with ``refers_to``: the page of the record that a revisit refers to, null for all others.

    Reads the records twice; pass a written table.
    """
    targets = records.filter("record_type != 'revisit'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")
    )
    plain = records.filter("refers_to_id IS NULL").withColumn("refers_to", F.lit(None).cast("bigint"))
    again = records.filter("refers_to_id IS NOT NULL")
    wanted = targets.join(again.select("refers_to_id").distinct(), "refers_to_id", "left_semi")
    return plain.unionByName(keyed_join(again, wanted, "refers_to_id", "left").select(plain.columns))
