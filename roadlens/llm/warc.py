"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Archives are written and read by Spark's own sources, so any store that Spark reaches will do. The
text writer puts an empty skippable frame after each row, which decoders pass over; each task's file
is a whole archive. The reader takes one archive at a time, finds its frames from their block
headers, decodes frame by frame, and checks headers, lengths and digests of each record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.common import shared_folder, written

# Fixed values of the formats.
DICTIONARY_FRAME, FRAME, TRAINED = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty skippable frame.
SEPARATOR = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
LEAST_PAYLOAD = 1000

READ_SCHEMA = "archive string, record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, error string"


def _clean(value: str) -> str:
    return "".join(c if c > "\x1f" and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = "null" if page_id is None else str(page_id)
    head = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = 32_768) -> bytes:
    """A Zstandard dictionary; of a few or tiny samples, which cannot train one, their content itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return record(0, "https://example.com/", b"<!DOCTYPE html><html><head></head><body></body></html>", None, False, "1970-01-01T00:00:00Z")


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    trained = data[:4] == struct.pack("<I", TRAINED)
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, from its header and block headers. Raises ValueError where it is cut off."""
    if len(data) - at < 8:
        raise ValueError("truncated frame")
    (magic,) = struct.unpack_from("<I", data, at)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    elif magic != FRAME:
        raise ValueError(f"no frame at byte {at}")
    else:
        end, last = at + zstandard.frame_header_size(bytes(data[at : at + 18])), False
        checksum = 4 if data[at + 4] & 4 else 0
        while not last:
            if end + 3 > len(data):
                raise ValueError("truncated frame")
            word = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = bool(word & 1), word >> 1 & 3, word >> 3
            if kind == 3:
                raise ValueError("reserved block type")
            end += 3 + (1 if kind == 1 else size)
        end += checksum
    if end > len(data):
        raise ValueError("truncated frame")
    return end


def read_frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time; skippable frames after the first are passed over."""
    data, at, decoder = memoryview(content), 0, zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        at = frame_end(data, 0)
        held = bytes(data[8:at])
        if held[:4] == struct.pack("<I", FRAME):
            held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
        decoder = zstandard.ZstdDecompressor(dict_data=_dictionary(held))
    while at < len(data):
        end = frame_end(data, at)
        if struct.unpack_from("<I", data, at)[0] == FRAME:
            yield decoder.decompressobj().decompress(bytes(data[at:end]))
        at = end


def _urn(value: str | None) -> int | None:
    name = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


def parse_record(data: bytes) -> dict:
    """The fields of READ_SCHEMA for one record; ``error`` says what is wrong with it, and is null for a sound one."""
    out = dict.fromkeys(x.split()[0] for x in READ_SCHEMA.split(", "))
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        return out | {"error": "no WARC header"}
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            return out | {"error": "malformed header line"}
        fields[name.strip().lower()] = value.strip()
    out |= {"record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type")}
    out |= {"page_id": _urn(out["record_id"]), "refers_to": _urn(fields.get("warc-refers-to"))}
    missing = [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest") if x not in fields]
    if missing:
        return out | {"error": f"missing {', '.join(missing)}"}
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"error": "length differs from Content-Length"}
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    told = [x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not http.startswith(b"HTTP/1.") or not gap or len(told) != 1 or not told[0].isdigit():
        return out | {"error": "malformed HTTP header"}
    kind, _, digest = fields["warc-payload-digest"].partition(":")
    try:
        raw = base64.b32decode(digest)
    except ValueError:
        raw = b""
    if kind != "sha1" or len(raw) != 20:
        return out | {"error": "malformed digest"}
    out |= {"payload_bytes": int(told[0]), "payload_digest": raw.hex()}
    if out["record_type"] == "revisit":
        return out | {"error": "revisit refers to nothing" if out["refers_to"] is None else "revisit with a payload" if payload else None}
    if len(payload) != out["payload_bytes"]:
        return out | {"error": "payload length differs"}
    return out | {"error": None if hashlib.sha1(payload).digest() == raw else "payload digest differs"}


def write_archives(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = 200, longest: int = 100_000, archive_bytes: int = 256_000_000, date: str = "1970-01-01T00:00:00Z",
    broadcast_rows: int = 200_000,
) -> str:
    """Writes a record per row of ``pages`` and returns the folder, below the shared one.

    Equal payloads of at least 1000 bytes: the row of the largest id is a response, and so is any row
    that repeats that id; others revisit it. Where no such row has an id, all are responses. A null
    payload is empty, a null url leaves the header out, other columns are ignored. Payloads held by
    several rows are found from hashes, pre-aggregated; they are broadcast up to ``broadcast_rows``
    (some 60 bytes each) and joined by shuffle beyond. The dictionary is trained on the ``sample``
    rows of smallest hash among payloads of up to ``longest`` bytes. A task's archive holds about
    ``archive_bytes`` of payload at most, or else one record: where any of the table's partitions holds more,
    all rows are dealt out anew into archives of half of it on average.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= LEAST_PAYLOAD, F.sha2("payload", 256)))
    repeated = rows.where("key is not null").groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    repeated = written(repeated.where("n > 1 and first is not null").select(F.col("key").alias("k"), "first"), "payloads")
    few = repeated.count() <= broadcast_rows
    typed = rows.join(F.broadcast(repeated) if few else repeated, F.col("key") == F.col("k"), "left")
    typed = typed.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    taken = rows.where(F.octet_length("payload") <= longest).orderBy(F.xxhash64("page_id", "url"), "page_id").limit(sample).select("url", "payload").collect()
    data = train_dictionary([record(0, r["url"], bytes(r["payload"]), None, False, date) for r in taken])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(data), write_checksum=True)
        lead = struct.pack("<II", DICTIONARY_FRAME, len(data)) + data
        for batch in batches:
            frames = [lead] if lead else []
            lead = b""
            for page_id, url, payload, refers in batch.itertuples(index=False, name=None):
                page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                frames.append(encoder.compress(record(page_id, url, payload, refers, refers is not None, date)))
            yield pd.DataFrame({"frame": frames})

    size = F.coalesce(F.sum(F.octet_length("payload").cast("long")), F.lit(0))
    parts = rows.groupBy(F.spark_partition_id().alias("p")).agg(size.alias("bytes")).agg(F.max("bytes").alias("most"), F.sum("bytes").alias("total")).first()
    # a broadcast join keeps the table's partitions; a shuffle brings the copies of a payload together, so they are dealt out again
    if not few or (parts["most"] or 0) > archive_bytes:
        typed = typed.repartition(2 * -(-(parts["total"] or 0) // archive_bytes) or 1)
    as_text = typed.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})  # ids stay exact beside nulls
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    frames = as_text.mapInPandas(pack, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", SEPARATOR).text(folder)
    return folder


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the archives in ``folder``, as READ_SCHEMA.

    A record that fails a check, or an archive that is cut off, gives a row whose ``error`` tells why;
    what precedes it is read. An executor holds one compressed archive and one record at a time.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found, frames = [], read_frames(content)
                while True:
                    try:
                        data = next(frames)
                    except StopIteration:
                        break
                    except (ValueError, zstandard.ZstdError) as e:
                        found.append(dict.fromkeys(names) | {"archive": path, "error": str(e)})
                        break
                    found.append(parse_record(data) | {"archive": path})
                    if len(found) == 1000:
                        yield _frame(found, names)
                        found = []
                yield _frame(found, names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInPandas(unpack, READ_SCHEMA)


def _frame(found: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=names)
    return out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"}) if len(out) else out


def archived_pages(pages: DataFrame, **options) -> DataFrame:
    """``pages`` written as WARC archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to. A record that fails a check ends the job."""
    found = read_archives(pages.sparkSession, write_archives(pages, **options))
    sound = F.assert_true(F.col("error").isNull(), F.concat_ws(": ", "archive", "record_id", "error")).isNull()
    return found.where(sound).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
