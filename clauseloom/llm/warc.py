"""WARC archives in Zstandard with an embedded dictionary, written and read by tasks.

Each task writes the records of its partition into archives of bounded size. An archive begins with a skippable frame
that holds a dictionary trained on the archive's own first records; every record is then a frame of its own, compressed with
that dictionary. A task names its archives after itself and a random number and returns their names; only the names
that Spark commits are read back, so a task that is run again, or twice, leaves nothing that counts.

Of pages with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the smallest key (nulls last, then the
smallest URL) is a response and the others revisit it without a payload.

Edge cases: a null payload is empty; a null key or URL is left out of its record and comes back as null; line breaks in a
URL are escaped. Of rows that are equal throughout one is the response and the others revisit it. An archive of too
few records for a dictionary is written without one. An empty table makes no archive. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm.common import small_batches
from clauseloom.plans.stage import fresh_path, stage

#: Payloads under this size are written again each time.
REVISIT_BYTES = 100

#: Magic number of the skippable frame that holds a dictionary (a fixed value of the format).
DICTIONARY_FRAME = 0x184D2A5D

DICTIONARY_BYTES = 64 << 10

#: Records that a dictionary is trained on, and bytes of records in an archive, at most.
TRAINING_BYTES, ARCHIVE_BYTES = 4 << 20, 64 << 20

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields if v is not None], f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode("utf-8") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write_archive(out: object, records: Iterator[bytes]) -> int:
    """Records into an open file, until the archive is full; returns how many. The dictionary comes from the first ones."""
    import zstandard

    first, size = [], 0
    for data in records:
        first.append(data)
        size += len(data)
        if size >= TRAINING_BYTES:
            break
    dictionary = None
    try:
        dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 16)), first)
        frame = dictionary.as_bytes()
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(frame)) + frame)
    except zstandard.ZstdError:
        pass
    packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
    for data in first:
        out.write(packer.compress(data))
    n = len(first)
    while size < ARCHIVE_BYTES and (data := next(records, None)) is not None:
        out.write(packer.compress(data))
        n, size = n + 1, size + len(data)
    return n


def read_archive(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one frame after the other."""
    import zstandard

    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        dictionary, at = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(data[at : at + step]))
            at += min(step, len(data) - at) - len(frame.unused_data)
        yield b"".join(parts)


def _record_id(page: str | None, url: str | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((page, url, digest, copy)))}>"


def _typed(pages: DataFrame) -> DataFrame:
    """p, u, payload, digest, copy and the key (rp, ru) of the response that a row revisits, with ``revisit``."""
    rows = pages.withColumn("digest", F.sha2(F.col("payload"), 256)).withColumn("size", F.length("payload"))
    counted = rows.groupBy("p", "u", "digest", "size").agg(F.count(F.lit(1)).alias("n"))
    heads = counted.groupBy("digest").agg(F.min(F.struct(F.col("p").isNull().alias("z"), "p", F.col("u").isNull().alias("y"), "u")).alias("h"))
    own = F.col("p").eqNullSafe(F.col("h.p")) & F.col("u").eqNullSafe(F.col("h.u"))
    typed = counted.join(heads, "digest").select(
        "p", "u", "digest", "n", (~own & (F.col("size") >= REVISIT_BYTES)).alias("revisit"),
        ((F.col("size") >= REVISIT_BYTES) & (F.col("n") > 1)).alias("several"), F.col("h.p").alias("rp"), F.col("h.u").alias("ru"),
    )
    # A revisit needs no payload, and of equal rows only one does.
    single = typed.filter("NOT revisit AND NOT several").withColumnsRenamed({"p": "_p", "u": "_u", "digest": "_d"})
    on = rows["p"].eqNullSafe(F.col("_p")) & rows["u"].eqNullSafe(F.col("_u")) & (rows["digest"] == F.col("_d"))
    alone = rows.join(single, on).select("p", "u", "payload", "digest", F.lit(0).alias("copy"), "revisit", "rp", "ru")
    chosen = typed.filter("NOT revisit AND several").withColumnsRenamed({"p": "_p", "u": "_u", "digest": "_d"})
    chosen = rows.join(chosen, on).dropDuplicates(["p", "u", "digest"]).select("p", "u", "payload", "digest", F.lit(0).alias("copy"), "revisit", "rp", "ru")
    again = typed.filter("revisit OR several").select(
        "p", "u", F.lit(None).cast("binary").alias("payload"), "digest",
        F.explode(F.expr("CASE WHEN revisit THEN sequence(0, int(n) - 1) ELSE sequence(1, int(n) - 1) END")).alias("copy"),
        F.lit(True).alias("revisit"), "rp", "ru",
    )
    return alone.unionByName(chosen).unionByName(again)


def write(df: DataFrame, key: str, url: str, payload: str, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every row as a record into archives in ``folder``; returns archive, records, bytes."""
    small_batches(df.sparkSession)
    rows = _typed(df.select(F.col(key).alias("p"), F.col(url).alias("u"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload")))
    # As text, since a null would make numbers inexact on the way to Python.
    rows = rows.withColumns({"p": F.col("p").cast("string"), "rp": F.col("rp").cast("string")})

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[bytes]:
        for batch in batches:
            for p, u, payload, digest, copy, revisit, rp, ru in batch.itertuples(index=False, name=None):
                fields = [
                    ("WARC-Record-ID", _record_id(p, u, digest, copy)), ("WARC-Date", date),
                    ("WARC-Target-URI", u and u.replace("\r", "%0D").replace("\n", "%0A")),
                    ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", p),
                ]
                if revisit:
                    fields += [
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To", _record_id(rp, ru, digest, 0)),
                    ]
                    yield record("revisit", fields, HTTP_HEAD)
                else:
                    yield record("response", fields, HTTP_HEAD + payload)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        records = made(batches)
        while (head := next(records, None)) is not None:
            store, path = fs.FileSystem.from_uri(f"{folder}/{uuid.uuid4().hex}.warc.zst")
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path, compression=None) as out:
                rest = iter([head])
                n = write_archive(out, (r for part in (rest, records) for r in part))
            info = store.get_file_info(path)
            yield pd.DataFrame({"archive": [f"{folder}/{path.rsplit('/', 1)[1]}"], "records": [n], "bytes": [info.size]})

    return rows.mapInPandas(run, "archive string, records long, bytes long")


def read(archives: DataFrame, key_type: str) -> DataFrame:
    """One row per record: p, record_id, record_type, payload_bytes, payload_digest (of what is in the record), refers_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for name in batch["archive"]:
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
                out = []
                for fields, block in map(parse, read_archive(data)):
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest, said = hashlib.sha256(payload).hexdigest(), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if fields["WARC-Type"] == "response" and digest != said:
                        raise ValueError(f"a payload in {name} does not match its digest")
                    out.append((fields.get("X-Page-ID"), fields["WARC-Record-ID"], fields["WARC-Type"], len(payload), said, fields.get("WARC-Refers-To")))
                yield pd.DataFrame(out, columns=["p", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_id"])

    made = archives.select("archive").mapInPandas(
        run, "p string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_id string"
    )
    return made.withColumn("p", F.col("p").cast(key_type))


def round_trip(spark: SparkSession, df: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """Write archives into the shared folder, read them back, and give revisits the payload facts of their response."""
    folder = fresh_path(spark, "warc")
    archives = stage(write(df, key, url, payload, folder), "warc-archives")
    parts = max(1, archives.count())
    records = stage(read(archives.repartition(parts), df.schema[key].dataType.simpleString()), "warc-records")
    responses = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_id"), F.col("p").alias("refers_to"), F.col("payload_bytes").alias("whole_bytes"),
        F.col("payload_digest").alias("whole_digest"),
    )
    revisits = records.filter("record_type = 'revisit'").join(responses, "refers_id").select(
        F.col("p").alias(key), F.col("whole_bytes").alias("payload_bytes"), F.col("whole_digest").alias("payload_digest"), "record_type", "refers_to"
    )
    own = records.filter("record_type = 'response'").select(
        F.col("p").alias(key), "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(df.schema[key].dataType).alias("refers_to")
    )
    return own.unionByName(revisits)
