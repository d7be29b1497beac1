"""WARC archives of Zstandard frames that share a dictionary.

A dictionary is trained on a bounded sample of the archived records (``SAMPLE`` records,
drawn by a hash, with the first ``SAMPLE_BYTES`` of their payloads), joined by a few
made-up ones so that few records are enough, and embedded in the leading, skippable
frame of every archive file. It has a number made from the sample, which each record's
frame names, so that archives with different dictionaries can be read together. Each
record is compressed by itself, so one can be read alone. Spark's text sink writes the
files, on any file system and with its commit protocol: the separator between two records
is itself an empty skippable frame, which Zstandard readers pass over, and Spark's text
source finds records by it, in splits. The files keep the sink's names, ``part-*.txt``;
tools that go by names want them renamed to ``.warc.zst``.

The separator stands nowhere else, whatever the pages hold: a record whose frame would have
its eight bytes is cut inside each place where the record has them, and else in halves, and
becomes several frames in a row, which read as one; sample records that hold them do not go
into the dictionary.

Of records with equal payloads of ``LEAST_REVISIT`` bytes or more, that of the largest
page_id is a response; the others are revisits without payload that refer to it.

Defined results: a null html is an empty payload; a null url leaves the target URI
out; rows repeating the largest page_id are all responses; a null page_id is smaller
than any; an empty table makes no archive, which reads as an empty table; of other
columns nothing is archived, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.store import new_path, scope, written

SAMPLE, SAMPLE_BYTES = 512, 1 << 16
BROADCAST_PAYLOADS = 100_000  # digests of payloads that repeat, about 150 bytes each
DICTIONARY_BYTES = 1 << 16
DICTIONARIES = 64  # that a reading task holds at once
GROUP = 4096  # records that are read after one copy of their dictionary
LEAST_REVISIT = 1000
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
# The magic numbers of the frame with the dictionary and of an empty frame.
DICTIONARY_MAGIC = struct.pack("<I", 0x184D2A5D)
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, record_type string, record_id string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; refers_to: None for a response."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url))
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """A record as a row of ``RECORDS``; its payload is checked against its digest."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "surrogatepass").split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = head["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    number = lambda k: int(head[k]) if k in head else None
    return number("Page-Id"), head.get("WARC-Target-URI"), kind, head["WARC-Record-ID"], payload if kind == "response" else None, size, digest, number("Refers-To-Page-Id")


def _records(frame: pd.DataFrame) -> Iterator[bytes]:
    whole = lambda x: None if pd.isna(x) else int(x)
    for page, url, payload, digest, refers in zip(frame["page_id"], frame["url"], frame["payload"], frame["digest"], frame["refers_to"]):
        yield record(whole(page), url, bytes(payload), digest, whole(refers))


def train_dictionary(records: list[bytes]) -> bytes:
    """A dictionary for such records; too few to train on make a plain one of their bytes."""
    import zstandard

    number = 32_768 + zlib.crc32(b"".join(hashlib.sha1(r).digest() for r in records)) % (2**31 - 32_768)  # the range for private use
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, dict_id=number).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY_BYTES:]


def specimens(n: int = 64) -> list[bytes]:
    """Made-up records, so that a dictionary can be trained however few pages there are."""
    texts = [f"<html><head><title>page {k}</title></head><body><p>{k * k}</p></body></html>".encode() for k in range(n)]
    return [record(k, f"https://www.example.org/{k}", t, hashlib.sha1(t).hexdigest(), k + 1 if k % 4 == 0 else None) for k, t in enumerate(texts)]


def frames_of(data: bytes, writer) -> bytes:
    """A record as one Zstandard frame, or as several, none of which holds the separator.

    No separator arises where frames meet, as its end is not the beginning of a frame and
    none of its ends is one of its beginnings.
    """
    frame = writer.compress(data)
    if SEPARATOR not in frame:
        return frame
    cuts, at = [], data.find(SEPARATOR)
    while at >= 0:
        cuts.append(at + len(SEPARATOR) // 2)
        at = data.find(SEPARATOR, at + 1)
    if not cuts:
        if len(data) < 2:
            raise ValueError("the separator is in the frame of a single byte")
        cuts = [len(data) // 2]
    return b"".join(frames_of(data[a:b], writer) for a, b in zip([0, *cuts], [*cuts, len(data)]))


def write_archives(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> str:
    """The folder of the archives, one file for each task that had rows."""
    with scope():
        spark = pages.sparkSession
        path = path or new_path(spark, "warc")
        payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
        base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
        base = base.withColumns({"digest": F.sha1("payload"), "__w_sum": F.sha2("payload", 256), "__w_size": F.octet_length("payload")})
        last = base.where(F.col("__w_size") >= LEAST_REVISIT).groupBy("digest", "__w_sum", "__w_size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
        last = written(last, "repeated-payloads")  # written, so that pages of a common payload can be split
        joined = base.join(F.broadcast(last) if last.count() <= BROADCAST_PAYLOADS else last, ["digest", "__w_sum", "__w_size"], "left")
        rows = joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))

        sample = base.select("page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload"), "digest", F.lit(None).cast("long").alias("refers_to"))
        drawn = F.xxhash64("page_id", "digest")
        every = max(1, pages.count() // (8 * SAMPLE))  # so that about 8 * SAMPLE rows, however many there are, meet to be cut to SAMPLE
        sample = sample.where(F.pmod(drawn, F.lit(every)) == 0).orderBy(drawn, "page_id").limit(SAMPLE)

        def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = [r for frame in parts for r in _records(frame) if SEPARATOR not in r]
            content = train_dictionary(found + specimens())
            yield pd.DataFrame({"dictionary": [content if SEPARATOR not in content else train_dictionary(specimens())]})

        trained = sample.coalesce(1).mapInPandas(learn, "dictionary binary").collect()  # DICTIONARY_BYTES at most
        content = bytes(trained[0][0]) if trained else train_dictionary(specimens())

        def frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import zstandard

            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
            leading = DICTIONARY_MAGIC + struct.pack("<I", len(content)) + content
            for frame in parts:
                made = [leading] if leading else []
                made += [frames_of(data, writer) for data in _records(frame)]
                if len(frame):
                    leading = b""
                    yield pd.DataFrame({"frame": made})

        lines = rows.mapInPandas(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
        lines.write.option("lineSep", SEPARATOR.decode("latin-1")).text(path)
        return path


def read_archives(spark: SparkSession, path: str, most: int = DICTIONARIES) -> DataFrame:
    """All records of the archives under path, with the columns of ``RECORDS``; payload is null for revisits.

    The dictionaries, one for each archive, go to all tasks if there are at most ``most``.
    If there are more, the records are dealt to groups of about ``GROUP`` of one dictionary,
    each of which begins with it; the archives are read once for that however many they are.
    """
    frames = spark.read.option("lineSep", SEPARATOR.decode("latin-1")).text(path).select(F.col("value").cast("binary").alias("frame"), F.col("_metadata.file_path").alias("file"))
    leads = F.startswith("frame", F.lit(bytearray(DICTIONARY_MAGIC)))
    content = F.expr("substring(frame, 9)")
    with scope():
        heads = frames.groupBy("file").agg(F.max(F.when(leads, content)).alias("content"), F.count_if(~leads).alias("n"))
        heads = written(heads.withColumn("h", F.xxhash64("content")), "dictionaries", keep=True)
        body = frames.where(~leads)
        if heads.select("h").distinct().limit(most + 1).count() <= most:
            contents = [bytes(r[0]) for r in heads.select("content").distinct().collect()]  # ``most`` of DICTIONARY_BYTES
            return body.select("frame").mapInPandas(_parser(contents), RECORDS)
        groups = heads.groupBy("h").agg(F.min("content").alias("content"), F.ceil(F.sum("n") / GROUP).cast("int").alias("groups"))
        groups = written(groups.withColumn("groups", F.greatest("groups", F.lit(1))), "dictionary-groups", keep=True)
        of = heads.select("file", "h").join(groups.select("h", "groups"), "h")
        dealt = body.join(of, "file").select("h", F.pmod(F.xxhash64("frame"), F.col("groups")).cast("int").alias("part"), F.lit(True).alias("record"), "frame")
        first = groups.select("h", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(False).alias("record"), F.col("content").alias("frame"))
        return first.unionByName(dealt).repartition("h", "part").sortWithinPartitions("h", "part", "record").mapInPandas(_group_parser, RECORDS)


def _table(frames: Iterator[tuple[bytes, object]]) -> pd.DataFrame:
    """The records of frames, each with the reader of its dictionary."""
    rows = [parse(reader.stream_reader(frame, read_across_frames=True).read()) for frame, reader in frames]  # checksums show a wrong dictionary
    table = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
    return table.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def _reader(content: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))


def _group_parser(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of rows in groups, each of which begins with its dictionary."""
    reader = None

    def with_readers(frame: pd.DataFrame) -> Iterator[tuple[bytes, object]]:
        nonlocal reader
        for is_record, data in zip(frame["record"], frame["frame"]):
            if is_record:
                yield bytes(data), reader
            else:
                reader = _reader(bytes(data))

    for frame in batches:
        yield _table(with_readers(frame))


def _parser(contents: list[bytes]):
    """A function from frames to records, with these dictionaries."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        readers: dict[int, list] = {}
        for content in contents:
            readers.setdefault(zstandard.ZstdCompressionDict(content).dict_id(), []).append(_reader(content))

        def fitting(frame: bytes):
            fits = readers[zstandard.get_frame_parameters(frame).dict_id]
            for reader in fits[:-1]:  # one, but for archives whose dictionaries' numbers happen to agree
                try:
                    reader.stream_reader(frame, read_across_frames=True).read()
                    return reader
                except zstandard.ZstdError:
                    continue
            return fits[-1]

        for batch in batches:
            yield _table((frame, fitting(frame)) for frame in map(bytes, batch["frame"]))

    return parsed


def describe(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record."""
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
