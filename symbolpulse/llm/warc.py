"""WARC archives: a writer whose files do not depend on how the input is partitioned, and a reader.

The writer sorts records by key and payload digest into ranges, one range for each shard.  The bounds
of the ranges come from a sample chosen by hash, so they depend on the records alone.  A
task writes its shard as gzip members, one for each record, and starts a new file when the
compressed size reaches a limit.  All headers, lengths and digests are made anew.  Of equal payloads,
one record is kept in full and the others are revisits of it.

Files are written under temporary names.  The rows that tasks return, one for each file, are the manifest; Spark
keeps those of one attempt for each task.  Only files of the manifest get their final names, and the manifest gets its
own name last: an archive without one is not there for readers, and files of
lost attempts are never read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.storage import stored
from .common import map_texts

#: Payloads below this many bytes are always written in full.
LEAST_REVISIT = 1000
FILE_BYTES, SHARD_BYTES = 64 << 20, 64 << 20
#: A record counts as its payload and so many bytes.
HEADER_BYTES = 500
#: Groups of records that bounds are taken from, twenty for each shard at least.
SAMPLE = 200_000
MOST_SHARDS = SAMPLE // 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"

MANIFEST = "shard int, part int, temporary string, file string, records long, bytes long, sha256 string, first_key string, last_key string"


# ---------------------------------------------------------------- one record


def _block(payload: bytes | None, length: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    return head.encode() + (payload or b"")


def _uri(url: str | None) -> str:
    """``url`` as one header value; what no header may hold is percent-encoded."""
    return quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~", errors="surrogatepass")


def record_id(key: str | None, digest: str, copy: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{digest}/{copy}')}>"


def record_bytes(key: str | None, url: str | None, payload: bytes, copy: str, refers_to: str | None, revisit: bool, date: str) -> bytes:
    """A record as it stands in the archive, before compression.

    ``copy`` tells records of equal key and payload apart; the one that others revisit has none.
    """
    sha1 = hashlib.sha1(payload).digest()
    block = _block(None if revisit else payload, len(payload))
    named = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(key, sha1.hex(), copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
    ]
    if key is not None:
        named.append(("WARC-X-Key", key))
    if revisit:
        named += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, sha1.hex(), ""))]
        if refers_to is not None:
            named.append(("WARC-X-Refers-To-Key", refers_to))
    named += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{n}: {v}\r\n".encode() for n, v in named) + CRLF + block + CRLF + CRLF


def _member(raw: bytes) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as z:
        z.write(raw)
    return out.getvalue()


# ---------------------------------------------------------------- writer


def _choose(records: DataFrame, index: DataFrame) -> DataFrame:
    """``records`` with ``revisit`` and ``refers_to``.

    Of equal payloads of :data:`LEAST_REVISIT` bytes or more the one with the greatest key is kept, and so are
    all others with this key.  Only keys and digests are grouped; payloads stay where they are
    unless the groups are too many for a broadcast.
    """
    kept = index.where(F.col("bytes") >= LEAST_REVISIT).groupBy(F.col("digest").alias("of"), F.col("bytes").alias("size"))
    kept = kept.agg(F.max("key").alias("kept"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"))
    kept = stored(kept.where("keys > 1").drop("keys"), "equal-payloads")
    groups, total = kept.agg(F.count(F.lit(1)), F.sum("n")).first()
    meet = (F.col("digest") == F.col("of")) & (F.col("bytes") == F.col("size"))
    few = 1000
    if groups <= few:
        both = records.join(F.broadcast(kept.drop("n")), meet, "left")
    else:
        # Groups with more than a thousandth of these rows are fewer than a thousand.
        hot, cold = kept.where(F.col("n") > total // few).drop("n"), kept.where(F.col("n") <= total // few).drop("n")
        both = records.join(F.broadcast(hot), meet)
        rest = records.join(F.broadcast(hot), meet, "left_anti").join(cold.hint("shuffle_hash"), meet, "left")
        both = both.unionByName(rest)
    revisit = F.col("of").isNotNull() & ~F.col("key").eqNullSafe(F.col("kept"))
    return both.select(*records.columns, revisit.alias("revisit"), F.when(revisit, F.col("kept")).alias("refers_to"))


def _bounds(groups: DataFrame, total: int, shards: int) -> list[tuple]:
    """Sort keys that cut the records into ``shards`` ranges of about equal bytes.

    A group of equal keys and digests counts once, with all its bytes.  Groups above half a shard
    are all taken, at most ``2 * shards``; of the others, the :data:`SAMPLE` smallest by hash.
    """
    if shards < 2:
        return []
    heavy = groups.where(F.col("weight") > total / (2 * shards)).collect()
    light = groups.where(F.col("weight") <= total / (2 * shards))
    rest = light.agg(F.sum("weight")).first()[0] or 0
    light = light.orderBy(F.xxhash64("key", "digest"), "key", "digest").limit(SAMPLE).collect()
    scale = rest / max(1, sum(r.weight for r in light))
    weighted = sorted([(_order(r.key), r.digest, r.weight) for r in heavy] + [(_order(r.key), r.digest, r.weight * scale) for r in light])
    out, seen, each = [], 0.0, total / shards
    for key, digest, weight in weighted:
        seen += weight
        while len(out) < shards - 1 and seen >= each * (len(out) + 1):
            out.append((key, digest))
    return out


def _order(key) -> tuple:
    """Null first, as Spark sorts."""
    return (key is not None, 0 if key is None else key)


def write_warc(
    records: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
    shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE,
) -> DataFrame:
    """Write an archive to ``folder`` and return its manifest.

    ``payload`` is text, written as UTF-8, or binary; null is empty.  A null key sorts first and
    is left out of its record; a null or empty url is ``about:blank``.  Repeated keys and equal rows are records of
    their own.  A group of equal keys and payloads that is greater than a shard is dealt over
    the shards its range spans.  An empty table gives a manifest without rows; other columns are left out, so no name can clash.
    ``folder`` is any place that pyarrow's file systems and Spark both reach.
    """
    spark = records.sparkSession
    rows = records.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.length("payload").cast("long"))
    index = rows.groupBy("key", "digest", "bytes").agg(F.count(F.lit(1)).alias("n"))
    index = stored(index.withColumn("weight", F.col("n") * (F.col("bytes") + HEADER_BYTES)), "record-index")
    total = index.agg(F.sum("weight")).first()[0] or 0
    shards = max(1, min(-(-total // shard_bytes), MOST_SHARDS))
    bounds = _bounds(index, total, shards)
    least = [bisect.bisect_left(bounds, b) for b in bounds]

    @F.arrow_udf("struct<shard:int,later:boolean>")
    def place_of(keys: pa.Array, digests: pa.Array, numbers: pa.Array) -> pa.Array:
        shard, later = [], []
        for k, d, n in zip(keys.to_pylist(), digests.to_pylist(), numbers.to_pylist()):
            at = (_order(k), d)
            high = bisect.bisect_right(bounds, at)
            # Equal bounds: one group fills several shards.
            same = high - least[high - 1] if high and bounds[high - 1] == at else 0
            shard.append(high - same + 1 + n % same if same > 1 else high)
            later.append(same > 1 and n % same > 0)
        return pa.StructArray.from_arrays([pa.array(shard, pa.int32()), pa.array(later, pa.bool_())], ["shard", "later"])

    chosen = _choose(rows, index).withColumn("place", place_of("key", "digest", F.monotonically_increasing_id()))
    chosen = chosen.select("*", "place.shard", "place.later").drop("place")
    chosen = chosen.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "digest", "url")
    chosen = chosen.withColumn("key", F.col("key").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    columns = ["shard", "later", "key", "url", "payload", "revisit", "refers_to"]
    draft = f"{folder}/_temporary-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(_as_uri(draft))
        place.create_dir(root, recursive=True)
        attempt = uuid.uuid4().hex
        open_: dict | None = None
        last, copy, part = None, 0, 0

        def close() -> pa.RecordBatch:
            open_["stream"].close()
            row = {c: open_[c] for c in ("shard", "part", "temporary", "file", "records", "bytes", "first_key", "last_key")}
            kinds = {"shard": pa.int32(), "part": pa.int32(), "records": pa.int64(), "bytes": pa.int64()}
            row["sha256"] = open_["digest"].hexdigest()
            names = [c.split()[0] for c in MANIFEST.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([row[c]], kinds.get(c, pa.string())) for c in names], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in columns}
                if open_ and (open_["shard"] != r["shard"] or open_["bytes"] >= file_bytes):
                    part = part + 1 if open_["shard"] == r["shard"] else 0
                    yield close()
                    open_ = None
                elif not open_:
                    part = 0
                if not open_:
                    name = f"part-{r['shard']:05d}-{part:05d}"
                    stream = place.open_output_stream(f"{root}/{name}-{attempt}", compression=None)
                    open_ = {
                        "shard": r["shard"], "part": part, "temporary": f"{draft}/{name}-{attempt}", "file": f"{folder}/{name}.warc.gz", "records": 0,
                        "bytes": 0, "stream": stream, "digest": hashlib.sha256(), "first_key": r["key"],
                    }
                same = (r["key"], hashlib.sha1(r["payload"]).digest())
                copy, last = copy + 1 if same == last else 0, same
                member = _member(record_bytes(r["key"], r["url"], r["payload"], f"{r['shard']}.{copy}" if copy or r["later"] or r["revisit"] else "", r["refers_to"], r["revisit"], date))
                open_["stream"].write(member)
                open_["digest"].update(member)
                open_["records"] += 1
                open_["bytes"] += len(member)
                open_["last_key"] = r["key"]
        if open_:
            yield close()

    manifest = stored(map_texts(chosen.select(*columns), write, MANIFEST), "warc-manifest")
    _commit(manifest, folder, draft)
    return read_manifest(spark, folder)


def _as_uri(path: str) -> str:
    """A path as pyarrow's file systems name it."""
    return re.sub(r"^file:/+", "file:///", path)


def _commit(manifest: DataFrame, folder: str, draft: str) -> None:
    """Give the files of the manifest their names, then publish the manifest."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for old, new in zip(batch.column("temporary").to_pylist(), batch.column("file").to_pylist()):
                place, source = fs.FileSystem.from_uri(_as_uri(old))
                target = fs.FileSystem.from_uri(_as_uri(new))[1]
                # A repeated attempt finds the work done.
                if place.get_file_info(source).type != fs.FileType.NotFound:
                    place.move(source, target)
                elif place.get_file_info(target).type == fs.FileType.NotFound:
                    raise FileNotFoundError(old)
            yield batch

    named = manifest.repartition(F.col("file")).mapInArrow(rename, manifest.schema)
    named.drop("temporary").write.parquet(f"{draft}/manifest")
    place, source = fs.FileSystem.from_uri(_as_uri(f"{draft}/manifest"))
    target = fs.FileSystem.from_uri(_as_uri(f"{folder}/manifest"))[1]
    place.move(source, target)
    place.delete_dir(fs.FileSystem.from_uri(_as_uri(draft))[1])


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``shard, part, file, records, bytes, sha256, first_key, last_key`` of each file of an archive."""
    return spark.read.schema(MANIFEST.replace("temporary string, ", "")).parquet(f"{folder}/manifest")


# ---------------------------------------------------------------- reader

RECORD = "key string, url string, record_type string, record_id string, payload binary, payload_bytes long, payload_digest string, refers_to string"


def parse_records(stream) -> Iterator[dict]:
    """Records of a WARC file, compressed by members or as a whole, or not at all.

    ``payload`` is null for a revisit; its length and digest are those of the full payload.
    A record whose payload or block does not fit its digests raises ``ValueError``.
    """
    source = io.BufferedReader(stream)
    if source.peek(2)[:2] == b"\x1f\x8b":
        source = io.BufferedReader(gzip.GzipFile(fileobj=source))
    while True:
        start = source.readline()
        while start in (CRLF, b"\n"):
            start = source.readline()
        if not start:
            return
        if not start.startswith(b"WARC/"):
            raise ValueError(f"no record at {start[:40]!r}")
        named = {}
        while (text := source.readline().strip(CRLF)) != b"":
            name, _, value = text.decode("utf-8").partition(":")
            named[name.lower()] = value.strip()
        block = source.read(int(named["content-length"]))
        kind = named["warc-type"]
        if kind not in ("response", "revisit", "resource"):
            continue
        if "warc-block-digest" in named and named["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise ValueError(f"block of {named['warc-record-id']} does not fit its digest")
        http = named.get("content-type", "").startswith("application/http")
        head, payload = block.split(b"\r\n\r\n", 1) if http and b"\r\n\r\n" in block else (b"", block)
        digest = named.get("warc-payload-digest", "").removeprefix("sha1:")
        digest = base64.b32decode(digest).hex() if digest else None
        length = len(payload)
        if kind == "revisit":
            found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
            length, payload = int(found[1]) if found else None, None
        elif digest not in (None, hashlib.sha1(payload).hexdigest()):
            raise ValueError(f"payload of {named['warc-record-id']} does not fit its digest")
        yield {
            "key": named.get("warc-x-key"), "url": named.get("warc-target-uri"), "record_type": kind, "record_id": named.get("warc-record-id"), "payload": payload,
            "payload_bytes": length, "payload_digest": digest or (payload is not None and hashlib.sha1(payload).hexdigest()) or None,
            "refers_to": named.get("warc-x-refers-to-key"),
        }


def read_warc(files: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Records of the files named in ``files(file)``, one task for some files, a record in memory at a time.

    ``columns`` are those of :data:`RECORD` to return; payloads that nobody asks for are checked and left behind.
    """
    shape = StructType.fromDDL(RECORD)
    shape = StructType([f for f in shape.fields if columns is None or f.name in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in shape.fields])
        for path in (p for b in batches for p in b.column("file").to_pylist()):
            place, name = fs.FileSystem.from_uri(_as_uri(path))
            held, size = [], 0
            with place.open_input_stream(name, compression=None) as stream:
                for r in parse_records(stream):
                    held.append({f.name: r[f.name] for f in shape.fields})
                    size += len(r["payload"] or b"") if "payload" in schema.names else 0
                    if len(held) >= 1000 or size >= 1 << 23:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    tasks = max(1, min(files.count(), MOST_SHARDS))
    return files.select("file").repartition(tasks, F.col("file")).mapInArrow(run, shape)
