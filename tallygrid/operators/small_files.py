"""Many tiny files into few well-sized bundles, byte for byte.

Files are joined without looking at their records: newline-delimited files end to end (a missing last newline is
supplied), complete zstandard frames end to end (a sequence of frames is itself a valid zstandard file). Each bundle
carries an index with start, length and CRC-32 of every member, so nothing is lost unnoticed and every file can be cut
out again unchanged. One shuffle, keyed by a hash of the file id, spreads the bytes evenly whatever the sizes are and
brings repeated listings of a file together.

Edge cases, as tested: a listing repeated with equal values is packed once; two files of one id with other bytes are
both packed; a null id takes its identity from path and content; null content counts as an empty file; an empty table
gives no bundle; other columns, whatever their names, are ignored; a file larger than the target is a bundle by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.cluster import told_apart

#: Magic numbers of the zstandard format (RFC 8878): a frame, and a skippable frame.
FRAME, SKIPPABLE = b"\x28\xb5\x2f\xfd", b"\x50\x2a\x4d\x18"
BUNDLES = "bundle_id bigint, kind string, header binary, payload binary, n_bytes bigint, crc bigint, members array<struct<file_id:bigint,path:string,start:bigint,length:bigint,crc:bigint>>"
MEMBER = pa.struct([("file_id", pa.int64()), ("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])
ARROW = pa.schema([("bundle_id", pa.int64()), ("kind", pa.string()), ("header", pa.binary()), ("payload", pa.binary()), ("n_bytes", pa.int64()), ("crc", pa.int64()), ("members", pa.list_(MEMBER))])


class _Open:
    """A bundle being filled."""

    def __init__(self, kind: str, header: bytes) -> None:
        self.kind, self.header, self.parts, self.size, self.members = kind, header, [], 0, []
        if header:
            self._put(header)

    def _put(self, data: bytes) -> None:
        self.parts.append(data)
        self.size += len(data)

    def add(self, file_id: int | None, path: str | None, body: bytes) -> None:
        self.members.append({"file_id": file_id, "path": path, "start": self.size, "length": len(body), "crc": zlib.crc32(body)})
        self._put(body)
        if self.kind == "lines" and body and not body.endswith(b"\n"):
            self._put(b"\n")

    def row(self, bundle_id: int) -> pa.RecordBatch:
        payload = b"".join(self.parts)
        if len(payload) != self.size:
            raise ValueError(f"bundle {bundle_id}: {len(payload)} bytes joined, {self.size} counted")
        return pa.RecordBatch.from_pylist([{"bundle_id": bundle_id, "kind": self.kind, "header": self.header, "payload": payload, "n_bytes": self.size, "crc": zlib.crc32(payload), "members": self.members}], schema=ARROW)


def _cut_header(body: bytes, lines: int) -> tuple[bytes, bytes]:
    """The first lines, with their ends, and the rest."""
    at = 0
    for _ in range(lines):
        end = body.find(b"\n", at)
        if end < 0:
            return (body + b"\n" if body else b""), b""
        at = end + 1
    return body[:at], body[at:]


def _told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are listed once for certain, and the others, made distinct; rows without an id are among these."""
    once, again = told_apart(rows, "file_id")
    return once.filter("file_id IS NOT NULL"), again.unionByName(rows.filter("file_id IS NULL")).dropDuplicates(["file_id", "path", "content"])


def pack_files(files: DataFrame, file_id: str = "file_id", path: str = "path", content: str = "content", target_bytes: int = 8 << 20, header_lines: int = 0) -> DataFrame:
    """Bundles of about ``target_bytes`` each; the last one of a task may be smaller.

    With ``header_lines`` the first lines of each newline-delimited file are its header: a bundle has one header, at its
    start, and takes only files with the same one. Files that begin with the zstandard magic number are joined as
    frames, apart from the others.
    """
    rows = files.select(F.col(f"`{file_id}`").cast("bigint").alias("file_id"), F.col(f"`{path}`").cast("string").alias("path"), F.coalesce(F.col(f"`{content}`").cast("binary"), F.lit(b"")).alias("content"))
    once, others = _told_apart(rows)

    def packer(side: int):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, made = TaskContext.get().partitionId(), 0
            filling: dict[tuple[str, bytes], _Open] = {}

            def close(bundle: _Open) -> pa.RecordBatch:
                nonlocal made
                made += 1
                return bundle.row(part << 34 | made << 1 | side)

            for batch in batches:
                for fid, where, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    kind, header = ("zstd" if body[:4] == FRAME else "lines"), b""
                    if header_lines and kind == "lines":
                        header, body = _cut_header(body, header_lines)
                    now = filling.get((kind, header))
                    if now is not None and now.members and now.size + len(body) > target_bytes:
                        yield close(now)
                        now = None
                    if now is None:
                        now = filling[kind, header] = _Open(kind, header)
                    now.add(fid, where, body)
                    if len(filling) > 64:  # many different headers: close the largest
                        yield close(filling.pop(max(filling, key=lambda k: filling[k].size)))
            for now in filling.values():
                yield close(now)

        return pack

    return once.mapInArrow(packer(0), BUNDLES).unionByName(others.mapInArrow(packer(1), BUNDLES))


def whole(bundle: dict) -> Iterator[tuple[dict, bytes]]:
    """The members of a bundle with their bytes; an error where a length or checksum differs from the index."""
    payload = bundle["payload"]
    if len(payload) != bundle["n_bytes"] or zlib.crc32(payload) != bundle["crc"]:
        raise ValueError(f"bundle {bundle['bundle_id']} is damaged")
    for m in bundle["members"]:
        body = payload[m["start"] : m["start"] + m["length"]]
        if len(body) != m["length"] or zlib.crc32(body) != m["crc"]:
            raise ValueError(f"file {m['file_id']} in bundle {bundle['bundle_id']} is damaged")
        yield m, body


def members(bundles: DataFrame) -> DataFrame:
    """Every packed file again, cut out by the index: ``bundle_id, file_id, path, content, intact``.

    ``intact`` is false where length or checksum of the file or of its bundle differ from the index.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                intact = len(b["payload"]) == b["n_bytes"] and zlib.crc32(b["payload"]) == b["crc"]
                out = [(m, b["payload"][m["start"] : m["start"] + m["length"]]) for m in b["members"]]
                yield pa.RecordBatch.from_pydict({
                    "bundle_id": pa.array([b["bundle_id"]] * len(out), pa.int64()), "file_id": pa.array([m["file_id"] for m, _ in out], pa.int64()),
                    "path": pa.array([m["path"] for m, _ in out], pa.string()), "content": pa.array([x for _, x in out], pa.binary()),
                    "intact": pa.array([intact and len(x) == m["length"] and zlib.crc32(x) == m["crc"] for m, x in out], pa.bool_()),
                })

    return bundles.select("bundle_id", "kind", "header", "payload", "n_bytes", "crc", "members").mapInArrow(unpack, "bundle_id bigint, file_id bigint, path string, content binary, intact boolean")


def write_bundles(bundles: DataFrame, out: str, kind: str = "lines") -> None:
    """One file for each bundle of the kind, through Spark's commit protocol, so that a lost task leaves nothing behind.

    The text sink ends each row with a newline. For lines that newline replaces the payload's last one. For frames it
    becomes the content of an empty-but-for-one-byte skippable frame, which readers of the format pass over.
    """
    payload = F.col("payload")
    if kind == "lines":
        payload = F.when(F.substring(payload, -1, 1) == F.lit(b"\n"), F.substring(payload, F.lit(1), (F.col("n_bytes") - 1).cast("int"))).otherwise(payload)
    else:
        payload = F.concat(payload, F.lit(SKIPPABLE + (1).to_bytes(4, "little")))
    chosen = bundles.filter((F.col("kind") == kind) & (F.col("n_bytes") > 0))
    chosen.select(payload.cast("string").alias("value")).write.mode("errorifexists").option("maxRecordsPerFile", 1).text(out)


def check_written(spark: SparkSession, bundles: DataFrame, out: str, kind: str = "lines") -> DataFrame:
    """Checksums that stand on only one side: ``n_bytes, crc, missing`` or surplus in the folder; no row if all is well."""
    extra = 0 if kind == "lines" else 9
    want = bundles.filter((F.col("kind") == kind) & (F.col("n_bytes") > 0)).select("n_bytes", "crc")
    body = F.substring(F.col("content"), F.lit(1), (F.col("length") - extra).cast("int"))
    have = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select((F.col("length") - extra).alias("n_bytes"), F.crc32(body).alias("crc"))
    both = want.withColumn("d", F.lit(1)).unionByName(have.withColumn("d", F.lit(-1)))
    return both.groupBy("n_bytes", "crc").agg(F.sum("d").alias("missing")).filter("missing <> 0")
