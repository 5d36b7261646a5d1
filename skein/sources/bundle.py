"""Bundles: part files of JSON lines, CSV or zipped XML with a manifest, written in two phases and checked before they are read.

Tasks write their part beside the place where it will stand, hash it on the way and tell the driver its size, SHA-256 and a
CRC-32 of every block. When all have done so the parts are moved and the manifest is written last: a folder without one is no bundle. A
task that runs again writes another part, and only the part of the attempt that counted is moved.
"""

import csv
import hashlib
import io
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# What parts are called, the bytes that begin a CSV, bytes of a block, entries and their bytes handed on together.
ENDINGS = {"jsonl": "jsonl", "csv": "csv", "nfozip": "zip"}
BOM, BLOCK, VERSION = b"\xef\xbb\xbf", 1 << 16, 1
ENTRIES, ENTRY_BYTES = 1_000, 1 << 20
MANIFEST, TEMPORARY = "manifest.json", "_temporary"
CHECK = "path string, bytes long, damage string, offset long"


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


@dataclass
class Part(WriterCommitMessage):
    """What a task tells of its part; no name if it had no row."""

    temporary: str | None
    number: int
    rows: int
    size: int
    sha256: str
    blocks: list[int]


class Hashed(io.RawIOBase):
    """A stream to write to that hashes what passes, whole and by blocks."""

    def __init__(self, out):
        self.out, self.size, self.sha, self.blocks, self.crc = out, 0, hashlib.sha256(), [], 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        data = bytes(data)
        self.out.write(data)
        self.sha.update(data)
        rest = data
        while rest:
            piece = rest[: BLOCK - self.size % BLOCK]
            self.crc, self.size, rest = zlib.crc32(piece, self.crc), self.size + len(piece), rest[len(piece) :]
            if self.size % BLOCK == 0:
                self.blocks.append(self.crc)
                self.crc = 0
        return len(data)

    def checksums(self) -> list[int]:
        return self.blocks + [self.crc] if self.size % BLOCK else self.blocks


class BundleWriter(DataSourceWriter):
    """Writes one part for each task."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.folder = schema.names, options["path"].rstrip("/")
        self.kind, self.root = options.get("kind", "jsonl"), options.get("root", "item")
        self.entry = options.get("entry", schema.names[0])
        if self.kind not in ENDINGS:
            raise ValueError(f"unsupported export format {self.kind!r}")

    def write(self, iterator: Iterator[Row]) -> Part:
        first = next(iterator, None)
        number = TaskContext.get().partitionId()
        if first is None:
            return Part(None, number, 0, 0, "", [])
        system, folder = _system(self.folder)
        system.create_dir(f"{folder}/{TEMPORARY}")
        name = f"{TEMPORARY}/{number}-{uuid.uuid4().hex}"
        rows = 0
        with system.open_output_stream(f"{folder}/{name}") as raw:
            out = Hashed(raw)
            put = getattr(self, f"_{self.kind}")(out)
            for row in (r for source in ([first], iterator) for r in source):
                put(row)
                rows += 1
            put(None)
        return Part(name, number, rows, out.size, out.sha.hexdigest(), out.checksums())

    def _jsonl(self, out: Hashed):
        def put(row: Row | None) -> None:
            if row is not None:
                out.write(json.dumps(row.asDict(True), ensure_ascii=False, default=str).encode() + b"\n")

        return put

    def _csv(self, out: Hashed):
        def line(values: list) -> None:
            text = io.StringIO()
            csv.writer(text, lineterminator="\r\n").writerow(["" if v is None else v for v in values])
            out.write(text.getvalue().encode())

        out.write(BOM)
        line(self.names)
        return lambda row: line(list(row)) if row is not None else None

    def _nfozip(self, out: Hashed):
        archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        used: dict[str, int] = {}

        def put(row: Row | None) -> None:
            if row is None:
                archive.close()
                return
            element = ElementTree.Element(self.root)
            for name, value in row.asDict().items():
                if value is not None:
                    ElementTree.SubElement(element, name).text = str(value)
            stem = "".join(c if c.isalnum() or c in "_-" else "_" for c in str(row[self.entry] if row[self.entry] is not None else "")) or "item"
            used[stem] = used.get(stem, 0) + 1
            name = stem if used[stem] == 1 else f"{stem}-{used[stem]}"
            archive.writestr(f"{self.root}s/{name}.nfo", ElementTree.tostring(element, "utf-8", xml_declaration=True))

        return put

    def commit(self, messages: list[Part]) -> None:
        system, folder = _system(self.folder)
        files = []
        for p in sorted((m for m in messages if m and m.temporary), key=lambda m: m.number):
            name = f"part-{p.number:05d}.{ENDINGS[self.kind]}"
            system.move(f"{folder}/{p.temporary}", f"{folder}/{name}")
            files.append({"path": name, "bytes": p.size, "sha256": p.sha256, "rows": p.rows, "blocks": p.blocks})
        system.create_dir(folder)
        self._clear(system, folder)
        manifest = {"version": VERSION, "kind": self.kind, "columns": self.names, "block": BLOCK, "files": files}
        with system.open_output_stream(f"{folder}/{TEMPORARY}.{MANIFEST}") as out:
            out.write(json.dumps(manifest).encode())
        system.move(f"{folder}/{TEMPORARY}.{MANIFEST}", f"{folder}/{MANIFEST}")

    def abort(self, messages: list[Part]) -> None:
        self._clear(*_system(self.folder))

    def _clear(self, system, folder: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{folder}/{TEMPORARY}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/{TEMPORARY}")


class BundleSource(DataSource):
    """``df.write.format("bundle")`` with the options path, kind (jsonl, csv, nfozip), root and entry (of XML)."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BundleWriter(schema, dict(self.options))


def write_bundle(df: DataFrame, folder: str, kind: str = "jsonl", **options: str) -> None:
    """``df`` as a bundle in a new folder. A table without rows is a bundle without parts."""
    df.sparkSession.dataSource.register(BundleSource)
    df.write.format("bundle").mode("append").options(path=folder, kind=kind, **options).save()


def manifest(folder: str) -> dict:
    """The manifest of a bundle; an error if there is none."""
    system, inner = _system(folder.rstrip("/"))
    try:
        with system.open_input_stream(f"{inner}/{MANIFEST}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        raise ValueError(f"no bundle in {folder}: it has no manifest") from None


def damaged_byte(block: bytes, crc: int) -> list[tuple[int, int]]:
    """(place, right value) of each single byte whose change would give a block its CRC-32."""
    table = np.array([zlib.crc32(bytes([v])) ^ zlib.crc32(b"\0") for v in range(256)], np.uint64)
    wanted, found = zlib.crc32(block) ^ crc, []
    effect = table[1:].copy()
    for place in range(len(block) - 1, -1, -1):
        for v in (np.flatnonzero(effect == wanted) + 1).tolist():
            found.append((place, block[place] ^ v))
        effect = table[(effect & np.uint64(255)).astype(np.int64)] ^ (effect >> np.uint64(8))
    return found


def checked(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, damage, offset) of a bundle's parts: damage is null, ``missing``, ``size`` or ``content``.

    offset is where content is damaged first: the very byte where one byte of one block differs, else the start of the first block whose
    checksum does; for a size it is the size found. Parts are read by tasks, a block at a time.
    """
    files = manifest(folder)["files"]
    folder = folder.rstrip("/")
    rows = spark.createDataFrame([(f["path"], f["bytes"], f["sha256"], f["blocks"]) for f in files], "path string, bytes long, sha256 string, blocks array<long>")

    def blocks(system, path: str) -> Iterator[bytes]:
        with system.open_input_stream(path) as f:
            while piece := f.read(BLOCK):
                yield piece

    def one(system, inner: str, path: str, size: int, sha256: str, crcs: list[int]) -> tuple:
        sha, total, bad = hashlib.sha256(), 0, []
        try:
            for k, piece in enumerate(blocks(system, f"{inner}/{path}")):
                sha.update(piece)
                total += len(piece)
                if k >= len(crcs) or zlib.crc32(piece) != crcs[k]:
                    bad.append((k, piece))
        except FileNotFoundError:
            return path, size, "missing", None
        if total != size:
            return path, size, "size", total
        if sha.hexdigest() == sha256:
            return path, size, None, None
        k, piece = bad[0] if bad else (0, b"")
        if len(bad) == 1:
            for place, value in damaged_byte(piece, crcs[k]):
                mended = hashlib.sha256()
                for j, p in enumerate(blocks(system, f"{inner}/{path}")):
                    mended.update(p if j != k else p[:place] + bytes([value]) + p[place + 1 :])
                if mended.hexdigest() == sha256:
                    return path, size, "content", k * BLOCK + place
        return path, size, "content", k * BLOCK

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _system(folder)
        for batch in batches:
            found = [one(system, inner, *row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found), kinds)], names=["path", "bytes", "damage", "offset"])

    return rows.repartition(max(1, len(files))).mapInArrow(check, CHECK)


def read_bundle(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of a bundle, or of zipped XML its entries (entry, content); refused, with every damaged part named, unless all are whole."""
    about = manifest(folder)
    bad = checked(spark, folder).where("damage is not null").orderBy("path").collect()
    if bad:
        raise ValueError("damaged bundle: " + "; ".join(f"{r.path}: {r.damage}" + (f" at byte {r.offset}" if r.offset is not None else "") for r in bad))
    paths = [f"{folder.rstrip('/')}/{f['path']}" for f in about["files"]]
    if not paths:
        return spark.createDataFrame([], schema)
    if about["kind"] == "jsonl":
        return spark.read.schema(schema).json(paths)
    if about["kind"] == "csv":
        return spark.read.schema(schema).csv(paths, header=True, escape='"', multiLine=True)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = _system(path)
                with system.open_input_file(inner) as f, zipfile.ZipFile(f) as archive:
                    names, texts, held = [], [], 0
                    for name in archive.namelist():
                        text = archive.read(name)
                        names.append(name)
                        texts.append(text.decode())
                        held += len(text)
                        if held >= ENTRY_BYTES or len(names) == ENTRIES:
                            yield pa.RecordBatch.from_pydict({"entry": names, "content": texts})
                            names, texts, held = [], [], 0
                    if names:
                        yield pa.RecordBatch.from_pydict({"entry": names, "content": texts})

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(entries, "entry string, content string")
