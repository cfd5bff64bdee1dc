"""Archives (ZIP): reading members, packing, zipping a tree, repair.

Tasks stream members in and out, so memory follows the largest member and not
the archive."""

from __future__ import annotations

import io
import json
import os
import shutil
import zipfile
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import partial

import pyarrow as pa
from pyarrow.fs import LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicat import __version__, errors
from chronicat.sources import stores

MANIFEST, METADATA, ARCHIVE = "manifest.json", "metadata.json", ".zip"
#: Bytes of contents that a batch holds before it goes on.
BATCH = 8 << 20
BROKEN = (zipfile.BadZipFile, zipfile.LargeZipFile, EOFError, OSError, zlib.error, NotImplementedError)
MEMBERS = "archive string, member string, size bigint, content binary, corrupted boolean"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in MEMBERS.split(", ")])


def _members(batches, contents: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            rows: list[tuple] = []
            held = 0
            try:
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                    for i in z.infolist():
                        if i.is_dir():
                            continue
                        rows.append((path, i.filename, i.file_size, z.read(i) if contents or i.filename in (MANIFEST, METADATA) else None, False))
                        held += len(rows[-1][3] or b"") + 100
                        if held > BATCH:
                            yield _batch(rows)
                            rows, held = [], 0
            except BROKEN:
                rows.append((path, "", 0, None, True))
            if rows:
                yield _batch(rows)


def read_archives(spark: SparkSession, root: str, contents: bool = True) -> DataFrame:
    """(archive, member, size, content, corrupted): members of every archive,
    and a row for an archive that can't be read to its end. Without contents
    only manifests and metadata are unpacked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*" + ARCHIVE).load(root)
    return files.select("path", "content").mapInArrow(partial(_members, contents=contents), MEMBERS)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    if not path.endswith(ARCHIVE):
        raise errors.NotAnArchive(path)
    return read_archives(spark, path)


def member_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("archive").agg(F.count("*").alias("members"))


def member_exists(members: DataFrame, archive: str, member: str) -> bool:
    return not members.where((F.col("archive") == archive) & (F.col("member") == member)).limit(1).isEmpty()


def _put(batches, root: str):
    """Rows come sorted by archive and member."""
    name, made, stream, z = None, 0, None, None

    def close():
        z.close()
        stream.__exit__(None, None, None)
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([made], pa.int64())], names=["archive", "members"])

    try:
        for b in batches:
            for archive, member, content in zip(b.column("archive").to_pylist(), b.column("member").to_pylist(), b.column("content"), strict=True):
                if archive != name:
                    if name is not None:
                        yield close()
                    stream = stores.replacing(f"{root}/{archive}")
                    z, name, made = zipfile.ZipFile(stream.__enter__(), "w", zipfile.ZIP_DEFLATED), archive, 0
                z.writestr(zipfile.ZipInfo(member), content.as_buffer().to_pybytes() if content.is_valid else b"", zipfile.ZIP_DEFLATED)
                made += 1
    except BaseException as e:
        if stream is not None:
            stream.__exit__(type(e), e, e.__traceback__)
        raise
    if name is not None:
        yield close()


def write_archives(members: DataFrame, root: str) -> DataFrame:
    """Write (archive, member, content) as one archive per name below root, a
    store that every executor reaches. Returns (archive, members); nothing is
    written until that is used. A retry replaces its own file."""
    root = stores.qualified(members.sparkSession, root)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("archive", "member", "content").repartition(parts, "archive").sortWithinPartitions("archive", "member")
    return dealt.mapInArrow(partial(_put, root=root), "archive string, members bigint")


def zip_tree(files: DataFrame, out: str, name: str = "files" + ARCHIVE, recursive: bool = True) -> DataFrame:
    """One archive of scanned files (name, content) with their names below the
    root; of direct children alone unless ``recursive``."""
    rows = files if recursive else files.where(~F.contains("name", F.lit("/")))
    return write_archives(rows.select(F.lit(name).alias("archive"), F.col("name").alias("member"), "content"), out)


def metadata_json(entries: list[dict], compressed: int = 0) -> bytes:
    """The metadata document of a manifest's entries."""
    times = [e["modified"] for e in entries if e.get("modified")]
    at = lambda t: datetime.fromisoformat(t.replace("Z", "+00:00")).astimezone(UTC)
    return json.dumps(
        {
            "engine_version": __version__,
            "total_file_count": len({e["name"] for e in entries}),
            "target_file_count": len({e["target"] for e in entries}),
            "uncompressed_size": sum(e.get("size") or 0 for e in entries),
            "compressed_size": compressed,
            "oldest_file_ts": min(times, key=at, default=None),
            "newest_file_ts": max(times, key=at, default=None),
        }
    ).encode()


def _lock(store, path: str) -> None:
    """Make a lock file, in one step where the store can. One that a lost task
    left has to be taken away by hand."""
    try:
        if isinstance(store, LocalFileSystem):
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600))
            return
    except FileExistsError:
        raise errors.ArchiveLocked(path) from None
    if store.get_file_info(path).is_file:
        raise errors.ArchiveLocked(path)
    store.open_output_stream(path).close()


def _repair(path: str, remove_backup: bool) -> dict:
    """Rewrite one archive beside itself and swap; the old one stays as
    ``.bak``. Entries whose content is missing and contents that no entry names
    go, tombstones stay, metadata is written anew."""
    store, at = stores.opened(path)
    size = store.get_file_info(at).size
    if path.startswith(("file:", "/")) and shutil.disk_usage(at.rsplit("/", 1)[0]).free < 2 * size:
        raise errors.InsufficientSpace(f"{path}: a repair needs {2 * size} bytes")
    lock = f"{at}.lock"
    _lock(store, lock)
    try:
        with store.open_input_file(at) as f, zipfile.ZipFile(f) as old:
            held = {i.filename: i for i in old.infolist() if not i.is_dir()}
            document = json.loads(old.read(MANIFEST))
            entries = [{**e, "target": e.get("target") or ""} for e in document.get("entries") or []]
            good = [e for e in entries if not e["target"] or e["target"] in held]
            used = {e["target"] for e in good if e["target"]}
            orphans = [m for m in held if m not in used and m not in (MANIFEST, METADATA)]
            with stores.replacing(f"{path}.new") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
                new.writestr(MANIFEST, json.dumps({**document, "entries": good}))
                new.writestr(METADATA, metadata_json(good, size))
                for m in sorted(used):  # copied piece by piece
                    with old.open(held[m]) as source, new.open(zipfile.ZipInfo(m), "w") as sink:
                        shutil.copyfileobj(source, sink, 1 << 20)
        store.move(at, f"{at}.bak")
        store.move(f"{at}.new", at)
        if remove_backup:
            store.delete_file(f"{at}.bak")
    finally:
        store.delete_file(lock)
    return {"orphaned_files_removed": len(orphans), "missing_entries_fixed": len(entries) - len(good)}


def _repairs(batches, remove_backup: bool):
    for b in batches:
        for path in b.column("archive").to_pylist():
            done, error = {}, None
            try:
                done = _repair(path, remove_backup)
            except (errors.ArchiveLocked, errors.InsufficientSpace, *BROKEN, KeyError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([error is None]), pa.array([done.get("orphaned_files_removed", 0)], pa.int64()), pa.array([done.get("missing_entries_fixed", 0)], pa.int64()), pa.array([error], pa.string())], names=["archive", "repaired", "orphaned_files_removed", "missing_entries_fixed", "error"])


def repair_archives(plan: DataFrame, remove_backup: bool = False) -> DataFrame:
    """Rewrite the repairable archives of a preview (archive, repairable).
    Returns (archive, repaired, orphaned_files_removed, missing_entries_fixed,
    error); each archive is one task's work, and run again it changes nothing."""
    todo = plan.where("repairable").select("archive")
    return todo.repartition(max(1, todo.count()), "archive").mapInArrow(partial(_repairs, remove_backup=remove_backup), "archive string, repaired boolean, orphaned_files_removed bigint, missing_entries_fixed bigint, error string")
