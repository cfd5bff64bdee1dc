"""Catalog operators on hand-made logs."""

import json
import os
import random
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronicat import errors
from chronicat.functions import bytes as ranges
from chronicat.functions import hashing, paths
from chronicat.operators import asof, boundaries, content, listing, stats, validation
from chronicat.plans import convert
from chronicat.sources import archives, catalog
from chronicat.streaming import ingest

LOG = "manifest string, pos bigint, name string, target string, size bigint, ts timestamp"
D = lambda m, d=1, h=0, mi=0, s=0, us=0: datetime(2024, m, d, h, mi, s, us)


def log(spark, *rows):
    return spark.createDataFrame([("m", i, n, t, 1, ts) if len(r) == 3 else r for i, r in enumerate(rows) for n, t, ts in [r[:3] if len(r) == 3 else (None,) * 3]], LOG)


def names(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_asof_ties_and_tombstones(spark):
    c = log(spark, ("a", "1-0-x", D(1)), ("a", "1-0-y", D(1)), ("b", "1-0-x", D(1)), ("b", "", D(2)), ("b", "1-0-z", D(3)))
    assert names(asof.snapshot(c, D(1, 15)), "name", "target") == [("a", "1-0-x"), ("b", "1-0-x")]
    assert names(asof.snapshot(c, D(2, 15)), "name", "target") == [("a", "1-0-x")]
    assert names(asof.snapshot(c), "name", "target") == [("a", "1-0-x"), ("b", "1-0-z")]
    assert names(asof.live(c, "first"), "name", "target") == [("a", "1-0-x"), ("b", "1-0-x")]
    with pytest.raises(ValueError):
        asof.live(c, "other")


def test_day_cutoff_is_a_second_short_of_midnight(spark):
    c = log(spark, ("a", "t", D(1, 5, 23, 59, 59)), ("b", "t", D(1, 5, 23, 59, 59, 500_000)))
    _, at, _ = paths.resolve("snapshots/2024/01/05")
    assert names(asof.snapshot(c, at), "name") == [("a",)]


def test_same_name_in_two_manifests(spark):
    c = spark.createDataFrame([("m", 0, "a", "t", 1, D(1)), ("n", 0, "a", "u", 1, D(2))], LOG)
    assert asof.snapshot(c).count() == 2


def test_collapse_and_counts(spark):
    c = log(spark, ("f1", "v1", D(1)), ("f1", "v2", D(2)), ("f1", "v3", D(3)), ("f2", "v1", D(1, 15)))
    assert names(asof.collapse(c), "name", "target") == [("f1", "v3"), ("f2", "v1")]
    for rows, n in [
        ((), 0),
        ((("f1", "h", None), ("f2", "h", None)), 2),
        ((("f1", "h", None), ("f2", "", None), ("f3", "h", None)), 2),
        ((("f1", "", None), ("f2", "", None)), 0),
        ((("f1", "h1", D(1)), ("f1", "h2", D(2)), ("f1", "", D(3))), 0),
        ((("f1", "h1", D(1)), ("f1", "", D(2)), ("f1", "h3", D(3))), 1),
        ((("f1", "h1", None), ("f1", "h2", None), ("f2", "h3", None), ("f2", "", None), ("f3", "h4", None)), 2),
    ]:
        found = stats.active_count(log(spark, *rows)).collect() if rows else []
        assert (found[0].active_files if found else 0) == n


def test_snapshot_without_bound_is_collapse_without_tombstones(spark):
    r = random.Random(3)
    c = log(spark, *[(f"n{r.randrange(20)}", r.choice(["", "x", "y"]), datetime(2024, 1, 1 + i // 24, i % 24)) for i in range(300)])
    assert names(asof.snapshot(c), "name", "target") == names(asof.alive(asof.collapse(c)), "name", "target")


def test_positions(spark):
    c = log(spark, ("a", "t", D(1)), ("b", "t", D(1)), ("c", "t", D(1)))
    assert names(asof.without_position(c, 1), "name") == [("a",), ("c",)]
    with pytest.raises(IndexError):
        asof.without_position(c, 5)
    assert asof.at_position(c, 7).count() == 0


def test_metadata_counts_the_empty_target(spark):
    m = stats.metadata(log(spark, ("a", "t", D(1)), ("a", "", D(2)), ("b", "t", D(3)))).first()
    assert (m.total_file_count, m.target_file_count, m.uncompressed_size, m.oldest_file_ts, m.newest_file_ts) == (2, 2, 3, D(1), D(3))


def test_prefix_isn_t_a_path_component(spark):
    c = log(spark, ("dev1/a", "t", D(1)), ("dev10/a", "t", D(1)))
    assert asof.under_prefix(c, "dev1").count() == 2
    assert names(listing.children(c, "dev1"), "entry", "kind") == [("a", "file")]
    assert names(listing.children(c), "entry", "kind") == [("dev1", "dir"), ("dev10", "dir")]


def test_offsets(spark, tmp_path):
    entries = [{"size": 1, "inode": 2**64 - 1, "modified": "2024-01-01T20:00:00.123456789-08:00", "name": "a", "target": "1-00000-ff"}]
    for folder, doc in (("x", {"entries": entries, "sorted": True}), ("y", {"entries": None, "sorted": False})):
        os.makedirs(tmp_path / folder)
        (tmp_path / folder / catalog.MANIFEST).write_text(json.dumps(doc))
    c = catalog.read_manifests(spark, str(tmp_path))
    row = c.collect()[0]
    assert c.count() == 1 and row.local_date == "2024-01-01" and row.ts == datetime(2024, 1, 2, 4, 0, 0, 123456) and row.inode == 2**64 - 1
    assert names(listing.calendar(c, "2024", "01"), "day") == [("01",)]
    back = catalog.envelope(c).first().value
    assert json.loads(back)["entries"][0]["name"] == "a" and json.loads(back)["sorted"] is True


def test_hash_functions(spark):
    d = spark.createDataFrame([("hello world", "742-00000-abc123def456", "abc123def456"), ("", "742-abc123", "abc")], "c string, t string, h string")
    rows = d.select(F.sha2("c", 256), hashing.sha_of_target(F.col("t")), hashing.work_prefix(F.col("t")), hashing.archive_prefix(F.col("t")), hashing.subbucket(F.col("h"))).collect()
    assert rows[0][0].startswith("b94d27b9934d3e08") and rows[1][0].startswith("e3b0c442")
    assert tuple(rows[0])[1:4] == ("abc123def456", "742/00000", "742-00000") and tuple(rows[1])[1:4] == (None,) * 3
    assert rows[0][4] == 0xEF456 % 100000 and rows[1][4] == 0
    digits = spark.createDataFrame([(c,) for c in "019abfABFgz "], "c string").select(hashing.hex_digit(F.col("c"))).collect()
    assert [r[0] for r in digits] == [0, 1, 9, 10, 11, 15, 10, 11, 15, 0, 0, 0]
    p = spark.createDataFrame([("/s/work/123/00000", "d/a.json")], "w string, f string").select(hashing.archive_path(F.col("w"), "/s/work", "/s/data"), hashing.hashed_name(F.col("f"), F.lit("ff"))).first()
    assert tuple(p) == ("/s/data/123-00000.zip", "d/ff.json")


def test_paths(spark):
    assert paths.paths_overlap("/a/b", "/a") and paths.paths_overlap("/a", "/a/") and not paths.paths_overlap("/a", "/ab")
    assert paths.resolve("live/a/b") == ("live", None, "a/b") and paths.resolve("snapshots/latest/x")[0] == "latest"
    assert paths.resolve("snapshots/2024/02/29/a")[2] == "a"
    for bad in ("snapshots/24", "snapshots/2024/13", "snapshots/2024/02/30", "other"):
        with pytest.raises(FileNotFoundError):
            paths.resolve(bad)


def test_nearest_manifest_has_no_fallback(spark):
    c = spark.createDataFrame([("", 0, "a/x", "t", 1, D(1)), ("a", 0, "y", "t", 1, D(1))], LOG)
    wanted = spark.createDataFrame([("a/x",), ("a/y",), ("b",)], "path string")
    assert names(listing.nearest_manifest(wanted, c.select(F.col("manifest").alias("dir"))), "path", "dir") == [("a/x", "a"), ("a/y", "a"), ("b", "")]
    assert names(listing.find_entries(wanted, c), "path") == [("a/y",)]


def by_recursion(files, target):
    def total(d):
        return sum(f.startswith(d + "/") or not d for f in files)

    out = set()

    def walk(d):
        if total(d) <= target:
            out.add((d, True))
            return
        rest = [f[len(d) + 1 :] if d else f for f in files if not d or f.startswith(d + "/")]
        for s in {r.split("/")[0] for r in rest if "/" in r}:
            walk(f"{d}/{s}" if d else s)
        if any("/" not in r for r in rest):
            out.add((d, False))

    walk("")
    return out


@pytest.mark.parametrize("key", range(4))
def test_boundaries_match_the_recursive_rule(spark, key):
    r = random.Random(key)
    files = sorted({"/".join(r.choice("abc") for _ in range(r.randrange(4))) + f"/f{i}" for i in range(40)} | {"top"})
    files = [f.lstrip("/") for f in files]
    d = spark.createDataFrame([(f,) for f in files], "path string")
    for target in (0, 3, 10, 100):
        found = boundaries.boundaries(d, target)
        assert set(names(found, "path", "include_subdirs")) == by_recursion(files, target)
        assert boundaries.assigned(d, target).groupBy("boundary", "include_subdirs").count().join(found.where("files > 0").withColumnRenamed("path", "boundary"), ["boundary", "include_subdirs"], "full").where("not count <=> files").count() == 0


def test_empty_folders_are_boundaries(spark):
    files = spark.createDataFrame([("a/1",), ("a/2",)], "path string")
    folders = spark.createDataFrame([("e",)], "dir string")
    assert ("e", True) in names(boundaries.boundaries(files, 1, folders), "path", "include_subdirs")


def test_put_and_merge(spark):
    old = spark.createDataFrame([(1, "t1", "old")], "n int, target string, c string")
    new = spark.createDataFrame([(2, "t1", "new"), (3, "t2", "x"), (4, "t2", "y")], "n int, target string, c string")
    assert names(content.put(old, new, "n"), "target", "c") == [("t2", "x")]
    assert names(content.merged(new.where("n = 2"), old), "target", "c") == [("t1", "new")]


def test_validate_and_repair(spark):
    e = spark.createDataFrame([("z", 0, "a", "t1", 1, D(1)), ("z", 1, "b", "gone", 1, D(1)), ("z", 2, "b", "gone", 1, D(2)), ("z", 3, "c", "", 0, D(3))], LOG.replace("manifest", "archive"))
    m = spark.createDataFrame([("z", "t1"), ("z", "orphan"), ("z", catalog.MANIFEST), ("bad", "x")], "archive string, member string")
    s = spark.createDataFrame([("z", 9, 9)], "archive string, total_file_count bigint, target_file_count bigint")
    a = spark.createDataFrame([("z",), ("bad",)], "archive string")
    f = validation.findings(a, e, m.where("archive = 'z'"), s, a.where("archive = 'bad'"))
    kinds = sorted(r.kind for r in f.collect())
    assert kinds == ["corrupted", "metadata mismatch", "metadata mismatch", "missing metadata", "missing target", "missing target", "orphan"]
    p = {r.archive: r for r in validation.preview(f).collect()}
    assert p["z"].missing_entries_fixed == 2 and p["z"].orphaned_files_removed == 1 and p["z"].metadata_regenerated and not p["bad"].repairable
    e2, m2, s2 = validation.repaired(e, m.where("archive = 'z'"))
    meta = m2.unionByName(spark.createDataFrame([("z", catalog.METADATA)], "archive string, member string"))
    assert validation.findings(a.where("archive = 'z'"), e2, meta, s2).count() == 0
    assert names(e2, "name") == [("a",), ("c",)]


def test_archives_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1-00000.zip", "k1", b"one"), ("1-00000.zip", "k2", b"two"), ("2-00000.zip", "k3", b"")], "archive string, member string, content binary")
    assert archives.write_archives(rows, str(tmp_path)).agg(F.sum("members")).first()[0] == 3
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = archives.read_archives(spark, str(tmp_path)).cache()
    assert names(got.where("not corrupted"), "member", "content") == [("k1", b"one"), ("k2", b"two"), ("k3", b"")]
    assert got.where("corrupted").count() == 1
    with zipfile.ZipFile(tmp_path / "1-00000.zip") as z:
        assert z.namelist() == ["k1", "k2"]
    new = spark.createDataFrame([("1-00000-k1", b"new")], "target string, content binary")
    old = got.withColumn("member", F.concat(F.lit("1-00000-"), "member"))
    out = str(tmp_path / "again")
    convert.repack_buckets(new, old.where("member <> '1-00000-'"), out).collect()
    assert ("1-00000-k1", b"new") in names(archives.read_archives(spark, out), "member", "content")


def test_convert(spark, tmp_path):
    for i in range(6):
        p = tmp_path / "in" / f"d{i % 2}" / f"{i}.json"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(str(i // 2))
    (tmp_path / "in" / "metadata.json").write_text("the engine's own")
    m = convert.convert(spark, f"file:{tmp_path}/in", str(tmp_path / "out"), 3).first()
    assert m.total_file_count == 6 and m.target_file_count == 3
    log = spark.read.parquet(str(tmp_path / "out/log"))
    assert names(log, "manifest", "pos") == [(d, i) for d in ("d0", "d1") for i in range(3)]
    with zipfile.ZipFile(tmp_path / "out/data/d1.zip") as z:
        assert len(z.namelist()) == 5 and json.loads(z.read(archives.METADATA))["total_file_count"] == 3
        assert [e["name"] for e in json.loads(z.read(archives.MANIFEST))["entries"]] == [r.name for r in log.where("manifest = 'd1'").orderBy("pos").collect()]
    assert spark.read.parquet(str(tmp_path / "out/blobs")).count() == 3
    assert catalog.count_files(spark, str(tmp_path / "in")) == 7


def test_ingest_restarts_without_doubling(spark, tmp_path):
    land, store = tmp_path / "land", tmp_path / "store"
    land.mkdir()
    (land / "a.json").write_text("one")
    (land / "empty").write_text("")
    run = lambda: ingest.start(spark, f"file:{land}", str(store), every=None).awaitTermination()
    run()
    (land / "b.json").write_text("one")
    (land / "c.json").write_text("two")
    run()
    run()
    assert names(ingest.read_log(spark, str(store)), "name") == [("a.json",), ("b.json",), ("c.json",)]
    assert ingest.read_blobs(spark, str(store)).count() == 2
    batch = spark.read.format("binaryFile").load(str(land))
    ingest.commit(batch, 0, f"file:{land}", str(store))
    ingest.commit(batch, 0, f"file:{land}", str(store))
    assert ingest.read_blobs(spark, str(store)).where("batch = 0").count() == 2


def test_seed_is_deterministic_and_mixed(spark):
    a, b = catalog.seed(spark, 2000), catalog.seed(spark, 2000)
    assert a.exceptAll(b).count() == 0 and a.select("content").distinct().count() <= 50
    share = a.where(F.size(F.split("folder", "/")) == 6).count() / 2000
    assert 0.5 < share < 0.7


def test_ids(spark):
    r = spark.createDataFrame([(5,), (9,)], "inode bigint")
    assert stats.next_ids(r).first()[0] == 10 and stats.next_ids(r, 100).first()[0] == 101 and stats.next_ids(r.where("false")).first()[0] == 1
    rows = stats.with_ids(spark.range(1000).repartition(7), 50)
    assert rows.select("inode").distinct().count() == 1000 and rows.where("inode <= 50").count() == 0


def test_names_below_relative_and_repeated_roots(spark, tmp_path, monkeypatch):
    for f in ("in/y.json", "in/main/y.json", "in/in/in/z json+1%.txt", "in/manifest.json", "in/a.zip"):
        p = tmp_path / f
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f)
    want = [("in/in/z json+1%.txt",), ("main/y.json",), ("y.json",)]
    for root in (str(tmp_path / "in"), f"file:{tmp_path}/in/", f"file://{tmp_path}/in", os.path.relpath(tmp_path / "in")):
        scanned = catalog.scan_files(spark, root)
        assert names(scanned, "name") == want and scanned.select("inode").distinct().count() == 3
    assert names(catalog.scan_files(spark, str(tmp_path / "in"), recursive=False), "name") == [("y.json",)]
    assert names(catalog.counts_by_folder(spark, str(tmp_path / "in")), "folder", "files") == [("", 3), ("in", 1), ("main", 1)]
    with pytest.raises(errors.ExpectedFolder):
        catalog.scan_files(spark, str(tmp_path / "in/y.json"))


def test_manifests_round_trip(spark, tmp_path):
    rows = [("", 0, "top", "t0", 1, D(1)), ("a b/c", 0, "x", "t1", 5, D(1, 2, 3, 4, 5, 678)), ("a b/c", 1, "x", "", 0, D(2)), ("a b", 0, "c/x", "t2", 1, D(1))]
    c = spark.createDataFrame(rows, LOG)
    root = str(tmp_path / "store")
    assert catalog.write_manifests(c, root) == 3 and catalog.write_manifests(c, root) == 3
    back = catalog.read_manifests(spark, root)
    assert names(back, "manifest", "pos", "name", "target", "size", "ts") == sorted(rows)
    wanted = spark.createDataFrame([("a b/c/x",), ("top",), ("none/x",)], "path string")
    assert names(listing.find_entries(wanted, back, D(1, 15)), "path", "target") == [("a b/c/x", "t1"), ("top", "t0")]
    assert [f for _, _, fs in os.walk(root) for f in fs if not f.endswith(".crc")] == [catalog.MANIFEST] * 3


def test_positions_are_dense_and_ordered_over_many_partitions(spark):
    rows = spark.range(3000).select(F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**6)).cast("string"), 6, "0").alias("name"), F.timestamp_seconds(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(200))).alias("ts"))
    spark.conf.set("spark.sql.shuffle.partitions", "130")
    try:
        got = ingest.placed(rows, 7).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got.sort(key=lambda r: r.pos)
    assert [r.pos for r in got] == [(7 << 40) + i for i in range(3000)]
    assert [(r.ts, r.name) for r in got] == sorted((r.ts, r.name) for r in got)


def test_landing_is_cleaned(spark, tmp_path):
    land, store, gone = tmp_path / "land", tmp_path / "store", tmp_path / "gone"
    (land / "deep").mkdir(parents=True)
    for k in range(3):  # a file goes once a later batch has been planned
        (land / "deep" / f"{k}.json").write_text(str(k))
        ingest.start(spark, f"file:{land}", str(store), every=None, clean="archive", archive=f"file:{gone}").awaitTermination()
    assert names(ingest.read_log(spark, str(store)), "name") == [(f"deep/{k}.json",) for k in range(3)]
    assert any(f == "0.json" for _, _, fs in os.walk(gone) for f in fs)


def broken_store(spark, tmp_path):
    """An archive with an orphan, a dangling entry, a tombstone and wrong
    metadata, a sound one, one without manifest, one that isn't an archive."""
    store = tmp_path / "store"
    store.mkdir()
    e = lambda n, t: {"size": 1, "inode": 1, "modified": "2024-01-01T00:00:00Z", "name": n, "target": t}
    good = [e("a", "t1"), e("b", "t2"), e("c", "")]
    for name, entries, members in (("odd", [*good, e("d", "lost")], ["t1", "t2", "orphan"]), ("fine", good, ["t1", "t2"]), ("bare", None, ["t1"])):
        with zipfile.ZipFile(store / f"{name}.zip", "w") as z:
            for m in members:
                z.writestr(m, "content of " + m)
            if entries is not None:
                z.writestr(archives.MANIFEST, json.dumps({"entries": entries, "sorted": True}))
                z.writestr(archives.METADATA, archives.metadata_json(good))
    (store / "torn.zip").write_bytes(b"PK not really")
    return store


def test_repair_writes_and_validates_clean(spark, tmp_path):
    from chronicat.__main__ import check

    store = broken_store(spark, tmp_path)
    _, found = check(spark, str(store))
    plan = validation.preview(found).cache()
    words = {os.path.basename(r.archive): r.summary for r in validation.rendered_plan(plan).collect()}
    assert words == {"odd.zip": "metadata regenerated, 1 orphaned removed, 1 missing entries fixed", "bare.zip": "not repairable", "torn.zip": "not repairable"}
    assert "corrupted" in {r.errors for r in validation.joined(found).collect()}
    (store / "odd.zip.lock").write_text("")
    assert archives.repair_archives(plan).first().error.startswith("ArchiveLocked")
    (store / "odd.zip.lock").unlink()
    done = archives.repair_archives(plan).collect()
    assert [(r.repaired, r.orphaned_files_removed, r.missing_entries_fixed) for r in done] == [(True, 1, 1)]
    assert sorted(os.listdir(store)) == ["bare.zip", "fine.zip", "odd.zip", "odd.zip.bak", "torn.zip"]
    left = {os.path.basename(r.archive) for r in check(spark, str(store))[1].collect()}
    assert left == {"bare.zip", "torn.zip"}
    with zipfile.ZipFile(store / "odd.zip") as z:
        assert z.read("t2") == b"content of t2" and {x["name"] for x in json.loads(z.read(archives.MANIFEST))["entries"]} == {"a", "b", "c"}


def test_command_line(spark, tmp_path, capsys):
    from chronicat.__main__ import main

    store = broken_store(spark, tmp_path)
    assert main(["validate", "-p", str(store), "-v", "-r", "--dry-run"]) == 1 and not (store / "odd.zip.bak").exists()
    assert "1 orphaned removed" in capsys.readouterr().out
    assert main(["validate", "-p", str(store), "-r", "--remove-backup"]) == 1 and not (store / "odd.zip.bak").exists()
    for name in ("bare.zip", "torn.zip"):
        (store / name).unlink()
    assert main(["validate", "-p", str(store)]) == 0
    files, out = str(tmp_path / "files"), str(tmp_path / "out")
    assert main(["seed", "-o", files, "-c", "40", "-v"]) == 0
    capsys.readouterr()
    assert main(["count", files, "--progress"]) == 0 and capsys.readouterr().out.strip().endswith("40")
    assert main(["convert", "-i", files, "-o", out, "-s", "5", "-t", "2", "-v"]) == 0
    assert main(["validate", "-p", out]) == 0 and main(["snapshot", out, "live/"]) == 0
    assert main(["convert", "-i", files, "-o", out + "2", "--legacy"]) == 0 and os.listdir(out + "2/data")
    assert main(["convert", "-i", files, "-o", files + "/x"]) == 2


def test_zip_tree_and_buckets(spark, tmp_path):
    for f, t in (("in/a.txt", "a"), ("in/sub/b.txt", "b"), ("in/old.zip", "z")):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text(t)
    files = catalog.scan_files(spark, str(tmp_path / "in"))
    for recursive, want in ((True, ["a.txt", "sub/b.txt"]), (False, ["a.txt"])):
        archives.zip_tree(files, str(tmp_path / "out"), recursive=recursive).collect()
        with zipfile.ZipFile(tmp_path / "out/files.zip") as z:
            assert z.namelist() == want
    assert names(archives.read_archives(spark, str(tmp_path / "out"), contents=False), "member", "size", "content") == [("a.txt", 1, None)]
    with pytest.raises(errors.NotAnArchive):
        archives.read_archive(spark, str(tmp_path / "in/a.txt"))
    blobs = spark.range(40).select(F.concat(F.lit("7-00000-"), F.sha2(F.col("id").cast("string"), 256)).alias("target"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    made = convert.pack_buckets(blobs, str(tmp_path / "packed"), most=20).collect()
    assert len(made) > 2 and sum(r.members for r in made) == 40
    assert archives.read_archives(spark, str(tmp_path / "packed")).select("member").distinct().count() == 40


def test_byte_ranges(spark):
    d = spark.createDataFrame([(b"hello", b"XY", at, size) for at, size in ((0, 3), (1, 5), (4, 7), (5, 0), (7, 1))], "c binary, d binary, at int, size int")
    for r in d.select("*", ranges.written(F.col("c"), F.col("d"), F.col("at")).alias("w"), ranges.truncated(F.col("c"), F.col("size")).alias("t")).collect():
        whole = bytearray(bytes(r.c).ljust(r.at, b"\0"))
        whole[r.at : r.at + 2] = b"XY"
        assert bytes(r.w) == bytes(whole) and bytes(r.t) == bytes(r.c)[: r.size].ljust(r.size, b"\0")


def test_registry_errors(spark):
    r = spark.createDataFrame([(5, "a")], "inode bigint, name string")
    assert stats.name_of(r, 5) == "a" and stats.registry_size(r).first().size == 1
    with pytest.raises(errors.IdNotFound):
        stats.name_of(r, 6)


def test_altered_gives_each_entry_once_whatever_its_copies(spark):
    whole = F.lit(b"whole")
    target = hashing.target(F.sha2(whole, 256))
    rows = spark.range(300).select(F.lit("z").alias("archive"), F.col("id").alias("pos"), F.lit("a").alias("name"), F.when(F.col("id") == 7, "").otherwise(target).alias("target"))
    e = rows.unionByName(rows.where("pos < 5").withColumn("archive", F.lit("y")))
    held = spark.range(200).select(F.lit("z").alias("archive"), target.alias("member"), F.when(F.col("id") % 2 == 0, F.encode(F.col("id").cast("string"), "UTF-8")).otherwise(whole).alias("content"))
    held = held.unionByName(spark.range(3).select(F.lit("y").alias("archive"), target.alias("member"), whole.alias("content")))
    assert names(validation.altered(e, held), "archive", "pos") == [("z", i) for i in range(300) if i != 7]
    assert validation.altered(e, held.where("archive = 'y'")).count() == 0
