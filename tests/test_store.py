"""Store, packs, builds, installs and streaming ingest."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from tarn.functions import canonical, hashing
from tarn.operators import build, graph, store, tree
from tarn.operators.store import Store
from tarn.sources import directory, pack
from tarn.streaming.ingest import event_totals, ingest


def demo(spark):
    """The demo's seven objects: rows for insert."""
    content = spark.createDataFrame([(bytearray(b"foobarbaz"), False), (bytearray(b"fn main() {}"), False), (bytearray(b'echo "hi"'), True)], "content binary, x boolean")
    blobs = store.blobs(content, executable=F.col("x"))
    ids = {bytes(r["content"]): r["id"] for r in blobs.collect()}
    rs = ids[b"fn main() {}"]
    tree_rows = lambda rows: store.metas(spark.createDataFrame(rows, canonical.TREE).select(canonical.tree_json(F.col("entries")).alias("json")), "tree")
    subs = tree_rows([({"main.rs": ("Blob", rs, None)},)] * 2)
    sub = subs.first()["id"]
    mains = tree_rows([({"src": ("Tree", sub, None), "foo.txt": ("Blob", ids[b"foobarbaz"], None), "baz.rs": ("Symlink", None, "./src/main.rs"), "bar.sh": ("Blob", ids[b'echo "hi"'], None)},)])
    main = mains.first()["id"]

    def package(name, refs, of):
        row = {"name": F.lit(name), "system": F.lit("x86_64-linux-gnu"), "references": F.array(*map(F.lit, refs)).cast("array<string>"), "self_references": F.create_map().cast("map<string,array<bigint>>"), "tree": F.lit(of)}
        return store.metas(spark.range(1).select(canonical.package_json(row).alias("json")), "pkg")

    foo = package("foo", [], main)
    bar = package("bar", [foo.first()["id"]], sub)
    return blobs.unionByName(subs).unionByName(mains), foo, bar


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    with pytest.raises(FileNotFoundError):
        Store.open(spark, path)
    s = Store.init(spark, path)
    with pytest.raises(FileExistsError):
        Store.init_bare(spark, path)
    rest, foo, bar = demo(spark)
    with pytest.raises(graph.MissingObjects, match="not installed"):
        s.insert(bar)
    s.insert(rest)
    s.insert(rest)
    s.insert(foo)
    s.insert(bar.unionByName(foo))
    s = Store.open(spark, path)
    assert s.objects().count() == 7 and s.installed().count() == 2
    assert s.nodes().agg(F.sum("size")).first()[0] == 868
    assert s.verify().isEmpty()
    bar_id = bar.first()["id"]
    found = s.closure(spark.createDataFrame([(bar_id,)], "id string"))
    assert found.num_objects() == 7 and found.unpacked_size() == 868
    assert s.get_meta(bar_id, "pkg").first()["name"] == "bar"
    assert bytes(s.get_blob(hashing.blake3(b"blob:foobarbaz")).first()["content"]) == b"foobarbaz"
    for bad in (lambda: s.get(bar_id, "blob"), lambda: s.get("0" * 64)):
        with pytest.raises(graph.MissingObjects):
            bad()
    asked = spark.createDataFrame([(bar_id, "pkg"), ("0" * 64, "pkg")], "id string, kind string")
    assert s.contains(asked).count() == 1
    assert {r["id"]: r["kind"] for r in s.lookup(asked).collect()} == {bar_id: "pkg", "0" * 64: None}
    with pytest.raises(Exception, match="no such object"):
        s.sizes(asked).collect()
    # a second store, in two steps
    other = Store.init(spark, f"file://{tmp_path}/t")
    roots = spark.createDataFrame([(bar_id,)], "id string")
    first = s.copy_to(other, roots)
    assert (first.num_present, first.missing.num_objects()) == (0, 7)
    second = s.copy_to(other, roots)
    assert (second.num_present, second.missing.num_objects()) == (1, 0)
    assert other.objects().count() == 7
    # a pack, in the order of sending
    sent = graph.yield_order(found.nodes, found.edges).select("id", "kind", "group_rank", "level")
    where = f"{tmp_path}/demo.pack"
    pack.write_pack(s.objects().join(sent, ["id", "kind"]), where, ["group_rank", "level", "id"])
    assert os.path.getsize(where) == 1207
    back = pack.read_pack(spark, where)
    assert back.count() == 7 and {r["id"] for r in back.collect()} == {r["id"] for r in s.nodes().collect()}
    kinds = [x[2] for x in pack.scan(where)]
    assert kinds == ["blob"] * 3 + ["tree"] * 2 + ["pkg"] * 2
    third = Store.init(spark, f"file://{tmp_path}/u")
    third.insert(back)
    assert third.verify().isEmpty() and third.objects().count() == 7


def test_sending_and_receiving(spark, tmp_path):
    s, other = (Store.init(spark, f"file://{tmp_path}/{x}") for x in "st")
    rest, foo, bar = demo(spark)
    s.insert(rest.unionByName(foo))
    s.insert(bar)
    roots = bar.select("id")
    found = s.find_missing(other, roots)
    s.send_pack(found.missing, f"{tmp_path}/demo.pack")
    assert os.path.getsize(f"{tmp_path}/demo.pack") == 1207
    assert other.recv_pack(f"{tmp_path}/demo.pack").count() == 7
    assert other.installed().count() == 2 and other.verify().isEmpty()
    with pytest.raises(graph.MissingObjects, match="no such object"):
        Store.init(spark, f"file://{tmp_path}/u").send_pack(found.missing, f"{tmp_path}/none.pack")
    events = []
    third = Store.init(spark, f"file://{tmp_path}/v")
    assert s.copy_to(third, roots, events.append).missing.num_objects() == 7
    assert [e["event"] for e in events] == ["begin", "read"] * 7 + ["finished"]
    assert [e["kind"] for e in events if e["event"] == "begin"] == ["blob"] * 3 + ["tree"] * 2 + ["pkg"] * 2
    assert (events[-1]["bytes"], events[-1]["num_objects"], [e["seq"] for e in events]) == (868, 7, list(range(15)))
    more = []
    s.copy_to(third, roots, more.append)
    assert [e["event"] for e in more] == ["finished"]
    big = hashing.blake3(b"blob:foobarbaz")
    assert (s.read_range(big, 3, 3), s.read_range(big, 7, 9), s.read_range(big, 20, 1)) == (b"bar", b"az", b"")


def test_checked_inserts(spark, tmp_path):
    s = Store.init(spark, f"file://{tmp_path}/s")
    rows = store.blobs(spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),)], "content binary"))
    with pytest.raises(store.DamagedObjects):
        s.insert(rows.withColumn("content", F.lit(b"x")), verify=True)
    assert s.objects().count() == 0
    s.insert(rows, verify=True)
    with pytest.raises(Exception, match="unknown object kind"):
        s.insert(rows.withColumn("kind", F.lit("other")))
    assert s.objects().count() == 2


def test_decoding_checks_fields(spark):
    id_ = "a" * 64
    good = {
        "tree": '{"entries":{"x":{"type":"Blob","id":"%s"},"y":{"type":"Symlink","target":"x"}}}' % id_,
        "pkg": '{"name":"n-1.0","system":"x86_64-darwin","references":["%s"],"self_references":{"%s":[1]},"tree":"%s"}' % (id_, id_, id_),
        "spec": '{"name":"n","version":"1.0.0","description":null,"license":null,"target":"i686-linux-musl","dependencies":["%s"],"build_dependencies":[],"builder":"b"}' % id_,
    }
    bad = {
        "tree": [("Blob", "Other"), (id_, id_[1:]), ('"target":"x"', '"other":"x"')],
        "pkg": [("n-1.0", ".n"), ("x86_64-darwin", "arm"), ('["' + id_, '["b' + id_), ('{"' + id_, '{"q' + id_[1:]), ('"tree":"a', '"tree":"z')],
        "spec": [('"n"', '"a b"'), ("1.0.0", "1.0"), ("i686-linux-musl", "i686-linux"), (id_, "x"), ('"builder":"b"', '"other":1')],
    }
    for kind, text in good.items():
        rows = spark.createDataFrame([(text,), (None,)], "json string").select(canonical.decode(kind, F.col("json")).alias("f"))
        assert [r["f"] is None for r in rows.collect()] == [False, True]
        for old, new in bad[kind]:
            assert old in text
            rows = spark.createDataFrame([(text.replace(old, new, 1),)], "json string").select(canonical.decode(kind, F.col("json")).alias("f"))
            with pytest.raises(Exception, match=f"not a valid {kind}"):
                rows.collect()


def test_damaged_packs(spark, tmp_path):
    body = b"hello"
    whole = pack.MAGIC + pack.header(hashing.blake3(b"blob:hello"), "blob", False, 5) + body + pack.FOOTER
    cases = {
        "magic": b"other" + whole[5:],
        "kind": whole[:43] + b"\x09" + whole[44:],
        "short": whole[:60],
        "no end": whole[: -len(pack.FOOTER)],
        "flipped": whole.replace(body, b"hellO"),
        "more": whole + b"x",
        "huge": whole[:44] + struct.pack(">Q", 1 << 63) + whole[52:],
    }
    good = tmp_path / "good"
    good.write_bytes(whole)
    assert pack.read_pack(spark, str(good)).count() == 1
    (tmp_path / "empty").write_bytes(pack.MAGIC + pack.FOOTER)
    assert pack.read_pack(spark, str(tmp_path / "empty")).count() == 0
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="PackError|pack|header|kind byte|cut short|hashes"):
            pack.read_pack(spark, str(tmp_path / name)).collect()


def test_layout_and_progress(spark):
    rows = spark.createDataFrame([("aa", "blob", 5, 0), ("ab", "blob", 7, 1), ("b", "tree", 0, 2)], "id string, kind string, size long, pos long")
    rows = rows.withColumn("run", F.substring("id", 1, 1))
    want = {"aa": 11, "ab": 57, "b": 105}
    for salt in (None, "run"):
        assert {r["id"]: r["entry_offset"] for r in pack.layout(rows, ["id"], salt).collect()} == want
    events = pack.progress(rows, "pos")
    assert tuple(event_totals(events).first()) == (12, 3)
    assert [r["event"] for r in events.orderBy("seq").collect()] == ["begin", "read"] * 3 + ["finished"]


def test_build_and_install(spark, tmp_path):
    src = tmp_path / "out"
    (src / "bin").mkdir(parents=True)
    (src / "bin/run").write_bytes(b"#!" + str(src).encode() + b"/lib and " + str(src).encode())
    os.chmod(src / "bin/run", 0o755)
    other = "%064x" % 77
    (src / "note").write_text(f"needs dep-{other}")
    os.symlink("bin/run", src / "go")
    files = directory.scan_directory(spark, str(src))
    out_dir = os.path.realpath(src)
    with pytest.raises(ValueError, match="longer"):
        try:
            build.build_package(files, "n" * 150, "x86_64-linux-gnu", out_dir, "/p")["blobs"].collect()
        except Exception as e:  # a worker's error carries the text
            raise ValueError(str(e)) from e
    long_dir = out_dir + "/" + "x" * 90
    moved = files.withColumn("content", F.encode(F.replace(F.decode("content", "utf-8"), F.lit(out_dir), F.lit(long_dir)), "utf-8"))
    made = build.build_package(moved, "n-1", "x86_64-linux-gnu", long_dir, "/p", allowed=[other])
    package = made["package"].first()
    assert package["references"] == [other]
    assert list(package["self_references"].values()) == [[2, 2 + len(long_dir) + 9]]
    with pytest.raises(ValueError, match="not dependencies"):
        build.build_package(moved, "n-1", "x86_64-linux-gnu", long_dir, "/p", allowed=[])
    manifest = build.install_manifest(made["package"], tree.entries(made["trees"]), made["blobs"], "/p")
    base = f"/p/n-1-{package['id']}"
    assert {r["path"]: r["action"] for r in manifest.collect()} == {f"{base}/bin/run": "rewrite", f"{base}/note": "link", f"{base}/go": "symlink"}
    content = {r["path"]: r["content"] for r in build.installed_content(manifest, made["blobs"]).collect()}
    text = bytes(content[f"{base}/bin/run"]).decode()
    assert text.count(base) == 2 and len(text) == 2 + 2 * len(long_dir) + 9
    relative = build.install_manifest(made["package"], tree.entries(made["trees"]), made["blobs"])
    root = tmp_path / "root"
    assert build.materialise(build.installed_content(relative, made["blobs"]), str(root)) == 3
    run = root / f"n-1-{package['id']}/bin/run"
    assert run.stat().st_mode & 0o777 == 0o544 and run.stat().st_mtime == 0
    with pytest.raises(Exception, match="no such blob"):
        build.install_manifest(made["package"], tree.entries(made["trees"]), made["blobs"].limit(0)).collect()


def test_streaming_ingest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"a"),)], "content binary").write.parquet(f"{source}/1")
    s = Store.init(spark, f"file://{tmp_path}/s")
    stream = lambda: spark.readStream.schema("content binary").parquet(f"{source}/*")
    ingest(stream(), s, f"{tmp_path}/c").awaitTermination()
    assert s.objects().count() == 2
    spark.createDataFrame([(bytearray(b"b"),), (bytearray(b"c"),)], "content binary").write.parquet(f"{source}/2")
    ingest(stream(), s, f"{tmp_path}/c").awaitTermination()
    assert s.objects().count() == 3
    ingest(stream(), s, f"{tmp_path}/c2").awaitTermination()  # all of it again
    assert s.objects().count() == 3


def test_missing_and_report(spark):
    packages = spark.createDataFrame([("p", ["q", "r"]), ("q", [])], "id string, references array<string>")
    assert [tuple(r) for r in store.missing_references(packages, packages).collect()] == [("p", "r")]
    rows = spark.createDataFrame([("a", 3), ("a", 3), ("b", 5)], "id string, size long")
    assert tuple(store.dedup_report(rows).first()) == (3, 2, 11, 8)
    assert tuple(store.dedup_report(rows.limit(0)).first()) == (0, 0, 0, 0)


def test_manifest_holds_no_tree_or_references_in_one_row(spark):
    from tarn.plans.catalogue import QUERIES

    names = ["b", 'a"\\', "é", "a", "a\x1f"]
    entries = [("t", x, "Blob", f"{i:064x}", None) for i, x in enumerate(names)] + [("t", "go", "Symlink", None, "b"), ("u", "b", "Blob", "0" * 64, None)]
    rows = spark.createDataFrame(entries, "tree string, name string, type string, id string, target string")
    pair = F.struct("name", F.struct("type", "id", "target"))
    whole = rows.groupBy("tree").agg(F.map_from_entries(F.collect_list(pair)).alias("e")).select("tree", hashing.meta_id("tree", canonical.tree_json(F.col("e")), "sha256"))
    assert dict(tree.streamed_ids(rows).collect()) == dict(whole.collect())
    with pytest.raises(Exception, match="two of one name"):
        tree.streamed_ids(rows.unionByName(rows)).collect()
    plan = QUERIES["install_manifest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan and "map<" not in plan and "element_at" not in plan

    packages = spark.createDataFrame([("p", "n", {"1": [3], "2": [5, 9]}, "t"), ("q", "n", None, "t")], "id string, name string, self_references map<string,array<long>>, tree string")
    files = spark.createDataFrame([("t", str(i), "Blob", str(i), None) for i in range(4)], "tree_id string, name string, type string, child_id string, target string")
    found = build.install_manifest(packages, files, files.select(F.col("child_id").alias("id"))).collect()
    assert {(r["package_id"], r["blob_id"]): r["offsets"] for r in found if r["action"] == "rewrite"} == {("p", "1"): [3], ("p", "2"): [5, 9]} and len(found) == 8
