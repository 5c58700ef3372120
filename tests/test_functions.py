"""Hashes, ids, JSON, names, platforms, scanning and rewriting."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.functions import canonical, hashing, ids, names, scan

#: Published ids of the demo's blobs, and of the hash itself for i % 251 inputs.
GOLDEN = {
    b"blob:foobarbaz": "9fcb43efcfdcc0cffb5bb2c2b386c0e75c1d9e01321b0f62f2bf907ec6557f60",
    b"blob:fn main() {}": "ab4db9898d125eb5f4b396fefd45b32fdb5a663e16855bcff29b9e18dc0f6f2f",
    b'exec:echo "hi"': "ca290b71a756a43da3eaedcab8afbbe594af6f25dd696ce877c5ceb3fe24c892",
    b"": "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    bytes(i % 251 for i in range(1024)): "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    bytes(i % 251 for i in range(1025)): "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
}


def _slow(data: bytes) -> str:
    """BLAKE3 with plain numbers, after its specification."""
    iv = [0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19]
    order, mask = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8], 0xFFFFFFFF
    turn = lambda x, n: (x >> n | x << (32 - n)) & mask

    def compress(cv, block, counter, size, flags):
        m = [int.from_bytes(block.ljust(64, b"\0")[i : i + 4], "little") for i in range(0, 64, 4)]
        v = cv[:] + iv[:4] + [counter & mask, counter >> 32, size, flags]

        def g(a, b, c, d, x, y):
            v[a] = (v[a] + v[b] + x) & mask
            v[d] = turn(v[d] ^ v[a], 16)
            v[c] = (v[c] + v[d]) & mask
            v[b] = turn(v[b] ^ v[c], 12)
            v[a] = (v[a] + v[b] + y) & mask
            v[d] = turn(v[d] ^ v[a], 8)
            v[c] = (v[c] + v[d]) & mask
            v[b] = turn(v[b] ^ v[c], 7)

        for _ in range(7):
            for i, (a, b, c, d) in enumerate([(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]):
                g(a, b, c, d, m[2 * i], m[2 * i + 1])
            m = [m[i] for i in order]
        return [v[i] ^ v[i + 8] for i in range(8)]

    def node(part, first, root):
        if len(part) <= 1024:
            cv = iv[:]
            blocks = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
            for i, b in enumerate(blocks):
                end = i == len(blocks) - 1
                cv = compress(cv, b, first, len(b), (i == 0) | 2 * end | 8 * (end and root))
            return cv
        left = 1024
        while left * 2 < len(part):
            left *= 2
        both = node(part[:left], first, False) + node(part[left:], first + left // 1024, False)
        return compress(iv[:], b"".join(x.to_bytes(4, "little") for x in both), 0, 64, 4 | 8 * root)

    return b"".join(x.to_bytes(4, "little") for x in node(data, 0, True)).hex()


def test_blake3():
    assert hashing.blake3_many(list(GOLDEN)) == list(GOLDEN.values())
    r = random.Random(3)
    values = [r.randbytes(n) for n in (1, 63, 64, 65, 2047, 2048, 2049, 3072, 3073, 5000, 9217, 40000)]
    assert hashing.blake3_many(values) == [_slow(v) for v in values]
    assert hashing.blake3_many([]) == []


def test_ids(spark):
    rows = spark.createDataFrame([(bytearray(b"foobarbaz"), False), (bytearray(b'echo "hi"'), True), (None, False)], "content binary, x boolean")
    found = [r[0] for r in rows.select(hashing.blob_id(F.col("content"), F.col("x"))).collect()]
    assert found == [GOLDEN[b"blob:foobarbaz"], GOLDEN[b'exec:echo "hi"'], None]
    upper = "AB" * 32
    row = spark.range(1).select(ids.parse_id(F.lit(upper)), ids.is_id(F.lit(upper[1:])), ids.object_path(F.lit(upper.lower()), F.lit("pkg")), ids.from_bytes(ids.to_bytes(F.lit(upper)))).first()
    assert tuple(row) == ("ab" * 32, False, f"ab/{'ab' * 31}.pkg", "ab" * 32)
    for bad in (ids.parse_id(F.lit("xyz")), ids.kind_rank(F.lit("file"))):
        with pytest.raises(Exception, match="not an object id|unknown object kind"):
            spark.range(1).select(bad).collect()
    assert [tuple(r) for r in ids.kinds(spark).collect()] == [("blob", 0), ("tree", 1), ("pkg", 2), ("spec", 3)]


def test_trees_and_packages(spark):
    txt, rs, sh = (GOLDEN[k] for k in (b"blob:foobarbaz", b"blob:fn main() {}", b'exec:echo "hi"'))
    sub = "dc0675565eada2f4d0df31f5a7d8c0c06c256decd6404ba3eee560686374332f"
    main = "48642aa3b535c3d2b8223b4ae8b0f9a62f1d5f1c769d136cb0da301264649603"
    data = [({"main.rs": ("Blob", rs, None)},), ({"src": ("Tree", sub, None), "foo.txt": ("Blob", txt, None), "baz.rs": ("Symlink", None, "./src/main.rs"), "bar.sh": ("Blob", sh, None)},), ({},)]
    trees = spark.createDataFrame(data, canonical.TREE)
    json = canonical.tree_json(F.col("entries"))
    found = trees.select(hashing.meta_id("tree", json).alias("id"), json.alias("json")).collect()
    assert [r["id"] for r in found[:2]] == [sub, main]
    assert [len(r["json"]) for r in found] == [111, 355, 14]
    packages = spark.createDataFrame([("foo", [], main), ("bar", ["db1d711c31e724dae692a4f1c7c9ec92f6e888232ded1c82409624aa052eb1d3"], sub)], "name string, references array<string>, tree string")
    row = {"name": F.col("name"), "system": F.lit("x86_64-linux-gnu"), "references": F.col("references"), "self_references": F.create_map().cast("map<string,array<bigint>>"), "tree": F.col("tree")}
    got = [r[0] for r in packages.select(hashing.meta_id("pkg", canonical.package_json(row))).collect()]
    assert got == ["db1d711c31e724dae692a4f1c7c9ec92f6e888232ded1c82409624aa052eb1d3", "42d38453bc26b794b974d63f2b4930d01a6ff0ddf0d792fe13faa766edb1bb5c"]


def test_json_escapes_and_nulls(spark):
    row = {n: F.lit(None).cast("string") for n in ("name", "version", "description", "license", "target")} | {n: F.array().cast("array<string>") for n in ("dependencies", "build_dependencies")}
    text = spark.range(1).select(canonical.spec_json(row | {"builder": F.lit('a\x1f\n"\\u001F/é')})).first()[0]
    assert text.endswith('"dependencies":[],"build_dependencies":[],"builder":"a\\u001f\\n\\"\\\\u001F/é"}')
    assert text.startswith('{"name":null,"version":null,')


def test_names_and_platforms(spark):
    good = ["hello-1.0.0", "a" * 191, "A_b?c=d+e"]
    bad = ["", ".hidden", "a b", "a" * 192, "é", "a/b"]
    rows = spark.createDataFrame([(x,) for x in [*good, *bad]], "n string")
    assert [r[0] for r in rows.select(names.is_name(F.col("n"))).collect()] == [True] * 3 + [False] * 6
    h = "58f16e6023968d08d72b0554e8310f073365a0a62ab33bc9052d1f7a5510035b"
    name, id_ = names.install_parts(F.lit(f"hello-1.0.0-{h}"))
    assert tuple(spark.range(1).select(name, id_).first()) == ("hello-1.0.0", h)
    cases = {f"{a}-{o}": f"{a}-{o}" for a in ("i686", "x86_64") for o in ("darwin", "linux-gnu", "linux-musl")} | {"x86_64-linux": None, "arm-darwin": None, "x86_64-darwin-x": "x86_64-darwin", "": None, "x86_64": None}
    rows = spark.createDataFrame([(x,) for x in cases], "p string")
    assert [r[0] for r in rows.select(names.platform(F.col("p"))).collect()] == list(cases.values())
    assert spark.range(1).select(names.platform(F.lit(names.host()))).first()[0] == names.host()
    kinds = spark.createDataFrame([(bytearray(b"\x7fELF.."),), (bytearray(b"\xcf\xfa\xed\xfe"),), (bytearray(b"#!"),)], "c binary")
    assert [r[0] for r in kinds.select(names.file_kind(F.col("c"))).collect()] == ["elf", "macho", "other"]
    v = spark.range(1).select(names.version_parts(F.lit("1.20.3-rc.1+b")), names.version_parts(F.lit("01.2.3"))).first()
    assert tuple(v[0]) == (1, 20, 3, "rc.1", "b") and v[1] is None
    with pytest.raises(Exception, match="period"):
        spark.range(1).select(names.parse_name(F.lit(".x"))).collect()


def test_references(spark):
    a, b, c = ("%064x" % n for n in (11, 12, 13))
    cases = [(f"see pkg-{a}.", [a]), (f"x-{a}-{b}", [a]), (f"/-{a}", []), (f"x-{a[1:]}", []), (f"x-{'AB' * 32}", ["ab" * 32]), (f"q-{c}ffff q-{a} r?-{b}", [a, b, c]), ("", []), (None, None)]
    rows = spark.createDataFrame(cases, "t string, want array<string>")
    got = rows.select(scan.references(F.col("t")), scan.binary_references(F.encode("t", "utf-8"))).collect()
    assert [r[0] for r in got] == [x for _, x in cases] == [r[1] for r in got]
    raw = spark.createDataFrame([(bytearray(b"\xff\x00n-" + a.encode() + b"\xfe"),)], "c binary")
    assert raw.select(scan.binary_references(F.col("c"))).first()[0] == [a]


def test_rewrite(spark):
    cases = [(b"PATTERNyyPATTERN", b"rep////yyrep////", [0, 9]), (b"xxPATTERNyyPATTERN", b"xxrep////yyrep////", [2, 11]), (b"xxxxxxxxxPATTERNyyyyPATTERN", b"xxxxxxxxxrep////yyyyrep////", [9, 20]), (b"", b"", [])]
    rows = spark.createDataFrame([(bytearray(x),) for x, _, _ in cases], "c binary")
    got = rows.select(scan.rewrite(F.col("c"), "PATTERN", "rep").alias("r")).select("r.*", scan.write_at(F.col("r.content"), F.col("r.offsets"), F.lit("PATTERN")).alias("back")).collect()
    assert [(bytes(r["content"]), r["offsets"]) for r in got] == [(y, z) for _, y, z in cases]
    assert [bytes(r["back"]) for r in got] == [x for x, _, _ in cases]
    with pytest.raises(ValueError, match="longer"):
        scan.rewritten(b"abc", b"b", b"cc")
