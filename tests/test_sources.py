"""Readers and writers, on small files made here."""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.lines import with_offsets
from fleetlens.operators.snapshots import (
    read_container_snapshot,
    read_disk_snapshot,
    read_firewall_snapshot,
    resolve_mounts,
    with_ports,
)
from fleetlens.plans.pipelines import duplicate_scan
from fleetlens.sources.files import read_image_manifest, read_index, read_manifest, write_index
from fleetlens.sources.lines import read_lines
from fleetlens.sources.networks import cidr_table, feeds_of, read_cidr_json, read_cidr_text, write_cidr_table
from fleetlens.sources.snapshots import read_accounts, read_container_meta
from fleetlens.sources.sinks import write_lines


def test_lines_of_many_files(spark, tmp_path):
    for name in ("b.log", "a.log"):
        (tmp_path / name).write_bytes(f"{name}\r\n\n#c\r\r\nend".encode())
    lines = read_lines(spark, str(tmp_path))
    got = [(os.path.basename(r["file_path"]), r["value"], r["file_size"]) for r in
           lines.orderBy("file_path", "block_start", "seq").collect()]
    size = len(b"a.log\r\n\n#c\r\r\nend")
    assert got == [(n, v, size) for n in ("a.log", "b.log") for v in (n, "", "#c", "end")]
    assert [r["offset"] for r in with_offsets(lines).where("file_path LIKE '%a.log'").orderBy("seq").collect()] == [
        0, 7, 8, 13,
    ]


def test_write_lines_keeps_order(spark, tmp_path, lines_of):
    texts = [f"line {i % 7} {i}" for i in range(500)]
    write_lines(lines_of(texts).repartition(5), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == texts


@pytest.fixture
def tree(tmp_path):
    content = {
        "one/a.txt": b"same", "one/sub/b.txt": b"same", "one/sub/c.txt": b"diff", "one/big.bin": b"z" * 5_000_000,
        "one/.git/config": b"same", "two/.svn/x": b"same", "two/d.txt": b"same", "two/e.txt": b"long content",
        "two/empty": b"", "two/big copy.bin": b"z" * 5_000_000,
    }
    for name, data in content.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return tmp_path / "tree"


def test_duplicate_scan(spark, tree, tmp_path):
    roots = [str(tree / "one"), str(tree / "two")]
    plain = {
        ("one", "a.txt", 4), ("one", "sub/b.txt", 4), ("one", "sub/c.txt", 4), ("one", "big.bin", 5_000_000),
        ("two", "d.txt", 4), ("two", "e.txt", 12), ("two", "big copy.bin", 5_000_000),
    }
    (tree / "two/.hid").mkdir()
    (tree / "two/.hid/_x").write_bytes(b"hidden")
    for hidden, expected in [(False, plain), (True, plain | {("two", ".hid/_x", 6)})]:
        manifest = read_manifest(spark, roots, hidden).collect()
        assert {(os.path.basename(r["root"]), r["subpath"], r["size"]) for r in manifest} == expected
        assert all(abs(r["mtime"].timestamp() - os.stat(os.path.join(r["root"], r["subpath"])).st_mtime) < 1
                   for r in manifest)
    (tree / "two/link.txt").symlink_to(tree / "one/a.txt")
    (tree / "two/loop").symlink_to(tree / "two")
    now = datetime(2024, 1, 1)
    first = duplicate_scan(spark, roots, str(tmp_path / "index1"), now)
    md5 = {r["subpath"]: r["md5"] for r in first.collect()}
    assert md5["e.txt"] is None and md5[".hid/_x"] is None and "link.txt" not in md5
    assert md5["a.txt"] == md5["d.txt"] == hashlib.md5(b"same").hexdigest()
    assert md5["big.bin"] == md5["big copy.bin"] == hashlib.md5(b"z" * 5_000_000).hexdigest()

    # A marked index shows which digests are taken over; one file changes its time, one its size.
    marked = first.withColumn("md5", F.concat(F.lit("old-"), F.col("md5"))).drop("saved_at")
    write_index(marked, str(tmp_path / "index2"), now)
    os.utime(tree / "one/sub/b.txt", (1, 1))
    (tree / "one/sub/c.txt").write_bytes(b"longer now..")
    second = duplicate_scan(spark, roots, str(tmp_path / "index3"), now, str(tmp_path / "index2"))
    md5 = {r["subpath"]: r["md5"] for r in second.collect()}
    assert md5["a.txt"].startswith("old-") and md5["big.bin"].startswith("old-")
    assert md5["sub/b.txt"] == hashlib.md5(b"same").hexdigest()
    assert md5["sub/c.txt"] == hashlib.md5(b"longer now..").hexdigest()
    assert md5["e.txt"] == hashlib.md5(b"long content").hexdigest()


def test_index_version_and_roots(spark, tmp_path):
    schema = "root string, subpath string, size bigint, mtime timestamp, md5 string"
    path = str(tmp_path / "index")
    write_index(spark.createDataFrame([("/r 1", "a", 1, datetime(2024, 1, 1), "x")], schema), path, datetime(2024, 1, 2))
    write_index(spark.createDataFrame([("/r=2", "b", 2, datetime(2024, 1, 1), None)], schema), path, datetime(2024, 1, 3))
    write_index(spark.createDataFrame([("/r 1", "c", 3, datetime(2024, 1, 1), "y")], schema), path, datetime(2024, 1, 4))
    got = {(r["root"], r["subpath"], r["size"], r["md5"]) for r in read_index(spark, path).collect()}
    assert got == {("/r 1", "c", 3, "y"), ("/r=2", "b", 2, None)}
    assert read_index(spark, path, version=2).count() == 0


def test_network_feeds(spark, tmp_path):
    (tmp_path / "v4.txt").write_text("10.0.0.0/8 \n\n 20.0.0.0/8\t")
    (tmp_path / "bot.json").write_text(
        '{"creationTime": "x", "prefixes": [{"ipv6Prefix": "2001:db8::/32"}, {"ipv4Prefix": "30.0.0.0/8"}]}'
    )
    text = read_cidr_text(spark, str(tmp_path / "v4.txt"), "cloudflare")
    json = read_cidr_json(spark, str(tmp_path / "bot.json"), "google:bot")
    assert [r["cidr"] for r in text.orderBy("pos").collect()] == ["10.0.0.0/8", "20.0.0.0/8"]
    assert [r["cidr"] for r in json.orderBy("pos").collect()] == ["2001:db8::/32", "30.0.0.0/8"]
    now = datetime(2024, 1, 1, 12)
    write_cidr_table({"cloudflare": text, "google:bot": json}, str(tmp_path / "cache"), now)
    assert cidr_table(spark, str(tmp_path / "cache"), now + timedelta(seconds=86399)).count() == 4
    assert cidr_table(spark, str(tmp_path / "cache"), now + timedelta(seconds=86400)).count() == 0
    feeds = feeds_of(cidr_table(spark, str(tmp_path / "cache"), now))
    assert {g: f.count() for g, f in feeds.items()} == {
        "cloudflare": 2, "google:bot": 2, "google:ads": 0, "google:user": 0,
    }


def png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + b"\0\0\0" * width for _ in range(height))
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 2))
    (tmp_path / "b.png").write_bytes(png(10, 20))
    (tmp_path / "c.png").write_bytes(b"no image")
    images, rejects = read_image_manifest(spark, str(tmp_path))
    assert {tuple(r) for r in images.collect()} == {(3, 2, "a.png"), (10, 20, "b.png")}
    assert [tuple(r) for r in rejects.collect()] == [("c.png", "image")]


def test_accounts(spark, tmp_path):
    (tmp_path / "passwd").write_text('root:x:0:0:"The" root:/root:/bin/sh\nnobody:x:65534:65534::/:\n')
    got = [(r["username"], r["uid"], r["name"], r["shell"]) for r in read_accounts(spark, str(tmp_path / "passwd")).collect()]
    assert got == [("root", 0, '"The" root', "/bin/sh"), ("nobody", 65534, None, None)]


def test_disks_and_containers(spark, tmp_path, lines_of):
    cid, ov = "17ade7745a9c" + "0" * 52, "beef" * 16
    (tmp_path / "meta.json").write_text(
        '[{"Id": "%s", "Name": "/web", "GraphDriver": {"Data": {"MergedDir": "/var/lib/docker/overlay2/%s/merged"}}}]' % (cid, ov)
    )
    meta = read_container_meta(spark, str(tmp_path / "meta.json")).withColumn("host", F.lit("h"))
    disks = read_disk_snapshot(
        lines_of(
            ["Filesystem     Type  1M-blocks  Used Available Use% Mounted on",
             f"shm   tmpfs  64 0  64   0% /var/lib/docker/containers/{cid}/mounts/shm",
             f"overlay overlay 153844 92692 54870  63% /var/lib/docker/overlay2/{ov}/merged",
             "/dev/sda1 ext4 153844 92692 - 63% /", ""]
        )
    ).withColumn("host", F.lit("h"))
    got = {r["mount_label"]: (r["size"], r["free"]) for r in resolve_mounts(disks, meta).collect()}
    assert got == {
        "/var/lib/docker/containers/{docker:web=17ade7745a9c...}/mounts/shm": (64, 64),
        "/var/lib/docker/overlay2/{docker:web:fs=beefbeefbeef...}/merged": (153844, 54870),
        "/": (153844, None),
    }
    unmounted = resolve_mounts(disks.where("NOT mount LIKE '%containers%'"), meta)
    assert unmounted.where("mount_label <> mount").count() == 0


def test_first_lines_are_headers_without_a_pattern(spark, lines_of):
    listing = ["Dateisystem Typ ...", "/dev/sda1 ext4 10 4 6 40% /"]
    lines = lines_of(listing, "a").unionByName(lines_of(listing, "b"))
    got = read_disk_snapshot(lines, header=None)
    assert [(r["file_path"], r["mount"]) for r in got.orderBy("file_path").collect()] == [("a", "/"), ("b", "/")]


def test_container_listing(spark, lines_of):
    containers, rejects = read_container_snapshot(
        lines_of(
            ["CONTAINER ID   IMAGE     COMMAND   CREATED      STATUS        PORTS     NAMES",
             '17ade7745a9c   web:1.0   "run"     2 days ago   Up 2 hours    0.0.0.0:80->80/tcp, 53/udp, 10.0.0.1:8443->443/tcp, 0.0.0.0:443->8443/tcp   web',
             '27ade7745a9c   db:1.0    "run db"  2 days ago   Exited (0) 3 hours ago   db',
             '37ade7745a9c   db:1.0    "x"       2 days ago   Created   :::80->80/tcp   v6',
             "a single column"]
        )
    )
    good, bad = with_ports(containers)
    got = {r["name"]: (r["state"], r["status"], r["port_text"]) for r in good.collect()}
    assert got == {
        "web": ("up", "Up 2 hours", "[*]:tcp{80,443->8443}; [-]:udp{53}; [10.0.0.1]:tcp{8443->443}"),
        "db": ("exited", "Ex(0) 3 hours ago", ""),
    }
    assert [r["name"] for r in bad.collect()] == ["v6"]
    assert [r["value"] for r in rejects.collect()] == ["a single column"]


def test_firewall_listing(spark, lines_of):
    rules, chains, rejects = read_firewall_snapshot(
        lines_of(
            ["Chain INPUT (policy DROP 0 packets, 0 bytes)",
             "num   pkts bytes target     prot opt in     out     source               destination",
             "1      12K  34M ACCEPT     all  --  !eth0   *       0.0.0.0/0            !10.0.0.0/8           state NEW  tcp dpt:22",
             "2        0    0 DROP       tcp  --  *      *       0.0.0.0/0            0.0.0.0/0",
             "", "Chain EMPTY (0 references)",
             "num   pkts bytes target     prot opt in     out     source               destination", "", "stray",
             "Chain INPUT (1 references)",
             "num   pkts bytes target     prot opt in     out     source               destination", ""]
        )
    )
    got = [(r["chain"], r["num"], r["target"], r["other"]) for r in rules.orderBy("seq").collect()]
    assert got == [("INPUT", "1", "ACCEPT", "state NEW tcp dpt:22"), ("INPUT", "2", "DROP", "")]
    assert {(r["chain"], r["policy"], r["rules"]) for r in chains.collect()} == {
        ("INPUT", "(policy DROP 0 packets, 0 bytes)", 2), ("EMPTY", "(0 references)", 0), ("INPUT", "(1 references)", 0),
    }
    assert {r["table"] for r in chains.collect()} == {"filter"}
    assert [r["value"] for r in rejects.collect()] == ["stray"]


def jpeg(width, height, filler=0):
    segment = lambda kind, data: b"\xff" + bytes([kind]) + struct.pack(">H", len(data) + 2) + data
    frame = struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00"
    fill = b"".join(segment(0xE1, b"\xff\xc0" * 30_000) for _ in range(filler))
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + b"\0" * 9) + fill + b"\xff" + segment(0xC4, b"\0") + segment(0xC2, frame) + b"\xff\xd9"


def webp(kind, data):
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(data)) + b"WEBP" + kind + struct.pack("<I", len(data)) + data


IMAGES = {
    "a.png": (png(300, 2), (300, 2)),
    "b.jpg": (jpeg(640, 480), (640, 480)),
    "long head.jpeg": (jpeg(7, 9, filler=40), (7, 9)),
    "c.gif": (b"GIF89a" + struct.pack("<HH", 5, 6) + b"\0" * 20, (5, 6)),
    "d.gif": (b"GIF87a" + struct.pack("<HH", 1, 65535) + b"\0" * 20, (1, 65535)),
    "e.bmp": (b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 20, -30) + b"\0" * 30, (20, 30)),
    "old.bmp": (b"BM" + b"\0" * 12 + struct.pack("<IHH", 12, 20, 31) + b"\0" * 30, (20, 31)),
    "x.webp": (webp(b"VP8X", b"\0" * 4 + (399).to_bytes(3, "little") + (299).to_bytes(3, "little")), (400, 300)),
    "l.webp": (webp(b"VP8L", b"\x2f" + (99 | 49 << 14).to_bytes(4, "little") + b"\0" * 9), (100, 50)),
    "k.webp": (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 12, 13) + b"\0" * 9), (12, 13)),
    "cut.png": (png(300, 2)[:18], None),
    "cut.jpg": (jpeg(640, 480)[:25], None),
    "no frame.jpg": (b"\xff\xd8\xff\xda\0\0", None),
    "zero.gif": (b"GIF89a" + b"\0" * 20, None),
    "wave.webp": (b"RIFF\0\0\0\0WAVEfmt " + b"\0" * 30, None),
    "plus+sign ä%20.txt": (b"text", None),
    "nothing": (b"", None),
}


def test_image_headers_of_five_formats(spark, tmp_path):
    for name, (data, _) in IMAGES.items():
        (tmp_path / name).write_bytes(data)
    images, rejects = read_image_manifest(spark, str(tmp_path))
    assert {r["name"]: (r["width"], r["height"]) for r in images.collect()} == {n: s for n, (_, s) in IMAGES.items() if s}
    assert {r["name"] for r in rejects.collect()} == {n for n, (data, s) in IMAGES.items() if data and not s}


def test_few_bytes_of_an_image_are_read():
    from fleetlens.sources.images import image_size

    for data, size in IMAGES.values():
        asked = []
        assert image_size(lambda n, at: (asked.append(n), data[at : at + n])[1]) == size
        assert sum(asked) < 1000


def test_a_failed_write_leaves_the_index_as_it_was(spark, tmp_path):
    path = str(tmp_path / "index")
    schema = "root string, subpath string, size long, mtime timestamp, md5 string"
    day = datetime(2024, 1, 1)
    rows = [("r", f"f{i}", i, day, None) for i in range(50)] + [("other", "x", 1, day, "m")]
    write_index(spark.createDataFrame(rows, schema), path, day)
    before = sorted(map(tuple, read_index(spark, path).collect()), key=str)
    reader = read_index(spark, path)
    broken = spark.range(100).selectExpr(
        "'r' AS root", "concat('g', id) AS subpath", "if(id = 99, raise_error('killed'), id) AS size",
        "timestamp'2024-01-02' AS mtime", "cast(null AS string) AS md5",
    )
    with pytest.raises(Exception, match="killed"):
        write_index(broken, path, datetime(2024, 1, 2))
    assert sorted(map(tuple, read_index(spark, path).collect()), key=str) == before
    write_index(spark.createDataFrame([("r", "new", 1, day, None)], schema), path, datetime(2024, 1, 3))
    # A reader of the earlier index still finds its files.
    assert sorted(map(tuple, reader.collect()), key=str) == before
    assert {(r["root"], r["subpath"]) for r in read_index(spark, path).collect()} == {("r", "new"), ("other", "x")}
    for n in range(3):
        write_index(spark.createDataFrame([("r", f"n{n}", 1, day, None)], schema), path, datetime(2024, 1, 4))
    assert len(list((tmp_path / "index").glob("v-*"))) <= 3
    assert {(r["root"], r["subpath"]) for r in read_index(spark, path).collect()} == {("r", "n2"), ("other", "x")}
