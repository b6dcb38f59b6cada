"""Addresses, longest prefixes, MaxMind DB files and URL references, against Python's own ipaddress and the RFC's examples."""

import ipaddress
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from newsloom.functions.addresses import address, network, resolve_url
from newsloom.operators.networks import locate_longest, networks_of
from newsloom.sources import mmdb


def number(ip):
    at = ipaddress.ip_address(ip)
    if at.version == 6 and at.ipv4_mapped:
        at = at.ipv4_mapped
    return int(at)


def unsigned(hi, lo):
    return (hi % (1 << 64)) << 64 | lo % (1 << 64)


ADDRESSES = """1.2.3.4 0.0.0.0 255.255.255.255 256.1.1.1 1.2.3 1.2.3.4.5 01.2.3.4 :: ::1 1:: 2001:db8::1 2001:DB8:0:0:8:800:200C:417A ::ffff:1.2.3.4 ::1.2.3.4 ::ffff:102:304
1:2:3:4:5:6:7:8 1:2:3:4:5:6:7 1:2:3:4:5:6:7:8:9 1::2::3 1:::2 12345::1 fe80::1%eth0 ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff 1:2:3:4:5:6:7:: ::2:3:4:5:6:7:8 1:2:3:4::5:6:7:8 :1:2:3:4:5:6:7:8
1:2:3:4:5:6:1.2.3.4 1:2:3:4:5:6:7:1.2.3.4 g::1 x 64:ff9b::192.0.2.33 ::1.2.3.256 8000:: 1:2:3:4:5:6:7:""".split() + [" 1.2.3.4 ", "", None]


def test_addresses(spark):
    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string")
    for r in rows.withColumn("a", address("ip")).collect():
        try:
            true = None if "%" in (r.ip or "") else number((r.ip or "").strip())
        except ValueError:
            true = None
        assert (None if r.a is None else unsigned(r.a.hi, r.a.lo)) == true, r.ip


def test_networks(spark):
    rows = spark.createDataFrame([(t,) for t in ("10.1.2.3/8", "10.1.2.3", "::/0", "2001:db8:ffff::/33", "1.2.3.4/33", "::1/129", "1.2.3.4/x", "x/3", "0.0.0.0/0", None)], "t string")
    found = {r.t: (r.n and (unsigned(r.n.hi, r.n.lo), r.n.length)) for r in rows.withColumn("n", network("t")).collect()}
    assert found == {"10.1.2.3/8": (10 << 24, 104), "10.1.2.3": (number("10.1.2.3"), 128), "::/0": (0, 0), "2001:db8:ffff::/33": (number("2001:db8:8000::"), 33), "1.2.3.4/33": None,
                     "::1/129": None, "1.2.3.4/x": None, "x/3": None, "0.0.0.0/0": (0, 96), None: None}


def test_longest(spark):
    rng = random.Random(2)
    nets, addresses = [], []
    for k in range(120):
        if rng.random() < 0.5:
            nets.append((f"10.{rng.randint(0, 3)}.{rng.randint(0, 3)}.{rng.randint(0, 255)}/{rng.choice([0, 8, 14, 16, 22, 24, 31, 32])}", k, "x"))
        else:
            nets.append((f"2001:db8:{rng.randint(0, 3):x}::{rng.randint(0, 3):x}/{rng.choice([0, 16, 32, 46, 48, 64, 65, 120, 126, 128])}", k, "x"))
    for _ in range(300):
        addresses.append(rng.choice([f"10.{rng.randint(0, 4)}.{rng.randint(0, 3)}.{rng.randint(0, 255)}", f"2001:db8:{rng.randint(0, 4):x}::{rng.randint(0, 3):x}", f"::ffff:10.0.0.{rng.randint(0, 3)}", "9.9.9.9", "bad", None]))
    asked = spark.createDataFrame([(i, a, "old") for i, a in enumerate(addresses)], "i int, ip string, country string")
    wide = [(ipaddress.ip_network(t, strict=False), k) for t, k, _ in nets]
    wide = [(int(n.network_address), n.prefixlen + 96 * (n.version == 4), k) for n, k in wide]

    def best(a):
        try:
            x = number(a)
        except ValueError:
            return None
        hit = [(length, -k) for at, length, k in wide if x >> 128 - length == at >> 128 - length]
        return -max(hit)[1] if hit else None

    table = networks_of(spark.createDataFrame(nets, "network string, asn int, country string"))
    found = locate_longest(asked, table).collect()
    assert {r.i: r.asn for r in found} == {i: best(a) for i, a in enumerate(addresses)} and found[0].asDict().keys() == {"i", "ip", "asn", "country"}
    assert locate_longest(asked.limit(0), table).count() == 0
    assert {r.asn for r in locate_longest(asked, table.limit(0)).collect()} == {None}


def write_mmdb(entries, size, version):
    """A file of networks ((bits, length) -> record) with a search tree of such records, as the format describes."""
    data, places = bytearray(), {}

    def put(value):
        def head(kind, n):
            first = (n if n < 29 else 29) | (kind << 5 if kind < 8 else 0)
            return bytes([first]) + (bytes([kind - 7]) if kind >= 8 else b"") + (bytes([n - 29]) if n >= 29 else b"")

        if isinstance(value, bool):
            return head(14, int(value))
        if isinstance(value, dict):
            return head(7, len(value)) + b"".join(put(k) + put(v) for k, v in value.items())
        if isinstance(value, list):
            return head(11, len(value)) + b"".join(map(put, value))
        if isinstance(value, str):
            raw = value.encode()
            return head(2, len(raw)) + raw
        if isinstance(value, float):
            return head(3, 8) + struct.pack(">d", value)
        raw = value.to_bytes((value.bit_length() + 7) // 8, "big")
        return head(9 if len(raw) > 4 else 6, len(raw)) + raw

    tree = [[None, None]]
    width = 128 if version == 6 else 32
    for (bits, length), record in sorted(entries.items(), key=lambda e: e[0][1]):
        key = json.dumps(record)
        if key not in places:
            places[key] = len(data)
            data += put(record)
        node = 0
        for d in range(length):
            bit = bits >> width - 1 - d & 1
            if d == length - 1:
                tree[node][bit] = ("data", places[key])
            else:
                old = tree[node][bit]
                if not isinstance(old, int):
                    tree.append([old, old])
                    tree[node][bit] = len(tree) - 1
                node = tree[node][bit]
    n = len(tree)
    value = lambda x: n if x is None else x if isinstance(x, int) else n + 16 + x[1]
    raw = bytearray()
    for left, right in tree:
        a, b = value(left), value(right)
        if size == 28:
            raw += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([a >> 24 << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big")
        else:
            raw += a.to_bytes(size // 8, "big") + b.to_bytes(size // 8, "big")
    return bytes(raw) + bytes(16) + bytes(data) + mmdb.MARK + put({"node_count": n, "record_size": size, "ip_version": version, "database_type": "Test"})


def country(code, name, **more):
    return {"country": {"iso_code": code, "names": {"en": name, "it": "x" * 40}}, **more}


@pytest.mark.parametrize(("size", "version"), [(24, 6), (28, 6), (32, 6), (24, 4)])
def test_mmdb(spark, tmp_path, size, version):
    rng = random.Random(size)
    entries = {}
    for k in range(60):  # nested ones come out as what is left of them
        if version == 4 or rng.random() < 0.6:
            length = rng.choice([12, 16, 20, 24, 31])
            at = (10 << 24 | rng.getrandbits(20)) >> 32 - length << 32 - length
            entries[at, length + (96 if version == 6 else 0)] = country(f"C{k % 7}", f"Land {k % 7}", n=k, big=k << 40, f=0.5 + k, ok=True, list=[k, "é"])
        else:
            length = rng.choice([33, 48, 60])
            at = (0x2001 << 112 | rng.getrandbits(60) << 50) >> 128 - length << 128 - length
            entries[at, length] = {"registered_country": {"iso_code": f"R{k % 3}"}, "n": k} if k % 2 else country("C1", "Land 1", n=k)
    path = tmp_path / "x.mmdb"
    path.write_bytes(write_mmdb(entries, size, version))
    rows = mmdb.read_mmdb(spark, str(path)).collect()
    # every address of a network has the record of the longest entry that holds it
    shift = 0 if version == 6 else 96
    for r in rows:
        at = unsigned(r.hi, r.lo)
        holding = [(n, rec) for (bits, n), rec in entries.items() if at >> 128 - n - shift == bits >> (128 - shift) - n]
        assert json.loads(r.record) == max(holding, key=lambda h: h[0])[1]
    covered = sorted((unsigned(r.hi, r.lo), 1 << 128 - r.length) for r in rows)
    assert all(a + size_a <= b for (a, size_a), (b, _) in zip(covered, covered[1:], strict=False))
    outer = [(bits, n) for bits, n in entries if not any(m < n and bits >> (128 - shift) - m == b >> (128 - shift) - m for b, m in entries)]
    assert sum(s for _, s in covered) == sum(1 << 128 - shift - n for _, n in outer)
    listed = [(r.code, r.name) for r in mmdb.countries(mmdb.read_mmdb(spark, str(path))).collect()]
    assert listed == sorted(listed, key=lambda c: (c[1], c[0])) and ("C1", "Land 1") in listed


def test_large_mmdb_in_one_task(spark, tmp_path, monkeypatch):
    path = tmp_path / "x.mmdb"
    path.write_bytes(write_mmdb({(10 << 24, 104): country("IT", "Italy"), (10 << 24 | 1 << 16, 112): country("FR", "France")}, 24, 6))
    few = sorted(map(tuple, mmdb.read_mmdb(spark, str(path)).collect()))
    monkeypatch.setattr(mmdb, "BROADCAST_BYTES", 10)
    assert sorted(map(tuple, mmdb.read_mmdb(spark, str(path)).collect())) == few
    path.write_bytes(b"nothing")
    with pytest.raises(Exception, match="mark"):
        mmdb.read_mmdb(spark, str(path)).collect()


NORMAL = """g:h g:h|g http://a/b/c/g|./g http://a/b/c/g|g/ http://a/b/c/g/|/g http://a/g|//g http://g|?y http://a/b/c/d;p?y|g?y http://a/b/c/g?y|#s http://a/b/c/d;p?q#s|g#s http://a/b/c/g#s|
g?y#s http://a/b/c/g?y#s|;x http://a/b/c/;x|g;x http://a/b/c/g;x|g;x?y#s http://a/b/c/g;x?y#s| http://a/b/c/d;p?q|. http://a/b/c/|./ http://a/b/c/|.. http://a/b/|../ http://a/b/|../g http://a/b/g|
../.. http://a/|../../ http://a/|../../g http://a/g|../../../g http://a/g|../../../../g http://a/g|/./g http://a/g|/../g http://a/g|g. http://a/b/c/g.|.g http://a/b/c/.g|g.. http://a/b/c/g..|
..g http://a/b/c/..g|./../g http://a/b/g|./g/. http://a/b/c/g/|g/./h http://a/b/c/g/h|g/../h http://a/b/c/h|g;x=1/./y http://a/b/c/g;x=1/y|g;x=1/../y http://a/b/c/y|
g?y/./x http://a/b/c/g?y/./x|g?y/../x http://a/b/c/g?y/../x|g#s/./x http://a/b/c/g#s/./x|g#s/../x http://a/b/c/g#s/../x|http:g http:g"""


def test_references(spark):
    pairs = [tuple(p.lstrip("\n").split(" ")) for p in NORMAL.split("|")]
    assert len(pairs) == 42
    rows = spark.createDataFrame(pairs, "r string, t string").select("r", "t", resolve_url("r", F.lit("http://a/b/c/d;p?q")).alias("got")).collect()
    assert [(r.r, r.got) for r in rows] == [(r.r, r.t) for r in rows]
    more = [("x.png", "https://b.it", "https://b.it/x.png"), ("x", "https://b.it/a/?q#f", "https://b.it/a/x"), ("", "https://b.it/a#f", "https://b.it/a"), (None, "https://b.it", None), ("x", None, None),
            (" /x ", "https://b.it/y", "https://b.it/x")]
    rows = spark.createDataFrame(more, "r string, b string, t string").select("t", resolve_url("r", "b").alias("got")).collect()
    assert [r.got for r in rows] == [r.t for r in rows]
