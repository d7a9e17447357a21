"""MaxMind DB files written here, read by the engine."""

from __future__ import annotations

import ipaddress
import struct

import pytest

from caselens.functions.mmdb import Database, fields_of
from caselens.operators import enrich
from caselens.operators.frames import Frame


def encode(value) -> bytes:
    def head(kind: int, size: int) -> bytes:
        extra = b""
        if size >= 285:
            size, extra = 30, (size - 285).to_bytes(2, "big")
        elif size >= 29:
            size, extra = 29, (size - 29).to_bytes(1, "big")
        return (bytes([kind << 5 | size]) if kind < 8 else bytes([size, kind - 7])) + extra

    if isinstance(value, bool):
        return head(14, int(value))
    if isinstance(value, str):
        return head(2, len(value.encode())) + value.encode()
    if isinstance(value, float):
        return head(3, 8) + struct.pack(">d", value)
    if isinstance(value, int):
        raw = value.to_bytes((value.bit_length() + 7) // 8, "big")
        return head(9 if len(raw) > 4 else 6, len(raw)) + raw
    if isinstance(value, list):
        return head(11, len(value)) + b"".join(map(encode, value))
    return head(7, len(value)) + b"".join(encode(k) + encode(v) for k, v in value.items())


def build(networks: dict[str, dict], kind: str, bits: int, version: int = 6) -> bytes:
    data, places = b"", {}
    nodes: list[list] = [[None, None]]
    for network, record in networks.items():
        net = ipaddress.ip_network(network)
        number, length = int(net.network_address), net.prefixlen
        if version == 6 and net.version == 4:
            length += 96
        width = 32 if version == 4 else 128
        key = repr(record)
        if key not in places:
            places[key] = len(data)
            data += encode(record)
        at = 0
        for k in range(length):
            side = number >> (width - 1 - k) & 1
            if k == length - 1:
                nodes[at][side] = ("data", places[key])
            else:
                if nodes[at][side] is None:
                    nodes.append([None, None])
                    nodes[at][side] = len(nodes) - 1
                at = nodes[at][side]
    n, tree = len(nodes), b""
    for pair in nodes:
        a, b = (n if x is None else n + 16 + x[1] if isinstance(x, tuple) else x for x in pair)
        if bits == 28:
            tree += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([a >> 24 << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big")
        else:
            tree += a.to_bytes(bits // 8, "big") + b.to_bytes(bits // 8, "big")
    meta = {"binary_format_major_version": 2, "node_count": n, "record_size": bits, "ip_version": version, "database_type": kind, "build_epoch": 1_790_000_000}
    return tree + bytes(16) + data + b"\xab\xcd\xefMaxMind.com" + encode(meta)


CITY = {
    "10.0.0.0/8": {"country": {"iso_code": "AA"}, "city": {"names": {"en": "Town " + "x" * 40, "de": "Stadt"}}, "location": {"latitude": 1.5}, "tags": [True, "t"]},
    "192.0.2.0/25": {"country": {"iso_code": "BB"}}, "2001:db8::/32": {"country": {"iso_code": "CC"}, "city": {"names": {"en": "Six"}}},
}


@pytest.mark.parametrize("bits", [24, 28, 32])
def test_lookup(bits):
    database = Database(build(CITY, "GeoLite2-City", bits))
    assert database.kind == "city"
    found = {a: fields_of("city", database.lookup(a)) for a in ("10.200.3.4", "192.0.2.127", "192.0.2.128", "2001:db8::9", "2001:db9::", "x", "")}
    assert found == {
        "10.200.3.4": ("AA", "Town " + "x" * 40), "192.0.2.127": ("BB", ""), "192.0.2.128": ("", ""), "2001:db8::9": ("CC", "Six"), "2001:db9::": ("", ""), "x": ("", ""), "": ("", ""),
    }
    assert database.lookup("10.0.0.1")["tags"] == [True, "t"] and database.lookup("10.0.0.1")["location"]["latitude"] == 1.5


def test_version_four_and_damage():
    raw = build({"10.0.0.0/9": {"autonomous_system_number": 64512, "autonomous_system_organization": "Org"}}, "ASN", 24, 4)
    database = Database(raw)
    assert fields_of(database.kind, database.lookup("10.1.1.1")) == ("64512", "Org") and database.lookup("::1") is None and database.lookup("10.128.0.1") is None
    with pytest.raises(ValueError):
        Database(b"nothing")


def test_enrichment(spark, tmp_path):
    (tmp_path / "c.mmdb").write_bytes(build(CITY, "City", 28))
    df = spark.createDataFrame([(0, " 10.1.2.3 "), (1, "nowhere"), (2, None), (3, "2001:db8::1")], "_ordinal long, ip string")
    rule = enrich.GeoDatabase("ip", str(tmp_path / "c.mmdb"))
    got = enrich.enrich(Frame(df, ("ip",)), [rule])
    rows = [(r["ip.country"], r["ip.city"]) for r in got.df.orderBy("_ordinal").collect()]
    assert rows == [("AA", "Town " + "x" * 40), ("", ""), ("", ""), ("CC", "Six")]
    assert rule.dataset["database_type"] == "City" and rule.dataset["built"] == "2026-09-21T14:13:20Z"
