"""Reader of MaxMind DB files, by the published file format (version 2)."""

from __future__ import annotations

import ipaddress
import struct
from functools import lru_cache

_MARKER = b"\xab\xcd\xefMaxMind.com"


class Database:
    """A database in memory; ``lookup`` gives the record of an address or None."""

    def __init__(self, raw: bytes):
        at = raw.rfind(_MARKER)
        if at < 0:
            raise ValueError("this is no MaxMind DB file")
        self.raw = raw
        meta, self._data = at + len(_MARKER), 0
        self._data = meta  # pointers in the metadata count from its own start
        self.metadata = self._value(meta)[0]
        if self.metadata.get("binary_format_major_version") != 2:
            raise ValueError("only version 2 of the format is supported")
        self.nodes, self.bits = self.metadata["node_count"], self.metadata["record_size"]
        if self.bits not in (24, 28, 32):
            raise ValueError(f"records of {self.bits} bits are not supported")
        self._data = self.nodes * self.bits // 4 + 16
        self._decoded = lru_cache(maxsize=100_000)(lambda place: self._value(place)[0])

    @property
    def kind(self) -> str:
        """asn, city or country, by the type that the database names."""
        name = self.metadata["database_type"].lower()
        return "asn" if "asn" in name else "city" if "city" in name else "country"

    def _record(self, node: int, side: int) -> int:
        width = self.bits // 4
        at = node * width
        if self.bits == 28:
            middle = self.raw[at + 3]
            if side == 0:
                return (middle & 0xF0) << 20 | int.from_bytes(self.raw[at : at + 3], "big")
            return (middle & 0x0F) << 24 | int.from_bytes(self.raw[at + 4 : at + 7], "big")
        half = width // 2
        return int.from_bytes(self.raw[at + side * half : at + (side + 1) * half], "big")

    def lookup(self, text: str):
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return None
        number, bits = int(address), address.max_prefixlen
        if self.metadata["ip_version"] == 4 and bits == 128:
            return None
        if self.metadata["ip_version"] == 6:
            bits = 128  # IPv4 addresses stand in ::/96
        node = 0
        for k in range(bits - 1, -1, -1):
            node = self._record(node, number >> k & 1)
            if node >= self.nodes:
                break
        if node <= self.nodes:
            return None
        return self._decoded(node - self.nodes - 16 + self._data)

    def _value(self, at: int) -> tuple:
        """A value of the data section and the place after it."""
        control = self.raw[at]
        kind, at = control >> 5, at + 1
        if kind == 1:
            size = (control >> 3 & 3) + 1
            given = self.raw[at : at + size]
            if size == 4:
                place = int.from_bytes(given, "big")
            else:
                place = ((control & 7) << 8 * size | int.from_bytes(given, "big")) + (0, 2048, 526_336)[size - 1]
            return self._value(self._data + place)[0], at + size
        if kind == 0:
            kind, at = self.raw[at] + 7, at + 1
        size = control & 31
        if size > 28:
            more = size - 28
            size = (29, 285, 65_821)[more - 1] + int.from_bytes(self.raw[at : at + more], "big")
            at += more
        if kind == 7:
            out = {}
            for _ in range(size):
                key, at = self._value(at)
                out[key], at = self._value(at)
            return out, at
        if kind == 11:
            items = []
            for _ in range(size):
                item, at = self._value(at)
                items.append(item)
            return items, at
        if kind == 14:
            return bool(size), at
        held, at = self.raw[at : at + size], at + size
        if kind == 2:
            return held.decode(errors="replace"), at
        if kind == 3:
            return struct.unpack(">d", held)[0], at
        if kind == 15:
            return struct.unpack(">f", held)[0], at
        if kind == 4:
            return held, at
        if kind in (5, 6, 8, 9, 10):
            number = int.from_bytes(held, "big")
            return (number - (1 << 32) if kind == 8 and size == 4 and number >> 31 else number), at
        raise ValueError(f"unknown type {kind} in the data section")


FIELDS = {"city": ["country", "city"], "country": ["country"], "asn": ["asn", "as_org"]}


def fields_of(kind: str, record) -> tuple[str, ...]:
    """The fields of a record, empty where it has none."""
    record = record or {}
    country = record.get("country", {}).get("iso_code") or ""
    if kind == "asn":
        number = record.get("autonomous_system_number")
        return ("" if number is None else str(number), record.get("autonomous_system_organization") or "")
    return (country, record.get("city", {}).get("names", {}).get("en") or "") if kind == "city" else (country,)
