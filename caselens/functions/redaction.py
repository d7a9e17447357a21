"""Redaction of columns: drop, mask, partial, ip prefix, keyed hash."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import let
from .semantic import V4, trimmed

DEFAULT_MASK = "[REDACTED]"


@dataclass(frozen=True)
class Rule:
    """How one column is rewritten; ``method`` is drop, mask, partial, ip_prefix or hmac."""

    column: str
    method: str
    text: str = DEFAULT_MASK
    keep: int = 3
    bits: int = 24
    length: int = 16

    def manifest(self, index: int, key: bytes | None) -> dict:
        extra = {
            "mask": {"replacement": self.text}, "partial": {"keep": self.keep}, "ip_prefix": {"bits": self.bits},
            "hmac": {"length": self.length, "key_fingerprint": fingerprint(key or b"")},
        }.get(self.method, {})
        return {"column": index, "name": self.column, "method": self.method, **extra}


def parse_rule(spec: str) -> Rule:
    """A rule from ``COL=METHOD[:PARAM]``."""
    column, found, how = spec.rpartition("=") if spec.count("=") == 1 else spec.partition("=")
    if not found or not column:
        raise ValueError(f"redaction {spec!r} is not COL=METHOD")
    method, given, parameter = how.partition(":")
    try:
        if method == "drop":
            return Rule(column, "drop")
        if method == "mask":
            return Rule(column, "mask", text=parameter if given else DEFAULT_MASK)
        if method == "partial":
            return Rule(column, "partial", keep=int(parameter) if given else 3)
        if method == "ip":
            return Rule(column, "ip_prefix", bits=int(parameter) if given else 24)
        if method == "hmac":
            return Rule(column, "hmac", length=int(parameter) if given else 16)
    except ValueError as error:
        raise ValueError(f"redaction {spec!r}: {parameter!r} is not a number") from error
    raise ValueError(f"redaction {spec!r}: unknown method {method!r}")


def check(rules: list[Rule], key: bytes | None) -> None:
    """Raises ValueError for rules that can't be applied."""
    seen: set[str] = set()
    for rule in rules:
        if rule.column in seen:
            raise ValueError(f"column {rule.column!r} has two redaction rules")
        seen.add(rule.column)
        if rule.method == "hmac":
            if not key:
                raise ValueError(f"column {rule.column!r}: hmac needs a key that is not empty")
            if not 1 <= rule.length <= 64:
                raise ValueError(f"column {rule.column!r}: hmac length must be 1..=64")
        if rule.method == "ip_prefix" and not 0 <= rule.bits <= 128:
            raise ValueError(f"column {rule.column!r}: prefix bits must be 0..=128")


def fingerprint(key: bytes) -> str:
    """What a manifest says of a key."""
    return hashlib.sha256(key).hexdigest()[:16]


def mask(column: Column, text: str = DEFAULT_MASK) -> Column:
    return F.lit(text)


def partial(column: Column, keep: int = 3) -> Column:
    """The first characters, the others as stars."""
    return F.concat(F.substring(column, 1, keep), F.repeat(F.lit("*"), F.greatest(F.length(column) - keep, F.lit(0))))


def _octets(value: Column) -> Column:
    """Dotted quad of an unsigned 32-bit number."""
    return F.concat_ws(".", *(F.shiftright(value, 8 * (3 - k)).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for k in range(4)))


def _quad(text: Column) -> Column:
    """Number of a dotted quad."""
    parts = F.split(text, r"\.")
    return sum((F.coalesce(parts[k].try_cast("bigint"), F.lit(0)) * (1 << 8 * (3 - k)) for k in range(4)), F.lit(0).cast("bigint"))


def _plain(text: Column) -> Column:
    """An IPv6 address whose quad at the end, if any, is written as two groups."""
    low = F.lit(65535).cast("bigint")
    words = lambda n: F.concat_ws(":", F.lower(F.hex(F.shiftright(n, 16))), F.lower(F.hex(n.bitwiseAND(low))))
    tail = F.substring_index(text, ":", -1)
    whole = F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail)), let(let(tail, _quad), words))
    return F.when(tail.rlike(rf"\A{V4}\z"), whole).otherwise(text)


def _parts(plain: Column) -> Column:
    """The eight groups of an IPv6 address; null for other texts."""
    some = r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?"
    side = lambda k: F.filter(F.split(F.substring_index(plain, "::", k), ":"), lambda x: x != "")
    gap = let(F.struct(side(1).alias("a"), side(-1).alias("b")), lambda s: F.when(F.size(s["a"]) + F.size(s["b"]) <= 7, F.concat(s["a"], F.array_repeat(F.lit("0"), F.lit(8) - F.size(s["a"]) - F.size(s["b"])), s["b"])))
    return F.when(plain.rlike(r"\A(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\z"), F.split(plain, ":")).when(plain.rlike(rf"\A{some}::{some}\z"), gap)


def _short(text: Column) -> Column:
    """Eight groups with the first longest run of zero groups cut out."""
    out = text
    for n in range(2, 9):  # the longest run is tried first
        run = rf"\A((?:[0-9a-f]+:)*?)0(?::0){{{n - 1}}}((?::[0-9a-f]+)*)\z"
        cut = F.concat(F.regexp_replace(F.regexp_extract(text, run, 1), ":\\z", ""), F.lit("::"), F.regexp_replace(F.regexp_extract(text, run, 2), "\\A:", ""))
        out = F.when(text.rlike(run), cut).otherwise(out)
    return out


def _six(groups: Column) -> Column:
    """An IPv6 address as text: lower case, zeros shortened, mapped IPv4 as a quad."""
    text = F.concat_ws(":", F.transform(groups, lambda x: F.lower(F.hex(x))))
    mapped = F.concat(F.lit("::ffff:"), let(groups[6] * 65536 + groups[7], _octets))
    return let(text, lambda t: F.when(t.rlike(r"\A(?:0:){5}ffff:"), mapped).otherwise(_short(t)))


def ip_prefix(column: Column, bits: int = 24) -> Column:
    """The network of an address, IPv4 or IPv6; anything else masked."""
    return let(trimmed(column), lambda text: _network(text, bits))


def _network(text: Column, bits: int) -> Column:
    kept = _quad(text).bitwiseAND(F.lit((0xFFFFFFFF << 32 - min(bits, 32)) & 0xFFFFFFFF).cast("bigint"))
    masks = [(0xFFFF << 16 - min(16, max(0, bits - 16 * k))) & 0xFFFF for k in range(8)]
    number = lambda x, m: F.conv(x, 16, 10).cast("bigint").bitwiseAND(m)
    network = F.zip_with(let(_plain(text), _parts), F.array(*(F.lit(m).cast("bigint") for m in masks)), number)
    wide = F.when(text.contains(":"), let(network, lambda g: F.when(g.isNotNull(), _six(g))))
    return F.when(text.rlike(rf"\A{V4}\z"), let(kept, _octets)).otherwise(F.coalesce(wide, F.lit(DEFAULT_MASK)))


def hmac_sha256(column: Column, key: bytes, length: int = 16) -> Column:
    """First hex digits of HMAC-SHA256, from two nested digests, so nothing leaves the JVM.

    The pads derived from the key are literals of the plan: keep plans and event logs to yourself.
    """
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(column, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(F.lit(outer), first), 256), 1, length)


def redact(column: Column, rule: Rule, key: bytes | None = None) -> Column:
    """The rewritten column; empty and missing values stay as they are."""
    column = column.cast("string")
    if rule.method == "mask":
        new = mask(column, rule.text)
    elif rule.method == "partial":
        new = partial(column, rule.keep)
    elif rule.method == "ip_prefix":
        new = ip_prefix(column, rule.bits)
    elif rule.method == "hmac":
        new = hmac_sha256(column, key or b"", rule.length)
    else:
        raise ValueError(f"{rule.method} rewrites no column")
    return F.when(column != "", new).otherwise(column)
