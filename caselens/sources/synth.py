"""Synthetic evidence: seeded profiles, made by Spark from row numbers.

``narrow`` is a proxy log, ``demo`` the same with documentation addresses and
domains, ``ragged`` one with short and long rows, ``wide`` has 150 columns and
``quotes`` fields with quotes, delimiters and line ends in them.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import quoted
from ..functions.timestamps import iso
from .evidence import temporary

PROFILES = ("narrow", "wide", "quotes", "ragged", "demo")
START = 1_790_000_000
NARROW = "timestamp src_ip dst_ip dst_port proto host path status bytes user action user_agent sha256".split()
_PATHS = ("/", "/index.html", "/login", "/api/v1/items", "/api/v1/users", "/static/app.js", "/static/site.css", "/images/logo.png", "/search", "/c2/beacon")
_AGENTS = (
    "Mozilla/5.0 (X11; Linux x86_64)", "Mozilla/5.0 (Windows NT 10.0; Win64; x64)", "curl/8.5.0", "python-requests/2.32", "Go-http-client/2.0",
    'Agent "quoted", with commas, inside', "", "okhttp/4.12.0",
)


def _draw(seed: int, salt: int, n: int) -> Column:
    """A number below ``n`` from the row, the seed and a salt."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))


def _pick(index: Column, values) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _narrow(seed: int, demo: bool) -> dict[str, Column]:
    d = lambda salt, n: _draw(seed, salt, n)
    text = lambda c: c.cast("string")
    percent = d(1, 100)
    port = F.when(percent < 60, 443).when(percent < 80, 80).when(percent < 90, 8080).otherwise(1024 + d(2, 63_511))
    if demo:
        target = F.concat(_pick(d(3, 3), ("192.0.2.", "198.51.100.", "203.0.113.")), text(1 + d(4, 254)))
        domain = F.concat(F.lit("site"), text(d(5, 2000)), F.lit("."), _pick(d(5, 2000) % 3, ("example.com", "example.net", "example.org")))
    else:
        target = F.concat_ws(".", text(20 + d(3, 180)), text(d(4, 256)), text(d(6, 256)), text(1 + d(7, 254)))
        domain = F.concat(F.lit("host"), text(d(5, 2000)), F.lit("."), _pick(d(5, 2000) % 4, ("com", "net", "org", "co.uk")))
    first = d(8, 100)
    status = d(9, 100)
    return {
        "timestamp": iso(F.lit(START) + F.col("id") + d(10, 2)),
        "src_ip": F.concat_ws(".", F.lit("10"), text(d(11, 16)), text(d(12, 256)), text(1 + d(13, 254))),
        "dst_ip": target, "dst_port": text(port), "proto": F.when(d(14, 100) < 90, "tcp").otherwise("udp"),
        "host": F.concat(F.when(first < 15, "www.").when(first < 30, "cdn.").otherwise(""), domain), "path": _pick(d(15, 10), _PATHS),
        "status": text(F.when(status < 80, 200).when(status < 85, 301).when(status < 90, 403).when(status < 95, 404).otherwise(500)),
        "bytes": text(d(16, 2_000_000)), "user": F.concat(F.lit("user"), F.lpad(text(d(17, 500)), 4, "0")),
        "action": F.when(d(18, 100) < 97, "allow").otherwise("deny"),
        "user_agent": F.concat(F.lit('"'), F.replace(_pick(d(19, 8), _AGENTS), F.lit('"'), F.lit('""')), F.lit('"')),
        "sha256": F.sha2(F.concat_ws(":", F.lit(str(seed)), text(F.col("id"))), 256),
    }


def _wide(seed: int) -> dict[str, Column]:
    out = {}
    for k in range(150):
        n = _draw(seed, 100 + k, 1 << 32)
        out[f"c{k:03d}"] = [
            iso(F.lit(START) + F.col("id")), n.cast("string"), F.concat((n % 1000).cast("string"), F.lit("."), (n % 10).cast("string")),
            F.when(n % 2 == 0, "true").otherwise("false"),
            F.translate(F.substring(F.sha2(n.cast("string"), 256), 1, 11), "0123456789", "ghijklmnop"),
        ][k % 5]
    return out


def _quotes(seed: int) -> dict[str, Column]:
    kind = _draw(seed, 1, 7)
    n = F.col("id").cast("string")
    message = _pick(kind, ("plain", "a, b", 'say "hi"', "two\nlines", "two\r\nlines", "", ""))
    rendered = F.when(kind == 5, F.lit('""')).otherwise(quoted(message))
    mix = F.translate(F.substring(F.repeat(F.sha2(n, 256), 32), 1, (_draw(seed, 2, 2000)).cast("int")), "0123", ',"\n ')
    return {"id": n, "message": rendered, "note": quoted(mix)}


def table(spark: SparkSession, profile: str, rows: int, seed: int = 1) -> tuple[list[str], DataFrame]:
    """The header and one ``line`` a row, terminator included, in row order."""
    base = spark.range(rows)
    if profile == "wide":
        columns = _wide(seed)
    elif profile == "quotes":
        columns = _quotes(seed)
    elif profile in ("narrow", "demo", "ragged"):
        columns = _narrow(seed, profile == "demo")
    else:
        raise ValueError(f"unknown profile {profile!r}; there are: {', '.join(PROFILES)}")
    end = F.when(_draw(seed, 3, 2) == 0, "\n").otherwise("\r\n") if profile == "quotes" else F.lit("\n")
    line = F.concat_ws(",", *columns.values())
    if profile == "ragged":
        fate = _draw(seed, 20, 100)
        short = F.concat_ws(",", *(c for n, c in columns.items() if n != "user"))
        line = F.when(fate < 5, short).when(fate < 10, F.concat(line, F.lit(",extra"))).otherwise(line)
    return list(columns), base.select("id", F.concat(line, end).alias("line"))


def generate(spark: SparkSession, output: str | Path, profile: str = "narrow", rows: int | None = None, size: int | None = None, seed: int = 1) -> dict:
    """Writes a file of so many rows, or of about so many bytes."""
    if rows is None:
        if size is None:
            raise ValueError("either rows or a size is needed")
        _, probe = table(spark, profile, 1000, seed)
        rows = max(1, int(size / (probe.select(F.avg(F.octet_length("line"))).first()[0] or 1)))
    header, lines = table(spark, profile, rows, seed)
    part, written = temporary(output), 0
    with open(part, "wb") as f:
        written += f.write((",".join(header) + "\n").encode())
        for row in lines.select("line").toLocalIterator(prefetchPartitions=True):
            written += f.write(row.line.encode())
    os.replace(part, output)
    return {"output": str(output), "profile": profile, "seed": seed, "rows": rows, "bytes": written}
