"""What a value looks like: one label for each value, by regular expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import let

LABELS = (
    "empty ipv4 ipv6 ip:port mac uuid sha256 sha1 md5 email url timestamp domain boolean integer float port http_status categorical text"
).split()
#: labels that name something an analyst looks up elsewhere
INDICATORS = "ipv4 ipv6 ip:port mac sha256 sha1 md5 email url domain".split()
# Endings that look like top-level domains and mostly are file names.
FILE_ENDINGS = (
    "exe dll txt csv log json xml html htm js css png jpg jpeg gif svg ico pdf zip gz tar bin dat py rs sys ini cfg conf bat ps1 sh "
    "vbs jar doc docx xls xlsx ppt pptx tmp bak db sqlite so dylib lnk msi cab scr pem key crt yaml yml toml md rtf mp4 mp3 wav avi mov"
).split()

_Q = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
V4 = rf"{_Q}(?:\.{_Q}){{3}}"
_H = "[0-9a-fA-F]{1,4}"
_LEFT = [""] + [rf"{_H}(?::{_H}){{{k}}}" for k in range(7)]
V6 = "|".join(
    [rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{6}}{V4}"]
    + [rf"{left}::(?:{_H}(?::{_H}){{0,{6 - k}}})?" for k, left in enumerate(_LEFT[:7])]
    + [rf"{_LEFT[7]}::"]
    + [rf"{left}::(?:{_H}:){{0,{5 - k}}}{V4}" for k, left in enumerate(_LEFT[:6])]
)
_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
DOMAIN = rf"(?:{_LABEL}\.)+(?!(?i:{'|'.join(FILE_ENDINGS)})\z)[A-Za-z]{{2,63}}"
_TIMES = [
    r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)?(?:Z|[+-]\d{2}:?\d{2})?",
    r"\d{4}/\d{2}/\d{2}(?: \d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)?(?:Z|[+-]\d{2}:?\d{2})?",
    r"\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}(?: [+-]\d{4})?",
    r"[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}",
    r"\d{1,2}/\d{1,2}/\d{4}(?: \d{1,2}:\d{2}(?::\d{2})?(?: ?[AaPp][Mm])?)?",
]


def trimmed(column: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(column, F.lit(" \t\n\f\r"))


def classify(column: Column) -> Column:
    """The label of each value; null counts as empty.  The first rule that holds decides."""
    return let(trimmed(F.coalesce(column.cast("string"), F.lit(""))), _label)


def _label(v: Column) -> Column:
    """The label of a trimmed value.  A look at its size and a character or two spares most values most of the expressions."""
    size = F.octet_length(v)
    full = lambda pattern: v.rlike(rf"\A(?:{pattern})\z")
    colon = v.contains(":")
    port = F.regexp_extract(v, r":(\d{1,5})\z", 1)
    name = F.regexp_extract(v, r"@(.*)\z", 1)
    is_domain = lambda c: c.rlike(rf"\A{DOMAIN}\z") & F.octet_length(c).between(4, 253)
    rules = [
        ("empty", size == 0),
        ("text", size > 4096),
        ("ipv4", size.between(7, 15) & v.contains(".") & full(V4)),
        ("ipv6", (size <= 45) & colon & full(V6)),
        ("ip:port", colon & full(rf"(?:{V4}|\[(?:{V6})\]):\d{{1,5}}") & (port.try_cast("int") <= 65535)),
        ("mac", (size == 17) & full(r"[0-9a-fA-F]{2}([:-])(?:[0-9a-fA-F]{2}\1){4}[0-9a-fA-F]{2}")),
        ("uuid", (size == 36) & full("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")),
        ("sha256", (size == 64) & full("[0-9a-fA-F]{64}")),
        ("sha1", (size == 40) & full("[0-9a-fA-F]{40}")),
        ("md5", (size == 32) & full("[0-9a-fA-F]{32}")),
        ("integer", (size <= 20) & full(r"[-+]?\d{1,19}")),
        ("float", (size <= 64) & v.rlike("[.eE]") & full(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?") & (F.abs(v.try_cast("double")) < float("inf"))),
        ("boolean", (size <= 5) & F.lower(v).isin("true", "false", "yes", "no", "t", "f", "y", "n")),
        ("timestamp", size.between(8, 40) & v.rlike("[0-9]") & full("|".join(_TIMES))),
        ("url", v.contains("://") & full(r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^ \t\n\f\r]+")),
        ("email", v.contains("@") & full(r"[A-Za-z0-9._+-]{1,64}@[^@]+") & is_domain(name)),
        ("domain", v.contains(".") & is_domain(v)),
    ]
    out = F.when(rules[0][1], rules[0][0])
    for label, rule in rules[1:]:
        out = out.when(rule, label)
    return out.otherwise("text")
