"""Secret scans with structural confirmation.

Pattern matches (assignments, access keys, hex runs) are found in whole texts.
On top of them, candidates for encoded keys and signed tokens are decoded and
reported only if what they hold parses:

* ``pem``  - a BEGIN mark and the next END mark of its label, with a base64 body
  that is a DER key, an encrypted key, an OpenSSH key, or (with encapsulated
  headers) any base64; or a base64 run that decodes to such a block;
* ``der``  - a base64 or hex run that decodes to a DER private key: nested
  lengths must add up exactly and the members must be those of PKCS#1, PKCS#8,
  SEC1, DSA or an encrypted PKCS#8 key.  Base64 may be broken into lines of one
  length, and in a longer run a key may follow one of ``/+-_``, its own length
  (``MAX_DER`` bytes at most) telling its end;
* ``openssh`` - a base64 run, in lines or not, that decodes to the OpenSSH
  private key container with nested lengths that add up;
* ``jwt``  - a signed-token triple whose header and payload decode to JSON
  objects, with an algorithm named in the header and a signature.

Defined cases: a null text is empty and has no spans; a null id is returned as
null; repeated rows are scanned and returned each; other columns are ignored
by ``scan`` and kept as they are by ``redact``.  Offsets are code points, ends
exclusive.  Time is linear in the text; items nested deeper than ``MAX_DEPTH``
are no key.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import LOWER, Chunk, byte_table, chunks, released

KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")
ASSIGN = re.compile(rb"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
#: shortest base64 and hex runs that can hold a private key
MIN_BASE64, MIN_HEX_KEY = 40, 60
#: longest key that is looked for inside a run, and deepest nesting of its items
MAX_DER, MAX_DEPTH = 16_384, 32
PEM_MARK = re.compile(rb"-----(BEGIN|END) ([A-Z0-9 ]{0,64}PRIVATE KEY)-----")
_HEX = byte_table((0x30, 0x39), (0x61, 0x66))
_HEX_ANY = byte_table((0x30, 0x39), (0x61, 0x66), (0x41, 0x46))
_BASE64 = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), "+/-_")
_TOKEN = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), "-_")

Span = tuple[int, int, int]  # start, number of the kind, end


# -- structure ------------------------------------------------------------


def unbase64(run: bytes) -> bytes | None:
    """Bytes of a base64 or base64url run, padded or not; None if it is neither."""
    run = run.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + b"=" * (-len(run) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of the DER items that fill ``data`` exactly, or None."""
    items, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, length, i = data[i], data[i + 1], i + 2
        if length & 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or i + width > len(data):
                return None
            length, i = int.from_bytes(data[i : i + width], "big"), i + width
            if length < 0x80:  # DER takes the shortest form
                return None
        if i + length > len(data):
            return None
        items.append((tag, data[i : i + length]))
        i += length
    return items


def is_der_key(data: bytes) -> bool:
    """True for a DER private key of one of the usual containers, with all nested lengths right."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    members = der_items(outer[0][1])
    if not members or len(members) < 2 or not all(_nested(tag, content) for tag, content in members):
        return False
    tags = [tag for tag, _ in members]
    version = members[0][1] if tags[0] == 0x02 else None
    if version in (b"\x00", b"\x01") and tags[1:3] == [0x30, 0x04]:  # PKCS#8
        return _is_algorithm(members[1][1])
    if version == b"\x01" and tags[1] == 0x04:  # SEC1
        return len(members[1][1]) >= 16
    if version in (b"\x00", b"\x01") and set(tags) <= {0x02, 0x30} and tags[:6] == [0x02] * 6:  # PKCS#1 or DSA
        return len(members) >= 6 and len(members[1][1]) >= 32
    return tags == [0x30, 0x04] and _is_algorithm(members[0][1])  # encrypted PKCS#8


def _nested(tag: int, content: bytes) -> bool:
    """Integers are not empty; constructed items hold items that fill them."""
    work = [(tag, content, 0)]
    while work:
        tag, content, depth = work.pop()
        if tag == 0x02 and not content:
            return False
        if tag & 0x20:
            items = der_items(content) if depth < MAX_DEPTH else None
            if items is None:
                return False
            work += [(t, c, depth + 1) for t, c in items]
    return True


def _is_algorithm(content: bytes) -> bool:
    items = der_items(content)
    return bool(items) and items[0][0] == 0x06 and len(items[0][1]) >= 3


def is_openssh_key(data: bytes) -> bool:
    """True for an OpenSSH private key container whose nested lengths fill it."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    i = len(magic)

    def field(i: int) -> tuple[bytes, int] | None:
        if i + 4 > len(data):
            return None
        n = int.from_bytes(data[i : i + 4], "big")
        return (data[i + 4 : i + 4 + n], i + 4 + n) if i + 4 + n <= len(data) else None

    for _ in range(3):  # cipher, derivation, its options
        if not (got := field(i)):
            return False
        i = got[1]
    if i + 4 > len(data) or not 1 <= (keys := int.from_bytes(data[i : i + 4], "big")) <= 16:
        return False
    i += 4
    for _ in range(keys + 1):  # public keys, then the private section
        if not (got := field(i)) or not got[0]:
            return False
        i = got[1]
    return True


def is_signed_token(token: bytes) -> bool:
    """True if header and payload are JSON objects, the header names an algorithm and the signature decodes."""
    header, payload, signature = token.split(b".")
    try:
        head, body = json.loads(unbase64(header) or b"0"), json.loads(unbase64(payload) or b"0")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict) and len(unbase64(signature) or b"") >= 16


def pem_holds_key(label: bytes, body: bytes) -> bool:
    parts = re.split(rb"\r?\n\r?\n", body.strip(), maxsplit=1)
    encapsulated = len(parts) == 2 and b":" in parts[0]
    data = unbase64(re.sub(rb"\s+|\\[nr]", b"", parts[-1]))
    if not data:
        return False
    if encapsulated:  # the body is encrypted: nothing to parse in it
        return len(data) >= 32
    return is_openssh_key(data) if b"OPENSSH" in label else is_der_key(data)


def der_chars(run: bytes, i: int) -> int:
    """Base64 characters of a DER key that might start at ``i``, as its first items and its length tell; 0 if none can."""
    head = unbase64(run[i : i + 24])
    if not head or len(head) < 12 or head[0] != 0x30:
        return 0
    width = head[1] & 0x7F if head[1] & 0x80 else 0
    if width > 2:
        return 0
    size = 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])
    inner = head[2 + width :]
    versioned = inner[:3] in (b"\x02\x01\x00", b"\x02\x01\x01") and inner[3] in (0x02, 0x04, 0x30)
    if size > MAX_DER or not (versioned or inner[0] == 0x30):
        return 0
    chars = -(-size * 4 // 3)
    return chars if i + chars <= len(run) else 0


def pem_blocks(text: bytes) -> list[tuple[int, int]]:
    """Places of the blocks that hold a key: each BEGIN mark with the END mark that follows it."""
    out, begin = [], None
    for m in PEM_MARK.finditer(text):
        if m[1] == b"BEGIN":
            begin = m
        elif begin and begin[2] == m[2]:
            if pem_holds_key(m[2], text[begin.end() : m.start()]):
                out.append((begin.start(), m.end()))
            begin = None
    return out


def key_spans(run: bytes) -> list[tuple[str, int, int]]:
    """Kind, start and end of the keys in a base64 run."""
    if run[:4] == b"b3Bl" and (data := unbase64(run)) and is_openssh_key(data):
        return [("openssh", 0, len(run))]
    if run[:10] == b"LS0tLS1CRU" and (data := unbase64(run)) and pem_blocks(data):  # the base64 of a BEGIN mark
        return [("pem", 0, len(run))]
    if run[:1] == b"M" and (data := unbase64(run)) and is_der_key(data):  # a SEQUENCE begins so
        return [("der", 0, len(run))]
    out, upto = [], 0
    for m in re.finditer(rb"(?:^|(?<=[/+_-]))M", run):
        if m.start() >= upto and (n := der_chars(run, m.start())):
            data = unbase64(run[m.start() : m.start() + n])
            if data and is_der_key(data):
                upto = m.start() + n
                out.append(("der", m.start(), upto))
    return out


# -- spans ----------------------------------------------------------------


def _documents_with(chunk: Chunk, raw: bytes, needles: tuple[bytes, ...]) -> set[int]:
    found, off = set(), chunk.off
    for needle in needles:
        p = raw.find(needle)
        while p >= 0:
            d = int(np.searchsorted(off, p, "right")) - 1
            if p + len(needle) <= off[d + 1]:
                found.add(d)
                p = raw.find(needle, int(off[d + 1]))
            else:
                p = raw.find(needle, p + 1)
    return found


def _runs(chunk: Chunk, table: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    starts, ends, _ = chunk.words(table)
    long = np.flatnonzero(ends - starts >= least)
    docs = np.searchsorted(chunk.off, starts[long], "right") - 1
    for d, k in zip(docs.tolist(), long.tolist(), strict=True):
        base = int(chunk.off[d])
        yield d, int(starts[k]) - base, int(ends[k]) - base


def _tokens(chunk: Chunk, raw: bytes) -> Iterator[tuple[int, int, int]]:
    """Signed tokens: three runs with one dot between, the first from its first ``eyJ`` on."""
    starts, ends, at = chunk.words(_TOKEN)
    joined = np.flatnonzero((starts[1:] - ends[:-1] == 1) & (chunk.data[ends[:-1]] == 0x2E)) if len(starts) > 1 else starts[:0]
    twice = joined[:-1][np.diff(joined) == 1]
    upto = 0
    for k in twice.tolist():
        d = int(np.searchsorted(chunk.off, starts[k], "right")) - 1
        if starts[k] < upto or ends[k + 2] > chunk.off[d + 1] or raw[starts[k + 1] : starts[k + 1] + 3] != b"eyJ":
            continue
        start = raw.find(b"eyJ", starts[k], ends[k])
        if start >= 0 and is_signed_token(raw[start : ends[k + 2]]):
            upto = int(ends[k + 2])
            yield d, start - int(chunk.off[d]), upto - int(chunk.off[d])


def _lines(chunk: Chunk, raw: bytes) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Document and places of each long base64 run, with the runs of its length on the next lines and a last one that may be shorter."""
    starts, ends, _ = chunk.words(_BASE64)
    size = ends - starts
    long = np.flatnonzero(size >= MIN_BASE64)
    docs = np.searchsorted(chunk.off, starts[long], "right") - 1
    upto = 0
    for k, d in zip(long.tolist(), docs.tolist(), strict=True):
        if k < upto:
            continue
        upto = k + 1
        while upto < len(starts) and starts[upto] < chunk.off[d + 1] and size[upto - 1] == size[k] >= size[upto] and raw[ends[upto - 1] : starts[upto]] in (b"\n", b"\r\n"):
            upto += 1
        yield d, list(zip(starts[k:upto].tolist(), ends[k:upto].tolist(), strict=True))


def chunk_spans(chunk: Chunk) -> dict[int, list[Span]]:
    """Byte spans of each document of the chunk that has any, in order."""
    raw = chunk.data.tobytes()
    text = lambda d: raw[chunk.off[d] : chunk.off[d + 1]]
    spans: dict[int, list[Span]] = {}
    add = lambda d, kind, start, end: spans.setdefault(d, []).append((start, KINDS.index(kind), end))
    for d in _documents_with(chunk, LOWER[chunk.data].tobytes(), KEYWORDS):
        for m in ASSIGN.finditer(text(d)):
            if m.end(1) - m.start(1) >= MIN_ASSIGN:
                add(d, "assign", *m.span())
    for d in _documents_with(chunk, raw, (b"AKIA",)):
        for m in ACCESS.finditer(text(d)):
            if m.end() - m.start() >= MIN_ACCESS:
                add(d, "access", *m.span())
    for d, start, end in _runs(chunk, _HEX, MIN_HEX):
        add(d, "hex", start, end)
    for d in _documents_with(chunk, raw, (b"PRIVATE KEY-----",)):
        for start, end in pem_blocks(text(d)):
            add(d, "pem", start, end)
    if b"eyJ" in raw:
        for d, start, end in _tokens(chunk, raw):
            add(d, "jwt", start, end)
    for d, lines in _lines(chunk, raw):
        parts = [raw[x:y] for x, y in lines]
        base = int(chunk.off[d])
        found = key_spans(b"".join(parts)) if len(lines) > 1 else []
        if found and found[0][1] == 0 and found[0][2] == sum(map(len, parts)):
            add(d, found[0][0], lines[0][0] - base, lines[-1][1] - base)
        else:
            for (x, _), part in zip(lines, parts, strict=True):
                for kind, a, b in key_spans(part) if len(part) >= MIN_BASE64 else ():
                    add(d, kind, x - base + a, x - base + b)
    for d, start, end in _runs(chunk, _HEX_ANY, MIN_HEX_KEY):
        run = text(d)[start:end]
        if run[:2] == b"30" and len(run) % 2 == 0 and is_der_key(bytes.fromhex(run.decode())):
            add(d, "der", start, end)
    return {d: sorted(found) for d, found in spans.items()}


def to_code_points(data: np.ndarray, spans: list[Span]) -> list[Span]:
    """The spans of one document's bytes, counted in code points."""
    if not len(data) or not (data & 0x80).any():
        return spans
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [(int(at[a]), kind, int(at[b])) for a, kind, b in spans]


# -- operators ------------------------------------------------------------


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``spans array<struct<kind,start,end>>`` of every row, by start, then kind, then end."""
    schema = f"doc_id {docs.schema[id_column].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for chunk in chunks(batch.column("text")):
                for d, found in chunk_spans(chunk).items():
                    found = to_code_points(chunk.data[chunk.off[d] : chunk.off[d + 1]], found)
                    out[chunk.first + d] = [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(released(spans_of), schema)


def redact(docs: DataFrame, text_column: str = "text", placeholder: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of the text replaced; overlapping spans become one placeholder."""
    mark = placeholder.encode()

    def mask(data: bytes, spans: list[Span]) -> bytes:
        out, end = [], 0
        for a, _, b in spans:
            if a >= end or not out:
                out += [data[end:a], mark]
            end = max(end, b)
        return b"".join([*out, data[end:]])

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            column = batch.column(at)
            changed: dict[int, str] = {}
            for chunk in chunks(column):
                for d, found in chunk_spans(chunk).items():
                    changed[chunk.first + d] = mask(chunk.data[chunk.off[d] : chunk.off[d + 1]].tobytes(), found).decode()
            if changed:
                values = column.to_pylist()
                for row, text in changed.items():
                    values[row] = text
                column = pa.array(values, column.type)
            yield batch.set_column(at, batch.schema.field(at), column)

    return docs.mapInArrow(released(masked), docs.schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    tell = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:3]))
    return spans.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(F.concat_ws(",", F.transform(base, tell)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", tell)).alias("spans"),
    )


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLE_SQL: dict[str, str] = {}
