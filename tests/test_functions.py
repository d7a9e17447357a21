from __future__ import annotations

import hashlib
import hmac
import ipaddress
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.functions import formats, redaction, timestamps
from caselens.functions.domains import SuffixList, default_list, parts
from caselens.functions.semantic import classify
from caselens.operators import search, timeline

AT = 1_790_000_000
MIDNIGHT = AT - 14 * 3600 - 13 * 60 - 20
# Timestamps and their seconds.
TIMES = {
    "2026-09-21T14:13:20Z": AT, "2026-09-21 14:13:20": AT, "2026-09-21T14:13:20.123456Z": AT, "2026-09-21T23:13:20+09:00": AT, "2026-09-21T23:13:20+0900": AT,
    "2026-09-21T09:13:20-05:00": AT, "2026-09-21T14:13": AT - 20, "2026-09-21": MIDNIGHT, "2026/09/21 14:13:20": AT, "21/Sep/2026:14:13:20 +0000": AT,
    "21/Sep/2026:23:13:20 +0900": AT, "Sep 21 14:13:20": AT, "9/21/2026 2:13:20 PM": AT, "9/21/2026 12:13:20 AM": AT - 14 * 3600, "09/21/2026": MIDNIGHT,
    "1790000000": AT, "1790000000123": AT, "1790000000123456": AT, "  1790000000  ": AT, "": None, "2026-13-01": None, "2026-09-21T25:00:00Z": None, "yesterday": None,
    "12345": None, "2026-09-21T14:13:20Q": None, "Foo 21 14:13:20": None, "21/Sep/2026": None, "9/21/2026 2:13:20 XM": None, "Sep 1 00:00:00": None,
    "2026-09-21Z": None, "2026/09/21T10:00": MIDNIGHT + 36_000, "9/21/2026 13:00 PM": MIDNIGHT + 13 * 3600, "2026-09-21T14:13:60Z": AT + 40, "1899-01-01": None,
    "2026-09-21T23:13:20+09": AT, "2026-09-21t14:13:20z": AT, "21/sEP/2026:14:13:20": AT, "2026-09-21 14:13:20,5": AT,
}


def test_parse_table():
    assert {t: timestamps.parse(t, 2026) for t in TIMES} == TIMES
    assert timestamps.parse(None, 2026) is None
    assert timestamps.parse("2026-02-31", 2026) == timestamps.parse("2026-03-03", 2026)
    assert timestamps.parse("Sep  1 00:00:00", 2026) == timestamps.parse("2026-09-01", 2026)


def test_parse_column(spark):
    texts = [*TIMES, None, "2026-02-31 10:00:00", "2026-02-28 23:59:60", "2300-01-01 00:00:00", "2026-09-21 14:13:20.123456789"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.s for r in df.select("t", timestamps.seconds(F.col("t"), T.StringType(), 2026).alias("s")).collect()}
    assert got == {t: timestamps.parse(t, 2026) for t in texts}


def test_buckets_and_widths():
    assert timestamps.width_of("5m") == 300 and timestamps.width_of("90") == 90
    for bad in ("0", "1w", "", "-5s"):
        with pytest.raises(ValueError):
            timestamps.width_of(bad)
    assert timeline.auto_width(0, 59) == 1 and timeline.auto_width(0, 60) == 5 and timeline.auto_width(None, None) == 1
    assert timeline.auto_width(0, 10**12) == 2_592_000
    assert search.snapped(61, 119, 60) == (60, 120) and search.snapped(-1, 0, 60) == (-60, 0)


# What values look like.
LABELS = {
    "": "empty", "   ": "empty", "10.0.0.1": "ipv4", "255.255.255.255": "ipv4", "256.1.1.1": "text", "1.2.3": "text", "2001:db8::1": "ipv6", "::1": "ipv6", "::": "ipv6",
    "fe80::1%en0": "text", "10.0.0.1:443": "ip:port", "[2001:db8::1]:8080": "ip:port", "10.0.0.1:99999": "text", "00:11:22:aa:bb:cc": "mac", "00-11-22-AA-BB-CC": "mac",
    "123e4567-e89b-12d3-a456-426614174000": "uuid", "d41d8cd98f00b204e9800998ecf8427e": "md5", "da39a3ee5e6b4b0d3255bfef95601890afd80709": "sha1",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855": "sha256", "42": "integer", "-7": "integer", "+3": "integer", "1234567890": "integer",
    "3.14": "float", "1e10": "float", "-0.5": "float", "1e999": "text", "true": "boolean", "No": "boolean", "2026-09-27T12:34:56Z": "timestamp",
    "2026-09-27 12:34:56.123+09:00": "timestamp", "2026-09-27": "timestamp", "2011/08/10 09:46:59.607825": "timestamp", "27/Sep/2026:12:34:56 +0900": "timestamp",
    "Sep 27 12:34:56": "timestamp", "9/27/2026 1:02:03 PM": "timestamp", "https://example.com/path?q=1": "url", "ftp://host": "url", "http://": "text",
    "alice@example.com": "email", "@example.com": "text", "example.com": "domain", "www.example.co.uk": "domain", "xn--80ak6aa92e.com": "domain", "setup.exe": "text",
    "Mozilla/5.0": "text", "user0317": "text", "/api/v1/login": "text", "-bad.example": "text", "hello world": "text", " 10.0.0.1\t": "ipv4",
}


def test_labels(spark):
    df = spark.createDataFrame([(v,) for v in LABELS], "v string")
    assert {r.v: r.label for r in df.select("v", classify(F.col("v")).alias("label")).collect()} == LABELS


def test_ipv6_by_the_library(spark):
    rng = random.Random(5)
    texts = [":".join(rng.choice(["", "0", "1", "ab", "ffff", "12345", "1.2.3.4"]) for _ in range(rng.randrange(3, 9))) for _ in range(1500)]
    texts += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "v string")

    def valid(t: str) -> bool:
        try:
            return bool(ipaddress.IPv6Address(t))
        except ValueError:
            return False

    for r in df.select("v", (classify(F.col("v")) == "ipv6").alias("six")).collect():
        assert r.six == valid(r.v), r.v


def test_redaction(spark):
    values = ["alice", "", None, "日本語テキスト", "10.1.243.150", " 10.9.8.7 ", "2001:db8:abcd:1234::1", "not-an-ip", "ab"]
    df = spark.createDataFrame([(v,) for v in values], "v string")

    def done(spec: str, key: bytes | None = b"k3y") -> list:
        return [r[0] for r in df.select(redaction.redact(F.col("v"), redaction.parse_rule(spec), key)).collect()]

    assert done("v=mask") == [redaction.DEFAULT_MASK if v else v for v in values]
    assert done("v=mask:x,y")[0] == "x,y"
    assert done("v=partial")[0] == "ali**" and done("v=partial")[3] == "日本語****" and done("v=partial")[-1] == "ab"
    ip = done("v=ip:16")
    assert ip[4:8] == ["10.1.0.0", "10.9.0.0", "2001::", redaction.DEFAULT_MASK] and ip[1:3] == ["", None]
    assert done("v=ip:48")[4:7] == ["10.1.243.150", "10.9.8.7", "2001:db8:abcd::"]
    assert done("v=ip:0")[4] == "0.0.0.0"
    for key in (b"k3y", b"x" * 100):
        want = [hmac.new(key, v.encode(), hashlib.sha256).hexdigest()[:12] if v else v for v in values]
        assert done("v=hmac:12", key) == want


def test_redaction_rules():
    with pytest.raises(ValueError, match="two"):
        redaction.check([redaction.parse_rule("a=mask"), redaction.parse_rule("a=drop")], None)
    with pytest.raises(ValueError, match="key"):
        redaction.check([redaction.parse_rule("a=hmac")], b"")
    with pytest.raises(ValueError, match="1..=64"):
        redaction.check([redaction.parse_rule("a=hmac:65")], b"k")
    for bad in ("a", "a=what", "=mask", "a=ip:x"):
        with pytest.raises(ValueError):
            redaction.parse_rule(bad)
    assert redaction.parse_rule("a=hmac").manifest(3, b"k3y")["key_fingerprint"] == hashlib.sha256(b"k3y").hexdigest()[:16]


def test_domains(spark):
    known = default_list()
    cases = {
        "www.example.com": ("example.com", "com", "www"), "Example.CO.UK.": ("example.co.uk", "co.uk", ""), "a.b.example.co.jp": ("example.co.jp", "co.jp", "a.b"),
        "com": ("", "", ""), "co.uk": ("", "", ""), "host.unknownsuffix": ("", "", ""), "": ("", "", ""), "x.y.ck": ("x.y.ck", "y.ck", ""), "a.www.ck": ("www.ck", "ck", "a"),
        "a..com": ("", "", ""), None: ("", "", ""),
    }
    assert {h: known.split(h) for h in cases} == cases
    df = spark.createDataFrame([(h,) for h in cases], "h string").select("h", parts(F.col("h")).alias("p"))
    assert {r.h: tuple(r.p) for r in df.collect()} == cases
    assert SuffixList.of(["// note", "dev", "", "*.test // x"]).split("a.b.test") == ("a.b.test", "b.test", "")


def test_formats(spark):
    assert formats.size_of("1.5K") == 1536 and formats.size_of("2G") == 2 << 30 and formats.size_of("7") == 7
    assert formats.integer_of("1_000,000") == 1_000_000 and formats.thousands(1234567) == "1,234,567"
    assert formats.binary_size(1536) == "1.5 KiB" and formats.duration(0.5) == "500 ms" and formats.duration(75) == "1 min 15 s"
    with pytest.raises(ValueError):
        formats.size_of("x")
    df = spark.createDataFrame([("a",), ('a"b',), ("a,b",), ("a\nb",), (None,)], "v string")
    assert [r[0] for r in df.select(formats.quoted(F.col("v"))).collect()] == ["a", '"a""b"', '"a,b"', '"a\nb"', ""]


def test_regex_translation(spark):
    df = spark.createDataFrame([("a\rb\n",), ("STRASSE é",), ("x$y",), ("a]b",), ("١",)], "v string")
    hit = lambda p, i=False: [r[0] for r in df.select(F.col("v").rlike(search.translate(p, i))).collect()]
    assert hit("a.b") == [True, False, False, True, False]  # a dot takes all but a line feed
    assert hit("b$") == [False, False, False, True, False]  # the very end only
    assert hit("strasse É", True)[1] and hit(r"\d")[4] and hit(r"x\$y")[2] and hit("[]]")[3] and hit("[^]]")[3]
    for bad in ("(?=a)", "(?<!a)b", r"(a)\1", "a++", "(?>a)"):
        with pytest.raises(ValueError):
            search.SearchQuery(bad, "regex").check()
    with pytest.raises(ValueError):
        search.SearchQuery("(", "regex").check()


def test_address_prefixes_against_the_library(spark):
    rng = random.Random(5)
    group = lambda: rng.choice(["0", "0", "0", "ffff", "1", "0db8", f"{rng.randrange(1 << 16):x}", f"{rng.randrange(1 << 16):04X}"])
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7::8", "::ffff:1.2.3.4", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1::2::3", ":1", "1:", "12345::", "g::", "::1%eth0", "10.1.2.3", "10.1.2.03", "x", "::1.2.3.400", " fe80::1 "]
    for _ in range(300):
        parts = [group() for _ in range(rng.choice([8, 8, 7, 5, 3, 9]))]
        if rng.random() < 0.6:
            parts[rng.randrange(len(parts))] = rng.choice(["", "::"])
        texts.append(":".join(parts).replace(":::::", "::").replace("::::", "::").replace(":::", "::"))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for bits in (0, 1, 24, 47, 64, 96, 113, 128):

        def want(text: str, bits: int = bits) -> str:
            try:
                address = ipaddress.ip_address(text.strip())
            except ValueError:
                return redaction.DEFAULT_MASK
            if "%" in text:
                return redaction.DEFAULT_MASK
            keep = min(bits, address.max_prefixlen)
            return str(type(address)(int(address) >> address.max_prefixlen - keep << address.max_prefixlen - keep))

        got = df.select("t", redaction.ip_prefix(F.col("t"), bits).alias("p")).collect()
        assert {r.t: r.p for r in got} == {t: want(t) for t in texts}


def test_timestamps_of_random_texts(spark):
    rng = random.Random(6)
    clock = lambda: rng.choice(["", "T10:20", " 23:59:60", "t01:02:03", " 24:00:00", "T10:20:30.5", " 1:02", "T10:20:3", " 12:00:00,999"])
    zone = lambda: rng.choice(["", "", "Z", "z", "+05:30", "-0800", "+09", " +0100", "+1", "-12:345"])
    number = lambda: str(rng.choice([0, 1, 2, 9, 10, 12, 13, 28, 29, 30, 31, 32]))
    month = lambda: rng.choice(["jan", "Feb", "MAR", "Sept", "Xyz", "dec", "anf"])
    year = lambda: rng.choice(["1899", "1900", "1970", "1999", "2000", "2024", "2100", "2200", "2201", "24"])
    forms = [
        lambda: f"{year()}-{number():0>2}-{number():0>2}{clock()}{zone()}", lambda: f"{year()}/{number():0>2}{rng.choice('/-')}{number():0>2}{clock()}{zone()}",
        lambda: f"{number():0>2}/{month()}/{year()}:{number():0>2}:30:15 {zone()}", lambda: f"{month()}{' ' * rng.randrange(1, 4)}{number()}{clock().replace('T', ' ')}",
        lambda: f"{number()}/{number()}/{year()} {number()}:{number():0>2}{rng.choice(['', ':07'])}{rng.choice(['', ' AM', 'pm', ' Pm'])}", lambda: f"{number()}/{number()}/{year()}",
        lambda: str(rng.randrange(10 ** rng.choice([9, 10, 13, 16, 19]))),
    ]
    texts = list({rng.choice(["", " ", "\t"]) + rng.choice(forms)() + rng.choice(["", "\n"]) for _ in range(3000)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", timestamps.seconds(F.col("t"), T.StringType(), 2024).alias("s"))
    assert "Python" not in found._jdf.queryExecution().toString()
    got = {r.t: r.s for r in found.collect()}
    assert {t: (got[t], timestamps.parse(t, 2024)) for t in texts if got[t] != timestamps.parse(t, 2024)} == {}
    assert sum(v is not None for v in got.values()) > 300
