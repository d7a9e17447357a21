"""Queries over evidence files: a table is written as a delimited file, and read back through the engine.

Each file is made once a session, in record order, below the folder that the
cluster shares (a temporary folder where none is set), and taken away at exit.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..functions import formats, redaction, timestamps
from ..functions.formats import quoted
from ..operators import charts, counts, enrich, lineage, manifest, profile, search, timeline
from ..operators.frames import ORDINAL, RAW, lift
from ..session import Case, lookup_table
from ..sources.evidence import Source
from ..streaming import tail
from .catalogue import EVENTS, KEY, NAMES, ORACLE_SQL, QUERIES, query, table

HEADER = ",".join(NAMES)
#: the whole file as SQL text, and its records with their places
FILE = f"(SELECT '{HEADER}' || chr(10) || string_agg(raw || chr(10), '' ORDER BY event_id) AS body FROM {EVENTS})"
PLACED = f"""(SELECT *, event_rank - 1 AS ordinal, {len(HEADER) + 1} + coalesce(sum(octet_length(encode(raw)) + 1) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {EVENTS})"""

_folders: dict[str, Path] = {}
_files: dict[tuple, Path] = {}


def folder(spark: SparkSession) -> Path:
    """A folder of this session's own, below the shared one; a temporary folder only where the executors are of this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or ""
    if shared not in _folders:
        if shared.startswith("file://") or shared.startswith("/"):
            made = Path(shared.removeprefix("file://")) / f"caselens-evidence-{uuid.uuid4().hex}"
            made.mkdir(parents=True)
        elif spark.sparkContext.master.startswith("local"):
            made = Path(tempfile.mkdtemp(prefix="caselens-evidence-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a mounted folder that all executors share")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _folders[shared] = made
    return _folders[shared]


def written(spark: SparkSession, sf: str, name: str, order: str, columns: list[str], delimiter: str = ",", header: bool = True, extra=None, lead: bytes = b"", end: str = "\n") -> Path:
    """A table as a delimited file.  It is one file, so it is written in one stream."""
    key = (str(folder(spark)), sf, name, *columns, delimiter, header, str(extra), lead, end)
    if key not in _files:
        line = F.concat_ws(delimiter, *(quoted(F.col(c), delimiter) for c in columns))
        df = table(spark, sf, name)
        if extra is not None:
            line = F.concat(line, extra)
        path = folder(spark) / f"{name}-{len(_files)}.csv"
        with open(path, "wb") as f:
            f.write(lead)
            if header:
                f.write((delimiter.join(columns) + end).encode())
            for row in df.select(order, line.alias("_line")).orderBy(order).toLocalIterator(prefetchPartitions=True):
                f.write((row._line + end).encode())
        _files[key] = path
    return _files[key]


def events_file(spark: SparkSession, sf: str) -> Path:
    return written(spark, sf, "events", "event_id", list(NAMES))


def case(spark: SparkSession, sf: str, **more) -> Case:
    return Case(spark, events_file(spark, sf), use_index=False, **more)


def _told(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows about a whole file."""
    return spark.createDataFrame(rows, schema)


_FOUR = ["event_id", "user_id", "event_type", "props"]


# -- opening --------------------------------------------------------------


@query("""WITH n AS (SELECT count(*) AS n FROM events) SELECT name, delimiter, header, bom, scan_start::BIGINT AS scan_start, fields::BIGINT AS fields, least(256, n + CASE WHEN header THEN 1 ELSE 0 END) AS sampled, 1.0::DOUBLE AS consistency
FROM n, (VALUES ('comma', ',', true, 'none', 0, 4), ('tab', chr(9), true, 'none', 0, 4), ('semicolon', ';', true, 'none', 0, 4), ('pipe', '|', true, 'none', 0, 4),
  ('data first', ',', false, 'none', 0, 4), ('bom', ';', true, 'utf8', 3, 4), ('one column', ',', false, 'none', 0, 1)) v(name, delimiter, header, bom, scan_start, fields)""")
def e01_sniff_dialects(spark, sf):
    made = {
        "comma": (_FOUR, ",", True, b""), "tab": (_FOUR, "\t", True, b""), "semicolon": (_FOUR, ";", True, b""), "pipe": (_FOUR, "|", True, b""),
        "data first": (_FOUR, ",", False, b""), "bom": (_FOUR, ";", True, b"\xef\xbb\xbf"), "one column": (["event_id"], ",", False, b""),
    }
    rows = []
    for name, (columns, delimiter, header, lead) in made.items():
        s = Source(written(spark, sf, "events", "event_id", columns, delimiter, header, lead=lead)).sniff()
        rows.append((name, s.dialect.delimiter, s.dialect.header, s.bom, s.scan_start, s.field_count, s.sampled_records, float(s.consistency)))
    return _told(spark, rows, "name string, delimiter string, header boolean, bom string, scan_start bigint, fields bigint, sampled bigint, consistency double")


@query(f"SELECT ordinal::BIGINT AS ordinal, start::BIGINT AS start, (start + octet_length(encode(raw)))::BIGINT AS stop, 6 AS fields, raw FROM {PLACED}")
def e02_scan_records(spark, sf):
    df = case(spark, sf).frame.df
    return df.select(F.col(ORDINAL).alias("ordinal"), F.col("_start").alias("start"), F.col("_end").alias("stop"), F.col("_nfields").alias("fields"), F.col(RAW).cast("string").alias("raw"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(lang, '') AS lang FROM documents")
def e03_split_fields_of_multiline_records(spark, sf):
    path = written(spark, sf, "documents", "doc_id", ["doc_id", "lang", "text"], end="\r\n")
    df = Case(spark, path, use_index=False).frame.df
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2("text", 256).alias("text_sha256"), "lang")


_RAGGED = f"(SELECT raw || CASE WHEN event_id % 7 = 0 THEN ',extra' ELSE '' END AS raw, event_id FROM {EVENTS})"


@query(f"""SELECT count(*) AS records, 6::BIGINT AS expected_fields, count(*) FILTER (event_id % 7 = 0) AS mismatches, 0::BIGINT AS lenient, 0::BIGINT AS unterminated, max(octet_length(encode(raw)))::BIGINT AS max_bytes,
  sha256('{HEADER}' || chr(10) || string_agg(raw || chr(10), '' ORDER BY event_id)) AS sha256, ({len(HEADER) + 1} + sum(octet_length(encode(raw)) + 1))::BIGINT AS size FROM {_RAGGED}""")
def e04_index_statistics_and_digest(spark, sf):
    path = written(spark, sf, "events", "event_id", list(NAMES), extra=F.when(F.col("event_id") % 7 == 0, F.lit(",extra")).otherwise(F.lit("")))
    opened = Case(spark, path, use_index=False)
    index = opened.build_index(save=False)
    s = index.stats
    row = (s.records, s.expected_fields, s.field_mismatches, s.lenient_quotes, s.unterminated_quotes, s.max_record_bytes, index.digests["sha256"], opened.source.size)
    return _told(spark, [row], "records bigint, expected_fields bigint, mismatches bigint, lenient bigint, unterminated bigint, max_bytes bigint, sha256 string, size bigint")


@query("""WITH n AS (SELECT count(*) AS n FROM events) SELECT name, used, records, notes::BIGINT AS notes FROM n, (SELECT 'before' AS name, false AS used, 0 AS known, 0 AS notes UNION ALL SELECT 'kept', true, 1, 0 UNION ALL
  SELECT 'other dialect', false, 0, 1 UNION ALL SELECT 'damaged', false, 0, 1) v, LATERAL (SELECT CASE WHEN known = 1 THEN n ELSE 0 END AS records)""")
def e05_index_sidecar_reuse(spark, sf):
    path, sidecar = events_file(spark, sf), folder(spark) / f"{uuid.uuid4().hex}.index.json"
    rows = []

    def tell(name: str, **more) -> Case:
        opened = Case(spark, path, index_path=sidecar, **more)
        rows.append((name, opened.from_index, opened.index.stats.records, len(opened.notes)))
        return opened

    tell("before").build_index()
    tell("kept")
    tell("other dialect", quote=None)
    sidecar.write_text(sidecar.read_text().replace('"records"', '"Records"'))
    tell("damaged")
    return _told(spark, rows, "name string, used boolean, records bigint, notes bigint")


@query("""SELECT count(*) AS records, count(*) FILTER (contains(raw, 'error')) AS matches, true AS same FROM {events}""")
def e33_evidence_by_uri(spark, sf):
    path = events_file(spark, sf)
    local, remote = (Case(spark, p, use_index=False) for p in (path, f"file://{path}"))
    found = search.matches(remote.frame, search.SearchQuery("error")).df.count()
    return _told(spark, [(remote.count().records, found, local.source.digest() == remote.source.digest())], "records bigint, matches bigint, same boolean")


# -- rows -----------------------------------------------------------------


@query("SELECT {ordinal}::BIGINT AS ordinal, event_id::VARCHAR AS event_id, props FROM {events} WHERE {ordinal} BETWEEN 120 AND 379")
def e06_rows_of_a_window(spark, sf):
    return case(spark, sf).rows(120, 260).df.select(F.col(ORDINAL).alias("ordinal"), "event_id", "props")


_PICKS = [0, 3, 17, 99, 100, 640, 10**7]


@query(f"SELECT {{ordinal}}::BIGINT AS ordinal, raw FROM {{events}} WHERE {{ordinal}} IN ({', '.join(map(str, _PICKS))})")
def e07_scattered_rows(spark, sf):
    return case(spark, sf).scattered(_PICKS).df.select(F.col(ORDINAL).alias("ordinal"), F.col(RAW).cast("string").alias("raw"))


@query(f"""SELECT '{HEADER}' AS header, count(*) AS records, count(*) - 1 AS last, 0::BIGINT AS first, least(count(*), 10) AS shown, least(count(*), 1000) AS probed FROM events""")
def e08_header_count_and_jumps(spark, sf):
    opened = case(spark, sf)
    n = opened.count().records
    probed = opened.quick_profile()[0]["sampled"]
    row = (",".join(opened.source.header(opened.dialect)), n, opened.go_to(10**12), opened.go_to(-5), opened.rows(0, 10).df.count(), probed)
    return _told(spark, [row], "header string, records bigint, last bigint, first bigint, shown bigint, probed bigint")


# -- searches and selections ----------------------------------------------


@query(r"SELECT {ordinal}::BIGINT AS ordinal, event_id::VARCHAR AS event_id FROM {events} WHERE regexp_matches(raw, 'ERROR,1[0-9]\.[^,]*,', 'i')")
def e09_search_file_by_expression(spark, sf):
    found = search.matches(case(spark, sf).frame, search.SearchQuery(r"(?P<kind>ERROR),1[0-9]\.[^,]*,", "regex", True))
    return found.df.select(F.col(ORDINAL).alias("ordinal"), "event_id")


@query("""WITH e AS (SELECT *, contains(raw, 'error') AS a, contains(raw, 'error') AND user_id = 17 AS b FROM {events})
SELECT step, n FROM (SELECT count(*) FILTER (a) AS s1, count(*) FILTER (b) AS s2, count(*) AS s0 FROM e), LATERAL (VALUES ('search', s1), ('pivot', s2), ('back', s1), ('pivot again', s2), ('revert', s1), ('clear', s0)) v(step, n)""")
def e10_selection_navigation(spark, sf):
    opened, rows = case(spark, sf), []
    rows.append(("search", opened.find(search.SearchQuery("error")).count()))
    rows.append(("pivot", opened.pivot("user_id", "17").count()))
    rows.append(("back", opened.pop_selection().count()))
    rows.append(("pivot again", opened.pivot("user_id", "17").count()))
    rows.append(("revert", opened.revert_to(1).count()))
    rows.append(("clear", opened.clear_selection().count()))
    return _told(spark, rows, "step string, n bigint")


@query("SELECT refused FROM (VALUES ('empty pattern'), ('derived pivot'), ('cancelled step'), ('source as output')) v(refused)")
def e11_refusals(spark, sf):
    opened, rows = case(spark, sf), []

    def refused(name: str, call: Callable) -> None:
        try:
            call()
        except (ValueError, RuntimeError):
            rows.append((name,))

    refused("empty pattern", lambda: search.matches(opened.frame, search.SearchQuery("")).df.count())
    derived = enrich.enrich(opened.frame, [enrich.Domain("props")])
    refused("derived pivot", lambda: lineage.Selection.all(derived).pivot("props.registrable", "x"))
    step = lineage.Selection.all(opened.frame).narrow(search.SearchQuery("error"))
    step.cancel()
    refused("cancelled step", step.complete)
    refused("source as output", lambda: opened.export(opened.source.path, force=True))
    return _told(spark, rows, "refused string")


@query("SELECT {ordinal}::BIGINT AS ordinal, event_type FROM {events} WHERE contains(raw, 'error') AND value > 50")
def e12_selection_semi_join(spark, sf):
    opened = case(spark, sf)
    found = search.matches(opened.frame, search.SearchQuery("error"))
    large = opened.frame.where(F.col("value").try_cast("double") > 50)
    both = lineage.intersect(lineage.Selection.all(found), lineage.Selection.all(large))
    return both.df.select(F.col(ORDINAL).alias("ordinal"), "event_type")


@query("SELECT {ordinal}::BIGINT AS ordinal FROM {events} WHERE (epoch(ts) >= 1704758400 AND epoch(ts) < 1704844800)")
def e13_time_range_snapped_to_buckets(spark, sf):
    opened = case(spark, sf)
    found = opened.filter_range("ts", 1704758400 + 77, 1704844800 - 13, 3600)
    return found.frame.df.select(F.col(ORDINAL).alias("ordinal"))


# -- analyses -------------------------------------------------------------


@query("SELECT (floor(epoch(ts) / 21600) * 21600)::BIGINT AS bucket, count(*) AS count FROM events WHERE event_type = 'click' GROUP BY 1")
def e14_timeline_of_explicit_width(spark, sf):
    opened = case(spark, sf)
    opened.pivot("event_type", "click")
    return timeline.buckets(opened.analysed(), "ts", timestamps.width_of("6h"), fill=False)


@query("""SELECT name, detected, count(*) AS sampled, count(*) FILTER (v <> '') AS non_empty, count(DISTINCT nullif(trim(v), '')) AS distinct, max(octet_length(encode(v)))::BIGINT AS max_len
FROM (SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS name, unnest(['integer', 'timestamp', 'integer', 'categorical', 'float', 'text']) AS detected, unnest([event_id::VARCHAR, ts::VARCHAR, user_id::VARCHAR, event_type, value::VARCHAR, props]) AS v FROM events) GROUP BY 1, 2""")
def e15_profile_of_a_file(spark, sf):
    rows = [(p["name"], "text" if p["name"] == "props" else p["detected"], p["sampled"], p["non_empty"], p["distinct"], p["max_len"]) for p in case(spark, sf).profile(whole=True)]
    return _told(spark, rows, "name string, detected string, sampled bigint, non_empty bigint, distinct bigint, max_len bigint")


@query("SELECT * FROM (VALUES ('event_type', 'pie')) v(name, kind) UNION ALL SELECT 'c_mktsegment', 'pie' UNION ALL SELECT 'host', 'bars'")
def e16_dashboard_panels(spark, sf):
    customers = written(spark, sf, "customer", "c_custkey", ["c_custkey", "c_mktsegment"])
    pages = table(spark, sf, "pages").withColumn("host", F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1)).select("page_id", "host")
    rows = []
    for made in (profile.profile(case(spark, sf).frame), profile.profile(Case(spark, customers, use_index=False).frame), profile.profile(lift(pages), whole=True)):
        rows += [(p.column, p.kind) for p in counts.panels(made) if p.column in ("event_type", "c_mktsegment", "host")]
    return _told(spark, rows, "name string, kind string")


@query("SELECT c AS name, true AS exact_within_bound, true AS within FROM (VALUES ('props'), ('user_id'), ('event_id')) v(c)")
def e17_bounded_counts(spark, sf):
    """Counts of bounded memory against exact ones: no count above the true one or more than the bound below it, and no frequent value missed."""
    frame, rows = case(spark, sf).frame, []
    for name in ("props", "user_id", "event_id"):
        kept, bound = counts.bounded_counts(frame, name, capacity=64)
        exact = counts.value_counts(frame, name, None)
        both = exact.join(kept.select("value", F.col("count").alias("low")), "value", "left").select("count", F.coalesce("low", F.lit(0)).alias("low"))
        bad = both.where((F.col("low") > F.col("count")) | (F.col("count") - F.col("low") > bound)).count()
        n = exact.agg(F.sum("count")).first()[0] or 0
        rows.append((name, bad == 0, bound <= n / 64 + 1))
    return _told(spark, rows, "name string, exact_within_bound boolean, within boolean")


@query("SELECT props AS value, count(*) AS count FROM events WHERE props <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def e18_bounded_counts_that_fit_are_exact(spark, sf):
    kept, bound = counts.bounded_counts(case(spark, sf).frame, "props", capacity=1 << 20)
    return kept.where(F.lit(bound) == 0).orderBy(F.desc("count"), "value").limit(10)


@query("SELECT true AS near FROM (SELECT 1)")
def e19_approximate_distinct_error(spark, sf):
    frame = case(spark, sf).frame
    exact = counts.totals(frame, "event_id").first()["distinct"]
    return counts.approximate_distinct(frame, "event_id").select((F.abs(F.col("distinct") - exact) <= 0.05 * exact).alias("near"))


@query("SELECT bucket, count FROM (SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS bucket, count(*) AS count FROM events GROUP BY 1), (SELECT max(floor(epoch(ts))) AS last FROM events) WHERE bucket + 3600 <= last - 600")
def e20_streamed_timeline(spark, sf):
    place = folder(spark) / f"stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    frame = lift(spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]"))
    tail.to_folder(tail.live_timeline(frame, "ts", 3600), f"file://{place}/out", f"file://{place}/state").awaitTermination()
    return spark.read.schema("bucket bigint, count bigint").parquet(f"file://{place}/out")


@query("SELECT event_id, props FROM events WHERE event_type = 'error'")
def e21_streamed_search(spark, sf):
    place = folder(spark) / f"stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    frame = lift(spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]"))
    found = tail.live_search(frame, search.SearchQuery("error", "exact", columns=("event_type",))).select("event_id", "props")
    tail.to_folder(found, f"file://{place}/out", f"file://{place}/state").awaitTermination()
    return spark.read.schema("event_id bigint, props string").parquet(f"file://{place}/out")


@query("""WITH c AS (SELECT (floor(epoch(ts) / w) * w)::BIGINT AS bucket, w, count(*) AS n FROM events, (SELECT CASE WHEN max(floor(epoch(ts))) - min(floor(epoch(ts))) < 500000 THEN 1 ELSE 60 END AS w FROM events) GROUP BY ALL)
SELECT s.bucket, coalesce(c.n, 0)::BIGINT AS count FROM (SELECT unnest(range(min(bucket), max(bucket) + 1, any_value(w)::BIGINT)) AS bucket FROM c) s LEFT JOIN c USING (bucket)""")
def e30_timeline_coarsened(spark, sf):
    """A width of one second over more seconds than a timeline may have."""
    return timeline.timeline(case(spark, sf).frame, "ts", 1)[2]


@query("SELECT {ordinal}::BIGINT AS ordinal FROM {events} WHERE contains(raw, 'view') AND {ordinal} < 700")
def e31_kept_selection(spark, sf):
    opened = case(spark, sf)
    kept = opened.find(search.SearchQuery("view")).keep()
    kept.count()
    rows = kept.frame.where(F.col(ORDINAL) < 700).df.select(F.col(ORDINAL).alias("ordinal")).collect()
    kept.forget()
    return _told(spark, [tuple(r) for r in rows], "ordinal bigint")


@query("""WITH c AS (SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1)
SELECT value, count, repeat('█', greatest(round(count * 40.0 / (SELECT max(count) FROM c)), 1)::INT) AS bar FROM c""")
def e34_chart_bars(spark, sf):
    return charts.bars(counts.value_counts(case(spark, sf).frame, "event_type"))


@query("""WITH c AS (SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1), t AS (SELECT count(DISTINCT floor(epoch(ts) / 86400)) AS days FROM events)
SELECT 'event_type' AS title, 'arc' AS mark, count(*) AS points, sum(count)::BIGINT AS total FROM c UNION ALL SELECT 'ts', 'bar', days, (SELECT count(*) FROM events) FROM t""")
def e35_chart_specifications(spark, sf):
    frame = case(spark, sf).frame
    panel = counts.Panel("event_type", "pie")
    made = [charts.specification(panel, counts.panel_data(frame, panel)), charts.timeline_specification("ts", timeline.buckets(frame, "ts", 86_400))]
    rows = [(c["title"], c["mark"], len(c["data"]["values"]), sum(v["count"] for v in c["data"]["values"])) for c in made]
    return _told(spark, rows, "title string, mark string, points bigint, total bigint")


# -- enrichment, edits, exports -------------------------------------------


@query("SELECT {ordinal}::BIGINT AS ordinal, coalesce(c_name, '') AS name FROM {events} LEFT JOIN customer ON user_id = c_custkey")
def e22_lookup_table_from_a_file(spark, sf):
    path = written(spark, sf, "customer", "c_custkey", ["c_custkey", "c_name", "c_mktsegment"])
    column, place, key, values = enrich.parse_lookup(f"user_id={path}:c_custkey:c_name")
    customers, told = lookup_table(spark, place, key, values)
    found = enrich.enrich(case(spark, sf).frame, [enrich.Lookup(column, customers, key, values, told)])
    return found.df.select(F.col(ORDINAL).alias("ordinal"), F.col("`user_id.c_name`").alias("name"))


_BLOCKS = [("10.0.0.0", "10.0.255.255", "AA"), ("10.1.0.0", "10.1.0.127", "BB"), ("10.2.0.0", "10.15.255.255", "CC"), ("11.0.0.0", "255.255.255.255", "DD"), ("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "EE")]


@query("""WITH a AS (SELECT event_id, user_id % 19 AS k, user_id % 251 AS b FROM events)
SELECT event_id, CASE WHEN k = 17 THEN 'EE' WHEN k = 18 THEN 'DD' WHEN k = 0 THEN 'AA' WHEN k = 1 THEN CASE WHEN b < 128 THEN 'BB' ELSE '' END WHEN k BETWEEN 2 AND 15 THEN 'CC' ELSE '' END AS country FROM a""")
def e36_address_ranges_from_a_table(spark, sf):
    """IPv4 and IPv6 ranges, narrow and very wide ones; k = 16 lies between two."""
    n = F.col("user_id")
    k, b = (n % 19).cast("string"), (n % 251).cast("string")
    address = F.when(n % 19 == 17, F.concat(F.lit("2001:db8:0:"), b, F.lit("::1"))).when(n % 19 == 18, F.concat(F.lit("200.1.2."), b))
    address = address.when(n % 19 == 1, F.concat(F.lit("10.1.0."), b)).otherwise(F.concat_ws(".", F.lit("10"), k, F.lit("7"), b))
    frame = lift(table(spark, sf, "events").select("event_id", "user_id").withColumn("ip", address))
    found = enrich.enrich(frame, [enrich.Geo("ip", spark.createDataFrame(_BLOCKS, "low string, high string, country string"), ("country",))])
    return found.df.select("event_id", F.col("`ip.country`").alias("country"))


def _export(spark: SparkSession, opened: Case, **how) -> tuple[Path, dict]:
    path = folder(spark) / f"{uuid.uuid4().hex}.out.csv"
    return path, opened.export(path, **how)


@query(f"SELECT raw AS line FROM {EVENTS} WHERE contains(raw, 'purchase') UNION ALL SELECT '{HEADER}'")
def e23_export_raw(spark, sf):
    opened = case(spark, sf)
    opened.find(search.SearchQuery("purchase"))
    path, _ = _export(spark, opened)
    return spark.read.schema("line string").option("lineSep", "\n").text(f"file://{path}").withColumnRenamed("value", "line")


@query(f"""SELECT count(*) AS records, sha256('{HEADER}' || chr(13) || chr(10) || string_agg(raw || chr(13) || chr(10), '' ORDER BY event_id)) AS sha256, 'raw-records' AS content, 'matches' AS kind, 1::BIGINT AS operations,
  (SELECT sha256(body) FROM {FILE}) AS source_sha256, 'output+source' AS scope, true AS ok, false AS ok_after_change FROM {EVENTS} WHERE contains(raw, 'signup')""")
def e24_manifest_and_verification(spark, sf):
    opened = case(spark, sf)
    opened.find(search.SearchQuery("signup"))
    path, told = _export(spark, opened, terminator="\r\n")
    checked = manifest.verify(path)
    with open(path, "ab") as f:
        f.write(b"x")
    out = told["output"]
    row = (out["records"], out["sha256"], out["content"], told["selection"]["kind"], len(told["operations"]), told["source"]["sha256"], checked["scope"], checked["ok"], manifest.verify(path)["ok"])
    return _told(spark, [row], "records bigint, sha256 string, content string, kind string, operations bigint, source_sha256 string, scope string, ok boolean, ok_after_change boolean")


@query(f"""SELECT raw AS line, count(*) OVER () AS records, (sum(octet_length(encode(raw)) + 1) OVER ())::BIGINT AS size, true AS ok FROM {EVENTS} WHERE contains(raw, 'click')""")
def e32_export_dataset(spark, sf):
    opened, place = case(spark, sf), folder(spark) / f"{uuid.uuid4().hex}.parts"
    opened.find(search.SearchQuery("click"))
    out = opened.export_dataset(place)["output"]
    lines = spark.read.schema("line string").option("lineSep", "\n").text(f"file://{place}").withColumnRenamed("value", "line")
    return lines.select("line", F.lit(out["records"]).cast("long").alias("records"), F.lit(out["size"]).cast("long").alias("size"), F.lit(manifest.verify(place)["ok"]).alias("ok"))


@query("""SELECT {ordinal}::BIGINT AS ordinal, CASE {ordinal} WHEN 5 THEN 'seen "twice"' ELSE event_type END AS event_type FROM {events} WHERE {ordinal} < 40""")
def e25_edit_version_file(spark, sf):
    opened, path = case(spark, sf), folder(spark) / f"{uuid.uuid4().hex}.edits.json"
    opened.edit(5, "event_type", 'seen "twice"')
    opened.mark(6, 2, "look again")
    opened.save_version(path)
    opened.discard_edits()
    opened.open_version(path)
    return opened.rows_shown(0, 40).df.select(F.col(ORDINAL).alias("ordinal"), "event_type")


@query(r"""SELECT event_id || ',' || left(user_id::VARCHAR, 1) || repeat('*', length(user_id::VARCHAR) - 1) || ',' || event_type || ',' || CASE WHEN value::VARCHAR = '' THEN '' ELSE '[REDACTED]' END || ',' || regexp_extract(raw, '("\{.*|[^,]*)$') || ',' || coalesce(c_mktsegment, '') AS line
FROM {events} LEFT JOIN customer ON c_custkey = user_id WHERE {ordinal} >= 10 AND {ordinal} < 510""")
def e26_export_enriched_and_redacted(spark, sf):
    opened = case(spark, sf)
    path = written(spark, sf, "customer", "c_custkey", ["c_custkey", "c_mktsegment"])
    customers, told = lookup_table(spark, path, "c_custkey")
    opened.enrich([enrich.Lookup("user_id", customers, "c_custkey", ("c_mktsegment",), told)])
    opened.redact_on_export([redaction.parse_rule(r) for r in ("ts=drop", "user_id=partial:1", "value=mask")])
    opened.selection = opened.selection.narrow(search.OrdinalRange.of("10:500"))
    out, _ = _export(spark, opened, header=False)
    return spark.read.schema("line string").option("lineSep", "\n").text(f"file://{out}").withColumnRenamed("value", "line")


@query(f"SELECT method, told FROM (VALUES ('drop', ''), ('mask', 'x'), ('partial', '3'), ('ip_prefix', '20'), ('hmac', '12:' || left(sha256('{KEY.decode()}'), 16)), ('refused', '4')) v(method, told)")
def e27_redaction_rules(spark, sf):
    rows, refused = [], 0
    for spec in ("a=drop", "a=mask:x", "a=partial", "a=ip:20", "a=hmac:12"):
        rule = redaction.parse_rule(spec)
        redaction.check([rule], KEY)
        told = rule.manifest(0, KEY)
        rows.append((rule.method, ":".join(str(told[k]) for k in ("replacement", "keep", "bits", "length", "key_fingerprint") if k in told)))
    for spec, key in (("a=what", KEY), ("a=hmac", None), ("a=ip:129", KEY), ("a=partial:x", KEY)):
        try:
            redaction.check([redaction.parse_rule(spec)], key)
        except ValueError:
            refused += 1
    return _told(spark, [*rows, ("refused", str(refused))], "method string, told string")


# -- the command line, generated files, cache -----------------------------


def _run(*arguments: str) -> dict:
    return cli.run(cli.parser().parse_args([*map(str, arguments), "--json"]))[0]


@query(f"""WITH f AS (SELECT * FROM {FILE}), n AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT props) AS props, count(DISTINCT event_type) AS types FROM events),
t AS (SELECT count(DISTINCT floor(epoch(ts) / 86400)) AS days FROM events)
SELECT name, value::VARCHAR AS value FROM f, n, t, LATERAL (VALUES ('info fields', '6'), ('index records', n::VARCHAR), ('index sha256', sha256(body)), ('count records', n::VARCHAR), ('rows', '5'), ('search matches', errors::VARCHAR),
  ('freq distinct', types::VARCHAR), ('freq cached', 'true'), ('timeline parsed', n::VARCHAR), ('timeline buckets', days::VARCHAR), ('profile columns', '6'), ('hash sha256', sha256(body)), ('hash size', octet_length(encode(body))::VARCHAR),
  ('export records', errors::VARCHAR), ('verify', 'true'), ('gen rows', '250'), ('gen same', 'true')) v(name, value)""")
def e28_command_line(spark, sf):
    path, made = events_file(spark, sf), folder(spark)
    index, out = made / f"{uuid.uuid4().hex}.index.json", made / f"{uuid.uuid4().hex}.cli.csv"
    rows = [("info fields", _run("info", path)["sniff"]["field_count"])]
    told = _run("index", path, "--index", index)
    rows += [("index records", told["records"]), ("index sha256", told["sha256"]), ("count records", _run("count", path)["records"])]
    rows += [("rows", len(_run("rows", path, "-s", "7", "-n", "5", "--index", index)["records"]))]
    rows += [("search matches", _run("search", path, "error", "-c", "event_type", "--exact")["matches"])]
    rows += [("freq distinct", _run("freq", path, "-c", "event_type", "--index", index)["distinct"]), ("freq cached", _run("freq", path, "-c", "event_type", "--index", index)["cached"])]
    told = _run("timeline", path, "-c", "ts", "-b", "1d")
    rows += [("timeline parsed", told["parsed"]), ("timeline buckets", sum(b["count"] > 0 for b in told["buckets"])), ("profile columns", len(_run("profile", path, "--index", index)["columns"]))]
    told = _run("hash", path, "--algo", "sha256")
    rows += [("hash sha256", told["sha256"]), ("hash size", told["size"])]
    rows += [("export records", _run("export", path, "-o", out, "-s", "error", "-c", "event_type", "--exact")["records"]), ("verify", _run("verify", out)["ok"])]
    made_twice = [made / f"{uuid.uuid4().hex}.gen.csv" for _ in range(2)]
    for place in made_twice:
        told = _run("gen", "-o", place, "--rows", "250", "-p", "quotes")
    rows += [("gen rows", Case(spark, made_twice[0], use_index=False).count().records), ("gen same", made_twice[0].read_bytes() == made_twice[1].read_bytes())]
    return _told(spark, [(k, json.dumps(v) if isinstance(v, bool) else str(v)) for k, v in rows], "name string, value string")


@query("SELECT * FROM (VALUES ('thousands', '1,234,567'), ('size', '1.5 MiB'), ('duration', '2 min 5 s'), ('bytes of 64K', '65536'), ('integer', '12345')) v(name, value)")
def e29_formats(spark, sf):
    rows = [
        ("thousands", formats.thousands(1_234_567)), ("size", formats.binary_size(3 << 19)), ("duration", formats.duration(125)),
        ("bytes of 64K", str(formats.size_of("64K"))), ("integer", str(formats.integer_of("12_345"))),
    ]
    return _told(spark, rows, "name string, value string")


__all__ = ["ORACLE_SQL", "QUERIES"]
