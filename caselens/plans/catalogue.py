"""Query catalogue: operators over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains, redaction, timestamps
from ..functions.semantic import FILE_ENDINGS, classify
from ..operators import counts, edits, enrich, export, lineage, profile, search, timeline
from ..operators.frames import ORDINAL, RAW, Frame, col, lift
from ..sources.dialect import Dialect

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = b"caselens test key"
NAMES = ("event_id", "ts", "user_id", "event_type", "value", "props")


def query(sql: str | None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("{events}", EVENTS).replace("{ordinal}", "(event_rank - 1)")
        return f

    return add


def _field(name: str) -> str:
    text = f"coalesce({name}::VARCHAR, '')"
    return f"CASE WHEN regexp_matches({text}, '[,\"\\r\\n]') THEN '\"' || replace({text}, '\"', '\"\"') || '\"' ELSE {text} END"


#: the events as a frame: data columns, raw record, rank
EVENTS = f"(SELECT *, row_number() OVER (ORDER BY event_id) AS event_rank, concat_ws(',', {', '.join(map(_field, NAMES))}) AS raw FROM events)"


def events(spark: SparkSession, sf: str, ordinal: bool = False) -> Frame:
    df = spark.read.parquet(f"{sf}/events.parquet")
    return lift(df, list(NAMES), "event_id" if ordinal else None)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _found(spark: SparkSession, sf: str, q: search.SearchQuery) -> DataFrame:
    return search.matches(events(spark, sf), q).df.select("event_id")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return q19_value_counts_top(spark, sf)


@query("SELECT event_id FROM {events} WHERE contains(raw, 'error,1')")
def q01_search_literal_raw(spark, sf):
    return _found(spark, sf, search.SearchQuery("error,1"))


@query("SELECT event_id FROM {events} WHERE contains(lower(raw), 'error')")
def q02_search_literal_ci(spark, sf):
    return _found(spark, sf, search.SearchQuery("ERROR", case_insensitive=True))


@query(r"SELECT event_id FROM {events} WHERE regexp_matches(raw, 'error,1[0-9]\.')")
def q03_search_regex_raw(spark, sf):
    return _found(spark, sf, search.SearchQuery(r"error,1[0-9]\.", "regex"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, 'the.{3,8}\n')")
def q04_search_regex_column(spark, sf):
    docs = lift(table(spark, sf, "documents"))
    return search.matches(docs, search.SearchQuery(r"the.{3,8}\n", "regex", columns=("text",))).df.select("doc_id")


@query("SELECT event_id FROM events WHERE contains(event_type, '1') OR contains(props, '1') OR contains(user_id::VARCHAR, '1')")
def q05_search_literal_columns(spark, sf):
    return _found(spark, sf, search.SearchQuery("1", columns=("event_type", "props", "user_id")))


@query("SELECT event_id FROM events WHERE event_type = 'error'")
def q06_search_exact_column(spark, sf):
    return _found(spark, sf, search.SearchQuery("error", "exact", columns=("event_type",)))


@query("SELECT event_id FROM events WHERE event_id::VARCHAR = '8' OR ts::VARCHAR = '8' OR user_id::VARCHAR = '8' OR event_type = '8' OR value::VARCHAR = '8' OR props = '8'")
def q07_search_exact_any(spark, sf):
    return _found(spark, sf, search.SearchQuery("8", "exact"))


@query("SELECT event_id FROM events WHERE lower(event_type) = 'error'")
def q08_search_exact_ci(spark, sf):
    return _found(spark, sf, search.SearchQuery("ErRoR", "exact", True, ("event_type",)))


@query("SELECT event_id FROM {events} WHERE NOT contains(raw, 'error')")
def q09_search_invert(spark, sf):
    return _found(spark, sf, search.SearchQuery("error", invert=True))


@query("SELECT event_id, {ordinal}::BIGINT AS ordinal FROM {events} WHERE {ordinal} >= 100 AND {ordinal} < 350")
def q10_ordinal_range(spark, sf):
    frame = events(spark, sf, ordinal=True)
    return search.matches(frame, search.OrdinalRange.of("100:250")).df.select("event_id", F.col(ORDINAL).alias("ordinal"))


@query("""SELECT event_id FROM {events} WHERE contains(raw, 'error') AND contains(props, '1')
  AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'""")
def q11_nested_selection(spark, sf):
    start, end = (timestamps.parse(d, 2024) for d in ("2024-01-05", "2024-01-20"))
    chain = lineage.Selection.all(events(spark, sf)).narrow(search.SearchQuery("error"))
    chain = chain.narrow(search.SearchQuery("1", columns=("props",))).narrow(search.TimeRange("ts", start, end))
    return chain.frame.df.select("event_id")


@query("SELECT event_id, {ordinal}::BIGINT AS ordinal, raw FROM {events} WHERE contains(raw, 'purchase') ORDER BY event_id LIMIT 20")
def q12_first_n_matches(spark, sf):
    _, first = search.first_matches(events(spark, sf, ordinal=True), search.SearchQuery("purchase"), 20)
    return first.df.select("event_id", F.col(ORDINAL).alias("ordinal"), F.col(RAW).alias("raw"))


@query("""WITH c AS (SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS bucket, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT s.bucket, coalesce(c.n, 0)::BIGINT AS count FROM (SELECT unnest(range(min(bucket), max(bucket) + 1, 3600)) AS bucket FROM c) s LEFT JOIN c USING (bucket)""")
def q13_timeline_hour_zero_fill(spark, sf):
    errors = search.matches(events(spark, sf), search.SearchQuery("error", "exact", columns=("event_type",)))
    return timeline.buckets(errors, "ts", 3600)


@query("SELECT (floor(epoch(ts) / 86400) * 86400)::BIGINT AS bucket, count(*) AS count FROM events GROUP BY 1")
def q14_timeline_day(spark, sf):
    return timeline.buckets(events(spark, sf), "ts", 86_400, fill=False)


@query("""SELECT count(*) AS counted, count(ts) AS parsed, count(*) - count(ts) AS unparsed, floor(epoch(min(ts)))::BIGINT AS min, floor(epoch(max(ts)))::BIGINT AS max FROM events""")
def q15_timeline_totals(spark, sf):
    return timeline.totals_frame(events(spark, sf), "ts")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-11 06:00:00'")
def q16_time_range(spark, sf):
    start, end = (timestamps.parse(t, 2024) for t in ("2024-01-10 06:00:00", "2024-01-11T06:00Z"))
    return search.matches(events(spark, sf), search.TimeRange("ts", start, end)).df.select("event_id")


@query("SELECT event_id, form, floor(epoch(ts))::BIGINT AS seconds FROM events, (VALUES ('iso'), ('clf'), ('us'), ('syslog'), ('epoch'), ('slash'), ('zoned')) f(form)")
def q17_parse_timestamp_formats(spark, sf):
    at = F.col("ts").cast("timestamp")
    forms = {
        "iso": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "clf": F.date_format(at, "dd/MMM/yyyy:HH:mm:ss '+0000'"), "us": F.date_format(at, "M/d/yyyy h:mm:ss a"),
        "syslog": F.date_format(at, "MMM dd HH:mm:ss"), "epoch": F.unix_timestamp(at).cast("string"), "slash": F.date_format(at, "yyyy/MM/dd HH:mm:ss"),
        "zoned": F.date_format(at + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd HH:mm:ss'+09:00'"),
    }
    texts = F.explode(F.array(*(F.struct(F.lit(k).alias("form"), v.alias("text")) for k, v in forms.items()))).alias("t")
    df = table(spark, sf, "events").select("event_id", texts).select("event_id", "t.form", "t.text")
    return df.select("event_id", "form", timestamps.seconds(F.col("text"), df.schema["text"].dataType, 2024).alias("seconds"))


@query(f"""WITH r AS (SELECT greatest(floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT, 1) AS span FROM events)
SELECT span, (SELECT min(w) FROM (VALUES {', '.join(f'({w})' for w in timeline.WIDTHS)}) v(w) WHERE span // w < 60)::BIGINT AS width FROM r""")
def q18_auto_width(spark, sf):
    t = timeline.totals(events(spark, sf), "ts")
    return spark.createDataFrame([(max(t.max - t.min, 1), timeline.auto_width(t.min, t.max))], "span bigint, width bigint")


@query("SELECT props AS value, count(*) AS count FROM {events} WHERE contains(raw, 'error') AND props <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def q19_value_counts_top(spark, sf):
    return counts.value_counts(search.matches(events(spark, sf), search.SearchQuery("error")), "props")


@query("""SELECT props AS value, count(*) AS count, count(*)::DOUBLE / (SELECT count(*) FROM events WHERE event_type = 'view') AS share
FROM events WHERE event_type = 'view' AND props <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def q20_value_counts_selection_share(spark, sf):
    return counts.value_shares(search.matches(events(spark, sf), search.SearchQuery("view", "exact", columns=("event_type",))), "props", 10)


@query("SELECT count(*) AS counted, count(*) FILTER (lang = 'fr') AS empty, count(DISTINCT nullif(lang, 'fr')) AS distinct FROM documents")
def q21_value_counts_totals(spark, sf):
    docs = table(spark, sf, "documents").withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    return counts.totals(Frame(docs, ("lang",)), "lang")


@query("SELECT count(DISTINCT props) AS exact, true AS near FROM events")
def q22_distinct_approx(spark, sf):
    """The estimate against the exact number: within five of its standard errors."""
    frame = events(spark, sf)
    both = counts.totals(frame, "props").select(F.col("distinct").alias("exact")).crossJoin(counts.approximate_distinct(frame, "props"))  # one row each
    return both.select("exact", (F.abs(F.col("distinct") - F.col("exact")) <= 0.04 * F.col("exact")).alias("near"))


@query("SELECT props AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")  # so few values are counted exactly
def q22b_top_approx(spark, sf):
    return counts.approximate_top(events(spark, sf), "props", 10_000).orderBy(F.desc("count"), "value").limit(10)


@query("""SELECT event_id, coalesce(c_name, '') AS name, coalesce(c_mktsegment, '') AS segment FROM events LEFT JOIN customer ON user_id::VARCHAR = c_custkey::VARCHAR""")
def q23_lookup_join(spark, sf):
    customers = lift(table(spark, sf, "customer"), ["c_custkey", "c_name", "c_mktsegment"], "c_custkey")
    found = enrich.enrich(events(spark, sf), [enrich.Lookup("user_id", customers, "c_custkey", ("c_name", "c_mktsegment"))])
    return found.df.select("event_id", col("user_id.c_name").alias("name"), col("user_id.c_mktsegment").alias("segment"))


@query("""SELECT n_nationkey::BIGINT AS n_nationkey, coalesce(last, '') AS last FROM nation LEFT JOIN
  (SELECT c_nationkey, max_by(c_name, c_custkey) AS last FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""")
def q24_lookup_last_wins(spark, sf):
    customers = lift(table(spark, sf, "customer"), ["c_nationkey", "c_name"], "c_custkey")
    nations = lift(table(spark, sf, "nation"))
    found = enrich.enrich(nations, [enrich.Lookup("n_nationkey", customers, "c_nationkey", ("c_name",))])
    return found.df.select(F.col("n_nationkey").cast("bigint"), col("n_nationkey.c_name").alias("last"))


_HOST = "regexp_extract(url, '^[a-z]+://([^/:]+)', 1)"


@query(f"SELECT page_id, {_HOST} AS host FROM pages")
def q25_domain_host(spark, sf):
    return table(spark, sf, "pages").select("page_id", domains.host(F.col("url")).alias("host"))


@query(f"""SELECT page_id, regexp_extract({_HOST}, '[^.]+\\.[^.]+$') AS registrable, regexp_extract({_HOST}, '[^.]+$') AS suffix,
  regexp_extract({_HOST}, '^(.*)\\.[^.]+\\.[^.]+$', 1) AS subdomain FROM pages""")
def q26_registrable(spark, sf):
    pages = table(spark, sf, "pages").withColumn("host", domains.host(F.col("url")))
    found = enrich.enrich(Frame(pages, ("page_id", "host")), [enrich.Domain("host")])
    return found.df.select("page_id", *(col(f"host.{f}").alias(f) for f in ("registrable", "suffix", "subdomain")))


def _redacted(spark, sf, rule: redaction.Rule) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", redaction.redact(F.col("c_name"), rule, KEY).alias("c_name"))


@query("SELECT c_custkey, CASE WHEN c_name <> '' THEN '[REDACTED]' ELSE c_name END AS c_name FROM customer")
def q27_redact_mask(spark, sf):
    return _redacted(spark, sf, redaction.parse_rule("c_name=mask"))


@query("SELECT c_custkey, left(c_name, 4) || repeat('*', greatest(length(c_name) - 4, 0)) AS c_name FROM customer")
def q28_redact_partial(spark, sf):
    return _redacted(spark, sf, redaction.parse_rule("c_name=partial:4"))


_IP = "'10.' || (user_id % 16) || '.' || (user_id % 251) || '.' || (1 + user_id % 250)"


def _ip():
    n = F.col("user_id")
    return F.concat_ws(".", F.lit("10"), (n % 16).cast("string"), (n % 251).cast("string"), (1 + n % 250).cast("string"))


@query("SELECT event_id, '10.' || (user_id % 16) || '.0.0' AS ip FROM events")
def q29_redact_ip_prefix(spark, sf):
    return table(spark, sf, "events").select("event_id", redaction.redact(_ip(), redaction.parse_rule("ip=ip:16")).alias("ip"))


_PADS = [bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


@query(f"SELECT c_custkey, left(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(c_name)))), 12) AS c_name FROM customer")
def q30_redact_hmac(spark, sf):
    return _redacted(spark, sf, redaction.parse_rule("c_name=hmac:12"))


@query(f"SELECT doc_id, sha256(doc_id || ',' || {_field('text')}) AS sha256 FROM documents")
def q31_value_sha256(spark, sf):
    """Digest of each exported record."""
    docs = lift(table(spark, sf, "documents"), ["doc_id", "text"], "doc_id")
    done = export.lines(docs, Dialect()).select(ORDINAL, F.sha2("line", 256).alias("sha256"))
    return done.join(docs.df.select(ORDINAL, "doc_id"), ORDINAL).select("doc_id", "sha256")


@query("""SELECT event_id, CASE {ordinal} WHEN 3 THEN 'reviewed' WHEN 7 THEN 'changed, twice' ELSE event_type END AS event_type,
  CASE {ordinal} WHEN 7 THEN '' ELSE props END AS props, {ordinal} IN (3, 7) AS changed FROM {events}""")
def q32_edit_overlay(spark, sf):
    made = edits.EditSet()
    for record, column, value in ((3, 3, "reviewed"), (7, 3, "changed, twice"), (7, 5, "")):
        made.set_cell(record, column, value, "before")
    found = edits.overlay(events(spark, sf, ordinal=True), made.table(spark))
    return found.df.select(F.col("event_id").cast("bigint"), "event_type", "props", F.col("_changed").alias("changed"))


_V4 = r"((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LABELS = rf"""CASE WHEN trim(v) = '' THEN 'empty' WHEN regexp_full_match(v, '{_V4}') THEN 'ipv4'
  WHEN regexp_full_match(v, '[0-9a-fA-F]{{64}}') THEN 'sha256' WHEN regexp_full_match(v, '[0-9a-fA-F]{{40}}') THEN 'sha1' WHEN regexp_full_match(v, '[0-9a-fA-F]{{32}}') THEN 'md5'
  WHEN regexp_full_match(v, '[-+]?[0-9]{{1,19}}') THEN 'integer'
  WHEN regexp_matches(v, '[.eE]') AND regexp_full_match(v, '[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?') THEN 'float'
  WHEN lower(v) IN ('true', 'false', 'yes', 'no', 't', 'f', 'y', 'n') THEN 'boolean'
  WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.,][0-9]{{1,9}})?)?)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?') THEN 'timestamp'
  WHEN regexp_full_match(v, '[A-Za-z][A-Za-z0-9+.-]{{1,15}}://[^ \t\n\f\r]+') THEN 'url'
  WHEN regexp_full_match(v, '([A-Za-z0-9]([A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\.)+[A-Za-z]{{2,63}}') AND length(v) BETWEEN 4 AND 253
    AND lower(regexp_extract(v, '[^.]*$')) NOT IN ({', '.join(f"'{e}'" for e in FILE_ENDINGS)}) THEN 'domain'
  ELSE 'text' END"""
_VALUES = f"""(SELECT event_id, 'ts' AS name, ts::VARCHAR AS v FROM events UNION ALL SELECT event_id, 'user_id', user_id::VARCHAR FROM events
  UNION ALL SELECT event_id, 'value', value::VARCHAR FROM events UNION ALL SELECT event_id, 'event_type', event_type FROM events
  UNION ALL SELECT event_id, 'props', props FROM events UNION ALL SELECT event_id, 'ip', {_IP} FROM events UNION ALL SELECT event_id, 'digest', sha256(props) FROM events
  UNION ALL SELECT page_id, 'url', url FROM pages UNION ALL SELECT page_id, 'host', {_HOST} FROM pages)"""


def _values(spark, sf) -> DataFrame:
    e, p = table(spark, sf, "events"), table(spark, sf, "pages")
    own = {
        "ts": F.col("ts").cast("string"), "user_id": F.col("user_id").cast("string"), "value": F.col("value").cast("string"), "event_type": F.col("event_type"),
        "props": F.col("props"), "ip": _ip(), "digest": F.sha2("props", 256),
    }
    theirs = {"url": F.col("url"), "host": F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1)}
    pairs = lambda columns: F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("v")) for n, c in columns.items()))).alias("p")
    return e.select("event_id", pairs(own)).unionByName(p.select(F.col("page_id").alias("event_id"), pairs(theirs))).select("event_id", "p.name", "p.v")


@query(f"SELECT event_id, name, {_LABELS} AS label FROM {_VALUES}")
def q33_classify_values(spark, sf):
    return _values(spark, sf).select("event_id", "name", classify(F.col("v")).alias("label"))


@query(f"SELECT name AS column, {_LABELS} AS label, count(*) AS count FROM {_VALUES} WHERE name NOT IN ('url', 'host', 'digest', 'ip') GROUP BY ALL")
def q34_profile_counts(spark, sf):
    return profile.label_counts(events(spark, sf), ["ts", "user_id", "value", "event_type", "props"])


@query("""SELECT name, max(octet_length(encode(coalesce(v, ''))))::BIGINT AS bytes FROM
(SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS name, unnest([doc_id::VARCHAR, text, lang, source, n_chars::VARCHAR]) AS v FROM documents) GROUP BY 1""")
def q35_max_len_bytes(spark, sf):
    return profile.sizes(lift(table(spark, sf, "documents")))


@query("""WITH c AS (SELECT user_id::VARCHAR AS value, count(*) AS count FROM events GROUP BY 1), t AS (SELECT * FROM c ORDER BY count DESC, value LIMIT 7)
SELECT value, count, false AS is_other FROM t UNION ALL SELECT 'other', (SELECT sum(count) FROM c)::BIGINT - (SELECT sum(count) FROM t)::BIGINT, true""")
def q36_dashboard_pie_other(spark, sf):
    return counts.panel_data(events(spark, sf), counts.Panel("user_id", "pie"))


_RANGES = [(0, 9, "AA"), (10, 49, "BB"), (60, 99, "CC"), (100, 131_071, "DD")]


@query(f"SELECT event_id, coalesce(country, '') AS country FROM events LEFT JOIN (VALUES {', '.join(map(str, _RANGES))}) r(low, high, country) ON user_id BETWEEN low AND high")
def q37_geo_range_join(spark, sf):
    ranges = spark.createDataFrame(_RANGES, "low bigint, high bigint, country string")
    found = enrich.range_join(table(spark, sf, "events"), F.col("user_id").cast("bigint"), ranges, "low", "high", ["country"])
    return found.select("event_id", F.coalesce("_hit.country", F.lit("")).alias("country"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')")
def q38_email_in_text(spark, sf):
    docs = lift(table(spark, sf, "documents"))
    return search.matches(docs, search.SearchQuery(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "regex", columns=("text",))).df.select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{1,3}(\.[0-9]{1,3}){3}')")
def q39_ipv4_in_text(spark, sf):
    docs = lift(table(spark, sf, "documents"))
    return search.matches(docs, search.SearchQuery(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", "regex", columns=("text",))).df.select("doc_id")


@query("SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'view'")
def q40_intersect_ids(spark, sf):
    pick = lambda kind: lineage.Selection.all(events(spark, sf)).pivot("event_type", kind).values("user_id")
    return pick("error").intersect(pick("view"))


_AFTER = f"""(SELECT event_id, raw, {{ordinal}} AS o, CASE WHEN {{ordinal}} = 4 THEN 'edited, "so"' ELSE event_type END AS event_type, ts, user_id, value, props FROM {{events}})"""


@query(f"""SELECT event_id, event_id || ',' || ts::VARCHAR || ',' || left(user_id::VARCHAR, 1) || repeat('*', greatest(length(user_id::VARCHAR) - 1, 0)) || ',' ||
  {_field('event_type')} || ',' || {_field('props')} || ',' || coalesce(c_mktsegment, '') AS line
FROM {_AFTER} LEFT JOIN customer ON c_custkey = user_id WHERE contains(raw, 'signup') OR o = 4""")
def q41_export_pipeline(spark, sf):
    frame = events(spark, sf, ordinal=True)
    chosen = frame.where(F.col(RAW).contains("signup") | (F.col(ORDINAL) == 4))
    made = edits.EditSet()
    made.set_cell(4, 3, 'edited, "so"', "before")
    customers = lift(table(spark, sf, "customer"), ["c_custkey", "c_mktsegment"], "c_custkey")
    how = export.Transform(
        edits=made, redact=[redaction.parse_rule("user_id=partial:1"), redaction.parse_rule("value=drop")],
        enrich=[enrich.Lookup("user_id", customers, "c_custkey", ("c_mktsegment",))],
    )
    done = export.lines(chosen, Dialect(), how).select(ORDINAL, F.col("line").cast("string").alias("line"))
    return done.join(frame.df.select(ORDINAL, "event_id"), ORDINAL).select("event_id", "line")


@query("""SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS before, lead(event_id) OVER (ORDER BY event_id) AS after
FROM events WHERE event_type = 'error' AND user_id = 17""")
def q42_next_prev_match(spark, sf):
    from pyspark.sql import Window

    found = lineage.Selection.all(events(spark, sf)).pivot("event_type", "error").pivot("user_id", "17").frame.df
    order = Window.partitionBy("user_id").orderBy("event_id")
    return found.select("event_id", F.lag("event_id").over(order).alias("before"), F.lead("event_id").over(order).alias("after"))


@query("""SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS before, lead(event_id) OVER (ORDER BY event_id) AS after
FROM events WHERE event_type = 'error'""")
def q49_next_prev_of_all_matches(spark, sf):
    found = lineage.Selection.all(events(spark, sf)).pivot("event_type", "error").frame.df
    return search.beside(found.select("event_id"), "event_id")


@query("SELECT count(*) FILTER (contains(raw, 'error')) AS n, count(*) FILTER (contains(raw, 'error') AND {ordinal} <= 500) AS rank, max({ordinal}) FILTER (contains(raw, 'error') AND {ordinal} < 500)::BIGINT AS before, min({ordinal}) FILTER (contains(raw, 'error') AND {ordinal} > 500)::BIGINT AS after FROM {events}")
def q43_match_navigation(spark, sf):
    r = search.neighbours(search.matches(events(spark, sf, ordinal=True), search.SearchQuery("error")), 500)
    return spark.createDataFrame([(r["n"], r["rank"], r["before"], r["after"])], "n bigint, rank bigint, before bigint, after bigint")


@query("SELECT event_id FROM events WHERE event_type <> 'error'")
def q44_complement(spark, sf):
    frame = events(spark, sf, ordinal=True)
    return lineage.complement(frame, search.matches(frame, search.SearchQuery("error", "exact", columns=("event_type",)))).df.select("event_id")


@query("SELECT (floor(epoch(ts) / 86400) * 86400)::BIGINT AS bucket, count(*) AS count FROM events GROUP BY 1")
def q45_rebucket(spark, sf):
    return timeline.rebucket(timeline.buckets(events(spark, sf), "ts", 3600), 86_400)


@query(f"""SELECT count(*) AS records, 2::BIGINT AS expected_fields, 0::BIGINT AS mismatches, max(octet_length(encode(item_id::VARCHAR || ',' || {_field('text')})))::BIGINT AS max_bytes FROM benchmark""")
def q46_file_stats(spark, sf):
    from ..session import Case
    from .evidence import written

    s = Case(spark, written(spark, sf, "benchmark", "item_id", ["item_id", "text"]), use_index=False).count()
    return spark.createDataFrame([(s.records, s.expected_fields, s.field_mismatches, s.max_record_bytes)], "records bigint, expected_fields bigint, mismatches bigint, max_bytes bigint")


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def q47_iso_format(spark, sf):
    return table(spark, sf, "events").select("event_id", timestamps.iso(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("iso"))


@query("SELECT split_part(url, '/', 3) AS value, count(*) AS count FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def q48_count_derived_column(spark, sf):
    pages = table(spark, sf, "pages").withColumn("url.host", F.split_part("url", F.lit("/"), F.lit(3)))
    return counts.value_counts(Frame(pages, ("page_id", "url"), ("url.host",)), "url.host", counts.TOP_PANEL)
