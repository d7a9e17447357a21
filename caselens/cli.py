"""Command line: info, index, rows, search, export, verify, freq, timeline, profile, count, hash, gen."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .functions import formats, redaction, timestamps
from .functions.domains import SuffixList, default_list
from .operators import counts, enrich, manifest, profile, search, timeline
from .operators.frames import ORDINAL, RAW, col
from .operators.lineage import Selection
from .session import Case, lookup_table
from .sources import synth
from .sources.dialect import delimiter_of
from .sources.evidence import Source


def spark_session() -> SparkSession:
    conf = {"spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    builder = SparkSession.builder.appName("caselens").config(map=conf)
    if not os.environ.get("MASTER"):
        builder = builder.master("local[*]").config("spark.sql.shuffle.partitions", str(os.cpu_count() or 8))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def _shared(p: argparse.ArgumentParser, file: bool = True) -> None:
    if file:
        p.add_argument("file")
    p.add_argument("--json", action="store_true", default=argparse.SUPPRESS)


def _dialect(p: argparse.ArgumentParser) -> None:
    p.add_argument("-d", "--delimiter")
    p.add_argument("--no-quote", action="store_true")
    group = p.add_mutually_exclusive_group()
    group.add_argument("--header", action="store_true")
    group.add_argument("--no-header", action="store_true")
    p.add_argument("--names")
    p.add_argument("--index")


def _search(p: argparse.ArgumentParser, columns: bool = True, flag: bool = True) -> None:
    if flag:
        p.add_argument("-s", "--search")
    kind = p.add_mutually_exclusive_group()
    kind.add_argument("-r", "--regex", action="store_true")
    kind.add_argument("--exact", action="store_true")
    p.add_argument("-i", "--ignore-case", action="store_true")
    p.add_argument("-v", "--invert", action="store_true")
    p.add_argument("--threads", type=int, help="accepted; Spark decides")
    if columns:
        p.add_argument("-c", "--column", action="append")


def _enrichment(p: argparse.ArgumentParser) -> None:
    p.add_argument("--geoip", action="append", default=[], metavar="COL=PATH", help="an .mmdb file, or a CSV of low, high and more columns")
    p.add_argument("--domain", action="append", default=[])
    p.add_argument("--lookup", action="append", default=[], metavar="COL=PATH:KEY[:VALUES]")
    p.add_argument("--psl", help="a public suffix list")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="caselens", description="Investigate large delimited evidence files.")
    top.add_argument("--json", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, file: bool = True, dialect: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        _shared(p, file)
        if dialect:
            _dialect(p)
        return p

    command("info").add_argument("-n", type=int, default=10)
    p = command("index")
    p.add_argument("--hash", choices=("sha256", "blake3", "all", "none"), default="sha256")
    p = command("rows")
    p.add_argument("-s", "--start", type=formats.integer_of, default=0)
    p.add_argument("-n", type=formats.integer_of, default=20)
    p.add_argument("--raw", action="store_true")
    p = command("search")
    p.add_argument("pattern")
    p.add_argument("-n", type=int, default=20)
    _search(p, flag=False)
    p = command("export")
    p.add_argument("-o", "--output", required=True)
    _search(p)
    p.add_argument("--range")
    p.add_argument("--omit-header", action="store_true")
    p.add_argument("--dataset", action="store_true", help="write a folder of parts, each by the task that holds its records")
    p.add_argument("--crlf", action="store_true")
    p.add_argument("-f", "--force", action="store_true")
    p.add_argument("--redact", action="append", default=[], metavar="COL=METHOD[:PARAM]")
    p.add_argument("--hmac-key-file")
    p.add_argument("--edits")
    _enrichment(p)
    p = command("verify", dialect=False)
    p.add_argument("--manifest")
    p.add_argument("--source")
    p.add_argument("--skip-source", action="store_true")
    p.add_argument("--require-source", action="store_true")
    p = command("freq")
    p.add_argument("-c", "--column", required=True)
    p.add_argument("-n", type=int, default=20)
    _search(p, columns=False)
    _enrichment(p)
    p = command("timeline")
    p.add_argument("-c", "--column", required=True)
    p.add_argument("-b", "--bucket", default="auto")
    p.add_argument("--max-buckets", type=int, default=timeline.MAX_BUCKETS)
    p.add_argument("--year", type=int)
    _search(p, columns=False)
    command("profile").add_argument("--whole", action="store_true")
    command("count")
    command("hash", dialect=False).add_argument("--algo", choices=("sha256", "blake3", "all", "none"), default="all")
    p = command("gen", file=False, dialect=False)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-p", "--profile", choices=synth.PROFILES, default="narrow")
    group = p.add_mutually_exclusive_group(required=True)
    group.add_argument("--rows", type=formats.integer_of)
    group.add_argument("--size", type=formats.size_of)
    p.add_argument("--seed", type=int, default=1)
    return top


def _case(a: argparse.Namespace) -> Case:
    given = {}
    if a.delimiter:
        given["delimiter"] = delimiter_of(a.delimiter)
    if a.no_quote:
        given["quote"] = None
    if a.header or a.no_header:
        given["header"] = a.header
    return Case(spark_session(), a.file, names=a.names.split(",") if a.names else None, index_path=a.index, **given)


def _query(a: argparse.Namespace, pattern: str, columns: list[str] | None) -> search.SearchQuery:
    kind = "regex" if a.regex else "exact" if a.exact else "literal"
    return search.SearchQuery(pattern, kind, a.ignore_case, tuple(columns) if columns else None, a.invert)


def _rules(case: Case, a: argparse.Namespace) -> list[enrich.Rule]:
    rules: list[enrich.Rule] = []
    for spec in a.geoip:
        column, found, path = spec.partition("=")
        if not found:
            raise ValueError(f"--geoip {spec!r} is not COL=PATH")
        if path.lower().endswith(".mmdb"):
            rules.append(enrich.GeoDatabase(column, path))
            continue
        frame, told = lookup_table(case.spark, path, "0")
        rules.append(enrich.Geo(column, frame.df.select(*map(col, frame.names)), tuple(frame.names[2:]), told))
    suffixes = SuffixList.of(Path(a.psl).read_text().splitlines(), Path(a.psl).name) if a.psl else default_list()
    rules += [enrich.Domain(column, suffixes) for column in a.domain]
    for spec in a.lookup:
        column, path, key, values = enrich.parse_lookup(spec)
        frame, told = lookup_table(case.spark, path, key, values)
        rule = enrich.Lookup(column, frame, key, values, told)
        if n := rule.duplicates():
            print(f"note: {n} rows of {path} repeat a key; the last one holds", file=sys.stderr)
        rules.append(rule)
    return rules


def _selected(case: Case, a: argparse.Namespace, columns: list[str] | None = None) -> Selection:
    chosen = case.selection
    if a.search is not None:
        chosen = chosen.narrow(_query(a, a.search, columns))
    return chosen


def _records(df, names: list[str], raw: bool) -> list[dict]:
    wanted = [col(ORDINAL), col(RAW)] if raw else [col(ORDINAL), *map(col, names)]
    out = []
    for r in df.select(*wanted).collect():
        out.append({"record": r[0], "raw": bytes(r[1]).decode(errors="replace")} if raw else {"record": r[0], "fields": [v for v in r[1:] if v is not None]})
    return out


def _stats(stats) -> dict:
    held = vars(stats).copy()
    held.pop("complete")
    return held


def run(a: argparse.Namespace) -> tuple[dict, int]:
    """The result of a command as JSON data, and the exit code."""
    began = time.monotonic()
    if a.command == "gen":
        told = synth.generate(spark_session(), a.output, a.profile, a.rows, a.size, a.seed)
        return _timed(told, began, told["bytes"]), 0
    if a.command == "verify":
        told = manifest.verify(a.file, a.manifest, a.source, a.skip_source, a.require_source)
        return told, 0 if told["ok"] else 1
    if a.command == "hash":
        if a.algo == "none":
            raise ValueError("there is nothing to hash with")
        source = Source(a.file)
        digests = source.digest(("sha256", "blake3") if a.algo == "all" else (a.algo,))
        return _timed({"file": a.file, "size": source.size, "sha256": digests.get("sha256"), "blake3": digests.get("blake3")}, began, source.size), 0

    case = _case(a)
    for note in case.notes:
        print(f"note: {note}", file=sys.stderr)
    head = {"file": a.file, "size": case.source.size}
    if a.command == "info":
        rows = case.rows(0, a.n)
        sniffed = case.sniffed
        told = head | {
            "bom": sniffed.bom, "dialect": case.dialect.json(), "header": case.columns if case.dialect.header else None, "records": _records(rows.df, case.columns, False),
            "sniff": {"field_count": sniffed.field_count, "consistency": sniffed.consistency, "sampled_records": sniffed.sampled_records},
        }
        return told | {"elapsed_ms": (time.monotonic() - began) * 1000}, 0
    if a.command == "index":
        index = case.build_index({"all": ("sha256", "blake3"), "none": ()}.get(a.hash, (a.hash,)))
        told = head | {"dialect": case.dialect.json(), "index_path": str(case.index_path), "index_bytes": case.index_path.stat().st_size, "checkpoints": len(index.splits)}
        return _timed(told | _stats(index.stats) | {"sha256": index.digests.get("sha256"), "blake3": index.digests.get("blake3")}, began, case.source.size), 0
    if a.command == "count":
        return _timed(head | {"dialect": case.dialect.json()} | _stats(case.count()), began, case.source.size), 0
    if a.command == "rows":
        found = case.rows(a.start, a.n)
        split = case.index.locate(a.start)
        told = {"file": a.file, "start": a.start, "count": a.n, "from_index": case.from_index, "checkpoint": split and {"record": split.ordinal, "offset": split.start}}
        return told | {"records": _records(found.df, case.columns, a.raw), "elapsed_ms": (time.monotonic() - began) * 1000}, 0
    if a.command == "search":
        query = _query(a, a.pattern, a.column)
        total, first = search.first_matches(case.frame, query, a.n)
        told = head | {"query": query.manifest(case.frame), "matches": total, "complete": True, "from_index": case.from_index}
        return _timed(told | {"records": _records(first.df, case.columns, False)}, began, case.source.size), 0
    if a.command == "freq":
        rules = _rules(case, a)
        whole = a.search is None and not rules
        store = case.cache()
        name = enrich.enrich(case.frame, rules).resolve(a.column)
        told = store.count(name, a.n) if whole else None
        cached = told is not None
        if not cached:
            frame = enrich.enrich(_selected(case, a).frame, rules)
            sums = counts.totals(frame, name).first().asDict()
            top = [{"value": r.value, "count": r["count"], "share": r["count"] / max(1, sums["counted"])} for r in counts.value_counts(frame, name, a.n).collect()]
            told = sums | {"exact": True, "error_bound": 0, "top": top}
            if whole:
                store.put_count(name, told)
                store.save()
        return _timed({"file": a.file, "column": enrich.enrich(case.frame, rules).index(name), "column_name": name, "search": a.search, "cached": cached} | told, began, case.source.size), 0
    if a.command == "timeline":
        name, year = case.frame.resolve(a.column), a.year or timestamps.current_year()
        width = None if a.bucket == "auto" else timestamps.width_of(a.bucket)
        store = case.cache()
        told = store.timeline(name, year, width) if a.search is None and a.max_buckets == timeline.MAX_BUCKETS else None
        cached = told is not None
        if not cached:
            sums, used, found = timeline.timeline(_selected(case, a).frame, name, width, a.max_buckets, year)
            stamp = lambda s: None if s is None else timestamps.iso_text(s)
            rows = [{"start": stamp(r.bucket), "start_unix": r.bucket, "count": r["count"]} for r in found.collect()]
            told = vars(sums) | {"min": stamp(sums.min), "max": stamp(sums.max), "base_resolution_s": timeline.resolution(sums.min, sums.max), "bucket_s": used, "buckets": rows, "year": year}
            if a.search is None and a.max_buckets == timeline.MAX_BUCKETS:
                store.put_timeline(name, told)
                store.save()
        told = {k: v for k, v in told.items() if k != "year"}
        return {"file": a.file, "column": case.frame.index(name), "column_name": name, "search": a.search, "cached": cached} | told | {"elapsed_s": time.monotonic() - began}, 0
    if a.command == "profile":
        store = case.cache()
        found = None if a.whole else store.profile()
        cached = found is not None
        if not cached:
            columns = profile.profile(case.frame, a.whole)
            found = {"columns": columns, "sampled_records": columns[0]["sampled"] if columns else 0}
            if not a.whole:
                store.put_profile(found)
                store.save()
        told = {"file": a.file, "sampled_records": found["sampled_records"], "spans_file": True, "from_index": case.from_index, "cached": cached, "columns": found["columns"]}
        return told | {"elapsed_ms": (time.monotonic() - began) * 1000}, 0
    if a.command == "export":
        return _export(case, a, began), 0
    raise ValueError(f"unknown command {a.command!r}")


def _export(case: Case, a: argparse.Namespace, began: float) -> dict:
    if a.range and a.search is not None:
        raise ValueError("--range and --search exclude each other")
    key = None
    if a.hmac_key_file:
        key = Path(a.hmac_key_file).read_bytes().rstrip(b"\r\n")
    elif os.environ.get("CASELENS_HMAC_KEY"):
        key = os.environ["CASELENS_HMAC_KEY"].encode()
    case.source.guard(a.output, manifest.path_for(a.output))
    if a.edits:
        case.open_version(a.edits)
    case.enrich(_rules(case, a))
    case.redact_on_export([redaction.parse_rule(r) for r in a.redact])
    redaction.check(case.redactions, key)
    case.selection = case.selection.narrow(search.OrdinalRange.of(a.range)) if a.range else _selected(case, a, a.column)
    end = "\r\n" if a.crlf else "\n"
    told = case.export_dataset(a.output, key, end, a.force) if a.dataset else case.export(a.output, key, not a.omit_header, end, a.force)
    out = told["output"]
    return {
        "output": a.output, "manifest": str(manifest.path_for(a.output)), "records": out["records"], "bytes": out["size"], "sha256": out["sha256"],
        "source_sha256": told["source"]["sha256"], "selection": told["selection"], "operations": told["operations"], "elapsed_s": time.monotonic() - began,
    }


def _timed(told: dict, began: float, size: int) -> dict:
    took = time.monotonic() - began
    return told | {"elapsed_s": took, "throughput_mib_s": size / (1 << 20) / max(took, 1e-9)}


def show(told: dict) -> str:
    """A result for people: scalars as lines, lists as rows."""
    lines = []
    for key, value in told.items():
        if isinstance(value, list):
            lines.append(f"{key}:")
            for item in value:
                if isinstance(item, dict) and "fields" in item:
                    lines.append(f"  {formats.thousands(item['record'])}  " + " | ".join(item["fields"]))
                else:
                    lines.append("  " + ("  ".join(f"{v}" for v in item.values()) if isinstance(item, dict) else str(item)))
        elif isinstance(value, int) and not isinstance(value, bool):
            lines.append(f"{key}: {formats.thousands(value)}")
        elif key == "elapsed_s":
            lines.append(f"elapsed: {formats.duration(value)}")
        else:
            lines.append(f"{key}: {value}")
    return "\n".join(lines)


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        told, code = run(a)
    except (ValueError, OSError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    print(json.dumps(told, ensure_ascii=False, default=str) if a.json else show(told))
    return code


__all__ = ["main", "parser", "run"]

if __name__ == "__main__":
    sys.exit(main())
