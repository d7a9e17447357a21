"""Whole investigations over small files, and the command line."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from caselens import cli
from caselens.functions import redaction
from caselens.operators import counts, edits, enrich, export, lineage, manifest, profile, search, timeline
from caselens.operators.frames import ORDINAL, RAW, Frame, lift, with_ordinal
from caselens.session import Case, lookup_table
from caselens.sources import synth
from caselens.sources.dialect import Dialect
from caselens.sources.evidence import Source, SourceChanged
from caselens.sources.index import Index


@pytest.fixture(autouse=True)
def cache(tmp_path, monkeypatch):
    monkeypatch.setenv("CASELENS_CACHE", str(tmp_path / "cache"))
    monkeypatch.setattr(cli, "spark_session", lambda: __import__("pyspark.sql", fromlist=["SparkSession"]).SparkSession.getActiveSession())


def put(path, text) -> str:
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def found(case_or_frame, query) -> list[int]:
    frame = case_or_frame.frame if isinstance(case_or_frame, Case) else case_or_frame
    return sorted(r[0] for r in search.matches(frame, query).df.select(ORDINAL).collect())


def test_searches(spark, tmp_path):
    case = Case(spark, put(tmp_path / "a.csv", 'ip,host\n10.0.0.1,"Evil, Inc"\n10.0.0.10,evil.example\n,10.0.0.1\nx\n"10.0.0.1","a ""b"""\n'))
    q = search.SearchQuery
    assert found(case, q("10.0.0.1")) == [0, 1, 2, 4]
    assert found(case, q('"Evil, Inc"')) == [0] and found(case, q("Evil, Inc", columns=("host",))) == [0]
    assert found(case, q('a "b"', columns=("host",))) == [4] and found(case, q('a ""b""')) == [4]
    assert found(case, q("EVIL", case_insensitive=True)) == [0, 1]
    assert found(case, q("10.0.0.1", "exact", columns=("ip",))) == [0, 4]
    assert found(case, q("10.0.0.1", "exact")) == [0, 2, 4]
    assert found(case, q("EVIL.example", "exact", True, ("host",))) == [1]
    assert found(case, q("", "exact", columns=("ip",))) == [2]
    assert found(case, q("", "exact", columns=("host",))) == []  # a missing field is not an empty one
    assert found(case, q("evil", invert=True)) == [0, 2, 3, 4]
    assert found(case, q("zzz", columns=("host",), invert=True)) == [0, 1, 2, 3, 4]
    assert found(case, q(r"^10\.0\.0\.1,", "regex")) == [0] and found(case, q("^evil", "regex", columns=("host",))) == [1]
    assert found(case, q("10.0.0.1", columns=("1",))) == [2]
    for bad in (q(""), q("(", "regex"), q("a", "fuzzy"), q("a", columns=("none",)), q("a", columns=("7",))):
        with pytest.raises(ValueError):
            found(case, bad)
    assert search.OrdinalRange.of("1_0:2,0") == search.OrdinalRange(10, 20)
    total, first = search.first_matches(case.frame, q("10"), 2)
    assert total == 4 and [r[ORDINAL] for r in first.df.collect()] == [0, 1]
    hits = search.matches(case.frame, q("10"))
    assert search.neighbours(hits, 2) == {"n": 4, "rank": 3, "before": 1, "after": 4, "first": 0, "last": 4}
    assert [search.select(hits, k) for k in range(5)] == [0, 1, 2, 4, None]


def test_lineage(spark, tmp_path):
    case = Case(spark, put(tmp_path / "a.csv", "ts,host,n\n" + "".join(f"2026-01-0{1 + k % 9} 00:00:0{k % 10},h{k % 3},{k}\n" for k in range(90))))
    case.find(search.SearchQuery("h1", columns=("host",)))
    case.filter_range("ts", 1767225600 + 1, 1767225600 + 3 * 86400, 86400)
    assert case.selection.count() == sum(k % 3 == 1 and k % 9 < 3 for k in range(90))
    steps = case.selection.operations()
    assert [s["op"] for s in steps] == ["search", "time_range"] and steps[0]["matches"] == 30 and steps[1]["from"] == "2026-01-01T00:00:00Z"
    depth = case.selection
    case.pivot("n", "10")
    assert case.selection.count() == 1
    assert case.pop_selection() is depth and case.revert_to(1).count() == 30 and case.clear_selection().count() == 90
    step = case.find(search.SearchQuery("h2"))
    step.cancel()
    for refused in (lambda: case.find(search.SearchQuery("x")), case.analysed, lambda: case.export(tmp_path / "o.csv")):
        with pytest.raises(lineage.Incomplete):
            refused()
    whole = lineage.Selection.all(case.frame)
    both = lineage.intersect(whole.pivot("host", "h1"), whole.narrow(search.OrdinalRange(0, 9)))
    assert sorted(r[0] for r in both.df.select(ORDINAL).collect()) == [1, 4, 7]
    assert lineage.complement(case.frame, both).df.count() == 87


def test_counts_and_timeline(spark, tmp_path):
    text = "ts,host\n" + "a,x\n2026-09-21 10:00:00,x\n2026-09-21 10:00:59,y\n2026-09-21 10:03:00,\n1790000000\n,z\n"
    case = Case(spark, put(tmp_path / "a.csv", text))
    totals, top = case.values("host")
    assert (totals.counted, totals.empty, totals.distinct) == (6, 2, 3)
    assert [tuple(r) for r in top.collect()] == [("x", 2), ("y", 1), ("z", 1)]
    assert [(r.value, r["count"], r.share) for r in counts.value_shares(case.frame, "host", 1).collect()] == [("x", 2, 2 / 6)]
    other = {r.value: r["count"] for r in counts.with_other(case.frame, "host", 1).collect()}
    assert other == {"x": 2, "other": 4}
    sums, width, found_ = case.timeline("ts", 60)
    assert (sums.counted, sums.parsed, sums.unparsed) == (6, 4, 2) and width == 60
    rows = [r["count"] for r in timeline.buckets(search.matches(case.frame, search.SearchQuery("2026")), "ts", 60).collect()]
    assert rows == [2, 0, 0, 1]
    assert counts.approximate_distinct(case.frame, "host").first()[0] == 3
    nothing = search.matches(case.frame, search.SearchQuery("nowhere"))
    assert timeline.buckets(nothing, "ts", 60).count() == 0 and counts.totals(nothing, "host").first().asDict() == {"counted": 0, "empty": 0, "distinct": 0}


def test_profile_and_dashboard(spark, tmp_path):
    header, lines = synth.table(spark, "narrow", 700, 3)
    path = put(tmp_path / "n.csv", ",".join(header) + "\n" + "".join(r.line for r in lines.orderBy("id").collect()))
    case = Case(spark, path)
    whole = {c["name"]: c for c in case.profile(whole=True)}
    want = {
        "timestamp": "timestamp", "src_ip": "ipv4", "dst_ip": "ipv4", "dst_port": "port", "proto": "categorical", "host": "domain", "path": "categorical", "status": "http_status",
        "bytes": "integer", "user": "text", "action": "categorical", "user_agent": "categorical", "sha256": "sha256",
    }
    assert {n: c["detected"] for n, c in whole.items()} == want
    assert whole["sha256"]["distinct"] == 700 and whole["sha256"]["max_len"] == 64 and len(whole["host"]["examples"]) == 3
    assert [p.column for p in counts.panels(list(whole.values()))] and len(case.dashboard()) <= 6
    assert len(profile.sample_ranges(100_000)) == 49 and profile.sample_ranges(2000) == [(0, 2000)]
    assert case.quick_profile()[0]["sampled"] == 700


def test_enrichment(spark, tmp_path):
    table = put(tmp_path / "assets.csv", "ip,owner,site\n10.0.0.1,old,a\n10.0.0.2,bob,b\n10.0.0.1,new,c\n 10.0.0.9,pad,d\n")
    frame, told = lookup_table(spark, table, "ip")
    assert told["records"] == 4 and told["lookup"]["values"] == ["owner", "site"]
    case = Case(spark, put(tmp_path / "a.csv", "src,host\n 10.0.0.1 ,www.example.co.uk\n10.0.0.9,nowhere\n10.0.0.2\n"))
    rule = enrich.Lookup("src", frame, "ip", (), told)
    assert rule.duplicates() == 1
    ranges = spark.createDataFrame([("10.0.0.0", "10.0.0.1", "AA"), ("10.0.0.2", "10.3.0.0", "BB"), ("2001:db8::", "2001:db8::ff", "CC")], "low string, high string, country string")
    case.enrich([rule, enrich.Domain("host"), enrich.Geo("src", ranges, ("country",))])
    got = case.analysed()
    assert got.derived == ("src.owner", "src.site", "host.registrable", "host.suffix", "host.subdomain", "src.country")
    rows = [[r[d] for d in got.derived] for r in got.df.orderBy(ORDINAL).collect()]
    assert rows == [["new", "c", "example.co.uk", "co.uk", "www", "AA"], ["", "", "", "", "", "BB"], ["bob", "b", "", "", "", "BB"]]
    assert [tuple(r) for r in case.values("host.suffix")[1].collect()] == [("co.uk", 1)]
    with pytest.raises(ValueError):
        lineage.Selection.all(got).pivot("src.owner", "new")
    six = Case(spark, put(tmp_path / "b.csv", "src,n\n2001:db8::7,1\n::1,2\n"))
    six.enrich([enrich.Geo("src", ranges, ("country",))])
    assert [r["src.country"] for r in six.analysed().df.orderBy(ORDINAL).collect()] == ["CC", ""]
    assert enrich.parse_lookup("src=C:\\x.csv:ip:a,b") == ("src", "C:\\x.csv", "ip", ("a", "b")) and enrich.parse_lookup("s=f:k") == ("s", "f", "k", ())


def test_export_keeps_bytes(spark, tmp_path):
    data = b'\xef\xbb\xbfid,text\r\n1,"two\nlines"\r\n\r\n2,"a""b"\r3,last'
    case = Case(spark, put(tmp_path / "a.csv", data))
    told = case.export(tmp_path / "o.csv")
    assert (tmp_path / "o.csv").read_bytes() == b'id,text\n1,"two\nlines"\n2,"a""b"\n3,last\n'
    assert told["output"]["content"] == "raw-records" and told["selection"] == {"kind": "all"} and told["source"]["records"] == 3
    with pytest.raises(FileExistsError):
        case.export(tmp_path / "o.csv")
    case.find(search.SearchQuery("lines"))
    told = case.export(tmp_path / "o.csv", header=False, terminator="\r\n", force=True)
    assert (tmp_path / "o.csv").read_bytes() == b'1,"two\nlines"\r\n' and told["selection"] == {"kind": "matches", "records": 1}
    ok = manifest.verify(tmp_path / "o.csv")
    assert ok["ok"] and ok["scope"] == "output+source"
    (tmp_path / "o.csv").write_bytes(b"changed")
    assert not manifest.verify(tmp_path / "o.csv", skip_source=True)["ok"]
    for target in (tmp_path / "a.csv", tmp_path / "link.csv"):
        if not target.exists():
            target.symlink_to(tmp_path / "a.csv")
        with pytest.raises(ValueError, match="source"):
            case.export(target, force=True)
    (tmp_path / "a.csv").write_bytes(data + b"\n4,new")
    with pytest.raises(SourceChanged):
        case.export(tmp_path / "p.csv")
    assert not (tmp_path / "p.csv").exists() and not list(tmp_path.glob(".*partial"))


def test_transformed_export(spark, tmp_path):
    case = Case(spark, put(tmp_path / "a.csv", 'ts,user,ip,note,free\n1,alice,10.1.2.3,topsecret,"kept, ""as"" is"\n2,,x,,\n3,bob\n'))
    lookup, told = lookup_table(spark, put(tmp_path / "t.csv", "user,team\nalice,red\ncarol,blue\n"), "user")
    case.edit(2, "user", "carol")
    case.edit(2, "free", "wide, now")
    case.edit(0, "ts", "1")  # the source's own value
    case.mark(0, 3)
    case.save_version(tmp_path / "v.json", "v1")
    again = Case(spark, tmp_path / "a.csv")
    again.open_version(tmp_path / "v.json")
    assert again.edits.cells.keys() == {(2, 1), (2, 4)} and again.edits.marks[0]["color"] == 3
    again.enrich([enrich.Lookup("user", lookup, "user", ("team",), told)])
    again.redact_on_export([redaction.parse_rule(r) for r in ("user=hmac:8", "ip=ip:16", "note=drop")])
    done = again.export(tmp_path / "o.csv", key=b"k3y")
    import hmac

    code = lambda v: hmac.new(b"k3y", v, hashlib.sha256).hexdigest()[:8]
    assert (tmp_path / "o.csv").read_text() == (
        f'ts,user,ip,free,user.team\n1,{code(b"alice")},10.1.0.0,"kept, ""as"" is",red\n2,,[REDACTED],,\n3,{code(b"carol")},,"wide, now",blue\n'
    )
    assert done["output"]["content"] == "records-edited-redacted-enriched"
    assert [o["op"] for o in done["operations"]] == ["edit", "enrich", "redact"]
    cells = done["operations"][0]["edits"]["cells"]
    assert "value" not in cells[0] and cells[1]["value"] == "wide, now" and "k3y" not in json.dumps(done)
    shown = again.rows_shown(2, 1).df.first()
    assert shown["user"] == "carol" and shown["user.team"] == "blue"
    other = Case(spark, put(tmp_path / "b.csv", "a,b\n1,2\n"))
    with pytest.raises(ValueError):
        other.open_version(tmp_path / "v.json")
    with pytest.raises(ValueError):
        edits.EditSet.from_json('{"caselens_edits": 1}')
    export.write_dataset(case.frame, case.dialect, str(tmp_path / "parts"))
    assert spark.read.text(str(tmp_path / "parts")).count() == 3


def test_index_and_cache(spark, tmp_path):
    path = put(tmp_path / "a.csv", "a,b\n" + "".join(f"{k},x\n" for k in range(50)) + 'y\n"z"q,1\n"open,2')
    case = Case(spark, path, Dialect())
    index = case.build_index()
    s = index.stats
    assert (s.records, s.expected_fields, s.field_mismatches, s.lenient_quotes, s.unterminated_quotes) == (53, 2, 2, 1, 1)
    assert index.digests["sha256"] == hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest()
    assert Case(spark, path, Dialect()).from_index
    assert not Case(spark, path, Dialect(";"), index_path=case.index_path).from_index
    stored = case.index_path.read_text()
    case.index_path.write_text(stored.replace("53", "54"))
    with pytest.raises(ValueError):
        Index.load(case.index_path)
    assert Case(spark, path, Dialect()).notes
    store = case.cache()
    store.put_count("a", {"top": [1, 2, 3], "distinct": 9})
    store.save()
    assert case.cache().count("a", 2)["top"] == [1, 2] and case.cache().count("a", 5) is None
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    assert Case(spark, path).cache().count("a", 2) is None


def test_source_guards(tmp_path):
    with pytest.raises(ValueError):
        Source(tmp_path)
    source = Source(put(tmp_path / "e.csv", ""))
    assert source.size == 0 and source.digest()["sha256"] == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        source.digest(("md4",))


def test_empty_and_headerless_files(spark, tmp_path):
    assert Case(spark, put(tmp_path / "e.csv", "")).frame.df.count() == 0
    case = Case(spark, put(tmp_path / "n.csv", "1,2\n3,4,5\n"), names=["n"])
    assert case.frame.names == ("n", "col1") and case.rows(1, 1).df.first()["n"] == "3" and case.go_to(99) == 1


def test_ordinals_of_tables(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    rows = with_ordinal(df, "k").collect()
    assert all(r.k == r[ORDINAL] for r in rows) and len(rows) == 1000
    assert with_ordinal(df.limit(0), "k").count() == 0
    lifted = lift(spark.createDataFrame([(1, 'a"b', None)], "a int, b string, c string"))
    assert lifted.df.first()[RAW] == '1,"a""b",'
    dotted = Frame(spark.createDataFrame([("x",)], "`a.b` string"), ("a.b",))
    assert found_values(counts.value_counts(dotted, "a.b")) == [("x", 1)]


def found_values(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def run(capsys, *arguments: str) -> tuple[int, dict]:
    code = cli.main(["--json", *arguments])
    out = capsys.readouterr().out
    return code, json.loads(out) if out else {}


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "g.csv")
    assert run(capsys, "gen", "-o", path, "--rows", "200", "-p", "demo")[1]["rows"] == 200
    code, told = run(capsys, "info", path, "-n", "2")
    assert code == 0 and told["header"] == synth.NARROW and len(told["records"]) == 2
    assert run(capsys, "count", path)[1]["records"] == 200
    assert run(capsys, "index", path)[1]["sha256"] == hashlib.sha256((tmp_path / "g.csv").read_bytes()).hexdigest()
    assert run(capsys, "rows", path, "-s", "5", "-n", "3")[1]["records"][0]["record"] == 5
    assert "raw" in run(capsys, "rows", path, "-n", "1", "--raw")[1]["records"][0]
    code, told = run(capsys, "search", path, "tcp", "--exact", "-c", "proto", "-n", "1")
    n = told["matches"]
    assert told["query"] == {"pattern": "tcp", "kind": "exact", "case_insensitive": False, "columns": [4], "invert": False} and len(told["records"]) == 1
    first, second = (run(capsys, "freq", path, "-c", "proto")[1] for _ in range(2))
    assert first["top"][0] == {"value": "tcp", "count": n, "share": n / 200} and not first["cached"] and second["cached"]
    assert run(capsys, "freq", path, "-c", "host.registrable", "--domain", "host", "-n", "3")[1]["distinct"] > 1
    told = run(capsys, "timeline", path, "-c", "timestamp", "-b", "1m")[1]
    assert sum(b["count"] for b in told["buckets"]) == 200 == told["parsed"]
    assert run(capsys, "profile", path)[1]["columns"][0]["detected"] == "timestamp"
    out = str(tmp_path / "o.csv")
    code, told = run(capsys, "export", path, "-o", out, "-s", "tcp", "--exact", "-c", "proto", "--redact", "user=mask", "--redact", "src_ip=ip:8")
    assert code == 0 and told["records"] == n and told["operations"][0]["matches"] == n
    assert run(capsys, "verify", out)[0] == 0 and run(capsys, "verify", out, "--skip-source", "--require-source")[0] == 1
    assert run(capsys, "export", path, "-o", out)[0] == 1  # it exists
    assert run(capsys, "export", path, "-o", str(tmp_path / "r.csv"), "--range", "10:5")[1]["selection"] == {"kind": "range", "first": 10, "count": 5}
    assert run(capsys, "export", path, "-o", path, "-f")[0] == 1
    assert run(capsys, "search", path, "(", "-r")[0] == 1 and run(capsys, "hash", path, "--algo", "none")[0] == 1
    assert run(capsys, "hash", path)[1]["size"] == (tmp_path / "g.csv").stat().st_size
    assert cli.main(["count", path]) == 0 and "records: 200" in capsys.readouterr().out
    with pytest.raises(SystemExit) as usage:
        cli.main(["freq", path])
    assert usage.value.code == 2


@pytest.mark.parametrize("name", synth.PROFILES)
def test_generated_profiles(spark, tmp_path, name):
    told = synth.generate(spark, tmp_path / "g.csv", name, rows=60, seed=2)
    again = synth.generate(spark, tmp_path / "h.csv", name, rows=60, seed=2)
    assert (tmp_path / "g.csv").read_bytes() == (tmp_path / "h.csv").read_bytes() and told["bytes"] == again["bytes"] == (tmp_path / "g.csv").stat().st_size
    stats = Case(spark, tmp_path / "g.csv", Dialect()).count()
    assert stats.records == 60 and stats.unterminated_quotes == 0
    assert (stats.field_mismatches > 0) == (name == "ragged")


def test_columns_of_equal_names_are_kept_apart(spark, tmp_path):
    path = tmp_path / "twice.csv"
    path.write_text("a,a,b\n1,2,3\n4,5,6\n")
    case = Case(spark, path, use_index=False, header=True)
    assert len(case.frame.names) == 3 and case.frame.resolve("a") == "a"
    case.redact_on_export([redaction.parse_rule("b=mask:x")])
    case.export(tmp_path / "out.csv")
    assert (tmp_path / "out.csv").read_text() == "a,a,b\n1,2,x\n4,5,x\n"


def test_dataset_export_and_its_verification(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("id,name\n" + "".join(f"{k},n{k}\n" for k in range(500)))
    case = Case(spark, path, use_index=False)
    told = case.export_dataset(tmp_path / "parts")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*")))
    assert lines == path.read_text().partition("\n")[2] and told["output"]["records"] == 500
    assert manifest.verify(tmp_path / "parts")["ok"]
    next((tmp_path / "parts").glob("part-*")).write_text("changed")
    assert not manifest.verify(tmp_path / "parts")["ok"]


def test_evidence_by_uri_and_long_records(spark, tmp_path, monkeypatch):
    path = tmp_path / "long.csv"
    path.write_text('id,text\n1,"' + "x\n" * 50_000 + '"\n2,b\n3,"never closed\n4,d\n')
    for place in (path, f"file://{path}"):
        case = Case(spark, place, use_index=False)
        assert [r.id for r in case.frame.df.select("id").collect()] == ["1", "2", "3"]
        assert case.count().unterminated_quotes == 1
        assert case.source.digest() == Case(spark, path, use_index=False).source.digest()


def test_counts_of_bounded_memory(spark):
    rows = [(f"v{k % 7}",) for k in range(700)] + [(f"rare{k}",) for k in range(400)] + [("",), (None,)]
    frame = lift(spark.createDataFrame(rows, "v string").repartition(5))
    found, bound = counts.bounded_counts(frame, "v", capacity=50)
    got = {r.value: r["count"] for r in found.collect()}
    assert len(got) <= 50 and bound <= 1100 / 50 + 1
    assert all(100 - bound <= got[f"v{k}"] <= 100 for k in range(7))
    assert counts.bounded_counts(lift(frame.df.limit(0)), "v")[1] == 0
