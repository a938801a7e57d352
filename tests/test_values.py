"""Small tables of expected values, invariants, and plans."""

import io
import random
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.fixtures import table
from millrace.functions import codec, html, text
from millrace.operators import activity, jobs, parcels, requests
from millrace.plans import parcels as plans
from millrace.sources import files

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column).first()[0]


@pytest.mark.parametrize("raw, amount, reason", [("1,234.56", 1234.56, None), ("￥100", 100.0, None), ("¥1 000.50", 1000.5, None), ("1.005", 1.01, None), ("-3", None, "negative"), ("1.2.3", None, "dots"), ("x", None, "not_numeric"), ("", None, "empty"), (None, None, "empty")])
def test_money(spark, raw, amount, reason):
    row = text.clean_money(spark.createDataFrame([(raw,)], "raw string"), "raw").first()
    assert (row.amount and float(row.amount)) == amount and row.reason == reason


@pytest.mark.parametrize("raw, out", [("第 1 章", "第1章"), ("版本 V2", "版本V2"), ("使用 Python 语言", "使用 Python 语言"), ("hello  world", "hello world")])
def test_spacing(spark, raw, out):
    assert one(spark, text.tidy_spacing(F.col("t")), t=raw) == out


def test_spacing_takes_one_pass(spark):
    """The passes that were made before, again and again, on texts of all kinds of neighbours."""
    cjk, punct, rng = f"[{text.CJK}]", f"[{text.PUNCT}]", random.Random(9)
    gaps = [
        rf" (?<={cjk} ) *(?={cjk})",
        rf" +(?={punct})| (?<={punct} ) *",
        rf" (?<={cjk} ) *(?=\p{{Nd}})| (?<=\p{{Nd}} ) *(?={cjk})",
        rf" (?<={cjk} ) *(?=[A-Za-z]{{1,4}}(?![A-Za-z]))| (?<=(?<![A-Za-z])[A-Za-z]{{1,4}} ) *(?={cjk})",
    ]
    texts = ["".join(rng.choice(["中", "文", "，", "'", "a", "bc", "defgh", "7", " ", " ", "  ", "\u3000", "-", "\n"]) for _ in range(40)) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    want = F.regexp_replace("t", text.ODD_SPACE, " ")
    for gap in gaps * 3:
        want = F.regexp_replace(want, gap, "")
    rows = frame.select(text.tidy_spacing(F.col("t")).alias("got"), F.regexp_replace(want, " {2,}", " ").alias("want"))
    assert all(r.got == r.want for r in rows.collect())
    plan = frame.select(text.tidy_spacing(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 3


def test_wrapped_tokens_look_back_only_at_white_space(spark):
    token = "QUJD" * 40
    rows = [(1, f"{token[:76]}\n {token[76:152]}\r\n\t{token[152:]} x"), (2, f"{token[:60]}\n{token[60:]}"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = codec.b64_sweep(docs, wrapped=True)
    assert [(r.doc_id, r.token) for r in found.orderBy("doc_id", "token").collect()] == [(1, token), (2, token[:60]), (2, token[60:])]
    assert "(?=[ \\t\\r\\n])(?<=" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("raw, out", [("exam-\nple", "example"), ("你好\n世界", "你好世界"), ("结束。\n下一句", "结束。\n下一句"), ("a\nb", "a b"), ("", "")])
def test_unwrap(spark, raw, out):
    assert one(spark, text.unwrap_soft_lines(F.col("t")), t=raw) == out


def test_timestamps(spark):
    rows = text.normalise_timestamps(spark.createDataFrame([("1754249288",), ("1754249288000",), ("nope",), (None,)], "raw string"), "raw").collect()
    assert rows[0].utc == "2025-08-03 19:28:08" and rows[0].local == "2025-08-04 03:28:08"
    assert rows[1].is_ms and rows[1].epoch_s == 1754249288
    assert rows[2].error == "unparseable" and rows[3].error == "empty"


def test_relative_age(spark, tmp_path):
    ages = spark.createDataFrame([(0,), (59,), (-59,), (60,), (-7200,), (40_000_000,), (None,)], "s long").select(text.relative_age(F.col("s")), text.relative_age(F.col("s"), ("分钟", "小时", "天", "个月"), moment=False)).collect()
    assert [r[0] for r in ages[:6]] == ["刚刚", "刚刚", "即将", "1分钟前", "2小时后", "1年前"]
    assert [r[1] for r in ages] == [None, None, None, "1分钟前", "2小时后", "15个月前", None]
    # the query's SQL has no word for less than a minute
    seconds = spark.createDataFrame([(1706659200 - s,) for s in (35, -20, 61, 40_000_000)], "s long")
    seconds.select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    assert {tuple(r) for r in entry.queries()["t16_relative_age"](spark, str(tmp_path)).collect()} == {(None, 2), ("1分钟前", 1), ("15个月前", 1)}


def test_escapes():
    assert codec.unescaped("\\u4f60\\u597d") == "你好"
    assert codec.unescaped("\\\\u4f60") == "你"
    assert codec.unescaped("\\u{1f600} %u4f60 U+0041 &#65; &#x42;") == "😀 你 A A B"
    assert codec.unescaped("\\ud83d\\ude00") == "😀"
    with pytest.raises(ValueError):
        codec.unescaped("\\u{110000}", "es6")
    assert codec.unescaped("\\U0001F600 U+41 xU+41 \\\\u{41} \\u{00000041}") == "😀 A xU+41 A A"


def test_escape_styles(spark):
    rows = spark.createDataFrame([("né 你😀",), ("plain\nASCII",), ("",), (None,)], "v string")
    told = {style: [r[0] for r in rows.select(codec.escaped(F.col("v"), style)).collect()] for style in codec.STYLES}
    assert told["backslash_u"] == ["n\\u00e9 \\u4f60\\U0001f600", "plain\nASCII", "", None]
    assert told["u_plus"][0] == "nU+00e9 U+4f60U+1f600" and told["html_entity"][0] == "n&#xe9; &#x4f60;&#x1f600;"
    assert told["percent_u"][0] == "n%u00e9 %u4f60\\U0001f600"
    assert rows.select(codec.escaped(F.col("v"), "html_entity", True)).first()[0] == "n&#xE9; &#x4F60;&#x1F600;"
    for style in ("backslash_u", "html_entity", "percent_u"):
        assert codec.unescaped(told[style][0]) == "né 你😀"
    job = codec.escape_job(rows.withColumn("k", F.length("v")), "k", "v").filter("k = 5").first()
    assert (job.escaped_chars, job.input_chars, job.output_chars) == (3, 5, 24)
    with pytest.raises(ValueError):
        codec.escaped(F.col("v"), "es6")


def test_line_dedupe_without_ids(spark):
    docs = spark.createDataFrame([(None, "x\ny"), (1, "y\r\nz\ny"), (2, None), (3, "x\ny\nz"), (4, "b\n"), (4, "b\na")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.dropped) for r in text.corpus_line_dedupe(docs).collect()}
    assert got[None] == ("x\ny", 0) and got[1] == ("z", 2) and got[2] == ("", 0) and got[3] == ("", 3) and len(got) == 5


def test_regex(spark):
    docs = spark.createDataFrame([(1, "a@b c@d"), (2, None)], "doc_id long, text string")
    assert text.replace_some(docs, r"(\w)@(\w)", "$2.$1", 1).orderBy("doc_id").first().text == "b.a c@d"
    spans = text.grep(docs, r"(?P<x>\w)@", "", 1).collect()
    assert [(s.start, s.end, s.groups[0].name) for s in spans] == [(0, 2, "x")]
    with pytest.raises(ValueError):
        text.grep(docs, "a", "q")


def test_markdown():
    page = "<h2>T</h2><p>a <b>b</b> <a href='/x'>l</a><a href='javascript:1'>n</a></p><ul><li>1<ul><li>2</li></ul></li></ul><pre><code class='language-py'>x = 1\n</code></pre><blockquote><p>q</p></blockquote><table><tr><th>h|</th></tr><tr><td>v</td></tr></table><script>no</script>"
    out, blocks = html.markdown(page, "http://h/d/")
    assert "## T" in out and "a **b** [l](http://h/x)n" in out and "- 1\n  - 2" in out and "```py\nx = 1\n```" in out and "> q" in out and "| h\\| |" in out and "no" not in out.split("n\n")[-1]
    assert blocks["headings"] == 1 and blocks["tables"] == 1 and blocks["links"] == 1


def test_main_content(spark):
    long = "word " * 60
    page = f"<div class='header'>{long}</div><div class='post_body'><p>{long}</p></div><div class='comments'>{long * 3}</div>"
    row = html.main_content(spark.createDataFrame([(1, page), (2, "<p>short</p>")], "page_id long, html string")).orderBy("page_id").collect()
    assert row[0].extracted and row[0].content.startswith("<div class='post_body'>") and row[0].content.endswith("</div>") and "comments" not in row[0].content
    assert not row[1].extracted and row[1].content == "<p>short</p>"


def test_claims(spark):
    packages = spark.createDataFrame([("000001", "f", None, 1, 0, 0, ""), ("000002", "f", "2030-01-01", 1, 0, 0, ""), ("000003", "", "2030-01-01", 0, 0, 1, "t"), ("000004", "f", "2030-01-01", 0, 0, 0, "")], "code string, stored_rel string, e string, max_downloads int, download_count int, burn_after int, text_payload string").withColumn("expires_at", F.col("e").cast("timestamp_ntz"))
    claims = spark.createDataFrame([(1, "000002"), (2, "000002"), (3, "999999"), (4, "x"), (5, "000001"), (6, "000003"), (7, "000004"), (8, "000004"), (9, None)], "claim_id long, code string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {r.claim_id: r.outcome for r in parcels.settle_claims(packages, claims).collect()}
    assert got == {1: "ok", 2: "exhausted", 3: "invalid", 4: "invalid", 5: "expired", 6: "missing", 7: "ok", 8: "ok", 9: "invalid"}
    assert {r.claim_id: r.outcome for r in parcels.settle_claims(packages, claims, "text").collect()}[6] == "ok"


@pytest.mark.parametrize("kind", ["file", "text"])
def test_parcels_that_share_a_code(spark, kind):
    """As the SQL of P10, where an order of each claim's parcels by id decides its ties."""
    rng = random.Random(5)
    ends = ["2024-01-05", "2030-01-01", None]
    made = [(f"{i:03}", f"{rng.randrange(12):06}", rng.choice(["", "f"]), rng.choice(ends), rng.randrange(4), rng.choice([0, 0, 1]), int(rng.random() < 0.2), rng.choice(["", "", "t"])) for i in range(40)]
    packages = spark.createDataFrame(made, "id string, code string, stored_rel string, e string, max_downloads int, download_count int, burn_after int, text_payload string").select("*", F.col("e").cast("timestamp_ntz").alias("expires_at")).drop("e")
    claims = spark.createDataFrame([(i, f"{rng.randrange(14):06}", f"2024-01-{rng.randrange(1, 9):02}") for i in range(300)], "claim_id long, code string, d string").select("claim_id", "code", F.col("d").cast("timestamp_ntz").alias("ts"))
    con = duckdb.connect()
    con.register("packages", packages.toPandas())
    con.register("claims", claims.toPandas())
    sql = plans._settled(kind).replace("$", "").replace("k.has,\n", "k.has, k.id,\n").replace("SELECT code, expires_at,", "SELECT id, code, expires_at,").replace("ORDER BY ts, claim_id", "ORDER BY ts, claim_id, id")
    want = con.execute(f"SELECT claim_id, code, outcome FROM ({sql})").fetchall()
    got = [tuple(r) for r in parcels.settle_claims(packages, claims, kind).select("claim_id", "code", "outcome").collect()]
    assert sorted(got) == sorted(want) and len({x[2] for x in got}) == 5


@pytest.mark.parametrize("kind", ["file", "text"])
def test_good_claims_are_counted_without_a_row_for_each_parcel(spark, kind):
    rng = random.Random(6)
    made = [(f"{i:03}", f"{rng.randrange(12):06}", rng.choice(["", "f"]), rng.choice(["2024-01-05", "2030-01-01", None]), rng.randrange(5), rng.choice([0, 0, 1]), int(rng.random() < 0.2), rng.choice(["", "", "t"])) for i in range(60)]
    packages = spark.createDataFrame(made, "id string, code string, stored_rel string, e string, max_downloads int, download_count int, burn_after int, text_payload string").select("*", F.col("e").cast("timestamp_ntz").alias("expires_at")).drop("e")
    claims = spark.createDataFrame([(i, f"{rng.randrange(14):06}", f"2024-01-{rng.randrange(1, 9):02}") for i in range(300)], "claim_id long, code string, d string").select("claim_id", "code", F.col("d").cast("timestamp_ntz").alias("ts"))
    used = parcels.used_up(packages, claims, kind)
    assert " Generate" not in used._jdf.queryExecution().optimizedPlan().toString()
    want = parcels.settle_claims(packages, claims, kind).filter("outcome = 'ok'").groupBy("code").count()
    assert sorted(map(tuple, used.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


def test_codes(spark):
    out = parcels.assign_codes(spark.range(30).select(F.col("id").cast("string")), spark.createDataFrame([("000000",)], "code string"))
    codes = [r.code for r in out.collect()]
    assert len(set(codes)) == 30 and "000000" not in codes
    with pytest.raises(ValueError):
        parcels.assign_codes(spark.range(11).select(F.col("id").cast("string")), spark.createDataFrame([], "code string"), space=10)


def test_codes_grow_where_six_digits_run_out(spark):
    six = spark.range(999_990).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("code"))
    used = six.union(spark.createDataFrame([("0000007",), ("6180008",)], "code string"))
    out = parcels.assign_codes(spark.range(50).select(F.col("id").cast("string")), used).collect()
    codes = {r.code for r in out}
    assert len(out) == len({r.id for r in out}) == len(codes) == 50 and not codes & {"0000007", "6180008"}
    assert sorted(map(len, codes)) == [6] * 10 + [7] * 40


def test_sliding(spark):
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate([0, 1, 2, 61, 62])], "client string, event_id long, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.event_id: (r.allowed, r.remaining) for r in requests.sliding_check(rows, 2, 60).collect()}
    assert got == {0: (True, 1), 1: (True, 0), 2: (False, 0), 3: (True, 0), 4: (True, 0)}
    assert {r.remaining for r in requests.sliding_check(rows, 0, 60).collect()} == {-1}


def test_lockout(spark):
    rows = spark.createDataFrame([("a", i, t, ok) for i, (t, ok) in enumerate([(0, False), (1, False), (2, True), (901, False), (902, True), (903, False)])], "client string, event_id long, t long, ok boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = [r.state for r in requests.lockouts(rows, 2, 600, 900).orderBy("event_id").collect()]
    assert got == ["counted", "tripped", "locked", "counted", "cleared", "counted"]


def test_throttle(spark):
    rows = spark.createDataFrame([("j", i, t, p) for i, (t, p) in enumerate([(0.0, 0.0), (0.1, 0.01), (0.2, 0.05), (1.5, 0.051)])], "job_id string, seq long, t double, progress double").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r.seq for r in jobs.throttle_progress(rows).collect()) == [0, 2, 3]


def test_redact(spark):
    assert one(spark, jobs.redact(F.col("t")), t="bad C:\\a\\b.txt and /tmp/x/y.pdf\nmore") == "bad … and …/y.pdf"


@pytest.mark.parametrize("raw, out", [("  \n x /a//b/c \n y", "x …/c"), ("open 'C:\\a b\\c' now", "open '… b\\c' now"), (None, ""), ("", ""), (" \t", jobs.NO_TEXT), ("a\x0bb", "a"), ("e" * 600, "e" * 500)])
def test_redact_edges(spark, raw, out):
    assert one(spark, jobs.redact(F.col("t")), t=raw) == out


@pytest.mark.parametrize("method, path, out", [("POST", "/tools/json/format", False), ("POST", "/tools/x/convert-batch", True), ("GET", "/api/jobs/1/download/", True), ("POST", "/api/jobs/1/download", True), ("GET", "/tools/x/download", False), ("GET", "/files/pickup/1", True), ("GET", "/tools/x/convert", False), ("PUT", "/tools/x/convert", False)])
def test_limited(spark, method, path, out):
    assert one(spark, requests.limited_scope(F.col("m"), F.col("p")), m=method, p=path) is out


def test_kinds(spark):
    rows = [("a.svg", "", "text"), ("a.PNG", "", "image"), ("a.bin", "image/heic", "image"), ("a", "text/x", "text"), (".env", "", "other"), ("x.env", "", "text"), ("x.kts", "", "text"), ("q", "application/pdf", "pdf"), ("q.", "", "other")]
    frame = spark.createDataFrame([(n, c, "") for n, c, _ in rows], "original_name string, content_type string, text_payload string")
    assert [r.kind for r in parcels.content_kind(frame).collect()] == [k for _, _, k in rows]


def test_dedupe_names(spark):
    names = ["a", "a", "a_1", "a_1_1", "A", "b.txt", "B.TXT", None, ".x", ".x"]
    got = activity.dedupe_names(spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "g int, i int, n string"), "g", "n", "i").orderBy("i").collect()
    assert [r.unique_name for r in got] == ["a", "a_1", "a_1_1", "a_1_1_1", "A_2", "b.txt", "B_1.TXT", None, ".x", ".x_1"]


def test_line_dedupe_keeps_all(spark):
    rows = text.corpus_line_dedupe(spark.createDataFrame([(1, "a\nb"), (2, None), (3, ""), (4, "b\n\n\nc")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.dropped) for r in rows] == [(1, "a\nb", 0), (2, "", 0), (3, "", 0), (4, "\nc", 2)]


def test_time_forms(spark):
    rows = text.normalise_timestamps(spark.createDataFrame([("2024-01-02 03",), ("2024-01-02 03:04:05.123456",)], "raw string"), "raw").collect()
    assert rows[0].local == "2024-01-02 03:00:00" and rows[1].error == "unparseable"


def test_file_kinds(spark):
    svg = b"\xef<?xml version='1'?>\n<!-- a\nb --> <!-- c --> <svg x>"
    rows = [(svg[1:], "x", "svg"), (b"?", "a.jfif", "jpeg"), (b"?", "a.jpe", "jpeg"), (b"?", "a.svgz", "svg"), (b"<svgx", "a", "unsupported"), (b"", "a.cur", "ico"), (b" " * 3000 + b"<svg>", "a", "svg")]
    frame = spark.createDataFrame([(bytearray(c), n) for c, n, _ in rows], "content binary, path string")
    assert [r[0] for r in frame.select(files.classify(F.col("content"), F.col("path"))).collect()] == [k for _, _, k in rows]


def test_main_content_offsets(spark):
    page = "<body>\f\r x\u2028<article>" + "<p>words of it </p>" * 12 + "</article><div class='main-content nav'>" + "z" * 900 + "</div>"
    row = html.main_content(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert row.extracted and row.content == page[page.index("<article>") : page.index("</article>") + 10]


def test_names(spark):
    assert one(spark, activity.sanitize_name(F.col("t")), t="a/b/..con.txt") == "_con.txt"
    assert one(spark, activity.sanitize_name(F.col("t")), t="报告 1?.pdf") == "报告_1_.pdf"
    assert not one(spark, activity.safe_rel(F.col("t")), t="..\\secrets")


def test_ranges(spark):
    specs = spark.createDataFrame([(1, 6, "1-3,5"), (2, 6, "4-9"), (3, 6, ""), (4, 6, None)], "id long, total int, spec string")
    strict = text.expand_ranges(specs)
    assert [r.n for r in strict.filter("id = 1").orderBy("ord").collect()] == [1, 2, 3, 5]
    assert {r.id for r in strict.filter("error is not null").collect()} == {2, 3, 4}
    assert [r.n for r in text.expand_ranges(specs, False).filter("id = 2").orderBy("ord").collect()] == [4, 5, 6]
    assert text.compact_ranges(strict.filter("id = 1")).first().spec == "1-3,5"


def test_archives(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("ok.txt", "x")
        z.writestr("../up.txt", "x")
    rows = files.archive_member_inventory(spark.createDataFrame([("a.zip", bytearray(data.getvalue())), ("b.zip", bytearray(b"no"))], "path string, content binary")).collect()
    assert sorted((r.path, r.flag) for r in rows) == [("a.zip", "ok"), ("a.zip", "path"), ("b.zip", "broken")]


def test_legacy_import(spark, tmp_path):
    (tmp_path / "old.json").write_text('[{"id": "1", "tool": "t", "pages": 3}, 5, {"id": "1", "tool": "z"}, {"tool": "none"}]')
    empty = spark.createDataFrame([], "id string, tool string, extra_json string")
    rows = files.import_legacy_json(spark, str(tmp_path / "old.json"), empty, ["id", "tool"]).collect()
    assert [(r.id, r.tool, r.extra_json) for r in rows] == [("1", "t", '{"pages":"3"}')]


def test_archive_sink(spark, tmp_path):
    files.archive_sink(table(spark, SF, "records").filter("created_at is not null"), str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a")).filter("day = '1998-01-01'")
    assert "PartitionFilters: [isnotnull" in back._jdf.queryExecution().toString()


def test_access_log(spark, tmp_path):
    (tmp_path / "x.log").write_text("INFO access method=GET path=/ status=200 ms=1.5 request_id=-\nnoise\n")
    row = files.read_access_log(spark, str(tmp_path)).collect()
    assert [(r.method, r.path, r.status, r.ms, r.request_id) for r in row] == [("GET", "/", 200, 1.5, None)]


def test_plans(spark):
    records = table(spark, SF, "records")
    assert "TakeOrderedAndProject" in activity.recent(records)._jdf.queryExecution().toString()
    assert "LeftAnti" in activity.delete_ids(records, spark.createDataFrame([("1",)], "id string"))._jdf.queryExecution().executedPlan().toString()
    assert requests.sliding_record(table(spark, SF, "requests"), 3, 60)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_large_batches_are_handled_in_pieces():
    import pyarrow as pa

    from millrace.session import pieces

    batch = pa.record_batch([pa.array(range(1000))], ["n"])
    got = list(pieces([batch, batch.slice(0, 0), batch.slice(0, 1)]))
    assert max(map(len, got)) == 64 and [x for p in got for x in p.column(0).to_pylist()] == [*range(1000), 0]
