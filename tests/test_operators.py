import math
import random

import pytest
from pyspark.sql import functions as F

from lodeline.functions import jsonx, text, timestamps
from lodeline.operators import export, layout, levels, profile, rows, search, state, timeline
from lodeline.operators.jobs import Job


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_line_level(spark):
    lines = ["ERROR WARN", "warn", "TRACE x", "é" * 99 + "a" + "ERROR", "é" * 99 + "ERROR", None, "FATAL ERROR", "x" * 197 + "INFO", "x" * 196 + "INFO"]
    assert column(spark, lines, levels.line_level) == ["ERROR", "OTHER", "DEBUG", "OTHER", "OTHER", "OTHER", "FATAL", "OTHER", "INFO"]


def test_bucket_equals_clause(spark):
    values = ["info", "INFO2", "Error", "ERRORS", "warning", "fatal", "notice", None, "xINFO"]
    df = spark.createDataFrame([(v,) for v in values], "lvl string")
    counts = {r.level: r.n for r in levels.count_levels(df, levels.field_level(F.col("lvl")), "lvl").collect()}
    assert counts == {"FATAL": 1, "ERROR": 2, "WARN": 1, "INFO": 2, "DEBUG": 0, "OTHER": 3}
    assert levels.level_clauses("lvl") == {"FATAL": "lvl=FATAL*", "ERROR": "lvl=ERROR*", "WARN": "lvl=WARN*", "INFO": "lvl=INFO*", "DEBUG": None, "OTHER": None}
    assert levels.active_level("LVL=ERROR*", "lvl", ["lvl"]) == "ERROR"
    assert levels.find_level_column(["ts", "Severity", "level"]) == "Severity"


def test_append_counts():
    old = {"INFO": 3, "OTHER": 1}
    assert levels.append_counts(old, "OTHER", {"ERROR": 1, "INFO": 1}) == {"FATAL": 0, "ERROR": 1, "WARN": 0, "INFO": 4, "DEBUG": 0, "OTHER": 0}


def scan(spark, raws, kinds=None):
    kinds = kinds or ["Num"] * len(raws)
    return spark.createDataFrame([(i, k, r) for i, (k, r) in enumerate(zip(kinds, raws, strict=True))], "line_no long, kind string, raw string")


def test_numeric(spark):
    r = profile.numeric_stats(scan(spark, ["10", "20", "30"])).first()
    assert (r["count"], r.mean, r.p50, r.p95, r.min, r.max, r.skipped) == (3, 20, 20, 30, 10, 30, 0)
    assert profile.numeric_stats(scan(spark, [str(i) for i in range(1, 1000)])).first().p50 == 500
    assert profile.numeric_stats(scan(spark, [str(i) for i in range(1, 11)])).first().p50 == 6
    empty = profile.numeric_stats(scan(spark, ["x", None], ["Str", None])).first()
    assert empty["count"] == 0 and empty.skipped == 2 and math.isnan(empty.p50)
    mixed = scan(spark, ["1", "2", "3", "a", '{"x":1}'], ["Num", "Num", "Num", "Str", "Nested"])
    assert profile.is_numeric(mixed, ["line_no"]) and profile.numeric_stats(mixed).first().skipped == 2


def test_quantiles_random(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 400):
        values = sorted(round(rng.gauss(0, 3), 2) for _ in range(n))
        r = profile.numeric_stats(scan(spark, [str(v) for v in values])).first()
        for k, p in profile.QUANTILES.items():
            assert r[k] == values[math.floor((n - 1) * p + 0.5)]


def test_enum(spark):
    kinds = ["Str"] * 4 + ["Null", "Bool", "Nested", None]
    got = profile.enum_stats(scan(spark, ["INFO", "INFO", "INFO", "ERROR", "null", "true", "{}", None], kinds)).collect()
    assert [(r.value, r.n) for r in got] == [("INFO", 3), ("ERROR", 1), ("null", 1), ("true", 1)]
    assert {(r.total, r.others, r.skipped, r.capped, r.scope_rows) for r in got} == {(6, 0, 2, False, 8)}
    many = profile.enum_stats(scan(spark, [f"v{i:03}" for i in range(37)], ["Str"] * 37), cap=30).collect()
    assert len(many) == 20 and all(r.capped and r.others == 17 for r in many)


def test_json(spark):
    lines = ['{"b":1.0,"a":"x\\n","b":1e5}', '{"a":1} x', "{'a':1}", '{"a":NaN}', "[1]", None, '{"n":{"k":[1,"é"]},"z":null}']
    got = column(spark, lines, jsonx.parse_line)
    assert (got[0]["keys"], got[0].raw, got[0].kinds) == (["b", "a"], ["1e5", "x\n"], ["Num", "Str"])
    assert [g.ok for g in got] == [True, False, False, False, True, False, True] and not got[4].is_object
    assert got[6].text == ['{"k":[1,"é"]}', "null"]
    subs = column(spark, [lines[6]], jsonx.flatten_line)[0]
    assert [(s.depth, s.label, s.value) for s in subs] == [(1, "n", '{"k":[1,"é"]}'), (2, "k", '[1,"é"]'), (3, "[0]", "1"), (3, "[1]", "é"), (1, "z", "null")]


def test_timestamps(spark):
    ok = ["1970-01-01T00:00:01Z", "1970-01-01 00:00:01,250 x", "1970-01-01T08:00:00.5+08:00", "1970-01-01T00:00:00", "junk", "2024-13-01T00:00:00Z"]
    assert column(spark, ok, timestamps.value_ms) == [1000, 1250, 500, 0, None, None]
    assert column(spark, ["1700000000", "1700000000123", "1.5"], timestamps.epoch_ms) == [1700000000000, 1700000000123, 1500]
    assert column(spark, [-1, 3_723_004], timestamps.time_of_day, "long") == ["23:59:59.999", "01:02:03.004"]
    assert [timestamps.zone_ms(z) for z in ("+8", "-5.5", "+05:30", "0", "23")] == [28_800_000, -19_800_000, 19_800_000, 0, 82_800_000]
    assert [timestamps.zone_ms(z) for z in ("", "+-8", "+24", "abc", "1:60")] == [None] * 5


def head_merge(sources):
    """Brute force: the least (time, source) of the heads, times inherited."""
    heads = []
    for src, ts in enumerate(sources):
        filled, last = [], next((t for t in ts if t is not None), None)
        for t in ts:
            last = t if t is not None else last
            filled.append(last)
        heads.append((src, filled))
    out, at = [], [0] * len(sources)
    while any(at[s] < len(f) for s, f in heads):
        _, s = min((f[at[s]], s) for s, f in heads if at[s] < len(f))
        out.append((s, at[s]))
        at[s] += 1
    return out


def test_merge_order(spark, monkeypatch):
    monkeypatch.setattr(timeline, "BLOCK", 4)
    rng = random.Random(3)
    for _ in range(3):
        sources = [[rng.choice([None, rng.randrange(12), rng.randrange(12)]) for _ in range(rng.randrange(1, 14))] for _ in range(3)]
        sources = [s if any(t is not None for t in s) else [0, *s] for s in sources]
        df = spark.createDataFrame([(s, i, t) for s, ts in enumerate(sources) for i, t in enumerate(ts)], "src int, line_no long, ts_raw long")
        got = timeline.merge_order(timeline.running_order(df)).orderBy("merge_pos").collect()
        assert [(r.src, r.line_no) for r in got] == head_merge(sources) and [r.merge_pos for r in got] == list(range(len(got)))


def test_timeline(spark):
    lines = lambda v: spark.createDataFrame(list(enumerate(v)), "line_no long, value string")
    js = timeline.Source("a.jsonl", lines(['{"ts":"1970-01-01T00:00:03Z","id":"aaa111"}', '{"ts":"1970-01-01T00:00:25Z"}', '{"ts":"1970-01-01T00:00:35Z"}']), timeline.Route(field="ts"), ["ts", "id"])
    log = timeline.Source("b.log", lines(["1970-01-01T00:00:10 x", "1970-01-01T00:00:20 AAA111 y", "1970-01-01T00:00:30 z"]), timeline.Route(form="iso"))
    t = timeline.merge(spark, [log, js, timeline.Rejected("c", "why")]).set_time(0, offset_ms=-7000)
    order = [(r.src, r.line_no, r.time) for r in t.rows().orderBy("merge_pos").collect()]
    assert order[:2] == [(0, 0, "00:00:03.000"), (1, 0, "00:00:03.000")] and len(order) == 6
    assert [(r.src, r.line_no) for r in t.trace("aaa111").rows().orderBy("merge_pos").collect()] == [(1, 0), (0, 1)]
    assert {r.src for r in t.hide(0).rows().collect()} == {1} and t.rejected[0].reason == "why"
    cells = {(r.src, r.line_no): tuple(r.cells) for r in t.table().collect()}
    assert cells[0, 0] == ("", "") and cells[1, 0] == ("1970-01-01T00:00:03Z", "aaa111")
    assert t.position_of(1, 0).first().merge_pos == 1 and t.row_at(0).first().src == 0


def test_union_columns_and_carry(spark):
    assert timeline.union_columns([["ts", "level", "msg"], [], ["level", "req", "msg"]]) == (["ts", "level", "msg", "req"], 0)
    assert timeline.union_columns([[f"c{i}" for i in range(30)]])[1] == 6
    marks = spark.createDataFrame([(0, 5), (1, 6)], "src int, line_no int")
    assert [tuple(r) for r in timeline.carry_state(marks, ["a", "b"], ["x", "b"]).collect()] == [(1, 6)]


def test_search(spark):
    lines = spark.createDataFrame(list(enumerate(["an Error error", "ok", "中文 Kelvin K", "ERROR"])), "line_no long, value string")
    found = search.search(lines, "error")
    assert (found.hit_lines, found.total_matches, sorted(r.line_no for r in found.hits.collect())) == (2, 3, [0, 3])
    assert search.search(lines, "(?-i)error").hit_lines == 1
    assert search.search(lines, r"^\w\w kelvin k$").hit_lines == 1
    with pytest.raises(search.BadPattern):
        search.search(lines, "(")
    assert search.next_hit(found.hits, 3).first()[0] == 0 and search.previous_hit(found.hits, 0).first()[0] == 3
    assert tuple(search.position(found.hits, 3).first()) == (2, 2)
    spans = search.highlights(lines, "error").orderBy("line_no", "begin").collect()
    assert [(s.line_no, s.begin, s.end, s.text) for s in spans] == [(0, 3, 8, "Error"), (0, 9, 14, "error"), (3, 0, 5, "ERROR")]


def test_rows(spark):
    lines = spark.createDataFrame([(0, '{"a":{"b":1}}'), (1, "x"), (5, '{"c":2}')], "line_no long, value string")
    opened = spark.createDataFrame([(0,), (5,), (9,)], "line_no long")
    shown = rows.display_rows(rows.sub_counts(lines, opened))
    assert [(r.line_no, r.n_sub, r.display_row) for r in shown.orderBy("line_no").collect()] == [(0, 2, 0), (1, 0, 3), (5, 1, 4)]
    assert tuple(rows.line_at(shown, 2).first()) == (0, 1) and tuple(rows.line_at(shown, 3).first()) == (1, -1)
    assert rows.next_bookmark({3, 10, 20}, 20) == 3 and rows.next_bookmark({3, 10}, 3) == 10 and rows.next_bookmark(set(), 1) is None
    assert rows.toggle_bookmark({1}, 1) == set() and rows.bookmark_rank({3, 10}, 10) == 2


def test_layout():
    v = layout.Layout.of(["a", "b", "c"])
    assert v.hide("a") and v.hide("b") and not v.hide("c") and v.visible == ["c"]
    v.move_before("c", "a")
    v.resize("a", 1)
    v.reconcile(["b", "a", "d"])
    assert (v.order, v.visible, v.widths) == (["a", "b", "d"], ["d"], {"a": 40})
    v.reconcile(["a", "b"])
    assert v.visible == ["a"]


def test_text(spark):
    assert text.snap_json_string(r'{"msg":"a\"b"}', 8, 9) == (8, 12)
    assert text.snap_json_string('{"n":42}', 5, 7) is None and text.snap_json_string('"a"', 1, 1) is None
    assert text.word_at("call foo-bar, ok", 6) == (5, 12) and text.word_at("中文", 1) == (1, 2)
    assert column(spark, [float("nan"), 3.0, 2.5], text.format_number, "double") == ["—", "3", "2.50"]
    assert column(spark, ["1,2.5", "-", "1a", ""], text.is_numeric_text) == [True, False, False, False]


def test_exports(spark, tmp_path):
    lines = spark.createDataFrame([(0, '{"a":"=SUM(1)","b":{"x":1}}'), (1, "bad, line"), (2, '{"a":"-5","b":"+x","c":1}')], "line_no long, value string")
    n, bad = export.export_csv(lines, ["a", "b"], tmp_path / "o.csv")
    assert (n, bad) == (3, 1)
    assert (tmp_path / "o.csv").read_bytes() == b"\xef\xbb\xbfa,b\r\n'=SUM(1),\"{\"\"x\"\":1}\"\r\n\"bad, line\",\r\n-5,'+x\r\n"
    export.export_pretty(lines.limit(2), tmp_path / "o.json")
    assert (tmp_path / "o.json").read_text() == '{\n  "a": "=SUM(1)",\n  "b": {\n    "x": 1\n  }\n}\n\nbad, line\n'
    assert export.atomic_write(tmp_path / "gone", iter([b"x"]), lambda: True) is None and not list(tmp_path.glob("gone*"))
    with pytest.raises(export.ExportRefused):
        export.refuse_unless_known(capped=True)
    assert export.detect_eol(b"a\r\nb\n") == b"\n" and export.detect_eol(b"a\r\nb\r\nc\n") == b"\r\n"


def test_state(tmp_path):
    s = state.State()
    for i in range(70):
        s.set_bookmarks(f"f{i}", {1})
    assert len(s.files) == 64 and "f0" not in s.files
    assert s.save_session("f69", " a\tb ", query="x") and s.session("f69", "ab")["query"] == "x" and not s.save_session("f69", "\n")
    s.dump(tmp_path / "s.json")
    assert state.State.load(tmp_path / "s.json") == s and state.State.load(tmp_path / "none") == state.State()


def test_job(spark):
    job = Job(spark)
    job.launch(lambda: 1)
    job.launch(lambda: spark.range(5).count())
    assert job.take(timeout=60) == 5 and job.take() is None
    job.launch(lambda: 2)
    job.cancel()
    assert job.take() is None


def test_highlights_see_the_whole_line(spark):
    cases = [(r"\berror", "xerror error", [(7, 12)]), ("a(?=b)", "aa ab", [(3, 4)]), ("^a", "aa", [(0, 1)]), ("x*", "axxb", [(1, 3)]), ("x*", "xxb", [(0, 2)]), (r"(a)\1", "ba aa", [(3, 5)]), ("é", "aÉbé", [(1, 2), (3, 4)])]
    for pattern, value, want in cases:
        df = spark.createDataFrame([(0, value)], "line_no long, value string")
        got = search.highlights(df, pattern).orderBy("begin").collect()
        assert [(r.begin, r.end) for r in got] == want, pattern
        assert [r.text for r in got] == [value[b:e] for b, e in want]


def test_quantiles_in_crowded_bins(spark, monkeypatch):
    import random

    from lodeline.operators import profile

    monkeypatch.setattr(profile, "FEW", 50)
    monkeypatch.setattr(profile, "BINS", 4)
    rng = random.Random(1)
    for xs in ([rng.gauss(0, 1) for _ in range(700)] + [1e9, -1e12], [5.0] * 300, [1.0] * 200 + [2.0] * 200, [1e308, -1e308, *map(float, range(90))], [3.0], []):
        scan = spark.createDataFrame([("Num", repr(x)) for x in xs] + [("Str", "a"), (None, None)], "kind string, raw string")
        got = profile.numeric_stats(scan).first()
        s = sorted(xs)
        assert (got["count"], got.scope_rows, got.skipped) == (len(s), len(s) + 2, 2)
        for k, p in profile.QUANTILES.items():
            assert got[k] == s[int((len(s) - 1) * p + 0.5)] if s else got[k] != got[k]


def test_copy_selection(spark):
    from lodeline.operators import rows

    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "line_no long, value string")
    assert rows.copy_selection(df, text="t", cell="c") == "t" and rows.copy_selection(df, cell="") == ""
    assert rows.copy_selection(df) == "a\nb\n" and rows.copy_selection(df, cap=1) == "a"


def test_numbers_reach_the_scan(spark, sf):
    from lodeline.operators import query

    df = spark.read.parquet(f"{sf}/events.parquet")
    for text in ("value>50", "user_id>=100.5", "user_id<=7", "user_id=12"):
        part = df.filter(query.compile_query(query.parse_query(text), F.lit(""), query.table_fields(df)))
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert any(x in plan.split("PushedFilters")[1] for x in ("LessThan", "GreaterThan", "EqualTo")), text
    odd = spark.createDataFrame([(1, 1.5, 3), (2, float("nan"), -3), (3, float("inf"), None), (4, None, 1 << 60)], "line_no long, x double, n long")

    def hits(text, fields):
        return sorted(r.line_no for r in odd.filter(query.compile_query(query.parse_query(text), F.lit(""), fields)).collect())

    as_text = lambda path: query.table_fields(odd)(path)
    for text in ("x>1", "x>=1.5", "x<2", "x<=1.5", "x>abc", "n>2.5", "n>=3", "n<0", "n<=-3", "n=3", "n=3.0", "n=03", "n=-3", "n=3*", "n>1e30", "n=abc"):
        assert hits(text, query.table_fields(odd)) == hits(text, as_text), text
