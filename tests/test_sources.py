import time

from pyspark.sql import functions as F

from lodeline import frame
from lodeline.operators.levels import line_level
from lodeline.operators.timeline import Rejected
from lodeline.sources import generate, lines, schema
from lodeline.streaming import tail


def test_numbering_over_splits(spark, tmp_path):
    want = [f"line {i}" + ("\r" if i % 7 == 0 else "") for i in range(20_000)]
    (tmp_path / "a.log").write_bytes(("﻿" + "\n".join(want) + "\n").encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = {r.line_no: r.value for r in lines.read_lines(spark, str(tmp_path / "a.log")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: w.rstrip("\r") for i, w in enumerate(want)}


def test_encodings(spark, tmp_path):
    body = "a中文\r\n\nlast é"
    for enc in ("utf-8", "utf-16", "gbk"):
        text = body.replace("é", "x") if enc == "gbk" else body
        path = tmp_path / f"{enc}.log"
        path.write_bytes((text + "中文字符编码" * 20).encode(enc))
        got = [r.value for r in lines.read_lines(spark, str(path)).orderBy("line_no").collect()]
        assert got == (text.replace("\r", "") + "中文字符编码" * 20).split("\n"), enc
    assert lines.detect_encoding(b"caf\xe9 \xff\x01 x \xfe z") == "latin-1"


def test_detect_and_discover(spark):
    df = generate.json_lines(spark, 200)
    assert schema.is_json_lines(df) and [c.name for c in schema.discover_columns(df)] == ["ts", "level", "logger", "msg", "req_id", "user", "duration_ms", "bytes", "status", "path"]
    assert not schema.is_json_lines(generate.plain_lines(spark, 50)) and not schema.is_json_lines(df.limit(2))


def test_frame(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    path.write_text("\n".join(r.value for r in generate.json_lines(spark, 300).orderBy("line_no").collect()))
    log = frame.open_log(spark, str(path))
    assert log.is_json and log.level_column == "level"
    part = log.filter("STATUS>=500")
    assert {r.status for r in part.table(["status"]).collect()} == {"500"}
    counts = {r.level: (r.n, r.clause) for r in log.levels().collect()}
    assert sum(n for n, _ in counts.values()) == 300
    for n, clause in counts.values():
        assert clause is None or log.filter(clause).lines.count() == n
    assert log.analyze("duration_ms").numeric and not log.analyze("logger").numeric
    assert log.expand([0]).count() == 10
    part.export(str(tmp_path / "raw.out"))
    assert (tmp_path / "raw.out").read_text().count("\n") == part.lines.count()
    log.export(str(tmp_path / "all.out"))
    assert (tmp_path / "all.out").read_bytes() == path.read_bytes()


def test_merge_sources(spark, tmp_path):
    made, truth = generate.merge_sources(spark, 400, 4)
    logs = []
    for i, df in enumerate(made):
        p = tmp_path / f"s{i}"
        p.write_text("\n".join(r.value for r in df.orderBy("line_no").collect()) + "\n")
        logs.append(frame.open_log(spark, str(p)))
    skews = [r.skew_ms for r in truth.orderBy("src").collect()]
    t = frame.merge(logs, offsets=[-s for s in skews])
    assert not t.rejected and t.rows().count() == 1600
    (tmp_path / "no").write_text("x\ny\nz\nw\n")
    assert isinstance(frame.open_source(frame.open_log(spark, str(tmp_path / "no"))), Rejected)


def test_tail(spark, tmp_path):
    a, out = tmp_path / "a.log", str(tmp_path / "table")
    a.write_text("INFO one\nERR")
    stream = tail.tail(spark, [str(a), str(tmp_path / "missing.log")])
    run = tail.follow_merge(stream, lambda r: F.col("line_no"), out, str(tmp_path / "cp"), processingTime="100 milliseconds")

    def rows():
        try:
            return sorted((r.line_no, r.value) for r in tail.merged(spark, out).collect())
        except Exception:
            return []

    def wait(want):
        end = time.time() + 60
        while rows() != want and time.time() < end:
            time.sleep(0.3)
        assert rows() == want

    try:
        wait([(0, "INFO one")])
        with a.open("a") as f:
            f.write("OR two\r\n")
        wait([(0, "INFO one"), (1, "ERROR two")])
        kept = spark.read.parquet(out)
        assert {r.level: r.n for r in kept.groupBy(line_level(F.col("value")).alias("level")).agg(F.count("*").alias("n")).collect()} == {"INFO": 1, "ERROR": 1}
        a.write_text("new\n")
        wait([(0, "new")])
    finally:
        run.stop()
