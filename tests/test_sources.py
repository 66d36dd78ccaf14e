"""Round trips through every reader and writer."""

import datetime

import pytest
from pyspark.sql import functions as F

from kinsieve.session import scratch_path, shared_dir, written
from kinsieve.sources import tables, writers


@pytest.fixture()
def frame(spark):
    rows = [(1, "a,b", 1.5, datetime.date(2001, 2, 3)), (2, None, None, None), (3, 'say "x"', -2.0, datetime.date(1999, 1, 1))]
    return spark.createDataFrame(rows, "id int, s string, x double, d date")


def test_delimited_round_trip_with_missing_token(spark, frame, tmp_path):
    path = str(tmp_path / "out")
    writers.write_delimited(frame, path)
    got = tables.read_delimited(spark, path, frame.schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, frame.collect()))
    assert tables.read_delimited(spark, path, frame.schema, ["id", "x"]).columns == ["id", "x"]
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    assert "NA" in text and "id,s,x,d" in text
    assert tables.first_column(got).columns == ["id"]


def test_sheet_export(spark, frame, tmp_path):
    writers.write_delimited(frame, str(tmp_path / "book" / "Sheet 1"))
    got = tables.read_sheet(spark, str(tmp_path), "book", "Sheet 1", frame.schema)
    assert got.count() == 3 and got.filter("s is null").count() == 1


def test_quoted_fields_with_line_breaks(spark, tmp_path):
    folder = tmp_path / "book" / "Notes"
    folder.mkdir(parents=True)
    (folder / "part.csv").write_text('id,note\n1,"first line\nsecond, ""quoted"" line"\n2,NA\n3,plain\n')
    got = tables.read_sheet(spark, str(tmp_path), "book", "Notes", "id int, note string", multi_line=True)
    assert sorted(map(tuple, got.collect())) == [(1, 'first line\nsecond, "quoted" line'), (2, None), (3, "plain")]
    assert got.filter("id = 1").select("note").collect()[0].note.count("\n") == 1


def test_snapshot_round_trip(spark, frame, tmp_path):
    folder = str(tmp_path / "snap")
    writers.write_snapshot({"first": frame, "second": frame.select("id")}, folder)
    got = tables.read_snapshot(spark, folder)
    assert set(got) == {"first", "second"} and got["second"].columns == ["id"]
    assert sorted(map(tuple, got["first"].collect())) == sorted(map(tuple, frame.collect()))


def test_trailer_is_cut_per_file(spark, tmp_path):
    for name in ("a", "b"):
        lines = ["n1,x,1", "n2,y,2", "n3,z,bad", "[Controls]", "ctl,k,9", "[Controls]", "more,k,9"]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "c.csv").write_text("n4,w,4\n")
    got = tables.read_before_trailer(
        spark, str(tmp_path), {"name": (0, "string"), "pos": (2, "int")}, F.col("value") == "[Controls]"
    )
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("n1", 1), ("n2", 2), ("n3", None)] * 2 + [("n4", 4)], key=str)


def test_whitespace_table(spark, tmp_path):
    (tmp_path / "t.txt").write_text("  SNP   CHR P\n rs1\t1  0.5\nrs2 2   NA\n\n")
    got = tables.read_whitespace(spark, str(tmp_path / "t.txt"), {"SNP": "string", "CHR": "int", "P": "double"})
    assert sorted(map(tuple, got.collect())) == [("rs1", 1, 0.5), ("rs2", 2, None)]


def test_a_data_row_equal_to_the_header_stays(spark, tmp_path):
    (tmp_path / "a.txt").write_text("snp\nrs1\nsnp\nrs3\n")
    (tmp_path / "b.txt").write_text("snp\nrs4\n")
    got = tables.read_whitespace(spark, str(tmp_path), {"snp": "string"})
    assert sorted(r[0] for r in got.collect()) == ["rs1", "rs3", "rs4", "snp"]


def test_quoted_fields_and_literal_separators(spark, tmp_path):
    (tmp_path / "q.csv").write_text('1,"a,b",x\n[End]\n2,c,y\n')
    fields = {"n": (0, "int"), "a": (1, "string"), "b": (2, "string")}
    got = tables.read_before_trailer(spark, str(tmp_path / "q.csv"), fields, F.col("value") == "[End]")
    assert [tuple(r) for r in got.collect()] == [(1, "a,b", "x")]
    (tmp_path / "p.csv").write_text("1|ab|x\n")
    got = tables.read_before_trailer(spark, str(tmp_path / "p.csv"), fields, F.col("value") == "[End]", sep="|")
    assert [tuple(r) for r in got.collect()] == [(1, "ab", "x")]


def test_no_local_folder_stands_in_on_a_cluster(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "local-cluster[2,1,1024]"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        shared_dir(Session)


def test_lines(spark, tmp_path):
    writers.write_lines(spark.createDataFrame([("x rs12",), ("none",)], "value string"), str(tmp_path / "l"))
    assert tables.read_lines(spark, str(tmp_path / "l")).count() == 2


def test_written_frames_go_to_the_shared_folder(spark, frame):
    assert written(frame, "t").count() == 3
    assert scratch_path(spark, "t").startswith(shared_dir(spark))
    assert scratch_path(spark, "t") != scratch_path(spark, "t")


def test_literal_table(spark):
    assert tables.literal_table(spark, [(0, "a"), (1, "b")], "code int, text string").count() == 2


def test_equal_stages_are_written_once_within_a_result(spark, monkeypatch):
    from pyspark.sql import functions as F

    from kinsieve import session

    calls = []
    plain = session.written
    monkeypatch.setattr(session, "written", lambda df, label: calls.append(label) or plain(df, label))
    build = lambda n: session.shared(spark.range(n).select((F.col("id") * 2).alias("x")), "twos")

    @session.staged
    def both():
        inner = session.staged(lambda: build(5))()
        return build(5).unionByName(inner).unionByName(build(6))

    assert both().count() == 16 and calls == ["twos", "twos"]
    both()
    assert len(calls) == 4  # a new result writes anew, as its inputs may have changed
    build(5), build(5)
    assert len(calls) == 6


def test_level_ranks_like_average_ranks(spark):
    from kinsieve.operators.joins import with_average_rank, with_level_rank

    df = spark.createDataFrame([(i, (["b", "a", "c", None, "z"] * 9)[i]) for i in range(40)], "id int, v string")
    kept = df.filter("v <> 'z' OR v IS NULL")
    got = {r.id: r.r for r in with_level_rank(kept, "v", "r", ("a", "b", "c")).collect()}
    assert got == {r.id: r.r for r in with_average_rank(kept, "v", "r").collect()}
    assert {r.r for r in with_level_rank(df, "v", "r", ("a", "b", "c")).filter("v = 'z' OR v IS NULL").collect()} == {None}
