import pytest

from pairweave.cli import main
from pairweave.plans.cluster import cluster
from pairweave.sources.pairs import dump_edges, read_objects, read_pairs, write_assignment


def test_mixed_separators_and_line_ends(spark, tmp_path):
    (tmp_path / "p").write_bytes(b"id1\tid2,d\textra\r\na,b\t0.1\tx\r\n\r\nb\tc\t0.2,y\nc,a,0.3,z\n")
    df, order = read_pairs(spark, str(tmp_path / "p"))
    assert [(r["id1"], r["id2"], r["d"]) for r in df.orderBy(order).collect()] == [("a", "b", 0.1), ("b", "c", 0.2), ("c", "a", 0.3)]


@pytest.mark.parametrize("line", ["a,b", "a,b,0.1,x,", "a,b,zero,x"])
def test_malformed_rows(spark, tmp_path, line):
    (tmp_path / "p").write_text(f"id1,id2,d,extra\na,c,0.5,x\n{line}\n")
    df, _ = read_pairs(spark, str(tmp_path / "p"))
    with pytest.raises(Exception, match="ill-formatted row|CAST_INVALID|cannot be cast"):
        df.collect()
    df, _ = read_pairs(spark, str(tmp_path / "p"), permissive=True)
    assert df.count() == 1


def test_header_only_and_narrow_header(spark, tmp_path):
    (tmp_path / "p").write_text("id1,id2,d\n")
    df, order = read_pairs(spark, str(tmp_path / "p"))
    assert cluster(df, order=order).collect() == []
    (tmp_path / "q").write_text("id1,id2\na,b\n")
    with pytest.raises(ValueError, match="three columns"):
        read_pairs(spark, str(tmp_path / "q"))


def test_order_of_lines_over_many_splits(spark, tmp_path):
    (tmp_path / "o").write_text("object,len\n" + "".join(f"x{(i * 7919) % 3000},{i}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = read_objects(spark, str(tmp_path / "o")).orderBy("gi").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["object"], r["gi"]) for r in got] == [(f"x{(i * 7919) % 3000}", i) for i in range(3000)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p").write_text("id1,id2,s\nb,a,0.9\nb,c,0.8\nd,e,0.2\n")
    assert main(["--similarity", "--min", "s", "0.5", "--algo", "complete", "--out-csv", "-v", str(tmp_path / "p"), str(tmp_path / "o")]) == 0
    assert (tmp_path / "o").read_text() == "object,cluster\na,0\nb,0\nc,1\n"
    assert main(["--id-cols", "x", "y", str(tmp_path / "p"), str(tmp_path / "o")]) == 1
    assert "no column" in capsys.readouterr().err


def test_folder_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "a", 0.1), ("b", "c", 0.25)], "x string, y string, d double")
    write_assignment(cluster(df), str(tmp_path / "out"))
    back = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "out"))
    assert [tuple(r) for r in back.collect()] == [("a", "0"), ("b", "0"), ("c", "0")] and back.columns == ["object", "cluster"]
    e = df.toDF("src", "dst", "d")
    v = spark.createDataFrame([("b", 0), ("c", 1), ("a", 2)], "id string, appear_key int")
    dump_edges(e, v, str(tmp_path / "edges"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "edges")).collect()] == ["a,b,0.1000000000", "b,c,0.2500000000", "b,a,0.1000000000", "c,b,0.2500000000"]


def test_only_first_lines_are_headers(spark, tmp_path):
    (tmp_path / "p").mkdir()
    for name in "xy":
        (tmp_path / "p" / name).write_text(f"id1,id2,d\n{name},b,0.5\n")
    df, order = read_pairs(spark, str(tmp_path / "p"))
    assert [r["id1"] for r in df.orderBy(order).collect()] == ["x", "y"]
    (tmp_path / "q").write_text("id1,id2,d\na,b,0.5\nid1,id2,d\n")
    with pytest.raises(Exception, match="ill-formatted row"):
        read_pairs(spark, str(tmp_path / "q"))[0].collect()


def test_command_line_names_the_bad_row(spark, tmp_path, capsys):
    (tmp_path / "p").write_text("id1,id2,s\nb,a,0.9\nb,c\n")
    assert main([str(tmp_path / "p"), str(tmp_path / "o")]) == 1
    said = capsys.readouterr().err
    assert said.startswith("error: ") and "b,c" in said and said.count("\n") == 1
