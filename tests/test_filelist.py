import pytest

from wirespan.sources import filelist
from wirespan.sources.design import Design


def test_filelist():
    files = {
        "/p/top.f": "a.sv // rest is gone\n+define+A=1+B +incdir+inc+inc2\n$LIB/c.sv#x y.sv\n-f\n sub/s.f\n-y lib -v v.sv -foo +bar+x ${NONE}d.sv http://x",
        "/p/sub/s.f": "b.sv",
    }
    got = filelist.read_filelist("/p/top.f", {"LIB": "lib"}, files.__getitem__)
    assert got.files == ["/p/a.sv", "/p/lib/c.sv", "/p/sub/b.sv", "/p/v.sv", "/p/d.sv", "/p/http:/x"]
    assert got.defines == ["A=1", "B"] and got.include_dirs == ["/p/inc", "/p/inc2"]
    assert len(got.notes) == 3
    with pytest.raises(ValueError):
        filelist.read_filelist("/l.f", {}, {"/l.f": "-f l.f"}.__getitem__)
    assert filelist.expand("$ $A ${B}x", {"A": "1", "B": "2"}) == "$ 1 2x"


def test_seal(spark, tmp_path):
    (tmp_path / "a.sv").write_text("module a; endmodule")
    (digest,) = [r.digest for r in filelist.source_files(spark, [f"file://{tmp_path}/a.sv"]).collect()]
    assert len(digest) == 64
    assert filelist.config_digest([("f", "ab"), ("g", "c")]) != filelist.config_digest([("f", "a"), ("g", "bc")])
    assert [filelist.status(), filelist.status(errors=1), filelist.status(fatal=True), filelist.status(scopes=0)] == ["complete", "partial", "hierarchy_only", "hierarchy_only"]
    old, new = filelist.meta(spark, {"a": 1, "b": None}), filelist.meta(spark, {"b": 2})
    assert sorted(filelist.merged_meta(old, new).collect()) == [("a", "1"), ("b", "2")]
    texts = spark.createDataFrame([("x",), ("",), (None,), ("a",), ("x",)], "t string")
    assert sorted(filelist.interned(texts, "t").collect()) == [(1, "a"), (2, "x")]
    files = spark.createDataFrame([(1, "/a", 9), (2, "/b", None)], "id long, path string, src_file_id long")
    assert sorted(filelist.linked(files, spark.createDataFrame([(7, "/a", "d")], "id long, path string, digest string")).collect()) == [(1, "/a", 7), (2, "/b", None)]


def test_registered(spark):
    Design.of(spark, {"meta": [("schema_version", "14")]}).register("small_")
    assert spark.sql("SELECT schema_version FROM small_v_db_info").first()[0] == 14
    assert spark.sql("SELECT * FROM small_v_driver").count() == 0
