from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelyst.operators import codebook as B
from panelyst.sources import readers, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_missing_tokens(spark, tmp_path, rows):
    p = write(tmp_path / "s.csv", 'PID,AGE,T\n0020,NA,""\nNA,19,ok\n0021,,NAN\n')
    df = readers.read_csv(spark, p, "PID STRING, AGE INT, T STRING")
    assert {tuple(r) for r in df.collect()} == {("0020", None, None), (None, 19, "ok"), ("0021", None, "NAN")}
    assert [f.dataType.simpleString() for f in readers.read_csv(spark, p).schema.fields] == ["string"] * 3


def test_bad_number_fails_loudly(spark, tmp_path):
    p = write(tmp_path / "s.csv", "AGE\nold\n")
    with pytest.raises(Exception, match="(?i)cast"):
        readers.read_csv(spark, p, "AGE INT").collect()


def test_files_are_found_by_name(spark, tmp_path):
    write(tmp_path / "MCD_Lab_2.csv", "Id,V\n0007,1\n")
    write(tmp_path / "MCD_Amb_2.csv", "Id,V\n0008,2\n")
    write(tmp_path / "Set_Lab" / "part-0.csv", "V,Id\n3,0009\n")
    found = readers.find_files(spark, str(tmp_path), r"_Lab(_\d)?$")
    assert [f.rsplit("/", 1)[1] for f in found] == ["MCD_Lab_2.csv", "Set_Lab"]
    df = readers.read_csv_inferred(spark, found, ["Id"])
    assert sorted(tuple(r) for r in df.select("Id", "V").collect()) == [("0007", 1), ("0009", 3)]
    assert dict(df.dtypes) == {"Id": "string", "V": "int"}
    amb = readers.find_files(spark, str(tmp_path), "^MCD_Amb")
    assert readers.read_csv(spark, amb).first()["Id"] == "0008"


def test_columns_go_by_name(spark, tmp_path):
    p = write(tmp_path / "s.csv", "n,id,txt\n7,9,swapped\n")
    df = readers.read_csv(spark, p, "id STRING, txt STRING, n INT")
    assert [tuple(r) for r in df.collect()] == [("9", "swapped", 7)]
    with pytest.raises(ValueError, match="gone"):
        readers.read_csv(spark, p, "id STRING, gone INT")


def test_a_file_with_another_header_is_an_error(spark, tmp_path):
    write(tmp_path / "d" / "part-0.csv", "a,b\n1,2\n")
    write(tmp_path / "d" / "part-1.csv", "b,a\n2,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, str(tmp_path / "d"), "a INT, b INT").collect()


HARD = ['say ""hi""'.replace('""', '"'), "two\nlines", "a,b", " blanks ", "back\\slash", 'end"', "\\", "'"]


def test_free_text_comes_back(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(HARD)), "k int, t string")
    sinks.export_csv(df, f"{tmp_path}/t")
    back = readers.read_csv(spark, f"{tmp_path}/t", "t STRING, k INT", multiline=True)
    assert {r["k"]: r["t"] for r in back.collect()} == dict(enumerate(HARD))
    p = write(tmp_path / "s.csv", 'id,t\n1,"he said ""no""\nand left"\n')
    assert [tuple(r) for r in readers.read_csv(spark, p, multiline=True).collect()] == [("1", 'he said "no"\nand left')]


@pytest.fixture
def small_splits(spark):
    """Files are cut into splits of a few dozen bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def free_texts(n):
    """Texts whose quotes, breaks and commas fall on all places of a split."""
    parts = ['"', "\n", ",", "a", " ", '""', "é", "\n\n", "x" * 40, "\\", "end\n"]
    out, state = [], 1
    for k in range(n):
        text = ""
        for _ in range(k % 9):
            state = (state * 1103515245 + 12345) % 2**31
            text += parts[state % len(parts)]
        out.append(text)
    return [*out, "line\n" * 60, '"' * 50, "last"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_with_breaks_is_read_by_many_tasks(spark, tmp_path, small_splits, end):
    texts = free_texts(300)
    lines = ["k,t", *(f'{k},"{t.replace(chr(34), chr(34) * 2)}"' for k, t in enumerate(texts))]
    path = tmp_path / "s.csv"
    path.write_bytes((end.join(lines).replace("\n", end).replace("\r\r", "\r") + end).encode())
    df = readers.read_csv(spark, str(path), "k INT, t STRING", multiline=True)
    assert df.rdd.getNumPartitions() > 50
    want = {k: t or "" for k, t in enumerate(texts)}
    assert {r["k"]: r["t"] or "" for r in df.collect()} == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    at_once = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(str(path))
    assert {int(r["k"]): r["t"] or "" for r in at_once.collect()} == want


def test_several_files_with_breaks(spark, tmp_path, small_splits):
    write(tmp_path / "d" / "a.csv", 'k,"t"\n1,"one\n\ntwo"\n\n2,x\n')
    write(tmp_path / "d" / "b.csv", 'k,t\n3,"' + "long\n" * 100 + '"')
    write(tmp_path / "d" / "c.csv", "k,t\n")
    df = readers.read_csv(spark, str(tmp_path / "d"), multiline=True)
    assert {tuple(r) for r in df.collect()} == {("1", "one\n\ntwo"), ("2", "x"), ("3", "long\n" * 100)}
    write(tmp_path / "e" / "a.csv", "k,t\n1,2\n")
    write(tmp_path / "e" / "b.csv", "t,k\n2,1\n")
    with pytest.raises(Exception, match="header"):
        readers.read_csv(spark, str(tmp_path / "e"), multiline=True).collect()
    p = write(tmp_path / "odd.csv", 'k,t\n1,"never closed\n2,x\n')
    with pytest.raises(ValueError, match="quotes"):
        readers.read_csv(spark, p, multiline=True)


def test_types_are_folded_over_all_paths(spark, tmp_path):
    one = write(tmp_path / "a.csv", "i,l,d,day,t,b,s,n,mix,id\n1,1,1,2020-01-02,2020-01-02,true,x,NA,1,007\n-2,,2,,,False,,,,008\n")
    two = write(tmp_path / "b.csv", "l,i,d,t,day,b,s,mix,id,extra\n5000000000,3,.5e3,2020-01-02 03:04:05,2021-12-31,TRUE,1,2020-01-02,009,7\n")
    df = readers.read_csv_inferred(spark, [one, two], ["id"])
    assert dict(df.dtypes) == {
        "i": "int", "l": "bigint", "d": "double", "day": "date", "t": "timestamp", "b": "boolean", "s": "string",
        "n": "string", "mix": "string", "id": "string", "extra": "int",
    }
    got = {r["id"]: r for r in df.collect()}
    assert got["009"]["d"] == 500.0 and got["009"]["l"] == 5_000_000_000 and got["007"]["extra"] is None
    assert got["008"]["i"] == -2 and got["008"]["b"] is False and got["007"]["n"] is None
    assert readers.inferred_types(df, []) == {}


def test_lookup_without_header(spark, tmp_path):
    p = write(tmp_path / "x.csv", "11,P1,no\n12,P2,yes\n")
    df = readers.read_lookup(spark, p, ["SiteSpecificID", "PID", "Withdrawn"], drop=["Withdrawn"])
    assert {tuple(r) for r in df.collect()} == {("11", "P1"), ("12", "P2")}


def test_lookup_sheets(spark, tmp_path):
    write(tmp_path / "GENDERS" / "a.csv", "PID,GENDERRECODE\n1,Other\n")
    write(tmp_path / "RACEFS" / "a.csv", "PID,RACERECODE\n1,Latino\n")
    sheets = readers.read_lookups(spark, str(tmp_path), ["GENDERS", "RACEFS"])
    assert sheets["RACEFS"].first()["RACERECODE"] == "Latino"


def test_labels_travel_with_parquet(spark, tmp_path):
    df = B.with_labels(spark.createDataFrame([(1, "x")], "AGE int, T string"), {"AGE": "Age in years"})
    df.write.parquet(f"{tmp_path}/d")
    back, labels = readers.read_labelled(spark, f"{tmp_path}/d")
    assert {tuple(r) for r in labels.collect()} == {("AGE", "Age in years"), ("T", None)}
    assert back.count() == 1


def test_save_load_export(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1.5), ("", "q", None)], "k string, t string, v double")
    sinks.save_tables({"one": df, "two": df.limit(1)}, f"{tmp_path}/saved")
    back = sinks.load_tables(spark, f"{tmp_path}/saved", ["one", "two"])
    assert back["one"].exceptAll(df).count() == 0
    sinks.export_report({"Table 1": df.where("k = 'a'")}, f"{tmp_path}/out")
    files = list((tmp_path / "out" / "Table 1").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines() == ["k,t,v", "a,,1.5"]


def test_materialise_uses_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    out = sinks.materialise(spark.range(10))
    assert out.count() == 10
    path = out.inputFiles()[0]
    assert "/panelyst-" in path and (root is None or f"{root.rstrip('/')}/panelyst-" in path)


def test_the_folder_does_not_depend_on_the_master():
    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.sql.warehouse.dir": "hdfs://warehouse"})

    assert sinks.shared_folder(Session).startswith("hdfs://warehouse/staged/panelyst-")
    Session.conf["spark.checkpoint.dir"] = "s3://shared/"
    assert sinks.shared_folder(Session).startswith("s3://shared/panelyst-")

def test_profile(spark):
    df = spark.createDataFrame([(0, "a", 1.5), (1, "b", None), (None, "a", 2.5)], "f int, t string, v double")
    got = {r["variable"]: r for r in B.profile(df, exact_distinct=True).collect()}
    assert (got["f"]["n_null"], got["f"]["min"], got["f"]["max"], got["f"]["is_binary"]) == (1, "0", "1", 1)
    assert (got["t"]["n_distinct"], got["t"]["is_binary"], got["v"]["is_binary"]) == (2, 0, 0)
    labels = spark.createDataFrame([("f", "Flag"), ("gone", "Gone")], "variable string, label string")
    book = {r["variable"]: r["label"] for r in B.codebook(df, labels).collect()}
    assert book == {"f": "Flag", "t": None, "v": None}


def test_distinct_counts_by_bitmaps(spark):
    """Narrow, wide and sparse whole numbers, negative ones, all NULL, text and fractions."""
    n = 300_000
    df = spark.range(n).selectExpr(
        "CAST(id % 7 AS INT) - 3 AS code", "id * 5 AS wide", "(id % 1000) * 9007199254740 AS sparse",
        "CAST(IF(id % 2 = 0, NULL, id % 40000 - 20000) AS SMALLINT) AS negative", "CAST(NULL AS BIGINT) AS none",
        "CAST(id % 11 AS STRING) AS t", "id % 13 / 2 AS v", "CAST(id % 3 AS TINYINT) AS b",
    )
    want = {c: df.select(c).distinct().where(f"{c} IS NOT NULL").count() for c in df.columns}
    got = {r["variable"]: r for r in B.profile(df, exact_distinct=True).collect()}
    assert {c: r["n_distinct"] for c, r in got.items()} == want
    assert (got["negative"]["min"], got["negative"]["type"], got["wide"]["max"]) == ("-19999", "smallint", str(5 * (n - 1)))
    near = {r["variable"]: r["n_distinct"] for r in B.profile(df).collect()}
    assert all(abs(near[c] - want[c]) <= 0.03 * want[c] for c in want)
    parts = [B.distinct_sketches(df.where(f"wide % 10 = {k}"), ["wide", "t"]) for k in (0, 5)]
    merged = {r["variable"]: r["n_distinct"] for r in B.merged_distinct(parts[0].unionByName(parts[1])).collect()}
    assert abs(merged["wide"] - n) <= 0.03 * n and merged["t"] == 11


def test_extract_drops_columns_before_the_age_rule(spark):
    # The flag is 1 only on a minor's row: it stays, though all kept rows have 0.
    df = spark.createDataFrame([(1, 17, 1, 5, 0), (1, 20, 0, 5, 0), (1, 30, 0, None, 0), (0, 40, 1, 5, 0)], "s int, age int, flag int, h int, z int")
    out = B.analysis_extract(df, ["age", "flag", "h", "z"], F.col("s") == 1, F.col("age") >= 18, ["h"])
    assert out.columns == ["age", "flag", "h"] and [tuple(r) for r in out.collect()] == [(20, 0, 5)]
