import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cleanframe import clean, read_csv, read_file, read_json, read_parquet, write_csv, write_json
from cleanframe.sources import readers

COLUMNS = ("sku", "price", "in_stock", "shipped", "units", "kind")
# Twelve clean rows, defects laid over single cells, and an early row once more at the end.
CLEAN = [(f"K-{i:03d}", f"{40 + i},{5 * i:02d}", "sim" if i % 3 else "não", f"{2 * i + 1:02d}.11.2023".replace(".", "/"), str(200 - i), "lamp") for i in range(12)]
DEFECTS = {(1, "kind"): " LAMP  ", (3, "units"): "N/A", (8, "price"): "7.777,00", (10, "price"): "", (5, "shipped"): "", (11, "kind"): "-", (6, "in_stock"): "null"}
READ_AS_NULL = {(3, "units"), (10, "price"), (5, "shipped"), (6, "in_stock")}


@pytest.fixture
def sample(tmp_path):
    rows = [[DEFECTS.get((i, c), v) for c, v in zip(COLUMNS, row)] for i, row in enumerate(CLEAN)]
    path = tmp_path / "stock.csv"
    path.write_text("\n".join("|".join(r) for r in [COLUMNS, *rows, rows[2]]), encoding="utf-8")
    return str(path)


def test_csv_reads_text_and_nulls(spark, sample):
    found = read_csv(spark, sample, row_id="n").orderBy("n").collect()
    assert len(found) == 13 and tuple(found[0].asDict()) == ("n", *COLUMNS)
    for r in found[:12]:
        for c, v in zip(COLUMNS, CLEAN[r["n"]]):
            at = (r["n"], c)
            assert r[c] == (None if at in READ_AS_NULL else DEFECTS.get(at, v))


def test_byte_order_mark_and_latin1(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("nome,x\nJosé,1\n".encode("utf-8-sig"))
    (tmp_path / "latin.txt").write_bytes("nome;x\nJosé;1\n".encode("latin-1"))
    assert [tuple(r) for r in read_file(spark, str(tmp_path / "bom.csv")).collect()] == [("José", "1")]
    assert read_file(spark, str(tmp_path / "bom.csv")).columns == ["nome", "x"]
    assert readers.detect_encoding(spark, str(tmp_path / "latin.txt")) == "ISO-8859-1"
    assert [tuple(r) for r in read_file(spark, str(tmp_path / "latin.txt")).collect()] == [("José", "1")]


@pytest.mark.parametrize("text, sep", [
    ("a,b\n1,2\n", ","), ("a;b\n1,5;2\n3,5;4\n", ";"), ("a\tb\nx y\tz\n", "\t"), ("a|b|c\n1|2|3\n", "|"),
    ('a;b\n"x,y,z";1\n"u,v";2\n', ";"), ("one\ntwo\n", ","),
])
def test_separator(spark, tmp_path, text, sep):
    (tmp_path / "f.txt").write_text(text)
    assert readers.detect_separator(spark, str(tmp_path / "f.txt")) == sep


def test_tsv_and_quotes(spark, tmp_path):
    (tmp_path / "f.tsv").write_text('a\tb\n"x ""y"""\t1\n')
    assert [tuple(r) for r in read_file(spark, str(tmp_path / "f.tsv")).collect()] == [('x "y"', "1")]


def test_typed_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("i,g,d,b,t\n1,1,1.5,True,a\n2,,2,False,1\n")
    df = read_csv(spark, str(tmp_path / "f.csv"), typed=True)
    assert df.dtypes == [("i", "bigint"), ("g", "double"), ("d", "double"), ("b", "boolean"), ("t", "string")]


def test_json_array_and_lines(spark, tmp_path):
    records = [{"a": 1, "b": {"c": {"d": "x"}, "e": 2.5}, "l": [1, 2]}, {"a": 2, "b": {"c": {"d": None}, "e": None}, "l": []}]
    (tmp_path / "array.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in records))
    for name in ("array.json", "lines.json"):
        df = read_json(spark, str(tmp_path / name), row_id="n").orderBy("n")
        assert df.columns == ["n", "a", "b.c.d", "b.e", "l"]
        assert [tuple(r) for r in df.collect()] == [(0, 1, "x", 2.5, [1, 2]), (1, 2, None, None, [])]


def test_parquet_row_ids_over_files(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1000).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(path)
    df = read_parquet(spark, path, row_id="row_id")
    assert df.where("id <> row_id").count() == 0 and df.count() == 1000


def test_writers(spark, tmp_path):
    df = spark.sql("select 1 as a, 'x;\"y' as t, cast(null as string) as n, timestamp_ntz'2024-01-02 03:04:05' as ts, array(1, 2) as l")
    write_csv(df, str(tmp_path / "c"), sep=";")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "c"), ";").collect()][0][:3] == ("1", 'x;"y', None)
    write_json(df, str(tmp_path / "j"))
    line = next(p for p in Path(tmp_path / "j").glob("part-*") if p.stat().st_size).read_text()
    assert json.loads(line)["n"] is None and json.loads(line)["ts"].startswith("2024-01-02T03:04:05")
    with pytest.raises(ValueError):
        write_csv(df, str(tmp_path / "d"), sep="|")
    with pytest.raises(ValueError):
        read_file(spark, "table.xlsx")


def test_sample_file_from_reading_to_export(spark, sample, tmp_path):
    done = clean(read_csv(spark, sample, row_id="row_id"), {"rename": {"units": "left"}}, {"columns": {"price": {"outliers": "clip"}}})
    kinds = done.prepared.kinds
    assert (kinds["price"], kinds["left"], kinds["shipped"], kinds["in_stock"]) == ("numeric", "numeric", "date", "boolean")
    out = {r["row_id"]: r for r in done.treated.df.collect()}
    assert set(out) == set(range(12))
    assert all(out[i][c] is not None for i, c in ((3, "left"), (10, "price"), (5, "shipped")))
    assert 51 <= out[8]["price"] < 7_777
    changes = {r["row_id"]: r for r in done.changed().collect()}
    assert changes[10]["price_imputed"] and changes[8]["price_changed"] and not changes[4]["price_changed"]
    counted = done.summary().first()
    assert (counted["duplicates"], counted["outliers"]) == (1, 1)
    write_csv(done.df, str(tmp_path / "out"))
    assert read_csv(spark, str(tmp_path / "out"), ",").count() == 12


def test_separator_is_judged_by_all_lines(spark, tmp_path):
    (tmp_path / "late.txt").write_text("a;b,c\n" + "1;2,3\n" * 700 + "1,2;3,4\n" * 30)
    assert readers.detect_separator(spark, str(tmp_path / "late.txt")) == ";"


def test_json_objects_over_several_lines(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"a": 1, "b": {"c": "x"}}, indent=2))
    assert [tuple(r) for r in read_json(spark, str(tmp_path / "one.json")).collect()] == [(1, "x")]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_one_broken_line_loses_no_other(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"a": 1}\n{"a": 2\n{"a": 3}\n')
    df = read_json(spark, str(tmp_path / "f.json"))
    assert df.columns == ["a", "bad_record"] and rows_of(df) == [(1, None), (3, None), (None, '{"a": 2')]
    assert rows_of(read_json(spark, str(tmp_path / "f.json"), bad="drop")) == [(1,), (3,)]
    with pytest.raises(ValueError, match='"a": 2'):
        read_json(spark, str(tmp_path / "f.json"), bad="error")
    assert rows_of(read_json(spark, str(tmp_path / "f.json"), schema="a long", row_id="n")) == [(0, 1, None), (1, None, '{"a": 2'), (2, 3, None)]


def test_several_objects_over_several_lines(spark, tmp_path):
    records = [{"a": i, "b": {"t": '} { "x" \\ [' + str(i)}, "l": [{"k": i}, {"k": -i}]} for i in range(40)]
    text = "\n".join(json.dumps(r, indent=2) for r in records[:20]) + " " + "".join(json.dumps(r, indent=1) for r in records[20:])
    (tmp_path / "f.json").write_text("\ufeff" + text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # records go over the borders of splits
    try:
        got = read_json(spark, str(tmp_path / "f.json"), row_id="n").orderBy("n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["n"], r["a"], r["b.t"], [x["k"] for x in r["l"]]) for r in got] == [(i, i, r["b"]["t"], [i, -i]) for i, r in enumerate(records)]


def test_each_json_file_has_its_own_layout(spark, tmp_path):
    folder = tmp_path / "several files"
    folder.mkdir()
    (folder / "a.json").write_text('{"a": 1}\n{"a": 2}\n{"a":\n')
    (folder / "b.json").write_text(json.dumps([{"a": 3}, {"a": 4}], indent=1))
    (folder / "c.json").write_text('[{"a": 5},{"a": 6}]')
    (folder / "d.json").write_text(json.dumps({"a": 7}, indent=1) + "\n" + json.dumps({"a": 8}, indent=1) + '\n{"a": 9,\n "b": ')
    (folder / "e.json").write_text('[{"a": 10}, {"a"')
    (folder / "f.json").write_text('{"a": 9}\n{"a": 10}\n[{"a": 11}, {"a": 12}]\n')
    got = read_json(spark, str(folder))
    assert sorted(r["a"] for r in got.where("bad_record is null").collect()) == list(range(1, 13))
    assert {r["bad_record"].split(":")[0] for r in got.where("bad_record is not null").collect()} == {'{"a"', '[{"a"'}
    assert got.where("bad_record is not null").count() == 3


def test_quoted_line_breaks_and_encodings_by_file(spark, tmp_path):
    folder = tmp_path / "csv files"
    folder.mkdir()
    (folder / "a.csv").write_text('k,t\n1,"x\ny"\n2,"he said ""so"""\n', encoding="utf-8")
    (folder / "b.csv").write_text("k,t\n3,são\n", encoding="utf-8")
    (folder / "c.csv").write_text("k,t\n4,não\n", encoding="latin-1")
    (folder / "d.csv").write_text('k,t\n5,"á\n\nb"\n', encoding="latin-1")
    expected = [("1", "x\ny"), ("2", 'he said "so"'), ("3", "são"), ("4", "não"), ("5", "á\n\nb")]
    assert rows_of(read_csv(spark, str(folder), ",")) == expected
    numbered = read_csv(spark, str(folder), ",", row_id="n").orderBy("n").collect()
    assert [tuple(r) for r in numbered] == [(i, *row) for i, row in enumerate(expected)]
    assert rows_of(read_csv(spark, str(folder / "a.csv"), ",")) == expected[:2]
