import datetime as dt
import io
import zipfile

import pytest
from helpers import dicts

from trunkwatch import schema as s
from trunkwatch.plans import imports
from trunkwatch.sources import store, tables, workbooks

ROWS = ("object_id,object_name,object_type,pipeline_id,lat,lon,year,material\n"
        "1,Задвижка «Щ»,crane,L-9,47.25,31.5,1987,Ы7\n"
        '2,"Отвод, левый",pipeline_section,L-4,-12.5,8.125,1994.0,Ё№\n')


def write(path, content, encoding):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content.encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1251"])
def test_charsets_read_alike(spark, tmp_path, encoding):
    rows = dicts(tables.read_objects(spark, write(tmp_path / "папка с пробелом" / "o.csv", ROWS, encoding)).orderBy("object_id"))
    assert [r["object_name"] for r in rows] == ["Задвижка «Щ»", "Отвод, левый"]
    assert [r["material"] for r in rows] == ["Ы7", "Ё№"]
    assert [r["year"] for r in rows] == [1987, 1994]
    assert rows[1]["lat"] == -12.5 and rows[0]["object_id"] == 1


def test_each_file_has_its_own_charset(spark, tmp_path):
    write(tmp_path / "a.csv", ROWS, "utf-8")
    write(tmp_path / "b.csv", ROWS, "cp1251")
    (tmp_path / "c.csv").write_bytes(ROWS.split("\n")[0].encode() + b"\n3,\x98\xe9,crane,MT-01,1,2,2000,x\n")
    found = {r["file"].rsplit("/", 1)[1]: r["charset"] for r in dicts(tables.detect_charsets(spark, str(tmp_path)))}
    assert found == {"a.csv": tables.UTF8, "b.csv": tables.CP1251, "c.csv": tables.LATIN1}
    names = [r["object_name"] for r in dicts(tables.read_objects(spark, str(tmp_path)))]
    assert sorted(names) == sorted(["Задвижка «Щ»", "Отвод, левый"] * 2 + ["\x98é"])


def test_mixed_charsets_are_joined_to_the_rows(spark, tmp_path):
    """No list of files is made; headers may come with a byte-order mark, and in another order in another charset."""
    head, one, two = ROWS.split("\n")[:3]
    for i in range(4):
        write(tmp_path / "in" / f"a{i}.csv", ROWS, "utf-8-sig" if i % 2 else "utf-8")
        write(tmp_path / "in" / f"b{i}.csv", "\n\n" + ROWS, "cp1251")
    (tmp_path / "in" / "c.csv").write_bytes(b"year,object_id,object_name\n2001,9,\x98\xe9\n1990,10,\"x, \xff\"\n")
    write(tmp_path / "in" / "empty.csv", "\n", "utf-8")
    rows = dicts(tables.read_objects(spark, str(tmp_path / "in")))
    names = sorted((r["object_id"], r["object_name"], r["year"], r["material"]) for r in rows)
    assert names == [(1, "Задвижка «Щ»", 1987, "Ы7")] * 8 + [(2, "Отвод, левый", 1994, "Ё№")] * 8 + [
        (9, "\x98é", 2001, None), (10, "x, ÿ", 1990, None)]
    write(tmp_path / "in" / "d.csv", "object_id,lat\n1,2\n", "utf-8")
    with pytest.raises(ValueError, match="differ"):
        tables.read_objects(spark, str(tmp_path / "in"))


def test_columns_go_by_name(spark, tmp_path):
    text = ("param2,date,defect_found,quality_grade,diag_id,humidity,object_id,method\n"
            "7.5,1998-11-23,TRUE,допустимо,908,61.25,77,TVK\nsoft,2003-07-09,false,,907,,31,GEO\n")
    rows = dicts(tables.read_diagnostics(spark, write(tmp_path / "d.csv", text, "utf-8-sig")).orderBy("diag_id"))
    assert [(r["diag_id"], r["defect_found"], r["humidity"], r["param2"], r["ml_label"]) for r in rows] == [
        (907, False, None, None, None), (908, True, 61.25, 7.5, None)]


def test_quotes_and_line_ends_inside_texts(spark, tmp_path):
    text = ('diag_id,object_id,method,date,defect_found,defect_description,ml_label\n'
            '1,1,UZK,2024-01-01,True,"трещина, ""глубокая"" \\ шов\nвторая строка",high\n'
            '2,1,NA,2024-01-02,True,,nan\n')
    write(tmp_path / "a.csv", text, "cp1251")
    write(tmp_path / "b.csv", text.replace("\nвторая", " вторая"), "utf-8")
    kinds = {(r["charset"], r["multi_line"]) for r in dicts(tables.detect_charsets(spark, str(tmp_path)))}
    assert kinds == {("cp1251", True), ("utf-8", False)}
    rows = dicts(tables.read_diagnostics(spark, str(tmp_path)))
    assert len(rows) == 4
    assert {r["defect_description"] for r in rows} == {
        'трещина, "глубокая" \\ шов\nвторая строка', 'трещина, "глубокая" \\ шов вторая строка', None}
    assert {(r["method"], r["ml_label"]) for r in rows if r["diag_id"] == 2} == {(None, None)}


def test_files_with_another_header_are_refused(spark, tmp_path):
    write(tmp_path / "a.csv", "object_id,lat\n1,2\n", "utf-8")
    write(tmp_path / "b.csv", "lat,object_id\n1,2\n", "utf-8")
    with pytest.raises(Exception):
        tables.read_objects(spark, str(tmp_path)).collect()


def test_headers_are_cleaned(spark):
    df = spark.createDataFrame([(1, 2)], ["\ufeff object_id", " lat\u200b "])
    assert tables.clean_headers(df).columns == ["object_id", "lat"]


def test_preview(objects):
    rows = dicts(tables.preview(objects(*[{"object_id": i} for i in range(25)])))
    assert len(rows) == 10 and rows[0]["row_count"] == 25 and rows[0]["columns"].startswith("object_id, object_name")


def workbook(path, rows, shared=True):
    """Rows of values; a date becomes a styled serial number."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    texts = sorted({v for row in rows for v in row if isinstance(v, str)})

    def cell(at, v):
        ref = f'r="{chr(65 + at)}1"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {ref} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, dt.date):
            return f'<c {ref} s="1"><v>{(v - dt.date(1899, 12, 30)).days}</v></c>'
        if isinstance(v, str):
            if shared:
                return f'<c {ref} t="s"><v>{texts.index(v)}</v></c>'
            return f'<c {ref} t="inlineStr"><is><t>{v}</t></is></c>'
        return f"<c {ref}><v>{v}</v></c>"

    body = "".join("<row>" + "".join(cell(i, v) for i, v in enumerate(row)) + "</row>" for row in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/'
                      'officeDocument/2006/relationships"><sheets><sheet name="a" sheetId="1" r:id="rId7"/>'
                      '<sheet name="b" sheetId="2" r:id="rId8"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/'
                      '2006/relationships"><Relationship Id="rId8" Target="worksheets/other.xml"/>'
                      '<Relationship Id="rId7" Target="/xl/worksheets/first.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/>'
                      '</numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        if shared:
            book.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(
                f"<si><r><t>{t[:1]}</t></r><r><t>{t[1:]}</t></r></si>" for t in texts) + "</sst>")
        book.writestr("xl/worksheets/first.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        book.writestr("xl/worksheets/other.xml", f"<worksheet {main}><sheetData/></worksheet>")
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(out.getvalue())


HEAD = [" diag_id", "object_id", "method", "date", "defect_found", "param1"]


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [HEAD, [1, 5, "UZK", dt.date(2024, 2, 29), True, 12.5], [None] * 6,
                                   [2, 5, "Щуп", "2024-03-01", False, None]])
    workbook(tmp_path / "b.xlsx", [HEAD[::-1], [None, True, dt.date(2023, 1, 1), "VIK", 6, 3]], shared=False)
    read = tables.conform(workbooks.read_workbooks(spark, str(tmp_path), s.DIAGNOSTICS), s.DIAGNOSTICS)
    assert set(read.columns) == {h.strip() for h in HEAD}
    rows = {r["diag_id"]: r for r in dicts(read)}
    assert (rows[1]["date"], rows[1]["defect_found"], rows[1]["param1"]) == ("2024-02-29", True, 12.5)
    assert (rows[2]["method"], rows[2]["defect_found"]) == ("Щуп", False)
    assert (rows[3]["object_id"], rows[3]["date"]) == (6, "2023-01-01")


def test_column_missing_from_one_workbook_is_missing(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [HEAD, [1, 5, "UZK", "2024-01-01", True, 1]])
    workbook(tmp_path / "b.xlsx", [HEAD[:4], [2, 5, "UZK", "2024-01-01"]])
    read = workbooks.read_workbooks(spark, str(tmp_path), s.DIAGNOSTICS)
    assert set(read.columns) == {"diag_id", "object_id", "method", "date"}


def test_corrupt_workbooks_and_empty_sheets(spark, tmp_path):
    workbook(tmp_path / "in" / "a.xlsx", [HEAD, [1, 5, "UZK", "2024-01-01", True, 1]])
    workbook(tmp_path / "in" / "empty.xlsx", [])
    done = imports.import_diagnostics(spark, str(tmp_path / "in"), str(tmp_path / "s1"), "xlsx")
    assert done.status == "FAILED" and "Отсутствуют" in done.errors[0]
    (tmp_path / "in" / "empty.xlsx").write_bytes((tmp_path / "in" / "a.xlsx").read_bytes()[:700])
    done = imports.import_diagnostics(spark, str(tmp_path / "in"), str(tmp_path / "s2"), "xlsx")
    assert done.status == "ERROR" and "empty.xlsx" in done.errors[0]
    (tmp_path / "in" / "empty.xlsx").write_bytes(b"")
    assert imports.import_diagnostics(spark, str(tmp_path / "in"), str(tmp_path / "s3"), "xlsx").rows_imported == 1


# --- imports -----------------------------------------------------------------------

DIAG = "diag_id,object_id,method,date,defect_found\n"


def test_imports_replace_and_log(spark, tmp_path):
    root = str(tmp_path / "store")
    first = imports.import_objects(spark, write(tmp_path / "o.csv", ROWS, "cp1251"), root)
    assert (first.success, first.rows_imported, first.errors) == (True, 2, [])
    assert len(first.preview) == 2 and store.current(spark, root, "objects").count() == 2

    good = imports.import_diagnostics(spark, write(tmp_path / "d1.csv", DIAG + "1,1,UZK,2024-01-01,true\n", "utf-8"), root)
    assert good.success and store.current(spark, root, "diagnostics").columns == s.DIAGNOSTICS.fieldNames()

    bad = imports.import_diagnostics(spark, write(
        tmp_path / "d2.csv", DIAG + "1,1,ZZ,2024-01-01,true\n1,77,UZK,,true\n", "utf-8"), root)
    assert bad.errors == ["Дублирующиеся diag_id: [1]", "Ссылки на несуществующие object_id: [77]"]
    assert bad.warnings == ["Некорректных дат: 1", "Неизвестные методы: [ZZ]"]
    assert store.current(spark, root, "diagnostics").count() == 1  # still the former table

    short = imports.import_diagnostics(spark, write(tmp_path / "d3.csv", "diag_id,Method\n1,UZK\n", "utf-8"), root)
    assert short.errors == [s.ERR_MISSING_COLUMNS % ("object_id, method, date, defect_found", "diag_id, Method")]

    gone = imports.import_objects(spark, str(tmp_path / "none.csv"), root)
    assert (gone.success, gone.status) == (False, "ERROR")
    odd = imports.import_objects(spark, str(tmp_path / "o.csv"), root, "pdf")
    assert odd.status == "ERROR"

    again = imports.import_diagnostics(spark, write(
        tmp_path / "d4.csv", DIAG + "7,2,UZK,2024-01-01,true\n8,2,UZK,2024-01-01,true\n", "utf-8"), root)
    assert again.success and {r["diag_id"] for r in dicts(store.current(spark, root, "diagnostics"))} == {7, 8}

    log = dicts(store.import_log(spark, root))
    assert [(r["file"], r["status"], r["rows"]) for r in log] == [
        ("o.csv", "SUCCESS", 2), ("d1.csv", "SUCCESS", 1), ("d2.csv", "FAILED", None), ("d3.csv", "FAILED", None),
        ("none.csv", "ERROR", None), ("o.csv", "ERROR", None), ("d4.csv", "SUCCESS", 2)]
    assert log[2]["errors"] == bad.errors


def test_training_follows_a_good_import(spark, tmp_path):
    lines = "".join(f"{i},1,UZK,2024-01-01,true,{i},{'high' if i > 50 else 'normal'}\n" for i in range(100))
    head = DIAG.strip() + ",param1,ml_label\n"
    result, fit = imports.import_and_train(spark, write(tmp_path / "d.csv", head + lines, "utf-8"), str(tmp_path / "store"))
    assert result.success and fit.is_trained and fit.labels == ["high", "normal"]
    result, fit = imports.import_and_train(spark, write(tmp_path / "e.csv", "diag_id\n1\n", "utf-8"), str(tmp_path / "store"))
    assert not result.success and fit is None


def test_values_do_not_get_lost_unnoticed(spark, tmp_path):
    text = DIAG.strip() + ",temperature\n2,1,UZK,2024-13-01,true,warm\n1,1,UZK,,nan,\n3,1,\"A, B\",2024-01-01,da,hot\n"
    result = imports.import_diagnostics(spark, write(tmp_path / "d.csv", text.replace('\\"', '"'), "utf-8"), str(tmp_path / "s"))
    assert result.success
    assert result.warnings == ["Некорректных дат: 2", "Неизвестные методы: [A, B]",
                               "Колонка 'defect_found' содержит 1 нечитаемых значений",
                               "Колонка 'temperature' содержит 2 нечитаемых значений"]
    assert [r["diag_id"] for r in result.preview] == [2, 1, 3]  # as in the file
    assert store.current(spark, str(tmp_path / "s"), "diagnostics").columns == s.DIAGNOSTICS.fieldNames()


def test_references_are_not_checked_without_objects(spark, tmp_path):
    path = write(tmp_path / "d.csv", DIAG + "1,1,UZK,2024-01-01,true\n", "utf-8")
    assert imports.import_diagnostics(spark, path, str(tmp_path / "store")).success
    assert store.current(spark, str(tmp_path / "store"), "objects") is None


def test_workbook_import(spark, tmp_path):
    workbook(tmp_path / "d.xlsx", [HEAD, [1, 5, "UZK", dt.date(2024, 2, 29), True, 12.5]])
    assert imports.import_diagnostics(spark, str(tmp_path / "d.xlsx"), str(tmp_path / "store"), "xlsx").success


def test_odd_column_and_file_names(spark, tmp_path):
    head, one, two = ROWS.split("\n")[:3]
    write(tmp_path / "in" / "Objects[1].csv", f"{head},extra.note,a`b\n{one},x,y\n", "utf-8")
    root = str(tmp_path / "store")
    done = imports.import_objects(spark, str(tmp_path / "in"), root)
    assert (done.status, done.rows_imported) == ("SUCCESS", 1)
    write(tmp_path / "in" / "o{2}*.csv", f"{head},extra.note,a`b\n{two},x,y\n", "cp1251")
    assert imports.import_objects(spark, str(tmp_path / "in"), root).rows_imported == 2


def test_every_unknown_value_is_told(spark, tmp_path):
    rows = "".join(f"{i},1,M{i:02},2024-01-01,true\n" for i in range(30))
    done = imports.import_diagnostics(spark, write(tmp_path / "d.csv", DIAG + rows, "utf-8"), str(tmp_path / "store"))
    assert done.success and done.warnings == [f"Неизвестные методы: [{', '.join(f'M{i:02}' for i in range(30))}]"]


def test_many_unknown_values_are_rows_of_a_table(spark, tmp_path):
    rows = "".join(f"{i},1,M{i // 2},2024-01-01,true\n" for i in range(600))
    done = imports.import_diagnostics(spark, write(tmp_path / "d.csv", DIAG + rows, "utf-8"), str(tmp_path / "store"))
    (path,) = (tmp_path / "store" / "import_unknown").glob("*/method")
    assert done.success and done.warnings == [f"Неизвестные методы: 300 ({path})"]
    assert {(r["value"], r["n_rows"]) for r in spark.read.parquet(str(path)).collect()} == {(f"M{i}", 2) for i in range(300)}


def test_batch_is_parsed_once(spark, tmp_path, monkeypatch):
    parsed = spark.sparkContext.accumulator(0)
    real = imports.read_batch

    def counted(*args):
        batch = real(*args)
        count = lambda rows: [parsed.add(1) or r for r in rows]
        return spark.createDataFrame(batch.rdd.mapPartitions(count), batch.schema)

    monkeypatch.setattr(imports, "read_batch", counted)
    rows = "".join(f"{i},{i % 7},UZK,2024-01-01,true\n" for i in range(500))
    assert imports.import_diagnostics(spark, write(tmp_path / "d.csv", DIAG + rows, "utf-8"), str(tmp_path / "store")).success
    assert parsed.value == 500
