"""Workbooks: round trips, and files as other programs write them."""

import zipfile

from curvecast.sources import readers, xlsx

M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _book(path, sheets, shared=None):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {M} {R}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        target = lambda i: f"worksheets/s{i}.xml" if i % 2 else f"/xl/worksheets/s{i}.xml"  # noqa: E731  (both forms occur)
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{target(i)}"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {M}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {M}>{shared}</sst>")


def _read(spark, path, schema, **options):
    xlsx.register(spark)
    return spark.read.format("xlsx").schema(schema).options(**options).load(str(path))


def test_round_trip_by_files(spark, tmp_path):
    rows = [(f"a<&>\"' {i} é\n", i / 7, None if i % 3 else i, i % 2 == 0) for i in range(50)] + [(None, None, 2**60 + 1, None), ("", 1e-300, -5, True)]
    schema = "name string, x double, k long, `is.on` boolean"
    xlsx.register(spark)
    spark.createDataFrame(rows, schema).repartition(4).write.format("xlsx").mode("append").save(f"file://{tmp_path}/out")
    back = _read(spark, f"file://{tmp_path}/out", schema)
    assert back.rdd.getNumPartitions() == len(list((tmp_path / "out").glob("*.xlsx"))) == 4
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, back.collect()), key=key) == sorted(rows, key=key)


def test_columns_by_name_shared_strings_gaps_and_bad_cells(spark, tmp_path):
    shared = '<si><t>Facility.Name</t></si><si><r><t>No</t></r><r><t>rth</t></r><rPh sb="0" eb="1"><t>zzz</t></rPh></si><si><t>Capacity</t></si>'
    head = '<row r="1"><c r="B1" t="s"><v>2</v></c><c r="D1" t="s"><v>0</v></c><c r="AA1" t="inlineStr"><is><t>longi</t></is></c></row>'
    body = '<row r="2"><c r="B2"><v>12.5</v></c><c r="D2" t="s"><v>1</v></c><c r="AA2"><v>-99</v></c></row><row r="3"/>'
    body += '<row r="4"><c r="B4" t="str"><v>n/a</v></c><c r="AA4" t="e"><v>#DIV/0!</v></c><c r="D4" t="str"><v>South</v></c></row>'
    _book(tmp_path / "a.xlsx", {"notes": '<row r="1"><c r="A1"><v>1</v></c></row>', "sites": head + body}, shared)
    (tmp_path / "b.txt").write_text("no workbook")
    got = _read(spark, tmp_path, "`Facility.Name` string, longi double, lati double, Capacity double", sheet="sites").collect()
    assert sorted(map(tuple, got)) == [("North", -99.0, None, 12.5), ("South", None, None, None)]
    _book(tmp_path / "one.xlsx", {"sites": head + body}, shared)
    assert {tuple(r) for r in readers.read_sites_wind_xlsx(spark, str(tmp_path / "one.xlsx")).collect()} == {("North", -99.0, None, 12.5), ("South", None, None, None)}


def test_empty_tables_and_missing_paths(spark, tmp_path):
    _book(tmp_path / "a.xlsx", {"s": ""})
    assert _read(spark, tmp_path, "a string").count() == 0
    xlsx.register(spark)
    spark.createDataFrame([], "a string").write.format("xlsx").mode("append").save(str(tmp_path / "none"))
    assert not list(tmp_path.glob("none/*"))
    for bad in (lambda: _read(spark, tmp_path / "absent", "a string").count(), lambda: _read(spark, tmp_path, "a string", sheet="t").count()):
        try:
            bad()
        except Exception:
            continue
        raise AssertionError("no error")
