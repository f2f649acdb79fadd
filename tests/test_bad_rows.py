import csv
import io

from conftest import rows_of
from hypothesis import given, settings, strategies as st

from lontar.operators import bad_rows as br

GOOD = 'Izin,"Izin adalah ""surat"", sah.",Undang-Undang Nomor 1 Tahun 2000,Hukum Umum,https://a.example/x?y=1,OK'
CASES = {
    GOOD: None,
    GOOD + "\r\n": None,
    'a,"b\nc kata",d,,HTTP://h:80/p,': None,
    'a,"b,c,d,e,f': "quoting",
    'a,b "kata",c,,http://h,x': "quoting",
    'a,"b"x,c,,http://h,x': "quoting",
    'a,"b" ,c,,http://h,x': "quoting",
    'a, "b kata",c,,http://h,x': "quoting",
    'a,"b \\"kata\\" c",d,,http://h,x': "quoting",
    "a,b,c": "column_count",
    "": "column_count",
    "a,kata,c,,http://h,x,": "column_count",
    "a,kata\nkata,c,,http://h,x": "column_count",
    "a,,c,,http://h,x": "value",
    "a,12.5,c,,http://h,x": "value",
    "a,#VALUE!,c,,http://h,x": "value",
    "a,.....,c,,http://h,x": "value",
    "a,kata \x07,c,,http://h,x": "value",
    "a,kata �,c,,http://h,x": "value",
    "a,kata,c,2019-07-14 00:00:00,http://h,x": "value",
    "a,kata,c,14 Juli 2019,http://h,x": "value",
    "a,kata,c,=VLOOKUP(A2;B:C;2),http://h,x": "value",
    "a,kata,c,???,http://h,x": "value",
    "a,kata,c,,ftp://h,x": "value",
    "a,kata,c,,https:///p,x": "value",
    "a,kata,c,,https://a b/p,x": "value",
    "a,kata,c,,https://h/a b,x": "value",
    "a,kata,c,,,x": "value",
    ",".join(br.COLUMNS): "value",
    None: "column_count",
}


def test_reasons(spark):
    listed = list(enumerate(CASES))
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in listed], "line_no long, raw_line string, row string, value int")
    cells = br.parse_cells(df)
    found = {r.row: r.reason for r in br.failures(cells).collect()}
    assert {x: found.get(i) for i, x in listed} == CASES
    loaded = br.load_valid(cells).collect()
    assert {r.row for r in loaded} == {i for i, x in listed if CASES[x] is None}
    assert next(r for r in loaded if r.row == 0).pengertian == 'Izin adalah "surat", sah.'


def test_empty_repeated_and_long(spark):
    empty = br.parse_cells(spark.createDataFrame([], "line_no long, raw_line string"))
    assert rows_of(br.failures(empty)) == [] and rows_of(br.load_valid(empty)) == []
    long = 'a,"' + 'kata ""x"" ' * 50_000 + '",c,,http://h,x'
    cells = br.parse_cells(spark.createDataFrame([(1, long), (2, "x"), (2, "x")], "line_no long, raw_line string"))
    assert rows_of(br.failures(cells)) == [(2, "column_count"), (2, "column_count")]
    assert len(br.load_valid(cells).first().pengertian) == 50_000 * len('kata "x" ')


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab ,"\n', max_size=6), min_size=1, max_size=6))
def test_cells_round_trip(cells):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(cells)
    assert br.split_record(out.getvalue()) == (cells, True)
