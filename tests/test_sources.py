import datetime as dt
import http.server
import io
import threading
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import report
from tidemark.sources import fetch, store, tidy, workbook


def test_region_names(spark):
    names = ["Americas", "Asia Pacific/All Other", "Worldwide", "Total World", "1998", "Total Year", " JAPAN ", None, "", "US", "Europe"]
    x = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", tidy.region_name(F.col("n")).alias("r")).orderBy("i")
    assert [r["r"] for r in x.collect()] == ["americas", "asia_pacific", "worldwide", "worldwide", None, None, "japan", None, None, "americas", "europe"]


def xlsx(path):
    rows = [["Year", *["x"] * 12], ["2019"], ["Worldwide", *[str(1000 * m) for m in range(1, 13)]], ["2020"], ["Worldwide", *[str(2000 * m) for m in range(1, 13)]]]
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if not v.isdigit() else f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>'
    sheet = "".join(f'<row r="{i}">{"".join(cell(i, c, v) for c, v in enumerate(r))}</row>' for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="http://r"><sheets><sheet name="Monthly Data" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet><sheetData>{sheet}</sheetData></worksheet>")
    path.write_bytes(out.getvalue())


def test_workbook_to_tidy(spark, tmp_path):
    xlsx(tmp_path / "b.xlsx")
    workbook.register(spark)
    grid = spark.read.format("workbook").option("sheet", "Monthly Data").load(str(tmp_path / "b.xlsx"))
    again = workbook.read_sheet(spark, str(tmp_path / "b.xlsx"))
    assert again.columns == grid.columns and sorted(map(str, again.collect())) == sorted(map(str, grid.collect()))
    x = tidy.load_billings(grid, through="2020-06-30").orderBy("date").collect()
    assert len(x) == 18 and x[0]["value"] == 1.0 and x[-1]["value"] == 12.0 and x[0]["series"] == "wsts_worldwide"
    assert x[0]["published"] == dt.datetime(2019, 3, 7)


def test_company_json_and_core(spark):
    body = '{"status": 200, "data": [{"revenue_year": 2020, "revenue_month": 1, "revenue": 5, "create_time": "2020-02-10 08:00:00"}, {"revenue_year": 2020, "revenue_month": 2, "revenue": 6, "create_time": ""}]}'
    x = tidy.load_company(spark.createDataFrame([(body,), ('{"status": 402}',), ("junk",)], "body string"), "a").orderBy("date").collect()
    assert [r["published"] for r in x] == [dt.datetime(2020, 2, 10, 8), dt.datetime(2020, 3, 11)]
    y = tidy.load_company(spark.createDataFrame([(body.replace('"revenue_month": 2', '"revenue_month": 3'),)], "body string"), "b")
    both = tidy.load_company(spark.createDataFrame([(body,)], "body string"), "a").unionByName(y)
    assert [(r["date"].month, r["value"]) for r in tidy.core_aggregate(both).collect()] == [(1, 10.0)]
    assert tidy.core_aggregate(both, ["twrev_a", "twrev_gone"]).count() == 2


def test_csv_and_prices(spark, tmp_path):
    (tmp_path / "s.csv").write_text("DATE,X\n2020-01-01,1.5\n2020-02-01,.\n2020-03-01,2\nbad,3\n")
    x = tidy.load_csv_series(spark, str(tmp_path / "s.csv"), "x", lag_days=15).orderBy("date").collect()
    assert [(r["date"], r["value"], r["published"]) for r in x] == [(dt.date(2020, 1, 31), 1.5, dt.datetime(2020, 2, 15)), (dt.date(2020, 3, 31), 2.0, dt.datetime(2020, 4, 15))]
    d = spark.createDataFrame([(dt.date(2020, 1, 2), 1.0, None), (dt.date(2020, 1, 30), 2.0, 5.0), (dt.date(2020, 1, 31), None, None), (dt.date(2020, 2, 3), None, 6.0)], "date date, `^SOX` double, QQQ double")
    assert sorted((r["series"], r["date"].month, r["value"]) for r in tidy.load_prices(d).collect()) == [("px_QQQ", 1, 5.0), ("px_QQQ", 2, 6.0), ("px_SOX", 1, 2.0)]


def test_price_scan(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Day,^SOX,QQQ\n2020-01-02,1.5,\n2020-01-30,2.5,x\n2020-02-03,,7\nbad,9,9\n")
    got = sorted((r["series"], r["date"], r["value"]) for r in tidy.read_prices(spark, str(tmp_path / "p.csv")).collect())
    assert got == [("px_QQQ", dt.date(2020, 2, 29), 7.0), ("px_SOX", dt.date(2020, 1, 31), 2.5)]


def test_fetch_tries_again(spark):
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            ok = self.path != "/gone" and (self.path != "/late" or asked.count(self.path) > 2)
            self.send_response(200 if ok else 404 if self.path == "/gone" else 503)
            self.end_headers()
            self.wfile.write(b"body of " + self.path.encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    fetch.register(spark)
    rows = spark.read.format("web").option("urls", f"{at}/late {at}/now").option("wait", "0.01").load().collect()
    assert {(r["url"], bytes(r["body"])) for r in rows} == {(f"{at}/late", b"body of /late"), (f"{at}/now", b"body of /now")} and asked.count("/late") == 3
    pauses = []
    with pytest.raises(ConnectionError, match="404"):
        fetch.fetch(f"{at}/gone", sleep=pauses.append)
    with pytest.raises(ConnectionError):
        fetch.fetch("http://127.0.0.1:1/", sleep=pauses.append, timeout=1)
    assert asked.count("/gone") == 1 and pauses == [1.5, 3.0]
    server.shutdown()


def test_best_effort_and_implausible(spark):
    noise = np.random.default_rng(0).uniform(-1, 1, 60)
    ok = spark.createDataFrame([(dt.date(2000 + i // 12, i % 12 + 1, 28), "s", 100.0 + float(noise[i]) + (5000 if i == 58 else 0), None) for i in range(60)], tidy.SCHEMA)
    df, failed = tidy.best_effort(spark, {"ok": lambda: ok, "no": lambda: 1 / 0, "none": lambda: ok.limit(0)})
    assert df.count() == 60 and set(failed) == {"no", "none"}
    assert tidy.best_effort(spark, {})[0].count() == 0
    assert {r["date"].month for r in tidy.implausible_moves(ok).collect()} == {11, 12} and tidy.implausible_moves(ok).count() == 2


def test_store_and_manifest(spark):
    s = store.Store(spark, "t_store")
    x = spark.createDataFrame([(dt.date(2020, 1, 31), "a", 1.0, dt.datetime(2020, 2, 1))], tidy.SCHEMA)
    assert s.write("raw", x) == 1 and s.write("raw", x, replace=False) == 2 and s.write("raw", x) == 1
    assert "raw" in s.tables() and s.tidy(["raw", "gone"]).count() == 1 and s.sql("select count(*) c from t_store.raw").first()["c"] == 1
    with pytest.raises(ValueError):
        s.tidy(["gone"])
    two = x.union(spark.createDataFrame([(dt.date(2020, 2, 29), "b", None, None)], tidy.SCHEMA))
    assert store.manifest(two, "n").first() == store.manifest(two.orderBy("date", ascending=False), "n").first()


def test_report_survives_missing_values(spark):
    none = spark.createDataFrame([], "date date, phase string, value double")
    stats = spark.createDataFrame([], "months long, ann_return double, ann_vol double, sharpe double, max_drawdown double")
    text = report.brief(report.facts(none, stats))
    assert "unknown" in text and "n/a" in text
    page = report.dashboard("A < B", {"t": report.table(spark.range(2)), "c": report.line_chart([1.0, None, 2.0, 3.0]), "gone": ""})
    assert "http" not in page and "not available" in page and "A &lt; B" in page
