import gzip
from urllib.parse import quote

from lingoscope.sources import files, sitemap

URL = "https://a.test/é/x y+z?q=1&r=%2F"


def put(root, run, address, ending, body):
    folder = root / f"run_id={run}"
    folder.mkdir(exist_ok=True)
    (folder / (quote(address, safe="") + ending)).write_bytes(body)


def test_sitemaps_from_files(spark, tmp_path):
    text = "<urlset><url><loc>https://a.test/1</loc></url><url><loc>https://a.test/2</loc></url></urlset>"
    put(tmp_path, "r", URL, ".xml.gz", gzip.compress(text.encode()))
    put(tmp_path, "r", "https://a.test/broken", ".xml.gz", gzip.compress(text.encode())[:12])
    put(tmp_path, "s", "https://a.test/plain", ".xml.gz", text.encode())
    put(tmp_path, "s", "https://a.test/other", ".png", b"x")
    rows = {(r["run_id"], r["sitemap"]): r["text"] for r in files.sitemaps(spark, str(tmp_path)).collect()}
    assert set(rows) == {("r", URL), ("r", "https://a.test/broken"), ("s", "https://a.test/plain")}
    assert rows["r", URL] == rows["s", "https://a.test/plain"] == text
    entries = sitemap.parse(files.sitemaps(spark, str(tmp_path)).where("sitemap like '%plain'"))
    assert entries.count() == 2


def test_pictures_are_chosen_before_bytes_are_read(spark, tmp_path):
    for k in range(4):
        put(tmp_path, f"r{k % 2}", f"https://a.test/{k}", ".png", bytes(10 * (k + 1)))
    rows = files.pictures(spark, str(tmp_path)).where("run_id = 'r1' and length > 20")
    assert [(r["url"], r["length"], bytes(r["picture"])) for r in rows.collect()] == [("https://a.test/3", 40, bytes(40))]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "GreaterThan(length,20)" in plan
