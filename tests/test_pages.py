import json

from changelens.sources import pages
from changelens.sources.tables import taken_while
from pyspark.sql import functions as F


def test_reading_stops_at_the_first_old_page(spark, tmp_path):
    """Two listings of five pages; what was fetched is told by the files that fetching leaves behind."""
    asked = tmp_path / "asked"
    asked.mkdir()
    want = []
    for repo in ("a", "b"):
        for p in range(5):
            rows = [(repo, 100 - 10 * p - i, f"2024-03-{28 - 5 * p - i:02}") for i in range(4)]
            want += rows
            last = f"{repo}-{p + 1}" if p < 4 else None
            (tmp_path / f"{repo}-{p}.json").write_text(json.dumps({"rows": rows, "next": last, "tag": f"t{p}"}))

    def body(address):
        got = json.loads((tmp_path / f"{address}.json").read_text())
        return pages.Page([tuple(r) for r in got["rows"]], got["next"], got["tag"])

    def fetch(address, tag):
        (asked / f"{address}{'-' + tag if tag else ''}").touch()
        return pages.Page(None) if tag else body(address)

    def fetched():
        names = sorted(p.name for p in asked.iterdir())
        for p in asked.iterdir():
            p.unlink()
        return names

    listing = pages.Listing("repo STRING, number INT, updated_at STRING", "updated_at", ("a-0", "b-0"), fetch, lambda address: body(address) if address == "a-0" else None)
    pages.register(spark, "listing", listing)
    everything = spark.read.format("listing").load()
    assert sorted(map(tuple, everything.collect())) == sorted(want)
    assert fetched() == ["a-0-t0", "a-1", "a-2", "a-3", "a-4", "b-0", "b-1", "b-2", "b-3", "b-4"]
    new = everything.where("updated_at > '2024-03-22'")
    assert sorted(map(tuple, new.collect())) == sorted(r for r in want if r[2] > "2024-03-22")
    assert fetched() == ["a-0-t0", "a-1", "b-0", "b-1"]
    same = taken_while(spark.createDataFrame(want, listing.schema), F.col("updated_at") <= "2024-03-22", [F.desc("updated_at")], ["repo"])
    assert sorted(map(tuple, new.collect())) == sorted(tuple(r) for r in same.where("updated_at > '2024-03-22'").select("repo", "number", "updated_at").collect())
    fetched()
    assert everything.where("number < 0").count() == 0 and len(fetched()) == 10
