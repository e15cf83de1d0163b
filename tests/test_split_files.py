"""Review files cut into blocks at every place, against the rows that were written."""

import csv
import random

import pytest

from reviewlens.sources import review_files

PIECES = ["a", "b ", '"', ",", "\n", "é", "x", "\r\n", '""', "\n\n"]


@pytest.mark.parametrize("size", [211, 4000])
def test_records_across_blocks(spark, tmp_path, size):
    make, rows = random.Random(size), {}
    for number in range(3):
        columns = ["recommendationid", "review", "appid"] if number < 2 else ["appid", "voted_up", "recommendationid", "review"]
        with open(tmp_path / f"{number}.csv", "w", newline="", encoding="utf-8-sig" if number == 1 else "utf-8") as f:
            out = csv.writer(f, lineterminator="\r\n" if number == 1 else "\n")
            out.writerow(columns)
            for i in range(60):
                text = "".join(make.choice(PIECES) for _ in range(make.randint(1, 40))).strip() or "q"
                if i in (7, 59):  # longer than several blocks
                    text = "start\n" + "a line\n" * 150 + '"end"'
                rows[number * 1000 + i] = (text, 5, True if number == 2 else None)
                row = {"recommendationid": number * 1000 + i, "review": text, "appid": 5, "voted_up": True}
                out.writerow([row[c] for c in columns])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = review_files.read_reviews(spark, str(tmp_path / "*.csv")).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(found) == len(rows)
    assert {r["recommendationid"]: (r["review"], r["appid"], r["voted_up"]) for r in found} == rows


def test_empty_and_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        review_files.read_reviews(spark, str(tmp_path / "none*.csv"))
    (tmp_path / "only_header.csv").write_text("recommendationid,review\n")
    (tmp_path / "empty.csv").write_text("")
    found = review_files.read_reviews(spark, str(tmp_path / "*.csv"))
    assert found.columns == ["recommendationid", "review"] and found.count() == 0
    (tmp_path / "open.csv").write_text('recommendationid,review\n1,"never closed\nsecond line\n\n2,x\n')
    rows = review_files.read_reviews(spark, str(tmp_path / "*.csv")).collect()
    assert len(rows) == 1 and rows[0]["recommendationid"] == 1 and "second line" in rows[0]["review"]
