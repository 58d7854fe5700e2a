"""Keep-first in file order and by keys of any type (merge fixture)."""
import os

from pyspark.sql import functions as F

from ulasan.plans.corpus import merge_sources, sort_corpus
from ulasan.session import scratch_path
from ulasan.sources.registry import SourceSpec


def write_csv(path, header, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(header + "\n" + "".join(r + "\n" for r in rows))


def test_merge_fixture_of_four_csv_sources_without_ids(spark):
    top = scratch_path(spark, "csv").removeprefix("file://")
    write_csv(f"{top}/x.csv", "text,date", ["' sama persis ',2025-03-02".replace("'", '"'), "dua kali,2025-01-05", "dua kali,2025-01-04"])
    # two files and, by the small splits below, many partitions
    write_csv(f"{top}/youtube/a.csv", "Comment,PublishedTime,more", ["sama persis,2025-01-01,1"] + [f"isi {i % 50},2025-02-{1 + i // 50:02d},0" for i in range(1000)])
    write_csv(f"{top}/youtube/b.csv", "Comment,PublishedTime,more", [f"isi {i},2025-01-01,0" for i in range(60)])
    write_csv(f"{top}/instagram.csv", "Comment,Date", [",2025-01-01", "isi 55,2025-01-01", "lain,2025-01-03"])
    write_csv(f"{top}/kaggle.csv", "full_text,created_at", ["teks lama,bukan tanggal", "#N/A N/A,2025-01-01", "lain,2024-01-01"])
    spec = lambda label, path, text, date: SourceSpec(label, f"file://{top}/{path}", text, date, fmt="csv", options={"multiLine": "false"})
    specs = [spec("x", "x.csv", "text", "date"), spec("youtube", "youtube", "Comment", "PublishedTime"),
             spec("gone", "gone.csv", "text", "date"), spec("instagram", "instagram.csv", "Comment", "Date"),
             spec("kaggle", "kaggle.csv", "full_text", "created_at")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = sort_corpus(merge_sources(spark, specs)).select("text", F.date_format("date", "yyyy-MM-dd").alias("d"), "source").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {r.text: (r.d, r.source) for r in rows}
    assert tuple(rows[0]) == ("teks lama", None, "kaggle")
    assert got["sama persis"] == ("2025-03-02", "x") and got["dua kali"] == ("2025-01-05", "x") and got["lain"] == ("2025-01-03", "instagram")
    assert all(got[f"isi {i}"] == ("2025-02-01", "youtube") for i in range(50))
    assert all(got[f"isi {i}"] == ("2025-01-01", "youtube") for i in range(50, 60))
    assert len(got) == len(rows) == 4 + 60


def test_keys_of_their_own_types(spark):
    path = scratch_path(spark, "keyed")
    rows = [("t", "b", 10, 1.5, "late"), ("t", "a", 9, 2.5, "second"), ("t", "a", 10, 0.5, "third"), ("t", "a", 9, -1.0, "first")]
    spark.createDataFrame(rows, "text string, s string, n int, r double, who string").repartition(3).write.parquet(path)
    for order, first in ((["s", "n", "r"], -1.0), (["n", "r"], -1.0), (["r"], -1.0), (["s", "n"], None)):
        spec = SourceSpec("k", path, "text", F.lit("2025-01-01"), order)
        key = merge_sources(spark, [spec]).first().row_key
        assert len(key) == len(order) and (first is None or key[-1].real == first)
    assert merge_sources(spark, [SourceSpec("k", path, "text", None, ["s"])]).first().row_key[0].str == "a"
