from voxlake.operators import dashboard as d
from voxlake.sources.metadata import latest_metadata, load_raw_metadata, scan_raw_files

from conftest import rows

RESULT = "verbatim_id string, theme string, summary string, sentiment string, texte_original string, source string, macro_theme string"


def results(spark):
    return spark.createDataFrame([
        ("a", "t", "s one", "positif", "text a", "web", "M"),
        ("b", "t", "s two", "négatif", "", "inconnue", "N"),
        ("c", "u", "s Three", "neutre", None, None, None),
        ("d", "u", "s four", "positif", "text d", "", "M"),
    ], RESULT)


def raw(spark):
    return spark.createDataFrame([
        ("f1", 0, "b", "old b", "s1"), ("f2", 0, "b", "first b", "s2"), ("f2", 1, "b", "last b", "s3"),
        ("f1", 1, "a", "other a", "s1"),
    ], "file string, row bigint, id string, text string, source string")


def test_backfill(spark):
    want = [
        ("a", "text a", "web"), ("b", "last b", "s3"),
        ("c", "(Texte original introuvable)", "inconnue"), ("d", "text d", ""),
    ]
    pick = ["verbatim_id", "texte_original", "source"]
    assert rows(d.backfill(results(spark), raw(spark)).select(pick)) == want
    # with a large table and hot ids
    assert rows(d.backfill(results(spark), raw(spark), hot_rows=1, broadcast_rows=0).select(pick)) == want
    bare = results(spark).drop("texte_original", "source")
    assert ("b", "last b", "s3") in rows(d.backfill(bare, raw(spark)).select(pick))


def test_filters(spark):
    r = results(spark)
    assert d.member_filter(r, source=[], sentiment=[]).count() == 4
    assert rows(d.explore(r, sources=["web", ""], sentiments=["positif"]).select("verbatim_id")) == [("a",), ("d",)]
    assert d.explore(r).columns == [
        "verbatim_id", "source", "texte_original", "macro_theme", "theme", "sentiment", "summary"]
    assert d.ordered_columns(r.drop("macro_theme")).columns == [
        "verbatim_id", "source", "texte_original", "theme", "summary", "sentiment"]
    assert rows(d.text_search(r, "THREE").select("verbatim_id")) == [("c",)]
    assert rows(d.text_search(r, "text").select("verbatim_id")) == [("a",), ("d",)]
    assert d.text_search(r, "").count() == 4
    assert rows(d.distinct_values(r, "macro_theme")) == [(None,), ("M",), ("N",)]


def test_kpis(spark):
    r = results(spark)
    assert tuple(d.kpis(r).first()) == (4, 2, 1, 1, 50.0, 25.0, 25.0)
    assert tuple(d.kpis(r, ["nowhere"]).first()) == (0, 0, 0, 0, None, None, None)
    assert rows(d.sentiment_split(r, ["web"])) == [("neutre", 0), ("négatif", 0), ("positif", 1)]
    assert rows(d.theme_sentiment_counts(r)) == [("M", "positif", 2), ("N", "négatif", 1)]
    assert d.preview(r, 2).count() == 2


def write(folder, name, text):
    with open(f"{folder}/{name}", "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_raw_metadata_scan(spark, folder):
    write(folder, "bank_a.csv", 'id,text,source\n1," padded ",web\n2,"two\nlines",\n1,again,app\n')
    write(folder, "shop_b.csv", "review,other\nr0,x\nNA,y\nr2,z\n")
    write(folder, "zoo.csv", "id,comment,source\n1,latest,NULL\n")
    write(folder, "skip.csv", "Text,avis\nx,y\n")
    write(folder, "empty.csv", "")
    with open(f"{folder}/broken.csv", "wb") as f:
        f.write(b"id,text\n\xff")
    write(folder, "note.txt", "id,text\n9,no\n")
    got = {r["id"]: (r["text"], r["source"]) for r in load_raw_metadata(spark, folder).collect()}
    got = {k: v for k, v in got.items() if not k.startswith("�")}
    assert {k: got[k] for k in ("1", "2", "shop_0", "shop_1", "shop_2")} == {
        "1": ("latest", "nan"), "2": ("two\nlines", "nan"),
        "shop_0": ("r0", "shop"), "shop_1": ("nan", "shop"), "shop_2": ("r2", "shop"),
    }
    rows_ = scan_raw_files(spark, folder).where("id = '1'").orderBy("file", "row").collect()
    assert [(r["row"], r["text"]) for r in rows_] == [(0, " padded "), (2, "again"), (0, "latest")]
    assert load_raw_metadata(spark, folder + "/none").count() == 0


def test_row_numbers_of_a_file_cut_into_splits(spark, folder):
    write(folder, "big.csv", "text\n" + "".join(f"row {i}\n" for i in range(5000)))
    write(folder, "wee.csv", "text\n" + "".join(f"row {i}\n" for i in range(50)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        scanned = scan_raw_files(spark, folder, multiline=False)
        got = sorted((r["id"], r["text"]) for r in latest_metadata(scanned).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted([(f"big_{i}", f"row {i}") for i in range(5000)] + [(f"wee_{i}", f"row {i}") for i in range(50)])
