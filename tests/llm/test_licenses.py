"""Licence scans on tables that are not plain scans, and with licences of one's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsight.llm.licenses import NOTICES, TEXTS, canonical, license_scan


def table(spark):
    rows = [(i, t.upper() if i % 2 else t) for i, t in enumerate(TEXTS.values())]
    rows += [(100 + i, f"Some words {i}.\n{lines[0]}\nMore words.") for i, lines in enumerate(NOTICES.values())]
    rows += [(200 + i, f"nothing of this kind {i}") for i in range(300)]
    rows += [(900, None), (901, ""), (None, TEXTS["MIT"]), (902, "x " * 100_000 + "\n" + NOTICES["MIT"][0]), (903, "\n".join(x[0] for x in NOTICES.values())), (0, rows[0][1])]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, whole int")


def rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.license or "", r.notices) for r in df.collect())


def test_the_same_licences_after_any_shuffle(spark):
    docs = table(spark)
    want = rows(license_scan(docs))
    assert [w[1] for w in want if 0 < w[0] < 100] == list(TEXTS)[1:]
    assert want.count((0, "MIT", "")) == 2 and (-1, "MIT", "") in want
    assert [w[2] for w in want if 100 <= w[0] < 200] == list(NOTICES)
    assert (902, "", "MIT") in want and (903, "", ",".join(sorted(NOTICES))) in want
    assert rows(license_scan(docs.repartition(8))) == want
    assert rows(license_scan(docs.repartition(5, "text").sortWithinPartitions("text"))) == want
    joined = docs.join(docs.select("doc_id").distinct(), "doc_id", "left")
    assert rows(license_scan(joined)) == want
    assert rows(license_scan(docs.distinct())) == sorted(set(want))
    assert license_scan(docs.where("doc_id < 0")).collect() == []


def test_known_licences_of_ones_own(spark):
    texts = [("House", "You may do as you please."), ("B-House", "you may do as you PLEASE"), ("Line", "Free for all")]
    known = spark.createDataFrame(texts, "license string, t string").select("license", F.md5(canonical(F.col("t"))).alias("digest"))
    docs = spark.createDataFrame([(1, "You may -- do as you please!"), (2, "a\nfree, for all\nb"), (3, TEXTS["MIT"])], "doc_id long, text string")
    assert rows(license_scan(docs, known)) == [(1, "B-House", "B-House"), (2, "", "Line"), (3, "", "")]
