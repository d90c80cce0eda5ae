"""Every entry that is long enough is answerable, however many there are."""

from lodestrata import catalog

SF = "/root/testdata/sf0.01"


def test_answerable_has_no_row_cap(spark):
    want = sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len((r["text"] or "").strip()) >= 10)
    assert len(want) > 300
    assert sorted(r["doc_seq"] for r in catalog.queries()["answerable"](spark, SF).collect()) == want
