"""Archives of large pages are written with a dictionary too, and read back whole."""

from marketloom.llm import warc
from marketloom.session import scratch_path


def test_large_pages_have_a_dictionary(spark):
    body = "".join(f"<li class='entry'><a href='/item/{i}'>Entry number {i * i % 7919}</a></li>" for i in range(9_000))
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<html><p>page {i}</p>{body}</html>") for i in range(6)], "page_id long, url string, html string")
    records = warc.page_records(pages)
    assert records.where(f"payload_bytes <= {warc.SAMPLE_PAGE_BYTES}").count() == 0
    dictionary = warc.train_dictionary(records)
    assert len(dictionary) > 1000
    files = warc.write_archives(records, f"file://{scratch_path(spark, 'archives')}", dictionary)
    back = {r.page_id: r.payload_bytes for r in warc.read_archives(files).select("page_id", "payload_bytes").collect()}
    assert back == {i: len(f"<html><p>page {i}</p>{body}</html>") for i in range(6)}


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.train_dictionary(warc.page_records(none)) == b""
