"""The data source of page ranges against the reader of whole files."""

from pathlib import Path

from marginalia.sources import pages, readers


class FormFeeds:
    """Files of text whose pages end at form feeds; notes what it reads."""

    def __init__(self, log):
        self.log = log

    def _texts(self, path):
        return Path(path).read_bytes().decode().split("\f")

    def count(self, path):
        return len(self._texts(path))

    def read(self, path, first, last):
        with open(self.log, "a") as f:
            f.write(f"{Path(path).name} {first} {last}\n")
        if "torn" in path and first > 0:
            raise ValueError("torn")
        return self._texts(path)[first:last]


def put(root, name, texts):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_bytes(texts if isinstance(texts, bytes) else "\f".join(texts).encode())


def test_against_the_reader_of_whole_files(spark, tmp_path):
    root = tmp_path / "in"
    put(root, "one/a.pdf", ["first page here", "", "12", "third page"])
    put(root, "b.pdf", [f"page {k}" for k in range(100)])
    put(root, "bad.pdf", b"\xff")
    put(root, "none.pdf", [""])
    put(root, "c.txt", ["no"])
    whole = readers.pages(spark, str(root), lambda b: b.decode().split("\f"))
    local = lambda df: sorted(((r["path"].removeprefix("file:"), r["page_no"], r["text"], (r["error"] or "")[:12]) for r in df.collect()), key=repr)
    for task_pages in (7, 1000):
        rows = pages.page_rows(spark, str(root), FormFeeds(str(tmp_path / "log")), task_pages=task_pages)
        assert local(pages.cleaned(rows)) == local(whole)
    (tmp_path / "empty").mkdir()
    assert pages.page_rows(spark, str(tmp_path / "empty"), FormFeeds("log")).count() == 0


def test_one_large_file_is_many_tasks(spark, tmp_path):
    put(tmp_path / "in", "large.pdf", [f"page number {k}" for k in range(10_000)])
    rows = pages.page_rows(spark, str(tmp_path / "in"), FormFeeds(str(tmp_path / "log")), task_pages=100)
    assert rows.rdd.getNumPartitions() == 100
    got = pages.cleaned(rows)
    assert got.count() == 10_000 and got.filter("text <> concat('page number ', page_no - 1)").isEmpty()


def test_a_file_that_fails_in_part_has_no_pages(spark, tmp_path):
    put(tmp_path / "in", "torn.pdf", ["one", "two", "three"])
    got = pages.cleaned(pages.page_rows(spark, str(tmp_path / "in"), FormFeeds(str(tmp_path / "log")), task_pages=1)).collect()
    assert [(r["page_no"], r["text"], r["error"]) for r in got] == [(None, None, "ValueError: torn")]


def test_a_second_run_reads_what_is_new(spark, tmp_path):
    root, log, out = tmp_path / "in", tmp_path / "log", str(tmp_path / "out")

    def run():
        stream = pages.page_rows(spark, str(root), FormFeeds(str(log)), task_pages=2, stream=True)
        stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination(120)
        return sorted((Path(r["path"]).name, r["place"], r["text"]) for r in spark.read.schema(pages.ROW).parquet(out).collect())

    put(root, "a.pdf", ["one", "two", "three"])
    assert run() == [("a.pdf", 0, "one"), ("a.pdf", 1, "two"), ("a.pdf", 2, "three")]
    before = log.read_text()
    assert len(run()) == 3 and log.read_text() == before
    put(root, "sub/b.pdf", ["four"])
    assert run()[-1] == ("b.pdf", 0, "four") and log.read_text().removeprefix(before) == "b.pdf 0 1\n"
