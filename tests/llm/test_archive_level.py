from pathlib import Path

from runloom.llm import archives


def test_archives_are_written_at_the_quick_level_and_read_back_whole(spark, tmp_path, monkeypatch):
    html = lambda i: "".join(f"<p>{(i * j * 7919) % 1013} words of {j % 17}</p>" for j in range(400))
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", html(i)) for i in range(40)], "page_id bigint, url string, html string").coalesce(1)
    size = {}
    for level in (archives.LEVEL, "BEST_COMPRESSION"):
        monkeypatch.setattr(archives, "LEVEL", level)
        path = str(tmp_path / level)
        archives.to_arc(pages, path)
        size[level] = sum(f.stat().st_size for f in Path(path).glob("*.gz"))
        got = archives.read_arc(spark, path).select("page_id", "payload").collect()
        assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == [(i, html(i)) for i in range(40)]
    assert size["THREE"] > size["BEST_COMPRESSION"]
