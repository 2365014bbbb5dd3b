"""Lines of a width, by stated results and by what must hold of any."""

from pagegrain.functions.wrapping import _wide, wrap

SIZE = 10.0


def test_words_fill_lines():
    assert wrap(["aa", " ", "bb", " ", "cc"], 28.0, SIZE) == ["aa bb", "cc"]
    assert wrap(["aa", " ", "bb"], 12.0, SIZE) == ["aa", "bb"]
    assert wrap(["aaaaa"], 12.0, SIZE) == ["aa", "aa", "a"]
    assert wrap([" "], 12.0, SIZE) == [" "]


def test_signs_at_line_ends():
    assert wrap(["数", "据", "，", "说"], 20.0, SIZE) == ["数据，", "说"]
    assert wrap(["数", "（", "据", "）"], 20.0, SIZE) == ["数", "（据）"]


def test_lines_of_documents(spark):
    from pyspark.sql import functions as F

    from pagegrain.plans import registry
    from pagegrain.sources.tables import table

    docs = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").where("text is not null").collect()}
    paragraphs = {}
    for r in registry.queries()["q_wrapped_lines"](spark, "/root/testdata/sf0.001").orderBy("doc_id", "paragraph", "line").collect():
        paragraphs.setdefault((r.doc_id, r.paragraph), []).append(r.text)
    for (doc, n), lines in paragraphs.items():
        assert "".join("".join(lines).split()) == "".join(docs[doc].split("\n")[n].split())
        assert all(_wide(line.rstrip(",.;:!?)]}、，。！？：；）】」』》〉%‰°"), 11.0) <= 240 + 11 for line in lines)
    assert len(paragraphs) == sum(bool(line.strip(" ")) for text in docs.values() for line in text.split("\n"))
