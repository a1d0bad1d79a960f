import bz2

import pytest

from conftest import rows
from weftlink.operators.kb import mention_dictionary
from weftlink.sources import sinks
from weftlink.sources.texts import labelled_mentions, labelled_tokens, read_documents, read_labelled
from weftlink.sources.vectors import read_vectors
from weftlink.sources.wiki import read_pages, read_redirects
from weftlink.streaming.incremental import stream_pages


def test_pages(spark, tmp_path):
    (tmp_path / "AA").mkdir()
    text = (
        '<doc id="12" url="u" title=" A &amp; B ">\nA & B\n\n First LINE \n\tsecond\n</doc>\n'
        '<doc id="13" url="u" title="List of x">\nList of x\nz\n</doc>\n<doc id="14" url="u" title="M (disambiguation)">\nM\nz\n</doc>\n'
    )
    (tmp_path / "AA" / "wiki_00.bz2").write_bytes(bz2.compress(text.encode()))
    (tmp_path / "AA" / "wiki_00.txt").write_text(text)
    assert rows(read_pages(spark, str(tmp_path))) == [(12, "A & B ", ["first line", "second"])]
    kept = rows(read_pages(spark, str(tmp_path), keep_disambiguation=True, lower=False))
    assert kept == [(12, "A & B ", ["First LINE", "second"]), (14, "M (disambiguation)", ["z"])]


def test_redirects(spark, tmp_path):
    page = '<page><title>{}</title><ns>0</ns>{}<revision><text>x</text></revision></page>\n'
    a = page.format("Old", '<redirect title=" New &amp; Co " />') + page.format("Plain", "")
    b = page.format("Other", '<redirect title="Foo" />')
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(a.encode()) + bz2.compress(b.encode()))
    assert rows(read_redirects(spark, str(tmp_path / "d.xml.bz2"))) == [("Old", "New & Co"), ("Other", "Foo")]


def test_vectors(spark, tmp_path):
    (tmp_path / "v.vec").write_text("2 3\nthe 1 2.5 -3 \nof 0 x 1\n\n")
    assert rows(read_vectors(spark, str(tmp_path / "v.vec"))) == [("of", [0.0, None, 1.0]), ("the", [1.0, 2.5, -3.0])]


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n[[y]]")
    assert rows(read_documents(spark, str(tmp_path)), "text") == [("x\n[[y]]",)]


LABELLED = """-DOCSTART- (1 EU)
EU\tB\tEU\tEuropean_Union\tu\t10
rejects
German\tB\tGerman call\tGermany\tu\t20
call\tI\tGerman call\tGermany\tu\t20
Peter\tB\tPeter\t--NME--
German\tB\tgerman call\tGermany\tu\t21

-DOCSTART- (2 X)
x
"""


def test_labelled(spark, tmp_path):
    (tmp_path / "c.tsv").write_text(LABELLED)
    docs, gold = read_labelled(spark, str(tmp_path / "c.tsv"))
    (doc,) = docs.collect()
    assert doc["tokens"] == ["eu", "rejects", "german", "call", "peter", "german"]
    assert sorted(tuple(m) for m in doc["mentions"]) == [("eu", 0, 1), ("german call", 2, 4), ("german call", 5, 6)]
    assert rows(gold) == [("1", "eu", 10), ("1", "german call", 21)]


def test_labelled_islands(spark):
    lines = [(1, 0, "a\tB\tA b\tA\tu\t1"), (1, 1, "b\tI\tA b\tA\tu\t1"), (1, 2, "c"), (1, 3, "d\tI\tD\tD\tu\t2"), (1, 4, "e\tB\tE\tE\tu\tx")]
    df = spark.createDataFrame(lines, "doc_id long, line_no int, line string")
    assert rows(labelled_mentions(labelled_tokens(df))) == [(1, "a b", 0, 2, 1), (1, "e", 4, 5, None)]


def test_sinks(spark, tmp_path):
    inc = spark.createDataFrame([("s", 1, 2)], "sf string, entity_id long, n long")
    root = str(tmp_path / "dict")
    for _ in range(5):
        sinks.upsert_mentions(inc, root)
    assert rows(sinks.latest(spark, root)) == [("s", 1, 10)]
    sinks.merge_version(inc, root, 4, mention_dictionary)  # a version written again replaces itself
    assert rows(sinks.latest(spark, root)) == [("s", 1, 10)]
    keyed = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    sinks.insert_unique(keyed((1, "a")), str(tmp_path / "t"), "k")
    for bad in (keyed((2, "a"), (2, "a")), keyed((1, "b")), keyed((1, "a")), keyed((None, "x"))):
        with pytest.raises(ValueError):
            sinks.insert_unique(bad, str(tmp_path / "t"), "k")
    sinks.insert_unique(keyed((2, "b")), str(tmp_path / "t"), "k")
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [(1, "a"), (2, "b")]
    scored = spark.createDataFrame([("s", 1, 2, 0.5, None, None, 2)], "sf string, entity_id long, n long, ctx_sim double, isa double, pa double, forms long")
    entity = spark.createDataFrame([(1, "One")], "entity_id long, name string")
    sinks.write_scores(scored, entity, str(tmp_path / "csv"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "csv"))) == [("s", "1: One", "2", "0.5", "0.0", "0.0")]
    sinks.write_nodes(scored, str(tmp_path / "nodes"))
    sinks.write_scalar(spark.createDataFrame([(7,)], "n long"), str(tmp_path / "n"))
    assert rows(spark.read.text(str(tmp_path / "n"))) == [("7",)]


def test_stream(spark, tmp_path):
    entity = spark.createDataFrame([(4, "Foo", "foo")], "entity_id long, name string, name_lower string")
    pages = str(tmp_path / "pages")
    for i in (0, 1, 0, 1, 1):  # pages are delivered again in later batches
        batch = spark.createDataFrame([(i, "t", ['<a href="Foo">f</a>'])], "page_id long, title string, lines array<string>")
        batch.write.mode("append").parquet(pages)
        stream_pages(spark, pages, entity, str(tmp_path / "kb")).awaitTermination(120)
    assert rows(sinks.latest(spark, str(tmp_path / "kb/mention"))) == [("f", 4, 2)]
    assert rows(sinks.latest(spark, str(tmp_path / "kb/link"))) == [(4, 0), (4, 1)]
