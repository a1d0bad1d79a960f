import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from weftlink.config import Params
from weftlink.functions import hygiene
from weftlink.operators.kb import KnowledgeBase
from weftlink.operators.pages import document_frequencies
from weftlink.plans import pipeline

DIM = 300


@pytest.fixture(scope="module")
def built(spark):
    """Pages about a river and a player called Jordan, with vectors of 300 numbers."""
    rng = np.random.default_rng(1)
    common, river, ball = 3 * rng.normal(size=DIM), rng.normal(size=DIM), rng.normal(size=DIM)
    kinds = {"river": river, "desert": river, "valley": river, "ball": ball, "team": ball, "game": ball}
    vec = [(w, (common + v + 0.1 * rng.normal(size=DIM)).tolist()) for w, v in kinds.items()] + [("short", [1.0]), (None, [0.0] * DIM)]
    pages = [
        (1, "Jordan", ["The <b>river</b> in the desert valley", '<a href="Amman">Amman</a>', None, ""]),
        (2, "Michael Jordan", ["ball team ball", '<a href="Chicago%20Bulls">bulls</a>']),
        (3, "Amman", ['valley desert <a href="Jordan">Jordan</a>']),
        (4, "Chicago Bulls", ['game team <a href="Michael Jordan">jordan</a> <a href="Nowhere">x</a>']),
        (5, "Jordan (disambiguation)", ['<a href="Jordan">a</a>', '<a href="Michael Jordan">b</a>']),
        (6, "Guide", ['<a href="Jordan">jordan</a>', '<a href="Amman">amman</a>']),
        (7, "Sport", ['<a href="Michael Jordan">mj</a>', '<a href="Chicago Bulls">bulls</a>']),
        (1, "Jordan", ["The <b>river</b> in the desert valley", '<a href="Amman">Amman</a>', None, ""]),
        (8, None, ["game"]), (None, "n", ["x"]), (9, "Empty", None),
    ]
    pages += [(i, f"Page {i}", [""]) for i in range(20, 60)]
    df = spark.createDataFrame(pages, "page_id long, title string, lines array<string>").selectExpr("*", "1 AS entity_id", "2 AS f")
    redirects = spark.createDataFrame([("The Bulls", "Chicago Bulls"), ("x", "Nowhere")], "title string, target string")
    return pipeline.build_knowledge_base(df, spark.createDataFrame(vec, "word string, vec array<double>"), redirects)


def test_tables(built):
    assert built.dim == DIM
    mention = {(s, e): n for s, e, n in rows(built.mention)}
    assert mention["jordan", 1] == 4 and mention["jordan", 2] == 2 and mention["the bulls", 4] == 1 and ("x", 4) not in mention
    assert (1, 5) not in rows(built.link) and {(1, 3), (3, 1), (2, 4), (4, 2), (4, 7)} <= set(rows(built.link))
    assert ("1", "river", 1) in {(str(d), w, f) for d, w, f in rows(built.doc_token)} and 5 not in {d for d, *_ in rows(built.doc_token)}
    assert {d for d, _ in rows(built.doc_embedding)} == {1, 2, 3, 4, 8}
    assert all(len(v) == DIM for _, v in rows(built.doc_embedding))


def test_stored_and_reopened(spark, built, tmp_path):
    again = built.save(str(tmp_path / "kb"))
    for name in ("entity", "mention", "link", "word_freq", "pages"):
        assert rows(getattr(again, name)) == rows(getattr(built, name))
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("The [[Jordan]] river near [[Amman]] in the desert valley")
    for kb in (built, KnowledgeBase.load(spark, str(tmp_path / "kb"))):
        found = pipeline.disambiguate_file(spark, str(tmp_path / "docs"), kb, str(tmp_path / "out"))
        assert rows(found, "sf", "entity_id", "name") == [("amman", 3, "Amman"), ("jordan", 1, "Jordan")]
    assert spark.read.option("header", True).csv(str(tmp_path / "out/scores")).count() == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "out/nodes")).count() == 3


def test_evaluation_of_a_corpus(spark, built, tmp_path):
    lines = ["-DOCSTART- (1 A)", "Jordan\tB\tJordan\tJordan\tu\t1", "river", "desert", "Amman\tB\tAmman\tAmman\tu\t3", "valley",
             "-DOCSTART- (2 B)", "Zork\tB\tZork\tZork\tu\t77", "game", "-DOCSTART- (3 C)", "bulls\tB\tbulls\tX\tu\t9", "ball"]
    (tmp_path / "c.tsv").write_text("\n".join(lines) + "\n")
    assert rows(pipeline.evaluate_file(spark, str(tmp_path / "c.tsv"), built)) == [(2, 3, 2, 0)]


def test_wrong_and_empty_vectors(spark, built):
    with pytest.raises(ValueError, match="64"):
        KnowledgeBase(*built._raw, Params(dim=64)).word_vec
    empty = pipeline.build_knowledge_base(
        spark.createDataFrame([], "page_id long, title string, lines array<string>"), spark.createDataFrame([], "word string, vec array<double>")
    )
    assert empty.entity.count() == empty.mention.count() == empty.link.count() == empty.word_freq.count() == empty.doc_embedding.count() == 0
    docs = spark.createDataFrame([(1, "[[Jordan]]")], "doc_id long, text string")
    assert pipeline.disambiguate(docs, empty).count() == 0


def test_document_frequencies(spark):
    pages = [(1, "A", ["It's <i>UP</i>. x", "x"]), (2, "B (disambiguation)", ["x"]), (3, "C", None), (4, "D", ["", None])]
    df = spark.createDataFrame(pages, "page_id long, title string, lines array<string>").withColumn("text", F.lit(1))
    assert rows(document_frequencies(df)) == [(1, "'s", 1), (1, ".", 1), (1, "it", 1), (1, "up", 1), (1, "x", 2)]
    assert document_frequencies(df.limit(0)).count() == 0


def test_shared_folder_is_not_local_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class getConf:  # noqa: N801
            def get(self, *_):
                return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        hygiene.shared_dir(Session())
    Session.sparkContext.master = "local[4]"
    assert hygiene.shared_dir(Session()).startswith("file://")
