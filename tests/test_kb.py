from pyspark.sql import functions as F

from conftest import rows
from weftlink.functions.text import link_target, stripped_of_tags
from weftlink.operators import kb as K
from weftlink.operators import links as L
from weftlink.operators.hot_keys import hot_keys, skew_distinct_count, skew_join, skew_sum
from weftlink.operators.sif import embed
from weftlink.plans import queries


def test_hot_keys_and_skew(spark):
    data = [("a", i % 7, 1) for i in range(900)] + [(f"k{i}", i, None) for i in range(99)] + [(None, 1, 5)]
    df = spark.createDataFrame(data, "key string, member long, rows long").withColumn("hot_key", F.lit(1))
    assert rows(hot_keys(df, "key", 0.5)) == [("a", 900)]
    counts = dict(rows(skew_distinct_count(df, "key", "member", "n")))
    assert counts["a"] == 7 and len(counts) == 100 and counts["k5"] == 1
    sums = {(k, m): n for k, m, n in rows(skew_sum(df, "key", "member", "rows", "n"))}
    assert sums["a", 0] == 129 and sums["k3", 3] == 0
    per = df.where("key is not null").groupBy("key").agg(F.count("*").alias("c"))
    assert skew_join(df, per, "key").where("key = 'a' and c = 900").count() == 900
    empty = df.limit(0)
    assert hot_keys(empty, "key", 0.5).count() == skew_sum(empty, "key", "member", "rows", "n").count() == 0
    nulls = spark.createDataFrame([("x", None), ("x", None)], "key string, member long")
    assert rows(skew_distinct_count(nulls, "key", "member", "n")) == [("x", 0)]


def test_dictionary_is_mergeable(spark):
    a = spark.createDataFrame([("s", 1, 2), ("s", 1, 3), (None, 1, 9), ("t", None, 1), ("z", 1, 0)], "sf string, entity_id long, n long")
    b = spark.createDataFrame([("s", 1, 1), ("u", 2, 4)], "sf string, entity_id long, n long")
    both = rows(K.mention_dictionary(a, b))
    assert both == [("s", 1, 6), ("u", 2, 4)] == rows(K.mention_dictionary(K.mention_dictionary(a), K.mention_dictionary(b)))


def test_links_merge_and_self_links(spark):
    a = spark.createDataFrame([(1, 2), (1, 2), (1, 1), (1, None)], "to_id long, from_id long")
    assert rows(K.inlink_counts(K.link_set(a, a))) == [(1, 2)]


def test_hot_targets_keep_their_inlinks(spark, tmp_path):
    data = [(1, i) for i in range(10_000)] + [(1, 5), (1, None), (None, 3)] + [(2 + i % 90, i) for i in range(180)]
    links = spark.createDataFrame(data, "to_id long, from_id long")
    links.write.parquet(f"{tmp_path}/link.parquet")
    whole = {(t, f) for t, f in data if t is not None and f is not None}
    got = rows(queries.inlink_pieces(spark, str(tmp_path)), "to_id", "piece", "from_ids")
    pairs = [(t, int(f)) for t, _, ids in got for f in ids.split(",")]
    assert len(pairs) == len(whole) and set(pairs) == whole
    assert len({(t, p) for t, p, _ in got}) == len(got) and sum(t == 1 for t, *_ in got) == -(-10_000 // 256)
    assert len(rows(queries.inlink_arrays(spark, str(tmp_path)), "to_id")) == 3 + 90
    small = K.inlink_pieces(K.link_set(links), 100)
    assert small.select(F.max(F.size("from_ids"))).first()[0] == 100
    assert K.inlink_pieces(K.link_set(links.limit(0))).count() == 0


def _entities(spark):
    names = [(1, "ALGOL"), (2, "Algol"), (3, "B & W"), (4, "Foo"), (5, "Mercury")]
    return K.entity_table(spark.createDataFrame(names, "entity_id long, name string"))


def test_resolution_by_case(spark):
    t = spark.createDataFrame([("ALGOL",), ("Algol",), ("algol",), ("FOO",), ("bar",), (None,)], "target string")
    assert rows(K.resolve(t, _entities(spark))) == [("ALGOL", 1), ("Algol", 2), ("FOO", 4)]


def test_page_links(spark):
    lines = [
        '<a href="Foo">foo</a> and <a href="http://x">ext</a>',  # the first link is swallowed
        'see <A HREF="B%20%26amp%3B%20W"> At&amp;t </A> and <a class="x" href="List of rivers">r</a>',
        None,
        "",
        'x <a href="Foo+Bar">q</a> <a href="foo">' + "y" * 129 + "</a>",
    ]
    pages = [(9, "P", lines), (9, "P", lines), (8, "Mercury (disambiguation)", ['<a href="Foo">f</a>']), (7, None, None), (None, "n", ["<a"])]
    df = spark.createDataFrame(pages, "page_id long, title string, lines array<string>")
    got = L.wiki_links(df, _entities(spark))
    assert rows(got, "page_id", "sf", "entity_id") == [(8, "mercury", 4), (9, "at&amp;t", 3)]
    assert rows(L.edges_of_links(got)) == [(3, 9)]


def test_decoding(spark):
    df = spark.createDataFrame([(1, "B%20%26amp%3B%20W"), (2, "a+b 100%"), (3, None), (4, " <b>x</b> &amp; <!-- no -->y 3 < 4 ")], "i int, s string")
    got = {i: (a, b) for i, a, b in rows(df.select("i", link_target(df.s), stripped_of_tags(df.s)))}
    assert got[1][0] == "B & W" and got[2][0] == "a+b 100%" and got[3] == (None, None)
    assert got[4][1] == "x & y 3 < 4"


def test_redirects(spark):
    r = spark.createDataFrame([("Old Foo", "Foo"), ("x", "Template:Foo"), ("y", None)], "title string, target string")
    assert rows(L.mentions_of_redirects(r, _entities(spark))) == [("old foo", 4, 1)]


def test_embedding(spark):
    words = spark.createDataFrame([("a", 0.5, [1.0, 0.0]), ("b", 1.0, [0.0, 2.0])], "word string, weight double, vec array<double>")
    toks = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (1, "zz", 9), (2, "zz", 1), (3, "a", 0)], "doc_id long, word string, f long")
    assert rows(embed(toks, ["doc_id"], words, 2)) == [(1, [0.25, 1.0])]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c"), (None, "d")], "k long, v string")
    assert rows(K.duplicate_keys(df, "k", "v")) == [(1, 2)]
