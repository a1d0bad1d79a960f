import random
from collections import Counter

import numpy as np
import pytest

from conftest import rows
from weftlink.llm import byte_bpe, lookalikes, markup, spam_pages, term_counts
from weftlink.llm.distinctive import characteristic_pairs, term_scores

VOCABULARY = byte_bpe.DEFAULT_VOCABULARY


# --- markup -----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "line",
    [
        "<h2>Clock</h2>", "x <A HREF='y'>z</A>", "a<br/>b", "kept in an</span> hall", "a <!-- b -->", "is&#8211; a", "R&amp;D",
        "[[a|b]]s", "{{main|x}}", "}}", "a '''b''' c", "== H ==", "===H ====" if False else "=== H ===", "## H", "* item", "*item", "** x",
        "# one", "1. one", "> said", "{| class=x", "|-", "| 1 || 2", "! a !! b", "|---|---|", "----", "a `b` c", "[a](http://b)",
        "![a](/b.png)", "**b**", "a __b__ c", "~~a~~", "\\section{A}", "\\item a", "a {\\bf b} c", "a~\\cite{b}", "end.\\\\", "$x^2$",
        "$$E = m$$", "\\(n \\le m\\)", "a. \\ldots", "#REDIRECT [[x]]", "text.\\footnote{no}", "* a * b",
    ],
)
def test_markup_is_found(line):
    assert markup.has_construct(line)


@pytest.mark.parametrize(
    "line",
    [
        "It cost $40 in spring and $ 784 by autumn.", "from $14 to $503", "C:\\old\\organ", "I <3 this (x < y).", "12 * 8 * 390 units",
        "18 < 39 and 39 > 4", "A 7'' single", "Rock 'n' roll; 18:6 == 231?", '"They was [sic] gone by [840]"', "R&D work for A&B.",
        "may be meant*, it says", "either a | b", "guild_total_2 and guild_id", "C# minor, #3", "About ~21 km; 10^7", "{3, 4}", "— Not yet",
        "Smith & Sons", "", "   ",
    ],
)
def test_prose_is_not_markup(line):
    assert not markup.has_construct(line)


def test_clean_page_keeps_structure():
    lines = ["== A '''b''' ==", None, "* [[x|y]] <b>z</b>", "```python", "# no heading", "```", "| a || b", "Here $$x_1$$ and <math>y</math>.", "&lt;b&gt;"]
    got = markup.clean_page(lines)
    assert [g[3] for g in got] == ["## A b", None, "- y z", "```python", "# no heading", "```", "| a | b |", "Here $x_1$ and $y$.", "<b>"]
    assert [g[2] for g in got] == [True, False, True, True, False, True, True, True, True]


def test_residues_over_lines():
    clean = lambda *lines: [g[3] for g in markup.clean_page(list(lines))]
    assert clean("Ada was a {{a|{{b|{{c|{{d|{{e|{{f}}}}}}}}}}}}poet.") == ["Ada was a poet."]
    assert clean("{{Infobox person", "| name = Ada", "| spouse = {{marriage|W", "}}", "}}", "Ada was a poet.") == ["", "", "", "", "", "Ada was a poet."]
    assert clean("one {{x", "y}} two {{z}} three") == ["one", "two three"]
    assert clean("never {{closed|a", "| b", "text") == ["never a", "| b |", "text"]
    assert clean("{{quote|", "A line of prose.", "|by=X", "}}", "end") == ["", "A line of prose.", "", "", "end"]
    assert clean("open {{x", "prose", "with {{a}} own") == ["open", "prose", "with own"]
    assert clean("}} stray", "text") == ["stray", "text"]
    assert clean("so", "\\begin{equation}", "E = mc^2 \\\\", "\\end{equation}", "and \\emph{on}") == ["so", "$$", "E = mc^2 \\\\", "$$", "and on"]
    assert clean("\\emph{" * 9 + "deep" + "}" * 9) == ["deep"]
    assert clean("a <!-- b", "c", "d --> e") == ["a", "", "e"]
    assert clean("{{" * 3000 + "x" + "}}" * 3000 + "y") == ["y"]


def test_plain_lines_hold_no_construct():
    rng = random.Random(12)
    signs = list("<>&[]{}|*_`~$\\=#'-+:;!. 1a)") + ["''", "--", "a ", "\n"]
    for _ in range(20_000):
        line = "".join(rng.choice(signs) for _ in range(rng.randint(1, 7))).replace("\n", " ")
        if markup.plain(line) and line.strip():
            assert not any(p.search(line) for p in (*markup._LINE_STARTS, *markup._ANYWHERE)), line
            assert markup._block(line) == ("text", " ".join(line.split(" ")).strip() if "  " not in line else markup._block(line)[1]), line


def test_kept_text(spark):
    long = "This paragraph is long enough to be running text on its own, without any doubt."
    data = [(1, ["a", "", "", "", "'" * 3 + long + "'" * 3, None, "* item", "", "", "", "b"]), (2, ["x"]), (3, None), (1, None)]
    df = spark.createDataFrame(data, "page_id long, lines array<string>").selectExpr("*", "'t' AS text", "1 AS kept")
    assert rows(markup.kept_text(df)) == [(1, f"{long}\n- item")]
    assert markup.kept_text(df.limit(0)).count() == 0


def test_block_distribution():
    assert markup.block_distribution([0, 0, 90, 80, 0, 0, 0, 0]) == [True, True, True, True, False, False, False, False]
    assert markup.block_distribution([]) == []


def test_clean_lines(spark):
    data = [(1, ["<b>x</b>", None, "", "y" * 300_000]), (1, ["<b>x</b>", None, "", "y" * 300_000]), (2, []), (3, None), (None, ["<b>"])]
    df = spark.createDataFrame(data, "page_id long, lines array<string>").selectExpr("*", "'z' AS kind", "1 AS k")
    got = rows(markup.clean_lines(df), "page_id", "line_no", "markup")
    assert got == [(1, 0, True), (1, 1, False), (1, 2, False), (1, 3, False)]
    assert markup.clean_lines(df.limit(0)).count() == 0


# --- look-alikes ------------------------------------------------------------------------------------------------------
def test_lookalikes(spark):
    names = [("e", "1", "Duchy of Cú"), ("e", "2", "Duс\u200bhу\u2007οf\u00a0Cu\u0301"), ("e", "3", "duchy of Cú"), ("e", "4", "Duchy of Cu"),
             ("e", "5", "Ｄｕｃｈｙ of Cú"), ("f", "1", "Duchy of Cú"), ("e", "6", "\u200b"), ("e", "7", ""), ("e", "8", None), ("e", "1", "Duchy of Cú"),
             ("e", "9", "ＡВС"), ("e", "10", "ΑBC")]
    df = spark.createDataFrame(names, "kind string, key string, text string")
    assert rows(lookalikes.same_looking_pairs(df)) == [("e", "1", "2"), ("e", "1", "5"), ("e", "10", "9"), ("e", "2", "5")]
    forms = {k: f for kind, k, f in rows(lookalikes.consistent_forms(df)) if kind == "e"}
    assert forms["2"] == "Duchy of Cú" and forms["6"] == "" and forms["8"] is None
    assert lookalikes.same_looking_pairs(df.limit(0)).count() == 0


def test_lattice_depends_on_looks_only():
    search = lookalikes.Searcher({("a", "o"): 5})
    rng = random.Random(1)
    for _ in range(200):
        word = "".join(rng.choice("abcdeopxyzАВсе") for _ in range(8))
        twin = "".join(rng.choice(lookalikes.CLASS_OF.get(c, c)) for c in word)
        assert search.text(word) == search.text(twin)
        assert (lookalikes.skeleton(word) == lookalikes.skeleton(word[::-1])) == (search.text(word) == search.text(word[::-1]))


# --- term counts ------------------------------------------------------------------------------------------------------
def brute(records, max_n):
    f, docs = Counter(), {}
    for rec, seq, w in records:
        run = []
        for t in (seq or []) + [None]:
            if t is None:
                for i in range(len(run)):
                    for n in range(1, max_n + 1):
                        if i + n <= len(run):
                            g = tuple(run[i : i + n])
                            f[g] += w
                            docs.setdefault(g, set()).add(rec)
                run = []
            else:
                run.append(t)
    return {g: (len(g), f[g], len(docs[g])) for g in f}


@pytest.mark.parametrize("max_n", [1, 3])
def test_ngrams_match_brute_force(spark, max_n, monkeypatch):
    rng = random.Random(max_n)
    data = [(rng.randint(1, 12), [rng.choice(["a", "a", "a", "b", "c d", None]) for _ in range(rng.randint(0, 9))], 2) for _ in range(60)]
    data = [(r, s, w) for r, s, w in data] + [(5, None, 2), (6, [], 2)]
    df = spark.createDataFrame(data, "rec long, seq array<string>, w long")
    for chunk in (20_000, 3):
        monkeypatch.setattr(term_counts, "CHUNK_RECORDS", chunk)
        got = {tuple(t): (n, f, r) for t, n, f, r in rows(term_counts.ngram_counts(df, "rec", "seq", "w", max_n))}
        assert got == brute([d for d in data], max_n)
    assert term_counts.ngram_counts(df.limit(0), "rec", "seq", None, max_n).count() == 0


TOKENS = [(1, "a", 4), (1, "a", 4), (1, "b", None), (2, "a", 1), (3, "c", 5), (3, None, 2), (None, "z", 1), (4, "c", 1), (5, None, None)]


def test_word_table_and_scores(spark):
    df = spark.createDataFrame(TOKENS, "doc_id long, word string, f long").selectExpr("*", "1 AS records", "'x' AS mark", "2 AS terms")
    got = {w: (f, r, m) for w, f, r, m in rows(term_counts.word_table(df, common=0.3))}
    assert got == {"a": (5, 2, "common"), "b": (0, 1, "rare"), "c": (6, 2, "common")}
    scores = {(d, w): s for d, w, *_, s in rows(term_scores(df))}
    assert scores[1, "b"] is None and scores[1, "a"] > scores[2, "a"]
    assert rows(characteristic_pairs(df, 4, 2, 1)) == [(1, "a"), (3, "c")]
    assert term_scores(df.limit(0)).count() == term_counts.word_table(df.limit(0)).count() == 0


# --- spam pages -------------------------------------------------------------------------------------------------------
_rng = random.Random(9)
_NOUNS = "mill port quarry inn bay fort school clock mural organ guild loom atlas opera alloy treaty novel vessel estuary canal".split()
_VERBS = "rebuilt sold founded saved drew lost renamed described financed inherited".split()


def prose(sentences):
    n, v = lambda: _rng.choice(_NOUNS), lambda: _rng.choice(_VERBS)
    forms = (
        lambda: f"The first printer of the {n()} {v()} a {n()} in {_rng.randint(1200, 1990)} and brought {_rng.randint(10, 999)} sheep.",
        lambda: f"Visitors reach the {n()} by a footpath from the {n()}, which takes about {_rng.randint(2, 19)} hours.",
        lambda: f"When the {n()} closed, its {n()} was {v()} and its {n()} retired.",
        lambda: f"Local tradition holds that a weaver hid the {n()} under the {n()}.",
        lambda: f"Critics called the {n()} ornate, while others {v()} it; only {_rng.randint(2, 30)} are left.",
    )
    return " ".join(_rng.choice(forms)() for _ in range(sentences)) + " "


PROSE = prose(3)
SPAM = {
    "keywords": "vintage watch strap buy watch strap, vintage watch strap? watch strap sale " * 10,
    "links": "\n".join(f"* [rare medal](http://www.shop{i}.example/x-{i})" for i in range(30)),
    "mentions": " | ".join(f"[[Lake Number{i}]]" for i in range(60)),
    "tags": " ".join(f"#cheap_atlas{i}" for i in range(80)),
    "menu": "Home | About us | Contact | Login | Shop | Help\n" * 8,
    "products": "\n".join(f"Luxury Tea Set early X{i} SKU-{i}4531 6{i}.95 USD" for i in range(10, 40)),
    "towns": "\n".join(f"free opera tickets town{i}" for i in range(60)),
    "items": ", ".join(f"atlas{i}, late loom{i}" for i in range(60)),
}


@pytest.mark.parametrize("kind", SPAM)
def test_spam_is_flagged(kind):
    assert 1 - spam_pages.shares(SPAM[kind])[0] > 0.5
    mixed = prose(9) + "\n" + SPAM[kind][:120]
    assert 1 - spam_pages.shares(mixed)[0] < 0.5


def test_prose_is_not_flagged():
    openings = ["Later", "By then", "In 1741", "Nevertheless", "In 1833", "Later", "By then", "In 1690", "Nevertheless", "In 1905"]
    named = " ".join(f"{o} Lake Onega {v} the {_rng.choice(_NOUNS)} of the {n}, and {w}s {v2} it." for o, v, n, w, v2 in zip(
        openings, _VERBS, _NOUNS, _NOUNS[10:], _VERBS[::-1]))
    bullets = "\n".join(f"* {prose(1)}" for _ in range(8))
    chinese = "".join(f"{_rng.choice('古新小大旧')}的{_rng.choice('山城港桥街')}属于{_rng.choice('古新小大旧')}的{_rng.choice('山城港桥街')}，建于{_rng.randint(1200, 1990)}年。" for _ in range(20))
    links = PROSE + "I found this at https://a.example/b, but the sculptor disagrees with most of what it says. " + PROSE
    for text in (prose(12), named, bullets, links, PROSE + "\nExternal links\nhttp://a.example/x\n#tag #other", chinese):
        assert 1 - spam_pages.shares(text)[0] < 0.5, text


@pytest.mark.parametrize(("phrases", "times"), [(50, 20), (200, 20), (60, 100)])
def test_many_key_phrases_are_flagged_at_any_length(phrases, times):
    rng = random.Random(phrases)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    runs = [" ".join(word() for _ in range(3)) for _ in range(phrases)] * times
    rng.shuffle(runs)
    page = " ".join(runs)
    assert 1 - spam_pages.shares(page)[0] > 0.9
    assert 1 - spam_pages.shares(prose(len(page) // 80) + "\n" + page)[0] > 0.4
    assert 1 - spam_pages.shares(prose(len(page) // 70))[0] < 0.1


def test_lists_of_sentences_over_many_seeds(monkeypatch):
    texts = []
    for n in (6, 8, 10, 15, 20, 40):
        for seed in range(200):
            monkeypatch.setitem(globals(), "_rng", random.Random(1000 * seed + n))
            texts += ["\n".join(f"* {prose(1)}" for _ in range(n)), prose(n)]
    flagged = 1 - spam_pages.batch_shares(texts)[:, 0] > 0.5
    assert flagged.sum() < 0.01 * len(texts)


def test_batches_equal_single_pages():
    rng = random.Random(3)
    texts = [prose(rng.randint(1, 30)) for _ in range(40)] + list(SPAM.values()) + ["", " \n", "x", "\r\n\u2028a b", "😀 " * 50, "a " * 300_000]
    rng.shuffle(texts)
    together = spam_pages.batch_shares([None, *texts, None])
    assert np.allclose(together[1:-1], [spam_pages.shares(t) for t in texts]) and not together[0].any()


def test_decoding_against_every_path():
    from itertools import product

    model, rng = spam_pages.prior_model(), np.random.default_rng(2)
    pages = [rng.integers(0, len(spam_pages.SYMBOLS), n) for n in (1, 4, 2, 5, 3)]
    got = np.split(spam_pages.decode(np.concatenate(pages), np.array([len(p) for p in pages]), model), np.cumsum([len(p) for p in pages])[:-1])

    def score(path, page):
        steps = [np.log(model.move[a, b]) for a, b in zip(path, path[1:])]
        return np.log(model.start[path[0]]) + sum(steps) + sum(np.log(model.emit[s, o]) for s, o in zip(path, page))

    for page, states in zip(pages, got, strict=True):
        best = max(score(p, page) for p in product(range(len(spam_pages.STATES)), repeat=len(page)))
        assert score(states, page) == pytest.approx(best)


def test_fit_raises_the_likelihood(monkeypatch):
    monkeypatch.setattr(spam_pages, "PRIOR_WEIGHT", 1.0)
    pages = [np.array([0] * 9 + [7]), np.array([1, 1, 2, 1]), np.array([6] * 12), np.array([], dtype=int)] * 5

    def likelihood(m):
        total = 0.0
        for page in pages:
            f = m.start
            for k, s in enumerate(page):
                f = (f if k == 0 else f @ m.move) * m.emit[:, s]
            total += np.log(f.sum())
        return total

    values = [likelihood(spam_pages.fit(pages, rounds)) for rounds in (0, 1, 3, 8)]
    assert values == sorted(values)
    fitted = spam_pages.fit(pages)
    for table in (fitted.start, fitted.move, fitted.emit):
        assert np.allclose(table.sum(-1), 1)


def test_the_model_is_fitted_on_every_page(spark):
    texts = [prose(i % 7 + 1) for i in range(60)] + list(SPAM.values()) * 3 + ["\n".join(f"* see http://a.example/{i}" for i in range(700))]
    pages = [spam_pages.Pieces([t]).symbols for t in texts]
    assert max(map(len, pages)) == 700
    want, got = spam_pages.fit(pages), spam_pages.fit_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.allclose(want.emit, got.emit) and np.allclose(want.move, got.move) and np.allclose(want.start, got.start)


def test_spam_query(spark):
    data = [(1, PROSE), (2, SPAM["tags"]), (2, SPAM["tags"]), (3, None), (4, ""), (5, " \n "), (6, prose(6000))]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS t", "3 AS prose")
    assert rows(spam_pages.spam_pages(df)) == [(2,), (2,)]
    assert spam_pages.fit_model(df.limit(0)).emit.tolist() == spam_pages.EMISSION.tolist()
    assert spam_pages.page_shares(df).count() == 7 and spam_pages.spam_pages(df.limit(0)).count() == 0


# --- byte-pair encoding -----------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as f:
        return byte_bpe.Encoder(f.read())


def test_ids_equal_the_public_tokenizer(encoder):
    import base64

    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    public = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["", " ", "it's", "<|endoftext|> x", "a" * 3000, "é京👍🏽" * 40, "x" * 96, "x" * 97, "\n\n  \t a", "ab" * 500 + " " * 300]
    texts += ["".join(rng.choice("abcdeéß京 \n'0129_-") for _ in range(rng.randint(1, 300))) for _ in range(150)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(80, 250))) for _ in range(100)]
    for text, ids in zip(texts, encoder.encode_batch(texts), strict=True):
        assert list(ids) == public.encode_ordinary(text)
        assert public.decode(list(ids)) == text


def test_pair_table_has_every_pair(encoder):
    a = np.array([encoder.ranks[b"t"], -1, encoder.ranks[b"\x00"]])
    b = np.array([encoder.ranks[b"h"], 5, encoder.ranks[b"\x01"]])
    assert encoder.table.look_up(a, b).tolist() == [encoder.ranks[b"th"], byte_bpe._NONE, byte_bpe._NONE]


def test_encode_table(spark):
    data = [(1, "hello world", "s"), (2, "", "s"), (3, None, None), (1, "hello world", "s")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    got = rows(byte_bpe.encode_texts(df))
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    counted = byte_bpe.encode_texts(df, keep=("ids",), count=True)
    assert rows(counted) == [(1, "s", 2), (1, "s", 2), (2, "s", 0), (3, None, 0)]
    assert byte_bpe.encode_texts(df.limit(0)).count() == 0
