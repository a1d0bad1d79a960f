import numpy as np
import pytest

from conftest import rows
from weftlink.llm import mixing
from weftlink.llm import name_variants as N
from weftlink.llm.vector_search import IndexParams, VectorIndex, k_means, nearest, restored, shortened, two_level

# --- mixing -----------------------------------------------------------------------------------------------------------


def test_subset_is_exact():
    rng = np.random.default_rng(1)
    for seed in range(20):
        lengths = np.unique(rng.integers(1, 900, 80))
        counts = rng.integers(0, 50, len(lengths))
        target = int((lengths * counts).sum() * rng.random())
        take = mixing.nearest_subset(lengths, counts, target, seed)
        assert (take <= counts).all() and (take >= 0).all()
        assert abs(int((take * lengths).sum()) - target) <= 1


def test_subset_brute_force_when_no_sum_fits():
    lengths, counts = np.array([7, 10, 0]), np.array([2, 1, 5])
    sums = {7 * a + 10 * b for a in range(3) for b in range(2)}
    for target in range(30):
        take = mixing.nearest_subset(lengths, counts, target)
        got = int((take * lengths).sum())
        assert got in sums and abs(got - target) == min(abs(s - target) for s in sums), target
    assert mixing.nearest_subset(lengths, counts, 0).sum() == 0
    assert mixing.nearest_subset(np.array([], dtype=int), np.array([], dtype=int), 5).sum() == 0


def test_long_documents():
    take = lambda n, count, target: int(mixing.nearest_subset(np.array([n]), np.array([count]), target)[0])
    assert [take(100_000, 10, t) for t in (290_000, 99_000, 49_000, 50_000, 950_001)] == [3, 1, 0, 0, 10]
    assert [take(60_000, 10, t) for t in (290_000, 99_000)] == [5, 2]


def test_subset_brute_force_over_all_lengths():
    rng = np.random.default_rng(9)
    for seed in range(60):
        lengths = np.unique((10 ** rng.uniform(0, 6, 5)).astype(int))
        counts = rng.integers(0, 3, len(lengths))
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + k * int(n) for s in sums for k in range(c + 1)}
        target = int(rng.integers(0, max(sums) + 10))
        got = int((mixing.nearest_subset(lengths, counts, target, seed) * lengths).sum())
        assert got in sums and abs(got - target) == min(abs(s - target) for s in sums)


def test_large_targets_come_near():
    rng = np.random.default_rng(4)
    lengths = np.unique((10 ** rng.uniform(0, 5, 300)).astype(int))
    counts = rng.integers(1, 10**6, len(lengths))
    total = int((lengths * counts).sum())
    for share in (0.001, 0.37, 0.999):
        take = mixing.nearest_subset(lengths, counts, int(total * share), 1)
        assert (take <= counts).all() and int((take * lengths).sum()) == int(total * share)


def test_mixture(spark):
    docs = [(i, "big", 10) for i in range(100)] + [(1000 + i, "small", 7) for i in range(10)] + [(5000, "big", 0), (6000, None, 3), (7000, "other", 5), (7001, "none", 4)]
    counted = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("absent", 0.1, 2), ("none", 0.1, None)], "source string, weight double, max_repeat int")
    mix = rows(mixing.mixture(counted, targets))
    used = {}
    for _, source, n, copies in mix:
        used[source] = used.get(source, 0) + n * copies
    total = 1000 + 70 + 4
    assert used == {"big": round(0.5 * total / 10) * 10, "small": 210}
    assert all(c == 3 for _, s, _, c in mix if s == "small") and mix == rows(mixing.mixture(counted.repartition(7), targets))
    report = {r[0]: r[1:] for r in rows(mixing.share_report(counted, targets), "source", "budget", "tokens", "most_repeats")}
    assert report["small"] == (round(0.3 * total), 210, 3) and report["absent"] == (round(0.1 * total), 0, 0) and report["none"][1] == 0
    assert mixing.mixture(counted.limit(0), targets).count() == 0
    assert mixing.mixture(counted, targets.limit(0)).count() == 0


def test_one_length_for_all(spark):
    counted = spark.range(3000).selectExpr("id AS doc_id", "'s' AS source", "5L AS n_tokens")
    targets = spark.createDataFrame([("s", 0.3, 1)], "source string, weight double, max_repeat int")
    assert mixing.mixture(counted, targets).count() == 900


# --- vectors ----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 64)) * rng.uniform(0.01, 50, (600, 1))
    near = base[:60] * 3 + 0.05 * np.linalg.norm(base[:60], axis=1, keepdims=True) / 8 * rng.normal(size=(60, 64))
    return np.concatenate([base, near, base[:5], base[:1]])


def brute_pairs(keys, x, cosine):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(u @ u.T >= cosine)
    return sorted((keys[i], keys[j]) for i, j in zip(a, b, strict=True) if keys[i] < keys[j])


def test_pairs_match_brute_force(spark, vectors):
    keys = [f"k{i}" for i in range(len(vectors))]
    data = [(k, v.tolist()) for k, v in zip(keys, vectors, strict=True)]
    data += [("zero", [0.0] * 64), ("short", [1.0] * 63), ("none", None), (None, [1.0] * 64), ("nan", [float("nan")] * 64), data[3]]
    df = spark.createDataFrame(data, "key string, vec array<double>").selectExpr("*", "1 AS cell", "2 AS unit")
    for params in (IndexParams(), IndexParams(list_block=5, query_block=7, probes=6)):  # long lists are split
        index = VectorIndex(df, params)
        assert rows(index.similar_keys(0.95)) == brute_pairs(keys, vectors, 0.95)
    one = VectorIndex(df, IndexParams(probes=1))  # exact without help from the probes
    assert rows(one.similar_keys(0.8, exact=True)) == brute_pairs(keys, vectors, 0.8)
    assert index.members.count() == len(keys)


def test_neighbours_recall(spark, vectors):
    keys = [f"k{i:04d}" for i in range(600)]
    x = vectors[:600] + 2 * vectors[:600].mean(0)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x, strict=True)], "key string, vec array<double>")
    got = {}
    for k, o, _, _ in rows(VectorIndex(df).neighbours(df.where("key < 'k0100'"), 5)):
        got.setdefault(k, set()).add(o)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(100):
        s = u @ u[i]
        s[i] = -9
        hits += len(got[keys[i]] & {keys[j] for j in np.argsort(-s)[:5]})
    assert len(got) == 100 and hits / 500 >= 0.9


def test_shortened_rows_are_within_their_bound():
    x = np.random.default_rng(3).normal(size=(200, 64)).astype(np.float32)
    x = np.concatenate([x, np.eye(64, dtype=np.float32), x[:5] * 1e-20])
    got, left = restored(shortened(x), 64)
    assert (np.linalg.norm(x - got, axis=1) <= left).all() and (left < 0.05 * np.linalg.norm(x, axis=1) + 1e-5).all()


def test_two_level_centres():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 8)).astype(np.float32)
    centres = two_level(x, 600, 4, 1)
    assert abs(len(centres) - 600) < 60 and np.isfinite(centres).all()
    flat = k_means(x, 600, 4, 1)
    error = lambda c: float(((x - c[nearest(x, c)[:, 0]]) ** 2).sum())
    assert error(centres) < 1.15 * error(flat)


def test_empty_index(spark):
    index = VectorIndex(spark.createDataFrame([("a", None)], "key string, vec array<double>"))
    assert index.similar_keys(0.9).count() == 0
    assert index.neighbours(spark.createDataFrame([("a",)], "key string"), 3).count() == 0


# --- names ------------------------------------------------------------------------------------------------------------
ENTITIES = [
    (1, "Leonard V. Lirvelancu"), (2, "Elizabeth Pancagerde"), (3, "Furnomanne Department of Public Archives"), (4, "Tartedirca University of Applied Optics"),
    (5, "Robert Kenniminyu"), (6, "Pancagerde Street"), (7, "Lirzufinxi Institute of Decorative Arts"), (8, "Girzípunsu International Railway"),
    (9, "Adam Manhadarfa"), (10, "Adam Manhadarfa"), (11, None), (None, "Walter Kersuderba"), (12, "Walter Kersuderba"),
]
VARIANTS = {
    "leo. lirvelancu obe": None, "lirvelancu, leonard": 1, "l. lirvelancu": 1, "len lirvelancu": 1, "leonard lirvelancu": 1, "leonrad lirvelancu": 1,
    "capt. elizabeth pancagerde": 2, "elizabeth panca-gerde": 2, "beth pancagerde": 2, "pancagerde, e.": 2, "elizabeth p4ncagerde": 2,
    "the furnomanne dept. of public archives": 3, "tartedirca uao": 4, "univ. of applied optics tartedirca": 4, "bob kenniminyu": 5, "r. kenniminyu": 5,
    "lirzufinxi inst. of decorative arts": 7, "lorzufinxi institute of decorative arts": 7, "girzipunsu intl. railway": 8, "adma manhadarfa": 9,
    "wаlter kersuderba": 12, "walter kersuderba md": 12,
    # other persons and things
    "george lirvelancu": None, "g. lirvelancu": None, "pancagerde": None, "pancagerde mural": None, "furnomanne tapestry": None, "leonard banpifirli": None,
    "leonard k. lirvelancu": None, "tartedirca mda": None, "": None, "  ": None, "...": None,
}
ALIASES = [("leonard", "len"), ("elizabeth", "beth"), ("robert", "bob"), (None, "x"), ("walter", None)]


def test_variants(spark):
    typed = spark.createDataFrame([(v,) for v in VARIANTS] + [(None,), ("l. lirvelancu",)], "name string").selectExpr("name", "1 AS id")
    entities = spark.createDataFrame(ENTITIES + ENTITIES[:2], "entity_id long, name string").selectExpr("*", "2 AS tokens")
    aliases = spark.createDataFrame(ALIASES, "given_name string, alias string")
    got = dict(rows(N.link_variants(typed, entities, aliases), "name", "entity_id"))
    want = {k: v for k, v in VARIANTS.items() if v} | {"leo. lirvelancu obe": 1}
    assert {k: v for k, v in got.items() if k != "leo. lirvelancu obe"} | {"leo. lirvelancu obe": 1} == want
    assert N.link_variants(typed.limit(0), entities, aliases).count() == 0
    assert N.link_variants(typed, entities.limit(0), aliases).count() == 0


UNLISTED = {
    "giovanni verdi": ["giovani verdi", "g. verdi", "verdi, giovanni", "giovanni vredi"], "Mei Lin Zhang": ["mei lin zhagn", "zhang mei lin", "zhang, mei lin"],
    "Olga Petrova": ["olga pertova", "o. petrova", "petrova olga"], "Ahmed Hassan": ["ahmed hasan", "hassan, ahmed"], "Amartya Sen": ["amartya sen phd", "a. sen", "amrtya sen"],
    "Rossi, Bruno": ["bruno rosi", "b. rossi"], "Toyota Motor": ["toyta motor", "toyota motors", "toyota mot."], "Deutsche Bahn": ["deutche bahn", "deutsche bhan"],
    "Jonathan Lee": ["j. lee", "jon lee"], "Li Wu": ["wu li", "wu, li"], "Margaret Feniparku": ["maggei feniparku", "maggie feniparku"],
    "Robert Smyth": ["bob smith", "r. smyth"], "Giovanni Verdelucci": ["giovanni verdeluci"], "Kaiser & Sons": ["kaisr & sons"],
}


def test_names_on_no_list(spark):
    names = list(UNLISTED) + ["Verdi Street", "Petrova (film)", "Lake Hassan", "Verdi", "Hans Petrov", "Smithers"]
    entities = spark.createDataFrame(list(enumerate(names)), "entity_id long, name string")
    aliases = spark.createDataFrame([("margaret", "maggie"), ("robert", "bob"), ("jonathan", "jon")], "given_name string, alias string")
    typed = {v: k for k, vs in UNLISTED.items() for v in vs}
    others = ["carla verdi", "verdi tunnel", "toyota", "wu", "ali hassan", "deutsche bank", "x. petrova"]
    df = spark.createDataFrame([(t,) for t in [*typed, *others]], "name string")
    got = {n: names[e] for n, e in rows(N.link_variants(df, entities, aliases), "name", "entity_id")}
    assert not {t: k for t, k in typed.items() if got.get(t) != k}
    assert not set(others) & set(got)


def test_blocks_lose_no_spelling_with_one_error():
    """Any single error in a word of any length leaves a block key intact."""
    from random import Random

    rng, letters = Random(6), "abcdefghij"

    def keys(w, typed):
        out = set()
        if len(w) <= N.MIN_SUFFIX:
            out.add("=" + w)
        if N.MIN_SUFFIX - typed < len(w) <= N.SHORT_WORD + typed:
            out |= {"~" + w} | {"~" + w[:i] + w[i + 1 :] for i in range(len(w))}
        sizes = range(len(w) - N.EDITS, len(w) + N.EDITS + 1) if typed else [len(w)]
        for h in {min(N.MAX_SUFFIX, max(N.MIN_SUFFIX, (n - 1) // 2)) for n in sizes if n > N.SHORT_WORD}:
            out |= {"<" + w[:h], ">" + w[-h:]}
        return out

    for _ in range(4000):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(4, 20)))
        i, kind = rng.randrange(len(w)), rng.randrange(4)
        v = {0: w[:i] + w[i + 1 :], 1: w[:i] + "z" + w[i:], 2: w[:i] + "z" + w[i + 1 :], 3: w[:i] + w[i : i + 2][::-1] + w[i + 2 :]}[kind]
        if N.alike(v, w):
            assert keys(v, True) & keys(w, False), (v, w)


def test_distances_against_tables():
    from random import Random

    def osa(a, b):
        d = {(i, j): max(i, j) if not min(i, j) else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = Random(5)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 11))) for _ in "ab")
        assert N.edits(a, b) == osa(a, b), (a, b)


def test_common_suffixes_are_refined_not_lost(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 3)
    names = [(i, f"{g} {c}onburgo") for i, (g, c) in enumerate((g, c) for g in ("Adam", "Brian", "Clara", "Diana", "Edgar") for c in "bcdfgklmpr")]
    entities = spark.createDataFrame(names, "entity_id long, name string")
    typed = spark.createDataFrame([("adam bonburgo",), ("burgo adam",), ("edgar ronbrugo",), ("d. konburgo",)], "name string")
    got = dict(rows(N.link_variants(typed, entities, spark.createDataFrame([], "given_name string, alias string")), "name", "entity_id"))
    find = {n.lower(): i for i, n in names}
    assert got["adam bonburgo"] == find["adam bonburgo"] and got["edgar ronbrugo"] == find["edgar ronburgo"] and got["d. konburgo"] == find["diana konburgo"]


def test_crowded_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 3)
    given = "Robert Anthony Jonathan Joan Joel Joseph Joshua John Ronald Roger Andrew Andrea".split()
    names = [(i, f"{g} {c}onburgo") for i, (g, c) in enumerate((g, c) for g in given for c in "bdkz")]
    entities = spark.createDataFrame(names, "entity_id long, name string")
    aliases = spark.createDataFrame([("robert", "bob"), ("anthony", "tony"), ("robert", "rob")], "given_name string, alias string")
    find = {n.lower(): i for i, n in names}
    want = {"bob bonburgo": "robert bonburgo", "tony donburgo": "anthony donburgo", "jhon zonburgo": "john zonburgo", "kobnurgo, jonathan": "jonathan konburgo"}
    typed = spark.createDataFrame([(t,) for t in want] + [("j. bonbrugo",)], "name string")
    got = dict(rows(N.link_variants(typed, entities, aliases), "name", "entity_id"))
    assert {t: got.get(t) for t in want} == {t: find[n] for t, n in want.items()}
    assert got["j. bonbrugo"] in {find[f"{g.lower()} bonburgo"] for g in given if g[0] == "J"}


def test_spellings_near_each_other_all_meet(spark):
    """Every two spellings that the comparison takes for one word meet, wherever their errors are."""
    from random import Random

    rng = Random(7)
    words, typed = [], []
    for _ in range(400):
        w = "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(4, 17)))
        v = list(w)
        for _ in range(rng.randint(0, 3)):
            i, kind = rng.randrange(len(v)), rng.randrange(3)
            v[i : i + 1] = [rng.choice("aeiou")] if kind == 0 else [] if kind == 1 and len(v) > 2 else [v[i], rng.choice("xyz")]
        words.append(w)
        typed.append("".join(v))
    df = lambda x: spark.createDataFrame([(w, False) for w in sorted(set(x))], "part string, one boolean")
    near = {(w, p) for w, p in rows(N.near_parts(df(typed), df(words)), "w", "p")}
    want = {(w, p) for w in typed for p in words if N.alike(w, p)}
    assert len(want) > 200 and not want - near


def test_errors_in_both_halves_of_a_name(spark):
    entities = spark.createDataFrame([(1, "Bursepenja Mutual Insurance Company"), (2, "Gorzitursi International Railway")], "entity_id long, name string")
    typed = spark.createDataFrame([("burcepenji mutual insurance company",), ("goryiturmi international railway",)], "name string")
    got = rows(N.link_variants(typed, entities, spark.createDataFrame([], "given_name string, alias string")), "name", "entity_id")
    assert got == [("burcepenji mutual insurance company", 1), ("goryiturmi international railway", 2)]


def test_pairs_grow_with_the_table(spark, monkeypatch):
    from random import Random

    rng, pairs, inner = Random(8), [], N.candidate_pairs
    monkeypatch.setattr(N, "candidate_pairs", lambda *a: pairs.append(inner(*a)) or pairs[-1])
    tails = sorted({"".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(320)})
    for n in (75, 300):
        names = [f"Adam Konbu{t}" for t in rng.sample(tails, n)]
        entities = spark.createDataFrame(list(enumerate(names)), "entity_id long, name string")
        typed = spark.createDataFrame([(x.lower(),) for x in names], "name string")
        assert N.link_variants(typed, entities, spark.createDataFrame([], "given_name string, alias string")).count() == n
    few, many = (x.count() for x in pairs)
    assert many < 10 * few and many < 0.2 * 300 * 300


def test_exploded_tables_are_not_broadcast(spark):
    """However small Spark takes them to be: a few spellings become very many keys."""
    names = [f"Adam Konbu{a}{b}" for a in ("ta", "ri", "mo") for b in ("lek", "nus", "vid")]
    parts = spark.createDataFrame([(n[5:].lower(), False) for n in names], "part string, one boolean")
    near = N.near_parts(parts, parts)
    entities, typed = spark.createDataFrame(list(enumerate(names)), "entity_id long, name string"), spark.createDataFrame([(n.lower(),) for n in names], "name string")
    linked = N.link_variants(typed, entities, spark.createDataFrame([], "given_name string, alias string"))
    for df, joins in ((near, 1), (linked, 4)):
        assert len(df.collect()) >= len(names)
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert final.count("SortMergeJoin") == joins and "BroadcastHashJoin" not in final


HIDDEN = {
    "Nokialto": ["nokailto", "nokia-lto"], "Ivan Hill": ["i. hill", "hill, ivan", "ivna hill"], "Park Jisungo": ["park jisnugo", "jisungo park"],
    "Olga Petrelova (footballer)": ["olga petrelvoa", "o. petrelova", "petrelova, olga", "olga petrelova footballer"], "Applegate (company)": ["aplegate", "applegate co."],
    "West Publishing Company": ["west publ. company", "west publishing co."], "New Gorvatta University": ["new gorvata university", "new gorvatta univ."],
    "University of South Bermalina": ["univ. of south bermalina", "university of south bermlaina"], "State Bank of Tirvolgo": ["state bk. of tirvolgo", "state bank of tirvogo"],
    "Red River Petrolanto": ["red river petrolatno"], "Western Digitalo": ["western digtalo"], "Robert Lumbaro (painter)": ["r. lumbaro", "robert lumbraro"],
}


def test_persons_and_organisations_beside_words_of_places(spark):
    places = ["Battle of Gunzedo", "Lake Gunzedo", "Gunzedo County", "Gunzedo (film)", "Gunzedo railway station", "Gunzedo, Northern Province", "Upper Gunzedo Valley"]
    names = [*HIDDEN, *places]
    entities = spark.createDataFrame(list(enumerate(names)), "entity_id long, name string")
    typed = {v: k for k, vs in HIDDEN.items() for v in vs}
    others = ["gunzeod county", "lake gunzdo", "battle of gunzdeo", "gunzedo flim", "gunzedo", "p. hill", "applegate mural", "olga", "g. nokialto"]
    df = spark.createDataFrame([(t,) for t in [*typed, *others]], "name string")
    got = {n: names[e] for n, e in rows(N.link_variants(df, entities, spark.createDataFrame([], "given_name string, alias string")), "name", "entity_id")}
    assert not {t: (k, got.get(t)) for t, k in typed.items() if got.get(t) != k}
    assert not set(others) & set(got)


def test_ratio_against_brute_force():
    from functools import lru_cache

    import random

    def lcs(a, b):
        @lru_cache(None)
        def f(i, j):
            return 0 if i == len(a) or j == len(b) else f(i + 1, j + 1) + 1 if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

        return f(0, 0)

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(4, 9))) for _ in "ab")
        expected = 2 * lcs(a, b) / (len(a) + len(b))
        assert N.lcs_ratio(a, b) in (pytest.approx(expected), 0.0)
        if expected >= N.RATIO:
            assert N.lcs_ratio(a, b) == pytest.approx(expected)
