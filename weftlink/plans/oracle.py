"""The same results in SQL, for the queries that SQL can express."""

from __future__ import annotations

import re

#: Rounds of the propagation with a fixed number, and most rounds to convergence.
ROUNDS, MOST_ROUNDS = 8, 90
#: Rounds of the power method for the common component.
POWER = 60
#: Schemes of links to other sites; fixed values.
_PROTOCOLS = (
    "bitcoin|ftp|ftps|geo|git|gopher|http|https|irc|ircs|magnet|mailto|mms|news|nntp|redis|sftp|sip|sips|sms|ssh|svn|tel|telnet|urn|"
    "worldwind|xmpp"
)
_EXTERNAL = rf"""<a.*?href=[''"](({_PROTOCOLS})(?:%3a|:)|//).*?>\s*(.*?)\s*</a>"""
_LINK = r"""(?i)<a.*?href="\s*(.+?)\s*".*?>\s*(.*?)\s*</a>"""
_SKIP = "regexp_matches({0}, '(?i)^(?:lists?\\s+of|wikipedia:|template:|category:|file:)')"
_DISAMBIGUATION = "regexp_matches({0}, '(?i)^(.+)\\s+\\(disambiguation\\)$')"
_URL = f"(?i)(?:{_PROTOCOLS})(?:%3a|:)/"

#: Common table expressions by name, with the names each one needs.
_CTE: dict[str, tuple[list[str], str]] = {
    "ent": ([], """SELECT entity_id, min(name) AS name, lower(min(name)) AS name_lower FROM entity
      WHERE entity_id IS NOT NULL AND name IS NOT NULL GROUP BY entity_id"""),
    "dict": ([], """SELECT sf, entity_id, CAST(sum(n) AS BIGINT) AS n FROM mention_count
      WHERE sf IS NOT NULL AND entity_id IS NOT NULL AND n IS NOT NULL GROUP BY sf, entity_id HAVING sum(n) > 0"""),
    "edges": ([], "SELECT DISTINCT to_id, from_id FROM link WHERE to_id IS NOT NULL AND from_id IS NOT NULL"),
    "inl": (["edges"], "SELECT to_id, count(*) AS inlinks FROM edges GROUP BY to_id"),
    "tok": ([], """SELECT doc_id, word, CAST(coalesce(max(f), 0) AS BIGINT) AS f FROM doc_token
      WHERE doc_id IS NOT NULL AND word IS NOT NULL GROUP BY doc_id, word"""),
    "wv": ([], "SELECT word, min(vec) AS vec FROM word_embedding WHERE word IS NOT NULL AND len(vec) = 64 GROUP BY word"),
    "wf": (["tok", "wv"], "SELECT word, CAST(sum(f) AS BIGINT) AS f FROM tok WHERE word IN (SELECT word FROM wv) GROUP BY word"),
    "tot": (["wf"], "SELECT coalesce(sum(f), 0) AS total FROM wf"),
    "ww": (["wv", "wf", "tot"], """SELECT wv.word, 0.001 / (0.001 + coalesce(coalesce(wf.f, 0) / CAST(tot.total AS DOUBLE), 0)) AS weight,
      wv.vec FROM wv LEFT JOIN wf ON wv.word = wf.word, tot"""),
    "wx": (["ww"], "SELECT word, weight, d AS dim, vec[d + 1] AS x FROM ww, range(64) r(d)"),
    "raw": (["tok", "wx"], """SELECT doc_id, dim, sum(f * weight * x) / sum(f) AS x FROM tok JOIN wx ON tok.word = wx.word
      GROUP BY doc_id, dim HAVING sum(f) > 0"""),
    "sto": ([], "SELECT doc_id, min(vec) AS vec FROM doc_embedding WHERE doc_id IS NOT NULL AND len(vec) = 64 GROUP BY doc_id"),
    "allx": (["sto", "raw"], """SELECT doc_id, d AS dim, vec[d + 1] AS x FROM sto, range(64) r(d)
      UNION ALL SELECT doc_id, dim, x FROM raw WHERE doc_id NOT IN (SELECT doc_id FROM sto)"""),
    "de": (["allx"], "SELECT doc_id, dim, x FROM allx WHERE doc_id IN (SELECT doc_id FROM allx WHERE x <> 0)"),
    "once": ([], """SELECT page_id, min(title) AS title, any_value(lines) AS lines FROM wiki_page
      WHERE page_id IS NOT NULL AND lines IS NOT NULL GROUP BY page_id"""),
    "line": (["once"], """SELECT page_id, title, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no FROM once"""),
    "lnk0": (["line"], f"""SELECT page_id, title, regexp_replace(line, '{_EXTERNAL}', '\\3', 'gi') AS line FROM line
      WHERE contains(lower(line), '<a')"""),
    "lnk": (["lnk0"], f"""SELECT page_id, title, unnest(regexp_extract_all(line, '{_LINK}', 1)) AS href,
      unnest(regexp_extract_all(line, '{_LINK}', 2)) AS anchor FROM lnk0"""),
    "tgt": (["lnk"], f"""SELECT page_id, {_DISAMBIGUATION.format("coalesce(title, '')")} AS from_disambiguation,
      CASE WHEN {_DISAMBIGUATION.format("coalesce(title, '')")} THEN lower(trim(regexp_extract(title, '(?i)^(.+)\\s+\\(disambiguation\\)$', 1)))
      ELSE lower(anchor) END AS sf, trim(replace(url_decode(href), '&amp;', '&')) AS target FROM lnk"""),
    "ek": (["ent"], "SELECT name_lower, count(*) AS k, min(entity_id) AS only_id FROM ent GROUP BY name_lower"),
    "wl": (["tgt", "ent", "ek"], f"""SELECT t.page_id, t.sf, CASE WHEN ek.k = 1 THEN ek.only_id ELSE e.entity_id END AS entity_id,
      t.from_disambiguation FROM tgt t JOIN ek ON lower(t.target) = ek.name_lower LEFT JOIN ent e ON e.name = t.target
      WHERE length(t.sf) <= 128 AND NOT {_SKIP.format("t.target")} AND NOT {_DISAMBIGUATION.format("t.target")}
      AND (ek.k = 1 OR e.entity_id IS NOT NULL)"""),
    "pt": (["line"], r"""SELECT page_id, line_no, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(line, '<!--.*?(?:-->|$)|</?[a-zA-Z][^<>]*>|<[!?][^<>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&ndash;', '–'), '&#8211;', '–'), '&#x2014;', '—'), '&eacute;', 'é'), '&quot;', '"'),
      '&nbsp;', chr(160)), '&amp;', '&'), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') AS text FROM line WHERE line IS NOT NULL"""),
    "doc": ([], r"""SELECT doc_id, lower(text) AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
      AND NOT contains(regexp_replace(lower(text), '(?s)\[\[.*?\]\]', chr(1), 'g'), '[[')"""),
    "seg": (["doc"], r"""SELECT doc_id, 2 * i AS seg, NULL AS sf, parts[i + 1] AS piece FROM
        (SELECT doc_id, string_split_regex(t, '(?s)\[\[.*?\]\]') AS parts FROM doc), range(100000) r(i) WHERE i < len(parts)
      UNION ALL SELECT doc_id, 2 * i + 1, marks[i + 1], marks[i + 1] FROM
        (SELECT doc_id, regexp_extract_all(t, '(?s)\[\[(.*?)\]\]', 1) AS marks FROM doc), range(100000) r(i) WHERE i < len(marks)"""),
    "segt": (["seg"], r"""SELECT doc_id, seg, sf, list_filter(string_split_regex(piece, '[\s\x{a0}\x{2000}-\x{200a}\x{3000}\x{202f}\x{205f}\x{2028}\x{2029}\x{85}\x{1680}]+'),
      lambda w: w <> '' AND length(w) <= 128) AS toks FROM seg"""),
    "off": (["segt"], """SELECT doc_id, seg, sf, toks, coalesce(sum(len(toks)) OVER (PARTITION BY doc_id ORDER BY seg
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM segt"""),
    "occ": (["off"], """SELECT doc_id, sf, CAST(start AS INTEGER) AS "start", CAST(start + len(toks) AS INTEGER) AS "end" FROM off WHERE sf IS NOT NULL"""),
    "alltok": (["off"], """SELECT doc_id, start + generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS word FROM off"""),
    "ctx": (["occ", "alltok"], """SELECT DISTINCT o.doc_id, o.sf, a.word FROM occ o JOIN alltok a ON o.doc_id = a.doc_id
      AND a.pos >= o."start" - 50 AND a.pos < o."end" + 50"""),
    "cv": (["ctx", "wx"], "SELECT doc_id, sf, dim, sum(weight * x) / count(*) AS x FROM ctx JOIN wx ON ctx.word = wx.word GROUP BY doc_id, sf, dim"),
    "kept": (["dict"], "SELECT sf, entity_id, n FROM (SELECT *, count(*) OVER (PARTITION BY sf) AS k FROM dict) WHERE k <= 50 OR n > 4"),
    "pri": (["kept", "ent", "edges", "de"], """SELECT sf, entity_id, n, n / CAST(sum(n) OVER (PARTITION BY sf) AS DOUBLE) AS prior FROM kept
      WHERE entity_id IN (SELECT entity_id FROM ent) AND entity_id IN (SELECT to_id FROM edges) AND entity_id IN (SELECT doc_id FROM de)"""),
    "cand": (["occ", "pri"], "SELECT o.doc_id, p.* FROM (SELECT DISTINCT doc_id, sf FROM occ) o JOIN pri p ON o.sf = p.sf"),
    "sim": (["cand", "cv", "de"], """SELECT c.doc_id, c.sf, c.entity_id, any_value(c.n) AS n, any_value(c.prior) AS prior,
      (1 + coalesce(sum(v.x * d.x) / nullif(sqrt(sum(v.x * v.x)) * sqrt(sum(d.x * d.x)), 0), 0)) / 2 AS ctx_sim
      FROM cand c JOIN cv v ON c.doc_id = v.doc_id AND c.sf = v.sf JOIN de d ON c.entity_id = d.doc_id AND v.dim = d.dim
      GROUP BY c.doc_id, c.sf, c.entity_id"""),
    "top": (["sim"], "SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY doc_id, sf ORDER BY ctx_sim DESC, entity_id) <= 120"),
    "node": (["top"], """SELECT doc_id, sf, entity_id, 0.4 * prior + 0.6 * ctx_sim AS raw,
      (0.4 * prior + 0.6 * ctx_sim) / sum(0.4 * prior + 0.6 * ctx_sim) OVER (PARTITION BY doc_id) AS isa FROM top"""),
    "pair": (["node"], """SELECT a.doc_id, a.sf AS sf_a, a.entity_id AS a, b.sf AS sf_b, b.entity_id AS b FROM node a JOIN node b
      ON a.doc_id = b.doc_id AND a.sf < b.sf"""),
    "up": (["pair"], "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM pair"),
    "sh": (["up", "edges"], """SELECT u.a, u.b, count(*) AS s FROM up u JOIN edges x ON x.to_id = u.a JOIN edges y ON y.to_id = u.b
      AND y.from_id = x.from_id GROUP BY u.a, u.b"""),
    "tr": (["sh", "inl", "ent"], """SELECT * FROM (SELECT s.a, s.b, CASE WHEN ln(w.wp) - ln(least(p.inlinks, q.inlinks)) > 0 THEN
      1 - (ln(greatest(p.inlinks, q.inlinks)) - ln(s.s)) / (ln(w.wp) - ln(least(p.inlinks, q.inlinks))) END AS tr
      FROM sh s JOIN inl p ON p.to_id = s.a JOIN inl q ON q.to_id = s.b, (SELECT count(*) AS wp FROM ent) w) WHERE tr IS NOT NULL"""),
    "half": (["pair", "tr"], """SELECT p.*, t.tr FROM pair p JOIN tr t ON t.a = least(p.a, p.b) AND t.b = greatest(p.a, p.b) WHERE t.tr > 0"""),
    "mat": (["half"], """SELECT doc_id, src_sf, src, dst_sf, dst, tr / sum(tr) OVER (PARTITION BY doc_id, src_sf, src) AS w FROM
      (SELECT doc_id, sf_a AS src_sf, a AS src, sf_b AS dst_sf, b AS dst, tr FROM half UNION ALL
       SELECT doc_id, sf_b, b, sf_a, a, tr FROM half)"""),
    "s0": (["node"], "SELECT doc_id, sf, entity_id, isa, isa AS s FROM node"),
}
for _i in range(1, MOST_ROUNDS + 1):
    _CTE[f"s{_i}"] = (
        [f"s{_i - 1}", "mat"],
        f"""SELECT doc_id, sf, entity_id, isa, u / sum(u) OVER (PARTITION BY doc_id) AS s FROM (SELECT n.doc_id, n.sf, n.entity_id,
      n.isa, 0.4 * n.isa + 0.6 * coalesce(f.inflow, 0) AS u FROM s{_i - 1} n LEFT JOIN (SELECT m.doc_id, m.dst_sf, m.dst,
      sum(m.w * p.s) AS inflow FROM mat m JOIN s{_i - 1} p ON m.doc_id = p.doc_id AND m.src_sf = p.sf AND m.src = p.entity_id
      GROUP BY m.doc_id, m.dst_sf, m.dst) f ON n.doc_id = f.doc_id AND n.sf = f.dst_sf AND n.entity_id = f.dst)""",
    )
_LAST = f"s{ROUNDS}"
_CTE |= {
    "rr1": ([_LAST], f"""SELECT doc_id, sf, entity_id, isa / sum(isa) OVER w AS i, pa / sum(pa) OVER w AS q FROM
      (SELECT doc_id, sf, entity_id, round(isa, 9) AS isa, round(s, 9) AS pa FROM {_LAST}) WINDOW w AS (PARTITION BY doc_id, sf)"""),
    "rr2": (["rr1"], """SELECT doc_id, sf, entity_id, (i + q) / sum(i + q) OVER w AS rs, (i * q) / sum(i * q) OVER w AS rm FROM rr1
      WINDOW w AS (PARTITION BY doc_id, sf)"""),
    "rr3": (["rr2"], """SELECT *, row_number() OVER (PARTITION BY doc_id, sf ORDER BY rs DESC, entity_id) AS ps,
      row_number() OVER (PARTITION BY doc_id, sf ORDER BY rm DESC, entity_id) AS pm FROM rr2"""),
    "rr4": (["rr3"], """SELECT doc_id, sf, max(CASE WHEN ps = 1 THEN entity_id END) AS es, max(CASE WHEN pm = 1 THEN entity_id END) AS em,
      max(CASE WHEN ps = 1 THEN rs END) - coalesce(max(CASE WHEN ps = 2 THEN rs END), 0) AS gs,
      max(CASE WHEN pm = 1 THEN rm END) - coalesce(max(CASE WHEN pm = 2 THEN rm END), 0) AS gm FROM rr3 GROUP BY doc_id, sf"""),
    "lp": (["edges", "ent"], """SELECT DISTINCT least(to_id, from_id) AS a, greatest(to_id, from_id) AS b FROM edges
      WHERE to_id <> from_id AND from_id IN (SELECT entity_id FROM ent)"""),
    "lsh": (["lp", "edges"], """SELECT u.a, u.b, count(*) AS s FROM lp u JOIN edges x ON x.to_id = u.a JOIN edges y ON y.to_id = u.b
      AND y.from_id = x.from_id GROUP BY u.a, u.b"""),
    "ltr": (["lsh", "inl", "ent"], _CTE["tr"][1].replace("FROM sh s", "FROM lsh s")),
    "lmat": (["ltr"], """SELECT src, dst, tr / sum(tr) OVER (PARTITION BY src) AS w FROM
      (SELECT a AS src, b AS dst, tr FROM ltr WHERE tr > 0 UNION ALL SELECT b, a, tr FROM ltr WHERE tr > 0)"""),
    "l0": (["inl", "edges"], "SELECT to_id AS entity_id, inlinks / CAST((SELECT count(*) FROM edges) AS DOUBLE) AS isa, inlinks / CAST((SELECT count(*) FROM edges) AS DOUBLE) AS s FROM inl"),
    **{
        f"l{i}": ([f"l{i - 1}", "lmat"], f"""SELECT entity_id, isa, u / sum(u) OVER () AS s FROM (SELECT n.entity_id, n.isa,
      0.4 * n.isa + 0.6 * coalesce(f.inflow, 0) AS u FROM l{i - 1} n LEFT JOIN (SELECT m.dst, sum(m.w * p.s) AS inflow FROM lmat m
      JOIN l{i - 1} p ON m.src = p.entity_id GROUP BY m.dst) f ON n.entity_id = f.dst)""")
        for i in range(1, ROUNDS + 1)
    },
    "gold": (["wl"], "SELECT page_id AS doc_id, sf, max(entity_id) AS entity_id FROM wl WHERE NOT from_disambiguation GROUP BY page_id, sf"),
    "named": (["occ", "ek"], "SELECT DISTINCT o.doc_id, o.sf, ek.only_id AS entity_id FROM occ o JOIN ek ON o.sf = ek.name_lower WHERE ek.k = 1"),
    # the common component of a document, by the power method
    "mx": (["cand", "cv", "de"], """SELECT c.doc_id, 'e' || c.entity_id AS r, d.dim, d.x FROM (SELECT DISTINCT doc_id, entity_id FROM cand SEMI JOIN cv USING (doc_id, sf)) c
      JOIN de d ON d.doc_id = c.entity_id UNION ALL SELECT v.doc_id, 'c' || v.sf, v.dim, v.x FROM cv v SEMI JOIN cand USING (doc_id, sf)"""),
    "gram": (["mx"], "SELECT a.doc_id, a.dim AS i, b.dim AS j, sum(a.x * b.x) AS g FROM mx a JOIN mx b ON a.doc_id = b.doc_id AND a.r = b.r GROUP BY ALL"),
    "pw0": (["gram"], "SELECT DISTINCT doc_id, i, 1.0 + i / 64.0 AS v FROM gram"),
    **{
        f"pw{i}": (
            ["gram", f"pw{i - 1}"],
            f"""SELECT doc_id, i, u / sqrt(sum(u * u) OVER (PARTITION BY doc_id)) AS v FROM (SELECT g.doc_id, g.i, sum(g.g * p.v) AS u FROM gram g
      JOIN pw{i - 1} p ON g.doc_id = p.doc_id AND g.j = p.i GROUP BY g.doc_id, g.i)""",
        )
        for i in range(1, POWER + 1)
    },
    "cd": ([f"pw{POWER}", "cv"], f"SELECT c.doc_id, c.sf, sum(c.x * p.v) AS along FROM cv c JOIN pw{POWER} p ON c.doc_id = p.doc_id AND c.dim = p.i GROUP BY ALL"),
    "ed": ([f"pw{POWER}", "mx"], f"SELECT m.doc_id, m.r, sum(m.x * p.v) AS along FROM mx m JOIN pw{POWER} p ON m.doc_id = p.doc_id AND m.dim = p.i GROUP BY ALL"),
    "psim": (["cand", "cv", "de", "cd", "ed"], f"""SELECT doc_id, sf, entity_id, (1 + coalesce(CASE WHEN nx * ny > 1e-24 THEN xy / sqrt(nx * ny) END, 0)) / 2 AS ctx_sim FROM
      (SELECT c.doc_id, c.sf, c.entity_id, sum(x * y) AS xy, sum(x * x) AS nx, sum(y * y) AS ny FROM (SELECT c.doc_id, c.sf, c.entity_id,
      v.x - cd.along * p.v AS x, d.x - ed.along * p.v AS y FROM cand c JOIN cv v ON c.doc_id = v.doc_id AND c.sf = v.sf
      JOIN de d ON c.entity_id = d.doc_id AND v.dim = d.dim JOIN cd ON cd.doc_id = c.doc_id AND cd.sf = c.sf
      JOIN ed ON ed.doc_id = c.doc_id AND ed.r = 'e' || c.entity_id JOIN pw{POWER} p ON p.doc_id = c.doc_id AND p.i = v.dim) c GROUP BY ALL)"""),
    # the first round that changes the scores of a document by no more than the tolerance
    **{
        f"ch{i}": ([f"s{i - 1}", f"s{i}"], f"SELECT a.doc_id, {i} AS k, sqrt(sum((a.s - b.s) * (a.s - b.s))) AS change FROM s{i} a JOIN s{i - 1} b USING (doc_id, sf, entity_id) GROUP BY a.doc_id")
        for i in range(1, MOST_ROUNDS + 1)
    },
    "stop": ([f"ch{i}" for i in range(1, MOST_ROUNDS + 1)], "SELECT doc_id, min(k) AS k FROM (" + " UNION ALL ".join(f"SELECT * FROM ch{i}" for i in range(1, MOST_ROUNDS + 1)) + ") WHERE change <= 0.001 GROUP BY doc_id"),
    "conv": (["stop"], "SELECT s.doc_id, s.sf, s.entity_id, s.s FROM (" + " UNION ALL ".join(f"SELECT {i} AS k, * FROM s{i}" for i in range(1, MOST_ROUNDS + 1)) + ") s JOIN stop USING (doc_id, k)"),
    "bp": (["pri"], "SELECT sf, entity_id AS chosen FROM pri QUALIFY row_number() OVER (PARTITION BY sf ORDER BY n DESC, entity_id) = 1"),
}


def _again(prefix: str, names: list[str]) -> None:
    """The named expressions once more, under a prefix, reading each other's copies."""
    for n in names:
        needed, text = _CTE[n]
        for table in names:  # keeps the old name as an alias where none is given
            text = re.sub(rf"\b(FROM|JOIN|, )\s*{table}(?=\s+(?:JOIN|LEFT|ON|WHERE|GROUP|QUALIFY|USING|SEMI|WINDOW)\b|\s*[,)]|\s*$)", rf"\1 {prefix}{table} AS {table}", text)
            text = re.sub(rf"\b(FROM|JOIN)\s+{table}(?=\s+\w)(?!\s+AS\b)(?!\s+(?:JOIN|LEFT|ON|WHERE|GROUP|QUALIFY|USING|SEMI|WINDOW)\b)", rf"\1 {prefix}{table}", text)
        _CTE.setdefault(prefix + n, ([prefix + x if x in names else x for x in needed], text))


# the dictionary as documents
_CTE["gcand"] = (["pri"], "SELECT CAST(length(sf) AS BIGINT) AS doc_id, * FROM pri")
_CTE["gcv"] = (["bp", "de"], "SELECT CAST(length(bp.sf) AS BIGINT) AS doc_id, bp.sf, de.dim, de.x FROM bp JOIN de ON bp.chosen = de.doc_id")
_again("g", [
    "cand", "cv", "sim", "top", "node", "pair", "up", "sh", "tr", "half", "mat", "rr1", "rr2", "rr3", "rr4", "stop", "conv",
    *[f"s{i}" for i in range(MOST_ROUNDS + 1)], *[f"ch{i}" for i in range(1, MOST_ROUNDS + 1)],
])
# a knowledge base built from pages alone
_CTE["bent"] = (["once"], f"""SELECT page_id AS entity_id, title AS name, lower(title) AS name_lower FROM once
  WHERE title IS NOT NULL AND NOT {_DISAMBIGUATION.format("title")}""")
_CTE["btok"] = (["pt", "once"], rf"""SELECT page_id AS doc_id, word, count(*) AS f FROM (SELECT page_id,
  unnest(string_split_regex(lower(text), '[\s\x{{a0}}\x{{85}}\x{{2000}}-\x{{200a}}\x{{3000}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{1680}}]+')) AS word FROM pt WHERE text <> ''
  AND page_id NOT IN (SELECT page_id FROM once WHERE title IS NOT NULL AND {_DISAMBIGUATION.format("title")}))
  WHERE word <> '' AND length(word) <= 128 GROUP BY page_id, word""")
_again("b", ["ent", "ek", "wl", "tok", "wf", "tot", "ww", "wx", "raw"])


def _sql(body: str, *needed: str) -> str:
    """The body after the expressions it needs, each once and in order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in _CTE[name][0]:
                add(n)
            order.append(name)

    for n in needed:
        add(n)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_CTE[n][1]})" for n in order) + "\n" if order else "") + body


ORACLE = {
    "entity_table": _sql("SELECT entity_id, name, name_lower FROM ent", "ent"),
    "entity_duplicates": """SELECT CAST(entity_id AS VARCHAR) AS key, count(DISTINCT name) AS versions FROM entity
      WHERE entity_id IS NOT NULL AND name IS NOT NULL GROUP BY entity_id HAVING count(DISTINCT name) > 1
      UNION ALL SELECT lower(name), count(DISTINCT entity_id) FROM entity WHERE entity_id IS NOT NULL AND name IS NOT NULL
      GROUP BY lower(name) HAVING count(DISTINCT entity_id) > 1""",
    "mention_dictionary": _sql("SELECT sf, entity_id, n FROM dict", "dict"),
    "incremental_dictionary": _sql("SELECT sf, entity_id, n FROM dict", "dict"),
    "title_mentions": _sql("SELECT name_lower AS sf, entity_id, CAST(1 AS BIGINT) AS n FROM ent", "ent"),
    "inlink_edges": _sql("SELECT to_id, from_id FROM edges", "edges"),
    "inlink_counts": _sql("SELECT to_id, inlinks FROM inl", "inl"),
    **{
        name: _sql(f"""SELECT to_id, piece, string_agg(CAST(from_id AS VARCHAR), ',' ORDER BY from_id) AS from_ids FROM
      (SELECT e.to_id, e.from_id, CASE WHEN i.inlinks <= {most} THEN 0 ELSE CAST(floor(e.from_id / {most}.0) AS BIGINT) + 1 END AS piece
       FROM edges e JOIN inl i ON e.to_id = i.to_id) GROUP BY to_id, piece""", "edges", "inl")
        for name, most in (("inlink_arrays", 4096), ("inlink_pieces", 256))
    },
    "word_freq": _sql("SELECT word, f FROM wf", "wf"),
    "total_word_count": _sql("SELECT CAST(total AS BIGINT) AS total FROM tot", "tot"),
    "sif_word_weight": _sql("SELECT word, round(weight, 6) AS weight FROM ww", "ww"),
    "sif_doc_embedding": _sql("SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(x, 4) + 0.0 AS x FROM raw", "raw"),
    "doc_embedding_complete": _sql("SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(x, 4) + 0.0 AS x FROM de", "de"),
    "page_links": _sql("SELECT page_id, href, anchor FROM lnk", "lnk"),
    "resolve_links": _sql("SELECT page_id, sf, entity_id, from_disambiguation FROM wl", "wl"),
    "mention_sources": _sql("""SELECT sf, entity_id, count(*) AS n FROM (SELECT sf, entity_id FROM wl UNION ALL
      SELECT name_lower, entity_id FROM ent) GROUP BY sf, entity_id""", "wl", "ent"),
    "link_sources": _sql("SELECT DISTINCT entity_id AS to_id, page_id AS from_id FROM wl WHERE NOT from_disambiguation", "wl"),
    "disambiguation_filter": f"""SELECT title, {_DISAMBIGUATION.format("title")} AS disambiguation,
      NOT {_DISAMBIGUATION.format("title")} AND NOT {_SKIP.format("title")} AS entity_title FROM (SELECT title FROM wiki_page UNION
      SELECT name FROM entity UNION SELECT unnest(['Mercury (disambiguation)', 'List of rivers', 'lists  of X', 'Template:Box',
      'Category:Y', 'File:z.png', 'Wikipedia:About', 'Listening'])) WHERE title IS NOT NULL""",
    "page_text": _sql("SELECT page_id, CAST(line_no AS INTEGER) AS line_no, text FROM pt WHERE text <> ''", "pt"),
    "doc_token_freq": _sql(rf"""SELECT page_id, word, count(*) AS f FROM (SELECT page_id,
      unnest(string_split_regex(lower(text), '[\s\x{{a0}}\x{{85}}\x{{2000}}-\x{{200a}}\x{{3000}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{1680}}]+')) AS word FROM pt WHERE text <> '')
      WHERE word <> '' AND length(word) <= 128 AND NOT regexp_matches(word, '{_URL}') GROUP BY page_id, word""", "pt"),
    "token_length_filter": rf"""SELECT doc_id, word, count(*) AS f FROM (SELECT doc_id,
      unnest(string_split_regex(lower(text), '[\s\x{{a0}}\x{{85}}\x{{2000}}-\x{{200a}}\x{{3000}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{1680}}]+')) AS word FROM documents)
      WHERE word <> '' AND (length(word) > 128 OR regexp_matches(word, '{_URL}')) GROUP BY doc_id, word""",
    "mention_markup": _sql("SELECT doc_id, sf, \"start\", \"end\" FROM occ", "occ"),
    "context_window": _sql("SELECT doc_id, sf, word FROM ctx", "ctx"),
    "candidates_prior": _sql("SELECT sf, entity_id, n, round(prior, 6) AS prior FROM pri", "pri"),
    "nil_mentions": _sql("""SELECT DISTINCT doc_id, sf FROM occ WHERE sf NOT IN (SELECT sf FROM pri)
      OR (doc_id, sf) NOT IN (SELECT (doc_id, sf) FROM cv WHERE x <> 0)""", "occ", "pri", "cv"),
    "common_component": _sql("SELECT doc_id, sf, entity_id, round(ctx_sim, 4) AS ctx_sim FROM psim", "psim"),
    "pagerank_converged": _sql("SELECT doc_id, sf, entity_id, round(s, 6) AS pa FROM conv", "conv"),
    "dictionary_topk": _sql("""SELECT sf, entity_id, round(ctx_sim, 3) AS ctx_sim FROM gsim QUALIFY row_number() OVER
      (PARTITION BY sf ORDER BY round(ctx_sim, 6) DESC, entity_id) <= 3""", "gsim"),
    "dictionary_propagation": _sql("SELECT doc_id, src_sf, src, dst_sf, dst, round(w, 6) AS w FROM gmat", "gmat"),
    "dictionary_converged": _sql("SELECT sf, entity_id, round(s, 6) AS pa FROM gconv", "gconv"),
    "dictionary_rerank": _sql("SELECT sf, CASE WHEN gs > gm THEN es ELSE em END AS entity_id FROM grr4", "grr4"),
    "dictionary_best": _sql(f"""SELECT sf, entity_id FROM g{_LAST} WHERE s > 0 QUALIFY row_number() OVER
      (PARTITION BY sf ORDER BY round(s, 9) DESC, entity_id) = 1""", f"g{_LAST}"),
    "redirect_mentions": _sql("""SELECT 'the ' || lower(upper(e.name)) AS sf, CASE WHEN ek.k = 1 THEN ek.only_id ELSE e.entity_id END AS entity_id,
      count(*) AS n FROM ent e JOIN ek ON lower(e.name) = ek.name_lower WHERE NOT """ + _SKIP.format("e.name") + " AND NOT " + _DISAMBIGUATION.format("e.name") + """
      GROUP BY 1, 2""", "ent", "ek"),
    "kb_build_entity": _sql("SELECT entity_id, name, name_lower FROM bent", "bent"),
    "kb_build_mention": _sql("""SELECT sf, entity_id, count(*) AS n FROM (SELECT sf, entity_id FROM bwl UNION ALL
      SELECT name_lower, entity_id FROM bent) GROUP BY sf, entity_id""", "bwl", "bent"),
    "kb_build_link": _sql("SELECT DISTINCT entity_id AS to_id, page_id AS from_id FROM bwl WHERE NOT from_disambiguation", "bwl"),
    "kb_build_doc_token": _sql("SELECT doc_id, word, f FROM btok", "btok"),
    "kb_build_word_freq": _sql("SELECT word, f FROM bwf", "bwf"),
    "kb_build_embedding": _sql("""SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(x, 4) + 0.0 AS x FROM braw
      WHERE doc_id IN (SELECT doc_id FROM braw WHERE x <> 0)""", "braw"),
    "tokenizer_goldens": """SELECT CAST(i AS INTEGER) AS line_no, t AS tokens FROM (VALUES (0, 'it ''s up .'), (1, 'do n''t'), (2, 'up , "'), (3, 'he said " rize . "'),
      (4, 'wait ... and'), (5, 'us$ 5 or $ 1.5'), (6, 'and / or 1996/97'), (7, 'in 2005 .'), (8, '2005.'), (9, 'the u.s. is'), (10, 'in the u.s .'),
      (11, 'mr. x came'), (12, 'foo - \\$ 5'), (13, 'SOCCER - Late'), (14, '1 - Jan x'), (15, '5. Mai x'), (16, 'J. Smith x'), (17, 'xx .. yy'),
      (18, '-- x'), (19, 'he said ( yes )'), (20, ''), (21, 'really ?'), (22, 'abc . - Def x'), (23, 'we ''ll go'), (24, 'x ( y ) z'),
      (25, ''), (26, '')) v(i, t)""",
    "context_similarity": _sql("SELECT doc_id, sf, entity_id, round(ctx_sim, 4) AS ctx_sim FROM sim", "sim"),
    "topk_candidates": _sql("""SELECT doc_id, sf, entity_id, round(ctx_sim, 4) AS ctx_sim FROM sim QUALIFY row_number() OVER
      (PARTITION BY doc_id, sf ORDER BY round(ctx_sim, 6) DESC, entity_id) <= 3""", "sim"),
    "initial_score": _sql("SELECT doc_id, sf, entity_id, round(raw, 4) AS raw, round(isa, 6) AS isa FROM node", "node"),
    "initial_choice": _sql("""SELECT doc_id, sf, entity_id FROM node WHERE raw > 0 QUALIFY row_number() OVER
      (PARTITION BY doc_id, sf ORDER BY round(raw, 9) DESC, entity_id) = 1""", "node"),
    "topical_relatedness": _sql("SELECT a, b, round(tr, 6) AS tr FROM tr", "tr"),
    "propagation_matrix": _sql("SELECT doc_id, src_sf, src, dst_sf, dst, round(w, 6) AS w FROM mat", "mat"),
    "pagerank_fixed_k": _sql(f"SELECT doc_id, sf, entity_id, round(s, 6) AS pa FROM {_LAST}", _LAST),
    "rerank": _sql("SELECT doc_id, sf, CASE WHEN gs > gm THEN es ELSE em END AS entity_id FROM rr4", "rr4"),
    "link_relatedness": _sql("SELECT a, b, round(tr, 6) AS tr FROM ltr", "ltr"),
    "link_pagerank": _sql(f"SELECT entity_id, round(s, 8) AS pa FROM l{ROUNDS}", f"l{ROUNDS}"),
    "evaluate_accuracy": _sql("""SELECT count(*) AS documents, CAST(coalesce(sum(total), 0) AS BIGINT) AS total, CAST(coalesce(sum(correct), 0) AS BIGINT) AS correct,
      CAST(coalesce(sum(nil), 0) AS BIGINT) AS nil FROM (SELECT g.doc_id, count(*) AS total, count(*) FILTER (WHERE c.chosen = g.entity_id) AS correct,
      count(*) FILTER (WHERE c.chosen IS NULL) AS nil FROM named g LEFT JOIN (SELECT doc_id, sf, CASE WHEN gs > gm THEN es ELSE em END AS chosen FROM rr4) c
      ON g.doc_id = c.doc_id AND g.sf = c.sf GROUP BY g.doc_id) WHERE total > nil""", "named", "rr4"),
    "evaluate_prior": _sql("""SELECT count(*) AS documents, CAST(coalesce(sum(total), 0) AS BIGINT) AS total, CAST(coalesce(sum(correct), 0) AS BIGINT) AS correct,
      CAST(coalesce(sum(nil), 0) AS BIGINT) AS nil FROM (SELECT g.doc_id, count(*) AS total, count(*) FILTER (WHERE bp.chosen = g.entity_id) AS correct,
      count(*) FILTER (WHERE bp.chosen IS NULL) AS nil FROM gold g LEFT JOIN bp ON g.sf = bp.sf GROUP BY g.doc_id) WHERE total > nil""", "gold", "bp"),
    "conll_mentions": """WITH r AS (SELECT l_orderkey AS doc_id, row_number() OVER w - 1 AS line_no, l_returnflag AS m, l_partkey, l_suppkey,
      sum(CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS island FROM lineitem
      WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))
      SELECT doc_id, 's' || max(CASE WHEN m = 'R' THEN l_suppkey END) AS sf, CAST(min(line_no) AS INTEGER) AS "start",
      CAST(max(line_no) + 1 AS INTEGER) AS "end", max(CASE WHEN m = 'R' THEN l_partkey END) AS gold FROM r GROUP BY doc_id, island
      HAVING max(CASE WHEN m = 'R' THEN 1 ELSE 0 END) = 1""",
    "p6_found": """SELECT 'link' AS kind, CAST(to_id AS VARCHAR) AS key FROM link WHERE to_id IS NOT NULL GROUP BY to_id
      HAVING count(*) > 0.02 * (SELECT count(*) FROM link)
      UNION ALL SELECT 'mention_count', sf FROM mention_count WHERE sf IS NOT NULL GROUP BY sf
      HAVING count(*) > 0.02 * (SELECT count(*) FROM mention_count)""",
    "p6_inlink_sizes": "SELECT to_id, count(DISTINCT from_id) AS inlinks FROM link WHERE to_id IS NOT NULL GROUP BY to_id",
    "p6_candidate_counts": """SELECT sf, entity_id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n FROM mention_count
      WHERE sf IS NOT NULL AND entity_id IS NOT NULL GROUP BY sf, entity_id""",
}
