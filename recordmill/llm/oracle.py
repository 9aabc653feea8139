"""SQL for DuckDB of the operators that SQL can express over whole tables; the others are tested by brute force."""

from recordmill.llm import licence_scan as licences
from recordmill.llm import url_filter as urls

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    form = f"regexp_replace({_lower(f'coalesce({text}, {_quoted("")})')}, {_quoted('(?m)' + licences.COPYRIGHT)}, '', 'g')"
    for spelling, common in licences.SPELLINGS:
        form = f"replace({form}, {_quoted(spelling)}, {_quoted(common)})"
    return f"trim(regexp_replace({form}, {_quoted(licences.OTHER)}, ' ', 'g'))"


def _licence_scan() -> str:
    texts = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licences.forms())
    digests = ", ".join(f"({_quoted(n)}, {_quoted(d)})" for n, ds in licences.DIGESTS.items() for d in ds)
    return f"""
        WITH named AS (SELECT sha256({_canonical('t')}) AS k, n FROM (VALUES {texts}) v(n, t)
                       UNION ALL SELECT d, n FROM (VALUES {digests}) w(n, d)),
        known AS (SELECT k, min(n) AS licence FROM named GROUP BY 1),
        mine AS (SELECT doc_id, sha256({_canonical('text')}) AS canonical_sha256 FROM documents)
        SELECT doc_id, licence, canonical_sha256 FROM mine LEFT JOIN known ON k = canonical_sha256"""


def _url_filter() -> str:
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
        for r in sorted(urls.RULES, key=lambda r: (len(r.name), r.name), reverse=True))
    block = ", ".join(_quoted(r.name) for r in urls.RULES if r.verdict == "block")
    names = [f"s{k}" for k in range(1, 9)]
    parts = [f"string_split(path, '/')[{k + 1}]" for k in range(1, 8)] + ["array_to_string(string_split(path, '/')[9:], '/')"]
    segments = ", ".join(f"regexp_replace(coalesce({part}, ''), '[0-9a-f]{{8,}}|[0-9]+', '*', 'g') AS {s}"
                         for s, part in zip(names, parts, strict=True))
    levels = ", ".join(names)
    sums = "sum(n)::DOUBLE AS n, sum(l)::DOUBLE AS l, sum(b)::DOUBLE AS b"
    steps = []
    for k, s in enumerate(names, 1):
        steps.append(f"""
        b{k} AS (SELECT host, template, {s}, {sums} FROM t{k - 1} GROUP BY ALL),
        a{k} AS (SELECT *, sum(l) OVER w AS al, sum(b) OVER w AS ab FROM b{k} WINDOW w AS (PARTITION BY host, template)),
        m{k} AS (SELECT *, l > 0 AND (n < 5 OR (al > l AND abs(b / l - (ab - b) / (al - l))
                   <= 1.96::DOUBLE * sqrt(ab / al * (1 - ab / al) * (1 / l + 1 / (al - l))))) AS merged FROM a{k}),
        t{k} AS (SELECT t.* EXCLUDE (template), template || CASE WHEN {s} = '' THEN ''
                   WHEN merged THEN '/?*' WHEN g.l = 0 AND g.n < 5 THEN '/?' ELSE '/' || {s} END AS template
                 FROM t{k - 1} t JOIN m{k} g USING (host, template, {s}))""")
    return f"""
        WITH u AS (SELECT page_id, {_lower(f"regexp_extract(coalesce(url, ''), '{urls.URL}', 1)")} AS host,
                     regexp_extract(coalesce(url, ''), '{urls.URL}', 2) AS path FROM pages),
        r AS (SELECT *, CASE {fits} END AS rule FROM u),
        s AS (SELECT *, {segments}, CASE WHEN rule IN ({block}) THEN 1 WHEN rule IS NOT NULL THEN 0 END AS label FROM r),
        t0 AS (SELECT host, {levels}, count(*) AS n, count(label) AS l, coalesce(sum(label), 0) AS b, '' AS template
               FROM s GROUP BY ALL),{','.join(steps)},
        o AS (SELECT host, template, (sum(b)::DOUBLE + 2.5::DOUBLE) / (sum(l)::DOUBLE + 5::DOUBLE) AS purity FROM t8 GROUP BY 1, 2)
        SELECT page_id, host, path, rule, CASE WHEN label = 1 THEN 'block' WHEN label = 0 THEN 'allow'
          WHEN purity >= 0.7::DOUBLE THEN 'block' ELSE 'allow' END AS verdict,
          replace(replace(template, '/?*', '/*'), '/?', '/*') AS template, purity
        FROM s JOIN t8 t USING (host, {levels}) JOIN o USING (host, template)"""


def _word_runs() -> str:
    return r"""
        WITH raw AS (SELECT row_number() OVER () AS r, doc_id,
                       regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                       list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT) AS bytes FROM documents),
        crc AS (SELECT r, doc_id, words, len(words) AS n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
                   flatten(list_transform(bytes, lambda b: [b, 999, 999, 999, 999, 999, 999, 999, 999]::UBIGINT[]))),
                   lambda c, t: CASE WHEN t < 999 THEN xor(c, t)
                     ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END::UBIGINT) END))::BIGINT AS h FROM raw),
        cut AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM crc),
        per AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM cut),
        text AS (SELECT r, doc_id, CASE WHEN a IS NULL THEN words ELSE list_transform(range(n), lambda i:
                   words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS words FROM per),
        word AS (SELECT r, unnest(range(len(words))) AS i, unnest(words) AS w FROM text),
        twice AS (SELECT * FROM word QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
        pair AS (SELECT x.r, x.i, y.i - x.i AS q FROM twice x JOIN twice y ON x.r = y.r AND x.w = y.w AND x.i < y.i),
        island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM pair),
        stretch AS (SELECT r, q, min(i) AS s, count(*) + q AS k FROM island GROUP BY r, q, g HAVING count(*) >= q AND count(*) + q >= 12),
        run AS (SELECT r, s, k, min(q) AS q FROM stretch GROUP BY r, s, k),
        gone AS (SELECT DISTINCT r, unnest(range(s + q, s + k)) AS i FROM run),
        listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || k || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
                     max((k, -s, -q)) AS best FROM run GROUP BY r),
        kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS collapsed FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -best[2] AS start, best[1] AS length, -best[3] AS period,
               1000 * best[1] // -best[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
               sha256(coalesce(collapsed, '')) AS collapsed_sha256
        FROM text LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)"""


def _divergence() -> str:
    share = "1 + 1000000000::HUGEINT * ({n} + 1) // ({total} + kept)"
    price = "({p} - {q}) * ({p} - {q}) // {q}"
    return rf"""
        WITH doc AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                       regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
        word AS (SELECT r, lang, source, unnest(list_transform(found, lambda t: {_lower('t')})) AS term FROM doc),
        vocabulary AS (SELECT lang, term, count(*) AS lang_n FROM word GROUP BY ALL HAVING count(DISTINCT r) >= 3),
        grp AS (SELECT DISTINCT lang, source FROM doc),
        langs AS (SELECT lang, count(term) AS kept, coalesce(sum(lang_n), 0) AS lang_total
                  FROM (SELECT DISTINCT lang FROM grp) LEFT JOIN vocabulary USING (lang) GROUP BY 1),
        n AS (SELECT lang, source, term, count(*) AS n FROM word SEMI JOIN vocabulary USING (lang, term) GROUP BY ALL),
        total AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM grp LEFT JOIN n USING (lang, source) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, v.term, coalesce(n, 0) AS n,
                {share.format(n="coalesce(n, 0)", total="total")} AS p, {share.format(n="lang_n", total="lang_total")} AS q
              FROM total g JOIN langs USING (lang) JOIN vocabulary v USING (lang)
              LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = v.term),
        pair AS (SELECT a.lang, a.source, b.source AS item, sum({price.format(p="a.p", q="b.p")}) AS value
                 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        both_parts AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
          UNION ALL SELECT lang, source, 'term', term, {price.format(p="p", q="q")} FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value,
          row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
        FROM both_parts QUALIFY part = 'pair' OR rank <= 200"""


def _embedding_dedup() -> str:
    return """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
        good AS (SELECT * FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
                   AND len(list_filter(x, lambda c: c <> 0)) > 0),
        link AS (SELECT a.r, b.r AS other, b.vec_id FROM good a JOIN good b ON a.r <> b.r AND len(a.x) = len(b.x)
                   AND list_cosine_similarity(a.x, b.x) >= 0.95::DOUBLE),
        reach AS (SELECT r, r AS other, vec_id FROM v UNION
                  SELECT reach.r, link.other, link.vec_id FROM reach JOIN link ON reach.other = link.r),
        least AS (SELECT r, min(vec_id) AS component_id FROM reach GROUP BY r),
        degree AS (SELECT r, count(*) AS n_links FROM link GROUP BY r)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN least USING (r) LEFT JOIN degree USING (r)"""


SQL: dict[str, str] = {
    "op3_licences": _licence_scan(),
    "op4_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_lower("coalesce(text, '')")} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op10_url_filter": _url_filter(),
    "op11_word_runs": _word_runs(),
    "op12_divergence": _divergence(),
    "op13_embedding_dedup": _embedding_dedup(),
}
