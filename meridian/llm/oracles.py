"""DuckDB SQL of the operators that SQL can express, by brute force."""

SUBSTRING_DEDUP = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM w),
    win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p WHERE i + 34 <= len(w)),
    rep AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
    gone AS (SELECT DISTINCT doc_id, i + k AS i FROM rep, range(35) t(k)),
    kept AS (SELECT p.doc_id, string_agg(p.w[p.i], ' ' ORDER BY p.i) AS s, count(*) AS n FROM p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
    SELECT w.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
NEAR_DEDUP = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach(doc_id, r) AS (SELECT a, a FROM edge UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.r),
    comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
    SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)"""
#: Weights of buckets in thousandths of a document: own counts, and 200 documents dealt like the wider group.
_BLEND = """{n} AS (SELECT {by}, metric, b, sum(w)::BIGINT AS w FROM (SELECT {by}, metric, b, 1000 * count(*) AS w FROM buckets GROUP BY ALL
    UNION ALL SELECT {by}, metric, b, (200000 * w) // whole FROM (SELECT DISTINCT {by}, metric FROM buckets) JOIN (SELECT *, (sum(w) OVER (PARTITION BY {to}, metric))::BIGINT AS whole FROM {wider}) USING ({to}, metric)) GROUP BY ALL)"""
QUALITY_RULES = r"""WITH w AS (SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 2], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS c FROM win) WHERE c > 1),
    cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(3) t(k) GROUP BY doc_id),
    lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    m AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(lines.n - lines.d, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lines USING (doc_id)),
    v AS (SELECT doc_id, lang, source, unnest([1, 2, 3, 4]) AS place, unnest(['word_length', 'symbol_share', 'dup_line_share', 'repeat_share']) AS metric, unnest([0.0, 0.01, 0.35, 0.3])::DOUBLE AS low,
    unnest([word_chars / greatest(n_words, 1)::DOUBLE, n_symbols / greatest(n_words, 1)::DOUBLE, n_dup_lines / greatest(n_lines, 1)::DOUBLE, n_repeat_words / greatest(n_words, 1)::DOUBLE]) AS v FROM m),
    buckets AS (SELECT *, greatest(-200, CASE WHEN v > 0 THEN floor(ln(v) / ln(1.05))::INT ELSE -200 END) AS b, 1 AS every FROM v),
    top AS (SELECT every, metric, b, 1000 * count(*) AS w FROM buckets GROUP BY ALL), """ + _BLEND.format(n="mid", by="every, lang", to="every", wider="top") + ", " + _BLEND.format(n="fine", by="lang, source", to="lang", wider="mid") + r""",
    cut AS (SELECT lang, source, metric, min(b) FILTER (4 * upto >= total) AS q1, min(b) FILTER (4 * upto >= 3 * total) AS q3
    FROM (SELECT *, sum(w) OVER (PARTITION BY lang, source, metric ORDER BY b) AS upto, sum(w) OVER (PARTITION BY lang, source, metric) AS total FROM fine) GROUP BY ALL),
    judged AS (SELECT doc_id, place, metric, v > greatest(low, CASE WHEN q3 > -200 THEN pow(1.05, q3 + 1 + 3.0 * (q3 - q1)) ELSE 0.0 END) AS beyond FROM buckets JOIN cut USING (lang, source, metric)),
    verdict AS (SELECT doc_id, arg_min(metric, place) FILTER (beyond) AS over FROM judged GROUP BY doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND over IS NULL AS kept, over FROM m JOIN verdict USING (doc_id)"""
EMBEDDING_DEDUP = r"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x != 0))),
    link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
    reach(vec_id, r) AS (SELECT a, a FROM link UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.r),
    comp AS (SELECT vec_id, min(r) AS c FROM reach GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN comp USING (vec_id)"""
FILTER_AUDIT = r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
    f AS (SELECT w.*, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM w LEFT JOIN l USING (doc_id)),
    m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
    x AS (SELECT i, 1 << i AS bit FROM range(5) r(i)),
    o AS (SELECT chr((65 + p.i)::INT) || chr((65 + q.i)::INT) || chr((65 + r.i)::INT) || chr((65 + s.i)::INT) || chr((65 + t.i)::INT) AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
    FROM x p, x q, x r, x s, x t WHERE (p.bit | q.bit | r.bit | s.bit | t.bit) = 31),
    steps AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::BIGINT AS before FROM o, range(1, 6) u(k)),
    g AS (SELECT part, filter_order, step, bit, n, good, bad, (mask & bit) > 0 AS fails, (mask & before) > 0 AS gone, mask = bit AS alone FROM m, steps),
    r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM g GROUP BY ALL)
    SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
INFILLING = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
    x AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
    p AS (SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
    SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
