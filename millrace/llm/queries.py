"""Queries of the training-data operators and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from ..runtime import table as t
from . import canonical, grouping, leakage, mixing, overlap, packing, sentences, unparsable


_SPLITS = ("train_split", "valid_split", "test_split")


def queries() -> dict:
    return {
        "p1_found": lambda s, d: mixing.short_sources(t(s, d, "collection_results"), t(s, d, "mix_targets")),
        "p1_mix": lambda s, d: mixing.mix(t(s, d, "samples"), t(s, d, "mix_targets")),
        "p1_report": lambda s, d: mixing.mix_report(t(s, d, "samples"), t(s, d, "mix_targets")),
        "p3_found": lambda s, d: grouping.found_groups(t(s, d, "samples")),
        "p3_splits": lambda s, d: grouping.split_groups(t(s, d, "samples")),
        "p3_report": lambda s, d: grouping.split_report(t(s, d, "samples")),
        "p5_found": lambda s, d: canonical.found_copies(t(s, d, "samples")),
        "p5_collapsed": lambda s, d: canonical.collapse(t(s, d, "samples")).select("sample_id", "label", "source", "n_copies"),
        "p4_found": lambda s, d: overlap.found_overlaps(*(t(s, d, x) for x in _SPLITS)),
        "p4_report": lambda s, d: overlap.overlap_report(*(t(s, d, x) for x in _SPLITS)),
        "p6_found": lambda s, d: unparsable.found_unparsable(t(s, d, "repo_commits")),
        "p6_rates": lambda s, d: unparsable.rates(t(s, d, "repo_commits")),
        "p7_pack": lambda s, d: packing.pack(t(s, d, "documents"), t(s, d, "pack_limits")),
        "p7_report": lambda s, d: packing.pack_report(t(s, d, "documents"), t(s, d, "pack_limits")),
        "p8_found": lambda s, d: leakage.found_leaks(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_leaks": lambda s, d: leakage.leaks(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_report": lambda s, d: leakage.leak_report(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_found": lambda s, d: sentences.found_sentences(t(s, d, "documents")),
    }


_RUNS = """list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"""
_WORDS = r"""regexp_extract_all(regexp_replace(lower(text), '([\x{3040}-\x{30FF}\x{3400}-\x{9FFF}])', ' \1 ', 'g'), '[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]|[\p{L}\p{N}]+')"""


_LEAKS = f"""WITH i AS (SELECT item_id, CASE WHEN lang IN ('zh', 'ja') THEN 24 ELSE 12 END AS n, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
            d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
            iw AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g FROM i WHERE len(w) >= n),
            dw AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12 UNION ALL SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 22), lambda k: array_to_string(w[k:k + 23], ' '))) FROM d WHERE len(w) >= 24),
            l AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g))"""
_COPIES = r"""WITH x AS (SELECT sample_id, label, regexp_replace(lower(code), '[^\p{L}\p{N}]+', '', 'g') AS c, attrs FROM samples WHERE label IS NOT NULL AND code IS NOT NULL),
            j AS (SELECT sample_id, string_agg(t.fullkey || '=' || coalesce(t.atom::VARCHAR, ''), ',' ORDER BY t.fullkey) AS a FROM x, json_tree(x.attrs) t GROUP BY 1),
            y AS (SELECT x.sample_id, min(x.sample_id) OVER g AS first_id, count(*) OVER g AS n FROM x LEFT JOIN j USING (sample_id) WHERE c <> '' WINDOW g AS (PARTITION BY label, c, attrs IS NULL, j.a))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """WITH l AS (SELECT run_id, collectors FROM (SELECT run_id, collectors, row_number() OVER (PARTITION BY run_id ORDER BY written_at DESC) AS r FROM collection_results) WHERE r = 1),
            c AS (SELECT run_id, lower(trim(k)) AS k, coalesce(v.samples_collected, 0) AS n FROM (SELECT run_id, unnest(map_keys(collectors)) AS k, unnest(map_values(collectors)) AS v FROM l)),
            s AS (SELECT run_id, k, sum(n) AS n FROM c GROUP BY 1, 2), total AS (SELECT run_id, sum(n) AS n FROM c GROUP BY 1)
            SELECT total.run_id, m.source FROM total CROSS JOIN mix_targets m LEFT JOIN s ON s.run_id = total.run_id AND s.k = m.collector
            WHERE m.target_pct * total.n > 100 * m.max_repeats * coalesce(s.n, 0)""",
        "p3_found": r"""WITH RECURSIVE x AS (SELECT sample_id, coalesce('e' || lower(trim(metadata.ecosystem)), 'n') AS eco, unnest(regexp_split_to_array(lower(metadata.package_name), '[,;|\r\n]')) AS name FROM samples),
            k AS (SELECT sample_id, eco || chr(1) || regexp_replace(name, '[^\p{L}\p{N}]+', '', 'g') AS key FROM x WHERE regexp_replace(name, '[^\p{L}\p{N}]+', '', 'g') <> ''),
            e AS (SELECT DISTINCT a.key AS a, b.key AS b FROM k a JOIN k b USING (sample_id)),
            r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
            f AS (SELECT key, min(sample_id) AS first FROM k GROUP BY 1), g AS (SELECT r.a AS key, min(f.first) AS group_id FROM r JOIN f ON f.key = r.b GROUP BY 1),
            m AS (SELECT DISTINCT k.sample_id, g.group_id FROM k JOIN g USING (key))
            SELECT sample_id, group_id FROM m WHERE group_id IN (SELECT group_id FROM m GROUP BY 1 HAVING count(*) > 1)""",
        "p4_found": f"""WITH a AS (SELECT row_id, s, list_transform(regexp_extract_all(code, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM (SELECT row_id, code, 't' AS s FROM train_split UNION ALL SELECT row_id, code, 'e' FROM valid_split UNION ALL SELECT row_id, code, 'e' FROM test_split) WHERE code IS NOT NULL),
            b AS (SELECT row_id, s, {_RUNS} AS g FROM a WHERE len(w) >= 3), u AS (SELECT row_id, s, len(g) AS n, unnest(g) AS h FROM b)
            SELECT least(x.row_id, y.row_id) AS id_a, greatest(x.row_id, y.row_id) AS id_b FROM u x JOIN u y USING (h) WHERE x.s = 't' AND y.s = 'e'
            GROUP BY x.row_id, y.row_id, x.n, y.n HAVING count(*) >= 0.6 * (x.n + y.n - count(*))""",
        "p4_report": f"""WITH a AS (SELECT row_id, s, source, list_transform(regexp_extract_all(code, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM (SELECT row_id, code, 'train' AS s, NULL AS source FROM train_split UNION ALL SELECT row_id, code, 'valid', metadata.source FROM valid_split UNION ALL SELECT row_id, code, 'test', metadata.source FROM test_split) WHERE code IS NOT NULL),
            b AS (SELECT row_id, s, source, array_to_string(w, ' ') AS c, {_RUNS} AS g FROM a WHERE len(w) >= 3), u AS (SELECT row_id, s, source, c, len(g) AS n, unnest(g) AS h FROM b),
            p AS (SELECT y.row_id, y.s AS split, coalesce(lower(trim(y.source)), 'unknown') AS source, x.c = y.c AS same FROM u x JOIN u y USING (h) WHERE x.s = 'train' AND y.s <> 'train'
            GROUP BY x.row_id, y.row_id, x.n, y.n, y.s, y.source, x.c, y.c HAVING count(*) >= 0.6 * (x.n + y.n - count(*)))
            SELECT split, source, count(*) FILTER (same) AS exact, count(*) FILTER (NOT same) AS near, count(DISTINCT row_id) AS leaked_rows FROM p GROUP BY 1, 2""",
        "p5_found": f"""{_COPIES} SELECT first_id, sample_id AS copy_id FROM y WHERE first_id <> sample_id""",
        "p5_collapsed": f"""{_COPIES} SELECT s.sample_id, s.label, s.source, coalesce(y.n, 1) AS n_copies FROM samples s LEFT JOIN y USING (sample_id) WHERE y.sample_id IS NULL OR y.first_id = y.sample_id""",
        "p8_found": f"""{_LEAKS} SELECT doc_id, item_id FROM l""",
        "p8_report": f"""{_LEAKS} SELECT item_id, count(*) AS n_docs FROM l GROUP BY 1""",
    }
