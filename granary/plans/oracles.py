"""The same queries as ANSI SQL for DuckDB; queries that SQL cannot express are not here."""

from __future__ import annotations

_DIGEST = "SELECT doc_id, source, lang, sha256(text) AS digest FROM documents"

_SPANS = """spans AS (SELECT l_partkey AS part, l_returnflag, l_orderkey, l_linenumber,
  date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS "start",
  date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem)"""


def _merge(source: str, keys: str, gap: int, name: str) -> str:
    return f"""{name}_o AS (SELECT {keys}, "start", "end", max("end") OVER (PARTITION BY {keys} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({source})),
{name}_i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM {name}_o),
{name} AS (SELECT {keys}, min("start") AS "start", max("end") AS "end" FROM {name}_i GROUP BY {keys}, island)"""


_HALF = _merge('SELECT part, "start", "end" FROM spans WHERE "end" > "start"', "part", 0, "merged")

_GATED = """gated AS (SELECT d.doc_id, source, lang, n_chars AS size, sha256(text) AS digest,
  list_filter([CASE WHEN quality IS NULL THEN 'unlabelled' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END,
    CASE WHEN n_chars < 200 THEN 'too_short' END, CASE WHEN n_chars > 20000 THEN 'too_long' END], lambda x: x IS NOT NULL) AS reasons
  FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""

_SETS = """words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
runs AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END AS r FROM words),
sets AS (SELECT doc_id, list_sort(list_filter(list_distinct(list_transform(r, lambda x: CAST('0x' || substr(md5(x), 1, 15) AS BIGINT))), lambda h: h < 144115188075855872)) AS items FROM runs)"""

#: Whole sets of shingles, by the text of each.
_WHOLE = _SETS.split("\nsets AS")[0] + "\nsets AS (SELECT doc_id, list_sort(list_distinct(r)) AS items FROM runs)"

_PAIRS = """heads AS (SELECT min(doc_id) AS doc_id, items FROM sets WHERE len(items) > 0 GROUP BY items),
flat AS (SELECT doc_id, len(items) AS n, unnest(items) AS x FROM heads),
shared AS (SELECT a.doc_id AS "left", b.doc_id AS "right", a.n AS nl, b.n AS nr, count(*) AS s FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT "left", "right", CAST(s AS DOUBLE) / (nl + nr - s) AS jaccard FROM shared WHERE CAST(s AS DOUBLE) / (nl + nr - s) >= 0.8)"""

#: Whole texts as symbols, one for each half byte.
_CODED = "translate(hex(coalesce(text, '')), '0123456789ABCDEF', 'ACGTACGTACGNACGT')"

ORACLES = {
    "content_ids": "SELECT doc_id, substr(sha256(text), 1, 16) AS content_id FROM documents",
    "classify_urls": """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'fasta' WHEN 1 THEN 'annotation' WHEN 2 THEN 'archive' ELSE 'other' END AS file_type,
      CASE WHEN contains(lower(url), 'softmask') THEN 'softmasked' WHEN contains(lower(url), 'genome_main') THEN 'main' WHEN contains(lower(url), '_genomic.fna') THEN 'ncbi_genomic' ELSE 'generic_genome' END AS genome_role FROM pages""",
    "url_normalise": "SELECT page_id, trim(regexp_replace(regexp_replace(lower(trim(' DOI: https://doi.org/' || url)), '^doi:\\s*', ''), '^https?://(?:dx\\.)?doi\\.org/', '')) AS doi FROM pages",
    "html_meta_extract": """SELECT page_id, regexp_extract(html, '(?i)<meta charset=["'']([^"'']*)', 1) AS charset,
      trim(regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<meta[^>]+name=["'']description["''][^>]*content=["'']([^"'']*)', 1), ''), regexp_extract(html, '(?is)<meta[^>]+content=["'']([^"'']*)["''][^>]*name=["'']description["'']', 1)), '\\s+', ' ', 'g')) AS description FROM pages""",
    "title_normalise_ascii": "SELECT p_partkey, array_to_string(regexp_extract_all(lower(regexp_replace(p_name, '<[^>]+>', ' ', 'g')), '([a-z0-9_]+)', 1), ' ') AS title FROM part",
    "material_keys": """SELECT 'supplier' AS kind, s_suppkey AS id, regexp_replace(lower(regexp_replace(s_name || '_T2T', '(?i)(?:[_-]?t2t(?:-?2)?|\\.v\\d+)$', '')), '[^a-z0-9]+', '', 'g') AS material_key FROM supplier
      UNION ALL SELECT 'part', p_partkey, regexp_replace(lower(regexp_replace(p_name || '.v2', '(?i)(?:[_-]?t2t(?:-?2)?|\\.v\\d+)$', '')), '[^a-z0-9]+', '', 'g') FROM part""",
    "safe_paths": "SELECT page_id, page_id % 3 = 2 AS safe FROM pages",
    "binomials": "SELECT p_partkey, array_to_string(list_slice(regexp_split_to_array(trim(p_type), '\\s+'), 1, 2), ' ') AS binomial, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS brand_key FROM part",
    "json_props": "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_number FROM events",
    "record_classes": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN false
      WHEN o_orderstatus = 'F' OR o_orderpriority LIKE '1%' THEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' ELSE floor(o_totalprice) >= 150000 END AS is_primary FROM orders""",
    "exact_dup_groups": f"""WITH d AS ({_DIGEST}), n AS (SELECT doc_id, digest, count(*) OVER (PARTITION BY digest) AS n FROM d)
      SELECT doc_id, CASE WHEN n > 1 THEN 'exact_' || substr(digest, 1, 16) ELSE '' END AS exact_group, n AS exact_group_size FROM n""",
    "exact_representative": f"""WITH d AS ({_DIGEST}) SELECT digest, doc_id, source FROM d
      QUALIFY row_number() OVER (PARTITION BY digest ORDER BY CASE source WHEN 'src3' THEN 0 WHEN 'src0' THEN 1 ELSE 9 END, source, doc_id) = 1""",
    "exact_unique_symbols": "SELECT lang, count(*) AS texts, CAST(sum(n) AS BIGINT) AS symbols FROM (SELECT sha256(text) AS digest, min(lang) AS lang, min(n_chars) AS n FROM documents GROUP BY 1) GROUP BY lang",
    "label_propagation": f"""WITH d AS ({_DIGEST}), l AS (SELECT d.doc_id, digest, 'q' || quality || ' t' || toxic AS label FROM d LEFT JOIN labels USING (doc_id)),
      b AS (SELECT digest, min(label) AS best FROM l WHERE label IS NOT NULL GROUP BY digest)
      SELECT doc_id, coalesce(label, best) AS label, CASE WHEN label IS NOT NULL THEN 'given' WHEN best IS NOT NULL THEN 'exact_group' ELSE 'unresolved' END AS label_source FROM l LEFT JOIN b USING (digest)""",
    "taxon_conflict": f"WITH d AS ({_DIGEST}) SELECT digest, count(DISTINCT source) AS sources FROM d GROUP BY digest HAVING count(DISTINCT source) > 1",
    "staged_imputation": f"""WITH d AS ({_DIGEST}), a AS (SELECT doc_id, digest, source, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN lang END AS lang FROM d),
      a1 AS (SELECT *, CASE WHEN lang IS NULL THEN 'unresolved' ELSE 'given' END AS lang_source FROM a),
      u1 AS (SELECT digest, min(lang) AS v FROM a1 WHERE lang <> '' GROUP BY digest HAVING count(DISTINCT lang) = 1),
      a2 AS (SELECT doc_id, digest, source, coalesce(lang, v) AS lang, CASE WHEN lang IS NULL AND v IS NOT NULL THEN 'exact_group' ELSE lang_source END AS lang_source FROM a1 LEFT JOIN u1 USING (digest)),
      a3 AS (SELECT doc_id, source, CASE WHEN doc_id % 17 = 0 THEN 'official' ELSE lang END AS lang, CASE WHEN doc_id % 17 = 0 THEN 'official' ELSE lang_source END AS lang_source FROM a2),
      u3 AS (SELECT source, min(lang) AS v FROM a3 WHERE lang <> '' GROUP BY source HAVING count(DISTINCT lang) = 1)
      SELECT doc_id, coalesce(lang, v) AS lang, CASE WHEN lang IS NULL AND v IS NOT NULL THEN 'source' ELSE lang_source END AS lang_source FROM a3 LEFT JOIN u3 USING (source)""",
    "audit_status": """SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') THEN 'PASS'
      WHEN o_orderkey IN (SELECT event_id FROM events WHERE event_type = 'error') THEN 'FAIL' ELSE 'MISSING' END AS status FROM orders""",
    "missing_extras": """WITH o AS (SELECT o_orderkey AS id FROM orders) SELECT id, 'missing' AS side FROM o WHERE id NOT IN (SELECT l_orderkey FROM lineitem)
      UNION ALL SELECT DISTINCT l_orderkey, 'extra' FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM o)""",
    "set_equality": """SELECT *, 'left' AS side FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT n_nationkey FROM nation)
      UNION ALL SELECT *, 'right' FROM (SELECT n_nationkey FROM nation EXCEPT ALL SELECT c_nationkey FROM customer)""",
    "first_failure": "SELECT user_id, event_id, value FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "fallback_pairing": """WITH s AS (SELECT s_suppkey, n_name || '|' || CAST(CAST(floor(s_acctbal / 1000) AS BIGINT) AS VARCHAR) AS pk, n_name AS fk FROM supplier JOIN nation ON s_nationkey = n_nationkey),
      c AS (SELECT c_custkey, n_name || '|' || CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR) AS pk, n_name AS fk FROM customer JOIN nation ON c_nationkey = n_nationkey),
      m AS (SELECT c_custkey, 1 AS pair_level, pk AS pair_key FROM c UNION ALL SELECT c_custkey, 2, fk FROM c), g AS (SELECT pair_level, pair_key, count(*) AS n FROM m GROUP BY ALL),
      p AS (SELECT s_suppkey, coalesce(a.pair_level, b.pair_level) AS pair_level, coalesce(a.pair_key, b.pair_key) AS pair_key, coalesce(a.n, b.n, 0) AS n
        FROM s LEFT JOIN g a ON a.pair_level = 1 AND s.pk = a.pair_key LEFT JOIN g b ON b.pair_level = 2 AND s.fk = b.pair_key),
      u AS (SELECT pair_level, pair_key, count(*) AS n FROM p WHERE pair_level IS NOT NULL GROUP BY ALL)
      SELECT 'left' AS side, s_suppkey AS id, pair_level, pair_key, n AS paired_count FROM p UNION ALL SELECT 'right', c_custkey, pair_level, pair_key, n FROM m JOIN u USING (pair_level, pair_key)""",
    "union_catalog": "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, '.' FROM supplier",
    "style_majority": """WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
      SELECT user_id, event_type AS style FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""",
    "closure_audit": """WITH p AS (SELECT p_partkey % 10 AS k, p_partkey AS seqid, CAST(floor(p_retailprice) AS BIGINT) AS length FROM part WHERE p_size < 48),
      f AS (SELECT l_partkey % 10 AS k, l_partkey AS seqid, l_linenumber AS s, l_linenumber + floor(l_quantity * 30) AS e, l_returnflag = 'N' AS gene FROM lineitem),
      j AS (SELECT f.k, f.seqid, gene, length, s < 1 OR e < s OR e > length AS bad FROM f LEFT JOIN p ON f.k = p.k AND f.seqid = p.seqid),
      u AS (SELECT k, array_to_string(list_slice(list(seqid ORDER BY seqid), 1, 20), ';') AS preview, CAST(sum(CAST('0x' || substr(md5(CAST(seqid AS VARCHAR)), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM (SELECT DISTINCT k, seqid FROM j WHERE length IS NULL) GROUP BY k),
      a AS (SELECT k, count(*) AS feature_count, count_if(gene) AS gene_count, count(DISTINCT seqid) FILTER (length IS NOT NULL) AS matched_seqid_count,
        count(DISTINCT seqid) FILTER (length IS NULL) AS unknown_seqid_count, count_if(bad) AS out_of_bounds_feature_count FROM j GROUP BY k)
      SELECT a.k, feature_count, CAST(gene_count AS BIGINT) AS gene_count, matched_seqid_count, unknown_seqid_count, CAST(out_of_bounds_feature_count AS BIGINT) AS out_of_bounds_feature_count, coalesce(preview, '') AS unknown_preview, coalesce(digest, '0') AS unknown_digest,
        CASE WHEN feature_count > 0 AND gene_count > 0 AND unknown_seqid_count = 0 AND out_of_bounds_feature_count = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM a LEFT JOIN u USING (k)""",
    "longest_field_merge": """WITH t AS (SELECT conv_id, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) = 1)
      SELECT conv_id, text, (SELECT string_agg(DISTINCT role, ';' ORDER BY role) FROM conversations c WHERE c.conv_id = t.conv_id) AS roles FROM t""",
    "resume_remaining": """SELECT o_orderkey AS id, o_orderstatus AS version FROM orders o WHERE NOT EXISTS
      (SELECT 1 FROM events e WHERE e.event_id = o.o_orderkey AND CASE WHEN event_type = 'click' THEN 'F' ELSE 'O' END = o.o_orderstatus)""",
    "unified_catalog": f"""WITH d AS ({_DIGEST}), s AS (SELECT *, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'PASS' WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'FAIL' ELSE 'MISSING' END AS status FROM d)
      SELECT doc_id, status, CASE WHEN status = 'PASS' THEN 'exact-' || substr(digest, 1, 16) ELSE '' END AS exact_group, CASE WHEN status = 'PASS' THEN count(*) OVER (PARTITION BY digest, status) ELSE 0 END AS exact_group_size,
      status = 'PASS' AND row_number() OVER (PARTITION BY digest, status ORDER BY source, doc_id) = 1 AS exact_representative FROM s""",
    "gated_selection": f"""WITH {_GATED}, o AS (SELECT *, len(reasons) = 0 AS ok, row_number() OVER (PARTITION BY len(reasons) = 0, digest ORDER BY size DESC, doc_id DESC) AS r1 FROM gated),
      m AS (SELECT *, row_number() OVER (PARTITION BY ok AND r1 = 1, lang, source ORDER BY size DESC, doc_id DESC) AS r2 FROM o)
      SELECT doc_id, array_to_string(reasons, ';') AS reasons, CASE WHEN NOT ok THEN 'REJECTED_HARD_GATE' WHEN r1 > 1 THEN 'REJECTED_ORIENTATION_ALTERNATIVE' WHEN r2 > 1 THEN 'REJECTED_MATERIAL_ALTERNATIVE' ELSE 'SELECTED' END AS status FROM m""",
    "reason_counts": f'WITH {_GATED}, r AS (SELECT unnest(reasons) AS reason FROM gated) SELECT reason, count(*) AS "rows" FROM r GROUP BY reason',
    "tier_case": """WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS l, s_suppkey % 3 = 0 AS t, floor(s_acctbal) >= 3000 AND s_acctbal / 10000 >= 0.5 AS big FROM supplier)
      SELECT s_suppkey, CASE WHEN l = 0 THEN 'complete_genome' WHEN l = 1 AND t THEN 'chromosome_official_t2t' WHEN l = 1 THEN 'chromosome_official' WHEN t THEN 't2t_label' WHEN big THEN 'structural_proxy' ELSE 'insufficient' END AS label,
      CASE WHEN l = 0 THEN 4 WHEN l = 1 AND t THEN 5 WHEN l = 1 THEN 3 WHEN t THEN 5 WHEN big THEN 2 ELSE 0 END AS tier, l > 1 AS pending FROM s""",
    "multi_rule_semi": "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE (l_quantity >= 45 AND l_discount * 1000 >= 90.0) OR (l_quantity >= 30 AND l_discount * 1000 >= 95.0)",
    "tiered_batch": """WITH p AS (SELECT *, CASE WHEN p_size > 45 THEN 1 WHEN p_size > 20 THEN 2 ELSE 3 END AS tier FROM part)
      SELECT p_partkey, p_size, tier FROM p WHERE tier = (SELECT min(tier) FROM p) QUALIFY row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) <= CASE tier WHEN 1 THEN 25 WHEN 2 THEN 50 ELSE 100 END""",
    "source_provenance": """WITH s AS (SELECT s_suppkey, array_to_string(list_filter([CASE WHEN NOT length(s_name) > 0 THEN 'name' END, CASE WHEN NOT s_acctbal > 0 THEN 'balance' END, CASE WHEN NOT s_nationkey < 20 THEN 'nation' END], lambda x: x IS NOT NULL), ';') AS m FROM supplier)
      SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'LICENSE_REVIEW_REQUIRED' WHEN s_suppkey % 7 = 0 THEN 'PENDING_NO_RESOLVER' WHEN m <> '' THEN 'INCOMPLETE_METADATA' WHEN s_suppkey % 5 = 0 THEN 'LICENSE_REVIEW_REQUIRED' ELSE 'PASS' END AS status, coalesce(nullif(m, ''), '.') AS missing FROM s""",
    "n50_by_lang": """WITH c AS (SELECT lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING) AS c, sum(n_chars) OVER (PARTITION BY lang) AS t FROM documents)
      SELECT lang, max(n_chars) FILTER (2 * c >= t) AS n50 FROM c GROUP BY lang""",
    "symbol_counts": "SELECT lang, s.symbol AS symbol, CAST(sum(length(upper(text)) - length(replace(upper(text), s.symbol, ''))) AS BIGINT) AS n FROM documents, (SELECT unnest(['A','C','G','T','N']) AS symbol) s GROUP BY lang, s.symbol",
    "summary_rollup": """SELECT count(*) AS documents, count(quality) AS labelled, CAST(count_if(quality = 1 AND toxic = 0) AS BIGINT) AS clean, count(DISTINCT source) AS sources, count(DISTINCT sha256(text)) AS texts,
      CAST(sum(n_chars) AS BIGINT) AS characters, max(n_chars) AS longest FROM documents LEFT JOIN labels USING (doc_id)""",
    "orientation_groups": """WITH s AS (SELECT doc_id, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGT]', 'N', 'g') AS f FROM documents), r AS (SELECT doc_id, f, reverse(translate(f, 'ACGT', 'TGCA')) AS c FROM s),
      k AS (SELECT doc_id, length(f) || ':' || least(sha256(f), sha256(c)) AS signature FROM r)
      SELECT doc_id, signature, count(*) OVER (PARTITION BY signature) AS group_size, min(doc_id) OVER (PARTITION BY signature) AS representative FROM k""",
    "merge_half_open": f"WITH {_SPANS}, {_HALF} SELECT * FROM merged",
    "merge_inclusive": f"WITH {_SPANS}, {_merge('SELECT part, "start", "end" FROM spans', 'part', 1, 'merged')} SELECT * FROM merged",
    "merged_bases": f'WITH {_SPANS}, {_merge('SELECT part, "start", "end" FROM spans', 'part', 1, 'merged')} SELECT part, CAST(sum("end" - "start" + 1) AS BIGINT) AS bases FROM merged GROUP BY part',
    "merge_sources": f"""WITH {_SPANS}, {_HALF} SELECT m.part, m."start", m."end", string_agg(DISTINCT s.l_returnflag, ';' ORDER BY s.l_returnflag) AS sources
      FROM merged m JOIN spans s ON s.part = m.part AND s."start" < m."end" AND m."start" < s."end" GROUP BY m.part, m."start", m."end" """,
    "subtract_masks": f"""WITH {_SPANS}, {_HALF}, {_merge('SELECT part, "start" + 5 AS "start", "start" + 12 AS "end" FROM spans WHERE l_linenumber = 1', 'part', 0, 'masks')},
      j AS (SELECT m.part, m."start" AS s, m."end" AS e, k."start" AS ms, k."end" AS me, lead(k."start") OVER w AS nxt, row_number() OVER w AS n FROM merged m LEFT JOIN masks k ON k.part = m.part AND k."start" < m."end" AND m."start" < k."end" WINDOW w AS (PARTITION BY m.part, m."start" ORDER BY k."start")),
      pieces AS (SELECT part, s AS "start", CASE WHEN ms IS NULL THEN e ELSE ms END AS "end" FROM j WHERE n = 1 UNION ALL SELECT part, me, coalesce(nxt, e) FROM j WHERE ms IS NOT NULL)
      SELECT * FROM pieces WHERE "end" > "start" """,
    "localised_intervals": """WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS record_index, CAST(sum(l_quantity) AS BIGINT) AS length FROM lineitem GROUP BY ALL)
      SELECT l_orderkey, record_index, CAST(floor(length / 4) AS BIGINT) AS "start", CAST(floor(length / 4) + ceil(length / 2) AS BIGINT) AS "end" FROM l WHERE length > 0""",
    "containment_check": f"""WITH {_SPANS}, {_merge('SELECT part, "start", "end" FROM spans WHERE l_returnflag <> \'N\' AND "end" > "start"', 'part', 0, 'merged')}
      SELECT part, l_orderkey, l_linenumber, "start", "end", EXISTS (SELECT 1 FROM merged m WHERE m.part = s.part AND m."start" <= s."start" AND s."end" <= m."end") AS inside FROM spans s WHERE l_returnflag = 'N'""",
    "overlap_violations": f"""WITH {_SPANS}, p AS (SELECT part, "start", max("end") OVER (PARTITION BY part ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM spans)
      SELECT part, count(*) AS overlaps, max(pe) AS last_end FROM p WHERE "start" < pe GROUP BY part""",
    "window_capacity": f'WITH {_SPANS}, {_HALF} SELECT part, CAST(c AS BIGINT) AS context, CAST(sum(floor(("end" - "start") / c)) AS BIGINT) AS windows FROM merged, (SELECT unnest([1, 7, 30]) AS c) GROUP BY part, c',
    "overlapping_capacity": f'WITH {_SPANS}, {_HALF} SELECT part, CAST(c AS BIGINT) AS context, CAST(sum(greatest("end" - "start" - c + 1, 0)) AS BIGINT) AS windows FROM merged, (SELECT unnest([1, 7, 30]) AS c) GROUP BY part, c',
    "chunk_filter": """WITH c AS (SELECT doc_id, i AS chunk_start, translate(substr(text, i + 1, 1000), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS i FROM documents))
      SELECT doc_id, chunk_start, chunk_start + length(chunk) AS chunk_end, sha256(chunk) AS chunk_sha256 FROM c
      WHERE length(chunk) >= 300 AND length(regexp_replace(chunk, '[^ETAOINSHR]', '', 'g')) >= 0.5 * length(chunk)""",
    "bottom_scaled_sketch": f"WITH {_SETS} SELECT doc_id, len(items) AS hashes, array_to_string(items, ',') AS sketch FROM sets",
    "shingle_jaccard": f"""WITH {_WHOLE}, {_PAIRS} SELECT "left", "right", round(jaccard, 9) AS jaccard, CASE WHEN jaccard >= 0.95 THEN 'near_duplicate' ELSE 'related' END AS classification FROM pairs""",
    "near_dup_components": f"""WITH RECURSIVE {_WHOLE}, {_PAIRS}, links AS (SELECT "left" AS a, "right" AS b FROM pairs UNION SELECT "right", "left" FROM pairs),
      walk AS (SELECT doc_id AS a, doc_id AS b FROM heads UNION SELECT w.a, e.b FROM walk w JOIN links e ON w.b = e.a), comp AS (SELECT a, min(b) AS component FROM walk GROUP BY a),
      member AS (SELECT s.doc_id, coalesce(c.component, s.doc_id) AS component FROM sets s LEFT JOIN heads h ON s.items = h.items LEFT JOIN comp c ON h.doc_id = c.a)
      SELECT doc_id, component, count(*) OVER (PARTITION BY component) AS component_size FROM member""",
    "max_jaccard_per_row": f"""WITH {_WHOLE}, f AS (SELECT doc_id, len(items) AS n, unnest(items) AS x FROM sets),
      p AS (SELECT a.doc_id, a.n, b.doc_id AS o, b.n AS m, count(*) AS c FROM f a JOIN f b ON a.x = b.x AND a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0 GROUP BY ALL)
      SELECT s.doc_id, round(coalesce(max(CAST(c AS DOUBLE) / (n + m - c)), 0.0), 9) AS max_jaccard FROM sets s LEFT JOIN p USING (doc_id) WHERE s.doc_id % 50 = 0 GROUP BY s.doc_id""",
    "sampling_weights": """WITH c AS (SELECT c_custkey, c_nationkey AS nation, c_mktsegment, greatest(CAST(floor(c_acctbal) AS BIGINT), 1) AS size, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS near FROM customer),
      l AS (SELECT *, sqrt(size) / sqrt(greatest(near, c_custkey % 3 + 1)) AS loc FROM c WHERE nation > 2), g AS (SELECT nation, pow(sum(size), 0.3) AS mass, sum(loc) AS s FROM l GROUP BY nation)
      SELECT c.c_custkey, round(coalesce(mass / (SELECT sum(mass) FROM g) * loc / s, 0.0) * 1000, 9) AS weight_permille FROM c LEFT JOIN l ON c.c_custkey = l.c_custkey LEFT JOIN g ON l.nation = g.nation""",
    "inverse_weights": "SELECT c_custkey, round(1.0::DOUBLE / count(*) OVER (PARTITION BY c_nationkey, c_mktsegment), 12) AS weight FROM customer",
    "split_assign": "SELECT doc_id, CASE WHEN source IN ('src3', 'src7') THEN 'cold_genus_holdout' ELSE 'pretrain' END AS split FROM documents",
    "split_leakage": f"""WITH d AS ({_DIGEST}), s AS (SELECT digest, CASE WHEN source IN ('src3', 'src7') THEN 'cold_genus_holdout' ELSE 'pretrain' END AS split FROM d)
      SELECT digest, count(DISTINCT split) AS splits, count(*) AS "rows" FROM s GROUP BY digest HAVING count(DISTINCT split) > 1""",
    "lpt_shards": """WITH RECURSIVE s AS (SELECT s_suppkey, CAST(floor(abs(s_acctbal)) AS BIGINT) AS size, row_number() OVER (ORDER BY CAST(floor(abs(s_acctbal)) AS BIGINT) DESC, s_suppkey) AS n FROM supplier),
      f AS (SELECT 0::BIGINT AS n, [0, 0, 0, 0]::BIGINT[] AS loads, [0, 0, 0, 0]::BIGINT[] AS items
        UNION ALL SELECT s.n, list_transform(range(1, 5), lambda i: loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN size ELSE 0 END), list_transform(range(1, 5), lambda i: items[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN 1 ELSE 0 END) FROM f JOIN s ON s.n = f.n + 1),
      l AS (SELECT * FROM f ORDER BY n DESC LIMIT 1) SELECT CAST(i - 1 AS INTEGER) AS shard, items[i] AS items, loads[i] AS load FROM l, (SELECT unnest(range(1, 5)) AS i)""",
    "task_index": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS task_index FROM orders",
    "sequence_tokens": """WITH c AS (SELECT p_partkey, list_transform(list_filter(string_split(upper(p_name), ''), lambda x: x <> ''), lambda x: CASE WHEN instr('ACGTNRYSWKMBDHV', x) > 0 THEN instr('ACGTNRYSWKMBDHV', x) + 1 ELSE 6 END) AS t FROM part)
      SELECT p_partkey, array_to_string(t, ',') AS tokens, array_to_string(list_transform(list_reverse(t), lambda i: CASE WHEN i > 1 THEN instr('ACGTNRYSWKMBDHV', substr('TGCANYRSWMKVHDB', i - 1, 1)) + 1 ELSE i END), ',') AS reverse FROM c""",
    "record_quality": """WITH f AS (SELECT l.*, o_custkey, o_orderstatus = 'F' AS p FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
      c AS (SELECT o_custkey, sum(CASE WHEN p THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END) AS e, sum(CASE WHEN p AND l_returnflag = 'R' THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END) AS k,
        sum(CASE WHEN p AND l_discount > 0.08 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS v FROM f GROUP BY o_custkey),
      r AS (SELECT o_custkey, sum(CAST(floor(o_totalprice) AS BIGINT)) AS n, count_if(o_orderstatus = 'F') AS pc, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END) AS pb FROM orders GROUP BY o_custkey),
      j AS (SELECT r.*, coalesce(e, 0) AS e, coalesce(k, 0) AS k, coalesce(v, 0) AS v, round(pb / n, 12) AS nf, CASE WHEN pb > 0 THEN round(coalesce(e, 0) / pb, 12) ELSE 0 END AS ef,
        CASE WHEN coalesce(e, 0) > 0 THEN round(k / e, 12) ELSE 0 END AS kf, CASE WHEN pb > 0 THEN round(coalesce(v, 0) / pb, 12) ELSE 0 END AS vf FROM r LEFT JOIN c USING (o_custkey)),
      x AS (SELECT *, array_to_string(list_filter([CASE WHEN nf < 0.9 THEN 'LOW_NUCLEAR' END, CASE WHEN ef < 0.95 THEN 'LOW_EVALUATED' END, CASE WHEN kf > 0.005 THEN 'PROKARYOTIC' END, CASE WHEN vf > 0.0001 THEN 'VECTOR' END], lambda s: s IS NOT NULL), ';') AS reasons FROM j)
      SELECT o_custkey AS candidate_id, CAST(n AS BIGINT) AS base_count, CAST(pc AS BIGINT) AS primary_record_count, CAST(pb AS BIGINT) AS primary_bases, CAST(e AS BIGINT) AS primary_evaluated_bases, CAST(k AS BIGINT) AS primary_prokaryotic_bases,
        CAST(v AS BIGINT) AS primary_vector_bases, CAST(round(kf, 9) AS DOUBLE) AS prokaryotic_fraction, reasons, CASE WHEN reasons = '' THEN 'PASS' ELSE 'FAIL' END AS status FROM x""",
    "release_plan": f"""WITH {_GATED}, o AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY size DESC, doc_id DESC) AS r1 FROM gated WHERE len(reasons) = 0),
      m AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY size DESC, doc_id DESC) AS r2 FROM o WHERE r1 = 1), s AS (SELECT doc_id, lang, lang || ' ' || source AS species, size AS n, lang = 'es' AS held FROM m WHERE r2 = 1),
      c AS (SELECT *, n // 2 AS a, least(n // 2 + 64, n) AS b FROM s), z AS (SELECT *, a + n - b AS bases FROM c), g AS (SELECT species, pow(sum(bases), 0.3) AS mass, sum(sqrt(bases)) AS loc FROM z WHERE NOT held GROUP BY species)
      SELECT doc_id AS candidate_id, bases, a // 128 + (n - b) // 128 AS capacity_128, a // 1024 + (n - b) // 1024 AS capacity_1024, CASE WHEN held THEN 'cold_genus_holdout' ELSE 'pretrain' END AS split,
        round(CASE WHEN held THEN 0.0 ELSE mass / (SELECT sum(mass) FROM g) * sqrt(bases) / loc END * 1000, 9) AS weight_permille FROM z LEFT JOIN g USING (species)""",
    "unreferenced_stores": "SELECT c_custkey AS candidate_id, CAST(floor(abs(c_acctbal)) AS BIGINT) AS bytes FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "audit_totals": """WITH l AS (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id),
      a AS (SELECT sha256(text) AS g, n_chars AS c, CASE WHEN q = 1 THEN 'PASS' WHEN q = 0 THEN 'FAIL' ELSE 'MISSING' END AS status FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id),
      u AS (SELECT count(*) AS n, min(c) AS c FROM a WHERE status = 'PASS' GROUP BY g)
      SELECT count(*) AS candidate_count, count(*) FILTER (status = 'PASS') AS pass_count, count(*) FILTER (status = 'FAIL') AS fail_count, count(*) FILTER (status = 'MISSING') AS missing_count,
        CAST(coalesce(sum(c) FILTER (status = 'PASS'), 0) AS BIGINT) AS total_symbols, (SELECT count(*) FROM u) AS unique_count, (SELECT count(*) FROM u WHERE n > 1) AS duplicate_group_count,
        (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM u WHERE n > 1) AS duplicate_member_count, (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) FROM u) AS unique_symbols FROM a""",
    "feature_maps": """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
      SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS counts, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY user_id""",
    "taxa_compatibility": """WITH t AS (SELECT DISTINCT p_brand || '|' || p_size AS "group", string_split(p_type, ' ')[1] AS genus, p_type AS species, array_to_string(string_split(p_type, ' ')[1:2], ' ') AS two FROM part)
      SELECT "group", count(*) AS taxa, count(*) <= 1 OR (count(DISTINCT genus) = 1 AND count(DISTINCT two) = 1) AS compatible FROM t GROUP BY "group" """,
    "quality_rank_top": """SELECT c_nationkey, c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS base_count FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey
      ORDER BY c_custkey % 3 DESC, c_custkey % 7 DESC, c_custkey % 5, c_custkey % 2 DESC, c_custkey % 11 DESC, c_custkey % 4, floor(c_acctbal) DESC, c_custkey DESC) = 1""",
    "annotation_catalog": """SELECT 'file' AS source_kind, 's' || s_suppkey AS annotation_id, s_name AS relative_path, 'annotation' AS annotation_role, CAST(s_nationkey AS VARCHAR) AS gene_count, '.' AS member_name FROM supplier
      UNION ALL SELECT 'zip_member', 'c' || c_custkey, c_mktsegment, 'archive_gene_models', CAST(c_nationkey AS VARCHAR), c_name FROM customer""",
    "defaulted_join": """SELECT c_custkey, coalesce(CAST(o.n AS VARCHAR), '.') AS orders, coalesce(CAST(e.n AS VARCHAR), '.') AS errors FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey
      LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) e ON c_custkey = user_id""",
    "list_members": "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS member, l_orderkey FROM lineitem",
    "subset_check": """WITH a AS (SELECT DISTINCT user_id AS k FROM events), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
      SELECT CAST(k AS VARCHAR) AS key, 'not in whole' AS rule FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'all', 'not proper' WHERE NOT EXISTS (SELECT 1 FROM b WHERE k NOT IN (SELECT k FROM a))""",
    "queries_unseen": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "literature_keys": """WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN trim(lower(trim(url))) END AS doi, array_to_string(regexp_extract_all(lower(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')), '[a-z0-9_]+'), ' ') AS title,
        CASE WHEN page_id % 4 > 0 THEN CAST(2000 + page_id % 20 AS VARCHAR) ELSE '' END AS y FROM pages)
      SELECT page_id, CASE WHEN coalesce(doi, '') <> '' THEN 'doi|' || doi ELSE 'title|' || title || '|' || y END AS literature_key FROM p""",
    "date_texts": "SELECT o_orderkey, year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) AS date_text FROM orders",
    "similarity_summary": f"""WITH RECURSIVE {_WHOLE}, {_PAIRS}, links AS (SELECT "left" AS a, "right" AS b FROM pairs UNION SELECT "right", "left" FROM pairs),
      walk AS (SELECT doc_id AS a, doc_id AS b FROM heads UNION SELECT w.a, e.b FROM walk w JOIN links e ON w.b = e.a), comp AS (SELECT a, min(b) AS component FROM walk GROUP BY a),
      member AS (SELECT coalesce(c.component, s.doc_id) AS component FROM sets s LEFT JOIN heads h ON s.items = h.items LEFT JOIN comp c ON h.doc_id = c.a), g AS (SELECT component, count(*) AS n FROM member GROUP BY component HAVING count(*) > 1)
      SELECT (SELECT count(*) FROM documents) AS candidate_count, (SELECT CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) FROM documents) AS compared_pair_count, (SELECT count(*) FROM pairs) AS related_pair_count,
        (SELECT count(*) FROM pairs WHERE jaccard >= 0.95) AS near_duplicate_pair_count, count(*) AS group_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS group_member_count FROM g""",
    "kmer_sketch": f"""WITH r AS (SELECT doc_id, {_CODED} AS s FROM documents), c AS (SELECT doc_id, substr(s, 1000 * i + 1, 1030) AS s FROM (SELECT doc_id, s, unnest(range(length(s) // 1000 + 1)) AS i FROM r)),
      k AS (SELECT doc_id, substr(s, i, 31) AS x FROM (SELECT doc_id, s, unnest(range(1, length(s) - 29)) AS i FROM c)), h AS (SELECT DISTINCT doc_id, CAST('0x' || substr(md5(least(x, reverse(translate(x, 'ACGT', 'TGCA')))), 1, 15) AS BIGINT) AS h FROM k WHERE NOT contains(x, 'N'))
      SELECT d.doc_id, coalesce(string_agg(CAST(h AS VARCHAR), ',' ORDER BY h), '') AS sketch FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id AND h < 1152921504606846976 // 10000 GROUP BY d.doc_id""",
    "orientation_sets": f"""WITH s AS (SELECT source, {_CODED} AS f FROM documents), d AS (SELECT source, length(f) AS n, sha256(length(f) || ':' || least(sha256(f), sha256(reverse(translate(f, 'ACGT', 'TGCA'))))) AS d FROM s),
      x AS (SELECT source, n, CAST('0x' || substr(d, 1, 12) AS BIGINT) AS a, CAST('0x' || substr(d, 13, 12) AS BIGINT) AS b, CAST('0x' || substr(d, 25, 12) AS BIGINT) AS c, CAST('0x' || substr(d, 37, 12) AS BIGINT) AS e FROM d)
      SELECT source, sha256('orientation-multiset-' || sum(a) || '-' || sum(b) || '-' || sum(c) || '-' || sum(e)) AS signature, count(*) AS record_count, CAST(sum(n) AS BIGINT) AS total_symbols FROM x GROUP BY source""",
    "store_decode": f"""WITH w AS (SELECT coalesce(lang, 'und') AS source, string_agg(replace({_CODED}, 'N', 'A'), '' ORDER BY doc_id) AS s FROM documents GROUP BY 1),
      r AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 'en' WHEN 'R' THEN 'de' ELSE 'fr' END AS source, CAST(l_orderkey * 13 AS BIGINT) AS a, CAST(l_quantity AS BIGINT) * 20 AS n FROM lineitem),
      b AS (SELECT source, k, substr(s, k * 4096 + 1, 8192) AS s, length(s) AS whole FROM (SELECT source, s, unnest(range(length(s) // 4096 + 1)) AS k FROM w))
      SELECT l_orderkey, l_linenumber, r.source, CASE WHEN n > 0 AND a + n <= whole THEN md5(substr(b.s, CAST(a % 4096 + 1 AS BIGINT), n)) END AS bases_md5 FROM r LEFT JOIN b ON r.source = b.source AND b.k = a // 4096""",
    "callable_spans": f"""WITH d AS (SELECT coalesce(lang, 'und') AS source, doc_id AS record, {_CODED} AS s FROM documents),
      p AS (SELECT source, record, s, coalesce(sum(length(s)) OVER (PARTITION BY source ORDER BY record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM d),
      r AS (SELECT source, record, f, s, regexp_extract_all(s, '[ACGT]+') AS runs FROM p)
      SELECT source, record, CAST(len(runs) AS BIGINT) AS runs, CAST(list_sum(list_transform(runs, lambda x: length(x))) AS BIGINT) AS bases, list_max(list_transform(runs, lambda x: length(x))) AS longest, CAST(f + length(s) - length(ltrim(s, 'N')) AS BIGINT) AS first FROM r WHERE len(runs) > 0""",
    "sketch_candidates": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_custkey % 5 <> 0 AND floor(o_totalprice) > 0 AND o_orderkey % 100000 <= 0.2 * floor(o_totalprice)",
    "task_preparation": f"WITH {_GATED} SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS task_index FROM gated WHERE len(reasons) = 0",
    "receipt_check": """WITH s AS (SELECT s_name AS path, CAST(floor(s_acctbal) AS BIGINT) AS n, s_suppkey AS k FROM supplier), a AS (SELECT path, n FROM s WHERE k % 13 <> 0), b AS (SELECT path, n + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS n FROM s WHERE k % 7 <> 0)
      SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN b.path IS NULL THEN 'unexpected' ELSE 'changed' END AS rule FROM a FULL JOIN b ON a.path = b.path WHERE a.n IS DISTINCT FROM b.n""",
}
