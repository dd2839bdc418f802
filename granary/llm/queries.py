"""Registered queries of this subpackage: thin bindings of its operators to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, iso_media, language_id, language_model, license_rules, license_scan, mixing, quality, sharding, simhash, spelling, suffix_dedup, target_resampling, token_counts
from granary.sources.tables import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document stored as an ISO media file, read back and indexed."""
    return iso_media.text_media(table(spark, sf_dir, "documents"), "doc_id", "text")


#: Vocabulary for token counts; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact histogram of encoded lengths of all documents, with its running sums."""
    lengths = token_counts.token_lengths(table(spark, sf_dir, "documents"), "text", VOCABULARY)
    return token_counts.length_histogram(lengths)


#: Domains of a labelled document, and the shares of tokens that a mix aims at.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' WHEN quality = 1 THEN 'clean' END"
MIX = {"clean": 0.80, "low": 0.15, "toxic": 0.05}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posterior, token count and fitted rate of every document, and how the fit ended."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rated, domains, report = mixing.mix(docs, labels, "doc_id", "text", F.expr(DOMAIN), MIX)
    shares = [F.round(F.col("mix_posterior")[domains.index(d)] if d in domains else F.lit(0.0), 9).alias(f"p_{d}") for d in MIX]
    fit = [F.lit(report[0][c] if report else None).alias(f"fit_{c}") for c in ("steps", "rest", "met")]
    return rated.select("doc_id", F.col("mix_tokens").alias("n_tokens"), *shares, F.round("mix_rate", 6).alias("rate"), *fit)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that also start earlier."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of document and benchmark item whose alignment reaches two fifths of the item's own score."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of fingerprints at most 3 bits apart."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``key``."""
    return sharding.shard_slots(table(spark, sf_dir, "documents"), "doc_id", "text", 40)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and backoff-automaton scores of all documents, learned from nine tenths of them."""
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    scored = language_model.score(table(spark, sf_dir, "documents"), "doc_id", "text", train)
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents against those labelled good, and the Gumbel top-k draw."""
    labels = table(spark, sf_dir, "labels")
    return quality.resample(table(spark, sf_dir, "documents"), labels, "doc_id", "text", F.col("quality") == 1)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    left_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = docs.withColumn("held_out", F.coalesce(left_out, F.lit(False)))
    net = language_id.learn(docs, "doc_id", "text", "lang", ~F.col("held_out"))
    return language_id.predict(docs, "doc_id", "text", net, ("held_out",))


#: Phrases that the license scan counts in all their places.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and the labels that all signature rules find in every whole document."""
    return license_scan.labelled(table(spark, sf_dir, "documents"), "text", PHRASES, ("doc_id",))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their importance towards the benchmark's texts; a quarter of those of 20 words or more is drawn."""
    return target_resampling.resample(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, the form it is a variant of, and the root of that."""
    return spelling.variants(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_token_counts": op2_token_counts,
    "op3_mixing": op3_mixing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_language_model": op8_language_model,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
    "op11_license_scan": op11_license_scan,
    "op12_target_resampling": op12_target_resampling,
    "op13_spelling_variants": op13_spelling_variants,
}


def _crc_steps() -> str:
    """SQL list of the CRC-32 remainders of the 16 half bytes, from the polynomial."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return "[" + ", ".join(map(str, out)) + "]"


def _crc(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text: half bytes, low one first, are folded into the checksum."""
    halves = f"list_transform(range(2 * strlen({text})), lambda i: CAST(strpos('0123456789ABCDEF', substr(hex({text}), i + 2 - 2 * (i % 2), 1)) - 1 AS BIGINT))"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda c, v: xor(c >> 4, {_crc_steps()}[(xor(c, v) & 15) + 1])), 4294967295) END"


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

def _license_sql() -> str:
    """Every rule at every word near a gate word; a detection stays unless another one removes it."""
    known = [*license_scan.base_rules(PHRASES), *license_rules.rules()]
    rows = ", ".join(f"({i}, '{r.label}', {r.priority}, ' {r.gates[0]} ', ' {r.gates[-1]} ', ' {r.head} ', '^({r.pattern}) ', {r.base})" for i, r in enumerate(known))
    gates = ", ".join(f"'{g}'" for g in sorted({g for r in known for g in r.gates}))
    sure = " ".join(f"WHEN {p} THEN {x}::DOUBLE" for p, x in license_rules.SURE.items())
    return f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), rule(k, label, priority, g1, g2, head, pattern, base) AS (VALUES {rows}),
      hit AS (SELECT doc_id, unnest(list_filter(range(len(w)), lambda i: w[i + 1] IN ({gates}))) AS i FROM d),
      near AS (SELECT DISTINCT doc_id, unnest(range(greatest(0, i - {license_scan.REACH}), i + 1)) AS i FROM hit),
      x AS (SELECT near.doc_id, i, ' ' || array_to_string(w[i + 1 : i + 1 + {license_scan.REACH}], ' ') || ' ' AS t FROM near JOIN d ON near.doc_id = d.doc_id),
      f AS (SELECT doc_id, i AS a, i + len(string_split(regexp_extract(t[2:], pattern, 1), ' ')) AS b, k, label, priority, base FROM x JOIN rule
        ON contains(t, head) AND (contains(t, g1) OR contains(t, g2)) WHERE regexp_matches(t[2:], pattern)),
      gone AS (SELECT DISTINCT x.doc_id, x.a, x.k FROM f AS x JOIN f AS e ON x.doc_id = e.doc_id
        AND ((e.a <= x.a AND e.b >= x.b AND e.priority <= x.priority AND (e.a < x.a OR e.b > x.b OR e.priority < x.priority OR e.k < x.k)) OR (e.a < x.b AND e.b > x.a AND e.priority < x.priority))),
      s AS (SELECT f.* FROM f LEFT JOIN gone ON f.doc_id = gone.doc_id AND f.a = gone.a AND f.k = gone.k WHERE f.base OR gone.doc_id IS NULL),
      m AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS first_word, max(a) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, min(priority) AS p, count(*) AS n_detections FROM s GROUP BY doc_id)
      SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
        CASE p {sure} ELSE 0::DOUBLE END AS score, coalesce(n_detections, 0) AS n_detections FROM d LEFT JOIN m ON d.doc_id = m.doc_id"""


ORACLES: dict[str, str] = {
    "op11_license_scan": _license_sql(),
    # Words as positions of a list with a mark (one space, two spaces) at either end; counts of one to three words.
    "op8_language_model": f"""WITH d AS (SELECT doc_id, {_crc("CAST(doc_id AS VARCHAR)")} % 10 <> 0 AS train, list_concat(['  '], regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+'), [' ']) AS w FROM documents),
      t AS (SELECT doc_id, train, w[i] AS w, w[i - 1] AS p, CASE WHEN i > 2 THEN w[i - 2] END AS q FROM (SELECT doc_id, train, w, unnest(range(2, len(w) + 1)) AS i FROM d)),
      c1 AS (SELECT w, count(*) AS c1 FROM t WHERE train GROUP BY w), c2 AS (SELECT p, w, count(*) AS c2 FROM t WHERE train GROUP BY p, w),
      c3 AS (SELECT q, p, w, count(*) AS c3 FROM t WHERE train AND q IS NOT NULL GROUP BY q, p, w),
      n AS (SELECT coalesce(sum(c1), 0)::BIGINT AS n, count(*) AS v, (SELECT count(*) FROM d WHERE train) AS texts FROM c1),
      x AS (SELECT t.doc_id, coalesce(c1.c1, 0) AS c1, coalesce(c2.c2, 0) AS c2, coalesce(c3.c3, 0) AS c3, CASE WHEN t.p = '  ' THEN texts ELSE coalesce(l1.c1, 0) END AS l1, CASE WHEN t.q IS NULL THEN 0 ELSE coalesce(l2.c2, 0) END AS l2,
        (coalesce(c1.c1, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)) AS p1
        FROM t CROSS JOIN n LEFT JOIN c1 ON t.w = c1.w LEFT JOIN c2 ON t.p = c2.p AND t.w = c2.w LEFT JOIN c3 ON t.q = c3.q AND t.p = c3.p AND t.w = c3.w
        LEFT JOIN c1 AS l1 ON t.p = l1.w LEFT JOIN c2 AS l2 ON t.q = l2.p AND t.p = l2.w),
      y AS (SELECT *, CASE WHEN l1 > 0 THEN (c2 + 128 * p1) / (l1 + 128) ELSE p1 END AS p2 FROM x),
      z AS (SELECT *, CASE WHEN l2 > 0 THEN (c3 + 128 * p2) / (l2 + 128) ELSE p2 END AS p3 FROM y),
      s AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (c1 > 0) AS n_known, round(fsum(log10(p1)), 6) AS base_score, round(fsum(log10(p3)), 6) AS score FROM z GROUP BY doc_id)
      SELECT d.doc_id, NOT train AS held_out, n_tokens, n_known, n AS train_tokens, base_score, score FROM d JOIN s ON d.doc_id = s.doc_id CROSS JOIN n""",
    # Every feature as a string; the checksum of each distinct one.
    "op12_target_resampling": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
      df AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2]))) AS f FROM d),
      bf AS (SELECT unnest(list_concat(w, list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2]))) AS f FROM b),
      dn AS (SELECT doc_id, f, count(*) AS c FROM df GROUP BY doc_id, f), bn AS (SELECT f, count(*) AS c FROM bf GROUP BY f),
      x AS (SELECT f, {_crc("f")} % 10000 AS k FROM (SELECT f FROM dn UNION SELECT f FROM bn)),
      s AS (SELECT k, sum(c) AS s FROM dn JOIN x ON dn.f = x.f GROUP BY k), t AS (SELECT k, sum(c) AS t FROM bn JOIN x ON bn.f = x.f GROUP BY k),
      g AS (SELECT s.k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(c) FROM dn) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(c) FROM bn), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.k = t.k),
      m AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_features, CAST(floor(sum(c * gain)::DOUBLE / sum(c)::DOUBLE) AS BIGINT) AS weight FROM dn JOIN x ON dn.f = x.f JOIN g ON x.k = g.k GROUP BY doc_id),
      o AS (SELECT d.doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT)::DOUBLE AS h FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
      c AS (SELECT doc_id, n, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM o),
      r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM c WHERE n >= 20)
      SELECT c.doc_id, n_features, weight, score, CASE WHEN r <= 25 * (SELECT count(*) FROM r) // 100 THEN r END AS rank FROM c LEFT JOIN r ON c.doc_id = r.doc_id""",
    # Near words share what is left when one place is left out of both (replaced) or of the longer one (inserted).
    "op13_spelling_variants": f"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-z\u00C0-\u00FF]+')) AS r FROM documents),
      d AS (SELECT doc_id || ':' || r AS x, r, count(*) AS c FROM runs GROUP BY doc_id, r),
      h AS (SELECT r, c, {_crc("x")} AS h FROM d),
      v AS (SELECT CASE WHEN h % 97 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, CAST(sum(c) AS BIGINT) AS n FROM h GROUP BY 1 HAVING sum(c) >= 3 AND length(word) >= 5),
      e AS (SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
      p AS (SELECT DISTINCT e.word AS x, v.word AS y FROM e JOIN v ON e.a || e.b = v.word),
      near AS (SELECT x, y FROM p UNION SELECT y, x FROM p UNION SELECT e.word, f.word FROM e JOIN e AS f ON e.i = f.i AND e.a = f.a AND e.b = f.b AND e.word <> f.word),
      best AS (SELECT x, count(*) AS n_near, max(v.n) AS top FROM near JOIN v ON near.y = v.word GROUP BY x),
      lead AS (SELECT best.x, min(near.y) AS form FROM best JOIN near ON best.x = near.x JOIN v ON near.y = v.word AND v.n = best.top GROUP BY best.x),
      f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * v.n THEN form END AS form, CASE WHEN top >= 2 * v.n THEN top END AS form_n FROM v LEFT JOIN best ON v.word = best.x LEFT JOIN lead ON v.word = lead.x),
      chain AS (SELECT word, word AS last, 0 AS depth FROM f UNION ALL SELECT chain.word, f.form, depth + 1 FROM chain JOIN f ON chain.last = f.word WHERE f.form IS NOT NULL),
      roots AS (SELECT word, arg_max(last, depth) AS root FROM chain GROUP BY word)
      SELECT f.word, form, root, n, n_near, form_n FROM f JOIN roots ON f.word = roots.word""",
    # Every 100-byte string by the digest of its hex form; starts after the first of each are merged into spans.
    "op4_suffix_dedup": """WITH h AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
      w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS d FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM h WHERE n >= 100)),
      late AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY d ORDER BY doc_id, i) > 1),
      mark AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS head FROM late),
      runs AS (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM mark),
      spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
      gaps AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS f, a AS t FROM spans UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
      kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (coalesce(t, n) - f)), '' ORDER BY f, t NULLS LAST) AS k FROM gaps g JOIN h ON g.doc_id = h.doc_id GROUP BY g.doc_id),
      sums AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS r, count(*) AS s FROM spans GROUP BY doc_id)
      SELECT h.doc_id, n AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(s, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
      FROM h LEFT JOIN kept ON h.doc_id = kept.doc_id LEFT JOIN sums ON h.doc_id = sums.doc_id""",
    # Half bytes, low one first, are folded into the checksum; jumps are followed until past 41 shards.
    "op7_sharding": f"""WITH RECURSIVE h AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, string_split(hex(coalesce(text, '')), '') AS h FROM documents),
      n AS (SELECT doc_id, size, list_transform(range(len(h)), lambda i: CAST(strpos('0123456789ABCDEF', h[i + 2 - 2 * (i % 2)]) - 1 AS BIGINT)) AS x FROM h),
      c AS (SELECT doc_id, size, CASE WHEN size = 16 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda c, v: xor(c >> 4, {_crc_steps()}[(xor(c, v) & 15) + 1])), 4294967295) END AS crc FROM n),
      j AS (SELECT doc_id, CAST(doc_id AS HUGEINT) AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM (SELECT DISTINCT doc_id FROM documents)
        UNION ALL SELECT doc_id, (k * 2862933555777941757 + 1) % 18446744073709551616, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / (CAST(((k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 AS DOUBLE) + 1))) AS BIGINT) FROM j WHERE j < 41),
      s AS (SELECT doc_id, CAST(max(b) FILTER (b < 40) AS INTEGER) AS shard, CAST(max(b) AS INTEGER) AS grown FROM j GROUP BY doc_id)
      SELECT c.doc_id, size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY c.doc_id, size, crc) - 1 AS slot, grown AS grown_shard FROM c JOIN s ON c.doc_id = s.doc_id""",
}
