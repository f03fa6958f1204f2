"""The corpus queries opN_<name>, with the parameters that they run with, and their SQL."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession

from . import collocations, filter_audit, fingerprints, jaccard_join, license_texts, licenses, mixing, packing, pii, secrets, topk, toxicity, url_filter, warc

#: The rules of the URL query.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(table(spark, sf_dir, "embeddings"))


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_report(secrets.scan(table(spark, sf_dir, "documents")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def tokenizer_files() -> tuple[str]:
    """The file of the 50k byte-level BPE."""
    import public_tokenizers

    return (public_tokenizers.path("byte_bpe_50k.json"),)


def op10_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_files())


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(pii.scan(table(spark, sf_dir, "documents")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_kneser_ney_toxicity, op2_syncmer_fingerprints, op3_license_scan, op4_exact_topk, op5_warc_salvage, op6_url_filter, op7_source_mix, op8_secret_scan, op9_jaccard_join, op10_sequence_packing, op11_pii, op12_collocations, op13_filter_audit, pipeline)}


OP6_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule_host, rule_path, rule, action) AS (VALUES
  ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'),
  ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')),
fits AS (
  SELECT p.page_id, max_by(struct_pack(rule := r.rule, action := r.action), length(r.rule)) AS best
  FROM p JOIN r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.best.rule AS rule, coalesce(f.best.action, 'allow') AS verdict
FROM p LEFT JOIN fits f USING (page_id)
"""


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{licenses.COPYRIGHT_LINE}', chr(10), 'g')"
    for variant, kept in licenses.SPELLINGS:
        out = f"replace({out}, '{variant}', '{kept}')"
    return f"trim(regexp_replace({out}, '{licenses.NOT_WORDS}', ' ', 'g'))"


def _known_sql(texts, digests=()) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(texts))
    ready = "".join(f" UNION ALL SELECT {1_000_000 + i}, {quoted(name)}, {quoted(found)}" for i, (name, found) in enumerate(digests))
    return f"(SELECT digest, arg_min(name, n) AS name FROM (SELECT n, name, sha256({_canonical_sql('t')}) AS digest FROM (VALUES {rows}) AS x(n, name, t){ready}) GROUP BY 1)"


OP3_SQL = f"""
WITH d AS (SELECT doc_id, text, sha256({_canonical_sql("text")}) AS digest FROM documents),
k AS {_known_sql(licenses.titled(), license_texts.DIGESTS)}, n AS {_known_sql(license_texts.NOTICES)},
l AS (SELECT DISTINCT doc_id, sha256({_canonical_sql("line")}) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(lower(line), 'licen[cs]e|licensed|spdx')),
f AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM l JOIN n ON l.line = n.digest GROUP BY 1)
SELECT d.doc_id, d.digest, k.name AS license, coalesce(f.notices, '') AS notices FROM d LEFT JOIN k USING (digest) LEFT JOIN f USING (doc_id)
"""

OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
best AS (SELECT h, max(page_id) AS keeps FROM p GROUP BY 1)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(flatten(list_transform(range(8), lambda g: list_transform(range(4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(g AS INT) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * CAST(j AS INT))) & 31 AS INT) + 1, 1)))), '') AS payload_digest,
  CASE WHEN keeps IS NULL OR page_id IS NOT DISTINCT FROM keeps THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keeps THEN keeps END AS refers_to
FROM p JOIN best USING (h)
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || left(sha1(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level FROM w
  WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size + 1e-9) AS INT)) ELSE 0 END AS passes FROM t),
b AS (SELECT *, greatest(0.0::DOUBLE, target - passes * source_size) AS budget FROM p),
r AS (SELECT d.doc_id, d.size, b.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS held,
  count(*) FILTER (d.size > 0) OVER (PARTITION BY d.source, d.h) AS alike, row_number() OVER (PARTITION BY d.source, d.h) AS i
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE WHEN budget > 0 AND (upto <= budget OR (upto - held <= budget AND i <= floor((budget - (upto - held)) * alike / held + 0.5))) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON r.other = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1
"""


_CONFIRMED_SQL = {
    "email": "length(h[i])",
    "ip": f"CASE WHEN regexp_matches(h[i], '{pii.IP_PARTS}') THEN length(h[i]) ELSE 0 END",
    "card": """CASE WHEN length(regexp_replace(h[i], '[^0-9]', '', 'g')) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse(regexp_replace(h[i], '[^0-9]', '', 'g')), ''),
      lambda c, j: CASE WHEN j % 2 = 1 THEN CAST(c AS INT) ELSE CAST(c AS INT) * 2 - CASE WHEN CAST(c AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 THEN length(h[i]) ELSE 0 END""",
    "phone": "CASE WHEN length(regexp_replace(h[i], '[^0-9]', '', 'g')) BETWEEN 10 AND 15 THEN length(h[i]) ELSE 0 END",
    "iban": "CASE WHEN {0} THEN length(h[i]) WHEN contains(h[i], ' ') AND {1} THEN length(regexp_replace(h[i], ' [A-Z0-9]{{1,3}}$', '')) ELSE 0 END",
    "ssn": f"CASE WHEN regexp_matches(h[i], '{pii.NO_SSN}') THEN 0 ELSE length(h[i]) END",
}


def _mod97_sql(code: str) -> str:
    flat = f"replace({code}, ' ', '')"
    values = f"list_transform(string_split(substr({flat}, 5) || left({flat}, 4), ''), lambda c: ascii(c) - CASE WHEN c < 'A' THEN 48 ELSE 55 END)"
    return f"(length({flat}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, {values}), lambda r, v: (r * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97) = 1)"


def _kind_sql(kind: str) -> str:
    pattern = pii.PLAIN[kind].replace("'", "''")
    sure = _CONFIRMED_SQL[kind]
    if kind == "iban":
        sure = sure.format(_mod97_sql("h[i]"), _mod97_sql("regexp_replace(h[i], ' [A-Z0-9]{1,3}$', '')"))
    near = f"regexp_matches(translate(right(g[i], {pii.CONTEXT}) || chr(10) || left(g[i + 1], {pii.CONTEXT}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pii.WORDS[kind]}')"
    wanted = "" if kind in pii.BASE or pii.SCORES[kind] >= pii.LEAST else f" AND {near}"
    return f"""SELECT doc_id, row_id, '{kind}' AS kind, {pii.KINDS.index(kind)} AS k, s AS start, s + n AS stop FROM (
    SELECT doc_id, row_id, g, h, i, {sure} AS n,
      CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, row_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS h FROM d))) WHERE n > 0{wanted}"""


OP11_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_kind_sql(kind) for kind in pii.KINDS)}),
a AS (SELECT row_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in pii.BASE)},
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < {len(pii.BASE)}) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM f GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (row_id)
"""

OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY 1),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS gram, count(*) AS f FROM places, (VALUES (1), (2), (3), (4), (5)) s(size) WHERE i + size - 1 <= len(ws) GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT lang, gram, size, f AS a, string_split(gram, ' ') AS ws FROM g WHERE size > 1),
held AS (SELECT DISTINCT s.lang, s.gram FROM c s JOIN c b ON s.lang = b.lang AND b.size > s.size AND 100 * b.a >= 100 * s.a AND contains(' ' || b.gram || ' ', ' ' || s.gram || ' ')),
k AS (SELECT c.*, unnest(range(1, size)) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = c.lang AND h.gram = c.gram)),
x AS (SELECT k.lang, k.gram, k.a, k.k, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * k.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM k JOIN g l ON l.lang = k.lang AND l.gram = array_to_string(k.ws[1:k.k], ' ') JOIN g r ON r.lang = k.lang AND r.gram = array_to_string(k.ws[k.k + 1:], ' ') JOIN t ON t.lang = k.lang),
b AS (SELECT lang, gram, a, arg_min(struct_pack(l := l, r := r, n := n, score := score), struct_pack(s := score, k := k)) AS v FROM x GROUP BY 1, 2, 3)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY v.score DESC, a DESC, gram) AS rank, gram AS phrase, a, v.l AS l, v.r AS r, CAST(v.n AS BIGINT) AS n, CAST(v.score AS BIGINT) AS score FROM b QUALIFY rank <= 2000
"""

OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^ 	-
]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(
  CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END,
  CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END,
  CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails FROM w LEFT JOIN l USING (doc_id)),
o(filter_order) AS (VALUES {", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))}),
s AS (SELECT filter_order, step, left(filter_order, step - 1) AS before, substr(filter_order, step, 1) AS f FROM o, range(1, 6) r(step)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY 1, 2),
y AS (SELECT c.part, s.filter_order, s.step, s.f, CAST(coalesce(sum(n) FILTER (NOT hit AND NOT contains(fails, f)), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT hit AND contains(fails, f)), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (hit AND contains(fails, f)), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = f), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(g) FILTER (NOT hit AND contains(fails, f)), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(x) FILTER (NOT hit AND contains(fails, f)), 0) AS BIGINT) AS toxic_lost
  FROM (SELECT c.*, s.*, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND before <> '' AND fails <> '' AS hit FROM c, s) c JOIN s USING (filter_order, step, f) GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM y
"""


def oracle_sql():
    return {"op3_license_scan": OP3_SQL, "op4_exact_topk": OP4_SQL, "op5_warc_salvage": OP5_SQL, "op6_url_filter": OP6_SQL, "op7_source_mix": OP7_SQL, "op9_jaccard_join": OP9_SQL, "op11_pii": OP11_SQL, "op12_collocations": OP12_SQL, "op13_filter_audit": OP13_SQL}
