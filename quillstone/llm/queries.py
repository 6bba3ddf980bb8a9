"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import contamination, lines, manifest, mixing, pages, phrases, quality, repeats, secrets, simhash, topk, toxicity, urls
from quillstone.llm.common import table

#: Fixed by the query's contract.
URL_RULES = [
    ("com", "/en/", urls.BLOCK),
    ("example.com", "/en/7", urls.ALLOW),
    ("net", "/de/", urls.ALLOW),
    ("example.net", "/de/8", urls.BLOCK),
    ("org", "/es/", urls.BLOCK),
]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("kept_sha256"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = secrets.scan(versions)
    return secrets.digest(found)


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op10_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.checked(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_page_text": op2_page_text,
    "op3_line_dedup": op3_line_dedup,
    "op4_secret_ledger": op4_secret_ledger,
    "op5_mixture": op5_mixture,
    "op6_simhash": op6_simhash,
    "op7_repeats": op7_repeats,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_top_products": op10_top_products,
    "op11_phrases": op11_phrases,
    "op12_manifest": op12_manifest,
    "op13_toxicity": op13_toxicity,
}

_OP4_KINDS = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
]
_OP4_FOUND = " UNION ALL ".join(
    f"""SELECT doc_id, {i} AS k, '{kind}' AS kind, part[p] AS part, {least} AS least, length(hit[p]) AS n,
    list_sum(list_transform(rest[1:p], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:p - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT *, unnest(range(1, 1 + len(hit))) AS p
          FROM (SELECT doc_id, regexp_extract_all(text, '{rx}') AS hit, regexp_extract_all(text, '{rx}', {group}) AS part,
                       regexp_split_to_array(text, '{rx}') AS rest FROM d WHERE regexp_matches(text, '{rx}')))"""
    for i, (kind, rx, group, least) in enumerate(_OP4_KINDS)
)

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: CRC-32 of the decimal doc_id: for each character eight steps of the reversed polynomial.
_CRC32 = """xor(CAST(4294967295 AS BIGINT), list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda crc, x: list_reduce(CAST(range(8) AS BIGINT[]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END, xor(crc, x)), CAST(4294967295 AS BIGINT)))"""


def _merkle_levels(name: str, leaves: str, high: int) -> str:
    """CTEs name_0 to name_{high}: the nodes of each level with the text of their siblings before and after.

    A tree that has come to one node stays at it, so trees of any height up to `high` can be unrolled alike.
    """
    run = "PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN"
    out = []
    for k in range(high + 1):
        nodes = leaves
        if k:
            up = "CASE WHEN any_value(total) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END"
            nodes = f"SELECT tree, pos // 8 AS pos, (any_value(total) + 7) // 8 AS total, {up} AS d FROM {name}_{k - 1} GROUP BY tree, pos // 8"
        out.append(f"""{name}_{k} AS MATERIALIZED (SELECT *, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS e FROM ({nodes}))""")
    return ",\n".join(out)


def _merkle_sql(high: int = 6, over: int = 2) -> str:
    """SQL of op12 for trees of up to 8 ** high leaves and 8 ** over trees."""
    lower = _LOWER.format("text")
    framed = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(framed, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    steps = [f"t_{k}" for k in range(high)] + [f"f_{k}" for k in range(over)]
    joins = " ".join(f"JOIN t_{k} ON t_{k}.tree = r.tree AND t_{k}.pos = r.pos // {8**k}" for k in range(high))
    joins += f" JOIN s ON s.of = r.tree {' '.join(f'JOIN f_{k} ON f_{k}.pos = s.pos // {8**k}' for k in range(over))}"
    fold = "new"
    for t in steps:
        fold = f"CASE WHEN {t}.total = 1 THEN {fold} ELSE sha256({t}.b || ({fold}) || {t}.e) END"
    parts = " || ".join(f"{t}.b || {t}.e" for t in steps)
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS leaf, {leaf(lower)} AS lowered FROM documents),
r AS (SELECT doc_id, tree, leaf, CASE WHEN {_CRC32} % 3 = 0 THEN lowered ELSE leaf END AS new, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY tree) AS total FROM d),
{_merkle_levels("t", "SELECT tree, pos, total, leaf AS d FROM r", high)},
s AS (SELECT tree AS of, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS total, d FROM t_{high}),
{_merkle_levels("f", "SELECT '' AS tree, pos, total, d FROM s", over)}
SELECT r.doc_id, r.leaf, s.d AS subroot, f_{over}.d AS root, sha256({parts}) AS proof_sha256, {fold} AS folded_root, {fold} = f_{over}.d AS verified
FROM r {joins} JOIN f_{over} ON true"""


#: The SQL of op2 holds for pages of the kind in the tables: one article of headings and paragraphs, few character references.
ORACLES = {
    "op2_page_text": r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS x FROM pages),
t AS (SELECT page_id, url, list_transform(x, lambda s: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s,
        '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS x FROM a),
j AS (SELECT page_id, url, array_to_string(list_filter(x, lambda s: s <> ''), chr(10)) AS text FROM t)
SELECT page_id, url, text, length(text) AS n_chars FROM j""",
    "op3_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, i, x[i] AS line FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM d)),
f AS (SELECT line, doc_id, i, row_number() OVER (ORDER BY doc_id, i) AS place FROM
      (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS n FROM l WHERE length(line) >= 20) WHERE n = 1),
k AS (SELECT DISTINCT line, side, h, CASE side WHEN 0 THEN substr(line, 1, h) ELSE substr(line, length(line) - h + 1) END AS half
      FROM (SELECT line, unnest([length(line) // 2, (length(line) - 1) // 2]) AS h FROM f), (VALUES (0), (1)) AS s(side)),
c AS (SELECT * FROM f WHERE line IN (SELECT line FROM k JOIN (SELECT side, h, half FROM k GROUP BY ALL HAVING count(*) > 1) USING (side, h, half))),
v AS (SELECT line, place, p, substr(line, 1, p - 1) || substr(line, p + 1) AS short FROM (SELECT *, unnest(range(1, length(line) + 1)) AS p FROM c)),
near AS (SELECT a.line FROM v a JOIN v b ON a.short = b.short AND a.p = b.p AND b.place < a.place
         UNION SELECT CASE WHEN a.place < b.place THEN b.line ELSE a.line END FROM v a JOIN c b ON a.short = b.line),
o AS (SELECT l.doc_id, l.i, l.line, length(l.line) < 20 OR (f.doc_id = l.doc_id AND f.i = l.i AND l.line NOT IN (SELECT line FROM near)) AS kept FROM l LEFT JOIN f USING (line)),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (kept) AS k, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (kept), '') AS text FROM o GROUP BY doc_id)
SELECT doc_id, CAST(n AS INTEGER) AS n_lines, CAST(n - k AS INTEGER) AS n_removed, length(text) AS n_chars, sha256(text) AS kept_sha256 FROM t""",
    "op4_secret_ledger": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({_OP4_FOUND}),
s AS (SELECT doc_id, k, kind, CAST(start AS BIGINT) AS start,
             kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS span
      FROM raw WHERE length(part) >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)""",
    "op7_repeats": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
g AS (SELECT doc_id, i, x[i + 1:i + 50] AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
h AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM g JOIN m USING (s) WHERE least < doc_id),
p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h) GROUP BY doc_id, run),
c AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY a)
      UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id),
k AS (SELECT doc_id, unhex(string_agg(hex(x[a + 1:b]), '' ORDER BY a)) AS kept FROM c JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, n - octet_length(kept) AS n_removed, (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id) AS n_spans, sha256(kept) AS kept_sha256 FROM d JOIN k USING (doc_id)""",
    "op8_decontamination": r"""
WITH w AS (SELECT 'd' AS t, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
           UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (SELECT DISTINCT t, id, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT t, id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
n AS (SELECT id, count(*) AS size FROM s WHERE t = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, CAST(count(*) AS INTEGER) AS hits, CAST(any_value(size) AS INTEGER) AS size,
       round(count(*) / any_value(size), 6) AS containment
FROM s d JOIN s b ON d.s = b.s AND d.t = 'd' AND b.t = 'b' JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(size) - 1e-9""",
    "op9_url_filter": r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id,
        translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, q, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                      ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(q) DESC) AS k
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, host, path, m.rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND k = 1""",
    "op10_top_products": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op11_phrases": f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS x FROM documents),
w AS (SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, w[i:i + size - 1] AS p, count(*) AS f
      FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS s(size) WHERE len(w) >= size) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, p, f AS a, size, unnest(range(1, size)) AS k FROM g WHERE size >= 2),
s AS (SELECT c.lang, c.p, c.a, c.size, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score,
        row_number() OVER (PARTITION BY c.lang, c.p ORDER BY CAST(2000000 AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) + y.f), k) AS best
      FROM c JOIN g x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN g y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
o AS (SELECT lang, q, max(f) AS f FROM (SELECT lang, f, size, p[i:i + m - 1] AS q FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM g, (VALUES (2), (3)) AS v(m) WHERE m < size)) GROUP BY lang, q),
k AS (SELECT s.lang, array_to_string(s.p, ' ') AS phrase, a, l, r, score FROM s LEFT JOIN o ON o.lang = s.lang AND o.q = s.p
      WHERE best = 1 AND NOT coalesce(CAST(100 AS HUGEINT) * o.f >= CAST(80 AS HUGEINT) * a, false)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN t USING (lang) WHERE rank <= 2000""",
    "op12_manifest": _merkle_sql(),
}
