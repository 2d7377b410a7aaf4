"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemscope.llm.common import read_table

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemscope.llm.ngram_jaccard import link_components

    return link_components(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


SQL_OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '{WORD}') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
  FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS t(i) WHERE len(ws) > 0),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y
  WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id, doc_id AS node FROM documents
  UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.node)
SELECT r.doc_id, coalesce(max(sz.n), 0)::BIGINT AS n_shingles, min(r.node) AS component_id
FROM reach r LEFT JOIN sz ON sz.doc_id = r.doc_id GROUP BY r.doc_id
"""

def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemscope.llm.suffix_dedup import remove_repeats

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("span_begin").cast("bigint").alias("n_spans"), "kept_sha256")


SQL_OP8 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (
  SELECT doc_id, s, md5(substr(x, 2 * s + 1, 800)) AS m
  FROM d, unnest(range(0, n - 399)) AS t(s) WHERE n >= 400),
dup AS (SELECT doc_id, s FROM win WHERE m IN (SELECT m FROM win GROUP BY m HAVING count(*) > 1)),
mark AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER w + 400 THEN 0 ELSE 1 END AS fresh
  FROM dup WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
isle AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM mark),
span AS (SELECT doc_id, k, min(s) AS b, max(s) + 400 AS e FROM isle GROUP BY 1, 2),
part AS (
  SELECT span.doc_id, k, substr(x, 2 * prev + 1, 2 * (b - prev)) AS piece, e - b AS gone
  FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS prev FROM span) span
  JOIN d USING (doc_id)),
agg AS (
  SELECT doc_id, count(*) AS n_spans, sum(gone) AS n_removed, string_agg(piece, '' ORDER BY k) AS head
  FROM part GROUP BY 1),
tail AS (SELECT doc_id, max(e) AS e FROM span GROUP BY 1)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN tail.doc_id IS NULL THEN x ELSE head || substr(x, 2 * tail.e + 1) END)) AS kept_sha256
FROM d LEFT JOIN agg USING (doc_id) LEFT JOIN tail USING (doc_id)
"""


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemscope.llm.lm_scoring import score_documents

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return score_documents(docs, train).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        "bits_per_byte")


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemscope.llm.bpe import encode_documents

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, digest=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemscope.llm.mixing import mix_sources

    return mix_sources(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


SQL_OP5 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS key, text FROM documents),
per AS (SELECT source, sum(size)::DOUBLE AS ss, 3 * sum(size)::DOUBLE AS full_, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i
        FROM d GROUP BY source),
w AS (SELECT *, (i % 3 + 1)::DOUBLE AS w FROM per),
lev AS (
  SELECT *, sum(ss) OVER () AS total,
         coalesce(sum(full_) OVER o, 0) AS below, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS left_
  FROM w WINDOW o AS (ORDER BY full_ / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
one AS (SELECT max((total - below) / left_) AS level FROM lev),
tgt AS (SELECT source, ss, least(full_, level * w) AS target FROM lev, one),
r AS (
  SELECT d.*, ss, target, CASE WHEN ss > 0 THEN target / ss ELSE 0.0 END AS rate,
         (('0x' || substr(md5('0:' || coalesce('s' || d.source, 'null')), 1, 8))::BIGINT)::DOUBLE / 4294967296.0 AS u,
         row_number() OVER (PARTITION BY d.source ORDER BY floor(ln(size + 1.0) * 6 + 0.0001), key, doc_id, size, text) AS k
  FROM d JOIN tgt ON d.source IS NOT DISTINCT FROM tgt.source)
SELECT doc_id, size, ss::BIGINT AS source_size, target,
       (least(floor(k * rate + u) - floor((k - 1) * rate + u), 3) * size)::BIGINT AS taken
FROM r
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemscope.llm.quality import judge_quality

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs, read_table(spark, sf_dir, "labels")).drop("text")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemscope.llm.url_filters import judge_urls

    return judge_urls(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


SQL_OP2 = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, coalesce(html, '') AS html,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages),
q AS (
  SELECT *, translate(regexp_extract(a, '^([^/?#]*)', 1), '{UPPER}', '{LOWERED}') AS host,
         regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(a, '^[^/?#]*([^#]*)', 1) AS rest,
         regexp_extract(url, '^(.*?)://', 1) AS scheme FROM p),
lk AS (
  SELECT host, path, scheme, CASE WHEN host <> '' THEN host || CASE WHEN rest = '' THEN '/' ELSE rest END END AS u,
         unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
                 regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS link
  FROM q),
lk2 AS (
  SELECT u, CASE WHEN strpos(link, '://') > 0 THEN substr(link, strpos(link, '://') + 3)
                 WHEN starts_with(link, '//') THEN substr(link, 3)
                 WHEN starts_with(link, '/') THEN host || link
                 ELSE host || CASE WHEN regexp_extract(path, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || link END AS b
  FROM lk WHERE link <> '' AND u IS NOT NULL),
ed AS (
  SELECT u, h || CASE WHEN r = '' THEN '/' ELSE r END AS v
  FROM (SELECT u, translate(regexp_extract(b, '^([^/?#]*)', 1), '{UPPER}', '{LOWERED}') AS h, regexp_extract(b, '^[^/?#]*([^#]*)', 1) AS r FROM lk2)
  WHERE h <> ''),
both_ways AS (SELECT u, v FROM ed UNION SELECT v, u FROM ed),
reach AS (SELECT u AS n, u AS m FROM both_ways UNION SELECT r.n, b.v FROM reach r JOIN both_ways b ON b.u = r.m),
rules(action, h, x) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
nodes AS (
  SELECT DISTINCT m AS n, regexp_extract(m, '^([^/?#]*)', 1) AS host, regexp_extract(m, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
said AS (SELECT n, arg_max(action, length(h || x)) AS action FROM nodes JOIN rules
         ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x) GROUP BY n),
grp AS (SELECT r.n, bool_or(s.action = 'allow') AS allowed FROM reach r JOIN said s ON s.n = r.m GROUP BY r.n),
own AS (SELECT host, path, arg_max(h || x, length(h || x)) AS rule, arg_max(action, length(h || x)) AS action
        FROM (SELECT DISTINCT host, path FROM q) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x) GROUP BY 1, 2)
SELECT q.page_id, coalesce(q.host, '') AS host, coalesce(q.path, '') AS path, own.rule,
       coalesce(own.action, CASE WHEN NOT grp.allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN own ON own.host = q.host AND own.path = q.path
LEFT JOIN grp ON q.host <> '' AND grp.n = q.host || CASE WHEN q.rest = '' THEN '/' ELSE q.rest END
"""


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemscope.llm.topk import quantise, top_k

    vectors = quantise(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


SQL_OP6 = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemscope.llm.licenses import scan_licenses

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "n_sentences", "sentences", "licenses")  # the columns of the SQL


def _sql_op9() -> str:
    from itemscope.llm.licenses import RULES, SENTENCES, normalise

    known = ", ".join(f"('{k}', '{normalise(s)}')" for k, s in SENTENCES.items())
    rules = ", ".join(f"({i}, '{f}', '{x}', ',{','.join(ids)},')" for i, (f, x, ids) in enumerate(RULES))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row,
                  ' ' || trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t
           FROM documents),
known(id, s) AS (VALUES {known}),
rules(i, family, licence, seq) AS (VALUES {rules}),
hit AS (SELECT row, id, strpos(t, s) AS p FROM d JOIN known ON contains(t, s)),
line AS (SELECT row, count(*) AS n, string_agg(id, ',' ORDER BY p, id) AS ids FROM hit GROUP BY row),
fit AS (SELECT row, family, min(i) AS i FROM line JOIN rules ON contains(',' || ids || ',', seq) GROUP BY 1, 2),
found AS (SELECT row, string_agg(licence, ',' ORDER BY fit.i) AS licenses FROM fit JOIN rules ON rules.i = fit.i GROUP BY row)
SELECT d.doc_id, coalesce(line.n, 0)::BIGINT AS n_sentences, coalesce(line.ids, '') AS sentences,
       coalesce(found.licenses, '') AS licenses
FROM d LEFT JOIN line USING (row) LEFT JOIN found USING (row)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemscope.llm.toxicity import score_toxicity

    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, read_table(spark, sf_dir, "labels"), train=remainder != 2)
    return scored.select("doc_id", (remainder == 2).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
                         "neighbours", "similarities")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemscope.llm.collocations import mine_phrases

    return mine_phrases(read_table(spark, sf_dir, "documents").select("lang", "text"))


def _sql_op11(min_count: int = 30, top: int = 2000) -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) AS phrase "
        f"FROM p WHERE len(ws) >= {k}" for k in (1, 2, 3, 4))
    inside = " UNION ALL ".join(f"SELECT lang, array_to_string(ws[{i}:{i + size - 1}], ' ') AS part, a FROM c WHERE k = {k}"
                                for k in (3, 4) for size in range(2, k) for i in range(1, k - size + 2))
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWERED}') AS t FROM documents),
s AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM s),
f AS (SELECT lang, k, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {min_count}),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
cut AS (SELECT c.*, unnest(range(1, k)) AS i FROM c),
sc AS (SELECT cut.lang, cut.phrase, a, i, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:i], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[i + 1:], ' ')),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
o AS (SELECT lang, part, max(a) AS covered FROM ({inside}) GROUP BY ALL),
r AS (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase)::INTEGER AS rank
  FROM best LEFT JOIN o ON o.lang = best.lang AND o.part = best.phrase WHERE covered IS NULL OR 100 * covered::HUGEINT < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= {top}
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemscope.llm.alignment import align_documents

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_documents(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemscope.llm.sharding import shard_documents

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return shard_documents(docs, keep=["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def _sql_op13(shards: int = 24, bits: int = 5) -> str:
    # one step of the curve (level, axis) is one CTE; xor and shifts as in the operator's docstring
    steps, prev = [], "lev"
    k = 0
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for w in "xyz":
            mine = "x" if w == "x" else w
            turn = f"xor(x, {low})"
            swap = f"xor(x, xor(x, {mine}) & {low})"
            sets = [f"CASE WHEN {mine} & {q} <> 0 THEN {turn} ELSE {swap} END AS x"]
            if w != "x":
                sets.append(f"CASE WHEN {w} & {q} <> 0 THEN {w} ELSE xor({w}, xor(x, {w}) & {low}) END AS {w}")
            k += 1
            steps.append(f"s{k} AS MATERIALIZED (SELECT * REPLACE ({', '.join(sets)}) FROM {prev})")
            prev = f"s{k}"
    flip = "0"
    for level in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN z & {1 << level} <> 0 THEN {(1 << level) - 1} ELSE 0 END)"
    place = " + ".join(f"((xor({w}, f) >> {level}) & 1) * {1 << (3 * level + 2 - i)}"
                       for level in range(bits) for i, w in enumerate("xyz"))
    chain = ",\n".join(steps)
    wide = 1 << bits
    return f"""
WITH d0 AS (
  SELECT doc_id, lang, source, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size
  FROM documents),
tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k:
          CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, lang, source, size, 8 * len(bin(size)) + (size >> (len(bin(size)) - 4)) - 8 AS k,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(x, '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d0, tab),
ln AS (SELECT lang, (row_number() OVER (ORDER BY lang NULLS FIRST) - 1) * {wide} // count(*) OVER () AS x FROM (SELECT DISTINCT lang FROM d)),
sn AS (SELECT source, (row_number() OVER (ORDER BY source NULLS FIRST) - 1) * {wide} // count(*) OVER () AS y FROM (SELECT DISTINCT source FROM d)),
kn AS (SELECT k, (coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {wide} // sum(n) OVER ())::BIGINT AS z
       FROM (SELECT k, count(*) AS n FROM d GROUP BY k)),
lev AS (SELECT DISTINCT x, y, z, x AS cx, y AS cy, z AS cz FROM (SELECT DISTINCT lang, source, k FROM d) c
        JOIN ln ON c.lang IS NOT DISTINCT FROM ln.lang JOIN sn ON c.source IS NOT DISTINCT FROM sn.source JOIN kn ON c.k = kn.k),
{chain},
gray AS (SELECT cx, cy, cz, x, xor(x, y) AS y, xor(xor(x, y), z) AS z FROM {prev}),
flip AS (SELECT *, {flip} AS f FROM gray),
cell AS (SELECT cx, cy, cz, {place} AS curve FROM flip),
r AS (
  SELECT d.*, curve, row_number() OVER (ORDER BY curve, size, text_crc32, doc_id NULLS FIRST) - 1 AS r, count(*) OVER () AS n
  FROM d JOIN ln ON d.lang IS NOT DISTINCT FROM ln.lang JOIN sn ON d.source IS NOT DISTINCT FROM sn.source JOIN kn ON d.k = kn.k
  JOIN cell ON cx = ln.x AND cy = sn.y AND cz = kn.z),
s AS (SELECT *, r * {shards} // n AS shard FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       (r - (shard * n + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s
"""


REGISTRY = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_url_filters": op2_url_filters,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_bpe_encode_decode": op4_bpe_encode_decode,
    "op5_mix_sources": op5_mix_sources,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_license_scans": op9_license_scans,
    "op10_toxicity": op10_toxicity,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_token_alignment": op12_token_alignment,
    "op13_sharding": op13_sharding,
}

SQL = {
    "op1_ngram_jaccard_join": SQL_OP1,
    "op2_url_filters": SQL_OP2,
    "op5_mix_sources": SQL_OP5,
    "op6_exact_top_k": SQL_OP6,
    "op8_suffix_array_dedup": SQL_OP8,
    "op9_license_scans": _sql_op9(),
    "op11_phrase_collocations": _sql_op11(),
    "op13_sharding": _sql_op13(),
}
