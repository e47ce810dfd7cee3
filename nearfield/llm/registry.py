"""The registered queries of this folder, with DuckDB SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import bpe, chat, exact, html, language, licenses, near, packing, topk, urls

#: The public vocabulary that the queries use; each operator takes any path.
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = bpe.decode(bpe.encode(documents, path).drop("text"), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return whole.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: A conversation whose texts hold the template's own strings.
CONFLICT_ID, CONFLICT_TEXT = -7, "</s>[INST] ok [/INST]"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(CONFLICT_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT_TEXT).alias("text"))
    done = chat.format_conversations(turns.unionByName(extra))
    return done.select("conv_id", "n_turns", F.sha2("turns_text", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)((?:/?s>)|(?:/?INST\]))', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)((?:/?s>)|(?:/?INST\]))', '\1\\\2\3', 'g')) AS chars FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + 20) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: Documents whose remainder is this are held out of what language identification learns from.
HELD_OUT = 1


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 3 == HELD_OUT


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.learn(documents.filter(~held_out()).select("doc_id", "text", "lang"))
    found = language.predict(documents.select("doc_id", "text"), model).drop("text")
    return found.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(documents, vocabulary()), documents.count())


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM texts JOIN firsts USING (t)
"""


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


OP7_SQL = r"""
WITH templates(id, name, text) AS (VALUES {templates}),
tw AS (SELECT id, name, list_filter(string_split_regex(lower(text), '[^\pL\pN]+'), lambda w: w <> '') AS w FROM templates),
tg AS (SELECT id, name, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM tw),
tn AS (SELECT id, name, len(g) AS size, CAST(floor(len(g) * 1.5::DOUBLE + 1e-9) AS BIGINT) AS high, CAST(ceil(len(g) / 1.5::DOUBLE - 1e-9) AS BIGINT) AS fewest FROM tg),
tc AS (SELECT id, gram, count(*) AS m FROM (SELECT id, unnest(g) AS gram FROM tg) GROUP BY ALL),
alike AS (SELECT a.id, b.id AS other FROM (SELECT x.id AS a, y.id AS b, sum(least(x.m, y.m)) AS c FROM tc x JOIN tc y USING (gram) GROUP BY ALL) p JOIN tn a ON a.id = p.a JOIN tn b ON b.id = p.b WHERE a.name <> b.name AND 2.0::DOUBLE * c / (a.size + b.size) >= 0.5),
told AS (SELECT alike.id, other, gram FROM alike JOIN tc USING (id) WHERE NOT EXISTS (SELECT 1 FROM tc o WHERE o.id = other AND o.gram = tc.gram)),
docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
dw AS (SELECT n, list_filter(string_split_regex(lower(text), '[^\pL\pN]+'), lambda w: w <> '') AS w FROM docs),
dg AS (SELECT n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram, unnest(range(1, len(w))) - 1 AS pos FROM dw),
hits AS (SELECT n, tc.id, pos, size, high, fewest FROM dg JOIN tc USING (gram) JOIN tn USING (id)),
runs AS (SELECT a.n, a.id, a.pos, a.size, a.high, a.fewest, count(*) FILTER (WHERE b.pos < a.pos + a.size) AS c1, max(b.pos) FILTER (WHERE b.pos < a.pos + a.size) AS e1, count(*) AS c2, max(b.pos) AS e2
  FROM hits a JOIN hits b ON a.n = b.n AND a.id = b.id AND b.pos >= a.pos AND b.pos < a.pos + a.high GROUP BY ALL HAVING count(*) >= a.fewest),
cand AS (SELECT n, id, pos, size, e1 - pos + 1 AS length, c1 AS c FROM runs UNION ALL SELECT n, id, pos, size, e2 - pos + 1, c2 FROM runs),
win AS (SELECT n, id, min({{'minus': -2.0::DOUBLE * c / (length + size), 'pos': pos, 'length': length}}) AS b FROM cand GROUP BY n, id),
inside AS (SELECT win.n, id, gram, count(*) AS k FROM win JOIN dg ON dg.n = win.n AND dg.pos >= b.pos AND dg.pos < b.pos + b.length WHERE b.minus <= -0.8 + 1e-12 GROUP BY ALL),
scored AS (SELECT n, id, 2.0::DOUBLE * sum(least(k, m)) / (any_value(b.length) + any_value(size)) AS dice, any_value(b.pos) AS pos FROM inside JOIN tc USING (id, gram) JOIN win USING (n, id) JOIN tn USING (id) GROUP BY n, id),
found AS (SELECT n, name, dice, pos FROM scored JOIN tn USING (id) WHERE dice >= 0.8 - 1e-12 AND NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT id, other FROM told) t WHERE t.id = scored.id AND NOT EXISTS (SELECT 1 FROM told JOIN inside USING (gram) WHERE told.id = t.id AND told.other = t.other AND inside.n = scored.n AND inside.id = scored.id))),
best AS (SELECT n, count(*) AS n_matches, max(dice) AS dice, min({{'d': -dice, 'name': name}}) AS b FROM found GROUP BY n)
SELECT doc_id, b.name AS license, coalesce(dice, 0.0) AS dice, coalesce(n_matches, 0) AS n_matches FROM docs LEFT JOIN best USING (n)
""".format(templates=", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(licenses.TEMPLATES)))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


OP9_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT n, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
urls AS (SELECT n, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
found AS (
  SELECT u.n, max({'size': length(r.host) + length(r.path), 'host_size': length(r.host), 'verdict': r.verdict, 'rule': r.host || r.path}) AS best
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.n
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM urls LEFT JOIN found USING (n)
"""


def op10_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe": op1_bpe, "op2_chat": op2_chat, "op3_topk": op3_topk, "op4_language": op4_language, "op5_packing": op5_packing, "op6_exact": op6_exact, "op7_licenses": op7_licenses, "op8_html": op8_html, "op9_urls": op9_urls, "op10_near": op10_near}
ORACLES = {"op2_chat": OP2_SQL, "op3_topk": OP3_SQL, "op6_exact": OP6_SQL, "op7_licenses": OP7_SQL, "op9_urls": OP9_SQL}
