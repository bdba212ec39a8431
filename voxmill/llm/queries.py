"""The registered queries of this subpackage and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import chat, decontaminate, hardneg, jaccard, mixing, naming, pieces, secrets, sharding, substrings, tokens, toxicity, whitening
from voxmill.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w,
             source_size * 3.0::DOUBLE AS full_at, row_number() OVER (ORDER BY source ASC NULLS LAST) AS src FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE
                 - coalesce(sum(full_at) OVER (ORDER BY full_at / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY full_at / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n),
c AS (SELECT (SELECT level FROM l WHERE NOT level * w > full_at ORDER BY full_at / w, src LIMIT 1) AS common),
t AS (SELECT source, source_size, CASE WHEN level * w > full_at THEN full_at ELSE common * w END AS target FROM l, c),
p AS (SELECT d.*, t.source_size, t.target, round(t.target)::BIGINT AS stop FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT p.*, g.pass FROM p, (SELECT unnest([0, 1, 2, 3]) AS pass) g WHERE g.pass * source_size < stop AND size > 0),
o AS (SELECT *, pass * source_size + coalesce(sum(size) OVER (PARTITION BY source, pass ORDER BY md5('mix|' || pass || '|' || doc_id), doc_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e),
k AS (SELECT doc_id, sum(greatest(least(pos + size, stop) - pos, 0))::BIGINT AS taken FROM o GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(k.taken, 0)::BIGINT AS taken FROM p LEFT JOIN k ON p.doc_id = k.doc_id
"""


@query("op1_mixing", OP1_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, rows = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(pieces, rows)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""


@query("op6_exact_dedup", OP6_SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_dedup(table(spark, sf_dir, "documents"))


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.even_tree(16))


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(replace(role || text, chr(92), '##'), '<', '##'), '[', '##'), ']', '##')) + 10 AS shown,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth,
             count(*) OVER (PARTITION BY conv_id) AS n FROM c),
x AS (SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY nth) AS chars FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) FILTER (role = 'assistant' OR nth = n))::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""


@query("op7_chat_formatting", OP7_SQL)
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], turns.schema))
    path = scratch_path(spark, "examples")
    chat.write_examples(turns, path)
    return chat.digest(chat.read_examples(spark, path))


def _op10_kind(kind: int, pattern: str, group: int) -> str:
    """Matches of one kind with the text before each, from which their places follow."""
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""
SELECT doc_id, repo, owner, {kind} AS kind, i, ps[i] AS gap, ms[i] AS m, vs[i] AS value FROM (
  SELECT doc_id, repo, owner, string_split_regex(t, {quoted}) AS ps, regexp_extract_all(t, {quoted}, 0) AS ms,
         regexp_extract_all(t, {quoted}, {group}) AS vs FROM d WHERE regexp_matches(t, {quoted})), unnest(range(1, len(ms) + 1)) AS u(i)"""


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') AS repo, source AS owner, coalesce(text, '') AS t FROM documents),
m AS ({_op10_kind(0, secrets.ASSIGN, 2)} UNION ALL {_op10_kind(1, secrets.ACCESS, 0)}
  UNION ALL {_op10_kind(2, secrets.HEX, 0)} UNION ALL {_op10_kind(3, secrets.BARE, 0)}),
p AS (SELECT doc_id, repo, owner, kind, value, length(m) AS n,
             sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo
      FROM m WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
s AS (SELECT doc_id, repo, owner, kind, value, lo::BIGINT AS lo, (lo + n)::BIGINT AS hi FROM p WHERE kind <> 0 OR length(value) >= 6),
b AS (SELECT * FROM s WHERE kind < 3),
c AS (SELECT * FROM b UNION ALL SELECT * FROM s WHERE kind = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
      AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = s.doc_id AND b.lo < s.hi AND s.lo < b.hi)),
f AS (SELECT value, count(DISTINCT coalesce('=' || owner, '')) AS n_owners, count(DISTINCT repo) AS n_repos FROM c GROUP BY value),
r AS (SELECT c.*, n_owners, n_repos, n_owners <= 2 AND n_repos <= 4 AND len(list_distinct(string_split(value, ''))) >= 10 AS live,
             list_extract(['assign', 'access', 'hex', 'owned'], kind + 1) || ':' || lo || ':' || hi AS shown FROM c JOIN f USING (value)),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
             count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied, max(n_owners) AS most_owners, max(n_repos) AS most_repos,
             coalesce(string_agg(shown, ',' ORDER BY lo, kind) FILTER (kind < 3), '') AS base,
             string_agg(shown, ',' ORDER BY lo, kind) FILTER (kind < 3 OR live) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live,
       coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(most_owners, 0)::BIGINT AS most_owners, coalesce(most_repos, 0)::BIGINT AS most_repos
FROM d LEFT JOIN g USING (doc_id)
"""


@query("op10_secret_scan", OP10_SQL)
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents"))[1])


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    folder = scratch_path(spark, "tokens")
    manifest = tokens.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return tokens.read_tokens(manifest)


OP8_SQL = r"""
WITH lowered AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM lowered WHERE t IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
li AS (SELECT greatest(max(len(w)), 5) AS step FROM iw),
ip AS (SELECT item_id, 'q' AS part, w[1:greatest(len(w) - len(w) // 4, least(10, len(w)))] AS w FROM iw WHERE len(w) > 0
       UNION ALL SELECT item_id, 'a', w[len(w) - greatest(len(w) // 4, least(10, len(w))) + 1:] FROM iw WHERE len(w) > 0
       UNION ALL SELECT item_id, 'w', w FROM iw WHERE len(w) > 0),
ish AS (SELECT DISTINCT item_id, part, array_to_string(w[i:i + 4], ' ') AS s FROM ip, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i)),
n AS (SELECT item_id, part, count(*) AS n FROM ish GROUP BY ALL),
widths AS (SELECT DISTINCT least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
dsh AS (SELECT doc_id, len(w) AS words, i - 1 AS pos, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM dw, widths, unnest(range(1, len(w) - k + 2)) AS u(i) WHERE len(w) >= k),
m AS (SELECT DISTINCT doc_id, item_id, part, dsh.s, pos, words, k FROM dsh JOIN ish ON dsh.s = ish.s),
p AS (SELECT DISTINCT doc_id, item_id, part, s, least(pos // step, greatest(1, -(-greatest(words - step, 0) // step)) - 1) AS passage FROM m, li
      UNION SELECT DISTINCT doc_id, item_id, part, s, pos // step - 1 FROM m, li WHERE pos // step >= 1 AND pos + k <= (pos // step + 1) * step),
c AS (SELECT doc_id, item_id, part, passage, count(*) AS k FROM p GROUP BY ALL),
g AS (SELECT doc_id, item_id, passage FROM c JOIN n USING (item_id, part) WHERE k >= 0.8 * n - 1e-9 GROUP BY ALL
      HAVING count(*) FILTER (part <> 'w') = 2 OR count(*) FILTER (part = 'w') = 1),
r AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS ids FROM g GROUP BY doc_id)
SELECT d.doc_id, r.ids IS NOT NULL AS contaminated, coalesce(len(r.ids), 0)::BIGINT AS n_items, coalesce(array_to_string(r.ids, ','), '') AS item_ids
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""


@query("op8_decontamination", OP8_SQL)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ","))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM w, unnest(range(1, len(w) - 33)) AS u(i)),
r AS (SELECT s FROM x GROUP BY s HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, j FROM x JOIN r USING (s), unnest(range(i, i + 35)) AS u(j)),
p AS (SELECT doc_id, j, w[j] AS word FROM w, unnest(range(1, len(w) + 1)) AS u(j)),
k AS (SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p.j) AS kept FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.j = c.j GROUP BY p.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n_kept, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""


@query("op4_substring_dedup", OP4_SQL)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP3_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
           FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM t, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM m JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
g AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, g.y FROM r JOIN g ON r.y = g.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(r.y), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON d.doc_id = r.x GROUP BY d.doc_id, n.n
"""


@query("op3_ngram_jaccard_join", OP3_SQL)
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op13_sentencepiece")
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    rows = pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    # the last span of a text ends with it
    n_bytes = F.when(F.size("ids") > 0, F.element_at("ends", -1)).otherwise(0).cast("bigint")
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), n_bytes.alias("n_bytes"))


OP11_SQL = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, e.vec_id, e.label, list_dot_product(a.q, e.q)::BIGINT AS score
      FROM e a JOIN e ON a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own AND vec_id <> anchor_id
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND label <> own AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


@query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    rows = hardneg.quantised(rows, 256)
    return hardneg.mine(rows, rows.filter(F.col("vec_id") % 100 == 0))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
