"""The queries of this subpackage: opN_<name> over whole tables, and their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, exact_dedup, language_id, mixing, mpeg_audio, ngram_join, secrets, sentence_dedup, suffix_dedup, token_codes
from millrace.workspace import prepare, stored, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(prepare(spark), sf_dir, "documents")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = language_id.held_out()
    model = language_id.fit(docs.where(~held))
    return language_id.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(mpeg_audio.store(_documents(spark, sf_dir)), "media")
    return mpeg_audio.features(media)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(_documents(spark, sf_dir))


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _documents(spark, sf_dir)
    return token_codes.read_tokens(token_codes.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), token_codes.token_folder(docs)))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_dedup.deduplicate(_documents(spark, sf_dir))
    return found.select("doc_id", "n_sentences", "n_removed", "n_shared", F.sha2("text", 256).alias("kept_sha256"))


def byte_bpe_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

    decoded = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path, pattern)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(_documents(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE_RULES]))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("_digest").alias("text_sha256"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(_documents(spark, sf_dir), most_repeats=MOST_REPEATS, seed=MIX_SEED)
    return plan.select("doc_id", "source", "tokens", "weight", "block", "copies", F.round("mix_position", 9).alias("mix_position"))


MOST_REPEATS, MIX_SEED = 2.0, 7


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_mpeg_audio": op2_mpeg_audio,
        "op3_ngram_join": op3_ngram_join,
        "op4_token_codes": op4_token_codes,
        "op5_sentence_spans": op5_sentence_spans,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_secrets": op7_secrets,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_suffix_array": op9_suffix_array,
        "op10_mixing": op10_mixing,
    }


OP5_SQL = r"""
WITH p AS (
  SELECT doc_id, list_filter(regexp_extract_all(text, '[^.!?,;:\n]*(?:[.!?,;:]+|\n|\z)[ \t\r\n]*'), lambda x: x <> '') AS pieces FROM documents),
t AS (SELECT doc_id, pieces, list_transform(pieces, lambda x: trim(regexp_replace(x, '[ \t\r\n]+', ' ', 'g'), ' ')) AS plain FROM p),
s AS (SELECT doc_id, unnest(plain) AS t, unnest(pieces) AS piece, generate_subscripts(plain, 1) AS i FROM t),
n AS (
  SELECT doc_id, i, piece, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS words,
         sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM s),
u AS (SELECT doc_id, upto, min(i) AS i FROM n GROUP BY doc_id, upto),
e AS (SELECT n.doc_id, n.i, greatest(u.i, n.i + 1) AS last FROM n ASOF JOIN u ON n.doc_id = u.doc_id AND n.upto - n.words + 16 <= u.upto),
r AS (SELECT e.doc_id, e.i, last, array_to_string(plain[e.i:last], chr(1)) AS run FROM e JOIN t USING (doc_id) WHERE last <= len(plain)),
l AS (SELECT doc_id, i, last, first_value(doc_id) OVER w AS first_doc, row_number() OVER w AS k FROM r WINDOW w AS (PARTITION BY run ORDER BY doc_id, i)),
g AS (SELECT doc_id, unnest(range(i, last + 1)) AS i, doc_id <> first_doc AS shared FROM l WHERE k > 1),
h AS (SELECT doc_id, i, bool_or(shared) AS shared FROM g GROUP BY doc_id, i),
m AS (SELECT n.doc_id, n.i, n.piece, h.i IS NOT NULL AS gone, coalesce(shared, false) AS shared FROM n LEFT JOIN h ON n.doc_id = h.doc_id AND n.i = h.i),
c AS (
  SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (gone) AS n_removed, count(*) FILTER (shared) AS n_shared,
         coalesce(string_agg(piece, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(n_shared, 0) AS n_shared, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN c USING (doc_id)
"""

def _marked(pattern: str, kind: str, kept: str) -> str:
    """doc_id, kind, start, end of the matches of a pattern: each is marked, and the text is cut at the marks."""
    return f"""
SELECT doc_id, '{kind}' AS kind, pos AS "start", pos + length(m) AS "end" FROM (
  SELECT doc_id, m, coalesce(sum(length(m) + length(rest)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, i FROM (
    SELECT doc_id, i, CASE WHEN i = 1 THEN '' ELSE split_part(piece, chr(57345), 1) END AS m, CASE WHEN i = 1 THEN piece ELSE split_part(piece, chr(57345), 2) END AS rest FROM (
      SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
        SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '({pattern})', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)) AS p FROM documents))))
WHERE i > 1 AND {kept}"""


def _either_case(pattern: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


_ASSIGN = "(?:" + _either_case("password|passwd|secret|token|api") + "_?" + _either_case("key") + r""")["'']?\x20*[:=]\x20*["'']?"""
_VALUE = "[A-Za-z0-9+/_.=-]+"

OP7_SQL = f"""
WITH s AS ({_marked(_ASSIGN + _VALUE, "assign", f"length(regexp_extract(m, '^{_ASSIGN}({_VALUE})', 1)) >= 12")}
UNION ALL {_marked("AKIA[A-Z0-9]+", "access", "length(m) >= 18")}
UNION ALL {_marked("[0-9a-f]+", "hex", "length(m) >= 16")}
UNION ALL {_marked("-----BEGIN [A-Z ]*PRIVATE KEY-----", "private_key", "true")}
UNION ALL {_marked(r"Bearer\x20+[A-Za-z0-9._~+/-]+", "bearer", r"length(regexp_extract(m, '^Bearer\x20+([A-Za-z0-9._~+/-]+)', 1)) >= 20")}),
o AS (SELECT *, kind || ':' || "start" || ':' || "end" AS span, list_position(['assign', 'access', 'hex', 'private_key', 'bearer'], kind) AS place FROM s),
c AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY "start", place) FILTER (place <= 3) AS base, string_agg(span, ',' ORDER BY "start", place) AS spans FROM o GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN c ON d.doc_id IS NOT DISTINCT FROM c.doc_id
"""

#: All strings of 400 bytes, in hexadecimal digits.
OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS p FROM d WHERE n >= 400)),
r AS (SELECT doc_id, p FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
i AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 400, true) AS fresh FROM r),
j AS (SELECT doc_id, p, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM i),
s AS (SELECT doc_id, island, min(p) AS b, max(p) + 400 AS e FROM j GROUP BY doc_id, island),
g AS (SELECT s.doc_id, island, b, e, substr(h, 2 * coalesce(lag(e) OVER q, 0) + 1, 2 * (b - coalesce(lag(e) OVER q, 0))) AS before, lead(b) OVER q IS NULL AS last, substr(h, 2 * e + 1) AS after
      FROM s JOIN d USING (doc_id) WINDOW q AS (PARTITION BY s.doc_id ORDER BY island)),
c AS (SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(before || CASE WHEN last THEN after ELSE '' END, '' ORDER BY island) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)
"""

#: Every pair of documents that share an n-gram, and the smallest id that is reached over links.
OP3_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS grams FROM t),
e AS MATERIALIZED (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p WHERE common >= 0.8 * (na + nb - common) - 1e-9),
c(doc_id, reached) AS (SELECT a, b FROM l UNION SELECT c.doc_id, l.b FROM c JOIN l ON c.reached = l.a),
k AS (SELECT doc_id, min(reached) AS reached FROM c GROUP BY doc_id),
n AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT g.doc_id, least(g.doc_id, coalesce(reached, g.doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, len(grams)::BIGINT AS n_ngrams
FROM g LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

#: The exponent that the bisection finds for a repetition limit has a closed form.
OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '{mixing.NO_SOURCE}') AS source,
         coalesce(len(regexp_extract_all(text, '[^ \t\r\n]+')), 0)::BIGINT AS tokens,
         md5('{MIX_SEED}|' || coalesce(source, '{mixing.NO_SOURCE}') || '|' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS t, count(*) AS n FROM d GROUP BY source),
e AS (SELECT ceil(round(greatest(0, 1 - ln({MOST_REPEATS}) / nullif(ln(max(t)::DOUBLE / min(t) FILTER (t > 0)), 0)) * 1e6, 3)) / 1e6 AS a, max(t) AS largest FROM s),
b AS (SELECT source, t, n, CASE WHEN t > 0 THEN least(floor({MOST_REPEATS} * t), floor(pow(largest::DOUBLE / t, 1 - coalesce(a, 0)) * t + 0.5))::BIGINT ELSE 0 END AS budget FROM s, e),
w AS (
  SELECT source, budget, CASE WHEN t > 0 THEN budget // t ELSE 1 END AS passes, CASE WHEN t > 0 THEN budget % t ELSE 0 END AS rest,
         round(budget / sum(budget) OVER (), 6) AS weight, least({mixing.MOST_BLOCKS}, (n + {mixing.BLOCK} - 1) // {mixing.BLOCK}) AS blocks FROM b),
p AS (SELECT d.*, budget, passes, rest, weight, ('0x' || substr(place, 1, 8))::BIGINT % blocks AS block FROM d JOIN w USING (source)),
i AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, block ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM p),
k AS (SELECT source, block, sum(tokens) AS block_tokens FROM p GROUP BY source, block),
o AS (
  SELECT source, block, coalesce(sum(block_tokens) OVER (PARTITION BY source ORDER BY md5('{MIX_SEED}|block|' || source || '|' || block::VARCHAR), block
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, source, tokens, weight, block::BIGINT AS block, (passes + CASE WHEN before + inside < rest THEN 1 ELSE 0 END)::BIGINT AS copies,
       round(CASE WHEN budget > 0 THEN (before + inside)::DOUBLE / budget ELSE 0 END, 9) AS mix_position
FROM i JOIN o USING (source, block)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": OP3_SQL, "op7_secrets": OP7_SQL, "op9_suffix_array": OP9_SQL, "op5_sentence_spans": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op10_mixing": OP10_SQL}
