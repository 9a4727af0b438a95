"""One query an operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrilake.llm import bpe, decontaminate, licenses, linededup, merkle, ngram_join, phrases, ppm, preference, quality, sharding, token_files, url_filter
from petrilake.llm.common import lower_ascii, scratch_path


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence, of its own or of its nearest directory with a licence file.

    Documents have no paths: they are laid out as /source/lang/doc_id, and one that opens with its licence is a licence file there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 20, "0"))
    found = licenses.scan(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text", F.lit(None).cast("boolean").alias("is_licence_file")))
    return found.select(F.col("id").alias("doc_id"), "own_licence", "own_score", "licence", "inherited_from")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as Arrow stream files and read back."""
    folder = scratch_path(spark, "tokens")
    manifest = token_files.write_tokens(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.read_documents(manifest, folder)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 24 shards by the ring, at most one row apart."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = _docs(spark, sf_dir).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = sharding.shard(rows, "doc_id", 24, order=["doc_id", "text_crc32", "size"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by the ranks, and the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(_docs(spark, sf_dir), path, public_tokenizers.PATTERN).select("doc_id", "ids", "n_tokens")
    both = bpe.decode(coded, path, public_tokenizers.PATTERN)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base figures and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return quality.judge(docs, columns=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by the trie of the training fold, and by its unigrams."""
    return ppm.score(_docs(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that larger documents repeat."""
    kept = linededup.dedup_lines(_docs(spark, sf_dir), 20, 3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows, and their items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.find_contamination(_docs(spark, sf_dir), benchmark, 10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    items = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of 5-word shingle sets that are alike by 0.8."""
    return ngram_join.join_components(_docs(spark, sf_dir), 5, 80)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op11_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by the ranking of preference pairs of the labelled training rows."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    docs = _docs(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = preference.score(docs, preference.fit(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of two to four words that hold together best, of each language."""
    return phrases.mine(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"), 4, 30)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digests up to the root of the table, and what a tampered fifth of them would give."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*fields)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = docs.withColumn("tampered", F.when(hit, merkle.leaf([lower_ascii(F.col(f)) if f == "text" else F.col(f) for f in fields])))
    found = merkle.manifest(docs, "doc_id", "source", fields, carry="tampered")
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_token_files": op2_token_files,
    "op3_sharding": op3_sharding,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_ppm": op6_ppm,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_ngram_join": op9_ngram_join,
    "op10_url_filter": op10_url_filter,
    "op11_preference": op11_preference,
    "op12_phrases": op12_phrases,
    "op13_merkle": op13_merkle,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_WORD = "'[^\\x20\\x09-\\x0D]+'"
_CLASS = lambda cls: f"length(regexp_replace(t, '[^{cls}]+', '', 'g'))"
_HALVES = "CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END / 2 + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END / 2"
#: A value of a Merkle leaf, and a node's siblings around what stands between them.
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_SIDES = "array_to_string(ds[1:i % 16], '') {} array_to_string(ds[i % 16 + 2:], '')"

ORACLES: dict[str, str] = {
    "op5_quality": f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
often AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM often) GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
base AS (SELECT d.doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, {_CLASS("#*$%&|<>")} AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
  [{_CLASS("a-z")}, {_CLASS("A-Z")}, {_CLASS("0-9")}, {_CLASS("#*$%&|<>")}, length(regexp_replace(t, '[a-zA-Z0-9#*$%&|<> \\x09-\\x0D]|[^\\x00-\\x7F]', '', 'g')), length(regexp_replace(t, '[\\x00-\\x7F]+', '', 'g'))] AS k
  FROM d LEFT JOIN dups ON dups.doc_id = d.doc_id LEFT JOIN repeats ON repeats.doc_id = d.doc_id),
langs AS (SELECT lang FROM base WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= 1000),
keyed AS (SELECT base.*, langs.lang AS lk FROM base LEFT JOIN langs ON langs.lang = base.lang),
classes AS (SELECT lk, i, sum(k[i]) AS n FROM (SELECT lk, k, unnest(range(1, 7)) AS i FROM keyed WHERE lk IS NOT NULL) GROUP BY ALL),
class_ref AS (SELECT lk, i, n / sum(n) OVER (PARTITION BY lk) AS p FROM classes),
class_dist AS (SELECT doc_id, sqrt(greatest(sum({_HALVES.format(p="p", q="q")}), 0)) AS dist FROM (SELECT doc_id, p, k[i] / greatest(list_sum(k), 1) AS q FROM keyed JOIN class_ref ON class_ref.lk = keyed.lk) GROUP BY doc_id),
words AS (SELECT doc_id, lang, unnest(w) AS word FROM d),
counts AS (SELECT lang AS lk, word, count(*) AS n FROM words WHERE lang IN (SELECT lang FROM langs) GROUP BY ALL),
common AS (SELECT lk, word, p FROM (SELECT lk, word, n / sum(n) OVER (PARTITION BY lk) AS p FROM counts) WHERE p >= 0.005),
mine AS (SELECT doc_id, word, count(*) AS n FROM words GROUP BY ALL),
cells AS (SELECT keyed.doc_id, p, coalesce(mine.n, 0) / greatest(n_words, 1) AS q FROM keyed JOIN common ON common.lk = keyed.lk LEFT JOIN mine ON mine.doc_id = keyed.doc_id AND mine.word = common.word),
others AS (SELECT doc_id, greatest(1 - sum(p), 0) AS p, 1 - sum(q) AS q, sum({_HALVES.format(p="p", q="q")}) AS js FROM cells GROUP BY doc_id),
word_dist AS (SELECT doc_id, sqrt(greatest(js + {_HALVES.format(p="p", q="q")}, 0)) AS dist FROM others),
judged AS (SELECT keyed.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(w.dist, 0) AS wd, coalesce(c.dist, 0) AS cd FROM keyed LEFT JOIN word_dist w ON w.doc_id = keyed.doc_id LEFT JOIN class_dist c ON c.doc_id = keyed.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (n_words < 80 OR (wd <= 0.4 AND cd <= 0.32)) AS kept FROM judged""",
    "op7_line_dedup": f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM parts),
keyed AS (SELECT doc_id, i, line, {_LOWER.format(f"trim(line, {_SPACE})")} AS k FROM each),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, i, line, common.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id""",
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, places.n, i, item_id FROM places JOIN windows ON places.k = windows.k AND places.n = windows.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
    "op12_phrases": f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(k))),
f AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
parts AS (SELECT lang, k, g, a, string_split(g, ' ') AS s FROM f WHERE k > 1),
longer AS (SELECT lang, array_to_string(s[i:i + m - 1], ' ') AS g, max(a) AS b FROM (SELECT lang, s, k, a, m, unnest(range(1, k - m + 2)) AS i FROM parts, (VALUES (2), (3)) x(m) WHERE m < k) GROUP BY ALL),
cuts AS (SELECT p.lang, p.g, p.a, j, l.a AS l, r.a AS r, 2000000::HUGEINT * p.a // (l.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM parts) p JOIN f l ON l.lang = p.lang AND l.g = array_to_string(s[1:j], ' ') JOIN f r ON r.lang = p.lang AND r.g = array_to_string(s[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.g = best.g WHERE longer.b IS NULL OR 100 * longer.b < 80 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM kept JOIN totals ON totals.lang = kept.lang QUALIFY rank <= 2000""",
    "op13_merkle": f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS rid, doc_id, source, {_FIELD.format("doc_id")} || {_FIELD.format("source")} || {_FIELD.format("lang")} || {_FIELD.format("n_chars")} AS head, text,
  coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(CAST(doc_id AS VARCHAR)[i])::BIGINT)), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 5 = 0, false) AS hit FROM documents, crc),
leaves AS (SELECT rid, doc_id, source, sha256(head || {_FIELD.format("text")}) AS leaf, CASE WHEN hit THEN sha256(head || {_FIELD.format(_LOWER.format("text"))}) END AS changed FROM d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
up(source, lvl, i, d, n) AS (SELECT source, 0, i, leaf, n FROM ranked UNION ALL SELECT source, lvl + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY source, lvl, i // 16, n),
runs AS (SELECT source, lvl, i // 16 AS r, list(d ORDER BY i) AS ds FROM up WHERE n > 1 GROUP BY ALL),
tops AS (SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
gup(lvl, i, d, n) AS (SELECT 0, i, d, n FROM tops UNION ALL SELECT lvl + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)), (n + 15) // 16 FROM gup WHERE n > 1 GROUP BY lvl, i // 16, n),
gruns AS (SELECT lvl, i // 16 AS r, list(d ORDER BY i) AS ds FROM gup WHERE n > 1 GROUP BY ALL),
walk(rid, source, lvl, i, n, proof, folded) AS (SELECT rid, source, 0, i, n, '', coalesce(changed, leaf) FROM ranked
  UNION ALL SELECT rid, w.source, w.lvl + 1, i // 16, (n + 15) // 16, proof || {_SIDES.format("||")}, sha256({_SIDES.format("|| folded ||")}) FROM walk w JOIN runs s ON w.source IS NOT DISTINCT FROM s.source AND w.lvl = s.lvl AND s.r = i // 16 WHERE n > 1),
gwalk(rid, lvl, i, n, proof, folded) AS (SELECT rid, 0, tops.i, tops.n, proof, folded FROM walk JOIN tops ON walk.source IS NOT DISTINCT FROM tops.source WHERE walk.n = 1
  UNION ALL SELECT rid, w.lvl + 1, i // 16, (n + 15) // 16, proof || {_SIDES.format("||")}, sha256({_SIDES.format("|| folded ||")}) FROM gwalk w JOIN gruns s ON w.lvl = s.lvl AND s.r = i // 16 WHERE n > 1)
SELECT doc_id, leaf, tops.d AS subroot, g.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = g.d AS verified FROM gwalk w JOIN ranked ON ranked.rid = w.rid JOIN tops ON tops.source IS NOT DISTINCT FROM ranked.source, gup g WHERE w.n = 1 AND g.n = 1""",
}
