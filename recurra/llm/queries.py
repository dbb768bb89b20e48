"""The queries of this subpackage, over whole tables, and their SQL where SQL can say the same."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binpack, bpe, difference_cover, divergence, fim, gru, langid, mixing, multiset_hash, pii, quality, relative_lz, signature_tree

TOKENIZER = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def crc_of_id(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = binpack.shard(documents(spark, sf_dir), 40)
    return rows.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir).select("doc_id", "source")).select("doc_id", "source", "_mix.*")


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op4_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_lz.dedup(documents(spark, sf_dir), 20, digests=True)


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), tokenizer_path(), digests=True)


def op6_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.join(documents(spark, sf_dir), 4, 85)


def op7_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir), F.coalesce(crc_of_id(4) != 2, F.lit(True)))


def op8_gated_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.scored(documents(spark, sf_dir), crc_of_id(7) != 2)


def op9_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.compare(documents(spark, sf_dir))


def op10_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difference_cover.dedup(documents(spark, sf_dir), 200, digests=True)


def op11_rope_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.restore(fim.transform(documents(spark, sf_dir)))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each kind are those of the base spans."""
    rows = pii.find(documents(spark, sf_dir))
    count = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return rows.select("doc_id", *count, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed(pii.together()).alias("spans"))


def op13_group_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_vector_packing, op2_pfair_mix, op3_weak_supervision, op4_relative_lz, op5_trie_bpe, op6_signature_tree, op7_hyperdimensional, op8_gated_recurrent, op9_multiset_hash, op10_difference_cover, op11_rope_fim, op12_crf_pii, op13_group_tiles)}


#: Words of whole texts, as lists.
_WORDS = "SELECT doc_id, list_filter(regexp_split_to_array({}, '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') ws FROM documents"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of 20 words whose words start earlier too.
_OP4 = f"""WITH w AS ({_WORDS.format("coalesce(text, '')")}),
  win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) i FROM w WHERE len(ws) >= 20)),
  dup AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) j FROM dup),
  each AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) j, unnest(ws) word FROM w),
  kept AS (SELECT doc_id, count(*) n, string_agg(word, ' ' ORDER BY j) t FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
  SELECT w.doc_id, cast(len(ws) AS bigint) n_words, cast(len(ws) - coalesce(n, 0) AS bigint) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

#: Sets of shingles, all pairs that share one, and the closure of the links.
_OP6 = f"""WITH RECURSIVE w AS ({_WORDS.format(_LOWER)}),
  s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) g FROM w),
  n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
  pairs AS (SELECT a.doc_id u, b.doc_id v, count(*) shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS (SELECT u, v FROM pairs JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
  sym AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
  reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, v FROM reach r JOIN sym ON r.seen = u),
  deg AS (SELECT u doc_id, count(*) d FROM sym GROUP BY u)
  SELECT reach.doc_id, cast(coalesce(any_value(n), 0) AS bigint) n_shingles, min(seen) component_id, cast(coalesce(any_value(d), 0) AS bigint) n_links
  FROM reach LEFT JOIN n USING (doc_id) LEFT JOIN deg USING (doc_id) GROUP BY reach.doc_id"""

#: Strings of 200 bytes, as hexadecimal digits, that start twice or more.
_OP10 = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) x FROM documents),
  win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) k FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) i FROM h WHERE len(x) >= 400)),
  dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
  edge AS (SELECT doc_id, i, lag(i) OVER w before, lead(i) OVER w after FROM dup WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  heads AS (SELECT doc_id, i a, row_number() OVER (PARTITION BY doc_id ORDER BY i) r FROM edge WHERE before IS NULL OR i - before > 200),
  tails AS (SELECT doc_id, i + 200 b, row_number() OVER (PARTITION BY doc_id ORDER BY i) r FROM edge WHERE after IS NULL OR after - i > 200),
  spans AS (SELECT doc_id, a, b, r, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) p FROM heads JOIN tails USING (doc_id, r)),
  cut AS (SELECT doc_id, count(*) n, sum(b - a) gone, max(b) e, string_agg(substr(x, cast(2 * p + 1 AS bigint), cast(2 * (a - p) AS bigint)), '' ORDER BY a) kept FROM spans JOIN h USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, cast(len(x) // 2 AS bigint) n_bytes, cast(coalesce(gone, 0) AS bigint) n_removed, cast(coalesce(n, 0) AS bigint) n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, cast(2 * coalesce(e, 0) + 1 AS bigint)))) kept_sha256 FROM h LEFT JOIN cut USING (doc_id)"""

#: Lists of units, cut by the numbers in the hash.
_OP11 = """WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') u, sha256('42:' || coalesce(cast(doc_id AS varchar), '')) h FROM documents),
  k AS (SELECT doc_id, t, u, len(u) n, list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(h, i, 8) AS bigint)) r FROM d),
  c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) a, greatest(r[1] % (n + 1), r[2] % (n + 1)) b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END form FROM k),
  p AS (SELECT *, array_to_string(u[1:a], '') x, array_to_string(u[a + 1:b], '') y, array_to_string(u[b + 1:n], '') z FROM c)
  SELECT doc_id, cast(n AS bigint) n, form, CASE WHEN form <> 'plain' THEN cast(length(x) AS bigint) END prefix_chars, CASE WHEN form <> 'plain' THEN cast(length(y) AS bigint) END middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) output_sha256, sha256(t) restored_sha256 FROM p"""

#: Shares of every kept term in every group, and all pairs of a language's groups.
_OP13 = """WITH d AS (SELECT row_number() OVER () id, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') u FROM documents),
  t AS (SELECT id, lang, source, unnest(u) term FROM d),
  kept AS (SELECT lang, term, count(*) whole FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
  l AS (SELECT lang, count(*) v, sum(whole) n FROM kept GROUP BY lang),
  c AS (SELECT lang, source, term, count(*) n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
  g AS (SELECT d.lang, d.source, any_value(coalesce(v, 0)) v, any_value(coalesce(l.n, 0)) whole, any_value(coalesce(s.n, 0)) total FROM d LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) n FROM c GROUP BY ALL) s USING (lang, source) GROUP BY ALL),
  p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (total + 2 * v) p, 1 + 1000000000 * (kept.whole + 2) // (g.whole + 2 * v) q
    FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
  f AS (SELECT a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  r AS (SELECT a.lang, a.source, 'pair' part, b.source item, cast(coalesce(f, 0) AS bigint) AS "value" FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, cast((p - q) * (p - q) // (p + q) AS bigint) FROM p WHERE n > 0 AND p > q)
  SELECT *, cast(row_number() OVER (PARTITION BY lang, source, part ORDER BY "value" DESC, item) AS int) AS rank FROM r QUALIFY part = 'pair' OR rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose whole result it can give, written from the contracts and not from the operators."""
    return {"op4_relative_lz": _OP4, "op6_signature_tree": _OP6, "op10_difference_cover": _OP10, "op11_rope_fim": _OP11, "op13_group_tiles": _OP13}
