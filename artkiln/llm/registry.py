"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottom_k, dom, lattice, line_rules, merkle, packing, passages, phrases, pieces, pivot_search, sharding, suffix_dedup, warc
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("op3_extendible_sharding", f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
     depths AS (SELECT CAST(range AS INTEGER) AS shard_depth FROM range(0, 61)),
     nodes AS (SELECT shard_depth, h >> (60 - shard_depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows
               FROM d, depths GROUP BY 1, 2 HAVING sum(n_bytes) <= {SHARD_BYTES}),
     fit AS (SELECT doc_id, n_bytes, h, n.shard_depth, n.shard_bytes, n.shard_rows, row_number() OVER (PARTITION BY doc_id ORDER BY n.shard_depth) AS k
             FROM d JOIN nodes n ON n.prefix = d.h >> (60 - n.shard_depth))
SELECT doc_id, n_bytes, substr(lpad(bin(h), 60, '0'), 1, shard_depth) AS shard, shard_depth, shard_bytes, shard_rows, TRUE AS fits FROM fit WHERE k = 1""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document, by the bytes of its text; null texts weigh nothing."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.shard(rows, F.col("doc_id"), F.col("n_bytes"), SHARD_BYTES)


@query("op6_line_frequency_rules", f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
     raw AS (SELECT doc_id, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS lw FROM parts),
     dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM raw WHERE len(lw) > 0 GROUP BY 1),
     norm AS (SELECT doc_id, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line, sum(len(lw)) AS words FROM raw WHERE len(lw) > 0 GROUP BY 1, 2),
     held AS (SELECT n.doc_id, d.host, n.line, n.words FROM norm n JOIN d USING (doc_id)),
     often AS (SELECT host, line, min(doc_id) AS first_doc FROM held GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= {line_rules.LEAST_DOCS}),
     gone AS (SELECT h.doc_id, sum(h.words) AS gone FROM held h JOIN often o ON h.host = o.host AND h.line = o.line WHERE h.doc_id <> o.first_doc GROUP BY 1),
     at8 AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 9),
     win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM at8),
     twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
     rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
     base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                     CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                     CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(w) - coalesce(gone, 0) AS BIGINT) AS words_left
              FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.REPEAT_PERCENT} * n_words) AND words_left >= {line_rules.LEFT_SHARE} * n_words AS kept FROM base""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return line_rules.judge(line_rules.measure(table(spark, sf_dir, "documents")))


@query("op8_warc_zstd", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     s AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS hex FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM s)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(hex, CAST(k // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM f""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    read = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_sentencepiece_viterbi")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, with the check that they decode to it."""
    return pieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op10_pattern_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op5_pivot_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best matches of every vector whose id is divisible by 50."""
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query("op4_attention_mil")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels outside the held-out fifth."""
    documents = table(spark, sf_dir, "documents")
    return passages.score(documents, passages.fit(documents, table(spark, sf_dir, "labels")))


@query("op9_dom_marginals")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return dom.extract(table(spark, sf_dir, "pages"), dom.trained())


@query("op1_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
     g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
     hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM g) WHERE m < doc_id),
     run AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS f FROM hit)),
     span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY 1, 2),
     cut AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM span UNION ALL SELECT d.doc_id, coalesce(max(b), 0), d.n FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id, d.n),
     kept AS (SELECT doc_id, sha256(unhex(string_agg(substr(h, CAST(2 * x + 1 AS INTEGER), CAST(2 * (y - x) AS INTEGER)), '' ORDER BY x, y))) AS kept_sha256 FROM cut JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_removed, count(a) AS n_spans, any_value(kept_sha256) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN span USING (doc_id) GROUP BY d.doc_id, d.n""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 50-byte strings of documents before it."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op7_bottom_k_dedup", """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                 ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM d),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
     shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
     link AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
     reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, min(r) = d.doc_id AS kept
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near copies of every document, on three words and a similarity of 0.85."""
    return bottom_k.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


#: crc32 of the decimal id, bit by bit, for the SQL.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), range(0, 8 * length(k))), lambda c, i:
    CASE WHEN i % 8 = 0 THEN xor(xor(c, ascii(substr(k, CAST(i // 8 + 1 AS INTEGER), 1))) >> 1, CASE WHEN xor(c, ascii(substr(k, CAST(i // 8 + 1 AS INTEGER), 1))) & 1 = 1 THEN 3988292384 ELSE 0 END)
         ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END))"""


def _tree(name: str, leaves: str) -> str:
    """Levels of the binary trees over leaves (tree, pos, h), a node alone at the end of a level hashed anew."""
    return f"""{name} AS (SELECT tree, 0 AS lvl, pos, h FROM {leaves} UNION ALL
      SELECT tree, lvl + 1, pos // 2, sha256(h || coalesce(nxt, '')) FROM (SELECT *, lead(h) OVER (PARTITION BY tree ORDER BY pos) AS nxt, count(*) OVER (PARTITION BY tree) AS c FROM {name}) WHERE pos % 2 = 0 AND c > 1),
 {name}_top AS (SELECT tree, max(lvl) AS top FROM {name} GROUP BY 1),
 {name}_way AS (SELECT l.tree, l.pos, string_agg(s.h, '' ORDER BY n.lvl) AS proof, list(CASE WHEN n.lvl = t.top THEN 'T' || n.h WHEN s.h IS NULL THEN 'N' WHEN s.pos < n.pos THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY n.lvl) AS way
   FROM {leaves} l JOIN {name} n ON n.tree = l.tree AND n.pos = l.pos >> n.lvl JOIN {name}_top t ON t.tree = l.tree LEFT JOIN {name} s ON s.tree = n.tree AND s.lvl = n.lvl AND s.pos = xor(n.pos, 1) GROUP BY l.tree, l.pos)"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


_FOLD = "list_reduce(list_prepend({start}, {way}), lambda a, x: CASE x[1] WHEN 'T' THEN a WHEN 'N' THEN sha256(a) WHEN 'L' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END)"


@query("op11_merkle_manifest", f"""
WITH RECURSIVE d AS (SELECT *, coalesce('=' || lang, '') AS tree, {_field('doc_id')} || {_field('source')} || {_field('lang')} AS head, CAST(doc_id AS VARCHAR) AS k FROM documents),
 e AS (SELECT doc_id, tree, sha256(head || {_field('n_chars')} || {_field('text')}) AS leaf, sha256(head || {_field("CASE WHEN " + _CRC32 + " % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} || {_field('text')}) AS tried FROM d),
 l AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM e),
 {_tree('t', 'l')},
 g AS (SELECT t.tree AS grp, '' AS tree, row_number() OVER (ORDER BY t.tree) - 1 AS pos, h FROM t JOIN t_top ON t.tree = t_top.tree AND lvl = top),
 {_tree('u', 'g')},
 r AS (SELECT h AS root FROM u JOIN u_top ON lvl = top),
 f AS (SELECT l.doc_id, l.leaf, g.h AS subroot, root, sha256(coalesce(t_way.proof, '') || coalesce(u_way.proof, '')) AS proof_sha256, {_FOLD.format(start='l.tried', way='t_way.way')} AS half, u_way.way AS way2
       FROM l JOIN t_way ON t_way.tree = l.tree AND t_way.pos = l.pos JOIN g ON g.grp = l.tree JOIN u_way ON u_way.pos = g.pos CROSS JOIN r)
SELECT doc_id, leaf, subroot, root, proof_sha256, {_FOLD.format(start='half', way='way2')} AS folded_root, {_FOLD.format(start='half', way='way2')} = root AS verified FROM f""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and folded root of every document, trees by language."""
    return merkle.manifest(merkle.document_leaves(table(spark, sf_dir, "documents")))


@query("op12_phrase_collocations", f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
 g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)),
 f AS (SELECT lang, CAST(k AS INTEGER) AS k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
 n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
 c AS (SELECT *, string_split(phrase, ' ') AS p FROM f WHERE k > 1),
 cuts AS (SELECT c.lang, c.k, c.phrase, c.a, cut, x.a AS l, y.a AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score
          FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(p[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(p[cut + 1:], ' ')),
 best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
 longer AS (SELECT DISTINCT c.lang, array_to_string(p[i:i + m - 1], ' ') AS phrase, c.a FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) c),
 kept AS (SELECT b.* FROM best b LEFT JOIN (SELECT lang, phrase, max(a) AS most FROM longer GROUP BY 1, 2) m USING (lang, phrase) WHERE NOT (100 * coalesce(most, 0) >= {phrases.DROP_PERCENT} * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= {phrases.TOP}""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return phrases.mine(table(spark, sf_dir, "documents"))


@query("op13_lattice_scores")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and lattice score of every document."""
    return lattice.score(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), rounds=2)
