"""The dealt operators as queries on whole tables; SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointgrid.llm import alignment, bpe, cap_filters, language, licenses, manifest, mixing, preferences, quality, recompression, simhash, spotsigs, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text they decode to, as digests."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())


@query()
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query()
def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document without those that 20 words repeat from earlier on."""
    return recompression.digests(table(spark, sf_dir, "documents"))


@query()
def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document without those in 400 bytes that stand elsewhere too."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


@query("""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), unit AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM sound),
links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM unit a JOIN unit b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u),
degree AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)
""")
def op2_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("""
WITH rows_ AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last_ AS (SELECT pair_id, max(turn) AS last_turn FROM rows_ WHERE role = 'assistant' GROUP BY pair_id),
marked AS (
  SELECT rows_.*, last_turn, coalesce(turn = last_turn AND role = 'assistant', false) AS reply FROM rows_ LEFT JOIN last_ USING (pair_id)
), sided AS (
  SELECT pair_id, 'chosen' AS side, turn, role, text FROM rows_
  UNION ALL SELECT pair_id, 'rejected', turn, role, text FROM marked WHERE last_turn IS NOT NULL AND NOT reply
  UNION ALL SELECT l.pair_id, 'rejected', l.last_turn, m.role, m.text
            FROM marked m JOIN last_ l ON l.pair_id = m.pair_id + 1 - 2 * (m.pair_id % 2) WHERE m.reply AND l.last_turn IS NOT NULL
), parts AS (
  SELECT pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         count(*) FILTER (side = 'chosen') AS chosen, count(*) FILTER (side = 'rejected') AS rejected
  FROM sided GROUP BY ALL
), apart AS (SELECT pair_id, min(turn) AS first_apart FROM parts WHERE chosen <> rejected GROUP BY pair_id),
placed AS (SELECT parts.*, first_apart IS NULL OR turn < first_apart AS common FROM parts LEFT JOIN apart USING (pair_id)),
sides AS (
  SELECT *, 'prompt' AS part, chosen AS n FROM placed WHERE common
  UNION ALL SELECT *, 'chosen', chosen FROM placed WHERE NOT common
  UNION ALL SELECT *, 'rejected', rejected FROM placed WHERE NOT common
)
SELECT pair_id, part, turn, role, text, '<|' || role || '|>' || chr(10) || text || chr(10) AS rendered, n,
       role = 'assistant' AND NOT common AS in_loss
FROM sides WHERE n > 0
""")
def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered turns of every conversation paired with itself under its neighbour's last reply."""
    return preferences.formatted(preferences.with_swapped_replies(table(spark, sf_dir, "conversations")))


@query("""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents
), totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM totals
), total AS (SELECT sum(source_size) AS s FROM totals),
filling AS (
  SELECT 0 AS step, (SELECT s FROM total) AS rest, sum(weight) AS weights, -1 AS before FROM weighed
  UNION ALL
  SELECT step + 1,
         (SELECT s FROM total) - (SELECT coalesce(sum(cap), 0) FROM weighed WHERE cap * weights <= rest * weight),
         (SELECT sum(weight) FROM weighed WHERE cap * weights > rest * weight), weights
  FROM filling WHERE weights IS NOT NULL AND weights <> before
), ended AS (SELECT rest, weights FROM filling WHERE weights IS NOT NULL ORDER BY step DESC LIMIT 1),
shares AS (
  SELECT source, source_size,
         CASE WHEN cap * weights > rest * weight THEN CAST(rest * weight AS DOUBLE) / CAST(weights AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target
  FROM weighed, ended
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0 END AS rate
  FROM sized JOIN shares ON sized.source IS NOT DISTINCT FROM shares.source
), counted AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CAST(
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0
    < rate - floor(rate) AS BIGINT) AS copies
  FROM rated
)
SELECT doc_id, size, source_size, target, rate, copies, copies * size AS taken FROM counted
""")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source, target and words taken of every document."""
    return mixing.planned(table(spark, sf_dir, "documents"))


_QUOTED = ", ".join(f"'{w}'" for w in spotsigs.ANCHORS)
_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""
WITH texts AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text NULLS FIRST) AS r, doc_id, coalesce(text, '') AS own FROM documents),
placed AS (
  SELECT r, doc_id, own, length(own) AS n_chars,
         coalesce(lead(own) OVER (ORDER BY r), first_value(own) OVER (ORDER BY r)) AS next FROM texts
), sides AS (
  SELECT r, 'own' AS side, own AS t FROM placed
  UNION ALL SELECT r, 'edited', substring(own, 1, n_chars - n_chars // 2) || substring(next, 1, n_chars // 2) FROM placed
), split AS (
  SELECT r, side, t, list_filter(string_split(translate(lower(t), {_BLANKS} || '{spotsigs.DROPPED}', '     '), ' '), lambda x: x <> '') AS w FROM sides
), content AS (
  SELECT r, side, t, w, list_filter(list_zip(w, list_concat([''], w[:len(w) - 1])), lambda z: z[1] IS NOT NULL AND z[1] NOT IN ({_QUOTED})) AS c FROM split
), signed AS (
  SELECT r, side, t, w, list_transform(
    list_filter(list_zip(c, c[2:], c[3:]), lambda z: z[3] IS NOT NULL AND z[1][2] IN ({_QUOTED})),
    lambda z: substr(md5(z[1][2] || ' ' || z[1][1] || ' ' || z[2][1] || ' ' || z[3][1]), 1, 8)) AS s FROM content
), prints AS (
  SELECT r, side, t, CASE WHEN len(s) > 0 THEN list_sort(list_distinct(s)) ELSE [substr(md5('= ' || array_to_string(w, ' ')), 1, 8)] END AS f FROM signed
), joined AS (
  SELECT p.doc_id, p.n_chars, e.t AS edited, o.f AS f, e.f AS g, coalesce(n.f, z.f) AS h
  FROM placed p JOIN prints o ON o.r = p.r AND o.side = 'own' JOIN prints e ON e.r = p.r AND e.side = 'edited'
  LEFT JOIN prints n ON n.r = p.r + 1 AND n.side = 'own' JOIN prints z ON z.r = 1 AND z.side = 'own'
)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(f, ' ') AS fingerprint, array_to_string(g, ' ') AS edited_fingerprint,
       CAST(len(list_intersect(f, g)) AS DOUBLE) / (len(f) + len(g) - len(list_intersect(f, g))) AS near_edited,
       CAST(len(list_intersect(f, h)) AS DOUBLE) / (len(f) + len(h) - len(list_intersect(f, h))) AS near_next
FROM joined
""")
def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return spotsigs.beside_edited(table(spark, sf_dir, "documents"))


@query()
def op1_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op7_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.identified(table(spark, sf_dir, "documents"))


@query()
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers in every document."""
    import public_tokenizers

    return alignment.digests(table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


_TEMPLATES = [*((t, label, True) for t, label in licenses.PHRASES.items()), *((t, label, False) for t, label in licenses.NOTICES.items())]
_TEMPLATE_ROWS = ", ".join(f"({i}, '{label}', {base}, '{t}')" for i, (t, label, base) in enumerate(_TEMPLATES))
_K = licenses.K


@query(f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.WORD}') AS w FROM documents
), templates AS (SELECT template, label, base, string_split(t, ' ') AS tw FROM (VALUES {_TEMPLATE_ROWS}) v(template, label, base, t)),
words AS (SELECT r, unnest(w) AS w0, generate_subscripts(w, 1) - 1 AS pos FROM texts),
own AS (SELECT template, label, base, len(tw) AS size, unnest(tw) AS t0, generate_subscripts(tw, 1) - 1 AS place FROM templates),
grams AS (SELECT r, pos, w0, lead(w0) OVER o AS w1, lead(w0, 2) OVER o AS w2 FROM words WINDOW o AS (PARTITION BY r ORDER BY pos)),
known AS (SELECT template, label, base, size, place, t0, lead(t0) OVER o AS t1, lead(t0, 2) OVER o AS t2 FROM own WINDOW o AS (PARTITION BY template ORDER BY place)),
diagonals AS MATERIALIZED (
  SELECT r, template, label, base, size, pos - place AS diagonal, bit_or({2**_K - 1}::BIGINT << place) AS bits, min(pos) AS lo, max(pos) + {_K} AS hi
  FROM grams JOIN known ON w0 = t0 AND w1 = t1 AND w2 = t2 GROUP BY ALL
), marked AS (
  SELECT *, CAST(coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {licenses.GAP}, true) AS INT) AS new FROM diagonals
), run AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS k FROM marked),
spans AS (
  SELECT r, label, base, size, bits, lo, hi FROM diagonals
  UNION ALL SELECT r, label, base, size, bit_or(bits), min(lo), max(hi) FROM run GROUP BY r, template, label, base, size, k
), judged AS (
  SELECT r, label, CAST(bit_count(bits) AS DOUBLE) / size AS share, NOT base AND bit_count(bits) / size >= {licenses.LEAST} AND hi - lo <= {licenses.LONGEST} * size AS fits FROM spans
), places AS (
  SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(tw)] = tw)) AS pos FROM texts, templates WHERE base
), found AS (
  SELECT r, NULL AS pos, CASE WHEN fits THEN label END AS label, NULL AS base_label, share FROM judged
  UNION ALL SELECT r, pos, label, label, 1.0 FROM places
), summed AS (
  SELECT r, count(pos) AS n_base, min(pos) AS first_word, max(pos) AS last_word, max(share) AS score,
         list_sort(list(DISTINCT base_label) FILTER (base_label IS NOT NULL)) AS b, list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)) AS l
  FROM found GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(l, ','), '') AS labels, coalesce(score, 0.0) AS score
FROM texts LEFT JOIN summed USING (r)
""")
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scanned(table(spark, sf_dir, "documents"))


def _written(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_written(n_chars if f == "n_chars" else f) for f in manifest.FIELDS) + ")"


_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
  lambda x, b: list_reduce(list_concat([xor(x, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"""


@query(f"""
WITH RECURSIVE hashed AS (
  SELECT CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, doc_id, {_leaf('n_chars')} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS tampered FROM documents
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM hashed
), level AS (
  SELECT tree, 0 AS l, i, n AS width, leaf AS h FROM leaves
  UNION ALL SELECT tree, l + 1, i // 2, (min(width) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM level WHERE width > 1 GROUP BY tree, l, i // 2
), made AS MATERIALIZED (SELECT * FROM level),
subroots AS MATERIALIZED (SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM made WHERE width = 1),
over AS (
  SELECT 0 AS l, i, n AS width, subroot AS h FROM subroots
  UNION ALL SELECT l + 1, i // 2, (min(width) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM over WHERE width > 1 GROUP BY l, i // 2
), top AS MATERIALIZED (SELECT * FROM over),
steps AS (
  SELECT s.tree, s.i, m.l, CASE WHEN o.h IS NULL THEN '' WHEN o.i < m.i THEN 'L' || o.h ELSE 'R' || o.h END AS step
  FROM leaves s JOIN made m ON m.tree = s.tree AND m.i = s.i >> m.l AND m.width > 1 LEFT JOIN made o ON o.tree = m.tree AND o.l = m.l AND o.i = xor(m.i, 1)
), own AS (SELECT tree, i, list(step ORDER BY l) AS path FROM steps GROUP BY tree, i),
last_steps AS (
  SELECT s.tree, m.l, CASE WHEN o.h IS NULL THEN '' WHEN o.i < m.i THEN 'L' || o.h ELSE 'R' || o.h END AS step
  FROM subroots s JOIN top m ON m.i = s.i >> m.l AND m.width > 1 LEFT JOIN top o ON o.l = m.l AND o.i = xor(m.i, 1)
), ends AS (SELECT tree, list(step ORDER BY l) AS path FROM last_steps GROUP BY tree),
proofs AS (
  SELECT doc_id, leaf, tampered, subroot, (SELECT h FROM top WHERE width = 1) AS root, list_concat(coalesce(own.path, []), coalesce(ends.path, [])) AS path
  FROM leaves JOIN subroots s USING (tree) LEFT JOIN own ON own.tree = leaves.tree AND own.i = leaves.i LEFT JOIN ends ON ends.tree = leaves.tree
), folded AS (
  SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s[2:]), ''), '')) AS proof_sha256,
         list_reduce(list_concat([coalesce(tampered, leaf)], path), lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
  FROM proofs
)
SELECT *, folded_root = root AS verified FROM folded
""")
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document in the Merkle manifest, checked against tampered rows."""
    return manifest.verified(table(spark, sf_dir, "documents"))
