"""Registered queries of the text operators: thin, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adledger.llm import (
    byte_bpe, chat_format, decontaminate, exact_dedup, fill_in_middle, license_scan, line_dedup, merkle, mixing, quality,
    simhash, substring_dedup, toxicity,
)
from adledger.llm.common import table, texts
from adledger.plans.registry import Registry

registry = Registry()


@registry.add("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = texts(table(spark, sf_dir, "documents"))
    return byte_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                 ["doc_id"], with_ids=False)


@registry.add("op7_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@registry.add("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registry.add("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registry.add("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).drop("_h")


OP6_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[s : s + 9], ' ') AS phrase
  FROM (SELECT item_id, words, unnest(generate_series(1, greatest(1, len(words) - 9))) AS s FROM iw WHERE len(words) > 0)
), lengths AS (SELECT DISTINCT n FROM windows
), grams AS (
  SELECT doc_id, s, n, array_to_string(words[s : s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS s FROM dw, lengths WHERE len(words) >= n)
), hits AS (SELECT g.doc_id, g.s, g.n, w.item_id FROM grams g JOIN windows w ON g.phrase = w.phrase AND g.n = w.n
), spots AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN spots USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


@registry.add("op6_decontaminate", OP6_SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_h")


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS (
  SELECT doc_id, s, array_to_string(words[s : s + 12], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS s FROM w WHERE len(words) >= 13)
), dup AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY gram) AS least FROM grams) WHERE least < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS spots FROM (SELECT doc_id, unnest(generate_series(s, s + 12)) AS p FROM dup) GROUP BY doc_id
), pieces AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM pieces
  WHERE (doc_id, p) NOT IN (SELECT doc_id, unnest(spots) FROM gone) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(spots), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@registry.add("op1_substring_dedup", OP1_SQL)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_words(table(spark, sf_dir, "documents")).drop("spans")


@registry.add("op3_chat_format")
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(table(spark, sf_dir, "conversations")).drop("place")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM d),
g AS (SELECT doc_id, p, line, lead(line) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM l),
dup AS (SELECT doc_id, p FROM (
  SELECT doc_id, p, row_number() OVER (PARTITION BY line, nxt ORDER BY doc_id, p) AS n FROM g WHERE nxt IS NOT NULL) WHERE n > 1),
one AS (SELECT doc_id, p FROM (
  SELECT doc_id, p, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) AS n FROM l) WHERE n > 1 AND length(line) >= 20),
gone AS (SELECT doc_id, unnest([p, p + 1]) AS p FROM dup UNION SELECT doc_id, p FROM one),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.p) AS kept, count(*) AS n
  FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.p = gone.p GROUP BY l.doc_id),
pairs AS (SELECT a.doc_id AS d1, a.p AS p1, b.doc_id AS d2, b.p - a.p AS shift
  FROM l a JOIN l b ON a.line = b.line AND (a.doc_id <> b.doc_id OR a.p <> b.p)),
islands AS (SELECT d1, count(*) AS n FROM (
  SELECT d1, d2, shift, p1 - row_number() OVER (PARTITION BY d1, d2, shift ORDER BY p1) AS island FROM pairs) GROUP BY d1, d2, shift, island),
runs AS (SELECT d1 AS doc_id, max(n) AS longest FROM islands GROUP BY d1)
SELECT d.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, len(lines) - coalesce(n, 0) AS n_removed,
       CAST(CASE WHEN longest IS NULL THEN 0 ELSE power(2, floor(log2(longest))) END AS BIGINT) AS run_scale, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)
"""


@registry.add("op9_line_dedup", OP9_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH templates(license_id, text) AS (VALUES {values}),
tw AS (SELECT license_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM templates),
tc AS (SELECT license_id, word, count(*) AS tf FROM tw GROUP BY ALL),
d AS (SELECT doc_id, source || '/' || lang AS dir, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS body, generate_subscripts(lines, 1) AS line FROM d),
lw AS (SELECT doc_id, line, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM l),
n AS (SELECT count(*) AS n_lines FROM lw),
w AS (SELECT doc_id, line, unnest(words) AS word FROM lw),
p AS (SELECT * FROM w WHERE word IN (SELECT word FROM tc)),
uses AS (SELECT word, count(*) AS uses FROM p GROUP BY word),
idf AS (SELECT v.word, ln(1 + n_lines / (1 + coalesce(uses, 0))) AS idf, ln(1 + n_lines / 2) AS idf_other
  FROM (SELECT DISTINCT word FROM tc) v LEFT JOIN uses USING (word), n),
tv AS (SELECT license_id, word, tf * idf AS w FROM tc JOIN idf USING (word)),
tn AS (SELECT license_id, sqrt(sum(w * w)) AS norm FROM tv GROUP BY 1),
target AS (SELECT license_id, word, w / norm AS w FROM tv JOIN tn USING (license_id)),
units AS (
  SELECT doc_id, line, word, count(*) AS tf FROM p GROUP BY ALL
  UNION ALL SELECT doc_id, -1, word, count(*) FROM p GROUP BY ALL),
total AS (SELECT doc_id, line, len(words) AS n FROM lw UNION ALL SELECT doc_id, -1, sum(len(words)) FROM lw GROUP BY 1),
size AS (SELECT doc_id, line, sqrt(sum(tf * idf * tf * idf) + (any_value(n) - sum(tf)) * max(idf_other) * max(idf_other)) AS norm
  FROM units JOIN idf USING (word) JOIN total USING (doc_id, line) GROUP BY doc_id, line),
cosine AS (SELECT doc_id, line, license_id, round(sum(tf * idf * w) / any_value(norm), 6) AS similarity
  FROM units JOIN idf USING (word) JOIN target USING (word) JOIN size USING (doc_id, line) GROUP BY doc_id, line, license_id),
ranked AS (SELECT doc_id, line < 0 AS is_file, license_id, similarity,
  row_number() OVER (PARTITION BY doc_id, line < 0 ORDER BY similarity DESC, license_id) AS n FROM cosine
  WHERE similarity >= CASE WHEN line < 0 THEN 0.5 ELSE 0.8 END),
own AS (SELECT * FROM ranked WHERE n = 1),
covers AS (SELECT dir, license_id, similarity, row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, license_id) AS n
  FROM own JOIN d USING (doc_id) WHERE is_file)
SELECT d.doc_id, coalesce(f.license_id, h.license_id, c.license_id) AS license_id,
  CASE WHEN f.doc_id IS NOT NULL THEN 'file' WHEN h.doc_id IS NOT NULL THEN 'header' WHEN c.dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  coalesce(f.similarity, h.similarity, c.similarity) AS similarity
FROM d LEFT JOIN own f ON f.doc_id = d.doc_id AND f.is_file LEFT JOIN own h ON h.doc_id = d.doc_id AND NOT h.is_file
LEFT JOIN covers c ON c.dir = d.dir AND c.n = 1
""".format(values=", ".join("('{}', '{}')".format(*t) for t in license_scan.TEMPLATES))


@registry.add("op10_license_scan", OP10_SQL)
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return license_scan.scan(files, license_scan.templates(spark)).drop("_h")


@registry.add("op11_mix_sources")
def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def _merkle_sql(rounds: int = 10) -> str:
    """Trees level by level, unrolled: enough for 8 ^ ``rounds`` documents a language."""
    fields = " || ".join(
        f"CASE WHEN {{0}} IS NULL THEN '-' ELSE CAST(strlen(CAST({{0}} AS VARCHAR)) AS VARCHAR) || ':' || CAST({{0}} AS VARCHAR) END".format(c)
        for c in merkle.FIELDS)
    changed = fields.replace("(text AS", f"(translate(text, '{merkle.UPPER}', '{merkle.LOWER}') AS")
    crc = ("xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           "lambda d: CAST(ord(d) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
           "lambda x, y: xor(x // 2, 3988292384 * (x % 2)))))")
    ctes = [f"""leaves AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
  sha256({fields}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({changed}) ELSE sha256({fields}) END AS claimed FROM documents),
n0 AS (SELECT lang, pos, leaf AS h FROM leaves)"""]

    def level(name: str, source: str, key: str) -> str:
        """Siblings of each node of ``source``, and the next level; a lone node stays as it is."""
        return f"""s{name} AS (SELECT {key}, pos, count(*) OVER (PARTITION BY {key}) AS n,
  coalesce(string_agg(h, '') OVER (PARTITION BY {key}, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (PARTITION BY {key}, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, h FROM {source}),
g{name} AS (SELECT {key}, pos // 8 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
  FROM s{name} GROUP BY {key}, pos // 8)"""

    for i in range(rounds):
        ctes.append(level(f"a{i}", "n0" if i == 0 else f"ga{i - 1}", "lang"))
    ctes.append(f"""roots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM ga{rounds - 1}),
t0 AS (SELECT 0 AS one, tree AS pos, subroot AS h FROM roots)""")
    for i in range(rounds // 2):
        ctes.append(level(f"b{i}", "t0" if i == 0 else f"gb{i - 1}", "one"))
    ctes.append("f0 AS (SELECT l.doc_id, l.lang, l.pos, l.leaf, r.subroot, r.tree, claimed AS d, '' AS proof FROM leaves l JOIN roots r ON l.lang IS NOT DISTINCT FROM r.lang)")
    step = 0
    for name, on in [*[(f"a{i}", f"s.lang IS NOT DISTINCT FROM f.lang AND s.pos = f.pos // {8 ** i}") for i in range(rounds)],
                     *[(f"b{i}", f"s.pos = f.tree // {8 ** i}") for i in range(rounds // 2)]]:
        ctes.append(f"f{step + 1} AS (SELECT f.* REPLACE (CASE WHEN s.n = 1 THEN f.d ELSE sha256(s.l || f.d || s.r) END AS d, f.proof || s.l || s.r AS proof) "
                    f"FROM f{step} f JOIN s{name} s ON {on})")
        step += 1
    return f"""WITH {", ".join(ctes)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, d AS folded_root, d = h AS verified
FROM f{step}, gb{rounds // 2 - 1}"""


@registry.add("op12_merkle_manifest", _merkle_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    lowered = {"text": F.translate("text", merkle.UPPER, merkle.LOWER)}
    return merkle.proofs(merkle.manifest(table(spark, sf_dir, "documents"), lowered, tampered))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
k AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
  CAST('0x' || h[17:24] AS BIGINT) % 100 AS f, CAST('0x' || h[25:32] AS BIGINT) % 100 AS s FROM d),
c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
  OR f >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@registry.add("op13_fill_in_middle", OP13_SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"))
