"""The driver queries, one per operator, each beside the SQL it is checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, functions as F

from lapwise.llm.bpe import digests
from lapwise.llm.decontamination import WINDOW, Benchmark, decontaminate, found_items
from lapwise.llm.language_id import identify, learn
from lapwise.llm.licenses import LEAST_SHARE, TEMPLATES, scan_licenses
from lapwise.llm.line_dedup import LONG_WORDS, WINDOW as LINE_WINDOW, line_dedup
from lapwise.llm.nearest import nearest_neighbours
from lapwise.llm.prefix_trie import grafted, trie, turns
from lapwise.llm.quality_classifier import quality_classifier
from lapwise.llm import quality_rules as qr
from lapwise.llm.registry import ORACLES, QUERIES, query  # noqa: F401
from lapwise.llm.simhash import near_duplicates
from lapwise.llm.spelling import DAMAGED, LEAST_COUNT, LEAST_LETTERS, TIMES, spelling_variants
from lapwise.llm.substring_dedup import LENGTH, sha256_of_kept, substring_dedup
from lapwise.llm.token_files import token_files
from lapwise.session import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _quality_sql() -> str:
    """The counts, the votes, and expectation-maximisation over vote patterns as a recursion."""
    rules = qr.rules()
    real = lambda x: f"CAST({x!r} AS DOUBLE)"
    votes = []
    for rule in rules:
        share = f"(CAST({rule.part} AS DOUBLE) / greatest({rule.whole}, 1))"
        inside = lambda limits, share=share: f"{share} BETWEEN {real(limits[0])} AND {real(limits[1])}"
        votes.append(f"CASE WHEN n_words = 0 THEN 0 WHEN NOT ({inside(rule.tolerated)}) THEN -1 WHEN {inside(rule.usual)} THEN 1 ELSE 0 END")
    evidence = [
        f"CASE votes[{j}] WHEN 1 THEN ln(g[{j}] / (1 - b[{j}])) WHEN -1 THEN ln((1 - g[{j}]) / b[{j}]) ELSE 0 END"
        for j in range(1, len(rules) + 1)
    ]
    odds = "ln(good / (1 - good)) + " + " + ".join(evidence)
    total = lambda weight, j, sign: f"coalesce(sum({weight}) FILTER (votes[{j}] = {sign}), 0)"

    def estimates(weight: str, right: int, start: float) -> str:
        parts = [
            f"({total(weight, j, right)} + {qr.PRIOR_VOTES * start!r}) / ({total(weight, j, 1)} + {total(weight, j, -1)} + {qr.PRIOR_VOTES})"
            for j in range(1, len(rules) + 1)
        ]
        return "[" + ",\n   ".join(parts) + "]"

    same = lambda x: "[" + ", ".join([real(x)] * len(rules)) + "]"
    return rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
triple AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) >= 3)),
twice AS (SELECT doc_id, s FROM triple GROUP BY ALL HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM triple JOIN twice USING (doc_id, s)) GROUP BY 1),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(repeated.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^!]+', '', 'g')) AS n_shouts,
         len(list_filter(l, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS n_symbol_lines
  FROM doc LEFT JOIN repeated USING (doc_id)),
voted AS (SELECT *, [{", ".join(votes)}] AS votes FROM m),
pattern AS MATERIALIZED (SELECT votes, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY votes),
em(step, good, g, b) AS (
  SELECT 0, {real(qr.START_GOOD)}, {same(qr.START_ON_GOOD)}, {same(qr.START_ON_BAD)}
  UNION ALL
  SELECT step + 1,
   (sum(n * p) + {qr.PRIOR_VOTES * qr.START_GOOD!r}) / (sum(n) + {qr.PRIOR_VOTES}),
   {estimates("n * p", 1, qr.START_ON_GOOD)},
   {estimates("n * (1 - p)", -1, qr.START_ON_BAD)}
  FROM (SELECT step, votes, n, 1 / (1 + exp(-greatest(-500, least(500, {odds})))) AS p FROM em, pattern WHERE step < {qr.ITERATIONS})
  GROUP BY step),
judged AS (
  SELECT voted.*, n_words < {qr.LEAST_WORDS} OR 100 * n_repeat_words > {qr.MOST_REPEATED_PERCENT} * n_words AS base_failed,
         1 / (1 + exp(-({odds}))) AS q
  FROM voted, (SELECT good, g, b FROM em ORDER BY step DESC LIMIT 1))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND q >= {qr.KEEP_AT} AS kept, round(q, 6) AS quality
FROM judged"""


@query("op1_quality_rules", _quality_sql())
def op1(table) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = qr.quality_rules(table("documents"))
    return judged.select("row.doc_id", *[f"m.{c}" for c in counts], "base_failed", "kept", F.round("quality", 6).alias("quality"))


@query("op2_language_id")
def op2(table) -> DataFrame:
    documents = table("documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    learning = documents.where(~held_out & F.col("lang").isNotNull()).select(F.col("doc_id").alias("id"), "text", "lang")
    predicted = identify(documents, learn(learning))
    return predicted.withColumnRenamed("id", "doc_id").select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


@query("op3_token_files")
def op3(table) -> DataFrame:
    return token_files(table("documents"), public_tokenizers.path("word_bpe_49k.json"))


def _licenses_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ",\n".join(
        f"('{t.label}', {str(t.base).lower()}, {quoted(t.words)}, {t.key_start}, {quoted(t.key)})" for t in TEMPLATES
    )
    return rf"""
WITH template(label, base, words, key_start, phrase) AS (VALUES {rows}),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
place AS (
  SELECT doc_id, w, label, base, words, key_start, unnest(range(0, len(w))) AS pos, phrase
  FROM doc JOIN template ON list_has_all(w, phrase)),
scored AS (
  SELECT doc_id, label, base, pos - key_start AS start,
         round(len(list_filter(range(0, len(words)),
               lambda i: pos - key_start + i >= 0 AND w[pos - key_start + i + 1] = words[i + 1])) / len(words), 6) AS share
  FROM place WHERE w[pos + 1 : pos + len(phrase)] = phrase),
found AS (SELECT * FROM scored WHERE share >= {LEAST_SHARE}),
summed AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
         max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM doc LEFT JOIN summed USING (doc_id)"""


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


@query("op4_license_scan", _licenses_sql())
def op4(table) -> DataFrame:
    scanned = scan_licenses(table("documents"))
    base = F.filter("found", lambda f: f["base"])
    starts = F.transform(base, lambda f: f["start"].cast("bigint"))
    return scanned.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _joined(F.transform(base, lambda f: f["label"])).alias("base_labels"),
        _joined(F.transform("found", lambda f: f["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)).alias("score"),
    )


@query("op5_quality_classifier")
def op5(table) -> DataFrame:
    labels = table("labels").select(F.col("doc_id").alias("id"), (F.col("quality") > 0).cast("int").alias("good"))
    # The documents name a source; its language editions are the paths below it.
    judged = quality_classifier(table("documents"), labels, (F.col("source"), F.col("lang")))
    measures = [F.round(c, 6).alias(c) for c in ("evidence", "host_quality", "path_quality", "quality")]
    return judged.select(F.col("id").alias("doc_id"), *measures, "kept")


DECONTAMINATION_SQL = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + {WINDOW} - 1], ' ') AS s, least(len(w), {WINDOW}) AS size
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
doc_window AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM dw CROSS JOIN (SELECT DISTINCT size FROM item_window) WHERE len(w) >= size)),
found AS (SELECT doc_id, i, size, item_id FROM doc_window JOIN item_window USING (s, size)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""


@query("op6_decontamination", DECONTAMINATION_SQL)
def op6(table) -> DataFrame:
    benchmark = Benchmark(table("benchmark"))
    searched = decontaminate(table("documents").select("doc_id", "text"), benchmark)
    searched = cut(searched.select("row.doc_id", "n_words", "hits", "numbers"), "decontamination-hits")
    hit = F.size("hits") > 0
    # Documents without a hit, most of them as a rule, take no part in the join.
    items = searched.where(hit).join(found_items(searched, benchmark), "numbers")
    none = searched.where(~hit).withColumn("items", F.array().cast("array<string>"))
    n_hit = F.aggregate("hits", F.lit(0), lambda total, h: total + h["last"] - h["first"] + 1).cast("bigint")
    return items.unionByName(none).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        hit.alias("contaminated"),
    )


LINE_DEDUP_SQL = rf"""
WITH numbered AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(0, len(parts))) AS line_no
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n_words
  FROM numbered WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
run AS (
  SELECT doc_id, pos, size, list(line) OVER w AS lines, count(*) OVER w AS n, sum(n_words) OVER w AS n_words
  FROM (SELECT *, unnest(range(1, {LINE_WINDOW} + 1)) AS size FROM worded)
  WINDOW w AS (PARTITION BY doc_id, size ORDER BY pos ROWS BETWEEN CURRENT ROW AND size - 1 FOLLOWING)),
repeated AS (
  SELECT doc_id, pos, size, row_number() OVER (PARTITION BY lines ORDER BY doc_id, pos) AS place
  FROM run WHERE n = size AND (size = {LINE_WINDOW} OR n_words >= {LONG_WORDS})),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS pos FROM repeated WHERE place > 1),
islands AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM gone),
counted AS (SELECT doc_id, count(*) AS n_removed, count(DISTINCT island) AS n_spans FROM islands GROUP BY doc_id),
line_counts AS (SELECT doc_id, count(*) AS n_lines FROM worded GROUP BY doc_id),
left_over AS (
  SELECT numbered.doc_id, string_agg(numbered.line, chr(10) ORDER BY numbered.line_no) AS kept
  FROM numbered LEFT JOIN worded USING (doc_id, line_no) LEFT JOIN gone ON gone.doc_id = worded.doc_id AND gone.pos = worded.pos
  WHERE gone.doc_id IS NULL GROUP BY numbered.doc_id)
SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN line_counts USING (doc_id) LEFT JOIN counted USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""


@query("op7_line_dedup", LINE_DEDUP_SQL)
def op7(table) -> DataFrame:
    deduped = line_dedup(table("documents"))
    kept = F.sha2(F.coalesce("kept", F.lit("")), 256)
    return deduped.select("row.doc_id", "n_lines", "n_removed", "n_spans", kept.alias("kept_sha256"))


@query("op8_simhash")
def op8(table) -> DataFrame:
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    found = near_duplicates(table("documents"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


# Bytes as two hexadecimal digits each.
SUBSTRING_DEDUP_SQL = f"""
WITH doc AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS digits FROM documents),
string AS (
  SELECT doc_id, p, substr(digits, 2 * p + 1, 2 * {LENGTH}) AS s
  FROM (SELECT doc_id, digits, unnest(range(0, len(digits) // 2 - {LENGTH} + 1)) AS p FROM doc WHERE len(digits) >= 2 * {LENGTH})),
first AS (SELECT s, min(doc_id) AS first_id FROM string GROUP BY s),
repeated AS (SELECT doc_id, p FROM string JOIN first USING (s) WHERE doc_id > first_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {LENGTH})) AS b FROM repeated),
runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < b - 1) AS n_spans
  FROM (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY b) AS before FROM gone) GROUP BY doc_id),
bytes AS (SELECT doc_id, digits, unnest(range(0, len(digits) // 2)) AS b FROM doc WHERE doc_id IN (SELECT doc_id FROM runs)),
kept AS (
  SELECT doc_id, string_agg(substr(digits, 2 * b + 1, 2), '' ORDER BY b) AS digits
  FROM bytes ANTI JOIN gone USING (doc_id, b) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(doc.digits) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN runs.doc_id IS NULL THEN doc.digits ELSE coalesce(kept.digits, '') END)) AS kept_sha256
FROM doc LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op9_substring_dedup", SUBSTRING_DEDUP_SQL)
def op9(table) -> DataFrame:
    return sha256_of_kept(substring_dedup(table("documents"))).withColumnRenamed("id", "doc_id")


@query("op10_bpe")
def op10(table) -> DataFrame:
    encoded = digests(table("documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.withColumnRenamed("id", "doc_id")


# CRC-32 by its table of 256 remainders, which a rule yields; ``bytes`` names a list of integers.
CRC_TABLE = """crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tab
  FROM range(256) t(i))"""


def _crc32(of: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295], {of}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


SPELLING_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
run AS (
  SELECT doc_id, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents)
  WHERE length(w) >= {LEAST_LETTERS} GROUP BY ALL),
hashed AS (
  SELECT w, n, {_crc32("""flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)] END))""")} AS h
  FROM run, crc),
word AS (
  SELECT w AS word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed)
  WHERE length(w) >= {LEAST_LETTERS} GROUP BY w HAVING sum(n) >= {LEAST_COUNT}),
shorter AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM shorter a JOIN shorter b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM word a JOIN shorter b ON a.word = b.rest
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN word b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word),
judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * n THEN other END AS form, CASE WHEN m >= {TIMES} * n THEN m END AS form_n
  FROM word LEFT JOIN best USING (word)),
followed(word, root, step) AS (
  SELECT word, word, 0 FROM judged
  UNION ALL SELECT f.word, j.form, step + 1 FROM followed f JOIN judged j ON f.root = j.word WHERE j.form IS NOT NULL)
SELECT word, form, last.root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM judged JOIN (SELECT word, arg_max(root, step) AS root FROM followed GROUP BY word) last USING (word)
"""


@query("op11_spelling", SPELLING_SQL)
def op11(table) -> DataFrame:
    return spelling_variants(table("documents"))


@query("op12_nearest")
def op12(table) -> DataFrame:
    found = nearest_neighbours(table("embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


# Turns borrowed from another conversation: the remainder of a hash by this number.
MOST_BORROWED = 9

TRIE_SQL = f"""
WITH {CRC_TABLE},
turn AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (SELECT conv_id, turn, md5(strlen(role) || ':' || role || text) AS g, strlen(text) AS bytes FROM turn),
numbered AS (
  SELECT conv_id, g, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g, bytes) AS pos FROM hashed),
conv AS (
  SELECT conv_id, conv_id - conv_id % 5 AS source,
         {_crc32("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))")} % {MOST_BORROWED} AS h
  FROM (SELECT DISTINCT conv_id FROM numbered), crc),
borrowed AS (
  SELECT c.conv_id, n.pos, n.g, n.bytes FROM conv c JOIN numbered n ON n.conv_id = c.source AND n.pos <= c.h),
taken AS (SELECT conv_id, count(*) AS k FROM borrowed GROUP BY conv_id),
path AS (
  SELECT * FROM borrowed
  UNION ALL
  SELECT n.conv_id, n.pos - h + coalesce(k, 0), g, bytes
  FROM numbered n JOIN conv USING (conv_id) LEFT JOIN taken USING (conv_id) WHERE n.pos > h),
step AS (
  SELECT conv_id, pos, bytes, md5(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS node FROM path
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM conv),
linked AS (
  SELECT *, lag(node) OVER w AS parent, lead(pos) OVER w IS NULL AS last FROM step WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
node AS (
  SELECT node, pos, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, min(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (last), '')) AS ends
  FROM linked GROUP BY node, pos),
child AS (SELECT parent, count(*) AS n FROM node GROUP BY parent),
weighed AS (SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child ON child.parent = node.node),
below AS (SELECT DISTINCT a.node, b.node AS lower FROM step a JOIN step b ON a.conv_id = b.conv_id AND a.pos <= b.pos),
summed AS (
  SELECT below.node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * bytes) AS saved
  FROM below JOIN weighed ON below.lower = weighed.node GROUP BY below.node)
SELECT w.conv_id, CAST(w.pos AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(w.n AS BIGINT) AS n_convs,
       CAST(w.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       w.ends AS ends_sha256
FROM weighed w JOIN summed USING (node) LEFT JOIN node p ON w.parent = p.node
"""


@query("op13_prefix_trie", TRIE_SQL)
def op13(table) -> DataFrame:
    numbered = cut(turns(table("conversations")), "trie-order")
    conv_id = F.col("conv_id")
    borrowed = F.crc32(conv_id.cast("string").cast("binary")) % MOST_BORROWED
    return trie(grafted(numbered, borrowed, conv_id - conv_id % 5, MOST_BORROWED - 1))
