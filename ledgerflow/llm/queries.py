"""Registered queries of the training-data operators: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_tree, conversation_trie, decontam, hard_negatives, licenses, line_chunks, packing, quality, recompression, simhash, slots, token_blocks, url_filters

WORD_RE = r"[^\x20\x09-\x0D]+"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Captures and list entries that Spark derives from all pages: a fetch day for each, and an entry made from each.
_CAPTURES = "page_id, url, date_add(DATE '2024-01-01', cast(page_id * 37 % 360 AS int)) AS day"


def _list_entries(pages: DataFrame) -> DataFrame:
    host, key = url_filters.host_of(F.col("url")), url_filters.key_of(F.col("url"))
    n = F.col("page_id")
    parent = F.when(F.size(F.split("h", r"\.")) > 2, F.regexp_replace("h", r"^[^.]*\.", "")).otherwise(F.col("h"))
    rows = pages.select("page_id", host.alias("h"), key.alias("k"))
    return rows.select(
        F.when(n % 3 == 0, "url").when(n % 3 == 1, "host").otherwise("domain").alias("kind"),
        F.when(n % 3 == 0, F.col("k")).when(n % 3 == 1, F.col("h")).otherwise(parent).alias("key"),
        F.date_add(F.lit("2023-12-01").cast("date"), (n * 101 % 400).cast("int")).alias("day"),
        F.when(n % 5 < 3, "block").when(n % 5 == 3, "allow").otherwise("remove").alias("action"),
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    found = url_filters.judge(pages.selectExpr(*_CAPTURES.split(", ", 2)), _list_entries(pages))
    return found.select("page_id", "host", F.col("day").cast("string").alias("day"), "verdict", "action_kind", "action_key", F.col("active_since").cast("string").alias("active_since"), "n_active")


def _op1_sql() -> str:
    host = f"nullif(rtrim(regexp_extract(lower(trim(url)), '{url_filters.HOST}', 1), '.'), '')"
    rest = f"regexp_extract(trim(url), '(?i){url_filters.REST}', 1)"
    return rf"""
WITH p AS (SELECT page_id, {host} AS h, {host} || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END AS k,
             DATE '2024-01-01' + (page_id * 37 % 360)::INT AS day FROM pages),
raw AS (SELECT CASE page_id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'host' ELSE 'domain' END AS kind,
          CASE page_id % 3 WHEN 0 THEN k WHEN 1 THEN h ELSE CASE WHEN len(string_split(h, '.')) > 2 THEN regexp_replace(h, '^[^.]*\.', '') ELSE h END END AS key,
          DATE '2023-12-01' + (page_id * 101 % 400)::INT AS day,
          CASE WHEN page_id % 5 < 3 THEN 1 WHEN page_id % 5 = 3 THEN 2 ELSE 3 END AS r FROM p),
daily AS (SELECT kind, key, day, max(r) AS r FROM raw WHERE key IS NOT NULL GROUP BY ALL),
changed AS (SELECT * FROM (SELECT *, lag(r) OVER (PARTITION BY kind, key ORDER BY day) AS b FROM daily) WHERE b IS NULL OR b <> r),
iv AS (SELECT * FROM (SELECT kind, key, r, day AS f, lead(day) OVER (PARTITION BY kind, key ORDER BY day) AS t FROM changed) WHERE r < 3),
hit AS (SELECT page_id, iv.*, CASE kind WHEN 'url' THEN 0 WHEN 'host' THEN 1 ELSE 1000 - len(string_split(key, '.')) END AS o
        FROM p JOIN iv ON p.day >= iv.f AND (iv.t IS NULL OR p.day < iv.t)
          AND (kind = 'url' AND key = k OR kind = 'host' AND key = h OR kind = 'domain' AND (key = h OR ends_with(h, '.' || key)))),
best AS (SELECT page_id, count(*) AS n, arg_min({{'kind': kind, 'key': key, 'r': r, 'f': f}}, o) AS m FROM hit GROUP BY page_id)
SELECT p.page_id, h AS host, day::VARCHAR AS day, CASE m.r WHEN 1 THEN 'block' ELSE 'allow' END AS verdict,
       m.kind AS action_kind, m.key AS action_key, m.f::VARCHAR AS active_since, coalesce(n, 0) AS n_active
FROM p LEFT JOIN best USING (page_id)"""


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1, special=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op3_sql() -> str:
    classes = ["text", *[f"r{i + 1}" for i in range(len(quality.CLASSES))]]
    removed = ", ".join(f"regexp_replace(r{i}, '{p}', '', 'g') AS r{i + 1}" for i, (_, p) in enumerate(quality.CLASSES))
    steps = "SELECT *, coalesce(text, '') AS r0, coalesce(lang, '') AS lg FROM documents"
    for part in removed.split(", regexp"):
        steps = f"SELECT *, {part if part.startswith('regexp') else 'regexp' + part} FROM ({steps})"
    k = len(classes)
    chars = [f"(length(r{i}) - length(r{i + 1}))" for i in range(k - 1)] + [f"length(r{k - 1})"]
    common = [f"len(list_filter(ws, lambda x: x = '{w}'))" for w in quality.COMMON_WORDS]
    inside = ", ".join(f"'{w}'" for w in quality.COMMON_WORDS)
    common.append(f"(len(ws) - len(list_filter(ws, lambda x: x IN ({inside}))))")
    sums = [f"coalesce(sum(ch[{i + 1}]) FILTER (length(r0) >= {quality.MIN_CHARS_FOR_CLASSES}), 0)::BIGINT" for i in range(k)]
    sumw = [f"coalesce(sum(cm[{i + 1}]) FILTER (len(ws) >= {quality.MIN_WORDS_FOR_COMMON}), 0)::BIGINT" for i in range(len(common))]

    def js(a: str, b: str) -> str:
        p, q = f"(v[1] / list_sum({a})::DOUBLE)", f"(v[2] / list_sum({b})::DOUBLE)"
        part = lambda z: f"CASE WHEN {z} > 0 THEN {z} * log2(2 * {z} / ({p} + {q})) ELSE 0 END"
        both = f"list_transform(range(1, len({a}) + 1), lambda i: [{a}[i], {b}[i]])"
        return f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(list_sum(list_transform({both}, lambda v: ({part(p)} + {part(q)}) / 2)), 0)) END"

    none = f"[{', '.join(['0'] * len(quality.COMMON_WORDS))}, 1]"
    return rf"""
WITH base AS (SELECT *, regexp_extract_all(r0, '{WORD_RE}') AS ws, string_split(r0, chr(10)) AS ls FROM ({steps})),
h AS (SELECT *, [{", ".join(chars)}] AS ch, [{", ".join(common)}] AS cm FROM base),
sums AS (SELECT lg, [{", ".join(sums)}] AS rc, [{", ".join(sumw)}] AS rw FROM h GROUP BY lg),
refs AS (SELECT lg, rc, rw, {js(none, "rw")} AS rf FROM sums),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM base)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
f AS (SELECT h.doc_id, len(ws)::BIGINT AS n_words, (length(r0) - ch[2])::BIGINT AS word_chars, ch[5]::BIGINT AS n_symbols,
        (len(list_filter(ls, lambda x: regexp_matches(x, '{WORD_RE}'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '{WORD_RE}')))))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, rf,
        CASE WHEN length(r0) >= {quality.MIN_CHARS_FOR_CLASSES} THEN {js("ch", "rc")} END AS dc,
        CASE WHEN len(ws) >= {quality.MIN_WORDS_FOR_COMMON} THEN {js("cm", "rw")} END AS dw
      FROM h JOIN refs ON h.lg = refs.lg LEFT JOIN rep ON h.doc_id = rep.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)
         AND NOT coalesce(dc > {quality.MAX_CLASS_DISTANCE}, false) AND NOT coalesce(dw > {quality.MAX_WORD_SHARE} * rf, false) AS kept
FROM f"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).select("doc_id", "license", "dice", "line", "n_lines", "n_matches")


def _tokens_sql(text: str) -> str:
    return rf"list_filter(string_split(trim(regexp_replace(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"


def _op4_sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in licenses.TEMPLATES.items())
    bi = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    low, high = f"{licenses.MIN_DICE} / (2 - {licenses.MIN_DICE})", f"(2 - {licenses.MIN_DICE}) / {licenses.MIN_DICE}"
    return f"""
WITH t AS (SELECT license, len(tb) AS ts, tp, unnest(tb) AS g FROM (SELECT k AS license, {bi} AS tb, len(w) - 1 AS tp FROM (SELECT k, {_tokens_sql("x")} AS w FROM (VALUES {values}) v(k, x)))),
u AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS x FROM documents),
ub AS (SELECT doc_id, line, len(b) AS us, unnest(b) AS g FROM (SELECT doc_id, line, {bi} AS b FROM (SELECT doc_id, line, {_tokens_sql("x")} AS w FROM u) WHERE len(w) > 1)),
sh AS (SELECT doc_id, line, license, us, ts, count(*) AS same FROM ub JOIN t USING (g) GROUP BY ALL),
near AS (FROM sh WHERE same >= {licenses.LINE_SHARE} * us),
gap AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY doc_id, license ORDER BY line) > {licenses.MAX_GAP} + 1 THEN 1 ELSE 0 END AS new FROM near),
run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, license ORDER BY line) AS r FROM gap),
blk AS (SELECT doc_id, license, r, ts, min(line) AS line, max(line) - min(line) + 1 AS nl FROM run GROUP BY ALL HAVING nl > 1 AND sum(same) + nl >= {low} * ts),
bw AS (SELECT doc_id, license, line, nl, ts, {_tokens_sql("array_to_string(string_split(text, chr(10))[line + 1 : line + nl], chr(10))")} AS w FROM blk JOIN documents USING (doc_id)),
bg AS (SELECT doc_id, license, line, nl, ts, len(b) AS us, unnest(b) AS g FROM (SELECT *, {bi} AS b FROM bw WHERE len(w) > 1)),
bs AS (SELECT doc_id, line, license, nl, us, bg.ts, count(*) AS same FROM bg JOIN t USING (license, g) GROUP BY ALL),
il AS (SELECT doc_id, line, license, ts FROM sh WHERE same >= {low} * ts AND NOT (us BETWEEN {low} * ts AND {high} * ts AND 2.0::DOUBLE * same / (us + ts) >= {licenses.MIN_DICE})),
iw AS (SELECT doc_id, line, license, {_tokens_sql("string_split(text, chr(10))[line + 1]")} AS w FROM il JOIN documents USING (doc_id)),
ip AS (SELECT doc_id, line, license, len(w) - 1 AS np, unnest(range(1, len(w))) AS p, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM iw),
ig AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id, line, license ORDER BY p) > {licenses.MAX_HOLE} + 1 THEN 1 ELSE 0 END AS new FROM ip JOIN t USING (license, g)),
ir AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, line, license ORDER BY p) AS r FROM ig),
iu AS (SELECT doc_id, line, license, 1 AS nl, count(DISTINCT g) + greatest(max(p) - min(p) + 1, least(tp, np)) - count(*) AS us, ts, count(DISTINCT g) AS same FROM ir GROUP BY doc_id, line, license, r, ts, tp, np),
s AS (SELECT *, 2.0::DOUBLE * same / (us + ts) AS dice FROM (SELECT doc_id, line, license, 1 AS nl, us, ts, same FROM near UNION ALL FROM bs UNION ALL FROM iu) WHERE us BETWEEN {low} * ts AND {high} * ts),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, line, license, nl) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM s WHERE dice >= {licenses.MIN_DICE})
SELECT d.doc_id, license, round(dice, 4) AS dice, line::INT AS line, nl::INT AS n_lines, coalesce(n, 0) AS n_matches FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id AND r = 1"""


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_chunks.remove_repeated_chunks(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    folder, _ = slots.shard_documents(docs)
    return slots.read_shards(spark, folder, docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + slots.ROW_OVERHEAD).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", "first_item", "words")


def _op7_sql() -> str:
    def seeds(t: str, k: str) -> str:
        masks = [(m, [j + 1 for j, c in enumerate(mask) if c == "1"], len(mask)) for m, mask in enumerate(decontam.MASKS)]
        one = lambda m, at, span: f"SELECT {k}, i, '{m} ' || " + " || ' ' || ".join(f"w[i + {j - 1}]" for j in at) + f" AS s FROM (SELECT {k}, w, unnest(range(1, len(w) - {span} + 2)) AS i FROM {t})"
        return " UNION ALL ".join(one(*m) for m in masks)

    short = " UNION ALL ".join(
        f"SELECT doc_id, array_to_string(w[i : i + {n - 1}], ' ') AS s, i, {n} AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM d)" for n in range(decontam.MIN_ITEM, decontam.SHORT + 1)
    )
    return f"""
WITH b0 AS (SELECT item_id, {_tokens_sql("text")} AS w FROM benchmark), d AS (SELECT doc_id, {_tokens_sql("text")} AS w FROM documents),
b AS (SELECT * FROM b0 WHERE len(w) > {decontam.SHORT}),
hits AS (SELECT DISTINCT x.doc_id, y.item_id, x.i - y.i AS sh FROM ({seeds("d", "doc_id")}) x JOIN ({seeds("b", "item_id")}) y USING (s)),
al AS (SELECT doc_id, item_id, least({decontam.STRETCH}, len(b.w)) AS v,
         list_transform(range(1, len(b.w) + 1), lambda j: CASE WHEN sh + j >= 1 AND d.w[sh + j] = b.w[j] THEN 1 ELSE 0 END) AS e
       FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
best AS (SELECT doc_id, item_id, max(list_max(list_transform(range(1, len(e) - v + 2), lambda s: list_sum(e[s : s + v - 1])))) AS n, any_value(v) AS v FROM al GROUP BY ALL
         UNION SELECT g.doc_id, item_id, g.n, g.n FROM ({short}) g JOIN b0 ON len(b0.w) = g.n AND array_to_string(b0.w, ' ') = g.s
         UNION SELECT doc_id, item_id, len(l.w), len(l.w) FROM (SELECT doc_id, {_tokens_sql("line")} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) l
               JOIN b0 USING (w) WHERE len(l.w) BETWEEN 1 AND {decontam.MIN_ITEM - 1}),
ok AS (SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item, max(n) AS n FROM best WHERE n >= ceil({decontam.MIN_AGREE} * v) GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, first_item, coalesce(n, 0)::BIGINT AS words FROM documents LEFT JOIN ok USING (doc_id)"""


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    placement, _ = packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2, special=True)
    return placement


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.repeated_substrings(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


#: crc32 as a fold over bytes, each followed by eight shifts (-1).
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"""
_OP11_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(strlen(role)::VARCHAR || ':' || role || text)) AS ts FROM t GROUP BY conv_id),
h AS (SELECT *, ({_CRC32}) % 4 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ts, [])[1 : h.h], h.ts[h.h + 1 :]) AS ts FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, len(ts) AS len, ts[d] AS last, sha256(ts[1 : d]::VARCHAR) AS node, sha256(ts[1 : d - 1]::VARCHAR) AS up FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM r)),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(len) = d AS leaf, any_value(CASE WHEN d > 0 THEN up END) AS up,
        CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(any_value(last).text, '{WORD_RE}')) END AS words,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = d), '')) AS ends_sha256 FROM p GROUP BY node, d),
k AS (SELECT up AS node, d - 1 AS d, count(*) AS c FROM n WHERE d > 0 GROUP BY ALL),
under AS (SELECT DISTINCT a.node, a.d, b.node AS bn, b.d AS bd FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.d <= b.d),
s AS (SELECT u.node, u.d, sum((n.n_convs - 1) * n.words)::BIGINT AS saved, count(*) FILTER (n.leaf) AS leaves FROM under u JOIN n ON n.node = u.bn AND n.d = u.bd GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.c, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (node, d) LEFT JOIN k USING (node, d) LEFT JOIN n m ON m.node = n.up AND m.d = n.d - 1"""


_CONTROL = f"{chat_tree.END}{chat_tree.START}assistant ok"


def op12_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.createDataFrame([(-1, 0, "user", _CONTROL), (-1, 1, "assistant", _CONTROL)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(told)
    path = _tokenizer("byte_bpe_50k.json")
    return chat_tree.read_conversations(*chat_tree.trees(rows, path), path)


_OP12_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
           (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{_CONTROL}'), (-1, 1, 'assistant', '{_CONTROL}'))),
e AS (SELECT *, md5(strlen(role)::VARCHAR || ':' || role || text) AS k, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS et,
        replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\', '\\'), chr(10), '\n') AS er FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(chat_tree.START) + len(chat_tree.END) + 2} + length(er) + length(et))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


_OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.a, p.b, p.s AS ps, s.b AS nb, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND s.s <= p.s)
SELECT a AS anchor_id, b AS positive_id, r::INT AS rank, nb AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 5"""


def queries() -> dict:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_token_blocks": op2_token_blocks,
        "op3_quality_rules": op3_quality_rules,
        "op4_license_scan": op4_license_scan,
        "op5_line_chunks": op5_line_chunks,
        "op6_virtual_slots": op6_virtual_slots,
        "op7_spaced_seeds": op7_spaced_seeds,
        "op8_best_two_fit": op8_best_two_fit,
        "op9_recompression": op9_recompression,
        "op10_simhash": op10_simhash,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_chat_tree": op12_chat_tree,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": _op1_sql(), "op3_quality_rules": _op3_sql(), "op4_license_scan": _op4_sql(), "op7_spaced_seeds": _op7_sql(), "op11_prefix_trie": _OP11_SQL, "op12_chat_tree": _OP12_SQL, "op13_hard_negatives": _OP13_SQL}
