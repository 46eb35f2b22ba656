"""The operators as registered queries, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.llm import conversations, divergence, idcodes, licenses, linededup, lm, minhash, packing, quality, sharding, tiling, tokencount, tokenizing, warc
from adlens.llm.common import documents, land
from adlens.llm.ship import send_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query; its operator's code is sent to the executors first."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            send_package(spark)
            return fn(spark, sf_dir)
        QUERIES[key] = run
        if sql is not None:
            CHECKS[key] = sql
        return run
    return add


# Words of a text as a list: A-Z lower-cased by translate, split at the six characters.
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_NEAR_SQL = f"""WITH RECURSIVE W AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  S AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
      ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i+4]) END) AS s FROM W),
  N AS (SELECT doc_id, count(*) AS n FROM S GROUP BY 1),
  P AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM S a JOIN S b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  E AS (SELECT a, b FROM P JOIN N x ON x.doc_id = a JOIN N y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
  L AS (SELECT a, b FROM E UNION ALL SELECT b, a FROM E),
  R AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT R.node, L.b FROM R JOIN L ON L.a = R.reach)
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
  FROM documents d LEFT JOIN N USING (doc_id) JOIN (SELECT node, min(reach) AS c FROM R GROUP BY 1) m ON m.node = d.doc_id"""


@query("op1_minhash_near_dedup", _NEAR_SQL)
def op1_minhash_near_dedup(spark, d):
    return minhash.near_duplicates(documents(spark, d))


# Base32 of the SHA-1: five hexadecimal digits make four characters.
_WARC_SQL = """WITH P AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
  G AS (SELECT h, max(page_id) AS top FROM P GROUP BY 1),
  X AS (SELECT h, g, CAST('0x' || substr(h, CAST(5 * g + 1 AS INT), 5) AS BIGINT) AS v FROM G, range(8) t(g)),
  B AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v >> CAST(15 - 5 * k AS INT)) & 31) AS INT), 1), '' ORDER BY g, k) AS b
    FROM X, range(4) t(k) GROUP BY 1)
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, b AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> top THEN top END AS refers_to
  FROM P JOIN G USING (h) JOIN B USING (h)"""


@query("op2_warc_dictionary", _WARC_SQL)
def op2_warc_dictionary(spark, d):
    return warc.archive_round_trip(spark.read.parquet(f"{d}/pages.parquet"))


SHARD_NAMES = [f"shard-{i}" for i in range(sharding.SHARDS)]
_SLOTS = sharding.table_size(sharding.SHARDS)

# One claim per step; the table so far is a list.
_SHARD_SQL = f"""WITH RECURSIVE D AS (SELECT i,
    CAST('0x' || substr(md5('offset:shard-' || i), 1, 15) AS BIGINT) % {_SLOTS} AS o,
    CAST('0x' || substr(md5('skip:shard-' || i), 1, 15) AS BIGINT) % {_SLOTS - 1} + 1 AS k FROM range({sharding.SHARDS}) t(i)),
  F AS (SELECT CAST(0 AS BIGINT) AS turn, list_transform(range({_SLOTS}), lambda x: CAST(-1 AS BIGINT)) AS owner,
      (SELECT list(o ORDER BY i) FROM D) AS o, (SELECT list(k ORDER BY i) FROM D) AS k,
      list_transform(range({sharding.SHARDS}), lambda x: CAST(0 AS BIGINT)) AS step, CAST(-1 AS BIGINT) AS slot
    UNION ALL SELECT * FROM (
      SELECT turn + 1, owner[:p] || [s] || owner[p + 2:], o, k, step[:s] || [j + 1] || step[s + 2:], p FROM (
        SELECT *, (o[s + 1] + j * k[s + 1]) % {_SLOTS} AS p FROM (
          SELECT *, step[s + 1] + list_position(list_transform(range(step[s + 1], {_SLOTS}),
              lambda x: owner[(o[s + 1] + x * k[s + 1]) % {_SLOTS} + 1]), -1) - 1 AS j FROM (
            SELECT *, turn % {sharding.SHARDS} AS s FROM F WHERE turn < {_SLOTS}))))),
  T AS (SELECT slot, (turn - 1) % {sharding.SHARDS} AS shard FROM F WHERE slot >= 0)
  SELECT doc_id, CAST(slot AS INT) AS slot, CAST(shard AS INT) AS shard FROM (SELECT doc_id,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {_SLOTS} AS slot FROM documents) JOIN T USING (slot)"""


@query("op3_permutation_sharding", _SHARD_SQL)
def op3_permutation_sharding(spark, d):
    return sharding.place(documents(spark, d).select("doc_id"), "doc_id", SHARD_NAMES)


@query("op4_string_tiling_decontamination")
def op4_string_tiling_decontamination(spark, d):
    return tiling.contaminated_pairs(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _split(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_QUALITY_SQL = f"""WITH T AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  W AS (SELECT doc_id, text, {_split("text")} AS w FROM T),
  A AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM W),
  G AS (SELECT doc_id, i, a, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM A),
  R AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS c FROM G WHERE c IS NOT NULL),
  N AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM R, range(3) t(k) WHERE c > 1 GROUP BY 1),
  L AS (SELECT doc_id, l, {_split("l")} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM T)),
  J AS (SELECT doc_id, l, len(w) AS n, (right(w[-1], 1) NOT IN ({_quoted(quality.CLOSING)})
      OR 2 * (length(l) - length(translate(l, '{quality.EMPHASIS}', ''))) > len(w)
      OR (len(list_filter(w, lambda x: x IN ({_quoted(quality.SEPARATORS)}))) >= 2
        AND 4 * len(list_filter(w, lambda x: x IN ({_quoted(quality.SEPARATORS)}))) >= len(w))
      OR {" OR ".join(f"contains({_LOWER.format('l')}, '{p}')" for p in quality.BOILERPLATE)}) AS fails FROM L WHERE len(w) > 0),
  K AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, coalesce(sum(n) FILTER (fails), 0) AS lost_words FROM J GROUP BY 1),
  B AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
      CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
      CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words
    FROM W LEFT JOIN N USING (doc_id) LEFT JOIN K USING (doc_id)),
  V AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM B)
  SELECT *, NOT base_failed AND 100 * lost_words <= {quality.LOSS_PERCENT} * n_words AS kept FROM V"""


@query("op5_line_quality_rules", _QUALITY_SQL)
def op5_line_quality_rules(spark, d):
    return quality.quality_figures(documents(spark, d))


@query("op6_line_dedup_alignment")
def op6_line_dedup_alignment(spark, d):
    return linededup.remove_repeated_lines(documents(spark, d).select("doc_id", "text", "n_chars"))


@query("op7_token_id_codes")
def op7_token_id_codes(spark, d):
    folder = idcodes.new_folder(spark)
    files = land(idcodes.write_ids(documents(spark, d), folder, tokenizing.vocabulary_path(tokenizing.WORD_LEVEL)), "id-files")
    return idcodes.read_ids(files, folder)


@query("op8_token_counts")
def op8_token_counts(spark, d):
    return tokencount.token_counts(documents(spark, d), tokenizing.vocabulary_path(tokencount.VOCABULARY))


# The CRC-32 of the digits of doc_id, bit by bit.
_CRC = """xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""
_SCORE_SQL = f"""WITH D AS (SELECT doc_id, {_CRC} % {lm.FOLDS} = {lm.HELD_OUT} AS held_out, {_WORDS} || [' '] AS w FROM documents),
  T AS (SELECT doc_id, held_out, unnest(w) AS t, unnest(['  '] || w[:-2]) AS h FROM D),
  U AS (SELECT t, count(*) AS c FROM T WHERE NOT held_out GROUP BY 1),
  H AS (SELECT h, count(*) AS ch FROM T WHERE NOT held_out GROUP BY 1),
  B AS (SELECT h, t, count(*) AS cb FROM T WHERE NOT held_out GROUP BY 1, 2),
  N AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM U),
  P AS (SELECT doc_id, held_out, coalesce(c, 0) AS c, coalesce(ch, 0) AS ch, coalesce(cb, 0) AS cb, n, (coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE) AS p
    FROM T LEFT JOIN U USING (t) LEFT JOIN H USING (h) LEFT JOIN B USING (h, t), N)
  SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
    round(sum(log10(p)), 6) AS base_score,
    round(sum(log10(CASE WHEN ch > 0 THEN (cb + {lm.PRIOR} * p) / (ch + {lm.PRIOR}) ELSE p END)), 6) AS score
  FROM P GROUP BY 1, 2"""


@query("op9_backoff_automaton_scores", _SCORE_SQL)
def op9_backoff_automaton_scores(spark, d):
    return lm.score_texts(documents(spark, d)).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


@query("op10_sum_of_squares_packing")
def op10_sum_of_squares_packing(spark, d):
    return packing.pack(documents(spark, d), tokenizing.vocabulary_path(tokenizing.BYTE_LEVEL))


_TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _p(count: str, total: str) -> str:
    return f"(1 + (CAST({divergence.SCALE} AS HUGEINT) * ({count} + 1)) // ({total}))"


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) // ({q}))"


_AUDIT_SQL = f"""WITH D AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERMS}') AS w FROM documents),
  G AS (SELECT DISTINCT lang, source FROM D),
  T AS (SELECT d, lang, source, unnest(w) AS t FROM D),
  K AS (SELECT lang, t, count(*) AS ln FROM T GROUP BY 1, 2 HAVING count(DISTINCT d) >= {divergence.MIN_DOCS}),
  C AS (SELECT lang, source, t, count(*) AS n FROM T JOIN K USING (lang, t) GROUP BY 1, 2, 3),
  V AS (SELECT lang, count(*) AS v, CAST(sum(ln) AS HUGEINT) AS l FROM K GROUP BY 1),
  N AS (SELECT lang, source, v, l, coalesce((SELECT sum(n) FROM C WHERE C.lang = G.lang AND C.source = G.source), 0) AS m FROM G JOIN V USING (lang)),
  P AS (SELECT lang, source, t, coalesce(n, 0) AS n, {_p("coalesce(n, 0)", "m + v")} AS p, {_p("ln", "l + v")} AS q
    FROM N JOIN K USING (lang) LEFT JOIN C USING (lang, source, t)),
  R AS (SELECT a.lang, a.source, b.source AS item, sum({_f("a.p", "b.p")}) AS value FROM P a JOIN P b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY 1, 2, 3),
  A AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
      FROM G a JOIN G b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN R ON R.lang = a.lang AND R.source = a.source AND R.item = b.source
    UNION ALL SELECT lang, source, 'term', t, CAST({_f("p", "q")} AS BIGINT) FROM P WHERE n > 0 AND p > q)
  SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM A) WHERE part = 'pair' OR rank <= {divergence.TOP}"""


@query("op11_source_divergence_audit", _AUDIT_SQL)
def op11_source_divergence_audit(spark, d):
    return divergence.divergence_audit(documents(spark, d))


# Forward: the least (cost, audit) with which each place and state is reached; inserts follow every row.
_REPAIR_SQL = f"""WITH RECURSIVE C AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.replace("CAST(doc_id AS VARCHAR)", "(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS d FROM conversations),
  X AS (SELECT k, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS c FROM C WHERE d <> 0),
  N AS (SELECT *, left(role, 1) AS o, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS e, row_number() OVER q AS i, lag(left(role, 1)) OVER q AS p,
      row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, c) > 1 AS seen
    FROM X WINDOW q AS (PARTITION BY k ORDER BY turn NULLS FIRST, sha256(role || ':' || text), c)),
  F AS (SELECT *, CASE WHEN e = '' THEN 'b' WHEN seen THEN 'd' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM N),
  S AS (SELECT unnest([0, 1, 3, 2]) AS s, unnest(['u', 'u', 'u', 'a']) AS o, unnest([2, 2, 2, 3]) AS t, unnest(['user', 'user', 'user', 'assistant']) AS role),
  A AS (SELECT k, i, s, s AS t, 'D' AS edit, 3 AS cost, CAST([] AS VARCHAR[]) AS line FROM F, S
    UNION ALL SELECT k, i, s, t, 'K', CAST(fault = 't' AS INT), [F.role || ':' || text] FROM F JOIN (SELECT s, o, t FROM S UNION ALL SELECT 0, 's', 1) S USING (o) WHERE fault NOT IN ('b', 'd')
    UNION ALL SELECT k, i, s, t, 'R', 2 + CAST(fault = 't' AS INT), [S.role || ':' || text] FROM F, S WHERE fault NOT IN ('b', 'd')),
  I AS (SELECT * FROM (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']),
    (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])) v(s, t, cost, edit, line)),
  W AS (SELECT k, CAST(0 AS BIGINT) AS i, t AS s, {{'cost': cost, 'audit': edit, 'lines': line}} AS b FROM (SELECT DISTINCT k FROM F), I WHERE s = 0
    UNION ALL SELECT * FROM (SELECT W.k, A.i, I.t, min({{'cost': W.b.cost + A.cost + I.cost, 'audit': W.b.audit || A.edit || I.edit, 'lines': W.b.lines || A.line || I.line}})
      FROM W JOIN A ON A.k = W.k AND A.i = W.i + 1 AND A.s = W.s JOIN I ON I.s = A.t GROUP BY 1, 2, 3)),
  Z AS (SELECT k, max(i) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (p || o NOT IN ('su', 'ua', 'au')) AS illegal FROM F GROUP BY 1),
  B AS (SELECT W.k, min(b) AS b FROM W JOIN Z ON Z.k = W.k AND W.i = n WHERE s IN (0, 3) GROUP BY 1)
  SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
    CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost,
    coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN Z ON Z.k = coalesce(CAST(conv_id AS VARCHAR), ' ') LEFT JOIN B ON B.k = Z.k"""


@query("op12_conversation_repair", _REPAIR_SQL)
def op12_conversation_repair(spark, d):
    return conversations.repair(spark.read.parquet(f"{d}/conversations.parquet"))


def _starts(phrase: str) -> str:
    parts = phrase.split(" ")
    return "list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts)) + ")"


_TEMPLATE_ROWS = ", ".join(f"({i}, '{label}', {sorted(set(t.split(' ')))}, {licenses.needed(len(set(t.split(' '))))})"
                           for i, (label, t) in enumerate(licenses.TEMPLATES))
_LICENSE_SQL = f"""WITH L AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
  W AS (SELECT r, doc_id, regexp_extract_all(t, '{licenses.WORD}') AS w FROM L),
  F AS (SELECT r, doc_id, len(w) AS n_words, {", ".join(f"{_starts(p)} AS {label}" for label, p in licenses.PHRASES)} FROM W),
  B AS (SELECT *, {" || ".join(label for label, _ in licenses.PHRASES)} AS places,
    {" || ".join(f"(CASE WHEN len({label}) > 0 THEN ['{label}'] ELSE CAST([] AS VARCHAR[]) END)" for label, _ in licenses.PHRASES)} AS base FROM F),
  X AS (SELECT r, line, list_distinct(regexp_extract_all(b, '{licenses.WORD}')) AS w FROM
    (SELECT r, unnest(string_split(t, chr(10))) AS b, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM L)),
  T(id, label, words, need) AS (VALUES {_TEMPLATE_ROWS}),
  H AS (SELECT r, line, label, len(list_intersect(w, words)) AS c, len(words) AS m FROM X, T WHERE len(list_intersect(w, words)) >= need),
  S AS (SELECT r, list(DISTINCT label) AS found, max(c / m) AS score, count(DISTINCT line) AS n_blocks FROM H GROUP BY 1)
  SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word,
    CAST(list_max(places) AS BIGINT) AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(base || coalesce(found, CAST([] AS VARCHAR[])))), ',') AS labels, coalesce(score, 0.0) AS score,
    CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks FROM B LEFT JOIN S USING (r)"""


@query("op13_license_scan", _LICENSE_SQL)
def op13_license_scan(spark, d):
    return licenses.scan_licenses(documents(spark, d))
