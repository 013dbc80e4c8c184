"""The registered queries of the text operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.llm import (array_merge, bucket_pointers, chat, content_sort, crf, dart_minhash, dual_tree, mixing, output_codes, quality_rules,
                            trie_join, turn_repair, word_table)
from shelfwatch.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_MIX_SQL = f"""
WITH s AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s GROUP BY source),
o AS (SELECT *, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left, sum(n) OVER () - coalesce(sum(3 * n) OVER before, 0) AS n_left FROM t
      WINDOW before AS (ORDER BY n * 1.0 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(n * 1.0 / w) AS least FROM o WHERE w * n_left / w_left::DOUBLE <= 3 * n),
g AS (SELECT source, n, CASE WHEN n * 1.0 / w < least THEN (3 * n)::DOUBLE ELSE w * (SELECT n_left FROM o x WHERE x.n * 1.0 / x.w = least ORDER BY source NULLS LAST LIMIT 1)
      / (SELECT w_left FROM o x WHERE x.n * 1.0 / x.w = least ORDER BY source NULLS LAST LIMIT 1)::DOUBLE END AS target FROM o, f),
p AS (SELECT s.*, g.n, g.target, floor(g.target + 0.5)::BIGINT AS quota, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5('mix-1:' || doc_id::VARCHAR), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "at" FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source, n AS source_size, target,
       CASE WHEN size > 0 THEN greatest(0, ceil((2 * quota - 2 * "at" - size) / (2.0 * n)))::BIGINT ELSE 0 END AS copies,
       size * CASE WHEN size > 0 THEN greatest(0, ceil((2 * quota - 2 * "at" - size) / (2.0 * n)))::BIGINT ELSE 0 END AS taken
FROM p
"""


@query("op1_mix_sources", _MIX_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_weight(documents(spark, sf_dir)).drop("draw")


@query("op2_dart_minhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_classes(documents(spark, sf_dir))


@query("op3_language_codes")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = output_codes.fit(docs.where(~output_codes.held_out() & F.col("doc_id").isNotNull()))
    found = output_codes.predict(docs, model)
    return found.select("doc_id", output_codes.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


_CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
l AS (SELECT *, 24 + length(replace(replace(replace(role, '\', '\e'), '<|', '<\p'), chr(10), '\n')) + length(replace(replace(text, '\', '\e'), '<|', '<\p')) AS piece,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM c),
e AS (SELECT *, sum(piece) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM l)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op4_chat_format", _CHAT_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    return chat.read_back(chat.examples(turns.unionByName(extra)))


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = array_merge.token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op6_bucket_pointers")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bucket_pointers.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = crf.scan(docs, crf.fit(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), count("crf"))


@query("op8_bpe_words")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    both = word_table.encode(documents(spark, sf_dir), path, decoded_col="decoded")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


_QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
w AS (SELECT doc_id, text, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda i: [words[i], words[i + 1], words[i + 2]])) AS win FROM d WHERE len(words) > 2),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
raw AS (SELECT doc_id, source, text, len(words) AS n_of, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT doc_id, source, text, n_of, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS line FROM raw),
q AS (SELECT source, line FROM n JOIN (SELECT source AS host, count(DISTINCT text) AS copies FROM d GROUP BY 1) h ON n.source IS NOT DISTINCT FROM h.host
      WHERE line <> '' GROUP BY source, line, copies HAVING count(DISTINCT text) >= 5 AND 100 * count(DISTINCT text) >= 10 * copies),
g AS (SELECT doc_id, sum(len(string_split(n.line, ' ')))::BIGINT AS gone FROM n JOIN q ON n.source IS NOT DISTINCT FROM q.source AND n.line = q.line GROUP BY doc_id),
b AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(g.gone, 0)::BIGINT AS n_removed
      FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_removed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (n_removed = 0 OR (n_words - n_removed >= 20 AND 100 * (n_words - n_removed) >= 30 * n_words)) AS kept
FROM b
"""


@query("op9_quality_rules", _QUALITY_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(documents(spark, sf_dir))


@query("op10_exact_dedup", """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(documents(spark, sf_dir))


def _repair_sql() -> str:
    """The repair as a recursion over a conversation's rows; a state is its cheapest (cost, audit, text so far)."""
    def step(state: str, cost: str, letter: str, text: str | None = None) -> str:
        said = f"{state}.t" if text is None else f"{state}.t || {text} || chr(10)"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {said}}} END"

    def kept(state: str, initial: str) -> str:
        return f"CASE WHEN kind = 0 AND left(role, 1) = '{initial}' THEN {step(state, 'cut', 'K', 'said')} END"

    def rerole(state: str, role: str) -> str:
        return f"CASE WHEN kind = 0 THEN {step(state, '2 + cut', 'R', repr(role + ':') + ' || text')} END"

    user, reply = "'user:'", "'assistant:'"
    insert = f"least(u, {step('n', '2', 'I', user)}, {step('s', '2', 'I', user)}, {step('a', '2', 'I', user)}) AS u, least(a, {step('u', '2', 'I', reply)}) AS a"
    row = f"""{step('n', '3', 'D')} AS n, least({step('s', '3', 'D')}, {kept('n', 's')}) AS s,
        least({step('u', '3', 'D')}, {', '.join(f(x, y) for x in 'nsa' for f, y in ((kept, 'u'), (rerole, 'user')))}) AS u,
        least({step('a', '3', 'D')}, {kept('u', 'a')}, {rerole('u', 'assistant')}) AS a"""
    state = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    return rf"""
WITH RECURSIVE said AS (SELECT conv_id, turn, row_number() OVER () AS r, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS key FROM conversations),
crc AS (SELECT * EXCLUDE key, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(key, lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT) % 20 AS lot FROM said),
hurt AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
          r, unnest(CASE lot WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc),
placed AS (SELECT *, row_number() OVER c AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, r, copy) > 1 AS again, lag(left(role, 1)) OVER c || left(role, 1) AS pair,
          regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last FROM hurt WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, r, copy)),
faults AS (SELECT conv_id, i, turn, role, text, pair, role || ':' || text AS said, CASE WHEN last = '' THEN 1 WHEN again THEN 2 ELSE 0 END AS kind,
          (last <> '' AND NOT again AND last NOT IN ('.', '!', '?'))::INT AS cut FROM placed),
walk AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}}::{state} AS n, NULL::{state} AS s, NULL::{state} AS u, NULL::{state} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, {row}
  FROM (SELECT * EXCLUDE (u, a), {insert} FROM (SELECT w.* EXCLUDE (u, a, i), f.i, f.role, f.text, f.said, f.kind, f.cut, {insert}
        FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
ended AS (SELECT conv_id, least(n, a) AS best FROM (SELECT * EXCLUDE (u, a), {insert} FROM (SELECT * EXCLUDE (u, a), {insert} FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)))),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum((kind = 1)::INT)::BIGINT AS blank, sum((kind = 2)::INT)::BIGINT AS duplicate, sum(cut)::BIGINT AS truncated,
          sum((coalesce(pair, 'su') NOT IN ('su', 'ua', 'au'))::INT)::BIGINT AS illegal FROM faults GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.c AS cost, best.a AS audit, sha256(left(best.t, greatest(0, length(best.t) - 1)::BIGINT)) AS repaired_sha256
FROM ended e LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query("op11_turn_repair", _repair_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    return turn_repair.summary(turn_repair.repaired(turn_repair.damaged(turns)))


@query("op12_trie_join")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.near_components(documents(spark, sf_dir))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')"

_SEARCH_SQL = f"""
WITH d AS (SELECT * FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS nn, sum(len(t))::BIGINT AS ll FROM d),
i AS (SELECT row_number() OVER () AS i, item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), s),
f AS (SELECT i, item_id, p.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(t) * nn) // ll))))::BIGINT AS score
      FROM i JOIN p USING (term) JOIN w USING (term) JOIN d ON d.r = p.r, s GROUP BY i, item_id, p.r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM f WHERE score > 0 QUALIFY rank <= 50
"""


@query("op13_dual_tree", _SEARCH_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.ranked(spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"), documents(spark, sf_dir))
