"""One thin query for each operator of the subpackage, and SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftgate.llm import chat, decontaminate, jaccard, maxent, mixture, negatives, neighbours, ordinal, pieces, pii, repair, tokens, urls
from driftgate.session import WorkArea, ship_package

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)  # tasks import the operators' modules
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_perspectives(spark, folder):
    views = chat.rotate(_table(spark, folder, "conversations"))
    return views.withColumn("mask", chat.mask_text(F.col("mask")))


_SQL["op1_perspectives"] = f"""
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS name,
         replace(coalesce(text, ''), '<|', '< |') AS body, floor(turn / {chat.PART_TURNS}.0) AS stretch
  FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, stretch ORDER BY turn NULLS LAST, name, body) AS nth FROM t
), v AS (
  SELECT n.conv_id, s.name AS speaker, stretch, (nth - 1) // {chat.PART_TURNS} AS piece, nth, s.name = n.name AS own,
         CASE WHEN s.name = n.name THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || n.name || chr(10) END || body || '<|im_end|>' || chr(10) AS segment
  FROM n JOIN (SELECT DISTINCT conv_id, name FROM t) s ON n.conv_id IS NOT DISTINCT FROM s.conv_id
), p AS (
  SELECT *, length(segment) AS len, sum(length(segment)) OVER (
           PARTITION BY conv_id, speaker ORDER BY stretch NULLS LAST, piece, nth) AS upto,
         dense_rank() OVER (PARTITION BY conv_id, speaker ORDER BY stretch NULLS LAST, piece) - 1 AS part
  FROM v
)
SELECT conv_id, speaker, CAST(part AS INTEGER) AS part, CAST(count(*) AS INTEGER) AS n_turns,
       CAST(min(upto - len) AS BIGINT) AS start, string_agg(segment, '' ORDER BY nth) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN CAST(upto - len + 22 AS BIGINT) || '-' || CAST(upto - 1 AS BIGINT) END,
                           ',' ORDER BY nth), '') AS mask
FROM p GROUP BY conv_id, speaker, part
"""


@query
def op2_token_counts(spark, folder):
    import public_tokenizers

    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


@query
def op3_benchmark_leaks(spark, folder):
    return decontaminate.matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@query
def op4_url_filter(spark, folder):
    return urls.judge(_table(spark, folder, "pages"))


@query
def op5_quality(spark, folder):
    docs = _table(spark, folder, "documents")
    model = ordinal.train(docs, _table(spark, folder, "labels"))
    return ordinal.score(docs.select("doc_id", "text"), model).drop("text")


@query
def op6_personal_data(spark, folder):
    return pii.annotate(_table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query
def op7_language_model(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return maxent.score(docs, WorkArea(spark, "op7"))


@query
def op8_mixture(spark, folder):
    docs = _table(spark, folder, "documents")
    area = WorkArea(spark, "op8")
    sized = docs.select("doc_id", "source", mixture.size_of(F.col("text")).alias("size"))
    return mixture.plan(area.save(sized, "sized"), area).select(
        "doc_id", "size", "source_size", "target", "taken", "shards"
    )


@query
def op9_nearest_vectors(spark, folder):
    asked = F.col("vec_id") % 20 == 0
    return neighbours.search(_table(spark, folder, "embeddings"), asked, 20, WorkArea(spark, "op9"))


@query
def op10_jaccard_components(spark, folder):
    return jaccard.cluster(_table(spark, folder, "documents"), WorkArea(spark, "op10"))


@query
def op11_conversation_repair(spark, folder):
    talks = _table(spark, folder, "conversations")
    return repair.report_all(talks, repair.repair(repair.damage(talks), WorkArea(spark, "op11")))


@query
def op12_hard_negatives(spark, folder):
    rows = _table(spark, folder, "embeddings").filter(F.col("label").isNotNull() & negatives.usable(F.col("embedding")))
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select("vec_id", flipped.alias("label"), negatives.whole(F.col("embedding")).alias("vector"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0, WorkArea(spark, "op12"))


def _repair_sql() -> str:
    """The cheapest edits from the last row to the first: for each state the least (cost, audit, turns) of the rest."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    due = {0: "u", 1: "u", 2: "a", 3: "u"}
    role = {"u": "user:", "a": "assistant:"}

    def way(cost: str, letter: str, turn: str | None, rest: str) -> str:
        turns = f"list_prepend({turn}, {rest}.t)" if turn else f"{rest}.t"
        return f"{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 't': {turns}}}"

    def row(state: int) -> str:
        """All that can be done with the row."""
        found = [way("3", "D", None, f"s{state}")]
        for initial, after in step[state].items():
            found.append(f"CASE WHEN live AND initial = '{initial}' THEN {way('late', 'K', 'turn', f's{after}')} END")
        after = step[state][due[state]]
        again = f"'{role[due[state]]}' || txt"
        found.append(f"CASE WHEN live THEN {way('2 + late', 'R', again, f's{after}')} END")
        return f"[{', '.join(found)}]"

    def best(state: int) -> str:
        inserted = way("2", "I", f"'{role[due[state]]}'", "o")
        more = f"list_transform(list_filter({row(step[state][due[state]])}, lambda o: o IS NOT NULL), lambda o: {inserted})"
        return f"list_sort(list_filter(list_concat({row(state)}, {more}), lambda o: o IS NOT NULL))[1]"

    nothing = "CAST([] AS VARCHAR[])"
    return f"""
WITH RECURSIVE bits AS (
  SELECT CAST(b AS BIGINT) AS b, CAST(b AS BIGINT) AS c, 0 AS k FROM range(256) r(b)
  UNION ALL
  SELECT b, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8
), names AS (
  SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), sums AS (
  SELECT name, 1 AS place, CAST(4294967295 AS BIGINT) AS c FROM names
  UNION ALL
  SELECT name, place + 1, xor(sums.c >> 8, bits.c)
  FROM sums JOIN bits ON k = 8 AND place <= length(name) AND b = xor(sums.c, ascii(substring(name, place, 1))) & 255
), kinds AS (
  SELECT name, xor(c, 4294967295) % 20 AS kind FROM sums WHERE place = length(name) + 1
), damaged AS (
  SELECT conv_id, turn AS place, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g')
              ELSE coalesce(text, ' ') END AS txt, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM conversations
  JOIN kinds ON name = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')
  WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place NULLS FIRST, role, txt) AS i FROM damaged
), marked AS (
  SELECT conv_id, place, txt, i, role || ':' || txt AS turn, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(txt, '[^\\x20\\x09-\\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) > 1 THEN 'd'
              WHEN regexp_matches(txt, '[.!?][\\x20\\x09-\\x0D]*$', 's') THEN '-' ELSE 't' END AS fault,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before
  FROM numbered
), rows_ AS (
  SELECT *, fault IN ('t', '-') AS live, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS late FROM marked
), talks AS (
  SELECT conv_id, max(i) AS n, coalesce(max(place) - min(place) + 1 - count(DISTINCT place), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id
), way AS (
  SELECT conv_id, n AS i, {{'c': 0, 'a': '', 't': {nothing}}} AS s0,
         {{'c': 4, 'a': 'II', 't': ['user:', 'assistant:']}} AS s1, {{'c': 2, 'a': 'I', 't': ['assistant:']}} AS s2,
         {{'c': 0, 'a': '', 't': {nothing}}} AS s3
  FROM talks
  UNION ALL
  SELECT way.conv_id, way.i - 1, {best(0)}, {best(1)}, {best(2)}, {best(3)}
  FROM way JOIN rows_ ON way.conv_id IS NOT DISTINCT FROM rows_.conv_id AND way.i = rows_.i
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost,
       coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN talks ON o.conv_id IS NOT DISTINCT FROM talks.conv_id
LEFT JOIN (SELECT * FROM way WHERE i = 0) w ON o.conv_id IS NOT DISTINCT FROM w.conv_id
"""


_SQL["op11_conversation_repair"] = _repair_sql()


_SQL["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS alike,
         CAST(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query
def op13_sentence_pieces(spark, folder):
    import public_tokenizers

    docs = _table(spark, folder, "documents").select("doc_id", "text")
    wanted = ("n_tokens", "ids_sha256", "decoded_sha256")
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), columns=wanted).drop("text")
