"""Queries of scans, names, tokens, pairs, blocks, evidence and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import measures as M
from knotwork.functions import text as X
from knotwork.operators import clusters, evidence, matching, pairs
from knotwork.plans.base import BLOCK_LIST, BLOCKS, CON, KO, LEC, NAME_KEY, REL, STRIP, TOKENS, WORDS, connections, lectures, objects, query, relations
from knotwork.session import table


@query(f"SELECT DISTINCT name, {NAME_KEY.format('name')} AS name_key FROM knowledge_objects WHERE name IS NOT NULL")
def name_match_key(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "knowledge_objects").select("name").filter("name IS NOT NULL").distinct()
    return names.select("name", X.name_key(F.col("name")).alias("name_key"))


_WRAPPED = "(length({0}) > {2} AND starts_with({0}, '{1}') AND ends_with({0}, '{3}') AND trim(substr({0}, {4}, length({0}) - {2})) <> '')"
_UNWRAP = [("bold", "**", "**"), ("code", "`", "`"), ("dollar", "$", "$"), ("paren_math", "\\(", "\\)"), ("bracket_math", "\\[", "\\]")]


def _wrap_case(column: str, value: str) -> str:
    """The first wrapper that may go: its name or what it holds."""
    out = ""
    for name, a, b in _UNWRAP:
        inside = f"substr({column}, {len(a) + 1}, length({column}) - {len(a) + len(b)})"
        out += f" WHEN {_WRAPPED.format(column, a, len(a) + len(b), b, len(a) + 1)} THEN " + (f"'outer_wrapper_removed:{name}'" if value == "name" else inside)
    return f"CASE{out} ELSE {'NULL' if value == 'name' else column} END"


@query(f"""WITH n AS (SELECT DISTINCT name FROM knowledge_objects WHERE trim(name) <> ''), d AS (SELECT name, unnest([name, '  **' || name || ' – x** ', '`' || name || '’s`', ' $' || name || '  (v)$', '\\(' || upper(name) || '\\)', '** **', '**' || name]) AS dressed FROM n),
    s1 AS (SELECT *, nfc_normalize(dressed) AS a FROM d WHERE trim(dressed) <> ''), s2 AS (SELECT *, translate(a, '‘’‛`´', repeat(chr(39), 5)) AS b FROM s1), s3 AS (SELECT *, translate(b, '‐‑‒–—―', '------') AS c FROM s2), s4 AS (SELECT *, trim(c) AS e FROM s3),
    s5 AS (SELECT *, {_wrap_case('e', 'inner')} AS f, {_wrap_case('e', 'name')} AS w FROM s4),
    s6 AS (SELECT *, CASE WHEN starts_with(f, ' ') THEN ' ' ELSE '' END || trim(regexp_replace(f, '\\s+', ' ', 'g')) || CASE WHEN ends_with(f, ' ') THEN ' ' ELSE '' END AS g FROM s5), s7 AS (SELECT *, replace(lower(g), 'ß', 'ss') AS h FROM s6)
    SELECT name, dressed, h || '|' || array_to_string(list_filter([CASE WHEN a <> dressed THEN 'unicode_normalization' END, CASE WHEN b <> a THEN 'apostrophe_normalization' END, CASE WHEN c <> b THEN 'dash_normalization' END, CASE WHEN e <> c THEN 'trim_whitespace' END, w,
        CASE WHEN g <> f THEN 'collapse_whitespace' END, CASE WHEN h <> g THEN 'casefold' END], lambda x: x IS NOT NULL), ',') AS audit FROM s7""")
def name_normalize_audit(spark: SparkSession, d: str) -> DataFrame:
    """All names of objects, as they are and in several wrappers."""
    names = table(spark, d, "knowledge_objects").select("name").filter("trim(name) <> ''").distinct()
    n, t = F.col("name"), F.lit
    dressed = F.array(n, F.concat(t("  **"), n, t(" – x** ")), F.concat(t("`"), n, t("’s`")), F.concat(t(" $"), n, t("  (v)$")), F.concat(t("\\("), F.upper(n), t("\\)")), t("** **"), F.concat(t("**"), n))
    rows = names.select("name", F.explode(dressed).alias("dressed")).withColumn("a", X.name_audit(F.col("dressed")))
    return rows.select("name", "dressed", F.concat_ws("|", "a.key", F.array_join("a.operations", ",")).alias("audit"))


@query("""SELECT pair_id, run_id, recorded_at, loaded_at, CAST(i - 1 AS INT) AS source_object_index, evidence_spans[i].lecture_id AS lecture_id, evidence_spans[i].span AS span
    FROM (SELECT *, unnest(range(1, len(evidence_spans) + 1)) AS i FROM relation_predictions)""")
def prediction_explode(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relation_predictions").select("pair_id", "run_id", "recorded_at", "loaded_at", F.posexplode("evidence_spans").alias("source_object_index", "s"))
    return r.select("pair_id", "run_id", "recorded_at", "loaded_at", "source_object_index", "s.lecture_id", "s.span")


@query(f"""SELECT printf('ko_mention_%08d', row_number() OVER (ORDER BY lecture_id, predicted_ko_id)) AS mention_id, lecture_id, predicted_ko_id, name, type, len(spans) AS n_spans,
    len(list_filter(spans, lambda x: x <> '' AND contains(coalesce(text, ''), x))) AS n_exact FROM {KO} k LEFT JOIN {LEC} l USING (lecture_id)""")
def mention_inventory(spark: SparkSession, d: str) -> DataFrame:
    k = objects(spark, d).join(lectures(spark, d).select("lecture_id", "text"), "lecture_id", "left")
    flags = F.transform("spans", lambda s: X.exact_span(F.col("text"), s))
    m = k.select("lecture_id", "predicted_ko_id", "name", "type", F.size("spans").cast("long").alias("n_spans"), F.size(F.filter(flags, lambda f: f)).cast("long").alias("n_exact"))
    m = pairs.numbered(m, ["lecture_id", "predicted_ko_id"])
    return m.select(M.sequence_id("ko_mention", F.col("no"), 8).alias("mention_id"), "lecture_id", "predicted_ko_id", "name", "type", "n_spans", "n_exact")


@query("SELECT a.s_nationkey AS \"group\", a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def pair_universe_local(spark: SparkSession, d: str) -> DataFrame:
    return pairs.local_universe(table(spark, d, "supplier"), "s_nationkey", "s_suppkey")


@query(f"SELECT lecture_id AS \"group\", count(*) AS n_objects, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS n_pairs FROM {KO} GROUP BY 1")
def pair_universe_counts(spark: SparkSession, d: str) -> DataFrame:
    return pairs.universe_counts(table(spark, d, "knowledge_objects"), "lecture_id", "predicted_ko_id")


_CANON = f"(SELECT {NAME_KEY.format('name')} AS k, list_sort(list_distinct(list(lecture_id))) AS l FROM {KO} GROUP BY 1)"
_NOUN = "regexp_extract(k, '[^ ]+$')"


def canonical_objects(spark: SparkSession, d: str) -> DataFrame:
    """Name key with its lectures; the last word of the name is the block."""
    k = objects(spark, d).groupBy(X.name_key_native(F.col("name")).alias("k")).agg(F.array_sort(F.collect_set("lecture_id")).alias("l"))
    return k.withColumn("noun", F.regexp_extract("k", "[^ ]+$", 0))


@query(f"""WITH p AS (SELECT lecture_id, max(course_id) AS c, max(topic_id) AS t FROM lectures GROUP BY 1),
    x AS (SELECT k, lecture_id, coalesce(c, '') AS c, coalesce(t, '') AS t FROM (SELECT DISTINCT {NAME_KEY.format('name')} AS k, lecture_id FROM {KO} WHERE lecture_id IS NOT NULL) LEFT JOIN p USING (lecture_id))
    SELECT a.k AS a, b.k AS b, 'pair_' || left(sha256('connection_pair_v0.1|' || a.k || '|' || b.k), 16) AS pair_id,
    CASE WHEN bool_or(a.lecture_id = b.lecture_id) THEN 'overlapping_provenance' ELSE 'disjoint_provenance' END AS stratum,
    bool_or(a.lecture_id <> b.lecture_id AND a.c = b.c) AS same_course_cross_lecture, bool_or(a.lecture_id <> b.lecture_id AND a.c <> b.c) AS cross_course,
    bool_or(a.lecture_id <> b.lecture_id AND a.t = b.t) AS same_topic_cross_lecture, bool_or(a.lecture_id <> b.lecture_id AND a.t <> b.t) AS cross_topic
    FROM x a JOIN x b ON a.k < b.k GROUP BY 1, 2 HAVING bool_or(a.lecture_id <> b.lecture_id)""")
def pair_universe_cross(spark: SparkSession, d: str) -> DataFrame:
    """The universe over all names, with scope flags."""
    k = objects(spark, d).select(X.name_key_native(F.col("name")).alias("k"), "lecture_id")
    places = table(spark, d, "lectures").groupBy(F.col("lecture_id").alias("lecture")).agg(F.max("course_id").alias("course"), F.max("topic_id").alias("topic"))
    return pairs.scoped_universe(k, "k", "lecture_id", places)


_ORD = "list_filter(" + WORDS.format("key") + ", lambda x: x <> 's')"
_SUB = "(len({0}) > 0 AND len({1}) > 0 AND list_has_all({1}, {0}) AND NOT list_has_all({0}, {1}))"
_INI = "(len({0}) = 1 AND length({0}[1]) >= 2 AND {0}[1] = array_to_string(list_transform({1}, lambda x: left(x, 1)), ''))"
_PLAIN = "replace(replace({0}, 'ï', 'i'), 'ö', 'o')"
_REASONS = f"""array_to_string(list_filter([
    CASE WHEN a.key = b.key THEN 'exact_normalized_name' END,
    CASE WHEN {_PLAIN.format('a.key')} = {_PLAIN.format('b.key')} AND a.key <> b.key THEN 'frozen_alias_identity' END,
    CASE WHEN a.w = b.w AND a.key <> b.key THEN 'name_token_equivalence' END,
    CASE WHEN {_INI.format('a.w', 'b.w')} OR {_INI.format('b.w', 'a.w')} THEN 'initialism_name_match' END,
    CASE WHEN {_SUB.format('a.w', 'b.w')} OR {_SUB.format('b.w', 'a.w')} THEN 'name_token_containment' END,
    CASE WHEN list_has_any(a.spans, b.spans) THEN 'exact_source_span' END], lambda x: x IS NOT NULL), ',')"""


@query(f"""WITH m AS (SELECT *, {_ORD} AS w FROM (SELECT *, lecture_id || '::' || predicted_ko_id AS id, {NAME_KEY.format('name')} AS key FROM {KO} WHERE type IS NOT NULL AND name IS NOT NULL))
    SELECT * FROM (SELECT a.id AS a, b.id AS b, {_REASONS} AS reasons FROM m a JOIN m b ON a.type = b.type AND a.id < b.id) WHERE reasons <> ''""")
def identity_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Over all lectures; names with a diaeresis are aliases of the plain ones, as in :func:`alias_clusters`."""
    k = objects(spark, d).withColumn("id", M.ref_label(F.col("lecture_id"), F.col("predicted_ko_id")))
    own = k.select(X.name_key_native(F.col("name")).alias("alias")).distinct()
    aliases = own.withColumn("alias_key", F.translate("alias", "ïö", "io")).filter("alias <> alias_key")
    return pairs.identity_candidates(k, None, "id", "type", "name", "spans", aliases).withColumn("reasons", F.array_join("reasons", ","))


@query("""SELECT a.s_nationkey AS "group", a.s_suppkey AS a, b.s_suppkey AS b, 'all_pairs' AS reason,
    'cand_' || left(sha256('connection_pair_v0.1|' || least(CAST(a.s_suppkey AS VARCHAR), CAST(b.s_suppkey AS VARCHAR)) || '|' || greatest(CAST(a.s_suppkey AS VARCHAR), CAST(b.s_suppkey AS VARCHAR))), 16) AS pair_id
    FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def all_pairs_selection(spark: SparkSession, d: str) -> DataFrame:
    u = pairs.local_universe(table(spark, d, "supplier"), "s_nationkey", "s_suppkey")
    return u.withColumn("reason", F.lit("all_pairs")).withColumn("pair_id", M.pair_id("cand_", F.col("a").cast("string"), F.col("b").cast("string")))


_LOCAL = f"(SELECT DISTINCT source.lecture_id AS lecture_id, source.ko_id AS a, target.ko_id AS b FROM {REL} WHERE source.lecture_id = target.lecture_id AND source.ko_id <> target.ko_id)"
_PLACES = f"""(SELECT k.lecture_id, k.predicted_ko_id, list(DISTINCT b.block_index) AS places
    FROM (SELECT lecture_id, predicted_ko_id, unnest(spans) AS s FROM {KO}) k JOIN {BLOCKS} b ON b.lecture_id = k.lecture_id AND k.s <> '' AND contains(b.span, k.s) GROUP BY 1, 2)"""


def located(spark: SparkSession, d: str) -> DataFrame:
    """The blocks in which an object's spans stand as they are."""
    spans = objects(spark, d).select("lecture_id", "predicted_ko_id", F.explode("spans").alias("needle"))
    blocks = evidence.block_rows(lectures(spark, d), "lecture_id", "text")
    held = matching.contained(spans, blocks, "lecture_id", "needle", "span")
    return held.select("lecture_id", "predicted_ko_id", "block_index").distinct()


def local_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = relations(spark, d).filter("source.lecture_id = target.lecture_id AND source.ko_id <> target.ko_id")
    return r.select("source.lecture_id", F.col("source.ko_id").alias("a"), F.col("target.ko_id").alias("b")).distinct()


_FT = NAME_KEY.format("regexp_replace(translate(nfc_normalize({0}), chr(160) || '，（）', ' ,()'), '\\\\[\\[\\]()]', ' ', 'g')")
_CUE = " OR ".join(f"contains(text, '{x}')" for x in pairs.CUES)
_LEX = f"CASE WHEN len({TOKENS}) > 0 THEN {TOKENS} ELSE list_distinct({WORDS}) END"
_SYMBOLS = """list_distinct(list_transform(flatten(list_transform(spans, lambda s: list_concat(regexp_extract_all(s, '\\\\[A-Za-z]+'), regexp_extract_all(s, '([A-Za-z]+)(?:_|\\()', 1), regexp_extract_all(regexp_replace(s, '[^\\p{L}\\p{N}_]', '  ', 'g'), '(?:^| )([A-Z][A-Z0-9]*)(?: |$)', 1)))), lambda x: lower(x)))"""


@query(f"""WITH bl AS (SELECT lecture_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n+'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS p FROM {LEC} WHERE text IS NOT NULL),
    bm AS (SELECT lecture_id, string_split(list_reduce(p, lambda x, y: CASE WHEN regexp_full_match(y, '(?s)(\\$\\$.*\\$\\$|\\\\\\[.*\\\\\\])') THEN x || chr(10) || chr(10) || y ELSE x || chr(1) || y END), chr(1)) AS q FROM bl WHERE len(p) > 0),
    bu AS (SELECT lecture_id, unnest(range(len(q))) AS i, unnest(q) AS b FROM bm), t AS (SELECT lecture_id, i, {_FT.format('b')} AS text FROM bu),
    o AS (SELECT lecture_id, predicted_ko_id AS id, {_FT.format('name')} AS name, spans, {_LEX.format(NAME_KEY.format('name'))} AS words, {_SYMBOLS} AS symbols FROM {KO} WHERE lecture_id IS NOT NULL AND predicted_ko_id IS NOT NULL),
    sp AS (SELECT lecture_id, id, unnest(spans) AS s FROM o), sf AS (SELECT DISTINCT lecture_id, id, {_FT.format('s')} AS n FROM sp WHERE s IS NOT NULL),
    bs AS (SELECT DISTINCT lecture_id, id, i FROM sf JOIN t USING (lecture_id) WHERE n <> '' AND contains(text, n)),
    pl AS (SELECT * FROM bs UNION ALL SELECT lecture_id, id, i FROM o JOIN t USING (lecture_id) WHERE name <> '' AND contains(text, name) AND NOT EXISTS (SELECT 1 FROM bs WHERE bs.lecture_id = o.lecture_id AND bs.id = o.id)),
    cu AS (SELECT lecture_id, i, {WORDS.format('text')} AS held FROM t WHERE {_CUE}),
    sd AS (SELECT lecture_id, id, i FROM o JOIN cu USING (lecture_id) WHERE list_has_all(held, words) UNION ALL SELECT lecture_id, id, i FROM pl SEMI JOIN cu USING (lecture_id, i)),
    la AS (SELECT lecture_id, id, list(DISTINCT i) AS pos FROM pl GROUP BY 1, 2), ls AS (SELECT lecture_id, id, list(DISTINCT i) AS said FROM sd GROUP BY 1, 2),
    f AS (SELECT o.lecture_id, o.id, words, symbols, coalesce(pos, []) AS pos, coalesce(said, []) AS said FROM o LEFT JOIN la USING (lecture_id, id) LEFT JOIN ls USING (lecture_id, id)),
    r AS (SELECT a.lecture_id, a.id AS a, b.id AS b, array_to_string(list_filter([
        CASE WHEN list_has_any(list_concat(a.pos, list_transform(a.pos, lambda x: x - 1), list_transform(a.pos, lambda x: x + 1)), b.pos) THEN 'source_proximity' END, CASE WHEN list_has_any(a.words, b.words) THEN 'lexical_overlap' END,
        CASE WHEN list_has_any(a.symbols, b.symbols) THEN 'symbol_overlap' END, CASE WHEN list_has_any(a.said, b.said) THEN 'explicit_reference' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f a JOIN f b ON a.lecture_id = b.lecture_id AND a.id < b.id)
    SELECT lecture_id, a, b, reasons <> '' AS selected, reasons, CASE WHEN reasons = '' THEN 'no_rule_triggered' END AS exclusion_reason FROM r""")
def rule_filtered_selection(spark: SparkSession, d: str) -> DataFrame:
    """All four rules over every pair inside a lecture, with the pairs left out. The SQL has no NFKC, which the tables' names and spans do not need."""
    blocks = evidence.block_rows(lectures(spark, d), "lecture_id", "text", X.math_blocks)
    return pairs.rule_decisions(objects(spark, d), blocks, "lecture_id", "predicted_ko_id", "name", "spans", joined=",")


_IDF = f"""(SELECT token, count(*) AS df, ln(((SELECT count(*) FROM {_CANON}) + 1) / (count(*) + 1)) + 1 AS idf
    FROM (SELECT unnest({TOKENS.format('k')}) AS token FROM {_CANON}) GROUP BY 1)"""


@query(f"SELECT token, df, round(idf, 9) AS idf FROM {_IDF}")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    k = canonical_objects(spark, d).withColumn("tokens", X.token_set(F.col("k")))
    return pairs.idf(k, "k", "tokens").withColumn("idf", F.round("idf", 9))


_PART = f"""o AS (SELECT p_brand, p_type, p_name, {TOKENS.format('p_name')} AS t FROM (SELECT DISTINCT p_brand, p_type, p_name FROM part)),
    w AS (SELECT token, ln(((SELECT count(*) FROM o) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT unnest(t) AS token FROM o) GROUP BY 1),
    u AS (SELECT a.p_brand, a.p_type, a.p_name AS a, b.p_name AS b, a.t AS ta, b.t AS tb FROM o a JOIN o b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_name < b.p_name WHERE list_has_any(a.t, b.t)),
    s AS (SELECT p_brand, p_type, a, b, len(list_intersect(ta, tb)) AS n_shared,
        round((SELECT sum(idf) FROM w WHERE list_contains(list_intersect(ta, tb), token)) / (SELECT sum(idf) FROM w WHERE list_contains(list_concat(ta, tb), token)), 12) AS weighted_jaccard FROM u)"""


def _part_scores(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one name are copies: a name stands for them once per block, so pairs grow with the vocabulary, not with the table."""
    p = table(spark, d, "part").select("p_brand", "p_type", "p_name").distinct().withColumn("tokens", X.token_set(F.col("p_name")))
    return pairs.weighted_jaccard(p, ["p_brand", "p_type"], "p_name", "tokens", pairs.idf(p, "p_name", "tokens"))


@query(f"WITH {_PART} SELECT p_brand, p_type, a, b, n_shared, round(weighted_jaccard, 9) AS weighted_jaccard FROM s")
def weighted_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _part_scores(spark, d).withColumn("weighted_jaccard", F.round("weighted_jaccard", 9))


_BLOCKED = f"""{_PART}, e AS (SELECT a.p_brand, a.p_type, a.p_name AS a, b.p_name AS b FROM o a JOIN o b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_name < b.p_name),
    f AS (SELECT e.*, coalesce(n_shared, 0) AS n_shared, round(coalesce(weighted_jaccard, 0), 9) AS weighted_jaccard FROM e LEFT JOIN s USING (p_brand, p_type, a, b)),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY weighted_jaccard DESC, a, b) AS rank, count(*) OVER (PARTITION BY p_brand, p_type) AS n FROM f)"""
_KEPT = "rank <= greatest(1, CAST(floor(n * 0.8) AS BIGINT))"
_BLOCK = ["p_brand", "p_type"]


def _part_sizes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_type", "p_name").distinct()
    return pairs.universe_counts(p.withColumn("block", F.struct("p_brand", "p_type")), "block", "p_name").select("group.*", "n_pairs")


@query(f"WITH {_BLOCKED} SELECT p_brand, p_type, a, b, n_shared, weighted_jaccard, rank FROM r WHERE n_shared > 0 AND {_KEPT}")
def topk_retention(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the top four fifths of all pairs of a block by weighted overlap; here those that share a token, :func:`topk_tail` has the rest."""
    s = pairs.ranked(weighted_jaccard(spark, d), "weighted_jaccard", ["a", "b"], _BLOCK)
    return pairs.top_fraction(s, _part_sizes(spark, d), 0.8, _BLOCK)


@query(f"WITH {_BLOCKED} SELECT p_brand, p_type, n AS n_pairs, count(*) FILTER ({_KEPT}) AS n_kept, count(*) FILTER (n_shared = 0) AS n_zero, count(*) FILTER (n_shared = 0 AND {_KEPT}) AS n_zero_kept FROM r GROUP BY p_brand, p_type, n")
def topk_tail(spark: SparkSession, d: str) -> DataFrame:
    """Per block how many pairs there are and are kept, and how many of those of score 0; these are kept in the order of their ids."""
    made = weighted_jaccard(spark, d).groupBy(*_BLOCK).agg(F.count("*").alias("n_met"))
    c = F.col
    sizes = _part_sizes(spark, d).filter("n_pairs > 0").join(made, _BLOCK, "left").fillna(0, ["n_met"]).withColumn("n_kept", F.greatest(F.lit(1), F.floor(c("n_pairs") * F.lit(0.8))))
    return sizes.select(*_BLOCK, "n_pairs", "n_kept", (c("n_pairs") - c("n_met")).alias("n_zero"), F.greatest(F.lit(0), c("n_kept") - c("n_met")).alias("n_zero_kept"))


def _universe(share: str) -> str:
    """All eligible pairs with their scores and ranks; no filter on tokens or lectures."""
    return f"""o AS (SELECT k, l, ty, {TOKENS.format('k')} AS t FROM (SELECT {NAME_KEY.format('name')} AS k, min(type) AS ty, list_sort(list_distinct(list(lecture_id))) AS l FROM {KO} GROUP BY 1)), w AS {_IDF},
    s AS (SELECT a.k AS a, b.k AS b, round((SELECT sum(idf) FROM w WHERE list_contains(list_intersect(a.t, b.t), token)) / (SELECT sum(idf) FROM w WHERE list_contains(list_concat(a.t, b.t), token)), 12) AS wj
        FROM o a JOIN o b ON a.k < b.k AND list_has_any(a.t, b.t)),
    e AS (SELECT a.k AS a, b.k AS b, list_has_any(a.l, b.l) AS shared, a.ty IS DISTINCT FROM b.ty AS differ FROM o a JOIN o b ON a.k < b.k WHERE NOT (len(a.l) = 1 AND len(b.l) = 1 AND a.l[1] = b.l[1])),
    f AS (SELECT e.*, wj IS NOT NULL AS met, round(coalesce(wj, 0) + CASE WHEN differ THEN 0.03 ELSE 0 END + {share}, 9) AS score FROM e LEFT JOIN s USING (a, b)),
    r AS (SELECT *, row_number() OVER (ORDER BY score DESC, a, b) AS rank, count(*) OVER () AS n FROM f), k AS (SELECT *, {_KEPT} AS kept FROM r)"""


_HYBRID, _LEXICAL = _universe("CASE WHEN shared THEN 1 ELSE 0 END"), _universe("0")
_PAIRS_OF = "SELECT a, b, CASE WHEN shared THEN 'overlapping_provenance' ELSE 'disjoint_provenance' END AS stratum, score, CASE WHEN score > 0.03 THEN rank END AS rank FROM k WHERE kept AND {0}"
_TAIL_OF = """SELECT CAST(score AS DOUBLE) AS score, count(*) AS n_pairs, count(*) FILTER (kept) AS n_kept, CASE WHEN bool_or(kept) AND NOT bool_and(kept) THEN arg_max(a, rank) FILTER (kept) END AS last_a,
    CASE WHEN bool_or(kept) AND NOT bool_and(kept) THEN arg_max(b, rank) FILTER (kept) END AS last_b FROM k WHERE NOT ({0}) GROUP BY 1"""


def _candidates(spark: SparkSession, d: str, method: str) -> tuple[DataFrame, DataFrame]:
    """A method over all names; a name's type is the least of its objects' types."""
    k = objects(spark, d).groupBy(X.name_key_native(F.col("name")).alias("k")).agg(F.collect_set("lecture_id").alias("l"), F.min("type").alias("type")).withColumn("tokens", X.token_set(F.col("k")))
    return pairs.connection_candidates(k, "k", "l", "tokens", method, kind="type")


@query(f"WITH {_HYBRID} {_PAIRS_OF.format('(met OR shared)')}")
def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid method over all names: the kept pairs that share a token or a lecture; :func:`hybrid_tail` has the rest."""
    return _candidates(spark, d, "hybrid_provenance_lexical")[0]


@query(f"WITH {_HYBRID} {_TAIL_OF.format('met OR shared')}")
def hybrid_tail(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d, "hybrid_provenance_lexical")[1]


@query(f"WITH {_LEXICAL} {_PAIRS_OF.format('met')}")
def lexical_rank(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d, "lexical_only")[0]


@query(f"WITH {_LEXICAL} {_TAIL_OF.format('met')}")
def lexical_tail(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d, "lexical_only")[1]


@query(f"WITH {_LEXICAL} SELECT a, b, 'overlapping_provenance' AS stratum, CAST(1 AS DOUBLE) AS score, row_number() OVER (ORDER BY a, b) AS rank FROM k WHERE shared")
def overlap_bridge(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d, "overlap_bridge")[0]


def _clusters(spark: SparkSession, d: str, keyed: DataFrame) -> DataFrame:
    m = keyed.withColumn("mention", M.ref_label(F.col("lecture_id"), F.col("predicted_ko_id")))
    c = clusters.group_clusters(m, "type", "key", "mention", "name", "mention")
    return c.select("type", "identity_key", "canonical_name", "first_seen", F.col("n_mentions").cast("long").alias("n_mentions"), F.array_join("mention_ids", "|").alias("mention_ids"), "cluster_id")


_CLUSTERS = """SELECT type, key AS identity_key, min_by(name, m) AS canonical_name, min(m) AS first_seen, count(DISTINCT m) AS n_mentions, array_to_string(list_sort(list(m)), '|') AS mention_ids,
    'ko_cluster_' || left(sha256('{"identity_key":' || CAST(to_json(key) AS VARCHAR) || ',"mention_ids":' || CAST(to_json(list_sort(list(m))) AS VARCHAR) || ',"type":' || coalesce(CAST(to_json(type) AS VARCHAR), 'null') || '}'), 16) AS cluster_id FROM ks GROUP BY type, key"""


@query(f"WITH ks AS (SELECT *, {NAME_KEY.format('name')} AS key, lecture_id || '::' || predicted_ko_id AS m FROM {KO}) {_CLUSTERS}")
def exact_name_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d, objects(spark, d).withColumn("key", X.name_key_native(F.col("name"))))


@query(f"""WITH ks AS (SELECT *, replace(replace({NAME_KEY.format('name')}, 'ï', 'i'), 'ö', 'o') AS key, lecture_id || '::' || predicted_ko_id AS m FROM {KO}) {_CLUSTERS}""")
def alias_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Names with a diaeresis are aliases of the plain ones; a dictionary lookup that defaults to the key itself."""
    k = objects(spark, d).withColumn("own", X.name_key_native(F.col("name")))
    aliases = k.select("own", F.translate("own", "ïö", "io").alias("to")).filter("own <> to").distinct()
    return _clusters(spark, d, k.join(aliases, "own", "left").withColumn("key", F.coalesce("to", "own")))


_SAME = "(SELECT mention_a AS a, mention_b AS b FROM identity_decisions WHERE decision = 'SAME_OBJECT' AND mention_a <> mention_b)"
_COMPONENTS = f"""e AS (SELECT a, b FROM {_SAME} UNION SELECT b, a FROM {_SAME}),
    n AS (SELECT mention_a AS x FROM identity_decisions UNION SELECT mention_b FROM identity_decisions),
    reach(x, y) AS (SELECT x, x FROM n WHERE x IS NOT NULL UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y),
    c AS (SELECT x AS node, min(y) AS component FROM reach GROUP BY 1)"""


def _components(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "identity_decisions")
    nodes = i.select(F.explode(F.array("mention_a", "mention_b")).alias("node"))
    return clusters.components(i.filter("decision = 'SAME_OBJECT'"), "mention_a", "mention_b", nodes)


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT node, component FROM c")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d)


@query(f"""WITH RECURSIVE {_COMPONENTS} SELECT DISTINCT mention_a AS a, mention_b AS b, x.component FROM identity_decisions
    JOIN c x ON x.node = mention_a JOIN c y ON y.node = mention_b WHERE decision = 'DISTINCT_OBJECT' AND x.component = y.component""")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    distinct = table(spark, d, "identity_decisions").filter("decision = 'DISTINCT_OBJECT'")
    return clusters.contradictions(_components(spark, d), distinct, "mention_a", "mention_b")


@query(f"""WITH RECURSIVE s AS (SELECT DISTINCT 'l:' || mention_a AS u, 'r:' || mention_b AS v, mention_a, mention_b FROM identity_decisions WHERE decision = 'SAME_OBJECT' AND mention_a IS NOT NULL AND mention_b IS NOT NULL),
    e AS (SELECT u, v FROM s UNION SELECT v, u FROM s), reach(x, y) AS (SELECT u, u FROM e UNION SELECT reach.x, e.v FROM reach JOIN e ON e.u = reach.y),
    c AS (SELECT x, count(*) FILTER (starts_with(y, 'l:')) AS n_left, count(*) FILTER (starts_with(y, 'r:')) AS n_right FROM reach GROUP BY 1)
    SELECT mention_a AS "left", mention_b AS "right", n_left, n_right, CASE WHEN n_left = 1 AND n_right = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM s JOIN c ON c.x = s.u""")
def bipartite_components(spark: SparkSession, d: str) -> DataFrame:
    same = table(spark, d, "identity_decisions").filter("decision = 'SAME_OBJECT' AND mention_a IS NOT NULL AND mention_b IS NOT NULL")
    return clusters.bipartite(same, "mention_a", "mention_b")


_PAIR_LECTURES = f"(SELECT DISTINCT pair_id, unnest([source.lecture_id, target.lecture_id]) AS lecture_id FROM {REL})"
_CATALOG = f"(SELECT pair_id, lecture_id, block_index, span, printf('evidence_%03d', row_number() OVER (PARTITION BY pair_id ORDER BY lecture_id, block_index)) AS evidence_id FROM {_PAIR_LECTURES} JOIN {BLOCKS} USING (lecture_id))"


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    p = relations(spark, d).select("pair_id", F.explode(F.array("source.lecture_id", "target.lecture_id")).alias("lecture_id"))
    return evidence.catalog(p, evidence.block_rows(lectures(spark, d), "lecture_id", "text"), "pair_id", "lecture_id")


@query(f"SELECT pair_id, lecture_id, CAST(block_index AS INT) AS block_index, evidence_id, md5(span) AS span_md5 FROM {_CATALOG}")
def evidence_catalog(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).select("pair_id", "lecture_id", "block_index", "evidence_id", F.md5("span").alias("span_md5"))


_COVERED = f"""(SELECT pair_id, lecture_id, block_index, bool_or(side = 'a') AS a, bool_or(side = 'b') AS b FROM (
    SELECT r.pair_id, pl.lecture_id, unnest(pl.places) AS block_index, 'a' AS side FROM {REL} r JOIN {_PLACES} pl ON pl.lecture_id = r.source.lecture_id AND pl.predicted_ko_id = r.source.ko_id
    UNION ALL SELECT r.pair_id, pl.lecture_id, unnest(pl.places), 'b' FROM {REL} r JOIN {_PLACES} pl ON pl.lecture_id = r.target.lecture_id AND pl.predicted_ko_id = r.target.ko_id) GROUP BY 1, 2, 3)"""


@query(f"""WITH p AS (SELECT DISTINCT pair_id, lecture_id FROM {_COVERED}),
    g AS (SELECT p.pair_id, p.lecture_id, b.block_index AS i, coalesce(c.a, false) AS a, coalesce(c.b, false) AS b FROM p JOIN {BLOCKS} b USING (lecture_id) LEFT JOIN {_COVERED} c ON c.pair_id = p.pair_id AND c.lecture_id = p.lecture_id AND c.block_index = b.block_index),
    w AS (SELECT s.pair_id, s.lecture_id, s.i AS s, t.i AS e FROM g s JOIN g t ON t.pair_id = s.pair_id AND t.lecture_id = s.lecture_id AND t.i BETWEEN s.i AND s.i + 2
        WHERE (SELECT bool_or(x.a) AND bool_or(x.b) FROM g x WHERE x.pair_id = s.pair_id AND x.lecture_id = s.lecture_id AND x.i BETWEEN s.i AND t.i))
    SELECT pair_id, lecture_id, CAST(s AS INT) AS start, CAST(e AS INT) AS "end" FROM w WHERE NOT EXISTS (SELECT 1 FROM w v WHERE v.pair_id = w.pair_id AND v.lecture_id = w.lecture_id AND v.s >= w.s AND v.e <= w.e AND (v.s > w.s OR v.e < w.e))""")
def evidence_windows_minimal(spark: SparkSession, d: str) -> DataFrame:
    r, at = relations(spark, d), located(spark, d)
    side = lambda s: r.select("pair_id", F.col(f"{s}.lecture_id").alias("lecture_id"), F.col(f"{s}.ko_id").alias("predicted_ko_id"), F.lit(s == "source").alias("a"), F.lit(s == "target").alias("b"))
    held = side("source").unionByName(side("target")).join(at, ["lecture_id", "predicted_ko_id"]).select("pair_id", "lecture_id", "block_index", "a", "b")
    every = held.select("pair_id", "lecture_id").distinct().join(evidence.block_rows(lectures(spark, d), "lecture_id", "text"), "lecture_id")
    rows = held.unionByName(every.select("pair_id", "lecture_id", "block_index", F.lit(False).alias("a"), F.lit(False).alias("b")))
    return evidence.minimal_windows(rows, "pair_id", "lecture_id", "block_index", "a", "b")


@query(f"SELECT lecture_id, predicted_ko_id, CAST(unnest(places) AS INT) AS block_index FROM {_PLACES}")
def containment_join(spark: SparkSession, d: str) -> DataFrame:
    return located(spark, d)


@query(f"""SELECT lecture_id, len({BLOCK_LIST}) AS n_blocks, len(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda x: {STRIP.format('x')}), lambda x: x <> ''))) AS n_exact,
    len(list_filter(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n+'), lambda x: {STRIP.format('x')}), lambda x: x <> ''), lambda x, i: i = 1 OR NOT regexp_full_match(x, '(?s)(\\$\\$.*\\$\\$|\\\\\\[.*\\\\\\])'))) AS n_math FROM {LEC} WHERE text IS NOT NULL""")
def block_splitters(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    n = lambda c: F.size(c).cast("long")
    return lectures(spark, d).filter("text IS NOT NULL").select("lecture_id", n(X.blocks(t)).alias("n_blocks"), n(X.exact_blocks(t)).alias("n_exact"), n(X.math_blocks(t)).alias("n_math"))


@query(f"""SELECT lecture_id, predicted_ko_id, array_to_string(list_sort({TOKENS.format('name')}), ' ') AS tokens, array_to_string(list_transform({WORDS.format('name')}, lambda x: left(x, 1)), '') AS initials,
    array_to_string(list_sort(list_distinct(list_transform(flatten(list_transform(spans, lambda s: regexp_extract_all(s, '\\\\[A-Za-z]+'))), lambda x: lower(x)))), ' ') AS commands,
    regexp_full_match(predicted_ko_id, '[a-z_]+_\\d{{1,3}}') AS short_id, lecture_id || '::' || predicted_ko_id AS label FROM {KO}""")
def token_functions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return objects(spark, d).select(
        "lecture_id", "predicted_ko_id", F.array_join(F.array_sort(X.token_set(n)), " ").alias("tokens"), X.initials(X.words(n)).alias("initials"),
        F.array_join(F.array_sort(X.symbol_tokens(F.col("spans"), [r"\\[A-Za-z]+"])), " ").alias("commands"),
        M.matches_whole(F.col("predicted_ko_id"), r"[a-z_]+_\d{1,3}").alias("short_id"), M.ref_label(F.col("lecture_id"), F.col("predicted_ko_id")).alias("label"),
    )


_MULTI = "list_sort(evidence_ids)"


@query(f"""SELECT a.canonical_pair_id, {_MULTI.replace('evidence_ids', 'a.evidence_ids')} = {_MULTI.replace('evidence_ids', 'b.evidence_ids')} AS same_multiset,
    list_sort(list_distinct(a.evidence_ids)) = list_sort(list_distinct(b.evidence_ids)) AS same_set,
    len(list_distinct(a.evidence_ids)) < len(list_distinct(b.evidence_ids)) AND list_has_all(b.evidence_ids, a.evidence_ids) AS proper_subset
    FROM {CON} a JOIN {CON.replace('connection_predictions', 'connection_predictions_copy')} b USING (canonical_pair_id) WHERE a.evidence_ids IS NOT NULL AND b.evidence_ids IS NOT NULL""")
def evidence_set_compare(spark: SparkSession, d: str) -> DataFrame:
    a = connections(spark, d).select("canonical_pair_id", F.col("evidence_ids").alias("x"))
    b = connections(spark, d, "_copy").select("canonical_pair_id", F.col("evidence_ids").alias("y"))
    j = a.join(b, "canonical_pair_id").filter("x IS NOT NULL AND y IS NOT NULL")
    x, y = F.col("x"), F.col("y")
    return j.select(
        "canonical_pair_id", (M.evidence_multiset(x) == M.evidence_multiset(y)).alias("same_multiset"), (M.evidence_set(x) == M.evidence_set(y)).alias("same_set"), X.proper_subset(x, y).alias("proper_subset"),
    )


@query(f"""SELECT b.lecture_id, CAST(b.block_index AS INT) AS block_index, k.predicted_ko_id FROM {BLOCKS} b JOIN (SELECT lecture_id, predicted_ko_id, {NAME_KEY.format('name')} AS p FROM {KO}) k ON k.lecture_id = b.lecture_id
    WHERE (p <> '' AND contains(lower(regexp_replace(b.span, '\\s+', ' ', 'g')), p)) OR (len({WORDS.format('p')}) > 0 AND contains(' ' || array_to_string({WORDS.format('b.span')}, ' ') || ' ', ' ' || array_to_string({WORDS.format('p')}, ' ') || ' '))""")
def phrase_present(spark: SparkSession, d: str) -> DataFrame:
    b = evidence.block_rows(lectures(spark, d), "lecture_id", "text").withColumn("t", F.lower(X.squeezed(F.col("span"))))
    k = objects(spark, d).select("lecture_id", "predicted_ko_id", X.name_key_native(F.col("name")).alias("p"))
    return b.join(k, "lecture_id").filter(X.phrase_present(F.col("p"), F.col("t"))).select("lecture_id", "block_index", "predicted_ko_id")


@query(f"""WITH o AS (SELECT lecture_id, predicted_ko_id, places FROM {_PLACES})
    SELECT p.lecture_id, p.a, p.b, (SELECT CAST(min(abs(x.i - y.i)) AS INT) FROM (SELECT unnest(u.places) AS i) x, (SELECT unnest(v.places) AS i) y) AS distance
    FROM {_LOCAL} p JOIN o u ON u.lecture_id = p.lecture_id AND u.predicted_ko_id = p.a JOIN o v ON v.lecture_id = p.lecture_id AND v.predicted_ko_id = p.b""")
def min_distance(spark: SparkSession, d: str) -> DataFrame:
    at = located(spark, d).groupBy("lecture_id", "predicted_ko_id").agg(F.collect_set("block_index").alias("at"))
    side = lambda s: at.select("lecture_id", F.col("predicted_ko_id").alias(s), F.col("at").alias(f"at_{s}"))
    j = local_pairs(spark, d).join(side("a"), ["lecture_id", "a"]).join(side("b"), ["lecture_id", "b"])
    return j.select("lecture_id", "a", "b", M.min_distance(F.col("at_a"), F.col("at_b")).alias("distance"))
