"""Named queries over the operators of this folder, with production parameters, and SQL for the same rows where SQL can state them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathscreen.llm import (byte_pairs, chosen_path, class_lm, curriculum, filter_audit, host_rules, license_templates, license_texts, merkle, page_diff, segment_popcounts, snapshots, token_files,
                            wu_manber)
from pathscreen.llm.common import table

END_ID = 2


def vocabulary() -> str:
    """The public vocabulary file that the queries use; the operators take any path."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules.host_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    m = F.col("_measures")
    return out.select("doc_id", *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), F.col("_base_failed").alias("base_failed"),
                      F.col("_host_rejected").alias("host_rejected"), F.col("_kept").alias("kept"))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.class_scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = curriculum.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.element_at(F.when(F.size("positions") > 0, F.col("positions")), 1).alias("first_position"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_tokens(spark, *token_files.write_tokens(table(spark, sf_dir, "documents"), vocabulary(), END_ID))


def op5_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.maximal_conversations(table(spark, sf_dir, "conversations"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wu_manber.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    leak = F.col(wu_manber.RESULT)
    hit = F.aggregate(leak["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select("doc_id", leak["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(leak["items"]).cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort(leak["items"]), ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_templates.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    every = F.col(license_templates.RESULT)["places"]
    base = F.filter(every, lambda p: ~p["template"])
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    score = F.when(F.exists(every, lambda p: p["template"]), 1.0).when(F.size(every) > 0, 0.5).otherwise(0.0)
    return found.select("doc_id", F.col(license_templates.RESULT)["n_words"].alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda p: p["first"])).alias("first_word"),
                        F.array_max(F.transform(base, lambda p: p["first"])).alias("last_word"), names(base).alias("base_labels"), names(every).alias("labels"), score.alias("score"))


def op7_license_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts count 1, notices 0.75 and base phrases 0.5; the phrases are those of op7_license_scan."""
    found = license_texts.license_texts(license_templates.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")))
    every, phrases = F.col(license_texts.RESULT)["places"], F.filter(F.col(license_templates.RESULT)["places"], lambda p: ~p["template"])
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    whole, notices = F.filter(every, lambda p: p["whole"]), F.filter(every, lambda p: ~p["whole"])
    score = F.when(F.size(whole) > 0, 1.0).when(F.size(notices) > 0, 0.75).when(F.size(phrases) > 0, 0.5).otherwise(0.0)
    return found.select("doc_id", F.col(license_texts.RESULT)["n_words"].alias("n_words"), names(whole).alias("whole_labels"), names(notices).alias("notice_labels"), names(phrases).alias("base_labels"), score.alias("score"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.main_texts(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.token_counts(table(spark, sf_dir, "documents"), vocabulary()).withColumn("over_limit", F.col("n_tokens") > 512)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_popcounts.near_duplicates(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_audit(filter_audit.document_facts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf is proven against the root; of each seventh document (by hash of the id) one that says a character more is tried instead."""
    c = {name: F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")}
    forged = F.when(F.crc32(c["doc_id"].cast("string")) % 7 == 0, merkle.record_hash(*(c | {"n_chars": c["n_chars"] + 1}).values()))
    leaves = table(spark, sf_dir, "documents").select("doc_id", merkle.group_key(c["lang"]).alias("group"), merkle.record_hash(*c.values()).alias("leaf"), forged.alias("forged"))
    out = merkle.manifest(leaves, ["doc_id", "leaf"]).withColumn("folded_root", merkle.folded(F.coalesce("forged", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_class_lm, op3_mixing, op4_token_files, op5_chat_snapshots, op6_decontamination, op7_license_scan, op7_license_texts, op8_main_text,
                                   op9_token_counts, op10_near_duplicates, op11_simhash, op12_filter_audit, op13_manifest, pipeline)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _host_sql() -> str:
    rules = {"short": "n_words < 50", "repeat": "100 * n_repeat_words > 50 * n_words", "lines": "10 * n_dup_lines > 3 * n_lines", "symbols": "10 * n_symbols > n_words",
             "letters": "word_chars < 2 * n_words OR word_chars > 15 * n_words"}
    long = " UNION ALL ".join(f"SELECT source, '{r}' AS rule, count(*) AS n, count(*) FILTER ({c}) AS f FROM m GROUP BY source" for r, c in rules.items())
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    g AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
    m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
          (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
          coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
    f AS ({long}),
    p AS (SELECT rule, sum(f)::DOUBLE / sum(n) AS mean, sum(n)::DOUBLE AS all_n, count(*) AS hosts, sum(n::DOUBLE * n) AS sq, sum(f::DOUBLE * f / n) - sum(f)::DOUBLE * sum(f) / sum(n) AS spread FROM f GROUP BY rule),
    e AS (SELECT rule, mean, (spread - (hosts - 1) * mean * (1 - mean)) / nullif(greatest(all_n - sq / all_n, 0), 0) AS excess FROM p),
    k AS (SELECT rule, mean, CASE WHEN excess > 0 THEN greatest(1.0::DOUBLE, least({host_rules.MOST_STRENGTH}::DOUBLE, mean * (1 - mean) / excess - 1)) ELSE {host_rules.MOST_STRENGTH}::DOUBLE END AS strength FROM e),
    v AS (SELECT source, bool_or((f + mean * strength) / (n + strength) > {host_rules.HOST_LIMIT}::DOUBLE) AS host_rejected FROM f JOIN k USING (rule) GROUP BY source),
    b AS (SELECT m.*, host_rejected, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected, NOT base_failed AND NOT host_rejected AS kept FROM b"""


def _license_sql() -> str:
    phrases = [f"SELECT '{p}' AS phrase, '{label}' AS label" for p, label in license_templates.PHRASES.items()]
    templates = [f"SELECT '{label}' AS label, ' {license_templates.template_pattern(t)}' AS pattern" for label, t in license_templates.TEMPLATES.items()]
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM} AS w FROM documents),
    j AS (SELECT rid, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d),
    p AS ({' UNION ALL '.join(phrases)}),
    h AS (SELECT rid, label, unnest(list_filter(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase)) - 1 AS pos FROM j JOIN p ON contains(t, ' ' || phrase || ' ')),
    m AS (SELECT rid, label FROM j JOIN ({' UNION ALL '.join(templates)}) ON regexp_matches(t, pattern)),
    b AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY rid),
    a AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, bool_or(whole) AS whole FROM (SELECT rid, label, false AS whole FROM h UNION ALL SELECT rid, label, true FROM m) GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           CASE WHEN whole THEN 1.0 WHEN labels IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE AS score
    FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)"""


def _audit_sql() -> str:
    """Every order is tried on every set of failures."""
    letters = "(SELECT unnest(string_split('A,B,C,D,E', ',')) AS l)"
    return rf"""
    WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
               doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy FROM documents),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
          || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
          || CASE WHEN copy THEN 'E' ELSE '' END AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
    m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, fails),
    o AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM {letters} a JOIN {letters} b ON b.l <> a.l JOIN {letters} c ON c.l NOT IN (a.l, b.l) JOIN {letters} d ON d.l NOT IN (a.l, b.l, c.l)
          JOIN {letters} e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
    z AS (SELECT m.*, o, CASE WHEN fails = '' THEN 9 ELSE 1 + length(regexp_extract(o, '^[^' || fails || 'Z]*')) END AS hit FROM m, o),
    r AS (SELECT part, o, s, substr(o, s, 1) AS filter, coalesce(sum(n) FILTER (hit > s), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit = s), 0)::BIGINT AS removed,
          coalesce(sum(n) FILTER (hit < s AND contains(fails, substr(o, s, 1))), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = substr(o, s, 1)), 0)::BIGINT AS unique_fails,
          coalesce(sum(g) FILTER (hit = s), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (hit = s), 0)::BIGINT AS toxic_lost FROM z, (SELECT unnest(range(1, 6))::INTEGER AS s) GROUP BY part, o, s)
    SELECT part, o AS filter_order, s AS step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r"""


def _manifest_sql() -> str:
    """Level by level, and each document's fold step by step; crc32 bit by bit, as DuckDB has none."""
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce({bits}, lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295), 4294967295)"
    own = lambda chars: "sha256(" + " || ".join(f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')" for x in ("doc_id", "source", "lang", chars, "text")) + ")"
    up = lambda rows: f"SELECT g, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {rows}) WHERE c > 1 GROUP BY g, lvl, pos // 2"
    return rf"""
    WITH RECURSIVE e AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS g, {own('n_chars')} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {own('(n_chars + 1)')} END AS forged FROM documents),
    l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM e),
    n(g, lvl, pos, h) AS (SELECT g, 0, pos, leaf FROM l UNION ALL {up('n')}),
    t AS MATERIALIZED (SELECT g, max(lvl) AS top, arg_max(h, lvl) AS subroot FROM n GROUP BY g),
    q AS MATERIALIZED (SELECT g AS sub, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, subroot FROM t),
    u(g, lvl, pos, h) AS (SELECT 0, 0, pos, subroot FROM q UNION ALL {up('u')}),
    v AS MATERIALIZED (SELECT max(lvl) AS top, arg_max(h, lvl) AS root FROM u),
    s AS (SELECT rid, lvl, pos >> lvl AS p, g FROM l JOIN t USING (g), (SELECT unnest(range(0, 64)) AS lvl) WHERE lvl < top),
    x AS (SELECT rid, s.lvl AS k, s.p % 2 = 1 AS behind, coalesce(n.h, '') AS h FROM s LEFT JOIN n ON n.g = s.g AND n.lvl = s.lvl AND n.pos = xor(s.p, 1)
          UNION ALL SELECT rid, 100 + k, (q.pos >> k) % 2 = 1, coalesce(u.h, '') FROM l JOIN q ON q.sub = l.g JOIN (SELECT unnest(range(0, 64)) AS k) ON true JOIN v ON k < v.top
          LEFT JOIN u ON u.lvl = k AND u.pos = xor(q.pos >> k, 1)),
    y AS MATERIALIZED (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY k) AS k, behind, h FROM x),
    f(rid, k, a) AS (SELECT rid, 0, coalesce(forged, leaf) FROM l UNION ALL SELECT f.rid, f.k + 1, sha256(CASE WHEN behind THEN y.h || a ELSE a || y.h END) FROM f JOIN y ON y.rid = f.rid AND y.k = f.k + 1),
    w AS (SELECT rid, arg_max(a, k) AS folded_root FROM f GROUP BY rid),
    p AS (SELECT rid, sha256(string_agg(h, '' ORDER BY k)) AS proof FROM y GROUP BY rid)
    SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM l JOIN t USING (g) JOIN v ON true JOIN w USING (rid) LEFT JOIN p USING (rid)"""


ORACLES: dict[str, str] = {
    "op1_quality_rules": _host_sql(),
    "op5_chat_snapshots": r"""
    WITH u AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rank, count(*) OVER (PARTITION BY conv_id) AS n_turns,
                 '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS part, coalesce('t' || text, 'n') || coalesce('t' || role, 'n') AS own FROM u),
    s AS (SELECT conv_id, rank, n_turns, string_agg(part, '') OVER w AS text, string_agg(own, chr(31)) OVER w AS own FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY rank)),
    f AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, any_value(text) AS text, own FROM s WHERE rank = n_turns GROUP BY own, n_turns)
    SELECT conv_id, n_turns, n_copies, text FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.rank = f.n_turns AND s.rank < s.n_turns AND s.own = f.own)""",
    "op6_decontamination": rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM} AS w FROM documents),
    b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_ALNUM} AS w FROM benchmark),
    i AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM b WHERE len(w) > 0)),
    n AS (SELECT DISTINCT n FROM i),
    x AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, n WHERE len(w) >= n)),
    h AS (SELECT rid, k, x.n, item FROM x JOIN i ON x.n = i.n AND x.win = i.win),
    p AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS q FROM h) GROUP BY rid),
    t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)""",
    "op7_license_scan": _license_sql(),
    "op12_filter_audit": _audit_sql(),
    "op13_manifest": _manifest_sql(),
    "op10_near_duplicates": rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS k FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT c.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
}
