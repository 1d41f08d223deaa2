"""Noise, stages, evaluation, events, tables (survey 2.1, 2.6, 2.10, 2.15, 2.18, 2.20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.operators import metrics, noise, stages
from lexmill.plans import sql as s
from lexmill.plans.registry import query
from lexmill.streaming import events as ev

_U = "(('0x' || substr(sha256('42:' || id || ':{kind}:{x}'), 1, 8))::BIGINT)::DOUBLE / 4294967296.0"
_P = "(floor(u2 * (length(x) - 1))::INT + 1)"
_H = "(floor(u2 * (length(x) - 3))::INT + 2)"
_EDIT = {
    "diacritics_all": f"translate(x, '{noise.PLAIN_OF[0]}', '{noise.PLAIN_OF[1]}')",
    "diacritics_partial": f"substr(x, 1, {_P} - 1) || translate(substr(x, {_P}, 1), '{noise.PLAIN_OF[0]}', '{noise.PLAIN_OF[1]}') || substr(x, {_P} + 1)",
    "qk_xh": f"substr(x, 1, {_P} - 1) || translate(substr(x, {_P}, 1), '{noise.QX[0]}', '{noise.QX[1]}') || substr(x, {_P} + 1)",
    "keyboard": f"substr(x, 1, {_P} - 1) || translate(substr(x, {_P}, 1), '{noise.KEYS[0]}', '{noise.KEYS[1]}') || substr(x, {_P} + 1)",
    "deletion": f"substr(x, 1, {_P} - 1) || substr(x, {_P} + 1)",
    "insertion": f"substr(x, 1, {_P}) || substr(x, {_P})",
    "transpose": f"substr(x, 1, {_P} - 1) || substr(x, {_P} + 1, 1) || substr(x, {_P}, 1) || substr(x, {_P} + 2)",
    "digraph": "replace(replace(replace(x, 'ş', 'sh'), 'ç', 'ch'), 'ğ', 'gh')",
    "space_split": f"substr(x, 1, {_H}) || ' ' || substr(x, {_H} + 1)",
    "hyphen": f"substr(x, 1, {_H}) || '-' || substr(x, {_H} + 1)",
}


def _noise_sql(kind: str) -> str:
    base = "(SELECT DISTINCT id, target AS t FROM data_row)"
    words = f"""(SELECT *, list_filter(range(0, len(w)), lambda i: regexp_matches(w[i + 1], '{noise.ELIGIBLE}')) AS el FROM (SELECT id, t, string_split(t, ' ') AS w, {_U.format(kind=kind, x='word')} AS u1, {_U.format(kind=kind, x='place')} AS u2 FROM {base}))"""
    picked = f"(SELECT *, el[floor(u1 * len(el))::INT + 1] AS i, w[el[floor(u1 * len(el))::INT + 1] + 1] AS x FROM {words})"
    if kind == "identity":
        noisy, source = "t", base
    elif kind == "punctuation":
        noisy, source = r"regexp_replace(t, '[.!?,;:]+\z', '')", base
    elif kind == "case":
        noisy, source = f"{s.lower('substr(t, 1, 1)')} || substr(t, 2)", base
    elif kind == "space_join":
        noisy, source = "CASE WHEN len(el) > 0 AND i < len(w) - 1 THEN array_to_string(list_concat(list_concat(w[1:i], [w[i + 1] || w[i + 2]]), w[i + 3:]), ' ') ELSE t END", picked
    else:
        noisy, source = f"CASE WHEN len(el) > 0 THEN array_to_string(list_concat(list_concat(w[1:i], [{_EDIT[kind]}]), w[i + 2:]), ' ') ELSE t END", picked
    return f"SELECT id, noisy, CASE WHEN noisy = t THEN 'identity' WHEN t IS NOT NULL THEN '{kind}' END AS category FROM (SELECT id, t, {noisy} AS noisy FROM {source})"


for _kind in noise.KINDS:
    query(f"noise_{_kind}", _noise_sql(_kind))(lambda q, kind=_kind: noise.noised(q.data_row.select("id", "target").distinct(), "id", "target", kind))


@query("protected_unchanged")
def protected_unchanged(q):
    """Texts in which noise changed how often a protected term occurs: none may come out."""
    rows = q.data_row.select("id", "target", "protected_terms").distinct()
    out = rows.join(noise.noised(q.data_row.select("id", "target").distinct(), "id", "target", "transpose"), "id")

    def times(text: str, term):
        return F.size(F.split(F.col(text), F.concat(F.lit("\\Q"), term, F.lit("\\E")), -1))

    return out.where(F.exists("protected_terms", lambda x: times("noisy", x) < times("target", x))).select("id")


@query("stage_punctuation_spacing", r"""SELECT document_id, regexp_replace(regexp_replace(regexp_replace(text, ' +([,.;:!?»)\]])', '\1', 'g'), '([«(\[]) +', '\1', 'g'), '([,;!?])(\p{L})', '\1 \2', 'g') AS value FROM clean_document""")
def stage_punctuation_spacing(q):
    return q.clean_document.select("document_id", stages.punctuation_spacing(F.col("text")).alias("value"))


@query("stage_terminal_mark", r"SELECT document_id, CASE WHEN regexp_matches(text, '[\p{L}\p{N}]\z') THEN text || '.' ELSE text END AS value FROM clean_document")
def stage_terminal_mark(q):
    return q.clean_document.select("document_id", stages.terminal_mark(F.col("text")).alias("value"))


@query("stage_sentence_case", "SELECT document_id, upper(translate(substr(text, 1, 1), 'iı', 'İI')) || substr(text, 2) AS value FROM clean_document")
def stage_sentence_case(q):
    return q.clean_document.select("document_id", stages.sentence_case(F.col("text")).alias("value"))


@query("stage_chain")
def stage_chain(q):
    """The default stages with literals shielded; `trace` names those that changed a text."""
    out = stages.run_stages(q.clean_document, "document_id", "text")
    return out.select("document_id", "after", F.array_join("trace", ",").alias("trace"), "stable")


_VERDICT = "(SELECT DISTINCT id, category, input, target, CASE WHEN ('0x' || substr(sha256(id), 1, 2))::INT < 128 THEN target ELSE input END AS actual FROM data_row WHERE input IS NOT NULL AND target IS NOT NULL)"


def _verdicts(q):
    """A result to be judged: about half of the rows corrected, by a hash."""
    h = F.conv(F.substring(F.sha2("id", 256), 1, 2), 16, 10).cast("int")
    rows = q.data_row.where("input IS NOT NULL AND target IS NOT NULL").select("id", "category", "input", "target").distinct()
    return rows.withColumn("actual", F.when(h < 128, F.col("target")).otherwise(F.col("input")))


@query("quality_by_category", f"""SELECT category, count(*) AS rows, sum((actual = target)::BIGINT)::BIGINT AS exact, sum((input = target)::BIGINT)::BIGINT AS identity, sum((input = target AND actual <> target)::BIGINT)::BIGINT AS identity_changed,
round(avg((actual = target)::INT), 6) AS accuracy FROM (SELECT coalesce(category, '(none)') AS category, input, target, actual FROM {_VERDICT}) GROUP BY ROLLUP (category)""")
def quality_by_category(q):
    return metrics.exactness(_verdicts(q), "category")


@query("quality_micro")
def quality_micro(q):
    return metrics.quality(_verdicts(q), ["category"])


_SCORED = "(SELECT event_id, user_id, least(value / 100.0, 1.0)::DOUBLE AS score, event_type <> 'error' AS correct FROM events WHERE value IS NOT NULL)"


def _scored(q):
    return q.events.where("value IS NOT NULL").select("event_id", "user_id", F.least(F.col("value") / 100.0, F.lit(1.0)).alias("score"), (F.col("event_type") != "error").alias("correct"))


@query("reliability_bins", f"SELECT least(floor(score * 5), 4)::INT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(correct::INT), 6) AS accuracy, round(avg((score - correct::INT) ** 2), 6) AS brier FROM {_SCORED} GROUP BY 1")
def reliability_bins(q):
    return metrics.reliability_bins(_scored(q))


@query("group_reliability", f"""WITH g AS (SELECT user_id, min(correct::INT) AS ok FROM {_SCORED} WHERE event_id % 7 = 0 GROUP BY 1), x AS (SELECT count(*) AS groups, sum(ok)::BIGINT AS all_correct FROM g)
SELECT groups, all_correct, round((all_correct::DOUBLE / groups + {metrics.Z}::DOUBLE ** 2 / (2.0::DOUBLE * groups) - {metrics.Z}::DOUBLE * sqrt(all_correct::DOUBLE / groups * (1 - all_correct::DOUBLE / groups) / groups + {metrics.Z}::DOUBLE ** 2 / (4.0::DOUBLE * groups * groups))) / (1 + {metrics.Z}::DOUBLE ** 2 / groups), 6) AS wilson_low FROM x""")
def group_reliability(q):
    return metrics.group_reliability(_scored(q).where("event_id % 7 = 0"), "user_id")


@query("threshold_pick", f"SELECT min(score) AS threshold, count(*) AS accepted FROM {_SCORED} WHERE score > (SELECT max(score) FROM {_SCORED} WHERE NOT correct AND score < 1.0) AND (correct OR score < 1.0)")
def threshold_pick(q):
    rows = _scored(q).where("correct OR score < 1.0")
    return metrics.zero_error_threshold(rows)


@query("factorial_shapley", """WITH o AS (SELECT event_type AS g, m AS mask, count(*) FILTER (user_id % 8 <= m) AS exact FROM events, generate_series(0, 7) x(m) GROUP BY ALL),
w AS (SELECT g, """ + ", ".join(f"max(exact) FILTER (mask = {m}) AS m{m}" for m in range(8)) + """ FROM o GROUP BY g)
SELECT g, 'first' AS model, round((m4 - m0) / 3.0::DOUBLE + (m5 - m1) / 6.0::DOUBLE + (m6 - m2) / 6.0::DOUBLE + (m7 - m3) / 3.0::DOUBLE, 6) AS contribution FROM w UNION ALL
SELECT g, 'second', round((m2 - m0) / 3.0::DOUBLE + (m3 - m1) / 6.0::DOUBLE + (m6 - m4) / 6.0::DOUBLE + (m7 - m5) / 3.0::DOUBLE, 6) FROM w UNION ALL
SELECT g, 'third', round((m1 - m0) / 3.0::DOUBLE + (m3 - m2) / 6.0::DOUBLE + (m5 - m4) / 6.0::DOUBLE + (m7 - m6) / 3.0::DOUBLE, 6) FROM w""")
def factorial_shapley(q):
    masks = q.events.select(F.col("event_type").alias("g"), "user_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("mask"))
    return metrics.shapley(masks.groupBy("g", "mask").agg(F.count(F.when(F.col("user_id") % 8 <= F.col("mask"), 1)).alias("exact")), "g")


@query("latency_summary", "SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def latency_summary(q):
    return metrics.nearest_rank(q.events, "event_type", "value")


@query("quantile_linear", "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.5), 6) AS mid, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY event_type")
def quantile_linear(q):
    return q.events.groupBy("event_type").agg(*(F.round(F.percentile("value", F.lit(p)), 6).alias(n) for p, n in ((0.025, "low"), (0.5, "mid"), (0.975, "high"))))


@query("cluster_bootstrap")
def cluster_bootstrap(q):
    return metrics.bootstrap(_verdicts(q).join(q.data_row.select("id", "document_id").distinct(), "id").withColumn("hit", (F.col("actual") == F.col("target")).cast("double")), "document_id", "hit")


@query("paired_bootstrap")
def paired_bootstrap(q):
    rows = _verdicts(q).join(q.data_row.select("id", "document_id").distinct(), "id")
    gain = (F.col("actual") == F.col("target")).cast("double") - (F.col("input") == F.col("target")).cast("double")
    return metrics.bootstrap(rows.withColumn("gain", gain), "document_id", "gain")


@query("split_source_counts", "SELECT source, lower(trim(split)) AS split, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM data_row), 6) AS share FROM data_row GROUP BY ALL")
def split_source_counts(q):
    total = q.data_row.agg(F.count("*").alias("total"))
    return q.data_row.groupBy("source", F.lower(F.trim("split")).alias("split")).agg(F.count("*").alias("n")).join(F.broadcast(total)).select("source", "split", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("adjudication_rollup", "SELECT source, category, count(*) AS n FROM data_row GROUP BY GROUPING SETS ((source, category), (source), ())")
def adjudication_rollup(q):
    return q.data_row.rollup("source", "category").agg(F.count("*").alias("n"))


@query("diversity", f"""WITH p AS (SELECT unnest(i) AS a, unnest(o) AS b FROM (SELECT {s.words('input')} AS i, {s.words('expected')} AS o FROM dataset_case) WHERE len(i) = len(o)), c AS (SELECT a, b, count(*) AS n FROM p WHERE a <> b GROUP BY ALL)
SELECT a, b, n FROM c ORDER BY n DESC, a, b LIMIT 10""")
def diversity(q):
    """The ten most frequent word replacements of the cases."""
    w = q.dataset_case.select(t.words(F.col("input")).alias("i"), t.words(F.col("expected")).alias("o")).where("size(i) = size(o)")
    p = w.select(F.inline(F.arrays_zip(F.col("i").alias("a"), F.col("o").alias("b")))).toDF("a", "b").where("a != b")
    return p.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(10)


@query("failures_limit", f"SELECT id, category FROM {_VERDICT} WHERE actual <> target ORDER BY id LIMIT 100")
def failures_limit(q):
    return _verdicts(q).where("actual != target").select("id", "category").orderBy("id").limit(100)


@query("review_accept", f"""WITH r AS (SELECT id, category, {s.fold('input')} AS k, {s.fold('target')} AS v, input, target FROM (SELECT DISTINCT id, category, input, target FROM data_row WHERE input IS NOT NULL AND target IS NOT NULL)),
x AS (SELECT *, (SELECT count(DISTINCT v) FROM r b WHERE b.k = r.k) AS targets, v IN (SELECT {s.fold('expected')} FROM dataset_case) AS blocked, id = min(id) OVER (PARTITION BY k, v) AS first FROM r)
SELECT id, CASE WHEN category = 'keyboard' THEN 'not approved' WHEN targets > 1 THEN 'conflicting targets' WHEN length(input) > 1200 OR length(target) > 1200 THEN 'too long' WHEN regexp_matches(target, '[ \t]{{3,}}|\n[ \t]+') THEN 'whitespace' WHEN blocked THEN 'blocked target' WHEN NOT first THEN 'duplicate pair' ELSE 'accepted' END AS reason FROM x""")
def review_accept(q):
    """Ordered reasons; the first that holds counts."""
    r = q.data_row.where("input IS NOT NULL AND target IS NOT NULL").select("id", "category", "input", "target").distinct()
    r = r.withColumn("k", t.fold_diacritics(F.col("input"))).withColumn("v", t.fold_diacritics(F.col("target")))
    per_input = r.groupBy("k").agg(F.countDistinct("v").alias("targets"))
    per_pair = r.groupBy("k", "v").agg(F.min("id").alias("first"))
    blocked = q.dataset_case.select(t.fold_diacritics(F.col("expected")).alias("v")).distinct().withColumn("blocked", F.lit(True))
    x = r.join(per_input, "k").join(per_pair, ["k", "v"]).join(blocked, "v", "left")
    reason = (
        F.when(F.col("category") == "keyboard", "not approved")
        .when(F.col("targets") > 1, "conflicting targets")
        .when((F.length("input") > 1200) | (F.length("target") > 1200), "too long")
        .when(F.rlike("target", F.lit(r"[ \t]{3,}|\n[ \t]+")), "whitespace")
        .when(F.col("blocked"), "blocked target")
        .when(F.col("id") != F.col("first"), "duplicate pair")
        .otherwise("accepted")
    )
    return x.select("id", reason.alias("reason"))


@query("policy_grid", f"""SELECT g / 10.0::DOUBLE AS threshold, count(*) FILTER (correct AND score >= g / 10.0::DOUBLE) AS tp, count(*) FILTER (NOT correct AND score >= g / 10.0::DOUBLE) AS fp FROM {_SCORED}, generate_series(1, 8) x(g) GROUP BY g""")
def policy_grid(q):
    grid = _scored(q).select("score", "correct", F.explode(F.array(*(F.lit(g / 10.0) for g in range(1, 9)))).alias("threshold")).where("score >= threshold")
    return grid.groupBy("threshold").agg(F.count(F.when(F.col("correct"), 1)).alias("tp"), F.count(F.when(~F.col("correct"), 1)).alias("fp"))


@query("span_overlap", "SELECT a.l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_shipdate < b.l_shipdate + INTERVAL 10 DAY AND b.l_shipdate < a.l_shipdate + INTERVAL 10 DAY")
def span_overlap(q):
    """Half-open spans of ten days that overlap, within a key."""
    x = q.lineitem.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("d"))
    a, b = x.toDF("l_orderkey", "line_a", "da"), x.toDF("l_orderkey", "line_b", "db")
    return a.join(b, "l_orderkey").where("line_a < line_b AND da < date_add(db, 10) AND db < date_add(da, 10)").select("l_orderkey", "line_a", "line_b")


@query("scan_parquet_pruned", "SELECT document_id, source FROM clean_document WHERE source = 'xeber-arxiv'")
def scan_parquet_pruned(q):
    """Two columns are read; the filter reaches the scan."""
    return q.clean_document.select("document_id", "source").where("source = 'xeber-arxiv'")


@query("content_hash", "SELECT count(*) AS n, sum(('0x' || substr(md5(document_id || coalesce(text, '')), 1, 8))::BIGINT)::BIGINT AS digest FROM clean_document")
def content_hash(q):
    """An order-free digest of a table: the sum of its rows' hashes."""
    h = F.conv(F.substring(F.md5(F.concat("document_id", F.coalesce("text", F.lit("")))), 1, 8), 16, 10).cast("long")
    return q.clean_document.agg(F.count("*").alias("n"), F.sum(h).alias("digest"))


@query("gate_status", "SELECT source, count(*) AS n, count(*) FILTER (text IS NULL) AS nulls, count(*) FILTER (license IS NULL) AS unlicensed, CASE WHEN count(*) FILTER (text IS NULL) > 0 THEN 'fail' ELSE 'pass' END AS status FROM clean_document GROUP BY source")
def gate_status(q):
    nulls = F.count(F.when(F.col("text").isNull(), 1))
    return q.clean_document.groupBy("source").agg(F.count("*").alias("n"), nulls.alias("nulls"), F.count(F.when(F.col("license").isNull(), 1)).alias("unlicensed"), F.when(nulls > 0, "fail").otherwise("pass").alias("status"))


@query("tumbling_window", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(q):
    return ev.tumbling(q.events).withColumn("start", F.unix_micros(F.to_timestamp("start")))


@query("sliding_window", "SELECT epoch_us(b - INTERVAL (15 * k) MINUTE) AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS b FROM events), generate_series(0, 3) g(k) GROUP BY ALL")
def sliding_window(q):
    return ev.sliding(q.events).withColumn("start", F.unix_micros(F.to_timestamp("start")))


@query("session_windows", """SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g
FROM (SELECT user_id, ts, event_id, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, g""")
def session_windows(q):
    return ev.sessions(q.events).withColumn("start", F.unix_micros(F.to_timestamp("start")))


@query("debounce", "SELECT event_id, user_id FROM (SELECT event_id, user_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts AS w FROM events) WHERE w IS NULL OR w >= INTERVAL 600 SECOND")
def debounce(q):
    return ev.debounced(q.events, 600).select("event_id", "user_id")


@query("latest_wins", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_wins(q):
    return ev.latest(q.events.select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("rate_limit_range", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS hits FROM events")
def rate_limit_range(q):
    """All hits in the minute up to each; the exact limit, which counts accepted hits only, is the stateful stream `rate_limited`."""
    return ev.hits_in_range(q.events, 60, 30).select("event_id", "hits")


@query("journal_capped", "SELECT user_id, event_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 20")
def journal_capped(q):
    return ev.journal(q.events, "user_id", 20).select("user_id", "event_id", "rank")


@query("speculative_cache", "SELECT document_id, min(target) AS value FROM data_row WHERE document_id IS NOT NULL AND target IS NOT NULL GROUP BY document_id HAVING count(DISTINCT target) = 1")
def speculative_cache(q):
    """Values all writers of a key agree on; contradicted keys are discarded."""
    rows = q.data_row.where("document_id IS NOT NULL AND target IS NOT NULL")
    return rows.groupBy("document_id").agg(F.min("target").alias("value"), F.max("target").alias("other")).where("value = other").select("document_id", "value")
