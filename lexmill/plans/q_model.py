"""Counts, language model, candidates, evaluation (survey 2.6, 2.8, 2.12, 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import distance, text as t
from lexmill.operators import lm, metrics
from lexmill.plans import sql as s
from lexmill.plans.registry import query

_SENT = f"sent AS (SELECT id, {s.words('target')} AS w FROM (SELECT DISTINCT id, target FROM data_row WHERE target IS NOT NULL AND lower(trim(split)) = 'train'))"
_HELD = f"held AS (SELECT id, {s.words('target')} AS w FROM (SELECT DISTINCT id, target FROM data_row WHERE target IS NOT NULL AND lower(trim(split)) = 'test'))"
_CLASS = "CASE " + " ".join(f"WHEN ends_with({{0}}, '{x}') AND length({{0}}) > {len(x) + 2} THEN '<suffix:{x}>'" for x in t.SUFFIXES) + " ELSE '<unk>' END"


def _tri(source: str, classes: bool) -> str:
    seen = f"CASE WHEN v.word IS NOT NULL OR r.word = '</s>' THEN r.word WHEN {_CLASS.format('r.word')} IN (SELECT word FROM one) THEN {_CLASS.format('r.word')} ELSE '<unk>' END"
    plain = f"CASE WHEN v.word IS NOT NULL OR r.word = '</s>' THEN r.word ELSE {_CLASS.format('r.word')} END"
    return f"""SELECT id, pos, coalesce(lag(m, 2) OVER x, '<s>') AS a, coalesce(lag(m) OVER x, '<s>') AS b, m AS c
  FROM (SELECT id, pos, {seen if classes else plain} AS m FROM (SELECT id, unnest(range(0, len(w) + 1))::INT AS pos, unnest(list_append(w, '</s>')) AS word FROM {source}) r LEFT JOIN vocab v ON r.word = v.word)
  WINDOW x AS (PARTITION BY id ORDER BY pos)"""


_LM = f"""WITH {_SENT}, {_HELD}, counts AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM sent) GROUP BY word),
vocab AS (SELECT word FROM counts WHERE n >= 3),
tri AS (SELECT a, b, c, count(*) AS n FROM ({_tri('sent', False)}) GROUP BY ALL),
ctx3 AS (SELECT a, b, sum(n)::BIGINT AS total3, count(*) AS types3 FROM tri GROUP BY ALL),
cont2 AS (SELECT b AS a, c AS b, count(*) AS n FROM tri GROUP BY ALL),
ctx2 AS (SELECT a, sum(n)::BIGINT AS total2, count(*) AS types2 FROM cont2 GROUP BY a),
one AS (SELECT c AS word, count(DISTINCT b) AS n FROM tri GROUP BY c),
q AS ({_tri('held', True)}),
scored AS (SELECT q.id, q.pos, q.a, q.b, q.c, coalesce(one.n::DOUBLE / (SELECT sum(n) FROM one), 0) AS p1, total2, types2, cont2.n AS n2, total3, types3, tri.n AS n3 FROM q
  LEFT JOIN one ON one.word = q.c LEFT JOIN ctx2 ON ctx2.a = q.b LEFT JOIN cont2 ON cont2.a = q.b AND cont2.b = q.c LEFT JOIN ctx3 ON ctx3.a = q.a AND ctx3.b = q.b LEFT JOIN tri ON tri.a = q.a AND tri.b = q.b AND tri.c = q.c),
prob2 AS (SELECT *, CASE WHEN total2 IS NULL THEN p1 ELSE greatest(coalesce(n2, 0) - 0.75::DOUBLE, 0) / total2 + 0.75::DOUBLE * types2 / total2 * p1 END AS p2 FROM scored),
prob AS (SELECT *, CASE WHEN total3 IS NULL THEN p2 ELSE greatest(coalesce(n3, 0) - 0.75::DOUBLE, 0) / total3 + 0.75::DOUBLE * types3 / total3 * p2 END AS p3 FROM prob2),
e2 AS (SELECT a, b, (n - 0.75::DOUBLE) / total2 AS p FROM (SELECT * FROM cont2 ORDER BY n DESC, a, b LIMIT 2000) JOIN ctx2 USING (a)),
e3 AS (SELECT a, b, c, (n - 0.75::DOUBLE) / total3 AS p FROM (SELECT * FROM tri ORDER BY n DESC, a, b, c LIMIT 4000) JOIN ctx3 USING (a, b)),
b2 AS (SELECT a, 1 - sum(p) AS backoff FROM e2 GROUP BY a), b3 AS (SELECT a, b, 1 - sum(p) AS backoff FROM e3 GROUP BY ALL)"""


def _sentences(q, split: str):
    return q.data_row.where(F.lower(F.trim("split")) == split).where("target IS NOT NULL").select("id", "target").distinct().select("id", t.words(F.col("target")).alias("w"))


def _vocabulary(q):
    return lm.vocabulary(_sentences(q, "train"))


def _model(q) -> lm.Model:
    return lm.fit(lm.trigram_rows(lm.mapped_tokens(_sentences(q, "train"), _vocabulary(q))))


def _held(q, model: lm.Model):
    return lm.trigram_rows(lm.mapped_tokens(_sentences(q, "test"), _vocabulary(q), model.continuation1))


query("word_counts_upsert", f"{_LM} SELECT word, n FROM counts")(lambda q: lm.word_counts(_sentences(q, "train")))


@query("vocabulary_with_dictionary", f"{_LM}, d AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT word, n FROM counts UNION ALL SELECT lower(word), 0 FROM function_word) GROUP BY word) SELECT word, n FROM d ORDER BY n DESC, word LIMIT 1500")
def vocabulary_with_dictionary(q):
    both = lm.word_counts(_sentences(q, "train")).unionByName(q.function_word.select(F.lower("word").alias("word"), F.lit(0).cast("long").alias("n")))
    return both.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(1500)


query("topk_vocab", f"{_LM} SELECT word, n FROM counts ORDER BY n DESC, word LIMIT 100")(lambda q: lm.word_counts(_sentences(q, "train")).orderBy(F.desc("n"), "word").limit(100))
query("ngram_counts", f"{_LM} SELECT a, b, c, n FROM tri")(lambda q: _model(q).trigrams)
query("bigram_counts", f"{_LM} SELECT b, c, sum(n)::BIGINT AS n FROM tri GROUP BY ALL")(lambda q: _model(q).trigrams.groupBy("b", "c").agg(F.sum("n").alias("n")))
query("kn_contexts3", f"{_LM} SELECT * FROM ctx3")(lambda q: _model(q).contexts3)
query("kn_continuation2", f"{_LM} SELECT * FROM cont2")(lambda q: _model(q).continuation2)
query("kn_contexts2", f"{_LM} SELECT * FROM ctx2")(lambda q: _model(q).contexts2)
query("kn_continuation1", f"{_LM} SELECT * FROM one")(lambda q: _model(q).continuation1)


def _scored(q, column: str):
    model = _model(q)
    return lm.probabilities(_held(q, model), model).select("id", "pos", F.round(column, 6).alias("p"))


query("kn_mapped", f"{_LM} SELECT id, pos, c AS word FROM q")(lambda q: _held(q, _model(q)).select("id", "pos", F.col("c").alias("word")))
query("kn_unigram", f"{_LM} SELECT id, pos, round(p1, 6) AS p FROM prob")(lambda q: _scored(q, "p1"))
query("kn_bigram", f"{_LM} SELECT id, pos, round(p2, 6) AS p FROM prob")(lambda q: _scored(q, "p2"))
query("kn_trigram", f"{_LM} SELECT id, pos, round(p3, 6) AS p FROM prob")(lambda q: _scored(q, "p3"))


@query("kn_fit", f"{_LM} SELECT (SELECT count(*) FROM tri) AS trigrams, (SELECT count(*) FROM ctx3) AS contexts3, (SELECT count(*) FROM cont2) AS continuation2, (SELECT count(*) FROM ctx2) AS contexts2, (SELECT count(*) FROM one) AS continuation1")
def kn_fit(q):
    m = _model(q)
    sizes = [d.agg(F.count("*").alias(n)) for n, d in (("trigrams", m.trigrams), ("contexts3", m.contexts3), ("continuation2", m.continuation2), ("contexts2", m.contexts2), ("continuation1", m.continuation1))]
    out = sizes[0]
    for d in sizes[1:]:
        out = out.join(F.broadcast(d))
    return out


@query("perplexity", f"{_LM} SELECT count(*) AS examples, sum((p3 <= 0)::BIGINT)::BIGINT AS zero, CASE WHEN sum((p3 <= 0)::INT) = 0 THEN round(exp(-sum(ln(p3)) / count(*)), 4) END AS perplexity FROM prob")
def perplexity(q):
    model = _model(q)
    return lm.perplexity(lm.probabilities(_held(q, model), model))


@query("lm_doc_score", f"{_LM} SELECT id, count(*) AS tokens, sum((c NOT LIKE '<%')::BIGINT)::BIGINT AS known, round(sum(CASE WHEN p3 > 0 THEN ln(p3) END), 4) AS loglik FROM prob GROUP BY id")
def lm_doc_score(q):
    model = _model(q)
    x = lm.probabilities(_held(q, model), model)
    return x.groupBy("id").agg(F.count("*").alias("tokens"), F.sum((~F.col("c").like("<%")).cast("long")).alias("known"), F.round(F.sum(F.when(F.col("p3") > 0, F.log("p3"))), 4).alias("loglik"))


@query("topk_ngrams", f"{_LM} SELECT a, b, n FROM cont2 ORDER BY n DESC, a, b LIMIT 2000")
def topk_ngrams(q):
    return _model(q).continuation2.orderBy(F.desc("n"), "a", "b").limit(2000)


def _pruned(q):
    m = _model(q)
    two = lm.pruned(m.continuation2, m.contexts2.withColumnRenamed("total2", "total"), ["a"], "b", 2000, m.discount)
    three = lm.pruned(m.trigrams, m.contexts3.withColumnRenamed("total3", "total"), ["a", "b"], "c", 4000, m.discount)
    return m, two, three


query("lm_prune", f"{_LM} SELECT a, b, c, round(p, 6) AS p, round(backoff, 6) AS backoff FROM e3 JOIN b3 USING (a, b)")(
    lambda q: (lambda e, c: e.join(c, ["a", "b"]).select("a", "b", "c", F.round("p", 6).alias("p"), F.round("backoff", 6).alias("backoff")))(*_pruned(q)[2])
)


@query("lm_pruned_prob", f"""{_LM} SELECT q.id, round(sum(coalesce(e3.p, 0) + coalesce(b3.backoff, 1) * (coalesce(e2.p, 0) + coalesce(b2.backoff, 1) * coalesce(one.n::DOUBLE / (SELECT sum(n) FROM one), 0))), 5) AS p FROM q
LEFT JOIN one ON one.word = q.c LEFT JOIN e2 ON e2.a = q.b AND e2.b = q.c LEFT JOIN b2 ON b2.a = q.b LEFT JOIN e3 ON e3.a = q.a AND e3.b = q.b AND e3.c = q.c LEFT JOIN b3 ON b3.a = q.a AND b3.b = q.b GROUP BY q.id""")
def lm_pruned_prob(q):
    m, two, three = _pruned(q)
    total = m.continuation1.agg(F.sum("n").alias("total"))
    p1 = m.continuation1.join(F.broadcast(total)).select("word", (F.col("n") / F.col("total")).alias("p"))
    return lm.pruned_probability(_held(q, m), p1, two, three).groupBy("id").agg(F.round(F.sum("p"), 5).alias("p"))


@query("oov_penalty", f"{_LM} SELECT id, pos, CASE WHEN v.word IS NULL THEN round(ln((SELECT count(*) FROM vocab)), 6) ELSE 0 END AS penalty FROM (SELECT id, unnest(range(0, len(w)))::INT AS pos, unnest(w) AS word FROM held) h LEFT JOIN vocab v USING (word)")
def oov_penalty(q):
    v = _vocabulary(q)
    size = v.agg(F.log(F.count("*").cast("double")).alias("ln_v"))
    rows = _sentences(q, "test").select("id", F.posexplode("w").alias("pos", "word")).join(v.withColumn("known", F.lit(True)), "word", "left").join(F.broadcast(size))
    return rows.select("id", "pos", F.when(F.col("known"), 0.0).otherwise(F.round("ln_v", 6)).alias("penalty"))


@query("lm_rank", f"""{_LM}, cand AS (SELECT a, b, c, n, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, c) AS rank FROM tri)
SELECT q.id, q.pos, cand.c AS candidate, rank::INT AS rank FROM q JOIN cand ON cand.a = q.a AND cand.b = q.b WHERE rank <= 8""")
def lm_rank(q):
    """The eight likeliest continuations of each context of the held-out texts."""
    m = _model(q)
    top = metrics.top_per_group(m.trigrams, ["a", "b"], [F.desc("n"), "c"], 8)
    return _held(q, m).select("id", "pos", "a", "b").join(top, ["a", "b"]).select("id", "pos", F.col("c").alias("candidate"), "rank")


@query("context_profile", f"""{_LM}, pairs AS (SELECT list_extract(w, i + 1) AS word, list_extract(w, j + 1) AS near, i, j, id FROM (SELECT id, w, unnest(range(0, len(w))) AS i FROM sent), generate_series(-2, 2) g(d), LATERAL (SELECT i + d AS j) WHERE d <> 0 AND j >= 0 AND j < len(w))
SELECT word, near, CASE WHEN j < i THEN 'left' ELSE 'right' END AS side, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 3""")
def context_profile(q):
    w = _sentences(q, "train").where("size(w) > 0").select("w", F.posexplode("w").alias("i", "word"))
    near = F.transform(F.filter(F.array(*map(F.lit, (-2, -1, 1, 2))), lambda d: (F.col("i") + d >= 0) & (F.col("i") + d < F.size("w"))), lambda d: F.struct(F.get("w", F.col("i") + d).alias("near"), F.when(d < 0, "left").otherwise("right").alias("side")))
    return w.select("word", F.inline(near)).groupBy("word", "near", "side").agg(F.count("*").alias("n")).where("n >= 3")


@query("topk_features_per_side", f"""{_LM}, pairs AS (SELECT b AS word, a AS near, n FROM tri WHERE a NOT LIKE '<%' AND b NOT LIKE '<%'), agg AS (SELECT word, near, sum(n)::BIGINT AS n FROM pairs GROUP BY ALL)
SELECT word, near, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS rank FROM agg) WHERE rank <= 8""")
def topk_features_per_side(q):
    pairs = _model(q).trigrams.where("a NOT LIKE '<%' AND b NOT LIKE '<%'").groupBy(F.col("b").alias("word"), F.col("a").alias("near")).agg(F.sum("n").alias("n"))
    return metrics.top_per_group(pairs, ["word"], [F.desc("n"), "near"], 8)


@query("topk_profiles", f"""{_LM}, f AS (SELECT {s.fold('word')} AS fold, word, n FROM counts), g AS (SELECT fold, count(*) AS forms, sum(n)::BIGINT AS total FROM f GROUP BY fold)
SELECT fold, forms, total FROM g ORDER BY (forms > 1) DESC, total DESC, fold LIMIT 500""")
def topk_profiles(q):
    f = lm.word_counts(_sentences(q, "train")).groupBy(t.fold_diacritics(F.col("word")).alias("fold")).agg(F.count("*").alias("forms"), F.sum("n").alias("total"))
    return f.orderBy(F.desc(F.col("forms") > 1), F.desc("total"), "fold").limit(500)


@query("ambiguity_groups", f"{_LM} SELECT {s.fold('word')} AS fold, count(*) AS surfaces, min(word) AS first FROM counts GROUP BY 1 HAVING count(*) > 1")
def ambiguity_groups(q):
    return lm.word_counts(_sentences(q, "train")).groupBy(t.fold_diacritics(F.col("word")).alias("fold")).agg(F.count("*").alias("surfaces"), F.min("word").alias("first")).where("surfaces > 1")


@query("nb_counts", f"""{_LM} SELECT fold, word, near, count(*) AS n FROM (SELECT {s.fold('c')} AS fold, c AS word, b AS near FROM ({_tri('sent', False)})) WHERE word NOT LIKE '<%' GROUP BY ALL""")
def nb_counts(q):
    rows = lm.trigram_rows(lm.mapped_tokens(_sentences(q, "train"), _vocabulary(q)))
    return rows.where("c NOT LIKE '<%'").groupBy(t.fold_diacritics(F.col("c")).alias("fold"), F.col("c").alias("word"), F.col("b").alias("near")).agg(F.count("*").alias("n"))


@query("form_evidence", f"""{_LM}, f AS (SELECT {s.fold('word')} AS fold, word, count(DISTINCT id) AS texts FROM (SELECT id, unnest(w) AS word FROM sent) GROUP BY ALL)
SELECT fold, min(word) AS word, max(texts) AS texts FROM f GROUP BY fold HAVING count(*) = 1 AND max(texts) >= 3 AND min(word) <> fold""")
def form_evidence(q):
    """Folds with one accented surface, seen in at least three texts."""
    f = _sentences(q, "train").select("id", F.explode("w").alias("word")).groupBy("word").agg(F.countDistinct("id").alias("texts")).withColumn("fold", t.fold_diacritics(F.col("word")))
    g = f.groupBy("fold").agg(F.count("*").alias("forms"), F.min("word").alias("word"), F.max("texts").alias("texts"))
    return g.where("forms = 1 AND texts >= 3 AND word != fold").select("fold", "word", "texts")


@query("boundary_pair_counts", rf"""WITH l AS (SELECT list_transform(string_split(trim(regexp_replace(target, '\s+', ' ', 'g'), ' '), ' '), lambda x: x) AS w FROM data_row WHERE target IS NOT NULL),
p AS (SELECT unnest(w) AS x, unnest(list_append(w[2:], NULL)) AS y FROM l)
SELECT right(regexp_replace({s.lower('x')}, '[.!?]+$', ''), 4) AS lt, left({s.lower('y')}, 5) AS rt, count(*) FILTER (regexp_matches(x, '[.!?]$')) AS positive, count(*) FILTER (NOT regexp_matches(x, '[.!?]$')) AS negative FROM p WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (regexp_matches(x, '[.!?]$')) >= 2""")
def boundary_pair_counts(q):
    w = q.data_row.where("target IS NOT NULL").select(F.split(F.trim(F.regexp_replace("target", r"\s+", " ")), " ").alias("w")).where("size(w) > 1")
    p = w.select(F.explode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("x"), F.expr("slice(w, 2, size(w) - 1)").alias("y"))).alias("p")).select("p.x", "p.y")
    ends = F.rlike("x", F.lit("[.!?]$"))
    left = F.right(F.regexp_replace(t.az_lower(F.col("x")), "[.!?]+$", ""), F.lit(4))
    out = p.groupBy(left.alias("lt"), F.left(t.az_lower(F.col("y")), F.lit(5)).alias("rt")).agg(F.count(F.when(ends, 1)).alias("positive"), F.count(F.when(~ends, 1)).alias("negative"))
    return out.where("positive >= 2")


@query("pos_counts", f"{_LM}, sfx AS (SELECT unnest([2, 3, 4]) AS k) SELECT right(word, k) AS suffix, sum(n)::BIGINT AS n, count(*) AS words FROM counts, sfx WHERE length(word) > k GROUP BY 1")
def pos_counts(q):
    c = lm.word_counts(_sentences(q, "train"))
    return c.select("word", "n", F.explode(F.array(*map(F.lit, (2, 3, 4)))).alias("k")).where("length(word) > k").groupBy(F.expr("right(word, k)").alias("suffix")).agg(F.sum("n").alias("n"), F.count("*").alias("words"))


@query("edit_rule_counts")
def edit_rule_counts(q):
    """Word replacements of the correction pairs, counted."""
    rows = q.correction_pair.where("input IS NOT NULL AND target IS NOT NULL").select("id", "input", "target").distinct()
    pairs = rows.select(F.inline(distance.seq_opcodes("input", "target"))).where("op = 'replace'")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("n"))


@query("edit_channel_counts")
def edit_channel_counts(q):
    """Replacements with one target only, by their distance."""
    rows = q.correction_pair.where("input IS NOT NULL AND target IS NOT NULL").select("id", "input", "target").distinct()
    pairs = rows.select(F.inline(distance.seq_opcodes("input", "target"))).where("op = 'replace'")
    clear = pairs.groupBy("source").agg(F.countDistinct("target").alias("targets"), F.min("target").alias("target"), F.count("*").alias("n")).where("targets = 1")
    return clear.select("source", "target", "n", F.levenshtein("source", "target").alias("distance"))


@query("edits")
def edits(q):
    rows = q.correction_pair.where("input IS NOT NULL AND target IS NOT NULL").select("id", "input", "target").distinct()
    return rows.select("id", F.inline(distance.word_edits("input", "target")))


@query("seq_opcodes")
def seq_opcodes(q):
    rows = q.correction_pair.select("id", "input", "target").distinct()
    return rows.select("id", F.inline(distance.seq_opcodes("input", "target")))


@query("osa_bounded")
def osa_bounded(q):
    words = q.correction_pair.select("id", "input", "target").distinct().select(F.inline(distance.seq_opcodes("input", "target"))).where("op = 'replace'").select("source", "target").distinct()
    return words.select("source", "target", distance.osa_bounded(F.col("source"), F.col("target")).alias("distance"))


_INDEX = f"""{_LM}, idx AS (SELECT word, n, unnest(list_distinct(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))))) AS key FROM counts WHERE n >= 3),
miss AS (SELECT DISTINCT word FROM (SELECT unnest({s.words('input')}) AS word FROM data_row WHERE input IS NOT NULL AND lower(trim(split)) = 'test') ANTI JOIN counts USING (word)),
mkey AS (SELECT word, unnest(list_distinct(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))))) AS key FROM miss)"""


def _lookup(q):
    counts = lm.word_counts(_sentences(q, "train"))
    index = counts.where("n >= 3").select(F.col("word").alias("candidate"), "n", F.explode(t.deletions(F.col("word"))).alias("key"))
    words = q.data_row.where(F.lower(F.trim("split")) == "test").select(F.explode(t.words(F.col("input"))).alias("word")).distinct()
    missing = words.join(counts, "word", "left_anti").select("word", F.explode(t.deletions(F.col("word"))).alias("key"))
    return missing.join(index, "key").select("word", "candidate", "n").distinct()


@query("candidate_keys", f"{_INDEX} SELECT DISTINCT mkey.word, idx.word AS candidate, idx.n FROM mkey JOIN idx USING (key)")
def candidate_keys(q):
    """Unknown words and the vocabulary's words that share a key with one letter deleted."""
    return _lookup(q)


@query("candidate_caps", f"{_INDEX}, c AS (SELECT DISTINCT mkey.word, idx.word AS candidate, idx.n FROM mkey JOIN idx USING (key)) SELECT word, candidate, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, candidate) AS rank FROM c) WHERE rank <= 8")
def candidate_caps(q):
    return metrics.top_per_group(_lookup(q), ["word"], [F.desc("n"), "candidate"], 8).select("word", "candidate", "rank")


@query("candidate_lookup")
def candidate_lookup(q):
    """Candidates within OSA distance two that share a deletion key, nearest and most frequent first, twenty a word."""
    near = _lookup(q).withColumn("distance", distance.osa_bounded(F.col("word"), F.col("candidate"))).where("distance <= 2")
    return metrics.top_per_group(near, ["word"], ["distance", F.desc("n"), "candidate"], 20).select("word", "candidate", "n", "distance", "rank")


@query("fold_lookup", f"""{_INDEX} SELECT m.word, c.word AS candidate, c.n FROM miss m JOIN counts c ON {s.fold('m.word')} = {s.fold('c.word')} WHERE m.word <> c.word""")
def fold_lookup(q):
    counts = lm.word_counts(_sentences(q, "train"))
    words = q.data_row.where(F.lower(F.trim("split")) == "test").select(F.explode(t.words(F.col("input"))).alias("word")).distinct().join(counts, "word", "left_anti")
    folded = counts.select(F.col("word").alias("candidate"), "n", t.fold_diacritics(F.col("word")).alias("key"))
    return words.withColumn("key", t.fold_diacritics(F.col("word"))).join(folded, "key").select("word", "candidate", "n").where("word != candidate")


@query("skeleton_lookup", f"""{_INDEX}, sk AS (SELECT word, n, regexp_replace({s.fold("replace(replace(replace(word, 'sh', 'ş'), 'ch', 'ç'), 'gh', 'ğ')")}, '[aeiou]', '', 'g') AS key FROM counts WHERE n >= 3)
SELECT m.word, count(*) AS candidates, min(sk.word) AS first FROM (SELECT word, regexp_replace({s.fold("replace(replace(replace(word, 'sh', 'ş'), 'ch', 'ç'), 'gh', 'ğ')")}, '[aeiou]', '', 'g') AS key FROM miss) m JOIN sk USING (key) WHERE length(key) >= 2 GROUP BY 1""")
def skeleton_lookup(q):
    counts = lm.word_counts(_sentences(q, "train"))
    words = q.data_row.where(F.lower(F.trim("split")) == "test").select(F.explode(t.words(F.col("input"))).alias("word")).distinct().join(counts, "word", "left_anti")
    sk = counts.where("n >= 3").select(F.col("word").alias("candidate"), t.skeleton(F.col("word")).alias("key"))
    hit = words.withColumn("key", t.skeleton(F.col("word"))).where("length(key) >= 2").join(sk, "key")
    return hit.groupBy("word").agg(F.count("*").alias("candidates"), F.min("candidate").alias("first"))
