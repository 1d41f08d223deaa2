"""Joins, keyed matching, near duplicates, clusters, splits (survey 2.5, 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.operators import components, crossing, matching as m, similarity, splits
from lexmill.operators.curation import segment_fallback
from lexmill.plans import sql as s
from lexmill.plans.registry import query
from lexmill.session import cut

_SPLIT = "CASE WHEN lower(trim(split)) IN ('dev', 'valid', 'val') THEN 'validation' ELSE lower(trim(split)) END"
_KEY_EXACT = f"sha256({s.collapse('nfc_normalize(target)')})"
_KEY_WORDS = f"array_to_string({s.words('target')}, ' ')"


def _rows(q):
    return q.data_row.withColumn("split", splits.norm_split(F.col("split")))


@query("dedup_exact_first", f"SELECT {_KEY_EXACT} AS key, min(id) AS id, count(*) AS n FROM data_row WHERE target IS NOT NULL GROUP BY 1")
def dedup_exact_first(q):
    rows = q.data_row.where("target IS NOT NULL").select(F.sha2(t.normalize_ws(F.col("target")), 256).alias("key"), "id")
    return m.first_by(rows, ["key"], ["id"])


@query("dedup_normalized_first", f"SELECT sha256({_KEY_WORDS}) AS key, min(id) AS id, count(*) AS n FROM data_row WHERE target IS NOT NULL GROUP BY 1")
def dedup_normalized_first(q):
    rows = q.data_row.where("target IS NOT NULL").select(t.sentence_key(F.col("target")).alias("key"), "id")
    return m.first_by(rows, ["key"], ["id"])


@query("dedup_pairs", "SELECT sha256(input || chr(10) || target) AS key, min(id) AS id, count(*) AS n FROM data_row WHERE input IS NOT NULL AND target IS NOT NULL GROUP BY 1")
def dedup_pairs(q):
    rows = q.data_row.where("input IS NOT NULL AND target IS NOT NULL").select(F.sha2(F.concat("input", F.lit("\n"), "target"), 256).alias("key"), "id")
    return m.first_by(rows, ["key"], ["id"])


@query("exact_duplicate_flags", f"SELECT id, split, id = min(id) OVER (PARTITION BY {_KEY_EXACT}) AS is_first FROM (SELECT DISTINCT id, target, {_SPLIT} AS split FROM data_row WHERE target IS NOT NULL)")
def exact_duplicate_flags(q):
    rows = _rows(q).where("target IS NOT NULL").select("id", "split", F.sha2(t.normalize_ws(F.col("target")), 256).alias("key")).distinct()
    return m.flag_first(rows, "key", ["id"]).select("id", "split", "is_first")


@query("unique_document_id", "SELECT id, count(*) AS n FROM data_row GROUP BY id HAVING count(*) > 1")
def unique_document_id(q):
    return q.data_row.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@query("xsource_sixgram_exclude", f"""
WITH g AS (SELECT document_id, source, unnest({s.ngrams('w', 6)}) AS gram FROM (SELECT document_id, source, {s.words('text')} AS w FROM clean_document WHERE text IS NOT NULL AND source IS NOT NULL)),
o AS (SELECT gram, arg_min(source, document_id) AS owner FROM g GROUP BY gram)
SELECT document_id, count(*) AS foreign_grams FROM g JOIN o USING (gram) WHERE g.source <> o.owner GROUP BY document_id""")
def xsource_sixgram_exclude(q):
    """The one-pass variant: the first candidate's source owns a six-gram; documents of other sources that hold it are excluded."""
    w = q.clean_document.where("text IS NOT NULL AND source IS NOT NULL").select("document_id", "source", t.words(F.col("text")).alias("w"))
    grams = w.select("document_id", "source", F.explode(t.word_ngrams(F.col("w"), 6)).alias("gram"))
    owner = grams.groupBy("gram").agg(F.min_by("source", "document_id").alias("owner"))
    return grams.join(owner, "gram").where("source != owner").groupBy("document_id").agg(F.count("*").alias("foreign_grams"))


@query("contamination_audit", f"""
WITH ref AS (SELECT DISTINCT key_type, key FROM (
  SELECT 0 AS key_type, sha256(array_to_string({s.words('expected')}, ' ')) AS key FROM dataset_case WHERE expected IS NOT NULL
  UNION ALL SELECT 1, sha256(unnest({s.ngrams(s.words('expected'), 8)})) FROM dataset_case WHERE expected IS NOT NULL)),
own AS (SELECT document_id, 0 AS key_type, sha256(array_to_string({s.words('text')}, ' ')) AS key FROM clean_document WHERE text IS NOT NULL
  UNION ALL SELECT document_id, 1, sha256(unnest({s.ngrams('w', 8)})) FROM (SELECT document_id, {s.words('text')} AS w FROM clean_document WHERE text IS NOT NULL))
SELECT document_id, max((key_type = 0)::INT) AS same_sentence, sum((key_type = 1)::BIGINT)::BIGINT AS shared_ngrams FROM own SEMI JOIN ref USING (key_type, key) GROUP BY document_id""")
def contamination_audit(q):
    return m.contamination(q.clean_document, q.dataset_case, "document_id", "text", "expected")


@query("collect_doc_sentences", f"SELECT document_id, seq, sha256(s) AS key FROM {s.segments('clean_document', 'document_id', 'text')}")
def collect_doc_sentences(q):
    return segment_fallback(q.clean_document).select("document_id", "seq", F.sha2("segment", 256).alias("key"))


_KEYED = f"""keyed AS (
  SELECT id AS row, {_SPLIT} AS split, side, key_type, key FROM (
    SELECT id, split, side, 0 AS key_type, sha256(array_to_string({s.words('x')}, ' ')) AS key FROM sides
    UNION ALL SELECT id, split, side, 1, sha256(unnest({s.ngrams(s.words('x'), 8)})) FROM sides)),"""
_SIDES = """sides AS (SELECT id, split, 'clean' AS side, target AS x FROM data_row WHERE target IS NOT NULL AND split IS NOT NULL
  UNION ALL SELECT id, split, 'noisy', input FROM data_row WHERE input IS NOT NULL AND split IS NOT NULL),"""


def _keyed(q):
    rows = _rows(q).where("split IS NOT NULL")
    sides = rows.select(F.col("id").alias("row"), "split", F.inline(F.array(F.struct(F.lit("clean").alias("side"), F.col("target").alias("x")), F.struct(F.lit("noisy").alias("side"), F.col("input").alias("x")))))
    w = sides.where("x IS NOT NULL").select("row", "split", "side", t.words(F.col("x")).alias("w"))
    return w.select("row", "split", "side", F.inline(t.typed_keys(F.col("w"))))


@query("first_owner_collisions", f"""WITH {_SIDES} {_KEYED}
owner AS (SELECT key_type, key, arg_min(split, (row, split)) AS owner FROM keyed GROUP BY ALL)
SELECT key_type, key, owner, sum(n)::BIGINT AS collisions FROM (SELECT key_type, key, split, owner, count(DISTINCT row) AS n FROM keyed JOIN owner USING (key_type, key) WHERE split <> owner GROUP BY ALL) GROUP BY key_type, key, owner""")
def first_owner_collisions(q):
    return m.owner_collisions(_keyed(q), "row")


@query("collision_classify", f"""WITH {_SIDES} {_KEYED}
per AS (SELECT key_type, key, count(DISTINCT split) FILTER (side = 'clean') AS clean_splits, min(split) FILTER (side = 'clean') AS owner FROM keyed GROUP BY ALL HAVING count(DISTINCT split) > 1),
aff AS (SELECT key_type, key, count(DISTINCT row) AS affected FROM keyed JOIN per USING (key_type, key) WHERE side = 'noisy' AND clean_splits <= 1 AND (owner IS NULL OR split <> owner) GROUP BY ALL)
SELECT key_type, key, clean_splits, clean_splits > 1 AS clean_collision, coalesce(affected, 0) AS affected FROM per LEFT JOIN aff USING (key_type, key)""")
def collision_classify(q):
    """Only keys that may lie in several splits are hashed in full."""
    spaced = lambda c: F.when(F.col(c).isNotNull(), t.spaced_words(F.col(c)))
    rows = _rows(q).where("split IS NOT NULL").select(F.col("id").alias("row"), "split", spaced("target").alias("clean"), spaced("input").alias("noisy"))
    out = m.classify_collisions(crossing.keyed(rows))
    return out.withColumn("key", F.lower(F.hex("key")))


@query("guard_pairs", f"""WITH {_SIDES} {_KEYED}
per AS (SELECT key_type, key, min(split) FILTER (side = 'clean') AS owner FROM keyed GROUP BY ALL HAVING count(DISTINCT split) > 1 AND count(DISTINCT split) FILTER (side = 'clean') <= 1),
hit AS (SELECT DISTINCT row AS id FROM keyed JOIN per USING (key_type, key) WHERE side = 'noisy' AND (owner IS NULL OR split <> owner))
SELECT d.id, CASE WHEN hit.id IS NOT NULL THEN target ELSE input END AS input, target, CASE WHEN hit.id IS NOT NULL THEN 'identity' ELSE category END AS category, hit.id IS NOT NULL AS guarded FROM data_row d LEFT JOIN hit ON d.id = hit.id""")
def guard_pairs(q):
    return m.guard_pairs(q.data_row.select("id", "input", "target", "category"), _keyed(q))


@query("pair_alignment", f"""
WITH a AS (SELECT DISTINCT id, document_id, {_SPLIT} AS split FROM data_row WHERE category <> 'keyboard'), b AS (SELECT DISTINCT id, document_id, CASE WHEN id LIKE '%7' THEN 'test' ELSE {_SPLIT} END AS split FROM data_row WHERE category <> 'delete')
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'extra' WHEN a.document_id IS DISTINCT FROM b.document_id THEN 'differs:document_id' ELSE 'differs:split' END AS problem
FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.document_id IS DISTINCT FROM b.document_id OR a.split IS DISTINCT FROM b.split""")
def pair_alignment(q):
    """The table beside a copy of itself with other rows missing and some splits changed."""
    rows = _rows(q)
    clean = rows.where("category != 'keyboard'").select("id", "document_id", "split").distinct()
    noisy = rows.where("category != 'delete'").select("id", "document_id", F.when(F.col("id").like("%7"), "test").otherwise(F.col("split")).alias("split")).distinct()
    return m.misaligned(clean, noisy, "id", ["document_id", "split"])


@query("document_split_owner", f"SELECT document_id, count(DISTINCT {_SPLIT}) AS splits, count(*) AS n FROM data_row WHERE document_id IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_SPLIT}) > 1")
def document_split_owner(q):
    return m.crossing(_rows(q), "document_id", "split")


@query("clean_target_owner", f"SELECT key, count(DISTINCT split) AS splits, count(*) AS n FROM (SELECT {_KEY_WORDS} AS key, {_SPLIT} AS split FROM data_row WHERE target IS NOT NULL AND split IS NOT NULL) GROUP BY key HAVING count(DISTINCT split) > 1")
def clean_target_owner(q):
    return m.crossing(_rows(q).select(F.array_join(t.words(F.col("target")), " ").alias("key"), "split"), "key", "split")


@query("split_word_overlap", f"""
WITH k AS (SELECT DISTINCT {_KEY_WORDS} AS key, {_SPLIT} AS split FROM data_row WHERE target IS NOT NULL AND split IS NOT NULL)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM k a JOIN k b ON a.key = b.key AND a.split < b.split GROUP BY ALL""")
def split_word_overlap(q):
    return m.split_pairs_shared(_rows(q).select(F.array_join(t.words(F.col("target")), " ").alias("key"), "split"), "key", "split")


@query("eval_exact_overlap", f"""SELECT case_id, count(DISTINCT d.source) AS sources, min(d.source) AS first_source
FROM (SELECT id AS case_id, {s.fold('expected')} AS key FROM dataset_case UNION SELECT id, {s.fold('input')} FROM dataset_case) c JOIN (SELECT {s.fold('text')} AS key, source FROM clean_document) d USING (key) GROUP BY 1""")
def eval_exact_overlap(q):
    cases = q.dataset_case.select(F.col("id").alias("case_id"), F.explode(F.array("expected", "input")).alias("x")).select("case_id", t.fold_diacritics(F.col("x")).alias("key")).distinct()
    docs = q.clean_document.select(t.fold_diacritics(F.col("text")).alias("key"), "source")
    return docs.join(cases, "key").groupBy("case_id").agg(F.countDistinct("source").alias("sources"), F.min("source").alias("first_source"))


@query("reserved_leak", f"""WITH k AS (SELECT id, {_SPLIT} AS split, {_KEY_WORDS} AS key FROM data_row WHERE target IS NOT NULL)
SELECT DISTINCT id FROM k SEMI JOIN (SELECT key FROM k WHERE split = 'test') r USING (key) WHERE split = 'train'""")
def reserved_leak(q):
    rows = _rows(q).where("target IS NOT NULL").select("id", "split", F.array_join(t.words(F.col("target")), " ").alias("key"))
    return rows.where("split = 'train'").join(rows.where("split = 'test'").select("key"), "key", "left_semi").select("id").distinct()


@query("paired_before_after", """SELECT id, category, CASE WHEN NOT b AND a THEN 'fixed' WHEN b AND NOT a THEN 'regressed' WHEN b AND a THEN 'retained-correct' ELSE 'open' END AS status
FROM (SELECT DISTINCT d.id, d.category, lower(d.input) = lower(d.target) AS b, p.input = p.target AS a FROM data_row d JOIN correction_pair p ON d.document_id = p.document_id WHERE d.input IS NOT NULL AND d.target IS NOT NULL AND p.input IS NOT NULL AND p.target IS NOT NULL AND d.document_id <> 'doc-journal')""")
def paired_before_after(q):
    a = q.data_row.where("document_id != 'doc-journal'").select("id", "category", "document_id", (F.lower("input") == F.lower("target")).alias("b")).where("b IS NOT NULL")
    b = q.correction_pair.select("document_id", (F.col("input") == F.col("target")).alias("a")).where("a IS NOT NULL").distinct()
    both = a.join(b, "document_id").select("id", "category", "b", "a").distinct()
    return both.select("id", "category", m.paired_status(F.col("b"), F.col("a")).alias("status"))


@query("regression_diff", f"SELECT DISTINCT id, CASE WHEN input = target THEN 'regressed' ELSE 'improved' END AS change FROM data_row WHERE (input = target) <> ({s.fold('input')} = {s.fold('target')})")
def regression_diff(q):
    """Rows whose verdict changes once diacritics are disregarded."""
    strict, loose = F.col("input") == F.col("target"), t.fold_diacritics(F.col("input")) == t.fold_diacritics(F.col("target"))
    return q.data_row.where(strict != loose).select("id", F.when(strict, "regressed").otherwise("improved").alias("change")).distinct()


@query("gold_amend", """SELECT id, CASE WHEN c.after IS NOT NULL THEN c.after ELSE target END AS target, c.after IS NOT NULL AS amended FROM (SELECT DISTINCT id, target FROM correction_pair) p
LEFT JOIN (SELECT DISTINCT target AS before, upper(target) AS after FROM data_row WHERE target LIKE 'X%') c ON p.target = c.before""")
def gold_amend(q):
    """A change applies only where the text before it is the one that was reviewed."""
    changes = q.data_row.where("target LIKE 'X%'").select("target", F.upper("target").alias("after")).distinct()
    rows = q.correction_pair.select("id", "target").distinct()
    return rows.join(changes, "target", "left").select("id", F.coalesce("after", "target").alias("target"), F.col("after").isNotNull().alias("amended"))


@query("review_upsert", """
WITH o AS (SELECT document_id AS k, min(id) AS id, max(target) AS v, epoch_us(min(created_at)) AS at_time FROM data_row WHERE document_id IS NOT NULL GROUP BY 1),
n AS (SELECT document_id AS k, min(id) AS id, max(target) AS v, epoch_us(max(created_at)) AS at_time FROM correction_pair WHERE document_id IS NOT NULL GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, coalesce(o.id, n.id) AS id, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v, CASE WHEN n.k IS NOT NULL THEN n.at_time ELSE o.at_time END AS at_time
FROM o FULL JOIN n ON o.k = n.k ORDER BY at_time DESC, k LIMIT 500""")
def review_upsert(q):
    """A known key takes the new values and keeps its id; the newest 500 stay."""
    old = q.data_row.where("document_id IS NOT NULL").groupBy(F.col("document_id").alias("k")).agg(F.min("id").alias("id"), F.max("target").alias("v"), F.unix_micros(F.min("created_at")).alias("at_time"))
    new = q.correction_pair.where("document_id IS NOT NULL").groupBy(F.col("document_id").alias("k")).agg(F.min("id").alias("id"), F.max("target").alias("v"), F.unix_micros(F.max("created_at")).alias("at_time"))
    return m.upserted(old, new, ["k"], "id", 500, "at_time")


_SETS = f"""base AS (SELECT document_id AS id, list_sort({s.ngrams('w', 5)}) AS g FROM (SELECT document_id, {s.words('text')} AS w FROM clean_document WHERE text IS NOT NULL)),
reps AS (SELECT min(id) AS id, g, len(g) AS n FROM base WHERE len(g) > 0 GROUP BY g),
e AS (SELECT id, n, unnest(g) AS gram FROM reps),
pairs AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared, round(count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS jaccard, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL)"""


def _reps(q, n: int = 5):
    w = q.clean_document.where("text IS NOT NULL").select("document_id", t.words(F.col("text")).alias("w"))
    return similarity.representatives(w.select("document_id", t.word_ngrams(F.col("w"), n).alias("grams")), "document_id", "grams")


@query("jaccard_pairs", f"WITH {_SETS} SELECT id_a, id_b, shared, jaccard FROM pairs WHERE jaccard >= 0.8")
def jaccard_pairs(q):
    """Distinct texts whose five-word shingles overlap by 0.8 or more; `jaccard_members` tells whose copies they are."""
    return similarity.jaccard_pairs(_reps(q)[0])


@query("jaccard_pairs_min3", f"WITH {_SETS} SELECT id_a, id_b, shared, jaccard FROM pairs WHERE jaccard >= 0.8 AND na >= 3 AND nb >= 3")
def jaccard_pairs_min3(q):
    return similarity.jaccard_pairs(_reps(q)[0], least=3)


@query("jaccard_allpairs", f"WITH {_SETS} SELECT id_a, id_b, shared, jaccard FROM pairs WHERE jaccard >= 0.95")
def jaccard_allpairs(q):
    """The audit at another threshold; the prefix filter stays exact, no pair of all is formed."""
    return similarity.jaccard_pairs(_reps(q)[0], threshold=0.95)


@query("jaccard_members", f"WITH {_SETS} SELECT base.id AS document_id, reps.id AS rep FROM base JOIN reps USING (g)")
def jaccard_members(q):
    reps, members = _reps(q)
    return members.join(reps.where("n > 0").select(F.col("id").alias("rep")), "rep", "left_semi").select("document_id", "rep")


def _trigrams(rows, id: str, text: str):
    w = rows.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.split(t.norm_number_class(F.col(text)), " ").alias("w"))
    return w.select("id", t.word_ngrams(F.col("w"), 5).alias("grams"))


_NORM = rf"regexp_extract_all(regexp_replace({{}}, '\d+', ' <n> ', 'g'), '[a-z]+|<n>')"
_NOVEL = f"""q AS (SELECT id, {s.ngrams(_NORM.format(s.fold('expected')), 5)} AS g FROM dataset_case WHERE expected IS NOT NULL),
r AS (SELECT document_id AS id, {s.ngrams('w', 5)} AS g FROM (SELECT document_id, {_NORM.format(s.fold('text'))} AS w FROM clean_document WHERE text IS NOT NULL)),
p AS (SELECT a.id, b.id AS rid, round(count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS score
  FROM (SELECT id, len(g) AS n, unnest(g) AS gram FROM q) a JOIN (SELECT id, len(g) AS n, unnest(g) AS gram FROM r) b USING (gram) GROUP BY a.id, b.id)"""


@query("novelty_trigram", f"WITH {_NOVEL} SELECT q.id, coalesce(max(score), 0.0)::DOUBLE AS score, arg_min(rid, (-score, rid)) AS nearest FROM q LEFT JOIN p ON q.id = p.id GROUP BY q.id")
def novelty_trigram(q):
    """The cases' highest similarity with any document, numbers as a class, on five-word shingles."""
    return similarity.novelty(_trigrams(q.dataset_case, "id", "expected"), _trigrams(q.clean_document, "document_id", "text"))


@query("novelty_stream", f"WITH {_NOVEL} SELECT rid AS document_id, count(*) AS hits, max(score) AS score FROM p GROUP BY rid")
def novelty_stream(q):
    """The other direction: each document's hits among the cases."""
    small, big = (cut(_trigrams(*x), "sets") for x in ((q.dataset_case, "id", "expected"), (q.clean_document, "document_id", "text")))
    a = small.select(F.col("id").alias("qid"), F.size("grams").alias("nq"), F.explode("grams").alias("gram"))
    b = big.select(F.col("id").alias("document_id"), F.size("grams").alias("nr"), F.explode("grams").alias("gram"))
    both = b.join(a, "gram").groupBy("document_id", "nr", "qid", "nq").agg(F.count("*").alias("shared"))
    score = F.round(F.col("shared") / (F.col("nq") + F.col("nr") - F.col("shared")), 6)
    return both.withColumn("score", score).groupBy("document_id").agg(F.count("*").alias("hits"), F.max("score").alias("score"))


def _cluster_links(q):
    docs = q.clean_document.where("text IS NOT NULL")
    whole = docs.select(F.concat(F.lit("d:"), F.sha2(t.norm_ci(F.col("text")), 256)).alias("key"), "document_id")
    sentence = segment_fallback(docs).where(F.length("segment") >= 20).select(F.concat(F.lit("s:"), F.sha2(t.fold_diacritics(F.col("segment")), 256)).alias("key"), "document_id")
    links = components.star(whole.unionByName(sentence), "key", "document_id")
    near = similarity.jaccard_pairs(_reps(q)[0]).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return links.unionByName(near)


_CLUSTERS = f"""{_SETS},
keys AS (SELECT document_id, 'd' || {s.collapse(s.lower('nfc_normalize(text)'))} AS k FROM clean_document WHERE text IS NOT NULL
  UNION SELECT document_id, 's' || {s.fold('s')} FROM {s.segments('clean_document', 'document_id', 'text')} WHERE length(s) >= 20),
l0 AS (SELECT k, min(document_id) AS a FROM keys GROUP BY k HAVING count(*) > 1),
l AS (SELECT DISTINCT a, document_id AS b FROM l0 JOIN keys USING (k) WHERE document_id <> a UNION SELECT id_a, id_b FROM pairs WHERE jaccard >= 0.8),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(node, seen) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, reach.seen FROM reach JOIN u ON reach.node = u.a)"""


@query("cluster_documents", f"WITH RECURSIVE {_CLUSTERS} SELECT node, min(seen) AS root FROM reach GROUP BY node")
def cluster_documents(q):
    """Documents joined by equal text, a shared sentence, or similarity of 0.8."""
    return components.contract(_cluster_links(q))


@query("union_families", f"""WITH RECURSIVE keys AS (SELECT DISTINCT 'd:' || document_id AS n, 'g:' || lower(trim(group_id)) AS k FROM correction_pair WHERE document_id IS NOT NULL AND group_id LIKE 'g-0%'),
u AS (SELECT n AS a, k AS b FROM keys UNION SELECT k, n FROM keys),
reach(node, seen) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, reach.seen FROM reach JOIN u ON reach.node = u.a)
SELECT node, min(seen) AS root FROM reach GROUP BY node""")
def union_families(q):
    links = q.correction_pair.where("document_id IS NOT NULL AND group_id LIKE 'g-0%'")
    return components.contract(links.select(F.concat(F.lit("d:"), "document_id").alias("a"), F.concat(F.lit("g:"), F.lower(F.trim("group_id"))).alias("b")))


_HASH = "(('0x' || substr(sha256({}), 1, 8))::BIGINT)::DOUBLE / 4294967296.0"


@query("cluster_split", f"""WITH RECURSIVE {_CLUSTERS}, roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node),
d AS (SELECT root, count(*)::VARCHAR || ':' || sum(('0x' || substr(sha256(node), 1, 12))::BIGINT)::VARCHAR AS digest FROM roots GROUP BY root)
SELECT node, CASE WHEN {_HASH.format("'split-v1:' || digest")} < 0.8 THEN 'train' WHEN {_HASH.format("'split-v1:' || digest")} < 0.9 THEN 'validation' ELSE 'test' END AS split FROM roots JOIN d USING (root)""")
def cluster_split(q):
    return splits.cluster_split(components.contract(_cluster_links(q)), "node", "root")


@query("source_split", """SELECT source, CASE WHEN n < 3 THEN NULL WHEN r <= t THEN 'train' WHEN r <= t + least(n - t - 1, greatest(1, floor(n * 0.1))) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, least(n - 2, greatest(1, floor(n * 0.8))) AS t FROM (SELECT source, row_number() OVER (ORDER BY sha256('42:' || source)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)))""")
def source_split(q):
    return splits.source_split(q.documents, "source")


@query("mod10_split", "SELECT doc_id, CASE WHEN h % 10 < 2 THEN 'test' WHEN h % 10 = 2 THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT AS h FROM documents)")
def mod10_split(q):
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12), 16, 10).cast("long")
    return q.documents.select("doc_id", splits.mod_split(h).alias("split"))


@query("index_split", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents")
def index_split(q):
    return q.documents.select("doc_id", F.when(F.pmod("doc_id", F.lit(5)) == 0, "test").otherwise("train").alias("split"))


@query("sample_fixed", "SELECT doc_id, n_chars FROM documents ORDER BY sha256('42:' || doc_id::VARCHAR), doc_id LIMIT 200")
def sample_fixed(q):
    return splits.sample_fixed(q.documents.select("doc_id", "n_chars"), "doc_id", 200)


@query("sample_groups", "SELECT document_id, count(*) AS n FROM data_row SEMI JOIN (SELECT document_id FROM (SELECT DISTINCT document_id FROM data_row WHERE document_id IS NOT NULL) ORDER BY sha256('42:' || document_id), document_id LIMIT 50) g USING (document_id) GROUP BY document_id")
def sample_groups(q):
    some = splits.sample_fixed(q.data_row.where("document_id IS NOT NULL").select("document_id").distinct(), "document_id", 50)
    return q.data_row.join(some, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("n"))


@query("shuffle_buffer", "SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(sha256('42:' || doc_id::VARCHAR), 1, 16))::UBIGINT, doc_id) AS place FROM documents")
def shuffle_buffer(q):
    """A seeded order of all rows, with its places: ranges are numbered side by side, no row goes through one task."""
    ordered = splits.shuffle_order(q.documents.select("doc_id"), "doc_id")
    parts = ordered.withColumn("part", F.spark_partition_id()).withColumn("inner", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33))
    return number_rows(parts)


def number_rows(parts):
    kept = cut(parts, "ordered")
    sizes = kept.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one row per partition
    before, at = {}, 0
    for r in sizes:
        before[r["part"]] = at
        at += r["n"]
    offsets = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    return kept.select("doc_id", (F.col("inner") + 1 + F.element_at(offsets, F.col("part"))).alias("place"))


@query("stable_rotation", "SELECT document_id, id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY NOT changed, sha256('42:' || document_id || ':' || id), id) AS rank FROM (SELECT DISTINCT document_id, id, input <> target AS changed FROM data_row WHERE document_id IS NOT NULL AND input IS NOT NULL AND target IS NOT NULL)) WHERE rank <= 16")
def stable_rotation(q):
    rows = q.data_row.where("document_id IS NOT NULL AND input IS NOT NULL AND target IS NOT NULL").select("document_id", "id", (F.col("input") != F.col("target")).alias("changed")).distinct()
    return splits.stable_rotation(rows, "document_id", "changed", "id", 16)


@query("set_union", "SELECT document_id FROM data_row WHERE document_id IS NOT NULL UNION SELECT document_id FROM correction_pair WHERE document_id IS NOT NULL")
def set_union(q):
    return q.data_row.select("document_id").union(q.correction_pair.select("document_id")).where("document_id IS NOT NULL").distinct()


@query("set_intersect", "SELECT document_id FROM data_row INTERSECT SELECT document_id FROM correction_pair")
def set_intersect(q):
    return q.data_row.select("document_id").intersect(q.correction_pair.select("document_id"))


@query("set_difference", "SELECT document_id FROM data_row EXCEPT SELECT document_id FROM correction_pair")
def set_difference(q):
    return q.data_row.select("document_id").subtract(q.correction_pair.select("document_id"))


@query("union_all", "SELECT split, count(*) AS n FROM (SELECT split FROM data_row UNION ALL SELECT split FROM correction_pair) GROUP BY split")
def union_all(q):
    return q.data_row.select("split").unionAll(q.correction_pair.select("split")).groupBy("split").agg(F.count("*").alias("n"))


@query("vector_top_k", """SELECT query, neighbour, rank::INT AS rank, cosine FROM (SELECT q.vec_id AS query, v.vec_id AS neighbour, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS cosine,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank
FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 10""")
def vector_top_k(q):
    """Queries are the rows whose id is divisible by 20, against all rows."""
    return similarity.cosine_top(q.embeddings, q.embeddings.where("vec_id % 20 = 0"), 10)
