"""Problem 10: the language of documents and of each stretch of whole sentences in mixed ones.

Evidence is fused by Bayes' rule. The text's likelihood comes from a model of hashed letter trigrams and words per language, and of the scripts each is
written in. It is fitted on some `FIT_ROWS` documents with a declared language, chosen by a hash: first by what they declare,
then, because declarations are often wrong, by what the model so far finds. The prior joins the declared language, by
how often each declaration stands at each language, and the host's: counts of the institution, smoothed towards its source, that towards
the source's suffix, that towards all documents, each a grouped aggregation. Sentences of a document form a chain in which
the language seldom changes; a change is drawn from the document's prior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut

# The languages, other codes for them, codes that say nothing, and the scripts each language is written in.
LANGUAGES = ("az", "tr", "en", "ru", "de", "fa", "hi", "zh", "ja", "th", "az-Cyrl")  # a language in another script is a class of its own
CODES = {
    "aze": "az", "azj": "az", "azb": "az", "tur": "tr", "eng": "en", "rus": "ru", "deu": "de", "ger": "de", "fas": "fa", "per": "fa", "pes": "fa",
    "hin": "hi", "zho": "zh", "chi": "zh", "cmn": "zh", "jpn": "ja", "tha": "th",
}
NOTHING = ("", "und", "unknown", "none", "null", "mul", "mis", "zxx", "n/a", "-")
SCRIPTS = {
    "Latin": {"az": 1.0, "tr": 1.0, "en": 1.0, "de": 1.0}, "Cyrillic": {"az-Cyrl": 1.0, "ru": 1.0}, "Arabic": {"fa": 1.0}, "Devanagari": {"hi": 1.0},
    "Han": {"zh": 1.0, "ja": 0.4}, "Kana": {"ja": 0.6}, "Thai": {"th": 1.0},
}

#: Documents with a declared language the text model is fitted on; priors are counted over all documents.
FIT_ROWS = 20_000

#: Hash buckets (of trigrams, and again of words), weight of the correlated features beside one independent observation,
#: probability of a change of language between sentences, strength of each level of the host's prior, probability of a letter of a foreign script,
#: letters from which on a sentence's words count in full (a shorter one is mostly names and abbreviations).
BITS, TEMPER, CHANGE, SMOOTH, FOREIGN, FULL = 16, 0.3, 0.001, 20.0, 2e-3, 80

_LINE = r"\r\n\v\f\x85\u2028\u2029"
_CLOSE = "[»”\"’)\\]」』]*"
_MARK, _FULL_STOP, _THAI = ".!?…", "。！？।؟۔", "\u0e00-\u0e7f"
# each begins with a set of characters, which the search skips to; a space is one only where there is Thai
_AFTER = f"(?<=[{_LINE}])[{_LINE}]*|(?<=[{_MARK}])[{_MARK}]*{_CLOSE}(?=\\s|$)|(?<=[{_FULL_STOP}])[{_FULL_STOP}]*{_CLOSE}"
_END = re.compile(f"[{_LINE}{_MARK}{_FULL_STOP}](?:{_AFTER})")
_END_THAI = re.compile(f"[{_LINE}{_MARK}{_FULL_STOP} ](?:{_AFTER}|(?<=[{_THAI}] ) *)")
_HAS_THAI = re.compile(f"[{_THAI}]")
_LETTER = re.compile(r"[^\W\d_]")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|(?:https?://|www\.)[!-~]+")  # in no language
_INDEX = {lang: i for i, lang in enumerate(LANGUAGES)}
_BASE = np.array([_INDEX[lang.partition("-")[0]] for lang in LANGUAGES])
_SCRIPT_NAMES = tuple(SCRIPTS)


def declared(lang: Column) -> Column:
    """The declared language without region, letter case and padding; null where nothing is declared, the code itself where it is none of the ten."""
    base = F.element_at(F.split(F.lower(F.trim(lang)), "[-_]"), 1)
    known = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    whole = F.lower(F.trim(lang))
    return F.when(~whole.isin(*NOTHING) & (base != ""), F.coalesce(F.element_at(known, base), base))


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences that have a letter. In Thai a space ends one; text without a letter belongs to none."""
    out, at = [], 0
    end = _END if text.isascii() or not _HAS_THAI.search(text) else _END_THAI
    for hi in [m.end() for m in end.finditer(text)] + [len(text)]:
        piece = text[at:hi]
        if _LETTER.search(piece):
            kept = piece.rstrip()
            out.append((hi - len(piece.lstrip()), at + len(kept)))
        at = hi
    return out


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower-case letter (0 for others), the same with Azerbaijani diacritics folded, the number of its script plus one."""
    import unicodedata

    low, plain, script = (np.zeros(0x32400, dtype=t) for t in (np.uint32, np.uint32, np.uint8))
    fold = str.maketrans("əıöüçşğ", "eioucsg")
    named = [(regex.compile(r"[\p{Hiragana}\p{Katakana}ー]" if n == "Kana" else rf"\p{{{n}}}"), i + 1) for i, n in enumerate(_SCRIPT_NAMES)]
    for code in range(0x32400):
        c = chr(code)
        if unicodedata.category(c)[0] not in "LM":
            continue
        lower = "i" if c == "İ" else c.lower()
        lower = lower if len(lower) == 1 else c
        low[code], plain[code] = ord(lower), ord(lower.translate(fold))
        for pattern, number in named:
            if pattern.match(c):
                script[code] = number
                break
    return low, plain, script


_CACHE: list = []


def _cached():
    if not _CACHE:
        _CACHE.extend(_tables())
    return _CACHE


def _script_scores() -> np.ndarray:
    out = np.full((len(SCRIPTS) + 1, len(LANGUAGES)), np.log(FOREIGN), dtype=np.float32)
    out[0] = 0.0
    for i, by_language in enumerate(SCRIPTS.values()):
        for lang, p in by_language.items():
            out[i + 1, _INDEX[lang]] = np.log(p)
    return out


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def features(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sentences: bucket and sentence of each feature (trigrams around every letter, then words), script and sentence of each letter."""
    low, plain, script = _cached()
    codes = np.frombuffer("\n".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.cumsum(codes == 10)
    at = np.where(codes < len(low), codes, 0)
    c, scripts = low[at].astype(np.uint64), script[at]
    letter = c > 0
    # a gap of any length is one space
    keep = letter | np.r_[True, letter[:-1]]
    c, p, owner, scripts, letter = c[keep], plain[at][keep].astype(np.uint64), owner[keep], scripts[keep], letter[keep]
    if not letter.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    before, after = np.r_[np.uint64(0), c[:-1]], np.r_[c[1:], np.uint64(0)]
    h = ((before * np.uint64(1_000_003) + c) * np.uint64(1_000_003) + after) * _MULTIPLIER
    tri = (h[letter] >> np.uint64(64 - BITS)).astype(np.int64)
    start = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
    run = np.arange(len(c)) - np.repeat(start, np.diff(np.r_[start, len(c)])) if start[0] == 0 else np.arange(len(c)) - np.r_[np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.r_[start, len(c)]))]
    mixed = np.where(letter, (p + np.uint64(7)) * (run.astype(np.uint64) * np.uint64(2) + np.uint64(0x1F123BB5)) * _MULTIPLIER, np.uint64(0))
    words = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), start) * _MULTIPLIER
    word = (words >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)
    return np.r_[tri, word], np.r_[owner[letter], owner[start]], scripts[letter].astype(np.int64), owner[letter]


class Model:
    """Log-probabilities of the features per language, from counts (2 * 2**BITS, classes)."""

    def __init__(self, counts: np.ndarray):
        half = 1 << BITS
        self.logp = np.empty(counts.shape, dtype=np.float32)
        for part in (slice(0, half), slice(half, 2 * half)):
            c = counts[part].astype(np.float64)
            every = c.sum(1, keepdims=True) + 0.5
            every /= every.sum()
            self.logp[part] = np.log((c + 0.5 + 200.0 * every) / (c.sum(0) + 0.5 * half * 0.2 + 200.0))
        self.scripts = _script_scores()

    def score(self, pieces: list[str]) -> np.ndarray:
        """Tempered log-likelihoods (sentences, classes), their best set to 0."""
        bucket, owner, script, letter_of = features(pieces)
        out = np.zeros((len(pieces), len(LANGUAGES)))
        if len(bucket):
            half = len(script)  # trigrams, one per letter, then words; both in the order of the sentences
            for lo, hi in ((0, half), (half, len(bucket))):
                first = np.flatnonzero(np.r_[True, owner[lo + 1 : hi] != owner[lo : hi - 1]])
                out[owner[lo:hi][first]] += np.add.reduceat(self.logp[bucket[lo:hi]], first, axis=0)
            letters = np.bincount(letter_of, minlength=len(pieces))
            out *= np.minimum(1.0, letters / FULL)[:, None]
            kinds = len(SCRIPTS) + 1
            out += np.bincount(letter_of * kinds + script, minlength=len(pieces) * kinds).reshape(-1, kinds) @ self.scripts
        out -= out.max(1, keepdims=True)
        return TEMPER * out


def _chunks(texts: list[str | None], most: int = 200_000) -> Iterator[tuple[list[int], list[str], list[tuple[int, int]]]]:
    """Sentences of texts in chunks of some `most` characters: the text's number, the sentence, its span."""
    of, pieces, spans, size = [], [], [], 0
    for i, text in enumerate(texts):
        for lo, hi in sentences(text) if text else ():
            of.append(i)
            piece = text[lo:hi]
            pieces.append(_ADDRESS.sub(" ", piece) if "@" in piece or "://" in piece or "www." in piece else piece)
            spans.append((lo, hi))
            size += hi - lo
        if size > most:
            yield of, pieces, spans
            of, pieces, spans, size = [], [], [], 0
    if pieces:
        yield of, pieces, spans


def _counted(docs: DataFrame, model: Model | None) -> np.ndarray:
    """Feature counts per class over documents `(text, said)`: by the declared language, or by what `model` finds in a
    sentence where it is sure. The driver gets at most 2 * 2**BITS counts per class, whatever the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(LANGUAGES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = shared.value, np.zeros((2 << BITS) * n, dtype=np.int64)
        scripts = _script_scores()
        for batch in batches:
            said = batch.column("said").to_pylist()
            for of, pieces, _ in _chunks(batch.column("text").to_pylist()):
                bucket, owner, script, letter_of = features(pieces)
                if m is None:
                    said_by = np.array([_INDEX.get(said[i], -1) for i in of])
                    fits = np.zeros((len(pieces), n))
                    for j in range(n):
                        fits[:, j] = np.bincount(letter_of, scripts[script, j], len(pieces))
                    # of the declared language the class whose script fits; if none does, it is no evidence
                    own = np.where(_BASE[None, :] == said_by[:, None], fits, -np.inf)
                    lang = np.where((said_by >= 0) & (own.max(1) > fits.max(1) - 25.0), own.argmax(1), -1)
                else:
                    score = m.score(pieces)
                    best = score.argmax(1)
                    score[np.arange(len(best)), best] = -np.inf
                    lang = np.where(score.max(1) < -3.0, best, -1)
                known = lang[owner] >= 0
                total += np.bincount(bucket[known] * n + lang[owner][known], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch({"at": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"at": [batch.column(0).to_numpy().astype(np.int32).tobytes()], "n": [batch.column(1).to_numpy().astype(np.int64).tobytes()]})

    per_task = docs.select("text", "said").where("text IS NOT NULL").mapInArrow(count, "at int, n long")
    packed = per_task.groupBy("at").agg(F.sum("n").alias("n")).mapInArrow(pack, "at binary, n binary")
    out = np.zeros((2 << BITS) * n, dtype=np.int64)
    for row in packed.toLocalIterator():
        out[np.frombuffer(row["at"], np.int32)] = np.frombuffer(row["n"], np.int64)
    return out.reshape(-1, n)


def fit(docs: DataFrame, function_word: DataFrame, rounds: int = 2, rows: int = FIT_ROWS) -> Model:
    """The model of some `rows` labelled documents of `docs (doc_id, text, said)`, whole texts, taken by a hash of the id (all where there are
    fewer); the function words (a fixed table) are seen some more times for their language."""
    labelled = docs.where("text IS NOT NULL").where(F.col("said").isin(*LANGUAGES))
    share = rows / max(1, labelled.count())
    if share < 1.0:
        labelled = labelled.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = cut(labelled.select("text", "said"), "fit")
    seed = np.zeros((2 << BITS, len(LANGUAGES)), dtype=np.int64)
    for row in function_word.where("word IS NOT NULL").select("lang", "word").distinct().collect():
        if row["lang"] in _INDEX:
            bucket, *_ = features([row["word"]])
            np.add.at(seed[:, _INDEX[row["lang"]]], bucket, 20)
    model = None
    for _ in range(1 + rounds):
        model = Model(seed + _counted(sample, model))
    return model


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """`(doc_id, said, institution, source, scores, starts, ends, counts)`: log-likelihoods and spans of each document's sentences, and
    the share of its letters per class. Documents without a letter have no row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(LANGUAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for of, pieces, spans in _chunks(batch.column("text").to_pylist()):
                score, of = m.score(pieces), np.array(of)
                spans = np.array(spans, dtype=np.int32)
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                edges = np.r_[first, len(of)]
                size = (spans[:, 1] - spans[:, 0]).astype(float)
                share = np.zeros((len(of), n))
                share[np.arange(len(of)), score.argmax(1)] = size
                share = np.add.reduceat(share, first)
                share /= share.sum(1, keepdims=True)
                take = pa.array(of[first])
                lists = lambda values, width=1: pa.ListArray.from_arrays(pa.array((edges * width).astype(np.int32)), values)
                yield pa.record_batch([
                    *(batch.column(c).take(take) for c in ("doc_id", "said", "institution", "source")),
                    lists(pa.array(score.astype(np.float32).ravel()), n), lists(pa.array(spans[:, 0])), lists(pa.array(spans[:, 1])),
                    pa.ListArray.from_arrays(pa.array((np.arange(len(first) + 1) * n).astype(np.int32)), pa.array(share.ravel())),
                ], names=["doc_id", "said", "institution", "source", "scores", "starts", "ends", "counts"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, said string, institution string, source string, scores array<float>, starts array<int>, ends array<int>, counts array<double>"
    return docs.select("doc_id", "said", "institution", "source", "text").where("text IS NOT NULL").mapInArrow(run, schema)


def _sums() -> list[Column]:
    return [F.sum(F.col("counts")[j]).alias(f"c{j}") for j in range(len(LANGUAGES))]


def host_priors(known: DataFrame) -> DataFrame:
    """`(row, prior)`, one value per class: the institution's counts, smoothed by its source's, those by the suffix's, those by all. Only the rows' keys
    go through the levels, not their evidence."""
    row = known.agg(*_sums()).first()  # one row
    counts = [float(row[j] or 0.0) for j in range(len(LANGUAGES))]
    total = sum(counts) + len(LANGUAGES)
    out = known.select("row", "suffix", "source", "institution").withColumn("prior", F.array(*(F.lit((c + 1.0) / total) for c in counts)))
    for key in ("suffix", "source", "institution"):
        out = cut(_with_group(out, known, key, total), "priors")
    return out.select("row", "prior")


#: A group with more than this share of the documents is joined by broadcast: there are fewer than 1 / HOT such groups.
HOT = 1 / 64


def _with_group(out: DataFrame, known: DataFrame, key: str, total: float) -> DataFrame:
    """`out` with its prior taken one level down, to the groups of `key`. Rows of large groups never go through a shuffle on the key."""
    columns = [f"c{j}" for j in range(len(LANGUAGES))]
    group = cut(known.where(F.col(key).isNotNull()).groupBy(key).agg(*_sums(), F.count("*").alias("_n")), "groups")
    large = F.col("_n") > total * HOT
    names = [r[key] for r in group.where(large).select(key).collect()]
    hot = F.coalesce(F.col(key).isin(*names), F.lit(False)) if names else F.lit(False)
    parts = [
        out.where(hot).join(F.broadcast(group.where(large).drop("_n")), key),
        out.where(F.col(key).isNotNull() & ~hot).join(group.where(~large).drop("_n"), key),
    ]
    known_groups = parts[0].unionByName(parts[1]).withColumn("prior", _level()).drop(*columns)
    return known_groups.unionByName(out.where(F.col(key).isNull()).select(*known_groups.columns))


def _level() -> Column:
    """The group's counts beside SMOOTH documents of the prior above it."""
    own = F.array(*(F.coalesce(F.col(f"c{j}"), F.lit(0.0)) for j in range(len(LANGUAGES))))
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) + SMOOTH
    return F.zip_with(own, "prior", lambda c, p: (c + SMOOTH * p) / total)


def declaration_table(known: DataFrame) -> dict[str, list[float]]:
    """P(declaration | language) for each declared language, "" for none and "?" for others: one row of counts each."""
    said = F.when(F.col("said").isNull(), "").when(F.col("said").isin(*LANGUAGES), F.col("said")).otherwise("?")  # a declaration has no script
    rows = {r["said"]: [float(r[f"c{j}"] or 0.0) for j in range(len(LANGUAGES))] for r in known.groupBy(said.alias("said")).agg(*_sums()).collect()}
    keys = (*(x for x in LANGUAGES if "-" not in x), "", "?")
    table = np.array([rows.get(k, [0.0] * len(LANGUAGES)) for k in keys]) + 1.0
    table /= table.sum(0)
    return {k: [float(x) for x in row] for k, row in zip(keys, table)}


def decode(score: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The likeliest chain of classes of a document's sentences (Viterbi); a document whose sentences agree needs none."""
    n, k = score.shape
    best, log_prior = score.argmax(1), np.log(prior)
    if n == 1:
        return (score + log_prior).argmax(1)
    if (best == best[0]).all():
        return best
    stay, change = np.log(1 - CHANGE), np.log(CHANGE)
    v, back = score[0] + log_prior, np.zeros((n, k), dtype=np.int64)
    for i in range(1, n):
        top = int(v.argmax())
        moved = v[top] + change + log_prior
        stayed = v + stay
        back[i] = np.where(moved > stayed, top, np.arange(k))
        v = np.maximum(moved, stayed) + score[i]
    best[-1] = int(v.argmax())
    for i in range(n - 1, 0, -1):
        best[i - 1] = back[i, best[i]]
    return best


def stretches(docs: DataFrame, function_word: DataFrame) -> DataFrame:
    """`(doc_id, said, seg_no, lang, confidence, start_pos, end_pos)`: the longest runs of whole sentences in one language.

    confidence is the posterior of the stretch's language; positions count code points of the text. Null, empty and
    letterless texts have none; unknown hosts and declarations fall back to what is known above them.
    """
    source = F.replace(F.lower(F.trim("source")), F.lit("_"), F.lit("-"))
    base = docs.select("doc_id", "text", declared(F.col("lang")).alias("said"), F.lower(F.trim("institution")).alias("institution"), source.alias("source"))
    known = cut(evidence(base, fit(base, function_word)).withColumn("row", F.monotonically_increasing_id()), "evidence")
    known = known.withColumn("suffix", F.when(F.col("source").contains("-"), F.substring_index("source", "-", -1)))
    table = declaration_table(known)
    ready = known.join(host_priors(known), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(LANGUAGES)
        odd = np.flatnonzero(_BASE != np.arange(k))
        said_table = np.log(np.array(list(table.values())))
        place = {key: i for i, key in enumerate(table)}

        def posterior(sums: np.ndarray) -> np.ndarray:
            post = np.exp(sums - sums.max(1, keepdims=True))
            for j in odd:  # a language is all its classes
                post[:, _BASE[j]] += post[:, j]
                post[:, j] = 0.0
            return post / post.sum(1, keepdims=True)

        for batch in batches:
            if not batch.num_rows:
                continue
            score = np.asarray(batch.column("scores").flatten()).reshape(-1, k).astype(float)
            starts, ends = (np.asarray(batch.column(c).flatten()) for c in ("starts", "ends"))
            n = np.asarray(pc.list_value_length(batch.column("starts")))
            first = np.r_[0, np.cumsum(n)[:-1]]
            said = np.array([place.get("" if x is None else x if x in _INDEX else "?") for x in batch.column("said").to_pylist()])
            prior = np.log(np.asarray(batch.column("prior").flatten()).reshape(-1, k)) + said_table[said]
            prior -= np.log(np.exp(prior).sum(1, keepdims=True))
            top = score.argmax(1)
            sums = np.add.reduceat(score, first) + prior
            # documents whose sentences agree, at once; of a single sentence the prior has a say
            one = np.minimum.reduceat(top, first) == np.maximum.reduceat(top, first)
            best = _BASE[np.where(n == 1, sums.argmax(1), top[first])]
            at = list(np.flatnonzero(one))
            seg, lang = [0] * len(at), [LANGUAGES[j] for j in best[one]]
            sure = list(np.round(posterior(sums)[np.arange(len(n)), best][one], 4))
            lo, hi = list(starts[first][one]), list(ends[first + n - 1][one])
            for i in np.flatnonzero(~one):
                some = slice(first[i], first[i] + n[i])
                chain = _BASE[decode(score[some], np.exp(prior[i]))]
                cuts = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
                post = posterior(np.add.reduceat(score[some], cuts) + prior[i])
                last = np.r_[cuts[1:], len(chain)] - 1
                at += [i] * len(cuts)
                seg += range(len(cuts))
                lang += [LANGUAGES[j] for j in chain[cuts]]
                sure += list(np.round(post[np.arange(len(cuts)), chain[cuts]], 4))
                lo += list(starts[some][cuts])
                hi += list(ends[some][last])
            take = pa.array(at, pa.int64())
            yield pa.record_batch([
                batch.column("doc_id").take(take), batch.column("said").take(take), pa.array(seg, pa.int32()), pa.array(lang, pa.string()),
                pa.array(sure, pa.float64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()),
            ], names=["doc_id", "said", "seg_no", "lang", "confidence", "start_pos", "end_pos"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, said string, seg_no int, lang string, confidence double, start_pos int, end_pos int"
    return ready.select("doc_id", "said", "scores", "starts", "ends", "prior").mapInArrow(run, schema)


def found(documents: DataFrame, function_word: DataFrame) -> DataFrame:
    """`(doc_id, seg_no, lang)` of the documents whose declared language is missing or not that of the first stretch, or that have several."""
    rows = cut(stretches(documents, function_word), "stretches")
    cases = rows.where("seg_no > 0 OR said IS NULL OR said != lang").select("doc_id").distinct()
    return rows.join(cases, "doc_id", "left_semi").select("doc_id", "seg_no", "lang")
