"""Problem 5: sentence units, by a hidden-event n-gram model.

Between two words of a line there may be a hidden boundary event. A trigram model over word classes gives the events'
probabilities; its counts come from the clear ones among the forward-backward posteriors over all texts, started from line
starts, gaps without a mark and clear priors, and refined in a few passes. A gap is uncertain where a terminal mark stands
outside of quotes and brackets, or, in a script that writes no marks, at a space.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most frequent words that stand for themselves in the model; all others go by their shape. n-grams the model holds at most (10 212 of them on sf0.1); the mass of
#: rarer ones goes to the back-off, since totals are formed from the kept ones.
VOCABULARY, NGRAMS, PASSES = 1500, 400_000, 3
START = "<s>"

_CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}ー々〆]"
_CLOSE = r"[»”“\"’'\)\]）」』》〉›]"
_END = regex.compile(rf"([.!?…。．！？｡।॥؟۔‥]+)({_CLOSE}*)$")
_TOKEN = regex.compile(rf"{_CJK}[。！？…]*{_CLOSE}*(?:[。！？…]+{_CLOSE}*)?|(?:(?!{_CJK})\S)+?(?:[。！？]+{_CLOSE}*(?={_CJK}|\S)|…+(?={_CJK})|(?={_CJK})|(?=\s)|$)")
_GLUED = regex.compile(rf"(?<=\S)[.!?…。．！？｡।॥؟۔‥]+{_CLOSE}*(?=[\p{{L}}\p{{N}}«“„‹\(\[（「『《〈№])")
_ADDRESS = regex.compile(r"@|//|www\.|\.example|\.\p{Ll}+/")
_AFTER_ADDRESS = regex.compile(r"(?:[«“„\(]|\p{Lu}\p{Ll})(?!\S*(?:[@/=&%]|\.\p{Ll}))")
_THAI = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_NUMBER = regex.compile(r"\d+")
_LEAD = regex.compile(r"^\W+")
_OPENING = regex.compile(r"^[«“„\"(\[「『（]+")
_QUOTED = regex.compile(r"[^)\]）\"]")
_ARABIC = regex.compile(r"\p{Arabic}")
_VOWEL_END = regex.compile(r"[aeiouəıöüаеиоуыэюяё]$")
_NO_LETTER = regex.compile(r"[^\p{L}\p{M}]")
_NO_PLAIN_LETTER = regex.compile(r"[^\p{L}]")
_PAIRS = {"«": "»", "“": "”", "„": "“”", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "《": "》", "‹": "›", "〈": "〉"}


_PAIRED = re.compile("[" + re.escape("".join({*_PAIRS, *"".join(_PAIRS.values()), '"'})) + "]")


def _inside(line: str) -> list[tuple[int, int]]:
    """The spans between paired quotes or brackets: (opening index, closing index)."""
    stack, spans, straight = [], [], -1
    for m in _PAIRED.finditer(line):
        i, c = m.start(), m.group()
        if c == '"':
            if straight >= 0:
                spans.append((straight, i))
                straight = -1
            else:
                straight = i
        elif c == "“" and stack and stack[-1][0] == "„":
            spans.append((stack.pop()[1], i))
        elif c in _PAIRS:
            stack.append((c, i))
        else:
            for j in range(len(stack) - 1, -1, -1):
                if c in _PAIRS[stack[j][0]]:
                    spans.append((stack[j][1], i))
                    del stack[j:]
                    break
    return spans


def _shape(token: str, vocabulary: frozenset[str] | set[str]) -> str:
    """A word's class: itself if frequent (numbers as 9), else the shape of its letters and its mark."""
    plain = _plain(token)
    return plain if plain in vocabulary or len(plain) == 1 else _form(plain)


@lru_cache(100_000)
def _plain(token: str) -> str:
    return _NUMBER.sub("9", token)


@lru_cache(100_000)
def _form(plain: str) -> str:
    m = _END.search(plain)
    mark, core = (m.group(), plain[: m.start()]) if m else ("", plain)
    letters = _NO_PLAIN_LETTER.sub("", core)
    if not letters:
        return f"#{core[:3]}{mark}"
    kind = "T" if _THAI.search(letters) else "A" if letters.isupper() and len(letters) > 1 else "I" if letters.isupper() else "C" if letters[0].isupper() else "l" if letters[0].islower() else "x"
    head = core[0] if not core[0].isalnum() else ""
    return f"{head}{kind}{min(len(letters), 4)}{mark}"


def _prior(token: str, following: str) -> float:
    """Probability of a boundary after a token with a mark, before anything is known of it."""
    m = _END.search(token)
    if m is None:
        return 0.97  # a space in a script without marks
    mark, core = m.group(1), _LEAD.sub("", token[: m.start()])
    cased = following[:1].isupper() or following[:1].islower()
    lead = regex.sub(r"^[«“„\"\(\[「『（]+", "", following)
    if lead[:1].islower():
        return 0.5 if lead[1:2].isupper() else 0.03
    if following[:1] in "–—-,;:":
        return 0.02
    if m.group(2) and _QUOTED.search(m.group(2)):
        return 0.5 if not cased and lead[:1].isalpha() else 0.95  # after a quotation; without case the model decides
    if set(mark) & set("!?。！？।؟۔॥"):
        return 0.95
    if "…" in mark or len(mark) > 1:
        return 0.85
    if core.isdigit():
        return 0.8 if following[:1] in "«“„\"(" else 0.4
    letters = _NO_LETTER.sub("", core)
    if not letters:
        return 0.9
    if len(letters) == 1:
        return 0.3 if letters.islower() else 0.02
    if "." in core and not core[:1].isdigit():
        return 0.02
    if not cased and _ARABIC.match(letters):
        return 0.85
    if len(letters) >= 3 and letters.islower() and _VOWEL_END.search(letters):
        return 0.9  # abbreviations rarely end in a vowel
    return 0.25 if len(letters) <= 3 else 0.6 if len(letters) == 4 else 0.95


def _glued_prior(token: str, following: str) -> float:
    """As _prior, where no space follows the mark: of decimals, dates, initials and abbreviations of single letters the marks are no ends."""
    m = _END.search(token)
    if m is not None and set(m.group()) <= set(".．…‥"):
        core = token[: m.start()]
        if core[-1:].isdigit() and following[:1].isdigit() or len(_NO_LETTER.sub("", core)) == 1 or _THAI.search(core):
            return 0.02
        if core[-1:] in ")]）»”" and following[:1].isupper():
            return 0.9
    return _prior(token, following)


def _tokens(line: str) -> list[tuple[int, int]]:
    spans = []
    for m in _TOKEN.finditer(line):
        lo, hi = m.span()
        if marks := list(_GLUED.finditer(m.group())):
            address = _ADDRESS.search(m.group()) is not None
            for g in marks:
                if not address or _AFTER_ADDRESS.match(m.group(), g.end()):
                    spans.append((lo, m.start() + g.end()))
                    lo = m.start() + g.end()
        spans.append((lo, hi))
    return spans


def _gaps(line: str, spans: list[tuple[int, int]]) -> list[bool]:
    """Of each gap after a token but the last, whether a boundary is possible."""
    pairs = _inside(line)
    out = []
    for (lo, hi), (nlo, nhi) in zip(spans, spans[1:]):
        open_ = _END.search(line, lo, hi) is not None or nlo > hi and (_THAI.match(line[hi - 1]) is not None or _THAI.match(line[nlo]) is not None)
        out.append(open_ and not any(o < hi <= c for o, c in pairs))
    return out


class Model:
    """Expected n-gram counts; probabilities are interpolated with the next lower order."""

    def __init__(self, vocabulary: set[str], counts: dict[str, float]):
        self.vocabulary, self.c = frozenset(vocabulary), counts
        self.total = counts.get("0", 0.0) + 1000.0

    def word(self, a: str, b: str, x: str) -> float:
        c = self.c.get
        p = (c(f"1\x01{x}", 0.0) + 0.5) / self.total
        p = (c(f"2\x01{b}\x01{x}", 0.0) + 3.0 * p) / (c(f"2n\x01{b}", 0.0) + 3.0)
        return (c(f"3\x01{a}\x01{b}\x01{x}", 0.0) + 2.0 * p) / (c(f"3n\x01{a}\x01{b}", 0.0) + 2.0)

    def boundary(self, a: str, b: str, prior: float) -> float:
        c = self.c.get
        p = (c(f"b\x01{b}", 0.0) + 4.0 * prior) / (c(f"bn\x01{b}", 0.0) + 4.0)
        p = (c(f"b\x01{a}\x01{b}", 0.0) + 4.0 * p) / (c(f"bn\x01{a}\x01{b}", 0.0) + 4.0)
        return min(max(p, 1e-4), 0.05 if prior < 0.05 else 1 - 1e-4)

    def posteriors(self, x: list[str], possible: list[bool], priors: list[float]) -> list[float]:
        """P(boundary) for each gap of a line: forward-backward over two states, a boundary before the word or none."""
        n = len(x)
        if not any(possible):
            return [0.0] * (n - 1)
        moves = []  # moves[i][s][t]: from state s before word i to state t before word i + 1
        for i in range(n - 1):
            rows = []
            for s in (0, 1):
                a = START if s or i == 0 else x[i - 1]
                if s and i and not possible[i - 1]:
                    rows.append((0.0, 0.0))
                elif not possible[i]:
                    near = any(possible[max(0, i - 1) : i])
                    rows.append((self.word(a, x[i], x[i + 1]) if near else 1.0, 0.0))
                else:
                    e = self.boundary(a, x[i], priors[i])
                    if a == START and x[i].endswith("."):
                        e *= 0.1  # a sentence of one word and a period is rare
                    rows.append(((1 - e) * self.word(a, x[i], x[i + 1]), e * self.word(START, START, x[i + 1])))
            moves.append(rows)
        forward = [(0.0, 1.0)]
        for rows in moves:
            f = forward[-1]
            t = [f[0] * rows[0][k] + f[1] * rows[1][k] for k in (0, 1)]
            z = t[0] + t[1] or 1.0
            forward.append((t[0] / z, t[1] / z))
        out, back = [0.0] * (n - 1), (1.0, 1.0)
        for i in range(n - 2, -1, -1):
            f = forward[i + 1]
            z = f[0] * back[0] + f[1] * back[1] or 1.0
            out[i] = f[1] * back[1] / z
            rows = moves[i]
            b = [rows[s][0] * back[0] + rows[s][1] * back[1] for s in (0, 1)]
            z = b[0] + b[1] or 1.0
            back = (b[0] / z, b[1] / z)
        return out


_LINE = regex.compile(r"[^\n\r\v\f\x85  ]+")


def _lines(text: str) -> Iterator[tuple[int, str, list[tuple[int, int]]]]:
    for m in _LINE.finditer(text):
        spans = _tokens(m.group())
        if spans:
            yield m.start(), m.group(), spans


def _read(line: str, spans: list[tuple[int, int]], vocabulary: frozenset[str] | set[str]):
    words = [line[a:b] for a, b in spans]
    possible = _gaps(line, spans)
    priors = [(_prior if hi < lo else _glued_prior)(w, y) if p else 0.0 for w, y, p, (_, hi), (lo, _) in zip(words, words[1:], possible, spans, spans[1:])]
    return [_shape(w, vocabulary) for w in words], possible, priors


def units(text: str | None, model: Model) -> list[tuple[int, int]]:
    """Sentence units of a text as (start, end) in code points. Null and blank texts have none. A line break ends a unit."""
    out = []
    for at, line, spans in _lines(text or ""):
        x, possible, priors = _read(line, spans, model.vocabulary)
        start = spans[0][0]
        for i, p in enumerate(model.posteriors(x, possible, priors)):
            if p > 0.5:
                out.append((at + start, at + spans[i][1]))
                start = spans[i + 1][0]
        out.append((at + start, at + spans[-1][1]))
    return out


def _expected(text: str, model: Model, into: Counter) -> None:
    """Adds a text's counts, of the n-grams that line starts and possible boundaries need. A gap counts once its posterior is
    clear: shares of unclear ones would let the words after a mark explain themselves without a boundary."""
    for _, line, spans in _lines(text):
        x, possible, priors = _read(line, spans, model.vocabulary)
        post = model.posteriors(x, possible, priors)
        into["0"] += len(x)
        for w in x:
            into[f"1\x01{w}"] += 1

        def word(a: str, b: str, y: str, n: float) -> None:
            into[f"2\x01{b}\x01{y}"] += n
            into[f"2n\x01{b}"] += n
            into[f"3\x01{a}\x01{b}\x01{y}"] += n
            into[f"3n\x01{a}\x01{b}"] += n

        word(START, START, x[0], 1.0)
        sure = [None if possible[i] and 0.15 < p < 0.85 else float(p > 0.5) for i, p in enumerate(post)]
        for i, event in enumerate(sure):
            before = 1.0 if i == 0 else sure[i - 1]
            if event is None or before is None:
                continue
            a = START if before else x[i - 1]
            if possible[i]:
                for history in (a + "\x01" + x[i], x[i]):
                    into["b\x01" + history] += event
                    into["bn\x01" + history] += 1.0
            if event:
                word(START, START, x[i + 1], 1.0)
            elif possible[i] or i == 0 or possible[i - 1]:
                word(a, x[i], x[i + 1], 1.0)


def _counted(texts: DataFrame, function) -> DataFrame:
    """`(key, n)`: what `function(text, counter)` counts over all texts, summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                function(text, counts)
            if len(counts) > 300_000:
                yield pa.record_batch({"key": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.float64())})
                counts = Counter()
        yield pa.record_batch({"key": pa.array(list(counts.keys()), pa.string()), "n": pa.array([float(v) for v in counts.values()], pa.float64())})

    return texts.select("text").where("text IS NOT NULL").mapInArrow(run, "key string, n double").groupBy("key").agg(F.sum("n").alias("n"))


def _most(counts: DataFrame, n: int) -> dict[str, float]:
    rows = counts.orderBy(F.desc("n"), "key").limit(n).toPandas()
    return dict(zip(rows["key"], rows["n"]))


def _with_totals(counts: dict[str, float]) -> dict[str, float]:
    """Kept counts with their histories' totals; what was cut is in no total."""
    out = {k: v for k, v in counts.items() if k[:2] not in ("2n", "3n")}
    for key, n in counts.items():
        if key[:2] in ("2\x01", "3\x01"):
            history = f"{key[0]}n{key[1:].rpartition(chr(1))[0]}"
            out[history] = out.get(history, 0.0) + n
    return out


def _words(text: str, into: Counter) -> None:
    for _, line, spans in _lines(text):
        into.update(_NUMBER.sub("9", line[a:b]) for a, b in spans)


def fit(texts: DataFrame, vocabulary: int = VOCABULARY, ngrams: int = NGRAMS, passes: int = PASSES) -> Model:
    """The model of all `texts.text`. Its size is bounded by the two parameters; each pass reads every text."""
    known = set(_most(_counted(texts, _words), vocabulary))
    model = Model(known, {})
    for _ in range(passes):
        shared = texts.sparkSession.sparkContext.broadcast(model)
        model = Model(known, _with_totals(_most(_counted(texts, lambda t, c, m=shared: _expected(t, m.value, c)), ngrams)))
    return model


def segmented(texts: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """`(*keys, start_pos, end_pos)`: one row per sentence unit of `texts.text`."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lo, hi = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for a, b in units(text, shared.value):
                    at.append(i)
                    lo.append(a)
                    hi.append(b)
            take = pa.array(at, pa.int64())
            yield pa.record_batch([*(batch.column(k).take(take) for k in keys), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=[*keys, "start_pos", "end_pos"])

    fields = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.select(*keys, "text").where("text IS NOT NULL").mapInArrow(run, f"{fields}, start_pos long, end_pos long")


def found(boundary_document: DataFrame, boundary_sample: DataFrame, clean_document: DataFrame) -> DataFrame:
    """`(document_id, start_pos, end_pos)` of every boundary_document and every sampled clean_document."""
    sample = clean_document.join(boundary_sample.select("document_id").distinct(), "document_id", "left_semi")
    texts = boundary_document.select("document_id", "text").unionByName(sample.select("document_id", "text"))
    return segmented(texts, fit(texts), ["document_id"])
