"""Languages of texts and of their segments, by multilingual mixture inference.

Each text is taken as a mixture of languages. Segments (sentences, line ends) get n-gram
log-likelihoods per language; expectation-maximisation estimates the text's proportions;
the set of languages is selected by penalised likelihood (a language enters when it raises
the log-likelihood by more than ``PENALTY``). A segment's confidence is its posterior.

The model is trained here, on a bounded sample of labelled texts (``SAMPLE`` per language,
chosen by hash), and cleaned by re-labelling the sample's sentences with itself, so that
wrong labels and mixed texts in the sample do no harm. A few function words per language
start it where a language has hardly any labelled text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGS = ("en", "pl", "de", "fr", "es")
SAMPLE = 400
PENALTY = 9.0
UNKNOWN = 0.5  # nats that a word outside the vocabulary speaks for or against a language at most: it may be a name
WHOLE = 4.0  # a whole sentence must be so many nats likelier in its language than without any

# Frequent function words, without accents.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for with on by not from this be are at which when",
    "pl": "nie na sie jest ze do przez tylko ktory oraz dla jak przed przy byl bez ponieważ gdy ma",
    "de": "der die das und nicht ist war von mit den dem ein eine auf wird bei weil noch als wir",
    "fr": "le la les des et est dans une pas que pour au du sur avec qui par ne sont avant",
    "es": "el los las que de y en una por con para no del al como pero mas cuando sin se",
}

# Spellings of the languages in labels.
NAMES = {
    "en": "en eng english",
    "pl": "pl pol polish",
    "de": "de deu ger german",
    "fr": "fr fra fre french",
    "es": "es spa spanish",
}
MISSING = ("", "und", "unknown")

_CODE = re.compile(r"`[^`\r\n]*`|\|[^|\r\n]*(?:\|[^|\r\n]*)+\||\$ [^\r\n]*?(?=\s[A-ZÀ-ÞĄ-Ż][a-zà-ž]|$)|(?:^|(?<=\s))(?:/[\w.\-]+){2,}(?::\d+)?|(?:^|(?<=\s))at [\w.]+ \([^)\r\n]*\)|\b[A-Z]\d+ \w+::\w+", re.M)
_SENTENCE = re.compile(r"[^.!?…\r\n]*(?:[.!?…](?!\s|$|[\"'”’»)\]]*(?:\s|$))[^.!?…\r\n]*)*(?:[.!?…]+[\"'”’»)\]]*(?=\s|$))?", re.M)
_WORD = re.compile(r"(?<![\w.\-/:@\\])[^\W\d_]+(?![\w\-/:@\\]|\.\w)")
_MARKS = re.compile("[̀-ͯ]+")
_LEAD = re.compile(r"(?:[^\w]|\d+\b|[A-Z]{3,}:)*")
_TAIL = re.compile(r"[.!?…][\"'”’»)\]]*$")


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text)).replace("ł", "l").replace("ß", "ss")


def label_language(label: Column) -> Column:
    """The language a label names: one of LANGS, ``other``, or null where the label is missing.

    ISO 639 codes of two or three letters with or without region and English names count, in any case.
    """
    clean = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    stem = F.element_at(F.split(clean, "[-_ ]"), 1)
    out = F.when(clean.isin(*MISSING), F.lit(None).cast("string"))
    for code, names in NAMES.items():
        out = out.when(stem.isin(*names.split()), code)
    return out.otherwise("other")


def segments(text: str) -> list[tuple[int, int, bool]]:
    """``(start, end, whole)`` of a text's segments; code, paths, log and table lines are in none.

    ``whole``: begins with a capital (after bullets, numbers and headings in capitals) and ends
    with a full stop, question or exclamation mark, or at a line end; at the end of the text
    only where no sentence of the text has such a mark (elsewhere it may have been cut off).
    """
    plain = _CODE.sub(lambda m: "\n" * len(m.group()), text)
    out, marked, last = [], False, len(plain.rstrip())
    for m in _SENTENCE.finditer(plain):
        s, e = m.span()
        head = _LEAD.match(plain, s, e).end()
        if head == e:
            continue
        while plain[s].isspace():
            s += 1
        ends = _TAIL.search(plain, max(s, e - 4), e) is not None
        marked = marked or ends
        out.append((s, e, plain[head].isupper(), ends))
    return [(s, e, up and (ends or e < last or not marked)) for s, e, up, ends in out]


class Model:
    """Word and letter n-gram likelihoods against a background of no language."""

    FLOOR, CEIL, EPS = -1.5, 7.0, 0.2

    def __init__(self, counts: dict[str, Counter], docs: dict[str, int]):
        """``counts``: for each language, in how many of its sentences a word occurs."""
        self.words: dict[str, np.ndarray] = {}
        total = {g: max(1, sum(c.values())) for g, c in counts.items()}
        vocab = {w for g, c in counts.items() for w, n in c.items() if n >= max(3, 0.004 * docs[g])} | {w for f in FUNCTION_WORDS.values() for w in f.split()}
        seed = {g: set(f.split()) for g, f in FUNCTION_WORDS.items()}
        p = np.array([[(counts[g][w] + 0.5 + 20 * (w in seed[g])) / (total[g] + 2_000) for g in LANGS] for w in sorted(vocab)])
        for w, row in zip(sorted(vocab), p):
            self.words[w] = np.clip(np.log(row / row.mean()) + 0.3 * np.sign(row - row.mean()), -4.0, 2.0) + (1.0 if row.max() > 1e-3 else 0.0)
        grams = [Counter() for _ in LANGS]
        for k, g in enumerate(LANGS):
            for w in vocab:
                n = counts[g][w] + 5 * (w in seed[g])
                if n:
                    for a in self._grams(w):
                        grams[k][a] += math.sqrt(n)
        self.grams: dict[str, np.ndarray] = {}
        sums = np.array([sum(c.values()) + 1_000 for c in grams])
        for a in set().union(*grams):
            q = (np.array([c[a] for c in grams]) + 0.2) / sums
            self.grams[a] = np.log(q / q.mean())
        self.weight = self._fitted()
        self.cache: dict[str, np.ndarray] = {}

    def _fitted(self) -> float:
        """The weight of an n-gram's nats that best predicts what whole words are worth (least squares over the vocabulary)."""
        known = [(np.sum(g, axis=0), t) for w, t in self.words.items() if (g := [self.grams[a] for a in self._grams(w) if a in self.grams])]
        x, t = (np.array(v) for v in zip(*known)) if known else (np.zeros(1), np.zeros(1))
        return float((x * t).sum() / max((x * x).sum(), 1e-9))

    @staticmethod
    def _grams(word: str) -> list[str]:
        w = f"<{word}>"
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def score(self, word: str) -> np.ndarray:
        """Nats by which the word speaks for each language."""
        known = self.words.get(word)
        if known is not None:
            return known
        hit = self.cache.get(word)
        if hit is None:
            g = [self.grams[a] for a in self._grams(word) if a in self.grams]
            hit = np.clip(self.weight * np.sum(g, axis=0), -UNKNOWN, UNKNOWN) if g else np.zeros(len(LANGS))
            if len(self.cache) < 200_000:
                self.cache[word] = hit
        return hit


def train(rows: Iterable[tuple[str, str]], rounds: int = 3) -> Model:
    """A model of ``(language, text)`` rows: first by their labels, then by what it says of each sentence itself."""
    found = ((LANGS.index(g), {*_WORD.findall(fold(t[s:e]))}) for g, t in rows for s, e, _ in segments(t))
    sents = [(g, ws) for g, ws in found if len(ws) >= 3]
    tongue = np.array([g for g, _ in sents], np.int64)
    codes: dict[str, int] = {}
    flat = np.array([codes.setdefault(w, len(codes)) for _, ws in sents for w in sorted(ws)], np.int64)
    at = np.cumsum([0] + [len(ws) for _, ws in sents])
    vocab, of = list(codes), np.repeat(np.arange(len(sents)), np.diff(at))
    model = None
    for _ in range(rounds + 1):
        sure = np.ones(len(sents), bool)
        if model is not None and len(sents):
            s = np.add.reduceat(np.array([model.score(w) for w in vocab])[flat], at[:-1], axis=0)
            top = np.sort(s, axis=1)
            sure, tongue = (top[:, -1] >= WHOLE) & (top[:, -1] - top[:, -2] >= 3), s.argmax(1)
        counts = {}
        for k, g in enumerate(LANGS):
            n = np.bincount(flat[(sure & (tongue == k))[of]], minlength=len(vocab))
            counts[g] = Counter({vocab[i]: int(n[i]) for i in np.flatnonzero(n)})
        model = Model(counts, {g: 1 + int((sure & (tongue == k)).sum()) for k, g in enumerate(LANGS)})
    return model


def _mix(score: np.ndarray, doc: np.ndarray, n: int, allowed: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM of each text's proportions over its allowed languages: ``(proportions, posteriors, log-likelihood)``."""
    pi = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            z = score + np.log(pi)[doc]
        top = z.max(1, keepdims=True)
        e = np.exp(z - top)
        s = e.sum(1, keepdims=True)
        post = e / s
        sums = np.stack([np.bincount(doc, post[:, g], minlength=n) for g in range(post.shape[1])], 1)
        size = np.bincount(doc, minlength=n)[:, None]
        pi = (sums + 0.02 * allowed) / np.maximum(size + 0.02 * allowed.sum(1, keepdims=True), 1e-9)
    ll = np.bincount(doc, (top + np.log(s))[:, 0], minlength=n)
    return pi, post, ll


def infer(model: Model, texts: list[str | None], penalty: float = PENALTY) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(spans, doc, score, posteriors, proportions, chosen)`` of a batch of texts; spans are ``(start, end, whole)``."""
    spans, doc, flat, at = [], [], [], []
    for d, t in enumerate(texts):
        if not t:
            continue
        for s, e, whole in segments(t):
            ws = _WORD.findall(fold(t[s:e]))
            if not ws:
                continue
            at.append(len(flat))
            flat += ws
            spans.append((s, e, whole, len(ws)))
            doc.append(d)
    n, k = len(texts), len(LANGS)
    doc = np.array(doc, np.int64)
    if not len(doc):
        return [], doc, np.zeros((0, k)), np.zeros((0, k)), np.full((n, k), 1 / k), np.zeros((n, k), bool)
    codes: dict[str, int] = {}
    idx = np.array([codes.setdefault(w, len(codes)) for w in flat])
    table = np.array([model.score(w) for w in codes])
    score = np.add.reduceat(table[idx], at, axis=0)
    totals = np.stack([np.bincount(doc, score[:, g], minlength=n) for g in range(k)], 1)
    chosen = np.zeros((n, k), bool)
    chosen[np.arange(n), totals.argmax(1)] = True
    main = chosen.argmax(1)
    over = np.maximum(score - score[np.arange(len(doc)), main[doc]][:, None], 0)
    bound = np.stack([np.bincount(doc, over[:, g], minlength=n) for g in range(k)], 1)  # no language can gain more
    some = np.flatnonzero((bound > penalty).any(1))
    pi, post = chosen.astype(float), chosen[doc].astype(float)
    if not len(some):
        return spans, doc, score, post, pi, chosen
    at_seg = np.flatnonzero(np.isin(doc, some))
    sub, sc, m, few = np.searchsorted(some, doc[at_seg]), score[at_seg], len(some), chosen[some]
    p, q, ll = _mix(sc, sub, m, few.astype(float))
    for _ in range(k - 1):
        gains = np.full((m, k), -np.inf)
        for g in range(k):
            more = few.copy()
            more[:, g] = True
            gains[:, g] = np.where(few[:, g], -np.inf, _mix(sc, sub, m, more.astype(float), 4)[2] - ll)
        pick = gains.argmax(1)
        grow = np.flatnonzero(gains[np.arange(m), pick] > penalty)
        if not len(grow):
            break
        few[grow, pick[grow]] = True
        p, q, ll = _mix(sc, sub, m, few.astype(float))
    pi[some], post[at_seg], chosen[some] = p, q, few
    return spans, doc, score, post, pi, chosen


def whole_sentences(spans: list, doc: np.ndarray, score: np.ndarray, post: np.ndarray, n: int) -> np.ndarray:
    """``(texts, languages)``: how many whole sentences each text has in each language."""
    out = np.zeros((n, len(LANGS)), np.int64)
    if len(doc):
        top = post.argmax(1)
        firm = np.array([w and m >= 3 for _, _, w, m in spans]) & (score[np.arange(len(doc)), top] >= WHOLE) & (post[np.arange(len(doc)), top] >= 0.9)
        np.add.at(out, (doc[firm], top[firm]), 1)
    return out


def training_sample(texts: DataFrame, labels: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``per_language`` texts for each language: the same for the same table, however it is split.

    ``texts(id, text)``, ``labels(id, lang)`` with ``lang`` as from ``label_language``. This is
    all that the driver ever holds.
    """
    known = labels.filter(F.col("lang").isin(*LANGS)).select("id", "lang")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    few = known.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_language)
    rows = texts.filter(F.length("text") > 0).join(F.broadcast(few.select("id", "lang")), "id").groupBy("id", "lang").agg(F.max("text").alias("text"))
    return [(r["lang"], r["text"]) for r in rows.orderBy("id").collect()]


def latest_labels(labels: DataFrame, key: str = "lesson_id") -> DataFrame:
    """``(id, lang)``: the language named by the label with the latest ``labelled_at`` (ties: labeller, spelling); null where it is missing."""
    last = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id"))
    last = last.agg(F.max_by(F.struct("lang"), F.struct("labelled_at", F.coalesce("labeller", F.lit("")), F.coalesce("lang", F.lit("")))).alias("l"))
    return last.select("id", label_language(F.col("l.lang")).alias("lang"))


def document_languages(texts: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """``texts(id, text, *keep)`` to ``(id, *keep, main, confidence, languages, sentences)``.

    ``main`` is the language of the greatest proportion and ``confidence`` that proportion;
    ``languages`` are those with at least one whole sentence, in the order of LANGS, and
    ``sentences`` how many each has. Null, empty and language-free texts: null and empty arrays.
    """
    said = texts.sparkSession.sparkContext.broadcast(model)
    schema = texts.select("id", "text", *keep).drop("text").schema.simpleString()[7:-1].replace(":", " ")
    schema += ", main string, confidence double, languages array<string>, sentences array<long>"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for s in range(0, len(whole), 2_000):
                pdf = whole.iloc[s : s + 2_000]
                spans, doc, score, post, pi, _ = infer(said.value, [t if isinstance(t, str) else None for t in pdf["text"]])
                n = whole_sentences(spans, doc, score, post, len(pdf))
                some = np.bincount(doc, minlength=len(pdf)) > 0 if len(doc) else np.zeros(len(pdf), bool)
                out = pdf.drop(columns="text")
                out["main"] = [LANGS[k] if ok else None for k, ok in zip(pi.argmax(1), some)]
                out["confidence"] = np.where(some, pi.max(1), np.nan)
                out["languages"] = [[LANGS[k] for k in np.flatnonzero(r)] for r in n]
                out["sentences"] = [r[r > 0].tolist() for r in n]
                yield out

    return texts.select("id", "text", *keep).mapInPandas(work, schema).withColumn("confidence", F.nanvl("confidence", F.lit(None).cast("double")))


def segment_languages(texts: DataFrame, model: Model) -> DataFrame:
    """``(id, ord, start, end, whole, lang, confidence)`` of every segment with words of ``texts(id, text)``.

    ``lang`` is null where no language stands out (names and identifiers only).
    """
    said = texts.sparkSession.sparkContext.broadcast(model)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 2_000):
                pdf = whole.iloc[at : at + 2_000]
                ids = pdf["id"].to_numpy()
                spans, doc, score, post, _, _ = infer(said.value, [t if isinstance(t, str) else None for t in pdf["text"]])
                top = post.argmax(1) if len(doc) else np.zeros(0, int)
                first: dict[int, int] = defaultdict(int)
                out = []
                for k, (s, e, w, _) in enumerate(spans):
                    clear = score[k, top[k]] > 1.0
                    out.append((ids[doc[k]], first[doc[k]], s, e, w, LANGS[top[k]] if clear else None, float(post[k, top[k]]) if clear else None))
                    first[doc[k]] += 1
                yield pd.DataFrame(out, columns=["id", "ord", "start", "end", "whole", "lang", "confidence"])

    return texts.filter(F.col("id").isNotNull()).select("id", "text").mapInPandas(work, "id long, ord int, start int, end int, whole boolean, lang string, confidence double")
