"""Languages of whole texts: script ranges, word scores, Viterbi with a switching penalty.

A word's script (by Unicode ranges) leaves the languages whose training texts
use it. Those get a score from hashed letter trigrams. Viterbi over all words
of a text, where going from one language to another costs a penalty, gives
spans; a text's language is the one with most letters in its spans.

The model is fitted on a bounded sample of labelled rows, about ``SAMPLE_DOCS``
for each language, chosen by a hash of their id; every text is then labelled
whole, in vectors over the texts of a batch.

Defined results
- null or empty text, or one without letters: ``und`` with score 0 and no spans
- letters of a script that no learned language has: the commonest language, score 0
- null labels and null ids aren't learned from; ties go to the language first in order
- repeated rows are labelled alike; columns are kept, one that has an output's name is replaced
- an empty table gives an empty table; without any label every text is ``und``
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismill.llm.bpe import added, fresh, texts

#: About so many labelled texts of each language are learned from.
SAMPLE_DOCS = 2000
#: Languages a model may have; more is an error, as the model is held whole by every task.
MAX_LANGUAGES = 200
#: What going to another language costs, in nats.
SWITCH = 8.0
#: A word counts against a language no more than this.
FLOOR = -6.0
GRAMS = 1 << 16
#: A language uses a script if it has this share of its letters.
SCRIPT_SHARE = 0.005
#: Words whose scores a task remembers, some 150 bytes each.
CACHED_WORDS = 200_000
#: Bytes of text worked on at once.
CHUNK = 4 << 20

#: Fixed: first code points of Unicode's ranges, and the script there.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"),
    (0x2E80, "han"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list of words: hashed trigrams with word ends, which word each is of, and each word's script."""
    c = np.frombuffer(("\x02" + "\x02".join(some) + "\x02").encode("utf-32-le", "surrogatepass"), "<u4")
    edge = c == 2
    x = c.astype(np.uint64)
    h = (x[:-2] * np.uint64(0x9E3779B1) + x[1:-1] * np.uint64(0x85EBCA77) + x[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x27D4EB2F165667C5)
    valid = ~edge[1:-1]
    first = np.flatnonzero(edge)[:-1] + 1
    return (h >> np.uint64(48)).astype(np.int64)[valid], (np.cumsum(edge)[:-2] - 1)[valid], _SCRIPT[np.searchsorted(_STARTS, c[first], "right") - 1]


@dataclass
class Model:
    """Languages in order, log shares of trigrams (GRAMS x languages), scripts (script x language) and the commonest language."""

    languages: list[str]
    logs: np.ndarray
    scripts: np.ndarray
    commonest: int

    @classmethod
    def of(cls, counts: dict[str, np.ndarray], scripts: dict[str, np.ndarray]) -> Model:
        names = sorted(counts)
        n = np.array([counts[k] for k in names], float).T if names else np.zeros((GRAMS, 0))
        s = np.array([scripts[k] for k in names], float).T if names else np.zeros((len(_NAMES), 0))
        logs = np.log((n + 0.5) / (n.sum(0) + 0.5 * GRAMS)).astype(np.float32)
        return cls(names, logs, s > SCRIPT_SHARE * np.maximum(s.sum(0), 1), int(n.sum(0).argmax()) if names else 0)


class Labeller:
    """Applies a model; remembers words' scores."""

    def __init__(self, model: Model):
        self.model = model
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1 << 12, bool)

    def _learn(self, some: list[str]) -> None:
        which, of, script = grams(some)
        m = self.model
        s = np.stack([np.bincount(of, m.logs[which, k], len(some)) for k in range(len(m.languages))], 1)
        allowed = m.scripts[script]
        s = np.where(allowed, s, -np.inf)
        top = s.max(1, keepdims=True)
        known = np.isfinite(top)
        s = np.where(known, np.maximum(s - np.where(known, top, 0), FLOOR), 0)
        s[known[:, 0]] = np.where(allowed, s, 2 * FLOOR)[known[:, 0]]
        at = len(self.index)
        while at + len(some) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.scores[at : at + len(some)] = s
        self.letters[at : at + len(some)] = [w.isalpha() or any(map(str.isalpha, w)) for w in some]
        self.index.update(zip(some, range(at, at + len(some)), strict=True))

    def label(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word of all texts in one array: its language, its length with 0 for words of foreign scripts, and whether it has letters (and not only numbers like ½)."""
        flat = [w for d in docs for w in d]
        new = list(set(flat).difference(self.index))
        if len(self.index) + len(new) > CACHED_WORDS and self.index:
            self._empty()
            new = list(set(flat))
        for i in range(0, len(new), 1 << 16):
            self._learn(new[i : i + (1 << 16)])
        ids = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        size = np.fromiter(map(len, flat), np.int64, len(flat))
        s = self.scores[ids]
        letters = self.letters[ids]
        return _viterbi(s, np.array([len(d) for d in docs])), np.where(letters & (s.any(1) | (s.shape[1] == 1)), size, 0), letters


def _viterbi(scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best languages of the words of all texts; a step works on the t-th word of every text that has one."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")  # texts longer than t
    came = np.empty(scores.shape, np.uint8)
    own = np.arange(scores.shape[1], dtype=np.uint8)
    best = np.zeros((len(size), scores.shape[1]), np.float32)
    for t in range(steps):
        n = active[t]
        at, v = begin[:n] + t, best[:n]
        k = v.argmax(1)
        jump = v[np.arange(n), k] - SWITCH
        stay = v >= jump[:, None]
        came[at] = np.where(stay, own, k[:, None].astype(np.uint8))
        best[:n] = np.where(stay, v, jump[:, None]) + scores[at]
    out = np.empty(len(scores), np.uint8)
    now = best.argmax(1)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        out[at] = now[:n]
        now[:n] = came[at, now[:n]]
    return out


def held_out(key: str = "doc_id") -> Column:
    """Rows that aren't learned from; false for null."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS) -> Model:
    """Learn from rows that aren't held out and have a text, a label and an id."""
    d = docs.where(~held_out(key)).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    n = {r.lang: r.n for r in d.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(n) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not n:
        return Model.of({}, {})
    part = F.lit(0)
    for k, v in n.items():
        part = F.when(F.col("lang") == k, F.lit(int(min(1.0, sample / v) * 1_000_000))).otherwise(part)
    d = d.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < part).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, k in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if some := words(t):
                    h, _, script = grams(some)
                    c = seen.setdefault(k, np.zeros(GRAMS + len(_NAMES), np.int64))
                    c[:GRAMS] += np.bincount(h, minlength=GRAMS)
                    c[GRAMS:] += np.bincount(script, [len(w) for w in some], len(_NAMES)).astype(np.int64)
        for k, c in seen.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at])], names=["lang", "gram", "n"])

    # The model: at most GRAMS numbers for each language.
    got = d.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {k: np.zeros(GRAMS + len(_NAMES)) for k in n}
    for k, g in got.groupby("lang"):
        counts[k][g["gram"].to_numpy()] = g["n"].to_numpy()
    return Model.of({k: c[:GRAMS] for k, c in counts.items()}, {k: c[GRAMS:] for k, c in counts.items()})


_SPAN = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])
SPAN = T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())])


def identify(docs: DataFrame, model: Model, text: str = "text", to: str = "lang_pred", score: str = "score", spans: str | None = None) -> DataFrame:
    """Add each text's language and the share of its letters in that language's spans; on request also the spans.

    Only texts go to Python and only labels come back; the rows themselves stay where they are.
    """
    new = [T.StructField(to, T.StringType()), T.StructField(score, T.DoubleType())] + ([T.StructField(spans, T.ArrayType(SPAN))] if spans else [])
    d, _, column = added(docs, *new, reads=text)
    kept = [c for c in d.columns if c != column or column == text]
    names = [*model.languages, "und"]

    def labelled(labeller: Labeller, part: list[str | None]) -> pa.Array:
        found = [words(t) if model.languages else [] for t in part]
        lengths = np.array([len(w) for w in found])
        path, size, letters = labeller.label(found) if lengths.sum() else (np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, bool))
        doc = np.repeat(np.arange(len(part)), lengths)
        lettered = np.bincount(doc, letters, len(part)) > 0
        share = np.bincount(doc * len(names) + path, size, len(part) * len(names)).reshape(len(part), -1)
        total = share.sum(1)
        best = np.where(total > 0, share.argmax(1), np.where(lettered, model.commonest, len(names) - 1))
        made = [pa.array([names[i] for i in best], pa.string()), pa.array(np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0))]
        if spans:
            made.append(pa.array(_spans(path, lengths, names), pa.list_(_SPAN)))
        return pa.StructArray.from_arrays(made, [f.name for f in new])

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(model)
        for c in columns:
            parts = [labelled(labeller, part) for part in texts(c, CHUNK)]
            yield pa.concat_arrays(parts or [labelled(labeller, [])])

    # Said not to be deterministic, so that a condition on the label doesn't work it out once more.
    label, at = F.arrow_udf(run, T.StructType(new)).asNondeterministic(), fresh(d, "labelled")
    d = d.withColumn(at, label(F.col(f"`{column}`")))
    return d.select(*(F.col(f"`{c}`") for c in kept), *(F.col(at)[f.name].alias(f.name) for f in new))


def _spans(path: np.ndarray, lengths: np.ndarray, names: list[str]) -> list[list[dict]]:
    out, at = [], 0
    for n in lengths:
        p = path[at : at + n]
        at += n
        cut = [0, *(np.flatnonzero(np.diff(p)) + 1), n] if n else [0]
        out.append([{"lang": names[p[i]], "first_word": int(i), "n_words": int(j - i)} for i, j in zip(cut, cut[1:], strict=False)])
    return out
