"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on the windows (WINDOW words, lower-cased) of
toxic texts, one on those of ordinary texts. A window is compressed with either, and it is
toxic by as many bytes as the toxic one saves. Labels belong to texts, and most windows of
a toxic text are ordinary language, so training goes in rounds: the dictionaries of other
texts measure every window, and the toxic dictionary of the next round is trained on the
toxic texts' windows that save so much as is LIFT times commoner in toxic than in ordinary
texts, the ordinary one on the ordinary texts' windows that do so wrongly. Behind either
lies the same background, a dictionary trained on all windows of the ordinary texts, so
that the language that both share costs the same. Nothing but zstandard's own training
chooses what a dictionary holds. Before compression every character becomes a fixed code
of CODE bytes, so that a match of a few characters outweighs the bytes that announce it.

A text is judged in segments of SEGMENT windows: the savings of a segment's different
windows (largest, mean, how many save so much) enter a logistic calibration, and the text's
strongest segment counts, in the fit as in the score. The calibration sees each training
text measured by dictionaries of the other texts. Savings mean different things in different
languages, so texts are grouped by the frequent words they hold (found from the training
texts alone), and each group has its threshold, which becomes score 0.5: where most of the
toxic and fewest of the ordinary ones lie above, with at most CLEAN_LOST of the ordinary
ones, in the same held-apart measures. Groups with fewer than LEAST_GROUP texts of either
label share the threshold of all.

Training reads a bounded sample: TOXIC and ORDINARY labelled texts of at most
TRAINING_CHARS characters, chosen by a hash of their ids. Scoring reads every whole text,
however long.

Defined cases: null and empty texts have no windows and get the calibrated score of no
savings; without two texts of both labels every score is the share of toxic labels (0
without any); rows with a null id are never trained on; repeated rows stay, each scored;
equal savings are equal, and of a text's equally strong segments any one counts; an empty
table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, ship

TOXIC, ORDINARY, TRAINING_CHARS = 2000, 3000, 20_000
WINDOW = 3
CODE = 3
LEVEL = 3
#: Characters of the background, of the first round's dictionaries, and of the later rounds'.
BACKGROUND, FIRST, SHARP = 32_768, 8_192, 4_096
#: zstandard's segment and d-mer lengths for the background and the first round, and for the later rounds.
WIDE, NARROW = (16, 6), (8, 8)
ROUNDS = 3
#: How many times commoner a saving is in windows of toxic texts, for windows that save so much to be trained on.
LIFT = 8.0
#: Savings, in bytes, that are counted apart.
MOST = 12
#: Windows that are judged together.
SEGMENT = 400
#: Parts of the training texts, measured with the other parts' dictionaries; rounds of choosing strongest segments.
FOLDS, STRONGEST = 4, 5
#: Share of a group's ordinary training texts that may lie above its threshold.
CLEAN_LOST = 0.1
#: Frequent words that group the texts, the cosine under which two long texts are of different groups, rounds of
#: settling the groups, and the texts of either label that a threshold needs.
PROFILE, ALIKE, SETTLE, LEAST_GROUP = 500, 0.5, 10, 30
CACHE_WORDS, LONGEST_KEPT = 300_000, 40


def code_table(seed: int = 7) -> dict[str, bytes]:
    """Characters' codes, made up as they are met; the same in every worker."""

    class Codes(dict):
        def __missing__(self, c):
            self[c] = out = random.Random(seed * 0x110000 + ord(c)).randbytes(CODE)
            return out

    return Codes()


class Coder(dict):
    """A text's windows as coded bytes: each word with the blank before it, and a blank at the end.

    As a dictionary, the words' codes; those of up to LONGEST_KEPT characters are kept, up to CACHE_WORDS.
    """

    def __init__(self):
        self.codes = code_table()
        self.blank = self.coded(" ")

    def __missing__(self, word: str) -> bytes:
        out = self.coded(f" {word}")
        if len(word) <= LONGEST_KEPT:
            self[word] = out
        return out

    def coded(self, text: str) -> bytes:
        return b"".join(map(self.codes.__getitem__, text))

    def windows(self, text: str | None) -> list[bytes]:
        if len(self) > CACHE_WORDS:
            self.clear()
        own = [self[w] for w in (text or "").lower().split()]
        own += [b""] * (-len(own) % WINDOW)
        return [b"".join((*w, self.blank)) for w in zip(*[iter(own)] * WINDOW, strict=True)]


def plain_windows(text: str | None) -> list[str]:
    """The same windows as text."""
    words = (text or "").lower().split()
    return [f" {' '.join(words[i : i + WINDOW])} " for i in range(0, len(words), WINDOW)]


def dictionary(windows: Iterable[str], size: int, shape: tuple[int, int]) -> str:
    """What a zstandard dictionary trained on the windows holds, the most useful last."""
    import zstandard

    samples = [w.encode() for w in windows]
    try:
        raw = zstandard.train_dictionary(size, samples, k=shape[0], d=shape[1]).as_bytes()
        raw = raw[_content_at(raw) :]
    except zstandard.ZstdError:  # too little text to train on
        raw = b"".join(samples)
    return raw[-size:].decode("utf-8", "ignore")


def _content_at(raw: bytes) -> int:
    """Where a trained dictionary's content begins: behind its entropy tables (some 100 to 300 bytes)."""
    import zstandard

    low, high = 8, min(len(raw), 1024)
    for at in range(low, high):  # the three repeat offsets, 1, 4 and 8, end the tables
        if raw[at : at + 12] == b"\1\0\0\0\4\0\0\0\10\0\0\0":
            return at + 12
    return min(len(raw), 300) if zstandard.ZstdCompressionDict(raw).dict_id() else 0


@dataclass(frozen=True)
class Groups:
    """Centres of groups of texts, in counts of frequent words."""

    words: tuple[str, ...] = ()
    centres: tuple[tuple[float, ...], ...] = ()

    def place(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words)}


def profile(text: str | None, place: dict[str, int]) -> np.ndarray:
    """Roots of the frequent words' counts, at length one."""
    x = np.sqrt(np.bincount([place[w] for w in (text or "").lower().split() if w in place], minlength=len(place)).astype(float))
    return x / max(float(np.linalg.norm(x)), 1e-12)


def found_groups(texts: list[str]) -> Groups:
    """Groups of texts whose frequent words agree (languages, mostly).

    The longest texts that are unlike each other are the first centres; spherical k-means goes on from there.
    """
    common = Counter(w for t in texts for w in set(t.lower().split()))
    words = tuple(w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:PROFILE])
    place = {w: i for i, w in enumerate(words)}
    x = np.array([profile(t, place) for t in texts])
    centres: list[np.ndarray] = []
    for i in sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)):
        if x[i].any() and all(x[i] @ c < ALIKE for c in centres):
            centres.append(x[i])
    if not centres:
        return Groups()
    c = np.array(centres)
    for _ in range(SETTLE):
        of = (x @ c.T).argmax(axis=1)
        sizes = np.bincount(of, minlength=len(c))
        sums = np.array([x[of == k].sum(axis=0) for k in np.flatnonzero(sizes >= min(LEAST_GROUP, sizes.max()))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return Groups(words, tuple(map(tuple, c.tolist())))


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: str
    toxic: str
    background: str = ""
    weights: tuple[float, ...] = ()
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    bias: float = 0.0
    groups: Groups = Groups()
    biases: tuple[float, ...] = ()

    def scorer(self) -> "Scorer":
        if self not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[self] = Scorer(self)
        return _SCORERS[self]


class Scorer:
    """Savings of windows, with the words' codes kept between texts and tasks."""

    def __init__(self, model: ToxicityModel, coder: Coder | None = None):
        import zstandard

        self.model, self.coder = model, coder or Coder()
        parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

        def compressor(content: str):
            own = zstandard.ZstdCompressionDict(self.coder.coded(content + model.background), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=parameters)
            return zstandard.ZstdCompressor(dict_data=own, compression_params=parameters).multi_compress_to_buffer

        self.lengths = (compressor(model.ordinary), compressor(model.toxic)) if model.toxic else None
        self.place, self.centres = model.groups.place(), np.array(model.groups.centres)

    def savings(self, windows: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each coded window."""
        if self.lengths is None or not windows:
            return np.zeros(len(windows), dtype=np.int64)
        ordinary, toxic = (np.array([len(x) for x in f(windows)], dtype=np.int64) for f in self.lengths)
        return ordinary - toxic

    def features(self, text: str | None) -> np.ndarray:
        """A row for each segment of the text, over its different windows, and how many segments there are."""
        windows = self.coder.windows(text)
        parts = [list(dict.fromkeys(windows[at : at + SEGMENT])) for at in range(0, max(1, len(windows)), SEGMENT)]
        return np.array([[*vector(self.savings(part)), np.log(len(parts))] for part in parts])

    def group(self, text: str | None) -> int:
        """The text's group; -1 without any frequent word."""
        x = profile(text, self.place) if len(self.centres) else np.zeros(1)
        return int((self.centres @ x).argmax()) if x.any() else -1

    def score(self, text: str | None) -> float:
        m = self.model
        g = self.group(text)
        z = m.bias if g < 0 else m.biases[g]
        if m.weights:
            z += float((((self.features(text) - m.mean) / m.scale) @ np.array(m.weights)).max())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


_SCORERS: dict[ToxicityModel, Scorer] = {}


def vector(d: np.ndarray) -> list[float]:
    """The largest savings, their mean, the windows' number, how many save so much, and which savings occur."""
    if not len(d):
        d = np.zeros(1, dtype=np.int64)
    upto = np.bincount(np.clip(d, 0, MOST), minlength=MOST + 1)[::-1].cumsum()[::-1][1:]
    return [float(d.max()), float(np.sort(d)[-3:].mean()), float(d.mean()), float(np.log1p(len(d))), *np.log1p(upto), *np.minimum(upto[3::2], 1)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps with a ridge on the weights."""
    a = np.column_stack((x, np.ones(len(x))))
    w, penalty = np.zeros(a.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _sample(docs: DataFrame, labels: DataFrame, toxic: int, n: int) -> list[str]:
    """Texts of n training rows with that label, in the order of a hash of their ids."""
    learn = labels.where((F.col("toxic") == toxic) & (crc_mod("doc_id", 5) != 0)).select("doc_id").dropDuplicates(["doc_id"])
    fits = F.col("text").isNotNull() & (F.length("text") <= TRAINING_CHARS)
    ids = docs.where(fits).select("doc_id").join(learn, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).distinct()
    chosen = docs.where(fits).select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most n ids; no text is shuffled
    return [r["text"] for r in sorted(chosen.collect(), key=lambda r: (r["doc_id"], r["text"]))][:n]


@dataclass
class _Side:
    """The texts of one label: each one's fold, and the windows that dictionaries are trained on."""

    texts: list[str]

    def __post_init__(self):
        self.fold = np.arange(len(self.texts)) % FOLDS
        self.chosen: list[list[str]] | None = None  # all windows

    def windows(self, without: int | None = None) -> Iterator[str]:
        for i, text in enumerate(self.texts):
            if self.fold[i] != without:
                yield from dict.fromkeys(plain_windows(text)) if self.chosen is None else self.chosen[i]

    def measure(self, scorers: list[Scorer]) -> list[np.ndarray]:
        """Savings of each text's different windows, by the scorer of its fold."""
        return [scorers[f].savings(list(dict.fromkeys(scorers[f].coder.windows(t)))) for t, f in zip(self.texts, self.fold, strict=True)]

    def choose(self, measured: list[np.ndarray], least: int) -> None:
        self.chosen = [[w for w, d in zip(dict.fromkeys(plain_windows(t)), m, strict=True) if d >= least] for t, m in zip(self.texts, measured, strict=True)]


def _least_saving(toxic: np.ndarray, ordinary: np.ndarray) -> int:
    """The least saving that is LIFT times commoner among toxic texts' windows; the one nearest to that if none is."""
    lifts = {v: (toxic >= v).mean() / max((ordinary >= v).mean(), 1 / len(ordinary)) for v in range(1, 4 * MOST)}
    return next((v for v, lift in lifts.items() if lift >= LIFT), max(lifts, key=lifts.get))


def _dictionaries(toxic: _Side, ordinary: _Side, background: str, first: bool, without: int | None = None) -> ToxicityModel:
    size, shape = (FIRST, WIDE) if first else (SHARP, NARROW)
    return ToxicityModel(dictionary(ordinary.windows(without), size, shape), dictionary(toxic.windows(without), size, shape) or " ", background)


def calibrated_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Where the toxic share above exceeds the ordinary one by most, the ordinary one being CLEAN_LOST at most."""
    order = np.argsort(-z, kind="stable")
    found, lost = np.cumsum(y[order]) / max(1, y.sum()), np.cumsum(1 - y[order]) / max(1, (1 - y).sum())
    last = np.append(np.diff(z[order]) != 0, True)  # ties lie on one side
    gain = np.where(last & (lost <= CLEAN_LOST), found - lost, -1.0)
    best = int(gain.argmax())
    if gain[best] <= 0:
        return float(z.max()) + 1e-6
    return float(z[order][best] if best + 1 == len(z) else (z[order][best] + z[order][best + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """docs: doc_id, text; labels: doc_id, toxic."""
    return fit_texts(*(_sample(docs, labels, k, n) for k, n in ((1, TOXIC), (0, ORDINARY))))


def fit_texts(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    if len(toxic) < 2 or len(ordinary) < 2:
        share = len(toxic) / max(1, len(toxic) + len(ordinary))
        return ToxicityModel("", "", bias=float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    bad, good, coder = _Side(toxic), _Side(ordinary), Coder()
    backgrounds = [dictionary(good.windows(k), BACKGROUND, WIDE) for k in range(FOLDS)]
    background = dictionary(good.windows(), BACKGROUND, WIDE)
    for r in range(ROUNDS + 1):
        scorers = [Scorer(_dictionaries(bad, good, backgrounds[k], r == 0, k), coder) for k in range(FOLDS)]
        if r == ROUNDS:
            break
        measured = bad.measure(scorers), good.measure(scorers)
        least = _least_saving(*(np.concatenate([*m, np.zeros(1, np.int64)]) for m in measured))
        bad.choose(measured[0], least)
        good.choose(measured[1], least)
    x, y, of = [], [], []
    for side, truth in ((bad, 1.0), (good, 0.0)):
        for text, k in zip(side.texts, side.fold, strict=True):
            rows = scorers[k].features(text)
            of += [len(y)] * len(rows)
            x.append(rows)
            y.append(truth)
    x, y, of = np.concatenate(x), np.array(y), np.array(of)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - mean) / scale
    weights, _ = _logistic(z, y[of])
    for _ in range(STRONGEST):  # a text's strongest segment stands for it
        order = np.lexsort((-(z @ weights), of))
        strongest = order[np.unique(of[order], return_index=True)[1]]
        weights, _ = _logistic(z[strongest], y)
    value = np.full(len(y), -np.inf)
    np.maximum.at(value, of, z @ weights)
    model = _dictionaries(bad, good, background, ROUNDS == 0)
    groups = found_groups(toxic + ordinary)
    scorer = Scorer(ToxicityModel("", "", groups=groups), coder)
    group, whole = np.array([scorer.group(t) for t in toxic + ordinary]), -calibrated_threshold(value, y)
    biases = []
    for g in range(len(groups.centres)):
        own = group == g
        enough = min((own & (y == k)).sum() for k in (0, 1)) >= LEAST_GROUP
        biases.append(-calibrated_threshold(value[own], y[own]) if enough else whole)
    fitted = (tuple(weights.tolist()), tuple(mean.tolist()), tuple(scale.tolist()))
    return ToxicityModel(model.ordinary, model.toxic, background, *fitted, whole, groups, tuple(biases))


def _scores(model: ToxicityModel, text: str, keep: list[str], below: float | None):
    def run(batches):
        scorer = model.scorer()
        for batch in batches:
            scores = np.array([scorer.score(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], dtype=np.float64)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            if below is None:
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores)], [*keep, "__strand_score"])
            else:
                yield pa.RecordBatch.from_arrays(kept, keep).filter(pa.array(scores < below))

    return run


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep, and `__strand_score`."""
    ship(docs.sparkSession)
    rows = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("__strand_score", T.DoubleType())])
    return rows.mapInArrow(_scores(model, text, keep, None), schema)


def toxicity_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text scores below 0.5; each row crosses to Python once and comes back if it stays."""
    model = fit(docs, labels)
    ship(docs.sparkSession)
    return docs.mapInArrow(_scores(model, "text", docs.columns, 0.5), docs.schema)


def op9_toxicity(spark, sf_dir) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    s = F.col("__strand_score")
    return scored.select("doc_id", held.alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))
