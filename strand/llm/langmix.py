"""Language identification by multilingual mixtures.

Letters and their two neighbours (blanks where no letter is) form n-grams, hashed to
BUCKETS. Their counts per language come from all training rows: each task adds up arrays,
and only (language, bucket, count) is shuffled. A word's likelihood under a language is
the product over its letters. For each text, expectation-maximisation estimates the
languages' shares of its words; then the language sets made of the largest shares, up to
all languages, are refitted, and the set with the best likelihood, less PENALTY times log(words) per further
language, is selected. The prediction is the selected set's largest share.

Defined cases: null texts and texts without a letter are `und` with score 0; training
skips null languages and texts; without any trained language everything is `und`; ties go
to the first language by name; repeated rows count as often as they come; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, ship

BUCKETS = 1 << 14
SMOOTHING = 0.5
ROUNDS, REFITS = 12, 6
PENALTY = 2.0
#: Characters handled at a time (longer texts one by one).
BLOCK = 1 << 20
UNDETERMINED = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all letters; where each word's letters start; which text each word is of."""
    points = np.frombuffer(("\n".join(texts) + "\n").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[points]
    kept = np.where(is_letter, points, np.uint32(32))
    before = np.concatenate(([np.uint32(32)], kept[:-1]))
    after = np.concatenate((kept[1:], [np.uint32(32)]))
    mixed = before * np.uint32(2654435761) + kept * np.uint32(2246822519) + after * np.uint32(3266489917)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(668265263)
    at = np.flatnonzero(is_letter)
    buckets = (mixed[at] >> np.uint32(18)).astype(np.int32)
    starts = np.flatnonzero(~is_letter[at - 1] | (at == 0)) if len(at) else at
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    return buckets, starts, np.searchsorted(ends, at[starts], side="right")


def _blocks(texts: list[str]):
    """Index ranges of about BLOCK characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _count(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
        for a, b in _blocks(texts):
            buckets, starts, of = ngrams(texts[a:b])
            spans = np.diff(np.append(starts, len(buckets)))
            text_of = np.repeat(of, spans)
            for lang in set(langs[a:b]):
                mine = (langs[a:b] == lang)[text_of]
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(buckets[mine], minlength=BUCKETS)
    for lang, n in sums.items():
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(n[hit])], ["lang", "bucket", "n"])


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    logs: np.ndarray  # (buckets, languages)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """From every row with a text and a language."""
    ship(docs.sparkSession)
    rows = docs.select(text, lang).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toPandas()  # at most BUCKETS numbers per language
    names = tuple(sorted(table["lang"].unique()))
    sums = np.full((BUCKETS, len(names)), SMOOTHING)
    sums[table["bucket"].to_numpy(), [names.index(x) for x in table["lang"]]] += table["n"].to_numpy()
    return LanguageModel(names, np.log(sums / sums.sum(axis=0)).astype(np.float32))


def _em(likes: np.ndarray, begin: np.ndarray, of: np.ndarray, n: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares per text after so many rounds, and the log-likelihoods (less the words' own maxima)."""
    for _ in range(rounds):
        weighted = likes * shares[of]
        weighted /= np.maximum(weighted.sum(axis=1, keepdims=True), 1e-30)
        shares = np.add.reduceat(weighted, begin, axis=0) / n[:, None]
    total = np.log(np.maximum((likes * shares[of]).sum(axis=1), 1e-30))
    return shares, np.add.reduceat(total, begin)


def mixtures(texts: list[str], model: LanguageModel) -> list[tuple[str, float, list[tuple[str, float]]]]:
    """(language, its share, the selected set's shares) of each text."""
    out: list = [(UNDETERMINED, 0.0, [])] * len(texts)
    size = len(model.names)
    if not size or not texts:
        return out
    buckets, starts, of = ngrams(texts)
    if not len(starts):
        return out
    words = np.add.reduceat(model.logs[buckets], starts, axis=0).astype(np.float64)
    likes = np.exp(words - words.max(axis=1, keepdims=True))
    which, begin, n = np.unique(of, return_index=True, return_counts=True)
    local = np.repeat(np.arange(len(which)), n)
    full, _ = _em(likes, begin, local, n, np.full((len(which), size), 1 / size), ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best, kept = np.full(len(which), -np.inf), np.zeros_like(full)
    for k in range(1, size + 1):
        start = np.where(rank < k, np.maximum(full, 1e-6), 0.0)
        shares, fit_ = _em(likes, begin, local, n, start / start.sum(axis=1, keepdims=True), REFITS if k > 1 else 0)
        value = fit_ - PENALTY * (k - 1) * np.log(n + 1)
        better = value > best + 1e-9
        best[better], kept[better] = value[better], shares[better]
    for i, shares in zip(which, kept, strict=True):
        top = int(shares.argmax())
        out[i] = (model.names[top], float(shares[top]), [(model.names[j], float(shares[j])) for j in np.argsort(-shares, kind="stable") if shares[j] > 0])
    return out


def _identify(model: LanguageModel):
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            found = [x for a, b in _blocks(texts) for x in mixtures(texts[a:b], model)]
            sets = [[{"lang": a, "share": s} for a, s in x[2]] for x in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                [*batch.schema.names[1:], "lang_pred", "score", "languages"],
            )

    return run


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, languages: the selected set with shares)."""
    ship(docs.sparkSession)
    schema = f"lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    fields = [docs.schema[key], *T._parse_datatype_string(schema).fields]
    return docs.select(F.col(text).alias("__strand_text"), key).mapInArrow(_identify(model), T.StructType(fields))


def op10_language(spark, sf_dir) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    found = identify(docs, fit(docs.where(~held & F.col("doc_id").isNotNull())))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
