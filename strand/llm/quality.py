"""Quality rules with thresholds that adapt to each language and source.

Every signal of a text is an integer computed by SQL functions. Its distribution
in each (language, source) is kept as a histogram whose buckets keep the leading
eight bits of the value: such sketches merge by adding counts, whatever the order,
and bound a quantile's relative error by 1/128. Quartiles read from the sketches
give each group a fence; groups with few texts use their language's sketch, or
the sketch of all texts. The fences are then joined to the texts.

Defined cases: a null or empty text has no words and fails the base rules; null
languages and sources form groups of their own; repeated rows count as often as
they come, and equal values share a bucket; texts are read whole, however long; other
columns may have any name that doesn't begin with __strand; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, broadcast_checked, let, saved

WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rules:
    """Base rules, and the fences' parameters.

    reach: quartile ranges beyond the quartiles; least: the smallest range that
    counts, in each signal's unit (thousandths; hundredths of a character for
    word_length); min_group: texts below which a coarser sketch is used.
    """

    min_words: int = 20
    max_repeat_percent: int = 30
    reach: int = 3
    min_group: int = 100
    symbols: int = 20
    dup_lines: int = 100
    repeats: int = 60
    upper: int = 60
    word_length: int = 120

    def least(self) -> dict[str, int]:
        return {"symbols": self.symbols, "dup_lines": self.dup_lines, "repeats": self.repeats, "upper": self.upper, "word_length": self.word_length}


RULES = Rules()
Q = "__strand_quality"


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(hashes: Column) -> Column:
    """Words inside 8-word windows that occur twice or more, from the words' hashes."""
    windows = F.when(
        F.size(hashes) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(placed: Column) -> Column:
        last = F.size(placed) - 1
        twice = F.filter(
            placed,
            lambda x, i: ((i > 0) & (F.get(placed, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(placed, i + 1)["h"] == x["h"])),
        )
        starts = F.array_sort(F.transform(twice, lambda x: x["at"]))
        step = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("end"))
        total = lambda s: F.aggregate(
            s,
            step,
            lambda acc, at: F.struct((acc["sum"] + F.least(F.lit(WINDOW), at - acc["end"])).alias("sum"), at.alias("end")),
            lambda acc: acc["sum"],
        )
        return let(starts, total)

    def count(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(placed, covered))

    return let(windows, count)


def quality_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the struct of signals in column `__strand_quality`."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, f"{SPACES}+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACES[1:]}"))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    out = docs.withColumns({f"{Q}_h": hashes, f"{Q}_l": lines})
    bare = F.translate(t, " \t\n\x0b\x0c\r", "")
    long = lambda c: c.cast("long")
    out = out.withColumn(
        Q,
        F.struct(
            long(F.size(f"{Q}_h")).alias("n_words"),
            long(F.length(bare)).alias("word_chars"),
            long(_removed(t, SYMBOLS)).alias("n_symbols"),
            long(F.size(f"{Q}_l") - F.size(F.array_distinct(f"{Q}_l"))).alias("n_dup_lines"),
            long(let(F.col(f"{Q}_h"), _repeat_words)).alias("n_repeat_words"),
            long(F.size(f"{Q}_l")).alias("n_lines"),
            long(_removed(t, UPPER)).alias("n_upper"),
        ),
    )
    return out.drop(f"{Q}_h", f"{Q}_l")


def _measures() -> dict[str, Column]:
    q = F.col(Q)
    share = lambda n, of, unit: F.expr(f"{unit} * {Q}.{n} div greatest({Q}.{of}, 1)")
    return {
        "symbols": share("n_symbols", "word_chars", 1000),
        "dup_lines": share("n_dup_lines", "n_lines", 1000),
        "repeats": share("n_repeat_words", "n_words", 1000),
        "upper": share("n_upper", "word_chars", 1000),
        "word_length": F.when(q["n_words"] > 0, share("word_chars", "n_words", 100)).otherwise(F.lit(0).cast("long")),
    }


def quantile_sketches(signals: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, signal, bucket, n): one mergeable histogram per group and signal."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), v.alias("v")) for k, v in _measures().items()]))
    flat = signals.select(F.col(lang).alias("lang"), F.col(source).alias("source"), pairs.alias("p")).select("lang", "source", "p.*")
    shift = "greatest(length(bin(v)) - 8, 0)"
    flat = flat.withColumn("bucket", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})"))
    return flat.groupBy("lang", "source", "signal", "bucket").agg(F.count("*").alias("n"))


def adaptive_thresholds(sketches: DataFrame, rules: Rules = RULES) -> DataFrame:
    """A fence (lo_<signal>, hi_<signal>) for each (lang, source)."""
    least = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.least().items())
    picked = ", ".join(f"max(CASE WHEN signal = '{k}' THEN lo END) AS lo_{k}, max(CASE WHEN signal = '{k}' THEN hi END) AS hi_{k}" for k in rules.least())
    return sketches.sparkSession.sql(f"""
        WITH merged AS (
          SELECT lang, source, signal, bucket, sum(n) AS n, 2 * grouping(lang) + grouping(source) AS level
          FROM {{sketches}}
          GROUP BY GROUPING SETS ((lang, source, signal, bucket), (lang, signal, bucket), (signal, bucket))),
        summed AS (
          SELECT *, sum(n) OVER (PARTITION BY level, lang, source, signal ORDER BY bucket) AS upto,
                 sum(n) OVER (PARTITION BY level, lang, source, signal) AS total FROM merged),
        quartiles AS (
          SELECT level, lang, source, signal, max(total) AS total,
                 min(CASE WHEN 4 * upto >= total THEN bucket END) AS q1,
                 min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS q3
          FROM summed GROUP BY level, lang, source, signal),
        fences AS (
          SELECT level, lang, source, signal, total,
                 q1 - {rules.reach} * greatest(q3 - q1, CASE signal {least} END) AS lo,
                 q3 + {rules.reach} * greatest(q3 - q1, CASE signal {least} END) AS hi FROM quartiles),
        chosen AS (
          SELECT g.lang, g.source, g.signal,
                 CASE WHEN g.total >= {rules.min_group} THEN g.lo WHEN l.total >= {rules.min_group} THEN l.lo ELSE a.lo END AS lo,
                 CASE WHEN g.total >= {rules.min_group} THEN g.hi WHEN l.total >= {rules.min_group} THEN l.hi ELSE a.hi END AS hi
          FROM fences g
          JOIN fences l ON l.level = 1 AND l.lang <=> g.lang AND l.signal = g.signal
          JOIN fences a ON a.level = 3 AND a.signal = g.signal
          WHERE g.level = 0)
        SELECT lang AS f_lang, source AS f_source, {picked} FROM chosen GROUP BY lang, source""", sketches=sketches)


def judge(signals: DataFrame, fences: DataFrame, rules: Rules = RULES, lang: str = "lang", source: str = "source") -> DataFrame:
    """signals with base_failed and kept inside the struct; fences joined by group."""
    q, own = F.col(Q), "__strand_fence_"
    fences = fences.select(*[F.col(c).alias(own + c) for c in fences.columns])
    same = F.col(lang).eqNullSafe(F.col(f"{own}f_lang")) & F.col(source).eqNullSafe(F.col(f"{own}f_source"))
    joined = signals.join(broadcast_checked(fences), same, "left")
    base = (q["n_words"] < rules.min_words) | (100 * q["n_repeat_words"] > rules.max_repeat_percent * q["n_words"])
    inside = F.lit(True)
    for name, value in _measures().items():
        inside = inside & (value <= F.col(f"{own}hi_{name}"))
        if name == "word_length":
            inside = inside & (value >= F.col(f"{own}lo_{name}"))
    out = joined.withColumn(Q, q.withField("base_failed", base).withField("kept", F.coalesce(~base & inside, F.lit(False))))
    return out.drop(*fences.columns)


def quality_rules(docs: DataFrame, rules: Rules = RULES, columns: list[str] | None = None) -> DataFrame:
    """docs (only `columns`, if given) with signals and verdict in `__strand_quality`.

    The signals are computed once and written; sketches and verdicts read that table.
    """
    columns = docs.columns if columns is None else columns
    signals = saved(quality_signals(docs).select(*columns, Q), "quality")
    fences = saved(adaptive_thresholds(quantile_sketches(signals), rules), "fences")
    return judge(signals, fences, rules)


def quality_filter(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    return quality_rules(docs, rules).where(F.col(Q)["kept"]).select(*docs.columns)


def op1_quality(spark, sf_dir) -> DataFrame:
    from .common import table

    judged = quality_rules(table(spark, sf_dir, "documents"), columns=["doc_id", "lang", "source"])
    return judged.select("doc_id", *[F.col(Q)[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def _duck_measure(n: str, of: str, unit: int) -> str:
    return f"({unit} * {n}) // greatest({of}, 1)"


OP1_SQL = f"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, t,
         list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM base),
wins AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM parts WHERE len(w) >= 8)),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM wins) WHERE c > 1),
covered AS (
  SELECT r, sum(least(8, i - prev)) AS n
  FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -100) AS prev FROM twice) GROUP BY r),
signals AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM parts LEFT JOIN covered USING (r)),
measured AS (
  SELECT *, {_duck_measure("n_symbols", "word_chars", 1000)} AS m1, {_duck_measure("n_dup_lines", "n_lines", 1000)} AS m2,
         {_duck_measure("n_repeat_words", "n_words", 1000)} AS m3, {_duck_measure("n_upper", "word_chars", 1000)} AS m4,
         {_duck_measure("word_chars", "n_words", 100)} AS m5 FROM signals),
flat AS (
  SELECT lang, source, k, v FROM (
    SELECT lang, source, unnest([1, 2, 3, 4, 5]) AS k, unnest([m1, m2, m3, m4, m5]) AS v FROM measured)),
sketch AS (
  SELECT lang, source, k, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) AS bucket, count(*) AS n
  FROM flat GROUP BY ALL),
merged AS (
  SELECT 0 AS level, lang, source, k, bucket, n FROM sketch
  UNION ALL SELECT 1, lang, NULL, k, bucket, sum(n) FROM sketch GROUP BY lang, k, bucket
  UNION ALL SELECT 3, NULL, NULL, k, bucket, sum(n) FROM sketch GROUP BY k, bucket),
summed AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, k ORDER BY bucket) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, k) AS total FROM merged),
quartiles AS (
  SELECT level, lang, source, k, max(total) AS total, min(bucket) FILTER (4 * upto >= total) AS q1,
         min(bucket) FILTER (4 * upto >= 3 * total) AS q3 FROM summed GROUP BY level, lang, source, k),
fences AS (
  SELECT level, lang, source, k, total, q1 - {RULES.reach} * greatest(q3 - q1, {list(RULES.least().values())}[k]) AS lo,
         q3 + {RULES.reach} * greatest(q3 - q1, {list(RULES.least().values())}[k]) AS hi FROM quartiles),
chosen AS (
  SELECT g.lang, g.source, g.k,
         CASE WHEN g.total >= {RULES.min_group} THEN g.lo WHEN l.total >= {RULES.min_group} THEN l.lo ELSE a.lo END AS lo,
         CASE WHEN g.total >= {RULES.min_group} THEN g.hi WHEN l.total >= {RULES.min_group} THEN l.hi ELSE a.hi END AS hi
  FROM fences g JOIN fences l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM g.lang AND l.k = g.k
  JOIN fences a ON a.level = 3 AND a.k = g.k WHERE g.level = 0),
wide AS (
  SELECT lang, source, max(hi) FILTER (k = 1) AS h1, max(hi) FILTER (k = 2) AS h2, max(hi) FILTER (k = 3) AS h3,
         max(hi) FILTER (k = 4) AS h4, max(hi) FILTER (k = 5) AS h5, max(lo) FILTER (k = 5) AS l5
  FROM chosen GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND m1 <= h1 AND m2 <= h2 AND m3 <= h3 AND m4 <= h4 AND m5 <= h5 AND m5 >= l5 AS kept
FROM measured m JOIN wide f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
"""
