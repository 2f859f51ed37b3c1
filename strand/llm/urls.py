"""URL filters: domain rules, then a character language-model ratio.

The longest rule that fits a URL decides it. URLs that rules decide train two smoothed
variable-order Markov models, one of accepted and one of rejected URLs: the probability
of a character after a context of up to ORDER - 1 characters is its count there, smoothed
by the probability after the context's tail, down to an even chance of any character; a
context that a model has never met leaves it at its tail's. A URL without a rule gets the
difference of the two log-likelihoods divided by its length. The difference at order k is
the one at order k - 1 plus a correction: one value for an n-gram that training met, and,
for every other character behind a context that it met, the context's own. So a URL's
score is one sum over the n-grams that lie in it, each giving what it adds as an n-gram
and what it adds as the context of the next character. The threshold is where the two
error rates add up to least on a tenth of the ruled URLs, scored by models that left them
out; the final models are of all ruled URLs.

Defined cases: a null URL, or one without "://", has an empty host and path and scores 0;
without ruled URLs of both kinds the threshold is 0 and every score 0 (allow); rules of
equal length: the longer host, then the lesser text; repeated rows and ids stay; URLs are
read whole, however long; other columns aren't read and may have any name; an empty table
gives an empty result. A broadcast model has at most BROADCAST_ROWS n-grams of ORDER
characters, some 20 MB; a larger one is joined by shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_checked, saved

#: Characters of the longest n-gram, the predicted one included.
ORDER = 5
#: Weight of the shorter context's estimate, in characters counted.
SMOOTHING = 2.0
ALPHABET = 128
#: Score buckets in which the threshold is looked for, per nat.
STEPS = 100
HELD_OUT = 10
BEGIN = "\u0002"


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)


def url_parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (host, path) with `rule` and `ruled`, its verdict; null where none fits."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), len(r.host), [-ord(c) for c in r.rule])):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))
        rule, ruled = F.when(fits, r.rule).otherwise(rule), F.when(fits, r.verdict).otherwise(ruled)
    return pages.withColumns({"rule": rule, "ruled": ruled})


def _grams(rows: DataFrame, order: int) -> DataFrame:
    """rows with `g`: the n-grams of host and path behind a mark of the beginning; `ends`: the place of its last character."""
    s = F.concat(F.lit(BEGIN), "host", "path")
    marked = rows.withColumn("s", s).where(F.length("s") > 1)
    placed = marked.withColumn("ends", F.explode(F.sequence(F.lit(1), F.length("s"))))
    sized = placed.withColumn("k", F.explode(F.sequence(F.lit(1), F.least("ends", F.lit(order)))))
    return sized.withColumn("g", F.expr("substring(s, ends - k + 1, k)")).drop("s", "k", "host", "path")


def _counts(rows: DataFrame, order: int) -> DataFrame:
    """(g, a, r): how often accepted and rejected URLs have each n-gram; the mark alone is no character."""
    grams = _grams(rows.select("host", "path", "ruled"), order).where("ends > 1")
    return grams.groupBy("g").agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("r"))


def _model(counts: DataFrame, order: int, smoothing: float) -> tuple[DataFrame, float]:
    """(g, gain, follow), and what any character adds: gain is for n-gram g's last character, follow for any character behind g."""
    context = F.expr("substring(g, 1, length(g) - 1)")
    sums = counts.groupBy(context.alias("c")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
    totals = saved(sums.withColumn("follow", F.round(F.log((F.col("cr") + smoothing) / (F.col("ca") + smoothing)), 12)), "contexts")
    chance = lambda n, of, below: (F.col(n) + smoothing * below) / (F.col(of) + smoothing)
    gains, tail = [], None
    for k in range(1, order + 1):
        own = counts.where(F.length("g") == k).withColumn("c", context).join(totals, "c")
        if tail is None:
            own = own.withColumns({"ba": F.lit(1.0 / ALPHABET), "br": F.lit(1.0 / ALPHABET)})
        else:
            own = own.join(tail, F.expr("substring(g, 2, length(g))") == F.col("t"))
        own = own.withColumns({"pa": chance("a", "ca", F.col("ba")), "pr": chance("r", "cr", F.col("br"))})
        change = F.log(F.col("pa") / F.col("pr")) - F.log(F.col("ba") / F.col("br"))
        level = saved(own.select("g", "pa", "pr", F.round(change - F.col("follow"), 12).alias("gain")), f"order{k}")
        gains.append(level.select("g", "gain", F.lit(0.0).alias("follow")))
        tail = level.select(F.col("g").alias("t"), F.col("pa").alias("ba"), F.col("pr").alias("br"))
    out = totals.where("c <> ''").select(F.col("c").alias("g"), F.lit(0.0).alias("gain"), "follow")
    for level in gains:
        out = out.unionByName(level)
    always = totals.where("c = ''").select("follow").first()
    return out.groupBy("g").agg(F.sum("gain").alias("gain"), F.sum("follow").alias("follow")), always["follow"] if always else 0.0


@dataclass(frozen=True)
class UrlModel:
    grams: DataFrame
    always: float
    order: int
    threshold: float

    def scores(self, rows: DataFrame) -> DataFrame:
        """(uid, score) of rows (uid, host, path) with any character."""
        sized = rows.withColumn("n", F.length(F.concat("host", "path")))
        matched = _grams(sized.select("uid", "n", "host", "path"), self.order).join(broadcast_checked(self.grams), "g", "left")
        adds = F.when(F.col("ends") <= F.col("n"), F.coalesce("follow", F.lit(0.0))).otherwise(F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))
        return matched.groupBy("uid").agg(F.round(F.lit(self.always) + F.sum(adds) / F.first("n"), 9).alias("score"))


def _threshold(scored: DataFrame) -> float:
    """Least score to allow: the two error rates there add up to least; nearest to zero among equals."""
    per = scored.groupBy(F.floor(F.col("score") * STEPS).alias("b")).agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("r"))
    row = per.sparkSession.sql(
        """
        SELECT b FROM (
          SELECT b, coalesce(sum(a) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(a) OVER () AS lost,
                 sum(r) OVER (ORDER BY b DESC) / sum(r) OVER () AS let_in FROM {per})
        WHERE lost IS NOT NULL AND let_in IS NOT NULL ORDER BY lost + let_in, abs(b), b LIMIT 1""",
        per=per,
    ).first()
    return 0.0 if row is None else row["b"] / STEPS


def train(ruled: DataFrame, order: int = ORDER, smoothing: float = SMOOTHING) -> UrlModel:
    """The two models from rows (uid, host, path, ruled) that rules decided, and their calibrated threshold."""
    held = F.pmod(F.xxhash64("host", "path"), F.lit(HELD_OUT)) == 0

    def model(counts: DataFrame, threshold: float) -> UrlModel:
        both = counts.agg(F.sum("a") > 0, F.sum("r") > 0).first()
        if not (both[0] and both[1]):
            return UrlModel(counts.limit(0).select("g", F.lit(0.0).alias("gain"), F.lit(0.0).alias("follow")), 0.0, order, 0.0)
        grams, always = _model(counts, order, smoothing)
        return UrlModel(saved(grams, "urlmodel"), always, order, threshold)

    parts = saved(_counts(ruled.where(~held), order).withColumn("held", F.lit(False)).unionByName(_counts(ruled.where(held), order).withColumn("held", F.lit(True))), "grams")
    rows = ruled.where(held)
    first = model(parts.where("NOT held").drop("held"), 0.0)
    threshold = _threshold(rows.join(first.scores(rows), "uid"))
    return model(saved(parts.groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "grams"), threshold)


def url_filter(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, score): score is null where a rule decides."""
    host, path = url_parts(url)
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rows = saved(by_rules(rows, rules).withColumn("uid", F.monotonically_increasing_id()), "urls")
    model = train(rows.where("ruled IS NOT NULL"))
    left = rows.where("ruled IS NULL")
    scored = left.join(model.scores(left), "uid", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    judged = scored.withColumn("verdict", F.when(F.col("score") >= model.threshold, "allow").otherwise("block"))
    out = ["key", "host", "path", "rule", "verdict", "score"]
    ruled = rows.where("ruled IS NOT NULL").withColumns({"verdict": F.col("ruled"), "score": F.lit(None).cast("double")})
    return judged.select(*out).unionByName(ruled.select(*out)).withColumnRenamed("key", key)


def op2_urls(spark, sf_dir) -> DataFrame:
    from .common import table

    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
