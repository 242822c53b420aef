"""URL filter by a ratio of character language models.

Fixed rules judge what they fit. The urls they allow and block train two Markov models of characters with contexts of
up to three characters, smoothed from order to order (Witten-Bell: a context seen n times with d different successors
gives d / (n + d) of its mass to the next shorter context). Every other url is judged by its mean log-likelihood
difference per character against a threshold calibrated on held-out judged urls.

Characters are 32 symbols (letters without case, one for digits, four for marks, one for the start). What is broadcast are
the ratios of the four-symbol sequences seen in training, 32^4 at most whatever the table's size, and 32^3 numbers each
for leaving a context and for the next shorter one. A url is cut once into short pieces that overlap by a context, so that
work grows with its length; sums go by the md5 of a url, before anything is shuffled, and meet the rows again at the end.
Everything runs in DataFrame operations.

Defined results: a null url, or one without ``://``, has an empty host and path; a null or empty url is blocked;
repeated rows get the same verdict each; without judged urls of both kinds the difference is 0 and the verdict allow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = 32
ORDER = 3
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Characters of a piece, besides the context it takes over.
PIECE = 64
#: Thresholds tried: this many a unit of the score, from -4 to 4.
STEPS = 50


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, written host and path; null if none does."""
    out = F.lit(None).cast("string")
    for h, p, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), h + p).otherwise(out)
    return out


def verdict_of(rule: Column, rules: tuple = RULES) -> Column:
    out = F.lit(None).cast("string")
    for h, p, verdict in rules:
        out = F.when(rule == h + p, verdict).otherwise(out)
    return out


def symbols(url: Column) -> Column:
    """One character from @ to _ (codes 64 to 95) for each character, after three for the start."""
    marked = F.translate(F.regexp_replace(F.translate(url, UPPER, LOWER), r"[^a-z0-9/.\-]", "_"), LOWER + "0123456789/.-", UPPER + "[" * 10 + "\\]^")
    return F.concat(F.lit("@" * ORDER), F.coalesce(marked, F.lit("")))


def _code(text: Column, at: Column, size: int) -> Column:
    """The ``size`` symbols from ``at`` on, as a number."""
    out = F.lit(0)
    for k in range(size):
        out = out * SYMBOLS + F.ascii(F.substring(text, at + k, 1)) - 64
    return out


def _grams(rows: DataFrame, url: str) -> DataFrame:
    """The other columns of ``rows`` with ``code`` for each character of the column ``url`` and its context, and ``first``
    for the first of a url. Urls without characters have no rows."""
    kept = [c for c in rows.columns if c != url]
    parts = F.regexp_extract_all(symbols(F.col(url)), F.lit(f"(.{{1,{PIECE}}})"), F.lit(1))
    held = rows.filter(F.length(url) > 0).select(*kept, parts.alias("parts_"))
    before = F.concat(F.array(F.lit("")), F.slice("parts_", 1, F.size("parts_") - 1))
    pieces = held.select(*kept, F.posexplode(F.zip_with(before, "parts_", lambda p, q: F.concat(F.right(p, F.lit(ORDER)), q))).alias("k_", "piece_"))
    places = pieces.filter(F.length("piece_") > ORDER).withColumn("at_", F.explode(F.sequence(F.lit(1), F.length("piece_") - ORDER)))
    first = (F.col("k_") == 0) & (F.col("at_") == 1)
    return places.select(*kept, _code(F.col("piece_"), F.col("at_"), ORDER + 1).cast("long").alias("code"), first.alias("first"))


@dataclass
class Model:
    """Log-likelihood ratios, allowed to blocked. All three tables are bounded by the number of symbols."""

    seen: DataFrame  # code of four symbols, llr: those seen in training, 32^4 at most
    escape: DataFrame  # context of three symbols, escape: what leaving it adds, 32^3 at most
    shorter: DataFrame  # code of three symbols, short_llr: 32^3
    threshold: float


def _sides(f) -> list[Column]:
    return [f(side).alias(out) for side, out in (("good", "good"), ("bad", "bad"))]


def _smoothed(side: str, shorter: str) -> Column:
    """n / (n + d) of the count and d / (n + d) of the shorter context; all of that, where the context is not known."""
    total, kinds = F.col(f"{side}_total"), F.col(f"{side}_kinds")
    known = (F.coalesce(side, F.lit(0)) + kinds * F.col(shorter)) / (total + kinds)
    return F.when(F.coalesce(total, F.lit(0)) > 0, known).otherwise(F.col(shorter))


def _tables(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of a model from ``counts`` (gram of four symbols, good, bad)."""
    spark = counts.sparkSession
    shorter = spark.range(1).select(F.lit(0).cast("long").alias("rest"), *_sides(lambda side: F.lit(1.0 / SYMBOLS)))
    for order in range(ORDER + 1):
        grams = SYMBOLS ** (order + 1)
        seen = counts.groupBy(F.pmod("gram", F.lit(grams)).cast("long").alias("code")).agg(*_sides(F.sum)) if order < ORDER else counts.withColumnRenamed("gram", "code")
        context = F.shiftright("code", 5).alias("context")
        totals = [x for side in ("good", "bad") for x in (F.sum(side).alias(f"{side}_total"), F.count_if(F.col(side) > 0).alias(f"{side}_kinds"))]
        contexts = common.cut(seen.groupBy(context).agg(*totals), "contexts")
        codes = spark.range(grams).withColumnRenamed("id", "code").join(seen, "code", "left") if order < ORDER else seen
        codes = codes.withColumns({"context": F.shiftright("code", 5), "rest": F.pmod("code", F.lit(max(1, grams // SYMBOLS if order else 1)))})
        below = shorter.withColumnsRenamed({"good": "good_below", "bad": "bad_below"})
        joined = codes.join(F.broadcast(contexts), "context", "left").join(F.broadcast(below), "rest")  # 32^3 rows at most
        level = joined.select("code", *_sides(lambda side: _smoothed(side, f"{side}_below")))
        if order == ORDER:
            lost = lambda side: F.when(F.col(f"{side}_total") > 0, F.log(F.col(f"{side}_kinds") / (F.col(f"{side}_total") + F.col(f"{side}_kinds")))).otherwise(0.0)
            escape = contexts.select("context", (lost("good") - lost("bad")).alias("escape"))
            return common.cut(level.select("code", F.log(F.col("good") / F.col("bad")).alias("llr")), "seen"), common.cut(escape, "escape"), shorter.select(F.col("rest"), F.log(F.col("good") / F.col("bad")).alias("short_llr"))
        shorter = common.cut(level.withColumnRenamed("code", "rest"), "shorter")
    raise AssertionError


def _scored(rows: DataFrame, url: str, model: Model) -> DataFrame:
    """``rows`` with score: the mean difference per character of the column ``url``; 0 without characters."""
    keyed = rows.withColumn("key_", F.md5(F.col(url).cast("binary")))
    grams = _grams(keyed.select("key_", url), url)
    grams = grams.withColumns({"context": F.shiftright("code", 5), "rest": F.pmod("code", F.lit(SYMBOLS**ORDER))})
    found = grams.join(F.broadcast(model.seen), "code", "left").join(F.broadcast(model.escape), "context", "left").join(F.broadcast(model.shorter), "rest", "left")
    value = F.coalesce("llr", F.coalesce("escape", F.lit(0.0)) + F.col("short_llr"))
    sums = common.cut(found.groupBy("key_").agg(F.avg(value).alias("score"), F.count_if("first").alias("times_")), "scores")
    told = common.spread_join(keyed.filter(F.length(url) > 0), sums, ["key_"], "times_").drop("key_", "times_")
    none = rows.filter(F.col(url).isNull() | (F.length(url) == 0)).withColumn("score", F.lit(0.0))
    return told.unionByName(none)


def train(judged: DataFrame) -> Model:
    """``judged``: url and verdict. A fifth, by a hash of the url, is held out to calibrate the threshold."""
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    rows = judged.filter("url is not null and length(url) > 0").select("url", (F.col("verdict") == "allow").alias("good"), held.alias("held"))
    grams = _grams(rows.filter(~F.col("held")).select("url", "good"), "url").select("good", F.col("code").alias("gram"))
    counts = common.cut(grams.groupBy("gram").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")), "grams")
    model = Model(*_tables(counts), 0.0)
    step = F.greatest(F.lit(-4 * STEPS), F.least(F.lit(4 * STEPS), F.floor(F.col("score") * STEPS))).cast("int")
    found = _scored(rows.filter("held").select("url", "good"), "url", model).select("good", step.alias("step")).groupBy("step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("step").collect()
    good, bad = sum(r["good"] for r in found), sum(r["bad"] for r in found)
    best, passed = -1.0, [good, 0]
    if good and bad:
        for r in found:  # everything from this step on is allowed
            rate = passed[0] / good + passed[1] / bad
            if rate > best:
                best, model.threshold = rate, r["step"] / STEPS
            passed = [passed[0] - r["good"], passed[1] + r["bad"]]
    return model


def judge(df: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score; the model is trained on what the rules judge, if not given."""
    rows = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    rows = rows.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    model = model or train(rows.filter("rule is not null").select("url", verdict_of(F.col("rule"), rules).alias("verdict")))
    scored = _scored(rows, "url", model)
    method = F.when((F.length(F.coalesce("url", F.lit(""))) > 0) & (F.col("score") >= model.threshold), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), method).alias("verdict"), "score")


def op3_markov_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages"))
