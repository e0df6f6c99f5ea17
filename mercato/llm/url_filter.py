"""URL filter: rules first, then the ratio of two character models, in DataFrame functions only.

URLs that a rule decides are the examples: accepted and rejected ones each train
a variable-order Markov model over 32 symbols. A model's chance of a symbol
mixes the orders 0 to 3 (Witten-Bell): the more different symbols have followed a
context, the more weight goes to the next shorter one; an unseen context
hands over to it wholly. A URL's score is the mean over its symbols of the log
ratio of the two chances. The bound between accepted and rejected is
calibrated on rule-decided URLs that did not train the models.

The models are tables of at most 32**4 rows whatever the input, so the tables
of log ratios, for contexts of three symbols that examples have and for all
contexts of two, can be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.operators.durable import OwnedTables

#: Letters, a digit, and marks; any other character is "~", the start of a URL "^".
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./-~^"
BASE = len(SYMBOLS)
ORDER = 3
#: One in so many rule-decided URLs calibrates instead of training.
CALIBRATION = 5
#: Width and number of score steps for the calibration.
STEPS, STEP = 400, 0.01
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is a host, then a path's beginning; it fits the host and its subdomains."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1] if "/" in self.pattern else ""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fits(rule: UrlRule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def matched(rules: list[UrlRule], host: Column, path: Column, give: str) -> Column:
    """Pattern or verdict of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.pattern)):
        found = F.when(fits(rule, host, path), F.lit(getattr(rule, give))).otherwise(found)
    return found


def symbols_of(host: Column, path: Column) -> Column:
    """The symbols of host and path as numbers, after three starts."""
    plain = F.lower(F.concat(host, path))
    plain = F.translate(plain, "123456789", "0" * 9)
    plain = F.regexp_replace(plain, r"[^a-z0./\-]", "~")
    chars = F.split(F.concat(F.lit("^" * ORDER), plain), "")
    return F.transform(F.array_remove(chars, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)


def grams_of(symbols: Column) -> Column:
    """For every symbol, itself with the three before it as one number below 32**4."""
    count = F.size(symbols) - ORDER
    at = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))))

    def number(i: Column) -> Column:
        out = F.get(symbols, i)
        for k in range(1, ORDER + 1):
            out = out * BASE + F.get(symbols, i + k)
        return out

    return F.transform(at, number)


def _model(counts: DataFrame, examples: str, order: int, shorter: DataFrame | None) -> DataFrame:
    """``gram`` of order + 1 symbols and ``chance`` of its last symbol after the others.

    ``counts``: gram of the full order and the number of ``examples`` of it; ``shorter``:
    the model of the next lower order, a written table.
    """
    spark = counts.sparkSession
    size = BASE ** (order + 1)
    seen = (
        counts.select((F.col("gram") % size).alias("gram"), F.col(examples).alias("n"))
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .where("n > 0")
    )
    contexts = (
        seen.withColumn("context", F.floor(F.col("gram") / BASE))
        .groupBy("context")
        .agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    )
    if order == ORDER:
        # Only contexts that either kind of example has: for the others the next shorter order speaks.
        grid = counts.select(F.floor(F.col("gram") / BASE).alias("context")).distinct()
        grid = grid.select("context", F.explode(F.sequence(F.lit(0), F.lit(BASE - 1))).alias("symbol"))
        grid = grid.select((F.col("context") * BASE + F.col("symbol")).alias("gram"), "context")
    else:
        grid = spark.range(size).select(F.col("id").alias("gram"), F.floor(F.col("id") / BASE).alias("context"))
    full = grid.join(seen, "gram", "left").join(F.broadcast(contexts), "context", "left").na.fill(0)
    if shorter is None:
        full = full.withColumn("before", F.lit(1.0 / BASE))
    else:
        below = shorter.select(F.col("gram").alias("tail"), F.col(examples).alias("before"))
        # At most 32**3 rows.
        full = full.withColumn("tail", F.col("gram") % (size // BASE)).join(F.broadcast(below), "tail")
    weight = F.col("total") + F.col("kinds")
    mixed = F.when(weight > 0, (F.col("n") + F.col("kinds") * F.col("before")) / weight).otherwise(F.col("before"))
    return full.select("gram", mixed.alias(examples))


def judge_urls(
    pages: DataFrame,
    rules: list[UrlRule],
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Key, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of every row.

    ``score`` is the log ratio less the calibrated bound, at least 0 for
    accepted URLs; null where a rule decides. A null URL or one without ``://``
    has no symbols and, like all URLs where one kind of example is
    missing, gets ``default``. Rows are independent: repeated or null
    keys do no harm. Other columns are not read.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"`{url}`"))
    split = pages.select(F.col(f"`{key}`"), host.alias("host"), path.alias("path"))
    decided = split.select(
        key,
        "host",
        "path",
        matched(rules, F.col("host"), F.col("path"), "pattern").alias("rule"),
        matched(rules, F.col("host"), F.col("path"), "verdict").alias("ruled"),
    )
    tables = OwnedTables(spark, "url-filter")
    # Written, so that what reads a row's grams computes nothing of it again, whatever the planner moves.
    ruled = decided.select(
        F.monotonically_increasing_id().alias("_row"),
        "*",
        (F.col("ruled") == "allow").alias("accepted"),
        # Equal URLs fall on one side, so that none is trained and calibrated with.
        (F.pmod(F.xxhash64("host", "path"), F.lit(CALIBRATION)) == 0).alias("held"),
    )
    rows = tables.write(with_grams(ruled), "rows")
    examples = rows.where("ruled IS NOT NULL")
    counts = tables.write(
        examples.where("NOT held")
        .select("accepted", F.explode("grams").alias("gram"))
        .groupBy("gram")
        .agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no")),
        "counts",
    )
    either = counts.agg(F.max("yes"), F.max("no")).first()
    if not (either[0] and either[1]):
        verdict = F.coalesce("ruled", F.lit(default))
        return rows.select(key, "host", "path", "rule", verdict.alias("verdict"), F.lit(None).cast("double").alias("score"))
    # Each order is written before the next is built on it, so no plan holds more than one.
    ratios, model = [], None
    for order in range(ORDER + 1):
        yes, no = (_model(counts, kind, order, model) for kind in ("yes", "no"))
        model = tables.write(yes.join(no, "gram"), f"model-{order}")
        if order >= ORDER - 1:
            ratio = F.log(F.col("yes") / F.col("no")).cast("float")
            ratios.insert(0, model.select("gram", ratio.alias("ratio")))
    # The bound with the fewest errors, both kinds of example counted alike.
    step = F.floor(F.col("ratio") / STEP).cast("int")
    step = F.greatest(F.lit(-STEPS), F.least(F.lit(STEPS), step))
    held = scored(examples.where("held"), ratios, ["_row", "accepted"]).where("ratio IS NOT NULL")
    tally = {
        row["step"]: (row["good"], row["bad"])
        for row in held.groupBy(step.alias("step"))
        .agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad"))
        .collect()
    }
    bound = calibrated(tally)
    free = scored(rows.where("ruled IS NULL"), ratios, ["_row"])
    judged = rows.drop("grams").join(free, "_row", "left").withColumn("score", F.col("ratio") - bound)
    verdict = (
        F.when(F.col("ruled").isNotNull(), F.col("ruled"))
        .when(F.col("score") < 0, F.lit("block"))
        .when(F.col("score") >= 0, F.lit("allow"))
        .otherwise(F.lit(default))
    )
    return judged.select(key, "host", "path", "rule", verdict.alias("verdict"), "score")


def with_grams(rows: DataFrame) -> DataFrame:
    """``rows`` (host, path) with ``grams``."""
    # The symbols get a column of their own: every gram reads them four times.
    split = rows.withColumn("symbols", symbols_of(F.col("host"), F.col("path")))
    return split.withColumn("grams", grams_of(F.col("symbols"))).drop("symbols")


def scored(rows: DataFrame, ratios: list[DataFrame], columns: list[str]) -> DataFrame:
    """``columns``, a row's number first, with ``ratio``, the mean of its grams' log ratios; none without grams.

    Only these columns go with every gram, so the cost follows the URL's length; a row's
    grams are added up in the task that made them. The tables of ratios have at
    most 32**4 and 32**3 rows and are broadcast.
    """
    long, short = ratios
    short = short.select(F.col("gram").alias("tail"), F.col("ratio").alias("short"))
    spread = rows.select(*columns, F.explode("grams").alias("gram"))
    spread = spread.withColumn("tail", F.col("gram") % BASE**ORDER)
    return (
        spread.join(F.broadcast(long), "gram", "left")
        .join(F.broadcast(short), "tail", "left")
        .groupBy(*columns)
        .agg(F.avg(F.coalesce("ratio", "short").cast("double")).alias("ratio"))
    )


def calibrated(tally: dict[int, tuple[int, int]]) -> float:
    """Bound with the least share of wrong examples; of equal ones the lowest.

    ``tally``: accepted and rejected examples by score step. Without both kinds
    the bound is 0.
    """
    good = sum(g for g, _ in tally.values())
    bad = sum(b for _, b in tally.values())
    if not good or not bad:
        return 0.0
    best, wrong = min(tally), float(1)
    lost, caught = 0, 0  # accepted and rejected examples below the step
    for step in sorted(tally):
        error = lost / good + (bad - caught) / bad
        if error < wrong:
            best, wrong = step, error
        lost, caught = lost + tally[step][0], caught + tally[step][1]
    return best * STEP
