"""URL filters (8), with DataFrame functions only: rules, else a language-model ratio.

Rules (action, host, path) fit a host and its subdomains where the path starts with the
rule's; the longest wins. URLs with a rule are the labelled ones: two character models
are trained on those that rules accept and reject. The models are of variable order:
each order of context is smoothed with the next shorter one, down to the uniform
distribution, so contexts that were never seen fall back by themselves. The score is
the difference of log-likelihoods divided by the number of characters; the threshold is
calibrated on the labelled URLs, between the two classes' means by their spreads.

Distinct host and path pairs are summed before the first shuffle, so a URL that a third
of all rows have counts once; where rows get their verdict, the rows of such a URL are dealt
over several tasks. The table of grams is bounded by the alphabet (38 symbols)
to the power of the order, whatever the input; it is broadcast only below a counted size.

Defined results: null or no `://`: host and path are empty, no rule fits, and the model
judges the empty string. If rules accept or reject no URL at all there is nothing to
learn from, and URLs without a rule are allowed with score 0; a score of exactly the
threshold is allowed. A URL of any length is one row, all of whose grams count. Repeated rows
stay. Columns of the input may have any names (see common.renamed); an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import renamed, small, told_by_size, written

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Characters of a gram: one, and up to ORDER - 1 of context.
ORDER = 4
#: Symbols after folding: a-z, 0, ./_-, one for all others, start and end.
SYMBOLS = 26 + 1 + 4 + 1 + 2
#: Weight of the shorter context's distribution, in characters.
PRIOR = 2.0
#: Rows of one URL that get its verdict in one task.
HOT_ROWS = 50_000


def host(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), upper, upper.lower())


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like `net/`, and its action; null where none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(action)
    return name, action


def _grams(urls: DataFrame) -> DataFrame:
    """urls with a row for each gram of `^^^` + folded host and path + `$`."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(F.concat("host", "path")), "[0-9]", "0"), "[^a-z0./_-]", "~")
    padded = F.concat(F.lit("^" * (ORDER - 1)), folded, F.lit("$"))
    # A look ahead at each place: one pass, where substrings by number would count characters from the start each time.
    return urls.withColumn("padded", padded).withColumn("gram", F.explode(F.regexp_extract_all("padded", F.lit(f"(?=(.{{{ORDER}}}))"), F.lit(1)))).drop("padded")


def ratios(urls: DataFrame) -> DataFrame:
    """(host, path, action, n) to (gram, ratio): log of accepted over rejected, for every gram that occurs."""
    of = lambda what: F.sum(F.when(F.col("action") == what, F.col("n")).otherwise(0)).cast("double")
    counts = _grams(urls).groupBy("gram").agg(of("allow").alias("allow"), of("block").alias("block"))
    last = counts.groupBy(F.substring("gram", ORDER, 1).alias("last")).agg(F.sum("allow").alias("allow_1"), F.sum("block").alias("block_1"))
    every = Window.partitionBy(F.lit(0))
    uniform = F.lit(1.0 / SYMBOLS)
    last = last.select("last", *[((F.col(f"{c}_1") + PRIOR * uniform) / (F.sum(f"{c}_1").over(every) + PRIOR)).alias(f"{c}_p") for c in ("allow", "block")])
    # At most SYMBOLS rows: one for each last character.
    out = counts.withColumn("last", F.substring("gram", ORDER, 1)).join(F.broadcast(last), "last")
    for order in range(2, ORDER + 1):
        at = ORDER - order + 1
        seen = Window.partitionBy(F.substring("gram", at, order))
        context = Window.partitionBy(F.substring("gram", at, order - 1))
        for c in ("allow", "block"):
            out = out.withColumn(f"{c}_p", (F.sum(c).over(seen) + PRIOR * F.col(f"{c}_p")) / (F.sum(c).over(context) + PRIOR))
    return out.select("gram", (F.log("allow_p") - F.log("block_p")).alias("ratio"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """pages with five more columns: host, path, rule, verdict (allow or block) and score."""
    names = renamed(pages, "host", "path", "rule", "verdict", "score")
    h, p, r, v, s = names
    parts = pages.select(host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    name, action = rule(F.col("host"), F.col("path"), rules)
    urls = written(parts.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("action", action))
    table = written(ratios(urls))
    scored = _grams(urls).join(small(table), "gram").groupBy("host", "path", "action").agg(F.avg("ratio").alias("score"), F.first("n").alias("n"))
    scored = written(scored)
    means = {x["action"]: (x["m"], x["d"]) for x in scored.filter("action IS NOT NULL").groupBy("action").agg(F.avg("score").alias("m"), F.coalesce(F.stddev("score"), F.lit(0.0)).alias("d")).collect()}
    if {"allow", "block"} <= means.keys():
        (ma, da), (mb, db) = means["allow"], means["block"]
        threshold, score = (ma * (db + 1e-9) + mb * (da + 1e-9)) / (da + db + 2e-9), F.col("score")
    else:
        threshold, score = 0.0, F.lit(0.0)
    n, x, y = renamed(pages.withColumns({k: F.lit(0) for k in names}), "n_rows", "parts", "part")
    verdicts = scored.select(F.col("host").alias(h), F.col("path").alias(p), score.alias(s), F.col("n").alias(n))
    name, action = rule(F.col(h), F.col(p), rules)
    found = told_by_size(pages.withColumns({h: host(F.col(url_col)), p: path(F.col(url_col))}), verdicts, [h, p], n, HOT_ROWS, (x, y))
    told = F.when(F.col(s) >= F.lit(threshold), F.lit("allow")).otherwise(F.lit("block"))
    return found.withColumns({r: name, v: F.coalesce(action, told)}).select(*pages.columns, *names)


def keep(pages: DataFrame, **how) -> DataFrame:
    """Only the pages whose verdict is allow. Columns as in pages."""
    verdict = renamed(pages, "host", "path", "rule", "verdict", "score")[3]
    return judge(pages, **how).filter(F.col(verdict) == "allow").select(*pages.columns)
