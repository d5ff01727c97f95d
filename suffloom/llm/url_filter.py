"""URL filter: host and path rules first, then the ratio of two character language models.

All of it is DataFrame functions. Two smoothed variable-order Markov models over
characters are counted, one of accepted and one of rejected URLs. Their alphabet
has 32 signs, so that a context of three signs and the next one make 2**20 cells:
the table of log ratios has a size that no input can grow. It reaches the scan as
a scalar subquery, and scoring needs no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suffloom.llm.common import UPPER, lower_ascii, table, written

#: (verdict, rule): a rule is a host and the path after it.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words that mark the seed of rejected URLs when a host holds them.
REJECTED_WORDS = ("casino", "bets", "poker", "pills", "viagra", "porn", "xxx", "ads-", "-ads", "track", "clickbait", "phish", "malware", "spam", "payday", "loan", "warez", "torrent")
_SIGNS = "abcdefghijklmnopqrstuvwxyz0.-/"
_ORDER = 3
_BINS = 4000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where the url is null or has no '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a longer one comes later and so stands outermost
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _cells() -> Column:
    """For each sign of host and path and for the end: its cell in the table of 32**4."""
    return F.expr(
        f"""transform(sequence(0, size(codes) - {_ORDER + 1}),
            i -> codes[i] * 32768 + codes[i + 1] * 1024 + codes[i + 2] * 32 + codes[i + 3])"""
    )


def _with_cells(df: DataFrame) -> DataFrame:
    signs = F.translate(lower_ascii(F.concat("host", "path")), "123456789", "000000000")
    df = df.withColumn("signs", signs)
    codes = F.expr(f"concat(array(0, 0, 0), transform(filter(split(signs, ''), c -> c <> ''), c -> locate(c, '{_SIGNS}')), array(0))")
    return df.withColumn("codes", codes).withColumn("cells", _cells()).drop("signs", "codes")


def _log_ratios(labelled: DataFrame, strength: float) -> DataFrame:
    """One row for each cell: log P(sign | context, accepted) - log P(sign | context, rejected).

    A level's counts are smoothed towards the next lower order with `strength` pseudo-counts,
    so that a context counts as far as it has been seen: unseen ones fall back wholly.
    """
    spark = labelled.sparkSession
    counts = (
        labelled.select("accepted", F.explode_outer("cells").alias("cell"))  # explode() would infer a filter that computes the cells anew for each sign
        .groupBy("cell")
        .agg(F.sum(F.when(F.col("accepted"), 1).otherwise(0)).cast("double").alias("a"), F.sum(F.when(F.col("accepted"), 0).otherwise(1)).cast("double").alias("r"))
    )
    counts = written(counts, "url-cells")
    level = None
    for order in range(_ORDER + 1):
        size = 32 ** (order + 1)
        own = counts.groupBy(F.col("cell").bitwiseAND(size - 1).alias("cell")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        dense = spark.range(size, numPartitions=1 if size < 1 << 15 else None).select(F.col("id").cast("int").alias("cell")).join(own, "cell", "left").fillna(0.0, ["a", "r"])
        totals = own.groupBy(F.shiftright("cell", 5).alias("context")).agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
        dense = dense.withColumn("context", F.shiftright("cell", 5)).join(totals, "context", "left").fillna(0.0, ["ta", "tr"])
        if level is None:
            dense = dense.withColumn("la", F.lit(1 / 32)).withColumn("lr", F.lit(1 / 32))
        else:
            dense = dense.withColumn("below", F.col("cell").bitwiseAND(size // 32 - 1)).join(level.select(F.col("cell").alias("below"), F.col("pa").alias("la"), F.col("pr").alias("lr")), "below")
        level = dense.select(
            "cell",
            ((F.col("a") + strength * F.col("la")) / (F.col("ta") + strength)).alias("pa"),
            ((F.col("r") + strength * F.col("lr")) / (F.col("tr") + strength)).alias("pr"),
        )
    return level.select("cell", F.log(F.col("pa") / F.col("pr")).cast("float").alias("ratio"))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    rejected_words: Sequence[str] = REJECTED_WORDS,
    strength: float = 2.0,
) -> DataFrame:
    """Judges each row's `url`; returns all rows and columns with host, path, rule, score, threshold and verdict.

    A rule's verdict stands. Where no rule fits, the URL is blocked if its score, the mean
    over its signs of the log ratio of both models, is under the threshold.

    Models: rejected URLs are those whose host holds one of the seed words `rejected_words`;
    accepted ones hold none and aren't blocked by a rule. The models also tell of hosts without
    a seed word: with one word's hosts left out of the fit, many of them are still blocked. Four fifths of the URLs (by MD5)
    are counted, the rest calibrates: the threshold is where the share of accepted URLs
    kept plus the share of rejected URLs dropped is largest (amid the gap, where scores leave one).

    Null urls, urls without '://' and empty hosts have empty parts, no rule unless one
    fits, score 0 and are allowed. An empty table gives an empty result. Without a URL of
    either kind there is no threshold, and all URLs without a rule are allowed. Columns
    of the input named like an output column are replaced. Rows may repeat.
    """
    made = ("host", "path", "rule", "score", "threshold", "verdict")
    given = [c for c in pages.columns if c not in made]
    df = pages.select(F.struct(*given).alias("row"), "url")  # so that no column of the input meets one of ours
    host, path = url_parts(F.col("url"))
    df = df.withColumn("host", host).withColumn("path", path)
    rule, ruled = matched_rule(F.col("host"), F.col("path"), rules)
    df = df.withColumn("rule", rule).withColumn("ruled", ruled)
    bad = F.lit(False)
    for w in rejected_words:
        bad = bad | F.col("host").contains(w)
    seeds = df.select("url", "host", "path", "ruled", bad.alias("bad")).where((F.col("host") != "") & (F.col("bad") | F.col("ruled").isNull() | (F.col("ruled") == "allow")))
    seeds = _with_cells(seeds).select("url", (~F.col("bad")).alias("accepted"), "cells")
    held_out = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 4), 16, 10).cast("int") % 5 == 0
    ratios = _log_ratios(seeds.where(~held_out), strength)
    model = written(ratios.groupBy().agg(F.sort_array(F.collect_list(F.struct("cell", "ratio"))).alias("m")).select(F.col("m.ratio").alias("m")), "url-model")

    def scored(x: DataFrame) -> DataFrame:
        x = x.withColumn("model", model.scalar())
        return x.withColumn("score", F.expr("aggregate(cells, 0D, (s, c) -> s + model[c]) / size(cells)")).drop("model", "cells")

    bins = scored(seeds.where(held_out)).select("accepted", F.least(F.lit(_BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + 4) / 8 * _BINS))).cast("int").alias("bin"))
    bins = bins.groupBy("bin").agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r"))
    whole = bins.groupBy().agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"), F.sort_array(F.collect_list(F.struct("bin", "a", "r"))).alias("bins"))
    # Kept: accepted in this bin or above; dropped: rejected in bins below it.
    best = F.expr(
        """aggregate(bins, named_struct('a', 0L, 'r', 0L, 'best', -1D, 'lo', 0, 'hi', 0, 'open', false),
             (s, x) -> if((ta - s.a - x.a) / ta + (s.r + x.r) / tr > s.best,
                named_struct('a', s.a + x.a, 'r', s.r + x.r, 'best', (ta - s.a - x.a) / ta + (s.r + x.r) / tr, 'lo', x.bin + 1, 'hi', x.bin + 1, 'open', true),
                named_struct('a', s.a + x.a, 'r', s.r + x.r, 'best', s.best, 'lo', s.lo, 'hi', if(s.open, x.bin, s.hi), 'open', false)),
             s -> (s.lo + s.hi) / 2)"""
    )
    threshold = whole.select(F.when((F.col("ta") > 0) & (F.col("tr") > 0), best * (8 / _BINS) - 4).alias("threshold"))
    out = scored(_with_cells(df)).withColumn("threshold", threshold.scalar())
    judged = F.when(F.col("score") < F.col("threshold"), "block").otherwise("allow")
    out = out.withColumn("verdict", F.coalesce("ruled", judged))
    return out.select(*(F.col("row").getField(c).alias(c) for c in given), *made)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _level(order: int, strength: float) -> str:
    """One order's smoothed probabilities of both models, for each cell."""
    size = 32 ** (order + 1)
    below = f"JOIN p{order - 1} b ON b.cell = g.cell & {size // 32 - 1}" if order else ""
    pa, pr = ("b.pa", "b.pr") if order else ("1 / 32", "1 / 32")
    return f"""
t{order} AS (SELECT cell & {size - 1} AS cell, sum(a) AS a, sum(r) AS r FROM counts GROUP BY ALL),
c{order} AS (SELECT cell >> 5 AS context, sum(a) AS ta, sum(r) AS tr FROM t{order} GROUP BY ALL),
p{order} AS (SELECT g.cell, (coalesce(a, 0) + {strength} * {pa}) / (coalesce(ta, 0) + {strength}) AS pa, (coalesce(r, 0) + {strength} * {pr}) / (coalesce(tr, 0) + {strength}) AS pr
    FROM (SELECT unnest(range({size})) AS cell) g {below} LEFT JOIN t{order} t ON t.cell = g.cell LEFT JOIN c{order} c ON c.context = g.cell >> 5),"""


def _rule_sql(column: int) -> str:
    cases = []
    for rule in sorted(RULES, key=lambda r: (len(r[1]), r[1]), reverse=True):
        host, slash, path = rule[1].partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}') THEN '{rule[column]}'")
    return f"CASE {' '.join(cases)} END"


SQL = f"""WITH urls AS (SELECT row_number() OVER () AS row_id, page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT row_id, page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
ruled AS (SELECT *, {_rule_sql(1)} AS rule, {_rule_sql(0)} AS says, regexp_matches(host, '{"|".join(REJECTED_WORDS)}') AS bad,
    list_concat([0, 0, 0], [instr('{_SIGNS}', c) for c in string_split(translate(host || path, '{UPPER}123456789', '{UPPER.lower()}000000000'), '') if c <> ''], [0]) AS codes FROM parts),
cells AS (SELECT row_id, unnest([codes[i] * 32768 + codes[i + 1] * 1024 + codes[i + 2] * 32 + codes[i + 3] for i in range(1, len(codes) - 2)]) AS cell FROM ruled),
seeds AS (SELECT row_id, NOT bad AS accepted, CAST('0x' || substr(md5(url), 1, 4) AS INT) % 5 = 0 AS held FROM ruled WHERE host <> '' AND (bad OR says IS NULL OR says = 'allow')),
counts AS (SELECT cell, CAST(sum(accepted::INT) AS DOUBLE) AS a, CAST(sum((NOT accepted)::INT) AS DOUBLE) AS r FROM seeds JOIN cells USING (row_id) WHERE NOT held GROUP BY ALL),
{"".join(_level(k, 2.0) for k in range(_ORDER + 1))}
scores AS (SELECT row_id, avg(CAST(CAST(ln(pa / pr) AS FLOAT) AS DOUBLE)) AS score FROM cells JOIN p{_ORDER} USING (cell) GROUP BY row_id),
bins AS (SELECT CAST(least({_BINS - 1}, greatest(0, floor((score + 4) / 8 * {_BINS}))) AS INT) AS bin, CAST(sum(accepted::INT) AS BIGINT) AS a, CAST(sum((NOT accepted)::INT) AS BIGINT) AS r
    FROM seeds JOIN scores USING (row_id) WHERE held GROUP BY ALL),
worth AS (SELECT bin, (ta - ca) / ta + cr / tr AS worth, lead(bin) OVER (ORDER BY bin) AS following FROM
    (SELECT bin, sum(a) OVER () AS ta, sum(r) OVER () AS tr, sum(a) OVER (ORDER BY bin) AS ca, sum(r) OVER (ORDER BY bin) AS cr FROM bins) WHERE ta > 0 AND tr > 0),
cut AS (SELECT (bin + 1 + coalesce(following, bin + 1)) / 2 * 8 / {_BINS} - 4 AS threshold FROM worth WHERE worth = (SELECT max(worth) FROM worth) ORDER BY bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN score < (SELECT threshold FROM cut) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled JOIN scores USING (row_id)"""
