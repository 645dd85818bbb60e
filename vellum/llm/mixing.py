"""Mixing sources to target weights by iterative proportional fitting (operator 5); DataFrame functions only.

Token counts of the cells (source, language, topic) are raked to target marginals: each round scales the cells so that
the sums by source, then by language, then by topic meet their targets. No cell gets more than its tokens: in each step
the full cells are set apart and the others are scaled to what is left of the target, until the largest relative error
of a marginal is below `tolerance`. A document is kept with probability (raked tokens / tokens of its cell) by a hash of its
id, so the sample is the same in every run and its expected tokens are the targets.

Targets: given tables, which must cover all values and be feasible (else an error); or for each dimension min(tokens,
factor * tokens ** power), with the factor that makes the sum `share` of all tokens. Should these defaults not be
feasible together, the closest state after `rounds` rounds stays, and mix_error says how far off it is.

A topic is the label whose markers a text holds most often (the first of equal ones), else 'prose'.

The cells are summed before anything else and are what the rounds work on: a row for each combination that occurs.
A round is three sums over windows of cells, without joins.

Edge cases: null marginals are the value ''; null and empty texts have no tokens and are kept with their cell's
probability (1 where a cell has no tokens); null ids hash as ''; rows with equal ids share their fate; very long texts
count whole; an empty table gives an empty result; other columns of df are carried along, but for those named mix_topic,
mix_tokens, mix_probability and mix_error, which are replaced.
"""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from .textops import stored

DIMENSIONS = ("source", "lang", "topic")
ADDED = ("mix_topic", "mix_tokens", "mix_probability", "mix_error")
BLOCK = 6
SMALL = 50_000
TOPICS = {"table": (" | ",), "legal": ("icense", "ights reserved"), "contact": ("@", "://"), "noise": ("&&&", "###", "$$$"), "abuse": ("idiot", "scum")}


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_counts(text, topics=TOPICS):
    """How often the markers of each topic stand in text."""
    times = lambda m: F.floor((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(m), F.lit("")))) / len(m.encode()))
    return F.array(*[sum((times(m) for m in markers), F.lit(0)) for markers in topics.values()])


def scaled(cells: str, dims, rounds: int = 1) -> str:
    """SQL of rounds of scaling `fitted` (not cut at the bound), so that the sums of least(tokens, fitted) by each dimension
    meet target_<dimension>: full cells are set apart, the others share what is left."""
    kept = ", ".join([*dims, "tokens", *[f"target_{d}" for d in dims]])
    for d in list(dims) * rounds:
        sums = f"SELECT {kept}, fitted, sum(CASE WHEN fitted >= tokens THEN tokens ELSE 0 END) OVER (PARTITION BY {d}) AS a, sum(CASE WHEN fitted >= tokens THEN 0 ELSE fitted END) OVER (PARTITION BY {d}) AS b FROM {cells}"
        cells = f"(SELECT {kept}, fitted * CASE WHEN b > 0 AND target_{d} > a THEN (target_{d} - a) / b WHEN target_{d} < a THEN target_{d} / (a + b) ELSE 1 END AS fitted FROM ({sums}))"
    return cells


def with_errors(cells: str, dims) -> str:
    """SQL that adds the largest relative error of the marginals that a cell belongs to."""
    now = lambda d: f"sum(least(fitted, tokens)) OVER (PARTITION BY {d})"
    of = [f"CASE WHEN target_{d} > 0 THEN abs({now(d)} - target_{d}) / target_{d} ELSE {now(d)} END" for d in dims]
    return f"SELECT *, greatest(0, {', '.join(of)}) AS error FROM {cells}"


def rake(cells, targets: dict, start: float = 1.0, rounds: int = 72, tolerance: float = 1e-10, dims=DIMENSIONS, must: bool = True):
    """(cells with `fitted`, at most tokens, and the largest relative error). cells: dims, tokens. targets: for each dim a
    table (dim, target). must: an error where targets lack a value or can't be met within `rounds`."""
    now = cells.withColumns({"tokens": F.col("tokens").cast("double"), "fitted": F.col("tokens") * F.lit(float(start))})
    for d in dims:
        now = now.join(targets[d].select(d, F.col("target").cast("double").alias(f"target_{d}")), d, "full_outer")
    now = stored(now, "cells")
    if bad := now.filter(" or ".join([f"target_{d} is null or target_{d} < 0 or isnan(target_{d})" for d in dims] + [f"(tokens is null and target_{d} > 0)" for d in dims])).first():
        raise ValueError(f"targets don't fit the values of the cells: {bad.asDict()}")
    now, error = now.filter("tokens is not null"), None
    # a few cells in one partition serve all windows without a shuffle; more are shuffled for each
    near = (lambda x: x.coalesce(1)) if now.count() <= SMALL else (lambda x: x)
    for _ in range(0, rounds, BLOCK):
        now = stored(now.sparkSession.sql(with_errors(scaled("{now}", dims, BLOCK), dims), now=near(now)), "cells")
        error = now.agg(F.max("error")).first()[0] or 0.0
        now = now.drop("error")
        if error < tolerance:
            break
    if must and error is not None and not error < max(tolerance, 1e-6):
        raise ValueError(f"targets can't be met together; the largest relative error is {error:.3g}")
    return now.withColumn("fitted", F.least("fitted", "tokens")), error or 0.0


def tempered(cells, power: float, aim: float, dims=DIMENSIONS) -> dict:
    """For each dim a table of target tokens of its values: min(tokens, factor * tokens ** power) with sum `aim`."""
    sums = [cells.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value")).agg(F.sum("tokens").cast("double").alias("m")) for d in dims]
    own = functools.reduce(lambda a, b: a.union(b), sums).withColumn("w", F.when(F.col("m") > 0, F.pow("m", F.lit(power))).otherwise(0.0))
    rising = Window.partitionBy("dim").orderBy("m", "value")
    below = F.coalesce(F.sum("m").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    # with the smaller values given whole, what is left over what weighs on it; the largest of these is the factor
    factor = F.max(F.when(F.col("m") > 0, (F.lit(aim) - below) / above)).over(Window.partitionBy("dim"))
    own = stored(own.withColumn("factor", factor).select("dim", "value", F.coalesce(F.least("m", F.col("factor") * F.col("w")), F.lit(0.0)).alias("target")), "targets")
    return {d: own.filter(F.col("dim") == d).select(F.col("value").alias(d), "target") for d in dims}


def mix(df, share: float = 0.5, power: float = 0.7, rounds: int = 72, tolerance: float = 1e-10, targets: dict | None = None, topic=None, topics=TOPICS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text"):
    """The kept rows of df, with mix_topic, mix_tokens, mix_probability and mix_error. topic: a Column instead of `topics`."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ADDED]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    counts = F.array(F.lit(0)) if topic is not None else topic_counts(text, topics)
    keyed = df.select(F.struct(*kept).alias("_row"), *[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(f"_{d}") for d in DIMENSIONS[:2]], counts.alias("_counts"), *([] if topic is None else [topic.alias("_given")]), n_words(text).alias("_tokens"))
    most = F.array_max("_counts")
    named = F.coalesce(F.col("_given").cast("string"), F.lit("")) if topic is not None else F.when(most > 0, F.element_at(F.lit(list(topics)), F.array_position("_counts", most).cast("int"))).otherwise("prose")
    keyed = keyed.withColumn("_topic", named)
    cells = stored(keyed.groupBy(*[F.col(f"_{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("_tokens").alias("tokens")), "cells")
    aim = share * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    wanted = tempered(cells, power, aim) | (targets or {})
    fitted, error = rake(cells, wanted, share, rounds, tolerance, must=bool(targets))
    chances = fitted.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(1.0).alias("_probability"))
    key = F.coalesce(F.col("_row")[id_col].cast("string"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    drawn = keyed.drop("_counts").join(chances, [f"_{d}" for d in DIMENSIONS]).filter(draw < F.col("_probability"))
    return drawn.select(*[F.col("_row")[c].alias(c) for c in df.columns if c not in ADDED], F.col("_topic").alias("mix_topic"), F.col("_tokens").alias("mix_tokens"), F.col("_probability").alias("mix_probability"), F.lit(error).alias("mix_error"))


def oracle(rounds: int = 72, share: float = 0.5, power: float = 0.7, seed: int = 11, topics=TOPICS) -> str:
    """The same in SQL, on the table documents, with all rounds made."""
    quoted = lambda m: "'" + m.replace("'", "''") + "'"
    times = lambda m: f"(strlen(text) - strlen(replace(text, {quoted(m)}, ''))) // {len(m.encode())}"
    counts = ", ".join(" + ".join(map(times, markers)) for markers in topics.values())
    labels = ", ".join(map(quoted, topics))
    sql = [
        f"d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, [{counts}] AS a, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents))",
        f"e AS (SELECT doc_id, source, lang, n, CASE WHEN list_max(a) > 0 THEN [{labels}][list_position(a, list_max(a))] ELSE 'prose' END AS topic FROM d)",
        "c AS (SELECT source, lang, topic, sum(n)::DOUBLE AS tokens FROM e GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        sql += [
            f"m_{d} AS (SELECT {d}, sum(tokens) AS m, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {power}) ELSE 0 END AS w FROM c GROUP BY 1)",
            f"s_{d} AS (SELECT *, coalesce(sum(m) OVER (ORDER BY m, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(w) OVER (ORDER BY m, {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM m_{d} WHERE m > 0)",
            f"f_{d} AS (SELECT max(({share} * (SELECT sum(tokens) FROM c) - below) / above) AS factor FROM s_{d})",
            f"t_{d} AS (SELECT {d}, least(m, factor * w) AS target_{d} FROM m_{d}, f_{d})",
        ]
    sql.append(f"r AS (SELECT 0 AS k, source, lang, topic, tokens, target_source, target_lang, target_topic, tokens * {share}::DOUBLE AS fitted FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic) UNION ALL SELECT * FROM (WITH s AS (SELECT * FROM r WHERE k < {rounds}) SELECT (SELECT max(k) + 1 FROM s) AS k, * FROM {scaled('s', DIMENSIONS)}))")
    sql.append(f"p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(fitted, tokens) / tokens ELSE 1.0 END AS probability FROM r WHERE k = {rounds})")
    return f"WITH RECURSIVE {', '.join(sql)} SELECT doc_id, source, lang, topic, n::BIGINT AS n_tokens, round(probability, 8) AS probability FROM e JOIN p USING (source, lang, topic) WHERE ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < probability"
