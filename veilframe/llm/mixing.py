"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token shares are raked: a factor per source makes the totals per source
meet their targets, then one per language, then one per topic, for a number of rounds. A cell's rate is the product of its three factors: by how
much its tokens should weigh more or less than they do. Documents are sampled by a hash of their id, with probabilities in proportion to
the rate of their cell.

Only DataFrame expressions are used. Tokens are summed per cell before anything is shuffled, the rounds work on cells alone, and documents meet their
cell's rate in a join on the three dimensions, whose small side adaptive execution broadcasts if it measures as small.

Targets: shares of tokens per value of a dimension, made to sum to one over the values present; values not named get none. Where no targets
are given, the present shares are flattened by the exponent ``flatten``.

Defined results: a null value of a dimension is a value of its own (named ``None`` in targets). A null text counts as empty, and each text as one token
at least. Rows that repeat an id share their fate, and so do rows without one. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import fresh, saved, text_or_empty

DIMENSIONS = ["source", "lang", "topic"]
#: A topic from the form of a text: the first that fits, else REST.
TOPICS = {"table": "{t} LIKE '% | %'", "short": "length({t}) < 400", "long": "length({t}) >= 4000"}
REST = "prose"
EMPTY_TEXT = "coalesce(text, '')"
SEED = 7
Targets = dict[str, dict[str | None, float]]


def topic_of(text_column: str = "text") -> Column:
    cases = " ".join(f"WHEN {test} THEN '{name}'" for name, test in TOPICS.items())
    return F.expr(f"CASE {cases} ELSE '{REST}' END".format(t=f"coalesce(`{text_column}`, '')"))


def tokens_of(text_column: str = "text") -> Column:
    """Runs without white space, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(text_or_empty(text_column), F.lit(r"[^ \t-\r]+"))).cast("long")


def uniform(id_column: str, seed: int = SEED) -> Column:
    """A number in [0, 1) from the id, whatever the partitions: seven hex digits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") / (1 << 28)


def _named(value: Column) -> Column:
    """Values as text, null as a value of its own."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def _goals(cells: DataFrame, dimension: str, given: dict[str | None, float] | None, flatten: float) -> DataFrame:
    """Target share of each value that is present."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("t"))
    if given is None:
        raw = F.pow("t", F.lit(flatten))
    elif given:
        pairs = [x for k, v in given.items() for x in (F.lit("null" if k is None else f"={k}"), F.lit(float(v)))]
        raw = F.coalesce(F.create_map(*pairs)[F.col(dimension)], F.lit(0.0))
    else:
        raw = F.lit(0.0)
    goals, (_, whole) = saved(sums.select(dimension, raw.alias("raw")), "goals", F.sum("raw"))
    return goals.select(dimension, (F.col("raw") / (whole or 1.0)).alias(f"{dimension}_share"))


def rake(cells: DataFrame, targets: Targets | None = None, flatten: float = 0.7, rounds: int = 6) -> DataFrame:
    """``cells`` (dimensions and ``tokens``) with ``rate``: calibrated token share over present token share."""
    cells, (_, total) = saved(cells, "cells", F.sum("tokens"))
    total = float(total or 1)
    goals = {d: _goals(cells, d, (targets or {}).get(d), flatten) for d in DIMENSIONS}
    factors = {d: cells.select(d).distinct().withColumn(f"{d}_factor", F.lit(1.0)) for d in DIMENSIONS}

    def rated(dimensions: list[str]) -> DataFrame:
        rows, rate = cells, F.lit(1.0)
        for d in dimensions:
            rows, rate = rows.join(factors[d], d), rate * F.col(f"{d}_factor")
        return rows.withColumn("rate", rate)

    for _ in range(rounds):
        for d in DIMENSIONS:
            # What this dimension's values would have without a factor of their own.
            others = rated([o for o in DIMENSIONS if o != d])
            have = others.groupBy(d).agg(F.sum(F.col("tokens") / total * F.col("rate")).alias("have"))
            factor = F.when(F.col("have") > 0, F.col(f"{d}_share") / F.col("have")).otherwise(0.0)
            factors[d], _ = saved(goals[d].join(have, d).select(d, factor.alias(f"{d}_factor")), "factors")
    return saved(rated(DIMENSIONS).select(*DIMENSIONS, "tokens", "rate"), "rates")[0]


def held_scale(rates: DataFrame, fraction: float) -> float:
    """The scale at which rates, capped at one, keep ``fraction`` of all tokens, or all that have a rate above zero if those are fewer.

    What capped cells can't give goes to the others; each round caps more cells, until none is added.
    """
    tokens, mass = F.col("tokens").cast("double"), F.col("tokens") * F.col("rate")
    scale, capped = 0.0, -1
    while True:
        full = F.col("rate") * scale >= 1
        n, total, given, rest = rates.agg(
            F.count_if(full), F.sum(tokens), F.sum(F.when(full, tokens).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(mass))
        ).first()
        if n == capped or not rest:
            return scale
        scale, capped = max(scale, (fraction * total - given) / rest), n


def mix(
    docs: DataFrame, targets: Targets | None = None, fraction: float = 0.5, flatten: float = 0.7, rounds: int = 6, id_column: str = "doc_id",
    text_column: str = "text", source_column: str = "source", lang_column: str = "lang", topic: Column | None = None,
    hold: bool = False,
) -> DataFrame:
    """``docs`` with a struct ``mixing``: topic, tokens, rate, probability, kept.

    ``fraction``: the share of all tokens to keep. It is lowered until the largest probability is one, so that none is clipped
    and the sample meets the targets; then the cell with the largest rate, however small, sets how much of everything is kept. ``hold``: keep the
    fraction instead, and cap single probabilities at one; capped cells then stay below their targets.
    """
    own = topic if topic is not None else topic_of(text_column)
    keys = {"source": _named(F.col(source_column)), "lang": _named(F.col(lang_column)), "topic": _named(own)}
    cells = docs.select(*[k.alias(d) for d, k in keys.items()], tokens_of(text_column).alias("tokens"))
    rates = rake(cells.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), targets, flatten, rounds)
    if hold:
        scale = held_scale(rates, fraction)
    else:
        most = rates.agg(F.max("rate")).first()[0] or 0.0
        scale = min(fraction, 1.0 / most) if most > 0 else 0.0
    names = {d: fresh(docs, f"mixing_{d}") for d in DIMENSIONS}
    small = rates.select(*[F.col(d).alias(names[d]) for d in DIMENSIONS], F.col("rate").alias(fresh(docs, "mixing_rate")))
    joined = docs.withColumns({names[d]: k for d, k in keys.items()}).join(small, list(names.values()))
    probability = F.col(small.columns[-1]) * scale
    if hold:
        probability = F.least(F.lit(1.0), probability)
    struct = F.struct(
        own.alias("topic"),
        tokens_of(text_column).alias("tokens"),
        F.col(small.columns[-1]).alias("rate"),
        probability.alias("probability"),
        (uniform(id_column) < probability).alias("kept"),
    )
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "mixing"], struct.alias("mixing"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs`` with the columns they had. Options as for ``mix``."""
    return mix(docs, **options).where("mixing.kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle_sql(fraction: float = 0.5, flatten: float = 0.7, rounds: int = 6) -> str:
    """The same with ``hold`` in SQL, the rounds written out.

    With any leading cells by rate capped, a scale keeps at most what it keeps with the right ones capped; so the scale wanted is the largest of them.
    """
    cases = " ".join(f"WHEN {test.format(t=EMPTY_TEXT)} THEN '{name}'" for name, test in TOPICS.items())
    digits = " + ".join(f"(instr('0123456789abcdef', substr(h, {i + 1}, 1)) - 1) * {16 ** (6 - i)}" for i in range(7))
    parts = [
        f"""named AS (SELECT doc_id, source, lang, CASE {cases} ELSE '{REST}' END AS topic,
                greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))) AS tokens,
                md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents)""",
        "cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM named GROUP BY ALL)",
        "whole AS (SELECT sum(tokens) AS total FROM cells)",
    ]
    for d in DIMENSIONS:
        parts.append(
            f"""goal_{d} AS (SELECT {d}, pow(sum(tokens), {flatten}) / (SELECT sum(p) FROM
                (SELECT pow(sum(tokens), {flatten}) AS p FROM cells GROUP BY {d})) AS share FROM cells GROUP BY {d})"""
        )
        parts.append(f"{d}_0 AS (SELECT DISTINCT {d}, 1.0::DOUBLE AS factor FROM cells)")
    last = dict.fromkeys(DIMENSIONS, 0)
    for _ in range(rounds):
        for d in DIMENSIONS:
            a, b = (o for o in DIMENSIONS if o != d)
            parts.append(
                f"""{d}_{last[d] + 1} AS MATERIALIZED (SELECT c.{d}, any_value(g.share) / sum(c.tokens / w.total * x.factor * y.factor) AS factor
                FROM cells c, whole w, {a}_{last[a]} x, {b}_{last[b]} y, goal_{d} g
                WHERE c.{a} IS NOT DISTINCT FROM x.{a} AND c.{b} IS NOT DISTINCT FROM y.{b} AND c.{d} IS NOT DISTINCT FROM g.{d} GROUP BY c.{d})"""
            )
            last[d] += 1
    same = " AND ".join(f"c.{d} IS NOT DISTINCT FROM f_{d}.{d}" for d in DIMENSIONS)
    tables = ", ".join(f"{d}_{last[d]} f_{d}" for d in DIMENSIONS)
    parts.append(
        f"rates AS (SELECT c.source, c.lang, c.topic, c.tokens, {' * '.join(f'f_{d}.factor' for d in DIMENSIONS)} AS rate FROM cells c, {tables} WHERE {same})"
    )
    before = "OVER (ORDER BY rate DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    onward = "OVER (ORDER BY rate DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    parts.append(f"capped AS (SELECT coalesce(sum(tokens) {before}, 0) AS given, sum(tokens * rate) {onward} AS rest FROM rates)")
    parts.append(f"scale AS (SELECT max(({fraction} * total - given) / rest) AS scale FROM capped, whole WHERE rest > 0)")
    parts.append("scaled AS (SELECT *, least(1.0, rate * (SELECT scale FROM scale)) AS p FROM rates)")
    on = " AND ".join(f"n.{d} IS NOT DISTINCT FROM s.{d}" for d in DIMENSIONS)
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, n.topic, CAST(n.tokens AS BIGINT) AS n_tokens, round(s.rate, 6) AS rate, round(s.p, 6) AS probability,
               ({digits}) / 268435456.0 < s.p AS kept
        FROM named n JOIN scaled s ON {on}"""
