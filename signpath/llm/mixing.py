"""Temperature mixing of sources under a token budget (operator 4), in DataFrame operations.

A source with share s of all tokens gets a weight in proportion to s**alpha. alpha is searched by bisection on multiples
of 1/4096 in [0, 1]: the largest at which the weights' entropy reaches the target, or, where that would repeat
a source more often than the limit, the smallest that keeps to the limit. Every step is one small aggregate over the table
of sources, which never comes to the driver; a job evaluates 15 exponents and so does four halvings.

The weights give each source a token budget. As many whole epochs as fit are taken; the rest of the budget is filled from one
more permutation: blocks of a source (by a hash of doc_id) in a pseudo-random order until the budget ends within a
block, whose documents are then taken in a second pseudo-random order up to the budget. Thus a hot
source costs a running sum over its blocks and a sort of one block, never of the source.

Defined cases: a null text has no tokens. A null source is a source of its own. A source without tokens has budget 0 and its
rows, having no part in the weights, get one copy. Equal hashes are ordered by doc_id; rows with the same doc_id share
their fate. A null doc_id is hashed as an empty string and sorts first. An empty table gives an empty result. Extra columns
of any name pass through ``realised``, as all of a row goes through the joins in one struct.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import quoted, stored

STEPS = 4096
FAN = 16
WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Params:
    """Target entropy as a share of the largest (even weights), repetition limit, budget as a multiple of all tokens."""

    entropy: float = 0.95
    max_repeats: float = 4.0
    budget: float = 1.0
    blocks: int = 256
    seed: str = "mix"
    broadcast_rows: int = 200_000


def _hash(seed: str, *parts: Column) -> Column:
    """32 bits of md5, which every engine has."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(x.cast("string"), F.lit("")) for x in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _measures(p: Params, text: str = "text") -> list[Column]:
    """tokens, block and order (the place within the block) of a row."""
    return [
        F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("mix__tokens"),
        F.pmod(_hash(p.seed, F.col("doc_id")), F.lit(p.blocks)).cast("int").alias("mix__block"),
        _hash(p.seed + "-order", F.col("doc_id")).alias("mix__order"),
    ]


def measured(docs: DataFrame, p: Params = Params(), source: str = "source") -> DataFrame:
    """doc_id, source, mix__tokens, mix__block and mix__order of every row."""
    return docs.select("doc_id", F.col(quoted(source)).alias("source"), *_measures(p))


def find_exponent(shares: DataFrame, p: Params = Params()) -> float:
    """alpha, by bisection; ``shares`` has a row (share > 0) for each source."""
    facts = shares.agg(F.count("*").alias("n"), F.min("share").alias("least")).first()
    if not facts["n"]:
        return 1.0

    def ok(alphas: list[float]) -> tuple[list[bool], list[bool]]:
        power = lambda a: F.pow("share", F.lit(a))
        sums = [x for i, a in enumerate(alphas) for x in (F.sum(power(a)).alias(f"z{i}"), F.sum(power(a) * F.log("share")).alias(f"u{i}"))]
        row = shares.agg(*sums).first()
        entropy = [math.log(row[f"z{i}"]) - a * row[f"u{i}"] / row[f"z{i}"] >= p.entropy * math.log(facts["n"]) for i, a in enumerate(alphas)]
        repeats = [p.budget * facts["least"] ** (a - 1) / row[f"z{i}"] <= max(p.max_repeats, p.budget) + 1e-9 for i, a in enumerate(alphas)]
        return entropy, repeats

    def search(which: int) -> int:
        """Entropy holds from 0 up to some step, the limit from some step up to the last; both by sections of FAN."""
        lo, hi = 0, STEPS
        first, last = ok([0.0, 1.0])[which]
        if which == 0 and last or which == 1 and not first and not last:
            return STEPS
        if which == 1 and first or which == 0 and not first:
            return 0
        while hi - lo > 1:
            at = sorted({lo + (hi - lo) * i // FAN for i in range(1, FAN)} - {lo, hi})
            held = ok([a / STEPS for a in at])[which]
            for a, good in zip(at, held, strict=True):
                if good == (which == 0):
                    lo = a
                else:
                    hi = a
                    break
        return lo if which == 0 else hi

    return max(search(0), search(1)) / STEPS


def plan(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """One row for each source and block: mix__p_source, mix__p_block, mix__p_weight, mix__p_epochs, mix__p_state (0 none, 1 whole, 2 up to the cut), cut."""
    blocks = stored(rows.groupBy(F.col("source").alias("mix__p_source"), F.col("mix__block").alias("mix__p_block")).agg(F.sum("mix__tokens").alias("tokens")), "mix-blocks")
    sources = blocks.groupBy("mix__p_source").agg(F.sum("tokens").alias("total"))
    everything = sources.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("t")).first()["t"]
    shares = stored(sources.where("total > 0").withColumn("share", F.col("total") / F.lit(float(max(everything, 1)))), "mix-shares")
    alpha = find_exponent(shares, p)
    z = shares.agg(F.sum(F.pow("share", F.lit(alpha)))).first()[0] or 1.0
    shares = shares.withColumn("mix__p_weight", F.pow("share", F.lit(alpha)) / F.lit(z)).withColumn("own", F.round(F.col("mix__p_weight") * F.lit(p.budget * everything)).cast("long"))
    shares = shares.select(F.col("mix__p_source").alias("s_"), "total", "mix__p_weight", F.expr("own div total").alias("mix__p_epochs"), F.expr("own % total").alias("rest"))
    order = Window.partitionBy("mix__p_source").orderBy(_hash(p.seed + "-blocks", F.col("mix__p_epochs"), F.col("mix__p_block")), "mix__p_block")
    placed = blocks.join(shares, F.col("mix__p_source").eqNullSafe(F.col("s_")), "left").drop("s_")
    placed = placed.withColumns({"mix__p_rank": F.row_number().over(order), "upto": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    state = F.when(F.col("rest").isNull(), 1).when(F.col("upto") <= F.col("rest"), 1).when(F.col("upto") - F.col("tokens") < F.col("rest"), 2).otherwise(0)
    placed = placed.withColumns({"mix__p_state": state, "left_": F.col("rest") - (F.col("upto") - F.col("tokens"))})
    placed = stored(placed.select("mix__p_source", "mix__p_block", "mix__p_rank", F.coalesce("mix__p_weight", F.lit(0.0)).alias("mix__p_weight"), F.coalesce("mix__p_epochs", F.lit(0)).cast("long").alias("mix__p_epochs"), "mix__p_state", "left_"), "mix-placed")
    # The cut of each source's last block: the last document that still fits.
    edge = rows.select(F.col("source").alias("r_"), "mix__block", "mix__order", _id().alias("id_"), "mix__tokens")
    ends = placed.where("mix__p_state = 2").select(F.col("mix__p_source").alias("e_"), F.col("mix__p_block").alias("b_"), "left_")
    edge = edge.join(_small(ends, p), F.col("r_").eqNullSafe(F.col("e_")) & (F.col("mix__block") == F.col("b_")))
    running = Window.partitionBy("e_").orderBy("mix__order", "id_").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.sum("mix__tokens").over(running)).where("upto <= left_")
    cuts = edge.groupBy("e_").agg(F.max(F.struct("mix__order", "id_")).alias("cut"))
    return stored(placed.drop("left_").join(cuts, F.col("mix__p_source").eqNullSafe(F.col("e_")) & (F.col("mix__p_state") == 2), "left").drop("e_"), "mix-plan")


def _id() -> Column:
    return F.coalesce("doc_id", F.lit(-(2**63)))


def _small(df: DataFrame, p: Params) -> DataFrame:
    """Broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= p.broadcast_rows else df


def copies(rows: DataFrame, planned: DataFrame, own, p: Params) -> DataFrame:
    """``rows`` joined with the struct column ``mix__plan`` (copies, weight); ``own`` gives a column of a row by name."""
    planned = planned.select(F.struct(*planned.columns).alias("mix__plan"))
    the = lambda c: F.col(f"mix__plan.{c}")
    joined = rows.join(_small(planned, p), own("source").eqNullSafe(the("mix__p_source")) & (own("mix__block") == the("mix__p_block")))
    fits = (own("mix__order") < the("cut.mix__order")) | ((own("mix__order") == the("cut.mix__order")) & (own("id") <= the("cut.id_")))
    more = (the("mix__p_state") == 1) | ((the("mix__p_state") == 2) & F.coalesce(fits, F.lit(False)))
    return joined.withColumn("mix__plan", F.struct((the("mix__p_epochs") + more.cast("long")).alias("copies"), the("mix__p_weight").alias("weight")))


def mix(docs: DataFrame, p: Params = Params(), source: str = "source") -> DataFrame:
    """doc_id, source, n_tokens, block, copies, weight of every row."""
    rows = stored(measured(docs, p, source), "mix-rows").withColumn("id", _id())
    got = copies(rows, plan(rows, p), F.col, p)
    return got.select("doc_id", F.col("source").alias(source), F.col("mix__tokens").alias("n_tokens"), F.col("mix__block").alias("block"), F.col("mix__plan.copies").alias("copies"), F.round("mix__plan.weight", 9).alias("weight"))


def realised(docs: DataFrame, p: Params = Params(), source: str = "source") -> DataFrame:
    """The rows of ``docs``, with their columns, as often as the mixture takes each."""
    planned = plan(stored(measured(docs, p, source), "mix-rows"), p)
    # All columns of a row go into one struct, so that none of them can clash with what is added.
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("mix__row"), F.struct(F.col(quoted(source)).alias("source"), *_measures(p), _id().alias("id")).alias("mix__own"))
    got = copies(rows, planned, lambda c: F.col(f"mix__own.{c}"), p).where("mix__plan.copies > 0")
    return got.select("mix__row", F.explode(F.sequence(F.lit(1).cast("long"), "mix__plan.copies"))).select("mix__row.*")


def oracle(p: Params = Params(), docs: str = "documents") -> str:
    """DuckDB SQL for ``mix``: the same lattice of exponents, searched by a recursive query one halving at a time."""
    h = lambda seed, *parts: f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'coalesce(CAST({x} AS VARCHAR), $$$$)' for x in parts)})), 1, 8) AS BIGINT)"
    z = "list_sum(list_transform(ss, lambda s: pow(s, {a})))"
    u = "list_sum(list_transform(ss, lambda s: pow(s, {a}) * ln(s)))"
    good = lambda a: f"(ln({z.format(a=a)}) - {a} * {u.format(a=a)} / {z.format(a=a)} >= {p.entropy} * ln(len(ss)))"
    fits = lambda a: f"({p.budget} * pow(list_min(ss), {a} - 1) / {z.format(a=a)} <= {max(p.max_repeats, p.budget)} + 1e-9)"
    mid = f"((lo + hi) // 2) / {float(STEPS)}"
    return f"""
    WITH RECURSIVE rows_ AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
      CAST({h(p.seed, 'doc_id')} % {p.blocks} AS INTEGER) AS block, {h(p.seed + '-order', 'doc_id')} AS o, coalesce(doc_id, -9223372036854775808) AS i FROM {docs}),
    totals AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS total FROM rows_ GROUP BY source),
    grand AS (SELECT CAST(sum(total) AS DOUBLE) AS t FROM totals),
    shares AS (SELECT source, total, total / t AS share FROM totals, grand WHERE total > 0),
    lst AS (SELECT list(share ORDER BY share) AS ss FROM shares),
    e(lo, hi, n) AS (SELECT 0, {STEPS}, 0 UNION ALL SELECT CASE WHEN {good(mid)} THEN (lo + hi) // 2 ELSE lo END, CASE WHEN {good(mid)} THEN hi ELSE (lo + hi) // 2 END, n + 1 FROM e, lst WHERE n < 12),
    r(lo, hi, n) AS (SELECT 0, {STEPS}, 0 UNION ALL SELECT CASE WHEN {fits(mid)} THEN lo ELSE (lo + hi) // 2 END, CASE WHEN {fits(mid)} THEN (lo + hi) // 2 ELSE hi END, n + 1 FROM r, lst WHERE n < 12),
    al AS (SELECT greatest(CASE WHEN {good('1.0')} THEN {STEPS} ELSE (SELECT lo FROM e WHERE n = 12) END,
      CASE WHEN {fits('0.0')} THEN 0 ELSE (SELECT hi FROM r WHERE n = 12) END) / {float(STEPS)} AS a FROM lst),
    zed AS (SELECT sum(pow(share, a)) AS z FROM shares, al),
    own AS (SELECT source, total, pow(share, a) / z AS w, CAST(round(pow(share, a) / z * {p.budget} * t) AS BIGINT) AS own FROM shares, al, zed, grand),
    blocks AS (SELECT source, block, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY source, block),
    placed AS (SELECT b.source, b.block, b.tokens, coalesce(w, 0.0) AS w, coalesce(own // total, 0) AS epochs, own % total AS rest,
      sum(b.tokens) OVER (PARTITION BY b.source ORDER BY {h(p.seed + '-blocks', 'own // total', 'b.block')}, b.block ROWS UNBOUNDED PRECEDING) AS upto
      FROM blocks b LEFT JOIN own o ON b.source IS NOT DISTINCT FROM o.source),
    done AS (SELECT r.*, w, epochs, rest, upto, tokens, sum(n_tokens) OVER (PARTITION BY r.source, r.block ORDER BY o, i ROWS UNBOUNDED PRECEDING) AS inside
      FROM rows_ r JOIN placed p ON r.source IS NOT DISTINCT FROM p.source AND r.block = p.block)
    SELECT doc_id, source, n_tokens, block, CAST(epochs + CASE WHEN rest IS NULL OR upto <= rest THEN 1 WHEN upto - tokens < rest AND inside <= rest - (upto - tokens) THEN 1 ELSE 0 END AS BIGINT) AS copies,
      round(w, 9) AS weight FROM done"""
