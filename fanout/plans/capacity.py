"""Ceiling and headroom queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fanout.operators import ceilings
from fanout.plans import inputs
from fanout.plans.oracle import ACHIEVED, CONSUME, INGEST, digest, with_views
from fanout.sources.tables import table


def ceiling_gate(spark, sf):
    gated = ceilings.consume_gate(inputs.consume_ceilings(spark, sf))
    return gated.select("env", "usable", F.array_join("refusals", "; ").alias("refusals"))


def ceiling_gate_ingest(spark, sf):
    return ceilings.ingest_gate(inputs.ingest_ceilings(spark, sf)).select("env", "format", "usable", "refusal")


def headroom_shares(spark, sf):
    return ceilings.headroom(
        inputs.achieved(spark, sf),
        ceilings.consume_gate(inputs.consume_ceilings(spark, sf)),
        ceilings.ingest_gate(inputs.ingest_ceilings(spark, sf)),
    )


def headroom_verdict(spark, sf):
    return ceilings.headroom_verdict(headroom_shares(spark, sf)).select(
        "arm", "binding_share", "binding", "infra_bound", "proven"
    )


def sweep_plateau(spark, sf):
    return ceilings.sweep_plateau(inputs.ladders(spark, sf))


def ceiling_merge(spark, sf):
    """Ingest ceilings keyed by environment and format, replaced where measured from outside."""
    old = inputs.ingest_ceilings(spark, sf).select(
        F.concat_ws("/", "env", "format").alias("format"), "rows_per_s", F.lit("old").alias("source")
    )
    new = inputs.ingest_ceilings(spark, sf).filter("client = 'outside'").select(
        F.concat_ws("/", "env", "format").alias("format"), (F.col("rows_per_s") + 1).alias("rows_per_s"), F.lit("new").alias("source")
    )
    return ceilings.merge_ceilings(old, new)


def foreign_ceilings(spark, sf):
    return ceilings.foreign_ceilings(inputs.ingest_ceilings(spark, sf)).select("env", "format", "infra_digest")


def infra_digest(spark, sf):
    s = table(spark, sf, "supplier")
    named = ceilings.infra_digest(
        F.lit("broker"), (F.col("s_suppkey") % 3 + 1).cast("string"), F.lit("8g"), F.lit("16"), F.lit("16g"), F.lit("8")
    )
    return s.select("s_suppkey", named.alias("digest"))


def burst_rates(spark, sf):
    return ceilings.burst_rates(inputs.bursts(spark, sf)).drop("elapsed_us")


QUERIES = {
    "ceiling_gate": ceiling_gate,
    "ceiling_gate_ingest": ceiling_gate_ingest,
    "headroom_shares": headroom_shares,
    "headroom_verdict": headroom_verdict,
    "sweep_plateau": sweep_plateau,
    "ceiling_merge": ceiling_merge,
    "foreign_ceilings": foreign_ceilings,
    "infra_digest": infra_digest,
    "burst_rates": burst_rates,
}

ORACLES = {
    "ceiling_gate": with_views(CONSUME)
    + "SELECT env, len(refusals) = 0 usable, array_to_string(refusals, '; ') refusals FROM consume_gate",
    "ceiling_gate_ingest": with_views(INGEST) + "SELECT env, format, refusal IS NULL usable, refusal FROM ingest_gate",
    "headroom_shares": with_views(CONSUME, INGEST, ACHIEVED) + "SELECT * EXCLUDE sst FROM shares",
    "headroom_verdict": with_views(CONSUME, INGEST, ACHIEVED)
    + """SELECT arm, CASE WHEN consume_share IS NULL THEN ingest_share WHEN ingest_share IS NULL THEN consume_share
        ELSE greatest(consume_share, ingest_share) END binding_share,
      CASE WHEN ingest_share >= coalesce(consume_share, 0) THEN 'ingest' WHEN consume_share IS NOT NULL THEN 'consume' END binding,
      coalesce(greatest(coalesce(consume_share, ingest_share), coalesce(ingest_share, consume_share)) > 0.7, false) infra_bound,
      unproven_ingest IS NULL AND unproven_consume IS NULL AND refusals = 0 proven FROM shares""",
    "sweep_plateau": with_views(
        """ladder AS (SELECT format, c, max(r) r, row_number() OVER (PARTITION BY format ORDER BY c) rn FROM (
          SELECT 'fmt-' || (l_suppkey % 7) format, CAST(pow(2, l_linenumber - 1) AS BIGINT) c,
            CAST(least(l_linenumber, l_suppkey % 7 + 1) * 100000 + CASE WHEN l_linenumber > l_suppkey % 7 + 1 THEN l_partkey % 1000 ELSE 0 END AS BIGINT) r
          FROM lineitem) GROUP BY format, c)""",
        """fold AS (SELECT format, rn, c best_at, r best, 0 misses, c last_at FROM ladder WHERE rn = 1
          UNION ALL SELECT l.format, l.rn, CASE WHEN l.r > f.best * 1.03 THEN l.c ELSE f.best_at END,
            CASE WHEN l.r > f.best * 1.03 THEN l.r ELSE f.best END, CASE WHEN l.r > f.best * 1.03 THEN 0 ELSE f.misses + 1 END, l.c
          FROM fold f JOIN ladder l ON l.format = f.format AND l.rn = f.rn + 1 WHERE f.misses < 2)""",
    )
    + """SELECT format, best_at concurrency, best rows_per_s, rn rungs_seen, best_at = last_at still_climbing FROM
      (SELECT *, max(rn) OVER (PARTITION BY format) top FROM fold) WHERE rn = top""",
    "ceiling_merge": with_views(INGEST)
    + """SELECT env || '/' || format format, CASE WHEN client = 'outside' THEN rows_per_s + 1 ELSE rows_per_s END rows_per_s,
      CASE WHEN client = 'outside' THEN 'new' ELSE 'old' END AS source FROM ingest_gate""",
    "foreign_ceilings": with_views(INGEST)
    + "SELECT env, format, infra_digest FROM ingest_gate WHERE infra_digest <> env_digest",
    "infra_digest": f"SELECT s_suppkey, {digest('s_suppkey')} digest FROM supplier",
    "burst_rates": """SELECT l_orderkey, l_linenumber, l_partkey, q AS "rows", b AS bytes, CAST(round(q / s) AS BIGINT) rows_per_s,
      b / s / 1e6 mb_per_s, b // greatest(q, 1) row_bytes FROM (SELECT *, CAST(l_quantity AS BIGINT) q,
      CAST(round(l_extendedprice*100) AS BIGINT) b, (l_partkey*1000 + 500000) / 1e6 s FROM lineitem)""",
}
