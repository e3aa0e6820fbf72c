"""Rule audits over timed events and order charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.functions import scalars
from tactus.operators import audit
from tactus.plans.bindings import EVENT_WIDTH, LINE_ROWS_SQL, event_rows, line_rows, rounded
from tactus.plans.play_queries import HOUR, KEYS, OCCUPIED_SQL, ORDER, PIECE, STREAM_SQL
from tactus.plans.registry import query


def big(*names: str) -> list:
    return [F.col(c).cast("bigint").alias(c) for c in names]


@query(
    "crowded",
    f"""WITH {LINE_ROWS_SQL} SELECT chart, slot::BIGINT AS slot,
    (coalesce(lead(slot) OVER (PARTITION BY chart ORDER BY slot), slot + 12) - slot < 10)::BIGINT AS crowded FROM
    (SELECT chart, slot FROM rows_)""".replace("< 10", "< 6"),
)
def crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.crowded(line_rows(spark, sf_dir), ["chart"], segment=96.0)
    return found.select("chart", *big("slot", "crowded"))


USAGE = ", ".join(
    f"round(sum(b.s{p} * pow(0.957, a.rn - b.rn)) + 1e-9, 6) AS u{p}" for p in range(4)
)


@query(
    "panel_usage",
    f"""WITH {OCCUPIED_SQL},
    n AS (SELECT *, user_id % 5 AS stage, row_number() OVER (PARTITION BY user_id % 5 ORDER BY t, event_id) AS rn FROM occ),
    u AS (SELECT a.event_id, {", ".join(f"sum(b.s{p} * pow(0.957, a.rn - b.rn)) AS u{p}" for p in range(4))}
      FROM n a JOIN n b ON a.stage = b.stage AND b.rn <= a.rn GROUP BY a.event_id)
    SELECT event_id, {", ".join(f"round(u{p} + 1e-9, 6) AS u{p}" for p in range(4))},
      {", ".join(f"round(-ln((u{p} + 1) / (u0 + u1 + u2 + u3 + 4) * 4) + 1e-9, 6) AS b{p}" for p in range(4))} FROM u""",
)
def panel_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).withColumn("stage", F.col("user_id") % 5)
    used = audit.panel_usage(rows, ["stage"], ORDER, segment=F.floor(F.col("t") / F.lit(PIECE)))
    return used.select(
        "event_id",
        *[rounded(F.get("usage", F.lit(p))).alias(f"u{p}") for p in range(4)],
        *[rounded(F.get("bias", F.lit(p))).alias(f"b{p}") for p in range(4)],
    )


@query(
    "same_arrow_runs",
    f"""WITH {OCCUPIED_SQL},
    a AS (SELECT *, CASE WHEN stepped = lag(stepped) OVER w AND n_step = 1 THEN 0 ELSE 1 END AS brk,
            row_number() OVER w AS rn FROM occ WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    b AS (SELECT *, max(CASE WHEN brk = 1 THEN rn END) OVER (PARTITION BY user_id ORDER BY t, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS from_rn FROM a)
    SELECT user_id, event_id, rn - from_rn + 1 AS repeats, (rn - from_rn + 1 >= 3)::BIGINT AS stale FROM b""",
)
def same_arrow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.same_arrow_runs(
        event_rows(spark, sf_dir), KEYS, ORDER, limit=3, segment=F.floor(F.col("t") / F.lit(PIECE))
    )
    return found.select("user_id", "event_id", *big("repeats", "stale"))


@query(
    "ration_audit",
    f"""WITH {OCCUPIED_SQL}, {STREAM_SQL},
    f AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id), 1e9) <= 3 * 3600 AS fast,
            (c0 IN (2,4))::INT + (c1 IN (2,4))::INT + (c2 IN (2,4))::INT + (c3 IN (2,4))::INT AS fz FROM st5),
    r AS (SELECT user_id, event_id, t, fast, n_step, crossed, in_run,
        count(*) OVER w AS rows, sum((n_step > 1)::INT) OVER w AS jumps, sum(n_step) OVER w AS notes, sum(fz) OVER w AS freezes,
        sum(in_run::INT) OVER w AS streamed, sum(crossed::INT) OVER w AS crossings,
        sum((in_run AND fast)::INT) OVER w AS fast_streamed, sum((crossed AND fast)::INT) OVER w AS fast_crossings
      FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    x AS (SELECT *, crossings - coalesce(last_value(CASE WHEN n_step = 1 AND NOT crossed THEN crossings END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS run FROM r)
    SELECT user_id, event_id, jumps::BIGINT AS jumps, freezes::BIGINT AS freezes, crossings::BIGINT AS crossings,
      streamed::BIGINT AS streamed, run::BIGINT AS crossed_run,
      (freezes > greatest(notes, 1) * 0.04::DOUBLE)::BIGINT AS over_freezes, (jumps > greatest(rows, 1) * 0.08::DOUBLE)::BIGINT AS over_jumps,
      (crossings > streamed * 0.04::DOUBLE OR (fast AND fast_crossings > fast_streamed * (0.04::DOUBLE / 6)))::BIGINT AS over_crossings,
      (run > CASE WHEN fast THEN 1 ELSE 2 END)::BIGINT AS over_run FROM x""",
)
def ration_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.ration_audit(
        event_rows(spark, sf_dir), KEYS, ORDER, F.lit(HOUR), gap=12 * HOUR, segment=PIECE
    )
    counts = ("jumps", "freezes", "crossings", "streamed", "crossed_run")
    flags = ("over_freezes", "over_jumps", "over_crossings", "over_run")
    return found.select("user_id", "event_id", *big(*counts, *flags))


@query(
    "rule_audit",
    f"""WITH {OCCUPIED_SQL},
    p AS (SELECT *, {", ".join(f"coalesce(last_value(CASE WHEN c{p} IN (2,4) THEN 1 WHEN c{p} = 3 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p{p}" for p in range(4))},
        lag(t) OVER w AS t0, lag(stepped) OVER w AS step0, lead(t) OVER w AS t1 FROM occ
        WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    q AS (SELECT user_id, event_id, list_filter([
        CASE WHEN t - t0 < 7200 AND stepped & step0 <> 0 THEN 'fast_jack' END,
        CASE WHEN n_step > 1 AND least(t - t0, t1 - t) < 3600 THEN 'cramped_jump' END,
        CASE WHEN {" OR ".join(f"(p{p} = 1 AND c{p} NOT IN (0, 3))" for p in range(4))} THEN 'step_on_held' END,
        CASE WHEN {" OR ".join(f"(p{p} = 0 AND c{p} = 3)" for p in range(4))} THEN 'orphan_tail' END,
        CASE WHEN n_step + p0 + p1 + p2 + p3 > 2 THEN 'too_many_limbs' END,
        CASE WHEN 5 IN (c0, c1, c2, c3) THEN 'mine' END,
        CASE WHEN 4 IN (c0, c1, c2, c3) THEN 'roll' END], lambda x: x IS NOT NULL) AS rules FROM p)
    SELECT user_id, event_id, unnest(rules) AS rule FROM q""",
)
def rule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.rule_audit(
        event_rows(spark, sf_dir), KEYS, ORDER, min_jack=2 * HOUR, min_room=HOUR, segment=PIECE, width=EVENT_WIDTH
    )
    return found.select("user_id", "event_id", "rule")


@query(
    "close_holds",
    f"""WITH {LINE_ROWS_SQL},
    a AS (SELECT *, lead(slot) OVER w AS ns, {", ".join(f"coalesce(lead(c{p}) OVER w, 0) AS n{p}" for p in range(4))} FROM rows_
      WINDOW w AS (PARTITION BY chart ORDER BY slot)),
    t AS (SELECT chart, least(slot + 12, coalesce(ns - 1, slot + 12)) AS slot,
      {" || ".join(f"CASE WHEN c{p} IN (2,4) AND n{p} <> 3 THEN '3' ELSE '0' END" for p in range(4))} AS codes FROM a)
    SELECT chart, slot::BIGINT AS slot, txt AS codes FROM rows_
    UNION ALL SELECT chart, slot::BIGINT, codes FROM t WHERE codes <> '0000'""",
)
def close_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = audit.close_holds(line_rows(spark, sf_dir), ["chart"], segment=96.0)
    return closed.select("chart", *big("slot"), scalars.code_text(F.col("codes")).alias("codes"))



