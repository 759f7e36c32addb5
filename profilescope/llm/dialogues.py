"""Operator 9: chat formatting by perspective rotation.

Every participant of a dialogue gets a rendering of it in which they are the assistant and all others are users by
name; only the assistant's turns are trained on. A rendering is a sequence of segments, one per turn, with
their places in it, so no dialogue has to fit into one row or task.

Places are running sums in two levels: within chunks of ``CHUNK`` turn numbers, after the sums of earlier chunks. A
dialogue with a third of all turns is thereby spread over many tasks. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers whose segments one task adds up.
CHUNK = 128
INSTRUCTIONS = ("system",)
UNKNOWN = "unknown"
END = "<|end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with a speaker and a text in which no mark can be mistaken for one of the rendering."""
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"<\|", "< |")
    return (
        conversations.where("conv_id IS NOT NULL")
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN)).alias("speaker"),
            text.alias("text"),
        )
        .distinct()
    )


def _running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds columns with the sums of all earlier rows of the same keys; ``sums`` maps new names to columns.

    ``_chunk`` must not fall in the given order.
    """
    level = Window.partitionBy(*keys).orderBy(F.col("_chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    before = chunks.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_chunk"])],
        *[F.coalesce(F.sum(f"_sum_{n}").over(level), F.lit(0)).alias(f"_before_{n}") for n in sums],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_chunk"])]
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumns({f"_in_{n}": F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    joined = inner.join(before, same)
    total = {n: F.col(f"_before_{n}") + F.col(f"_in_{n}") for n in sums}
    return joined.select(*rows.columns, *[v.alias(n) for n, v in total.items()])


def rotate(conversations: DataFrame, instructions: tuple[str, ...] = INSTRUCTIONS) -> DataFrame:
    """The segments of every participant's rendering of every dialogue.

    Columns: conv_id, perspective, position (from 0), role (assistant, user or system), name (of a user), segment, start
    and end (code points in the rendering), train_start and train_end (of what is learned: an
    assistant's text with its end mark; null elsewhere).

    Participants are all speakers but those in ``instructions``, whose turns are system turns for everyone. Turns go by
    number, then speaker, then text; a turn that is repeated as a whole counts once. Nulls: turns without a
    conv_id belong to no dialogue and are left out; a null role speaks as a user named ``unknown`` and has no perspective of their
    own (nor has a role of that name); a null turn number comes first; a null text is empty. A dialogue without participants has no rendering. ``<|`` in a text becomes
    ``< |``. An empty table gives no rows. Other columns are not read.
    """
    turns = _turns(conversations)
    told = F.col("speaker").isin(list(instructions)) if instructions else F.lit(False)
    who = turns.where(~told & (F.col("speaker") != UNKNOWN)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    role = F.when(told, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    rows = turns.join(who, "conv_id").withColumn("role", role)
    name = F.when(F.col("role") == "user", F.col("speaker"))
    head = F.when(F.col("role") == "user", F.concat(F.lit("<|user:"), "speaker", F.lit("|>"))).otherwise(
        F.concat(F.lit("<|"), "role", F.lit("|>"))
    )
    rows = (
        rows.withColumn("name", name)
        .withColumn("_head", F.length(head))
        .withColumn("segment", F.concat(head, "text", F.lit(END)))
        .withColumn("_length", F.length("segment").cast("long"))
        .withColumn("_one", F.lit(1).cast("long"))
        .withColumn("_chunk", F.floor(F.col("turn") / CHUNK))
    )
    order = [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("text")]
    placed = _running(rows, ["conv_id", "perspective"], order, {"start": "_length", "position": "_one"})
    mine = F.col("role") == "assistant"
    return placed.select(
        "conv_id",
        "perspective",
        "position",
        "role",
        "name",
        "segment",
        "start",
        (F.col("start") + F.col("_length")).alias("end"),
        F.when(mine, F.col("start") + F.col("_head")).alias("train_start"),
        F.when(mine, F.col("start") + F.col("_length")).alias("train_end"),
    )


def op9(conversations: DataFrame) -> DataFrame:
    return rotate(conversations)


ORACLE_OP9 = """
WITH turns AS (
  SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
         coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), who AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker NOT IN ('system', 'unknown')
), cast_ AS (
  SELECT t.conv_id, w.perspective, t.turn, t.speaker, t.text,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM turns t JOIN who w ON t.conv_id = w.conv_id
), headed AS (
  SELECT *, CASE WHEN role = 'user' THEN '<|user:' || speaker || '|>' ELSE '<|' || role || '|>' END AS head FROM cast_
), rendered AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM headed
), placed AS (
  SELECT *, row_number() OVER w - 1 AS position,
         coalesce(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rendered
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text)
)
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, role,
       CASE WHEN role = 'user' THEN speaker END AS name, segment, CAST(start AS BIGINT) AS start,
       CAST(start + length(segment) AS BIGINT) AS "end",
       CASE WHEN role = 'assistant' THEN CAST(start + length(head) AS BIGINT) END AS train_start,
       CASE WHEN role = 'assistant' THEN CAST(start + length(segment) AS BIGINT) END AS train_end
FROM placed
"""
