"""Query op11, the same over records of unlike layouts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm import chat
from tracklane.llm.common import table

#: What both rows of conversation -1 say.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def with_control(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of rows, and the two rows of conversation -1."""
    spark = rows.sparkSession
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(own)


def digests(conversations: DataFrame, *more: str) -> DataFrame:
    """conv_id, what is read back from the formatted text of its turns, and more columns as they are."""
    read = chat.read_back(chat.formatted(conversations))
    learned = read.withColumn("__learned", F.array_join("learned_texts", ""))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return learned.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("__learned").cast("long").alias("loss_chars"),
        F.sha2("__learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        *more,
    )


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_control(table(spark, sf_dir, "conversations"))
    records = chat.canonical(rows, ["conv_id", "turn"], absent_nulls=False)
    return digests(chat.gathered(records, "conv_id", "turn"))


def layout_records(rows: DataFrame) -> DataFrame:
    """Each conversation as one JSON record, in the layout that suits its turns: conv_id and record.

    A question with its answer becomes a prompt, an instruction or a question, by
    the length of its text; others become messages, messages of parts or shared
    conversations by their number of turns.
    """
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role, text))).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: x["role"]), " ")
    first, last = F.col("t")[0]["text"], F.element_at("t", -1)["text"]
    n = F.length(first)
    said = lambda a, b: F.to_json(F.struct(first.alias(a), last.alias(b)))
    each = lambda name, a, b: F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias(a), b(x))).alias(name)))
    content = lambda x: x["text"].alias("content")
    value = lambda x: x["text"].alias("value")
    parts = lambda x: F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content")
    record = (
        F.when((roles == "user assistant") & (n % 4 == 0), said("prompt", "response"))
        .when((roles == "user assistant") & (n % 4 == 1), said("prompt", "completion"))
        .when((roles == "user assistant") & (n % 4 == 2), said("instruction", "output"))
        .when(roles == "user assistant", said("question", "answer"))
        .when(F.size("t") % 3 == 0, each("messages", "role", content))
        .when(F.size("t") % 3 == 1, each("messages", "role", parts))
        .otherwise(each("conversations", "from", value))
    )
    return lists.select("conv_id", record.alias("record"))


def chat_formatting_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op11, from JSON records of seven layouts; the layout stands beside."""
    records = chat.canonical(layout_records(with_control(table(spark, sf_dir, "conversations"))), ["conv_id"], json="record")
    return digests(records, "layout")


_ROWS = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '{CONTROL}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
marked AS (
  SELECT *, role || chr(10) || text || chr(10) AS said,
         replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|line|>') AS role_out, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS text_out
  FROM given)"""

_DIGESTS = """conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(said, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || role_out || chr(10) || text_out || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars"""

SQL = f"{_ROWS}\nSELECT {_DIGESTS}\nFROM marked GROUP BY conv_id"

LAYOUTS_SQL = rf"""{_ROWS}
SELECT {_DIGESTS},
       CASE WHEN string_agg(role, ' ' ORDER BY turn NULLS FIRST, role, text) = 'user assistant'
            THEN CASE length(min_by(text, turn)) % 4 WHEN 0 THEN 'prompt_response' WHEN 1 THEN 'prompt_completion' WHEN 2 THEN 'instruction' ELSE 'question_answer' END
            ELSE CASE count(*) % 3 WHEN 0 THEN 'messages' WHEN 1 THEN 'message_parts' ELSE 'shared_conversations' END END AS layout
FROM marked GROUP BY conv_id
"""
