"""Model output: tagged plans, single files, line-delimited JSON events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X


def plan_header(df: DataFrame, text: str, strict_tags: bool = False) -> DataFrame:
    """``df`` with assistant_reply and proposal_summary.

    Tags are repaired literally by default, which empties proposal_summary where its tags are whole;
    ``strict_tags`` keeps it.
    """
    body = X.repaired_tags(X.unwrapped(text), strict_tags)
    return df.withColumns({"assistant_reply": X.strip(X.tag(body, "assistant_reply")), "proposal_summary": X.strip(X.tag(body, "proposal_summary"))})


def plan_actions(df: DataFrame, key: str, text: str, strict_tags: bool = False) -> DataFrame:
    """key, ordinal, kind, target_file, summary, updated_content of every complete action block.

    Blocks without a known kind, a target or a content are dropped; ordinals count all blocks from 0.
    """
    body = X.repaired_tags(X.unwrapped(text), strict_tags)
    b = df.select(key, F.posexplode(X.blocks(body, "action")).alias("ordinal", "block"))
    content = X.file_body(F.coalesce(F.nullif(X.tag("block", "updated_content"), F.lit("")), X.tag("block", "updated_file")))
    out = b.select(key, "ordinal", X.action_kind(X.tag("block", "kind")).alias("kind"), X.strip(X.tag("block", "target_file")).alias("target_file"), X.strip(X.tag("block", "summary")).alias("summary"), content.alias("updated_content"))
    return out.where("kind is not null and target_file <> '' and updated_content <> ''")


def single_file(df: DataFrame, text: str, strict_tags: bool = False) -> DataFrame:
    """``df`` with file_summary and file_content: the tagged content, else the longest fenced block, else the text without its summary."""
    body = X.repaired_tags(X.unwrapped(text), strict_tags)
    tagged = X.file_body(F.coalesce(F.nullif(X.tag(body, "updated_content"), F.lit("")), X.tag(body, "updated_file")))
    rest = X.strip(F.regexp_replace(body, fixed.SUMMARY_BLOCK, ""))
    content = F.coalesce(F.nullif(tagged, F.lit("")), F.nullif(X.largest_code_block(body), F.lit("")), rest)
    return df.withColumns({"file_summary": X.strip(X.tag(body, "summary")), "file_content": X.strip(content)})


def events(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, type, chunk, seq of each line that is a JSON event; other lines give no row.

    One pass of a JSON parser with a fixed schema; fields that are missing are null.
    """
    rows = df.select(key, F.posexplode(F.split(X.blank_to_empty(text), "\n", -1)).alias("line_no", "line"))
    e = F.from_json("line", "type string, payload struct<chunk string, seq int, status string, updatedContent string>")
    parsed = rows.where(F.col("line").startswith("{")).withColumn("e", e).where("e.type is not null")
    return parsed.select(key, "line_no", F.col("e.type").alias("type"), F.col("e.payload.chunk").alias("chunk"), F.col("e.payload.seq").alias("seq"))


def model_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """The message contents of a model's NDJSON stream; blank lines and empty contents are skipped."""
    content = F.get_json_object(X.strip(line), "$.message.content")
    return df.select(content.alias("content")).where("content is not null and content <> ''")
