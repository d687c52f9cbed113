"""Chat formatting in Spark expressions only: formatted text, loss spans, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlake.llm.common import table

#: Control strings of the template (fixed values).
BLOCK, ROLE_END, TURN, END = "<s>", "<r>", "<t>", "</s>"
_CONTROL = r"(s>|/s>|r>|t>)"
_INST = r"(INST\]|/INST\])"
#: unescape() in SQL.
_UNESCAPE = rf"regexp_replace(regexp_replace({{}}, r'<\\(\\*){_CONTROL}', '<$1$2'), r'\[\\(\\*){_INST}', '[$1$2')"
#: Turns whose places are found together.
_RUN = 128


def _runs(array: str) -> str:
    """The begins of the runs of an array, in SQL; none of an empty one."""
    return f"filter(sequence(0, greatest(size({array}) - 1, 0), {_RUN}), r -> r < size({array}))"


def escape(text: Column) -> Column:
    """Put a backslash inside each control string of a text: ``<s>`` becomes
    ``<\\s>`` and ``<\\s>`` becomes ``<\\\\s>``, so that unescape() undoes it. The
    instruction brackets of other templates are treated alike."""
    text = F.regexp_replace(text, r"<(\\*)" + _CONTROL, r"<\\$1$2")
    return F.regexp_replace(text, r"\[(\\*)" + _INST, r"[\\$1$2")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)" + _CONTROL, r"<$1$2")
    return F.regexp_replace(text, r"\[\\(\\*)" + _INST, r"[$1$2")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to one row a conversation: ``formatted`` and
    ``loss_spans`` (start from 0 and length in code points of each assistant text).

    Turns are collected as structs and sorted by (turn, role, text), nulls first, so
    ties and repeated rows have one order and all stay. Adjacent turns of one role
    merge to one block ``<s>role<r>text<t>text</s>``; ``<t>`` keeps the turns apart.
    Null roles and texts are empty. Only assistant texts are under the loss mask,
    marks are not. A null conv_id is a conversation of its own.
    """
    turns = (
        rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    )
    turns = turns.withColumn("t", F.transform("t", lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text"))))
    # what stands before each text, then the text: a new block where the role changes
    pieces = turns.withColumn(
        "p",
        F.expr(
            f"""transform(t, (x, i) -> struct(
                case when i = 0 then concat('{BLOCK}', x.role, '{ROLE_END}')
                     when get(t, i - 1).role = x.role then '{TURN}'
                     else concat('{END}{BLOCK}', x.role, '{ROLE_END}') end as mark,
                x.text as text, x.role = 'assistant' as loss))"""
        ),
    )
    # places by runs of turns, so that the work grows with the conversation and not with its square
    size = "transform(p, x -> cast(length(x.mark) + length(x.text) as long))"
    ends = pieces.withColumn("n", F.expr(f"transform({_runs('p')}, r -> slice({size}, r + 1, {_RUN}))"))
    ends = ends.withColumn("n", F.expr(
        """aggregate(transform(n, r -> aggregate(r, 0L, (a, x) -> a + x)), named_struct('at', 0L, 'all', cast(array() as array<bigint>)),
            (a, x) -> named_struct('at', a.at + x, 'all', array_append(a.all, a.at))).all"""
    ))
    ends = ends.withColumn("q", F.expr(
        f"""flatten(transform({_runs('p')}, (r, i) -> aggregate(slice(p, r + 1, {_RUN}),
            named_struct('at', get(n, i), 'spans', cast(array() as array<struct<start: bigint, length: bigint>>)),
            (a, x) -> named_struct(
                'at', a.at + length(x.mark) + length(x.text),
                'spans', case when x.loss then array_append(a.spans, named_struct('start', a.at + length(x.mark), 'length', cast(length(x.text) as bigint)))
                         else a.spans end)).spans))"""
    ))
    formatted = F.concat(F.array_join(F.transform("p", lambda x: F.concat(x["mark"], x["text"])), ""), F.lit(END))
    return ends.select("conv_id", formatted.alias("formatted"), F.col("q").alias("loss_spans"))


def under_mask(formatted: str, spans: str) -> Column:
    """The unescaped text under the spans of a formatted conversation, read run by run of
    spans: a run's part of the text is cut out once."""
    part = f"substring({formatted}, cast(s[0].start + 1 as int), cast(s[size(s) - 1].start + s[size(s) - 1].length - s[0].start as int))"
    cut = "substring(part, cast(x.start - s[0].start + 1 as int), cast(x.length as int))"
    run = f"transform(array({part}), part -> array_join(transform(s, x -> {_UNESCAPE.format(cut)}), ''))[0]"
    return F.expr(f"array_join(transform(transform({_runs(spans)}, r -> slice({spans}, r + 1, {_RUN})), s -> {run}), '')")


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """The way back: (conv_id, formatted) to ``turns``, an array of (role, text)."""
    block = F.split(F.expr(f"substr(formatted, 1, length(formatted) - {len(END)})"), END, -1)

    def turns(b: Column) -> Column:
        role = F.substring_index(b, ROLE_END, 1)
        body = F.substring(b, F.length(role) + len(ROLE_END) + 1, F.length(b))
        role = unescape(F.substring(role, F.lit(len(BLOCK) + 1), F.length(role)))
        return F.transform(F.split(body, TURN, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(block, turns)))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, with digests read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text"))
        for i, r in enumerate(("user", "assistant"))
    ])).alias("r")).select("r.*")
    out = parse_conversations(format_conversations(rows.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("_under", under_mask("formatted", "loss_spans")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_under").cast("long").alias("loss_chars"),
        F.sha2("_under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
