"""Operator 6, chat formatting by schema fingerprints (DataFrame functions only).

A record is a JSON object in one of several layouts.  The nested field paths of each record,
without types and values, are hashed; the hash selects a declarative mapping to canonical turns.
Turns are then written in one template and can be read back exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

TURNS = "array<struct<turn: bigint, role: string, text: string>>"


def _said(*turns: tuple[str, Column]) -> Column:
    """Turns from columns, in order; an absent one (null) is left out."""
    all_turns = F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text")) for i, (role, text) in enumerate(turns)])
    return F.filter(all_turns, lambda t: t["text"].isNotNull())


def _listed(items: Column, role: str, text: str, names: dict[str, str] | None = None) -> Column:
    def one(x: Column, i: Column) -> Column:
        r = x[role]
        for old, new in (names or {}).items():
            r = F.when(x[role] == old, new).otherwise(r)
        return F.struct(i.cast("long").alias("turn"), r.alias("role"), x[text].alias("text"))
    return F.transform(items, one)


def _instruction(r: Column) -> Column:
    task = F.when(F.coalesce(r["input"], F.lit("")) == "", r["instruction"]).otherwise(F.concat(r["instruction"], F.lit("\n\n"), r["input"]))
    return _said(("user", task), ("assistant", r["output"]))


_SHARE = {"human": "user", "gpt": "assistant"}
#: layout: (field paths, schema to read it with, record -> turns).  Paths are sorted by name, as the fingerprint has them.
LAYOUTS = {
    "row": ("OBJECT<conv_id, role, text, turn>", "conv_id bigint, turn bigint, role string, text string",
            lambda r: F.array(F.struct(r["turn"].alias("turn"), r["role"].alias("role"), r["text"].alias("text")))),
    "messages": ("OBJECT<conv_id, messages: ARRAY<OBJECT<content, role>>>", "conv_id bigint, messages array<struct<role: string, content: string>>",
                 lambda r: _listed(r["messages"], "role", "content")),
    "shared": ("OBJECT<conv_id, conversations: ARRAY<OBJECT<from, value>>>", "conv_id bigint, conversations array<struct<from: string, value: string>>",
               lambda r: _listed(r["conversations"], "from", "value", _SHARE)),
    "prompt": ("OBJECT<completion, conv_id, prompt>", "conv_id bigint, prompt string, completion string",
               lambda r: _said(("user", r["prompt"]), ("assistant", r["completion"]))),
    "system_prompt": ("OBJECT<conv_id, prompt, response, system>", "conv_id bigint, system string, prompt string, response string",
                      lambda r: _said(("system", r["system"]), ("user", r["prompt"]), ("assistant", r["response"]))),
    "instruction": ("OBJECT<conv_id, input, instruction, output>", "conv_id bigint, instruction string, input string, output string", _instruction),
    "bare_instruction": ("OBJECT<conv_id, instruction, output>", "conv_id bigint, instruction string, output string",
                         lambda r: _said(("user", r["instruction"]), ("assistant", r["output"]))),
}


def field_paths(record: Column) -> Column:
    """The nested field paths of a JSON record, e.g. OBJECT<conv_id, messages: ARRAY<OBJECT<content, role>>>."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(schema, r": (?:[A-Z_]+(?:\([0-9, ]+\))?)(?=[,>])", "")


def schema_fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """Add fingerprint, layout, conv_id, turns (in order: turn, role, text) to each JSON record.

    A record whose paths no mapping knows, or that is no JSON, gets null layout, conv_id and turns;
    it is kept.  A null text is empty."""
    paths = field_paths(F.col(record))
    out = records.withColumn("fingerprint", schema_fingerprint(paths))
    layout, conv, turns = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast(TURNS)
    for name, (known, schema, mapping) in LAYOUTS.items():
        is_it = F.col("fingerprint") == schema_fingerprint(F.lit(known))
        r = F.from_json(F.col(record), schema)
        layout = F.when(is_it, F.lit(name)).otherwise(layout)
        conv = F.when(is_it, r["conv_id"]).otherwise(conv)
        turns = F.when(is_it, mapping(r).cast(TURNS)).otherwise(turns)
    filled = F.transform(turns, lambda t: F.struct(t["turn"].alias("turn"), F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return out.withColumns({"layout": layout, "conv_id": conv, "turns": filled})


# Control strings of the template, and of other templates that a tokenizer may know.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_FIRST = r"(<|\[)"
_REST = r"(\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])"


def escape(text: Column) -> Column:
    """No control string is left: a backslash follows the first character of each, and
    backslashes are doubled."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _FIRST + _REST, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) from canonical turns (conv_id, turn, role, text): the
    conversation in the template, and the spans (start, length in code points) of the texts that
    `trained` says, control strings excluded.

    Turns go by turn, then role, then text; repeated rows are all kept; a null turn comes first;
    a null conv_id is a conversation of its own.  One output value holds a conversation, so
    one task does."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    role, text = escape(F.col("role")), escape(F.col("text"))
    rows = turns.select("conv_id", "turn", "role", "text", F.concat(F.lit(START), role, F.lit(SEP)).alias("head"), text.alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.withColumn("no", F.row_number().over(w)).withColumn("end", F.sum(size.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - len(END) - F.length("body")
    parts = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "no", F.concat("head", "body", F.lit(END)).alias("piece"), (F.col("role") == trained).alias("loss"),
        start.alias("start"), F.length("body").cast("long").alias("length")))).alias("parts"))
    spans = F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["start"], p["length"]))
    return parts.select("conv_id", F.array_join(F.col("parts.piece"), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """Add turns (role, text) and loss_texts, read from `formatted` and `loss_spans` alone."""
    pieces = F.split(F.col("formatted"), r"<\|im_end\|>")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        cut = F.split(F.substr(p, F.lit(len(START) + 1)), r"<\|im_sep\|>")
        return F.struct(unescape(cut[0]).alias("role"), unescape(cut[1]).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_texts", loss)


def digests(chats: DataFrame) -> DataFrame:
    back = read_back(chats)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    records = rows.select(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    tricky = "</s>[INST] ok [/INST]"
    # Conversation -7 comes in another layout.
    message = [F.struct(F.lit(r).alias("role"), F.lit(tricky).alias("content")) for r in ("user", "assistant")]
    extra = spark.range(1).select(F.to_json(F.struct(F.lit(-7).alias("conv_id"), F.array(*message).alias("messages"))).alias("record"))
    turns = canonical_turns(records.unionByName(extra)).select("conv_id", F.inline("turns"))
    return digests(formatted(turns))


ORACLE = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '(<|\[)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\\\2', 'g') AS body,
  regexp_replace(replace(role, '\', '\\'), '(<|\[)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\\\2', 'g') AS who FROM r)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(who) + length(body) + 32) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
