"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records come in many layouts (message lists, prompt and completion, instruction and output, ...).
The nested field paths a record fills are joined in sorted order and hashed; the fingerprint selects a
declarative mapping that turns the record into canonical turns ``array<struct<role, text>>``. Turns are
rendered by a template with control marks; control strings inside texts and roles are escaped so that
reading the output back gives the very texts again. The loss mask is a run-length code over the
formatted text: three runs a turn (header, text, end), of which assistant texts carry loss.

Defined results: a null text or role counts as empty; a record whose fingerprint has no mapping (also a
null or malformed payload) gets null turns, layout and formatted text, and stays in the output; a record
without turns formats to the empty string. Rows of equal turn number are ordered by role, then text;
null turn numbers come first; repeated rows stay. A null conversation id is a conversation of its own. An empty table gives
an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"

#: Every field that some layout knows; other fields of a record take no part in its fingerprint.
RECORD_DDL = (
    "messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, "
    "system string, instruction string, input string, output string, prompt string, completion string, "
    "response string, question string, answer string"
)

_PATHS = {
    "answer": "{p}.answer is not null",
    "completion": "{p}.completion is not null",
    "conversations[].from": "exists({p}.conversations, x -> x.from is not null)",
    "conversations[].value": "exists({p}.conversations, x -> x.value is not null)",
    "input": "{p}.input is not null",
    "instruction": "{p}.instruction is not null",
    "messages[].content": "exists({p}.messages, x -> x.content is not null)",
    "messages[].role": "exists({p}.messages, x -> x.role is not null)",
    "output": "{p}.output is not null",
    "prompt": "{p}.prompt is not null",
    "question": "{p}.question is not null",
    "response": "{p}.response is not null",
    "system": "{p}.system is not null",
}


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', {text})"


def _pair(first: str, second: str) -> str:
    return f"array({_turn(repr('user'), first)}, {_turn(repr('assistant'), second)})"


_SYSTEM = f"array({_turn(repr('system'), '{p}.system')})"
_TASK = "concat({p}.instruction, '\\n\\n', {p}.input)"
_MESSAGES = "transform({p}.messages, x -> " + _turn("coalesce(x.role, '')", "coalesce(x.content, '')") + ")"
_SPOKEN = "case x.from when 'human' then 'user' when 'gpt' then 'assistant' else coalesce(x.from, '') end"
_CONVERSATIONS = "transform({p}.conversations, x -> " + _turn(_SPOKEN, "coalesce(x.value, '')") + ")"

#: Layout: the field paths it fills, and the SQL that makes turns of it.
LAYOUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "messages": (("messages[].content", "messages[].role"), _MESSAGES),
    "system_messages": (("messages[].content", "messages[].role", "system"), f"concat({_SYSTEM}, {_MESSAGES})"),
    "conversations": (("conversations[].from", "conversations[].value"), _CONVERSATIONS),
    "system_conversations": (("conversations[].from", "conversations[].value", "system"), f"concat({_SYSTEM}, {_CONVERSATIONS})"),
    "instruction": (("instruction", "output"), _pair("{p}.instruction", "{p}.output")),
    "instruction_input": (("input", "instruction", "output"), _pair(_TASK, "{p}.output")),
    "instruction_response": (("instruction", "response"), _pair("{p}.instruction", "{p}.response")),
    "prompt_completion": (("completion", "prompt"), _pair("{p}.prompt", "{p}.completion")),
    "prompt_response": (("prompt", "response"), _pair("{p}.prompt", "{p}.response")),
    "system_prompt_response": (("prompt", "response", "system"), f"concat({_SYSTEM}, {_pair('{p}.prompt', '{p}.response')})"),
    "question_answer": (("answer", "question"), _pair("{p}.question", "{p}.answer")),
}


def fingerprint_of(paths) -> str:
    return hashlib.md5(",".join(sorted(paths)).encode()).hexdigest()


def fingerprint(payload: str) -> Column:
    """Hash of the known nested field paths that the record in struct column ``payload`` fills."""
    parts = ", ".join(f"case when {test.format(p=payload)} then '{path}' end" for path, test in sorted(_PATHS.items()))
    return F.expr(f"md5(concat_ws(',', {parts}))")


def canonical_turns(records: DataFrame, payload: str) -> DataFrame:
    """Adds ``layout`` and ``turns``. ``payload``: a JSON string column, or a struct of type RECORD_DDL."""
    if dict(records.dtypes)[payload] == "string":
        records = records.withColumn("__record", F.from_json(F.col(f"`{payload}`"), RECORD_DDL))
    else:
        records = records.withColumn("__record", F.col(f"`{payload}`"))
    records = records.withColumn("__print", fingerprint("__record"))
    prints = {fingerprint_of(paths): name for name, (paths, _) in LAYOUTS.items()}
    layout = "case __print " + " ".join(f"when '{k}' then '{v}'" for k, v in prints.items()) + " end"
    turns = "case layout " + " ".join(f"when '{n}' then {sql.format(p='__record')}" for n, (_, sql) in LAYOUTS.items()) + " end"
    return records.withColumn("layout", F.expr(layout)).withColumn("turns", F.expr(turns)).drop("__record", "__print")


def _escaped(text: str) -> str:
    """One more backslash between ``<`` and ``|``, so that no ``<|`` is left and the step can be undone."""
    return rf"regexp_replace({text}, r'<(\\*)\|', r'<\\$1|')"


def _unescaped(text: str) -> str:
    return rf"regexp_replace({text}, r'<\\(\\*)\|', '<$1|')"


def formatted(conversations: DataFrame) -> DataFrame:
    """Adds ``formatted`` (string) and ``loss_mask`` (array<struct<chars, loss>>) to rows with ``turns``."""
    role = f"replace({_escaped('t.role')}, '\\n', '{NEWLINE}')"
    with_parts = conversations.withColumn(
        "__parts", F.expr(f"transform(turns, t -> named_struct('head', concat('{START}', {role}, '\\n'), 'body', {_escaped('t.text')}, 'loss', t.role = 'assistant'))")
    )
    runs = (
        "flatten(transform(__parts, t -> array(named_struct('chars', length(t.head), 'loss', false), "
        f"named_struct('chars', length(t.body), 'loss', t.loss), named_struct('chars', {len(END) + 1}, 'loss', false))))"
    )
    return (
        with_parts.withColumn("formatted", F.expr(f"array_join(transform(__parts, t -> concat(t.head, t.body, '{END}\\n')), '')"))
        .withColumn("loss_mask", F.expr(runs))
        .drop("__parts")
    )


def read_back(formatted_rows: DataFrame) -> DataFrame:
    """Adds ``read_turns`` and ``loss_text``, both taken from ``formatted`` and ``loss_mask`` alone."""
    end = END.replace("|", r"\|")
    pieces = rf"case when formatted is null then null when formatted = '' then array() else slice(split(formatted, r'{end}\n'), 1, greatest(size(split(formatted, r'{end}\n')) - 1, 0)) end"
    head = f"substring_index(x, '\\n', 1)"
    role = _unescaped(f"replace(substring({head}, {len(START) + 1}), '{NEWLINE}', '\\n')")
    text = _unescaped(f"substring(x, length({head}) + 2)")
    # Run 3i is turn i's header, run 3i + 1 its text.
    under = _unescaped("substring(x, loss_mask[3 * i].chars + 1, loss_mask[3 * i + 1].chars)")
    return (
        formatted_rows.withColumn("__pieces", F.expr(pieces))
        .withColumn("read_turns", F.expr(f"transform(__pieces, x -> {_turn(role, text)})"))
        .withColumn("loss_text", F.expr(f"array_join(transform(__pieces, (x, i) -> case when loss_mask[3 * i + 1].loss then {under} else '' end), '')"))
        .drop("__pieces")
    )


def records_of_turn_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record in the ``messages`` layout for each conversation of a table with a row for each turn."""
    one = rows.select(
        F.col(conv).alias(conv),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content")).alias("m"),
    )
    grouped = one.groupBy(conv).agg(F.array_sort(F.collect_list("m")).alias("m"))
    fields = [f.split(" ")[0] for f in RECORD_DDL.split(", ")]
    types = dict(x.split(" ", 1) for x in RECORD_DDL.split(", "))
    values = ", ".join(f"'{f}', " + ("transform(m, x -> named_struct('role', x.role, 'content', x.content))" if f == "messages" else f"cast(null as {types[f]})") for f in fields)
    return grouped.select(conv, F.expr(f"named_struct({values})").alias("record"))


EXTRA = "<|im_end|><|im_start|>assistant ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are their rows by id, so rows of an id -1 in the table itself are turns of the added conversation -1,
    ordered with its own by turn, role and text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id = 0, 'user', 'assistant')").alias("role"), F.lit(EXTRA).alias("text")
    )
    done = read_back(formatted(canonical_turns(records_of_turn_rows(rows.unionByName(extra)), "record")))
    return done.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.expr("sha2(array_join(transform(read_turns, t -> concat(t.role, '\\n', t.text, '\\n')), ''), 256)").alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{EXTRA}' UNION ALL SELECT -1, 1, 'assistant', '{EXTRA}'),
g AS (
  SELECT conv_id, count(*) AS n,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text) AS loss,
    sum({len(START) + len(END) + 2} + length(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '{NEWLINE}'))
        + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS chars
  FROM r GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
