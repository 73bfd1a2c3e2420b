r"""Chat formatting by prefix-target expansion.

A conversation's rendering is one text, a piece per turn:

    user         [INST] text [/INST]
    assistant    text</s>
    system       <<SYS>>text<</SYS>>
    other roles  [ROLE]role[/ROLE]text[/TURN]

Control strings inside a text get a backslash behind their first character, and a backslash
becomes two, so no control string but the template's own is left in the rendering, and
taking the backslashes out again gives the text.

Every assistant turn becomes an example of its own: all turns before it are context, its
reply alone is trainable. The context of an example is a prefix of the rendering, so
``examples`` says where its text ends and where its mask lies, one row per turn, and
``expand`` writes every example's whole text out, which ``read_examples`` reads back. Turns
after the last reply end in one more example without a target, so that the output holds every turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pairmatch.llm.common import query, quoted, table

#: Control strings of the template and of vocabularies that it is likely to meet.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]")
#: What stands before and after the text of a turn.
TEMPLATE = {"user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
TARGET = "assistant"

#: The place behind the first character of a control string.
_INSIDE = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)
_PLACES = ("place", "example", "text_end", "mask_start", "mask_end")
#: Characters of examples that are handed on at once.
_AT_ONCE = 1 << 20
#: Characters of an example that one string surely holds.
_LONGEST = (1 << 31) // 4 - 1
#: What reading back adds up per conversation.
_SUMS = ("n_turns", "loss_chars", "formatted_chars", "n_examples", "rendered_chars")


def escape(text: Column) -> Column:
    """Double the backslashes, then put one behind the first character of every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_INSIDE), F.lit(r"\\"))


def unescape(text: Column) -> Column:
    """One backslash for every two, none for a single one."""
    return F.regexp_replace(text, F.lit(r"\\(\\?)"), F.lit("$1"))


def render(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, piece, chars`` of every row; null roles and texts are read as empty."""
    kind = F.coalesce(quoted(role).cast("string"), F.lit(""))
    body = escape(F.coalesce(quoted(text), F.lit("")))
    piece = F.concat(F.lit("[ROLE]"), escape(kind), F.lit("[/ROLE]"), body, F.lit("[/TURN]"))
    for name, (before, after) in TEMPLATE.items():
        piece = F.when(kind == name, F.concat(F.lit(before), body, F.lit(after))).otherwise(piece)
    rows = turns.select(
        quoted(conv).alias("conv"), quoted(turn).alias("turn"), kind.alias("role"), piece.alias("piece")
    )
    return rows.withColumn("chars", F.length("piece").cast("long"))


def read_piece(piece: Column) -> tuple[Column, Column]:
    """Role and text of a turn, read from its piece alone."""
    named = r"(?s)^\[ROLE\](.*?)\[/ROLE\](.*)\[/TURN\]$"
    role, inner = unescape(F.regexp_extract(piece, named, 1)), F.regexp_extract(piece, named, 2)
    # A piece without an opening is a reply, so the empty opening is tried first and wins last.
    for name, (before, after) in sorted(TEMPLATE.items(), key=lambda t: len(t[1][0])):
        own = F.startswith(piece, F.lit(before)) & F.endswith(piece, F.lit(after))
        size = F.length(piece) - len(before) - len(after)
        role = F.when(own, F.lit(name)).otherwise(role)
        inner = F.when(own, F.substring(piece, F.lit(len(before) + 1), size)).otherwise(inner)
    return role, unescape(inner)


def _unescaped(text: str) -> str:
    """``unescape`` of one text."""
    return re.sub(r"\\(\\?)", r"\1", text)


def read_text(rendering: str) -> list[tuple[str, str]]:
    """Roles and texts of a whole rendering, or of a prefix that ends with a turn."""
    turn = re.compile(
        r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>"
        r"|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)\[/TURN\]|(?P<assistant>.*?)</s>",
        re.S,
    )

    out, at = [], 0
    while at < len(rendering):
        m = turn.match(rendering, at)
        if m is None:
            raise ValueError(f"no turn begins at {at}")
        name = m.lastgroup
        out.append((_unescaped(m["role"]), _unescaped(m["other"])) if name == "other" else (name, _unescaped(m[name])))
        at = m.end()
    return out


def examples(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv, turn, role, piece, chars, place, example, text_end, mask_start, mask_end`` of every turn.

    ``place`` numbers a conversation's turns from 1 in the order of ``turn`` (nulls first,
    ties by role, then text). A row with an ``example`` number is one: its text is the first
    ``text_end`` characters of the conversation's pieces, its mask those from ``mask_start``
    up to ``mask_end``; the mask is empty for the last turn of a conversation that doesn't
    end with a reply. Positions count code points. Null texts and roles are read as empty, a
    null conversation is one more, repeated rows are turns of their own, an empty table gives
    no rows, other columns are not read.

    Conversations are dealt whole and sorted; a task runs through its rows in batches with a
    few numbers in memory, however long a conversation is.
    """
    rows = render(turns, conv, turn, role, text)
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "piece")
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.LongType()) for n in _PLACES)])
    before, after = (len(x) for x in TEMPLATE[TARGET])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, last, own, place, example, end, started = None, object(), None, 0, 0, 0, False

        def placed(batch, following):
            """``following`` are the conversations after each row, ``last`` behind the last one."""
            nonlocal own, place, example, end, started
            out = []
            convs, roles, sizes = (batch.column(i).to_pylist() for i in (0, 2, 4))
            for now, after_it, kind, size in zip(convs, following, roles, sizes):
                if not started or now != own:
                    own, place, example, end, started = now, 0, 0, 0, True
                start, place, end = end, place + 1, end + size
                if kind == TARGET:
                    example += 1
                    out.append((place, example, end, start + before, end - after))
                elif after_it is last or after_it != now:
                    example += 1
                    out.append((place, example, end, end, end))
                else:
                    out.append((place, None, None, None, None))
            columns = [pa.array(c, pa.int64()) for c in zip(*out)]
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            # A batch's last row waits: only the next row tells whether its conversation ends.
            if held is not None:
                yield placed(held, [batch.column(0)[0].as_py()])
            if batch.num_rows > 1:
                yield placed(batch.slice(0, batch.num_rows - 1), batch.column(0).slice(1).to_pylist())
            held = batch.slice(batch.num_rows - 1)
        if held is not None:
            yield placed(held, [last])

    return ordered.mapInArrow(run, schema)


def expand(rows: DataFrame, longest: int = 1 << 24) -> DataFrame:
    """``conv, example, text, mask_start, mask_end``: the whole text of every example.

    ``rows`` are those of ``examples`` in their order. A task holds the conversation it is in
    up to the last example; one of more than ``longest`` characters fails the job and has to
    be read from the pieces. The texts of a conversation of n turns grow with n * n.
    """
    read = rows.select("conv", "piece", "place", "example", "text_end", "mask_start", "mask_end")
    schema = T.StructType(
        [rows.schema["conv"], *(T.StructField(n, T.LongType()) for n in ("example", "mask_start", "mask_end"))]
    ).add("text", T.StringType())
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def written(made):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names=schema.names)

        text, made, size = "", [], 0
        for batch in batches:
            for conv, piece, place, example, end, *mask in zip(*(c.to_pylist() for c in batch.columns)):
                text = piece if place == 1 else text + piece
                if example is None:
                    continue
                if end > longest:
                    raise ValueError(f"an example of conversation {conv} has over {longest} characters")
                made.append((conv, example, *mask, text))
                size += len(text)
                if size >= _AT_ONCE:
                    yield written(made)
                    made, size = [], 0
        if made:
            yield written(made)

    return read.mapInArrow(run, schema)


def _said(rows: DataFrame):
    """Schema of what is read back, and a function that makes a batch of its rows."""
    schema = T.StructType(
        [
            rows.schema["conv"],
            *(T.StructField(n, T.StringType()) for n in ("turns_sha256", "loss_sha256")),
            *(T.StructField(n, T.LongType()) for n in _SUMS),
        ]
    )
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def table_of(done):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=schema.names)

    return schema, table_of


def read_back(rows: DataFrame) -> DataFrame:
    """What the formatted rows say, per conversation: ``conv, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_examples, rendered_chars``.

    Roles and texts are read from the pieces, trained text from the masks. ``rows`` are those
    of ``examples`` in their order; a digest runs through a conversation in batches.
    """
    role, text = read_piece(F.col("piece"))
    # A mask lies in the piece that ends its example.
    under = F.substring(
        "piece", F.col("mask_start") - F.col("text_end") + F.col("chars") + 1, F.col("mask_end") - F.col("mask_start")
    )
    said = F.concat(role, F.lit("\n"), text, F.lit("\n"))
    loss = F.when(F.col("mask_end") > F.col("mask_start"), unescape(under))
    read = rows.select(
        "conv",
        said.cast("binary").alias("said"),
        loss.cast("binary").alias("loss"),
        F.coalesce(F.length(loss), F.lit(0)).cast("long").alias("loss_chars"),
        F.coalesce("text_end", F.lit(0)).alias("text_end"),
        F.col("example").isNotNull().cast("long").alias("example"),
        "chars",
    )
    schema, table_of = _said(rows)

    def run(batches: Iterator) -> Iterator:
        import hashlib

        own, turns, lost, counts = None, None, None, [0] * len(_SUMS)
        for batch in batches:
            done = []
            for conv, words, loss, *numbers in zip(*(c.to_pylist() for c in batch.columns)):
                if turns is None or conv != own:
                    if turns is not None:
                        done.append((own, turns.hexdigest(), lost.hexdigest(), *counts))
                    own, turns, lost, counts = conv, hashlib.sha256(), hashlib.sha256(), [0] * len(_SUMS)
                turns.update(words)
                if loss is not None:
                    lost.update(loss)
                counts = [a + b for a, b in zip(counts, (1, *numbers))]
            if done:
                yield table_of(done)
        if turns is not None:
            yield table_of([(own, turns.hexdigest(), lost.hexdigest(), *counts)])

    return read.mapInArrow(run, schema)


def read_examples(texts: DataFrame) -> DataFrame:
    """What the examples' whole texts say, per conversation: the columns of ``read_back``.

    ``texts`` are those of ``expand`` in their order. Trained text is what lies under the mask of
    each example's text. Every example has to begin with the one before it, so the turns are read
    from the last one; a task holds two texts beside its batch.
    """
    schema, table_of = _said(texts)

    def run(batches: Iterator) -> Iterator:
        import hashlib

        own, whole, lost, loss_chars, formatted, count = None, "", None, 0, 0, 0

        def closed():
            said, turns = read_text(whole), hashlib.sha256()
            for role, words in said:
                turns.update(f"{role}\n{words}\n".encode())
            return (own, turns.hexdigest(), lost.hexdigest(), len(said), loss_chars, formatted, count, len(whole))

        for batch in batches:
            done = []
            for conv, example, start, end, text in zip(*(c.to_pylist() for c in batch.columns)):
                if example == 1:
                    if count:
                        done.append(closed())
                    own, whole, lost, loss_chars, formatted, count = conv, "", hashlib.sha256(), 0, 0, 0
                if conv != own or example != count + 1 or not text.startswith(whole):
                    raise ValueError(f"example {example} of conversation {conv} doesn't continue the one before it")
                trained = _unescaped(text[start:end])
                lost.update(trained.encode())
                whole, loss_chars, formatted, count = text, loss_chars + len(trained), formatted + len(text), example
            if done:
                yield table_of(done)
        if count:
            yield table_of([closed()])

    return texts.select("conv", "example", "mask_start", "mask_end", "text").mapInArrow(run, schema)


def with_planted(turns: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose two turns are made of control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    planted = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        said.alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(planted)


def _escape_sql(text: str) -> str:
    heads = {}
    for c in CONTROL:
        heads.setdefault(c[0], []).append(re.escape(c[1:]))
    pattern = "|".join(f"({re.escape(h)})({'|'.join(rest)})" for h, rest in heads.items())
    kept = "".join(f"\\{2 * i + 1}" for i in range(len(heads)))
    rest = "".join(f"\\{2 * i + 2}" for i in range(len(heads)))
    return f"regexp_replace(replace({text}, '\\', '\\\\'), '{pattern}', '{kept}\\\\{rest}', 'g')"


def _piece_sql() -> str:
    cases = " ".join(
        f"WHEN '{name}' THEN '{before}' || {_escape_sql('text')} || '{after}'"
        for name, (before, after) in TEMPLATE.items()
    )
    other = f"'[ROLE]' || {_escape_sql('role')} || '[/ROLE]' || {_escape_sql('text')} || '[/TURN]'"
    return f"CASE role {cases} ELSE {other} END"


OP11_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, {_piece_sql()} AS piece FROM t),
c AS (SELECT *, sum(length(piece)) OVER w AS text_end, lead(1) OVER w IS NULL AS final FROM p
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, piece ROWS UNBOUNDED PRECEDING))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, piece)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{TARGET}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, piece) FILTER (WHERE role = '{TARGET}'), '')) AS loss_sha256,
  CAST(sum(text_end) FILTER (WHERE role = '{TARGET}' OR final) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (WHERE role = '{TARGET}' OR final) AS BIGINT) AS n_examples,
  CAST(sum(length(piece)) AS BIGINT) AS rendered_chars
FROM c GROUP BY conv_id"""


@query(sql=OP11_SQL)
def op11_prefix_targets(spark, sf_dir):
    """All conversations as one example per reply, each with its whole text, and what these say when read back."""
    turns = with_planted(table(spark, sf_dir, "conversations"))
    written = expand(examples(turns, "conv_id", "turn", "role", "text"), _LONGEST)
    return read_examples(written).withColumnRenamed("conv", "conv_id")
