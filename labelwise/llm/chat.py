"""Chat formatting by rendering successive turn prefixes with a template that is a black box.

The template is any function from a list of turns to a string.  What prefix ``k`` adds to prefix ``k - 1`` is
turn ``k``'s span; a template whose output for a prefix does not start with its output for the shorter one
rewrites history, and the turn that shows it is reported.  Where a turn's own text lies within its span is
found by rendering the turn with a marker character for a text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwise.llm import common

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
#: A turn without its marks: the role up to the first line break that is not escaped, and the text.
TURN = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"
MARKERS = ("\ue000", "\ue001")
SCHEMA = (
    "conv_id long, formatted string, spans array<struct<start:int,end:int>>, "
    "texts array<struct<start:int,end:int>>, loss array<struct<start:int,end:int>>, rewritten_at int"
)


def escape(text: str) -> str:
    """No ``<|`` is left, so no control string can be; ``unescape`` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def chat_template(turns: Sequence[Turn]) -> str:
    """``<|im_start|>role`` / text ``<|im_end|>`` blocks, with line breaks in a role escaped too."""
    return "".join(START + escape(role).replace("\n", "\\\n") + "\n" + escape(text) + END + "\n" for role, text in turns)


def locate(turns: Sequence[Turn], template: Template) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], int | None]:
    """The rendered conversation, each turn's span, where its text lies in it, and the first turn that rewrites history.

    A template that rewrites history, or drops or repeats a turn's text, has no spans from that turn on.
    """
    spans: list[tuple[int, int]] = []
    texts: list[tuple[int, int]] = []
    before, rewritten = template([]), None
    for k, (role, text) in enumerate(turns):
        now = template(turns[: k + 1])
        if rewritten is None:
            marker = next(m for m in (*MARKERS, "\x00") if m not in role and m not in before)
            marked = template([*turns[:k], (role, marker)])
            if not (now.startswith(before) and marked.startswith(before) and marked.count(marker) == 1):
                rewritten = k
            else:
                at = marked.index(marker)
                until = len(now) - (len(marked) - at - 1)
                if until < at or now[:at] != marked[:at] or now[until:] != marked[at + 1 :]:
                    rewritten = k
                else:
                    spans.append((len(before), len(now)))
                    texts.append((at, until))
        before = now
    return before, spans, texts, rewritten


def _render(template: Template, roles: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = (pa.string(), pairs, pairs, pairs, pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for turns in batch.column(1)[at : at + 64].to_pylist():
                    said = [(t["role"] or "", t["text"] or "") for t in turns]
                    formatted, spans, texts, rewritten = locate(said, template)
                    loss = [p for (role, _), p in zip(said, texts) if role in roles]
                    out.append((formatted, *([{"start": a, "end": b} for a, b in x] for x in (spans, texts, loss)), rewritten))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + 64], *columns], names=["conv_id", "formatted", "spans", "texts", "loss", "rewritten_at"]
                )

    return run


def write(
    turns: DataFrame,
    path: str,
    template: Template = chat_template,
    trained_roles: Sequence[str] = ("assistant",),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> None:
    """Format every conversation (its rows by turn, then role and text; null role or text: empty) and write Parquet.

    Columns: conv_id, formatted, spans of the turns, places of their texts, ``loss`` (the places that training
    counts: texts of ``trained_roles``), ``rewritten_at`` (index of the first turn at which the template
    rewrote history; null if none).  Places are in code points.  Rows with a null conversation make one
    conversation of their own; repeated rows are turns of their own.  A formatted conversation is one value
    of one row, so its turns meet in one task, like any text.
    """
    rows = common.narrow(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    talks = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    talks.mapInArrow(_render(template, frozenset(trained_roles)), SCHEMA).write.option("compression", "zstd").parquet(path)


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per conversation, read back from the output of ``chat_template`` alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars."""
    rows = spark.read.parquet(path)
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")
    bodies = F.transform(blocks, lambda b: F.substring(b, len(START) + 1, 1 << 30))
    said = F.transform(
        bodies, lambda b: F.concat(*[x for k in (1, 2) for x in (_plain(F.regexp_extract(b, TURN, k)), F.lit("\n"))])
    )
    heard = F.array_join(F.transform("loss", lambda p: _plain(F.col("formatted").substr(p["start"] + 1, p["end"] - p["start"]))), "")
    return rows.select("conv_id", "formatted", F.array_join(said, "").alias("said"), heard.alias("heard"), F.size(bodies).alias("n")).select(
        "conv_id",
        F.col("n").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("heard").cast("long").alias("loss_chars"),
        F.sha2("heard", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
