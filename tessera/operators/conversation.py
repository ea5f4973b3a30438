"""Chat history: recent turns as text, standalone questions, further phrasings."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

Model = Callable[[str], str]

REWRITE = """Somebody asks about source code, and the question may lean on what was said before. Turn it into one that a reader without the conversation would understand; a question that needs nothing from it comes back unchanged. Your reply is that question and nothing else, not its answer.

Conversation:
{history}

Question: {question}

Standalone question:"""

EXPAND = """A search over source code may miss the right file if it says things otherwise than the question does. List {n} short searches for the same thing in differing terms, identifiers among them: one a line, each with its number, and no other text.

Question: {question}
"""


def recent_turns(turns: DataFrame, most: int = 3, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conversation, history): the last ``most`` pairs of turns as lines ``User: ...`` and ``Assistant: ...``.

    0 pairs: all turns. Blank turns are left out after the cut; long ones are shortened to
    500 characters. Conversations with nothing left have an empty history.
    """
    last = Window.partitionBy(conversation).orderBy(F.col(order).desc())
    rows = turns if most == 0 else turns.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= 2 * most)
    line = F.when(T.not_blank("text"), F.concat(T.speaker("role"), F.lit(": "), T.shortened(F.regexp_replace("text", T.STRIP, ""))))
    lines = F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(F.col(order).alias("o"), line.alias("s"))))), lambda x: x["s"])
    return rows.groupBy(conversation).agg(F.array_join(lines, "\n").alias("history"))


def format_history(history: Sequence[dict], most: int = 3) -> str:
    """The same for one conversation on the driver."""
    rows = list(history)[-2 * most :] if most else list(history)
    out = []
    for r in rows:
        text = (r.get("content") or "").strip()
        if text:
            out.append(f"{'User' if r.get('role') == 'user' else 'Assistant'}: {text[:500] + '...' if len(text) > 500 else text}")
    return "\n".join(out)


def standalone(question: str, history: Sequence[dict] | None, model: Model, most: int = 3) -> str:
    """The question made standalone; without history, on an error or an empty reply it stays."""
    turns = format_history(history or [], most)
    if not turns:
        return question
    try:
        reply = model(REWRITE.format(history=turns, question=question))
    except Exception:
        return question
    return (reply or "").strip().strip('"').strip() or question


def parse_list(text: str, most: int) -> list[str]:
    """Items of a numbered, bulleted or plain list, ``most`` at most."""
    out = []
    for line in (text or "").splitlines():
        line = line.strip()
        if line and len(out) < most:
            found = re.match(r"^(?:\d+[.)]|[-*•])\s*(.+)$", line)
            item = (found[1] if found else line).strip().strip('"').strip()
            if item:
                out.append(item)
    return out


def expand(question: str, model: Model, n: int = 2) -> list[str]:
    """Up to ``n`` further phrasings, none of them the question or one another in other case; on an error none."""
    if n <= 0:
        return []
    try:
        found = parse_list(model(EXPAND.format(question=question, n=n)), n)
    except Exception:
        return []
    seen, out = {question.strip().lower()}, []
    for x in found:
        if x.lower() not in seen:
            seen.add(x.lower())
            out.append(x)
    return out


def expanded(rows: DataFrame, n: int, question: str = "question", reply: str = "reply", key: str = "query_id") -> DataFrame:
    """(key, variant, phrasing) for many questions at once: replies parsed, repeats and the question itself left out."""
    items = rows.select(key, question, F.posexplode(T.list_items(reply, n)).alias("pos", "phrasing"))
    low = F.lower("phrasing")
    first = Window.partitionBy(key, low).orderBy("pos")
    kept = items.where(low != F.lower(F.regexp_replace(question, T.STRIP, ""))).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select(key, F.row_number().over(Window.partitionBy(key).orderBy("pos")).alias("variant"), "phrasing")
