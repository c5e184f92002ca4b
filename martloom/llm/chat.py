"""Chat formatting with a grammar round trip.

Every turn is rendered between control strings, parsed again by the grammar, and compared with its source. Content that
holds a control string makes the two differ; it is then escaped, by one backslash after the control string's first
character, and the turn is rendered and parsed again.

    turn      = system | user | assistant | other
    system    = "<<SYS>>\\n" content "\\n<</SYS>>\\n"
    user      = "[INST] " content " [/INST]"
    assistant = "<s> " content " </s>"
    other     = "[ROLE]" content "[/ROLE] " content " </s>"
    content   = text without a control string; one backslash is taken from each escaped one
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import written

FRAMES = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
OTHER = ("[ROLE]", "[/ROLE] ", " </s>")
LEARNED = "assistant"  # the role under the loss mask
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>|/?ROLE\])"
_CONTROL = re.compile(CONTROL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def frame(role: str, content: str) -> tuple[str, int, int]:
    """A rendered turn and where its content stands."""
    if role in FRAMES:
        before, after = FRAMES[role]
    else:
        before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
    return before + content + after, len(before), len(before) + len(content)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """The turns of rendered text: role, unescaped content, and where the content stands. Anything else is a ValueError."""
    turns, at = [], 0

    def content(start: int, end: str) -> tuple[str, int]:
        stop = text.find(end, start)
        if stop < 0:
            raise ValueError(f"no {end!r} after {start}")
        if any(not m[2] for m in _CONTROL.finditer(text, start, stop)):
            raise ValueError(f"control string inside the content at {start}")
        return unescape(text[start:stop]), stop

    while at < len(text):
        for role, (before, after) in FRAMES.items():
            if text.startswith(before, at):
                start = at + len(before)
                break
        else:
            if not text.startswith(OTHER[0], at):
                raise ValueError(f"no turn begins at {at}")
            role, stop = content(at + len(OTHER[0]), OTHER[1])
            start, after = stop + len(OTHER[1]), OTHER[2]
        said, stop = content(start, after)
        turns.append((role, said, start, stop))
        at = stop + len(after)
    return turns


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn that parses back to itself. Null roles and texts are empty. Escaping is applied only where the plain form does not
    come back, and is enough: afterwards no control string is left in the content."""
    role, text = role or "", text or ""
    for content in (text, escape(text)):
        out, start, end = frame(role, content)
        try:
            if parse(out) == [(role, text, start, end)]:
                return out, start, end
        except ValueError:
            pass
    raise ValueError(f"a {role!r} turn does not come back")


def _rendered(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
    rows = [(*render(r, t), (r or "") == LEARNED) for r, t in zip(roles, texts)]
    return pd.DataFrame([(out, start if mine else -1, end if mine else -1) for out, start, end, mine in rows], columns=["formatted", "loss_start", "loss_end"])


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per turn: ``conv_id``, ``turn``, ``formatted``, and the span of it under the loss mask (-1 if none), in code points.

    A conversation's text is its rows' ``formatted`` by ``turn`` (null first), ties by ``formatted``; equal rows are turns of their own.
    Rows need no other row, so a conversation of any length spreads over tasks.
    """
    out = F.pandas_udf(_rendered, "formatted string, loss_start int, loss_end int")
    return conversations.select("conv_id", "turn", out("role", "text").alias("__out")).select("conv_id", "turn", "__out.*")


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and place. Only running hashes are held."""
    now, state = None, None

    def done() -> tuple:
        conv, turns, n, loss, chars, size = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

    for batch in batches:
        out = []
        for conv, text, start, end in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
            if state is None or conv != now:
                if state is not None:
                    out.append(done())
                now, state = conv, [conv, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, said, _, _ in parse(text):
                state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                state[2] += 1
            if start >= 0:
                said = unescape(text[start:end])
                state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(said)
            state[5] += len(text)
        if out:
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(_DIGEST.types)], schema=_DIGEST)
    if state is not None:
        yield pa.record_batch([pa.array([v], t) for v, t in zip(done(), _DIGEST.types)], schema=_DIGEST)


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from formatted turns. A digest takes a conversation's turns in order, so they
    pass through one task; it holds one batch of them and the running hashes."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "formatted", "loss_start", "loss_end")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return dealt.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


CONFLICT = "</s>[INST] ok [/INST]"


def report(conversations: DataFrame) -> DataFrame:
    """All conversations and one of conflicting texts, written formatted and read back."""
    spark = conversations.sparkSession
    extra = spark.createDataFrame([(-1, 0, "user", CONFLICT), (-1, 1, "assistant", CONFLICT)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(written(formatted(rows)))


# DuckDB strings hold backslashes as they are.
SQL = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{CONFLICT}' union all select -1, 1, 'assistant', '{CONFLICT}'
), e as (
  select *, regexp_replace(text, '{CONTROL}', '\1\\\2\3', 'g') as content, regexp_replace(role, '{CONTROL}', '\1\\\2\3', 'g') as other from t
), f as (
  select *, case role when 'system' then '<<SYS>>' || chr(10) || content || chr(10) || '<</SYS>>' || chr(10)
    when 'user' then '[INST] ' || content || ' [/INST]' when 'assistant' then '<s> ' || content || ' </s>'
    else '[ROLE]' || other || '[/ROLE] ' || content || ' </s>' end as formatted
  from e
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, formatted)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, formatted) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(formatted)) as bigint) as formatted_chars
from f group by conv_id
"""
