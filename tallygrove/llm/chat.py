"""Chat records of many layouts as canonical turns, formatted with a loss mask, and read back.

A record is a JSON text. The hash of its sorted nested field paths, its fingerprint, selects a declarative mapping; a
mapping says which fields hold roles and texts. A new layout is a new mapping, not new code.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

Turns = list[tuple[str, str]]


def field_paths(record: object, at: str = "") -> set[str]:
    """Paths of all fields: names joined by dots (a dot in a name is escaped), ``[]`` for the elements of a list."""
    if isinstance(record, dict) and record:
        names = ((f"{at}." if at else "") + k.replace("\\", "\\\\").replace(".", "\\.") for k in record)
        return set().union(*(field_paths(v, n) for n, v in zip(names, record.values())))
    if isinstance(record, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in record)) if record else {f"{at}[]"}
    return {at}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """How a layout's fields become turns.

    Either ``turns`` names a list whose elements hold ``role`` and ``text``, or ``fields`` lists (role, field names) in
    order, the texts of a turn's fields joined by an empty line. ``roles`` renames roles; ``optional`` paths may be absent.
    """

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> Iterator[str]:
        if self.turns:
            must = {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}
            yield fingerprint({f"{self.turns}[]"})  # no turns
        else:
            must = {name for _, names in self.fields for name in names} - set(self.optional)
        for n in range(len(self.optional) + 1):
            for more in itertools.combinations(self.optional, n):
                yield fingerprint(must | set(more))

    def apply(self, record: dict) -> Turns:
        if self.turns:
            found = [(_text(x.get(self.role)), _text(x.get(self.text))) for x in record[self.turns]]
        else:
            parts = [(role, [_text(record[n]) for n in names if n in record]) for role, names in self.fields]
            found = [(role, "\n\n".join([texts[0], *filter(None, texts[1:])])) for role, texts in parts if texts]
        return [(self.roles.get(r, r), t) for r, t in found]


def _text(value: object) -> str:
    """A null is empty, a text itself, anything else its JSON."""
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


MAPPINGS = (
    Mapping("messages", turns="messages", role="role", text="content"),
    Mapping("from_value", turns="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("prompt", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping("completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(
        "instruction",
        fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
        optional=("system", "input"),
    ),
)


@dataclass(frozen=True)
class Template:
    """Marks of a turn; ``controls`` are all strings that a text must not be able to forge."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned: str = "assistant"  # the role whose texts the loss covers

    def escape(self, text: str) -> str:
        """Backslashes are doubled, and one is put after the first character of each control string."""
        marks = "|".join(map(re.escape, self.controls))
        return re.sub(marks, lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))

    def format(self, turns: Turns) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the code point spans that the loss covers: each learned text, without marks."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head = self.open + self.escape(role).replace("\n", "\\\n") + "\n"
            body = self.escape(text)
            if role == self.learned:
                spans.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, self.close, "\n"]
            at += len(head) + len(body) + len(self.close) + 1
        return "".join(parts), spans

    def parse(self, formatted: str) -> Turns:
        """The turns of a formatted text."""
        turns = []
        for part in formatted.split(self.close + "\n")[:-1]:
            head = re.match(r"(?:\\.|[^\\\n])*\n", part[len(self.open) :], re.DOTALL)
            if not part.startswith(self.open) or head is None:
                raise ValueError("not a formatted conversation")
            turns.append((unescape(head[0][:-1]), unescape(part[len(self.open) + head.end() :])))
        return turns


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_records(records: DataFrame, key: str, record: str, mappings: tuple[Mapping, ...] = MAPPINGS, template: Template = Template()) -> DataFrame:
    """``key``, ``layout``, ``fingerprint``, ``formatted``, ``spans`` of every row; ``record`` names the JSON column.

    A record that is null or no JSON has no fingerprint; one whose fingerprint no mapping has keeps it; both have a null
    layout, text and spans. Two mappings with a common fingerprint are an error. Other columns are not read.
    """
    by_print: dict[str, Mapping] = {}
    for m in mappings:
        for f in m.fingerprints():
            if f in by_print:
                raise ValueError(f"{m.name} and {by_print[f].name} have the same fields")
            by_print[f] = m

    def one(text: str | None) -> tuple:
        try:
            value = json.loads(text or "")
        except ValueError:
            return None, None, None, None
        mark = fingerprint(field_paths(value))
        if mark not in by_print:
            return None, mark, None, None
        formatted, spans = template.format(by_print[mark].apply(value))
        return by_print[mark].name, mark, formatted, [{"start": a, "stop": b} for a, b in spans]

    made = DataType.fromDDL("layout string, fingerprint string, formatted string, spans array<struct<start:long,stop:long>>")
    schema = StructType([records.schema[key], *made.fields])
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = list(zip(*map(one, part.column("_record").to_pylist())))
                columns = [pa.array(x, t) for x, t in zip(found, (pa.string(), pa.string(), pa.string(), spans_type))]
                yield pa.RecordBatch.from_arrays([part.column(key), *columns], [key, "layout", "fingerprint", "formatted", "spans"])

    return records.select(F.col(key), F.col(record).cast("string").alias("_record")).mapInArrow(work, schema)


def read_back(formatted: DataFrame, key: str, template: Template = Template()) -> DataFrame:
    """``key``, ``turns`` (array of role and text) and ``learned`` (texts under the mask, unescaped) of formatted rows."""
    made = DataType.fromDDL("turns array<struct<role:string,text:string>>, learned array<string>")
    schema = StructType([formatted.schema[key], *made.fields])
    turns_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def one(text: str | None, spans: list[dict] | None) -> tuple:
        if text is None:
            return None, None
        turns = [{"role": r, "text": t} for r, t in template.parse(text)]
        return turns, [unescape(text[s["start"] : s["stop"]]) for s in spans or []]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = list(zip(*map(one, part.column("formatted").to_pylist(), part.column("spans").to_pylist())))
                columns = [pa.array(x, t) for x, t in zip(found, (turns_type, pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([part.column(key), *columns], [key, "turns", "learned"])

    return formatted.select(key, "formatted", "spans").mapInArrow(work, schema)


def records_of_turns(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``record`` of a table of turns (conv_id, turn, role, text), each in the plainest layout that holds it.

    Turns go by ``turn``, then role and text; a null role or text is empty. Rows without a conv_id are one conversation.
    Two turns of user and assistant become a prompt, three with a system turn before them an instruction; others become a
    list, of messages or, where the id is odd and all roles are the usual ones, of from and value.
    """
    c = F.col
    said = F.struct(c("turn"), F.coalesce(c("role").cast("string"), F.lit("")).alias("role"), F.coalesce(c("text").cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    at = lambda i: F.get(c("t"), F.lit(i))["text"]
    usual = F.forall("t", lambda x: x["role"].isin("system", "user", "assistant")) & (F.pmod("conv_id", F.lit(2)) == 1)
    rename = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    named = lambda *names: roles == F.array(*map(F.lit, names))
    record = (
        F.when(named("user", "assistant"), F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))))
        .when(named("system", "user", "assistant"), F.to_json(F.struct(at(0).alias("system"), at(1).alias("instruction"), at(2).alias("output"))))
        .when(usual, F.to_json(F.struct(F.transform("t", lambda x: F.struct(rename(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"], x["text"].alias("content"))).alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))
