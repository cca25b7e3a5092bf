"""Chat formatting: records of any layout to canonical turns, then to marked text.

A record's schema fingerprint is a hash of its nested field paths, such as
``messages[].role``. Declarative layouts say which paths hold roles and texts;
each is known under the fingerprints of all its forms, so a record finds its
layout by one look-up. Turns are rendered one by one, so a conversation of any
length is a run of rows whose texts, joined in order, are the formatted
conversation; each row says which span of it carries loss.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Fields that describe a record and take no part in its fingerprint.
DESCRIPTIVE = frozenset({"id", "source", "metadata", "meta", "created", "license", "lang"})
#: Other names of roles; names not listed stay as they are.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Part:
    """Turns found at one place: under each element of ``each``, or once.

    ``texts`` are paths whose non-empty values are joined by a blank line;
    ``role`` is a path, or with ``says`` a fixed name. Paths in ``optional`` may
    be absent.
    """

    texts: tuple[str, ...]
    role: str | None = None
    says: str | None = None
    each: str | None = None
    optional: frozenset[str] = frozenset()
    aliases: bool = True


@dataclass(frozen=True)
class Layout:
    """A named way to lay out a record: its parts in the order of the turns.

    ``maybe`` numbers the parts that may be absent as a whole.
    """

    name: str
    parts: tuple[Part, ...]
    others: tuple[str, ...] = ()
    maybe: frozenset[int] = frozenset()

    def fingerprints(self) -> set[str]:
        found = set()
        for gone in _subsets(sorted(self.maybe)):
            parts = [p for i, p in enumerate(self.parts) if i not in gone]
            if not parts:
                continue
            free = sorted({(p.each, o) for p in parts for o in p.optional}, key=str)
            for absent in _subsets(free):
                paths = set(self.others)
                for p in parts:
                    here = [x for x in (*p.texts, p.role) if x and (p.each, x) not in absent]
                    paths |= {f"{p.each}[].{x}" if p.each else x for x in here}
                found.add(fingerprint_of(paths))
            if all(p.each for p in parts):  # lists without elements
                found.add(fingerprint_of({f"{p.each}[]" for p in parts} | set(self.others)))
        return found


def _subsets(items: Sequence) -> Iterator[set]:
    for n in range(len(items) + 1):
        yield from map(set, itertools.combinations(items, n))


LAYOUTS = (
    Layout("row", (Part(("text",), role="role", aliases=False),)),
    Layout("message", (Part(("content",), role="role"),)),
    Layout("speaker", (Part(("value",), role="from"),)),
    Layout("messages", (Part(("content",), role="role", each="messages"),)),
    Layout("message_parts", (Part(("content[].text",), role="role", each="messages"),), others=("messages[].content[].type",)),
    Layout("conversations", (Part(("value",), role="from", each="conversations"),)),
    Layout("turn_list", (Part(("text",), role="role", each="turns"),)),
    Layout("prompt", (Part(("system",), says="system"), Part(("prompt",), says="user"), Part(("response",), says="assistant")), maybe=frozenset({0, 1, 2})),
    Layout("completion", (Part(("prompt",), says="user"), Part(("completion",), says="assistant")), maybe=frozenset({0})),
    Layout("question", (Part(("question",), says="user"), Part(("answer",), says="assistant")), maybe=frozenset({1})),
    Layout("instruction", (Part(("instruction", "input"), says="user", optional=frozenset({"input"})), Part(("output",), says="assistant")), maybe=frozenset({0, 1})),
    Layout("pairs", (Part(("user",), says="user", each="history"), Part(("assistant",), says="assistant", each="history"))),
)


def fingerprint_of(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def field_paths(value, ignored: frozenset[str] = DESCRIPTIVE) -> set[str]:
    """Nested paths of all leaves; a list adds ``[]``, an empty object or list is a leaf."""
    found: set[str] = set()
    todo = [(value, "")]
    while todo:
        here, path = todo.pop()
        if isinstance(here, dict) and here:
            todo += [(v, f"{path}.{k}" if path else k) for k, v in here.items() if path or k not in ignored]
        elif isinstance(here, list) and here:
            todo += [(v, f"{path}[]") for v in here]
        else:
            found.add(path + ("[]" if isinstance(here, list) else ""))
    return found


@dataclass
class Registry:
    """Layouts by fingerprint; of two layouts with one fingerprint the first holds."""

    layouts: Sequence[Layout] = LAYOUTS
    known: dict[str, Layout] = field(default_factory=dict)

    def __post_init__(self):
        for layout in self.layouts:
            for mark in layout.fingerprints():
                self.known.setdefault(mark, layout)


def _texts(value, path: str) -> list[str]:
    here = [value]
    for name in path.split("."):
        name, many = name.removesuffix("[]"), name.endswith("[]")
        here = [v.get(name) for v in here if isinstance(v, dict)]
        if many:
            here = [x for v in here if isinstance(v, list) for x in v]
    return [v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in here if v is not None]


def turns_of(record: dict, layout: Layout) -> list[tuple[str | None, str]]:
    """Role and text of each turn; lists that several parts share are read side by side."""
    found: list[tuple[int, int, str | None, str]] = []
    for no, part in enumerate(layout.parts):
        items = _list(record, part.each) if part.each else [record]
        for at, item in enumerate(items):
            if not part.each and not any(_there(item, t) for t in part.texts):
                continue
            role = part.says if part.says is not None else next(iter(_texts(item, part.role)), None)
            role = ROLE_NAMES.get(role, role) if part.aliases else role
            text = "\n\n".join(t for p in part.texts if (t := "".join(_texts(item, p))))
            found.append((at if part.each else 0, no, role, text))
    return [(role, text) for _, _, role, text in sorted(found, key=lambda f: f[:2])]


def _list(record, path: str) -> list:
    here = record
    for name in path.split("."):
        here = here.get(name) if isinstance(here, dict) else None
    return here if isinstance(here, list) else []


def _there(record, path: str) -> bool:
    return isinstance(record, dict) and path.split(".")[0].removesuffix("[]") in record


def canonical_turns(records: DataFrame, keys: list[str], record_col: str, layouts: Sequence[Layout] = LAYOUTS, ignored: frozenset[str] = DESCRIPTIVE) -> DataFrame:
    """``keys, part, role, text, layout, fingerprint``: a row per turn of each JSON record.

    ``part`` counts a record's turns from 0; a record with an empty list of
    turns gives no row. A null text is an empty one, a null role stays null. A
    record of no known layout, null, or no JSON object is one row with null
    layout, part, role and text (and a null fingerprint where it is no object),
    so none is lost. Repeated records are converted each. Keys are passed on as
    they are, other columns are not read. A narrow map; one record at a time is
    held as Python objects, whatever its length.
    """
    kept = records.select(*keys, F.col(record_col).cast("string").alias("__record"))
    taken = [c for c in keys if c in ("part", "role", "text", "layout", "fingerprint")]
    if taken:
        raise ValueError(f"rename key columns {taken}")
    schema = StructType(
        [*kept.schema.fields[:-1], StructField("part", LongType())] + [StructField(c, StringType()) for c in ("role", "text", "layout", "fingerprint")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Registry(layouts).known
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                source, rows = [], []
                for i, text in enumerate(part.column(len(keys)).to_pylist()):
                    try:
                        record = json.loads(text) if text is not None else None
                    except ValueError:
                        record = None
                    mark = fingerprint_of(field_paths(record, ignored)) if isinstance(record, dict) else None
                    layout = known.get(mark)
                    made = [(None, None, None, None, mark)] if layout is None else [(n, role, said, layout.name, mark) for n, (role, said) in enumerate(turns_of(record, layout))]
                    source += [i] * len(made)
                    rows += made
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                at = pa.array(source, pa.int32())
                kinds = [pa.int64()] + [pa.string()] * 4
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(j).take(at) for j in range(len(keys))), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names
                )

    return kept.mapInArrow(run, schema)


@dataclass(frozen=True)
class Template:
    """Marks around a turn. Every mark starts with ``<|``, which escaped texts never hold."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    after_turn: str = "\n"
    learns: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if not (self.start.startswith("<|") and self.end.startswith("<|")) or "<|" in self.after_turn or not self.after_role.startswith("\n"):
            raise ValueError("marks start with <|, the role ends at a line break")


CHATML = Template()


def escaped(text: Column) -> Column:
    """Puts one more backslash between ``<`` and ``|``, so no ``<|`` is left; other text stays as it is."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    """A role as one line: backslashes and line breaks are written as two characters."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    pieces = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_turns(turns: DataFrame, keys: list[str], template: Template = CHATML) -> DataFrame:
    """``keys, segment, loss_start, loss_length``: each turn marked up.

    A conversation's segments in order are its formatted text. The loss span is
    counted in code points of the segment, from 0; turns of roles that do not
    learn have length 0. Null roles and texts are written as empty. Rows without
    a layout (see ``canonical_turns``) are no turns and left out. Built-in
    functions only.
    """
    kept = turns.where(F.col("layout").isNotNull()) if "layout" in turns.columns else turns
    head = F.concat(F.lit(template.start), _role_out(F.coalesce("role", F.lit(""))), F.lit(template.after_role))
    body = escaped(F.coalesce("text", F.lit("")))
    learns = F.coalesce(F.col("role").isin(*template.learns), F.lit(False))
    return kept.select(*keys, head.alias("__head"), body.alias("__body"), learns.alias("__learns")).select(
        *keys,
        F.concat("__head", "__body", F.lit(template.end + template.after_turn)).alias("segment"),
        F.length("__head").alias("loss_start"),
        F.when(F.col("__learns"), F.length("__body")).otherwise(0).alias("loss_length"),
    )


def read_turns(segments: DataFrame, template: Template = CHATML) -> DataFrame:
    """``role, text, learnt, n_chars`` (and the other columns) read back from segments.

    ``learnt`` is the unescaped text under the loss span, null where there is
    none. A segment without the template's marks raises.
    """
    tail = template.end + template.after_turn
    seg = F.col("segment")
    good = seg.startswith(template.start) & seg.endswith(tail) & (F.instr(seg, "\n") > 0)
    checked = F.when(good, seg).otherwise(F.raise_error(F.concat(F.lit("no turn: "), F.substring(seg, 1, 80))))
    others = [c for c in segments.columns if c not in ("segment", "loss_start", "loss_length")]
    inner = segments.select(*others, "loss_start", "loss_length", checked.alias("segment")).withColumn("__at", F.instr("segment", template.after_role))
    first = len(template.start) + 1
    role = F.substring(seg, F.lit(first), F.col("__at") - first)
    begin = F.col("__at") + len(template.after_role)
    text = F.substring(seg, begin, F.length(seg) - len(tail) - begin + 1)
    return inner.select(
        *others,
        _role_in(role).alias("role"),
        unescaped(text).alias("text"),
        F.when(F.col("loss_length") > 0, unescaped(F.substring(seg, F.col("loss_start") + 1, F.col("loss_length")))).alias("learnt"),
        F.length(seg).cast("long").alias("n_chars"),
    )


def digests(turns: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` per conversation.

    Takes what ``read_turns`` returns. Turns go by ``order``, nulls first, then
    by role and text. A null key is a conversation of its own. SHA-256 reads one
    byte after another, so a conversation passes through one task; it streams
    through in sorted order and is never held, whatever its length.
    """
    kept = turns.select(F.col(key), *order, "role", "text", F.coalesce("learnt", F.lit("")).alias("learnt"), "n_chars")
    dealt = kept.repartition(key).sortWithinPartitions(key, *order, "role", "text").select(key, "role", "text", "learnt", "n_chars")
    schema = StructType(
        [kept.schema.fields[0], StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType())]
        + [StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, said, learnt, turns, loss, chars = None, None, None, 0, 0, 0
        for batch in batches:
            done: list[tuple] = []
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                for k, role, text, under, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if said is None or k != now:
                        if said is not None:
                            done.append((now, turns, said.hexdigest(), loss, learnt.hexdigest(), chars))
                        now, said, learnt, turns, loss, chars = k, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                    said.update(f"{role}\n{text}\n".encode())
                    learnt.update(under.encode())
                    turns, loss, chars = turns + 1, loss + len(under), chars + n
            yield _rows(done)
        if said is not None:
            yield _rows([(now, turns, said.hexdigest(), loss, learnt.hexdigest(), chars)])

    kinds = [to_arrow_type(kept.schema.fields[0].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

    return dealt.mapInArrow(run, schema)
