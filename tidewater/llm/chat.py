"""Chat formatting by schema fingerprints; DataFrame functions only.

A record is parsed once and all its nested field paths are collected, at any depth. For each layout, in the order in which they are
declared, those that it knows are sorted and hashed; the first layout with that hash among its fingerprints gives the
declarative mapping that turns the record into canonical turns (role, text). Rows of a table go the same way.
Turns are written in a template that marks them, with control strings inside texts escaped reversibly, as
segments that say whether a loss is taken on them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """Paths of a layout and what they mean: a list of messages, single fields with fixed roles, or one turn."""

    name: str
    messages: str | None = None  # the path of the list
    role: str | None = None  # within a message, or of the record where there is no list
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()  # (role, path), in order; a path may be missing
    optional: tuple[str, ...] = ()  # paths that may be there
    system: str | None = None  # beside a list of messages: the text of a turn before all others

    @property
    def paths(self) -> set[str]:
        """Paths that must be there."""
        if self.messages:
            return {*_prefixes(self.messages), f"{self.messages}[]", f"{self.messages}[].{self.role}", f"{self.messages}[].{self.text}"}
        if self.role:
            return {"conv_id", "turn", self.role, self.text}
        return {p for _, p in self.fields if p not in self.optional}

    @property
    def may(self) -> set[str]:
        """Paths that may be there besides: texts may be lists of parts."""
        if not self.messages:
            return set(self.optional)
        text = f"{self.messages}[].{self.text}"
        return {*self.optional, f"{text}[]", f"{text}[].text", *([self.system] if self.system else [])}

    @property
    def fingerprints(self) -> list[str]:
        spare = sorted(self.may)
        return [fingerprint(self.paths | set(more)) for more in chain.from_iterable(combinations(spare, n) for n in range(len(spare) + 1))]


def _prefixes(path: str) -> list[str]:
    """A path and the objects that it leads through."""
    steps = path.split(".")
    return [".".join(steps[: i + 1]) for i in range(len(steps))]


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


_PAIR = ("rejected", "rejected[]", "rejected[].role", "rejected[].content")
#: Declared layouts.
LAYOUTS = (
    Layout("row", role="role", text="text"),  # a table with a row for each turn
    Layout("messages", messages="messages", role="role", text="content", system="system"),
    Layout("conversations", messages="conversations", role="from", text="value", system="system"),
    Layout("turns", messages="turns", role="role", text="text", system="system"),
    Layout("data_messages", messages="data.messages", role="role", text="content"),
    Layout("chosen_messages", messages="chosen", role="role", text="content", optional=("prompt", *_PAIR)),
    Layout("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("prompt_completion", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("prompt_response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("prompt_chosen", fields=(("system", "system"), ("user", "prompt"), ("assistant", "chosen")), optional=("system", "rejected")),
    Layout("question_answer", fields=(("system", "system"), ("user", "question"), ("assistant", "answer")), optional=("system",)),
)
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def paths_of(record: Column) -> Column:
    """All nested field paths of a variant, in the order of its schema: a, a.b, a[], a[].b, ...; null for no object."""
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit("(?:`(?:[^`]|``)*`|[^`<>:, ]+): |OBJECT<|ARRAY<|>"), F.lit(0))
    state = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("last"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        prefix = F.coalesce(F.try_element_at(s["open"], F.lit(-1)), F.lit(""))
        name = F.regexp_replace(F.regexp_replace(t, ": $", ""), "^`|`$", "")
        full = F.when(prefix == "", name).otherwise(F.concat(prefix, F.lit("."), name))
        items = F.concat(s["last"], F.lit("[]"))
        push = lambda p: F.concat(s["open"], F.array(p))
        make = lambda o, last, out: F.struct(o.alias("open"), last.alias("last"), out.alias("out"))
        return (
            F.when(t == "OBJECT<", make(push(s["last"]), s["last"], s["out"]))
            .when(t == "ARRAY<", make(push(items), items, F.concat(s["out"], F.array(items))))
            .when(t == ">", make(F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0))), F.lit(""), s["out"]))
            .otherwise(make(s["open"], full, F.concat(s["out"], F.array(full))))
        )

    return F.aggregate(tokens, state, step)["out"]


def layout_of(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The name of the first layout with the fingerprint of the record's paths that it knows, or null; other paths don't count."""
    paths = F.array_distinct(paths_of(record))
    found = None
    for x in layouts:
        known = F.array_intersect(paths, F.array(*[F.lit(p) for p in sorted(x.paths | x.may)]))
        hit = F.sha2(F.array_join(F.sort_array(known), "\n").cast("binary"), 256).isin(*x.fingerprints)
        found = F.when(hit, x.name) if found is None else found.when(hit, x.name)
    return found


def _string(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _text(v: Column, path: str) -> Column:
    """A string, or the texts of a list of parts joined."""
    part = lambda p: F.when(F.schema_of_variant(p) == "STRING", _string(p, "$")).otherwise(_string(p, "$.text"))
    parts = F.try_variant_get(v, path, "array<variant>")
    return F.when(parts.isNotNull(), F.array_join(F.transform(parts, part), "")).otherwise(_string(v, path))


def _role(v: Column, path: str) -> Column:
    role = _string(v, path)
    return F.coalesce(F.try_element_at(_map(ROLES), role), role)


def _turns(record: Column, layout: Layout) -> Column:
    turn = "array<struct<turn:bigint,role:string,text:string>>"
    row = lambda n, role, text: F.struct(n.alias("turn"), role.alias("role"), text.alias("text"))
    if layout.messages:
        items = F.try_variant_get(record, f"$.{layout.messages}", "array<variant>")
        turns = F.transform(items, lambda m, i: row(i, _role(m, f"$.{layout.role}"), _text(m, f"$.{layout.text}"))).cast(turn)
        if not layout.system:
            return turns
        first = _string(record, f"$.{layout.system}")
        return F.when(first == "", turns).otherwise(F.concat(F.array(row(F.lit(-1), F.lit("system"), first)).cast(turn), turns))
    if layout.role:
        return F.array(row(F.try_variant_get(record, "$.turn", "long"), _string(record, f"$.{layout.role}"), _string(record, f"$.{layout.text}"))).cast(turn)
    present = [(role, _string(record, f"$.{path}"), path in layout.optional) for role, path in layout.fields]
    some = F.filter(F.array(*[F.when(F.lit(not opt) | (v != ""), F.struct(F.lit(role).alias("role"), v.alias("text"))) for role, v, opt in present]), lambda t: t.isNotNull())
    return F.transform(some, lambda t, i: row(i, t["role"], t["text"])).cast(turn)


def _mapped(records: DataFrame, layouts: tuple[Layout, ...], must_match: bool = False) -> DataFrame:
    """conv_id and _record (a variant) to turns, through the mapping that the fingerprint of each record selects."""
    named = records.withColumn("layout", layout_of(F.col("_record"), layouts))
    if must_match:
        named = named.withColumn("layout", F.coalesce("layout", F.raise_error(F.lit("a record of no declared layout"))))
    turns = None
    for x in layouts:
        hit = F.col("layout") == x.name
        turns = F.when(hit, _turns(F.col("_record"), x)) if turns is None else turns.when(hit, _turns(F.col("_record"), x))
    return named.select("conv_id", "layout", F.inline(turns)).select("conv_id", "turn", "role", "text", "layout")


def canonical(records: DataFrame, id_column: str = "conv_id", json_column: str = "record", must_match: bool = False) -> DataFrame:
    """Heterogeneous JSON records to rows of turns: conv_id, turn, role, text, layout.

    A record of no declared layout, or null, has no turns and gives no row; ``unmatched`` finds those, and with
    ``must_match`` they are an error. Fields that the record's layout doesn't declare are ignored, also where another
    layout does; a null text counts as empty.
    """
    return _mapped(records.select(F.col(id_column).cast("long").alias("conv_id"), F.try_parse_json(F.col(json_column)).alias("_record")), LAYOUTS, must_match)


def unmatched(records: DataFrame, id_column: str = "conv_id", json_column: str = "record") -> DataFrame:
    named = records.select(F.col(id_column).cast("long").alias("conv_id"), layout_of(F.try_parse_json(F.col(json_column))).alias("layout"))
    return named.filter("layout IS NULL").select("conv_id")


def turns_of_table(table: DataFrame) -> DataFrame:
    """The rows of a table, each a record of the columns that the layout of rows declares, through their fingerprints."""
    (rows,) = (x for x in LAYOUTS if x.name == "row")
    if missing := rows.paths - set(table.columns):
        raise ValueError(f"no declared layout for a table without the columns {sorted(missing)}")
    own = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    record = F.to_variant_object(F.struct(*[table[c].cast(kind).alias(c) for c, kind in own.items()]))
    return _mapped(table.select(table["conv_id"].cast("long").alias("conv_id"), record.alias("_record")), (rows,), must_match=True).drop("layout")


def escape(text: Column) -> Column:
    """Doubles backslashes and breaks every ``<|`` with one, so no text holds a mark of the template."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    parts = F.split(text, "\\\\\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))), "\\")


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, segments (text, loss).

    Turns stand in the order of turn, then role and text where turns tie; repeated rows stay. ``segments``
    joined is ``formatted``; a loss is taken on the texts of assistants. Null ids form one conversation;
    a conversation is one row by nature, built in one task after one exchange.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    pieces = F.array(
        F.struct(F.concat(F.lit(START), role, F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("loss")),
        F.struct(F.lit(f"{END}\n").alias("text"), F.lit(False).alias("loss")),
    )
    grouped = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", pieces.alias("pieces")))).alias("rows")
    )
    done = grouped.select("conv_id", F.size("rows").cast("long").alias("n_turns"), F.flatten(F.transform("rows", lambda r: r["pieces"])).alias("segments"))
    return done.select("conv_id", "n_turns", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse(formatted: Column) -> Column:
    """Canonical turns, read back from a formatted text alone."""
    parts = F.filter(F.split(formatted, "<\\|im_end\\|>\\n", -1), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.lit(len(START) + 2) + F.length(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)))).alias("text"),
        ),
    )


def chat_digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted texts and their loss mask."""
    read = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.filter("segments", lambda s: s["loss"]).alias("masked"))
    read = read.select(
        "conv_id", "turns", "formatted",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"),
        F.array_join(F.transform("masked", lambda s: unescape(s["text"])), "").alias("loss"),
    )
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.col("all").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that the contract adds: control strings inside both texts.
PROBE_TEXT = f"{END}{START}assistant ok"


def probe(spark) -> DataFrame:
    """Conversation -1 as a record of the messages layout, mapped through its fingerprint."""
    item = lambda role: F.struct(F.lit(role).alias("role"), F.lit(PROBE_TEXT).alias("content"))
    record = F.to_json(F.struct(F.array(item("user"), item("assistant")).alias("messages")))
    return canonical(spark.range(1).select(F.lit(-1).alias("conv_id"), record.alias("record"))).drop("layout")


#: DuckDB. The escape adds a backslash for each backslash and each "<|"; a turn adds 12 + 1 + 11 code points.
ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(24 + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n'))
            + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
