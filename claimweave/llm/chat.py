"""Chat formatting with DataFrame functions only.

Records come in many layouts (prompt and completion, instruction and output, lists of messages). The nested field
paths of a record, without their types, are hashed; that fingerprint selects a declarative layout, which says where turns,
roles and texts are. The canonical turns are then written with a template that marks turns, and control strings
inside texts are escaped reversibly. Character spans of assistant texts form the loss mask.

Template of a turn: ``### role: text</turn>`` and a line feed. The role is URL-encoded. In texts a backslash is
doubled, ``</turn>`` becomes ``<\\/turn>`` and a ``#`` before another gets a backslash after it, so neither ``</turn>`` nor
``##`` occurs in a written text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
TURNS = "array<struct<role: string, text: string>>"
LOSS_ROLE = "assistant"
#: Names that other layouts give to roles; fixed values.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Field paths as ``schema_of_variant`` shows them without types, and where the turns are.

    Either ``items`` names a list whose members have a role and a text field, or ``fields`` lists (role, fields): a
    turn whose text is these fields' non-empty values, joined by a blank line. A system turn without text is left out.
    """

    name: str
    paths: str
    items: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def turns(self, record: Column) -> Column:
        if self.items:
            kind = f"array<struct<{self.role}: string, {self.text}: string>>"
            found = F.coalesce(F.try_variant_get(record, f"$.{self.items}", kind), F.array().cast(kind))
            return F.transform(found, lambda m: F.struct(_known_role(m[self.role]).alias("role"), F.coalesce(m[self.text], F.lit("")).alias("text")))
        made = []
        for role, fields in self.fields:
            values = F.filter(F.array(*(F.try_variant_get(record, f"$.{f}", "string") for f in fields)), lambda x: F.length(x) > 0)
            text = F.array_join(values, "\n\n")
            made.append(F.when((F.size(values) > 0) | F.lit(role != "system"), F.struct(F.lit(role).alias("role"), text.alias("text"))))
        return F.filter(F.array(*made), lambda t: t.isNotNull())


LAYOUTS = (
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", "messages", "role", "content"),
    Layout("no messages", "OBJECT<messages: ARRAY>", "messages", "role", "content"),
    Layout("conversations", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "conversations", "from", "value"),
    Layout("dialog", "OBJECT<dialog: ARRAY<OBJECT<role, text>>>", "dialog", "role", "text"),
    Layout("instruction", "OBJECT<instruction, output>", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction with input", "OBJECT<input, instruction, output>", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt", "OBJECT<completion, prompt>", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", "OBJECT<prompt, response>", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system", "OBJECT<prompt, response, system>", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)


def _known_role(role: Column) -> Column:
    named = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
    return F.coalesce(named[role], role, F.lit(""))


def fingerprint(record: Column) -> Column:
    """Hash of a variant's nested field paths; types and nulls make no difference."""
    typed = F.schema_of_variant(record)
    bare = F.regexp_replace(typed, r"(: |<)(?!OBJECT|ARRAY)[A-Z_]+(\(\d+(,\s*\d+)?\))?", "$1")
    return F.xxhash64(F.regexp_replace(F.regexp_replace(bare, r": (?=[,>])", ""), "<>", ""))


def canonical(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with layout (a name) and turns, an array of (role, text).

    Records are variants. An unknown layout, a null record and a scalar give a null layout and null turns; no row is
    dropped. Null texts are empty, null roles are empty strings.
    """
    mark = fingerprint(F.col(record_col))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in reversed(layouts):
        on = F.col("_fingerprint") == F.xxhash64(F.lit(layout.paths))
        name, turns = F.when(on, F.lit(layout.name)).otherwise(name), F.when(on, layout.turns(F.col(record_col))).otherwise(turns)
    return records.withColumn("_fingerprint", mark).withColumns({"layout": name, "turns": turns}).drop("_fingerprint")


def escape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.regexp_replace(text, "#(?=#)", r"#\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\/#])", "$1")


def formatted(records: DataFrame, id_col: str) -> DataFrame:
    """(id, formatted, loss): each record's turns in the template and the loss mask, (first, size) in characters.

    ``records(id, turns)`` holds one row for each id; null turns and empty lists give an empty text without spans.
    """
    rows = records.select(F.col(id_col).alias("id"), F.posexplode_outer("turns").alias("pos", "turn"))
    head = F.concat(F.lit("### "), F.url_encode("turn.role"), F.lit(": "))
    rows = rows.select("id", "pos", (F.col("turn.role") == LOSS_ROLE).alias("learn"), head.alias("head"), escape(F.col("turn.text")).alias("body"))
    piece = F.concat("head", "body", F.lit(END))
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(piece)).over(before), F.lit(0)) + F.length("head")
    rows = rows.select("id", "pos", "learn", piece.alias("piece"), start.alias("first"), F.length("body").cast("long").alias("size"))
    turn = F.struct("pos", "piece", "learn", "first", "size")
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    span = F.transform(F.filter("t", lambda x: x.learn), lambda x: F.struct(x["first"].alias("first"), x["size"].alias("size")))
    text = F.array_join(F.transform("t", lambda x: x.piece), "")
    return whole.select(F.col("id").alias(id_col), F.coalesce(text, F.lit("")).alias("formatted"), span.alias("loss"))


def parsed(text: Column) -> Column:
    """The turns written in a formatted text."""
    pieces = F.filter(F.split(text, END, -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, ": ", 1)
        body = F.substr(piece, F.length(role) + 3)
        return F.struct(F.url_decode(F.substr(role, F.lit(5))).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def masked(text: Column, loss: Column) -> Column:
    """The unescaped text of each span of the loss mask."""
    return F.transform(loss, lambda s: unescape(F.substr(text, (s["first"] + 1).cast("int"), s["size"].cast("int"))))


def from_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, record): rows by turn as records with a list of messages, in order of turn, then role, then text.

    Repeated rows are turns of their own. A null turn number comes first; rows with a null id form one record.
    """
    message = F.struct(F.col(turn_col), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("content"))
    whole = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(message)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x.role.alias("role"), x.content.alias("content")))
    return whole.select(id_col, F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))


def digests(written: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Counts and SHA-256 digests read back from ``formatted`` and ``loss``."""
    read = written.select(id_col, "formatted", parsed(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("texts"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learnt = F.array_join("texts", "")
    return read.select(
        id_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
