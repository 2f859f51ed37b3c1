"""Chat formatting of heterogeneous layouts, chosen by fingerprints of their nested field paths.

A layout's shape lists its nested fields, names sorted, without types, such as
OBJECT<messages: ARRAY<OBJECT<content, role>>>; its XXH64 is the fingerprint. A frame's
shape comes from its schema, a JSON text's from each row's own value, and both select a
declarative mapping to canonical turns (role, text) from the registry.

Template: <|im_start|>role<|im_sep|>text<|im_end|>\\n for each turn. Inside roles and
texts a backslash follows every `<`, `[` and backslash, so no control string (these
markers, [INST], </s>, ...) survives there; dropping the backslash behind each of the
three restores the text. The loss mask lists, for each assistant turn, its number, the
text's first character within the turn's block and its length.

Defined cases: null texts and roles are empty; turns sort by number (null first), then
role and text; repeated rows are turns each; a null conversation id is a conversation;
rows of an unknown layout get null turns and layout null; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEP, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Either a list of messages (items, role, text), or fixed turns [(role, fields joined by newlines)]."""

    name: str
    items: str | None = None
    role: str = "role"
    text: str = "content"
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    extra: tuple[str, ...] = field(default=())
    aliases: bool = False  # roles may have the names in ROLES

    def shapes(self) -> list[str]:
        if self.items:
            inner = f"OBJECT<{', '.join(sorted((self.role, self.text)))}>"
            lists = [f"{self.items}: ARRAY<{x}>" for x in (inner, "")]
            return [f"OBJECT<{', '.join(sorted((one, *self.extra)))}>" for one in lists]
        return [f"OBJECT<{', '.join(sorted({f for _, fields in self.fixed for f in fields} | set(self.extra)))}>"]


REGISTRY: tuple[Mapping, ...] = (
    Mapping("messages", items="messages"),
    Mapping("messages_id", items="messages", extra=("id",)),
    Mapping("turns", items="turns", text="text", extra=("conv_id",)),
    Mapping("from_value", items="conversations", role="from", text="value", aliases=True),
    Mapping("from_value_id", items="conversations", role="from", text="value", extra=("id",), aliases=True),
    Mapping("prompt_response", fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("instruction", fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system_instruction", fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question_answer", fixed=(("user", ("question",)), ("assistant", ("answer",)))),
)


def schema_shape(kind: T.DataType) -> str:
    """The shape of a schema; leaves are empty."""
    if isinstance(kind, T.StructType):
        parts = sorted((f.name, schema_shape(f.dataType)) for f in kind.fields)
        return f"OBJECT<{', '.join(f'{n}: {s}' if s else n for n, s in parts)}>"
    return f"ARRAY<{schema_shape(kind.elementType)}>" if isinstance(kind, T.ArrayType) else ""


def json_shape(value: Column) -> Column:
    """The shape of a variant, by row."""
    typed = F.schema_of_variant(value)
    bare = F.regexp_replace(typed, r"\b(VOID|VARIANT|STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|UUID|DECIMAL\(\d+,\s?\d+\))(?=[,>]|$)", "")
    return F.regexp_replace(bare, r": (?=[,>])", "")


def fingerprint(shape: Column) -> Column:
    return F.xxhash64(shape)


def _shape_fingerprint(shape: str) -> int:
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(shape.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def registry_fingerprints(registry=REGISTRY) -> dict[int, Mapping]:
    return {_shape_fingerprint(s): m for m in registry for s in m.shapes()}


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _role(value: Column, aliases: bool) -> Column:
    role = _text(value)
    out = role
    for other, name in ROLES.items() if aliases else ():
        out = F.when(role == other, name).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _mapped(m: Mapping, get, items) -> Column:
    """Canonical turns of one row; get(name): a top field; items(name): the list of its (role, text) getters."""
    if m.items:
        return items(m)
    join = lambda fields: F.array_join(F.filter(F.array(*[_text(get(f)) for f in fields]), lambda x: x != ""), "\n")
    return F.array(*[_turn(F.lit(role), join(fields)) for role, fields in m.fixed])


def canonical_frame(df: DataFrame, registry=REGISTRY) -> DataFrame:
    """df with columns `layout` and `turns`, by its schema's fingerprint; the schema selects once for all rows."""
    own = registry_fingerprints(registry).get(_shape_fingerprint(schema_shape(df.schema)))
    if own is None:
        return df.withColumns({"layout": F.lit(None).cast("string"), "turns": F.lit(None).cast(TURNS)})
    items = lambda m: F.coalesce(F.transform(F.col(m.items), lambda x: _turn(_role(x[m.role], m.aliases), _text(x[m.text]))), F.array().cast(TURNS))
    return df.withColumns({"turns": _mapped(own, F.col, items), "layout": F.lit(own.name)})


def canonical_json(df: DataFrame, json: str, registry=REGISTRY) -> DataFrame:
    """df with `layout` and `turns` by the fingerprint of each row's JSON text."""
    known = registry_fingerprints(registry)
    parsed = df.withColumn("__v", F.try_parse_json(json)).withColumn("__f", fingerprint(json_shape(F.col("__v"))))
    v = F.col("__v")
    get = lambda name: F.try_variant_get(v, f"$.{name}", "string")

    def items(m):
        rows = F.try_variant_get(v, f"$.{m.items}", f"array<struct<{m.role}:string,{m.text}:string>>")
        return F.transform(rows, lambda x: _turn(_role(x[m.role], m.aliases), _text(x[m.text])))

    turns, layout = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for f, m in known.items():
        turns = F.when(F.col("__f") == f, _mapped(m, get, items).cast(TURNS)).otherwise(turns)
        layout = F.when(F.col("__f") == f, m.name).otherwise(layout)
    return parsed.withColumns({"layout": layout, "turns": turns}).drop("__v", "__f")


def turn_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) from one row per turn: conv_id, turn, role, text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(turn))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def restored(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """df with `formatted` and `loss` (turn, start, length) instead of the turns."""
    safe = df.withColumn("__safe", F.transform(turns, lambda x: F.struct(escaped(x["role"]).alias("role"), escaped(x["text"]).alias("text"))))
    block = lambda x: F.concat(F.lit(START), x["role"], F.lit(SEP), x["text"], F.lit(STOP))
    span = lambda x, i: F.struct(i.alias("turn"), (F.length(x["role"]) + len(START + SEP)).alias("start"), F.length(x["text"]).alias("length"), (x["role"] == "assistant").alias("use"))
    spans = F.filter(F.transform("__safe", span), lambda s: s["use"])
    return safe.withColumns(
        {
            "formatted": F.array_join(F.transform("__safe", block), ""),
            "loss": F.transform(spans, lambda s: F.struct(s["turn"], s["start"], s["length"])),
        }
    ).drop("__safe", turns)


def _blocks(formatted: Column) -> Column:
    return F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")


def read_back(df: DataFrame) -> DataFrame:
    """df (formatted, loss) with `turns` and `learned`: the text under the loss mask."""
    cut = df.withColumn("__blocks", _blocks(F.col("formatted")))
    turn = lambda b: _turn(
        restored(F.substring_index(F.substr(b, F.lit(len(START) + 1)), SEP, 1)),
        restored(F.substr(b, F.locate(SEP, b) + len(SEP))),
    )
    learned = F.transform("loss", lambda s: restored(F.substr(F.get("__blocks", s["turn"]), s["start"] + 1, s["length"])))
    return cut.withColumns({"turns": F.transform("__blocks", turn), "learned": F.array_join(learned, "")}).drop("__blocks")


def digest(rows: DataFrame) -> DataFrame:
    conversations = canonical_frame(turn_rows(rows)).select("conv_id", "turns")
    back = read_back(format_turns(conversations))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(said).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        sha(F.col("learned")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_chat(spark, sf_dir) -> DataFrame:
    from .common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, s AS text FROM VALUES (0L, 'user', :s), (1L, 'assistant', :s) AS x(t, r, s)", args={"s": said})
    return digest(rows.unionByName(more))


def _escaped_sql(c: str) -> str:
    return f"(length({c}) + length({c}) - length(regexp_replace({c}, '[<\\[\\\\]', '', 'g')))"


OP6_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(START + SEP + STOP)} + {_escaped_sql('role')} + {_escaped_sql('text')}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
