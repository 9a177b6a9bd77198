"""Chat formatting: records of unlike layouts to canonical turns, turns to marked text with a loss mask, and back.

A record's layout is the set of its nested field paths. The paths are written
out in one canonical text (the shape), the shape is hashed, and the hash, the
fingerprint, selects a declarative mapping that says where turns are found.
Fields that no mapping names take no part. Everything is DataFrame functions;
data of nested columns is looked at as VARIANT, so JSON text, arrays of structs
and plain columns go one way.

Each turn becomes `<|im_start|>role\\ntext<|im_end|>\\n`. In texts and roles a
backslash is put into whatever reads `<`, any backslashes, `|`, so no control
string can come from data, and taking one backslash out gives the data back.
The mask has an entry for each turn: where in the turn's block the loss starts,
and over how many code points (0 where the turn is not learned). Entries count
from their own block, so applying a mask takes time in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|line|>"
TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Say:
    """A turn of one role: its fields' texts, joined by empty lines; no turn where all are null."""

    role: str
    fields: tuple[str, ...]

    def turns(self, df: DataFrame) -> Column:
        given = [plain_text(df, f) for f in self.fields]
        text = given[0] if len(given) == 1 else F.concat_ws("\n\n", *[F.when(g != "", g) for g in given])
        said = F.when(F.coalesce(*given).isNotNull(), F.struct(F.lit(self.role).alias("role"), text.alias("text")))
        return F.array_compact(F.array(said))


@dataclass(frozen=True)
class Each:
    """A turn for each element of an array of objects; roles has other names for roles."""

    field: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()

    def turns(self, df: DataFrame) -> Column:
        def turn(element: Column) -> Column:
            role = F.try_variant_get(element, f"$.{self.role}", "string")
            for other, name in self.roles:
                role = F.when(role == other, name).otherwise(role)
            return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(parts_text(F.try_variant_get(element, f"$.{self.text}", "variant")), F.lit("")).alias("text"))

        return F.transform(F.try_variant_get(as_variant(df, self.field), "$", "array<variant>"), turn)


@dataclass(frozen=True)
class Row:
    """The record is one turn of a conversation that has more rows."""

    role: str
    text: str

    def turns(self, df: DataFrame) -> Column:
        role, text = (F.coalesce(plain_text(df, f), F.lit("")) for f in (self.role, self.text))
        return F.array(F.struct(role.alias("role"), text.alias("text")))


@dataclass(frozen=True)
class Mapping:
    """A layout: paths that a record has, paths that it may have, and where its turns are."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    parts: tuple[Say | Each | Row, ...]

    def shapes(self) -> Iterator[str]:
        for n in range(len(self.optional) + 1):
            for more in combinations(self.optional, n):
                yield shape_of([*self.required, *more])


SHARED_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
PARTS = ("messages[].role", "messages[].content[].type", "messages[].content[].text")

#: Layouts known; callers may give others.
MAPPINGS = (
    Mapping("turn_rows", ("role", "text"), ("conv_id", "turn"), (Row("role", "text"),)),
    Mapping("messages", ("messages[].role", "messages[].content"), ("system", "messages[].name"), (Say("system", ("system",)), Each("messages", "role", "content", SHARED_ROLES))),
    Mapping("message_parts", PARTS, ("system", "messages[].name"), (Say("system", ("system",)), Each("messages", "role", "content", SHARED_ROLES))),
    Mapping("shared_conversations", ("conversations[].from", "conversations[].value"), ("system",), (Say("system", ("system",)), Each("conversations", "from", "value", SHARED_ROLES))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), (Say("system", ("system",)), Say("user", ("instruction", "input")), Say("assistant", ("output",)))),
    Mapping("prompt_response", ("prompt", "response"), ("system",), (Say("system", ("system",)), Say("user", ("prompt",)), Say("assistant", ("response",)))),
    Mapping("prompt_completion", ("prompt", "completion"), ("system",), (Say("system", ("system",)), Say("user", ("prompt",)), Say("assistant", ("completion",)))),
    Mapping("question_answer", ("question", "answer"), ("context", "system"), (Say("system", ("system",)), Say("user", ("context", "question")), Say("assistant", ("answer",)))),
)


def _quoted(name: str) -> str:
    plain = all(c.isascii() and (c.isalnum() or c == "_") for c in name) and not name.isdigit()
    return name if plain and name else "`" + name.replace("`", "``") + "`"


def shape_of(paths: Iterable[str]) -> str:
    """The canonical text of a set of paths such as `messages[].role`, as shape() writes it for a record."""
    tree: dict = {}
    for path in paths:
        at = tree
        for step in path.replace("[]", ".[]").split("."):
            at = at.setdefault(step, {})

    def inner(node: dict) -> str:
        if "[]" in node:
            return f"ARRAY<{inner(node['[]'])}>"
        return f"OBJECT<{fields(node)}>" if node else ""

    def fields(node: dict) -> str:
        return ", ".join(_quoted(k) + (f": {inner(v)}" if v else "") for k, v in sorted(node.items()))

    return fields(tree)


def roots(mappings: Sequence[Mapping]) -> list[str]:
    return sorted({p.split(".")[0].removesuffix("[]") for m in mappings for p in (*m.required, *m.optional)})


def _nested(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (ArrayType, MapType, StructType, VariantType))


def as_variant(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, VariantType):
        return F.col(f"`{name}`")
    return F.to_variant_object(F.col(f"`{name}`"))


def plain_text(df: DataFrame, name: str) -> Column:
    """A field as text; null where the table has no such column."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    return parts_text(as_variant(df, name)) if _nested(df, name) else F.col(f"`{name}`").cast("string")


def parts_text(value: Column) -> Column:
    """Text of a variant: a scalar as it is, an array of parts by the `text` of each, in order."""
    kind = F.schema_of_variant(value)
    parts = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    return F.when(kind.startswith("ARRAY"), F.array_join(parts, "")).when(kind != "VOID", F.try_variant_get(value, "$", "string"))


_NAME = r"(?:`(?:[^`]|``)*`|[A-Za-z0-9_]+)"


def shape(df: DataFrame, names: Sequence[str], absent_nulls: bool = True) -> Column:
    """Canonical text of the paths that a record has below these columns, leaf types left out.

    absent_nulls: whether a plain column that is null counts as not there (rows of
    unlike records read into one wide table) or as there (a table of one layout).
    Null fields of nested data are never there.
    """
    found = []
    for name in sorted(names):
        if _nested(df, name):
            kind = F.schema_of_variant(as_variant(df, name))
            found.append(F.when(kind != "VOID", F.concat(F.lit(f"{_quoted(name)}: "), kind)))
        else:
            found.append(F.when(F.col(f"`{name}`").isNotNull() | F.lit(not absent_nulls), F.lit(_quoted(name))))
    if not found:
        return F.lit("")
    known = F.concat_ws(", ", *found)
    known = F.regexp_replace(known, rf"({_NAME}: (?!VOID))|{_NAME}: VOID(?:, )?", "$1")  # fields that are null
    known = F.regexp_replace(known, r"(`(?:[^`]|``)*`)|, (?=>)", "$1")
    return F.regexp_replace(known, r"(`(?:[^`]|``)*`)|(?:: |(?<=ARRAY<))[A-Z_]+(?: NTZ)?(?:\([0-9, ]+\))?(?=[,>]|$)", "$1")


def _fields(df: DataFrame, json: str | None, names: Sequence[str], kept: Sequence[Column]) -> DataFrame:
    """kept, and the fields that mappings name: columns of df, or of the JSON text in one of its columns as VARIANT."""
    if json is None:
        return df.select(*kept, *[F.col(f"`{n}`") for n in names if n in df.columns])
    held = df.select(*kept, F.try_parse_json(F.col(f"`{json}`")).alias("__record"))
    return held.select(*held.columns[:-1], *[F.try_variant_get("__record", f"$.{n}", "variant").alias(n) for n in names])


def canonical(df: DataFrame, carry: Sequence[str], mappings: Sequence[Mapping] = MAPPINGS, absent_nulls: bool = True, json: str | None = None) -> DataFrame:
    """The carried columns, fingerprint, layout (a mapping's name) and turns of each record.

    A record is a row of df, or the JSON object in its column `json`. Records of a
    layout that no mapping has keep their row: layout is null, turns are empty,
    and the fingerprint says what to map; null and malformed JSON, and JSON that
    is no object, have no fields. Null roles and texts are empty. Other columns
    have no effect; a carried column named fingerprint, layout or turns goes.
    """
    names = roots(mappings)
    carried = [c for c in carry if c not in ("fingerprint", "layout", "turns")]
    records = _fields(df, json, names, [F.col(f"`{c}`").alias(f"__kept{i}") for i, c in enumerate(carried)])
    known = [n for n in names if n in records.columns]
    marked = records.withColumn("__print", F.sha2(shape(records, known, absent_nulls), 256))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for m in mappings:
        if set(roots([Mapping(m.name, m.required, (), m.parts)])) <= set(known):
            own = F.col("__print").isin([sha256(s.encode()).hexdigest() for s in m.shapes()])
            found = [p.turns(marked) for p in m.parts if not isinstance(p, Say) or set(p.fields) & set(known)]
            layout = F.when(own, m.name).otherwise(layout)
            turns = F.when(own, F.concat(*found) if len(found) > 1 else found[0]).otherwise(turns)
    kept = [F.col(f"__kept{i}").alias(c) for i, c in enumerate(carried)]
    return marked.select(*kept, F.col("__print").alias("fingerprint"), layout.alias("layout"), turns.cast(TURNS).alias("turns"))


def gathered(records: DataFrame, key: str, position: str) -> DataFrame:
    """One row for each key: the turns of its records, by position (null first), then by role and text.

    Repeated records stay. A null key is a key. A conversation is one row of the
    output, and has to fit into a row.
    """
    lists = records.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("at"), F.col("turns").alias("turns")))).alias("rows"))
    return lists.select(key, F.flatten(F.transform("rows", lambda r: r["turns"])).alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def formatted(df: DataFrame, learned: str = "assistant") -> DataFrame:
    """df with `turns` replaced by formatted (string) and mask (array of start, length for each turn).

    No turns give an empty string and an empty mask. Given columns named formatted or mask go.
    """
    role = lambda t: F.regexp_replace(escaped(t["role"]), "\n", LINE)
    blocks = F.transform("turns", lambda t: F.struct(role(t).alias("role"), escaped(t["text"]).alias("text"), (t["role"] == learned).alias("learned")))
    out = df.withColumns({"__blocks": blocks}).drop("formatted", "mask")
    text = F.array_join(F.transform("__blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit("\n"), b["text"], F.lit(END + "\n"))), "")
    at = lambda b: F.lit(len(START) + 1) + F.length(b["role"])
    mask = F.transform("__blocks", lambda b: F.struct(at(b).alias("start"), F.when(b["learned"], F.length(b["text"])).otherwise(0).alias("length"), b["learned"].alias("learned")))
    return out.withColumns({"formatted": text, "mask": mask}).drop("__blocks", "turns")


def read_back(df: DataFrame) -> DataFrame:
    """df with turns and learned_texts, both taken from formatted and mask alone.

    Given columns of these names are replaced.
    """
    out = df.withColumn("__blocks", F.split("formatted", r"<\|im_end\|>\n"))
    out = out.withColumn("__blocks", F.slice("__blocks", 1, F.size("__blocks") - 1))
    rest = lambda s, start: F.substring(s, start, F.length(s))

    def turn(block: Column) -> Column:
        role = F.substring_index(rest(block, F.lit(len(START) + 1)), "\n", 1)
        text = rest(block, F.length(role) + len(START) + 2)
        return F.struct(unescaped(F.regexp_replace(role, r"<\|line\|>", "\n")).alias("role"), unescaped(text).alias("text"))

    masked = F.zip_with("__blocks", "mask", lambda b, m: F.when(m["learned"], unescaped(F.substring(b, m["start"] + 1, m["length"]))))
    return out.withColumns({"turns": F.transform("__blocks", turn), "learned_texts": F.array_compact(masked)}).drop("__blocks")
