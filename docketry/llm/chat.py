"""Chat formatting: records of many layouts become canonical turns, then marked text with a loss mask."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import let

# --- fixed values of the template --------------------------------------------------------------------
START, END = "<|im_start|>", "<|im_end|>"
TURN_END = END + "\n"
#: A control string is its first character and its rest; escaped, a backslash stands between.
FIRST = r"([<\[])"
REST = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|/?SYS>|</?SYS>>)"
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}
TURN = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def escape(text: Column) -> Column:
    """Control strings broken by one more backslash than they hold; ``unescape`` takes it out again."""
    return F.regexp_replace(text, FIRST + r"(\\*)" + REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, FIRST + r"\\(\\*)" + REST, "$1$2$3")


class Layout(NamedTuple):
    """A record layout: the leaf paths it must and may have, and how it becomes turns."""

    name: str
    required: Sequence[str]
    optional: Sequence[str]
    turns: Callable[[Callable[[str], Column]], Column]


def _turn(role: str | Column, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _listed(path: str, role: str, text: str):
    def field(x: Column, name: str, names: set[str]) -> Column:
        return x[name] if name in names else F.lit(None).cast("string")

    return lambda get: F.transform(get(path), lambda x: _turn(
        field(x, role, get.fields(path)), field(x, text, get.fields(path))))


def _fields(*pairs: tuple[str, str]):
    """Turns from single fields; a field that is null gives no turn."""
    return lambda get: F.filter(
        F.array(*[F.when(get(f).isNotNull(), _turn(role, get(f))) for role, f in pairs]), lambda x: x.isNotNull())


def _instruct(get) -> Column:
    asked = F.concat_ws("\n\n", get("instruction"), F.when(get("input") != "", get("input")))
    return F.filter(
        F.array(F.when(get("system").isNotNull(), _turn("system", get("system"))), _turn("user", asked),
                _turn("assistant", get("output"))), lambda x: x.isNotNull())


LAYOUTS = (
    Layout("messages", ["messages[].role"], ["messages[].content"], _listed("messages", "role", "content")),
    Layout("exchanges", ["conversations[].from"], ["conversations[].value"], _listed("conversations", "from", "value")),
    Layout("completion", ["prompt", "response"], ["system"], _fields(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ["instruction", "output"], ["input", "system"], _instruct),
)


def leaf_paths(schema: T.StructType, at: str = "") -> list[str]:
    """Field paths of the values in a schema; [] marks an array's elements."""
    out = []
    for f in schema.fields:
        path, kind = at + f.name, f.dataType
        if isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        out += leaf_paths(kind, path + ".") if isinstance(kind, T.StructType) else [path]
    return out


def _present(path: str) -> Column:
    """Whether a record has a value at a path (in any element, for arrays)."""
    if "[]" not in path:
        return F.col(f"row.{path}").isNotNull()
    array, _, inner = path.partition("[]")
    inner = inner.lstrip(".")
    return F.coalesce(F.exists(F.col(f"row.{array}"), lambda x: (x[inner] if inner else x).isNotNull()), F.lit(False))


def fingerprint(schema: T.StructType, fields: Sequence[str]) -> Column:
    """Hash of the sorted paths that hold a value in a record."""
    paths = sorted(p for p in leaf_paths(schema) if p.partition("[")[0].partition(".")[0] in fields)
    return F.xxhash64(F.array_join(F.array(*[F.when(_present(p), F.lit(p)) for p in paths]), "\n"))


def canonical(records: DataFrame, fields: Sequence[str], layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Adds ``layout`` and ``turns`` (array of role and text) to records whose columns ``fields`` hold prompts in any layout.

    The paths with values are hashed, and the hash selects a declarative mapping; each layout is known under the hash of
    every choice of its optional paths.  A record of no known layout has null for both.  Roles known under other names are
    renamed; null roles and texts are empty.  Columns outside ``fields`` pass through and don't count.
    """
    rows = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns if c not in ("layout", "turns")]).alias("row"))
    schema = rows.schema["row"].dataType
    names = set(schema.names)

    def get(name: str) -> Column:
        return F.col(f"row.{name}") if name in names else F.lit(None).cast("string")

    get.fields = lambda name: set(schema[name].dataType.elementType.names)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN)
    for x in layouts:
        if any(p.partition("[")[0] not in names for p in x.required):
            continue
        known = [F.xxhash64(F.lit("\n".join(sorted([*x.required, *more])))) for n in range(len(x.optional) + 1) for more in combinations(x.optional, n)]
        hit = F.col("print").isin(*known)
        layout, turns = F.when(hit, x.name).otherwise(layout), F.when(hit, x.turns(get)).otherwise(turns)
    rows = rows.withColumn("print", fingerprint(schema, fields)).select("row", layout.alias("layout"), turns.alias("turns"))
    alias = F.create_map(*[F.lit(v) for pair in ROLES.items() for v in pair])
    renamed = F.transform("turns", lambda t: F.struct(F.coalesce(alias[t["role"]], t["role"]).alias("role"), t["text"].alias("text")))
    return rows.select("row.*", "layout", renamed.alias("turns"))


def running_sums(sizes: Column, block: int = 64) -> Column:
    """The sum of all entries before each one: sums of whole blocks, and of the entries before it in its own block."""
    def add(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def of(n: Column) -> Column:
        # no block at all for an empty array
        return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda b: b < n)

    def within(arrays: Column) -> Column:
        whole, before = arrays["sizes"], arrays["before"]
        return F.transform(whole, lambda x, i: F.get(before, F.floor(i / block).cast("int")) + add(
            F.slice(whole, F.floor(i / block).cast("int") * block + 1, i % block)))

    def blocks(arrays: Column) -> Column:
        before = F.transform(arrays["sums"], lambda x, b: add(F.slice(arrays["sums"], F.lit(1), b)))
        return let(F.struct(arrays["sizes"].alias("sizes"), before.alias("before")), within)

    def sums(whole: Column) -> Column:
        total = F.transform(of(F.ceil(F.size(whole) / block).cast("int")), lambda b: add(F.slice(whole, b * block + 1, F.lit(block))))
        return let(F.struct(whole.alias("sizes"), total.alias("sums")), blocks)

    return let(sizes, sums)


def formatted(records: DataFrame, learn: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` (start and length in code points of the texts to learn) to records with ``turns``.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``; roles are URL-encoded, control strings inside texts escaped.  Null turns
    give null; no turns give an empty text.  Other columns pass through whatever their names, but for ``formatted`` and
    ``loss_spans``, which are replaced.
    """
    rows = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns if c not in ("formatted", "loss_spans")]).alias("row"))
    head = lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
    parts = F.transform("row.turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learn).alias("learn")))
    rows = rows.withColumn("parts", parts)
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(TURN_END))), "")
    sizes = F.transform("parts", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(TURN_END))

    def spans(starts: Column) -> Column:
        found = F.transform("parts", lambda p, i: F.when(p["learn"], F.struct(
            (F.get(starts, i) + F.length(p["head"])).cast("int").alias("start"), F.length(p["body"]).alias("length"))))
        return F.filter(found, lambda s: s.isNotNull())

    return rows.withColumn("formatted", text).withColumn("loss_spans", let(running_sums(sizes), spans)).select("row.*", "formatted", "loss_spans")


def read_turns(text: Column) -> Column:
    """Turns read back from formatted text."""
    pieces = F.slice(F.split(text, r"<\|im_start\|>"), 2, 1 << 30)
    body = lambda p: F.substring_index(p, TURN_END, 1)
    return F.transform(pieces, lambda p: let(F.instr(p, F.lit("\n")), lambda n: F.struct(
        F.url_decode(F.substring(p, F.lit(1), n - 1)).alias("role"),
        unescape(body(F.substring(p, n + 1, F.length(p)))).alias("text"))))


def masked_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"]))), "")
