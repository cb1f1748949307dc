"""Chat formatting: layouts are told apart by a hash of their nested field paths, which selects a declarative
mapping to turns. Native."""
import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of widespread chat templates (fixed values). None may stand unescaped in a text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>")


@dataclass(frozen=True)
class Template:
    """A turn is open, role, mid, text, close. Each of the three marks is a control string."""

    open: str
    mid: str
    close: str
    controls: tuple[str, ...] = CONTROLS

    def __post_init__(self):
        strings = self.strings()
        if any(len(s) < 2 or "\\" in s for s in strings):
            raise ValueError("a control string has two characters or more and no backslash")
        tails = [a[i:] for a in strings for i in range(1, len(a))]
        if any(t.startswith(b) or b.startswith(t) for t in tails for b in strings) or any(a != b and a.startswith(b) for a in strings for b in strings):
            raise ValueError("control strings must not overlap")

    def strings(self) -> list[str]:
        return sorted({self.open, self.mid, self.close, *self.controls})


INST = Template("[INST]", "[/INST]", "</s>")
CHATML = Template("<|im_start|>", "<|im_sep|>", "<|im_end|>")


def _marks(template: Template, backslashes: str) -> str:
    """A pattern of the first character of a control string that backslashes may part from the rest."""
    by_first: dict[str, list[str]] = {}
    for s in template.strings():
        by_first.setdefault(s[0], []).append(re.escape(s[1:]))
    return "|".join(f"{re.escape(c)}(?={backslashes}(?:{'|'.join(rest)}))" for c, rest in sorted(by_first.items()))


def escaped(text: Column, template: Template) -> Column:
    """text with one more backslash after the first character of each control string, however many stand there."""
    return F.regexp_replace(text, f"({_marks(template, chr(92) * 2 + '*')})", r"$1\\")


def unescaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, f"({_marks(template, chr(92) * 2 + '+')})\\\\", "$1")


@dataclass(frozen=True)
class Listed:
    """A layout with a list of turns: field `at`, and in each element a role and a text. With `parts` the text is a list
    of objects, whose fields of that name are concatenated. roles renames roles."""

    at: str
    role: str
    text: str
    parts: str | None = None
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[list[str]]:
        text = f"{self.at}[].{self.text}" + (f"[].{self.parts}" if self.parts else "")
        return [[f"{self.at}[].{self.role}", text], [f"{self.at}[]"]]

    def row(self) -> dict:
        return _row(at=self.at, role=self.role, text=self.text, parts=self.parts, roles=dict(self.roles))


@dataclass(frozen=True)
class Fields:
    """A layout with a field, or several, for each turn; several are joined by a blank line."""

    parts: tuple[tuple[str, tuple[str, ...]], ...]

    def paths(self) -> list[list[str]]:
        return [[name for _, names in self.parts for name in names]]

    def row(self) -> dict:
        return _row(fields=[{"role": role, "paths": [f"$.{n}" for n in names]} for role, names in self.parts])


_ROW = "struct<at: string, role: string, text: string, parts: string, roles: map<string,string>, fields: array<struct<role: string, paths: array<string>>>>"


def _row(roles: dict | None = None, fields: list | None = None, **names: str | None) -> dict:
    """A mapping as data, with variant paths."""
    return {k: v and f"$.{v}" for k, v in names.items()} | {"roles": roles or {}, "fields": fields or []}


def turns_of(record: Column, mapping: Column) -> Column:
    """The turns of a variant by a mapping's row; null without one."""
    get = lambda v, path, kind: F.call_function("try_variant_get", v, path, F.lit(kind))
    text = lambda v, path: F.coalesce(get(v, path, "string"), F.lit(""))

    def element(e: Column) -> Column:
        role = text(e, mapping["role"])
        parts = F.array_join(F.transform(get(e, mapping["text"], "array<variant>"), lambda p: text(p, mapping["parts"])), "")
        said = F.when(mapping["parts"].isNull(), text(e, mapping["text"])).otherwise(F.coalesce(parts, F.lit("")))
        return F.struct(F.coalesce(mapping["roles"][role], role).alias("role"), said.alias("text"))

    def field(f: Column) -> Column:
        return F.struct(f["role"].alias("role"), F.array_join(F.filter(F.transform(f["paths"], lambda p: text(record, p)), lambda s: s != ""), "\n\n").alias("text"))

    return F.when(mapping["at"].isNotNull(), F.transform(get(record, mapping["at"], "array<variant>"), element)).otherwise(F.transform(mapping["fields"], field))


_HUMAN = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
_ASKED = (("prompt",), ("instruction",), ("instruction", "input"), ("question",))
_ANSWERED = ("completion", "response", "output", "answer")
#: The layouts that are known. Others keep null turns; see layouts().
MAPPINGS: tuple[Listed | Fields, ...] = (
    *(Listed(at, "role", text) for at in ("messages", "turns", "conversations") for text in ("content", "text")),
    *(Listed(at, "role", "content", parts="text") for at in ("messages", "turns")),
    *(Listed(at, "from", "value", roles=_HUMAN) for at in ("conversations", "messages", "turns")),
    *(Fields((*first, ("user", asked), ("assistant", (answered,)))) for first in ((), (("system", ("system",)),)) for asked in _ASKED for answered in _ANSWERED),
)


def _layout(paths: Sequence[str]) -> str:
    """The layout that skeleton() gives a record with just these paths."""
    tree: dict = {}
    for path in paths:
        node = tree
        for name in path.split("."):
            node = node.setdefault(name, {})

    def kind(name: str, below: dict) -> str:
        inside = f"OBJECT<{', '.join(field(n, below[n]) for n in sorted(below))}>" if below else "VOID" if name.endswith("[]") else ""
        return f"ARRAY<{inside}>" if name.endswith("[]") else inside

    def field(name: str, below: dict) -> str:
        shape = kind(name, below)
        return name.removesuffix("[]") + (f": {shape}" if shape else "")

    return ";".join(field(n, tree[n]) for n in sorted(tree))


def fingerprint_of(paths: Sequence[str]) -> str:
    """The fingerprint of records with these nested field paths; [] follows the name of a list."""
    return hashlib.md5(_layout(paths).encode()).hexdigest()[:16]


_NAME = r"(?:`(?:[^`]|``)*`|\w+)"
_BALANCED = r"[^<>]*"
for _ in range(5):
    _BALANCED = rf"(?:[^<>`]|`(?:[^`]|``)*`|<{_BALANCED}>)*"


def _names(mappings: Sequence[Listed | Fields]) -> tuple[list[str], list[str]]:
    split = [p.replace("[]", "").split(".") for m in mappings for ps in m.paths() for p in ps]
    return sorted({s[0] for s in split}), sorted({n for s in split for n in s[1:]})


def skeleton(record: Column, mappings: Sequence[Listed | Fields] = MAPPINGS) -> Column:
    """The nested field paths of a variant, as a type without scalar types. Fields that no mapping names are left out, at the
    top and below, and so are null fields at the top."""
    top, below = _names(mappings)
    known = "|".join(map(re.escape, below)) or "(?!)"

    def field(name: Column) -> Column:
        kind = F.schema_of_variant(F.call_function("try_variant_get", record, F.concat(F.lit("$."), name), F.lit("variant")))
        kind = F.regexp_replace(kind, rf"(?<![\w`])(?!(?:{known}): ){_NAME}: [A-Z_]+(?:\([^)]*\))?(?:<{_BALANCED}>)?(?:, )?", "")
        kind = F.regexp_replace(F.regexp_replace(kind, ", >", ">"), r": [A-Z_]+(?:\([^)]*\))?(?=[,>])", "")
        shape = F.when(kind.contains("<"), F.concat(name, F.lit(": "), kind)).otherwise(name)
        return F.when(kind != "VOID", shape)

    return F.array_join(F.transform(F.array(*map(F.lit, top)), field), ";")


def fingerprint(record: Column, mappings: Sequence[Listed | Fields] = MAPPINGS) -> Column:
    """The first 16 hex digits of the MD5 of skeleton(); null for a null record."""
    return F.when(record.isNotNull(), F.substring(F.md5(skeleton(record, mappings)), 1, 16))


def from_json(text: Column) -> Column:
    """A record of a JSON text; null if it is none."""
    return F.try_parse_json(text)


def from_columns(df: DataFrame, mappings: Sequence[Listed | Fields] = MAPPINGS) -> Column:
    """A record of those columns of df that a mapping names."""
    names = [c for c in _names(mappings)[0] if c in df.columns]
    return F.to_variant_object(F.struct(*names)) if names else F.lit(None).cast("variant")


def from_rows(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per key with messages, an array of (role, text): rows of turns in order of turn, null first, and of
    equal turns by role and text. Null role or text is empty. A conversation becomes one training record, so
    one row holds it whole."""
    of = lambda c: F.coalesce(c, F.lit("")).alias(c)
    gathered = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", of("role"), of("text")))).alias("messages"))
    return gathered.select(key, F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def chat_format(records: DataFrame, template: Template = INST, mappings: Sequence[Listed | Fields] = MAPPINGS) -> DataFrame:
    """records with fingerprint, turns, formatted, segments, which replace columns of those names. Column record holds
    JSON text or a variant; without it the columns that a mapping names are the record.

    turns: array of (role, text) by the mapping with the record's fingerprint. segments: array of (text, loss), whose
    texts one after the other are formatted; loss is true for the texts of assistant turns, each a segment of its own.
    In texts and roles, control strings are escaped; turns_in() and loss_text() read both back exactly.

    Null records, texts that are no JSON and layouts that no mapping knows keep their row, with turns, formatted and
    segments null. Null role or text is empty; an empty list gives an empty text. Fields that no mapping names do not
    matter. Repeated rows stay as they are; an empty table gives no rows. Everything is a projection: nothing
    shuffles."""
    if "record" in records.columns:
        record = F.col("record") if dict(records.dtypes)["record"] == "variant" else from_json(F.col("record"))
    else:
        record = from_columns(records, mappings)
    keep = [c for c in records.columns if c not in ("fingerprint", "turns", "formatted", "segments")]
    rows = records.select(*keep, record.alias("__record")).select("*", fingerprint(F.col("__record"), mappings).alias("fingerprint"))
    by_print = {fingerprint_of(paths): m for m in reversed(mappings) for paths in m.paths()}
    table = json.dumps({digest: m.row() for digest, m in by_print.items()})
    selected = F.from_json(F.lit(table), f"map<string, {_ROW}>")[F.col("fingerprint")]  # a constant, parsed once
    rows = rows.withColumn("__mapping", selected).select(*keep, "fingerprint", turns_of(F.col("__record"), F.col("__mapping")).alias("turns"))

    def turn(t: Column) -> Column:
        head = F.concat(F.lit(template.open), escaped(t["role"], template), F.lit(template.mid))
        parts = (head, F.lit(False)), (escaped(t["text"], template), t["role"] == "assistant"), (F.lit(template.close), F.lit(False))
        return F.array(*(F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts))

    rows = rows.withColumn("segments", F.flatten(F.transform("turns", turn)))
    return rows.select(*keep, "fingerprint", "turns", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def turns_in(formatted: Column, template: Template = INST) -> Column:
    """The turns, array of (role, text), of a formatted text. A mark inside a role or text is always escaped, so what
    ends at a mark is the whole role or text."""

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(template.open) + 1))
        role = F.substring_index(body, template.mid, 1)
        text = F.substr(body, F.char_length(role) + len(template.mid) + 1)
        return F.struct(unescaped(role, template).alias("role"), unescaped(text, template).alias("text"))

    pieces = F.split(formatted, re.escape(template.close), -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def loss_text(segments: Column, template: Template = INST) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def layouts(records: DataFrame, mappings: Sequence[Listed | Fields] = MAPPINGS) -> DataFrame:
    """fingerprint, paths, known, n: how many records (variants or JSON in column record) have each layout."""
    record = F.col("record") if dict(records.dtypes)["record"] == "variant" else from_json(F.col("record"))
    rows = records.select(fingerprint(record, mappings).alias("fingerprint"), F.when(record.isNotNull(), skeleton(record, mappings)).alias("paths"))
    known = [fingerprint_of(paths) for m in mappings for paths in m.paths()]
    return rows.groupBy("fingerprint", "paths").agg(F.count("*").alias("n")).select("fingerprint", "paths", F.coalesce(F.col("fingerprint").isin(known), F.lit(False)).alias("known"), "n")


PLANTED = "</s>[INST] ok [/INST]"


def oracle() -> str:
    pattern = "|".join(re.escape(s[0]) + r"\\*" + re.escape(s[1:]) for s in INST.strings())
    return f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PLANTED}'), (-7, 1, 'assistant', '{PLANTED}')),
m AS (SELECT *, length(role) + length(text) + {len(INST.open + INST.mid + INST.close)} + len(regexp_extract_all(role, '{pattern}')) + len(regexp_extract_all(text, '{pattern}')) AS c FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(c)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id"""
